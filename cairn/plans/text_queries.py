"""Queries of the text, scoring and selection operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import classify as C
from cairn.functions import text as T
from cairn.operators import pack, score, select
from cairn.operators.snippet import active_mask, lines_of, slice_lines

from .inputs import SYMBOLS_SQL, TASKS_SQL, kw, ordered_distinct, overlap, sql_list, symbols, table, tasks, tok

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# Synonyms of the queries: canonical name to (members, whether one brings the whole group).
SYNONYMS = {"hardware": (("bolt", "gear", "widget"), True), "color": (("blue", "red", "green"), False)}


@query("identifier_tokens", f"WITH {SYMBOLS_SQL} SELECT no, array_to_string({tok('concat(name, kind, id)')}, ' ') AS tokens FROM sym")
def identifier_tokens(spark, d):
    return symbols(spark, d).select("no", F.array_join(T.identifier_tokens(F.concat("name", "kind", "id")), " ").alias("tokens"))


@query("symbol_token_set", f"WITH {SYMBOLS_SQL} SELECT no, array_to_string(list_sort(list_distinct(flatten([{', '.join(tok(c) for c in score.SEARCHED)}]))), ' ') AS tokens FROM sym")
def symbol_token_set(spark, d):
    return symbols(spark, d).select("no", F.array_join(F.array_sort(T.token_set(*score.SEARCHED)), " ").alias("tokens"))


@query("task_keywords", f"SELECT conv_id, turn, array_to_string({kw('text')}, ' ') AS keywords FROM conversations")
def task_keywords(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.keywords("text"), " ").alias("keywords"))


def _expand_sql(words: str) -> str:
    after: dict[str, list[str]] = {}
    for name in sorted(SYNONYMS):
        members, full = SYNONYMS[name]
        for m in sorted({*members, name}):
            after.setdefault(m, []).extend([name, *(sorted(members) if full else ())])
    cases = " ".join(f"WHEN '{k}' THEN {sql_list([k, *dict.fromkeys(v)])}" for k, v in after.items())
    return ordered_distinct(f"flatten(list_transform({words}, lambda w: CASE w {cases} ELSE [w] END))")


@query("keyword_synonyms", f"SELECT p_partkey, array_to_string({_expand_sql('kws')}, ' ') AS keywords FROM (SELECT p_partkey, {kw('p_name')} AS kws FROM part)")
def keyword_synonyms(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(T.keywords("p_name", SYNONYMS), " ").alias("keywords"))


def _intent_sql(words: str) -> str:
    parts = ", ".join(f"CASE WHEN {overlap(words, sql_list(v))} > 0 THEN '{k}' END" for k, v in T.INTENTS.items())
    return f"array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), ' ')"


@query("task_intents", f"WITH {TASKS_SQL}, w AS (SELECT task_id, flatten(list_transform(regexp_extract_all(lower(task), '[\\p{{L}}\\p{{N}}_@./\\-]+'), lambda r: {tok('r')})) AS ws FROM tasks) SELECT task_id, {_intent_sql('list_filter(ws, lambda x: length(x) > 2)')} AS intents FROM w")
def task_intents(spark, d):
    return tasks(spark).select("task_id", F.array_join(T.intents("task"), " ").alias("intents"))


_CONJ = sql_list(T.CONJUNCTIONS)
_DECOMPOSE_SQL = f"""
WITH w AS (
  SELECT conv_id, turn, lower(trim(text)) AS whole, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM conversations),
f AS (
  SELECT *, list_reduce(list_prepend('', list_transform(ws, lambda x: x)),
           lambda a, x: CASE WHEN list_contains({_CONJ}, x) AND NOT (a = '' OR ends_with(a, chr(10))) THEN concat(a, chr(10))
                             WHEN a = '' OR ends_with(a, chr(10)) THEN concat(a, x) ELSE concat(a, ' ', x) END) AS j FROM w),
p AS (SELECT *, list_filter(string_split(j, chr(10)), lambda x: x <> '') AS parts FROM f),
k AS (SELECT *, list_filter(parts, lambda x: len({kw('x')}) > 0) AS useful FROM p)
SELECT conv_id, turn, CASE WHEN len(parts) > 1 AND len(useful) > 0 THEN len(useful) ELSE 1 END AS n_parts,
       array_to_string(list_transform(CASE WHEN len(parts) > 1 AND len(useful) > 0 THEN useful ELSE [array_to_string(ws, ' ')] END,
         lambda x: coalesce(list_filter(string_split(x, ' '), lambda y: list_contains({sql_list(T.ACTIONS)}, y))[1], 'modify')), ' ') AS actions
FROM k"""


@query("task_decompose", _DECOMPOSE_SQL)
def task_decompose(spark, d):
    rows = table(spark, d, "conversations").withColumn("parts", T.task_parts("text"))
    return rows.select("conv_id", "turn", F.size("parts").alias("n_parts"), F.array_join(F.transform("parts", lambda p: p["action"]), " ").alias("actions"))


@query("token_cost", "SELECT doc_id, greatest(1, length(coalesce(text, '')) // 4) AS plain, greatest(1, CAST(floor(length(coalesce(text, '')) / 3.5) AS INTEGER)) AS claude, greatest(1, CAST(floor(length(coalesce(text, '')) / 3.7) AS INTEGER)) AS gemini FROM documents")
def token_cost(spark, d):
    return table(spark, d, "documents").select("doc_id", *[T.estimate_tokens("text", m).alias(a) for a, m in (("plain", "default"), ("claude", "claude"), ("gemini", "gemini"))])


@query("budget_profile", "WITH p AS (SELECT doc_id, n_chars, CASE WHEN n_chars < 500 THEN 'micro' WHEN n_chars < 3000 THEN 'standard' WHEN n_chars < 9000 THEN 'deep' ELSE 'custom' END AS profile FROM documents) SELECT profile, CASE profile WHEN 'micro' THEN 1500 WHEN 'standard' THEN 4096 WHEN 'deep' THEN 8192 ELSE 777 END AS budget, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM p GROUP BY ALL")
def budget_profile(spark, d):
    n = F.col("n_chars")
    rows = table(spark, d, "documents").withColumn("profile", F.when(n < 500, "micro").when(n < 3000, "standard").when(n < 9000, "deep").otherwise("custom"))
    return rows.groupBy("profile", T.budget("profile", F.lit(777)).alias("budget")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("idf", f"WITH t AS (SELECT doc_id, unnest(list_distinct({tok('text')})) AS token FROM documents), n AS (SELECT count(*) AS n FROM documents) SELECT token, count(*) AS df, round(ln((n + 1) / (count(*) + 1)) + 1, 6) AS idf FROM t, n GROUP BY token, n")
def idf(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.identifier_tokens("text").alias("tokens"))
    return score.idf(docs).select("token", "df", F.round("idf", 6).alias("idf"))


_FALSE_SQL = "CASE p.k " + " ".join(f"WHEN '{k}' THEN {overlap('tn', sql_list([t for a, t in C.FALSE_PAIRS if a == k]))} > 0" for k in sorted({k for k, _ in C.FALSE_PAIRS})) + " ELSE false END"
SCORE_CTE = f"""{TASKS_SQL}, {SYMBOLS_SQL},
st AS (
  SELECT *, list_distinct({tok('name')}) AS tn, list_distinct({tok('file')}) AS tf, list_distinct({tok('signature')}) AS ts,
         list_distinct(flatten([{', '.join(tok(c) for c in score.SEARCHED)}])) AS ta FROM sym),
ix AS (SELECT token, ln(((SELECT count(*) FROM sym) + 1) / (count(*) + 1)) + 1 AS idf FROM (SELECT unnest(ta) AS token FROM st) GROUP BY token),
kq AS (SELECT task_id, {kw('task')} AS kws FROM tasks),
kx AS (SELECT task_id, kws, unnest(kws) AS k FROM kq),
ki AS (SELECT kx.task_id, kx.k, kx.kws, coalesce(ix.idf, 1.0) AS w FROM kx LEFT JOIN ix ON kx.k = ix.token),
pk AS (
  SELECT task_id, any_value(kws) AS kws, st.id, st.no, st.file, any_value(tn) AS tn, any_value(tf) AS tf, any_value(ts) AS ts, any_value(ta) AS ta, any_value(kind) AS kind, any_value(exported) AS exported,
         sum(CASE WHEN list_contains(tn, p.k) THEN w ELSE 0 END) AS wn, sum(CASE WHEN list_contains(tf, p.k) THEN w ELSE 0 END) AS wf,
         sum(CASE WHEN {_FALSE_SQL} THEN 0 ELSE
           (CASE WHEN NOT contains(lower(name), p.k) THEN 0 WHEN list_contains(tn, p.k) THEN 1.5 * w * (1 + 0.8 * (w - 1))
                 WHEN len(list_filter(tn, lambda t: starts_with(t, p.k) AND t <> p.k)) > 0 THEN 0.8 * w * (1 + 0.4 * (w - 1)) ELSE 0.2 * w END)
           + (CASE WHEN contains(lower(file), p.k) THEN 0.45 * w * (1 + 0.24 * (w - 1)) ELSE 0 END)
           + (CASE WHEN length(p.k) > 4 AND list_contains(tn, p.k) THEN 0.5 * w ELSE 0 END) END) AS per
  FROM ki p, st GROUP BY task_id, st.id, st.no, st.file),
cn AS (SELECT *, {overlap('kws', 'tn')} AS n1, {overlap('kws', 'tf')} AS n2, {overlap('kws', 'ts')} AS n3, {overlap('kws', 'ta')} AS n4,
              {overlap(f"list_filter(kws, lambda w: NOT list_contains({sql_list(T.ENTITY_WORDS)}, w))", 'tf')} AS nf FROM pk),
sc AS (
  SELECT *, CASE WHEN n1 > 0 THEN n1 * (5.0 + 0.5 * wn) ELSE 0 END + CASE WHEN n2 > 0 THEN n2 * (1.6 + 0.3 * wf) ELSE 0 END
         + 1.5 * n3 + 0.6 * greatest(0, n4 - n1)
         + CASE WHEN nf > 0 AND kind = 'func' AND exported AND NOT contains(lower(file), 'test') AND NOT contains(lower(file), 'spec') THEN 1.2 ELSE 0 END + per AS task_score
  FROM cn)"""


def scored(spark, d):
    words = tasks(spark).select("task_id", T.keywords("task").alias("kws"))
    return score.score_tasks(symbols(spark, d), words)


@query("task_score", f"WITH {SCORE_CTE} SELECT task_id, no, round(task_score, 4) AS task_score, n4 AS overlap FROM sc")
def task_score(spark, d):
    return scored(spark, d).select("task_id", "no", F.round("task_score", 4).alias("task_score"), "overlap")


_MMR_CTE = f"""{SCORE_CTE},
fi AS (SELECT task_id, id, no, file, round(task_score, 4) AS task_score, round(task_score / 10, 4) AS final FROM sc WHERE task_score > 0),
mm AS (SELECT *, round(final * pow(0.7, row_number() OVER (PARTITION BY task_id, file ORDER BY final DESC, task_score DESC, id DESC) - 1), 6) AS mmr FROM fi),
rk AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY mmr DESC, final DESC, task_score DESC, id DESC) AS seed_no FROM mm),
seeds AS (SELECT * FROM rk WHERE seed_no <= 40)"""


def seeds(spark, d):
    rows = scored(spark, d).filter("task_score > 0")
    rows = rows.withColumns({"task_score": F.round("task_score", 4), "final": F.round(F.col("task_score") / 10, 4)})
    return select.mmr(rows, ["task_id"])


@query("final_score_mmr", f"WITH {_MMR_CTE} SELECT task_id, no, final, mmr, seed_no FROM seeds")
def final_score_mmr(spark, d):
    return seeds(spark, d).select("task_id", "no", "final", "mmr", "seed_no")


_GREEDY = """
gq AS (SELECT s.task_id, s.no, s.id, s.mmr, p.size AS cost, row_number() OVER (PARTITION BY s.task_id ORDER BY s.mmr DESC, s.id) AS k FROM seeds s JOIN sym p ON s.no = p.no),
gw AS (
  SELECT task_id, 0::BIGINT AS k, 0::BIGINT AS used, NULL::BOOLEAN AS taken FROM (SELECT DISTINCT task_id FROM gq)
  UNION ALL
  SELECT gq.task_id, gq.k, CASE WHEN gw.used + gq.cost <= {most} THEN gw.used + gq.cost ELSE gw.used END, gw.used + gq.cost <= {most}
  FROM gw JOIN gq ON gq.task_id = gw.task_id AND gq.k = gw.k + 1)"""


@query("greedy_budget", f"WITH RECURSIVE {_MMR_CTE}, {_GREEDY.format(most=300)} SELECT gq.task_id, gq.no, gw.taken, gw.used FROM gw JOIN gq USING (task_id, k)")
def greedy_budget(spark, d):
    rows = seeds(spark, d).select("task_id", "no", "id", "mmr", F.col("size").alias("cost"))
    out = select.greedy_budget(rows, ["task_id"], 300, [F.col("mmr").desc(), F.col("id")])
    return out.select("task_id", "no", "taken", "used")


_TIER = "CASE WHEN size > 35 THEN 'critical' WHEN size > 15 THEN 'workflow' ELSE 'support' END"
_CAP_SQL = f"""
WITH RECURSIVE {SYMBOLS_SQL},
q AS (SELECT no, file, CASE WHEN size > 35 THEN 3 WHEN size > 15 THEN 2 ELSE 1 END AS most, row_number() OVER (PARTITION BY file ORDER BY price DESC, no) AS k FROM sym),
w AS (
  SELECT file, 0::BIGINT AS k, 0 AS n, NULL::BOOLEAN AS admitted FROM (SELECT DISTINCT file FROM q)
  UNION ALL
  SELECT q.file, q.k, w.n + (w.n < q.most)::INTEGER, w.n < q.most FROM w JOIN q ON q.file = w.file AND q.k = w.k + 1)
SELECT q.no, w.admitted FROM w JOIN q USING (file, k)"""


@query("file_cap", _CAP_SQL)
def file_cap(spark, d):
    size = F.col("size")
    rows = symbols(spark, d).withColumn("tier", F.when(size > 35, "critical").when(size > 15, "workflow").otherwise("support"))
    return select.file_cap(rows, [], [F.col("price").desc(), F.col("no")]).select("no", "admitted")


@query("confidence", f"""WITH {_MMR_CTE}, b AS (SELECT task_id, min(mmr) AS lo, max(mmr) AS hi FROM seeds GROUP BY task_id),
c AS (SELECT s.task_id, s.no, round(0.55 * CASE WHEN hi > lo THEN (mmr - lo) / (hi - lo) ELSE 1 END + 0.45 * (1 - (seed_no - 1) / count(*) OVER (PARTITION BY s.task_id)), 4) AS confidence FROM seeds s JOIN b USING (task_id))
SELECT *, CASE WHEN confidence >= 0.65 THEN 'very_high' WHEN confidence >= 0.35 THEN 'high' WHEN confidence >= 0.10 THEN 'medium' ELSE 'low' END AS confidence_label FROM c""")
def confidence(spark, d):
    rows = seeds(spark, d)
    ends = rows.groupBy("task_id").agg(F.min("mmr").alias("lo"), F.max("mmr").alias("hi"))
    out = select.confidence(rows.join(ends, "task_id"), ["task_id"], [F.col("seed_no")], F.col("lo"), F.col("hi"), "mmr")
    return out.select("task_id", "no", "confidence", "confidence_label")


@query("test_cap", f"""WITH {SYMBOLS_SQL}, n AS (SELECT *, contains(file, '/small/') AS t, count(*) OVER (PARTITION BY kind) AS n FROM sym),
k AS (SELECT *, sum(t::INT) OVER (PARTITION BY kind) AS k, row_number() OVER (PARTITION BY kind, t ORDER BY price DESC, id) AS r FROM n)
SELECT kind, no FROM k WHERE NOT t OR k <= 0.05 * n OR r <= greatest(1, floor(0.05 * n))""")
def test_cap(spark, d):
    return select.cap_tests(symbols(spark, d), ["kind"], F.contains("file", F.lit("/small/")), "price", 0.05).select("kind", "no")


_FOC = f"list_filter(kws, lambda w: NOT list_contains({sql_list(T.ENTITY_WORDS)}, w))"
_TIER_SQL = f"""WITH {TASKS_SQL}, {SYMBOLS_SQL},
p AS (SELECT * REPLACE (CASE no % 7 WHEN 0 THEN replace(file, 'src/', 'src/Models/') WHEN 1 THEN replace(file, 'src/', 'spec/') WHEN 2 THEN replace(file, 'src/', 'models/') ELSE file END AS file) FROM sym),
x AS (SELECT t.task_id, s.*, {kw('task')} AS kws, t.task_id = 2 AS tests, list_distinct({tok('name')}) AS tn, list_distinct({tok('file')}) AS tf, list_distinct({tok('signature')}) AS ts FROM tasks t, p s),
y AS (SELECT *, {overlap(_FOC, 'list_concat(tn, ts)')} AS fns, {overlap(_FOC, 'tf')} AS ff, {overlap('kws', 'tn')} AS kn, {overlap('kws', 'list_concat(tn, tf, ts)')} AS ka, {overlap(_FOC, 'list_concat(tn, tf, ts)')} AS fa, len({_FOC}) AS nf, kind IN ('class', 'interface') OR contains(lower(file), '/models/') AS m, contains(lower(file), 'test') OR contains(lower(file), 'spec') AS t FROM x)
SELECT task_id, no,
  CASE WHEN t AND tests THEN 'workflow' WHEN t THEN 'support' WHEN kind = 'func' AND fns > 0 THEN 'critical' WHEN kind = 'func' AND NOT m AND ff > 0 AND exported THEN 'critical' WHEN m AND kn > 0 AND exported THEN 'critical'
       WHEN m AND fns > 0 THEN 'critical' WHEN kind = 'func' AND NOT m AND ka > 0 AND inbound_calls + outbound_calls > 0 THEN 'workflow' WHEN m AND ka > 0 THEN 'workflow' ELSE 'support' END AS tier,
  CASE WHEN t AND NOT tests THEN 0.55 WHEN nf = 0 OR fa > 0 THEN 1.0 WHEN m THEN 0.25 WHEN ka > 0 THEN 0.58 WHEN regexp_matches(name, '^[A-Z]') AND kn = 0 THEN 0.70 ELSE 1.0 END::DOUBLE AS factor
FROM y"""


@query("context_tier", _TIER_SQL)
def context_tier(spark, d):
    no, file = F.col("no") % 7, F.col("file")
    under = lambda folder: F.replace(file, F.lit("src/"), F.lit(folder))
    placed = symbols(spark, d).withColumn("file", F.when(no == 0, under("src/Models/")).when(no == 1, under("spec/")).when(no == 2, under("models/")).otherwise(file))
    # tokens once a symbol, before the tasks (a stated handful) multiply the rows
    rows = score.symbol_tokens(placed).crossJoin(F.broadcast(tasks(spark).select("task_id", T.keywords("task").alias("kws"), T.intents("task").alias("ints"))))
    return rows.select("task_id", "no", C.context_tier(F.col("kws"), F.col("ints"), ready=True).alias("tier"), C.support_factor(F.col("kws"), F.col("ints"), ready=True).alias("factor"))


_DECL = " OR ".join(f"starts_with(trim(signature), '{p}')" for p in C.DECLARATIONS)
_NOISE_SQL = f"""WITH {SYMBOLS_SQL}
SELECT no, name IN ({', '.join("'" + n + "'" for n in C.BUILTIN_NAMES)}) OR (kind = 'func' AND NOT ({_DECL}) AND NOT exported AND (start_line = end_line OR ends_with(trim(signature), ')') OR NOT (contains(signature, '{{') OR contains(signature, '=>') OR ends_with(trim(signature), ':')))) AS noise,
       kind = 'interface' AND named_imports >= 25 AND inbound_calls = 0 AS generic,
       no % 3 = 0 AS non_core,
       CASE WHEN end_line - start_line >= 100 THEN 0.7 WHEN end_line - start_line >= 50 THEN 0.85 ELSE 1.0 END::DOUBLE AS size_factor,
       CASE role WHEN 'entry_point' THEN 1.3 WHEN 'hub' THEN 1.25 WHEN 'api_surface' THEN 1.2 WHEN 'leaf' THEN 0.85 ELSE 1.0 END::DOUBLE AS role_factor
FROM sym"""


@query("noise_filter", _NOISE_SQL)
def noise_filter(spark, d):
    path = F.concat(F.when(F.col("no") % 3 == 0, F.when(F.col("no") % 2 == 0, "Docs/").otherwise("lib/Samples/")).otherwise("document/"), F.col("file"))
    return symbols(spark, d).select("no", C.is_noise().alias("noise"), C.is_generic_type().alias("generic"), C.is_non_core(path).alias("non_core"), C.size_penalty(C.line_count(F.col("start_line"), F.col("end_line"))).alias("size_factor"), C.role_boost(F.col("role")).alias("role_factor"))


_FINAL_SQL = f"""WITH {SCORE_CTE},
y AS (SELECT sc.*, s.rank, s.name, s.start_line, s.end_line, s.role, s.named_imports, s.inbound_calls, {overlap("list_filter(kws, lambda w: NOT list_contains(" + sql_list(T.ENTITY_WORDS) + ", w))", 'list_concat(tn, sc.tf, ts)')} AS fa,
             {overlap('kws', 'list_concat(tn, sc.tf, ts)')} AS ka, len(list_filter(kws, lambda w: NOT list_contains({sql_list(T.ENTITY_WORDS)}, w))) AS foc, max(task_score) OVER (PARTITION BY task_id) AS most, sc.kind IN ('class', 'interface') AS m, sc.task_id = 2 AS typed
      FROM sc JOIN sym s ON s.no = sc.no)
SELECT task_id, no, round((0.55 * task_score / CASE WHEN most = 0 THEN 1 ELSE most END + 0.25 * least(inbound_calls, 8) / 8 + 0.2 * rank)
  * CASE WHEN kind = 'interface' AND named_imports >= 25 AND inbound_calls = 0 AND n4 = 0 AND NOT typed THEN 0.45 ELSE 1 END
  * CASE WHEN foc = 0 OR fa > 0 THEN 1 WHEN m THEN 0.25 WHEN ka > 0 THEN 0.58 WHEN regexp_matches(name, '^[A-Z]') AND n1 = 0 THEN 0.7 ELSE 1 END
  * CASE WHEN end_line - start_line + 1 > 100 THEN 0.7 WHEN end_line - start_line + 1 > 50 THEN 0.85 ELSE 1 END
  * CASE role WHEN 'entry_point' THEN 1.3 WHEN 'hub' THEN 1.25 WHEN 'api_surface' THEN 1.2 WHEN 'leaf' THEN 0.85 ELSE 1 END * (1 + 0.4 * (no % 4) / 4.0) + 1e-9, 5)::DOUBLE AS final FROM y"""


@query("final_score", _FINAL_SQL)
def final_score(spark, d):
    rows = scored(spark, d).join(F.broadcast(tasks(spark).select("task_id", T.intents("task").alias("ints"))), "task_id")
    most = rows.groupBy("task_id").agg(F.max("task_score").alias("most"))
    rows = rows.join(F.broadcast(most), "task_id")  # one row a task
    value = score.final_score(F.col("task_score"), F.col("most"), F.col("rank"), F.col("kws"), F.col("ints"), (F.col("no") % 4) / 4.0)
    return rows.select("task_id", "no", F.round(value + 1e-9, 5).alias("final"))


@query("baseline_ranking", f"""WITH {TASKS_SQL}, {SYMBOLS_SQL}, x AS (SELECT task_id, no, id, rank, {kw('task')} AS kws, {tok('name')} AS tn, {tok('file')} AS tf, {tok("concat_ws(' ', id, name, file, signature)")} AS ta FROM tasks, sym),
y AS (SELECT *, {overlap('kws', 'ta')} AS hits FROM x), z AS (SELECT *, round(3.0 * {overlap('kws', 'tn')} + 1.2 * {overlap('kws', 'tf')} + hits, 6)::DOUBLE AS score FROM y WHERE hits > 0)
SELECT task_id, id, score, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, rank DESC, id DESC) AS place FROM z""")
def baseline_ranking(spark, d):
    from cairn.operators.evals import grep_ranking

    return grep_ranking(symbols(spark, d), tasks(spark).select("task_id", T.keywords("task").alias("kws")))


_FLOW = sql_list(C.FLOW_WORDS)
_SNIP_SQL = f"""WITH l AS (
  SELECT doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n$', ''), chr(10))) AS t,
         generate_subscripts(string_split(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n$', ''), chr(10)), 1) AS i FROM documents WHERE text <> ''),
a AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM l),
o AS (SELECT *, i <= 2 OR i = n OR (trim(t) <> '' AND ({overlap("regexp_extract_all(trim(t), '[A-Za-z_][A-Za-z0-9_]*')", _FLOW)} > 0 OR contains(lower(trim(t)), 'zzz') OR contains(trim(t), '(') OR contains(trim(t), 'new ') OR contains(trim(t), '.') OR contains(trim(t), '::'))) AS own FROM a),
m AS (SELECT *, own OR coalesce(lag(own) OVER w, false) OR coalesce(lead(own) OVER w, false) AS active FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (active) AS n_active FROM m GROUP BY doc_id"""


@query("snippet_mask", _SNIP_SQL)
def snippet_mask(spark, d):
    kws = F.array(F.lit("zzz"))
    rows = table(spark, d, "documents").filter("text <> ''").withColumn("lines", lines_of(F.col("text")))
    return rows.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size(F.filter(active_mask(F.col("lines"), kws), lambda x: x)).cast("long").alias("n_active"))


_SLICE_SQL = _SNIP_SQL.rsplit("SELECT doc_id, count(*)", 1)[0] + """, g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, active ORDER BY i) AS run FROM m),
h AS (SELECT doc_id, active, run, any_value(n) AS n, count(*) AS k FROM g GROUP BY ALL),
s AS (SELECT doc_id, any_value(n) AS n_lines, CASE WHEN any_value(n) <= 20 THEN any_value(n) ELSE sum(CASE WHEN active OR k <= 4 THEN k ELSE 1 END) END AS n_shown FROM h GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n_lines, 0)::INTEGER AS n_lines, coalesce(s.n_shown, 0)::INTEGER AS n_shown FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id"""


@query("snippet_slice", _SLICE_SQL)
def snippet_slice(spark, d):
    rows = table(spark, d, "documents").withColumn("lines", lines_of(F.col("text")))
    return rows.select("doc_id", F.size("lines").alias("n_lines"), F.size(slice_lines(F.col("lines"), F.array(F.lit("zzz")))).alias("n_shown"))


@query("pack_json", f"WITH {SYMBOLS_SQL}, u AS (SELECT role, no, sum(size) OVER (PARTITION BY role ORDER BY price DESC, no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS used FROM sym) SELECT * FROM u WHERE used <= 4096")
def pack_json(spark, d):
    return pack.prefix_fit(symbols(spark, d), ["role"], [F.col("price").desc(), F.col("no")], 4096, "size").select("role", "no", "used")


def _fold_sql(step_cols: str, anchor: str, out: str) -> str:
    return f"""
WITH RECURSIVE {SYMBOLS_SQL},
q AS (SELECT role, no, size AS cost, 2::BIGINT AS ref, {_TIER} AS tier, row_number() OVER (PARTITION BY role ORDER BY CASE WHEN size > 35 THEN 3 WHEN size > 15 THEN 2 ELSE 1 END DESC, price DESC, no) AS k FROM sym),
w AS (
  SELECT role, 0::BIGINT AS k, 0::BIGINT AS used, {anchor} FROM (SELECT DISTINCT role FROM q)
  UNION ALL
  SELECT q.role, q.k, {step_cols} FROM w JOIN q ON q.role = w.role AND q.k = w.k + 1)
SELECT q.role, q.no, {out}, w.used FROM w JOIN q USING (role, k)"""


def _tiered(spark, d):
    size = F.col("size")
    return symbols(spark, d).withColumns({"tier": F.when(size > 35, "critical").when(size > 15, "workflow").otherwise("support"), "cost": size, "ref_cost": F.lit(2)})


_FORM = "CASE WHEN q.tier <> 'support' AND w.used + q.cost <= 2000 THEN 'full' WHEN w.used + q.ref <= 2000 THEN 'reference' ELSE 'omitted' END"


@query("pack_xml", _fold_sql(f"w.used + CASE {_FORM} WHEN 'full' THEN q.cost WHEN 'reference' THEN q.ref ELSE 0 END, {_FORM}", "''::VARCHAR AS form", "w.form"))
def pack_xml(spark, d):
    return pack.three_way_fit(_tiered(spark, d), ["role"], [F.col("price").desc(), F.col("no")], 2000).select("role", "no", "form", "used")


_FITS = "(w.stopped <> q.tier AND w.used + q.cost <= 3000)"


@query("pack_compact", _fold_sql(f"w.used + CASE WHEN {_FITS} THEN q.cost ELSE 0 END, CASE WHEN {_FITS} THEN w.stopped ELSE q.tier END, {_FITS}", "''::VARCHAR AS stopped, NULL::BOOLEAN AS included", "w.included"))
def pack_compact(spark, d):
    return pack.tier_fit(_tiered(spark, d), ["role"], [F.col("price").desc(), F.col("no")], 3000).select("role", "no", "included", "used")


@query("compact_block", f"""WITH {SYMBOLS_SQL} SELECT no, concat('!', regexp_extract(file, '([^/]*)$', 1), '::', no, '|cri|', substr(kind, 1, 4), '|', substr(role, 1, 4), '|', '0.5', chr(10), '  > ', regexp_extract(file, '([^/]*)$', 1), '::x', chr(10), '  sig: ', signature) AS block FROM sym""")
def compact_block(spark, d):
    none = F.array().cast("array<string>")
    rel = F.struct(none.alias("called_by"), F.array(F.concat("file", F.lit("::x"))).alias("calls"), none.alias("imports"), none.alias("dep_called_by"), none.alias("dep_calls"))
    rows = symbols(spark, d).withColumns({"tier": F.lit("critical"), "confidence": F.lit(0.5), "relations": rel})
    return rows.select("no", pack.compact_block().alias("block"))


@query("xml_escape", "SELECT page_id, md5(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_md5 FROM pages")
def xml_escape(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.xml_escape(F.coalesce("html", F.lit("")))).alias("escaped_md5"))


@query("safeguards", f"""WITH {SYMBOLS_SQL} SELECT no, array_to_string(list_filter(['structure_first', CASE WHEN no % 2 = 0 THEN 'scope_rust' ELSE 'scope' END, CASE WHEN no % 2 = 0 THEN 'types_rust' END, CASE WHEN c THEN 'damping' END, CASE WHEN c THEN 'stamp_signs' END, CASE WHEN c THEN 'index_base' END], lambda x: x IS NOT NULL), ',') AS rules FROM (SELECT no, role = 'hub' AS c FROM sym)""")
def safeguards(spark, d):
    from cairn.operators.rollup import safeguards as rules

    rows = symbols(spark, d).withColumns({"domain": F.when(F.col("role") == "hub", "calculator").otherwise("general"), "langs": F.when(F.col("no") % 2 == 0, F.array(F.lit("py"), F.lit("rs"))).otherwise(F.array(F.lit("py")))})
    return rows.select("no", F.array_join(rules(F.col("domain"), F.col("langs")), ",").alias("rules"))


def flagship(spark, d):
    """Task text to ranked rows within a budget: keywords, IDF, score, diversity by file, greedy budget."""
    rows = seeds(spark, d).select("task_id", "id", "no", "name", "file", "mmr", F.col("size").alias("cost"))
    out = select.greedy_budget(rows, ["task_id"], 300, [F.col("mmr").desc(), F.col("id")])
    return out.filter("taken").select("task_id", "id", "name", "file", "mmr", "cost", "used")
