"""Queries of the smaller operators: grades, layers, plans, suites, file scores, clipped graphs, sources of projects. With their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import classify as C
from cairn.functions import text as T
from cairn.operators import evals, pack, rollup, score
from cairn.sources import projects, resolve

from .inputs import PAGE_PATHS_SQL, SUPPLY_EDGES_SQL, SYMBOLS_SQL, ordered_distinct, page_paths, sql_list, supply_edges, symbols, table, tok

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("grades", f"WITH {SYMBOLS_SQL} SELECT no, CASE WHEN size >= 45 THEN 'A+' WHEN size >= 40 THEN 'A' WHEN size >= 35 THEN 'B' WHEN size >= 30 THEN 'C' WHEN size >= 25 THEN 'D' ELSE 'F' END AS grade FROM sym")
def grades(spark, d):
    """FLT-19."""
    return symbols(spark, d).select("no", C.grade(F.col("size") / 50).alias("grade"))


@query("text_clips", """SELECT doc_id, CASE WHEN length(text) // 4 > 50 THEN concat(substr(text, 1, 200), chr(10), '... [truncated]') ELSE text END AS clipped,
  CASE lang WHEN 'en' THEN '#' WHEN 'fr' THEN '--' ELSE '//' END AS leader FROM documents""")
def text_clips(spark, d):
    """PRJ-16 and PRJ-14."""
    ext = F.when(F.col("lang") == "en", ".PY").when(F.col("lang") == "fr", "sql").otherwise("ts")
    return table(spark, d, "documents").select("doc_id", T.truncate_tokens("text", 50).alias("clipped"), T.comment_leader(ext).alias("leader"))


@query("symbol_kinds", f"WITH {SYMBOLS_SQL} SELECT no, CASE kind WHEN 'func' THEN 12 WHEN 'class' THEN 5 ELSE 11 END AS code FROM sym")
def symbol_kinds(spark, d):
    """PRJ-18."""
    return symbols(spark, d).select("no", T.lsp_kind(F.upper("kind")).alias("code"))


@query("benchmark_tokens", f"SELECT conv_id, turn, array_to_string({ordered_distinct('list_filter(' + tok("replace(coalesce(text, chr(32)), ':', ' ')") + ', lambda w: length(w) > 2 AND NOT list_contains(' + sql_list(T.TASK_STOP_WORDS) + ', w))')}, ' ') AS tokens FROM conversations")
def benchmark_tokens(spark, d):
    """PRJ-04."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.benchmark_tokens("text"), " ").alias("tokens"))


_TIER = "CASE WHEN size > 35 THEN 'critical' WHEN size > 15 THEN 'workflow' ELSE 'support' END"


def _tier():
    return F.when(F.col("size") > 35, "critical").when(F.col("size") > 15, "workflow").otherwise("support")


@query("tier_layers", f"WITH {SYMBOLS_SQL} SELECT file, {_TIER} AS tier, string_agg(id, ',' ORDER BY price, id) AS ids FROM sym GROUP BY ALL")
def tier_layers(spark, d):
    """TK-12."""
    out = pack.layers(symbols(spark, d).withColumn("tier", _tier()), ["file"], "price")
    return out.select("file", "tier", F.array_join("ids", ",").alias("ids"))


@query("open_next", f"""WITH {SYMBOLS_SQL}, f AS (SELECT *, {_TIER} AS tier, CASE no % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'reference' ELSE 'omitted' END AS form, size - 10 AS score FROM sym),
r AS (SELECT role, id, row_number() OVER (PARTITION BY role ORDER BY (form = 'omitted') DESC, CASE tier WHEN 'critical' THEN 3 WHEN 'workflow' THEN 2 ELSE 1 END DESC, score DESC, price DESC, id) AS plan_no FROM f WHERE form <> 'full' AND NOT (tier = 'support' AND score <= 0))
SELECT * FROM r WHERE plan_no <= 8""")
def open_next(spark, d):
    """TK-05."""
    n = F.col("no") % 3
    rows = symbols(spark, d).withColumns({"tier": _tier(), "form": F.when(n == 0, "full").when(n == 1, "reference").otherwise("omitted"), "score": F.col("size") - 10, "value": F.col("price")})
    return pack.expansion_plan(rows, ["role"]).select("role", "id", "plan_no")


@query("compact_graph", "SELECT p_brand AS id, count(*)::INTEGER AS symbols, CASE WHEN length(string_agg(p_name, ' ' ORDER BY p_name, p_partkey)) > 60 THEN concat(substr(string_agg(p_name, ' ' ORDER BY p_name, p_partkey), 1, 60), '...') ELSE string_agg(p_name, ' ' ORDER BY p_name, p_partkey) END AS summary FROM part GROUP BY p_brand")
def compact_graph(spark, d):
    """SNK-10."""
    names = F.sort_array(F.collect_list("p_name"))
    files = table(spark, d, "part").groupBy(F.col("p_brand").alias("id")).agg(names.alias("symbols"), F.array_join(names, " ").alias("summary"))
    return pack.compact_graph(files).select("id", "symbols", "summary")


@query("suite_means", "WITH x AS (SELECT doc_id, (doc_id % 7) / 7.0 AS score, (doc_id % 5) / 10.0 AS lift, (doc_id % 3) / 3.0 AS utilization, doc_id % 4 = 0 AS guarded FROM documents) SELECT count(*) AS cases, round(avg(score), 4)::DOUBLE AS score, round(avg(lift), 4)::DOUBLE AS lift, round(avg(utilization), 4)::DOUBLE AS utilization, round(avg(guarded::INT), 4)::DOUBLE AS guarded_rate FROM x")
def suite_means(spark, d):
    """AG-22."""
    k = F.col("doc_id")
    return evals.suite_means(table(spark, d, "documents").select(((k % 7) / 7.0).alias("score"), ((k % 5) / 10.0).alias("lift"), ((k % 3) / 3.0).alias("utilization"), (k % 4 == 0).alias("guarded")))


@query("context_score", """WITH x AS (SELECT doc_id, (doc_id % 11) / 10.0 AS r, (doc_id % 3) / 2.0 AS c, (doc_id % 5) / 4.0 AS p, (doc_id % 4) / 3.0 AS pc, (doc_id % 2)::DOUBLE AS f FROM documents)
SELECT doc_id, round((0.55 * r + 0.15 * c + 0.12 * p + 0.10 * pc + 0.08 * (1 - f)) * CASE WHEN doc_id % 6 = 0 THEN 0.75 ELSE 1 END + 1e-9, 3)::DOUBLE AS score, round(r - greatest(p, pc, 0), 4)::DOUBLE AS lift FROM x""")
def context_score(spark, d):
    """AG-20."""
    k = F.col("doc_id")
    r, c, p, pc, f = (k % 11) / 10.0, (k % 3) / 2.0, (k % 5) / 4.0, (k % 4) / 3.0, (k % 2).cast("double")
    value = evals.graph_score(r, c, p, pc, f, k % 6 == 0)
    return table(spark, d, "documents").select("doc_id", F.round(value + 1e-9, 3).alias("score"), evals.lift(r, p, pc).alias("lift"))


@query("required_ranks", f"""WITH {SYMBOLS_SQL}, s AS (SELECT role AS case_id, id, row_number() OVER (PARTITION BY role ORDER BY price DESC, no) AS place FROM sym),
e AS (SELECT DISTINCT role AS case_id, substr(name, 1, 6) AS name FROM sym)
SELECT e.case_id, e.name, (SELECT min(place) FROM s WHERE s.case_id = e.case_id AND contains(lower(s.id), lower(e.name))) AS place FROM e""")
def required_ranks(spark, d):
    """WN-09: names are searched for in the ids of their case."""
    from pyspark.sql import Window

    s = symbols(spark, d)
    ranked = s.select(F.col("role").alias("case_id"), "id", F.row_number().over(Window.partitionBy("role").orderBy(F.col("price").desc(), "no")).alias("place"))
    return evals.required_ranks(s.select(F.col("role").alias("case_id"), F.substring("name", 1, 6).alias("name")).distinct(), ranked).select("case_id", "name", "place")


@query("agent_quality", """WITH x AS (SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'user') AS u, list(text ORDER BY turn) FILTER (role <> 'user') AS a, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id AS case_id, 0.0::DOUBLE AS knowledge_coverage, 1.0::DOUBLE AS file_coverage, round(1 - n / 100.0, 3)::DOUBLE AS token_efficiency, round(0.25 + 0.15 * 0.5 + 0.15 * (1 - n / 100.0), 3)::DOUBLE AS quality FROM x""")
def agent_quality(spark, d):
    """AG-23: knowledge that no text has, a file that is there, half the tiers critical, a turn a token."""
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("case_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"), F.count("*").alias("used"))
    rows = rows.withColumns({
        "knowledge": F.array(F.lit("zqzqzq wvwvwv")),
        "texts": F.transform("t", lambda x: x["text"]),
        "files_to_edit": F.array(F.concat(F.lit("Conv"), F.col("case_id").cast("string"))),
        "files": F.array(F.concat(F.lit("src/conv"), F.col("case_id").cast("string"), F.lit(".py"))),
        "tiers": F.array(F.lit("critical"), F.lit("support")),
        "budget": F.lit(100),
    })
    return evals.agent_quality(rows).select("case_id", "knowledge_coverage", "file_coverage", "token_efficiency", "quality")


@query("focused_files", """WITH f AS (SELECT p_brand AS id, list(p_name) AS names, list(DISTINCT p_type) AS imports, count(*) / 1000.0 AS importance FROM part GROUP BY p_brand),
p AS (SELECT id, importance, sum(CASE WHEN contains(lower(id), k) THEN 3 ELSE 0 END + CASE WHEN len(list_filter(names, lambda n: contains(lower(n), k))) > 0 THEN 2 ELSE 0 END + CASE WHEN len(list_filter(imports, lambda n: contains(lower(n), k))) > 0 THEN 1 ELSE 0 END) AS points
      FROM f, (VALUES ('ring'), ('brand#1'), ('small')) t(k) GROUP BY ALL)
SELECT id, round(points + 2 * importance, 6)::DOUBLE AS score FROM p WHERE points > 0""")
def focused_files(spark, d):
    """AG-26."""
    files = table(spark, d, "part").groupBy(F.col("p_brand").alias("id")).agg(F.collect_list("p_name").alias("names"), F.collect_set("p_type").alias("imports"), (F.count("*") / 1000.0).alias("importance"))
    return rollup.focused_files(files.withColumn("summary", F.lit(None).cast("string")), ["ring", "Brand#1", "small"]).select("id", "score")


@query("missing_keywords", """WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS keyword FROM part UNION SELECT DISTINCT lower(event_type) FROM events)
SELECT keyword FROM w WHERE length(keyword) > 2 AND NOT EXISTS (SELECT 1 FROM part WHERE list_contains(string_split(lower(p_name), ' '), keyword))""")
def missing_keywords(spark, d):
    """SO-04: event types are the words that no part has in its name."""
    words = table(spark, d, "part").select(F.explode(T.keywords("p_name")).alias("k")).unionByName(table(spark, d, "events").select(F.explode(T.keywords("event_type")).alias("k")))
    task = words.distinct().select(F.array("k").alias("kws"))
    named = table(spark, d, "part").select(F.col("p_name").alias("name"), *[F.lit("").alias(c) for c in ("id", "file", "kind", "signature")])
    return rollup.missing_keywords(named, task)


@query("semantic_blend", "SELECT vec_id, round(CASE WHEN vec_id % 50 = 0 THEN 0.7 * (vec_id % 10) + 3.0 * (vec_id % 7) / 7.0 ELSE vec_id % 10 END, 6)::DOUBLE AS score FROM embeddings")
def semantic_blend(spark, d):
    """FN-07."""
    k = F.col("vec_id")
    return table(spark, d, "embeddings").select("vec_id", F.round(score.semantic_blend((k % 10).cast("double"), (k % 7) / 7.0, k % 50 == 0), 6).alias("score"))


@query("source_dirs", "SELECT DISTINCT concat(p_brand, '/', p_type) AS dir FROM part")
def source_dirs(spark, d):
    """SRC-14."""
    return projects.source_dirs(table(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type", F.lit("bin"), F.col("p_partkey").cast("string")).alias("path")))


@query("recent_errors", "WITH l AS (SELECT event_id AS line, CASE event_type WHEN 'error' THEN concat('ERROR user ', user_id) WHEN 'click' THEN concat('SomeException in ', user_id) ELSE event_type END AS text FROM events) SELECT line, text FROM l WHERE contains(text, 'ERROR') OR contains(text, 'Exception') ORDER BY line DESC LIMIT 80")
def recent_errors(spark, d):
    """SRC-21."""
    t, u = F.col("event_type"), F.col("user_id").cast("string")
    text = F.when(t == "error", F.concat(F.lit("ERROR user "), u)).when(t == "click", F.concat(F.lit("SomeException in "), u)).otherwise(t)
    return projects.recent_errors(table(spark, d, "events").select(F.col("event_id").alias("line"), text.alias("text")))


@query("classic_imports", f"""WITH {PAGE_PATHS_SQL}, h AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.py$', '') AS base FROM paths),
w AS (SELECT path AS file, dir, base FROM h WHERE base <> '' AND base <> '.py'),
j AS (SELECT w.file, h.path, w.dir, h.dir AS other, w.base, CASE WHEN w.dir = h.dir THEN 3 WHEN starts_with(concat(w.dir, '/'), concat(h.dir, '/')) OR starts_with(concat(h.dir, '/'), concat(w.dir, '/')) THEN 2 ELSE 1 END AS proximity
      FROM w JOIN h ON h.base = w.base AND h.path <> w.file),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY proximity DESC, path) AS r FROM j)
SELECT file AS source, path AS target, proximity FROM r WHERE base NOT IN ('index', 'main', 'utils', 'helpers', 'types', 'constants', 'config', 'app', 'models', '__init__') OR r = 1""")
def classic_imports(spark, d):
    """JN-09: each file imports its own base name, which other folders have too."""
    paths = page_paths(spark, d)
    base = F.regexp_replace(T.basename("path"), r"\.py$", "")
    wants = paths.select(F.col("path").alias("file"), base.alias("import")).filter("import <> '' and import <> '.py'")
    return resolve.classic_edges(wants, paths)


@query("graph_statistics", f"""WITH {SUPPLY_EDGES_SQL}
SELECT count(*) AS connections, count(*) FILTER (kind = 'calls-symbol') AS calls, count(*) FILTER (kind = 'calls-symbol-local') AS local_calls, count(*) FILTER (kind = 'imports-symbol') AS named_imports FROM edges""")
def graph_statistics(spark, d):
    """AG-14 over symbol edges."""
    return rollup.edge_statistics(supply_edges(spark, d))
