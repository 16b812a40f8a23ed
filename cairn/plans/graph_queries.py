"""Queries of the graph, roll-up, set, semantic, evaluation, source and streaming operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import evals, graph, rollup, select, semantic, sets

from .inputs import (
    COMMENT_LINES_SQL,
    NATION_LINKS_SQL,
    PAGE_PATHS_SQL,
    SUPPLY_EDGES_SQL,
    SYMBOLS_SQL,
    TASKS_SQL,
    comment_lines,
    kw,
    nation_links,
    nations,
    overlap,
    page_paths,
    supply_edges,
    symbols,
    table,
    tasks,
    tok,
)

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _rank_sql(jump: str) -> str:
    return f"""
WITH RECURSIVE {NATION_LINKS_SQL},
w AS (SELECT source, target, count(*)::DOUBLE AS k FROM links WHERE source <> target GROUP BY ALL),
s AS (SELECT source, target, k / sum(k) OVER (PARTITION BY source) AS share FROM w),
n AS (SELECT n_nationkey AS id, {jump} AS jump, n_nationkey NOT IN (SELECT source FROM s) AS sink FROM nation),
r AS (
  SELECT 0 AS step, id, 1.0 / 25 AS rank FROM n
  UNION ALL
  SELECT r.step + 1, n.id, 0.15 * n.jump + 0.85 * (sum(CASE WHEN m.sink THEN r.rank ELSE 0 END) / 25 + sum(coalesce(s.share, 0) * r.rank))
  FROM r JOIN n m ON m.id = r.id CROSS JOIN n LEFT JOIN s ON s.source = r.id AND s.target = n.id
  WHERE r.step < 20 GROUP BY r.step, n.id, n.jump)
SELECT id, round(rank / max(rank) OVER (), 6) AS rank FROM r WHERE step = 20"""


@query("pagerank", _rank_sql("1.0 / 25"))
def pagerank(spark, d):
    out = graph.pagerank(nations(spark, d), nation_links(spark, d), iterations=20, tolerance=None)
    return out.select(F.col("id").cast("int").alias("id"), F.round("rank", 6).alias("rank"))


@query("personalized_pagerank", _rank_sql("CASE WHEN n_regionkey = 2 THEN 1.0 / (SELECT count(*) FROM nation WHERE n_regionkey = 2) ELSE 0 END"))
def personalized_pagerank(spark, d):
    ns = nations(spark, d)
    seeds = ns.filter("n_regionkey = 2").select("id", F.lit(1.0).alias("weight"))
    out = graph.pagerank(ns, nation_links(spark, d), iterations=20, tolerance=None, seeds=seeds)
    return out.select(F.col("id").cast("int").alias("id"), F.round("rank", 6).alias("rank"))


_NODE_SQL = """nodes AS (
  SELECT n_nationkey AS id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS lines,
         (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS symbols, (n_nationkey + 1) / 25.0 AS pagerank FROM nation)"""


def _nation_nodes(spark, d):
    ns = nations(spark, d).select("id")
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("id")).agg(F.count("*").alias("lines"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("id")).agg(F.count("*").alias("symbols"))
    rows = ns.join(c, "id", "left").join(s, "id", "left")
    return rows.select("id", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("symbols", F.lit(0)).alias("symbols"), ((F.col("id") + 1) / 25.0).alias("pagerank"))


@query("file_importance", f"""WITH {NATION_LINKS_SQL}, {_NODE_SQL},
g AS (SELECT n.*, (SELECT count(*) FROM links WHERE source = n.id) + (SELECT count(*) FROM links WHERE target = n.id) AS degree FROM nodes n)
SELECT id, degree, round(0.7 * pagerank + 0.2 * degree / max(degree) OVER () + 0.1 * symbols / max(symbols) OVER (), 4) AS importance,
       round(0.6 * degree / max(degree) OVER () + 0.3 * lines / max(lines) OVER () + 0.1 * symbols / max(symbols) OVER (), 4) AS classic FROM g""")
def file_importance(spark, d):
    nodes, links = _nation_nodes(spark, d), nation_links(spark, d)
    classic = graph.importance(nodes, links, precise=False).select("id", F.col("importance").alias("classic"))
    return graph.importance(nodes, links).join(classic, "id").select(F.col("id").cast("int").alias("id"), "degree", "importance", "classic")


@query("symbol_degrees", f"""WITH {SUPPLY_EDGES_SQL},
n AS (SELECT concat('P', p_partkey) AS id, p_size, p_partkey % 2 = 0 AS exported FROM part),
i AS (SELECT target AS id, count(*) FILTER (kind LIKE 'calls-symbol%') AS inbound_calls, count(*) FILTER (kind = 'calls-symbol-local') AS inbound_calls_local,
             count(*) FILTER (kind = 'imports-symbol') AS named_imports, count(DISTINCT CASE WHEN kind = 'imports-symbol' THEN source_file END) AS incoming_file_imports FROM edges GROUP BY target),
x AS (SELECT n.id, exported, p_size, coalesce(inbound_calls, 0) AS inbound_calls, coalesce(inbound_calls_local, 0) AS inbound_calls_local, coalesce(named_imports, 0) AS named_imports, coalesce(incoming_file_imports, 0) AS incoming_file_imports FROM n LEFT JOIN i USING (id))
SELECT id, inbound_calls, inbound_calls_local, named_imports, incoming_file_imports,
       round(0.5 * p_size / 50.0 + 0.2 * exported::INT + 0.1 * least(incoming_file_imports, 5) / 5 + 0.2 * least(inbound_calls, 8) / 8, 6)::DOUBLE AS rank FROM x""")
def symbol_degrees(spark, d):
    parts = table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_size") / 50.0).alias("file_rank"), (F.col("p_partkey") % 2 == 0).alias("exported"))
    rows = graph.symbol_degrees(parts, supply_edges(spark, d))
    rank = graph.symbol_rank(F.col("file_rank"), F.col("exported"), F.col("incoming_file_imports"), F.col("inbound_calls"))
    return rows.select("id", "inbound_calls", "inbound_calls_local", "named_imports", "incoming_file_imports", rank.alias("rank"))


_ROLE_EDGES = "re AS (SELECT DISTINCT concat('o', o_custkey) AS source, concat('p', l_partkey) AS target FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION SELECT DISTINCT concat('p', l_partkey), concat('s', l_suppkey) FROM lineitem)"


@query("roles", f"""WITH {_ROLE_EDGES}, n AS (SELECT source AS id FROM re UNION SELECT target FROM re),
i AS (SELECT target AS id, count(*) AS k FROM re GROUP BY target), o AS (SELECT source AS id, count(*) AS k FROM re GROUP BY source),
g AS (SELECT n.id, coalesce(i.k, 0) AS indegree, coalesce(o.k, 0) AS outdegree FROM n LEFT JOIN i ON i.id = n.id LEFT JOIN o ON o.id = n.id)
SELECT *, CASE WHEN indegree > 0 AND outdegree = 0 THEN 'leaf' WHEN outdegree > 0 AND indegree = 0 THEN 'entry_point' WHEN indegree >= 3 AND outdegree >= 3 THEN 'hub'
       WHEN indegree >= 5 AND indegree > 3 * outdegree THEN 'api_surface' ELSE 'module' END AS role FROM g""")
def roles(spark, d):
    """Customer to part to supplier, over all order lines."""
    name = lambda lead, c: F.concat(F.lit(lead), F.col(c).cast("string"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    bought = li.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(name("o", "o_custkey").alias("source"), name("p", "l_partkey").alias("target"))
    e = bought.unionByName(li.select(name("p", "l_partkey").alias("source"), name("s", "l_suppkey").alias("target"))).distinct()
    n = e.select(F.col("source").alias("id")).unionByName(e.select(F.col("target").alias("id"))).distinct()
    return graph.roles(n, e)


_SEED_SQL = "seeds AS (SELECT concat('P', p_partkey) AS id, p_size / 50.0 AS score FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 40)"


def _seeds(spark, d):
    top = table(spark, d, "part").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(40)
    return top.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_size") / 50.0).alias("score"))


def _pair_edges(spark, d):
    """Part to supplier and supplier to part, one edge per pair."""
    e = supply_edges(spark, d).select("source", "target").distinct()
    back = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("target")).distinct()
    return e.unionByName(back)


_PAIR_SQL = f"""{SUPPLY_EDGES_SQL},
pe AS (SELECT DISTINCT source, target FROM edges UNION ALL SELECT DISTINCT concat('P', l_partkey), concat('S', l_suppkey) FROM lineitem WHERE l_quantity > 45)"""


@query("two_hop", f"""WITH {_PAIR_SQL}, {_SEED_SQL},
ke AS (SELECT source, target, length(source) % 2 = 0 AS call FROM pe),
kn AS (SELECT id, length(id) % 3 AS overlap, CASE length(id) % 4 WHEN 0 THEN 0.0 ELSE 0.5 END AS task, length(id) % 5 <> 0 AS gate FROM (SELECT source AS id FROM pe UNION SELECT target FROM pe)),
h1 AS (SELECT DISTINCT s.id AS seed, s.score AS base, e.source AS id, call, 'callers' AS way FROM ke e JOIN seeds s ON e.target = s.id
       UNION ALL SELECT DISTINCT s.id, s.score, e.target, call, 'callees' FROM ke e JOIN seeds s ON e.source = s.id),
h2 AS (SELECT base, e.source AS id, 0.30 AS f, 'callers_2hop' AS reason FROM h1 JOIN ke e ON e.target = h1.id AND e.call WHERE h1.call AND way = 'callers'
       UNION ALL SELECT base, e.target, 0.25, 'callees_2hop' FROM h1 JOIN ke e ON e.source = h1.id AND e.call WHERE h1.call AND way = 'callees'),
u AS (SELECT base, id, CASE way WHEN 'callers' THEN 0.70 ELSE 0.65 END AS f, way AS reason FROM h1 WHERE call
      UNION ALL SELECT base, id, CASE way WHEN 'callers' THEN 0.35 ELSE 0.30 END, 'import_neighbors' FROM h1 WHERE NOT call UNION ALL SELECT * FROM h2),
v AS (SELECT u.id, reason, CASE WHEN reason = 'import_neighbors' THEN greatest(base * CASE WHEN overlap > 0 THEN f WHEN task > 0 THEN f * 0.75 ELSE least(f, 0.035) END, 0.35 * task) ELSE base * f END AS score
      FROM u JOIN kn ON kn.id = u.id WHERE gate OR reason LIKE '%2hop')
SELECT id, round(max(score), 6)::DOUBLE AS score, array_to_string(list_sort(list_distinct(list(reason))), ',') AS reasons FROM v GROUP BY id""")
def two_hop(spark, d):
    pairs = _pair_edges(spark, d)
    edges = pairs.withColumn("kind", F.when(F.length("source") % 2 == 0, "calls-symbol").otherwise("imports-symbol"))
    ids = pairs.select(F.col("source").alias("id")).unionByName(pairs.select(F.col("target").alias("id"))).distinct()
    n = F.length("id")
    known = ids.select("id", (n % 3).alias("overlap"), F.when(n % 4 == 0, 0.0).otherwise(0.5).alias("task_score"), (n % 5 != 0).alias("gate"))
    out = select.neighbors(_seeds(spark, d), edges, known)
    return out.select("id", F.round("score", 6).alias("score"), F.array_join("reasons", ",").alias("reasons"))


@query("neighborhood", f"""WITH {_PAIR_SQL}, s AS (SELECT concat('P', p_partkey) AS id FROM part WHERE p_partkey % 20 = 0),
a1 AS (SELECT DISTINCT s.id AS start, e.target AS id FROM s JOIN pe e ON e.source = s.id WHERE e.target <> s.id),
a2 AS (SELECT a1.start, e.target AS id, min(a1.id) AS via FROM a1 JOIN pe e ON e.source = a1.id WHERE e.target <> a1.start AND NOT EXISTS (SELECT 1 FROM a1 b WHERE b.start = a1.start AND b.id = e.target) GROUP BY ALL),
b1 AS (SELECT DISTINCT s.id AS start, e.source AS id FROM s JOIN pe e ON e.target = s.id WHERE e.source <> s.id),
b2 AS (SELECT b1.start, e.source AS id, min(b1.id) AS via FROM b1 JOIN pe e ON e.target = b1.id WHERE e.source <> b1.start AND NOT EXISTS (SELECT 1 FROM b1 b WHERE b.start = b1.start AND b.id = e.source) GROUP BY ALL)
SELECT start, id, 1 AS hop, 'callees' AS direction, NULL::VARCHAR AS via FROM a1 UNION ALL SELECT start, id, 2, 'callees', via FROM a2
UNION ALL SELECT start, id, 1, 'callers', NULL FROM b1 UNION ALL SELECT start, id, 2, 'callers', via FROM b2""")
def neighborhood(spark, d):
    starts = table(spark, d, "part").filter("p_partkey % 20 = 0")  # the stated query set
    return graph.neighborhood(_pair_edges(spark, d), starts.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id")))


_SEL_SQL = f"""{_PAIR_SQL}, kx AS (SELECT source, target, CASE WHEN length(source) % 2 = 0 THEN 'calls-symbol' ELSE 'imports-symbol' END AS kind FROM pe),
sel AS (SELECT id FROM (SELECT concat('P', p_partkey) AS id FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 200) UNION ALL SELECT concat('S', s_suppkey) FROM supplier WHERE s_acctbal > 5000)"""


def _selection(spark, d):
    top = table(spark, d, "part").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(200).select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"))
    ids = top.unionByName(table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id")))
    e = _pair_edges(spark, d).withColumn("kind", F.when(F.length("source") % 2 == 0, "calls-symbol").otherwise("imports-symbol"))
    return ids, e


@query("relations_density", f"""WITH {_SEL_SQL}, i AS (SELECT * FROM kx WHERE source IN (SELECT id FROM sel) AND target IN (SELECT id FROM sel))
SELECT (SELECT count(*) FROM sel) AS nodes, (SELECT count(*) FROM i) AS edges, round((SELECT count(*) FROM i) / ((SELECT count(*) FROM sel) * ((SELECT count(*) FROM sel) - 1)), 6)::DOUBLE AS density""")
def relations_density(spark, d):
    return select.density(*_selection(spark, d))


_LIST = "array_to_string(list_sort(list_distinct(list({x})))[1:{n}], ',')"


@query("relations", f"""WITH {_SEL_SQL}, i AS (SELECT DISTINCT source, target, kind FROM kx WHERE source IN (SELECT id FROM sel) AND target IN (SELECT id FROM sel) AND source <> target),
c AS (SELECT source, target FROM i WHERE kind = 'calls-symbol'),
f AS (SELECT DISTINCT a.source, b.target FROM c a JOIN c b ON a.target = b.source WHERE a.source <> b.target AND NOT EXISTS (SELECT 1 FROM c x WHERE x.source = a.source AND x.target = b.target)),
g AS (SELECT DISTINCT a.source, b.target FROM c a JOIN c b ON a.target = b.source WHERE a.source <> b.target AND NOT EXISTS (SELECT 1 FROM c x WHERE x.source = a.source AND x.target = b.target))
SELECT sel.id, coalesce((SELECT {_LIST.format(x='target', n=15)} FROM c WHERE source = sel.id), '') AS calls, coalesce((SELECT {_LIST.format(x='source', n=15)} FROM c WHERE target = sel.id), '') AS called_by,
       coalesce((SELECT {_LIST.format(x='target', n=15)} FROM i WHERE source = sel.id AND kind = 'imports-symbol'), '') AS imports,
       coalesce((SELECT {_LIST.format(x='target', n=10)} FROM f WHERE source = sel.id), '') AS dep_calls, coalesce((SELECT {_LIST.format(x='source', n=10)} FROM g WHERE target = sel.id), '') AS dep_called_by
FROM sel""")
def relations(spark, d):
    out = select.relations(*_selection(spark, d))
    return out.select("id", *[F.array_join(c, ",").alias(c) for c in out.columns if c != "id"])


@query("frontier_top8", f"""WITH {_SEL_SQL},
s AS (SELECT concat('P', p_partkey) AS id, p_size / 50.0 AS score, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS order_no FROM part QUALIFY order_no <= 200),
cut AS (SELECT concat('S', s_suppkey) AS id, CASE WHEN s_nationkey % 2 = 0 THEN 'critical' ELSE 'support' END AS tier FROM supplier),
a AS (SELECT source AS near, target AS id, kind FROM kx UNION ALL SELECT target, source, kind FROM kx),
h AS (SELECT a.id, a.near AS from_id, order_no, kind, tier, round(score * CASE WHEN kind = 'calls-symbol' THEN 0.75 ELSE 0.30 END, 6) AS plan_score FROM a JOIN s ON a.near = s.id JOIN cut ON cut.id = a.id),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY order_no, plan_score DESC, kind) = 1)
SELECT id, from_id, plan_score::DOUBLE AS plan_score, kind, tier FROM b ORDER BY plan_score DESC, CASE tier WHEN 'critical' THEN 3 ELSE 1 END DESC, id LIMIT 8""")
def frontier_top8(spark, d):
    from pyspark.sql import Window

    w = Window.orderBy(F.col("p_retailprice").desc(), "p_partkey")
    top = table(spark, d, "part").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(200)
    chosen = top.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_size") / 50.0).alias("score"), F.row_number().over(w).alias("order_no"))
    cut = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.when(F.col("s_nationkey") % 2 == 0, "critical").otherwise("support").alias("tier"))
    return select.frontier(chosen, cut, _selection(spark, d)[1])


@query("type_dependency", f"""WITH {SYMBOLS_SQL}, r AS (SELECT unnest(regexp_extract_all(signature, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM sym WHERE kind = 'func')
SELECT id, 0.85::DOUBLE AS score FROM sym WHERE kind <> 'func' AND name IN (SELECT name FROM r) AND id NOT IN (SELECT id FROM sym WHERE size <= 3)""")
def type_dependency(spark, d):
    s = symbols(spark, d)
    rows = s.filter("kind = 'func'").withColumn("tier", F.lit("critical"))
    return select.type_dependencies(rows, s.filter("kind <> 'func'"), s.filter("size <= 3"))


@query("cochange_coupling", """WITH l AS (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200),
c AS (SELECT DISTINCT l_orderkey AS k, concat(p_brand, '.py') AS f FROM lineitem JOIN l ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
m AS (SELECT * FROM c WHERE k IN (SELECT k FROM c GROUP BY k HAVING count(*) >= 2)), n AS (SELECT f, count(*) AS n FROM m GROUP BY f),
p AS (SELECT x.f AS a, y.f AS b, count(*) AS together FROM m x JOIN m y ON x.k = y.k AND x.f < y.f GROUP BY ALL),
s AS (SELECT p.*, round(least(1.0, together / least(u.n, v.n)), 6)::DOUBLE AS score FROM p JOIN n u ON u.f = a JOIN n v ON v.f = b)
SELECT a, b, together, score FROM s UNION ALL SELECT b, a, together, score FROM s""")
def cochange_coupling(spark, d):
    return rollup.coupling(_changes(spark, d)).select("a", "b", "together", "score")


def _changes(spark, d):
    o, li, p = table(spark, d, "orders"), table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), table(spark, d, "part").select("p_partkey", "p_brand")
    rows = o.select("o_orderkey", "o_orderdate").join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    commits = rows.select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("ts"), F.concat("p_brand", F.lit(".py")).alias("file"))
    # the last orders by date; those without lines count among them
    last = o.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(200).select(F.col("o_orderkey").alias("commit"))
    return rollup.recent_commits(commits.join(last, "commit", "left_semi"))


_HOT_SQL = """h AS (SELECT event_id, concat(event_type, '_', user_id, '.py') AS file FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 28 DAYS),
hs AS (SELECT file, count(DISTINCT event_id) AS commits FROM h GROUP BY file)"""


def _hot(spark, d):
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    rows = e.crossJoin(F.broadcast(now)).select(F.col("event_id").alias("commit"), "ts", "now", F.concat_ws("_", "event_type", F.concat(F.col("user_id").cast("string"), F.lit(".py"))).alias("file"))
    return rollup.hotspots(rollup.recent_touches(rows, F.col("now")))


@query("hotspots", f"WITH {_HOT_SQL} SELECT file, commits, round(commits / max(commits) OVER (), 6)::DOUBLE AS score FROM hs")
def hotspots(spark, d):
    return _hot(spark, d)


@query("score_boost", f"""WITH {_HOT_SQL}, s AS (SELECT file, round(commits / max(commits) OVER (), 6)::DOUBLE AS score FROM hs)
SELECT file, round(1 + 0.40 * score + 0.25 * 0.5 * (hash_even::INT), 6)::DOUBLE AS boost FROM (SELECT file, score, length(file) % 2 = 0 AS hash_even FROM s)""")
def score_boost(spark, d):
    hot = _hot(spark, d)
    related = hot.select("file", F.lit("x").alias("related"))
    coupled = hot.filter(F.length("file") % 2 == 0).select(F.col("file").alias("a"), F.lit("x").alias("b"), F.lit(0.5).alias("score"))
    return rollup.score_boost(hot, hot, coupled, related)


_DEBT = "(?i)(?:^|\\s)[#/;/*-]*\\s*(" + rollup.DEBT_TAGS + ")[\\s:)]*\\s*(.*?)(?:\\n|$|(?:--|//|#|;))"
_DEBT_CTE = f"""{COMMENT_LINES_SQL},
mk AS (SELECT file, line, text, unnest(regexp_extract_all(text, '{_DEBT}', 1)) AS tag, unnest(regexp_extract_all(text, '{_DEBT}', 2)) AS note FROM lines),
mark AS (SELECT file, line, upper(tag) AS tag, CASE WHEN upper(tag) IN ('FIXME', 'BUG', 'XXX') THEN 'high' WHEN upper(tag) IN ('HACK', 'HACKY', 'KLUDGE', 'WORKAROUND') THEN 'medium' ELSE 'low' END AS severity,
         substr(trim(note), 1, 120) AS note, substr(trim(text), 1, 200) AS text FROM mk)"""


@query("debt_markers", f"WITH {_DEBT_CTE} SELECT * FROM mark")
def debt_markers(spark, d):
    return rollup.debt_markers(comment_lines(spark, d))


@query("debt_rollup", f"WITH {_DEBT_CTE} SELECT CASE WHEN grouping(severity) = 0 THEN 'severity' WHEN grouping(tag) = 0 THEN 'tag' ELSE 'all' END AS level, coalesce(severity, tag, '') AS key, count(*) AS markers, count(DISTINCT file) AS files FROM mark GROUP BY GROUPING SETS ((severity), (tag), ())")
def debt_rollup(spark, d):
    return rollup.debt_rollup(rollup.debt_markers(comment_lines(spark, d)))


@query("debt_top_files", f"WITH {_DEBT_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line, tag, note) AS r FROM mark) SELECT file, count(*) FILTER (r <= 3 AND severity = 'high') AS high_shown, count(*) AS markers FROM r GROUP BY file ORDER BY high_shown DESC, markers DESC, file LIMIT 20")
def debt_top_files(spark, d):
    return rollup.debt_top_files(rollup.debt_markers(comment_lines(spark, d)))


_TFIDF_CTE = f"""dt AS (SELECT doc_id AS id, {tok('text')} AS tokens FROM documents),
ix AS (SELECT token, ln(((SELECT count(*) FROM dt) + 1) / (count(*) + 1)) + 1 AS idf FROM (SELECT id, unnest(list_distinct(tokens)) AS token FROM dt) GROUP BY token),
wt AS (SELECT id, token, count(*) / any_value(n) * any_value(idf) AS w FROM (SELECT id, len(tokens) AS n, unnest(tokens) AS token FROM dt) JOIN ix USING (token) GROUP BY id, token),
nm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM wt GROUP BY id)"""


@query("tfidf_search", f"""WITH {_TFIDF_CTE},
qt AS (SELECT item_id AS id, {tok('text')} AS tokens FROM benchmark),
qw AS (SELECT id, token, count(*) / any_value(n) * any_value(idf) AS w FROM (SELECT id, len(tokens) AS n, unnest(tokens) AS token FROM qt) JOIN ix USING (token) GROUP BY id, token),
qn AS (SELECT id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY id),
s AS (SELECT qw.id AS query, wt.id AS doc, round(sum(qw.w * wt.w) / (any_value(qn.norm) * any_value(nm.norm)), 6) AS similarity FROM qw JOIN wt USING (token) JOIN qn ON qn.id = qw.id JOIN nm ON nm.id = wt.id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, doc) AS place FROM s WHERE similarity > 0.01)
SELECT query, place, doc, similarity FROM r WHERE place <= 10""")
def tfidf_search(spark, d):
    # tokens once, for the frequencies and for the weights
    docs = graph.cut(table(spark, d, "documents").select(F.col("doc_id").alias("id"), T.identifier_tokens("text").alias("tokens")))
    from cairn.operators.score import idf

    words = idf(docs)
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), T.identifier_tokens("text").alias("tokens"))
    return semantic.sparse_topk(semantic.tfidf(items, idf=words), semantic.tfidf(docs, idf=words)).select("query", "place", "doc", "similarity")


@query("dense_topk", """WITH p AS (SELECT vec_id AS probe, embedding AS pe FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT probe, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], pe::DOUBLE[]), 6) AS similarity FROM p, embeddings WHERE vec_id <> probe),
r AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY similarity DESC, id) AS place FROM s) SELECT * FROM r WHERE place <= 10""")
def dense_topk(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return semantic.dense_topk(e.filter("id % 20 = 0"), e)


@query("domain_detect", f"""WITH {_TFIDF_CTE},
dm AS (SELECT doc_id AS id, lang AS domain FROM documents), sz AS (SELECT domain, count(*) AS n FROM dm GROUP BY domain),
pr AS (SELECT domain, token, sum(w) / any_value(n) AS pw FROM wt JOIN dm USING (id) JOIN sz USING (domain) GROUP BY domain, token), pn AS (SELECT domain, sqrt(sum(pw * pw)) AS pnorm FROM pr GROUP BY domain),
s AS (SELECT wt.id, domain, round(sum(w * pw) / (any_value(norm) * any_value(pnorm)), 6) AS c FROM wt JOIN pr USING (token) JOIN pn USING (domain) JOIN nm ON nm.id = wt.id GROUP BY wt.id, domain)
SELECT id, arg_min(domain, struct_pack(a := -c, b := domain)) AS domain, max(c) AS similarity FROM s GROUP BY id""")
def domain_detect(spark, d):
    from cairn.operators.score import idf

    docs = graph.cut(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"), T.identifier_tokens("text").alias("tokens")))
    words = idf(docs)
    return semantic.detect_domain(semantic.tfidf(docs, idf=words), semantic.prototypes(docs, words))


_DOMAINS = {"english": "the and that", "french": "les des est", "spanish": "los que del", "german": "der und die"}


@query("keyword_domain", "WITH s AS (SELECT conv_id, turn, " + ", ".join("(" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in ws.split()) + f") AS {n}" for n, ws in _DOMAINS.items()) + ") , m AS (SELECT *, greatest(english, french, spanish, german) AS score FROM s) SELECT conv_id, turn, score, CASE WHEN score = 0 THEN 'general' WHEN english = score THEN 'english' WHEN french = score THEN 'french' WHEN spanish = score THEN 'spanish' ELSE 'german' END AS domain FROM m".replace(") , m", " FROM conversations), m"))
def keyword_domain(spark, d):
    return rollup.keyword_domain(table(spark, d, "conversations"), ["conv_id", "turn"], _DOMAINS)


@query("test_mapping", f"""WITH {PAGE_PATHS_SQL},
k AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS base FROM paths),
t AS (SELECT * FROM k WHERE starts_with(base, 'test_') OR ends_with(base, '_test.py') OR contains(base, '.test.') OR regexp_matches(concat('/', path), '/(test|tests|__tests__|spec|specs)/')),
s AS (SELECT * FROM k WHERE path NOT IN (SELECT path FROM t) AND base <> '.py'),  -- a dot file has no extension
f AS (SELECT s.path, t.path AS test FROM s JOIN t ON t.path = concat(s.dir, '/test_', s.base) OR t.path = concat('tests/test_', s.base)),
b AS (SELECT base, min(path) AS path FROM s GROUP BY base),
r AS (SELECT b.path, t.path AS test FROM t JOIN b ON b.base = regexp_replace(t.base, '^test_', '')),
l AS (SELECT * FROM f UNION SELECT * FROM r), n AS (SELECT path FROM s WHERE path NOT IN (SELECT path FROM l)), z AS (SELECT path FROM t WHERE path NOT IN (SELECT test FROM l))
SELECT (SELECT count(*) FROM s) AS total_source_files, (SELECT count(*) FROM t) AS total_test_files, (SELECT count(*) FROM n) AS untested_files, (SELECT count(*) FROM z) AS dead_tests,
       round(((SELECT count(*) FROM s) - (SELECT count(*) FROM n)) / (SELECT count(*) FROM s), 4)::DOUBLE AS coverage_ratio, (SELECT array_to_string(list_sort(list(path))[1:50], ',') FROM n) AS untested""")
def test_mapping(spark, d):
    out = rollup.coverage(page_paths(spark, d))
    return out.select("total_source_files", "total_test_files", "untested_files", "dead_tests", "coverage_ratio", F.array_join("untested", ",").alias("untested"))


@query("snapshot_diff", """WITH a AS (SELECT o_orderkey AS key, o_orderstatus AS hash FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'),
b AS (SELECT o_orderkey AS key, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS hash FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01')
SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.hash IS DISTINCT FROM b.hash""")
def snapshot_diff(spark, d):
    return sets.diff(*_snapshots(spark, d))


def _snapshots(spark, d):
    o = table(spark, d, "orders")
    old = o.filter("o_orderdate < timestamp_ntz'1999-01-01'").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("hash"))
    new = o.filter("o_orderdate >= timestamp_ntz'1997-01-01'").select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("o_orderstatus")).alias("hash"))
    return old, new


@query("affected", SQL["snapshot_diff"].replace("SELECT coalesce", ", d AS (SELECT coalesce", 1) + """)
SELECT DISTINCT concat('S', l_suppkey) AS key FROM lineitem JOIN d ON l_orderkey = d.key WHERE d.status IN ('added', 'changed')""")
def affected(spark, d):
    changes = sets.diff(*_snapshots(spark, d)).withColumn("key", F.col("key").cast("string"))
    edges = table(spark, d, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source"), F.col("l_orderkey").cast("string").alias("target"))
    return sets.affected(changes, edges)


@query("delta_report", SQL["affected"].replace("SELECT DISTINCT concat", ", f AS (SELECT DISTINCT concat", 1) + """)
SELECT (SELECT count(*) FROM d WHERE status = 'added') AS added_count, (SELECT count(*) FROM d WHERE status = 'removed') AS removed_count, (SELECT count(*) FROM d WHERE status = 'changed') AS changed_count, (SELECT count(*) FROM f) AS affected_count,
       (SELECT array_to_string(list_sort(list(key::VARCHAR))[1:20], ',') FROM d WHERE status = 'added') AS added, (SELECT array_to_string(list_sort(list(key))[1:20], ',') FROM f) AS affected""")
def delta_report(spark, d):
    changes = sets.diff(*_snapshots(spark, d)).withColumn("key", F.col("key").cast("string"))
    edges = table(spark, d, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source"), F.col("l_orderkey").cast("string").alias("target"))
    out = sets.delta_report(changes, sets.affected(changes, edges))
    return out.select("added_count", "removed_count", "changed_count", "affected_count", F.array_join("added", ",").alias("added"), F.array_join("affected", ",").alias("affected"))


@query("gate", """SELECT o_orderpriority AS key, count(*) AS files, array_to_string(list_filter([CASE WHEN count(*) FILTER (o_orderstatus = 'F') % 2 = 1 THEN 'new_cycles' END,
  CASE WHEN count(*) FILTER (o_orderstatus = 'O') / count(*) > 0.34 THEN 'changed_files' END, CASE WHEN count(*) FILTER (o_orderstatus = 'P') / count(*) > 0.3 THEN 'removed_symbols' END], lambda x: x IS NOT NULL), ',') AS failed FROM orders GROUP BY o_orderpriority""")
def gate(spark, d):
    s = F.col("o_orderstatus")
    rows = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("key")).agg(F.count("*").alias("files"), F.count_if(s == "F").alias("f"), F.count_if(s == "O").alias("o"), F.count_if(s == "P").alias("p"))
    return rows.select("key", "files", F.array_join(sets.gate(F.col("f") % 2, F.col("files"), F.col("o"), F.col("files"), F.col("p"), most_changed=0.34), ",").alias("failed"))


@query("merge_priority", """WITH r AS (
  SELECT 1 AS part, p_partkey AS id, p_size / 50.0 AS s, p_size AS place FROM part WHERE p_size > 30 UNION ALL
  SELECT 2, p_partkey, p_size / 25.0, p_size FROM part WHERE p_type = 'SMALL' UNION ALL SELECT 3, p_partkey, 0.5, p_size FROM part WHERE p_brand = 'Brand#2')
SELECT id, count(*) AS appearances, round(arg_min(s, part), 6)::DOUBLE AS first_score, round(10 * count(*) + arg_min(s, part), 6)::DOUBLE AS priority FROM r GROUP BY id""")
def merge_priority(spark, d):
    p = table(spark, d, "part")
    part = lambda rows, n, s: rows.select(F.col("p_partkey").alias("id"), F.lit(n).alias("part"), s.cast("double").alias("selection_score"), F.col("p_size").alias("place"))
    every = part(p.filter("p_size > 30"), 1, F.col("p_size") / 50.0).unionByName(part(p.filter("p_type = 'SMALL'"), 2, F.col("p_size") / 25.0)).unionByName(part(p.filter("p_brand = 'Brand#2'"), 3, F.lit(0.5)))
    return select.merge_priority(every).withColumn("first_score", F.round("first_score", 6))


_CASE_CTE = """cs AS (
  SELECT concat(source, '-', lang) AS case_id, source AS fixture, lang AS category, list(concat('doc', lpad(doc_id::VARCHAR, 9, '0')) ORDER BY doc_id) FILTER (quality = 1) AS must, list(concat('doc', lpad(doc_id::VARCHAR, 9, '0')) ORDER BY doc_id) FILTER (toxic = 1) AS must_not,
         (list(concat('DOC', lpad(doc_id::VARCHAR, 9, '0'), '::x') ORDER BY n_chars DESC, doc_id))[1:20] AS found FROM documents JOIN labels USING (doc_id) GROUP BY source, lang),
c2 AS (SELECT case_id, fixture, category, coalesce(must, []) AS must, coalesce(must_not, []) AS must_not, found FROM cs),
c3 AS (SELECT *, len(list_filter(must, lambda m: len(list_filter(found, lambda f: contains(lower(f), m))) > 0)) AS h, len(list_filter(must, lambda m: len(list_filter(found[1:10], lambda f: contains(lower(f), m))) > 0)) AS h10,
              len(list_filter(must_not, lambda m: len(list_filter(found, lambda f: contains(lower(f), m))) > 0)) AS g FROM c2),
c4 AS (SELECT *, CASE WHEN len(must) = 0 THEN 1.0 ELSE h / len(must) END AS recall, CASE WHEN len(must) = 0 THEN 0.0 ELSE least(1.0, h10 / 10) END AS precision, CASE WHEN len(must_not) = 0 THEN 0.0 ELSE g / len(must_not) END AS penalty FROM c3)"""


def _cases(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("name", F.concat(F.lit("doc"), F.lpad(F.col("doc_id").cast("string"), 9, "0")))
    of = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("name"))))
    ranked = F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n_chars")).alias("n"), "doc_id", "name"))), 1, 20), lambda x: F.concat(F.upper(x["name"]), F.lit("::x")))
    return rows.groupBy(F.concat_ws("-", "source", "lang").alias("case_id"), F.col("source").alias("fixture"), F.col("lang").alias("category")).agg(of(F.col("quality") == 1).alias("must"), of(F.col("toxic") == 1).alias("must_not"), ranked.alias("found")).withColumns({"top_n": F.lit(10), "tier_accuracy": F.lit(1.0)})


@query("case_scores", f"WITH {_CASE_CTE} SELECT case_id, round(recall, 6)::DOUBLE AS recall, round(precision, 6)::DOUBLE AS precision, round(penalty, 6)::DOUBLE AS penalty, round(0.40 * recall + 0.25 * precision + 0.20 * (1 - penalty) + 0.15, 6)::DOUBLE AS score FROM c4")
def case_scores(spark, d):
    return evals.case_scores(_cases(spark, d)).select("case_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "penalty")], "score")


_GATE_CTE = _CASE_CTE + """, mr AS (SELECT CASE WHEN grouping(fixture) = 0 THEN 'fixture' WHEN grouping(category) = 0 THEN 'category' ELSE 'all' END AS level, coalesce(fixture, category, '') AS key, round(avg(recall), 4)::DOUBLE AS recall, count(*) AS cases FROM c4 GROUP BY GROUPING SETS ((fixture), (category), ()))"""


@query("recall_gate", f"""WITH {_GATE_CTE} SELECT level, key, recall, 0.9::DOUBLE AS before, CASE WHEN level = 'all' AND (recall < 0.8 OR round(0.9 - recall, 6) > 0.03) THEN 'fail' WHEN level = 'fixture' AND round(0.9 - recall, 6) > 0.1 THEN 'warn' ELSE 'ok' END AS verdict FROM mr""")
def recall_gate(spark, d):
    now = evals.mean_recall(evals.case_scores(_cases(spark, d)))
    return evals.recall_gate(now, now.withColumn("recall", F.lit(0.9)))


@query("mean_recall", f"WITH {_GATE_CTE} SELECT * FROM mr")
def mean_recall(spark, d):
    return evals.mean_recall(evals.case_scores(_cases(spark, d)))


@query("overview", f"""WITH {SUPPLY_EDGES_SQL}, f AS (SELECT concat('P', p_partkey) AS id, p_type AS type, p_size / 50.0 AS importance FROM part)
SELECT 'total' AS section, 'files' AS key, count(*)::DOUBLE AS value FROM f UNION ALL SELECT 'total', 'connections', count(*) FROM edges
UNION ALL (SELECT 'important', id, importance FROM f ORDER BY importance DESC, id LIMIT 15) UNION ALL (SELECT 'type', type, count(*) FROM f GROUP BY type ORDER BY count(*) DESC, type LIMIT 10)
UNION ALL (SELECT 'hub', id, count(*) FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id ORDER BY count(*) DESC, id LIMIT 5)""")
def overview(spark, d):
    files = table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_type").alias("type"), (F.col("p_size") / 50.0).alias("importance"))
    return rollup.overview(files, supply_edges(spark, d))


@query("file_search", """SELECT p_brand AS id, 3 * (contains(lower(p_brand), '1'))::INT + 2 * (contains(lower(any_value(p_brand)), 'x'))::INT + count(*) FILTER (contains(p_name, '1') OR contains(p_name, 'ring')) * 0 AS base,
  CASE WHEN contains(lower(p_brand), 'ring') THEN 3 ELSE 0 END + CASE WHEN bool_or(contains(lower(p_type), 'ring')) THEN 1 ELSE 0 END + count(*) FILTER (contains(lower(p_name), 'ring')) AS points FROM part GROUP BY p_brand HAVING points > 0""".replace("3 * (contains(lower(p_brand), '1'))::INT + 2 * (contains(lower(any_value(p_brand)), 'x'))::INT + count(*) FILTER (contains(p_name, '1') OR contains(p_name, 'ring')) * 0 AS base,\n  ", ""))
def file_search(spark, d):
    files = table(spark, d, "part").groupBy(F.col("p_brand").alias("id")).agg(F.collect_list("p_name").alias("names"), F.collect_set("p_type").alias("imports")).withColumn("summary", F.lit(None).cast("string"))
    return rollup.file_search(files, "ring").select("id", F.col("points").cast("long").alias("points"))


@query("regex_query", f"WITH {SYMBOLS_SQL} SELECT id, name FROM sym WHERE regexp_matches(name, '(?i)^red.*(ring|bolt)$') AND kind = 'func' ORDER BY rank DESC, id LIMIT 20")
def regex_query(spark, d):
    return rollup.regex_symbols(symbols(spark, d), "^red.*(ring|bolt)$", "func").select("id", "name")


@query("find_symbols", f"WITH {SYMBOLS_SQL} SELECT id, name FROM sym WHERE contains(lower(name), 'bluebo') ORDER BY rank DESC, id LIMIT 15")
def find_symbols(spark, d):
    return rollup.find_symbols(symbols(spark, d), "blueBo").select("id", "name")


@query("smart_start", f"""WITH {TASKS_SQL}, {SYMBOLS_SQL}, x AS (SELECT task_id, {overlap(kw('task'), f"list_concat({tok('name')}, {tok('file')})")} > 0 AS hit FROM tasks, sym),
g AS (SELECT task_id, count(*) AS total, count(*) FILTER (hit) AS matched FROM x GROUP BY task_id)
SELECT *, CASE WHEN matched / total > 0.05 THEN 'HIGH' WHEN matched > 0 THEN 'MEDIUM' ELSE 'LOW' END AS relevance FROM g""")
def smart_start(spark, d):
    return rollup.probe(symbols(spark, d), tasks(spark).select("task_id", T.keywords("task").alias("kws")))


# nations by trade over all order lines, and a ring through all regions that no pair shortens
_CYCLE_EDGES = f"""{NATION_LINKS_SQL}, ce AS (SELECT DISTINCT concat('N', lpad(source::VARCHAR, 2, '0')) AS source, concat('N', lpad(target::VARCHAR, 2, '0')) AS target FROM links
  UNION ALL SELECT concat('R', r_regionkey), concat('R', (r_regionkey + 1) % (SELECT count(*) FROM region)) FROM region)"""


@query("cycles", f"""WITH {_CYCLE_EDGES}
SELECT concat(source, ' -> ', target) AS cycle, 1 AS length FROM ce WHERE source = target
UNION SELECT concat(a.source, ' -> ', a.target, ' -> ', a.source), 2 FROM ce a JOIN ce b ON b.source = a.target AND b.target = a.source WHERE a.source < a.target
UNION SELECT c.cycle, 3 FROM (  -- of the cycles of three through an edge that no pair closes, the first way back
  SELECT e.source, e.target, min([e.target, x.target, e.source]) AS way, NULL FROM ce e JOIN ce x ON x.source = e.target JOIN ce y ON y.source = x.target AND y.target = e.source
  WHERE e.source <> e.target AND x.target NOT IN (e.source, e.target) AND NOT EXISTS (SELECT 1 FROM ce b WHERE b.source = e.target AND b.target = e.source) GROUP BY e.source, e.target) w,
  LATERAL (SELECT CASE least(w.way[1], w.way[2], w.way[3]) WHEN w.way[1] THEN concat(w.way[1], ' -> ', w.way[2], ' -> ', w.way[3], ' -> ', w.way[1])
    WHEN w.way[2] THEN concat(w.way[2], ' -> ', w.way[3], ' -> ', w.way[1], ' -> ', w.way[2]) ELSE concat(w.way[3], ' -> ', w.way[1], ' -> ', w.way[2], ' -> ', w.way[3]) END AS cycle) c
UNION SELECT concat(string_agg(concat('R', r_regionkey), ' -> ' ORDER BY r_regionkey), ' -> R0'), count(*)::INTEGER FROM region""")
def cycles(spark, d):
    name = lambda c: F.concat(F.lit("N"), F.lpad(F.col(c).cast("string"), 2, "0")).alias(c)
    e = nation_links(spark, d).select(name("source"), name("target")).distinct()
    r = table(spark, d, "region")
    ring = r.crossJoin(F.broadcast(r.agg(F.count("*").alias("n"))))  # one row
    step = lambda k, c: F.concat(F.lit("R"), k.cast("string")).alias(c)
    return graph.cycles(e.unionByName(ring.select(step(F.col("r_regionkey"), "source"), step((F.col("r_regionkey") + 1) % F.col("n"), "target"))))


@query("reexport_closure", """WITH RECURSIVE di AS (SELECT concat('f', n_nationkey) AS file, n_name AS name, concat('s', n_nationkey) AS symbol FROM nation),
fw AS (SELECT concat('f', n_nationkey) AS target, concat('r', n_regionkey) AS file, CASE WHEN n_nationkey % 2 = 0 THEN '*' ELSE n_name END AS imported, CASE WHEN n_nationkey % 2 = 0 THEN '*' ELSE concat('x', n_name) END AS exported FROM nation
       UNION ALL SELECT concat('r', r_regionkey), 'top', '*', '*' FROM region),
c AS (SELECT file, name, symbol FROM di UNION SELECT fw.file, CASE WHEN imported = '*' THEN c.name ELSE exported END, c.symbol FROM c JOIN fw ON fw.target = c.file AND (imported = '*' OR imported = c.name))
SELECT file, name, min(symbol) AS symbol FROM c GROUP BY file, name""")
def reexport_closure(spark, d):
    n = nations(spark, d)
    even = F.col("id") % 2 == 0
    file = F.concat(F.lit("f"), F.col("id").cast("string"))
    direct = n.select(file.alias("file"), F.col("n_name").alias("name"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("symbol"))
    fw = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("file"), file.alias("target"), F.when(even, "*").otherwise(F.col("n_name")).alias("imported"), F.when(even, "*").otherwise(F.concat(F.lit("x"), "n_name")).alias("exported"))
    top = table(spark, d, "region").select(F.lit("top").alias("file"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("target"), F.lit("*").alias("imported"), F.lit("*").alias("exported"))
    return graph.closure(direct, fw.unionByName(top))


@query("communities")
def communities(spark, d):
    """Suppliers and parts by shared order lines."""
    li = table(spark, d, "lineitem")
    e = li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"))
    n = e.select(F.col("source").alias("id")).unionByName(e.select(F.col("target").alias("id"))).distinct()
    return graph.communities(n, e)


@query("alias_prefix_join", r"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^(https?):', 1) AS scheme, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(url, '^https?://[^/]+/?', '') AS rest FROM pages)
SELECT page_id, 1 AS rank, concat('h/', host, '/', rest) AS base FROM u UNION ALL SELECT page_id, 2, concat(scheme, '//', host, '/', rest) FROM u""")
def alias_prefix_join(spark, d):
    """JN-07 on URLs as namespaces: every host and every scheme is a prefix, the longest one first."""
    from cairn.sources.resolve import namespace_candidates

    pages = table(spark, d, "pages").select("page_id", "url")
    spelled = F.replace("url", F.lit("/"), F.lit("\\"))
    host = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    named = pages.select(F.replace(host, F.lit("/"), F.lit("\\")).alias("namespace"), F.concat(F.lit("h/"), F.regexp_replace(host, "^https?://", "")).alias("base")).distinct()
    schemes = pages.select(F.regexp_extract("url", r"^(https?:)", 1).alias("namespace"), F.regexp_extract("url", r"^(https?):", 1).alias("base")).distinct()
    out = namespace_candidates(pages.select(F.col("page_id").alias("file"), F.lit(0).alias("ord"), spelled.alias("source")), named.unionByName(schemes))
    return out.select(F.col("file").alias("page_id"), "rank", "base")


@query("suffix_match", f"""WITH {PAGE_PATHS_SQL}, b AS (SELECT path, string_split(regexp_replace(path, '\\.py$', ''), '/') AS segs FROM paths),
s AS (SELECT path, array_to_string(segs[i:], '/') AS suffix FROM (SELECT path, segs, unnest(range(1, len(segs) + 1)) AS i FROM b))
SELECT suffix, path FROM s QUALIFY row_number() OVER (PARTITION BY suffix ORDER BY len(string_split(path, '/')), length(path), path) = 1""")
def suffix_match(spark, d):
    from cairn.sources.resolve import suffix_index

    return suffix_index(page_paths(spark, d))


@query("import_resolve", f"""WITH {SYMBOLS_SQL}, files AS (SELECT DISTINCT file AS path FROM sym),
r AS (SELECT id AS file_id, file, no AS ord, CASE no % 3 WHEN 0 THEN concat('./', regexp_extract(file, '([^/]*)$', 1)) WHEN 1 THEN concat('../', split_part(file, '/', 2), '/', regexp_replace(regexp_extract(file, '([^/]*)$', 1), '\\.py$', '')) ELSE './missing' END AS source FROM sym),
c AS (SELECT file, ord, CASE ord % 3 WHEN 2 THEN NULL ELSE file END AS target FROM r)
SELECT replace(file, '.py', '.ts') AS file, ord, replace(target, '.py', '.ts') AS target FROM c WHERE target IS NOT NULL""")
def import_resolve(spark, d):
    from cairn.sources.resolve import resolve

    s = symbols(spark, d).withColumn("file", F.regexp_replace("file", r"\.py$", ".ts"))
    leaf, folder = F.element_at(F.split("file", "/"), -1), F.element_at(F.split("file", "/"), 2)
    spec = F.when(F.col("no") % 3 == 0, F.concat(F.lit("./"), leaf)).when(F.col("no") % 3 == 1, F.concat(F.lit("../"), folder, F.lit("/"), F.regexp_replace(leaf, r"\.ts$", ""))).otherwise("./missing")
    records = s.select("file", F.col("no").alias("ord"), spec.alias("source"), F.lit("import").alias("kind"))
    return resolve(records, s.select(F.col("file").alias("path")).distinct())


def _code(spark, d):
    """A Python module for each part: it calls into the module of the next part (a ring), and its class calls its function."""
    k = F.col("p_partkey").cast("string")
    n = table(spark, d, "part").agg(F.count("*").alias("n"))  # one row
    rows = table(spark, d, "part").select("p_partkey", "p_name").crossJoin(F.broadcast(n)).withColumn("next", ((F.col("p_partkey") + 1) % F.col("n")).cast("string"))
    module = F.format_string('"""About the part %s."""\nfrom pkg.p%s import run%s\n\ndef run%s(x):\n    # TODO: use x\n    return run%s(x)\n\nclass Box%s:\n    def open%s(self):\n        return run%s(self)\n', F.col("p_name"), F.col("next"), F.col("next"), k, F.col("next"), k, k, k)
    return rows.select(F.concat(F.lit("pkg/p"), k, F.lit(".py")).alias("path"), module.alias("content"))


_CODE_SQL = "co AS (SELECT p_partkey AS k, p_name, (p_partkey + 1) % (SELECT count(*) FROM part) AS nx, concat('pkg/p', p_partkey, '.py') AS path FROM part)"


@query("scan_repo", f"WITH {_CODE_SQL} SELECT path AS id, 'py' AS type, 10 AS lines, 3 AS symbols, concat('About the part ', p_name, '. // TODO: use x') AS summary, concat('pkg.p', nx) AS imports, 'module' AS role, 1.0::DOUBLE AS importance FROM co")
def scan_repo(spark, d):
    from cairn.engine import Engine

    return Engine(spark, _code(spark, d)).files.select("id", "type", "lines", "symbols", "summary", F.array_join("imports", ",").alias("imports"), "role", "importance")


@query("extract_symbols", f"""WITH {_CODE_SQL}, s AS (
  SELECT path, concat('run', k) AS name, 'func' AS kind, 4 AS line, 6 AS end_line, concat('def run', k, '(x):') AS signature, concat('run', nx) AS calls FROM co
  UNION ALL SELECT path, concat('Box', k), 'class', 8, 10, concat('class Box', k, ':'), '' FROM co
  UNION ALL SELECT path, concat('open', k), 'func', 9, 10, concat('def open', k, '(self):'), concat('run', k) FROM co)
SELECT concat(path, '::', name) AS id, kind, line, end_line, signature, true AS exported, calls FROM s""")
def extract_symbols(spark, d):
    from cairn.sources.extract import parse_files, symbol_rows

    return symbol_rows(parse_files(_code(spark, d))).select("id", "kind", "line", "end_line", "signature", "exported", F.array_join("calls", ",").alias("calls"))


@query("call_edges", f"""WITH {_CODE_SQL}
SELECT concat(path, '::run', k) AS source, concat('pkg/p', nx, '.py::run', nx) AS target, 'calls-symbol' AS kind FROM co WHERE nx <> k
UNION ALL SELECT concat(path, '::open', k), concat(path, '::run', k), 'calls-symbol-local' FROM co
UNION ALL SELECT concat(path, '::', x, k), concat('pkg/p', nx, '.py::run', nx), 'imports-symbol' FROM co, (VALUES ('run'), ('Box'), ('open')) t(x) WHERE nx <> k""")
def call_edges(spark, d):
    from cairn.engine import Engine

    return Engine(spark, _code(spark, d)).symbol_edges.select("source", "target", "kind")


@query("watch_delta", """WITH x AS (SELECT user_id, arg_max(event_type, event_id) AS hash FROM events GROUP BY user_id)
SELECT user_id::VARCHAR AS key, hash FROM x WHERE hash <> 'error'""")
def watch_delta(spark, d):
    """The events as a stream of file states: a user is a file, an error deletes it."""
    from cairn.streaming.watch import watch_states

    return watch_states(spark, f"{d}/events.parquet")
