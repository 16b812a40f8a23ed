"""Inputs of the registered queries: the driver's tables seen as symbols, files, edges and tasks, in Spark and in SQL.

Both sides derive the same columns from the same whole tables: a part is a symbol, its brand and
type name a file, an order line an edge, an order a commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASKS = (
    (1, "fix the broken ring widget in small parts"),
    (2, "add tests for blue bolt types"),
    (3, "Refactor redWidget and update steel gears"),
    (4, "support promo items with large models"),
    (5, "find nothing here"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TASKS), "task_id int, task string")


TASKS_SQL = "tasks(task_id, task) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in TASKS) + ")"


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    first, second = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    name = F.concat(first, F.upper(F.substring(second, 1, 1)), F.substring(second, 2, 100))
    file = F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")), F.lit(".py"))
    kind = F.when(k % 4 < 2, "func").when(k % 4 == 2, "class").otherwise("interface")
    sig = F.when(k % 3 == 0, F.concat(F.lit("def "), name, F.lit("("), F.col("p_type"), F.lit(")"))).when(k % 3 == 1, F.concat(name, F.lit("()"))).otherwise(F.concat(F.lit("class "), name, F.lit(":")))
    role = F.when(k % 5 == 0, "hub").when(k % 5 == 1, "leaf").when(k % 5 == 2, "entry_point").when(k % 5 == 3, "api_surface").otherwise("module")
    return table(spark, sf_dir, "part").select(
        F.concat(file, F.lit("::"), k.cast("string")).alias("id"),
        k.alias("no"),
        name.alias("name"),
        file.alias("file"),
        kind.alias("kind"),
        sig.alias("signature"),
        (k % 2 == 0).alias("exported"),
        F.col("p_size").alias("start_line"),
        (F.col("p_size") + k % 120).cast("int").alias("end_line"),
        (F.col("p_size") / 50.0).alias("rank"),
        (k % 30).cast("int").alias("named_imports"),
        (k % 3).cast("int").alias("resolved_imports"),
        (k % 9).cast("int").alias("inbound_calls"),
        (k % 5).cast("int").alias("outbound_calls"),
        role.alias("role"),
        F.col("p_size").alias("size"),
        F.col("p_retailprice").alias("price"),
    )


SYMBOLS_SQL = """sym0 AS (
  SELECT p_partkey AS no, p_size AS size, p_retailprice AS price, p_type,
         concat(split_part(p_name, ' ', 1), upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2)) AS name,
         concat('src/', lower(p_type), '/', replace(lower(p_brand), '#', '_'), '.py') AS file
  FROM part),
sym AS (
  SELECT concat(file, '::', no) AS id, no, name, file, size, price,
         CASE WHEN no % 4 < 2 THEN 'func' WHEN no % 4 = 2 THEN 'class' ELSE 'interface' END AS kind,
         CASE WHEN no % 3 = 0 THEN concat('def ', name, '(', p_type, ')') WHEN no % 3 = 1 THEN concat(name, '()') ELSE concat('class ', name, ':') END AS signature,
         no % 2 = 0 AS exported, size AS start_line, size + no % 120 AS end_line, size / 50.0 AS rank,
         no % 30 AS named_imports, no % 3 AS resolved_imports, no % 9 AS inbound_calls, no % 5 AS outbound_calls,
         CASE no % 5 WHEN 0 THEN 'hub' WHEN 1 THEN 'leaf' WHEN 2 THEN 'entry_point' WHEN 3 THEN 'api_surface' ELSE 'module' END AS role
  FROM sym0)"""


def tok(x: str) -> str:
    """PRJ-01 in SQL."""
    return rf"regexp_extract_all(lower(regexp_replace(regexp_replace(coalesce({x}, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[@./_\-]+', ' ', 'g')), '[a-z0-9]+')"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def kw(x: str) -> str:
    """FN-01 in SQL, without synonyms: distinct words in order, over two characters, stop words out."""
    from cairn.functions.text import STOP_WORDS

    words = f"flatten(list_transform(regexp_extract_all(coalesce({x}, ''), '[\\p{{L}}\\p{{N}}_@./\\-]+'), lambda r: {tok('r')}))"
    kept = f"list_filter({words}, lambda w: length(w) > 2 AND NOT list_contains({sql_list(STOP_WORDS)}, w))"
    return ordered_distinct(kept)


def ordered_distinct(x: str) -> str:
    return f"list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform({x}, lambda w: [w])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END)"


def overlap(a: str, b: str) -> str:
    """Number of distinct strings in both lists."""
    return f"len(list_filter(list_distinct({a}), lambda w: list_contains({b}, w)))"


def nation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nation to supplier nation, one row per order line; nation 0 and 1 have no links out, so that there are sinks."""
    li, od = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cu, su = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = li.join(od, F.col("l_orderkey") == F.col("o_orderkey")).join(cu, F.col("o_custkey") == F.col("c_custkey")).join(su, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.filter("c_nationkey > 1").select(F.col("c_nationkey").cast("long").alias("source"), F.col("s_nationkey").cast("long").alias("target"))


NATION_LINKS_SQL = """links AS (
  SELECT c_nationkey AS source, s_nationkey AS target
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey > 1)"""


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_name", "n_regionkey")


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to part: ``S<key>``, ``P<key>``, an edge per order line, kinds by line number."""
    kind = F.when(F.col("l_linenumber") % 3 == 0, "imports-symbol").when(F.col("l_linenumber") % 3 == 1, "calls-symbol").otherwise("calls-symbol-local")
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("target"), kind.alias("kind"), F.concat(F.lit("F"), (F.col("l_suppkey") % 10).cast("string")).alias("source_file"))


SUPPLY_EDGES_SQL = """edges AS (
  SELECT concat('S', l_suppkey) AS source, concat('P', l_partkey) AS target,
         CASE l_linenumber % 3 WHEN 0 THEN 'imports-symbol' WHEN 1 THEN 'calls-symbol' ELSE 'calls-symbol-local' END AS kind,
         concat('F', l_suppkey % 10) AS source_file
  FROM lineitem)"""


def comment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comment line for each event: its type decides the tag, its user the file."""
    t = F.col("event_type")
    text = F.when(t == "error", F.concat(F.lit("# FIXME: value "), F.floor("value").cast("string"))).when(t == "click", F.lit("// todo (later) ; hack nothing")).when(t == "purchase", F.lit("x = 1  # XXX")).when(t == "view", F.lit("temperature is high")).otherwise("plain line")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".py")).alias("file"), F.col("event_id").cast("int").alias("line"), text.alias("text"))


COMMENT_LINES_SQL = """lines AS (
  SELECT concat('u', user_id, '.py') AS file, CAST(event_id AS INTEGER) AS line,
         CASE event_type WHEN 'error' THEN concat('# FIXME: value ', CAST(floor(value) AS BIGINT)) WHEN 'click' THEN '// todo (later) ; hack nothing'
              WHEN 'purchase' THEN 'x = 1  # XXX' WHEN 'view' THEN 'temperature is high' ELSE 'plain line' END AS text
  FROM events)"""


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source path for each page and a test path for every other one, from its URL."""
    host, leaf = F.regexp_extract("url", r"^https?://([^/]+)", 1), F.regexp_replace(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1), r"[^a-z0-9/]", "_")
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.replace(host, F.lit("."), F.lit("_")), F.lit("/"), leaf, F.lit(".py")).alias("path"))
    d, b = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.regexp_extract("path", r"([^/]*)$", 1)
    test = F.when(F.col("page_id") % 4 == 0, F.concat(d, F.lit("/test_"), b)).when(F.col("page_id") % 4 == 2, F.concat(F.lit("tests/test_"), b))
    return rows.select("path").unionByName(rows.select(test.alias("path")).filter("path is not null")).distinct()


PAGE_PATHS_SQL = r"""pp AS (
  SELECT page_id, concat(replace(regexp_extract(url, '^https?://([^/]+)', 1), '.', '_'), '/',
         regexp_replace(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '[^a-z0-9/]', '_', 'g'), '.py') AS path FROM pages),
paths AS (
  SELECT path FROM pp UNION
  SELECT CASE page_id % 4 WHEN 0 THEN concat(regexp_extract(path, '^(.*)/[^/]*$', 1), '/test_', regexp_extract(path, '([^/]*)$', 1))
              ELSE concat('tests/test_', regexp_extract(path, '([^/]*)$', 1)) END
  FROM pp WHERE page_id % 2 = 0)"""
