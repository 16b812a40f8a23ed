"""Mixing sources to target weights by entropy balancing. DataFrame operations only.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and share
``BUDGET`` of all words; a target stops at ``MOST`` times its source's words and the excess is
reshared by weight (water filling, solved exactly from the sorted saturation points).

Rates: of all document rates between 0 and ``MOST`` that give each source its target of words, those nearest to 1 in
entropy, sum(r ln r - r), are exponential tilts by the words of a document, min(MOST, exp(lambda[source] * x)) with
x the document's size over its source's word-weighted mean size. The multipliers solve the convex dual: its gradient
in a source is the words that the rates take less the target, its curvature the sum of size * x * rate. Each Newton step sums both
over all documents, as (source, size) classes with their counts, and a bracket that the signs of the gradients
narrow holds every step. A source that must be taken ``MOST`` times whole has no finite multiplier and that rate.

Copies: rates are rounded to millionths and dealt by systematic rounding over the documents of
a source in order of size; two repair steps then move the one document that brings the source nearest to
its target. Places come from counts of (source, size, slice) cells, where a class of over ``SLICE_ROWS`` documents has as
many slices as keep a cell at about that; no task sorts a source or a class. All sums that decide copies are of exact
integers, so reruns agree.

Defined cases: null text has size 0; sources without words get target 0 and no copies; null is a source of
its own; repeated rows are separate documents (in the order of their place in the files); rows with a null ``doc_id`` come
last in their cell; a very long text is one row whose size alone is moved; columns of the mix (``mix_size, mix_target,
mix_copy``) take another name (``_2`` and so on) where the documents have one of that name; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import UID, P, as_scan, hot_join, materialize, with_uid

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
#: Newton steps a job, and jobs at most (a bracket halves at worst, so that many suffice for any double).
STEPS_AT_ONCE = 3
MOST_JOBS = 40
WIDEST = float(2**20)
EXACT = 1e-12
SLICE_ROWS = 10_000
REPAIRS = 2
UNIT = 1_000_000

WORD = r"[^\x20\x09-\x0D]+"
SRC = [P + "no", P + "src"]


def sizes(docs: DataFrame) -> DataFrame:
    """Row id, ``doc_id``, source key and the number of words of each row."""
    return with_uid(docs).select(
        UID,
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").isNull().alias(SRC[0]),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias(SRC[1]),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def targets(by_source: DataFrame) -> DataFrame:
    """Add ``target`` to one row per source (``SRC``, ``words``)."""
    order = Window.orderBy(*SRC)
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (turn + 1).cast("int")).cast("long")
    rows = by_source.withColumn(P + "w", weight)
    filled = Window.orderBy((F.col("words") / F.col(P + "w")), *SRC)
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        P + "all": F.sum("words").over(filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        P + "full": MOST * F.coalesce(F.sum("words").over(before), F.lit(0)),
        P + "left": F.sum(P + "w").over(filled.rowsBetween(0, Window.unboundedFollowing)),
    })
    # with the sources before this one full, a unit of weight is worth so much
    level = (F.lit(BUDGET) * F.col(P + "all") - F.col(P + "full")) / F.col(P + "left")
    rows = rows.withColumn(P + "t", F.when(level <= F.lit(float(MOST)) * F.col("words") / F.col(P + "w"), level))
    whole = filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn(P + "t", F.max(P + "t").over(whole))  # the first level that holds is the largest one
    target = F.least(F.col(P + "t") * F.col(P + "w"), F.lit(float(MOST)) * F.col("words"))
    return rows.select(*SRC, "words", P + "docs", F.coalesce(target, F.lit(float(MOST)) * F.col("words")).alias("target"))


def _rate(lam) -> F.Column:
    """The rate of a class of documents (``x``) under the multiplier of its source."""
    return F.when(F.col(P + "whole"), F.lit(float(MOST))).otherwise(F.least(F.lit(float(MOST)), F.exp(F.least(lam * F.col("x"), F.lit(1.0)))))


def tilt(classes: DataFrame, by_source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``by_source`` with ``lam``, the multiplier of each source's word constraint, and ``classes`` with ``x``, by distributed Newton steps."""
    mean = classes.groupBy(*SRC).agg((F.sum(F.col(P + "m") * F.col("size") * F.col("size").cast("double")) / F.nullif(F.sum(F.col(P + "m") * F.col("size")), F.lit(0))).alias("mean"))
    held = by_source.join(mean, SRC).withColumn(P + "whole", F.col("target") >= MOST * F.col("words"))
    lam = F.when(~F.col(P + "whole") & (F.col("words") > 0), F.lit(0.0))
    state = materialize(held.withColumns({"lam": lam, "lo": F.lit(-WIDEST), "hi": F.lit(WIDEST), P + "open": lam.isNotNull()}), "tilts")
    classes = materialize(classes.join(held.select(*SRC, "mean"), SRC).withColumn("x", F.coalesce(F.col("size") / F.col("mean"), F.lit(0.0))).drop("mean"), "classes")
    some = classes.filter("size > 0")
    for _ in range(MOST_JOBS):
        for _ in range(STEPS_AT_ONCE):
            moved = some.join(state.filter(P + "open").select(*SRC, "lam", P + "whole"), SRC)
            got = F.col(P + "m") * F.col("size") * _rate(F.col("lam"))
            free = F.col("lam") * F.col("x") < F.log(F.lit(float(MOST)))  # a rate at the bound does not move
            sums = moved.groupBy(*SRC).agg(F.sum(got).alias("got"), F.sum(F.when(free, got * F.col("x")).otherwise(0.0)).alias("bend"))
            state = state.join(sums, SRC, "left").withColumn("off", F.col("got") - F.col("target"))
            state = state.withColumns({"lo": F.when(F.col("off") < 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(F.col("off") > 0, F.col("lam")).otherwise(F.col("hi"))})
            newton = F.col("lam") - F.try_divide("off", "bend")
            inside = (newton > F.col("lo")) & (newton < F.col("hi"))
            settled = ~F.col(P + "open") | (F.abs("off") <= EXACT * F.col("words"))
            step = F.when(settled, F.col("lam")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2)
            state = state.withColumns({P + "open": ~settled & (step != F.col("lam")), "lam": step}).drop("got", "bend", "off")
        state = materialize(state, "tilts")
        if state.filter(P + "open").isEmpty():
            break
    return state.select(*by_source.columns, "lam", P + "whole"), classes


def _placed(rows: DataFrame, classes: DataFrame, by_source: DataFrame, total: int) -> DataFrame:
    """Add to each row the rate of its class and the sum of all rates before it in its source, by (size, slice, ``doc_id``, row id), in millionths."""
    rates = classes.join(by_source.select(*SRC, "lam", P + "whole", "target"), SRC)
    rate = F.when(F.col("target") > 0, F.round(UNIT * _rate(F.col("lam"))).cast("long")).otherwise(F.lit(0).cast("long"))
    before = Window.partitionBy(*SRC).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rates = rates.withColumn(P + "rate", F.coalesce(rate, F.lit(0)))
    rates = rates.withColumn(P + "sum", F.coalesce(F.sum(F.col(P + "m") * F.col(P + "rate")).over(before), F.lit(0)))
    rates = materialize(rates.select(*SRC, "size", P + "m", P + "rate", P + "sum", F.ceil(F.col(P + "m") / SLICE_ROWS).cast("int").alias(P + "slices")), "rates")
    # a class of one slice needs no salt: its rows are in the order of their ids
    slice_ = F.pmod(F.xxhash64("doc_id", UID), F.col(P + "slices")).alias(P + "slice")
    rows = hot_join(rows, rates, [*SRC, "size"], P + "m", total).select(UID, "doc_id", *SRC, "size", P + "rate", P + "sum", slice_)
    rows = materialize(rows, "cells")
    cell = [*SRC, "size", P + "slice"]
    in_class = Window.partitionBy(*SRC, "size").orderBy(P + "slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.filter(F.col(P + "slice").isNotNull()).groupBy(*cell).agg(F.count("*").alias(P + "n"))
    cells = cells.withColumn(P + "p", F.coalesce(F.sum(P + "n").over(in_class), F.lit(0))).drop(P + "n")
    own = Window.partitionBy(*cell).orderBy(F.col("doc_id").asc_nulls_last(), UID)
    ranked = rows.withColumn(P + "r", F.row_number().over(own)).join(cells, cell)
    return ranked.withColumn(P + "sum", F.col(P + "sum") + (F.col(P + "r") + F.col(P + "p") - 1) * F.col(P + "rate"))


def _repair(rows: DataFrame, by_source: DataFrame, total: int) -> DataFrame:
    """Give or take one copy of the document of each source that brings its taken words nearest to the target."""
    taken = rows.groupBy(*SRC).agg(F.sum(F.col("copies") * F.col("size")).alias(P + "taken"))
    gap = by_source.join(taken, SRC).select(*SRC, P + "docs", (F.round("target").cast("long") - F.col(P + "taken")).alias(P + "gap"))
    off = F.col(P + "gap")
    open_rows = hot_join(rows, gap, SRC, P + "docs", total)  # settled sources too, else their rows would be shuffled to find that out
    can = (off != 0) & F.when(off > 0, F.col("copies") < MOST).otherwise(F.col("copies") > 0) & (F.col("size") > 0) & (F.col("size") < 2 * F.abs(off))
    key = F.struct(F.abs(F.abs(off) - F.col("size")).alias("d"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col(UID).alias("u"))
    best = open_rows.filter(can).groupBy(*SRC).agg(F.min(key).alias(P + "b"), F.max(F.signum(off).cast("int")).alias(P + "d"))
    move = best.select(F.col(P + "b.u").alias(UID), F.col(P + "d"))
    moved = rows.join(move, UID, "left").withColumn("copies", F.col("copies") + F.coalesce(P + "d", F.lit(0))).drop(P + "d")
    return materialize(moved, "copies")


def mix(docs: DataFrame) -> DataFrame:
    """``UID, doc_id, size, source_size, target, copies, taken`` of each row."""
    rows = materialize(sizes(as_scan(docs)), "sizes")
    total = rows.count()
    classes = materialize(rows.groupBy(*SRC, "size").agg(F.count("*").alias(P + "m")), "classes")
    by_source = classes.groupBy(*SRC).agg(F.sum(F.col("size") * F.col(P + "m")).alias("words"), F.sum(P + "m").alias(P + "docs"))
    by_source, classes = tilt(classes, materialize(targets(by_source), "sources"))
    placed = _placed(rows, classes, by_source, total)
    upto = lambda c: F.floor((c + UNIT // 2) / UNIT)
    dealt = placed.withColumn("copies", (upto(F.col(P + "sum") + F.col(P + "rate")) - upto(F.col(P + "sum"))).cast("int"))
    dealt = materialize(dealt.select(UID, "doc_id", *SRC, "size", "copies"), "copies")
    for _ in range(REPAIRS):
        dealt = _repair(dealt, by_source, total)
    out = hot_join(dealt, by_source.select(*SRC, P + "docs", F.col("words").alias("source_size"), "target"), SRC, P + "docs", total)
    return out.select(UID, "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _free(name: str, taken: list[str]) -> str:
    """``name``, or with the first number from 2 on that no column has."""
    k, out, lower = 2, name, {x.lower() for x in taken}
    while out.lower() in lower:
        out, k = f"{name}_{k}", k + 1
    return out


def apply_mix(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes it: each row as many times as it has copies, with its size and its source's target."""
    docs = as_scan(docs)
    taken = mix(docs).filter("copies > 0").select(UID, F.col("size").alias(P + "size"), F.col("target").alias(P + "target"), F.col("copies").alias(P + "copies"))
    names = [_free(x, docs.columns) for x in ("mix_size", "mix_target", "mix_copy")]
    both = with_uid(docs).join(taken.hint("shuffle_hash"), UID)
    copies = F.explode(F.sequence(F.lit(1), F.col(P + "copies"))).alias(names[2])
    own = [f"`{c}`" for c in docs.columns]
    return both.select(*own, F.col(P + "size").alias(names[0]), F.col(P + "target").alias(names[1]), copies)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def _repair_sql(k: int) -> str:
    return f"""
g{k} AS (
  SELECT s.src, CAST(round(s.target) AS BIGINT) - sum(c.copies * c.size) AS gap
  FROM c{k} c JOIN s ON c.src = s.src GROUP BY s.src, s.target),
b{k} AS (
  SELECT c.doc_id, sign(g.gap) AS d, row_number() OVER (
           PARTITION BY c.src ORDER BY abs(abs(g.gap) - c.size), c.doc_id) AS rn
  FROM c{k} c JOIN g{k} g ON c.src = g.src
  WHERE g.gap <> 0 AND c.size > 0 AND c.size < 2 * abs(g.gap)
    AND CASE WHEN g.gap > 0 THEN c.copies < {MOST} ELSE c.copies > 0 END),
c{k + 1} AS (
  SELECT c.doc_id, c.src, c.size, c.copies + coalesce(b.d, 0) AS copies
  FROM c{k} c LEFT JOIN b{k} b ON b.doc_id = c.doc_id AND b.rn = 1)"""


OP9_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, struct_pack(n := source IS NULL, s := coalesce(source, '')) AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
a AS (SELECT src, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY src),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY src.n, encode(src.s)) - 1) % 3] AS w FROM a),
f AS (
  SELECT *, sum(words) OVER () AS whole,
         2 * coalesce(sum(words) OVER (ORDER BY words / w, src.n, encode(src.s) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(w) OVER (ORDER BY words / w, src.n, encode(src.s) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM w),
t AS (SELECT max((1.5 * whole - filled)::DOUBLE / rest) AS t FROM f WHERE (1.5 * whole - filled)::DOUBLE / rest <= 2.0 * words / w),
s AS (SELECT src, words, least(coalesce((SELECT t FROM t) * w, 2.0 * words), 2.0 * words)::DOUBLE AS target FROM w),
k AS (SELECT src, size, count(*) AS m FROM d GROUP BY ALL),
e AS (SELECT src, sum(m * size * size::DOUBLE) / sum(m * size) AS mean FROM k GROUP BY src),
x AS (SELECT k.src, k.size, k.m, k.size / e.mean AS x FROM k JOIN e ON k.src = e.src),
n AS (  -- the multipliers by halving brackets
  SELECT 0 AS step, src, -{WIDEST}::DOUBLE AS lo, {WIDEST}::DOUBLE AS hi FROM s WHERE words > 0 AND target < {MOST} * words
  UNION ALL
  SELECT n.step + 1, n.src,
         CASE WHEN sum(x.m * x.size * least({MOST}, exp(least((n.lo + n.hi) / 2 * x.x, 1)))) < s.target THEN (n.lo + n.hi) / 2 ELSE n.lo END,
         CASE WHEN sum(x.m * x.size * least({MOST}, exp(least((n.lo + n.hi) / 2 * x.x, 1)))) < s.target THEN n.hi ELSE (n.lo + n.hi) / 2 END
  FROM n JOIN x ON x.src = n.src JOIN s ON s.src = n.src WHERE n.step < 75 GROUP BY n.step, n.src, n.lo, n.hi, s.target),
l AS (SELECT src, (lo + hi) / 2 AS lam FROM n WHERE step = 75),
r AS (
  SELECT x.src, x.size, CASE WHEN s.words = 0 THEN 0 WHEN l.lam IS NULL THEN {MOST * UNIT}
         ELSE CAST(round({UNIT} * least({MOST}, exp(least(l.lam * x.x, 1)))) AS BIGINT) END AS rate
  FROM x JOIN s ON x.src = s.src LEFT JOIN l ON x.src = l.src),
p AS (
  SELECT d.*, r.rate, sum(r.rate) OVER (PARTITION BY d.src ORDER BY d.size, d.doc_id ROWS UNBOUNDED PRECEDING) AS c
  FROM d JOIN r ON d.src = r.src AND d.size = r.size),
c0 AS (
  SELECT doc_id, src, size, (c + {UNIT // 2}) // {UNIT} - (c - rate + {UNIT // 2}) // {UNIT} AS copies FROM p),
{",".join(_repair_sql(k) for k in range(REPAIRS))}
SELECT c.doc_id, c.size, s.words AS source_size, s.target, CAST(c.copies * c.size AS BIGINT) AS taken
FROM c{REPAIRS} c JOIN s ON c.src = s.src
"""
