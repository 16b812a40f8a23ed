"""Exact dedup by a tree merge of sorted digest runs.

Each input partition is a run of digests. In binomial rounds the runs exchange slices: in
round ``r`` a run keeps the digests whose ``r``-th digit is its own and hands the others to
its partners, merging what it gets (several runs at once, ``RADIX`` partners a round). At
every merge only one entry per digest survives: the row count and the smallest verified
identifier. An entry is matched by SHA-256, XXH64 and length together, so that the retained
identifier is verified by a second, independent hash at each level. A digest that a third of
all rows share therefore costs one entry per run, never one row per document.

Defined cases: null text is the empty text; rows with equal text are one group whatever their
other columns are; of repeated rows with the same ``doc_id`` one stays; a null ``doc_id`` stays
only if no row of its group has as many code points and an id; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UID, P, as_scan, hot_join, keep_rows, materialize, partitions, with_uid

RADIX = 4
LEAST_ROUNDS = 2
SPACE = r"[\x20\x09-\x0D]+"

KEY = [P + "sha", P + "xx", P + "len"]


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: row id, ``doc_id``, code points of the text, and the digests of its normalised form."""
    whole = F.coalesce(F.col(text), F.lit(""))
    norm = F.regexp_replace(whole, SPACE, "")
    rows = with_uid(as_scan(docs)).select(UID, F.col(doc_id).alias("doc_id"), F.length(whole).alias(P + "n"), norm.alias(P + "norm"))
    return rows.select(UID, "doc_id", P + "n", F.unhex(F.sha2(P + "norm", 256)).alias(KEY[0]), F.xxhash64(P + "norm").alias(KEY[1]), F.length(P + "norm").alias(KEY[2]))


def tree_merge(rows: DataFrame, width: int) -> DataFrame:
    """Merge the runs of ``rows`` to one entry per digest: count, best row (longest text, then smallest id, then row id)."""
    best = F.struct((-F.col(P + "n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(UID).alias("uid"))
    runs = rows.select(F.spark_partition_id().alias(P + "run"), *KEY, F.lit(1).cast("long").alias(P + "cnt"), best.alias(P + "best"))
    rounds, reach = 1, RADIX
    while reach < width or rounds < LEAST_ROUNDS:
        rounds, reach = rounds + 1, reach * RADIX
    for r in range(rounds):
        step = RADIX**r
        digit = F.pmod(F.shiftright(F.col(KEY[1]), (RADIX.bit_length() - 1) * r), F.lit(RADIX))
        own = F.pmod(F.floor(F.pmod(F.col(P + "run"), F.lit(reach)) / step), F.lit(RADIX))
        to = (F.pmod(F.col(P + "run"), F.lit(reach)) + (digit - own) * step).cast("int")
        runs = runs.withColumn(P + "run", to).groupBy(P + "run", *KEY).agg(F.sum(P + "cnt").alias(P + "cnt"), F.min(P + "best").alias(P + "best"))
    return runs.select(*KEY, P + "cnt", P + "best")


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256`` and the row id ``UID``."""
    spark = docs.sparkSession
    rows = materialize(digests(docs, text, doc_id), "digests")
    merged = materialize(tree_merge(rows, partitions(spark)), "runs")
    out = hot_join(rows, merged, KEY, P + "cnt", rows.count())
    return out.select(
        UID,
        "doc_id",
        F.col(P + "best.id").alias("keep_id"),
        F.col(P + "cnt").alias("group_size"),
        (F.col(P + "best.uid") == F.col(UID)).alias("kept"),
        F.lower(F.hex(KEY[0])).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of equal texts; columns unchanged."""
    docs = as_scan(docs)
    found = exact_dedup(docs, text, doc_id)
    return keep_rows(with_uid(docs), found.filter("kept"))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop(UID)


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, row_number() OVER w AS rn, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM k
"""
