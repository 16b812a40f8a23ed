"""Snapshots and deltas: what changed between two states, what that affects, and the gates on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHOWN = 20


def diff(old: DataFrame, new: DataFrame, key: str = "key", digest: str = "hash") -> DataFrame:
    """SO-01: ``key, status`` (added, removed, changed) of two snapshots; null digests compare as equal. One shuffle of keys and digests."""
    a, b = old.select(key, F.col(digest).alias("_a"), F.lit(True).alias("_old")), new.select(key, F.col(digest).alias("_b"), F.lit(True).alias("_new"))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, key, "full").select(key, status.alias("status")).filter("status is not null")


def affected(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """JN-27: sources of edges into changed or added keys that are not themselves such."""
    hit = changes.filter(F.col("status").isin("changed", "added")).select(F.col("key").alias("target"))
    into = edges.join(hit, "target", "left_semi").select(F.col("source").alias("key")).distinct()
    return into.join(hit.withColumnRenamed("target", "key"), "key", "left_anti")


def delta_report(changes: DataFrame, touched: DataFrame, shown: int = SHOWN) -> DataFrame:
    """SO-02 and TK-09: one row with counts and the first keys of each kind."""
    rows = changes.unionByName(touched.withColumn("status", F.lit("affected")))
    kinds = ("added", "removed", "changed", "affected")
    of = lambda k: F.when(F.col("status") == k, F.col("key"))
    out = rows.agg(*[F.count(of(k)).alias(f"{k}_count") for k in kinds])
    for k in kinds:  # the first keys by a bounded sort, never all of them in one list
        first = rows.filter(F.col("status") == k).select("key").distinct().orderBy("key").limit(shown)
        out = out.crossJoin(first.agg(F.sort_array(F.collect_list("key")).alias(k)))
    return out


def gate(new_cycles: Column, files: Column, changed: Column, symbols: Column, removed: Column, most_changed: float = 0.5, most_removed: float = 0.3, self_ratio: bool = False) -> Column:
    """FLT-27: names of the gates that a diff fails. With ``self_ratio`` the changed share is taken of itself (always 1) and only bites above 100 files."""
    share = F.when(files > 0, changed / files).otherwise(0.0)
    too_many = (changed > 100) if self_ratio else (share > most_changed)
    gone = F.when(symbols > 0, removed / symbols).otherwise(0.0) > most_removed
    return F.filter(F.array(F.when(new_cycles > 0, "new_cycles"), F.when(too_many, "changed_files"), F.when(gone, "removed_symbols")), lambda x: x.isNotNull())


def set_hash(rows: DataFrame, key: str = "id") -> DataFrame:
    """AG-28: one row with the MD5 of all keys in order, combined from the keys' own digests so that no task gathers them."""
    d = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.select(F.col(key)).distinct().agg(F.md5(F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum(d), F.lit(0)).cast("string"))).alias("set_hash"))
