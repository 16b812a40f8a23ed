"""The gate on changes: snapshots, their diff, the verdict, a report. ``python -m cairn`` calls it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import sets
from cairn.sources import scan


def take_snapshot(engine, path: str) -> None:
    """API-24 init: files, symbols and cycles as one table."""
    cycles = engine.cycles().select(F.concat(F.lit("cycle:"), "cycle").alias("key"), F.lit("").alias("hash"))
    edges = engine.file_edges.select(F.concat(F.lit("edge:"), "source", F.lit(">"), "target").alias("key"), F.lit("").alias("hash")).distinct()
    scan.save_snapshot(engine.snapshot().unionByName(cycles).unionByName(edges), path)


def compare_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """SO-01: ``kind, key, status``."""
    rows = sets.diff(old, new)
    return rows.select(F.substring_index("key", ":", 1).alias("kind"), F.regexp_replace("key", "^[a-z]+:", "").alias("key"), "status")


def verdict(old: DataFrame, new: DataFrame, changes: DataFrame) -> DataFrame:
    """FLT-27: one row: counts and the gates that fail."""
    count = lambda kind, *status: F.count_if((F.col("kind") == kind) & F.col("status").isin(*status))
    c = changes.agg(count("cycle", "added").alias("new_cycles"), count("file", "added").alias("files_added"), count("file", "removed").alias("files_removed"), count("file", "changed").alias("files_changed"), count("symbol", "added").alias("symbols_added"), count("symbol", "removed").alias("symbols_removed"), count("edge", "added").alias("edges_added"), count("edge", "removed").alias("edges_removed"))
    files = new.agg(F.count_if(F.col("key").startswith("file:")).alias("files"))
    symbols = old.agg(F.count_if(F.col("key").startswith("symbol:")).alias("symbols"))
    rows = c.crossJoin(files).crossJoin(symbols)
    return rows.withColumn("failed", sets.gate(F.col("new_cycles"), F.col("files"), F.col("files_changed"), F.col("symbols"), F.col("symbols_removed")))


def report(row, changes: DataFrame, shown: int = 20) -> str:
    """SNK-06: the verdict as Markdown, with the first changes of each kind."""
    lines = ["# Change report", "", f"**{'FAIL: ' + ', '.join(row.failed) if row.failed else 'PASS'}**", "", "| what | count |", "|-|-|"]
    lines += [f"| {k.replace('_', ' ')} | {v} |" for k, v in row.asDict().items() if k != "failed"]
    for r in changes.select("kind", "status").distinct().orderBy("kind", "status").collect():  # a few kinds by three statuses
        first = changes.filter((F.col("kind") == r.kind) & (F.col("status") == r.status)).orderBy("key").limit(shown)
        lines += ["", f"## {r.kind} {r.status}", *[f"- {k.key}" for k in first.collect()]]
    return "\n".join(lines) + "\n"
