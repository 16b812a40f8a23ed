"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a join and two aggregations; the edges of a round are written to the shared
folder, so the plan stays short and a lost executor costs one round. A node with very many
neighbours is served by ``hot_join`` and never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import P, hot_join, materialize

MAX_ROUNDS = 60


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Hang the neighbours of each node on the smallest of them: those above it (large) or those below it (small)."""
    if small:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    near = materialize(near, "near")
    low = near.groupBy("u").agg(F.min("v").alias(P + "m"), F.count("*").alias(P + "n"))
    low = materialize(low.withColumn(P + "m", F.least(P + "m", "u")), "low")
    moved = hot_join(near, low, ["u"], P + "n", near.count())
    if small:
        own = low.select(F.col("u").alias("a"), F.col(P + "m").alias("b"))
        out = moved.select(F.col("v").alias("a"), F.col(P + "m").alias("b")).unionByName(own)
    else:
        out = moved.filter("v > u").select(F.col("v").alias("a"), F.col(P + "m").alias("b"))
    return materialize(out.filter("a <> b").distinct(), "stars")


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a long, b long)``; root is the smallest node reachable."""
    edges = materialize(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    before = _mark(edges)
    for _ in range(MAX_ROUNDS):
        edges = _stars(_stars(edges, small=False), small=True)
        after = _mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
