"""Semantic search and domain detection: TF-IDF in long form, sparse and dense cosine, prototypes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Probes of a dense search that are sent out at a time.
PROBES = 2048


def tfidf(docs: DataFrame, tokens: str = "tokens", id_col: str = "id", idf: DataFrame | None = None) -> DataFrame:
    """AG-05: ``id, token, weight`` with tf = count / length and the smoothed IDF, and ``norm`` of the row's vector."""
    from .score import idf as idf_of

    table = (idf_of(docs, tokens) if idf is None else idf).select("token", "idf")
    counts = docs.select(F.col(id_col).alias("id"), F.size(tokens).alias("len"), F.explode(tokens).alias("token")).groupBy("id", "len", "token").agg(F.count("*").alias("c"))
    rows = counts.join(table, "token").select("id", "token", (F.col("c") / F.col("len") * F.col("idf")).alias("weight"))
    norm = rows.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return rows.join(norm, "id")


def sparse_topk(queries: DataFrame, index: DataFrame, k: int = 10, least: float = 0.01, digits: int = 6) -> DataFrame:
    """TK-06 and FN-08: per query the ``k`` rows of largest cosine over ``least``: only rows that share a token are ever paired."""
    pairs = index.select(F.col("id").alias("doc"), "token", F.col("weight").alias("wd"), F.col("norm").alias("nd")).join(queries.select(F.col("id").alias("query"), "token", F.col("weight").alias("wq"), F.col("norm").alias("nq")), "token")
    dots = pairs.groupBy("query", "doc").agg(F.sum(F.col("wd") * F.col("wq")).alias("dot"), F.first("nd").alias("nd"), F.first("nq").alias("nq"))
    cos = F.round(F.when(F.col("nd") * F.col("nq") > 0, F.col("dot") / (F.col("nd") * F.col("nq"))).otherwise(0.0), digits)
    scored = dots.select("query", "doc", cos.alias("similarity")).filter(F.col("similarity") > least)
    return topk(scored, ["query"], [F.col("similarity").desc(), F.col("doc")], k)


def topk(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, as ``place`` 1..k; the rank limit is pushed below the shuffle by the optimizer."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= k)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """FN-08: dense; 0 where either is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def dense_topk(probes: DataFrame, index: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """TK-07: per probe the nearest ``k`` rows of the index by cosine, itself left out. Both: ``id, embedding``.

    The probes are a stated set against all rows: they go out in blocks of ``PROBES`` (a bounded broadcast), and a task gives for each
    probe and batch of rows the ``k`` best alone, so what is shuffled is ``k`` rows a probe and batch."""
    blocks = -(-probes.count() // PROBES)
    found = None
    for n in range(blocks):
        mine = probes if blocks == 1 else probes.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n)
        rows = [(r.id, r.embedding) for r in mine.select("id", "embedding").collect()]
        if not rows:
            continue
        best = index.filter("embedding is not null").select("id", "embedding").mapInArrow(_nearest([r[0] for r in rows], np.array([r[1] for r in rows], np.float64), k, digits), "probe long, id long, similarity double")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return probes.sparkSession.createDataFrame([], "probe long, id long, similarity double, place int")
    return topk(found, ["probe"], [F.col("similarity").desc(), F.col("id")], k)


def _nearest(ids: list[int], probes: np.ndarray, k: int, digits: int):
    norm = np.sqrt((probes * probes).sum(axis=1))
    own = np.array(ids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.asarray(b.column("embedding").flatten(), np.float64).reshape(b.num_rows, -1)
            row_ids = b.column("id").to_numpy()
            size = np.sqrt((rows * rows).sum(axis=1))
            both = norm[:, None] * size[None, :]
            cos = np.round(np.divide(probes @ rows.T, both, out=np.zeros_like(both), where=both > 0), digits)
            cos[own[:, None] == row_ids[None, :]] = -2  # itself
            order = np.lexsort((np.broadcast_to(row_ids, cos.shape), -cos), axis=1)[:, :k]
            best = np.take_along_axis(cos, order, axis=1)
            keep = best > -2
            yield pa.record_batch([pa.array(np.repeat(own, keep.sum(axis=1))), pa.array(row_ids[order][keep]), pa.array(best[keep])], ["probe", "id", "similarity"])

    return run


def prototypes(examples: DataFrame, idf: DataFrame) -> DataFrame:
    """AG-06 over ``domain, id, tokens``: ``domain, token, weight``, the mean of the domain's example vectors, with its norm."""
    vectors = tfidf(examples, idf=idf).join(examples.select("id", "domain"), "id")
    n = examples.groupBy("domain").agg(F.count("*").alias("n"))
    mean = vectors.groupBy("domain", "token").agg(F.sum("weight").alias("w")).join(n, "domain").select("domain", "token", (F.col("w") / F.col("n")).alias("weight"))
    norm = mean.groupBy("domain").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return mean.join(norm, "domain")


def detect_domain(vectors: DataFrame, protos: DataFrame, digits: int = 6) -> DataFrame:
    """AG-07: the prototype of largest cosine for each ``id``; rows that share no token get the first domain in name order."""
    dots = vectors.select("id", "token", F.col("weight").alias("wv"), F.col("norm").alias("nv")).join(protos, "token").groupBy("id", "domain").agg(F.sum(F.col("wv") * F.col("weight")).alias("d"), F.first("nv").alias("nv"), F.first("norm").alias("np"))
    cos = F.round(F.when(F.col("nv") * F.col("np") > 0, F.col("d") / (F.col("nv") * F.col("np"))).otherwise(0.0), digits)
    best = dots.groupBy("id").agg(F.min(F.struct((-cos).alias("c"), "domain")).alias("b"))
    first = protos.agg(F.min("domain").alias("first"))
    rows = vectors.select("id").distinct().join(best, "id", "left").crossJoin(F.broadcast(first))
    return rows.select("id", F.coalesce("b.domain", "first").alias("domain"), F.coalesce(-F.col("b.c"), F.lit(0.0)).alias("similarity"))
