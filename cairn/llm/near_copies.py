"""Near copies of the pipeline: SimHash over five-word shingles in the Gray index, every link verified at a similarity of 0.8.

Sixty-four bits and a radius of three cannot hold a Jaccard similarity of 0.8: the bits of such a pair differ with a
probability of ``DIFFER``. The stage therefore takes ``WORDS`` words of fingerprint and a radius that all but about one
in a thousand of such pairs keep and that unrelated pairs do not reach. Buckets are tables of sampled bits: as many
bits as keep a bucket at about ``BUCKET`` rows, and as many tables as ``TARGET`` recall needs at that number of bits (both
grow with the number of texts). In each bucket the Gray-order index links what lies within the radius.

These links only propose: texts that chains of them connect are a family. In a task a family's shingle sets are held
together and joined by the same index with a radius so wide that it loses practically no pair; a pair counts only if the
exact Jaccard similarity of the two sets is ``SIMILARITY`` or more, and pairs that verified links already connect are
skipped. No pair leaves a task, only a spanning forest of verified links does.

A family of over ``SLICE`` shingles is dealt to slices. Each slice is first joined on its own, beside the family's
``ANCHORS`` first texts or so; what the links of all slices leave outside the family's largest group (a small rest, as a rule) then
meets every slice. So no pair between different groups is missed, and no task holds more than two slices.

Defined cases: texts of fewer than five words are one shingle; null, empty and blank texts have no shingles and are
copies of each other; the shingles of a very long text are a slice of their own at worst; of a group the smallest
``doc_id`` stays (a null one only if all are null), of repeated ids the first row; extra columns are kept, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import P, UID, as_scan, hot_join, keep_rows, materialize, partitions, with_uid
from .components import components
from .simhash import Forest, GrayIndex, gray_rank, link_rows, majority

SEED = 42
SHINGLE = 5
SIMILARITY = 0.8
WORDS = 3
#: Probability that a bit differs at a similarity of 0.8: the angle between two such sets (cosine 2s / (1 + s)) over pi.
DIFFER = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
_SPREAD = math.sqrt(64 * WORDS * DIFFER * (1 - DIFFER))
RADIUS = round(64 * WORDS * DIFFER + 3 * _SPREAD)
FAMILY_RADIUS = round(64 * WORDS * DIFFER + 5.2 * _SPREAD)
TARGET = 0.95
BUCKET = 512
SLICE = 2_000_000
ANCHORS = 32
PAIRS_AT_ONCE = 1024
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
W = [f"w{k}" for k in range(WORDS)]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and only [\x20\x09-\x0D] separates
    if not words:
        return np.zeros(0, np.uint64)
    k = min(SHINGLE, len(words))
    grams = map(b" ".join, zip(*(islice(words, i, None) for i in range(k)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(words) - k + 1))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` words of SimHash of a shingle set."""
    rows = [hashes]
    for _ in range(WORDS - 1):
        x = (rows[-1] ^ (rows[-1] >> np.uint64(31))) * _M1
        rows.append((x ^ (x >> np.uint64(29))) * _M2)
    return majority(np.stack(rows, axis=1))


def tables(texts: int) -> np.ndarray:
    """The sampled bits of each table for so many texts: (tables, bits)."""
    bits = min(62, max(6, math.ceil(math.log2(max(2, texts))) - int(math.log2(BUCKET))))
    width = 64 * WORDS
    apart = np.arange(width + 1)
    weight = np.array([math.comb(width, d) * DIFFER**d * (1 - DIFFER) ** (width - d) for d in apart.tolist()])
    agree = np.array([math.comb(width - d, bits) / math.comb(width, bits) for d in apart.tolist()])
    n = 1
    while (weight * (1 - agree) ** n).sum() > 1 - TARGET:
        n += max(1, n // 50)
    rng = np.random.default_rng(SEED)
    return np.stack([np.sort(rng.choice(64 * WORDS, bits, replace=False)) for _ in range(n)])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for b in batches:
        digests, sizes, fps = [], [], []
        for t in b.column("text").to_pylist():
            h = shingles(t)
            digests.append(xxhash.xxh3_128_hexdigest(h.tobytes()))
            sizes.append(len(h))
            fps.append(wide_fingerprint(h))
        fp = np.stack(fps).view(np.int64) if fps else np.zeros((0, WORDS), np.int64)
        yield pa.record_batch([b.column(UID), b.column("doc_id"), pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), *(pa.array(fp[:, k].copy()) for k in range(WORDS))], [UID, "doc_id", "digest", "size", *W])


def _deal(picks: np.ndarray):
    """Each node once for each table, under the value of the table's bits."""
    power = np.int64(1) << np.arange(picks.shape[1], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [b.column(w).to_numpy() for w in W]
            bits = np.unpackbits(np.stack(fp, axis=1).view(np.uint8).reshape(b.num_rows, 8 * WORDS), axis=1)
            for t, pick in enumerate(picks):
                value = bits[:, pick].astype(np.int64) @ power
                yield pa.record_batch([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(value), b.column("node"), *(b.column(w) for w in W)], ["turn", "value", "node", *W])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            found = [pa.array(shingles(t).view(np.int64)) for t in part.column("text").to_pylist()]
            yield pa.record_batch([part.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "hashes"])


class _Sets:
    """Shingle sets of a task's nodes; ``similar`` says which pairs have a similarity of ``SIMILARITY`` or more."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets], np.int64)
        values, ids = np.unique(np.concatenate(sets), return_inverse=True)
        shared = np.bincount(ids, minlength=len(values)) > 1  # a shingle of one set alone is in no intersection
        owner = np.repeat(np.arange(len(sets)), self.size)[shared[ids]]
        self.flat = ids[shared[ids]]
        self.kept = np.bincount(owner, minlength=len(sets))
        self.start = np.cumsum(self.kept) - self.kept
        self.mark = np.zeros(len(values), np.uint8)

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = np.zeros(len(a), np.int64)
        m, n = self.size[a], self.size[b]
        need = np.ceil(SIMILARITY / (1 + SIMILARITY) * (m + n) - 1e-9)  # by the sizes alone, then by what is shared at all
        worth = np.flatnonzero(np.minimum(np.minimum(m, n), np.minimum(self.kept[a], self.kept[b])) >= need)
        order = worth[np.argsort(a[worth], kind="stable")]
        edge = np.flatnonzero(np.diff(a[order], prepend=-1))
        for lo, hi in zip(edge.tolist(), np.append(edge, len(order))[1:].tolist(), strict=True):
            i, others = a[order[lo]], b[order[lo:hi]]
            own = self.flat[self.start[i] : self.start[i] + self.kept[i]]
            self.mark[own] = 1
            k = self.kept[others]
            end = np.cumsum(k)
            at = np.repeat(self.start[others] - (end - k), k) + np.arange(end[-1])
            both[order[lo:hi]] = np.add.reduceat(self.mark[self.flat[at]], end - k, dtype=np.int64)
            self.mark[own] = 0
        # as in exact arithmetic on integers: 5 * both >= 4 * union
        return 5 * both >= 4 * (m + n - both)


def family_links(node: np.ndarray, known: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the verified links between the nodes of one task, beyond the groups that ``known`` names."""
    fp = np.stack([wide_fingerprint(x) for x in sets])
    order = np.lexsort(gray_rank(fp).T[::-1])
    node, known, fp = node[order], known[order], fp[order]
    forest = Forest(len(node))
    _, first, of = np.unique(known, return_index=True, return_inverse=True)
    forest.link(np.arange(len(node)), first[of])
    held = _Sets([sets[i] for i in order])
    up = GrayIndex(np.zeros(len(node), np.int64), fp).join(FAMILY_RADIUS, forest, held.similar, PAIRS_AT_ONCE).up
    tied = np.flatnonzero(up != np.arange(len(up)))
    return node[tied], node[up[tied]]


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``family, slice, rest, node, known, hashes`` sorted by the first three to links ``a, b``."""
    key, nodes, known, sets = None, [], [], []

    def flush() -> Iterator[pa.RecordBatch]:
        if len(nodes) > 1:
            n, first = np.unique(np.array(nodes, np.int64), return_index=True)  # a node may be an anchor of its own slice
            a, b = family_links(n, np.array(known, np.int64)[first], [sets[i] for i in first])
            if len(a):
                yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    for b in batches:
        keys = np.stack([b.column(c).to_numpy() for c in ("family", "slice", "rest")], axis=1)
        edge = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
        hashes = b.column("hashes")
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), b.num_rows], strict=True):
            if lo == hi:
                continue
            if key != (mine := tuple(keys[lo].tolist())):
                yield from flush()
                key, nodes, known, sets = mine, [], [], []
            nodes += b.column("node")[lo:hi].to_pylist()
            known += b.column("known")[lo:hi].to_pylist()
            sets += [hashes[i].values.to_numpy().view(np.uint64) for i in range(lo, hi)]
    yield from flush()


def _verified(rows: DataFrame) -> DataFrame:
    keys = ["family", "slice", "rest"]
    dealt = rows.select(*(F.col(k).cast("long").alias(k) for k in keys), "node", "known", "hashes")
    dealt = dealt.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_families, "a long, b long")


def _rooted(nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``nodes`` (``node, ...``) with the root of each one's group."""
    roots = components(links).select(F.col("node"), F.col("root").alias(name))
    return nodes.join(roots, "node", "left").withColumn(name, F.coalesce(name, "node"))


def verified_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect exactly what the pairs of a family at ``SIMILARITY`` connect. ``members``: ``node, size, family``."""
    weight = members.groupBy("family").agg(F.sum("size").alias("w")).select("family", F.ceil(F.col("w") / SLICE).cast("long").alias("slices"))
    weight = materialize(weight, "weights")
    wide = materialize(weight.filter("slices > 1"), "wide")  # SLICE shingles each, at least
    rows = members.join(wide, "family", "left").withColumn("slices", F.coalesce("slices", F.lit(1).cast("long")))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")))
    rows = materialize(rows.join(sets, "node"), "families")
    one = rows.select("family", "slice", F.lit(0).alias("rest"), "node", F.col("node").alias("known"), "hashes")
    if wide.isEmpty():
        return materialize(_verified(one), "links")
    many = rows.filter("slices > 1")
    # the smallest nodes of each slice, then of the family: no aggregate holds more than ANCHORS a slice
    low = Window.partitionBy("family", "slice").orderBy("node")
    few = many.select("family", "slice", "slices", "node").withColumn("at", F.row_number().over(low)).filter(F.col("at") <= F.greatest(F.lit(1), F.lit(ANCHORS) / F.col("slices")))
    first = few.filter(F.col("slice") < ANCHORS).select("slices", "node")
    anchors = first.join(rows.drop("slices", "slice"), "node")
    anchors = anchors.select("family", F.explode(F.expr("sequence(0L, slices - 1)")).alias("slice"), F.lit(0).alias("rest"), "node", F.col("node").alias("known"), "hashes")
    links = materialize(_verified(one.unionByName(anchors)), "links")
    # what the slices have left apart: all but the largest group of each family meets every slice
    placed = materialize(_rooted(many.select("node", "family", "size"), links, "known"), "placed")
    groups = placed.groupBy("family", "known").agg(F.count("*").alias("n"))
    main = groups.groupBy("family").agg(F.max_by("known", F.struct("n", -F.col("known"))).alias("main"))
    apart = materialize(placed.join(main, "family").filter("known <> main").select("node", "family", "known", "size"), "apart")
    rests = apart.groupBy("family").agg(F.ceil(F.sum("size") / SLICE).cast("long").alias("rests")).join(wide, "family")
    rests = materialize(rests, "rests")
    held = placed.select("node", "known").join(many, "node")
    slices = held.join(rests.select("family", "rests"), "family")
    slices = slices.select("family", "slice", F.explode(F.expr("sequence(0L, rests - 1)")).alias("rest"), "node", "known", "hashes")
    rest = apart.select("node").join(held, "node").drop("slice", "slices").join(rests, "family").withColumn("rest", F.pmod(F.xxhash64("node", F.lit(2)), F.col("rests")))
    rest = rest.select("family", F.explode(F.expr("sequence(0L, slices - 1)")).alias("slice"), "rest", "node", "known", "hashes")
    return links.unionByName(materialize(_verified(slices.unionByName(rest)), "links"))


def similar_groups(docs: DataFrame) -> DataFrame:
    """``UID, doc_id, root`` of each row: rows that chains of near copies connect share a root."""
    slim = with_uid(as_scan(docs)).select(UID, F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = f"{UID} long, doc_id string, digest string, size long, " + ", ".join(f"{w} long" for w in W)
    rows = materialize(slim.mapInArrow(_signatures, schema), "signatures")
    nodes = rows.groupBy("digest").agg(F.min(UID).alias("node"), F.count("*").alias(P + "n"), *(F.any_value(c).alias(c) for c in ("size", *W)))
    nodes = materialize(nodes, "nodes")  # rows with equal sets are one node
    full = nodes.filter("size > 0").select("node", *W)
    kinds = "turn int, value long, node long, " + ", ".join(f"{w} long" for w in W)
    dealt = materialize(full.mapInArrow(_deal(tables(nodes.count())), kinds), "tables")
    proposed = materialize(link_rows(dealt, ["turn", "value"], RADIUS, WORDS), "proposed")
    families = materialize(components(proposed).withColumnRenamed("root", "family"), "families")
    members = materialize(families.join(nodes.select("node", "size"), "node"), "members")
    texts = slim.select(F.col(UID).alias("node"), "text").join(members.select("node").hint("shuffle_hash"), "node", "left_semi")
    sets = materialize(texts.mapInArrow(_sets, "node long, hashes array<long>"), "sets")
    roots = components(verified_links(members, sets)).withColumnRenamed("node", "_node")
    named = nodes.join(roots, F.col("node") == F.col("_node"), "left").select("digest", P + "n", F.coalesce("root", "node").alias("root"))
    return hot_join(rows.select(UID, "doc_id", "digest"), materialize(named, "named"), ["digest"], P + "n", rows.count()).select(UID, "doc_id", "root")


def drop_similar(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest ``doc_id``."""
    docs = as_scan(docs)
    found = materialize(similar_groups(docs), "groups")
    number = F.expr("try_cast(doc_id as bigint)")  # ids of other kinds stand in the order of their texts
    best = F.min(F.struct(F.col("doc_id").isNull(), number.isNull(), number, F.col("doc_id"), F.col(UID).alias("uid")))
    stays = found.groupBy("root").agg(best.alias("best")).select(F.col("best.uid").alias(UID))
    return keep_rows(with_uid(docs), stays)
