"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints at three or fewer differing bits agree wholly in one of four 16-bit blocks, so
each distinct fingerprint goes to four buckets. A task sorts the fingerprints of its buckets by
Gray rank (neighbours in that order differ in few bits), groups eight consecutive ones under a
node that keeps what its members share as a masked bit pattern, groups eight nodes again, and
so on. The self-join walks pairs of nodes from the top: the differences that two patterns
show on bits that both share are a lower bound for all their members, so whole groups fall
away; pairs of groups that are known to be one component are skipped too, which keeps a group
of thousands of near copies from being compared pair by pair. A bucket with over ``BUCKET_ROWS``
fingerprints is dealt to tasks in pairs of slices, without losing a pair.

A task returns at most one link per fingerprint (a spanning forest); ``components`` joins them. The index takes
fingerprints of any number of 64-bit words; ``near_copies`` uses it for wider ones and larger radii.

Defined cases: null, empty and blank texts have fingerprint zero, linked like any other; a null
``doc_id`` gets a component like other rows but never names one unless all ids of it are null;
repeated rows share a fingerprint; the shingles of a very long text are hashed in pieces; extra columns are
ignored (kept by ``drop_near_copies``, whatever their names); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UID, P, as_scan, hot_join, keep_rows, materialize, partitions, with_uid
from .components import components

SEED = 42
RADIUS = 3
BLOCKS = 4
FAN = 8
CHUNK = 16_384
BUCKET_ROWS = 100_000
TASK_ROWS = 200_000
SHINGLES_AT_ONCE = 1_000_000


def majority(hashes: np.ndarray) -> np.ndarray:
    """The words of ``hashes`` (rows of 64-bit words) in which a bit is 1 if it is 1 in over half the rows."""
    n, k = hashes.shape
    return _majority(_ones(np.ascontiguousarray(hashes)), n, k)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How often each bit is 1. 255 rows at a time are summed in bytes, eight of them in one word."""
    n, k = hashes.shape
    ones = np.zeros(64 * k, np.int64)
    for lo in range(0, n, 255):
        part = np.unpackbits(hashes[lo : lo + 255].view(np.uint8).reshape(-1, 8 * k), axis=1)
        ones += part.view(np.uint64).sum(axis=0).view(np.uint8)
    return ones


def _majority(ones: np.ndarray, total: int, k: int) -> np.ndarray:
    return np.packbits(ones * 2 > total).view("<u8")[:k] if total else np.zeros(k, np.uint64)


def fingerprint(text: str | None, words_in_shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a whole text."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and only [\x20\x09-\x0D] separates
    if not words:
        return 0
    k = min(words_in_shingle, len(words))
    shingles = map(b" ".join, zip(*(islice(words, i, None) for i in range(k)), strict=False))
    left = total = len(words) - k + 1
    ones = np.zeros(64, np.int64)
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    while left:
        n = min(left, SHINGLES_AT_ONCE)
        ones += _ones(np.fromiter(hashes, np.uint64, n).reshape(n, 1))
        left -= n
    return int(_majority(ones, total, 1)[0])


def _fingerprints(words_in_shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words_in_shingle) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(UID), b.column("doc_id"), pa.array(fps.view(np.int64))], [UID, "doc_id", "fp"])

    return run


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence; codes of several words (columns, the first the highest) give ranks of as many."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    if x.ndim == 2:  # a word is mirrored where the words above it have an odd number of ones
        odd = np.zeros(len(x), np.uint64)
        for k in range(1, x.shape[1]):
            odd = x[:, k - 1] & np.uint64(1)
            x[:, k] ^= np.uint64(0) - odd
    return x


class Forest:
    """Union-find on arrays: the smallest index of a component is its label."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> bool:
        changed = False
        while True:
            a, b = self.up[i], self.up[j]
            apart = a != b
            if not apart.any():
                return changed
            changed = True
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while True:
                over = self.up[self.up]
                if np.array_equal(over, self.up):
                    break
                self.up = over


class GrayIndex:
    """Levels of nodes over fingerprints sorted by (bucket, Gray rank); level 0 are the fingerprints (rows of words)."""

    def __init__(self, bucket: np.ndarray, fp: np.ndarray):
        self.bits, self.mask, self.first = [fp], [np.full(fp.shape, ~np.uint64(0))], []
        start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        size = np.diff(np.append(start, len(fp)))
        while True:
            groups = -(-size // FAN)
            of = np.repeat(np.arange(len(size)), groups)
            begin = np.cumsum(groups) - groups
            first = np.repeat(start, groups) + (np.arange(len(of)) - begin[of]) * FAN
            below, mask = self.bits[-1], self.mask[-1]
            ones, zeros = np.bitwise_and.reduceat(below & mask, first, axis=0), np.bitwise_and.reduceat(~below & mask, first, axis=0)
            self.bits.append(ones)
            self.mask.append(ones | zeros)
            self.first.append(np.append(first, len(below)))
            start, size = begin, groups
            if (groups == 1).all():
                return

    def spread(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of children below pairs of nodes of ``level``; of a node with itself each pair once."""
        f = self.first[level - 1]
        na, nb = f[a + 1] - f[a], f[b + 1] - f[b]
        n = na * nb
        of = np.repeat(np.arange(len(a)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        i, j = f[a][of] + k // nb[of], f[b][of] + k % nb[of]
        ok = (a[of] != b[of]) | (i <= j)
        return i[ok], j[ok]

    def join(self, radius: int, forest: Forest | None = None, agree: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, chunk: int = CHUNK) -> Forest:
        """Link all fingerprints of a bucket that differ in ``radius`` bits or fewer and that ``agree``, if given, accepts;
        pairs that ``forest`` or earlier links connect are skipped."""
        n, top = len(self.bits[0]), len(self.bits) - 1
        forest = forest or Forest(n)
        low = high = None

        def refresh() -> None:
            nonlocal low, high
            low, high = [forest.up], [forest.up]
            for f in self.first:
                low.append(np.minimum.reduceat(low[-1], f[:-1]))
                high.append(np.maximum.reduceat(high[-1], f[:-1]))

        refresh()
        tops = np.arange(len(self.bits[top]))
        stack = [(top, tops[i : i + chunk], tops[i : i + chunk]) for i in range(0, len(tops), chunk)]
        while stack:
            level, a, b = stack.pop()
            one = (low[level][a] == high[level][a]) & (low[level][b] == high[level][b]) & (low[level][a] == low[level][b])
            a, b = a[~one], b[~one]
            apart = np.bitwise_count((self.bits[level][a] ^ self.bits[level][b]) & self.mask[level][a] & self.mask[level][b])
            near = apart.sum(axis=1, dtype=np.int32) <= radius
            a, b = a[near], b[near]
            if not len(a):
                continue
            if level == 0:
                if agree is not None:
                    good = agree(a, b)
                    a, b = a[good], b[good]
                if forest.link(a, b):
                    refresh()
                continue
            i, j = self.spread(level, a, b)
            apart = np.flatnonzero(i != j)
            same = np.flatnonzero(i == j) if level > 1 else apart[:0]
            step = chunk * (FAN if level == 1 else 1)
            for part in (apart, same):  # the last pushed is walked first: groups with themselves
                for k in range(0, len(part), step):
                    p = part[k : k + step]
                    stack.append((level - 1, i[p], j[p]))
        return forest


def link_buckets(radius: int, words: int = 1):
    """Rows ``bucket, turn, node, w0, w1, ...`` sorted by bucket to ``a, b``: a spanning forest of the links between nodes in them."""
    names = ["bucket", "turn", "node", *(f"w{k}" for k in range(words))]

    def links(bucket: np.ndarray, turn: np.ndarray, node: np.ndarray, *w: np.ndarray) -> pa.RecordBatch | None:
        fp = np.stack([x.view(np.uint64) for x in w], axis=1)
        turn = turn.astype(np.uint64)
        turned = fp if words > 1 else (fp << turn[:, None]) | (fp >> ((np.uint64(64) - turn) % np.uint64(64))[:, None] * (turn > 0)[:, None])
        order = np.lexsort((*gray_rank(turned).T[::-1], bucket))
        fp, bucket, node = fp[order], bucket[order], node[order]
        up = GrayIndex(bucket, fp).join(radius).up
        tied = np.flatnonzero(up != np.arange(len(up)))
        return pa.record_batch([pa.array(node[tied]), pa.array(node[up[tied]])], ["a", "b"]) if len(tied) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, last = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(c).to_numpy() for c in names]
            if rows >= TASK_ROWS:
                cut = int(np.argmax(new[0] != last)) if (new[0] != last).any() else len(new[0])
                held.append([x[:cut] for x in new])
                new = [x[cut:] for x in new]
                if len(new[0]):
                    if (got := links(*(np.concatenate(x) for x in zip(*held, strict=True)))) is not None:
                        yield got
                    held, rows = [], 0
            if len(new[0]):
                held.append(new)
                rows += len(new[0])
                last = new[0][-1]
        if held and (got := links(*(np.concatenate(x) for x in zip(*held, strict=True)))) is not None:
            yield got

    return run


def link_rows(rows: DataFrame, keys: list[str], radius: int, words: int = 1) -> DataFrame:
    """Links ``a, b`` between the nodes of rows with equal ``keys``. ``rows`` is materialised: ``turn, node, w0, w1, ...`` and the keys."""
    large = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > BUCKET_ROWS)
    large = large.select(*keys, F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("slices"))
    rows = rows.join(large, keys, "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices"))).withColumn("other", F.explode(F.expr("sequence(0, slices - 1)")))
    bucket = F.xxhash64(*keys, F.least("own", "other"), F.greatest("own", "other"))  # a chance clash only adds comparisons
    rows = rows.select(bucket.alias("bucket"), F.col("turn").cast("long").alias("turn"), "node", *(f"w{k}" for k in range(words)))
    rows = rows.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(link_buckets(radius, words), "a long, b long")


def link_fingerprints(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` that connect exactly what the pairs of distinct ``fp`` at ``radius`` or fewer bits connect."""
    if not 0 <= radius < BLOCKS:
        raise ValueError(f"blocks guarantee a radius of 0 to {BLOCKS - 1}")
    width = 64 // BLOCKS
    block = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    rows = fps.select("fp", block.alias("k"))
    value = F.expr(f"shiftrightunsigned(fp, {64 - width} - k * {width}) & {2**width - 1}L")
    rows = rows.select((F.col("k") * width).alias("turn"), value.alias("value"), F.col("fp").alias("node"), F.col("fp").alias("w0"))
    return link_rows(materialize(rows, "blocks"), ["turn", "value"], radius)


def near_groups(docs: DataFrame, words_in_shingle: int = 3, radius: int = RADIUS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``UID, doc_id, fp, component_id`` of each row: its fingerprint and the smallest ``doc_id`` it reaches."""
    slim = with_uid(as_scan(docs)).select(UID, F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = materialize(slim.mapInArrow(_fingerprints(words_in_shingle), f"{UID} long, doc_id long, fp long"), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.count("*").alias(P + "n"), F.min("doc_id").alias(P + "low")), "distinct")
    roots = components(link_fingerprints(fps, radius)).withColumnRenamed("node", "fp")
    rooted = materialize(fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    named = rooted.groupBy("root").agg(F.min(P + "low").alias("component_id"), F.count("*").alias(P + "fps"))
    by_fp = materialize(hot_join(rooted, named, ["root"], P + "fps", rooted.count()).select("fp", P + "n", "component_id"), "named")
    return hot_join(rows, by_fp, ["fp"], P + "n", rows.count()).select(UID, "doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, words_in_shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest ``doc_id``."""
    docs = as_scan(docs)
    found = materialize(near_groups(docs, words_in_shingle, radius), "groups")
    best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(UID).alias("uid")))
    stays = found.groupBy("component_id").agg(best.alias("best")).select(F.col("best.uid").alias(UID))
    return keep_rows(with_uid(docs), stays)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
