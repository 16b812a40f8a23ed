"""Line dedup over range-partitioned line hashes.

The mapper turns a text into hashes of its long line keys, never shipping text. The hashes
are range-partitioned by (hash, document) and sorted by (hash, document, row, position), so a
task streams each hash's documents in order and knows at once which occurrences lose: once
enough documents are seen, all but the last document's. A hash that spreads over several
partitions (one line in a third of all documents) is settled from the partitions' summaries,
of which there are two a partition at most. What comes back is one zlib-packed keep bitmap
per document that loses lines.

Defined cases: null or empty text is one empty line; rows with a null ``doc_id`` hold no line
and lose none; repeated rows of one ``doc_id`` count as one document and lose the same lines;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UID, P, as_scan, materialize, partitions, with_uid

BLANK = " \t\n\x0b\x0c\r"

_LINES = f"h1 long, h2 long, doc_id long, {UID} long, pos int"
_FOUND = f"kind int, h1 long, h2 long, doc_id long, {UID} long, pos int"


def line_hashes(min_chars: int):
    """Mapper: (row id, doc_id, text) to (hash, document, row, position) of each line whose key is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                lines = pc.split_pattern(pc.fill_null(part.column("text"), "").cast(pa.large_string()), "\n")
                flat = pc.list_flatten(lines)
                parent = pc.list_parent_indices(lines).to_numpy()
                first = np.asarray(lines.offsets)[:-1] - np.asarray(lines.offsets)[0]
                keys = pc.ascii_lower(pc.ascii_trim(flat, BLANK))
                has_id = part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                hit = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False) & has_id[parent])
                if not len(hit):
                    continue
                blob = b"".join(hashlib.blake2b(k.encode(), digest_size=16).digest() for k in keys.take(pa.array(hit)).to_pylist())
                h = np.frombuffer(blob, dtype="<i8").reshape(-1, 2)
                owner = parent[hit]
                ids = pc.fill_null(part.column("doc_id"), 0).cast(pa.int64()).to_numpy()[owner]
                uid = part.column(UID).to_numpy()[owner]
                yield pa.record_batch([pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(ids), pa.array(uid), pa.array((hit - first[owner]).astype("int32"))], ["h1", "h2", "doc_id", UID, "pos"])

    return run


def stream_runs(min_docs: int):
    """One range partition: (hash, document, row, position) in order to drops (kind 0), rows that
    need the neighbours' word (kind 1) and summaries of the first and the last hash (kind 2: ``pos`` documents, largest ``doc_id``)."""

    def out(kind: int, rows: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(rows), kind, "int32")), *(pa.array(rows[:, k].copy()) for k in range(4)), pa.array(rows[:, 4].astype("int32"))], ["kind", "h1", "h2", "doc_id", UID, "pos"])

    def settle(rows: np.ndarray, n_docs: np.ndarray, last_doc: np.ndarray, of: np.ndarray) -> np.ndarray:
        return rows[(n_docs[of] >= min_docs) & (rows[:, 2] < last_doc[of])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None  # the partition's first hash: another partition may hold earlier documents of it
        first_docs, first_last = 0, None
        held = np.zeros((0, 5), "int64")  # rows of the current hash that are not settled
        held_docs = 0  # documents of the current hash before those in held
        for b in batches:
            if not b.num_rows:
                continue
            new = np.column_stack([b.column(k).to_numpy().astype("int64") for k in range(5)])
            if first is None:
                first = (new[0, 0], new[0, 1])
            if first_last is None or len(held) == 0:
                mine = (new[:, 0] == first[0]) & (new[:, 1] == first[1])
                if mine.any():
                    n = int(np.argmin(mine)) if not mine.all() else len(new)
                    docs = new[:n, 2]
                    first_docs += int((np.diff(docs) != 0).sum()) + int(first_last is None or docs[0] != first_last)
                    first_last = int(docs[-1])
                    yield out(1, new[:n])
                    new = new[n:]
                    if not len(new):
                        continue
            rows = np.concatenate([held, new]) if len(held) else new
            change = np.flatnonzero((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)) + 1
            starts = np.concatenate([[0], change])
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
            new_doc = np.ones(len(rows), bool)
            new_doc[1:] = (np.diff(rows[:, 2]) != 0) | (np.diff(of) != 0)
            n_docs = np.bincount(of, weights=new_doc, minlength=len(starts)).astype("int64")
            n_docs[0] += held_docs
            last_doc = rows[np.append(starts[1:], len(rows)) - 1, 2]
            tail = starts[-1]
            if tail:
                lost = settle(rows[:tail], n_docs, last_doc, of[:tail])
                if len(lost):
                    yield out(0, lost)
                held_docs = 0
            held = rows[tail:]
            if n_docs[-1] >= min_docs:  # more documents can only be larger: all but the last one's rows are lost
                more = held[:, 2] < last_doc[-1]
                if more.any():
                    yield out(0, held[more])
                    held = held[~more]
                held_docs = int(n_docs[-1]) - 1
        if first is not None:
            yield out(2, np.array([[first[0], first[1], first_last, 0, first_docs]], "int64"))
        if len(held):
            yield out(1, held)
            n = held_docs + len(np.unique(held[:, 2]))
            yield out(2, np.array([[held[0, 0], held[0, 1], held[-1, 2], 0, n]], "int64"))

    return run


def pack_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row id, lost positions) to (row id, zlib-packed bitmap with a 0 for each lost line, up to the last lost one)."""
    for b in batches:
        maps = []
        for pos in b.column("lost").to_pylist():
            keep = np.ones((max(pos) // 8 + 1) * 8, bool)
            keep[pos] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        yield pa.record_batch([b.column(UID), pa.array(maps, pa.binary())], [UID, "keep_bitmap"])


def unpack_bitmap(packed: bytes, n_lines: int) -> np.ndarray:
    """The keep flags of a document's lines; lines beyond the bitmap stay."""
    keep = np.ones(n_lines, bool)
    if packed is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), "uint8"))[:n_lines].astype(bool)
        keep[: len(bits)] = bits
    return keep


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``UID, keep_bitmap`` of each row that loses lines. ``docs``: doc_id, text."""
    spark = docs.sparkSession
    slim = with_uid(as_scan(docs)).select(UID, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = materialize(slim.mapInArrow(line_hashes(min_chars), _LINES), "lines")
    order = ["h1", "h2", "doc_id"]
    ranged = lines.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order, UID, "pos")
    found = materialize(ranged.mapInArrow(stream_runs(min_docs), _FOUND), "runs")
    ends = found.filter("kind = 2").groupBy("h1", "h2").agg(F.sum("pos").alias(P + "docs"), F.max("doc_id").alias(P + "last"))
    late = found.filter("kind = 1").join(F.broadcast(ends), ["h1", "h2"]).filter((F.col(P + "docs") >= min_docs) & (F.col("doc_id") < F.col(P + "last")))
    lost = found.filter("kind = 0").select(UID, "pos").unionByName(late.select(UID, "pos"))
    return lost.groupBy(UID).agg(F.collect_list("pos").alias("lost")).mapInArrow(pack_bitmaps, f"{UID} long, keep_bitmap binary")


def _kept_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lines_n, dropped, digest = [], [], []
        for text, packed in zip(b.column("text"), b.column("keep_bitmap"), strict=True):
            text = text.as_py() or ""
            n = text.count("\n") + 1
            lost = 0
            if (packed := packed.as_py()) is not None:
                keep = unpack_bitmap(packed, n)
                lost = int(n - keep.sum())
                text = "\n".join(x for x, k in zip(text.split("\n"), keep.tolist(), strict=True) if k)
            lines_n.append(n)
            dropped.append(lost)
            digest.append(hashlib.sha256(text.encode()).hexdigest())
        yield pa.record_batch([b.column("doc_id"), pa.array(lines_n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    maps = keep_bitmaps(docs)
    both = with_uid(docs).join(maps.hint("shuffle_hash"), UID, "left").select("doc_id", "text", "keep_bitmap")
    return both.mapInArrow(_kept_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
f AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < g.last, false) AS lost
  FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
