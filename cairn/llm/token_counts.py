"""Token counts as delta-maintained rollups.

A store is a folder of batches. A batch holds signed, pre-aggregated changes by source, language
and tokenizer version: an insert adds a document and its tokens, a delete takes them away, a
revision adds the difference of the counts. Totals are the sums over all batches, so they never
need the documents again. A batch is committed under its id by one rename-free directory with
Spark's success marker: committing an id again changes nothing, and a half-written one is
overwritten, so a retried job never counts twice. ``compact`` folds batches into one.

Counting: ``words`` counts runs of non-space characters in the JVM; ``Bpe`` counts the tokens of a
public byte-level vocabulary. A text is cut where a non-space is followed by a space; no token
of the vocabulary's split pattern crosses such a place, so each distinct piece is encoded once.

Defined cases: null text counts as the empty text (a document with 0 tokens); null source and
language are groups of their own; repeated rows are separate documents; a very long text is counted whole; extra
columns are kept by ``count_tokens`` and ignored by ``deltas``; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, work_path

TOKENIZERS = "/opt/tokenizers"
#: Split pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 500_000
WORDS = "words-1"
KEYS = ["source", "lang", "tokenizer"]

_PIECE = re.compile(r"\s*\S+|\s+")
_ODD = re.compile(r"[\x1c-\x1f]")  # space to Python but not to the split pattern


class Bpe:
    """Counts tokens of a rank file; the file is read where the object is made, workers get its contents."""

    def __init__(self, path: str):
        self.name = os.path.basename(path).split(".")[0]
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding, self._pieces = None, None

    def __getstate__(self):
        return {"name": self.name, "ranks": self.ranks, "_encoding": None, "_pieces": None}

    def count(self, text: str | None) -> int:
        if self._encoding is None:
            import tiktoken

            self._encoding = tiktoken.Encoding(self.name, pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
            self._pieces = _Pieces(self._encoding.encode_ordinary)
        if not text:
            return 0
        if _ODD.search(text):
            return len(self._encoding.encode_ordinary(text))
        return sum(map(self._pieces.__getitem__, _PIECE.findall(text)))


class _Pieces(dict):
    """Tokens of each piece; a missing one is encoded once and kept while there is room."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(piece) < 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = n
        return n


def _count(bpe: Bpe, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.fromiter((bpe.count(t.as_py()) for t in b.column("text")), np.int64, b.num_rows)
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(n)], [*names, "tokens"])

    return run


def count_tokens(rows: DataFrame, tokenizer: Bpe | None = None) -> DataFrame:
    """``rows`` (with ``text``) with ``tokens`` and ``tokenizer`` in place of the text; ``None`` counts words."""
    names = [c for c in rows.columns if c != "text"]
    if tokenizer is None:
        tokens = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
        return rows.select(*names, tokens.alias("tokens"), F.lit(WORDS).alias("tokenizer"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names), "tokens long"])
    return rows.mapInArrow(_count(tokenizer, names), schema).withColumn("tokenizer", F.lit(tokenizer.name))


def deltas(after: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    """Signed changes from counted rows as they are now (``after``) and as they were (``before``).

    Inserts have only ``after``, deletes only ``before``; a revision has both, and may change source or language too."""
    signed = [x.select("source", "lang", "tokenizer", F.lit(s).cast("long").alias("docs"), (F.col("tokens") * s).alias("tokens")) for x, s in ((after, 1), (before, -1)) if x is not None]
    rows = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def commit(store: str, batch: str, changes: DataFrame) -> bool:
    """Commit ``changes`` as ``batch``; False if that batch is in the store already (then nothing is computed)."""
    if not re.fullmatch(r"[\w.-]+", batch):
        raise ValueError(f"not a batch id: {batch!r}")
    path = f"{store}/batch={batch}"
    if _exists(changes.sparkSession, f"{path}/_SUCCESS"):
        return False
    changes.select(*KEYS, "docs", "tokens").write.mode("overwrite").parquet(path)
    return True


def batches(spark, store: str) -> list[str]:
    """Ids of the committed batches."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch=") and _exists(spark, f"{store}/{n}/_SUCCESS"))


def totals(spark, store: str) -> DataFrame:
    """``source, lang, tokenizer, docs, tokens`` over all committed batches; groups that were emptied are gone."""
    found = batches(spark, store)
    schema = "source string, lang string, tokenizer string, docs long, tokens long"
    if not found:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{store}/batch={b}" for b in found])
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")


def compact(spark, store: str, into: str, batch: str) -> None:
    """Write the totals of ``store`` as the single batch of a new store; the old one stays valid until its owner drops it."""
    commit(into, batch, totals(spark, store))


def op7_token_counts(spark, sf_dir: str, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """Load all documents under two tokenizer versions, revise those of low quality (repeated spaces and
    blank lines collapsed), delete the toxic ones, with a batch sent twice; the totals that remain."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    low = materialize(labels.filter("quality = 0").select("doc_id"), "low")
    toxic = materialize(labels.filter("toxic = 1").select("doc_id"), "toxic")
    store = work_path(spark, "counts")
    for version in (None, Bpe(tokenizer)):
        name = version.name if version is not None else WORDS
        revised = docs.join(low, "doc_id", "left_semi").withColumn("text", F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
        old = materialize(count_tokens(docs, version), "counted")
        new = materialize(count_tokens(revised, version), "recounted")  # only what is revised is counted again
        commit(store, f"load-{name}", deltas(after=old))
        commit(store, f"revise-{name}", deltas(after=new, before=old.join(low, "doc_id", "left_semi")))
        state = old.join(low, "doc_id", "left_anti").unionByName(new)
        gone = deltas(before=state.join(toxic, "doc_id", "left_semi"))
        for _ in range(2):  # the second commit of the same id changes nothing
            commit(store, f"delete-{name}", gone)
    return totals(spark, store)
