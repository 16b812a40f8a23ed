"""The corpus pipeline: five filters over ``documents``, each written as Parquet and read again as the next one's input.

Each stage applies one operator of ``cairn.llm`` to all rows that its predecessor kept, and all but the last return the columns of
``documents``. Rows are named by their file and their place in it, so a lost executor or another split of the files changes no decision.

Defined cases, for every stage: a null ``text`` is a text without words (language ID rejects it with all that have no letter); null sources and
ids are kept as they are and share the rules of their operators; repeated rows are separate rows until a dedup stage leaves one of them; ties go
to the smallest ``doc_id``, then to the first row; very long texts are read whole; extra columns pass through, whatever their names (the mix
names its own columns around them); empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import materialize
from cairn.llm.decontam import drop_leaks
from cairn.llm.exact_dedup import drop_copies
from cairn.llm.langid import keep_known
from cairn.llm.mixing import apply_mix
from cairn.llm.near_copies import drop_similar


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those that language ID rejects go."""
    return keep_known(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash over five-word shingles in the Gray index, links verified at a similarity of 0.8 or more."""
    return drop_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs with at most a fifth of its words edited."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as it is taken."""
    return apply_mix(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: Language models and CGK walks have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
