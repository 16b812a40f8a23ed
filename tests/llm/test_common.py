"""Row ids that name the same row in every evaluation, and scans of what is no scan."""

import pytest
from pyspark.sql import functions as F

from cairn.llm.common import UID, as_scan, with_uid
from cairn.llm.decontam import drop_leaks
from cairn.llm.exact_dedup import drop_copies
from cairn.llm.line_dedup import op8_line_dedup
from cairn.llm.mixing import apply_mix
from cairn.llm.near_copies import drop_similar
from cairn.llm.simhash import drop_near_copies


@pytest.fixture(scope="module")
def docs_path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows") / "we ird é%20=x" / "documents.parquet")
    texts = ["w" + " w".join(str(k) for k in range(i % 50, i % 50 + 8)) + "\nthis is a line of more than forty characters that many have" for i in range(400)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(12).write.parquet(path)
    return path


def split(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", size)


def ids(spark, path):
    return {(r[UID], r.doc_id) for r in with_uid(spark.read.parquet(path)).select(UID, "doc_id").collect()}


def test_row_ids_do_not_depend_on_splits(spark, docs_path):
    split(spark, "128m")
    first = ids(spark, docs_path)
    split(spark, "1k")
    try:
        assert spark.read.parquet(docs_path).rdd.getNumPartitions() > 4
        assert ids(spark, docs_path) == first and len({u for u, _ in first}) == 400
    finally:
        split(spark, "128m")


@pytest.mark.parametrize("drop", [drop_copies, drop_near_copies, drop_similar, apply_mix, lambda d: drop_leaks(d, d.sparkSession.createDataFrame([(1, "w7 w8 w9 w10")], "item_id long, text string"))])
def test_decisions_hold_when_the_splits_change(spark, docs_path, drop):
    docs = spark.read.parquet(docs_path)
    split(spark, "128m")
    plan = drop(docs)  # decided under one set of splits
    want = sorted(map(str, plan.collect()))
    again = drop(spark.read.parquet(docs_path))
    split(spark, "1k")
    try:
        assert sorted(map(str, again.collect())) == want
    finally:
        split(spark, "128m")


def test_line_dedup_holds_when_the_splits_change(spark, docs_path):
    folder = docs_path.rsplit("/", 1)[0]
    split(spark, "128m")
    want = sorted(map(str, op8_line_dedup(spark, folder).collect()))
    plan = op8_line_dedup(spark, folder)
    split(spark, "1k")
    try:
        assert sorted(map(str, plan.collect())) == want
    finally:
        split(spark, "128m")


def test_rows_without_a_place_are_written_first(spark, docs_path):
    docs = spark.read.parquet(docs_path)
    assert as_scan(docs) is docs
    for df in (docs.unionByName(docs), spark.range(5).withColumnRenamed("id", "doc_id"), docs.groupBy("source").count()):
        scan = as_scan(df)
        assert with_uid(scan).select(UID).distinct().count() == df.count()
    assert as_scan(docs.withColumn("_metadata", F.lit(1))).count() == 400


def test_mix_columns_make_way_for_the_documents_own(spark, docs_path):
    docs = spark.read.parquet(docs_path).withColumns({"mix_size": F.lit("mine"), "MIX_COPY": F.lit("too")})
    out = apply_mix(docs)
    assert out.columns == [*docs.columns, "mix_size_2", "mix_target", "mix_copy_2"]
    assert {(r.mix_size, r.MIX_COPY) for r in out.collect()} == {("mine", "too")}
