"""Shared pieces of the training-data operators: work tables, row ids, skew-safe joins.

Work tables are Parquet under the folder that ``spark.checkpoint.dir`` names, so that a
lost executor never takes the only copy of an intermediate with it.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than one row in this many, or more than ``HOT_ROWS`` rows.
HOT_SHARE = 1024
HOT_ROWS = 1_000_000
#: Prefix of every internal column, so that extra columns of the caller cannot clash.
P = "__c_"
UID = P + "uid"

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master may get one of its own."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="cairn-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def work_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/cairn/{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, path))
    return path


def _sweep() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone: the folder's owner sweeps it
            return


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: the lineage is cut, nothing is recomputed."""
    spark = df.sparkSession
    path = work_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def as_scan(df: DataFrame) -> DataFrame:
    """``df`` itself if it is a scan of files (with filters and projections at most), else a written copy of it."""
    if df.inputFiles():
        try:
            df.select(df.metadataColumn("_metadata")["row_index"])
            return df
        except AnalysisException:  # files below a join, union or aggregate: rows have no place of their own
            pass
    return materialize(df, "rows")


_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):/+"


def _file_code(paths: list[str]) -> tuple[str, int]:
    """(salt, bits) under which the salted hashes of all paths differ in their lowest ``bits`` bits."""
    bits = max(16, 2 * (max(1, len(paths)) - 1).bit_length())
    for salt in range(1000):
        if len({xxhash.xxh64_intdigest(f"{salt}{p}", 42) & (2**bits - 1) for p in paths}) == len(paths):
            return str(salt), bits
    raise ValueError(f"no code for {len(paths)} files")


def with_uid(scan: DataFrame) -> DataFrame:
    """Add a row id to a scan of files (``as_scan``): a code of the row's file and its place in that file.

    It names the same row in every evaluation, however the scan is split into tasks. The code is a salted hash of the
    path that the driver has found to be free of clashes among the files listed, so nothing is joined or broadcast."""
    paths = sorted({re.sub(_SCHEME, r"\1:/", p) for p in scan.inputFiles()})
    salt, bits = _file_code(paths)
    meta = scan.metadataColumn("_metadata")
    code = F.xxhash64(F.concat(F.lit(salt), F.regexp_replace(meta["file_path"], _SCHEME, "$1:/"))).bitwiseAND(F.lit(2**bits - 1))
    place = meta["row_index"]
    fits = F.when(place < F.lit(2 ** (63 - bits)), place).otherwise(F.raise_error(F.lit("a file has too many rows for a row id")).cast("long"))
    return scan.withColumn(UID, F.shiftleft(code, 63 - bits).bitwiseOR(fits))


def keep_rows(docs: DataFrame, uids: DataFrame) -> DataFrame:
    """Rows of ``docs`` (with ``UID``) whose id is in ``uids``. Only ids are built into the hash side, texts are never sorted."""
    return docs.join(uids.select(UID).hint("shuffle_hash"), UID, "left_semi").drop(UID)


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Join a materialised ``left`` to ``right``, which has one row per key and the key's row count in ``count``.

    Keys with over ``total / HOT_SHARE`` or over ``HOT_ROWS`` rows are broadcast (by the pigeonhole at most
    ``HOT_SHARE`` or ``total / HOT_ROWS`` of them), so no task gets such a key's rows; the rest is shuffled, and
    no key of it has more than ``HOT_ROWS`` rows.
    """
    bound = min(max(10_000, total // HOT_SHARE), HOT_ROWS)
    hot = right.filter(F.col(count) > bound)
    cold = right.filter(F.col(count) <= bound)
    by_hot = left.join(F.broadcast(hot), keys, "inner")
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return by_hot.unionByName(rest)
