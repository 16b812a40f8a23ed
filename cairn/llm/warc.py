"""WARC archives of pages and their Merkle fixity audit.

Pages become WARC resource records. A shard is one WARC: the records of ``SHARD_PAGES`` consecutive page ids in order, so that a
record's range is where it stands in the shard's bytes. A leaf hashes a record together with its ordered range, a node the
hashes of ``FAN`` children in order, and a top node stands for all its bytes and their order. The levels of a tree are stored
tables. A replica is the shards' bytes beside the lengths of their records, as an index file has them; its tree is measured from the bytes, cut
at those lengths and never decoded, so damaged headers and bytes that are no text are only other bytes. Two trees are compared top by top; below nodes that agree nothing is joined, and the
descent ends at the records that are changed, missing or extra. Only the cutting of bytes runs in Python; all else are DataFrame operations.

A shard that holds more than ``SHARD_ROWS`` records (repeated page ids) is dealt to parts by the records' hashes.

Defined cases: null html and url are empty; rows with a null ``page_id`` form shards of their own below zero, by hash; repeated
rows are separate records in a fixed order; a very long page makes its shard as long (a shard must fit one row, 2 GB); extra columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import P, UID, as_scan, materialize, with_uid, work_path

SHARD_PAGES = 256
SHARD_ROWS = 512
NULL_SHARDS = 65_536
FAN = 16
LEVELS = 2  # FAN ** LEVELS records under a top node; a longer shard has several
DATE = "2024-01-01T00:00:00Z"
SHARD = ["shard", "part"]
#: With at most so many differing shards the descent names them in the filter of the stored levels.
NAMED = 1000


def warc_records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """``page_id, shard, part, key, record`` of each row; ``page_id`` and ``key`` (the record's hash) order a shard."""
    pages = as_scan(pages)
    html, url = F.coalesce(pages["html"].cast("string"), F.lit("")), F.coalesce(pages["url"].cast("string"), F.lit(""))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(pages["page_id"].cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
        html,
        F.lit("\r\n\r\n"),
    )
    rows = with_uid(pages).select(UID, pages["page_id"].cast("long").alias("page_id"), record.alias("record"))
    shard = F.coalesce(F.floor(F.col("page_id") / SHARD_PAGES), -1 - F.pmod(F.xxhash64("record"), F.lit(NULL_SHARDS)))
    rows = rows.select(UID, "page_id", shard.alias("shard"), F.sha2("record", 256).alias("key"), "record")
    count = rows.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > SHARD_ROWS)
    large = count.select("shard", F.ceil(F.col("n") / (SHARD_ROWS // 2)).alias("parts"))
    dealt = rows.join(F.broadcast(materialize(large, "large")), "shard", "left") if not large.isEmpty() else rows.withColumn("parts", F.lit(None).cast("long"))
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("key", UID), F.col("parts"))).cast("int")
    return dealt.select("page_id", "shard", part.alias("part"), "key", "record")


def ranges(records: DataFrame) -> DataFrame:
    """``page_id, shard, part, seq, offset, length, sha`` of each record in its shard. Only digests and lengths are shuffled, never records."""
    slim = records.select("page_id", *SHARD, "key", F.octet_length("record").cast("long").alias("length"))
    w = Window.partitionBy(*SHARD).orderBy("page_id", "key")
    rows = slim.withColumn("seq", F.row_number().over(w).cast("long") - 1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.select("page_id", *SHARD, "seq", "offset", "length", F.col("key").alias("sha"))


def leaves(found: DataFrame) -> DataFrame:
    """Level 0: the hash of each record's range and bytes."""
    digest = F.sha2(F.concat_ws(":", "seq", "offset", "length", "sha"), 256)
    return found.select(*SHARD, F.col("seq").alias("node"), F.col("offset").alias("lo"), (F.col("offset") + F.col("length")).alias("hi"), digest.alias("hash"))


def tree(level0: DataFrame) -> list[DataFrame]:
    """The stored levels of the trees of all shards, from the leaves to the tops."""
    out = [materialize(level0, "level-0")]
    for k in range(1, LEVELS + 1):
        kids = F.transform(F.sort_array(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"])  # FAN of them
        up = out[-1].groupBy(*SHARD, F.floor(F.col("node") / FAN).alias("parent"))
        nodes = up.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sha2(F.array_join(kids, ""), 256).alias("hash"))
        out.append(materialize(nodes.select(*SHARD, F.col("parent").alias("node"), "lo", "hi", "hash"), f"level-{k}"))
    return out


def audit(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """Records in which two replicas differ: ``shard, part, seq, lo, hi, status`` (changed, missing, extra); nothing below equal nodes is joined."""
    bad = None
    for k in range(LEVELS, -1, -1):
        a, b = ours[k], theirs[k].select(*SHARD, "node", F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.col("hash").alias("hash_b"))
        if bad is not None:
            few = [r.shard for r in bad.select("shard").distinct().limit(NAMED + 1).collect()]
            below = bad.select(*SHARD, F.col("node").alias(P + "parent"))
            side = lambda x: (x.filter(F.col("shard").isin(few)) if len(few) <= NAMED else x).withColumn(P + "parent", F.floor(F.col("node") / FAN)).join(below, [*SHARD, P + "parent"], "left_semi").drop(P + "parent")
            a, b = side(a), side(b)
        bad = a.join(b, [*SHARD, "node"], "full").filter(~F.col("hash").eqNullSafe(F.col("hash_b")))
        if k:
            bad = materialize(bad.select(*SHARD, "node"), "branches")
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("changed")
    return bad.select(*SHARD, F.col("node").alias("seq"), F.coalesce("lo", "lo_b").alias("lo"), F.coalesce("hi", "hi_b").alias("hi"), status.alias("status"))


def write_warc(records: DataFrame) -> DataFrame:
    """``shard, part, bytes, lengths``: one WARC a shard, its records in order, and how long each is."""
    rows = records.groupBy(*SHARD).agg(F.sort_array(F.collect_list(F.struct("page_id", "key", "record"))).alias("rows"))
    whole = F.array_join(F.transform("rows", lambda x: x["record"]), "").cast("binary")
    return rows.select(F.col("shard").cast("long").alias("shard"), "part", whole.alias("bytes"), F.transform("rows", lambda x: F.octet_length(x["record"]).cast("long")).alias("lengths"))


def _sum(xs) -> F.Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for shard, part, data, lengths in zip(*(b.column(c) for c in (*SHARD, "bytes", "lengths")), strict=True):
            whole = memoryview(data.as_buffer()) if data.is_valid else memoryview(b"")
            at, rows = 0, []
            for n in [*(lengths.as_py() or []), max(0, len(whole) - sum(lengths.as_py() or []))]:
                if n and at < len(whole):
                    piece = whole[at : at + n]
                    rows.append((len(rows), at, len(piece), hashlib.sha256(piece).hexdigest()))
                at += n
            if rows:
                seq, offset, length, sha = zip(*rows, strict=True)
                yield pa.record_batch([pa.array([shard.as_py()] * len(rows), pa.int64()), pa.array([part.as_py()] * len(rows), pa.int32()), pa.array(seq, pa.int64()), pa.array(offset, pa.int64()), pa.array(length, pa.int64()), pa.array(sha)], [*SHARD, "seq", "offset", "length", "sha"])


def measure(replica: DataFrame) -> DataFrame:
    """The ranges of a replica (``shard, part, bytes, lengths``), measured from its bytes: those that the bytes do not reach are not there, and
    bytes beyond the last make one range more. A shard's bytes are cut where they are; expressions would copy all of them for each record."""
    return replica.select(*SHARD, "bytes", "lengths").mapInArrow(_measured, "shard long, part int, seq long, offset long, length long, sha string")


def parse_warc(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, payload) of each record of an uncompressed WARC file."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(": ", 1) for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
        size = int(head["Content-Length"])
        yield at, head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for data in b.column("bytes"):
            rows = [(at, head.get("WARC-Target-URI", ""), body.decode("utf-8", "replace")) for at, head, body in parse_warc(data.as_py())]
            if rows:
                yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], ["offset", "url", "html"])


def read_warc(files: DataFrame) -> DataFrame:
    """``offset, url, html`` of the records of WARC files given as rows of ``bytes`` (for files: the binaryFile source's content)."""
    return files.select("bytes").mapInArrow(_parsed, "offset long, url string, html string")


def damaged(replica: DataFrame) -> DataFrame:
    """A replica with known damage, for drills: in every fourth shard one byte of the record 7 (modulo the records) is turned over, in every
    second the last record is cut off."""
    n = F.size("lengths")
    place = (_sum(F.slice("lengths", F.lit(1), F.lit(7) % n)) + 30).cast("int")  # in the header, after its first line
    part = lambda start, length: F.substring(F.col("bytes"), start, length)
    other = F.when(F.hex(part(place + 1, F.lit(1))) == "FF", F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("FF")))
    turned = F.concat(part(F.lit(1), place), other, part(place + 2, F.octet_length("bytes")))
    rows = replica.withColumn("bytes", F.when(F.pmod("shard", F.lit(4)) == 0, turned).otherwise(F.col("bytes")))
    cut = F.substring(F.col("bytes"), F.lit(1), _sum(F.slice("lengths", F.lit(1), n - 1)).cast("int"))
    return rows.withColumn("bytes", F.when(F.pmod("shard", F.lit(2)) == 0, cut).otherwise(F.col("bytes")))


def op5_warc_fixity(spark, sf_dir: str) -> DataFrame:
    """Archive all pages as WARC shards, keep a replica with the damage of a drill, and audit it: where each record stands, and what became of it."""
    records = warc_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    manifest = materialize(ranges(records), "manifest")
    path = work_path(spark, "replica")
    damaged(write_warc(records)).write.parquet(path)
    replica = spark.read.parquet(path)
    ours = tree(leaves(manifest))
    bad = audit(ours, tree(leaves(measure(replica))))
    root = ours[LEVELS].select(*SHARD, F.col("node").alias("top"), F.col("hash").alias("root_sha256"))
    rows = manifest.join(ours[0].select(*SHARD, F.col("node").alias("seq"), F.col("hash").alias("leaf_sha256")), [*SHARD, "seq"])
    rows = rows.withColumn("top", F.floor(F.col("seq") / FAN**LEVELS)).join(root, [*SHARD, "top"])
    rows = rows.join(bad.select(*SHARD, "seq", "status"), [*SHARD, "seq"], "left")
    return rows.select("page_id", "shard", "seq", "offset", "length", "leaf_sha256", "root_sha256", F.coalesce("status", F.lit("intact")).alias("status"))


OP5_SQL = rf"""
WITH r AS (
  SELECT page_id, page_id // {SHARD_PAGES} AS shard,
         concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10),
                'WARC-Date: {DATE}', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10),
                'Content-Length: ', octet_length(encode(coalesce(html, ''))), chr(13), chr(10), chr(13), chr(10),
                html, chr(13), chr(10), chr(13), chr(10)) AS record
  FROM pages),
o AS (
  SELECT *, octet_length(encode(record)) AS length, row_number() OVER w - 1 AS seq, count(*) OVER (PARTITION BY shard) AS n
  FROM r WINDOW w AS (PARTITION BY shard ORDER BY page_id, sha256(record))),
f AS (
  SELECT *, coalesce(sum(length) OVER (PARTITION BY shard ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM o),
l0 AS (SELECT page_id, shard, n, seq, off, length, sha256(concat_ws(':', seq, off, length, sha256(record))) AS h FROM f),
l1 AS (SELECT shard, seq // {FAN} AS n, sha256(string_agg(h, '' ORDER BY seq)) AS h FROM l0 GROUP BY ALL),
l2 AS (SELECT shard, n // {FAN} AS m, sha256(string_agg(h, '' ORDER BY n)) AS h FROM l1 GROUP BY ALL)
SELECT l0.page_id, l0.shard, l0.seq, l0.off AS "offset", l0.length, l0.h AS leaf_sha256, l2.h AS root_sha256,
       CASE WHEN l0.shard % 2 = 0 AND l0.seq = l0.n - 1 THEN 'missing' WHEN l0.shard % 4 = 0 AND l0.seq = 7 % l0.n THEN 'changed' ELSE 'intact' END AS status
FROM l0 JOIN l2 ON l0.shard = l2.shard AND l0.seq // {FAN**LEVELS} = l2.m
"""
