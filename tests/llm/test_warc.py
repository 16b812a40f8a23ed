"""WARC shards, their ranges and the fixity audit: against byte offsets, planted damage, odd rows."""

import hashlib

from pyspark.sql import functions as F

from cairn.llm import warc
from cairn.llm.common import materialize

SCHEMA = "page_id long, url string, html string, shard string, record int"


def archive(spark, rows):
    records = warc.warc_records(spark.createDataFrame(rows, SCHEMA))
    manifest = materialize(warc.ranges(records), "manifest")
    return manifest, materialize(warc.write_warc(records), "replica")


def pages(n):
    return [(i, f"http://x/{i}", f"<p>é {i}\r\n\r\nWARC/1.1\r\n</p>", "own", 1) for i in range(n)]


def found(manifest, replica):
    ours = warc.tree(warc.leaves(manifest))
    bad = warc.audit(ours, warc.tree(warc.leaves(warc.measure(replica)))).collect()
    return sorted((r.shard, r.seq, r.status) for r in bad)


def test_round_trip_and_ranges(spark):
    manifest, replica = archive(spark, pages(600))
    assert {(r.url, r.html) for r in warc.read_warc(replica).collect()} == {(u, h) for _, u, h, *_ in pages(600)}
    shards = {(r.shard, r.part): bytes(r.bytes) for r in replica.collect()}
    assert sorted(shards) == [(0, 0), (1, 0), (2, 0)]
    for r in manifest.collect():
        data = shards[r.shard, r.part][r.offset : r.offset + r.length]
        assert hashlib.sha256(data).hexdigest() == r.sha and data.startswith(b"WARC/1.1\r\n")
    for data in shards.values():
        for _, head, body in warc.parse_warc(data):
            assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(head) and len(body) == int(head["Content-Length"])
    assert found(manifest, replica) == []


def test_damage_is_located(spark):
    manifest, replica = archive(spark, pages(1300))
    at = {(r.shard, r.seq): r.offset for r in manifest.collect()}
    size = {r.shard: len(r.bytes) for r in replica.collect()}
    turn = lambda shard, place, by: F.when(F.col("shard") == shard, F.unhex(F.concat(F.substring(F.hex("bytes"), 1, 2 * place), F.lit(by), F.expr(f"substring(hex(bytes), {2 * place + 3})"))))
    changed = turn(0, at[0, 7] + 12, "FF")  # no UTF-8 any more
    changed = changed.when(F.col("shard") == 1, F.substring("bytes", 1, at[1, 255])).when(F.col("shard") == 2, F.concat("bytes", F.lit(b"more")))
    bad = replica.withColumn("bytes", changed.otherwise(F.col("bytes"))).filter("shard <> 3")
    got = found(manifest, materialize(bad, "bad"))
    assert got[:3] == [(0, 7, "changed"), (1, 255, "missing"), (2, 256, "extra")]
    assert got[3:] == [(3, i, "missing") for i in range(256)]
    swapped = turn(4, size[4] - 1, "00").otherwise(F.col("bytes"))  # the very last byte
    assert found(manifest, materialize(replica.withColumn("bytes", swapped), "bad")) == [(4, 256, "changed")] or found(manifest, materialize(replica.withColumn("bytes", swapped), "bad")) == [(4, 255, "changed")]


def test_odd_rows(spark):
    rows = pages(3) + [(1, "http://x/1", pages(3)[1][2], "own", 1)] * 3 + [(None, None, None, None, None)] * 5 + [(2, None, "x" * 400_000, None, None)]
    manifest, replica = archive(spark, rows)
    assert manifest.count() == len(rows) and found(manifest, replica) == []
    assert {r.shard < 0 for r in manifest.filter("page_id is null").collect()} == {True}
    many = [(5, "u", "same", "s", 1)] * 1500 + [(None, "u", f"{i}", "s", 1) for i in range(50)]
    manifest, replica = archive(spark, many)
    assert manifest.count() == len(many) and manifest.filter("shard = 0").select("part").distinct().count() > 2 and found(manifest, replica) == []
    manifest, replica = archive(spark, [])
    assert manifest.count() == replica.count() == 0 and found(manifest, replica) == []
