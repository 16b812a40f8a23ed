"""Exact, line and near dedup, mixing: against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import simhash
from cairn.llm.common import UID
from cairn.llm.components import components
from cairn.llm.exact_dedup import drop_copies, exact_dedup
from cairn.llm.line_dedup import _kept_digest, keep_bitmaps
from cairn.llm.common import with_uid
from cairn.llm.mixing import apply_mix, mix, targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, __x string"


def stored(spark, tmp_path, rows, name="docs", schema=SCHEMA, parts=3):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


def rows(texts, source=lambda i: f"s{i % 3}"):
    return [(i, t, "en", source(i), len(t or ""), "u", "x") for i, t in enumerate(texts)]


def squeeze(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_dedup_matches_brute_force(spark, tmp_path):
    rng = random.Random(1)
    pool = ["a b", "ab", "a  b ", "", " ", None, "é x", "x y", "x y", "\t\n", "long " * 500]
    data = rows([rng.choice(pool) for _ in range(120)]) + [(5, "ab", "en", None, 2, "u", "x"), (None, "unique one", None, None, 0, "u", "x"), (None, "ab", None, None, 0, "u", "x")]
    got = exact_dedup(stored(spark, tmp_path, data)).drop(UID).collect()
    groups = {}
    for d, t, *_ in data:
        groups.setdefault(squeeze(t), []).append((-len(t or ""), d is None, d, t))
    assert len(got) == len(data)
    for r in got:
        g = next(g for k, g in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        best = sorted(g, key=lambda x: (x[0], x[1], x[2] or 0))[0]
        assert (r.keep_id, r.group_size) == (best[2], len(g))
    assert sum(r.kept for r in got) == len(groups)
    kept = drop_copies(spark.read.parquet(str(tmp_path / "docs")))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert kept.count() == len(groups)


def test_line_dedup_matches_brute_force(spark, tmp_path):
    rng = random.Random(2)
    lines = ["  License line that is shared by very many documents of all kinds", "LICENSE line that is shared by very many documents of all kinds ", "short", "", "another line of more than forty characters, seen sometimes", "x" * 41]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6))) for _ in range(60)] + [None, "", "y" * 39, "\n\n"]
    data = rows(texts)
    docs = stored(spark, tmp_path, data).select("doc_id", "text")
    both = with_uid(docs).join(keep_bitmaps(docs), UID, "left").select("doc_id", "text", "keep_bitmap")
    got = {r.doc_id: r for r in both.mapInArrow(_kept_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string").collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for d, t, *_ in data:
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(d)
    for d, t, *_ in data:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (len(key(x)) >= 40 and len(holders[key(x)]) >= 5 and d < max(holders[key(x)]))]
        want = (len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
        assert (got[d].n_lines, got[d].n_dropped, got[d].kept_sha256) == want, d


def test_one_line_over_many_partitions(spark, tmp_path):
    line = "this very line is in every document of the table, all of them"
    data = [(i, line, "en", "s", 0, "u", "x") for i in range(400)] + [(399, line, "en", "s", 0, "u", "x"), (None, line, "en", "s", 0, "u", "x")]
    docs = stored(spark, tmp_path, data).select("doc_id", "text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        lost = with_uid(docs).join(keep_bitmaps(docs), UID).select("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(r.doc_id for r in lost) == list(range(399))


def brute_fingerprint(text, k=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(grams))


def test_fingerprints_match_brute_force_and_spark(spark):
    texts = [None, "", " \t ", "one", "One TWO", "a b c d e a b c", "É é x y z w", "w " * 5000]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    h = spark.range(1).select(F.xxhash64(F.lit("one")).alias("h")).first().h
    assert simhash.fingerprint("one") == h % 2**64


def test_gray_index_finds_the_components_of_all_close_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = [b ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64))) for b in base[:150] for _ in range(4)]
    dense = [base[0] ^ np.uint64(1 << i) ^ np.uint64(1 << j) for i in range(30) for j in range(30)]
    fp = np.unique(np.concatenate([base, np.array(near, np.uint64), np.array(dense, np.uint64)]))
    order = np.argsort(simhash.gray_rank(fp))
    fp = fp[order]
    got = simhash.GrayIndex(np.zeros(len(fp), np.int64), fp[:, None]).join(3)
    want = simhash.Forest(len(fp))
    for i in range(len(fp)):
        j = np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 3)
        want.link(np.full(len(j), i), j)
    assert np.array_equal(got.up, want.up)


def test_near_groups_match_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 300))) for _ in range(80)]
    texts += [t.replace(" ", "  ", 1).upper() for t in texts[:10]] + [t + " end" for t in texts[10:40]] + [None, "", " "]
    data = rows(texts) + [(3, texts[3], "en", "s", 0, "u", "x"), (None, texts[5], "en", "s", 0, "u", "x")]
    docs = stored(spark, tmp_path, data)
    fps = np.array([brute_fingerprint(t) for _, t, *_ in data], np.uint64)
    forest = simhash.Forest(len(fps))
    for i in range(len(fps)):
        j = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3)
        forest.link(np.full(len(j), i), j)
    ids = [d for d, *_ in data]
    low = {}
    for i, root in enumerate(forest.up):
        low[root] = min([x for x in (low.get(root), ids[i]) if x is not None], default=None)
    want = sorted((-1 if d is None else d, f"{int(f):016x}", low[r]) for d, f, r in zip(ids, fps, forest.up, strict=True))
    for limit in (simhash.BUCKET_ROWS, 8):  # small slices too: every pair of slices must meet
        monkeypatch.setattr(simhash, "BUCKET_ROWS", limit)
        got = simhash.near_groups(docs).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in got) == want
    kept = simhash.drop_near_copies(docs)
    assert kept.count() == len(set(forest.up.tolist())) and kept.columns == docs.columns


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def fill(sizes, weights, budget):
    """Targets by resharing until none is above its cap."""
    full, target = set(), {}
    while True:
        left = budget - sum(2 * sizes[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        target = {s: 2 * sizes[s] if s in full else left * weights[s] / w for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing_meets_targets(spark, tmp_path):
    rng = random.Random(6)
    source = lambda i: [None, "a", "é", "b", "z"][min(4, int(rng.expovariate(0.7)))]
    data = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(int(rng.expovariate(0.01)))), "en", source(i), 0, "u", "x") for i in range(900)]
    data += [(900, None, "en", "empty", 0, "u", "x"), (5, data[5][1], "en", "a", 0, "u", "x")]
    docs = stored(spark, tmp_path, data)
    got = mix(docs).drop(UID).collect()
    again = mix(docs).drop(UID).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    words = {}
    for _, t, _, s, *_ in data:
        words[s] = words.get(s, 0) + len((t or "").split())
    order = sorted((s for s in words if s is not None), key=lambda s: s.encode()) + [None]
    want = fill(words, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(words.values()))
    by_id = {d: s for d, _, _, s, *_ in data}
    taken = {}
    for r in got:
        s = by_id[r.doc_id]
        assert r.taken in (0, r.size, 2 * r.size)
        assert r.target == pytest.approx(want[s]) and r.source_size == words[s]
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(5, 0.01 * t), s
    assert apply_mix(docs.withColumn("copies", F.lit("mine"))).select("copies").distinct().collect() == [("mine",)]
    out = apply_mix(docs)
    assert out.agg(F.sum("mix_size")).first()[0] == sum(taken.values())


def test_empty_tables(spark, tmp_path):
    docs = stored(spark, tmp_path, [], parts=1)
    assert exact_dedup(docs).count() == 0
    assert keep_bitmaps(docs).count() == 0
    assert simhash.near_groups(docs).count() == 0
    assert mix(docs).count() == 0
    assert drop_copies(docs).count() == simhash.drop_near_copies(docs).count() == apply_mix(docs).count() == 0


def test_targets_saturate(spark):
    rows_ = [(False, "a", 10, 1), (False, "b", 1000, 1), (False, "c", 500, 1)]
    got = {r["__c_src"]: r.target for r in targets(spark.createDataFrame(rows_, "__c_no boolean, __c_src string, words long, __c_docs long")).collect()}
    want = fill({"a": 10, "b": 1000, "c": 500}, {"a": 3, "b": 1, "c": 2}, 1.5 * 1510)
    assert got == pytest.approx(want)
