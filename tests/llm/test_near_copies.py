"""Near copies of the pipeline against brute force over all pairs."""

import random

import numpy as np

import corpus_pipeline
from cairn.llm import near_copies, simhash


def brute_shingles(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute_kept(texts):
    sets = [brute_shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in range(len(texts)) if find(i) == i}


def edited(rng, text, n):
    w = text.split()
    for at in rng.sample(range(len(w)), n):
        w[at] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_edited_copies_go_and_others_stay(spark, tmp_path):
    rng = random.Random(1)
    texts = []
    for _ in range(40):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300)))
        texts += [base, edited(rng, base, 1), edited(rng, base, max(1, len(base.split()) // 50)), edited(rng, base, len(base.split()) // 15)]
    family = " ".join(f"f{rng.randrange(3000)}" for _ in range(200))
    for _ in range(60):  # a chain: each is a copy of the one before, the ends are not copies of each other
        texts.append(family)
        family = edited(rng, family, 2)
    texts += ["a b c", "A  b\nc", "a b d", "one", "", " ", None]
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    path = str(tmp_path / "d")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    want = brute_kept(texts)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == want
    assert len(want) < simhash.drop_near_copies(docs).count()  # three bits leave edited copies in
    assert near_copies.drop_similar(docs.limit(0)).count() == 0


def test_tables_propose_and_the_radius_keeps_pairs_at_the_threshold():
    rng = random.Random(2)
    for texts in (1000, 250_000, 10**8):
        picks = near_copies.tables(texts)
        hit = near = pairs = 0
        while pairs < 150:
            base = " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
            other = edited(rng, base, rng.randint(1, 5))
            a, b = brute_shingles(base), brute_shingles(other)
            if len(a & b) >= 0.8 * len(a | b):
                pairs += 1
                x, y = (near_copies.wide_fingerprint(near_copies.shingles(t)) for t in (base, other))
                apart = np.unpackbits((x ^ y).view(np.uint8))
                near += apart.sum() <= near_copies.RADIUS
                hit += bool((apart[picks] == 0).all(axis=1).any())
        assert hit >= 0.95 * pairs and near >= 0.95 * pairs


def test_large_families_in_slices(spark, tmp_path, monkeypatch):
    """A family whose members are near each other only in part, in slices of a few texts each."""
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(3000)}" for _ in range(150))
    texts = [edited(rng, base, rng.randint(1, 6)) for _ in range(150)]
    chain = " ".join(f"f{rng.randrange(3000)}" for _ in range(150))
    for _ in range(80):
        texts.append(chain)
        chain = edited(rng, chain, 2)
    rng.shuffle(texts)
    path = str(tmp_path / "d")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    want = brute_kept(texts)
    whole = {r.doc_id for r in near_copies.drop_similar(docs).collect()}
    monkeypatch.setattr(near_copies, "SLICE", 3000)
    cut = {r.doc_id for r in near_copies.drop_similar(docs).collect()}
    assert whole == want and cut == want


def test_similarity_is_exact():
    rng = random.Random(4)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(1, 50))), np.uint64) for _ in range(80)]
    held = near_copies._Sets(sets)
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(80) for j in range(80) if i != j], strict=True))
    brute = [5 * len(x & y) >= 4 * len(x | y) for x, y in ((set(sets[i].tolist()), set(sets[j].tolist())) for i, j in zip(a, b, strict=True))]
    assert held.similar(a, b).tolist() == brute
