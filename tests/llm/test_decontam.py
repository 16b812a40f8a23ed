"""Decontamination against brute-force edit search."""

import random

import numpy as np
import pytest

from cairn.llm import decontam
from cairn.llm.decontam import WORD


def words(rng, n, vocab=400):
    return " ".join(f"{'abcdefgh'[rng.randrange(8)]}{rng.randrange(vocab)}" for _ in range(n))


def edit_table(p, t):
    """Smallest edit distance of ``p`` to a run of ``t``, by the full table."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def edited(rng, text, share, kind):
    """``text`` with edits on the given share of its words."""
    w = text.split()
    k = int(share * len(w))
    if kind == "head":
        return ["new"] * k + w[k:]
    if kind == "letters":
        for i in rng.sample(range(len(w)), k):
            w[i] = w[i] + rng.choice("xyz")
        return w
    for _ in range(k):
        i, u = rng.randrange(len(w)), rng.random()
        if u < 1 / 3:
            w[i] = "new"
        elif u < 2 / 3:
            w.insert(i, "new")
        else:
            w.pop(i)
    return w


def leaks(index, tokens):
    codes = [index.vocab.get(w, 0) for w in tokens]
    _, pairs = index.candidates(np.array(codes, np.int64), np.array([0]))
    return {i: hit for i in set(pairs[:, 0].tolist()) if (hit := decontam.verify(index, i, codes, sorted(pairs[pairs[:, 0] == i, 1].tolist())))}


def test_edit_distance_matches_the_table():
    rng = random.Random(1)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 70)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        assert decontam.best_edit(p, t)[0] == edit_table(p, t)


@pytest.mark.parametrize("kind", ["mixed", "head", "letters"])
@pytest.mark.parametrize("share", [0.02, 0.05, 0.1, 0.15, 0.2])
def test_recall_against_brute_force(share, kind):
    rng = random.Random(f"{share}{kind}")
    texts = [words(rng, rng.randint(12, 60)) for _ in range(36)] + [words(rng, n) for n in (150, 400)] * 2
    index = decontam.Index(list(enumerate(texts)))
    want = found = 0
    for i, text in enumerate(texts):
        tokens = words(rng, rng.randint(0, 50)).split() + edited(rng, text, share, kind) + words(rng, 50).split()
        got = leaks(index, tokens)
        for j, other in enumerate(texts):
            brute = edit_table(other.split(), tokens) if j == i or j in got else None
            if brute is not None and brute <= int(decontam.MAX_EDITS * len(other.split())):
                want += 1
                found += j in got
                assert j not in got or got[j][0] >= brute
            else:
                assert j not in got
    assert want >= len(texts) and found >= 0.95 * want


def test_verbatim_items_of_any_length_are_found():
    rng = random.Random(5)
    texts = [words(rng, n) for n in (1, 2, 3, 4, 5, 7, 11, 12, 13, 23, 24, 47, 48, 96, 1000)]
    index = decontam.Index(list(enumerate(texts)))
    for before in range(40):
        tokens = ["x"] * before
        for t in texts:
            tokens += [*t.split(), "x"]
        assert set(leaks(index, tokens)) == set(range(len(texts)))
    for i, text in enumerate(texts):  # at the very end and the very start
        assert i in leaks(index, ["x", *text.split()]) and i in leaks(index, text.split())


def test_spread_letter_edits_and_a_rewritten_head():
    """Edits that leave no run of three words, and a head of 52 words."""
    rng = random.Random(6)
    texts = [words(rng, 30) for _ in range(40)]
    index = decontam.Index(list(enumerate(texts)))
    found = 0
    for i, t in enumerate(texts):
        w = t.split()
        for k in range(2, 30, 5):
            w[k] += "x"
        found += i in leaks(index, w)
    assert found >= 38
    texts = [words(rng, 400) for _ in range(20)]
    index = decontam.Index(list(enumerate(texts)))
    assert sum(i in leaks(index, ["new"] * 52 + t.split()[52:]) for i, t in enumerate(texts)) >= 19


def test_repeated_words_stay_bounded():
    index = decontam.Index([(i, " ".join(["the"] * n)) for i, n in enumerate((20, 30, 40))] + [(9, words(random.Random(7), 20))])
    got = leaks(index, ["the"] * 30_000)
    assert set(got) == {0, 1, 2}
    assert leaks(index, ["of"] * 1000) == {}


def test_leaks_are_found_and_clean_texts_left(spark, tmp_path):
    rng = random.Random(2)
    items = [(i, words(rng, rng.randint(12, 60))) for i in range(30)] + [(98, None), (99, ""), (100, "two words")]
    docs, want = [], set()
    for i, (item, text) in enumerate(items[:30]):
        w = text.split()
        if i % 3 == 1:
            w[5] = "changed"
        docs.append((i, words(rng, 200) + "\n" + (" ".join(w).upper() if i % 3 == 2 else " ".join(w)) + ", " + words(rng, 100), "x", "mine"))
        want.add((i, item))
    docs += [(1000 + i, words(rng, 300), "x", "mine") for i in range(50)]
    docs += [(2000, None, "x", "mine"), (2001, "", "x", "mine"), (None, items[0][1], "x", None), (3000, words(rng, 200_000) + " " + items[3][1], "x", "mine"), (0, docs[0][1], "x", "mine")]
    # extra columns have the operator's own names
    spark.createDataFrame(docs, "doc_id long, text string, item_id string, edits string").write.parquet(str(tmp_path / "d"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = spark.read.parquet(str(tmp_path / "d"))
    got = decontam.find_leaks(d, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want | {(None, 0), (3000, 3)}
    assert sum(r.doc_id == 0 for r in got) == 2  # repeated rows are reported each
    texts = {d_: t for d_, t, *_ in docs}
    for r in got:
        if r.doc_id is not None and r.edits == 0:
            assert texts[r.doc_id][r.start : r.end].lower() == dict(items)[r.item_id].lower()
    clean = decontam.drop_leaks(d, bench)
    assert {r.doc_id for r in clean.collect()} == {x for x, *_ in docs if x is not None and 1000 <= x < 3000}
    assert clean.columns == d.columns
    assert decontam.find_leaks(d, bench.limit(0)).count() == 0
    assert decontam.find_leaks(d.limit(0), bench).count() == 0
    named = d.withColumn("doc_id", d["doc_id"].cast("string"))
    assert {r.doc_id for r in decontam.find_leaks(named, bench).collect()} == {None if r.doc_id is None else str(r.doc_id) for r in got}


def test_blocks_of_items_give_the_same(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    items = spark.createDataFrame([(i, words(rng, 30)) for i in range(12)], "item_id long, text string").cache()
    docs = [(r.item_id, words(rng, 40) + " " + r.text) for r in items.collect()]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    whole = {(r.doc_id, r.item_id) for r in decontam.find_leaks(d, items).collect()}
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 500)
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(d, items).collect()} == whole == {(i, i) for i in range(12)}
    assert WORD.findall("a_b") == ["a", "b"]
