"""Decontamination, HTML text, language ID, secrets, WARC, token counts and the pipeline."""

import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from cairn.llm import decontam, html_text, langid, secrets, token_counts
from cairn.llm.common import UID

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def words(rng, n, vocab=400):
    return " ".join(f"{'abcdefgh'[rng.randrange(8)]}{rng.randrange(vocab)}" for _ in range(n))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></ul></nav><div class="cookie-notice">We use cookies on this site and you agree.</div>
<article><h1>Title &amp; more</h1><p>First <b>bold paragraph<br>after&nbsp;break
 and line<p>Second &lt;p&gt; 3 &#60; 4 &eacute;<div class="ad">Buy now</div><ul><li>one<li>two</ul></article>
<section class="comments"><p>I think that this is a comment of a reader and it is long enough to be text.</p></section>
<aside>Side</aside><form><label>Mail</label><input></form><footer>&copy; foot</footer></body></html>"""


def test_main_text_of_an_article():
    assert html_text.main_text(PAGE) == "Title & more First bold paragraph after break and line Second <p> 3 < 4 é one two"


def test_main_text_without_an_article_tag():
    body = "The cat sat on the mat and it was in the house that they had for the winter of that year, " * 4
    page = f'<body><div id="menu"><a href=1>Home</a> <a href=2>About</a></div><div><h2>Heading</h2><p>{body}</p><p>Short one.</p><p>{body}</p></div><p><a href=x>read more about the of and</a></p><div class=footer>All rights</div>'
    got = html_text.main_text(page)
    assert got.startswith("Heading The cat") and "Short one." in got
    assert "Home" not in got and "rights" not in got and "read more" not in got


def test_odd_pages(spark):
    for page in (None, "", "no tags at all", "<", "<p", "<!-- open", "<script>never closed", "<p>" * 5000, "</p></div>"):
        html_text.main_text(page)
    assert html_text.main_text("<article>" + "x " * 200_000 + "</article>") == ("x " * 200_000).strip()
    out = html_text.extract_text(spark.createDataFrame([(1, None, None), (1, None, None)], "page_id long, url string, html string")).collect()
    assert [(r.text, r.n_chars) for r in out] == [("", 0)] * 2


def test_language_models_are_distributions():
    model = langid.fit({"a": {"abba": 3, "bab": 1}, "b": {"ccd": 2, "abd": 1}})
    chars = "abcd" + chr(langid.END)
    import numpy as np

    for context in ("ab", "bb", "zz", chr(langid.START) * 3, "c"):
        total = np.zeros(2)
        for c in chars:
            codes = np.frombuffer((chr(langid.START) * 3 + context + c).encode("utf-32-le"), "<u4").astype(np.uint64)
            total += np.exp(model.char_logp(codes, np.array([len(codes) - 1])))[0]
        assert (total > 0.6).all() and (total < 1.01).all()  # the rest is for characters never seen


@tables
def test_language_id_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.op3_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in held) and not any(r.rejected for r in held)


def test_language_id_edge_cases(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["the", "and", "house"] if i % 2 else ["der", "und", "haus"]) for _ in range(50)), "en" if i % 2 else "de") for i in range(60)]
    docs += [(100, None, "en"), (101, "123 !! ½ ²", "en"), (102, "", None), (103, "щука " * 200, None), (104, "the and " * 50_000, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(df.select("doc_id", "text"), langid.train_split(df), ["doc_id"]).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and all(got[i].rejected for i in (100, 101, 102))
    assert got[103].rejected and not got[104].rejected and got[104].lang_pred == "en"
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    clash = df.withColumns({"score": F.lit("mine"), "rejected": F.lit(1), "lang_pred": F.lit(None).cast("string")})
    kept = langid.keep_known(clash)
    assert kept.columns == clash.columns and {r.score for r in kept.collect()} == {"mine"}
    assert langid.keep_known(clash.limit(0)).count() == 0
    none = langid.predict(df.select("doc_id", "text"), langid.train_split(df.filter("false")), ["doc_id"])
    assert {r.lang_pred for r in none.collect()} == {"und"}


@tables
def test_rejection_is_calibrated(spark):
    """Texts of a language that was left out are rejected, held-out texts of known ones are not."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text is not null")
    langs = sorted(r.lang for r in docs.select("lang").distinct().filter("lang is not null").collect())
    held = docs.filter(langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    for left_out in langs[:2]:
        model = langid.train(docs.filter(~langid.held_out(F.col("doc_id")) & (F.col("lang") != left_out)))
        foreign = langid.predict(held.filter(F.col("lang") == left_out), model, ["doc_id"]).collect()
        assert sum(r.rejected for r in foreign) >= 0.95 * len(foreign)
    model = langid.train_split(docs)
    assert not any(r.rejected for r in langid.predict(held, model, ["doc_id"]).collect())
    odd = spark.createDataFrame([(1, "щука плавает в реке и поет"), (2, "日本語のテキスト"), (3, "xqzzk vrtpl wqxkj zzpt qqqq")], "doc_id long, text string")
    assert all(r.rejected for r in langid.predict(odd, model, ["doc_id"]).collect())


def brute_secrets(text):
    spans = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))


def test_base_secrets_match_brute_force(spark):
    rng = random.Random(6)
    bits = ["password", "Secret", "api_key", "apikey", "TOKEN", "=", ":", " ", "'", '"', "abcdef", "AKIA", "ABCD1234ABCD1234", "0123456789abcdef01234567", "é", "\n", "x", "ſ", "K"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, "", "token=token:abcdefgh"]
    got = secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        want = brute_secrets(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[r.doc_id]
        assert r.n_assign + r.n_access + r.n_hex == (want.count(",") + 1 if want else 0)
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def brute_linked(text):
    """Every pair of parts compared: which weak parts have all three roles filled by parts within reach in their paragraph."""
    base = secrets.base_spans(text)
    parts = [(m.start(), m.end(), "user") for m in secrets._USER.finditer(text)] + [(m.start(), m.end(), "endpoint") for m in secrets._ENDPOINT.finditer(text)]
    inside = lambda s, e: any(a < e and b > s for a, b, _ in base + parts)
    if base or parts:
        parts = parts + [(m.start(), m.end(), "weak") for m in secrets._WEAK.finditer(text) if secrets._looks_random(m[0]) and not inside(m.start(), m.end())]
    breaks = [m.start() for m in re.finditer(r"\n\s*\n", text)]
    scope = lambda s: sum(b < s for b in breaks)
    out = list(base)
    for s, e, kind in parts:
        near = {kind} | {k for a, b, k in base + parts if scope(a) == scope(s) and (a - e if a >= s else s - b) <= secrets.REACH}
        if near & {"user", "access"} and near & {"assign", "hex", "weak"} and near & {"endpoint", "access"}:
            out.append((s, e, kind))
    return sorted(out, key=lambda x: (x[0], secrets.KINDS.index(x[2])))


def test_linked_spans_match_all_pairs():
    rng = random.Random(9)
    bits = ["user: admin42", "login=bob99", "https://h.example.com/p", "db.example.com:5432", "Zx81kQpLm02RtYv7", "password=hunter22", "AKIA" + "ABCD1234ABCD1234", "0123456789abcdef01234567", "words here", " ", "\n", "\n\n", "x" * 90, ", "]
    for _ in range(1500):
        text = " ".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert secrets.linked_spans(text, secrets.base_spans(text)) == brute_linked(text), repr(text)


def test_secrets_of_odd_rows(spark):
    rows = [("a", None, 1, "x"), ("a", None, 1, "x"), (None, "", 2, "y"), ("b", "x" * 300_000 + " token=abcdef12", 3, "z")]
    df = spark.createDataFrame(rows, "doc_id string, text string, n_hex int, spans string")
    got = secrets.find_secrets(df).collect()
    assert [(r.doc_id, r.n_assign, r.spans) for r in got] == [("a", 0, ""), ("a", 0, ""), (None, 0, ""), ("b", 1, "assign:300001:300015")]
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_weak_parts_need_their_complements():
    whole = "user: admin42\nhost db.example.com:5432\nvalue Zx81kQpLm02RtYv7"
    kinds = lambda t: [k for _, _, k in secrets.linked_spans(t, secrets.base_spans(t))]
    assert kinds(whole) == ["user", "endpoint", "weak"]
    assert kinds(whole.replace("user: admin42", "nothing")) == []
    assert kinds(whole.replace("\nhost", "\n\nhost")) == []  # another paragraph is another scope
    assert kinds("user: admin42 " + "x " * 300 + "db.example.com:5432 Zx81kQpLm02RtYv7") == []


TOKENIZER = f"{token_counts.TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files here")
def test_piecewise_counts_are_exact():
    import tiktoken

    bpe = token_counts.Bpe(TOKENIZER)
    plain = tiktoken.Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(7)
    bits = ["the", " ", "  ", "\n", "\t", "don't", "'s", "42", "é", "!!", " ", "\x1c", " ", "日本"]
    for t in [None, "", " ", "\n\n a", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(2000))]:
        assert bpe.count(t) == len(plain.encode_ordinary(t or "")), repr(t)


def test_rollups_are_additive_and_idempotent(spark, tmp_path):
    store = str(tmp_path / "store")
    schema = "doc_id long, source string, lang string, text string"
    old = token_counts.count_tokens(spark.createDataFrame([(1, "a", "en", "x y z"), (2, "a", None, "x"), (3, None, "en", None), (3, None, "en", None)], schema))
    new = token_counts.count_tokens(spark.createDataFrame([(1, "b", "en", "x y")], schema))
    assert token_counts.commit(store, "1", token_counts.deltas(after=old))
    assert not token_counts.commit(store, "1", token_counts.deltas(after=old))
    token_counts.commit(store, "2", token_counts.deltas(after=new, before=old.filter("doc_id = 1")))
    token_counts.commit(store, "3", token_counts.deltas(before=old.filter("doc_id = 2")))
    want = {("b", "en", 1, 2), (None, "en", 2, 0)}
    assert {(r.source, r.lang, r.docs, r.tokens) for r in token_counts.totals(spark, store).collect()} == want
    token_counts.compact(spark, store, str(tmp_path / "small"), "base")
    assert {(r.source, r.lang, r.docs, r.tokens) for r in token_counts.totals(spark, str(tmp_path / "small")).collect()} == want
    assert token_counts.totals(spark, str(tmp_path / "none")).count() == 0


@tables
@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer files here")
def test_token_query_matches_brute_force(spark):
    bpe = token_counts.Bpe(TOKENIZER)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    want = {}
    for d in docs:
        label = labels.get(d.doc_id)
        if label and label.toxic == 1:
            continue
        text = re.sub(r"[\x20\x09-\x0D]+", " ", d.text) if label and label.quality == 0 else d.text
        for name, n in (("words-1", len(re.findall(r"[^\x20\x09-\x0D]+", text))), (bpe.name, bpe.count(text))):
            key = (d.source, d.lang, name)
            a, b = want.get(key, (0, 0))
            want[key] = (a + 1, b + n)
    got = {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in token_counts.op7_token_counts(spark, SF).collect()}
    assert got == want


@tables
@pytest.mark.parametrize("name", ["op5_warc_fixity", "op6_exact_dedup", "op8_line_dedup", "op9_mixing"])
def test_queries_match_their_sql(spark, name):
    from oracle_check import compare, connect

    from cairn.llm.queries import QUERIES, SQL

    said = compare(spark, connect(SF), name, SF, QUERIES[name], SQL[name])
    assert said.startswith("ok"), said


def kept_by_brute_force(rows):
    """The smallest id of each group that chains of pairs at a similarity of 0.8 over five-word shingles make."""
    sets = {}
    for d, t in rows.items():
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()
    root = {d: d for d in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in rows:
        for b in rows:
            both = len(sets[a] & sets[b]) if a < b else 0
            if a < b and (sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d for d in rows if find(d) == d}


def leaked(text, bench):
    """Does any item occur with at most a fifth of its words edited (bit-parallel over the whole text)?"""
    words_ = decontam.WORD.findall((text or "").lower())
    for item in bench:
        own = decontam.WORD.findall(item.lower())
        if own and decontam.best_edit(own, words_)[0] <= int(decontam.MAX_EDITS * len(own)):
            return True
    return False


@tables
def test_pipeline_matches_brute_force_stage_by_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    from cairn.llm.common import materialize

    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, before, SF), "t")
        assert after.columns == names
        rows = {r.doc_id: r.text for r in before.collect()}
        kept = ids(after)
        if name == "language_id":
            assert kept == {d for d, t in rows.items() if re.search(r"[^\W\d_]", t or "")}
        elif name == "exact_dedup":
            groups = {}
            for d, t in rows.items():
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), d))
            assert kept == {min(g)[1] for g in groups.values()}
        elif name == "near_dedup":
            assert kept == kept_by_brute_force(rows)
        else:
            assert kept == {d for d, t in rows.items() if not leaked(t, bench)}
        before = after
    final = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in before.collect()}
    got = {}
    for r in final.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
        assert r.mix_size == sizes[r.doc_id]
    assert max(got.values()) <= 2 and set(got) <= set(sizes)
    source = {r.doc_id: r.source for r in before.collect()}
    by_source, taken = {}, {}
    for d, x in source.items():
        by_source[x] = by_source.get(x, 0) + sizes[d]
        taken[x] = taken.get(x, 0) + got.get(d, 0) * sizes[d]
    order = sorted((x for x in by_source if x is not None), key=lambda x: x.encode()) + [None] * (None in by_source)
    weight = {x: (3, 1, 2)[i % 3] for i, x in enumerate(order)}
    full = set()
    while True:  # reshare what is above twice a source's words until none is
        left = 1.5 * sum(by_source.values()) - sum(2 * by_source[x] for x in full)
        unit = left / max(1, sum(w for x, w in weight.items() if x not in full))
        over = {x for x in by_source if x not in full and unit * weight[x] > 2 * by_source[x]}
        if not over:
            break
        full |= over
    for x, words_ in by_source.items():
        target = 2 * words_ if x in full else unit * weight[x]
        own = [sizes[d] for d in source if source[d] == x]
        assert abs(taken[x] - target) <= max(0.02 * target, max(own) / 2 + 1), x
    assert UID not in final.columns
