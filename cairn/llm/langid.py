"""Language ID with interpolated Kneser-Ney character models.

One model per language over the characters of words (padded with ``ORDER - 1`` starts and one
end). All n-grams that any language has seen stand in one sorted hash array per order, beside a
matrix with the finished interpolated log probability in every language; contexts stand in
another with their back-off weights. A text is scored word by word: a word's log probability
does not depend on its neighbours, so each distinct word of a batch is scored once. The
language is that of the lowest cross-entropy per character.

Rejection: the excess of a text is how many spreads (which shrink with the length of its distinct words) the cross-entropy of its words, each in
its own best language, lies above the mean of its language. Mean, spread and the limit are calibrated on texts that took no part in the
fit: the limit lies between the excess that ``KEEP`` of them stay under and the excess that the same texts reach when their
own language is taken out of the models, at the geometric mean of both where they are apart, and never under ``LEAST_Z``.

Training sample: per language about ``PER_LANG`` texts (a third of them for calibration), chosen by the hash of their
``doc_id``, of the ``MOST_LANGS`` commonest languages, and of their words the ``MOST_WORDS`` commonest. The sample is written once. Nothing of the bounds touches prediction.

Defined cases: texts that are null or have no letter (Unicode category L) are ``und`` with score 0 and rejected;
repeated rows are predicted alike; with no labelled rows all texts are ``und``; a very long text is scored whole, in pieces of
words; extra columns are kept by ``keep_known``, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import P, materialize

ORDER = 4
PER_LANG = 450
MOST_LANGS, MOST_WORDS = 500, 50_000
UNKNOWN = "und"
START, END = 2, 3
KEEP = 0.999
LEAST_Z = 8.0
SLACK = 0.05  # share of the mean cross-entropy that counts as spread at any length
MIX = np.uint64(0x9E3779B97F4A7C15)
LETTERS = regex.compile(r"\p{L}+")
DIGIT = re.compile(r"\d")


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` codes that end at each position (positions below ``n - 1`` wrap and are not used)."""
    h = np.full(len(codes), np.uint64(n))
    for k in range(n - 1, -1, -1):
        h = (h ^ np.roll(codes, k)) * MIX
        h ^= h >> np.uint64(29)
    return h


def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the padded words in a row, and for each position its word, or -1 where nothing is predicted."""
    pad, end = chr(START) * (ORDER - 1), chr(END)
    codes = np.frombuffer("".join(pad + w + end for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.fromiter((len(w) + ORDER for w in words), np.int64, len(words))
    of = np.repeat(np.arange(len(words)), sizes)
    begin = np.cumsum(sizes) - sizes
    of[(np.arange(len(of)) - begin[of]) < ORDER - 1] = -1
    return codes, of


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return keys[at] == h, at


@dataclass
class Model:
    langs: list[str]
    grams: list[np.ndarray]  # per order 1..ORDER: sorted hashes
    logp: list[np.ndarray]  # (grams, languages)
    ctxs: list[np.ndarray]  # per order 2..ORDER: sorted hashes of contexts
    back: list[np.ndarray]
    floor: float
    mean: np.ndarray | None = None  # cross-entropy of calibration texts per language
    spread: np.ndarray | None = None
    limit: float = LEAST_Z
    missed: float = 0.0  # share of the calibration texts that would pass if their language were unknown

    def without(self, lang: int) -> Model:
        """The models of the other languages."""
        keep = [j for j in range(len(self.langs)) if j != lang]
        part = lambda tables: [x[:, keep] for x in tables]
        return Model([self.langs[j] for j in keep], self.grams, part(self.logp), self.ctxs, part(self.back), self.floor, self.mean[keep], self.spread[keep])

    def char_logp(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probability in each language of the characters at ``at``."""
        out = np.zeros((len(at), len(self.langs)), np.float32)
        left = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            hit, where = _find(self.grams[n - 1], gram_hashes(codes, n)[at[left]])
            out[left[hit]] += self.logp[n - 1][where[hit]]
            left = left[~hit]
            if not len(left):
                return out
            if n > 1:
                seen, ctx = _find(self.ctxs[n - 2], gram_hashes(codes, n - 1)[at[left] - 1])
                out[left[seen]] += self.back[n - 2][ctx[seen]]
        out[left] += np.float32(self.floor)
        return out

    def score_words(self, words: list[str]) -> np.ndarray:
        """(words, languages): summed log probability of each word with its end."""
        total = np.zeros((len(words), len(self.langs)))
        for lo in range(0, len(words), 50_000):
            part = words[lo : lo + 50_000]
            codes, of = encode_words(part)
            at = np.flatnonzero(of >= 0)
            p = self.char_logp(codes, at)
            begin = np.flatnonzero(np.diff(of[at], prepend=-1))
            total[lo : lo + len(part)] = np.add.reduceat(p, begin, axis=0, dtype=np.float64)
        return total


def fit(counts: dict[str, dict[str, int]]) -> Model:
    """Interpolated Kneser-Ney models from word counts per language (highest order: counts, lower: distinct left neighbours)."""
    langs = sorted(counts)
    raw = []  # per language and order: (hashes, context hashes, lower-order hashes, counts)
    letters: set[int] = set()
    for lang in langs:
        words = sorted(counts[lang])
        codes, of = encode_words(words)
        at = np.flatnonzero(of >= 0)
        weight = np.array([counts[lang][w] for w in words], np.int64)[of[at]]
        letters.update(np.unique(codes[at]).tolist())
        orders: list = [None] * ORDER
        for n in range(ORDER, 0, -1):
            h = gram_hashes(codes, n)[at]
            keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            if n == ORDER:
                c = np.bincount(inverse, weights=weight)
            else:  # distinct grams one longer that end in this one
                longer, one = np.unique(gram_hashes(codes, n + 1)[at], return_index=True)
                c = np.bincount(inverse[one], minlength=len(keys)).astype(float)
            ctx = gram_hashes(codes, n - 1)[at - 1][first] if n > 1 else np.zeros(len(keys), np.uint64)
            low = gram_hashes(codes, n - 1)[at][first] if n > 1 else None
            orders[n - 1] = (keys, ctx, low, c)
        raw.append(orders)
    floor = -np.log(len(letters) + 1.0)
    model = Model(langs, [], [], [], [], floor)
    for n in range(1, ORDER + 1):
        everyone = [r[n - 1] for r in raw]
        keys = np.unique(np.concatenate([x[0] for x in everyone]))
        ctx_of, low_of = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
        for k, ctx, low, _ in everyone:
            at = np.searchsorted(keys, k)
            ctx_of[at] = ctx
            if low is not None:
                low_of[at] = low
        ctxs = np.unique(np.concatenate([x[1] for x in everyone]))
        prob, back = np.zeros((len(keys), len(langs))), np.zeros((len(ctxs), len(langs)))
        for j, (k, ctx, _, c) in enumerate(everyone):
            ones, twos = (c == 1).sum(), (c == 2).sum()
            discount = min(0.95, max(0.1, ones / max(1.0, ones + 2.0 * twos)))
            ci = np.searchsorted(ctxs, ctx)
            total = np.bincount(ci, weights=c, minlength=len(ctxs))
            kinds = np.bincount(ci, minlength=len(ctxs))
            lam = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            back[:, j] = lam
            prob[np.searchsorted(keys, k), j] = np.maximum(c - discount, 0) / total[ci]
        if n == 1:
            lower = np.full((len(keys), len(langs)), np.exp(floor))
        else:
            lower = np.exp(model.logp[-1][np.searchsorted(model.grams[-1], low_of)].astype(np.float64))
        prob += back[np.searchsorted(ctxs, ctx_of)] * lower
        model.grams.append(keys)
        model.logp.append(np.log(prob).astype(np.float32))
        if n > 1:
            model.ctxs.append(ctxs)
            model.back.append(np.log(back).astype(np.float32))
        else:
            model.floor = float(floor + np.log(back[0]).mean())
    return model


def batch_scores(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text the summed log probabilities, the number of predicted characters (0: no letter), the
    summed log probability of each word in its own best language (high in a mixture of known languages), and the number of
    characters of its distinct words (repeats are no further evidence). Tokens with digits count only where a text has no other letters."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    coded = pc.list_flatten(lists).dictionary_encode()
    names = coded.dictionary.to_pylist()
    runs = [LETTERS.findall(t) for t in names]  # a token's letter runs are its words
    words = sorted({w for r in runs for w in r})
    index = {w: i for i, w in enumerate(words)}
    by_word = model.score_words(words)
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    flat = np.fromiter((index[w] for r in runs for w in r), np.int64)
    owner = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
    width = len(model.langs) + 2
    by_token = np.zeros((len(runs), width))
    if len(flat):
        np.add.at(by_token, owner, np.column_stack([by_word, sizes, by_word.max(axis=1)])[flat])
    mixed = np.fromiter((DIGIT.search(t) is not None for t in names), bool, len(names))
    tokens = coded.indices.to_numpy(zero_copy_only=False)
    offsets = np.asarray(lists.offsets)
    offsets = offsets - offsets[0]
    plain, other = np.zeros((len(texts), width)), np.zeros((len(texts), width))
    full = np.flatnonzero(np.diff(offsets))
    for out, which in ((plain, ~mixed), (other, mixed)):
        if len(full) and which.any():
            for j in range(width):
                out[full, j] = np.add.reduceat((by_token[:, j] * which)[tokens], offsets[full])
    bare = plain[:, -2] == 0
    plain[bare] = other[bare]
    text_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    pairs = np.unique(text_of * len(names) + tokens) if len(tokens) else np.zeros(0, np.int64)
    of, token = pairs // max(1, len(names)), pairs % max(1, len(names))
    used = np.where(mixed[token], bare[of], True)
    distinct = np.bincount(of, by_token[token, -2] * used, len(texts)) if len(pairs) else np.zeros(len(texts))
    return plain[:, :-2], plain[:, -2], plain[:, -1], distinct


def excess(model: Model, logp: np.ndarray, chars: np.ndarray, envelope: np.ndarray, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best language of each text and its excess over that language's calibration texts, in spreads."""
    n = np.maximum(chars, 1)
    best = logp.argmax(axis=1)
    allowed = np.sqrt(model.spread[best] ** 2 / np.maximum(distinct, 1) + (SLACK * model.mean[best]) ** 2)
    return best, (-envelope / n - model.mean[best]) / allowed


def calibrate(model: Model, texts: list[str], lang: list[str]) -> None:
    """Mean, spread and limit from texts that the model was not fitted on."""
    scores = [batch_scores(model, pa.array(texts[k : k + 512], pa.string())) for k in range(0, len(texts), 512)]
    logp, chars, envelope, distinct = (np.concatenate(x) for x in zip(*scores, strict=True))
    own = np.array([model.langs.index(x) for x in lang])
    model.mean, model.spread = np.ones(len(model.langs)), np.ones(len(model.langs))
    seen = chars > 0
    for j in np.unique(own[seen]):
        mine = seen & (own == j)
        h, n = -envelope[mine] / chars[mine], distinct[mine]
        model.mean[j] = np.average(h, weights=n)
        model.spread[j] = np.sqrt(np.median((h - model.mean[j]) ** 2 * n) / 0.455)
    inside = excess(model, logp[seen], chars[seen], envelope[seen], distinct[seen])[1]
    outside = [np.zeros(0)]
    for j in np.unique(own[seen]) if len(model.langs) > 1 else []:
        mine = [t for t, o, s in zip(texts, own, seen, strict=True) if o == j and s]
        rest = model.without(int(j))
        outside.append(excess(rest, *batch_scores(rest, pa.array(mine, pa.string())))[1])
    low, high = float(np.quantile(inside, KEEP)) if len(inside) else 0.0, np.concatenate(outside)
    far = float(np.quantile(high, 0.05)) if len(high) else low
    model.limit = max(LEAST_Z, 1.5 * low, math.sqrt(low * far) if far > low > 0 else 0.0)
    model.missed = float((high <= model.limit).mean()) if len(high) else 0.0


def decide(model: Model, logp: np.ndarray, chars: np.ndarray, envelope: np.ndarray, distinct: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score in 0..1 (posterior, tempered by the square root of the length) and rejection of each text."""
    n = np.maximum(chars, 1)
    h = -logp / n[:, None]
    gap = (h - h.min(axis=1, keepdims=True)) * np.sqrt(n)[:, None] * 2
    score = np.where(chars > 0, 1 / np.exp(-gap).sum(axis=1), 0.0)
    best, over = excess(model, logp, chars, envelope, distinct)
    rejected = (chars == 0) | (over > model.limit)
    return [model.langs[i] if c else UNKNOWN for i, c in zip(best, chars, strict=True)], score, rejected


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = [LETTERS.findall((t.as_py() or "").lower()) for t in b.column("text")]
        lang = np.repeat(np.array(b.column("lang").to_pylist(), object), [len(x) for x in lists])
        if len(lang):
            yield pa.record_batch([pa.array(lang, pa.string()), pa.array([w for x in lists for w in x], pa.string())], ["lang", "word"])


def sample(labelled: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """``text, lang, fit`` of about ``per_lang`` rows of each language, by hash of ``doc_id``; ``fit`` is false for a third of them, for calibration."""
    n = labelled.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MOST_LANGS).collect()
    share = F.lit(0.0)
    for lang, rows in n:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_lang / rows))).otherwise(share)
    place = lambda salt: F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id").cast("string")), F.lit(2**31)) / 2.0**31
    return labelled.filter(place("sample") < share).select("text", "lang", (place("fold") >= 1 / 3).alias("fit"))


def train(labelled: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """Fit and calibrate on ``labelled(doc_id, text, lang)``."""
    known = labelled.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    rows = materialize(sample(known, per_lang), "sample")
    words = rows.filter("fit").select("text", "lang").mapInArrow(_word_counts, "lang string, word string").groupBy("lang", "word").count()
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("count").desc(), "word"))
    words = words.withColumn("n", first).filter(F.col("n") <= MOST_WORDS).toPandas()  # bounded by MOST_LANGS and MOST_WORDS
    if not len(words):
        return None
    model = fit({lang: dict(zip(x["word"], x["count"].astype(int), strict=True)) for lang, x in words.groupby("lang")})
    held = rows.filter("not fit").filter(F.col("lang").isin(model.langs)).select("text", "lang").collect()  # bounded by MOST_LANGS and per_lang
    if held:
        calibrate(model, [r.text for r in held], [r.lang for r in held])
    else:
        model.mean, model.spread, model.limit = np.zeros(len(model.langs)), np.ones(len(model.langs)), math.inf
    return model


def _predict(model: Model | None, columns: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                if model is None:
                    lang, score, rejected = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows), np.ones(part.num_rows, bool)
                else:
                    lang, score, rejected = decide(model, *batch_scores(model, part.column("text")))
                yield pa.record_batch([*(part.column(c) for c in columns), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*columns, *names])

    return run


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train_split(docs: DataFrame) -> Model | None:
    """The model of the query's contract: text and lang of the rows that are not held out."""
    return train(docs.filter(~held_out(F.col("doc_id"))))


def predict(docs: DataFrame, model: Model | None, columns: list[str], prefix: str = "") -> DataFrame:
    """``columns`` of ``docs`` with ``lang_pred, score, rejected`` (each after ``prefix``); ``docs`` has a string ``text``."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = [prefix + x for x in ("lang_pred", "score", "rejected")]
    added = (f"`{n}` {k}" for n, k in zip(names, ("string", "double", "boolean"), strict=True))
    return docs.mapInArrow(_predict(model, columns, names), ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), *added]))


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that language ID rejects; columns unchanged, no shuffle."""
    model = train_split(docs)
    names = docs.columns
    return predict(docs, model, names, P).filter(~F.col(P + "rejected")).select(*[f"`{n}`" for n in names])


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(docs.select("doc_id", "text"), train_split(docs), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
