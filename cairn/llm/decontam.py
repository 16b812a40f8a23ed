"""Benchmark decontamination: CGK walks, bit-sampling LSH over item-sized windows, exact edit check.

Texts and items are word sequences (lower-cased runs of letters and digits), and edits are insertions, deletions
and replacements of words. An item of ``n`` words is leaked in a text if it occurs there with at most
``MAX_EDITS * n`` edits (rounded down).

A CGK walk reads a sequence with one random bit per (step, word): it emits the word it stands on and moves on if the
bit says so (here two times in three), so that sequences at a small edit distance fall back into step after an edit and
emit the same words at most steps. A walk takes as many steps as cross the item, whatever its length. Each
repetition has its own bits and samples a few steps from anywhere in the walk; an item and a window whose sampled words
agree are a candidate. The repetitions are as many as ``TARGET`` recall needs at the largest number of edits.

Windows start at every ``stride``-th word of the text, where the stride is about a third of the item; the index holds the
walks of an item from each of its first ``stride`` words, so one of them starts at the very word a window starts at.
Two exact bounds save work and lose nothing that the final check accepts: a window can only hold an item if
enough of its words are words of the benchmark at all, and a candidate if enough of them are words of that item.

The index of a block of items is broadcast; a block is bounded by ``BLOCK_CHARS`` code points, and a larger benchmark
is searched block by block.

Defined cases: null and empty texts and items have no words and match nothing; repeated items are reported under
each id; repeated rows each; very long texts are walked in pieces of ``WINDOWS`` windows; extra columns are ignored (kept
by ``drop_leaks``, whatever their names); an empty table on either side gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UID, as_scan, materialize, with_uid

MAX_EDITS = 0.2
TARGET = 0.95
#: Share of the steps at which an item and a copy with ``MAX_EDITS`` edits agree, as measured on items of 14 to 60 words.
AGREE = 0.45
ADVANCE = 2 / 3
#: Expected false candidates a window that the choice of samples per repetition allows.
NOISE = 0.05
STEP_CLASS = 1.4
WINDOWS = 16_384
PAIRS = 500_000
BLOCK_CHARS = 20_000_000
TABLE_BYTES = 200_000_000
WORD = re.compile(r"[^\W_]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    return x ^ (x >> np.uint64(27))


def stride_of(words: int) -> int:
    """The largest power of two that is at most a third of the item, one at least."""
    return 1 << max(0, (words // 3).bit_length() - 1)


def step_class(steps: float) -> int:
    """The largest length of a walk in the classes 1, 2, 3, 4, 5, 7, 9, 12, 16, ... that is at most ``steps``."""
    s = 1
    while (more := max(s + 1, int(s * STEP_CLASS))) <= steps:
        s = more
    return s


class Index:
    """CGK/LSH tables of a block of items."""

    def __init__(self, items: list[tuple[int, str]], seed: int = 7, target: float = TARGET):
        self.vocab: dict[str, int] = {}
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        for item, text in items:
            found = WORD.findall((text or "").lower())
            if found:
                self.ids.append(item)
                self.words.append(np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in found], np.int64))
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.most = (MAX_EDITS * self.size).astype(np.int64)
        self.stride = np.array([stride_of(n) for n in self.size.tolist()], np.int64)
        self.steps = np.array([step_class((n - t + 1) / ADVANCE) for n, t in zip(self.size.tolist(), self.stride.tolist(), strict=True)], np.int64)
        #: (steps, stride) of the classes of items, with the fewest words of any of them and the widest reach
        self.classes = sorted(set(zip(self.steps.tolist(), self.stride.tolist(), strict=True)))
        rng = np.random.default_rng(seed)
        self.seed = int(rng.integers(1, 2**62))
        n = len(self.vocab) + 1
        self.vocab_hashes = _mix(np.arange(1, n + 1, dtype=np.uint64) * _M1)
        starts = sum(self.stride.tolist())
        seen = np.bincount(np.concatenate(self.words), minlength=n) if self.words else np.zeros(n)
        clash = float(((seen / max(1, seen.sum())) ** 2).sum())
        self.samples = 2
        while self.words and self.samples < 8 and starts * clash**self.samples > NOISE:
            self.samples += 1
        self.repetitions = math.ceil(math.log(1 - target) / math.log(1 - AGREE**self.samples))
        self.picks = [[np.sort(rng.choice(s, min(s, self.samples), replace=False)) for s, _ in self.classes] for _ in range(self.repetitions)]
        self._build()

    def _build(self) -> None:
        """Keys of the walks of all items from each of their first ``stride`` words, sorted, per repetition."""
        longest = max((s for s, _ in self.classes), default=0)
        flat = np.concatenate([np.append(w, np.zeros(longest + 1, np.int64)) for w in self.words]) if self.words else np.zeros(0, np.int64)
        begin = np.cumsum(np.array([0] + [len(w) + longest + 1 for w in self.words]))[:-1]
        item = np.repeat(np.arange(len(self.words)), self.stride)
        offset = np.arange(len(item)) - np.repeat(np.cumsum(self.stride) - self.stride, self.stride)
        of = {c: k for k, c in enumerate(self.classes)}
        cls = np.array([of[c] for c in zip(self.steps.tolist(), self.stride.tolist(), strict=True)], np.int64)
        order = np.argsort(-self.steps[item], kind="stable")
        item, offset = item[order], offset[order]
        which = [np.flatnonzero(cls[item] == k) for k in range(len(self.classes))]
        self.tables = []
        for r in range(self.repetitions if self.words else 0):
            rows, keys = [], []
            for k, key, known in self.signatures(flat, begin[item] + offset, self.steps[item], which, r):
                rows.append(which[k][known])
                keys.append(key[known])
            rows, keys = np.concatenate(rows), np.concatenate(keys)
            by = np.argsort(keys, kind="stable")
            self.tables.append((keys[by], item[rows[by]], offset[rows[by]]))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def bits(self, r: int, steps: int) -> np.ndarray:
        """(steps, vocabulary): whether walk ``r`` moves on from a word."""
        cache = self.__dict__.setdefault("_bits", {})
        if r not in cache or len(cache[r]) < steps:
            out = np.empty((steps, len(self.vocab_hashes)), np.int8)
            for j in range(steps):
                salt = _mix(np.array([(self.seed + r * 1_000_003 + j * 7919) % 2**64], np.uint64) * _M1)
                out[j] = _mix(self.vocab_hashes ^ salt) % np.uint64(3) != 0
            if self.repetitions * out.size > TABLE_BYTES:
                return out
            cache[r] = out
        return cache[r]

    def signatures(self, flat: np.ndarray, at: np.ndarray, steps: np.ndarray, which: list[np.ndarray], r: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Walk ``r`` from the places ``at`` (longest walks first) of ``flat``: for each class its number, and for the
        places ``which[class]`` a hash of the sampled words and whether all of them are words of the benchmark."""
        at = at.copy()
        emitted, move = np.empty_like(at), np.empty(len(at), np.int8)
        picks = self.picks[r]
        keys = [np.full(len(w), np.uint64(s * 64 + t)) for w, (s, t) in zip(which, self.classes, strict=True)]
        known = [np.ones(len(w), bool) for w in which]
        used = [0] * len(which)
        last = max((int(p[-1]) for p, w in zip(picks, which, strict=True) if len(w)), default=-1)
        table = self.bits(r, last + 1)
        falling = -steps
        for j in range(last + 1):
            n = int(np.searchsorted(falling, -j, side="left"))  # walks of more than j steps
            np.take(flat, at[:n], out=emitted[:n], mode="clip")
            for k, w in enumerate(which):
                if len(w) and used[k] < len(picks[k]) and picks[k][used[k]] == j:
                    word = emitted[w]
                    known[k] &= word > 0
                    keys[k] = _mix((keys[k] ^ word.astype(np.uint64)) * _M1)
                    used[k] += 1
            np.take(table[j], emitted[:n], out=move[:n], mode="clip")
            at[:n] += move[:n]
        for k, w in enumerate(which):
            if len(w):
                yield k, keys[k], known[k]

    def windows(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Starts of the windows that have enough words of the benchmark and their longest walks, by falling length, and those of each class."""
        total = np.concatenate([[0], np.cumsum(flat > 0)])
        at = np.arange(0, len(flat), min((t for _, t in self.classes), default=1))
        want, fits = np.zeros(len(at), np.int64), []
        for steps, stride in self.classes:
            mine = (self.steps == steps) & (self.stride == stride)
            need = int((self.size - self.most)[mine].min())
            reach = int((self.size + self.most)[mine].max())
            inside = total[np.minimum(at + reach, len(flat))] - total[np.maximum(at - stride + 1, 0)]
            ok = (at % stride == 0) & (inside >= need)
            want[ok] = np.maximum(want[ok], steps)
            fits.append(ok)
        order = np.argsort(-want, kind="stable")
        order = order[: int((want > 0).sum())]
        return at[order], want[order], [np.flatnonzero(ok[order]) for ok in fits]

    def candidates(self, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, item, first word) that share the sampled words of a repetition and enough words, as two arrays: rows and (item, place in ``flat``)."""
        ends = np.append(starts[1:], len(flat))
        found = []
        if not len(self.words) or not len(flat):
            return np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        places, want, fits = self.windows(flat)
        shift = int(self.stride.max())  # an item may start so many words before its window
        width = len(flat) + shift
        for lo in range(0, len(places), WINDOWS):
            hi = min(lo + WINDOWS, len(places))
            part = [f[np.searchsorted(f, lo) : np.searchsorted(f, hi)] - lo for f in fits]
            pairs = [np.zeros(0, np.int64)]
            for r in range(self.repetitions):
                table, items, offsets = self.tables[r]
                sieve = self._sieve(r)
                for k, key, known in self.signatures(flat, places[lo:hi], want[lo:hi], part, r):
                    hit = np.flatnonzero(known & sieve[(key & np.uint64(len(sieve) - 1)).astype(np.int64)])
                    left = np.searchsorted(table, key[hit])
                    n = np.searchsorted(table, key[hit], side="right") - left
                    for a, b in _slices(n):
                        of = np.repeat(np.arange(a, b), n[a:b])
                        row = left[of] + np.arange(len(of)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
                        pairs.append(items[row] * width + (places[lo + part[k][hit[of]]] - offsets[row] + shift))
                        if sum(map(len, pairs)) > PAIRS:
                            found.append(self._plausible(flat, starts, ends, np.unique(np.concatenate(pairs)), width, shift))
                            pairs = [np.zeros(0, np.int64)]
            found.append(self._plausible(flat, starts, ends, np.unique(np.concatenate(pairs)), width, shift))
        if not found:
            return np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        rows = np.unique(np.concatenate(found), axis=0)
        return rows[:, 0], rows[:, 1:]

    def _sieve(self, r: int) -> np.ndarray:
        cache = self.__dict__.setdefault("_sieves", {})
        if r not in cache:
            keys = self.tables[r][0]
            sieve = np.zeros(1 << max(12, (32 * len(keys)).bit_length()), bool)
            sieve[(keys & np.uint64(len(sieve) - 1)).astype(np.int64)] = True
            cache[r] = sieve
        return cache[r]

    def _plausible(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, pairs: np.ndarray, width: int, shift: int) -> np.ndarray:
        """(row, item, first word) of those candidates whose reach holds enough words of the item (an upper bound by hash)."""
        item, start = pairs // width, pairs % width - shift
        # a window may begin in the row before: the row is that of the window's own start, the place after the item's offset
        doc = np.searchsorted(starts, np.minimum(start + self.stride[item] - 1, len(flat) - 1), side="right") - 1
        most, need = self.most[item], (self.size - self.most)[item]
        lo, hi = np.maximum(start - most, starts[doc]), np.minimum(start + self.size[item] + most, ends[doc])
        live = np.argsort(lo - hi, kind="stable")  # the widest first
        live = live[(hi - lo)[live] >= need[live]]
        count = np.zeros(len(item), np.int64)
        member, row = self._members()
        for j in range(int((hi - lo)[live[:1]].max(initial=0))):
            if j % 8 == 0:  # those that the rest of their words can still make plausible
                live = live[count[live] + (hi - lo)[live] - j >= need[live]]
                live = live[(hi - lo)[live] > j]
                at, base = lo[live], item[live] * row
            inside = at + j < hi[live]
            word = flat[np.minimum(at + j, len(flat) - 1)]
            count[live] += member(base, word) & inside
        good = count >= need
        return np.stack([doc, item, start], axis=1)[good]

    def _members(self):
        """A function of ``item * row`` and word that says whether the item has the word (by hash, and at times wrongly yes, where a table would be large), and ``row``."""
        if "_member" not in self.__dict__:
            row = len(self.vocab) + 1
            own = np.concatenate([i * row + w for i, w in enumerate(self.words)])
            if len(self.words) * row <= TABLE_BYTES:
                table = np.zeros(len(self.words) * row, bool)
                table[own] = True
                self._member = lambda base, word: table[base + word]
            else:
                table = np.zeros(1 << max(16, (16 * len(own)).bit_length()), bool)
                place = lambda x: (_mix(x.astype(np.uint64) * _M1) & np.uint64(len(table) - 1)).astype(np.int64)
                table[place(own)] = True
                self._member = lambda base, word: table[place(base + word)] & (word > 0)
        return self._member, len(self.vocab) + 1


def _slices(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of the entries of ``n`` whose sum is about ``PAIRS`` at most."""
    total = np.cumsum(n)
    a = 0
    while a < len(n) and total[-1] > (total[a - 1] if a else 0):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, side="right")))
        yield a, b
        a = b


def best_edit(pattern, text) -> tuple[int, int]:
    """Smallest edit distance of ``pattern`` to a run of ``text``, and the end of the first best one (bit-parallel)."""
    m = len(pattern)
    peq: dict = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def verify(index: Index, item: int, codes: list[int], places: list[int]) -> tuple[int, int, int] | None:
    """(edits, first word, end word) of the item's best occurrence near one of the sorted places, if it is near enough."""
    n, most = int(index.size[item]), int(index.most[item])
    pattern = index.words[item].tolist()
    best = None
    k = 0
    while k < len(places):
        lo = hi = max(0, places[k])
        while k < len(places) and places[k] <= hi + n:
            hi = max(hi, places[k])
            k += 1
        lo = max(0, lo - most)
        region = codes[lo : hi + n + most]
        edits, end = best_edit(pattern, region)
        if edits <= most and (best is None or edits < best[0]):
            begin = end - best_edit(pattern[::-1], region[:end][::-1][: n + most])[1]
            best = (edits, lo + begin, lo + end)
    return best


def _search(index: Index, rows: int = 500):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = index.vocab.get
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                texts = part.column("text")
                found_words = [WORD.findall(t.lower()) if t else [] for t in texts.to_pylist()]
                sizes = np.array([len(w) for w in found_words])
                flat = np.fromiter(map(get, chain.from_iterable(found_words), repeat(0)), np.int64, int(sizes.sum()))
                del found_words
                # rows without words share the start of the next one; searchsorted must find the row that has words
                full = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[full]
                row, pairs = index.candidates(flat, starts)
                found: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
                for r, (i, p) in zip(row.tolist(), pairs.tolist(), strict=True):
                    found[r][i].append(p - int(starts[r]))
                out: list[tuple] = []
                for r, by_item in found.items():
                    k = int(full[r])
                    codes = flat[starts[r] : starts[r] + sizes[k]].tolist()
                    hits = [(i, hit) for i, ps in by_item.items() if (hit := verify(index, i, codes, sorted(ps)))]
                    if not hits:
                        continue
                    marks = [(m.start(), m.end()) for m in WORD.finditer(texts[k].as_py())]
                    same = len(marks) == len(codes)  # lower-casing can change the words of rare scripts
                    for i, (edits, lo, hi) in hits:
                        span = (marks[lo][0], marks[max(lo, hi - 1)][1]) if same else (-1, -1)
                        out.append((part.column(UID)[k].as_py(), part.column("doc_id")[k].as_py(), index.ids[i], edits, int(index.size[i]), *span))
                if out:
                    cols = [pa.array(c) if n == "doc_id" else pa.array(c, t) for c, (n, t) in zip(zip(*out, strict=True), _KINDS, strict=True)]
                    cols[1] = cols[1].cast(part.column("doc_id").type)
                    yield pa.record_batch(cols, [n for n, _ in _KINDS])

    return run


_KINDS = [(UID, pa.int64()), ("doc_id", None), ("item_id", pa.int64()), ("edits", pa.int32()), ("item_words", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per (row of ``docs``, benchmark item that occurs in it): ids, edits, and the span in code points. No shuffle of texts."""
    slim = with_uid(as_scan(docs)).select(UID, "doc_id", F.col("text").cast("string").alias("text"))
    schema = f"{UID} long, doc_id {slim.schema['doc_id'].dataType.simpleString()}, item_id long, edits int, item_words int, start int, end int"
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS) or 1
    found = None
    for k in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        index = Index([tuple(r) for r in mine.orderBy("item_id", "text").collect()])  # bounded by BLOCK_CHARS
        if index.words:
            part = slim.mapInArrow(_search(index), schema)
            found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows in which a benchmark item occurs; columns unchanged."""
    docs = as_scan(docs)
    leaky = materialize(find_leaks(docs, benchmark).select(UID).distinct(), "leaks")
    return with_uid(docs).join(leaky.hint("shuffle_hash"), UID, "left_anti").drop(UID)


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop(UID)
