"""Secret scans with multipart credential linking.

Base spans come from three patterns (assignments, access identifiers, hex runs). Around them the
scan collects parts that mean little alone: identifiers (``user``, ``account``, ``client id``
assignments), endpoints (URLs and host names with a port) and weak secrets (long mixed tokens
without a keyword). An interval join inside a scope (a paragraph, and at most ``REACH`` code
points between two parts) links each part to the parts of complementary kinds near it; a weak
candidate is reported only when all three roles are filled by parts near it: who (an identifier or access key), what (a
secret-like part) and where (an endpoint; an access key fills this role too, since its form names its provider). The join is a sweep over the sorted spans of a document, so a document
with very many parts costs its number of parts, not of pairs.

Defined cases: null text is the empty text; repeated rows are scanned each; a very long text is scanned whole; extra columns are
ignored, whatever their names; ``doc_id`` may be of any type; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "user", "endpoint", "weak")
BASE = ("assign", "access", "hex")
REACH = 200

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # greedy: the whole run, as of any length and then kept from 24 on
_USER = re.compile(r"""(?<![A-Za-z0-9])(?:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{3,})""", re.ASCII | re.IGNORECASE)
_ENDPOINT = re.compile(r"(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|amqp|mongodb)://[^\s\"'<>]+|(?<![\w.-])(?:[a-z0-9-]+\.)+[a-z]{2,}:[0-9]{2,5}(?![0-9])", re.ASCII)
_WEAK = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")

#: A text without any of these has no base span and no endpoint, and a weak candidate needs one of them.
_WORTH = r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]|AKIA[A-Z0-9]|[0-9a-f]{24}|://|[a-z]:[0-9]{2}"


def _looks_random(s: str) -> bool:
    """Digits and letters of both cases, or digits with letters in over a fifth of the places."""
    digits = sum(c.isdigit() for c in s)
    upper = sum(c.isupper() for c in s)
    lower = sum(c.islower() for c in s)
    return digits > 0 and ((upper > 0 and lower > 0) or (digits * 5 >= len(s) and upper + lower > 0))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping per kind."""
    spans = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def linked_spans(text: str, base: list[tuple[int, int, str]], reach: int = REACH) -> list[tuple[int, int, str]]:
    """Base spans and the weak parts that complement each other or a base span."""
    parts = [(m.start(), m.end(), "user") for m in _USER.finditer(text)]
    parts += [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
    starts = [s for s, _, _ in base]
    stops = [e for _, e, _ in sorted(base, key=lambda s: s[1])]
    taken = sorted(parts)

    def inside(lo: int, hi: int) -> bool:
        return bisect_left(starts, hi) > bisect_right(stops, lo) or any(s < hi and e > lo for s, e, _ in taken[max(0, bisect_left(taken, (lo,)) - 1) : bisect_left(taken, (hi,))])

    if base or parts:
        parts += [(m.start(), m.end(), "weak") for m in _WEAK.finditer(text) if _looks_random(m[0]) and not inside(m.start(), m.end())]
    everything = sorted([*base, *parts])
    if not everything:
        return []
    breaks = [m.start() for m in re.finditer(r"\n\s*\n", text)]
    scope = [bisect_left(breaks, s) for s, _, _ in everything]
    near: list[set[str]] = [set() for _ in everything]
    last: dict[str, tuple[int, int]] = {}
    for forward in (True, False):  # the nearest part of each kind on either side decides what is in reach
        last.clear()
        order = range(len(everything)) if forward else range(len(everything) - 1, -1, -1)
        for i in order:
            s, e, kind = everything[i]
            for other, (edge, sc) in last.items():
                if sc == scope[i] and (s - edge if forward else edge - e) <= reach:
                    near[i].add(other)
            mark = e if forward else s
            if kind in last and last[kind][1] == scope[i]:
                mark = max(mark, last[kind][0]) if forward else min(mark, last[kind][0])
            last[kind] = (mark, scope[i])
    out = list(base)
    for (s, e, kind), by in zip(everything, near, strict=True):
        has = by | {kind}
        complete = has & {"user", "access"} and has & {"assign", "hex", "weak"} and has & {"endpoint", "access"}
        if kind not in BASE and complete:
            out.append((s, e, kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


NOTHING = hashlib.sha256(b"").hexdigest()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            part = b.slice(at, 1024)
            texts = pc.fill_null(part.column("text"), "")
            worth = pc.match_substring_regex(texts, _WORTH).to_pylist()
            n = {k: [0] * part.num_rows for k in BASE}
            digest, spans = [NOTHING] * part.num_rows, [""] * part.num_rows
            for i, w in enumerate(worth):
                if not w:
                    continue
                text = texts[i].as_py()
                base = base_spans(text)
                for _, _, k in base:
                    n[k][i] += 1
                digest[i] = hashlib.sha256(_join(base).encode()).hexdigest()
                spans[i] = _join(linked_spans(text, base))
            yield pa.record_batch([part.column("doc_id"), *(pa.array(n[k], pa.int64()) for k in BASE), pa.array(digest), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: counts of base spans, their digest, and all spans. No shuffle."""
    slim = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"))
    return slim.mapInArrow(_scan, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
