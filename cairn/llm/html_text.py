"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one labels a block by its place (inside
navigation, header, footer, aside, form, advert, notice or comment containers: bad) and by
length, link density and stop-word density (good, bad, near-good, short). Pass two gives
short and near-good blocks the label of the nearest decided neighbours; where both sides differ
a near-good block stays and a short one goes.

Class names and ids are one signal of place: a whole name says what a container is by its first or last part (``ad``, ``site-footer``),
unless another part speaks of layout (``has-sidebar``, ``page-with-nav``), and no name counts on a container around the main article.

An <article> is evidence, not a verdict: the one with most text outside bad containers is the main article where it holds
at least as many code points as the good blocks outside it. A block in it that only its stop words make bad is near-good, a near-good one
is good, its edge counts as a good neighbour for blocks within and as a bad one for
those without, and containers set into it (adverts) say nothing about the blocks around them. Length,
link density and neighbours decide there as elsewhere; other articles (teasers) have no such evidence.

Defined cases: null html is the empty page with empty text; unclosed and stray tags end with
their container, at a cost that grows with the page alone however deep they are; a very long page is read whole; repeated rows are
extracted each; extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_LINK_DENSITY = 0.2
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOPWORDS_LOW, STOPWORDS_HIGH = 0.15, 0.25

#: Common function words of the languages the engine meets (fixed values).
STOPWORDS = frozenset(
    "the of and to in a is that for it was on are as with at be this from or an by not but had his they have you which we "
    "de la le et les des en un une du dans est que pour qui sur au pas par plus il avec ce se ne son elle "
    "der die und das den von zu mit ist des sich dem nicht ein eine auf für als auch es er sie nach wird bei "
    "el los las del y por con una su para al lo como más pero sus este o no si sin sobre entre".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")

RAW = frozenset("script style template noscript textarea title iframe object svg math canvas select option".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AUTO_CLOSE = {"p": frozenset(["p"]), "li": frozenset(["li"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tr": frozenset(["tr", "td", "th"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"])}
BAD_TAGS = frozenset("nav footer aside form button menu dialog fieldset label".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion teaser cookie cookies consent gdpr notice notification "
    "alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets related recommended recommendations share sharing social "
    "comment comments commentlist disqus reply replies respond footer topbar toolbar pagination pager subscribe newsletter signup login copyright disclaimer".split()
)
#: Bad unless another part of the name says that it is part of an article.
DOUBTFUL_WORDS = frozenset("banner header masthead foot side search legal follow tags toc skip".split())
BODY_WORDS = frozenset("article post story entry main content".split())
#: Parts that make a name one of layout or subject.
LAYOUT_WORDS = frozenset("has with without no not free page layout body wrapper grid columns col row container is theme news".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw and not raw.isspace() else {}


def _is_bad(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Does the tag, its role or its state make a container bad?"""
    if tag in BAD_TAGS or attrs.get("role", "").lower() in BAD_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    return tag == "header" and not in_article


def _bad_name(attrs: dict[str, str]) -> bool:
    """Does a class name or the id, taken whole, make a container bad?"""
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        parts = [x.lower() for x in _PARTS.findall(name)]
        if not parts or LAYOUT_WORDS & set(parts):
            continue
        ends = {parts[0], parts[-1]}
        if ends & BAD_WORDS or ends & DOUBTFUL_WORDS and not BODY_WORDS & set(parts):
            return True
    return False


class Block(NamedTuple):
    text: str
    linked: int  # code points in links
    article: int  # number of the outermost article, or 0
    bad: bool  # in a bad container
    heading: str  # the heading tag, or ''


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order; containers that are bad by name alone do not count around the main article."""
    out: list[tuple[Block, tuple[int, ...]]] = []
    text: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool, bool, int]] = []  # tag, bad, article, named, block tags below
    open_: dict[str, list[int]] = defaultdict(list)  # places of the open tags of each name
    named: list[int] = []  # numbers of the open containers with a bad name
    around: dict[int, tuple[int, ...]] = {}  # those around each article
    n_bad = n_article = n_links = n_blocks = articles = names = 0
    heading = ""

    def flush() -> None:
        nonlocal linked
        if text:
            whole = _SPACE.sub(" ", _html.unescape("".join(text))).strip()
            if whole:
                out.append((Block(whole, linked, articles if n_article else 0, n_bad > 0, heading), tuple(named)))
            text.clear()
        linked = 0

    def pop() -> str:
        nonlocal n_bad, n_article, n_links, n_blocks, heading
        tag, bad, art, is_named, _ = stack.pop()
        open_[tag].pop()
        n_bad -= bad
        n_article -= art
        n_links -= tag == "a"
        n_blocks -= tag in BLOCK
        if is_named:
            named.pop()
        if tag == heading:
            heading = ""
        return tag

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            piece = page[at:stop]
            text.append(piece)
            if n_links:
                linked += len(_html.unescape(piece).strip())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_[tag]:
                if tag in BLOCK or tag in BAD_TAGS:
                    flush()
                # an inline end tag does not close the blocks around it
                if tag not in BLOCK and n_blocks > stack[open_[tag][-1]][4]:
                    continue
                while pop() != tag:
                    pass
            elif tag in ("p", "br"):
                flush()
            continue
        if tag in RAW:
            if not m[0].endswith("/>"):
                close = _closing(tag).search(page, at)
                at = close.end() if close else end
            continue
        if tag in BLOCK or tag in BAD_TAGS:
            flush()
        if tag in VOID or m[0].endswith("/>"):
            continue
        if tag in AUTO_CLOSE:
            while stack and stack[-1][0] in AUTO_CLOSE[tag] or stack and stack[-1][0] not in BLOCK and any(x[0] in AUTO_CLOSE[tag] for x in stack[-4:]):
                pop()
        attrs = _attributes(m[3])
        bad = _is_bad(tag, attrs, n_article > 0)
        art = tag == "article" or attrs.get("itemprop", "").lower() == "articlebody"
        if art and not n_article:
            articles += 1
            around[articles] = tuple(named)
        is_named = tag not in ("html", "body") and _bad_name(attrs)
        if is_named:
            names += 1
            named.append(names)
        stack.append((tag, bad, art, is_named, n_blocks))
        open_[tag].append(len(stack) - 1)
        n_blocks += tag in BLOCK
        n_bad += bad
        n_article += art
        n_links += tag == "a"
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = tag
    flush()
    sizes: dict[int, int] = defaultdict(int)
    for b, inside in out:
        if b.article and not b.bad and b.linked <= MAX_LINK_DENSITY * len(b.text) and len(inside) == len(around[b.article]):
            sizes[b.article] += len(b.text)
    main = max(sizes, key=lambda k: (sizes[k], -k), default=0)
    spared = set(around.get(main, ()))
    return [b._replace(bad=b.bad or any(x not in spared for x in inside), article=b.article if b.article == main else 0) for b, inside in out]


@cache
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def classify(block: Block) -> str:
    """First pass: good, near, short or bad."""
    text, linked, _, bad, _ = block
    if bad or linked > MAX_LINK_DENSITY * len(text):
        return "bad"
    if "\xa9" in text and len(text) < LENGTH_HIGH:
        return "bad"
    words = text.lower().split()
    density = sum(w.strip(".,;:!?()\"'") in STOPWORDS for w in words) / len(words)
    if len(text) < LENGTH_LOW:
        return "short"
    if density >= STOPWORDS_HIGH:
        return "good" if len(text) > LENGTH_HIGH else "near"
    return "near" if density >= STOPWORDS_LOW else "bad"


def settle(kinds: list[str], headings: list[str], inside: list[int] | None = None) -> list[bool]:
    """Second pass: which blocks are text. ``inside`` numbers the article with evidence that a block is in (0: none)."""
    n = len(kinds)
    inside = inside or [0] * n

    def nearest(order: range) -> list[str]:
        out, seen, place = [""] * n, "bad", 0
        for i in order:
            if inside[i] != place:
                seen, place = "good" if inside[i] else "bad", inside[i]
            out[i] = seen
            seen = kinds[i] if kinds[i] in ("good", "bad") else seen
        return out

    before, after = nearest(range(n)), nearest(range(n - 1, -1, -1))
    out = []
    for kind, a, b, h in zip(kinds, before, after, headings, strict=True):
        if kind in ("good", "bad"):
            out.append(kind == "good")
        elif kind == "set in":
            out.append(False)
        elif h and b == "good":  # a heading belongs to what follows
            out.append(True)
        else:
            out.append(a == b == "good" or (kind == "near" and "good" in (a, b)))
    return out


def with_evidence(found: list[Block], kinds: list[str]) -> tuple[list[str], list[int]]:
    """The labels of pass one with the evidence of articles, and the article with evidence of each block (or 0)."""
    outside, within = 0, 0
    for (text, linked, article, bad, _), kind in zip(found, kinds, strict=True):
        if article:
            within += 0 if bad or linked > MAX_LINK_DENSITY * len(text) else len(text)
        elif kind == "good":
            outside += len(text)
    if within < outside or not within:
        return kinds, [0] * len(kinds)
    out = []
    for (text, linked, article, bad, _), kind in zip(found, kinds, strict=True):
        if article and bad:
            kind = "set in"
        elif article and kind == "near":
            kind = "good"
        elif article and kind == "bad" and linked <= MAX_LINK_DENSITY * len(text) and not ("\xa9" in text and len(text) < LENGTH_HIGH):
            kind = "near"
        out.append(kind)
    return out, [b[2] for b in found]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    kinds, inside = with_evidence(found, [classify(b) for b in found])
    keep = settle(kinds, [b[4] for b in found], inside)
    return " ".join(b[0] for b, k in zip(found, keep, strict=True) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            texts = [main_text(h.as_py()) for h in part.column("html")]
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row of ``pages(page_id, url, html)``: the main text and its code points. No shuffle."""
    slim = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return slim.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
