"""An <article> is evidence for the block rules, not a verdict."""

import random
import re
import time

from cairn.llm import html_text

BODY = "The cat sat on the mat and it was in the house that they had for the winter of that year, " * 4


def test_main_text_beside_article_teasers():
    cards = "".join(f"<article><h3>Card {i}</h3><p>A teaser.</p></article>" for i in range(3))
    got = html_text.main_text(f"<body><div><h1>Story</h1><p>{BODY}</p><p>{BODY}</p></div>{cards}</body>")
    assert got.startswith("Story The cat") and got.count("winter") == 8
    assert "teaser" not in got


def test_link_list_in_an_article_goes():
    links = "".join(f'<li><a href="/{i}">Another story of the day {i}</a></li>' for i in range(5))
    got = html_text.main_text(f"<body><article><h1>Story</h1><p>{BODY}</p><p>Short one.</p><p>{BODY}</p><ul>{links}</ul></article></body>")
    assert got.startswith("Story The cat") and "Short one." in got
    assert "Another story" not in got


def test_names_of_layout_do_not_hide_the_article():
    for name in ("has-sidebar", "page-with-nav", "social-news", "related-layout", "alert-free", "no-footer", "main sidebar-container"):
        assert html_text.main_text(f'<body><div class="{name}"><article><p>{BODY}</p><p>Short one.</p></article></div></body>').endswith("Short one."), name
    for name in ("sidebar", "site-footer", "cookie-notice", "ad", "newsletter-signup", "related", "relatedPosts"):
        got = html_text.main_text(f'<body><article><p>{BODY}</p></article><div class="{name}"><p>{BODY}</p></div></body>')
        assert got.count("winter") == 4, name


def test_teasers_are_not_the_article():
    assert html_text.main_text('<article class="teaser"><p>Read me.</p></article>') == ""
    got = html_text.main_text(f"<body><article><p>{BODY}</p></article><article><h3>Next</h3><p>A teaser.</p></article></body>")
    assert got == BODY.strip()


def nearest(kinds, i, step):
    i += step
    while 0 <= i < len(kinds):
        if kinds[i] in ("good", "bad"):
            return kinds[i]
        i += step
    return "bad"


def test_second_pass_matches_a_search_for_neighbours():
    rng = random.Random(1)
    for _ in range(500):
        kinds = [rng.choice(["good", "bad", "near", "short"]) for _ in range(rng.randint(0, 12))]
        heads = [rng.choice(["", "", "h2"]) for _ in kinds]
        want = []
        for i, (k, h) in enumerate(zip(kinds, heads, strict=True)):
            a, b = nearest(kinds, i, -1), nearest(kinds, i, 1)
            if k in ("good", "bad"):
                want.append(k == "good")
            elif h and b == "good":
                want.append(True)
            else:
                want.append((a, b) == ("good", "good") or k == "near" and "good" in (a, b))
        assert html_text.settle(kinds, heads) == want


def test_pages_without_an_article_follow_the_two_passes():
    rng = random.Random(2)
    for _ in range(60):
        parts, want = [], []
        for _ in range(rng.randint(1, 6)):
            kind = rng.choice(["text", "links", "ad"])
            mark = f"m{rng.randrange(10**9)}"
            if kind == "text":
                parts.append(f"<p>{BODY} {mark}</p>")
                want.append(mark)
            elif kind == "links":
                parts.append(f'<ul><li><a href="/x">Read more of the story {mark}</a></li></ul>')
            else:
                parts.append(f'<div class="ad"><p>{BODY} {mark}</p></div>')
        got = html_text.main_text(f"<body><div>{''.join(parts)}</div></body>")
        assert re.findall(r"m\d+", got) == want


def test_deep_and_unclosed_tags_cost_their_length():
    for page in ("<div>" * 200_000, "<b>" * 100_000 + "</i>" * 100_000, "<p><b>" * 60_000 + "</b></p>" * 60_000, "<div><a>" * 50_000 + "</a>" * 100_000):
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 10


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    page = f"<article><p>{BODY}</p></article>"
    df = spark.createDataFrame([(1, "u", page, "mine", 3), (1, "u", page, "mine", 3), (None, None, "<p>" + "x " * 300_000 + "</p>", None, None)], schema)
    got = html_text.extract_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert [r.text for r in got.collect()][:2] == [BODY.strip()] * 2
    assert html_text.extract_text(df.limit(0)).count() == 0
