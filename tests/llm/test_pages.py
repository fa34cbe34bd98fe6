"""Main text of pages: wrappers, comments, foreign and deep elements, and random trees whose text is known."""

from __future__ import annotations

import random
import time

import pytest

from evidentia.llm import pages

WRAPPERS = ["has-sidebar", "layout-with-sidebar", "login-page", "ad-free", "page-with-banner", "social network"]


@pytest.mark.parametrize("name", WRAPPERS)
def test_wrappers_keep_their_article(name):
    assert pages.main_text(f'<div class="{name}"><article><p>one</p></article><div class="footer">f</div></div>')[0] == "one"
    assert pages.main_text(f'<div class="{name}"><div><p>one and some more text</p></div><div class="footer">f</div></div>')[0] == "one and some more text"


CASES = [
    ('<form id="f"><div><article><p>one</p><form>f</form></article><div>x</div></div></form>', "one"),
    ('<div class="has-sidebar"><div class="sidebar"><article>tea</article></div><article><p>one two three</p></article></div>', "one two three"),
    ('<article><p>one</p><article class="comment">c</article></article>', "one"),
    ('<main><article class="post alert"><p>one</p></article><article class="comment-3">c</article></main>', "one"),
    ('<article><p>one</p><section id="comments"><p>c</p></section></article>', "one"),
    ("<article><p>x <svg/> y</p><p>z <svg><path d='m'/><text>t</text></svg> w</p></article>", "x y\nz\nw"),
    ('<article><p>one</p><svg class="i"/><p>two</p></article>', "one\ntwo"),
    ('<aside><article>a longer text than that</article></aside><div class="sidebar"><article>b</article></div>', "b"),
    ('<div class="site-footer">f</div><div>some text of the page</div><div class="main-nav">n</div>', "some text of the page"),
    ("", ""),
    ("<", "<"),
    ("<p>a<p>b</i></div>c", "a\nb\nc"),
]


@pytest.mark.parametrize(("source", "want"), CASES)
def test_cases(source, want):
    assert pages.main_text(source)[0] == want


def test_time_follows_depth():
    for source in ("<div>x" * 10_000, "<div>x" * 5_000 + "</b></section>" * 5_000, "<svg>" * 10_000 + "x"):
        began = time.process_time()
        text, _ = pages.main_text(source)
        assert time.process_time() - began < 1.0
        pages.page_nodes(source)
        assert time.process_time() - began < 2.0
    assert pages.main_text("<div>x" * 3)[0] == "x\nx\nx"


def grown(rng, depth, inside, noise):
    """A random element: its markup, and its blocks with whether each is inside an article and noise."""
    tag = rng.choice(["div", "section", "ul", "blockquote", "aside", "nav", "form", "article" if not inside else "div"])
    name = rng.choice(["", "", "", "x1", "comments", "menu", "wide"])
    noisy = noise or tag in ("aside", "nav", "form") or (tag != "article" and name in ("comments", "menu"))
    inside = inside or tag == "article"
    out, blocks = [f'<{tag} class="{name}">' if name else f"<{tag}>"], []
    for _ in range(rng.randint(1, 4)):
        if depth and rng.random() < 0.5:
            more, below = grown(rng, depth - 1, inside, noisy)
            out.append(more)
            blocks += below
        else:
            words = [rng.choice(["a", "b&amp;", "&lt;c", "é", "d"]) for _ in range(rng.randint(1, 5))]
            gap = rng.choice([" ", "\n\t", "<br>", " <b>", "</i> "])
            out.append(f"<p>{gap.join(words)}</p>")
            blocks.append((inside, noisy, " ".join(words).replace("&amp;", "&").replace("&lt;", "<")))
    out.append(f"</{tag}>")
    return "".join(out), blocks


def test_random_trees():
    rng = random.Random(11)
    for _ in range(400):
        source, blocks = grown(rng, 4, False, False)
        source, blocks = f"<body><article><p>first</p></article>{source}</body>", [(True, False, "first"), *blocks]
        assert pages.main_text(source)[0] == "\n".join(text for inside, noise, text in blocks if inside and not noise), source


def test_clashing_columns_and_nulls(spark):
    rows = [(1, "http://a.b/c", "<article><p>one</p></article>", "x", 2, 3), (1, None, None, None, None, None), (None, "", "", "h", 0, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, low int, branch int")
    assert sorted((r.text, r.n_chars) for r in pages.extract(df).collect()) == [("", 0), ("", 0), ("one", 3)]
    assert pages.extract(df.limit(0)).count() == 0
