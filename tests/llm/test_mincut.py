import html
import itertools
import random
import re

from tidelog.llm import mincut


def test_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 7)
        s, t = [[rng.randint(0, 9) for _ in range(n)] for _ in range(2)]
        edges = [(a, b, rng.randint(0, 6)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda keep: sum(t[i] if keep[i] else s[i] for i in range(n)) + sum(c for a, b, c in edges if keep[a] != keep[b])  # noqa: B023, E731
        assert cost(mincut.minimum_cut(s, t, edges)) == min(map(cost, itertools.product([True, False], repeat=n)))


def test_whole_table(pages):
    found = {r.page_id: r for r in mincut.extract_main_text(pages).collect()}
    for r in pages.collect():
        own = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", own).replace("<b>", "").replace("</b>", "")).split())
        assert found[r.page_id].text == want and found[r.page_id].n_chars == len(want) and found[r.page_id].url == r.url


PAGE = """<html><body class="has-sidebar"><header class="top"><a href=/>Home</a> Site</header><div class="cookie-notice">We use cookies to make this site better for all of our users and friends.</div>
<div id="content"><h1>Title &amp; more</h1><p>A long paragraph of <b>re</b>al content that goes on for a good
number of words so it is kept by the cut, truly.<p>Short.<form>Name <input></form><p>Another long paragraph of real content, with a <a href=x>link</a>, that goes on for a good number of words.</div>
<div class="sidebar"><ul><li><a>x</a></li></ul></div><section id="comments"><p>Great post! I really liked reading this text and hope there are more of these to come in time.</p></section><script>var x = "</p>";</script><footer>(c)</footer>"""


def test_a_page_without_article():
    want = "Title & more A long paragraph of real content that goes on for a good number of words so it is kept by the cut, truly. Short. Another long paragraph of real content, with a link, that goes on for a good number of words."
    assert mincut.main_text(PAGE) == want


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>only text"), (4, "u", "plain words"), (None, "u", "<article><p>x &lt;b&gt; &eacute;&#x1F642;<br>y</article>"), (5, "u", "<article>" + "<p>para graph</p>" * 3000 + "</article>"), (5, "u", "<nav>menu</nav>"), (5, "u", "<nav>menu</nav>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'mine' as text", "1 as n_chars")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in mincut.extract_main_text(df).collect()), key=repr)
    want = [(1, ""), (2, ""), (3, "only text"), (4, "plain words"), (None, "x <b> é🙂 y"), (5, " ".join(["para graph"] * 3000)), (5, ""), (5, "")]
    assert got == sorted(((i, t, len(t)) for i, t in want), key=repr)
    assert mincut.extract_main_text(df.limit(0)).count() == 0


ARTICLE = "<p>A long paragraph of real content that goes on for a good number of words, so that it is kept by the cut.</p>"
COMMENT = "<p>Great post! I really liked reading this text and hope there are more of these to come in time.</p>"
KEPT = "A long paragraph of real content that goes on for a good number of words, so that it is kept by the cut."


def test_pages_that_misled():
    """No end of the head; comments that are articles; an article whose class names what the page has; mathematics."""
    assert mincut.main_text(f"<html><head><title>t</title><body><article>{ARTICLE}</article>") == KEPT
    assert mincut.main_text(f"<head><title>t</title><meta charset=x>{ARTICLE}") == KEPT
    page = f'<body><article>{ARTICLE}</article><section id="comments"><article>{COMMENT}</article><article class="c">{COMMENT}</article></section>'
    assert mincut.main_text(page) == KEPT
    assert mincut.main_text(f'<article class="post has-sidebar comments-open">{ARTICLE}</article><article class="comment">{COMMENT}</article>') == KEPT
    assert mincut.main_text(f"<article>{ARTICLE}<p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>") == KEPT + " Where x=2 holds."


def test_the_cut_decides(pages):
    """Blocks whose label by themselves is the other one, on the pages and on one without marks."""
    changed = 0
    for r in pages.collect():
        blocks = mincut.blocks_of(r.html)
        changed += sum(k != (mincut.log_odds(b) > 0) for b, k in zip(blocks, mincut.labels(blocks), strict=True))
    assert changed > 50
    short = "<div>" + ARTICLE * 2 + "<p><a href=x>Linked words alone</a></p>" + ARTICLE * 2 + "</div>"
    weights = (0.1, 2.0, -2.0, 0.5, -2.0, 0.0)
    blocks = mincut.blocks_of(short)
    assert [mincut.log_odds(b, weights) > 0 for b in blocks].count(False) == 1 and mincut.main_text(short, weights) == f"{KEPT} {KEPT} Linked words alone {KEPT} {KEPT}"


def test_fitted_weights(pages):
    assert mincut.fit_classifier([]) == mincut.PRIOR_WEIGHTS == mincut.fit_classifier([None, "<p>x"])
    fitted = mincut.fit_classifier([r.html for r in pages.collect()])
    assert fitted != mincut.PRIOR_WEIGHTS and max(abs(a - b) for a, b in zip(fitted, mincut.PRIOR_WEIGHTS, strict=True)) < 4
    assert mincut.fitted(pages) == mincut.fitted(pages.repartition(7))


def test_deep_and_long_pages():
    n = 30_000
    assert mincut.main_text("<div>" * n + ARTICLE + "</div>" * n) == KEPT
    assert mincut.main_text("<b>" * n + "<p>x</p></i>" * 3000) == " ".join(["x"] * 3000)
    assert mincut.main_text("<article>" + ARTICLE * 5000).count("kept") == 5000
