import html
import itertools
import random
import re
import time

from tidemark.llm import html_extraction as hx
from tidemark.llm.common import table


def cost(side, odds, edges):
    return sum(abs(s) for s, c in zip(odds, side) if (s > 0) != c and s) + sum(w for a, b, w in edges if side[a] != side[b])


def test_cut_is_minimal():
    r = random.Random(4)
    for _ in range(60):
        n = r.randint(1, 9)
        odds = [r.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, r.uniform(0, 2)) for a in range(n) for b in range(a) if r.random() < 0.5]
        best = min(cost(s, odds, edges) for s in itertools.product([False, True], repeat=n))
        assert abs(cost(hx.minimum_cut(odds, edges), odds, edges) - best) < 1e-6


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{x}</style></head><body class="home page">
<header class="site-header"><div>Site name</div><nav><ul><li><a href=/>Home</a><li><a href=/b>More</a></ul></nav></header>
<div class="cookie-notice">We use cookies. Please accept all of them now.</div>
<main><article><header><h1>A title</h1></header><p>First &amp; foremost,
 a &lt;long&gt; paragraph with <a href=x>a link</a> and <b>bold</b> words in it.<br>Second line.<p>Short.
<script>var a = "</p>";</script><ul><li>Point one.<li>Point two.</ul><aside><p>Elsewhere on the site, a long aside text.</p></aside>
<div class="ad-box">Buy this very good product today.</div><blockquote>Quoted words.</blockquote></article>
<section id="comments"><h2>Comments</h2><p>I liked this article very much, said a reader.</p></section></main>
<form><label>Name</label><input></form><div class="sidebar"><p>Popular posts of this week are here.</p></div>
<footer>&copy; 2024 Someone.</footer></body></html>"""


def test_a_page_with_everything():
    assert hx.main_text(PAGE) == "A title\nFirst & foremost, a <long> paragraph with a link and bold words in it. Second line.\nShort.\nPoint one.\nPoint two.\nQuoted words."
    plain = '<div id="wrap"><div class="menu"><a href=1>One</a> <a href=2>Two</a></div><div class="content"><h2>Head</h2><p>Some words of a text that goes on for a while.</p><p>And so on.</p></div><div class="footer">Imprint</div></div>'
    assert hx.main_text(plain) == "Head\nSome words of a text that goes on for a while.\nAnd so on."


def test_neighbourhood_decides():
    """One line, by itself boilerplate: content between paragraphs of its parent, and not between links."""
    line = "<div>Forty two or so</div>"
    element, text, linked = hx.blocks(line)[0]
    assert hx.log_odds(element, text, linked, False) < 0
    text = "<p>A paragraph that has a good number of words, goes on for some time and then ends.</p>"
    link = "<div><a href=x>Some link</a></div>"
    assert "Forty two" in hx.main_text(f"<div>{text}{text}{line}{text}{text}</div>")
    assert "Forty two" not in hx.main_text(f"<div>{link}{link}{line}{link}{link}</div>")
    assert hx.main_text(line) == ""


def test_weights_are_learnt(spark):
    """Pages without names that tell are read by the weights that pages with names gave: all content stays, and lists of links go. Whole
    sentences of an advert are left where nothing names them."""
    rows = [r.html for r in table(spark, "/root/testdata/sf0.01", "pages").select("html").collect()]
    weights = hx.train(spark.createDataFrame([(x,) for x in rows], "html string"))
    assert weights != hx.TEXT_WEIGHTS and weights[2] < 0 < weights[1]
    assert hx.train(spark.createDataFrame([("<p>x",), (None,)], "html string")) == hx.TEXT_WEIGHTS
    same = wanted = extra = boilerplate = 0
    for x in rows[:100]:
        bare = re.sub(r'class="[^"]*"|id="[^"]*"', "", re.sub(r"<(/?)(article|nav|footer|header|aside|main)\b[^>]*>", r"<\1div>", x))
        want, got = hx.main_text(x, weights).split("\n"), hx.main_text(bare, weights).split("\n")
        same, wanted = same + len(set(want) & set(got)), wanted + len(set(want))
        extra, boilerplate = extra + len(set(got) - set(want)), boilerplate + len({t for _, t, _ in hx.blocks(x)} - set(want))
    assert same > 0.99 * wanted and extra < 0.4 * boilerplate, (same, wanted, extra, boilerplate)


def test_time_grows_with_length():
    for page in ("<div>" * 20000 + "x", "<a " * 20000, '<a "' * 20000, "<p><span>" * 20000, "<ul><li>" * 10000 + "y", "<b>" * 20000 + "</i>" * 20000):
        at = time.perf_counter()
        hx.main_text(page)
        assert time.perf_counter() - at < 6, page[:9]


def test_tables_and_edges(spark):
    rows = hx.query(spark, "/root/testdata/sf0.01").collect()
    raw = {r.page_id: r.html for r in table(spark, "/root/testdata/sf0.01", "pages").collect()}
    assert len(rows) == len(raw)
    for r in rows:
        body = re.search(r"<article>(.*)</article>", raw[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x) if "<b" in x else x).split()) for x in re.split(r"</?(?:h1|p)>", body)]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "<p>a < b and c.</p>" * 3), (3, "<" * 5000), (4, "<p>Lost " * 20000), (4, "</div></p>&#x41;&nbsp;b")], "page_id long, html string").selectExpr("*", "1 AS text", "'u' AS url")
    got = hx.extract(odd).collect()
    assert [r.n_chars for r in got[:2]] == [0, 0] and len(got) == 6 and got[2].text.startswith("a < b and c.")
    assert hx.extract(odd.limit(0)).count() == 0


def test_formulas_are_text():
    page = "<main><article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be a number that all of the following lines rely on, and more.</p></article></main>"
    assert hx.main_text(page).startswith("Let x=2 be a number")
    assert "never" not in hx.main_text(page.replace("Let", "<svg><text>never</text></svg><noscript>never</noscript>Let"))
