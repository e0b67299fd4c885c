import html
import re
import time

import duckdb
import pytest

from ketflow.llm import html_main as H

CASES = {
    '<div class="content with-sidebar"><div id="menu"><a href=x>m</a></div><article><header><h1>T</h1></header><p>One, two, three.</p><section class="comments"><p>a comment, really</p></section></article></div>': "T\nOne, two, three.",
    "<body><div><p>Plain text, with a comma, and so on.</p><p>x</p><h2>Head</h2></div><div class=ad><p>ad, ad, ad</p></div></body>": "Plain text, with a comma, and so on.\nx\nHead",
    "": "",
    "<p>only": "only",
    "<table><tr><td>a<td>b</table>": "a\nb",
    "plain &lt;b&gt; text &nbsp; here &eacute;&#x41;": "plain <b> text here éA",
    "<main><h1>Hi</h1><p>a</p><aside>no</aside></main><div class=cookie-notice>cookies</div>": "Hi\na",
    "<body><header>site</header><div><div><p>Aaa bbb, ccc.</p></div><div><p>ddd eee, fff ggg</p></div></div><footer>f</footer>": "Aaa bbb, ccc.\nddd eee, fff ggg",
    "<article><p>a <b>bold<p>next <i>one</i><ul><li>x<li>y</ul><form><p>name</p></form><script>var a='<p>no</p>'</script></article>": "a bold\nnext one\nx\ny",
    "<html><body class='has-sidebar ad'><article><p>kept, all the same</p></article>": "kept, all the same",
    "<nav><p>menu, menu</p></nav><!-- <p>no</p> --><style>p{}</style>": "",
    "<article><p>a<br>b\n c</p></article>": "a b c",
    "<div role=navigation><p>no, no</p></div><div hidden><p>no</p></div><p>yes, yes</p>": "yes, yes",
    "<p>broken <b <i>x</p": "broken x",
    # names of layout wrappers overruled by the points
    "<form id=f><div class=top><a href=/>home</a></div><article><h1>T</h1><p>One, two, three.</p></article></form>": "T\nOne, two, three.",
    "<form><div><h1>T</h1><p>One, two, three.</p><p>Four, five.</p></div></form>": "T\nOne, two, three.\nFour, five.",
    "<div class='page no-sidebar'><p>One, two, three.</p><p>Four, five.</p></div><footer><p>foot, foot</p></footer>": "One, two, three.\nFour, five.",
    "<div class='layout sidebar-right'><div><h1>T</h1><p>One, two, three.</p></div><div class=sidebar><p>side</p></div></div>": "T\nOne, two, three.",
    "<div class='ad-free reading'><article><p>One, two, three.</p></article></div><aside><article><p>other, news</p></article></aside>": "One, two, three.",
    "<article><p>One.</p></article><section id=comments><article class=comment><p>" + "I say, " * 90 + "</p></article></section>": "One.",
    "<div class=comments><p>only, comments, here</p></div>": "",
    "<article><p>Main, text, it is.</p></article><aside><article><p>" + "teaser, " * 9 + "</p></article></aside>": "Main, text, it is.",
    # without article or main
    "<div id=w><div class=a><a href=1>x</a><a href=2>y</a></div><div class=t><h2>H</h2><p>" + "Long, text. " * 20 + "</p><p>Short.</p></div><div class=b><a href=3>more</a></div></div>": "H\n" + ("Long, text. " * 20).strip() + "\nShort.",
    "<div class=s><p>" + "Part, one. " * 30 + "</p></div><div class=s><p>Two.</p></div><div class=x><a href=1>l</a></div>": ("Part, one. " * 30).strip() + "\nTwo.",
    "<table><tr><td><a href=1>a</a><td><p>Text, in a cell, of an old page.</p><p>And, more.</p></table>": "Text, in a cell, of an old page.\nAnd, more.",
    "<main><div><p>One, two.</p></div><div><ul><li>item</ul></div></main><div><a href=1>x</a></div>": "One, two.\nitem",
}


@pytest.mark.parametrize("page", CASES)
def test_cases(page):
    if page.startswith("<p>broken"):
        assert H.extract(page).startswith("broken")
    else:
        assert H.extract(page) == CASES[page]


def test_hard_cases(spark):
    rows = [(1, "u", None), (1, "u", ""), (2, None, "<p>" * 3000 + "deep" + "</p>"), (3, "u", "<div>" * 5000 + "x, y"), (4, "u", "<article><p>" + "word, " * 100_000 + "</p></article>"), (4, "u", "no tags at all")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id bigint, url string, html string, text string")
    got = H.extract_pages(df)
    assert got.columns == ["page_id", "url", "html", "text"]
    texts = [r.text for r in got.collect()]
    assert texts[:4] == ["", "", "deep", "x, y"] and len(texts[4].split()) == 100_000 and texts[5] == "no tags at all"
    assert H.extract_pages(df.limit(0)).count() == 0


def brute_points(node, level=0):
    """Points of a container by definition: its paragraphs' own, halved for each level between."""
    total = 0.0
    for c in node.children:
        if isinstance(c, H.Node) and c.kind == H.WANTED:
            own = sum(len(x.strip()) for x in c.children if isinstance(x, str))
            blocks = any(isinstance(x, H.Node) and x.kind == H.WANTED and x.tag in H.BLOCK and text_size(x) for x in c.children)
            if text_size(c) and (c.tag in H.PARAGRAPH or c.tag in H.BLOCK and own >= 25 and not blocks):
                commas = sum(x.count(",") for x in c.children if isinstance(x, str))
                total += (1 + commas + min(text_size(c) / 100, 3)) * (1 - link_size(c) / text_size(c)) / 2**level
            total += brute_points(c, level + 1)
    return total


def text_size(n):
    return sum(len(x.strip()) if isinstance(x, str) else text_size(x) if x.kind == H.WANTED else 0 for x in n.children)


def link_size(n):
    return text_size(n) if n.tag == "a" else sum(link_size(x) for x in n.children if isinstance(x, H.Node) and x.kind == H.WANTED)


@pytest.mark.parametrize("page", [c for c in CASES if c])
def test_points_are_those_of_the_definition(page):
    tree = H._Tree()
    tree.feed(page)
    tree.close()
    H._take_back(tree.nodes)
    for node in tree.nodes:
        if node.on:
            assert abs(node.points - brute_points(node)) < 1e-9 and node.size == text_size(node) and node.linked == link_size(node)


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "x", "<font>" * 8000 + "<p>word, word</p>" * 8000, "<b>" * 30_000 + "<li>x" * 30_000, "<i><article>" + "<b>" * 20_000 + "</i>" * 20_000, "<div class=ad><h1>x</h1><p>a, b</p></div>" * 10_000, "<div><p>a, b" * 20_000])
def test_time_is_linear_in_the_page(page):
    began = time.perf_counter()
    H.extract(page)
    assert time.perf_counter() - began < 4


def test_pages_of_the_tables():
    for i, page in duckdb.sql("select page_id, html from '/root/testdata/sf0.01/pages.parquet'").fetchall():
        inner = re.search(r"<article>(.*?)(</article>|<footer|$)", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x.replace("<b>", "").replace("</b>", ""))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert H.extract(page) == "\n".join(x for x in parts if x), i
