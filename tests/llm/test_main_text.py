import html
import random
import re

import pytest

from boxquery.llm.main_text import extract, main_texts
from boxquery.llm.page_tree import parse

SCHEMA = "page_id bigint, url string, html string, text string, p int, key string"


def text_of(source):
    return extract(parse(source, True), set())


def run(spark, rows, **how):
    frame = spark.createDataFrame([(*row, "clash", 1, "clash") for row in rows], SCHEMA)
    return sorted((repr((r["page_id"], r["url"], r["html"], r["p"], r["key"])), r["text"]) for r in main_texts(frame, **how).collect())


def article_by_pattern(source):
    """The article of the given pages, whose markup is known."""
    found = re.search(r"<article>(.*?)(?:</article>|\Z)", source, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", found.replace("<br>", " ").replace("<b>", ""))
    return "\n\n".join(filter(None, (" ".join(html.unescape(block).split()) for block in blocks)))


def test_pages_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r["page_id"]: article_by_pattern(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in main_texts(pages).collect()} == want


PAGES = {
    "<p>a<p>b": "a\n\nb",
    "<p><b>one.<br><p>two &amp; three&nbsp;x &copy &am; &#65;&#x42;</b> four": "one.\n\ntwo & three x © &am; AB four",
    "<article><h1>T</h1><p>x  y\n z</article><p>late": "T\n\nx y z",
    "<nav><ul><li><a>m</a><article>in an open menu</article>": "in an open menu",
    "<div><script>var a = '</p><p>';</script>a<style>p{}</style>b</div>": "ab",
    "<script>never closed <p>x": "",
    "a<!-- c <p>x</p> -->b<!-->c<![CDATA[x]]>d<!doctype html>": "abcd",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "a\n\nb\n\nc\n\nd",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a b\n\nc",
    "1 < 2 <3 <a href=x>y</a> 3 > 2 <": "1 < 2 <3 y 3 > 2 <",
    "<article><p>text</p><aside>side</aside><div class='share-buttons'>Share</div><section id=comments><article class=comment><p>long long comment</article></section><footer>tags</footer></article>": "text",
    "<div class=cookieBanner>we use</div><form><input>go<select><option>a</select></form><header>Site<nav>x</nav></header><div id=content><h2>T</h2><p>body</div><div class='page-footer'>f</div>": "T\n\nbody",
    "<main><article><header><h1>T</h1></header><p>x</article><article><p>y</article></main>": "T\n\nx\n\ny",
    "<body class='has-sidebar with-comments'><div class='post with-comments'><p>the whole text of the page</div>": "the whole text of the page",
    "<p title='a > b' class=\"x\">t</p><p title=\"never closed>u</p>": "t\n\nu",
    "<title>no</title><noscript>no</noscript><textarea>no</textarea><template>no</template>": "",
    "</p></div></html>after": "after",
    "<span>a<div>b</span>c</div>d": "a\n\nbc\n\nd",
    "": "",
    " \n ": "",
}


@pytest.mark.parametrize("source", PAGES)
def test_by_hand(source):
    assert text_of(source) == PAGES[source]


def test_deep_and_long_pages_take_no_recursion():
    assert text_of("<div>" * 100_000 + "x") == "x"
    assert text_of("<p>" + "<b>" * 50_000 + "x" + "</i>" * 50_000) == "x"
    assert len(text_of("<p>word &amp; </p>" * 100_000)) == 100_000 * 8 - 2
    assert text_of("<a " + "b='c' " * 200_000 + ">x") == "x"
    assert text_of("<" * 200_000) == "<" * 200_000


def site(n_pages, host="http://site.example.com"):
    """Pages without any telling tag or name: what is the template shows only in its recurrence."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows, want = [], []
    shared = "a passage that many pages of the site have in common"
    for i in range(n_pages):
        own = [" ".join(rng.choices(words, k=12)) for _ in range(rng.randint(2, 5))]
        if i % 3 == 0:
            own.append(shared)
        slots = [f"top of the site {i % 2}", "subscribe now to our letters", f"end of the site {i % 3}"]
        rows.append((i, f"{host}/{i}", f"<div class=q{i}><p>{slots[0]}</p></div><div class=z>" + "".join(f"<p>{o}</p>" for o in own) + f"<div class=k1>{slots[1]}</div></div><div class=b><i>{slots[2]}</i></div>"))
        want.append("\n\n".join(own))
    return rows, want


@pytest.mark.parametrize("how", [{}, {"broadcast_keys": 0, "salts": 3}])
def test_template_by_recurrence(spark, how):
    rows, want = site(40)
    lone = (900, "http://other.example.com/1", rows[0][2])
    strange = [(901, None, None), (902, None, ""), (None, "no host", "<p>x"), (903, "http://site.example.com/1", None)]
    got = run(spark, [*rows, rows[3], lone, *strange], **how)
    told = {r[0]: w for r, w in zip(rows, want)}
    for key, text in got:
        page_id, url, *_ = eval(key)
        if url is not None and url.startswith("http://site") and page_id in told:
            assert text == told[page_id]
    by_id = [(eval(key)[0], text) for key, text in got]
    assert len(got) == 46 and sorted(t for i, t in by_id if i == 3) == [told[3]] * 2
    assert dict(by_id)[900].startswith("top of the site 0") and [dict(by_id)[i] for i in (901, 902, None, 903)] == ["", "", "x", ""]


def test_copies_of_an_article_stay(spark):
    rows = [(i, f"http://h.example.net/{i}", f"<div class=menu{i}>m</div><article><p>the same article</p><p>end {i % 2}</p></article><div class=x>bottom</div>") for i in range(30)]
    assert [text for _, text in run(spark, rows)] == [f"the same article\n\nend {eval(key)[0] % 2}" for key, _ in run(spark, rows)]


def test_a_page_many_times_is_one_page(spark):
    row = (1, "http://h.example.net/1", "<div class=a>own text</div><div class=b>more</div>")
    assert [text for _, text in run(spark, [row] * 20)] == ["own text\n\nmore"] * 20


def test_empty_table(spark):
    assert run(spark, []) == []
