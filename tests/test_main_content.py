"""E2/E3 main content: golden pages, the SQL twin on random pages, and the
standard library's parser on well-formed nested ones."""

import random

import duckdb
import pytest
from conftest import SF001, many
from htmlrender import render_markdown
from pyspark.sql import functions as F

from pagetide.functions import html as H
from pagetide.operators import extract as E
from pagetide.plans import duck as D
from pagetide.sources.tables import read_pages

GOLDEN = [
    ("<nav><ul><li><a href='/x'>n</a></ul></nav><h1>T</h1><p>one<p>two <a href=/y>l</a>", "# T\n\none\n\ntwo [l](/y)"),
    ('<div class="x sidebar"><div>in</div>still</div>out<div><nav>open</div>after</nav>z', "outafterz"),
    ("<nav><p>menu<article>kept</article>", "kept"),
    ('<ul class="menu"><li>a<li>b</ul><ol><li>c<li class="ad">d<li>e</ol>', "- c\n- e"),
    ("<header>h<div></header>i</div>j", "i\nj"),
    ("<aside><article>t</article></aside>u", "u"),
    ("<nav><div><nav>a</nav>b</div>c</nav>d", "d"),
    ('<a title="a>b" href="u">t</a>', "[t](u)"),
    ("<a href=x>1<a href=y>2</a>3</a><a>q</a>", "1[2](y)3q"),
    ("<div id=ad>q</div>w<span class='big ads'>e</span>r<div class=adverb>s</div>", "wrs"),
    ("x<script>var t='</p>';</p>", "x"),
    ("plain &amp; <5 &lt;b&gt;", "plain & <5 <b>"),
    ("<html><head><title>t</title><body><h1>A</h1><p>b</p></body></html>", "# A\n\nb"),
    ("<head><title>t</title></head><header><b>h</header><h2>A</h2>b<br/>c<!-- d --><table><tr><td>1</tr></table>", "## A\n\nb\nc1"),
    ("", ""), (None, None), ("<p>a</div>b", "a\nb"), ("<nav/>a<svg/>b<svg><p>c</p></svg>", "ab"),
]


def test_golden_pages(spark):
    assert many(spark, H.markdown_lite, [h for h, _ in GOLDEN]) == [m for _, m in GOLDEN]


BITS = [
    "<nav>", "</nav>", "<header>", "</header>", "<div>", "</div>", '<div class="ad">', "<div id='x menu'>", "<span class=ads>", "</span>", "<p>", "</p>",
    "<li>", "</li>", '<li class="widget">', "<ul>", "</ul>", "<article>", "</article>", "<main>", "</main>", "<body>", "</body>", "<h1>", "</h1>", "<h3 x=1>",
    "<br>", "<a href='/u?a=1&amp;b'>", '<a href="v">', "<a href=w>", "<a>", "</a>", "<!-- <nav> -->", "<script>if (a<b) '</div>'</script>", "<style>", "</style>",
    "<head>", "</head>", "text", " one  two\n", "&lt;", "&amp;nbsp;", "é", "<", ">", '"', "'", "<b", "</", "<table>", "</table>", "<svg>", "</svg>", "<svg/>", "<!x>",
]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_pages_agree_with_the_sql_twin(spark, seed):
    rnd = random.Random(seed)
    pages = ["".join(rnd.choice(BITS) for _ in range(rnd.randint(1, 30))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string").select("i", H.content_tokens("html").alias("t"))
    got = df.select("i", H.token_markdown("t"), H.count_links("t"), H.count_headings("t")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE p (i INT, html VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?)", list(enumerate(pages)))
    sql = f"SELECT i, {D.pieces_markdown('g')}, {D.count_links('g')}, {D.count_headings('g')} FROM (SELECT i, {D.content_pieces('html')} AS g FROM p)"
    want = {r[0]: r for r in con.execute(sql).fetchall()}
    bad = [(pages[r[0]], tuple(r), want[r[0]]) for r in got if tuple(r) != want[r[0]]]
    assert not bad, bad[0]


def nested(rnd, depth):
    """A well-formed tree with blocks to leave out at any depth."""
    if depth == 0 or rnd.random() < 0.2:
        return rnd.choice(["word ", "two words ", "<h2>head</h2>", "<p>par <a href='/x'>link</a> end</p>"])
    tag = rnd.choice(["div", "section", "nav", "aside", "header", "footer", 'div class="ad"', "div id='sidebar'", "blockquote", "ul"])
    inner = "".join(nested(rnd, depth - 1) for _ in range(rnd.randint(1, 4)))
    return f"<{tag}>{inner}</{tag.split()[0]}>"


def test_nested_pages_agree_with_the_parser(spark):
    rnd = random.Random(7)
    pages = ["".join(nested(rnd, 6) for _ in range(3)) for _ in range(300)]
    df = spark.createDataFrame([(i, f"https://a.com/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["seq"]: (r["markdown"], r["n_links"], r["n_headings"]) for r in E.extract_markdown(df).collect()}
    words = lambda t: t.split()  # noqa: E731  (the two break lines differently around blocks)
    for i, p in enumerate(pages):
        text, links, headings = render_markdown(p)
        assert (words(got[i][0]), *got[i][1:]) == (words(text), links, headings), p


def test_page_table_and_markdown_share_the_body(spark):
    pages = read_pages(spark, SF001)
    a = {(r["url"], r["markdown"]) for r in E.extract_pages(pages).select("url", "markdown").collect()}
    assert a == {(r["url"], r["markdown"]) for r in E.extract_markdown(pages).collect()}


def test_no_python_stage_and_long_pages(spark):
    long = "<nav>" + "<div>x" * 2000 + "</nav>" + "<p>word <b>b</b>" * 30_000 + "<div class='ad'>y</div>" * 500
    df = spark.createDataFrame([(1, "https://a.com/", long)], "page_id long, url string, html string")
    out = E.extract_markdown(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInPandas" not in plan
    assert out.select(F.regexp_count("markdown", F.lit("word"))).first()[0] == 30_000
    assert "x" not in out.first()["markdown"] and "y" not in out.first()["markdown"]
