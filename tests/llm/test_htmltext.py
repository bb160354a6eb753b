"""Operator 12 on pages that are made from known articles."""

import html
import random

import pytest

from pagetide.llm.htmltext import content_lines, extract, main_text, op12_html_text, out_word

from . import helpers

WORDS = "the river of stone and salt & light <b> über café went 5 > 3 along its bank".split()
FURNITURE = [
    '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>',
    '<div class="sidebar"><h3>Latest</h3><p>{t}</p></div>', '<aside><p>{t}</p></aside>',
    '<div id="cookie-notice" role="dialog"><p>We use cookies. {t}</p><button>Accept</button></div>',
    '<div class="ad ad-top">Buy now: {t}</div>', '<form action="/s"><label>Search</label><input name="q"><select><option>All</option></select></form>',
    "<script>document.write('<p>{t}</p>');</script>", "<style>p > b {{ margin: 0 }}</style>", "<!-- <p>{t}</p> -->", "<noscript>{t}</noscript>",
    '<section id="comments"><h2>Comments</h2><article><p>{t} {t} {t}</p></article></section>', '<div class="share-buttons"><a>Share</a></div>',
    '<ul class="breadcrumbs"><li><a href="/">Top</a></li><li>Here</li></ul>', '<div role="alert">{t}</div>',
]


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def made_page(rnd, wrap):
    blocks = [sentence(rnd, rnd.choice([1, 4, 30, 90])) for _ in range(rnd.randint(3, 12))]
    blocks[1] = sentence(rnd, 120)
    furniture = lambda: "".join(rnd.choice(FURNITURE).format(t=html.escape(sentence(rnd, rnd.choice([3, 12])))) for _ in range(rnd.randint(0, 3)))
    body = ""
    for i, b in enumerate(blocks):
        text = html.escape(b).replace(" ", rnd.choice([" ", "\n  ", "&#32;", " <br> ", " "]), 2)
        if rnd.random() < 0.3:
            text = "<b>" + text + rnd.choice(["</b>", ""])
        body += f"<h1>{text}</h1>" if i == 0 else rnd.choice([f"<p>{text}</p>", f"<p>{text}", f"<div>{text}</div>", f"<blockquote><p>{text}</p></blockquote>"])
        if rnd.random() < 0.2:
            body += furniture()
    head = "<!DOCTYPE html><html><head><title>T &amp; t</title></head><body><header><h1>Site name</h1><p>Slogan of the site</p></header>"
    return f"{head}{furniture()}{wrap[0]}{body}{wrap[1]}{furniture()}<footer>&copy; site</footer>{rnd.choice(['</body></html>', ''])}", blocks


@pytest.mark.parametrize("wrap", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="wrap"><div class="text">', "</div></div>")])
def test_articles_come_out_whole(wrap):
    rnd = random.Random(str(wrap))
    for _ in range(150):
        page, blocks = made_page(rnd, wrap)
        assert main_text(page).split("\n") == [" ".join(b.split()) for b in blocks], page


def test_blocks_white_space_and_references():
    page = "<article><h1> A&nbsp;&lt;b&gt;\n\tc </h1>loose <i>text</i><ul><li>one<li>two</ul><table><tr><td>1<td>2<tr><td>3</table><p>x<br>y<p>&#x41;&bogus; &amp</article>"
    assert main_text(page) == "A <b> c\nloose text\none\ntwo\n1 2\n3\nx y\nA&bogus; &"


def test_short_lines_stay_and_own_headers_keep_their_headings():
    page = '<article><header><h1>Title</h1><p class="byline">By x</p></header><p>' + "word " * 200 + "</p><p>Yes.</p><footer>tags</footer></article><p>after</p>"
    assert main_text(page).split("\n")[0] == "Title" and main_text(page).endswith("\nYes.")
    assert "By x" not in main_text(page) and "tags" not in main_text(page)


def test_wrappers_and_several_articles():
    long = "word " * 80
    assert main_text(f'<form id="aspnet"><input><article><p>{long}</p></article></form>') == long.strip()
    two = f'<article class="teaser"><p>short</p></article><article><p>{long}</p></article><div class="has-sidebar"><p>x</p></div>'
    assert main_text(two) == long.strip()
    index = "<main>" + f"<article><p>{long}</p></article>" * 3 + "</main>"
    assert main_text(index) == "\n".join([long.strip()] * 3)


def test_malformed_pages():
    assert main_text("<article><p>a</div></span><b>b</article>") == "ab"
    assert main_text("<nav><a>x</a></nav>") == ""
    assert main_text("<article>open <script>var a = '<p>no</p>';") == "open"
    assert main_text("<![if IE]><p>text of a page</p><![endif]>") == "text of a page"
    assert main_text("<p>5 < 6 && 7 > 6</p>") == "5 < 6 && 7 > 6"
    rnd = random.Random(3)
    bits = ["<", ">", "&", "<p", "</", "<!", "<![", "<!--", "-->", "<?", "a", '"', "=", " ", "<article>", "</article>", "<div>", "</div>", "<table>", "<td>", "\0", "&#0;", "&#xD800;", "é"]
    for _ in range(3000):
        main_text("".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))))


def test_long_and_deep_pages():
    page = "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>" + "word " * 300_000 + "</p></article>"
    assert len(main_text(page)) == 4 + 1 + 5 * 300_000 - 1


def test_threshold_and_names():
    import numpy as np

    chars, tags = np.array([5, 6, 5, 300, 280, 310, 4, 5]), np.array([3, 3, 3, 2, 2, 2, 4, 4])
    assert content_lines(chars, tags)[3:6].all() and not content_lines(chars, tags)[[0, 1, 7]].any()
    assert content_lines(np.array([3]), np.array([0])).all()
    for name in ("ad", "sidebar-left", "site-footer", "comment_list", "Main-NAV", "x cookies"):
        assert out_word(name)
    for name in ("has-sidebar", "adventure", "content", "headline", "no-comments", "post article"):
        assert not out_word(name)


def test_rows_nulls_repeats_and_extra_columns(spark):
    from pyspark.sql import functions as F

    rows = [(1, "u", "<p>a&amp;b</p>"), (1, "u", "<p>a&amp;b</p>"), (None, None, None), (2, "v", ""), (3, None, "<article>é<p>😀</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("t"), "n_chars": F.lit(1), "out": F.lit(2)})
    found = extract(df)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    want = [(1, "u", "a&b", 3), (1, "u", "a&b", 3), (None, None, "", 0), (2, "v", "", 0), (3, None, "é\n😀", 3)]
    assert helpers.ordered(found.collect()) == helpers.ordered(want)
    assert extract(df.limit(0)).collect() == []


def test_query_reads_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    found = op12_html_text(spark, sf).collect()
    assert len(found) == spark.read.parquet(f"{sf}/pages.parquet").count()
    for r in found:
        assert r["n_chars"] == len(r["text"]) > 0
