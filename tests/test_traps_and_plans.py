"""Semantic traps, the Python renderer, S2, and plan shape checks."""

import io
import os
import contextlib

from conftest import SF001
from pyspark.sql import functions as F

from pagetide.operators import search as Q
from pagetide.operators import sites as ST
from pagetide.plans import queries as QQ
from pagetide.plans import vocab as V
from pagetide.sources.tables import read_map_text
from pagetide.streaming.snapshots import scratch


def _pages(spark, rows):
    schema = "domain string, seq bigint, metadata struct<title:string>, json struct<title:string,summary:string>"
    return spark.createDataFrame(rows, schema)


def test_keyword_substring_trap(spark):
    # T13: "api" hits "capital" and "endpoint" is a second distinct keyword
    p = _pages(spark, [("a.com", 1, ("Capital markets",), (None, "our endpoint list")), ("b.com", 1, ("api",), (None, ""))])
    got = {(r["domain"], r["category"]) for r in ST.site_expansions(p, V.REFERENCE_CATEGORIES).collect()}
    assert got == {("a.com", "API/Developer")}  # b.com has one distinct keyword only (min 2)


def test_expansions_capped_at_five(spark):
    words = "api sdk changelog release recipe meal course lesson listing property cart checkout plugin extension"
    p = _pages(spark, [("a.com", 1, (words,), (None, ""))])
    rows = ST.site_expansions(p, V.REFERENCE_CATEGORIES).orderBy("cat_rank").collect()
    # seven categories qualify; the first five in list order are kept
    assert [r["category"] for r in rows] == [
        "API/Developer", "Changelog/Releases", "Recipes/Food", "Education/Courses", "Real Estate",
    ]


def test_title_precedence_and_generic_description(spark):
    # The description rules read json.title before metadata.title
    schema = ("domain string, seq bigint, metadata struct<title:string,description:string,ogDescription:string>, "
              "json struct<title:string,description:string,summary:string>")
    p = spark.createDataFrame(
        [("a.com", 1, ("plain words", None, None), ("Our Services", None, "")), ("b.com", 1, ("nothing", None, None), (None, None, ""))],
        schema,
    )
    hp = spark.createDataFrame([], "domain string, url string, seq bigint")
    got = {r["domain"]: (r["description"], r["tier"]) for r in ST.site_description(p, hp).collect()}
    assert got["a.com"] == ("Service-based business", "title_rules")
    assert got["b.com"] == ("a website at b.com", "generic")


def test_pricing_matches_a_literal_dollar(spark):
    # The pricing family means a dollar sign, not "every line"
    docs = spark.createDataFrame([("a.com", "p", "costs $5\nno money here")], "domain string, slug string, content string")
    fam = [f for f in V.REFERENCE_PATTERN_FAMILIES if f[0] == "pricing"]
    got = {(r["phrase"], r["n"]) for r in Q.pattern_matches(docs, fam).collect()}
    assert got == {("$", 1), ("cost", 1)}


def test_map_text_scan(spark):
    d = scratch(spark, "maptxt")
    local = d[len("file:"):] if d.startswith("file:") else d
    os.makedirs(local, exist_ok=True)
    with open(os.path.join(local, "map-urls.txt"), "w") as f:
        f.write("https://a.com/x\n\n   \n  https://a.com/y  \n")
    rows = read_map_text(spark, d, "a.com").orderBy("seq").collect()
    assert [r["url"] for r in rows] == ["https://a.com/x", "https://a.com/y"]


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_url_jobs_never_read_html(spark):
    for name in ("map_diff", "map_health", "miss_history", "fetch_queue"):
        plan = _plan(QQ.QUERIES[name](spark, SF001))
        schemas = [line for line in plan.splitlines() if "ReadSchema" in line]
        assert schemas and all("html" not in s for s in schemas), name


def test_search_reads_only_needed_columns(spark):
    plan = _plan(QQ.QUERIES["document_topics"](spark, SF001))
    schemas = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert schemas and all("lang" not in s and "n_chars" not in s for s in schemas)


def test_discovery_limit(spark):
    import pytest

    from pagetide.operators.extract import discover_urls
    from pagetide.sources.tables import read_pages

    pages = read_pages(spark, SF001)
    with pytest.raises(ValueError):
        discover_urls(pages, limit=0)
    capped = discover_urls(pages, limit=2)
    per_site = {r["domain"]: r["n"] for r in capped.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    full = {r["domain"]: r["n"] for r in discover_urls(pages).groupBy("domain").agg(F.count("*").alias("n")).collect()}
    assert per_site == {d: min(2, n) for d, n in full.items()}


def test_no_query_plans_cross_products(spark):
    """No registered query pairs rows without a key (cartesian / nested-loop joins)."""
    from pagetide.plans.queries import QUERIES

    bad = {}
    for name, fn in QUERIES.items():
        if name == "miss_counter_stream":  # executes a stream; its batch twin is miss_history
            continue
        plan = _plan(fn(spark, SF001))
        hits = [op for op in ("CartesianProduct", "BroadcastNestedLoopJoin") if op in plan]
        if hits:
            bad[name] = hits
    assert not bad


def test_content_diff_moves_no_text(spark):
    """No exchange of the diff holds a body or a rendered text, and only pages
    that share a slug are shuffled for the documents themselves."""
    import re

    from pagetide.plans import queries as Q

    diff = Q.scoped(Q.content_diff)(spark, SF001)
    plan = diff._jdf.queryExecution().optimizedPlan().toString()
    keyed = diff._jdf.queryExecution().executedPlan()
    text = keyed.toString()
    assert "Exchange" in text
    for stage in re.findall(r"(?:Exchange|Window|Sort) [^\n]*", text):
        assert not re.search(r"\b(body|content|markdown|html)#", stage), stage
    # what goes into each hash exchange: the columns of the project below it
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            below = next(x for x in lines[i + 1:] if "Project" in x or "Scan" in x or "HashAggregate" in x)
            names = re.search(r"\[(.*)\]", below).group(1)
            outputs = [part.rsplit(" AS ", 1)[-1] for part in re.split(r", (?![^()]*\))", names)]
            assert not any(re.match(r"(body|content|markdown|html)#", o.strip()) for o in outputs), below
    assert "Join" in plan


def test_documents_without_rivals_are_not_shuffled(spark):
    from pagetide.operators import assemble as A

    rows = [(1, "https://a.com/x", "<p>1</p>"), (2, "https://a.com/x?q", "<p>2</p>"), (3, "https://a.com/y", "<p>3</p>"), (4, "https://b.com/x", ""),
            (5, "https://b.com/x#t", "<p>5</p>"), (6, "https://b.com/z", " "), (7, "", "<p>7</p>"), (8, None, "<p>8</p>"), (3, "https://a.com/y", "<p>3</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    from pagetide.operators import extract as E

    table = E.extract_pages(pages)
    rivals = A.rival_pages(E.keyed_pages(pages.select("page_id", "url")))
    assert {r["seq"] for r in rivals.collect()} == {1, 2, 3, 4, 5, 7, 8}
    got = A.one_per_slug(A.render(A.resolve_fields(table)), rivals)
    key = lambda df: sorted((r["domain"] or "", r["slug"], r["seq"], r["body"]) for r in df.collect())
    assert key(got) == key(A.page_docs(table))
