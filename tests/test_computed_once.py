"""What a query reads of a rendered page is computed once, however often it is used."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pagetide.functions import patterns as P
from pagetide.functions import text as T
from pagetide.functions.urls import py_strip
from pagetide.operators import assemble as A
from pagetide.operators import extract as E
from pagetide.operators import search as Q
from pagetide.operators.extract import term_counts
from pagetide.plans import queries as PQ
from pagetide.plans import vocab as V


def _docs(spark):
    rows = [(i, f"https://a.example.com/{i}", f"<title>t{i}</title><p>the body of {i}</p>") for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return A.render(A.resolve_fields(E.extract_pages(pages)))


def _token_passes(df) -> int:
    """How often the optimized plan cuts a page into tokens."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(r"<!--\.\*\?", plan))


def test_a_page_is_cut_into_tokens_once(spark):
    docs = _docs(spark).where("not _blank")
    for found in (docs, Q.rank_tiers(docs, "the|of"), Q.list_titles(docs), Q.preview(docs, "body"), Q.pattern_matches(docs, V.FIXTURE_PATTERN_FAMILIES)):
        assert _token_passes(found) == 1
        assert found.count() == 3 or "family" in found.columns


def test_diff_renders_once(spark, tmp_path):
    rows = [(i, f"https://a.example.com/{i}", f"<p>the body of {i}</p>") for i in (1, 5, 11, 13, 14)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    diff = PQ.QUERIES["content_diff"](spark, str(tmp_path))
    assert _token_passes(diff) == 0  # digests are read back
    assert {r["slug"]: r["status"] for r in diff.collect()} == {"1": "unchanged", "5": "added", "11": "added", "13": "updated", "14": "unchanged"}


def test_topics_share_one_pass(spark):
    docs = _docs(spark).where("not _blank")
    held = spark.createDataFrame([("a.example.com", "junk")], "domain string, category string")
    categories = (V.Category("junk", ("body",), 1, "body of 1"), V.Category("other", ("body",), 1, "body"))
    found = Q.search_by_topic(docs, (("junk", "body"), ("none", "zzzz")), held, categories)
    assert _token_passes(found) == 0  # hits are read back
    assert sorted((r["topic"], r["slug"], r["tier"]) for r in found.collect()) == sorted(
        [("junk", str(i), "strong") for i in range(3)] + [("junk", "1", "strong")]
    )


def test_space_as_before(spark):
    wide = P.WS_LATIN + P.WS_WIDE
    texts = [None, "", "a", wide, f"{wide}a{wide}é{wide}", "a ​ b", "é  　x", "a\n\n b", "𝒳 "]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select(
        "s", py_strip("s").alias("p"), T.collapse_space("s").alias("c"), F.regexp_replace("s", P.STRIP, "").alias("sp"), F.regexp_replace("s", P.WS_RUN, " ").alias("cp")
    ).collect()
    assert all(c.isspace() for c in wide)
    for r in rows:
        assert (r["p"], r["c"]) == (r["sp"], r["cp"])


def test_term_counts(spark):
    words = spark.createDataFrame([(["b", "a", "b", "c", "b", "a"],), ([],), (["x"],)], "w array<string>")
    got = [{(t["term"], t["tf"]) for t in r[0]} for r in words.select(term_counts(F.col("w"))).collect()]
    assert got == [{("a", 2), ("b", 3), ("c", 1)}, set(), {("x", 1)}]


def test_keywords_of_repeated_pages(spark):
    """Rows with one key are one page; a page without a site counts for df only; no pair is shuffled for its tf."""
    rows = [("d", "u", 1, "Aa bb aa."), ("d", "u", 1, "bb bb"), ("d", "v", 2, None), (None, "w", 3, "bb"), ("d", "x", 4, "aa bb cc")]
    df = E.keyword_summary(spark.createDataFrame(rows, "domain string, url string, seq bigint, text string"), k=2)
    assert sorted(map(str, ((r["url"], r["keywords"], r["keyword_tf"]) for r in df.collect()))) == sorted(map(str, [
        ("u", "bb aa", 5), ("u", "bb aa", 5), ("v", "", 0), ("w", "", 0), ("x", "cc aa", 2),
    ]))


def test_a_page_is_rendered_by_one_branch(spark, tmp_path):
    """Pages that share a slug and those that do not are told apart below the rendering."""
    rows = [(i, f"https://a.example.com/{u}", f"<p>the body of {i}</p>") for i, u in ((1, "x"), (2, "x"), (3, "y"), (3, "z"), (4, "v"))]
    rows += [(None, "https://a.example.com/w", "<p>the body of none</p>"), (5, None, "<p>the body of 5</p>"), (6, "https://a.example.com/y", None)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    docs = PQ.QUERIES["page_docs"](spark, str(tmp_path))
    plan = docs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = {kind: [i for i, line in enumerate(plan) if f"Join {kind}" in line] for kind in ("LeftAnti", "LeftSemi")}
    passes = [i for i, line in enumerate(plan) if "<!--.*?" in line]
    assert len(passes) == 2 and all(any(p < j for j in found) for p, found in zip(passes, joins.values()))
    assert sorted((r["slug"], r["seq"] or 0) for r in docs.collect()) == [("index", 5), ("v", 4), ("w", 0), ("x", 2), ("y", 3), ("z", 3)]


def test_pages_of_one_row_group_are_dealt_to_all_tasks(spark, tmp_path):
    """One file of one row group is read by one task, but not rendered by one; null and repeated keys are dealt too."""
    rows = [(None if i % 4 == 0 else i % 50, f"https://a.example.com/{i}", f"<p>the body of {i}</p>") for i in range(200)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    for name in ("page_docs", "search_any"):
        docs = PQ.QUERIES[name](spark, str(tmp_path))
        places = [r["n"] for r in docs.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(places) == 200 and len(places) >= spark.sparkContext.defaultParallelism and max(places) < 60
    found = PQ.QUERIES["artifact_lines_by_domain"](spark, str(tmp_path))
    assert "_row" in found._jdf.queryExecution().optimizedPlan().toString() and found.first()["n_pages"] == 200


def test_long_texts_are_stripped_as_short_ones(spark):
    edges = ["", *P.WS_LATIN, *P.WS_WIDE]
    texts = [None, "", *(f"{e}a b{e}" for e in edges), *(f"{e}é" for e in edges), *(f"x{e}" for e in edges), P.WS_LATIN + P.WS_WIDE, "​a"]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select(py_strip("s").alias("p"), T.strip_text("s").alias("t")).collect()
    assert all(r["p"] == r["t"] for r in rows)
