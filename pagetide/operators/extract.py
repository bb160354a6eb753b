"""Job ``extract_pages`` (E1-E6): raw HTML corpus -> page table.

All of it is native expressions and joins. Main content (E2, E3) is one
token fold per page, which the page table and the markdown table share.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetide.session import computed, written
from pagetide.functions import html as H
from pagetide.functions import patterns as P
from pagetide.functions.urls import (
    drop_query,
    is_content_url,
    py_strip,
    url_slug,
    with_url_keys,
)


def main_text(markdown):
    """Plain text of a markdown-lite body: markup removed, whitespace collapsed."""
    s = F.regexp_replace(markdown, r"(?m)^#{1,6} ", "")
    s = F.regexp_replace(s, r"(?m)^- ", "")
    s = F.regexp_replace(s, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return H.plain_text(s)


def lead_text(markdown):
    """Main text without heading lines (source of the lead sentences)."""
    return main_text(F.regexp_replace(markdown, r"(?m)^#{1,6} .*$", ""))


def _nz(name: str):
    """'' -> NULL on a column computed in an earlier projection."""
    return F.when(F.col(name) != "", F.col(name))


def with_domain(df: DataFrame, url_col: str = "url", out: str = "domain") -> DataFrame:
    """Add the site key of ``url_col`` (normalisation staged in its own projections)."""
    tmp = f"_{out}_norm"
    return with_url_keys(df, url_col, nurl=tmp, domain=out).drop(tmp)


def keyed_pages(pages: DataFrame) -> DataFrame:
    """Site keys for raw pages: ``domain, url, seq`` plus the remaining columns."""
    rest = [c for c in pages.columns if c not in ("url", "page_id")]
    return with_domain(pages.select("url", F.col("page_id").alias("seq"), *rest)).select(
        "domain", "url", "seq", *rest
    )


def page_metadata(pages: DataFrame) -> DataFrame:
    """Head fields per page (NULL when absent)."""
    h, m = F.col("html"), F.col("_metas")
    raw = keyed_pages(pages).withColumn("_metas", H.meta_tags(h)).select(
        "domain", "url", "seq",
        H.meta_title(h).alias("title"),
        H.meta_description(m).alias("description"),
        H.og_description(m).alias("og_description"),
        H.og_url(m).alias("og_url"),
        H.page_lang(h).alias("lang"),
        H.first_h1(h).alias("h1"),
    )
    cols = ["title", "description", "og_description", "og_url", "lang", "h1"]
    return raw.select("domain", "url", "seq", *[_nz(c).alias(c) for c in cols])


def _markdown_stage(pages: DataFrame, *extra) -> DataFrame:
    staged = keyed_pages(pages)
    if extra:
        staged = staged.withColumn("_metas", H.meta_tags("html"))
    staged = staged.select("domain", "url", "seq", "html", *extra)
    return computed(staged, markdown=H.markdown_lite("html")).drop("html")


def _heads(html, metas) -> list:
    return [
        H.meta_title(html).alias("m_title"),
        H.meta_description(metas).alias("m_description"),
        H.og_description(metas).alias("m_og_description"),
        H.og_url(metas).alias("m_og_url"),
    ]


def _metadata():
    return F.struct(
        F.col("url").alias("sourceURL"),
        _nz("m_og_url").alias("ogUrl"),
        _nz("m_title").alias("title"),
        _nz("m_description").alias("description"),
        _nz("m_og_description").alias("ogDescription"),
    )


def page_heads(pages: DataFrame) -> DataFrame:
    """The page table's keys and metadata, for readers that need no body."""
    h, m = F.col("html"), F.col("_metas")
    heads = keyed_pages(pages).withColumn("_metas", H.meta_tags(h)).select("domain", "url", "seq", *_heads(h, m))
    return heads.select("domain", "url", "seq", _metadata().alias("metadata"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """E1+E3: the page table in the reference's shape.

    ``metadata`` = what the page declares (title, meta/og description, og url);
    ``json`` = what we derive from the body (first heading, lead sentence,
    lead of three sentences) in place of the reference's LLM extraction.
    """
    h, m = F.col("html"), F.col("_metas")
    s1 = _markdown_stage(
        pages,
        *_heads(h, m),
        H.first_h1(h).alias("j_title"),
    )
    # leads come from running text: heading lines are left out
    s2 = s1.withColumn("_text", lead_text(F.col("markdown")))
    s3 = s2.select(
        "*",
        H.lead_sentences("_text", 1).alias("j_description"),
        H.lead_sentences("_text", 3).alias("j_summary"),
    )
    return s3.select(
        "domain", "url", "seq", "markdown",
        _metadata().alias("metadata"),
        F.struct(
            _nz("j_title").alias("title"),
            _nz("j_description").alias("description"),
            _nz("j_summary").alias("summary"),
        ).alias("json"),
    )


def main_text_table(pages: DataFrame) -> DataFrame:
    """E3 as a table: one row per page with its plain main text."""
    return _markdown_stage(pages).select("domain", "url", "seq", main_text(F.col("markdown")).alias("text"))


def page_links(pages: DataFrame) -> DataFrame:
    """Every link of every page, resolved, with host and flags."""
    src = keyed_pages(pages.select("page_id", "url", "html")).select(
        "domain", "url", "seq", *H.base_parts("url"),
        F.posexplode(H.hrefs("html")).alias("pos", "href"),
    )
    stripped = src.withColumn("_h", py_strip("href"))
    resolved = stripped.withColumn("_r", H.resolve_href_parts("_h")).withColumn("target", H.remove_dot_segments("_r")).drop(
        "_r", "_h", "_b_scheme", "_b_origin", "_b_nofrag", "_b_noquery", "_b_dir"
    )
    with_td = with_domain(resolved, "target", "target_domain")
    return with_td.select(
        "domain", "url", "seq", "pos", "href", "target", "target_domain",
        F.coalesce(F.col("target_domain") == F.col("domain"), F.lit(False)).alias("is_same_site"),
        is_content_url("target").alias("is_content"),
    )


def discover_urls(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """E5: same-site content URLs found in pages and their links (map stand-in).

    Query and fragment dropped, https forced, distinct per site; with ``limit``
    the first that many per site by URL.
    """
    if limit is not None and limit < 1:
        raise ValueError(f"limit must be at least 1, got {limit}")
    own = keyed_pages(pages.select("page_id", "url")).select("domain", F.col("url").alias("found"))
    links = page_links(pages).select("domain", F.col("target").alias("found"))
    found = with_url_keys(own.unionByName(links), "found", nurl="_n", domain="_d")
    found = found.select("domain", drop_query("_n").alias("url"), "_d")
    # same-site, valid, content URLs only; counted inside the aggregate so no
    # row filter is pushed down through the URL projections (and the
    # same-site test of the link rows is the _d = domain test itself)
    valid = F.col("url").isNotNull() & is_content_url("url") & (F.col("_d") == F.col("domain"))
    distinct = found.groupBy("domain", "url").agg(F.count_if(valid).alias("n_refs")).where(F.col("n_refs") > 0)
    if limit is not None:
        distinct = first_n_per_key(distinct, ["domain"], [F.asc("url")], limit)
    return distinct.select("domain", "url", "n_refs", url_slug("url").alias("slug"))


def first_n_per_key(df: DataFrame, keys: list[str], order: list, n: int, buckets: int = 64) -> DataFrame:
    """First ``n`` rows per key in ``order``, in two rounds.

    Round one ranks inside (key, hash bucket) groups and keeps at most ``n``
    per bucket, so a hot key is spread over ``buckets`` tasks; round two
    ranks the survivors (at most ``buckets * n`` per key). Same result as one
    window over the whole key.
    """
    b = df.withColumn("_bkt", F.pmod(F.xxhash64(*df.columns), F.lit(buckets)))
    w1 = Window.partitionBy(*keys, "_bkt").orderBy(*order)
    b = b.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= n).drop("_r1", "_bkt")
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return b.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= n).drop("_r")


def term_counts(words):
    """The distinct words of an array with their counts: array of (term, tf)."""

    def runs(w):
        n = F.size(w)
        first = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(w, i) != F.get(w, i - 2)))
        counted = lambda f: F.transform(f, lambda i, j: F.struct(
            F.element_at(w, i).alias("term"), (F.coalesce(F.get(f, j + 1), n + 1) - i).cast("bigint").alias("tf")
        ))
        none = F.array().cast("array<struct<term:string,tf:bigint>>")
        return F.when(n > 0, H.let(first, counted)).otherwise(none)

    return H.let(F.sort_array(words), runs)


def _of_same_page(texts: DataFrame, page: list[str]) -> DataFrame:
    """One row per page key (``page`` and ``text``): the texts of rows that share a key
    put together, which are few; the others stay where they are read."""
    shared = written(texts.groupBy(*page).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in page]), "shared-pages")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in page])
    alone = texts.join(shared, same, "left_anti").select(*page, "text")
    joined = texts.join(shared, same, "left_semi").groupBy(*page).agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
    return alone.unionByName(joined)


#: Terms whose document frequencies are broadcast (some 300 KB).
HOT_TERMS = 10_000


def keyword_summary(text_df: DataFrame, k: int = 8, min_len: int = 1, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """Top-``k`` terms per page by (tf desc, df asc, term asc) + lead sentence.

    ``text_df`` has ``domain, url, seq, text``. Terms are lower-cased runs of
    letters/digits of at least ``min_len`` chars that are no ``stop_words``. df
    counts pages over the whole input; it is one partial-aggregated shuffle on
    ``term``. A page's terms are counted where its text is read and written once, as
    one row: no (page, term) pair is shuffled for its tf. Only terms that can reach a page's top ``k`` (those of its ``k``-th
    largest tf or more) are looked up in df: the ``HOT_TERMS`` of largest df, which
    are broadcast, where the rows are, the others by a join on ``term``, where none
    of them can hold more than one in ``HOT_TERMS`` of all (page, term) pairs.
    """
    page = ["domain", "url", "seq"]
    words = F.filter(
        F.split(F.lower(F.col("text")), P.TOKEN_SPLIT, -1),
        lambda w: (F.length(w) >= min_len) & (~w.isin(*stop_words) if stop_words else F.lit(True)),
    )
    terms = written(_of_same_page(text_df, page).select(*page, F.inline(F.array(F.struct(term_counts(words).alias("terms"))))), "page-terms")
    df_ = written(terms.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term-df")
    least = F.element_at(F.sort_array("terms.tf", asc=False), F.least(F.size("terms"), F.lit(k)))
    able = terms.where(F.size("terms") > 0).withColumn("_least", least)
    able = able.select(*page, F.inline(F.filter("terms", lambda t: t["tf"] >= F.col("_least"))))
    able = written(able, "terms-able")
    hot = df_.orderBy(F.desc("df"), F.asc("term")).limit(HOT_TERMS)
    looked = able.join(F.broadcast(hot), "term", "left")
    rare = looked.where(F.col("df").isNull()).drop("df").join(df_, "term")
    scored = looked.where(F.col("df").isNotNull()).unionByName(rare)
    w = Window.partitionBy("domain", "url", "seq").orderBy(F.desc("tf"), F.asc("df"), F.asc("term"))
    top = scored.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    kw = top.groupBy("domain", "url", "seq").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), " "
        ).alias("keywords"),
        F.sum("tf").cast("bigint").alias("keyword_tf"),
    )
    lead = text_df.select("domain", "url", "seq", H.lead_sentences(F.col("text"), 1).alias("lead"))
    lead = lead.withColumn("lead", _nz("lead"))
    return lead.join(kw, ["domain", "url", "seq"], "left").select(
        "domain", "url", "seq",
        F.coalesce("keywords", F.lit("")).alias("keywords"),
        F.coalesce("keyword_tf", F.lit(0).cast("bigint")).alias("keyword_tf"),
        "lead",
    )


def extract_markdown(pages: DataFrame) -> DataFrame:
    """Main-content markdown with its links and headings counted; the body
    is the page table's (E3)."""
    staged = keyed_pages(pages.select("page_id", "url", "html")).select("domain", "url", "seq", H.content_tokens("html").alias("_tokens"))
    return staged.select(
        "domain", "url", "seq", H.token_markdown("_tokens").alias("markdown"),
        H.count_links("_tokens").cast("int").alias("n_links"), H.count_headings("_tokens").cast("int").alias("n_headings"),
    )
