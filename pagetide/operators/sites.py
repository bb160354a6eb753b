"""Per-site aggregates (A1-A10).

Every job reduces pages to one row (or a handful) per site with partial
aggregates; no page body is ever collected into a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetide.functions import text as T
from pagetide.functions.urls import site_name
from pagetide.plans import vocab as V

COST_MAP = 1        # fixed value: credits per map call
COST_PER_PAGE = 5   # fixed value: credits per fetched page


def sync_report(diff: DataFrame) -> DataFrame:
    """A1: added / updated / unchanged / total per site (from K2)."""
    return diff.groupBy("domain").agg(
        F.count_if(F.col("status") == "added").alias("added"),
        F.count_if(F.col("status") == "updated").alias("updated"),
        F.count_if(F.col("status") == "unchanged").alias("unchanged"),
        F.count(F.lit(1)).alias("total"),
    )


def cost_estimate(queue_uncapped: DataFrame, prev_docs: DataFrame, max_pages: int | None = None) -> DataFrame:
    """A2: quote before fetching: 1 + 5 x pages, capped; create vs update."""
    n = queue_uncapped.groupBy("domain").agg(F.count(F.lit(1)).alias("n_queue"))
    known = prev_docs.select("domain").distinct().withColumn("_known", F.lit(True))
    capped = F.lit(max_pages is not None) & (F.col("n_queue") > F.lit(max_pages or 0))
    count = F.when(capped, F.lit(max_pages or 0).cast("bigint")).otherwise(F.col("n_queue"))
    return n.join(known, "domain", "left").select(
        "domain", "n_queue",
        capped.alias("capped"),
        count.alias("scrape_count"),
        (COST_MAP + COST_PER_PAGE * count).cast("bigint").alias("est_credits"),
        F.when(F.col("_known"), "update").otherwise("create").alias("action"),
    )


def run_cost(fetched: DataFrame, sites: DataFrame, cache_only: bool = False, force: bool = False) -> DataFrame:
    """A3: credits a run spent: 0 cache-only, 1 map only, else 1 + 5 x fetched."""
    n = sites.select("domain").distinct().join(
        fetched.groupBy("domain").agg(F.count(F.lit(1)).alias("n_fetched")), "domain", "left"
    ).withColumn("n_fetched", F.coalesce("n_fetched", F.lit(0).cast("bigint")))
    credits = (
        F.when(F.lit(cache_only), F.lit(0))
        .when((F.col("n_fetched") == 0) & F.lit(not force), F.lit(COST_MAP))
        .otherwise(COST_MAP + COST_PER_PAGE * F.col("n_fetched"))
    )
    return n.select("domain", "n_fetched", credits.cast("bigint").alias("credits"))


def dry_run_preview(
    effective: DataFrame, backfill: DataFrame, force: bool = False, max_pages: int | None = None
) -> DataFrame:
    """A4: what a run would do, per site, without writing anything."""
    e = effective.groupBy("domain").agg(
        F.count_if(F.col("status") != "deleted").alias("total"),
        F.count_if(F.col("status") == "new").alias("new"),
        F.count_if(F.col("status") == "unchanged").alias("unchanged"),
        F.count_if(F.col("status") == "deleted").alias("deleted"),
    )
    b = backfill.groupBy("domain").agg(F.count(F.lit(1)).alias("backfill"))
    j = e.join(b, "domain", "left").withColumn("backfill", F.coalesce("backfill", F.lit(0).cast("bigint")))
    to_scrape = F.col("total") if force else F.col("new") + F.col("backfill")
    capped = F.lit(max_pages is not None) & (to_scrape > F.lit(max_pages or 0))
    count = F.when(capped, F.lit(max_pages or 0).cast("bigint")).otherwise(to_scrape)
    return j.select(
        "domain", "total", "new", "unchanged", "deleted", "backfill",
        to_scrape.alias("pages_to_scrape"),
        capped.alias("capped"),
        count.alias("scrape_count"),
        (COST_MAP + COST_PER_PAGE * count).cast("bigint").alias("est_credits"),
        ((count == 0) & (F.col("deleted") == 0)).alias("up_to_date"),
    )


def _category_array(categories: Sequence[V.Category]) -> F.Column:
    rows = [
        f"named_struct('cat_order', {i}, 'category', {T.sql_lit(c.name)}, 'expansion', {T.sql_lit(c.expansion)}, "
        f"'keyword', {T.sql_lit(kw)}, 'min_hits', {c.min_hits})"
        for i, c in enumerate(categories)
        for kw in c.keywords
    ]
    return T.sql_array(rows)


def page_title_summary(page: DataFrame) -> DataFrame:
    """Lower-cased ``title + ' ' + summary`` per page (T13/T14 precedence)."""
    title = F.coalesce(T.nullif_blank(F.col("metadata.title")), T.nullif_blank(F.col("json.title")), F.lit(""))
    summary = F.coalesce(T.nullif_blank(F.col("json.summary")), F.lit(""))
    return page.select("domain", "seq", F.lower(F.concat(title, F.lit(" "), summary)).alias("text"))


def site_expansions(page: DataFrame, categories: Sequence[V.Category] = V.REFERENCE_CATEGORIES) -> DataFrame:
    """A5: categories with >= min_hits distinct keywords present on the site.

    Substring match (T13), evaluated per page (Decision 9): one pass over
    pages with the keyword list as a literal array; only (site, category,
    keyword) hits are shuffled, pre-aggregated per partition.
    """
    t = page_title_summary(page)
    hits = t.select(
        "domain",
        F.explode(F.filter(_category_array(categories), lambda k: F.col("text").contains(k["keyword"]))).alias("k"),
    ).select("domain", "k.cat_order", "k.category", "k.expansion", "k.keyword", "k.min_hits")
    g = hits.groupBy("domain", "cat_order", "category", "expansion", "min_hits").agg(
        F.countDistinct("keyword").alias("n_keywords")
    )
    ok = g.where(F.col("n_keywords") >= F.col("min_hits"))
    w = Window.partitionBy("domain").orderBy("cat_order")
    return (
        ok.withColumn("cat_rank", F.row_number().over(w).cast("int"))
        .where(F.col("cat_rank") <= V.MAX_CATEGORIES)
        .select("domain", "category", "n_keywords", "cat_rank", "expansion")
    )


def site_description(
    page: DataFrame,
    homepages: DataFrame,
    rules: Sequence[V.DescriptionRule] = V.REFERENCE_DESCRIPTION_RULES,
    manual: Mapping[str, str] | None = None,
    title_pages: int | None = None,
) -> DataFrame:
    """Manual -> homepage fields -> title rules over the pages -> generic.

    The rules read the titles of all pages of a site, or with ``title_pages`` of the
    first that many in list order. ``homepages`` is the output of ``assemble.homepage`` (domain, url, seq).
    Output ``(domain, description, tier)``.
    """
    sites = page.select("domain").distinct()
    # tier 2: fields of the homepage row
    hp = homepages.select("domain", "seq").join(
        page.select("domain", "seq", "metadata", "json"), ["domain", "seq"]
    )
    jd = T.py_strip(F.coalesce(F.col("json.description"), F.lit("")))
    js = T.py_strip(F.coalesce(F.col("json.summary"), F.lit("")))
    md = T.py_strip(F.coalesce(F.col("metadata.description"), F.lit("")))
    og = T.py_strip(F.coalesce(F.col("metadata.ogDescription"), F.lit("")))
    hp = hp.select(
        "domain",
        F.when(F.length(jd) > V.HOMEPAGE_MIN_DESCRIPTION, jd).alias("t2a"),
        F.when(F.length(js) > V.HOMEPAGE_MIN_SUMMARY, T.condense_summary(js)).alias("t2b"),
        F.when(F.length(md) > V.HOMEPAGE_MIN_DESCRIPTION, md).alias("t2c"),
        F.when(F.length(og) > V.HOMEPAGE_MIN_DESCRIPTION, og).alias("t2d"),
    )
    # tier 3: json.title before metadata.title
    title = F.lower(F.coalesce(T.nullif_blank(F.col("json.title")), T.nullif_blank(F.col("metadata.title")), F.lit("")))
    first = page.select("domain", "seq", title.alias("t"))
    if title_pages is not None:
        from pagetide.operators.extract import first_n_per_key

        first = first_n_per_key(first, ["domain"], [F.asc("seq")], title_pages)
    rule_hits = first.groupBy("domain").agg(
        *[
            F.bool_or(F.exists(T.sql_array([T.sql_lit(x) for x in r.terms]), lambda x: F.col("t").contains(x))).alias(f"r{i}")
            for i, r in enumerate(rules)
        ]
    )
    t3 = F.coalesce(*[F.when(F.col(f"r{i}"), F.lit(r.description)) for i, r in enumerate(rules)], F.lit(None).cast("string"))
    manual_col = F.lit(None).cast("string")
    if manual:
        m = F.create_map(*[x for kv in manual.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
        manual_col = T.nullif_blank(T.py_strip(F.element_at(m, F.col("domain"))))
    j = sites.join(hp, "domain", "left").join(rule_hits.select("domain", t3.alias("t3")), "domain", "left")
    generic = F.concat(F.lit("a website at "), F.col("domain"))
    tiers = [
        (manual_col, "manual"), (F.col("t2a"), "homepage_description"), (F.col("t2b"), "homepage_summary"),
        (F.col("t2c"), "meta_description"), (F.col("t2d"), "og_description"), (F.col("t3"), "title_rules"),
    ]
    desc = F.coalesce(*[c for c, _ in tiers], generic)
    tier = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for c, n in tiers], F.lit("generic"))
    return j.select("domain", desc.alias("description"), tier.alias("tier"))


def asset_filter_report(found: DataFrame) -> DataFrame:
    """Per site, URLs found and how many the asset filter removes.

    ``found`` has ``domain, url, is_content``.
    """
    d = found.select("domain", "url", "is_content").dropDuplicates(["domain", "url"])
    return d.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_urls"),
        F.count_if(~F.col("is_content")).alias("n_removed"),
    )


def pending_deletions(counter: DataFrame, show: int = 5) -> DataFrame:
    """Pending candidates per site and the first five (by URL)."""
    from pagetide.operators.extract import first_n_per_key

    p = counter.where(F.col("action") == "pending").select("domain", "url")
    n = p.groupBy("domain").agg(F.count(F.lit(1)).alias("n_pending"))
    first = first_n_per_key(p, ["domain"], [F.asc("url")], show).groupBy("domain").agg(
        F.array_join(F.array_sort(F.collect_list("url")), " ").alias("first_pending")
    )
    return n.join(first, "domain")


def batch_status(batches: DataFrame) -> DataFrame:
    """A10, A3: batches, URLs and reported credits per site, status and kind of
    failure: the service said so (batch_failed), it took too long (poll_timeout),
    or a call failed and left its message (message)."""
    error = F.col("error")
    kind = F.when(error.isNull(), "").when(error.isin("batch_failed", "poll_timeout"), error).otherwise("message")
    return batches.groupBy("domain", "status", kind.alias("error")).agg(
        F.count(F.lit(1)).alias("n_batches"), F.sum("n_urls").cast("bigint").alias("n_urls"),
        F.coalesce(F.sum("credits_used"), F.lit(0)).cast("bigint").alias("credits_used"),
    )


def site_manifest(report: DataFrame, expansions: DataFrame, description: DataFrame) -> DataFrame:
    """Name, description, page count and expansion categories per site, with
    a line ``- **category**: `pattern``` for each that a search can use."""
    line = lambda s: F.concat(F.lit("- **"), s["category"], F.lit("**: `"), s["expansion"], F.lit("`"))
    ranked = F.array_sort(F.collect_list(F.struct("cat_rank", "category", "expansion")))  # MAX_CATEGORIES at most
    e = expansions.groupBy("domain").agg(ranked.alias("c")).select(
        "domain", F.array_join(F.transform("c", lambda s: s["category"]), "; ").alias("expansions"),
        F.array_join(F.transform("c", line), "\n").alias("expansion_lines"),
    )
    return (
        description.join(report.select("domain", F.col("total").alias("page_count")), "domain", "left")
        .join(e, "domain", "left")
        .select(
            "domain",
            site_name(F.col("domain")).alias("site_name"),
            "description",
            F.coalesce("page_count", F.lit(0).cast("bigint")).alias("page_count"),
            F.coalesce("expansions", F.lit("")).alias("expansions"),
            F.coalesce("expansion_lines", F.lit("")).alias("expansion_lines"),
        )
    )
