"""Search over rendered page documents (Q1-Q15).

The reference documents a ripgrep workflow over files; here each step is a
predicate or projection over the ``page_docs`` table. Patterns are literals,
so each regex compiles once per task. Case-insensitive matching lower-cases
both sides (same result in Java and RE2, unlike their ``(?i)`` on non-ASCII).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetide.functions import patterns as P
from pagetide.session import written

PREVIEW_LINES = 12          # fixed value: header preview length of the reference
TOO_MANY = 20               # fixed value: "20+ results -> narrow"
DEFAULT_TOP = 5             # "start with 2-5 pages"
SAMPLES_PER_CATEGORY = 3    # "2-3 representative pages per category"

# Page types recognised from the first slug segment (anything else is its own type).
PAGE_TYPES = (
    ("services", ("services", "service", "treatments", "procedures", "solutions")),
    ("blog", ("blog", "news", "articles", "posts", "insights")),
    ("about", ("about", "team", "company", "who-we-are")),
    ("contact", ("contact", "locations", "location")),
    ("pricing", ("pricing", "plans", "price")),
    ("docs", ("docs", "documentation", "guide", "guides", "help", "faq")),
    ("products", ("product", "products", "shop", "store")),
)


def matches(c: Column, pattern: str) -> Column:
    """Case-insensitive regex search (``rg -i``)."""
    return F.lower(c).rlike(pattern.lower())


def terms_of(pattern: str) -> list[str]:
    return [t for t in pattern.split("|") if t]


def search_any(docs: DataFrame, pattern: str) -> DataFrame:
    """Q1: pages where any line matches (names only)."""
    return docs.where(matches(F.col("content"), pattern)).select("domain", "slug", "url")


def search_narrow(docs: DataFrame, broad: str, specific: str) -> DataFrame:
    """Q2: pages matching both patterns (anywhere in the file)."""
    return docs.where(matches(F.col("content"), broad) & matches(F.col("content"), specific)).select(
        "domain", "slug", "url"
    )


def match_lines(docs: DataFrame, pattern: str) -> DataFrame:
    """Q3: matching lines with their page and 1-based line number."""
    lines = docs.select("domain", "slug", F.posexplode(F.split(F.col("content"), "\n", -1)).alias("pos", "line"))
    return lines.where(matches(F.col("line"), pattern)).select(
        "domain", "slug", (F.col("pos") + 1).cast("int").alias("line_no"), "line"
    )


def preview(docs: DataFrame, pattern: str, n_lines: int = PREVIEW_LINES) -> DataFrame:
    """Q4: first 12 lines of every hit."""
    head = F.array_join(F.slice(F.split(F.col("content"), "\n", -1), 1, n_lines), "\n")
    return docs.where(matches(F.col("content"), pattern)).select("domain", "slug", head.alias("preview"))


def list_titles(docs: DataFrame) -> DataFrame:
    """Q5: vocabulary discovery (``rg "^title:"``)."""
    return docs.select("domain", "slug", "title")


def list_slugs(docs: DataFrame) -> DataFrame:
    """Q5: file names (``ls``)."""
    return docs.select("domain", "slug")


TIER_ORDER = {"strong": 1, "moderate": 2, "weak": 3}


def _tier(pattern: str) -> Column:
    strong = matches(F.col("title"), pattern) | matches(F.col("summary"), pattern)
    moderate = (
        matches(F.col("description"), pattern) | matches(F.col("url"), pattern) | matches(F.col("slug"), pattern)
    )
    weak = matches(F.col("body"), pattern)
    return F.when(strong, "strong").when(moderate, "moderate").when(weak, "weak")


def _matched_terms(pattern: str) -> Column:
    ts = terms_of(pattern)
    return sum((F.when(matches(F.col("content"), t), 1).otherwise(0) for t in ts), F.lit(0)).cast("int")


def rank_tiers(docs: DataFrame, pattern: str, keep_weak: bool = False) -> DataFrame:
    """Q6: strong = title or summary; moderate = description, url or slug;
    weak = body only (dropped unless ``keep_weak``)."""
    t = docs.select(
        "domain", "slug", "url", "title", _tier(pattern).alias("tier"), _matched_terms(pattern).alias("matched_terms")
    )
    keep = ["strong", "moderate", "weak"] if keep_weak else ["strong", "moderate"]
    return t.where(F.col("tier").isin(*keep))


def top_pages(ranked: DataFrame, n: int = DEFAULT_TOP) -> DataFrame:
    """Q7: best ``n`` pages per site by (tier, matched terms desc, url)."""
    from pagetide.operators.extract import first_n_per_key

    tier_rank = F.when(F.col("tier") == "strong", 1).when(F.col("tier") == "moderate", 2).otherwise(3)
    order = [tier_rank, F.desc("matched_terms"), F.asc("url"), F.asc("slug")]
    top = first_n_per_key(ranked, ["domain"], order, n)
    w = Window.partitionBy("domain").orderBy(*order)
    return top.withColumn("rank", F.row_number().over(w).cast("int"))


QUICK, MODERATE, FIRST_LOAD = 3, 7, 5  # pages per load band, and loaded first


def load_bands(ranked: DataFrame) -> DataFrame:
    """Q7: per site how many candidates a search has, the band that this makes it
    (quick up to 3 pages, moderate up to 7, deep beyond) and how many to load
    first."""
    g = ranked.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_if(F.col("tier") == "strong").alias("n_strong")
    )
    n = F.col("n_candidates")
    band = F.when(n <= QUICK, "quick").when(n <= MODERATE, "moderate").otherwise("deep")
    return g.select("domain", "n_candidates", "n_strong", band.alias("band"), F.least(n, F.lit(FIRST_LOAD)).cast("bigint").alias("n_first"))


def _topic_hits(docs: DataFrame, topics: Sequence[tuple[str, str]]) -> DataFrame:
    hits = F.filter(
        F.array(*[F.when(matches(F.col("content"), pat), F.lit(name)) for name, pat in topics]),
        lambda x: x.isNotNull(),
    )
    return docs.select("domain", "slug", "url", "title", "summary", "description", "body", F.explode(hits).alias("topic"))


def search_by_topic(
    docs: DataFrame, topics: Sequence[tuple[str, str]], expansions: DataFrame | None = None, categories: Sequence = ()
) -> DataFrame:
    """Q8: expand each topic to its synonym pattern and search; tier per hit.

    With ``expansions`` (domain, category) a site's own categories are topics too:
    every page is matched against all ``categories`` where it is read, and the
    hits, keys only, stay where the site has the category. No text is shuffled.
    """
    if expansions is None:
        return _tiered(docs, topics)
    # one pass over the documents: a topic and a category may have the same name
    both = [(f"t:{name}", pat) for name, pat in topics] + [(f"c:{c.name}", c.expansion) for c in categories]
    hits = written(_tiered(docs, both), "topic-hits")
    of = lambda kind: hits.where(F.col("topic").startswith(kind)).withColumn("topic", F.substr("topic", F.lit(3)))
    held = expansions.select("domain", F.col("category").alias("topic"))
    return of("t:").unionByName(of("c:").join(held, ["domain", "topic"], "left_semi").select(*hits.columns))


def _tiered(docs: DataFrame, topics: Sequence[tuple[str, str]]) -> DataFrame:
    pats = dict(topics)
    h = _topic_hits(docs, topics)
    tier = F.coalesce(*[F.when(F.col("topic") == name, _tier(pat)) for name, pat in pats.items()])
    return h.select("topic", "domain", "slug", "url", tier.alias("tier")).where(F.col("tier").isNotNull())


def too_many_results(docs: DataFrame, topics: Sequence[tuple[str, str]], threshold: int = TOO_MANY) -> DataFrame:
    """Q9: hits per (topic, site) with advice: narrow at 20+, broaden at 0."""
    sites = docs.select("domain").distinct()
    names = F.array(*[F.lit(n) for n, _ in topics])
    grid = sites.select("domain", F.explode(names).alias("topic"))
    hits = _topic_hits(docs, topics).groupBy("topic", "domain").agg(F.count(F.lit(1)).alias("n_hits"))
    j = grid.join(hits, ["topic", "domain"], "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0).cast("bigint")))
    advice = F.when(F.col("n_hits") >= threshold, "narrow").when(F.col("n_hits") == 0, "broaden").otherwise("ok")
    return j.select("topic", "domain", "n_hits", advice.alias("advice"))


def citations(top: DataFrame) -> DataFrame:
    """Q10: ``- [title](url)`` for every page used."""
    return top.select("domain", "slug", F.concat(F.lit("- ["), "title", F.lit("]("), "url", F.lit(")")).alias("citation"))


LINK_MD = r"\[([^\]\n]*)\]\(([^)\n]*)\)"


def markdown_links(df: DataFrame, column: str, keys: Sequence[str] = ("domain", "slug")) -> DataFrame:
    """Q11: ``[text](url)`` occurrences of a markdown column, in order."""
    texts = F.regexp_extract_all(F.col(column), F.lit(LINK_MD), F.lit(1))
    urls = F.regexp_extract_all(F.col(column), F.lit(LINK_MD), F.lit(2))
    z = df.select(*keys, F.posexplode(F.arrays_zip(texts.alias("text"), urls.alias("href"))).alias("pos", "l"))
    return z.select(*keys, "pos", F.col("l.text").alias("text"), F.col("l.href").alias("href"))


def full_page_markdown(pages: DataFrame) -> DataFrame:
    """Whole-page text with anchors as markdown links (navigation kept)."""
    from pagetide.operators.extract import keyed_pages

    md = F.col("html")
    for anchor in P.ANCHORS:
        md = F.regexp_replace(md, anchor, "[$2]($1)")
    return keyed_pages(pages.select("page_id", "url", "html")).select("domain", "url", "seq", md.alias("md"))


def pattern_matches(docs: DataFrame, families: Sequence[tuple[str, str]]) -> DataFrame:
    """Q12: one pass, every family: ``(domain, slug, family, phrase, n)``."""
    low = F.lower(F.col("content"))
    found = F.array(
        *[
            F.struct(F.lit(name).alias("family"), F.regexp_extract_all(low, F.lit(pat.lower()), F.lit(0)).alias("m"))
            for name, pat in families
        ]
    )
    x = docs.select("domain", "slug", F.explode(found).alias("f")).select(
        "domain", "slug", F.col("f.family").alias("family"), F.explode("f.m").alias("phrase")
    )
    return x.groupBy("domain", "slug", "family", "phrase").agg(F.count(F.lit(1)).alias("n"))


def categorize_pages(docs: DataFrame) -> DataFrame:
    """Q13: page type from the first slug segment."""
    seg = F.substring_index(F.col("slug"), "--", 1)
    cat = F.when(F.col("slug") == "index", F.lit("homepage"))
    for name, keys in PAGE_TYPES:
        cat = cat.when(seg.isin(*keys), F.lit(name))
    cat = cat.otherwise(F.when(seg == "", F.lit("other")).otherwise(seg))
    return docs.select("domain", "slug", "url", "seq", cat.alias("category"))


def sample_per_category(categorized: DataFrame, n: int = SAMPLES_PER_CATEGORY) -> DataFrame:
    """Q14: first ``n`` pages (list order) of every (site, category)."""
    from pagetide.operators.extract import first_n_per_key

    order = [F.asc("seq"), F.asc("slug")]
    top = first_n_per_key(categorized, ["domain", "category"], order, n)
    w = Window.partitionBy("domain", "category").orderBy(*order)
    return top.withColumn("sample_rank", F.row_number().over(w).cast("int"))


def synthesize_top(found: DataFrame, n: int = 10) -> DataFrame:
    """Q15: phrases ranked within each family across all pages."""
    g = found.groupBy("family", "phrase").agg(
        F.sum("n").cast("bigint").alias("n_occurrences"),
        F.count(F.lit(1)).alias("n_pages"),
        F.countDistinct("domain").alias("n_sites"),
    )
    order = [F.desc("n_pages"), F.desc("n_occurrences"), F.asc("phrase")]
    # two-level top-n: a family can hold millions of phrases, so rank inside
    # hash buckets first and only the per-bucket winners meet in one window
    g = g.withColumn("_b", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    w1 = Window.partitionBy("family", "_b").orderBy(*order)
    g = g.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= n).drop("_r", "_b")
    w = Window.partitionBy("family").orderBy(*order)
    return g.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= n)
