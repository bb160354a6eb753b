"""Job ``page_docs`` (P1-P3, K1, K2, S6): page table -> rendered page documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetide.functions import text as T
from pagetide.functions.urls import is_homepage, py_strip, url_slug
from pagetide.session import computed

PAGE_DOC_COLUMNS = ["domain", "slug", "url", "seq", "title", "description", "summary", "body", "content", "content_sha"]


def resolve_fields(page: DataFrame) -> DataFrame:
    """P1 + P2: one flat row per page, with the P2 blank-body flag ``_blank``.

    title: metadata.title, else json.title (HTML-stripped), else "Untitled";
    description: metadata.description, ogDescription, else json.description
    (stripped), else ""; summary: json.summary, always stripped;
    url: sourceURL, else ogUrl. Empty strings count as missing (T15).
    """
    m, j = F.col("metadata"), F.col("json")
    url = F.coalesce(T.nullif_blank(m["sourceURL"]), T.nullif_blank(m["ogUrl"]))
    title = F.coalesce(
        T.nullif_blank(m["title"]), T.nullif_blank(T.strip_html(j["title"])), F.lit("Untitled")
    )
    description = F.coalesce(
        T.nullif_blank(m["description"]),
        T.nullif_blank(m["ogDescription"]),
        T.strip_html(F.coalesce(j["description"], F.lit(""))),
    )
    summary = T.strip_html(F.coalesce(j["summary"], F.lit("")))
    # P2 is a flag, not a filter here: a filter on it would be pushed below
    # the projection that renders the markdown and re-run that whole regex
    # chain. ``page_docs`` drops blank pages after its per-slug window.
    return page.select(
        "domain",
        url.alias("url"),
        "seq",
        title.alias("title"),
        description.alias("description"),
        summary.alias("summary"),
        "markdown",
        (T.strip_text(F.coalesce("markdown", F.lit(""))) == "").alias("_blank"),
    )


def render(fields: DataFrame) -> DataFrame:
    """K1: header + wrapped summary + cleaned body -> one ``content`` string."""
    body = T.clean_body(T.br_to_newline(F.col("markdown")))
    content = F.concat(
        F.lit('---\ntitle: "'), T.yaml_escape(F.col("title")),
        F.lit('"\ndescription: "'), T.yaml_escape(F.col("description")),
        F.lit('"\nurl: "'), F.coalesce(F.col("url"), F.lit("")),
        F.lit('"\nsummary: |\n'), T.wrap_summary(F.col("summary")),
        F.lit("\n---\n\n"), F.col("body"),
    )
    done = [c for c in PAGE_DOC_COLUMNS if c not in ("domain", "seq", "content_sha")] + [c for c in ("_blank",) if c in fields.columns]
    staged = (
        fields.withColumn("slug", url_slug(F.coalesce(F.col("url"), F.lit(""))))
        .withColumn("body", body)
        .withColumn("content", content)
        .select("domain", "seq", *done)
    )
    once = computed(staged, **{c: F.col(c) for c in done}).withColumn("content_sha", F.sha2(F.col("content"), 256))
    return once.select(*PAGE_DOC_COLUMNS, *done[len(PAGE_DOC_COLUMNS) - 3:])


def _doc_columns(docs: DataFrame) -> list[str]:
    """Those of a document's columns that ``docs`` has."""
    return [c for c in PAGE_DOC_COLUMNS if c in docs.columns]


def last_per_slug(docs: DataFrame) -> DataFrame:
    """Decision 6: one document per ``(domain, slug)`` — the last in list order.

    Blank pages (P2) never win and are dropped; the filter sits after the
    window, so it cannot be pushed below the rendering projection.
    """
    blank = F.col("_blank") if "_blank" in docs.columns else F.lit(False)
    w = Window.partitionBy("domain", "slug").orderBy(blank.asc(), F.desc("seq"), F.desc("url"))
    out = docs.withColumn("_b", blank).withColumn("_r", F.row_number().over(w))
    return out.where((F.col("_r") == 1) & ~F.col("_b")).select(*_doc_columns(docs))


def rival_pages(keys: DataFrame) -> DataFrame:
    """``seq`` of the pages (domain, url, seq) that may share a document with
    another one: those whose (domain, slug) is not theirs alone, and those without
    a site (what they declare may name any slug). No text is read."""
    slugs = keys.select(F.coalesce("domain", F.lit("")).alias("domain"), "seq", url_slug(F.coalesce("url", F.lit(""))).alias("slug"))
    crowded = slugs.groupBy("domain", "slug").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("domain", "slug")
    rivals = slugs.join(crowded, ["domain", "slug"], "left_semi").unionByName(slugs.where("domain = ''"))
    return rivals.select("seq").distinct()


def one_per_slug(docs: DataFrame, rivals: DataFrame) -> DataFrame:
    """``last_per_slug`` with the winners chosen before texts move: only the
    documents of ``rivals`` (seq) are shuffled, the others are their slug's only
    ones. ``rivals`` is a written table, so its size decides how it is joined."""
    return _one_per_slug(docs.join(rivals, "seq", "left_anti"), docs.join(rivals, "seq", "left_semi"))


def rendered_once(rows: DataFrame, key: str, rivals: DataFrame, rendering) -> DataFrame:
    """``one_per_slug`` of ``rendering(rows)``, where ``rows`` are pages or a page table
    and ``key`` is their ``seq``. They are dealt to the two branches before a text is
    touched: a join above the rendering stays above it, and both would render all."""
    return _one_per_slug(*(rendering(rows.join(rivals, rows[key] == rivals["seq"], how)) for how in ("left_anti", "left_semi")))


def _one_per_slug(alone: DataFrame, rival: DataFrame) -> DataFrame:
    return alone.where(~F.col("_blank")).select(*_doc_columns(alone)).unionByName(last_per_slug(rival))


def page_docs(page: DataFrame) -> DataFrame:
    return last_per_slug(render(resolve_fields(page)))


def content_diff(new_docs: DataFrame, prev_docs: DataFrame) -> DataFrame:
    """K2: added / updated / unchanged per ``(domain, slug)``.

    Join on the key, compare the 64-hex digest (content equality would move
    whole documents through the join's equality check; the digest is enough
    and the shuffle carries only keys + digests).
    """
    prev = prev_docs.select("domain", "slug", F.col("content_sha").alias("prev_sha"))
    cur = new_docs.select("domain", "slug", "url", "content_sha")
    j = cur.join(prev, ["domain", "slug"], "left")
    status = (
        F.when(F.col("prev_sha").isNull(), "added")
        .when(F.col("prev_sha") == F.col("content_sha"), "unchanged")
        .otherwise("updated")
    )
    return j.select("domain", "slug", "url", status.alias("status"), "content_sha")


def homepage(page: DataFrame) -> DataFrame:
    """Per site, the first page (by ``seq``) whose URL is the site root."""
    url = F.coalesce(T.nullif_blank(F.col("metadata.sourceURL")), T.nullif_blank(F.col("metadata.ogUrl")))
    cand = page.select("domain", url.alias("url"), "seq").where(is_homepage(F.col("url"), F.col("domain")))
    return cand.groupBy("domain").agg(F.min_by(F.struct("url", "seq"), F.col("seq")).alias("h")).select(
        "domain", "h.url", "h.seq"
    )


def parse_page_docs(docs: DataFrame, column: str = "content") -> DataFrame:
    """Header fields and body back out of a rendered document.

    Inverse of K1 up to its normalisations: escapes undone, summary
    un-wrapped into single-spaced text.
    """
    c = F.col(column)
    header = F.regexp_extract(c, r"(?s)\A---\n(.*?)\n---\n", 1)

    def field(name: str) -> F.Column:
        raw = F.regexp_extract(header, r"(?m)^" + name + r": \"(.*)\"$", 1)
        return F.replace(F.replace(raw, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))

    summary_block = F.regexp_extract(header, r"(?s)\nsummary: \|\n(.*)\z", 1)
    summary = py_strip(F.regexp_replace(summary_block, r"[ \n]+", " "))
    body = F.regexp_extract(c, r"(?s)\A---\n.*?\n---\n\n(.*)\z", 1)
    keep = [x for x in ("domain", "slug") if x in docs.columns]
    return docs.select(
        *keep,
        field("title").alias("title"),
        field("description").alias("description"),
        field("url").alias("url"),
        summary.alias("summary"),
        body.alias("body"),
    )
