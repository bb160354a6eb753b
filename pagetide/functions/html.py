"""HTML fields (E1, E3, E4) as native Column expressions.

They run in the JVM with no Python worker. Tag nesting is not regular: main
content is a fold over a page's tags with the open elements as state (one
regex pass cuts the page into tokens; the fold sees only the tags that can
matter), so nested blocks end at their own end tags.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetide.functions import patterns as P
from pagetide.functions.text import collapse_space, decode_entities, strip_text
from pagetide.functions.urls import _c, py_strip


def _field(html: Column, pattern: str) -> Column:
    """First capture of pattern, tags dropped, entity-decoded, whitespace-collapsed.

    '' when absent; callers turn '' into NULL in a later projection so the
    regex tree is not duplicated.
    """
    raw = F.regexp_extract(html, pattern, 1)
    return py_strip(F.regexp_replace(decode_entities(F.regexp_replace(raw, P.ANY_TAG, "")), P.WS_RUN, " "))


def meta_title(html: Column | str) -> Column:
    return _field(_c(html), P.TITLE)


def first_h1(html: Column | str) -> Column:
    return _field(_c(html), P.H1)


def meta_tags(html: Column | str) -> Column:
    """All meta tags of a page as one short text: one pass, whatever is read from them."""
    return F.array_join(F.regexp_extract_all(_c(html), F.lit(P.META_TAG), F.lit(0)), "")


def meta_value(html: Column | str, attr: str, value: str) -> Column:
    """Meta tag content in either attribute order ('' when absent)."""
    h = _c(html)
    raw = F.coalesce(
        *[F.nullif(_quoted(h, p), F.lit("")) for p in (P.meta_content(attr, value), P.meta_content_first(attr, value))], F.lit("")
    )
    return py_strip(F.regexp_replace(decode_entities(F.regexp_replace(raw, P.ANY_TAG, "")), P.WS_RUN, " "))


def _quoted(html: Column, pattern: str) -> Column:
    """The value that ``P.QUOTED`` captures at the end of a pattern's match."""
    return F.concat(F.regexp_extract(html, pattern, 1), F.regexp_extract(html, pattern, 2))


def meta_description(html: Column | str) -> Column:
    return meta_value(html, "name", "description")


def og_description(html: Column | str) -> Column:
    return meta_value(html, "property", "og:description")


def og_url(html: Column | str) -> Column:
    return meta_value(html, "property", "og:url")


def page_lang(html: Column | str) -> Column:
    return F.lower(_quoted(_c(html), P.LANG))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def page_tokens(html: Column | str) -> Column:
    """Comments, tags and texts of a page in order: array of (t, name, i); name
    is '' for what is no tag."""
    found = F.regexp_extract_all(_c(html), F.lit(P.TOKEN), F.lit(0))
    name = lambda t: F.when(t.startswith("<"), F.lower(F.regexp_extract(t, P.TAG_NAME, 1))).otherwise("")
    return F.transform(found, lambda t, i: F.struct(t.alias("t"), name(t).alias("name"), i.alias("i")))


_FOLD = "struct<stack:array<string>,skip:int,start:int,ranges:array<struct<a:int,b:int>>>"


def _excluded_ranges(tokens: Column) -> Column:
    """Token ranges [a, b) of the outermost blocks that are no content.

    One fold over the tags that matter. The state is the stack of open
    elements, the stack's size at which a block to leave out began (0: none),
    its first token, and the ranges found so far. An end tag closes all that is
    open inside its element; one that nothing opened is passed over.
    """
    n = F.size(tokens)
    tags = F.filter(tokens, lambda x: x["name"].isin(*P.TRACKED_TAGS) & ~x["t"].endswith("/>"))
    bad = lambda x: x["name"].isin(*P.EXCLUDED_TAGS) | x["t"].rlike(P.EXCLUDED_CLASS)
    marked = F.transform(
        tags, lambda x: F.struct(x["name"].alias("name"), x["i"].alias("i"), x["t"].startswith("</").alias("end"), bad(x).alias("bad"))
    )

    def cut(acc, size, at):
        """The state with the stack cut to ``size`` at token ``at``."""
        over = (acc["skip"] > 0) & (size < acc["skip"])
        done = F.concat(acc["ranges"], F.array(F.struct(acc["start"].alias("a"), at.cast("int").alias("b"))))
        return F.struct(
            F.slice(acc["stack"], F.lit(1), size).alias("stack"), F.when(over, 0).otherwise(acc["skip"]).alias("skip"),
            acc["start"].alias("start"), F.when(over, done).otherwise(acc["ranges"]).alias("ranges"),
        )

    def opened(acc, x):
        size = F.size(acc["stack"])
        top = F.when(size > 0, F.element_at(acc["stack"], -1))
        held = F.when(acc["skip"] > 0, F.get(acc["stack"], acc["skip"] - 1))
        kept = (
            F.when((top == x["name"]) & x["name"].isin(*P.SELF_CLOSING_SIBLINGS), size - 1)
            .when(x["name"].isin(*P.CONTENT_TAGS) & held.isin(*P.NEVER_AROUND_CONTENT), acc["skip"] - 1)
        )
        before = F.when(kept.isNull(), acc).otherwise(cut(acc, kept, x["i"]))

        def push(b):
            begins = (b["skip"] == 0) & x["bad"]
            return F.struct(
                F.concat(b["stack"], F.array(x["name"])).alias("stack"),
                F.when(begins, F.size(b["stack"]) + 1).otherwise(b["skip"]).alias("skip"),
                F.when(begins, x["i"].cast("int")).otherwise(b["start"]).alias("start"), b["ranges"].alias("ranges"),
            )

        return let(before, push)

    def closed(acc, x):
        back = F.array_position(F.reverse(acc["stack"]), x["name"]).cast("int")
        return let(back, lambda k: F.when(k == 0, acc).otherwise(cut(acc, F.size(acc["stack"]) - k, x["i"] + 1)))

    empty = F.struct(
        F.array().cast("array<string>").alias("stack"), F.lit(0).alias("skip"), F.lit(0).alias("start"),
        F.array().cast("array<struct<a:int,b:int>>").alias("ranges"),
    ).cast(_FOLD)
    # what is open at the end ends there
    finish = lambda acc: F.when(acc["skip"] > 0, cut(acc, F.lit(0), n)["ranges"]).otherwise(acc["ranges"])
    fold = lambda m: F.aggregate(m, empty, lambda acc, x: F.when(x["end"], closed(acc, x)).otherwise(opened(acc, x)).cast(_FOLD), finish)
    none = F.array().cast("array<struct<a:int,b:int>>")
    return let(marked, lambda m: F.when(F.exists(m, lambda x: x["bad"] & ~x["end"]), fold(m)).otherwise(none))


def content_tokens(html: Column | str) -> Column:
    """The tokens of a page outside blocks that are no content."""

    def kept(tokens):
        def between(ranges):
            start = lambda k: F.when(k == 0, 0).otherwise(F.get(ranges, k - 1)["b"])
            stop = lambda k: F.when(k == F.size(ranges), F.size(tokens)).otherwise(F.get(ranges, k)["a"])
            gaps = F.transform(
                F.sequence(F.lit(0), F.size(ranges)), lambda k: F.slice(tokens, start(k) + 1, F.greatest(stop(k) - start(k), F.lit(0)))
            )
            return F.flatten(gaps)

        return let(_excluded_ranges(tokens), between)

    return F.when(_c(html).isNotNull(), let(page_tokens(html), kept))


def _piece(x: Column) -> Column:
    """What a content token becomes: markdown marks, texts and anchors stay."""
    name, t = x["name"], x["t"]
    end = t.startswith("</")
    heading = name.isin(*[f"h{n}" for n in range(1, 7)])
    level = F.substring(name, 2, 1).cast("int")
    href = F.regexp_replace(F.regexp_extract(t, P.TAG_HREF, 1), P.HREF_QUOTES, "")
    return (
        F.when(name == "", F.when(t.startswith("<") & (t != "<"), "").otherwise(t))
        .when(name == "p", "\n\n")
        .when(heading, F.when(end, "\n\n").otherwise(F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), level), F.lit(" "))))
        .when(name == "br", "\n")
        .when(name == "li", F.when(end, "\n").otherwise("\n- "))
        .when((name == "a") & end, P.LINK_END)
        .when(name == "a", let(href, lambda h: F.when(h != "", F.concat(F.lit(P.LINK_OPEN), h, F.lit(P.LINK_TEXT))).otherwise("")))
        .when(end & name.isin(*P.BREAK_TAGS), "\n")
        .otherwise("")
    )


def _linked(x: Column) -> Column:
    """Marks of anchors with a target and an end become links, others go."""
    return F.regexp_replace(F.regexp_replace(x, P.LINK, "[$2]($1)"), P.LINK_MARKS, "")


def token_markdown(tokens: Column | str) -> Column:
    """E2/E3 body of content tokens: main content as light markdown.

    headings -> ``#``..``######``, paragraphs -> blank lines, ``<br>`` ->
    newline, list items -> ``- ``, links -> ``[text](href)``; other tags
    dropped; entities decoded; spaces collapsed per line; at most one blank
    line in a row.
    """
    s = F.array_join(F.transform(_c(tokens), _piece), "")
    s = let(s, lambda x: F.when(x.rlike(P.LINK_MARKS), _linked(x)).otherwise(x))
    s = let(s, lambda x: F.when(F.contains(x, F.lit("&")), decode_entities(x)).otherwise(x))
    s = F.regexp_replace(s, P.INLINE_SPACE, " ")
    s = F.regexp_replace(s, P.SPACE_AROUND_NL, "\n")
    s = F.regexp_replace(s, P.MANY_NL, "\n\n")
    return py_strip(s)


def markdown_lite(html: Column | str) -> Column:
    """E3 body of a page."""
    return token_markdown(content_tokens(html))


def count_links(tokens: Column | str) -> Column:
    """Links of content tokens: anchors with a target and an end."""
    anchors = F.filter(_c(tokens), lambda x: x["name"] == "a")
    return F.regexp_count(F.array_join(F.transform(anchors, _piece), ""), F.lit(P.LINK))


def count_headings(tokens: Column | str) -> Column:
    return F.size(F.filter(_c(tokens), lambda x: x["name"].isin(*[f"h{n}" for n in range(1, 7)]) & ~x["t"].startswith("</")))


def plain_text(markdown: Column | str) -> Column:
    """Whitespace-collapsed text of a markdown-lite body (search and keywords)."""
    return strip_text(collapse_space(markdown))


def lead_pattern(n: int) -> str:
    """First ``n`` sentences ending in . ! or ?; the whole text if none ends."""
    return r"(?s)\A((?:[^.!?]*[.!?]+[ \n]+){0," + str(n - 1) + r"}[^.!?]*[.!?]+|.*)"


def lead_sentences(text: Column | str, n: int) -> Column:
    """Lead of a text ('' for blank input)."""
    return py_strip(F.regexp_extract(_c(text), lead_pattern(n), 1))


def hrefs(html: Column | str) -> Column:
    """Every ``<a href>`` value in document order (array): quoted or bare,
    entities decoded."""
    found = F.regexp_extract_all(_c(html), F.lit(P.HREF), F.lit(1))
    return F.transform(found, lambda x: decode_entities(F.regexp_replace(x, P.HREF_QUOTES, "")))


def remove_dot_segments(url: Column | str) -> Column:
    """``.`` and ``..`` segments of an absolute URL's path resolved."""
    u = _c(url)
    parts = r"(?s)\A([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)([^?#]*)(.*)\z"
    path = F.regexp_extract(u, parts, 2)

    def step(acc, s):
        return (
            F.when(s == ".", acc)
            .when((s == "..") & (F.size(acc) > 1), F.slice(acc, F.lit(1), F.size(acc) - 1))
            .when(s == "..", acc)
            .otherwise(F.concat(acc, F.array(s)))
        )

    # a path that ends in a dot segment ends in a slash
    closed = F.when(path.rlike(r"/\.\.?\z"), F.concat(path, F.lit("/"))).otherwise(path)
    walked = F.aggregate(F.split(closed, "/"), F.array().cast("array<string>"), step)
    fixed = F.concat(F.regexp_extract(u, parts, 1), F.array_join(walked, "/"), F.regexp_extract(u, parts, 3))
    return F.when(u.rlike(r"(?s)\A[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)?/\.\.?(/|\z|\?|#)"), fixed).otherwise(u)


def base_parts(base: Column | str) -> list[Column]:
    """Per-page pieces used to resolve relative links (compute before explode)."""
    b = _c(base)
    scheme = F.regexp_extract(b, r"\A([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.regexp_extract(b, r"\A([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    no_frag = F.regexp_replace(b, r"#.*\z", "")
    no_query = F.regexp_replace(F.regexp_replace(b, r"#.*\z", ""), r"\?.*\z", "")
    bd = F.regexp_replace(
        F.regexp_extract(no_query, r"\A([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/.*)?)", 1), r"[^/]*\z", ""
    )
    return [
        scheme.alias("_b_scheme"), origin.alias("_b_origin"), no_frag.alias("_b_nofrag"),
        no_query.alias("_b_noquery"), bd.alias("_b_dir"),
    ]


def resolve_href_parts(h: Column | str) -> Column:
    """Resolve a stripped link against the ``base_parts`` columns."""
    h = _c(h)
    base_dir = F.when(F.col("_b_dir").endswith("/"), F.col("_b_dir")).otherwise(
        F.concat(F.col("_b_origin"), F.lit("/"))
    )
    return (
        F.when(h.rlike(r"\A[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(F.col("_b_scheme"), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(F.col("_b_origin"), h))
        .when(h.startswith("#"), F.concat(F.col("_b_nofrag"), h))
        .when(h.startswith("?"), F.concat(F.col("_b_noquery"), h))
        .when(h == "", F.col("_b_nofrag"))
        .otherwise(F.concat(base_dir, h))
    )
