"""Text cleanup (X1-X6) as Spark Column expressions.

Array work uses higher-order functions (``filter``, ``aggregate``) so it
stays inside the JVM; per-row text is page-sized, never corpus-sized.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetide.functions import patterns as P
from pagetide.functions.urls import _c, _let, py_strip

# ---- fixed values that must equal the reference (page rendering) ----------
WRAP_INDENT = 2
WRAP_WIDTH = 80
ARTIFACT_MIN_LEN = 100     # a line longer than this ...
ARTIFACT_MAX_SEP = 10      # ... with more than this many '-' or '_' ...
CONDENSE_MAX_CHARS = 250
CONDENSE_MAX_SENTENCES = 3
PAGE_STRUCTURE_PHRASES = (
    "this page", "the page", "additional resources", "includes links",
    "provides links", "contains links", "links to", "page also",
)
# ---------------------------------------------------------------------------


def decode_entities(c: Column | str) -> Column:
    """Named-entity decoding as one fold over the (entity, char) table.

    A single higher-order expression instead of 17 nested ``replace`` calls
    keeps the generated code of wide projections under the JVM method limit.
    """
    table = sql_array([f"named_struct('e', {sql_lit(e)}, 'c', {sql_lit(ch)})" for e, ch in P.ENTITIES])
    return F.aggregate(table, _c(c), lambda acc, x: F.replace(acc, x["e"], x["c"]))


def sql_lit(s: str) -> str:
    """A Spark SQL string literal (quotes and backslashes escaped)."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_array(items: list[str]) -> Column:
    """A literal array built by one SQL expression (one JVM call, not one per item)."""
    return F.expr("array(" + ", ".join(items) + ")")


def strip_html(c: Column | str) -> Column:
    """<br> -> space, other tags dropped, whitespace collapsed, trimmed."""
    s = F.regexp_replace(_c(c), P.BR_TAG, " ")
    s = F.regexp_replace(s, P.ANY_TAG, "")
    return py_strip(collapse_space(s))


def collapse_space(c: Column | str) -> Column:
    """Every run of whitespace as one space."""
    wide = sql_array([sql_lit(ch) for ch in P.WS_WIDE])
    rare = lambda x: (F.octet_length(x) > F.length(x)) & F.exists(wide, lambda w: F.contains(x, w))
    run = lambda x: F.when(rare(x), F.regexp_replace(x, P.WS_RUN, " ")).otherwise(F.regexp_replace(x, P.WS_LATIN_RUN, " "))
    return _let(_c(c), run)


def strip_text(c: Column | str) -> Column:
    """``py_strip`` of a long text: trimming looks at every character, so a text
    that neither begins nor ends with white space is left alone."""
    space = sql_array([sql_lit(ch) for ch in P.WS_LATIN + P.WS_WIDE])
    return _let(_c(c), lambda x: F.when(F.exists(space, lambda w: x.startswith(w) | x.endswith(w)), py_strip(x)).otherwise(x))


def br_to_newline(c: Column | str) -> Column:
    """X2."""
    return F.regexp_replace(_c(c), P.BR_TAG, "\n")


def _count_char(s: Column, ch: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))


def is_artifact_line(line: Column) -> Column:
    """X3 predicate: long, space-free, dash/underscore-heavy, has a capital."""
    s = py_strip(line)
    return (
        (F.length(line) > ARTIFACT_MIN_LEN)  # first, as few lines are that long
        & (F.length(s) > ARTIFACT_MIN_LEN)
        & ~s.contains(" ")
        & ((_count_char(s, "-") > ARTIFACT_MAX_SEP) | (_count_char(s, "_") > ARTIFACT_MAX_SEP))
        & s.rlike(r"\p{IsUppercase}")
    )


def clean_body(c: Column | str) -> Column:
    """Drop artifact lines, then strip the whole text."""
    lines = F.split(_c(c), "\n", -1)
    kept = F.filter(lines, lambda l: ~is_artifact_line(l))
    return strip_text(F.array_join(kept, "\n"))


def artifact_line_count(c: Column | str) -> Column:
    """Number of lines X3 removes (for per-site reports)."""
    lines = F.split(_c(c), "\n", -1)
    return F.size(F.filter(lines, is_artifact_line)).cast("bigint")


def yaml_escape(c: Column | str) -> Column:
    """Backslash, double quote, newline — in that order."""
    s = F.replace(_c(c), F.lit("\\"), F.lit("\\\\"))
    s = F.replace(s, F.lit('"'), F.lit('\\"'))
    return F.replace(s, F.lit("\n"), F.lit(" "))


def words(c: Column | str) -> Column:
    """Python ``str.split()``: whitespace-separated, no empty words."""
    return F.filter(F.split(py_strip(_c(c)), P.WS_RUN, -1), lambda w: w != "")


def wrap_summary(c: Column | str, indent: int = WRAP_INDENT, width: int = WRAP_WIDTH) -> Column:
    """Greedy wrap; a line is flushed when ``len(line)+len(word)+1 > width``.

    ``line`` carries its trailing space, so visible lines are <= width-1
    chars, and a first word that does not fit leaves an empty first line.
    """
    prefix = " " * indent
    init = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(prefix).alias("line"))

    def step(acc: Column, w: Column) -> Column:
        flush = F.length(acc["line"]) + F.length(w) + 1 > width
        return F.when(
            flush,
            F.struct(
                F.array_append(acc["lines"], F.rtrim(acc["line"])).alias("lines"),
                F.concat(F.lit(prefix), w, F.lit(" ")).alias("line"),
            ),
        ).otherwise(
            F.struct(acc["lines"].alias("lines"), F.concat(acc["line"], w, F.lit(" ")).alias("line"))
        )

    def finish(acc: Column) -> Column:
        lines = F.when(F.trim(acc["line"]) != "", F.array_append(acc["lines"], F.rtrim(acc["line"]))).otherwise(
            acc["lines"]
        )
        return F.array_join(lines, "\n")

    return F.aggregate(words(c), init, step, finish)


def condense_summary(c: Column | str) -> Column:
    """Business-focused lead of a summary, <= 250 chars, <= 3 sentences.

    Sentences are split on ". "; sentences about page structure are dropped
    unless that drops all; one trailing period per sentence is removed before
    one is added back (so no ".."). Accumulation stops at the first sentence
    that would overflow. NULL when nothing fits.
    """
    s = py_strip(_c(c))
    sentences = F.filter(
        F.transform(F.split(s, r"\. ", -1), lambda x: py_strip(x)), lambda x: x != ""
    )
    phrases = sql_array([sql_lit(p) for p in PAGE_STRUCTURE_PHRASES])
    phrase_hit = lambda x: F.exists(phrases, lambda p: F.lower(x).contains(p))
    business = F.filter(sentences, lambda x: ~phrase_hit(x))
    chosen = F.slice(F.when(F.size(business) > 0, business).otherwise(sentences), 1, CONDENSE_MAX_SENTENCES)
    init = F.struct(
        F.array().cast("array<string>").alias("parts"),
        F.lit(0).alias("len"),
        F.lit(False).alias("stop"),
    )

    def step(acc: Column, x: Column) -> Column:
        sent = F.concat(F.regexp_replace(x, r"\.\z", ""), F.lit("."))
        new_len = acc["len"] + F.length(sent) + F.when(F.size(acc["parts"]) > 0, 1).otherwise(0)
        fits = ~acc["stop"] & (new_len <= CONDENSE_MAX_CHARS)
        return F.when(
            fits,
            F.struct(F.array_append(acc["parts"], sent).alias("parts"), new_len.alias("len"), F.lit(False).alias("stop")),
        ).otherwise(F.struct(acc["parts"].alias("parts"), acc["len"].alias("len"), F.lit(True).alias("stop")))

    out = F.aggregate(chosen, init, step, lambda acc: F.array_join(acc["parts"], " "))
    return F.when(out != "", out)


def nullif_blank(c: Column | str) -> Column:
    """Falsy-as-missing (T15): NULL and '' both become NULL."""
    x = _c(c)
    return F.when(x != "", x)
