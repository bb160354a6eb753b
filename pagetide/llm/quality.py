"""Operator 7: quality rules as weak supervision (native).

Each rule votes good (+1), bad (-1) or abstains (0) on features of the whole
text. EM over the counts of vote patterns estimates how far each rule is to
be trusted, and a document is kept when the posterior probability of good
quality is at least ``THRESHOLD``; no single rule decides.

Words are runs without ASCII white space. Defined cases: null text counts as
empty; empty text and text without words have zero in every feature and fail
the base rule (fewer than 50 words); repeated rows get the same answer each;
null doc_id is carried through; texts of any length are read whole; an empty
table gives no rows (and EM keeps its start values); extra columns do not matter,
and columns of the input that carry a result's name are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.llm import weak
from pagetide.llm.common import documents, let, materialize, text_or_empty

THRESHOLD = 0.5
MIN_WORDS = 50
SYMBOLS = r"[#*$%&|<>]"
RULES = ["v_length", "v_symbols", "v_repeats", "v_lines", "v_word_length", "v_shouting", "v_sentences"]
#: The most that each rule may fire on good documents (order of RULES).
FALSE_ALARM = (0.05, 0.001, 0.001, 0.2, 0.02, 0.001, 0.01)
#: Start and prior of EM: good documents hardly ever draw a bad vote, bad ones
#: draw one from some of the rules.
P_GOOD, P_BAD, PRIOR_GOOD = (0.002, 0.198, 0.80), (0.30, 0.25, 0.45), 0.85


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the array."""

    def covered(w):
        n = F.size(w)

        def windows(h):
            return F.slice(
                F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))), 1, n - 2
            )

        def starts(s):
            twin = F.filter(
                s,
                lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]),
            )
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        def total(p):
            # a start adds its words up to the next start, three at most
            return F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
                F.lit(0).cast("long"),
                lambda acc, x: acc + x,
            )

        def repeated(t):
            pairs = F.transform(t, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
            return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0).cast("long")).otherwise(
                let(let(F.sort_array(pairs), starts), total)
            )

        hashed = F.transform(w, lambda x: F.xxhash64(x))
        return F.when(n >= 3, let(let(hashed, windows), repeated)).otherwise(F.lit(0).cast("long"))

    return let(words, covered)


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with the features of its texts; one pass, no shuffle."""
    text = text_or_empty()
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    df = docs.withColumn("_t", text).withColumn(
        "_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    )
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.regexp_count("_t", F.lit(SYMBOLS)).cast("long"),
        "_lines": lines,
        "n_repeat_words": repeat_words(F.col("_w")).cast("long"),
        "_upper": F.regexp_count("_t", F.lit(r"[\p{Lu}]")).cast("long"),
        "_ends": F.regexp_count("_t", F.lit(r"[.!?](?![!?.])")).cast("long"),
    }).withColumns({
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
    }).drop("_t", "_w", "_lines")


def votes(df: DataFrame) -> DataFrame:
    n, chars = F.col("n_words"), F.col("word_chars")

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return df.withColumns({
        "v_length": vote(n < MIN_WORDS, n >= 80),
        "v_symbols": vote(10 * F.col("n_symbols") > 2 * n, 50 * F.col("n_symbols") <= n),
        "v_repeats": vote(10 * F.col("n_repeat_words") > 4 * n, 10 * F.col("n_repeat_words") <= 3 * n),
        "v_lines": vote(10 * F.col("n_dup_lines") > 6 * F.col("n_lines"), (F.col("n_dup_lines") == 0) & (F.col("n_lines") > 1)),
        "v_word_length": vote((chars < 2 * n) | (chars > 12 * n), (chars >= 3 * n) & (chars <= 9 * n)),
        "v_shouting": vote(5 * F.col("_upper") > chars, 10 * F.col("_upper") <= chars),
        "v_sentences": vote((n > 0) & (F.col("_ends") == 0), 40 * F.col("_ends") >= n),
    })


def assess(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` plus features, votes, ``quality`` (posterior
    probability), ``base_failed`` and ``kept``.

    The voted rows are written once to the shared folder: EM reads their vote
    counts, the result reads the same files.
    """
    new = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", "quality", "kept", *RULES}
    cols = [F.col(f"`{c}`") for c in keep if c not in new]
    src = docs.select(*cols, *([] if "text" in keep else ["text"]))
    voted = votes(features(src))
    if "text" not in keep:
        voted = voted.drop("text")
    voted = materialize(voted, "quality-votes")
    model = weak.fit(voted, RULES, PRIOR_GOOD, P_GOOD, P_BAD, false_alarm=FALSE_ALARM)
    n = F.col("n_words")
    return (
        voted.withColumn("quality", model.posterior())
        .withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * n))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= THRESHOLD))
        .drop("_upper", "_ends")
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with the same columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
    return assess(packed, ["_row", "text"]).filter("kept").select("_row.*")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return assess(documents(spark, sf_dir).select("doc_id", "text"), ["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.round("quality", 6).alias("quality"),
    )
