"""Operator 2: licence scan by ordered signature rules (native).

Several hundred regexes (``license_rules``) are gated twice. A text goes on only
if one of a few literals occurs in it. There every literal that some rule needs
is looked up once, and a rule runs only if all its literals occur; ways to write
a name that share no literal are rules of their own. Detections are spans with a
priority; a span inside another one is suppressed when the other has a higher
priority, or the same priority and a longer span, or the same span and an
earlier rule.

Words for positions are runs of ASCII letters and digits and all non-ASCII
characters, after lower-casing A-Z. Defined cases: null text counts as empty;
texts without a mention have zero places, null positions, empty labels and
score 0; repeated rows get the same answer each, and a null doc_id is carried;
spans that tie in all but the rule go to the rule that stands first; texts of any
length are read whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.llm.common import documents, let, regex_spans, text_or_empty
from pagetide.llm.license_rules import GATE_LITERALS, LEAD_MARK, LEAD_UNDER, rules

# a word character before lower-casing (ASCII letters and digits, and all
# beyond ASCII), and its complement
_IN = r"[\P{ASCII}\p{Alnum}]"
_OUT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

# fixed values: base phrases and their labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def _phrase(words: str) -> str:
    return (_OUT + "+").join(words.split())


BASE = rf"(?i)(?<!{_IN})(?:{'|'.join(map(_phrase, PHRASES))})(?!{_IN})"

SPANS = "array<struct<start:bigint,stop:bigint,label:string,priority:int,rule:int>>"


def literals() -> list[str]:
    """All literals that some rule needs."""
    return sorted({k for r in rules() for k in r.keywords})


def rule_table() -> Column:
    """The rules, with the numbers of their literals."""
    number = {k: i for i, k in enumerate(literals())}
    rows = [
        {"label": r.label, "priority": r.priority, "needs": [number[k] for k in r.keywords], "pattern": r.pattern, "rule": i}
        for i, r in enumerate(rules())
    ]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<label:string,priority:int,needs:array<int>,pattern:string,rule:int>>")


def _spans(text: Column, r: Column) -> Column:
    """Spans (code points, end exclusive) of one rule's matches in ``text``."""
    return regex_spans(
        text, r["pattern"],
        lambda start, stop, hit, before, after: (
            start.alias("start"), stop.alias("stop"), r["label"].alias("label"), r["priority"].alias("priority"), r["rule"].alias("rule"),
        ),
        SPANS,
    )


def mentions(text: Column) -> Column:
    """Whether some rule, or a base phrase, can match ``text`` at all."""

    def held(low):
        some = lambda words: functools.reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words])
        # the base phrases hold 'cc', 'general' or 'reserved', of which the last passes anyway
        base = some(["general", "cc"]) & text.rlike(BASE)
        return some(GATE_LITERALS) | (F.contains(low, F.lit("under")) & text.rlike("(?i)" + LEAD_UNDER)) | base

    return let(F.lower(text), held)


def keyword_text(text: Column) -> Column:
    """Where literals are looked up: lower case, white space and hyphens as one blank."""
    lead = F.when(text.rlike("(?i)" + LEAD_UNDER), F.lit(LEAD_MARK)).otherwise(F.lit(""))
    return F.concat(F.regexp_replace(F.lower(text), r"[\s-]+", " "), lead)


def detections(text: Column, lower: Column) -> Column:
    """All spans of all rules whose literals occur, suppressed ones removed."""
    words = F.from_json(F.lit(json.dumps(literals())), "array<string>")
    hits = let(lower, lambda low: F.filter(F.transform(words, lambda w, i: F.when(F.contains(low, w), i)), lambda i: i.isNotNull()))
    runnable = let(hits, lambda h: F.filter(rule_table(), lambda r: F.forall(r["needs"], lambda k: F.array_contains(h, k))))
    every = F.flatten(F.transform(runnable, lambda r: _spans(text, r)))

    def beaten(a: Column, b: Column) -> Column:
        longer = (b["stop"] - b["start"]) > (a["stop"] - a["start"])
        wins = (b["priority"] > a["priority"]) | (
            (b["priority"] == a["priority"]) & (longer | (~longer & (b["rule"] < a["rule"])))
        )
        return (b["start"] <= a["start"]) & (b["stop"] >= a["stop"]) & wins

    # Sorted by start, a container never starts later; the widest stop seen so
    # far does not decide priority, so the spans of a text are compared. Their
    # number is the number of mentions in one text.
    return let(F.array_sort(every), lambda s: F.filter(s, lambda a: ~F.exists(s, lambda b: beaten(a, b))))


def n_words(text: Column) -> Column:
    """Words of a text: the parts between separators that are not empty."""
    parts = F.split(text, _OUT + "+")
    outside = lambda p: (F.element_at(p, 1) == "").cast("int") + ((F.size(p) > 1) & (F.element_at(p, -1) == "")).cast("int")
    return let(parts, lambda p: F.size(p) - outside(p)).cast("long")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, base columns, ``detections`` (spans), labels and score."""
    df = docs.select("doc_id", text_or_empty().alias("_t")).withColumn("_gate", mentions(F.col("_t")))
    word = F.lit(_IN + "+")
    empty = F.array().cast("array<string>")
    df = df.withColumns({
        "n_words": n_words(F.col("_t")),
        "_hits": F.when(F.col("_gate"), F.regexp_extract_all("_t", F.lit(BASE), F.lit(0))).otherwise(empty),
        "detections": F.when(F.col("_gate"), detections(F.col("_t"), keyword_text(F.col("_t")))).otherwise(F.array().cast(SPANS)),
    })
    parts = F.split("_t", BASE, -1)
    base_label = lambda h: F.when(F.lower(h).startswith("cc"), "cc-by").when(F.lower(h).startswith("gen"), "gpl").otherwise("reserved")
    found = F.size("_hits") > 0
    df = df.withColumns({
        "n_base": F.size("_hits").cast("long"),
        "first_word": F.when(found, let(parts, lambda p: F.regexp_count(F.get(p, F.lit(0)), word)).cast("long")),
        "last_word": F.when(
            found,
            F.col("n_words")
            - let(parts, lambda p: F.regexp_count(F.element_at(p, -1), word))
            - F.regexp_count(F.element_at("_hits", -1), word),
        ).cast("long"),
        "_base": F.array_sort(F.array_distinct(F.transform("_hits", base_label))),
    })
    top = F.array_max(F.transform("detections", lambda d: d["priority"])) / F.lit(100.0)
    return df.withColumns({
        "base_labels": F.array_join("_base", ","),
        "labels": F.array_join(
            F.array_sort(F.array_distinct(F.concat("_base", F.transform("detections", lambda d: d["label"])))), ","
        ),
        "score": F.greatest(F.coalesce(top, F.lit(0.0)), F.when(found, 0.5).otherwise(0.0)).cast("double"),
    }).drop("_t", "_gate", "_hits", "_base")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )
