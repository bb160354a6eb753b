"""Operator 13: filter interaction audit by min-plus removal ranks.

Which filter removes a document depends on the order of the filters. For all
orders at once: a mask matrix M (documents by filters) holds 0 where a document
fails a filter and infinity elsewhere, and a matrix P (filters by orders), the
inverse permutations, holds the step at which an order applies a filter. Their
min-plus product, the minimum over the filters of M + P, is the step at which
each order removes each document. Scattering documents by that step, weighted
by 1, by good and by toxic labels, counts what every step removes; documents
that fail a step's filter and were removed before are its redundancy.

Only the masks matter, so Spark counts documents per (part, mask, labels) and
the product runs on these counts: ``2**filters`` rows a part at most.

* ``failures`` finds the masks. Conditions on a text alone are one projection;
  the filter on copies needs the whole table: documents are counted per (text
  digest, document), then per digest with the smallest doc_id, before any join,
  so a text that a third of the documents share is a few rows.
* ``interactions`` multiplies, for any filters.

Texts are equal when their SHA-256 digests are.

Defined cases: null text counts as empty and null lang as the empty string; an
empty text fails the first filter (no word), not those on ratios. A null doc_id
is larger than any other and has no label. Rows that repeat doc_id and text
count each, and are no copies of each other. Of several label rows of one
document, one that says 1 is enough; null labels say nothing. Texts of any
length are read whole. An empty table gives no rows; extra columns do not
matter.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.llm.common import documents, let, materialize, python_ready, text_or_empty

FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
SYMBOLS = r"[#$%&*|]"

MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES)


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions on a text alone, by filter."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    counts = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    few = lambda c: DISTINCT_PERCENT * c["n"].cast("long") > 100 * c["d"].cast("long")
    return {
        "A_B": let(counts, lambda c: F.struct((c["n"] < MIN_WORDS).alias("A"), few(c).alias("B"))),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > CAPITAL_PERCENT * F.char_length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents per part and set of failed
    filters; bit i of ``mask`` is filter i of ``FILTERS``."""
    src = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text_or_empty().alias("_t"))
    found = src.select("doc_id", "part", F.unhex(F.sha2("_t", 256)).alias("digest"), *[c.alias(k) for k, c in text_conditions(F.col("_t")).items()])
    bit = lambda c, i: F.when(c, F.lit(1 << i)).otherwise(F.lit(0))
    mask = bit(F.col("A_B.A"), 0) + bit(F.col("A_B.B"), 1) + bit(F.col("C"), 2) + bit(F.col("D"), 3)
    rows = found.select("doc_id", "part", "digest", mask.alias("mask")).groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marked = labels.filter("doc_id is not null").groupBy("doc_id").agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    no = F.lit(False)
    rows = materialize(rows, "audit-rows").join(materialize(marked, "audit-labels"), "doc_id", "left")
    rows = rows.withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})
    # of each text: what its smallest document holds, and what all hold
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))
    texts = rows.withColumn("key", key).groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("key").alias("first"), F.min_by("n", "key").alias("n_first")
    )
    texts = materialize(texts, "audit-texts")
    lowest = texts.groupBy("digest").agg(F.min("first").alias("lowest"))
    texts = texts.join(materialize(lowest, "audit-lowest"), "digest")
    own = F.when(F.col("first") == F.col("lowest"), F.col("n_first")).otherwise(F.lit(0).cast("long"))
    copy_bit = 1 << FILTERS.index("E")
    both = F.array(
        F.struct(F.col("mask").alias("mask"), own.alias("n")),
        F.struct((F.col("mask") + copy_bit).alias("mask"), (F.col("n") - own).alias("n")),
    )
    split = texts.select("part", "good", "toxic", F.explode(both).alias("s")).select("part", "good", "toxic", "s.mask", "s.n")
    weight = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(F.lit(0).cast("long")))
    return split.filter("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), weight("good").alias("n_good"), weight("toxic").alias("n_toxic")
    )


def orders(filters: int) -> np.ndarray:
    """All orders of the filters, one a row, in lexicographic order."""
    return np.array(list(permutations(range(filters))))


def removal_steps(masks: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The step (from 1) at which each order removes each mask; one more than
    there are filters where none does. Masks by orders."""
    k = order.shape[1]
    inverse = np.argsort(order, axis=1).T + 1  # filters by orders
    far = k + 1  # as good as infinity: no step comes after it
    mask = np.where((masks[:, None] >> np.arange(k)) & 1, 0, far)  # masks by filters
    out = np.full((len(masks), len(order)), far)
    for f in range(k):
        np.minimum(out, mask[:, f, None] + inverse[f][None, :], out=out)
    return out


def audit_counts(masks: np.ndarray, weights: np.ndarray, filters: int) -> dict[str, np.ndarray]:
    """Measures (orders by steps) of one part; ``weights`` has a column each
    for documents, good ones and toxic ones."""
    order = orders(filters)
    n_orders, k = order.shape
    step = removal_steps(masks, order)
    removed = np.zeros((n_orders, k + 2, 3), np.int64)
    np.add.at(removed, (np.arange(n_orders)[None, :], step), weights[:, None, :])
    removed = removed[:, 1:k + 1]
    fails = np.array([weights[(masks >> f) & 1 == 1, 0].sum() for f in range(k)], np.int64)
    alone = np.array([weights[masks == 1 << f, 0].sum() for f in range(k)], np.int64)
    share = np.zeros(k, np.int64)
    np.add.at(share, order, removed[:, :, 0])
    return {
        "kept": weights[:, 0].sum() - np.cumsum(removed[:, :, 0], axis=1),
        "removed": removed[:, :, 0],
        "redundant": fails[order] - removed[:, :, 0],
        "unique_fails": alone[order],
        "good_lost": removed[:, :, 1],
        "toxic_lost": removed[:, :, 2],
        "shapley": share[order],
    }


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of ``filters`` (a letter each) and step, from
    ``failures``' counts."""
    python_ready(counts.sparkSession)
    k = len(filters)
    names = ["".join(filters[f] for f in o) for o in orders(k)]

    def part_rows(table: pa.Table) -> pa.Table:
        masks = table.column("mask").to_numpy().astype(np.int64)
        weights = np.stack([table.column(c).to_numpy() for c in ("n", "n_good", "n_toxic")], axis=1)
        found = audit_counts(masks, weights, k)
        rows = len(names) * k
        cols = {
            "part": pa.array([table.column("part")[0].as_py()] * rows, pa.string()),
            "filter_order": pa.array(np.repeat(names, k).tolist(), pa.string()),
            "step": pa.array(np.tile(np.arange(1, k + 1), len(names)), pa.int32()),
        }
        return pa.table({**cols, **{m: pa.array(found[m].ravel(), pa.int64()) for m in MEASURES}})

    return counts.groupBy("part").applyInArrow(part_rows, AUDIT)


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return interactions(failures(documents(spark, sf_dir), labels))


#: The same counts in DuckDB: masks by window, removal step by least().
OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         CASE WHEN w.doc_id IS NULL THEN min(w.doc_id) OVER (PARTITION BY t) IS NOT NULL
              ELSE w.doc_id > min(w.doc_id) OVER (PARTITION BY t) END AS e,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), g AS (
  SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), x(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), o AS (
  SELECT x1.x || x2.x || x3.x || x4.x || x5.x AS filter_order FROM x x1, x x2, x x3, x x4, x x5
  WHERE x1.x NOT IN (x2.x, x3.x, x4.x, x5.x) AND x2.x NOT IN (x3.x, x4.x, x5.x) AND x3.x NOT IN (x4.x, x5.x) AND x4.x <> x5.x
), r AS (
  SELECT part, filter_order, a, b, c, d, e, n, good, toxic,
         least(CASE WHEN a THEN strpos(filter_order, 'A') ELSE 6 END, CASE WHEN b THEN strpos(filter_order, 'B') ELSE 6 END,
               CASE WHEN c THEN strpos(filter_order, 'C') ELSE 6 END, CASE WHEN d THEN strpos(filter_order, 'D') ELSE 6 END,
               CASE WHEN e THEN strpos(filter_order, 'E') ELSE 6 END) AS gone
  FROM g, o
), s AS (
  SELECT r.*, step, substr(filter_order, step, 1) AS filter,
         CASE substr(filter_order, step, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END AS fails,
         a::int + b::int + c::int + d::int + e::int AS n_fails
  FROM r, (VALUES (1), (2), (3), (4), (5)) AS steps(step)
), m AS (
  SELECT part, filter_order, step, any_value(filter) AS filter,
         sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN fails AND gone < step THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM s GROUP BY part, filter_order, step
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM m
"""
