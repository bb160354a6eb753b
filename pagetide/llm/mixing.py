"""Operator 4: mixing sources to target weights by systematic sampling (native).

Sources, in code-point order with null last, weigh 3, 1, 2, repeating. They
share ``SHARE`` times all words by weight; a source stops at ``CAP`` times its
own size, and what it leaves is shared again by weight (solved in closed form).
Each document of a source has the expected copies target / size of the source.
Inside a source, documents are laid out by size, the expected copies are summed
along this line, one offset per source (from a seed) is added, and a document
is emitted once for each integer that its stretch crosses. Laying out by size
makes the words taken follow the target closely, not only the copies.

The line's positions come from counts: per (source, size class, salt) and then
per (source, size class), so only a (source, size class, salt) group is ever
ordered by rows, and a source or size that holds most rows is still spread over
``SALTS`` groups.

Words are runs without ASCII white space. Defined cases: null and empty texts
have size 0 and take no words; a source without words has target 0; a null
source is a source of its own; rows that repeat are documents of their own;
documents of one size lie in the order of a hash; a text of any length counts
with all its words; an empty table gives no rows; extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetide.llm.common import WORD, documents, materialize, text_or_empty

WEIGHTS = (3, 1, 2)
SHARE_NUM, SHARE_DEN = 3, 2  # 150 %
CAP = 2
SALTS = 256  # two hexadecimal digits of a digest
SEED = "mix-1"


def sized(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns plus size, and the keys of the sampling line."""
    size = F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")
    key = F.col("doc_id").cast("string")
    return docs.withColumn("size", size).select(
        *[F.col(f"`{c}`") for c in keep],
        F.col("size"),
        F.col("source").isNull().alias("_null"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"),
        F.floor(F.sqrt(F.col("size").cast("double"))).cast("long").alias("_class"),
        F.left(F.md5(F.coalesce(key, F.lit("")).cast("binary")), F.lit(2)).alias("_salt"),
        F.col("doc_id").alias("_id"),
    )


def targets(docs: DataFrame) -> DataFrame:
    """Per source: its size, its target in words, copies expected of each of
    its documents and the offset. One row per source goes through one task."""
    by_source = docs.groupBy("_null", "_source").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy("_null", "_source")
    weights = F.array(*[F.lit(w).cast("long") for w in WEIGHTS])
    nth = F.row_number().over(rank) - 1
    weighed = by_source.withColumn("w", F.get(weights, nth % len(WEIGHTS)))
    everything = Window.partitionBy()
    # a source is capped if, with all sources of smaller cap / weight capped,
    # its share of the rest still lies above its cap
    ratio = F.col("source_size").cast("double") / F.col("w")
    below = Window.orderBy("ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tied = Window.partitionBy("ratio")
    s = weighed.withColumn("ratio", ratio)
    s = s.withColumns({
        "total": F.sum("source_size").over(everything),
        "w_all": F.sum("w").over(everything),
        "size_below": F.sum("source_size").over(below) - F.sum("source_size").over(tied),
        "w_below": F.sum("w").over(below) - F.sum("w").over(tied),
    })
    left = SHARE_NUM * F.col("total") - SHARE_DEN * CAP * F.col("size_below")
    s = s.withColumn("capped", left * F.col("w") > SHARE_DEN * CAP * F.col("source_size") * (F.col("w_all") - F.col("w_below")))
    gone = lambda c: F.sum(F.when(F.col("capped"), F.col(c)).otherwise(0)).over(everything)
    s = s.withColumns({"size_capped": gone("source_size"), "w_capped": gone("w")})
    share = (
        ((SHARE_NUM * F.col("total") - SHARE_DEN * CAP * F.col("size_capped")) * F.col("w")).cast("double")
        / (SHARE_DEN * (F.col("w_all") - F.col("w_capped"))).cast("double")
    )
    s = s.withColumn("target", F.when(F.col("capped"), (CAP * F.col("source_size")).cast("double")).otherwise(share))
    digest = F.md5(F.concat_ws("|", F.lit(SEED), F.col("_null").cast("int").cast("string"), F.col("_source")).cast("binary"))
    return s.select(
        "_null", "_source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("copies_each"),
        (F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double") / F.lit(float(1 << 32))).alias("offset"),
    )


def with_copies(rows: DataFrame, counts_from: DataFrame) -> DataFrame:
    """``rows`` (of ``sized``) with source_size, target and ``copies``.

    ``counts_from`` holds the same rows (any columns besides the keys); group
    counts and source sizes are read from it.
    """
    group = ["_null", "_source", "_class", "_salt"]
    counts = counts_from.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    classes = counts.groupBy(*group[:3]).agg(F.sum("n").alias("n"))
    before_class = classes.select(
        *group[:3], (F.sum("n").over(Window.partitionBy(*group[:2]).orderBy("_class")) - F.col("n")).alias("before_class")
    )
    before_salt = counts.select(
        *group, (F.sum("n").over(Window.partitionBy(*group[:3]).orderBy("_salt")) - F.col("n")).alias("before_salt")
    )
    line = (
        before_salt.join(before_class, group[:3])
        .join(targets(counts_from), group[:2])
        .select(*group, (F.col("before_class") + F.col("before_salt")).alias("before"), "source_size", "target", "copies_each", "offset")
    )
    nth = F.row_number().over(Window.partitionBy(*group).orderBy("size", F.col("_id").asc_nulls_last()))
    placed = rows.withColumn("nth", nth).join(line, group)
    at = F.col("before") + F.col("nth")
    edge = lambda i: F.floor(F.col("offset") + F.col("copies_each") * i.cast("double"))
    return placed.withColumn("copies", (edge(at) - edge(at - 1)).cast("long"))


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: each row once per copy, same columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "source", "text")
    rows = sized(packed, ["_row"])
    keys = materialize(sized(docs.select("doc_id", "source", "text"), []).drop("_id"), "mix-keys")
    taken = with_copies(rows, keys).filter(F.col("copies") > 0).select("_row", "copies")
    one = taken.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return one.select("_row.*")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    rows = materialize(sized(documents(spark, sf_dir), ["doc_id"]), "mix-sizes")
    return with_copies(rows, rows).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, source IS NULL AS nul, coalesce(source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2) AS salt
  FROM documents),
s0 AS (SELECT nul, src, sum(size)::BIGINT AS source_size FROM d GROUP BY nul, src),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY nul, src COLLATE "binary") - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s0),
s2 AS (SELECT *, CAST(source_size AS DOUBLE) / w AS ratio, sum(source_size) OVER () AS total, sum(w) OVER () AS w_all FROM s1),
s3 AS (SELECT a.*, coalesce((SELECT sum(b.source_size) FROM s2 b WHERE b.ratio < a.ratio), 0) AS size_below,
              coalesce((SELECT sum(b.w) FROM s2 b WHERE b.ratio < a.ratio), 0) AS w_below FROM s2 a),
s4 AS (SELECT *, (3 * total - 4 * size_below) * w > 4 * source_size * (w_all - w_below) AS capped FROM s3),
s5 AS (SELECT *, sum(CASE WHEN capped THEN source_size ELSE 0 END) OVER () AS size_capped,
              sum(CASE WHEN capped THEN w ELSE 0 END) OVER () AS w_capped FROM s4),
s6 AS (SELECT nul, src, source_size,
              CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE)
                   ELSE CAST((3 * total - 4 * size_capped) * w AS DOUBLE) / CAST(2 * (w_all - w_capped) AS DOUBLE) END AS target
       FROM s5),
s7 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each,
              CAST(('0x' || substr(md5('{SEED}|' || CAST(nul AS INT) || '|' || src), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0 AS u
       FROM s6),
r AS (SELECT d.*, row_number() OVER (PARTITION BY nul, src ORDER BY floor(sqrt(CAST(size AS DOUBLE))), salt, size, doc_id NULLS LAST) AS pos FROM d)
SELECT r.doc_id, r.size, s7.source_size, s7.target,
       CAST((floor(u + each * CAST(pos AS DOUBLE)) - floor(u + each * CAST(pos - 1 AS DOUBLE))) * r.size AS BIGINT) AS taken
FROM r JOIN s7 ON r.nul = s7.nul AND r.src = s7.src
"""
