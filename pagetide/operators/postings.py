"""Term-to-page postings: candidates first, the search's regex verifies (Q1, Q2, Q6).

A search is a substring search, so postings hold the words of a page (runs of
letters and digits, lower case), and the vocabulary is searched for words that
contain the longest run of letters and digits of each alternative: a text that
matches holds such a word. Only the partitions of these words are read, and only
the documents that they name.

  <root>/vocabulary/bucket=<k>   (term, n_pages)
  <root>/postings/bucket=<k>     (term, domain, slug), by hash of the term

Alternatives that are no plain text, or hold no letter or digit, need the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.functions import patterns as P

BUCKETS = 64
#: Tasks that a bucket's rows are dealt to when it is written: one word may be in every page.
SPREAD = 8
VOCABULARY = "term string, n_pages bigint, bucket int"
POSTINGS = "term string, domain string, slug string, bucket int"
_META = re.compile(r"[\\.^$*+?()\[\]{}]")


class Postings:
    """The postings of a documents table, under ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def build(self, docs: DataFrame) -> "Postings":
        """Write postings of the contents and slugs of ``docs``."""
        text = F.lower(F.concat_ws(" ", "content", "slug"))
        words = F.array_distinct(F.split(text, P.TOKEN_SPLIT))
        rows = docs.select("domain", "slug", F.explode(words).alias("term")).where("term <> ''")
        rows = rows.withColumn("bucket", self._bucket())
        spread = F.pmod(F.xxhash64("domain", "slug"), F.lit(SPREAD))
        rows.repartition("bucket", spread).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.root}/postings")
        n = self._read("postings", POSTINGS).groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("n_pages"))
        n.write.partitionBy("bucket").parquet(f"{self.root}/vocabulary")
        return self

    def _bucket(self):
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    def _read(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")

    def candidates(self, pattern: str) -> DataFrame | None:
        """(domain, slug) of all pages that can match ``pattern``; None if only a
        scan can tell."""
        runs = []
        for alternative in pattern.lower().split("|"):
            found = re.findall(r"[^\W_]+", alternative)
            if _META.search(alternative) or not found:
                return None
            runs.append(max(found, key=len))
        held = F.exists(F.array(*[F.lit(r) for r in runs]), lambda r: F.contains(F.col("term"), r))
        terms = self._read("vocabulary", VOCABULARY).where(held).select("term", "bucket")
        touched = sorted(r["bucket"] for r in terms.select("bucket").distinct().collect())  # no more than buckets
        rows = self._read("postings", POSTINGS).where(F.col("bucket").isin(touched) & held)
        return rows.select("domain", "slug").distinct()

    def restrict(self, docs: DataFrame, *patterns: str) -> DataFrame:
        """The documents that can match every one of ``patterns``."""
        for pattern in patterns:
            found = self.candidates(pattern)
            if found is not None:
                docs = docs.join(found, ["domain", "slug"], "left_semi")
        return docs
