"""State and cache files of a previous sync (S3, S5), read for many sites at once.

Layout per site: ``<root>/<domain>/state.json`` and
``<root>/<domain>/batch-response.json``; the site key is taken from the
folder name (``domain=<site>`` as Spark writes it, too). A file that is not a JSON object (or is corrupt) counts as an
empty state, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

META = T.StructType([T.StructField(n, T.StringType()) for n in ("sourceURL", "ogUrl", "title", "description", "ogDescription")])
JSONX = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "description", "summary")])
PAGE = T.StructType(
    [T.StructField("markdown", T.StringType()), T.StructField("metadata", META), T.StructField("json", JSONX)]
)
BATCH = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("firecrawl_batch_id", T.StringType()),
        T.StructField("urls", T.ArrayType(T.StringType())),
        T.StructField("status", T.StringType()),
        T.StructField("pages", T.ArrayType(PAGE)),
        T.StructField("error", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)
CANDIDATE = T.StructType(
    [
        T.StructField("consecutive_misses", T.IntegerType()),
        T.StructField("first_missing_at", T.StringType()),
        T.StructField("last_missing_at", T.StringType()),
    ]
)
STATE = T.StructType(
    [
        T.StructField(
            "map",
            T.StructType(
                [
                    T.StructField("urls", T.ArrayType(T.StringType())),
                    T.StructField("timestamp", T.StringType()),
                    T.StructField("payload", T.StructType([T.StructField("url", T.StringType()), T.StructField("limit", T.LongType())])),
                ]
            ),
        ),
        T.StructField("batches", T.MapType(T.StringType(), BATCH)),
        T.StructField("deletion_candidates", T.MapType(T.StringType(), CANDIDATE)),
    ]
)


def _site_of_path() -> F.Column:
    return F.try_url_decode(F.regexp_extract(F.input_file_name(), r"/(?:domain=)?([^/]+)/[^/]+$", 1))


def read_state(spark: SparkSession, pattern: str) -> dict[str, DataFrame]:
    """S3: state files -> ``map``, ``batches``, ``batch_pages``, ``candidates``.

    Each file is one JSON document (``wholetext``); parsing is per file, so a
    corrupt file yields an empty state for its site only.
    """
    raw = spark.read.option("wholetext", True).text(pattern).select(
        _site_of_path().alias("domain"), F.from_json("value", STATE).alias("s")
    )
    ok = raw.where(F.col("s").isNotNull())
    mp = ok.select("domain", F.posexplode("s.map.urls").alias("seq", "url")).select(
        "domain", F.trim("url").alias("url"), F.col("seq").cast("bigint")
    ).where(F.col("url") != "")
    batches = ok.select("domain", F.explode("s.batches").alias("key", "b")).select(
        "domain", F.coalesce("b.batch_id", "key").alias("batch_id"), "b.urls", "b.status", "b.error",
        F.to_timestamp("b.timestamp").alias("ts"), "b.pages",
    )
    batch_pages = batches.select("domain", "batch_id", "status", "ts", F.posexplode("pages").alias("pos", "page"))
    cands = ok.select("domain", F.explode("s.deletion_candidates").alias("url", "c")).select(
        "domain", "url", "c.consecutive_misses",
        F.to_timestamp("c.first_missing_at").alias("first_missing_at"),
        F.to_timestamp("c.last_missing_at").alias("last_missing_at"),
    )
    return {"map": mp, "batches": batches.drop("pages"), "batch_pages": batch_pages, "candidates": cands}


def state_cached_pages(batch_pages: DataFrame, urls: DataFrame | None = None, keep: str = "first") -> DataFrame:
    """Pages of completed batches, one per (domain, sourceURL), optionally
    restricted to a URL set. keep="first" = oldest batch (reference order)."""
    from pyspark.sql import Window

    p = batch_pages.where(F.col("status") == "completed").select(
        "domain", "batch_id", "ts", "pos", F.col("page.metadata.sourceURL").alias("url"), "page"
    )
    if urls is not None:
        p = p.join(urls.select("domain", "url"), ["domain", "url"], "left_semi")
    order = [F.asc("ts"), F.asc("batch_id"), F.asc("pos")] if keep == "first" else [F.desc("ts"), F.asc("batch_id"), F.asc("pos")]
    w = Window.partitionBy("domain", "url").orderBy(*order)
    return p.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("domain", "url", "batch_id", "page")


def read_legacy_pages(spark: SparkSession, pattern: str) -> DataFrame:
    """Legacy page lists — a JSON array of pages, or an object with ``data``."""
    raw = spark.read.option("wholetext", True).text(pattern).select(_site_of_path().alias("domain"), "value")
    as_list = F.from_json("value", T.ArrayType(PAGE))
    as_obj = F.from_json("value", T.StructType([T.StructField("data", T.ArrayType(PAGE))]))["data"]
    # from_json would wrap a lone object into a one-element array: pick the
    # parser by the document's first character instead
    is_list = F.ltrim(F.col("value")).startswith("[")
    pages = raw.select("domain", F.posexplode(F.when(is_list, as_list).otherwise(as_obj)).alias("pos", "page"))
    return pages.select("domain", F.col("page.metadata.sourceURL").alias("url"), "pos", "page")


def with_fallback(state_pages: DataFrame, legacy: DataFrame, urls: DataFrame) -> DataFrame:
    """S4 then S5: the legacy list fills in URLs the state does not have."""
    from pyspark.sql import Window

    rest = legacy.join(urls.select("domain", "url"), ["domain", "url"], "left_semi").join(
        state_pages.select("domain", "url"), ["domain", "url"], "left_anti"
    )
    w = Window.partitionBy("domain", "url").orderBy("pos")
    rest = rest.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return state_pages.select("domain", "url", "page", F.lit("state").alias("source")).unionByName(
        rest.select("domain", "url", "page", F.lit("legacy").alias("source"))
    )
