"""Table scans (S1, S2). Column pruning reaches the parquet reader because
every caller selects only what it needs before any action."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.functions.urls import py_strip
from pagetide.operators.rank import positions
from pagetide.plans import probes

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


# Known layouts of the driver tables: no footer read at plan time.
SCHEMAS = {
    "pages": "page_id bigint, url string, html string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    df = reader.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def read_pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Raw pages ``(page_id, url, html)``; project ``html`` only when needed."""
    columns = columns or ("page_id", "url", "html")
    pages = read_table(spark, sf_dir, "pages", *columns)
    if probes.active():
        pages = pages.unionByName(spark.createDataFrame(probes.PAGES, SCHEMAS["pages"]).select(*columns))
    return pages


def read_map_files(spark: SparkSession, path: str) -> DataFrame:
    """The map files of many sites, ``<path>/<site>/<file>`` (or
    ``domain=<site>``), one URL per line: ``(domain, url, seq)``.

    ``seq`` is a URL's place in its site: files in order of their names, lines in
    file order, whichever tasks read them. Lines are stripped, blank ones dropped.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        py_strip("value").alias("url"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    folder = F.regexp_extract("file", r"/(?:domain=)?([^/]+)/[^/]+\z", 1)
    lines = lines.where(F.col("url") != "").withColumn("domain", F.try_url_decode(folder))
    placed = positions(lines, ["domain"], [F.asc("file"), F.asc("block"), F.asc("line")], "seq")
    return placed.select("domain", "url", "seq")


def read_map_text(spark: SparkSession, path: str, domain: str | None = None) -> DataFrame:
    """A map file, one URL per line; lines stripped, blanks dropped.

    ``seq`` keeps file order (monotonic within and across input splits).
    """
    df = spark.read.text(path)
    df = df.select(py_strip("value").alias("url")).where(F.col("url") != "")
    df = df.withColumn("seq", F.monotonically_increasing_id())
    if domain is not None:
        df = df.withColumn("domain", F.lit(domain))
    return df
