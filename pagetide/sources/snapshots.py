"""Sync inputs derived from ``pages`` (FIXTURES.md §2).

The reference syncs one site against the state of its previous run. These
relations play "previous run" and "this run" for every site at once. They are
whole-table derivations; the residues on ``page_id`` decide which snapshot a
page is missing from. No page is missing from both maps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.operators.extract import keyed_pages
from pagetide.operators.rank import positions
from pagetide.functions.urls import batch_id_of
from pagetide.plans.memo import shared
from pagetide.sources.tables import read_pages

# Run timestamps are parameters, never current_timestamp(): results must not
# depend on the wall clock.
PREV_RUN_TS = "2026-01-01 00:00:00"
RUN_TS = "2026-01-08 00:00:00"


@dataclass(frozen=True)
class SnapshotSpec:
    prev_drop_mod: int = 5      # page absent from the previous map
    cur_drop_mod: int = 7       # page absent from the current map
    uncached_mod: int = 11      # previous-map page never fetched (backfill)
    edited_mod: int = 13        # cached document differs from the new rendering
    batch_chunk: int = 5        # URLs per batch record
    failed_chunk_mod: int = 3   # chunk % 3 == 2 -> failed batch
    n_runs: int = 5


SPEC = SnapshotSpec()


@shared
def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain, url, seq) of every page; ``seq`` = page_id = list order."""
    return keyed_pages(read_pages(spark, sf_dir, "page_id", "url")).select("domain", "url", "seq")


def prev_map(spark: SparkSession, sf_dir: str, spec: SnapshotSpec = SPEC) -> DataFrame:
    return site_pages(spark, sf_dir).where(F.col("seq") % spec.prev_drop_mod != 0)


def cur_map(spark: SparkSession, sf_dir: str, spec: SnapshotSpec = SPEC) -> DataFrame:
    keep = (F.col("seq") % spec.cur_drop_mod != 0) | (F.col("seq") % spec.prev_drop_mod == 0)
    return site_pages(spark, sf_dir).where(keep)


def cached_urls(spark: SparkSession, sf_dir: str, spec: SnapshotSpec = SPEC) -> DataFrame:
    """URLs fetched by the previous run (before batch failures)."""
    return prev_map(spark, sf_dir, spec).where(F.col("seq") % spec.uncached_mod != 0)


def batches(spark: SparkSession, sf_dir: str, spec: SnapshotSpec = SPEC) -> DataFrame:
    """Batch records of the previous run: chunks of cached URLs per site.

    ``(domain, chunk, batch_id, urls, n_urls, status, ts, error, credits_used)``;
    status failed where chunk % 3 == 2, in one of three ways per site. Only keys
    travel; pages stay in their own table.
    """
    c = positions(cached_urls(spark, sf_dir, spec), ["domain"], [F.asc("url")])
    c = c.withColumn("chunk", F.floor((F.col("pos") - 1) / spec.batch_chunk).cast("int"))
    g = c.groupBy("domain", "chunk").agg(F.array_sort(F.collect_list("url")).alias("urls"))
    failed, way = F.col("chunk") % spec.failed_chunk_mod == 2, F.length("domain") % 3
    error = F.when(way == 0, "batch_failed").when(way == 1, "poll_timeout").otherwise(F.concat(F.lit("HTTP 503 for site "), "domain"))
    return g.select(
        "domain", "chunk",
        batch_id_of("urls").alias("batch_id"),
        "urls",
        F.size("urls").cast("bigint").alias("n_urls"),
        F.when(failed, "failed").otherwise("completed").alias("status"),
        (F.to_timestamp(F.lit(PREV_RUN_TS)) + F.make_interval(mins=F.col("chunk"))).alias("ts"),
        F.when(failed, error).alias("error"),
        F.when(~failed, 5 * F.size("urls")).cast("bigint").alias("credits_used"),
    )


def interrupted_batches(queue: DataFrame, chunk_size: int) -> DataFrame:
    """Batches of a run over ``queue`` that was cut off: every third chunk was
    done and every third was being polled; the rest was not submitted."""
    c = queue.withColumn("chunk", F.floor((F.col("queue_pos") - 1) / chunk_size).cast("int"))
    g = c.groupBy("domain", "chunk").agg(F.array_sort(F.collect_list("url")).alias("urls"))
    turn = (F.col("chunk") + F.length("domain")) % 3
    return g.where(turn < 2).select(
        "domain", batch_id_of("urls").alias("batch_id"), F.when(turn == 0, "completed").otherwise("polling").alias("status"),
        F.size("urls").cast("bigint").alias("n_urls"),
    )


def prev_candidates(spark: SparkSession, sf_dir: str, spec: SnapshotSpec = SPEC) -> DataFrame:
    """Deletion candidates carried from earlier runs.

    Pages absent from the previous map, with 1 or 2 misses so far.
    """
    p = site_pages(spark, sf_dir).where(F.col("seq") % spec.prev_drop_mod == 0)
    misses = (1 + F.floor(F.col("seq") / spec.prev_drop_mod) % 2).cast("int")
    last = F.to_timestamp(F.lit(PREV_RUN_TS))
    return p.select(
        "domain", "url",
        misses.alias("consecutive_misses"),
        (last - F.make_interval(days=(misses - 1) * 7)).alias("first_missing_at"),
        last.alias("last_missing_at"),
    )


def empty_run_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site whose run 1 map comes back empty: most pages, then name."""
    counts = site_pages(spark, sf_dir).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    # global min_by: partial aggregates per partition, one row to the driver side
    return counts.agg(F.min_by("domain", F.struct(-F.col("n"), F.col("domain"))).alias("domain"))


def run_map(spark: SparkSession, sf_dir: str, spec: SnapshotSpec = SPEC) -> DataFrame:
    """Five map runs with explicit presence rows ``(domain, url, run_id, present)``."""
    pages = site_pages(spark, sf_dir)
    grid = pages.withColumn("run_id", F.explode(F.sequence(F.lit(0), F.lit(spec.n_runs - 1))))
    # exactly one row: broadcasting it is size-bounded
    hole = F.broadcast(empty_run_domain(spark, sf_dir).withColumn("empty_site", F.lit(True)))
    grid = grid.join(hole, "domain", "left")
    absent = (
        ((F.col("seq") % spec.cur_drop_mod == 0) & (F.col("run_id") >= 2))
        | ((F.col("seq") % spec.uncached_mod == 3) & (F.col("run_id") == 3))
        | (F.coalesce(F.col("empty_site"), F.lit(False)) & (F.col("run_id") == 1))
    )
    return grid.select("domain", "url", "seq", "run_id", (~absent).alias("present"))
