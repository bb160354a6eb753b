"""Structured Streaming forms of the sync (ST1-ST3).

ST2 is the miss counter as typed keyed state (``transformWithStateInPandas``):
one value per (domain, url) in RocksDB, fed explicit present/absent rows per run,
with an initial state and a time to live if wanted.
ST1 and ST3 drive the sync state from ``foreachBatch``; both are idempotent on
replay (a finished run id is skipped).

Every scratch path lives under the shared checkpoint folder of the session.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pagetide.operators import sync as S
from pagetide.session import checkpoint_dir, written

PRESENCE_SCHEMA = "domain string, url string, run_id int, present boolean, trusted boolean"
MISS_OUT_SCHEMA = "domain string, url string, run_id int, consecutive_misses int, deleted boolean, late boolean"
MISS_STATE_SCHEMA = "misses int, tracked boolean, last_run int"


def scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "streams", f"{name}-{uuid.uuid4().hex[:10]}")


def miss_step(rows: pd.DataFrame, state: tuple | None, threshold: int = S.DELETION_MISS_THRESHOLD) -> tuple[list[tuple], tuple]:
    """One URL's rows of a micro-batch on its state (misses, tracked, last run):
    ``(run_id, misses, deleted, late)`` rows and the new state. The rule is that of
    ``sync.miss_history`` (J5)."""
    misses, tracked, last_run = state or (0, False, -1)
    rows = rows.sort_values("run_id")
    out = []
    for run_id, present, trusted in zip(rows["run_id"], rows["present"], rows["trusted"]):
        if run_id <= last_run:  # older than the state: cannot count any more
            out.append((int(run_id), int(misses), False, True))
            continue
        last_run = int(run_id)
        if present:
            misses, tracked = 0, True
            continue
        if not tracked:
            continue
        if trusted:
            misses += 1
        if misses >= 1:
            out.append((last_run, misses, misses == threshold, False))
        if misses == threshold:
            misses, tracked = 0, False
    return out, (int(misses), bool(tracked), int(last_run))


class MissCounter(StatefulProcessor):
    """State of one URL: a typed value, forgotten ``ttl_days`` after its last run."""

    def __init__(self, threshold: int, ttl_days: int | None):
        self.threshold, self.ttl_days = threshold, ttl_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = self.ttl_days * 86_400_000 if self.ttl_days else None
        self.value = handle.getValueState("misses", MISS_STATE_SCHEMA, ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.value.get() if self.value.exists() else None
        found, state = miss_step(pd.concat(list(rows), ignore_index=True), state, self.threshold)
        self.value.update(state)
        yield pd.DataFrame([(key[0], key[1], *f) for f in found], columns=["domain", "url", "run_id", "consecutive_misses", "deleted", "late"])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        first = initialState.iloc[0]
        self.value.update((int(first["misses"]), bool(first["tracked"]), int(first["last_run"])))

    def close(self) -> None:
        pass


def miss_counter_stream(
    presence: DataFrame, initial: DataFrame | None = None, ttl_days: int | None = None, threshold: int = S.DELETION_MISS_THRESHOLD
) -> DataFrame:
    """ST2 over a streaming DataFrame of ``PRESENCE_SCHEMA`` rows. ``initial``
    (domain, url, misses, tracked, last_run) is the state that the first
    micro-batch starts from, one row per URL."""
    from pagetide.session import ship_package

    ship_package(presence.sparkSession)
    return presence.groupBy("domain", "url").transformWithStateInPandas(
        MissCounter(threshold, ttl_days), MISS_OUT_SCHEMA, "Append", "ProcessingTime" if ttl_days else "None",
        initialState=initial.groupBy("domain", "url") if initial is not None else None,
    )


#: What typed state needs, and no micro-batches without data: with a time to live
#: these would go on for ever.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB; the session's own
    settings are restored."""
    old = {name: spark.conf.get(name, None) for name in STATE_CONF}
    for name, value in STATE_CONF.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def feed_miss_counter(spark: SparkSession, source: str, base: str, **options) -> None:
    """Run ST2 over what is new in ``source`` and stop: a restart goes on from the
    state of the checkpoint under ``base``."""
    with rocksdb_state(spark):
        q = (
            miss_counter_stream(spark.readStream.schema(PRESENCE_SCHEMA).parquet(source), **options)
            .writeStream.format("parquet")
            .option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/ckpt")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination()


def run_miss_counter_stream(spark: SparkSession, run_map: DataFrame) -> DataFrame:
    """Feed a run history through ST2 and return the emitted candidate states
    (read back from the stream's parquet sink). ``late`` rows, whose run is not
    after the last one that their URL has seen, are in ``miss_stream_late``."""
    return _miss_stream_sink(spark, run_map).where(~F.col("late")).drop("late")


def miss_stream_late(spark: SparkSession, run_map: DataFrame) -> DataFrame:
    return _miss_stream_sink(spark, run_map).where("late").select("domain", "url", "run_id")


def _miss_stream_sink(spark: SparkSession, run_map: DataFrame) -> DataFrame:
    """Each run is written when it happens, and the stream started anew on it: the
    state alone carries the history."""
    base = scratch(spark, "miss")
    health = S.run_health(run_map).select("domain", "run_id", "trusted")
    presence = run_map.join(health, ["domain", "run_id"]).select("domain", "url", "run_id", "present", "trusted")
    runs = sorted(r["run_id"] for r in run_map.select("run_id").distinct().collect())
    for run_id in runs:
        presence.where(F.col("run_id") == run_id).write.mode("append").parquet(f"{base}/in")
        feed_miss_counter(spark, f"{base}/in", base)
    return spark.read.schema(MISS_OUT_SCHEMA).parquet(f"{base}/out")


def snapshot_stream(spark: SparkSession, store, source_dir: str, pages: DataFrame, ckpt: str, **opts):
    """ST1: every micro-batch of map snapshots ``(domain, url, seq, run_id,
    run_ts)`` runs the sync once per run id it contains, in order, at the run's
    own time; finished run ids are skipped, so a replayed micro-batch changes
    nothing."""
    from pagetide.plans.sync_job import RunOptions, sync

    def apply(batch: DataFrame, epoch: int) -> None:
        done = {r["run_id"] for r in store.run_log().select("run_id").distinct().collect()}
        runs = batch.groupBy("run_id").agg(F.max("run_ts").alias("run_ts")).orderBy("run_id").collect()
        for run_id, run_ts in runs:
            if run_id in done:
                continue
            snap = batch.where(F.col("run_id") == run_id).select("domain", "url", "seq")
            sync(spark, store, snap, pages, RunOptions(run_id=run_id, run_ts=run_ts, **opts))

    src = spark.readStream.schema("domain string, url string, seq bigint, run_id int, run_ts string").parquet(source_dir)
    q = src.writeStream.foreachBatch(apply).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return store


def page_upsert_stream(spark: SparkSession, store, source_dir: str, ckpt: str):
    """ST3: rendered page documents arriving as a stream are upserted by
    ``(domain, slug)``: only a newer ``seq`` replaces, and an identical
    ``content_sha`` is a no-op, so older or replayed documents change nothing.
    Each micro-batch writes the buckets of the documents that it changes."""
    from pagetide.operators.assemble import PAGE_DOC_COLUMNS, last_per_slug
    from pagetide.plans.sync_job import DOC_SCHEMA

    def apply(batch: DataFrame, epoch: int) -> None:
        incoming = last_per_slug(batch.select(*PAGE_DOC_COLUMNS))
        keys = incoming.select("domain", "slug")
        stored = store.docs().select("domain", "slug", F.col("seq").alias("_seq"), F.col("content_sha").alias("_sha")).join(keys, ["domain", "slug"], "left_semi")
        newer = F.col("_sha").isNull() | ((F.col("seq") > F.col("_seq")) & (F.col("content_sha") != F.col("_sha")))
        changed = incoming.join(stored, ["domain", "slug"], "left").where(newer).select(*PAGE_DOC_COLUMNS)
        store.upsert_docs(written(changed, "changed"), keys.limit(0))

    src = spark.readStream.schema(DOC_SCHEMA).parquet(source_dir)
    q = src.writeStream.foreachBatch(apply).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return store
