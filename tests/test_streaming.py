"""Streaming forms (ST1-ST3) against their batch twins."""

from conftest import SF001
from pyspark.sql import functions as F

from pagetide.operators import sync as S
from pagetide.plans.sync_job import CorpusStore
from pagetide.sources import snapshots as SN
from pagetide.sources.tables import read_pages
from pagetide.streaming import snapshots as ST


def _rows(df):
    return sorted(tuple(r) for r in df.select("domain", "url", "run_id", "consecutive_misses", "deleted").collect())


def test_keyed_state_equals_window_form(spark):
    runs = SN.run_map(spark, SF001)
    assert _rows(ST.run_miss_counter_stream(spark, runs)) == _rows(S.miss_history(runs))


def test_keyed_state_vectors(spark):
    rows = [("a.com", "u", i, p) for i, p in enumerate([True, False, False, False])]
    rows += [("a.com", "v", i, p) for i, p in enumerate([True, False, True, False])]
    rows += [("a.com", f"pad{k}", i, True) for i in range(4) for k in range(20)]
    rm = spark.createDataFrame(rows, "domain string, url string, run_id int, present boolean")
    out = {(r["url"], r["run_id"]): (r["consecutive_misses"], r["deleted"]) for r in ST.run_miss_counter_stream(spark, rm).collect()}
    assert [out.get(("u", i)) for i in range(4)] == [None, (1, False), (2, False), (3, True)]
    assert [out.get(("v", i)) for i in range(4)] == [None, (1, False), None, (1, False)]


def test_snapshot_stream_and_page_upsert(spark):
    pages = read_pages(spark, SF001)
    runs = SN.run_map(spark, SF001)
    src = ST.scratch(spark, "snap-src")
    for r in (0, 1):
        runs.where((F.col("run_id") == r) & F.col("present")).select("domain", "url", "seq", "run_id", F.lit(f"2026-03-0{r + 1} 00:00:00").alias("run_ts")) \
            .write.mode("append").parquet(src)
    store = CorpusStore(spark, ST.scratch(spark, "store"))
    ckpt = ST.scratch(spark, "snap-ckpt")
    ST.snapshot_stream(spark, store, src, pages, ckpt)
    assert store.runs() == [0, 1]
    assert sorted(r[0] for r in store.run_log().select("run_id").distinct().collect()) == [0, 1]
    # replay of the same source with a fresh checkpoint runs nothing anew
    ST.snapshot_stream(spark, store, src, pages, ST.scratch(spark, "snap-ckpt2"))
    assert store.runs() == [0, 1] and store.run_log().count() == len(set(map(tuple, store.run_log().select("run_id", "domain").collect())))

    # ST3: a stream of documents where one page changed
    docs = store.docs()
    one = docs.orderBy("domain", "slug").limit(1).withColumn("content", F.concat("content", F.lit(" edited"))) \
        .withColumn("content_sha", F.sha2("content", 256)).withColumn("seq", F.col("seq") + 100000)
    dsrc = ST.scratch(spark, "docs-src")
    docs.unionByName(one).write.parquet(dsrc)
    one.write.parquet(dsrc + "-one")
    one, n_docs = spark.read.parquet(dsrc + "-one"), docs.count()
    ST.page_upsert_stream(spark, store, dsrc, ST.scratch(spark, "docs-ckpt"))
    after = store.docs()
    assert after.count() == n_docs
    assert after.where(F.col("content").endswith(" edited")).count() == 1

    # an older document never replaces a newer one
    old = one.withColumn("seq", F.lit(-1).cast("bigint")).withColumn("content_sha", F.lit("old"))
    osrc = ST.scratch(spark, "docs-old")
    old.write.parquet(osrc)
    files = set(store.docs().inputFiles())
    ST.page_upsert_stream(spark, store, osrc, ST.scratch(spark, "docs-ckpt2"))
    assert set(store.docs().inputFiles()) == files


def _presence(spark, source, *rows):
    spark.createDataFrame(list(rows), ST.PRESENCE_SCHEMA).coalesce(1).write.mode("append").parquet(source)


def _misses(spark, base):
    rows = spark.read.schema(ST.MISS_OUT_SCHEMA).parquet(f"{base}/out").collect()
    return sorted((r.url, r.run_id, r.consecutive_misses, r.deleted, r.late) for r in rows)


def test_late_rows_and_restarts(spark):
    """Each call is a stream of its own that goes on from the checkpoint."""
    base = ST.scratch(spark, "miss-late")
    src = f"{base}/in"
    _presence(spark, src, ("a.com", "u", 0, True, True), ("a.com", "u", 3, False, True), ("a.com", "v", 0, True, True))
    ST.feed_miss_counter(spark, src, base)
    assert _misses(spark, base) == [("u", 3, 1, False, False)]
    _presence(spark, src, ("a.com", "u", 2, False, True), ("a.com", "u", 4, False, True), ("a.com", "v", 4, False, False))
    ST.feed_miss_counter(spark, src, base)
    assert _misses(spark, base) == [("u", 2, 1, False, True), ("u", 3, 1, False, False), ("u", 4, 2, False, False)]
    ST.feed_miss_counter(spark, src, base)  # nothing new, nothing twice
    _presence(spark, src, ("a.com", "u", 5, False, True), ("a.com", "v", 5, False, True))
    ST.feed_miss_counter(spark, src, base)
    assert _misses(spark, base)[3:] == [("u", 5, 3, True, False), ("v", 5, 1, False, False)]


def test_initial_state_and_time_to_live(spark):
    base = ST.scratch(spark, "miss-init")
    src = f"{base}/in"
    initial = spark.createDataFrame([("a.com", "u", 2, True, 6), ("a.com", "w", 1, True, 6)], "domain string, url string, misses int, tracked boolean, last_run int")
    _presence(spark, src, ("a.com", "u", 7, False, True), ("a.com", "new", 7, False, True), ("a.com", "w", 6, False, True))
    ST.feed_miss_counter(spark, src, base, initial=initial, ttl_days=30)
    assert _misses(spark, base) == [("u", 7, 3, True, False), ("w", 6, 1, False, True)]


def test_run_times_come_from_the_snapshot_rows(spark):
    """Run times come from the rows, whatever the micro-batch is called."""
    pages = spark.createDataFrame(
        [(i, f"https://a.com/p{i}", f"<html><body><p>Page {i}.</p></body></html>") for i in range(3)], "page_id long, url string, html string"
    )
    src, store = ST.scratch(spark, "many-src"), CorpusStore(spark, ST.scratch(spark, "many-store"))
    rows = [("a.com", f"https://a.com/p{i}", i, r, f"2026-03-{r + 1:02d} 00:00:00") for r in (0, 20) for i in range(3)]
    spark.createDataFrame(rows, "domain string, url string, seq long, run_id int, run_ts string").write.parquet(src)
    ST.snapshot_stream(spark, store, src, pages, ST.scratch(spark, "many-ckpt"))
    assert {(x.run_id, x.run_ts) for x in store.run_log().collect()} == {(0, "2026-03-01 00:00:00"), (20, "2026-03-21 00:00:00")}
    assert {str(x.ts) for x in store.batches().select("ts").collect()} == {"2026-03-01 00:00:00"}
