"""Four-plus-run scenario of the whole sync job, its state and its files."""

import os
import uuid

from conftest import SF001
from pyspark.sql import functions as F

from pagetide.plans.sync_job import RunOptions, CorpusStore, sync
from pagetide.session import checkpoint_dir
from pagetide.sources import snapshots as SN
from pagetide.sources.tables import read_pages


def _store(spark):
    root = os.path.join(checkpoint_dir(spark), "store-" + uuid.uuid4().hex[:8])
    return CorpusStore(spark, root)


def test_scenario_with_untrusted_run(spark):
    store = _store(spark)
    pages = read_pages(spark, SF001)
    runs = SN.run_map(spark, SF001)
    n_pages = pages.count()
    empty_site = SN.empty_run_domain(spark, SF001).collect()[0]["domain"]
    logs = []
    for r in range(5):
        new_map = runs.where((F.col("run_id") == r) & F.col("present")).select("domain", "url", "seq")
        out = sync(spark, store, new_map, pages, RunOptions(run_id=r, run_ts=f"2026-03-0{r + 1} 00:00:00"))
        logs.append({x["domain"]: x for x in out["log"].collect()})
    assert store.runs() == [0, 1, 2, 3, 4]
    # run 0: every page fetched and added
    assert sum(x["fetched"] for x in logs[0].values()) == n_pages
    assert sum(x["added"] for x in logs[0].values()) == sum(x["total"] for x in logs[0].values())
    # run 1: the empty map of one site is untrusted; nothing fetched, map cost only
    assert logs[1][empty_site]["trusted"] is False and logs[1][empty_site]["reason"] == "empty_map"
    assert all(x["fetched"] == 0 and x["credits"] == 1 for x in logs[1].values())
    assert all(x["deleted"] == 0 for x in logs[1].values())
    # pages missing from runs 2, 3, 4 (trusted) are deleted at run 4, not before
    assert sum(x["deleted"] for lg in logs[:4] for x in lg.values()) == 0
    gone = runs.where((F.col("seq") % 7 == 0) & (F.col("run_id") == 4)).select("url").collect()
    deleted_at_4 = sum(x["deleted"] for x in logs[4].values())
    assert 0 < deleted_at_4 <= len(gone)
    docs_urls = {r["url"] for r in store.docs().select("url").collect()}
    assert len(docs_urls & {g["url"] for g in gone}) == len(gone) - deleted_at_4
    # the run log holds one row per site and run
    assert store.run_log().count() == sum(len(lg) for lg in logs)


def test_second_sync_same_input_is_unchanged(spark):
    store = _store(spark)
    pages = read_pages(spark, SF001)
    m = SN.cur_map(spark, SF001)
    sync(spark, store, m, pages, RunOptions(run_id=0, run_ts="2026-04-01 00:00:00"))
    out = sync(spark, store, m, pages, RunOptions(run_id=1, run_ts="2026-04-02 00:00:00"))
    rows = out["log"].collect()
    assert all(r["added"] == 0 and r["updated"] == 0 and r["fetched"] == 0 for r in rows)
    # dry run writes nothing and quotes nothing to fetch
    before = store.runs()
    prev = sync(spark, store, m, pages, RunOptions(run_id=2, run_ts="2026-04-03 00:00:00", dry_run=True))
    assert store.runs() == before
    assert all(r["up_to_date"] for r in prev["preview"].collect())
    # cache-only rebuild re-renders the same documents at zero cost
    out = sync(spark, store, m, pages, RunOptions(run_id=3, run_ts="2026-04-04 00:00:00", cache_only=True))
    rows = out["log"].collect()
    assert all(r["credits"] == 0 and r["updated"] == 0 and r["added"] == 0 for r in rows)


def test_markdown_export(spark):
    from pagetide.plans.export import changed_docs, export_markdown
    from pagetide.plans import queries as Q
    from pagetide.operators import assemble as A
    from pagetide.streaming.snapshots import scratch

    docs = Q.scoped(Q.docs)(spark, SF001)
    empty = docs.limit(0)
    diff = A.content_diff(docs, empty)
    out = scratch(spark, "export")
    export_markdown(changed_docs(docs, diff), out)
    local = out[len("file:"):] if out.startswith("file:") else out
    files = [os.path.join(d, f) for d, _, fs in os.walk(local) for f in fs if f.endswith(".md")]
    assert len(files) == docs.count()
    one = docs.orderBy("domain", "slug").first()
    with open(os.path.join(local, one["domain"], one["slug"] + ".md"), encoding="utf-8") as f:
        assert f.read() == one["content"]


def _small(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://a.com/x", "<body><p>Old x.</p></body>"), (2, "https://www.a.com/x?ref=1", "<body><p>New x.</p></body>"),
            (3, "https://a.com/y", "<body><p>Y.</p></body>"), (4, "https://a.com/y#top", "<body><p>Other y.</p></body>"),
        ],
        "page_id long, url string, html string",
    )
    new_map = spark.createDataFrame(
        [("a.com", "https://a.com/x", 1), ("a.com", "https://a.com/y", 2), ("a.com", "https://a.com/z", 3)], "domain string, url string, seq long"
    )
    return pages, new_map


def test_pages_are_found_by_canonical_url(spark):
    store, (pages, new_map) = _store(spark), _small(spark)
    out = sync(spark, store, new_map, pages, RunOptions(run_id=0, run_ts="2026-04-01 00:00:00"))
    log = out["log"].collect()[0]
    # an exact URL wins, otherwise the latest page; z has no page and is not paid for
    assert (log.queued, log.fetched, log.credits) == (3, 2, 11)
    bodies = {x.url: x.body for x in store.docs().collect()}
    assert bodies["https://a.com/y"].strip() == "Y." and set(bodies) == {"https://a.com/x", "https://a.com/y"}
    got = {(x.status, tuple(x.urls)) for x in store.batches().collect()}
    assert got == {("completed", ("https://a.com/x", "https://a.com/y")), ("failed", ("https://a.com/z",))}
    again = sync(spark, store, new_map, pages, RunOptions(run_id=1, run_ts="2026-04-02 00:00:00"))["log"].collect()[0]
    assert (again.queued, again.fetched, again.credits) == (1, 0, 1)


def test_forced_run_counts_no_miss_and_rebuild_implies_force(spark):
    store, (pages, new_map) = _store(spark), _small(spark)
    sync(spark, store, new_map, pages, RunOptions(run_id=0, run_ts="2026-04-01 00:00:00"))
    one = new_map.where("seq = 1")
    log = sync(spark, store, one, pages, RunOptions(run_id=1, run_ts="2026-04-02 00:00:00", force=True))["log"].collect()[0]
    assert (log.trusted, log.deleted, log.fetched) == (True, 0, 1)
    assert store.candidates().count() == 0
    assert RunOptions(run_id=2, run_ts="2026-04-03 00:00:00", rebuild=True).force
    import pytest

    with pytest.raises(ValueError):
        RunOptions(run_id=2, run_ts="epoch-3")


def test_site_list_reports_sites_without_urls(spark):
    store, (pages, new_map) = _store(spark), _small(spark)
    sites = spark.createDataFrame([("a.com",), ("empty.com",)], "domain string")
    log = sync(spark, store, new_map, pages, RunOptions(run_id=0, run_ts="2026-04-01 00:00:00"), sites=sites)["log"]
    assert {x.domain: x.status for x in log.collect()} == {"a.com": "ok", "empty.com": "error_empty_map"}
    only = spark.createDataFrame([("b.com",), ("c.com",)], "domain string")
    more = spark.createDataFrame([("b.com", "https://b.com/y", 1)], "domain string, url string, seq long")
    b = spark.createDataFrame([(9, "https://b.com/y", "<p>B.</p>")], "page_id long, url string, html string")
    sync(spark, store, more, b, RunOptions(run_id=1, run_ts="2026-04-02 00:00:00"), sites=only)
    assert {x.domain for x in store.map().select("domain").distinct().collect()} == {"a.com", "b.com"}


def _files(spark, store):
    """bucket -> {file: modification time} of the document files."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{store.root}/docs")
    fs, out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), {}
    for folder in fs.listStatus(path):
        if folder.isDirectory() and "bucket=" in folder.getPath().getName():
            out[folder.getPath().getName()] = {f.getPath().getName(): f.getModificationTime() for f in fs.listStatus(folder.getPath())}
    return out


def _site(spark, n, edited=()):
    rows = [(i, f"https://a.com/p{i}", f"<body><p>Page {i}{' edited' if i in edited else ''}.</p></body>") for i in range(n)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return pages, pages.select(F.lit("a.com").alias("domain"), "url", F.col("page_id").alias("seq"))


def test_a_small_change_writes_only_its_buckets(spark):
    store = CorpusStore(spark, os.path.join(checkpoint_dir(spark), "store-" + uuid.uuid4().hex[:8]), buckets=32)
    pages, new_map = _site(spark, 300)
    sync(spark, store, new_map, pages, RunOptions(run_id=0, run_ts="2026-04-01 00:00:00"))
    before = _files(spark, store)
    assert len(before) == 32
    # an idle run writes no document
    log = sync(spark, store, new_map, pages, RunOptions(run_id=1, run_ts="2026-04-02 00:00:00"))["log"].collect()[0]
    assert (log.unchanged, log.added, log.updated, log.total) == (300, 0, 0, 300) and _files(spark, store) == before
    # three new pages (1 %) are added: at most three buckets change
    pages, new_map = _site(spark, 303)
    log = sync(spark, store, new_map, pages, RunOptions(run_id=2, run_ts="2026-04-03 00:00:00"))["log"].collect()[0]
    assert (log.unchanged, log.added, log.updated, log.total) == (300, 3, 0, 303)
    after = _files(spark, store)
    changed = [b for b in after if after[b] != before[b]]
    assert 1 <= len(changed) <= 3
    # a forced run over two edited pages renders all and writes the two
    pages, new_map = _site(spark, 303, edited=(5, 77))
    out = sync(spark, store, new_map, pages, RunOptions(run_id=3, run_ts="2026-04-04 00:00:00", force=True))
    log = out["log"].collect()[0]
    assert (log.unchanged, log.added, log.updated, log.total, out["fetched"]) == (301, 0, 2, 303, 303)
    assert {(r.slug, r.status) for r in out["changed"].collect()} == {("p5", "updated"), ("p77", "updated")}
    last = _files(spark, store)
    assert 1 <= len([b for b in last if last[b] != after[b]]) <= 2
    assert store.docs().where("body like '%edited%'").count() == 2 and store.docs().count() == 303


def test_a_removed_page_gives_its_slug_to_the_one_before(spark):
    store, pages = _store(spark), spark.createDataFrame(
        [(1, "https://a.com/x", "<body><p>One.</p></body>"), (2, "https://a.com/x?b", "<body><p>Two.</p></body>"), (3, "https://a.com/y", "<body><p>Y.</p></body>")]
        + [(10 + i, f"https://a.com/z{i}", f"<body><p>Z {i}.</p></body>") for i in range(6)],
        "page_id long, url string, html string",
    )
    every = pages.select(F.lit("a.com").alias("domain"), "url", F.col("page_id").alias("seq"))
    sync(spark, store, every, pages, RunOptions(run_id=0, run_ts="2026-04-01 00:00:00"))
    body = lambda: {r.slug: r.body.strip() for r in store.docs().collect()}
    assert body()["x"] == "Two." and len(body()) == 8
    left = every.where("seq not in (2, 3)")
    for run in (1, 2, 3):
        log = sync(spark, store, left, pages, RunOptions(run_id=run, run_ts=f"2026-04-0{run + 1} 00:00:00"))["log"].collect()[0]
        assert log.deleted == (2 if run == 3 else 0)
    assert body()["x"] == "One." and "y" not in body() and len(body()) == 7
    assert (log.added, log.updated, log.total) == (0, 1, 7)


def test_a_run_that_died_is_invisible_and_can_be_repeated(spark):
    import pytest

    store, (pages, new_map) = _store(spark), _small(spark)
    sync(spark, store, new_map, pages, RunOptions(run_id=0, run_ts="2026-04-01 00:00:00"))
    half = spark.createDataFrame([("a.com", "https://a.com/half", 7)], "domain string, url string, seq long")
    store.write("map", 1, half)  # died before its log
    assert store.runs() == [0] and {r.url for r in store.map().collect()} == {r.url for r in new_map.collect()}
    again = sync(spark, store, new_map, pages, RunOptions(run_id=1, run_ts="2026-04-02 00:00:00"))["log"].collect()[0]
    assert store.runs() == [0, 1] and (again.added, again.unchanged) == (0, 2)
    assert {r.url for r in store.map().collect()} == {r.url for r in new_map.collect()}
    with pytest.raises(RuntimeError):
        sync(spark, store, new_map, pages, RunOptions(run_id=1, run_ts="2026-04-02 00:00:00"))


def test_rebuild_drops_pages_that_are_not_fetched_again(spark):
    store, (pages, new_map) = _store(spark), _small(spark)
    sync(spark, store, new_map, pages, RunOptions(run_id=0, run_ts="2026-04-01 00:00:00"))
    only_y = pages.where("page_id = 3")
    log = sync(spark, store, new_map, only_y, RunOptions(run_id=1, run_ts="2026-04-02 00:00:00", rebuild=True))["log"].collect()[0]
    assert {r.slug for r in store.docs().collect()} == {"y"} and log.total == 1
