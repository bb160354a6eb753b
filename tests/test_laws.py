"""Laws of the sync and rendering jobs."""

from conftest import SF001, SF01
from pyspark.sql import functions as F

from pagetide.operators import assemble as A
from pagetide.operators import extract as E
from pagetide.operators import sync as S
from pagetide.plans import queries as Q
from pagetide.sources import snapshots as SN


def test_diff_partitions_known_and_new(spark):
    prev, cur = SN.prev_map(spark, SF01), SN.cur_map(spark, SF01)
    d = S.map_diff(prev, cur)
    counts = {r["status"]: r["n"] for r in d.groupBy("status").agg(F.count("*").alias("n")).collect()}
    n_prev = prev.select("domain", "url").distinct().count()
    n_cur = cur.select("domain", "url").distinct().count()
    assert counts["unchanged"] + counts["deleted"] == n_prev
    assert counts["unchanged"] + counts["new"] == n_cur


def test_health_guard_branches(spark):
    h = {r["domain"]: r for r in Q.health(spark, SF01).collect()}
    reasons = {r["reason"] for r in h.values()}
    assert {"first_run", "empty_map", "mass_deletion", ""} <= reasons
    for r in h.values():
        if r["reason"] == "mass_deletion":
            assert r["deleted_ratio"] >= 0.3 and not r["trusted"]
        if r["reason"] == "":
            assert r["deleted_ratio"] < 0.3 and r["trusted"]


def test_map_health_vectors(spark):
    def health(prev, cur):
        p = spark.createDataFrame([("a.com", u) for u in prev] or [], "domain string, url string")
        c = spark.createDataFrame([("a.com", u) for u in cur] or [], "domain string, url string")
        rows = S.map_health(S.map_diff(p, c)).collect()
        return (rows[0]["trusted"], rows[0]["deleted_ratio"]) if rows else None

    ten = [f"u{i}" for i in range(10)]
    assert health([], ten) == (True, 0.0)
    assert health(ten, []) == (False, 1.0)
    assert health(ten, ten[3:]) == (False, 0.3)
    assert health(ten, ten[2:]) == (True, 0.2)


def test_second_sync_is_idle(spark):
    cur = SN.cur_map(spark, SF001)
    d = S.map_diff(cur, cur)
    assert {r[0] for r in d.select("status").distinct().collect()} == {"unchanged"}
    docs = A.page_docs(E.extract_pages(Q.pages(spark, SF001)))
    diff = A.content_diff(docs, docs)
    assert {r[0] for r in diff.select("status").distinct().collect()} == {"unchanged"}
    eff = S.effective_map(d, S.map_health(d))
    empty_backfill = eff.limit(0).select("domain", "url")
    assert S.fetch_queue(eff, empty_backfill).count() == 0


def test_render_parse_round_trip(spark):
    docs = A.page_docs(E.extract_pages(Q.pages(spark, SF001)))
    parsed = A.parse_page_docs(docs)
    j = docs.alias("d").join(parsed.alias("p"), ["domain", "slug"])
    norm = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
    bad = j.where(
        (F.col("d.title") != F.col("p.title"))
        | (F.col("d.description") != F.col("p.description"))
        | (F.col("d.url") != F.col("p.url"))
        | (norm(F.col("d.summary")) != F.col("p.summary"))
        | (F.col("d.body") != F.col("p.body"))
    )
    assert docs.count() == parsed.count() > 0
    assert bad.count() == 0


def _fold_miss_counter(spark, sf):
    """J4 applied run after run; the candidate table is checkpointed between runs."""
    runs = SN.run_map(spark, sf)
    health = S.run_health(runs)
    rows = []
    cand = spark.createDataFrame(
        [], "domain string, url string, consecutive_misses int, first_missing_at timestamp, last_missing_at timestamp"
    )
    trusted_runs = health.where("trusted").select("domain", "run_id")
    n = runs.agg(F.max("run_id")).collect()[0][0] + 1
    for r in range(n):
        cur = runs.where((F.col("run_id") == r) & F.col("present")).select("domain", "url")
        # last trusted map before run r, per site
        last = trusted_runs.where(F.col("run_id") < r).groupBy("domain").agg(F.max("run_id").alias("run_id"))
        prev = runs.join(last, ["domain", "run_id"]).where("present").select("domain", "url")
        h = health.where(F.col("run_id") == r).select("domain", "trusted")
        out = S.miss_counter(cand, prev, cur, h, f"2026-02-{r + 1:02d} 00:00:00")
        rows += [
            (x["domain"], x["url"], r, x["consecutive_misses"], x["action"] == "delete")
            for x in out.where(F.col("action") != "cleared").collect()
        ]
        cand = out.where(F.col("action") == "pending").select(
            "domain", "url", "consecutive_misses",
            F.to_timestamp("first_missing_at").alias("first_missing_at"),
            F.to_timestamp("last_missing_at").alias("last_missing_at"),
        )
        cand = cand.checkpoint()  # cut lineage between runs (reliable checkpoint dir)
    return sorted(rows)


def test_miss_counter_batch_equals_window(spark):
    window = sorted(
        (x["domain"], x["url"], x["run_id"], x["consecutive_misses"], x["deleted"])
        for x in S.miss_history(SN.run_map(spark, SF001)).collect()
    )
    folded = _fold_miss_counter(spark, SF001)
    assert window == folded
    assert any(d for *_, d in window)  # the fixture reaches a deletion


def test_miss_rule_vectors(spark):
    def history(present, trusted=None):
        rows = [("a.com", "u", i, p) for i, p in enumerate(present)]
        rows += [("a.com", f"pad{k}", i, True) for i in range(len(present)) for k in range(20)]
        rm = spark.createDataFrame(rows, "domain string, url string, run_id int, present boolean")
        got = {x["run_id"]: x["consecutive_misses"] for x in S.miss_history(rm).where("url = 'u'").collect()}
        return [got.get(i, 0) for i in range(len(present))]

    assert history([True, False, False, False]) == [0, 1, 2, 3]
    assert history([True, False, True, False]) == [0, 1, 0, 1]


def test_health_is_checked_against_the_last_trusted_run(spark):
    """Full map, empty map, degraded map: the degraded one is compared with the
    full one, so it is not trusted and counts no miss; a healthy one then is."""
    urls = [f"u{i}" for i in range(10)]
    present = {0: urls, 1: [], 2: urls[:1], 3: urls[:9], 4: urls[:9]}
    rows = [("a.com", u, r, u in have) for r, have in present.items() for u in urls]
    rm = spark.createDataFrame(rows, "domain string, url string, run_id int, present boolean")
    health = {x["run_id"]: (x["n_cached"], x["n_deleted"], x["trusted"]) for x in S.run_health(rm).collect()}
    assert health == {0: (0, 0, True), 1: (10, 10, False), 2: (10, 9, False), 3: (10, 1, True), 4: (9, 0, True)}
    got = {(x["url"], x["run_id"]): x["consecutive_misses"] for x in S.miss_history(rm).collect()}
    assert got == {("u9", 3): 1, ("u9", 4): 2}
