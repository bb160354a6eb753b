"""Distributed positions against sorting, and their plan."""

import random

import pytest
from pyspark.sql import functions as F

from pagetide.operators.rank import positions


@pytest.fixture(autouse=True)
def many_partitions(spark):
    # small tables would be coalesced to one partition
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows_of(seed, n, hot):
    rnd = random.Random(seed)
    return [(rnd.choice(["hot"] * hot + ["a", "b", None, "c"]), rnd.choice([None, *range(n)]), f"u{rnd.randint(0, n)}") for _ in range(n)]


@pytest.mark.parametrize("seed,n,hot", [(1, 500, 0), (2, 4000, 8), (3, 1, 0), (4, 3000, 1000)])
def test_positions_equal_sorting(spark, seed, n, hot):
    rows = rows_of(seed, n, hot)
    df = spark.createDataFrame(rows, "site string, seq long, url string").repartition(5)
    got = positions(df, ["site"], [F.asc_nulls_last("seq"), F.desc("url")]).collect()
    want = {}
    for site in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == site), key=lambda r: r[2], reverse=True)
        mine = sorted(mine, key=lambda r: (r[1] is None, r[1] or 0))
        want[site] = [(seq, url, i) for i, (_, seq, url) in enumerate(mine, 1)]
    have = {}
    for site, seq, url, pos in got:
        have.setdefault(site, []).append((seq, url, pos))
    assert {k: sorted(v, key=lambda x: x[2]) for k, v in have.items()} == want


def test_rows_that_tie_spread_over_partitions(spark):
    df = spark.range(0, 4000, 1, 4).select(F.lit("one").alias("site"), F.lit(1).alias("x"))
    got = positions(df, ["site"], [F.asc("x")])
    assert sorted(r["pos"] for r in got.collect()) == list(range(1, 4001))
    assert got.columns == ["site", "x", "pos"]
    held = spark.read.parquet(got.inputFiles()[0].rsplit("/", 1)[0]).groupBy("_part").count().collect()
    assert len(held) > 1 and max(r["count"] for r in held) < 4000


def test_empty_table(spark):
    assert positions(spark.createDataFrame([], "site string, url string"), ["site"], [F.asc("url")]).collect() == []


def test_no_window_over_a_whole_group(spark):
    df = spark.createDataFrame(rows_of(5, 300, 3), "site string, seq long, url string")
    plan = positions(df, ["site"], [F.asc("url")])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window" in line]
    assert windows and all("_part" in w for w in windows)
