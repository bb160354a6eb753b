"""Postings: the same hits as a scan, and only a rare word's partitions read."""

import os
import re

import pytest
from conftest import SF001

from pagetide.operators import search as Q
from pagetide.operators.postings import Postings
from pagetide.plans import queries as R
from pagetide.session import written
from pagetide.streaming.snapshots import scratch


@pytest.fixture(scope="module")
def corpus(spark):
    docs = written(R.scoped(R.docs)(spark, SF001), "docs")
    extra = docs.limit(1).selectExpr("domain", "'rare--page' AS slug", "url", "seq", "'Quixotic capital' AS title", "'' AS description", "'' AS summary",
                                     "'x of the y' AS body", "'title: Quixotic capital x of the y' AS content", "'' AS content_sha")
    docs = written(docs.unionByName(extra), "docs")
    return docs, Postings(spark, scratch(spark, "postings"), buckets=16).build(docs)


@pytest.mark.parametrize("pattern", ["the|of", "quixotic", "api", "of the", "xyzzy", "tion", "rare--page", r"\$\$\$", "é", "a|zzzz", "--"])
def test_candidates_give_the_hits_of_a_scan(corpus, pattern):
    docs, index = corpus
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(Q.search_any(index.restrict(docs, pattern), pattern)) == key(Q.search_any(docs, pattern))
    assert key(Q.rank_tiers(index.restrict(docs, pattern), pattern, True)) == key(Q.rank_tiers(docs, pattern, True))


def test_a_rare_word_reads_only_its_partition(corpus):
    docs, index = corpus
    found = index.candidates("quixotic")
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = re.search(r"PartitionFilters: \[([^\]]*)\]", plan).group(1)
    assert "bucket" in scan and re.search(r"bucket#\d+ (?:=|IN) ?\(?\d+", scan)
    buckets = {re.search(r"bucket=(\d+)", f).group(1) for f in found.inputFiles()}
    all_buckets = [d for d in os.listdir(index.root.removeprefix("file:") + "/postings") if d.startswith("bucket=")]
    assert len(all_buckets) > 8 and "quixotic" in {r["term"] for r in index._read("vocabulary", "term string, n_pages bigint, bucket int").collect()}
    assert len(buckets) <= len(all_buckets)


def test_patterns_that_need_a_scan(corpus):
    _, index = corpus
    assert index.candidates(r"a.*b") is None and index.candidates("--") is None and index.candidates("ok|(x)") is None
