"""State-file (S3/S4) and legacy cache (S5) sources, many sites at once."""

import json
import os

from pagetide.sources import state as SS
from pagetide.streaming.snapshots import scratch


def _page(url, title):
    return {"markdown": f"# {title}\n\nbody", "metadata": {"sourceURL": url, "title": title}, "json": {"summary": "s"}}


def _local(path):
    return path[len("file:"):] if path.startswith("file:") else path


def _write(root, site, name, obj):
    root = _local(root)
    os.makedirs(os.path.join(root, site), exist_ok=True)
    with open(os.path.join(root, site, name), "w", encoding="utf-8") as f:
        f.write(obj if isinstance(obj, str) else json.dumps(obj))


def test_state_and_legacy(spark):
    root = scratch(spark, "state")
    _write(root, "a.com", "state.json", {
        "map": {"urls": ["https://a.com/x", " ", "https://a.com/y"], "timestamp": "2026-01-01T00:00:00+00:00"},
        "batches": {
            "b1": {"batch_id": "b1", "urls": ["https://a.com/x"], "status": "completed",
                   "pages": [_page("https://a.com/x", "old")], "timestamp": "2026-01-01T00:00:00+00:00"},
            "b2": {"batch_id": "b2", "urls": ["https://a.com/x"], "status": "completed",
                   "pages": [_page("https://a.com/x", "new")], "timestamp": "2026-01-02T00:00:00+00:00"},
            "b3": {"batch_id": "b3", "urls": ["https://a.com/y"], "status": "failed", "pages": [],
                   "timestamp": "2026-01-02T00:00:00+00:00"},
        },
        "deletion_candidates": {"https://a.com/z": {"consecutive_misses": 2, "first_missing_at": "2026-01-01T00:00:00+00:00",
                                                    "last_missing_at": "2026-01-02T00:00:00+00:00"}},
    })
    _write(root, "b.com", "state.json", "[1, 2, 3]")          # not an object -> empty state
    _write(root, "c.com", "state.json", "{ broken")           # corrupt -> empty state
    _write(root, "a.com", "batch-response.json", {"data": [_page("https://a.com/y", "legacy y")]})
    _write(root, "c.com", "batch-response.json", [_page("https://c.com/q", "legacy q")])

    st = SS.read_state(spark, os.path.join(root, "*", "state.json"))
    assert sorted((r["domain"], r["url"]) for r in st["map"].collect()) == [("a.com", "https://a.com/x"), ("a.com", "https://a.com/y")]
    assert st["candidates"].where("consecutive_misses = 2").count() == 1
    assert st["batches"].count() == 3
    first = SS.state_cached_pages(st["batch_pages"], keep="first").collect()
    latest = SS.state_cached_pages(st["batch_pages"], keep="latest").collect()
    assert [r["page"]["metadata"]["title"] for r in first] == ["old"]       # T3: first batch wins
    assert [r["page"]["metadata"]["title"] for r in latest] == ["new"]     # Decision 4

    legacy = SS.read_legacy_pages(spark, os.path.join(root, "*", "batch-response.json"))
    assert sorted(r["domain"] for r in legacy.collect()) == ["a.com", "c.com"]
    want = st["map"].select("domain", "url")
    both = SS.with_fallback(SS.state_cached_pages(st["batch_pages"]), legacy, want)
    got = {(r["url"], r["source"]) for r in both.collect()}
    assert got == {("https://a.com/x", "state"), ("https://a.com/y", "legacy")}
