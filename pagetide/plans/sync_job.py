"""The sync job: one run over every site, with its state kept as Parquet (K3-K9).

State lives in a folder on shared storage:

  <root>/<table>/run_id=<n>   what run n changed, of these tables:
      map          (domain, url, seq)           maps of the sites whose map changed
      candidates   (domain, url, misses, ...)    pending deletions of the run's sites
      page_cache   (domain, url, slug, ...)      fetched pages, and URLs that went
      batches      (domain, chunk, batch_id, urls, n_urls, status, ts)
      run          the run's log rows, one per site (K7), written last
  <root>/docs/bucket=<k>      page documents by hash of (domain, slug) (K3)

A run writes only what it changes. Tables by run are read as the latest row per
key; only runs in the log count, so what a crashed run left is invisible, and
repeating the run replaces its folders. Documents are replaced bucket by bucket
(dynamic partition overwrite): buckets without a change keep their files. A run
that died after its documents is repeated like any other; documents that it had
written already then count as unchanged.

A run renders only the documents it can change: those of the slugs of fetched
and of removed pages.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.operators import assemble as A
from pagetide.operators import extract as E
from pagetide.operators import sites as ST
from pagetide.operators import sync as S
from pagetide.functions.text import nullif_blank
from pagetide.functions.urls import batch_id_agg, drop_query, py_strip, url_slug, with_url_keys
from pagetide.session import written

MAP_SCHEMA = "domain string, url string, seq bigint"
CAND_SCHEMA = (
    "domain string, url string, consecutive_misses int, first_missing_at timestamp, last_missing_at timestamp"
)
BATCH_SCHEMA = (
    "domain string, chunk int, batch_id string, urls array<string>, n_urls bigint, status string, ts timestamp"
)
PAGE_SCHEMA = T.StructType(
    [
        T.StructField("domain", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("markdown", T.StringType()),
        T.StructField(
            "metadata",
            T.StructType([T.StructField(n, T.StringType()) for n in ("sourceURL", "ogUrl", "title", "description", "ogDescription")]),
        ),
        T.StructField("json", T.StructType([T.StructField(n, T.StringType()) for n in ("title", "description", "summary")])),
    ]
)
DOC_SCHEMA = (
    "domain string, slug string, url string, seq bigint, title string, description string, summary string, "
    "body string, content string, content_sha string"
)
#: Columns of the page cache beside the page's own; ``gone``: the URL was removed.
CACHE_SCHEMA = T.StructType([*PAGE_SCHEMA.fields, T.StructField("slug", T.StringType()), T.StructField("blank", T.BooleanType()), T.StructField("gone", T.BooleanType())])
CACHE_KEYS = ("domain", "url", "seq", "slug", "blank")
BUCKETS = 64


@dataclass(frozen=True)
class RunOptions:
    run_id: int
    run_ts: str
    force: bool = False                # refetch every URL of the map, compared with nothing: no miss is counted
    rebuild: bool = False              # drop cached pages and documents first; implies force
    allow_mass_deletion: bool = False  # override the 30 % guard
    cache_only: bool = False           # re-render from cached pages; no map, no fetch
    dry_run: bool = False              # preview only (A4); nothing is written
    max_pages: int | None = None       # per-site cap on fetched URLs
    batch_size: int = S.BATCH_SIZE

    def __post_init__(self):
        if self.cache_only and (self.force or self.rebuild or self.dry_run):
            raise ValueError("cache_only excludes force, rebuild and dry_run")
        if self.rebuild:
            object.__setattr__(self, "force", True)
        dt.datetime.fromisoformat(self.run_ts)  # fail here, not in a job


RUN_LOG_SCHEMA = (
    "run_id int, run_ts string, domain string, status string, trusted boolean, reason string, "
    "urls_discovered bigint, new_urls bigint, queued bigint, fetched bigint, deleted bigint, added bigint, updated bigint, "
    "unchanged bigint, total bigint, credits bigint"
)


_TYPES = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def _struct(columns: str) -> T.StructType:
    """A schema of plain columns, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


TABLES = {
    "map": _struct(MAP_SCHEMA), "candidates": _struct(CAND_SCHEMA), "page_cache": CACHE_SCHEMA,
    "batches": _struct(BATCH_SCHEMA), "run": _struct(RUN_LOG_SCHEMA),
}


class CorpusStore:
    """The state of all runs under ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        for name, schema in TABLES.items():  # so that every table can be read
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.root}/{name}/run_id=-1")
        spark.createDataFrame([], DOC_SCHEMA).write.mode("ignore").parquet(f"{self.root}/docs/bucket=0")

    # -- tables by run ----------------------------------------------------------
    def write(self, table: str, run_id: int, df: DataFrame, *observed) -> DataFrame:
        """Write what run ``run_id`` changed of ``table``; reads it back."""
        path = f"{self.root}/{table}/run_id={run_id}"
        schema = TABLES[table]
        out = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        for observation, values in observed:
            out = out.observe(observation, *values)
        out.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def changes(self, table: str) -> DataFrame:
        """Rows of all runs in the log, with their ``run_id``."""
        schema = T.StructType([*TABLES[table].fields, *([] if table == "run" else [T.StructField("run_id", T.IntegerType())])])
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{table}")
        return rows.where(F.col("run_id").isin(self.runs())) if table != "run" else rows.where("run_id >= 0")

    def runs(self) -> list[int]:
        return sorted(r["run_id"] for r in self.changes("run").select("run_id").distinct().collect())

    def run_log(self) -> DataFrame:
        """K7: log rows of every finished run."""
        return self.changes("run").select(*TABLES["run"].fieldNames())

    def _of_last_run(self, table: str) -> DataFrame:
        """Per site the rows of the last run that wrote it; a row without URL
        only says that the run did."""
        rows = self.changes(table)
        last = rows.groupBy("domain").agg(F.max("run_id").alias("run_id"))
        return rows.join(last, ["domain", "run_id"]).where(F.col("url").isNotNull()).select(*TABLES[table].fieldNames())

    def map(self) -> DataFrame:
        """K4: the last trusted map of every site."""
        return self._of_last_run("map")

    def candidates(self) -> DataFrame:
        return self._of_last_run("candidates")

    def batches(self) -> DataFrame:
        return self.changes("batches").drop("run_id")

    def cached_keys(self) -> DataFrame:
        """(domain, url, seq, slug, blank, run_id) of every cached page: no text is read."""
        rows = self.changes("page_cache").select(*CACHE_KEYS, "gone", "run_id")
        last = F.max_by(F.struct("seq", "slug", "blank", "gone", "run_id"), "run_id").alias("p")
        found = rows.groupBy("domain", "url").agg(last).where("not p.gone")
        return found.select("domain", "url", "p.seq", "p.slug", "p.blank", "p.run_id")

    def cached_pages(self, keys: DataFrame) -> DataFrame:
        """The pages of ``keys`` (domain, url, run_id)."""
        rows = self.changes("page_cache").where("not gone")
        return rows.join(keys.select("domain", "url", "run_id"), ["domain", "url", "run_id"], "left_semi").select(*PAGE_SCHEMA.fieldNames())

    # -- documents ----------------------------------------------------------------
    def docs(self) -> DataFrame:
        return self._buckets().drop("bucket")

    def _buckets(self) -> DataFrame:
        schema = _struct(DOC_SCHEMA).add("bucket", T.IntegerType())
        # a row without a slug only keeps a bucket that ran empty
        return self.spark.read.schema(schema).parquet(f"{self.root}/docs").where(F.col("slug").isNotNull())

    def upsert_docs(self, changed: DataFrame, removed: DataFrame) -> None:
        """K3: replace the documents of ``changed``, drop those of ``removed``
        (domain, slug); only buckets that hold one of them are written."""
        bucket = F.pmod(F.xxhash64("domain", "slug"), F.lit(self.buckets)).cast("int").alias("bucket")
        rows = changed.select(*A.PAGE_DOC_COLUMNS, bucket)
        keys = rows.select("domain", "slug", "bucket").unionByName(removed.select("domain", "slug", bucket))
        touched = sorted(r["bucket"] for r in keys.select("bucket").distinct().collect())  # no more than buckets
        if not touched:
            return
        # pruned to the touched folders, whose files stay until the new ones are complete
        kept = self._buckets().where(F.col("bucket").isin(touched)).join(keys.select("domain", "slug"), ["domain", "slug"], "left_anti")
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in _struct(DOC_SCHEMA)]
        marks = self.spark.createDataFrame([(b,) for b in touched], "bucket int").select(*empty, "bucket")
        merged = kept.unionByName(rows).unionByName(marks).repartition(len(touched), "bucket")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/docs")


def _chunk_batches(queue: DataFrame, obtained: DataFrame, run_ts: str, size: int) -> DataFrame:
    """K6: batch records of the queue, chunks of ``size``: the URLs of a chunk
    whose page was obtained as ``completed``, the others as ``failed``."""
    got = obtained.select("domain", "url", F.lit("completed").alias("status"))
    c = queue.withColumn("chunk", F.floor((F.col("queue_pos") - 1) / size).cast("int"))
    c = c.join(got, ["domain", "url"], "left").withColumn("status", F.coalesce("status", F.lit("failed")))
    g = c.groupBy("domain", "chunk", "status").agg(
        batch_id_agg("url").alias("batch_id"),
        F.array_sort(F.collect_list("url")).alias("urls"),
        F.count(F.lit(1)).alias("n_urls"),
    )
    return g.select("domain", "chunk", "batch_id", "urls", "n_urls", "status", F.to_timestamp(F.lit(run_ts)).alias("ts"))


def _canonical(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``key``: the URL as discovery writes it (https, no query or fragment)."""
    return with_url_keys(df, url, nurl="_n").withColumn("key", drop_query(F.col("_n"))).drop("_n")


def lookup_pages(queue: DataFrame, pages: DataFrame) -> DataFrame:
    """The queued URLs' pages as ``(page_id, url, html)``, ``url`` being the
    queued one: the page of exactly this URL, else the latest page of the same
    canonical URL. Picks on keys; ``html`` joins only the pages picked."""
    want = _canonical(queue.select("domain", "url")).select(F.col("url").alias("want"), "key").distinct()
    have = _canonical(pages.select("page_id", "url")).select("page_id", "url", "key")
    best = F.max_by(F.struct("page_id", "url"), F.struct((F.col("url") == F.col("want")).alias("same"), "page_id"))
    picked = have.join(want, "key").groupBy("want").agg(best.alias("p")).select("want", "p.page_id", F.col("p.url").alias("url"))
    html = pages.select("page_id", "url", "html").dropDuplicates(["page_id", "url"])
    return html.join(picked, ["page_id", "url"]).select("page_id", F.col("want").alias("url"), "html")


def winners(keys: DataFrame) -> DataFrame:
    """Decision 6 on keys alone: per (domain, slug) the last page in list order
    that is not blank."""
    last = F.max_by(F.struct(*[c for c in keys.columns if c not in ("domain", "slug")]), F.struct("seq", "url"))
    found = keys.where("not blank").groupBy("domain", "slug").agg(last.alias("w"))
    return found.select("domain", "slug", "w.*")


def sync(
    spark: SparkSession,
    store: CorpusStore,
    new_map: DataFrame,
    pages: DataFrame,
    opts: RunOptions,
    sites: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """One run for every site: diff, guard, count misses, fetch what is
    missing, render, delete what is confirmed gone, write the changes.

    ``new_map``: ``(domain, url, seq)`` from discovery (E5 or a map table);
    ``pages``: raw ``(page_id, url, html)``, looked up by ``lookup_pages`` — only
    queued URLs are extracted, once: they are written first, and documents and
    log are built from those files.
    ``sites``: ``(domain)`` of the sites to run (default: those of either map);
    a site without any URL gets a log row, and other sites keep their state.
    Returns the run's report tables (already written unless ``dry_run``).
    """
    # a repeated run_id is a replay after a failure: the finished run wins
    if opts.run_id in store.runs():
        raise RuntimeError(f"run {opts.run_id} is already committed")
    prev_map, candidates, cache = store.map(), store.candidates(), store.cached_keys()
    if sites is not None:
        sites = sites.select("domain").distinct()
        prev_map, candidates, new_map = (x.join(sites, "domain", "left_semi") for x in (prev_map, candidates, new_map))
    dropped = cache.limit(0)
    if opts.rebuild:
        chosen = sites if sites is not None else prev_map.select("domain").union(new_map.select("domain")).distinct()
        dropped = cache.join(chosen, "domain", "left_semi")
        cache = cache.join(chosen, "domain", "left_anti")

    if opts.cache_only:
        # S7 + Decision 4: newest cached copy of every URL of the stored map
        effective = prev_map.select("domain", "url", F.lit("unchanged").alias("status"), F.lit(True).alias("trusted"))
        health = prev_map.select("domain").distinct().select(
            "domain", F.lit(None).cast("bigint").alias("n_cached"), F.lit(None).cast("bigint").alias("n_new"),
            F.lit(None).cast("bigint").alias("n_deleted"), F.lit(None).cast("double").alias("deleted_ratio"),
            F.lit(True).alias("trusted"), F.lit("cache_only").alias("reason"),
        )
        gone = candidates.limit(0).select("domain", "url")
        queue = effective.limit(0).select("domain", "url", F.lit("").alias("kind"), F.lit(0).alias("queue_pos"))
    else:
        # a forced run is compared with nothing: every URL is new, none is missed
        diff = S.map_diff(prev_map.limit(0) if opts.force else prev_map, new_map)
        health = S.map_health(diff, allow_mass_deletion=opts.allow_mass_deletion)
        if sites is not None:
            none = F.lit(0).cast("bigint")
            health = health.unionByName(sites.join(health, "domain", "left_anti").select(
                "domain", none.alias("n_cached"), none.alias("n_new"), none.alias("n_deleted"),
                F.lit(1.0).alias("deleted_ratio"), F.lit(False).alias("trusted"), F.lit("empty_map").alias("reason"),
            ))
        effective = S.effective_map(diff, health)
        counter = S.miss_counter(candidates, prev_map, new_map, health, opts.run_ts, count=not opts.force)
        gone = counter.where(F.col("action") == "delete").select("domain", "url")
        backfill = S.backfill_urls(effective, cache)
        queue_all = S.fetch_queue(effective, backfill, seq=new_map, force=opts.force)
        queue = queue_all if opts.max_pages is None else queue_all.where(F.col("queue_pos") <= opts.max_pages)
        if opts.dry_run:
            preview = ST.dry_run_preview(effective, backfill, force=opts.force, max_pages=opts.max_pages)
            return {"preview": preview, "health": health, "queue": queue}

    # work avoidance: only queued URLs are extracted
    found = None if opts.cache_only else lookup_pages(queue, pages)
    fresh = None if found is None else E.extract_pages(found)
    fetched_rows = _cache_rows(fresh) if fresh is not None else spark.createDataFrame([], CACHE_SCHEMA)
    out = dropped.select("domain", "url").unionByName(gone).distinct()
    if found is not None:
        out = out.join(E.keyed_pages(found.select("page_id", "url")).select("domain", "url"), ["domain", "url"], "left_anti")
    fetched_count = Observation("fetched")
    count = F.count_if(~F.col("gone")).alias("n")
    written = store.write("page_cache", opts.run_id, fetched_rows.unionByName(_gone_rows(out)), (fetched_count, [count]))
    fresh = written.where("not gone")
    n_fresh = fetched_count.get["n"]

    docs = _write_docs(store, opts, cache, dropped, fresh, gone, prev_map if opts.cache_only else None)
    report = docs["report"]
    # only pages that were obtained count as fetched, and are paid for
    fetched = fresh.groupBy("domain").agg(F.count(F.lit(1)).alias("fetched"))
    queued = queue.groupBy("domain").agg(F.count(F.lit(1)).alias("queued"))
    credits = (
        F.lit(0) if opts.cache_only
        else F.when((F.coalesce("fetched", F.lit(0)) == 0) & F.lit(not opts.force), F.lit(ST.COST_MAP))
        .otherwise(ST.COST_MAP + ST.COST_PER_PAGE * F.coalesce("fetched", F.lit(0)))
    )
    eff_counts = effective.groupBy("domain").agg(
        F.count_if(F.col("status") != "deleted").alias("urls_discovered"),
        F.count_if(F.col("status") == "new").alias("new_urls"),
    )
    n_gone = gone.groupBy("domain").agg(F.count(F.lit(1)).alias("deleted"))
    log = (
        health.select("domain", "trusted", "reason")
        .join(eff_counts, "domain", "left").join(fetched, "domain", "left").join(queued, "domain", "left").join(n_gone, "domain", "left")
        .join(report, "domain", "left")
    )
    # K8: per-site guards; the job fails only when every site fails
    status = (
        F.when((F.col("reason") == "empty_map") & (F.coalesce("urls_discovered", F.lit(0)) == 0), "error_empty_map")
        .when(F.coalesce("total", F.lit(0)) == 0, "error_no_pages")
        .otherwise("ok")
    )
    log = log.select(
        F.lit(opts.run_id).alias("run_id"), F.lit(opts.run_ts).alias("run_ts"), "domain", status.alias("status"),
        "trusted", "reason",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in
          ("urls_discovered", "new_urls", "queued", "fetched", "deleted", "added", "updated", "unchanged", "total")],
        credits.cast("bigint").alias("credits"),
    ).checkpoint()
    if not log.isEmpty() and log.where(F.col("status") == "ok").isEmpty():
        raise RuntimeError("every site failed its guards; the run is not logged")
    if not opts.cache_only:
        ran = health.select("domain")
        # K4: trusted sites whose map changed take the new one, the others keep theirs
        moved = effective.where(F.col("trusted") & (F.col("status") != "unchanged")).select("domain").distinct()
        if opts.force:
            moved = health.where("trusted").select("domain")
        taken = new_map.select("domain", "url", "seq").join(moved, "domain", "left_semi")
        pending = counter.where(F.col("action") == "pending").select(
            "domain", "url", "consecutive_misses",
            F.to_timestamp("first_missing_at").alias("first_missing_at"), F.to_timestamp("last_missing_at").alias("last_missing_at"),
        )
        store.write("map", opts.run_id, taken.unionByName(moved, allowMissingColumns=True))
        store.write("candidates", opts.run_id, pending.unionByName(ran, allowMissingColumns=True))
        store.write("batches", opts.run_id, _chunk_batches(queue, fresh, opts.run_ts, opts.batch_size))
    log = store.write("run", opts.run_id, log)
    return {"report": report, "health": health, "log": log, "docs": store.docs(), "changed": docs["changed"], "fetched": n_fresh}


def _cache_rows(pages: DataFrame) -> DataFrame:
    """Extracted pages as cache rows: with the slug of their document, and
    whether they are blank (P2)."""
    url = F.coalesce(nullif_blank(F.col("metadata.sourceURL")), nullif_blank(F.col("metadata.ogUrl")), F.lit(""))
    return pages.select(
        *PAGE_SCHEMA.fieldNames(), url_slug(url).alias("slug"), (py_strip(F.coalesce("markdown", F.lit(""))) == "").alias("blank"), F.lit(False).alias("gone")
    )


def _gone_rows(keys: DataFrame) -> DataFrame:
    null = [F.lit(None).cast(f.dataType).alias(f.name) for f in CACHE_SCHEMA if f.name not in ("domain", "url", "gone")]
    return keys.select("domain", "url", *null, F.lit(True).alias("gone"))


def _write_docs(store, opts, cache, dropped, fresh, gone, live_map) -> dict[str, DataFrame]:
    """Render and write the documents that the run changes; report per site."""
    fresh_keys = fresh.select(*CACHE_KEYS).withColumn("run_id", F.lit(opts.run_id))
    live = cache.join(fresh.select("domain", "url"), ["domain", "url"], "left_anti").join(gone, ["domain", "url"], "left_anti")
    live = live.unionByName(fresh_keys)
    if live_map is not None:  # cache-only: every document is rendered anew
        live = live.join(live_map.select("domain", "url"), ["domain", "url"], "left_semi")
        affected = live.select("domain", "slug").unionByName(store.docs().select("domain", "slug"))
    else:
        left = cache.join(gone, ["domain", "url"], "left_semi").unionByName(dropped)
        affected = fresh_keys.select("domain", "slug").unionByName(left.select("domain", "slug"))
        # a rebuild also drops documents whose page is not cached any more
        if opts.rebuild:
            affected = affected.unionByName(store.docs().join(dropped.select("domain").distinct(), "domain", "left_semi").select("domain", "slug"))
    affected = written(affected.distinct(), "affected")
    chosen = written(winners(live.join(affected, ["domain", "slug"], "left_semi")), "winners")
    own = chosen.where(F.col("run_id") == opts.run_id)
    pages = fresh.select(*PAGE_SCHEMA.fieldNames()).join(own.select("domain", "url"), ["domain", "url"], "left_semi")
    pages = pages.unionByName(store.cached_pages(chosen.where(F.col("run_id") != opts.run_id)))
    rendered = A.render(A.resolve_fields(pages)).where("not _blank").select(*A.PAGE_DOC_COLUMNS)
    stored = store.docs().select("domain", "slug", "content_sha").join(affected, ["domain", "slug"], "left_semi")
    stored = written(stored, "stored")
    status = F.when(F.col("_sha").isNull(), "added").when(F.col("_sha") == F.col("content_sha"), "unchanged").otherwise("updated")
    known = stored.select("domain", "slug", F.col("content_sha").alias("_sha"))
    # rendered once: what is not unchanged goes into the buckets
    diffed = written(rendered.join(known, ["domain", "slug"], "left").withColumn("status", status).drop("_sha").where("status <> 'unchanged'"), "changed")
    removed = stored.join(chosen, ["domain", "slug"], "left_anti").select("domain", "slug")
    removed = written(removed, "removed")
    store.upsert_docs(diffed, removed)
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = diffed.groupBy("domain").agg(n("added"), n("updated"))
    total = store.docs().groupBy("domain").agg(F.count(F.lit(1)).alias("total"))
    zero = F.lit(0).cast("bigint")
    report = total.join(counts, "domain", "left").withColumns({"added": F.coalesce("added", zero), "updated": F.coalesce("updated", zero)})
    report = report.withColumn("unchanged", F.col("total") - F.col("added") - F.col("updated"))
    return {"report": report.select("domain", "added", "updated", "unchanged", "total"), "changed": diffed.select("domain", "slug", "url", "status")}
