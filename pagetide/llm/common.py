"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.session import checkpoint_dir, ship_package

#: White space and word of the contracts (ASCII white space only).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder named by ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage: later stages re-read files that survive a lost executor.
    """
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove materialized tables whose readers have all been written."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def releasing(rows):
    """``rows``, and at their end the memory that a worker holds but does not use
    goes back: idle workers live on beside the next stage's."""
    import ctypes

    import pyarrow as pa

    try:
        yield from rows
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def python_ready(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers."""
    ship_package(spark)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def split_words(text: Column) -> Column:
    """ASCII-white-space words of ``text`` as an array (empty for no word)."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def re_literal(pattern: str) -> str:
    """``pattern`` as a SQL string literal (backslashes kept)."""
    return "r'" + pattern.replace("'", "\\x27") + "'"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def regex_spans(text: Column, pattern: Column, fields, schema: str, keep=None) -> Column:
    """Matches of ``pattern`` in ``text`` as an array of structs.

    ``fields(start, stop, hit, before, after)`` makes a struct's columns, in
    the order of ``schema``; positions are code points, ``before`` and
    ``after`` the text up to the neighbouring matches. ``pattern`` must not
    match the empty string; matches of which ``keep(hit)`` is not true are
    passed over.
    """

    def place(found):
        def walk(gaps):
            def step(acc, m):
                start = (acc["at"] + F.char_length(m["gap"])).cast("long")
                stop = (start + F.char_length(m["hit"])).cast("long")
                row = F.array(F.struct(*fields(start, stop, m["hit"], m["gap"], m["next"]))).cast(schema)
                more = F.concat(acc["out"], row)
                if keep is not None:
                    more = F.when(keep(m["hit"]), more).otherwise(acc["out"])
                return F.struct(stop.alias("at"), more.alias("out"))

            n = F.size(found)
            sides = F.zip_with(
                F.slice(gaps, F.lit(1), n), F.slice(gaps, F.lit(2), n), lambda g, x: F.struct(g.alias("gap"), x.alias("next"))
            )
            matches = F.zip_with(
                sides, found, lambda s, h: F.struct(s["gap"].alias("gap"), s["next"].alias("next"), h.alias("hit"))
            )
            zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(schema).alias("out"))
            return F.aggregate(matches, zero, step, lambda acc: acc["out"])

        return F.when(F.size(found) == 0, F.array().cast(schema)).otherwise(let(F.split(text, pattern, -1), walk))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), place)
