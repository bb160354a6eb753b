"""pagetide — page-corpus analytics as Spark DataFrame jobs.

Layout:
  functions/  Column -> Column expressions (URL keys, text cleanup, HTML fields)
  sources/    table readers and deterministic snapshot relations
  operators/  DataFrame -> DataFrame jobs (inventory, extract, sync, assemble,
              sites, search)
  plans/      vocabularies, the sync driver with versioned sinks, DuckDB oracles
  streaming/  Structured Streaming forms of the sync state machine
"""

from pagetide.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
