"""Corpus pipeline: quality rules, near-dedup, PII, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``; the last returns one row per piece of
a packed sequence.

Defined cases: null texts count as empty, and the first stage rejects them with
all other texts under 50 words. Null doc_ids, langs and sources are carried; of
rows that repeat doc_id and text one stays; of documents that tie the smallest
doc_id stays (null last). Texts of any length are read whole. An empty table
gives no piece. Extra columns are carried up to the last stage, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagetide.llm import minhash, mixing, packing, pii, quality
from pagetide.llm.common import documents, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that it rejects go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: one document of each group stays."""
    return minhash.dedup(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: personal data becomes marks such as <EMAIL>; n_chars follows."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: each document as many times as the mix takes it."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: pieces of sequences of at most 4096 tokens."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Quality votes, EM and sketches are not expressible in SQL; tests/llm checks
#: run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
