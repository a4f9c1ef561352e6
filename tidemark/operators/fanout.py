"""Ingest of a mixed table of payloads: one pass writes the tables of all kinds of filings, what was rejected, and a summary.

Kinds with a key are stored upserts of the touched buckets, in the order of the payloads; kinds without one, rejects and summaries are
written as the part of their batch, in place of what the batch may have written before. So a batch that is run again,
also after it broke off in the middle, leaves the same tables.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.filings import KINDS, TARGETS, checked_filings, count_filings
from tidemark.operators.stored import PART, upsert_stored
from tidemark.sources import store


def ingest_all(raw: DataFrame, root: str, number: int, seq: str = "seq", buckets: int = 16) -> None:
    """Writes a batch of (symbol, kind, json, seq) under root; rows of unknown kinds are not read."""
    # kept by kind, so that a kind's jobs pass over the blocks of the others; given back below
    raw = raw.sortWithinPartitions("kind").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for kind, (keys, policy, _) in TARGETS.items():
            rows, _, ok, rejects = checked_filings(raw.where(F.col("kind") == kind), kind, seq)
            if policy == "append":
                ok.drop("_at").write.mode("overwrite").parquet(f"{root}/{kind}/batch={number}")
            else:
                upsert_stored(f"{root}/{kind}", ok, keys, policy, seq="_at", buckets=buckets)
            told = rejects.select("symbol", "reasons", F.to_json(F.struct(*[c for c in rejects.columns if c not in ("symbol", "reasons", "_at")])).alias("row"))
            told.write.mode("overwrite").parquet(f"{root}/rejects/kind={kind}/batch={number}")
            count_filings(rows, kind).drop("kind").write.mode("overwrite").parquet(f"{root}/summary/kind={kind}/batch={number}")
    finally:
        raw.unpersist()


def ingest_batches(root: str, seq: str = "seq", buckets: int = 16):
    """ingest_all as a foreachBatch function."""
    return lambda batch, number: ingest_all(batch, root, number, seq, buckets)


def read_kind(spark: SparkSession, root: str, kind: str) -> DataFrame | None:
    """What is stored of a kind; None before its first row."""
    path = f"{root}/{kind}"
    return spark.read.parquet(path).drop(PART, "batch") if kind in KINDS and store.exists(spark, path) else None


def ingest_report(spark: SparkSession, root: str) -> DataFrame:
    """(kind, rows_read, undated, rejected, stored) over all batches, a row for each kind."""
    parts = spark.read.option("basePath", f"{root}/summary").parquet(f"{root}/summary")
    read = parts.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("rows_read", "undated", "rejected")])
    stored = None
    for kind in KINDS:
        rows = read_kind(spark, root, kind)
        if rows is not None:
            one = rows.agg(F.count("*").alias("stored")).withColumn("kind", F.lit(kind))
            stored = one if stored is None else stored.unionByName(one)
    return read if stored is None else read.join(stored, "kind", "left").fillna(0, ["stored"])
