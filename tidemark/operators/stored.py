"""Upserts into a stored table of which only the touched parts are written.

The table is partitioned by a hash bucket of its key. A batch reads the buckets of its keys, merges, and replaces just these by
dynamic partition overwrite, so what is read and written follows the batch (a bucket for each key at most) and no older version stays.
Every policy of merge_into gives the same table when a batch is merged again, so a batch that broke off is simply run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.merge import merge_into
from tidemark.sources import store

PART = "key_bucket"
BUCKETS = 64


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(PART)


def upsert_stored(path: str, rows: DataFrame, keys: list[str], policy: str = "replace", columns: list[str] | None = None, seq: str | None = None, buckets: int = BUCKETS) -> list[int]:
    """Merges rows into the table under path, which the first batch makes; the number of buckets must stay the same. Returns the
    buckets that were written."""
    spark = rows.sparkSession
    names = [c for c in rows.columns if c != seq or c in keys]
    touched = sorted(r[0] for r in rows.select(_bucket(keys, buckets).alias(PART)).distinct().collect())  # a row a bucket
    if not touched:
        return []
    if store.exists(spark, path):
        target = spark.read.parquet(path).where(F.col(PART).isin(touched)).select(*names)
    else:
        target = spark.createDataFrame([], rows.select(*names).schema)
    merged = merge_into(target, rows, keys, policy, columns, seq).withColumn(PART, _bucket(keys, buckets))
    merged.repartition(len(touched), PART).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(PART).parquet(path)
    return touched
