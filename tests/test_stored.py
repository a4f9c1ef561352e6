"""Stored upserts: every policy equals merge_into, only touched buckets are written, a repeated batch changes nothing."""

import os
import random

import pytest

from tidemark.operators import merge, stored

SCHEMA = "k int, g string, v string, w double, seq int"


def batches(seed):
    rng = random.Random(seed)
    row = lambda s: (rng.choice([None, *range(12)]), rng.choice(["a", "b"]), rng.choice([None, "None", "x", "y"]), rng.choice([None, 1.0, 2.0]), s)
    return [[row(s) for s in range(rng.randint(0, 15))] for _ in range(4)]


@pytest.mark.parametrize("policy", ["replace", "coalesce", "insert", "fill", "columns"])
def test_policies_equal_the_merge_of_whole_tables(spark, tmp_path, policy):
    keys, columns = ["k", "g"], ["w"] if policy == "columns" else None
    table = spark.createDataFrame([], SCHEMA).drop("seq")
    for i, rows in enumerate([[(1, "a", None, None, 0)], *batches(3)]):
        batch = spark.createDataFrame(rows, SCHEMA)
        table = spark.createDataFrame(merge.merge_into(table, batch, keys, policy, columns, "seq").collect(), table.schema)
        for _ in range(2 if i == 2 else 1):
            stored.upsert_stored(str(tmp_path / "t"), batch, keys, policy, columns, "seq", buckets=5)
        assert sorted(map(str, stored.read_stored(spark, str(tmp_path / "t")).collect())) == sorted(map(str, table.collect()))


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    stored.upsert_stored(path, spark.range(1000).selectExpr("id AS k", "'old' AS v"), ["k"], buckets=20)
    before = files(path)
    one = spark.createDataFrame([(7, "new")], "k long, v string")
    (bucket,) = stored.upsert_stored(path, one, ["k"], buckets=20)
    changed = before ^ files(path)
    assert changed and all(f"key_bucket={bucket}/" in f for f in changed) and len(before) == 20
    assert stored.upsert_stored(path, one.limit(0), ["k"], buckets=20) == []
    got = {r.k: r.v for r in stored.read_stored(spark, path).collect()}
    assert len(got) == 1000 and [k for k, v in got.items() if v == "new"] == [7]


def test_upsert_stream_into_a_stored_table(spark, tmp_path):
    from tidemark.streaming import jobs

    schema = "k int, v string, seq int"
    for i, rows in enumerate([[(1, "a", 1), (1, "b", 2), (2, "x", 1)], [(2, "y", 3), (3, "z", 4)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(jobs.upsert_batches(str(tmp_path / "t"), ["k"])).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, stored.read_stored(spark, str(tmp_path / "t")).collect())) == [(1, "b"), (2, "y"), (3, "z")]
