"""Staged builds: a stop at any place, a crash before the ledger's word, new versions, and the document index by stages."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import indexing as ix
from tidemark.operators import staged as sg
from tidemark.sources import store


def lines(docs):
    return docs.select("doc_id", F.posexplode(F.split("text", "\\|")).alias("i", "line"))


STAGES = {
    "lines": (None, lines),
    "counts": ("lines", lambda rows: rows.groupBy("doc_id").agg(F.count("*").alias("n"))),
    "long": ("lines", lambda rows: rows.where("length(line) > 2").groupBy("doc_id").agg(F.max("line").alias("x"))),
}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, version string")


def tables(spark, root, docs):
    return {n: sorted(map(tuple, sg.read_stage(spark, root, n, docs).collect())) for n in STAGES}


ROWS = [(1, "a|bb|ccc", "1"), (2, "x", "1"), (3, "dddd|e", "1"), (None, "no id", "1")]


@pytest.fixture(scope="module")
def unbroken(spark):
    root = store.new_path(spark, "staged")
    docs = frame(spark, ROWS)
    assert sg.build(spark, root, docs, STAGES) == {"lines": 3, "counts": 3, "long": 3}
    assert sg.build(spark, root, docs, STAGES) == {"lines": 0, "counts": 0, "long": 0}
    return tables(spark, root, docs)


@pytest.mark.parametrize("stop", ["lines", "counts"])
def test_a_build_goes_on_after_a_stage(spark, unbroken, stop):
    root, docs = store.new_path(spark, "staged"), frame(spark, ROWS)
    sg.build(spark, root, docs.where("doc_id < 3"), STAGES)
    sg.build(spark, root, docs, STAGES, until=stop)
    done = sg.build(spark, root, docs, STAGES)
    assert done["lines"] == 0 and done["long"] == 1
    assert tables(spark, root, docs) == unbroken


@pytest.mark.parametrize("crash", ["lines", "counts", "long"])
def test_rows_without_the_ledger_s_word_don_t_count(spark, unbroken, crash, monkeypatch):
    root, docs, commit = store.new_path(spark, "staged"), frame(spark, ROWS), sg._commit

    def broken(done, path):
        if f"/{crash}/" in path:
            raise OSError("lost")
        commit(done, path)

    monkeypatch.setattr(sg, "_commit", broken)
    with pytest.raises(OSError):
        sg.build(spark, root, docs, STAGES)
    assert sg.read_stage(spark, root, crash, docs) is None
    monkeypatch.setattr(sg, "_commit", commit)
    sg.build(spark, root, docs, STAGES)
    assert tables(spark, root, docs) == unbroken


def test_a_new_version_replaces_the_old_rows(spark, unbroken):
    root, docs = store.new_path(spark, "staged"), frame(spark, ROWS)
    sg.build(spark, root, docs, STAGES)
    newer = frame(spark, [(1, "zz", "2"), *ROWS[1:]])
    assert sg.build(spark, root, newer, STAGES) == {"lines": 1, "counts": 1, "long": 1}
    got = tables(spark, root, newer)
    assert [r for r in got["lines"] if r[0] == 1] == [(1, 0, "zz")] and [r[0] for r in got["long"]] == [3]
    assert [r for r in got["lines"] if r[0] != 1] == [r for r in unbroken["lines"] if r[0] != 1]
    assert tables(spark, root, docs) == unbroken  # the older version can still be read


def test_document_index_by_stages_equals_one_build(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    meta = docs.select("doc_id", F.col("source").alias("symbol"), F.lit("Annual Report").alias("doc_type"), F.lit("2024").alias("fiscal_year"), F.lit(None).cast("string").alias("quarter"), F.lit(None).cast("string").alias("company"))
    now, root = docs.select("doc_id", "text", F.lit(1).alias("version")), store.new_path(spark, "staged")
    stages = sg.document_stages(meta)
    for until in ("chunks", "trees", "rollups", None):
        sg.build(spark, root, now, stages, until)
    whole = ix.build_index(docs.select("doc_id", "text"), meta, docs.select("doc_id").limit(0))
    current = now.select("doc_id", F.col("version").cast("string").alias("version"))
    for name, keys in (("chunks", ["doc_id", "chunk_index", "chunk_text"]), ("trees", ["doc_id", "total_chunks", "total_sections"]), ("rollups", ["doc_id", "node_id", "summary"])):
        got, want = (sorted(map(tuple, x.select(*keys).collect())) for x in (sg.read_stage(spark, root, name, current), whole[name]))
        assert got == want
    whole["chunks"].unpersist()
    words = sg.read_stage(spark, root, "keywords", current)
    assert words.where("array_size(at) = 0").count() == 0 and words.select("doc_id").distinct().count() == sg.read_stage(spark, root, "chunks", current).select("doc_id").distinct().count()


def test_batches_whose_documents_are_all_current_meet_no_documents(spark):
    """The rows of a whole batch are neither joined with versions when written nor when read; those of a partly replaced one are."""
    root, docs = store.new_path(spark, "staged"), frame(spark, ROWS)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    sg.build(spark, root, docs, STAGES)
    assert "Join" not in plan(sg.read_stage(spark, root, "lines", docs))
    again = frame(spark, [(1, "zz|y", "2"), *ROWS[1:]])
    sg.build(spark, root, again, STAGES)
    got = sg.read_stage(spark, root, "lines", again)
    assert "Join" in plan(got) and sorted(map(tuple, got.collect())) == [(1, 0, "zz"), (1, 1, "y"), (2, 0, "x"), (3, 0, "dddd"), (3, 1, "e")]
