"""Index builds by stages that are taken up again where they stopped.

Under a root each stage has a table and the ledger says which documents it has done, for which version. A run gives each stage one
batch: first the rows are written to <stage>/batch=<n>, then the ledger's rows to ledger/<stage>/batch=<n>; a batch counts
once the ledger's part is complete. So what a broken run has written without the ledger's word is not read, and the next run writes the
same batch again. Each stage takes the documents that its source stage has done and it has not: one anti-join, no look at rows.
Rows don't carry their version, as the ledger's part of their batch has it, and meet the documents only where some of the batch are not wanted.

A new version of a document (any text or number) is done anew and its older rows are read no more, which is the upsert of trees and
roll-ups.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import store

#: name -> (source stage or None for the documents, rows of the source -> rows of the stage, both with doc_id)
Stages = dict[str, tuple[str | None, Callable[[DataFrame], DataFrame]]]
LEDGER = "doc_id long, version string"


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches under a path whose writer has finished."""
    if not store.exists(spark, path):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    numbers = [int(f.getPath().getName().rpartition("=")[2]) for f in found if "=" in f.getPath().getName()]
    return sorted(n for n in numbers if store.exists(spark, f"{path}/batch={n}/_SUCCESS"))


def ledger(spark: SparkSession, root: str, stage: str) -> DataFrame:
    """(doc_id, version) of what a stage has done."""
    paths = [f"{root}/ledger/{stage}/batch={n}" for n in _batches(spark, f"{root}/ledger/{stage}")]
    return spark.read.schema(LEDGER).parquet(*paths) if paths else spark.createDataFrame([], LEDGER)


def read_stage(spark: SparkSession, root: str, stage: str, current: DataFrame) -> DataFrame | None:
    """The rows of a stage for the current documents (doc_id, version); None before its first batch. Rows of a batch have the
    version that its ledger names; a batch whose documents are all current is read as it lies."""
    wanted = current.select("doc_id", F.col("version").cast("string").alias("version")).distinct()
    parts = []
    for n in _batches(spark, f"{root}/ledger/{stage}"):
        rows = spark.read.parquet(f"{root}/{stage}/batch={n}")
        done = spark.read.schema(LEDGER).parquet(f"{root}/ledger/{stage}/batch={n}")
        now = done.join(wanted, ["doc_id", "version"], "left_semi")
        parts.append(rows if now.count() == done.count() else rows.join(now.select("doc_id"), "doc_id", "left_semi"))
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else None


def build(spark: SparkSession, root: str, docs: DataFrame, stages: Stages, until: str | None = None) -> dict[str, int]:
    """Brings the tables under root up to docs (doc_id, version and what the first stage reads); stages are taken in their
    order, the last one being `until`. Returns how many documents each stage has done now."""
    current = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("version").cast("string").alias("version")).where("doc_id IS NOT NULL").distinct()
    counts, every = {}, None
    for stage, (source, make) in stages.items():
        left = current.join(ledger(spark, root, stage), ["doc_id", "version"], "left_anti")
        if source is not None:
            left = left.join(ledger(spark, root, source), ["doc_id", "version"], "left_semi")
        counts[stage] = left.count()
        if counts[stage]:
            number = 1 + max([0, *_batches(spark, f"{root}/ledger/{stage}")])
            if source is None:
                rows, every = docs.withColumn("version", F.col("version").cast("string")), every or current.count()
                if counts[stage] == every:  # all documents: nothing to look up
                    rows = rows.where("CAST(doc_id AS LONG) IS NOT NULL AND version IS NOT NULL")
                else:
                    rows = rows.join(left, ["doc_id", "version"], "left_semi")
            else:
                rows = read_stage(spark, root, source, left)
            make(rows).write.mode("overwrite").parquet(f"{root}/{stage}/batch={number}")
            _commit(left, f"{root}/ledger/{stage}/batch={number}")
        if stage == until:
            break
    return counts


def _commit(done: DataFrame, path: str) -> None:
    done.select("doc_id", "version").write.mode("overwrite").parquet(path)


def document_stages(meta: DataFrame, least: int = 500, headings=None, embedder=None, summarize=None, **sizes) -> Stages:
    """The stages of the document index: chunks with prefix and vector (of documents over so many characters), section trees,
    roll-ups with vectors, keyword postings. meta as for enrich_chunks."""
    from tidemark.operators import indexing as ix
    from tidemark.operators import keyword as kw

    def chunks(docs: DataFrame) -> DataFrame:
        cut = ix.chunk_documents(docs.where(F.length("text") > least), headings or ix.HEADINGS, **sizes)
        return ix.embed_chunks(ix.enrich_chunks(cut, meta), embedder=embedder)

    def rollups(rows: DataFrame) -> DataFrame:
        made = ix.rollup_summaries(rows, **({"summarize": summarize} if summarize else {}))
        return ix.embed_chunks(made, "summary", embedder, keys=["doc_id", "node_id"])

    return {
        "chunks": (None, chunks),
        "trees": ("chunks", ix.section_tree),
        "rollups": ("chunks", rollups),
        "keywords": ("chunks", lambda rows: kw.keyword_postings(rows, ["doc_id", "chunk_index"], {"prefix": "A", "chunk_text": "B"})),
    }
