"""The corpus pipeline: toxicity, line dedup, near-dup, benchmark decontamination, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and
each works on what its predecessor kept. run() writes what a stage returns to the shared folder and reads it again for
the next one, so a lost executor costs at most the work of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, minhash, sentencepiece, toxicity
from tidemark.llm.common import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores under 0.5 for toxicity.

    Null and empty texts have no words and stay. Rows that share an id go if one of them is toxic; a row without id is judged
    with the other rows without id. Columns pass through, whatever their names.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the later copies of repeated lines (smallest id, then earliest, stays); n_chars follows the text.

    Null texts stay null, a text may become empty; equal rows are one occurrence and don't empty each other; a row without id
    keeps its text. Other columns pass through.
    """
    out = line_dedup.line_dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (similarity of 0.8 or more) the row with the smallest id.

    Null, empty and wordless texts are near to nothing and stay, as do rows without id. Rows that share an id are one document
    and stay or go together. Columns pass through.
    """
    gone = minhash.near_duplicates(docs, percent=80).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item.

    Null and empty texts hold none. Rows are judged one by one, also those that share an id or have none; equal rows stay or go
    together. Columns pass through.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids_sha256, restored, ids) of each row: null ids and counts for a null text, none for an empty one."""
    return sentencepiece.encode(docs).select("doc_id", "n_ids", "ids_sha256", "restored", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", to_ids),
]

#: Trained scores and Viterbi ids are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
