"""What the corpus operators share: word rules, scratch tables, word fingerprints, components of a graph."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these six kinds of ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session without one gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


_WRITTEN: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which clean() removes with all that is under it."""
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends here, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Deletes the tables that this session has cut so far, once the results that rest on them are written; how many."""
    done = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return done


#: A name of more than this share of the rows is common; there are fewer than 1 / COMMON of them.
COMMON = 1 / 1000


def join_by_name(rows: DataFrame, names: DataFrame, keys: list[str], columns: list[str], how: str = "inner") -> DataFrame:
    """rows joined with the columns of names (one row a name, with its number of rows as count).

    Common names are broadcast, so their rows stay where they are; the others, and with how = "left" rows without a name, are
    joined by an exchange that no name dominates. Rows are told apart by a look at the hashes of the common names, so each row
    passes one join only, and without common names there is one join.
    """
    names = cut(names.select(*keys, "count", *columns), "names")
    most = COMMON * rows.count()
    found = sorted({r[0] for r in names.where(F.col("count") > most).select(F.xxhash64(*keys)).collect()})  # under 1 / COMMON
    names = names.drop("count")
    if not found:
        return rows.join(names, keys, how)
    common = F.xxhash64(*keys).isin(found)
    few = rows.where(~common).join(names.where(~common), keys, how)
    many = rows.where(common).join(F.broadcast(names.where(common)), keys, how)
    return few.unionByName(many.select(*few.columns))


# ---- fingerprints, for use inside tasks ----

_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def join_names(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The name of the ordered pair (x, y): the same in every task, so naming needs no exchange."""
    return mix(x * _C + mix(y + _C))


def word_names(text: str | None, lower: bool = False) -> np.ndarray:
    """64-bit names of a text's words, in order."""
    if not text:
        return np.empty(0, np.uint64)
    raw = text.encode("utf-8", "surrogatepass")
    found = (raw.lower() if lower else raw).split()  # bytes: only ASCII white space, only ASCII letters
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def gram_names(names: np.ndarray, k: int) -> np.ndarray:
    """Names of the k-grams at each position (none if there are fewer than k)."""
    n = len(names) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = mix(names[:n] + np.uint64(k))
    for j in range(1, k):
        out = join_names(out, names[j : n + j])
    return out


def shingle_set(names: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct k-shingles; a shorter text is one shingle; no words, no shingle."""
    if len(names) == 0:
        return names
    return np.unique(gram_names(names, min(k, len(names))))


# ---- what workers keep ----

_KEPT: dict = {}


def keep(name, make):
    """A value that a worker keeps for its later tasks, made once. A worker keeps one value, so that what the stages of a
    pipeline remember does not add up in it."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


# ---- connected components ----


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) long edges -> (node, component), the component being the smallest node reached.

    Alternating large-star and small-star rounds; each is two exchanges of the edges and ends in a table, and a round
    that changes nothing is the last. Hubs are no problem: a star sends one row per edge, and minima combine before
    the exchange. Self-loops and repeated edges are ignored.
    """
    now = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        now = cut(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
