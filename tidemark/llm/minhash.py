"""Near-duplicate documents by HyperMinHash.

Each text becomes the set of its 5-word shingles. A register holds, for one of 128 hash ranges, the leading-zero count
and ten further bits of the least shingle hash there. Bands of four registers make the buckets; for two sets of
similarity 0.85 all 32 bands differ with probability (1 - 0.85**4)**32 < 1e-10, at 0.8 with 5e-8. Candidates pass a
collision-corrected Jaccard estimate and are then confirmed on the full shingle sets of the whole texts.

With few shingles most registers are empty, so sets of up to SMALL shingles are met exactly instead: two sets of n or more
shingles and similarity t share at least ceil(t n) of them, so in one order of all shingles (that of their hashes) the
first n - ceil(t n) + 1 of either hold a common one. These are the small sets' bucket keys, and no such pair is lost. The
estimate of a small set is not used either, as it rests on too few registers.

Groups of any size are handled without emitting their pairs: documents with equal sets are one class with the smallest
id as its representative; each bucket is first a star around its smallest member, and then, for those that the confirmed links
leave apart from it, around another one of them, for some rounds: a group of mutually similar texts becomes one component as soon as one
of them is the middle. Members of a bucket that are still in different components are then compared across components, at places chosen
by an exact prefix bound on their shingles; a bitmap of each set, part of the join's condition, bounds what two sets can share, so that groups just
under the threshold don't become rows. So every link between different texts is either confirmed or joins documents connected already.

Defined results: a null or empty text, or one without words, has no shingle, is linked with nothing and is kept. Rows
with the same id are one document: each row gets its own count, what is near to one of its texts is linked with all, and
they are kept or not together. A row without id is kept, with a null component. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import components, cut, documents, join_by_name, mix, shingle_set, word_names

REGISTERS = 128
ROWS = 4
BANDS = REGISTERS // ROWS
MANTISSA = 10
#: An estimate this far under the threshold is over six standard errors away with 128 registers.
MARGIN = 0.2
#: Sets of at most so many shingles, and those that may be similar to one, are met by their first shingles.
SMALL = 64
#: Rounds of stars around a member of each bucket; what they leave apart is compared across components.
STARS = 4
#: Cells in each of the two tables that count shingles; more make the order finer, the results are the same.
CELLS = 1 << 19

_SKETCH = "doc_id long, n_shingles long, f1 long, f2 long, registers binary, first array<long>"
_EDGES = np.array([(i << 64) // REGISTERS for i in range(REGISTERS)], dtype=object)
_STARTS = np.array([int(x) for x in _EDGES], np.uint64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a sorted array of distinct 64-bit hashes; 0 is an empty register."""
    at = np.searchsorted(shingles, _STARTS)
    out = np.zeros(REGISTERS, np.uint16)
    full = at < np.append(at[1:], len(shingles))
    least = shingles[at[full]]
    bits = int(REGISTERS).bit_length() - 1
    fraction = ((least << np.uint64(bits)) >> np.uint64(11)).astype(np.float64)  # 53 bits below the range's own
    mantissa, exponent = np.frexp(fraction)
    zeros = np.where(fraction > 0, 53 - exponent, 53)
    tail = np.where(fraction > 0, np.floor((2 * mantissa - 1) * (1 << MANTISSA)), 0)
    out[full] = ((zeros + 1).astype(np.uint16) << np.uint16(MANTISSA)) | tail.astype(np.uint16)
    return out


def _collisions() -> np.ndarray:
    """Chance that the registers of two unrelated sets are equal, by log2 of the shingles in a range."""
    zeros, tail = np.meshgrid(np.arange(54), np.arange(1 << MANTISSA), indexing="ij")
    low = 2.0 ** -(zeros + 1.0) * (1 + tail / (1 << MANTISSA))
    high = low + 2.0 ** -(zeros + 1.0 + MANTISSA)
    return np.array([np.sum((np.exp(-low * n) - np.exp(-high * n)) ** 2) for n in 2.0 ** np.arange(0, 40)])


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, less the equal registers that chance alone explains."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    equal = ((a == b) & (a > 0)).sum(axis=1)
    chance = table[np.clip(np.log2(np.maximum(n / REGISTERS, 1)).astype(int), 0, len(table) - 1)]
    return (equal - used * chance) / np.maximum(used * (1 - chance), 1e-9)


def _least(n: int, percent: int) -> int:
    """How many shingles a set of n shares at least with one as similar."""
    return -(-percent * n // 100)


def _sketches(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["text"]):
                own = shingle_set(word_names(text, lower=True))
                n, least = len(own), _least(len(own), percent)
                first = own[: n - least + 1].view(np.int64) if 0 < least <= SMALL else None
                sums = (int(mix(own + np.uint64(i)).sum().view(np.int64)) for i in (0, 1))
                rows.append((key, n, *sums, sketch(own).tobytes() if n else None, first))
            out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "f1", "f2", "registers", "first"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return run


def _likely(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = _collisions()
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                n = np.sqrt(batch["na"].to_numpy(float) * batch["nb"].to_numpy(float))
                few = np.minimum(batch["na"], batch["nb"]).to_numpy() <= SMALL
                batch = batch[few | (estimate(a, b, n, table) >= least)]
            yield batch[["a", "b"]]

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, y = None, None
        for batch in batches:
            good = []
            for a, b, ta, tb in zip(batch["a"], batch["b"], batch["ta"], batch["tb"]):
                if last != (b, tb):  # rows with one b tend to come together
                    last, y = (b, tb), shingle_set(word_names(tb, lower=True))
                x = shingle_set(word_names(ta, lower=True))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    return run


def _links(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b), those with enough shingles in common: estimate first, then the whole texts."""
    side = lambda x: sketches.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b")
    sized = sized.where((100 * F.least("na", "nb")) >= percent * F.greatest("na", "nb"))
    likely = sized.mapInPandas(_likely(percent / 100 - MARGIN), "a long, b long")
    full = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}"))
    both = likely.join(full("a"), "a").join(full("b"), "b").select("a", "b", "ta", "tb")
    return both.mapInPandas(_confirmed(percent), "a long, b long").distinct()


def _buckets():
    """Bucket keys: the first shingles of a set that may be similar to a small one, the bands of one that isn't small.

    A set that is not small but may be similar to one has both. An empty band is no key.
    """
    keys = []
    for j in range(BANDS):
        band = F.substring("registers", j * 2 * ROWS + 1, 2 * ROWS)
        keys.append(F.when(band != F.lit(bytes(2 * ROWS)), F.xxhash64(F.lit(j), band)))
    bands = F.when(F.col("n_shingles") > SMALL, F.array_compact(F.array(*keys)))
    none = F.array().cast("array<long>")
    return F.concat(F.coalesce(F.transform("first", lambda x: F.xxhash64(F.lit(-1), x)), none), F.coalesce(bands, none))


def _cells(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two cells in which a shingle is counted."""
    bits = np.uint64(CELLS.bit_length() - 1)
    high, low = shingles >> (np.uint64(64) - bits), shingles & np.uint64(CELLS - 1)
    return high.astype(np.int64), low.astype(np.int64) + CELLS


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(2 * CELLS, np.int64)
    for batch in batches:
        for text in batch["text"]:
            for cells in _cells(shingle_set(word_names(text, lower=True))):
                np.add.at(total, cells, 1)
    cell = np.flatnonzero(total)
    yield pd.DataFrame({"cell": cell, "n": total[cell]})


#: Words of 64 bits in a set's bitmap.
WORDS = 4


def bits_of(shingles: np.ndarray) -> dict[str, int]:
    """A bitmap of a set: each shingle sets one bit. Two sets differ in as many shingles as their bitmaps in bits, or more."""
    at = (mix(shingles + np.uint64(3)) & np.uint64(64 * WORDS - 1)).astype(np.int64)
    table = np.zeros(64 * WORDS, np.uint8)
    table[at] = 1
    return {f"b{i}": int(x) for i, x in enumerate(np.packbits(table).view(np.int64))}


def _early(percent: int, levels):
    """The shingles that may be the first common one of a similar pair, with their places p from 1 on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[pd.DataFrame] = []
        waiting = 0
        for batch in batches:
            for key, component, text in zip(batch["doc_id"], batch["component"], batch["text"]):
                own = shingle_set(word_names(text, lower=True))
                one, two = _cells(own)
                order = np.lexsort((own, np.minimum(levels.value[one], levels.value[two])))
                # as the larger set of a pair, n - percent n + 1 places at most
                first = own[order[: len(own) + 1 + (-percent * len(own)) // 100]]
                rows.append(pd.DataFrame({"doc_id": key, "component": component, "n": len(own), "p": np.arange(1, len(first) + 1), "shingle": first.view(np.int64), **bits_of(own)}))
                waiting += len(first)
                if waiting >= 100_000:
                    yield pd.concat(rows)
                    rows, waiting = [], 0
        if rows:
            yield pd.concat(rows)

    return run


def _across(rest: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) from different components that may be similar enough, losing none that are.

    Shingles are put into one order, rare ones first. Of a pair that is similar enough, the first common shingle stands so
    early in both sets that enough can follow it; pairs are met at such places only. Members of a large group that are
    not linked to it have shingles of their own there, which nobody else has.

    Any order is right as long as it is the same everywhere, so rarity is the power of two in the lesser of two counts
    kept in a table of fixed size, and only the early shingles of a text leave its task.
    """
    spark = rest.sparkSession
    apart = cut(rest.join(texts, "doc_id").select("doc_id", "component", "text"), "apart")
    counts = apart.select("text").mapInPandas(_counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = counts.select("cell", F.floor(F.log2("n")).cast("byte").alias("level")).toArrow()  # 2 * CELLS rows at most
    levels = np.zeros(2 * CELLS, np.int8)
    levels[found["cell"].to_numpy()] = found["level"].to_numpy()
    each = cut(
        apart.mapInPandas(_early(percent, spark.sparkContext.broadcast(levels)), "doc_id long, component long, n long, p long, shingle long" + "".join(f", b{i} long" for i in range(WORDS))),
        "shingles",
    )
    # only shingles of several components can join any
    several = each.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    early = cut(each.join(several.select("shingle"), "shingle", "left_semi"), "early")
    cols = ["doc_id", "component", "n", "p", *[f"b{i}" for i in range(WORDS)]]
    x = early.where(F.col("p") <= F.col("n") - F.ceil(F.col("n") * 2 * percent / (100 + percent)) + 1)
    x = x.select("shingle", *[F.col(c).alias(f"x_{c}") for c in cols])
    y = early.select("shingle", *[F.col(c).alias(f"y_{c}") for c in cols])
    need = F.ceil((F.col("x_n") + F.col("y_n")) * percent / (100 + percent))
    fits = (F.col("x_component") != F.col("y_component")) & (F.col("x_n") <= F.col("y_n")) & (100 * F.col("x_n") >= percent * F.col("y_n"))
    enough = 1 + F.least(F.col("x_n") - F.col("x_p"), F.col("y_n") - F.col("y_p")) >= need
    differ = reduce(lambda a, b: a + b, [F.bit_count(F.col(f"x_b{i}").bitwiseXOR(F.col(f"y_b{i}"))) for i in range(WORDS)])
    met = x.join(y, (x["shingle"] == y["shingle"]) & fits & enough & (F.col("x_n") + F.col("y_n") - differ >= 2 * need))
    return met.select(F.greatest("x_doc_id", "y_doc_id").alias("a"), F.least("x_doc_id", "y_doc_id").alias("b")).distinct()


def _merge(grouped: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after further links (a, b)."""
    of = grouped.select("node", "component")
    edges = (
        links.join(of.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        .join(of.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    )
    merged = components(edges)
    new = merged.select("node", F.col("node").alias("mid")).join(of.select("node"), "node", "left_anti")
    every = of.select("node", F.col("component").alias("mid")).unionByName(new)
    every = every.join(merged.select(F.col("node").alias("mid"), F.col("component").alias("top")), "mid", "left")
    return cut(every.select("node", F.coalesce("top", "mid").alias("component")), "grouped")


def _placed(members: DataFrame, grouped: DataFrame) -> DataFrame:
    """members (with doc_id) and their component, which is the document itself before its first link."""
    found = members.join(grouped.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return found.withColumn("component", F.coalesce("component", "doc_id"))


def near_duplicates(
    docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = cut(texts.mapInPandas(_sketches(percent), _SKETCH), "sketches")
    named = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(named.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("count")), "classes")
    rep = classes.select(F.col("rep").alias("doc_id"), "n_shingles", "f1", "f2")
    reps = named.join(rep, rep.columns, "left_semi").dropDuplicates(rep.columns)

    buckets = cut(reps.select("doc_id", F.explode(_buckets()).alias("bucket")), "buckets")
    hubs = buckets.groupBy("bucket").agg(F.min("doc_id").alias("hub"), F.count("*").alias("count")).where("count > 1")
    left = shared = cut(join_by_name(buckets, hubs, ["bucket"], ["hub"]), "shared")
    only = texts.join(shared.select("doc_id").distinct(), "doc_id")
    only = cut(only.withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_h"]).drop("_h"), "texts")

    grouped = docs.sparkSession.createDataFrame([], "node long, component long")
    for turn in range(STARS):
        stars = left.where("hub <> doc_id").select(F.greatest("doc_id", "hub").alias("a"), F.least("doc_id", "hub").alias("b")).distinct()
        grouped = _merge(grouped, cut(_links(stars, reps, only, percent), "links"))
        # who is still apart from its bucket's hub is asked again, around another of these
        of_hub = grouped.select(F.col("node").alias("hub"), F.col("component").alias("_c"))
        apart = _placed(left, grouped).join(of_hub, "hub", "left").where(F.col("component") != F.coalesce("_c", "hub"))
        apart = cut(apart.select("doc_id", "bucket"), "apart")
        pick = F.min_by("doc_id", F.xxhash64("doc_id", F.lit(turn)))
        hubs = apart.groupBy("bucket").agg(pick.alias("hub"), F.count("*").alias("count")).where("count > 1")
        left = cut(join_by_name(apart, hubs, ["bucket"], ["hub"]), "left")
        if left.isEmpty():
            break

    # what the stars left apart: members of one bucket in different components
    placed = cut(_placed(shared.select("bucket", "doc_id"), grouped), "placed")
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("count")).where("lo < hi")
    rest = cut(join_by_name(placed, open_, ["bucket"], []).select("doc_id", "component").distinct(), "rest")
    grouped = _merge(grouped, cut(_links(_across(rest, only, percent), reps, only, percent), "links"))
    whole = grouped.select(F.col("node").alias("rep"), F.col("component").alias("component_id"))
    classed = classes.join(whole, "rep", "left").select("n_shingles", "f1", "f2", "count", F.coalesce("component_id", "rep").alias("component_id"))
    rows = sketches.select("doc_id", "n_shingles", "f1", "f2")
    out = join_by_name(rows, classed, ["n_shingles", "f1", "f2"], ["component_id"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
