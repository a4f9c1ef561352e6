"""Benchmark passages in texts: CGK embedding, bit-sampling LSH, exact edit distance.

A benchmark item of n words is found where some stretch of a text differs from it by at most floor(n/5) words inserted,
deleted or replaced (words are lower-case letters, digits and underscores; case and punctuation don't count).

Windows of the size of an item are embedded by CGK random walks: a walk copies the current word and moves on if a random
bit of (step, word) says so, which turns an edit into a few differing coordinates. A repetition samples two coordinates of
its own walk, and their words are a key; windows and items that share two keys are joined by Spark. Each pair that meets is
confirmed by the exact edit distance, with free ends within the allowed number of words, so nothing is reported wrongly.
Sizes are taken in classes (an item is embedded by its first words, as many as the least size of its class), and the number
of repetitions grows with the size, as walks agree in less the more edits are allowed; README has the measured recall by
size. Items under five words allow no edit: their windows are embedded as they are, and meet with certainty.

Only windows that can match are embedded, by a bound that costs no recall: an edit spoils at most two of an item's n - 1
word pairs, so a matching stretch holds n - 1 - 2 floor(n/5) of them at least, one of them among the item's first
2 floor(n/5) + 1 pairs and one among its last so many. Which pairs occur in items, and which keys, tasks know from two bit
tables of a limited size (more items make them let more through, nothing less). So the benchmark may be of any size, and
no text is sent anywhere but the few stretches whose key occurs.

Null or empty texts and items match nothing; equal rows are one row; rows that share an id but not the text are separate;
a text that holds an item more than once has its best match (least distance, then first) returned; other columns are not
read. Word fingerprints have 64 bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, documents, gram_names, join_names, keep, mix

EDIT_SHARE = 5  # one word in five may differ
SAMPLED = 2
#: Bits of a bit table, at most.
TABLE_BITS = 1 << 27
#: Texts that are looked at together, and words that a worker remembers.
TEXTS, REMEMBERED = 1000, 500_000
#: Keys that a window and an item must share to be looked at, where they have several.
MEETINGS = 2
_WORDS = re.compile(r"\w+")
_ONE = np.uint64(1)


class _Names(dict):
    def __missing__(self, word: str) -> int:
        out = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) | 1  # never 0
        return out


def names(text: str | None) -> np.ndarray:
    """Names of a text's words."""
    if not text:
        return np.empty(0, np.uint64)
    known = keep("decontaminate", _Names)
    if len(known) > REMEMBERED:
        known.clear()
    found = _WORDS.findall(text.lower())
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def class_sizes(most: int) -> list[int]:
    """Least sizes of the classes: every size up to ten, then a fifth more each time."""
    out = list(range(1, 11))
    while out[-1] < most:
        out.append(out[-1] + out[-1] // 5)
    return out


def repetitions(size: int) -> int:
    """Repetitions for items of a class; fitted to the measured agreement of walks at the allowed edits."""
    return 1 if size < EDIT_SHARE else 20 + size // 3


class Walks:
    """Keys of windows of a size."""

    def __init__(self, size: int):
        self.size, self.n = size, repetitions(size)
        rng = np.random.default_rng(size)
        self.odd = rng.integers(1 << 63, size=self.n, dtype=np.uint64)[:, None] * np.uint64(2) + _ONE
        self.pick = np.array([rng.choice(2 * size, SAMPLED, replace=False) for _ in range(self.n)], np.uint64)

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """(windows by repetitions); windows are rows of names, as many as the size."""
        salt = mix(np.arange(self.n, dtype=np.uint64) + np.uint64(self.size << 20))
        if self.size < EDIT_SHARE:
            return join_names(gram_rows(windows), salt[:1])[:, None]
        out = np.empty((len(windows), self.n), np.uint64)
        block = max(1, 60_000 // self.n)
        for first in range(0, len(windows), block):
            rows = windows[first : first + block]
            step = np.zeros((self.n, len(rows)), np.uint64)  # at which the walk comes to a word
            at = np.zeros((SAMPLED, self.n, len(rows)), np.int64)  # the word that it copies at the sampled steps
            picks = [self.pick[:, j, None] for j in range(SAMPLED)]
            for word in np.ascontiguousarray(rows.T[:-1]):
                bits = word * self.odd  # bit s decides at step s (and 64 steps later again)
                bits ^= bits >> np.uint64(32)
                turn = step & np.uint64(63)
                bits = (bits >> turn) | (bits << ((np.uint64(64) - turn) & np.uint64(63)))
                step += np.bitwise_count(~bits & (bits - _ONE)).astype(np.uint64) + _ONE  # stays until a bit is set
                for j, pick in enumerate(picks):
                    at[j] += step <= pick
            every = np.arange(len(rows))
            key = salt[:, None]
            for j in range(SAMPLED):
                key = join_names(key, rows[every, at[j]])
            out[first : first + block] = key.T
        return out


def gram_rows(windows: np.ndarray) -> np.ndarray:
    out = mix(windows[:, 0] + np.uint64(windows.shape[1]))
    for j in range(1, windows.shape[1]):
        out = join_names(out, windows[:, j])
    return out


class Bits:
    """A bit table of names; each name sets two bits."""

    def __init__(self, table: np.ndarray):
        self.table, self.mask = table, np.uint64(len(table) * 64 - 1)

    def places(self, x: np.ndarray) -> list[np.ndarray]:
        return [mix(x + np.uint64(i)) & self.mask for i in (11, 12)]

    def has(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(x.shape, bool)
        for at in self.places(x):
            out &= (self.table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & _ONE == 1
        return out


#: Where in an item a word pair stands: anywhere, among the first, among the last.
ANYWHERE, HEAD, TAIL = 0, 1, 2


def _kind(pairs: np.ndarray, size: int, kind: int) -> np.ndarray:
    """Names of word pairs as those of a part of the items of a class (size 0: of any)."""
    return join_names(pairs, np.full(1, size * 4 + kind, np.uint64))


def _item_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        each = [names(t) for t in batch["text"]]
        sizes = class_sizes(max(map(len, each), default=1))
        size = [max(s for s in sizes if s <= len(x)) if len(x) else 0 for x in each]
        yield pd.DataFrame({"item_id": batch["item_id"], "n": [len(x) for x in each], "size": size, "words": [x.tobytes() for x in each]})


def _item_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    walks: dict[int, Walks] = {}
    for batch in batches:
        for size, part in batch.groupby("size"):
            walk = walks.setdefault(size, Walks(size))
            keys = walk.keys(np.array([np.frombuffer(x, np.uint64, size) for x in part["words"]]))
            yield pd.DataFrame({"key": keys.ravel().view(np.int64), "item": np.repeat(part["item"].to_numpy(), walk.n)})


def _item_bits(bits: int, of_pairs: bool):
    """Set bits of the tables, as 64-bit parts."""
    table = Bits(np.empty(bits // 64, np.uint64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if of_pairs:
                found = []
                for size, raw in zip(batch["size"], batch["words"]):
                    own = np.frombuffer(raw, np.uint64)
                    pairs, head = gram_names(own, 2), 2 * (len(own) // EDIT_SHARE) + 1
                    found += [_kind(pairs, 0, ANYWHERE), _kind(pairs, size, ANYWHERE), _kind(pairs[:head], size, HEAD), _kind(pairs[-head:], size, TAIL)]
                found = np.concatenate(found) if found else np.empty(0, np.uint64)
            else:
                found = batch["key"].to_numpy().view(np.uint64)
            at = np.concatenate(table.places(found)).astype(np.int64)
            yield pd.DataFrame({"slot": at >> 6, "bits": (np.int64(1) << (at & 63))})

    return run


def _table(rows: DataFrame, entries: int, of_pairs: bool) -> Bits:
    """The bit table of some rows: a collected table of at most TABLE_BITS bits."""
    bits = min(TABLE_BITS, 1 << max(10, (32 * entries).bit_length()))
    found = rows.mapInPandas(_item_bits(bits, of_pairs), "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[found["slot"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return Bits(table)


def known_pairs(words: np.ndarray, ends: np.ndarray, pairs: Bits) -> tuple[np.ndarray, np.ndarray]:
    """Places and names of the word pairs that are in any item."""
    every = join_names(mix(words[:-1] + np.uint64(2)), words[1:])
    at = np.flatnonzero(pairs.has(_kind(every, 0, ANYWHERE)) & (ends[:-1] == ends[1:]))
    return at, every[at]


def live_windows(found: tuple[np.ndarray, np.ndarray], begins: np.ndarray, ends: np.ndarray, low: int, high: int, pairs: Bits) -> np.ndarray:
    """Starts of windows that can match an item of low to high words. begins, ends: of the text of each word."""
    if low < 2:
        return np.arange(len(ends))
    spare = high // EDIT_SHARE
    least = min(n - 1 - 2 * (n // EDIT_SHARE) for n in range(low, high + 1))
    at, every = found
    own = pairs.has(_kind(every, low, ANYWHERE))
    at, every = at[own], every[own]
    if len(at) < least:
        return at[:0]
    # enough pairs within a window and the words that may be put into it
    first, last = at[: len(at) - least + 1], at[least - 1 :]
    lowest = np.maximum(last - (high + spare - 2), begins[first])
    some = np.flatnonzero((lowest <= first) & (ends[first] == ends[last]))
    size = first[some] - lowest[some] + 1
    start = np.unique(np.repeat(lowest[some], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    # an intact pair of the item stands in the text at its own place, up to so many words earlier or later
    head = 2 * spare + 1
    for kind, a, b in ((HEAD, 0, head + spare), (TAIL, max(low - 1 - head - spare, 0), high + spare)):
        place = at[pairs.has(_kind(every, low, kind))]
        start = start[np.searchsorted(place, np.minimum(start + b, ends[start])) > np.searchsorted(place, start + a)]
    return start


def _windows(classes: list[tuple[int, int]], tables):
    """Stretches of texts around the windows that have a key of an item, with these keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs, item_keys = (Bits(x) for x in tables.value)
        walks = [(Walks(low), low, high) for low, high in classes]
        for batch in batches:
            for first in range(0, len(batch), TEXTS):
                part = batch.iloc[first : first + TEXTS]
                each, ids, hashes = [names(t) for t in part["text"]], part["doc_id"].tolist(), part["_h"].tolist()
                words, sizes = np.concatenate(each), np.array([len(x) for x in each])
                text_end = np.cumsum(sizes)
                begins, ends, text = (np.repeat(x, sizes) for x in (text_end - sizes, text_end, np.arange(len(each))))
                if not len(words):
                    continue
                found, rows = known_pairs(words, ends, pairs), []
                for walk, low, high in walks:
                    spare = high // EDIT_SHARE
                    start = live_windows(found, begins, ends, low, high, pairs)
                    for a in range(0, len(start), 20_000):
                        some = start[a : a + 20_000]
                        place = some[:, None] + np.arange(low)
                        windows = np.where(place < ends[some][:, None], words[np.minimum(place, len(words) - 1)], np.uint64(0))
                        keys = walk.keys(windows)
                        hit = item_keys.has(keys)
                        for k in np.flatnonzero(hit.sum(axis=1) >= min(MEETINGS, walk.n)):
                            i, t = int(some[k]), text[some[k]]
                            begin = text_end[t] - sizes[t]
                            first_word = max(i - spare, begin)
                            stretch = words[first_word : min(i + high + spare, text_end[t])]
                            rows.append((ids[t], hashes[t], low, first_word - begin, stretch.tobytes(), keys[k][hit[k]].view(np.int64)))
                out = pd.DataFrame(rows, columns=["doc_id", "_h", "size", "at", "stretch", "keys"])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    return run


def edit_distances(item: np.ndarray, stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """items and stretches row by row (stretches padded with 0): the least distance between the item and a part of the
    stretch, and where that part ends first (free ends)."""
    steps = np.arange(stretches.shape[1] + 1)
    before = np.zeros((len(stretches), len(steps)), np.int64)
    for j in range(item.shape[1]):
        now = np.empty_like(before)
        now[:, 0] = before[:, 0] + 1
        now[:, 1:] = np.minimum(before[:, 1:] + 1, before[:, :-1] + (stretches != item[:, j, None]))
        before = np.minimum.accumulate(now - steps, axis=1) + steps
    end = before.argmin(axis=1)
    return before[np.arange(len(end)), end], end


def _padded(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows))), np.uint64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for n, part in batch.groupby("n"):
            for first in range(0, len(part), 500):
                some = part.iloc[first : first + 500]
                item = np.array([np.frombuffer(x, np.uint64) for x in some["words"]])
                rows = [np.frombuffer(x, np.uint64) for x in some["stretch"]]
                distance, end = edit_distances(item, _padded(rows))
                good = np.flatnonzero(distance <= n // EDIT_SHARE)
                if not len(good):
                    continue
                _, size = edit_distances(item[good, ::-1], _padded([rows[k][: end[k]][::-1] for k in good]) if end[good].any() else np.zeros((len(good), 1), np.uint64))
                some = some.iloc[good]
                yield pd.DataFrame(
                    {
                        "doc_id": some["doc_id"].astype("Int64"),
                        "_h": some["_h"],
                        "item_id": some["item_id"],
                        "start_word": some["at"].to_numpy() + end[good] - size,
                        "n_words": size,
                        "distance": distance[good],
                    }
                )


_HITS = "doc_id long, _h long, item_id long, start_word long, n_words long, distance long"


def _found(texts: DataFrame, items: DataFrame) -> DataFrame:
    """_HITS of texts (doc_id, text, _h) and items (item_id, text)."""
    spark = texts.sparkSession
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").mapInPandas(_item_rows, "item_id long, n long, size long, words binary")
    items = cut(items.where("n > 0").withColumn("item", F.xxhash64("item_id", "words")).dropDuplicates(["item"]), "items")
    sizes = items.groupBy("size").agg(F.max("n").alias("most"), F.count("*").alias("items"), F.sum("n").alias("words")).orderBy("size").collect()
    if not sizes:
        return spark.createDataFrame([], _HITS)
    keys = cut(items.select("item", "size", "words").mapInPandas(_item_keys, "key long, item long").distinct(), "item-keys")
    pairs = _table(items.select("size", "words"), sum(r["words"] for r in sizes), True)
    marks = _table(keys.select("key"), sum(r["items"] * repetitions(r["size"]) for r in sizes), False)
    tables = spark.sparkContext.broadcast((pairs.table, marks.table))
    windows = texts.where("text IS NOT NULL").mapInPandas(
        _windows([(r["size"], r["most"]) for r in sizes], tables), "doc_id long, _h long, size long, at long, stretch binary, keys array<long>"
    )
    met = windows.withColumn("key", F.explode("keys")).drop("keys").join(keys, "key")
    met = met.groupBy("doc_id", "_h", "at", "size", "item").agg(F.first("stretch").alias("stretch"), F.count("*").alias("keys"))
    met = met.where((F.col("keys") >= MEETINGS) | (F.col("size") < EDIT_SHARE))
    both = met.drop("size", "keys").join(items.select("item", "item_id", "n", "words"), "item")
    best = F.min(F.struct("distance", "start_word", "n_words")).alias("best")
    hits = both.mapInPandas(_verified, _HITS).groupBy("doc_id", "_h", "item_id").agg(best)
    return hits.select("doc_id", "_h", "item_id", "best.start_word", "best.n_words", "best.distance")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("_h"))


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, distance): the best match of each item in each text that has one."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    return _found(_texts(docs, id_col, text_col), items).drop("_h")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text holds a benchmark item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    dirty = _found(_texts(docs, id_col, text_col), items).select(F.col("doc_id").alias("_dirty"), F.col("_h").alias("_hash")).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_dirty")) & (F.xxhash64(text_col) == F.col("_hash"))
    return docs.join(dirty, same, "left_anti")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
