"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

A word is described by its subsequences of four letters; up to three letters may lie between two of them, and each costs a
factor, the best occurrence counting: an explicit map, so its scalar products are a kernel. The kernel of two words is the
square of that product, the kernel of two sentences the sum over their pairs of words; sums and products of kernels are
kernels, so no matrix of it has a negative eigenvalue. Letters put between those of an insult keep all its subsequences
and lower the kernel by the factors only. Words are compared without case and signs, a run of single letters as one word.

Sentences end with a line, with a sign of their own (.!?), or after SENTENCE words; a sentence is the set of its words.
Landmarks are word fragments that are much more frequent in texts labelled toxic; of like ones only the best is taken.
The Nystroem map takes the kernels of a sentence with the landmarks through the inverse root of the landmarks' own matrix,
and a linear support vector machine is trained on it. A label is of a whole text: the text stands for the sentence that is
most toxic by the machine so far (at first, the one nearest to the landmarks), and the machine is trained again. A text's
margin is the largest of its sentences; a logistic curve over margins gives scores from 0 to 1. The machine being linear
and the kernel a sum over words, what a word adds is one number, which a worker works out once for each word it meets.

Learning takes a bounded sample of labelled rows (sample_rows, the smallest hashes of the id). The model is a few
hundred numbers and is sent to the tasks; every text is scored whole, in one scan. Null or empty texts have no words and
get the score of an empty sentence; without labels of both kinds or without landmarks every score is the share of toxic
labels. Repeated rows give repeated results; labels of one id count once (toxic if any says so); other columns of the
documents are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, cut, documents, keep

SAMPLE_ROWS = 20_000
LANDMARKS = 64
FRAGMENT = 5
#: Letters of a subsequence, the most letters between two of them, and the factor that each costs.
LETTERS, GAP, DECAY = 4, 3, 0.9
SENTENCE = 40
ROUNDS = 2
#: Words that a worker remembers, and numbers that it remembers of them.
REMEMBERED, NUMBERS = 600_000, 6_000_000
#: Letters of a word that are looked at together; a longer word is cut into pieces that overlap by more than any
#: subsequence is long.
WIDTH, STEP = 32, 16
_SIGNS_IN_LINE = re.compile(r"[^\w\n]+|[\d_]+")


def letters(word: str) -> str:
    return _SIGNS_IN_LINE.sub("", word.lower().replace("\n", ""))


def subsequences(word: str) -> dict[str, float]:
    """The description of a word: its subsequences and their weights."""
    out: dict[str, float] = {}
    ways = [(i, c, 1.0) for i, c in enumerate(word)]
    for _ in range(LETTERS - 1):
        ways = [(j, f + word[j], w * DECAY ** (j - i - 1)) for i, f, w in ways for j in range(i + 1, min(i + GAP + 2, len(word)))]
    for _, f, w in ways:
        out[f] = max(out.get(f, 0.0), w)
    return out


class Kernel:
    """Kernels of words with a list of landmarks, whose descriptions have unit length."""

    def __init__(self, landmarks):
        own = [subsequences(x) for x in landmarks]
        features = sorted(set().union(*own)) if own else []
        place = {f: i for i, f in enumerate(features)}
        self.weight = np.zeros((len(features), len(own)))
        for m, each in enumerate(own):
            size = sum(v * v for v in each.values()) ** 0.5
            for f, v in each.items():
                self.weight[place[f], m] = v / size
        # the landmarks' subsequences as a tree; letters that are in none are 0, and so is the dead end
        self.used = np.array(sorted({ord(c) for f in features for c in f}), np.uint32)
        nodes: dict[str, int] = {}
        for f in features:
            for n in range(1, LETTERS + 1):
                nodes.setdefault(f[:n], len(nodes) + 1)
        self.next = np.zeros((len(nodes) + 2, len(self.used) + 1), np.int32)
        self.leaf = np.zeros(len(nodes) + 2, np.int64)
        for f, node in nodes.items():
            code = int(np.searchsorted(self.used, ord(f[-1]))) + 1
            self.next[nodes[f[:-1]] if len(f) > 1 else len(nodes) + 1, code] = node
            if len(f) == LETTERS:
                self.leaf[node] = place[f]
        self.root = len(nodes) + 1

    def of(self, words: list[str]) -> np.ndarray:
        """Kernels (words by landmarks); words are letters only."""
        out = np.zeros((len(words), self.weight.shape[1]))
        if not len(self.used) or not words:
            return out
        pieces = [(i, w[a : a + WIDTH]) for i, w in enumerate(words) for a in (range(0, max(len(w) - WIDTH, 0) + STEP, STEP) if len(w) > WIDTH else (0,))]
        word = np.array([i for i, _ in pieces])
        chars = np.array([x for _, x in pieces], f"<U{WIDTH}").view(np.uint32).reshape(-1, WIDTH)
        at = np.minimum(np.searchsorted(self.used, chars), len(self.used) - 1)
        code = np.zeros((len(pieces), WIDTH + GAP + 1), np.int32)
        code[:, :WIDTH] = np.where(self.used[at] == chars, at + 1, 0)
        row, place = np.nonzero(self.next[self.root][code])
        node, gaps = self.next[self.root][code[row, place]], np.zeros(len(row), np.int64)
        for _ in range(LETTERS - 1):
            ways = []
            for gap in range(GAP + 1):
                then = np.minimum(place + 1 + gap, WIDTH)  # the column behind the last holds no letter
                to = self.next[node, code[row, then]]
                ok = np.flatnonzero(to)
                ways.append((row[ok], then[ok], to[ok], gaps[ok] + gap))
            row, place, node, gaps = map(np.concatenate, zip(*ways))
        if not len(row):
            return out
        key = word[row] * len(self.leaf) + node
        order = np.lexsort((gaps, key))
        first = order[np.flatnonzero(np.append(True, np.diff(key[order]) > 0))]  # the fewest gaps of each subsequence
        owner = word[row[first]]
        start = np.flatnonzero(np.append(True, np.diff(owner) > 0))
        values = self.weight[self.leaf[node[first]]] * (DECAY ** gaps[first])[:, None]
        out[owner[start]] = np.add.reduceat(values, start, axis=0) ** 2
        return out


class Reader:
    """Turns texts into words by sentence, and remembers what words are worth: value(list of words) -> array of rows."""

    def __init__(self, value):
        self.value = value
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {b"\0": 0}
        self.values: list[np.ndarray] = [self.value([""]).astype(np.float32)]
        self.flags: list[np.ndarray] = [np.array([[True, False]])]
        self.table, self.flag = self.values[0], self.flags[0]

    def _learn(self, new: list[bytes]) -> None:
        for start in range(0, len(new), 8192):
            part = new[start : start + 8192]
            plain = _SIGNS_IN_LINE.sub("", b"\n".join(part).decode("utf-8", "replace").lower()).split("\n")
            self.values.append(self.value(plain).astype(np.float32))
            self.flags.append(np.array([[w[-1:] in (b".", b"!", b"?"), len(x) == 1 and len(w) <= 3] for w, x in zip(part, plain)]))
            for w in part:
                self.number[w] = len(self.number)
        if new:
            self.table, self.flag = np.concatenate(self.values), np.concatenate(self.flags)
            self.values, self.flags = [self.table], [self.flag]

    def read(self, texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text, the numbers of its words and of their sentences, each word once a sentence."""
        each = [t.encode("utf-8", "surrogatepass").replace(b"\n", b" \0 ").split() if t else [] for t in texts]
        if len(self.number) >= min(REMEMBERED, NUMBERS // self.table.shape[1]):
            self._forget()
        self._learn(list(set().union(*map(set, each)) - self.number.keys()))
        get = self.number.__getitem__
        for raw in each:
            ids = np.fromiter(map(get, raw), np.int64, len(raw))
            ends, single = self.flag[ids].T
            sentence = np.append(0, np.cumsum(ends & ~single)[:-1]) if len(ids) else ids
            start = np.flatnonzero(np.append(True, np.diff(sentence) > 0)) if len(ids) else ids
            size = np.diff(np.append(start, len(ids)))
            parts = -(-size // SENTENCE)
            place = np.arange(len(ids)) - np.repeat(start, size)
            sentence = np.repeat(np.cumsum(parts) - parts, size) + place // SENTENCE
            edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
            for a, b in zip(edge[::2], edge[1::2]):
                if b - a > 2:  # spelt out
                    word = b"".join(raw[a:b])
                    if word not in self.number:
                        self._learn([word])
                    ids, sentence = np.append(ids, get(word)), np.append(sentence, sentence[a])
            both = np.unique(sentence * len(self.number) + ids)
            yield both % len(self.number), both // len(self.number)

    def sums(self, texts) -> Iterator[np.ndarray]:
        """For each text, the sum of the rows of its words, by sentence; a text without words has one empty sentence."""
        for ids, sentence in self.read(texts):
            if not len(ids):
                yield self.table[:1]
                continue
            start = np.flatnonzero(np.append(True, np.diff(sentence) > 0))
            yield np.add.reduceat(self.table[ids], start, axis=0)


def _reader(landmarks: tuple[str, ...], weights: tuple[float, ...] | None = None) -> Reader:
    """The worker's reader for a model: it stays for later tasks, and so does what it remembers."""

    def make() -> Reader:
        kernel = Kernel(landmarks)
        return Reader(kernel.of if weights is None else lambda words: kernel.of(words) @ np.array(weights)[:, None])

    return keep(("toxicity", landmarks, weights), make)


def _witnesses(landmarks: tuple[str, ...], weights: np.ndarray):
    """Of each text the sentence with the largest margin."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _reader(landmarks)
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.iloc[start : start + 500]
                best = [x[int(np.argmax(x @ weights))] for x in reader.sums(part["text"])]
                yield pd.DataFrame({"label": part["label"].to_numpy(), "near": best})

    return run


def choose_landmarks(sample: DataFrame, most: int = LANDMARKS) -> list[str]:
    """From (text, label): fragments of words that speak for label 1."""
    words = F.array_distinct(F.split(F.lower("text"), SPACE))
    by_word = (
        sample.select("label", F.explode(words).alias("w"))
        .select("label", F.regexp_replace("w", r"[^\p{L}]+", "").alias("w"))
        .where(F.length("w") >= LETTERS)
        .groupBy("w")
        .agg(F.sum("label").alias("bad"), F.count("*").alias("n"))
    )
    starts = F.sequence(F.lit(1), F.greatest(F.length("w") - FRAGMENT + 1, F.lit(1)))
    parts = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("w"), i, F.lit(FRAGMENT))))
    total = sample.agg(F.avg("label")).first()[0] or 0.0
    if not 0 < total < 1:
        return []
    scored = (
        by_word.select("bad", "n", F.explode(F.array_distinct(F.concat(parts, F.array("w")))).alias("f"))
        .groupBy("f")
        .agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
        .where((F.col("bad") >= 5) & (F.col("bad") >= 0.5 * F.col("n")))
        .withColumn("z", (F.col("bad") - total * F.col("n")) / F.sqrt(total * (1 - total) * F.col("n")))
        .orderBy(F.desc("z"), "f")
        .limit(most * 12)
        .collect()
    )
    chosen: list[str] = []
    seen: list[dict[str, float]] = []
    for r in scored:
        own = subsequences(r["f"])
        size = sum(v * v for v in own.values()) ** 0.5
        own = {k: v / size for k, v in own.items()}
        if own and all(sum(v * own.get(k, 0.0) for k, v in w.items()) ** 2 < 0.6 for w in seen):
            chosen.append(r["f"])
            seen.append(own)
        if len(chosen) == most:
            break
    return chosen


def nystroem_root(landmarks) -> np.ndarray:
    """The inverse root of the landmarks' kernel matrix, each landmark taken with unit length."""
    size = np.array([sum(v * v for v in subsequences(x).values()) for x in landmarks])
    values, vectors = np.linalg.eigh(Kernel(landmarks).of(list(landmarks)) / size[:, None])
    return vectors @ np.diag(np.maximum(values, 1e-3) ** -0.5) @ vectors.T


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """The model: landmarks, what a landmark's kernel adds to a margin, and the logistic curve."""
    named = (
        labels.where(F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg(F.max(F.col(label_col)).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = cut(texts.join(named, "doc_id").select("text", "label"), "labelled")
    share = sample.agg(F.avg("label")).first()[0] or 0.0
    landmarks = tuple(choose_landmarks(sample))
    if not landmarks:
        return {"landmarks": (), "share": share}
    root, weights = nystroem_root(landmarks), np.ones(len(landmarks))
    dot = lambda column, row: F.aggregate(F.zip_with(column, F.array(*[F.lit(float(x)) for x in row]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    for _ in range(ROUNDS):
        described = sample.mapInPandas(_witnesses(landmarks, weights), "label double, near array<double>")
        ready = cut(described.select("label", "near", F.array(*[dot("near", r) for r in root]).alias("x")), "features")
        svm = LinearSVC(regParam=1e-3, maxIter=60, aggregationDepth=2).fit(ready.select("label", array_to_vector("x").alias("features")))
        weights = root @ svm.coefficients.toArray()
    margin = dot("near", weights) + float(svm.intercept)
    curve = LogisticRegression(regParam=1e-4).fit(ready.select("label", array_to_vector(F.array(margin)).alias("features")))
    return {
        "landmarks": landmarks,
        "share": share,
        "weights": tuple(float(x) for x in weights),
        "intercept": float(svm.intercept),
        "slope": float(curve.coefficients[0]),
        "offset": float(curve.intercept),
    }


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of each row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if not model["landmarks"]:
        return texts.select("doc_id", F.lit(float(model["share"])).alias("score"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _reader(model["landmarks"], model["weights"])
        for batch in batches:
            margin = np.empty(len(batch))
            for start in range(0, len(batch), 500):
                for i, x in enumerate(reader.sums(batch["text"].iloc[start : start + 500]), start):
                    margin[i] = x.max() + model["intercept"]
            value = 1 / (1 + np.exp(-(model["slope"] * margin + model["offset"])))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": value})

    return texts.mapInPandas(run, "doc_id long, score double")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def trained_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) by a model that learnt from the labels of the ids that are not held out."""
    return score(docs, fit(docs, labels.where(~held_out())))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score at least the threshold."""
    bad = trained_score(docs, labels).where(F.col("score") >= threshold).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("_bad")), "left_anti")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trained_score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
