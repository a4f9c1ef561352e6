"""Removal of repeated 20-word passages by recompression.

A text is a sequence of symbols, first the names of its four-word phrases. A round of recompression replaces runs of
one symbol by a run symbol, then adjacent symbols of a left and a right class by a pair symbol. Names are fingerprints
of what they replace, so every Spark task gives equal material the same name with no dictionary to exchange. Whether a
symbol joins a neighbour depends on that neighbour alone, so equal passages agree in all symbols but a few next to
their ends: after two rounds, every symbol between the 5th and the 12th phrase of a 20-word window is the same wherever
the window occurs. Each window is represented by the least-named symbol of that stretch (runs are taken as repeated at
once); Spark deals those symbols out by name, and only windows whose symbol occurs twice are looked at further. They are
dealt out by the fingerprint of their own 20 words (96 bits), which verifies them and finds the first one; a phrase that
many texts share without a common window is spread over all buckets by that.

Payloads travel as packed arrays, at most one row per bucket and batch (none without an entry), and what a batch knows to
be repeated within itself is not sent to the name's bucket again: a passage that a third of all texts share costs its
bucket one entry per batch. The number of buckets follows the characters read.

Defined results: null or empty text has no words; a text under 20 words keeps them all. Documents stand in the order of
their ids, and rows that share an id but not the text in the order of a hash of the text; equal rows with one id are the
same occurrence, so neither is removed. A row without id is left as it is; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, gram_names, join_names, mix, word_names

WINDOW = 20
PHRASE = 4
#: Phrases of a window whose symbols are the same in every occurrence: from EDGE up to EDGE + ZONE.
EDGE, ZONE = 5, WINDOW - PHRASE + 1 - 10
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Characters that a task turns into symbols at once.
SLICE_CHARS = 24_000_000
BUCKET_CHARS = 12_000_000
#: Words of short texts that are looked at together; longer texts go alone.
TOGETHER = 1 << 15


def _pairs(names, starts, ends, barrier, salt):
    """Joins each left-class symbol with a right-class one after it."""
    right = (mix(names + np.uint64(salt)) & np.uint64(1)).astype(bool)
    first = np.zeros(len(names), bool)
    first[:-1] = ~right[:-1] & right[1:] & ~barrier[:-1] & ~barrier[1:]
    at = np.flatnonzero(first)
    names, ends = names.copy(), ends.copy()
    names[at] = join_names(names[at], names[at + 1])
    ends[at] = ends[at + 1]
    keep = np.ones(len(names), bool)
    keep[at + 1] = False
    return names[keep], starts[keep], ends[keep], barrier[keep]


def symbols(words: np.ndarray, foreign: np.ndarray | None = None):
    """Names, first and end phrase of the symbols after the rounds, and which of them are runs.

    foreign: the phrases that reach from one text into the next; they join nothing and count as runs.
    """
    names = gram_names(words, PHRASE)
    new = np.append(True, names[1:] != names[:-1])
    if foreign is not None:
        new[foreign] = True
        new[1:][foreign[:-1]] = True
    cuts = np.flatnonzero(new)
    sizes = np.diff(np.append(cuts, len(names)))
    if (sizes >= 3).any():  # a run symbol; runs of two stay as they are
        run = np.repeat(sizes >= 3, sizes)
        keep = ~run
        keep[cuts] = True
        starts = np.flatnonzero(keep)
        ends = np.append(starts[1:], len(names))
        names, barrier = names[starts], run[starts]
    else:
        starts = np.arange(len(names))
        ends, barrier = starts + 1, np.zeros(len(names), bool)
    if foreign is not None:
        barrier = barrier | foreign[starts]
    for salt in (1, 2):
        names, starts, ends, barrier = _pairs(names, starts, ends, barrier, salt)
    return names, starts, ends, barrier


def representatives(words: np.ndarray, foreign: np.ndarray | None = None):
    """For each window: the name and index of its least symbol, and whether a run lies in its stretch.

    With several texts on end, what is said of a window that reaches into the next text means nothing.
    """
    n = len(words) - WINDOW + 1
    names, starts, ends, barrier = symbols(words, foreign)
    # how many symbols start, and end, before a phrase
    phrases = len(words) - PHRASE + 1
    flags = np.zeros((2, phrases + 2), np.int32)
    flags[0, starts + 1] = 1
    flags[1, ends] = 1
    started, ended = np.cumsum(flags, axis=1, dtype=np.int32)
    low, high = started[EDGE : EDGE + n], ended[EDGE + ZONE : EDGE + ZONE + n]
    worth = np.append(np.where(barrier, _TOP, names), np.full(ZONE, _TOP))
    best, where = np.full(n, _TOP), np.zeros(n, np.int32)
    for t in range(int((high - low).max(initial=0))):
        at = low + np.int32(t)
        value = worth[at]
        less = (value < best) & (at < high)
        np.copyto(best, value, where=less)
        np.copyto(where, at, where=less)
    runs = np.zeros(phrases + 1, np.int32)
    runs[starts[barrier]] += 1
    runs[ends[barrier]] -= 1
    in_run = np.append(0, np.cumsum(np.cumsum(runs)[:-1] > 0, dtype=np.int32))
    run = in_run[EDGE + ZONE : EDGE + ZONE + n] > in_run[EDGE : EDGE + n]
    return best, where, run | (best == _TOP)


class _Texts:
    """Texts of a window or more on end, so that short ones cost no calls of their own."""

    def __init__(self, found: list[tuple[int, np.ndarray]]):
        self.place = np.array([i for i, _ in found])
        sizes = [len(x) for _, x in found]
        self.words = np.concatenate([x for _, x in found])
        owner = np.repeat(np.arange(len(found), dtype=np.int32), sizes)
        n = len(owner) - WINDOW + 1
        best, where, run = representatives(self.words, owner[: 1 - PHRASE] != owner[PHRASE - 1 :])
        self.owner, self.valid = owner[:n], owner[:n] == owner[WINDOW - 1 :]
        self.start = np.cumsum([0, *sizes[:-1]])
        self.run, self.where = run & self.valid, where
        # each chosen symbol once for every place where it stands
        clear = self.valid & ~run
        of = where[clear]
        size = int(of.max(initial=-1)) + 1
        name, text, chosen = np.zeros(size, np.uint64), np.zeros(size, np.int32), np.zeros(size, bool)
        name[of], text[of], chosen[of] = best[clear], self.owner[clear], True
        self.clear, self.index = clear, np.flatnonzero(chosen)
        self.name, self.text = name[self.index], text[self.index]

    def hits(self, names: list) -> np.ndarray:
        """The windows with a run, or whose symbol is among the names that belong to their text (of each text of the part)."""
        own = [np.asarray([] if names[i] is None else names[i], np.int64).view(np.uint64) for i in self.place]
        salt = mix(np.arange(1, len(own) + 1, dtype=np.uint64))  # a chance meeting only adds a window to look at
        wanted = np.concatenate(own) ^ np.repeat(salt, [len(x) for x in own])
        found = np.zeros(int(self.index.max(initial=-1)) + 1, bool)
        found[self.index] = np.isin(self.name ^ salt[self.text], wanted)
        out = self.run.copy()
        out[self.clear] = found[self.where[self.clear]]
        return np.flatnonzero(out)


def _together(part: pd.DataFrame) -> Iterator[_Texts]:
    found, size = [], 0
    for i, text in enumerate(part["text"]):
        words = word_names(text)
        if len(words) >= WINDOW:
            found.append((i, words))
            size += len(words)
        if size >= TOGETHER:
            yield _Texts(found)
            found, size = [], 0
    if found:
        yield _Texts(found)


def _window_names(words: np.ndarray) -> np.ndarray:
    two = join_names(words[:-1], words[1:])
    four = join_names(two[:-2], two[2:])
    eight = join_names(four[:-4], four[4:])
    sixteen = join_names(eight[:-8], eight[8:])
    n = len(words) - WINDOW + 1
    return join_names(sixteen[:n], four[16 : 16 + n])


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        size = batch["text"].str.len().fillna(0).cumsum() // SLICE_CHARS
        for _, part in batch.groupby(size.to_numpy(), sort=False):
            yield part


#: A document's key: its id and a hash of its text.
KEY = np.dtype([("id", "<i8"), ("h", "<i8")])


def _keys(part: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(part), KEY)
    out["id"], out["h"] = part["doc_id"], part["h"]
    return out


def _order(docs: np.ndarray, *less) -> np.ndarray:
    """The order by document; less: what else counts, the least first."""
    return np.lexsort((*less, docs["h"], docs["id"]))


def _packed(bucket: int, kind: int, docs: np.ndarray, *values: np.ndarray) -> tuple:
    """Documents (ordered) as runs."""
    start = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])) if len(docs) else np.empty(0, np.int64)
    sizes = np.diff(np.append(start, len(docs))).astype(np.uint32)
    return (bucket, kind, docs[start].tobytes(), sizes.tobytes(), *(v.tobytes() for v in values))


def _unpacked(group: pd.DataFrame) -> np.ndarray:
    return np.concatenate([np.repeat(np.frombuffer(x, KEY), np.frombuffer(n, np.uint32)) for x, n in zip(group["docs"], group["sizes"])])


#: kind 0: seen once in its batch; 1: seen more often there; 2: known to be repeated, sent anywhere.
def _send_symbols(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _slices(batches):
            docs, names, twice, with_runs = [], [], [], []
            keys = _keys(part)
            for texts in _together(part):
                order = np.lexsort((texts.name, texts.text))
                own, text = texts.name[order], texts.text[order]
                start = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (text[1:] != text[:-1]))) if len(own) else order
                docs.append(keys[texts.place[text[start]]])
                names.append(own[start])
                twice.append(np.diff(np.append(start, len(own))) > 1)
                with_runs.append(keys[texts.place[np.unique(texts.owner[texts.run])]])
            if not docs:
                continue
            docs, names, twice, with_runs = map(np.concatenate, (docs, names, twice, with_runs))
            rows = []
            deal = int(names[0] % np.uint64(buckets)) if len(names) else 0
            if len(with_runs):  # these have windows to look at in any case
                rows.append(_packed(deal, 2, with_runs, np.full(len(with_runs), _TOP)))
            if not len(names):
                yield pd.DataFrame(rows, columns=["bucket", "kind", "docs", "sizes", "names"])
                continue
            order = np.argsort(names, kind="stable")
            docs, names, twice = docs[order], names[order], twice[order]
            head = np.append(True, names[1:] != names[:-1])
            count = np.diff(np.append(np.flatnonzero(head), len(names)))
            often = np.repeat(count > 1, count) | np.repeat(np.logical_or.reduceat(twice, np.flatnonzero(head)), count)
            rest = np.flatnonzero(~head)
            if len(rest):
                rest = rest[_order(docs[rest])]
                rows.append(_packed(int(names[0] % np.uint64(buckets)), 2, docs[rest], names[rest]))
            bucket = (names % np.uint64(buckets)).astype(np.int64)
            for kind, own in ((0, head & ~often), (1, head & often)):
                at = np.flatnonzero(own)
                at = at[np.lexsort((docs["h"][at], docs["id"][at], bucket[at]))]
                for group in np.split(at, np.flatnonzero(np.diff(bucket[at])) + 1):
                    if len(group):
                        rows.append(_packed(int(bucket[group[0]]), kind, docs[group], names[group]))
            yield pd.DataFrame(rows, columns=["bucket", "kind", "docs", "sizes", "names"])

    return run


def _repeated_symbols(group: pd.DataFrame) -> pd.DataFrame:
    names = [np.frombuffer(x, np.uint64) for x in group["names"]]
    kind = np.repeat(group["kind"].to_numpy(), [len(x) for x in names])
    docs, names = _unpacked(group), np.concatenate(names)
    here = kind < 2
    values, place, count = np.unique(names[here], return_inverse=True, return_counts=True)
    count[place[kind[here] == 1]] += 1
    keep = ~here
    keep[np.flatnonzero(here)[count[place] > 1]] = True
    return pd.DataFrame({"doc_id": docs["id"][keep], "h": docs["h"][keep], "name": names[keep].view(np.int64)})


def _send_windows(buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _slices(batches):
            cols: list[list] = [[], [], [], [], []]
            keys, names = _keys(part), part["names"].tolist()
            for texts in _together(part):
                at = texts.hits(names)
                own = texts.owner[at]
                whole = _window_names(texts.words)[at]
                check = (_window_names(mix(texts.words + np.uint64(7)))[at] >> np.uint64(32)).astype(np.uint32)
                for c, x in zip(cols, (keys[texts.place[own]], (at - texts.start[own]).astype(np.uint32), whole, check, (whole % np.uint64(buckets)).astype(np.int64))):
                    c.append(x)
            if not cols[0]:
                continue
            docs, at, whole, check, deal = map(np.concatenate, cols)
            first = _first(whole, check, docs, at)
            rows = []
            late = np.flatnonzero(~first)
            if len(late):
                late = late[_order(docs[late], at[late])]
                rows.append(_packed(int(whole[0] % np.uint64(buckets)), 2, docs[late], at[late], whole[:0], check[:0]))
            own = np.flatnonzero(first)
            own = own[np.lexsort((at[own], docs["h"][own], docs["id"][own], deal[own]))]
            for group in np.split(own, np.flatnonzero(np.diff(deal[own])) + 1):
                if len(group):
                    rows.append(_packed(int(deal[group[0]]), 0, docs[group], at[group], whole[group], check[group]))
            yield pd.DataFrame(rows, columns=["bucket", "kind", "docs", "sizes", "at", "whole", "check"])

    return run


def _first(whole, check, docs, at) -> np.ndarray:
    """Which windows are the first of their words; equal ids and starts are one occurrence."""
    if not len(whole):
        return np.zeros(0, bool)
    order = np.lexsort((at, docs["h"], docs["id"], check, whole))
    w, c, d, a = whole[order], check[order], docs[order], at[order]
    head = np.append(True, (w[1:] != w[:-1]) | (c[1:] != c[:-1]))
    which = np.cumsum(head) - 1
    start = np.flatnonzero(head)
    first = (d == d[start][which]) & (a == a[start][which])
    out = np.empty(len(order), bool)
    out[order] = first
    return out


def _late_windows(group: pd.DataFrame) -> pd.DataFrame:
    """Stretches of consecutive starts of windows that are not the first, by document."""
    docs = _unpacked(group)
    at = np.concatenate([np.frombuffer(x, np.uint32) for x in group["at"]])
    sent = np.concatenate([np.full(len(x) // 4, k == 0) for x, k in zip(group["at"], group["kind"])])
    whole = np.concatenate([np.frombuffer(x, np.uint64) for x in group["whole"]])
    check = np.concatenate([np.frombuffer(x, np.uint32) for x in group["check"]])
    late = ~sent
    late[np.flatnonzero(sent)[~_first(whole, check, docs[sent], at[sent])]] = True
    docs, at = docs[late], at[late].astype(np.int64)
    order = _order(docs, at)
    docs, at = docs[order], at[order]
    if not len(docs):
        return pd.DataFrame({"doc_id": docs["id"], "h": docs["h"], "low": at.astype(np.int32), "high": at.astype(np.int32)})
    head = np.append(True, (docs[1:] != docs[:-1]) | (at[1:] > at[:-1] + 1))
    start = np.flatnonzero(head)
    end = np.append(start[1:], len(docs)) - 1
    return pd.DataFrame({"doc_id": docs["id"][start], "h": docs["h"][start], "low": at[start].astype(np.int32), "high": at[end].astype(np.int32)})


def _kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, text, low, high in zip(batch["doc_id"], batch["text"], batch["low"], batch["high"]):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            gone = np.zeros(len(words) + 1, np.int64)
            if low is not None and len(low):
                np.add.at(gone, np.asarray(low), 1)
                np.add.at(gone, np.asarray(high) + WINDOW, -1)
            keep = np.cumsum(gone)[:-1] == 0
            left = [w for w, k in zip(words, keep) if k] if not keep.all() else words
            rows.append((key, len(words), len(words) - len(left), b" ".join(left).decode("utf-8", "surrogatepass")))
        out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_text"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of each row: the words not covered by a window that starts earlier too."""
    all_ = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("h"))
    buckets = 16 + (all_.agg(F.sum(F.length("text"))).first()[0] or 0) // BUCKET_CHARS
    key = ["doc_id", "h"]
    texts = all_.where("doc_id IS NOT NULL")
    sent = texts.mapInPandas(_send_symbols(buckets), "bucket long, kind int, docs binary, sizes binary, names binary")
    repeated = sent.groupBy("bucket").applyInPandas(_repeated_symbols, "doc_id long, h long, name long")
    by_doc = repeated.groupBy(*key).agg(F.collect_set("name").alias("names"))
    looked = texts.join(by_doc, key)
    windows = looked.mapInPandas(_send_windows(buckets), "bucket long, kind int, docs binary, sizes binary, at binary, whole binary, check binary")
    late = windows.groupBy("bucket").applyInPandas(_late_windows, "doc_id long, h long, low int, high int")
    gone = late.groupBy(*key).agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))
    out = "doc_id long, n_words long, n_removed long, kept_text string"
    known = texts.join(gone, key, "left").mapInPandas(_kept, out)
    nobody = all_.where("doc_id IS NULL").select("doc_id", "text", *[F.lit(None).cast("array<int>").alias(c) for c in ("low", "high")])
    return known.unionByName(nobody.mapInPandas(_kept, out))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256")
    )
