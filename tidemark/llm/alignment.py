"""Alignment of two tokenizers over the same texts, by exact-text deduplication.

Texts are shuffled by the full text, so each distinct one is tokenised by both vocabularies and aligned once, with the number
of its documents as its weight; a group of copies combines within each task before the exchange. The byte offsets at
which tokens of A and of B both end cut the tokens into groups, and every A token is linked with every B token of its group. An
id pair's count is how many documents hold it linked: the pairs of a distinct text, once each, times its weight. Each text's links are
then measured against these counts and the measures are joined to the documents.

* Both vocabularies end tokens where spaces follow another character, so a text is cut there, and a stretch ("the word with the
  spaces before it") has the same tokens in every text. A worker encodes a stretch once by the tokenizers' own libraries and
  remembers a limited number of short ones. Offsets, groups and links of some texts at a time are arrays.
* A distinct text keeps its different id pairs with their numbers of links, as two arrays in a table in the shared folder.
  Pairs are counted with partial aggregation, so a pair that all texts share is no hot key; the counts (a row for each different pair, not
  for each text) are broadcast when there are at most SMALL of them, and joined by an exchange with skew handling otherwise.
* Documents meet their measures by a 128-bit name of the text. Names of more than a thousandth of the rows (there are fewer than a
  thousand) are broadcast, so the copies of a text stay where they are.

Defined results: null and empty texts, and texts whose joined token bytes are not the text after one space (for instance with the character
that marks spaces in pieces), have no tokens: zeros and an empty digest. Documents are rows: rows that share an id, or have none, or
are equal, count one by one. An empty table has no result. Only the id and text columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe_words import Library
from tidemark.llm.common import cut, documents, join_by_name, keep

#: Session settings that name the two vocabularies, and what is taken without them.
SETTING_A, A = "spark.tidemark.align.a", "/opt/tokenizers/byte_bpe_50k.json"
SETTING_B, B = "spark.tidemark.align.b", "/opt/tokenizers/piece_bpe_32k.model"
#: Stretches that a worker remembers at most, and the longest of them in characters.
REMEMBERED, LONGEST = 200_000, 48
#: So many different pairs are broadcast at most.
SMALL = 1_000_000
#: Characters of texts that are aligned at a time (or one text), and links of one group that are made one by one.
TOGETHER, LINKS = 1 << 19, 4096
MARK = "▁"
#: Stretches: what stands between two places where spaces begin after something else. Both vocabularies end a token there. A last
#: space goes with the word before it: B, which puts a stretch's first space itself, gives an empty text no token.
_STRETCH = re.compile(r"\s*(?:\S+(?:[^\S ]\s*)?)+(?: \Z)?|\s+")

#: Stretches that A's library takes together, joined: one space and Latin letters, digits or marks.
_WORD = re.compile(r" [!-~\xa1-\xac\xae-\u024f]+")
AT_ONCE = 4000


class Aligner:
    """Both vocabularies, and the tokens of stretches."""

    def __init__(self, a: str, b: bytes):
        import sentencepiece

        self.a = Library(a, special=False)  # strings of special tokens are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        bytes_of = {c: n for n, c in self.a.table.items()}
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(bytes_of[c] for c in token) if all(c in bytes_of for c in token) else token.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode())
        self.n_a, self.n_b = len(self.a_bytes), len(self.b_bytes)
        self.a_len, self.b_len = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes))
        #: what a token adds to the text of the groups: within or at the end of its part
        self.told = [f"{i}{end}" for n, ends in ((self.n_a, ",|"), (self.n_b, ",;")) for end in ends for i in range(n)]
        inner = any(MARK in self.b.id_to_piece(i).lstrip(MARK) for i in range(self.n_b))
        self.stretch = re.compile(r"(?s).+") if inner else _STRETCH
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        added = self.a.tokenizer.get_added_tokens_decoder().values()
        self.joined = self.a.spaced and not self.a.lower and not inner and all(t.special for t in added)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a worker has one core

    def _ids_a(self, parts: list[str]) -> tuple[bytes, np.ndarray]:
        """A's ids of all parts, one after another, and how many each part has. Ordinary parts are given to the library some
        thousands at a time: its pattern splits them where it would split the text."""
        out: list[bytes] = [b""] * len(parts)
        plain = [i for i, p in enumerate(parts) if _WORD.fullmatch(p)] if self.joined else []
        for at in range(0, len(plain), AT_ONCE):
            some = plain[at : at + AT_ONCE]
            text = "".join([parts[i] for i in some])
            ids = np.array(self.a.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum([len(parts[i].encode()) for i in some])
            told = np.cumsum(self.a_len[ids])
            last = np.searchsorted(told, ends)
            if len(told) and told[-1] == ends[-1] and (told[last] == ends).all():
                packed, start = ids.tobytes(), 0
                for i, stop in zip(some, (4 * last + 4).tolist()):
                    out[i], start = packed[start:stop], stop
        out = [x or self.a.ids(p) for x, p in zip(out, parts)]
        return b"".join(out), np.array([len(x) // 4 for x in out])

    def _learn(self, parts: list[str]) -> None:
        if not parts:
            return
        a, of_a = self._ids_a(parts)
        each = self.b.encode([p[1:] for p in parts], num_threads=1)  # it puts the first space itself
        b, of_b = array("I", chain.from_iterable(each)).tobytes(), np.array([len(x) for x in each])
        sides = []
        for packed, of, table, sizes in ((a, of_a, self.a_bytes, self.a_len), (b, of_b, self.b_bytes, self.b_len)):
            ids = np.frombuffer(packed, "<u4")
            ends = np.cumsum(of)
            sides += [ends.tolist(), np.append(0, np.cumsum(sizes[ids]))[ends].tolist(), b"".join([table[i] for i in ids.tolist()])]
        ends_a, bytes_a, said_a, ends_b, bytes_b, said_b = sides
        i = j = x = y = 0
        for part, i2, x2, j2, y2 in zip(parts, ends_a, bytes_a, ends_b, bytes_b):
            same = said_a[x:x2] == part.encode("utf-8", "surrogatepass") == said_b[y:y2]
            self.known[part] = (a[4 * i : 4 * i2], b[4 * j : 4 * j2]) if same else None
            i, x, j, y = i2, x2, j2, y2

    def align(self, texts: list[str | None]) -> Iterator[tuple[int, dict]]:
        """(place, measures with different pairs and their links) of the texts that have tokens; a pair is A's id * size of B + B's id."""
        waiting: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            if not text:
                continue
            waiting.append((i, self.stretch.findall(" " + text)))
            size += len(text)
            if size >= TOGETHER:
                yield from self._together(waiting)
                waiting, size = [], 0
        if waiting:
            yield from self._together(waiting)

    def _together(self, waiting: list[tuple[int, list[str]]]) -> Iterator[tuple[int, dict]]:
        known = self.known
        new = {p for _, parts in waiting for p in parts if p not in known}
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = {p for _, parts in waiting for p in parts}
        self._learn(list(new))
        places, a, b = [], [], []
        for i, parts in waiting:
            got = [known[p] for p in parts]
            if None not in got:
                places.append(i)
                a.append(b"".join([x for x, _ in got]))
                b.append(b"".join([y for _, y in got]))
        for part in new:
            if len(part) > LONGEST:
                del known[part]
        if places:
            yield from zip(places, self._measured(a, b))

    def _measured(self, packed_a: list[bytes], packed_b: list[bytes]) -> Iterator[dict]:
        """The measures of texts by the tokens of both sides."""
        a, b = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (packed_a, packed_b))
        of_a, of_b = (np.array([len(x) // 4 for x in side]) for side in (packed_a, packed_b))
        ends_a, ends_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        at = np.zeros(int(ends_a[-1]) + 1, np.uint8)
        at[ends_a] = 1
        at[ends_b] |= 2
        both = at == 3
        group_at = np.cumsum(both)
        group_a, group_b = (group_at[e] - both[e] for e in (ends_a, ends_b))
        n = int(group_at[-1])
        in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        from_a, from_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        text_ends = ends_a[np.cumsum(of_a) - 1]
        text_of = np.searchsorted(text_ends, np.flatnonzero(both))
        groups = np.bincount(text_of, minlength=len(of_a))
        links = np.zeros(len(of_a), np.int64)
        np.add.at(links, text_of, in_a * in_b)

        # different pairs of each text; a long group is taken by its different ids, so it doesn't grow to its square
        short = in_a * in_b <= LINKS
        times = np.where(short, in_b, 0)[group_a]
        left = np.repeat(np.arange(len(a)), times)
        right = from_b[group_a[left]] + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        size = self.n_a * self.n_b
        keys = [text_of[group_a[left]] * size + a[left] * self.n_b + b[right]]
        counts = [np.ones(len(left), np.int64)]
        for g in np.flatnonzero(~short):
            (ua, ka), (ub, kb) = (np.unique(x[s : s + k], return_counts=True) for x, s, k in ((a, from_a[g], in_a[g]), (b, from_b[g], in_b[g])))
            keys.append((text_of[g] * size + ua[:, None] * self.n_b + ub).ravel())
            counts.append((ka[:, None] * kb).ravel())
        key, count = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, count = key[first], np.add.reduceat(count, first)
        cuts = np.searchsorted(key, np.arange(1, len(of_a)) * size)

        # A's tokens of a group, then B's
        after_a, after_b = np.cumsum(in_a), np.cumsum(in_b)
        word = np.empty(len(a) + len(b), np.int64)
        i, j = np.arange(len(a)), np.arange(len(b))
        word[i + from_b[group_a]] = a + self.n_a * (i == after_a[group_a] - 1)
        word[j + after_a[group_b]] = 2 * self.n_a + b + self.n_b * (j == after_b[group_b] - 1)
        told = self.told
        start = 0
        for t, (pairs, k) in enumerate(zip(np.split(key, cuts), np.split(count, cuts))):
            stop = start + of_a[t] + of_b[t]
            text = "".join([told[x] for x in word[start:stop].tolist()])
            start = stop
            digest = hashlib.sha256(text[:-1].encode()).hexdigest()
            yield {"n_a": int(of_a[t]), "n_b": int(of_b[t]), "n_groups": int(groups[t]), "n_links": int(links[t]), "groups_sha256": digest, "pairs": pairs - t * size, "links": k}


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def _sizes(a: str, b: bytes) -> tuple[int, int]:
    import sentencepiece

    told = json.loads(a)
    ids = [*told["model"]["vocab"].values(), *(t["id"] for t in told.get("added_tokens", []))]
    return 1 + max(ids), sentencepiece.SentencePieceProcessor(model_proto=b).get_piece_size()


def aligned_texts(texts: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """(h1, h2, weight, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links) of each distinct text (column text) that has
    tokens; a pair is A's id * size of B + B's id."""
    spark = texts.sparkSession
    path_a, path_b = a or spark.conf.get(SETTING_A, A), b or spark.conf.get(SETTING_B, B)
    with open(path_a, encoding="utf-8") as f, open(path_b, "rb") as g:  # of fixed size
        vocabularies = f.read(), g.read()
    shared = spark.sparkContext.broadcast(vocabularies)
    n_a, n_b = _sizes(*vocabularies)
    kind = "int" if n_a * n_b < 1 << 31 else "long"
    lists = pa.list_(pa.int32() if kind == "int" else pa.int64())
    schema = pa.schema([(c, pa.int64()) for c in ("h1", "h2", "weight", *_NUMBERS)] + [("groups_sha256", pa.string()), ("pairs", lists), ("links", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = keep(("aligner", path_a, path_b), lambda: Aligner(*shared.value))
        for batch in batches:
            names = [batch[c].to_pylist() for c in ("h1", "h2", "weight")]
            rows, size = [], 0
            for i, got in aligner.align(batch["text"].to_pylist()):
                rows.append({c: x[i] for c, x in zip(("h1", "h2", "weight"), names)} | got)
                size += len(got["pairs"])
                if size >= 1 << 19:
                    yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)
                    rows, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)

    distinct = texts.where("text <> ''").groupBy("text").agg(F.count("*").alias("weight"))
    named = distinct.select("text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "weight")
    columns = f"h1 long, h2 long, weight long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<{kind}>, links array<long>"
    return cut(named.mapInArrow(run, columns), "aligned").withColumn("n_second", F.lit(n_b))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): in how many documents each id pair is linked, and whether no pair of its A id is in more."""
    each = aligned.select("weight", "n_second", F.explode("pairs").alias("pair"))
    counts = cut(each.groupBy("pair", F.expr("pair div n_second").alias("a")).agg(F.sum("weight").alias("count")), "pairs")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return cut(counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "counts")


def align(docs: DataFrame, a: str | None = None, b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of docs."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    aligned = aligned_texts(texts.select("text"), a, b)
    counts = pair_counts(aligned)
    if counts.count() <= SMALL:
        counts = F.broadcast(counts)
    key = ["h1", "h2"]
    each = aligned.select(*key, F.explode(F.arrays_zip("pairs", "links")).alias("l")).select(*key, F.col("l.pairs").alias("pair"), F.col("l.links").alias("links"))
    best = F.when(F.col("best"), F.col("links")).otherwise(0)
    sums = each.join(counts, "pair").groupBy(*key).agg(F.sum(best).alias("n_best"), F.sum(F.col("links") * F.col("count")).alias("count_sum"))
    numbers = [*_NUMBERS, "n_best", "count_sum"]
    measures = aligned.drop("pairs", "links").join(sums, key).select(*key, F.col("weight").alias("count"), *numbers, "groups_sha256")
    rows = texts.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    out = join_by_name(rows, measures, key, [*numbers, "groups_sha256"], "left")
    return out.select("doc_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))
