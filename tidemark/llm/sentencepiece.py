"""SentencePiece encoding and decoding by a streaming Viterbi search.

An automaton reports the pieces that end at each character. For each place the search keeps the last piece of the way to
it, for a window of the longest piece, and as soon as the ways to all places from which the search may go on run through
one boundary, the ids before it are final: they are committed and forgotten. So memory depends on the longest piece and
not on the text, however long a stretch without spaces is.

What makes a way depends on the kind of the vocabulary; the ids are those of the vocabulary's own library for both:

* with log-probabilities a way costs the sum of its negative scores, and the cheapest one to a place stays;
* with merges a way may only join neighbours that merging their joint text would leave apart. Of the pieces that end at a
  place exactly one continues such a way, and merging the whole text up to there ends with that piece.

A character without a piece becomes its UTF-8 bytes. The text is not normalised; a space marks its start, as the
vocabulary expects, and the character that marks spaces in pieces is encoded as its bytes. Spaces start pieces (no piece has one after another character), so the stretch of one word is encoded by
itself; its committed ids are remembered in a table of limited size.

The vocabulary is read on the driver from the path that is given (its size is fixed) and broadcast. Null texts give null
ids, empty texts none; repeated rows give repeated results; only the id and text columns are read. Decoding gives an encoded
text back exactly. Of any other ids, bytes that are no UTF-8 become U+FFFD, control pieces nothing, and the unknown piece
and numbers without a piece (null, negative, too large) U+FFFD.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, keep

#: Session setting that names the vocabulary, and what is taken without it.
SETTING, MODEL = "spark.tidemark.piece.model", "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stretches whose ids a worker remembers at most, and pairs of neighbours.
REMEMBERED = 600_000
LOST = "\ufffd".encode()


def load_vocabulary(path: str = MODEL) -> dict:
    """Pieces with ids and scores (spaces written as spaces), ids of the bytes, the bytes of every id, and the kind."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    byte_ids, raw, pieces = {}, [b""] * size, {}
    for i in range(size):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            raw[i] = bytes([int(piece[3:5], 16)])
        elif sp.is_unknown(i):
            raw[i] = LOST
        elif not (sp.is_control(i) or sp.is_unused(i)):
            piece = piece.replace(MARK, " ")
            raw[i] = piece.encode()
            pieces[piece] = (i, sp.get_score(i))
    if len(byte_ids) < 256:
        raise ValueError("the vocabulary has no piece for each byte")
    # merges are scored by their rank, in whole numbers
    return {"pieces": pieces, "bytes": byte_ids, "raw": raw, "merges": all(s == int(s) for _, s in pieces.values())}


class Viterbi:
    """The streaming search. feed() takes characters and returns ids that are final; close() returns the rest."""

    def __init__(self, vocabulary: dict):
        self.pieces, self.byte_ids, self.merges = (vocabulary[k] for k in ("pieces", "bytes", "merges"))
        self.longest = max(map(len, self.pieces))
        self.automaton = ahocorasick.Automaton()
        for piece, (i, score) in self.pieces.items():
            self.automaton.add_word(piece, (len(piece), i, -score, piece))
        self.automaton.make_automaton()
        self.fallback = 10 - min(score for _, score in self.pieces.values())
        #: by piece, which pieces may follow it
        self.after: dict[str, dict[str, bool]] = {}
        self.known = 0
        self.ways: dict[str, tuple] = {}
        self._reset()

    def _reset(self) -> None:
        self.text = ""  # characters from the last committed boundary on
        self.cost = [0.0]  # of the way to each place since that boundary
        #: the last piece of the way: length, id (-1: bytes), text, what may follow it (None: anything)
        self.step: list[tuple[int, int, str, dict | None]] = [(0, -1, "", None)]

    def merged(self, text: str) -> list[str]:
        """A short text's pieces by merging: again and again the best neighbours, of equal ones the first."""
        parts, score = list(text), self.pieces
        while True:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                found = score.get(parts[i] + parts[i + 1])
                if found and found[1] > best:
                    best, at = found[1], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _may_follow(self, before: str, piece: str) -> bool:
        """Whether merging the joint text of two pieces leaves just these two."""
        if self.known >= REMEMBERED:
            for each in self.after.values():
                each.clear()
            self.known = 0
        self.known += 1
        out = self.after[before][piece] = self.merged(before + piece) == [before, piece]
        return out

    def _way(self, n: int, i: int, piece: str) -> tuple:
        return n, i, piece, self.after.setdefault(piece, {})

    def feed(self, chars: str) -> list[int]:
        out: list[int] = []
        for start in range(0, len(chars), self.longest):
            self.text += chars[start : start + self.longest]
            (self._join if self.merges else self._cheapest)()
            if len(self.text) >= 2 * self.longest:
                out += self._commit()
        return out

    def _join(self) -> None:
        """Ways to the new places that merging would leave as they are."""
        step, ways = self.step, self.ways
        place = len(step)
        for end, (n, i, _, piece) in self.automaton.iter(self.text, max(0, place - self.longest)):
            if end < place - 1:
                continue  # its way is known
            while place <= end:
                step.append(self._way(1, -1, self.text[place - 1]))
                place += 1
            _, _, before, after = step[place - n]
            if after is None or after.get(piece) or (piece not in after and self._may_follow(before, piece)):
                step.append(ways.get(piece) or ways.setdefault(piece, self._way(n, i, piece)))
                place += 1
        while place <= len(self.text):
            step.append(self._way(1, -1, self.text[place - 1]))
            place += 1

    def _cheapest(self) -> None:
        """The cheapest ways to the new places; without a piece that ends there, its character becomes bytes."""
        cost, step, text = self.cost, self.step, self.text
        place, first = len(step), max(0, len(step) - self.longest)
        ends: list[list] = [[] for _ in range(len(text) - place + 1)]
        for end, found in self.automaton.iter(text, first):
            if end >= place - 1:
                ends[end + 1 - place].append(found)
        for at, found in enumerate(ends, place):
            best, way = min(((cost[at - n] + c, (n, i, piece, None)) for n, i, c, piece in found), key=lambda x: x[0], default=(math.inf, None))
            if way is None:
                best, way = cost[-1] + self.fallback, (1, -1, text[at - 1], None)
            cost.append(best)
            step.append(way)

    def _commit(self) -> list[int]:
        """Ids up to the last boundary that the ways to all places still in reach share."""
        end = len(self.text)
        live = set(range(max(0, end - self.longest + 1), end + 1))
        while len(live) > 1:
            far = max(live)
            live.discard(far)
            live.add(far - self.step[far][0])
        at = live.pop()
        out, floor = self._ids(at), self.cost[at] if at < len(self.cost) else 0.0
        self.text, self.cost = self.text[at:], [c - floor for c in self.cost[at:]] or [0.0]
        self.step = [(0, -1, *self.step[at][2:]), *self.step[at + 1 :]]  # what follows is still joined to the last piece
        return out

    def _ids(self, at: int) -> list[int]:
        back: list[int] = []
        while at > 0:
            n, i, piece, _ = self.step[at]
            back += [i] if i >= 0 else [self.byte_ids[b] for b in reversed(piece.encode("utf-8", "surrogatepass"))]
            at -= n
        return back[::-1]

    def close(self) -> list[int]:
        out = self._ids(len(self.text))
        self._reset()
        return out


class Coder:
    """Encodes and decodes whole texts."""

    def __init__(self, vocabulary: dict):
        self.search, self.raw, self.seen = Viterbi(vocabulary), vocabulary["raw"], {}
        inner = any(" " in p.lstrip(" ") for p in vocabulary["pieces"])
        self.stretch = re.compile(r"(?s).+" if inner else r" *[^ ]+| +")

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        seen = self.seen
        for part in self.stretch.findall(" " + text):
            ids = seen.get(part)
            if ids is None:
                ids = self.search.feed(part) + self.search.close()
                if len(part) <= 64:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[part] = tuple(ids)
            out += ids
        return out

    def decode(self, ids) -> str:
        raw = self.raw
        try:
            whole = b"".join([raw[i] for i in ids])
            if len(ids) and min(ids) < 0:
                raise IndexError
        except (IndexError, TypeError):
            whole = b"".join([raw[i] if i is not None and 0 <= i < len(raw) else LOST for i in ids])
        text = whole.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _coder(shared) -> Coder:
    """The worker's coder: it stays for later tasks, and so does what it remembers."""
    return keep(("sentencepiece", shared.id), lambda: Coder(shared.value))


class _Shared:
    """A broadcast vocabulary with a name for it."""

    def __init__(self, spark: SparkSession, path: str | None):
        self.id = path = path or spark.conf.get(SETTING, MODEL)
        self._broadcast = spark.sparkContext.broadcast(load_vocabulary(path))

    @property
    def value(self) -> dict:
        return self._broadcast.value


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids, ids_sha256, restored): the ids of each text, and whether they decode to it."""
    shared = _Shared(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(shared)
        for batch in batches:
            rows = []
            for start in range(0, len(batch), 500):  # ids of a few texts at a time
                rows = []
                part = batch.iloc[start : start + 500]
                for key, text in zip(part["doc_id"], part["text"]):
                    if text is None:
                        rows.append((key, None, None, None, None))
                        continue
                    ids = np.array(coder.encode(text), np.int32)
                    digest = hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()
                    rows.append((key, len(ids), ids, digest, coder.decode(ids.tolist()) == text))
                out = pd.DataFrame(rows, columns=["doc_id", "n_ids", "ids", "ids_sha256", "restored"])
                out["doc_id"], out["n_ids"] = out["doc_id"].astype("Int64"), out["n_ids"].astype("Int64")
                out["restored"] = out["restored"].astype("boolean")
                yield out

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInPandas(run, "doc_id long, n_ids long, ids array<int>, ids_sha256 string, restored boolean")


def decode(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids; null ids give null."""
    shared = _Shared(rows.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(shared)
        for batch in batches:
            # with a null among them, ids come as floats
            texts = [None if ids is None else coder.decode([None if i is None or i != i else int(i) for i in ids]) for ids in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": pd.Series(texts, dtype=object)})

    out = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return out.mapInPandas(run, "doc_id long, text string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir)).select("doc_id", "n_ids", "ids_sha256", "restored")
