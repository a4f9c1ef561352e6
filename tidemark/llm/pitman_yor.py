"""Language-model scores of texts by a hierarchical Pitman-Yor model.

Tokens are the words of a text in lower case (A to Z) and one end. The restaurant of a context - the token before - serves
the tokens that follow it; all contexts share the root restaurant as their parent, whose customers are their tables, and
the root's own parent is uniform over the training vocabulary and one unknown token. The seating is sampled by Gibbs: a
customer leaves its table and sits down again given the seats of all others. Contexts are swept, then the root given the
contexts' tables (one seating for each sample), then the contexts again given each of these roots. The score of a token is
the mean of its predictive probabilities over the samples, each taken with the root and the tables of that sample. A sweep
moves every customer of every dish. It takes STEPS steps at most: a dish of up to so many customers moves one in a step, a
larger one an equal part of them, which sit down given the seats of all that stay. Discounts follow from how many dishes
have one and two customers; strengths are parameters.

How it runs: a slice of the texts counts its distinct pairs (context, token) and sends them, packed, to the parts of their
contexts; which text holds which pair goes to a row of the slice itself. That one exchange is read by all later steps.
Parts add up their dishes and tell cells of words how often each word is served and how many tables it has; cells seat
the root and send back what the parts asked for; parts send each slice one probability for each of its pairs, in the order
in which they came. So texts are read once, names of pairs travel once, and totals (customers, vocabulary, discounts)
travel with the replies. Contexts and pairs that a sample of the texts shows to be common are dealt over all parts: their
totals go through cell 0, a part seats its own share of their customers, and tables elsewhere are taken from the round
before. Customers of different dishes that move in one step see the tables from before it.

Parts and cells follow the characters read; a slice sends a part nothing if it has none of its contexts, so its messages
are never more than its contexts. Word fingerprints have 56 bits.

Learning uses the rows whose crc32(id as text) mod 7 is not 2. A null text counts as an empty one (its only token is
the end); repeated rows give repeated results and count as often; without training rows every probability is 1; a row
without id is held out; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, join_names, mix, word_names

STRENGTH_ROOT, STRENGTH = 1.0, 1.0
SAMPLES = 2
#: Dishes of more customers start with about as many tables as they may have, others with one.
MOVES = 24
#: A sweep takes so many steps at most; a step moves up to a STEPS-th of a dish's customers, rounded up.
STEPS = 256
SLICE_CHARS, PART_CHARS = 16_000_000, 16_000_000
#: Cells of words, at most, so that a part never sends more rows than this.
CELLS = 1 << 16
#: Word fingerprints are 56 bits: the last byte of a name is 0, so that it travels as 7 bytes.
BITS = np.uint64(0xFFFFFFFFFFFFFF00)
END = np.uint64(0x5E5E5E5E5E5E5E5E) & BITS
#: Rows that are looked at for common contexts and pairs: one of so many, at least SAMPLE_ROWS.
SAMPLED, SAMPLE_ROWS = 2000, 2000
#: A context or pair is common from this share of the tokens, or a twentieth of a part's, on; at most COMMON_MOST of them.
COMMON, COMMON_MOST = 1 / 1000, 1 << 20


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(True))


# ---- arrays in rows ----


def _array(raw: bytes, kind=np.float64) -> np.ndarray:
    return np.frombuffer(raw, kind) if raw else np.empty(0, kind)


def _pack(x: np.ndarray, kind=np.uint8) -> bytes:
    """Counts in few bytes: the largest number of the kind says that the count follows behind, in full."""
    most = np.iinfo(kind).max
    return np.minimum(x, most).astype(kind).tobytes() + x[x >= most].astype(np.int64).tobytes()


def _unpack(raw: bytes, n: int, kind=np.uint8) -> np.ndarray:
    if not n:
        return np.empty(0, np.int64)
    out = np.frombuffer(raw, kind, n).astype(np.int64)
    rest = np.frombuffer(raw, np.int64, -1, n * np.dtype(kind).itemsize) if len(raw) > n * np.dtype(kind).itemsize else []
    out[out == np.iinfo(kind).max] = rest
    return out


def _pack_names(x: np.ndarray) -> bytes:
    return (x >> np.uint64(32)).astype(np.uint32).tobytes() + (x >> np.uint64(16)).astype(np.uint16).tobytes() + (x >> np.uint64(8)).astype(np.uint8).tobytes()


def _unpack_names(raw: bytes) -> np.ndarray:
    n = len(raw) // 7
    if not n:
        return np.empty(0, np.uint64)
    parts = ((np.uint32, 0, 32), (np.uint16, 4 * n, 16), (np.uint8, 6 * n, 8))
    return np.bitwise_or.reduce([np.frombuffer(raw, kind, n, at).astype(np.uint64) << np.uint64(bits) for kind, at, bits in parts])


def _place(own: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of some names are among the known ones (ordered), and the places of these."""
    if not len(known):
        return np.zeros(len(own), bool), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    found = known[at] == own
    return found, at[found]


def _by_cell(names: np.ndarray, cells: int) -> list[np.ndarray]:
    """Places of the names of each cell, in the order of the names."""
    cell = (mix(names) % np.uint64(cells)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    return np.split(order, np.searchsorted(cell[order], np.arange(1, cells)))


# ---- seating ----


class Seats:
    """Customers of some dishes and their tables; each dish belongs to one restaurant (room).

    elsewhere: tables of the rooms that are not seated here; times: how many times its own customers a dish has in all.
    """

    def __init__(self, counts, room, rooms: int, elsewhere=None, times=None):
        counts = np.asarray(counts, np.int64)
        self.out = np.minimum(counts, 1)
        several = np.flatnonzero(counts > 1)
        self.at = several[np.argsort(-counts[several], kind="stable")]
        self.c, self.r = counts[self.at], room[self.at]
        self.times = np.ones(len(self.at)) if times is None else times[self.at]
        self.start = np.cumsum(self.c) - self.c
        self.t = np.ones(len(self.at), np.int64)
        self.all = np.bincount(room, weights=self.out, minlength=rooms) + (0 if elsewhere is None else elsewhere)
        n = int(self.c.sum())
        self.label, self.size, self.free = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.fresh = True

    def _first(self, parent: np.ndarray, discount: float, strength: float, rng) -> None:
        """The state to start from: about as many tables as the dishes may have, customers dealt over them."""
        self.fresh = False
        new = (strength + discount * self.all[self.r]) * parent
        tables = np.where(self.c > MOVES, 1 + new * np.log1p(self.c / np.maximum(new, 1)), 1).astype(np.int64)
        self.t = np.minimum(tables, self.c)
        each = np.repeat(np.arange(len(self.c)), self.c)
        place = np.arange(len(each)) - self.start[each]
        of = self.t[each]
        self.label = np.where(place < of, place, rng.integers(0, of) if len(of) else place).astype(np.int32)
        self.size = np.bincount(self.start[each] + self.label, minlength=len(each)).astype(np.int32)
        # labels without a table: the first c - t places of a dish's part of this stack
        self.free = (place + of).astype(np.int32)
        self.all = self.all + np.bincount(self.r, weights=self.t - 1, minlength=len(self.all))

    def sweep(self, parent: np.ndarray, discount: float, strength: float, rng) -> None:
        """Customers leave their tables and sit down again: at another customer's with the chance of its size less the
        discount, at a new one with that of (strength + discount * all tables) * the parent's probability."""
        parent = parent[self.at]
        if self.fresh:
            self._first(parent, discount, strength, rng)
        if not len(self.c):
            return
        every = np.arange(len(self.c))
        large = int(np.searchsorted(-self.c, -STEPS))
        # how many dishes have a customer left to move in each step
        left = np.searchsorted(-self.c, -np.arange(1, min(int(self.c[0]), STEPS) + 1), "right")
        for j, n in enumerate(left):
            if large:
                low = self.c[:large] * j // STEPS
                part = self.c[:large] * (j + 1) // STEPS - low
                place = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
                self._move(np.repeat(every[:large], part), np.repeat(low, part), np.repeat(part, part), place, parent, discount, strength, rng)
            if n > large:
                self._move(every[large:n], j, 1, None, parent, discount, strength, rng)

    def _move(self, dish, first, many, place, parent, discount: float, strength: float, rng) -> None:
        """Customers of dishes (in order) move: the one at first, or, with their places, many of a dish from first on."""
        several = place is not None

        def rank(at: np.ndarray):
            """The how manieth of its dish each is."""
            return np.arange(len(at)) - np.searchsorted(dish[at], dish[at]) if several else 0

        def add(x: np.ndarray, at: np.ndarray, n: int) -> None:
            if several:
                np.add.at(x, at, n)
            else:
                x[at] += n

        o, c, r, size = self.start[dish], self.c[dish], self.r[dish], len(dish)
        me = o + first + (place if several else 0)
        table = o + self.label[me]
        add(self.size, table, -1)
        gone = np.flatnonzero(self.size[table] == 0)
        if several:  # a table that lost its last customers is gone once
            gone = np.sort(gone[np.unique(table[gone], return_index=True)[1]])
        self.free[o[gone] + c[gone] - self.t[dish[gone]] + rank(gone)] = self.label[me[gone]]
        add(self.t, dish[gone], -1)
        np.subtract.at(self.all, r[gone], 1)
        t = self.t[dish]
        new = (strength + discount * self.all[r]) * parent[dish]
        opens = (rng.random(size) * (new + self.times[dish] * (c - 1 - discount * t)) < new) | (t == 0)
        to = np.empty(size, np.int32)
        at = np.flatnonzero(opens)
        to[at] = self.free[o[at] + c[at] - t[at] - 1 - rank(at)]
        add(self.t, dish[at], 1)
        np.add.at(self.all, r[at], 1)
        at = np.flatnonzero(~opens)
        behind, stay = first + many, c - many
        while len(at):  # the table of a customer that stays, with the chance of its size less the discount
            k = (rng.random(len(at)) * stay[at]).astype(np.int64) + (behind[at] if several else behind)
            to[at] = self.label[o[at] + k % c[at]]
            at = at[rng.random(len(at)) * self.size[o[at] + to[at]] < discount]
        self.label[me] = to
        add(self.size, o + to, 1)

    def tables(self) -> np.ndarray:
        out = self.out.copy()
        out[self.at] = self.t
        return out


def discount_of(ones: float, twos: float) -> float:
    return min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95)


def root_probability(less: np.ndarray, tables: float, guests: float, vocabulary: float, discount: float) -> np.ndarray:
    """less: a word's guests less the discount for each of its tables."""
    return (np.maximum(less, 0) + (STRENGTH_ROOT + discount * tables) / (vocabulary + 1)) / (STRENGTH_ROOT + guests)


def probability(counts, tables, customers, all_tables, parent, discount: float):
    return (np.maximum(counts - discount * tables, 0) + (STRENGTH + discount * all_tables) * parent) / (STRENGTH + customers)


# ---- slices ----

_DEALT = "key long, slice long, split boolean, contexts binary, sizes binary, names binary, counts binary, docs binary, missing binary, tokens binary, places binary"
_COLUMNS = [c.split()[0] for c in _DEALT.split(", ")]


def _tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all tokens of some texts, of the tokens before them, and the tokens by text."""
    each = [np.append(word_names(t, lower=True) & BITS, END) for t in texts]
    names = np.concatenate(each) if each else np.empty(0, np.uint64)
    return names, np.append(END, names[:-1]), np.array([len(x) for x in each], np.int64)  # a first token follows an end


def _count_sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        w, u, _ = _tokens(batch["text"])
        for kind, names in ((1, u), (2, join_names(u, w))):
            name, n = np.unique(names, return_counts=True)
            yield pd.DataFrame({"kind": kind, "name": name.view(np.int64), "n": n})
        yield pd.DataFrame({"kind": [0], "name": [0], "n": [len(w)]})


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of an ordered array start, and their sizes."""
    start = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
    return start, np.diff(np.append(start, len(x)))


def _deal(contexts: np.ndarray, pairs: np.ndarray, parts: int):
    """Rows of the pairs for the parts, and the slice's own row. contexts, pairs: the common ones, ordered."""

    def rows(slice_: int, part: pd.DataFrame) -> Iterator[tuple]:
        w, u, sizes = _tokens(part["text"])
        doc = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint16 if len(sizes) < 1 << 16 else np.uint32)
        weight = np.repeat(part["train"].to_numpy(bool), sizes)
        place, times = [], []
        split = np.isin(u, contexts)
        for kind in (False, True):
            own = np.flatnonzero(split == kind)
            if not len(own):
                continue
            wc, names = pd.factorize(w[own])
            uc, rooms = pd.factorize(u[own])
            if kind:
                pair = join_names(u[own], w[own])
                home = np.where(np.isin(pair, pairs), mix(pair + np.uint64(slice_)), pair)
                to = (mix(home) % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((wc, uc, to))
            else:
                to_room = (mix(rooms) % np.uint64(parts)).astype(np.int64)
                rank = np.empty(len(rooms), np.int64)
                rank[np.argsort(to_room, kind="stable")] = np.arange(len(rooms))
                order = np.argsort(rank[uc] * len(names) + wc)
                to = to_room[uc]
            to, uc, wc = to[order], uc[order], wc[order]
            start, n = _runs(uc * len(names) + wc)
            counts = np.add.reduceat(weight[own][order].astype(np.int64), start)
            place.append(doc[own][order])
            times.append(n)
            to, uc, wc = to[start], uc[start], wc[start]
            for a, size in zip(*_runs(to)):
                first, each = _runs(uc[a : a + size])
                yield (int(to[a]), slice_, kind, rooms[uc[a : a + size][first]].tobytes(), _pack(each), _pack_names(names[wc[a : a + size]]), _pack(counts[a : a + size]), None, None, None, None)
        ids = part["doc_id"]
        places = np.concatenate(place).tobytes() if place else b""
        times = np.concatenate(times) if times else np.empty(0, np.int64)
        yield (-1 - slice_, slice_, False, None, len(times).to_bytes(8, "little"), None, _pack(times), ids.fillna(0).astype(np.int64).to_numpy().tobytes(), ids.isna().to_numpy().tobytes(), sizes.tobytes(), places)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            cut_at = batch["text"].str.len().fillna(0).cumsum() // SLICE_CHARS
            for _, part in batch.groupby(cut_at.to_numpy(), sort=False):
                for row in rows(number, part):
                    yield pd.DataFrame([row], columns=_COLUMNS)
                number += 1

    return run


# ---- parts and cells ----


class _Part:
    """The dishes of a part."""

    def __init__(self, group: pd.DataFrame, contexts: np.ndarray, pairs: np.ndarray):
        group = group.sort_values(["slice", "split"])
        u, w, c = [], [], []
        self.rows = []
        for r in group.itertuples(index=False):
            own = _array(r.contexts, np.uint64)
            each = _unpack(r.sizes, len(own))
            n = int(each.sum())
            u.append(np.repeat(own, each))
            w.append(_unpack_names(r.names))
            c.append(_unpack(r.counts, n))
            self.rows.append((r.slice, r.split, n))
        u, w, c = map(np.concatenate, (u, w, c))
        code, names = pd.factorize(w)
        order = np.argsort(names)
        self.names = names[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        code = rank[code]
        room, self.rooms = pd.factorize(u)
        self.dish, both = pd.factorize(room * len(names) + code)
        self.word, self.room = both % len(names), both // len(names)
        self.counts = np.bincount(self.dish, weights=c, minlength=len(both)).astype(np.int64)
        self.shared, self.shared_at = _place(self.rooms, contexts)
        self.hot, self.hot_at = _place(join_names(self.rooms[self.room], self.names[self.word]), pairs)
        self.asked = np.bincount(self.word[self.counts > 1], minlength=len(names)) > 0
        self.key = int(group["key"].iloc[0])

    def customers(self) -> np.ndarray:
        return np.bincount(self.room, weights=self.counts, minlength=len(self.rooms))

    def served(self) -> np.ndarray:
        return np.bincount(self.room, weights=self.counts > 0, minlength=len(self.rooms))

    def by_word(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, weights=tables, minlength=len(self.names)).astype(np.int64)

    def common_totals(self, contexts: int, pairs: int) -> list[np.ndarray]:
        """Customers and dishes of the common contexts, customers of the common pairs, here."""
        add = lambda at, x, n: np.bincount(at, weights=x, minlength=n)
        return [add(self.shared_at, self.customers()[self.shared], contexts), add(self.shared_at, self.served()[self.shared], contexts), add(self.hot_at, self.counts[self.hot], pairs)]

    def seats(self, told: "_Told") -> Seats:
        elsewhere = np.zeros(len(self.rooms))
        elsewhere[self.shared] = np.maximum(told.dishes[self.shared_at] - self.served()[self.shared], 0)
        times = np.ones(len(self.counts))
        times[self.hot] = told.pairs[self.hot_at] / np.maximum(self.counts[self.hot], 1)
        return Seats(self.counts, self.room, len(self.rooms), elsewhere, times)


class _Told:
    """Totals: from the sums of all cells, and what cell 0 adds up for the common contexts and pairs."""

    def __init__(self, told: pd.DataFrame, contexts: int, pairs: int):
        self.sums = np.sum([_array(x) for x in told["sums"]], axis=0)
        self.vocabulary, self.tokens = self.sums[:2]
        stats = _array(next((x for x, c in zip(told["stats"], told["cell"]) if c == 0), b""))
        ones, twos = stats[:2]
        self.discount = discount_of(ones, twos)
        self.context_customers, self.dishes, self.pairs, self.rest = np.split(stats[2:], np.cumsum([contexts, contexts, pairs]))


_ASKS = "cell long, part long, names binary, guests binary, counts binary, asked binary, stats binary"
_GUESTS = "cell long, part long, guests binary, model binary, stats binary"
_REPLY = "part long, cell long, less binary, counts binary, sums binary, stats binary"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _ask(contexts: np.ndarray, pairs: np.ndarray, cells: int):
    """What a part tells the cells first: each word's dishes and customers, with one table a dish."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        if group["key"].iloc[0] < 0:
            return _frame([], _ASKS)
        p = _Part(group, contexts, pairs)
        guests, counts = p.by_word(p.counts > 0), p.by_word(p.counts)
        own = np.ones(len(p.counts), bool)
        own[p.hot] = False
        stats = np.concatenate([[(p.counts[own] == 1).sum(), (p.counts[own] == 2).sum()], *p.common_totals(len(contexts), len(pairs))])
        rows = [
            (q, p.key, _pack_names(p.names[at]), _pack(guests[at]), _pack(counts[at], np.uint16), np.packbits(p.asked[at]).tobytes(), b"" if q else stats.astype(float).tobytes())
            for q, at in enumerate(_by_cell(p.names, cells))
        ]
        return _frame(rows, _ASKS)

    return run


class _Cell:
    """The words of a cell, with what each part said of them."""

    def __init__(self, group: pd.DataFrame):
        group = group.sort_values("part")
        self.parts = group["part"].tolist()
        each = [_unpack_names(x) for x in group["names"]]
        self.sizes = np.array([len(x) for x in each])
        self.names, self.place = np.unique(np.concatenate(each), return_inverse=True)
        self.guests = np.concatenate([_unpack(x, n) for x, n in zip(group["guests"], self.sizes)])
        self.counts = self.by_name(np.concatenate([_unpack(x, n, np.uint16) for x, n in zip(group["counts"], self.sizes)]))
        self.asked = np.concatenate([np.unpackbits(_array(x, np.uint8), count=n).astype(bool) for x, n in zip(group["asked"], self.sizes)])
        self.stats = np.sum([_array(x) for x in group["stats"]], axis=0) if group["cell"].iloc[0] == 0 else np.empty(0)

    def by_name(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, weights=x, minlength=len(self.names))

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, np.cumsum(self.sizes)[:-1])


def _reply_first(group: pd.DataFrame) -> pd.DataFrame:
    """Guests of the words that each part asked for: those of dishes with several customers."""
    cell = _Cell(group)
    guests = cell.by_name(cell.guests)
    sums = np.array([(cell.counts > 0).sum(), cell.counts.sum(), guests.sum(), (guests == 1).sum(), (guests == 2).sum()], float)
    q = int(group["cell"].iloc[0])
    rows = [
        (part, q, guests[at][asked].astype(np.float32).tobytes(), b"", sums.tobytes(), cell.stats.tobytes())
        for part, at, asked in zip(cell.parts, cell.split(cell.place), cell.split(cell.asked))
    ]
    return _frame(rows, _REPLY)


def _seat_first(contexts: np.ndarray, pairs: np.ndarray, cells: int, samples: int):
    """Tables of the words asked for, in each sample, given a root with one table a word."""

    def run(group: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(told):
            return _frame([], _GUESTS)
        p, know = _Part(group, contexts, pairs), _Told(told, len(contexts), len(pairs))
        guests, ones, twos = know.sums[2:5]
        root = discount_of(ones, twos)
        places = [at[p.asked[at]] for at in _by_cell(p.names, cells)]
        parent = np.zeros(len(p.names))
        for q, less in zip(told["cell"], told["less"]):
            parent[places[q]] = _array(less, np.float32) - root
        parent = root_probability(parent, know.vocabulary, guests, know.vocabulary, root)[p.word]
        rng, seats = np.random.default_rng(p.key), p.seats(know)
        seats.sweep(parent, know.discount, STRENGTH, rng)
        by_word, shared = [], []
        for _ in range(samples):
            seats.sweep(parent, know.discount, STRENGTH, rng)
            tables = seats.tables()
            by_word.append(p.by_word(tables))
            rooms = np.bincount(p.room, weights=tables, minlength=len(p.rooms))[p.shared]
            shared.append(np.bincount(p.shared_at, weights=rooms, minlength=len(contexts)))
        model = np.array([know.vocabulary, root]).tobytes()
        rows = [(q, p.key, _pack(np.concatenate([x[at] for x in by_word])), model, b"" if q else np.concatenate(shared).tobytes()) for q, at in enumerate(places)]
        return _frame(rows, _GUESTS)

    return run


def _reply_last(samples: int):
    """The root's seating in each sample, for all words of each part, and the words' customers."""

    def run(group: pd.DataFrame, seated: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(seated):
            return _frame([], _REPLY)
        cell, q = _Cell(group), int(group["cell"].iloc[0])
        seated = seated.sort_values("part")
        vocabulary, discount = _array(seated["model"].iloc[0])
        asked = cell.split(cell.asked)
        told = [_unpack(x, samples * int(a.sum())).reshape(samples, -1) for x, a in zip(seated["guests"], asked)]
        known = cell.counts > 0
        rng, less, sums = np.random.default_rng(q), [], [known.sum(), cell.counts.sum()]
        for s in range(samples):
            each = cell.guests.copy()
            each[cell.asked] = np.concatenate([x[s] for x in told])
            guests = cell.by_name(each).astype(np.int64)
            seats = Seats(guests, np.zeros(len(guests), np.int64), 1, np.array([vocabulary - known.sum()]))
            for _ in range(2):
                seats.sweep(np.full(len(guests), 1 / (vocabulary + 1)), discount, STRENGTH_ROOT, rng)
            tables = seats.tables()
            less.append((guests - discount * tables).astype(np.float32))
            sums += [guests.sum(), tables.sum()]
        stats = np.concatenate([cell.stats, np.sum([_array(x) for x in seated["stats"]], axis=0)]) if q == 0 else np.empty(0)
        sums = np.array([*sums, discount if q == 0 else 0.0], float)
        rows = [
            (part, q, np.concatenate([x[at] for x in less]).tobytes(), _pack(cell.counts[at], np.uint16), sums.tobytes(), stats.tobytes())
            for part, at in zip(cell.parts, cell.split(cell.place))
        ]
        return _frame(rows, _REPLY)

    return run


_SCORES = "key long, part long, split boolean, p binary, counts binary, model binary"


def _score(contexts: np.ndarray, pairs: np.ndarray, cells: int, samples: int):
    """For each row of a slice, log10 of the mean probability of each of its pairs, and the customers of its word."""

    def run(group: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(told):
            return _frame([], _SCORES)
        p, know = _Part(group, contexts, pairs), _Told(told, len(contexts), len(pairs))
        root = know.sums[-1]
        less, counts = np.zeros((samples, len(p.names))), np.zeros(len(p.names), np.int64)
        places = _by_cell(p.names, cells)
        for q, x, c in zip(told["cell"], told["less"], told["counts"]):
            at = places[q]
            less[:, at] = _array(x, np.float32).reshape(samples, -1)
            counts[at] = _unpack(c, len(at), np.uint16)
        dish_counts, customers = p.counts.astype(float), p.customers()
        dish_counts[p.hot] = know.pairs[p.hot_at]
        customers[p.shared] = know.context_customers[p.shared_at]
        rng, seats, mean = np.random.default_rng(p.key + 1), p.seats(know), np.zeros(len(p.counts))
        for s in range(samples):
            guests, root_tables = know.sums[2 + 2 * s : 4 + 2 * s]
            parent = root_probability(less[s], root_tables, guests, know.vocabulary, root)[p.word]
            for _ in range(1 if s else 2):
                seats.sweep(parent, know.discount, STRENGTH, rng)
            tables = seats.tables().astype(float)
            rooms = np.bincount(p.room, weights=tables, minlength=len(p.rooms))
            rooms[p.shared] = know.rest[s * len(contexts) : (s + 1) * len(contexts)][p.shared_at]
            tables[p.hot] *= np.maximum(know.pairs[p.hot_at] / np.maximum(p.counts[p.hot], 1), 1)
            mean += probability(dish_counts, tables, customers[p.room], rooms[p.room], parent, know.discount) / samples
        p_dish, c_dish = np.log10(mean).astype(np.float32), counts[p.word]
        model, rows, done = np.array([know.vocabulary, know.tokens]).tobytes(), [], 0
        for slice_, split, n in p.rows:
            at = p.dish[done : done + n]
            rows.append((-1 - slice_, p.key, bool(split), p_dish[at].tobytes(), _pack(c_dish[at], np.uint16), model))
            done += n
        return _frame(rows, _SCORES)

    return run


def _gather(group: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
    """The scores of the texts of a slice. Its pairs are those that were not split by part, then the split ones."""
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if not len(group) or group["key"].iloc[0] >= 0:
        return _frame([], schema)
    r = next(group.itertuples(index=False))
    sizes, missing = _array(r.tokens, np.int64), _array(r.missing, bool)
    n_pairs = int.from_bytes(r.sizes, "little")
    times = _unpack(r.counts, n_pairs)
    doc = np.frombuffer(r.places, np.uint16 if len(sizes) < 1 << 16 else np.uint32)
    told = told.sort_values(["split", "part"])
    vocabulary, tokens = _array(told["model"].iloc[0])
    p = np.concatenate([_array(x, np.float32) for x in told["p"]]).astype(float)
    c = np.concatenate([_unpack(x, len(y) // 4, np.uint16) for x, y in zip(told["counts"], told["p"])])
    add = lambda x: np.bincount(doc, weights=np.repeat(x, times), minlength=len(sizes))
    ids = pd.Series(_array(r.docs, np.int64)).astype("Int64").mask(missing)
    return pd.DataFrame(
        {
            "doc_id": ids,
            "n_tokens": sizes,
            "n_known": add((c > 0).astype(float)).astype(np.int64),
            "train_tokens": np.full(len(sizes), int(tokens)),
            "base_score": add(np.log10((c + 1.0) / (tokens + vocabulary + 1.0))),
            "score": add(p),
        }
    )


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each row."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    r = texts.agg(F.count("*"), F.sum(F.length("text"))).first()
    parts = 4 + (r[1] or 0) // PART_CHARS
    cells = min(parts, CELLS)
    # which contexts and pairs count as common changes only where they are kept
    share = min(COMMON, 1 / (20 * parts))
    few = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(min(r[0] // SAMPLE_ROWS, SAMPLED), 1))) == 0)
    seen = few.select("text").mapInPandas(_count_sampled, "kind long, name long, n long").groupBy("kind", "name").agg(F.sum("n").alias("n"))
    top = seen.orderBy(F.desc("n")).limit(min(int(2 / share), COMMON_MOST) + 1).collect()
    total = sum(x["n"] for x in top if x["kind"] == 0)
    contexts, pairs = (np.sort(np.array([x["name"] for x in top if x["kind"] == k and x["n"] >= share * total], np.int64).view(np.uint64)) for k in (1, 2))

    dealt = texts.withColumn("train", ~held_out()).mapInPandas(_deal(contexts, pairs, parts), _DEALT)
    by_key = lambda: dealt.groupBy("key")
    asks = by_key().applyInPandas(_ask(contexts, pairs, cells), _ASKS)
    first = asks.groupBy("cell").applyInPandas(_reply_first, _REPLY)
    guests = by_key().cogroup(first.groupBy("part")).applyInPandas(_seat_first(contexts, pairs, cells, samples), _GUESTS)
    last = asks.groupBy("cell").cogroup(guests.groupBy("cell")).applyInPandas(_reply_last(samples), _REPLY)
    scores = by_key().cogroup(last.groupBy("part")).applyInPandas(_score(contexts, pairs, cells, samples), _SCORES)
    out = by_key().cogroup(scores.groupBy("key")).applyInPandas(
        _gather, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = language_model_scores(documents(spark, sf_dir))
    return rows.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
