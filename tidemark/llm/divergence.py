"""Audit of how the sources of a language diverge: pairs of sources, and the terms that mark a source.

A term is a run of ASCII letters and characters beyond ASCII, with A to Z lower-cased. A language keeps the terms of at least
three of its documents. With c occurrences of a term in a group (lang, source), N of all kept terms there and V kept terms,
the share is p = 1 + floor(10**9 * (c + 1) / (N + V)), and the divergence of p from q is floor((p - q)**2 / q). All of it is
exact: shares are divided digit by digit in 64-bit numbers, so counts may reach 9e15.

The sum over all terms for a pair of sources is Gustavson's row accumulation over a term-major index (a row for each kept term
with the counts of the sources that have it, dealt by term). A task takes a block of the index; each source scatters its terms
through the block's rows into a dense accumulator with a cell for each peer, so pairs of postings never become rows, and
only the accumulators' cells leave the task. Where one or both sources lack a term, its share is not zero but the baseline
p0 of its source. So the total for (g, h) is

    V f(p0g, p0h)                                              every term as if both lacked it
    + sum over g's terms of f(p, p0h) - f(p0g, p0h)            from how often each count occurs in g, for all peers
    + sum over h's terms of f(p0g, p) - f(p0g, p0h)            the same for h
    + sum over common terms of f(p, p') - f(p, p0h) - f(p0g, p') + f(p0g, p0h)      scattered through the index.

The groups (their names, N and V) are known to every task. Their number is the root of the number of result rows, as each pair
within a language is one, so it is bounded by what the caller asked for. A source with a third of all rows is no hot key: terms are counted
within tasks before the exchange, the index is dealt by term, and only the first terms of a source leave a task.

Defined results: null text, lang and source count as ''. Each row is a document, also if it shares its id with others or is a
copy of one. A group without kept terms has pairs (all terms at its baseline) and no terms; a language without kept terms
has pairs of value 0; the only source of a language has no pairs; an empty table has no result. Only the named columns are read, so others
can't clash.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, documents

#: Documents that a kept term occurs in at least; shares are of so many parts; ranks of the part `term`.
LEAST_DOCUMENTS, PARTS, RANKS = 3, 1_000_000_000, 200
#: Counted terms, and cells of accumulators or of intermediate products, that a task holds at most before it sends them on.
HELD, CELLS = 300_000, 1 << 20

#: Bytes of a term stay (A to Z lower-cased), all others become spaces.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def share(c, d):
    """1 + floor(10**9 * (c + 1) / d) of 64-bit numbers, three digits at a time."""
    rest, out = np.asarray(c, np.int64) + 1, np.int64(0)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // d, rest % d
    return out + 1


def excess(p, q):
    """floor((p - q)**2 / q)."""
    return (p - q) * (p - q) // q


def _share_sql(c: str, d: str) -> str:
    rest, out = f"({c} + 1)", "0"
    for _ in range(3):
        out, rest = f"({out} * 1000 + ({rest} * 1000) div {d})", f"(({rest} * 1000) % {d})"
    return f"(1 + {out})"


def _counted(numbers):
    """(lang, g, term, n, docs): occurrences and documents of the terms of a task's texts."""

    def rows(held: dict) -> pa.RecordBatch:
        lang, g, term, n, docs = [], [], [], [], []
        for (name, source), (all_, in_) in held.items():
            lang += [name] * len(all_)
            g += [numbers.value[name][source]] * len(all_)
            term += all_.keys()
            n += all_.values()
            docs += map(in_.__getitem__, all_)
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(g, pa.int32()), pa.array(term, pa.binary()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "g", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(lambda: (Counter(), Counter()))
        seen = 0
        for batch in batches:
            for lang, source, text in zip(*(batch[c] for c in ("lang", "source", "text"))):
                found = text.as_py().translate(_TERM_BYTES).split()
                all_, in_ = held[lang.as_py(), source.as_py()]
                before = len(all_)
                all_.update(found)
                in_.update(set(found))
                seen += len(all_) - before
                if seen >= HELD:
                    yield rows(held)
                    held.clear()
                    seen = 0
        yield rows(held)

    return run


class Peers:
    """The groups of a language as arrays by number: denominators and baselines."""

    def __init__(self, n: np.ndarray, v: int):
        self.v, self.d = v, np.maximum(n + v, 1)
        self.p0 = share(np.zeros(len(n), np.int64), self.d)

    def scatter(self, of: np.ndarray, g: np.ndarray, n: np.ndarray, into: dict) -> None:
        """Adds what common terms bring: posting i is of row of[i] (ascending) of the index, in source g[i], with count n[i]."""
        p = share(n, self.d[g])
        starts = np.searchsorted(of, of, "left")
        counts = np.searchsorted(of, of, "right") - starts
        order = np.argsort(g, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(g[order])) + 1):
            source = int(g[mine[0]])
            acc, low = into[source], self.p0[source]
            room = np.cumsum(counts[mine]) // CELLS
            for part in np.split(mine, np.flatnonzero(np.diff(room)) + 1):
                k = counts[part]
                at = np.repeat(starts[part] - np.cumsum(k) + k, k) + np.arange(k.sum())
                peer, own, other = g[at], np.repeat(p[part], k), p[at]
                base = self.p0[peer]
                np.add.at(acc, peer, excess(own, other) - excess(own, base) - excess(low, other) + excess(low, base))

    def baselines(self, g: int, n: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the terms of a source bring by their counts alone, to (g, h) for each h and to (x, g) for each x."""
        rows, cols = np.zeros(len(self.d), np.int64), np.zeros(len(self.d), np.int64)
        p, own = share(n, self.d[g]), self.p0[g]
        step = max(1, CELLS // len(self.d))
        for i in range(0, len(p), step):
            q, k = p[i : i + step, None], times[i : i + step, None]
            rows += (k * (excess(q, self.p0) - excess(own, self.p0))).sum(axis=0)
            cols += (k * (excess(self.p0, q) - excess(self.p0, own))).sum(axis=0)
        return rows, cols


_CELL = "lang string, g int, h int, value long"


def _cells(lang: str, g, h, value) -> pa.RecordBatch:
    keep = (np.asarray(g) != np.asarray(h)) & (np.asarray(value) != 0)
    g, h = np.broadcast_to(g, keep.shape)[keep], np.broadcast_to(h, keep.shape)[keep]
    columns = [pa.array([lang] * len(g), pa.string()), pa.array(g, pa.int32()), pa.array(h, pa.int32()), pa.array(value[keep], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "g", "h", "value"])


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    coded = batch["lang"].dictionary_encode()
    codes = coded.indices.to_numpy()
    for i, lang in enumerate(coded.dictionary.to_pylist()):
        yield lang, np.flatnonzero(codes == i)


def _scattered(peers):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def sent():
            for lang, rows in held.items():
                for g, acc in rows.items():
                    yield _cells(lang, g, np.arange(len(acc)), acc)
            held.clear()

        for batch in batches:
            for lang, at in _by_lang(batch):
                p = peers.value[lang]
                lists = batch["postings"].take(pa.array(at))
                flat = lists.flatten()
                of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                rows = held.setdefault(lang, defaultdict(lambda n=len(p.d): np.zeros(n, np.int64)))
                p.scatter(of, flat.field("g").to_numpy(), flat.field("n").to_numpy(), rows)
            if sum(len(acc) for rows in held.values() for acc in rows.values()) >= CELLS:
                yield from sent()
        yield from sent()

    return run


def _based(peers):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, n, times = (batch[c].to_numpy() for c in ("g", "n", "times"))
            for lang, at in _by_lang(batch):
                p = peers.value[lang]
                everyone = np.arange(len(p.d))
                order = at[np.argsort(g[at], kind="stable")]
                for mine in np.split(order, np.flatnonzero(np.diff(g[order])) + 1):
                    source = int(g[mine[0]])
                    rows, cols = p.baselines(source, n[mine], times[mine])
                    yield _cells(lang, source, everyone, rows)
                    yield _cells(lang, everyone, source, cols)

    return run


def _paired(peers):
    """All pairs of a source, each with the value of V terms that both lack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                p, g = peers.value[row["lang"]], row["g"]
                value = p.v * excess(p.p0[g], p.p0)
                h = np.delete(np.arange(len(p.d)), g)
                columns = [pa.array([row["lang"]] * len(h), pa.string()), pa.array(np.full(len(h), g), pa.int32()), pa.array(h, pa.int32()), pa.array(value[h], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "g", "h", "value"])

    return run


def source_divergence(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", ranks: int = RANKS
) -> DataFrame:
    """(lang, source, part, item, value, rank): pairs of sources of a language, and the terms that mark a source."""
    spark = docs.sparkSession
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    texts = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), blank(text_col).cast("binary").alias("text"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = cut(texts.select("lang", "source").distinct().withColumn("g", number), "groups")
    numbers: dict = defaultdict(dict)
    for lang, source, g in zip(*(c.to_pylist() for c in groups.toArrow().columns)):
        numbers[lang][source] = g

    counted = texts.mapInArrow(_counted(spark.sparkContext.broadcast(dict(numbers))), "lang string, g int, term binary, n long, docs long")
    by_group = counted.groupBy("lang", "g", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    index = by_group.groupBy("lang", F.col("term").cast("string").alias("term")).agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"), F.collect_list(F.struct("g", "n")).alias("postings")
    )
    index = cut(index.where(F.col("docs") >= LEAST_DOCUMENTS).drop("docs"), "index")
    each = index.select("lang", F.explode("postings").alias("p")).select("lang", "p.g", "p.n")
    times = cut(each.groupBy("lang", "g", "n").agg(F.count("*").alias("times")), "times")

    total = {(r.lang, r.g): r.n for r in times.groupBy("lang", "g").agg(F.sum(F.col("n") * F.col("times")).alias("n")).collect()}  # a row a group
    kept = {r.lang: r.v for r in index.groupBy("lang").agg(F.count("*").alias("v")).collect()}
    known = {lang: Peers(np.array([total.get((lang, g), 0) for g in range(len(own))], np.int64), kept.get(lang, 0)) for lang, own in numbers.items()}
    peers = spark.sparkContext.broadcast(known)
    of_lang = {lang: sum(total.get((lang, g), 0) for g in own.values()) + kept.get(lang, 0) for lang, own in numbers.items()}
    sizes = spark.createDataFrame(
        [(lang, g, source, int(known[lang].d[g]), of_lang[lang]) for lang, own in numbers.items() for source, g in own.items()],
        "lang string, g int, source string, d long, d_lang long",
    )

    cells = groups.mapInArrow(_paired(peers), _CELL)
    cells = cells.unionByName(times.mapInArrow(_based(peers), _CELL)).unionByName(index.select("lang", "postings").mapInArrow(_scattered(peers), _CELL))
    pairs = cells.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    named = F.broadcast(sizes)  # a row a group
    pairs = pairs.join(named.select("lang", "g", "source"), ["lang", "g"]).join(named.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"])

    terms = index.select("lang", "term", "n_lang", F.explode("postings").alias("p")).select("lang", F.col("term").alias("item"), "n_lang", "p.g", "p.n")
    terms = terms.join(named, ["lang", "g"]).withColumns({"p": F.expr(_share_sql("n", "d")), "q": F.expr(_share_sql("n_lang", "d_lang"))})
    terms = terms.where("p > q").withColumn("value", F.expr("(p - q) * (p - q) div q"))

    def ranked(df: DataFrame, part: str) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    return ranked(pairs, "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= ranks))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::hugeint AS n_lang FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCUMENTS}),
v AS (SELECT lang, count(*)::hugeint AS v, sum(n_lang)::hugeint AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::hugeint AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT lang, source, sum(n)::hugeint AS n FROM c GROUP BY lang, source),
a AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + ({PARTS}::hugeint * (coalesce(c.n, 0) + 1)) // (coalesce(s.n, 0) + v.v) AS p,
         1 + ({PARTS}::hugeint * (k.n_lang + 1)) // (v.n + v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
pairs AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
  FROM a AS x JOIN a AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
every AS (
  SELECT x.lang, x.source, y.source AS item, coalesce(value, 0)::bigint AS value
  FROM g AS x JOIN g AS y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source),
found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM every
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint FROM a WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::int AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {RANKS}"""
