"""Removal of repeated line runs: suffixes of line-ID sequences, refined by distributed prefix doubling.

Every line with a word gets an ID, a 128-bit fingerprint of its text. Only suffixes that start with a line found twice
are kept. Round r names the first 2**r lines of a suffix by the names of its two halves, and keeps the suffixes whose
name occurs twice: the members of one name are an interval of the suffix array whose common prefix has at least 2**r
lines. Rounds go on until no name occurs twice. In each, the first occurrence of a name (smallest id, then earliest) stays,
and all later ones are copies of 2**r lines; copies that continue each other from the same place are one run.

A run is worth removing from min_words words on. The least stretches of so many words, taken from each line forwards and from
each line backwards, are named by two overlapping halves at the level of their length, and their later occurrences go as
well. Together these stretches cover exactly the later copies of all maximal repeated runs of at least min_words words. With
a floor of one word every later copy of a line with a word goes; the longer names then say which runs these lines are.

All steps are DataFrame operations. Lines are grouped by name with partial aggregation and joined back against unique
names. Names of more than a thousandth of the rows (fewer than a thousand names) are sent to every task instead, so the
rows of a very common line or run stay where they are; per document only that document's own repeated lines meet. Rounds
end in tables in the shared folder.

Defined results: null text stays null, lines without words stay, a text may become empty; equal rows are one occurrence,
so they don't remove each other; a row without id is left as it is. Other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, WORD, cut, documents, join_by_name

#: Runs of fewer words stay; 1 removes every later copy of a line with a word.
MIN_WORDS = 1
#: The key of a document: its id and its text, so that rows that share an id stay apart unless they are equal.
KEY = ["_d", "_h"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _with_words(text: Column) -> Column:
    """Places of the lines that hold a word."""
    numbered = F.transform(_lines(text), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    return F.filter(numbered, lambda s: s["x"].rlike(WORD))


def _reach(words: Column, least: int) -> Column:
    """How many of the first numbers add up to at least so much (null: all don't)."""
    step = lambda a, w: F.when(a["sum"] >= least, a).otherwise(
        F.struct((a["sum"] + w).alias("sum"), (a["n"] + 1).alias("n"))
    )
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"))
    return F.aggregate(words, start, step, lambda a: F.when(a["sum"] >= least, a["n"]))


def late_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_d, _h, gone, _runs, _longest): for documents with later copies of runs, the ordinals of the lines (with words)
    that go, how many runs they are, and how many lines the longest has."""
    t = docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("_t")).where("_d IS NOT NULL AND _t IS NOT NULL")
    t = t.withColumn("_h", F.xxhash64("_t"))
    each = t.select(*KEY, F.posexplode(F.transform(_with_words(F.col("_t")), lambda s: s["x"])).alias("o", "x"))
    lines = cut(
        each.select(
            *KEY,
            "o",
            F.xxhash64("x").alias("p"),
            F.xxhash64(F.lit(1), "x").alias("q"),
            F.least(F.size(F.split(F.btrim("x", F.lit(" \t\x0b\f\r")), SPACE)), F.lit(min_words)).alias("w"),
        ),
        "lines",
    )
    twice = lines.groupBy("p", "q").count().where("count > 1")
    active = join_by_name(lines, twice, ["p", "q"], []).dropDuplicates([*KEY, "o"])
    # consecutive lines form a stretch; within it, how far to go for enough words
    by_doc = Window.partitionBy(*KEY).orderBy("o")
    active = active.withColumn("g", F.col("o") - F.row_number().over(by_doc))
    ahead = Window.partitionBy(*KEY, "g").orderBy("o")
    forth = F.collect_list("w").over(ahead.rowsBetween(0, min_words - 1))
    back = F.reverse(F.collect_list("w").over(ahead.rowsBetween(-(min_words - 1), 0)))
    active = cut(
        active.withColumns({"n": _reach(forth, min_words), "m": _reach(back, min_words)}).drop("g"), "suffixes"
    )
    spans = F.array_compact(
        F.array(
            F.when(F.col("n").isNotNull(), F.struct(F.col("o").alias("s"), F.col("n").alias("n"))),
            F.when(F.col("m").isNotNull(), F.struct((F.col("o") - F.col("m") + 1).alias("s"), F.col("m").alias("n"))),
        )
    )
    runs = active.select(*KEY, F.explode(F.array_distinct(spans)).alias("r")).select(*KEY, "r.s", "r.n").distinct()

    named, windows = None, []
    level, k = active.select(*KEY, "o", "p", "q", "n"), 1
    while True:
        if k <= min_words:  # no least stretch is longer
            mine = runs.where((F.col("n") >= k) & (F.col("n") < 2 * k))
            head = level.select(*KEY, F.col("o").alias("s"), "p", "q")
            if k == 1:
                keyed = mine.join(head, [*KEY, "s"]).withColumns({"p2": F.col("p"), "q2": F.col("q")})
            else:
                tail = level.select(*KEY, F.col("o").alias("e"), F.col("p").alias("p2"), F.col("q").alias("q2"))
                keyed = mine.withColumn("e", F.col("s") + F.col("n") - k).join(head, [*KEY, "s"]).join(tail, [*KEY, "e"])
            keyed = keyed.select(
                *KEY,
                "s",
                "n",
                F.xxhash64("n", "p", "q", "p2", "q2").alias("a"),
                F.xxhash64(F.lit(2), "p", "n", "q", "p2", "q2").alias("b"),
            )
            named = keyed if named is None else named.unionByName(keyed)
        follow = F.first(F.struct("p", "q")).over(Window.partitionBy(*KEY).orderBy("o").rangeBetween(k, k))
        doubled = level.withColumn("f", follow).where("f IS NOT NULL")
        doubled = doubled.select(
            *KEY,
            "o",
            F.xxhash64("p", "f.p").alias("p"),
            F.xxhash64(F.lit(3), "q", "f.q").alias("q"),
            "n",
        )
        k *= 2
        doubled = cut(doubled, f"prefixes{k}")
        start = F.struct(*KEY, F.col("o").alias("s"))
        again = doubled.groupBy("p", "q").agg(F.min(start).alias("first"), F.count("*").alias("count")).where("count > 1")
        level = cut(join_by_name(doubled, again, ["p", "q"], ["first"]), f"level{k}")
        if level.isEmpty():
            break
        later = level.where((start > F.col("first")) & (F.col("n") <= k))
        windows.append(later.select(*KEY, F.col("o").alias("s"), F.lit(k).alias("n"), "first"))
    named = cut(named, "runs")
    place = F.struct(*KEY, "s")
    first = named.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("count"))
    late = join_by_name(named, first.where("first < last"), ["a", "b"], ["first"]).where(place > F.col("first"))
    late = late.select(*KEY, "s", "n", "first")
    for more in windows:
        late = late.unionByName(more)
    return _runs(late)


def _runs(late: DataFrame) -> DataFrame:
    """(_d, _h, gone, _runs, _longest) of later copies of n lines from line s on, with the place of the first.

    Copies within another one say nothing new. The others continue a run if they come from the same place in the same
    document, next to or over what is there already.
    """
    end, by_doc = F.col("s") + F.col("n"), Window.partitionBy(*KEY).orderBy("s", F.desc("n"))
    before = F.coalesce(F.max(end).over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = late.withColumns({"e": end, "before": before}).where("e > before")
    origin = F.struct("first._d", "first._h", (F.col("first.s") - F.col("s")).alias("shift"))
    new = new.withColumn("origin", origin)
    goes_on = (F.lag("origin").over(by_doc) == F.col("origin")) & (F.col("s") <= F.col("before"))
    new = new.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(by_doc))
    fresh = F.sequence(F.greatest("s", "before"), F.col("e") - 1)
    each = new.groupBy(*KEY, "run").agg(F.flatten(F.collect_list(fresh)).alias("gone"), (F.max("e") - F.min("s")).alias("lines"))
    return each.groupBy(*KEY).agg(
        F.flatten(F.collect_list("gone")).alias("gone"),
        F.count("*").alias("_runs"),
        F.max("lines").cast("long").alias("_longest"),
    )


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the later copies of repeated line runs cut out of the text; same columns, same rows."""
    return _with_runs(docs, min_words, id_col, text_col).select(*docs.columns)


def _with_runs(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """line_dedup with (_runs, _longest): the runs cut out of each text, and the lines of the longest."""
    gone = late_lines(docs, min_words, id_col, text_col)
    t = F.col(text_col)
    keyed = docs.withColumns({"_d": F.col(id_col), "_h": F.xxhash64(t)})
    joined = keyed.join(gone, KEY, "left")
    out = joined.withColumn("_n", F.when(F.col("gone").isNotNull(), F.transform(_with_words(t), lambda s: s["i"])))
    drop = F.transform("gone", lambda o: F.get("_n", o))
    out = out.withColumn("_l", F.when(F.col("gone").isNotNull(), _lines(t)))
    keep = F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), drop)
    left = F.array_join(F.transform(keep, lambda i: F.get("_l", i)), "\n")
    rest = F.when(F.col("gone").isNotNull() & (F.size("_l") > 0), left).otherwise(t)
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("_runs", "_longest")]
    return out.withColumn(text_col, rest).select(*docs.columns, *counts)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", F.size(_lines(F.col("text"))).cast("long").alias("n_lines"))
    out = _with_runs(docs)
    kept = F.when(F.col("text").isNotNull(), F.size(F.filter(_lines(F.col("text")), lambda x: x.rlike(WORD))))
    return out.select(
        "doc_id",
        "n_lines",
        kept.cast("long").alias("n_lines_with_words_left"),
        F.sha2("text", 256).alias("kept_sha256"),
        F.col("_runs").alias("n_runs"),
        F.col("_longest").alias("longest_run"),
    )
