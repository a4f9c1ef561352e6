"""Filters, key look-ups, rankings and coverage of filings, as joins and windows over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.retrieval import small


def metadata_filter(df: DataFrame, **wanted) -> DataFrame:
    """Rows that equal every given value; None sets no condition."""
    conditions = [F.col(c) == v for c, v in wanted.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def keyword_lookup(df: DataFrame, columns: list[str], text: str, key: str, k: int = 20) -> DataFrame:
    """The first k rows (by key) with the text, in any case, in one of the columns."""
    return df.where(reduce(lambda a, b: a | b, [F.contains(F.lower(c), F.lit(text.lower())) for c in columns])).orderBy(key).limit(k)


def eligible_docs(df: DataFrame, text: str = "text", least: int = 500) -> DataFrame:
    return df.where(F.length(text) > least)


def since(df: DataFrame, day: str, asof: str, years: int = 0, days: int = 0) -> DataFrame:
    """Rows dated within so many years and days before asof, or later."""
    start = F.date_sub(F.add_months(F.lit(asof).cast("date"), -12 * years), days)
    return df.where(F.col(day) >= start)


def year_range(df: DataFrame, year: str, low: int = 2015, high: int = 2026) -> DataFrame:
    """Years within the range, and 'Unknown'; other texts go."""
    return df.where((F.col(year) == "Unknown") | F.col(year).try_cast("int").between(low, high))


def top_opportunities(df: DataFrame, score: str, key: str, least: float = 60.0, n: int = 10) -> DataFrame:
    """The n best rows of at least a score."""
    return df.where(F.col(score) >= least).orderBy(F.desc(score), key).limit(n)


def best_per_key(df: DataFrame, keys: list[str], score: str, *ties: str) -> DataFrame:
    """The row with the highest score of each key, the first by the ties."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), *ties)
    return df.withColumn("_b", F.row_number().over(order)).where("_b = 1").drop("_b")


def new_only(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose keys are not stored."""
    return incoming.join(stored.select(*keys).distinct(), keys, "left_anti")


def existing_keys(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose keys are stored."""
    return incoming.join(stored.select(*keys).distinct(), keys, "left_semi")


def merge_ranking(candidates: DataFrame, ranking: DataFrame, key: str, score: str = "score") -> DataFrame:
    """Candidates with the score of an external ranking, 0 where it has none."""
    return candidates.join(ranking.select(key, score), key, "left").fillna(0.0, [score])


def align_by_position(left: DataFrame, right: DataFrame, key: str, order: str, names: tuple[str, str]) -> DataFrame:
    """Pairs the n-th values of two series of each key; the longer one is cut to the shorter."""
    w = Window.partitionBy(key).orderBy(order)
    number = lambda df, name: df.select(key, F.row_number().over(w).alias("pos"), name)
    return number(left, names[0]).join(number(right, names[1]), [key, "pos"])


def resolve_codes(df: DataFrame, query: str = "query", lines: str = "lines", key: str | None = None) -> DataFrame:
    """(key, code, name, symbol), the key being the query if none is named, from each query's own result lines 'code/name/symbol/..': the first line whose
    symbol equals the query or holds it, else the first with three parts."""
    key = key or query
    each = df.select(*{key, query}, F.posexplode(lines).alias("pos", "line")).withColumn("p", F.split("line", "/")).where(F.size("p") >= 3)
    symbol = F.upper(F.trim(F.col("p")[2]))
    hit = symbol.contains(F.upper(F.col(query))).cast("int")
    first = each.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(hit), "pos"))).where("_r = 1")
    return first.select(key, F.trim(F.col("p")[0]).alias("code"), F.trim(F.col("p")[1]).alias("name"), symbol.alias("symbol"))


def market_sentiment(news: DataFrame, key: str, order: list[Column], score: str, headline: str, n: int = 5) -> DataFrame:
    """(key, sentiment, n, status, headline) over the latest n rows of each key."""
    r = news.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= n)
    g = r.groupBy(key).agg(F.avg(score).alias("sentiment"), F.count("*").alias("n"), F.min_by(headline, "_r").alias("headline"))
    return g.withColumn("status", F.when(F.col("sentiment") > 0.2, "Bullish").when(F.col("sentiment") < -0.2, "Bearish").otherwise("Neutral"))


def market_topk(hits: DataFrame, key: str, item: str, least: float, each: int = 3) -> DataFrame:
    """(query_id, key, best, items): up to `each` hits of every key that reach a score."""
    w = Window.partitionBy("query_id", key).orderBy(F.desc("score"), item)
    kept = hits.where(F.col("score") >= least).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= each)
    items = F.transform(F.sort_array(F.collect_list(F.struct("_r", item))), lambda s: s[item])
    return kept.groupBy("query_id", key).agg(F.max("score").alias("best"), items.alias("items"))


def snapshot_trend(df: DataFrame, key: str, order: str, value: str, n: int = 7) -> DataFrame:
    """(key, newest, oldest, change %) over the last n rows of each key."""
    last = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_r") <= n)
    g = last.groupBy(key).agg(F.min_by(value, "_r").alias("newest"), F.max_by(value, "_r").alias("oldest"))
    return g.withColumn("change", (F.try_divide("newest", "oldest") - 1) * 100)


def period_trend(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, periods, first, last, change %, growth % a period) over the periods of each key."""
    at = F.struct(*order)
    g = df.groupBy(key).agg(F.count("*").alias("periods"), F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"))
    ratio = F.try_divide("last", "first")
    growth = F.when((F.col("periods") > 1) & (ratio > 0), (F.pow(ratio, 1 / (F.col("periods") - 1)) - 1) * 100)
    return g.withColumns({"change": (ratio - 1) * 100, "growth": growth})


def fully_covered(a: DataFrame, b: DataFrame, key: str, least_a: int = 10, least_b: int = 30) -> DataFrame:
    """(key, n_a, n_b, complete): row counts of two tables, either of which may lack a key."""
    counts = a.groupBy(key).agg(F.count("*").alias("n_a")).join(b.groupBy(key).agg(F.count("*").alias("n_b")), key, "full_outer")
    counts = counts.fillna(0, ["n_a", "n_b"])
    return counts.withColumn("complete", (F.col("n_a") >= least_a) & (F.col("n_b") >= least_b))


def select_call_docs(docs: DataFrame, key: list[str], kind: str = "kind") -> DataFrame:
    """Of each call the transcript, or without one the ai_summary; slides (ppt) always."""
    has = F.max((F.col(kind) == "transcript").cast("int")).over(Window.partitionBy(*key))
    out = docs.withColumn("_t", has)
    return out.where((F.col(kind).isin("transcript", "ppt")) | ((F.col(kind) == "ai_summary") & (F.col("_t") == 0))).drop("_t")


def carry_forward(turns: DataFrame, key: str, turn: str, value: str, out: str) -> DataFrame:
    """Adds the last non-null value of the turns before."""
    before = Window.partitionBy(key).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn(out, F.last(value, ignorenulls=True).over(before))


def user_profiles(log: DataFrame, user: str, ts: str, kind: str, kinds: list[str], hours: int = 10) -> DataFrame:
    """(user, n, n_<kind>.., active_hours, engagement): counters and the last so many distinct hours of the day."""
    g = log.groupBy(user).agg(
        F.count("*").alias("n"), *[F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds], F.sort_array(F.collect_set(F.hour(ts))).alias("_h")
    )
    level = F.when(F.col("n") > 50, "high").when(F.col("n") > 10, "medium").otherwise("low")
    return g.withColumns({"active_hours": F.slice("_h", -F.least(F.lit(hours), F.size("_h")), hours), "engagement": level}).drop("_h")


def rerank(hits: DataFrame, query: str, text: str, scorer=None, most: int | None = 512) -> DataFrame:
    """Hits in the order of a scorer of (query, start of text), by default the share of the query's terms it holds. most: the
    length of that start (None: the whole text)."""
    from tidemark.operators.retrieval import terms

    def overlap(q: Column, t: Column) -> Column:
        return F.try_divide(F.size(F.array_intersect(terms(q), terms(t))), F.size(F.array_distinct(terms(q))))

    scored = hits.withColumn("rerank_score", (scorer or overlap)(F.col(query), F.col(text) if most is None else F.left(text, F.lit(most))))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank")
    return scored.withColumn("rank", F.row_number().over(w))
