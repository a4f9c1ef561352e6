"""Window operators over dated series; every window is partitioned by the series key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(key: str, date: str):
    return Window.partitionBy(key).orderBy(date)


def normalize_first(df: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Adds norm: the value over the first value of its series."""
    first = F.first(value, ignorenulls=True).over(_by(key, date).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("norm", F.try_divide(F.col(value), first))


def daily_returns(df: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Adds ret: the change over the row before."""
    return df.withColumn("ret", F.try_divide(F.col(value), F.lag(value).over(_by(key, date))) - 1)


def drawdown_series(df: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Adds peak, drawdown (% under the peak) and max_drawdown so far."""
    so_far = _by(key, date).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("peak", F.max(value).over(so_far))
    out = out.withColumn("drawdown", F.coalesce(F.try_divide(F.col("peak") - F.col(value), F.col("peak")) * 100, F.lit(0.0)))
    return out.withColumn("max_drawdown", F.max("drawdown").over(so_far))


def drawdown_episodes(df: DataFrame, key: str, date: str, value: str, least: float = 5.0, most: int = 5, mode: str = "reference") -> DataFrame:
    """Closed episodes under a peak that went deeper than least %: start (first deep date), end (last date before the
    new peak), depth (deepest so far, or of the episode with mode 'episode'); the first ones of each series."""
    s = drawdown_series(df, key, date, value)
    w = _by(key, date)
    prev = F.lag("peak").over(w)
    s = s.withColumn("_i", F.sum(F.when(prev.isNull() | (F.col(value) > prev), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = s.groupBy(key, "_i").agg(
        F.min(F.when(F.col("drawdown") > least, F.col(date))).alias("start"),
        F.max(date).alias("end"),
        F.max("max_drawdown" if mode == "reference" else "drawdown").alias("depth"),
    )
    last = F.max("_i").over(Window.partitionBy(key))
    closed = g.withColumn("_last", last).where("start IS NOT NULL AND _i < _last")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("start"))
    return closed.withColumn("episode", rank).where(F.col("episode") <= most).select(key, "episode", "start", "end", "depth")


def underwater(df: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """(key, longest run of closed rows at or under a peak, mean of drawdowns over 1 %)."""
    s = drawdown_series(df, key, date, value)
    w = _by(key, date)
    prev = F.lag("peak").over(w)
    s = s.withColumn("_i", F.sum(F.when(prev.isNull() | (F.col(value) > prev), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = s.groupBy(key, "_i").agg((F.count("*") - 1).alias("n"), F.sum(F.when(F.col("drawdown") > 1, F.col("drawdown"))).alias("s"), F.count_if(F.col("drawdown") > 1).alias("c"))
    g = g.withColumn("_last", F.max("_i").over(Window.partitionBy(key)))
    return g.groupBy(key).agg(
        F.coalesce(F.max(F.when(F.col("_i") < F.col("_last"), F.col("n"))), F.lit(0)).alias("longest_underwater"),
        F.coalesce(F.try_divide(F.sum("s"), F.sum("c")), F.lit(0.0)).alias("mean_drawdown"),
    )


def trailing_return(df: DataFrame, key: str, date: str, value: str, points: list[int]) -> DataFrame:
    """(key, r_N): change over the last N points, 0 for a shorter series."""
    desc = Window.partitionBy(key).orderBy(F.desc(date))
    s = df.withColumn("_r", F.row_number().over(desc))
    at = lambda n: F.max(F.when(F.col("_r") == n, F.col(value)))
    return s.groupBy(key).agg(*[F.coalesce(F.try_divide(at(1), at(n)) - 1, F.lit(0.0)).alias(f"r_{n}") for n in points])


def moving_average(key: str, date: str, value: str, n: int) -> Column:
    w = _by(key, date).rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(w) == n, F.avg(value).over(w))


def rsi(df: DataFrame, key: str, date: str, value: str, n: int = 14) -> DataFrame:
    """Adds rsi with simple means; the first change counts as 0."""
    d = F.coalesce(F.col(value) - F.lag(value).over(_by(key, date)), F.lit(0.0))
    w = _by(key, date).rowsBetween(-(n - 1), 0)
    out = df.withColumn("_d", d)
    up, down = F.avg(F.greatest(F.col("_d"), F.lit(0.0))).over(w), F.avg(F.greatest(-F.col("_d"), F.lit(0.0))).over(w)
    value_ = F.when(F.count("_d").over(w) < n, None).when((down == 0) & (up == 0), None).when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / down))
    return out.withColumn("rsi", value_).drop("_d")


def technical_snapshot(prices: DataFrame, key: str, date: str, value: str, year: int = 252) -> DataFrame:
    """Last row of each series of 50 points or more: averages, RSI, range of a year, trend label."""
    w = _by(key, date).rowsBetween(-(year - 1), 0)
    s = rsi(prices, key, date, value)
    s = s.withColumns(
        {
            "dma_50": moving_average(key, date, value, 50),
            "dma_200": moving_average(key, date, value, 200),
            "high": F.max(value).over(w),
            "low": F.min(value).over(w),
            "n": F.count("*").over(Window.partitionBy(key)),
            "_r": F.row_number().over(Window.partitionBy(key).orderBy(F.desc(date))),
        }
    ).where("_r = 1 AND n >= 50")
    above50, above200 = F.coalesce(F.col(value) > F.col("dma_50"), F.lit(False)), F.coalesce(F.col(value) > F.col("dma_200"), F.lit(False))
    trend = (
        F.when(above50 & above200 & (F.col("rsi") > 50), "Strong Uptrend")
        .when(above50 & above200, "Uptrend")
        .when(~above50 & ~above200 & (F.col("rsi") < 50), "Strong Downtrend")
        .when(~above50 & ~above200, "Downtrend")
        .otherwise("Sideways")
    )
    return s.withColumns(
        {
            "from_high": F.try_divide(F.col(value) - F.col("high"), F.col("high")) * 100,
            "position": F.try_divide(F.col(value) - F.col("low"), F.col("high") - F.col("low")) * 100,
            "trend": trend,
        }
    ).drop("_r", "n")


def long_term_trend(df: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """(key, first, last, total change %, yearly growth % over the actual days)."""
    g = df.where(F.col(value).isNotNull()).groupBy(key).agg(
        F.min_by(value, date).alias("first"), F.max_by(value, date).alias("last"), F.datediff(F.max(date), F.min(date)).alias("days")
    )
    years = F.col("days") / 365.25
    ratio = F.try_divide(F.col("last"), F.col("first"))
    return g.withColumns(
        {"change": (ratio - 1) * 100, "cagr": F.when((F.col("days") > 0) & (ratio > 0), (F.pow(ratio, 1 / years) - 1) * 100)}
    )


def latest_n(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order (which should break ties)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def sentiment_trend(df: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Newest-two mean less oldest-two mean: direction and strength; under three rows 'insufficient'."""
    w = Window.partitionBy(key)
    s = df.withColumns({"_a": F.row_number().over(w.orderBy(date)), "_d": F.row_number().over(w.orderBy(F.desc(date)))})
    g = s.groupBy(key).agg(
        F.count("*").alias("n"),
        (F.avg(F.when(F.col("_d") <= 2, F.col(value))) - F.avg(F.when(F.col("_a") <= 2, F.col(value)))).alias("delta"),
    )
    label = F.when(F.col("n") < 3, "insufficient").when(F.col("delta") > 0.2, "improving").when(F.col("delta") < -0.2, "declining").otherwise("stable")
    return g.withColumns({"trend": label, "strength": F.least(F.lit(1.0), F.abs("delta") / 0.5)})


def period_growth(df: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The last period of each key with growth % of each value over the period before (0 if that is not positive)."""
    w = Window.partitionBy(key).orderBy(*order)
    out = df
    for v in values:
        before = F.lag(v).over(w)
        out = out.withColumn(f"{v}_growth", F.when(before.isNull(), None).when(before > 0, (F.col(v) / before - 1) * 100).otherwise(F.lit(0.0)))
    return latest_n(out, [key], [F.desc(c) for c in order])


def assign_positions(signups: DataFrame, stored: DataFrame, at: str, first: int = 77) -> DataFrame:
    """(email, market, position) of new signups (email, market, at): the first of each lower-case trimmed email and market
    counts, positions follow the largest stored one (market, position) and start at `first`."""
    email = F.lower(F.trim("email"))
    new = signups.groupBy(email.alias("email"), "market").agg(F.min(at).alias("_at"))
    top = stored.groupBy("market").agg(F.max("position").alias("_top"))
    number = F.row_number().over(Window.partitionBy("market").orderBy("_at", "email"))
    out = new.join(top, "market", "left").withColumn("position", (F.greatest(F.coalesce("_top", F.lit(0)), F.lit(first - 1)) + number).cast("int"))
    return out.select("email", "market", "position")
