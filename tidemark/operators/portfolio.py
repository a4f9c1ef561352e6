"""Portfolio analytics for many portfolios in one job, each keyed by portfolio_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import blank_to, risk_label, risk_score
from tidemark.operators import timeseries as ts


def portfolio_values(prices: DataFrame, spine: DataFrame, holdings: DataFrame, initial: float = 100_000.0) -> DataFrame:
    """(portfolio_id, d, value) on all dates of the spine (d, bench): weighted mean of the normalised prices present; a date on
    which no holding has a price has the initial value."""
    on_spine = prices.join(spine.select("d"), "d", "left_semi")
    norm = ts.normalize_first(on_spine, "symbol", "d", "close").select("symbol", "d", "norm")
    held = holdings.join(norm, "symbol").groupBy("portfolio_id", "d").agg(
        F.sum(F.col("weight") * F.col("norm")).alias("s"), F.sum("weight").alias("w")
    )
    # every portfolio has every date: the rows are the result's own, dates are one row a day
    days = holdings.select("portfolio_id").distinct().join(spine.select(F.collect_set("d").alias("_days"))).select("portfolio_id", F.explode("_days").alias("d"))
    held = days.join(held, ["portfolio_id", "d"], "left")
    return held.select("portfolio_id", "d", (initial * F.coalesce(F.try_divide("s", "w"), F.lit(1.0))).alias("value"))


def backtest(prices: DataFrame, benchmark: DataFrame, holdings: DataFrame, initial: float = 100_000.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, series, episodes) of each portfolio against the benchmark (d, bench)."""
    values = portfolio_values(prices, benchmark, holdings, initial)
    series = ts.drawdown_series(ts.daily_returns(values, "portfolio_id", "d", "value"), "portfolio_id", "d", "value")
    bench = benchmark.agg(F.min_by("bench", "d").alias("b0"), F.max_by("bench", "d").alias("b1"))
    s = series.groupBy("portfolio_id").agg(
        F.count("*").alias("days"),
        F.max_by("value", "d").alias("final_value"),
        F.greatest(F.datediff(F.max("d"), F.min("d")) / 365, F.lit(0.01)).alias("years"),
        (F.stddev_samp("ret") * F.sqrt(F.lit(252.0)) * 100).alias("volatility"),
        F.avg("ret").alias("mean_ret"),
        F.max("max_drawdown").alias("max_drawdown"),
    )
    s = s.join(F.broadcast(bench))  # one row
    total = (F.col("final_value") / initial - 1) * 100
    summary = s.select(
        "portfolio_id",
        "days",
        "final_value",
        total.alias("total_return"),
        ((F.pow(F.col("final_value") / initial, 1 / F.col("years")) - 1) * 100).alias("cagr"),
        (total - (F.col("b1") / F.col("b0") - 1) * 100).alias("alpha"),
        "volatility",
        F.coalesce(F.try_divide(F.col("mean_ret") * 252 * 100, F.col("volatility")), F.lit(0.0)).alias("sharpe"),
        "max_drawdown",
    )
    return summary, series, ts.drawdown_episodes(values, "portfolio_id", "d", "value")


def value_at_risk(returns: DataFrame, key: str = "portfolio_id", value: str = "ret") -> DataFrame:
    """VaR 95 and 99 as order statistics (0-based floor(n p)), CVaR 95 as the mean below, all in %."""
    w = Window.partitionBy(key)
    r = returns.where(F.col(value).isNotNull()).withColumns({"_r": F.row_number().over(w.orderBy(value)) - 1, "_n": F.count("*").over(w)})
    at = lambda p: F.abs(F.max(F.when(F.col("_r") == F.floor(F.col("_n") * p), F.col(value)))) * 100
    below = F.abs(F.avg(F.when(F.col("_r") < F.floor(F.col("_n") * 0.05), F.col(value)))) * 100
    return r.groupBy(key).agg(at(0.05).alias("var95"), at(0.01).alias("var99"), F.coalesce(below, at(0.05)).alias("cvar95"))


def risk_report(returns: DataFrame, bench: DataFrame, rf: float = 0.05, least: int = 30) -> DataFrame:
    """One row per portfolio from (portfolio_id, d, ret, value, max_drawdown) and (d, bret), aligned by date."""
    j = returns.where("ret IS NOT NULL").join(bench, "d", "left")
    g = j.groupBy("portfolio_id").agg(
        F.count("*").alias("n"),
        F.count("bret").alias("nb"),
        F.avg("ret").alias("m"),
        F.stddev_samp("ret").alias("sd"),
        F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))).alias("dsd"),
        F.count_if(F.col("ret") < 0).alias("negatives"),
        F.covar_samp("ret", "bret").alias("cov"),
        F.var_samp("bret").alias("vb"),
        F.corr("ret", "bret").alias("rho"),
        F.avg("bret").alias("mb"),
        F.max("max_drawdown").alias("max_drawdown"),
    )
    enough = F.col("nb") >= least
    beta = F.when(enough, F.coalesce(F.try_divide("cov", "vb"), F.lit(1.0))).otherwise(1.0)
    vol = F.col("sd") * F.sqrt(F.lit(252.0))
    sharpe = F.coalesce(F.try_divide(F.col("m") * 252 - rf, vol), F.lit(0.0))
    downside = F.coalesce(F.col("dsd"), F.lit(0.0)) * F.sqrt(F.lit(252.0))
    out = g.join(value_at_risk(returns), "portfolio_id").select(
        "portfolio_id",
        "n",
        (vol * 100).alias("volatility"),
        (F.col("sd") * F.sqrt(F.lit(21.0)) * 100).alias("monthly_volatility"),
        sharpe.alias("sharpe"),
        F.when(F.col("negatives") == 0, sharpe * 1.5).otherwise(F.coalesce(F.try_divide(F.col("m") * 252 - rf, downside), F.lit(0.0))).alias("sortino"),
        beta.alias("beta"),
        F.when(enough, (F.col("m") * 252 - (rf + beta * (F.col("mb") * 252 - rf))) * 100).otherwise(0.0).alias("alpha"),
        F.when(enough, F.coalesce(F.col("rho"), F.lit(0.0))).otherwise(0.8).alias("correlation"),
        "max_drawdown",
        "var95",
        "var99",
        "cvar95",
    )
    known = F.col("n") >= least
    score = F.when(known, risk_score(F.col("volatility"), F.col("max_drawdown"), F.col("beta"), F.col("var95"))).otherwise(5)
    return out.withColumn("risk_score", score).withColumn("risk_label", F.when(known, risk_label(F.col("risk_score"))).otherwise("Unknown"))


def sector_exposure(holdings: DataFrame, company: DataFrame) -> DataFrame:
    """(portfolio_id, sector, weight, n, symbols): the company table decides the sector, default Other."""
    j = holdings.join(company, "symbol", "left").withColumn("sector", blank_to(F.col("sector"), "Other"))
    return j.groupBy("portfolio_id", "sector").agg(
        F.sum("weight").alias("weight"), F.count("*").alias("n"), F.array_sort(F.collect_list("symbol")).alias("symbols")
    )


def concentration(holdings: DataFrame) -> DataFrame:
    """HHI of each portfolio and a 0 to 100 score of diversification (a single holding scores 0)."""
    g = holdings.groupBy("portfolio_id").agg(F.count("*").alias("n"), F.sum(F.pow(F.col("weight") / 100, 2) * 10_000).alias("hhi"))
    least = 10_000 / F.col("n")
    score = F.coalesce((100 - F.try_divide(F.col("hhi") - least, 10_000 - least) * 100).cast("int"), F.lit(0))
    return g.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)))


def exposure_report(holdings: DataFrame, company: DataFrame) -> DataFrame:
    """Concentration, number of sectors, largest sector and warnings of each portfolio."""
    e = sector_exposure(holdings, company).groupBy("portfolio_id").agg(
        F.count("*").alias("sectors"), F.max("weight").alias("top_sector_weight"), F.max_by("sector", F.struct("weight", "sector")).alias("top_sector")
    )
    top = ts.latest_n(holdings, ["portfolio_id"], [F.desc("weight"), F.asc("symbol")], 3).groupBy("portfolio_id").agg(
        F.count_if(F.col("weight") > 15).alias("heavy")
    )
    out = concentration(holdings).join(e, "portfolio_id").join(top, "portfolio_id")
    warnings = F.array_compact(
        F.array(
            F.when(F.col("top_sector_weight") > 30, "sector_over_30"),
            F.when(F.col("heavy") > 0, "holding_over_15"),
            F.when(F.col("sectors") < 4, "few_sectors"),
        )
    )
    return out.withColumn("warnings", F.array_join(warnings, ",")).drop("heavy")


def industry_exposure(holdings: DataFrame, company: DataFrame, n: int = 10) -> DataFrame:
    """(portfolio_id, industry, weight, n, rank): the n heaviest industries of each portfolio, default Other."""
    j = holdings.join(company, "symbol", "left").withColumn("industry", blank_to(F.col("industry"), "Other"))
    g = j.groupBy("portfolio_id", "industry").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("portfolio_id").orderBy(F.desc("weight"), "industry"))
    return g.withColumn("rank", rank).where(F.col("rank") <= n)


def full_analytics(prices: DataFrame, benchmark: DataFrame, holdings: DataFrame, company: DataFrame, initial: float = 100_000.0) -> DataFrame:
    """Back-test, risk and exposure of each portfolio in one row; risk rests on the returns of the rounded values."""
    summary, series, _ = backtest(prices, benchmark, holdings, initial)
    rounded = series.select("portfolio_id", "d", F.round("value", 2).alias("value"))
    risk_series = ts.drawdown_series(ts.daily_returns(rounded, "portfolio_id", "d", "value"), "portfolio_id", "d", "value")
    one = benchmark.withColumn("one", F.lit(1))  # the one benchmark series: a row a day
    bench = ts.daily_returns(one, "one", "d", "bench").select("d", F.col("ret").alias("bret"))
    risk = risk_report(risk_series, bench).select("portfolio_id", "sortino", "beta", "var95", "risk_score", "risk_label")
    exposure = exposure_report(holdings, company).select("portfolio_id", "hhi", "score", "sectors", "warnings")
    return summary.select("portfolio_id", "total_return", "cagr", "volatility", "max_drawdown").join(risk, "portfolio_id").join(exposure, "portfolio_id")


def insider_analysis(trades: DataFrame, strong: int = 3, asof: str | None = None, days: int = 90) -> DataFrame:
    """(symbol, trades, buys, sells, buyers, net_value, signals, sentiment) from (symbol, insider, kind P/S, role, value); with
    asof only the trades (d) of so many days up to it count."""
    if asof is not None:
        end = F.lit(asof).cast("date")
        trades = trades.where((F.col("d") > F.date_sub(end, days)) & (F.col("d") <= end))
    if "role" not in trades.columns:
        trades = trades.withColumn("role", F.lit(None).cast("string"))
    buy, sell = F.col("kind") == "P", F.col("kind") == "S"
    g = trades.groupBy("symbol").agg(
        F.count("*").alias("trades"),
        F.count_if(buy).alias("buys"),
        F.count_if(sell).alias("sells"),
        F.count_distinct(F.when(buy, F.col("insider"))).alias("buyers"),
        F.count_if(buy & F.col("role").isin("CEO", "CFO")).alias("executive_buys"),
        F.coalesce(F.sum(F.when(sell, F.col("value"))), F.lit(0.0)).alias("sold"),
        F.coalesce(F.sum(F.when(buy, F.col("value")).when(sell, -F.col("value"))), F.lit(0.0)).alias("net_value"),
    )
    cluster = (F.col("buys") >= 3) & (F.col("buyers") >= 2)
    selling = (F.col("sells") >= 5) | (F.col("sold") > 1e7)
    signals = F.array_compact(
        F.array(
            F.when(cluster, F.when(F.col("buyers") >= strong, "cluster_buy:strong").otherwise("cluster_buy:moderate")),
            F.when(F.col("executive_buys") > 0, "executive_buying:strong"),
            F.when(selling, F.when(F.col("sells") >= 8, "insider_selling:strong").otherwise("insider_selling:moderate")),
        )
    )
    net = F.when(F.col("buys") > F.col("sells"), "bullish").when(F.col("sells") > F.col("buys"), "bearish").otherwise("neutral")
    return g.withColumns({"signals": F.array_join(signals, ","), "sentiment": net}).drop("sold", "executive_buys")


def consensus(rows: DataFrame, lists: bool = False) -> DataFrame:
    """Confidence-weighted rating of each symbol from (symbol, rating -1..1, confidence); with lists also the first two
    catalysts and risks of each analyst (in order of analyst), five at most."""
    aggs = [F.coalesce(F.try_divide(F.sum(F.col("rating") * F.col("confidence")), F.sum("confidence")), F.lit(0.0)).alias("score"), F.count("*").alias("n")]
    if lists:
        # analysts of a symbol are few; what meets in a row is two texts of each
        each = lambda c: F.slice(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("analyst", F.slice(c, 1, 2).alias("x")))), lambda s: s["x"])), 1, 5)
        aggs += [each("catalysts").alias("catalysts"), each("risks").alias("risks")]
    g = rows.groupBy("symbol").agg(*aggs)
    label = F.when(F.col("score") > 0.3, "bullish").when(F.col("score") < -0.3, "bearish").otherwise("neutral")
    return g.withColumns({"consensus": label, "conviction": (F.abs("score") * 100).cast("int")})


def sentiment_analyst(sentiment: DataFrame) -> DataFrame:
    """An analyst's row for each symbol from (symbol, sentiment): 1 up or down beyond 0.3, confidence 0.6."""
    x = F.col("sentiment")
    rating = F.when(x > 0.3, 1.0).when(x < -0.3, -1.0).otherwise(0.0)
    return sentiment.select("symbol", F.lit("sentiment").alias("analyst"), rating.alias("rating"), F.lit(0.6).alias("confidence"))


def swarm_rollup(rows: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Consensus over the analysts' rows and the rule-based one."""
    mine = sentiment_analyst(sentiment)
    return consensus(rows.select("symbol", "analyst", "rating", "confidence").unionByName(mine))


def blend_sentiment(rows: DataFrame) -> DataFrame:
    """(symbol, blended) from (symbol, role, sentiment): financial 0.4, strategic 0.35, tone 0.25; absent roles count 0."""
    weight = F.when(F.col("role") == "financial", 0.4).when(F.col("role") == "strategic", 0.35).when(F.col("role") == "tone", 0.25).otherwise(0.0)
    return rows.groupBy("symbol").agg(F.sum(weight * F.col("sentiment")).alias("blended"))
