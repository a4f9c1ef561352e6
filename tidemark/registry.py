"""Queries over the test tables, with the SQL that gives the same rows.

orders stand for prices (symbol: market segment, close: mean order price), nations for portfolios, parts for companies,
events for trades and alerts, documents for filings, conversations for the query log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as sc
from tidemark.functions import signals as sg
from tidemark.operators import merge as mg
from tidemark.operators import portfolio as pf
from tidemark.operators import retrieval as rt
from tidemark.operators import timeseries as ts
from tidemark.operators.stored import read_stored, upsert_stored
from tidemark.sources import payloads as py
from tidemark.sources import store
from tidemark.streaming import jobs

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "c1_backtest_summary"


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    store.safe_unions(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def r(c, n: int = 6):
    return F.round(c, n)


def prices(spark, d) -> DataFrame:
    """Monthly closes by market segment."""
    o = table(spark, d, "orders").join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    return o.groupBy(F.col("c_mktsegment").alias("symbol"), month.alias("d")).agg(F.avg("o_totalprice").alias("close"))


PRICES = """prices AS (SELECT c_mktsegment AS symbol, date_trunc('month', o_orderdate)::date AS d, avg(o_totalprice) AS close
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def benchmark(spark, d) -> DataFrame:
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    return table(spark, d, "orders").groupBy(month.alias("d")).agg(F.avg("o_totalprice").alias("bench"))


BENCH = "bench AS (SELECT date_trunc('month', o_orderdate)::date AS d, avg(o_totalprice) AS bench FROM orders GROUP BY ALL)"


def holdings(spark, d) -> DataFrame:
    """Each nation holds the segments of its customers, by share."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("portfolio_id"), F.col("c_mktsegment").alias("symbol")).agg(F.count("*").alias("n"))
    return c.withColumn("weight", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("portfolio_id"))).drop("n")


HOLD = """hold AS (SELECT c_nationkey AS portfolio_id, c_mktsegment AS symbol,
  count(*) * 100.0::double / sum(count(*)) OVER (PARTITION BY c_nationkey) AS weight FROM customer GROUP BY c_nationkey, c_mktsegment)"""
VALUES = f"""{PRICES}, {BENCH}, {HOLD},
norm AS (SELECT symbol, d, close / first_value(close) OVER (PARTITION BY symbol ORDER BY d) AS norm FROM prices SEMI JOIN bench USING (d)),
held AS (SELECT portfolio_id, d, sum(weight * norm) / sum(weight) AS x FROM hold JOIN norm USING (symbol) GROUP BY ALL),
val AS (SELECT portfolio_id, d, 100000.0::double * coalesce(x, 1) AS value FROM (SELECT DISTINCT portfolio_id FROM hold) CROSS JOIN bench LEFT JOIN held USING (portfolio_id, d)),
ret AS (SELECT *, value / lag(value) OVER w - 1 AS ret, max(value) OVER w AS peak FROM val
  WINDOW w AS (PARTITION BY portfolio_id ORDER BY d)),
dd AS (SELECT *, (peak - value) / peak * 100 AS drawdown, max((peak - value) / peak * 100) OVER (PARTITION BY portfolio_id ORDER BY d) AS max_drawdown FROM ret)"""


def series(spark, d) -> DataFrame:
    return pf.backtest(prices(spark, d), benchmark(spark, d), holdings(spark, d))[1]


@query(f"""WITH {VALUES}, b AS (SELECT arg_min(bench, d) b0, arg_max(bench, d) b1 FROM bench),
s AS (SELECT portfolio_id, count(*) AS days, arg_max(value, d) AS final_value, greatest(date_diff('day', min(d), max(d)) / 365.0, 0.01) AS years,
  stddev_samp(ret) * sqrt(252) * 100 AS volatility, avg(ret) AS m, max(max_drawdown) AS max_drawdown FROM dd GROUP BY 1)
SELECT portfolio_id, days, round(final_value, 4) AS final_value, round((final_value / 100000 - 1) * 100, 6) AS total_return,
  round((pow(final_value / 100000, 1 / years) - 1) * 100, 6) AS cagr, round((final_value / 100000 - 1) * 100 - (b1 / b0 - 1) * 100, 6) AS alpha,
  round(volatility, 6) AS volatility, round(coalesce(m * 25200 / volatility, 0), 6) AS sharpe, round(max_drawdown, 6) AS max_drawdown FROM s, b""")
def c1_backtest_summary(spark, d):
    s = pf.backtest(prices(spark, d), benchmark(spark, d), holdings(spark, d))[0]
    return s.select("portfolio_id", "days", r("final_value", 4).alias("final_value"), *[r(c).alias(c) for c in ("total_return", "cagr", "alpha", "volatility", "sharpe", "max_drawdown")])


@query(f"WITH {VALUES} SELECT portfolio_id, d, round(value, 4) AS value, round(ret, 8) AS ret, round(drawdown, 6) AS drawdown, round(max_drawdown, 6) AS max_drawdown FROM dd")
def w3_drawdown_series(spark, d):
    return series(spark, d).select("portfolio_id", "d", r("value", 4).alias("value"), r("ret", 8).alias("ret"), r("drawdown").alias("drawdown"), r("max_drawdown").alias("max_drawdown"))


@query(f"""WITH {VALUES}, g AS (SELECT *, sum(CASE WHEN p IS NULL OR value > p THEN 1 ELSE 0 END) OVER (PARTITION BY portfolio_id ORDER BY d) AS i
  FROM (SELECT *, lag(peak) OVER (PARTITION BY portfolio_id ORDER BY d) AS p FROM dd)),
e AS (SELECT portfolio_id, i, min(CASE WHEN drawdown > 5 THEN d END) AS s, max(d) AS z, max(max_drawdown) AS depth, max(max(i)) OVER (PARTITION BY portfolio_id) AS li FROM g GROUP BY portfolio_id, i),
k AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY s) AS episode FROM e WHERE s IS NOT NULL AND i < li)
SELECT portfolio_id, episode::int AS episode, s AS start, z AS "end", round(depth, 6) AS depth FROM k WHERE episode <= 5""")
def w4_drawdown_episodes(spark, d):
    e = pf.backtest(prices(spark, d), benchmark(spark, d), holdings(spark, d))[2]
    return e.withColumn("depth", r("depth"))


@query(f"""WITH {VALUES}, g AS (SELECT *, sum(CASE WHEN p IS NULL OR value > p THEN 1 ELSE 0 END) OVER (PARTITION BY portfolio_id ORDER BY d) AS i
  FROM (SELECT *, lag(peak) OVER (PARTITION BY portfolio_id ORDER BY d) AS p FROM dd)),
e AS (SELECT portfolio_id, i, count(*) - 1 AS n, max(max(i)) OVER (PARTITION BY portfolio_id) AS li FROM g GROUP BY portfolio_id, i),
m AS (SELECT portfolio_id, avg(CASE WHEN drawdown > 1 THEN drawdown END) AS md FROM dd GROUP BY 1)
SELECT portfolio_id, coalesce(max(CASE WHEN i < li THEN n END), 0) AS longest_underwater, round(coalesce(any_value(md), 0), 6) AS mean_drawdown FROM e JOIN m USING (portfolio_id) GROUP BY portfolio_id""")
def w5_underwater(spark, d):
    v = pf.portfolio_values(prices(spark, d), benchmark(spark, d), holdings(spark, d))
    return ts.underwater(v, "portfolio_id", "d", "value").withColumn("mean_drawdown", r("mean_drawdown"))


@query(f"""WITH {VALUES}, q AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY d DESC) AS k FROM val)
SELECT portfolio_id, round(coalesce(max(CASE WHEN k = 1 THEN value END) / max(CASE WHEN k = 12 THEN value END) - 1, 0), 8) AS r_12,
  round(coalesce(max(CASE WHEN k = 1 THEN value END) / max(CASE WHEN k = 36 THEN value END) - 1, 0), 8) AS r_36 FROM q GROUP BY 1""")
def w6_trailing_return(spark, d):
    v = pf.portfolio_values(prices(spark, d), benchmark(spark, d), holdings(spark, d))
    t = ts.trailing_return(v, "portfolio_id", "d", "value", [12, 36])
    return t.select("portfolio_id", r("r_12", 8).alias("r_12"), r("r_36", 8).alias("r_36"))


@query(f"""WITH {VALUES}, o AS (SELECT portfolio_id, ret, row_number() OVER (PARTITION BY portfolio_id ORDER BY ret) - 1 AS k, count(*) OVER (PARTITION BY portfolio_id) AS n FROM ret WHERE ret IS NOT NULL)
SELECT portfolio_id, round(abs(max(CASE WHEN k = floor(n * 0.05) THEN ret END)) * 100, 6) AS var95, round(abs(max(CASE WHEN k = floor(n * 0.01) THEN ret END)) * 100, 6) AS var99,
  round(coalesce(abs(avg(CASE WHEN k < floor(n * 0.05) THEN ret END)) * 100, abs(max(CASE WHEN k = floor(n * 0.05) THEN ret END)) * 100), 6) AS cvar95 FROM o GROUP BY 1""")
def a9_value_at_risk(spark, d):
    v = pf.value_at_risk(series(spark, d))
    return v.select("portfolio_id", *[r(c).alias(c) for c in ("var95", "var99", "cvar95")])


@query(f"""WITH {VALUES}, br AS (SELECT d, bench / lag(bench) OVER (ORDER BY d) - 1 AS bret FROM bench),
j AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY ret) - 1 AS k, count(*) OVER (PARTITION BY portfolio_id) AS nn FROM dd WHERE ret IS NOT NULL) LEFT JOIN br USING (d)),
g AS (SELECT portfolio_id, count(*) AS n, avg(ret) AS m, stddev_samp(ret) AS sd, coalesce(stddev_samp(CASE WHEN ret < 0 THEN ret END), 0) AS dsd, count(*) FILTER (ret < 0) AS neg,
  covar_samp(ret, bret) / var_samp(bret) AS beta, corr(ret, bret) AS rho, avg(bret) AS mb, max(max_drawdown) AS mdd, abs(max(CASE WHEN k = floor(nn * 0.05) THEN ret END)) * 100 AS v95,
  abs(max(CASE WHEN k = floor(nn * 0.01) THEN ret END)) * 100 AS v99, abs(avg(CASE WHEN k < floor(nn * 0.05) THEN ret END)) * 100 AS below FROM j GROUP BY 1),
x AS (SELECT *, sd * sqrt(252) * 100 AS vol, (m * 252 - 0.05) / (sd * sqrt(252)) AS sharpe FROM g),
y AS (SELECT *, greatest(1, least(10, round_even(0.3 * least(vol / 5, 10) + 0.3 * least(mdd / 10, 10) + 0.2 * least(beta * 5, 10) + 0.2 * least(v95 / 0.5, 10), 0)::int)) AS risk FROM x)
SELECT portfolio_id, n, round(beta, 6) AS beta, round(rho, 6) AS correlation, round((m * 252 - (0.05 + beta * (mb * 252 - 0.05))) * 100, 4) AS alpha, round(vol, 6) AS volatility,
  round(sd * sqrt(21) * 100, 6) AS monthly_volatility, round(sharpe, 6) AS sharpe, round(CASE WHEN neg = 0 THEN sharpe * 1.5 ELSE coalesce((m * 252 - 0.05) / nullif(dsd * sqrt(252), 0), 0) END, 6) AS sortino,
  round(mdd, 6) AS max_drawdown, round(v95, 6) AS var95, round(v99, 6) AS var99, round(coalesce(below, v95), 6) AS cvar95, risk AS risk_score,
  CASE WHEN risk <= 3 THEN 'Low' WHEN risk <= 5 THEN 'Moderate' WHEN risk <= 7 THEN 'High' ELSE 'Very High' END AS risk_label FROM y""")
def c2_risk_report(spark, d):
    b = benchmark(spark, d).withColumn("one", F.lit(1))
    bench = ts.daily_returns(b, "one", "d", "bench").select("d", F.col("ret").alias("bret"))
    x = pf.risk_report(series(spark, d), bench)
    six = ("beta", "correlation", "volatility", "monthly_volatility", "sharpe", "sortino", "max_drawdown", "var95", "var99", "cvar95")
    return x.select("portfolio_id", "n", *[r(c).alias(c) for c in six], r("alpha", 4).alias("alpha"), "risk_score", "risk_label")


@query(f"""WITH {HOLD}, m(symbol, sector) AS (VALUES ('AUTOMOBILE', 'Industry'), ('MACHINERY', 'Industry'), ('BUILDING', 'Industry'), ('HOUSEHOLD', 'Consumer'))
SELECT portfolio_id, coalesce(sector, 'Other') AS sector, round(sum(weight), 6) AS weight, count(*) AS n, string_agg(symbol, ',' ORDER BY symbol) AS symbols
FROM hold LEFT JOIN m USING (symbol) GROUP BY ALL""")
def a1_sector_exposure(spark, d):
    e = pf.sector_exposure(holdings(spark, d), company(spark))
    return e.select("portfolio_id", "sector", r("weight").alias("weight"), "n", F.array_join("symbols", ",").alias("symbols"))


def company(spark) -> DataFrame:
    return spark.createDataFrame([("AUTOMOBILE", "Industry"), ("MACHINERY", "Industry"), ("BUILDING", "Industry"), ("HOUSEHOLD", "Consumer")], "symbol string, sector string")


@query(f"""WITH {HOLD}, g AS (SELECT portfolio_id, count(*) AS n, sum(pow(weight / 100, 2) * 10000) AS hhi FROM hold GROUP BY 1)
SELECT portfolio_id, n, round(hhi, 6) AS hhi, greatest(0, least(100, coalesce(trunc(100 - (hhi - 10000.0 / n) / nullif(10000 - 10000.0 / n, 0) * 100), 0)))::int AS score FROM g""")
def a2_concentration(spark, d):
    return pf.concentration(holdings(spark, d)).withColumn("hhi", r("hhi"))


@query(f"""WITH {PRICES}, a AS (SELECT *, count(*) OVER (PARTITION BY symbol ORDER BY d ROWS 11 PRECEDING) AS c12, avg(close) OVER (PARTITION BY symbol ORDER BY d ROWS 11 PRECEDING) AS a12,
  coalesce(close - lag(close) OVER (PARTITION BY symbol ORDER BY d), 0) AS ch FROM prices),
b AS (SELECT *, count(*) OVER w AS c14, avg(greatest(ch, 0)) OVER w AS up, avg(greatest(-ch, 0)) OVER w AS dn FROM a WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS 13 PRECEDING))
SELECT symbol, d, round(CASE WHEN c12 = 12 THEN a12 END, 4) AS ma_12, round(CASE WHEN c14 < 14 OR (up = 0 AND dn = 0) THEN NULL WHEN dn = 0 THEN 100 ELSE 100 - 100 / (1 + up / dn) END, 6) AS rsi FROM b""")
def w7_w8_average_and_rsi(spark, d):
    p = ts.rsi(prices(spark, d), "symbol", "d", "close")
    return p.select("symbol", "d", r(ts.moving_average("symbol", "d", "close", 12), 4).alias("ma_12"), r("rsi").alias("rsi"))


@query(f"""WITH {PRICES}, c AS (SELECT *, coalesce(close - lag(close) OVER (PARTITION BY symbol ORDER BY d), 0) AS ch FROM prices),
x AS (SELECT *, max(close) OVER w AS high, min(close) OVER w AS low, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS k, count(*) OVER (PARTITION BY symbol) AS n,
  avg(close) OVER a AS d50, count(*) OVER b AS n200, avg(close) OVER b AS d200, avg(greatest(ch, 0)) OVER s AS up, avg(greatest(-ch, 0)) OVER s AS dn
  FROM c WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS 251 PRECEDING), a AS (PARTITION BY symbol ORDER BY d ROWS 49 PRECEDING), b AS (PARTITION BY symbol ORDER BY d ROWS 199 PRECEDING), s AS (PARTITION BY symbol ORDER BY d ROWS 13 PRECEDING)),
y AS (SELECT *, CASE WHEN up = 0 AND dn = 0 THEN NULL WHEN dn = 0 THEN 100 ELSE 100 - 100 / (1 + up / dn) END AS rsi, close > d50 AS a50, coalesce(n200 = 200 AND close > d200, false) AS a200 FROM x WHERE k = 1 AND n >= 50)
SELECT symbol, d, round(close, 4) AS close, round(high, 4) AS high, round(low, 4) AS low, round((close - high) / high * 100, 6) AS from_high, round((close - low) / (high - low) * 100, 6) AS position,
  round(d50, 4) AS dma_50, round(CASE WHEN n200 = 200 THEN d200 END, 4) AS dma_200, round(rsi, 6) AS rsi,
  CASE WHEN a50 AND a200 AND rsi > 50 THEN 'Strong Uptrend' WHEN a50 AND a200 THEN 'Uptrend' WHEN NOT a50 AND NOT a200 AND rsi < 50 THEN 'Strong Downtrend' WHEN NOT a50 AND NOT a200 THEN 'Downtrend' ELSE 'Sideways' END AS trend FROM y""")
def c7_technical_snapshot(spark, d):
    s = ts.technical_snapshot(prices(spark, d), "symbol", "d", "close")
    return s.select("symbol", "d", *[r(c, 4).alias(c) for c in ("close", "high", "low", "dma_50", "dma_200")], *[r(c).alias(c) for c in ("from_high", "position", "rsi")], "trend")


@query(f"""WITH {PRICES}, g AS (SELECT symbol, arg_min(close, d) AS f, arg_max(close, d) AS l, date_diff('day', min(d), max(d)) AS days FROM prices GROUP BY 1)
SELECT symbol, round(f, 4) AS "first", round(l, 4) AS "last", days::int AS days, round((l / f - 1) * 100, 6) AS change, round((pow(l / f, 365.25 / days) - 1) * 100, 6) AS cagr FROM g""")
def w16_long_term_trend(spark, d):
    t = ts.long_term_trend(prices(spark, d), "symbol", "d", "close")
    return t.select("symbol", r("first", 4).alias("first"), r("last", 4).alias("last"), "days", r("change").alias("change"), r("cagr").alias("cagr"))


def quarters(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    day = F.col("l_shipdate").cast("date")
    rev = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy(F.col("l_returnflag").alias("symbol"), sc.fiscal_year(day).alias("fy"), sc.fiscal_quarter(day).alias("q")).agg(F.sum(rev).alias("revenue"), F.sum(rev * F.col("l_tax")).alias("tax"))


QUARTERS = """qs AS (SELECT l_returnflag AS symbol, (year(l_shipdate) + (month(l_shipdate) >= 4)::int)::int AS fy,
  'Q' || (((month(l_shipdate) - 4 + 12) % 12) // 3 + 1) AS q, sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_extendedprice * (1 - l_discount) * l_tax) AS tax FROM lineitem GROUP BY ALL)"""


@query(f"WITH {QUARTERS} SELECT symbol, fy, q, round(revenue, 2) AS revenue, round((revenue - tax) / revenue * 100, 6) AS margin FROM qs")
def w18_margin_by_quarter(spark, d):
    return quarters(spark, d).select("symbol", "fy", "q", r("revenue", 2).alias("revenue"), r(F.try_divide(F.col("revenue") - F.col("tax"), F.col("revenue")) * 100).alias("margin"))


@query(f"""WITH {QUARTERS}, g AS (SELECT *, lag(revenue) OVER w AS p, row_number() OVER (PARTITION BY symbol ORDER BY fy DESC, q DESC) AS k FROM qs WINDOW w AS (PARTITION BY symbol ORDER BY fy, q))
SELECT symbol, fy, q, round(revenue, 2) AS revenue, round(CASE WHEN p IS NULL THEN NULL WHEN p > 0 THEN (revenue / p - 1) * 100 ELSE 0 END, 6) AS revenue_growth FROM g WHERE k = 1""")
def w19_quarterly_comparison(spark, d):
    g = ts.period_growth(quarters(spark, d), "symbol", ["fy", "q"], ["revenue"])
    return g.select("symbol", "fy", "q", r("revenue", 2).alias("revenue"), r("revenue_growth").alias("revenue_growth"))


@query("""SELECT o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS F, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS O,
  round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS P FROM orders GROUP BY 1""")
def j10_comparison_matrix(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.sum("o_totalprice"))
    return o.select("o_orderpriority", *[r(c, 2).alias(c) for c in "FOP"])


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 3""")
def s12_latest_n(spark, d):
    return ts.latest_n(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT c_custkey, c_name, o_orderkey AS last_order FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def j1_with_latest(spark, d):
    last = ts.latest_n(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("last_order"))
    return table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", "last_order")


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def j2_pending_documents(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@query("""WITH a AS (SELECT source, count(*) AS docs, min(2015 + doc_id % 10) AS first_year, max(2015 + doc_id % 10) AS last_year FROM documents GROUP BY 1),
b AS (SELECT source, count(*) AS labelled FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT source, coalesce(docs, 0) AS docs, coalesce(labelled, 0) AS labelled, first_year, last_year FROM a FULL JOIN b USING (source)""")
def j3_coverage_table(spark, d):
    docs = table(spark, d, "documents")
    year = 2015 + F.col("doc_id") % 10
    a = docs.groupBy("source").agg(F.count("*").alias("docs"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    b = table(spark, d, "labels").select("doc_id").join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("labelled"))
    j = a.join(b, "source", "full_outer")
    return j.select("source", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("labelled", F.lit(0)).alias("labelled"), "first_year", "last_year")


@query("SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_keys, min(o_orderdate)::date AS first_date, max(o_orderdate)::date AS last_date FROM orders")
def a4_table_profile(spark, d):
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").agg(F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("n_keys"), F.min(day).alias("first_date"), F.max(day).alias("last_date"))


@query("""SELECT source, count(*) AS docs, round(avg(length(text)), 6) AS avg_chars, sum(length(text))::bigint AS chars,
  (greatest(1, floor(avg(length(text)) / 4000)) * count(*))::bigint AS chunks FROM documents GROUP BY 1""")
def a5_corpus_estimate(spark, d):
    n = F.length("text")
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.avg(n).alias("a"), F.sum(n).alias("chars"))
    return g.select("source", "docs", r("a").alias("avg_chars"), "chars", (F.greatest(F.lit(1), F.floor(F.col("a") / 4000)) * F.col("docs")).cast("long").alias("chunks"))


def _upsert(spark, d):
    """Closed orders are stored; the batch has the open ones and those in both, urgent ones twice (seq)."""
    o = table(spark, d, "orders")
    old = o.where("o_orderstatus <> 'O'").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderstatus <> 'F'")
    status = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus"))
    one = new.select("o_orderkey", status.alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(1).alias("seq"))
    two = new.where("o_orderpriority LIKE '1%'").select("o_orderkey", F.lit(None).cast("string").alias("o_orderstatus"), (F.col("o_totalprice") + 2).alias("o_totalprice"), F.lit(2).alias("seq"))
    return old, one.unionByName(two)


UPSERT = """old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'O'),
batch AS (SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderstatus END AS o_orderstatus, o_totalprice + 1 AS o_totalprice, 1 AS seq FROM orders WHERE o_orderstatus <> 'F'
  UNION ALL SELECT o_orderkey, NULL, o_totalprice + 2, 2 FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority LIKE '1%'),
new AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) AS k FROM batch) WHERE k = 1),
early AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM batch WHERE seq = 1)"""


@query(f"WITH {UPSERT} SELECT * FROM new UNION ALL SELECT * FROM old ANTI JOIN new USING (o_orderkey)")
def m1_replace(spark, d):
    return mg.merge_into(*_upsert(spark, d), ["o_orderkey"], "replace", seq="seq")


@query(f"""WITH {UPSERT} SELECT o_orderkey, coalesce(early.o_orderstatus, old.o_orderstatus) AS o_orderstatus, coalesce(new.o_totalprice, old.o_totalprice) AS o_totalprice
FROM old FULL JOIN new USING (o_orderkey) LEFT JOIN early USING (o_orderkey)""")
def m2_coalesce(spark, d):
    return mg.merge_into(*_upsert(spark, d), ["o_orderkey"], "coalesce", seq="seq")


@query(f"WITH {UPSERT} SELECT * FROM old UNION ALL SELECT * FROM early ANTI JOIN old USING (o_orderkey)")
def m3_insert(spark, d):
    return mg.merge_into(*_upsert(spark, d), ["o_orderkey"], "insert", seq="seq")


@query(f"""WITH {UPSERT}, blank AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'None' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM old)
SELECT o_orderkey, CASE WHEN b.o_orderkey IS NULL OR (n.o_orderkey IS NOT NULL AND b.o_orderstatus = 'None') THEN n.o_orderstatus ELSE b.o_orderstatus END AS o_orderstatus,
  CASE WHEN b.o_orderkey IS NULL THEN n.o_totalprice ELSE b.o_totalprice END AS o_totalprice FROM blank b FULL JOIN new n USING (o_orderkey)""")
def m4_fill(spark, d):
    old, new = _upsert(spark, d)
    blank = old.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "None").otherwise(F.col("o_orderstatus")))
    return mg.merge_into(blank, new, ["o_orderkey"], "fill", seq="seq")


@query(f"""WITH {UPSERT} SELECT o_orderkey, CASE WHEN old.o_orderkey IS NULL THEN new.o_orderstatus ELSE old.o_orderstatus END AS o_orderstatus, coalesce(new.o_totalprice, old.o_totalprice) AS o_totalprice
FROM old FULL JOIN new USING (o_orderkey)""")
def m5_columns(spark, d):
    return mg.merge_into(*_upsert(spark, d), ["o_orderkey"], "columns", columns=["o_totalprice"], seq="seq")


@query(f"WITH {UPSERT} SELECT * FROM new UNION ALL SELECT * FROM old ANTI JOIN new USING (o_orderkey)")
def m1_stored(spark, d):
    """The same upsert into a stored table, of which the batch rewrites the buckets of its keys; the batch comes twice."""
    old, new = _upsert(spark, d)
    path = store.new_path(spark, "orders")
    upsert_stored(path, old, ["o_orderkey"])
    for _ in range(2):
        upsert_stored(path, new, ["o_orderkey"], seq="seq")
    return read_stored(spark, path)


@query("""WITH v AS (SELECT p_partkey, CASE WHEN length(p_name) > 12 THEN 'client_name' END AS a, CASE WHEN length(p_type) > 7 THEN 'buy_sell' END AS b FROM part)
SELECT p_partkey, concat_ws(',', a, b) AS reasons FROM v WHERE a IS NOT NULL OR b IS NOT NULL""")
def m6_append_rejects(spark, d):
    p = table(spark, d, "part")
    _, rejects = mg.append_valid(p.limit(0), p, {"client_name": F.length("p_name") <= 12, "buy_sell": F.length("p_type") <= 7})
    return rejects.select("p_partkey", F.array_join("reasons", ",").alias("reasons"))


@query("""SELECT o_orderkey, o_orderdate::date AS day FROM orders WHERE o_orderpriority <> '5-LOW'""")
def m7_skip_undated(spark, d):
    o = table(spark, d, "orders")
    text = F.when(F.col("o_orderpriority") != "5-LOW", F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("n/a")
    return mg.with_key_date(o.select("o_orderkey", sc.parse_date(text).alias("day")), "day")


@query("""SELECT c_custkey AS id, c_name AS name, NULL::double AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier""")
def m8_evolve(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return mg.evolve(a, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))


@query("""WITH t AS (SELECT 'u' || (user_id % 20) AS symbol, user_id, event_type, value, user_id % 7 = 0 AS exec FROM events
  WHERE event_type IN ('purchase', 'error') AND ts::date > DATE '2024-01-30' - 20 AND ts::date <= DATE '2024-01-30'),
g AS (SELECT symbol, count(*) AS trades, count(*) FILTER (event_type = 'purchase') AS buys, count(*) FILTER (event_type = 'error') AS sells,
  count(*) FILTER (event_type = 'purchase' AND exec) AS ex, count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS buyers,
  sum(CASE WHEN event_type = 'purchase' THEN value ELSE -value END) AS net, coalesce(sum(value) FILTER (event_type = 'error'), 0) AS sold FROM t GROUP BY 1)
SELECT symbol, trades, buys, sells, buyers, round(net, 4) AS net_value, concat_ws(',', CASE WHEN buys >= 3 AND buyers >= 2 THEN CASE WHEN buyers >= 3 THEN 'cluster_buy:strong' ELSE 'cluster_buy:moderate' END END,
  CASE WHEN ex > 0 THEN 'executive_buying:strong' END, CASE WHEN sells >= 5 OR sold > 1e7 THEN CASE WHEN sells >= 8 THEN 'insider_selling:strong' ELSE 'insider_selling:moderate' END END) AS signals,
  CASE WHEN buys > sells THEN 'bullish' WHEN sells > buys THEN 'bearish' ELSE 'neutral' END AS sentiment FROM g""")
def c5_insider_analysis(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("purchase", "error"))
    title = F.when(F.col("user_id") % 7 == 0, "Chief Financial Officer").otherwise("Engineer")
    t = e.select(F.concat(F.lit("u"), F.col("user_id") % 20).alias("symbol"), F.col("user_id").alias("insider"), F.when(F.col("event_type") == "purchase", "P").otherwise("S").alias("kind"), "value", sc.insider_role(title, "reference").alias("role"), F.col("ts").cast("date").alias("d"))
    return pf.insider_analysis(t, asof="2024-01-30", days=20).withColumn("net_value", r("net_value", 4))


GOOD, BAD = ["the ", "und ", "que "], ["des ", "los ", "with "]
PRESENT = lambda ws: " + ".join(f"contains(lower(text), '{w}')::int" for w in ws)


@query(f"""SELECT doc_id, round(coalesce((g - b)::double / nullif(g + b, 0), 0), 2) AS score,
  CASE WHEN round(coalesce((g - b)::double / nullif(g + b, 0), 0), 2) > 0.3 THEN 'bullish' WHEN round(coalesce((g - b)::double / nullif(g + b, 0), 0), 2) > 0.1 THEN 'cautious'
  WHEN round(coalesce((g - b)::double / nullif(g + b, 0), 0), 2) > -0.1 THEN 'neutral' WHEN round(coalesce((g - b)::double / nullif(g + b, 0), 0), 2) > -0.3 THEN 'concerned' ELSE 'bearish' END AS tone
FROM (SELECT doc_id, {PRESENT(GOOD)} AS g, {PRESENT(BAD)} AS b FROM documents)""")
def n1_lexicon_sentiment(spark, d):
    s = table(spark, d, "documents").select("doc_id", sg.lexicon_sentiment(F.col("text"), GOOD, BAD).alias("score"))
    return s.withColumn("tone", sg.tone(F.col("score")))


@query("""SELECT conv_id, turn, array_to_string(list_transform(list_sort(c), lambda x: x.t), ' | ') AS context FROM (
  SELECT conv_id, turn, list({'turn': turn, 't': left(text, 150)}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS c FROM conversations) WHERE c IS NOT NULL""")
def n13_recent_context(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    c = table(spark, d, "conversations").withColumn("c", F.collect_list(F.left("text", F.lit(150))).over(w))
    return c.where(F.size("c") > 0).select("conv_id", "turn", F.array_join("c", " | ").alias("context"))


def families_sql(families: dict[str, list[str]], column: str = "lower(text)") -> str:
    """The first family with a word in a text."""
    cases = [f"WHEN {' OR '.join(f"contains({column}, '{w}')" for w in words)} THEN '{name}'" for name, words in families.items()]
    return f"CASE {' '.join(cases)} END"


def any_sql(words: list[str], column: str = "lower(text)") -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


@query(f"""SELECT conv_id, turn, coalesce({families_sql(sg.COMPARISON)}, CASE WHEN contains(lower(text), ' and ') AND {any_sql(sg.PAIR_WORDS)} THEN 'and_pattern' END) AS intent FROM conversations""")
def n9_comparison_intent(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", sg.comparison_intent(F.col("text")).alias("intent"))


@query(f"""SELECT conv_id, turn, {families_sql(sg.ANALYSIS)} AS intent FROM conversations""")
def n10_analysis_intent(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", sg.analysis_intent(F.col("text")).alias("intent"))


@query(f"""SELECT conv_id, turn, concat_ws('|', 'PE of ' || s || ' against its five-year average?', CASE WHEN {any_sql(sg.VALUE_WORDS)} THEN 'PE of ' || s || ' against its sector, and why?' END,
  CASE WHEN {any_sql(sg.ACTION_WORDS)} THEN 'Outlook and guidance of ' || s || ' in the last call?|Main risks of ' || s || '?' END, 'Recent news and catalysts of ' || s || '?') AS questions
FROM (SELECT *, 'C' || conv_id AS s FROM conversations)""")
def n11_decompose_query(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.array_join(sg.decompose_query(F.col("text"), F.concat(F.lit("C"), "conv_id")), "|").alias("questions"))


@query("SELECT conv_id, turn, " + ", ".join(f"CASE WHEN {any_sql(w)} THEN {hi}::double ELSE {lo}::double END AS {n}" for n, (w, hi, lo) in sg.RELEVANCE.items()) + " FROM conversations")
def n15_source_relevance(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", *[sg.source_relevance(F.col("text"), n).alias(n) for n in sg.RELEVANCE])


@query("""SELECT p_partkey, round_even((s - p_retailprice) / s * 100, 1) AS discount, CASE WHEN (s - p_retailprice) / s * 100 > 10 THEN 'Undervalued' WHEN (s - p_retailprice) / s * 100 < -10 THEN 'Premium' ELSE 'Fair Value' END AS status,
  round(CASE WHEN p_size > 25 THEN p_retailprice / (p_size - 25) END, 6) AS pb FROM (SELECT *, avg(p_retailprice) OVER (PARTITION BY p_type) * 1.08 AS s FROM part)""")
def f16_valuation_status(spark, d):
    p = table(spark, d, "part").withColumn("s", F.avg("p_retailprice").over(Window.partitionBy("p_type")) * 1.08)
    pe, s = F.col("p_retailprice"), F.col("s")
    return p.select("p_partkey", sc.valuation_discount(pe, s).alias("discount"), sc.valuation_status(pe, s).alias("status"), r(sc.price_to_book(pe, F.col("p_size") - 25.0)).alias("pb"))


@query("""SELECT l_orderkey, l_linenumber, round(g, 4) AS gain, round(CASE WHEN g <= 0 THEN 0 WHEN days > 365 THEN greatest(g - 125000, 0) * 0.125 ELSE g * 0.2 END, 4) AS tax
FROM (SELECT l_orderkey, l_linenumber, l_orderkey, (l_extendedprice / l_quantity - p_retailprice) * l_quantity AS g, date_diff('day', DATE '1998-01-01', l_shipdate::date) AS days FROM lineitem JOIN part ON p_partkey = l_partkey)""")
def f11_capital_gains_tax(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1998-01-01").cast("date"))
    x = sc.capital_gains_tax(F.col("p_retailprice"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), days)
    return j.select("l_orderkey", "l_linenumber", r(x["gain"], 4).alias("gain"), r(x["tax"], 4).alias("tax"))


@query(f"""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(e::double[], embedding::double[]), 9) AS score FROM embeddings, q),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, rank::int AS rank FROM k WHERE rank <= 10""")
def r4_vector_search(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return rt.vector_search(e, q, 10).select("query_id", "vec_id", r("score").alias("score"), "rank")


@query(r"""WITH a AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/]+)', 1) AS host, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href\s*=\s*["''][^"'']*["''][^>]*>.*?</a>')) AS t FROM pages)
SELECT page_id, url, CASE WHEN h LIKE '/%' THEN host || h ELSE h END AS href FROM (SELECT *, regexp_extract(t, '(?is)href\s*=\s*["'']([^"'']*)["'']', 1) AS h FROM a) GROUP BY ALL""")
def s9_links(spark, d):
    return py.extract_links(table(spark, d, "pages")).select("page_id", "url", "href")


@query("""SELECT 'u' || (user_id % 20) AS symbol, date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 15""")
def x2_volume_spikes(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id") % 20).alias("symbol"), F.col("ts").cast("timestamp").alias("ts"))
    return jobs.volume_spikes(e).select("symbol", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT symbol, event_id, round(previous, 6) AS previous, round(s, 6) AS sentiment, CASE WHEN s <= -0.3 THEN 'drop' ELSE 'surge' END AS kind,
  CASE WHEN s <= -0.5 THEN 'high' WHEN s <= -0.3 THEN 'medium' ELSE 'low' END AS severity FROM (
  SELECT *, lag(s) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS previous FROM (SELECT 'u' || (user_id % 20) AS symbol, ts, event_id, (value % 200) / 100.0 - 1 AS s FROM events)) WHERE s <= -0.3 OR s >= 0.5""")
def x1_sentiment_alerts(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id") % 20).alias("symbol"), F.struct("ts", "event_id").alias("ts"), (F.col("value") % 200 / 100.0 - 1).alias("sentiment"))
    a = jobs.sentiment_alerts(e)
    return a.select("symbol", F.col("ts.event_id").alias("event_id"), r("previous").alias("previous"), r("sentiment").alias("sentiment"), "kind", "severity")


@query("""WITH s AS (SELECT o_custkey % 997 AS person, c_nationkey AS market, min(o_orderkey) AS first FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
k AS (SELECT market, 70 + market AS stored FROM (SELECT DISTINCT c_nationkey AS market FROM customer))
SELECT 'p' || person || '@x.test' AS email, market, (greatest(stored, 76) + row_number() OVER (PARTITION BY market ORDER BY first))::int AS position FROM s JOIN k USING (market)""")
def w21_assign_positions(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("market"))
    name = F.concat(F.lit("p"), F.col("o_custkey") % 997, F.lit("@x.test"))
    email = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" "), F.upper(name))).otherwise(name)
    signups = table(spark, d, "orders").join(c, "o_custkey").select(email.alias("email"), "market", F.col("o_orderkey").alias("at"))
    stored = c.select("market").distinct().select("market", (F.col("market") + 70).alias("position"))
    return ts.assign_positions(signups, stored, "at")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
def p14_metric_filters(spark, d):
    return mg.apply_metric_filters(table(spark, d, "orders").where("o_orderstatus = 'F'"), {"o_totalprice": ">200000"}).select("o_orderkey")


@query("""SELECT s_suppkey, concat_ws(',', CASE WHEN NOT (s_acctbal > 0) THEN 'balance' END, CASE WHEN NOT (s_nationkey < 20) THEN 'nation' END) AS reasons FROM supplier""")
def p10_validate(spark, d):
    v = mg.validate(table(spark, d, "supplier"), {"balance": F.col("s_acctbal") > 0, "nation": F.col("s_nationkey") < 20})
    return v.select("s_suppkey", F.array_join("reasons", ",").alias("reasons"))


@query("""WITH a AS (SELECT event_type AS symbol, user_id % 50 AS analyst, avg(sin(event_id)) AS rating, avg(0.1 + (user_id % 9) / 10.0) AS confidence FROM events GROUP BY ALL),
s AS (SELECT symbol, sum(rating * confidence) / sum(confidence) AS x, count(*) AS n FROM a GROUP BY 1),
c AS (SELECT symbol, string_agg(t, ',' ORDER BY analyst, i) AS catalysts FROM (SELECT symbol, analyst, i, 'c' || analyst || '-' || i AS t, row_number() OVER (PARTITION BY symbol ORDER BY analyst, i) AS k FROM a, (VALUES (1), (2)) v(i)) WHERE k <= 5 GROUP BY 1)
SELECT symbol, round(x, 6) AS score, n, CASE WHEN x > 0.3 THEN 'bullish' WHEN x < -0.3 THEN 'bearish' ELSE 'neutral' END AS consensus, trunc(abs(x) * 100)::int AS conviction, catalysts FROM s JOIN c USING (symbol)""")
def a12_consensus(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("symbol"), (F.col("user_id") % 50).alias("analyst")).agg(F.avg(F.sin(F.col("event_id").cast("double"))).alias("rating"), F.avg(0.1 + F.col("user_id") % 9 / 10.0).alias("confidence"))
    texts = lambda p: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat(F.lit(p), F.col("analyst"), F.lit("-"), i))
    c = pf.consensus(e.withColumns({"catalysts": texts("c"), "risks": texts("r")}), lists=True)
    return c.select("symbol", r("score").alias("score"), "n", "consensus", "conviction", F.array_join("catalysts", ",").alias("catalysts"))


from tidemark import registry_filings, registry_index, registry_views  # noqa: E402, F401  (add their queries to the tables above)
