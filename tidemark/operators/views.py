"""Views for charts and answers: period series of revenue and margin, segments, stock context, theme indexes, query triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import signals as sg
from tidemark.operators import screening as sn
from tidemark.operators import timeseries as ts
from tidemark.operators.filings import latest_metrics


def period_parts(period: Column) -> tuple[Column, Column]:
    """(year, quarter) of 'FY25' or 'Q3 FY25'; quarter 0 for a year, 0 and 0 for other texts."""
    year = F.regexp_extract(period, r"FY(\d+)\s*$", 1).try_cast("int")
    quarter = F.regexp_extract(period, r"Q(\d)", 1).try_cast("int")
    return F.coalesce(year, F.lit(0)), F.when(year.isNotNull(), F.coalesce(quarter, F.lit(0))).otherwise(0)


def period_points(df: DataFrame, current: int, period: str = "period") -> DataFrame:
    """Adds fy and q of the period; a year that is not over (current or later, in full) goes."""
    year, quarter = period_parts(F.col(period))
    out = df.withColumns({"fy": year, "q": quarter})
    return out.where(~((F.col("fy") > 0) & (2000 + F.col("fy") >= current) & (F.col("q") == 0)))


def revenue_trend(df: DataFrame, current: int, key: str = "symbol", value: str = "value") -> DataFrame:
    """(key, periods, first, last, change %, growth % a step) over the periods of each key in order."""
    return sn.period_trend(period_points(df, current), key, ["fy", "q"], value)


def margin_points(df: DataFrame, current: int) -> DataFrame:
    """(symbol, period, fy, q, margin, change): the margin, else profit over revenue in %, and its change in points."""
    out = period_points(df, current).withColumn("margin", F.coalesce(F.nullif("net_margin", F.lit(0.0)), F.try_divide("profit", "revenue") * 100))
    w = Window.partitionBy("symbol").orderBy("fy", "q")
    return out.withColumn("change", F.col("margin") - F.lag("margin").over(w)).select("symbol", "period", "fy", "q", "margin", "change")


def segment_breakdown(df: DataFrame, key: str = "symbol") -> DataFrame:
    """(key, segment, value, share, total) from (key, segment, q1..q4) or (key, segment, value): with quarters the last counts."""
    value = F.coalesce("q4", F.lit(0.0)) if "q4" in df.columns else F.coalesce("value", F.lit(0.0))
    g = df.groupBy(key, "segment").agg(F.sum(value).alias("value"))
    total = F.sum("value").over(Window.partitionBy(key))
    return g.withColumn("total", total).withColumn("share", F.try_divide("value", "total") * 100)


def financial_views(annual: DataFrame, quarterly: DataFrame, current: int) -> DataFrame:
    """(symbol, view, fy, q, revenue, margin): the years of a symbol that has three or more, else its quarters if two or more."""
    cols = ["symbol", "fy", "q", "revenue", F.try_divide(F.col("profit"), F.col("revenue")).alias("_m")]
    points = lambda df, view: period_points(df, current).select(*cols).withColumn("view", F.lit(view))
    both = points(annual, "annual").unionByName(points(quarterly, "quarterly"))
    both = both.withColumn("_n", F.count("*").over(Window.partitionBy("symbol", "view")))
    years = F.max(F.when(F.col("view") == "annual", F.col("_n")).otherwise(0)).over(Window.partitionBy("symbol"))
    enough = F.when(F.coalesce(years, F.lit(0)) >= 3, F.col("view") == "annual").otherwise((F.col("view") == "quarterly") & (F.col("_n") >= 2))
    return both.withColumn("_ok", enough).where("_ok").select("symbol", "view", "fy", "q", "revenue", (F.col("_m") * 100).alias("margin"))


def notable_shift(df: DataFrame, key: str, order: str, value: str, least: float = 0.4) -> DataFrame:
    """(key, order, before, after): the newest pair of neighbours that differ by more than `least`."""
    w = Window.partitionBy(key).orderBy(order)
    pairs = df.withColumn("before", F.lag(value).over(w)).where(F.abs(F.col(value) - F.col("before")) > least)
    return ts.latest_n(pairs.select(key, order, "before", F.col(value).alias("after")), [key], [F.desc(order)])


def sentiment_report(calls: DataFrame, good: list[str], bad: list[str], n: int = 8, least: int = 1000) -> DataFrame:
    """(symbol, calls, mean_score, latest, tone, trend, strength, shift_at, shift) from (symbol, d, text): of the last n calls of
    a symbol those of at least so many characters; the trend of their scores, and the newest change of over 0.4."""
    last = ts.latest_n(calls.select("symbol", "d", "text"), ["symbol"], [F.desc("d")], n)
    s = last.where(F.length("text") >= least).select("symbol", "d", sg.lexicon_sentiment(F.col("text"), good, bad).alias("score"))
    g = s.groupBy("symbol").agg(F.count("*").alias("calls"), F.avg("score").alias("mean_score"), F.max_by("score", "d").alias("latest"))
    trend = ts.sentiment_trend(s, "symbol", "d", "score").select("symbol", "trend", "strength")
    shift = notable_shift(s, "symbol", "d", "score").select("symbol", F.col("d").alias("shift_at"), (F.col("after") - F.col("before")).alias("shift"))
    return g.withColumn("tone", sg.tone(F.col("latest"))).join(trend, "symbol").join(shift, "symbol", "left")


def esg_by_symbol(companies: DataFrame, reports: DataFrame, environment: list[str], social: list[str], governance: list[str]) -> DataFrame:
    """(symbol, e, s, g, overall, executive_pay, quality) of each company by its newest report (symbol, d, text)."""
    newest = ts.latest_n(reports.select("symbol", "d", "text"), ["symbol"], [F.desc("d")])
    x = sg.esg_score(F.col("text"), environment, social, governance)
    return companies.join(newest, "symbol", "left").select("symbol", x.alias("x")).select("symbol", "x.*")


def stock_context(snapshots: DataFrame, prices: DataFrame, news: DataFrame, n_news: int = 5) -> DataFrame:
    """One row for each symbol: newest snapshot (symbol, d, price), trend of its last seven, long-term trend of prices
    (symbol, d, close), and the newest headlines (symbol, ts, headline)."""
    last = ts.latest_n(snapshots, ["symbol"], [F.desc("d")]).select("symbol", F.col("d").alias("asof"), "price")
    short = sn.snapshot_trend(snapshots, "symbol", "d", "price").select("symbol", F.col("change").alias("short_change"))
    long = ts.long_term_trend(prices, "symbol", "d", "close").select("symbol", "cagr", F.col("change").alias("long_change"))
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"), "headline")
    heads = news.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_news).groupBy("symbol").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "headline"))), lambda s: s["headline"]).alias("headlines"))
    return last.join(short, "symbol", "left").join(long, "symbol", "left").join(heads, "symbol", "left")


def build_theme_index(hits: DataFrame, fundamentals: DataFrame, most: int = 15, ranking: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, summary) of a theme index for each query from hits (query_id, symbol, score): the best hit of a symbol, an
    outside ranking if given, the first `most` symbols with equal weight 100 / most, their newest fundamentals, averages."""
    best = sn.best_per_key(hits.select("query_id", "symbol", "score"), ["query_id", "symbol"], "score")
    if ranking is not None:
        best = best.drop("score").join(ranking.select("query_id", "symbol", "score"), ["query_id", "symbol"], "left").fillna(0.0, ["score"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "symbol"))
    members = best.withColumn("rank", rank).where(F.col("rank") <= most).withColumn("weight", F.lit(round(100 / most, 2)))
    members = latest_metrics(members, fundamentals)
    return members, members.groupBy("query_id").agg(F.count("*").alias("members"), F.avg("score").alias("mean_score"))


def triage(queries: DataFrame, aliases: dict[str, str], allowed: list[str], scope: tuple, key: list[str] = ["conv_id", "turn"]) -> DataFrame:
    """For each query of a log (conv_id, turn, text): tickers, whether it leans on an earlier one, the ticker carried forward
    for it, comparison and analysis intent, scope, and sub-questions about the ticker."""
    t = queries.select(*key, "text", sg.extract_tickers(F.col("text"), aliases, allowed).alias("tickers"), sg.is_followup(F.col("text")).alias("followup"))
    t = t.withColumn("first", F.get("tickers", F.lit(0)))
    t = sn.carry_forward(t, key[0], key[1], "first", "carried")
    symbol = F.coalesce("first", F.when(F.col("followup"), F.col("carried")))
    return t.withColumn("symbol", symbol).select(
        *key, "tickers", "followup", "symbol", sg.comparison_intent(F.col("text")).alias("comparison"), sg.analysis_intent(F.col("text")).alias("analysis"),
        sg.classify_scope(F.col("text"), *scope).alias("scope"), F.when(F.col("symbol").isNotNull(), sg.decompose_query(F.col("text"), F.col("symbol"))).alias("questions"),
    )


# Words that show a user's taste for risk, horizon, sectors, concerns, level and language, in the order in which they are looked for.
RISK_WORDS = {
    "aggressive": ["yolo", "double", "multibagger", "high growth", "alpha", "momentum", "swing trade"],
    "conservative": ["safe", "stable", "dividend", "blue chip", "low risk", "fd", "government"],
    "moderate": ["balanced", "diversified", "index", "etf", "sip"],
}
HORIZON_WORDS = {
    "short": ["intraday", "short term", "quick", "this week", "tomorrow", "swing"],
    "long": ["long term", "10 year", "retire", "wealth", "compound", "hold forever"],
    "medium": ["1 year", "few months", "medium term"],
}
SECTOR_WORDS = {
    "banking": ["bank", "hdfc", "icici", "kotak", "axis", "sbi", "nifty bank"],
    "it": ["tcs", "infosys", "wipro", "tech mahindra", "hcl", "it sector", "software"],
    "pharma": ["pharma", "sun pharma", "dr reddy", "cipla", "biocon", "healthcare"],
    "auto": ["auto", "tata motors", "maruti", "m&m", "bajaj", "eicher", "ev"],
    "fmcg": ["fmcg", "hindustan unilever", "itc", "nestle", "dabur", "marico"],
    "energy": ["reliance", "oil", "ongc", "power", "adani power", "tata power"],
    "metals": ["tata steel", "hindalco", "vedanta", "coal india", "nmdc"],
}
CONCERN_WORDS = ["risk", "loss", "volatile", "crash", "fall"]
EXPERT_WORDS = ["pe ratio", "eps", "roce", "ebitda", "dcf", "intrinsic value", "beta", "sharpe"]
OWNER_WORDS = ["i have", "i own", "my portfolio", "i bought", "i hold"]
MIXED_WORDS = ["kya", "hai", "nahi", "acha", "kitna", "kaisa", "kaise", "bhai", "yaar"]

#: How many of a user's tickers, concerns and sectors a profile keeps, by last first mention; owned tickers all stay.
KEPT = {"tickers": 10, "concerns": 5, "sectors": 5}


def profile_rows(
    log: DataFrame, aliases: dict[str, str], allowed: list[str], concerns: list[str] = CONCERN_WORDS, risk=RISK_WORDS, horizon=HORIZON_WORDS,
    sectors: dict[str, list[str]] = SECTOR_WORDS, mixed: list[str] = MIXED_WORDS,
) -> DataFrame:
    """What each row of a log (user_id, turn, text), batch or stream, says about its user."""
    t, low = F.col("text"), F.lower(F.col("text"))
    some = lambda items: F.array_compact(F.array(*items, F.lit(None).cast("string")))
    return log.select(
        "user_id", F.col("turn").cast("long").alias("turn"), sg.first_family(t, risk).alias("risk"), sg.first_family(t, horizon).alias("horizon"),
        F.when(F.length(t) > 100, "detailed").when(low.contains("quick") | low.contains("briefly"), "concise").alias("verbosity"),
        F.when(sg.detect_style(t, mixed)["mixed"], "hinglish").when(sg.detect_style(t, mixed)["devanagari"], "hindi").alias("language"),
        (sg.present(t, EXPERT_WORDS) > 0).alias("expert"), F.coalesce(low.contains("chart") | low.contains("graph"), F.lit(False)).alias("charts"), (sg.present(t, OWNER_WORDS) > 0).alias("owns"),
        F.coalesce(sg.extract_tickers(t, aliases, allowed), F.array().cast("array<string>")).alias("tickers"), some([F.when(low.contains(c), F.lit(c)) for c in concerns]).alias("concerns"),
        some([F.when(sg.present(t, ws) > 0, F.lit(n)) for n, ws in sectors.items()]).alias("sectors"),
    )


def finish_profiles(facts: DataFrame) -> DataFrame:
    """Adds how engaged a user is, the level, and from two questions on a persona."""
    engaged = F.when(F.col("n") > 50, "high").when(F.col("n") > 10, "medium").otherwise("low")
    persona = F.concat_ws(", ", F.coalesce("risk", F.lit("moderate")), F.coalesce("horizon", F.lit("medium")), F.coalesce("verbosity", F.lit("balanced")))
    return facts.withColumns({
        "language": F.coalesce("language", F.lit("english")), "persona": F.when(F.col("n") >= 2, persona), "engagement": engaged, "level": F.when(F.col("expert"), "expert").otherwise("intermediate"),
    }).drop("expert")


def build_profiles(log: DataFrame, aliases: dict[str, str], allowed: list[str], *words, **more) -> DataFrame:
    """A profile of each user from (user_id, turn, text): counters, the last stated risk taste, horizon, verbosity and language, the
    ten tickers, five sectors and five concerns that came up last for the first time, tickers owned, level, charts, how
    engaged the user is, and from two questions on a persona. Word lists as for profile_rows."""
    rows = profile_rows(log, aliases, allowed, *words, **more)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("turn"))).alias(c)
    out = rows.groupBy("user_id").agg(F.count("*").alias("n"), last("risk"), last("horizon"), last("verbosity"), last("language"), F.max("expert").alias("expert"), F.max("charts").alias("charts"))

    def recent(column: str, name: str, n: int | None, where: str = "true") -> DataFrame:
        """The last n by first mention, in that order."""
        each = rows.where(where).select("user_id", "turn", F.posexplode(column).alias("p", "x")).groupBy("user_id", "x").agg(F.min(F.struct("turn", "p")).alias("at"))
        if n is not None:
            each = each.withColumn("_r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("at")))).where(F.col("_r") <= n)
        return each.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias(name))

    for column, n in KEPT.items():
        out = out.join(recent(column, column, n), "user_id", "left")
    out = out.join(recent("tickers", "owned", None, "owns"), "user_id", "left")
    none = F.array().cast("array<string>")
    return finish_profiles(out.withColumns({c: F.coalesce(c, none) for c in (*KEPT, "owned")}))
