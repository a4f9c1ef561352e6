"""Exchange filings and quotes: raw payloads to tables by declared column maps, and their ingest.

Payloads are JSON texts of (symbol, json). What a kind of filing looks like is data (KINDS), so one operator reads them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import action_id, build_url, clean_ticker, meeting_type, parse_date, safe_float, safe_int, strip_markup
from tidemark.operators.merge import merge_into, split_valid, validate, with_key_date

ROWS = "array<map<string,string>>"
XBRL = "https://www.bseindia.com"
#: For each kind the columns of a filing, the payload's names for it in order, and how it is read.
KINDS: dict[str, dict[str, tuple[tuple[str, ...], str]]] = {
    "governance": {"quarter": (("Fld_QuarterId",), "text"), "fiscal_year": (("Year",), "text"), "report_date": (("Fld_EndDate",), "date"), "xbrl_url": (("xbrlurl",), "url")},
    "shareholding": {
        "quarter": (("qtr",), "text"), "fiscal_year": (("yr",), "text"), "promoter_holding": (("PROMOTER_HOLDING",), "number"), "public_holding": (("PUBLIC_HOLDING",), "number"),
        "institutional_holding": (("Institutional_HOLDING",), "number"), "dii_holding": (("DII_HOLDING",), "number"), "fii_holding": (("FII_HOLDING",), "number"), "xbrl_url": (("xbrlurl",), "url"),
    },
    "related_party": {"fiscal_year": (("yr",), "text"), "half_year": (("qtr",), "text"), "report_date": (("filing_date_time",), "date"), "xbrl_url": (("xbrlurl",), "url")},
    "board_meetings": {"meeting_date": (("meeting_date", "tm"), "date"), "purpose": (("Purpose_name", "PURPOSE"), "text"), "agenda": (("Agenda",), "text")},
    "shareholder_meetings": {"meeting_date": (("MEETING_DATE", "DT_TM"), "date"), "purpose": (("PURPOSE_NAME", "Purpose"), "text"), "agenda": (("Agenda",), "text")},
    "corporate_actions": {
        "action_type": (("purpose_name", "Purpose"), "text"), "ex_date": (("BCRD_from",), "date"), "record_date": (("Record_Dt",), "date"),
        "bc_start_date": (("BC_STRT_DT",), "date"), "bc_end_date": (("BC_END_DT",), "date"), "details": (("Amount",), "text"),
    },
    "deals": {
        "trade_date": (("DEAL_DATE", "DT_TM"), "date"), "client_name": (("CLIENT_NAME", "ClientName"), "text"), "buy_sell": (("TRANSACTION_TYPE", "BUYSELL"), "text"),
        "quantity": (("QUANTITY",), "whole"), "price": (("PRICE",), "number"),
    },
    "insider_trades": {
        "trade_date": (("DT_TM",), "date"), "client_name": (("Name_Of_Person", "Acq_Name"), "text"), "buy_sell": (("Category",), "text"),
        "quantity": (("Buy_No_OF_Shares", "Sell_No_OF_Shares"), "whole"), "price": (("Buy_Avg_CAP", "Sell_Avg_CAP"), "number"),
    },
    "announcements": {"announcement_type": (("CATEGORYNAME",), "text"), "announcement_date": (("DT_TM",), "date"), "subject": (("SLONGNAME", "HEADLINE"), "text"), "pdf_url": (("ATTACHMENTNAME",), "text")},
    "integrated": {"filing_type": (("category", "Category"), "text"), "quarter": (("qtr",), "text"), "fiscal_year": (("yr",), "text"), "filing_date": (("filing_date_time",), "date"), "xbrl_url": (("xbrlurl",), "url")},
    "complaints": {"quarter": (("qtr", "Quarter"), "text"), "fiscal_year": (("yr", "Year"), "text"), "xbrl_url": (("xbrlurl",), "url")},
}
#: For each kind: its key, the merge policy, the date without which a row is skipped, and rules for single rows.
TARGETS: dict[str, tuple[list[str], str, str | None]] = {
    "governance": (["symbol", "quarter", "fiscal_year"], "coalesce", None),
    "shareholding": (["symbol", "quarter", "fiscal_year"], "replace", None),
    "related_party": (["symbol", "fiscal_year", "half_year"], "coalesce", None),
    "board_meetings": (["symbol", "meeting_date", "purpose"], "coalesce", "meeting_date"),
    "shareholder_meetings": (["symbol", "meeting_date", "purpose"], "coalesce", "meeting_date"),
    "corporate_actions": (["symbol", "action_type", "ex_date"], "coalesce", "ex_date"),
    "deals": ([], "append", None),
    "insider_trades": ([], "append", None),
    "announcements": ([], "append", None),
    "integrated": (["symbol", "filing_type", "quarter", "fiscal_year"], "coalesce", None),
    "complaints": (["symbol", "quarter", "fiscal_year"], "coalesce", None),
}


def unwrap(json: Column) -> Column:
    """The rows of a payload {"Table": [..]} or [..]; empty forms and other texts have none."""
    t = F.trim(json)
    inner = F.when(t.startswith("["), t).otherwise(F.get_json_object(t, "$.Table"))
    return F.coalesce(F.from_json(inner, ROWS), F.array().cast(ROWS))


def normalize_filings(df: DataFrame, kind: str, prefix: str = XBRL, seq: str | None = None) -> DataFrame:
    """(symbol, columns of the kind, content): of each column the first of its names that is not empty; content is the text
    of the markup in the payload, else the payload's row itself. Shareholder meetings also get their type. With seq, the column that
    orders payloads, rows also carry their place (seq, number within the payload) as _at."""
    place = [F.struct(F.col(seq).alias("seq"), F.col("_p").alias("p")).alias("_at")] if seq else []
    rows = df.select("symbol", *([seq] if seq else []), F.posexplode(unwrap(F.col("json"))).alias("_p", "_r"))
    read = {
        "text": lambda c: c, "number": safe_float, "whole": safe_int, "date": lambda c: parse_date(F.regexp_replace(c, r"[T ]\d{2}:\d{2}.*$", "")), "url": lambda c: build_url(F.coalesce(c, F.lit("")), prefix),
    }
    pick = lambda names: F.coalesce(*[F.nullif(F.try_element_at("_r", F.lit(n)), F.lit("")) for n in names])
    columns = [read[how](pick(names)).alias(c) for c, (names, how) in KINDS[kind].items()]
    content = F.coalesce(strip_markup(F.try_element_at("_r", F.lit("content"))), F.to_json("_r"))
    out = rows.select("symbol", *columns, content.alias("content"), *place)
    return out.withColumn("meeting_type", meeting_type(F.coalesce("purpose", F.lit("")))) if kind == "shareholder_meetings" else out


def ingest_filings(raw: DataFrame, kind: str, target: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new target, rejects, summary) of payloads of a kind: rows without their key date are skipped, single bad rows are set
    aside with reasons, the rest is merged by the kind's policy."""
    keys, policy, _ = TARGETS[kind]
    rows, dated, ok, rejects = checked_filings(raw, kind)
    new = target.unionByName(ok.select(*target.columns)) if policy == "append" else merge_into(target, ok, keys, policy)
    return new, rejects, split_summary(rows, dated, rejects, kind)


def checked_filings(raw: DataFrame, kind: str, seq: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(all rows, those with their key date, of these the good ones, and the others with reasons) of payloads of a kind."""
    rows = normalize_filings(raw, kind, seq=seq)
    day = TARGETS[kind][2]
    dated = with_key_date(rows, day) if day else rows
    return rows, dated, *split_valid(dated, _rules(rows))


def _rules(rows: DataFrame) -> dict[str, Column]:
    """What a single row has to meet."""
    rules = {"symbol": F.col("symbol").isNotNull() & (F.col("symbol") != "")}
    if "client_name" in rows.columns:
        rules |= {"client_name": F.length(F.coalesce("client_name", F.lit(""))) <= 1000, "buy_sell": F.length(F.coalesce("buy_sell", F.lit(""))) <= 10}
    return rules


def count_filings(rows: DataFrame, kind: str) -> DataFrame:
    """(kind, rows_read, undated, rejected) of all rows of payloads of a kind, in one pass."""
    day = TARGETS[kind][2]
    dated = F.col(day).isNotNull() if day else F.lit(True)
    bad = F.size("reasons") > 0
    return validate(rows, _rules(rows)).agg(F.count("*").alias("rows_read"), F.count_if(~dated).alias("undated"), F.count_if(dated & bad).alias("rejected")).select(F.lit(kind).alias("kind"), "*")


def split_summary(rows: DataFrame, dated: DataFrame, rejects: DataFrame, kind: str) -> DataFrame:
    """(kind, rows_read, undated, rejected) of an ingest."""
    count = lambda df, c: df.agg(F.count("*").alias("n")).select(F.lit(c).alias("c"), "n")
    every = count(rows, "read").unionByName(count(dated, "dated")).unionByName(count(rejects, "rejected"))
    n = lambda c: F.max(F.when(F.col("c") == c, F.col("n")))
    return every.groupBy(F.lit(kind).alias("kind")).agg(n("read").alias("rows_read"), (n("read") - n("dated")).alias("undated"), n("rejected").alias("rejected"))


def run_stats(log: DataFrame, group: str, seconds: str = "seconds") -> DataFrame:
    """(group, docs, chunks, errors, docs_per_minute) of a run log (group, chunks, error, seconds)."""
    g = log.groupBy(group).agg(F.count("*").alias("docs"), F.sum("chunks").alias("chunks"), F.count("error").alias("errors"), F.sum(seconds).alias("_s"))
    return g.withColumn("docs_per_minute", F.coalesce(F.try_divide(F.col("docs") * 60.0, F.col("_s")), F.lit(0.0))).drop("_s")


_ITEM = "struct<boardMeetDate:string,purpose:string,recordDate:string,dateOfAnnouncement:string,remarks:string,percentage:string>"
_ACTIONS = f"struct<stockCorporateActionData:struct<boardMeetings:array<{_ITEM}>,dividend:array<{_ITEM}>,bonus:array<{_ITEM}>,splits:array<{_ITEM}>>>"


def explode_corporate_actions(df: DataFrame) -> DataFrame:
    """(symbol, type, date, title, url) of (symbol, json): ten meetings and dividends, five bonuses and splits each; without a
    date no row; the url is an id of symbol, date and kind."""
    j = df.select("symbol", F.from_json("json", _ACTIONS)["stockCorporateActionData"].alias("d"))

    def rows(name: str, most: int, kind: str, code: str, title, dates: tuple[str, ...]) -> Column:
        day = lambda x: F.coalesce(*[F.nullif(x[c], F.lit("")) for c in dates])
        each = F.slice(F.coalesce(F.col(f"d.{name}"), F.array().cast(f"array<{_ITEM}>")), 1, most)
        return F.transform(F.filter(each, lambda x: day(x).isNotNull()), lambda x: F.struct(F.lit(kind).alias("type"), day(x).alias("date"), title(x).alias("title"), F.lit(code).alias("code")))

    text = lambda c, default: F.coalesce(c, F.lit(default))
    record = ("recordDate", "dateOfAnnouncement")
    every = F.concat(
        rows("boardMeetings", 10, "Board Meeting", "BM", lambda x: text(x["purpose"], "Board Meeting"), ("boardMeetDate",)),
        rows("dividend", 10, "Dividend", "DIV", lambda x: F.concat(F.lit("Dividend Declared: "), text(x["remarks"], ""), F.lit(" ("), text(x["percentage"], ""), F.lit("%)")), record),
        rows("bonus", 5, "Bonus", "BON", lambda x: F.concat(F.lit("Bonus Issue: "), text(x["remarks"], "Bonus Issue")), record),
        rows("splits", 5, "Split", "SPLIT", lambda x: F.concat(F.lit("Stock Split: "), text(x["remarks"], "Stock Split")), record),
    )
    out = j.select("symbol", F.explode(every).alias("a")).select("symbol", "a.type", "a.date", "a.title", "a.code")
    return out.withColumn("url", action_id(F.col("code"), F.col("symbol"), F.col("date"))).drop("code")


_KV = "array<struct<key:string,value:string>>"
_PEER = "struct<companyName:string,tickerId:string,priceToEarningsValueRatio:string,returnOnAverageEquityTrailing12Month:string,netProfitMarginPercentTrailing12Month:string,priceToBookValueRatio:string,marketCap:string,overallRating:string>"
_QUOTE = (
    "struct<stockDetailsReusableData:struct<price:string,percentChange:string,marketCap:string,pPerEBasicExcludingExtraordinaryItemsTTM:string,"
    f"sectorPriceToEarningsValueRatio:string,priceYTDPricePercentChange:string,price5DayPercentChange:string,peerCompanyList:array<{_PEER}>>,"
    f"keyMetrics:struct<mgmtEffectiveness:{_KV},margins:{_KV},growth:{_KV},persharedata:{_KV}>,recosBar:struct<tickerPercentage:string>,"
    "news:array<struct<headline:string,summary:string,date:string,url:string>>>"
)
#: Group and name of a key metric, and the column that it fills.
METRICS = (
    ("mgmtEffectiveness", "returnOnAverageEquityTrailing12Month", "roe"), ("mgmtEffectiveness", "returnOnAverageAssetsTrailing12Month", "roa"),
    ("margins", "netProfitMarginPercentTrailing12Month", "net_margin"), ("margins", "operatingMarginTrailing12Month", "operating_margin"),
    ("growth", "revenueChangePercentMostRecentQuarter1YearAgo", "revenue_growth"), ("growth", "ePSChangePercentTTMOverTTM", "profit_growth"),
)


def normalize_quotes(df: DataFrame) -> DataFrame:
    """One flat row of fundamentals for each (ticker, json): direct fields; what is missing from the ticker's own entry among
    its peers; then the key metrics, which win; the first five news and three peers."""
    j = df.select(clean_ticker(F.col("ticker")).alias("ticker"), F.from_json("json", _QUOTE).alias("q"))
    stock = lambda c: safe_float(F.col(f"q.stockDetailsReusableData.{c}"))
    none = F.array().cast(f"array<{_PEER}>")
    j = j.withColumn("peers_all", F.coalesce("q.stockDetailsReusableData.peerCompanyList", none))
    own = F.get(F.filter("peers_all", lambda p: (F.upper(p["companyName"]) == F.col("ticker")) | p["tickerId"].endswith(F.col("ticker"))), 0)
    j = j.withColumn("own", own)

    def metric(group: str, key: str) -> Column:  # of equal keys the last
        rows = F.filter(F.coalesce(F.col(f"q.keyMetrics.{group}"), F.array().cast(_KV)), lambda x: x["key"] == key)
        return F.when(F.size(rows) > 0, safe_float(F.element_at(rows, -1)["value"]))

    def share(part: str, also: str = "") -> Column:
        rows = F.filter(F.coalesce("q.keyMetrics.persharedata", F.array().cast(_KV)), lambda x: x["key"].contains(part) & x["key"].contains(also))
        return F.when(F.size(rows) > 0, safe_float(F.element_at(rows, -1)["value"]))

    known = {c: metric(g, k) for g, k, c in METRICS}
    mine = lambda c: safe_float(F.col(f"own.{c}"))
    some = lambda c: F.nullif(c, F.lit(0.0))
    price = stock("price")
    return j.select(
        "ticker", price.alias("price"), stock("percentChange").alias("change_pct"), stock("marketCap").alias("market_cap"),
        F.coalesce(some(stock("pPerEBasicExcludingExtraordinaryItemsTTM")), mine("priceToEarningsValueRatio")).alias("pe_ratio"),
        stock("sectorPriceToEarningsValueRatio").alias("sector_pe"), stock("priceYTDPricePercentChange").alias("ytd_change"), stock("price5DayPercentChange").alias("week_change"),
        F.coalesce(known["roe"], mine("returnOnAverageEquityTrailing12Month")).alias("roe"), known["roa"].alias("roa"),
        F.coalesce(known["net_margin"], mine("netProfitMarginPercentTrailing12Month")).alias("net_margin"), known["operating_margin"].alias("operating_margin"),
        known["revenue_growth"].alias("revenue_growth"), known["profit_growth"].alias("profit_growth"), share("ePSIncludingExtraOrdinaryItemsTrailing12Month").alias("eps_ttm"),
        F.coalesce(share("bookValuePerShare", "MostRecentFiscalYear"), F.try_divide(price, mine("priceToBookValueRatio"))).alias("book_value"),
        safe_float(F.col("q.recosBar.tickerPercentage")).alias("analyst_score"), F.slice(F.coalesce("q.news", F.array().cast("array<struct<headline:string,summary:string,date:string,url:string>>")), 1, 5).alias("news"),
        F.transform(F.slice("peers_all", 1, 3), lambda p: F.struct(p["companyName"].alias("name"), safe_float(p["priceToEarningsValueRatio"]).alias("pe_ratio"), p["marketCap"].alias("market_cap"), p["overallRating"].alias("rating"))).alias("peers"),
    )


def latest_metrics(members: DataFrame, fundamentals: DataFrame, key: str = "symbol", day: str = "d") -> DataFrame:
    """members with the columns of the newest row of fundamentals of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(day))
    last = fundamentals.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", day)
    return members.join(last, key, "left")


def comparison_matrix(df: DataFrame, key: str, names: list[str], metrics: list[str]) -> DataFrame:
    """A row for each metric and a column for each of the given names; a name without a row has null."""
    long = df.where(F.col(key).isin(*names)).unpivot([key], metrics, "metric", "value")
    return long.groupBy("metric").pivot(key, names).agg(F.max("value"))


def filings_pack(filings: DataFrame, calls: DataFrame, reports: DataFrame, n: tuple[int, int, int] = (10, 8, 7)) -> DataFrame:
    """(symbol, kind, rank, id): the newest filings, calls and reports (symbol, id, d) of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.desc("d"), "id")
    parts = [
        df.select("symbol", F.lit(kind).alias("kind"), F.row_number().over(w).alias("rank"), "id").where(F.col("rank") <= most)
        for df, kind, most in zip((filings, calls, reports), ("filing", "call", "report"), n)
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def full_transcripts(calls: DataFrame, title: str = "title", quarter: str = "quarter", skip: tuple[str, ...] = ("Unknown",)) -> DataFrame:
    """Calls that are no summaries or slides, and whose quarter is known."""
    t = F.lower(F.coalesce(F.col(title), F.lit("")))
    return calls.where(~t.contains("(ai_summary)") & ~t.contains("(ppt)") & ~F.col(quarter).isin(*skip))


def valid_year(c: Column) -> Column:
    return c.rlike("^[0-9]+$")


def screen_symbols(reports: DataFrame, n: int, key: str = "symbol") -> DataFrame:
    """The first 3 n symbols that have a report."""
    return reports.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).limit(3 * n)


def rows_by_source(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, n_tables, n_rows): in how many tables a key occurs and with how many rows in all."""
    parts = [df.groupBy(key).agg(F.count("*").alias("n")).withColumn("t", F.lit(t)) for t, df in tables.items()]
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.groupBy(key).agg(F.count("*").alias("n_tables"), F.sum("n").alias("n_rows"))


def coverage_report(reports: DataFrame, calls: DataFrame, key: str, year: str, few: int = 3) -> DataFrame:
    """(key, reports, first_year, last_year, calls, total, attention, rank): documents of each key, the most first; attention
    marks those with fewer than `few` reports."""
    a = reports.where(valid_year(F.col(year).cast("string"))).groupBy(key).agg(F.count("*").alias("reports"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    b = calls.groupBy(key).agg(F.count("*").alias("calls"))
    j = a.join(b, key, "full_outer").fillna(0, ["reports", "calls"]).withColumn("total", F.col("reports") + F.col("calls"))
    return j.withColumn("attention", F.col("reports") < few)


def needs_attention(report: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The first n keys of a coverage report that need attention, fewest documents first."""
    return report.where("attention").orderBy("total", key).limit(n)


def document_summary(rollups: DataFrame, meta: DataFrame) -> DataFrame:
    """(symbol, fiscal_year, doc_id, summary): the newest document's summary of each symbol and year."""
    top = rollups.where("level = 2").join(meta, "doc_id")
    w = Window.partitionBy("symbol", "fiscal_year").orderBy(F.desc("doc_id"))
    return top.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("symbol", "fiscal_year", "doc_id", "summary")
