"""News feeds, link pages of filings, and result logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import fiscal_quarter_of_text, fiscal_year_of_text
from tidemark.sources.payloads import anchors

MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+20\d{2}"


def _tag(block: Column, name: str) -> Column:
    inner = F.regexp_extract(block, rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>", 1)
    text = F.regexp_replace(inner, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(text)


def _blocks(df: DataFrame, name: str, most: int) -> DataFrame:
    found = F.regexp_extract_all("xml", F.lit(rf"(?is)<{name}\b.*?</{name}\s*>"), F.lit(0))
    return df.select("symbol", F.posexplode(F.slice(found, 1, most)).alias("pos", "b"))


def read_news_feed(df: DataFrame, limit: int = 10) -> DataFrame:
    """(symbol, pos, title, source, link, published) of the first items of RSS texts (symbol, xml); the source is what stands
    after the last dash of the title."""
    title = _tag(F.col("b"), "title")
    head = F.when(title.contains("-"), F.trim(F.regexp_extract(title, r"(?s)^(.*)-[^-]*$", 1))).otherwise(title)
    source = F.when(title.contains("-"), F.trim(F.substring_index(title, "-", -1)))
    return _blocks(df, "item", limit).select("symbol", "pos", head.alias("title"), source.alias("source"), _tag(F.col("b"), "link").alias("link"), _tag(F.col("b"), "pubDate").alias("published"))


def read_atom(df: DataFrame, limit: int = 40) -> DataFrame:
    """(symbol, pos, title, updated, link) of the first entries of Atom texts (symbol, xml)."""
    link = F.regexp_extract("b", r"(?is)<link\b[^>]*href\s*=\s*[\"']([^\"']*)", 1)
    return _blocks(df, "entry", limit).select("symbol", "pos", _tag(F.col("b"), "title").alias("title"), _tag(F.col("b"), "updated").alias("updated"), link.alias("link"))


def absolute(href: Column, base: str) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href))


def extract_doc_links(pages: DataFrame, base: str) -> DataFrame:
    """(symbol, url, title, fiscal_year) of annual reports linked from (symbol, html), each url once: links to PDFs, or with
    a year and the word annual or report."""
    a = pages.select("symbol", F.posexplode(anchors(F.col("html"))).alias("pos", "a")).select("symbol", "pos", "a.href", "a.label").where("href <> ''")
    both = F.concat("label", F.lit(" "), "href")
    pdf, year = F.lower("href").contains(".pdf"), both.rlike("(?:19|20)[0-9]{2}")
    kept = a.where(pdf | (year & both.rlike(r"(?i)annual|report|ar[0-9]{4}")))
    url = absolute(F.col("href"), base)
    first = kept.groupBy("symbol", url.alias("url")).agg(F.min_by(F.struct("label", both.alias("both")), "pos").alias("x"))
    fy = fiscal_year_of_text(F.col("x.both"))
    title = F.concat(F.lit("Annual Report "), F.when(F.col("x.label") != "", F.col("x.label")).otherwise(fy))
    return first.select("symbol", "url", title.alias("title"), fy.alias("fiscal_year"))


def extract_event_links(rows: DataFrame, base: str) -> DataFrame:
    """(symbol, date_text, fiscal_year, quarter, links) of call events (symbol, html of one row): a row needs a date; links are
    a map of transcript, ai_summary, ppt and recording by their labels, a PDF is the transcript if there is no other."""
    text = F.regexp_replace("html", r"(?s)<[^>]*>", " ")
    date = F.coalesce(F.nullif(F.regexp_extract(text, f"({MONTH})", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"(\d{1,2}[-/]\d{1,2}[-/]20\d{2})", 1), F.lit("")))
    rows = rows.select("symbol", date.alias("date_text"), anchors(F.col("html")).alias("a")).where("date_text IS NOT NULL")

    def kind(x: Column) -> Column:
        t = F.lower(x["label"])
        return (
            F.when(t.rlike("transcript|call|earning"), "transcript").when(t.contains("summary"), "ai_summary").when(t.rlike("ppt|presentation"), "ppt")
            .when(t.rlike("rec|audio|video"), "recording").when(F.lower(x["href"]).contains(".pdf"), "pdf")
        )

    each = F.filter(F.transform("a", lambda x: F.struct(kind(x).alias("kind"), absolute(x["href"], base).alias("url"))), lambda s: s["kind"].isNotNull() & (s["url"] != base))
    rows = rows.withColumn("each", each)
    pick = lambda k: F.element_at(F.filter("each", lambda s: s["kind"] == k), -1)["url"]
    has = lambda k: F.exists("each", lambda s: s["kind"] == k)
    entries = [F.when(has(k), F.struct(F.lit(k).alias("key"), pick(k).alias("value"))) for k in ("ai_summary", "ppt", "recording")]
    transcript = F.when(has("transcript"), pick("transcript")).when(has("pdf"), F.filter("each", lambda s: s["kind"] == "pdf")[0]["url"])
    links = F.map_from_entries(F.array_compact(F.array(F.when(transcript.isNotNull(), F.struct(F.lit("transcript").alias("key"), transcript.alias("value"))), *entries)))
    out = rows.withColumn("links", links).where(F.size("links") > 0)
    return out.select("symbol", "date_text", fiscal_year_of_text(F.col("date_text")).alias("fiscal_year"), fiscal_quarter_of_text(F.col("date_text")).alias("quarter"), "links")


def extract_notices(rows: DataFrame, base: str) -> DataFrame:
    """(symbol, title, url, date_text, fiscal_year, agency) of announcements and ratings (symbol, html of one row): links whose
    text has five characters or more, the date in the row, the agency after 'from'."""
    text = F.trim(F.regexp_replace(F.regexp_replace("html", r"(?s)<[^>]*>", " "), r"\s+", " "))
    date = F.coalesce(F.nullif(F.regexp_extract(text, f"({MONTH})", 1), F.lit("")), F.lit(""))
    agency = F.nullif(F.trim(F.regexp_extract(text, r"(?i)\bfrom\s+(.+)$", 1)), F.lit(""))
    each = rows.select("symbol", date.alias("date_text"), agency.alias("agency"), F.explode(anchors(F.col("html"))).alias("a"))
    kept = each.where((F.col("a.href") != "") & (F.length("a.label") >= 5))
    return kept.select("symbol", F.col("a.label").alias("title"), absolute(F.col("a.href"), base).alias("url"), "date_text", fiscal_year_of_text(F.col("date_text")).alias("fiscal_year"), "agency")


def page_pdf_links(pages: DataFrame, base: str) -> DataFrame:
    """(symbol, url, fiscal_year) of all links of a page to annual*.pdf or ar*.pdf."""
    a = pages.select("symbol", F.explode(anchors(F.col("html"))).alias("a")).where(F.col("a.href").rlike(r"(?i)annual.*\.pdf|ar.*\.pdf"))
    return a.select("symbol", absolute(F.col("a.href"), base).alias("url"), fiscal_year_of_text(F.col("a.href")).alias("fiscal_year")).distinct()


def head_latest(df: DataFrame, at: str, key: str, n: int = 10) -> DataFrame:
    """The newest n rows of a table."""
    return df.orderBy(F.desc(at), key).limit(n)


def query_log(queries: DataFrame) -> DataFrame:
    """Rows for the log of queries: text (cut to 2000), symbols as an array, intent, size of the response and milliseconds."""
    none = F.array().cast("array<string>")
    return queries.select("query_id", F.left("query", F.lit(2000)).alias("query"), F.coalesce("symbols", none).alias("symbols"), F.coalesce("intent", F.lit("general")).alias("intent"), F.length(F.coalesce("response", F.lit(""))).alias("response_chars"), F.greatest(F.coalesce("ms", F.lit(0)), F.lit(0)).alias("ms"))


def append_query_log(queries: DataFrame, path: str) -> None:
    """Adds queries to the log at a path."""
    query_log(queries).write.mode("append").parquet(path)


def coverage_lines(report: DataFrame, key: str) -> DataFrame:
    """A coverage report as lines of text, one for each key."""
    return report.select(F.format_string("%-24s reports %5d calls %5d total %5d%s", F.col(key).cast("string"), "reports", "calls", "total", F.when(F.col("attention"), " *").otherwise("")).alias("value"))


def write_coverage(report: DataFrame, key: str, path: str) -> None:
    coverage_lines(report, key).write.mode("errorifexists").text(path)
