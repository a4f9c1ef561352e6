"""Readers of raw payloads: JSON price series, exchange tables, HTML links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRICE = "struct<datasets:array<struct<metric:string,values:array<array<string>>>>>"


def read_price_payloads(df: DataFrame) -> DataFrame:
    """(symbol, trade_date, price, dma_50, dma_200, volume) from (symbol, json): one row per date with a price."""
    sets = df.select("symbol", F.explode(F.from_json("json", PRICE)["datasets"]).alias("s"))
    rows = sets.select("symbol", F.col("s.metric").alias("metric"), F.explode("s.values").alias("v"))
    rows = rows.select("symbol", "metric", F.get("v", F.lit(0)).try_cast("date").alias("trade_date"), F.get("v", F.lit(1)).try_cast("double").alias("x"))
    wide = rows.groupBy("symbol", "trade_date").pivot("metric", ["Price", "DMA50", "DMA200", "Volume"]).agg(F.max("x"))
    return wide.where("Price IS NOT NULL").select(
        "symbol", "trade_date", F.col("Price").alias("price"), F.col("DMA50").alias("dma_50"), F.col("DMA200").alias("dma_200"), F.col("Volume").cast("long").alias("volume")
    )


def normalize_table(df: DataFrame, mapping: dict[str, list[str]], json: str = "json") -> DataFrame:
    """Rows of payloads {"Table": [..]} or [..]: each column takes the first of its keys that is not empty."""
    inner = F.coalesce(F.get_json_object(json, "$.Table"), F.when(F.col(json).startswith("["), F.col(json)))
    rows = df.select("symbol", F.explode(F.from_json(inner, "array<map<string,string>>")).alias("r"))
    pick = lambda keys: F.coalesce(*[F.nullif(F.try_element_at("r", F.lit(k)), F.lit("")) for k in keys])
    return rows.select("symbol", *[pick(keys).alias(c) for c, keys in mapping.items()])


def anchors(html: Column) -> Column:
    """array<struct<href, label>> of the anchors of a page, in order."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>"), F.lit(0))
    return F.transform(
        tags,
        lambda t: F.struct(
            F.regexp_extract(t, r"(?is)href\s*=\s*[\"']([^\"']*)[\"']", 1).alias("href"),
            F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]*>", " "), r"\s+", " ")).alias("label"),
        ),
    )


def extract_links(pages: DataFrame, keep: Column | None = None) -> DataFrame:
    """(page_id, url, href, label) of the links of (page_id, url, html): absolute, each once per page."""
    each = pages.select("page_id", "url", F.posexplode(anchors(F.col("html"))).alias("pos", "a"))
    host = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    href = F.when(F.col("a.href").startswith("/"), F.concat(host, F.col("a.href"))).otherwise(F.col("a.href"))
    out = each.select("page_id", "url", "pos", href.alias("href"), F.col("a.label").alias("label"))
    first = out.groupBy("page_id", "url", "href").agg(F.min_by("label", "pos").alias("label"))
    return first if keep is None else first.where(keep)
