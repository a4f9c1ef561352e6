"""Listed universes, valuation payloads, and the sinks of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.payloads import PRICE


def load_universe(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """(symbol), distinct and sorted: of series EQ from a table with a header, or from JSON texts without all-digit ids."""
    if fmt == "csv":
        rows = spark.read.option("header", True).csv(path)
        names = {c.strip().upper(): c for c in rows.columns}
        out = rows.where(F.trim(F.col(names["SERIES"])) == "EQ").select(F.trim(F.col(names["SYMBOL"])).alias("symbol"))
    else:
        lists = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("symbol"))
        out = lists.where(~F.col("symbol").rlike(r"^\d+$"))
    return out.where(F.col("symbol").isNotNull() & (F.col("symbol") != "")).distinct().orderBy("symbol")


def read_valuation_payloads(df: DataFrame) -> DataFrame:
    """(symbol, trade_date, pe, eps) from (symbol, json): one row for each date with a PE."""
    sets = df.select("symbol", F.explode(F.from_json("json", PRICE)["datasets"]).alias("s"))
    kind = F.when(F.col("s.metric").contains("Earning") | F.upper("s.metric").contains("PE"), "pe").when(F.col("s.metric") == "EPS", "eps")
    rows = sets.select("symbol", kind.alias("kind"), F.explode("s.values").alias("v")).where("kind IS NOT NULL")
    rows = rows.select("symbol", "kind", F.get("v", F.lit(0)).try_cast("date").alias("trade_date"), F.get("v", F.lit(1)).try_cast("double").alias("x"))
    wide = rows.groupBy("symbol", "trade_date").pivot("kind", ["pe", "eps"]).agg(F.max("x"))
    return wide.where("pe IS NOT NULL AND trade_date IS NOT NULL")


def append_rows(df: DataFrame, path: str) -> None:
    """Adds rows to a table; a failed job leaves none of them."""
    df.write.mode("append").parquet(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    """One JSON object a line; NaN becomes null, decimals numbers, dates ISO texts."""
    clean = {"double": lambda c: F.nanvl(F.col(c), F.lit(None).cast("double")), "float": lambda c: F.nanvl(F.col(c), F.lit(None).cast("float"))}
    cols = [clean[t](c).alias(c) if t in clean else F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def read_jdbc_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int = 64, **options) -> DataFrame:
    """An external table read in parallel by ranges of a numeric key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)
