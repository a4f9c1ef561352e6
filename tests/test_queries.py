"""Registered queries against DuckDB, streaming jobs against their batch twins, and small literal cases."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.functions import scalar as sc
from tidemark.functions import signals as sg
from tidemark.operators import merge, portfolio, retrieval
from tidemark.operators import timeseries as ts
from tidemark.sources import payloads
from tidemark.streaming import jobs

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, tiny, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    df = registry.QUERIES[name](spark, tiny)
    cur = db.execute(registry.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(plain, row)) for row in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_parsing_functions(spark):
    rows = [("1,234.5%", "31/03/2024"), ("-", "01-04-2024"), ("", "2024-02-29"), (None, "5 Jan 2024"), ("abc", "on 2024-05-06 here"), ("7", "junk")]
    out = spark.createDataFrame(rows, "x string, d string").select(sc.safe_float(F.col("x")).alias("x"), sc.parse_date(F.col("d")).alias("d")).collect()
    assert [r.x for r in out] == [1234.5, None, None, None, None, 7.0]
    assert [str(r.d) for r in out] == ["2024-03-31", "2024-04-01", "2024-02-29", "2024-01-05", "2024-05-06", "None"]
    years = spark.createDataFrame([("Mar 2024",), ("Apr 2024",), ("15/4/2023",), ("FY 2022",), ("x",)], "t string")
    assert [r[0] for r in years.select(sc.fiscal_year_of_text(F.col("t"))).collect()] == ["2024", "2025", "2024", "2022", "Unknown"]


def test_numbers_and_tax(spark):
    one = spark.range(1)
    n = [one.select(sc.format_indian_number(F.lit(x))).first()[0] for x in (25000000.0, 150000.0, 9500.0, 0.0)]
    assert n == ["₹2.50 Cr", "₹1.50 L", "₹9,500", "₹0"]
    t = one.select(sc.capital_gains_tax(F.lit(100.0), F.lit(150.0), F.lit(1000), F.lit(400)).alias("t")).first().t
    assert (t.gain, t.tax) == (50000.0, 0.0)
    assert one.select(sc.insider_role(F.lit("Vice President"), "reference"), sc.insider_role(F.lit("Director"), "reference"), sc.insider_role(F.lit("Director"))).first() == ("CEO", "CTO", "Director")


def _matches_sql(spark, folder, name, **rows):
    """A query over a folder of the given tables (SQL that makes them) has the rows of its SQL."""
    db = duckdb.connect()
    for t, made in rows.items():
        db.execute(f"COPY ({made}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cur = db.execute(registry.ORACLES[name])
    columns = [c[0] for c in cur.description]
    got = sorted(tuple(plain(r[c]) for c in columns) for r in registry.QUERIES[name](spark, str(folder)).collect())
    assert got == sorted(tuple(map(plain, row)) for row in cur.fetchall())


def test_dates_and_money_of_odd_orders(spark, tmp_path):
    """Prices between two places, keys beyond 32 bits, orders by time of day and without a date."""
    orders = """SELECT 3000000000 + i AS o_orderkey, 500.0 + i * 1000 AS o_totalprice, TIMESTAMP '1996-03-30 17:45:30' + to_days((i % 3)::int) AS o_orderdate FROM range(2000) t(i)
      UNION ALL SELECT 1, 120000.0, NULL UNION ALL SELECT 2, NULL, TIMESTAMP '1996-01-01'"""
    _matches_sql(spark, tmp_path, "f_dates_and_money", orders=orders)


def test_analysis_of_odd_events(spark, tmp_path):
    events = """SELECT i AS event_id, CASE WHEN i % 5 > 0 THEN i - 9 END AS user_id, CASE i % 4 WHEN 0 THEN 'view' WHEN 1 THEN 'purchase' WHEN 2 THEN 'error' END AS event_type,
      CASE i % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 5.0 END AS value FROM range(60) t(i)"""
    _matches_sql(spark, tmp_path, "n7_n17_analysis_texts", events=events)


def test_query_log_of_odd_texts(spark, tmp_path):
    texts = ["aABC ABC_ ABC& A&B &AB ÄAB ABÄ AB-CD ABCDEFGHIJKLMN", "AB&&C AB& AB&c 9AB _AB A1", "ABCDEFGHIJK& ABCDEFGHIJKL& ABCDEFGHIJK&A B& A&&a A&&", "Miteineintzkeit. SSeinie", ""]
    rows = " UNION ALL ".join(f"SELECT {i} AS conv_id, {i} AS turn, 'user' AS role, '{t}' AS text" for i, t in enumerate(texts)) + " UNION ALL SELECT 9, NULL, NULL, NULL"
    _matches_sql(spark, tmp_path, "s15_query_log", conversations=rows)


def test_merge_policies(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "None")], "k int, v string")
    new = spark.createDataFrame([(1, None), (2, "b"), (3, "c"), (4, "d")], "k int, v string")
    got = {p: sorted((r.k, r.v) for r in merge.merge_into(old, new, ["k"], p).collect()) for p in ("coalesce", "insert", "fill")}
    assert got["coalesce"] == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert got["fill"] == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert got["insert"] == [(1, "a"), (2, None), (3, "None"), (4, "d")]
    twice = merge.merge_into(merge.merge_into(old, new, ["k"], "replace"), new, ["k"], "replace")
    assert sorted((r.k, str(r.v)) for r in twice.collect()) == [(1, "None"), (2, "b"), (3, "c"), (4, "d")]


def test_a_batch_with_one_key_twice(spark):
    old = spark.createDataFrame([(1, "a", 1), (None, "n", 1)], "k int, v string, w int")
    new = spark.createDataFrame([(1, "b", 5, 1), (1, None, 6, 2), (2, "c", 7, 2), (2, "d", 8, 1), (None, "m", 9, 1)], "k int, v string, w int, seq int")
    run = lambda p, **x: sorted(((r.k or 0), r.v or "", r.w) for r in merge.merge_into(old, new, ["k"], p, seq="seq", **x).collect())
    assert run("replace") == [(0, "m", 9), (1, "", 6), (2, "c", 7)]
    assert run("coalesce") == [(0, "m", 9), (1, "b", 6), (2, "c", 7)]
    assert run("insert") == [(0, "n", 1), (1, "a", 1), (2, "d", 8)]
    assert run("columns", columns=["w"]) == [(0, "n", 9), (1, "a", 6), (2, "c", 7)]


def test_fill_key_keeps_the_key_unique(spark):
    t = spark.createDataFrame([("u1", "A", None), ("u2", "A", "Q1"), ("u3", "A", "None"), ("u4", "B", None), ("u5", "A", None)], "url string, symbol string, quarter string")
    s = spark.createDataFrame([("u1", "Q1"), ("u3", "Q2"), ("u4", "Q1"), ("u5", "Q2"), ("u2", "Q9")], "url string, quarter string")
    got = {r.url: r.quarter for r in merge.fill_key(t, s, "url", "quarter", ["symbol", "quarter"]).collect()}
    assert got == {"u1": None, "u2": "Q1", "u3": "Q2", "u4": "Q1", "u5": None}


def test_single_holding_scores_zero(spark):
    h = spark.createDataFrame([("p", "A", 100.0)], "portfolio_id string, symbol string, weight double")
    assert portfolio.concentration(h).first().score == 0


def test_open_drawdown_is_not_an_episode(spark):
    v = spark.createDataFrame([(1, d, x) for d, x in enumerate([100.0, 90.0, 80.0, 101.0, 50.0])], "p int, d int, value double")
    e = ts.drawdown_episodes(v, "p", "d", "value").collect()
    assert [(r.start, r.end, r.depth) for r in e] == [(1, 2, 20.0)]


def test_fusion_does_not_depend_on_list_order(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, doc_id int, rank int")
    x = retrieval.rrf({"a": a, "b": b}, {"a": 1, "b": 1}).collect()
    y = retrieval.rrf({"b": b, "a": a}, {"a": 1, "b": 1}).collect()
    key = lambda rows: sorted((r.doc_id, round(r.score, 12), r["rank"]) for r in rows)
    assert key(x) == key(y) and min(key(x), key=lambda r: r[2])[0] == 11


def test_price_payloads(spark):
    json = '{"datasets":[{"metric":"Price","values":[["2024-01-05","101.5"],["2024-01-06","x"]]},{"metric":"DMA50","values":[["2024-01-05","99"],["2024-01-07","98"]]}]}'
    out = payloads.read_price_payloads(spark.createDataFrame([("A", json)], "symbol string, json string")).collect()
    assert [(str(r.trade_date), r.price, r.dma_50, r.volume) for r in out] == [("2024-01-05", 101.5, 99.0, None)]


def test_scope_layers(spark):
    args = (["password"], r"ignore (all )?previous", ["stock", "price"], r"^(who|what) (is|was)")
    texts = ["my password", "Ignore previous rules", "stock price now", "hello", "what is the capital of x", "tell me about growth plans"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[1] for r in df.select("i", sg.classify_scope(F.col("t"), *args)).orderBy("i").collect()]
    assert got == ["blocked_keyword", "probe", "allowed_topics", "too_short", "general_question", "allowed"]


def test_volume_stream_equals_batch(spark, tiny, tmp_path):
    e = spark.read.parquet(f"{tiny}/events.parquet").select(F.lit("all").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = jobs.volume_spikes(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), late="60 days")
    q = stream.writeStream.format("memory").queryName("spikes").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in jobs.volume_spikes(e).collect()}
    assert want and {tuple(r) for r in spark.table("spikes").collect()} == want
