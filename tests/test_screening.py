"""Small literal cases of screens, look-ups, text rules, roll-ups and file sources."""

from pyspark.sql import functions as F

from tidemark.functions import scalar as sc
from tidemark.functions import signals as sg
from tidemark.operators import screening as sn
from tidemark.sources import files


def test_years_and_calls(spark):
    y = spark.createDataFrame([("2015",), ("2014",), ("Unknown",), ("x",), (None,)], "y string")
    assert sorted(r.y for r in sn.year_range(y, "y").collect()) == ["2015", "Unknown"]
    c = spark.createDataFrame([(1, "transcript"), (1, "ai_summary"), (1, "ppt"), (2, "ai_summary"), (3, "ppt")], "call int, kind string")
    assert sorted(map(tuple, sn.select_call_docs(c, ["call"]).collect())) == [(1, "ppt"), (1, "transcript"), (2, "ai_summary"), (3, "ppt")]


def test_resolve_codes_order(spark):
    rows = [("ABC", ["1/First/XYZ/A", "2/Second/ABCD/A", "3/Third/ABC/A"]), ("QQ", ["bad", "7/Seven/SEV/A"]), ("NO", ["x/y"])]
    got = {r["query"]: r["code"] for r in sn.resolve_codes(spark.createDataFrame(rows, "query string, lines array<string>")).collect()}
    assert got == {"ABC": "2", "QQ": "7"}


def test_rerank(spark):
    h = spark.createDataFrame([(1, 1, "red fox", "blue whale"), (1, 2, "red fox", "a red fox")], "query_id int, rank int, q string, t string")
    assert [r.t for r in sn.rerank(h, "q", "t").orderBy("rank").collect()] == ["a red fox", "blue whale"]


def test_text_rules(spark):
    text = "Sales of 2019 are projected to grow.\n- one\n-- two\nScore: 12"
    one = spark.createDataFrame([(text,), (None,)], "t string")
    row = one.select(sg.fact_check(F.col("t"), 2026).alias("f"), sg.bullet_points(F.col("t")).alias("b"), sg.analyst_score(F.col("t")).alias("s")).collect()
    assert (row[0].f, row[0].b, row[0].s) == (["2019"], ["one", "two"], 1.0)
    assert (row[1].f, row[1].b) == (None, [])
    r = spark.range(1).select(
        sc.build_url(F.lit("/files/report-2024.pdf"), "https://x.test/").alias("u"), sc.build_url(F.lit("a.pdf"), "https://x.test").alias("e"),
        sc.meeting_type(F.lit("38th A.G.M notice")).alias("m"), sc.company_of_title(F.lit("Acme Ltd Annual Report 2024")).alias("c"),
        sc.insider_name(F.lit("4 - ACME (0001) (Jane Roe)")).alias("n"), sc.to_crore(F.lit(25000000.0)).alias("cr"),
    ).first()
    assert tuple(r) == ("https://x.test/files/report-2024.pdf", "", "AGM", "Acme Ltd", "Jane Roe", 2.5)


def test_files(spark, tmp_path):
    (tmp_path / "eq.csv").write_text("SYMBOL, SERIES\nB,EQ\nA,EQ\nA,EQ\nC,BE\n,EQ\n")
    assert [r.symbol for r in files.load_universe(spark, str(tmp_path / "eq.csv")).collect()] == ["A", "B"]
    (tmp_path / "eq.json").write_text('["B", "500325", "A"]')
    assert [r.symbol for r in files.load_universe(spark, str(tmp_path / "eq.json"), "json").collect()] == ["A", "B"]
    json = '{"datasets":[{"metric":"Price to Earning","values":[["2024-01-05","20.5"],["2024-01-06","x"]]},{"metric":"EPS","values":[["2024-01-05","4"],["2024-01-07","5"]]}]}'
    out = files.read_valuation_payloads(spark.createDataFrame([("A", json)], "symbol string, json string")).collect()
    assert [(str(r.trade_date), r.pe, r.eps) for r in out] == [("2024-01-05", 20.5, 4.0)]
    files.write_ndjson(spark.sql("SELECT double('NaN') AS x, 1.5BD AS y"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out"), schema="x double, y double").first() == (None, 1.5)
