"""The fan-out of mixed filings: small payloads, batches that come again or break off, and a stream."""

import pytest

from tidemark.operators import fanout
from tidemark.operators import filings as fl

SCHEMA = "symbol string, kind string, json string, seq long"
ONE = [
    ("A", "governance", '[{"Fld_QuarterId":"Q1","Year":"2024","Fld_EndDate":"01/04/2024","xbrlurl":""},{"Fld_QuarterId":"Q1","Year":"2024","Fld_EndDate":""}]', 1),
    ("A", "deals", '{"Table":[{"DEAL_DATE":"02/01/2024","CLIENT_NAME":"c","TRANSACTION_TYPE":"B","QUANTITY":"5","PRICE":"1.5"},{"CLIENT_NAME":"d","TRANSACTION_TYPE":"a very long side"}]}', 2),
    ("A", "board_meetings", '[{"meeting_date":"02/01/2024","Purpose_name":"x","Agenda":"old"},{"Purpose_name":"undated"}]', 3),
    ("", "complaints", '[{"qtr":"Q1","yr":"2024"}]', 4),
    ("A", "shareholding", '[{"qtr":"Q1","yr":"2024","PROMOTER_HOLDING":"50"},{"qtr":"Q1","yr":"2024","PROMOTER_HOLDING":"60"}]', 6),
    ("A", "shareholding", '[{"qtr":"Q1","yr":"2024","PROMOTER_HOLDING":"99"}]', 5),
    ("A", "unknown", "[{}]", 7),
    ("A", "integrated", "no json", 8),
]
TWO = [("A", "board_meetings", '[{"meeting_date":"02/01/2024","Purpose_name":"x","Agenda":"new"}]', 9), ("B", "deals", '[{"CLIENT_NAME":"e","TRANSACTION_TYPE":"S"}]', 10)]


def state(spark, root):
    out = {k: sorted(map(str, rows.collect())) for k in fl.KINDS if (rows := fanout.read_kind(spark, root, k)) is not None}
    return out | {"report": sorted(map(tuple, fanout.ingest_report(spark, root).collect()))}


def frames(spark):
    return spark.createDataFrame(ONE, SCHEMA), spark.createDataFrame(TWO, SCHEMA)


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("f") / "t")
    for n, batch in enumerate(frames(spark)):
        fanout.ingest_all(batch, root, n)
    return root, state(spark, root)


def test_tables_and_report(spark, whole):
    root, got = whole
    report = {r[0]: r[1:] for r in got["report"]}
    assert set(report) == set(fl.KINDS)
    assert (report["governance"], report["deals"], report["board_meetings"], report["complaints"], report["shareholding"], report["integrated"]) == ((2, 0, 0, 1), (3, 0, 1, 2), (3, 1, 0, 1), (1, 0, 1, 0), (3, 0, 0, 1), (0, 0, 0, 0))
    read = lambda kind, *c: [tuple(r[x] for x in c) for r in fanout.read_kind(spark, root, kind).collect()]
    assert read("shareholding", "promoter_holding") == [(60.0,)]  # the last by seq and place, not the largest
    assert read("board_meetings", "agenda") == [("new",)] and str(read("governance", "report_date")[0][0]) == "2024-04-01"
    rejected = spark.read.parquet(f"{root}/rejects").collect()
    assert sorted((r.kind, r.reasons) for r in rejected) == [("complaints", ["symbol"]), ("deals", ["buy_sell"])]


def test_a_batch_that_comes_again_or_broke_off_changes_nothing(spark, whole, tmp_path, monkeypatch):
    root, (one, two) = str(tmp_path / "t"), frames(spark)
    fanout.ingest_all(one, root, 0)
    upsert, calls = fanout.upsert_stored, []

    def broken(path, *args, **kw):
        calls.append(path)
        if len(calls) == 4:
            raise OSError("lost")
        return upsert(path, *args, **kw)

    monkeypatch.setattr(fanout, "upsert_stored", broken)
    with pytest.raises(OSError):
        fanout.ingest_all(two, root, 1)
    monkeypatch.setattr(fanout, "upsert_stored", upsert)
    for _ in range(2):
        fanout.ingest_all(two, root, 1)
    assert state(spark, root) == whole[1]


def test_stream(spark, whole, tmp_path):
    for i, rows in enumerate((ONE, TWO)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(fanout.ingest_batches(str(tmp_path / "t"))).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert state(spark, str(tmp_path / "t")) == whole[1]


@pytest.mark.parametrize("kind", ["deals", "board_meetings", "governance"])
def test_a_kind_is_counted_in_one_pass(spark, kind):
    """Rows read, undated and rejected come from one parse of the payloads, and are those of the parts."""
    table = '{"Table": [{"meeting_date": "01/02/2024", "CLIENT_NAME": "x"}, {"meeting_date": "", "TRANSACTION_TYPE": "a very long side"}]}'
    raw = spark.createDataFrame([("A", table), ("", table), (None, table), ("B", "no json"), ("C", None)], "symbol string, json string")
    rows, dated, _, rejects = fl.checked_filings(raw, kind)
    counted = fl.count_filings(rows, kind)
    assert counted.collect() == fl.split_summary(rows, dated, rejects, kind).collect()
    assert fl.count_filings(rows.limit(0), kind).collect() == [(kind, 0, 0, 0)]
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
