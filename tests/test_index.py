"""Chunking, trees, search, streams and filings on small literal cases."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import filings as fl
from tidemark.operators import indexing as ix
from tidemark.operators import retrieval as rt
from tidemark.sources import feeds
from tidemark.streaming import jobs

RULES = [(n, re.compile(p, re.M)) for n, p in ix.HEADINGS]
SENTENCE = "The plant ran well this year and output rose again. "


def test_marks_are_greedy_in_the_order_of_patterns():
    text = "Chairman\nLetter from the Chairman\n" + SENTENCE * 5 + "\nOutlook\n" + SENTENCE + "\nRisk management\nx"
    marks = ix.section_marks(text, RULES)
    assert [m[1] for m in marks] == ["chairman_letter", "risk_management"]  # Outlook stands within 100 of an earlier pattern's match
    assert marks[0][2] == "Letter from the Chairman" and marks[0][3] == 1.0


def test_table_regions():
    table = "\n".join(f"| a{i} | {i} | {i * i} |" for i in range(20))
    text = SENTENCE * 10 + "\n" + table + "\n" + SENTENCE * 10
    (a, b), = ix.table_regions(text)
    assert a <= text.index("| a0") and b >= text.index("| a19") and ix.table_regions("| a | b |\n") == []


def test_chunks_of_a_report():
    parts = [SENTENCE * 20, "Management discussion\n" + SENTENCE * 300, "Outlook\n" + SENTENCE * 30]
    text = "\n".join(parts)
    chunks = ix.chunk_text(text, "report", RULES)
    assert [c[0] for c in chunks] == ["preamble", *["mda"] * (len(chunks) - 2), "outlook"] and len(chunks) > 4
    assert chunks[0][2] == 0 and chunks[-1][3] == len(text) and all(a[3] == b[2] for a, b in zip(chunks, chunks[1:]))
    assert all(c[3] - c[2] <= 4800 for c in chunks) and all(text[: c[3]].endswith((". ", ".\n", "\n")) for c in chunks[1:-2])
    assert ix.chunk_text("short", "report", RULES) == [("unknown", "", 0, 5)]
    assert ix.chunk_text("", "report", RULES) == [("unknown", "", 0, 0)]


def test_chunks_of_a_call_keep_questions_with_answers():
    turn = lambda who, n: f"{who}: " + SENTENCE * n
    text = "\n".join(["Jane Roe - Big Fund", turn("Operator", 30), turn("Analyst One", 20), turn("Management", 40), turn("Analyst Two", 20), turn("Management", 30)])
    chunks = ix.chunk_text(text, "call", RULES)
    starts = [text[c[2] : c[2] + 11] for c in chunks]
    assert "Analyst One" in starts and "Analyst Two" in starts and not any(s.startswith("Management") for s in starts)
    assert chunks[-1][3] == len(text)


def test_overlap_pages_and_label(spark):
    text = "Outlook\n" + SENTENCE * 300
    rows = ix.chunk_documents(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id", "chunk_index").collect()
    first, second = rows[0], rows[1]
    assert first.overlap is None and second.overlap.startswith("[Outlook] ") and len(second.overlap) <= 310
    assert (first.page_start, rows[-2].page_end) == (1, (len(text) - 1) // 3000 + 1) and rows[-1].section == "unknown"
    one = spark.createDataFrame([("x\nOutlook\n",), ("nothing",)], "t string").select(ix.section_label(F.col("t"))).collect()
    assert [r[0] for r in one] == ["outlook", None]


def test_enriched_chunks_and_vectors(spark):
    docs = spark.createDataFrame([(1, SENTENCE * 200), (2, SENTENCE * 20), (3, "x")], "doc_id long, text string")
    meta = spark.createDataFrame([(i, "ABC", "Annual Report", "2024", None, "Acme") for i in (1, 2, 3)], "doc_id long, symbol string, doc_type string, fiscal_year string, quarter string, company string")
    index = ix.build_index(docs, meta, spark.createDataFrame([(2,)], "doc_id long"))
    rows = index["chunks"].collect()
    assert {r.doc_id for r in rows} == {1} and all(r.embed_text.startswith("This is from ABC (Acme)'s Annual Report for FY2024, in the") for r in rows)
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-3 and len(r.embedding) == 64 for r in rows)
    bad = ix.embed_chunks(docs, "text", embedder=lambda texts: [[1.0]] * len(texts), keys=["doc_id"])
    with pytest.raises(Exception, match="another number or size"):
        bad.collect()
    done = ix.embed_chunks(docs, "text", keys=["doc_id"], done=docs.where("doc_id < 3"))
    assert [r.doc_id for r in done.collect()] == [3]


def test_hybrid_search_prefers_the_text_that_holds_the_query(spark):
    texts = ["copper mine output and prices in the north", "dairy farms report milk yields", "steel mill closes after a fire", "copper wire demand grows"]
    c = spark.createDataFrame([(i, 0, "notes", f"T{i}", t, 1, 1) for i, t in enumerate(texts)], "doc_id long, chunk_index int, section string, title string, chunk_text string, page_start int, page_end int")
    chunks = ix.embed_chunks(c, "chunk_text")
    q = ix.embed_chunks(spark.createDataFrame([(7, "copper mine output")], "query_id long, query string"), "query", keys=["query_id"]).withColumnRenamed("embedding", "vector")
    got = rt.hybrid_search({"chunks": chunks, "trees": ix.section_tree(c)}, q, k=3, expansions=q.select("query_id", "vector")).orderBy("rank").collect()
    assert got[0].key == "chunk:0:0" and got[0].methods == ["expansion", "keyword", "tree", "vector"] and len(got) == 3


def test_hybrid_search_reads_all_trees_and_whole_texts(spark):
    """The oldest of more than fifty trees is searched, and words behind the start of a text count in the last order."""
    texts = ["copper mine output"] + [f"dairy farm {i} reports milk" for i in range(70)] + ["dairy " * 100 + "copper smelter"]
    c = spark.createDataFrame([(i, 0, "notes", f"T{i}", t, 1, 1) for i, t in enumerate(texts)], "doc_id long, chunk_index int, section string, title string, chunk_text string, page_start int, page_end int")
    chunks = ix.embed_chunks(c, "chunk_text")
    q = ix.embed_chunks(spark.createDataFrame([(7, "copper mine output"), (8, "copper smelter")], "query_id long, query string"), "query", keys=["query_id"]).withColumnRenamed("embedding", "vector")
    got = {(r.query_id, r["rank"]): r for r in rt.hybrid_search({"chunks": chunks, "trees": ix.section_tree(c)}, q, k=3).collect()}
    assert got[(7, 1)].key == "chunk:0:0" and "tree" in got[(7, 1)].methods
    assert got[(8, 1)].key == "chunk:71:0"


def test_hybrid_query_indexes_short_documents_too(spark, tiny):
    from tidemark import registry_index

    held = registry_index._index(spark, tiny, least=0)["chunks"].select("doc_id").distinct().count()
    assert held == spark.read.parquet(f"{tiny}/documents.parquet").where("length(text) > 0").select("doc_id").distinct().count()


def test_vector_search_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)] + [(99, [0.0, 0.0, 0.0])], "vec_id long, embedding array<double>").repartition(5)
    q = rows.where("vec_id < 9").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    key = lambda df: sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())
    whole = key(rt.vector_search(rows, q, 4))
    assert len(whole) == 36 and all(a[3] == 1.0 for a in whole if a[1] == 1)
    monkeypatch.setattr(rt, "BROADCAST_ROWS", 2)
    assert key(rt.vector_search(rows, q, 4)) == whole


def test_filing_payloads(spark):
    rows = [("A", '{"Table":[{"meeting_date":"","tm":"2024-05-06T00:00:00","Purpose_name":"","PURPOSE":"Results","Agenda":"x"},{"tm":"soon"}]}'), ("B", "[]"), ("C", '""'), ("D", ""), ("E", None), ("F", "{}")]
    out = fl.normalize_filings(spark.createDataFrame(rows, "symbol string, json string"), "board_meetings").collect()
    assert [(r.symbol, str(r.meeting_date), r.purpose) for r in out] == [("A", "2024-05-06", "Results"), ("A", "None", None)]
    page = "<p>" + SENTENCE * 2 + "</p><script>x</script>"
    out = fl.normalize_filings(spark.createDataFrame([("A", '[{"MEETING_DATE":"2024-01-02","Purpose":"38th AGM","content":"' + page + '"}]')], "symbol string, json string"), "shareholder_meetings").first()
    assert out.meeting_type == "AGM" and out.content == (SENTENCE * 2).strip()
    for kind in fl.KINDS:
        assert fl.normalize_filings(spark.createDataFrame(rows[:1], "symbol string, json string"), kind).count() == 2


def test_sinks(spark, tmp_path):
    q = spark.createDataFrame([(1, "x" * 3000, None, None, "abc", -5)], "query_id int, query string, symbols array<string>, intent string, response string, ms int")
    feeds.append_query_log(q, str(tmp_path / "log"))
    feeds.append_query_log(q, str(tmp_path / "log"))
    got = spark.read.parquet(str(tmp_path / "log")).collect()
    assert len(got) == 2 and (len(got[0]["query"]), got[0].symbols, got[0].intent, got[0].ms) == (2000, [], "general", 0)
    report = fl.coverage_report(spark.createDataFrame([("A", "2020"), ("A", "x")], "s string, y string"), spark.createDataFrame([("B",)], "s string"), "s", "y")
    feeds.write_coverage(report, "s", str(tmp_path / "cover"))
    assert spark.read.text(str(tmp_path / "cover")).count() == 2


def test_streams_equal_their_batch_twins(spark, tiny, tmp_path):
    e = spark.read.parquet(f"{tiny}/events.parquet").select(F.col("user_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = jobs.profile_stream(stream, ["purchase"]).writeStream.format("memory").queryName("profiles").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(map(str, r)) for r in spark.table("profiles").collect()} == {tuple(map(str, r)) for r in jobs.profile_stream(e, ["purchase"]).collect()}


def test_upsert_stream(spark, tmp_path):
    step = jobs.upsert_batches(str(tmp_path / "t"), ["k"])
    schema = "k int, v string, seq int"
    step(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1)], schema), 0)
    for _ in range(2):  # a batch that is run again changes nothing
        step(spark.createDataFrame([(2, "y", 1), (3, "z", 1)], schema), 1)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).drop("key_bucket").collect()) == [(1, "b"), (2, "y"), (3, "z")]
    assert jobs.first_seen(spark.createDataFrame([(1, "a", 1), (1, "b", 2)], schema), ["k"]).count() == 1


def test_alert_stream_equals_batch(spark, tiny, tmp_path):
    e = spark.read.parquet(f"{tiny}/events.parquet").select(F.concat(F.lit("u"), F.col("user_id") % 20).alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") % 200 / 100.0 - 1).alias("sentiment"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = jobs.sentiment_alert_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("alerts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    key = lambda rows: sorted((r.symbol, r.ts, round(r.sentiment, 6), r.kind, r.severity, None if r.previous is None else round(r.previous, 6)) for r in rows)
    want = jobs.sentiment_alerts(e)
    assert key(spark.table("alerts").collect()) == key(want.collect())
    assert jobs.alerts_of(want, spark.createDataFrame([("u1",)], "symbol string")).select("symbol").distinct().count() == 1


def test_table_lines_and_speakers():
    rows = {"| a | b |": True, "| a |": False, "Revenue from operations   1,234.5   (98)": True, "Total\t12\t-\t7%": True, "Rs. 5 and INR 7 and ₹8": True, "In 2024  we grew  a lot": False, "Rs 5 only": False, "": False}
    assert {line: ix.is_table_line(line) for line in rows} == rows
    speakers = {
        "Q: how much?": ("letter", "Q", True), "A. Ten": ("letter", "A", False), "Operator: next, please": ("role", "Operator", False), "Analyst One: hello": ("role", "Analyst One", True),
        "Mr. Rao: thanks": ("role", "Mr. Rao", False), "Jane Roe (Chief Analyst): yes": ("titled", "Jane Roe", True), "Jane Roe - Big Fund": ("firm", "Jane Roe", False),
        "we sold it - at last": None, "The plan: more": None, "Margins: 5": None,
    }
    assert {line: ix.speaker_of(line) for line in speakers} == speakers
    assert ix.speaker_turns("Q: one\nQ: two\n") == []


def test_chunks_in_sql_are_those_of_the_library(spark, tiny):
    from tidemark.functions.batch import register_chunk_text

    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    register_chunk_text(spark, name="chunks_here")
    docs.createOrReplaceTempView("docs_here")
    columns = "doc_id, chunk_index, section, title, chunk_text, char_start, char_end, page_start, page_end"
    got = spark.sql(f"SELECT {columns} FROM docs_here, LATERAL chunks_here(text, 'report')")
    want = ix.chunk_documents(docs).select(*columns.split(", "))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_callables_work_on_batches(spark, tmp_path):
    from tidemark.functions.batch import batched
    from tidemark.operators.screening import rerank

    log = str(tmp_path / "calls")

    def shorten(texts):
        with open(log, "a") as f:
            f.write(f"{len(texts)}\n")
        return [None if t is None else t[:3].upper() for t in texts]

    df = spark.createDataFrame([(i, None if i == 7 else f"text {i}") for i in range(1000)], "i int, t string").coalesce(1)
    got = df.select("i", batched(shorten, most=300)("t").alias("s")).collect()
    assert {r.s for r in got} == {"TEX", None} and [int(x) for x in open(log)] == [300, 300, 300, 100]
    with pytest.raises(Exception, match="came back"):
        df.select(batched(lambda texts: texts[1:])("t")).collect()
    summed = ix.rollup_summaries(ix.chunk_documents(spark.createDataFrame([(1, "Outlook\n" + SENTENCE * 900)], "doc_id long, text string")), summarize=batched(lambda ts: [t[:10] for t in ts]))
    assert {len(r.summary) for r in summed.collect()} == {10}
    found = spark.createDataFrame([(1, "k1", "plant", "a plant", 0.1, 1), (1, "k2", "plant", "other", 0.9, 2)], "query_id int, key string, query string, text string, score double, rank int")
    score = batched(lambda qs, ts: [float(q in t) for q, t in zip(qs, ts)], "double")
    assert [r.key for r in rerank(found, "query", "text", score).orderBy("rank").collect()] == ["k1", "k2"]


def test_chunks_are_handed_on_in_small_batches(spark, monkeypatch):
    """Also from one large batch of texts."""
    import pyarrow as pa

    class Docs:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    text = "One sentence stands here. " * 40
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": text, "kind": "report"} for i in range(100)])
    monkeypatch.setattr(ix, "TOGETHER", 5000)
    parts = list(ix.chunk_documents(Docs())(iter([batch])))
    assert max(p.num_rows for p in parts) <= 5 and sum(len(t) for p in parts for t in p["chunk_text"].to_pylist()) == 100 * len(text)
