"""Queries of the document index and retrieval (see registry.py).

Trees, tree search and roll-ups also run over the lines of the documents as chunks, which SQL can cut in the same way.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.batch import register_chunk_text
from tidemark.functions.stemming import STOP_WORDS, stems_sql
from tidemark.operators import filings as fl
from tidemark.operators import indexing as ix
from tidemark.operators import keyword as kw
from tidemark.operators import retrieval as rt
from tidemark.operators import staged as sg
from tidemark.registry import query, r, table
from tidemark.sources import store

_ITEMS = "SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id % 100 = 0"
_TITLES = "SELECT doc_id AS query_id, string_split(text, chr(10))[1] AS query FROM documents WHERE doc_id % 100 = 0"
_BM25 = r"""w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), l AS (SELECT doc_id, count(*) AS dl FROM w GROUP BY 1), n AS (SELECT count(*) AS n, avg(dl) AS a FROM l),
q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM asked),
p AS (SELECT term, doc_id, count(*) AS tf FROM w SEMI JOIN q USING (term) GROUP BY ALL),
h AS (SELECT * FROM p JOIN q USING (term) JOIN l USING (doc_id)), f AS (SELECT query_id, term, count(*) AS df FROM h GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 9) AS raw, count(*) AS got FROM h JOIN f USING (query_id, term), n GROUP BY ALL),
m AS (SELECT query_id, count(*) AS need FROM q GROUP BY 1)"""


@query(f"""WITH asked AS ({_TITLES}), {_BM25}, k AS (SELECT query_id, doc_id, raw / (raw + 1) AS score, row_number() OVER (PARTITION BY query_id ORDER BY raw / (raw + 1) DESC, doc_id) AS rank FROM s JOIN m USING (query_id) WHERE got = need)
SELECT query_id, doc_id, round(score, 6) AS score, rank::int AS rank FROM k WHERE rank <= 10""")
def r5_bm25_search(spark, d):
    """Texts that hold all terms of the first line of a document whose id is divisible by 100."""
    q = table(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.split("text", "\n", -1)[0].alias("query"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    return rt.bm25_all_terms(docs, q).select("query_id", "doc_id", r("score").alias("score"), "rank")


@query(f"""WITH asked AS ({_ITEMS}), {_BM25}, k AS (SELECT query_id, doc_id, raw / (raw + 1) AS score, row_number() OVER (PARTITION BY query_id ORDER BY raw / (raw + 1) DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, round(score, 6) AS score, rank::int AS rank FROM k WHERE rank <= 10""")
def r5_bm25_ranked(spark, d):
    """Texts with the highest sum over the terms of a benchmark item that they hold."""
    q = table(spark, d, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    hits, words = rt.query_hits(docs, q)
    return rt.bm25_search(hits, words, rt.term_stats(docs), all_terms=False).select("query_id", "doc_id", r("score").alias("score"), "rank")


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_PLACES = rf"""d AS (SELECT doc_id, source, regexp_extract_all(lower(concat_ws(' ', source, lang)), '[a-z0-9]+') AS a, regexp_extract_all(lower(text), '[a-z0-9]+') AS b FROM documents),
t1 AS (SELECT doc_id, source, unnest(a) AS word, unnest(range(1, len(a) + 1)) AS pos, 1.0::double AS inverse FROM d), o AS (SELECT doc_id, max(pos) AS last FROM t1 WHERE word NOT IN ({_STOP}) GROUP BY 1),
t2 AS (SELECT doc_id, source, unnest(b) AS word, unnest(range(1, len(b) + 1)) AS pos, 2.5::double AS inverse FROM d),
tw AS (SELECT * FROM t1 UNION ALL SELECT t2.doc_id, source, word, pos + coalesce(last, 0), inverse FROM t2 LEFT JOIN o USING (doc_id)),
v AS (SELECT DISTINCT word FROM tw WHERE word NOT IN ({_STOP})), st AS ({stems_sql('SELECT word FROM v')}), k AS (SELECT doc_id, source, stem AS term, pos, inverse FROM tw JOIN st USING (word))"""


def _covers(filtered: str = "true") -> str:
    """Ranks of (query_id, query, wanted) in asked by the covers of all stems, from _PLACES."""
    return rf"""qw AS (SELECT DISTINCT query_id, wanted, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS word FROM asked), qv AS (SELECT DISTINCT word FROM qw WHERE word NOT IN ({_STOP})), qs AS ({stems_sql('SELECT word FROM qv')}),
q AS (SELECT DISTINCT query_id, wanted, stem AS term FROM qw JOIN qs USING (word)), n AS (SELECT query_id, count(*) AS need FROM q GROUP BY 1),
h AS (SELECT query_id, doc_id, k.term, pos, inverse FROM k JOIN q USING (term) WHERE {filtered}), g AS (SELECT query_id, doc_id FROM h JOIN n USING (query_id) GROUP BY query_id, doc_id, need HAVING count(DISTINCT term) = need),
e AS (SELECT *, row_number() OVER w AS rn, sum(inverse) OVER w AS cum FROM h SEMI JOIN g USING (query_id, doc_id) WINDOW w AS (PARTITION BY query_id, doc_id ORDER BY pos)),
l AS (SELECT e.query_id, e.doc_id, e.pos, e.rn, e.cum, max(CASE WHEN e.term = q.term THEN e.pos END) OVER (PARTITION BY e.query_id, e.doc_id, q.term ORDER BY e.pos) AS lp FROM e JOIN q USING (query_id)),
m AS (SELECT query_id, doc_id, pos, rn, cum, CASE WHEN count(lp) = count(*) THEN min(lp) END AS low FROM l GROUP BY ALL),
c AS (SELECT *, coalesce(max(low) OVER (PARTITION BY query_id, doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m),
x AS (SELECT c.query_id, c.doc_id, c.pos - c.low AS far, c.rn - b.rn + 1 AS words, c.cum - b.cum + b.inverse AS total FROM c JOIN e AS b ON b.query_id = c.query_id AND b.doc_id = c.doc_id AND b.pos = c.low WHERE c.low > c.before),
s AS (SELECT query_id, doc_id, round(sum(words / total / (1 + far - (words - 1))), 9) AS raw FROM x GROUP BY ALL),
z AS (SELECT query_id, doc_id, raw / (raw + 1) AS score, row_number() OVER (PARTITION BY query_id ORDER BY raw / (raw + 1) DESC, doc_id) AS rank FROM s)
SELECT query_id, doc_id, round(score, 6) AS score, rank::int AS rank FROM z WHERE rank <= 10"""


def _keyword_index(spark, d) -> str:
    """The stored index of the documents: source and language as the prefix, the text, and the source as a filter."""
    path = store.new_path(spark, "keywords")
    docs = table(spark, d, "documents").select("doc_id", "source", "text", F.concat_ws(" ", "source", "lang").alias("prefix"))
    kw.write_index(kw.keyword_postings(docs, ["doc_id"], {"prefix": "A", "text": "B"}, ["source"]), path)
    return path


@query(f"""WITH {_PLACES} SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n_places, min(pos)::int AS first_place, max(pos)::int AS last_place, round(sum(1 / inverse), 6) AS weight FROM k GROUP BY term""")
def r5_keyword_index(spark, d):
    """What the stored index holds of each stem."""
    held = spark.read.parquet(_keyword_index(spark, d)).select("term", "doc_id", "at")
    weight = F.aggregate("at", F.lit(0.0), lambda sum_, a: sum_ + kw.weight(a))
    by = held.groupBy("term").agg(
        F.count("doc_id").alias("rows"), F.sum(F.size("at")).alias("n_places"), kw.place(F.min(F.array_min("at"))).alias("first_place"), kw.place(F.max(F.array_max("at"))).alias("last_place"), r(F.sum(weight)).alias("weight")
    )
    # rows of a stem are its documents but where an id occurs again
    again = rt.small(table(spark, d, "documents").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1"))
    more = held.join(again, "doc_id", "left_semi").groupBy("term").agg((F.count("*") - F.count_distinct("doc_id")).alias("more"))
    return by.join(more, "term", "left").select("term", (F.col("rows") - F.coalesce("more", F.lit(0))).alias("n_docs"), "n_places", "first_place", "last_place", "weight")


@query(f"""WITH asked AS (SELECT doc_id AS query_id, NULL AS wanted, string_split(text, chr(10))[1] AS query FROM documents WHERE doc_id % 100 = 0), {_PLACES}, {_covers()}""")
def r5_keyword_search(spark, d):
    """The first line of every document whose id is divisible by 100, over the stored index."""
    q = table(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.split("text", "\n", -1)[0].alias("query"))
    return kw.keyword_search(spark, _keyword_index(spark, d), q).select("query_id", "doc_id", r("score").alias("score"), "rank")


@query(f"""WITH asked AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 200 = 0 THEN source END AS wanted, string_split(text, chr(10))[1] AS query FROM documents WHERE doc_id % 100 = 0), {_PLACES}, {_covers("wanted IS NULL OR wanted = source")}""")
def r5_keyword_filtered(spark, d):
    """The first lines again, half of them within the document's own source."""
    q = table(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.split("text", "\\n", -1)[0].alias("query"), F.when(F.col("doc_id") % 200 == 0, F.col("source")).alias("source"))
    return kw.keyword_search(spark, _keyword_index(spark, d), q).select("query_id", "doc_id", r("score").alias("score"), "rank")


#: Lines as chunks: section by the place of a line, page of three lines.
LINES = """c AS (SELECT doc_id, i::int AS chunk_index, x AS chunk_text, CASE i % 3 WHEN 0 THEN 'risk_management' WHEN 1 THEN 'outlook' ELSE 'notes' END AS section,
  CASE WHEN i % 3 = 2 THEN 'Note ' || i ELSE CASE i % 3 WHEN 0 THEN 'Risk Management' ELSE 'Outlook' END END AS title, (i // 3 + 1)::int AS page
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE length(x) > 0)"""


def line_chunks(spark, d, docs=None):
    c = (table(spark, d, "documents") if docs is None else docs).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "x")).where("length(x) > 0")
    section = F.when(F.col("i") % 3 == 0, "risk_management").when(F.col("i") % 3 == 1, "outlook").otherwise("notes")
    title = F.when(F.col("i") % 3 == 2, F.concat(F.lit("Note "), "i")).otherwise(F.initcap(F.replace(section, F.lit("_"), F.lit(" "))))
    page = (F.floor(F.col("i") / 3) + 1).cast("int")
    return c.select("doc_id", F.col("i").alias("chunk_index"), section.alias("section"), title.alias("title"), F.col("x").alias("chunk_text"), page.alias("page_start"), page.alias("page_end"))


@query(f"""WITH {LINES}, g AS (SELECT doc_id, section, min(page) AS start_page, max(page) AS end_page, count(*) AS n_chunks, arg_min(title, chunk_index) AS title, arg_min(chunk_text, chunk_index) AS t,
  string_agg(chunk_index::varchar, ',' ORDER BY chunk_index) AS ids FROM c GROUP BY ALL),
k AS (SELECT doc_id, section, count(*) AS n FROM c JOIN g USING (doc_id, section) WHERE c.title <> g.title AND n_chunks > 3 GROUP BY ALL)
SELECT doc_id, section, title, CASE WHEN section = 'notes' THEN 2 ELSE 1 END AS level, start_page, end_page, left(trim(left(t, 500), ' '), 300) AS summary, ids, coalesce(n, 0)::int AS n_children FROM g LEFT JOIN k USING (doc_id, section)""")
def r6_section_tree(spark, d):
    t = ix.section_tree(line_chunks(spark, d)).select("doc_id", F.explode("nodes").alias("n"))
    return t.select("doc_id", "n.section", "n.title", "n.level", "n.start_page", "n.end_page", "n.summary", F.array_join("n.chunk_ids", ",").alias("ids"), F.size("n.children").alias("n_children"))


def _tree_sql(which: str = "true") -> str:
    return rf"""WITH {LINES}, g AS (SELECT doc_id, section, count(*) AS n_chunks, arg_min(title, chunk_index) AS title, left(trim(left(arg_min(chunk_text, chunk_index), 500), ' '), 300) AS summary, list(chunk_index ORDER BY chunk_index) AS ids FROM c WHERE {which} GROUP BY ALL),
ch AS (SELECT c.doc_id, c.section, c.title, trim(left(c.chunk_text, 200), ' ') AS summary, [c.chunk_index] AS ids FROM c JOIN g ON c.doc_id = g.doc_id AND c.section = g.section WHERE c.title <> g.title AND n_chunks > 3),
e AS (SELECT doc_id, section, title, summary, ids FROM g UNION ALL SELECT * FROM ch), e2 AS (SELECT *, ids[1] AS at0, len(ids) AS size FROM e),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM benchmark WHERE item_id % 100 = 0),
q2 AS (SELECT * FROM q WHERE word NOT IN ({', '.join(repr(w) for w in ix.TREE_STOP)})),
wd AS (SELECT doc_id, section, at0, size, ids, unnest(list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+'))) AS word, 2.0 AS w FROM e2
  UNION ALL SELECT doc_id, section, at0, size, ids, unnest(list_distinct(regexp_extract_all(lower(summary), '[a-z0-9]+'))), 0.5 FROM e2 UNION ALL SELECT doc_id, section, at0, size, ids, unnest(string_split(section, '_')), 1.0 FROM e2),
s AS (SELECT query_id, doc_id, at0, size, section, any_value(ids) AS ids, sum(w) AS score FROM wd JOIN q2 USING (word) GROUP BY query_id, doc_id, at0, size, section),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, at0, size, section) AS n FROM s) WHERE n <= 20),
o AS (SELECT query_id, doc_id, chunk_index, max(score) AS score, min(n) AS n FROM (SELECT query_id, doc_id, score, n, unnest(ids) AS chunk_index FROM t) GROUP BY ALL)
SELECT query_id, doc_id, chunk_index, score::double AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n, doc_id, chunk_index)::int AS rank FROM o) WHERE rank <= 10"""


def _tree_search(spark, d, newest):
    c = line_chunks(spark, d)
    q = table(spark, d, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return ix.tree_search(ix.section_tree(c), q, c, newest=newest)


@query(_tree_sql())
def r7_tree_search(spark, d):
    """Over the trees of all documents."""
    return _tree_search(spark, d, None)


@query(_tree_sql("doc_id IN (SELECT doc_id FROM c GROUP BY 1 ORDER BY 1 DESC LIMIT 50)"))
def r7_tree_search_newest(spark, d):
    """Over the newest 50 trees, which is what a search looks at unless told otherwise."""
    return _tree_search(spark, d, 50)


@query(f"""WITH {LINES}, e AS (SELECT doc_id, count(*) AS n, min(page) AS a, max(page) AS b FROM c GROUP BY 1 HAVING count(*) > 3),
g AS (SELECT doc_id, section, count(*) AS n, min(chunk_index) AS f, string_agg(printf('[Chunk %d, pages %d-%d]' || chr(10), chunk_index, page, page) || left(chunk_text, 2000), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY chunk_index) AS t,
  min(page) AS a, max(page) AS b FROM c SEMI JOIN e USING (doc_id) GROUP BY ALL HAVING count(*) >= 2),
one AS (SELECT doc_id, printf('L1_%04d', row_number() OVER (PARTITION BY doc_id ORDER BY f) - 1) AS node_id, section, n, length(t) AS chars, a, b FROM g)
SELECT doc_id, node_id, section, 1 AS level, n::int AS n_chunks, a AS page_start, b AS page_end, chars::int AS chars FROM one
UNION ALL SELECT doc_id, 'L2_0000', 'executive_summary', 2, e.n::int, e.a, e.b, (sum(length(printf('[%s | pages %d-%d]' || chr(10), CASE section WHEN 'risk_management' THEN 'Risk Management' WHEN 'outlook' THEN 'Outlook' ELSE 'Notes' END, one.a, one.b)) + chars) + 7 * (count(*) - 1))::int
FROM one JOIN e USING (doc_id) GROUP BY doc_id, e.n, e.a, e.b""")
def r8_rollups(spark, d):
    """Roll-ups whose summary is the whole text, by its length."""
    x = ix.rollup_summaries(line_chunks(spark, d), summarize=lambda t: t)
    return x.select("doc_id", "node_id", "section", "level", F.size("chunk_ids").alias("n_chunks"), "page_start", "page_end", F.length("summary").alias("chars"))


@query(f"""WITH {LINES}, m AS (SELECT doc_id, source AS symbol, 2015 + doc_id % 10 AS fiscal_year FROM documents), g AS (SELECT doc_id FROM c GROUP BY 1 HAVING count(*) > 3)
SELECT symbol, fiscal_year, max(doc_id) AS doc_id FROM m SEMI JOIN g USING (doc_id) GROUP BY ALL""")
def r17_document_summary(spark, d):
    """The newest document with a summary of each source and year."""
    meta = table(spark, d, "documents").select("doc_id", F.col("source").alias("symbol"), (2015 + F.col("doc_id") % 10).alias("fiscal_year"))
    return fl.document_summary(ix.rollup_summaries(line_chunks(spark, d)), meta).drop("summary")


@query(f"""WITH {LINES}, p AS (SELECT doc_id, page, string_agg(chunk_text, chr(10) ORDER BY chunk_index) AS text FROM c GROUP BY ALL),
h AS (SELECT doc_id, 'one' AS section, min(page) AS f FROM p WHERE contains(lower(text), 'the ') GROUP BY 1 UNION ALL SELECT doc_id, 'two', min(page) FROM p WHERE contains(lower(text), 'und ') GROUP BY 1)
SELECT h.doc_id, section, f AS first_page, string_agg(text, chr(10) ORDER BY page) AS text FROM h JOIN p ON p.doc_id = h.doc_id AND page BETWEEN f AND f + 3 GROUP BY ALL""")
def n16_section_ranges(spark, d):
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_text"))), lambda s: s["chunk_text"]), "\n")
    pages = line_chunks(spark, d).groupBy("doc_id", F.col("page_start").alias("page")).agg(text.alias("text"))
    return ix.section_ranges(pages, {"one": "the ", "two": "und "})


#: Headings that occur in the documents: frequent short words at the start of a line.
LINE_STARTS = (("opening", r"(?i)^(?:The|La|Die|El)\b"), ("outlook", r"(?i)^(?:And|Et|Und|Y)\b"), ("notes", r"(?i)^(?:Of|De|Von)\b"))


def _chunks(spark, d):
    kind = F.when(F.col("lang") == "en", "call").otherwise("report")
    return ix.chunk_documents(table(spark, d, "documents"), LINE_STARTS, kind, paragraph=r"\n")


@query()
def r3_chunks(spark, d):
    return _chunks(spark, d)


@query("SELECT doc_id, length(text)::bigint AS chars FROM documents WHERE length(text) > 0")
def r3_chunks_cover(spark, d):
    """Every character of a document is in one chunk."""
    return _chunks(spark, d).groupBy("doc_id").agg(F.sum(F.length("chunk_text")).alias("chars")).where("chars > 0")


@query("SELECT doc_id, length(text)::bigint AS chars, 0 AS first_start, length(text)::int AS last_end FROM documents WHERE length(text) > 0")
def r3_chunk_text_in_sql(spark, d):
    """The same chunks by the table function, in a lateral join."""
    register_chunk_text(spark, LINE_STARTS, paragraph=r"\n")
    table(spark, d, "documents").createOrReplaceTempView("tidemark_docs")
    return spark.sql("""SELECT doc_id, sum(length(c.chunk_text)) AS chars, min(c.char_start) AS first_start, max(c.char_end) AS last_end
      FROM tidemark_docs, LATERAL chunk_text(text, CASE WHEN lang = 'en' THEN 'call' ELSE 'report' END) AS c GROUP BY doc_id HAVING sum(length(c.chunk_text)) > 0""")


def _index(spark, d, least: int = 500) -> dict:
    """The stored index of all documents over so many characters, built by stages and read back."""
    docs = table(spark, d, "documents")
    meta = docs.select("doc_id", F.col("source").alias("symbol"), F.lit("Annual Report").alias("doc_type"), (2015 + F.col("doc_id") % 10).cast("string").alias("fiscal_year"), F.lit(None).cast("string").alias("quarter"), F.lit(None).cast("string").alias("company"))
    root, now = store.new_path(spark, "index"), docs.select("doc_id", "text", F.lit("1").alias("version"))
    stages = sg.document_stages(meta, least, headings=LINE_STARTS, paragraph=r"\n")
    sg.build(spark, root, now, {n: s for n, s in stages.items() if n != "keywords"})
    return {n: sg.read_stage(spark, root, n, now) for n in ("chunks", "trees", "rollups")}


@query()
def c11_build_index(spark, d):
    """Chunks of all documents over 500 characters with prefix and vector."""
    return _index(spark, d)["chunks"]


@query(f"""WITH {LINES}, c2 AS (SELECT c.*, length(chunk_text) AS chars FROM c), v AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '2' ELSE '1' END AS version FROM documents),
n AS (SELECT doc_id, count(*) AS n_chunks, sum(chars) AS chars, count(DISTINCT section) AS n_nodes FROM c2 GROUP BY 1),
g AS (SELECT doc_id, count(*) + 1 AS n_rollups FROM (SELECT doc_id, section FROM c2 GROUP BY ALL HAVING count(*) >= 2) JOIN n USING (doc_id) WHERE n_chunks > 3 GROUP BY 1)
SELECT v.doc_id, version, coalesce(n_chunks, 0)::bigint AS n_chunks, coalesce(chars, 0)::bigint AS chars, coalesce(n_nodes, 0)::bigint AS n_nodes, coalesce(n_rollups, 0)::bigint AS n_rollups FROM v LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)""")
def c11_staged_build(spark, d):
    """A build that stops after its first stage, goes on, and then takes a new version of every third document: what it has of each."""
    docs, root = table(spark, d, "documents"), store.new_path(spark, "index")
    lines = lambda rows: line_chunks(spark, d, rows)
    stages = {"chunks": (None, lines), "trees": ("chunks", ix.section_tree), "rollups": ("chunks", ix.rollup_summaries)}
    first = docs.withColumn("version", F.lit("1"))
    sg.build(spark, root, first, stages, until="chunks")
    sg.build(spark, root, first, stages)
    second = docs.withColumn("version", F.when(F.col("doc_id") % 3 == 0, "2").otherwise("1"))
    sg.build(spark, root, second, stages)
    rows = {n: sg.read_stage(spark, root, n, second) for n in stages}
    out = sg.ledger(spark, root, "rollups").join(second.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
    out = out.join(rows["chunks"].groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("chunk_text")).alias("chars")), "doc_id", "left")
    out = out.join(rows["trees"].select("doc_id", F.size("nodes").cast("long").alias("n_nodes")), "doc_id", "left").join(rows["rollups"].groupBy("doc_id").agg(F.count("*").alias("n_rollups")), "doc_id", "left")
    return out.fillna(0)


@query()
def r12_hybrid_search(spark, d):
    """Five lists for every benchmark item whose id is divisible by 100, over all documents with a text."""
    index = _index(spark, d, least=0)
    q = table(spark, d, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    vectors = ix.embed_chunks(q, "query", keys=["query_id"]).withColumnRenamed("embedding", "vector")
    passages = ix.embed_chunks(q.withColumn("query", F.concat(F.lit("Risks and outlook. "), "query")), "query", keys=["query_id"]).select("query_id", F.col("embedding").alias("vector"))
    return rt.hybrid_search(index, vectors, expansions=passages)
