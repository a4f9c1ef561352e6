"""More queries over the test tables: screens, look-ups, trends, profiles and text rules (see registry.py)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as sc
from tidemark.functions import signals as sg
from tidemark.operators import portfolio as pf
from tidemark.operators import retrieval as rt
from tidemark.operators import screening as sn
from tidemark.operators import timeseries as ts
from tidemark.registry import BAD, GOOD, HOLD, PRESENT, PRICES, QUARTERS, company, holdings, prices, quarters, query, r, table

STOP = ["and", "the", "of", "in", "to", "is", "a"]
MOOD = f"round(coalesce((({PRESENT(GOOD)}) - ({PRESENT(BAD)}))::double / nullif(({PRESENT(GOOD)}) + ({PRESENT(BAD)}), 0), 0), 2)"


@query("SELECT doc_id, source FROM documents WHERE lang = 'en'")
def p1_metadata_filter(spark, d):
    return sn.metadata_filter(table(spark, d, "documents"), lang="en", source=None).select("doc_id", "source")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%R#0000000%' OR c_mktsegment ILIKE '%R#0000000%' ORDER BY c_custkey LIMIT 20")
def p2_keyword_lookup(spark, d):
    return sn.keyword_lookup(table(spark, d, "customer"), ["c_name", "c_mktsegment"], "R#0000000", "c_custkey").select("c_custkey", "c_name")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 500")
def p3_eligible_docs(spark, d):
    return sn.eligible_docs(table(spark, d, "documents")).select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::date >= DATE '1996-01-01'")
def p6_since(spark, d):
    return sn.since(table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date")), "day", "1998-01-01", years=2).select("o_orderkey")


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice >= 950 ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def p12_top_opportunities(spark, d):
    return sn.top_opportunities(table(spark, d, "part"), "p_retailprice", "p_partkey", 950.0).select("p_partkey", "p_retailprice")


@query("""WITH a AS (SELECT source, count(*) AS n_a FROM documents GROUP BY 1), b AS (SELECT source, count(*) AS n_b FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT source, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, coalesce(n_a, 0) >= 10 AND coalesce(n_b, 0) >= 30 AS complete FROM a FULL JOIN b USING (source)""")
def p13_fully_covered(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return sn.fully_covered(docs, docs.join(table(spark, d, "labels").select("doc_id"), "doc_id"), "source")


@query("""WITH l AS (SELECT o_custkey, o_orderkey, upper(o_orderpriority) AS symbol FROM orders), q AS (SELECT c_custkey, upper(left(c_mktsegment, 1)) AS q FROM customer),
k AS (SELECT c_custkey, o_orderkey, symbol, row_number() OVER (PARTITION BY c_custkey ORDER BY contains(symbol, q)::int DESC, o_orderkey) AS k FROM q JOIN l ON o_custkey = c_custkey)
SELECT c_custkey::varchar AS query, o_orderkey::varchar AS code, symbol FROM k WHERE k = 1""")
def j7_resolve_codes(spark, d):
    """Each customer looks for a code among the lines of own orders."""
    line = F.concat_ws("/", F.col("o_orderkey").cast("string"), F.lit("order"), "o_orderpriority", F.lit("A"))
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("t")))), lambda s: s["t"]).alias("lines"))
    c = table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", F.left("c_mktsegment", F.lit(1)).alias("query"), "lines")
    found = sn.resolve_codes(c.select("query", "lines", "c_custkey"), key="c_custkey")
    return found.select(F.col("c_custkey").cast("string").alias("query"), "code", "symbol")


@query("""SELECT c_custkey, round(coalesce(spent, 0), 2) AS score FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey""")
def j8_merge_ranking(spark, d):
    spent = table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("score"))
    return sn.merge_ranking(table(spark, d, "customer").select("c_custkey"), spent, "c_custkey").withColumn("score", r("score", 2))


@query(f"""WITH {PRICES}, a AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY d)::int AS pos, close FROM prices),
b AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY d)::int AS pos, close AS later FROM prices WHERE d >= DATE '1995-01-01')
SELECT symbol, pos, round(close, 4) AS close, round(later, 4) AS later FROM a JOIN b USING (symbol, pos)""")
def j11_align_by_position(spark, d):
    p = prices(spark, d)
    pairs = sn.align_by_position(p, p.where("d >= DATE '1995-01-01'").withColumnRenamed("close", "later"), "symbol", "d", ("close", "later"))
    return pairs.select("symbol", "pos", r("close", 4).alias("close"), r("later", 4).alias("later"))


@query("SELECT doc_id FROM documents SEMI JOIN labels USING (doc_id)")
def j13_existing_keys(spark, d):
    return sn.existing_keys(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"]).select("doc_id")


@query("""SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1""")
def a19_best_per_key(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return sn.best_per_key(li, ["l_partkey"], "l_extendedprice", "l_orderkey", "l_linenumber")


EVENTS = "ev AS (SELECT 'u' || (user_id % 20) AS symbol, ts, event_id, event_type, (value % 200) / 100.0 - 1 AS s FROM events)"


def _news(spark, d):
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("u"), F.col("user_id") % 20).alias("symbol"), "ts", "event_id", "event_type", (F.col("value") % 200 / 100.0 - 1).alias("s"))


@query(f"""WITH {EVENTS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS k FROM ev)
SELECT symbol, round(avg(s), 6) AS sentiment, count(*) AS n, arg_min(event_type, k) AS headline, CASE WHEN avg(s) > 0.2 THEN 'Bullish' WHEN avg(s) < -0.2 THEN 'Bearish' ELSE 'Neutral' END AS status FROM k WHERE k <= 5 GROUP BY 1""")
def a11_market_sentiment(spark, d):
    return sn.market_sentiment(_news(spark, d), "symbol", [F.desc("ts"), F.desc("event_id")], "s", "event_type").withColumn("sentiment", r("sentiment"))


@query("SELECT c_nationkey AS market, count(*) AS signups FROM customer GROUP BY 1")
def a16_signup_count(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("market")).agg(F.count("*").alias("signups"))


@query(f"""WITH s AS (SELECT source, doc_id, {MOOD} AS score FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS a, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS z FROM s),
g AS (SELECT source AS symbol, count(*) AS n, avg(score) FILTER (z <= 2) - avg(score) FILTER (a <= 2) AS delta FROM k GROUP BY 1)
SELECT symbol, n, round(delta, 6) AS delta, CASE WHEN n < 3 THEN 'insufficient' WHEN delta > 0.2 THEN 'improving' WHEN delta < -0.2 THEN 'declining' ELSE 'stable' END AS trend, round(least(1, abs(delta) / 0.5), 6) AS strength FROM g""")
def w11_sentiment_trend(spark, d):
    s = table(spark, d, "documents").select(F.col("source").alias("symbol"), "doc_id", sg.lexicon_sentiment(F.col("text"), GOOD, BAD).alias("score"))
    t = ts.sentiment_trend(s, "symbol", "doc_id", "score")
    return t.select("symbol", "n", r("delta").alias("delta"), "trend", r("strength").alias("strength"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, label AS symbol, vec_id, round(list_cosine_similarity(e::double[], embedding::double[]), 9) AS score FROM embeddings, q),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS h FROM s) WHERE h <= 30),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, symbol ORDER BY score DESC, vec_id) AS k FROM t WHERE score >= 0.1)
SELECT query_id, symbol, round(max(score), 6) AS best, string_agg(vec_id::varchar, ',' ORDER BY k) AS items FROM k WHERE k <= 3 GROUP BY ALL""")
def w13_market_topk(spark, d):
    e = table(spark, d, "embeddings")
    hits = rt.vector_search(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 30)
    top = sn.market_topk(hits.join(e.select("vec_id", F.col("label").alias("symbol")), "vec_id"), "symbol", "vec_id", 0.1)
    return top.select("query_id", "symbol", r("best").alias("best"), F.array_join("items", ",").alias("items"))


@query(f"""WITH {PRICES}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS k FROM prices)
SELECT symbol, round(arg_min(close, k), 4) AS newest, round(arg_max(close, k), 4) AS oldest, round((arg_min(close, k) / arg_max(close, k) - 1) * 100, 6) AS change FROM k WHERE k <= 7 GROUP BY 1""")
def w15_snapshot_trend(spark, d):
    return sn.snapshot_trend(prices(spark, d), "symbol", "d", "close").select("symbol", r("newest", 4).alias("newest"), r("oldest", 4).alias("oldest"), r("change").alias("change"))


@query(f"""WITH {QUARTERS}, y AS (SELECT symbol, fy, sum(revenue) AS revenue FROM qs GROUP BY ALL),
g AS (SELECT symbol, count(*) AS periods, arg_min(revenue, fy) AS f, arg_max(revenue, fy) AS l FROM y GROUP BY 1)
SELECT symbol, periods, round(f, 2) AS "first", round(l, 2) AS "last", round((l / f - 1) * 100, 6) AS change, round(CASE WHEN periods > 1 THEN (pow(l / f, 1.0 / (periods - 1)) - 1) * 100 END, 6) AS growth FROM g""")
def w17_revenue_trend(spark, d):
    y = quarters(spark, d).groupBy("symbol", "fy").agg(F.sum("revenue").alias("revenue"))
    t = sn.period_trend(y, "symbol", ["fy"], "revenue")
    return t.select("symbol", "periods", r("first", 2).alias("first"), r("last", 2).alias("last"), r("change").alias("change"), r("growth").alias("growth"))


@query(f"""WITH {HOLD}, m(symbol, sector) AS (VALUES ('AUTOMOBILE', 'Industry'), ('MACHINERY', 'Industry'), ('BUILDING', 'Industry'), ('HOUSEHOLD', 'Consumer')),
s AS (SELECT portfolio_id, coalesce(sector, 'Other') AS sector, sum(weight) AS w FROM hold LEFT JOIN m USING (symbol) GROUP BY ALL),
e AS (SELECT portfolio_id, count(*) AS sectors, max(w) AS w, arg_max(sector, (w, sector)) AS top FROM s GROUP BY 1),
h AS (SELECT portfolio_id, count(*) FILTER (weight > 15) AS heavy FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY weight DESC, symbol) AS k FROM hold) WHERE k <= 3 GROUP BY 1)
SELECT portfolio_id, sectors, round(w, 6) AS top_sector_weight, top AS top_sector, concat_ws(',', CASE WHEN w > 30 THEN 'sector_over_30' END, CASE WHEN heavy > 0 THEN 'holding_over_15' END, CASE WHEN sectors < 4 THEN 'few_sectors' END) AS warnings FROM e JOIN h USING (portfolio_id)""")
def c3_exposure_report(spark, d):
    e = pf.exposure_report(holdings(spark, d), company(spark))
    return e.select("portfolio_id", "sectors", r("top_sector_weight").alias("top_sector_weight"), "top_sector", "warnings")


@query(f"""WITH k AS (SELECT source AS symbol, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k FROM documents),
s AS (SELECT symbol, doc_id, {MOOD} AS score FROM k WHERE k <= 8 AND length(text) >= 1000), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY doc_id) AS a, row_number() OVER (PARTITION BY symbol ORDER BY doc_id DESC) AS z, lag(score) OVER (PARTITION BY symbol ORDER BY doc_id) AS b FROM s),
g AS (SELECT symbol, count(*) AS calls, avg(score) AS m, arg_max(score, doc_id) AS l, avg(score) FILTER (z <= 2) - avg(score) FILTER (a <= 2) AS delta, max(doc_id) FILTER (abs(score - b) > 0.4) AS shift_at, arg_max(score - b, doc_id) FILTER (abs(score - b) > 0.4) AS shift FROM n GROUP BY 1)
SELECT symbol, calls, round(m, 6) AS mean_score, round(l, 6) AS latest, CASE WHEN l > 0.3 THEN 'bullish' WHEN l > 0.1 THEN 'cautious' WHEN l > -0.1 THEN 'neutral' WHEN l > -0.3 THEN 'concerned' ELSE 'bearish' END AS tone,
  CASE WHEN calls < 3 THEN 'insufficient' WHEN delta > 0.2 THEN 'improving' WHEN delta < -0.2 THEN 'declining' ELSE 'stable' END AS trend, round(least(1, abs(delta) / 0.5), 6) AS strength, shift_at, round(shift, 6) AS shift FROM g""")
def c6_sentiment_report(spark, d):
    from tidemark.operators.views import sentiment_report

    calls = table(spark, d, "documents").select(F.col("source").alias("symbol"), F.col("doc_id").alias("d"), "text")
    x = sentiment_report(calls, GOOD, BAD)
    return x.select("symbol", "calls", "tone", "trend", "shift_at", *[r(c).alias(c) for c in ("mean_score", "latest", "strength", "shift")])


@query("""WITH k AS (SELECT source AS symbol, lower(text) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k FROM documents),
c AS (SELECT DISTINCT source || x AS symbol FROM documents, (VALUES (''), ('-new')) v(x)), j AS (SELECT c.symbol, t FROM c LEFT JOIN k ON k.symbol = c.symbol AND k = 1),
v AS (SELECT symbol, t, coalesce(10 * (contains(t, 'the ')::int + contains(t, 'und ')::int), 50) AS e, coalesce(10 * contains(t, 'que ')::int, 50) AS s, coalesce(11 * contains(t, 'les ')::int, 50) AS g FROM j)
SELECT symbol, e, s, g, trunc(e * 0.33 + s * 0.33 + g * 0.34)::int AS overall, 50 AS executive_pay, CASE WHEN t IS NULL THEN 'low' ELSE 'medium' END AS quality FROM v""")
def n4_esg_by_symbol(spark, d):
    from tidemark.operators.views import esg_by_symbol

    docs = table(spark, d, "documents").select(F.col("source").alias("symbol"), F.col("doc_id").alias("d"), "text")
    names = docs.select("symbol").distinct()
    companies = names.unionByName(names.select(F.concat("symbol", F.lit("-new")).alias("symbol")))
    return esg_by_symbol(companies, docs, ["the ", "und "], ["que "], ["les "])


@query("""SELECT user_id, n, n_purchase, n_error, array_to_string(list_slice(h, greatest(len(h) - 9, 1), len(h)), ',') AS active_hours, CASE WHEN n > 50 THEN 'high' WHEN n > 10 THEN 'medium' ELSE 'low' END AS engagement
FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS n_purchase, count(*) FILTER (event_type = 'error') AS n_error, list_sort(list(DISTINCT hour(ts))) AS h FROM events GROUP BY 1)""")
def c9_user_profiles(spark, d):
    p = sn.user_profiles(table(spark, d, "events"), "user_id", "ts", "event_type", ["purchase", "error"])
    return p.withColumn("active_hours", F.array_join("active_hours", ","))


@query("""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x NOT IN ('and', 'the', 'of', 'in', 'to', 'is', 'a')))), ',') AS keywords FROM conversations""")
def u3_keywords(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(sg.keywords(F.col("text"), STOP), ",").alias("keywords"))


_STARTS = " OR ".join(
    f"(regexp_matches(lower(trim(text)), '{start}')" + (f" AND NOT regexp_matches(lower(trim(text)), '{start}{behind}')" if behind else "") + ")" for start, behind in sg.FOLLOWUPS
)


@query(f"""WITH t AS (SELECT conv_id, turn, text, {_STARTS} AS followup,
  CASE WHEN role = 'user' THEN nullif(regexp_extract(text, '\\b(The[a-z]*)\\b', 1), '') END AS topic FROM conversations)
SELECT conv_id, turn, followup, topic, last_value(topic IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM t""")
def n12_followups(spark, d):
    c = table(spark, d, "conversations")
    topic = F.when(F.col("role") == "user", F.nullif(F.regexp_extract("text", r"\b(The[a-z]*)\b", 1), F.lit("")))
    t = c.select("conv_id", "turn", sg.is_followup(F.col("text")).alias("followup"), topic.alias("topic"))
    return sn.carry_forward(t, "conv_id", "turn", "topic", "carried")


@query(f"""SELECT doc_id, CASE WHEN g > b THEN 'positive' WHEN b > g THEN 'negative' ELSE 'neutral' END AS label, round((CASE WHEN g = b THEN 0 ELSE sign(g - b) * least(1.0, 0.5 + 0.1 * abs(g - b)) END)::double, 6) AS score, g::int AS good, b::int AS bad
FROM (SELECT doc_id, {PRESENT(GOOD)} AS g, {PRESENT(BAD)} AS b FROM documents)""")
def n3_headline_class(spark, d):
    h = table(spark, d, "documents").select("doc_id", sg.headline_class(F.col("text"), GOOD, BAD).alias("h"))
    return h.select("doc_id", "h.label", r("h.score").alias("score"), "h.good", "h.bad")


@query("""WITH c AS (SELECT doc_id, source, doc_id // 6 AS call, CASE lang WHEN 'en' THEN 'transcript' WHEN 'de' THEN 'ai_summary' ELSE 'ppt' END AS kind FROM documents),
t AS (SELECT *, count(*) FILTER (kind = 'transcript') OVER (PARTITION BY source, call) AS n FROM c)
SELECT doc_id, source, call, kind FROM t WHERE kind IN ('transcript', 'ppt') OR (kind = 'ai_summary' AND n = 0)""")
def r16_select_call_docs(spark, d):
    """Documents stand for calls, their language for the kind."""
    kind = F.when(F.col("lang") == "en", "transcript").when(F.col("lang") == "de", "ai_summary").otherwise("ppt")
    c = table(spark, d, "documents").select("doc_id", "source", F.floor(F.col("doc_id") / 6).alias("call"), kind.alias("kind"))
    return sn.select_call_docs(c, ["source", "call"])


@query("""WITH a AS (SELECT event_id, 'u' || (user_id % 20) AS symbol, ts, (value % 200) / 100.0 - 1 AS s FROM events)
SELECT event_id, symbol, round(s, 6) AS sentiment FROM a WHERE s <= -0.3 OR s >= 0.5 ORDER BY ts DESC, event_id DESC LIMIT 20""")
def x5_recent_alerts(spark, d):
    a = _news(spark, d).where("s <= -0.3 OR s >= 0.5").orderBy(F.desc("ts"), F.desc("event_id")).limit(20)
    return a.select("event_id", "symbol", r("s").alias("sentiment"))


@query("""SELECT p_partkey, CASE WHEN (p_retailprice - s) / s * 100 > 20 THEN 'premium' WHEN (p_retailprice - s) / s * 100 < -20 THEN 'discount' ELSE 'in_line' END AS band
FROM (SELECT *, avg(p_retailprice) OVER (PARTITION BY p_brand) AS s FROM part)""")
def f18_pe_band(spark, d):
    p = table(spark, d, "part").withColumn("s", F.avg("p_retailprice").over(Window.partitionBy("p_brand")))
    return p.select("p_partkey", sc.pe_band(F.col("p_retailprice"), F.col("s")).alias("band"))
