"""Personal data in texts: pattern spans, and further candidates chosen by boosted trees.

Generators of high recall propose spans, which may overlap. The four base kinds keep every match that passes its own
check. The remaining candidates (obfuscated addresses, local phone numbers, identity numbers, credentials) are described
by format and context features and scored by gradient-boosted trees that learned from all candidates, but for a fifth of them,
which pass a strict check of their kind; the check itself is no feature. Thresholds by kind are
calibrated on the fifth that the trees did not see. The trees become a nested CASE expression, so scoring
is a projection: built-in functions only, no user function, and one scan of the texts.

Spans count code points, the end exclusive. Null or empty text has no spans. Rows are independent: repeated rows give
repeated results, and only the id and text columns are read. With too few candidates of either outcome nothing is learnt
and only base spans are returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, documents

#: Patterns of the base kinds, in an equivalent form that neither backtracks nor recurses on long runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds that only the trees may accept.
MORE = {
    "email_masked": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\))\x20?[a-z0-9-]{1,63}+\x20?(?:\[dot\]|\(dot\)|\.)\x20?[a-z]{2,24}",
    "phone_local": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?i)(?:password|passwd|secret|token|api[_-]?key)\x20?[=:]\x20?[^\s]{6,128}+",
}
KINDS = [*BASE, *MORE]
#: A word of this kind just before a span speaks for personal data.
HINTS = r"(?i)(mail|contact|phone|tel|call|fax|mobile|card|visa|iban|ssn|social|host|addr|login|user|pass|key|token)[^\n]{0,12}$"
PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
FEATURES = ("length", "digits", "letters", "others", "groups", "digit_share", "kinds_of_chars", "hinted", "joined_before", "joined_after", "first_digit", "fourth_digit", "last_part")
PRECISION = 0.98


def _found(text: Column, pieces: Column, matches: Column) -> Column:
    """Matches with their places: pieces are what a split by the same pattern leaves, so lengths add up to starts."""
    kind = "array<struct<start:int,end:int,v:string>>"
    step = lambda a, i: F.struct(
        (a["at"] + F.length(pieces[i]) + F.length(matches[i])).alias("at"),
        F.concat(
            a["out"],
            F.array(
                F.struct(
                    (a["at"] + F.length(pieces[i])).alias("start"),
                    (a["at"] + F.length(pieces[i]) + F.length(matches[i])).alias("end"),
                    matches[i].alias("v"),
                )
            ),
        ).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    walk = F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), start, step, lambda a: a["out"])
    return F.when((F.size(matches) > 0) & (F.size(pieces) > F.size(matches)), walk).otherwise(F.array().cast(kind))


def _luhn(digits: Column) -> Column:
    def term(i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(F.transform(places, term), F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _strict(kind: str, v: Column) -> Column:
    """The check of a kind: for a base kind that of its definition."""
    d = _digits(v)
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: v.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"),
        "card": lambda: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(F.lit(False)),
        "phone": lambda: F.length(d).between(9, 15),
        "email_masked": lambda: v.rlike(r"(?i)(com|org|net|edu|gov|io|de|fr|es|uk)$"),
        "phone_local": lambda: d.rlike("^[2-9][0-9]{2}[2-9]"),
        "ssn": lambda: ~d.rlike("^(000|666|9)|^[0-9]{3}00|0000$"),
        "secret": lambda: v.rlike("[=:].*[A-Za-z]") & v.rlike("[=:].*[0-9]") & (F.length(v) >= 16),
    }[kind]()


def _features(t: Column, x: Column) -> list[Column]:
    v, n = x["v"], F.length(x["v"]).cast("double")
    count = lambda p: n - F.length(F.regexp_replace(v, p, ""))
    has = lambda p: v.rlike(p).cast("double")
    before = F.substring(t, F.greatest(x["start"] - 31, F.lit(1)), F.least(x["start"], F.lit(32)))
    digit = lambda k: F.coalesce(F.substring(_digits(v), k, 1).try_cast("double"), F.lit(-1.0))
    near = lambda at: F.substring(t, at, F.lit(1)).rlike("[A-Za-z0-9_]").cast("double")
    return [
        n,
        count("[0-9]"),
        count("[A-Za-z]"),
        count("[^A-Za-z0-9]"),
        F.size(F.split(v, "[^A-Za-z0-9]+")).cast("double"),
        count("[0-9]") / n,
        has("[a-z]") + has("[A-Z]") + has("[0-9]") + has("[^A-Za-z0-9]"),
        before.rlike(HINTS).cast("double"),
        F.when(x["start"] > 0, near(x["start"])).otherwise(F.lit(0.0)),
        near(x["end"] + 1),
        digit(1),
        digit(4),
        F.length(F.regexp_extract(v, "([A-Za-z0-9]*)$", 1)).cast("double"),
    ]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): each row's candidates with kind, place, text, check result and features."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    patterns = BASE | MORE
    t = t.withColumns({f"_m_{k}": F.regexp_extract_all("_t", F.lit(p), F.lit(0)) for k, p in patterns.items()})
    none = F.array().cast("array<string>")
    t = t.withColumns(
        {f"_s_{k}": F.when(F.size(f"_m_{k}") > 0, F.split("_t", p, -1)).otherwise(none) for k, p in patterns.items()}
    )
    t = t.withColumns({f"_f_{k}": _found(F.col("_t"), F.col(f"_s_{k}"), F.col(f"_m_{k}")) for k in patterns})

    def rows(i: int, k: str) -> Column:
        found = F.col(f"_f_{k}")
        if k == "card":  # single numbers are no candidates
            found = F.filter(found, lambda x: F.length(_digits(x["v"])) >= 9)
        return F.transform(
            found,
            lambda x: F.struct(
                F.lit(i).alias("k"),
                x["start"].alias("start"),
                x["end"].alias("end"),
                _strict(k, x["v"]).alias("valid"),
                F.array(*_features(F.col("_t"), x)).alias("x"),
            ),
        )

    return t.select("doc_id", F.concat(*[rows(i, k) for i, k in enumerate(patterns)]).alias("found"))


def _tree(node, x: Column) -> Column:
    """A fitted tree as a CASE expression."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    left, right = _tree(node.leftChild(), x), _tree(node.rightChild(), x)
    return F.when(x[split.featureIndex()] <= float(split.threshold()), left).otherwise(right)


def fit_trees(found: DataFrame, trees: int = 12, depth: int = 3):
    """From all candidates: (score of a feature array as a Column function, least score by kind), or None. A fifth of them, by
    hash, is for the thresholds, the others are for the trees."""
    rows = found.select(F.explode("found").alias("c"), "doc_id").select(
        "c.k", "c.x", F.col("c.valid").cast("double").alias("label"), F.xxhash64("doc_id", "c.start", "c.k").alias("h")
    )
    rows = cut(rows, "pii-candidates")
    split = F.pmod("h", F.lit(5)) == 0
    fit = rows.where(~split)
    counts = {r["label"]: r["count"] for r in fit.groupBy("label").count().collect()}
    if min(counts.get(0.0, 0), counts.get(1.0, 0)) < 20:
        return None
    parts = fit.select("label", *[F.col("x")[i].alias(c) for i, c in enumerate(FEATURES)])
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(parts)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, subsamplingRate=1.0).fit(ready)
    pairs = list(zip(model.trees, model.treeWeights))

    def score(x: Column) -> Column:
        margin = reduce(lambda a, b: a + b, [w * _tree(t._java_obj.rootNode(), x) for t, w in pairs])
        return 1 / (1 + F.exp(-2 * margin))

    bins = (
        rows.where(split)
        .select("k", "label", F.floor(score(F.col("x")) * 100).cast("int").alias("bin"))
        .groupBy("k", "bin")
        .agg(F.count("*").alias("n"), F.sum("label").alias("good"))
        .collect()  # at most kinds x 101 rows
    )
    least = {}
    for k in range(len(KINDS)):
        n = good = 0
        for r in sorted((r for r in bins if r["k"] == k), key=lambda r: -r["bin"]):
            n, good = n + r["n"], good + r["good"]
            if good >= PRECISION * n:
                least[k] = r["bin"] / 100
    return score, least


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of (k, start, end) in order of kind and start; k indexes KINDS."""
    found = cut(candidates(docs, id_col, text_col), "pii")
    place = lambda c: F.struct(c["k"].alias("k"), c["start"].alias("start"), c["end"].alias("end"))
    base = F.transform(F.filter("found", lambda c: (c["k"] < len(BASE)) & c["valid"]), place)
    rows = found.select("doc_id", "found", base.alias("base"))
    trees = fit_trees(found)
    if trees is None or not any(k >= len(BASE) for k in trees[1]):
        return rows.select("doc_id", "base", F.col("base").alias("spans"))
    score, least = trees
    free = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    def accepted(c: Column) -> Column:
        level = reduce(lambda a, kv: F.when(c["k"] == kv[0], F.lit(kv[1])).otherwise(a), least.items(), F.lit(2.0))
        return (c["k"] >= len(BASE)) & (score(c["x"]) >= level) & free(c)

    more = F.transform(F.filter("found", accepted), place)
    return rows.select("doc_id", "base", F.concat("base", more).alias("spans"))


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["k"]], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """The rows of docs with the selected spans of the text replaced by a mark. Each distinct text is looked at once, by its hash, so
    rows that share an id, have none or are equal are all redacted, and no row is lost or doubled; null texts stay null."""
    keyed = docs.withColumn("_key", F.sha2(text_col, 256))
    found = pii_spans(keyed.select("_key", text_col).dropDuplicates(["_key"]), "_key", text_col)
    spans = found.select(F.col("doc_id").alias("_key"), F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).alias("_spans"))
    t = F.col(text_col)
    step = lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(
            s["start"] >= a["at"],
            F.concat(a["out"], F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)),
        ).otherwise(a["out"]).alias("out"),
    )
    done = F.aggregate(F.col("_spans"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    whole = F.concat(done["out"], F.substring(t, done["at"] + 1, F.length(t)))
    out = keyed.join(spans, "_key", "left")
    return out.withColumn(text_col, F.when(F.size("_spans") > 0, whole).otherwise(t)).select(*docs.columns)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii_spans(documents(spark, sf_dir))
    n = lambda i: F.size(F.filter("base", lambda s: s["k"] == i)).cast("long")
    return rows.select(
        "doc_id",
        *[n(i).alias(f"n_{k}") for i, k in enumerate(BASE)],
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
    )
