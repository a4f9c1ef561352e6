"""Rule-based quality filter: one projection of counts, compared with a threshold table.

Every count is a built-in expression over the row's own text, so the operator is a map without exchange or user
function. A text that is null or has no word has all counts 0 and fails. Rows are judged one by one: repeated rows
give repeated results, and only the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, SPACE, documents, words

SYMBOLS = r"[#*$%&|<>]"

#: Frequent function words of the four languages of the corpus (a parameter of the operator).
STOP_WORDS = (
    "the of and to in a is that it for on was be with as by this are at from or an not "
    "de la le et les des en un une que est pour dans sur pas par au du il ne ce qui "
    "der die das und von zu mit sich auf für ist nicht ein eine als auch es dem den im "
    "el los las y se del al lo por con su para como más no una"
).split()

#: Rule name, measure, least and greatest value (None: open). A text must meet every row.
THRESHOLDS: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("mean_word_length", "mean_word_length", 2.0, 15.0),
    ("symbols_per_char", "symbol_ratio", None, 0.05),
    ("stop_word_share", "stop_ratio", 0.02, None),
    ("repeated_line_share", "dup_line_ratio", None, 0.3),
    ("upper_case_share", "upper_ratio", None, 0.5),
)


def _measures() -> dict[str, Column]:
    share = lambda n, of: F.coalesce(F.try_divide(F.col(n).cast("double"), F.col(of)), F.lit(0.0))
    return {
        "mean_word_length": share("word_chars", "n_words"),
        "symbol_ratio": share("n_symbols", "word_chars"),
        "stop_ratio": share("n_stop", "n_words"),
        "dup_line_ratio": share("n_dup_lines", "n_lines"),
        "upper_ratio": share("n_upper", "word_chars"),
    }


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    thresholds=THRESHOLDS,
    stop_words=tuple(STOP_WORDS),
    min_words: int = 50,
) -> DataFrame:
    """Counts, base verdict, failed rule names and the final verdict of each row."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    t = t.withColumns(
        {
            "_w": words(F.col("_t")),
            "_l": F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD)),
            "word_chars": F.length(F.regexp_replace("_t", SPACE, "")).cast("long"),
            "n_symbols": (F.length("_t") - F.length(F.regexp_replace("_t", SYMBOLS, ""))).cast("long"),
            "n_upper": (F.length("_t") - F.length(F.regexp_replace("_t", "[A-ZÀ-ÖØ-Þ]+", ""))).cast("long"),
        }
    )
    w = F.col("_w")
    grams = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("g"), i.alias("i")),
    )
    t = t.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_stop": F.size(F.filter(w, lambda x: F.lower(x).isin(list(stop_words)))).cast("long"),
            "_g": F.when(F.size(w) >= 3, F.sort_array(grams)),
        }
    )
    g = F.col("_g")

    def same(k: Column, x: Column) -> Column:
        """Whether the window at place k of the order has the words of x; they are compared where the hashes meet."""
        y = F.get(g, k)
        words_ = [w[y["i"] + j] == w[x["i"] + j] for j in range(3)]
        return F.coalesce((y["g"] == x["g"]) & words_[0] & words_[1] & words_[2], F.lit(False))

    t = t.withColumn("_p", F.filter(g, lambda x, k: same(k - 1, x) | same(k + 1, x)))
    t = t.withColumn("_p", F.sort_array(F.transform("_p", lambda x: x["i"])))
    p = F.col("_p")
    covered = F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    t = t.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    t = t.withColumns(_measures())
    t = t.withColumn(
        "base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )
    broken = [
        F.when(
            (F.col(m) < low if low is not None else F.lit(False)) | (F.col(m) > high if high is not None else F.lit(False)),
            F.lit(rule),
        )
        for rule, m, low, high in thresholds
    ]
    t = t.withColumn("failed_rules", F.array_compact(F.array(*broken)))
    t = t.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    return t.drop("_t", "_w", "_l", "_g", "_p")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _sql() -> str:
    """The same rows in DuckDB."""
    stop = ", ".join(f"'{x}'" for x in STOP_WORDS)
    value = {
        "mean_word_length": "coalesce(word_chars::double / nullif(n_words, 0), 0)",
        "symbol_ratio": "coalesce(n_symbols::double / nullif(word_chars, 0), 0)",
        "stop_ratio": "coalesce(n_stop::double / nullif(n_words, 0), 0)",
        "dup_line_ratio": "coalesce(n_dup_lines::double / nullif(n_lines, 0), 0)",
        "upper_ratio": "coalesce(n_upper::double / nullif(word_chars, 0), 0)",
    }
    rules = [
        f"{value[m]} {op} {bound}"
        for _, m, low, high in THRESHOLDS
        for op, bound in ((">=", low), ("<=", high))
        if bound is not None
    ]
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
r AS (
  SELECT doc_id, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS q FROM g WHERE n > 1) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, len(w)::bigint AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
         (length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]+', '', 'g')))::bigint AS n_upper,
         len(l)::bigint AS n_lines, (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines,
         len(list_filter(w, lambda x: lower(x) IN ({stop})))::bigint AS n_stop,
         coalesce(n_repeat_words, 0)::bigint AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {" AND ".join(rules)} AS kept
FROM c"""


ORACLE_SQL = _sql()
