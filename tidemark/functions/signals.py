"""Lexicon and rule signals over texts, as Column -> Column; word lists are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(text: Column, words: list[str]) -> Column:
    """How many of the words occur in the text at all."""
    t = F.lower(text)
    return reduce(lambda a, b: a + b, [F.coalesce(t.contains(w), F.lit(False)).cast("int") for w in words])


def lexicon_sentiment(text: Column, good: list[str], bad: list[str]) -> Column:
    """(good - bad) / (good + bad) by presence, to two places; 0 if neither occurs."""
    g, b = present(text, good), present(text, bad)
    return F.round(F.coalesce(F.try_divide((g - b).cast("double"), (g + b).cast("double")), F.lit(0.0)), 2)


def tone(score: Column) -> Column:
    return (
        F.when(score > 0.3, "bullish").when(score > 0.1, "cautious").when(score > -0.1, "neutral").when(score > -0.3, "concerned").otherwise("bearish")
    )


def headline_sentiment(text: Column, good: list[str], bad: list[str]) -> Column:
    """0.2 up or down per word present, within -1 and 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.2 * (present(text, good) - present(text, bad))))


def esg_score(text: Column, environment: list[str], social: list[str], governance: list[str]) -> Column:
    """struct<e, s, g, overall, executive_pay, quality>: 10, 10 and 11 points per word present, at most 100; without text 50
    each and quality low; executive pay is always 50."""
    e = F.least(F.lit(100), 10 * present(text, environment))
    s = F.least(F.lit(100), 10 * present(text, social))
    g = F.least(F.lit(100), 11 * present(text, governance))
    pick = lambda x: F.when(text.isNull(), F.lit(50)).otherwise(x)
    overall = (pick(e) * 0.33 + pick(s) * 0.33 + pick(g) * 0.34).cast("int")
    quality = F.when(text.isNull(), "low").otherwise("medium")
    return F.struct(pick(e).alias("e"), pick(s).alias("s"), pick(g).alias("g"), overall.alias("overall"), F.lit(50).alias("executive_pay"), quality.alias("quality"))


def classify_scope(text: Column, blocked: list[str], probe: str, topics: list[str], general: str) -> Column:
    """Ordered layers: blocked word, probing pattern, two topics allow, too short, general question, else allow."""
    t = F.lower(F.coalesce(text, F.lit("")))
    n_topics, n_words = present(t, topics), F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return (
        F.when(present(t, blocked) > 0, "blocked_keyword")
        .when(t.rlike(probe), "probe")
        .when(n_topics >= 2, "allowed_topics")
        .when((n_words < 3) & (n_topics == 0), "too_short")
        .when(t.rlike(general) & (n_topics == 0), "general_question")
        .otherwise("allowed")
    )


def extract_tickers(text: Column, aliases: dict[str, str], allowed: list[str], most: int = 5) -> Column:
    """Symbols by alias in the order of the list, then upper-case words of the allow-list; distinct, at most so many."""
    t = F.lower(text)
    named = F.array_compact(F.array(*[F.when(t.contains(a), F.lit(s)) for a, s in aliases.items()]))
    upper = F.filter(F.regexp_extract_all(text, F.lit(r"\b[A-Z][A-Z0-9&]{1,11}\b"), F.lit(0)), lambda w: w.isin(allowed))
    return F.slice(F.array_distinct(F.concat(named, upper)), 1, most)


#: Families of a comparison, and words that make "x and y" one.
COMPARISON = {
    "versus": ["vs", "versus", "vs."],
    "comparison": ["compare", "comparison", "comparing"],
    "which_better": ["which is better", "which one", "should i choose", "better investment"],
    "difference": ["difference between"],
}
PAIR_WORDS = ["stock", "invest", "buy", "compare", "both"]
#: What a question about figures asks for, in order.
ANALYSIS = {
    "segment_breakdown": ["segment", "breakdown", "division", "by business", "revenue mix", "business mix", "contribution", "o2c", "retail", "jio", "digital", "oil and gas", "refining"],
    "quarterly_comparison": ["quarter", "qoq", "q-o-q", "q1", "q2", "q3", "q4", "sequential"],
    "revenue_trend": ["revenue trend", "revenue growth", "revenue over", "sales trend", "sales growth", "topline"],
    "margin_trend": ["margin trend", "margin over time", "margin history", "margin guidance", "margins changing", "profitability"],
    "peer_comparison": ["compare", "vs", "versus", "peers", "competitors", "relative to", "better than", "worse than", "industry"],
    "valuation_gauge": ["valuation", "expensive", "cheap", "undervalued", "overvalued", "pe ratio", "trading at", "fairly valued"],
}
#: Words of a question that ask for peers, or for management and risks.
VALUE_WORDS = ["undervalued", "overvalued", "cheap", "expensive", "valuation", "pe", "price"]
ACTION_WORDS = ["buy", "sell", "invest", "hold", "should"]


def first_family(text: Column, families: dict[str, list[str]]) -> Column:
    """The first family with a word in the text; null without one."""
    return F.coalesce(*[F.when(present(text, words) > 0, F.lit(name)) for name, words in families.items()])


def comparison_intent(text: Column, families: dict[str, list[str]] = COMPARISON, pair: list[str] = PAIR_WORDS) -> Column:
    """versus, comparison, which_better, difference, and_pattern, or null: by parts of words, in this order."""
    both = F.lower(text).contains(" and ") & (present(text, pair) > 0)
    return F.coalesce(first_family(text, families), F.when(both, "and_pattern"))


def analysis_intent(text: Column, families: dict[str, list[str]] = ANALYSIS) -> Column:
    """The chart that answers a question, or null."""
    return first_family(text, families)


def decompose_query(text: Column, symbol: Column) -> Column:
    """Sub-questions about a symbol: valuation always, peers, management and risks by the words of the question, news last."""
    ask = lambda template: F.format_string(template, symbol)
    value, action = present(text, VALUE_WORDS) > 0, present(text, ACTION_WORDS) > 0
    return F.array_compact(
        F.array(
            ask("PE of %s against its five-year average?"),
            F.when(value, ask("PE of %s against its sector, and why?")),
            F.when(action, ask("Outlook and guidance of %s in the last call?")),
            F.when(action, ask("Main risks of %s?")),
            ask("Recent news and catalysts of %s?"),
        )
    )


#: Words of a question for which a source is most relevant, its relevance then and otherwise.
RELEVANCE = {
    "technical": (["buy", "sell", "should", "invest", "entry", "exit", "technical", "trend", "dma", "rsi"], 0.9, 0.5),
    "market": (["price", "limit", "trading", "value", "market cap", "pe ratio"], 0.9, 0.6),
    "filings": (["result", "quarterly", "profit", "revenue", "earnings", "financial", "guidance", "margin", "trend"], 0.95, 0.7),
}


def source_relevance(text: Column, source: str) -> Column:
    """How relevant a source is for a question, by its words."""
    words, high, low = RELEVANCE[source]
    return F.when(present(text, words) > 0, high).otherwise(low)


def detect_style(text: Column, markers: list[str]) -> Column:
    """struct<mixed, devanagari>: a marker word of mixed language, and signs of the Devanagari script."""
    return F.struct((present(text, markers) > 0).alias("mixed"), text.rlike("[ऀ-ॿ]").alias("devanagari"))


def sanitize_response(text: Column, patterns: list[str], notes: dict[str, str], query: Column) -> Column:
    """Drops the patterns, then appends the note of each trigger in the query, once."""
    out = reduce(lambda a, p: F.regexp_replace(a, p, ""), patterns, text)
    for trigger, note in notes.items():
        out = F.when(F.lower(query).contains(trigger) & ~out.contains(note), F.concat(out, F.lit("\n\n" + note))).otherwise(out)
    return F.trim(out)


def headline_class(text: Column, good: list[str], bad: list[str]) -> Column:
    """struct<label, score, good, bad>: the side with more words present, 0.5 and 0.1 for each of the difference."""
    g, b = present(text, good), present(text, bad)
    size = F.least(F.lit(1.0), 0.5 + 0.1 * F.abs(g - b))
    label = F.when(g > b, "positive").when(b > g, "negative").otherwise("neutral")
    return F.struct(label.alias("label"), F.when(g > b, size).when(b > g, -size).otherwise(F.lit(0.0)).alias("score"), g.alias("good"), b.alias("bad"))


def keywords(text: Column, stop: list[str]) -> Column:
    """Distinct terms of a text without stop words, sorted."""
    t = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.sort_array(F.array_except(t, F.array(*[F.lit(w) for w in stop])))


#: How a question begins that leans on an earlier one, and what must not follow.
FOLLOWUPS = (
    ("^(what about|how about|and|also|its|their|the same)", None),
    ("^(tell me more|more on|expand on|elaborate)", None),
    ("^(compare|vs|versus)", r"\s+\w+\s+(and|vs|versus)"),
    ("^(why|when|how)", r"\s+(is|are|does|do)\s+\w+"),
)


def is_followup(text: Column) -> Column:
    """A question that leans on an earlier one."""
    t, out = F.lower(F.trim(text)), F.lit(False)
    for start, behind in FOLLOWUPS:
        out = out | t.rlike(start + (f"(?!{behind})" if behind else ""))
    return out


def false_unavailable(text: Column, price: Column) -> Column:
    """Whether a text calls a price unavailable that is known."""
    return F.lower(text).rlike("price.*(?:unavailable|not available|data missing)") & price.isNotNull() & (price > 0)


#: Labels of an analyst's text in the order in which they are looked for.
ANALYST_LABELS = {"Very Bullish": 0.9, "Bullish": 0.5, "Neutral": 0.0, "Cautious": -0.3, "Bearish": -0.7}


def label_sentiment(text: Column, labels: dict[str, float] = ANALYST_LABELS) -> Column:
    """The sentiment of the first label (in the order of the labels) that a text holds, 0 without one."""
    return F.coalesce(*[F.when(text.contains(k), F.lit(v)) for k, v in labels.items()], F.lit(0.0))


def fact_check(text: Column, year: int) -> Column:
    """Past years (2010 on) that stand within 30 characters of a word of the future, sorted."""
    t = F.lower(text)
    years = F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b(20[12]\d)\b"), F.lit(1)))

    def near(y: Column) -> Column:
        at = F.instr(t, y)
        start = F.greatest(at - 30, F.lit(1))
        return F.substring(t, start, at + 30 - start).rlike("projected|estimated|forecast|future")

    return F.sort_array(F.filter(years, lambda y: (y.cast("int") < year) & near(y)))


def bullet_points(text: Column, most: int = 10) -> Column:
    """Lines that start with a dash, without it."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.trim(s))
    return F.slice(F.transform(F.filter(lines, lambda s: s.startswith("-")), lambda s: F.trim(F.regexp_replace(s, r"^-+", ""))), 1, most)


def analyst_score(text: Column) -> Column:
    """The number after 'Score:' kept within 1 and 10, as -0.8 to 1."""
    n = F.regexp_extract(text, r"(?i)score:\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    return (F.greatest(F.lit(1.0), F.least(F.lit(10.0), n)) - 5) / 5
