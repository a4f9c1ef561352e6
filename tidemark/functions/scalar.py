"""Scalar functions of filings and market data, as Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_float(c: Column, strip: bool = True) -> Column:
    """A number from text; null, '' and '-' give null; commas and percent signs are dropped if strip."""
    t = F.trim(F.regexp_replace(c, "[,%]", "")) if strip else F.trim(c)
    return t.try_cast("double")


def safe_int(c: Column) -> Column:
    """The number in a text, without its fraction."""
    return F.trim(c).try_cast("double").try_cast("long")


def parse_date(c: Column) -> Column:
    """The first of d/m/Y, d-m-Y, Y-m-d, 'd Mon Y' that fits, else an ISO date inside the text."""
    t = F.trim(c)
    tried = [F.try_to_timestamp(t, F.lit(f)).cast("date") for f in ("d/M/yyyy", "d-M-yyyy", "yyyy-M-d", "d MMM yyyy")]
    inside = F.nullif(F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")).try_cast("date")
    return F.coalesce(*tried, inside)


def fiscal_year(d: Column) -> Column:
    """April starts a fiscal year, named by the calendar year in which it ends."""
    return F.year(d) + (F.month(d) >= 4).cast("int")


def fiscal_quarter(d: Column) -> Column:
    return F.concat(F.lit("Q"), F.pmod(F.floor((F.month(d) - 4) / 3), F.lit(4)) + 1)


def fiscal_year_of_text(c: Column) -> Column:
    """Fiscal year of 'Mon YYYY' or D/M/Y texts, else a year in the text, else 'Unknown'."""
    months = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    name = F.lower(F.regexp_extract(c, r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?,?\s+(\d{4})", 1))
    named_year = F.regexp_extract(c, r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?,?\s+(\d{4})", 2).try_cast("int")
    month = F.array_position(F.array(*[F.lit(m) for m in months]), name)
    dm = F.regexp_extract(c, r"\b\d{1,2}/(\d{1,2})/(\d{4})\b", 1).try_cast("int")
    dy = F.regexp_extract(c, r"\b\d{1,2}/(\d{1,2})/(\d{4})\b", 2).try_cast("int")
    plain = F.nullif(F.regexp_extract(c, r"((?:19|20)\d{2})", 1), F.lit(""))
    return F.coalesce(
        F.when(name != "", (named_year + (month >= 4).cast("int")).cast("string")),
        F.when(dm.isNotNull(), (dy + (dm >= 4).cast("int")).cast("string")),
        plain,
        F.lit("Unknown"),
    )


def strip_markup(c: Column) -> Column:
    """Plain text of HTML; null for under 50 characters in or up to 20 out."""
    t = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<\?.*?\?>", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(t, r"[-_=]{10,}", "")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when((F.length(c) >= 50) & (F.length(t) > 20), t)


def two_places(x: Column) -> Column:
    """A text with two decimals. As in C and Python the binary value decides: a number that is written with a 5 in the third
    place goes to the side on which its binary value lies, and to the even place only if it is exactly between."""
    half = F.round(x * 200)  # odd: between two places
    high = x * 134217729.0 - (x * 134217729.0 - x)  # x in two parts of half as many bits, so that products are exact
    over = (high * 200 - half) + (x - high) * 200
    up = (over > 0) | ((over == 0) & (F.pmod(half + 1, F.lit(4.0)) == 0))
    between = (F.pmod(half, F.lit(2.0)) == 1) & (half / 200 == x)
    return F.format_string("%.2f", F.when(between, F.when(up, half + 1).otherwise(half - 1) / 200).otherwise(x))


def format_indian_number(x: Column) -> Column:
    """Rupees in crore (Cr), lakh (L) or with commas; null and 0 give a plain zero."""
    a = F.abs(x)
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    body = (
        F.when(a >= 1e7, F.concat(two_places(a / 1e7), F.lit(" Cr")))
        .when(a >= 1e5, F.concat(two_places(a / 1e5), F.lit(" L")))
        .otherwise(F.format_number(a, 0))
    )
    return F.when(x.isNull() | (x == 0), F.lit("₹0")).otherwise(F.concat(sign, F.lit("₹"), body))


def capital_gains_tax(buy: Column, sell: Column, quantity: Column, days: Column) -> Column:
    """struct<gain, tax, net, long_term>: 12.5 % over 125,000 beyond a year, else 20 %; no tax on a loss."""
    gain = (sell - buy) * quantity
    long_term = days > 365
    tax = F.when(gain <= 0, F.lit(0.0)).when(long_term, F.greatest(gain - 125000, F.lit(0.0)) * 0.125).otherwise(gain * 0.20)
    return F.struct(gain.alias("gain"), tax.alias("tax"), (gain - tax).alias("net"), long_term.alias("long_term"))


def action_id(kind: Column, title: Column, date: Column) -> Column:
    return F.concat(F.lit("action://"), F.left(F.md5(F.concat_ws("-", title, date, kind)), F.lit(12)))


def clean_ticker(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(c)), r"\.(NS|BO)$", "")


def market_session(ts: Column) -> Column:
    """weekend, pre_open (9:00), open (9:15 to 15:30) or closed."""
    minute = F.hour(ts) * 60 + F.minute(ts) + F.second(ts) / 60
    return (
        F.when(F.dayofweek(ts).isin(1, 7), "weekend")
        .when((minute >= 540) & (minute < 555), "pre_open")
        .when((minute >= 555) & (minute <= 930), "open")
        .otherwise("closed")
    )


def valuation_status(pe: Column, sector_pe: Column) -> Column:
    discount = F.try_divide(sector_pe - pe, sector_pe) * 100
    return F.when(discount > 10, "Undervalued").when(discount < -10, "Premium").when(discount.isNotNull(), "Fair Value")


def valuation_discount(pe: Column, sector_pe: Column) -> Column:
    """How far a PE stands under its sector's, in %, to one place."""
    return F.bround(F.try_divide(sector_pe - pe, sector_pe) * 100, 1)


def price_to_book(price: Column, book: Column) -> Column:
    return F.when((price != 0) & (book > 0), F.try_divide(price, book))


def risk_score(volatility: Column, drawdown: Column, beta: Column, var95: Column) -> Column:
    """1 to 10 from annual volatility %, drawdown %, beta and VaR %; rounded half to even."""
    ten = F.lit(10.0)
    raw = (
        0.3 * F.least(volatility / 5, ten) + 0.3 * F.least(drawdown / 10, ten) + 0.2 * F.least(beta * 5, ten) + 0.2 * F.least(var95 / 0.5, ten)
    )
    return F.greatest(F.lit(1), F.least(F.lit(10), F.bround(raw, 0).cast("int")))


def risk_label(score: Column) -> Column:
    return F.when(score <= 3, "Low").when(score <= 5, "Moderate").when(score <= 7, "High").otherwise("Very High")


def insider_role(title: Column, mode: str = "word") -> Column:
    """The first role that a title holds: as a word, or ('reference') as any part of it."""
    roles = (  # fixed values
        ("CEO", ("chief executive", "ceo", "president")),
        ("CFO", ("chief financial", "cfo", "treasurer")),
        ("COO", ("chief operating", "coo")),
        ("CTO", ("chief technology", "cto")),
        ("Director", ("director", "board")),
        ("VP", ("vice president", "vp")),
        ("10% Owner", ("10%", "beneficial owner")),
    )
    t, out = F.lower(title), None
    for role, parts in roles:
        if mode == "reference":
            hit = F.lit(False)
            for p in parts:
                hit = hit | t.contains(p)
        else:
            hit = t.rlike("(?<!vice )" + r"\b(" + "|".join(parts) + ")") if role == "CEO" else t.rlike(r"\b(" + "|".join(parts) + ")")
        out = F.when(hit, role) if out is None else out.when(hit, role)
    return out.otherwise("Officer")


def pad_vector(v: Column, size: int) -> Column:
    return F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(size) - F.size(v), F.lit(0))))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is null, empty of length, or of another size."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(dot(a, b), norm), F.lit(0.0))).otherwise(F.lit(0.0))


def blank_to(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def clean_text(c: Column) -> Column:
    """Without NUL signs, white space runs as one space."""
    return F.trim(F.regexp_replace(F.replace(c, F.lit("\x00"), F.lit("")), r"\s+", " "))


def build_url(c: Column, prefix: str) -> Column:
    """An absolute link as it is; a path of 15 characters or more, with a folder and a file name with a point, under the
    prefix; else ''."""
    path = F.ltrim(c, F.lit("/"))
    whole = F.rtrim(path, F.lit("/"))
    ok = (F.length(path) >= 15) & whole.contains("/") & F.substring_index(whole, "/", -1).contains(".")
    return F.when(c.startswith("http"), c).when(ok, F.concat(F.lit(prefix.rstrip("/") + "/"), path)).otherwise(F.lit(""))


def to_crore(x: Column) -> Column:
    """Rupees in crore to two places; NaN gives null."""
    return F.round(F.nanvl(x.cast("double"), F.lit(None).cast("double")) / 1e7, 2)


def pe_band(pe: Column, sector_pe: Column, band: float = 20.0) -> Column:
    premium = F.try_divide(pe - sector_pe, sector_pe) * 100
    return F.when(premium > band, "premium").when(premium < -band, "discount").when(premium.isNotNull(), "in_line")


def derived_metrics(profit: Column, equity: Column, debt: Column, cash_flow: Column) -> Column:
    """struct<roe, debt_to_equity, cash_conversion>: null where a part is null or zero."""
    share = lambda a, b: F.when((a != 0) & (b != 0), F.try_divide(a, b))
    return F.struct(
        F.bround(share(profit, equity) * 100, 2).alias("roe"), F.bround(share(debt, equity), 2).alias("debt_to_equity"), F.bround(share(cash_flow, profit), 2).alias("cash_conversion")
    )


def meeting_type(title: Column) -> Column:
    return F.when(F.upper(title).rlike(r"A\.G\.M|AGM"), "AGM").otherwise("EGM")


def company_of_title(title: Column) -> Column:
    """What stands before ' Annual'."""
    return F.trim(F.regexp_replace(title, r"(?s) Annual.*$", ""))


def insider_name(text: Column) -> Column:
    return F.left(F.trim(F.regexp_replace(F.substring_index(text, "(", -1), r"\)", "")), F.lit(50))


def format_market_cap(crores: Column) -> Column:
    """Crores in lakh crore (L Cr), thousand crore (K Cr) or crore; null and 0 give N/A."""
    body = F.when(crores >= 100_000, F.concat(F.lit("₹"), two_places(crores / 100_000), F.lit(" L Cr"))).when(crores >= 1000, F.concat(F.lit("₹"), two_places(crores / 1000), F.lit("K Cr")))
    return F.when(crores.isNull() | (crores == 0), F.lit("N/A")).otherwise(body.otherwise(F.format_string("₹%.0f Cr", F.bround(crores))))


#: States of trading that call for a warning, and how grave they are.
CIRCUITS = {
    "UPPER_CIRCUIT": "warn: upper circuit, avoid buying", "LOWER_CIRCUIT": "warn: lower circuit, selling pressure",
    "ASM_STAGE_1": "warn: surveillance stage 1, higher margins", "ASM_STAGE_2": "severe: surveillance stage 2",
    "GSM_STAGE_1": "warn: graded surveillance stage 1, trade on Fridays", "GSM_STAGE_2": "severe: graded surveillance stage 2, limited trading",
    "TRADING_HALTED": "halt: no transactions",
}


def circuit_warning(status: Column) -> Column:
    """The warning of a trading state; null for a normal or unknown one."""
    table = F.create_map(*[F.lit(x) for kv in CIRCUITS.items() for x in kv])
    return F.try_element_at(table, status)


def premium(pe: Column, base: Column) -> Column:
    return (F.try_divide(pe, base) - 1) * 100


def range_position(price: Column, low: Column, high: Column) -> Column:
    """Where a price stands between low and high, in %; 50 if they are equal."""
    return F.when(high == low, F.lit(50.0)).otherwise(F.try_divide(price - low, high - low) * 100)


def valuation_insight(pe: Column, sector_pe: Column, hist_pe: Column, price: Column, low: Column, high: Column) -> Column:
    """Codes of what a valuation says against the sector (30, -20), the own history (20, -20; 22 if unknown) and the range of a
    year (25, 75)."""
    of_sector, of_past, at = premium(pe, sector_pe), premium(pe, F.coalesce(hist_pe, F.lit(22.0))), range_position(price, low, high)
    return F.array_compact(
        F.array(
            F.when(of_sector > 30, "sector_premium").when(of_sector < -20, "sector_discount").when(of_sector.isNotNull(), "sector_in_line"),
            F.when(of_past < -20, "below_history").when(of_past > 20, "above_history"),
            F.when(at < 25, "near_low").when(at > 75, "near_high"),
        )
    )


def historical_context(price: Column, low: Column, high: Column, cagr: Column, pe: Column, sector_pe: Column) -> Column:
    """Codes of the range of a year (25, 75), the growth of ten years (15, 8) and the PE against the sector (-15, 30)."""
    at, of_sector = F.when(high != low, range_position(price, low, high)), F.when(sector_pe > 0, premium(pe, sector_pe))
    return F.array_compact(
        F.array(
            F.when(at < 25, "range_low").when(at > 75, "range_high").when(at.isNotNull(), "range_mid"),
            F.when(cagr > 15, "growth_strong").when(cagr > 8, "growth_decent").when(cagr.isNotNull(), "growth_modest"),
            F.when(of_sector < -15, "sector_discount").when(of_sector > 30, "sector_premium"),
        )
    )


#: Names under which a yearly figure is found, in order.
ANNUAL = {"revenue_cr": ("Revenue", "Total Revenue", "revenue"), "net_profit_cr": ("Net Profit", "PAT", "net_profit"), "ebitda_cr": ("EBITDA", "ebitda")}


def annual_metrics(metrics: Column) -> Column:
    """struct<revenue_cr, net_profit_cr, ebitda_cr> of a map of texts; 0 where there is none."""
    pick = lambda names: F.coalesce(*[safe_float(F.try_element_at(metrics, F.lit(n))) for n in names], F.lit(0.0))
    return F.struct(*[pick(names).alias(c) for c, names in ANNUAL.items()])


def parse_price(c: Column) -> Column:
    """The price in a text or in JSON {"NSE": .., "BSE": ..}, the first exchange first; 0 for what is no number."""
    found = F.coalesce(F.get_json_object(c, "$.NSE"), F.get_json_object(c, "$.BSE"), c)
    return F.coalesce(F.trim(F.replace(found, F.lit(","), F.lit(""))).try_cast("double"), F.lit(0.0))


def fiscal_quarter_of_text(c: Column) -> Column:
    """Q1 to Q4 of 'Mon YYYY' or D/M/Y texts, else 'Unknown'."""
    months = "jan feb mar apr may jun jul aug sep oct nov dec".split()
    name = F.lower(F.regexp_extract(c, r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?,?\s+\d{4}", 1))
    month = F.nullif(F.array_position(F.array(*[F.lit(m) for m in months]), name).cast("int"), F.lit(0))
    month = F.coalesce(month, F.regexp_extract(c, r"\b\d{1,2}[-/](\d{1,2})[-/]\d{4}\b", 1).try_cast("int"))
    quarter = F.pmod(F.floor((month - 4) / 3), F.lit(4)) + 1
    return F.coalesce(F.concat(F.lit("Q"), quarter.cast("string")), F.lit("Unknown"))


def status_band(x: Column, bands: list[tuple[float, str]], beyond: str) -> Column:
    """The label of the first bound that a value does not exceed."""
    out = None
    for bound, label in bands:
        out = F.when(x <= bound, label) if out is None else out.when(x <= bound, label)
    return out.when(x.isNotNull(), beyond)


def context_prefix(symbol: Column, doc_type: Column, year: Column, quarter: Column, section: Column, company: Column, page_start: Column, page_end: Column, descriptions: dict[str, str] | None = None) -> Column:
    """One sentence on where a chunk comes from: company, document, period, section and pages; parts that are null are left out."""
    who = F.when(company.isNotNull(), F.format_string("%s (%s)", symbol, company)).otherwise(symbol)
    label = F.initcap(F.replace(section, F.lit("_"), F.lit(" ")))
    table = F.create_map(*[F.lit(x) for kv in (descriptions or {"": ""}).items() for x in kv])
    about = F.try_element_at(table, section)
    none = F.lit("")
    pages = F.when(page_start == page_end, F.format_string(" (page %d)", page_start)).when(page_end.isNotNull(), F.format_string(" (pages %d-%d)", page_start, page_end))
    return F.concat(
        F.format_string("This is from %s's %s for FY%s", who, doc_type, year),
        F.coalesce(F.concat(F.lit(", "), quarter), none),
        F.coalesce(F.concat(F.lit(", in the "), label, F.lit(" section")), none),
        F.coalesce(F.concat(F.lit(". This section "), about), none),
        F.coalesce(pages, none),
        F.lit("."),
    )


def source_label(symbol: Column, doc_type: Column, year: Column, quarter: Column) -> Column:
    """'SYM report FY2024 Q1', without the parts that are null."""
    return F.concat_ws(" ", symbol, doc_type, F.concat(F.lit("FY"), year.cast("string")), quarter)
