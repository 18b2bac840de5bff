"""The rule-based reading of a salary text that the search and ranking operators use (its quirks are kept).

For amounts in common units use jobloom.operators.units.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions import js

# Currency prefixes in order, and period words.
PREFIXES = [("$", "USD"), ("usd", "USD"), ("us$", "USD"), ("€", "EUR"), ("eur", "EUR"), ("£", "GBP"), ("gbp", "GBP"), ("₦", "NGN"), ("ngn", "NGN"), ("¥", "JPY"), ("jpy", "JPY"), ("₵", "GHS"), ("ghs", "GHS"), ("r", "ZAR"), ("zar", "ZAR"), ("ksh", "KES"), ("kes", "KES"), ("a$", "AUD"), ("aud", "AUD"), ("c$", "CAD"), ("cad", "CAD")]
PERIOD_WORDS = {
    "hour": ["hr", "hr.", "hrs", "hour", "hourly", "/hr", "/hr.", "per hour", "an hour"], "day": ["day", "daily", "/day", "per day"],
    "week": ["wk", "week", "weekly", "/wk", "per week", "a week"], "month": ["mo", "month", "monthly", "/mo", "/month", "per month", "a month", "p/m"],
    "year": ["yr", "year", "yearly", "annual", "annually", "/yr", "/year", "per year", "a year", "p.a", "p/a"],
}
#: Longest first, ties in the order above.
PERIOD_ORDER = sorted(((w, p) for p, words in PERIOD_WORDS.items() for w in words), key=lambda x: -len(x[0]))
CODES = {w: c for w, c in PREFIXES if re.fullmatch("[a-z]{3}", w)}
RANGE = r"(?:[$€£₦¥]\s*)?(\d{1,3}(?:[kKmMBb])?)\s*(?:[-–to]|to)\s*(?:[$€£₦¥]\s*)?(\d{1,3}(?:[kKmMBb])?)"


def _number(value: Column) -> Column:
    form = r"(?i)^(\d+(?:\.\d+)?)(k|m|b)?\z"

    def read(cleaned: Column) -> Column:
        unit = F.lower(F.regexp_extract(cleaned, form, 2))
        n = js.blank_to_null(F.regexp_extract(cleaned, form, 1)).try_cast("double")
        return F.floor(n * F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).otherwise(1.0) + 0.5)

    return js.let(js.trim(F.regexp_replace(value, r"(?i)[$,€£¥₦₵R\s]", "")), read)


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])


def _split_currency(t: Column) -> Column:
    """struct<code, rest>: a leading currency word, the first of the list that fits, else a trailing code."""
    word = F.regexp_extract(F.lower(t), "^(" + "|".join(re.escape(w) for w, _ in PREFIXES) + ")", 1)
    last = F.lower(F.regexp_extract(t, r"(?<![A-Za-z0-9_])([A-Za-z]{3})\s*\z", 1))
    code, tail = F.try_element_at(_map(dict(PREFIXES)), word), F.try_element_at(_map(CODES), last)
    rest = F.when(word != "", js.trim(F.substring(t, F.length(word) + 1, F.length(t)))).when(tail.isNotNull(), js.trim(F.regexp_replace(t, r"[A-Za-z]{3}\s*\z", ""))).otherwise(t)
    return F.struct(F.coalesce(code, tail).alias("code"), rest.alias("rest"))


def _split_period(rest: Column) -> Column:
    """struct<period, rest>: the first period word of the list that occurs, taken out once."""
    word = F.get(F.filter(F.array(*[F.lit(w) for w, _ in PERIOD_ORDER]), lambda w: F.contains(F.lower(rest), w)), F.lit(0))

    def cut(w: Column) -> Column:
        at = F.position(w, F.lower(rest))
        left = F.when(w.isNull(), rest).otherwise(js.trim(F.concat(F.substring(rest, F.lit(1), at - 1), F.substring(rest, at + F.length(w), F.length(rest)))))
        return F.struct(F.coalesce(F.try_element_at(_map(dict(PERIOD_ORDER)), w), F.lit("year")).alias("period"), left.alias("rest"))

    return js.let(word, cut)


def _amounts(after: Column) -> Column:
    """struct<min, max, confidence> of what is left."""
    c = F.regexp_replace(after, r"(?i)/\s*(hr|hrs|hour|day|wk|week|mo|month|yr|year|annual)", "")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)per\s+(hour|day|week|month|year|annum)", ""), r"p\.?\s*[aA]", "")
    c = js.trim(F.replace(c, F.lit(","), F.lit("")))

    def numbers(c: Column) -> Column:
        s = js.trim(F.regexp_replace(c, r"(?i)[$,€£¥₦₵R\s]", ""))
        return F.struct(
            _number(F.regexp_extract(c, RANGE, 1)).alias("lo"), _number(F.regexp_extract(c, RANGE, 2)).alias("hi"),
            _number(F.regexp_extract(s, r"(\d{4,}|\d{1,3}[kKmMbB])", 1)).alias("one"), _number(F.regexp_extract(s, r"(\d+(?:\.\d+)?[kKmMbB]?)", 1)).alias("any"),
        )

    def choose(n: Column) -> Column:
        ranged, single = F.coalesce(n["hi"] >= n["lo"], F.lit(False)), F.coalesce(n["one"], n["any"])
        sure = F.when(ranged, F.when(n["hi"] - n["lo"] < 200000, "high").otherwise("medium")).when(n["one"].isNotNull(), "high").when(n["any"].isNotNull(), "medium").otherwise("low")
        return F.struct(F.when(ranged, n["lo"]).otherwise(single).cast("bigint").alias("min"), F.when(ranged, n["hi"]).otherwise(single).cast("bigint").alias("max"), sure.alias("confidence"))

    return js.let(c, lambda c: js.let(numbers(c), choose))


def parse(raw: Column) -> Column:
    """struct<min, max, currency, period, type, confidence>."""

    def whole(t: Column) -> Column:
        return js.let(_split_currency(t), lambda m: js.let(_split_period(m["rest"]), lambda p: js.let(_amounts(p["rest"]), lambda a: put(t, m, p, a))))

    def put(t: Column, money: Column, period: Column, a: Column) -> Column:
        low, none = F.lower(t), a["min"].isNull()
        kind = F.when(F.contains(low, F.lit("commission")), "commission").when(js.contains_any(low, ["starting", "from"]), "starting").when(js.contains_any(low, ["-", "–", "to"]), "range").otherwise("unspecified")
        blank = F.coalesce(F.length(t), F.lit(0)) == 0
        return F.struct(
            F.when(~blank, a["min"]).alias("min"), F.when(~blank, a["max"]).alias("max"),
            F.when(~blank, F.when(none, money["code"]).otherwise(F.coalesce(money["code"], F.lit("USD")))).alias("currency"),
            F.when(blank, "unknown").otherwise(period["period"]).alias("period"), F.when(blank | none, "unspecified").otherwise(kind).alias("type"), F.when(blank, "low").otherwise(a["confidence"]).alias("confidence"),
        )

    return js.let(js.trim(raw), whole)


def show(low: Column, high: Column, currency: Column, period: Column, kind: Column, confidence: Column, raw: Column) -> Column:
    """A parsed salary as a short text; the raw text where it is not sure."""
    signs = {"USD": "$", "EUR": "€", "GBP": "£", "NGN": "₦", "JPY": "¥", "GHS": "₵", "ZAR": "r", "KES": "ksh", "AUD": "a$", "CAD": "c$"}
    sign = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in signs.items() for x in p]), currency), currency)
    short = lambda n: F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1_000_000.0), F.lit("M"))).when(n >= 1000, F.concat(F.floor(n / 1000.0 + 0.5).cast("string"), F.lit("k"))).otherwise(n.cast("string"))
    per = F.when(period != "year", F.concat(F.lit("/"), period)).otherwise("")
    text = F.when(kind == "range", F.concat(sign, short(low), F.lit("-"), short(high), per)).when(low == high, F.concat(sign, short(low), per)).otherwise(raw)
    return F.when((confidence == "low") | low.isNull(), F.coalesce(raw, F.lit("Not specified"))).otherwise(text)
