"""Amounts of pay, stated in free text in many currencies, periods and scales, as whole units of one currency per year.

The text around each number is segmented by dynamic programming over tries of prefixes (scales: k, thousand, lakh),
roots (currencies, periods) and exponents ("per", "/", "p.", "pro"). A decomposition scores by the prior of each piece
for the dimension of the field, here currency^1 * time^-1: an "m" right behind a number is a million, an "m" behind
"p." is a month, a lone "a" is an exponent, the "a" of "p.a." a year.

Defined results: null, blank or empty text, text without a number, and text whose numbers all belong to something
else (hours, leave, grades, percentages) give null; so does a bare zero. A number that opens a range without a scale
takes the scale of its partner if it is the smaller one as written ("36-42K", but not "740 - 1.1k").
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.tables import rows_of

# Spellings of currencies.
CURRENCIES = {
    "USD": ["$", "usd", "us$", "u.s. dollars", "us dollars", "dollars", "dollar", "u$s"],
    "EUR": ["€", "eur", "euros", "euro"],
    "GBP": ["£", "gbp", "pounds sterling", "pounds", "pound", "sterling", "quid"],
    "CHF": ["chf", "fr.", "sfr.", "sfr", "swiss francs", "francs suisses", "schweizer franken", "franken"],
    "NGN": ["₦", "ngn", "naira", "n"],
    "GHS": ["₵", "gh₵", "ghs", "ghc", "cedis", "cedi"],
    "JPY": ["¥", "jpy", "yen", "jp¥", "円"],
    "ZAR": ["zar", "rand", "r"],
    "KES": ["kes", "ksh", "kshs", "kenyan shillings", "kenya shillings", "shillings"],
    "AUD": ["aud", "a$", "au$", "australian dollars", "aussie dollars"],
    "CAD": ["cad", "c$", "ca$", "canadian dollars", "can$"],
    "INR": ["₹", "inr", "rs.", "rs", "rupees", "rupee", "indian rupees"],
}
# Spellings of periods; those in PERIODS_BARE state the period without an exponent before them.
PERIODS = {
    "hour": ["hour", "hours", "hr", "hrs", "h", "stunde", "std", "heure", "hora"],
    "day": ["day", "days", "d", "diem", "tag", "jour", "día", "dia"],
    "week": ["week", "weeks", "wk", "w", "woche", "semaine", "semana"],
    "month": ["month", "months", "mo", "mth", "m", "cm", "monat", "mois", "mes"],
    "year": ["year", "years", "yr", "yrs", "y", "a", "annum", "jahr", "an", "année", "año", "ano"],
}
PERIODS_BARE = {
    "hour": ["hourly", "hourly rate", "stündlich", "stundenlohn"],
    "day": ["daily", "day rate", "daily rate", "p/d", "tagessatz"],
    "week": ["weekly", "wöchentlich", "hebdomadaire"],
    "month": ["monthly", "pcm", "monatlich", "mensuel", "mensuels", "mensuales", "monatsgehalt"],
    "year": ["annually", "yearly", "annual", "annuel", "annuels", "anuales", "jahresgehalt", "jährlich", "pa"],
}
# Scales, exponents, and words that may stand around an amount without changing it.
SCALES = {
    "k": 1e3, "thousand": 1e3, "thousands": 1e3, "tsd": 1e3, "tausend": 1e3, "mil": 1e3, "mille": 1e3, "grand": 1e3,
    "m": 1e6, "mn": 1e6, "mio": 1e6, "million": 1e6, "millions": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9,
    "l": 1e5, "lac": 1e5, "lacs": 1e5, "lakh": 1e5, "lakhs": 1e5, "cr": 1e7, "crore": 1e7, "crores": 1e7,
}
LAKH_SCALES = {"l", "lac", "lacs", "lakh", "lakhs", "cr", "crore", "crores"}
EXPONENTS = ["per", "/", "a", "an", "p", "p.", "pro", "par", "por", "al", "a la", "à la", "de l'", "de l’", "je", "im", "each", "every"]
FILLERS = [
    "between", "from", "starting at", "starting", "up to", "upto", "min", "max", "ca", "circa", "approx", "about", "around",
    "pay", "salary", "rate", "comp", "compensation", "wage", "gehalt", "salaire", "salario", "vergütung", "gross", "net", "brutto",
    "netto", "brut", "brutos", "bruto", "ote", "doe", "negotiable", "benefits", "equity", "plus", "pension", "bonus", "and", "to",
    "bis", "ab", "de", "à", "y", "et", "und", "or", "base", "basic", "on-target", "package", "depending on experience",
]
# What a number in front of (or behind) these words counts is not pay.
NOT_PAY_AFTER = r"%|percent|(?:paid |annual )?(?:holidays?|leave|vacation|bonus|pension|equity|match)\b|(?:[a-z]+\.? )?(?:holidays?|leave|vacation|contract|contrato|vertrag)\b|(?:hours?|hrs?|h|days?|d)(?: (?:per|a)|/)\s?(?:week|wk|day|month|year)\b|\(k\)|st\b|nd\b|rd\b|th\b"
NOT_PAY_BEFORE = r"\b(?:grade|level|band|step|tier|top|no\.?|nr\.?|ref\.?|tvöd|entgeltgruppe|bonus|equity|pension|hours|leave|holiday)[\s:#-]*[a-z]?$|(?<![a-z])[a-z]$"

NUMBER = re.compile(r"\d{1,3}(?:[ \u00a0\u2009\u202f']\d{3})+(?![\d])(?:[.,]\d{1,2}(?!\d))?|\d+(?:[.,]\d+)*")
BREAK = re.compile(r"[,;(+]|\bplus\b")
OPEN_END = re.compile(r"(?<=[0-9a-z])\+")  # "20k+": the amount is a lower bound, it states the one number
FILLER_WORDS = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(FILLERS, key=len, reverse=True))) + r")\b")


class Trie:
    """Strings with values, matched from a position on."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, value: tuple) -> None:
        node = self.root
        for ch in word:
            node = node.setdefault(ch, {})
        node.setdefault("", []).append((word, *value))

    def matches(self, text: str, at: int) -> Iterator[tuple]:
        node = self.root
        for i in range(at, len(text)):
            node = node.get(text[i])
            if node is None:
                return
            for hit in node.get("", ()):
                yield i + 1, hit


def _build() -> Trie:
    trie = Trie()
    for code, words in CURRENCIES.items():
        for w in words:
            trie.add(w, ("root", "currency", code))
    for period, words in PERIODS.items():
        for w in words:
            trie.add(w, ("root", "time", period))
    for period, words in PERIODS_BARE.items():
        for w in words:
            trie.add(w, ("bare", "time", period))
    for w in SCALES:
        trie.add(w, ("prefix", "scale", w))
    for w in EXPONENTS:
        trie.add(w, ("exponent", "", "-1"))
    for w in FILLERS:
        trie.add(w, ("filler", "", ""))
    return trie


TRIE = _build()


def segment(text: str, behind_number: bool, before_number: bool) -> tuple[float, list[tuple[str, str, str]]]:
    """The best decomposition of a piece of text into prefixes, roots and exponents: (score, [(kind, dimension, value)]).

    behind_number / before_number: whether a number touches the left / right end. The priors make the dimension of a
    pay field, currency * time^-1, the cheapest reading; characters that no piece covers cost most.
    """
    n = len(text)
    # state: position, kind of the last piece -> (score, back pointer, piece)
    best: list[dict[str, tuple[float, tuple | None, tuple | None]]] = [{} for _ in range(n + 1)]
    best[0]["number" if behind_number else "start"] = (0.0, None, None)
    for i in range(n):
        for last, (score, _, _) in list(best[i].items()):
            ch = text[i]
            word_start = i == 0 or not text[i - 1].isalpha()

            def put(j: int, kind: str, value: float, piece: tuple | None, i: int = i, last: str = last) -> None:
                if kind not in best[j] or best[j][kind][0] < value:
                    best[j][kind] = (value, (i, last), piece)

            if not ch.isalpha() and ch not in "$€£₦₵¥₹/":
                # a dot keeps "p." and "p.m." together; other punctuation ends a unit
                put(i + 1, last if ch in " .'\u2019\u00a0" else "start" if last not in ("number",) else last, score - 0.01, None)
            else:
                put(i + 1, "unknown", score - (1.5 if last == "unknown" and not word_start else 4.0), None)
            for j, (word, kind, dim, value) in TRIE.matches(text, i):
                word_end = j == n or not text[j].isalpha() or not word[-1].isalpha()
                alpha = word[0].isalpha()
                glued = alpha and not word_start and last not in ("prefix", "number", "exponent", "root")
                if kind == "prefix":
                    if last != "number":
                        continue
                    cost = 0.4 if len(word) == 1 else 0.2
                    if len(word) == 1 and i > 0:
                        cost += 3.0 if word in "lm" else 1.0  # "8 m" may be metres, "8M" is not
                elif kind == "root" and dim == "currency":
                    cost = 0.3
                    if len(word) == 1 and alpha:
                        if not (before_number and not text[j:].strip()):
                            continue
                        cost = 0.8
                elif kind == "root":
                    cost = 0.3 if last == "exponent" else (6.0 if len(word) <= 2 else 3.0)
                elif kind == "bare":
                    cost = 0.3
                elif kind == "exponent":
                    cost = 0.6 if alpha else 0.3
                else:
                    cost = 0.5
                if alpha and not word_end and not (kind == "prefix" or (kind in ("exponent", "root") and len(word) <= 2)):
                    continue
                if not word_end and kind == "prefix" and len(word) > 1:
                    continue
                if not word_end:
                    cost += 0.8
                if glued:
                    cost += 5.0
                nxt = {"prefix": "prefix", "root": "root", "bare": "root", "exponent": "exponent", "filler": "start"}[kind]
                put(j, nxt, score - cost, (kind, dim, value))
    # an exponent that nothing follows isn't one
    kind = max(best[n], key=lambda k: best[n][k][0] - (2.0 if k == "exponent" else 0.0))
    score, back, piece = best[n][kind]
    out = []
    while back is not None:
        if piece:
            out.append(piece)
        _, back, piece = best[back[0]][back[1]]
    return score, out[::-1]


def parse_number(raw: str, scaled: bool) -> float:
    """A number in any of the usual styles. Three digits behind a single dot are thousands unless a scale follows."""
    s = re.sub(r"[ \u00a0\u2009\u202f']", "", raw)
    if "." in s and "," in s:
        dec = max(s.rfind("."), s.rfind(","))
        return float(re.sub(r"[.,]", "", s[:dec]) + "." + s[dec + 1:])
    for sep in ".,":
        if sep in s:
            parts = s.split(sep)
            if len(parts) > 2 or (len(parts[1]) == 3 and not (scaled and sep == ".") and parts[0] != "0"):
                return float("".join(parts))
            return float(".".join(parts))
    return float(s)


def parse_pay(text: str | None) -> tuple[float, float, str, str] | None:
    """(min, max, currency, period) of a statement of pay, amounts as written times their scale; None if it states none."""
    if not text or not any(c.isdigit() for c in text):
        return None
    low = OPEN_END.sub("", text.lower()).strip()
    spans = [(m.start(), m.end()) for m in NUMBER.finditer(low)]
    found = []
    for k, (a, b) in enumerate(spans):
        prev_end = spans[k - 1][1] if k else 0
        next_start = spans[k + 1][0] if k + 1 < len(spans) else len(low)
        before, after = low[prev_end:a], low[b:next_start]
        head = BREAK.split(after, maxsplit=1)[0] if not after.lstrip().startswith("(k)") else after
        if re.match(r"\s*(?:" + NOT_PAY_AFTER + ")", head) or (not k and re.search(NOT_PAY_BEFORE, before.strip()) and not _is_unit(before)):
            continue
        found.append((k, a, b, before, after))
    if not found:
        return None
    amounts, currency, period, lakh, evidence, around = [], None, None, False, False, ""
    for i, (k, a, b, before, after) in enumerate(found):
        follows = i + 1 < len(found) and found[i + 1][0] == k + 1
        # the text between two amounts belongs to the first up to the connector, to the second behind it
        if follows:
            m = re.search(r"-|–|—|~|\bto\b|\band\b|\bbis\b|(?<=\s)à(?=\s)", after)
            tail = after[: m.start()] if m else after
        else:
            tail = BREAK.split(after, maxsplit=1)[0] if after.lstrip()[:1] != "(" else ""
        lead = before
        if i and found[i - 1][0] == k - 1:
            m = re.search(r"-|–|—|~|\bto\b|\band\b|\bbis\b|(?<=\s)à(?=\s)", before)
            lead = before[m.end():] if m else ""
        elif k and not i:
            lead = ""
        scale = None
        for piece_text, behind, ahead in ((lead, False, True), (tail, True, False)):
            around += " " + piece_text
            _, pieces = segment(piece_text.rstrip() if behind else piece_text, behind, ahead)
            for kind, dim, value in pieces:
                if kind == "prefix":
                    scale = value
                    evidence = True
                elif dim == "currency":
                    currency = currency or value
                    evidence = True
                elif dim == "time":
                    period = value if period is None else period
                    evidence = True
        rest = tail.strip()
        if rest.startswith("lpa"):
            scale, period, evidence = "lakh", period or "year", True
        lakh |= scale in LAKH_SCALES
        amounts.append((parse_number(low[a:b], scale is not None), scale))
        if not follows:
            break
        if len(amounts) == 2:
            break
    if not evidence and FILLER_WORDS.sub("", around).strip(" .:~-"):
        return None
    values = []
    if len(amounts) == 2:
        (x, sx), (y, sy) = amounts
        if sx is None and sy is not None and x < y:
            sx = sy
        values = [x * SCALES.get(sx, 1), y * SCALES.get(sy, 1)]
    else:
        values = [amounts[0][0] * SCALES.get(amounts[0][1], 1)] * 2
    if not any(values):
        return None
    return min(values), max(values), currency or ("INR" if lakh else "USD"), period or "year"


def _is_unit(before: str) -> bool:
    """Whether the text that ends right before a number is a currency, not the letter of a grade."""
    return any(kind == "root" for kind, _, _ in segment(before.lower(), False, True)[1])


def pay_per_year(text: Column, units: DataFrame) -> Column:
    """struct<usd_year_min bigint, usd_year_max bigint> of a pay text; null where it states no pay.

    units: (unit_name, unit_kind, factor), at most 1000 rows: a fixed reference table that goes to every task.
    """
    factors = {(r.unit_kind, r.unit_name): r.factor for r in rows_of(units.select("unit_kind", "unit_name", "factor"), 1000, "the table of units")}

    @F.pandas_udf("usd_year_min bigint, usd_year_max bigint")
    def parse(texts: pd.Series) -> pd.DataFrame:
        seen: dict[str, tuple] = {}
        lows, highs = [], []
        for t in texts:
            if t not in seen:
                p = parse_pay(t)
                f = None if p is None else (factors.get(("currency", p[2])), factors.get(("period", p[3])))
                seen[t] = (None, None) if f is None or None in f else tuple(round(v * f[0] * f[1]) for v in p[:2])
            low, high = seen[t]
            lows.append(low)
            highs.append(high)
        return pd.DataFrame({"usd_year_min": pd.array(lows, dtype="Int64"), "usd_year_max": pd.array(highs, dtype="Int64")})

    return parse(text)


def unify_pay(jobs: DataFrame, units: DataFrame, id_col: str = "id", text_col: str = "salary_range") -> DataFrame:
    """(id, usd_year_min, usd_year_max) of every row that states pay. No shuffle; other columns are not read."""
    has_digit = F.col(text_col).rlike("[0-9]")
    pay = jobs.where(has_digit).select(F.col(id_col).alias("id"), pay_per_year(F.col(text_col), units).alias("pay"))
    return pay.where(F.col("pay.usd_year_min").isNotNull()).select("id", "pay.usd_year_min", "pay.usd_year_max")
