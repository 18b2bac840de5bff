"""One instant from timestamps written in many formats, precisions, languages and zones.

The distinct combinations of raw text, zone, day order and language form a dictionary. Each is parsed once, tried
against every form; the parsed part can be kept in a folder, so that a later run parses only new combinations. The
instants are joined back to the rows on the combination. Ages ("3 days ago") are stored as a length and subtracted
from the row's reference time at the join.

Defined results: null, blank or unparsable text, impossible dates, and bounds ("30+ days ago") give null, as does a
local time whose zone is null or unknown; an age without a reference time gives null. A local time that occurs twice
is the earlier instant; one that is skipped at a clock change is read with the offset before the change.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.session import exists

VERSION = 1  # of the parser: kept dictionaries of other versions aren't read

# Names of months and units.
MONTHS = {
    "jan": 1, "january": 1, "januar": 1, "jänner": 1, "janvier": 1, "enero": 1, "ene": 1, "janv": 1,
    "feb": 2, "february": 2, "februar": 2, "février": 2, "fevrier": 2, "febrero": 2, "févr": 2,
    "mar": 3, "march": 3, "märz": 3, "maerz": 3, "mars": 3, "marzo": 3, "mär": 3,
    "apr": 4, "april": 4, "avril": 4, "abril": 4, "abr": 4, "avr": 4,
    "may": 5, "mai": 5, "mayo": 5, "jun": 6, "june": 6, "juni": 6, "juin": 6, "junio": 6,
    "jul": 7, "july": 7, "juli": 7, "juillet": 7, "julio": 7, "juil": 7,
    "aug": 8, "august": 8, "août": 8, "aout": 8, "agosto": 8, "ago": 8,
    "sep": 9, "sept": 9, "september": 9, "septembre": 9, "septiembre": 9,
    "oct": 10, "october": 10, "okt": 10, "oktober": 10, "octobre": 10, "octubre": 10,
    "nov": 11, "november": 11, "novembre": 11, "noviembre": 11,
    "dec": 12, "december": 12, "dez": 12, "dezember": 12, "décembre": 12, "decembre": 12, "diciembre": 12, "dic": 12, "déc": 12,
}
UNITS = {
    "second": 1, "s": 1, "sekunde": 1, "seconde": 1, "segundo": 1,
    "minute": 60, "min": 60, "m": 60, "minuten": 60, "minuto": 60,
    "hour": 3600, "h": 3600, "hr": 3600, "stunde": 3600, "stunden": 3600, "heure": 3600, "hora": 3600,
    "day": 86400, "d": 86400, "tag": 86400, "tagen": 86400, "tage": 86400, "jour": 86400, "día": 86400, "dia": 86400,
    "week": 604800, "w": 604800, "wk": 604800, "woche": 604800, "wochen": 604800, "semaine": 604800, "semana": 604800,
}
# Offsets in minutes of zone abbreviations, for those that the site's own zone doesn't use.
ABBREVIATIONS = {
    "utc": 0, "gmt": 0, "z": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120,
    "eet": 120, "eest": 180, "wat": 60, "cat": 120, "sast": 120, "eat": 180, "ist": 330, "jst": 540, "est": -300, "edt": -240,
    "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "aest": 600, "aedt": 660, "acst": 570, "awst": 480,
}
AGE = re.compile(
    r"(?:(?:re)?posted|publié|veröffentlicht|publicado)?\s*(?:(?P<n>\d+|an?|one|einem|einer|une?|una?)\s*(?P<u>[^\W\d_]+?)\s+ago"
    r"|(?:vor|hace|il y a)\s+(?P<n2>\d+|einem|einer|une?|una?)\s+(?P<u2>[^\W\d_]+))"
)
TIME = r"(?P<H>\d{1,2})[:h](?P<M>\d{2})(?::(?P<S>\d{2}))?(?:[.,]\d+)?(?:\s*(?P<ap>[ap])\.?m\.?(?![a-z]))?"
PREFIX = r"(?:(?:re)?posted(?: on)?|publié le|publié|veröffentlicht am|publicado el|date:?)?\s*(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
SUFFIX = r"(?:\s*(?:uhr|h|hrs))?"
ZONE = r"(?:\s*(?P<off>[+-]\d{2}:?\d{2}|[+-]\d{2})?\s*(?:\[(?P<iana1>[a-z_]+(?:/[a-z_+-]+)*)\]|(?P<iana2>[a-z]+/[a-z_]+(?:/[a-z_]+)?)|(?P<abbr>[a-z]{1,5}))?)?"
MID = r"(?:[\st,]+(?:at|um|à|a las)?\s*|\s*)"
DATES = [
    r"(?P<y>\d{4})[-/.](?P<m>\d{1,2})[-/.](?P<d>\d{1,2})",
    r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})",
    r"(?P<d>\d{1,2})\.(?P<m>\d{1,2})\.(?P<y>\d{4}|\d{2})",
    r"(?P<s1>\d{1,2})/(?P<s2>\d{1,2})/(?P<y>\d{4}|\d{2})",
    r"(?P<mon>[^\W\d_]+)\.?\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})",
    r"(?P<d>\d{1,2})(?:er|st|nd|rd|th|\.)?\s+(?:de\s+)?(?P<mon>[^\W\d_]+)\.?,?\s+(?:de\s+)?(?P<y>\d{4})",
]
COMPACT = r"t(?P<H>\d{2})(?P<M>\d{2})(?P<S>\d{2})?(?:[.,]\d+)?(?P<ap>)"
FORMS = [re.compile(PREFIX + d + "(?:" + MID + TIME + SUFFIX + ZONE + ")?") for d in DATES]
FORMS.append(re.compile(PREFIX + DATES[1] + COMPACT + ZONE))
FORMS.append(re.compile(TIME + r"\s+" + DATES[0] + ZONE))


def _offset(name: str, local: datetime, tz: ZoneInfo | None) -> timezone | None:
    """The offset of an abbreviation: as the site's zone uses it, near that time or at all that year, else its usual one."""
    if tz is not None and name not in ("utc", "gmt", "z", "ut"):
        for when in (local, *(local + timedelta(days=d) for d in (-1, 1, -91, 91, 182))):
            for fold in (0, 1):
                x = when.replace(tzinfo=tz, fold=fold)
                if (x.tzname() or "").lower() == name:
                    return timezone(x.utcoffset())
    return timezone(timedelta(minutes=ABBREVIATIONS[name])) if name in ABBREVIATIONS else None


def parse_instant(raw: str | None, tz_name: str | None, day_first: bool | None) -> tuple[str, int] | None:
    """("at", epoch seconds) or ("age", seconds) of a text; None if it fixes no instant."""
    if raw is None or len(raw) > 200:
        return None
    text = raw.strip().lower()
    if re.fullmatch(r"\d{9,}(?:\.\d+)?", text):
        whole = int(text.split(".")[0])
        return "at", whole if whole < 10**11 else whole // 1000 if whole < 10**14 else whole // 10**6 if whole < 10**17 else whole // 10**9
    if m := AGE.fullmatch(text):
        n, unit = m["n"] or m["n2"], (m["u"] or m["u2"])
        length = UNITS.get(unit) or UNITS.get(unit.rstrip("s"))
        return ("age", (int(n) if n.isdigit() else 1) * length) if length else None
    for form in FORMS:
        if not (m := form.fullmatch(text)):
            continue
        g = m.groupdict()
        if g.get("mon") is not None:
            month, day = MONTHS.get(g["mon"]), int(g["d"])
            if month is None:
                continue
        elif g.get("s1") is not None:
            a, b = int(g["s1"]), int(g["s2"])
            day, month = (a, b) if day_first else (b, a)
        else:
            month, day = int(g["m"]), int(g["d"])
        year = int(g["y"]) + (2000 if len(g["y"]) == 2 else 0)
        hour, minute, second = (int(g.get(k) or 0) for k in ("H", "M", "S"))
        if g.get("ap"):
            if not 1 <= hour <= 12:
                continue
            hour = hour % 12 + (12 if g["ap"] == "p" else 0)
        try:
            local = datetime(year, month, day, hour, minute, second)
        except ValueError:
            continue
        try:
            site = ZoneInfo(tz_name) if tz_name else None
        except (KeyError, ValueError, OSError):
            site = None
        zone: timezone | ZoneInfo | None = site
        if g.get("off"):
            o = g["off"].replace(":", "")
            zone = timezone((1 if o[0] == "+" else -1) * timedelta(hours=int(o[1:3]), minutes=int(o[3:] or 0)))
        elif iana := g.get("iana1") or g.get("iana2"):
            named = [tz for tz in (tz_name or "",) if tz.lower() == iana] or ["/".join("_".join(w.capitalize() for w in part.split("_")) for part in iana.split("/"))]
            try:
                zone = ZoneInfo(named[0] if named[0] != "Utc" else "UTC")
            except (KeyError, ValueError, OSError):
                continue
        elif g.get("abbr"):
            zone = _offset(g["abbr"], local, site)
        if zone is None:
            continue
        return "at", int(local.replace(tzinfo=zone).astimezone(UTC).timestamp())
    return None


KEYS = ["raw", "tz_name", "day_first"]
DICTIONARY = "raw string, tz_name string, day_first boolean, kind string, seconds bigint"


def _parse_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = [parse_instant(r, t if isinstance(t, str) else None, d is True or d == 1) for r, t, d in zip(pdf.raw, pdf.tz_name, pdf.day_first, strict=True)]
        yield pdf.assign(kind=pd.Series([g[0] if g else None for g in got], dtype=object, index=pdf.index), seconds=pd.array([g[1] if g else None for g in got], dtype="Int64"))


def build_dictionary(combos: DataFrame, store: str | None = None) -> DataFrame:
    """The dictionary (raw, tz_name, day_first, kind, seconds) of distinct combinations.

    store: a shared folder. The combinations found there aren't parsed again; the new ones are parsed and added as a
    batch of their own, so a lost executor or a failed job leaves the earlier batches as they were.
    """
    spark = combos.sparkSession
    distinct = combos.select(*KEYS).distinct()
    if store is None:
        return distinct.mapInPandas(_parse_all, DICTIONARY)
    folder = f"{store.rstrip('/')}/v{VERSION}"
    new = distinct
    if exists(spark, folder):
        known = spark.read.schema(DICTIONARY).parquet(f"{folder}/batch-*")
        same = [distinct[k].eqNullSafe(known[k]) for k in KEYS]
        new = distinct.join(known, same[0] & same[1] & same[2], "left_anti")
    new.mapInPandas(_parse_all, DICTIONARY).write.parquet(f"{folder}/batch-{uuid.uuid4().hex}")
    return spark.read.schema(DICTIONARY).parquet(f"{folder}/batch-*").dropDuplicates(KEYS)


def normalise_instants(
    rows: DataFrame, sources: DataFrame, text: str = "posted_date", site: str = "source_site", reference: str = "crawled_at", keep: str = "id", store: str | None = None
) -> DataFrame:
    """(keep, epoch_s) of every row whose text fixes an instant.

    sources: (source_site, tz_name, day_first), one row per site; it is joined by the optimizer's choice of join.
    """
    zones = sources.select(F.col("source_site").alias("_site"), "tz_name", "day_first").dropDuplicates(["_site"])
    base = rows.where(F.col(text).rlike(r"[0-9]|\bago\b|vor |hace |il y a")).select(F.col(keep).alias("_keep"), F.col(text).alias("raw"), F.col(site).alias("_site"), F.col(reference).alias("_ref"))
    base = base.join(zones, "_site", "left").select("_keep", "raw", F.coalesce("tz_name", F.lit("")).alias("tz_name"), F.coalesce("day_first", F.lit(False)).alias("day_first"), "_ref")
    words = build_dictionary(base, store)
    found = base.join(words.where(F.col("kind").isNotNull()), KEYS)
    return found.select(F.col("_keep").alias(keep), instant(F.col("kind"), F.col("seconds"), F.col("_ref")).alias("epoch_s")).where(F.col("epoch_s").isNotNull())


def instant(kind: Column, seconds: Column, reference: Column) -> Column:
    """Seconds since 1970 of a dictionary entry, for a row's reference time; fractions dropped."""
    return F.when(kind == "at", seconds).otherwise(F.floor((F.unix_micros(reference) - seconds * F.lit(1_000_000)) / F.lit(1_000_000)).cast("bigint"))
