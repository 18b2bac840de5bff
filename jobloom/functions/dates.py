"""Ages and dates of postings, relative to an explicit as_of. For instants from any format use jobloom.operators.timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions import js

DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}


def _days(unit: Column) -> Column:
    return F.when(F.startswith(unit, F.lit("day")), 1).when(F.startswith(unit, F.lit("week")), 7).when(F.startswith(unit, F.lit("month")), 30).otherwise(365)


def relative_age(text: Column) -> Column:
    """Days of "N units ago" or "a unit ago"; null for anything else."""
    t = js.trim(F.lower(text))
    many = r"^(\d+)\s+(day|days|week|weeks|month|months|year|years)\s+ago\z"
    one = r"^a\s+(day|week|month|year)\s+ago\z"
    n = js.blank_to_null(F.regexp_extract(t, many, 1)).try_cast("bigint")
    single = js.blank_to_null(F.regexp_extract(t, one, 1))
    return F.coalesce(n * _days(F.regexp_extract(t, many, 2)), F.when(single.isNotNull(), _days(single).cast("bigint")))


def absolute_instant(text: Column) -> Column:
    """ISO dates and times, RFC 2822, "MMM d, yyyy", and epochs of 10 or 13 digits."""
    t = js.trim(text)
    digits10, digits13 = F.when(F.rlike(t, F.lit(r"^\d{10}\z")), t), F.when(F.rlike(t, F.lit(r"^\d{13}\z")), t)
    iso = F.when(F.rlike(t, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?\z")), t.try_cast("timestamp"))
    mail = F.try_to_timestamp(F.regexp_replace(t, r"^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss Z"))
    words = F.coalesce(F.try_to_timestamp(t, F.lit("MMM d, yyyy")), F.try_to_timestamp(t, F.lit("MMMM d, yyyy")))
    return F.coalesce(F.timestamp_seconds(digits10.try_cast("bigint")), F.timestamp_millis(digits13.try_cast("bigint")), iso, mail, words)


def absolute_age(text: Column, as_of: Column) -> Column:
    return (F.unix_millis(as_of) - F.unix_millis(absolute_instant(text))) / F.lit(86_400_000.0)


def posted_age(text: Column, as_of: Column) -> Column:
    return F.coalesce(relative_age(text).cast("double"), absolute_age(text, as_of))


def relative_date(text: Column, as_of: Column) -> Column:
    """The day that a relative text means."""
    t = js.trim(F.lower(text))
    p = r"(?:posted|reposted)?\s*(\d+)\s*(hour|hours|day|days|week|weeks|month|months|year|years)\s*ago"
    n, unit = js.blank_to_null(F.regexp_extract(t, p, 1)).try_cast("int"), F.regexp_extract(t, p, 2)
    back = F.when(t.isin("today", "just posted", "posted today", "new"), 0).when(t.isin("yesterday", "posted yesterday"), 1).otherwise(n * F.when(F.startswith(unit, F.lit("hour")), 0).otherwise(_days(unit)))
    return F.date_sub(as_of.cast("date"), back)


def recency_score(instant: Column, as_of: Column) -> Column:
    old = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(instant)) / F.lit(86_400_000_000.0))
    return F.when(instant.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - old / 30.0)))
