"""Keyed writes and maintenance of the table of postings, as table-to-table transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.functions import dates, js, text
from jobloom.operators.search import latest


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the rows of incoming put in or over those of the same key; of several incoming ones, the last by all columns."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [F.col(c) for c in stored.columns if dict(stored.dtypes)[c].split("<")[0] not in ("map",)]
    return latest(both, [F.col(k) for k in keys], [F.col("_new"), *rest]).drop("_new")


def patch(stored: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """stored with the non-null columns of changes (one row a key) put over its own."""
    fields = [c for c in changes.columns if c != key]
    side = changes.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_new_{c}") for c in fields))
    joined = stored.join(side, stored[key] == side["_key"], "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in fields else c for c in stored.columns))


def delete_cascade(jobs: DataFrame, vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    return jobs.join(gone, "id", "left_anti"), vectors.join(gone.select(F.col("id").alias("job_id")), "job_id", "left_anti")


def address(column: str = "apply_url") -> Column:
    return js.blank_to_null(js.trim(F.col(column)))


def duplicate_rank(jobs: DataFrame) -> DataFrame:
    """jobs with dup_rank: 1 for the newest row of an apply_url (by posted date, then crawl), null without one."""
    posted = F.coalesce(F.unix_millis(dates.absolute_instant(F.col("posted_date"))), F.lit(0))
    order = [posted.desc(), F.col("crawled_at").desc(), F.col("id")]
    return jobs.withColumn("dup_rank", F.when(address().isNotNull(), F.row_number().over(Window.partitionBy(address()).orderBy(*order))))


def newest_per_address(jobs: DataFrame) -> DataFrame:
    """Rows without apply_url, and of each apply_url the newest row. No window: the best row is kept by an aggregate."""
    posted = F.coalesce(F.unix_millis(dates.absolute_instant(F.col("posted_date"))), F.lit(0))
    keyed = jobs.where(address().isNotNull())
    best = keyed.groupBy(address().alias("_url")).agg(F.max(F.struct(posted.alias("p"), F.unix_micros("crawled_at").alias("c"))).alias("m"))
    tied = keyed.withColumn("_url", address()).withColumn("m", F.struct(posted.alias("p"), F.unix_micros("crawled_at").alias("c"))).join(best, ["_url", "m"]).groupBy("_url").agg(F.min("id").alias("id"))
    return jobs.where(address().isNull()).unionByName(jobs.join(tied.select("id"), "id", "left_semi"))


def decisions(jobs: DataFrame, as_of: str, prune: bool = True) -> DataFrame:
    """(id, action): junk, duplicate, prune, update or keep; the first that holds, duplicates among rows that aren't junk."""
    at = F.lit(as_of).cast("timestamp")
    junk = text.marketing_page(F.col("company"), F.col("source_site"), F.col("title"), F.col("apply_url"), F.col("source_url"), F.col("description")) & (F.length("company") > 0)
    marked = jobs.withColumn("junk", F.coalesce(junk, F.lit(False)))
    ranked = duplicate_rank(marked.where("not junk"))
    age = dates.posted_age(F.col("posted_date"), at)
    d = F.coalesce("description", F.lit(""))
    tidy = text.format_description(d)
    changed = (
        (tidy != d) | (text.remote_flag(F.col("remote_status"), tidy) != text.remote_enum(F.col("remote_status"))) | (text.apply_fallback(F.col("apply_url"), F.col("source_url")) != F.coalesce(js.trim(F.col("apply_url")), F.lit("")))
        | ~F.coalesce(F.size("skills") > 0, F.lit(False)) | (F.coalesce(js.trim(F.col("source_site")), F.lit("")) != F.coalesce(text.site_name(F.col("source_site")), F.lit("")))
    )
    action = F.when(F.col("dup_rank") > 1, "duplicate").when(F.lit(prune) & F.coalesce(age > 60, F.lit(False)), "prune").when(changed, "update").otherwise("keep")
    return marked.where("junk").select("id", F.lit("junk").alias("action")).unionByName(ranked.select("id", action.alias("action")))


def health(jobs: DataFrame) -> DataFrame:
    """total, % of rows without experience level, sources, and apply_urls that repeat: one pass."""
    url = js.blank_to_null(F.col("apply_url"))
    return jobs.agg(
        F.count("*").alias("total"),
        js.rounded(100.0 * F.count_if(F.coalesce("experience_level", F.lit("unspecified")) == "unspecified") / F.greatest(F.count("*"), F.lit(1)), 1).alias("pct_unspecified"),
        F.count_distinct(F.coalesce("source_site", F.lit(""))).alias("source_sites"), (F.count(url) - F.count_distinct(url)).alias("duplicate_apply_urls"),
    )


def visible(entries: DataFrame, as_of: str, key: str = "key", written: str = "written_at", ttl_seconds: int = 600) -> DataFrame:
    """The last value of every key that hasn't expired."""
    last = latest(entries, [F.col(key)], [F.col(written)])
    return last.where(F.unix_micros(written) + ttl_seconds * 1_000_000 > F.unix_micros(F.lit(as_of).cast("timestamp")))
