"""Predicate search over postings: every filter is added only if it is asked for, so only those reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fresh(jobs: DataFrame, as_of: str, days: int = 60, column: str = "crawled_at") -> DataFrame:
    return jobs.where(F.col(column) >= F.timestamp_seconds(F.unix_timestamp(F.lit(as_of).cast("timestamp")) - days * 86400))


def search(
    jobs: DataFrame, as_of: str, term: str | None = None, location: str | None = None, remote: bool | None = None, skills: list[str] | None = None, limit: int = 50,
) -> DataFrame:
    """Fresh postings, newest first. `%` and `_` in term are wildcards; remote=False adds no filter; skills match any."""
    out = fresh(jobs, as_of)
    if term and term.strip():
        like = f"%{term.strip()}%"
        out = out.where(F.col("title").ilike(like) | F.col("company").ilike(like) | F.col("description").ilike(like))
    if location:
        out = out.where(F.col("location").ilike(f"%{location}%"))
    if remote is True:
        out = out.where(F.col("remote_status") == "remote")
    if skills:
        out = out.where(F.arrays_overlap("skills", F.array(*map(F.lit, skills))))
    return out.orderBy(F.desc("crawled_at"), "id").limit(min(limit, 50))


def newest(rows: DataFrame, columns: list[str], limit: int, order: str = "created_at", key: str = "id") -> DataFrame:
    """The newest rows, pruned to some columns; a top-k per partition and a merge, no full sort."""
    return rows.orderBy(F.desc(order), key).limit(limit).select(*columns)


def known(keys: DataFrame, stored: DataFrame, on: str) -> DataFrame:
    return keys.join(stored.select(on), on, "left_semi")


def unknown(keys: DataFrame, stored: DataFrame, on: str) -> DataFrame:
    return keys.join(stored.select(on), on, "left_anti")


def browse(jobs: DataFrame, as_of: str, n: int = 20, seed: str = "0") -> DataFrame:
    """n of the newest 5n (at most 250) fresh postings, in the order of a seeded hash."""
    pool = newest(fresh(jobs, as_of), ["id", "title"], min(5 * n, 250), "crawled_at")
    return pool.orderBy(F.md5(F.concat(F.lit(seed), "id")), "id").limit(min(n, 50))


def latest(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of every key in a given order. Keys are spread by the shuffle; within one, only the best row is kept:
    an aggregate with a map-side step, so a key that holds a third of all rows is one row a task."""
    packed = F.struct(*[F.col(c) for c in rows.columns])
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = rows.select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], packed.alias("_row"), F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)]).alias("_order"))
    return keyed.groupBy(*names).agg(F.max_by("_row", "_order").alias("_row")).select("_row.*")


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
