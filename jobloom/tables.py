"""Readers of the input tables: one parquet file or folder each, below one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table. Timestamps without zone become UTC instants."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    ntz = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


def rows_of(df: DataFrame, limit: int, what: str) -> list:
    """All rows of a small reference table, after a check of its size: it is going to be sent to every task."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; it is meant to be a small reference table")
    return rows


def hash_sample(df: DataFrame, columns: list[str], key: str, rows: int, known: int, seed: int = 7) -> list:
    """At most about `rows` rows of `columns` by a seeded hash of the key, in the order of that hash.

    known: how many rows df has. Every row has the same chance wherever it lies; the share is set below rows / known, so
    that the limit behind it, which keeps the driver safe, doesn't bite. The same data give the same sample.
    """
    share = min(1.0, 0.85 * rows / max(1, known))
    h = F.xxhash64(F.lit(seed), F.col(key))
    part = df if known <= rows else df.where(F.shiftrightunsigned(h, 1) < int(share * (1 << 63)))
    got = part.select(h.alias("_h"), *columns).limit(2 * rows).collect()
    return [r[1:] for r in sorted(got, key=lambda r: (r[0], repr(r[1:])))]
