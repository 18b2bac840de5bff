"""Stateful behaviours on streams: deduplication by key within a time bound, and sessions folded turn by turn."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_stream(events: DataFrame, key: str, time: str = "ts", bound: str = "60 days") -> DataFrame:
    """First event of every key; state is dropped once the watermark is past it."""
    return events.withWatermark(time, bound).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, key: str, time: str = "ts", gap: str = "7 days", bound: str = "1 day") -> DataFrame:
    """(key, start, end, n): events of a key with no gap longer than `gap` between them; works on streams and tables."""
    rows = events.withWatermark(time, bound) if events.isStreaming else events
    window = F.session_window(time, gap)
    return rows.groupBy(key, window.alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def rescore_points(lengths: list[int], growth: float = 1.3) -> list[bool]:
    """Whether each text is scored again: only when it grew past `growth` times the last scored length."""
    last, out = 0, []
    for n in lengths:
        again = n > last * growth
        out.append(again)
        last = n if again else last
    return out


def fold_rescores(turns: DataFrame, key: str, order: str, length: str) -> DataFrame:
    """(key, order, rescore) for streams of turns; the last scored length is the state of a key."""
    kinds = dict(turns.dtypes)

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        last = state.get[0] if state.exists else 0
        pdf = pd.concat(list(batches)).sort_values(order)
        again = []
        for n in pdf[length]:
            again.append(n > last * 1.3)
            last = int(n) if again[-1] else last
        state.update((last,))
        yield pd.DataFrame({key: pdf[key], order: pdf[order], "rescore": again})

    return turns.groupBy(key).applyInPandasWithState(fold, f"{key} {kinds[key]}, {order} {kinds[order]}, rescore boolean", "last long", "append", "NoTimeout")


def fold_fields(turns: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """(key, order, fields) for streams of turns: every field keeps its first stated value, turns in order within a key.

    The state of a key is kept as long as the query runs.
    """
    kinds = dict(turns.dtypes)
    shape = ", ".join(f"{f} string" for f in fields)

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        known = list(state.get) if state.exists else [None] * len(fields)
        pdf = pd.concat(list(batches)).sort_values(order)
        rows = []
        for _, turn in pdf.iterrows():
            known = [k if k else (v if isinstance(v, str) and v.strip() else k) for k, v in zip(known, (turn[f] for f in fields), strict=True)]
            rows.append((turn[key], turn[order], *known))
        state.update(tuple(known))
        yield pd.DataFrame(rows, columns=[key, order, *fields])

    return turns.groupBy(key).applyInPandasWithState(fold, f"{key} {kinds[key]}, {order} {kinds[order]}, {shape}", shape, "append", "NoTimeout")
