"""Streaming forms: sessions by silence, tumbling and sliding segments, running speaker shares.

The same functions work on batch frames, which the tests use to hold both against each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gap_sessions(df: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """(key, first, last, rows): rows of a key whose times are less than `gap` apart. Rows later than `late` are left out
    of a stream; a batch has no late rows."""
    timed = df.withWatermark(at, late) if df.isStreaming else df
    grouped = timed.groupBy(key, F.session_window(at, gap)).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("rows"))
    return grouped.select(key, "first", "last", "rows")


def window_counts(df: DataFrame, key: str, at: str, length: str, slide: str | None, late: str) -> DataFrame:
    """(key, window_start, window_end, rows, value): tumbling windows, or sliding ones if `slide` is given."""
    timed = df.withWatermark(at, late) if df.isStreaming else df
    span = F.window(at, length, slide) if slide else F.window(at, length)
    return timed.groupBy(key, span.alias("w")).agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("value")).select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "rows", "value")


def distinct_by_id(df: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """Rows delivered twice, once: by id within the watermark in a stream, by id in a batch."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if df.isStreaming else df.dropDuplicates([key])


def running_totals(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, rows, total) after every micro-batch, held as state per key; works on streams in update mode."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows, total = state.get if state.exists else (0, 0.0)
        for p in parts:
            rows, total = rows + len(p), total + float(p[value].sum())
        state.update((rows, total))
        yield pd.DataFrame({key: [k[0]], "rows": [rows], "total": [total]})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, rows bigint, total double", "rows bigint, total double", "update", "NoTimeout")
