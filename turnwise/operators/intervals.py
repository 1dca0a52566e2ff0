"""Intervals per entity: continuous periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.operators.ordering import grouped_running, paired_boundaries
from turnwise.session import staged


def periods_and_gaps(df: DataFrame, entity: str, start_seconds: str, end_seconds: str) -> DataFrame:
    """(entity, kind, start_ms, end_ms): each entity's longest covered stretches (`period`) and the gaps between them.

    Starts and ends are sorted independently. Behind the end of rank k lies a gap exactly where the start of rank k+1
    lies after it: k intervals have then begun and as many ended. The first start and the starts behind gaps, paired in
    rank order with the ends before gaps and the last end, are the periods. Equal times are counted before they are
    ranked, so a time that a third of all rows share is one row; a value of n copies then holds the ranks up to its
    running count, and only its last one as an end, and its first as a start, can stand at a gap. Ranks come from value
    buckets, so an entity that holds most rows is spread over tasks; joins are on (entity, rank).

    Times count in whole milliseconds, rounded half up. Defined results: an interval with a null or NaN time, or whose
    end does not lie after its start, covers nothing; touching intervals continue a period; repeated rows change
    nothing; a null entity is an entity; an empty input gives no rows. Other columns are ignored, whatever their names.
    """
    ms = lambda c: F.floor(F.col(c).cast("double") * 1000 + 0.5).cast("bigint")
    real = ~F.isnan(F.col(start_seconds).cast("double")) & ~F.isnan(F.col(end_seconds).cast("double"))
    spans = df.filter(real).select(F.struct(F.col(entity)).alias("entity"), ms(start_seconds).alias("s"), ms(end_seconds).alias("e")).filter("e > s")
    counted = lambda c: grouped_running(spans.groupBy("entity", c).agg(F.count(F.lit(1)).alias("n")), ["entity"], [c], F.col("n"), name="k")
    ends = counted("e").select("entity", "e", "k")
    starts = counted("s").select("entity", "s", (F.col("k") - F.col("n")).alias("k"))
    gaps = staged(ends.join(starts, ["entity", "k"]).filter("s > e").select("entity", "e", "s"))
    outer = spans.groupBy("entity").agg(F.min("s").alias("first"), F.max("e").alias("last"))
    opened = gaps.select("entity", "s").union(outer.select("entity", "first"))
    closed = gaps.select("entity", "e").union(outer.select("entity", "last"))
    periods = paired_boundaries(opened, closed, ["entity"], ["s"], ["e"])
    shaped = lambda d, kind, a, b: d.select(F.col(f"entity.{entity}").alias(entity), F.lit(kind).alias("kind"), F.col(a).alias("start_ms"), F.col(b).alias("end_ms"))
    return shaped(periods, "period", "s", "e").unionByName(shaped(gaps, "gap", "e", "s"))


__all__ = ["periods_and_gaps"]
