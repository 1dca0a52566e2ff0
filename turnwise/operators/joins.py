"""Joins that the transcript operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of the same names, null keys matching each other; the right keys are dropped."""
    named = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same: Column = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(named, same, how).drop(*[f"_right_{k}" for k in keys])


def overlap_join(left: DataFrame, right: DataFrame, entity: str, left_span: tuple[str, str], right_span: tuple[str, str], bin_seconds: float) -> DataFrame:
    """Pairs of intervals of one entity that overlap by more than nothing, as (left columns, right columns, overlap).

    Both sides are cut into bins of `bin_seconds` and joined on (entity, bin), so a hot entity is spread over its bins
    and no side is compared with all of the other; a pair is kept in the first bin that both reach. Column names of the
    two sides must differ, apart from `entity`. Intervals that are null or not longer than zero overlap nothing.
    """
    a, b = left_span
    c, d = right_span
    bins = lambda s, e: F.sequence(F.floor(F.col(s) / bin_seconds), F.floor(F.col(e) / bin_seconds))
    lo = left.filter(F.col(b) > F.col(a)).withColumn("_bin", F.explode(bins(a, b)))
    hi = right.filter(F.col(d) > F.col(c)).withColumnRenamed(entity, "_entity").withColumn("_right_bin", F.explode(bins(c, d)))
    both = lo.join(hi, (F.col(entity) == F.col("_entity")) & (F.col("_bin") == F.col("_right_bin")))
    first = F.col("_bin") == F.floor(F.greatest(a, c) / bin_seconds)
    overlap = F.least(b, d) - F.greatest(a, c)
    return both.filter(first).withColumn("overlap", overlap).filter("overlap > 0").drop("_bin", "_right_bin", "_entity")
