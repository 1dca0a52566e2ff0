"""Exact ranks and running sums inside groups of any size.

A window over one hot group would put that group into one task. Here the group is cut into value buckets, each bucket
is ordered on its own, and the buckets' totals, of which there are few, give every bucket its offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.operators.joins import keyed_join
from turnwise.session import staged

MANTISSA = 4096
#: Rows of one bucket from which it is divided by ranges of the whole order.
HOT_ROWS = 1_000_000
#: Bytes of the files read (the optimizer's figure) from which hot buckets are looked for at all.
LOOK_FROM = 64 << 20


def value_bucket(value: Column, mantissa: int = MANTISSA) -> Column:
    """A BIGINT that never falls as `value` rises: binary exponent and the leading bits of the mantissa.

    Each power of two holds `mantissa` buckets, so that the split needs no knowledge of the data. Infinities and NaN
    fall into the outermost buckets, null gives null.
    """
    v = value.cast("double")
    size = F.abs(v)
    exponent = F.least(F.greatest(F.floor(F.log2(size)), F.lit(-300)), F.lit(1023))
    key = (exponent + 301) * mantissa + F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * mantissa)
    top = F.lit(3000 * mantissa).cast("bigint")
    key = F.when(size == 0, F.lit(0)).when(F.isnan(v) | (size == float("inf")), top).otherwise(F.greatest(key, F.lit(1)))
    return F.when(v.isNull(), None).when((v < 0) & ~F.isnan(v), -key).otherwise(key).cast("bigint")


def _read_bytes(df: DataFrame) -> int:
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def divided_buckets(cut: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], hot_rows: int | None = None) -> DataFrame:
    """Adds `_ord_part`: 0, and in buckets of over `hot_rows` rows, such as those of one repeated value, the number of a
    range of the whole order, so that no bucket is one task whatever the ties.

    Ranges come from Spark's range partitioning over (keys, bucket, order), written once so that they stay fixed. Where
    no bucket is hot, which one small aggregation tells, nothing is moved.
    """
    plain = cut.withColumn("_ord_part", F.lit(0))
    if _read_bytes(cut) < LOOK_FROM:
        return plain
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    named = [F.col(k).alias(f"_hot_{i}") for i, k in enumerate(keys)]
    hot = staged(cut.groupBy(*named, F.col(bucket).alias("_hot_b")).agg(F.count(F.lit(1)).alias("_hot_n")).filter(F.col("_hot_n") > hot_rows))
    total = hot.agg(F.sum("_hot_n")).first()[0]
    if not total:
        return plain
    same = F.col(bucket).eqNullSafe(F.col("_hot_b"))
    for i, k in enumerate(keys):
        same = same & cut[k].eqNullSafe(F.col(f"_hot_{i}"))
    parts = int(min(20_000, max(2, -(-total // max(1, hot_rows // 2)))))
    ranged = cut.join(hot, same, "left_semi").repartitionByRange(parts, *keys, bucket, *order)
    divided = staged(ranged.withColumn("_ord_part", F.spark_partition_id() + 1))
    return cut.join(hot, same, "left_anti").withColumn("_ord_part", F.lit(0)).unionByName(divided)


def grouped_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    weight: Column | None = None,
    name: str = "rank",
    bucket: Column | None = None,
    mantissa: int = MANTISSA,
    hot_rows: int | None = None,
) -> DataFrame:
    """Adds the running sum of `weight` (1 if not given: the rank) inside each `keys` group in `order`, ascending.

    `order[0]` must be numeric and not null unless `bucket` is given, which must never fall along `order`. Ties of all
    `order` columns are broken arbitrarily, so pass enough columns. Rows with null keys keep a group of their own.
    An empty input gives an empty output. Buckets of more than `hot_rows` rows (by default HOT_ROWS, looked for in inputs
    of LOOK_FROM bytes or more) are divided by ranges of the whole order. Existing columns called like the helper columns (`_ord_*`) are not allowed.
    """
    w = F.lit(1).cast("bigint") if weight is None else weight
    cut = df.withColumn("_ord_bucket", value_bucket(F.col(order[0]), mantissa) if bucket is None else bucket)
    cut = divided_buckets(cut.withColumn("_ord_weight", w), keys, "_ord_bucket", order, hot_rows)
    keyed = [F.col(k).alias(f"_ord_{i}") for i, k in enumerate(keys)]
    sums = cut.groupBy(*keyed, F.col("_ord_bucket").alias("_ord_b"), F.col("_ord_part").alias("_ord_p")).agg(F.sum("_ord_weight").alias("_ord_sum"))
    before = Window.partitionBy(*[f"_ord_{i}" for i in range(len(keys))]).orderBy("_ord_b", "_ord_p").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_ord_before", F.sum("_ord_sum").over(before) - F.col("_ord_sum")).drop("_ord_sum")
    same = (F.col("_ord_bucket") == F.col("_ord_b")) & (F.col("_ord_part") == F.col("_ord_p"))
    for i, k in enumerate(keys):
        same = same & cut[k].eqNullSafe(F.col(f"_ord_{i}"))
    inside = Window.partitionBy(*keys, "_ord_bucket", "_ord_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(sums, same).withColumn(name, F.col("_ord_before") + F.sum("_ord_weight").over(inside))
    return out.drop("_ord_bucket", "_ord_weight", "_ord_part", "_ord_b", "_ord_p", "_ord_before", *[f"_ord_{i}" for i in range(len(keys))])


def paired_boundaries(
    starts: DataFrame, ends: DataFrame, keys: Sequence[str], start_order: Sequence[str], end_order: Sequence[str]
) -> DataFrame:
    """Pairs the k-th start with the k-th end of each group, both ordered on their own."""
    a = grouped_running(starts, keys, start_order, name="_pair_rank")
    b = grouped_running(ends, keys, end_order, name="_pair_rank")
    return a.join(b, [*keys, "_pair_rank"]).drop("_pair_rank")


def windowed(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: dict[str, tuple[str, Column]], bucket: Column | None = None, mantissa: int = MANTISSA, hot_rows: int | None = None) -> DataFrame:
    """Window columns over groups of any size; `cols` maps names to (kind, column).

    Kinds: `sum` and `max` up to the row itself, `sum_before` and `max_before` without it, `last_before` the last
    value that is not null before it, `lag` and `lead` the neighbours' values. As in `grouped_running`, rows are
    ordered inside value buckets, and one small row per bucket carries the group's state from bucket to bucket. Nulls
    of `order[0]` need a `bucket`. Ties of all `order` columns are broken arbitrarily. Hot buckets are divided as in
    `grouped_running`.
    """
    cut = df.withColumn("_win_bucket", value_bucket(F.col(order[0]), mantissa) if bucket is None else bucket)
    wrap = {"lag", "lead", "last_before"}
    for name, (kind, col) in cols.items():
        value = F.struct(col.alias("v"))
        cut = cut.withColumn(f"_win_{name}", F.when(col.isNotNull(), value) if kind == "last_before" else value if kind in wrap else col)
    cut = divided_buckets(cut, keys, "_win_bucket", order, hot_rows)
    place = F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    summary = []
    for name, (kind, _) in cols.items():
        c = F.col(f"_win_{name}")
        if kind.startswith("sum"):
            summary.append(F.sum(c).alias(f"_sum_{name}"))
        elif kind.startswith("max"):
            summary.append(F.max(c).alias(f"_sum_{name}"))
        elif kind == "lead":
            summary.append(F.min_by(c, place).alias(f"_sum_{name}"))
        else:
            summary.append(F.max_by(c, F.when(c.isNotNull(), place)).alias(f"_sum_{name}"))
    names = [f"_key_{i}" for i in range(len(keys))]
    small = cut.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_win_bucket").alias("_b"), F.col("_ord_part").alias("_p")).agg(*summary)
    past = Window.partitionBy(*names).orderBy("_b", "_p").rowsBetween(Window.unboundedPreceding, -1)
    coming = Window.partitionBy(*names).orderBy("_b", "_p")
    for name, (kind, _) in cols.items():
        c = F.col(f"_sum_{name}")
        carried = F.sum(c).over(past) if kind.startswith("sum") else F.max(c).over(past) if kind.startswith("max") else F.lead(c).over(coming) if kind == "lead" else F.last(c, ignorenulls=True).over(past)
        small = small.withColumn(f"_carry_{name}", carried)
    same = F.col("_win_bucket").eqNullSafe(F.col("_b")) & (F.col("_ord_part") == F.col("_p"))
    for k, n in zip(keys, names):
        same = same & cut[k].eqNullSafe(F.col(n))
    inside = Window.partitionBy(*keys, "_win_bucket", "_ord_part").orderBy(*order)
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(small.drop(*[f"_sum_{n}" for n in cols]), same)
    for name, (kind, _) in cols.items():
        c, carry = F.col(f"_win_{name}"), F.col(f"_carry_{name}")
        if kind.startswith("sum"):
            own = F.sum(c).over(before if kind == "sum_before" else upto)
            made = F.coalesce(carry, F.lit(0)) + F.coalesce(own, F.lit(0))
        elif kind.startswith("max"):
            made = F.greatest(carry, F.max(c).over(before if kind == "max_before" else upto))
        elif kind == "lead":
            made = F.coalesce(F.lead(c).over(inside), carry)["v"]
        elif kind == "lag":
            made = F.coalesce(F.lag(c).over(inside), carry)["v"]
        else:
            made = F.coalesce(F.last(c, ignorenulls=True).over(before), carry)["v"]
        out = out.withColumn(name, made)
    gone = ["_win_bucket", "_ord_part", "_b", "_p", *names, *[f"_win_{n}" for n in cols], *[f"_carry_{n}" for n in cols]]
    return out.drop(*gone)


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """(keys, n, <point>...): exact percentiles with linear interpolation, without holding a group in one task.

    Null and NaN values are left out; a group of only such values has no row. An empty input gives no rows.
    """
    v = F.col(value).cast("double")
    known = df.filter(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v"))
    grouped = known.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = grouped_running(grouped, keys, ["_v"], F.col("_c"), name="_upto")
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    both = keyed_join(ranked, sizes if keys else F.broadcast(sizes), keys)  # without keys there is one row
    picks = []
    for name, p in points.items():
        at = F.lit(p) * (F.col("n") - 1) + 1
        for part, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            held = (F.col("_upto") >= place) & (F.col("_upto") - F.col("_c") < place)
            picks.append(F.max(F.when(held, F.col("_v"))).alias(f"_{name}_{part}"))
    wide = both.groupBy(*keys, "n").agg(*picks)
    for name, p in points.items():
        at = F.lit(p) * (F.col("n") - 1) + 1
        wide = wide.withColumn(name, F.col(f"_{name}_lo") + (at - F.floor(at)) * (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")))
    return wide.select(*keys, "n", *points)
