"""One ranking from several scores on different scales."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.operators.ordering import grouped_running
from turnwise.session import staged


def rank_scores(df: DataFrame, group: str, item: str, scores: Sequence[str]) -> DataFrame:
    """(group, item, z_<score>...): each score as its centred fractional rank inside the group, from -1/2 to 1/2.

    Equal scores share their mean rank; a missing score (null or NaN) stays null. Equal scores are counted first, and
    the counts, one row a value, are ranked in value buckets: neither a group, nor missing scores, nor a value that a
    third of the rows share is held in one task.
    """
    out = df.select(F.struct(F.col(group).alias("g")).alias("g"), F.struct(F.col(item).alias("i")).alias("i"), *[F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double")).alias(f"v{j}") for j, s in enumerate(scores)])
    out = staged(out)
    long = out.select("g", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"v{j}").alias("v")) for j in range(len(scores))])).alias("x")).select("g", "x.j", "x.v").filter("v is not null")
    counts = long.groupBy("g", "j", "v").agg(F.count(F.lit(1)).alias("n"))
    ranked = grouped_running(counts, ["g", "j"], ["v"], F.col("n"), name="upto")
    totals = counts.groupBy("g", "j").agg(F.sum("n").alias("total"))
    z = (F.col("upto") - F.col("n") / 2) / F.col("total") - 0.5
    placed = staged(ranked.join(totals, ["g", "j"]).select("g", "j", "v", z.alias("z")))
    for j in range(len(scores)):
        own = placed.filter(F.col("j") == j).select("g", F.col("v").alias(f"v{j}"), F.col("z").alias(f"z{j}"))
        out = out.join(own, ["g", f"v{j}"], "left")
    return out.select(F.col("g.g").alias(group), F.col("i.i").alias(item), *[F.col(f"z{j}").alias(f"z_{s}") for j, s in enumerate(scores)])


def first_component(ranked: DataFrame, columns: Sequence[str], directions: Sequence[int]) -> list[float]:
    """Loadings of the first principal component of the columns' correlation matrix, from one distributed aggregation.

    Correlations come from the rows that have both values. The component's sign is the one under which the loadings
    agree best with the declared directions. A score whose loading still runs against its declaration would work against
    it in the ranking: such scores are left out (loading 0) and the component is found again without them, so that what
    is projected on is always the first component of the scores in use. Columns without spread have no loading; where
    all lack it, all weigh alike.
    """
    n = len(columns)
    x = [F.col(c) for c in columns]
    sums = []
    for a in range(n):
        for b in range(a, n):
            both = x[a].isNotNull() & x[b].isNotNull()
            sums += [F.sum(F.when(both, x[a] * x[b])), F.sum(F.when(both, x[a] * x[a])), F.sum(F.when(both, x[b] * x[b]))]
    row = [v or 0.0 for v in ranked.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    corr, at = np.zeros((n, n)), 0
    for a in range(n):
        for b in range(a, n):
            xy, xx, yy = row[at : at + 3]
            at += 3
            corr[a, b] = corr[b, a] = xy / np.sqrt(xx * yy) if xx > 0 and yy > 0 else 0.0
    sign = np.array(directions, float)
    if not corr.any():
        return list(sign / np.sqrt(n))
    oriented, used = corr * np.outer(sign, sign), list(range(n))
    out = np.zeros(n)
    while used:
        part = oriented[np.ix_(used, used)]
        if not part.any():
            break
        values, vectors = np.linalg.eigh(part)
        first = vectors[:, int(np.argmax(values))]
        first = first if first.sum() >= 0 else -first
        against = [k for k, v in zip(used, first) if v < -1e-9]
        if not against:
            out[used] = np.maximum(first, 0.0)
            break
        used = [k for k in used if k not in against]
    return [float(v) for v in out * sign]


def combined_ranking(df: DataFrame, group: str, item: str, directions: dict[str, int], with_place: bool = True) -> DataFrame:
    """(group, item, projection, place): one ranking of each group's items from several scores, place 1 being the best.

    `directions` names the score columns, each with 1 (a high score speaks for the item) or -1. Scores become fractional
    ranks inside their group, so neither scale nor distribution counts; items are sorted by their projection on the
    first principal component, best first, ties by item. An item that lacks scores is projected on the component's part
    that belongs to its own scores, scaled to unit length, so that a missing score speaks neither for nor against it.
    Without `with_place` the last column is left out, for a caller that only wants the best few (`best_of`).

    Defined results: an item with no score at all has projection 0; rows of one item that
    repeat count once, each score by its largest value if they differ; a null group is a group; an empty input gives no
    rows; other columns are ignored, whatever their names.
    """
    names = list(directions)
    once = df.groupBy(F.col(group).alias("_group"), F.col(item).alias("_item")).agg(*[F.max(F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double"))).alias(f"_s{j}") for j, s in enumerate(names)])
    ranked = rank_scores(once, "_group", "_item", [f"_s{j}" for j in range(len(names))])
    zs = [f"z__s{j}" for j in range(len(names))]
    loadings = first_component(ranked, zs, [directions[s] for s in names])
    total: Column = F.lit(0.0)
    length: Column = F.lit(0.0)
    for z, w in zip(zs, loadings):
        total = total + F.coalesce(F.col(z), F.lit(0.0)) * F.lit(w)
        length = length + F.when(F.col(z).isNotNull(), F.lit(w * w)).otherwise(0.0)
    projection = F.when(length > 0, total / F.sqrt(length)).otherwise(F.lit(0.0))
    projected = ranked.select("_group", "_item", projection.alias("_projection"))
    if not with_place:
        return projected.select(F.col("_group").alias(group), F.col("_item").alias(item), F.col("_projection").alias("projection"))
    placed = grouped_running(projected.withColumn("_down", -F.col("_projection")), ["_group"], ["_down", "_item"], name="_place")
    return placed.select(F.col("_group").alias(group), F.col("_item").alias(item), F.col("_projection").alias("projection"), F.col("_place").alias("place"))


def best_of(ranking: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """The `k` best items of each group with their place. The limit is applied before the shuffle too, so a hot group
    stays small."""
    order = Window.partitionBy(group).orderBy(F.col("projection").desc(), F.col(item))
    return ranking.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
