"""Sources mixed to target shares, by hierarchical budgets and seeded epochs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.operators.ordering import grouped_running
from turnwise.session import staged

#: Leaves of the budget tree, at most; they are names of domains, languages and sources, not data.
LEAVES_MAX = 100_000


def spread(budget: float, weights: Sequence[float], capacities: Sequence[float]) -> list[float]:
    """Shares a budget among siblings by weight. What a full one cannot take goes to its siblings, by weight, until
    the budget is spent or all are full; siblings without weight take part only when all others are full."""
    out = [0.0] * len(weights)
    left = min(budget, sum(capacities))
    open_ = [i for i, c in enumerate(capacities) if c > 0]
    while left > 1e-9 and open_:
        weight = sum(weights[i] for i in open_)
        part = {i: left * (weights[i] / weight if weight > 0 else 1 / len(open_)) for i in open_}
        full = [i for i in open_ if part[i] >= capacities[i] - out[i]]
        if not full:
            for i in open_:
                out[i] += part[i]
            break
        for i in full:
            left -= capacities[i] - out[i]
            out[i] = capacities[i]
        open_ = [i for i in open_ if i not in full and weights[i] + (weight <= 0) > 0] or [i for i in open_ if i not in full]
    return out


def budgets(paths: Sequence[tuple], weights: dict[tuple, float], capacities: Sequence[float], total: float) -> list[float]:
    """Budget of every leaf of a tree.

    `paths` are the leaves' ways from the root, `weights` the weights of nodes (by path) among their siblings. A budget
    is split top down; a shortage below a node is made up by its siblings before its ancestors', because every node
    enters with the capacity of all leaves below it.
    """
    out = [0.0] * len(paths)

    def descend(members: list[int], depth: int, budget: float) -> None:
        if not members:
            return
        if len(members) == 1 and len(paths[members[0]]) == depth:
            out[members[0]] = min(budget, capacities[members[0]])
            return
        children: dict[tuple, list[int]] = {}
        for i in members:
            children.setdefault(paths[i][: depth + 1], []).append(i)
        names = list(children)
        caps = [sum(capacities[i] for i in children[c]) for c in names]
        for c, b in zip(names, spread(budget, [weights.get(c, 0.0) for c in names], caps)):
            descend(children[c], depth + 1, b)

    descend(list(range(len(paths))), 0, total)
    return out


def whole_budgets(budget: Sequence[float], capacities: Sequence[int]) -> list[int]:
    """Budgets in whole tokens with the same rounded sum, none above its capacity: largest remainders are raised."""
    out = [min(int(b), c) for b, c in zip(budget, capacities)]
    short = round(sum(budget)) - sum(out)
    for i in sorted(range(len(out)), key=lambda i: (out[i] - budget[i], i)):
        step = min(1, capacities[i] - out[i], short)
        if step > 0:
            out[i] += step
            short -= step
    return out


def mix_sources(
    df: DataFrame, item_id: str, size: str, source: str, language: str, targets: DataFrame, total: float | None = None, seed: int = 17, domain: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Items with the tokens that each epoch uses of them, and the report of shares.

    `targets` has (source, target_share, max_repeats) and may have a column named by `domain`; without it all sources
    are of one domain. The budget `total`, by default the size of all items of the named sources, goes down a tree of
    domains, languages and sources. A leaf, one source in one language, weighs its source's share times its part of the
    source's tokens, an inner node the sum of its leaves. A leaf that cannot fill its budget within `max_repeats` leaves
    the rest to its siblings, the other sources of its language and domain, by their weights; what those cannot take
    goes to the other languages of the domain, and then to the other domains, up to the root.

    A leaf's budget is filled by whole epochs and the token prefix of one more: its items come in an order drawn from
    the seed, the leaf and the epoch, and the item at the end of the budget is used in its first tokens only, so that
    every budget is met to the token. Prefixes are found by bucketed running sums, never in one task.

    Returns (item_id, source, language, size, copies, prefix_tokens) for the items used: `copies` whole uses, and
    `prefix_tokens` of one more use cut short (0 for all but one item of a leaf); and (source, target_share,
    max_repeats, available, budget, used, actual_share) for every target.

    Defined results: items of null sources, or of sources without a target, are left aside; a null language is a
    language; null and negative sizes count as zero, and such items come with the epochs they lie in; rows of one item
    that repeat count once; a source without items, or of share 0, uses nothing; shares are scaled to sum to 1;
    max_repeats below 1 or null counts as 0; empty inputs give empty results or zeros; other columns are ignored,
    whatever their names.
    """
    above = F.coalesce(F.col(domain).cast("string"), F.lit("")) if domain else F.lit("")
    named = targets.select(F.col("source").alias("src"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("most"), above.alias("dom")).filter("src is not null").dropDuplicates(["src"])
    goal = named.limit(LEAVES_MAX + 1).collect()
    if len(goal) > LEAVES_MAX:
        raise ValueError("too many sources for one budget tree")
    kind = df.schema[item_id].dataType
    items = df.select(F.struct(F.col(item_id).alias("id")).alias("item"), F.col(source).alias("src"), F.coalesce(F.col(language), F.lit("")).alias("lang"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("n"))
    items = staged(items.join(F.broadcast(named.select("src")), "src", "left_semi").dropDuplicates(["item"]))  # bounded by LEAVES_MAX
    leaves = items.groupBy("src", "lang").agg(F.sum("n").alias("n")).limit(LEAVES_MAX + 1).collect()
    if len(leaves) > LEAVES_MAX:
        raise ValueError("too many leaves for one budget tree")
    shares = {g["src"]: max(0.0, g["share"] or 0.0) for g in goal}
    most = {g["src"]: max(0, g["most"] or 0) for g in goal}
    dom = {g["src"]: g["dom"] for g in goal}
    leaves = sorted(leaves, key=lambda r: (r["src"], r["lang"]))
    have: dict[str, int] = {}
    for r in leaves:
        have[r["src"]] = have.get(r["src"], 0) + r["n"]
    paths = [(dom[r["src"]], r["lang"], r["src"]) for r in leaves]
    weights: dict[tuple, float] = {}
    for p, r in zip(paths, leaves):
        for depth in range(1, 4):
            weights[p[:depth]] = weights.get(p[:depth], 0.0) + shares[r["src"]] * r["n"] / max(1, have[r["src"]])
    caps = [r["n"] * most[r["src"]] if shares[r["src"]] > 0 else 0 for r in leaves]
    spent = whole_budgets(budgets(paths, weights, [float(c) for c in caps], float(sum(have.values()) if total is None else total)), caps)
    plan = []
    for r, b in zip(leaves, spent):
        whole = min(b // r["n"], most[r["src"]]) if r["n"] else 0
        plan.append((r["src"], r["lang"], int(whole), int(b - whole * r["n"])))
    spark = df.sparkSession
    leaf = spark.createDataFrame(plan, "src string, lang string, whole int, prefix bigint")
    drawn = items.join(F.broadcast(leaf), ["src", "lang"])  # bounded by LEAVES_MAX
    drawn = drawn.withColumn("draw", F.shiftrightunsigned(F.xxhash64("item.id", "src", "lang", "whole", F.lit(seed)), 1))
    drawn = grouped_running(drawn, ["src", "lang"], ["draw", "item"], F.col("n"), name="reach", bucket=F.shiftright("draw", 51))
    fits = (F.col("reach") <= F.col("prefix")) & (F.col("n") > 0)
    cut = F.greatest(F.lit(0), F.when(F.col("reach") > F.col("prefix"), F.col("prefix") - (F.col("reach") - F.col("n"))).otherwise(F.lit(0)))
    drawn = drawn.withColumn("copies", F.col("whole") + fits.cast("int")).withColumn("cut", cut.cast("bigint"))
    used = staged(drawn.filter("copies > 0 or cut > 0").select("item", "src", "lang", "n", "copies", "cut"))
    taken = {r["src"]: r["used"] for r in used.groupBy("src").agg(F.sum(F.col("n") * F.col("copies") + F.col("cut")).alias("used")).collect()}  # one row per target at most
    planned: dict[str, int] = {}
    for r, b in zip(leaves, spent):
        planned[r["src"]] = planned.get(r["src"], 0) + b
    whole_share, everything = sum(shares.values()) or 1.0, sum(taken.values()) or 1
    rows = [(s, shares[s] / whole_share, most[s], have.get(s, 0), float(planned.get(s, 0)), taken.get(s, 0), taken.get(s, 0) / everything) for s in sorted(shares)]
    report = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, available bigint, budget double, used bigint, actual_share double")
    out = used.select(F.col("item.id").cast(kind).alias(item_id), F.col("src").alias("source"), F.col("lang").alias("language"), F.col("n").alias("size"), "copies", F.col("cut").alias("prefix_tokens"))
    return out, report
