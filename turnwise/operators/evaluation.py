"""Run timing, cold references, run comparison and score summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.operators.joins import keyed_join
from turnwise.operators.ordering import exact_percentiles, grouped_running

#: Statuses under which a stage did its own work.
EXECUTED = ("executed", "failed")
# Weights and bounds of the run quality signal.
QUALITY_WEIGHT, VOLUME_WEIGHT, SAFETY_WEIGHT = 0.45, 0.35, 0.20
QUALITY_HIGH, QUALITY_MEDIUM = 0.72, 0.50
# Parts of a key that mark a secret.
SECRET_KEYS = "token|secret|password|api_key|auth"


def exact_sum(seconds: Column) -> Column:
    """Sum of seconds in whole microseconds, which does not depend on the order of addition."""
    return F.sum(F.round(seconds * 1e6).cast("bigint")) / 1e6


def timing_summary(stages: DataFrame) -> DataFrame:
    """Per run: stage counts by status and reuse, the costliest stage (the first of equal ones), total and label.

    Label: `forced` with any forced stage, `cold` without reuse, `warm` if no more stages executed than were reused,
    else `mixed`. Null durations count as zero.
    """
    cost = F.coalesce("duration_seconds", F.lit(0.0))
    tally = lambda c: F.count(F.when(c, 1))
    runs = stages.groupBy("session_id", "run_id").agg(
        F.count(F.lit(1)).alias("stages"),
        tally(F.col("status").isin(*EXECUTED)).alias("executed"),
        tally(F.col("status") == "reused").alias("reused"),
        tally(F.col("status") == "skipped").alias("skipped"),
        tally(F.col("status") == "failed").alias("failed"),
        tally(F.col("used_cache")).alias("cache_hits"),
        tally(F.col("used_existing_artifact")).alias("artifact_hits"),
        tally(F.col("forced_recompute")).alias("forced"),
        exact_sum(cost).alias("total_seconds"),
        F.min_by("stage_name", F.struct((-cost).alias("c"), "ordinal")).alias("costliest_stage"),
    )
    label = F.when(F.col("forced") > 0, "forced").when(F.col("reused") == 0, "cold").when(F.col("executed") <= F.col("reused"), "warm").otherwise("mixed")
    return runs.withColumn("run_label", label)


def stage_status(stages: DataFrame) -> DataFrame:
    """Per session and stage: reused from cache or artifact if all its rows were, else executed, forced or not."""
    flags = stages.groupBy("session_id", "stage_name").agg(F.bool_and("used_cache").alias("c"), F.bool_and("used_existing_artifact").alias("a"), F.bool_or("forced_recompute").alias("f"))
    status = F.when(F.col("c"), "reused_from_cache").when(F.col("a"), "reused_from_artifact").when(F.col("f"), "executed_forced").otherwise("executed")
    return flags.select("session_id", "stage_name", status.alias("stage_status"))


def cold_references(stages: DataFrame) -> DataFrame:
    """Stage rows whose duration is a true cost: executed, not reused, longer than zero."""
    return stages.filter((F.col("status") == "executed") & ~F.col("used_cache") & ~F.col("used_existing_artifact") & (F.col("duration_seconds") > 0))


def reference_choice(references: DataFrame, keys: Sequence[str], sample_id: str, duration: str, name: str) -> DataFrame:
    """(keys, <name>_seconds, <name>_sample): per group the sample closest to the median (to a microsecond), the first on ties."""
    middle = exact_percentiles(references, keys, duration, {"_median": 0.5})
    both = keyed_join(references, middle.drop("n"), keys).select(*keys, sample_id, duration, "_median")
    best = F.struct(F.round(F.abs(F.col(duration) - F.col("_median")), 6).alias("d"), F.col(sample_id).alias("s"))
    return both.groupBy(*keys).agg(F.min_by(duration, best).alias(f"{name}_seconds"), F.min_by(sample_id, best).alias(f"{name}_sample"))


def cold_equivalents(stages: DataFrame, tiers: Sequence[Sequence[str]]) -> DataFrame:
    """Per run: own durations plus, for reused stages, the reference of the first tier that has one.

    A run with a reused stage for which no tier has a reference is incomplete and has no total.
    """
    refs = cold_references(stages)
    rows = stages
    for i, keys in enumerate(tiers):
        picked = reference_choice(refs, keys, "timing_id", "duration_seconds", f"t{i}").select(*keys, f"t{i}_seconds")
        rows = keyed_join(rows, picked, keys, "left")
    reused = F.col("status") == "reused"
    cost = F.when(reused, F.coalesce(*[F.col(f"t{i}_seconds") for i in range(len(tiers))])).otherwise(F.coalesce("duration_seconds", F.lit(0.0)))
    runs = rows.groupBy("run_id").agg(exact_sum(cost).alias("s"), F.bool_and(cost.isNotNull()).alias("complete"), F.count(F.when(reused, 1)).alias("replaced_stages"))
    return runs.select("run_id", F.when(F.col("complete"), F.col("s")).alias("cold_equivalent_seconds"), "complete", "replaced_stages")


def oldest_cold_run(stages: DataFrame) -> DataFrame:
    """Per session: the oldest run that reused nothing, its total, and the sum of the longest executions of stages it lacks."""
    runs = stages.groupBy("session_id", "run_id").agg(F.min("started_at").alias("began"), F.bool_or(F.col("status") == "reused").alias("warm"))
    first = runs.filter(~F.col("warm")).groupBy("session_id").agg(F.min_by("run_id", F.struct("began", "run_id")).alias("cold_run"))
    own = stages.filter(F.col("status").isin(*EXECUTED)).join(first, "session_id")
    longest = own.groupBy("session_id", "cold_run", "stage_name").agg(
        F.max(F.when(F.col("run_id") == F.col("cold_run"), F.col("duration_seconds"))).alias("mine"), F.max("duration_seconds").alias("longest")
    )
    return longest.groupBy("session_id", "cold_run").agg(F.sum(F.coalesce("mine", "longest")).alias("reference_seconds"), F.count(F.when(F.col("mine").isNull(), 1)).alias("filled_stages"))


def resumable(stages: DataFrame) -> DataFrame:
    """Per session: whether its first run (by id) may be resumed, that is, has no failed stage."""
    runs = stages.groupBy("session_id", "run_id").agg(F.bool_or(F.col("status") == "failed").alias("failed"))
    return runs.groupBy("session_id").agg(F.min("run_id").alias("run_id"), (~F.min_by("failed", "run_id")).alias("resumable"))


def canonical_label(path: Column) -> Column:
    """File name without folder and extension in lower case, unsafe characters as `_`, without leading number and
    trailing sample-rate mark."""
    base = F.lower(F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", ""))
    safe = F.regexp_replace(F.regexp_replace(base, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.regexp_replace(F.regexp_replace(safe, r"^[0-9]+_", ""), r"_mono_[0-9]+hz$", "")


def redacted(text: Column) -> Column:
    """JSON text with the values of secret-looking keys replaced."""
    return F.regexp_replace(text, rf'("[^"]*(?:{SECRET_KEYS})[^"]*"\s*:\s*)("(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|true|false|null)', '$1"<redacted>"')


def rankings(values: DataFrame, item: str, measures: dict[str, bool]) -> DataFrame:
    """(ranking, place, item, value): one ranking per measure; True: highest first, the larger id first on ties."""
    parts = []
    for name, high in measures.items():
        rows = values.filter(F.col(name).isNotNull()).select(F.lit(name).alias("ranking"), F.col(item).alias("item"), F.col(name).cast("double").alias("value"), F.lit(high).alias("high"))
        parts.append(rows)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    up = grouped_running(out, ["ranking"], ["value", "item"], name="up")
    size = out.groupBy("ranking").agg(F.count(F.lit(1)).alias("n"))
    place = F.when(F.col("high"), F.col("n") - F.col("up") + 1).otherwise(F.col("up"))
    return up.join(F.broadcast(size), "ranking").select("ranking", place.alias("place"), F.col("item").alias(item), "value")  # one row per measure


def score_distribution(df: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Per group: count, min, avg, median and max of a score; groups without scores have a count of 0 and nulls."""
    base = df.groupBy(*keys).agg(F.count(score).alias("n"), F.min(score).alias("low"), F.avg(score).alias("mean"), F.max(score).alias("high"))
    middle = exact_percentiles(df, keys, score, {"median": 0.5}).drop("n")
    return keyed_join(base, middle, keys, "left")


def band(score: Column, high: float, medium: float) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def top_reasons(df: DataFrame, keys: Sequence[str], reasons: str, k: int) -> DataFrame:
    """Per group the `k` most frequent entries of an array column, ties by name."""
    counts = df.select(*keys, F.explode(reasons).alias("reason")).groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "reason")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def run_quality(df: DataFrame, keys: Sequence[str], quality: str, risk: str) -> DataFrame:
    """Per group the quality signal: median quality, number of good candidates, and absence of risk, weighted."""
    middle = exact_percentiles(df, keys, quality, {"median_quality": 0.5}).drop("n")
    q, r = F.col(quality), F.col(risk)
    base = df.groupBy(*keys).agg(
        F.count(F.when(q >= QUALITY_HIGH, 1)).alias("high"), F.count(F.when((q >= QUALITY_MEDIUM) & (q < QUALITY_HIGH), 1)).alias("medium"),
        F.avg(r).alias("risk"), F.avg((r >= 0.55).cast("double")).alias("high_risk"),
    )
    both = keyed_join(base, middle, keys)
    volume = F.least(F.lit(1.0), (F.col("high") + 0.4 * F.col("medium")) / 10)
    safety = F.greatest(F.lit(0.0), 1 - 0.8 * F.col("risk") - 0.2 * F.col("high_risk"))
    signal = QUALITY_WEIGHT * F.col("median_quality") + VOLUME_WEIGHT * volume + SAFETY_WEIGHT * safety
    return both.select(*keys, "median_quality", "high", "medium", signal.alias("quality_signal"), band(signal, QUALITY_HIGH, QUALITY_MEDIUM).alias("quality_band"))
