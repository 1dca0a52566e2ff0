"""Speaker attribution by overlap, and smoothing of speaker runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.operators.joins import keyed_join, overlap_join
from turnwise.operators.ordering import windowed
from turnwise.session import staged

#: Least share of an utterance that its speaker must cover, and ratio of the runner-up from which it is ambiguous.
MIN_RATIO, AMBIGUOUS = 0.6, 0.85
#: A run is unstable below this duration or evidence, or, wholly degraded, up to this duration.
SHORT_RUN, LITTLE_EVIDENCE, DEGRADED_RUN = 1.25, 1.0, 1.75
BRIDGE_SECONDS = 0.5
BIN_SECONDS = 30.0
LOW_ENERGY, HIGH_CROSSING = 0.35, 0.22


def confidence(ratio: Column, top: Column, runner: Column, duration: Column, degraded: Column) -> Column:
    """Confidence of an attribution, from coverage, lead over the runner-up and overlap length."""
    lead = F.when(top > 0, 1 - runner / top).otherwise(1.0)
    raw = 0.55 * F.least(F.lit(1.0), ratio) + 0.25 * lead + 0.20 * F.least(F.lit(1.0), F.when(duration > 0, top / duration).otherwise(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw * F.when(degraded, 0.7).otherwise(1.0)))


def attribute_speakers(utterances: DataFrame, speech: DataFrame, source: str = "audio_source_id") -> DataFrame:
    """(utt_id, source, duration, speaker, status, top_overlap, runner_up, ratio, confidence) of every utterance.

    `utterances` has (utt_id, source, u_start, u_end), `speech` (source, speaker, s_start, s_end). Overlaps are summed
    by speaker over a binned interval join; the two speakers with most overlap decide, ties by name.
    """
    pairs = overlap_join(utterances, speech, source, ("u_start", "u_end"), ("s_start", "s_end"), BIN_SECONDS)
    sums = pairs.groupBy("utt_id", "speaker").agg(F.sum("overlap").alias("o"))
    place = F.row_number().over(Window.partitionBy("utt_id").orderBy(F.col("o").desc(), "speaker"))
    best = sums.withColumn("p", place).filter("p <= 2").groupBy("utt_id").agg(
        F.max(F.when(F.col("p") == 1, F.col("speaker"))).alias("top_speaker"), F.max(F.when(F.col("p") == 1, F.col("o"))).alias("top_overlap"), F.max(F.when(F.col("p") == 2, F.col("o"))).alias("runner_up")
    )
    rows = keyed_join(utterances, best, ["utt_id"], "left").withColumn("duration", F.col("u_end") - F.col("u_start"))
    rows = rows.withColumn("top_overlap", F.coalesce("top_overlap", F.lit(0.0))).withColumn("runner_up", F.coalesce("runner_up", F.lit(0.0)))
    rows = rows.withColumn("ratio", F.when(F.col("duration") > 0, F.col("top_overlap") / F.col("duration")).otherwise(0.0))
    status = (
        F.when(F.col("duration").isNull() | (F.col("duration") <= 0), "invalid_utterance_timing").when(F.col("top_overlap") <= 0, "no_overlap")
        .when(F.col("ratio") < MIN_RATIO, "low_overlap").when(F.col("runner_up") >= AMBIGUOUS * F.col("top_overlap"), "ambiguous_overlap").otherwise("assigned")
    )
    rows = rows.withColumn("status", status).withColumn("speaker", F.when(F.col("status") == "assigned", F.col("top_speaker")))
    score = confidence(F.col("ratio"), F.col("top_overlap"), F.col("runner_up"), F.col("duration"), F.lit(False))
    return rows.select("utt_id", source, "u_start", "u_end", "duration", "speaker", "status", "top_overlap", "runner_up", "ratio", F.when(F.col("status") == "assigned", score).otherwise(0.0).alias("confidence"))


def runs_of(df: DataFrame, source: str, order: list[str], speaker: str, start: str, end: str, evidence: str, degraded: str, name: str = "run_no") -> DataFrame:
    """Adds the number of the run of equal speakers (null is a speaker of its own) that a row belongs to."""
    seen = windowed(df.withColumn("_s", F.struct(F.col(speaker).alias("x"))), [source], order, {"_prev": ("lag", F.col("_s"))})
    change = (F.col("_prev").isNull() | ~F.col("_prev.x").eqNullSafe(F.col(speaker))).cast("bigint")
    marked = seen.withColumn("_change", change).drop("_s", "_prev")
    return windowed(marked, [source], order, {name: ("sum", F.col("_change"))}).drop("_change")


def run_table(rows: DataFrame, source: str, order: list[str], speaker: str, start: str, end: str, evidence: str, degraded: str, run: str = "run_no") -> DataFrame:
    """One row per run: speaker, times, duration, evidence and whether it is unstable."""
    place = F.struct(*order)
    runs = rows.groupBy(source, run).agg(
        F.min_by(speaker, place).alias("run_speaker"), F.min_by(start, place).alias("run_start"), F.max_by(end, place).alias("run_end"),
        F.sum(evidence).alias("evidence"), F.bool_and(degraded).alias("all_degraded"), F.count(F.lit(1)).alias("size"),
    )
    runs = runs.withColumn("run_duration", F.col("run_end") - F.col("run_start"))
    weak = (F.col("run_duration") < SHORT_RUN) | (F.col("evidence") < LITTLE_EVIDENCE) | (F.col("all_degraded") & (F.col("run_duration") <= DEGRADED_RUN))
    return runs.withColumn("unstable", weak)


def smooth_speakers(df: DataFrame, source: str, order: list[str], speaker: str, start: str, end: str, evidence: str, degraded: str) -> DataFrame:
    """Adds `smoothed` and `smoothing`, by passes over runs that are found anew for each pass.

    Short runs without a speaker between runs of one speaker take it (`bridged_gap`); unstable runs between runs of one
    other speaker take that (`smoothed_switch`); wholly degraded unstable runs take the speaker before
    (`kept_previous`). Neighbours are those with a speaker, as they stood before the pass.
    """
    rows = df.withColumn("smoothed", F.col(speaker)).withColumn("smoothing", F.lit(None).cast("string"))
    for step in ("bridged_gap", "smoothed_switch", "kept_previous"):
        rows = staged(runs_of(rows, source, order, "smoothed", start, end, evidence, degraded))
        runs = run_table(rows, source, order, "smoothed", start, end, evidence, degraded)
        runs = windowed(runs, [source], ["run_no"], {"before": ("last_before", F.col("run_speaker"))})
        backward = windowed(runs.withColumn("down", -F.col("run_no")), [source], ["down"], {"after": ("last_before", F.col("run_speaker"))})
        own, before, after = F.col("run_speaker"), F.col("before"), F.col("after")
        if step == "bridged_gap":
            take = own.isNull() & (F.col("run_duration") <= BRIDGE_SECONDS) & (before == after)
        elif step == "smoothed_switch":
            take = own.isNotNull() & F.col("unstable") & (before == after) & (before != own)
        else:
            take = F.col("all_degraded") & F.col("unstable") & before.isNotNull() & ~before.eqNullSafe(own)
        fixed = backward.filter(take).select(source, "run_no", F.col("before").alias("taken"))
        rows = keyed_join(rows, fixed, [source, "run_no"], "left")
        rows = rows.withColumn("smoothing", F.when(F.col("taken").isNotNull(), F.lit(step)).otherwise(F.col("smoothing")))
        rows = rows.withColumn("smoothed", F.coalesce("taken", "smoothed")).drop("taken", "run_no")
    return rows


def audio_quality(df: DataFrame, samples: str, file_rms: Column) -> DataFrame:
    """Adds rms, zero-crossing rate and reasons of degradation of a window of samples (ARRAY<DOUBLE>)."""
    n = F.size(samples)
    rms = F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x) / n)
    pairs = F.zip_with(F.slice(F.col(samples), 1, F.greatest(n - 1, F.lit(0))), F.slice(F.col(samples), 2, F.greatest(n - 1, F.lit(0))), lambda x, y: ((x >= 0) != (y >= 0)).cast("int"))
    crossing = F.aggregate(pairs, F.lit(0), lambda a, x: a + x) / F.greatest(n - 1, F.lit(1))
    out = df.withColumn("rms", F.when(n > 0, rms)).withColumn("crossing_rate", F.when(n > 0, crossing))
    reasons = F.array_compact(F.array(F.when(F.col("rms") < LOW_ENERGY * file_rms, "low_energy"), F.when(F.col("crossing_rate") > HIGH_CROSSING, "high_zero_crossing_rate")))
    return out.withColumn("quality_reasons", reasons).withColumn("is_degraded", F.size("quality_reasons") > 0)


def speaker_names(tracks: DataFrame, source: str, label: str, start: str) -> DataFrame:
    """(source, label, speaker_id): labels renamed `SPEAKER_%02d` by first appearance in their source."""
    first = tracks.groupBy(source, label).agg(F.min(start).alias("first"))
    place = F.row_number().over(Window.partitionBy(source).orderBy("first", label))
    return first.withColumn("speaker_id", F.format_string("SPEAKER_%02d", place - 1)).drop("first")


def role_estimates(tracks: DataFrame, source: str, label: str, start: str) -> DataFrame:
    """(source, label, role, confidence): the first voice teaches, all others are students; a placeholder's guess."""
    first = tracks.filter(F.col(label).isNotNull()).groupBy(source, label).agg(F.min(start).alias("first"))
    lead = Window.partitionBy(source).orderBy("first", label)
    return first.select(source, label, F.when(F.row_number().over(lead) == 1, "teacher").otherwise("student").alias("role"), F.lit(0.25).alias("role_confidence"))
