"""Long-form metrics, review rows and the review queue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.operators.joins import keyed_join
from turnwise.operators.ordering import exact_percentiles, windowed
from turnwise.session import staged

POINTS = {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9}
# Buckets of words and of seconds, from (inclusive) and to (exclusive); they overlap on purpose.
WORD_BUCKETS = {"le_2": (None, 3), "le_3": (None, 4), "4_6": (4, 7), "7_12": (7, 13), "13_24": (13, 25), "ge_25": (25, None), "ge_35": (35, None), "ge_50": (50, None)}
SECOND_BUCKETS = {"lt_1s": (None, 1), "1_2s": (1, 2), "2_5s": (2, 5), "5_10s": (5, 10), "ge_10s": (10, None), "ge_15s": (15, None), "ge_20s": (20, None)}
PRIORITIES = ("high", "medium", "low")


def unpivoted(df: DataFrame, keys: Sequence[str], section: str) -> DataFrame:
    """(keys, section, metric, value) from a wide row per group."""
    names = [c for c in df.columns if c not in keys]
    entries = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(*keys, F.lit(section).alias("section"), F.explode(entries).alias("_x")).select(*keys, "section", "_x.metric", "_x.value")


def _inside(value: Column, low: float | None, high: float | None) -> Column:
    return (value >= low if low is not None else F.lit(True)) & (value < high if high is not None else F.lit(True))


def measured(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per group: total, average, extremes and exact percentiles of a column."""
    base = df.groupBy(*keys).agg(F.sum(value).alias("total"), F.avg(value).alias("average"), F.min(value).alias("low"), F.max(value).alias("high"))
    return keyed_join(base, exact_percentiles(df, keys, value, POINTS).drop("n"), keys, "left")


def sentence_metrics(df: DataFrame, keys: Sequence[str], words: str, seconds: str, label: str) -> DataFrame:
    """(keys, section, metric, value): volume, word and duration statistics, buckets and label counts of sentences."""
    rows = staged(df.select(*keys, words, seconds, label))  # read by every section; what rates the sentences runs once
    counted = lambda value, buckets: [F.count(F.when(_inside(F.col(value), *edges) & F.col(value).isNotNull(), 1)).alias(name) for name, edges in buckets.items()]
    parts = [
        unpivoted(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("sentences")), keys, "volume"), unpivoted(measured(rows.withColumn(words, F.col(words).cast("double")), keys, words), keys, "words"),
        unpivoted(measured(rows, keys, seconds), keys, "seconds"), unpivoted(rows.groupBy(*keys).agg(*counted(words, WORD_BUCKETS)), keys, "word_buckets"), unpivoted(rows.groupBy(*keys).agg(*counted(seconds, SECOND_BUCKETS)), keys, "second_buckets"),
    ]
    labels = rows.filter(F.col(label).isNotNull()).groupBy(*keys, F.col(label).alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    parts.append(labels.select(*keys, F.lit("labels").alias("section"), "metric", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def utterance_rows(utterances: DataFrame, segments_of: DataFrame, source: str, order: Sequence[str], key: str, speaker: str) -> DataFrame:
    """Adds whether the speaker changed since the last known one, and the segments that hold the utterance.

    `segments_of` has (key, segment). Several segments are listed, none gives `UNASSIGNED_SEGMENT`.
    """
    seen = windowed(utterances, [source], order, {"_last": ("last_before", F.col(speaker))})
    held = segments_of.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("segment")), ",").alias("segments"), F.countDistinct("segment").alias("n_segments"))
    out = keyed_join(seen, held, [key], "left")
    out = out.withColumn("speaker_changed", F.coalesce((F.col(speaker) != F.col("_last")), F.lit(False))).withColumn("segments", F.coalesce("segments", F.lit("UNASSIGNED_SEGMENT")))
    return out.withColumn("segment_conflict", F.coalesce(F.col("n_segments") > 1, F.lit(False))).drop("_last", "n_segments")


def review_queue(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of all kinds whose priority is not low, with a suggested action and a sort key.

    Every part has (id, start, priority, flags).
    """
    out = None
    for kind, df in parts:
        rows = df.filter(F.col("priority") != "low").select(F.lit(kind).alias("kind"), "id", "start", "priority", "flags")
        out = rows if out is None else out.unionByName(rows)
    flags = F.col("flags")
    action = (
        F.when(flags.contains("speaker_change_inside"), "check_speaker_change").when(flags.contains("merge_risky"), "check_merge").when(flags.contains("semantic_"), "check_wording")
        .when(flags.contains("uncertain") | flags.contains("unassigned"), "check_speaker").otherwise("review")
    )
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("priority"))
    return out.withColumn("suggested_action", action).withColumn("sort_key", F.struct(rank.alias("p"), F.coalesce("start", F.lit(float("inf"))).alias("s"), "kind", "id"))


def carried_comments(rows: DataFrame, earlier: DataFrame, key: str) -> DataFrame:
    """Rows with the comments that people gave to rows of the same key in an earlier output; the last one counts."""
    last = earlier.filter(F.trim("comment") != "").groupBy(key).agg(F.max_by("comment", "written_at").alias("comment"))
    return keyed_join(rows, last, [key], "left")


def sentence_question_rows(sentences: DataFrame, pairs: DataFrame, bin_seconds: float = 30.0, most: int = 2) -> DataFrame:
    """(source, unit_id, qa_count, qa_ids, best_confidence): every sentence with the pairs whose question begins in it.

    `sentences` has (source, unit_id, u_start, u_end), `pairs` (source, qa_id, at, confidence). The ids are the first
    `most` in time; the counts are of all. A sentence meets the pairs of the bins it touches only, so a hot source is
    spread over its bins. Sentences without times, and pairs without a start, meet nothing; a sentence with no pair has
    count 0; repeated rows of one key count once.
    """
    own = sentences.dropDuplicates(["unit_id"])
    lo, hi = F.floor(F.col("u_start") / bin_seconds), F.floor(F.col("u_end") / bin_seconds)
    held = own.filter(F.col("u_end") > F.col("u_start")).select("source", "unit_id", "u_start", "u_end", F.explode(F.sequence(lo, hi)).alias("bin"))
    asked = pairs.filter(F.col("at").isNotNull()).dropDuplicates(["qa_id"]).withColumn("bin", F.floor(F.col("at") / bin_seconds))
    met = held.join(asked, ["source", "bin"]).filter((F.col("at") >= F.col("u_start")) & (F.col("at") < F.col("u_end")))
    found = met.groupBy("unit_id").agg(F.count(F.lit(1)).alias("_n"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "qa_id"))), lambda x: x["qa_id"]), 1, most).alias("_ids"), F.max("confidence").alias("best_confidence"))
    out = own.join(found, "unit_id", "left")
    return out.select("source", "unit_id", F.coalesce("_n", F.lit(0)).alias("qa_count"), F.coalesce("_ids", F.array().cast("array<string>")).alias("qa_ids"), "best_confidence")


def summary_rows(sections: dict[str, tuple[DataFrame, dict[str, tuple[str | None, str | None]]]]) -> DataFrame:
    """(section, metric, value, value2): one row a metric, from one aggregation a section.

    A metric is (column, flag): without both the rows are counted; with a column its mean and median; with a flag, a
    SQL condition, how many rows hold it and their share. Empty tables count 0 and have no other value.
    """
    out: DataFrame | None = None
    for section, (df, metrics) in sections.items():
        aggs, named = [F.count(F.lit(1)).cast("double").alias("_n")], []
        for i, (metric, (column, flag)) in enumerate(metrics.items()):
            if column is not None:
                aggs += [F.avg(column).alias(f"_v{i}"), F.percentile(column, F.lit(0.5)).alias(f"_w{i}")]
                pair = (F.col(f"_v{i}"), F.col(f"_w{i}"))
            elif flag is not None:
                aggs.append(F.count(F.when(F.expr(flag), 1)).cast("double").alias(f"_v{i}"))
                pair = (F.col(f"_v{i}"), F.when(F.col("_n") > 0, F.col(f"_v{i}") / F.col("_n")))
            else:
                pair = (F.col("_n"), F.lit(None))
            named.append(F.struct(F.lit(section).alias("section"), F.lit(metric).alias("metric"), pair[0].cast("double").alias("value"), pair[1].cast("double").alias("value2")))
        rows = df.agg(*aggs).select(F.explode(F.array(*named)).alias("r")).select("r.*")
        out = rows if out is None else out.unionByName(rows)
    return out
