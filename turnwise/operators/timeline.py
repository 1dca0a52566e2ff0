"""Transcript merging, timing policies, text normalization and utterance building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.operators.joins import keyed_join
from turnwise.operators.ordering import grouped_running, value_bucket, windowed

#: Longest silence inside an utterance, in seconds.
MAX_GAP = 0.85
#: Merged units on one page of a session's full text.
PAGE_UNITS = 200


def clamp_timing(df: DataFrame, start: str = "start_seconds", end: str = "end_seconds") -> DataFrame:
    """Adds `clean_start`, `clean_end` and `timing_note`: missing times become 0, negative starts 0, ends that lie
    before the start the start."""
    s = F.when(F.col(start).isNull() | F.isnan(start), F.lit(0.0)).otherwise(F.greatest(F.col(start), F.lit(0.0)))
    missing = F.col(start).isNull() | F.isnan(start) | F.col(end).isNull() | F.isnan(end)
    note = F.when(missing, "non_numeric").when(F.col(start) < 0, "negative_start").when(F.col(end) < 0, "negative_end").when(F.col(end) < F.col(start), "reversed")
    out = df.withColumn("clean_start", F.when(missing, F.lit(0.0)).otherwise(s)).withColumn("timing_note", note)
    return out.withColumn("clean_end", F.when(missing, F.lit(0.0)).otherwise(F.greatest(F.col(end), F.col("clean_start"))))


def merged_units(chunks: DataFrame, sources: DataFrame, drop_invalid: bool = False) -> DataFrame:
    """(session_id, unit_no, chunk_id, chunk_occurrence, audio_source_id, start, end, overlaps_earlier, timing_note).

    Chunks are ordered inside their session: known sources in session order, unknown ones behind by name, then by
    start, end, arrival and id. The n-th row of one chunk id keeps its number; a unit overlaps if it starts before the
    latest end (0 at least) of the units before it in its source.
    """
    known = sources.select("session_id", "audio_source_id", "order_index").dropDuplicates(["session_id", "audio_source_id"])
    rows = keyed_join(clamp_timing(chunks), known, ["session_id", "audio_source_id"], "left")
    if drop_invalid:
        rows = rows.filter(F.col("timing_note").isNull())
    rows = rows.withColumn("src", F.coalesce(F.col("order_index").cast("bigint"), F.lit(1 << 20)))
    order = ["src", "audio_source_id", "clean_start", "clean_end", "ingested_at", "chunk_id"]
    # names of unknown sources are ordered inside one bucket; known sources have time buckets of their own
    bucket = F.when(F.col("order_index").isNull(), F.lit((1 << 20) * (1 << 24)).cast("bigint")).otherwise(F.col("src") * (1 << 24) + value_bucket(F.col("clean_start")))
    out = grouped_running(rows, ["session_id"], order, name="unit_no", bucket=bucket)
    out = windowed(out, ["session_id", "audio_source_id"], ["clean_start", "clean_end", "ingested_at", "chunk_id"], {"reach": ("max_before", F.col("clean_end"))})
    nth = F.row_number().over(Window.partitionBy("session_id", "chunk_id").orderBy("unit_no"))
    return out.withColumn("chunk_occurrence", nth).withColumn("overlaps_earlier", F.col("clean_start") < F.greatest(F.coalesce("reach", F.lit(0.0)), F.lit(0.0))).select(
        "session_id", "unit_no", "chunk_id", "chunk_occurrence", "audio_source_id", F.col("clean_start").alias("start"), F.col("clean_end").alias("end"), "overlaps_earlier", "timing_note", "text", "detected_language"
    )


def full_text_pages(units: DataFrame, page_units: int = PAGE_UNITS) -> DataFrame:
    """(session_id, page_no, text, languages): the session's text in unit order, in pages of bounded size."""
    page = F.floor((F.col("unit_no") - 1) / page_units)
    spoken = F.when(F.trim("text") != "", F.col("text"))
    grouped = units.groupBy("session_id", page.alias("page_no")).agg(
        F.array_sort(F.collect_list(F.when(spoken.isNotNull(), F.struct("unit_no", spoken.alias("t"))))).alias("parts"), F.array_sort(F.collect_set("detected_language")).alias("languages")
    )
    return grouped.select("session_id", "page_no", F.array_join(F.transform("parts", lambda x: x["t"]), "\n").alias("text"), F.array_join("languages", ",").alias("languages"))


def normalized_text(text: Column) -> Column:
    """White space collapsed and trimmed; none before `,.;:!?` and inside brackets; one after `,;:!?` before a letter."""
    out = F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r" ([,.;:!?])", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"([(\[{]) ", "$1"), r" ([)\]}])", "$1")
    return F.regexp_replace(out, r"([,;:!?])(\p{L})", "$1 $2")


def normalize_units(df: DataFrame, text: str = "text", drop_empty: bool = True, keep_raw: bool = True) -> DataFrame:
    out = df.withColumn("raw_text", F.col(text)) if keep_raw else df
    out = out.withColumn(text, normalized_text(F.col(text)))
    return out.filter(F.coalesce(F.col(text), F.lit("")) != "") if drop_empty else out


def words_of(df: DataFrame, segment: str, text: str, start: str, end: str) -> DataFrame:
    """One row per word with times spread evenly over the segment: the seam for an aligner's output."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")), " "), lambda w: w != "")
    spread = df.withColumn("_w", words).withColumn("_n", F.size("_w")).filter("_n > 0")
    spread = spread.select("*", F.posexplode("_w").alias("_i", "word"))
    span = F.greatest(F.col(end) - F.col(start), F.lit(0.0))
    return (
        spread.withColumn("word_index", F.col("_i") + 1)
        .withColumn("word_start", F.col(start) + span * F.col("_i") / F.col("_n"))
        .withColumn("word_end", F.col(start) + span * (F.col("_i") + 1) / F.col("_n"))
        .drop("_w", "_n", "_i")
    )


def gap_split_words(words: DataFrame, segment: str, order: list[str], start: str, end: str, max_gap: float = MAX_GAP) -> DataFrame:
    """Adds `draft_no`: a new draft begins where the silence since the last known end of the segment exceeds `max_gap`.

    Words without times never split. After a split the last end starts anew with the word itself, which is the last
    known one anyway. A segment is one stretch of recognised speech, of bounded size.
    """
    inside = Window.partitionBy(segment).orderBy(*order)
    last = F.last(F.coalesce(end, start), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    split = (F.col(start) - last > max_gap).cast("int")
    marked = words.withColumn("_split", F.coalesce(split, F.lit(0)))
    return marked.withColumn("draft_no", F.sum("_split").over(inside.rowsBetween(Window.unboundedPreceding, 0))).drop("_split")


def drafts_to_utterances(words: DataFrame, segment: str, order: list[str], text: str, start: str, end: str) -> DataFrame:
    """One row per draft: joined text, first and last times (end not before start), number of words, content id."""
    place = F.struct(*order)
    grouped = words.groupBy(segment, "draft_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t")))), lambda x: x["_t"]), " ").alias("text"),
        F.min_by(F.coalesce(start, end), F.when(F.coalesce(start, end).isNotNull(), place)).alias("start"),
        F.max_by(F.coalesce(end, start), F.when(F.coalesce(start, end).isNotNull(), place)).alias("end"),
        F.count(F.lit(1)).alias("words"),
    )
    joined = F.regexp_replace(F.regexp_replace("text", r" ([,.;:!?)\]}])", "$1"), r"([(\[{]) ", "$1")
    out = grouped.withColumn("text", joined).withColumn("end", F.greatest("end", "start"))
    content = F.concat_ws("|", F.col(segment), F.col("draft_no"), F.round(F.col("start") * 1000).cast("bigint"), F.round(F.col("end") * 1000).cast("bigint"), "text")
    return out.withColumn("utterance_key", F.substring(F.sha1(content), 1, 16))


def with_segment_fallback(utterances: DataFrame, segments: DataFrame, segment: str) -> DataFrame:
    """Segments without any utterance become one utterance each, from their own text and times."""
    missing = segments.join(utterances.select(segment).distinct(), segment, "left_anti")
    return utterances.select(segment, "text", "start", "end").unionByName(missing.select(segment, "text", "start", "end"))
