"""Scans: session folders, recognised chunks, plain transcripts, evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# File extensions by media type, and of files that earlier runs wrote beside the media.
AUDIO = ("wav", "mp3", "m4a", "aac", "flac")
VIDEO = ("mp4", "mov", "mkv", "avi")
SIDECARS = r"(?i)(?:_transcript\.txt|_manifest\.json|_normalized\.json|\.cache\.json)$"


def media_type(path: Column) -> Column:
    """`audio`, `video` or `unsupported`, by the file's extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin(*AUDIO), "audio").when(ext.isin(*VIDEO), "video").otherwise("unsupported")


def session_sources(df: DataFrame, session: str, path: str) -> DataFrame:
    """(session, path, source_id, media_type): a session's files by lower-cased name, numbered. A session has few files."""
    rows = df.filter(F.col(path).isNotNull() & ~F.col(path).rlike(SIDECARS)).select(session, path)
    name = F.lower(F.regexp_replace(F.col(path), r"^.*/", ""))
    place = F.row_number().over(Window.partitionBy(session).orderBy(name, path))
    return rows.withColumn("source_id", F.format_string("source_%03d", place)).withColumn("media_type", media_type(F.col(path)))


def list_media(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, media_type) of the files of a folder, sidecars left out; contents are not read."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    return files.filter(~F.col("path").rlike(SIDECARS)).withColumn("media_type", media_type(F.col("path")))


def session_name(df: DataFrame, session: str, path: str) -> DataFrame:
    """(session, session_name): stem of the first file by name, and the number of files."""
    name = F.lower(F.regexp_replace(F.col(path), r"^.*/", ""))
    grouped = df.groupBy(session).agg(F.min_by(path, F.struct(name.alias("n"), path)).alias("first"), F.count(F.lit(1)).alias("files"))
    stem = F.regexp_replace(F.regexp_replace("first", r"^.*/", ""), r"\.[^.]*$", "")
    return grouped.select(session, F.concat(stem, F.lit("_"), F.col("files"), F.lit("files")).alias("session_name"))


def recognised_chunks(df: DataFrame, source: str, place: str, start: str, end: str, text: str, language: str, source_language: str) -> DataFrame:
    """Chunks of a recogniser's segments: numbered with the blank ones, which are then left out; times made possible;
    a missing language taken from the source."""
    number = F.row_number().over(Window.partitionBy(source).orderBy(place))
    rows = df.withColumn("chunk_id", F.format_string("%s_chunk_%04d", F.col(source), number)).filter(F.trim(text) != "")
    begin = F.greatest(F.coalesce(F.col(start), F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumn("start_seconds", begin).withColumn("end_seconds", F.greatest(F.coalesce(F.col(end), begin), begin))
    return rows.withColumn("text", F.trim(text)).withColumn("detected_language", F.coalesce(language, source_language)).select(source, "chunk_id", "start_seconds", "end_seconds", "text", "detected_language")


def majority_language(df: DataFrame, source: str, language: str) -> DataFrame:
    """(source, language): the most frequent language of a source's chunks, ties by name."""
    counts = df.filter(F.col(language).isNotNull()).groupBy(source, language).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(source).agg(F.min_by(language, F.struct((-F.col("n")).alias("n"), language)).alias("majority_language"))


def plain_transcripts(spark: SparkSession, folder: str, durations: DataFrame) -> DataFrame:
    """One chunk per plain text file, from 0 to the duration that `durations` (name, duration_seconds) knows."""
    files = spark.read.text(folder, wholetext=True).withColumn("path", F.input_file_name())
    named = files.withColumn("name", F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"\.[^.]*$", ""))
    return named.join(durations, "name", "left").select("name", F.concat("name", F.lit("_chunk_0001")).alias("chunk_id"), F.lit(0.0).alias("start_seconds"), F.coalesce("duration_seconds", F.lit(0.0)).alias("end_seconds"), F.trim("value").alias("text")).filter("text != ''")


def evaluation_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run, metrics, review, error): the metrics.json of every run folder with its ai_review.json, as JSON text.

    Damaged files give an error text in place of content.
    """

    def texts(name: str) -> DataFrame:
        files = spark.read.text(f"{folder}/*/{name}", wholetext=True).withColumn("path", F.input_file_name())
        return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("run"), F.col("value"))

    sound = F.try_parse_json("value").isNotNull()
    metrics = texts("metrics.json").select("run", F.when(sound, F.col("value")).alias("metrics"), F.when(~sound, F.lit("invalid_json")).alias("error"))
    try:
        reviews = texts("ai_review.json").select("run", F.when(sound, F.col("value")).alias("review"))
        return metrics.join(reviews, "run", "left")
    except Exception:  # no run has a review
        return metrics.withColumn("review", F.lit(None).cast("string"))
