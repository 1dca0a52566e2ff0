"""Queries of the interval and the nested-record operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators.intervals import periods_and_gaps
from turnwise.operators.records import FlatRecords, flatten_records
from turnwise.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods_and_gaps(table(spark, sf_dir, "segmentation_units"), "audio_source_id", "start_seconds", "end_seconds")


def _flat(spark: SparkSession, sf_dir: str) -> dict[str, FlatRecords]:
    keys = {"stage_timings": "timing_id", "responsiveness_scores": "qa_candidate_id"}
    return {name: flatten_records(table(spark, sf_dir, name), key, "metadata") for name, key in keys.items()}


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        flat.bridge.filter("is_element").select(F.lit(name).alias("record_table"), "record_id", "node_path", "parent_path").distinct()
        for name, flat in _flat(spark, sf_dir).items()
    ]
    return parts[0].unionByName(parts[1])


def p7_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [flat.objects.select(F.lit(name).alias("record_table"), "node_hash", "body", "occurrences") for name, flat in _flat(spark, sf_dir).items()]
    return parts[0].unionByName(parts[1])


def p7_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [flat.bridge.select(F.lit(name).alias("record_table"), "*") for name, flat in _flat(spark, sf_dir).items()]
    return parts[0].unionByName(parts[1])


QUERIES = {"p4_found": p4_found, "p7_found": p7_found, "p7_objects": p7_objects, "p7_bridge": p7_bridge}

SQL = {
    "p4_found": """
        WITH spans AS (
            SELECT audio_source_id, CAST(floor(start_seconds * 1000 + 0.5) AS BIGINT) AS s, CAST(floor(end_seconds * 1000 + 0.5) AS BIGINT) AS e
            FROM segmentation_units WHERE start_seconds IS NOT NULL AND end_seconds IS NOT NULL
        ), seen AS (
            SELECT *, max(e) OVER (PARTITION BY audio_source_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
            FROM spans WHERE e > s
        ), marked AS (
            SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY audio_source_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island
            FROM seen
        ), periods AS (
            SELECT audio_source_id, island, min(s) AS a, max(e) AS b FROM marked GROUP BY ALL
        )
        SELECT audio_source_id, 'period' AS kind, a AS start_ms, b AS end_ms FROM periods
        UNION ALL
        SELECT audio_source_id, 'gap', prev, a FROM (
            SELECT audio_source_id, a, lag(b) OVER (PARTITION BY audio_source_id ORDER BY a) AS prev FROM periods
        ) WHERE prev IS NOT NULL
    """,
}
