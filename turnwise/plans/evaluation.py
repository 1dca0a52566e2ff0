"""Queries of run timing, comparison and score summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators import evaluation as ev
from turnwise.session import table

_TIERS = (("stage_name", "session_id"), ("stage_name",))


def _stages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "stage_timings").drop("metadata", "ingested_at").dropDuplicates(["timing_id"])


def _qa(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "qa_candidates").drop("ingested_at").dropDuplicates(["qa_candidate_id"])


def timing_summary(spark, sf):
    return ev.timing_summary(_stages(spark, sf))


def stage_status(spark, sf):
    return ev.stage_status(_stages(spark, sf))


def cold_reference_rows(spark, sf):
    return ev.cold_references(_stages(spark, sf)).select("timing_id", "stage_name", "duration_seconds")


def cold_reference_choice(spark, sf):
    return ev.reference_choice(ev.cold_references(_stages(spark, sf)), ["stage_name"], "timing_id", "duration_seconds", "reference")


def cold_equivalent_runtime(spark, sf):
    return ev.cold_equivalents(_stages(spark, sf), _TIERS)


def oldest_cold_run(spark, sf):
    return ev.oldest_cold_run(_stages(spark, sf))


def resume_check(spark, sf):
    return ev.resumable(_stages(spark, sf))


def run_rankings(spark, sf):
    runs = ev.timing_summary(_stages(spark, sf)).select("run_id", "total_seconds", F.col("executed").cast("double").alias("executed"), F.col("reused").cast("double").alias("reused"), F.when(F.col("failed") > 0, F.col("failed").cast("double")).alias("failed"))
    return ev.rankings(runs, "run_id", {"total_seconds": False, "executed": False, "reused": True, "failed": True})


def input_labels(spark, sf):
    return table(spark, sf, "audio_sources").select("audio_source_id", ev.canonical_label(F.col("original_path")).alias("input_label"))


def secret_redaction(spark, sf):
    text = table(spark, sf, "responsiveness_scores").select("qa_candidate_id", "metadata").distinct()
    return text.select("qa_candidate_id", ev.redacted(F.col("metadata")).alias("metadata"))


def review_summary(spark, sf):
    """Keep, revise or reject by confidence, per session, with the means of the scores."""
    q = _qa(spark, sf).withColumn("decision", F.when(F.col("confidence") >= 0.75, "keep").when(F.col("confidence") >= 0.45, "revise").otherwise("reject"))
    tally = lambda d: F.count(F.when(F.col("decision") == d, 1)).alias(d)
    return q.groupBy("session_id").agg(tally("keep"), tally("revise"), tally("reject"), F.avg("confidence").alias("confidence"), F.avg("similarity_score").alias("similarity"), F.avg("retrieval_score").alias("retrieval"))


def score_distribution(spark, sf):
    return ev.score_distribution(_qa(spark, sf), ["session_id"], "similarity_score")


def flag_counts(spark, sf):
    return ev.top_reasons(_qa(spark, sf), ["session_id"], "review_flags", 10)


def run_quality_signal(spark, sf):
    risk = _qa(spark, sf).withColumn("risk", F.least(F.lit(1.0), F.coalesce(F.size("review_flags").cast("double"), F.lit(0.0)) * 0.3))
    return ev.run_quality(risk, ["session_id"], "confidence", "risk")


QUERIES = {
    f.__name__: f
    for f in (timing_summary, stage_status, cold_reference_rows, cold_reference_choice, cold_equivalent_runtime, oldest_cold_run, resume_check, run_rankings, input_labels, secret_redaction, review_summary, score_distribution, flag_counts, run_quality_signal)
}

_ST = "st AS (SELECT DISTINCT * EXCLUDE (metadata, ingested_at) FROM stage_timings)"
_QA = "qa AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM qa_candidates)"
_REFS = "refs AS (SELECT * FROM st WHERE status = 'executed' AND NOT used_cache AND NOT used_existing_artifact AND duration_seconds > 0)"


def _choice(name: str, keys: str) -> str:
    return f"""{name}_m AS (SELECT {keys}, quantile_cont(duration_seconds, 0.5) AS m FROM refs GROUP BY {keys}),
        {name} AS (SELECT {keys}, arg_min(duration_seconds, (round(abs(duration_seconds - m), 6), timing_id)) AS seconds, arg_min(timing_id, (round(abs(duration_seconds - m), 6), timing_id)) AS sample
                   FROM refs JOIN {name}_m USING ({keys}) GROUP BY {keys})"""


_RUNS = f"""
    WITH {_ST}
    SELECT session_id, run_id, count(*) AS stages, count(*) FILTER (status IN ('executed', 'failed')) AS executed, count(*) FILTER (status = 'reused') AS reused,
        count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (used_cache) AS cache_hits,
        count(*) FILTER (used_existing_artifact) AS artifact_hits, count(*) FILTER (forced_recompute) AS forced, sum(round(coalesce(duration_seconds, 0) * 1e6)::BIGINT) / 1e6 AS total_seconds,
        arg_min(stage_name, (-coalesce(duration_seconds, 0), ordinal)) AS costliest_stage,
        CASE WHEN count(*) FILTER (forced_recompute) > 0 THEN 'forced' WHEN count(*) FILTER (status = 'reused') = 0 THEN 'cold'
             WHEN count(*) FILTER (status IN ('executed', 'failed')) <= count(*) FILTER (status = 'reused') THEN 'warm' ELSE 'mixed' END AS run_label
    FROM st GROUP BY session_id, run_id"""

SQL = {
    "timing_summary": _RUNS,
    "stage_status": f"""WITH {_ST} SELECT session_id, stage_name, CASE WHEN bool_and(used_cache) THEN 'reused_from_cache' WHEN bool_and(used_existing_artifact) THEN 'reused_from_artifact'
        WHEN bool_or(forced_recompute) THEN 'executed_forced' ELSE 'executed' END AS stage_status FROM st GROUP BY ALL""",
    "cold_reference_rows": f"WITH {_ST}, {_REFS} SELECT timing_id, stage_name, duration_seconds FROM refs",
    "cold_reference_choice": f"WITH {_ST}, {_REFS}, {_choice('c', 'stage_name')} SELECT stage_name, seconds AS reference_seconds, sample AS reference_sample FROM c",
    "cold_equivalent_runtime": f"""WITH {_ST}, {_REFS}, {_choice('a', 'stage_name, session_id')}, {_choice('b', 'stage_name')},
        x AS (SELECT st.run_id, st.status, CASE WHEN status = 'reused' THEN coalesce(a.seconds, b.seconds) ELSE coalesce(duration_seconds, 0) END AS cost
              FROM st LEFT JOIN a ON a.stage_name = st.stage_name AND a.session_id = st.session_id LEFT JOIN b ON b.stage_name = st.stage_name)
        SELECT run_id, CASE WHEN bool_and(cost IS NOT NULL) THEN sum(round(cost * 1e6)::BIGINT) / 1e6 END AS cold_equivalent_seconds, bool_and(cost IS NOT NULL) AS complete, count(*) FILTER (status = 'reused') AS replaced_stages FROM x GROUP BY run_id""",
    "oldest_cold_run": f"""WITH {_ST}, runs AS (SELECT session_id, run_id, min(started_at) AS began, bool_or(status = 'reused') AS warm FROM st GROUP BY ALL),
        cold AS (SELECT session_id, arg_min(run_id, (began, run_id)) AS cold_run FROM runs WHERE NOT warm GROUP BY 1),
        l AS (SELECT session_id, cold_run, stage_name, max(duration_seconds) FILTER (run_id = cold_run) AS mine, max(duration_seconds) AS longest FROM st JOIN cold USING (session_id) WHERE status IN ('executed', 'failed') GROUP BY ALL)
        SELECT session_id, cold_run, sum(coalesce(mine, longest)) AS reference_seconds, count(*) FILTER (mine IS NULL) AS filled_stages FROM l GROUP BY ALL""",
    "resume_check": f"""WITH {_ST}, runs AS (SELECT session_id, run_id, bool_or(status = 'failed') AS failed FROM st GROUP BY ALL)
        SELECT session_id, min(run_id) AS run_id, NOT arg_min(failed, run_id) AS resumable FROM runs GROUP BY 1""",
    "run_rankings": f"""WITH runs AS ({_RUNS}), v AS (
            SELECT 'total_seconds' AS ranking, run_id, total_seconds::DOUBLE AS value, false AS high FROM runs UNION ALL SELECT 'executed', run_id, executed, false FROM runs
            UNION ALL SELECT 'reused', run_id, reused, true FROM runs UNION ALL SELECT 'failed', run_id, failed, true FROM runs WHERE failed > 0)
        SELECT ranking, CASE WHEN high THEN row_number() OVER (PARTITION BY ranking ORDER BY value DESC, run_id DESC) ELSE row_number() OVER (PARTITION BY ranking ORDER BY value, run_id) END AS place, run_id, value FROM v""",
    "input_labels": r"""SELECT audio_source_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(original_path, '^.*/', ''), '\.[^.]*$', '')),
        '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '^[0-9]+_', ''), '_mono_[0-9]+hz$', '') AS input_label FROM audio_sources""",
    "secret_redaction": r"""SELECT DISTINCT qa_candidate_id, regexp_replace(metadata, '("[^"]*(?:token|secret|password|api_key|auth)[^"]*"\s*:\s*)("(?:[^"\\]|\\.)*"|-?[0-9][0-9.eE+-]*|true|false|null)', '\1"<redacted>"', 'g') AS metadata FROM responsiveness_scores""",
    "review_summary": f"""WITH {_QA} SELECT session_id, count(*) FILTER (confidence >= 0.75) AS keep, count(*) FILTER (confidence >= 0.45 AND confidence < 0.75) AS revise,
        count(*) FILTER (confidence < 0.45 OR confidence IS NULL) AS reject, avg(confidence) AS confidence, avg(similarity_score) AS similarity, avg(retrieval_score) AS retrieval FROM qa GROUP BY 1""",
    "score_distribution": f"WITH {_QA} SELECT session_id, count(similarity_score) AS n, min(similarity_score) AS low, avg(similarity_score) AS mean, max(similarity_score) AS high, quantile_cont(similarity_score, 0.5) AS median FROM qa GROUP BY 1",
    "flag_counts": f"""WITH {_QA}, r AS (SELECT session_id, unnest(review_flags) AS reason FROM qa), c AS (SELECT session_id, reason, count(*) AS n FROM r GROUP BY ALL)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, reason) AS place FROM c) WHERE place <= 10""",
    "run_quality_signal": f"""WITH {_QA}, r AS (SELECT *, least(1.0, coalesce(len(review_flags), 0)::DOUBLE * 0.3) AS risk FROM qa),
        a AS (SELECT session_id, quantile_cont(confidence, 0.5) AS median_quality, count(*) FILTER (confidence >= 0.72) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.72) AS medium,
              avg(risk) AS risk, avg((risk >= 0.55)::INT::DOUBLE) AS high_risk FROM r GROUP BY 1),
        s AS (SELECT *, 0.45 * median_quality + 0.35 * least(1.0, (high + 0.4 * medium) / 10) + 0.20 * greatest(0.0, 1 - 0.8 * risk - 0.2 * high_risk) AS quality_signal FROM a WHERE median_quality IS NOT NULL)
        SELECT session_id, median_quality, high, medium, quality_signal, CASE WHEN quality_signal >= 0.72 THEN 'high' WHEN quality_signal >= 0.5 THEN 'medium' ELSE 'low' END AS quality_band FROM s""",
}
