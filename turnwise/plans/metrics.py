"""Queries of metrics, review rows and outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnwise.operators import metrics as me
from turnwise.operators import sentences as se
from turnwise.plans.sentences import _U, _quality, _sentences, sentence_review
from turnwise.plans.sentences import SQL as _SENTENCE_SQL
from turnwise.plans.timeline import _once
from turnwise.sources import outputs
from turnwise.sources import scans


def sentence_metrics(spark, sf):
    rated = se.quality_columns(_sentences(spark, sf), "text", F.col("end_seconds") - F.col("start_seconds"))
    return me.sentence_metrics(rated, ["session_id"], "words", "seconds", "quality")


def _asked(spark, sf):
    q = _once(spark, sf, "qa_candidates", "qa_candidate_id")
    return q.select(F.col("audio_source_id").alias("source"), F.col("qa_candidate_id").alias("qa_id"), F.col("question_timing.start_seconds").alias("at"), "confidence")


def sentence_question_rows(spark, sf):
    own = _sentences(spark, sf).select(F.col("audio_source_id").alias("source"), "unit_id", F.col("start_seconds").alias("u_start"), F.col("end_seconds").alias("u_end"))
    return me.sentence_question_rows(own, _asked(spark, sf)).withColumn("qa_ids", F.array_join("qa_ids", ","))


def report_summary(spark, sf):
    """Counts, means and shares of the report's sections, as rows."""
    chunks, said = _once(spark, sf, "transcript_chunks", "chunk_id"), _once(spark, sf, "utterances", "utterance_id")
    return me.summary_rows(
        {
            "pairs": (_once(spark, sf, "qa_candidates", "qa_candidate_id"), {"count": (None, None), "confidence": ("confidence", None), "high": (None, "confidence >= 0.75"), "low": (None, "confidence < 0.45"), "without_answer": (None, "answer_text is null or trim(answer_text) = ''"), "flagged": (None, "size(review_flags) > 0")}),
            "utterances": (said, {"count": (None, None), "unassigned": (None, "speaker_id is null"), "uncertain": (None, "speaker_is_uncertain"), "blank": (None, "text is null or trim(text) = ''")}),
            "chunks": (chunks, {"count": (None, None), "transcription_confidence": ("transcription_confidence", None), "language_confidence": ("language_confidence", None), "without_language": (None, "detected_language is null")}),
            "stages": (_once(spark, sf, "stage_timings", "timing_id"), {"count": (None, None), "seconds": ("duration_seconds", None), "reused": (None, "used_cache or used_existing_artifact"), "failed": (None, "status = 'failed'")}),
        }
    )


def utterance_rows(spark, sf):
    said = _once(spark, sf, "utterances", "utterance_id").filter("start_seconds is not null")
    links = said.filter("transcript_chunk_id is not null").select("utterance_id", F.col("transcript_chunk_id").alias("segment"))
    out = me.utterance_rows(said, links, "audio_source_id", ["start_seconds", "utterance_id"], "utterance_id", "speaker_id")
    return out.select("utterance_id", "speaker_changed", "segments", "segment_conflict")


def review_queue(spark, sf):
    chunks = _once(spark, sf, "transcript_chunks", "chunk_id").select("chunk_id", F.col("start_seconds").alias("start"))
    rows = sentence_review(spark, sf).join(chunks, "chunk_id").select(F.col("chunk_id").alias("id"), "start", F.col("review_priority").alias("priority"), "flags")
    said = _once(spark, sf, "utterances", "utterance_id").select(
        F.col("utterance_id").alias("id"), F.col("start_seconds").alias("start"), F.when(F.col("speaker_id").isNull(), "medium").otherwise("low").alias("priority"), F.lit("unassigned_source").alias("flags")
    )
    return me.review_queue([("sentence", rows), ("utterance", said)]).select("kind", "id", "priority", "suggested_action")


def comment_carry_over(spark, sf):
    """Review rows with earlier comments; notes on stages stand for what people wrote."""
    rows = _once(spark, sf, "stage_timings", "timing_id").select("timing_id", "run_id", "stage_name")
    earlier = _once(spark, sf, "stage_timings", "timing_id").filter("note is not null").select("run_id", F.col("note").alias("comment"), F.col("started_at").alias("written_at"))
    return me.carried_comments(rows, earlier, "run_id")


def session_documents(spark, sf):
    """The session document of every audio source, as one JSON text."""
    return outputs.session_json(_once(spark, sf, "audio_sources", "audio_source_id"), _once(spark, sf, "utterances", "utterance_id"))


def session_sources(spark, sf):
    return scans.session_sources(_once(spark, sf, "audio_sources", "audio_source_id"), "session_id", "original_path")


_QUERIES = (sentence_metrics, sentence_question_rows, report_summary, utterance_rows, review_queue, comment_carry_over, session_documents, session_sources)
QUERIES = {f.__name__: f for f in _QUERIES}


def _counts(value: str, section: str, buckets: dict) -> str:
    edge = lambda lo, hi: " AND ".join([f"{value} >= {lo}"] * (lo is not None) + [f"{value} < {hi}"] * (hi is not None))
    return " ".join(f"UNION ALL SELECT session_id, '{section}', '{name}', count(*) FILTER ({edge(*b)}) FROM q GROUP BY 1" for name, b in buckets.items())


def _wide(section: str, value: str) -> str:
    cols = f"sum({value})::DOUBLE AS total, avg({value}) AS average, min({value})::DOUBLE AS low, max({value})::DOUBLE AS high, quantile_cont({value}::DOUBLE, 0.5) AS median, quantile_cont({value}::DOUBLE, 0.25) AS p25, quantile_cont({value}::DOUBLE, 0.75) AS p75, quantile_cont({value}::DOUBLE, 0.9) AS p90"
    names = ("total", "average", "low", "high", "median", "p25", "p75", "p90")
    return f"SELECT session_id, '{section}' AS section, unnest({list(names)}) AS metric, unnest([{', '.join(names)}]) AS value FROM (SELECT session_id, {cols} FROM q GROUP BY 1)"


SQL = {
    "sentence_metrics": f"""WITH r AS (SELECT DISTINCT session_id, unit_id, text, end_seconds - start_seconds AS seconds FROM segmentation_units WHERE unit_kind = 'sentence' AND trim(text) <> ''), q AS ({_quality('r')})
        SELECT session_id, 'volume' AS section, 'sentences' AS metric, count(*)::DOUBLE AS value FROM q GROUP BY 1
        UNION ALL {_wide('words', 'words')} UNION ALL {_wide('seconds', 'seconds')}
        {_counts('words', 'word_buckets', me.WORD_BUCKETS)} {_counts('seconds', 'second_buckets', me.SECOND_BUCKETS)}
        UNION ALL SELECT session_id, 'labels', quality, count(*) FROM q GROUP BY 1, 3""",
    "utterance_rows": f"""WITH {_U}, l AS (SELECT *, last_value(speaker_id IGNORE NULLS) OVER (PARTITION BY audio_source_id ORDER BY start_seconds, utterance_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM u WHERE start_seconds IS NOT NULL)
        SELECT utterance_id, coalesce(speaker_id <> prev, false) AS speaker_changed, coalesce(transcript_chunk_id, 'UNASSIGNED_SEGMENT') AS segments, false AS segment_conflict FROM l""",
    "review_queue": f"""WITH r AS ({_SENTENCE_SQL["sentence_review"]}), s AS (SELECT 'sentence' AS kind, chunk_id AS id, review_priority AS priority, flags FROM r
            UNION ALL SELECT DISTINCT 'utterance', utterance_id, CASE WHEN speaker_id IS NULL THEN 'medium' ELSE 'low' END, 'unassigned_source' FROM utterances)
        SELECT kind, id, priority, CASE WHEN contains(flags, 'speaker_change_inside') THEN 'check_speaker_change' WHEN contains(flags, 'merge_risky') THEN 'check_merge' WHEN contains(flags, 'semantic_') THEN 'check_wording'
            WHEN contains(flags, 'uncertain') OR contains(flags, 'unassigned') THEN 'check_speaker' ELSE 'review' END AS suggested_action FROM s WHERE priority <> 'low'""",
    "comment_carry_over": """WITH st AS (SELECT DISTINCT timing_id, run_id, stage_name, note, started_at FROM stage_timings), l AS (SELECT run_id, arg_max(note, started_at) AS comment FROM st WHERE trim(note) <> '' GROUP BY 1)
        SELECT st.timing_id, run_id, stage_name, comment FROM st LEFT JOIN l USING (run_id)""",
    "session_sources": r"""WITH s AS (SELECT session_id, original_path, lower(regexp_extract(original_path, '\.([^./]+)$', 1)) AS ext, lower(regexp_replace(original_path, '^.*/', '')) AS name FROM audio_sources)
        SELECT session_id, original_path, printf('source_%03d', row_number() OVER (PARTITION BY session_id ORDER BY name, original_path)) AS source_id,
            CASE WHEN ext IN ('wav', 'mp3', 'm4a', 'aac', 'flac') THEN 'audio' WHEN ext IN ('mp4', 'mov', 'mkv', 'avi') THEN 'video' ELSE 'unsupported' END AS media_type FROM s WHERE original_path IS NOT NULL""",
    "sentence_question_rows": """WITH u AS (SELECT DISTINCT audio_source_id AS source, unit_id, start_seconds AS u_start, end_seconds AS u_end FROM segmentation_units WHERE unit_kind = 'sentence' AND trim(text) <> ''),
        q AS (SELECT DISTINCT audio_source_id AS source, qa_candidate_id AS qa_id, question_timing.start_seconds AS t, confidence FROM qa_candidates),
        m AS (SELECT u.unit_id, count(*) AS n, array_to_string((list(qa_id ORDER BY t, qa_id))[1:2], ',') AS ids, max(confidence) AS best FROM u JOIN q ON u.source = q.source AND q.t >= u.u_start AND q.t < u.u_end GROUP BY 1)
        SELECT source, unit_id, coalesce(n, 0) AS qa_count, coalesce(ids, '') AS qa_ids, best AS best_confidence FROM u LEFT JOIN m USING (unit_id)""",
    "report_summary": """WITH p AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM qa_candidates), u AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM utterances), c AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM transcript_chunks), t AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM stage_timings),
        f AS (SELECT 'pairs' AS section, 'high' AS metric, count(*) FILTER (confidence >= 0.75) AS v, count(*) AS n FROM p UNION ALL SELECT 'pairs', 'low', count(*) FILTER (confidence < 0.45), count(*) FROM p
            UNION ALL SELECT 'pairs', 'without_answer', count(*) FILTER (answer_text IS NULL OR trim(answer_text, ' ') = ''), count(*) FROM p UNION ALL SELECT 'pairs', 'flagged', count(*) FILTER (len(review_flags) > 0), count(*) FROM p
            UNION ALL SELECT 'utterances', 'unassigned', count(*) FILTER (speaker_id IS NULL), count(*) FROM u UNION ALL SELECT 'utterances', 'uncertain', count(*) FILTER (speaker_is_uncertain), count(*) FROM u
            UNION ALL SELECT 'utterances', 'blank', count(*) FILTER (text IS NULL OR trim(text, ' ') = ''), count(*) FROM u UNION ALL SELECT 'chunks', 'without_language', count(*) FILTER (detected_language IS NULL), count(*) FROM c
            UNION ALL SELECT 'stages', 'reused', count(*) FILTER (used_cache OR used_existing_artifact), count(*) FROM t UNION ALL SELECT 'stages', 'failed', count(*) FILTER (status = 'failed'), count(*) FROM t)
        SELECT section, metric, v::DOUBLE AS value, CASE WHEN n > 0 THEN v / n END AS value2 FROM f UNION ALL SELECT 'pairs', 'count', count(*)::DOUBLE, NULL FROM p UNION ALL SELECT 'utterances', 'count', count(*)::DOUBLE, NULL FROM u
        UNION ALL SELECT 'chunks', 'count', count(*)::DOUBLE, NULL FROM c UNION ALL SELECT 'stages', 'count', count(*)::DOUBLE, NULL FROM t UNION ALL SELECT 'pairs', 'confidence', avg(confidence), median(confidence) FROM p
        UNION ALL SELECT 'chunks', 'transcription_confidence', avg(transcription_confidence), median(transcription_confidence) FROM c UNION ALL SELECT 'chunks', 'language_confidence', avg(language_confidence), median(language_confidence) FROM c
        UNION ALL SELECT 'stages', 'seconds', avg(duration_seconds), median(duration_seconds) FROM t""",
}
