"""Queries of sentence reconstruction, provenance and segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators import segments as sg
from turnwise.operators import sentences as se
from turnwise.plans.timeline import _once
from turnwise.session import table


def _grouped(spark, sf):
    said = _once(spark, sf, "utterances", "utterance_id").filter("trim(text) != ''")
    return se.utterance_groups(said, "audio_source_id", ["start_seconds", "utterance_id"], "start_seconds", "end_seconds", "speaker_id", "speaker_is_uncertain")


def utterance_groups(spark, sf):
    return _grouped(spark, sf).groupBy("audio_source_id", "group_no").agg(F.count(F.lit(1)).alias("utterances"), F.min("start_seconds").alias("start"), F.max("end_seconds").alias("end"))


def _groups(spark, sf):
    return _once(spark, sf, "rendered_groups", "group_id").filter("text is not null")


def fallback_sentence_split(spark, sf):
    return se.fallback_pieces(_groups(spark, sf), "group_id", "text")


def boundary_snap(spark, sf):
    """Ends of the split pieces, snapped to the ends of the group's utterances."""
    pieces = fallback_sentence_split(spark, sf).groupBy("group_id").agg(F.sort_array(F.collect_list("piece_end")).alias("targets"))
    both = pieces.join(_groups(spark, sf).select("group_id", F.col("utterance_end_offsets").alias("ends")), "group_id")
    return both.select("group_id", F.explode(se.snapped_boundaries(F.col("ends"), F.col("targets"))).alias("utterance_index"))


def _sentences(spark, sf):
    return _once(spark, sf, "segmentation_units", "unit_id").filter("unit_kind = 'sentence' and trim(text) != ''")


def sentence_quality(spark, sf):
    rated = se.cleanup_scores(se.quality_columns(_sentences(spark, sf), "text", F.col("end_seconds") - F.col("start_seconds")))
    return rated.select("unit_id", "words", "quality", "length_bucket", "duration_bucket", "autonomy", "boundary", "continuation")


def _evidence(spark, sf):
    said = _once(spark, sf, "utterances", "utterance_id").filter("trim(text) != '' and transcript_chunk_id is not null")
    return se.speaker_evidence(said, "transcript_chunk_id", "speaker_id", "speaker_is_uncertain", "start_seconds", "end_seconds", "text", ["start_seconds", "utterance_id"])


def sentence_speaker_evidence(spark, sf):
    return _evidence(spark, sf)


def speaker_recovery(spark, sf):
    chunks = _once(spark, sf, "transcript_chunks", "chunk_id").filter("start_seconds is not null").withColumn("words", F.size(F.split(F.trim("text"), r"\s+")))
    rows = chunks.join(_evidence(spark, sf).withColumnRenamed("transcript_chunk_id", "chunk_id"), "chunk_id")
    out = se.recovered_speakers(rows, "audio_source_id", ["start_seconds", "chunk_id"], "start_seconds", "end_seconds", "words")
    return out.select("chunk_id", "sentence_speaker", "speaker_status", "recovered_speaker")


def sentence_review(spark, sf):
    said = _once(spark, sf, "utterances", "utterance_id").filter("trim(text) != '' and transcript_chunk_id is not null")
    inside = said.groupBy("transcript_chunk_id").agg(
        F.coalesce(F.bool_or(F.col("speaker_is_uncertain") & F.col("speaker_id").isNotNull()), F.lit(False)).alias("has_uncertain"), F.bool_or(F.col("speaker_id").isNull()).alias("has_unassigned"),
        (F.countDistinct("speaker_id") > 1).alias("has_change"),
    )
    chunks = _once(spark, sf, "transcript_chunks", "chunk_id").filter("trim(text) != ''")
    rated = se.quality_columns(chunks, "text", F.col("end_seconds") - F.col("start_seconds"))
    rows = rated.join(inside.withColumnRenamed("transcript_chunk_id", "chunk_id"), "chunk_id").join(_evidence(spark, sf).withColumnRenamed("transcript_chunk_id", "chunk_id"), "chunk_id")
    out = se.review_labels(rows, "quality", "speaker_status", F.col("has_change"), F.col("has_uncertain"), F.col("has_unassigned"))
    return out.select("chunk_id", "quality", "speaker_status", "merge_safety", "speaker_confidence", F.array_join("review_flags", ",").alias("flags"), "review_priority")


def provenance_validation(spark, sf):
    """Utterances against the chunks that name them as their words; delivered twice, a link repeats."""
    said = _once(spark, sf, "utterances", "utterance_id")
    links = table(spark, sf, "utterances").filter("aligned_segment_id is not null").select("audio_source_id", "utterance_id", F.col("transcript_chunk_id").alias("sentence_id"))
    return se.provenance_report(said, links, "audio_source_id", "utterance_id", "sentence_id")


def sentence_reconstruction(spark, sf):
    rows = _grouped(spark, sf).select(
        F.col("audio_source_id").alias("source"), "group_no", F.struct("start_seconds", "utterance_id").alias("place"), "utterance_id", "text", F.col("start_seconds").alias("start"),
        F.col("end_seconds").alias("end"), F.col("speaker_id").alias("speaker"), F.coalesce("speaker_is_uncertain", F.lit(False)).alias("uncertain"),
    )
    return se.reconstruct_sentences(rows)


def _units(spark, sf):
    return _once(spark, sf, "segmentation_units", "unit_id")


def segment_structural(spark, sf):
    return sg.segment_units(_units(spark, sf), "structural")


def segment_windowed(spark, sf):
    return sg.segment_units(_units(spark, sf), "windowed")


def segment_adaptive(spark, sf):
    return sg.segment_units(_units(spark, sf), "adaptive")


def segment_summary(spark, sf):
    return sg.segment_summary(sg.all_modes(_units(spark, sf)))


_QUERIES = (
    utterance_groups, fallback_sentence_split, boundary_snap, sentence_quality, sentence_speaker_evidence, speaker_recovery, sentence_review, provenance_validation, sentence_reconstruction,
    segment_structural, segment_windowed, segment_adaptive, segment_summary,
)
QUERIES = {f.__name__: f for f in _QUERIES}

_U = "u AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM utterances)"
_C = "c AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM transcript_chunks)"
_MARKERS = "('and','or','but','because','if','then','that','which','when','where','while','to','for','with','without','of','in','on','at','from','into','the','a','an','e','ed','o','ma','per','che','di','da','con','se','quando','dove','mentre','quindi','il','lo','la','gli','le','un','uno','una')"


def _quality(rows: str) -> str:
    """SQL of `quality_columns` over rows with text and seconds."""
    return f"""SELECT *, CASE WHEN si OR ei OR (words <= 3 AND NOT strong) THEN 'fragment' WHEN words >= 24 OR coalesce(seconds >= 12, false) OR clauses >= 2 THEN 'run_on'
            WHEN words <= 3 OR length(text) <= 20 OR coalesce(seconds <= 2, false) OR si OR ei OR NOT strong THEN 'borderline' ELSE 'good' END AS quality,
            CASE WHEN words <= 3 THEN 'short' WHEN words >= 24 THEN 'long' ELSE 'medium' END AS length_bucket,
            CASE WHEN seconds <= 2 THEN 'short' WHEN seconds >= 12 THEN 'long' WHEN seconds IS NOT NULL THEN 'medium' END AS duration_bucket
        FROM (SELECT *, len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS words, lower(regexp_extract(text, '^[^\\p{{L}}\\p{{N}}]*([\\p{{L}}\\p{{N}}]+)', 1)) IN {_MARKERS} AS si,
            lower(regexp_extract(text, '([\\p{{L}}\\p{{N}}]+)[^\\p{{L}}\\p{{N}}]*$', 1)) IN {_MARKERS} AS ei, regexp_matches(text, '[.!?][''"”»)\\]]*\\s*$') AS strong,
            len(regexp_extract_all(text, '[,;:]')) AS clauses FROM {rows})"""


_EVIDENCE = f"""{_U}, e0 AS (SELECT transcript_chunk_id AS cid, speaker_id, coalesce(speaker_is_uncertain, false) AS unsure, len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS n, greatest(end_seconds - start_seconds, 0) AS d,
            row_number() OVER (PARTITION BY transcript_chunk_id ORDER BY start_seconds DESC, utterance_id DESC) = 1 AS closing FROM u WHERE trim(text) <> '' AND transcript_chunk_id IS NOT NULL),
    e1 AS (SELECT *, (CASE WHEN speaker_id IS NULL THEN 0.5 WHEN unsure THEN 0.65 ELSE 1.0 END + 0.35 * least(d, 1.0) + 0.25 * least(n / 4, 1.0)) * CASE WHEN d <= 0.45 OR n <= 2 THEN 0.5 ELSE 1.0 END * CASE WHEN closing THEN 1.08 ELSE 1.0 END AS w FROM e0),
    e2 AS (SELECT cid, speaker_id, sum(w) AS w, sum(CASE WHEN unsure THEN 0.0 ELSE w END) AS stable, sum(d) AS d, sum(n) AS n FROM e1 GROUP BY ALL),
    e3 AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY round(w, 9) DESC, round(stable, 9) DESC, round(d, 9) DESC, n DESC, speaker_id DESC) AS p FROM e2 WHERE speaker_id IS NOT NULL),
    e4 AS (SELECT cid, max(speaker_id) FILTER (p = 1) AS top, max(w) FILTER (p = 1) AS w1, max(w) FILTER (p = 2) AS w2, max(stable) FILTER (p = 1) AS stable1, sum(w) AS all_w FROM e3 GROUP BY 1),
    e5 AS (SELECT cid, sum(CASE WHEN speaker_id IS NULL THEN w ELSE 0.0 END) AS noise FROM e2 GROUP BY 1),
    e6 AS (SELECT *, coalesce(w1 / all_w, 0) AS share, coalesce(w2 / all_w, 0) AS second_share, coalesce((w1 - coalesce(w2, 0)) / w1, 0) AS margin FROM e5 LEFT JOIN e4 USING (cid)),
    e7 AS (SELECT *, CASE WHEN w1 IS NOT NULL AND share >= 0.58 AND margin >= 0.45 AND (w1 > noise OR stable1 > w1 - stable1) AND NOT (stable1 <= 0 AND noise >= 0.75 * w1)
            THEN CASE WHEN stable1 < w1 - stable1 THEN 'uncertain' WHEN second_share = 0 THEN 'stable' WHEN share >= 0.66 AND stable1 >= w1 - stable1 THEN 'mostly_stable' ELSE 'uncertain' END
            WHEN second_share >= 0.33 THEN 'mixed' ELSE 'unassigned' END AS speaker_status FROM e6),
    evidence AS (SELECT cid AS transcript_chunk_id, CASE WHEN speaker_status IN ('stable', 'mostly_stable', 'uncertain') THEN top END AS sentence_speaker, speaker_status, share, second_share, margin, noise FROM e7)"""
_Q = "q"
_PIECES = """g AS (SELECT DISTINCT group_id, text FROM rendered_groups WHERE text IS NOT NULL),
    s AS (SELECT group_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?;:]) ', '\\1' || chr(1), 'g'), chr(1)), lambda p: p <> '') AS ps FROM g),
    pieces AS (SELECT group_id, i - 1 AS piece_no, ps[i] AS piece FROM (SELECT *, unnest(generate_series(1, len(ps))) AS i FROM s))"""
SQL = {
    "utterance_groups": f"""WITH {_U}, k AS (SELECT *, CASE WHEN speaker_id IS NOT NULL AND NOT coalesce(speaker_is_uncertain, false) THEN speaker_id END AS known FROM u WHERE trim(text) <> ''),
        l AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR start_seconds - lag(end_seconds) OVER w > 2.5 OR known <> lag(known) OVER w THEN 1 ELSE 0 END AS br FROM k WINDOW w AS (PARTITION BY audio_source_id ORDER BY start_seconds, utterance_id)),
        n AS (SELECT *, sum(br) OVER (PARTITION BY audio_source_id ORDER BY start_seconds, utterance_id ROWS UNBOUNDED PRECEDING) AS group_no FROM l)
        SELECT audio_source_id, group_no, count(*) AS utterances, min(start_seconds) AS start, max(end_seconds) AS "end" FROM n GROUP BY ALL""",
    "fallback_sentence_split": f"WITH {_PIECES} SELECT *, sum(length(piece) + 1) OVER (PARTITION BY group_id ORDER BY piece_no) - 1 AS piece_end FROM pieces",
    "sentence_quality": f"""WITH r AS (SELECT DISTINCT unit_id, text, end_seconds - start_seconds AS seconds FROM segmentation_units WHERE unit_kind = 'sentence' AND trim(text) <> ''), q AS ({_quality('r')}),
        f AS (SELECT *, quality = 'fragment' AS fr, quality = 'run_on' AS ro, quality = 'borderline' AS bo FROM q)
        SELECT unit_id, words, quality, length_bucket, duration_bucket,
            least(1, greatest(0, 0.78 - 0.34 * fr::INT - 0.22 * ro::INT - 0.12 * bo::INT - 0.14 * si::INT + 0.06 * (words BETWEEN 4 AND 23)::INT)) AS autonomy,
            least(1, greatest(0, 0.76 - 0.18 * fr::INT - 0.24 * ro::INT - 0.10 * bo::INT - 0.18 * ei::INT - 0.16 * (NOT strong)::INT - 0.10 * (clauses >= 2)::INT + 0.08 * strong::INT)) AS boundary,
            least(1, greatest(0, 0.08 + 0.24 * fr::INT + 0.20 * ro::INT + 0.10 * bo::INT + 0.16 * si::INT + 0.14 * ei::INT + 0.08 * (NOT strong)::INT + 0.08 * (clauses >= 2)::INT)) AS continuation FROM f""",
    "sentence_speaker_evidence": f"WITH {_EVIDENCE} SELECT * FROM evidence",
    "speaker_recovery": f"""WITH {_EVIDENCE}, {_C}, r AS (SELECT c.*, e.*, len(string_split_regex(trim(text), '\\s+')) AS words, CASE WHEN speaker_status IN ('stable', 'mostly_stable') THEN sentence_speaker END AS who
            FROM c JOIN evidence e ON e.transcript_chunk_id = c.chunk_id WHERE start_seconds IS NOT NULL),
        n AS (SELECT *, CASE WHEN start_seconds - lag(end_seconds) OVER w <= 1.0 THEN lag(who) OVER w END AS l, CASE WHEN lead(start_seconds) OVER w - end_seconds <= 1.0 THEN lead(who) OVER w END AS r FROM r WINDOW w AS (PARTITION BY audio_source_id ORDER BY start_seconds, chunk_id))
        SELECT chunk_id, sentence_speaker, speaker_status, CASE WHEN speaker_status = 'unassigned' AND end_seconds - start_seconds <= 2.25 AND words <= 6 AND second_share <= 0.2
            THEN CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN CASE WHEN l = r THEN l END ELSE coalesce(l, r) END END AS recovered_speaker FROM n""",
    "sentence_review": f"""WITH {_EVIDENCE}, {_C}, r AS (SELECT chunk_id, text, end_seconds - start_seconds AS seconds FROM c WHERE trim(text) <> ''), q AS ({_quality('r')}),
        i AS (SELECT transcript_chunk_id, coalesce(bool_or(speaker_is_uncertain AND speaker_id IS NOT NULL), false) AS hu, bool_or(speaker_id IS NULL) AS ha, count(DISTINCT speaker_id) > 1 AS hc FROM u WHERE trim(text) <> '' AND transcript_chunk_id IS NOT NULL GROUP BY 1),
        j AS (SELECT *, speaker_status = 'mixed' OR hc OR (quality = 'fragment' AND speaker_status = 'unassigned') AS risky FROM q JOIN i ON i.transcript_chunk_id = q.chunk_id JOIN evidence e ON e.transcript_chunk_id = q.chunk_id),
        k AS (SELECT *, CASE WHEN risky THEN 'risky' WHEN hu OR ha OR quality IN ('fragment', 'run_on') OR speaker_status IN ('uncertain', 'unassigned') THEN 'borderline' ELSE 'safe' END AS merge_safety FROM j)
        SELECT chunk_id, quality, speaker_status, merge_safety, CASE speaker_status WHEN 'stable' THEN 'high' WHEN 'mostly_stable' THEN 'medium' ELSE 'low' END AS speaker_confidence,
            array_to_string(list_filter([CASE WHEN quality <> 'good' THEN 'semantic_' || quality END, CASE WHEN risky THEN 'merge_risky' END, CASE WHEN hu THEN 'uncertain_source' END, CASE WHEN ha THEN 'unassigned_source' END, CASE WHEN hc THEN 'speaker_change_inside' END], lambda x: x IS NOT NULL), ',') AS flags,
            CASE WHEN speaker_status = 'mixed' OR risky THEN 'high' WHEN merge_safety = 'borderline' OR quality <> 'good' THEN 'medium' ELSE 'low' END AS review_priority FROM k""",
    "provenance_validation": f"""WITH {_U}, b AS (SELECT DISTINCT audio_source_id, utterance_id, 1 AS known FROM u),
        l AS (SELECT audio_source_id, utterance_id, count(DISTINCT transcript_chunk_id) AS sentences, count(*) - count(DISTINCT transcript_chunk_id) AS repeats FROM utterances WHERE aligned_segment_id IS NOT NULL GROUP BY ALL),
        f AS (SELECT * FROM b FULL OUTER JOIN l USING (audio_source_id, utterance_id)),
        r AS (SELECT audio_source_id, count(known) AS utterances, count(*) FILTER (sentences IS NULL) AS unmapped, count(*) FILTER (known IS NOT NULL AND sentences > 1) AS multi_assigned, coalesce(sum(repeats), 0) AS repeated_links,
            count(*) FILTER (known IS NULL) AS unknown, max(sentences) AS most_sentences FROM f GROUP BY 1)
        SELECT *, unmapped + multi_assigned + repeated_links + unknown AS anomalies FROM r""",
}
