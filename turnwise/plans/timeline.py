"""Queries of transcript merging, utterance building and speaker attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.operators import speakers as sp
from turnwise.operators import timeline as tl
from turnwise.session import table


def _once(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    return table(spark, sf, name).drop("ingested_at").dropDuplicates([key])


def _units(spark, sf):
    return tl.merged_units(table(spark, sf, "transcript_chunks"), table(spark, sf, "audio_sources"))


def merge_order(spark, sf):
    return _units(spark, sf).select("session_id", "unit_no", "chunk_id", "chunk_occurrence", "start", "end")


def overlap_warnings(spark, sf):
    return _units(spark, sf).filter("overlaps_earlier").select("session_id", "chunk_id", "start")


def timing_policy(spark, sf):
    return tl.clamp_timing(_once(spark, sf, "segmentation_units", "unit_id")).select("unit_id", "clean_start", "clean_end", "timing_note")


def full_text_pages(spark, sf):
    return tl.full_text_pages(_units(spark, sf))


def text_normalize(spark, sf):
    return tl.normalize_units(_once(spark, sf, "transcript_chunks", "chunk_id").select("chunk_id", "text"), keep_raw=False)


def _words(spark, sf):
    said = _once(spark, sf, "utterances", "utterance_id").filter("aligned_segment_id is not null")
    return tl.words_of(said, "aligned_segment_id", "text", "start_seconds", "end_seconds")


def aligned_words(spark, sf):
    return _words(spark, sf).select("utterance_id", "word_index", "word", "word_start", "word_end")


_ORDER = ["start_seconds", "utterance_id", "word_index"]


def utterance_gap_split(spark, sf):
    """Words of a chunk, in time order, split into utterances at silences."""
    words = _words(spark, sf).filter("transcript_chunk_id is not null")
    drafts = tl.gap_split_words(words, "transcript_chunk_id", _ORDER, "word_start", "word_end", max_gap=0.25)
    return tl.drafts_to_utterances(drafts, "transcript_chunk_id", _ORDER, "word", "word_start", "word_end").select("transcript_chunk_id", "draft_no", "text", "start", "end", "words")


def segment_fallback(spark, sf):
    said = utterance_gap_split(spark, sf).withColumnRenamed("transcript_chunk_id", "chunk_id")
    chunks = _once(spark, sf, "transcript_chunks", "chunk_id").select("chunk_id", "text", F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"))
    return tl.with_segment_fallback(said, chunks.filter("trim(text) != ''"), "chunk_id").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("utterances"), F.min("start").alias("start"), F.max("end").alias("end"))


def _speech(spark, sf):
    u = _once(spark, sf, "utterances", "utterance_id").filter("speaker_id is not null")
    return u.select("audio_source_id", F.col("speaker_id").alias("speaker"), F.col("start_seconds").alias("s_start"), F.col("end_seconds").alias("s_end"))


def _attributed(spark, sf):
    chunks = _once(spark, sf, "transcript_chunks", "chunk_id").select(F.col("chunk_id").alias("utt_id"), "audio_source_id", F.col("start_seconds").alias("u_start"), F.col("end_seconds").alias("u_end"))
    return sp.attribute_speakers(chunks, _speech(spark, sf))


def speaker_overlap_attribution(spark, sf):
    return _attributed(spark, sf).drop("duration", "audio_source_id", "u_start", "u_end")


_RUN = ("audio_source_id", ["u_start", "utt_id"], "speaker", "u_start", "u_end", "top_overlap", "is_degraded")


def _decided(spark, sf):
    return _attributed(spark, sf).filter("u_start is not null").withColumn("is_degraded", F.col("confidence") < 0.5)


def speaker_runs(spark, sf):
    rows = sp.runs_of(_decided(spark, sf), *_RUN)
    return sp.run_table(rows, *_RUN).select("audio_source_id", "run_no", "run_speaker", "run_start", "run_end", "evidence", "size", "unstable")


def speaker_run_smoothing(spark, sf):
    return sp.smooth_speakers(_decided(spark, sf), *_RUN).select("utt_id", "speaker", "smoothed", "smoothing")


def speaker_first_appearance(spark, sf):
    return sp.speaker_names(_speech(spark, sf), "audio_source_id", "speaker", "s_start")


def speaker_roles(spark, sf):
    return sp.role_estimates(_speech(spark, sf), "audio_source_id", "speaker", "s_start")


def audio_quality(spark, sf):
    """Quality of sample windows; the embedding vectors stand for windows of samples."""
    e = table(spark, sf, "embeddings").withColumn("samples", F.col("embedding").cast("array<double>"))
    return sp.audio_quality(e, "samples", F.lit(0.5)).select("vec_id", "rms", "crossing_rate", F.array_join("quality_reasons", ",").alias("reasons"), "is_degraded")


_QUERIES = (
    merge_order, overlap_warnings, timing_policy, full_text_pages, text_normalize, aligned_words, utterance_gap_split, segment_fallback, speaker_overlap_attribution,
    speaker_runs, speaker_run_smoothing, speaker_first_appearance, speaker_roles, audio_quality,
)
QUERIES = {f.__name__: f for f in _QUERIES}


def _clamped(table_: str) -> str:
    missing = "(start_seconds IS NULL OR isnan(start_seconds) OR end_seconds IS NULL OR isnan(end_seconds))"
    return f"""SELECT *, CASE WHEN {missing} THEN 0.0 ELSE greatest(start_seconds, 0.0) END AS clean_start,
        CASE WHEN {missing} THEN 0.0 ELSE greatest(end_seconds, greatest(start_seconds, 0.0)) END AS clean_end,
        CASE WHEN {missing} THEN 'non_numeric' WHEN start_seconds < 0 THEN 'negative_start' WHEN end_seconds < 0 THEN 'negative_end' WHEN end_seconds < start_seconds THEN 'reversed' END AS timing_note FROM {table_}"""


_UNITS = f"""clamped AS ({_clamped("transcript_chunks")}),
    placed AS (SELECT c.*, s.order_index FROM clamped c LEFT JOIN (SELECT DISTINCT session_id, audio_source_id, order_index FROM audio_sources) s USING (session_id, audio_source_id)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY order_index NULLS LAST, audio_source_id, clean_start, clean_end, ingested_at, chunk_id) AS unit_no,
        max(clean_end) OVER (PARTITION BY session_id, audio_source_id ORDER BY clean_start, clean_end, ingested_at, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM placed),
    units AS (SELECT *, row_number() OVER (PARTITION BY session_id, chunk_id ORDER BY unit_no) AS chunk_occurrence, clean_start < greatest(coalesce(reach, 0), 0) AS overlaps_earlier FROM numbered)"""

_U = "u AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM utterances)"
_C = "c AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM transcript_chunks)"
_WORDS = f"""{_U}, lists AS (SELECT *, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '') AS ws FROM u WHERE aligned_segment_id IS NOT NULL AND text IS NOT NULL),
    words AS (SELECT * EXCLUDE (ws), ws[i] AS word, i AS word_index, start_seconds + greatest(end_seconds - start_seconds, 0) * (i - 1) / len(ws) AS word_start,
        start_seconds + greatest(end_seconds - start_seconds, 0) * i / len(ws) AS word_end FROM (SELECT *, unnest(generate_series(1, len(ws))) AS i FROM lists WHERE len(ws) > 0))"""
_DRAFTS = f"""{_WORDS}, lasts AS (SELECT *, last_value(coalesce(word_end, word_start) IGNORE NULLS) OVER (PARTITION BY transcript_chunk_id ORDER BY start_seconds, utterance_id, word_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
        FROM words WHERE transcript_chunk_id IS NOT NULL),
    marked AS (SELECT *, CASE WHEN word_start - prev > 0.25 THEN 1 ELSE 0 END AS split FROM lasts),
    drafted AS (SELECT *, sum(split) OVER (PARTITION BY transcript_chunk_id ORDER BY start_seconds, utterance_id, word_index ROWS UNBOUNDED PRECEDING) AS draft_no FROM marked),
    drafts AS (SELECT transcript_chunk_id, draft_no, regexp_replace(regexp_replace(string_agg(word, ' ' ORDER BY start_seconds, utterance_id, word_index), ' ([,.;:!?)\\]}}])', '\\1', 'g'), '([(\\[{{]) ', '\\1', 'g') AS text,
        arg_min(word_start, (start_seconds, utterance_id, word_index)) AS start, greatest(arg_max(word_end, (start_seconds, utterance_id, word_index)), arg_min(word_start, (start_seconds, utterance_id, word_index))) AS "end",
        count(*) AS words FROM drafted GROUP BY transcript_chunk_id, draft_no)"""
_SPEECH = f"{_U}, speech AS (SELECT audio_source_id, speaker_id AS speaker, start_seconds AS s, end_seconds AS e FROM u WHERE speaker_id IS NOT NULL)"
_ATTR = f"""{_SPEECH}, {_C},
    o AS (SELECT c.chunk_id, speech.speaker, sum(least(c.end_seconds, speech.e) - greatest(c.start_seconds, speech.s)) AS o FROM c JOIN speech ON c.audio_source_id = speech.audio_source_id AND speech.s < c.end_seconds AND speech.e > c.start_seconds
          WHERE c.end_seconds > c.start_seconds AND speech.e > speech.s GROUP BY ALL),
    p AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY o DESC, speaker) AS p FROM o),
    b AS (SELECT chunk_id, max(speaker) FILTER (p = 1) AS top_speaker, max(o) FILTER (p = 1) AS top_overlap, max(o) FILTER (p = 2) AS runner_up FROM p GROUP BY 1),
    r AS (SELECT c.chunk_id AS utt_id, audio_source_id, start_seconds AS u_start, end_seconds AS u_end, end_seconds - start_seconds AS d, top_speaker, coalesce(top_overlap, 0) AS top_overlap, coalesce(runner_up, 0) AS runner_up,
            CASE WHEN end_seconds > start_seconds THEN coalesce(top_overlap, 0) / (end_seconds - start_seconds) ELSE 0 END AS ratio FROM c LEFT JOIN b USING (chunk_id)),
    s AS (SELECT *, CASE WHEN d IS NULL OR d <= 0 THEN 'invalid_utterance_timing' WHEN top_overlap <= 0 THEN 'no_overlap' WHEN ratio < 0.6 THEN 'low_overlap' WHEN runner_up >= 0.85 * top_overlap THEN 'ambiguous_overlap' ELSE 'assigned' END AS status FROM r),
    decided AS (SELECT *, CASE WHEN status = 'assigned' THEN top_speaker END AS speaker,
            CASE WHEN status = 'assigned' THEN least(1, greatest(0, 0.55 * least(1, ratio) + 0.25 * (1 - runner_up / top_overlap) + 0.2 * least(1, top_overlap / d))) ELSE 0 END AS confidence FROM s)"""


def _runs(rows: str, speaker: str, out: str) -> str:
    return f"""{out}_l AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag({speaker}) OVER w IS DISTINCT FROM {speaker} THEN 1 ELSE 0 END AS change FROM {rows} WINDOW w AS (PARTITION BY audio_source_id ORDER BY u_start, utt_id)),
    {out} AS (SELECT * EXCLUDE (change), sum(change) OVER (PARTITION BY audio_source_id ORDER BY u_start, utt_id ROWS UNBOUNDED PRECEDING) AS run_no FROM {out}_l),
    {out}_t0 AS (SELECT audio_source_id, run_no, arg_min({speaker}, (u_start, utt_id)) FILTER ({speaker} IS NOT NULL) AS run_speaker, min(u_start) AS run_start, arg_max(u_end, (u_start, utt_id)) AS run_end, sum(top_overlap) AS evidence, bool_and(is_degraded) AS all_degraded, count(*) AS size FROM {out} GROUP BY ALL),
    {out}_t AS (SELECT *, run_end - run_start AS run_duration, (run_end - run_start < 1.25) OR evidence < 1.0 OR (all_degraded AND run_end - run_start <= 1.75) AS unstable,
        last_value(run_speaker IGNORE NULLS) OVER (PARTITION BY audio_source_id ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
        last_value(run_speaker IGNORE NULLS) OVER (PARTITION BY audio_source_id ORDER BY run_no DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after FROM {out}_t0)"""


def _pass(rows: str, out: str, step: str, take: str) -> str:
    return f"""{_runs(rows, "smoothed", out)},
    {out}_f AS (SELECT r.* EXCLUDE (smoothed, smoothing, run_no), CASE WHEN {take} THEN before ELSE smoothed END AS smoothed, CASE WHEN {take} THEN '{step}' ELSE smoothing END AS smoothing
        FROM {out} r JOIN {out}_t t ON r.audio_source_id = t.audio_source_id AND r.run_no = t.run_no)"""


_BASE = f"{_ATTR}, base AS (SELECT *, confidence < 0.5 AS is_degraded FROM decided WHERE u_start IS NOT NULL)"
SQL = {
    "merge_order": f'WITH {_UNITS} SELECT session_id, unit_no, chunk_id, chunk_occurrence, clean_start AS start, clean_end AS "end" FROM units',
    "overlap_warnings": f"WITH {_UNITS} SELECT session_id, chunk_id, clean_start AS start FROM units WHERE overlaps_earlier",
    "timing_policy": f"WITH s AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM segmentation_units) SELECT unit_id, clean_start, clean_end, timing_note FROM ({_clamped('s')})",
    "full_text_pages": rf"""WITH {_UNITS}, p AS (SELECT *, (unit_no - 1) // 200 AS page_no FROM units)
        SELECT session_id, page_no, coalesce(string_agg(text, chr(10) ORDER BY unit_no) FILTER (trim(text) <> ''), '') AS text, coalesce(array_to_string(list_sort(list(DISTINCT detected_language) FILTER (detected_language IS NOT NULL)), ','), '') AS languages FROM p GROUP BY ALL""",
    "text_normalize": rf"""WITH {_C}, n AS (SELECT chunk_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ([,.;:!?])', '\1', 'g'), '([(\[{{]) ', '\1', 'g'), ' ([)\]}}])', '\1', 'g'), '([,;:!?])(\p{{L}})', '\1 \2', 'g') AS text FROM c)
        SELECT * FROM n WHERE text IS NOT NULL AND text <> ''""",
    "aligned_words": f"WITH {_WORDS} SELECT utterance_id, word_index, word, word_start, word_end FROM words",
    "utterance_gap_split": f"WITH {_DRAFTS} SELECT * FROM drafts",
    "segment_fallback": f"""WITH {_DRAFTS}, {_C}, x AS (SELECT transcript_chunk_id AS chunk_id, start, "end" FROM drafts UNION ALL
        SELECT chunk_id, start_seconds, end_seconds FROM c WHERE trim(text) <> '' AND chunk_id NOT IN (SELECT transcript_chunk_id FROM drafts))
        SELECT chunk_id, count(*) AS utterances, min(start) AS start, max("end") AS "end" FROM x GROUP BY 1""",
    "speaker_overlap_attribution": f"WITH {_ATTR} SELECT utt_id, speaker, status, top_overlap, runner_up, ratio, confidence FROM decided",
    "speaker_runs": f"WITH {_BASE}, {_runs('base', 'speaker', 'x')} SELECT audio_source_id, run_no, run_speaker, run_start, run_end, evidence, size, unstable FROM x_t",
    "speaker_run_smoothing": f"""WITH {_BASE}, s0 AS (SELECT *, speaker AS smoothed, NULL::VARCHAR AS smoothing FROM base),
        {_pass('s0', 'p1', 'bridged_gap', 'coalesce(run_speaker IS NULL AND run_duration <= 0.5 AND before = after, false)')},
        {_pass('p1_f', 'p2', 'smoothed_switch', 'coalesce(run_speaker IS NOT NULL AND unstable AND before = after AND before <> run_speaker, false)')},
        {_pass('p2_f', 'p3', 'kept_previous', 'coalesce(all_degraded AND unstable AND before IS NOT NULL AND before IS DISTINCT FROM run_speaker, false)')}
        SELECT utt_id, speaker, smoothed, smoothing FROM p3_f""",
    "speaker_first_appearance": f"""WITH {_SPEECH}, f AS (SELECT audio_source_id, speaker, min(s) AS first FROM speech GROUP BY ALL)
        SELECT audio_source_id, speaker, printf('SPEAKER_%02d', row_number() OVER (PARTITION BY audio_source_id ORDER BY first, speaker) - 1) AS speaker_id FROM f""",
    "speaker_roles": f"""WITH {_SPEECH}, f AS (SELECT audio_source_id, speaker, min(s) AS first FROM speech GROUP BY ALL)
        SELECT audio_source_id, speaker, CASE WHEN row_number() OVER (PARTITION BY audio_source_id ORDER BY first, speaker) = 1 THEN 'teacher' ELSE 'student' END AS role, 0.25 AS role_confidence FROM f""",
    "audio_quality": """WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), y AS (SELECT vec_id, sqrt(list_sum(list_transform(v, lambda a: a * a)) / len(v)) AS rms,
            list_sum(list_transform(generate_series(1, len(v) - 1), lambda i: CASE WHEN (v[i] >= 0) <> (v[i + 1] >= 0) THEN 1 ELSE 0 END)) / (len(v) - 1) AS crossing_rate FROM x)
        SELECT vec_id, rms, crossing_rate, array_to_string(list_filter([CASE WHEN rms < 0.35 * 0.5 THEN 'low_energy' END, CASE WHEN crossing_rate > 0.22 THEN 'high_zero_crossing_rate' END], lambda r: r IS NOT NULL), ',') AS reasons,
            rms < 0.35 * 0.5 OR crossing_rate > 0.22 AS is_degraded FROM y""",
}
