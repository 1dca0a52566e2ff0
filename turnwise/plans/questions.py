"""Queries of questions, answers, their ranking and gates, and of semantic scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwise.functions import lexical as lx
from turnwise.operators import questions as qs
from turnwise.operators import semantic as sm
from turnwise.operators.ordering import grouped_running
from turnwise.plans.timeline import _once
from turnwise.session import table


def _qa(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "qa_candidates", "qa_candidate_id")


def rule_text_tokens(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null").withColumn("rule", lx.rule_text(F.col("text")))
    return d.select("doc_id", F.sha1("rule").alias("rule_hash"), F.size(lx.rule_tokens(F.col("rule"))).alias("tokens"), F.size(lx.content_tokens(F.col("rule"))).alias("content_tokens"), F.size(lx.number_tokens(F.col("rule"))).alias("numbers"))


def answer_cues(spark, sf):
    q = _qa(spark, sf).filter("answer_text is not null").withColumn("rule", lx.rule_text(F.col("answer_text")))
    return q.select("qa_candidate_id", lx.cue_weight(F.col("rule"), lx.ANSWER_CUES, 0.30).alias("cue_weight"), F.array_join(lx.cue_codes(F.col("rule"), lx.ANSWER_CUES), ",").alias("codes"), lx.cue_label(F.col("rule"), lx.ANSWER_CUES).alias("label"))


def _scored(spark, sf):
    return qs.question_scores(_qa(spark, sf).filter("question_text is not null"), "question_text")


def question_scores(spark, sf):
    return _scored(spark, sf).select("qa_candidate_id", "question_tokens", "intent", "question_kind", "question_score", "is_contextual", "question_band")


def question_answer_alignment(spark, sf):
    q = _qa(spark, sf).filter("question_text is not null and answer_text is not null")
    return qs.alignment_columns(q, "question_text", "answer_text").select("qa_candidate_id", "shared_keywords", "shared_numbers", "token_overlap", "new_tokens", "alignment")


def _answered(spark, sf):
    q = _scored(spark, sf).withColumn("gap", F.col("answer_timing.start_seconds") - F.col("question_timing.end_seconds"))
    different, same = F.coalesce(F.col("similarity_score") <= sm.DIFFERENT_VOICE, F.lit(False)), F.coalesce(F.col("similarity_score") >= sm.SAME_VOICE, F.lit(False))
    distance = F.when(F.col("gap") <= 4, 1).when(F.col("gap") <= 10, 2).otherwise(3)
    out = qs.answer_scores(q, "question_text", "answer_text", F.col("gap"), distance, different, same)
    asks = F.coalesce(F.col("answer_text").contains("?"), F.lit(False))
    return out.withColumn("distance", distance).withColumn("pair_confidence", qs.pair_confidence(F.col("question_score"), F.col("answer_score"), F.lit(False), asks))


def answer_scores(spark, sf):
    return _answered(spark, sf).filter("answer_text is not null").select("qa_candidate_id", "answer_score", "part_distance", "part_cues", "part_responsive", "part_silence", "part_broken", "part_echo", "part_voice", "pair_confidence")


def answer_rank(spark, sf):
    return qs.ranked_answers(_answered(spark, sf), ["audio_source_id", "question_text"], "pair_confidence", "distance", "gap", "qa_candidate_id").select("qa_candidate_id", "place")


def answer_rerank(spark, sf):
    return qs.reranked(_answered(spark, sf), ["audio_source_id", "question_text"], "answer_score", "retrieval_score", "qa_candidate_id").select("qa_candidate_id", "final_score", "final_place", "fallback")


def _asked(spark, sf):
    q = _qa(spark, sf).filter("question_timing.start_seconds is not null and question_timing.end_seconds is not null and question_text is not null")
    return q.select(F.col("audio_source_id").alias("source"), F.col("qa_candidate_id").alias("question_id"), F.col("question_timing.start_seconds").alias("q_start"), F.col("question_timing.end_seconds").alias("q_end"), F.col("question_text").alias("text"))


def _sentences(spark, sf):
    u = _once(spark, sf, "segmentation_units", "unit_id").filter("unit_kind = 'sentence' and start_seconds is not null and end_seconds is not null and trim(text) != ''")
    return u.select(F.col("audio_source_id").alias("source"), "unit_id", F.col("start_seconds").alias("u_start"), F.col("end_seconds").alias("u_end"), "text")


def answer_windows(spark, sf):
    return qs.answer_windows(_asked(spark, sf).drop("text"), _sentences(spark, sf)).select("question_id", "span", "first_unit", "last_unit", "gap", "seconds", F.length("text").alias("text_length"))


def _line(spark, sf):
    """Questions and units in one order per source."""
    q = _asked(spark, sf).select("source", F.col("question_id").alias("id"), F.col("q_end").alias("t"), F.lit(0).alias("kind"), "text")
    u = _sentences(spark, sf).select("source", F.col("unit_id").alias("id"), F.col("u_start").alias("t"), F.lit(1).alias("kind"), "text")
    return grouped_running(q.unionByName(u), ["source"], ["t", "kind", "id"], name="k")


def deferred_recurrence(spark, sf):
    line = _line(spark, sf)
    return qs.keyword_recurrence(line.filter("kind = 0").select("source", F.col("id").alias("question_id"), "k", "text"), line.filter("kind = 1").select("source", "k", "text"))


def context_units(spark, sf):
    """Two units before each question, by position among the units that began before the question's end."""
    line = _line(spark, sf).filter("kind = 0").select("source", F.col("id").alias("question_id"), "k", "text")
    asked = grouped_running(line, ["source"], ["k"], name="nth").withColumn("qk", F.col("k") - F.col("nth"))
    return qs.context_units(asked.select("source", "question_id", "qk", "text"), _sentences(spark, sf))


def qa_quality(spark, sf):
    rated = _answered(spark, sf)
    context = F.when(F.col("continuation_text").isNotNull(), 0.90).otherwise(0.40)
    grounding = F.when(F.col("answer_timing").isNotNull(), 0.8).otherwise(0.3)
    out = qs.quality_features(rated, F.col("question_score"), F.col("answer_score"), context, grounding, "review_flags")
    return out.select("qa_candidate_id", "risk_score", "base_quality", "final_quality", "quality_band", "risk_band", F.array_join("risk_reasons", ",").alias("risk_reasons"))


def _gated(spark, sf):
    rated = _answered(spark, sf)
    rules = [
        (F.col("intent").isin("poll_or_check", "rhetorical_tag"), "weak_question_intent"), (F.coalesce(F.col("part_echo") < 0, F.lit(False)), "answer_echo"),
        (F.coalesce(F.col("part_broken") < 0, F.lit(False)) & (F.col("answer_tokens") < 5), "broken_answer"), (F.coalesce(F.array_contains("review_flags", "weak_boundary"), F.lit(False)) & (F.col("pair_confidence") < 0.55), "weak_boundary"),
    ]
    return qs.quality_gate(rated, F.col("pair_confidence"), rules)


def qa_gate(spark, sf):
    return _gated(spark, sf).select("qa_candidate_id", "suppressed_by", "emitted")


def speaker_rescue(spark, sf):
    gated = _gated(spark, sf).filter("not emitted")
    soft = F.col("suppressed_by").isin("below_min_confidence", "weak_boundary")
    eligible = F.coalesce(F.col("similarity_score") <= sm.DIFFERENT_VOICE, F.lit(False)) & soft
    return sm.rescued(gated, "session_id", "qa_candidate_id", eligible, checked=soft).select("qa_candidate_id", "rescued")


def qa_coverage(spark, sf):
    units = _once(spark, sf, "segmentation_units", "unit_id").filter("unit_kind = 'sentence' and text is not null")
    return qs.coverage(units, _gated(spark, sf), "session_id", "text", "suppressed_by")


_NEAR = ("audio_source_id", "qa_candidate_id", "at", "question_text", "answer_text")


def near_duplicate_pairs(spark, sf):
    return qs.near_duplicate_pairs(_qa(spark, sf).withColumn("at", F.col("question_timing.start_seconds")), *_NEAR)


def near_duplicate_decisions(spark, sf):
    return qs.without_near_duplicates(_qa(spark, sf).withColumn("at", F.col("question_timing.start_seconds")), *_NEAR, "confidence", "review_flags", "reason_codes")


def semantic_topk(spark, sf):
    """The four nearest vectors of every vector whose id is divisible by 20."""
    e = table(spark, sf, "embeddings")
    out = sm.cosine_top(e.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), e, "query_id", "vec_id", "embedding", 4, 0.2)
    return out.select("query_id", "vec_id", F.round("similarity", 4).alias("similarity"))


def semantic_index_topk(spark, sf):
    """The same from an inverted-file index, which may miss a few."""
    e = table(spark, sf, "embeddings")
    q = e.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return sm.indexed_top(q, e, "query_id", "vec_id", "embedding", 4, 0.2).select("query_id", "vec_id", F.round("similarity", 4).alias("similarity"))


def responsiveness_scores(spark, sf):
    s = _once(spark, sf, "responsiveness_scores", "qa_candidate_id").filter("question_answer_similarity is not null")
    return s.select("qa_candidate_id", sm.responsiveness(F.col("question_answer_similarity"), F.col("answer_continuation_similarity")).alias("responsiveness"))


def voice_check(spark, sf):
    q = _qa(spark, sf)
    qd, ad = F.col("question_timing.end_seconds") - F.col("question_timing.start_seconds"), F.col("answer_timing.end_seconds") - F.col("answer_timing.start_seconds")
    overlap = F.col("answer_timing.start_seconds") < F.col("question_timing.end_seconds")
    return sm.voice_check(q, F.col("similarity_score"), qd, ad, overlap).select("qa_candidate_id", "voice", "voice_penalty", "voice_bonus")


_QUERIES = (
    rule_text_tokens, answer_cues, question_scores, question_answer_alignment, answer_scores, answer_rank, answer_rerank, answer_windows, deferred_recurrence, context_units, qa_quality, qa_gate, speaker_rescue,
    qa_coverage, near_duplicate_pairs, near_duplicate_decisions, semantic_topk, semantic_index_topk, responsiveness_scores, voice_check,
)
QUERIES = {f.__name__: f for f in _QUERIES}


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _rule(col: str) -> str:
    return f"trim(regexp_replace(regexp_replace(translate(lower(regexp_replace({col}, '[’`]', '''', 'g')), '{lx.ACCENTED}', '{lx.PLAIN}'), '[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g'))"


def _tokens(rule: str) -> str:
    return f"regexp_extract_all({rule}, '[a-z0-9_'']+')"


_STOP = "[" + ", ".join(_s(w) for w in lx.STOPWORDS) + "]"


def _content(rule: str) -> str:
    return f"list_distinct(list_filter({_tokens(rule)}, lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t)))"


def _numbers(rule: str) -> str:
    return f"list_distinct(regexp_extract_all({rule}, '\\b\\d+(?:\\.\\d+)?\\b'))"


def _weights(rule: str, cues, most: float) -> str:
    return f"least({most}, " + " + ".join(f"CASE WHEN regexp_matches({rule}, {_s(p)}) THEN {w} ELSE 0.0 END" for p, _, _, w in cues) + ")"


def _label(rule: str, cues) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({rule}, {_s(p)}) THEN '{label}' END" for p, _, label, _ in cues) + ")"


def _overlap(a: str, b: str) -> str:
    return f"CASE WHEN least(len({a}), len({b})) > 0 THEN len(list_intersect({a}, {b})) / least(len({a}), len({b})) ELSE 0 END"


def rounded(sql: str) -> str:
    """SQL in which every clamp to 0 and 1 is rounded to four digits, as `lexical.clamp` does."""
    out, at = [], 0
    while (k := sql.find("least(1.0, ", at)) >= 0:
        depth, end = 0, k + len("least")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if not depth:
                break
        out.append(sql[at:k] + "(floor(least(1.0, " + rounded(sql[k + len("least(1.0, ") : end]) + " * 10000 + 0.500001) / 10000)")
        at = end
    return "".join(out) + sql[at:]


_QA = "qa AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM qa_candidates)"
_IN = lambda words: "(" + ", ".join(_s(w) for w in words) + ")"
_HEADS = _IN([*lx.INTERROGATIVES, *qs.AUXILIARIES])
_SCORED = f"""{_QA}, q0 AS (SELECT *, trim(question_text) AS t, {_rule("trim(question_text)")} AS rule, contains(trim(question_text), '?') AS mark FROM qa WHERE question_text IS NOT NULL),
    q1 AS (SELECT *, len({_tokens("rule")}) AS question_tokens, trim(regexp_replace(regexp_replace(rule, '^(?:(?:allora|cioe|e|ma|ok)[,;:]* ){{0,2}}', ''), '[ ?.!]+$', '')) AS bare,
        regexp_extract(rule, '^([a-z0-9_'']+)', 1) IN {_IN(lx.INTERROGATIVES)} OR regexp_extract(rule, '^([a-z0-9_]+)', 1) IN {_IN(lx.INTERROGATIVES)} AS opens,
        {_weights("rule", lx.QUESTION_CUES, 0.36)} AS cues, {_weights("rule", lx.DIDACTIC_CUES, 0.30)} AS didactic, regexp_matches(rule, {_s(qs.CHECK_IN)}) AS chk, regexp_matches(rule, {_s(qs.POLL)}) AS poll FROM q0),
    q2 AS (SELECT *, regexp_extract(bare, '^([a-z0-9_'']+)', 1) IN {_HEADS} OR regexp_extract(bare, '^([a-z0-9_]+)', 1) IN {_HEADS} AS head, mark AND cues = 0 AND didactic = 0 AND regexp_matches(rule, {_s(qs.TAG)}) AND question_tokens > 3 AS tag,
        mark AND cues = 0 AND didactic = 0 AND question_tokens <= 2 AND NOT chk AS fragment,
        list_min(list_filter(list_transform({_tokens("bare")}, lambda w, i: CASE WHEN w IN {_HEADS} THEN i - 1 END), lambda i: i IS NOT NULL)) AS cue_at FROM q1),
    q3 AS (SELECT *, CASE WHEN poll OR chk THEN 'poll_or_check' WHEN tag THEN 'rhetorical_tag' WHEN fragment THEN 'fragment' WHEN cue_at >= 3 AND NOT head THEN 'embedded_statement_question'
        WHEN mark AND NOT head AND didactic = 0 THEN 'weak_question_form' ELSE 'information_seeking' END AS intent FROM q2),
    q4 AS (SELECT *, CASE WHEN t = '' OR length(t) > {qs.MAX_QUESTION} OR (NOT mark AND (regexp_matches(rule, {_s("|".join(f"(?:{p})" for p in lx.DECLARATIVE_WHAT))}) OR (cues = 0 AND didactic = 0))) THEN NULL ELSE
        least(1.0, greatest(0.0, 0.40 * mark::INT + cues + didactic + 0.12 * opens::INT + 0.10 * (NOT mark)::INT + CASE WHEN question_tokens BETWEEN 3 AND 24 THEN 0.08 WHEN question_tokens < 2 THEN -0.25 ELSE 0 END
        - 0.28 * chk::INT - 0.42 * poll::INT - 0.30 * tag::INT - 0.22 * fragment::INT - 0.18 * (NOT mark AND NOT opens)::INT
        + CASE intent WHEN 'poll_or_check' THEN -0.18 WHEN 'rhetorical_tag' THEN -0.18 WHEN 'fragment' THEN -0.16 WHEN 'embedded_statement_question' THEN -0.12 WHEN 'weak_question_form' THEN -0.10 ELSE 0 END
        - 0.08 * (question_tokens <= 3 AND NOT head)::INT)) END AS question_score FROM q3),
    scored AS (SELECT *, coalesce({_label("rule", lx.DIDACTIC_CUES)}, {_label("rule", lx.QUESTION_CUES)}, CASE WHEN mark THEN 'direct_question' END, 'generic_question') AS question_kind,
        question_tokens <= 2 OR regexp_matches(rule, {_s(qs.ANAPHORIC)}) AS is_contextual, CASE WHEN question_score >= 0.75 THEN 'high' WHEN question_score >= 0.45 THEN 'medium' ELSE 'low' END AS question_band FROM q4)"""


def _aligned(rows: str) -> str:
    return f"""a0 AS (SELECT *, {_rule("question_text")} AS qr, {_rule("answer_text")} AS ar FROM {rows} WHERE question_text IS NOT NULL AND answer_text IS NOT NULL),
    a1 AS (SELECT *, {_content("qr")} AS qtok, {_content("ar")} AS atok, {_numbers("qr")} AS qnum, {_numbers("ar")} AS anum FROM a0),
    a2 AS (SELECT *, len(list_intersect(qtok, atok)) AS shared_keywords, len(list_intersect(qnum, anum)) AS shared_numbers, {_overlap("qtok", "atok")} AS token_overlap, len(list_filter(atok, lambda x: NOT list_contains(qtok, x))) AS new_tokens,
        regexp_matches(qr, '\\b(?:how many|how much|quanto|quanti|quanta|quante)\\b') AS quantity, regexp_matches(qr, '\\b(?:why|perche)\\b') AS why FROM a1),
    a3 AS (SELECT *, CASE WHEN shared_keywords > 0 OR shared_numbers > 0 THEN 0.10 WHEN quantity THEN -0.28 WHEN why THEN 0.0 ELSE -0.16 END AS relevance, CASE WHEN shared_numbers > 0 THEN 0.12 WHEN quantity AND len(anum) > 0 THEN 0.10 ELSE 0 END AS nums FROM a2),
    aligned AS (SELECT *, least(1.0, greatest(0.0, 0.04 + least(0.15, 0.05 * shared_keywords) + nums + greatest(0.0, relevance))) AS alignment FROM a3)"""


_ANSWERED = f"""{_SCORED}, {_aligned("scored")},
    b0 AS (SELECT *, answer_timing.start_seconds - question_timing.end_seconds AS gap, {_weights("ar", lx.ANSWER_CUES, 0.30)} AS part_cues, {_weights("ar", lx.ANSWER_CUES, 1.0)} AS cue_sum, len({_tokens("ar")}) AS answer_tokens FROM aligned),
    b1 AS (SELECT *, CASE WHEN gap <= 4 THEN 1 WHEN gap <= 10 THEN 2 ELSE 3 END AS distance, CASE WHEN gap <= 4 THEN 0.12 WHEN gap <= 10 THEN 0.06 WHEN gap IS NULL THEN 0.0 ELSE -0.08 END AS part_silence,
        greatest(-0.24, least(0.06, CASE WHEN new_tokens >= 3 THEN 0.04 WHEN new_tokens <= 1 THEN -0.10 ELSE 0 END + CASE WHEN shared_keywords > 0 OR shared_numbers > 0 THEN 0.07 WHEN cue_sum > 0 THEN -0.08 ELSE -0.14 END
            + CASE WHEN answer_tokens < 3 THEN -0.10 ELSE 0 END)) AS part_responsive,
        CASE WHEN lower(regexp_extract(answer_text, '([\\p{{L}}\\p{{N}}]+)[^\\p{{L}}\\p{{N}}]*$', 1)) IN {_IN(lx.INCOMPLETE_MARKERS)} OR NOT regexp_matches(answer_text, '[.!?][''"”»)\\]]*\\s*$') THEN -0.10 ELSE 0.0 END AS part_broken,
        CASE WHEN token_overlap >= 0.72 AND new_tokens <= 1 THEN -0.28 ELSE 0.0 END AS part_echo, CASE WHEN similarity_score <= 0.45 THEN 0.10 WHEN similarity_score >= 0.72 THEN -0.04 ELSE 0.0 END AS part_voice,
        contains(answer_text, '?') AS asks FROM b0),
    b2 AS (SELECT *, CASE distance WHEN 1 THEN 0.20 WHEN 2 THEN 0.12 ELSE 0.06 END AS part_distance FROM b1),
    b3 AS (SELECT *, least(1.0, greatest(0.0, 0.18 + part_distance + part_cues + alignment + part_responsive + CASE WHEN answer_tokens BETWEEN 3 AND 80 THEN 0.08 ELSE 0 END + part_silence - 0.20 * asks::INT + part_broken + part_echo + part_voice)) AS answer_score FROM b2),
    b4 AS (SELECT *, least(1.0, greatest(0.0, 0.55 * coalesce(question_score, 0) + 0.45 * answer_score - 0.24 * asks::INT)) AS pair_confidence FROM b3),
    rest AS (SELECT *, least(1.0, greatest(0.0, 0.55 * coalesce(question_score, 0))) AS pair_confidence, answer_timing.start_seconds - question_timing.end_seconds AS gap,
        CASE WHEN answer_timing.start_seconds - question_timing.end_seconds <= 4 THEN 1 WHEN answer_timing.start_seconds - question_timing.end_seconds <= 10 THEN 2 ELSE 3 END AS distance FROM scored WHERE answer_text IS NULL),
    answered AS (SELECT * FROM b4 UNION ALL BY NAME SELECT * FROM rest)"""
_ASKED = "asked AS (SELECT audio_source_id AS source, qa_candidate_id AS question_id, question_timing.start_seconds AS q_start, question_timing.end_seconds AS q_end, question_text AS text FROM qa WHERE question_timing.start_seconds IS NOT NULL AND question_timing.end_seconds IS NOT NULL AND question_text IS NOT NULL)"
_SENT = "sents AS (SELECT DISTINCT audio_source_id AS source, unit_id, start_seconds AS u_start, end_seconds AS u_end, text FROM segmentation_units WHERE unit_kind = 'sentence' AND start_seconds IS NOT NULL AND end_seconds IS NOT NULL AND trim(text) <> '')"
_PLACED = "placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY u_start, u_end, unit_id) AS k FROM sents)"
_LINE = f"""{_QA}, {_ASKED}, {_SENT}, line AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY t, kind, id) AS k FROM (
        SELECT source, question_id AS id, q_end AS t, 0 AS kind, text FROM asked UNION ALL SELECT source, unit_id, u_start, 1, text FROM sents))"""
_GATED = f"""{_ANSWERED}, gated AS (SELECT *, CASE WHEN coalesce(pair_confidence, 0) < 0.40 THEN 'below_min_confidence' WHEN intent IN ('poll_or_check', 'rhetorical_tag') THEN 'weak_question_intent' WHEN part_echo < 0 THEN 'answer_echo'
        WHEN part_broken < 0 AND answer_tokens < 5 THEN 'broken_answer' WHEN list_contains(review_flags, 'weak_boundary') AND pair_confidence < 0.55 THEN 'weak_boundary' END AS suppressed_by FROM answered)"""
SQL = {
    "rule_text_tokens": f"WITH r AS (SELECT doc_id, {_rule('text')} AS rule FROM documents WHERE text IS NOT NULL) SELECT doc_id, sha1(rule) AS rule_hash, len({_tokens('rule')}) AS tokens, len({_content('rule')}) AS content_tokens, len({_numbers('rule')}) AS numbers FROM r",
    "answer_cues": f"WITH {_QA}, r AS (SELECT qa_candidate_id, {_rule('answer_text')} AS rule FROM qa WHERE answer_text IS NOT NULL) SELECT qa_candidate_id, {_weights('rule', lx.ANSWER_CUES, 0.30)} AS cue_weight, array_to_string(list_filter([{', '.join(f'CASE WHEN regexp_matches(rule, {_s(p)}) THEN {_s(c)} END' for p, c, _, _ in lx.ANSWER_CUES)}], lambda x: x IS NOT NULL), ',') AS codes, {_label('rule', lx.ANSWER_CUES)} AS label FROM r",
    "question_scores": f"WITH {_SCORED} SELECT qa_candidate_id, question_tokens, intent, question_kind, question_score, is_contextual, question_band FROM scored",
    "question_answer_alignment": f"WITH {_QA}, {_aligned('qa')} SELECT qa_candidate_id, shared_keywords, shared_numbers, token_overlap, new_tokens, alignment FROM aligned",
    "answer_scores": f"WITH {_ANSWERED} SELECT qa_candidate_id, answer_score, part_distance, part_cues, part_responsive, part_silence, part_broken, part_echo, part_voice, pair_confidence FROM b4",
    "answer_rank": f"WITH {_ANSWERED} SELECT qa_candidate_id, row_number() OVER (PARTITION BY audio_source_id, question_text ORDER BY round(pair_confidence, 9) DESC NULLS LAST, distance, gap NULLS LAST, qa_candidate_id) AS place FROM answered",
    "answer_rerank": f"""WITH {_ANSWERED}, f AS (SELECT *, row_number() OVER (PARTITION BY audio_source_id, question_text ORDER BY answer_score DESC NULLS LAST, qa_candidate_id) AS first, max(retrieval_score) OVER (PARTITION BY audio_source_id, question_text) AS any_score FROM answered),
        m AS (SELECT *, CASE WHEN first <= 8 AND retrieval_score IS NOT NULL THEN 0.7 * retrieval_score + 0.3 * answer_score ELSE answer_score END AS final_score, CASE WHEN any_score IS NULL THEN 'semantic_unavailable' END AS fallback FROM f)
        SELECT qa_candidate_id, final_score, row_number() OVER (PARTITION BY audio_source_id, question_text ORDER BY final_score DESC NULLS LAST, qa_candidate_id) AS final_place, fallback FROM m""",
    "answer_windows": f"""WITH {_QA}, {_ASKED}, {_SENT}, {_PLACED}, n AS (SELECT *, lead(q_start) OVER (PARTITION BY source ORDER BY q_start, question_id) AS next_q FROM asked),
        b AS (SELECT n.source, n.question_id, n.q_end, n.next_q, (SELECT count(*) FROM sents s WHERE s.source = n.source AND s.u_start < n.q_end) AS before FROM n),
        w AS (SELECT b.*, step, p.unit_id, p.u_start, p.u_end, p.text FROM b, (SELECT unnest([1, 2, 3]) AS step), placed p WHERE p.source = b.source AND p.k = b.before + step),
        g AS (SELECT *, min(u_start) OVER o AS lo, max(u_end) OVER o AS hi, first_value(unit_id) OVER o AS first_unit, string_agg(text, ' ') OVER o AS joined FROM w WINDOW o AS (PARTITION BY question_id ORDER BY step ROWS UNBOUNDED PRECEDING)),
        s AS (SELECT *, max(CASE WHEN u_start >= coalesce(next_q, 'inf'::DOUBLE) OR u_start - q_end > 45 OR u_end - lo > 45 THEN 1 ELSE 0 END) OVER (PARTITION BY question_id ORDER BY step ROWS UNBOUNDED PRECEDING) AS stopped FROM g)
        SELECT question_id, step AS span, first_unit, unit_id AS last_unit, lo - q_end AS gap, hi - lo AS seconds, length(joined) AS text_length FROM s WHERE stopped = 0""",
    "deferred_recurrence": f"""WITH {_LINE}, words AS (SELECT source, id, k, kind, unnest({_content(_rule("text"))}) AS word FROM line)
        SELECT q.id AS question_id, count(DISTINCT q.word) AS hits, count(DISTINCT u.k) AS units, min(u.k - q.k) AS nearest FROM words q JOIN words u ON q.source = u.source AND q.word = u.word AND q.kind = 0 AND u.kind = 1 AND u.k - q.k BETWEEN 4 AND 31 GROUP BY 1""",
    "context_units": f"""WITH {_QA}, {_ASKED}, {_SENT}, {_PLACED}, b AS (SELECT a.*, (SELECT count(*) FROM sents s WHERE s.source = a.source AND s.u_start < a.q_end) AS qk FROM asked a),
        j AS (SELECT b.question_id, p.unit_id, p.k, {_rule("b.text")} AS qr, {_rule("p.text")} AS ur FROM b JOIN placed p ON p.source = b.source AND p.k IN (b.qk, b.qk - 1)),
        s AS (SELECT *, least(1.0, 0.05 + least(0.30, 0.08 * len(list_intersect({_content("qr")}, {_content("ur")}))) + CASE WHEN len(list_intersect({_numbers("qr")}, {_numbers("ur")})) > 0 THEN 0.16 ELSE 0 END + CASE WHEN len({_tokens("ur")}) BETWEEN 4 AND 40 THEN 0.08 ELSE 0 END) AS context_score FROM j)
        SELECT question_id, unit_id, context_score, row_number() OVER (PARTITION BY question_id ORDER BY context_score DESC, k) AS place FROM s""",
    "qa_quality": f"""WITH {_ANSWERED}, r AS (SELECT *, least(1.0, list_sum(list_prepend(0.0, list_transform(coalesce(review_flags, []), lambda f: CASE f WHEN 'possible_echo' THEN 0.28 WHEN 'weak_boundary' THEN 0.16 WHEN 'long_answer' THEN 0.08 WHEN 'low_confidence' THEN 0.22 ELSE 0.05 END)))) AS risk_score,
            least(1.0, greatest(0.0, 0.34 * coalesce(question_score, 0) + 0.38 * coalesce(answer_score, 0) + 0.16 * CASE WHEN continuation_text IS NOT NULL THEN 0.9 ELSE 0.4 END + 0.12 * CASE WHEN answer_timing IS NOT NULL THEN 0.8 ELSE 0.3 END)) AS base_quality FROM answered),
        f AS (SELECT *, least(1.0, greatest(0.0, base_quality - 0.45 * risk_score)) AS final_quality FROM r)
        SELECT qa_candidate_id, risk_score, base_quality, final_quality, CASE WHEN final_quality >= 0.74 THEN 'high' WHEN final_quality >= 0.5 THEN 'medium' ELSE 'low' END AS quality_band,
            CASE WHEN risk_score >= 0.55 THEN 'high' WHEN risk_score >= 0.25 THEN 'medium' ELSE 'low' END AS risk_band, array_to_string(list_sort(coalesce(review_flags, []))[1:8], ',') AS risk_reasons FROM f""",
    "qa_gate": f"WITH {_GATED} SELECT qa_candidate_id, suppressed_by, suppressed_by IS NULL AS emitted FROM gated",
    "speaker_rescue": f"""WITH {_GATED}, e AS (SELECT *, coalesce(suppressed_by IN ('below_min_confidence', 'weak_boundary'), false) AS checked, coalesce(similarity_score <= 0.45, false) AND suppressed_by IN ('below_min_confidence', 'weak_boundary') AS ok FROM gated WHERE suppressed_by IS NOT NULL),
        s AS (SELECT *, sum(checked::INT) OVER (PARTITION BY session_id ORDER BY qa_candidate_id ROWS UNBOUNDED PRECEDING) AS c FROM e)
        SELECT qa_candidate_id, ok AND c <= 40 AND sum(CASE WHEN ok AND c <= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY qa_candidate_id ROWS UNBOUNDED PRECEDING) <= 8 AS rescued FROM s""",
    "qa_coverage": f"""WITH {_GATED}, u AS (SELECT DISTINCT unit_id, session_id, text FROM segmentation_units WHERE unit_kind = 'sentence' AND text IS NOT NULL),
        b AS (SELECT session_id, count(*) AS units, count(*) FILTER (lower(regexp_extract(text, '^[^\\p{{L}}\\p{{N}}]*([\\p{{L}}\\p{{N}}]+)', 1)) IN {_IN(lx.INTERROGATIVES)} OR contains(text, '?')) AS interrogative_units FROM u GROUP BY 1),
        f AS (SELECT session_id, count(*) AS candidates, count(*) FILTER (suppressed_by IS NULL) AS emitted FROM gated GROUP BY 1)
        SELECT session_id, units, interrogative_units, coalesce(candidates, 0) AS candidates, coalesce(emitted, 0) AS emitted, CASE WHEN candidates > 0 THEN emitted / candidates END AS coverage_ratio FROM b LEFT JOIN f USING (session_id)""",
    "near_duplicate_pairs": f"""WITH {_QA}, r AS (SELECT audio_source_id AS source, qa_candidate_id AS item, question_timing.start_seconds AS at, {_content(_rule("question_text"))} AS q, coalesce({_content(_rule("answer_text"))}, []) AS a FROM qa WHERE question_timing.start_seconds IS NOT NULL),
        p AS (SELECT l.source, l.item AS "left", r.item AS "right", {_overlap("l.q", "r.q")} AS question_overlap, {_overlap("l.a", "r.a")} AS answer_overlap FROM r l JOIN r ON l.source = r.source AND (r.at, r.item) > (l.at, l.item) AND r.at - l.at <= 90)
        SELECT * FROM p WHERE (question_overlap >= 0.72 AND answer_overlap >= 0.50) OR (question_overlap >= 0.86 AND answer_overlap >= 0.35)""",
    "semantic_topk": """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS place FROM s) SELECT query_id, vec_id, round(similarity, 4) AS similarity FROM p WHERE place <= 4 AND similarity >= 0.2""",
    "responsiveness_scores": """SELECT DISTINCT qa_candidate_id, least(1.0, greatest(0.0, 0.18 + 0.82 * s - CASE WHEN s >= 0.92 THEN 0.24 WHEN s >= 0.85 THEN 0.14 ELSE 0 END - CASE WHEN m >= 0.25 THEN 0.22 WHEN m >= 0.12 THEN 0.12 ELSE 0 END)) AS responsiveness
        FROM (SELECT qa_candidate_id, question_answer_similarity AS s, coalesce(answer_continuation_similarity, -1.0) - question_answer_similarity AS m FROM responsiveness_scores WHERE question_answer_similarity IS NOT NULL)""",
    "voice_check": f"""WITH {_QA}, v AS (SELECT qa_candidate_id, similarity_score AS s, CASE WHEN NOT coalesce(similarity_score IS NOT NULL AND NOT coalesce(answer_timing.start_seconds < question_timing.end_seconds, false)
            AND question_timing.end_seconds - question_timing.start_seconds >= 1.5 AND answer_timing.end_seconds - answer_timing.start_seconds >= 1.5, false) THEN 'skipped' WHEN similarity_score >= 0.72 THEN 'same' WHEN similarity_score <= 0.45 THEN 'different' ELSE 'unclear' END AS voice FROM qa)
        SELECT qa_candidate_id, voice, CASE WHEN voice = 'same' THEN least(1.0, (s - 0.72) / 0.13) * 0.25 ELSE 0 END AS voice_penalty, CASE WHEN voice = 'different' THEN 0.04 ELSE 0 END AS voice_bonus FROM v""",
}
SQL = {name: sql if name == "voice_check" else rounded(sql) for name, sql in SQL.items()}
