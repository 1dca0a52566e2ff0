"""Queries of the extraction of question-and-answer pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.config import options
from turnwise.functions import lexical as lx
from turnwise.operators import extraction as ex
from turnwise.operators import sentences as se
from turnwise.operators import questions as qs
from turnwise.plans.questions import _ANSWERED, _IN, _QA, _content, _qa, _answered, _rule, _s, _tokens, rounded
from turnwise.plans.sentences import SQL as SENTENCE_SQL
from turnwise.plans.timeline import _once

#: Seconds of a stretch that stands for a segment where units are related by segment.
SEGMENT_SECONDS = 60


def _dialogue(spark, sf) -> DataFrame:
    """Sentences of the sources, with the questions and answers of the pairs as units of their own among them."""
    place = lambda s: F.array(F.floor(F.col(s) / SEGMENT_SECONDS).cast("int"))
    said = _once(spark, sf, "segmentation_units", "unit_id").filter("unit_kind = 'sentence' and start_seconds is not null and end_seconds is not null and trim(text) != ''")
    said = said.select("session_id", F.col("audio_source_id").alias("source"), "unit_id", F.col("start_seconds").alias("u_start"), F.col("end_seconds").alias("u_end"), "text", F.lit(None).cast("string").alias("speaker"))
    qa = _qa(spark, sf)
    for kind in ("question", "answer"):
        t = f"{kind}_timing"
        own = qa.filter(f"trim({kind}_text) != '' and {t}.start_seconds is not null and {t}.end_seconds is not null")
        own = own.select("session_id", F.col("audio_source_id").alias("source"), F.concat(F.lit(kind[0] + ":"), "qa_candidate_id").alias("unit_id"), F.col(f"{t}.start_seconds").alias("u_start"), F.col(f"{t}.end_seconds").alias("u_end"), F.col(f"{kind}_text").alias("text"), F.lit(kind).alias("speaker"))
        said = said.unionByName(own)
    rated = se.cleanup_scores(se.quality_columns(said, "text", F.col("u_end") - F.col("u_start"))).withColumn("segments", place("u_start"))
    none = F.lit(None).cast("string")
    return rated.select(
        "session_id", "source", "unit_id", "u_start", "u_end", "text", "speaker", "segments", F.lit(True).alias("grounded"), "quality", none.alias("merge_safety"), none.alias("review_priority"),
        "autonomy", "boundary", "continuation", none.alias("speaker_status"), F.lit(None).cast("double").alias("margin"),
    )


def sentence_spans(spark, sf):
    d = _once(spark, sf, "rendered_groups", "group_id").filter("text is not null")
    return d.select("group_id", F.posexplode(ex.sentence_spans(F.col("text"))).alias("n", "s")).select("group_id", "n", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.sha1("s.span").alias("span_hash"))


def noise_predicates(spark, sf):
    d = _qa(spark, sf).filter("answer_text is not null").withColumn("rule", lx.rule_text(F.col("answer_text")))
    return d.select("qa_candidate_id", *[c.alias(n) for n, c in ex.noise_columns(F.col("rule")).items()])


def answer_trimming(spark, sf):
    d = ex.trimmed_answer(_qa(spark, sf).filter("answer_text is not null"), "question_text", "answer_text")
    return d.select("qa_candidate_id", F.sha1("trimmed").alias("trimmed_hash"), F.array_join("trim_reasons", ",").alias("reasons"))


def _focused(spark, sf):
    return ex.span_integrity(ex.question_focus(_qa(spark, sf).filter("question_text is not null"), "qa_candidate_id", "question_text"))


def question_focus(spark, sf):
    return _focused(spark, sf).select("qa_candidate_id", F.sha1("focus").alias("focus_hash"), F.length("preamble").alias("preamble_length"), F.length("seed").alias("seed_length"), "question_score", "integrity")


def question_support(spark, sf):
    rated = se.cleanup_scores(se.quality_columns(_once(spark, sf, "segmentation_units", "unit_id").filter("unit_kind = 'sentence' and trim(text) != ''"), "text", F.col("end_seconds") - F.col("start_seconds")))
    none = F.lit(None).cast("string")
    rows = rated.withColumn("grounded", F.col("session_start_seconds").isNotNull()).withColumn("merge_safety", none).withColumn("review_priority", none).withColumn("speaker_status", none).withColumn("margin", F.lit(None).cast("double"))
    return ex.question_support(rows).select("unit_id", "support", F.array_join("support_reasons", ",").alias("reasons"))


def didactic_usefulness(spark, sf):
    rows = _focused(spark, sf).withColumn("support", F.lit(0.02))
    return ex.didactic_usefulness(rows, F.col("is_contextual"), F.col("seed") != "").select("qa_candidate_id", "didactic_score", "final_question_score")


def segment_relation(spark, sf):
    """Relation of the minutes in which a pair's question and answer lie."""
    place = lambda c: F.when(F.col(c).isNotNull(), F.array(F.floor(F.col(c) / SEGMENT_SECONDS).cast("int")))
    return _qa(spark, sf).select("qa_candidate_id", ex.segment_relation(place("question_timing.start_seconds"), place("answer_timing.start_seconds")).alias("relation"))


def _candidate(spark, sf):
    rows = _answered(spark, sf).filter("answer_text is not null")
    return rows.withColumn("origin", F.lit("local")).withColumn("span", F.when(F.col("continuation_text").isNull(), 1).otherwise(2)).withColumn("completed", F.coalesce(F.array_contains("reason_codes", "semantic_rescue"), F.lit(False))).withColumn("first_text", F.regexp_extract("answer_text", r"^[^.!?]*[.!?]?", 0))


def answer_span_completeness(spark, sf):
    return ex.span_completeness(_candidate(spark, sf), "question_text", "answer_text", "first_text", "span", True).select("qa_candidate_id", "part_span", "span_reason")


def monologue_risk(spark, sf):
    voice = F.when(F.col("similarity_score") >= 0.72, F.lit("one"))
    other = F.when(F.col("similarity_score") >= 0.72, F.lit("one")).when(F.col("similarity_score") <= 0.45, F.lit("two"))
    return ex.monologue_risk(_candidate(spark, sf), F.coalesce(voice, F.when(other.isNotNull(), F.lit("one"))), other, True).select("qa_candidate_id", "part_monologue")


def answer_context(spark, sf):
    """Of the sentences of each minute of a source, taken as one answer."""
    said = _once(spark, sf, "segmentation_units", "unit_id").filter("unit_kind = 'sentence' and trim(text) != '' and start_seconds is not null")
    rated = se.quality_columns(said, "text", F.col("end_seconds") - F.col("start_seconds"))
    none = F.array().cast("array<string>")
    held = rated.groupBy("audio_source_id", F.floor(F.col("start_seconds") / SEGMENT_SECONDS).alias("minute")).agg(F.collect_set("quality").alias("q"), F.max(F.col("session_start_seconds").isNotNull()).alias("g"))
    return held.select("audio_source_id", "minute", ex.answer_context(F.col("q"), none, none, F.col("g")).alias("part_context"))


def answer_selection(spark, sf):
    """Of the pairs of one question text in a source, the answer that stands first and does not ask."""
    rows = _answered(spark, sf).filter("answer_text is not null").withColumn("origin", F.when(F.col("gap") <= 1, "same_unit").otherwise("local"))
    rows = rows.withColumn("place", F.struct(-F.round("pair_confidence", 9), "qa_candidate_id"))
    return ex.selected_answers(rows.select("audio_source_id", "question_text", "qa_candidate_id", "answer_text", "origin", "answer_tokens", "answer_score", "place"), ["audio_source_id", "question_text"]).select("audio_source_id", "qa_candidate_id")


def grounded_times(spark, sf):
    said = _once(spark, sf, "utterances", "utterance_id")
    held = said.filter("transcript_chunk_id is not null and start_seconds is not null").groupBy(F.col("transcript_chunk_id").alias("chunk_id")).agg(F.collect_set("utterance_id").alias("utterance_ids"))
    chunks = _once(spark, sf, "transcript_chunks", "chunk_id").join(held, "chunk_id", "left")
    spans = chunks.select(F.col("chunk_id").alias("item"), "utterance_ids", F.col("start_seconds").alias("own_start"), F.col("end_seconds").alias("own_end"))
    return ex.grounded_times(spans, said.select("utterance_id", F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"))).withColumnRenamed("item", "chunk_id")


def _reasoned(spark, sf):
    """Pairs with the reasons that their scores give."""
    rows = _answered(spark, sf).filter("answer_text is not null")
    found = [
        F.when(F.col("part_echo") < 0, "answer_echoes_question_penalty"), F.when(F.col("part_responsive") <= -0.10, "answer_responsiveness_weak"), F.when(F.col("relevance") < 0, "low_question_answer_relevance"),
        F.when((F.col("part_broken") < 0), "incomplete_answer_span_penalty"), F.when(F.col("new_tokens") <= 1, "low_information_answer_penalty"), F.when(F.col("distance") == 3, "segment_unknown"),
    ]
    rows = rows.withColumn("why", F.concat("question_reasons", F.array_compact(F.array(*found))))
    return rows.withColumn("up", ex.review_flags(F.col("why"), F.col("pair_confidence"), F.coalesce(F.col("answer_text").contains("?"), F.lit(False)), F.col("question_timing").isNull()))


def review_flags(spark, sf):
    return _reasoned(spark, sf).select("qa_candidate_id", F.array_join("up", ",").alias("flags"))


def _risky(spark, sf):
    weak = F.col("continuation_text").isNull()
    return ex.risk_columns(_reasoned(spark, sf), F.col("why"), F.col("up"), F.col("pair_confidence"), weak, F.coalesce(F.length("continuation_text") < 30, F.lit(False)), F.coalesce("part_cues", F.lit(0.0)), F.coalesce("relevance", F.lit(0.0)))


def pair_risk(spark, sf):
    return _risky(spark, sf).select("qa_candidate_id", "risk_score", F.array_join("risk_reasons", ",").alias("reasons"))


def strict_gate(spark, sf):
    rows = _risky(spark, sf)
    return rows.select("qa_candidate_id", ex.gate_reason(F.col("pair_confidence"), F.col("why"), F.col("risk_reasons"), F.col("intent"), F.coalesce(F.col("shared_keywords") > 0, F.lit(False)) & F.col("continuation_text").isNotNull(), True).alias("suppressed_by"))


def echoed_questions(spark, sf):
    from turnwise.operators.ordering import grouped_running

    placed = grouped_running(_dialogue(spark, sf).select("source", "unit_id", "u_start", "u_end", "text"), ["source"], ["u_start", "u_end", "unit_id"], name="k")
    return ex.echoed_questions(placed.filter("unit_id like 'q:%'").select("source", F.col("unit_id").alias("question_id"), "k", "text"), placed)


def qa_extract(spark, sf):
    """The whole extraction over the dialogue lines, as the default profile does it."""
    out = ex.extract_pairs(_dialogue(spark, sf), options("current"))
    lists = {c: F.array_join(c, ",").alias(c) for c in ("reasons", "review_flags", "risk_reasons")}
    return out.select(*[lists.get(c, c) for c in out.columns])


def qa_extract_strict(spark, sf):
    """The same under the strict gate."""
    return ex.extract_pairs(_dialogue(spark, sf), options("quality_local")).select("question_id", "origin", "answer_score", "confidence", "suppressed_by", "duplicate_of")


_QUERIES = (
    sentence_spans, noise_predicates, answer_trimming, question_focus, question_support, didactic_usefulness, segment_relation, answer_span_completeness, monologue_risk, answer_context, answer_selection, grounded_times, review_flags,
    pair_risk, strict_gate, echoed_questions, qa_extract, qa_extract_strict,
)
QUERIES = {f.__name__: f for f in _QUERIES}


def _list(items) -> str:
    return "[" + ", ".join(_s(x) for x in items) + "]"


def _when_list(pairs) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {when} THEN {_s(name)} END" for when, name in pairs) + "], lambda x: x IS NOT NULL)"


_CHATTER = f"""n0 AS (SELECT DISTINCT qa_candidate_id, {_rule("answer_text")} AS rule FROM qa_candidates WHERE answer_text IS NOT NULL),
    n1 AS (SELECT *, regexp_replace(trim(regexp_replace(rule, '[ ?.!;:]+$', '')), '\\s+', ' ', 'g') AS bare FROM n0), n2 AS (SELECT *, {_tokens("bare")} AS tok, {_content("bare")} AS words FROM n1)"""


def _any(column: str, patterns) -> str:
    return f"regexp_matches({column}, {_s('|'.join(f'(?:{p})' for p in patterns))})"


def _only(words) -> str:
    return f"(len(tok) > 0 AND len(list_filter(tok, lambda t: NOT list_contains({_list(words)}, t))) = 0)"


def _flag_sql() -> str:
    """Review flags in order; a flag of two reasons stands where the first of them that is there puts it."""
    pairs, seen = [("pair_confidence < 0.45", "low_confidence"), ("pair_confidence >= 0.45 AND pair_confidence < 0.75", "medium_confidence"), ("question_timing IS NULL", "fallback_input_layer"), ("contains(answer_text, '?')", "answer_is_question")], {}
    for code, flag in ex.REASON_FLAGS.items():
        before = seen.setdefault(flag, [])
        pairs.append((f"list_contains(codes, {_s(code)})" + "".join(f" AND NOT list_contains(codes, {_s(c)})" for c in before), flag))
        before.append(code)
    return _when_list(pairs)


def _risks() -> list[tuple[str, str | None, float]]:
    up, why = (lambda f: f"list_contains(up, {_s(f)})"), (lambda c: f"list_contains(codes, {_s(c)})")
    out: list[tuple[str, str | None, float]] = [(up(f), f, ex.FLAG_RISKS[f]) for f in sorted(ex.FLAG_RISKS)]
    out += [(f"{why(code)} AND NOT {up(alias)}", alias, weight) for code, (alias, weight) in sorted(ex.REASON_RISKS.items())]
    out.append((f"pair_confidence < 0.45 AND NOT {up('low_confidence')}", "low_confidence", ex.FLAG_RISKS["low_confidence"]))
    out.append((f"pair_confidence >= 0.45 AND pair_confidence < 0.75 AND {up('medium_confidence')}", None, ex.MEDIUM_RISK))
    out.append((" AND ".join(f"NOT {why(c)}" for c in ("question_mark", "question_intent_autonomous_head", "question_intent_didactic_cue")), "implicit_question_risk", ex.IMPLICIT_RISK))
    out += [("continuation_text IS NULL", "weak_context_risk", ex.WEAK_CONTEXT_RISK), ("coalesce(length(continuation_text) < 30, false)", "thin_context_risk", ex.THIN_CONTEXT_RISK), ("part_cues > 0 AND relevance <= 0", "surface_answer_cue_risk", ex.SURFACE_CUE_RISK)]
    return out


_INTENTS = {"poll_or_check": "poll_or_check", "rhetorical_tag": "rhetorical_tag", "fragment": "fragment", "embedded_statement_question": "embedded_statement", "weak_question_form": "weak_form"}
_WHY = _when_list(
    [
        ("mark", "question_mark"), ("NOT mark", "implicit_question_cue"), ("chk", "rhetorical_checkin_question"), ("poll", "rhetorical_poll_question"), ("tag", "declarative_tag_question"), ("fragment", "fragment_question"),
        ("NOT mark AND NOT opens", "implicit_declarative_question_penalty"), ("head", "question_intent_autonomous_head"), ("didactic > 0", "question_intent_didactic_cue"), *[(f"intent = '{i}'", f"question_intent_{code}") for i, code in _INTENTS.items()],
        ("part_echo < 0", "answer_echoes_question_penalty"), ("part_responsive <= -0.10", "answer_responsiveness_weak"), ("relevance < 0", "low_question_answer_relevance"), ("part_broken < 0", "incomplete_answer_span_penalty"),
        ("new_tokens <= 1", "low_information_answer_penalty"), ("distance = 3", "segment_unknown"),
    ]
)
_REASONED = f"{_ANSWERED}, w AS (SELECT *, {_WHY} AS codes FROM b4), u AS (SELECT *, {_flag_sql()} AS up FROM w)"
_RISKY = f"""{_REASONED}, r AS (SELECT *, least(1.0, {" + ".join(f"CASE WHEN {when} THEN {weight} ELSE 0 END" for when, _, weight in _risks())}) AS risk_score, ({_when_list([(when, name) for when, name, _ in _risks() if name])})[1:{ex.RISK_REASONS}] AS risks FROM u)"""
_FIRST = lambda names: f"list_min(list_intersect(codes, {_list(names)}))"
_SUPPORT = (
    ("g", 0.03, "question_utterance_grounded"), ("NOT g", -0.03, "question_missing_utterance_grounding"), ("quality = 'good'", 0.02, "question_sentence_quality_good"), ("quality = 'borderline'", -0.02, "question_sentence_quality_borderline"),
    ("quality IN ('fragment', 'run_on')", -0.08, "question_sentence_quality_penalty"), ("autonomy < 0.45", -0.08, "question_low_sentence_autonomy"), ("autonomy >= 0.45 AND autonomy < 0.60", -0.03, "question_borderline_sentence_autonomy"),
    ("boundary < 0.45", -0.06, "question_low_boundary_confidence"), ("continuation >= 0.42", -0.04, "question_continuation_risk"),
)
_ONCE = "SELECT DISTINCT * EXCLUDE (ingested_at)"
SQL = {
    "sentence_spans": """WITH g AS (SELECT DISTINCT group_id, text, regexp_extract_all(text, '[.?!]*[^.?!]+[.?!]?') AS p FROM rendered_groups WHERE text IS NOT NULL),
        r AS (SELECT group_id, text, len(p) AS m, unnest(range(1, len(p) + 1)) AS i, p FROM g), b AS (SELECT group_id, i, regexp_replace(p[i], '^[.?!]+', '') AS bare, list_sum(list_transform(p[1:i], lambda x: length(x))) AS upto FROM r),
        s AS (SELECT group_id, i, trim(bare, ' ') AS span, (upto - length(bare))::INT AS start, upto::INT AS "end" FROM b), k AS (SELECT * FROM s WHERE span <> ''),
        n AS (SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY i) - 1 AS n, start, "end", span FROM k UNION ALL SELECT group_id, 0, 0, length(text), trim(text, ' ') FROM g WHERE group_id NOT IN (SELECT group_id FROM k))
        SELECT group_id, n, start, "end", sha1(span) AS span_hash FROM n""",
    "noise_predicates": f"""WITH {_CHATTER} SELECT qa_candidate_id, regexp_matches(bare, {_s(qs.CHECK_IN)}) AS check_in, regexp_matches(bare, {_s(qs.POLL)}) OR (len(tok) <= 6 AND {_only([*lx.POLL_WORDS, "or", "o"])}) AS poll,
        regexp_matches(rule, {_s(lx.BACKCHANNEL_CHECK)}) AS backchannel, regexp_matches(rule, {_s(lx.PROCEDURAL)}) AS procedural, regexp_matches(bare, {_s(lx.FOLLOW_UP_PROMPT)}) AS follow_up_prompt, {_any("rule", lx.HAND_OFFS)} AS hand_off,
        {_any("bare", lx.BOILERPLATE)} OR bare IN {_IN(lx.FILLER_ANSWERS)} AS boilerplate, len(tok) <= 4 AND {_only([*lx.BACKCHANNEL_WORDS, *lx.POLL_WORDS])} AS backchannel_answer,
        len(tok) <= 18 AND len(list_filter(words, lambda t: t IN {_IN(lx.DEFLECTION_META)})) >= 1 AND len(list_intersect(tok, {_list((*lx.DEFLECTION_DISMISSIVE, *lx.NEGATIONS))})) >= 1
            AND len(list_filter(words, lambda t: t IN {_IN(lx.DEFLECTION_META)})) >= 0.2 * len(words) AS deflection,
        coalesce(tok[-1] IN {_IN(lx.INCOMPLETE_ENDS)}, false) OR (regexp_matches(bare, {_s(lx.INCOMPLETE_STARTS)}) AND NOT regexp_matches(rule, '[.!?]\\s*$')) AS incomplete, regexp_matches(bare, {_s(lx.ADDITIVE_STARTS)}) AS additive, {_any("bare", lx.CAUSAL_STATEMENTS)} AS causal FROM n2""",
    "question_support": f"""WITH q AS ({SENTENCE_SQL["sentence_quality"]}), s AS (SELECT q.*, u.session_start_seconds IS NOT NULL AS g FROM q JOIN ({_ONCE} FROM segmentation_units) u USING (unit_id))
        SELECT unit_id, floor(({" + ".join(f"CASE WHEN {when} THEN {weight} ELSE 0 END" for when, weight, _ in _SUPPORT)}) * 10000 + 0.5) / 10000 AS support, array_to_string({_when_list([(when, code) for when, _, code in _SUPPORT])}, ',') AS reasons FROM s""",
    "segment_relation": f"""WITH {_QA}, p AS (SELECT qa_candidate_id, abs(floor(question_timing.start_seconds / 60) - floor(answer_timing.start_seconds / 60)) AS d FROM qa)
        SELECT qa_candidate_id, CASE WHEN d IS NULL THEN 'segment_unknown' WHEN d = 0 THEN 'same_segment' WHEN d = 1 THEN 'next_segment' ELSE 'distant_segment' END AS relation FROM p""",
    "monologue_risk": f"""WITH {_ANSWERED}, v AS (SELECT *, shared_keywords > 0 OR shared_numbers > 0 AS anchor, intent IN {_IN(ex.WEAK_INTENTS)} AS odd, part_cues > 0 AS cue, coalesce(similarity_score <= 0.45, false) AS turn, coalesce(similarity_score >= 0.72, false) AS same FROM b4),
        k AS (SELECT *, part_responsive <= -0.10 OR (NOT anchor AND (NOT cue OR new_tokens <= 2)) AS weak FROM v)
        SELECT qa_candidate_id, CASE WHEN distance <= 1 AND gap <= 6 AND NOT turn THEN CASE WHEN weak AND (odd OR same) THEN -0.22 WHEN weak AND NOT same AND NOT turn THEN -0.16 WHEN odd AND NOT cue THEN -0.10 ELSE 0 END ELSE 0 END AS part_monologue FROM k""",
    "answer_context": f"""WITH q AS ({SENTENCE_SQL["sentence_quality"]}), h AS (SELECT audio_source_id, floor(start_seconds / 60)::BIGINT AS minute, list(quality) AS l, bool_or(session_start_seconds IS NOT NULL) AS g
            FROM q JOIN ({_ONCE} FROM segmentation_units) u USING (unit_id) WHERE start_seconds IS NOT NULL GROUP BY 1, 2)
        SELECT audio_source_id, minute, CASE WHEN list_has_any(l, ['fragment', 'run_on']) THEN -0.08 WHEN list_contains(l, 'borderline') THEN -0.02 ELSE 0.05 END + CASE WHEN g THEN 0.04 ELSE -0.05 END AS part_context FROM h""",
    "answer_selection": f"""WITH {_ANSWERED}, o AS (SELECT *, coalesce(gap <= 1, false) AND answer_tokens <= 4 AND answer_score >= 0.45 AS own FROM b4 WHERE NOT contains(answer_text, '?')),
        p AS (SELECT *, row_number() OVER (PARTITION BY audio_source_id, question_text ORDER BY own DESC, CASE WHEN own THEN -answer_score ELSE 0 END, round(pair_confidence, 9) DESC, qa_candidate_id) AS n FROM o) SELECT audio_source_id, qa_candidate_id FROM p WHERE n = 1""",
    "grounded_times": f"""WITH u AS ({_ONCE} FROM utterances), c AS ({_ONCE} FROM transcript_chunks), r AS (SELECT transcript_chunk_id AS chunk_id, min(start_seconds) AS s, max(end_seconds) AS e FROM u WHERE start_seconds IS NOT NULL GROUP BY 1)
        SELECT c.chunk_id, coalesce(s, start_seconds) AS start, coalesce(e, end_seconds) AS "end", CASE WHEN s IS NOT NULL THEN 'utterances' ELSE 'units' END AS timing_source FROM c LEFT JOIN r USING (chunk_id)""",
    "review_flags": f"WITH {_REASONED} SELECT qa_candidate_id, array_to_string(up, ',') AS flags FROM u",
    "pair_risk": f"WITH {_RISKY} SELECT qa_candidate_id, risk_score, array_to_string(risks, ',') AS reasons FROM r",
    "strict_gate": f"""WITH {_RISKY} SELECT qa_candidate_id, coalesce(CASE WHEN list_contains(codes, 'deflection_answer_penalty') THEN 'deflection_answer_penalty' END, CASE WHEN coalesce(pair_confidence, 0) < 0.40 THEN 'below_min_confidence' END,
        {_FIRST(ex.WEAK_QUESTION_REASONS)}, CASE WHEN pair_confidence < 0.72 THEN {_FIRST(ex.WEAK_PAIR_REASONS)} END, CASE WHEN intent IN ('embedded_statement_question', 'weak_question_form') THEN intent END,
        CASE WHEN NOT (shared_keywords > 0 AND continuation_text IS NOT NULL) THEN list_filter({_list(ex.RISK_ORDER)}, lambda n: list_contains(risks, n) OR list_contains(codes, n))[1] END) AS suppressed_by FROM r""",
}
SQL = {name: rounded(sql) if name in ("monologue_risk", "answer_selection", "review_flags", "pair_risk", "strict_gate") else sql for name, sql in SQL.items()}
