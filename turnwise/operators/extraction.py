"""Extraction of question-and-answer pairs from ordered units: focus, context, candidates, scores, flags, risk, gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.config import Options
from turnwise.functions import lexical as lx
from turnwise.operators import questions as qs
from turnwise.operators.joins import keyed_join
from turnwise.operators.ordering import grouped_running, windowed
from turnwise.session import staged

#: Silence that context, a recovered question and a split question may span.
CONTEXT_GAP, COMPLETION_GAP = 3.5, 0.35
#: Characters of an answer for each unit it may have.
ANSWER_CHARS = 350
#: Units behind a question in which a cluster of prompts and echoes may put off the answer, and its limits.
CLUSTER_UNITS, CLUSTER_BRIDGES, CLUSTER_TOKENS, CLUSTER_LEAST = 8, 4, 12, 5
#: Units before a question in which its prompt and the question it echoes are looked for.
ECHO_UNITS = 4
LEAST_QUESTION = 0.45


def _none() -> Column:
    return F.array().cast("array<string>")


def sentence_spans(text: Column) -> Column:
    """ARRAY<STRUCT<span, start, end>>: stretches up to a final mark, with their offsets; blank ones are left out.

    A text without any is one span. The pieces tile the text, so offsets are running lengths.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"[.?!]*[^.?!]+[.?!]?"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<span:string,start:int,end:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        bare = F.regexp_replace(p, r"^[.?!]+", "")
        end = acc["at"] + F.length(p)
        one = F.struct(F.trim(bare).alias("span"), (end - F.length(bare)).cast("int").alias("start"), end.cast("int").alias("end"))
        return F.struct(end.cast("int").alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    found = F.filter(F.aggregate(pieces, start, step)["spans"], lambda s: s["span"] != "")
    whole = F.array(F.struct(F.trim(text).alias("span"), F.lit(0).alias("start"), F.length(text).cast("int").alias("end")))
    return F.when(F.size(found) > 0, found).otherwise(whole)


def noise_columns(rule: Column) -> dict[str, Column]:
    """Predicates on rule text that tell chatter from content, by name."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(rule, r"[ ?.!;:]+$", "")), r"\s+", " ")
    tokens = lx.rule_tokens(bare)
    n = F.size(tokens)
    meta = F.size(F.filter(lx.content_tokens(bare), lambda t: t.isin(*lx.DEFLECTION_META)))
    dismissive = F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in (*lx.DEFLECTION_DISMISSIVE, *lx.NEGATIONS)])))
    any_of = lambda patterns, c: c.rlike("|".join(f"(?:{p})" for p in patterns))
    only = lambda words, c: (F.size(c) > 0) & (F.size(F.filter(c, lambda t: ~t.isin(*words))) == 0)
    return {
        "check_in": bare.rlike(qs.CHECK_IN), "poll": bare.rlike(qs.POLL) | ((n <= 6) & only([*lx.POLL_WORDS, "or", "o"], tokens)),
        "backchannel": rule.rlike(lx.BACKCHANNEL_CHECK), "procedural": rule.rlike(lx.PROCEDURAL), "follow_up_prompt": bare.rlike(lx.FOLLOW_UP_PROMPT), "hand_off": any_of(lx.HAND_OFFS, rule),
        "boilerplate": any_of(lx.BOILERPLATE, bare) | bare.isin(*lx.FILLER_ANSWERS), "backchannel_answer": (n <= 4) & only([*lx.BACKCHANNEL_WORDS, *lx.POLL_WORDS], tokens),
        "deflection": (n <= 18) & (meta >= 1) & (dismissive >= 1) & (meta >= 0.2 * F.size(lx.content_tokens(bare))),
        "incomplete": F.element_at(F.concat(F.array(F.lit("")), tokens), -1).isin(*lx.INCOMPLETE_ENDS) | (bare.rlike(lx.INCOMPLETE_STARTS) & ~rule.rlike(r"[.!?]\s*$")),
        "additive": bare.rlike(lx.ADDITIVE_STARTS), "causal": any_of(lx.CAUSAL_STATEMENTS, bare),
    }


def trimmed_answer(df: DataFrame, question: str, answer: str) -> DataFrame:
    """Adds `trimmed` and `trim_reasons`: the answer without a meta opening, a confirming tag at its end, or check-ins
    between its sentences. Each cut is made only if enough is left: 3 tokens, 2 tokens, and for inner check-ins 7 tokens
    with a cue, a word of the question or 5 content words."""
    size = lambda c: F.size(lx.rule_tokens(lx.rule_text(c)))
    text = F.trim(F.col(answer))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, lx.META_OPENING, 1), r"\s+", " "), r"^[ ,.\-]+|[ ,.\-]+$", "")
    out = df.withColumn("_rest", rest)
    opens = size(F.col("_rest")) >= 3
    out = out.withColumn("_opened", F.when(opens, F.col("_rest")).otherwise(text))
    body = F.regexp_replace(F.regexp_replace(F.regexp_extract("_opened", lx.TRAILING_TAG, 1), r"\s+", " "), r"^[ ,;:.]+|[ ,;:.]+$", "")
    out = out.withColumn("_body", body)
    tags = size(F.col("_body")) >= 2
    out = out.withColumn("_tagged", F.when(tags, F.col("_body")).otherwise(F.col("_opened")))
    out = out.withColumn("_spans", F.transform(sentence_spans(F.col("_tagged")), lambda s: s["span"]))
    last = F.size("_spans") - 1
    chat = lambda s: (F.size(lx.rule_tokens(lx.rule_text(s))) <= 12) & lx.rule_text(s).rlike(lx.BACKCHANNEL_CHECK)
    kept = F.filter("_spans", lambda s, i: ~((i > 0) & (i < last) & chat(s)))
    out = out.withColumn("_kept", F.when((F.size("_spans") >= 3) & (F.size(kept) < F.size("_spans")), F.array_join(kept, " ")))
    rule = lx.rule_text(F.col("_kept"))
    stands = (size(F.col("_kept")) >= 7) & ((lx.cue_weight(rule, lx.ANSWER_CUES, 1.0) > 0) | F.arrays_overlap(lx.content_tokens(rule), lx.content_tokens(lx.rule_text(F.coalesce(question, F.lit(""))))) | (F.size(lx.content_tokens(rule)) >= 5))
    stands = F.coalesce(stands, F.lit(False))
    reasons = F.array_compact(F.array(F.when(opens, "answer_meta_opening_trimmed"), F.when(tags, "answer_trailing_tag_trimmed"), F.when(stands, "answer_internal_checkin_trimmed")))
    return out.withColumn("trimmed", F.when(stands, F.col("_kept")).otherwise(F.col("_tagged"))).withColumn("trim_reasons", reasons).drop("_rest", "_opened", "_body", "_tagged", "_spans", "_kept")


def question_focus(units: DataFrame, unit: str = "unit_id", text: str = "text") -> DataFrame:
    """Adds to every unit that may ask something `focus`, `preamble`, `seed` and the columns of `question_scores`.

    Of the spans with a question mark the best score wins, the first on a tie. Without a mark, the part before a colon
    that holds a cue is the focus, or else the first span with a cue, from behind a didactic lead-in on. The text
    before the focus is its preamble, the text behind it the seed of an answer in the same unit.
    """
    t = F.col(text)
    spans = sentence_spans(t)
    cue = lambda c: (lx.cue_weight(lx.rule_text(c), lx.QUESTION_CUES, 1.0) > 0) | (lx.cue_weight(lx.rule_text(c), lx.DIDACTIC_CUES, 1.0) > 0)
    colon = F.regexp_extract(t, r"^([^:?]{4,}):", 1)
    before = F.array(F.struct(F.trim(colon).alias("span"), F.lit(0).alias("start"), (F.length(colon) + 1).cast("int").alias("end")))
    implied = F.slice(F.filter(spans, lambda s: cue(s["span"])), 1, 1)
    chosen = F.when(t.contains("?"), F.filter(spans, lambda s: s["span"].contains("?"))).when((colon != "") & cue(colon), before).otherwise(implied)
    rows = units.filter(t.isNotNull()).withColumn("_c", chosen).select("*", F.posexplode("_c").alias("_n", "_s")).drop("_c")
    led = F.regexp_extract("_s.span", lx.DIDACTIC_LEAD, 2)
    leads = ~F.col("_s.span").contains("?") & (F.size(lx.rule_tokens(lx.rule_text(led))) >= 4)
    rows = rows.withColumn("focus", F.when(leads, F.trim(led)).otherwise(F.col("_s.span"))).withColumn("_start", F.when(leads, F.col("_s.end") - F.length(led)).otherwise(F.col("_s.start"))).withColumn("_end", F.col("_s.end"))
    scored = qs.question_scores(rows, "focus")
    keep = [c for c in scored.columns if c not in ("_s", "_n", unit)]
    best = scored.groupBy(unit).agg(F.max_by(F.struct(*keep), F.struct("question_score", -F.col("_n"))).alias("b")).select(unit, "b.*")
    out = best.withColumn("preamble", F.trim(F.substring(text, F.lit(1), F.col("_start")))).withColumn("seed", F.trim(F.substring(text, F.col("_end") + 1, F.length(text))))
    return out.drop("_start", "_end")


def span_integrity(df: DataFrame) -> DataFrame:
    """Adds `integrity`: a penalty where the focus starts inside a sentence, unless a bridge such as `that is` leads in."""
    rule = F.regexp_replace(lx.rule_text(F.col("preamble")), r"\s+$", "")
    clean = (F.coalesce("preamble", F.lit("")) == "") | F.col("preamble").rlike(r"[.?!;:]$") | rule.rlike(lx.BRIDGE_ENDS)
    return df.withColumn("integrity", F.when(clean, 0.0).otherwise(-0.10))


def question_support(df: DataFrame) -> DataFrame:
    """Adds `support` and `support_reasons` from the sentence's own labels; null where the unit has none (`quality` null).

    Reads grounded, quality, merge_safety, review_priority, autonomy, boundary, continuation, speaker_status, margin.
    """
    steady = F.coalesce(F.col("speaker_status").isin("stable", "mostly_stable"), F.lit(False))
    terms = [
        (F.coalesce("grounded", F.lit(False)), 0.03, "question_utterance_grounded"), (~F.coalesce("grounded", F.lit(False)), -0.03, "question_missing_utterance_grounding"),
        (F.col("quality") == "good", 0.02, "question_sentence_quality_good"), (F.col("quality") == "borderline", -0.02, "question_sentence_quality_borderline"), (F.col("quality").isin("fragment", "run_on"), -0.08, "question_sentence_quality_penalty"),
        (F.col("merge_safety") == "safe", 0.02, "question_merge_safety_support"), (F.col("merge_safety") == "borderline", -0.03, "question_merge_safety_borderline"), (F.col("merge_safety") == "risky", -0.06, "question_merge_safety_penalty"),
        (F.col("review_priority") == "medium", -0.02, "question_review_priority_medium"), (F.col("review_priority") == "high", -0.04, "question_review_priority_high"),
        (F.col("autonomy") < 0.45, -0.08, "question_low_sentence_autonomy"), ((F.col("autonomy") >= 0.45) & (F.col("autonomy") < 0.60), -0.03, "question_borderline_sentence_autonomy"),
        (F.col("boundary") < 0.45, -0.06, "question_low_boundary_confidence"), (F.col("continuation") >= 0.42, -0.04, "question_continuation_risk"),
        (steady, 0.02, "question_speaker_resolution_support"), (F.col("speaker_status") == "mixed", -0.05, "question_speaker_conflict_penalty"), (steady & (F.col("margin") >= 0.45), 0.02, "question_speaker_dominance_support"),
    ]
    total: Column = F.lit(0.0)
    for when, weight, _ in terms:
        total = total + F.when(when, weight).otherwise(0.0)
    known = F.col("quality").isNotNull()
    reasons = F.array_compact(F.array(*[F.when(when, code) for when, _, code in terms]))
    return df.withColumn("support", F.when(known, F.round(total, 4)).otherwise(0.0)).withColumn("support_reasons", F.when(known, reasons).otherwise(_none()))


# What a question's reasons take from its didactic use, and kinds that add to it.
DIDACTIC_WEIGHTS = {
    "rhetorical_checkin_question": -0.28, "rhetorical_poll_question": -0.42, "declarative_tag_question": -0.30, "fragment_question": -0.18, "implicit_declarative_question_penalty": -0.18,
    "question_intent_poll_or_check": -0.18, "question_intent_rhetorical_tag": -0.18, "question_intent_fragment": -0.16, "question_intent_embedded_statement": -0.10, "question_intent_weak_form": -0.08,
}
DIDACTIC_KINDS = ("why", "how", "where", "difference", "didactic_prompt")


def didactic_usefulness(df: DataFrame, expanded: Column, seeded: Column) -> DataFrame:
    """Adds `didactic_score`, and `final_question_score`: the larger of it and the score with support and integrity."""
    total = F.col("question_score") + F.greatest(F.lit(-0.02), F.least(F.lit(0.04), F.col("support"))) + F.when(expanded, 0.06).otherwise(0.0) + F.when(seeded, 0.04).otherwise(0.0)
    for reason, weight in DIDACTIC_WEIGHTS.items():
        total = total + F.when(F.array_contains("question_reasons", reason), weight).otherwise(0.0)
    total = total + F.when(F.col("question_kind").isin(*DIDACTIC_KINDS), 0.03).otherwise(0.0)
    out = df.withColumn("didactic_score", lx.clamp(total))
    return out.withColumn("final_question_score", F.greatest("didactic_score", lx.clamp(F.col("question_score") + F.col("support") + F.col("integrity"))))


def neighbours(units: DataFrame) -> DataFrame:
    """Adds `k`, the place of a unit in its source, and text, end, speaker of the units before and start, text behind it."""
    order = ["u_start", "u_end", "unit_id"]
    out = grouped_running(units, ["source"], order, name="k")
    around = {"_b1": ("lag", F.struct("text", "u_end", "speaker", "segments", "unit_id")), "_a1": ("lead", F.struct("text", "u_start", "speaker"))}
    return windowed(out, ["source"], order, around)


def in_context(df: DataFrame) -> DataFrame:
    """Adds to rows of `question_focus` over `neighbours`: `recovered`, `recomposed`, `expanded` and `question_text`.

    A question without its mark is recovered where its preamble is clean and another unit follows within CONTEXT_GAP
    that does not just go on. A focus that begins its unit is recomposed with the unit before it where that one, of the
    same speaker and within CONTEXT_GAP, has no final mark. A contextual question gets the unit before it as context,
    unless that lies in a distant segment.
    """
    gap = F.greatest(F.lit(0.0), F.col("u_start") - F.col("_b1.u_end"))
    near = F.coalesce(gap <= CONTEXT_GAP, F.lit(False))
    same = F.col("_b1.speaker").eqNullSafe(F.col("speaker"))
    follows = F.coalesce(F.col("_a1.u_start") - F.col("u_end") <= CONTEXT_GAP, F.lit(False))
    goes_on = F.coalesce(noise_columns(lx.rule_text(F.col("_a1.text")))["additive"], F.lit(False))
    implicit = ~F.col("focus").contains("?")
    recovered = implicit & (F.col("question_score").isNotNull()) & (F.col("integrity") == 0) & follows & ~goes_on & F.col("is_head")
    open_before = near & same & (F.col("preamble") == "") & ~lx.ends_strongly(F.col("_b1.text"))
    relation = segment_relation(F.col("_b1.segments"), F.col("segments"))
    expands = near & F.col("is_contextual") & (relation != "distant_segment")
    out = df.withColumn("recovered", recovered).withColumn("recomposed", open_before).withColumn("expanded", expands)
    joined = F.when(F.col("expanded") | F.col("recomposed"), F.concat_ws(" ", "_b1.text", "focus")).otherwise(F.col("focus"))
    return out.withColumn("question_text", joined).withColumn("question_score", F.when(F.col("question_score").isNotNull(), lx.clamp(F.col("question_score") + F.when(F.col("recovered"), 0.06).otherwise(0.0))))


def segment_relation(question: Column, answer: Column) -> Column:
    """same_segment, next_segment, distant_segment or segment_unknown, from the places of the segments of both sides."""
    apart = F.array_min(F.flatten(F.transform(question, lambda a: F.transform(answer, lambda b: F.abs(a - b)))))
    known = (F.size(F.coalesce(question, F.array().cast("array<int>"))) > 0) & (F.size(F.coalesce(answer, F.array().cast("array<int>"))) > 0)
    return F.when(~known, "segment_unknown").when(apart == 0, "same_segment").when(apart == 1, "next_segment").otherwise("distant_segment")


def echoed_questions(asked: DataFrame, placed: DataFrame) -> DataFrame:
    """(question_id, is_echo): whether among the ECHO_UNITS units before a question lie a prompt and a question that it
    repeats in good part. `asked` has (source, question_id, k, text); units are joined by place, never by window."""
    wanted = asked.withColumn("k", F.explode(F.array(*[F.col("k") - i for i in range(1, ECHO_UNITS + 1)])))
    rows = wanted.join(placed.select("source", "k", F.col("text").alias("_before")), ["source", "k"])
    q, b = lx.content_tokens(lx.rule_text(F.col("text"))), lx.content_tokens(lx.rule_text(F.col("_before")))
    prompt = noise_columns(lx.rule_text(F.col("_before")))["follow_up_prompt"]
    related = ~prompt & F.col("_before").contains("?") & (lx.overlap_ratio(q, b) >= 0.45) & (F.size(q) <= 8)
    return rows.groupBy("question_id").agg((F.max(prompt.cast("int")) + F.max(related.cast("int")) == 2).alias("is_echo"))


def plausible(text: Column, units: int = qs.ANSWER_UNITS) -> Column:
    """Whether a text can be a concise answer: three tokens, at most one question mark, no more than its share of text."""
    marks = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    return F.coalesce((F.length(F.trim(text)) <= units * ANSWER_CHARS) & (F.size(lx.rule_tokens(lx.rule_text(text))) >= 3) & (marks <= 1), F.lit(False))


_CANDIDATE = ("question_id", "origin", "distance", "span", "gap", "answer_start", "answer_end", "answer_text", "answer_segments", "first_text", "truncated", "completed")


def answer_candidates(asked: DataFrame, placed: DataFrame, o: Options) -> DataFrame:
    """(question_id, origin, distance, span, gap, answer_start, answer_end, answer_text, answer_segments, first_text,
    truncated, completed): every place where an answer may stand.

    `same_unit`: the text behind the focus. `local`: growing spans of the next units, up to another question, a long
    silence or the limits. `completed`: a span that breaks off, with the unit that goes on. `competing_prefix`: what a
    unit says before it asks the next question. `cluster`: behind up to CLUSTER_BRIDGES prompts and echoes. Units are
    met by (source, place); a question meets at most CLUSTER_UNITS of them.
    """
    units = placed.select("source", "k", "u_start", "u_end", "text", F.col("segments").alias("_seg"), F.coalesce("asks", F.lit(False)).alias("asks"), F.coalesce("lead", F.lit("")).alias("lead"))
    wanted = asked.select("source", "question_id", F.col("k").alias("qk"), F.col("u_end").alias("q_end"), F.explode(F.sequence(F.lit(1), F.lit(CLUSTER_UNITS))).alias("step")).withColumn("k", F.col("qk") + F.col("step"))
    met = wanted.join(units, ["source", "k"])
    noise = noise_columns(lx.rule_text(F.col("text")))
    tokens = F.size(lx.rule_tokens(lx.rule_text(F.col("text"))))
    met = met.withColumn("prompt", noise["follow_up_prompt"]).withColumn("tokens", tokens)
    one = F.struct("step", "u_start", "u_end", "text", "asks", "lead", "prompt", "tokens", F.col("_seg").alias("seg"))
    lines = staged(met.groupBy("question_id", "q_end").agg(F.array_sort(F.collect_list(one)).alias("line")))
    last = lambda a: F.element_at(a, -1)

    def shaped(d: DataFrame, origin: Column, truncated: Column, completed: Column) -> DataFrame:
        part = F.col("part")
        return d.filter(F.size("part") > 0).select(
            "question_id", origin.alias("origin"), part[0]["step"].alias("distance"), F.size(part).alias("span"), F.greatest(F.lit(0.0), part[0]["u_start"] - F.col("q_end")).alias("gap"), part[0]["u_start"].alias("answer_start"),
            F.array_max(F.transform(part, lambda u: u["u_end"])).alias("answer_end"), F.array_join(F.transform(part, lambda u: u["text"]), " ").alias("answer_text"), F.array_distinct(F.flatten(F.transform(part, lambda u: u["seg"]))).alias("answer_segments"),
            part[0]["text"].alias("first_text"), truncated.alias("truncated"), completed.alias("completed"),
        )

    no = F.lit(False)
    fits = lambda part: (part[0]["u_start"] - F.col("q_end") <= qs.ANSWER_GAP) & (last(part)["u_end"] - part[0]["u_start"] <= o.max_answer_duration_seconds) & ~F.exists(part, lambda u: u["asks"])
    grown = lines.select("*", F.explode(F.sequence(F.lit(1), F.lit(o.max_answer_units))).alias("n")).withColumn("part", F.slice("line", 1, F.col("n"))).filter(F.size("part") == F.col("n"))
    grown = grown.filter(fits(F.col("part"))).withColumn("next", F.get("line", F.col("n")))
    unended = ~lx.ends_strongly(last(F.col("part"))["text"])
    goes_on = F.coalesce((F.col("next.u_start") - last(F.col("part"))["u_end"] <= COMPLETION_GAP) & (F.col("next.text").rlike(r"^[\p{Ll},]") | lx.first_word(F.col("next.text")).isin(*lx.CONTINUATION_MARKERS)) & ~F.col("next.asks"), no)
    local = shaped(grown.withColumn("_t", unended & ~goes_on), F.lit("local"), F.col("_t"), no)
    whole = grown.filter(unended & goes_on & (F.col("n") < o.max_answer_units)).withColumn("part", F.concat("part", F.array("next")))
    completed = shaped(whole.filter(fits(F.col("part"))), F.lit("completed"), no, F.lit(True))
    rival = lines.withColumn("_at", F.get(F.filter("line", lambda u: u["asks"]), F.lit(0))).filter(F.col("_at").isNotNull() & (F.col("_at.step") <= o.max_answer_units) & plausible(F.col("_at.lead")))
    rival = rival.withColumn("part", F.array(F.struct("_at.step", "_at.u_start", "_at.u_end", F.col("_at.lead").alias("text"), no.alias("asks"), F.lit("").alias("lead"), no.alias("prompt"), F.col("_at.tokens"), "_at.seg")))
    prefix = shaped(rival.filter(F.col("_at.u_start") - F.col("q_end") <= qs.ANSWER_GAP), F.lit("competing_prefix"), no, no)
    head = F.aggregate("line", F.struct(F.lit(0).alias("n"), no.alias("p"), F.lit(True).alias("open")), lambda a, u: F.when(a["open"] & (u["asks"] | u["prompt"]), F.struct((a["n"] + 1).alias("n"), (a["p"] | u["prompt"]).alias("p"), F.lit(True).alias("open"))).otherwise(F.struct(a["n"].alias("n"), a["p"].alias("p"), no.alias("open"))))
    behind = lines.withColumn("_h", head).filter(F.col("_h.n").between(1, CLUSTER_BRIDGES) & F.col("_h.p")).withColumn("_rest", F.slice("line", F.col("_h.n") + 1, o.max_answer_units))
    enough = F.aggregate("_rest", F.struct(F.lit(0).alias("n"), F.lit(0).alias("t"), F.lit(True).alias("open")), lambda a, u: F.when(a["open"] & ~u["asks"], F.struct((a["n"] + 1).alias("n"), (a["t"] + u["tokens"]).alias("t"), (a["t"] + u["tokens"] < CLUSTER_TOKENS).alias("open"))).otherwise(F.struct(a["n"].alias("n"), a["t"].alias("t"), no.alias("open"))))
    behind = behind.withColumn("_e", enough).filter(F.col("_e.t") >= CLUSTER_LEAST).withColumn("part", F.slice("_rest", 1, F.col("_e.n")))
    cluster = shaped(behind.filter(F.col("part")[0]["u_start"] - F.col("q_end") <= qs.ANSWER_GAP), F.lit("cluster"), no, no)
    seed = asked.filter(plausible(F.col("seed"))).select(
        "question_id", F.lit("same_unit").alias("origin"), F.lit(0).alias("distance"), F.lit(1).alias("span"), F.lit(0.0).alias("gap"), F.col("u_start").alias("answer_start"), F.col("u_end").alias("answer_end"), F.col("seed").alias("answer_text"),
        F.col("segments").alias("answer_segments"), F.col("seed").alias("first_text"), no.alias("truncated"), no.alias("completed"),
    )
    out = seed
    for d in (local, completed, prefix, cluster):
        out = out.unionByName(d)
    return out.select(*_CANDIDATE)


def deferred_candidates(asked: DataFrame, placed: DataFrame, best_local: DataFrame) -> DataFrame:
    """Candidates of the same columns, RECUR_FROM to RECUR_TO units behind a question whose next units answer it weakly:
    units that share its content words, do not ask, and align with it. `best_local` has (question_id, best_score)."""
    weak = asked.join(best_local, "question_id", "left").filter((F.col("didactic_score") >= 0.62) & (F.coalesce("best_score", F.lit(0.0)) < 0.38))
    size = qs.RECUR_TO - qs.RECUR_FROM + 1
    words = lambda d: d.withColumn("word", F.explode(F.filter(lx.content_tokens(lx.rule_text(F.col("text"))), lambda t: ~t.isin(*lx.WEAK_KEYWORDS))))
    first = F.floor((F.col("k") + qs.RECUR_FROM) / size)
    q = words(weak.withColumn("text", F.col("question_text"))).select("source", "question_id", "question_text", F.col("u_end").alias("q_end"), F.col("k").alias("qk"), "word", F.explode(F.array(first, first + 1)).alias("block"))
    u = words(placed.filter(~F.coalesce("asks", F.lit(False)))).select("source", "k", "u_start", "u_end", "text", "segments", "word", F.floor(F.col("k") / size).alias("block"))
    met = q.join(u, ["source", "word", "block"]).filter((F.col("k") - F.col("qk")).between(qs.RECUR_FROM, qs.RECUR_TO)).drop("word", "block").dropDuplicates(["question_id", "k"])
    good = qs.alignment_columns(met, "question_text", "text").filter(F.col("alignment") >= 0.18)
    return good.select(
        "question_id", F.lit("deferred").alias("origin"), (F.col("k") - F.col("qk")).cast("int").alias("distance"), F.lit(1).alias("span"), F.greatest(F.lit(0.0), F.col("u_start") - F.col("q_end")).alias("gap"),
        F.col("u_start").alias("answer_start"), F.col("u_end").alias("answer_end"), F.col("text").alias("answer_text"), F.col("segments").alias("answer_segments"), F.col("text").alias("first_text"), F.lit(False).alias("truncated"), F.lit(False).alias("completed"),
    )


def span_completeness(df: DataFrame, question: str, answer: str, first: str, span: str, strict: bool) -> DataFrame:
    """Adds `part_span` and `span_reason`: whether the units behind the first add substance to an answer.

    Reads alignment, shared_keywords, shared_numbers, answer_tokens, distance and completed of the whole answer.
    """
    whole = F.col("alignment")
    named = ["alignment", "shared_keywords", "shared_numbers", "token_overlap", "new_tokens", "relevance"]
    held = df.select("*", *[F.col(c).alias(f"_w_{c}") for c in named]).drop(*named)
    one = qs.alignment_columns(held, question, first)
    one = one.select("*", F.col("alignment").alias("_f_alignment"), ((F.col("shared_keywords") > 0) | (F.col("shared_numbers") > 0) | (lx.cue_weight(lx.rule_text(F.col(first)), lx.ANSWER_CUES, 1.0) > 0)).alias("_f_signal")).drop(*named)
    for c in named:
        one = one.withColumnRenamed(f"_w_{c}", c)
    signal = (F.col("shared_keywords") > 0) | (F.col("shared_numbers") > 0) | (F.col("part_cues") > 0)
    broken = noise_columns(lx.rule_text(F.col(first)))["incomplete"] | ~lx.ends_strongly(F.col(first))
    short, several = F.col("answer_tokens") <= 70, F.col(span) > 1
    extends = signal & short & ((whole - F.col("_f_alignment") >= 0.08) | ~F.col("_f_signal"))
    reason = F.when(several & (F.col("completed") | (~extends & broken & short)), "answer_span_completion_support").when(several & extends, "answer_span_extension_support")
    reason = reason.when(several & (F.col("answer_tokens") > 80), "answer_span_too_broad_penalty")
    delta = F.when(several & F.col("completed"), F.when(short, 0.12).otherwise(0.04)).when(several & extends, 0.12).when(several & broken & short, F.when(signal, 0.10).otherwise(0.06)).when(several & (F.col("answer_tokens") > 80), -0.08)
    if strict:
        premise = ~several & ~signal & (F.col("answer_tokens") <= 9) & (F.col("distance") <= 1)
        reason, delta = reason.when(premise, "premise_only_answer_penalty"), delta.when(premise, -0.10)
    return one.withColumn("part_span", F.coalesce(delta, F.lit(0.0))).withColumn("span_reason", reason).drop("_f_alignment", "_f_signal")


def answer_context(quality: Column, merge: Column, priority: Column, grounded: Column) -> Column:
    """Delta from the grounding and the labels (arrays) of an answer's sentences; 0 where they have no labels."""
    has = lambda c, *names: F.exists(F.coalesce(c, _none()), lambda x: x.isin(*names))
    worst = F.when(has(quality, "fragment", "run_on") | has(merge, "risky") | has(priority, "high"), -0.08).when(has(quality, "borderline") | has(merge, "borderline") | has(priority, "medium"), -0.02).otherwise(0.05)
    return F.when(F.size(F.coalesce(quality, _none())) > 0, F.round(worst + F.when(grounded, 0.04).otherwise(-0.05), 4)).otherwise(0.0)


WEAK_INTENTS = ("embedded_statement_question", "weak_question_form", "rhetorical_tag", "poll_or_check", "fragment", "subordinate_fragment")


def monologue_risk(df: DataFrame, question_voice: Column, answer_voice: Column, strict: bool, trimmed: Column | None = None) -> DataFrame:
    """Adds `part_monologue`: a penalty for a near local answer that reads like its own speaker going on.

    Voices are speaker names where they are reliable, else null. Reads origin, distance, gap, intent, shared_keywords,
    shared_numbers, part_cues, new_tokens, part_responsive.
    """
    near = F.col("origin").isin("local", "completed", "same_unit") & (F.col("distance") <= 1) & (F.col("gap") <= 6)
    turn, same = F.coalesce(question_voice != answer_voice, F.lit(False)), F.coalesce(question_voice == answer_voice, F.lit(False))
    missing = question_voice.isNull() | answer_voice.isNull()
    anchor = (F.col("shared_keywords") > 0) | (F.col("shared_numbers") > 0)
    odd, cue = F.col("intent").isin(*WEAK_INTENTS), F.col("part_cues") > 0
    weak = (F.col("part_responsive") <= -0.10) | (~anchor & (~cue | (F.col("new_tokens") <= 2)))
    ladder = F.when(weak & (odd | same), -0.22)
    if strict:
        ladder = ladder.when(weak & missing & ~(trimmed if trimmed is not None else F.lit(False)), -0.16)
    return df.withColumn("part_monologue", F.when(near & ~turn, F.coalesce(ladder.when(odd & ~cue, -0.10), F.lit(0.0))).otherwise(0.0))


def selected_answers(df: DataFrame, group: Sequence[str], place: str = "place") -> DataFrame:
    """One row a question: the best short answer of its own sentence from .45 on, else the first by place that does not
    ask. A question's candidates are few, so the choice is an aggregation."""
    asks = F.coalesce(F.col("answer_text").contains("?"), F.lit(False))
    own = (F.col("origin") == "same_unit") & (F.col("answer_tokens") <= 4) & (F.col("answer_score") >= 0.45)
    rest = [c for c in df.columns if c not in group]
    best = df.filter(~asks).groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(F.when(own, 0).otherwise(1), F.when(own, -F.col("answer_score")).otherwise(0.0), place)).alias("_b"))
    return best.select(*group, "_b.*")


def grounded_times(spans: DataFrame, utterances: DataFrame) -> DataFrame:
    """(item, start, end, timing_source): the reach of the utterances that a span names, or else of its own units.

    `spans` has (item, utterance_ids, own_start, own_end), `utterances` (utterance_id, start, end).
    """
    named = spans.select("item", F.explode(F.array_distinct("utterance_ids")).alias("utterance_id"))
    reach = named.join(utterances, "utterance_id").groupBy("item").agg(F.min("start").alias("_s"), F.max("end").alias("_e"))
    both = keyed_join(spans, reach, ["item"], "left")
    return both.select("item", F.coalesce("_s", "own_start").alias("start"), F.coalesce("_e", "own_end").alias("end"), F.when(F.col("_s").isNotNull(), "utterances").otherwise("units").alias("timing_source"))


# Flags that reasons put up for review.
REASON_FLAGS = {
    "competing_question_nearby": "competing_question", "segment_unknown": "segment_unknown", "rhetorical_poll_question": "rhetorical_poll_question", "poll_or_backchannel_noise": "poll_or_backchannel_noise",
    "procedural_question_request": "procedural_question_request", "fragment_question": "fragment_question", "declarative_tag_question": "declarative_tag_question",
    "low_autonomy_implicit_question": "low_autonomy_implicit_question", "question_low_sentence_autonomy": "low_sentence_autonomy", "question_low_boundary_confidence": "low_boundary_confidence",
    "answer_echoes_question_penalty": "same_sentence_echo", "answer_circular_echo_penalty": "circular_answer_echo", "same_sentence_without_answer_cue": "same_sentence_without_answer_cue",
    "quality_local_deferred_penalty": "quality_local_deferred", "answer_boilerplate_penalty": "answer_boilerplate", "deflection_answer_penalty": "deflection_answer",
    "low_information_answer_penalty": "low_information_answer", "incomplete_answer_span_penalty": "incomplete_answer_span", "surface_answer_cue_penalty": "surface_answer_cue",
    "deferred_answer_too_broad_penalty": "deferred_answer_too_broad", "answer_poll_or_backchannel_penalty": "answer_poll_or_backchannel", "answer_truncated_at_boundary_penalty": "answer_truncated_at_boundary",
    "question_span_integrity_penalty": "question_span_integrity", "answer_responsiveness_weak": "weak_answer_responsiveness", "answer_responsiveness_followup_prompt": "followup_prompt_answer",
    "monologue_continuation_risk": "monologue_continuation_risk", "question_intent_poll_or_check": "poll_or_check_question", "question_intent_rhetorical_tag": "rhetorical_tag_question",
    "question_intent_fragment": "fragment_question", "question_intent_subordinate_fragment": "subordinate_fragment_question", "question_intent_embedded_statement": "embedded_statement_question",
    "question_intent_weak_form": "weak_question_form",
}
# Risk weights of review flags and of reasons under other names.
FLAG_RISKS = {
    "low_confidence": 0.20, "fallback_input_layer": 0.16, "answer_is_question": 0.28, "rhetorical_poll_question": 0.28, "poll_or_backchannel_noise": 0.22, "procedural_question_request": 0.24,
    "poll_or_check_question": 0.24, "fragment_question": 0.24, "subordinate_fragment_question": 0.24, "declarative_tag_question": 0.22, "weak_question_form": 0.22, "embedded_statement_question": 0.18,
    "weak_implicit_quantity_question": 0.24, "weak_expanded_contextual_question": 0.24, "low_autonomy_implicit_question": 0.24, "low_sentence_autonomy": 0.16, "low_boundary_confidence": 0.12,
    "same_sentence_echo": 0.24, "circular_answer_echo": 0.24, "same_sentence_without_answer_cue": 0.24, "answer_boilerplate": 0.24, "answer_poll_or_backchannel": 0.30, "low_information_answer": 0.20,
    "incomplete_answer_span": 0.14, "answer_truncated_at_boundary": 0.16, "question_span_integrity": 0.14, "surface_answer_cue": 0.22, "weak_answer_responsiveness": 0.22, "followup_prompt_answer": 0.26,
    "thin_answer_reply": 0.18, "unanchored_quantity_answer": 0.20, "monologue_continuation_risk": 0.24, "semantic_nonresponsive": 0.22, "deferred_answer_too_broad": 0.20, "quality_local_deferred": 0.14,
    "competing_question": 0.08, "segment_unknown": 0.08,
}
REASON_RISKS = {
    "answer_boilerplate_penalty": ("answer_boilerplate", 0.24), "answer_circular_echo_penalty": ("circular_answer_echo", 0.24), "answer_echoes_question_penalty": ("same_sentence_echo", 0.24),
    "answer_poll_or_backchannel_penalty": ("answer_poll_or_backchannel", 0.30), "answer_responsiveness_followup_prompt": ("followup_prompt_answer", 0.26), "answer_responsiveness_thin_reply": ("thin_answer_reply", 0.18),
    "answer_responsiveness_unanchored_quantity": ("unanchored_quantity_answer", 0.20), "answer_responsiveness_weak": ("weak_answer_responsiveness", 0.22), "answer_truncated_at_boundary_penalty": ("answer_truncated_at_boundary", 0.16),
    "deferred_long_temporal_gap": ("deferred_long_gap", 0.14), "distant_segment_penalty": ("distant_segment", 0.10), "incomplete_answer_span_penalty": ("incomplete_answer_span", 0.14),
    "low_question_answer_relevance": ("low_relevance", 0.32), "moderator_handoff_answer_penalty": ("moderator_handoff_answer", 0.20), "premise_only_answer_penalty": ("premise_only_answer", 0.28),
    "question_low_boundary_confidence": ("low_boundary_confidence", 0.12), "question_low_sentence_autonomy": ("low_sentence_autonomy", 0.16), "question_span_integrity_penalty": ("question_span_integrity", 0.14),
    "same_sentence_without_answer_cue": ("same_sentence_without_answer_cue", 0.24), "surface_answer_cue_penalty": ("surface_answer_cue", 0.22),
}
MEDIUM_RISK, IMPLICIT_RISK, WEAK_CONTEXT_RISK, THIN_CONTEXT_RISK, SURFACE_CUE_RISK = 0.04, 0.22, 0.14, 0.16, 0.22
#: Reasons that a report, and the gate, read at most.
RISK_REASONS = 8


def review_flags(reasons: Column, confidence: Column, asks: Column, fallback: Column) -> Column:
    """Flags for review, in fixed order: confidence, layer, an answer that asks, and what the reasons stand for."""
    known = F.coalesce(reasons, _none())
    found = [F.when(confidence < 0.45, "low_confidence").when(confidence < 0.75, "medium_confidence"), F.when(fallback, "fallback_input_layer"), F.when(asks, "answer_is_question")]
    found += [F.when(F.array_contains(known, code), flag) for code, flag in REASON_FLAGS.items()]
    return F.array_distinct(F.array_compact(F.array(*found)))


def risk_columns(df: DataFrame, reasons: Column, flags: Column, confidence: Column, weak_context: Column, thin_context: Column, cue: Column, relevance: Column) -> DataFrame:
    """Adds `risk_reasons`, cut to RISK_REASONS, and `risk_score`, which counts all of them.

    Flags with a weight count first, in order of name, then reasons under their other names where no flag named them
    yet, then low confidence, a question without mark, head or didactic cue, weak or thin context, and a cue without
    relevance.
    """
    why, up = F.coalesce(reasons, _none()), F.coalesce(flags, _none())
    has = lambda c: F.array_contains(why, c)
    out: list[tuple[Column, str | None, float]] = [(F.array_contains(up, f), f, FLAG_RISKS[f]) for f in sorted(FLAG_RISKS)]
    out += [(has(code) & ~F.array_contains(up, alias), alias, weight) for code, (alias, weight) in sorted(REASON_RISKS.items())]
    out.append(((confidence < 0.45) & ~F.array_contains(up, "low_confidence"), "low_confidence", FLAG_RISKS["low_confidence"]))
    out.append(((confidence >= 0.45) & (confidence < 0.75) & F.array_contains(up, "medium_confidence"), None, MEDIUM_RISK))
    out.append((~has("question_mark") & ~has("question_intent_autonomous_head") & ~has("question_intent_didactic_cue"), "implicit_question_risk", IMPLICIT_RISK))
    out += [(weak_context, "weak_context_risk", WEAK_CONTEXT_RISK), (thin_context, "thin_context_risk", THIN_CONTEXT_RISK), ((cue > 0) & (relevance <= 0), "surface_answer_cue_risk", SURFACE_CUE_RISK)]
    each = F.array(*[F.when(when, F.struct(F.lit(name).cast("string").alias("name"), F.lit(weight).alias("weight"))) for when, name, weight in out])
    found = df.withColumn("_risks", F.array_compact(each))
    names = F.array_distinct(F.array_compact(F.transform("_risks", lambda r: r["name"])))
    return found.withColumn("risk_reasons", F.slice(names, 1, RISK_REASONS)).withColumn("risk_score", lx.clamp(F.aggregate("_risks", F.lit(0.0), lambda s, r: s + r["weight"]))).drop("_risks")


# Reasons for which the strict gate holds a pair back.
WEAK_QUESTION_REASONS = ("declarative_tag_question", "fragment_question", "low_autonomy_implicit_question", "procedural_question_request", "question_intent_subordinate_fragment", "rhetorical_checkin_question", "rhetorical_poll_question")
WEAK_PAIR_REASONS = (
    "answer_boilerplate_penalty", "answer_circular_echo_penalty", "answer_poll_or_backchannel_penalty", "deflection_answer_penalty", "low_information_answer_penalty", "moderator_handoff_answer_penalty",
    "question_continuation_answer_penalty", "same_sentence_without_answer_cue",
)
RISK_ORDER = (
    "poll_or_backchannel_noise", "answer_poll_or_backchannel", "surface_answer_cue_risk", "implicit_question_risk", "quality_local_deferred", "unanchored_quantity_answer", "followup_prompt_answer",
    "weak_implicit_quantity_question", "weak_expanded_contextual_question", "thin_answer_reply", "low_sentence_autonomy", "incomplete_answer_span", "answer_truncated_at_boundary", "question_span_integrity",
    "weak_answer_responsiveness", "monologue_continuation_risk", "semantic_nonresponsive", "low_relevance", "competing_question",
)


def gate_reason(confidence: Column, reasons: Column, risks: Column, intent: Column, override: Column, strict: bool, least: float = 0.40) -> Column:
    """Why a pair is held back, or null if it is emitted. Other profiles than the strict one ask for `least` alone.

    In order: a deflecting answer, low confidence, a weak question, a weak pair below .72, a weak intent, a split
    question recovered without its mark, a deferred answer, and the first risk in RISK_ORDER; `override`, a cluster or
    completed span that is well anchored, lets the risks pass.
    """
    why, risk = F.coalesce(reasons, _none()), F.coalesce(risks, _none())
    has = lambda c: F.array_contains(why, c)
    low = F.when(F.coalesce(confidence, F.lit(0.0)) < least, "below_min_confidence")
    if not strict:
        return low
    first = lambda names: F.array_min(F.array_intersect(why, F.array(*[F.lit(n) for n in names])))
    listed = F.element_at(F.concat(F.filter(F.array(*[F.lit(n) for n in RISK_ORDER]), lambda n: F.array_contains(risk, n) | F.array_contains(why, n)), F.array(F.lit(None).cast("string"))), 1)
    return F.coalesce(
        F.when(has("deflection_answer_penalty"), "deflection_answer_penalty"), low, first(WEAK_QUESTION_REASONS), F.when(confidence < 0.72, first(WEAK_PAIR_REASONS)),
        F.when(intent.isin("embedded_statement_question", "weak_question_form"), intent),
        F.when(has("question_without_terminal_mark_recovered") & has("split_question_recomposed") & ~has("question_mark"), "question_without_terminal_mark_recovered"),
        F.when(has("quality_local_deferred_penalty"), "quality_local_deferred_penalty"), F.when(~override, listed),
    )


def extract_pairs(units: DataFrame, o: Options) -> DataFrame:
    """One call from ordered units to pairs: detect, search, score, rank, select, flag, gate and drop near-duplicates.

    `units` has (session_id, source, unit_id, u_start, u_end, text, speaker, segments ARRAY<INT>, grounded, quality,
    merge_safety, review_priority, autonomy, boundary, continuation, speaker_status, margin); labels may be null.
    Returns a row for every question with an answer: (session_id, source, qa_no, question_id, question_text,
    answer_text, origin, question_start, answer_start, answer_end, question_score, answer_score, confidence,
    segment_relation, reasons, review_flags, risk_reasons, risk_score, base_quality, final_quality, suppressed_by,
    duplicate_of). `qa_no` counts the questions of a source in order, with gaps where a question has no answer.

    Defined results: blank texts and units without times are left out; rows of one unit id that repeat count once;
    empty inputs give no rows; other columns are ignored.
    """
    labels = ["speaker", "segments", "grounded", "quality", "merge_safety", "review_priority", "autonomy", "boundary", "continuation", "speaker_status", "margin"]
    clean = units.filter("trim(text) != '' and u_start is not null and u_end is not null").select("session_id", "source", "unit_id", "u_start", "u_end", "text", *labels).dropDuplicates(["unit_id"])
    placed = staged(neighbours(staged(clean)))
    focused = staged(in_context(staged(question_support(span_integrity(question_focus(placed))))))
    focused = didactic_usefulness(focused, F.col("expanded"), plausible(F.col("seed")))
    more = F.array_compact(
        F.array(
            F.when(F.col("expanded"), "question_context_expanded"), F.when(F.col("recovered"), "question_without_terminal_mark_recovered"), F.when(F.col("recomposed"), "split_question_recomposed"),
            F.when(F.col("integrity") < 0, "question_span_integrity_penalty"), F.when(~F.col("focus").contains("?") & (F.size(F.array_intersect("support_reasons", F.array(*[F.lit(x) for x in lx.WEAK_STRUCTURE]))) > 0), "low_autonomy_implicit_question"),
        )
    )
    focused = focused.withColumn("reasons", F.concat("question_reasons", "support_reasons", more))
    asked = staged(focused.filter(F.col("final_question_score") >= LEAST_QUESTION).withColumn("question_id", F.col("unit_id")))
    asks = asked.select("source", "k", F.lit(True).alias("asks"), F.col("preamble").alias("lead"))
    marked = staged(keyed_join(placed, asks, ["source", "k"], "left"))
    local = answer_candidates(asked, marked, o)
    scored = _scored_candidates(asked, local, o)
    best = scored.groupBy("question_id").agg(F.max("answer_score").alias("best_score"))
    scored = staged(scored)
    late = _scored_candidates(asked, deferred_candidates(asked, marked, staged(best)), o)
    ranked = qs.ranked_answers(scored.unionByName(late), ["question_id"], "answer_score", "distance", "gap", "_ord")
    chosen = selected_answers(ranked, ["question_id"])
    echo = echoed_questions(asked.select("source", "question_id", "k", F.col("focus").alias("text")), placed)
    pairs = keyed_join(chosen, echo, ["question_id"], "left")
    nth = grouped_running(asked.select("source", "question_id", "k"), ["source"], ["k"], name="qa_no").select("question_id", "qa_no")
    pairs = keyed_join(pairs, nth, ["question_id"])
    pairs = pairs.withColumn("confidence", qs.pair_confidence(F.col("question_score"), F.col("answer_score"), F.col("competing"), F.lit(False)))
    pairs = pairs.withColumn("reasons", F.array_distinct(F.concat("reasons", F.array_compact(F.array(F.when(F.col("is_echo"), "interview_echo_question"))))))
    pairs = pairs.withColumn("review_flags", review_flags(F.col("reasons"), F.col("confidence"), F.lit(False), F.col("quality").isNull()))
    pairs = staged(pairs)  # read many times over below, and no filter is to be pushed under it
    context = F.when(F.col("expanded"), 0.90).when(F.length("preamble") > 0, 0.68).when(F.col("recomposed"), 0.40).otherwise(0.20)
    pairs = risk_columns(pairs, F.col("reasons"), F.col("review_flags"), F.col("confidence"), context <= 0.20, F.size(lx.rule_tokens(lx.rule_text(F.col("preamble")))).between(1, 2), F.col("part_cues"), F.col("relevance"))
    pairs = staged(pairs)
    base = 0.34 * (0.70 * F.col("question_score") + 0.30 * F.col("didactic_score")) + 0.38 * F.col("answer_score") + 0.16 * context + 0.12 * F.when(F.coalesce("grounded", F.lit(False)), 0.8).otherwise(0.3)
    pairs = pairs.withColumn("base_quality", lx.clamp(base)).withColumn("final_quality", lx.clamp(F.col("base_quality") - 0.45 * F.col("risk_score")))
    anchored = (F.col("shared_keywords") > 0) & (F.col("origin").isin("cluster", "completed") | F.coalesce("is_echo", F.lit(False)) | F.coalesce(F.col("span_reason") == "answer_span_extension_support", F.lit(False)))
    pairs = pairs.withColumn("suppressed_by", gate_reason(F.col("confidence"), F.col("reasons"), F.col("risk_reasons"), F.col("intent"), anchored, o.strict_gate, o.qa_min_confidence))
    pairs = staged(pairs)
    emitted = pairs.filter("suppressed_by is null")
    twins = qs.without_near_duplicates(emitted, "source", "question_id", "question_start", "question_text", "answer_text", "confidence", "review_flags", "reasons")
    twins = twins.filter("not kept").select(F.col("item").alias("question_id"), F.col("replaced_by").alias("duplicate_of"))
    return keyed_join(pairs, twins, ["question_id"], "left").select(
        "session_id", "source", "qa_no", "question_id", "question_text", "answer_text", "origin", "question_start", "answer_start", "answer_end", "question_score", "answer_score", "confidence", "segment_relation",
        "reasons", "review_flags", "risk_reasons", "risk_score", "base_quality", "final_quality", "suppressed_by", "duplicate_of",
    )


_QUESTION = ("session_id", "source", "question_id", "question_text", "focus", "preamble", "intent", "didactic_score", "expanded", "recomposed", "speaker", "quality", "grounded", "reasons")


def _scored_candidates(asked: DataFrame, candidates: DataFrame, o: Options) -> DataFrame:
    """Candidates with their trimmed text, all partial scores, reasons and the clamped sum."""
    q = asked.select(*_QUESTION, F.col("segments").alias("question_segments"), F.col("final_question_score").alias("question_score"), F.col("u_start").alias("question_start"))
    rows = candidates.join(q, "question_id")
    # staged, so that no filter on the trimmed text is pushed below it and trims again
    rows = staged(trimmed_answer(rows, "question_text", "answer_text").withColumn("answer_text", F.col("trimmed")).drop("trimmed"))
    rows = rows.filter(plausible(F.col("answer_text"), o.max_answer_units) | ((F.col("origin") == "same_unit") & (F.size(lx.rule_tokens(lx.rule_text(F.col("answer_text")))) >= 1)))
    rows = rows.withColumn("_rule_text", lx.rule_text(F.col("answer_text")))
    for name, col in noise_columns(F.col("_rule_text")).items():
        rows = rows.withColumn(f"_noise_{name}", F.coalesce(col, F.lit(False)))
    rows = staged(rows)  # the scores below read these many times over
    out = staged(qs.answer_scores(rows, "focus", "answer_text", F.col("gap"), F.col("distance"), F.lit(False), F.lit(False)))
    out = span_completeness(out, "focus", "answer_text", "first_text", "span", o.strict_gate)
    out = out.withColumn("segment_relation", segment_relation(F.col("question_segments"), F.col("answer_segments")))
    out = monologue_risk(out, F.lit(None).cast("string"), F.lit(None).cast("string"), o.strict_gate, F.array_contains("trim_reasons", "answer_meta_opening_trimmed"))
    noise = {c.removeprefix("_noise_"): F.col(c) for c in rows.columns if c.startswith("_noise_")}
    anchor = (F.col("shared_keywords") > 0) | (F.col("shared_numbers") > 0)
    gates = {
        "moderator_handoff_answer_penalty": (noise["hand_off"], -0.22), "answer_boilerplate_penalty": (noise["boilerplate"], -0.26), "answer_poll_or_backchannel_penalty": (noise["backchannel_answer"], -0.34),
        "additive_continuation_answer_penalty": (noise["additive"] & ~anchor, -0.14), "same_sentence_penalty": (F.col("origin") == "same_unit", -0.16), "same_sentence_without_answer_cue": ((F.col("origin") == "same_unit") & (F.col("part_cues") <= 0) & ~anchor, -0.26),
        "answer_echoes_question_penalty": (F.col("part_echo") < 0, 0.0), "answer_circular_echo_penalty": ((F.col("part_echo") >= 0) & (F.col("token_overlap") >= 0.68) & (F.col("new_tokens") <= 2), -0.22),
        "low_information_answer_penalty": (F.col("new_tokens") <= 1, -0.12), "incomplete_answer_span_penalty": (noise["incomplete"], -0.10), "answer_truncated_at_boundary_penalty": (F.col("truncated"), -0.16),
        "surface_answer_cue_penalty": ((F.col("part_cues") > 0) & ~anchor & (F.col("new_tokens") <= 2), -0.18), "deflection_answer_penalty": (noise["deflection"] & ~anchor & (F.col("part_cues") <= 0), -0.42),
        "deferred_answer_too_broad_penalty": ((F.col("origin") == "deferred") & (F.col("answer_tokens") > 80), -0.14), "monologue_continuation_risk": (F.col("part_monologue") < 0, 0.0),
        "answer_responsiveness_weak": (F.col("part_responsive") <= -0.10, 0.0), "answer_responsiveness_followup_prompt": (noise["follow_up_prompt"], -0.22), "low_question_answer_relevance": (F.col("relevance") < 0, 0.0),
        "distant_segment_penalty": (F.col("segment_relation") == "distant_segment", -0.05), "segment_unknown": (F.col("segment_relation") == "segment_unknown", 0.0),
        "quality_local_deferred_penalty": ((F.col("origin") == "deferred") & F.lit(o.strict_gate), -0.10), "competing_question_nearby": (F.col("origin") == "competing_prefix", -0.08), "interview_cluster_answer": (F.col("origin") == "cluster", 0.20),
        "same_segment_support": (F.col("segment_relation") == "same_segment", 0.10), "next_segment_support": (F.col("segment_relation") == "next_segment", 0.05),
    }
    total = F.col("answer_score") + F.col("part_span") + F.col("part_monologue")
    for when, weight in gates.values():
        if weight:
            total = total + F.when(when, weight).otherwise(0.0)
    codes = F.array_compact(F.array(*[F.when(when, code) for code, (when, _) in gates.items()], F.col("span_reason")))
    out = out.withColumn("competing", F.col("origin") == "competing_prefix").withColumn("reasons", F.array_distinct(F.concat("reasons", "trim_reasons", codes))).withColumn("answer_score", lx.clamp(total))
    order = F.create_map(*[F.lit(x) for i, name in enumerate(("same_unit", "local", "completed", "competing_prefix", "cluster", "deferred")) for x in (name, i)])
    return out.withColumn("_ord", F.element_at(order, F.col("origin")) * 100 + F.col("span")).drop("trim_reasons", "question_segments", "answer_segments", "_rule_text", *[c for c in out.columns if c.startswith("_noise_")])
