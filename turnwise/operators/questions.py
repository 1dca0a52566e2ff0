"""Questions, answers and their pairs: scores, windows, ranking, quality gates and near-duplicates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import lexical as lx
from turnwise.operators.joins import keyed_join
from turnwise.operators.ordering import grouped_running, windowed

#: Units after a question that may answer it, and limits of the silence before and of the whole answer.
ANSWER_UNITS, ANSWER_GAP, ANSWER_SECONDS = 3, 45.0, 45.0
#: Units after a question in which its keywords are looked for again.
RECUR_FROM, RECUR_TO = 4, 31
NEAR_SECONDS = 90.0
MAX_QUESTION = 220
CONFIDENCE_HIGH, CONFIDENCE_MEDIUM = 0.75, 0.45

# Short utterances that only ask for assent, alternatives put to a vote, and auxiliary verbs.
CHECK_IN = r"^(?:right|vero|correct|ok|okay|yes|no|eh)\??$"
POLL = r"^(?:\d+(?:\s+(?:or|o)\s+\d+)+|(?:one|two|three|four|five|uno|due|tre|quattro|cinque)(?:\s+(?:or|o)\s+(?:one|two|three|four|five|uno|due|tre|quattro|cinque))+)\??$"
TAG = r"^.+?[,;]?\s+(?:right|vero|correct|ok|okay|yes|no|eh)\?$"
AUXILIARIES = "am are can could did do does had has have is must should was were will would c'e c'era esiste esistono puo puoi possiamo".split()
ANAPHORIC = r"^(?:(?:is|was|were) that true|(?:does|did|do|can|could|would|will|has|have|had) it\b.*|really|why|what about that|it must\b.*right)\??$"


def question_scores(df: DataFrame, text: str) -> DataFrame:
    """Adds rule text, cues, intent, type, score and confidence label of a question.

    Empty and overlong texts, declarative ones without a question mark and texts without any sign of a question have a
    null score.
    """
    t = F.trim(F.col(text))
    out = df.withColumn("rule", lx.rule_text(t)).withColumn("question_tokens", F.size(lx.rule_tokens(F.col("rule"))))
    rule, tokens = F.col("rule"), F.col("question_tokens")
    # every step is a column of its own, so that later ones name it instead of repeating its expression
    bare = F.trim(F.regexp_replace(F.regexp_replace(rule, r"^(?:(?:allora|cioe|e|ma|ok)[,;:]* ){0,2}", ""), r"[ ?.!]+$", ""))
    start = lambda c: F.regexp_extract(c, r"^([a-z0-9_']+)", 1)
    stem = lambda c: F.regexp_extract(c, r"^([a-z0-9_]+)", 1)
    heads = [*lx.INTERROGATIVES, *AUXILIARIES]
    steps = {
        "_mark": t.contains("?"), "_bare": bare, "_opens": start(rule).isin(*lx.INTERROGATIVES) | stem(rule).isin(*lx.INTERROGATIVES),
        "_cues": lx.cue_weight(rule, lx.QUESTION_CUES, 0.36), "_didactic": lx.cue_weight(rule, lx.DIDACTIC_CUES, 0.30), "_check": rule.rlike(CHECK_IN), "_poll": rule.rlike(POLL), "_tagged": rule.rlike(TAG),
        "_declarative": rule.rlike("|".join(f"(?:{p})" for p in lx.DECLARATIVE_WHAT)), "is_contextual": (tokens <= 2) | rule.rlike(ANAPHORIC),
        "_head": start(F.col("_bare")).isin(*heads) | stem(F.col("_bare")).isin(*heads),
        "_cue_at": F.array_min(F.filter(F.transform(lx.rule_tokens(F.col("_bare")), lambda w, i: F.when(w.isin(*heads), i)), lambda i: i.isNotNull())),
    }
    for name, col in steps.items():
        out = out.withColumn(name, col)
    mark, head, opens, cues, didactic, check, poll = (F.col(c) for c in ("_mark", "_head", "_opens", "_cues", "_didactic", "_check", "_poll"))
    plain = mark & (cues == 0) & (didactic == 0)
    out = out.withColumn("_tag", plain & F.col("_tagged") & (tokens > 3)).withColumn("_fragment", plain & (tokens <= 2) & ~check)
    intent = (
        F.when(poll | check, "poll_or_check").when(F.col("_tag"), "rhetorical_tag").when(F.col("_fragment"), "fragment").when((F.col("_cue_at") >= 3) & ~head, "embedded_statement_question")
        .when(mark & ~head & (didactic == 0), "weak_question_form").otherwise("information_seeking")
    )
    out = out.withColumn("intent", intent)
    delta = F.when(F.col("intent").isin("poll_or_check", "rhetorical_tag"), -0.18).when(F.col("intent") == "fragment", -0.16).when(F.col("intent") == "embedded_statement_question", -0.12)
    delta = delta.when(F.col("intent") == "weak_question_form", -0.10).otherwise(0.0) + F.when((tokens <= 3) & ~head, -0.08).otherwise(0.0)
    rejected = (t == "") | (F.length(t) > MAX_QUESTION) | (~mark & (F.col("_declarative") | ((cues == 0) & (didactic == 0))))
    length = F.when((tokens >= 3) & (tokens <= 24), 0.08).when(tokens < 2, -0.25).otherwise(0.0)
    score = (
        F.when(mark, 0.40).otherwise(0.0) + cues + didactic + F.when(opens, 0.12).otherwise(0.0) + F.when(~mark, 0.10).otherwise(0.0) + length
        + F.when(check, -0.28).otherwise(0.0) + F.when(poll, -0.42).otherwise(0.0) + F.when(F.col("_tag"), -0.30).otherwise(0.0) + F.when(F.col("_fragment"), -0.22).otherwise(0.0)
        + F.when(~mark & ~opens, -0.18).otherwise(0.0) + delta
    )
    kind = F.coalesce(lx.cue_label(rule, lx.DIDACTIC_CUES), lx.cue_label(rule, lx.QUESTION_CUES), F.when(mark, "direct_question"), F.lit("generic_question"))
    intents = {"poll_or_check": "poll_or_check", "rhetorical_tag": "rhetorical_tag", "fragment": "fragment", "embedded_statement_question": "embedded_statement", "weak_question_form": "weak_form"}
    reasons = [F.when(mark, "question_mark"), F.when(~mark, "implicit_question_cue"), F.when(check, "rhetorical_checkin_question"), F.when(poll, "rhetorical_poll_question"), F.when(F.col("_tag"), "declarative_tag_question")]
    reasons += [F.when(F.col("_fragment"), "fragment_question"), F.when(~mark & ~opens, "implicit_declarative_question_penalty"), F.when(head, "question_intent_autonomous_head"), F.when(didactic > 0, "question_intent_didactic_cue")]
    reasons += [F.when(F.col("intent") == name, f"question_intent_{code}") for name, code in intents.items()]
    out = out.withColumn("question_reasons", F.array_compact(F.array(*reasons))).withColumn("is_head", head)
    out = out.withColumn("question_kind", kind).withColumn("question_score", F.when(~rejected, lx.clamp(score))).drop(*[c for c in (*steps, "_tag", "_fragment") if c != "is_contextual"])
    return out.withColumn("question_band", F.when(F.col("question_score") >= CONFIDENCE_HIGH, "high").when(F.col("question_score") >= CONFIDENCE_MEDIUM, "medium").otherwise("low"))


def alignment_columns(df: DataFrame, question: str, answer: str) -> DataFrame:
    """Adds shared keywords and numbers of question and answer, their overlap ratio and the alignment signal."""
    out = df.withColumn("_qr", lx.rule_text(F.col(question))).withColumn("_ar", lx.rule_text(F.col(answer)))
    q, a = F.col("_qr"), F.col("_ar")
    out = out.withColumn("_q", lx.content_tokens(q)).withColumn("_a", lx.content_tokens(a)).withColumn("_an", lx.number_tokens(a)).withColumn("_qn", lx.number_tokens(q))
    shared = F.size(F.array_intersect("_q", "_a"))
    quantity = q.rlike(r"\b(?:how many|how much|quanto|quanti|quanta|quante)\b")
    out = out.withColumn("shared_keywords", shared).withColumn("shared_numbers", F.size(F.array_intersect("_qn", "_an"))).withColumn("token_overlap", lx.overlap_ratio(F.col("_q"), F.col("_a")))
    numbers = F.when(F.col("shared_numbers") > 0, 0.12).when(quantity & (F.size("_an") > 0), 0.10).otherwise(0.0)
    why = q.rlike(r"\b(?:why|perche)\b")
    relevance = F.when((F.col("shared_keywords") > 0) | (F.col("shared_numbers") > 0), 0.10).when(quantity, -0.28).when(why, 0.0).otherwise(-0.16)
    signal = lx.clamp(F.lit(0.04) + F.least(F.lit(0.15), 0.05 * F.col("shared_keywords")) + numbers + F.greatest(F.lit(0.0), relevance))
    return out.withColumn("new_tokens", F.size(F.array_except("_a", "_q"))).withColumn("relevance", relevance).withColumn("alignment", signal).drop("_q", "_a", "_an", "_qn", "_qr", "_ar")


def answer_scores(df: DataFrame, question: str, answer: str, gap: Column, distance: Column, different_voice: Column, same_voice: Column) -> DataFrame:
    """Adds the partial scores of an answer and their clamped sum.

    The parts: a start, distance in units, cues, alignment, responsiveness, length, silence before the answer,
    questions in the answer, a span that breaks off, and the voices.
    """
    out = alignment_columns(df, question, answer)
    out = out.withColumn("_rule", lx.rule_text(F.col(answer))).withColumn("answer_tokens", F.size(lx.rule_tokens(F.col("_rule")))).withColumn("_cues", lx.cue_weight(F.col("_rule"), lx.ANSWER_CUES, 1.0))
    tokens, cues = F.col("answer_tokens"), F.col("_cues")
    asks = F.col(answer).contains("?")
    near = F.when(distance <= 0, 0.28).when(distance == 1, 0.20).when(distance == 2, 0.12).otherwise(0.06)
    fresh = F.when(F.col("new_tokens") >= 3, 0.04).when(F.col("new_tokens") <= 1, -0.10).otherwise(0.0)
    anchored = F.when((F.col("shared_keywords") > 0) | (F.col("shared_numbers") > 0), 0.07).when(cues > 0, -0.08).otherwise(-0.14)
    respond = F.greatest(F.lit(-0.24), F.least(F.lit(0.06), fresh + anchored + F.when(tokens < 3, -0.10).otherwise(0.0)))
    silence = F.when(gap <= 4, 0.12).when(gap <= 10, 0.06).when(gap.isNull(), 0.0).otherwise(-0.08)
    broken = F.when(lx.last_word(F.col(answer)).isin(*lx.INCOMPLETE_MARKERS) | ~lx.ends_strongly(F.col(answer)), -0.10).otherwise(0.0)
    echo = F.when((F.col("token_overlap") >= 0.72) & (F.col("new_tokens") <= 1), -0.28).otherwise(0.0)
    voice = F.when(different_voice, 0.10).when(same_voice, -0.04).otherwise(0.0)
    parts = {
        "start": F.lit(0.18), "distance": near, "cues": F.least(F.lit(0.30), cues), "aligned": F.col("alignment"), "responsive": respond,
        "length": F.when((tokens >= 3) & (tokens <= 80), 0.08).otherwise(0.0), "silence": silence, "asks": F.when(asks, -0.20).otherwise(0.0), "broken": broken, "echo": echo, "voice": voice,
    }
    total: Column = F.lit(0.0)
    for name, col in parts.items():
        out = out.withColumn(f"part_{name}", F.coalesce(col, F.lit(0.0)))
        total = total + F.col(f"part_{name}")
    return out.drop("_rule", "_cues").withColumn("answer_score", F.when(F.col(answer).isNotNull(), lx.clamp(total)))


def pair_confidence(question_score: Column, answer_score: Column, competing: Column, asks: Column) -> Column:
    """Confidence of a pair, from both scores."""
    return lx.clamp(0.55 * F.coalesce(question_score, F.lit(0.0)) + 0.45 * F.coalesce(answer_score, F.lit(0.0)) - F.when(competing, 0.10).otherwise(0.0) - F.when(asks, 0.24).otherwise(0.0))


def answer_windows(questions: DataFrame, units: DataFrame) -> DataFrame:
    """(question_id, span, first_unit, last_unit, gap, seconds, text): growing spans of the units that follow a question.

    `questions` has (source, question_id, q_start, q_end), `units` (source, unit_id, u_start, u_end, text). A span
    ends before another question begins, before a silence or a total over the limits, and after ANSWER_UNITS units.
    Positions are exact ranks: questions and units are put into one order, which tells each question how many units
    began before its end, and the next positions are joined by equality.
    """
    placed = grouped_running(units, ["source"], ["u_start", "u_end", "unit_id"], name="k")
    nexts = windowed(questions, ["source"], ["q_start", "question_id"], {"next_q": ("lead", F.col("q_start"))})
    line = units.select("source", F.col("u_start").alias("t"), F.lit(0).alias("is_q"), F.lit(None).cast("string").alias("question_id"), F.lit(1).alias("one"))
    line = line.unionByName(questions.select("source", F.col("q_end").alias("t"), F.lit(-1).alias("is_q"), "question_id", F.lit(0).alias("one")))
    at = windowed(line, ["source"], ["t", "is_q", "question_id"], {"before": ("sum", F.col("one"))}).filter("is_q = -1").select("question_id", "before")
    wanted = nexts.join(at, "question_id").withColumn("step", F.explode(F.array(*[F.lit(i) for i in range(1, ANSWER_UNITS + 1)])))
    wanted = wanted.withColumn("k", F.col("before") + F.col("step"))
    rows = wanted.join(placed, ["source", "k"])
    grow = Window.partitionBy("question_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    stop = (F.col("u_start") >= F.coalesce("next_q", F.lit(float("inf")))) | (F.col("u_start") - F.col("q_end") > ANSWER_GAP) | (F.col("u_end") - F.min("u_start").over(grow) > ANSWER_SECONDS)
    rows = rows.withColumn("stopped", F.max(stop.cast("int")).over(grow)).filter("stopped = 0")
    return rows.select(
        "question_id", F.col("step").alias("span"), F.first("unit_id").over(grow).alias("first_unit"), F.col("unit_id").alias("last_unit"), (F.min("u_start").over(grow) - F.col("q_end")).alias("gap"),
        (F.max("u_end").over(grow) - F.min("u_start").over(grow)).alias("seconds"), F.array_join(F.collect_list("text").over(grow), " ").alias("text"),
    )


def keyword_recurrence(questions: DataFrame, units: DataFrame) -> DataFrame:
    """(question_id, hits, units, nearest): content words of a question that come back RECUR_FROM to RECUR_TO units later.

    `questions` has (source, question_id, k, text), `units` (source, k, text), k being positions in one order. Words
    are joined by (source, word, block of positions), so that a frequent word in a long source meets two blocks only.
    """
    size = RECUR_TO - RECUR_FROM + 1
    words = lambda d: d.withColumn("word", F.explode(lx.content_tokens(lx.rule_text(F.col("text")))))
    first = F.floor((F.col("k") + RECUR_FROM) / size)
    q = words(questions).select("source", "question_id", F.col("k").alias("qk"), "word", F.explode(F.array(first, first + 1)).alias("block"))
    u = words(units).select("source", "k", "word", F.floor(F.col("k") / size).alias("block"))
    met = q.join(u, ["source", "word", "block"]).filter((F.col("k") - F.col("qk")).between(RECUR_FROM, RECUR_TO))
    return met.groupBy("question_id").agg(F.countDistinct("word").alias("hits"), F.countDistinct("k").alias("units"), F.min(F.col("k") - F.col("qk")).alias("nearest"))


def ranked_answers(df: DataFrame, group: list[str], score: str, distance: str, gap: str, ordinal: str) -> DataFrame:
    """Adds `place`: best score first (to nine digits, so that noise of summation decides nothing), then nearer,
    earlier, and as inserted."""
    order = Window.partitionBy(*group).orderBy(F.round(F.col(score), 9).desc_nulls_last(), F.col(distance), F.col(gap).asc_nulls_last(), F.col(ordinal))
    return df.withColumn("place", F.row_number().over(order))


def reranked(df: DataFrame, group: list[str], rule_score: str, semantic: str, ordinal: str, top: int = 8) -> DataFrame:
    """Adds `final_score` and `final_place`: the best few mix the semantic score in, others keep the rule score.

    Where no semantic score is there at all, the order of the rule scores stays and `fallback` says so.
    """
    first = F.row_number().over(Window.partitionBy(*group).orderBy(F.col(rule_score).desc_nulls_last(), F.col(ordinal)))
    mixed = F.when((F.col("_first") <= top) & F.col(semantic).isNotNull(), 0.7 * F.col(semantic) + 0.3 * F.col(rule_score)).otherwise(F.col(rule_score))
    out = df.withColumn("_first", first).withColumn("final_score", mixed).withColumn("fallback", F.when(F.max(semantic).over(Window.partitionBy(*group)).isNull(), "semantic_unavailable"))
    last = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("final_score").desc_nulls_last(), F.col(ordinal)))
    return out.withColumn("final_place", last).drop("_first")


def context_units(questions: DataFrame, units: DataFrame, before: int = 2) -> DataFrame:
    """(question_id, context_score, unit_id, place): the units just before a question that share words with it.

    The score adds topic overlap, a shared number and a plausible length; the two best are kept, in time order.
    """
    placed = grouped_running(units, ["source"], ["u_start", "u_end", "unit_id"], name="k")
    wanted = questions.withColumn("k", F.explode(F.array(*[F.col("qk") - i for i in range(before)])))
    rows = wanted.join(placed.withColumnRenamed("text", "unit_text"), ["source", "k"])
    q, u = lx.rule_text(F.col("text")), lx.rule_text(F.col("unit_text"))
    shared = F.size(F.array_intersect(lx.content_tokens(q), lx.content_tokens(u)))
    number = F.when(F.size(F.array_intersect(lx.number_tokens(q), lx.number_tokens(u))) > 0, 0.16).otherwise(0.0)
    tokens = F.size(lx.rule_tokens(u))
    score = lx.clamp(0.05 + F.least(F.lit(0.30), 0.08 * shared) + number + F.when((tokens >= 4) & (tokens <= 40), 0.08).otherwise(0.0))
    best = Window.partitionBy("question_id").orderBy(F.col("context_score").desc(), F.col("k"))
    return rows.withColumn("context_score", score).withColumn("place", F.row_number().over(best)).filter("place <= 2").select("question_id", "unit_id", "context_score", "place")


# Risk weights of review flags.
RISK_WEIGHTS = {"possible_echo": 0.28, "weak_boundary": 0.16, "long_answer": 0.08, "low_confidence": 0.22}
_KNOWN_REASONS = 8


def quality_features(df: DataFrame, question: Column, answer: Column, context: Column, grounding: Column, flags: str) -> DataFrame:
    """Adds base, risk and final quality of a pair and their bands; the listed reasons are cut after scoring."""
    weights = F.create_map(*[F.lit(x) for kv in RISK_WEIGHTS.items() for x in kv])
    names = F.coalesce(F.col(flags), F.array().cast("array<string>"))
    risk = lx.clamp(F.aggregate(names, F.lit(0.0), lambda s, f: s + F.coalesce(F.element_at(weights, f), F.lit(0.05))))
    base = 0.34 * F.coalesce(question, F.lit(0.0)) + 0.38 * F.coalesce(answer, F.lit(0.0)) + 0.16 * context + 0.12 * grounding
    out = df.withColumn("risk_score", risk).withColumn("base_quality", lx.clamp(base)).withColumn("risk_reasons", F.slice(F.array_sort(names), 1, _KNOWN_REASONS))
    out = out.withColumn("final_quality", lx.clamp(F.col("base_quality") - 0.45 * F.col("risk_score")))
    band = F.when(F.col("final_quality") >= 0.74, "high").when(F.col("final_quality") >= 0.50, "medium").otherwise("low")
    return out.withColumn("quality_band", band).withColumn("risk_band", F.when(F.col("risk_score") >= 0.55, "high").when(F.col("risk_score") >= 0.25, "medium").otherwise("low"))


def quality_gate(df: DataFrame, confidence: Column, rules: list[tuple[Column, str]], least: float = 0.40) -> DataFrame:
    """Adds `emitted` and `suppressed_by`: the first rule that holds suppresses the pair."""
    reason = F.when(F.coalesce(confidence, F.lit(0.0)) < least, "below_min_confidence")
    for when, name in rules:
        reason = reason.when(when, name)
    return df.withColumn("suppressed_by", reason).withColumn("emitted", reason.isNull())


def near_duplicate_pairs(df: DataFrame, source: str, item: str, at: str, question: str, answer: str) -> DataFrame:
    """(source, left, right, question_overlap, answer_overlap): pairs within NEAR_SECONDS that say much the same.

    Items are joined by (source, block of time) with the block and its neighbour, so only near ones meet.
    """
    toks = lambda c: lx.content_tokens(lx.rule_text(F.col(c)))
    rows = df.filter(F.col(at).isNotNull()).select(F.col(source).alias("source"), F.col(item).alias("item"), F.col(at).alias("at"), toks(question).alias("q"), toks(answer).alias("a")).withColumn("block", F.floor(F.col("at") / NEAR_SECONDS))
    left = rows.select("source", F.col("item").alias("left"), F.col("at").alias("lat"), F.col("q").alias("lq"), F.col("a").alias("la"), F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("block"))
    both = left.join(rows, ["source", "block"]).filter(((F.col("at") > F.col("lat")) | ((F.col("at") == F.col("lat")) & (F.col("item") > F.col("left")))) & (F.col("at") - F.col("lat") <= NEAR_SECONDS))
    both = both.withColumn("question_overlap", lx.overlap_ratio(F.col("lq"), F.col("q"))).withColumn("answer_overlap", lx.overlap_ratio(F.coalesce("la", F.array().cast("array<string>")), F.coalesce("a", F.array().cast("array<string>"))))
    same = ((F.col("question_overlap") >= 0.72) & (F.col("answer_overlap") >= 0.50)) | ((F.col("question_overlap") >= 0.86) & (F.col("answer_overlap") >= 0.35))
    return both.filter(same).select("source", "left", F.col("item").alias("right"), "question_overlap", "answer_overlap")


_KEPT = pa.schema([("source", pa.string()), ("item", pa.string()), ("kept", pa.bool_()), ("replaced_by", pa.string())])


def _ratio(a: list[str] | None, b: list[str] | None) -> float:
    x, y = set(a or ()), set(b or ())
    return len(x & y) / min(len(x), len(y)) if x and y else 0.0


def _dedupe(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Decisions over rows (source, item, at, q, a, confidence, flags, length, follow-up, noise) in order.

    A row that makes an echo pair with the last kept one (answers alike, one question in the other's answer) is settled
    first: the one whose question echoes less stays. Of near-duplicates the better stays (confidence, fewer flags,
    longer). The one that stays takes the place of the first; the last two fields may be missing.
    """
    kept: list[tuple] = []
    for r in rows:
        near = lambda k: r[2] - k[2] <= NEAR_SECONDS  # noqa: B023, E731
        for k in kept[:-1]:
            if not near(k):
                yield k[0], k[1], True, None
        kept = [k for k in kept[:-1] if near(k)] + kept[-1:]
        twin, wins = None, False
        if kept and near(kept[-1]) and not any(x[8:9] == (True,) for x in (r, kept[-1])) and _ratio(r[4], kept[-1][4]) >= 0.45:
            old = kept[-1]
            new_echo, old_echo = _ratio(r[3], old[4]), _ratio(old[3], r[4])
            if max(new_echo, old_echo) >= 0.55:
                worth = lambda x: (-(x[9] if len(x) > 9 else 0), x[5] or 0.0, x[7] or 0)
                twin, wins = len(kept) - 1, new_echo < old_echo if abs(new_echo - old_echo) >= 0.05 else worth(r) >= worth(old)
        if twin is None:
            twin = next((i for i in reversed(range(len(kept))) if near(k := kept[i]) and (q := _ratio(k[3], r[3])) >= 0.72 and ((a := _ratio(k[4], r[4])) >= 0.50 or (q >= 0.86 and a >= 0.35))), None)
            wins = twin is not None and (r[5] or 0.0, -(r[6] or 0), r[7] or 0) > (kept[twin][5] or 0.0, -(kept[twin][6] or 0), kept[twin][7] or 0)
        if twin is None:
            kept.append(r)
        elif wins:
            old, kept[twin] = kept[twin], r
            yield old[0], old[1], False, r[1]
        else:
            yield r[0], r[1], False, kept[twin][1]
    for k in kept:
        yield k[0], k[1], True, None


def followed_up(question: Column) -> Column:
    """Whether a question is context plus a short question of its own."""
    spans = F.filter(F.transform(F.regexp_extract_all(question, F.lit(r"[^.?!]+[.?!]?"), F.lit(0)), F.trim), lambda x: x != "")
    last = F.element_at(spans, -1)
    rule = lx.rule_text(last)
    bare = F.regexp_replace(rule, r"^(?:(?:allora|cioe|e|ma|ok)[,;:]* ){0,2}", "")
    head = F.regexp_extract(bare, r"^([a-z0-9_]+)", 1).isin(*lx.INTERROGATIVES, *AUXILIARIES) | F.regexp_extract(bare, r"^([a-z0-9_']+)", 1).isin(*lx.INTERROGATIVES, *AUXILIARIES)
    head = head | bare.rlike(r"\b(?:che|cosa|what)[ ?.!]*$") & (F.size(lx.rule_tokens(bare)) >= 2) | bare.rlike(r"^(?:(?:can|could|would) you (?:tell|explain|describe|show)|(?:puoi|potresti|puo) (?:spiegare|spiegarci|spiegarmi|dire|dirci))\b")
    return F.coalesce((F.size(spans) >= 2) & last.endswith("?") & (F.size(lx.rule_tokens(rule)) <= 4) & head, F.lit(False))


def without_near_duplicates(df: DataFrame, source: str, item: str, at: str, question: str, answer: str, confidence: str, flags: str, reasons: str | None = None) -> DataFrame:
    """(source, item, kept, replaced_by): one pass in time order over every stretch of a source.

    A silence over NEAR_SECONDS between questions parts a source into stretches that cannot affect each other; they are
    folded in parallel, streaming through sorted partitions with only the last NEAR_SECONDS in memory.
    """
    toks = lambda c: lx.content_tokens(lx.rule_text(F.col(c)))
    none = F.array().cast("array<string>")
    named = F.concat(F.coalesce(F.col(flags), none), F.coalesce(F.col(reasons), none) if reasons else none)
    noise = F.size(F.filter(named, lambda x: x.rlike("backchannel|boilerplate|truncated|incomplete|thin_answer|answer_poll")))
    rows = df.filter(F.col(at).isNotNull()).select(
        F.col(source).alias("source"), F.col(item).alias("item"), F.col(at).alias("at"), toks(question).alias("q"), toks(answer).alias("a"), F.col(confidence).alias("c"),
        F.coalesce(F.size(flags), F.lit(0)).alias("f"), F.size(lx.rule_tokens(lx.rule_text(F.col(answer)))).alias("n"), followed_up(F.col(question)).alias("u"), noise.alias("z"),
    )
    seen = windowed(rows, ["source"], ["at", "item"], {"_prev": ("lag", F.col("at"))})
    far = (F.col("_prev").isNull() | (F.col("at") - F.col("_prev") > NEAR_SECONDS)).cast("bigint")
    cut = windowed(seen.withColumn("_far", far), ["source"], ["at", "item"], {"stretch": ("sum", F.col("_far"))}).drop("_prev", "_far")
    sorted_ = cut.repartition("source", "stretch").sortWithinPartitions("source", "stretch", "at", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []
        for _, part in groupby(rows, key=lambda r: (r[0], r[10])):
            out += _dedupe(iter(part))
            if len(out) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _KEPT)], schema=_KEPT)
                out = []
        cols = list(zip(*out)) if out else [[]] * len(_KEPT)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _KEPT)], schema=_KEPT)

    picked = sorted_.select("source", "item", "at", "q", "a", "c", "f", "n", "u", "z", "stretch")
    return picked.mapInArrow(run, "source string, item string, kept boolean, replaced_by string")


def coverage(units: DataFrame, candidates: DataFrame, key: str, text: str, reason: str) -> DataFrame:
    """Per session: units, interrogative ones by first word, candidates, emitted ones and the ratio; suppressions as JSON."""
    asked = lx.first_word(F.col(text)).isin(*lx.INTERROGATIVES) | F.col(text).contains("?")
    base = units.groupBy(key).agg(F.count(F.lit(1)).alias("units"), F.count(F.when(asked, 1)).alias("interrogative_units"))
    found = candidates.groupBy(key).agg(F.count(F.lit(1)).alias("candidates"), F.count(F.when(F.col(reason).isNull(), 1)).alias("emitted"))
    both = keyed_join(base, found, [key], "left")
    for c in ("candidates", "emitted"):
        both = both.withColumn(c, F.coalesce(c, F.lit(0)))
    return both.withColumn("coverage_ratio", F.when(F.col("candidates") > 0, F.col("emitted") / F.col("candidates")))
