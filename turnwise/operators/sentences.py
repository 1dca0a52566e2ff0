"""Sentences from utterances: grouping, splitting, quality labels, speakers and provenance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnwise.functions import lexical as lx
from turnwise.operators.joins import keyed_join
from turnwise.operators.ordering import windowed

GROUP_GAP = 2.5
#: Limits of merged sentences and marks of run-on ones.
MAX_WORDS, MAX_SECONDS = 30, 15.0
RUN_ON_WORDS, RUN_ON_SECONDS = 24, 12.0
SPLIT_SCORE = 1.0


def utterance_groups(df: DataFrame, source: str, order: Sequence[str], start: str, end: str, speaker: str, uncertain: str) -> DataFrame:
    """Adds `group_no`: a new group after a silence over GROUP_GAP or at a change between two certain speakers."""
    known = F.when(F.col(speaker).isNotNull() & ~F.coalesce(F.col(uncertain), F.lit(False)), F.col(speaker))
    seen = windowed(df.withColumn("_known", known), [source], order, {"_prev": ("lag", F.struct(F.col(end).alias("e"), F.col("_known").alias("k")))})
    breaks = F.col("_prev").isNull() | (F.col(start) - F.col("_prev.e") > GROUP_GAP) | (F.col("_known") != F.col("_prev.k"))
    marked = seen.withColumn("_break", F.coalesce(breaks, F.lit(False)).cast("bigint")).drop("_prev", "_known")
    return windowed(marked, [source], order, {"group_no": ("sum", F.col("_break"))}).drop("_break")


def fallback_pieces(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, piece_no, piece, piece_end): the text split at white space behind `. ! ? ; :`, with the end offset of each
    piece in the text whose white space is single blanks."""
    flat = F.trim(F.regexp_replace(F.col(text), r"\s+", " "))
    pieces = F.split(F.regexp_replace(flat, r"([.!?;:]) ", "$1\u0001"), "\u0001")
    rows = df.select(F.col(key), F.posexplode(F.filter(pieces, lambda p: p != "")).alias("piece_no", "piece"))
    before = F.sum(F.length("piece") + 1).over(Window.partitionBy(key).orderBy("piece_no").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("piece_end", (before - 1).cast("int"))


def snapped_boundaries(ends: Column, targets: Column) -> Column:
    """Index of the utterance end that each wanted boundary snaps to.

    The nearest end behind the one taken before, the earlier of two equally near ones; the last boundary is the last
    end. A boundary for which no end is left is dropped.
    """
    n = F.size(ends)
    numbered = F.transform(ends, lambda e, i: F.struct(i.alias("i"), e.alias("e")))

    def step(acc: Column, target: Column) -> Column:
        taken = F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(-1)
        free = F.filter(numbered, lambda x: x["i"] > taken)
        near = F.array_min(F.transform(free, lambda x: F.struct(F.abs(x["e"] - target).alias("d"), x["i"].alias("i"))))
        return F.when(F.size(free) > 0, F.concat(acc, F.array(near["i"]))).otherwise(acc)

    inner = F.aggregate(F.slice(targets, 1, F.greatest(F.size(targets) - 1, F.lit(0))), F.array().cast("array<int>"), step)
    last = (n - 1).cast("int")
    return F.when(n > 0, F.concat(F.filter(inner, lambda i: i < last), F.array(last))).otherwise(F.array().cast("array<int>"))


def quality_columns(df: DataFrame, text: str, seconds: Column) -> DataFrame:
    """Adds word count, fragment and run-on signals, the semantic label and the buckets of length and duration."""
    t = F.col(text)
    out = df.withColumn("words", lx.word_count(t)).withColumn("seconds", seconds)
    out = out.withColumn("starts_incomplete", lx.first_word(t).isin(*lx.INCOMPLETE_MARKERS)).withColumn("ends_incomplete", lx.last_word(t).isin(*lx.INCOMPLETE_MARKERS))
    out = out.withColumn("strong_end", lx.ends_strongly(t))
    few = F.col("words") <= 3
    clauses = F.size(F.regexp_extract_all(t, F.lit("[,;:]"), F.lit(0)))
    run_on = (F.col("words") >= RUN_ON_WORDS) | F.coalesce(F.col("seconds") >= RUN_ON_SECONDS, F.lit(False)) | (clauses >= 2)
    short = few | (F.length(t) <= 20) | F.coalesce(F.col("seconds") <= 2, F.lit(False)) | F.col("starts_incomplete") | F.col("ends_incomplete") | ~F.col("strong_end")
    label = F.when(F.col("starts_incomplete") | F.col("ends_incomplete") | (few & ~F.col("strong_end")), "fragment").when(run_on, "run_on").when(short, "borderline").otherwise("good")
    out = out.withColumn("clauses", clauses).withColumn("quality", label)
    out = out.withColumn("length_bucket", F.when(few, "short").when(F.col("words") >= RUN_ON_WORDS, "long").otherwise("medium"))
    return out.withColumn("duration_bucket", F.when(F.col("seconds") <= 2, "short").when(F.col("seconds") >= RUN_ON_SECONDS, "long").when(F.col("seconds").isNotNull(), "medium"))


def cleanup_scores(df: DataFrame) -> DataFrame:
    """Adds autonomy, boundary confidence and continuation risk to rows of `quality_columns`."""
    q = F.col("quality")

    def add(base: float, *terms: tuple[Column, float]) -> Column:
        total: Column = F.lit(base)
        for when, weight in terms:
            total = total + F.when(when, weight).otherwise(0.0)
        return lx.clamp(total)

    frag, run, border = q == "fragment", q == "run_on", q == "borderline"
    si, ei, weak = F.col("starts_incomplete"), F.col("ends_incomplete"), ~F.col("strong_end")
    multi = F.col("clauses") >= 2
    usual = (F.col("words") >= 4) & (F.col("words") <= 23)
    return (
        df.withColumn("autonomy", add(0.78, (frag, -0.34), (run, -0.22), (border, -0.12), (si, -0.14), (usual, 0.06)))
        .withColumn("boundary", add(0.76, (frag, -0.18), (run, -0.24), (border, -0.10), (ei, -0.18), (weak, -0.16), (multi, -0.10), (~weak, 0.08)))
        .withColumn("continuation", add(0.08, (frag, 0.24), (run, 0.20), (border, 0.10), (si, 0.16), (ei, 0.14), (weak, 0.08), (multi, 0.08)))
    )


def speaker_evidence(utterances: DataFrame, sentence: str, speaker: str, uncertain: str, start: str, end: str, text: str, order: Sequence[str]) -> DataFrame:
    """Per sentence: weight, share and margin of the strongest speakers, the noise of the unassigned, and the decision.

    A contribution is 1 (certain), .65 (uncertain) or .5 (unassigned), plus .35 by duration and .25 by words, halved
    for short fragments; the closing utterance counts a little more.
    """
    words, seconds = lx.word_count(F.col(text)), F.greatest(F.col(end) - F.col(start), F.lit(0.0))
    unsure = F.coalesce(F.col(uncertain), F.lit(False))
    base = F.when(F.col(speaker).isNull(), 0.5).when(unsure, 0.65).otherwise(1.0)
    weight = base + 0.35 * F.least(seconds, F.lit(1.0)) + 0.25 * F.least(words / 4, F.lit(1.0))
    weight = weight * F.when((seconds <= 0.45) | (words <= 2), 0.5).otherwise(1.0)
    closing = F.row_number().over(Window.partitionBy(sentence).orderBy(*[F.col(o).desc() for o in order])) == 1
    rows = utterances.withColumn("_w", weight * F.when(closing, 1.08).otherwise(1.0)).withColumn("_d", seconds).withColumn("_n", words).withColumn("_u", unsure)
    each = rows.groupBy(sentence, speaker).agg(F.sum("_w").alias("w"), F.sum(F.when(~F.col("_u"), F.col("_w")).otherwise(0.0)).alias("stable"), F.sum("_d").alias("d"), F.sum("_n").alias("n"))
    named = each.filter(F.col(speaker).isNotNull())
    place = F.row_number().over(Window.partitionBy(sentence).orderBy(F.round("w", 9).desc(), F.round("stable", 9).desc(), F.round("d", 9).desc(), F.col("n").desc(), F.col(speaker).desc()))
    ranked = named.withColumn("p", place)
    at = lambda c, p: F.max(F.when(F.col("p") == p, F.col(c)))
    best = ranked.groupBy(sentence).agg(at(speaker, 1).alias("top"), at("w", 1).alias("w1"), at("w", 2).alias("w2"), at("stable", 1).alias("stable1"), F.sum("w").alias("all_w"))
    noise = each.groupBy(sentence).agg(F.sum(F.when(F.col(speaker).isNull(), F.col("w")).otherwise(0.0)).alias("noise"))
    both = keyed_join(noise, best, [sentence], "left")
    both = both.withColumn("share", F.coalesce(F.col("w1") / F.col("all_w"), F.lit(0.0))).withColumn("second_share", F.coalesce(F.col("w2") / F.col("all_w"), F.lit(0.0)))
    both = both.withColumn("margin", F.coalesce((F.col("w1") - F.coalesce("w2", F.lit(0.0))) / F.col("w1"), F.lit(0.0)))
    unstable = F.col("w1") - F.col("stable1")
    clear = (F.col("share") >= 0.58) & (F.col("margin") >= 0.45) & ((F.col("w1") > F.col("noise")) | (F.col("stable1") > unstable)) & ~((F.col("stable1") <= 0) & (F.col("noise") >= 0.75 * F.col("w1")))
    sure = F.when(F.col("second_share") == 0, "stable").when((F.col("share") >= 0.66) & (F.col("stable1") >= unstable), "mostly_stable").otherwise("uncertain")
    sure = F.when(F.col("stable1") < unstable, "uncertain").otherwise(sure)
    status = F.when(F.col("w1").isNotNull() & clear, sure).when(F.col("second_share") >= 0.33, "mixed").otherwise("unassigned")
    out = both.withColumn("speaker_status", status).withColumn("sentence_speaker", F.when(F.col("speaker_status").isin("stable", "mostly_stable", "uncertain"), F.col("top")))
    return out.select(sentence, "sentence_speaker", "speaker_status", "share", "second_share", "margin", "noise")


def recovered_speakers(sentences: DataFrame, source: str, order: Sequence[str], start: str, end: str, words: str) -> DataFrame:
    """Adds `recovered_speaker`: an unassigned short sentence takes the speaker of a near, stable neighbour.

    Both neighbours that qualify must agree. Recovered sentences are no neighbours for others, so one pass is exact.
    """
    near = F.struct(F.when(F.col("speaker_status").isin("stable", "mostly_stable"), F.col("sentence_speaker")).alias("who"), F.col(start).alias("s"), F.col(end).alias("e"))
    rows = windowed(sentences, [source], order, {"_prev": ("lag", near), "_next": ("lead", near)})
    left = F.when(F.col(start) - F.col("_prev.e") <= 1.0, F.col("_prev.who"))
    right = F.when(F.col("_next.s") - F.col(end) <= 1.0, F.col("_next.who"))
    small = (F.col("speaker_status") == "unassigned") & (F.col(end) - F.col(start) <= 2.25) & (F.col(words) <= 6) & (F.col("second_share") <= 0.2)
    agreed = F.when(left.isNotNull() & right.isNotNull(), F.when(left == right, left)).otherwise(F.coalesce(left, right))
    return rows.withColumn("recovered_speaker", F.when(small, agreed)).drop("_prev", "_next")


def review_labels(df: DataFrame, quality: str, status: str, has_change: Column, has_uncertain: Column, has_unassigned: Column) -> DataFrame:
    """Adds merge safety, confidence label, flags and priority."""
    q, s = F.col(quality), F.col(status)
    risky = (s == "mixed") | has_change | (q == "fragment") & (s == "unassigned")
    safety = F.when(risky, "risky").when(has_uncertain | has_unassigned | q.isin("fragment", "run_on") | s.isin("uncertain", "unassigned"), "borderline").otherwise("safe")
    flags = F.array_compact(
        F.array(
            F.when(q != "good", F.concat(F.lit("semantic_"), q)), F.when(risky, "merge_risky"), F.when(has_uncertain, "uncertain_source"),
            F.when(has_unassigned, "unassigned_source"), F.when(has_change, "speaker_change_inside"),
        )
    )
    priority = F.when((s == "mixed") | risky, "high").when((safety == "borderline") | (q != "good"), "medium").otherwise("low")
    level = F.when(s == "stable", "high").when(s == "mostly_stable", "medium").otherwise("low")
    return df.withColumn("merge_safety", safety).withColumn("speaker_confidence", level).withColumn("review_flags", flags).withColumn("review_priority", priority)


def provenance_report(utterances: DataFrame, links: DataFrame, source: str, utterance: str, sentence: str) -> DataFrame:
    """Per source: utterances, sentences, and anomalies of the links between them.

    Unmapped utterances, utterances in several sentences, repeated links, and links to unknown utterances.
    """
    base = utterances.select(source, utterance).distinct()
    uses = links.groupBy(source, utterance).agg(F.countDistinct(sentence).alias("sentences"), (F.count(F.lit(1)) - F.countDistinct(sentence)).alias("repeats"))
    both = base.withColumn("known", F.lit(1)).join(uses, [source, utterance], "full_outer")
    tally = lambda c: F.count(F.when(c, 1))
    report = both.groupBy(source).agg(
        F.count("known").alias("utterances"), tally(F.col("sentences").isNull()).alias("unmapped"), tally(F.col("known").isNotNull() & (F.col("sentences") > 1)).alias("multi_assigned"),
        F.coalesce(F.sum("repeats"), F.lit(0)).alias("repeated_links"), tally(F.col("known").isNull()).alias("unknown"), F.max("sentences").alias("most_sentences"),
    )
    return report.withColumn("anomalies", F.col("unmapped") + F.col("multi_assigned") + F.col("repeated_links") + F.col("unknown"))


def _incomplete(text: str) -> tuple[bool, bool, bool]:
    words = ["".join(c for c in w if c.isalnum()).lower() for w in text.split()]
    words = [w for w in words if w]
    strong = text.rstrip(" '\"”»)]")[-1:] in (".", "!", "?")
    return (bool(words) and words[0] in lx.INCOMPLETE_MARKERS, bool(words) and words[-1] in lx.INCOMPLETE_MARKERS, strong)


class _Span:
    """A stretch of consecutive utterances [a, b)."""

    def __init__(self, us: list[dict], a: int, b: int) -> None:
        self.a, self.b = a, b
        self.text = " ".join(u["text"] for u in us[a:b])
        self.words = len(self.text.split())
        self.seconds = (us[b - 1]["end"] or 0.0) - (us[a]["start"] or 0.0)
        self.opens_mid, self.ends_mid, self.strong = _incomplete(self.text)
        self.fragment = self.opens_mid or self.ends_mid or (self.words <= 3 and not self.strong)


def _changes(us: list[dict], i: int) -> bool:
    a, b = us[i - 1], us[i]
    return bool(a["speaker"] and b["speaker"] and a["speaker"] != b["speaker"] and not a["uncertain"] and not b["uncertain"])


def merged_spans(us: list[dict], cuts: Sequence[int]) -> list[tuple[int, int]]:
    """Spans between cuts, merged where a piece is no sentence of its own, until nothing changes."""
    spans = [_Span(us, a, b) for a, b in zip([0, *cuts], [*cuts, len(us)]) if b > a]
    k = 0
    while k < len(spans):
        here = spans[k]

        def joined(x: _Span, y: _Span) -> _Span | None:
            both = _Span(us, x.a, y.b)
            return None if _changes(us, y.a) or both.words > MAX_WORDS or both.seconds > MAX_SECONDS else both

        ahead = joined(here, spans[k + 1]) if k + 1 < len(spans) and (here.fragment or here.ends_mid) else None
        behind = joined(spans[k - 1], here) if ahead is None and k and (here.fragment or here.opens_mid) else None
        if ahead is not None:
            spans[k : k + 2] = [ahead]
        elif behind is not None:
            spans[k - 1 : k + 1] = [behind]
            k -= 1
        else:
            k += 1
    return [(s.a, s.b) for s in spans]


def split_span(us: list[dict], a: int, b: int) -> list[tuple[int, int]]:
    """A run-on span divided at its best inner boundary, and its parts again; as it is if none is good enough."""
    todo, out = [(a, b)], []
    while todo:
        a, b = todo.pop()
        whole = _Span(us, a, b)
        best = None
        if whole.words >= RUN_ON_WORDS or whole.seconds >= RUN_ON_SECONDS or sum(whole.text.count(c) for c in ",;:") >= 2:
            for i in range(a + 1, b):
                left, right = _Span(us, a, i), _Span(us, i, b)
                gap = (us[i]["start"] or 0.0) - (us[i - 1]["end"] or 0.0)
                first = right.text.split()[:1]
                opens = bool(first) and first[0].strip(",.;:!?").lower() in lx.TRANSITION_MARKERS
                score = (3 if left.strong else 1.25 if left.text.rstrip()[-1:] in (",", ";", ":") else 0) + (2 if gap >= 0.75 else 1 if gap >= 0.35 else 0)
                score += opens - 1.5 * right.opens_mid - 2 * left.ends_mid - 0.5 * _changes(us, i)
                if score >= SPLIT_SCORE and not left.fragment and not right.fragment and (best is None or score > best[0]):
                    best = (score, i)
        if best is None:
            out.append((a, b))
        else:
            todo += [(best[1], b), (a, best[1])]
    return out


def refined_sentences(us: list[dict]) -> list[tuple[int, int]]:
    """Sentence spans of one group of utterances: merge fragments, split run-ons, merge again."""
    spans = merged_spans(us, [i for i in range(1, len(us)) if _incomplete(us[i - 1]["text"])[2]])
    parts = [p for a, b in spans for p in split_span(us, a, b)]
    return merged_spans(us, [a for a, _ in parts[1:]])


_SENTENCES = pa.schema([("source", pa.string()), ("sentence_no", pa.int32()), ("group_no", pa.int64()), ("text", pa.string()), ("start_seconds", pa.float64()), ("end_seconds", pa.float64()), ("utterance_ids", pa.list_(pa.string()))])


def reconstruct_sentences(groups: DataFrame) -> DataFrame:
    """(source, group_no, sentence_no, text, start_seconds, end_seconds, utterance_ids) of grouped utterances.

    `groups` has (source, group_no, place, utterance_id, text, start, end, speaker, uncertain). A group ends at the
    first longer silence or certain change of speaker, so it is of bounded size and is worked on as one row.
    """
    packed = groups.groupBy("source", "group_no").agg(F.array_sort(F.collect_list(F.struct("place", "utterance_id", "text", "start", "end", "speaker", "uncertain"))).alias("us"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                us = r["us"]
                for k, (a, e) in enumerate(refined_sentences(us)):
                    rows.append((r["source"], k, r["group_no"], " ".join(u["text"] for u in us[a:e]), us[a]["start"], us[e - 1]["end"], [u["utterance_id"] for u in us[a:e]]))
            cols = list(zip(*rows)) if rows else [[]] * len(_SENTENCES)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SENTENCES)], schema=_SENTENCES)

    return packed.mapInArrow(run, "source string, sentence_no int, group_no bigint, text string, start_seconds double, end_seconds double, utterance_ids array<string>")
