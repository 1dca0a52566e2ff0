import random

from pyspark.sql import functions as F
from turnwise.operators import segments as sg
from turnwise.operators import sentences as se

WORDS = "the curve limits a very different result, because when pressure is low. So we see it. Ma allora la curva cambia!".split()


def units(rng, n):
    out, t = [], 0.0
    for i in range(n):
        t += rng.choice([0.0, 0.2, 0.4, 2.5, 5.0, 9.0])
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 14)))
        out.append((rng.choice(["s1", "s1", "s2"]), f"u{i:03d}", round(t, 3), round(t + rng.uniform(0.1, 12), 3), text))
        t = out[-1][3] - rng.choice([0, 0, 1])
    return out


def test_structural_folds_agree_with_one_pass(spark):
    rows = units(random.Random(1), 300)
    df = spark.createDataFrame(rows + [("s1", "x", None, 1.0, "no time"), ("s1", "y", 1.0, 2.0, "  ")], "audio_source_id string, unit_id string, start_seconds double, end_seconds double, text string")
    got = {(r["source"], r["first_unit"], r["last_unit"], r["units"]) for r in sg.segment_units(df, "structural").collect()}
    want = set()
    for source in ("s1", "s2"):
        own = sorted((r for r in rows if r[0] == source), key=lambda r: (r[2], r[3], r[1]))
        want |= {(source, s[0][1], s[-1][1], len(s)) for s, _ in sg.structural(own)}
    assert got == want
    assert sg.segment_units(df.limit(0), "structural").count() == 0
    for mode in ("windowed", "adaptive"):
        covered = sum(r["units"] for r in sg.segment_units(df, mode).collect())
        assert covered == len(rows)  # windows without overlap take each unit once


def brute_windows(u):
    out, i = [], 0
    while i < len(u):
        j = next((j for j in range(i + 1, len(u)) if u[j][2] >= u[i][2] + sg.WINDOW_SECONDS), len(u))
        out.append(u[i:j])
        i = j
    return out


def brute_adaptive(u):
    out, i = [], 0
    while i < len(u):
        end = len(u) - 1
        for j in range(i, len(u)):
            seconds, length = u[j][3] - u[i][2], len(" ".join(x[4] for x in u[i : j + 1]))
            if seconds >= sg.TARGET_SECONDS or length >= sg.TARGET_TEXT:
                scores = {e: sg.boundary_score(" ".join(x[4] for x in u[i : e + 1]), u[e], u[e + 1] if e + 1 < len(u) else None) for e in range(max(i, j - sg.LOOKBACK + 1), j + 1)}
                best = max(scores, key=lambda e: (scores[e], e))
                if scores[best] >= sg.LEAST_SCORE or seconds >= sg.LIMIT_SECONDS or length >= sg.LIMIT_TEXT:
                    end = best
                    break
        out.append(u[i : end + 1])
        i = end + 1
    return out


def test_windows_and_adaptive_segments_run_on_over_silences(spark):
    rows = units(random.Random(4), 300)
    df = spark.createDataFrame(rows, "audio_source_id string, unit_id string, start_seconds double, end_seconds double, text string")
    for mode, brute in (("windowed", brute_windows), ("adaptive", brute_adaptive)):
        want = [(s, k, seg[0][1], seg[-1][1], len(seg)) for s in ("s1", "s2") for k, seg in enumerate(brute(sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[3], r[1]))))]
        got = [(r["source"], r["segment_no"], r["first_unit"], r["last_unit"], r["units"]) for r in sg.segment_units(df, mode).collect()]
        assert sorted(got) == want


def test_silences_close_structural_segments_as_in_one_pass(spark):
    rows = units(random.Random(5), 300) + [("s3", "a", 0.0, 1.0, "One clear sentence about waves."), ("s3", "b", 40.0, 95.0, "One more sentence about waves."), ("s3", "c", 110.0, 111.0, "x" * 700), ("s3", "d", 120.0, 121.0, "y" * 120)]
    df = spark.createDataFrame(rows, "audio_source_id string, unit_id string, start_seconds double, end_seconds double, text string")
    want = [(s, k, seg[0][1], seg[-1][1], reason) for s in ("s1", "s2", "s3") for k, (seg, reason) in enumerate(sg.structural(sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[3], r[1]))))]
    got = [(r["source"], r["segment_no"], r["first_unit"], r["last_unit"], r["closing_reason"]) for r in sg.segment_units(df, "structural").collect()]
    assert sorted(got) == want and [w[4] for w in want[-4:]] == ["max_duration", "gap", "max_text_length", "end"]


def test_modes_by_hand():
    u = [("s", str(i), i * 10.0, i * 10.0 + 9, "One clear sentence about waves.") for i in range(20)]
    assert [len(s) for s, _ in sg.windows(u)] == [6, 6, 6, 2]
    assert [len(s) for s, _ in sg.windows(u, overlap=30.0)][:3] == [6, 6, 6]
    cut = list(sg.structural(u))
    assert all(s[-1][3] - s[0][2] <= sg.MAX_SECONDS for s, _ in cut) and cut[0][1] in ("max_duration", "gap") and cut[-1][1] == "end"
    assert all(reason in ("adaptive_boundary", "end") for _, reason in sg.adaptive(u)) and sum(len(s) for s, _ in sg.adaptive(u)) == 20
    assert sg.continues("we saw that the", "curve changes") and not sg.continues("We saw it all there.", "curve changes")


def test_weak_singletons_join_their_neighbours():
    weak, full = ("s", "w", 0.0, 1.0, "Hm."), ("s", "f", 2.0, 3.0, "One clear sentence about waves.")
    names = lambda segs: ["".join(u[1] for u in s) for s, _ in sg.without_weak_singletons(segs)]
    assert names([([weak], "gap"), ([full, full], "gap"), ([weak], "gap"), ([full], "end")]) == ["wffw", "f"]
    assert names([([weak], "end")]) == ["w"] and names([]) == [] and names([([weak], "gap"), ([weak], "end")]) == ["ww"]


def test_snapping(spark):
    def brute(ends, targets):
        out, taken = [], -1
        for t in targets[:-1]:
            free = [(abs(e - t), i) for i, e in enumerate(ends) if i > taken]
            if free:
                taken = min(free)[1]
                out.append(taken)
        return [i for i in out if i < len(ends) - 1] + ([len(ends) - 1] if ends else [])

    rng = random.Random(6)
    cases = [(sorted(rng.sample(range(100), rng.randrange(0, 7))), sorted(rng.sample(range(100), rng.randrange(1, 6)))) for _ in range(60)]
    df = spark.createDataFrame([(i, e, t) for i, (e, t) in enumerate(cases)], "i int, ends array<int>, targets array<int>")
    for r in df.select("i", se.snapped_boundaries(F.col("ends"), F.col("targets")).alias("got")).collect():
        assert r["got"] == brute(*cases[r["i"]])


def said(text, start, end, speaker="A", uncertain=False):
    return {"text": text, "start": start, "end": end, "speaker": speaker, "uncertain": uncertain}


def test_refinement():
    us = [said("The curve", 0, 1), said("changes the shape of the waves.", 1, 3), said("And", 3.1, 3.4), said("the pressure is low today.", 3.5, 5), said("Yes.", 5.2, 5.5, "B")]
    spans = se.refined_sentences(us)
    assert spans[0] == (0, 4) and spans[-1][1] == 5 and [b for _, b in spans[:-1]] == [a for a, _ in spans[1:]]
    long = [said(f"word {i} goes on and on again, with more words here.", i * 4.0, i * 4.0 + 3) for i in range(6)]
    assert all(b - a < 6 for a, b in se.refined_sentences(long)) and se.refined_sentences([said("hm", 0, 1)]) == [(0, 1)]


def test_reconstruction_keeps_every_utterance(spark):
    rng = random.Random(2)
    rows = [("s", i, f"u{i:03d}", " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 9))), i * 2.0 + 3 * (i // 7), i * 2.0 + 1.5 + 3 * (i // 7), rng.choice(["A", "B", None]), rng.random() < 0.3) for i in range(90)]
    df = spark.createDataFrame(rows, "source string, place int, utterance_id string, text string, start double, end double, speaker string, uncertain boolean")
    grouped = se.utterance_groups(df, "source", ["start", "utterance_id"], "start", "end", "speaker", "uncertain")
    out = se.reconstruct_sentences(grouped).orderBy("group_no", "sentence_no").collect()
    assert [u for r in out for u in r["utterance_ids"]] == [r[2] for r in rows]
