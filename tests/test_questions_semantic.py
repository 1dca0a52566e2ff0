import random

import numpy as np
from pyspark.sql import functions as F
from turnwise.operators import questions as qs
from turnwise.operators import semantic as sm


def test_question_scores(spark):
    rows = [("a", "What happens if the curve changes?"), ("b", "Right?"), ("c", "That's what we call a wave"), ("d", "Perché la curva cambia?"), ("e", ""), ("f", None), ("g", "x" * 300 + "?"), ("h", "3 or 4?")]
    got = {r["id"]: r for r in qs.question_scores(spark.createDataFrame(rows, "id string, q string"), "q").collect()}
    assert got["a"]["question_kind"] == "conditional" and got["a"]["intent"] == "information_seeking" and got["a"]["question_score"] > 0.75
    assert got["b"]["intent"] == "poll_or_check" and got["h"]["intent"] == "poll_or_check" and got["d"]["question_kind"] == "why"
    assert all(got[i]["question_score"] is None for i in "cefg")


def test_dedupe_streams_like_the_whole(spark):
    rng = random.Random(3)
    words = "curve wave sensor data chapter table lesson filter".split()
    rows, t = [], 0.0
    for i in range(120):
        t += rng.choice([5.0, 20.0, 60.0, 120.0])
        rows.append((rng.choice(["s1", "s2"]), f"i{i:03d}", t, " ".join(rng.sample(words[:4], 3)), " ".join(rng.sample(words[:6], 4)), round(rng.random(), 2), rng.choice([None, ["x"], []])))
    df = spark.createDataFrame(rows, "source string, item string, at double, q string, a string, c double, f array<string>")
    got = {(r["item"], r["kept"], r["replaced_by"]) for r in qs.without_near_duplicates(df, "source", "item", "at", "q", "a", "c", "f").collect()}
    want = set()
    for s in ("s1", "s2"):
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1]))
        part = [(r[0], r[1], r[2], r[3].split(), r[4].split(), r[5], len(r[6]) if r[6] else 0, len(r[4])) for r in own]
        want |= {x[1:] for x in qs._dedupe(iter(part))}
    assert got == want and len(got) == len(rows) and any(not k for _, k, _ in got)


def test_echo_pairs_keep_the_question_that_does_not_echo(spark):
    first, echo = ("How does pressure change the curve?", "sensor filter reduces noise data"), ("Does sensor filter reduces noise?", "sensor filter reduces data chapter")
    after = ("The sensor filter reduces noise. Why?", echo[1])
    cases = {"a": (first, echo, 60.0), "b": (echo, first, 60.0), "c": (first, after, 60.0), "d": (first, echo, 91.0)}
    rows = [(s, s + str(i), [0.0, t][i], *pair, 0.5, None) for s, (*pairs, t) in cases.items() for i, pair in enumerate(pairs)]
    df = spark.createDataFrame(rows, "source string, item string, at double, q string, a string, c double, f array<string>")
    got = {r["item"]: r["replaced_by"] for r in qs.without_near_duplicates(df, "source", "item", "at", "q", "a", "c", "f").collect()}
    assert got == {"a0": None, "a1": "a0", "b0": "b1", "b1": None, "c0": None, "c1": None, "d0": None, "d1": None}


def test_cosine_top_is_exact(spark, monkeypatch):
    monkeypatch.setattr(sm, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(2)
    m = rng.normal(size=(150, 8))
    m[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None)], "vid long, v array<double>")
    queries = df.filter("vid % 20 = 0").withColumnRenamed("vid", "qid")
    got = {}
    for r in sm.cosine_top(queries, df, "qid", "vid", "v", 4).orderBy("qid", "place").collect():
        got.setdefault(r["qid"], []).append(r["vid"])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    u = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    for q in range(0, 150, 20):
        s = u @ u[q]
        s[q] = -9
        assert got[q] == list(np.argsort(-s, kind="stable")[:4])
    assert sm.cosine_top(queries.limit(0), df, "qid", "vid", "v", 4).count() == 0


def test_rescue_is_capped(spark):
    df = spark.createDataFrame([("s", f"{i:03d}", i % 2 == 0) for i in range(60)], "s string, i string, ok boolean")
    out = [r["i"] for r in sm.rescued(df, "s", "i", F.col("ok"), most_checks=30, most_rescues=8).filter("rescued").collect()]
    assert sorted(out) == [f"{i:03d}" for i in range(0, 16, 2)]


def test_only_checked_pairs_use_up_the_checks(spark):
    df = spark.createDataFrame([("s", f"{i:03d}", i >= 50, i >= 52 and i % 2 == 0) for i in range(120)], "s string, i string, soft boolean, ok boolean")
    out = lambda checks: sorted(r["i"] for r in sm.rescued(df, "s", "i", F.col("ok"), most_checks=checks, checked=F.col("soft")).filter("rescued").collect())
    assert out(40) == [f"{i:03d}" for i in range(52, 68, 2)] and out(6) == ["052", "054"]


def test_answer_windows_stop(spark):
    q = spark.createDataFrame([("s", "q1", 0.0, 10.0), ("s", "q2", 21.0, 22.0), ("t", "q3", 0.0, 1.0)], "source string, question_id string, q_start double, q_end double")
    u = spark.createDataFrame([("s", "u1", 2.0, 3.0, "a"), ("s", "u2", 11.0, 12.0, "b"), ("s", "u3", 13.0, 14.0, "c"), ("s", "u4", 23.0, 24.0, "d"), ("s", "u5", 80.0, 81.0, "e"), ("t", "u6", 60.0, 61.0, "f")], "source string, unit_id string, u_start double, u_end double, text string")
    got = {(r["question_id"], r["span"], r["text"]) for r in qs.answer_windows(q, u).collect()}
    assert got == {("q1", 1, "b"), ("q1", 2, "b c"), ("q2", 1, "d")}
