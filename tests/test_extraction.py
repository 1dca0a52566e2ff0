import numpy as np
from pyspark.sql import functions as F
from turnwise.config import options
from turnwise.operators import extraction as ex
from turnwise.operators import semantic as sm

UNITS = "session_id string, source string, unit_id string, u_start double, u_end double, text string, speaker string, segments array<int>, grounded boolean, quality string, merge_safety string, review_priority string, autonomy double, boundary double, continuation double, speaker_status string, margin double"


def units(spark, texts, gap=0.5):
    rows, at = [], 0.0
    for i, t in enumerate(texts):
        rows.append(("s", "a", f"u{i:02d}", at, at + 4, t, None, [0], True, "good", "safe", "low", 0.8, 0.8, 0.1, "stable", 0.7))
        at += 4 + gap
    return spark.createDataFrame(rows, UNITS)


def test_spans_focus_and_trimming(spark):
    df = spark.createDataFrame([("a", "It rains. Hi?! Why is the wave longer? Because the water is cold."), ("b", "no marks"), ("c", "..."), ("d", "La domanda è perché la curva cambia adesso")], "unit_id string, text string")
    spans = {r["unit_id"]: [(s["span"], s["start"], s["end"]) for s in r["s"]] for r in df.select("unit_id", ex.sentence_spans(F.col("text")).alias("s")).collect()}
    assert spans["a"] == [("It rains.", 0, 9), ("Hi?", 9, 13), ("Why is the wave longer?", 14, 38), ("Because the water is cold.", 38, 65)] and spans["b"] == [("no marks", 0, 8)] and spans["c"] == [("...", 0, 3)]
    got = {r["unit_id"]: r for r in ex.span_integrity(ex.question_focus(df)).collect()}
    assert got["a"]["focus"] == "Why is the wave longer?" and got["a"]["preamble"] == "It rains. Hi?!" and got["a"]["seed"] == "Because the water is cold." and got["a"]["integrity"] == 0
    assert got["d"]["focus"].startswith("perché la curva") and got["d"]["integrity"] == 0 and "b" not in got
    cases = [("q", "Well, that's a great question, the wave is longer because of the wind, right?", "the wave is longer because of the wind"), ("q", "Good, right?", "Good, right?"), ("wave", "The wave is long here. Can you hear me? It moves with the cold wind.", "The wave is long here. It moves with the cold wind.")]
    out = ex.trimmed_answer(spark.createDataFrame(cases, "q string, a string, want string"), "q", "a").collect()
    assert all(r["trimmed"] == r["want"] for r in out)


def test_one_call_finds_the_pairs(spark):
    texts = [
        "Today the lecturer explains the waves.", "Why is the red wave longer than the blue wave?", "The red wave is longer because its frequency is lower.", "The sensor is new.",
        "What is the speed of sound in water? The speed of sound in water is about 1500 metres.", "Okay, next topic.", "", "Tell me about the pressure.", "How does the pressure change with depth?", "The pressure grows with depth, because the water above weighs more.",
    ]
    df = units(spark, texts)
    out = {r["question_id"]: r for r in ex.extract_pairs(df.unionByName(df.limit(2)), options("current")).collect()}
    assert out["u01"]["origin"] == "local" and "frequency" in out["u01"]["answer_text"] and out["u01"]["suppressed_by"] is None
    assert out["u04"]["origin"] == "same_unit" and "1500" in out["u04"]["answer_text"]
    assert "water above" in out["u08"]["answer_text"] and out["u08"]["segment_relation"] == "same_segment" and all(0 <= r["confidence"] <= 1 for r in out.values())
    assert [out[k]["qa_no"] for k in sorted(out)] == sorted(out[k]["qa_no"] for k in out)
    assert ex.extract_pairs(df.limit(0), options("current")).count() == 0


def test_clusters_echoes_and_relations(spark):
    texts = ["How does the new pump cool the engine?", "Tell us about it.", "The new pump cools the engine, how?", "The pump moves cold water around the engine block all the time and so takes its heat away."]
    df = units(spark, texts)
    placed = ex.neighbours(df)
    asked = placed.filter("unit_id in ('u00', 'u02')").select("source", F.col("unit_id").alias("question_id"), "k", "text")
    assert {r["question_id"]: r["is_echo"] for r in ex.echoed_questions(asked, placed).collect()} == {"u02": True}
    a = placed.withColumn("asks", F.col("text").contains("?")).withColumn("lead", F.lit(""))
    q = placed.filter("unit_id = 'u00'").withColumn("question_id", F.lit("u00")).withColumn("seed", F.lit(""))
    got = ex.answer_candidates(q, a, options("current")).collect()
    assert any(r["origin"] == "cluster" and r["answer_text"].startswith("The pump moves") for r in got)
    rel = spark.range(1).select(*[ex.segment_relation(F.array(*map(F.lit, x)), F.array(*map(F.lit, y))) for x, y in (([1], [1, 3]), ([1], [2]), ([1], [5]))], ex.segment_relation(F.lit(None).cast("array<int>"), F.array(F.lit(1)))).first()
    assert list(rel) == ["same_segment", "next_segment", "distant_segment", "segment_unknown"]


def test_index_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 24))
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(size=24) * 0.7]) for i in range(3000)] + [(3000, None), (3001, [0.0] * 24)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    q = df.filter("id % 20 = 0").withColumnRenamed("id", "qid")
    pairs = lambda d: {(r["qid"], r["id"]) for r in d.collect()}
    exact, found = pairs(sm.cosine_top(q, df, "qid", "id", "v", 5, 0.0)), pairs(sm.indexed_top(q, df, "qid", "id", "v", 5, 0.0))
    recall = len(exact & found) / len(exact)
    print("recall", recall)
    assert recall >= 0.9
    assert pairs(sm.indexed_top(q, df, "qid", "id", "v", 5, 0.0, lists=9, probes=9)) == exact
    assert sm.indexed_top(q, df.limit(0), "qid", "id", "v", 5).count() == 0


def test_rescue_counts_checks_only(spark):
    rows = [("s", f"q{i:03d}", i % 2 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "s string, q string, ok boolean").withColumn("other", F.lit(1))
    got = {r["q"] for r in sm.rescued(df, "s", "q", F.col("ok")).filter("rescued").collect()}
    assert got == {f"q{i:03d}" for i in range(0, 16, 2)}
    got = sm.rescued(df, "s", "q", F.col("ok") & (F.col("q") >= "q030"), checked=F.lit(True)).filter("rescued").count()
    assert got == 5
