import json

import pytest
from pyspark.sql import functions as F
from turnwise.config import options, snapshot
from turnwise.functions import backends
from turnwise.sources import outputs, scans
from turnwise.streaming import sessions


def test_scans(spark, tmp_path):
    for name in ("b.mp4", "A.WAV", "c.txt", "a_manifest.json"):
        (tmp_path / name).write_text("x")
    got = {r["path"].rsplit("/", 1)[1]: r["media_type"] for r in scans.list_media(spark, str(tmp_path)).collect()}
    assert got == {"b.mp4": "video", "A.WAV": "audio", "c.txt": "unsupported"}
    df = spark.createDataFrame([("s", "in/b.mp4"), ("s", "in/A.WAV"), ("s", None)], "session string, path string")
    assert [(r["source_id"], r["media_type"]) for r in scans.session_sources(df, "session", "path").orderBy("source_id").collect()] == [("source_001", "audio"), ("source_002", "video")]
    assert scans.session_name(df.filter("path is not null"), "session", "path").first()["session_name"] == "A_2files"


def test_chunks_and_languages(spark):
    rows = [("s", 0, -1.0, 2.0, " hi ", None), ("s", 1, 2.0, 3.0, " ", "en"), ("s", 2, 5.0, 4.0, "yo", "de"), ("s", 3, None, None, "x", "de")]
    df = spark.createDataFrame(rows, "src string, n int, a double, b double, t string, lang string").withColumn("sl", F.lit("it"))
    got = [tuple(r) for r in scans.recognised_chunks(df, "src", "n", "a", "b", "t", "lang", "sl").orderBy("chunk_id").collect()]
    assert got == [("s", "s_chunk_0001", 0.0, 2.0, "hi", "it"), ("s", "s_chunk_0003", 5.0, 5.0, "yo", "de"), ("s", "s_chunk_0004", 0.0, 0.0, "x", "de")]
    assert scans.majority_language(df, "src", "lang").first()["majority_language"] == "de"


def test_plain_texts_and_runs(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.txt").write_text("hello\nworld")
    (tmp_path / "t" / "two.txt").write_text("  ")
    d = spark.createDataFrame([("one", 12.5)], "name string, duration_seconds double")
    assert [tuple(r) for r in scans.plain_transcripts(spark, str(tmp_path / "t"), d).collect()] == [("one", "one_chunk_0001", 0.0, 12.5, "hello\nworld")]
    for run, text in (("r1", '{"a": 1}'), ("r2", '{"a": ')):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "metrics.json").write_text(text)
    got = {r["run"]: (r["metrics"], r["error"]) for r in scans.evaluation_runs(spark, str(tmp_path / "runs")).collect()}
    assert got == {"r1": ('{"a": 1}', None), "r2": (None, "invalid_json")}


def test_outputs(spark, tmp_path):
    src = spark.createDataFrame([("s", "a", None, 3.0)], "session_id string, audio_source_id string, original_path string, duration_seconds double")
    u = spark.createDataFrame([("a", f"u{i}", "t", float(i), i + 1.0, None) for i in range(7)], "audio_source_id string, utterance_id string, text string, start_seconds double, end_seconds double, speaker_id string")
    docs = outputs.session_json(src, u, part_rows=3)
    parts = [json.loads(r["document"]) for r in docs.orderBy("part_no").collect()]
    assert [x["utterance_id"] for p in parts for x in p["utterances"]] == [f"u{i}" for i in range(7)] and "original_path" not in parts[0] and len(parts) == 3
    outputs.write_session_json(docs, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 3
    outputs.write_tables({"one": u}, str(tmp_path / "tables"))
    with pytest.raises(Exception):
        outputs.write_tables({"one": u}, str(tmp_path / "tables"))
    (tmp_path / "run").mkdir()
    assert outputs.run_folder(spark, str(tmp_path), "run").endswith("run_2") and outputs.run_folder(spark, str(tmp_path), "new").endswith("new")
    same, hit = outputs.cached(u, lambda d: d.filter("start_seconds > 2"), str(tmp_path / "cache"), "stage", {"x": 1})
    again, hit2 = outputs.cached(u.orderBy(F.desc("utterance_id")), lambda d: d, str(tmp_path / "cache"), "stage", {"x": 1})
    other, hit3 = outputs.cached(u, lambda d: d, str(tmp_path / "cache"), "stage", {"x": 2})
    assert (hit, hit2, hit3) == (False, True, False) and same.count() == again.count() == 4 and other.count() == 7
    timing = spark.createDataFrame([(0, "load", "executed", 1.0)], "ordinal int, stage_name string, status string, duration_seconds double")
    qa = spark.createDataFrame([("q1", "Why?", "So.")], "qa_candidate_id string, question_text string, answer_text string")
    assert "| load | executed | 1.00 |" in outputs.packet_lines("Run", {"n": 1}, timing, qa) and "**A** So." in outputs.packet_lines("Run", {}, timing, qa)


def test_options():
    assert options("quality_local").strict_gate and options("full", segmentation_mode="windowed").segmentation_mode == "windowed" and snapshot(options())["semantic_top_k"] == 4
    assert options(segmentation_max_gap_seconds=9.0).segmentation_soft_max_gap_seconds == 9.0 and options(max_answer_units=-3).max_answer_units == 0
    for bad in (lambda: options("none"), lambda: options(nothing=1)):
        with pytest.raises(KeyError):
            bad()
    with pytest.raises(ValueError):
        options(segmentation_mode="x")


class Backend:
    def __init__(self, up=True):
        self.up = up

    def available(self):
        return self.up

    def embed(self, texts):
        return [[float(len(t)), 1.0] for t in texts]

    def score(self, pairs):
        return [1.0 if a == b else 0.0 for a, b in pairs]

    def split(self, text, language):
        return text.split(". ")


def test_backends(spark):
    df = spark.createDataFrame([("ab", "ab"), ("ab", "c"), (None, "c")], "a string, b string")
    assert [r["embedding"] for r in backends.embedded(df, "a", Backend()).orderBy("a").collect()] == [None, [2.0, 1.0], [2.0, 1.0]]
    assert backends.embedded(df, "a", Backend(False)).select("fallback_reason").distinct().collect()[0][0] == "embedding_backend_unavailable"
    assert sorted(r["semantic_score"] for r in backends.pair_scored(df, "a", "b", Backend()).collect()) == [0.0, 0.0, 1.0]
    assert backends.pair_scored(df, "a", "b", None).first()["fallback_reason"] == "reranker_unavailable"
    backends.register_splitter(spark, "split_sentences_with", Backend())
    assert [tuple(r) for r in spark.sql("select * from split_sentences_with('One. Two', 'en')").collect()] == [(0, "One"), (1, "Two")]
    assert backends.first_available(("x", False, None), ("y", True, len))[0] == "y"
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [None if r[0] is None else round(r[0], 6) for r in v.select(backends.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, None]


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(u, f"2025-01-01 {h:02d}:00:00", 1.0 * h) for u in ("a", "b") for h in (0, 1, 2, 9, 10, 20)] + [("a", "2025-01-09 00:00:00", 0.0), ("b", "2025-01-09 00:00:00", 0.0)]
    df = spark.createDataFrame(rows, "user string, t string, value double").select("user", F.to_timestamp("t").alias("ts"), "value")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(make, mode, name):
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    batch = {tuple(r) for r in sessions.gap_sessions(df, "user", "ts", "3 hours", "1 hour").collect() if r["last"].day == 1}
    stream = {tuple(r) for r in run(lambda s: sessions.gap_sessions(s, "user", "ts", "3 hours", "1 hour"), "append", "gaps").collect()}
    assert stream == batch and len(batch) == 6  # the last rows only move the watermark on
    counts = lambda s: sessions.window_counts(s, "user", "ts", "6 hours", None, "1 hour")
    assert {tuple(r) for r in run(counts, "append", "wins").collect()} == {tuple(r) for r in counts(df).collect() if r["window_start"].day == 1}
    totals = {r["user"]: (r["rows"], r["total"]) for r in run(lambda s: sessions.running_totals(s, "user", "value"), "update", "totals").collect()}
    assert totals == {"a": (7, 42.0), "b": (7, 42.0)}
    assert sessions.distinct_by_id(df.withColumn("id", F.col("user")), "id", "ts", "1 hour").count() == 2


def test_comparison(spark, tmp_path):
    import pytest
    from turnwise.operators.evaluation import rankings

    runs = spark.createDataFrame([("b", 12.5, None), ("a", 3.0, 2)], "run_id string, seconds double, pairs int")
    placed = rankings(runs, "run_id", {"seconds": False, "pairs": True})
    outputs.write_comparison("Runs", runs, placed, str(tmp_path / "cmp"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "cmp/markdown")).collect())
    assert text.startswith("# Runs") and "| b | 12.500 |  |" in text and "1. a (3.000)" in text and "2. b (12.500)" in text and text.count("1. a") == 2
    assert spark.read.json(str(tmp_path / "cmp/runs")).count() == 2 and spark.read.json(str(tmp_path / "cmp/rankings")).count() == 3
    with pytest.raises(ValueError):
        outputs.comparison_markdown("x", runs, placed, limit=1)


def test_sentence_question_rows(spark):
    from turnwise.operators.metrics import sentence_question_rows, summary_rows

    sentences = spark.createDataFrame([("s", "u1", 0.0, 5.0), ("s", "u2", 5.0, 9.0), ("s", "u3", None, 2.0)], "source string, unit_id string, u_start double, u_end double")
    pairs = spark.createDataFrame([("s", "q1", 1.0, 0.9), ("s", "q2", 2.0, 0.5), ("s", "q3", 4.999, 0.1), ("s", "q4", 9.0, 0.2), ("t", "q5", 1.0, 0.3), ("s", "q6", None, 0.3)], "source string, qa_id string, at double, confidence double")
    got = {r["unit_id"]: r for r in sentence_question_rows(sentences, pairs, 60.0).collect()}
    assert got["u1"]["qa_count"] == 3 and got["u1"]["qa_ids"] == ["q1", "q2"] and abs(got["u1"]["best_confidence"] - 0.9) < 1e-9
    assert got["u2"]["qa_count"] == got["u3"]["qa_count"] == 0 and got["u2"]["qa_ids"] == []
    rows = {(r["section"], r["metric"]): (r["value"], r["value2"]) for r in summary_rows({"pairs": (pairs, {"count": (None, None), "confidence": ("confidence", None)})}).collect()}
    assert rows == {("pairs", "count"): (6.0, None), ("pairs", "confidence"): (0.9, 0.1)} or rows[("pairs", "count")][0] == 6.0
