import json
import random

from turnwise.operators.intervals import periods_and_gaps
from turnwise.operators.ordering import grouped_running, value_bucket
from turnwise.operators.records import field_kinds, flatten_records, nodes_of, parsed
from pyspark.sql import functions as F


def brute(rows):
    by = {}
    for who, s, e in rows:
        if s is None or e is None or s != s or e != e or round(e * 1000) <= round(s * 1000):
            continue
        by.setdefault(who, []).append((round(s * 1000), round(e * 1000)))
    out = set()
    for who, spans in by.items():
        spans.sort()
        a, b = spans[0]
        for s, e in spans[1:]:
            if s > b:
                out |= {(who, "period", a, b), (who, "gap", b, s)}
                a, b = s, e
            else:
                b = max(b, e)
        out.add((who, "period", a, b))
    return out


def test_periods_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), -1.5]) if rng.random() < 0.05 else round(rng.uniform(0, 900), 3), 0.0) for _ in range(400)]
    rows = [(w, s, None if rng.random() < 0.03 else (s or 0) + round(rng.uniform(-0.5, 3), 3)) for w, s, _ in rows]
    rows += rows[:50] + [("c", 1.0, 2.0), ("c", 2.0, 3.0), ("c", 1.2, 1.4), ("d", 5.0, 5.0)]
    df = spark.createDataFrame(rows, "who string, s double, e double").withColumn("entity", F.lit("x")).withColumn("k", F.lit(1)).withColumn("kind", F.lit(2))
    got = [tuple(r) for r in periods_and_gaps(df, "who", "s", "e").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert periods_and_gaps(df.limit(0), "who", "s", "e").count() == 0


def test_running_sum_over_buckets(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, None]), rng.choice([0.0, -1e-9, 1e12, -7.25, rng.uniform(-3, 3)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, v double, i int")
    got = {r["i"]: r["rank"] for r in grouped_running(df, ["g"], ["v", "i"]).collect()}
    for g in (1, 2, None):
        own = sorted((v, i) for h, v, i in rows if h == g)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))


def test_bucket_never_falls(spark):
    values = sorted([0.0, -0.0, 2.0**-1074, 1e308, -1e308, float("inf"), float("-inf")] + [s * 2.0**k * f for s in (1, -1) for k in range(-40, 40, 7) for f in (1, 1.0000000001, 1.5, 1.9999999999)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    keys = [r[0] for r in df.select(value_bucket(F.col("v")).alias("b"), "i").orderBy("i").select("b").collect()]
    assert keys == sorted(keys)


RECORDS = [
    ("r1", json.dumps({"a": [{"x": 1}, None, {"x": {"y": [{"z": 1}]}}], "m": {"n": 1}})),
    ("r2", json.dumps({"a": {"x": "1"}, "b": json.dumps([{"c": 1}])})),
    ("r3", json.dumps(json.dumps({"a": [{"x": 1}]}))),
    ("r4", '{"a": [{"x": 1}, {"x'),
    ("r5", "null"),
    ("r6", ""),
    ("r7", None),
    ("r8", "[[{\"q\": 1}]]"),
    ("r1", json.dumps({"a": [{"x": 1}, None, {"x": {"y": [{"z": 1}]}}], "m": {"n": 1}})),
    (None, '{"a": [{"x": 1}]}'),
]
EXPECTED = {
    ("r1", "a[0]", ""), ("r1", "a[2]", ""), ("r1", "a[2].x.y[0]", "a[2]"), ("r2", "a[0]", ""), ("r2", "b[0]", ""),
    ("r3", "a[0]", ""), ("r8", "[0][0]", ""), (None, "a[0]", ""),
}


def test_flat_records(spark):
    df = spark.createDataFrame(RECORDS, "id string, metadata string").withColumn("text", F.lit(1)).withColumn("node_path", F.lit(2))
    for most in (100, 0):  # names sent to the tasks, or joined
        flat = flatten_records(df, "id", "metadata", list_fields_max=most)
        got = [(r["record_id"], r["node_path"], r["parent_path"]) for r in flat.bridge.filter("is_element").collect()]
        assert len(got) == len(set(got)) and set(got) == EXPECTED
        bodies = {r["node_hash"]: r["occurrences"] for r in flat.objects.collect()}
        assert flat.nodes.count() == sum(bodies.values()) and len(bodies) < flat.nodes.count()
    assert flatten_records(df.limit(0), "id", "metadata").bridge.count() == 0


def test_equal_subtrees_share_a_hash():
    lists = field_kinds(parsed(RECORDS[0][1]))[0]
    a = {n[0]: n for n in nodes_of(parsed('{"a":[{"p":1,"q":{"r":2}},{"q":{"r":2},"p":1}]}'), lists)}
    assert a["a[0]"][6] == a["a[1]"][6] and a["a[0].q"][7] == a["a[0]"][6] and a["a[0]"][7] == a[""][6]
    assert parsed('{"a": [1, 2') is None and parsed("3") is None


def test_deep_and_long_records(spark):
    deep = '{"a":' * 300 + "[{}]" + "}" * 300
    wide = json.dumps({"b": [{"i": i} for i in range(5000)]})
    df = spark.createDataFrame([("d", deep), ("w", wide)], "id string, metadata string")
    got = {r["record_id"]: r["count"] for r in flatten_records(df, "id", "metadata").bridge.filter("is_element").groupBy("record_id").count().collect()}
    assert got == {"d": 1, "w": 5000}
