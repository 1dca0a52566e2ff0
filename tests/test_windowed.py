import random

from pyspark.sql import functions as F
from turnwise.operators.ordering import windowed


def test_windowed_matches_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.0, 1.5, rng.uniform(0, 5000)]), i, rng.choice([None, rng.randrange(9)])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, t double, i int, v int")
    kinds = ["sum", "sum_before", "max", "max_before", "last_before", "lag", "lead"]
    got = {r["i"]: r for r in windowed(df, ["g"], ["t", "i"], {f"w_{k}": (k, F.col("v")) for k in kinds}).collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        values = [r[3] for r in own]
        for n, r in enumerate(own):
            known = [v for v in values[:n] if v is not None]
            upto = [v for v in values[: n + 1] if v is not None]
            want = [sum(upto), sum(known), max(upto, default=None), max(known, default=None), known[-1] if known else None, values[n - 1] if n else None, values[n + 1] if n + 1 < len(own) else None]
            assert [got[r[2]][f"w_{k}"] for k in kinds] == want


def test_hot_groups_values_and_nulls_are_divided(spark, monkeypatch):
    """A third of the rows each in one value, one null group and one group: the same results, and no part of the order
    that a task would hold has more than a small share of the rows."""
    from turnwise.operators import ordering
    from turnwise.operators.ordering import grouped_running

    monkeypatch.setattr(ordering, "LOOK_FROM", 0)
    rng = random.Random(3)
    rows = [(rng.choice(["a", None, f"g{i % 50}"]), rng.choice([0.0, 0.0, rng.uniform(0, 90)]), f"id{i:05d}") for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, t double, i string").repartition(8)
    cut = df.withColumn("b", ordering.value_bucket(F.col("t")))
    parts = ordering.divided_buckets(cut, ["g"], "b", ["t", "i"], 300).groupBy("g", "b", "_ord_part").count().agg(F.max("count")).first()[0]
    assert cut.groupBy("g", "b").count().agg(F.max("count")).first()[0] > 1000 and parts <= 450
    got = {r["i"]: r for r in grouped_running(df, ["g"], ["t", "i"], hot_rows=300).collect()}
    win = {r["i"]: r for r in windowed(df, ["g"], ["t", "i"], {"w": ("lag", F.col("i")), "x": ("lead", F.col("i")), "m": ("max_before", F.col("i"))}, hot_rows=300).collect()}
    assert len(got) == len(win) == 6000
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        ids = [r[2] for r in own]
        for n, i in enumerate(ids):
            assert got[i]["rank"] == n + 1 and win[i]["w"] == (ids[n - 1] if n else None) and win[i]["x"] == (ids[n + 1] if n + 1 < len(ids) else None)
            assert win[i]["m"] == (max(ids[:n]) if n else None)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    import pytest
    from turnwise import session

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_staged_files_end_with_their_block(spark):
    import os

    from turnwise.session import shared_dir, staged, staging

    with staging():
        df = staged(spark.range(5))
        path = df.inputFiles()[0].replace("file://", "")
        assert os.path.exists(path) and shared_dir(spark) and df.count() == 5
    assert not os.path.exists(path)
