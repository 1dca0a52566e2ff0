import random

import numpy as np
from turnwise.llm.ranking import best_of, combined_ranking


def brute(rows):
    """Ranking of {item: (group, a, b, c)} with directions 1, 1, -1."""
    z = {}
    for g in {r[0] for r in rows.values()}:
        for j in range(3):
            own = {i: r[1 + j] for i, r in rows.items() if r[0] == g and r[1 + j] is not None and r[1 + j] == r[1 + j]}
            for i, v in own.items():
                less, same = sum(x < v for x in own.values()), sum(x == v for x in own.values())
                z[i, j] = (less + (same + 1) / 2 - 0.5) / len(own) - 0.5
    corr = np.zeros((3, 3))
    for a in range(3):
        for b in range(3):
            p = [(z[i, a], z[i, b]) for i in rows if (i, a) in z and (i, b) in z]
            corr[a, b] = sum(x * y for x, y in p) / np.sqrt(sum(x * x for x, _ in p) * sum(y * y for _, y in p))
    sign = np.array([1, 1, -1])
    values, vectors = np.linalg.eigh(corr * np.outer(sign, sign))
    w = np.abs(vectors[:, np.argmax(values)]) * sign
    out = {}
    for i in rows:
        has = [j for j in range(3) if (i, j) in z]
        out[i] = sum(w[j] * z[i, j] for j in has) / np.sqrt(sum(w[j] ** 2 for j in has)) if has else 0.0
    return out


def test_against_brute_force(spark):
    rng = random.Random(11)
    rows = {}
    for i in range(120):
        q = rng.random()
        pick = lambda v: None if rng.random() < 0.15 else v
        rows[f"i{i}"] = (rng.choice(["g1", "g2", None]), pick(round(q, 1)), pick(1e6 * q**9), pick(float("nan") if rng.random() < 0.1 else -q + rng.random() / 3))
    rows["none"] = ("g1", None, None, None)
    data = [(i, *r) for i, r in rows.items()] + [("i0", *rows["i0"])]
    df = spark.createDataFrame(data, "item string, grp string, a double, b double, c double").selectExpr("*", "1 as projection", "2 as v", "3 as g")
    got = combined_ranking(df, "grp", "item", {"a": 1, "b": 1, "c": -1})
    want = brute(rows)
    have = {r["item"]: r["projection"] for r in got.collect()}
    assert have.keys() == want.keys() and all(abs(have[i] - want[i]) < 1e-9 for i in want)
    places = {r["item"]: (r["grp"], r["place"]) for r in got.collect()}
    for g in ("g1", "g2", None):
        own = sorted((i for i in rows if rows[i][0] == g), key=lambda i: (-have[i], i))
        assert [places[i] for i in own] == [(g, k + 1) for k in range(len(own))]
    top = {(r["grp"], r["item"]) for r in best_of(got, "grp", "item", 3).collect()}
    expected = set()
    for g in ("g1", "g2", None):
        own = sorted((i for i in rows if rows[i][0] == g), key=lambda i: (-have[i], i))
        expected |= {(g, i) for i in own[:3]}
    assert top == expected


def test_empty_and_flat(spark):
    df = spark.createDataFrame([("x", "g", 1.0, None), ("y", "g", 1.0, None)], "item string, grp string, a double, b double")
    assert combined_ranking(df.limit(0), "grp", "item", {"a": 1, "b": -1}).count() == 0
    assert {r["projection"] for r in combined_ranking(df, "grp", "item", {"a": 1, "b": -1}).collect()} == {0.0}


def test_a_score_against_its_declaration_is_left_out(spark):
    from turnwise.llm.ranking import first_component

    rng = random.Random(1)
    rows = [(x := rng.random() - 0.5, x + rng.random() / 5, -x + rng.random() / 5) for _ in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    w = first_component(df, ["a", "b", "c"], [1, 1, 1])
    assert w[2] == 0 and abs(w[0] - w[1]) < 1e-6 and abs(w[0] ** 2 + w[1] ** 2 - 1) < 1e-9
    w = first_component(df, ["a", "b", "c"], [1, 1, -1])
    assert w[0] > 0 and w[1] > 0 and w[2] < 0
