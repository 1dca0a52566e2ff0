import itertools
import random

import numpy as np
import pytest
from turnwise.llm import chunking
from turnwise.llm.chunking import best_cuts, cut_text, cutting_cost, piece_start, split_oversized
from turnwise.llm.tokens import count_tokens, encoding, token_offsets


def brute(levels, limit, overlap):
    """Least cost over all cuttings at any positions whatever."""
    n = len(levels) - 1
    best = None
    at = [i for i in range(overlap + 1, n) if levels[i] <= 5]
    for k in range(len(at) + 1):
        for cuts in itertools.combinations(at, k):
            sizes = [b - a for a, b in zip([0, *[piece_start(levels, c, overlap) for c in cuts]], [*cuts, n])]
            if max(sizes) <= limit:
                cost = cutting_cost(levels, cuts, limit, overlap)
                best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("cells,block", [(0, 1), (4_000_000, 2), (4_000_000, 4), (0, 32)])
def test_cuts_are_optimal(cells, block, monkeypatch):
    monkeypatch.setattr(chunking, "TABLE_CELLS", cells)
    monkeypatch.setattr(chunking, "BLOCK", block)
    rng = random.Random(4)
    for _ in range(60):
        n, limit, overlap = rng.randrange(6, 15), rng.randrange(4, 7), rng.randrange(0, 3)
        levels = np.array([5] + [rng.choice([0, 1, 2, 3, 4, 5, 5, 9]) for _ in range(n - 1)] + [5], np.int8)
        want, cuts = brute(levels, limit, overlap), best_cuts(levels, limit, overlap)
        if n <= limit:
            assert cuts == []
            continue
        assert (cuts is None) == (want is None)
        if cuts is not None:
            sizes = [b - a for a, b in zip([0, *[piece_start(levels, c, overlap) for c in cuts]], [*cuts, n])]
            assert max(sizes) <= limit and abs(cutting_cost(levels, cuts, limit, overlap) - want) < 1e-9


def test_bounds_lose_no_cutting_of_long_texts():
    """Over texts too long to enumerate: the same cost as the program over every position."""
    rng = random.Random(8)
    for _ in range(25):
        n, limit, overlap = rng.randrange(900, 3000), rng.randrange(100, 400), rng.randrange(0, 40)
        levels = np.array([5] + [rng.choice([5] * 20 + [4] * 20 + [3] * 3 + [2] * rng.choice([0, 1]) + [9] * 5) for _ in range(n - 1)] + [5], np.int8)
        every = np.array([i for i in range(overlap + 1, n) if levels[i] <= 5])
        got, want = best_cuts(levels, limit, overlap), chunking._cheapest(levels, every, limit, overlap)
        assert abs(cutting_cost(levels, got, limit, overlap) - cutting_cost(levels, want, limit, overlap)) < 1e-9


def test_a_late_sentence_end_does_not_rule_out_clauses():
    levels = np.full(1001, 4, np.int8)
    levels[0] = 5
    levels[500], levels[950] = 3, 2  # an even cut at a clause, or a late one at a sentence
    assert best_cuts(levels, 960, 0) == [500]


TEXTS = ["One sentence here. Another one follows, and more! " * 60, "word" * 900, "你好世界。" * 300, "a\n\nb " * 400, "ไทย ภาษา " * 300, "🙂" * 700]


@pytest.mark.parametrize("text", TEXTS)
def test_pieces_restore_the_text(text):
    enc = encoding()[0]
    ids = enc.encode_ordinary(text)
    pieces = cut_text(text, 100, 10)
    back, at = "", 0
    for k, (a, b, s, e) in enumerate(pieces):
        assert count_tokens(text[s:e]) <= 100 and enc.decode(ids[a:b]) == text[s:e]
        if k:
            assert pieces[k - 1][1] - 13 <= a <= pieces[k - 1][1] - 10 and (a == pieces[k - 1][1] - 10 or '🙂' in text)
        back, at = back + text[max(s, at) : e], e
    assert back == text and len(pieces) > 1
    if "sentence" in text:
        assert all(text[:e].rstrip()[-1] in ".!" for _, _, _, e in pieces)


def test_an_uncuttable_text_fails_nothing():
    assert len(cut_text("🙂" * 9, 3, 1)) > 1 and cut_text("🙂" * 9, 3, 1)[-1][3] == 9


def test_offsets():
    assert token_offsets("").tolist() == [0] and token_offsets("ab cd")[-1] == 5 and count_tokens(None) == 0


def test_operator(spark):
    rows = [(1, TEXTS[0]), (2, "short"), (3, None), (4, ""), (1, TEXTS[0]), (None, TEXTS[1]), (5, "x " * 200000)]
    df = spark.createDataFrame(rows, "doc bigint, body string").selectExpr("*", "1 as id", "2 as t", "3 as piece")
    got = split_oversized(df, "doc", "body", 100, 10)
    assert dict(got.dtypes)["doc"] == "bigint"
    pieces = [(r["doc"], r["piece_no"]) for r in got.collect()]
    assert len(pieces) == len(set(pieces)) and {d for d, _ in pieces} == {1, None, 5}
    assert split_oversized(df.limit(0), "doc", "body", 100, 10).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "doc", "body", 10, 10)
