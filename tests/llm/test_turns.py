import random

import pytest
from turnwise.llm import turns
from turnwise.llm.turns import clean_text, cue_clock, cue_number, label_name, label_number, precedence_order, segment_order, speaker_turns
from turnwise.operators import ordering


def test_labels_and_cues():
    labels = [" SPEAKER_02 ", "speaker IV", "Speaker three", "spk#4?", "speaker５", "[2]", "Speaker 2 (student)", "S03", "UNKNOWN", "speaker_?", None, "", "RELATORE 02", "SPK_002"]
    assert [label_number(x) for x in labels] == [2, 4, 3, 4, 5, 2, 2, 3, None, None, None, None, 2, 2]
    assert [label_number(x) for x in ("Mario Sei", "Anna 2nd", "Prof. Rossi", "SPEAKER_A", "Speaker B", "2", "two", "i")] == [None, None, None, None, None, 2, 2, None]
    assert [label_name(x) for x in ("Anna", " ANNA ", "SPEAKER_A", "Speaker B", "Prof. Rossi", "Mario Sei", "UNKNOWN", "speaker_?", "speaker", "S01", None)] == ["anna", "anna", "speaker a", "speaker b", "prof rossi", "mario sei", None, None, None, None, None]
    assert [cue_number(x) for x in ("发言人2：你好", "話者3：こんにちは", "［S04］ 好")] == [2, 3, 4] and [turns._said(x)[2] for x in ("发言人2：你好", "話者3：こんにちは", "［S04］ 好")] == [2, 3, 4]
    assert clean_text("发言人2：你好") == "你好" and [cue_clock(x) for x in ("00:01:02.500 --> a", "[2:03] b", "1:2", None)] == [62.5, 123.0, None, None]
    cues = ["SPEAKER_03 >> hi", "<Relatore 2> ciao", "Relatore 4 - ciao", "Speaker 1: x", "[S02] x", "(spk 3) x", "the second speaker 2 reduces", "[00:01:02] a", None]
    assert [cue_number(x) for x in cues] == [3, 2, 4, 1, 2, 3, None, None, None]


def test_clean_text():
    assert clean_text("00:02:05.970 --> SPEAKER_02 >> Secondo me ehm, il modello [laughter] eh... cambia *tossisce* tutto!") == "Secondo me il modello cambia tutto!"
    assert clean_text("(…) uhm") == "" and clean_text(None) == ""


def resolved(nodes, edges):
    """Topological order by plain search: edges enter from the heaviest down unless they close a cycle."""
    after = {x: set() for x in nodes}

    def reaches(a, b):
        todo, seen = [a], {a}
        while todo:
            x = todo.pop()
            if x == b:
                return True
            todo += after[x] - seen
            seen |= after[x]
        return False

    for a, b, _ in sorted(edges, key=lambda e: -e[2]):
        if a != b and not reaches(b, a):
            after[a].add(b)
    out = []
    while len(out) < len(nodes):
        out.append(next(x for x in nodes if x not in out and not any(x in after[y] for y in nodes if y not in out)))
    return out


def test_graph_agrees_with_plain_search():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(1, 9)
        edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(1, 4)) for _ in range(rng.randrange(14))]
        assert precedence_order(n, edges) == resolved(range(n), edges)


def test_order_resolves_conflicts():
    # (start, place, clock, chunk, chunk start): places and clocks that contradict the starts give way
    assert segment_order([(1.0, 2, None, "a", 1.0), (2.0, 1, None, "a", 1.0), (3.0, 3, 0.5, "a", 1.0)]) == [0, 1, 2]
    # without starts the place decides, against the clock; without places the clock does, against the order of the chunks
    assert segment_order([(None, 2, 1.0, "a", 0.0), (None, 1, 9.0, "a", 0.0)]) == [1, 0]
    assert segment_order([(None, None, 9.0, "a", 0.0), (None, None, 1.0, "b", 5.0)]) == [1, 0]
    assert segment_order([(None, None, None, "a", 7.0), (None, None, None, "b", 5.0)]) == [1, 0]
    # a segment without a start stands between its neighbours in the chunk
    assert segment_order([(None, 2, None, "a", 0.0), (1.0, 1, None, "a", 0.0), (5.0, 3, None, "a", 0.0)]) == [1, 0, 2]


def brute(rows, labels):
    """Turns of [(id, source, chunk, text, start, end, place)] by explicit precedence edges over whole sources."""
    label_of = {c: (label_number(l), label_name(l), s) for c, l, s in labels}
    rows = list({r[0]: r for r in rows}.values())
    cues = {}
    for r in rows:
        if (n := cue_number(r[3])) is not None:
            cues[r[2]] = min(n, cues.get(r[2], n))
    out = {}
    for source in {r[1] for r in rows}:
        own = {r[0]: r for r in rows if r[1] == source and any(ch.isalpha() for ch in clean_text(r[3]))}
        edges = []
        for a in own.values():
            for b in own.values():
                if a[4] < b[4]:
                    edges.append((a[0], b[0], 4))
                if a[2] == b[2] and a[6] < b[6]:
                    edges.append((a[0], b[0], 3))
                if label_of[a[2]][2] < label_of[b[2]][2]:
                    edges.append((a[0], b[0], 1))
        turns = []
        for i in resolved(sorted(own, key=lambda i: (own[i][4], label_of[own[i][2]][2], own[i][2], own[i][6], i)), edges):
            r = own[i]
            no = label_of[r[2]][0] if label_of[r[2]][0] is not None else cues.get(r[2])
            who = (no, None if no is not None else label_of[r[2]][1])
            if turns and turns[-1][0] == who:
                turns[-1][2] = r[5]
                turns[-1][3].append(i)
            else:
                turns.append([who, r[4], r[5], [i]])
        out[source] = [(*w, round(s * 1000), round(e * 1000), len(i)) for w, s, e, i in turns]
    return out


@pytest.mark.parametrize("nodes", [None, 4])
def test_turns_match_explicit_constraints(spark, monkeypatch, nodes):
    monkeypatch.setattr(turns, "STRETCH_SECONDS", 3.0)
    if nodes:  # stretches are divided too
        monkeypatch.setattr(turns, "STRETCH_NODES", nodes)
        monkeypatch.setattr(ordering, "LOOK_FROM", 0)
    rng = random.Random(7)
    labels = [(f"c{i}", rng.choice(["S1", "speaker two", None, "SPK_003", "UNKNOWN", "Anna", "SPEAKER_A"]), float(rng.randrange(6))) for i in range(14)]
    rows = []
    for i in range(60):
        text = rng.choice(["hello there", "uhm", "[music]", "Speaker 2: fine", "", "(spk 4) well then"])
        s = float(rng.randrange(8))
        c = rng.randrange(14)
        rows.append((f"u{i:02d}", f"src{c % 2}", f"c{c}", text, s, s + 1.5, i))
    rows += rows[:9]
    u = spark.createDataFrame(rows, "utterance_id string, audio_source_id string, transcript_chunk_id string, text string, start_seconds double, end_seconds double, aligned_segment_index int")
    c = spark.createDataFrame(labels + labels[:3], "chunk_id string, speaker_label string, start_seconds double")
    u, c = u.selectExpr("*", "1 as k", "2 as speaker_no", "3 as clean"), c.selectExpr("*", "1 as chunk", "2 as text")
    got = {}
    for r in speaker_turns(u, c).orderBy("audio_source_id", "turn_no").collect():
        got.setdefault(r["audio_source_id"], []).append((r["speaker_no"], r["speaker_name"], r["start_ms"], r["end_ms"], r["utterances"]))
    assert got == brute(rows, labels)
    assert speaker_turns(u.limit(0), c).count() == 0


def test_nulls(spark):
    u = spark.createDataFrame(
        [("a", "s", None, "hi", 1.0, 2.0, None), ("b", "s", "x", None, None, None, 1), ("c", None, "y", "yes", None, None, None), ("d", "s", "y", "yes " * 20000, 3.0, None, 2)],
        "utterance_id string, audio_source_id string, transcript_chunk_id string, text string, start_seconds double, end_seconds double, aligned_segment_index int",
    )
    c = spark.createDataFrame([("y", "S2", None)], "chunk_id string, speaker_label string, start_seconds double")
    got = {(r["audio_source_id"], r["speaker_no"], r["start_ms"], r["end_ms"]) for r in speaker_turns(u, c, with_text=False).collect()}
    assert got == {("s", None, 1000, 2000), ("s", 2, 3000, None), (None, 2, None, None)}


def test_missing_starts_and_names(spark):
    rows = [("a", "s", "x", "one", 5.0, 6.0, 1), ("b", "s", "x", "two", None, 7.0, 2), ("c", "s", "x", "three", 700.0, 701.0, 3), ("d", "s", "y", "four", 6.5, 6.9, 1), ("e", "s", "z", "00:00:06.700 --> five", None, 6.8, 1)]
    u = spark.createDataFrame(rows, "utterance_id string, audio_source_id string, transcript_chunk_id string, text string, start_seconds double, end_seconds double, aligned_segment_index int")
    c = spark.createDataFrame([("x", "Anna", 5.0), ("y", "SPEAKER_A", 6.5), ("z", "anna", 6.7)], "chunk_id string, speaker_label string, start_seconds double")
    got = [(r["speaker_name"], r["text"]) for r in speaker_turns(u, c).orderBy("turn_no").collect()]
    assert got == [("anna", "one two"), ("speaker a", "four"), ("anna", "five three")]
