import itertools
import random

import numpy as np
import pytest

import cuewright.llm.speaker_turns as speaker_module
from cuewright.llm.speaker_turns import speaker_turns, turn_rows
from cuewright.operators.intervals import speech_periods
from cuewright.operators.labels import assign

KIND = "voice_id long, media_path string, start_time double, end_time double, speaker_label string, transcribed_text string, name string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], KIND).repartition(3)


def turns(spark, rows, partitions=4):
    return sorted((r.turn_voice_id, r.voice_id) for r in turn_rows(table(spark, rows), partitions).collect())


def test_rules(spark):
    nan = float("nan")
    rows = [
        (1, "/a", 0.0, 1.0, "SPEAKER_00", "one"),
        (2, "/a", 1.0, 2.0, "Speaker zero", "two"),
        (3, "/a", 2.0, 3.0, "S1", "three"),
        (4, "/a", 3.0, 4.0, "S1", "[laughs] uh..."),
        (5, "/a", 4.0, 5.0, None, "Speaker 1: four"),
        (6, "/a", 5.0, 6.0, "?", "nobody knows"),
        (7, "/a", 6.0, 6.0, "S0", "no length"),
        (8, "/a", 7.0, nan, "S0", "no end"),
        (9, "/a", None, 8.0, "S0", "no start"),
        (10, "/a", 8.0, 9.0, "spk_1", "five"),
        (11, "/a", 8.0, 9.0, "spk_1", "five"),
        (12, None, 8.0, 9.0, "spk_1", "no path"),
        (13, "/b", 0.5, 0.9, "SPEAKER_01", "another file"),
        (14, "/a", 1.0, 2.0, "S0", "tie, later id"),
        (15, "/a", 9.0, 9.5, "S0", None),
    ]
    assert turns(spark, rows) == [(1, 1), (1, 2), (1, 14), (3, 3), (3, 5), (3, 10), (13, 13)]
    text = {r.turn_voice_id: (r.speaker_no, r.start_ms, r.end_ms, r.n_rows, r.text) for r in speaker_turns(table(spark, rows)).collect()}
    assert text[1] == (0, 0, 2000, 3, "one two tie, later id")
    assert text[3] == (1, 2000, 9000, 3, "three four five")


@pytest.mark.parametrize("partitions", [1, 2, 9, 30])
def test_runs_over_range_edges(spark, partitions):
    rng = random.Random(partitions)
    rows, n = [], 0
    for path, count in (("/hot", 200), ("/x", 7), ("/y", 1)):
        speaker = 0
        for i in range(count):
            speaker = rng.randrange(3) if rng.random() < 0.12 else speaker
            n += 1
            rows.append((n, path, i // 2 + 0.0, i // 2 + 1.0, f"S{speaker}", f"word {n}"))
    expected = []
    for _, group in itertools.groupby(rows, key=lambda r: (r[1], r[4])):
        group = list(group)
        expected += [(group[0][0], r[0]) for r in group]
    assert turns(spark, rows, partitions) == sorted(expected)


def test_slips_in_names_are_assigned(spark):
    rows = [(i, "/a", float(i), i + 1.0, label, f"w{i}") for i, label in enumerate(["Speaker one", "Speaker two", "Speakr thre", "Speaker too", "Speaker onee"], 1)]
    rows += [(i, "/b", float(i), i + 1.0, "Speaker three", "w") for i in range(50, 53)]
    got = dict((b, a) for a, b in turns(spark, rows))
    assert set(got) >= {1, 2, 3, 50, 51, 52}
    assert turns(spark, []) == []


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n, m = int(rng.integers(1, 5)), int(rng.integers(5, 7))
        cost = rng.integers(0, 20, (n, m)).astype(float)
        best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        found = assign(cost)
        assert len(set(found)) == n
        assert sum(cost[i, j] for i, j in enumerate(found)) == best


def test_periods_and_turns_agree_on_speakers(spark):
    labels = ["Speaker one", "SPK_1", "speakr_3", "Speakr thre", "spkr 3", "Speaker too", "unknown", None, "S２", "sprecher 4", "sprecer 4"]
    rows = [(i, "/a", 10.0 * i, 10.0 * i + 1, label, "hello there") for i, label in enumerate(labels, 1)]
    rows += [(50 + i, "/b", float(i), i + 0.5, label, "hello") for i, label in enumerate(["Speaker three", "Speaker two", "Sprecher 1"])]
    df = table(spark, rows)
    turned = {(r.speaker_no, r.start_ms) for r in speaker_turns(df).where("media_path = '/a'").collect()}
    periods = {(r.speaker_no, r.start_ms) for r in speech_periods(df).where("media_path = '/a' and kind = 'period'").collect()}
    of = {s // 10_000: n for n, s in periods}
    assert {(n, s) for n, s in periods if (n, s) in turned} == turned
    assert of == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 2, 9: 2, 10: 4, 11: 4}


def test_a_monologue_comes_in_parts(spark, monkeypatch):
    monkeypatch.setattr(speaker_module, "PART_ROWS", 7)
    rows = [(i, "/a", 60.0 * i, 60.0 * i + 30, "S1", f"word{i}") for i in range(1, 41)]
    parts = sorted(speaker_turns(table(spark, rows)).collect(), key=lambda r: r.part_no)
    assert [r.n_rows for r in parts] == [7] * 5 + [5] and {r.turn_voice_id for r in parts} == {1}
    assert " ".join(r.text for r in parts) == " ".join(f"word{i}" for i in range(1, 41))


def test_long_sound_notes_are_no_speech(spark):
    rows = [(1, "/a", 0.0, 1.0, "S1", "[" + "a long note of what is heard " * 20 + "]"), (2, "/a", 1.0, 2.0, "S1", "*" + "rain falls " * 30 + "*"), (3, "/a", 2.0, 3.0, "S1", "word")]
    assert turns(spark, rows) == [(3, 3)]
