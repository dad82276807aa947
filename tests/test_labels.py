import itertools
import random

import numpy as np

from cuewright.functions.speakers import NUMBER_WORDS
from cuewright.operators.labels import assign, assigned, named, speaker_numbers


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(7)
    for _ in range(40):
        n = int(rng.integers(1, 6))
        m = n + int(rng.integers(0, 3))
        cost = rng.integers(0, 15, (n, m)).astype(float)
        best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        assert sum(cost[i, j] for i, j in enumerate(assign(cost))) == best


def test_names_are_told_apart_at_least_cost():
    assert assigned({"speakr too": {2: 1.0, 10: 2.0}, "speaker tow": {2: 2.0}}, set()) == {"speakr too": 10, "speaker tow": 2}
    assert assigned({"a": {3: 1.0}, "b": {3: 1.0}}, {3}) == {"a": 3, "b": 3}  # spellings of one speaker
    assert assigned({}, set()) == {}


def slip(word, rng):
    """A letter left out, doubled or changed with its neighbour, but for the first."""
    i = rng.randrange(1, len(word) - 1)
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + word[i] + word[i:], word[:i] + word[i + 1] + word[i] + word[i + 2 :]])


def test_slips_are_read(spark):
    rng = random.Random(11)
    rows, expected, n = [], {}, 0
    for path in range(40):
        for number in rng.sample([1, 3, 4, 5, 7, 8, 9], 4):
            word = NUMBER_WORDS[number]
            for text in (f"Speaker {word}", f"speaker_{number}", f"{slip('speaker', rng)} {word}", f"{slip('Speaker', rng)}_{number:02d}"):
                n += 1
                rows.append((n, f"/{path}", text))
                expected[n] = number
    df = spark.createDataFrame([(*r, "so it is") for r in rows], "id long, path string, label string, text string")
    got = {r.id: r.speaker_no for r in speaker_numbers(named(df, "label", "text").select("id", "path", "name", "number"), ["path"]).collect()}
    assert sum(got.get(i) == x for i, x in expected.items()) >= 0.97 * len(expected)
    assert not [i for i in got if rows[i - 1][2].lower().startswith("speaker") and got[i] != expected[i]]


def test_unknown_speakers_and_empty(spark):
    df = spark.createDataFrame([(1, "/a", None, None), (2, "/a", "", "hm"), (3, "/a", "unknown", "Speaker 2: yes"), (4, "/a", "Anna", "yes")], "id long, path string, label string, text string")
    rows = named(df, "label", "text").select("id", "path", "name", "number")
    assert [(r.id, r.speaker_no) for r in speaker_numbers(rows, ["path"]).collect()] == [(3, 2)]
    assert speaker_numbers(rows.limit(0), ["path"]).count() == 0
