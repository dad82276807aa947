import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.llm.language import LANGUAGES, Crf, judge, language_cases, language_code, languages, train, words_of

HELD_OUT = {
    "en": ["We walked along the river and talked about the weather.", "She has never seen such a small house before."],
    "es": ["Caminamos junto al río y hablamos del tiempo.", "Ella nunca ha visto una casa tan pequeña."],
    "pt": ["Nós caminhamos junto ao rio e não falamos do tempo.", "Ela nunca viu uma casa tão pequena."],
    "fr": ["Nous avons marché le long de la rivière.", "Elle n'a jamais vu une maison aussi petite."],
    "de": ["Wir sind am Fluss entlang gegangen und haben geredet.", "Sie hat noch nie ein so kleines Haus gesehen."],
    "nl": ["We hebben langs de rivier gelopen en gepraat.", "Zij heeft nog nooit zo'n klein huis gezien."],
    "it": ["Abbiamo camminato lungo il fiume e parlato del tempo.", "Lei non ha mai visto una casa così piccola."],
    "ta": ["நாங்கள் ஆற்றின் கரையில் நடந்தோம்.", "naan netru unnai paarthen aanal nee ennai paarkavillai"],
    "hi": ["हम नदी के किनारे चल रहे थे।", "main kal tumse milne aaya tha lekin tum ghar par nahin the"],
}


@pytest.fixture(scope="module")
def model():
    return train([])


def test_held_out_sentences(model):
    rows = [(lang, s) for lang, texts in HELD_OUT.items() for s in texts]
    got = judge(model, [words_of(s) for _, s in rows])
    right = sum(LANGUAGES[g[0]] == lang for (lang, _), g in zip(rows, got))
    assert right >= len(rows) - 1


def test_words_of_mixed_text(model):
    words = words_of("The door was open when we came back pero nadie sabe por qué la puerta estaba abierta")
    tags = [LANGUAGES[i] for i in model.tag([words])[0].argmax(1)]
    assert tags[:6].count("en") >= 5
    assert tags[-7:].count("es") >= 6


def test_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    crf = Crf()
    crf.t = rng.normal(size=crf.t.shape)
    e = rng.normal(size=(3, len(LANGUAGES)))
    flat, expected = crf.marginals(np.concatenate([e, e[:1]]), np.array([3, 1]), True)
    got = [flat[:3], flat[3:]]
    n = len(LANGUAGES)
    total, marginal, moves = 0.0, np.zeros((3, n)), np.zeros((n, n))
    for path in itertools.product(range(n), repeat=3):
        w = np.exp(sum(e[k, y] for k, y in enumerate(path)) + crf.t[path[0], path[1]] + crf.t[path[1], path[2]])
        total += w
        for k, y in enumerate(path):
            marginal[k, y] += w
        moves[path[0], path[1]] += w
        moves[path[1], path[2]] += w
    assert np.allclose(got[0], marginal / total)
    assert np.allclose(expected, moves / total)
    assert np.allclose(got[1][0], np.exp(e[0]) / np.exp(e[0]).sum())


def test_notations(spark):
    cases = {"EN": "en", " english ": "en", "pt-BR": "pt", "deu": "de", "Tamil": "ta", "": None, "??": None, None: None, "und": None, "sv": "sv", "en_US": "en"}
    rows = spark.createDataFrame([(k,) for k in cases], "c string").select("c", language_code(F.col("c")).alias("l")).collect()
    assert {r.c: r.l for r in rows} == cases


def test_cases(spark):
    en, es = "We walked along the river and talked about the weather.", "Nadie sabe por qué la puerta estaba abierta."
    seg = lambda *texts: [(t, 0.0, None) for t in texts]
    rows = [
        (1, f"{en} {en}", seg(en, en), "en"), (2, en, seg(en, es, en), "English"), (3, es, seg(es, es), "ta"), (4, es, None, None), (5, None, seg(en, en, es), "en"),
        (6, "♪ ♪", seg("♪ ♪", "[music]"), "en"), (7, None, None, "en"), (8, "", [], ""), (9, None, seg(None, "  ", en), "en"), (10, en, [], "und"),
    ]
    kind = "transcription_id long, full_text string, segments array<struct<seg_text: string, start_s: double, end_s: double>>, lang_code string"
    found = languages(spark.createDataFrame(rows, kind))
    assert sorted(tuple(r) for r in language_cases(found).collect()) == [(2, 1, "es"), (3, -1, "es"), (4, -1, "es"), (5, 2, "es"), (10, -1, "en")]
    assert all(0 < r.confidence <= 1 for r in found.collect())
    assert languages(spark.createDataFrame([], kind)).count() == 0


def test_very_long_text(model):
    assert judge(model, [words_of("the door was open " * 3000)])[0][0] == LANGUAGES.index("en")
    assert judge(model, [words_of("x" * 50000)])[0][2] == 1


def test_runs_without_spaces_and_short_segments(spark):
    en, es = "We walked along the river and talked about the weather.", "Nadie sabe por qué la puerta estaba abierta."
    run = "weknow" + "nadiesabeporquélapuertaestabaabiertacuandovolvimosalacasadelosabuelos" * 8 + "wewentout"
    assert LANGUAGES[judge(train([]), [words_of(run)])[0][0]] == "es"
    kind = "transcription_id long, full_text string, segments array<struct<seg_text: string, start_s: double, end_s: double>>, lang_code string"
    rows = [(1, None, [(x, 0.0, None) for x in (en, en, run, "नहीं", "Okay.", "Z" + "o" * 400, en)], "en"), (2, run, None, "en")]
    found = language_cases(languages(spark.createDataFrame(rows, kind)))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 2, "es"), (1, 3, "hi"), (2, -1, "es")]


def test_encoded_bytes_do_not_vote(spark):
    import random

    rng = random.Random(2)
    es = "Nadie sabe por qué la puerta estaba abierta. No podemos esperar más, hay que salir de aquí."
    blobs = ["".join(rng.choice("0123456789abcdef") for _ in range(1200)), "".join(rng.choice("ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789") for _ in range(900)), "SGVsbG8gV29ybGQgZnJvbSBoZXJl" * 20]
    assert words_of("call 555-1234 at 10:30, room B12 of https://example.org/some/page") == ["call", "at", "room", "of"]
    for blob in blobs:
        assert words_of(blob) == []
    segs = [(es, 0.0, None), (f"{es} {blobs[0]} Mañana", 1.0, None), (blobs[1], 2.0, None), (f"{blobs[2]} {es}", 3.0, None)]
    kind = "transcription_id long, full_text string, segments array<struct<seg_text: string, start_s: double, end_s: double>>, lang_code string"
    assert language_cases(languages(spark.createDataFrame([(1, None, segs, "es")], kind))).count() == 0


def test_runs_inside_a_segment(spark):
    en = "We walked along the river and talked about the weather. The door was open when we came back."
    mixed = "The door was still open when we came back pero nadie sabe por qué la puerta estaba abierta cuando volvimos a la casa and we never saw such a small house before in the village by the river"
    kind = "transcription_id long, full_text string, segments array<struct<seg_text: string, start_s: double, end_s: double>>, lang_code string"
    found = languages(spark.createDataFrame([(1, None, [(en, 0.0, None), (mixed, 1.0, None), (en, 2.0, None)], "en")], kind))
    rows = [r for r in found.collect() if r.kind == "mixed"]
    assert [(r.segment_no, r.lang) for r in rows] == [(1, "en")]
    assert sum(s.words for s in rows[0].spans) == len(mixed.split())
    spanish = max((s for s in rows[0].spans if s.lang == "es"), key=lambda s: s.words)
    assert spanish.words >= 10 and spanish.confidence > 0.9 and 7 <= spanish.first_word <= 11
    assert language_cases(found).count() == 0
