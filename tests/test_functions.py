import math
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuewright.functions import ids, media, paths, speakers, text, times, vectors


def one(spark, column, **values):
    """The value of a column function over one row of literals."""
    return spark.range(1).select(column(**{k: F.lit(v) for k, v in values.items()}).alias("x")).first().x


@pytest.mark.parametrize(
    ("stem", "title", "year"),
    [
        ("The.Matrix.1999.1080p.BluRay.x264-YTS", "The Matrix", 1999),
        ("Movie [2025]", "Movie [", 2025),
        ("Movie (2010)", "Movie", 2010),
        ("Movie (2010 remaster)", "Movie (", 2010),
        ("2012", "", 2012),
        ("Show.S01E02.720p.WEB-DL.H.264", "Show S01E02 H", None),
        ("Blade.Runner.2049.2017.2160p", "Blade Runner", 2049),
        ("IMG_20240101_120000", "IMG 20240101 120000", None),
        ("A (1080) 2001", "A", 1080),
        ("", "", None),
    ],
)
def test_title_and_year(spark, stem, title, year):
    got = one(spark, lambda s: text.title_and_year(s), s=stem)
    assert (got.title, got.year) == (title, year)
    assert one(spark, lambda s, t: text.title_or_stem(t, s), s=stem, t=title) == (title or stem)


def test_title_of_null(spark):
    assert spark.range(1).select(text.title_and_year(F.lit(None).cast("string")).alias("x")).first().x is None


@pytest.mark.parametrize(
    ("path", "hint", "kind"),
    [
        ("/a/Show.S01E02.mkv", "unknown", "tv"),
        ("/a/Show.S01E02.mkv", "MOVIE", "tv"),
        ("/a/Movie (2010).mkv", "nonsense", "movie"),
        ("/a/2012.mkv", None, "video"),
        ("/a/x.M4V", "unknown", "personal"),
        ("/a/x.wmv", "unknown", "video"),
        ("/a/song.MP3", "unknown", "audio"),
        ("C:\\p\\shot.JPG", "unknown", "image"),
        ("/a/noext", "unknown", "personal"),
    ],
)
def test_media_kind(spark, path, hint, kind):
    assert one(spark, lambda p, h: media.media_kind(p, h), p=path, h=hint) == kind


@pytest.mark.parametrize("path", ["/a/b c.mkv", '"/a/b c.mkv"', " '/a/b c.mkv'\n", '\t"\'/a/b c.mkv\'" '])
def test_clean_path(spark, path):
    assert one(spark, lambda p: paths.clean_path(p), p=path) == "/a/b c.mkv"


def test_blank_path_is_null(spark):
    assert one(spark, lambda p: paths.clean_path(p), p=' "" ') is None


def test_uuid5_equals_python(spark):
    keys = ["", "a", "/v/ü.mkv_1.5", "x" * 500, "ta_தமிழ்_0.0", *[f"/m/{i}.mkv_{i / 3:.3f}" for i in range(60)]]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", ids.uuid5(F.col("k")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_DNS, r.k)) for r in rows)


def test_numbers_in_keys(spark):
    values = [0.0, 0.001, 1.5, 123456.789, 9999999.0, 10000000.0, 123456789.25, 2.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", ids.number_text(F.col("v")).alias("t")).collect()
    assert [r.t for r in rows] == [repr(v) for v in values]


@pytest.mark.parametrize(("shown", "seconds"), [("00:00:01.500", 1.5), ("01:02:03.25", 3723.25), ("1:2", 0.0), ("a:b:c", 0.0), ("", 0.0), (None, 0.0)])
def test_seconds_of(spark, shown, seconds):
    assert one(spark, lambda t: text.seconds_of(t.cast("string")), t=shown) == seconds


@settings(max_examples=20, deadline=None)
@given(st.lists(st.integers(0, 400_000_000), min_size=1, max_size=40))
def test_timestamps_round_trip(spark, values):
    rows = spark.createDataFrame([(v / 1000,) for v in values], "s double")
    back = rows.select("s", text.seconds_of(F.replace(text.timestamp_of(F.col("s")), F.lit(","), F.lit("."))).alias("b")).collect()
    assert all(abs(r.s - r.b) < 1e-6 for r in back)


def test_timestamp_carries(spark):
    assert one(spark, lambda s: text.timestamp_of(s), s=1.9996) == "00:00:02,000"


def test_json_part(spark):
    cases = {'```json\n{"a": {"b": 1}}\n```': '{"a": {"b": 1}}', 'x {"a": 1} y': '{"a": 1}', "none": "none"}
    for answer, part in cases.items():
        assert one(spark, lambda t: text.json_part(t), t=answer) == part
    assert one(spark, lambda t: text.parsed_json(t, "a int"), t='well {"a": 3}').a == 3
    assert one(spark, lambda t: text.parsed_json(t, "a int"), t="no json") is None


def test_prompts(spark):
    assert one(spark, lambda t, s: text.filled_prompt(t, s), t="do {{JSON_SCHEMA}} {{FEW_SHOT}}.", s="{}") == "do {} ."
    assert one(spark, lambda t, s: text.filled_prompt(t, s), t="do", s="{}").endswith("{}")


def test_actor_lists(spark):
    assert one(spark, lambda t: text.actors_of(t), t="A, ,B C ,") == ["A", "B C"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.floats(-100, 100, width=32), min_size=3, max_size=3), min_size=1, max_size=8))
def test_vectors_against_python(spark, rows):
    df = spark.createDataFrame([(i, r, rows[0]) for i, r in enumerate(rows)], "i int, a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    for r in df.select("a", "b", vectors.norm(a).alias("n"), vectors.cosine(a, b).alias("c"), vectors.l2_distance(a, b).alias("d"), vectors.l2_normalize(a).alias("u")).collect():
        n = math.sqrt(sum(x * x for x in r.a))
        m = math.sqrt(sum(x * x for x in r.b))
        assert r.n == pytest.approx(n)
        assert r.d == pytest.approx(math.dist(r.a, r.b))
        assert r.c is None if n * m == 0 else r.c == pytest.approx(sum(x * y for x, y in zip(r.a, r.b)) / n / m)
        assert r.u == pytest.approx([x / (n + 1e-9) for x in r.a])


def test_vector_checks(spark):
    rows = [([1.0, 2.0],), ([1.0],), (None,), ([1.0, None],), ([1.0, float("nan")],), ([float("inf"), 1.0],)]
    df = spark.createDataFrame(rows, "v array<float>")
    assert [r.ok for r in df.select(vectors.is_vector(F.col("v"), 2).alias("ok")).collect()] == [True, False, False, False, False, False]
    with pytest.raises(Exception, match="length 2"):
        df.where("size(v) = 1").select(vectors.require_dim(F.col("v"), 2)).collect()


def test_times(spark):
    rows = [(1.25,), (-1.0,), (float("nan"),), (None,), (float("inf"),)]
    df = spark.createDataFrame(rows, "s double").select(times.usable(F.col("s")).alias("u"), times.finite(F.col("s")).alias("f"), times.millis(F.col("s")).alias("m"))
    assert [(r.u, r.f, r.m) for r in df.collect()] == [(True, True, 1250), (False, True, -1000), (False, False, None), (False, False, None), (False, False, None)]


@pytest.mark.parametrize(
    ("label", "said", "number"),
    [
        ("SPEAKER_01", None, 1), ("  [speaker_2] ", "", 2), ("S3", "", 3), ("SPK04", "", 4), ("Speaker Five:", "", 5), ("SPEAKER_OO", "", 0), ("SPEAKER_1O", "", 10),
        ("SPEAKER_０７", "", 7), ("SPEAKER_08 (cont'd)", "", 8), ("Sprecher 9", "", 9), ("Locuteur 10", "", 10), ("Speaker #11", "", 11), ("SPEAKER-12:", "", 12),
        ("UNKNOWN", "no name", None), ("?", ">> Speaker 1: yes", 1), (None, "[S2] yes", 2), ("", "spk_3> yes", 3), ("SPEAKER_??", "Speaker 4 - yes", 4), ("  ", "(SPEAKER_05) yes", 5),
        ("S6", "Speaker 1: it is the label that counts", 6), (None, None, None), (None, "Speaker 4 says", None),
    ],
)
def test_speaker_numbers(spark, label, said, number):
    got = spark.range(1).select(speakers.speaker_number(F.lit(label).cast("string"), F.lit(said).cast("string")).alias("x")).first().x
    assert got == number


@pytest.mark.parametrize(
    ("said", "spoken"),
    [
        ("[00:00:03] Uh... <noise>", False), ("Mm-hmm, äh!", False), ("♪ ♪", False), ("00:01:02.345", False), ("*door slams*", False), ("...", False), ("", False), (None, False),
        ("Speaker 1: (01:02)", False), ("Er, yes", True), ("7", True), ("நான்", True), ("Uhland", True),
    ],
)
def test_spoken_words(spark, said, spoken):
    assert spark.range(1).select(speakers.has_word(F.lit(said).cast("string")).alias("x")).first().x is spoken


@pytest.mark.parametrize(
    ("said", "clean"),
    [
        (">> Speaker 1: [00:01:02] Well, uh, I I mean, go  home. (laughs)", "Well, I go home."),
        ("Um... no — er — not yet", "no not yet"),
        ("Er hat um acht nicht angerufen und ist weg.", "Er hat um acht nicht angerufen und ist weg."),
    ],
)
def test_clean_speech(spark, said, clean):
    assert one(spark, lambda t: speakers.clean_speech(t), t=said) == clean
