import os

from pyspark.sql import functions as F

from cuewright.sources import assets, media, subtitles

SRT = "1\r\n00:00:01,000 --> 00:00:02,500\r\nHello\r\nthere\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\n5 apples"


def test_parse_srt(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes(SRT.encode())
    (tmp_path / "b.SRT").write_bytes(b"1\n00:00:01,000 --> 00:00:02,000\nbad \xff bytes\n")
    (tmp_path / "c.txt").write_bytes(SRT.encode())
    rows = subtitles.read_srt(spark, str(tmp_path)).orderBy("video_path", "segment_no").collect()
    assert [(r.text, r.start, r.end) for r in rows] == [("Hello\nthere", 1.0, 2.5), ("5 apples", 3.0, 4.0), ("bad  bytes", 1.0, 2.0)]
    assert subtitles.read_srt(spark, str(tmp_path / "missing")).count() == 0


def test_empty_cue_takes_the_next(spark):
    text = "1\n00:00:01,000 --> 00:00:02,000\n\n2\n00:00:03,000 --> 00:00:04,000\nnext\n"
    got = spark.range(1).select(subtitles.cues(F.lit(text)).alias("c")).first().c
    assert [(c.text, c.start) for c in got] == [("2\n00:00:03,000 --> 00:00:04,000\nnext", 1.0)]


def test_cues_written(spark):
    rows = [("v", "b ", 2.0, None), ("v", "a", 1.0, 1.1), ("v", "a", 1.0, 1.3), ("v", " ", 1.0, 9.0), ("v", "x", None, 9.0), (None, "y", 1.0, 2.0), ("v", "n", float("nan"), 2.0)]
    df = spark.createDataFrame(rows, "k string, text string, start double, end double")
    got = subtitles.cue_texts(df, ["k"]).orderBy("k", "cue_no").collect()
    assert [(r.k, r.cue_no, r.text, r.end) for r in got] == [(None, 1, "y", 2.0), ("v", 1, "a", 1.3), ("v", 2, "b", 4.0)]
    assert got[1].cue == "1\n00:00:01,000 --> 00:00:01,300\na\n"


def test_srt_files_round_trip(spark, tmp_path):
    rows = [("v", f"line {i}", i * 3.0, i * 3.0 + 2) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, text string, start double, end double")
    assert subtitles.write_srt(df, str(tmp_path / "out"), "k") == 50
    folder = tmp_path / "out" / "k=v"
    whole = "".join((folder / name).read_text() for name in sorted(os.listdir(folder)) if name.startswith("part"))
    back = spark.range(1).select(subtitles.cues(F.lit(whole)).alias("c")).first().c
    assert [(c.text, c.start, c.end) for c in back] == [r[1:] for r in rows]


def test_scan(spark, tmp_path):
    keep = ["a.mkv", "sub/B.MP3", "sub/deep/deeper/c%20[1] x.Png", "_d.jpg", "empty.wav"]
    drop = [".hidden.mkv", ".git/x.mkv", "node_modules/x.mkv", "sub/.h/x.mkv", "sub/deep/build/x.mp4", "notes.txt"]
    for name in keep + drop:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "empty" in name else b"abc")
    rows = assets.scan(spark, str(tmp_path)).collect()
    assert {os.path.relpath(r.file_path, tmp_path) for r in rows} == set(keep)
    assert {r.media_type for r in rows} == {"video", "audio", "image"}
    listing = spark.createDataFrame([(str(tmp_path / n),) for n in keep + drop] + [(None,)], "path string")
    assert {os.path.relpath(r.path, tmp_path) for r in assets.select_assets(listing.where(F.col("path").isNull() | assets.kept_path(F.col("path"), root=str(tmp_path)))).collect()} <= set(keep)
    for bad in ("", "  ", None, str(tmp_path / "none"), str(tmp_path / "a.mkv")):
        assert assets.scan(spark, bad).count() == 0
    assert {os.path.basename(r.file_path) for r in assets.scan(spark, str(tmp_path), ["sub"]).collect()} >= {"a.mkv"}


def test_subtitle_choice(spark):
    rows = [("v", "embedded", "e", "o"), ("v", "sidecar", "s", "o"), ("w", "sidecar", "o", "o"), ("w", "embedded", "e", "o"), ("u", "user", "u", "o"), ("u", "sidecar_language", "l", "o"), ("x", "other", "p", "o"), (None, "user", "p", "o")]
    got = subtitles.best_subtitles(spark.createDataFrame(rows, "video_path string, kind string, path string, output_path string")).collect()
    assert sorted((r.video_path, r.kind) for r in got) == [("u", "user"), ("v", "sidecar"), ("w", "embedded")]
    videos = spark.createDataFrame([("/a/x.y.mkv",)], "path string")
    listing = spark.createDataFrame([("/a/x.y.ta.srt",), ("/a/x.y.srt",), ("/a/z.srt",)], "path string")
    assert sorted((r.kind, r.path) for r in subtitles.sidecar_candidates(videos, listing, "ta").collect()) == [("sidecar", "/a/x.y.srt"), ("sidecar_language", "/a/x.y.ta.srt")]


def test_frames_and_probes(spark):
    rows = [("a", 31.0), ("b", 0.0), ("c", None), ("d", float("nan")), ("e", 15.0), ("f", -3.0)]
    got = media.frame_manifest(spark.createDataFrame(rows, "video_path string, duration_s double")).collect()
    assert [(r.video_path, r.timestamp) for r in got] == [("a", 0.0), ("a", 15.0), ("a", 30.0), ("e", 0.0)]
    probes = spark.createDataFrame([('{"format": {"duration": "12.5"}, "streams": []}',), ("{}",), ("broken",), (None,)], "j string")
    assert [r.d for r in probes.select(media.duration_of(media.probed(F.col("j"))).alias("d")).collect()] == [12.5, 0.0, 0.0, 0.0]


def test_metadata_lookup(spark):
    works = spark.createDataFrame([(1, "movie", "A", 1999), (2, "movie", "B", None), (3, "personal", "A", 1999), (4, "tv", "C", 2000), (5, "movie", "", 1999)], "id int, media_type string, title string, year int")
    first = spark.createDataFrame([("A", 1999, [("plot a", ["", "x", "y", None, "z", "late"])]), ("C", 2000, [])], "title string, year int, results array<struct<overview: string, cast: array<string>>>")
    second = spark.createDataFrame([("A", 1999, "True", "other", "q"), ("B", None, "True", "plot b", "m, ,n"), ("C", 2000, "False", "no", "k")], "title string, year int, response string, plot string, actors string")
    got = {r.id: (r.plot_summary, r.cast, r.is_processed) for r in media.lookup_metadata(works, first, second).collect()}
    assert got == {1: ("plot a", ["x", "y", "z"], True), 2: ("plot b", ["m", "n"], True), 3: (None, None, False), 4: (None, None, False), 5: (None, None, False)}


def test_missing(spark):
    wanted = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert sorted(str(r.k) for r in media.missing(wanted, spark.createDataFrame([(2,), (2,)], "k int"), "k").collect()) == ["1", "None"]
