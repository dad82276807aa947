import json

import pytest
from pyspark.sql import functions as F

from cuewright.__main__ import chosen_path, main
from cuewright.api import Engine
from cuewright.logs import event_log
from cuewright.models import Adapters, HashingEncoder, Settings, encode_texts, load_prompt
from cuewright.operators import store
from cuewright.operators.store import COLLECTIONS, face_clusters, mean_vectors
from cuewright.sources.media import cached, keep, missing
from cuewright.streaming.ingest import ingest_subtitles


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "store"))


def lines(spark, rows):
    return spark.createDataFrame(rows, "video_path string, text string, start double, end double")


def test_upserts_change_nothing_when_repeated(spark, engine):
    assert engine.store.collections() == list(COLLECTIONS)
    rows = lines(spark, [("/v", "the red car", 1.0, None), ("/v", " ", 2.0, 3.0), ("/v", "a blue boat", 4.0, 5.0)])
    for _ in range(2):
        engine.ingest_segments(rows)
    assert engine.store.read("media_segments").count() == 2
    engine.ingest_segments(lines(spark, [("/v", "the green car", 1.0, 2.0)]))
    assert {r.text for r in engine.store.read("media_segments").collect()} == {"the green car", "a blue boat"}
    frames = spark.createDataFrame([("/v", 0.0, "a red car parks"), ("/v", 15.0, "Error: no model"), ("/v", 30.0, "")], "video_path string, timestamp double, action string")
    for _ in range(2):
        engine.ingest_frames(frames)
    assert engine.store.read("media_frames").count() == 1
    found = engine.search("red car", 5).collect()
    assert [(r.modality, r.content) for r in found][:1] == [("visual", "a red car parks")]
    assert found[0].time == "0.00s"
    engine.store.close()
    engine.store.close()


def test_search_options(spark, engine):
    engine.ingest_segments(lines(spark, [("/a", "red car", 0.0, 1.0), ("/b", "red car", 0.0, 1.0), ("/b", "boat", 2.0, 3.0)]))
    assert {r.video_path for r in engine.search_media("red car", video_path="/b", score_threshold=0.5).collect()} == {"/b"}
    assert engine.search_media("red car", segment_type="visual").count() == 0
    text = engine.call_tool("search_media", json.dumps({"query": "red car", "limit": 5}))
    assert "Dialogue matches: 3" in text
    assert text.startswith("Search results for: 'red car'\nVisual matches: 0\nDialogue matches: 3\n- [D] 0.00s /a: red car\n")
    assert engine.call_tool("search_media", "not json").startswith("Search results for: ''\nVisual matches: 0")
    assert engine.call_tool("search_media", {"query": "x", "limit": 99}).startswith("search_media failed with error: ")
    assert engine.search_media("red car", 1).columns == ["score", "text", "start", "end", "video_path", "type"]
    assert engine.search_frames("red car").columns == ["score", "action", "timestamp", "video_path", "type"]
    assert engine.search_face([1.0] * 128).columns == ["score", "id", "name", "cluster_id"]
    assert engine.call_tool("nothing", {}) == "Unknown tool: nothing"


def test_faces_and_voices(spark, engine):
    face = spark.createDataFrame([([1.0] + [0.0] * 127,), (None,)], "embedding array<float>")
    for _ in range(2):
        engine.ingest_faces(face)
    assert engine.store.read("faces").count() == 2  # random identifiers: appended, not merged
    assert engine.search_face([1.0] + [0.0] * 127).first().score == 0.0
    voices = spark.createDataFrame([("/v", 0.0, 40.0, "S0", [3.0] * 256), ("/v", 0.0, 0.5, "S0", [3.0] * 256)], "media_path string, start double, end double, speaker_label string, embedding array<float>")
    engine.ingest_voices(voices)
    assert [r.end for r in engine.store.read("voice_segments").collect()] == [30.0]
    with pytest.raises(Exception, match="length 256"):
        engine.store.append_voices(voices.withColumn("embedding", F.slice("embedding", 1, 3)))


def test_ingest_media(spark, engine, tmp_path):
    film = tmp_path / "Movie (2010).mkv"
    film.write_bytes(b"x")
    film.with_suffix(".srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nhello world\n")
    answer = engine.ingest_media(f' "{film}" ', "nonsense")
    assert answer["message"] == "Ingestion completed"
    assert answer["media_type_hint"] == "unknown"
    asset = engine.store.read("assets").first()
    assert (asset.title, asset.year, asset.media_type) == ("Movie", 2010, "movie")
    assert engine.store.read("media_segments").first().text == "hello world"
    assert "not found" in engine.ingest_media("/no/such.mkv")["message"]


def test_command_line(spark, tmp_path, capsys):
    film = tmp_path / "Film (1999).mkv"
    film.write_bytes(b"x")
    film.with_suffix(".srt").write_text("1\n00:00:01,000 --> 00:00:02,000\nthe red car\n")
    main(["ingest", str(tmp_path / "s"), str(film)])
    main(["search", str(tmp_path / "s"), "red car", "--limit", "3"])
    said = capsys.readouterr().out
    assert "Ingestion completed" in said
    assert "Film (1999).mkv: the red car..." in said


def test_arriving_subtitles(spark, engine, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for i in range(3):
        (inbox / f"{i}.srt").write_text(f"1\n00:00:0{i},000 --> 00:00:09,000\nline {i}\n")
        query = ingest_subtitles(engine, str(inbox), str(tmp_path / "checkpoint"), once=True)
        assert query.awaitTermination(120)
    assert {r.text for r in engine.store.read("media_segments").collect()} == {"line 0", "line 1", "line 2"}


def test_models_and_logs(spark, tmp_path):
    assert len(encode_texts("a b")) == 1
    assert encode_texts([]) == []
    assert HashingEncoder(8).encode(["", None]).tolist() == [[0.0] * 8] * 2
    assert Settings().models_for("xx") == [Settings().fallback_model]
    with pytest.raises(FileNotFoundError):
        load_prompt("none.txt", str(tmp_path))
    event_log(str(tmp_path / "log" / "x.jsonl")).info("seen", extra={"fields": {"n": 3}})
    assert json.loads((tmp_path / "log" / "x.jsonl").read_text())["n"] == 3


def test_aggregates(spark):
    faces = spark.createDataFrame([(0, "b"), (0, "a"), (-1, "c"), (None, "d")], "cluster_id int, sample_path string")
    assert [tuple(r) for r in face_clusters(faces).collect()] == [(0, 2, "a")]
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0])], "k string, embedding array<float>")
    assert mean_vectors(vectors, "k").first().embedding_avg == [2.0, 3.0]


def test_writes_add_only_their_rows_until_they_are_made_one(spark, engine, monkeypatch):
    monkeypatch.setattr(store, "COMPACTED_AT", 4)
    for i in range(6):
        engine.ingest_segments(lines(spark, [("/v", f"text {i}", 1.0, 2.0), ("/v", f"other {i}", 10.0 + i, None)]))
        got = {r.text for r in engine.store.read("media_segments").collect()}
        assert got == {f"text {i}", *(f"other {k}" for k in range(i + 1))}
    writes = engine.store.writes("media_segments")
    assert writes[0].endswith("-all") and len(writes) == 3
    again = store.PointStore(spark, engine.store.folder)
    assert again.read("media_segments").count() == 7
    assert spark.read.parquet(f"{engine.store.folder}/media_segments/{writes[-1]}").count() == 2


def test_a_write_that_did_not_end_is_not_seen(spark, engine):
    engine.ingest_segments(lines(spark, [("/v", "a", 1.0, 2.0)]))
    lines(spark, [("/v", "b", 3.0, 4.0)]).write.parquet(f"{engine.store.folder}/media_segments/_tmp-x")
    assert engine.store.read("media_segments").count() == 1


class Told:
    """Stands in for all models."""

    def __init__(self, spark):
        self.spark = spark

    def probe(self, media):
        return media.withColumn("probe", F.when(F.col("path").contains("broken"), F.lit("no json")).otherwise(F.lit('{"format": {"duration": "31.5"}}')))

    def embedded(self, media):
        srt = "1\n00:00:01,000 --> 00:00:02,000\nfrom inside\n"
        return media.where("path like '%inside%'").select("path", F.lit(srt).cast("binary").alias("content"))

    def recognised(self, media):
        assert {r.path for r in media.collect()} == {"/m/broken.mkv", "/m/speech.mkv"}
        segments = media.where("path like '%speech%'").select("path", F.lit(0).alias("segment"), F.lit("hello there friend").alias("text"), F.lit(0.0).alias("start"), F.lit(3.0).alias("end"))
        words = segments.select("path", "segment", F.posexplode(F.array(*[F.lit(x) for x in (" hello.", " there", " friend")])).alias("word_idx", "word"))
        return segments, words.select("*", F.col("word_idx").cast("double").alias("start"), (F.col("word_idx") + 1).cast("double").alias("end"))

    def describe(self, frames):
        return frames.withColumn("action", F.when(F.col("frame_idx") == 1, "Error: no model").when(F.col("frame_idx") == 0, "a red car"))

    def faces(self, frames):
        vector = F.array_repeat(F.lit(1.0), 128)
        return frames.select("video_path", "timestamp", F.when(F.col("frame_idx") == 0, vector).alias("embedding"))

    def voices(self, media):
        return media.select(F.col("path").alias("media_path"), F.lit(0.0).alias("start"), F.lit(5.0).alias("end"), F.lit("S0").alias("speaker_label"), F.array_repeat(F.lit(2.0), 256).alias("embedding"))


def test_ingestion_through_all_models(spark, tmp_path):
    told = Told(spark)
    engine = Engine(spark, str(tmp_path / "s"), adapters=Adapters(told, told, told, told, told, told), settings=Settings())
    files = spark.createDataFrame([("/m/beside.mkv", "video"), ("/m/inside.mkv", "unknown"), ("/m/speech.mkv", "unknown"), ("/m/broken.mkv", "VIDEO"), (None, None)], "file_path string, media_type string")
    srt = "1\n00:00:01,000 --> 00:00:02,000\n{}\n"
    listing = [("/m/beside.ta.srt", srt.format("in Tamil")), ("/m/beside.srt", srt.format("in English")), ("/m/inside.srt", "no cues")]
    listing = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in listing], "path string, content binary")
    assert engine.ingest_files(files, listing) == {"segments": 4, "voices": 4, "frames": 9, "faces": 3}
    got = {(r.video_path, r.text) for r in engine.store.read("media_segments").collect()}
    assert got == {("/m/beside.mkv", "in Tamil"), ("/m/inside.mkv", "from inside"), ("/m/speech.mkv", "hello."), ("/m/speech.mkv", "there friend")}
    assert {r.duration for r in engine.store.read("assets").collect()} == {31.5, 0.0}
    assert engine.store.read("media_frames").count() == 3 and engine.store.rejected_frames().count() == 3
    assert engine.store.read("faces").count() == 3 and engine.store.read("voice_segments").count() == 4
    assert engine.call_tool("ingest_media", {"file_path": "/no.mkv"}) == "Ingestion result for /no.mkv: File not found: /no.mkv (media_type_hint=unknown)"


def test_settings_of_the_environment():
    given = Settings.from_env({"frame_interval": "5", "LANGUAGE": "en", "ENABLE_VOICE_ANALYSIS": "false", "WHISPER_MODEL_MAP": '{"en": ["x"]}', "OTHER": "1"})
    assert (given.frame_interval, given.language, given.voices, given.models_for("en")) == (5.0, "en", False, ["x"])
    assert Settings.from_env({}) == Settings()
    with pytest.raises(ValueError):
        Settings.from_env({"BATCH_SIZE": "many"})


def test_a_file_is_chosen_among_like_ones(spark, tmp_path):
    for name in ("Silver Lake (1999).mkv", "Golden Hill (2001).mp4", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    exact = str(tmp_path / "Silver Lake (1999).mkv")
    assert chosen_path(spark, f'"{exact}"') == exact
    assert chosen_path(spark, str(tmp_path / "Silver Lakes 1999.mkv"), lambda _: "1") == exact
    assert chosen_path(spark, str(tmp_path / "#"), lambda _: "2") == exact  # none is like it: all in order
    for choice in ("", "9", "x"):
        with pytest.raises(SystemExit):
            chosen_path(spark, str(tmp_path / "Silver.mkv"), lambda _: choice)
    with pytest.raises(SystemExit):
        chosen_path(spark, str(tmp_path / "none" / "x.mkv"))


def test_cache_of_vectors(spark, tmp_path):
    folder = str(tmp_path / "cache")
    assert cached(spark, folder).count() == 0
    rows = spark.createDataFrame([("a", [1.0]), ("a", [1.0]), ("b", None), (None, [2.0])], "key string, embedding array<float>")
    for _ in range(2):
        keep(rows, folder)
    assert [tuple(r) for r in cached(spark, folder).collect()] == [("a", [1.0])]
    assert [r.key for r in missing(rows.where("key is not null"), cached(spark, folder), "key").collect()] == ["b"]
