"""Queries of the core operators over the tables of a folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions.ids import face_cache_key, frame_key, segment_key, uuid5
from cuewright.functions.media import checked_hint, kind_from
from cuewright.functions.paths import base_name, clean_path, extension, stem
from cuewright.functions.speakers import speaker_number
from cuewright.functions.text import actors_of, filled_prompt, joined_parts, json_part, model_folder, preview, seconds_of, strip, timestamp_of, title_and_year, title_or_stem
from cuewright.functions.times import usable
from cuewright.functions.vectors import box_from_corner, cosine, is_vector, l2_distance, l2_normalize, norm
from cuewright.operators.cluster import dbscan
from cuewright.operators.intervals import speech_periods
from cuewright.operators.search import (
    both_modalities, checked_limit, close_names, counts_by, face_hits, formatted, frame_hits, payload_filter, segment_hits, shown_line, top_k, top_k_batched,
)
from cuewright.models import with_vectors
from cuewright.operators.segments import DEFAULT_SPAN, prepared, sentences, split_long, voice_segments, within
from cuewright.operators.store import PointStore, face_clusters, latest, mean_vectors, voice_profiles
from cuewright.plans.oracles import ORACLES
from cuewright.session import shared_dir, ship, staged
from cuewright.sources.assets import select_assets
from cuewright.sources.media import duration_of, frame_manifest, lookup_metadata, missing, probed
from cuewright.sources.subtitles import best_subtitles, cue_texts, cues

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _points(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    points = table(spark, d, "embeddings").withColumn("kind", F.concat(F.lit("label-"), F.col("label").cast("string")))
    return points, points.where("vec_id = 0").select("embedding")


def topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    points, q = _points(spark, d)
    return top_k(points, q, 10, key="vec_id").select("vec_id", "score")


def topk_cosine_filtered(spark: SparkSession, d: str) -> DataFrame:
    points, q = _points(spark, d)
    return top_k(payload_filter(points, kind="label-3"), q, 10, key="vec_id").select("vec_id", "label", "score")


def topk_threshold(spark: SparkSession, d: str) -> DataFrame:
    points, q = _points(spark, d)
    return top_k(points, q, 50, key="vec_id", threshold=0.15).select("vec_id", "score")


def topk_euclid(spark: SparkSession, d: str) -> DataFrame:
    points, q = _points(spark, d)
    return top_k(points, q, 10, key="vec_id", metric="euclid", score="dist").select("vec_id", "dist")


def topk_batched(spark: SparkSession, d: str) -> DataFrame:
    points, _ = _points(spark, d)
    asked = points.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return top_k_batched(points, asked, 5, key="vec_id")


def topk_faces(spark: SparkSession, d: str) -> DataFrame:
    faces = table(spark, d, "detected_faces").where(is_vector(F.col("embedding"), 128))
    faces = faces.where(norm(F.col("embedding")) > 0).withColumn("unit", l2_normalize(F.col("embedding")))
    asked = faces.where("face_id % 50 = 0").select(F.col("face_id").alias("query_id"), F.col("unit").alias("vector"))
    return top_k_batched(faces, asked, 3, vector="unit", key="face_id", metric="euclid", threshold=0.5)


def search_facade(spark: SparkSession, d: str) -> DataFrame:
    points, q = _points(spark, d)
    named = points.withColumns({"video_path": F.concat(F.lit("/v/"), F.col("label").cast("string"), F.lit(".mkv")), "t": F.col("vec_id").cast("double") / 4})
    frames = top_k(named.where("label < 5"), q, 10, key="vec_id").select("score", F.col("t").alias("timestamp"), "video_path", F.lit("").alias("action"))
    spoken = top_k(named.where("label >= 5"), q, 10, key="vec_id").select("score", F.col("t").alias("start"), "video_path", F.concat(F.lit("line "), F.col("vec_id").cast("string")).alias("text"))
    return both_modalities(frames, spoken)


def hit_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts_by(search_facade(spark, d))


def hit_format(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "media_frames").where(usable(F.col("frame_ts")))
    return rows.select("frame_id", *formatted(F.col("frame_ts") / 7, F.col("frame_ts"), F.col("video_path"), F.col("action_text"), "Visual scene"))


def hit_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "media_segments").where("seg_text is not null")
    return rows.select("segment_id", shown_line(F.col("video_path"), F.col("seg_text")).alias("line"))


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return rows.select("vec_id", F.round(norm(F.col("embedding")), 6).alias("length"), F.round(norm(l2_normalize(F.col("embedding"))), 6).alias("unit_length"))


def vector_pairs(spark: SparkSession, d: str) -> DataFrame:
    points, q = _points(spark, d)
    q = F.array(*[F.lit(float(x)) for x in q.first().embedding])
    return points.select("vec_id", F.round(cosine(F.col("embedding"), q), 6).alias("cos"), F.round(l2_distance(F.col("embedding"), q), 6).alias("dist"))


def face_validity(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "detected_faces").select(is_vector(F.col("embedding"), 128).alias("valid"))
    return rows.groupBy("valid").agg(F.count("*").alias("faces"))


def face_boxes(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "detected_faces").where("bbox is not null").select("face_id", "bbox.*")
    box = box_from_corner(F.col("box_left") + 0.75, F.col("box_top") + 0.25, F.col("box_right") - F.col("box_left"), F.col("box_bottom") - F.col("box_top"))
    return b.select("face_id", box.alias("b")).select("face_id", "b.top", "b.right", "b.bottom", "b.left")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "media_segments").select("segment_id", "video_path", F.col("seg_text").alias("text"), F.nanvl("start_s", F.lit(None).cast("double")).alias("start"), F.col("end_s").alias("end"), F.col("seg_type").alias("type"))


def prepare_segments(spark: SparkSession, d: str) -> DataFrame:
    return prepared(_segments(spark, d)).select("segment_id", "text", "start", "end", "type")


def segments_within(spark: SparkSession, d: str) -> DataFrame:
    return within(prepared(_segments(spark, d)), 60.0, 120.0).select("segment_id", "start", "end")


def voice_clamp(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "speaker_segments").where("not isnan(start_time) and not isnan(end_time)")
    rows = rows.select("voice_id", F.col("start_time").alias("start"), (F.col("start_time") + (F.col("end_time") - F.col("start_time")) * 5).alias("end"))
    return voice_segments(rows, embedding=None).select("voice_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def voice_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "speaker_segments").where("not isnan(start_time) and not isnan(end_time) and end_time > start_time")
    rows = rows.withColumn("label", speaker_number(F.col("speaker_label"), F.col("transcribed_text")))
    return voice_profiles(rows, "label", "start_time", "end_time").withColumn("total_duration", F.round("total_duration", 3))


def face_cluster_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "unresolved_faces").select(F.pmod("cluster_id", F.lit(17)).cast("int").alias("cluster_id"), F.nullif(F.trim("sample_image_path"), F.lit("")).alias("sample_path"))
    return face_clusters(rows)


def mean_vector(spark: SparkSession, d: str) -> DataFrame:
    rows = mean_vectors(table(spark, d, "embeddings"), "label")
    return rows.select("label", F.round(F.col("embedding_avg")[0], 6).alias("first"), F.round(norm(F.col("embedding_avg")), 6).alias("length"))


def _works(spark: SparkSession, d: str) -> DataFrame:
    """Files with title and year read once: file_id, stem, p, kind, guessed, hint."""
    path = clean_path(F.col("path"))
    rows = table(spark, d, "media_files").select("file_id", path.alias("path"), "media_type").withColumn("stem", stem(F.col("path")))
    rows = rows.withColumn("p", title_and_year(F.col("stem")))
    rows = rows.withColumn("guessed", kind_from(F.col("path"), F.lit("unknown"), F.col("p")))
    hint = checked_hint(F.col("media_type"))
    return rows.select("file_id", "path", "stem", "p", hint.alias("hint"), F.when(hint != "unknown", hint).otherwise(F.col("guessed")).alias("kind"), "guessed")


def media_types(spark: SparkSession, d: str) -> DataFrame:
    return _works(spark, d).select("file_id", "hint", "kind", "guessed")


def titles(spark: SparkSession, d: str) -> DataFrame:
    return _works(spark, d).select("file_id", F.col("p.title").alias("title"), F.col("p.year").alias("year"), title_or_stem(F.col("p.title"), F.col("stem")).alias("shown"))


def scanned_assets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "media_files").select("file_id", clean_path(F.col("path")).alias("path"), F.col("size_bytes").alias("file_size_bytes"))
    return select_assets(rows, excluded=["backup", "inbox", "cam00"]).select("file_id", "media_type", "file_size_bytes")


def scanned_defaults(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "media_files").select("file_id", clean_path(F.col("path")).alias("path"))
    return select_assets(rows).select("file_id", "media_type")


def asset_table(spark: SparkSession, d: str) -> DataFrame:
    length = table(spark, d, "transcriptions").groupBy(clean_path(F.col("media_path")).alias("path")).agg(F.max("duration_s").alias("duration"))
    rows = _works(spark, d).join(length, "path", "left")
    return rows.select("file_id", "kind", F.col("p.title").alias("title"), F.col("p.year").alias("year"), F.coalesce("duration", F.lit(0.0)).alias("duration"))


def metadata_lookup(spark: SparkSession, d: str) -> DataFrame:
    works = staged(_works(spark, d).select("file_id", F.col("kind").alias("media_type"), F.col("p.title").alias("title"), F.col("p.year").alias("year")), "works")
    known = works.where("year is not null and title <> ''").groupBy("title", "year").agg(F.min("file_id").alias("i"))
    text = lambda start: F.concat(F.lit(start), F.col("i").cast("string"))
    cast = F.array(F.lit(""), text("A"), F.lit("B"), F.lit("C"), F.lit("D"), F.lit("E"))
    result = F.array(F.struct(text("plot ").alias("overview"), cast.alias("cast")))
    first = known.select("title", "year", F.when(F.col("i") % 3 == 0, result).otherwise(F.slice(result, 1, 0)).alias("results"))
    second = known.select("title", "year", F.when(F.col("i") % 4 == 0, "True").otherwise("False").alias("response"), text("other ").alias("plot"), F.lit(" X, ,Y ").alias("actors"))
    found = lookup_metadata(works, first, second)
    return found.select("file_id", "plot_summary", F.array_join("cast", "|").alias("cast"), "is_processed")


def actor_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", actors_of(F.col("text")).alias("a"))
    return rows.select("doc_id", F.size("a").alias("actors"), F.array_join("a", "|").alias("names"))


def model_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```")).alias("answer"))
    return rows.select("event_id", json_part(F.col("answer")).alias("part"), F.get_json_object(json_part(F.col("answer")), "$.k").cast("bigint").alias("k"))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" {{JSON_SCHEMA}} {{FEW_SHOT}}"))).otherwise(F.col("p_name")).alias("t"), "p_type")
    return rows.select("p_partkey", filled_prompt(F.col("t"), F.lit("{}"), F.col("p_type")).alias("prompt"))


def point_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "media_segments").where("video_path is not null and start_s is not null and not isnan(start_s)")
    key = segment_key(F.col("video_path"), F.col("start_s"))
    return rows.select("segment_id", uuid5(key).alias("id"), (uuid5(key) == F.col("point_id")).alias("as_stored"))


def frame_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "media_frames").where(F.col("video_path").isNotNull() & usable(F.col("frame_ts")))
    return rows.select("frame_id", uuid5(frame_key(F.col("video_path"), F.col("frame_ts"))).alias("id"))


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "media_segments").select("point_id", "segment_id", "ingested_at", F.sha1(F.coalesce("seg_text", F.lit(""))).alias("text_hash"))
    return latest(rows, ["point_id"], ["ingested_at", "segment_id"]).select("point_id", "segment_id", "text_hash")


def cache_misses(spark: SparkSession, d: str) -> DataFrame:
    return missing(table(spark, d, "documents"), table(spark, d, "doc_labels"), "doc_id").select("doc_id", "source")


def frames_of_videos(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "transcriptions").select(F.concat(F.lit("t"), F.col("transcription_id").cast("string")).alias("video_path"), "duration_s")
    return frame_manifest(rows)


def srt_cues(spark: SparkSession, d: str) -> DataFrame:
    rows = _segments(spark, d).select(F.coalesce(clean_path(F.col("video_path")), F.lit("-")).alias("path"), "text", "start", F.nanvl("end", F.lit(None).cast("double")).alias("end"))
    return cue_texts(rows, ["path"]).select("path", "cue_no", timestamp_of(F.col("start")).alias("from_ts"), timestamp_of(F.col("end")).alias("to_ts"), "text")


def srt_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = _segments(spark, d).select("segment_id", F.regexp_replace("text", r"\s+", " ").alias("text"), "start", F.nanvl("end", F.lit(None).cast("double")).alias("end"))
    written = cue_texts(rows, ["segment_id"]).select("segment_id", F.explode(cues(F.col("cue"))).alias("c"))
    return written.select("segment_id", F.round("c.start", 3).alias("start"), F.round("c.end", 3).alias("end"), F.col("c.text").alias("text"))


def srt_times(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", (F.col("value") * 37).alias("s"))
    return rows.select("event_id", timestamp_of(F.col("s")).alias("shown"), seconds_of(F.replace(timestamp_of(F.col("s")), F.lit(","), F.lit("."))).alias("seconds"))


def subtitle_choice(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("sidecar", "user", "embedded", "sidecar_language", "other")])
    rows = table(spark, d, "media_segments").where("video_path is not null").select(
        clean_path(F.col("video_path")).alias("video_path"),
        F.element_at(kinds, (F.pmod("segment_id", F.lit(5)) + 1).cast("int")).alias("kind"),
        F.concat(F.lit("/subs/"), F.lpad(F.pmod("segment_id", F.lit(97)).cast("string"), 2, "0"), F.lit(".srt")).alias("path"),
        F.lit("/subs/05.srt").alias("output_path"),
    )
    return best_subtitles(rows)


def long_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "transcriptions").select("transcription_id", F.posexplode("segments").alias("segment_no", "s"))
    rows = rows.select("transcription_id", "segment_no", F.col("s.seg_text").alias("text"), F.col("s.start_s").alias("start"), F.col("s.end_s").alias("end"))
    out = split_long(rows).where("start is not null")
    return out.select("transcription_id", "segment_no", "piece_no", F.regexp_replace(strip(F.col("text")), r"\s+", " ").alias("text"), F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


def sentence_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "transcriptions").select("transcription_id", F.posexplode("segments").alias("segment_no", "s"))
    rows = rows.select("transcription_id", "segment_no", F.coalesce("s.seg_text", F.lit("")).alias("text"), F.col("s.start_s").alias("start"), F.coalesce("s.end_s", F.col("s.start_s") + DEFAULT_SPAN).alias("end")).where("start is not null")
    keys = ["transcription_id", "segment_no"]
    words = rows.select(*keys, "start", "end", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("ws"))
    words = words.select(*keys, "start", ((F.col("end") - F.col("start")) / F.size("ws")).alias("step"), F.posexplode("ws").alias("word_idx", "w"))
    at = lambda k: F.col("start") + F.col("step") * (F.col("word_idx") + k)
    words = words.select(*keys, "word_idx", F.concat(F.lit(" "), "w").alias("word"), at(0).alias("start"), at(1).alias("end"))
    out = sentences(words, rows, keys)
    shown = lambda c: F.round(F.col(c) + 1e-7, 4).alias(c)  # noqa: E731  # halves go up, whatever the order of additions
    return out.select(*keys, "sentence_no", "text", shown("start"), shown("end"))


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return dbscan(table(spark, d, "embeddings"), key="vec_id", eps=1.13, min_samples=3).withColumn("cluster", F.col("cluster").cast("bigint"))


def fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "media_files").select("file_id", base_name(clean_path(F.col("path"))).alias("name")).where(extension(F.col("name")).isin("mp4", "mkv", "avi", "mov", "webm"))
    asked = files.where("file_id % 50 = 0").select(F.col("file_id").alias("query_id"), F.upper("name").alias("query"))
    return close_names(asked, files).withColumn("ratio", F.round("ratio", 6))


def _named(spark: SparkSession, d: str) -> tuple[DataFrame, list[float]]:
    """The points with what is stored of segments, frames and faces, and the vector asked for."""
    points, q = _points(spark, d)
    at = F.col("vec_id").cast("double") / 4
    both = {"id": F.lpad(F.col("vec_id").cast("string"), 8, "0"), "video_path": F.concat(F.lit("/v/"), F.col("label").cast("string"), F.lit(".mkv")), "text": F.concat(F.lit("line "), F.col("vec_id").cast("string")), "start": at, "end": at + 2}
    both |= {"type": F.when(F.col("vec_id") % 3 > 0, "dialogue"), "action": F.concat(F.lit("scene "), F.col("vec_id").cast("string")), "timestamp": at, "name": F.lit(None).cast("string"), "cluster_id": F.col("label")}
    return points.withColumns(both), q.first().embedding


def hit_segments(spark: SparkSession, d: str) -> DataFrame:
    points, q = _named(spark, d)
    return segment_hits(top_k(payload_filter(points, video_path="/v/3.mkv", type="dialogue"), q, 7))


def hit_frames(spark: SparkSession, d: str) -> DataFrame:
    points, q = _named(spark, d)
    return frame_hits(top_k(points, q, checked_limit(50), threshold=0.05))


def hit_faces(spark: SparkSession, d: str) -> DataFrame:
    points, q = _named(spark, d)
    return face_hits(top_k(points, q, 5, metric="euclid"))


def path_hits(spark: SparkSession, d: str) -> DataFrame:
    points, q = _named(spark, d)
    return top_k(payload_filter(points, video_path="/v/5.mkv", type=""), q, 10).select("vec_id", "score")


def _store(spark: SparkSession) -> PointStore:
    return PointStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    """All segments stored, then those of over three seconds again with another text: the last text of a key counts."""
    store = _store(spark)
    rows = latest(prepared(table(spark, d, "media_segments").select("segment_id", "ingested_at", "video_path", F.col("seg_text").alias("text"), F.nanvl("start_s", F.lit(None).cast("double")).alias("start"), F.nanvl("end_s", F.lit(None).cast("double")).alias("end"), F.lit("dialogue").alias("type")).where("video_path is not null")), ["video_path", "start"], ["ingested_at", "segment_id"])
    rows = staged(with_vectors(rows, "text"), "rows")
    store.upsert_segments(rows)
    store.upsert_segments(rows.where(F.col("end") - F.col("start") > 3).withColumn("text", F.concat(F.lit("again: "), "text")))
    return store.read("media_segments").select("id", "video_path", "start", "end", F.sha1("text").alias("text_hash"), "type", F.size("embedding").alias("dim"))


def store_append(spark: SparkSession, d: str) -> DataFrame:
    """Faces with a usable vector appended twice under new identifiers: the number of rows and of identifiers by path."""
    store = _store(spark)
    rows = table(spark, d, "detected_faces").where(is_vector(F.col("embedding"), 128))
    rows = rows.select(F.col("embedding"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("cluster_id"), clean_path(F.col("video_path")).alias("video_path"), F.col("frame_ts").alias("timestamp"))
    for _ in range(2):
        store.append_faces(rows)
    return store.read("faces").groupBy("video_path").agg(F.count("*").alias("faces"), F.count_distinct("id").alias("ids"))


def store_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames stored by path and time; failed captions are put aside and counted beside those stored."""
    store = _store(spark)
    rows = table(spark, d, "media_frames").where(F.col("video_path").isNotNull() & usable(F.col("frame_ts")) & (strip(F.coalesce("action_text", F.lit(""))) != ""))
    rows = latest(rows.select("frame_id", "video_path", F.col("frame_ts").alias("timestamp"), F.col("action_text").alias("action")), ["video_path", "timestamp"], ["frame_id"])
    rows = rows.select("video_path", "timestamp", "action", F.lit(None).cast("string").alias("dialogue"), F.array_repeat(F.lit(0.5).cast("float"), 384).alias("embedding"))
    for _ in range(2):
        store.upsert_frames(rows)
    kept = store.read("media_frames").select("video_path", F.lit("stored").alias("state"))
    aside = store.rejected_frames().select("video_path", "timestamp").distinct().select("video_path", F.lit("failed").alias("state"))
    return kept.unionByName(aside).groupBy("video_path", "state").agg(F.count("*").alias("frames"))


def voice_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.lit(1.0).alias("start"), (F.lit(1.0) + F.col("label")).alias("end"), F.when(F.col("label") != 4, F.col("embedding")).alias("embedding"))
    return voice_segments(rows).select("vec_id", "end", F.round(norm(F.col("embedding")), 6).alias("length"), F.round(F.col("embedding")[0], 6).alias("first"))


def written_cues(spark: SparkSession, d: str) -> DataFrame:
    rows = _segments(spark, d).select(F.coalesce(clean_path(F.col("video_path")), F.lit("-")).alias("path"), "text", "start", F.nanvl("end", F.lit(None).cast("double")).alias("end"))
    return cue_texts(rows, ["path"]).groupBy("path").agg(F.count("*").alias("cues"))


def frame_counts(spark: SparkSession, d: str) -> DataFrame:
    frames = frame_manifest(table(spark, d, "transcriptions").select(clean_path(F.col("media_path")).alias("video_path"), "duration_s"))
    return frames.groupBy("video_path").agg(F.count("*").alias("frames"), F.max("timestamp").alias("last"))


def message_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents")
    model = F.concat(F.lit("org/"), F.coalesce("source", F.lit("none")))
    return rows.select("doc_id", preview(F.col("text"), 30).alias("preview"), model_folder(model).alias("folder"), joined_parts(F.array(F.lit(" "), F.col("lang"), F.lit(None).cast("string"), F.col("source"))).alias("parts"))


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "detected_faces").where("bbox is not null and video_path is not null")
    box = F.struct(F.col("bbox.box_top").alias("top"), F.col("bbox.box_right").alias("right"), F.col("bbox.box_bottom").alias("bottom"), F.col("bbox.box_left").alias("left"))
    return rows.select("face_id", face_cache_key(F.col("video_path"), box, "v1").alias("key"))


def probe_answers(spark: SparkSession, d: str) -> DataFrame:
    json = F.when(F.col("duration_s").isNull(), F.lit("broken")).otherwise(F.concat(F.lit('{"format": {"duration": "'), F.format_string("%.3f", "duration_s"), F.lit('"}}')))
    return table(spark, d, "transcriptions").select("transcription_id", F.round(duration_of(probed(json)), 3).alias("seconds"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return speech_periods(table(spark, d, "speaker_segments"))


def queries() -> dict[str, Query]:
    named = (
        topk_cosine, topk_cosine_filtered, topk_threshold, topk_euclid, topk_batched, topk_faces, search_facade, hit_counts, hit_format, hit_lines,
        vector_norms, vector_pairs, face_validity, face_boxes, prepare_segments, segments_within, voice_clamp, voice_profile, face_cluster_counts,
        mean_vector, media_types, titles, scanned_assets, asset_table, metadata_lookup, actor_lists, model_answers, prompts, point_ids, frame_ids,
        upsert_latest, cache_misses, frames_of_videos, srt_cues, srt_round_trip, srt_times, subtitle_choice, long_chunks, sentence_fold, clusters,
        fuzzy_names, hit_segments, hit_frames, hit_faces, path_hits, store_upsert, store_append, store_frames, voice_vectors, written_cues,
        frame_counts, message_texts, cache_keys, probe_answers, scanned_defaults, p5_found,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
