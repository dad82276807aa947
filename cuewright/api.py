"""The engine as a few calls: ingest tables, search, and dispatch of tool calls."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions.media import checked_hint, media_kind
from cuewright.functions.paths import stem
from cuewright.functions.text import title_and_year, title_or_stem
from cuewright.models import Adapters, Encoder, HashingEncoder, Settings, encode_texts, with_vectors
from cuewright.operators.search import both_modalities, checked_limit, face_hits, frame_hits, payload_filter, segment_hits, top_k
from cuewright.operators.segments import prepared, sentences, split_long, voice_segments
from cuewright.operators.store import PointStore
from cuewright.session import ship, staged
from cuewright.sources.media import duration_of, frame_manifest, probed, processed_frames
from cuewright.sources.subtitles import best_subtitles, parse_srt, sidecar_candidates


class Engine:
    """A point store with an encoder."""

    def __init__(self, spark: SparkSession, folder: str, encoder: Encoder | None = None, adapters: Adapters | None = None, settings: Settings | None = None):
        ship(spark)
        self.spark, self.store, self.encoder = spark, PointStore(spark, folder), encoder or HashingEncoder()
        self.adapters, self.settings = adapters or Adapters(), settings or Settings.from_env()

    def ingest_segments(self, segments: DataFrame) -> None:
        """Dialogue (video_path, text, start, end), from subtitles or recognition."""
        rows = prepared(segments)
        self.store.upsert_segments(with_vectors(rows, "text", self.encoder))

    def ingest_frames(self, frames: DataFrame) -> None:
        """Described frames (video_path, timestamp, action, and dialogue if known)."""
        rows = frames.where(F.coalesce(F.trim("action"), F.lit("")) != "")
        if "dialogue" not in rows.columns:
            rows = rows.withColumn("dialogue", F.lit(None).cast("string"))
        self.store.upsert_frames(with_vectors(rows, "action", self.encoder))

    def ingest_voices(self, voices: DataFrame) -> None:
        self.store.append_voices(voice_segments(voices))

    def ingest_faces(self, faces: DataFrame) -> None:
        for name, kind in (("name", "string"), ("cluster_id", "int"), ("video_path", "string"), ("timestamp", "double")):
            if name not in faces.columns:
                faces = faces.withColumn(name, F.lit(None).cast(kind))
        self.store.append_faces(faces)

    def ingest_assets(self, files: DataFrame) -> None:
        """Files (file_path, media_type as a hint, duration): title and year are read from the name."""
        name = stem(F.col("file_path"))
        parsed = title_and_year(name)
        rows = files.select("file_path", media_kind(F.col("file_path"), F.col("media_type")).alias("media_type"), title_or_stem(parsed["title"], name).alias("title"), parsed["year"].alias("year"), "duration")
        self.store.upsert_assets(rows)

    def ingest_files(self, files: DataFrame, listing: DataFrame | None = None) -> dict[str, int]:
        """Ingest media files (file_path, media_type as a hint): what is stored of each kind, and the frames processed.

        Durations come from the probe, dialogue from the best subtitles there are (those of the language or of
        the same name in ``listing`` (path, content), else embedded ones), and where there are none from
        recognition, folded into sentences and cut to length; voices, frames and faces from their models.
        Failed captions are put aside. A model that is missing adds nothing.
        """
        use = self.adapters
        media = staged(files.select(F.col("file_path").alias("path"), "media_type").where("path is not null").dropDuplicates(["path"]), "media")
        known = use.prober.probe(media) if use.prober else media.withColumn("probe", F.lit(None).cast("string"))
        length = staged(known.select("path", duration_of(probed(F.col("probe"))).alias("duration")), "lengths")
        self.ingest_assets(media.join(length, "path", "left").select(F.col("path").alias("file_path"), "media_type", "duration"))
        done = {"segments": 0, "voices": 0, "frames": 0, "faces": 0}

        none = self.spark.createDataFrame([], "path string, content binary")
        listing = none if listing is None else listing.select("path", "content")
        inside = use.subtitles.embedded(media.select("path")).select("path", "content") if use.subtitles else none
        candidates = sidecar_candidates(media.select("path"), listing, self.settings.language)
        candidates = candidates.unionByName(inside.select(F.col("path").alias("video_path"), F.lit("embedded").alias("kind"), "path", F.lit(None).cast("string").alias("output_path")))
        texts = listing.select(F.lit("sidecar").alias("from"), F.col("path").alias("of"), "content").unionByName(inside.select(F.lit("embedded").alias("from"), F.col("path").alias("of"), "content"))
        # A file without a cue is no subtitles, and the next one is tried.
        cues_of = parse_srt(texts.withColumn("key", F.concat("from", F.lit(":"), "of")), path="key").withColumnRenamed("video_path", "key")
        origin = F.when(F.col("kind") == "embedded", "embedded").otherwise("sidecar")
        candidates = candidates.withColumn("key", F.concat(origin, F.lit(":"), "path")).join(cues_of.select("key").distinct(), "key", "left_semi")
        chosen = best_subtitles(candidates.drop("key")).withColumn("key", F.concat(origin, F.lit(":"), "path"))
        spoken = staged(chosen.select("video_path", "key").join(cues_of, "key").select("video_path", "text", "start", "end"), "spoken")
        silent = media.select("path").join(spoken.select(F.col("video_path").alias("path")).distinct(), "path", "left_anti")
        if use.transcriber:
            segments, words = use.transcriber.recognised(silent)
            spoken = spoken.unionByName(split_long(sentences(words, segments, ["path", "segment"])).select(F.col("path").alias("video_path"), "text", "start", "end"))
        spoken = staged(spoken, "dialogue")
        done["segments"] = prepared(spoken).count()
        if done["segments"]:
            self.ingest_segments(spoken)
        if use.diariser and self.settings.voices:
            voices = staged(use.diariser.voices(media.select("path")), "voices")
            done["voices"] = voice_segments(voices).count()
            self.ingest_voices(voices)
        frames = staged(frame_manifest(length, "path", "duration", self.settings.frame_interval), "frames")
        done["frames"] = processed_frames(frames)
        if use.captioner:
            self.ingest_frames(use.captioner.describe(frames))
        if use.face_finder:
            faces = staged(use.face_finder.faces(frames).where("embedding is not null"), "faces")
            done["faces"] = faces.count()
            self.ingest_faces(faces)
        return done

    def ingest_media(self, file_path: str, media_type: str = "unknown") -> dict[str, str]:
        """Ingest one file with what lies beside it and what the models tell; errors come back as the message."""
        path = os.path.abspath(os.path.expanduser(file_path.strip().strip('"').strip("'")))
        hint = self.spark.range(1).select(checked_hint(F.lit(media_type)).alias("h")).first().h
        answer = {"file_path": path, "media_type_hint": hint}
        if not os.path.isfile(path):
            return answer | {"message": f"File not found: {path}"}
        try:
            beside = [p for p in (f"{os.path.splitext(path)[0]}{x}" for x in (f".{self.settings.language}.srt", ".srt")) if os.path.isfile(p)]
            listing = None
            if beside:
                listing = self.spark.createDataFrame([(p, bytearray(Path(p).read_bytes())) for p in beside], "path string, content binary")
            self.ingest_files(self.spark.createDataFrame([(path, hint)], "file_path string, media_type string"), listing)
        except Exception as error:
            return answer | {"message": f"Ingestion failed: {error}"}
        return answer | {"message": "Ingestion completed"}

    def _nearest(self, name: str, vector: list[float], limit: int, **options) -> DataFrame:
        points = options.pop("points", None)
        points = self.store.read(name) if points is None else points
        return top_k(points.drop("seq"), vector, limit, **options)

    def search_media(self, query: str, limit: int = 5, score_threshold: float | None = None, video_path: str | None = None, segment_type: str | None = None) -> DataFrame:
        """Dialogue most like a text, of a video or a type if one is given: score, text, start, end, video_path, type."""
        points = payload_filter(self.store.read("media_segments"), video_path=video_path, type=segment_type)
        return segment_hits(self._nearest("media_segments", encode_texts(query, self.encoder)[0], limit, threshold=score_threshold, points=points))

    def search_frames(self, query: str, limit: int = 5, score_threshold: float | None = None) -> DataFrame:
        """Frames whose description is most like a text: score, action, timestamp, video_path, type."""
        return frame_hits(self._nearest("media_frames", encode_texts(query, self.encoder)[0], limit, threshold=score_threshold))

    def search_face(self, vector: list[float], limit: int = 5, score_threshold: float | None = None) -> DataFrame:
        """Faces nearest to a vector: score, id, name, cluster_id; the score and the threshold are distances."""
        return face_hits(self._nearest("faces", vector, limit, metric="euclid", threshold=score_threshold))

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """The best frames and the best dialogue, side by side; the text is encoded once."""
        vector = encode_texts(query, self.encoder)[0]
        return both_modalities(frame_hits(self._nearest("media_frames", vector, limit)), segment_hits(self._nearest("media_segments", vector, limit)))

    def call_tool(self, name: str, arguments: str | dict) -> str:
        """A tool call as text: the query, counts, and at most five lines of each modality; errors come back as text.

        Arguments that cannot be read are none.
        """
        if isinstance(arguments, str):
            try:
                arguments = json.loads(arguments)
            except ValueError:
                arguments = {}
        arguments = arguments if isinstance(arguments, dict) else {}
        try:
            if name == "search_media":
                query = str(arguments.get("query", ""))
                rows = self.search(query, checked_limit(int(arguments.get("limit", 5)))).collect()
                lines = [f"Search results for: {query!r}"]
                for kind, mark in (("visual", "V"), ("dialogue", "D")):
                    own = [r for r in rows if r.modality == kind]
                    lines += [f"{kind.capitalize()} matches: {len(own)}", *(f"- [{mark}] {r.time} {r.file}: {r.content}" for r in own[:5])]
                return "\n".join(lines)
            if name == "ingest_media":
                got = self.ingest_media(str(arguments.get("file_path", "")), str(arguments.get("media_type", "unknown")))
                return f"Ingestion result for {got['file_path']}: {got['message']} (media_type_hint={got['media_type_hint']})"
        except Exception as error:
            return f"{name} failed with error: {error}"
        return f"Unknown tool: {name}"
