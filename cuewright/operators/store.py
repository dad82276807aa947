"""Collections of points kept as Parquet, with idempotent upserts."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.functions.ids import frame_key, random_id, segment_key, uuid5
from cuewright.functions.vectors import require_dim


@dataclass(frozen=True)
class Collection:
    name: str
    dim: int
    metric: str
    key: str
    payload: str
    keyed: bool


#: Fixed value: the version of voice vectors.
VOICE_VERSION = "wespeaker_resnet34_v1_l2"
#: The collections, their vector lengths and metrics.
COLLECTIONS = {
    c.name: c
    for c in (
        Collection("media_segments", 384, "cosine", "id", "video_path string, text string, start double, end double, type string", True),
        Collection("media_frames", 384, "cosine", "id", "video_path string, timestamp double, action string, dialogue string, type string", True),
        Collection("faces", 128, "euclid", "id", "name string, cluster_id int, video_path string, timestamp double", False),
        Collection("voice_segments", 256, "cosine", "id", "media_path string, start double, end double, speaker_label string, embedding_version string", False),
        Collection("assets", 0, "cosine", "id", "file_path string, media_type string, title string, year int, duration double", True),
    )
}


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the one that comes last in the order; null keys are one group.

    The maximum is taken before the shuffle, so a key of many versions costs one row a task.
    """
    values = [c for c in rows.columns if c not in keys]
    ordered = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.xxhash64(*[F.col(c) for c in rows.columns if c in order or "map" not in dict(rows.dtypes)[c]]).alias("tie"))
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), ordered).alias("_v"))
    return best.select(*keys, *[F.col("_v")[c].alias(c) for c in values]).select(*rows.columns)


COMPACTED_AT = 12  #: writes of a collection after which they are made one


class PointStore:
    """Collections below one folder. Each write adds its own rows only; readers see whole writes.

    A write is a folder ``w<number>``, made beside the others and shown by one rename. Readers take the last
    compacted one (``w<number>-all``) and all that follow; of a keyed collection the last row of a key counts.
    After ``COMPACTED_AT`` writes they are made one, so the cost of that is spread over as many writes.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for c in COLLECTIONS.values():
            self._fs.mkdirs(self._path(f"{self.folder}/{c.name}"))

    @staticmethod
    def schema(c: Collection) -> str:
        vector = ", embedding array<float>" if c.dim else ""
        return f"id string, {c.payload}{vector}, seq bigint"

    def writes(self, name: str) -> list[str]:
        """The writes that count, in order."""
        found = sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.folder}/{name}")))
        found = [v for v in found if v.startswith("w") and self._fs.exists(self._path(f"{self.folder}/{name}/{v}/_SUCCESS"))]
        last = max((i for i, v in enumerate(found) if v.endswith("-all")), default=0)
        return found[last:]

    def _add(self, name: str, df: DataFrame, number: int, suffix: str = "") -> None:
        staging = f"{self.folder}/{name}/_tmp-{uuid.uuid4().hex}"
        df.write.parquet(staging)
        if not self._fs.rename(self._path(staging), self._path(f"{self.folder}/{name}/w{number:08d}{suffix}")):
            raise RuntimeError(f"write {number} of {name} exists")

    def collections(self) -> list[str]:
        return [c for c in COLLECTIONS if self._fs.exists(self._path(f"{self.folder}/{c}"))]

    def read(self, name: str) -> DataFrame:
        c = COLLECTIONS[name]
        writes = self.writes(name)
        if not writes:
            return self.spark.createDataFrame([], self.schema(c))
        rows = self.spark.read.schema(self.schema(c)).parquet(*[f"{self.folder}/{name}/{v}" for v in writes])
        merged = len(writes) == 1 and writes[0].endswith("-all")
        return rows if merged or not c.keyed else latest(rows, ["id"], ["seq"])

    def compact(self, name: str) -> None:
        """Make the writes of a collection one; those before the last compaction go, as readers may still be at the others."""
        writes = self.writes(name)
        if len(writes) < 2:
            return
        self._add(name, self.read(name), int(writes[-1][1:9]), "-all")
        for f in list(self._fs.listStatus(self._path(f"{self.folder}/{name}"))):
            if (v := f.getPath().getName()).startswith("w") and v < writes[0]:
                self._fs.delete(f.getPath(), True)

    def _merge(self, name: str, rows: DataFrame) -> None:
        c = COLLECTIONS[name]
        writes = self.writes(name)
        number = int(writes[-1][1:9]) + 1 if writes else 1
        if c.dim:
            rows = rows.withColumn("embedding", require_dim(F.col("embedding"), c.dim).cast("array<float>"))
        shape = T._parse_datatype_string(self.schema(c))
        self._add(name, rows.withColumn("seq", F.lit(number).cast("bigint")).select(*[F.col(f.name).cast(f.dataType) for f in shape.fields]), number)
        if len(writes) + 1 >= COMPACTED_AT:
            self.compact(name)

    def upsert_segments(self, rows: DataFrame) -> None:
        """Store dialogue segments (video_path, text, start, end, embedding); a path and start once, the last wins.

        A null start counts as 0, a null type as dialogue.
        """
        rows = rows.withColumns({"start": F.coalesce(F.col("start").cast("double"), F.lit(0.0)), "type": F.coalesce("type", F.lit("dialogue")) if "type" in rows.columns else F.lit("dialogue")})
        rows = rows.withColumns({"id": uuid5(segment_key(F.col("video_path"), F.col("start")))})
        self._merge("media_segments", rows)

    def upsert_frames(self, rows: DataFrame) -> None:
        """Store described frames (video_path, timestamp, action, dialogue, embedding); a path and time once.

        The key text is hashed twice, as its own identifier becomes the name of the stored one. Failed
        captions, which begin with an error mark, are put aside: see ``rejected_frames``.
        """
        failed = F.coalesce(F.lower("action").rlike(r"^\s*\[?(?:error|failed)\b"), F.lit(False))
        rows.where(failed).select("video_path", F.col("timestamp").cast("double").alias("timestamp"), "action").write.mode("append").parquet(self._rejected)
        rows = rows.where(~failed)
        once = uuid5(frame_key(F.col("video_path"), F.col("timestamp")))
        rows = rows.withColumns({"id": uuid5(once), "type": F.lit("visual")})
        self._merge("media_frames", rows)

    @property
    def _rejected(self) -> str:
        return f"{self.folder}/rejected/media_frames"

    def rejected_frames(self) -> DataFrame:
        """Frames whose caption failed: video_path, timestamp, action."""
        shape = "video_path string, timestamp double, action string"
        there = self._fs.exists(self._path(self._rejected))
        return self.spark.read.schema(shape).parquet(self._rejected) if there else self.spark.createDataFrame([], shape)

    def append_faces(self, rows: DataFrame) -> None:
        """Add faces with a vector, under new random identifiers."""
        rows = rows.where("embedding is not null").withColumns({"id": random_id()})
        self._merge("faces", rows)

    def append_voices(self, rows: DataFrame, version: str = VOICE_VERSION) -> None:
        """Add voice segments with a vector, under new random identifiers; other lengths fail the job."""
        rows = rows.where("embedding is not null").withColumns({"id": random_id(), "embedding_version": F.lit(version)})
        self._merge("voice_segments", rows)

    def upsert_assets(self, rows: DataFrame) -> None:
        """Store what is known of files (file_path, media_type, title, year, duration)."""
        self._merge("assets", rows.withColumns({"id": uuid5(F.col("file_path"))}))

    def close(self) -> None:
        """Nothing is held open; may be called any number of times."""


def face_clusters(faces: DataFrame) -> DataFrame:
    """Clusters of faces (cluster_id) with their number of rows and the first path, by name."""
    rows = faces.where("cluster_id is not null and cluster_id >= 0")
    return rows.groupBy("cluster_id").agg(F.count("*").alias("occurrence_count"), F.min("sample_path").alias("sample_image_path"))


def voice_profiles(voices: DataFrame, label: str = "speaker_label", start: str = "start", end: str = "end") -> DataFrame:
    """Speakers with their total time and number of segments; a null label is a group."""
    return voices.groupBy(F.col(label).alias("label")).agg(F.sum(F.col(end) - F.col(start)).alias("total_duration"), F.count("*").alias("segments"))


def mean_vectors(points: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """The mean vector of each label: label, embedding_avg."""
    one = points.select(F.col(label).alias("label"), F.posexplode(vector).alias("i", "x"))
    each = one.groupBy("label", "i").agg(F.avg("x").alias("x"))
    vectors = each.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))  # one row a dimension
    return vectors.select("label", F.transform("v", lambda p: p["x"]).alias("embedding_avg"))
