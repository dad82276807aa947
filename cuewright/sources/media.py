"""What decoders give: probes, frame manifests and caches of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions.text import parsed_json

PROBE = "format struct<duration: string, format_name: string, size: string>, streams array<struct<index: int, codec_type: string, codec_name: string, width: int, height: int>>"
INTERVAL = 15.0


def probed(json: Column) -> Column:
    """A probe's answer as a struct; null where it is no JSON object."""
    return parsed_json(json, PROBE)


def duration_of(probe: Column) -> Column:
    """Seconds of a probe's format; 0 where they are missing."""
    return F.coalesce(probe["format"]["duration"].try_cast("double"), F.lit(0.0))


def frame_manifest(videos: DataFrame, path: str = "video_path", duration: str = "duration_s", interval: float = INTERVAL) -> DataFrame:
    """Frames that a decoder yields at one frame per ``interval`` seconds: video_path, frame_idx, timestamp, name.

    One row for each whole or begun interval of a positive duration; frames are ordered by number, also
    beyond four digits. Null, NaN, zero and negative durations give none.
    """
    d = F.col(duration)
    good = videos.where(d.isNotNull() & ~F.isnan(d) & (d > 0))
    n = F.ceil(d / interval).cast("int")
    rows = good.select(F.col(path).alias("video_path"), F.explode(F.sequence(F.lit(0), n - 1)).alias("frame_idx"))
    name = F.concat(F.lit("frame_"), F.when(F.col("frame_idx") < 9999, F.lpad((F.col("frame_idx") + 1).cast("string"), 4, "0")).otherwise((F.col("frame_idx") + 1).cast("string")), F.lit(".jpg"))
    return rows.withColumns({"timestamp": F.col("frame_idx") * F.lit(interval), "name": name})


def processed_frames(frames: DataFrame) -> int:
    """How many frames there are of videos with a path."""
    return frames.where("video_path is not null").count()


def missing(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not stored yet: what a cache has to compute."""
    return wanted.join(stored.select(key).distinct(), key, "left_anti")


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors kept below a folder: key, embedding; none if there is no such folder."""
    shape = "key string, embedding array<float>"
    try:
        return spark.read.schema(shape).parquet(folder)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], shape)


def keep(vectors: DataFrame, folder: str) -> None:
    """Put vectors (key, embedding) into the cache below a folder, those of keys it has not yet; null vectors are not kept."""
    rows = vectors.where("key is not null and embedding is not null").dropDuplicates(["key"])
    missing(rows, cached(vectors.sparkSession, folder), "key").select("key", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("append").parquet(folder)


def lookup_metadata(works: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Plot and cast of films and shows from two lookup tables, the first before the second.

    ``works`` has media_type, title, year; ``first`` has title, year, results (array of struct of overview
    and cast), of which the first result counts and up to five names of its cast are kept before blank ones
    go; ``second`` has title, year, response, plot, actors (a comma list) and counts where the response is
    True. Only films and shows with a title are looked up; is_processed tells whether one was found. Lookup
    tables hold a title and year once.
    """
    from cuewright.functions.text import actors_of

    on = lambda t: (F.col("title") == F.col(f"{t}_title")) & F.col("year").eqNullSafe(F.col(f"{t}_year"))
    a = first.where(F.size("results") > 0).select(F.col("title").alias("a_title"), F.col("year").alias("a_year"), F.element_at("results", 1).alias("r"))
    a = a.select("a_title", "a_year", F.col("r.overview").alias("a_plot"), F.filter(F.slice("r.cast", 1, 5), lambda x: x.isNotNull() & (x != "")).alias("a_cast"), F.lit(True).alias("a_found"))
    b = second.where(F.col("response") == "True").select(F.col("title").alias("b_title"), F.col("year").alias("b_year"), F.col("plot").alias("b_plot"), actors_of(F.col("actors")).alias("b_cast"), F.lit(True).alias("b_found"))
    asked = F.col("media_type").isin("movie", "tv") & (F.col("title") != "")
    rows = works.join(a, on("a") & asked, "left").join(b, on("b") & asked, "left")
    use_first = F.coalesce("a_found", F.lit(False))
    return rows.select(
        *works.columns,
        F.when(use_first, F.col("a_plot")).otherwise(F.col("b_plot")).alias("plot_summary"),
        F.when(use_first, F.col("a_cast")).otherwise(F.col("b_cast")).alias("cast"),
        F.coalesce("a_found", "b_found", F.lit(False)).alias("is_processed"),
    )
