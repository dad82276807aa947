"""Subtitles in SRT form: reading, writing, and the choice among several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions.text import seconds_of, strip, timestamp_of
from cuewright.operators.ranking import numbered

CUE = r"(\d+)\s*\n(\d{2}:\d{2}:\d{2},\d{3})\s*-->\s*(\d{2}:\d{2}:\d{2},\d{3})\s*\n([\s\S]*?)(?=\n\d+\s*\n|\z)"
LEAST_SPAN, DEFAULT_SPAN = 0.2, 2.0


def cues(text: Column) -> Column:
    """Cues of an SRT text as an array of text, start, end and type; empty cues are left out.

    An empty cue takes the cue after it into its text, as the form is read by its numbers.
    """
    get = lambda i: F.regexp_extract_all(text, F.lit(CUE), F.lit(i))
    zipped = F.arrays_zip(get(2).alias("s"), get(3).alias("e"), get(4).alias("t"))
    number = lambda c: seconds_of(F.replace(c, F.lit(","), F.lit(".")))
    made = F.transform(zipped, lambda c: F.struct(strip(c["t"]).alias("text"), number(c["s"]).alias("start"), number(c["e"]).alias("end"), F.lit("dialogue").alias("type")))
    return F.filter(made, lambda c: c["text"] != "")


def decoded(content: Column) -> Column:
    """Bytes as text; what is not UTF-8 is left out, line ends become line feeds."""
    text = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))
    return F.regexp_replace(text, r"\r\n?", "\n")


def parse_srt(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Segments of subtitle files (path, content): video_path, segment_no, text, start, end, type."""
    rows = files.select(F.col(path).alias("video_path"), F.posexplode(cues(decoded(F.col(content)))).alias("segment_no", "c"))
    return rows.select("video_path", "segment_no", "c.text", "c.start", "c.end", "c.type")


def read_srt(spark: SparkSession, where: str) -> DataFrame:
    """Segments of all ``.srt`` files of a folder or a glob; missing ones give none."""
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("recursiveFileLookup", "true")
    try:
        return parse_srt(files.load(where).where(F.lower("path").endswith(".srt")).select("path", "content"))
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return parse_srt(spark.createDataFrame([], "path string, content binary"))


def cue_texts(segments: DataFrame, keys: list[str], text: str = "text", start: str = "start", end: str = "end", offset: float = 0.0) -> DataFrame:
    """Cues to be written, numbered from 1 by key in order of time: the keys, cue_no, start, end, cue.

    Blank texts, null starts and spans under 0.2 s are left out; a null end is two seconds after the
    start; ``offset`` is added to all times.
    """
    rows = segments.withColumn("_t", strip(F.col(text))).where((F.col("_t") != "") & F.col(start).isNotNull() & ~F.isnan(start))
    rows = rows.withColumn("_e", F.coalesce(F.nanvl(F.col(end), F.lit(None).cast("double")), F.col(start) + DEFAULT_SPAN)).where(F.col("_e") - F.col(start) >= LEAST_SPAN)
    rows = rows.select(*keys, F.col("_t").alias("text"), (F.col(start) + offset).alias("start"), (F.col("_e") + offset).alias("end"))
    rows = numbered(rows, keys, ["start", "end", "text"], F.floor(F.col("start") / 600), "cue_no")
    cue = F.concat(F.col("cue_no").cast("string"), F.lit("\n"), timestamp_of(F.col("start")), F.lit(" --> "), timestamp_of(F.col("end")), F.lit("\n"), F.col("text"), F.lit("\n"))
    return rows.select(*keys, "cue_no", "start", "end", "text", cue.alias("cue"))


def write_srt(segments: DataFrame, folder: str, key: str, **columns: str) -> int:
    """Write the cues of each key below ``folder``, in files that follow the order of time; their number.

    Every part of a key holds a range of its cues, so that no task writes more than a part of a long one;
    joining the parts of ``key=...`` in the order of their names gives the file.
    """
    cue_rows = cue_texts(segments, [key], **columns)
    ranged = cue_rows.repartitionByRange(key, "start").sortWithinPartitions(key, "start", "cue_no")
    ranged.select(key, "cue").write.mode("overwrite").partitionBy(key).text(folder)
    return cue_rows.count()


#: Where subtitles may come from, the best first.
PRIORITY = ("user", "sidecar_language", "sidecar", "embedded")


def best_subtitles(candidates: DataFrame) -> DataFrame:
    """The subtitles to use of each video: video_path, kind and path of the candidate that comes first.

    ``candidates`` has video_path, kind (one of ``PRIORITY``), path and output_path; sidecars that are the
    output itself do not count.
    """
    order = F.array_position(F.array(*[F.lit(x) for x in PRIORITY]), F.col("kind"))
    usable = (order > 0) & ~(F.col("kind").startswith("sidecar") & F.coalesce(F.col("path") == F.col("output_path"), F.lit(False)))
    best = candidates.where(usable & F.col("video_path").isNotNull()).groupBy("video_path").agg(F.min(F.struct(order.alias("o"), "kind", "path")).alias("b"))
    return best.select("video_path", "b.kind", "b.path")


def sidecar_candidates(videos: DataFrame, listing: DataFrame, language: str, path: str = "path") -> DataFrame:
    """Sidecar candidates of videos among the files of a listing (path)."""
    base = F.regexp_replace(F.col(path), r"(?<=[^/\\.])\.[^./\\]*$", "")
    wanted = videos.select(
        F.col(path).alias("video_path"),
        F.explode(F.array(F.struct(F.lit("sidecar_language").alias("kind"), F.concat(base, F.lit(f".{language}.srt")).alias("path")), F.struct(F.lit("sidecar").alias("kind"), F.concat(base, F.lit(".srt")).alias("path")))).alias("c"),
    )
    return wanted.select("video_path", "c.kind", "c.path").join(listing.select("path").distinct(), "path", "left_semi").withColumn("output_path", F.lit(None).cast("string"))
