"""Ingestion of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cuewright.api import Engine
from cuewright.sources.subtitles import parse_srt

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def subtitle_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Segments of subtitle files that arrive in a folder."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.srt").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return parse_srt(files)


def ingest_subtitles(engine: Engine, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Store the dialogue of arriving subtitle files.

    The store's keys make a repeated batch change nothing, so each file counts exactly once. With ``once``
    what has arrived is taken and the query ends.
    """

    def store(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            engine.ingest_segments(batch.select("video_path", "text", "start", "end"))

    writer = subtitle_stream(engine.spark, folder).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
