"""Clean, ordered speaker turns from diarised transcripts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions.paths import clean_path
from cuewright.functions.speakers import clean_speech, has_word
from cuewright.functions.times import finite, millis
from cuewright.operators.labels import named, speaker_numbers
from cuewright.operators.ranking import numbered
from cuewright.session import staged

RANGE_ROWS = 2_000_000  #: rows that one task scans
PART_ROWS = 500  #: rows of a turn whose texts are joined in one row
SCAN_SCHEMA = (
    "rec tinyint, pid int, voice_id bigint, turn bigint, speaker_no int, fe1 bigint, fe2 bigint, fs int, first_id bigint, le1 bigint, le2 bigint, ls int, last_turn bigint"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns within one range of the order (transcript, start, voice_id), and a summary row of its edges."""
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got).combine_chunks()
    e1, e2, spk, ids = (table.column(c).to_numpy() for c in ("e1", "e2", "speaker_no", "voice_id"))
    n = len(ids)
    at = np.arange(n)
    change = np.zeros(n, dtype=bool)
    change[1:] = (e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1]) | (spk[1:] != spk[:-1])
    opener = np.maximum.accumulate(np.where(change, at, -1))
    known = opener >= 0
    turn = pa.array(ids[np.maximum(opener, 0)], mask=~known, type=pa.int64())
    one = lambda value, kind=pa.int64(): pa.concat_arrays([pa.nulls(n, kind), pa.array([value], type=kind)])
    columns = [
        pa.array(np.r_[np.zeros(n, np.int8), np.ones(1, np.int8)]),
        pa.array(np.full(n + 1, pid, np.int32)),
        pa.concat_arrays([pa.array(ids, type=pa.int64()), pa.nulls(1, pa.int64())]),
        pa.concat_arrays([turn, pa.nulls(1, pa.int64())]),
        pa.concat_arrays([pa.array(spk, type=pa.int32()), pa.nulls(1, pa.int32())]),
        *(one(int(v)) for v in (e1[0], e2[0])),
        one(int(spk[0]), pa.int32()),
        one(int(ids[0])),
        *(one(int(v)) for v in (e1[-1], e2[-1])),
        one(int(spk[-1]), pa.int32()),
        one(int(ids[opener[-1]]) if known[-1] else None),
    ]
    names = [part.split()[0] for part in SCAN_SCHEMA.split(", ")]
    yield from pa.Table.from_arrays(columns, names=names).to_batches(max_chunksize=65536)


def turn_rows(voices: DataFrame, partitions: int | None = None) -> DataFrame:
    """The rows that belong to a turn, with the turn's opening row and its speaker number.

    Columns: turn_voice_id, voice_id, speaker_no. Left out are rows with a null path or id; with a start or end
    that is null, NaN or infinite, or an end not after the start; copies with equal path, times, label
    and text (the smallest voice_id stays; nulls count as equal); rows whose speaker is told neither by
    the label nor by a name that opens the text; and rows without a spoken word. A turn is an unbroken
    run of one speaker in the order of start_time, then voice_id. Transcripts of any length are spread
    over ranges of that order, whose edges are joined by a prefix scan over one row a range. An empty
    table gives no rows.
    """
    spark = voices.sparkSession
    path = clean_path(F.col("media_path"))
    rows = voices.where(finite(F.col("start_time")) & finite(F.col("end_time")) & (F.col("end_time") > F.col("start_time")) & F.col("voice_id").isNotNull())
    rows = rows.select(F.col("voice_id").cast("bigint").alias("voice_id"), path.alias("p"), "start_time", "end_time", "speaker_label", "transcribed_text")
    rows = named(rows.where("p is not null"), "speaker_label", "transcribed_text").select(
        "voice_id",
        F.xxhash64("p").alias("e1"),
        F.xxhash64(F.lit("second"), "p").alias("e2"),
        F.col("start_time").alias("s"),
        F.xxhash64("end_time", F.coalesce("speaker_label", F.lit("\0")), F.coalesce("transcribed_text", F.lit("\0"))).alias("h1"),
        F.xxhash64(F.coalesce("transcribed_text", F.lit("\0")), F.coalesce("speaker_label", F.lit("\0")), "end_time").alias("h2"),
        "name",
        "number",
        has_word(F.col("transcribed_text")).alias("w"),
    )
    rows = rows.where("w and name is not null")
    # Copies have one label and text, hence one name and number.
    rows = rows.groupBy("e1", "e2", "s", "h1", "h2").agg(F.min("voice_id").alias("voice_id"), F.first("name").alias("name"), F.first("number").alias("number"))
    rows = staged(rows.select("e1", "e2", "s", "voice_id", "name", "number"), "voices")
    count = rows.count()

    order = ["e1", "e2", "s", "voice_id"]
    rows = speaker_numbers(rows, ["e1", "e2"]).select(*order, "speaker_no")
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // RANGE_ROWS))
    scanned = staged(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_scan, SCAN_SCHEMA), "turns")

    line = Window.orderBy("pid")  # one row a range
    edges = scanned.where("rec = 1").withColumn("before", F.lag(F.struct("le1", "le2", "ls")).over(line))
    edges = edges.withColumn("goes_on", F.coalesce(F.col("before") == F.struct(F.col("fe1").alias("le1"), F.col("fe2").alias("le2"), F.col("fs").alias("ls")), F.lit(False)))
    edges = edges.withColumn("sure", F.coalesce("last_turn", F.when(~F.col("goes_on"), F.col("first_id"))))
    earlier = F.last("sure", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.select("pid", F.when(F.col("goes_on"), earlier).otherwise(F.col("first_id")).alias("lead"))
    found = scanned.where("rec = 0").select("pid", "voice_id", "turn", "speaker_no").join(F.broadcast(edges), "pid")
    return found.select(F.coalesce("turn", "lead").alias("turn_voice_id"), "voice_id", "speaker_no")


def speaker_turns(voices: DataFrame) -> DataFrame:
    """Clean turns: turn_voice_id, part_no, media_path, speaker_no, start_ms, end_ms, n_rows and text.

    The text joins the rows of the turn in order, without hesitations, sound notes, time marks, speaker
    names and words said twice; see ``turn_rows`` for which rows count. A turn is one row with part 0; a
    monologue of more than ``PART_ROWS`` rows comes in parts of that many, in order, so that no row grows
    with the length of a recording.
    """
    rows = staged(turn_rows(voices), "turn-rows")
    parts = rows.join(voices.select("voice_id", "media_path", "start_time", "end_time", "transcribed_text"), "voice_id")
    parts = parts.select(
        "turn_voice_id",
        "voice_id",
        "speaker_no",
        clean_path(F.col("media_path")).alias("media_path"),
        millis(F.col("start_time")).alias("s"),
        millis(F.col("end_time")).alias("e"),
        clean_speech(F.col("transcribed_text")).alias("t"),
    )
    parts = numbered(parts, ["turn_voice_id"], ["s", "voice_id"], F.floor(F.col("s") / 600_000))
    parts = parts.withColumn("part_no", F.floor((F.col("number") - 1) / PART_ROWS).cast("int"))
    turns = parts.groupBy("turn_voice_id", "part_no").agg(
        F.min("media_path").alias("media_path"),
        F.max("speaker_no").alias("speaker_no"),
        F.min("s").alias("start_ms"),
        F.max("e").alias("end_ms"),
        F.count("*").alias("n_rows"),
        F.array_sort(F.collect_list(F.struct("number", "t"))).alias("parts"),  # at most PART_ROWS
    )
    return turns.withColumn("text", F.array_join(F.transform("parts", lambda p: p["t"]), " ")).drop("parts")
