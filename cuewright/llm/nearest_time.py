"""Pairing of records by nearest time within an entity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions.paths import clean_path
from cuewright.functions.times import millis, usable
from cuewright.session import staged

RANGE_ROWS = 2_000_000  #: rows (some 40 bytes each) of a range, which one task holds
SCAN_SCHEMA = (
    "rec tinyint, pid int, id bigint, t bigint, prev_t bigint, prev_id bigint, next_t bigint, next_id bigint, "
    "open_prev boolean, open_next boolean, fe1 bigint, fe2 bigint, le1 bigint, le2 bigint"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scan one range of the order (entity, time, side, id).

    Emits a row for each left record (rec 0) with its neighbours inside the range, and one
    summary row (rec 1) with the right records at both edges.
    """
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got).combine_chunks()
    e1, e2, t, side, ids = (table.column(c).to_numpy() for c in ("e1", "e2", "t", "side", "id"))
    n = len(t)
    at = np.arange(n)
    new_entity = np.ones(n, dtype=bool)
    new_entity[1:] = (e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1])
    entity = np.cumsum(new_entity)
    new_run = new_entity.copy()
    new_run[1:] |= (t[1:] != t[:-1]) | (side[1:] != side[:-1])
    run_start = np.maximum.accumulate(np.where(new_run, at, 0))
    right = side == 0
    before = np.maximum.accumulate(np.where(right, at, -1))
    after = np.minimum.accumulate(np.where(right, at, n)[::-1])[::-1]

    left = at[~right]
    b, a = before[left], after[left]
    has_b = (b >= 0) & (entity[np.maximum(b, 0)] == entity[left])
    has_a = (a < n) & (entity[np.minimum(a, n - 1)] == entity[left])
    b0 = run_start[np.maximum(b, 0)]
    a0 = np.minimum(a, n - 1)
    open_prev = np.where(has_b, b0 == 0, entity[left] == 1)
    open_next = ~has_a & (entity[left] == entity[-1])

    last = int(before[-1])
    last = last if last >= 0 and entity[last] == entity[-1] else -1
    first = int(after[0])
    first = first if first < n and entity[first] == 1 else -1
    edge = lambda i, values: None if i < 0 else int(values[i])
    last0 = int(run_start[last]) if last >= 0 else -1

    def column(values: np.ndarray, valid: np.ndarray, tail: int | None) -> pa.Array:
        head = pa.array(values, mask=~valid, type=pa.int64())
        return pa.concat_arrays([head, pa.array([tail], type=pa.int64())])

    m = len(left)
    every = np.ones(m, dtype=bool)
    none = np.zeros(m, dtype=bool)
    columns = [
        pa.array(np.r_[np.zeros(m, np.int8), np.ones(1, np.int8)]),
        pa.array(np.full(m + 1, pid, np.int32)),
        column(ids[left], every, None),
        column(t[left], every, None),
        column(t[b0], has_b, edge(last0, t)),
        column(ids[b0], has_b, edge(last0, ids)),
        column(t[a0], has_a, edge(first, t)),
        column(ids[a0], has_a, edge(first, ids)),
        pa.array(np.r_[open_prev, False]),
        pa.array(np.r_[open_next, False]),
        *(column(np.zeros(m, np.int64), none, int(v)) for v in (e1[0], e2[0], e1[-1], e2[-1])),
    ]
    names = [part.split()[0] for part in SCAN_SCHEMA.split(", ")]
    yield from pa.Table.from_arrays(columns, names=names).to_batches(max_chunksize=65536)


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    *,
    left_id: str,
    right_id: str,
    left_entity: Column,
    right_entity: Column,
    left_time: Column,
    right_time: Column,
    tolerance_s: float,
    partitions: int | None = None,
) -> DataFrame:
    """For each left record the right record of the same entity that is nearest in time.

    Both sides are put into one global order of entity and time, cut into ranges of about equal
    size wherever the cuts fall, so an entity may fill any number of ranges. Each range is scanned
    on its own; the right records at its edges are then exchanged by a prefix scan over one
    summary row a range, so that records beside a cut see past it.

    Columns of the result: ``left_id``, ``right_id``, ``diff_ms`` (right minus left). Defined cases:
    rows with a null entity or a time that is null, NaN, infinite or negative take no part; of right
    records at one time the smallest id is taken; of two equally near times the earlier; left rows
    without a partner within ``tolerance_s`` (inclusive) are left out; repeated left rows each get
    their partner; empty tables give an empty result. Only the named columns are read, so any
    others may clash.
    """
    spark = left.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(left.count() + right.count()) // RANGE_ROWS))

    def side(df: DataFrame, key: str, entity: Column, time: Column, number: int) -> DataFrame:
        rows = df.select(entity.alias("e"), time.alias("s"), F.col(key).cast("bigint").alias("id"))
        rows = rows.where(F.col("e").isNotNull() & F.col("id").isNotNull() & usable(F.col("s")))
        # Two 64-bit hashes stand for the entity, so no long names are sorted and moved.
        return rows.select(
            F.xxhash64("e").alias("e1"),
            F.xxhash64(F.lit("second"), "e").alias("e2"),
            millis(F.col("s")).alias("t"),
            F.lit(number).cast("tinyint").alias("side"),
            "id",
        )

    order = ["e1", "e2", "t", "side", "id"]
    rows = side(right, right_id, right_entity, right_time, 0).unionByName(side(left, left_id, left_entity, left_time, 1))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    scanned = staged(ranged.mapInArrow(_scan, SCAN_SCHEMA), "nearest")

    # One row a range: its number is that of the ranges, whatever the data's size.
    edges = scanned.where("rec = 1")
    last = F.struct("le1", "le2", F.col("prev_t").alias("t"), F.col("prev_id").alias("id"))
    first = F.struct("fe1", "fe2", F.col("next_t").alias("t"), F.col("next_id").alias("id"))
    tie = Window.partitionBy("le1", "le2", "prev_t")
    edges = edges.withColumn("prev_id", F.when(F.col("prev_t").isNotNull(), F.min("prev_id").over(tie)))
    earlier = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy("pid").rowsBetween(1, Window.unboundedFollowing)
    carried = edges.select(
        "pid",
        "fe1",
        "fe2",
        "le1",
        "le2",
        F.last(F.when(F.col("prev_t").isNotNull(), last), ignorenulls=True).over(earlier).alias("p"),
        F.first(F.when(F.col("next_t").isNotNull(), first), ignorenulls=True).over(later).alias("f"),
    ).select(
        "pid",
        F.when((F.col("p.le1") == F.col("fe1")) & (F.col("p.le2") == F.col("fe2")), F.struct("p.t", "p.id")).alias("p"),
        F.when((F.col("f.fe1") == F.col("le1")) & (F.col("f.fe2") == F.col("le2")), F.struct("f.t", "f.id")).alias("f"),
    )
    c = scanned.where("rec = 0").select("pid", "id", "t", "prev_t", "prev_id", "next_t", "next_id", "open_prev", "open_next")
    c = c.join(F.broadcast(carried), "pid", "left")
    prev = (
        F.when(F.col("open_prev") & F.col("prev_t").isNull(), F.struct(F.col("p.t").alias("t"), F.col("p.id").alias("id")))
        .when(
            F.col("open_prev") & (F.col("p.t") == F.col("prev_t")),
            F.struct(F.col("prev_t").alias("t"), F.least("prev_id", "p.id").alias("id")),
        )
        .otherwise(F.struct(F.col("prev_t").alias("t"), F.col("prev_id").alias("id")))
    )
    after = F.when(F.col("open_next"), F.struct(F.col("f.t").alias("t"), F.col("f.id").alias("id"))).otherwise(
        F.struct(F.col("next_t").alias("t"), F.col("next_id").alias("id"))
    )
    c = c.select(F.col("id").alias("left_id"), "t", prev.alias("b"), after.alias("a"))
    db, da = F.col("t") - F.col("b.t"), F.col("a.t") - F.col("t")
    back = da.isNull() | (db <= da)
    c = c.select(
        "left_id",
        F.when(back, F.col("b.id")).otherwise(F.col("a.id")).alias("right_id"),
        F.when(back, -db).otherwise(da).alias("diff_ms"),
    )
    return c.where(F.abs("diff_ms") <= F.lit(round(tolerance_s * 1000)))


def segments_with_frames(segments: DataFrame, frames: DataFrame, tolerance_s: float = 2.0) -> DataFrame:
    """Dialogue segments paired with the nearest frame of the same video; see ``nearest_in_time``."""
    return nearest_in_time(
        segments,
        frames,
        left_id="segment_id",
        right_id="frame_id",
        left_entity=clean_path(F.col("video_path")),
        right_entity=clean_path(F.col("video_path")),
        left_time=F.col("start_s"),
        right_time=F.col("frame_ts"),
        tolerance_s=tolerance_s,
    ).select(F.col("left_id").alias("segment_id"), F.col("right_id").alias("frame_id"), "diff_ms")
