"""Merging of time intervals into continuous periods, and the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.functions.paths import clean_path
from cuewright.functions.times import finite, millis
from cuewright.operators.labels import named, speaker_numbers
from cuewright.session import staged


def periods_and_gaps(intervals: DataFrame, keys: list[str], start_ms: str, end_ms: str, bucket_s: int = 600) -> DataFrame:
    """Continuous periods and the gaps between successive periods of each key.

    Overlapping intervals become one session of ``session_window``, whose gap is each row's own
    length; touching periods are joined afterwards. Sessions are formed within buckets of the start
    time, so that a key with a great share of all rows is spread over many tasks; a bucket's share
    in a period that began earlier follows from the greatest end before it, which is a running
    maximum over one row a bucket.

    Columns: the keys, ``kind`` (``period`` or ``gap``), ``start_ms``, ``end_ms``. Defined cases: rows
    with a null time or an end not after the start are left out; null keys form groups of their own;
    intervals that touch are continuous; repeated rows change nothing; an empty table gives none.
    """
    width = bucket_s * 1000
    rows = intervals.select(*keys, F.col(start_ms).cast("bigint").alias("s"), F.col(end_ms).cast("bigint").alias("e"))
    rows = rows.where(F.col("e") > F.col("s")).withColumn("b", F.floor(F.col("s") / width))
    by = [f"k{i}" for i in range(len(keys))]
    rows = rows.select(*[F.col(x).alias(y) for x, y in zip(keys, by)], "s", "e", "b")
    length = F.concat((F.col("e") - F.col("s")).cast("string"), F.lit(" milliseconds"))
    sessions = rows.groupBy(*by, "b", F.session_window(F.timestamp_millis("s"), length).alias("w")).agg(F.max("e").alias("e"))
    sessions = sessions.select(*by, "b", F.unix_millis("w.start").alias("s"), "e")

    def joined(a: DataFrame, other: DataFrame) -> DataFrame:
        extra = [c for c in other.columns if c not in (*by, "b")]
        other = other.select(*[F.col(c).alias(f"r_{c}") for c in (*by, "b")], *extra)
        on = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in (*by, "b")]
        return a.join(other, on, "left").drop(*[f"r_{c}" for c in (*by, "b")])

    buckets = Window.partitionBy(*by).orderBy("b")
    before = buckets.rowsBetween(Window.unboundedPreceding, -1)
    reach = sessions.groupBy(*by, "b").agg(F.max("e").alias("reach"))
    reach = reach.select(
        *by, "b", F.max("reach").over(before).alias("carry"), F.max("reach").over(Window.partitionBy(*by)).alias("last_end")
    )
    inside = Window.partitionBy(*by, "b").orderBy("s", "e")
    marked = joined(sessions, reach).withColumn(
        "known", F.greatest("carry", F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    )
    marked = marked.withColumn("part", F.sum((F.col("known").isNull() | (F.col("s") > F.col("known"))).cast("int")).over(inside))
    # Part 0 of a bucket continues a period of an earlier bucket; the others begin one each.
    parts = marked.groupBy(*by, "b", "part").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.first("carry").alias("carry"), F.first("last_end").alias("last_end")
    )
    heads = parts.groupBy(*by, "b").agg(
        F.max("part").alias("parts"),
        F.min(F.when(F.col("part") > 0, F.col("s"))).alias("first_start"),
        F.greatest(F.max("carry"), F.max(F.when(F.col("part") == 0, F.col("e")))).alias("prev_end"),
    )
    heads = heads.where("first_start is not null").select(
        *by, "b", "parts", F.lead("prev_end").over(buckets).alias("cut_end"), F.lead("first_start").over(buckets).alias("cut_start")
    )
    found = joined(parts.where("part > 0"), heads).withColumn("next_s", F.lead("s").over(Window.partitionBy(*by, "b").orderBy("part")))
    final = F.col("part") == F.col("parts")
    found = found.select(
        *[F.col(y).alias(x) for x, y in zip(keys, by)],
        F.col("s"),
        F.when(final, F.coalesce("cut_end", F.greatest("last_end", "e"))).otherwise(F.col("e")).alias("e"),
        F.when(final, F.col("cut_start")).otherwise(F.col("next_s")).alias("n"),
    )
    pieces = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("s").alias("start_ms"), F.col("e").alias("end_ms")),
        F.struct(F.lit("gap").alias("kind"), F.col("e").alias("start_ms"), F.col("n").alias("end_ms")),
    )
    return found.select(*keys, F.inline(pieces)).where("end_ms is not null")


def speech_periods(voices: DataFrame) -> DataFrame:
    """Periods of speech and the pauses between them, by file and speaker number.

    Speakers are told apart as in speaker turns: by the label or a name that opens the text, unreadable
    ones by the roster of all files. Rows whose interval is unusable or whose speaker is unknown are left out.
    """
    rows = named(voices.where(finite(F.col("start_time")) & finite(F.col("end_time"))), "speaker_label", "transcribed_text")
    rows = rows.select(clean_path(F.col("media_path")).alias("media_path"), "name", "number", millis(F.col("start_time")).alias("s"), millis(F.col("end_time")).alias("e"))
    rows = staged(rows.where("name is not null and media_path is not null and e > s"), "intervals")
    return periods_and_gaps(speaker_numbers(rows, ["media_path"]), ["media_path", "speaker_no"], "s", "e")
