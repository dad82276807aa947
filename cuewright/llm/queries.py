"""Queries of the training-data operators over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewright.llm.containers import fill_report, pack_documents
from cuewright.llm.history_dedup import find_repeats
from cuewright.llm.language import language_cases, languages
from cuewright.llm.mixing import mix_documents, share_report
from cuewright.llm.nearest_time import segments_with_frames
from cuewright.llm.speaker_turns import speaker_turns, turn_rows
from cuewright.llm.safety import THRESHOLD, offence_rates, offence_scores, source_name
from cuewright.llm.spectral import face_group_report, face_groups
from cuewright.llm.splitting import LIMIT, segment_items, split_oversized
from cuewright.session import ship, staged

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return segments_with_frames(table(spark, d, "media_segments"), table(spark, d, "media_frames")).select("segment_id", "frame_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return find_repeats(table(spark, d, "media_files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return turn_rows(table(spark, d, "speaker_segments")).select("turn_voice_id", "voice_id")


def p3_turns(spark: SparkSession, d: str) -> DataFrame:
    return speaker_turns(table(spark, d, "speaker_segments"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(segment_items(table(spark, d, "media_segments"), table(spark, d, "transcriptions")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).where("piece_no = 0").select("origin", "item_id", "item_no")


def p6_languages(spark: SparkSession, d: str) -> DataFrame:
    return languages(table(spark, d, "transcriptions")).drop("claimed")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return language_cases(languages(table(spark, d, "transcriptions")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return face_groups(table(spark, d, "detected_faces"), table(spark, d, "unresolved_faces"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return face_group_report(table(spark, d, "detected_faces"), table(spark, d, "unresolved_faces"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"), table(spark, d, "container_specs"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p8_containers(spark, d), table(spark, d, "container_specs"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_documents(table(spark, d, "documents"), table(spark, d, "source_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return share_report(p9_mix(spark, d), table(spark, d, "source_targets"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return offence_scores(table(spark, d, "documents"), table(spark, d, "doc_labels")).select("doc_id", "source", "score")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).where(F.col("score") >= THRESHOLD).select("doc_id").distinct()


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return offence_rates(p10_scores(spark, d))


def p3_times(spark: SparkSession, d: str) -> DataFrame:
    """Turns with their speaker, times and rows, the parts of long ones put together."""
    parts = p3_turns(spark, d).groupBy("turn_voice_id")
    return parts.agg(F.min("media_path").alias("media_path"), F.min("speaker_no").alias("speaker_no"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("n_rows").alias("n_rows"))


def p4_checks(spark: SparkSession, d: str) -> DataFrame:
    """Each text cut: a hash of its new parts put together, and how many pieces are too long or do not repeat the end before."""
    rows = p4_pieces(spark, d).withColumn("own", F.expr("substring(piece, own_start - start + 1)"))
    order = Window.partitionBy("origin", "item_id", "item_no").orderBy("piece_no")
    rows = rows.withColumn("before", F.lag("piece").over(order))
    kept = F.coalesce(F.col("before").endswith(F.expr("substring(piece, 1, own_start - start)")), F.lit(True))
    by = rows.groupBy("origin", "item_id", "item_no")  # the pieces of one text, which was one row
    by = by.agg(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "own"))), lambda x: x["own"]), "")).alias("text_hash"), F.sum((F.length("piece") > LIMIT).cast("int")).alias("too_long"), F.sum((~kept).cast("int")).alias("not_repeated"))
    return by


def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    """The runs of words of one language in segments that are foreign or mixed."""
    rows = languages(table(spark, d, "transcriptions")).where("spans is not null")
    return rows.select("transcription_id", "segment_no", "kind", F.posexplode("spans").alias("span_no", "s")).select("transcription_id", "segment_no", "kind", "span_no", "s.lang", "s.first_word", "s.words", "s.confidence")


def p7_sizes(spark: SparkSession, d: str) -> DataFrame:
    return p7_groups(spark, d).select("origin", "first_id", "faces", "occurrences")


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """By spec: documents packed, and how many containers are too full or documents cut without need or not whole."""
    specs = table(spark, d, "container_specs").select("spec_name", F.col("capacity_tokens").alias("capacity"))
    packed = staged(p8_containers(spark, d).join(F.broadcast(specs), "spec_name"), "packed")
    full = packed.groupBy("spec_name", "container").agg(F.sum("tokens").alias("n"), F.max("capacity").alias("c")).groupBy("spec_name").agg(F.sum((F.col("n") > F.col("c")).cast("int")).alias("too_full"))
    whole = packed.groupBy("spec_name", "doc_id").agg(F.sum("tokens").alias("n"), F.count("*").alias("pieces"), F.max(F.col("start_token") + F.col("tokens")).alias("last"), F.max("capacity").alias("c"))
    whole = whole.groupBy("spec_name").agg(F.count("*").alias("documents"), F.sum((F.col("pieces") != F.ceil(F.col("n") / F.col("c"))).cast("int")).alias("cut_wrongly"), F.sum((F.col("last") != F.col("n")).cast("int")).alias("not_whole"))
    return whole.join(full, "spec_name")


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """By source: its target and cap, whether it is met within half a percent of all tokens, and documents used too often or unknown to it."""
    used = staged(p9_mix(spark, d), "used")
    known = table(spark, d, "documents").where("text is not null").select("doc_id", source_name().alias("source"), F.xxhash64("text").alias("h"))
    # A text may come from any source that has it.
    texts = known.join(used.select("doc_id", F.col("source").alias("as")), "doc_id").select("doc_id", "as", "h").distinct()
    strange = texts.join(known.select("h", F.col("source").alias("as")).distinct(), ["h", "as"], "left_anti").groupBy(F.col("as").alias("source")).agg(F.count("*").alias("strange"))
    targets = table(spark, d, "source_targets")
    caps = targets.select(F.col("source_name").alias("source"), "max_repeats")
    over = used.join(F.broadcast(caps), "source").where("uses > max_repeats").groupBy("source").agg(F.count("*").alias("over_used"))
    rows = share_report(used, targets).join(strange, "source", "left").join(over, "source", "left")
    return rows.select("source", "target_share", "max_repeats", (F.abs(F.col("share") - F.col("target_share")) < 0.005).alias("met"), F.coalesce("strange", F.lit(0)).alias("strange"), F.coalesce("over_used", F.lit(0)).alias("over_used"))


def p10_checks(spark: SparkSession, d: str) -> DataFrame:
    """By source: documents scored, and scores that are no chances."""
    rows = p10_scores(spark, d).groupBy(source_name().alias("source"))
    return rows.agg(F.count("*").alias("documents"), F.sum((~F.coalesce(F.col("score").between(0, 1), F.lit(False))).cast("int")).alias("no_chances"))


def queries() -> dict[str, Query]:
    named = (
        p1_found, p2_found, p3_found, p3_turns, p3_times, p4_found, p4_pieces, p4_checks, p6_found, p6_languages, p6_spans, p7_found, p7_groups, p7_sizes,
        p8_containers, p8_fill, p8_checks, p9_mix, p9_shares, p9_checks, p10_found, p10_scores, p10_rates, p10_checks,
    )
    return {f.__name__: f for f in named}
