"""Preparation of timed text and speech."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewright.functions.text import strip
from cuewright.functions.vectors import l2_normalize

DEFAULT_SPAN = 2.0
MAX_SEGMENT = 8.0
MAX_SENTENCE = 6.0
VOICE_LEAST, VOICE_MOST = 0.8, 30.0


def prepared(df: DataFrame, text: str = "text", start: str = "start", end: str = "end", kind: str = "type") -> DataFrame:
    """Segments ready to be stored: text stripped, blank texts and null starts left out, a null end two
    seconds after the start, and ``kind`` set to dialogue. Other columns are kept."""
    out = df.withColumn(text, strip(F.col(text))).where((F.col(text) != "") & F.col(start).isNotNull())
    begin = F.col(start).cast("double")
    return out.withColumns({start: begin, end: F.coalesce(F.col(end).cast("double"), begin + DEFAULT_SPAN), kind: F.lit("dialogue")})


def with_boundary(df: DataFrame, chunk: str = "timestamp") -> DataFrame:
    """Recognised chunks, which carry a struct of start and end, with these as columns of their own."""
    return df.withColumns({"start": F.col(f"{chunk}.start"), "end": F.col(f"{chunk}.end")})


def split_long(df: DataFrame, text: str = "text", start: str = "start", end: str = "end", longest: float = MAX_SEGMENT) -> DataFrame:
    """Chunks longer than ``longest`` seconds cut into equal bins of time and of words.

    A chunk of d seconds has floor((d + longest - 1e-9) / longest) + 1 bins, each of (words // bins, at
    least one) words, what is left over in the last. Bins without words are dropped. Chunks with a null
    start or end pass as they are, blank ones are dropped.
    """
    df = df.where(F.coalesce(strip(F.col(text)), F.lit("")) != "")
    d = F.col(end) - F.col(start)
    df = df.withColumn("_w", F.filter(F.split(F.regexp_replace(strip(F.col(text)), r"\s+", " "), " "), lambda w: w != ""))
    df = df.withColumn("_n", F.when(d > longest, F.floor((d + longest - 1e-9) / longest) + 1).otherwise(F.lit(1)).cast("int"))
    df = df.withColumn("_per", F.greatest(F.floor(F.size("_w") / F.col("_n")), F.lit(1)).cast("int"))
    df = df.withColumn("_last", (F.least(F.col("_n"), F.ceil(F.size("_w") / F.col("_per"))) - 1).cast("int"))

    def piece(i: Column) -> Column:
        size = F.when(i == F.col("_last"), F.size("_w")).otherwise(F.col("_per"))
        return F.struct(
            F.array_join(F.slice("_w", i * F.col("_per") + 1, size), " ").alias("t"),
            (F.col(start) + i * (d / F.col("_n"))).alias("s"),
            (F.col(start) + (i + 1) * (d / F.col("_n"))).alias("e"),
        )

    whole = F.array(F.struct(F.col(text).alias("t"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e")))
    pieces = F.when(F.col("_n") > 1, F.transform(F.sequence(F.lit(0), F.col("_last")), piece)).otherwise(whole)
    rest = [c for c in df.columns if c not in (text, start, end, "_w", "_n", "_per", "_last")]
    out = df.select(*rest, F.posexplode(pieces).alias("piece_no", "_p"))
    return out.select(*rest, "piece_no", F.col("_p.t").alias(text), F.col("_p.s").alias(start), F.col("_p.e").alias(end))


def folded_sentences(words: Column, longest: float = MAX_SENTENCE) -> Column:
    """Sentences (text, start, end) of an array of words (word, start, end), sorted by their place.

    A sentence ends with a word that ends more than ``longest`` seconds after its start or in ``?``, ``.``
    or ``!``; the next starts where it ended. Words carry their own leading space.
    """
    empty = F.from_json(F.lit("[]"), "array<struct<text:string,start:double,end:double>>")
    state = F.struct(words[0]["start"].cast("double").alias("start"), F.lit("").alias("acc"), F.lit(0.0).alias("last"), empty.alias("out"))

    def step(s: Column, w: Column) -> Column:
        text = F.concat(s["acc"], w["word"])
        flush = ((w["end"] - s["start"]) > longest) | strip(w["word"]).rlike(r"[?.!]$")
        done = F.struct(strip(text).alias("text"), s["start"].alias("start"), w["end"].cast("double").alias("end"))
        return F.struct(
            F.when(flush, w["end"].cast("double")).otherwise(s["start"]).alias("start"),
            F.when(flush, "").otherwise(text).alias("acc"),
            w["end"].cast("double").alias("last"),
            F.when(flush, F.array_append(s["out"], done)).otherwise(s["out"]).alias("out"),
        )

    def finish(s: Column) -> Column:
        rest = F.struct(strip(s["acc"]).alias("text"), s["start"].alias("start"), s["last"].alias("end"))
        return F.when(s["acc"] != "", F.array_append(s["out"], rest)).otherwise(s["out"])

    return F.aggregate(words, state, step, finish)


def sentences(words: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Sentences of recognised segments from their words.

    ``words``: the keys, word_idx, word, start, end; ``segments``: the keys, text, start, end. Segments
    without words are one sentence. The words of one segment, a few seconds of speech, are gathered.
    """
    grouped = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("word_idx", "word", "start", "end"))).alias("ws"))
    joined = segments.join(grouped, keys, "left")
    whole = F.array(F.struct(strip(F.col("text")).alias("text"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")))
    out = joined.select(*keys, F.posexplode(F.when(F.size("ws") > 0, folded_sentences(F.col("ws"))).otherwise(whole)).alias("sentence_no", "x"))
    return out.select(*keys, "sentence_no", "x.text", "x.start", "x.end")


def voice_segments(df: DataFrame, start: str = "start", end: str = "end", embedding: str | None = "embedding") -> DataFrame:
    """Voice segments of use: shorter than 0.8 s left out, longer than 30 s cut to 30 s, and with a
    vector, if ``embedding`` names one, which is scaled to length one."""
    length = F.col(end) - F.col(start)
    out = df.where(length >= VOICE_LEAST).withColumn(end, F.least(F.col(end), F.col(start) + VOICE_MOST))
    if embedding:
        out = out.where(F.col(embedding).isNotNull()).withColumn(embedding, l2_normalize(F.col(embedding)))
    return out


def within(df: DataFrame, start_s: float | None, end_s: float | None, start: str = "start", end: str = "end") -> DataFrame:
    """Segments that lie inside a range of time; an end that is not given leaves that side open."""
    if start_s is not None:
        df = df.where(F.col(start) >= start_s)
    return df if end_s is None else df.where(F.col(end) <= end_s)
