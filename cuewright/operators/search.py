"""Similarity search: exact top-k by cosine or Euclidean distance with payload filters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMITS = (1, 50)
ROUND = 6  #: digits of scores, so that ties and cut-offs do not depend on the order of additions


def payload_filter(df: DataFrame, **equal: str | None) -> DataFrame:
    """Rows whose columns equal the given values; empty and missing values filter nothing."""
    tests = [F.col(c) == v for c, v in equal.items() if v]
    return df.where(reduce(Column.__and__, tests)) if tests else df


def checked_limit(limit: int = 5) -> int:
    if not LIMITS[0] <= limit <= LIMITS[1]:
        raise ValueError(f"limit must be from {LIMITS[0]} to {LIMITS[1]}")
    return limit


def top_k(
    points: DataFrame,
    query: Sequence[float] | DataFrame,
    k: int,
    *,
    vector: str = "embedding",
    key: str = "id",
    metric: str = "cosine",
    threshold: float | None = None,
    score: str = "score",
) -> DataFrame:
    """The k best points for one query vector, best first; ties go to the smaller key.

    ``query`` is a vector or a table whose first row has the vector in its first column. Scores are
    rounded to six digits before they are compared. With cosine, points of at least ``threshold`` count,
    with ``euclid`` those at most that far. Points whose vector is null, of another length, all zero (for
    cosine) or holds a null, NaN or infinity are left out. Vectors are scored in Arrow batches, each of
    which hands on its best k, so only few rows leave a task. Give only the columns wanted: all are handed on.
    """
    near = metric == "cosine"
    if isinstance(query, DataFrame):
        row = query.first()
        if row is None or row[0] is None:
            return points.limit(0).withColumn(score, F.lit(None).cast("double"))
        query = row[0]
    q = np.array(query, dtype=np.float64)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(vector)
            sizes = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False)
            at = np.nonzero(sizes == len(q))[0]
            x = pc.list_flatten(v.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), len(q))
            with np.errstate(all="ignore"):
                value = (x @ q) / np.sqrt((x * x).sum(1)) / np.sqrt(q @ q) if near else np.sqrt(((x - q) ** 2).sum(1))
            value = np.round(value, ROUND)
            ok = np.isfinite(value)
            if threshold is not None:
                ok &= (value >= threshold) if near else (value <= threshold)
            rows = batch.take(pa.array(at[ok]))
            table = pa.Table.from_batches([rows]).append_column("_score", pa.array(value[ok]))
            order = pc.sort_indices(table, sort_keys=[("_score", "descending" if near else "ascending"), (key, "ascending")])
            yield from table.take(order[:k]).combine_chunks().to_batches()

    schema = T.StructType([*points.schema.fields, T.StructField("_score", T.DoubleType())])
    found = points.mapInArrow(best, schema).withColumnRenamed("_score", score)
    return found.orderBy(F.col(score).desc() if near else F.col(score).asc(), key).limit(k)


SENT_NUMBERS = 1 << 23  #: numbers in the vectors of queries (64 MB) sent to all tasks at once


def top_k_batched(
    points: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    vector: str = "embedding",
    key: str = "id",
    metric: str = "cosine",
    threshold: float | None = None,
    block: int = 512,
) -> DataFrame:
    """The k best points for each of many queries: query_id, key, score, rank.

    ``queries`` has query_id and vector. As many queries as ``SENT_NUMBERS`` allows are sent to all tasks, each
    of which streams its points past them, a block of queries and a batch of points a matrix product, and
    hands on its best k of each query only; more queries take further passes over the points. Points are
    never shuffled. Scores, ties and vectors that do not count are as in ``top_k``; null query ids are kept.
    """
    near = metric == "cosine"
    queries = queries.select("query_id", F.col("vector").cast("array<double>").alias("q")).where(F.col("q").isNotNull() & (F.size("q") > 0) & F.forall("q", lambda x: x.isNotNull() & ~F.isnan(x)))
    points = points.select(F.col(key).alias("p_id"), F.col(vector).cast("array<double>").alias("v"))
    size = queries.agg(F.count("*").alias("n"), F.sum(F.size("q")).alias("numbers")).first()
    passes = max(1, -(-(size.numbers or 0) // SENT_NUMBERS))
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("pass", T.IntegerType()), T.StructField("p_id", points.schema["p_id"].dataType), T.StructField("score", T.DoubleType())])
    spark = points.sparkSession
    found, names = None, None
    for turn in range(passes):
        own = queries.where(F.pmod(F.xxhash64("q", "query_id"), F.lit(passes)) == turn) if passes > 1 else queries
        asked = own.collect()  # at most about SENT_NUMBERS numbers
        groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in sorted({len(r.q) for r in asked}):
            at = [i for i, r in enumerate(asked) if len(r.q) == length]
            groups[length] = (np.array(at, np.int32), np.array([asked[i].q for i in at], np.float64))
        sent = spark.sparkContext.broadcast(groups)
        here = points.mapInArrow(_batched(sent, k, near, threshold, block, turn), schema)
        ids = spark.createDataFrame([(i, turn, r.query_id) for i, r in enumerate(asked)], T.StructType([schema.fields[0], schema.fields[1], T.StructField("query_id", queries.schema["query_id"].dataType)]))
        found, names = (here, ids) if found is None else (found.unionByName(here), names.unionByName(ids))
    order = Window.partitionBy("pass", "query").orderBy(F.col("score").desc() if near else F.col("score").asc(), "p_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(names, ["pass", "query"]).select("query_id", F.col("p_id").alias(key), "score", "rank")


def _batched(sent, k: int, near: bool, threshold: float | None, block: int, turn: int):
    """Keeps the best k points of each query over the batches of a task."""

    def best_of(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[("query", "ascending"), ("score", "descending" if near else "ascending"), ("p_id", "ascending")])
        table = table.take(order)
        query = table.column("query").to_numpy()
        first = np.r_[True, query[1:] != query[:-1]]
        place = np.arange(len(query)) - np.maximum.accumulate(np.where(first, np.arange(len(query)), 0))
        return table.filter(pa.array(place < k))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = sent.value
        held: list[pa.Table] = []
        worst = {length: np.full(len(at), -np.inf) for length, (at, _) in groups.items()}
        for batch in batches:
            v = batch.column("v")
            sizes = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False)
            for length, (at, q) in groups.items():
                rows = np.nonzero(sizes == length)[0]
                if not len(rows):
                    continue
                x = pc.list_flatten(v.take(pa.array(rows))).to_numpy(zero_copy_only=False).reshape(len(rows), length)
                ids = batch.column("p_id").take(pa.array(rows))
                with np.errstate(all="ignore"):
                    square = (x * x).sum(1)
                    for low in range(0, len(q), block):
                        part = q[low : low + block]
                        product = part @ x.T
                        if near:
                            s = product / np.sqrt((part * part).sum(1))[:, None] / np.sqrt(square)
                        else:
                            s = -np.sqrt(np.maximum((part * part).sum(1)[:, None] + square - 2 * product, 0))
                        s = np.where(np.isfinite(s), s, -np.inf)
                        edge = np.maximum(np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf), worst[length][low : low + block])
                        # Rounding may change the order by as much as a step; candidates are then computed exactly.
                        i, j = np.nonzero((s >= (edge - 3 * 10.0**-ROUND)[:, None]) & (s > -np.inf))
                        if not near:
                            s[i, j] = -np.sqrt(((part[i] - x[j]) ** 2).sum(1))
                        value = np.round(s[i, j] if near else -s[i, j], ROUND)
                        ok = np.isfinite(value)
                        if threshold is not None:
                            ok &= (value >= threshold) if near else (value <= threshold)
                        i, j, value = i[ok], j[ok], value[ok]
                        if len(i):
                            held.append(pa.table({"query": pa.array(at[low + i]), "pass": pa.array(np.full(len(i), turn, np.int32)), "p_id": ids.take(pa.array(j)), "score": pa.array(value)}))
            if sum(t.num_rows for t in held) > 4 * k * sum(len(at) for at, _ in groups.values()) + 100_000:
                held = [best_of(pa.concat_tables(held))]
                query, score = held[0].column("query").to_numpy(), held[0].column("score").to_numpy()
                full = np.bincount(query, minlength=1 + max(int(at.max()) for at, _ in groups.values())) >= k
                last = np.full(len(full), np.inf)
                np.minimum.at(last, query, score if near else -score)
                for length, (at, _) in groups.items():
                    worst[length] = np.where(full[at], last[at], -np.inf)
        if held:
            yield from best_of(pa.concat_tables(held)).combine_chunks().to_batches()

    return work


def segment_hits(hits: DataFrame) -> DataFrame:
    return hits.select("score", "text", "start", "end", "video_path", "type")


def frame_hits(hits: DataFrame) -> DataFrame:
    kind = F.coalesce("type", F.lit("visual")) if "type" in hits.columns else F.lit("visual")
    return hits.select("score", "action", "timestamp", "video_path", kind.alias("type"))


def face_hits(hits: DataFrame) -> DataFrame:
    return hits.select("score", "id", "name", "cluster_id")


def formatted(score: Column, time: Column, path: Column, content: Column, fallback: str) -> list[Column]:
    """A hit as shown: score and time with two decimals, the file, and the content or a word for it."""
    return [
        F.call_function("format_number", score, F.lit("0.00")).alias("score"),
        F.concat(F.call_function("format_number", time, F.lit("0.00")), F.lit("s")).alias("time"),
        path.alias("file"),
        F.coalesce(F.nullif(content, F.lit("")), F.lit(fallback)).alias("content"),
    ]


def both_modalities(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Frame hits and segment hits side by side, neither fused nor ranked anew: modality and the hit."""
    visual = frames.select(F.lit("visual").alias("modality"), *formatted(F.col("score"), F.col("timestamp"), F.col("video_path"), F.col("action"), "Visual scene"))
    spoken = segments.select(F.lit("dialogue").alias("modality"), *formatted(F.col("score"), F.col("start"), F.col("video_path"), F.col("text"), "Dialogue"))
    return visual.unionByName(spoken)


def shown_line(path: Column, content: Column) -> Column:
    """A hit as a line: base name or Unknown, and the first 80 characters followed by dots."""
    name = F.coalesce(F.nullif(F.regexp_extract(path, r"([^/\\]*)$", 1), F.lit("")), F.lit("Unknown"))
    return F.concat(name, F.lit(": "), F.substring(content, 1, 80), F.lit("..."))


def counts_by(hits: DataFrame, modality: str = "modality") -> DataFrame:
    return hits.groupBy(modality).agg(F.count("*").alias("hits"))


LETTERS = 64  #: groups of letters by which ratios are bounded
COUNTED = 65_535  #: characters of a query up to which its letters are counted
LONGEST = 256  #: characters of a name up to which its common subsequence with a query is measured
CHUNK = 256, 1 << 14  #: names of the greatest bounds whose subsequences are measured first, and at most at once
NAMES, PAIRS, LEAST_PAIRS = 200_000, 200_000_000, 200_000  #: names of a block at most, and pairs aimed at in a task, at most and at least


def letter_counts(texts: list[str]) -> np.ndarray:
    """How often each group of letters is in each text, at most ``COUNTED``: a row a group, a column a text."""
    out = np.zeros((LETTERS, len(texts)), np.uint16)
    for low in range(0, len(texts), 20_000):
        part = texts[low : low + 20_000]
        codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) % LETTERS
        owner = np.repeat(np.arange(len(part)), [len(t) for t in part])
        counts = np.bincount(codes * len(part) + owner, minlength=LETTERS * len(part)).reshape(LETTERS, len(part))
        out[:, low : low + len(part)] = np.minimum(counts, COUNTED)
    return out


def common_lengths(query: str, texts: list[str]) -> np.ndarray:
    """At least the length of the longest common subsequence of the query and each text.

    The bit-parallel recurrence, a bit a character of the query, over all texts at once. Characters of
    the same last byte count as equal, and those that fill short texts up as zero bytes, so it may come out too great.
    """
    words = -(-len(query) // 64)
    mask = np.zeros((words, 256), np.uint64)
    for j, c in enumerate(query):
        mask[j // 64, ord(c) & 255] |= np.uint64(1 << j % 64)
    codes = np.array(texts).view(np.uint32).reshape(len(texts), -1)
    v = [np.full(len(texts), 2**64 - 1, np.uint64) for _ in range(words)]
    for row in np.ascontiguousarray((codes & 255).astype(np.uint8).T):
        carry = None
        for w in range(words):
            same = v[w] & mask[w][row]
            total = v[w] + same
            over = total < same
            if carry is not None:
                total += carry
                over |= total < carry
            carry = over.astype(np.uint64)
            v[w] = total | (v[w] ^ same)
    return sum((np.bitwise_count(~x).astype(np.int64) for x in v), np.zeros(len(texts), np.int64))


def closest(query: str, pool: list[str], have: np.ndarray, size: np.ndarray, n: int, cutoff: float) -> list[tuple[float, str]]:
    """The n names of the pool most alike, as ratio and name; ``have`` are its ``letter_counts``, ``size`` its lengths.

    Matching blocks are a common subsequence, so its length bounds the ratio from above, and the letters
    shared bound that. Ratios are computed from the greatest bound down until no name left can be among the best.
    """
    from difflib import SequenceMatcher
    from heapq import heappush, heapreplace

    ratio = lambda shared, total: np.where(total > 0, 2.0 * shared / np.maximum(total, 1), 1.0)
    total = size + len(query)
    if len(query) <= COUNTED:
        own = letter_counts([query])[:, 0]
        shared = np.zeros(len(pool), np.uint16)
        for c in np.nonzero(own)[0]:
            shared += np.minimum(have[c], own[c])
    else:
        shared = np.minimum(size, len(query))
    bound = ratio(shared, total)
    rest = np.nonzero(bound >= cutoff)[0]
    m = SequenceMatcher()
    m.set_seq2(query)
    best: list[tuple[float, str]] = []
    chunk, most = CHUNK
    while len(rest):
        now, rest = rest, rest[:0]
        if len(now) > chunk:
            by = np.argpartition(-bound[now], chunk)
            now, rest = now[by[:chunk]], now[by[chunk:]]
        upper = bound[now]
        short = np.nonzero(size[now] <= LONGEST)[0]
        if len(short):
            common = common_lengths(query, [pool[i] for i in now[short]])
            upper[short] = np.minimum(upper[short], ratio(common, total[now[short]]))
        for k in np.argsort(-upper, kind="stable"):
            if upper[k] < cutoff or (len(best) == n and upper[k] < best[0][0]):
                break
            name = pool[now[k]]
            m.set_seq1(name)
            if (r := m.ratio()) >= cutoff:
                if len(best) < n:
                    heappush(best, (r, name))
                elif (r, name) > best[0]:
                    heapreplace(best, (r, name))
        if len(best) == n:
            rest = rest[bound[rest] >= best[0][0]]
        chunk = min(chunk * 4, most)
    return best


def close_names(queries: DataFrame, names: DataFrame, n: int = 5, cutoff: float = 0.3, first: int = 0) -> DataFrame:
    """For each query (query_id, query) the n names most alike by the ratio of matching blocks.

    The same ratio and cut-off, and the same order among equals, as ``difflib.get_close_matches``: by
    ratio, then by name, both falling. ``names`` has name; equal names count once. A task holds a block of
    names and a share of the queries, and leaves out what cannot be among the best, see ``closest``; equal queries
    are answered once. With ``first``, a query that no name is like gets the first so many names
    in their order, with a null ratio. Null queries and names are left out. Columns: query_id, name, ratio, rank.
    """
    spark = names.sparkSession
    pool = names.select("name").where("name is not null").distinct()
    asked = queries.select("query_id", "query").where("query is not null")
    known, wanted = pool.count(), asked.count()
    blocks = max(1, -(-known // NAMES))
    # At small sizes no more tasks than have something to do; else at least two a core.
    tasks = max(min(2 * spark.sparkContext.defaultParallelism, known * wanted // LEAST_PAIRS), -(-known * wanted // PAIRS), 1)
    shares = -(-tasks // blocks)
    at = lambda block, share: (F.lit(shares) * block + share).cast("int").alias("part")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = asked.withColumn("block", every(blocks)).select("query_id", "query", at(F.col("block"), F.pmod(F.xxhash64("query"), F.lit(shares))))
    right = pool.withColumn("share", every(shares)).select("name", at(F.pmod(F.xxhash64("name"), F.lit(blocks)), F.col("share")))
    # Named numbers are not coalesced, small as the parts are; with four times as many few parts meet.
    left, right = (df.repartition(4 * blocks * shares, "part") for df in (left, right))

    def work(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pool = right["name"].tolist()
        have, size = letter_counts(pool), np.array([len(x) for x in pool])
        found = {query: closest(query, pool, have, size, n, cutoff) for query in dict.fromkeys(left["query"])} if pool else {}
        out = [(query_id, name, r) for query_id, query in zip(left["query_id"], left["query"]) for r, name in found.get(query, [])]
        return pd.DataFrame(out, columns=["query_id", "name", "ratio"])

    kind = asked.schema["query_id"].dataType.simpleString()
    found = left.groupBy("part").cogroup(right.groupBy("part")).applyInPandas(work, f"query_id {kind}, name string, ratio double")
    order = Window.partitionBy("query_id").orderBy(F.col("ratio").desc(), F.col("name").desc())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    if first:
        some = [r.name for r in pool.orderBy("name").limit(first).collect()]
        rest = asked.join(ranked.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.posexplode(F.array(*[F.lit(x) for x in some]).cast("array<string>")).alias("rank", "name"))
        ranked = ranked.unionByName(rest.select("query_id", "name", F.lit(None).cast("double").alias("ratio"), (F.col("rank") + 1).alias("rank")))
    return ranked


def batches(df: DataFrame, size: int = 16) -> Iterator[list]:
    """Rows in lists of ``size``, the last one shorter, streamed to the driver partition by partition."""
    held: list = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
