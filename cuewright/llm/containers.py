"""Filling of containers of fixed capacity with items of varying length."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.tokens import VOCABULARY, with_token_counts
from cuewright.session import staged

Pattern = tuple[tuple[int, int], ...]  #: (length, how many) of one container
SALTS = 64
SENT_PLACES = 500_000  #: rows of the plan (some 50 bytes each) sent to all tasks at most


FREQUENT = 48  #: frequent lengths that every other length is combined with; what no combination takes is packed greedily
SWEEPS = 60  #: of the least squares, at most
ALL = 5  #: every so many sweeps all combinations are tried, in between those in use


def combinations(histogram: dict[int, int], capacity: int, window: int, frequent: int = FREQUENT) -> list[Pattern]:
    """Shallow combinations of lengths whose sum is at most ``window`` below the capacity.

    Pairs of every length with its best complement, triples of a frequent length, any other and the best
    complement, and containers filled with copies of one length and the best complement of the rest.
    """
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)

    def best(rest: np.ndarray) -> np.ndarray:
        """The greatest length of at most ``rest``, 0 if there is none."""
        k = np.searchsorted(lengths, rest, "right") - 1
        return np.where(k >= 0, lengths[np.maximum(k, 0)], 0)

    often = lengths[np.lexsort((lengths, -counts))[:frequent]]
    a, b = (x.ravel() for x in np.meshgrid(lengths, often, indexing="ij"))
    a, b = a[a + b < capacity], b[a + b < capacity]
    none = np.zeros_like(lengths)
    rows = [np.stack([lengths, none, none], 1), np.stack([lengths, best(capacity - lengths), none], 1), np.stack([a, b, best(capacity - a - b)], 1)]
    rows = np.sort(np.concatenate(rows), 1)
    total = rows.sum(1)
    rows = np.unique(rows[(total >= capacity - window) & (total <= capacity)], axis=0)
    found: set[Pattern] = set()

    def keep(parts: list[int]) -> None:
        uses = Counter(parts)
        if all(histogram[v] >= c for v, c in uses.items()):
            found.add(tuple(sorted(uses.items())))

    for row in rows.tolist():
        keep([v for v in row if v])
    for length in lengths.tolist():
        copies = min(capacity // length, histogram[length])
        for k in {copies, max(copies - 1, 1), max(copies // 2, 1)}:
            parts, left = [length] * k, capacity - k * length
            while len(parts) < k + 3 and (x := int(best(np.array(left)))):
                parts.append(x)
                left -= x
            if 0 <= left <= window:
                keep(parts)
    return sorted(found)


def nonnegative_least_squares(patterns: list[Pattern], histogram: dict[int, int], sweeps: int = SWEEPS) -> np.ndarray:
    """How often to use each pattern so that together they use up the histogram, in least squares.

    Coordinate descent: a pattern's step is exact and cut at zero. Patterns have few lengths, so a sweep
    costs as much as they have entries; most sweeps go over the patterns in use only. It ends when a sweep over
    all changes no repeat by a twentieth, as repeats are rounded down.
    """
    left = {length: float(n) for length, n in histogram.items()}
    norms = [float(sum(c * c for _, c in p)) for p in patterns]
    x = [0.0] * len(patterns)
    use: list[int] = []
    for sweep in range(sweeps):
        whole = sweep % ALL == 0
        moved = 0.0
        for k in range(len(patterns)) if whole else use:
            old = x[k]
            gain = 0.0
            for v, c in patterns[k]:
                gain += left[v] * c
            if gain <= 0.0 and old == 0.0:
                continue
            step = max(gain / norms[k], -old)
            if step:
                x[k] = old + step
                for v, c in patterns[k]:
                    left[v] -= step * c
                moved = max(moved, abs(step))
        if whole:
            use = [k for k, v in enumerate(x) if v > 0.0]
            if moved < 0.05:
                break
    return np.array(x)


def plan(histogram: dict[int, int], capacity: int, window: int | None = None) -> list[tuple[Pattern, int]]:
    """Patterns and their repeats that use up the histogram exactly.

    The repeats of the least-squares solution are rounded down, as far as items are left; what remains
    is packed greedily, the longest first with whatever fits best, equal containers at once. Works on
    distinct lengths only, at most ``capacity`` of them, however many items there are.
    """
    left = {int(k): int(v) for k, v in histogram.items() if v > 0}
    window = max(1, capacity // 128) if window is None else window
    out: list[tuple[Pattern, int]] = []
    patterns = combinations(left, capacity, window) if left else []
    if patterns:
        x = nonnegative_least_squares(patterns, left)
        for k in np.argsort(-x, kind="stable"):
            n = min([int(x[k] + 1e-6), *(left.get(v, 0) // c for v, c in patterns[k])])
            if n > 0:
                out.append((patterns[k], n))
                for v, c in patterns[k]:
                    left[v] -= c * n
        left = {k: v for k, v in left.items() if v}
    lengths = sorted(left)
    while lengths:
        parts: dict[int, int] = {}
        room = capacity
        while True:
            k = int(np.searchsorted(lengths, room, "right")) - 1
            while k >= 0 and left[lengths[k]] <= parts.get(lengths[k], 0):
                k -= 1
            if k < 0:
                break
            v = lengths[k]
            c = min(room // v, left[v] - parts.get(v, 0))
            parts[v] = parts.get(v, 0) + c
            room -= c * v
        n = min(left[v] // c for v, c in parts.items())
        out.append((tuple(sorted(parts.items())), n))
        for v, c in parts.items():
            left[v] -= c * n
        lengths = [v for v in lengths if left[v]]
    return out


def pack(items: DataFrame, specs: list[tuple[str, int]]) -> DataFrame:
    """Containers of items (item_id, tokens): spec_name, container, item_id, piece_no, start_token, tokens.

    Only items longer than the capacity are cut, into full pieces, each a container of its own, and a
    rest, which is packed like an item. Containers are planned on the histogram of lengths by
    non-negative least squares; an item's place follows from its rank among those of its length, counted
    in parts, so that a length that a great share of all items have is spread over tasks. Defined cases:
    items of no tokens are in no container; null ids are kept; repeated items are packed each; an empty
    table gives an empty result; capacities must be positive.
    """
    spark = items.sparkSession
    if any(c <= 0 for _, c in specs):
        raise ValueError("capacities must be positive")
    each = F.array(*[F.struct(F.lit(name).alias("spec_name"), F.lit(c).cast("bigint").alias("capacity")) for name, c in specs])
    rows = items.where("tokens > 0").select("item_id", F.col("tokens").cast("bigint").alias("n"), F.inline(each))
    full = F.floor(F.col("n") / F.col("capacity")).cast("int")
    rows = rows.withColumn("whole", F.when(F.col("n") > F.col("capacity"), full).otherwise(0))
    rows = rows.withColumn("rest", F.col("n") - F.col("whole") * F.col("capacity"))
    pieces = rows.where("whole > 0").select("spec_name", "capacity", "item_id", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("piece_no"))
    pieces = pieces.select(
        "spec_name",
        F.concat_ws("-", F.lit("full"), F.coalesce(F.col("item_id").cast("string"), F.lit("none")), "piece_no").alias("container"),
        "item_id",
        "piece_no",
        (F.col("piece_no") * F.col("capacity")).alias("start_token"),
        F.col("capacity").alias("tokens"),
    )
    rests = rows.where("rest > 0").select(
        "spec_name", "item_id", F.col("whole").alias("piece_no"), (F.col("whole") * F.col("capacity")).alias("start_token"), F.col("rest").alias("tokens"),
        F.pmod(F.xxhash64("item_id"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    counts = rests.groupBy("spec_name", "tokens", "salt").count()
    earlier = Window.partitionBy("spec_name", "tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("spec_name", "tokens", "salt", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    # At most as many rows as the capacities add up to, whatever the number of items.
    histograms: dict[str, dict[int, int]] = {name: {} for name, _ in specs}
    for r in counts.groupBy("spec_name", "tokens").agg(F.sum("count").alias("n")).collect():
        histograms[r.spec_name][r.tokens] = r.n
    places: list[tuple[str, int, int, int, int, int]] = []
    for name, capacity in specs:
        used: dict[int, int] = {}
        for number, (pattern, n) in enumerate(plan(histograms[name], capacity)):
            for length, c in pattern:
                at = used.get(length, 0)
                places.append((name, length, at, at + c * n, c, number))
                used[length] = at + c * n
    place = spark.createDataFrame(places, "spec_name string, tokens bigint, low bigint, high bigint, each int, pattern int")
    place = place.groupBy("spec_name", "tokens").agg(F.array_sort(F.collect_list(F.struct("low", "high", "each", "pattern"))).alias("ps"))
    rank = F.row_number().over(Window.partitionBy("spec_name", "tokens", "salt").orderBy("item_id", "piece_no")) - 1
    ranked = rests.withColumn("r", rank).join(offset, ["spec_name", "tokens", "salt"]).withColumn("r", F.col("r") + F.col("offset"))
    ranked = ranked.join(F.broadcast(place) if len(places) <= SENT_PLACES else place, ["spec_name", "tokens"])
    ranked = ranked.withColumn("p", F.filter("ps", lambda p: (p["low"] <= F.col("r")) & (F.col("r") < p["high"]))[0])
    number = F.floor((F.col("r") - F.col("p.low")) / F.col("p.each")).cast("bigint")
    mixed = ranked.select(
        "spec_name", F.concat_ws("-", F.lit("mix"), F.col("p.pattern").cast("string"), number.cast("string")).alias("container"), "item_id", "piece_no", "start_token", "tokens"
    )
    return mixed.unionByName(pieces)


def pack_documents(documents: DataFrame, specs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Documents in containers of each capacity of ``specs`` (a table of a few rows); see ``pack``."""
    wanted = [(r.spec_name, r.capacity_tokens) for r in specs.where("spec_name is not null and capacity_tokens > 0").collect()]
    sized = staged(with_token_counts(documents.select(F.col("doc_id").alias("item_id"), "text"), path=path), "sizes")
    return pack(sized, wanted).withColumnRenamed("item_id", "doc_id")


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Containers, tokens and the share of the room that is used, by spec."""
    by = packed.groupBy("spec_name").agg(
        F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"), F.count("*").alias("pieces")
    )
    by = by.join(F.broadcast(specs.select("spec_name", "capacity_tokens")), "spec_name")
    return by.withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
