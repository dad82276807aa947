"""Mixing of overlapping sources to target shares of the total size."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.safety import source_name
from cuewright.llm.tokens import VOCABULARY, with_token_counts
from cuewright.session import staged

BUCKETS = 4096


class Network:
    """A small flow network; flows by cheapest augmenting paths with node potentials."""

    def __init__(self, nodes: int):
        self.edges: list[list[list[float]]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, room: int, cost: int) -> list:
        """Adds an arc and gives it; its flow is what room its counterpart has."""
        there, back = [b, room, cost, len(self.edges[b])], [a, 0, -cost, len(self.edges[a])]
        self.edges[a].append(there)
        self.edges[b].append(back)
        return back

    def run(self, source: int, sink: int) -> int:
        n, total = len(self.edges), 0
        potential = [0] * n
        while True:
            far = [float("inf")] * n
            far[source] = 0
            came: list[tuple[int, int] | None] = [None] * n
            heap = [(0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a]:
                    continue
                for k, (b, room, cost, _) in enumerate(self.edges[a]):
                    nd = d + cost + potential[a] - potential[b]
                    if room > 0 and nd < far[b]:
                        far[b], came[b] = nd, (a, k)
                        heapq.heappush(heap, (nd, b))
            if came[sink] is None:
                return total
            potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far)]
            push, at = float("inf"), sink
            while at != source:
                a, k = came[at]
                push, at = min(push, self.edges[a][k][1]), a
            at = sink
            while at != source:
                a, k = came[at]
                edge = self.edges[a][k]
                edge[1] -= push
                self.edges[at][edge[3]][1] += push
                at = a
            total += push


def route(sizes: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    """Tokens that each membership pattern gives to each of its sources, at the least cost of repetition.

    ``sizes``: tokens of each pattern, a sorted tuple of sources. A pattern's k-th use costs k - 1 for
    each token, so that repeats are spread. Gives the tokens that could not be routed, and the flows.
    """
    names = sorted(targets)
    patterns = sorted(sizes)
    net = Network(2 + len(patterns) + len(names))
    sink = 1
    arcs = {}
    for i, p in enumerate(patterns):
        for k in range(max(targets[s][1] for s in p)):
            net.arc(0, 2 + i, sizes[p], k)
        for s in p:
            arcs[p, s] = net.arc(2 + i, 2 + len(patterns) + names.index(s), sizes[p] * targets[s][1], 0)
    quota = {s: int(total * targets[s][0]) for s in names}
    for j, s in enumerate(names):
        net.arc(2 + len(patterns) + j, sink, quota[s], 0)
    flow = net.run(0, sink)
    return sum(quota.values()) - flow, {key: int(arc[1]) for key, arc in arcs.items() if arc[1] > 0}


def largest_total(sizes: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]]) -> int:
    """The largest total for which every source can reach its share."""
    low, high = 0, sum(sizes[p] * max(targets[s][1] for s in p) for p in sizes) + 1
    while high - low > 1:
        middle = (low + high) // 2
        if route(sizes, targets, middle)[0]:
            high = middle
        else:
            low = middle
    return low


def mix(items: DataFrame, targets: list[tuple[str, float, int]], total: int | None = None, seed: int = 0) -> DataFrame:
    """Draws from items (item_id, source, key, tokens): item_id, source, uses, tokens, total_tokens.

    Items with one ``key`` (copies of one text) are one document, known by the smallest id, and may count
    for any source that a copy belongs to; it is used at most as often as the source that it counts for
    allows. Sizes are summed by membership pattern, of which there are at most 2^sources, routed by
    min-cost flow, and documents taken in an order that depends on the seed, along a circle of each
    pattern's tokens: a document is used by a source as often as the source's arc passes its middle.
    Without ``total`` the largest is taken for which all shares can be met. Defined cases: items of no
    tokens, of null key or of a source without target take no part; targets are scaled to sum 1; sources
    of no item or of share 0 are met by nothing, others then share the rest; an empty table gives none.
    """
    spark = items.sparkSession
    allowed = spark.createDataFrame([t for t in targets if t[1] > 0 and t[2] > 0], "source string, target_share double, max_repeats int")
    rows = items.where("tokens > 0 and key is not null").join(F.broadcast(allowed.select("source")), "source")
    # Copies are combined before the shuffle: the set holds at most as many sources as have targets.
    documents = rows.groupBy("key").agg(F.min("item_id").alias("item_id"), F.max("tokens").alias("tokens"), F.array_sort(F.collect_set("source")).alias("pattern"))
    documents = staged(documents.withColumn("u", F.xxhash64("key", F.lit(seed))), "documents")
    sizes = {tuple(r.pattern): int(r.n) for r in documents.groupBy("pattern").agg(F.sum("tokens").alias("n")).collect()}
    present = {s for p in sizes for s in p}
    wanted = {s: (share, repeats) for s, share, repeats in targets if s in present and share > 0 and repeats > 0}
    scale = sum(share for share, _ in wanted.values())
    wanted = {s: (share / scale, repeats) for s, (share, repeats) in wanted.items()}
    total = (largest_total(sizes, wanted) if sizes else 0) if total is None else total
    flows = route(sizes, wanted, total)[1] if sizes else {}
    arcs, start = [], {}
    for (pattern, source), flow in sorted(flows.items()):
        at = start.get(pattern, 0)
        arcs.append((list(pattern), source, at, at + flow, sizes[pattern], wanted[source][1]))
        start[pattern] = at + flow
    arcs = spark.createDataFrame(arcs, "pattern array<string>, source string, low bigint, high bigint, size bigint, cap int")

    # The place of each document on its pattern's circle: a running sum within parts of the order, after
    # the sums of the parts before.
    documents = documents.withColumn("part", F.pmod(F.shiftright("u", 40), F.lit(BUCKETS)))
    parts = documents.groupBy("pattern", "part").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("pattern").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("pattern", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("pattern", "part").orderBy("u", "item_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = documents.withColumn("run", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(parts, ["pattern", "part"])
    middle = F.col("base") + F.col("run") + F.col("tokens") / 2
    used = placed.withColumn("middle", middle).join(F.broadcast(arcs), "pattern")
    passes = F.ceil((F.col("high") - F.col("middle")) / F.col("size")) - F.ceil((F.col("low") - F.col("middle")) / F.col("size"))
    used = used.withColumn("uses", F.least(passes, F.col("cap")).cast("int")).where("uses > 0")
    return used.select("item_id", "source", "uses", "tokens", (F.col("uses") * F.col("tokens")).alias("total_tokens"))


def mix_documents(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0, path: str = VOCABULARY) -> DataFrame:
    """Documents drawn so that the sources meet their shares; ``targets`` has a row for each source."""
    wanted = [(r.source_name, r.target_share, r.max_repeats) for r in targets.where("source_name is not null and target_share is not null and max_repeats is not null").collect()]
    rows = documents.select(F.col("doc_id").alias("item_id"), source_name().alias("source"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"), "text")
    rows = rows.where("text is not null").select("item_id", "source", F.concat_ws(":", "k1", "k2").alias("key"), "text")
    sized = staged(with_token_counts(rows, path=path), "sizes")
    return mix(sized, wanted, total, seed).withColumnRenamed("item_id", "doc_id")


def share_report(used: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share, tokens, documents and most uses of a document, by source."""
    by = used.groupBy("source").agg(F.sum("total_tokens").alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    everything = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # a row a source
    by = by.select("source", "tokens", "documents", "most_uses", (F.col("tokens") / everything).alias("share"))
    names = targets.select(F.col("source_name").alias("source"), "target_share", "max_repeats")
    out = F.broadcast(names).join(by, "source", "left")
    return out.select(
        "source", "target_share", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats",
    )
