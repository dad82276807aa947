"""Density-based clustering of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.operators.components import components
from cuewright.session import staged

BLOCK = 4096  #: rows of each of the two blocks that one task compares


def _near(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    out = np.empty((len(a), len(b)), bool)
    for i in range(0, len(a), 512):
        d2 = (a[i : i + 512] ** 2).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a[i : i + 512] @ b.T
        close = np.abs(d2 - eps * eps) < 1e-6 * max(1.0, eps * eps)
        out[i : i + 512] = d2 <= eps * eps
        for x, y in zip(*np.nonzero(close)):  # too near to tell from the expanded form
            out[i + x, y] = np.sqrt(((a[i + x] - b[y]) ** 2).sum()) <= eps
    return out


def _pairs_of_blocks(points: DataFrame, eps: float, seed: int) -> DataFrame:
    """Points (id, weight, v) dealt to the pairs of blocks that may hold neighbours: i, j, side and the columns.

    Blocks are ranges of a projection on one random direction, which never takes points farther apart than
    they are: only blocks whose ranges are at most ``eps`` apart meet, each such pair once. A block meets those
    from itself on up to a last one, so the pairs are kept as one number a block.
    """
    spark = points.sparkSession
    first = points.first()
    n = max(1, -(-points.count() // BLOCK))
    turn = np.random.default_rng(seed).standard_normal(len(first.v) if first else 1)
    turn = F.array(*[F.lit(float(x)) for x in turn / np.linalg.norm(turn)])
    along = F.aggregate(F.zip_with("v", turn, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    ranged = staged(points.withColumn("along", along).repartitionByRange(n, "along").withColumn("block", F.spark_partition_id()), "ranged")
    edges = ranged.groupBy("block").agg(F.min("along").alias("low"), F.max("along").alias("high")).orderBy("block").collect()  # a row a block
    number, low, high = [r.block for r in edges], np.array([r.low for r in edges]), np.array([r.high for r in edges])
    last = [int(np.nonzero(low <= high[i] + eps + 1e-9)[0].max()) for i in range(len(edges))]
    reach = [(number[i], i, last[i], next(h for h in range(len(edges)) if last[h] >= i)) for i in range(len(edges))]
    # As ranges are in order, the blocks before one that meet it are those from a first one on.
    table = spark.createDataFrame(reach, "block int, at int, last int, first int")
    ranged = ranged.drop("along").join(F.broadcast(table), "block")
    mine = ranged.withColumn("i", F.col("at")).withColumn("j", F.explode(F.sequence("at", "last"))).withColumn("side", F.lit(0))
    theirs = ranged.where("first < at").withColumn("i", F.explode(F.sequence("first", F.col("at") - 1))).withColumn("j", F.col("at")).withColumn("side", F.lit(1))
    return mine.unionByName(theirs).drop("block", "at", "last", "first")


def dbscan(points: DataFrame, *, key: str = "id", vector: str = "embedding", eps: float = 0.5, min_samples: int = 3, seed: int = 1) -> DataFrame:
    """DBSCAN by Euclidean distance: the key and its cluster, -1 for noise.

    Neighbours are at most ``eps`` away and include the point itself. Clusters are numbered by their
    smallest core key, from 0; a border point belongs to the lowest-numbered cluster with a core near it.
    Equal vectors are compared once. All points are compared in pairs of blocks of ``BLOCK`` rows, each pair
    once, leaving out blocks that a projection shows to be too far apart; a task holds two blocks. Emitted are
    counts and the links that keep what is linked connected, never all pairs. Vectors of different
    lengths are an error; null keys and vectors that are null or hold a null or NaN are left out; an
    empty table gives an empty result.
    """
    spark = points.sparkSession
    kind = points.schema[key].dataType.simpleString()
    rows = points.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    sizes = rows.agg(F.count_distinct(F.size("v")).alias("n")).first().n
    if sizes > 1:
        raise ValueError("vectors must all have one length")
    # Copies of one vector are one point of that weight.
    distinct = staged(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "distinct")
    dealt = staged(_pairs_of_blocks(distinct, eps, seed), "dealt")

    def sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        b = a if pdf["i"].iloc[0] == pdf["j"].iloc[0] else b
        if not len(a) or not len(b):
            return a, b, np.zeros((len(a), len(b)), bool)
        return a, b, _near(np.stack(a["v"].to_list()), np.stack(b["v"].to_list()), eps)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, near = sides(pdf)
        out = pd.DataFrame({"id": a["id"], "n": near @ b["weight"].to_numpy()})
        return out if b is a else pd.concat([out, pd.DataFrame({"id": b["id"], "n": near.T @ a["weight"].to_numpy()})])

    counted = dealt.groupBy("i", "j").applyInPandas(count, f"id {kind}, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    core = staged(counted.where(F.col("n") >= min_samples).select("id", F.lit(True).alias("core")), "core")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links of cores to other cores (rec 0), and of other points to near cores (rec 1)."""
        a, b, near = sides(pdf)
        ids, others, core_a, core_b = a["id"].to_numpy(), b["id"].to_numpy(), a["core"].to_numpy(), b["core"].to_numpy()
        parent = {x: x for x in [*ids[core_a], *others[core_b]]}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        both = near[np.ix_(core_a, core_b)]
        own, other = ids[core_a], others[core_b]
        for i in range(len(own)):
            for j in np.nonzero(both[i])[0]:
                x, y = find(own[i]), find(other[j])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((own[i], other[j], 0))
        for names, cores, table, is_core in ((ids, others, near, core_b), (others, ids, near.T, core_a)):
            edge = ~(core_a if table is near else core_b)
            for i in np.nonzero(edge)[0]:
                out += [(names[i], r, 1) for r in {find(cores[j]) for j in np.nonzero(table[i] & is_core)[0]}]
            if b is a:
                break
        return pd.DataFrame(out, columns=["a", "b", "rec"])

    flagged = dealt.join(core, "id", "left").withColumn("core", F.coalesce("core", F.lit(False)))
    links = staged(flagged.groupBy("i", "j").applyInPandas(link, f"a {kind}, b {kind}, rec int"), "links")
    roots = components(links.where("rec = 0").select("a", "b"))
    cores = core.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    # Numbered within ranges of the roots, whose counts are then added up: one row a range meets in one task.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = staged(cores.select("root").distinct().repartitionByRange(n, "root").withColumn("pid", F.spark_partition_id()), "roots")
    base = number.groupBy("pid").count()
    base = base.select("pid", F.coalesce(F.sum("count").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    number = number.withColumn("r", F.row_number().over(Window.partitionBy("pid").orderBy("root"))).join(F.broadcast(base), "pid")
    number = number.select("root", (F.col("base") + F.col("r") - 1).alias("cluster"))
    cores = staged(cores.join(number, "root").select("id", "cluster"), "cores")
    border = links.where("rec = 1").join(cores.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("cluster"))
    label = distinct.select("id", "v").join(cores.unionByName(border), "id", "left").select("v", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return rows.join(label, "v").select(F.col("id").alias(key), F.col("cluster").cast("int").alias("cluster"))
