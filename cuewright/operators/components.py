"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.session import release, staged


def _unsettled(links: DataFrame) -> bool:
    """Whether any node has more than one link to a smaller node, or is both ends of links."""
    ends = links.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(links.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or (up = 1 and down = 1)").agg(F.count("*")).first()[0] > 0


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """The smallest node of each linked node's component, as columns ``node`` and ``root``.

    Alternates large-star and small-star contractions, whose number grows with the logarithm of
    the longest path, until every link leads straight to a root. Each round is a minimum by node, combined before the shuffle, joined back to
    the links, so no node's links are ever gathered. Nodes without a link, and links with a null or
    to the node itself, give no rows; repeated links change nothing.
    """
    hi, lo = F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    current = staged(links.select(hi, lo).distinct(), "links")
    for _ in range(max_rounds):
        if not _unsettled(current):
            break
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        following = staged(small, "links")
        release(current)
        current = following
    else:
        raise RuntimeError("components did not settle")
    found = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found.unionByName(found.select("root", "root").distinct().toDF("node", "root"))
