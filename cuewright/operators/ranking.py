"""Numbering of rows within keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], order: list[str], part: Column, name: str = "number") -> DataFrame:
    """Adds the place of each row, from 1, within its key in the given order.

    ``part`` must not fall along the order (such as a time cut to ten minutes). Rows are ranked within
    their part and the counts of the parts before are added, so a key with a great share of all rows is
    spread over as many tasks as it has parts; per key only one row a part is gathered. Null keys form
    one group each.
    """
    df = df.withColumn("_part", part)
    counts = df.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_part").eqNullSafe(F.col("_p"))]
    out = df.withColumn("_r", rank).join(base, on, "left")
    return out.withColumn(name, F.col("_r") + F.col("_base")).drop("_part", "_p", "_r", "_base", *[f"_k{i}" for i in range(len(keys))])
