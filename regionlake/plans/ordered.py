"""Looking at the next row along a key without ordering all of a key's rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_next(df: DataFrame, keys: list[str], order: str, tie: str, width: int) -> DataFrame:
    """df with next_<order>: the next row's value, by order and tie, among the rows of keys.

    Rows are ordered in bins of width; only each bin's first value is ordered along the whole key.
    """
    rows = df.withColumn("_bin", F.floor(F.col(order) / width).cast("long"))
    firsts = rows.groupBy(*keys, "_bin").agg(F.min(order).alias("_first"))
    firsts = firsts.withColumn("_after", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_bin"))).drop("_first")
    inside = Window.partitionBy(*keys, "_bin").orderBy(order, tie)
    out = rows.join(firsts, [*keys, "_bin"])
    return out.withColumn(f"next_{order}", F.coalesce(F.lead(order).over(inside), F.col("_after"))).drop("_bin", "_after")
