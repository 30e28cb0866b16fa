"""Writers: snapshots as CSV, graph files and heatmap files as lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_csv(density: DataFrame, path: str) -> None:
    """frame, x, y, z, n as CSV files with the header t,x,y,z,density."""
    out = density.select(F.col("frame").alias("t"), "x", "y", "z", F.col("n").alias("density"))
    out.write.option("header", True).mode("overwrite").csv(path)


def graph_lines(nodes: DataFrame, edges: DataFrame, name: str = "tasks") -> DataFrame:
    """value: the lines of a graph file, in order of pos: head, nodes, edges, end. nodes and edges have line."""
    spark = nodes.sparkSession
    ends = spark.createDataFrame([(0, f"digraph {name} {{"), (3, "}")], "pos int, value string")
    body = nodes.select(F.lit(1).alias("pos"), F.col("line").alias("value")).unionByName(edges.select(F.lit(2).alias("pos"), F.col("line").alias("value")))
    return ends.unionByName(body).orderBy("pos", "value").select("value")


def heatmap_lines(cells: DataFrame) -> DataFrame:
    """rank, sample, value as lines of three columns, in order."""
    return cells.orderBy("rank", "sample").select(F.format_string("%d %d %f", "rank", "sample", "value").alias("value"))


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)
