"""Readers of configuration and log text: frames of lines in, columns out. spark.read.text gives the lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def key_values(df: DataFrame) -> DataFrame:
    """key, value of lines 'key = value'; comments and other lines are left out."""
    v = F.col("value")
    pair = F.split(v, "=", 2)
    return df.where(v.contains("=") & ~F.ltrim(v).startswith("#")).select(F.trim(pair[0]).alias("key"), F.trim(pair[1]).alias("value"))


def spaced_pairs(df: DataFrame) -> DataFrame:
    """key, value of lines 'key value'; what follows # is a comment."""
    bare = F.trim(F.regexp_replace(F.col("value"), r"#.*$", ""))
    pair = F.split(bare, r"\s+", 2)
    return df.select(pair.alias("p")).where(F.size("p") == 2).select(F.col("p")[0].alias("key"), F.col("p")[1].alias("value"))


ITEM_LINE = r"^(\w+)\(([^)]*)\), (\w+)\(([^)]*)\), ([^:]+): "


def item_boxes(df: DataFrame) -> DataFrame:
    """no, action, mode, name, id, ref, box, lo, hi of lines (no, line)
    'action(mode), name(id), ref: [[lo]] - [[hi]] ...'."""
    fields = {n: F.regexp_extract("line", ITEM_LINE, k + 1).alias(n) for k, n in enumerate(("action", "mode", "name", "id", "ref"))}
    points = F.regexp_extract_all("line", F.lit(r"\[\[([0-9,]+)\]\]"), F.lit(1))
    rows = df.where(F.col("line").rlike(ITEM_LINE)).select("no", *fields.values(), points.alias("points"))
    boxes = rows.select("no", *fields, "points", F.explode(F.sequence(F.lit(0), F.floor(F.size("points") / 2).cast("int") - 1)).alias("box"))
    return boxes.select("no", *fields, "box", F.col("points")[F.col("box") * 2].alias("lo"), F.col("points")[F.col("box") * 2 + 1].alias("hi"))
