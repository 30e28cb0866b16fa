"""Parallel loops and task trees as dataflow: mapping, chaining, reducing, ids, the overlay hierarchy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import heap
from ..registry import query
from ..sources import fixtures as fx
from ..sources.fixtures import with_sql
from .kernels import chain_step, iterate

#: A loop is split while it has more iterations than this.
GRAIN = 10000


def pfor(spark, begin: int, end: int, body: Column) -> DataFrame:
    """i, v: body over every i of [begin, end). Spark cuts the range; body is a column over id."""
    return spark.range(begin, end).select(F.col("id").alias("i"), body.alias("v"))


@query("q_pfor_map", "SELECT i, i * i + 1 AS v FROM (SELECT unnest(range(10, 5010)) AS i)")
def pfor_map(spark, d) -> DataFrame:
    return pfor(spark, 10, 5010, F.col("id") * F.col("id") + 1)


@query("q_pfor_chain", "SELECT i, CAST(4 AS BIGINT) AS v FROM (SELECT unnest(range(0, 3000)) AS i)")
def pfor_chain(spark, d) -> DataFrame:
    """Four loops, each of which needs its predecessor at i - 1, i and i + 1."""
    return iterate(chain_step, pfor(spark, 0, 3000, F.lit(0).cast("long")), 4)


@query("q_sync_steps", with_sql("SELECT step, count(*) AS n, CAST(sum(i + step) AS BIGINT) AS total FROM vector, (VALUES (1), (2), (3)) AS s(step) GROUP BY step", "vector"))
def sync_steps(spark, d, steps: int = 3) -> DataFrame:
    """Loops of which each depends, one on one, on what the loop before left at the same place."""
    at, out = fx.vector(spark, d).select("i", F.col("i").alias("v")), None
    for step in range(1, steps + 1):
        at = at.select("i", (F.col("v") + 1).alias("v"))
        row = at.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")).select(F.lit(step).alias("step"), "n", "total")
        out = row if out is None else out.unionByName(row)
    return out


@query("q_parallel", with_sql("SELECT 'sum' AS part, CAST(sum(i) AS BIGINT) AS value FROM vector UNION ALL SELECT 'count' AS part, count(*) AS value FROM vector", "vector"))
def q_parallel(spark, d) -> DataFrame:
    """Two results that do not depend on each other."""
    v = fx.vector(spark, d)
    return parallel(v.agg(F.sum("i").alias("value")).select(F.lit("sum").alias("part"), "value"), v.agg(F.count(F.lit(1)).alias("value")).select(F.lit("count").alias("part"), "value"))


@query("q_tree_reduce", with_sql("SELECT CAST(sum(i) AS BIGINT) AS total, max(a) AS top, bit_xor(i) AS folded FROM vector", "vector"))
def tree_reduce(spark, d) -> DataFrame:
    """Associative combines: partial in each task, then final."""
    return fx.vector(spark, d).agg(F.sum("i").alias("total"), F.max("a").alias("top"), F.bit_xor("i").alias("folded"))


@query("q_preduce_counts", with_sql("SELECT CAST(x % 5 AS BIGINT) AS frame, CAST(floor(v / 50) AS BIGINT) AS cell, count(*) AS n FROM grid GROUP BY 1, 2", "grid"))
def preduce_counts(spark, d) -> DataFrame:
    return fx.grid(spark, d).groupBy((F.col("x") % 5).alias("frame"), F.floor(F.col("v") / 50).cast("long").alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query("q_tree_children", with_sql("SELECT p.heap, coalesce(l.heap, p.heap) AS left_child, coalesce(r.heap, p.heap) AS right_child FROM task_profile p LEFT JOIN task_profile l ON l.heap = 2 * p.heap LEFT JOIN task_profile r ON r.heap = 2 * p.heap + 1", "task_profile"))
def tree_children(spark, d) -> DataFrame:
    """Children that exist; a node without one stands for itself. Each child tells its parent: one exchange."""
    p = fx.task_profile(spark, d).select("heap")
    told = p.where("heap > 1").groupBy(heap.parent(F.col("heap")).alias("heap")).agg(
        F.max(F.when(F.col("heap") % 2 == 0, F.col("heap"))).alias("l"), F.max(F.when(F.col("heap") % 2 == 1, F.col("heap"))).alias("r")
    )
    return p.join(told, "heap", "left").select("heap", F.coalesce("l", "heap").alias("left_child"), F.coalesce("r", "heap").alias("right_child"))


@query("q_task_id_ops", with_sql("SELECT heap, length(bin(heap)) - 1 AS depth, CAST(floor(heap / 2) AS BIGINT) AS parent, heap > 1 AND heap % 2 = 0 AS is_left, heap > 1 AND heap % 2 = 1 AS is_right, length(bin(heap)) >= 4 AND substr(bin(heap), 1, 4) = '1011' AS below_11, regexp_replace(substr(bin(heap), 2), '(.)', '.\\1', 'g') AS path FROM task_profile", "task_profile"))
def task_id_ops(spark, d) -> DataFrame:
    h = F.col("heap")
    return fx.task_profile(spark, d).select(
        "heap", heap.depth(h).alias("depth"), heap.parent(h).alias("parent"), ((h > 1) & (h % 2 == 0)).alias("is_left"), ((h > 1) & (h % 2 == 1)).alias("is_right"),
        heap.in_subtree(h, F.lit(11).cast("long")).alias("below_11"), heap.text(h).alias("path"),
    )


def layers(n: Column) -> Column:
    """Layer of the root over n ranks: ceil(log2 n)."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))


def overlay(ranks: DataFrame) -> DataFrame:
    """For rank, layer: whether the address exists (its rank is a multiple of 2 ** layer), its parent, the
    children one layer below (a left one has the same rank) and the number of ranks it spans."""
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("layer").cast("int"))
    double = size * 2
    up = F.floor(F.col("rank") / double).cast("long") * double
    leaf = F.col("layer") == 0
    return ranks.select(
        "rank", "layer", (F.col("rank") % size == 0).alias("exists"), up.alias("parent_rank"), (F.col("layer") + 1).alias("parent_layer"),
        F.when(~leaf, F.col("rank")).alias("left_rank"), F.when(~leaf, F.col("rank") + F.floor(size / 2).cast("long")).alias("right_rank"), size.alias("span"),
    )


@query("q_hierarchy", "SELECT r AS rank, l AS layer, r % CAST(pow(2, l) AS BIGINT) = 0 AS exists, CAST(floor(r / pow(2, l + 1)) * pow(2, l + 1) AS BIGINT) AS parent_rank, l + 1 AS parent_layer, CASE WHEN l > 0 THEN r END AS left_rank, CASE WHEN l > 0 THEN r + CAST(pow(2, l - 1) AS BIGINT) END AS right_rank, CAST(pow(2, l) AS BIGINT) AS span FROM (SELECT unnest(range(0, 64)) AS r), (SELECT CAST(unnest(range(0, 7)) AS INTEGER) AS l)")
def hierarchy(spark, d) -> DataFrame:
    ranks = spark.range(64).select(F.col("id").alias("rank"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("layer"))
    return overlay(ranks)


@query("q_hierarchy_root", "SELECT n AS size, CASE WHEN n <= 1 THEN '0:0' ELSE '0:' || CAST(CAST(ceil(log2(n)) AS INTEGER) AS VARCHAR) END AS root FROM (SELECT unnest(range(1, 65)) AS n)")
def hierarchy_root(spark, d) -> DataFrame:
    """The root address over networks of 1 to 64 ranks."""
    return spark.range(1, 65).select(F.col("id").alias("size"), F.concat(F.lit("0:"), layers(F.col("id")).cast("string")).alias("root"))


def parallel(*frames: DataFrame) -> DataFrame:
    """Independent branches of one shape, as one plan."""
    return reduce(lambda a, b: a.unionByName(b), frames)
