"""Numeric kernels as joins, windows and aggregates over coordinate frames."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import heap
from ..plans.settle import settle
from ..registry import query
from ..sources import fixtures as fx
from ..sources.fixtures import with_sql

SCALE = 3.0
#: Fixed value: the star stencil's weights at offsets -2 to 2 of the centre row and column.
STAR = (-0.125, -0.25, 0.0, 0.25, 0.125)
HEAT_K = 0.001
COLUMNS = 100


@query("q_grid_init", with_sql("SELECT x, y, CAST(x + y AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b FROM grid", "grid"))
def grid_init(spark, d) -> DataFrame:
    return fx.grid(spark, d).select("x", "y", (F.col("x") + F.col("y")).cast("double").alias("a"), F.lit(0.0).alias("b"))


@query("q_tree_init", "SELECT h AS heap, length(bin(h)) - 1 AS depth, CASE WHEN h >= 512 THEN h - 512 END AS leaf FROM (SELECT unnest(range(1, 1024)) AS h)")
def tree_init(spark, d, depth: int = 9) -> DataFrame:
    """A balanced tree of the given depth; leaves are numbered."""
    h = F.col("heap")
    nodes = spark.range(1, 2 ** (depth + 1)).withColumnRenamed("id", "heap")
    return nodes.select("heap", heap.depth(h).alias("depth"), F.when(h >= 2**depth, h - 2**depth).alias("leaf"))


# ---- streams -------------------------------------------------------------------------------------


@query("q_stream_init", with_sql("SELECT i, CAST(1 AS DOUBLE) AS a, CAST(2 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c FROM vector", "vector"))
def stream_init(spark, d) -> DataFrame:
    return fx.vector(spark, d).select("i", F.lit(1.0).alias("a"), F.lit(2.0).alias("b"), F.lit(0.0).alias("c"))


def _stream(name: str, target: str, column: str, sql: str) -> None:
    query(name, with_sql(f"SELECT i, {sql} AS {target} FROM vector", "vector"))(lambda spark, d: fx.vector(spark, d).select("i", F.expr(column).alias(target)))


_stream("q_stream_copy", "c", "a", "a")
_stream("q_stream_scale", "b", f"{SCALE}D * c", f"CAST({SCALE} AS DOUBLE) * c")
_stream("q_stream_add", "c", "a + b", "a + b")
_stream("q_stream_triad", "a", f"b + {SCALE}D * c", f"b + CAST({SCALE} AS DOUBLE) * c")
_stream("q_vector_add", "c", "1.0D + 2.0D", "CAST(3 AS DOUBLE)")


def stream_cycle(v: DataFrame) -> DataFrame:
    """Copy, scale, add, triad in turn: one projection, no exchange."""
    return v.withColumn("c", F.col("a")).withColumn("b", SCALE * F.col("c")).withColumn("c", F.col("a") + F.col("b")).withColumn("a", F.col("b") + SCALE * F.col("c"))


@query("q_stream_check", with_sql("SELECT name, CAST(e AS DOUBLE) AS expected, CAST(0 AS DOUBLE) AS mean_error, true AS ok FROM (VALUES ('a', 15), ('b', 3), ('c', 4)) AS t(name, e)", "vector"))
def stream_check(spark, d) -> DataFrame:
    """Mean absolute error of every array after one cycle, against the closed form; all rows are checked."""
    start = (1.0, 2.0, 0.0)
    a, b, c = start[0], SCALE * start[0], start[0] * (1 + SCALE)
    expected = {"a": b + SCALE * c, "b": b, "c": c}
    v = stream_cycle(stream_init(spark, d))
    sums = v.agg(*[F.avg(F.abs(F.col(k) - e)).alias(k) for k, e in expected.items()])
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(e).alias("expected"), F.col(k).alias("mean_error"), (F.col(k) / e <= 1e-13).alias("ok")) for k, e in expected.items()]))
    return sums.select(rows)


_RUNS = "SELECT event_type AS kernel, CAST(user_id % 10 AS INTEGER) AS iteration, value AS seconds FROM events"


@query("q_stream_report", f"SELECT kernel, round(1e-6 * 16 * 1024 / min(seconds), 6) AS best_rate, round(avg(seconds), 6) AS mean, min(seconds) AS least, max(seconds) AS largest FROM ({_RUNS}) WHERE iteration > 0 GROUP BY kernel")
def stream_report(spark, d) -> DataFrame:
    """Best rate and times of every kernel; iteration 0 is left out. A run of no time has an infinite rate."""
    runs = fx.table(spark, d, "events").selectExpr("event_type AS kernel", "CAST(user_id % 10 AS INT) AS iteration", "value AS seconds")
    least = F.min("seconds")
    # Spark's division fails at zero; a power gives infinity with the zero's sign
    rate = F.when(least == 0, F.pow(least, F.lit(-1.0))).otherwise(F.lit(1e-6 * 16 * 1024) / least)
    return runs.where("iteration > 0").groupBy("kernel").agg(
        F.round(rate, 6).alias("best_rate"), F.round(F.avg("seconds"), 6).alias("mean"), least.alias("least"), F.max("seconds").alias("largest")
    )


# ---- stencils ------------------------------------------------------------------------------------


def gather(grid: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """x, y and one column n_<k> a neighbour: every cell sends its value to the cells that look at it.

    One exchange by cell, with partial sums; rows and columns of any length are spread evenly.
    """
    sends = F.array(*[F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.lit(k).alias("k"), F.col("v").alias("v")) for k, (dx, dy) in enumerate(offsets)])
    sent = grid.select(F.inline(sends))
    return sent.groupBy("x", "y").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"n_{k}") for k in range(len(offsets))])


_OFFSETS = [(0, dy) for dy in (-2, -1, 0, 1, 2)] + [(dx, 0) for dx in (-2, -1, 1, 2)]


def star(grid: DataFrame) -> DataFrame:
    """x, y, b of the cells whose whole star of radius 2 lies in the grid."""
    g = gather(grid, _OFFSETS)
    row = [(STAR[k], F.col(f"n_{k}")) for k in range(5)]
    column = [(w, F.col(f"n_{5 + k}")) for k, w in enumerate((STAR[0], STAR[1], STAR[3], STAR[4]))]
    total = reduce(lambda a, b: a + b, [w * c for w, c in row + column])
    inside = reduce(lambda a, b: a & b, [F.col(f"n_{k}").isNotNull() for k in range(len(_OFFSETS))])
    return g.where(inside).select("x", "y", total.alias("b"))


_WEIGHTS = ", ".join([f"(0, {k - 2}, CAST({STAR[k]} AS DOUBLE))" for k in range(5)] + [f"({k - 2}, 0, CAST({STAR[k]} AS DOUBLE))" for k in (0, 1, 3, 4)])
_STAR_SQL = f"""SELECT x, y, round(sum(b), 6) AS b FROM (SELECT n.x - dx AS x, n.y - dy AS y, w * v AS b FROM grid n, (VALUES {_WEIGHTS}) AS s(dx, dy, w))
  GROUP BY x, y HAVING count(*) = 9"""


@query("q_stencil_star2", with_sql(_STAR_SQL, "grid"))
def stencil_star2(spark, d) -> DataFrame:
    return star(fx.grid(spark, d)).withColumn("b", F.round("b", 6))


#: The grid's factors of x and y.
COEF_X, COEF_Y = 1.0, 1.0


@query("q_stencil_norm", with_sql(f"SELECT 3 AS iterations, round(avg(abs(s)), 6) AS norm, CAST(8 AS DOUBLE) AS expected FROM (SELECT sum(w * (n.x + n.y + k)) AS s FROM grid n, (VALUES {_WEIGHTS}) AS s(dx, dy, w), (SELECT unnest(range(0, 4)) AS k) GROUP BY n.x - dx, n.y - dy HAVING count(*) = 36)", "grid"))
def stencil_norm(spark, d, iterations: int = 3) -> DataFrame:
    """Mean of |b| over the inner cells: a = x + y grows by 1 after each round, and every round, one more than
    the iterations, adds a's star to b."""
    a, rounds = fx.grid(spark, d).select("x", "y", (COEF_X * F.col("x") + COEF_Y * F.col("y")).cast("double").alias("v")), None
    for _ in range(iterations + 1):
        rounds = star(a) if rounds is None else rounds.unionByName(star(a))
        a = a.withColumn("v", F.col("v") + 1)
    b = rounds.groupBy("x", "y").agg(F.sum("b").alias("b"))
    return b.agg(F.lit(iterations).alias("iterations"), F.round(F.avg(F.abs("b")), 6).alias("norm"), F.lit((iterations + 1) * (COEF_X + COEF_Y)).alias("expected"))


def heat_step(grid: DataFrame, k: float = HEAT_K) -> DataFrame:
    """One step of the five-point rule on integers, cut toward zero; edge cells stay."""
    g = gather(grid, [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)])
    c = F.col("n_0")
    near = F.col("n_1") + F.col("n_2") + F.col("n_3") + F.col("n_4")
    return g.where(c.isNotNull()).select("x", "y", F.coalesce((c + k * (near - 4 * c)).cast("int"), c).alias("v"))


@query("q_heat_step", with_sql(f"WITH i AS (SELECT x, y, CAST(floor(v * 1000) AS INTEGER) AS v FROM grid) SELECT c.x, c.y, coalesce(CAST(trunc(c.v + CAST({HEAT_K} AS DOUBLE) * ((w.v + e.v + n.v + s.v) - 4 * c.v)) AS INTEGER), c.v) AS v FROM i c LEFT JOIN i w ON w.x = c.x - 1 AND w.y = c.y LEFT JOIN i e ON e.x = c.x + 1 AND e.y = c.y LEFT JOIN i n ON n.x = c.x AND n.y = c.y - 1 LEFT JOIN i s ON s.x = c.x AND s.y = c.y + 1", "grid"))
def q_heat_step(spark, d) -> DataFrame:
    return heat_step(fx.grid(spark, d).select("x", "y", F.floor(F.col("v") * 1000).cast("int").alias("v")))


def iterate(step, start: DataFrame, steps: int, every: int = 4) -> DataFrame:
    """step applied steps times; lineage is cut every few steps."""
    out = start
    for k in range(1, steps + 1):
        out = step(out)
        if k % every == 0 and k < steps:
            out = settle(out)
    return out


def chain_step(line: DataFrame) -> DataFrame:
    """B[i] = A[i] + 1 where both neighbours (if there) hold the same value; else the cell is wrong: null."""
    sent = line.select(F.inline(F.array(*[F.struct((F.col("i") + o).alias("i"), F.lit(o).alias("o"), F.col("v").alias("v")) for o in (-1, 0, 1)])))
    got = sent.groupBy("i").agg(*[F.max(F.when(F.col("o") == o, F.col("v"))).alias(n) for o, n in ((0, "c"), (1, "l"), (-1, "r"))]).where("c IS NOT NULL")
    same = (F.coalesce("l", "c") == F.col("c")) & (F.coalesce("r", "c") == F.col("c"))
    return got.select("i", F.when(same, F.col("c") + 1).alias("v"))


_LINE = "SELECT i, CAST(5 AS BIGINT) AS v FROM vector"


def _line(spark, d) -> DataFrame:
    return fx.vector(spark, d).select("i", F.lit(5).cast("long").alias("v"))


@query("q_stencil_1d", with_sql("SELECT i, CAST(6 AS BIGINT) AS v FROM vector", "vector"))
def stencil_1d(spark, d) -> DataFrame:
    return chain_step(_line(spark, d))


@query("q_stencil_2d", with_sql("SELECT x, y, v + 1 AS v FROM grid", "grid"))
def stencil_2d(spark, d) -> DataFrame:
    return fx.grid(spark, d).select("x", "y", (F.col("v") + 1).alias("v"))


@query("q_pingpong", with_sql("SELECT i, CAST(8 AS BIGINT) AS v FROM vector", "vector"))
def pingpong(spark, d) -> DataFrame:
    """Three steps between two buffers, each of which expects the neighbours at its own step."""
    return iterate(chain_step, _line(spark, d), 3)


# ---- matrices ------------------------------------------------------------------------------------


def transpose_accumulate(n: int, iterations: int, spark) -> DataFrame:
    """b[i, j] += a[j, i], then a += 1, iterations times, a starting as i * n + j: every iteration sends each
    cell of the a that the one before left to its mirror; sums combine before the exchange."""
    a, sent = spark.range(n * n).select(F.floor(F.col("id") / n).cast("long").alias("i"), (F.col("id") % n).alias("j"), F.col("id").cast("double").alias("a")), None
    for _ in range(iterations):
        mirror = a.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("a").alias("b"))
        sent = mirror if sent is None else sent.unionByName(mirror)
        a = a.withColumn("a", F.col("a") + 1)
    return sent.groupBy("i", "j").agg(F.sum("b").alias("b"))


@query("q_transpose", "SELECT i, j, CAST(sum(j * 64 + i + k) AS DOUBLE) AS b FROM (SELECT unnest(range(0, 64)) AS i), (SELECT unnest(range(0, 64)) AS j), (SELECT unnest(range(0, 3)) AS k) GROUP BY i, j")
def transpose(spark, d) -> DataFrame:
    return transpose_accumulate(64, 3, spark)


@query("q_transpose_check", "WITH b AS (SELECT i, j, CAST(sum(j * 64 + i + k) AS DOUBLE) AS b FROM (SELECT unnest(range(0, 64)) AS i), (SELECT unnest(range(0, 64)) AS j), (SELECT unnest(range(0, 3)) AS k) GROUP BY i, j) SELECT sum(abs(b - ((j * 64 + i) * 3 + 3.0))) AS error, sum(abs(b - ((j * 64 + i) * 3 + 3.0))) < 1e-8 AS ok FROM b")
def transpose_check(spark, d, n: int = 64, it: int = 2) -> DataFrame:
    """Against the closed form of it + 1 iterations."""
    expected = (F.col("j") * n + F.col("i")) * (it + 1) + it * (it + 1) / 2.0
    b = transpose_accumulate(n, it + 1, spark)
    return b.agg(F.sum(F.abs(F.col("b") - expected)).alias("error")).select("error", (F.col("error") < 1e-8).alias("ok"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, v: the product of sparse (i, k, v) and (i = k, k = j, v). Equal k meet; partial sums come first."""
    right = b.select(F.col("i").alias("k"), F.col("k").alias("j"), F.col("v").alias("w"))
    return a.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


@query("q_matmul", with_sql("SELECT a.i, b.k AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM matrix_a a JOIN matrix_b b ON a.k = b.i GROUP BY a.i, b.k", "matrix_a", "matrix_b"))
def q_matmul(spark, d) -> DataFrame:
    return matmul(fx.matrix(spark, d), fx.matrix(spark, d, second=True))


# ---- scalars, sorting, sampling ------------------------------------------------------------------


@query("q_fib_recursive", "WITH RECURSIVE f AS (SELECT 0 AS n, CAST(0 AS BIGINT) AS fib, CAST(1 AS BIGINT) AS next UNION ALL SELECT n + 1, next, fib + next FROM f WHERE n < 38) SELECT n, fib FROM f")
def fib_recursive(spark, d) -> DataFrame:
    return spark.sql("WITH RECURSIVE f(n, fib, next) AS (SELECT 0, CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, next, fib + next FROM f WHERE n < 38) SELECT n, fib FROM f")


def unit(i: Column, salt: int) -> Column:
    """A number in [0, 1) from a multiplicative hash, the same everywhere."""
    return F.pmod((i + salt) * 48271, F.lit(2147483647)) / 2147483647.0


@query("q_pi", "SELECT count(*) AS n, CAST(sum(CASE WHEN x * x + y * y <= 1 THEN 1 ELSE 0 END) AS BIGINT) AS hits, 4.0 * sum(CASE WHEN x * x + y * y <= 1 THEN 1 ELSE 0 END) / count(*) AS pi FROM (SELECT ((i + 1) * 48271 % 2147483647) / 2147483647.0 AS x, ((i * 7 + 90001) * 48271 % 2147483647) / 2147483647.0 AS y FROM (SELECT unnest(range(0, 200000)) AS i))")
def monte_carlo_pi(spark, d, n: int = 200000) -> DataFrame:
    i = F.col("id")
    x, y = unit(i, 1), unit(i * 7, 90001)
    hit = F.when(x * x + y * y <= 1, 1).otherwise(0)
    return spark.range(n).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("hits")).select("n", "hits", (4.0 * F.col("hits") / F.col("n")).alias("pi"))


@query("q_sort", "SELECT CAST(l_quantity AS INTEGER) AS v, count(*) AS n, sum(count(*)) OVER (ORDER BY CAST(l_quantity AS INTEGER)) - count(*) AS first FROM lineitem GROUP BY 1".replace("sum(count(*)) OVER (ORDER BY CAST(l_quantity AS INTEGER)) - count(*)", "CAST(sum(count(*)) OVER (ORDER BY CAST(l_quantity AS INTEGER)) - count(*) AS BIGINT)"))
def sort_positions(spark, d) -> DataFrame:
    """Where each value begins in the sorted order: values are few, so counts are ordered, not rows."""
    v = fx.table(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return v.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def sorted_rows(df: DataFrame, *columns: str) -> DataFrame:
    """All rows in order: range partitions, sampled by Spark, each sorted."""
    return df.orderBy(*columns)


@query("q_partition_pos", "SELECT 25 AS pivot, count(*) FILTER (WHERE CAST(l_quantity AS INTEGER) <= 25) AS position, count(*) AS n FROM lineitem")
def partition_pos(spark, d, pivot: int = 25) -> DataFrame:
    v = fx.table(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("v"))
    return v.agg(F.lit(pivot).alias("pivot"), F.count_if(F.col("v") <= pivot).alias("position"), F.count(F.lit(1)).alias("n"))


# ---- points --------------------------------------------------------------------------------------

RADIUS = 1.26
#: Queries of a leaf of the k-d tree, and of a block that is sent to every task.
LEAF, BLOCK = 256, 1 << 15


def kd_leaves(q: np.ndarray, most: int = LEAF) -> list[np.ndarray]:
    """The rows of q in leaves: halved at the median of the widest dimension as long as there are too many."""
    work, out = [np.arange(len(q))], []
    while work:
        own = work.pop()
        if len(own) <= most:
            out.append(own)
            continue
        wide = np.ptp(q[own], axis=0).argmax()
        order = own[np.argsort(q[own, wide], kind="stable")]
        work += [order[: len(own) // 2], order[len(own) // 2 :]]
    return out


def _counted(shared, radius: float):
    """A count for each query of a block: of a leaf's queries only points within radius of its box are seen."""
    square = radius * radius

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        n = np.zeros(len(ids), np.int64)
        leaves = [(own, q[own].min(0), q[own].max(0), (q[own] ** 2).sum(1)) for own in kd_leaves(q)]
        for batch in batches:
            if not len(batch):
                continue
            p = np.array(batch["p"].tolist(), np.float64)
            norms = (p**2).sum(1)
            for own, lo, hi, mine in leaves:
                far = np.maximum(np.maximum(lo - p, p - hi), 0)
                near = np.flatnonzero((far**2).sum(1) <= square + 1e-9)
                if not len(near):
                    continue
                d2 = mine[:, None] + norms[near][None, :] - 2 * q[own] @ p[near].T
                inside = d2 <= square
                for i, j in np.argwhere(np.abs(d2 - square) < 1e-6):  # too close for the expanded form
                    inside[i, j] = ((q[own[i]] - p[near[j]]) ** 2).sum() <= square
                n[own] += inside.sum(1)
        yield pd.DataFrame({"qid": ids, "n": n}).query("n > 0")

    return run


def radius_count(points: DataFrame, queries: DataFrame, radius: float, block: int = BLOCK) -> DataFrame:
    """qid, n: points (id, p) within radius of each query (qid, p) that has any. The stated set of queries goes
    to the tasks in blocks of bounded size, one job a block; every job reads the points in batches and sends
    one count a query and task."""
    spark = points.sparkSession
    out, held = None, []

    def job(rows: list) -> DataFrame:
        shared = spark.sparkContext.broadcast((np.array([r["qid"] for r in rows], np.int64), np.array([r["p"] for r in rows], np.float64)))
        return settle(points.select("p").mapInPandas(_counted(shared, radius), "qid long, n long").groupBy("qid").agg(F.sum("n").alias("n")))

    for r in queries.orderBy("qid").toLocalIterator():
        held.append(r)
        if len(held) >= block:
            out, held = job(held) if out is None else out.unionByName(job(held)), []
    if held or out is None:
        last = job(held) if held else spark.createDataFrame([], "qid long, n long")
        out = last if out is None else out.unionByName(last)
    return out


_RADIUS = f"SELECT qid, count(*) AS n FROM q JOIN embeddings e ON list_sum(list_transform(list_zip(CAST(q.p AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) <= {RADIUS * RADIUS} GROUP BY qid"


@query("q_radius_count", f"WITH q AS (SELECT vec_id AS qid, embedding AS p FROM embeddings WHERE vec_id % 100 = 0) {_RADIUS}")
def q_radius_count(spark, d) -> DataFrame:
    """Of every vector whose id is divisible by 100, all at once."""
    e = fx.table(spark, d, "embeddings")
    return radius_count(e.select(F.col("embedding").alias("p")), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("p")), RADIUS)


def radius_one(points: DataFrame, p: list[float], radius: float) -> DataFrame:
    """n: points (p) within radius of one point, by columns alone."""
    gaps = F.zip_with(F.col("p").cast("array<double>"), F.array(*[F.lit(float(x)) for x in p]), lambda a, b: a - b)
    return points.where(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x) <= radius * radius).agg(F.count(F.lit(1)).alias("n"))


@query("q_radius_latency", f"WITH q AS (SELECT vec_id AS qid, embedding AS p FROM embeddings WHERE vec_id < 3) {_RADIUS}")
def radius_latency(spark, d) -> DataFrame:
    """One query after the other, each its own pass, as where every answer is waited for: the first three."""
    e = fx.table(spark, d, "embeddings")
    rows = e.where("vec_id < 3").select("vec_id", "embedding").collect()  # three
    out = [radius_one(e.select(F.col("embedding").alias("p")), r["embedding"], RADIUS).select(F.lit(r["vec_id"]).alias("qid"), "n") for r in rows]
    return reduce(lambda a, b: a.unionByName(b), out)


def box_min_dist(p: Column, lo: Column, hi: Column) -> Column:
    """Squared distance of a point from a box."""
    gaps = F.zip_with(F.zip_with(lo, p, lambda a, b: a - b), F.zip_with(p, hi, lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)


@query("q_box_min_dist", "SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: pow(greatest(-0.1 - x, x - 0.1, 0.0), 2))), 6) AS d2 FROM embeddings")
def q_box_min_dist(spark, d) -> DataFrame:
    """From the cube of side 0.2 around the origin."""
    p = F.col("embedding").cast("array<double>")
    lo, hi = F.transform(p, lambda _: F.lit(-0.1)), F.transform(p, lambda _: F.lit(0.1))
    return fx.table(spark, d, "embeddings").select("vec_id", F.round(box_min_dist(p, lo, hi), 6).alias("d2"))


@query("q_kd_split_dim", "SELECT h AS heap, (length(bin(h)) - 1) % 7 AS dim FROM (SELECT unnest(range(1, 1024)) AS h)")
def kd_split_dim(spark, d) -> DataFrame:
    """The dimension that a node of a 7-dimensional tree splits."""
    h = F.col("heap")
    return spark.range(1, 1024).withColumnRenamed("id", "heap").select("heap", (heap.depth(h) % 7).alias("dim"))


# ---- unbalanced trees ----------------------------------------------------------------------------

MAX_CHILDREN = 100


def geometric_children(u: Column, b: Column) -> Column:
    """Children of a node by the inverse of the geometric distribution with mean b, at most MAX_CHILDREN."""
    return F.least(F.floor(F.log(1 - u) / F.log(1 - 1 / (1 + b))), F.lit(MAX_CHILDREN)).cast("int")


def target_branching(shape: str, b0: float, depth: Column, limit: int) -> Column:
    """The mean number of children at a depth: shapes fixed, linear, expdec and cyclic."""
    root = F.lit(float(b0))
    x = depth.cast("double")
    rule = {
        "fixed": F.when(depth < limit, F.lit(float(b0))).otherwise(0.0),
        "linear": b0 * (1 - x / limit),
        "expdec": b0 * F.pow(x, F.lit(-np.log(b0) / np.log(limit))),
        "cyclic": F.when(depth > 5 * limit, 0.0).otherwise(F.pow(F.lit(float(b0)), F.sin(2 * np.pi * x / limit))),
    }[shape]
    return F.when(depth == 0, root).otherwise(rule)


@query("q_uts_children", "SELECT CAST(i AS BIGINT) AS id, CASE WHEN b <= 0 THEN 0 ELSE CAST(least(floor(ln(1 - u) / ln(1 - 1 / (1 + b))), 100) AS INTEGER) END AS children FROM (SELECT i, ((i + 17) * 48271 % 2147483647) / 2147483647.0 AS u, CASE WHEN i % 12 = 0 THEN 4.0 ELSE 4.0 * (1 - CAST(i % 12 AS DOUBLE) / 10) END AS b FROM (SELECT unnest(range(0, 5000)) AS i))")
def uts_children(spark, d) -> DataFrame:
    """Of 5000 nodes at depths 0 to 11, linear shape, mean 4 at the root, limit 10."""
    b = target_branching("linear", 4.0, F.col("id") % 12, 10)
    return spark.range(5000).select("id", F.when(b <= 0, 0).otherwise(geometric_children(unit(F.col("id"), 17), b)).alias("children"))


def sha_state(state: Column, child: Column) -> Column:
    """A child's 20 bytes: SHA-1 of the parent's and the child's number as four big-endian bytes."""
    return F.unhex(F.sha1(F.concat(state, F.unhex(F.lpad(F.hex(child), 8, "0")))))


def sha_unit(state: Column) -> Column:
    """[0, 1) from the last four bytes, without the sign bit."""
    return F.pmod(F.conv(F.hex(F.substring(state, 17, 4)), 16, 10).cast("long"), F.lit(2147483648)) / 2147483648.0


def children(kind: str, u: Column, depth: Column, b0: float, limit: int, shape: str = "linear", q: float = 0.25, m: int = 4, shift: float = 0.5) -> Column:
    """Children of a node of a binomial, geometric, hybrid (geometric above shift * limit, then binomial) or
    balanced tree. u: the node's number in [0, 1); the root of a binomial tree has floor(b0) children."""
    binomial = F.when(u < q, m).otherwise(0)
    mean = target_branching(shape, b0, depth, limit)
    geometric = F.when(mean <= 0, 0).otherwise(geometric_children(u, mean))
    return {
        "binomial": F.when(depth == 0, int(np.floor(b0))).otherwise(F.least(binomial, F.lit(MAX_CHILDREN))),
        "geometric": geometric,
        "hybrid": F.when(depth < shift * limit, geometric).otherwise(F.least(binomial, F.lit(MAX_CHILDREN))),
        "balanced": F.when(depth < limit, int(b0)).otherwise(0),
    }[kind].cast("int")


def uts_tree(spark, b0: float, limit: int, seed: int, kind: str = "geometric", most: int = 64, **more) -> list[DataFrame]:
    """The levels of a tree whose nodes are drawn from hashes of their path; a level is one frontier frame."""
    start = F.unhex(F.sha1(F.concat(F.unhex(F.lpad(F.lit(""), 32, "0")), F.unhex(F.lpad(F.hex(F.lit(seed)), 8, "0")))))
    level = spark.range(1).select(start.alias("state"))
    levels = []
    for depth in range(most):
        level = settle(level.select("state", children(kind, sha_unit(F.col("state")), F.lit(depth), b0, limit, **more).alias("n")))
        levels.append(level.select(F.lit(depth).alias("depth"), "n"))
        nodes = level.where("n > 0").select("state", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("child"))
        if nodes.isEmpty():
            break
        # children of few parents would stay in few tasks
        level = nodes.select(sha_state(F.col("state"), F.col("child")).alias("state")).repartition(spark.sparkContext.defaultParallelism)
    return levels


# Its SQL holds the levels that the published rule gives in plain Python (tests/test_operators.py).
@query("q_uts_size", "SELECT CAST(depth AS INTEGER) AS depth, CAST(nodes AS BIGINT) AS nodes, CAST(leaves AS BIGINT) AS leaves FROM (VALUES (0, 1, 0), (1, 5, 0), (2, 59, 12), (3, 189, 42), (4, 690, 135), (5, 3043, 3043)) AS t(depth, nodes, leaves)")
def uts_size(spark, d, b0: float = 4.0, limit: int = 5, seed: int = 19, **more) -> DataFrame:
    """Nodes and leaves of every depth of a tree, a geometric one of fixed shape unless told otherwise."""
    levels = uts_tree(spark, b0, limit, seed, **({"shape": "fixed"} | more))
    return reduce(lambda a, b: a.unionByName(b), levels).groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("n") == 0).alias("leaves"))


@query("q_uts_shapes", "WITH d AS (SELECT CAST(x AS INTEGER) AS depth, CAST(x AS DOUBLE) AS x FROM (SELECT unnest(range(0, 41)) AS x)) SELECT shape, depth, round(CASE WHEN depth = 0 THEN 4.0 WHEN shape = 'fixed' THEN CASE WHEN depth < 8 THEN 4.0 ELSE 0.0 END WHEN shape = 'linear' THEN 4.0 * (1 - x / 8) WHEN shape = 'expdec' THEN 4.0 * pow(x, -ln(4.0) / ln(8.0)) WHEN depth > 40 THEN 0.0 ELSE pow(4.0, sin(2 * pi() * x / 8)) END, 9) AS branching FROM d, (VALUES ('fixed'), ('linear'), ('expdec'), ('cyclic')) AS s(shape)")
def uts_shapes(spark, d) -> DataFrame:
    """The mean number of children by depth for every shape: 4 at the root, limit 8."""
    depth = F.col("id").cast("int")
    out = [spark.range(41).select(F.lit(s).alias("shape"), depth.alias("depth"), F.round(target_branching(s, 4.0, depth, 8), 9).alias("branching")) for s in ("fixed", "linear", "expdec", "cyclic")]
    return reduce(lambda a, b: a.unionByName(b), out)


# ---- particles -----------------------------------------------------------------------------------


def particle_step(cells: DataFrame) -> DataFrame:
    """A cell checks that it and its neighbours are at its step, then takes the particles of (x - 1, y - 1)."""
    g = gather(cells.select("x", "y", F.struct("time", "particles").alias("v")), [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1)])
    t = F.col("n_0.time")
    ok = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"n_{k}.time") == t, F.lit(True)) for k in range(1, 5)])
    none = F.array().cast("array<bigint>")
    return g.where("n_0 IS NOT NULL").select("x", "y", F.when(ok, t + 1).alias("time"), F.coalesce("n_5.particles", none).alias("particles"))


@query("q_particle_cells", "WITH p AS (SELECT x, y, i FROM (SELECT unnest(range(0, 20)) AS x), (SELECT unnest(range(0, 20)) AS y), (SELECT unnest(range(0, 2)) AS i) WHERE (x + y) % 3 = 0) SELECT c.x, c.y, 3 AS time, count(p.i) AS particles, CAST(coalesce(sum(p.x * 1000 + p.y * 10 + p.i), 0) AS BIGINT) AS ids FROM (SELECT x, y FROM (SELECT unnest(range(0, 20)) AS x), (SELECT unnest(range(0, 20)) AS y)) c LEFT JOIN p ON p.x = c.x - 3 AND p.y = c.y - 3 GROUP BY c.x, c.y")
def particle_cells(spark, d) -> DataFrame:
    """Three steps of a 20 x 20 grid; number of particles and sum of their ids by cell."""
    x, y = F.floor(F.col("id") / 20).cast("long"), F.col("id") % 20
    first = F.when((x + y) % 3 == 0, F.array(x * 1000 + y * 10, x * 1000 + y * 10 + 1)).otherwise(F.array().cast("array<bigint>"))
    cells = spark.range(400).select(x.alias("x"), y.alias("y"), F.lit(0).alias("time"), first.alias("particles"))
    out = iterate(particle_step, cells, 3)
    return out.select("x", "y", "time", F.size("particles").cast("long").alias("particles"), F.aggregate("particles", F.lit(0).cast("long"), lambda a, b: a + b).alias("ids"))


# light's speed, the planet's radius and magnetic field, charge and mass of the particles (SI),
# the time step, the box's side in radii, the most sub-steps of a step.
LIGHT, RADIUS_M, FIELD, CHARGE, MASS, STEP_S, SIDE, MOST_SUBSTEPS = 299792458.0, 6378137.0, 3.07e-5, 1.602176565e-19, 1.672621777e-27, 0.01, 20.0, 100


def dipole(p: np.ndarray) -> np.ndarray:
    """The planet's field at places relative to its centre."""
    x, y, z = p.T
    strength = -FIELD * RADIUS_M**3 / (p**2).sum(1) ** 2.5
    return np.stack([3 * x * z, 3 * y * z, 2 * z**2 - x**2 - y**2], 1) * strength[:, None]


def trace(position: np.ndarray, velocity: np.ndarray, steps: int, every: int, cells: int) -> list[np.ndarray]:
    """The cells (frame, x, y, z) of particles that fly through the field around a planet, in a periodic cube.

    Only those are traced that start in the cube and outside the planet. Steps 0 to steps: a step is cut, by
    each particle's own field, into equal parts that turn the velocity (half, whole, half) and move on. Who
    then is in the planet is gone; of the others the cell they came from counts at every so many steps.
    """
    half, qom = SIDE * RADIUS_M / 2, CHARGE / MASS
    own = ((position**2).sum(1) >= RADIUS_M**2) & (np.abs(position) <= half).all(1)
    p, v, out = position[own], velocity[own], []
    for step in range(steps + 1):
        cell = np.floor((p + half) / (2 * half / cells)).astype(np.int64)
        field = dipole(p)
        with np.errstate(divide="ignore"):
            longest = np.pi * LIGHT / (4 * qom * (field**2).sum(1))
        parts = np.minimum(STEP_S / longest, MOST_SUBSTEPS - 1).astype(np.int64) + 1
        dt = (STEP_S / parts)[:, None]
        t = 0.5 * qom * dt * field
        s = 2 * t / (1 + (t**2).sum(1))[:, None]
        for k in range(int(parts.max(initial=0))):
            on = np.flatnonzero(parts > k)
            v[on] += np.cross(v[on] + np.cross(v[on], t[on]), s[on])
            p[on] += v[on] * dt[on]
        p = np.where(p > half, p - 2 * half, p)
        p = np.where(p < -half, p + 2 * half, p)
        alive = (p**2).sum(1) > RADIUS_M**2
        if step % every == 0:
            out.append(np.column_stack([np.full(int(alive.sum()), step // every), cell[alive]]))
        p, v = p[alive], v[alive]
    return out


@query("q_pic_density")
def pic_density(spark, d, particles: int = 5000, steps: int = 20, every: int = 5, cells: int = 8) -> DataFrame:
    """frame, x, y, z, n: particles by cell of a grid. Places are even in the middle three quarters of the cube,
    speeds normal around those of ten million electron volts. Each batch of particles is traced on its own;
    counts are combined before they are dealt out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = batch[["px", "py", "pz"]].to_numpy(np.float64)
            v = batch[["vx", "vy", "vz"]].to_numpy(np.float64)
            for frame in trace(p, v, steps, every, cells):
                yield pd.DataFrame(frame, columns=["frame", "x", "y", "z"]).astype({"frame": np.int32})

    u = lambda k: unit(F.col("id") * (2 * k + 3), 1000 * k + 7)
    side, energy = SIDE * RADIUS_M, 1e7 * CHARGE
    speed = LIGHT / (1 + MASS * LIGHT**2 / energy) ** 0.5
    normal = lambda k: F.sqrt(-2 * F.log(1 - u(k))) * F.cos(2 * np.pi * u(k + 3)) * speed
    born = spark.range(particles).select(*[((u(k) * 0.75 - 0.375) * side).alias(n) for k, n in enumerate(("px", "py", "pz"))], *[normal(k + 3).alias(n) for k, n in enumerate(("vx", "vy", "vz"))])
    return born.mapInPandas(run, "frame int, x long, y long, z long").groupBy("frame", "x", "y", "z").agg(F.count(F.lit(1)).alias("n"))


@query("q_scalar", "SELECT 12 AS written, 12 AS read")
def scalar(spark, d) -> DataFrame:
    """A one-row item that is written to the shared folder, replaced there, and read again."""
    before = settle(spark.range(1).select(F.lit(5).alias("value")))
    after = settle(before.select((F.col("value") + 7).alias("value")))
    return after.select(F.lit(12).alias("written"), F.col("value").alias("read"))
