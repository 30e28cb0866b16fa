"""Where tasks go under a tree of decisions, what is involved on the way, and choices of policies and points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from .scheduling import decisions, uniform_mapping

#: SQL of the decisions of a map (task, node) of 2 ** LOG tasks over NODES nodes, as paths with a range of nodes.
TREE_SQL = """sp AS (SELECT (task + (1 << {log})) >> up AS path, min(node) AS least, max(node) AS most FROM mp, (SELECT unnest(range(0, {log} + 1)) AS up) GROUP BY 1),
 w(path, depth, lo, hi) AS (SELECT CAST(1 AS BIGINT), 0, 0, {nodes} UNION ALL
   SELECT 2 * w.path + c, CASE WHEN s.most < lo + (hi - lo) // 2 OR s.least >= lo + (hi - lo) // 2 THEN depth + 1 ELSE depth END,
     CASE WHEN s.least >= lo + (hi - lo) // 2 THEN lo + (hi - lo) // 2 ELSE lo END, CASE WHEN s.most < lo + (hi - lo) // 2 THEN lo + (hi - lo) // 2 ELSE hi END
   FROM w JOIN sp s ON s.path = w.path, (SELECT unnest([0, 1]) AS c) WHERE depth < {steps}),
 dt AS (SELECT CAST(w.path AS BIGINT) AS path, CASE WHEN most < lo + (hi - lo) // 2 THEN 'left' WHEN least >= lo + (hi - lo) // 2 THEN 'right' ELSE 'stay' END AS decision
   FROM w JOIN sp ON sp.path = w.path WHERE depth < {steps})"""
_MAP4 = "mp AS (SELECT t AS task, CAST(floor(t / 8) AS INTEGER) AS node FROM (SELECT unnest(range(0, 32)) AS t))"
_TREE4 = f"{_MAP4}, {TREE_SQL.format(log=5, nodes=4, steps=2)}"
_TARGETS = """tg(path, rank, layer) AS (
   SELECT CAST(1 AS BIGINT), CASE WHEN decision = 'right' THEN 2 ELSE 0 END, CASE WHEN decision IN ('left', 'right') THEN 1 ELSE 2 END FROM (SELECT 1) LEFT JOIN dt ON dt.path = 1
   UNION ALL
   SELECT 2 * tg.path + c, CASE WHEN layer > 0 AND decision = 'right' THEN rank + (1 << (layer - 1)) ELSE rank END, CASE WHEN layer > 0 AND decision IN ('left', 'right') THEN layer - 1 ELSE layer END
   FROM tg CROSS JOIN (SELECT unnest([0, 1]) AS c) LEFT JOIN dt ON dt.path = 2 * tg.path + c WHERE tg.path < 32)"""


@query("q_decision_tree", f"WITH RECURSIVE {_TREE4} SELECT * FROM dt")
def decision_tree(spark, d) -> DataFrame:
    return decisions(uniform_mapping(spark, 4, 5), 5, 4)


def _follow(at: DataFrame, tree: DataFrame) -> DataFrame:
    """path, rank, layer of the parent's target to the path's own: leaves stay, others go as decided."""
    moves = F.col("layer") > 0
    half = F.expr("CAST(shiftleft(1, greatest(layer - 1, 0)) AS INT)")
    out = at.join(tree, "path", "left")
    return out.select(
        "path",
        F.when(moves & (F.col("decision") == "right"), F.col("rank") + half).otherwise(F.col("rank")).alias("rank"),
        F.when(moves & F.col("decision").isin("left", "right"), F.col("layer") - 1).otherwise(F.col("layer")).alias("layer"),
    )


def targets(tree: DataFrame, layers: int, depth: int) -> list[DataFrame]:
    """Of each level of task paths (heap indices) down to depth: path, rank and layer of the node it goes to.

    A path starts where its parent went; a node of layer 0 is a leaf. One join a level: levels are few.
    """
    spark = tree.sparkSession
    root = spark.range(1).select(F.lit(1).cast("long").alias("path"), F.lit(0).alias("rank"), F.lit(layers).alias("layer"))
    out = [_follow(root, tree)]
    for _ in range(depth):
        below = out[-1].select(F.explode(F.array(F.col("path") * 2, F.col("path") * 2 + 1)).alias("path"), "rank", "layer")
        out.append(_follow(below, tree))
    return out


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("q_task_target", f"WITH RECURSIVE {_TREE4}, {_TARGETS} SELECT path, CAST(rank AS INTEGER) AS rank, CAST(layer AS INTEGER) AS layer FROM tg")
def task_target(spark, d) -> DataFrame:
    """The node of the hierarchy that each task path goes to, for a uniform map over four nodes."""
    return _all(targets(decision_tree(spark, d), 2, 5))


def involved(found: DataFrame, layers: int, depth: int) -> DataFrame:
    """path, rank, layer: the nodes that take part in placing a path: the root and the targets of its prefixes."""
    ups = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("up")
    prefixes = found.select("path", ups).select("path", F.expr("shiftright(path, up)").alias("prefix")).where("prefix > 0")
    on = prefixes.join(found.withColumnRenamed("path", "prefix"), "prefix").select("path", "rank", "layer")
    return on.unionByName(found.select("path", F.lit(0).alias("rank"), F.lit(layers).alias("layer"))).distinct()


@query("q_involved", f"WITH RECURSIVE {_TREE4}, {_TARGETS} SELECT DISTINCT p.path, CAST(a.rank AS INTEGER) AS rank, CAST(a.layer AS INTEGER) AS layer FROM tg p, (SELECT unnest(range(0, 6)) AS up), tg a WHERE a.path = p.path >> up UNION SELECT path, CAST(0 AS INTEGER) AS rank, CAST(2 AS INTEGER) AS layer FROM tg")
def q_involved(spark, d) -> DataFrame:
    return involved(task_target(spark, d), 2, 5)


def distribution(tree: DataFrame, tasks_log: int, layers: int) -> DataFrame:
    """task, node: where every task of one level ends, going on to left children until the target is a leaf."""
    deepest = targets(tree, layers, tasks_log + layers)[-1]
    task = F.expr(f"shiftright(path, {layers}) - {2**tasks_log}")
    return deepest.where(F.col("path") % 2**layers == 0).select(task.alias("task"), F.col("rank").alias("node"))


def from_vector(spark, nodes_of_tasks: list[int], nodes: int) -> DataFrame:
    """The decisions of a given map: a node for each of a power of two tasks. A short list, a configuration.
    Decisions go as many levels below the tasks as nodes can still be halved."""
    log, steps = (len(nodes_of_tasks) - 1).bit_length(), max(0, (nodes - 1).bit_length())
    given = spark.createDataFrame(list(enumerate(nodes_of_tasks)), "task long, node int")
    fine = given.select(F.explode(F.sequence(F.col("task") * 2**steps, F.col("task") * 2**steps + 2**steps - 1)).alias("task"), "node")
    return decisions(fine, log + steps, nodes)


_VECTOR = [0, 0, 1, 1, 1, 2, 3, 3]


@query("q_map_from_vector", "SELECT CAST(i - 1 AS BIGINT) AS task, CAST(v[i] AS INTEGER) AS node FROM (SELECT [0, 0, 1, 1, 1, 2, 3, 3] AS v), (SELECT unnest(range(1, 9)) AS i)")
def map_from_vector(spark, d) -> DataFrame:
    """A map of eight tasks to decisions and back again."""
    return distribution(from_vector(spark, _VECTOR, 4), 3, 2)


# ---- policies ------------------------------------------------------------------------------------

# Names of policies, how they are replaced, and what they start from.
POLICIES = {"uniform": ("static", "tree"), "balanced": ("dynamic", "tree"), "tuned": ("tuned", "tree"), "ino": ("ino", "tree"), "random": ("random", "random")}


def policy(name: Column, part: int) -> Column:
    """part 0: how a policy is replaced; 1: what it starts from. Unknown and missing names are uniform."""
    out = F.lit(POLICIES["uniform"][part])
    for known, parts in POLICIES.items():
        out = F.when(name == known, parts[part]).otherwise(out)
    return out


@query("q_policy_choice", "SELECT name, CASE WHEN name IN ('tuned', 'ino', 'random') THEN name WHEN name = 'balanced' THEN 'dynamic' ELSE 'static' END AS kind, CASE WHEN name = 'random' THEN 'random' ELSE 'tree' END AS start FROM (SELECT DISTINCT CASE user_id % 7 WHEN 0 THEN 'uniform' WHEN 1 THEN 'balanced' WHEN 2 THEN 'tuned' WHEN 3 THEN 'ino' WHEN 4 THEN 'random' WHEN 5 THEN 'other' END AS name FROM events)")
def policy_choice(spark, d) -> DataFrame:
    """Of the names that the event stream's users ask for."""
    names = F.element_at(F.array(*[F.lit(n) for n in ("uniform", "balanced", "tuned", "ino", "random", "other", None)]), (F.col("user_id") % 7 + 1).cast("int"))
    asked = spark.read.parquet(f"{d}/events.parquet").select(names.alias("name")).distinct()
    return asked.select("name", policy(F.col("name"), 0).alias("kind"), policy(F.col("name"), 1).alias("start"))


# ---- points to explore ---------------------------------------------------------------------------

#: Fixed value: points held for exploration.
MOST_POINTS = 10


def explore(held: DataFrame, generated: DataFrame, forgotten: DataFrame, past: DataFrame, most: int = MOST_POINTS) -> DataFrame:
    """nodes, threads: held points, filled up to most: first from the generators (turn, generator, nodes,
    threads) in turn, then with forgotten points, then with past ones, both in order. A point that comes
    twice takes two places. All are configurations: short tables."""
    none = F.lit(0)
    rows = generated.select(none.alias("kind"), "turn", "generator", "nodes", "threads")
    for kind, more in ((1, forgotten), (2, past)):
        rows = rows.unionByName(more.select(F.lit(kind).alias("kind"), none.alias("turn"), none.alias("generator"), "nodes", "threads"))
    place = F.row_number().over(Window.orderBy("kind", "turn", "generator", "nodes", "threads"))
    room = held.agg((F.lit(most) - F.count(F.lit(1))).alias("room"))  # one row
    chosen = rows.withColumn("place", place).join(F.broadcast(room)).where("place <= room")
    return held.select("nodes", "threads").unionByName(chosen.select("nodes", "threads")).distinct()


_EXPLORE = """n AS (SELECT s_suppkey AS k FROM supplier ORDER BY s_suppkey LIMIT 10),
 held AS (SELECT CAST(k AS INTEGER) AS nodes, 1 AS threads FROM n WHERE k <= 2),
 rest AS (SELECT 0 AS kind, CAST(k AS INTEGER) AS turn, g AS generator, g AS nodes, CAST(k * 2 AS INTEGER) AS threads FROM n, (VALUES (1), (2)) AS x(g) WHERE k <= 2
   UNION ALL SELECT 1, 0, 0, CAST(k AS INTEGER), 9 FROM n WHERE k % 4 = 1 UNION ALL SELECT 2, 0, 0, CAST(k AS INTEGER), 7 FROM n)"""


@query("q_explore", f"WITH {_EXPLORE}, r AS (SELECT *, row_number() OVER (ORDER BY kind, turn, generator, nodes, threads) AS place FROM rest) SELECT DISTINCT nodes, threads FROM (SELECT nodes, threads FROM held UNION ALL SELECT nodes, threads FROM r WHERE place <= 10 - (SELECT count(*) FROM held))")
def q_explore(spark, d) -> DataFrame:
    """Points made of the first ten suppliers as node counts."""
    n = spark.read.parquet(f"{d}/supplier.parquet").orderBy("s_suppkey").limit(10).select(F.col("s_suppkey").cast("int").alias("k"))
    held = n.where("k <= 2").select(F.col("k").alias("nodes"), F.lit(1).alias("threads"))
    made = n.where("k <= 2").select(F.col("k").alias("turn"), F.explode(F.array(F.lit(1), F.lit(2))).alias("generator"), (F.col("k") * 2).alias("threads")).withColumn("nodes", F.col("generator"))
    of = lambda threads: [F.col("k").alias("nodes"), F.lit(threads).alias("threads")]
    return explore(held, made, n.where("k % 4 = 1").select(*of(9)), n.select(*of(7)))
