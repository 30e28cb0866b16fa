"""Scheduling analytics: task maps, rebalancing, scores, frontiers, failure handling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import heap
from ..plans.intervals import earlier_sum
from ..plans.settle import settle
from ..registry import query
from ..sources import fixtures as fx
from ..sources.fixtures import with_sql

N = "node_state"


def share(k: Column, tasks: Column, nodes: Column) -> Column:
    """Tasks of the k-th of some nodes: equal shares, the first ones take what is left over."""
    each = F.floor(tasks / nodes)
    return (each + F.when(k < tasks - each * nodes, 1).otherwise(0)).cast("long")


def equal_distribution(nodes: DataFrame, tasks: int) -> DataFrame:
    """rank, tasks of the active nodes, in order of rank. Nodes are the machines: a short table."""
    active = nodes.where("active")
    k = F.row_number().over(Window.orderBy("rank")) - 1
    n = active.agg(F.count(F.lit(1)).alias("n"))
    return active.select("rank", k.alias("k")).join(F.broadcast(n)).select("rank", share(F.col("k"), F.lit(tasks), F.col("n")).alias("tasks"))


@query("q_equal_distribution", with_sql("SELECT rank, CAST(floor(1000 / n) + CASE WHEN k < 1000 % n THEN 1 ELSE 0 END AS BIGINT) AS tasks FROM (SELECT rank, row_number() OVER (ORDER BY rank) - 1 AS k, count(*) OVER () AS n FROM node_state WHERE active)", N))
def q_equal_distribution(spark, d) -> DataFrame:
    return equal_distribution(fx.node_state(spark, d), 1000)


def uniform_mapping(spark, nodes: int, granularity: int | None = None) -> DataFrame:
    """task, node: 2 ** level tasks in blocks of equal size, the first blocks one larger."""
    log = max(0, (nodes - 1).bit_length())
    level = max(log, max(log + 3, 5) if granularity is None else granularity)
    tasks = 2**level
    each, more = divmod(tasks, nodes)
    t = F.col("id")
    edge = more * (each + 1)
    node = F.when(t < edge, F.floor(t / (each + 1))).otherwise(more + F.floor((t - edge) / each)).cast("int")
    return spark.range(tasks).select(t.alias("task"), node.alias("node"))


@query("q_uniform_mapping", "SELECT t AS task, CAST(ntile(5) OVER (ORDER BY t) - 1 AS INTEGER) AS node FROM (SELECT unnest(range(0, 64)) AS t)")
def q_uniform_mapping(spark, d) -> DataFrame:
    return uniform_mapping(spark, 5)


def decisions(mapping: DataFrame, tasks_log: int, nodes: int) -> DataFrame:
    """path (heap index), decision: at every task path of a mapping, whether all tasks below go to the left
    or the right half of the nodes still possible there, or stay. Node ranges follow the decisions above."""
    ups = F.explode(F.sequence(F.lit(0), F.lit(tasks_log)))
    spans = mapping.select((F.col("task") + 2**tasks_log).alias("leaf"), "node", ups.alias("up")).select(F.expr("shiftright(leaf, up)").alias("path"), "node")
    spans = spans.groupBy("path").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    steps = max(0, (nodes - 1).bit_length())

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:  # one mapping: at most 2 ** (granularity + 1) paths
        span = {p: (a, b) for p, a, b in zip(pdf["path"], pdf["least"], pdf["most"], strict=True)}
        out, work = [], [(1, 0, 0, nodes)]
        while work:
            path, depth, lo, hi = work.pop()
            if path not in span or depth >= steps:
                continue
            least, most = span[path]
            mid = lo + (hi - lo) // 2
            if most < mid:
                out.append((path, "left"))
                depth, hi = depth + 1, mid
            elif least >= mid:
                out.append((path, "right"))
                depth, lo = depth + 1, mid
            else:
                out.append((path, "stay"))
            work += [(2 * path, depth, lo, hi), (2 * path + 1, depth, lo, hi)]
        return pd.DataFrame(sorted(out), columns=["path", "decision"])

    return spans.groupBy(F.lit(1).alias("one")).applyInPandas(walk, "path long, decision string")


def node_costs(loads: DataFrame, mapping: DataFrame) -> DataFrame:
    """node, tasks, cost: load by number of tasks; a node without tasks gets the mean load of a task."""
    owned = mapping.groupBy("node").agg(F.count(F.lit(1)).alias("tasks"))
    mean = loads.agg(F.sum("load").alias("total")).join(mapping.agg(F.count(F.lit(1)).alias("m"))).select((F.col("total") / F.col("m")).alias("mean"))
    t = loads.join(owned, "node", "left").join(F.broadcast(mean)).withColumn("tasks", F.coalesce("tasks", F.lit(0)))
    return t.select("node", "tasks", F.when(F.col("tasks") == 0, F.col("mean")).otherwise(F.col("load") / F.col("tasks")).alias("cost"))


_MAP3 = "mp AS (SELECT t AS task, CAST(ntile(3) OVER (ORDER BY t) - 1 AS INTEGER) AS node FROM (SELECT unnest(range(0, 32)) AS t))"
_COSTS = f"{_MAP3}, co AS (SELECT l.node, coalesce(k.tasks, 0) AS tasks, CASE WHEN k.tasks IS NULL THEN CAST((SELECT sum(load) FROM node_load) AS DOUBLE) / 32 ELSE CAST(load AS DOUBLE) / k.tasks END AS cost FROM node_load l LEFT JOIN (SELECT node, count(*) AS tasks FROM mp GROUP BY node) k ON k.node = l.node)"


@query("q_rebalance_costs", with_sql(f"WITH {_COSTS} SELECT * FROM co", "node_load"))
def rebalance_costs(spark, d) -> DataFrame:
    return node_costs(fx.node_load(spark, d), uniform_mapping(spark, 3, 5))


def assign_by_cost(costs: DataFrame, active: list[bool]) -> DataFrame:
    """task, node: tasks in order go to the next active node when their running cost passes the node's goal."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:  # one mapping, in order
        pdf = pdf.sort_values("task")
        usable = [k for k, a in enumerate(active) if a] or [0]
        goal = each = pdf["cost"].sum() / len(usable)
        at, done, out = 0, 0.0, []
        for c in pdf["cost"]:
            if at < len(usable) - 1 and done + c > goal:
                at += 1
                goal += each
            out.append(usable[at])
            done += c
        return pd.DataFrame({"task": pdf["task"], "node": np.array(out, np.int32)})

    return costs.select("task", "cost").groupBy(F.lit(1).alias("one")).applyInPandas(run, "task long, node int")


_REBALANCE = f"""WITH RECURSIVE {_COSTS}, tc AS (SELECT task, cost FROM mp JOIN co ON co.node = mp.node), ea AS (SELECT sum(cost) / 3 AS each FROM tc),
 r(task, pos, done, goal) AS (SELECT CAST(-1 AS BIGINT), 0, CAST(0 AS DOUBLE), each FROM ea UNION ALL
   SELECT tc.task, CASE WHEN pos < 2 AND done + cost > goal THEN pos + 1 ELSE pos END, done + cost, CASE WHEN pos < 2 AND done + cost > goal THEN goal + each ELSE goal END
   FROM r JOIN tc ON tc.task = r.task + 1, ea)
 SELECT task, CAST([0, 2, 3][pos + 1] AS INTEGER) AS node FROM r WHERE task >= 0"""


@query("q_rebalance_map", with_sql(_REBALANCE, "node_load"))
def rebalance_map(spark, d) -> DataFrame:
    mapping = uniform_mapping(spark, 3, 5)
    costs = node_costs(fx.node_load(spark, d), mapping).select("node", "cost")
    return assign_by_cost(mapping.join(costs, "node"), [True, False, True, True])


def shift_boundaries(costs: np.ndarray, mapping: np.ndarray, nodes: int) -> np.ndarray:
    """A mapping in blocks, with one task moved over a boundary wherever a node's mean cost leaves the 95 %
    interval around the overall mean; nodes without tasks are skipped."""
    mean = costs.mean()
    var = ((costs - mean) ** 2).mean()
    margin = 1.96 * np.sqrt(var / len(costs))
    size = np.bincount(mapping, minlength=nodes)
    own = np.bincount(mapping, costs, nodes) / np.maximum(size, 1)
    if var < 0.01:
        return mapping
    for k in range(nodes):
        near = [j for j in (k - 1, k + 1) if 0 <= j < nodes and size[j] > 0]
        if not size[k] or not near:
            continue
        if own[k] > mean + margin and size[k] > 1:
            j = min(near, key=lambda j: (own[j], -j))
            if own[j] < own[k] - margin:
                size[k] -= 1
                size[j] += 1
        elif own[k] < mean - margin:
            j = max(near, key=lambda j: (own[j], -j))
            if size[j] > 1 and own[j] > own[k] + margin:
                size[k] += 1
                size[j] -= 1
    return np.repeat(np.arange(nodes), size)


@query("q_rebalance_times")
def rebalance_times(spark, d, nodes: int = 4) -> DataFrame:
    """From the task times of 64 paths of one level."""
    deep = fx.task_profile(spark, d).where(heap.depth(F.col("heap")) >= 6)
    costs = deep.groupBy((heap.ancestor(F.col("heap"), 6) - 64).alias("task")).agg((F.sum(F.col("end_us") - F.col("start_us")) / 1e6).alias("cost"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("task")
        before = np.repeat(np.arange(nodes), len(pdf) // nodes + 1)[: len(pdf)]
        return pd.DataFrame({"task": pdf["task"], "node": shift_boundaries(pdf["cost"].to_numpy(), before, nodes).astype(np.int32)})

    return costs.groupBy(F.lit(1).alias("one")).applyInPandas(run, "task long, node int")


@query("q_random_policy", with_sql("SELECT heap, CASE WHEN length(bin(heap)) - 1 < 3 THEN 'stay' WHEN (heap * 48271) % 2147483647 < 1073741823 THEN 'left' ELSE 'right' END AS decision FROM task_profile", "task_profile"))
def random_policy(spark, d) -> DataFrame:
    """Short paths stay, others go either way by a hash of the path."""
    h = F.col("heap")
    coin = F.when((h * 48271) % 2147483647 < 1073741823, "left").otherwise("right")
    return fx.task_profile(spark, d).select("heap", F.when(heap.depth(h) < 3, "stay").otherwise(coin).alias("decision"))


# ---- states and scores ---------------------------------------------------------------------------


@query("q_load_variance", with_sql("SELECT round(avg(load), 6) AS mean, round(coalesce(var_samp(load), 0), 6) AS variance FROM node_state WHERE active", N))
def load_variance(spark, d) -> DataFrame:
    """Sample variance; 0 for one node."""
    return fx.node_state(spark, d).where("active").agg(F.round(F.avg("load"), 6).alias("mean"), F.round(F.coalesce(F.var_samp("load"), F.lit(0.0)), 6).alias("variance"))


def score(speed: Column, efficiency: Column, power: Column, m: Column, n: Column, k: Column) -> Column:
    return F.pow(speed, m) * F.pow(efficiency, n) * F.pow(1 - power, k)


def derived(nodes: DataFrame) -> DataFrame:
    """nodes with speed, efficiency and power shares."""
    speed = F.col("cpu_load")
    efficiency = speed * (F.col("cur_frequency") * F.col("active_cores")) / (F.col("max_frequency") * F.col("num_cores"))
    return nodes.withColumns({"speed": speed, "efficiency": efficiency, "power": F.when(F.col("max_power") == 0, 0.0).otherwise(F.col("cur_power") / F.col("max_power"))})


_DERIVED = "dv AS (SELECT *, cpu_load AS speed, cpu_load * (cur_frequency * active_cores) / (max_frequency * num_cores) AS efficiency, cur_power / max_power AS power FROM node_state)"


@query("q_node_state", with_sql(f"WITH {_DERIVED} SELECT rank, speed, round(efficiency, 9) AS efficiency, power FROM dv", N))
def q_node_state(spark, d) -> DataFrame:
    return derived(fx.node_state(spark, d)).select("rank", "speed", F.round("efficiency", 9).alias("efficiency"), "power")


@query("q_score", with_sql(f"WITH {_DERIVED} SELECT rank, round(pow(speed, 1.0) * pow(efficiency, 0.5) * pow(1 - power, 2.0), 9) AS score FROM dv", N))
def q_score(spark, d) -> DataFrame:
    s = score(F.col("speed"), F.col("efficiency"), F.col("power"), F.lit(1.0), F.lit(0.5), F.lit(2.0))
    return derived(fx.node_state(spark, d)).select("rank", F.round(s, 9).alias("score"))


def system_state(nodes: DataFrame) -> DataFrame:
    """Sums over nodes that are online and active, by the number of all; power by its most."""
    on = F.col("online") & F.col("active")
    of = lambda c: F.sum(F.when(on, F.col(c)).otherwise(0.0))
    return derived(nodes).agg(
        F.round(of("speed") / F.count(F.lit(1)), 9).alias("speed"), F.round(of("efficiency") / F.count(F.lit(1)), 9).alias("efficiency"),
        F.round(F.when(F.sum("max_power") == 0, 0.0).otherwise(of("cur_power") / F.sum("max_power")), 9).alias("power"), F.count_if(on).alias("nodes"),
    )


_SYSTEM = f"{_DERIVED} SELECT round(sum(CASE WHEN online AND active THEN speed ELSE 0 END) / count(*), 9) AS speed, round(sum(CASE WHEN online AND active THEN efficiency ELSE 0 END) / count(*), 9) AS efficiency, round(sum(CASE WHEN online AND active THEN cur_power ELSE 0 END) / sum(max_power), 9) AS power, count(*) FILTER (WHERE online AND active) AS nodes FROM dv"


@query("q_system_state", with_sql(f"WITH {_SYSTEM}", N))
def q_system_state(spark, d) -> DataFrame:
    return system_state(fx.node_state(spark, d))


@query("q_system_json", with_sql("SELECT rank, '{\"id\":' || rank || ',\"online\":' || online || ',\"active\":' || active || ',\"num_cores\":' || num_cores || ',\"weighted_task_througput\":' || load || '}' AS json FROM node_state", N))
def system_json(spark, d) -> DataFrame:
    """A node as the dashboard's JSON; one key is spelt as its readers expect."""
    s = F.struct(F.col("rank").alias("id"), "online", "active", "num_cores", F.col("load").alias("weighted_task_througput"))
    return fx.node_state(spark, d).select("rank", F.to_json(s).alias("json"))


def framed(df: DataFrame, column: str = "json") -> DataFrame:
    """Messages as the dashboard reads them: eight bytes of length, big-endian, and the text."""
    body = F.encode(F.col(column), "UTF-8")
    return df.withColumn("frame", F.concat(F.unhex(F.lpad(F.hex(F.octet_length(body)), 16, "0")), body))


@query("q_objective_parse", "SELECT * FROM (VALUES ('speed', 1, 0, 0), ('efficiency', 0, 1, 0), ('power', 0, 0, 1), ('sse', 2, 1, 0), ('p', 0, 0, 1), ('', 0, 0, 0)) AS t(objective, m, n, k)")
def objective_parse(spark, d) -> DataFrame:
    """Exponents of an objective: a name, or letters s, e and p that add up."""
    o = F.col("objective")
    names = {"speed": "s", "efficiency": "e", "power": "p"}
    letters = o
    for name, letter in names.items():
        letters = F.when(o == name, letter).otherwise(letters)
    count = lambda c: F.regexp_count(letters, F.lit(c)).cast("int")
    rows = spark.createDataFrame([(x,) for x in ("speed", "efficiency", "power", "sse", "p", "")], "objective string")
    return rows.select("objective", count("s").alias("m"), count("e").alias("n"), count("p").alias("k"))


@query("q_tune_state", with_sql(f"WITH {_DERIVED} SELECT round(avg(speed), 9) AS speed, round(avg(efficiency), 9) AS efficiency FROM dv WHERE active", N))
def tune_state(spark, d) -> DataFrame:
    return derived(fx.node_state(spark, d)).where("active").agg(F.round(F.avg("speed"), 9).alias("speed"), F.round(F.avg("efficiency"), 9).alias("efficiency"))


def power_estimate(frequency: Column, c: float = 100.0, u: float = 0.8) -> Column:
    return c * frequency * frequency * u * u


@query("q_power_estimate", with_sql("SELECT rank, round(100.0 * (cur_frequency / 1000) * (cur_frequency / 1000) * 0.8 * 0.8, 6) AS watts FROM node_state", N))
def q_power_estimate(spark, d) -> DataFrame:
    return fx.node_state(spark, d).select("rank", F.round(power_estimate(F.col("cur_frequency") / 1000), 6).alias("watts"))


# ---- frontiers -----------------------------------------------------------------------------------


def pareto(points: DataFrame) -> DataFrame:
    """Points (id, load, time, energy) that none dominates: load is to be large, time and energy small.

    Of equal values one row stands for all; a point first has to survive the frontier of its own partition,
    then those of all partitions: each block of survivors is held against every other, so that no task has
    more than two blocks of them, however many there are.
    """
    values = points.select("load", "time", "energy").distinct()

    def local(batches):
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b])
            held = held[_undominated(held[["load", "time", "energy"]].to_numpy(float))]
        if held is not None:
            yield held

    def against(pdf: pd.DataFrame) -> pd.DataFrame:
        own, others = pdf[pdf["side"] == 0], pdf[["load", "time", "energy"]].to_numpy(float) * FRONTIER
        key = own[["load", "time", "energy"]].to_numpy(float) * FRONTIER
        lost = [bool(((others <= k).all(1) & (others < k).any(1)).any()) for k in key]
        return own[lost][["load", "time", "energy"]]

    schema = values.schema
    some = settle(values.mapInPandas(local, schema))
    blocks = max(1, -(-some.count() // FRONTIER_BLOCK))
    dealt = some.withColumn("own", F.pmod(F.xxhash64("load", "time", "energy"), F.lit(blocks)).cast("int"))
    # a block as candidates beside each block, and as that block
    candidates = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("side", F.lit(0))
    rivals = dealt.withColumnRenamed("own", "other").withColumn("own", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("side", F.lit(1))
    lost = candidates.unionByName(rivals).groupBy("own", "other").applyInPandas(against, schema).distinct()
    best = some.join(lost, ["load", "time", "energy"], "left_anti")
    return points.join(best, ["load", "time", "energy"]).select("id", "load", "time", "energy")


#: What makes a point better is less of load, time and energy times these.
FRONTIER = np.array([-1.0, 1.0, 1.0])
FRONTIER_BLOCK = 8192


def _undominated(v: np.ndarray) -> np.ndarray:
    key = v * FRONTIER
    order = np.lexsort((key[:, 2], key[:, 1], key[:, 0]))
    keep: list[int] = []
    for i in order:
        k = key[keep]
        if not len(keep) or not ((k <= key[i]).all(1) & (k < key[i]).any(1)).any():
            keep.append(i)
    out = np.zeros(len(v), bool)
    out[keep] = True
    return out


_POINTS = "pt AS (SELECT p_partkey AS id, p_size AS load, CAST(p_partkey * 7919 % 1009 AS BIGINT) AS time, CAST(p_partkey * 104729 % 997 AS BIGINT) AS energy FROM part)"


def _points(spark, d) -> DataFrame:
    return fx.table(spark, d, "part").selectExpr("p_partkey AS id", "p_size AS load", "p_partkey * 7919 % 1009 AS time", "p_partkey * 104729 % 997 AS energy")


@query("q_pareto", f"WITH {_POINTS} SELECT * FROM pt p WHERE NOT EXISTS (SELECT 1 FROM pt q WHERE q.load >= p.load AND q.time <= p.time AND q.energy <= p.energy AND (q.load > p.load OR q.time < p.time OR q.energy < p.energy))")
def q_pareto(spark, d) -> DataFrame:
    return pareto(_points(spark, d))


@query("q_latest_point", "SELECT event_type AS knob, user_id % 16 AS nodes, max(event_id) AS id, arg_max(value, event_id) AS value FROM events WHERE event_id >= (SELECT max(event_id) FROM events) - 4000 GROUP BY 1, 2")
def latest_point(spark, d, interval: int = 4000) -> DataFrame:
    """The last point recorded of each setting within the history."""
    e = fx.table(spark, d, "events").selectExpr("event_type AS knob", "user_id % 16 AS nodes", "event_id AS id", "value")
    last = e.agg((F.max("id") - interval).alias("oldest"))  # one row
    return e.join(F.broadcast(last)).where("id >= oldest").groupBy("knob", "nodes").agg(F.max("id").alias("id"), F.max_by("value", "id").alias("value"))


# ---- schedules over nodes ------------------------------------------------------------------------


def schedule_costs(loads: DataFrame, mapping: DataFrame) -> DataFrame:
    """node, load, tasks, cost of a task (at least 0.001), threshold of acting: the sample variance of loads
    times the root of two."""
    t = loads.join(mapping.groupBy("node").agg(F.count(F.lit(1)).alias("tasks")), "node")
    var = loads.agg((F.coalesce(F.var_samp(F.col("load") / 1e6), F.lit(0.0)) * 1.41421356237).alias("threshold"))
    return t.join(F.broadcast(var)).select("node", "load", "tasks", F.greatest(F.col("load") / F.col("tasks") / 1e6, F.lit(0.001)).alias("cost"), F.round("threshold", 6).alias("threshold"))


_MAP4 = "mp AS (SELECT t AS task, CAST(ntile(4) OVER (ORDER BY t) - 1 AS INTEGER) AS node FROM (SELECT unnest(range(0, 32)) AS t))"


@query("q_ino_costs", with_sql(f"WITH {_MAP4} SELECT l.node, load, tasks, greatest(CAST(load AS DOUBLE) / tasks / 1e6, 0.001) AS cost, round(v.threshold, 6) AS threshold FROM node_load l JOIN (SELECT node, count(*) AS tasks FROM mp GROUP BY node) k ON k.node = l.node, (SELECT coalesce(var_samp(CAST(load AS DOUBLE) / 1e6), 0) * 1.41421356237 AS threshold FROM node_load) v", "node_load"))
def ino_costs(spark, d) -> DataFrame:
    return schedule_costs(fx.node_load(spark, d), uniform_mapping(spark, 4, 5))


def decide(costs: dict[int, float], times: dict[int, float], tasks: dict[int, list[int]], nodes: int, top: int = 1, bottom: int = 1) -> dict[int, int]:
    """task -> node. With another number of nodes all tasks are dealt anew; else the slowest and the fastest
    node share their tasks if their times differ enough. Each task goes to the least loaded node (ties: the
    one that was filled first stays first); tasks come in order of their number."""
    out = {t: n for n, own in tasks.items() for t in own}
    if len(times) != nodes or len(times) < top + bottom:
        work, load = [(costs[n], t) for n in sorted(tasks) for t in sorted(tasks[n])], {n: 0.0 for n in range(nodes)}
    else:
        order = sorted(times, key=lambda n: (-times[n], n))
        values = np.array(list(times.values()))
        threshold = (values.var(ddof=1) if len(values) > 1 else 0.0) * 1.41421356237
        slow, fast = order[:top], order[len(order) - bottom :]
        high, low = np.mean([times[n] for n in slow]), np.mean([times[n] for n in fast])
        if (high - low) ** 2 < threshold or threshold <= 0.01:
            return out
        load = {n: 0.0 for n in [*slow, *fast]}
        work = [(costs[n] * (times[n] / low if n in slow else 1.0), t) for n in [*slow, *fast] for t in sorted(tasks.get(n, []))]
    for c, t in work:
        n = min(load, key=lambda k: (load[k], k))
        load[n] += c
        out[t] = n
    return out


@query("q_ino_schedule")
def ino_schedule(spark, d) -> DataFrame:
    """A new schedule of 32 tasks; one group, as large as the mapping."""
    mapping = uniform_mapping(spark, 4, 5)
    costs = schedule_costs(fx.node_load(spark, d), mapping).select("node", "load", "cost")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.drop_duplicates("node")
        found = decide(dict(zip(one["node"], one["cost"], strict=True)), dict(zip(one["node"], one["load"] / 1e5, strict=True)), pdf.groupby("node")["task"].apply(list).to_dict(), 4)
        return pd.DataFrame(sorted(found.items()), columns=["task", "node"])

    return mapping.join(costs, "node").groupBy(F.lit(1).alias("one")).applyInPandas(run, "task long, node int")


#: Samples of a history beyond which it is cut, and to how many.
HISTORY, HISTORY_CUT = 1000, 500


@query("q_leeway_bound", "WITH c AS (SELECT event_type AS objective, count(*) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY 1), s AS (SELECT event_type AS objective, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) SELECT c.objective, count(*) AS samples, round(avg(value), 6) AS mean, least, most, round(least + 0.2 * (most - least), 6) AS bound FROM c JOIN s ON s.objective = c.objective AND k <= CASE WHEN n <= 1000 THEN n ELSE 500 + (n - 1001) % 501 END GROUP BY c.objective, least, most")
def leeway_bound(spark, d, leeway: float = 0.2) -> DataFrame:
    """Of each objective: the samples its history still holds, and what a lower objective may cost it, between
    the least and the most that ever were. A history that grows beyond HISTORY is cut to the last HISTORY_CUT."""
    e = fx.table(spark, d, "events").select(F.col("event_type").alias("objective"), "value", "event_id")
    n, again = F.col("n"), HISTORY + 1 - HISTORY_CUT
    held = F.when(n <= HISTORY, n).otherwise(HISTORY_CUT + (n - HISTORY - 1) % again)
    whole = e.groupBy("objective").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most")).withColumn("held", held)
    k = F.row_number().over(Window.partitionBy("objective").orderBy(F.desc("event_id")))
    last = e.withColumn("k", k).where(F.col("k") <= HISTORY)  # ranked in part before the exchange, as at most HISTORY are kept
    kept = last.join(F.broadcast(whole), "objective").where("k <= held")
    bound = F.round(F.col("least") + leeway * (F.col("most") - F.col("least")), 6)
    return kept.groupBy("objective", "least", "most").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("value"), 6).alias("mean")).select("objective", "samples", "mean", "least", "most", bound.alias("bound"))


# ---- failures ------------------------------------------------------------------------------------


_LIVING = "[0, 1, 2, 4, 5, 6, 7]"


@query("q_reschedule", with_sql(f"WITH p AS (SELECT heap, locality FROM task_profile), r AS (SELECT heap, row_number() OVER (ORDER BY heap) - 1 AS k, count(*) OVER () AS n FROM p WHERE locality = 3), x AS (SELECT heap, CASE WHEN k < (n % 7) * (n // 7 + 1) THEN k // (n // 7 + 1) ELSE n % 7 + (k - (n % 7) * (n // 7 + 1)) // (n // 7) END AS i FROM r) SELECT p.heap, CASE WHEN p.locality <> 3 THEN p.locality ELSE CAST({_LIVING}[CAST(i + 1 AS BIGINT)] AS INTEGER) END AS locality FROM p LEFT JOIN x ON x.heap = p.heap", "task_profile"))
def reschedule(spark, d, dead: int = 3, ranks: int = 8) -> DataFrame:
    """Tasks of a dead rank, in order, go to the living in equal shares, the first ones larger by one; the
    others stay. Numbers come from positions in ranges of the path, and of ranges of ranges, so the tasks
    are not ordered in one place."""
    p = fx.task_profile(spark, d).select("heap", "locality")
    lost = p.where(F.col("locality") == dead).withColumn("_bin", F.floor(F.col("heap") / 4096).cast("long"))
    per = earlier_sum(lost.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")), "n")
    k = F.col("base") + F.row_number().over(Window.partitionBy("_bin").orderBy("heap")) - 1
    living = [r for r in range(ranks) if r != dead]
    total = lost.agg(F.count(F.lit(1)).alias("total"))  # one row
    numbered = lost.join(per, "_bin").select("heap", k.alias("k")).join(F.broadcast(total))
    each = F.floor(F.col("total") / len(living))
    more = F.col("total") % len(living)
    edge = more * (each + 1)
    place = F.when(F.col("k") < edge, F.floor(F.col("k") / (each + 1))).otherwise(more + F.floor((F.col("k") - edge) / F.greatest(each, F.lit(1))))
    moved = numbered.select("heap", F.element_at(F.array(*[F.lit(r) for r in living]), (place + 1).cast("int")).alias("locality"))
    return p.where(F.col("locality") != dead).unionByName(moved)


@query("q_failed_ranks", with_sql("WITH b AS (SELECT rank, max(t) AS seen FROM node_sample WHERE NOT (rank = 2 AND t > (SELECT max(t) - 30 FROM node_sample)) GROUP BY rank) SELECT rank, seen, (SELECT max(t) FROM node_sample) > seen + 12 AS failed FROM b", "node_sample"))
def failed_ranks(spark, d, delta: int = 12) -> DataFrame:
    """Ranks whose last beat lies more than delta behind the latest beat of all."""
    s = fx.node_sample(spark, d).select("rank", "t")
    now = s.agg(F.max("t").alias("now"))  # one row
    beats = s.join(F.broadcast(now)).where("NOT (rank = 2 AND t > now - 30)")
    return beats.groupBy("rank", "now").agg(F.max("t").alias("seen")).select("rank", "seen", (F.col("now") > F.col("seen") + delta).alias("failed"))


@query("q_guard_ring", with_sql("WITH r AS (SELECT rank FROM node_state WHERE online AND active) SELECT rank, coalesce(lead(rank) OVER (ORDER BY rank), (SELECT min(rank) FROM r)) AS guards FROM r", N))
def guard_ring(spark, d) -> DataFrame:
    """Each running rank and the next one it guards, around. Ranks are the machines: a short table."""
    r = fx.node_state(spark, d).where("online AND active").select("rank")
    w = Window.orderBy("rank")
    first = F.min("rank").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return r.select("rank", F.coalesce(F.lead("rank").over(w), first).alias("guards"))


@query("q_split_filter", with_sql("SELECT heap FROM task_profile WHERE heap % 5 <> 0 AND length(bin(heap)) - 1 < 9", "task_profile"))
def split_filter(spark, d, cutoff: int = 9) -> DataFrame:
    """Tasks that can be split and are not yet as deep as the cut-off."""
    return fx.task_profile(spark, d).where((F.col("heap") % 5 != 0) & (heap.depth(F.col("heap")) < cutoff)).select("heap")
