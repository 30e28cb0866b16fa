"""Monitoring analytics over finished tasks: times, children, trees, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import heap
from ..plans.ordered import with_next
from ..registry import query
from ..sources import fixtures as fx
from ..sources.fixtures import with_sql

US = 1_000_000.0
LEVEL = 14
P = "task_profile"


def exclusive(profiles: DataFrame) -> DataFrame:
    """heap, seconds of every profiled task."""
    return profiles.select("heap", ((F.col("end_us") - F.col("start_us")) / US).alias("seconds"))


@query("q_exclusive_time", with_sql("SELECT e.heap, coalesce((end_us - start_us) / 1000000.0, 0.0) AS seconds FROM (SELECT event_id + 1 AS heap FROM events) e LEFT JOIN task_profile p ON p.heap = e.heap", P))
def exclusive_time(spark, d) -> DataFrame:
    """Of every task; 0.0 where there is no profile."""
    tasks = fx.table(spark, d, "events").select((F.col("event_id") + 1).alias("heap"))
    return tasks.join(exclusive(fx.task_profile(spark, d)), "heap", "left").fillna(0.0, ["seconds"])


def inclusive(profiles: DataFrame) -> DataFrame:
    """heap, seconds from a task's start to the last end of it and its direct children; 0.0 for leaves."""
    ends = profiles.groupBy(F.col("parent").alias("heap")).agg(F.max("end_us").alias("last"))
    seconds = (F.greatest("end_us", "last") - F.col("start_us")) / US
    return profiles.join(ends, "heap", "left").select("heap", F.when(F.col("last").isNotNull(), seconds).otherwise(0.0).alias("seconds"))


@query("q_inclusive_time", with_sql("WITH c AS (SELECT parent, max(end_us) AS last FROM task_profile GROUP BY parent) SELECT p.heap, CASE WHEN last IS NULL THEN 0.0 ELSE (greatest(end_us, last) - start_us) / 1000000.0 END AS seconds FROM task_profile p LEFT JOIN c ON c.parent = p.heap", P))
def inclusive_time(spark, d) -> DataFrame:
    return inclusive(fx.task_profile(spark, d))


def by_name(profiles: DataFrame) -> DataFrame:
    """name, n, and mean, least and largest exclusive seconds."""
    us = F.col("end_us") - F.col("start_us")
    return profiles.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), (F.sum(us) / F.count(F.lit(1)) / US).alias("mean"), (F.min(us) / US).alias("least"), F.greatest(F.max(us) / US, F.lit(0.0)).alias("largest")
    )


def _named(column: str):
    def run(spark, d) -> DataFrame:
        return by_name(fx.task_profile(spark, d)).select("name", column)

    return run


query("q_avg_by_name", with_sql("SELECT name, CAST(sum(end_us - start_us) AS DOUBLE) / count(*) / 1000000.0 AS mean FROM task_profile GROUP BY name", P))(_named("mean"))
query("q_min_by_name", with_sql("SELECT name, min(end_us - start_us) / 1000000.0 AS least FROM task_profile GROUP BY name", P))(_named("least"))
query("q_max_by_name", with_sql("SELECT name, greatest(max(end_us - start_us) / 1000000.0, 0.0) AS largest FROM task_profile GROUP BY name", P))(_named("largest"))


def children(profiles: DataFrame, edges: DataFrame) -> DataFrame:
    """heap of every parent: mean over all its children, of whom those without a profile count 0; sample
    deviation over the profiled ones, 0.0 below two."""
    us = F.col("end_us") - F.col("start_us")
    times = profiles.select("heap", us.alias("us"))
    return edges.join(times, "heap", "left").groupBy(F.col("parent").alias("heap")).agg(
        (F.coalesce(F.sum("us"), F.lit(0)) / F.count(F.lit(1)) / US).alias("child_mean"), F.round(F.coalesce(F.stddev_samp(F.col("us") / US), F.lit(0.0)), 6).alias("child_sd")
    )


_CHILDREN = "SELECT e.parent AS heap, CAST(coalesce(sum(end_us - start_us), 0) AS DOUBLE) / count(*) / 1000000.0 AS child_mean, round(coalesce(stddev_samp((end_us - start_us) / 1000000.0), 0.0), 6) AS child_sd FROM task_edges e LEFT JOIN task_profile p ON p.heap = e.heap GROUP BY e.parent"


@query("q_children_mean", with_sql(f"SELECT heap, child_mean FROM ({_CHILDREN})", P, "task_edges"))
def children_mean(spark, d) -> DataFrame:
    return children(fx.task_profile(spark, d), fx.task_edges(spark, d)).select("heap", "child_mean")


@query("q_children_sd", with_sql(f"SELECT heap, child_sd FROM ({_CHILDREN})", P, "task_edges"))
def children_sd(spark, d) -> DataFrame:
    return children(fx.task_profile(spark, d), fx.task_edges(spark, d)).select("heap", "child_sd")


def last_times(profiles: DataFrame, n: int) -> DataFrame:
    """The exclusive seconds of the n tasks that ended last (ties: the larger heap)."""
    return profiles.orderBy(F.desc("end_us"), F.desc("heap")).limit(n).select(((F.col("end_us") - F.col("start_us")) / US).alias("seconds"))


_LAST = "(SELECT (end_us - start_us) / 1000000.0 AS seconds FROM task_profile ORDER BY end_us DESC, heap DESC LIMIT 100)"


@query("q_avg_last_n", with_sql(f"SELECT count(*) AS n, round(avg(seconds), 6) AS mean FROM {_LAST}", P))
def avg_last_n(spark, d) -> DataFrame:
    return last_times(fx.task_profile(spark, d), 100).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("seconds"), 6).alias("mean"))


@query("q_sd_last_n", with_sql(f"SELECT count(*) AS n, round(stddev_pop(seconds), 6) AS sd FROM {_LAST}", P))
def sd_last_n(spark, d) -> DataFrame:
    """Population deviation."""
    return last_times(fx.task_profile(spark, d), 100).agg(F.count(F.lit(1)).alias("n"), F.round(F.stddev_pop("seconds"), 6).alias("sd"))


@query("q_avg_idle", with_sql("SELECT CAST(sum(end_us - start_us) AS DOUBLE) / count(*) / (max(end_us) - min(start_us)) AS busy_share FROM task_profile", P))
def avg_idle(spark, d) -> DataFrame:
    """Mean duration by elapsed time."""
    us = F.col("end_us") - F.col("start_us")
    return fx.task_profile(spark, d).agg((F.sum(us) / F.count(F.lit(1)) / (F.max("end_us") - F.min("start_us"))).alias("busy_share"))


# ---- samples of nodes ----------------------------------------------------------------------------


def counters(samples: DataFrame) -> DataFrame:
    """Running totals of used and idle by rank. One row a node and hour: a node's series is short."""
    w = Window.partitionBy("rank").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return samples.select("rank", "t", F.sum("used").over(w).alias("used"), F.sum("idle").over(w).alias("idle"))


_COUNTERS = "c AS (SELECT rank, t, sum(used) OVER w AS used, sum(idle) OVER w AS idle FROM node_sample WINDOW w AS (PARTITION BY rank ORDER BY t))"


@query("q_cpu_load", with_sql(f"WITH {_COUNTERS}, x AS (SELECT rank, t, used - coalesce(lag(used) OVER w, 0) AS u, idle - coalesce(lag(idle) OVER w, 0) AS i FROM c WINDOW w AS (PARTITION BY rank ORDER BY t)) SELECT rank, t, CAST(u AS DOUBLE) / (u + i) AS cpu_load FROM x", "node_sample"))
def cpu_load(spark, d) -> DataFrame:
    w = Window.partitionBy("rank").orderBy("t")
    u = F.col("used") - F.coalesce(F.lag("used").over(w), F.lit(0))
    i = F.col("idle") - F.coalesce(F.lag("idle").over(w), F.lit(0))
    return counters(fx.node_sample(spark, d)).select("rank", "t", (u / (u + i)).alias("cpu_load"))


def live_samples(samples: DataFrame) -> DataFrame:
    """sample, active_tasks, avg_duration, idle_rate, memory_mb of each rank, as a line is written for every
    sample; samples are numbered from 0. One row a node and hour: a node's series is short."""
    w = Window.partitionBy("rank").orderBy("t")
    return samples.select(
        "rank", (F.row_number().over(w) - 1).alias("sample"), F.col("tasks").alias("active_tasks"), (F.col("used") / F.col("tasks")).alias("avg_duration"),
        (1 - F.col("used") / (F.col("used") + F.col("idle"))).alias("idle_rate"), (F.col("bytes_in") * 1e-6).alias("memory_mb"),
    )


@query("q_live_sample", with_sql("SELECT rank, CAST(row_number() OVER (PARTITION BY rank ORDER BY t) - 1 AS INTEGER) AS sample, tasks AS active_tasks, CAST(used AS DOUBLE) / tasks AS avg_duration, 1 - CAST(used AS DOUBLE) / (used + idle) AS idle_rate, bytes_in * CAST(1e-6 AS DOUBLE) AS memory_mb FROM node_sample", "node_sample"))
def q_live_sample(spark, d) -> DataFrame:
    return live_samples(fx.node_sample(spark, d))


def ring(column: str, slots: int, w) -> Column:
    """The value slots samples ago, or the first there is."""
    return F.coalesce(F.lag(column, slots).over(w), F.first(column).over(w.rowsBetween(Window.unboundedPreceding, 0)))


@query("q_idle_rate", with_sql(f"WITH {_COUNTERS}, x AS (SELECT rank, t, used, coalesce(lag(used, 8) OVER w, first_value(used) OVER w) AS u0, coalesce(lag(t, 8) OVER w, first_value(t) OVER w) AS t0 FROM c WINDOW w AS (PARTITION BY rank ORDER BY t)) SELECT rank, t, CASE WHEN t > t0 THEN 1.0 - CAST(used - u0 AS DOUBLE) / ((t - t0) * 1000) ELSE 0.0 END AS idle_rate FROM x", "node_sample"))
def idle_rate(spark, d) -> DataFrame:
    """Over a ring of eight samples; 1000 units an hour are all CPUs."""
    w = Window.partitionBy("rank").orderBy("t")
    c = counters(fx.node_sample(spark, d)).select("rank", "t", "used", ring("used", 8, w).alias("u0"), ring("t", 8, w).alias("t0"))
    return c.select("rank", "t", F.when(F.col("t") > F.col("t0"), 1.0 - (F.col("used") - F.col("u0")) / ((F.col("t") - F.col("t0")) * 1000)).otherwise(0.0).alias("idle_rate"))


@query("q_throughput", with_sql("SELECT rank, t, tasks / 3600.0 AS per_second FROM node_sample", "node_sample"))
def throughput(spark, d) -> DataFrame:
    return fx.node_sample(spark, d).select("rank", "t", (F.col("tasks") / 3600.0).alias("per_second"))


@query("q_weighted_throughput", with_sql("SELECT rank, t, weight / 3600.0 AS per_second FROM node_sample", "node_sample"))
def weighted_throughput(spark, d) -> DataFrame:
    """A task of depth n weighs 2 ** -n."""
    return fx.node_sample(spark, d).select("rank", "t", (F.col("weight") / 3600.0).alias("per_second"))


@query("q_network", with_sql("SELECT rank, CAST(sum(bytes_in) AS BIGINT) AS bytes_in, CAST(sum(bytes_out) AS BIGINT) AS bytes_out FROM node_sample GROUP BY rank", "node_sample"))
def network(spark, d) -> DataFrame:
    return fx.node_sample(spark, d).groupBy("rank").agg(F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"))


@query("q_heatmap", with_sql("WITH s AS (SELECT rank, row_number() OVER (PARTITION BY rank ORDER BY t) - 1 AS sample, tasks FROM node_sample), n AS (SELECT max(sample) AS last FROM s) SELECT r.rank, CAST(k AS BIGINT) AS sample, coalesce(CAST(tasks AS DOUBLE), 0.0) AS value FROM (SELECT DISTINCT rank FROM s) r CROSS JOIN (SELECT unnest(range(0, (SELECT last + 1 FROM n))) AS k) LEFT JOIN s ON s.rank = r.rank AND s.sample = k", "node_sample"))
def heatmap(spark, d) -> DataFrame:
    """Every rank's samples, padded with 0.0 to the longest series."""
    samples = fx.node_sample(spark, d).select("rank", (F.row_number().over(Window.partitionBy("rank").orderBy("t")) - 1).cast("long").alias("sample"), "tasks")
    last = samples.groupBy("rank").agg(F.max("sample").alias("own"))
    top = last.agg(F.max("own").alias("last"))  # one row
    pads = last.join(F.broadcast(top)).where("own < last").select("rank", F.explode(F.sequence(F.col("own") + 1, F.col("last"))).alias("sample"), F.lit(0.0).alias("value"))
    return samples.select("rank", "sample", F.col("tasks").cast("double").alias("value")).unionByName(pads)


# ---- task times by path --------------------------------------------------------------------------


def time_bins(tasks: DataFrame, level: int = LEVEL) -> DataFrame:
    """bin, us: a task deeper than level counts in its ancestor there, a shallower one spreads evenly.

    tasks: heap, us. Only the fewer than 2 ** level shallow paths are spread.
    """
    h, n = F.col("heap"), heap.depth(F.col("heap"))
    paths = tasks.groupBy("heap").agg(F.sum("us").alias("us"))
    deep = paths.where(n >= level).select((heap.ancestor(h, level) - 2**level).alias("bin"), F.col("us").cast("double").alias("us"))
    width = F.call_function("shiftleft", F.lit(1).cast("long"), (level - n).cast("int"))
    shallow = paths.where(n < level).select(
        F.explode(F.sequence(heap.path(h) * width, heap.path(h) * width + width - 1)).alias("bin"), (F.col("us") / width).alias("us")
    )
    return deep.unionByName(shallow).groupBy("bin").agg(F.sum("us").alias("us"))


def _bins_sql(name: str, where: str = "true") -> str:
    h = "length(bin(heap)) - 1"
    return f"""{name} AS (SELECT bin, sum(us) AS us FROM (
      SELECT CAST(floor(heap / pow(2, {h} - 14)) AS BIGINT) - 16384 AS bin, CAST(end_us - start_us AS DOUBLE) AS us FROM task_profile WHERE {h} >= 14 AND {where}
      UNION ALL SELECT unnest(range(CAST((heap - pow(2, {h})) * pow(2, 14 - ({h})) AS BIGINT), CAST((heap - pow(2, {h}) + 1) * pow(2, 14 - ({h})) AS BIGINT))) AS bin,
        (end_us - start_us) / pow(2, 14 - ({h})) AS us FROM task_profile WHERE {h} < 14 AND {where}) GROUP BY bin)"""


def _timed(profiles: DataFrame) -> DataFrame:
    return profiles.select("heap", (F.col("end_us") - F.col("start_us")).alias("us"), "start_us")


@query("q_task_time_bins", with_sql(f"WITH {_bins_sql('b')} SELECT bin, us FROM b", P))
def task_time_bins(spark, d) -> DataFrame:
    return time_bins(_timed(fx.task_profile(spark, d)))


def path_times(bins: DataFrame, paths: DataFrame, level: int = LEVEL) -> DataFrame:
    """heap, us of paths: the sum of the bins below, or a share of the bin above. At most 2 ** level bins."""
    n = heap.depth(F.col("heap"))
    k = F.explode(F.sequence(F.lit(0), F.lit(level)))
    above = bins.select((F.col("bin") + 2**level).alias("leaf"), "us", k.alias("up")).select(F.expr("shiftright(leaf, up)").alias("heap"), "us").groupBy("heap").agg(F.sum("us").alias("us"))
    wanted = paths.select("heap", F.when(n > level, heap.ancestor(F.col("heap"), level)).otherwise(F.col("heap")).alias("at"), F.greatest(n - level, F.lit(0)).alias("deeper"))
    return wanted.join(above.withColumnRenamed("heap", "at"), "at", "left").select("heap", (F.coalesce("us", F.lit(0.0)) / F.pow(F.lit(2.0), "deeper")).alias("us"))


@query("q_task_time_path", with_sql(f"WITH {_bins_sql('b')}, w AS (SELECT unnest(range(1, 128)) AS heap UNION ALL SELECT unnest(range(40000, 40010)) AS heap) SELECT heap, (SELECT coalesce(sum(us), 0.0) FROM b WHERE CASE WHEN length(bin(heap)) - 1 <= 14 THEN CAST(floor((bin + 16384) / pow(2, 14 - (length(bin(heap)) - 1))) AS BIGINT) = heap ELSE bin + 16384 = CAST(floor(heap / pow(2, length(bin(heap)) - 15)) AS BIGINT) END) / pow(2, greatest(length(bin(heap)) - 15, 0)) AS us FROM w", P))
def task_time_path(spark, d) -> DataFrame:
    paths = spark.range(1, 128).withColumnRenamed("id", "heap").unionByName(spark.range(40000, 40010).withColumnRenamed("id", "heap"))
    return path_times(time_bins(_timed(fx.task_profile(spark, d))), paths)


def time_rates(now: DataFrame, last: DataFrame, interval: float) -> DataFrame:
    """(now - last) / interval of each bin."""
    return now.join(last.withColumnRenamed("us", "before"), "bin", "left").select("bin", ((F.col("us") - F.coalesce("before", F.lit(0.0))) / interval).alias("rate"))


@query("q_task_time_rate", with_sql(f"WITH {_bins_sql('b')}, {_bins_sql('c', 'heap % 3 = 0')} SELECT b.bin, (b.us - coalesce(c.us, 0.0)) / 16.0 AS rate FROM b LEFT JOIN c ON c.bin = b.bin", P))
def task_time_rate(spark, d) -> DataFrame:
    tasks = _timed(fx.task_profile(spark, d))
    return time_rates(time_bins(tasks), time_bins(tasks.where("heap % 3 = 0")), 16.0)


# ---- iterations ----------------------------------------------------------------------------------


def iterations(starts: DataFrame, bin_us: int = 86_400_000_000) -> DataFrame:
    """root, start_us, id and seconds to the root's next start; the last has none.

    A root's starts are ordered inside days, so a root with very many is spread over its days.
    """
    out = with_next(starts, ["root"], "start_us", "id", bin_us)
    return out.select("root", "id", "start_us", ((F.col("next_start_us") - F.col("start_us")) / US).alias("seconds"))


_ITER = f"it AS (SELECT user_id AS root, event_id AS id, epoch_us(ts) AS start_us, (lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - epoch_us(ts)) / {US} AS seconds FROM events)"


def _starts(spark, d) -> DataFrame:
    return fx.table(spark, d, "events").selectExpr("user_id AS root", "event_id AS id", f"{fx.micros('ts')} AS start_us")


@query("q_iteration_times", f"WITH {_ITER} SELECT * FROM it WHERE seconds IS NOT NULL")
def iteration_times(spark, d) -> DataFrame:
    return iterations(_starts(spark, d)).where("seconds IS NOT NULL")


@query("q_avg_last_iters", f"WITH {_ITER}, r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY start_us DESC, id DESC) AS k FROM it WHERE seconds IS NOT NULL) SELECT root, count(*) AS n, round(max(CASE WHEN k = 1 THEN seconds END), 6) AS last, round(avg(seconds), 6) AS mean FROM r WHERE k <= 10 GROUP BY root")
def avg_last_iters(spark, d, n: int = 10) -> DataFrame:
    """The last and the mean of the last n iterations of each root.

    Spark keeps n rows a root in each task before the exchange, as the rank is only compared with n.
    """
    it = iterations(_starts(spark, d)).where("seconds IS NOT NULL")
    k = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("start_us"), F.desc("id")))
    top = it.withColumn("k", k).where(F.col("k") <= n)
    return top.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.when(F.col("k") == 1, F.col("seconds"))), 6).alias("last"), F.round(F.avg("seconds"), 6).alias("mean"))


# ---- tables and trees ----------------------------------------------------------------------------


def profile_table(profiles: DataFrame, edges: DataFrame) -> DataFrame:
    """id, name, exclusive and inclusive seconds with shares of the wall time, children's mean and deviation."""
    wall = profiles.agg((F.max("end_us") - F.min("start_us")).alias("wall_us"))  # one row
    excl = (F.col("end_us") - F.col("start_us")) / US
    t = profiles.join(inclusive(profiles).withColumnRenamed("seconds", "inclusive"), "heap").join(children(profiles, edges), "heap", "left").join(F.broadcast(wall))
    share = lambda c: F.when(F.col("wall_us") > 0, F.round(100 * c / (F.col("wall_us") / US), 6)).otherwise(0.0)
    return t.select(
        F.col("heap").cast("string").alias("id"), "name", excl.alias("exclusive"), share(excl).alias("exclusive_share"), "inclusive", share(F.col("inclusive")).alias("inclusive_share"),
        F.coalesce("child_mean", F.lit(0.0)).alias("child_mean"), F.coalesce("child_sd", F.lit(0.0)).alias("child_sd"),
    ).orderBy("id")


@query(
    "q_profile_table",
    with_sql(
        f"""WITH c AS ({_CHILDREN}), l AS (SELECT parent, max(end_us) AS last FROM task_profile GROUP BY parent), w AS (SELECT max(end_us) - min(start_us) AS wall FROM task_profile),
        t AS (SELECT p.heap, name, (end_us - start_us) / 1000000.0 AS exclusive, CASE WHEN last IS NULL THEN 0.0 ELSE (greatest(end_us, last) - start_us) / 1000000.0 END AS inclusive, child_mean, child_sd
          FROM task_profile p LEFT JOIN l ON l.parent = p.heap LEFT JOIN c ON c.heap = p.heap)
        SELECT CAST(heap AS VARCHAR) AS id, name, exclusive, round(100 * exclusive / (wall / 1000000.0), 6) AS exclusive_share, inclusive, round(100 * inclusive / (wall / 1000000.0), 6) AS inclusive_share,
          coalesce(child_mean, 0.0) AS child_mean, coalesce(child_sd, 0.0) AS child_sd FROM t, w""",
        P, "task_edges",
    ),
)
def q_profile_table(spark, d) -> DataFrame:
    return profile_table(fx.task_profile(spark, d), fx.task_edges(spark, d))


@query("q_gather_profiles", with_sql("WITH u AS (SELECT heap, name, locality FROM task_profile UNION ALL SELECT heap, 'copy' AS name, locality + 3 AS locality FROM task_profile WHERE heap % 4 = 0) SELECT heap, arg_min(name, locality) AS name, min(locality) AS locality FROM u GROUP BY heap", P))
def gather_profiles(spark, d) -> DataFrame:
    """Profiles of several nodes: of one task the one of the lowest locality stays."""
    p = fx.task_profile(spark, d).select("heap", "name", "locality")
    more = p.where("heap % 4 = 0").select("heap", F.lit("copy").alias("name"), (F.col("locality") + 3).alias("locality"))
    return p.unionByName(more).groupBy("heap").agg(F.min_by("name", "locality").alias("name"), F.min("locality").alias("locality"))


@query("q_tree_edges", with_sql("SELECT parent, heap AS child, '  \"' || parent || '\" -> \"' || heap || '\";' AS line FROM task_edges", "task_edges"))
def tree_edges(spark, d) -> DataFrame:
    """The edges, also as lines of a graph file."""
    e = fx.task_edges(spark, d).withColumnRenamed("heap", "child")
    return e.withColumn("line", F.format_string('  "%d" -> "%d";', "parent", "child"))


@query("q_tree_nodes", with_sql("SELECT heap, '  \"' || heap || '\" [ label=\"' || name || '\" ];' AS line FROM task_profile", P))
def tree_nodes(spark, d) -> DataFrame:
    return fx.task_profile(spark, d).select("heap", F.format_string('  "%d" [ label="%s" ];', "heap", "name").alias("line"))


@query("q_tree_reachable", with_sql("WITH RECURSIVE r AS (SELECT CAST(5 AS BIGINT) AS heap UNION ALL SELECT e.heap FROM r JOIN task_edges e ON e.parent = r.heap) SELECT heap FROM r", "task_edges"))
def tree_reachable(spark, d) -> DataFrame:
    """All tasks below task 5 and itself: a prefix test, no recursion."""
    e = fx.task_edges(spark, d).select("heap")
    return e.where(heap.in_subtree(F.col("heap"), F.lit(5).cast("long")))


def colour(share: Column) -> Column:
    """A colour as rrggbb on the way from yellow (0) to red (1) through the hues between, of full saturation
    and value: the hue falls from a sixth to 0, so red stays full and green fades."""
    sixths = (F.lit(1 / 6) + (0 - F.lit(1 / 6)) * share) * 6
    green = F.when(sixths >= 1, 255).otherwise(F.floor(255 * sixths)).cast("int")
    return F.concat(F.lit("ff"), F.lpad(F.lower(F.hex(green)), 2, "0"), F.lit("00"))


@query("q_tree_color", with_sql("WITH m AS (SELECT CAST(sum(end_us - start_us) AS DOUBLE) AS total FROM task_profile), x AS (SELECT heap, (CAST(1.0 / 6.0 AS DOUBLE) + (0 - CAST(1.0 / 6.0 AS DOUBLE)) * ((end_us - start_us) / total)) * 6 AS h FROM task_profile, m) SELECT heap, 'ff' || lpad(printf('%x', CASE WHEN h >= 1 THEN 255 ELSE CAST(floor(255 * h) AS INTEGER) END), 2, '0') || '00' AS colour FROM x", P))
def tree_color(spark, d) -> DataFrame:
    """By each task's share of the time of all."""
    p = fx.task_profile(spark, d)
    us = F.col("end_us") - F.col("start_us")
    return p.join(F.broadcast(p.agg(F.sum(us).alias("total")))).select("heap", colour(us / F.col("total")).alias("colour"))


def match_previous(ids: Column, root: str, previous: str) -> Column:
    """The id of the same task below the root of an earlier iteration."""
    return F.when(ids.startswith(root + ".") | (ids == root), F.concat(F.lit(previous), F.substring(ids, len(root) + 1, 1 << 20))).otherwise(F.lit(None))


_PATHS = "SELECT heap, '1.5' || regexp_replace(substr(bin(heap), 2), '(.)', '.\\1', 'g') AS id FROM task_profile"


@query("q_match_previous", with_sql(f"SELECT id, '1.4' || substr(id, 4) AS previous FROM ({_PATHS})", P))
def q_match_previous(spark, d) -> DataFrame:
    ids = fx.task_profile(spark, d).select(F.concat(F.lit("1.5"), heap.text(F.col("heap"))).alias("id"))
    return ids.select("id", match_previous(F.col("id"), "1.5", "1.4").alias("previous"))


def counter_deltas(start: Column, stop: Column) -> Column:
    """stop - start of every hardware counter."""
    return F.zip_with(start, stop, lambda a, b: b - a)


@query("q_papi", with_sql("SELECT heap, [(heap + 5) * 3 - heap, CAST(0 AS BIGINT), heap % 7 + 11] AS counters FROM task_profile", P))
def papi(spark, d) -> DataFrame:
    h = F.col("heap")
    start, stop = F.array(h, h * 2, F.lit(0).cast("long")), F.array((h + 5) * 3, h * 2, h % 7 + 11)
    return fx.task_profile(spark, d).select("heap", counter_deltas(start, stop).alias("counters"))
