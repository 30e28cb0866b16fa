"""The benchmark table, run plans and reports over log text; configuration text."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import query
from ..sources import text

# The table's columns and their order.
BENCH = T.StructType(
    [
        T.StructField("app_name", T.StringType()), T.StructField("app_args", T.StringType()), T.StructField("time", T.DoubleType()), T.StructField("energy", T.LongType()),
        T.StructField("power", T.LongType()), T.StructField("initial_threads", T.IntegerType()), T.StructField("min_threads", T.IntegerType()), T.StructField("max_threads", T.IntegerType()),
        T.StructField("mean_threads", T.DoubleType()), T.StructField("mode_threads", T.DoubleType()), T.StructField("stdev_threads", T.DoubleType()), T.StructField("resource", T.DoubleType()),
        T.StructField("hpx_queuing", T.StringType()), T.StructField("objective", T.StringType()), T.StructField("date", T.StringType()),
    ]
)


def _rows() -> list[tuple]:
    """A small table of runs: two applications, three objectives, five thread counts."""
    out = []
    for k, (app, objective, threads) in enumerate(product(("grain", "stencil"), ("time", "resource", "none"), (1, 2, 4, 8, 16))):
        known = k % 3 != 0
        out.append((app, "4 200", 100.0 / threads + k, 1000 * k, 10 * k, threads, threads - 1 if known else None, threads if known else None,
                    threads - 0.5 if known else None, float(threads) if known else None, 0.25 if known else None, 0.0 if k % 2 else 50.0 + k, "static", objective, f"2018-01-{k + 1:02d}"))
    return out


def _sql_value(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else f"CAST({v} AS BIGINT)"


_VALUES = "bench AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_sql_value, r)) + ")" for r in _rows()) + ") AS t(" + ", ".join(f.name for f in BENCH) + "))"


def bench(spark) -> DataFrame:
    return spark.createDataFrame(_rows(), BENCH)


def with_defaults(runs: DataFrame) -> DataFrame:
    """Thread statistics that are missing are those of a run with a constant number."""
    n = F.col("initial_threads")
    kinds = {"min_threads": "int", "max_threads": "int", "mean_threads": "double", "mode_threads": "double"}
    return runs.withColumns({c: F.coalesce(F.col(c), n.cast(k)) for c, k in kinds.items()} | {"stdev_threads": F.coalesce("stdev_threads", F.lit(0.0))})


@query("q_bench_defaults", f"WITH {_VALUES} SELECT app_name, objective, CAST(initial_threads AS INTEGER) AS initial_threads, CAST(coalesce(min_threads, initial_threads) AS INTEGER) AS min_threads, CAST(coalesce(max_threads, initial_threads) AS INTEGER) AS max_threads, coalesce(mean_threads, initial_threads) AS mean_threads, coalesce(mode_threads, initial_threads) AS mode_threads, coalesce(stdev_threads, 0) AS stdev_threads FROM bench")
def bench_defaults(spark, d) -> DataFrame:
    return with_defaults(bench(spark)).select("app_name", "objective", "initial_threads", "min_threads", "max_threads", "mean_threads", "mode_threads", "stdev_threads")


def select_runs(runs: DataFrame, app: str, args: str, objective: str, threads: list[int]) -> DataFrame:
    columns = ["app_name", "app_args", "initial_threads", "time", "min_threads", "mean_threads", "stdev_threads", "energy", "resource", "objective"]
    wanted = (F.col("app_name") == app) & (F.col("app_args") == args) & (F.col("objective") == objective) & F.col("initial_threads").isin(threads)
    return runs.where(wanted).select(*columns).orderBy("initial_threads")


@query("q_bench_select", f"WITH {_VALUES} SELECT app_name, app_args, CAST(initial_threads AS INTEGER) AS initial_threads, time, CAST(min_threads AS INTEGER) AS min_threads, mean_threads, stdev_threads, energy, resource, objective FROM bench WHERE app_name = 'grain' AND app_args = '4 200' AND objective = 'time' AND initial_threads IN (1, 4, 16)")
def bench_select(spark, d) -> DataFrame:
    return select_runs(bench(spark), "grain", "4 200", "time", [1, 4, 16])


def plot_series(runs: DataFrame, app: str, args: str, threads: list[int], objectives: list[str], value: str) -> DataFrame:
    """objective, threads, value: a line of a plot for each objective; with time and resource also the least
    number of threads and the deviation, rounded to two places, that are written beside the points."""
    lines = None
    for objective in objectives:  # a short list of a configuration
        own = select_runs(runs, app, args, objective, threads)
        beside = objective in ("time", "resource")
        line = own.select(
            "objective", F.col("initial_threads").alias("threads"), F.col(value).cast("double").alias("value"),
            (F.col("min_threads") if beside else F.lit(None).cast("int")).alias("least"), (F.round("stdev_threads", 2) if beside else F.lit(None).cast("double")).alias("deviation"),
        )
        lines = line if lines is None else lines.unionByName(line)
    return lines


@query("q_plot_series", f"WITH {_VALUES} SELECT objective, CAST(initial_threads AS INTEGER) AS threads, CAST(resource AS DOUBLE) AS value, CASE WHEN objective <> 'none' THEN CAST(min_threads AS INTEGER) END AS least, CASE WHEN objective <> 'none' THEN round(stdev_threads, 2) END AS deviation FROM bench WHERE app_name = 'stencil' AND app_args = '4 200' AND objective IN ('time', 'resource', 'none') AND initial_threads IN (1, 2, 8)")
def q_plot_series(spark, d) -> DataFrame:
    return plot_series(bench(spark), "stencil", "4 200", [1, 2, 8], ["time", "resource", "none"], "resource")


def plan_runs(spark, **choices: list) -> DataFrame:
    """Every combination of the given choices: short lists of a configuration, exploded in turn."""
    out = spark.range(1).drop("id")
    for name, values in choices.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out


@query("q_bench_plan", "SELECT app, args, threads, objective FROM (VALUES ('grain'), ('stencil')) AS a(app), (VALUES ('1'), ('2')) AS b(args), (VALUES (1), (8), (64)) AS c(threads), (VALUES ('time'), ('none')) AS e(objective)")
def bench_plan(spark, d) -> DataFrame:
    return plan_runs(spark, app=["grain", "stencil"], args=["1", "2"], threads=[1, 8, 64], objective=["time", "none"])


# ---- logs ----------------------------------------------------------------------------------------


def run_logs(spark) -> DataFrame:
    """run, pos, line of 40 short logs."""
    k = F.col("id")
    lines = [F.concat(F.lit("Active threads: "), ((k * j) % 7 + 1).cast("string")) for j in range(1, 8)]
    lines += [F.lit("noise without numbers"), F.when(k % 3 == 0, F.concat(F.lit("Resource usage: "), (k * 1.5).cast("string"))).otherwise("done")]
    return spark.range(40).select(k.alias("run"), F.posexplode(F.array(*lines)).alias("pos", "line"))


_LOGS = "logs AS (SELECT k AS run, CAST(j - 1 AS INTEGER) AS pos, 'Active threads: ' || CAST((k * j) % 7 + 1 AS VARCHAR) AS line FROM (SELECT unnest(range(0, 40)) AS k), (SELECT unnest(range(1, 8)) AS j) UNION ALL SELECT k, 7, 'noise without numbers' FROM (SELECT unnest(range(0, 40)) AS k) UNION ALL SELECT k, 8, CASE WHEN k % 3 = 0 THEN 'Resource usage: ' || CAST(k * 1.5 AS VARCHAR) ELSE 'done' END FROM (SELECT unnest(range(0, 40)) AS k))"


def parse_log(lines: DataFrame) -> DataFrame:
    """run, pos, threads, resource of the lines that tell either."""
    threads = F.regexp_extract("line", r"Active threads:\s*(\d+)", 1)
    resource = F.regexp_extract("line", r"Resource[^:]*:\s*([0-9.]+)", 1)
    out = lines.select("run", "pos", F.nullif(threads, F.lit("")).cast("int").alias("threads"), F.nullif(resource, F.lit("")).cast("double").alias("resource"))
    return out.where("threads IS NOT NULL OR resource IS NOT NULL")


_PARSED = f"{_LOGS}, parsed AS (SELECT run, pos, CAST(nullif(regexp_extract(line, 'Active threads:\\s*(\\d+)', 1), '') AS INTEGER) AS threads, CAST(nullif(regexp_extract(line, 'Resource[^:]*:\\s*([0-9.]+)', 1), '') AS DOUBLE) AS resource FROM logs)"


@query("q_log_parse", f"WITH {_PARSED} SELECT * FROM parsed WHERE threads IS NOT NULL OR resource IS NOT NULL")
def log_parse(spark, d) -> DataFrame:
    return parse_log(run_logs(spark))


@query("q_thread_stats", f"WITH {_PARSED}, c AS (SELECT run, threads, count(*) AS n FROM parsed WHERE threads IS NOT NULL GROUP BY run, threads) SELECT p.run, min(p.threads) AS least, max(p.threads) AS largest, round(avg(p.threads), 6) AS mean, (SELECT c.threads FROM c WHERE c.run = p.run ORDER BY n DESC, c.threads LIMIT 1) AS mode, round(coalesce(stddev_samp(p.threads), 0), 6) AS sd FROM parsed p WHERE p.threads IS NOT NULL GROUP BY p.run")
def thread_stats(spark, d) -> DataFrame:
    """Of each run; the smallest of several modes."""
    p = parse_log(run_logs(spark)).where("threads IS NOT NULL")
    counts = p.groupBy("run", "threads").agg(F.count(F.lit(1)).alias("n"))
    mode = counts.groupBy("run").agg(F.max_by("threads", F.struct("n", -F.col("threads"))).alias("mode"))
    stats = p.groupBy("run").agg(F.min("threads").alias("least"), F.max("threads").alias("largest"), F.round(F.avg("threads"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("threads"), F.lit(0.0)), 6).alias("sd"))
    return stats.join(mode, "run").select("run", "least", "largest", "mean", "mode", "sd")


def resource(reported: Column, time: Column, threads: Column) -> Column:
    return F.when(F.coalesce(reported, F.lit(0.0)) == 0, time * threads).otherwise(reported)


@query("q_resource", f"WITH {_VALUES} SELECT app_name, objective, CAST(initial_threads AS INTEGER) AS initial_threads, CASE WHEN resource = 0 THEN time * initial_threads ELSE resource END AS used FROM bench")
def q_resource(spark, d) -> DataFrame:
    return bench(spark).select("app_name", "objective", "initial_threads", resource(F.col("resource"), F.col("time"), F.col("initial_threads")).alias("used"))


@query("q_energy_delta", f"WITH {_VALUES} SELECT app_name, objective, CAST(initial_threads AS INTEGER) AS initial_threads, energy + power * 3 - energy AS joules FROM bench")
def energy_delta(spark, d) -> DataFrame:
    """The counter after less the counter before."""
    before, after = F.col("energy"), F.col("energy") + F.col("power") * 3
    return bench(spark).select("app_name", "objective", "initial_threads", (after - before).alias("joules"))


# ---- data item logs ------------------------------------------------------------------------------

_ITEM_LINES = [
    "create(grid), main(0), D-0.1: [[0,0]] - [[10,20]]",
    "create(grid), main(1), D-0.1: [[10,0]] - [[20,20]]",
    "require(ro), loop(0), D-0.1: [[0,0]] - [[5,20]] [[5,0]] - [[10,20]]",
    "require(rw), loop(0.0), D-0.1: [[0,0]] - [[5,20]]",
    "require(rw), loop(0.1), D-0.2: [[5,0]] - [[10,20]]",
    "require(ro), loop(1), D-0.1: [[10,0]] - [[20,20]]",
    "require(ro), sum(0.1.0), D-0.2: [[7,0]] - [[8,20]]",
    "# nothing to see",
]


def item_log(spark) -> DataFrame:
    return spark.createDataFrame([(i, x) for i, x in enumerate(_ITEM_LINES)], "no long, line string")


_ITEM_SQL = (
    "il AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{x}')" for i, x in enumerate(_ITEM_LINES)) + ") AS t(no, line)), "
    r"ip AS (SELECT no, regexp_extract(line, '^(\w+)\(([^)]*)\), (\w+)\(([^)]*)\), ([^:]+): ', 1) AS action, regexp_extract(line, '^(\w+)\(([^)]*)\), (\w+)\(([^)]*)\), ([^:]+): ', 2) AS mode, regexp_extract(line, '^(\w+)\(([^)]*)\), (\w+)\(([^)]*)\), ([^:]+): ', 3) AS name, regexp_extract(line, '^(\w+)\(([^)]*)\), (\w+)\(([^)]*)\), ([^:]+): ', 4) AS id, regexp_extract(line, '^(\w+)\(([^)]*)\), (\w+)\(([^)]*)\), ([^:]+): ', 5) AS ref, regexp_extract_all(line, '\[\[([0-9,]+)\]\]', 1) AS points FROM il WHERE line LIKE '%(%'), "
    "ib AS (SELECT no, action, mode, name, id, ref, CAST(k AS INTEGER) AS box, points[2 * k + 1] AS lo, points[2 * k + 2] AS hi FROM (SELECT *, unnest(range(0, CAST(len(points) / 2 AS BIGINT))) AS k FROM ip))"
)


@query("q_dilog_parse", f"WITH {_ITEM_SQL} SELECT * FROM ib")
def dilog_parse(spark, d) -> DataFrame:
    return text.item_boxes(item_log(spark))


@query("q_dilog_fragments", f"WITH {_ITEM_SQL} SELECT ref, id AS location, string_agg(lo || '-' || hi, ' ' ORDER BY no, box) AS boxes FROM ib WHERE action = 'create' GROUP BY ref, id")
def dilog_fragments(spark, d) -> DataFrame:
    """The boxes created of each item at each location, in order."""
    return _listed(text.item_boxes(item_log(spark)).where("action = 'create'"), "ref", F.col("id").alias("location"))


@query("q_dilog_requires", f"WITH {_ITEM_SQL} SELECT name, id AS level, ref, mode, string_agg(lo || '-' || hi, ' ' ORDER BY no, box) AS boxes FROM ib WHERE action = 'require' GROUP BY name, id, ref, mode")
def dilog_requires(spark, d) -> DataFrame:
    return _listed(text.item_boxes(item_log(spark)).where("action = 'require'"), "name", F.col("id").alias("level"), "ref", "mode")


def _listed(boxes: DataFrame, *keys) -> DataFrame:
    listed = boxes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("no", "box", F.concat_ws("-", "lo", "hi").alias("text")))).alias("own"))
    return listed.withColumn("boxes", F.concat_ws(" ", F.col("own.text"))).drop("own")


@query("q_dilog_iterations", f"WITH {_ITEM_SQL}, l AS (SELECT name, id, min(no) AS no FROM ib WHERE action = 'require' GROUP BY name, id), f AS (SELECT name, arg_min(len(string_split(id, '.')), no) AS depth FROM l GROUP BY name) SELECT l.name, count(*) AS iterations FROM l JOIN f ON f.name = l.name AND len(string_split(id, '.')) = depth GROUP BY l.name")
def dilog_iterations(spark, d) -> DataFrame:
    """Levels of a work item as deep as its first."""
    levels = text.item_boxes(item_log(spark)).where("action = 'require'").groupBy("name", "id").agg(F.min("no").alias("no"))
    deep = levels.withColumn("depth", F.size(F.split("id", r"\.")))
    first = deep.groupBy("name").agg(F.min_by("depth", "no").alias("depth"))
    return deep.join(first, ["name", "depth"]).groupBy("name").agg(F.count(F.lit(1)).alias("iterations"))


# ---- configuration text --------------------------------------------------------------------------

_CONFIG = ["# tracer", "number of particles = 1000", "time steps=150", "grid size = 64 ", "no assignment here", "planet radius = 0.25"]


@query("q_config_parse", "SELECT * FROM (VALUES ('grid size', '64'), ('number of particles', '1000'), ('planet radius', '0.25'), ('time steps', '150')) AS t(key, value)")
def config_parse(spark, d) -> DataFrame:
    return text.key_values(spark.createDataFrame([(x,) for x in _CONFIG], "value string"))


@query("q_config_columns", "SELECT * FROM (VALUES ('threads', '8'), ('zone_x', '10'), ('zone_y', '20')) AS t(key, value)")
def config_columns(spark, d) -> DataFrame:
    lines = ["# sizes", "threads   8", "zone_x 10  # cells", "", "zone_y\t20"]
    return text.spaced_pairs(spark.createDataFrame([(x,) for x in lines], "value string"))
