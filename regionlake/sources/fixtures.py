"""Inputs of the registered queries, derived from the star schema and the event stream; each also as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> str:
    """Microseconds of a timestamp without time zone, whatever the session's zone is."""
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})"


SQL: dict[str, str] = {}


def with_sql(body: str, *names: str) -> str:
    """body behind the CTEs of the named fixtures."""
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def task_profile(spark: SparkSession, d: str) -> DataFrame:
    """heap, parent, name, locality, start_us, end_us: nine of ten events as finished tasks."""
    return table(spark, d, "events").where("event_id % 10 <> 7").selectExpr(
        "event_id + 1 AS heap", "shiftright(event_id + 1, 1) AS parent", "event_type AS name", "CAST(user_id % 8 AS INT) AS locality",
        f"{micros('ts')} AS start_us", f"{micros('ts')} + CAST(round(value * 1000000) AS BIGINT) AS end_us",
    )


SQL["task_profile"] = """SELECT event_id + 1 AS heap, CAST(floor((event_id + 1) / 2) AS BIGINT) AS parent, event_type AS name,
  CAST(user_id % 8 AS INTEGER) AS locality, epoch_us(ts) AS start_us, epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) AS end_us
  FROM events WHERE event_id % 10 <> 7"""


def task_edges(spark: SparkSession, d: str) -> DataFrame:
    """parent, heap of all tasks, profiled or not."""
    return table(spark, d, "events").where("event_id > 0").selectExpr("shiftright(event_id + 1, 1) AS parent", "event_id + 1 AS heap")


SQL["task_edges"] = "SELECT CAST(floor((event_id + 1) / 2) AS BIGINT) AS parent, event_id + 1 AS heap FROM events WHERE event_id > 0"


def grid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("CAST(floor(event_id / 100) AS BIGINT) AS x", "event_id % 100 AS y", "value AS v")


SQL["grid"] = "SELECT CAST(floor(event_id / 100) AS BIGINT) AS x, event_id % 100 AS y, value AS v FROM events"


def vector(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("event_id AS i", "value AS a", "CAST(user_id AS DOUBLE) AS b", "CAST(event_id % 100 AS DOUBLE) AS c")


SQL["vector"] = "SELECT event_id AS i, value AS a, CAST(user_id AS DOUBLE) AS b, CAST(event_id % 100 AS DOUBLE) AS c FROM events"


def region_a(spark: SparkSession, d: str) -> DataFrame:
    """item, lo, hi: half-open boxes."""
    return table(spark, d, "lineitem").where("l_quantity <= 3").selectExpr("l_returnflag AS item", "l_orderkey AS lo", "l_orderkey + CAST(l_quantity AS BIGINT) AS hi")


SQL["region_a"] = "SELECT l_returnflag AS item, l_orderkey AS lo, l_orderkey + CAST(l_quantity AS BIGINT) AS hi FROM lineitem WHERE l_quantity <= 3"


def region_b(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderkey % 5 = 0").selectExpr(
        "CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS item", "o_orderkey AS lo", "o_orderkey + 1 + o_custkey % 7 AS hi"
    )


SQL["region_b"] = """SELECT CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'N' ELSE 'R' END AS item, o_orderkey AS lo,
  o_orderkey + 1 + o_custkey % 7 AS hi FROM orders WHERE o_orderkey % 5 = 0"""


def requirement(spark: SparkSession, d: str) -> DataFrame:
    """task, item, lo, hi, mode."""
    return table(spark, d, "lineitem").where("l_quantity <= 3").selectExpr(
        "l_orderkey AS task", "l_returnflag AS item", "l_orderkey AS lo", "l_orderkey + CAST(l_quantity AS BIGINT) AS hi",
        "CASE WHEN l_linestatus = 'O' THEN 'ReadWrite' ELSE 'ReadOnly' END AS mode",
    )


SQL["requirement"] = """SELECT l_orderkey AS task, l_returnflag AS item, l_orderkey AS lo, l_orderkey + CAST(l_quantity AS BIGINT) AS hi,
  CASE WHEN l_linestatus = 'O' THEN 'ReadWrite' ELSE 'ReadOnly' END AS mode FROM lineitem WHERE l_quantity <= 3"""


def location(spark: SparkSession, d: str) -> DataFrame:
    """item, rank, lo, hi: who owns which part; some parts have no owner."""
    items = F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R")))
    return table(spark, d, "supplier").where("s_suppkey % 7 <> 5").select(
        items.alias("item"), F.expr("CAST(s_suppkey % 4 AS INT)").alias("rank"), F.expr("s_suppkey * 150").alias("lo"), F.expr("s_suppkey * 150 + 150").alias("hi")
    )


SQL["location"] = """SELECT item, CAST(s_suppkey % 4 AS INTEGER) AS rank, s_suppkey * 150 AS lo, s_suppkey * 150 + 150 AS hi
  FROM supplier CROSS JOIN (VALUES ('A'), ('N'), ('R')) AS i(item) WHERE s_suppkey % 7 <> 5"""


def node_sample(spark: SparkSession, d: str) -> DataFrame:
    """rank, t (hour), tasks, weight, used, idle, bytes_in, bytes_out: sums of one node in one hour."""
    e = table(spark, d, "events").selectExpr("CAST(user_id % 8 AS INT) AS rank", f"CAST(floor({micros('ts')} / 3600000000) AS BIGINT) AS t", "event_id", "CAST(round(value) AS BIGINT) AS w")
    return e.groupBy("rank", "t").agg(
        F.count(F.lit(1)).alias("tasks"),
        F.sum(F.expr("pow(2.0, 1 - length(bin(event_id + 1)))")).alias("weight"),
        F.sum("w").alias("used"),
        F.sum(F.lit(250)).alias("idle"),
        F.sum(F.expr("event_id % 1000")).alias("bytes_in"),
        F.sum(F.expr("event_id % 777")).alias("bytes_out"),
    )


SQL["node_sample"] = """SELECT CAST(user_id % 8 AS INTEGER) AS rank, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS t, count(*) AS tasks,
  sum(pow(2.0, 1 - length(bin(event_id + 1)))) AS weight, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS used,
  CAST(sum(250) AS BIGINT) AS idle, CAST(sum(event_id % 1000) AS BIGINT) AS bytes_in, CAST(sum(event_id % 777) AS BIGINT) AS bytes_out
  FROM events GROUP BY 1, 2"""


def node_state(spark: SparkSession, d: str) -> DataFrame:
    """A row for each supplier as a node: rank, online, active, cores, frequencies, load."""
    return table(spark, d, "supplier").selectExpr(
        "s_suppkey AS rank", "s_suppkey % 11 <> 3 AS online", "s_suppkey % 5 <> 2 AS active", "CAST(4 + s_suppkey % 4 * 4 AS INT) AS num_cores",
        "CAST(2 + s_suppkey % 7 AS INT) AS active_cores", "2400.0D AS max_frequency", "CAST(1200 + s_suppkey % 6 * 200 AS DOUBLE) AS cur_frequency",
        "CAST(s_suppkey % 10 AS DOUBLE) / 10 AS cpu_load", "CAST(s_suppkey % 13 AS DOUBLE) AS cur_power", "20.0D AS max_power", "CAST(s_suppkey * 37 % 101 AS BIGINT) AS load",
    )


SQL["node_state"] = """SELECT s_suppkey AS rank, s_suppkey % 11 <> 3 AS online, s_suppkey % 5 <> 2 AS active, CAST(4 + s_suppkey % 4 * 4 AS INTEGER) AS num_cores,
  CAST(2 + s_suppkey % 7 AS INTEGER) AS active_cores, CAST(2400 AS DOUBLE) AS max_frequency, CAST(1200 + s_suppkey % 6 * 200 AS DOUBLE) AS cur_frequency,
  CAST(s_suppkey % 10 AS DOUBLE) / 10 AS cpu_load, CAST(s_suppkey % 13 AS DOUBLE) AS cur_power, CAST(20 AS DOUBLE) AS max_power,
  CAST(s_suppkey * 37 % 101 AS BIGINT) AS load FROM supplier"""


def node_load(spark: SparkSession, d: str) -> DataFrame:
    """node, load in hundredths."""
    return table(spark, d, "events").selectExpr("CAST(user_id % 4 AS INT) AS node", "CAST(round(value * 100) AS BIGINT) AS w").groupBy("node").agg(F.sum("w").alias("load"))


SQL["node_load"] = "SELECT CAST(user_id % 4 AS INTEGER) AS node, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS load FROM events GROUP BY 1"


def matrix(spark: SparkSession, d: str, second: bool = False) -> DataFrame:
    """i, k, v: a sparse matrix of integers, unique in (i, k)."""
    i, k, v = ("p_size", "p_partkey % 32", "p_partkey % 7") if second else ("p_partkey % 32", "p_size", "p_partkey % 10")
    return table(spark, d, "part").groupBy(F.expr(f"CAST({i} AS INT)").alias("i"), F.expr(f"CAST({k} AS INT)").alias("k")).agg(F.sum(F.expr(f"CAST({v} AS BIGINT)")).alias("v"))


SQL["matrix_a"] = "SELECT CAST(p_partkey % 32 AS INTEGER) AS i, CAST(p_size AS INTEGER) AS k, CAST(sum(p_partkey % 10) AS BIGINT) AS v FROM part GROUP BY 1, 2"
SQL["matrix_b"] = "SELECT CAST(p_size AS INTEGER) AS i, CAST(p_partkey % 32 AS INTEGER) AS k, CAST(sum(p_partkey % 7) AS BIGINT) AS v FROM part GROUP BY 1, 2"
