"""Region algebra: sets of half-open boxes of an item's index space, in canonical form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import heap
from ..plans import intervals
from ..plans.settle import settle
from ..registry import query
from ..sources import fixtures as fx
from ..sources.fixtures import with_sql

ITEM = ["item"]

# Coordinates of a set, and a set of coordinates as boxes: the oracles' way, unlike ours.
_COORDS = "ca AS (SELECT DISTINCT item, unnest(range(lo, hi)) AS c FROM region_a), cb AS (SELECT DISTINCT item, unnest(range(lo, hi)) AS c FROM region_b)"
_BOXES = "SELECT item, min(c) AS lo, max(c) + 1 AS hi FROM (SELECT item, c, c - row_number() OVER (PARTITION BY item ORDER BY c) AS g FROM s) GROUP BY item, g"


@query("q_region_merge", with_sql(f"WITH {_COORDS}, s AS (SELECT item, c FROM ca UNION SELECT item, c FROM cb) {_BOXES}", "region_a", "region_b"))
def region_merge(spark, d) -> DataFrame:
    return intervals.union(fx.region_a(spark, d), fx.region_b(spark, d), ITEM)


@query("q_region_intersect", with_sql(f"WITH {_COORDS}, s AS (SELECT item, c FROM ca INTERSECT SELECT item, c FROM cb) {_BOXES}", "region_a", "region_b"))
def region_intersect(spark, d) -> DataFrame:
    return intervals.intersect(fx.region_a(spark, d), fx.region_b(spark, d), ITEM)


@query("q_region_difference", with_sql(f"WITH {_COORDS}, s AS (SELECT item, c FROM ca EXCEPT SELECT item, c FROM cb) {_BOXES}", "region_a", "region_b"))
def region_difference(spark, d) -> DataFrame:
    return intervals.difference(fx.region_a(spark, d), fx.region_b(spark, d), ITEM)


def emptiness(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Each key and whether its region has no element."""
    return regions.groupBy(*keys).agg((F.sum(F.greatest(F.col("hi") - F.col("lo"), F.lit(0))) == 0).alias("empty"))


@query("q_region_empty", with_sql("SELECT item, sum(CASE WHEN hi - 1 > lo THEN hi - 1 - lo ELSE 0 END) = 0 AS empty FROM region_a GROUP BY item", "region_a"))
def region_empty(spark, d) -> DataFrame:
    """Of boxes shrunk by one."""
    return emptiness(fx.region_a(spark, d).withColumn("hi", F.col("hi") - 1), ITEM)


def is_subregion(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Per key of a: whether b covers all of it."""
    pieces = intervals.segments({"a": a, "b": b}, keys).where("a")
    return pieces.groupBy(*keys).agg(F.bool_and("b").alias("contained"))


@query(
    "q_region_subregion",
    with_sql(
        f"""WITH {_COORDS}, i AS (SELECT item, c FROM ca INTERSECT SELECT item, c FROM cb),
        x AS (SELECT 'a' AS what, item, count(*) = (SELECT count(*) FROM i WHERE i.item = ca.item) AS contained FROM ca GROUP BY item),
        y AS (SELECT DISTINCT 'intersection' AS what, item, true AS contained FROM i) SELECT * FROM x UNION ALL SELECT * FROM y""",
        "region_a", "region_b",
    ),
)
def region_subregion(spark, d) -> DataFrame:
    a, b = fx.region_a(spark, d), fx.region_b(spark, d)
    both = settle(intervals.intersect(a, b, ITEM))
    return is_subregion(a, b, ITEM).select(F.lit("a").alias("what"), "item", "contained").unionByName(is_subregion(both, b, ITEM).select(F.lit("intersection").alias("what"), "item", "contained"))


def scan(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Every coordinate once."""
    return intervals.merge(regions, keys).select(*keys, F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("c"))


@query("q_region_scan", with_sql("SELECT DISTINCT item, unnest(range(lo, hi)) AS c FROM region_a", "region_a"))
def region_scan(spark, d) -> DataFrame:
    return scan(fx.region_a(spark, d), ITEM)


def halo(boxes: DataFrame, radius: int, dims: dict[str, tuple[int, int]]) -> DataFrame:
    """lo_<dim>, hi_<dim> grown by radius on every side and clipped to the dimension's bounds."""
    out = boxes
    for dim, (lo, hi) in dims.items():
        out = out.withColumn(f"lo_{dim}", F.greatest(F.col(f"lo_{dim}") - radius, F.lit(lo).cast("long"))).withColumn(f"hi_{dim}", F.least(F.col(f"hi_{dim}") + radius, F.lit(hi).cast("long")))
    return out


_TILES = "SELECT DISTINCT CAST(floor(event_id / 100) AS BIGINT) AS tile, CAST(floor(event_id / 100) AS BIGINT) % 10 * 10 AS lo_x, CAST(floor(event_id / 100) AS BIGINT) % 10 * 10 + 10 AS hi_x, CAST(floor(event_id / 1000) AS BIGINT) % 10 * 10 AS lo_y, CAST(floor(event_id / 1000) AS BIGINT) % 10 * 10 + 10 AS hi_y FROM events"


@query("q_region_halo", f"SELECT tile, greatest(lo_x - 2, 0) AS lo_x, least(hi_x + 2, 100) AS hi_x, greatest(lo_y - 2, 0) AS lo_y, least(hi_y + 2, 100) AS hi_y FROM ({_TILES})")
def region_halo(spark, d) -> DataFrame:
    """Of every tile of events, whichever of its events are there."""
    t = F.floor(F.col("event_id") / 100).cast("long")
    u = F.floor(F.col("event_id") / 1000).cast("long")
    tiles = fx.table(spark, d, "events").select(
        t.alias("tile"), (t % 10 * 10).alias("lo_x"), (t % 10 * 10 + 10).alias("hi_x"), (u % 10 * 10).alias("lo_y"), (u % 10 * 10 + 10).alias("hi_y")
    ).distinct()
    return halo(tiles, 2, {"x": (0, 100), "y": (0, 100)})


@query("q_tree_subtree", with_sql("SELECT heap, CAST(floor(heap / pow(2, length(bin(heap)) - 1 - 3)) AS BIGINT) AS root FROM task_profile WHERE length(bin(heap)) - 1 >= 3 AND CAST(floor(heap / pow(2, length(bin(heap)) - 1 - 3)) AS BIGINT) IN (8, 13)", "task_profile"))
def tree_subtree(spark, d) -> DataFrame:
    """Tasks below two nodes of depth 3."""
    h = F.col("heap")
    return fx.task_profile(spark, d).where(heap.depth(h) >= 3).select("heap", heap.ancestor(h, 3).alias("root")).where(F.col("root").isin(8, 13))


def range_ops(ranges: DataFrame, by: int, limit: int) -> DataFrame:
    """Of lo, hi: empty, size, grown (within 0 and limit), shrunk, and whether the range covers its middle."""
    lo, hi = F.col("lo"), F.col("hi")
    grown_lo, grown_hi = F.greatest(lo - by, F.lit(0).cast("long")), F.least(hi + by, F.lit(limit).cast("long"))
    return ranges.select(
        *[c for c in ranges.columns if c not in ("lo", "hi")], "lo", "hi",
        (lo >= hi).alias("empty"), F.greatest(hi - lo, F.lit(0).cast("long")).alias("size"),
        grown_lo.alias("grown_lo"), grown_hi.alias("grown_hi"), (lo + by).alias("shrunk_lo"), (hi - by).alias("shrunk_hi"),
        ((lo + by < hi - by) & (lo <= lo + by) & (hi - by <= hi)).alias("covers_shrunk"),
    )


@query("q_range_ops", with_sql("SELECT item, lo, hi, lo >= hi AS empty, greatest(hi - lo, 0) AS size, greatest(lo - 1, 0) AS grown_lo, least(hi + 1, 10000) AS grown_hi, lo + 1 AS shrunk_lo, hi - 1 AS shrunk_hi, lo + 1 < hi - 1 AS covers_shrunk FROM region_b", "region_b"))
def q_range_ops(spark, d) -> DataFrame:
    return range_ops(fx.region_b(spark, d), 1, 10000)


def bisect(ranges: DataFrame) -> DataFrame:
    mid = F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2).cast("long")
    return ranges.select("*", mid.alias("mid"))


@query("q_range_split", with_sql("SELECT item, lo, hi, lo + CAST(floor((hi - lo) / 2) AS BIGINT) AS mid FROM region_b", "region_b"))
def range_split(spark, d) -> DataFrame:
    return bisect(fx.region_b(spark, d))


@query(
    "q_requirement_merge",
    with_sql(
        """WITH s AS (SELECT DISTINCT task, item, mode, unnest(range(lo, hi)) AS c FROM requirement)
        SELECT task, item, mode, min(c) AS lo, max(c) + 1 AS hi FROM
        (SELECT *, c - row_number() OVER (PARTITION BY task, item, mode ORDER BY c) AS g FROM s) GROUP BY task, item, mode, g""",
        "requirement",
    ),
)
def requirement_merge(spark, d) -> DataFrame:
    """Requirements of one task on one item in one mode are fused."""
    return intervals.merge(fx.requirement(spark, d), ["task", "item", "mode"])


def neighbour_blocks(n: int, block: int, blocks: DataFrame) -> DataFrame:
    """For block numbers of [0, n) cut into blocks: the block and what it waits for, left and right."""
    k = F.col("block")
    last = (n - 1) // block
    bounds = lambda b: (b * block, F.least((b + 1) * block, F.lit(n).cast("long")))
    lo, hi = bounds(k)
    return blocks.where((k >= 0) & (k <= last)).select(
        "block", lo.alias("lo"), hi.alias("hi"), F.when(k > 0, k - 1).alias("left"), F.when(k < last, k + 1).alias("right"),
        F.greatest(lo - 1, F.lit(0).cast("long")).alias("needs_lo"), F.least(hi + 1, F.lit(n).cast("long")).alias("needs_hi"),
    )


@query("q_neighbor_blocks", "SELECT b AS block, b * 64 AS lo, least((b + 1) * 64, 5000) AS hi, CASE WHEN b > 0 THEN b - 1 END AS \"left\", CASE WHEN b < 78 THEN b + 1 END AS \"right\", greatest(b * 64 - 1, 0) AS needs_lo, least(least((b + 1) * 64, 5000) + 1, 5000) AS needs_hi FROM (SELECT unnest(range(0, 79)) AS b)")
def neighbor_blocks(spark, d) -> DataFrame:
    return neighbour_blocks(5000, 64, spark.range(0, 79).withColumnRenamed("id", "block"))
