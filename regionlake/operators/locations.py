"""Who owns which part of an item: lookup, acquisition, transfer plans. A relation (item, rank, lo, hi)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import intervals
from ..plans.settle import settle
from ..registry import query
from ..sources import fixtures as fx
from ..sources.fixtures import with_sql

OWNER = ["item", "rank"]
TASK = ["task", "item"]
#: Ranks of the fixtures.
RANKS = 4

_LC = "lc AS (SELECT DISTINCT item, rank, unnest(range(lo, hi)) AS c FROM location)"
_BC = "bc AS (SELECT DISTINCT item, unnest(range(lo, hi)) AS c FROM region_b)"
_RC = "rc AS (SELECT DISTINCT task, item, mode, unnest(range(lo, hi)) AS c FROM requirement)"


def _boxes(source: str, *keys: str) -> str:
    k = ", ".join(keys)
    return f"SELECT {k}, min(c) AS lo, max(c) + 1 AS hi FROM (SELECT *, c - row_number() OVER (PARTITION BY {k} ORDER BY c) AS g FROM {source}) GROUP BY {k}, g"


def add_part(location: DataFrame, parts: DataFrame) -> DataFrame:
    """location with the regions of parts (item, rank, lo, hi) added to their ranks."""
    return intervals.union(location, parts, OWNER)


@query("q_loc_add", with_sql(f"WITH {_LC}, {_BC}, s AS (SELECT * FROM lc UNION SELECT item, CAST(1 AS INTEGER) AS rank, c FROM bc) {_boxes('s', 'item', 'rank')}", "location", "region_b"))
def loc_add(spark, d) -> DataFrame:
    return add_part(fx.location(spark, d), fx.region_b(spark, d).withColumn("rank", F.lit(1)))


def update(location: DataFrame, region: DataFrame, rank: int) -> DataFrame:
    """Gives rank every owned part of region (item, lo, hi); parts without an owner are not moved."""
    moved = settle(intervals.overlap_join(location, intervals.merge(region, ["item"]), ["item"]).select("item", "rank", "lo", "hi"))
    left = intervals.segments({"here": location, "gone": moved}, OWNER).where("here AND NOT gone").select(*OWNER, "lo", "hi")
    return intervals.union(left, moved.withColumn("rank", F.lit(rank)), OWNER)


@query("q_loc_update", with_sql(f"WITH {_LC}, {_BC}, s AS (SELECT DISTINCT lc.item, CASE WHEN bc.c IS NULL THEN rank ELSE 2 END AS rank, lc.c FROM lc LEFT JOIN bc ON bc.item = lc.item AND bc.c = lc.c) {_boxes('s', 'item', 'rank')}", "location", "region_b"))
def loc_update(spark, d) -> DataFrame:
    return update(fx.location(spark, d), fx.region_b(spark, d), 2)


def locate(requirements: DataFrame, location: DataFrame) -> DataFrame:
    """task, item, mode, rank, lo, hi: the owned parts of each requirement and their owners."""
    found = intervals.overlap_join(requirements, location, ["item"]).select("task", "item", "mode", F.col("b_rank").alias("rank"), "lo", "hi")
    return intervals.merge(found, ["task", "item", "mode", "rank"], intervals.width_of(location))


@query("q_locate", with_sql(f"WITH {_LC}, {_RC}, s AS (SELECT DISTINCT task, rc.item, mode, rank, rc.c FROM rc JOIN lc ON lc.item = rc.item AND lc.c = rc.c) {_boxes('s', 'task', 'item', 'mode', 'rank')}", "location", "requirement"))
def q_locate(spark, d) -> DataFrame:
    return locate(fx.requirement(spark, d), fx.location(spark, d))


def acquire_read(requirements: DataFrame, location: DataFrame, me) -> DataFrame:
    """What a read-only requirement copies from other ranks; me: the column of the task's rank."""
    return locate(requirements.where("mode = 'ReadOnly'"), location).where(F.col("rank") != me).withColumn("kind", F.lit("replicate"))


@query("q_acquire_ro", with_sql(f"WITH {_LC}, {_RC}, s AS (SELECT DISTINCT task, rc.item, mode, rank, rc.c FROM rc JOIN lc ON lc.item = rc.item AND lc.c = rc.c WHERE mode = 'ReadOnly' AND rank <> task % 4) SELECT *, 'replicate' AS kind FROM ({_boxes('s', 'task', 'item', 'mode', 'rank')})", "location", "requirement"))
def acquire_ro(spark, d) -> DataFrame:
    return acquire_read(fx.requirement(spark, d), fx.location(spark, d), F.col("task") % RANKS)


def acquire_write(requirements: DataFrame, location: DataFrame, me) -> DataFrame:
    """Of read-write requirements: parts of other ranks migrate, parts of none are allocated."""
    wanted = settle(intervals.merge(requirements.where("mode = 'ReadWrite'").select(*TASK, "lo", "hi"), TASK))
    found = settle(intervals.overlap_join(wanted, location, ["item"]).select(*TASK, F.col("b_rank").alias("rank"), "lo", "hi"))
    width = intervals.width_of(wanted)
    moved = intervals.merge(found.where(F.col("rank") != me), [*TASK, "rank"], width).withColumn("kind", F.lit("migrate"))
    new = intervals.difference(wanted, found.select(*TASK, "lo", "hi"), TASK)
    return moved.unionByName(new.select(*TASK, F.lit(None).cast("int").alias("rank"), "lo", "hi", F.lit("allocate").alias("kind")))


_WC = "wc AS (SELECT DISTINCT task, item, c FROM rc WHERE mode = 'ReadWrite')"
_RW = f"""{_LC}, {_RC}, {_WC}, m AS (SELECT task, wc.item, rank, wc.c FROM wc JOIN lc ON lc.item = wc.item AND lc.c = wc.c WHERE rank <> task % 4),
 n AS (SELECT task, item, c FROM wc WHERE NOT EXISTS (SELECT 1 FROM lc WHERE lc.item = wc.item AND lc.c = wc.c))"""


@query("q_acquire_rw", with_sql(f"WITH {_RW} SELECT task, item, rank, lo, hi, 'migrate' AS kind FROM ({_boxes('m', 'task', 'item', 'rank')}) UNION ALL SELECT task, item, NULL AS rank, lo, hi, 'allocate' AS kind FROM ({_boxes('n', 'task', 'item')})", "location", "requirement"))
def acquire_rw(spark, d) -> DataFrame:
    return acquire_write(fx.requirement(spark, d), fx.location(spark, d), F.col("task") % RANKS)


def missing_region(wanted: DataFrame, full: DataFrame, allocated: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lo, hi, unallocated: of a key's wanted region the managed part that no child has, if there is
    one; else what is not managed at all."""
    pieces = settle(intervals.segments({"wanted": wanted, "full": full, "allocated": allocated}, keys).where("wanted AND NOT (full AND allocated)"))
    has = pieces.where("full").select(*keys).distinct().withColumn("unallocated", F.lit(True))
    chosen = pieces.join(has, keys, "left").withColumn("unallocated", F.coalesce("unallocated", F.lit(False))).where("full = unallocated")
    return intervals.merge(chosen.select(*keys, "unallocated", "lo", "hi"), [*keys, "unallocated"])


@query(
    "q_missing_region",
    with_sql(
        f"""WITH w AS (SELECT DISTINCT item, unnest(range(lo, hi)) AS c FROM region_a), {_BC},
        al AS (SELECT DISTINCT item, unnest(range(lo, hi)) AS c FROM location WHERE item <> 'N' OR rank >= 0),
        f AS (SELECT item, c FROM bc WHERE item <> 'R' UNION SELECT item, c FROM al),
        m AS (SELECT item, c FROM w INTERSECT (SELECT item, c FROM f EXCEPT SELECT item, c FROM al)),
        r AS (SELECT item, c FROM w WHERE item NOT IN (SELECT item FROM m) EXCEPT SELECT item, c FROM f)
        SELECT *, true AS unallocated FROM ({_boxes('m', 'item')}) UNION ALL SELECT *, false AS unallocated FROM ({_boxes('r', 'item')})""",
        "region_a", "region_b", "location",
    ),
)
def q_missing_region(spark, d) -> DataFrame:
    """Managed: what has an owner, and region B of all items but one; allocated: what has an owner."""
    allocated = fx.location(spark, d).select("item", "lo", "hi")
    full = fx.region_b(spark, d).where("item <> 'R'").unionByName(allocated)
    return missing_region(fx.region_a(spark, d), full, allocated, ["item"])


def write_check(requirements: DataFrame, location: DataFrame, me) -> DataFrame:
    """task, item, ok: whether the task's rank owns all that it writes; read-only ones are skipped."""
    wanted = settle(intervals.merge(requirements.where("mode = 'ReadWrite'").select(*TASK, "lo", "hi"), TASK))
    own = intervals.overlap_join(wanted, location, ["item"]).where(F.col("b_rank") == me).select(*TASK, "lo", "hi")
    return intervals.segments({"wanted": wanted, "own": own}, TASK).where("wanted").groupBy(*TASK).agg(F.bool_and("own").alias("ok"))


@query("q_write_check", with_sql(f"WITH {_LC}, {_RC}, {_WC} SELECT task, item, bool_and(EXISTS (SELECT 1 FROM lc WHERE lc.item = wc.item AND lc.c = wc.c AND lc.rank = wc.task % 4)) AS ok FROM wc GROUP BY task, item", "location", "requirement"))
def q_write_check(spark, d) -> DataFrame:
    return write_check(fx.requirement(spark, d), fx.location(spark, d), F.col("task") % RANKS)


def split_allowance(full: DataFrame, left: DataFrame, right: DataFrame, required: DataFrame, keys: list[str]) -> DataFrame:
    """What the left child gets of required: not yet its own, managed here and not the right child's."""
    sets = {"required": required, "here": full, "lefts": left, "rights": right}
    return intervals.where(sets, keys, "required AND here AND NOT lefts AND NOT rights")


@query(
    "q_allowance_split",
    with_sql(
        f"""WITH {_LC}, w AS (SELECT DISTINCT item, unnest(range(lo, hi)) AS c FROM region_a),
        s AS (SELECT item, c FROM w WHERE EXISTS (SELECT 1 FROM lc WHERE lc.item = w.item AND lc.c = w.c)
          AND NOT EXISTS (SELECT 1 FROM lc WHERE lc.item = w.item AND lc.c = w.c AND rank IN (0, 3))) {_boxes('s', 'item')}""",
        "location", "region_a",
    ),
)
def allowance_split(spark, d) -> DataFrame:
    """Full: all that is owned; left: rank 0's; right: rank 3's."""
    loc = fx.location(spark, d)
    of = lambda r: loc.where(F.col("rank") == r).select("item", "lo", "hi")
    return split_allowance(loc.select("item", "lo", "hi"), of(0), of(3), fx.region_a(spark, d), ["item"])


def transfer_plan(requirements: DataFrame, owners: DataFrame, target) -> DataFrame:
    """task, item, mode, rank, lo, hi, kind: where each requirement's elements come from.

    What the target has is skipped; every other element comes from its owner of the least rank. Read-only
    elements are replicated, others migrate. A requirement is cut where an owner's part begins or ends, so
    its work goes with the number of parts, not of elements.
    """
    keys = ["task", "item", "mode"]
    found = settle(locate(requirements, owners))
    cuts = found.select(*keys, F.explode(F.array("lo", "hi")).alias("lo")).distinct()
    pieces = cuts.withColumn("hi", F.lead("lo").over(Window.partitionBy(*keys).orderBy("lo"))).where("hi IS NOT NULL")
    held = intervals.overlap_join(pieces, found, keys)
    each = held.groupBy(*keys, "a_lo", "a_hi").agg(F.min("b_rank").alias("rank"), F.bool_or(F.col("b_rank") == target).alias("there")).where("NOT there")
    boxes = intervals.merge(each.select("task", "item", "mode", "rank", F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi")), ["task", "item", "mode", "rank"], intervals.width_of(found))
    return boxes.withColumn("kind", F.when(F.col("mode") == "ReadOnly", "Replication").otherwise("Migration"))


@query(
    "q_transfer_plan",
    with_sql(
        f"""WITH {_RC}, o AS (SELECT item, rank, lo, hi FROM location UNION ALL SELECT item, (rank + 1) % 4 AS rank, lo + 75 AS lo, hi + 75 AS hi FROM location),
        oc AS (SELECT DISTINCT item, rank, unnest(range(lo, hi)) AS c FROM o),
        s AS (SELECT task, rc.item, mode, rc.c, min(rank) AS rank FROM rc JOIN oc ON oc.item = rc.item AND oc.c = rc.c GROUP BY task, rc.item, mode, rc.c HAVING NOT bool_or(rank = task % 4))
        SELECT *, CASE WHEN mode = 'ReadOnly' THEN 'Replication' ELSE 'Migration' END AS kind FROM ({_boxes('s', 'task', 'item', 'mode', 'rank')})""",
        "location", "requirement",
    ),
)
def q_transfer_plan(spark, d) -> DataFrame:
    loc = fx.location(spark, d)
    also = loc.select("item", ((F.col("rank") + 1) % RANKS).cast("int").alias("rank"), (F.col("lo") + 75).alias("lo"), (F.col("hi") + 75).alias("hi"))
    return transfer_plan(fx.requirement(spark, d), loc.unionByName(also), F.col("task") % RANKS)


def ownership_json(locations: DataFrame) -> DataFrame:
    """Each rank's boxes of an item as JSON, in order. A rank's canonical boxes of one item are one document."""
    boxes = intervals.merge(locations, OWNER)
    part = F.struct(F.array("lo").alias("from"), F.array("hi").alias("to"))
    listed = boxes.groupBy("rank", "item").agg(F.sort_array(F.collect_list(part)).alias("region"))
    return listed.select("rank", "item", F.to_json(F.struct(F.col("item").alias("id"), F.lit("range").alias("type"), "region")).alias("json"))


def acquire(requirements: DataFrame, location: DataFrame, me) -> DataFrame:
    """All requirements of every task, of either mode: what is replicated, migrates or is allocated; a task
    can go when all of its rows have been done."""
    read = acquire_read(requirements, location, me).select(*TASK, "rank", "lo", "hi", "kind")
    return read.unionByName(acquire_write(requirements, location, me))


@query("q_acquire_all", with_sql(f"WITH {_RW}, s AS (SELECT DISTINCT task, rc.item, rank, rc.c FROM rc JOIN lc ON lc.item = rc.item AND lc.c = rc.c WHERE mode = 'ReadOnly' AND rank <> task % 4), x AS (SELECT task, item, rank, lo, hi, 'replicate' AS kind FROM ({_boxes('s', 'task', 'item', 'rank')}) UNION ALL SELECT task, item, rank, lo, hi, 'migrate' AS kind FROM ({_boxes('m', 'task', 'item', 'rank')}) UNION ALL SELECT task, item, NULL AS rank, lo, hi, 'allocate' AS kind FROM ({_boxes('n', 'task', 'item')})) SELECT task, kind, count(*) AS parts, CAST(sum(hi - lo) AS BIGINT) AS elements FROM x GROUP BY task, kind", "location", "requirement"))
def acquire_all(spark, d) -> DataFrame:
    """Parts and elements that each task waits for, by kind."""
    rows = acquire(fx.requirement(spark, d), fx.location(spark, d), F.col("task") % RANKS)
    return rows.groupBy("task", "kind").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.col("hi") - F.col("lo")).alias("elements"))


def surrender(location: DataFrame, missing: DataFrame) -> DataFrame:
    """item, rank, lo, hi, gone: every rank's parts of missing (item, lo, hi), which it gives up, and what it
    keeps."""
    ranks = location.select(*OWNER).distinct()
    asked = missing.join(ranks, "item").select(*OWNER, "lo", "hi")
    pieces = settle(intervals.segments({"here": location, "asked": asked}, OWNER).where("here"))
    return intervals.merge(pieces.select(*OWNER, F.col("asked").alias("gone"), "lo", "hi"), [*OWNER, "gone"])


@query("q_collect_children", with_sql(f"WITH {_LC}, {_BC}, s AS (SELECT lc.item, rank, bc.c IS NOT NULL AS gone, lc.c FROM lc LEFT JOIN bc ON bc.item = lc.item AND bc.c = lc.c) {_boxes('s', 'item', 'rank', 'gone')}", "location", "region_b"))
def collect_children(spark, d) -> DataFrame:
    return surrender(fx.location(spark, d), fx.region_b(spark, d))


def resize(covered: DataFrame, exclusive: DataFrame, region: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Covered and exclusive parts (item, rank, lo, hi) after fragments have grown by region (item, rank, lo,
    hi, write): all of it is covered, what is written is owned as well."""
    grown = intervals.union(covered, region, OWNER)
    return grown, intervals.union(exclusive, region.where("write"), OWNER)


@query("q_resize_fragment", with_sql(f"WITH {_LC}, g AS (SELECT DISTINCT item, CAST(lo % 4 AS INTEGER) AS rank, lo % 2 = 0 AS write, unnest(range(lo, hi)) AS c FROM region_b), s AS (SELECT 'covered' AS what, * FROM (SELECT item, rank, c FROM lc UNION SELECT item, rank, c FROM g) UNION ALL SELECT 'exclusive' AS what, * FROM (SELECT item, rank, c FROM lc UNION SELECT item, rank, c FROM g WHERE write)) {_boxes('s', 'what', 'item', 'rank')}", "location", "region_b"))
def resize_fragment(spark, d) -> DataFrame:
    """Fragments of the owned parts grow by region B, dealt over the ranks; boxes at even places are written."""
    loc = fx.location(spark, d)
    region = fx.region_b(spark, d).select("item", (F.col("lo") % 4).cast("int").alias("rank"), "lo", "hi", (F.col("lo") % 2 == 0).alias("write"))
    covered, exclusive = resize(loc, loc, region)
    return covered.select(F.lit("covered").alias("what"), *OWNER, "lo", "hi").unionByName(exclusive.select(F.lit("exclusive").alias("what"), *OWNER, "lo", "hi"))


@query("q_ownership_json", with_sql("WITH r AS (SELECT rank, item, lo, hi FROM location) SELECT rank, item, '{\"id\":\"' || item || '\",\"type\":\"range\",\"region\":[' || string_agg('{\"from\":[' || lo || '],\"to\":[' || hi || ']}', ',' ORDER BY lo) || ']}' AS json FROM (SELECT rank, item, min(c) AS lo, max(c) + 1 AS hi FROM (SELECT *, c - row_number() OVER (PARTITION BY rank, item ORDER BY c) AS g FROM (SELECT DISTINCT rank, item, unnest(range(lo, hi)) AS c FROM r)) GROUP BY rank, item, g) GROUP BY rank, item", "location"))
def q_ownership_json(spark, d) -> DataFrame:
    return ownership_json(fx.location(spark, d))
