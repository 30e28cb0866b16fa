"""Sweeps over half-open intervals without putting a key's rows into one task.

Every step that looks along a key (running sums, running maxima, the next point) works inside bins of the
coordinate; only one summary row of each bin is ordered along the whole key. Bins are as wide as the range
of the coordinates needs for a key to have no more than MOST_BINS of them. So a key that holds a third of
all rows is spread over as many tasks as its coordinates have bins, and its summary fits one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The least coordinates in a bin; the most bins of a key; bins in a range.
BIN, MOST_BINS, RANGE = 1024, 1 << 20, 1024


def width_of(*frames: DataFrame) -> int:
    """The width of bins for all intervals (lo, hi) of frames: one pass over two columns, a row back."""
    ends = None
    for df in frames:
        one = df.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        ends = one if ends is None else ends.unionByName(one)
    r = ends.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    span = 0 if r["lo"] is None or r["hi"] is None else int(r["hi"]) - int(r["lo"])
    width = BIN
    while width * MOST_BINS < span:
        width *= 2
    return width


def _bin(c: Column, width: int) -> Column:
    return F.floor(c / width).cast("long")


def earlier_sum(bins: DataFrame, value: str) -> DataFrame:
    """_bin and base: the sum of a value over all earlier bins, combined inside ranges of bins first."""
    rows = bins.withColumn("_range", F.floor(F.col("_bin") / RANGE).cast("long"))
    per = rows.groupBy("_range").agg(F.sum(value).alias("_sum"))
    outer = per.select("_range", F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_outer"))
    inner = F.sum(value).over(Window.partitionBy("_range").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(outer, "_range").select("_bin", (F.coalesce(inner, F.lit(0)) + F.coalesce("_outer", F.lit(0))).alias("base"))


def merge(df: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """The canonical form of a set of intervals (keys, lo, hi): disjoint, maximal, not empty.

    Intervals are merged inside the bins of their starts. A bin then tells its last start and its end; along
    the key these give each bin what reaches into it, and since where.
    """
    width = width or width_of(df)
    rows = df.where("lo < hi").withColumn("_bin", _bin(F.col("lo"), width))
    inside = Window.partitionBy(*keys, "_bin").orderBy("lo", "hi")
    before = F.max("hi").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    flagged = rows.select(*keys, "_bin", "lo", "hi", F.when(before >= F.col("lo"), 0).otherwise(1).alias("_new"))
    numbered = flagged.withColumn("_part", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    local = numbered.groupBy(*keys, "_bin", "_part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    along = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = local.groupBy(*keys, "_bin").agg(F.max("lo").alias("_last"), F.max("hi").alias("_top")).withColumn("_reach", F.max("_top").over(along))
    fresh = F.when(F.col("_reach").isNull() | (F.col("_last") > F.col("_reach")), F.col("_last"))
    bins = bins.withColumn("_since", F.last(fresh, ignorenulls=True).over(along)).select(*keys, "_bin", "_reach", "_since")
    start = F.when(F.col("lo") <= F.col("_reach"), F.col("_since")).otherwise(F.col("lo"))
    return local.join(bins, [*keys, "_bin"]).groupBy(*keys, start.alias("lo")).agg(F.max("hi").alias("hi"))


def segments(sets: dict[str, DataFrame], keys: list[str], width: int | None = None) -> DataFrame:
    """keys, lo, hi and for each set whether it covers the piece: one sweep over the ends of all sets."""
    width, ends = width or width_of(*sets.values()), None
    for name, df in sets.items():
        signs = lambda s, own=name: [F.lit(s if n == own else 0).alias(n) for n in sets]
        pair = F.inline(F.array(F.struct(F.col("lo").alias("p"), *signs(1)), F.struct(F.col("hi").alias("p"), *signs(-1))))
        part = df.where("lo < hi").select(*keys, pair)
        ends = part if ends is None else ends.unionByName(part)
    points = ends.withColumn("_bin", _bin(F.col("p"), width)).repartition(*keys, "_bin")
    points = points.groupBy(*keys, "_bin", "p").agg(*[F.sum(n).alias(n) for n in sets])
    order = Window.partitionBy(*keys).orderBy("_bin")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    bins = points.groupBy(*keys, "_bin").agg(F.min("p").alias("_p"), *[F.sum(n).alias(f"_s_{n}") for n in sets])
    bins = bins.select(*keys, "_bin", F.lead("_p").over(order).alias("_after"), *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sets])
    inside = Window.partitionBy(*keys, "_bin").orderBy("p")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    return points.join(bins, [*keys, "_bin"]).select(
        *keys,
        F.col("p").alias("lo"),
        F.coalesce(F.lead("p").over(inside), F.col("_after")).alias("hi"),
        *[(F.col(f"_c_{n}") + F.sum(n).over(so_far) > 0).alias(n) for n in sets],
    )


def where(sets: dict[str, DataFrame], keys: list[str], condition: str) -> DataFrame:
    """The canonical region of the elements for which a condition on the sets' names holds."""
    width = width_of(*sets.values())
    return merge(segments(sets, keys, width).where(condition).select(*keys, "lo", "hi"), keys, width)


def union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return merge(a.select(*keys, "lo", "hi").unionByName(b.select(*keys, "lo", "hi")), keys, width_of(a, b))


def intersect(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return where({"a": a, "b": b}, keys, "a AND b")


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return where({"a": a, "b": b}, keys, "a AND NOT b")


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """Pairs of overlapping intervals: a's columns, b's as b_<name> (but the keys), and lo, hi of the overlap.

    Intervals meet in the bins they touch; the bin of the overlap's start keeps the pair. Pairs are the
    result here, so their number is the size of the overlap relation. An interval touches at most MOST_BINS.
    """
    width = width or width_of(a, b)
    rest = [c for c in b.columns if c not in keys]
    right = b.where("lo < hi").select(*keys, *[F.col(c).alias(f"b_{c}") for c in rest])
    left = a.where("lo < hi").withColumnsRenamed({"lo": "a_lo", "hi": "a_hi"})
    left = left.withColumn("_bin", F.explode(F.sequence(_bin(F.col("a_lo"), width), _bin(F.col("a_hi") - 1, width))))
    right = right.withColumn("_bin", F.explode(F.sequence(_bin(F.col("b_lo"), width), _bin(F.col("b_hi") - 1, width))))
    lo = F.greatest("a_lo", "b_lo")
    out = left.join(right, [*keys, "_bin"]).where((F.col("a_lo") < F.col("b_hi")) & (F.col("b_lo") < F.col("a_hi")) & (F.col("_bin") == _bin(lo, width)))
    return out.withColumn("lo", lo).withColumn("hi", F.least("a_hi", "b_hi")).drop("_bin")
