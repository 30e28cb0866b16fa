"""Mixing sources to target weights by subset sums over exact document lengths.

Every source gets a target of words. Whole passes over a source's documents come first; what is left of
the target is met by a subset: documents are counted by exact length, a proportional share of every length
is taken, lengths are added in seeded order while they fit, and bounded-knapsack dynamic programming over
the remaining counts finds the sum nearest to the rest, the rest itself where the counts allow. Which documents of a length are taken
follows a seeded hash, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, hashing

#: By sources in code point order, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: No document more often than this.
MOST = 3
#: The dynamic programme's budget, in words: lengths are added until less than this is missing.
BUDGET = 1 << 15
#: Ranges of the seeded hash: a length of one source is ranked in so many parts.
RANGES = 4096
#: Targets of at most so many sources are computed on the driver, of more where the sources are.
GATHERED = 100_000


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> dict[str | None, float]:
    """Each source's target: share of all sizes by weight, at most most times its size; what is cut off
    is shared anew by weight among the others until none is above."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, free = share * sum(sizes.values()), {}, list(names)
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not full:
            out |= {s: unit * weight[s] for s in free}
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many of each length to take: their sum is the nearest to budget that is found, of two the lower.

    The sum equals budget whenever the remaining counts can fill what the greedy part leaves.
    """
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return take
    if budget >= total:
        return np.where(lengths > 0, counts, 0)
    keep = min(BUDGET, budget)
    part = (budget - keep) / total
    take = np.where(lengths > 0, np.floor(counts * part).astype(np.int64), 0)
    left = budget - int((lengths * take).sum())
    order = np.argsort(hashing.mix(lengths.astype(np.uint64) + np.uint64(hashing.mixed(seed))), kind="stable")
    for i in order:
        n, spare = int(lengths[i]), int(counts[i] - take[i])
        if n > 0 and spare > 0 and left - n >= BUDGET // 2:
            k = min(spare, (left - BUDGET // 2) // n)
            take[i] += k
            left -= k * n
    # bounded knapsack: bit s of reach says whether the sum s can be made of the lengths so far; a sum of
    # more than twice what is left is farther from it than none
    most = 2 * left
    reach, steps, full = 1, [], (1 << (most + 1)) - 1
    for i in order:
        n, spare = int(lengths[i]), int(counts[i] - take[i])
        spare = min(spare, most // n) if n > 0 else 0
        k = 1
        while spare > 0 and not reach >> left & 1:
            k = min(k, spare)
            steps.append((i, k, reach))
            reach |= reach << (k * n) & full
            spare -= k
            k *= 2
        if reach >> left & 1:
            break
    at = (reach & (1 << (left + 1)) - 1).bit_length() - 1
    above = reach >> left
    if above:
        next_up = left + (above & -above).bit_length() - 1
        at = next_up if next_up - left < left - at else at
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= k * int(lengths[i])
    return take


def _wanted(totals: DataFrame, weights: tuple[float, ...], most: int, share: float) -> DataFrame:
    """skey, source_size, target of every source (skey, total)."""
    spark = totals.sparkSession
    gathered = totals.limit(GATHERED + 1).collect()  # one row a source
    if len(gathered) <= GATHERED:
        sizes = {(r["skey"][1:] if r["skey"] != "n" else None): int(r["total"]) for r in gathered}
        rows = [("n" if s is None else "s" + s, sizes[s], float(t)) for s, t in targets(sizes, weights, most, share).items()]
        return spark.createDataFrame(rows, "skey string, source_size long, target double")
    order = [F.col("skey") == "n", F.col("skey")]
    ranged = common.settled(totals.repartitionByRange(common.parts(spark), *order).withColumn("part", F.spark_partition_id()))
    before, begin = 0, []
    for r in ranged.groupBy("part").count().orderBy("part").collect():  # one row a partition
        begin.append((r["part"], before))
        before += r["count"]
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    begins = spark.createDataFrame(begin, "part int, begin long")
    ranked = ranged.withColumn("rank", rank).join(F.broadcast(begins), "part")
    k = F.pmod(F.col("begin") + F.col("rank"), F.lit(len(weights))).cast("int")
    weighted = common.settled(ranked.select("skey", F.col("total").alias("size"), F.element_at(F.array(*[F.lit(float(w)) for w in weights]), k + 1).alias("weight")))
    # each round caps more sources; those that are capped stay so, as the unit grows
    unit, capped = 0.0, -1
    while True:
        cap = most * F.col("size") < F.lit(unit) * F.col("weight")
        got = weighted.agg(F.count_if(cap).alias("n"), F.sum(F.when(cap, most * F.col("size"))).alias("cut"), F.sum(F.when(~cap, F.col("weight"))).alias("weight"), F.sum("size").alias("size")).first()
        if got["n"] == capped or not got["weight"]:
            break
        capped, unit = got["n"], (share * got["size"] - (got["cut"] or 0)) / got["weight"]
    target = F.least(F.lit(unit) * F.col("weight"), (most * F.col("size")).cast("double"))
    return weighted.select("skey", F.col("size").alias("source_size"), target.alias("target"))


def mix(docs: DataFrame, seed: int = 7, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row.

    size: words [^\\x20\\x09-\\x0D]+ of the whole text, 0 for null. taken: words the mix takes of the
    document, repeats counted, a multiple of size. Null sources are one source, the last. Repeated rows
    are documents of their own; null ids stay. An empty table gives no rows; a source without words has
    target 0.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    sized = common.slim(docs, "doc_id", "source", "text").select(
        "doc_id",
        "source",
        key.alias("skey"),
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id").alias("h"),
    )
    sized = common.settled(sized.withColumn("b", F.pmod(F.col("h"), F.lit(RANGES)).cast("int")))
    by_range = sized.groupBy("skey", "size", "b").agg(F.count(F.lit(1)).alias("n"))
    by_length = sized.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n"))
    totals = by_length.groupBy("skey").agg(F.sum(F.col("size") * F.col("n")).alias("total"))
    wanted = _wanted(totals, weights, most, share)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        target, size = float(pdf["target"].iloc[0]), int(pdf["source_size"].iloc[0])
        pdf = pdf.sort_values("size")
        passes = min(most, int(target // size)) if size else 0
        budget = round(target - passes * size) if passes < most else 0
        extra = fit_budget(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(budget), seed)
        return pd.DataFrame({"skey": pdf["skey"], "size": pdf["size"], "passes": passes, "extra": extra, "source_size": size, "target": target})

    planned = by_length.join(wanted, "skey").groupBy("skey").applyInPandas(plan, "skey string, size long, passes int, extra long, source_size long, target double")
    before = Window.partitionBy("skey", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = by_range.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(planned, ["skey", "size"]).drop("n")
    within = Window.partitionBy("skey", "size", "b").orderBy("h", "doc_id")
    ranked = sized.withColumn("r", F.row_number().over(within)).join(ranges, ["skey", "size", "b"])
    times = F.col("passes") + F.when(F.col("before") + F.col("r") <= F.col("extra"), 1).otherwise(0)
    return ranked.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def op6(docs: DataFrame) -> DataFrame:
    return mix(docs).drop("source")
