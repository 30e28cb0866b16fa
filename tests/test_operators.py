"""Invariants, closed forms and literal results of operators that SQL does not cover."""

import hashlib
import json
import math
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from helpers import same
from regionlake import registry
from regionlake.functions import tuning
from regionlake.operators import kernels, locations, scheduling
from regionlake.plans import intervals
from regionlake.sources import fixtures as fx
from regionlake.sources import sinks
from regionlake.streaming import monitor

Q = registry.queries()


def boxes(spark, rows):
    return spark.createDataFrame(rows, "k string, lo long, hi long")


def listed(df):
    return sorted((r["lo"], r["hi"]) for r in df.collect())


def test_merge_over_bins(spark):
    rows = [("a", 0, 10), ("a", 10, 12), ("a", 5, 5000), ("a", 4999, 5001), ("a", 7000, 7000), ("a", 6000, 9000), ("a", 9001, 9002), ("a", 8000, 8999)]
    assert listed(intervals.merge(boxes(spark, rows), ["k"], 7)) == [(0, 5001), (6000, 9000), (9001, 9002)]


@pytest.mark.parametrize("seed", range(3))
def test_interval_algebra(spark, seed):
    rng = np.random.default_rng(seed)
    draw = lambda: [("a", int(x), int(x + n)) for x, n in zip(rng.integers(0, 300, 40), rng.integers(0, 12, 40), strict=True)]
    a, b = draw(), draw()
    sa, sb = ({c for _, lo, hi in r for c in range(lo, hi)} for r in (a, b))
    to_boxes = lambda s: [(c, next(d for d in range(c, 10**6) if d not in s)) for c in sorted(s) if c - 1 not in s]
    da, db = boxes(spark, a), boxes(spark, b)
    assert listed(intervals.union(da, db, ["k"])) == to_boxes(sa | sb)
    assert listed(intervals.intersect(da, db, ["k"])) == to_boxes(sa & sb)
    assert listed(intervals.difference(da, db, ["k"])) == to_boxes(sa - sb)


def test_empty_regions(spark):
    none = boxes(spark, []).where("k = 'x'")
    some = boxes(spark, [("a", 1, 3)])
    assert listed(intervals.union(none, none, ["k"])) == []
    assert listed(intervals.difference(some, none, ["k"])) == [(1, 3)]
    assert listed(intervals.intersect(some, none, ["k"])) == []


def test_hierarchy_roots(spark):
    got = [r["root"] for r in Q["q_hierarchy_root"](spark, DATA).orderBy("size").limit(12).collect()]
    assert got == "0:0 0:1 0:2 0:2 0:3 0:3 0:3 0:3 0:4 0:4 0:4 0:4".split()


def test_identity_product(spark):
    one = spark.range(20).select(F.col("id").alias("i"), F.col("id").alias("k"), F.lit(1).alias("v"))
    got = kernels.matmul(one, one).collect()
    assert len(got) == 20 and all(r["i"] == r["j"] and r["v"] == 1 for r in got)


def test_shares_differ_by_one(spark):
    n = [r["n"] for r in scheduling.uniform_mapping(spark, 7).groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(n) == 7 and max(n) - min(n) <= 1


def test_decisions_reach_the_mapped_node(spark):
    tree = {r["path"]: r["decision"] for r in Q["q_decision_tree"](spark, DATA).collect()}
    for task in range(32):
        lo, hi, path = 0, 4, 32 + task
        for up in range(5, -1, -1):
            choice = tree.get(path >> up)
            mid = lo + (hi - lo) // 2
            lo, hi = (lo, mid) if choice == "left" else (mid, hi) if choice == "right" else (lo, hi)
        assert (lo, hi) == (task // 8, task // 8 + 1)


def test_rebalance_uses_active_nodes_in_order(spark):
    got = [r["node"] for r in Q["q_rebalance_map"](spark, DATA).orderBy("task").collect()]
    assert got == sorted(got) and set(got) == {0, 2, 3}


def plain_trace(p, v, steps, every, cells):
    """One particle, in plain numbers."""
    half, out = kernels.SIDE * kernels.RADIUS_M / 2, []
    if sum(x * x for x in p) < kernels.RADIUS_M**2 or any(abs(x) > half for x in p):
        return out
    for step in range(steps + 1):
        cell = tuple(int((x + half) // (2 * half / cells)) for x in p)
        x, y, z = p
        strength = -kernels.FIELD * kernels.RADIUS_M**3 / (x * x + y * y + z * z) ** 2.5
        b = [3 * x * z * strength, 3 * y * z * strength, (2 * z * z - x * x - y * y) * strength]
        qom = kernels.CHARGE / kernels.MASS
        parts = min(int(kernels.STEP_S / (np.pi * kernels.LIGHT / (4 * qom * sum(c * c for c in b)))) + 1, kernels.MOST_SUBSTEPS)
        dt = kernels.STEP_S / parts
        for _ in range(parts):
            t = [0.5 * qom * dt * c for c in b]
            s = [2 * c / (1 + sum(w * w for w in t)) for c in t]
            cross = lambda a, c: [a[1] * c[2] - a[2] * c[1], a[2] * c[0] - a[0] * c[2], a[0] * c[1] - a[1] * c[0]]
            v = [a + c for a, c in zip(v, cross([a + c for a, c in zip(v, cross(v, t), strict=True)], s), strict=True)]
            p = [a + c * dt for a, c in zip(p, v, strict=True)]
        p = [a - 2 * half if a > half else a + 2 * half if a < -half else a for a in p]
        if sum(a * a for a in p) <= kernels.RADIUS_M**2:
            return out
        if step % every == 0:
            out.append((step // every, *cell))
    return out


def test_particles_one_by_one():
    rng = np.random.default_rng(4)
    p = rng.uniform(-0.55, 0.55, (60, 3)) * kernels.SIDE * kernels.RADIUS_M
    p[:20] /= 6  # near the planet: many sub-steps, some absorbed, some inside from the start
    v = rng.normal(0, 4e7, (60, 3))
    want = sorted(c for a, b in zip(p.tolist(), v.tolist(), strict=True) for c in plain_trace(a, b, 12, 4, 16))
    got = sorted(tuple(r) for frame in kernels.trace(p.copy(), v.copy(), 12, 4, 16) for r in frame.tolist())
    assert got == want and len(want) > 60


def test_frontier_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, int(a), int(b), int(2000 - a - b + c)) for i, (a, b, c) in enumerate(zip(rng.integers(0, 900, 800), rng.integers(0, 900, 800), rng.integers(0, 30, 800), strict=True))]
    rows = [(i, -a, b, c) for i, a, b, c in rows]  # load is to be large: many undominated points
    df = spark.createDataFrame(rows, "id long, load long, time long, energy long")
    want = sorted(i for i, a, b, c in rows if not any(x >= a and y <= b and z <= c and (x, y, z) != (a, b, c) for _, x, y, z in rows))
    monkeypatch.setattr(scheduling, "FRONTIER_BLOCK", 50)
    assert sorted(r["id"] for r in scheduling.pareto(df).collect()) == want and len(want) > 100


def test_radius_count_by_leaves(spark):
    rng = np.random.default_rng(1)
    p, q = rng.uniform(0, 100, (3000, 7)), rng.uniform(0, 100, (700, 7))
    want = {k: int(n) for k, n in enumerate((((q[:, None, :] - p[None, :, :]) ** 2).sum(2) <= 45.0**2).sum(1)) if n}
    points = spark.createDataFrame([(x.tolist(),) for x in p], "p array<double>")
    queries = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(q)], "qid long, p array<double>")
    assert {r["qid"]: r["n"] for r in kernels.radius_count(points, queries, 45.0, block=300).collect()} == want
    assert kernels.radius_one(points, q[3].tolist(), 45.0).first()["n"] == want.get(3, 0)
    assert kernels.radius_count(points, queries.where("qid < 0"), 45.0).count() == 0


def test_shift_boundaries():
    costs = np.array([9.0] * 4 + [1.0] * 4)
    got = scheduling.shift_boundaries(costs, np.repeat([0, 1], 4), 2)
    assert list(np.bincount(got)) == [2, 6]  # the dear node gives one, and the cheap one takes another
    # of two neighbours with equal means the one before gives or takes
    even = np.array([9.0] * 4 + [1.0] * 4 + [9.0] * 4)
    assert list(np.bincount(scheduling.shift_boundaries(even, np.repeat([0, 1, 2], 4), 3))) == [2, 7, 3]
    flat = np.full(8, 2.0)
    assert list(scheduling.shift_boundaries(flat, np.repeat([0, 1], 4), 2)) == [0] * 4 + [1] * 4


def test_decide_moves_from_slow_to_fast():
    tasks = {0: [0, 1, 2, 3], 1: [4, 5], 2: [6, 7]}
    got = scheduling.decide({0: 1.0, 1: 1.0, 2: 1.0}, {0: 9.0, 1: 5.0, 2: 1.0}, tasks, 3)
    assert got[4] == got[5] == 1 and sum(n == 2 for n in got.values()) > 2
    assert set(scheduling.decide({0: 1.0}, {0: 1.0}, {0: [0, 1, 2]}, 3).values()) == {0, 1, 2}


def test_uts_levels_add_up(spark):
    rows = Q["q_uts_size"](spark, DATA).orderBy("depth").collect()
    assert rows[0]["nodes"] == 1 and rows[-1]["nodes"] == rows[-1]["leaves"]
    assert [r["depth"] for r in rows] == list(range(len(rows)))


def test_particles_are_not_made(spark):
    per = Q["q_pic_density"](spark, DATA).groupBy("frame").agg(F.sum("n").alias("n")).orderBy("frame").collect()
    n = [r["n"] for r in per]
    assert len(n) == 5 and n == sorted(n, reverse=True) and n[0] <= 5000


def test_algebra_sizes(spark):
    a, b = fx.region_a(spark, DATA), fx.region_b(spark, DATA)
    size = lambda df: df.select(F.sum(F.col("hi") - F.col("lo"))).first()[0]
    assert [size(intervals.merge(a, ["item"])), size(intervals.intersect(a, b, ["item"])), size(intervals.difference(a, b, ["item"]))] == [708, 173, 535]


def test_stream_throughput(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, "2024-01-01 00:10:00"), (1, "2024-01-01 00:50:00"), (2, "2024-01-01 00:20:00"), (1, "2024-01-01 05:00:00")]
    df = spark.createDataFrame(rows, "rank int, t string").select("rank", F.col("t").cast("timestamp").alias("ts"))
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = monitor.throughput(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["rank"], r["tasks"]) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 2), (2, 1)}


def plain_tree(b0, limit, seed):
    level, sizes = [hashlib.sha1(b"\0" * 16 + struct.pack(">I", seed)).digest()], []
    while level:
        below = []
        for depth, s in ((len(sizes), s) for s in level):
            u = (struct.unpack(">I", s[16:])[0] & 0x7FFFFFFF) / 2147483648.0
            n = min(100, math.floor(math.log(1 - u) / math.log(1 - 1 / (1 + b0)))) if depth < limit or depth == 0 else 0
            below += [hashlib.sha1(s + struct.pack(">I", i)).digest() for i in range(n)]
        sizes.append(len(level))
        level = below
    return sizes


def test_uts_tree_is_the_hashed_one(spark):
    """The same rule in plain Python gives 4,130,071 nodes of depth 10 and seed 19."""
    got = [r["nodes"] for r in kernels.uts_size(spark, DATA, limit=6).orderBy("depth").collect()]
    assert got == plain_tree(4.0, 6, 19)


def test_child_counts(spark):
    rows = spark.range(4).select(F.col("id").alias("depth"))
    of = lambda kind, **k: [r["n"] for r in rows.select(kernels.children(kind, F.lit(0.2), F.col("depth"), 5.0, 2, **k).alias("n")).collect()]
    assert of("binomial") == [5, 4, 4, 4] and of("balanced") == [5, 5, 0, 0]
    assert of("hybrid", shape="fixed") == [of("geometric", shape="fixed")[0], 4, 4, 4]
    assert of("geometric", shape="linear")[2:] == [0, 0]


def test_tuners():
    best, score = tuning.coordinate_descent(lambda s: -((s[0] - 7) ** 2) - (s[1] - 3) ** 2, (1, 9), [(1, 10), (1, 10)])
    assert best == (7, 3) and score == 0
    x, y = tuning.simplex(lambda p: (p[0] - 2) ** 2 + (p[1] + 1) ** 2, np.array([[0, 0], [5, 0], [0, 5]]), np.array([-5, 0]), np.array([5, 5]))
    assert abs(x[0] - 2) < 1e-2 and x[1] == 0 and abs(y - 1) < 1e-3


def test_ownership_json_of_all_locations(spark):
    rows = [("A", k % 4, k * 150, k * 150 + 150) for k in range(100)] + [("A", 0, 100, 160), ("N", 1, 40000, 40001)]
    got = {(r["rank"], r["item"]): json.loads(r["json"]) for r in locations.ownership_json(spark.createDataFrame(rows, "item string, rank int, lo long, hi long")).collect()}
    want = {(r, "A"): [(k * 150, k * 150 + 150) for k in range(r, 100, 4)] for r in range(4)} | {(1, "N"): [(40000, 40001)]}
    want[0, "A"][0] = (0, 160)
    assert {k: [(*b["from"], *b["to"]) for b in v["region"]] for k, v in got.items()} == want


def test_halo_of_tiles_without_their_first_event(spark, tmp_path):
    spark.createDataFrame([(7,), (99,), (100,), (250,), (260,), (1999,)], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted(tuple(r) for r in Q["q_region_halo"](spark, str(tmp_path)).select("tile", "lo_x", "hi_x", "lo_y", "hi_y").collect())
    assert got == [(0, 0, 12, 0, 12), (1, 8, 22, 0, 12), (2, 18, 32, 0, 12), (19, 88, 100, 8, 22)]


def test_sinks(spark, tmp_path):
    nodes = Q["q_tree_nodes"](spark, DATA).where("heap < 4")
    edges = Q["q_tree_edges"](spark, DATA).where("child < 4")
    lines = [r["value"] for r in sinks.graph_lines(nodes, edges).collect()]
    assert lines[0] == "digraph tasks {" and lines[-1] == "}" and lines[-2] == '  "1" -> "3";' and len(lines) == 7
    cells = spark.createDataFrame([(1, 0, 2.0), (0, 1, 0.5)], "rank int, sample long, value double")
    sinks.write_lines(sinks.heatmap_lines(cells), str(tmp_path / "h"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "h")).collect()] == ["0 1 0.500000", "1 0 2.000000"]
    sinks.snapshot_csv(spark.createDataFrame([(0, 1, 2, 3, 9)], "frame int, x long, y long, z long, n long"), str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).first().asDict() == {"t": "0", "x": "1", "y": "2", "z": "3", "density": "9"}


def test_json_frames(spark):
    r = scheduling.framed(spark.createDataFrame([("é{}",)], "json string")).first()
    assert bytes(r["frame"]) == struct.pack(">Q", 4) + "é{}".encode()


def test_stream_report_of_runs_without_time(spark, tmp_path):
    """The rate of a run of no seconds is infinite, in SQL as here; null and NaN times stay what they are."""
    inf, nan = math.inf, math.nan
    rows = [(1, "zero", 0.0), (2, "zero", 2.0), (1, "minus", -0.0), (1, "null", None), (1, "some", None), (2, "some", 0.5), (1, "nan", nan), (10, "first", 0.0), (11, "first", 4.0), (-3, "negative", 0.0)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = Q["q_stream_report"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    same(got, con, registry.oracle_sql()["q_stream_report"])
    rate = {r["kernel"]: r["best_rate"] for r in got.collect()}
    assert rate["zero"] == inf and rate["minus"] == -inf and rate["null"] is None and rate["first"] == 0.004096
    assert rate["some"] == 0.032768 and math.isnan(rate["nan"]) and "negative" not in rate
