"""Ties, traps and orders that the tables do not exercise by themselves."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marram.operators import cleaning, constraints, maps, ranks, voxels
from marram.operators.asof import nearest_asof
from marram.operators.voxels import CELL, Occupancy

LEFT, RIGHT = "k string, t long, q int", "k string, r long, n int"


@pytest.mark.parametrize("slot", [None, 10, 3])
def test_asof_ties_tolerance_and_slots(spark, slot):
    right = [("a", 0, 1), ("a", 10, 2), ("a", 10, 3), ("a", 90, 4), ("b", 5, 5)]
    left = [("a", 5, 1), ("a", 10, 2), ("a", 13, 3), ("a", 50, 4), ("a", 51, 5), ("a", -9, 6), ("a", 200, 7), ("c", 1, 8), ("b", None, 9)]
    out = nearest_asof(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], "t", "r", ["n"], None, slot, "n")
    assert {r["q"]: (r["n"], r["gap"]) for r in out.collect()} == {1: (1, 5), 2: (2, 0), 3: (2, 3), 4: (2, 40), 5: (4, 39), 6: (1, 9), 7: (4, 110)}
    near = nearest_asof(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], "t", "r", ["n"], 5, slot, "n")
    assert {r["q"] for r in near.collect()} == {1, 2, 3}


def test_dedup_comes_before_the_quality_bound(spark):
    parts = [spark.createDataFrame([(1, 0.9)], "k int, std double"), spark.createDataFrame([(1, 0.1), (2, 0.5), (3, float("nan"))], "k int, std double")]
    assert [r["k"] for r in cleaning.union_ranges(parts, ["k"], "std", 0.5).collect()] == [2]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.floats(-3, 3, allow_nan=False), min_size=1, max_size=40))
def test_fold_equals_the_loop_in_chunks_too(spark, values):
    c = Occupancy()
    level = 0.0
    for v in values:
        level = max(c.low, min(c.high, level + v))
    rows = spark.createDataFrame([(0, 0, 0, i, v) for i, v in enumerate(values)], "ix long, iy long, iz long, o long, v double").orderBy(F.rand(1))
    plain = voxels.clamped_fold(rows, list(CELL), "o", "v", c).first()["l"]
    parts = voxels.clamped_fold(rows, list(CELL), "o", "v", c, 7).first()["l"]
    assert plain == level and math.isclose(parts, level, abs_tol=1e-12)


def march(o, e, res):
    """Cell by cell, the nearest plane next."""
    cell, end = np.floor(o / res).astype(int), np.floor(e / res).astype(int)
    out = []
    while (cell != end).any():
        t = [((cell[k] + (end[k] > cell[k])) * res - o[k]) / (e[k] - o[k]) if cell[k] != end[k] else math.inf for k in range(3)]
        k = int(np.argmin(t))
        cell[k] += 1 if end[k] > cell[k] else -1
        if (cell != end).any():
            out.append(tuple(int(x) for x in cell))
    return out


def test_rays_equal_a_march(spark):
    rng = np.random.default_rng(3)
    ends = rng.uniform(-2, 2, (60, 6))
    ends[0] = [0.1, 0.1, 0.1, 1.7, 0.1, 0.1]
    ends[1, 3:] = ends[1, :3]
    ends[2] = [0.05, 0.05, 0.05, 1.05, 1.05, 1.05]
    ends[3] = [-0.3, 0.2, 0.9, -0.3, 0.2, -1.4]
    names = ["ox", "oy", "oz", "px", "py", "pz"]
    rays = spark.createDataFrame([(i, *map(float, e)) for i, e in enumerate(ends)], "id int, " + ", ".join(f"{n} double" for n in names))
    got: dict[int, list] = {}
    for r in voxels.crossed_cells(rays, ["id"], tuple(names[:3]), tuple(names[3:]), 0.1).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append((r["ix"], r["iy"], r["iz"]))
    for i, e in enumerate(ends):
        want = march(e[:3], e[3:], 0.1)
        l1 = int(np.abs(np.floor(e[3:] / 0.1) - np.floor(e[:3] / 0.1)).sum())
        assert got.get(i, []) == want and len(want) == max(0, l1 - 1)


def test_uniform_equals_weighted_without_uncertainty(spark):
    pts = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 0.3, 0.2, 0.0, 0.0), (0, 0.0, 0.0, 0.0, 0.05, 0.0, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0, 9.0, 0.0, 0.0, 0.0, 0.0)], "f int, ox double, oy double, oz double, px double, py double, pz double, tr double, sigma_z double")
    out = [sorted(map(tuple, voxels.frame_evidence(voxels.integrate(pts, Occupancy(weighted=w), ["f"], ("ox", "oy", "oz"), ("px", "py", "pz")), ["f"]).collect())) for w in (True, False)]
    assert out[0] == out[1] and {r[0] for r in out[0]} == {0}
    others = F.array(F.struct(F.lit(1.0).alias("x"), F.lit(0.3).alias("y"), F.lit(0.2).alias("z")))
    masked = voxels.integrate(pts.withColumn("mates", others), Occupancy(), ["f"], ("ox", "oy", "oz"), ("px", "py", "pz"), "mates").collect()
    assert masked and all(r["value"] < 0 for r in masked)


def test_spread_keeps_its_mass_and_stops_below_half_a_cell(spark):
    rows = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.3, 0.85), (1, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.049, 0.85), (2, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.05, 0.85)], "id int, ox double, oy double, oz double, px double, py double, pz double, s double, v double")
    out = voxels.spread_endpoints(rows, ["id"], ("ox", "oy", "oz"), ("px", "py", "pz"), "s", "v", 0.1)
    got = {r["id"]: (r["n"], r["total"]) for r in out.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).collect()}
    assert all(math.isclose(t, 0.85) for _, t in got.values()) and got[0][0] == 13 and got[1][0] == 1 and got[2][0] == 3


def test_nan_is_never_valid(spark):
    z, _ = voxels.depth(F.col("d"), 20.0)
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (0.0,), (-1.0,), (10.0,), (None,)], "d double")
    assert [r["z"] for r in rows.select(z.alias("z")).collect()] == [None, None, None, None, 2.0, None]
    assert [r["c"] for r in spark.createDataFrame([(float("nan"),), (0.85,), (0.86,), (-0.5,)], "l double").select(maps.classify(F.col("l")).alias("c")).collect()] == ["unknown", "unknown", "occupied", "free"]


def test_raster_truncates_towards_zero(spark):
    rows = spark.createDataFrame([(-2.1, 0.0, 0.0, "free"), (-1.9, 0.1, 0.0, "occupied"), (-2.6, 0.0, 0.0, "free"), (0.0, 0.0, 1.0, "free")], "x double, y double, z double, label string")
    assert [(r["gx"], r["gy"], r["label"]) for r in maps.raster(rows, [], 0.0, 1.0, 0.5, (-2.0, 2.0, -2.0, 2.0)).collect()] == [(0, 4, 1)]


def test_gauge_follows_the_configuration(spark):
    def targets(ids, **c):
        entities = spark.createDataFrame([(i,) for i in ids], "id int")
        return sorted(r["id"] for r in constraints.gauge_entities(entities, constraints.Config(**c)).collect())

    assert targets([0, 1, 2]) == []
    assert targets([0, 1, 2], use_anchor=False) == [0]
    assert targets([0, 1, 2], use_anchor=False, inter_pairs=()) == [0, 1, 2]
    assert targets([0, 1, 2], use_anchor=False, inter_pairs=((0, 1), (1, 7))) == [0, 2]
    assert targets([1, 2], anchor_robots=(2,), inter_pairs=()) == [1]
    assert targets([0, 1, 2], anchor_robots=(2,), start="first_pose") == [0, 1]
    assert targets([0, 1, 2], anchor_robots=(1,), use_inter=False) == [0, 2]


def test_thinning_positions(spark):
    rows = spark.range(1000).orderBy(F.rand(2))
    for most in (2, 7, 400, 999):
        want = sorted(set(np.linspace(0, 999, most).astype(int).tolist()))
        assert sorted(r["id"] for r in maps.thinned(rows, most, ["id"]).collect()) == want


def test_noise_depends_on_the_row_alone(spark):
    rows = spark.createDataFrame([(float(i), 1, i % 15, 2.0, "anchor" if i % 15 < 10 else "inter") for i in range(400)], "timestamp double, from_id int, to_id int, gt_range double, kind string")
    z = cleaning.injected_range(F.col("gt_range"), F.col("kind"), F.concat_ws("|", "timestamp", "from_id", "to_id"), 0.2)
    a, b = (sorted(map(tuple, r.select("*", z.alias("z")).collect())) for r in (rows, rows.repartition(5)))
    assert a == b and len({r[-1] for r in a}) > 300


@pytest.mark.parametrize("slot", [None, 10])
def test_asof_drops_unknown_entities(spark, slot):
    left = spark.createDataFrame([("a", 5, 1), (None, 5, 2)], LEFT)
    right = spark.createDataFrame([("a", 6, 1), (None, 5, 2)], RIGHT)
    assert [r["q"] for r in nearest_asof(left, right, ["k"], "t", "r", ["n"], None, slot).collect()] == [1]


def jumps(rows, far):
    """The state machine, row by row."""
    bad, good = [False] * len(rows), rows[0] if rows else None
    for i in range(1, len(rows)):
        if far(rows[i], good):
            bad[i - 1] = bad[i] = True
        else:
            good = rows[i]
    return bad


def test_outliers_equal_the_loop_across_batches(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k, n in ((0, 700), (1, 1), (2, 300), (None, 90)):
        v = np.cumsum(rng.normal(0, 1, n)) + rng.choice([0, 0, 0, 30], n)
        v[n // 2 : n // 2 + 40] += 100  # a long stretch that is far from the last good row
        rows += [(k, i, float(x)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "k int, o int, v double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {}
        for r in cleaning.jump_outliers(df, ["k"], "o", "v", 5.0).orderBy("o").collect():
            got.setdefault(r["k"], []).append(r["flagged"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in (0, 1, 2, None):
        assert got[k] == jumps([v for kk, _, v in rows if kk == k], lambda a, b: abs(a - b) > 5.0)


def test_ranks_and_quantiles(spark):
    rng = np.random.default_rng(1)
    values = np.round(rng.gamma(2.0, 3.0, 20_000), 2)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id int, v double").repartition(5)
    got = {r["id"]: r["pos"] for r in ranks.ranked(rows, ["v", "id"]).collect()}
    order = sorted(range(len(values)), key=lambda i: (values[i], i))
    assert [got[i] for i in order] == list(range(len(values)))
    shares = [0.0, 0.01, 0.37, 0.5, 0.97, 1.0]
    for small in (10**6, 50):  # by one aggregate, and by narrowing brackets
        assert np.allclose(ranks.quantiles(rows, F.col("v"), shares, small), np.quantile(values, shares), atol=1e-12)
    assert ranks.quantiles(rows.where("false"), F.col("v"), [0.5]) == [None]
    assert sorted(r["id"] for r in cleaning.every_kth(rows, 7, [], ["id"]).collect()) == list(range(0, 20_000, 7))


def test_pixels_are_thinned_after_frames_are_judged(spark):
    rows = [(f, u, v, (u + v) % (2 + f) == 0) for f in range(3) for u in range(12) for v in range(12)]
    df = spark.createDataFrame(rows, "f int, u int, v int, ok boolean")
    got = voxels.sampled_frames(df, ["f"], F.col("ok"), "v", "u", 48, 4).collect()
    assert {r["f"] for r in got} == {0, 1} and all(r["u"] % 4 == 0 and r["v"] % 4 == 0 for r in got)


RAYS = "f int, ox double, oy double, oz double, px double, py double, pz double, tr double, sigma_z double, s array<double>"


def test_pose_uncertainty_modes(spark):
    flat = [0.04, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    pts = spark.createDataFrame([(0, 0.01, 0.01, 0.01, 2.01, 0.01, 0.01, 0.04, 0.0, flat), (1, 0.01, 0.01, 0.01, 0.01, 2.01, 0.01, 0.0, 0.0, flat)], RAYS)

    def run(**c):
        rows = voxels.integrate(pts, Occupancy(use_pose_weight=False, **c), ["f"], ("ox", "oy", "oz"), ("px", "py", "pz"), covariance="s")
        out = {0: {}, 1: {}}
        for r in voxels.frame_evidence(rows, ["f"]).collect():
            out[r["f"]][(r["ix"], r["iy"], r["iz"])] = r["value"]
        return out

    plain, scale, cut, spread = run(), run(free_mode="scale"), run(free_mode="truncate", truncate_sigmas=2.0), run(spread=True)
    # The second ray is across the uncertain axis, its frame has no trace: nothing changes it.
    assert all(math.isclose(m[1][c], v) for m in (scale, cut, spread) for c, v in plain[1].items()) and all(len(m[1]) == len(plain[1]) for m in (scale, cut, spread))
    assert len(plain[0]) == 20 and math.isclose(scale[0][(5, 0, 0)], -0.4 * math.exp(-4)) and scale[0][(20, 0, 0)] == 0.85
    assert len(cut[0]) == 16 and (15, 0, 0) in cut[0] and (16, 0, 0) not in cut[0]
    assert math.isclose(sum(v for v in spread[0].values() if v > 0), 0.85, rel_tol=1e-9) and min(c[0] for c, v in spread[0].items() if v > 0) == 16
    with pytest.raises(ValueError):
        voxels.integrate(pts, Occupancy(free_mode="scale"), ["f"], ("ox", "oy", "oz"), ("px", "py", "pz"))
    with pytest.raises(ValueError):
        run(free_mode="else")
    counts = voxels.frame_counts(pts.select("f").unionAll(spark.range(2).select(F.lit(9))), pts, Occupancy(max_ray=1.0), ("ox", "oy", "oz"), ("px", "py", "pz")).first()
    assert tuple(counts) == (4, 0)
