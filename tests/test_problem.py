"""A small world from logs to a solution."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marram.operators import constraints, problem, segmented, solve
from marram.operators.lie import quat_of, rotation_of, so3_exp

ANCHORS = [(0, -4.0, -4.0, 0.5), (1, 4.0, -4.0, 2.5), (2, 4.0, 4.0, 0.5), (3, -4.0, 4.0, 2.5)]


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(4)
    t = np.arange(0, 2, 0.25)
    truth, tracks, ranges = [], [], []
    at = {}
    for k in range(2):
        p = np.stack([np.cos(t + k), np.sin(t + k), 1 + 0.1 * t], axis=1)
        r = so3_exp(np.stack([0 * t, 0 * t, t / 2 + k], axis=1))
        at[k] = p
        yaw = so3_exp(np.array([0.0, 0.0, 0.3 + k]))
        for s, x, m in zip(t, p, r, strict=True):
            truth.append((k, float(s), *map(float, x)))
            moved = yaw.T @ (x - np.array([1.0, -2.0, 0.5]))
            tracks.append((k, float(s), *map(float, moved), *map(float, quat_of(yaw.T @ m)), 1.0))
    for i, s in enumerate(t):
        for k in range(2):
            for a, *xyz in ANCHORS:
                z = float(np.linalg.norm(at[k][i] - np.array(xyz)))
                ranges.append((float(s) + 0.01, 10 * (k + 1), a, z + 0.14, 0.1, z, "anchor"))
        z = float(np.linalg.norm(at[0][i] - at[1][i]))
        ranges.append((float(s), 10, 20, z + 0.14 + float(rng.normal(0, 0)), 0.1, z, "inter"))
    ranges.append((50.0, 10, 0, 1.0, 0.1, 1.0, "anchor"))
    make = spark.createDataFrame
    return (
        at,
        make(tracks, "robot int, t double, x double, y double, z double, qx double, qy double, qz double, qw double, v double"),
        make(truth, "robot int, t double, x double, y double, z double"),
        make(ranges, "timestamp double, from_id int, to_id int, range double, std double, gt_range double, kind string"),
        make(ANCHORS, "id int, x double, y double, z double"),
    )


def test_clean_world_is_solved(spark, world):
    at, tracks, truth, ranges, anchors = world
    made = problem.build(tracks, truth, ranges, anchors)
    assert {r["kind"]: r["n"] for r in made.stats.collect()} == {"odometry": 14, "anchor_range": 64, "native_range": 8, "gravity": 16}
    found = segmented.optimise(made.factors, made.nodes, F.floor(F.col("t") / 3), F.col("t"), fan=2)
    assert found.cost < 1e-6
    got = np.array([[r["x"], r["y"], r["z"]] for r in found.nodes.orderBy("id").collect()])
    assert np.abs(got - np.concatenate([at[0], at[1]])).max() < 1e-3


def test_switches(spark, world):
    _, tracks, truth, ranges, anchors = world
    kinds = lambda **c: {r["kind"]: r["n"] for r in problem.build(tracks, truth, ranges, anchors, constraints.Config(**c)).stats.collect()}
    assert kinds(use_anchor=False, use_gravity=False) == {"odometry": 14, "native_range": 8, "pose_prior": 1}
    assert kinds(use_anchor=False, use_gravity=False, inter_pairs=()) == {"odometry": 14, "pose_prior": 2}
    assert kinds(use_ranges=False, max_odometry_gap=0.1, use_gravity=False) == {"pose_prior": 16}
    assert kinds(anchor_robots=(1,), use_inter=False, use_gravity=False) == {"odometry": 14, "anchor_range": 32, "pose_prior": 1}
    assert kinds(bias_mode="online", use_gravity=False) == {"odometry": 14, "anchor_range": 64, "inter_range": 8, "bias_prior": 2}
    assert kinds(pin_anchors=True, use_gravity=False) == {"odometry": 14, "native_range": 72, "anchor_pin": 4}
    assert kinds(range_every=2, use_gravity=False, max_odometry_gap=0.1)["anchor_range"] == 32
    truth = truth.select("*", *[F.lit(v).alias(c) for c, v in (("qx", 0.0), ("qy", 0.0), ("qz", 0.0), ("qw", 1.0))])
    assert kinds(use_anchor=False, use_gravity=False, start="first_pose") == {"odometry": 14, "native_range": 8, "pose_prior": 2}


def solve_world(spark, world, config, heights=None):
    at, tracks, truth, ranges, anchors = world
    made = problem.build(tracks, truth, ranges, anchors, config, heights=heights)
    one = F.lit(0).alias("run")
    found = solve.optimise_groups(made.factors.select(one, "*"), made.nodes.select(one, "*"), ["run"]).drop("run")
    got = np.array([[r["x"], r["y"], r["z"]] for r in problem.trajectory(found, made.nodes).orderBy("robot", "i").collect()])
    return found, np.abs(got - np.concatenate([at[0], at[1]])).max()


def test_biases_are_solved_for(spark, world):
    # A tight prior at 0 would hold them back; a weak one leaves them to the ranges.
    found, error = solve_world(spark, world, constraints.Config(bias_mode="online", bias_sigma=100.0, range_bias=0.0))
    biases = {r["robot"]: r["bias"] for r in problem.biases(found).collect()}
    assert error < 1e-3 and set(biases) == {0, 1}
    assert all(abs(b - 0.14) < 1e-3 for b in biases.values())
    plain, _ = solve_world(spark, world, constraints.Config())
    assert problem.biases(plain).count() == 0


def test_pinned_anchors_and_true_ranges_and_gauges(spark, world):
    assert solve_world(spark, world, constraints.Config(pin_anchors=True))[1] < 1e-3
    assert solve_world(spark, world, constraints.Config(use_true_range=True, bias_mode="off"))[1] < 1e-3
    assert solve_world(spark, world, constraints.Config(injected={"sigma": 0.0}))[1] < 1e-3
    noisy = [solve_world(spark, world, constraints.Config(injected={"sigma": 0.05, "bias": True, "outlier": True, "seed": s}))[1] for s in (1, 1, 2)]
    assert noisy[0] == pytest.approx(noisy[1], abs=1e-9) and abs(noisy[0] - noisy[2]) > 1e-6 and max(noisy) < 1.0
    heights = world[2].select("robot", "t", F.col("z").alias("h"))
    found, error = solve_world(spark, world, constraints.Config(use_height=True, height_every=2), heights)
    assert error < 1e-3


def test_first_pose_start(spark, world):
    at, tracks, truth, ranges, anchors = world
    whole = truth.join(tracks.select("robot", "t", *[F.col(c) for c in ("qx", "qy", "qz", "qw")]), ["robot", "t"])
    yaw = {0: 0.3, 1: 1.3}
    turned = [(r["robot"], r["t"], r["x"], r["y"], r["z"], *map(float, quat_of(so3_exp(np.array([0.0, 0.0, yaw[r["robot"]]])) @ rotation_of(np.array([r[c] for c in ("qx", "qy", "qz", "qw")]))))) for r in whole.collect()]
    truth = spark.createDataFrame(turned, "robot int, t double, x double, y double, z double, qx double, qy double, qz double, qw double")
    nodes = problem.placed(problem.numbered(tracks), truth, constraints.Config(start="first_pose"))
    got = np.array([[r["x"], r["y"], r["z"]] for r in nodes.orderBy("robot", "i").collect()])
    assert np.abs(got - np.concatenate([at[0], at[1]])).max() < 1e-9
    free = problem.placed(problem.numbered(tracks), truth, constraints.Config(yaw_only=False))
    got = np.array([[r["x"], r["y"], r["z"]] for r in free.orderBy("robot", "i").collect()])
    assert np.abs(got - np.concatenate([at[0], at[1]])).max() < 1e-6


def test_arms_must_be_known(spark, world):
    _, tracks, truth, ranges, anchors = world
    config = constraints.Config(use_moment_arm=True, bias_mode="off")
    arms = spark.createDataFrame([(10, 0.1, 0.0, 0.0), (20, 0.0, 0.1, 0.0)], "id int, x double, y double, z double")
    made = problem.build(tracks, truth, ranges, anchors, config, arms)
    assert {r["kind"] for r in made.stats.collect()} == {"odometry", "gravity", "ma_anchor_range", "ma_inter_range"}
    with pytest.raises(Exception, match="no arm"):
        problem.build(tracks, truth, ranges, anchors, config, arms.where("id = 10")).factors.collect()


def test_quaternion_product_is_rotation_product():
    rng = np.random.default_rng(0)
    a, b = (q / np.linalg.norm(q) for q in rng.normal(size=(2, 4)))
    product = np.array([float(v) for v in problem.multiply(tuple(a), tuple(b))])
    assert np.allclose(rotation_of(product), rotation_of(a) @ rotation_of(b))
