"""Jacobians against finite differences, the spline's limits, the solver on a world with a known answer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marram.operators import factor_math as fm
from marram.operators import lie, segmented, solve
from marram.operators.alignment import similarity
from marram.operators.cleaning import smoothing_spline, spline_at

RNG = np.random.default_rng(0)


def pose(n=20):
    return lie.so3_exp(RNG.uniform(-1.7, 1.7, (n, 3))), RNG.uniform(-3, 3, (n, 3))


def test_exp_and_log_invert():
    x = RNG.uniform(-1.5, 1.5, (50, 6))
    r, t = lie.se3_exp(x)
    assert np.allclose(lie.se3_log(r, t), x, atol=1e-9)
    assert np.allclose(lie.rotation_of(lie.quat_of(r)), r)
    assert np.allclose(lie.so3_log(lie.so3_exp(np.array([[1e-12, 0, 0], [0, np.pi - 1e-7, 0]]))), [[1e-12, 0, 0], [0, np.pi - 1e-7, 0]], atol=1e-6)


@pytest.mark.parametrize("arm", [False, True])
@pytest.mark.parametrize("bias", [0.0, 0.11])
def test_range_jacobians(arm, bias):
    (ra, pa), (rb, pb) = pose(), pose()
    z, anchor = RNG.uniform(1, 5, 20), RNG.uniform(-3, 3, (20, 3))
    la, lb = (RNG.uniform(-0.2, 0.2, (20, 3)) if arm else None for _ in range(2))
    e, j = fm.anchor_range(ra, pa, anchor, z, bias, la)
    assert np.allclose(j, fm.numeric(lambda r, p: fm.anchor_range(r, p, anchor, z, bias, la)[0], ra, pa)[:, 0], atol=1e-4)
    _, ja, jb = fm.inter_range(ra, pa, rb, pb, z, bias, la, lb)
    assert np.allclose(ja, fm.numeric(lambda r, p: fm.inter_range(r, p, rb, pb, z, bias, la, lb)[0], ra, pa)[:, 0], atol=1e-4)
    assert np.allclose(jb, fm.numeric(lambda r, p: fm.inter_range(ra, pa, r, p, z, bias, la, lb)[0], rb, pb)[:, 0], atol=1e-4)
    if not arm:
        assert np.allclose(e, np.linalg.norm(pa - anchor, axis=1) - z + bias, atol=1e-9)


def test_height_and_gravity():
    r, p = pose()
    assert np.allclose(fm.height(r, p, np.ones(20))[1], fm.numeric(lambda r, p: fm.height(r, p, np.ones(20))[0], r, p)[:, 0], atol=1e-6)
    up = r[:, 2, :]
    assert np.allclose(fm.gravity(r, up), 0, atol=1e-12)
    tilted = r @ lie.so3_exp(np.array([0.1, 0.0, 0.0]))
    seen = np.arccos(np.clip((tilted[:, 2, :] * up).sum(axis=1), -1, 1))
    assert np.allclose(np.linalg.norm(fm.gravity(tilted, up), axis=1), np.sin(seen), atol=1e-9)


def test_spline_limits():
    t = np.sort(RNG.uniform(0, 10, 40))
    y = np.sin(t) + RNG.normal(0, 0.1, 40)
    level, curve = smoothing_spline(t, y, 1.0)
    assert np.allclose(level, y) and np.allclose(spline_at(t, level, curve, t), y)
    line = np.polyval(np.polyfit(t, y, 1), t)
    assert np.allclose(smoothing_spline(t, y, 1e-10)[0], line, atol=1e-4)
    straight, bent = smoothing_spline(t, 3 * t + 1, 0.5)
    assert np.allclose(straight, 3 * t + 1) and np.allclose(bent, 0, atol=1e-9)
    assert smoothing_spline(t[:2], y[:2], 0.5)[0].tolist() == y[:2].tolist()


def test_similarity_recovers_a_transform():
    src = RNG.normal(size=(30, 3))
    r = lie.so3_exp(np.array([0.4, -0.7, 1.1]))
    dst = 1.7 * src @ r.T + np.array([1.0, 2.0, 3.0])
    sums = {c: float(v) for c, v in zip(("sx", "sy", "sz", "dx", "dy", "dz"), np.r_[src.sum(0), dst.sum(0)], strict=True)}
    for i, a in enumerate(("sx", "sy", "sz")):
        sums[a + a] = float((src[:, i] ** 2).sum())
        for j, b in enumerate(("dx", "dy", "dz")):
            sums[a + b] = float((src[:, i] * dst[:, j]).sum())
    scale, quaternion, shift = similarity(sums, 30, True)
    assert np.isclose(scale, 1.7) and np.allclose(lie.rotation_of(quaternion), r) and np.allclose(shift, [1, 2, 3])


@pytest.mark.parametrize("mirrored", [False, True])
def test_similarity_is_a_rotation_and_the_best_one(mirrored):
    src = RNG.normal(size=(40, 3))
    dst = src @ lie.so3_exp(np.array([0.2, 0.5, -0.4])).T + RNG.normal(0, 0.3, (40, 3))
    if mirrored:
        dst[:, 2] *= -1
    sums = {c: float(v) for c, v in zip(("sx", "sy", "sz", "dx", "dy", "dz"), np.r_[src.sum(0), dst.sum(0)], strict=True)}
    sums |= {f"{a}{b}": float((src[:, i] * dst[:, j]).sum()) for i, a in enumerate(("sx", "sy", "sz")) for j, b in enumerate(("dx", "dy", "dz"))}
    sums |= {a + a: float((src[:, i] ** 2).sum()) for i, a in enumerate(("sx", "sy", "sz"))}
    _, q, shift = similarity(sums, 40, False)
    error = lambda r, t: ((src @ r.T + t - dst) ** 2).sum()
    best = lie.rotation_of(q)
    assert np.isclose(np.linalg.det(best), 1)
    for _ in range(50):
        r = best @ lie.so3_exp(RNG.normal(0, 0.1, 3))
        assert error(best, shift) <= error(r, (dst - src @ r.T).mean(0)) + 1e-9


def test_banded_solver_against_dense():
    from marram.operators.banded import five_diagonals

    for m in (1, 2, 3, 63, 64, 65, 200):
        a = np.stack([RNG.uniform(4, 5, m), RNG.uniform(-1, 1, m), RNG.uniform(-1, 1, m)])
        dense = np.diag(a[0]) + sum(np.diag(a[k, : m - k], k) + np.diag(a[k, : m - k], -k) for k in (1, 2) if m > k)
        b = RNG.normal(size=m)
        assert np.allclose(five_diagonals(a, b), np.linalg.solve(dense, b))


def test_spline_query_against_dense_normal_equations(spark, small_dir):
    """The registered query's rows against the same minimum found with dense matrices."""
    from marram.plans import association
    from marram.plans.registry import events

    got = {}
    for r in association.smoothing_spline(spark, small_dir).collect():
        got.setdefault(r["user_id"], []).append((r["t"], r["value"]))
    rows = {}
    for r in events(spark, small_dir).collect():
        rows.setdefault(r["user_id"], []).append((r["t"] / 1e6, r["value"]))
    assert got.keys() == rows.keys()
    for user, raw in rows.items():
        raw.sort(key=lambda r: r[0])
        t, y = (np.array(v) for v in zip(*raw, strict=True))
        if len(t) < 3 or len(set(t)) < len(t):
            continue
        h, m = np.diff(t), len(t) - 2
        q, r = np.zeros((len(t), m)), np.zeros((m, m))
        for k in range(m):
            q[k : k + 3, k] = 1 / h[k], -1 / h[k] - 1 / h[k + 1], 1 / h[k + 1]
            r[k, k] = (h[k] + h[k + 1]) / 3
            if k + 1 < m:
                r[k, k + 1] = r[k + 1, k] = h[k + 1] / 6
        lam = (1 - 0.9999) / 0.9999
        want = y - lam * q @ np.linalg.solve(r + lam * q.T @ q, q.T @ y)
        assert np.allclose([v for _, v in sorted(got[user])], want, rtol=1e-6, atol=1e-6)


def test_cholesky_and_marginals_against_dense():
    n = 8
    a = RNG.normal(size=(6 * n, 6 * n))
    dense = np.zeros((6 * n, 6 * n))
    for i in range(n):
        for j in range(max(0, i - 2), i + 1):
            dense[6 * i : 6 * i + 6, 6 * j : 6 * j + 6] = a[6 * i : 6 * i + 6, 6 * j : 6 * j + 6] * 0.1
    dense = dense + dense.T + 6 * np.eye(6 * n)
    blocks = {(j, i): dense[6 * j : 6 * j + 6, 6 * i : 6 * i + 6] for i in range(n) for j in range(max(0, i - 2), i + 1)}
    factor = solve.BlockCholesky(blocks, list(range(n)))
    rhs = RNG.normal(size=6 * n)
    x = factor.solve({i: rhs[6 * i : 6 * i + 6] for i in range(n)})
    assert np.allclose(np.concatenate([x[i] for i in range(n)]), np.linalg.solve(dense, rhs))
    inverse = np.linalg.inv(dense)
    for i, m in factor.marginals().items():
        assert np.allclose(m, inverse[6 * i : 6 * i + 6, 6 * i : 6 * i + 6])


def world(spark, outliers):
    """Six poses on a curve, five anchors, exact odometry, exact ranges but for ``outliers`` of them."""
    n = 6
    p = np.stack([np.linspace(0, 2, n), np.sin(np.linspace(0, 2, n)), np.linspace(1, 1.4, n)], axis=1)
    r = lie.so3_exp(np.stack([np.zeros(n), np.linspace(0, 0.1, n), np.linspace(0, 1, n)], axis=1))
    anchors = np.array([[-3, -3, 0.5], [3, -3, 2.5], [3, 3, 0.5], [-3, 3, 2.5], [0, 0, 3.0]])
    q = lie.quat_of(r)
    rows = []
    for i in range(n - 1):
        dr, dt = lie.between(r[i : i + 1], p[i : i + 1], r[i + 1 : i + 2], p[i + 1 : i + 2])
        rows.append(("odometry", i, i + 1, [*map(float, dt[0]), *map(float, lie.quat_of(dr)[0])], None, None, None, [0.02] * 6, 0.0, None))
    k = 0
    for i in range(n):
        for a in anchors:
            k += 1
            z = float(np.linalg.norm(p[i] - a)) + (1.5 if k in outliers else 0.0)
            rows.append(("anchor_range", i, None, [z], list(map(float, a)), None, None, [0.1], 1.5, None))
    rows.append(("pose_prior", 0, None, [*map(float, p[0]), *map(float, q[0])], None, None, None, [0.05] * 6, 0.0, None))
    start = [(i, *(p[i] + RNG.normal(0, 0.1, 3)).tolist(), *lie.quat_of(r[i : i + 1] @ lie.so3_exp(RNG.normal(0, 0.05, (1, 3))))[0].tolist()) for i in range(n)]
    return p, spark.createDataFrame(rows, solve.FACTOR), spark.createDataFrame(start, solve.NODE)


def test_solver_finds_a_clean_world(spark):
    p, factors, nodes = world(spark, ())
    found = segmented.optimise(factors, nodes, with_marginals=True)
    at = np.array([[r["x"], r["y"], r["z"]] for r in found.nodes.orderBy("id").collect()])
    assert found.cost < 1e-8 < found.first_cost and np.abs(at - p).max() < 1e-4
    assert all(np.linalg.eigvalsh(m).min() > 0 for m in [np.array(r["covariance"]).reshape(6, 6) for r in found.nodes.collect()])


def test_groups_are_solved_as_one_by_one(spark):
    p, factors, nodes = world(spark, (3,))
    whole = segmented.optimise(factors, nodes, with_marginals=True)
    twice = lambda df: df.withColumn("g", F.lit("a")).unionByName(df.withColumn("g", F.lit("b")))
    rows = solve.optimise_groups(twice(factors), twice(nodes).unionByName(nodes.limit(1).withColumn("g", F.lit("c"))), ["g"], with_marginals=True).collect()
    want = {r["id"]: r for r in whole.nodes.collect()}
    assert {r["g"] for r in rows} == {"a", "b", "c"} and len(rows) == 13
    for r in rows:
        if r["g"] != "c":
            assert np.allclose([r[c] for c in "xyz"], [want[r["id"]][c] for c in "xyz"], atol=1e-6) and np.isclose(r["cost"], whole.cost, atol=1e-9)
            assert np.allclose(np.array(r["covariance"]).reshape(6, 6), np.array(want[r["id"]]["covariance"]).reshape(6, 6), atol=1e-9)
        else:
            assert r["covariance"] is None and r["rounds"] == 0


def test_a_groups_constraints_are_linearised_in_bounded_memory(monkeypatch):
    """200,000 ranges to 20,000 poses: the blocks and one chunk of constraints, not all of them at once."""
    import tracemalloc

    import pyarrow as pa

    n, each = 20_000, 10
    ids = np.arange(n) * 3
    a = np.repeat(ids, each)
    anchors = RNG.uniform(-3, 3, (len(a), 3))
    none = pa.nulls(len(a), pa.list_(pa.float64()))
    column = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * (v.size // len(a))), pa.array(v.ravel()))
    link = pa.nulls(len(a), pa.int64())
    rows = pa.table({"kind": ["anchor_range"] * len(a), "a": a, "b": link, "c": link, "meas": column(np.ones(len(a))), "point": column(anchors), "arm_a": none, "arm_b": none, "sigma": column(np.full(len(a), 0.1)), "huber": np.zeros(len(a))})
    state = np.concatenate([RNG.uniform(-1, 1, (n, 3)), np.tile([0.0, 0.0, 0.0, 1.0], (n, 1))], axis=1)
    constraints = solve.Constraints(rows, ids)
    tracemalloc.start()
    h, g, cost = constraints.system(state)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    d = np.repeat(state[:, :3], each, axis=0) - anchors
    assert cost == pytest.approx(0.5 * (((np.linalg.norm(d, axis=1) - 1) / 0.1) ** 2).sum())
    monkeypatch.setattr(solve, "LINEAR_ROWS", 77_777)
    h2, g2, cost2 = constraints.system(state)
    assert np.allclose(h, h2) and np.allclose(g, g2) and cost == pytest.approx(cost2)


def test_pose_marginals_against_a_dense_inverse(spark, small_dir):
    """The registered query's covariances against the inverse of the whole information matrix."""
    from marram.plans import estimation

    got = {r["id"]: r for r in estimation.pose_marginals(spark, small_dir).collect()}
    nodes, factors = estimation._chain(spark, small_dir)
    label = nodes.groupBy("label").count().orderBy("count").first()["label"]
    solved = solve.optimise_groups(factors, nodes, ["label"]).where(F.col("label") == label)
    h, _, _ = solve.normal_equations(factors.where(F.col("label") == label).drop("label"), solved)
    ids = sorted({i for i, _ in h})
    dense = np.zeros((6 * len(ids),) * 2)
    for (i, j), m in h.items():
        a, b = 6 * ids.index(i), 6 * ids.index(j)
        dense[a : a + 6, b : b + 6] = m
        dense[b : b + 6, a : a + 6] = m.T
    values, vectors = np.linalg.eigh(dense)
    inverse = (vectors / values) @ vectors.T
    for k, i in enumerate(ids):
        assert np.allclose(np.array(got[i]["sigma_pos"]).reshape(3, 3), inverse[6 * k + 3 : 6 * k + 6, 6 * k + 3 : 6 * k + 6], rtol=1e-5, atol=1e-9)


def test_robust_beats_plain_with_outliers(spark):
    p, factors, nodes = world(spark, (3, 17))
    error = []
    for rows in (factors, factors.withColumn("huber", F.lit(0.0))):
        at = np.array([[r["x"], r["y"], r["z"]] for r in segmented.optimise(rows, nodes).nodes.orderBy("id").collect()])
        error.append(np.abs(at - p).max())
    assert error[0] < error[1]


def test_multilateration(spark):
    anchors = np.array([[-3, -3, 0.5], [3, -3, 2.5], [3, 3, 0.5], [-3, 3, 2.5], [0, 0, 3.0]])
    truth = RNG.uniform(-2, 2, (5, 3))
    rows = [(i, *map(float, a), float(np.linalg.norm(t - a)), 0.1) for i, t in enumerate(truth) for a in anchors]
    out = solve.multilaterate(spark.createDataFrame(rows, "id long, ax double, ay double, az double, z double, sigma double"), ["id"]).orderBy("id").collect()
    assert np.allclose([[r["x"], r["y"], r["z"]] for r in out], truth, atol=1e-6)


def test_multilateration_leaves_local_minima(spark):
    """Exact ranges fit one point only; from the mean of the anchors alone the descent ended at costs of 385 and 53."""
    anchors = np.array([[-3, -3, 0.5], [3, -3, 2.5], [3, 3, 0.5], [-3, 3, 2.5], [0, 0, 3.0]])
    truth = np.array([[-1.30676, 0.87386, 5.25111], [2.85174, 3.0784, 1.98718], [0.4, -0.7, 1.1]])
    rows = [(i, *map(float, a), float(np.linalg.norm(t - a)), 0.1) for i, t in enumerate(truth) for a in anchors[: 4 if i == 2 else 5]]
    out = solve.multilaterate(spark.createDataFrame(rows, "id long, ax double, ay double, az double, z double, sigma double"), ["id"]).orderBy("id").collect()
    assert np.allclose([[r["x"], r["y"], r["z"]] for r in out], truth, atol=1e-6)
    assert max(r["cost"] for r in out) < 1e-9
