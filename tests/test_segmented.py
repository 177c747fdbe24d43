"""What is too long for one task, cut into pieces, against the same work in one piece."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marram.operators import factor_math as fm
from marram.operators import lie, segmented, solve

RNG = np.random.default_rng(5)


def test_closed_form_jacobians_against_differences():
    n = 30
    pose = lambda: (lie.so3_exp(RNG.normal(0, 1.2, (n, 3))), RNG.normal(0, 2, (n, 3)))
    (ra, pa), (rb, pb) = pose(), pose()
    rm, pm = lie.between(ra, pa, rb @ lie.so3_exp(RNG.normal(0, 0.3, (n, 3))), pb + RNG.normal(0, 0.3, (n, 3)))
    e = fm.odometry(ra, pa, rb, pb, rm, pm)
    ja, jb = fm.odometry_jacobians(e, ra, pa, rb, pb)
    assert np.allclose(ja, fm.numeric(lambda r, p: fm.odometry(r, p, rb, pb, rm, pm), ra, pa), atol=1e-6)
    assert np.allclose(jb, fm.numeric(lambda r, p: fm.odometry(ra, pa, r, p, rm, pm), rb, pb), atol=1e-6)
    assert np.allclose(lie.inverse_right_jacobian(fm.pose_prior(ra, pa, rb, pb)), fm.numeric(lambda r, p: fm.pose_prior(r, p, rb, pb), ra, pa), atol=1e-5)
    up = RNG.normal(size=(n, 3))
    up /= np.linalg.norm(up, axis=1, keepdims=True)
    assert np.allclose(fm.gravity_jacobian(ra, up), fm.numeric(lambda r, p: fm.gravity(r, up), ra, pa), atol=1e-6)
    tiny = RNG.normal(0, 1e-9, (n, 6))
    assert np.allclose(lie.inverse_right_jacobian(tiny), np.eye(6), atol=1e-8)


def fleet(spark, n=48):
    """Two robots with noisy odometry, ranges between them and to anchors, a range bias each, and one pinned anchor."""
    rows, start, t = [], [], np.arange(n) * 0.5
    poses = {}
    for k in (0, 1):
        p = np.stack([np.cos(t / 4 + k), np.sin(t / 5) * 2, 1 + 0.1 * t], axis=1) + k
        r = lie.so3_exp(np.stack([0.05 * np.sin(t), np.zeros(n), t / 6], axis=1))
        poses[k] = r, p
        dr, dt = lie.between(r[:-1], p[:-1], r[1:], p[1:])
        dr, dt = dr @ lie.so3_exp(RNG.normal(0, 0.01, (n - 1, 3))), dt + RNG.normal(0, 0.01, (n - 1, 3))
        for i in range(n - 1):
            rows.append(("odometry", k * 1000 + i, k * 1000 + i + 1, [*dt[i].tolist(), *lie.quat_of(dr[i]).tolist()], None, None, None, [0.01] * 6, 0.0, None))
        for i in range(n):
            q = lie.quat_of(r[i] @ lie.so3_exp(RNG.normal(0, 0.02, 3)))
            start.append((k * 1000 + i, *(p[i] + RNG.normal(0, 0.05, 3)).tolist(), *q.tolist(), float(t[i])))
        start.append((9000 + k, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, None))
        rows.append(("bias_prior", 9000 + k, None, [0.0] * 6 + [1.0], None, None, None, [1e-3, 1e-3, 1e-3, 1.0, 1e-3, 1e-3], 0.0, None))
        rows.append(("pose_prior", k * 1000, None, [*p[0].tolist(), *lie.quat_of(r[0]).tolist()], None, None, None, [0.05] * 6, 0.0, None))
    anchor = [3.0, -2.0, 0.5]
    start.append((9100, *anchor, 0.0, 0.0, 0.0, 1.0, None))
    rows.append(("anchor_pin", 9100, None, [*anchor, 0.0, 0.0, 0.0, 1.0], None, None, None, [1e-3] * 6, 0.0, None))
    for i in range(0, n, 3):
        far = np.linalg.norm(poses[0][1][i] - poses[1][1][i])
        rows.append(("inter_range", i, 1000 + i, [float(far + RNG.normal(0, 0.05) + 0.2)], None, None, None, [0.1], 1.5, 9000))
        rows.append(("inter_range", 1000 + i, 9100, [float(np.linalg.norm(poses[1][1][i] - anchor) + RNG.normal(0, 0.05))], None, None, None, [0.1], 1.5, 9001))
    return spark.createDataFrame(rows, solve.FACTOR), spark.createDataFrame(start, solve.NODE + ", t double")


def test_segments_give_what_one_task_gives(spark):
    factors, nodes = fleet(spark)
    one = F.lit(0).alias("g")
    want = {r["id"]: r for r in solve.optimise_groups(factors.select(one, "*"), nodes.select(one, "*"), ["g"], with_marginals=True).collect()}
    for fan, seconds in ((8, 3), (2, 6)):
        found = segmented.optimise(factors, nodes, F.floor(F.col("t") / seconds), F.col("t"), fan=fan, with_marginals=True)
        rows = found.nodes.collect()
        assert len(rows) == len(want) and np.isclose(found.cost, want[0]["cost"], rtol=1e-8)
        for r in rows:
            assert np.allclose([r[c] for c in "xyz"], [want[r["id"]][c] for c in "xyz"], atol=1e-7)
            assert np.allclose(r["covariance"], want[r["id"]]["covariance"], rtol=1e-5, atol=1e-9)


def test_segments_by_place_when_none_are_given(spark):
    factors, nodes = fleet(spark, 20)
    factors, nodes = factors.where("a < 1000 AND kind IN ('odometry', 'pose_prior')"), nodes.where("id < 1000")
    segmented_nodes, segmented.SEGMENT_NODES = segmented.SEGMENT_NODES, 3
    try:
        found = segmented.optimise(factors, nodes, fan=3)
    finally:
        segmented.SEGMENT_NODES = segmented_nodes
    one = F.lit(0).alias("g")
    want = {r["id"]: r for r in solve.optimise_groups(factors.select(one, "*"), nodes.select(one, "*"), ["g"]).collect()}
    for r in found.nodes.collect():
        assert np.allclose([r[c] for c in "xyz"], [want[r["id"]][c] for c in "xyz"], atol=1e-7)


def track(spark, n, seed=3):
    """Two entities of uneven times, one long and one short, and one without a name."""
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.uniform(0.01, 0.2, n))
    rows = [("long", float(a), float(np.sin(a) + rng.normal(0, 0.1)), float(a * 0.1 + rng.normal(0, 0.1))) for a in t]
    rows += [("short", float(a), float(a), 1.0) for a in range(5)] + [(None, float(a), float(a % 3), 2.0) for a in range(30)]
    return spark.createDataFrame(rows, "k string, t double, x double, y double")


def test_spline_in_segments_equals_the_whole_solve(spark):
    from marram.operators import cleaning

    df = track(spark, 1003).repartition(5)
    df = df.unionByName(df.where("t < 20 AND k = 'long'"))  # times that come twice
    order = lambda rows: sorted([(str(r["k"]), r["t"], r["x"], r["y"]) for r in rows.collect()])
    for smooth in (0.9999, 0.3):
        want = order(cleaning.smoothed(df, ["k"], "t", ["x", "y"], smooth))
        for piece in (8, 61, 500):
            got = order(cleaning.smoothed(df, ["k"], "t", ["x", "y"], smooth, task_rows=20, piece_rows=piece))
            assert [g[:2] for g in got] == [w[:2] for w in want]
            assert np.allclose([g[2:] for g in got], [w[2:] for w in want], rtol=1e-9, atol=1e-9)


def test_spline_is_evaluated_between_knots_as_in_numpy(spark):
    from marram.operators import cleaning

    df = track(spark, 200).where("k = 'long'")
    knots = cleaning.fitted(df, ["k"], "t", ["x"], 0.9, task_rows=50, piece_rows=40)
    at = np.sort(RNG.uniform(-1, 25, 80))
    asks = spark.createDataFrame([("long", float(a)) for a in at] + [("other", 1.0)], "k string, t double")
    rows = df.orderBy("t").collect()
    t, x = np.array([r["t"] for r in rows]), np.array([r["x"] for r in rows])
    level, curve = cleaning.smoothing_spline(t, x, 0.9)
    for slot in (None, 1.5):
        got = sorted((r["t"], r["x"]) for r in cleaning.evaluated(knots, asks, ["k"], "t", ["x"], slot).collect())
        assert len(got) == 80
        assert np.allclose(got, np.stack([np.clip(at, t[0], t[-1]), cleaning.spline_at(t, level, curve, at)], axis=1), atol=1e-9)


def test_outliers_in_pieces_equal_one_pass(spark):
    from marram.operators import cleaning

    n = 600
    v = np.where(RNG.random(n) < 0.15, RNG.choice([50.0, 100.0, -70.0], n), 0.0) + RNG.normal(0, 1, n)
    v[[0, 16, 32, 48, 64]] = 100.0  # pieces that begin with an outlier
    v[80:120] = 100.0  # and a stretch of them over several pieces
    rows = [("a", i, float(x)) for i, x in enumerate(v)] + [("b", i, float(i % 2) * 9) for i in range(40)] + [(None, i, float(i % 7)) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, o int, v double").repartition(4)
    seen = lambda out: sorted((str(r["k"]), r["o"], r["v"], r["flagged"]) for r in out.collect())
    want = seen(cleaning.jump_outliers(df, ["k"], "o", "v", 5.0))
    last, plain = v[0], []
    for i, x in enumerate(v):
        plain.append(i > 0 and abs(x - last) > 5.0)
        last = last if plain[-1] else x
    assert [w[3] for w in want if w[0] == "a"] == [plain[i] or (i + 1 < n and plain[i + 1]) for i in range(n)]
    for piece in (8, 16, 150):
        assert seen(cleaning.jump_outliers(df, ["k"], "o", "v", 5.0, task_rows=45, piece_rows=piece)) == want
    quats = lie.quat_of(lie.so3_exp(RNG.normal(0, 0.9, (200, 3))))
    turns = spark.createDataFrame([("a", i, f"row {i}", *map(float, q)) for i, q in enumerate(quats)], "k string, o int, name string, qx double, qy double, qz double, qw double")
    cols = ["qx", "qy", "qz", "qw"]
    whole = sorted(map(tuple, cleaning.rotation_outliers(turns, ["k"], "o", cols).collect()))
    assert sorted(map(tuple, cleaning.rotation_outliers(turns, ["k"], "o", cols, task_rows=50, piece_rows=16).collect())) == whole


def test_a_front_of_arrow_rows_against_a_dense_system():
    """Four nodes eliminated from repeated blocks, steps substituted, and the selected inverse, all on Arrow tables."""
    rng, n = np.random.default_rng(6), 4
    a = rng.normal(size=(6 * n, 6 * n))
    dense, g = a @ a.T + 6 * np.eye(6 * n), rng.normal(size=(n, 6))
    part = lambda m, i, j: m[6 * i : 6 * i + 6, 6 * j : 6 * j + 6]
    pairs = [(i, j) for i in range(n) for j in range(i, n)] * 2
    values = np.stack([np.concatenate([part(dense, i, j).ravel() / 2, g[i] / 2 * (i == j), np.zeros(6)]) for i, j in pairs])
    i, j = (pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1))
    rows = segmented._elimination(0, 0.0)((pa.scalar(5),), segmented._table([i, j], ["i", "j"], values, segmented._H + segmented._G + segmented._D))
    assert set(rows["front"].to_pylist()) == {5} and set(rows["kind"].to_pylist()) == {"factor"}
    none = segmented._table([], [], np.full((len(rows), 6), np.nan), segmented._S)
    met = pa.table([*rows.columns, *none.columns], names=[*rows.column_names, *none.column_names])
    steps = segmented._matrix(segmented._substitute(met), segmented._S)
    assert np.allclose(steps.ravel(), -np.linalg.solve(dense, g.ravel()))
    found, inverse = segmented._selected(rows), np.linalg.inv(dense)
    for i, j, h in zip(found["i"].to_pylist(), found["j"].to_pylist(), segmented._matrix(found, segmented._H), strict=True):
        assert np.allclose(h.reshape(6, 6), part(inverse, i, j))
