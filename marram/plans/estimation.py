"""Queries: constraints, graph, alignment and estimation. Embedding components stand for points and rotations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marram.functions.geometry import vec
from marram.operators import alignment, constraints, factor_math, lie, problem, segmented, solve
from marram.operators.asof import nearest_asof
from marram.plans.registry import DAY, HOUR, events, of_type, points, query, r6, table


@query(f"""
SELECT user_id, event_id AS a_event_id, b AS b_event_id, gap FROM (
    SELECT user_id, event_id, lead(event_id) OVER w AS b, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE gap <= {12 * HOUR}""")
def adjacency_gap(spark, sf_dir):
    out = constraints.adjacent(events(spark, sf_dir), ["user_id"], "t", ["event_id"], 12 * HOUR)
    return out.select("user_id", "a_event_id", "b_event_id", (F.col("b_t") - F.col("a_t")).alias("gap"))


@query("""
SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY n_name""")
def dim_lookup(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    region = t("region").where(F.col("r_name").isin("ASIA", "EUROPE"))
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def unconstrained_nodes(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select("c_custkey")
    return constraints.untouched(nodes, [(table(spark, sf_dir, "orders").where("o_totalprice > 150000"), [["o_custkey"]])], ["c_custkey"])


@query("""
SELECT a, b, count(*) AS n FROM (SELECT user_id % 7 AS a, event_id % 7 AS b FROM events)
WHERE (least(a, b), greatest(a, b)) IN ((0, 1), (2, 3), (2, 4)) GROUP BY a, b""")
def pair_filter(spark, sf_dir):
    pairs = spark.createDataFrame([(0, 1), (3, 2), (4, 2)], "p long, q long")
    rows = events(spark, sf_dir).select((F.col("user_id") % 7).alias("a"), (F.col("event_id") % 7).alias("b"))
    return constraints.allowed_pairs(rows, "a", "b", pairs).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH RECURSIVE e AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 5 AND a.s_acctbal > 2000),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a)
SELECT a AS id, min(b) AS component FROM reach GROUP BY a""")
def components_gauge(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    edges = s.where("s_acctbal > 2000").select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 5).alias("b"))
    edges = edges.join(s, F.col("b") == F.col("s_suppkey"), "left_semi")
    return constraints.connected(edges, s.select(F.col("s_suppkey").alias("id")))


@query("""
SELECT kind, factor, count(*) AS n FROM (
    SELECT CASE WHEN user_id % 20 < 10 THEN 'anchor' ELSE 'inter' END AS kind,
           CASE WHEN user_id % 20 < 10 THEN 'ma_anchor_range' ELSE 'ma_inter_range' END AS factor FROM events) GROUP BY ALL""")
def factor_stats(spark, sf_dir):
    kind = F.when(F.col("user_id") % 20 < 10, "anchor").otherwise("inter")
    rows = events(spark, sf_dir).select(kind.alias("kind")).withColumn("factor", constraints.range_factor_kind(constraints.Config(use_moment_arm=True), F.col("kind")))
    return constraints.stats(rows, ["kind", "factor"])


#: Corners of the room, as (id, x, y, z).
ANCHORS = ((0, -3.0, -3.0, 0.5), (1, 3.0, -3.0, 2.5), (2, 3.0, 3.0, 0.5), (3, -3.0, 3.0, 2.5), (4, 0.0, 0.0, 3.0))
_ANCHORS = "(VALUES " + ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for i, x, y, z in ANCHORS) + ") AS k(anchor, ax, ay, az)"


def _anchors(spark):
    return spark.createDataFrame(list(ANCHORS), "anchor int, ax double, ay double, az double")


def _ranges(spark, sf_dir):
    """Each point with each of the five fixed anchors."""
    p = points(spark, sf_dir, ["x", "y", "z"], 10.0)
    beside = F.explode(F.array(*[F.struct(F.lit(i).alias("anchor"), F.lit(x).alias("ax"), F.lit(y).alias("ay"), F.lit(z).alias("az")) for i, x, y, z in ANCHORS]))
    return p.select("*", beside.alias("k")).select("vec_id", "label", "x", "y", "z", "k.*")


@query(f"""
WITH r AS (SELECT vec_id, anchor, sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay) + (z - az) * (z - az)) - (2.0 + label / 2.0) + 0.14 AS residual
    FROM (SELECT vec_id, label, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings), {_ANCHORS})
SELECT vec_id, anchor, round(residual, 6) AS residual, round(CASE WHEN abs(residual / 0.3) <= 1.5 THEN 1.0 ELSE 1.5 / abs(residual / 0.3) END, 6) AS weight,
       round(CASE WHEN abs(residual / 0.3) <= 1.5 THEN 0.5 * abs(residual / 0.3) * abs(residual / 0.3) ELSE 1.5 * (abs(residual / 0.3) - 0.75) END, 6) AS cost FROM r""")
def range_residual_huber(spark, sf_dir):
    e = constraints.range_residual(vec("x", "y", "z"), vec("ax", "ay", "az"), 2.0 + F.col("label") / 2.0, 0.14)
    rows = _ranges(spark, sf_dir).withColumn("e", e)
    s = F.lit(0.3)
    return rows.select("vec_id", "anchor", r6("e").alias("residual"), r6(constraints.huber_weight(F.col("e"), s, 1.5)).alias("weight"), r6(constraints.huber_cost(F.col("e"), s, 1.5)).alias("cost"))


@query("""
WITH q AS (SELECT vec_id, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z,
    embedding[4]::DOUBLE / n AS a, embedding[5]::DOUBLE / n AS b, embedding[6]::DOUBLE / n AS c, embedding[7]::DOUBLE / n AS w
    FROM (SELECT *, sqrt(embedding[4]::DOUBLE ** 2 + embedding[5]::DOUBLE ** 2 + embedding[6]::DOUBLE ** 2 + embedding[7]::DOUBLE ** 2) AS n FROM embeddings)),
m AS (SELECT vec_id, x + (1 - 2 * (b * b + c * c)) * 0.1 + 2 * (a * b - c * w) * -0.05 + 2 * (a * c + b * w) * 0.2 - 3 AS dx,
    y + 2 * (a * b + c * w) * 0.1 + (1 - 2 * (a * a + c * c)) * -0.05 + 2 * (b * c - a * w) * 0.2 + 3 AS dy,
    z + 2 * (a * c - b * w) * 0.1 + 2 * (b * c + a * w) * -0.05 + (1 - 2 * (a * a + b * b)) * 0.2 - 2.5 AS dz FROM q)
SELECT vec_id, round(sqrt(dx * dx + dy * dy + dz * dz) - 4.0, 6) AS residual, round(dx / sqrt(dx * dx + dy * dy + dz * dz), 6) AS ux FROM m""")
def moment_arm_residual(spark, sf_dir):
    from marram.functions.geometry import plus, rotate
    from marram.operators.cleaning import norm

    p = points(spark, sf_dir, ["x", "y", "z", "qx", "qy", "qz", "qw"])
    n = norm("qx", "qy", "qz", "qw")
    q = tuple(F.col(c) / n for c in ("qx", "qy", "qz", "qw"))
    at = tuple(F.col(c) * 10 for c in "xyz")
    arm, anchor = (F.lit(0.1), F.lit(-0.05), F.lit(0.2)), (F.lit(3.0), F.lit(-3.0), F.lit(2.5))
    e = constraints.arm_range_residual(at, q, arm, anchor, F.lit(4.0))
    u = constraints.range_direction(plus(at, rotate(q, arm)), anchor)
    return p.select("vec_id", r6(e).alias("residual"), r6(u[0]).alias("ux"))


#: Unit quaternions a (components 4-7) and b (8-11), positions p (1-3, times 10) and r (12-14, times 10) of each row.
_POSES = """pose AS (SELECT vec_id, label, embedding[1]::DOUBLE * 10 AS px, embedding[2]::DOUBLE * 10 AS py, embedding[3]::DOUBLE * 10 AS pz, embedding[4]::DOUBLE / na AS ax, embedding[5]::DOUBLE / na AS ay, embedding[6]::DOUBLE / na AS az, embedding[7]::DOUBLE / na AS aw,
    embedding[8]::DOUBLE / nb AS bx, embedding[9]::DOUBLE / nb AS by_, embedding[10]::DOUBLE / nb AS bz, embedding[11]::DOUBLE / nb AS bw, embedding[12]::DOUBLE * 10 AS rx, embedding[13]::DOUBLE * 10 AS ry, embedding[14]::DOUBLE * 10 AS rz
    FROM (SELECT *, sqrt(embedding[4]::DOUBLE ** 2 + embedding[5]::DOUBLE ** 2 + embedding[6]::DOUBLE ** 2 + embedding[7]::DOUBLE ** 2) AS na, sqrt(embedding[8]::DOUBLE ** 2 + embedding[9]::DOUBLE ** 2 + embedding[10]::DOUBLE ** 2 + embedding[11]::DOUBLE ** 2) AS nb FROM embeddings))"""


def _two_poses(spark, sf_dir):
    """Nodes of each row's two poses (ids 2v and 2v + 1), and its columns."""
    names = ["px", "py", "pz", "ax", "ay", "az", "aw", "bx", "by", "bz", "bw", "rx", "ry", "rz"]
    p = points(spark, sf_dir, names).withColumns({"a": F.col("vec_id") * 2, "b": F.col("vec_id") * 2 + 1})
    of = lambda q: F.sqrt(F.col(q + "x") ** 2 + F.col(q + "y") ** 2 + F.col(q + "z") ** 2 + F.col(q + "w") ** 2)
    node = lambda i, at, q: p.select(F.col(i).alias("id"), *[(F.col(at + c) * 10).alias(c) for c in "xyz"], *[(F.col(q + c) / of(q)).alias("q" + c) for c in "xyzw"])
    return node("a", "p", "a").unionByName(node("b", "r", "b")), p


def _factor(p, kind, meas, sigma, b=None, point=None, arm_a=None, arm_b=None, huber=0.0, c=None, keep=("vec_id",)):
    columns = problem.factor_row(kind, F.col("a"), b, [F.lit(float(v)) if not isinstance(v, Column) else v for v in meas], [F.lit(float(v)) for v in sigma], huber, point, arm_a, arm_b, c)
    return p.select(*keep, *columns)


def _fixed(*values):
    return tuple(F.lit(float(v)) for v in values)


@query("""
SELECT label, count(*) AS n, round(sum(0.5 * (e / 0.1) * (e / 0.1)), 4) AS cost FROM (
    SELECT label, embedding[3]::DOUBLE * 10 - label / 5.0 AS e FROM embeddings) GROUP BY label""")
def height_residual(spark, sf_dir):
    nodes, p = _two_poses(spark, sf_dir)
    found = solve.residuals(_factor(p, "height", [F.col("label") / 5.0], [0.1], keep=("label",)), nodes, ["label"])
    return found.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("cost"), 4).alias("cost"))


@query(f"""WITH {_POSES}, e AS (SELECT vec_id,
    px + (1 - 2 * (ay * ay + az * az)) * 0.1 + 2 * (ax * ay - az * aw) * -0.05 + 2 * (ax * az + ay * aw) * 0.2 - rx - ((1 - 2 * (by_ * by_ + bz * bz)) * -0.1 + 2 * (bx * by_ - bz * bw) * 0.15 + 2 * (bx * bz + by_ * bw) * 0.05) AS dx,
    py + 2 * (ax * ay + az * aw) * 0.1 + (1 - 2 * (ax * ax + az * az)) * -0.05 + 2 * (ay * az - ax * aw) * 0.2 - ry - (2 * (bx * by_ + bz * bw) * -0.1 + (1 - 2 * (bx * bx + bz * bz)) * 0.15 + 2 * (by_ * bz - bx * bw) * 0.05) AS dy,
    pz + 2 * (ax * az - ay * aw) * 0.1 + 2 * (ay * az + ax * aw) * -0.05 + (1 - 2 * (ax * ax + ay * ay)) * 0.2 - rz - (2 * (bx * bz - by_ * bw) * -0.1 + 2 * (by_ * bz + bx * bw) * 0.15 + (1 - 2 * (bx * bx + by_ * by_)) * 0.05) AS dz FROM pose)
SELECT vec_id, round(sqrt(dx * dx + dy * dy + dz * dz) - 2.0, 6) AS residual FROM e""")
def moment_arm_between(spark, sf_dir):
    """Range between the antennas of two poses."""
    nodes, p = _two_poses(spark, sf_dir)
    f = _factor(p, "ma_inter_range", [2.0], [1.0], F.col("b"), None, _fixed(0.1, -0.05, 0.2), _fixed(-0.1, 0.15, 0.05))
    return solve.residuals(f, nodes, ["vec_id"]).select("vec_id", r6(F.get("residual", F.lit(0))).alias("residual"))


@query(f"""WITH {_POSES}, e AS (SELECT vec_id, sqrt((px - rx) ** 2 + (py - ry) ** 2 + (pz - rz) ** 2) - 2.0 AS native, sqrt((px - rx) ** 2 + (py - ry) ** 2 + (pz - rz) ** 2) - 2.0 + rx AS biased FROM pose)
SELECT vec_id, round(native, 6) AS native, round(biased, 6) AS biased, round(0.5 * (native / 0.01) ** 2, 3) AS floored FROM e""")
def range_between(spark, sf_dir):
    """Range between two poses as it is, with a bias (the x of a third node) and with a sigma that the floor holds to 0.01."""
    nodes, p = _two_poses(spark, sf_dir)
    one = lambda **k: solve.residuals(_factor(p, "native_range", [2.0], k.pop("sigma", [1.0]), F.col("b"), **k), nodes.where("true"), ["vec_id"])
    still = nodes.withColumns({"qx": F.when(F.col("id") % 2 == 1, 0.0).otherwise(F.col("qx")), "qy": F.when(F.col("id") % 2 == 1, 0.0).otherwise(F.col("qy")), "qz": F.when(F.col("id") % 2 == 1, 0.0).otherwise(F.col("qz")), "qw": F.when(F.col("id") % 2 == 1, 1.0).otherwise(F.col("qw"))})
    biased = solve.residuals(_factor(p, "inter_range", [2.0], [1.0], F.col("b"), c=F.col("b")), still, ["vec_id"])
    get = F.get("residual", F.lit(0))
    out = one().select("vec_id", r6(get).alias("native")).join(biased.select("vec_id", r6(get).alias("biased")), "vec_id")
    return out.join(one(sigma=[0.0001], huber=1e9).select("vec_id", F.round("cost", 3).alias("floored")), "vec_id")


def _log_sql(q: str, t: str, name: str) -> str:
    """Rotation vector and translation part of the logarithm of (unit quaternion q0..q3, w last, vector t0..t2) of a table."""
    return f"""{name}_w AS (SELECT *, CASE WHEN {q}3 < 0 THEN -1 ELSE 1 END AS sg, sqrt({q}0 ** 2 + {q}1 ** 2 + {q}2 ** 2) AS vn FROM {name}_in),
    {name}_r AS (SELECT *, 2 * atan2(vn, sg * {q}3) AS th FROM {name}_w),
    {name}_v AS (SELECT *, th / vn * sg * {q}0 AS w0, th / vn * sg * {q}1 AS w1, th / vn * sg * {q}2 AS w2, 1 / (th * th) - (1 + cos(th)) / (2 * th * sin(th)) AS k FROM {name}_r),
    {name}_c AS (SELECT *, w1 * {t}2 - w2 * {t}1 AS c0, w2 * {t}0 - w0 * {t}2 AS c1, w0 * {t}1 - w1 * {t}0 AS c2 FROM {name}_v),
    {name} AS (SELECT *, {t}0 - 0.5 * c0 + k * (w1 * c2 - w2 * c1) AS u0, {t}1 - 0.5 * c1 + k * (w2 * c0 - w0 * c2) AS u1, {t}2 - 0.5 * c2 + k * (w0 * c1 - w1 * c0) AS u2 FROM {name}_c)"""


_ROUNDED = ", ".join(f"round({c}, 5) + 0.0 AS {n}" for c, n in zip(("w0", "w1", "w2", "u0", "u1", "u2"), ("rx", "ry", "rz", "tx", "ty", "tz"), strict=True))


def _six_columns(found):
    return found.select("vec_id", *[(F.round(F.get("residual", F.lit(i)), 5) + 0.0).alias(n) for i, n in enumerate(("rx", "ry", "rz", "tx", "ty", "tz"))])


#: b seen from a: quaternion conj(a) * b and the difference turned into a's frame.
_SEEN = """seen AS (SELECT vec_id, aw * bx - ax * bw - ay * bz + az * by_ AS g0, aw * by_ + ax * bz - ay * bw - az * bx AS g1, aw * bz - ax * by_ + ay * bx - az * bw AS g2, aw * bw + ax * bx + ay * by_ + az * bz AS g3,
    (1 - 2 * (ay * ay + az * az)) * (rx - px) + 2 * (ax * ay + az * aw) * (ry - py) + 2 * (ax * az - ay * aw) * (rz - pz) AS h0,
    2 * (ax * ay - az * aw) * (rx - px) + (1 - 2 * (ax * ax + az * az)) * (ry - py) + 2 * (ay * az + ax * aw) * (rz - pz) AS h1,
    2 * (ax * az + ay * aw) * (rx - px) + 2 * (ay * az - ax * aw) * (ry - py) + (1 - 2 * (ax * ax + ay * ay)) * (rz - pz) AS h2 FROM pose)"""


@query(f"""WITH {_POSES}, {_SEEN}, odo_in AS (SELECT vec_id, 0.8 * g0 - 0.6 * g1 AS q0, 0.8 * g1 + 0.6 * g0 AS q1, 0.8 * g2 - 0.6 * g3 AS q2, 0.8 * g3 + 0.6 * g2 AS q3,
    0.28 * (h0 - 0.5) + 0.96 * (h1 + 0.25) AS t0, -0.96 * (h0 - 0.5) + 0.28 * (h1 + 0.25) AS t1, h2 - 1.0 AS t2 FROM seen),
    turned AS (SELECT vec_id, 0.8 * g0 + 0.6 * g1 AS q0, 0.8 * g1 - 0.6 * g0 AS q1, 0.8 * g2 - 0.6 * g3 AS q2, 0.8 * g3 + 0.6 * g2 AS q3,
    0.28 * (h0 - 0.5) + 0.96 * (h1 + 0.25) AS t0, -0.96 * (h0 - 0.5) + 0.28 * (h1 + 0.25) AS t1, h2 - 1.0 AS t2 FROM seen),
    {_log_sql("q", "t", "odo").replace("odo_in),", "turned),", 1)}
SELECT vec_id, {_ROUNDED} FROM odo""")
def odometry_residual(spark, sf_dir):
    """Logarithm of the measured motion's inverse times the one between two poses; measured: 2 atan(3/4) about z, and a step."""
    nodes, p = _two_poses(spark, sf_dir)
    f = _factor(p, "odometry", [0.5, -0.25, 1.0, 0.0, 0.0, 0.6, 0.8], [1.0] * 6, F.col("b"))
    return _six_columns(solve.residuals(f, nodes, ["vec_id"]))


@query(f"""WITH {_POSES}, pri_in AS (SELECT vec_id, ax AS q0, ay AS q1, az AS q2, aw AS q3, px - 0.5 AS t0, py + 0.25 AS t1, pz - 1.0 AS t2 FROM pose), {_log_sql("q", "t", "pri")}
SELECT vec_id, {_ROUNDED} FROM pri""")
def pose_prior_residual(spark, sf_dir):
    nodes, p = _two_poses(spark, sf_dir)
    f = _factor(p, "pose_prior", [0.5, -0.25, 1.0, 0.0, 0.0, 0.0, 1.0], [1.0] * 6)
    return _six_columns(solve.residuals(f, nodes, ["vec_id"]))


@query(f"""WITH {_POSES}, g AS (SELECT vec_id, 2 * (ax * az - ay * aw) AS x, 2 * (ay * az + ax * aw) AS y, 1 - 2 * (ax * ax + ay * ay) AS z FROM pose)
SELECT vec_id, round(sqrt(greatest(1 - (0.48 * x + 0.6 * y + 0.64 * z) ** 2, 0)), 6) AS tilt FROM g""")
def gravity_residual(spark, sf_dir):
    """Size of the tilt residual: the sine between the world's up in the body and the measured one."""
    nodes, p = _two_poses(spark, sf_dir)
    found = solve.residuals(_factor(p, "gravity", [0.48, 0.6, 0.64], [1.0]), nodes, ["vec_id"])
    at = lambda i: F.get("residual", F.lit(i))
    return found.select("vec_id", r6(F.sqrt(at(0) * at(0) + at(1) * at(1))).alias("tilt"))


_PAIRS = """pairs AS (SELECT vec_id, label, embedding[1]::DOUBLE AS sx, embedding[2]::DOUBLE AS sy, embedding[3]::DOUBLE AS sz,
    embedding[4]::DOUBLE AS dx, embedding[5]::DOUBLE AS dy, embedding[6]::DOUBLE AS dz FROM embeddings)"""
_YAW = """mean AS (SELECT {0}, avg(sx) AS msx, avg(sy) AS msy, avg(sz) AS msz, avg(dx) AS mdx, avg(dy) AS mdy, avg(dz) AS mdz FROM pairs GROUP BY {0}),
yaw AS (SELECT {0}, count(*) AS n, atan2(sum((sx - msx) * (dy - mdy) - (sy - msy) * (dx - mdx)), sum((sx - msx) * (dx - mdx) + (sy - msy) * (dy - mdy))) AS yaw
    FROM pairs JOIN mean USING ({0}) GROUP BY {0}),
fit AS (SELECT {0}, n, yaw, mdx - (cos(yaw) * msx - sin(yaw) * msy) AS tx, mdy - (sin(yaw) * msx + cos(yaw) * msy) AS ty, mdz - msz AS tz FROM mean JOIN yaw USING ({0}))"""


def _pairs(spark, sf_dir):
    return points(spark, sf_dir, [*alignment.SRC, *alignment.DST])


@query(f"WITH {_PAIRS}, {_YAW.format('label')} SELECT label, n, round(yaw, 6) AS yaw, round(tx, 6) AS tx, round(ty, 6) AS ty, round(tz, 6) AS tz FROM fit")
def yaw_align(spark, sf_dir):
    return alignment.yaw_alignment(_pairs(spark, sf_dir), ["label"]).select("label", "n", *[r6(c).alias(c) for c in ("yaw", "tx", "ty", "tz")])


_TRACKS = f"""p AS (SELECT user_id, event_id, value, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, event_id, value, epoch_us(ts) AS t FROM events WHERE event_type = 'view'),
hit AS (SELECT * FROM (SELECT p.user_id, p.value AS a, v.value AS b, abs(p.t - v.t) AS gap,
    row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.t - v.t), v.t, v.event_id) AS k FROM p JOIN v USING (user_id)) WHERE k = 1 AND gap <= {2 * DAY}),
pairs AS (SELECT user_id, 10 * cos(a / 20) AS sx, 10 * sin(a / 20) AS sy, a / 100 AS sz, 10 * cos(b / 20) AS dx, 10 * sin(b / 20) AS dy, b / 100 AS dz FROM hit)"""


@query(f"""
WITH {_TRACKS}, {_YAW.format('user_id')}
SELECT user_id, n, rmse FROM (SELECT user_id, count(*) AS n, round(sqrt(avg((cos(yaw) * sx - sin(yaw) * sy + tx - dx) ** 2 + (sin(yaw) * sx + cos(yaw) * sy + ty - dy) ** 2 + (sz + tz - dz) ** 2)), 6) AS rmse
FROM pairs JOIN fit USING (user_id) GROUP BY user_id) WHERE n >= 5""")
def ate_yaw(spark, sf_dir):
    """Estimated track, truth nearest in time, yaw alignment per entity, root mean square error."""
    e = events(spark, sf_dir)
    right = of_type(e, "view").select("user_id", F.col("t").alias("rt"), F.col("value").alias("b"), "event_id")
    left = of_type(e, "purchase").select("user_id", "t", F.col("value").alias("a"))
    hit = nearest_asof(left, right, ["user_id"], "t", "rt", ["b"], 2 * DAY, DAY, "event_id")
    at = lambda c: (10 * F.cos(F.col(c) / 20), 10 * F.sin(F.col(c) / 20), F.col(c) / 100)
    pairs = hit.select("user_id", *[x.alias(n) for x, n in zip((*at("a"), *at("b")), (*alignment.SRC, *alignment.DST), strict=True)])
    out = alignment.rmse(alignment.aligned_by_yaw(pairs, ["user_id"]), ["user_id"])
    return out.select("user_id", "n", r6("rmse").alias("rmse"))


@query(f"""
WITH {_PAIRS}, raw AS (SELECT label, sqrt(avg((sx - dx) ** 2 + (sy - dy) ** 2 + (sz - dz) ** 2)) AS before FROM pairs GROUP BY label), {_YAW.format('label')},
al AS (SELECT label, count(*) AS n, sqrt(avg((cos(yaw) * sx - sin(yaw) * sy + tx - dx) ** 2 + (sin(yaw) * sx + cos(yaw) * sy + ty - dy) ** 2 + (sz + tz - dz) ** 2)) AS after FROM pairs JOIN fit USING (label) GROUP BY label)
SELECT label, n, round(before, 6) AS before, round(after, 6) AS after, round(100 * (before - after) / before, 4) AS improve_pct FROM raw JOIN al USING (label) WHERE n >= 5""")
def run_report(spark, sf_dir):
    from marram.functions.geometry import length, minus

    pairs = _pairs(spark, sf_dir)
    raw = alignment.rmse(pairs.withColumn("error", length(minus(vec(*alignment.SRC), vec(*alignment.DST)))), ["label"]).select("label", F.col("rmse").alias("before"))
    out = alignment.rmse(alignment.aligned_by_yaw(pairs, ["label"]), ["label"]).withColumnRenamed("rmse", "after").join(raw, "label")
    gain = F.try_divide(100 * (F.col("before") - F.col("after")), F.col("before"))
    return out.select("label", "n", r6("before").alias("before"), r6("after").alias("after"), F.round(gain, 4).alias("improve_pct"))


#: The top eigenvalue of Horn's matrix by Newton's steps on its quartic from above; m.. are centred sums of source times target.
_HORN = f"""WITH RECURSIVE {_PAIRS}, c AS (SELECT label, count(*) AS n, avg(sx) AS a, avg(sy) AS b, avg(sz) AS c, avg(dx) AS d, avg(dy) AS e, avg(dz) AS f FROM pairs GROUP BY label),
m AS (SELECT label, any_value(n) AS n, {", ".join(f"sum((s{p} - {u}) * (d{q} - {v})) AS {p}{q}" for p, u in zip("xyz", "abc", strict=True) for q, v in zip("xyz", "def", strict=True))},
    sum((sx - a) ** 2 + (sy - b) ** 2 + (sz - c) ** 2) AS ss, sum((dx - d) ** 2 + (dy - e) ** 2 + (dz - f) ** 2) AS dd FROM pairs JOIN c USING (label) GROUP BY label),
k AS (SELECT label, n, ss, dd, -2 * (xx ** 2 + xy ** 2 + xz ** 2 + yx ** 2 + yy ** 2 + yz ** 2 + zx ** 2 + zy ** 2 + zz ** 2) AS c2,
    8 * (xx * yz * zy + yy * zx * xz + zz * xy * yx - xx * yy * zz - yz * zx * xy - zy * yx * xz) AS c1,
    xx + yy + zz AS a, yz - zy AS b, zx - xz AS c, xy - yx AS d, xx - yy - zz AS e, xy + yx AS f, zx + xz AS g, yy - xx - zz AS h, yz + zy AS i, zz - xx - yy AS j FROM m),
q AS (SELECT label, n, ss, dd, c2, c1, a * (e * (h * j - i * i) - f * (f * j - i * g) + g * (f * i - h * g)) - b * (b * (h * j - i * i) - f * (c * j - i * d) + g * (c * i - h * d))
    + c * (b * (f * j - g * i) - e * (c * j - d * i) + g * (c * g - d * f)) - d * (b * (f * i - g * h) - e * (c * i - d * h) + f * (c * g - d * f)) AS c0 FROM k),
newton(label, step, v) AS (SELECT label, 0, (ss + dd) / 2 FROM q UNION ALL SELECT q.label, step + 1, v - (v ** 4 + c2 * v ** 2 + c1 * v + c0) / (4 * v ** 3 + 2 * c2 * v + c1) FROM newton JOIN q USING (label) WHERE step < 80)
SELECT label, n, round(sqrt(greatest({{rest}}, 0) / n), 6) AS rmse FROM q JOIN newton USING (label) WHERE step = 80"""


def _similarity(spark, sf_dir, with_scale):
    out = alignment.rmse(alignment.aligned_by_similarity(_pairs(spark, sf_dir), ["label"], with_scale), ["label"])
    return out.select("label", "n", r6("rmse").alias("rmse"))


@query(_HORN.format(rest="ss + dd - 2 * v"))
def rigid_align(spark, sf_dir):
    return _similarity(spark, sf_dir, False)


@query(_HORN.format(rest="dd - v * v / ss"))
def sim3_align(spark, sf_dir):
    return _similarity(spark, sf_dir, True)


@query(f"""WITH e AS (SELECT vec_id, x, y, z, (x - ax) / (0.1 * d) AS u, (y - ay) / (0.1 * d) AS v, (z - az) / (0.1 * d) AS w FROM (SELECT *, sqrt((x - ax) ** 2 + (y - ay) ** 2 + (z - az) ** 2) AS d
    FROM (SELECT vec_id, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings), {_ANCHORS})),
h AS (SELECT vec_id, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z, sum(u * u) AS a, sum(u * v) AS b, sum(u * w) AS c, sum(v * v) AS d, sum(v * w) AS e, sum(w * w) AS f FROM e GROUP BY vec_id)
SELECT vec_id, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z, 0.0 AS cost, round(((d * f - e * e) + (a * f - c * c) + (a * d - b * b)) / (a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)), 6) AS trace FROM h""")
def lm_multilateration(spark, sf_dir):
    """Positions from exact ranges, which only the true point fits, and the trace of their covariance."""
    r = _ranges(spark, sf_dir)
    z = constraints.range_residual(vec("x", "y", "z"), vec("ax", "ay", "az"), F.lit(0.0))
    found = solve.multilaterate(r.select("vec_id", "ax", "ay", "az", z.alias("z"), F.lit(0.1).alias("sigma")), ["vec_id"])
    return found.select("vec_id", *[(F.round(c, 5) + 0.0).alias(c) for c in "xyz"], (F.round("cost", 6) + 0.0).alias("cost"), r6("trace").alias("trace"))


def _chain(spark, sf_dir):
    """A chain of poses per label in id order, linked by odometry, with ranges to the anchors: nodes, factors, each label a problem of its own."""
    key = F.col("label").cast("long") * 1_000_000_000 + F.col("vec_id")
    p = points(spark, sf_dir, ["x", "y", "z"], 4.0).withColumn("id", key)
    nodes = p.select("label", "id", (F.col("x") + 0.05).alias("x"), (F.col("y") - 0.05).alias("y"), (F.col("z") + 0.03).alias("z"), *[F.lit(v).alias(c) for c, v in (("qx", 0.0), ("qy", 0.0), ("qz", 0.0), ("qw", 1.0))])
    links = constraints.adjacent(p, ["label"], "id", ["x", "y", "z"], 1_000_000_000)
    moved = [F.col(f"b_{c}") - F.col(f"a_{c}") for c in "xyz"]
    odo = links.select("label", *problem.factor_row("odometry", F.col("a_id"), F.col("b_id"), [*moved, *_fixed(0, 0, 0, 1)], [F.lit(0.02)] * 6))
    r = _ranges(spark, sf_dir).withColumns({c: F.col(c) * 0.4 for c in "xyz"}).withColumn("id", key)
    z = constraints.range_residual(vec("x", "y", "z"), vec("ax", "ay", "az"), F.lit(0.0))
    ranges = r.select("label", *problem.factor_row("anchor_range", F.col("id"), None, [z], [F.lit(0.1)], 1.5, vec("ax", "ay", "az")))
    return nodes, odo.unionByName(ranges)


@query("""SELECT label::BIGINT * 1000000000 + vec_id AS id, round(embedding[1]::DOUBLE * 4, 5) + 0.0 AS x, round(embedding[2]::DOUBLE * 4, 5) + 0.0 AS y, round(embedding[3]::DOUBLE * 4, 5) + 0.0 AS z, 0.0 AS turn, 0.0 AS cost FROM embeddings""")
def pose_graph(spark, sf_dir):
    """Poses from exact motions and ranges, which only the true ones fit; turn is the size of the rotation left."""
    nodes, factors = _chain(spark, sf_dir)
    found = solve.optimise_groups(factors, nodes, ["label"])
    turn = F.sqrt(F.col("qx") ** 2 + F.col("qy") ** 2 + F.col("qz") ** 2)
    return found.select("id", *[(F.round(c, 5) + 0.0).alias(c) for c in "xyz"], (r6(turn) + 0.0).alias("turn"), (r6("cost") + 0.0).alias("cost"))


@query()
def pose_marginals(spark, sf_dir):
    nodes, factors = _chain(spark, sf_dir)
    found = solve.optimise_groups(factors, nodes, ["label"], with_marginals=True)
    at = lambda r, c: F.get("covariance", F.lit(6 * r + c))
    return found.select("id", (at(3, 3) + at(4, 4) + at(5, 5)).alias("trace"), F.array(*[at(r, c) for r in (3, 4, 5) for c in (3, 4, 5)]).alias("sigma_pos"))


#: Sigmas of the climb between poses, of heights, of the first pose, and of rotations, which are held level: a tilt would explain part of a climb.
_CLIMB, _HEIGHT, _FIRST, _LEVEL = 0.05, 0.12, 0.3, 1e-4

_HEIGHTS = f"""WITH RECURSIVE n AS (
    SELECT label, label::BIGINT * 1000000000 + vec_id AS id, embedding[1]::DOUBLE AS h, embedding[2]::DOUBLE AS climb, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings
), up AS (
    SELECT label, k, h AS m, 1 / (1 / {_FIRST}::DOUBLE ** 2 + 1 / {_HEIGHT}::DOUBLE ** 2) AS p FROM n WHERE k = 1
    UNION ALL
    SELECT n.label, n.k, up.m + n.climb + (up.p + {_CLIMB}::DOUBLE ** 2) / (up.p + {_CLIMB}::DOUBLE ** 2 + {_HEIGHT}::DOUBLE ** 2) * (n.h - up.m - n.climb), 1 / (1 / (up.p + {_CLIMB}::DOUBLE ** 2) + 1 / {_HEIGHT}::DOUBLE ** 2)
    FROM up JOIN n ON n.label = up.label AND n.k = up.k + 1
), met AS (SELECT n.label, n.id, n.k, n.n, up.m, up.p, lead(n.climb) OVER (PARTITION BY n.label ORDER BY n.k) AS climb FROM n JOIN up ON up.label = n.label AND up.k = n.k),
down AS (
    SELECT label, k, m AS z, p AS variance FROM met WHERE k = n
    UNION ALL
    SELECT b.label, b.k, b.m + b.p / (b.p + {_CLIMB}::DOUBLE ** 2) * (d.z - b.m - b.climb), b.p + (b.p / (b.p + {_CLIMB}::DOUBLE ** 2)) ** 2 * (d.variance - b.p - {_CLIMB}::DOUBLE ** 2)
    FROM down d JOIN met b ON b.label = d.label AND b.k = d.k - 1
)
SELECT met.id, round(z, 6) + 0.0 AS z, round(variance, 9) AS variance FROM down JOIN met ON met.label = down.label AND met.k = down.k"""


def _climbs(spark, sf_dir):
    """Level poses per label, each with a height, the climb from one to the next, and a prior on the first; heights and climbs contradict each other."""
    rows = points(spark, sf_dir, ["h", "climb"]).withColumn("id", F.col("label").cast("long") * 1_000_000_000 + F.col("vec_id"))
    zero, level = [F.lit(0.0), F.lit(0.0)], _fixed(0, 0, 0, 1)
    links = constraints.adjacent(rows, ["label"], "id", ["climb"], 1_000_000_000)
    odometry = links.select("label", *problem.factor_row("odometry", F.col("a_id"), F.col("b_id"), [*zero, F.col("b_climb"), *level], [F.lit(_LEVEL)] * 3 + [F.lit(_CLIMB)] * 3))
    heights = rows.select("label", *problem.factor_row("height", F.col("id"), None, [F.col("h")], [F.lit(_HEIGHT)]))
    first = rows.groupBy("label").agg(F.min(F.struct("id", "h")).alias("f")).select("label", "f.*")
    prior = first.select("label", *problem.factor_row("pose_prior", F.col("id"), None, [*zero, F.col("h"), *level], [F.lit(_LEVEL)] * 3 + [F.lit(_FIRST)] * 3))
    nodes = rows.select("label", "id", F.lit(0.1).alias("x"), F.lit(-0.1).alias("y"), (F.col("h") + 0.2).alias("z"), *[v.alias(c) for c, v in zip(("qx", "qy", "qz", "qw"), level, strict=True)])
    return nodes, odometry.unionByName(heights).unionByName(prior)


def _z_and_variance(found):
    return found.select("id", (r6("z") + 0.0).alias("z"), F.round(F.get("covariance", F.lit(35)), 9).alias("variance"))


@query(_HEIGHTS)
def noisy_heights(spark, sf_dir):
    """Solution and marginals of contradicting measurements; the heights' part is linear, which a filter and smoother in SQL solve."""
    nodes, factors = _climbs(spark, sf_dir)
    return _z_and_variance(solve.optimise_groups(factors, nodes, ["label"], with_marginals=True))


@query(_HEIGHTS)
def noisy_heights_by_segments(spark, sf_dir):
    """The same as one problem, eliminated by segments of forty ids, level by level."""
    nodes, factors = _climbs(spark, sf_dir)
    segment = F.col("label").cast("long") * 64 + F.floor(F.col("id") % 1_000_000_000 / 40)
    return _z_and_variance(segmented.optimise(factors.drop("label"), nodes, segment, fan=64, tolerance=1e-7, with_marginals=True).nodes)


@query("SELECT DISTINCT label, 0.3 AS bias, 0.0 AS error FROM embeddings")
def range_bias_solved(spark, sf_dir):
    """Ranges that all read 0.3 too long: the bias that each label's chain finds, and the largest error of its poses."""
    nodes, factors = _chain(spark, sf_dir)
    bias = problem.BIAS_IDS + F.col("label")
    longer = F.when(F.col("kind") == "anchor_range", F.transform("meas", lambda z: z + 0.3)).otherwise(F.col("meas"))
    factors = factors.withColumns({"meas": longer, "c": F.when(F.col("kind") == "anchor_range", bias).cast("long")})
    labels = nodes.select("label").distinct()
    zero = [F.lit(0.0)] * 3
    prior = labels.select("label", *problem.factor_row("bias_prior", bias, None, [*zero, *_fixed(0, 0, 0, 1)], [*_fixed(1e-3, 1e-3, 1e-3, 100, 1e-3, 1e-3)]))
    start = labels.select("label", bias.cast("long").alias("id"), *[F.lit(0.0).alias(c) for c in ("x", "y", "z", "qx", "qy", "qz")], F.lit(1.0).alias("qw"))
    found = solve.optimise_groups(factors.unionByName(prior), nodes.unionByName(start), ["label"])
    truth = nodes.select("id", (F.col("x") - 0.05).alias("tx"), (F.col("y") + 0.05).alias("ty"), (F.col("z") - 0.03).alias("tz"))
    off = F.sqrt((F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2 + (F.col("z") - F.col("tz")) ** 2)
    poses = found.join(truth, "id").groupBy("label").agg((F.round(F.max(off), 4) + 0.0).alias("error"))
    return found.where(F.col("id") >= problem.BIAS_IDS).select("label", F.round("x", 4).alias("bias")).join(poses, "label")


_ARMS = ((10, 0.1, 0.0, 0.05), (20, -0.1, 0.02, 0.05), (30, 0.0, 0.1, 0.0))


@query(f"""
WITH nodes AS (SELECT user_id % 3 AS robot, epoch_us(ts) / 1e6 AS t, value / 100 AS v, (user_id % 3) * 1000000000 + row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts) - 1 AS id FROM events WHERE event_type = 'view'),
r AS (SELECT event_id, epoch_us(ts) / 1e6 AS t, user_id % 3 AS robot, CASE WHEN event_id % 2 = 0 THEN NULL ELSE (user_id + 1) % 3 END AS peer, event_id % 7 AS anchor, event_id % 2 = 0 AS fixed, value / 10 AS z, greatest(value / 500, 0.1) AS s
    FROM events WHERE event_type = 'purchase'),
a AS (SELECT * FROM (SELECT r.*, n.id AS a, n.v AS va, abs(r.t - n.t) AS ga, row_number() OVER (PARTITION BY r.event_id ORDER BY abs(r.t - n.t), n.t, n.id) AS k FROM r JOIN nodes n ON n.robot = r.robot) WHERE k = 1 AND ga <= 1800),
b AS (SELECT * FROM (SELECT a.event_id, n.id AS b, n.v AS vb, abs(a.t - n.t) AS gb, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - n.t), n.t, n.id) AS j FROM a JOIN nodes n ON n.robot = a.peer) WHERE j = 1 AND gb <= 1800),
arm(robot, x) AS (VALUES (0, 0.1::DOUBLE), (1, -0.1::DOUBLE), (2, 0.0::DOUBLE))
SELECT 'ma_anchor_range' AS kind, a.a, NULL::BIGINT AS b, round(z - 0.14, 6) AS z, round(sqrt(s * s + (va * ga) ** 2), 4) AS sigma, arm.x AS arm_a, NULL::DOUBLE AS arm_b FROM a JOIN arm USING (robot) WHERE fixed AND anchor < 5 AND robot IN (0, 1)
UNION ALL SELECT 'ma_inter_range', a.a, b.b, round(z - 0.14, 6), round(sqrt(s * s + (va * ga) ** 2 + (vb * gb) ** 2), 4), m.x, n.x
FROM a JOIN b USING (event_id) JOIN arm m ON m.robot = a.robot JOIN arm n ON n.robot = a.peer WHERE NOT fixed AND (least(a.robot, peer), greatest(a.robot, peer)) IN ((0, 1), (1, 2))""")
def range_factors(spark, sf_dir):
    """Range constraints from a log: both ends matched to nodes, anchors and antenna arms looked up, pairs and robots as configured, sigma with motion."""
    e = events(spark, sf_dir).withColumn("s", F.col("t") / 1e6)
    nodes = problem.numbered(of_type(e, "view").select((F.col("user_id") % 3).cast("int").alias("robot"), F.col("s").alias("t"), (F.col("value") / 100).alias("v")))
    fixed = F.col("event_id") % 2 == 0
    tag = lambda c: (c % 3 * 10 + 10).cast("int")
    ranges = of_type(e, "purchase").select(F.col("s").alias("timestamp"), tag(F.col("user_id")).alias("from_id"), F.when(fixed, (F.col("event_id") % 7).cast("int")).otherwise(tag(F.col("user_id") + 1)).alias("to_id"), (F.col("value") / 10).alias("range"), (F.col("value") / 500).alias("std"), (F.col("value") / 10).alias("gt_range"), F.when(fixed, "anchor").otherwise("inter").alias("kind"))
    config = constraints.Config(use_moment_arm=True, range_tolerance=1800.0, range_sigma_floor=0.1, anchor_robots=(0, 1), inter_pairs=((1, 0), (2, 1)))
    anchors = _anchors(spark).toDF("id", "x", "y", "z")
    arms = spark.createDataFrame(list(_ARMS), "id int, x double, y double, z double")
    found = problem.range_rows(nodes, ranges, anchors, arms, config)
    one = lambda c: F.get(c, F.lit(0))
    return found.select("kind", "a", "b", r6(one("meas")).alias("z"), F.round(one("sigma"), 4).alias("sigma"), one("arm_a").alias("arm_a"), one("arm_b").alias("arm_b"))


_WHOLE_TRACKS = _TRACKS.replace(f" AND gap <= {2 * DAY}", "")


@query(f"""
WITH {_WHOLE_TRACKS}, {_YAW.format('user_id')}
SELECT p.event_id, round(cos(yaw) * (10 * cos(value / 20)) - sin(yaw) * (10 * sin(value / 20)) + tx, 9) AS x, round(sin(yaw) * (10 * cos(value / 20)) + cos(yaw) * (10 * sin(value / 20)) + ty, 9) AS y, round(value / 100 + tz, 9) AS z,
    round(abs(sin((yaw + value / 100) / 2)), 9) AS qz FROM p JOIN fit USING (user_id)""")
def placed_nodes(spark, sf_dir):
    """Every node of every track in the truth's frame, by the best yaw and translation of its track."""
    e = events(spark, sf_dir)
    at = (10 * F.cos(F.col("value") / 20), 10 * F.sin(F.col("value") / 20), F.col("value") / 100)
    pose = lambda rows: rows.select(F.col("user_id").alias("robot"), "t", "event_id", *[c.alias(n) for c, n in zip(at, "xyz", strict=True)])
    half = F.col("value") / 200
    tracks = of_type(e, "purchase").select(F.col("user_id").alias("robot"), "t", F.col("event_id").alias("v"), *[c.alias(n) for c, n in zip(at, "xyz", strict=True)], F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"), F.cos(half).alias("qw"))
    nodes = problem.placed(problem.numbered(tracks), pose(of_type(e, "view")))
    return nodes.select(F.col("v").alias("event_id"), *[F.round(c, 9).alias(c) for c in "xyz"], F.round(F.abs("qz"), 9).alias("qz"))


@query("""
WITH p AS (SELECT user_id, arg_min(value, (ts, event_id)) AS a, min(ts) AS ts FROM events WHERE event_type = 'purchase' GROUP BY user_id),
h AS (SELECT * FROM (SELECT p.user_id, a, v.value AS b, row_number() OVER (PARTITION BY p.user_id ORDER BY abs(epoch_us(p.ts) - epoch_us(v.ts)), v.ts, 10 * cos(v.value / 20)) AS k FROM p JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view') WHERE k = 1),
y AS (SELECT user_id, (b - a) / 200 AS yaw, 10 * cos(a / 20) AS x, 10 * sin(a / 20) AS y, a / 100 AS z, 10 * cos(b / 20) AS dx, 10 * sin(b / 20) AS dy, b / 100 AS dz FROM h)
SELECT user_id AS robot, round(yaw, 6) AS yaw, round(dx - (cos(yaw) * x - sin(yaw) * y), 5) AS tx, round(dy - (sin(yaw) * x + cos(yaw) * y), 5) AS ty, round(dz - z, 5) AS tz FROM y""")
def first_pose_align(spark, sf_dir):
    """Heading and position that take each track's first pose to the truth nearest to it."""
    e = events(spark, sf_dir)
    at = (10 * F.cos(F.col("value") / 20), 10 * F.sin(F.col("value") / 20), F.col("value") / 100)
    half = F.col("value") / 400
    pose = lambda kind: of_type(e, kind).select(F.col("user_id").alias("robot"), "t", *[c.alias(n) for c, n in zip(at, "xyz", strict=True)], F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"), F.cos(half).alias("qw"))
    found = problem.first_pose_alignment(pose("purchase"), pose("view"))
    return found.select("robot", r6("yaw").alias("yaw"), *[F.round(c, 5).alias(c) for c in ("tx", "ty", "tz")])


@query("""SELECT min(id) AS id FROM (SELECT s_suppkey::INTEGER AS id, CASE WHEN s_suppkey < 40 THEN s_suppkey // 4 ELSE 1000 + s_suppkey END AS component FROM supplier)
GROUP BY component HAVING NOT bool_or(id IN (0, 8, 13))""")
def gauge_choice(spark, sf_dir):
    """Entities that carry the gauge: the first of each component of the pairs that may range each other, where none may range an anchor."""
    entities = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("id"))
    pairs = tuple((k + 1, k) for k in range(40) if k % 4 != 3)
    return constraints.gauge_entities(entities, constraints.Config(anchor_robots=(0, 8, 13), inter_pairs=pairs))


_UNIT = "sqrt(embedding[{0}]::DOUBLE ** 2 + embedding[{1}]::DOUBLE ** 2 + embedding[{2}]::DOUBLE ** 2)"


@query(f"""
WITH v AS (SELECT vec_id, embedding[1]::DOUBLE / n AS x, embedding[2]::DOUBLE / n AS y, embedding[3]::DOUBLE / n AS z, embedding[4]::DOUBLE / n AS w,
    embedding[5]::DOUBLE / {_UNIT.format(5, 6, 7)} AS a, embedding[6]::DOUBLE / {_UNIT.format(5, 6, 7)} AS b, embedding[7]::DOUBLE / {_UNIT.format(5, 6, 7)} AS c,
    embedding[8]::DOUBLE AS l, embedding[9]::DOUBLE AS m, embedding[10]::DOUBLE AS o
    FROM (SELECT *, sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2 + embedding[3]::DOUBLE ** 2 + embedding[4]::DOUBLE ** 2) AS n FROM embeddings)),
u AS (SELECT vec_id, l, m, o, a * (1 - 2 * (y * y + z * z)) + b * 2 * (x * y + z * w) + c * 2 * (x * z - y * w) AS p,
    a * 2 * (x * y - z * w) + b * (1 - 2 * (x * x + z * z)) + c * 2 * (y * z + x * w) AS q,
    a * 2 * (x * z + y * w) + b * 2 * (y * z - x * w) + c * (1 - 2 * (x * x + y * y)) AS r FROM v)
SELECT vec_id, round(m * r - o * q, 6) + 0.0 AS rx, round(o * p - l * r, 6) + 0.0 AS ry, round(l * q - m * p, 6) + 0.0 AS rz, round(p, 6) + 0.0 AS tx, round(q, 6) + 0.0 AS ty, round(r, 6) + 0.0 AS tz FROM u""")
def antenna_jacobian(spark, sf_dir):
    """How a range changes as the pose that carries the antenna turns and moves: the arm crossed with the direction seen in the body, and that direction."""
    e = lambda i: F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}")
    names = ["rx", "ry", "rz", "tx", "ty", "tz"]

    def run(batches):
        for pdf in batches:
            values = pdf[[f"e{i}" for i in range(10)]].to_numpy()
            unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
            found = factor_math.range_jacobian(lie.rotation_of(unit(values[:, :4])), unit(values[:, 4:7]), values[:, 7:10])
            yield pd.DataFrame(found, columns=names).assign(vec_id=pdf["vec_id"].to_numpy())[["vec_id", *names]]

    found = table(spark, sf_dir, "embeddings").select("vec_id", *[e(i) for i in range(10)]).mapInPandas(run, "vec_id long, " + ", ".join(f"{n} double" for n in names))
    return found.select("vec_id", *[(r6(n) + 0.0).alias(n) for n in names])


@query("SELECT (vec_id % 3)::INTEGER AS robot, vec_id::INTEGER AS i, vec_id::DOUBLE / 2 AS t, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, 0.0::DOUBLE AS qz, 1.0::DOUBLE AS qw FROM embeddings WHERE label > 1")
def trajectory_rows(spark, sf_dir):
    """Solved poses by robot and time; nodes of biases and anchors are none."""
    p = points(spark, sf_dir, ["x", "y", "z"]).withColumns({**{c: F.lit(0.0) for c in ("qx", "qy", "qz")}, "qw": F.lit(1.0), "id": F.col("vec_id")})
    robot = F.when(F.col("label") > 1, (F.col("vec_id") % 3).cast("int"))
    nodes = p.select("id", robot.alias("robot"), F.col("vec_id").cast("int").alias("i"), (F.col("vec_id") / 2).alias("t"))
    return problem.trajectory(p, nodes)


@query("""
WITH n AS (SELECT user_id % 3 AS robot, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts) - 1 AS i FROM events WHERE event_type = 'view'),
nodes AS (SELECT robot * 1000000000 + i AS id, robot, t, i FROM n),
odometry AS (SELECT * FROM (SELECT id AS a, lead(id) OVER w AS b, lead(t) OVER w - t AS gap FROM nodes WINDOW w AS (PARTITION BY robot ORDER BY t)) WHERE gap <= 3600),
r AS (SELECT event_id, epoch_us(ts) / 1e6 AS t, user_id % 3 AS robot, CASE WHEN event_id % 2 = 0 THEN NULL ELSE (user_id + 1) % 3 END AS peer, event_id % 7 AS anchor FROM events WHERE event_type = 'purchase'),
a AS (SELECT * FROM (SELECT r.*, n.id AS a, abs(r.t - n.t) AS ga, row_number() OVER (PARTITION BY r.event_id ORDER BY abs(r.t - n.t), n.t, n.id) AS k FROM r JOIN nodes n ON n.robot = r.robot) WHERE k = 1 AND ga <= 1800),
b AS (SELECT * FROM (SELECT a.event_id, n.id AS b, abs(a.t - n.t) AS gb, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - n.t), n.t, n.id) AS j FROM a JOIN nodes n ON n.robot = a.peer) WHERE j = 1 AND gb <= 1800),
ranged AS (
    SELECT a, 1000000000000000 + anchor AS b, 2000000000000000 + robot AS c FROM a WHERE peer IS NULL AND anchor < 5 AND robot = 0
    UNION ALL SELECT a, b, 2000000000000000 + robot FROM a JOIN b USING (event_id) WHERE least(robot, peer) = 0 AND greatest(robot, peer) = 1),
h AS (SELECT user_id % 3 AS robot, epoch_us(ts) / 1e6 AS t FROM events WHERE event_type = 'click'),
height AS (SELECT id AS a FROM nodes n WHERE EXISTS (SELECT 1 FROM h WHERE h.robot = n.robot AND abs(h.t - n.t) <= 3600)),
gauge AS (SELECT id AS a FROM nodes WHERE robot = 2 AND i = 0),
touched AS (SELECT a AS id FROM odometry UNION SELECT b FROM odometry UNION SELECT a FROM ranged UNION SELECT b FROM ranged UNION SELECT a FROM height UNION SELECT a FROM gauge),
rows AS (
    SELECT 'odometry' AS kind, a, b, NULL::BIGINT AS c, 0.0041::DOUBLE AS sigma FROM odometry
    UNION ALL SELECT 'inter_range', a, b, c, NULL FROM ranged
    UNION ALL SELECT 'height', a, NULL, NULL, NULL FROM height
    UNION ALL SELECT 'pose_prior', a, NULL, NULL, 0.001 FROM gauge
    UNION ALL SELECT 'pose_prior', id, NULL, NULL, 10 FROM nodes WHERE id NOT IN (SELECT id FROM touched)
    UNION ALL SELECT 'gravity', id, NULL, NULL, NULL FROM nodes
    UNION ALL SELECT DISTINCT 'bias_prior', c, NULL::BIGINT, NULL::BIGINT, 1.0 FROM ranged
    UNION ALL SELECT DISTINCT 'anchor_pin', b, NULL::BIGINT, NULL::BIGINT, 0.0001 FROM ranged WHERE b >= 1000000000000000)
SELECT kind, a, b, c, sigma FROM rows""")
def problem_rows(spark, sf_dir):
    """Every constraint of a whole problem: motions, heights, ranges with biases and anchors as unknowns, their priors, tilt, the gauge of the robot that nothing grounds, and weak priors; the sigma of the last component where it is fixed."""
    e = events(spark, sf_dir).withColumn("s", F.col("t") / 1e6)
    robot = (F.col("user_id") % 3).cast("int").alias("robot")
    level = [F.lit(v).alias(c) for c, v in (("qx", 0.0), ("qy", 0.0), ("qz", 0.0), ("qw", 1.0))]
    tracks = of_type(e, "view").select(robot, F.col("s").alias("t"), (F.col("value") / 10).alias("x"), (F.col("event_id") % 50 / 10).alias("y"), F.lit(1.0).alias("z"), *level, F.lit(0.0).alias("v"))
    fixed = F.col("event_id") % 2 == 0
    tag = lambda c: (c % 3 * 10 + 10).cast("int")
    ranges = of_type(e, "purchase").select(F.col("s").alias("timestamp"), tag(F.col("user_id")).alias("from_id"), F.when(fixed, (F.col("event_id") % 7).cast("int")).otherwise(tag(F.col("user_id") + 1)).alias("to_id"), (F.col("value") / 10).alias("range"), F.lit(0.1).alias("std"), (F.col("value") / 10).alias("gt_range"), F.when(fixed, "anchor").otherwise("inter").alias("kind"))
    heights = of_type(e, "click").select(robot, F.col("s").alias("t"), F.lit(1.0).alias("h"))
    config = constraints.Config(bias_mode="online", pin_anchors=True, use_height=True, range_tolerance=1800.0, max_odometry_gap=3600.0, anchor_robots=(0,), inter_pairs=((1, 0),))
    found = problem.build(tracks, tracks.drop("v"), ranges, _anchors(spark).toDF("id", "x", "y", "z"), config, heights=heights).factors
    last = F.when(F.col("kind") == "bias_prior", F.get("sigma", F.lit(3))).when(F.col("kind").isin("odometry", "pose_prior", "anchor_pin"), F.get("sigma", F.lit(5)))
    return found.select("kind", "a", "b", "c", last.alias("sigma"))
