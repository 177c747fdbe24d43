"""From logs to a solvable problem: constraint rows out of tracks, ranges and heights.

Tracks are (robot int, t, x, y, z, qx, qy, qz, qw, v double): odometry poses in a frame per robot.
Everything up to the rows is joins and expressions; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.functions.geometry import minus, plus, rotate, times, vec
from marram.operators import alignment, cleaning, constraints
from marram.operators.asof import TRACK_SLOT, nearest_asof, nearest_to_first
from marram.operators.constraints import Config
from marram.session import Workspace

#: Sigmas of odometry, tilt, gauge, per-robot and weak priors, heights; all in radians and metres.
ODOMETRY_SIGMA = (0.0124, 0.0041)
TILT_SIGMA, GAUGE_SIGMA, PRIOR_SIGMA, WEAK_SIGMA = 0.0114, (1e-3, 1e-3), (0.1, 0.3), (5.0, 10.0)
HEIGHT_SIGMA, HEIGHT_HUBER = 0.12, 1.5
PIN_SIGMA = 1e-4
#: The five degrees of a bias' node that are not the bias.
HELD_SIGMA = 1e-3
#: Node ids leave room for so many nodes a robot; nodes of anchors and biases come after all poses, since they are linked to many.
ROOM = 1_000_000_000
ANCHOR_IDS, BIAS_IDS = ROOM * 1_000_000, ROOM * 2_000_000

_QUAT = ("qx", "qy", "qz", "qw")
_POSE = ("x", "y", "z", *_QUAT)


def multiply(a, b):
    """Product of quaternions xyzw."""
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return (aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw, aw * bw - ax * bx - ay * by - az * bz)


def conjugate(q):
    x, y, z, w = q
    return -x, -y, -z, w


def numbered(tracks: DataFrame) -> DataFrame:
    """Tracks with i (0-based in time order) and id."""
    i = F.row_number().over(Window.partitionBy("robot").orderBy("t")) - 1
    return tracks.withColumn("i", i).withColumn("id", F.col("robot").cast("long") * ROOM + F.col("i"))


def _heading(q) -> Column:
    """Rotation about z of a unit quaternion: the angle of the first column."""
    x, y, z, w = q
    return F.atan2(2 * (x * y + z * w), 1 - 2 * (y * y + z * z))


def first_pose_alignment(nodes: DataFrame, truth: DataFrame) -> DataFrame:
    """robot, yaw, tx, ty, tz that take each robot's first node to the truth nearest to it: heading and position."""
    left = nodes.select("robot", "t", *_POSE)
    right = truth.select("robot", F.col("t").alias("rt"), *[F.col(c).alias(f"d{c}") for c in _POSE])
    hit = nearest_to_first(left, right, ["robot"], "t", "rt", list(_POSE), [f"d{c}" for c in _POSE])
    there, here = (tuple(F.col(f"{s}{c}") for c in _QUAT) for s in ("d", ""))
    turned = hit.withColumn("yaw", _heading(there) - _heading(here))
    cos, sin = F.cos("yaw"), F.sin("yaw")
    return turned.select("robot", "yaw", (F.col("dx") - (cos * F.col("x") - sin * F.col("y"))).alias("tx"), (F.col("dy") - (sin * F.col("x") + cos * F.col("y"))).alias("ty"), (F.col("dz") - F.col("z")).alias("tz"))


def placed(nodes: DataFrame, truth: DataFrame, config: Config | None = None) -> DataFrame:
    """Nodes moved to the truth's frame (robot, t, x, y, z, and a quaternion for the first pose): the start of the search.

    By the best yaw and translation of each robot's track, by its best rotation and translation, or
    by its first pose alone, as the configuration says.
    """
    config = config or Config()
    if config.start == "first_pose":
        moved = nodes.join(first_pose_alignment(nodes, truth), "robot")
    else:
        right = truth.select("robot", F.col("t").alias("rt"), *[F.col(c).alias(d) for c, d in zip("xyz", alignment.DST, strict=True)])
        left = nodes.select("robot", "t", *[F.col(c).alias(s) for c, s in zip("xyz", alignment.SRC, strict=True)])
        pairs = nearest_asof(left, right, ["robot"], "t", "rt", list(alignment.DST), slot=TRACK_SLOT)
        fit = alignment.yaw_alignment(pairs, ["robot"]) if config.yaw_only else alignment.similarity_alignment(pairs, ["robot"], False)
        moved = nodes.join(fit.drop("n"), "robot")
    if config.start == "first_pose" or config.yaw_only:
        turn = (F.lit(0.0), F.lit(0.0), F.sin(F.col("yaw") / 2), F.cos(F.col("yaw") / 2))
        position = alignment.turned("x", "y", "z")
    else:
        turn = tuple(F.get("quaternion", F.lit(i)) for i in range(4))
        position = plus(times(F.col("rotation"), vec("x", "y", "z")), tuple(F.get("translation", F.lit(i)) for i in range(3)))
    at = dict(zip(_POSE, (*position, *multiply(turn, vec(*_QUAT))), strict=True))
    return moved.select("robot", "i", "id", "t", "v", *[c.alias(n) for n, c in at.items()])


@dataclass
class Problem:
    nodes: DataFrame
    factors: DataFrame
    stats: DataFrame


def factor_row(kind: str | Column, a: Column, b: Column | None, meas: list, sigma: list, huber: float = 0.0, point=None, arm_a=None, arm_b=None, c: Column | None = None) -> list[Column]:
    """Columns of solve.FACTOR."""
    array = lambda x: F.lit(None).cast("array<double>") if x is None else F.array(*x).cast("array<double>")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    node = lambda x: (F.lit(None) if x is None else x).cast("long")
    return [kind.alias("kind"), node(a).alias("a"), node(b).alias("b"), array(meas).alias("meas"), array(point).alias("point"), array(arm_a).alias("arm_a"), array(arm_b).alias("arm_b"), array(sigma).alias("sigma"), F.lit(float(huber)).alias("huber"), node(c).alias("c")]


def _six(sigma: tuple[float, float], times: float = 1.0) -> list[Column]:
    return [F.lit(sigma[0])] * 3 + [F.lit(sigma[1] * times)] * 3


def measurement(config: Config) -> tuple[Column, Column]:
    """Range and its sigma from columns timestamp, from_id, to_id, range, std, gt_range and kind: measured, true or injected."""
    floor = cleaning.measured_sigma(F.col("std"), config.range_sigma_floor, config.sigma_override)
    if config.injected is not None:
        key = F.concat_ws("|", F.lit(str(config.injected.get("seed", 0))), F.col("timestamp").cast("string"), F.col("from_id").cast("string"), F.col("to_id").cast("string"))
        z = cleaning.injected_range(F.col("gt_range"), F.col("kind"), key, config.injected.get("sigma", 0.0), config.injected.get("bias", False), config.injected.get("outlier", False))
        return cleaning.measured_range(z, False, False, 0.0, True), floor
    z = cleaning.measured_range(F.lit(None).cast("double"), config.use_true_range, config.bias_mode == "const", config.range_bias, False)
    return z, F.lit(config.true_range_sigma) if config.use_true_range else floor


def range_rows(nodes: DataFrame, ranges: DataFrame, anchors: DataFrame, arms: DataFrame | None, config: Config) -> DataFrame | None:
    """Range constraints. Every range_every-th raw row counts; both ends must lie within the tolerance of a node.

    A range of an antenna without an arm in ``arms`` is an error where arms are modelled: it would
    otherwise be solved as if there were none. With bias_mode "online" the asking robot's bias is a
    node of the constraint; with pin_anchors so is the anchor.
    """
    rows = cleaning.every_kth(ranges, config.range_every, [], ["timestamp", "from_id", "to_id"]) if config.range_every > 1 else ranges
    of = lambda tag: F.floor(F.col(tag) / 10).cast("int") - 1
    rows = rows.where("from_id >= 10").withColumns({"robot": of("from_id"), "peer": F.when(F.col("to_id") >= 10, of("to_id"))})
    near = nodes.select("robot", F.col("t").alias("nt"), F.col("id").alias("a"), F.col("v").alias("va"))
    keep = ["timestamp", "from_id", "to_id", "range", "std", "gt_range", "kind", "robot", "peer"]
    rows = nearest_asof(rows.select(*keep), near, ["robot"], "timestamp", "nt", ["a", "va"], config.range_tolerance).withColumnRenamed("gap", "ga").drop("matched_on")
    z, floor = measurement(config)
    armed, online = config.use_moment_arm, config.bias_mode == "online"
    bias = F.lit(BIAS_IDS) + F.col("robot") if online else None
    if armed:
        arm = lambda side, key: arms.select(F.col("id").alias(key), *[F.col(c).alias(f"{side}{c}") for c in "xyz"])
        missing = F.raise_error(F.format_string("antenna %s has no arm", F.col("from_id")))
        rows = rows.join(arm("la", "from_id"), "from_id", "left").withColumn("lax", F.when(F.col("lax").isNull(), missing.cast("double")).otherwise(F.col("lax")))
    la = vec("lax", "lay", "laz") if armed else None
    slip = lambda v, gap: F.col(v) * F.col(gap) if config.motion_sigma else F.lit(0.0)
    kind = lambda k: constraints.range_factor_kind(config, F.lit(k))
    out = []
    if config.use_ranges and config.use_anchor:
        to = rows.where("kind = 'anchor'").join(anchors.select(F.col("id").alias("to_id"), *[F.col(c).alias(f"p{c}") for c in "xyz"]), "to_id")
        if config.anchor_robots is not None:
            to = to.where(F.col("robot").isin(list(config.anchor_robots)))
        sigma = cleaning.with_motion(floor, slip("va", "ga"))
        if config.pin_anchors and not armed:
            out.append(to.select(*factor_row("inter_range" if online else "native_range", F.col("a"), F.lit(ANCHOR_IDS) + F.col("to_id"), [z], [sigma], config.huber, c=bias)))
        else:
            out.append(to.select(*factor_row(kind("anchor") if armed else "anchor_range", F.col("a"), None, [z], [sigma], config.huber, vec("px", "py", "pz"), la, c=bias)))
    if config.use_ranges and config.use_inter:
        to = rows.where("kind = 'inter'")
        if config.inter_pairs is not None:
            pairs = ranges.sparkSession.createDataFrame([tuple(p) for p in config.inter_pairs], "p int, q int")
            to = constraints.allowed_pairs(to, "robot", "peer", pairs)
        there = nodes.select(F.col("robot").alias("peer"), F.col("t").alias("nt"), F.col("id").alias("b"), F.col("v").alias("vb"))
        to = nearest_asof(to, there, ["peer"], "timestamp", "nt", ["b", "vb"], config.range_tolerance).withColumnRenamed("gap", "gb")
        if armed:
            to = to.join(arm("lb", "to_id"), "to_id", "left").withColumn("lbx", F.when(F.col("lbx").isNull(), F.raise_error(F.format_string("antenna %s has no arm", F.col("to_id"))).cast("double")).otherwise(F.col("lbx")))
        sigma = cleaning.with_motion(floor, slip("va", "ga"), slip("vb", "gb"))
        out.append(to.select(*factor_row(kind("inter"), F.col("a"), F.col("b"), [z], [sigma], config.huber, None, la, vec("lbx", "lby", "lbz") if armed else None, c=bias)))
    return _union(out)


def _union(parts: list[DataFrame]) -> DataFrame | None:
    whole = None
    for p in parts:
        if p is not None:
            whole = p if whole is None else whole.unionByName(p)
    return whole


def _scalar_nodes(ids: DataFrame, x: Column, y: Column | None = None, z: Column | None = None) -> DataFrame:
    """Rows of Problem.nodes for unknowns that are no robot's pose, from (id, ...)."""
    zero, none = F.lit(0.0), F.lit(None)
    return ids.select("id", x.cast("double").alias("x"), (zero if y is None else y).alias("y"), (zero if z is None else z).alias("z"), *[zero.alias(c) for c in _QUAT[:3]], F.lit(1.0).alias("qw"), none.cast("int").alias("robot"), none.cast("int").alias("i"), none.cast("double").alias("t"))


def build(tracks: DataFrame, truth: DataFrame, ranges: DataFrame, anchors: DataFrame, config: Config | None = None, arms: DataFrame | None = None, heights: DataFrame | None = None) -> Problem:
    """The whole problem: odometry, tilt, heights, ranges, biases, pinned anchors, gauge and weak priors.

    heights: robot, t, h. Nodes, ranges and constraints are read several times below, so each is
    written to the shared folder once instead of being derived again.
    """
    config, work = config or Config(), Workspace(tracks.sparkSession)
    raw = numbered(tracks)
    nodes = work.keep(placed(raw, truth, config))
    links = constraints.adjacent(raw, ["robot"], "t", ["id", *_POSE], config.max_odometry_gap)
    qa, qb = (tuple(F.col(f"{s}_{c}") for c in _QUAT) for s in "ab")
    d = minus(tuple(F.col(f"b_{c}") for c in "xyz"), tuple(F.col(f"a_{c}") for c in "xyz"))
    step = [*rotate(conjugate(qa), d), *multiply(conjugate(qa), qb)]
    odometry = links.select(*factor_row("odometry", F.col("a_id"), F.col("b_id"), step, _six(ODOMETRY_SIGMA)))
    here = [F.col(c) for c in _POSE]
    first = nodes.where("i = 0")
    touching = [odometry]
    if config.gauge_per_robot:
        touching.append(first.select(*factor_row("pose_prior", F.col("id"), None, here, _six(PRIOR_SIGMA))))
    if config.prior_every:
        last = F.max("i").over(Window.partitionBy("robot"))
        inner = nodes.withColumn("last", last).where((F.col("i") > 0) & (F.col("i") < F.col("last")) & (F.col("i") % config.prior_every == 0))
        touching.append(inner.select(*factor_row("pose_prior", F.col("id"), None, here, _six(PRIOR_SIGMA, 3.0))))
    if config.use_height and heights is not None:
        right = heights.select("robot", F.col("t").alias("ht"), "h")
        met = nearest_asof(nodes.where(F.col("i") % config.height_every == 0).select("robot", "t", "id"), right, ["robot"], "t", "ht", ["h"], 2 * config.range_tolerance)
        touching.append(met.select(*factor_row("height", F.col("id"), None, [F.col("h")], [F.lit(HEIGHT_SIGMA)], HEIGHT_HUBER)))
    ranged = range_rows(nodes, ranges, anchors, arms, config)
    if ranged is not None:
        ranged = work.keep(ranged)
        touching.append(ranged)
    if not config.gauge_per_robot:
        entities = tracks.select(F.col("robot").alias("id")).distinct()
        targets = constraints.gauge_entities(entities, config).select(F.col("id").alias("robot"))
        touching.append(first.join(targets, "robot", "left_semi").select(*factor_row("pose_prior", F.col("id"), None, here, _six(GAUGE_SIGMA))))
    touching = work.keep(_union(touching))
    loose = constraints.untouched(nodes, [(touching, [["a"], ["b"]])], ["id"])
    weak = loose.select(*factor_row("pose_prior", F.col("id"), None, here, _six(WEAK_SIGMA)))
    rest, unknowns = [weak], [nodes.select("id", *_POSE, "robot", "i", "t")]
    if config.use_gravity:
        up = rotate(conjugate(vec(*_QUAT)), (F.lit(0.0), F.lit(0.0), F.lit(1.0)))
        rest.append(raw.select(*factor_row("gravity", F.col("id"), None, list(up), [F.lit(TILT_SIGMA)])))
    rigid = [F.lit(0.0)] * 3 + [F.lit(1.0)]
    if config.bias_mode == "online" and ranged is not None:
        used = ranged.select(F.col("c").alias("id")).where("id IS NOT NULL").distinct()
        unknowns.append(_scalar_nodes(used, F.lit(config.range_bias)))
        sigma = [*[F.lit(HELD_SIGMA)] * 3, F.lit(config.bias_sigma), *[F.lit(HELD_SIGMA)] * 2]
        rest.append(used.select(*factor_row("bias_prior", F.col("id"), None, [F.lit(0.0)] * 3 + rigid, sigma)))
    if config.pin_anchors and ranged is not None:
        used = ranged.where(F.col("b").between(ANCHOR_IDS, BIAS_IDS - 1)).select(F.col("b").alias("id")).distinct()
        used = used.join(anchors.select((F.lit(ANCHOR_IDS) + F.col("id")).cast("long").alias("id"), *"xyz"), "id")
        unknowns.append(_scalar_nodes(used, F.col("x"), F.col("y"), F.col("z")))
        rest.append(used.select(*factor_row("anchor_pin", F.col("id"), None, [F.col("x"), F.col("y"), F.col("z"), *rigid], _six((PIN_SIGMA, PIN_SIGMA)))))
    factors = _union([touching, *rest])
    return Problem(_union(unknowns), factors, constraints.stats(factors, ["kind"]))


def biases(solved: DataFrame) -> DataFrame:
    """robot, bias (four decimals) of a solution's nodes; none unless biases were unknowns."""
    rows = solved.where(F.col("id") >= BIAS_IDS)
    return rows.select((F.col("id") - BIAS_IDS).cast("int").alias("robot"), F.round("x", 4).alias("bias"))


def trajectory(solved: DataFrame, nodes: DataFrame) -> DataFrame:
    """robot, i, t and solved pose of the robots' nodes."""
    return solved.select("id", *_POSE).join(nodes.where("robot IS NOT NULL").select("id", "robot", "i", "t"), "id").select("robot", "i", "t", *_POSE)
