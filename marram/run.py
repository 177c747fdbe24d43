"""Whole runs: fuse and score, dump poses with covariance, map, compare weightings, export the viewer, prepare the front-end."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.operators import alignment, constraints, figures, maps, problem, segmented, solve, stereo, voxels
from marram.operators.asof import TRACK_SLOT, nearest_asof
from marram.operators.cleaning import first_rows
from marram.operators.constraints import Config
from marram.operators.problem import Problem
from marram.operators.ranks import ranked
from marram.operators.voxels import CELL, Occupancy
from marram.session import Workspace
from marram.sources import dimensions, logs, sinks

ROBOTS = ("ifo001", "ifo002", "ifo003")
#: Switches of the run whose poses feed the map.
DUMP_CONFIG = Config(use_moment_arm=True, bias_mode="off", range_sigma_floor=0.05)


@dataclass(frozen=True)
class Layout:
    """Where a data set's files lie."""

    root: str
    odometry: str

    @property
    def logs(self) -> str:
        return f"{self.root}/data"

    def config(self, name: str) -> str:
        return f"{self.root}/config/{name}"

    def track(self, seq: str, robot: str) -> str:
        return f"{self.odometry}/{seq}/{robot}/vio.csv"


@dataclass
class Inputs:
    tracks: DataFrame
    truth: DataFrame
    ranges: DataFrame
    anchors: DataFrame
    arms: DataFrame
    heights: DataFrame | None


def _all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def read_inputs(spark: SparkSession, at: Layout, seq: str, robots: tuple[str, ...] = ROBOTS, stride: int = 2, with_heights: bool = False) -> Inputs:
    """Logs and layouts of a sequence; robots are numbered in their order. A robot without a log has no rows."""
    shift = dimensions.timeshift(spark, f"{at.logs}/{seq}/timeshift.yaml")
    number = lambda df, k: df.withColumn("robot", F.lit(k))
    tracks = _all([number(logs.odometry(spark, at.track(seq, r), shift, stride), k) for k, r in enumerate(robots)])
    truth = _all([number(logs.ground_truth(spark, at.logs, seq, r), k) for k, r in enumerate(robots)]).withColumnRenamed("timestamp", "t")
    heights = None
    if with_heights:
        bias = at.config("height/bias.yaml")
        heights = _all([number(logs.heights(spark, at.logs, seq, r, dimensions.height_bias(spark, bias, r)), k) for k, r in enumerate(robots)]).withColumnRenamed("timestamp", "t")
    # Every table is read many times, and the truth is a fitted spline: each is made once.
    work = Workspace(spark)
    tracks, truth, heights = work.keep(tracks), work.keep(truth), None if heights is None else work.keep(heights)
    return Inputs(tracks, truth, work.keep(logs.ranges(spark, at.logs, seq, list(robots))), dimensions.anchors(spark, at.config("uwb/anchors.yaml"), seq), dimensions.tag_arms(spark, at.config("uwb/tags.yaml")), heights)


#: Nodes of a run that one task solves; a longer run is cut into segments of so many seconds.
TASK_NODES, SEGMENT_SECONDS = 20_000, 60.0


def solved(inputs: Inputs, config: Config, with_marginals: bool = False, most: int = 100, task_nodes: int = TASK_NODES, seconds: float = SEGMENT_SECONDS) -> tuple[Problem, DataFrame]:
    """The problem and its solved nodes, with cost, rounds and, if asked for, covariance.

    A run of up to ``task_nodes`` nodes is solved in one task, a longer one by segments of time,
    each where it lies; the solution is the same.
    """
    made = problem.build(inputs.tracks, inputs.truth, inputs.ranges, inputs.anchors, config, inputs.arms, inputs.heights)
    work = Workspace(inputs.tracks.sparkSession)
    made = replace(made, nodes=work.keep(made.nodes), factors=work.keep(made.factors))
    made = replace(made, stats=constraints.stats(made.factors, ["kind"]))
    if made.nodes.count() > task_nodes:
        found = segmented.optimise(made.factors, made.nodes, F.floor(F.col("t") / seconds), F.col("t"), most=most, with_marginals=with_marginals)
        return made, found.nodes.withColumns({"cost": F.lit(found.cost), "first_cost": F.lit(found.first_cost), "rounds": F.lit(found.rounds)})
    one = F.lit(0).alias("run")
    found = solve.optimise_groups(made.factors.select(one, "*"), made.nodes.select(one, "*"), ["run"], most, with_marginals=with_marginals)
    return made, found.drop("run")


def scored(tracks: DataFrame, truth: DataFrame, with_scale: bool = False) -> DataFrame:
    """robot, n, rmse of tracks (robot, t, x, y, z) against the truth nearest in time, after a rigid (or similarity) fit."""
    left = tracks.select("robot", "t", *[F.col(c).alias(s) for c, s in zip("xyz", alignment.SRC, strict=True)])
    right = truth.select("robot", F.col("t").alias("rt"), *[F.col(c).alias(d) for c, d in zip("xyz", alignment.DST, strict=True)])
    pairs = nearest_asof(left, right, ["robot"], "t", "rt", list(alignment.DST), slot=TRACK_SLOT)
    return alignment.rmse(alignment.aligned_by_similarity(pairs, ["robot"], with_scale), ["robot"])


#: Pixels of a figure of tracks, and of errors in time.
FIGURE = (480, 480)


def figures_of(inputs: Inputs, fused: DataFrame, folder: str, seq: str, robots: tuple[str, ...] = ROBOTS) -> None:
    """<folder>/<seq>_<robot>_tracks.svg and <seq>_errors.svg: fitted tracks over the truth, and distances from it in time."""
    width, height = FIGURE
    pairs = []
    for name, tracks in (("odometry", inputs.tracks), ("fused", fused)):
        left = tracks.select("robot", "t", *[F.col(c).alias(s) for c, s in zip("xyz", alignment.SRC, strict=True)])
        right = inputs.truth.select("robot", F.col("t").alias("rt"), *[F.col(c).alias(d) for c, d in zip("xyz", alignment.DST, strict=True)])
        met = alignment.aligned_by_similarity(nearest_asof(left, right, ["robot"], "t", "rt", list(alignment.DST), slot=TRACK_SLOT), ["robot"], False)
        pairs.append(met.withColumn("name", F.lit(name)))
    work = Workspace(inputs.tracks.sparkSession)
    met = work.keep(_all(pairs))
    names = F.array(*map(F.lit, robots))
    label = F.concat_ws(" ", F.get(names, F.col("robot")), "name")
    low, high = met.agg(F.min("t"), F.max("t")).first()
    if low is not None:
        high = high if high > low else low + 1.0
        off = met.select(label.alias("series"), "t", F.col("error"))
        sinks.spans_svg(figures.spans(off, ["series"], "t", "error", low, high, width), "series", f"{folder}/{seq}_errors.svg", f"{seq}: distance from the truth", low, high, width)
    for k, robot in enumerate(robots):
        own = met.where(F.col("robot") == k)
        tracks = own.select("name", "t", F.col("ax").alias("x"), F.col("ay").alias("y")).unionByName(own.where("name = 'fused'").select(F.lit("truth").alias("name"), "t", F.col(alignment.DST[0]).alias("x"), F.col(alignment.DST[1]).alias("y")))
        x0, x1, y0, y1 = tracks.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        if x0 is not None:
            reach = max(x1 - x0, y1 - y0, 1e-6) / 2
            box = ((x0 + x1) / 2 - reach, (x0 + x1) / 2 + reach, (y0 + y1) / 2 - reach, (y0 + y1) / 2 + reach)
            sinks.trails_svg(figures.trails(tracks, ["name"], "t", "x", "y", box, width, height), "name", f"{folder}/{seq}_{robot}_tracks.svg", f"{seq}, {robot}: tracks from above", box, width, height)
    work.drop_all_but()


def report(inputs: Inputs, made: Problem, found: DataFrame, robots: tuple[str, ...] = ROBOTS) -> DataFrame:
    """robot (name), n, before, after, improve_pct: error of the odometry and of the fused tracks."""
    before = scored(inputs.tracks, inputs.truth).select("robot", F.col("rmse").alias("before"))
    after = scored(problem.trajectory(found, made.nodes), inputs.truth).withColumnRenamed("rmse", "after")
    gain = F.try_divide(100 * (F.col("before") - F.col("after")), F.col("before"))
    names = F.array(*map(F.lit, robots))
    return after.join(before, "robot").select(F.get(names, F.col("robot")).alias("robot"), "n", "before", "after", gain.alias("improve_pct"))


def fuse(spark: SparkSession, at: Layout, seq: str, out: str, config: Config | None = None, robots: tuple[str, ...] = ROBOTS) -> dict:
    """Build, solve, score against the truth and write <out>/<seq>_summary.json and figures; what the summary holds."""
    config = config or Config()
    inputs = read_inputs(spark, at, seq, robots, with_heights=config.use_height)
    made, found = solved(inputs, config)
    found = Workspace(spark).keep(found)
    summary = sinks.summary_json(report(inputs, made, found, robots), made.stats, f"{out}/{seq}_summary.json")
    figures_of(inputs, problem.trajectory(found, made.nodes), out, seq, robots)
    summary["biases"] = {robots[r["robot"]]: r["bias"] for r in problem.biases(found).collect()}
    return summary


def fused_poses(made: Problem, found: DataFrame, extrinsics: dict[int, list[float]], robots: tuple[str, ...] = ROBOTS) -> DataFrame:
    """Rows of schemas.DUMP: camera poses (body pose * extrinsic), the body's position, and its position covariance."""
    spark = found.sparkSession
    cameras = spark.createDataFrame([(k, [float(v) for v in m]) for k, m in extrinsics.items()], "robot int, camera array<double>")
    rows = found.join(made.nodes.where("robot IS NOT NULL").select("id", "robot", "i", "t"), "id").join(F.broadcast(cameras), "robot")
    x, y, z, w = (F.col(c) for c in ("qx", "qy", "qz", "qw"))
    body = [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), F.col("x")],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), F.col("y")],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y), F.col("z")],
        [F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)],
    ]
    m = lambda r, c: F.get("camera", F.lit(4 * r + c))
    camera = [sum((body[r][k] * m(k, c) for k in range(1, 4)), body[r][0] * m(0, c)) for r in range(4) for c in range(4)]
    sigma = [F.get("covariance", F.lit(6 * r + c)) for r in (3, 4, 5) for c in (3, 4, 5)]
    names = F.array(*map(F.lit, robots))
    return rows.select(F.get(names, F.col("robot")).alias("robot"), "i", "t", F.array(*camera).alias("pose"), (sigma[0] + sigma[4] + sigma[8]).alias("tr_sigma_pos"), F.struct("x", "y", "z").alias("p_body"), F.array(*sigma).alias("sigma_pos"))


def dump(spark: SparkSession, at: Layout, seq: str, path: str, anchor_free: bool = False, write: tuple[str, ...] = ROBOTS, robots: tuple[str, ...] = ROBOTS) -> DataFrame:
    """Solve with marginals and write the poses of the robots in ``write``; robot, low, middle, high of their covariance traces."""
    config = replace(DUMP_CONFIG, anchor_robots=()) if anchor_free else DUMP_CONFIG
    made, found = solved(read_inputs(spark, at, seq, robots), config, with_marginals=True)
    extrinsics = {k: dimensions.extrinsic(spark, at.config(f"vins/{r}/vins.yaml")) for k, r in enumerate(robots)}
    sinks.pose_dump(fused_poses(made, found, extrinsics, robots).where(F.col("robot").isin(list(write))), path)
    return voxels.trace_range(logs.poses(spark, path), ["robot"], "tr_sigma_pos")


def stereo_frames(images: DataFrame, calibrations: dict[str, dimensions.StereoCalibration], most: int = 96, reach: int = 3) -> DataFrame:
    """robot, t, u, v, disparity from raw grey images (robot, t, camera 0 or 1, v, u, grey), rectified first."""
    spark, sides = images.sparkSession, []
    dealt = images.repartition("robot", "t")
    for robot, k in calibrations.items():
        flat = stereo.rectification(k)
        own = dealt.where(F.col("robot") == robot)
        view = lambda camera, name, own=own, k=k, flat=flat: stereo.remapped(own.where(F.col("camera") == camera), ["robot", "t"], stereo.rectifying_map(spark, k, flat, camera)).select("robot", "t", "v", "u", F.round("grey").alias(name))
        sides.append(view(0, "left").join(view(1, "right"), ["robot", "t", "v", "u"]))
    return stereo.disparities(_all(sides), ["robot", "t"], most, reach)


def observations(poses: DataFrame, disparities: DataFrame, calibrations: dict[str, dimensions.StereoCalibration], c: Occupancy, stride: int = 2, most_frames: int | None = None, tolerance: float = 0.05, least_pixels: int = 100, step: int = 4, mates_within: float = 0.5, rectified: bool = False) -> DataFrame:
    """World points of every stride-th pose's stereo frame: robot, i, t, frame, o*, p*, tr, sigma_z, sigma_pos, mates.

    disparities: robot, t, u, v, disparity (pixels of rectified frames). A pose takes the frame
    nearest in time; frames with too few valid depths go; mates are the other robots' bodies at the
    time, a track without a pose near enough has none. frame numbers the poses in time over robots.
    ``rectified``: disparities are those of ``stereo_frames``, so points lie in the rectified
    camera's frame and are turned back into the raw one; else the cameras count as rectified.
    """
    spark = poses.sparkSession
    same_frame = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    flat = {r: stereo.rectification(k) for r, k in calibrations.items()} if rectified else {}
    rows = [(r, f.focal, f.focal, f.cx, f.cy, f.focal * f.baseline, list(f.rotations[0])) for r, f in flat.items()]
    rows = rows or [(r, *k.intrinsics[0], k.intrinsics[0][0] * k.baseline, same_frame) for r, k in calibrations.items()]
    intrinsics = F.broadcast(spark.createDataFrame(rows, "robot string, fx double, fy double, cx double, cy double, fb double, turned array<double>"))
    used = poses.where(F.col("i") % stride == 0)
    frames = disparities.select("robot", "t").distinct().select("robot", F.col("t").alias("ft"))
    met = nearest_asof(used, frames, ["robot"], "t", "ft", [], tolerance).drop("gap").withColumnRenamed("matched_on", "ft")
    bodies = poses.select(F.col("robot").alias("other"), F.col("t").alias("ot"), "p_body")
    names = F.array(*[F.lit(r) for r in calibrations])
    asks = met.select("robot", "i", "t", F.explode(F.filter(names, lambda n: n != F.col("robot"))).alias("other"))
    mates = nearest_asof(asks, bodies, ["other"], "t", "ot", ["p_body"], mates_within).groupBy("robot", "i").agg(F.collect_list("p_body").alias("mates"))
    pixels = disparities.withColumnRenamed("t", "ft").join(met, ["robot", "ft"]).join(intrinsics, "robot")
    z = F.when(~F.isnan("disparity") & (F.col("disparity") > 0), (F.col("fb") / F.col("disparity")).cast("float").cast("double"))
    pixels = pixels.withColumn("z", F.when(z.between(0.3, 5.0), z))
    pixels = voxels.sampled_frames(pixels, ["robot", "i"], F.col("z").isNotNull(), "v", "u", least_pixels, step)
    sigma = (F.col("z") * F.col("z") / F.col("fb")).cast("float").cast("double")
    at = lambda k: F.get("pose", F.lit(k))
    local = voxels.backproject(F.col("u"), F.col("v"), F.col("z"), F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"), F.col("turned") if rectified else None)
    point = voxels.to_world(F.array(*[at(4 * r + k) for r in range(3) for k in range(3)]), local, (at(3), at(7), at(11)))
    world = pixels.join(mates, ["robot", "i"], "left")
    out = world.select("robot", "i", "t", *[at(4 * k + 3).alias(n) for k, n in enumerate(("ox", "oy", "oz"))], *[x.alias(n) for x, n in zip(point, ("px", "py", "pz"), strict=True)], F.col("tr_sigma_pos").alias("tr"), sigma.alias("sigma_z"), "sigma_pos", "mates")
    frames_used = out.select("robot", "i", "t").distinct()
    if most_frames is not None:
        frames_used = first_rows(frames_used, most_frames, ["robot"], ["t"])
    return out.join(ranked(frames_used, ["robot", "i"], "frame").drop("t"), ["robot", "i"])


ORIGIN, POINT = ("ox", "oy", "oz"), ("px", "py", "pz")


def occupancy_map(points: DataFrame, c: Occupancy, chunk: int = 64) -> DataFrame:
    """ix, iy, iz, l from ``observations``: robots one after another, frames in time, a clamp after each frame."""
    evidence = voxels.integrate(points, c, ["frame"], ORIGIN, POINT, "mates", "sigma_pos")
    return voxels.clamped_fold(voxels.frame_evidence(evidence, ["frame"]), list(CELL), "frame", "value", c, chunk)


def slice_raster(cells: DataFrame, resolution: float, centre: float = 0.8, band: float = 0.15, bounds: tuple[float, float, float, float] = (-6.0, 8.0, -6.0, 8.0)) -> DataFrame:
    """Labels of a horizontal slice of a map (ix, iy, iz, l)."""
    centres = cells.select(*[((F.col(k) + 0.5) * resolution).alias(a) for k, a in zip(CELL, "xyz", strict=True)], maps.classify(F.col("l")).alias("label"))
    return maps.raster(centres, [], centre, band, resolution, bounds)


def compare(points: DataFrame, c: Occupancy, centre: float = 0.8) -> DataFrame:
    """suppressed, uniform_free, percent: what weighting takes from the free cells of a slice."""
    points = Workspace(points.sparkSession).keep(points)  # depths are made once for both maps
    rasters = [slice_raster(occupancy_map(points, replace(c, weighted=w)), c.resolution, centre) for w in (True, False)]
    return maps.suppressed_share(maps.difference(*rasters, ["gx", "gy"]))


def camera_tracks(points: DataFrame) -> DataFrame:
    """robot, t, x, y, z of the cameras that gave ``observations``."""
    return points.select("robot", "t", *[F.col(o).alias(a) for o, a in zip(ORIGIN, "xyz", strict=True)]).distinct()


def export(points: DataFrame, c: Occupancy, template: str, path: str, title: str, subtitle: str = "", most_free: int = 60_000) -> dict:
    """Map the points and write the viewer page; its payload."""
    spark = points.sparkSession
    points = Workspace(spark).keep(points)
    cells = occupancy_map(points, c).cache()
    try:
        scene = sinks.viewer_scene(cells, camera_tracks(points), c.resolution, most_free=most_free)
    finally:
        cells.unpersist()
    sinks.viewer_html(spark, dimensions.read_text(spark, template), scene, title, subtitle, path)
    return scene


def prepare(spark: SparkSession, at: Layout, seq: str, robot: str, out: str, camera: str = "infra1") -> None:
    """The front-end's settings and its list of frames of one robot."""
    calibration = dimensions.stereo_calibration(spark, at.config(f"realsense/{robot}/intrinsics.yaml"))
    sinks.write_text(spark, f"{out}/{robot}.yaml", sinks.front_end_settings(calibration))
    listing = logs.image_listing(spark, f"{at.logs}/{seq}/{robot}/{camera}")
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "").try_cast("double")
    sinks.image_list(listing.select(stem.alias("t"), "path"), f"{out}/{seq}_{robot}_list")

