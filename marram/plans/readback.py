"""Queries: tables written as sensor logs and read back by the library's readers, rows against the tables' own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.plans.registry import events, of_type, points, query, r6, table
from marram.session import Workspace
from marram.sources import dimensions, logs, schemas, sinks

SEQ = "flight_room"
ROBOTS = ("r0", "r1", "r2")


def _folder(spark) -> str:
    return Workspace(spark).folder()


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def _per_robot(read) -> DataFrame:
    """What ``read(robot)`` gives for each robot, with the robot."""
    return _union([read(robot).withColumn("robot", F.lit(robot)) for robot in ROBOTS])


def _logged(spark, sf_dir) -> DataFrame:
    """Events with a robot each and a time of their own."""
    robot = F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string"))
    return events(spark, sf_dir).withColumns({"robot": robot, "s": F.col("event_id") / 4})


_POSE = ["x", "y", "z", "qx", "qy", "qz", "qw"]


@query("""SELECT 'r' || label AS robot, vec_id::DOUBLE AS timestamp, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z,
embedding[4]::DOUBLE AS qx, embedding[5]::DOUBLE AS qy, embedding[6]::DOUBLE AS qz, embedding[7]::DOUBLE AS qw FROM embeddings WHERE label < 3""")
def read_truth(spark, sf_dir):
    """Tracks as files of a tracker, whose columns come in another order and with one more."""
    root, short = _folder(spark), {v: k for k, v in schemas.TRUTH_COLUMNS.items()}
    rows = points(spark, sf_dir, _POSE)
    for robot in ROBOTS:
        own = rows.where(F.concat(F.lit("r"), "label") == robot)
        own.select(F.lit("more").alias("note"), *[F.col(c).alias(short[c]) for c in reversed(_POSE)], F.col("vec_id").alias("timestamp")).write.csv(f"{root}/{SEQ}/{robot}/mocap.csv", header=True)
    return _per_robot(lambda robot: logs.ground_truth(spark, root, SEQ, robot, clean=False))


@query("""
SELECT event_id::DOUBLE / 4 AS timestamp, (user_id % 3 * 10 + 10)::INTEGER AS from_id, CASE WHEN event_id % 2 = 0 THEN event_id % 7 ELSE (user_id + 1) % 3 * 10 + 10 END::INTEGER AS to_id,
    value AS range, std, CASE WHEN event_id % 2 = 0 THEN 'anchor' ELSE 'inter' END AS kind
FROM (SELECT *, CASE WHEN event_id % 5 = 0 AND user_id % 3 = 2 THEN 0.125::DOUBLE ELSE (event_id % 10)::DOUBLE / 8 END AS std FROM events) WHERE std <= 0.5""")
def read_ranges(spark, sf_dir):
    """Ranges that each robot logs, some of them heard by the next robot too: the first in robot order counts, then the bound on std."""
    root, e = _folder(spark), _logged(spark, sf_dir)
    tag = lambda c: (c % 3 * 10 + 10).cast("int")
    to = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 7).cast("int")).otherwise(tag(F.col("user_id") + 1))
    rows = e.select("event_id", (F.col("user_id") % 3).alias("k"), F.col("s").alias("timestamp"), tag(F.col("user_id")).alias("from_id"), to.alias("to_id"), F.col("value").alias("range"), (F.col("event_id") % 10 / 8).alias("std"), F.col("value").alias("gt_range"), F.lit(0.0).alias("bias"))
    heard = rows.where("event_id % 5 = 0").withColumns({"k": (F.col("k") + 1) % 3, "std": F.lit(0.125)})
    both = rows.unionByName(heard)
    for k, robot in enumerate(ROBOTS):
        both.where(F.col("k") == k).drop("k", "event_id").write.csv(f"{root}/{SEQ}/{robot}/uwb_range.csv", header=True)
    return logs.ranges(spark, root, SEQ, [*ROBOTS, "none"]).select("timestamp", "from_id", "to_id", "range", "std", "kind")


#: A number, the key of a dict and the item of a list: the forms that a height's bias comes in.
_BIASES = "r0: 0.25\nr1: {0.5: old}\nr2: [0.75, 9]\n"


def _heights(spark, sf_dir) -> DataFrame:
    root, e = _folder(spark), _logged(spark, sf_dir)
    sinks.write_text(spark, f"{root}/bias.yaml", _BIASES)
    for robot in ROBOTS:
        e.where(F.col("robot") == robot).select(F.col("value").alias("range"), F.col("s").alias("timestamp")).write.csv(f"{root}/{SEQ}/{robot}/height.csv", header=True)
    return _per_robot(lambda robot: logs.heights(spark, root, SEQ, robot, dimensions.height_bias(spark, f"{root}/bias.yaml", robot)))


_H = "SELECT 'r' || user_id % 3 AS robot, event_id::DOUBLE / 4 AS timestamp, round(value - 0.25 * (user_id % 3 + 1), 6) AS h FROM events"


@query(_H)
def read_heights(spark, sf_dir):
    return _heights(spark, sf_dir).select("robot", "timestamp", r6("h").alias("h"))


@query(f"{_H} ORDER BY event_id LIMIT 25")
def earliest_heights(spark, sf_dir):
    """The first heights of all robots in time."""
    return logs.by_time(_heights(spark, sf_dir), "timestamp", 25).select("robot", "timestamp", r6("h").alias("h"))


@query("""
SELECT round(t, 6) AS t, value AS x, user_id::DOUBLE AS y, event_id::DOUBLE AS z, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, 0.0::DOUBLE AS qz, 1.0::DOUBLE AS qw, round(sqrt(5 * value ** 2 + user_id ** 2), 6) AS v
FROM (SELECT *, event_id::DOUBLE / 1000 - 1.25 AS t, row_number() OVER (ORDER BY event_id) AS n FROM events) WHERE n % 2 = 1""")
def read_odometry(spark, sf_dir):
    """A file without a header, shifted in time by a calibration's two terms; every second row counts."""
    root, f = _folder(spark), F.lit
    sinks.write_text(spark, f"{root}/shift.yaml", "timeshift_s: 1\ntimeshift_ns: 250000000\n")
    rows = events(spark, sf_dir).select(F.col("event_id") * 1_000_000, "value", F.col("user_id").cast("double"), F.col("event_id").cast("double"), f(1.0), f(0.0), f(0.0), f(0.0), "value", F.col("value") * 2, F.col("user_id").cast("double"))
    rows.toDF(*[field.name for field in schemas.ODOMETRY]).write.csv(f"{root}/vio.csv", header=False)
    found = logs.odometry(spark, f"{root}/vio.csv", dimensions.timeshift(spark, f"{root}/shift.yaml"), 2)
    return found.select(r6("t").alias("t"), *_POSE, r6("v").alias("v"))


def _keyframe_line(rows: DataFrame) -> DataFrame:
    """Eight numbers between blanks of any kind, with an empty line after some of them."""
    number = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit("  "), number("s"), F.lit(" "), number("value"), F.lit("\t"), number("user_id"), F.lit("   "), number("event_id"), F.lit(" 0 0 0.0 1 "))
    return rows.select(F.concat(line, F.when(F.col("event_id") % 3 == 0, "\n").otherwise("")).alias("value"))


@query("SELECT event_id::DOUBLE / 4 AS t, value AS x, user_id::DOUBLE AS y, event_id::DOUBLE AS z, 0.0::DOUBLE AS qx, 0.0::DOUBLE AS qy, 0.0::DOUBLE AS qz, 1.0::DOUBLE AS qw FROM events")
def read_keyframes(spark, sf_dir):
    path = f"{_folder(spark)}/keyframes.txt"
    _keyframe_line(_logged(spark, sf_dir)).write.text(path)
    return logs.keyframes(spark, path)


@query("SELECT event_type AS robot, count(*) AS n FROM events WHERE value > 40 GROUP BY event_type HAVING count(*) >= 20")
def enough_keyframes(spark, sf_dir):
    """Keyframes of each robot's file; robots with too few, and the one without a file, are left out."""
    root, e = _folder(spark), _logged(spark, sf_dir)
    kinds = [r[0] for r in e.select("event_type").distinct().collect()]  # a handful, one file each
    for kind in kinds:
        _keyframe_line(of_type(e, kind).where("value > 40")).write.text(f"{root}/{kind}.txt")
    found = logs.enough_keyframes(spark, {k: f"{root}/{k}.txt" for k in [*kinds, "none"]})
    return spark.createDataFrame(sorted(found.items()), "robot string, n long")


@query("SELECT event_id::DOUBLE / 8 AS t, event_type || '/' || event_id || ' left.jpeg' AS path FROM events")
def image_list_back(spark, sf_dir):
    """A list of images as the front-end reads it, written and read again."""
    path = f"{_folder(spark)}/images.txt"
    rows = events(spark, sf_dir).select((F.col("event_id") / 8).alias("t"), F.concat("event_type", F.lit("/"), "event_id", F.lit(" left.jpeg")).alias("path"))
    sinks.image_list(rows, path)
    return logs.image_list(spark, path)


@query("""
SELECT 'r' || label AS robot, vec_id::INTEGER AS i, vec_id::DOUBLE / 2 AS t, round(list_sum(embedding[1:16]::DOUBLE[]), 6) AS pose_sum, embedding[17]::DOUBLE AS tr_sigma_pos,
    embedding[CASE WHEN vec_id % 2 = 0 THEN 20 ELSE 4 END]::DOUBLE AS bx, embedding[CASE WHEN vec_id % 2 = 0 THEN 21 ELSE 8 END]::DOUBLE AS by, embedding[CASE WHEN vec_id % 2 = 0 THEN 22 ELSE 12 END]::DOUBLE AS bz FROM embeddings""")
def pose_dump_back(spark, sf_dir):
    """A dump of poses by robot, read back; a missing body position is the pose's own."""
    path = f"{_folder(spark)}/dump"
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    body = F.when(F.col("vec_id") % 2 == 0, F.struct(*[at(19 + k).alias(c) for k, c in enumerate("xyz")]))
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("r"), "label").alias("robot"), F.col("vec_id").cast("int").alias("i"), (F.col("vec_id") / 2).alias("t"), F.array(*[at(i) for i in range(16)]).alias("pose"), at(16).alias("tr_sigma_pos"), body.alias("p_body"), F.lit(None).cast("array<double>").alias("sigma_pos"))
    sinks.pose_dump(rows, path)
    total = F.aggregate("pose", F.lit(0.0), lambda s, x: s + x)
    return logs.poses(spark, path).select("robot", "i", "t", r6(total).alias("pose_sum"), "tr_sigma_pos", *[F.col(f"p_body.{c}").alias(f"b{c}") for c in "xyz"])


@query("""
SELECT r_name AS layout, n_nationkey AS id, n_nationkey + 0.5::DOUBLE AS x, -n_nationkey::DOUBLE AS y, 2.25::DOUBLE AS z FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'arms', n_nationkey + 10, n_nationkey / 8, 0.0, -0.125 FROM nation""")
def read_layouts(spark, sf_dir):
    """Anchors of each layout, told by the end of a sequence's name, and antenna arms of all robots, from their files."""
    root = _folder(spark)
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_nationkey").orderBy("r_name", "n_nationkey").collect()  # a calibration file's worth
    anchors, arms = {}, []
    for name, key in rows:
        anchors.setdefault(name, []).append(f'  {key}: "[{key + 0.5}, {-key}, 2.25]"\n')
        arms.append(f"r{key}:\n  {key + 10}: [{key / 8}, 0, -0.125]\n")
    sinks.write_text(spark, f"{root}/anchors.yaml", "".join(f"{name}:\n{''.join(lines)}" for name, lines in anchors.items()))
    sinks.write_text(spark, f"{root}/tags.yaml", "".join(arms))
    layouts = [dimensions.anchors(spark, f"{root}/anchors.yaml", f"day_1_{name}").withColumn("layout", F.lit(name)) for name in anchors]
    return _union([*layouts, dimensions.tag_arms(spark, f"{root}/tags.yaml").withColumn("layout", F.lit("arms"))])


@query("""
SELECT event_type AS robot, round(max(value) * 0.123457, 4) AS before_rmse, round(min(value) * 0.654321 + 0.1, 4) AS after_rmse, round(count(*) / 7, 1) AS improve_pct, count(*) AS keyframes, (SELECT count(*) FROM events WHERE user_id % 2 = 1) AS odd
FROM events GROUP BY event_type""")
def summary_back(spark, sf_dir):
    """The JSON summary of a run, read back as maps."""
    path, e = f"{_folder(spark)}/summary.json", events(spark, sf_dir)
    n: Column = F.count(F.lit(1))
    report = e.groupBy(F.col("event_type").alias("robot")).agg(n.alias("n"), (F.max("value") * 0.123457).alias("before"), (F.min("value") * 0.654321 + 0.1).alias("after"), (n / 7).alias("improve_pct"))
    kinds = e.groupBy(F.when(F.col("user_id") % 2 == 1, "odd").otherwise("even").alias("kind")).agg(n.alias("n"))
    sinks.summary_json(report, kinds, path)
    shape = "stats map<string,long>, per_robot map<string,struct<before_rmse:double,after_rmse:double,improve_pct:double,keyframes:long>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("j"))
    rows = whole.select(F.explode("j.per_robot").alias("robot", "of"), F.col("j.stats")["odd"].alias("odd"))
    return rows.select("robot", "of.*", "odd")


@query("""
SELECT label, e[1] AS first, e[7] AS middle, e[16] AS final, e[17] AS fx, e[20] AS cy, e[28] AS distortion, (label + 1) * 16 AS width, abs(e[32]) AS baseline
FROM (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS e FROM embeddings GROUP BY label)""")
def read_cameras(spark, sf_dir):
    """Each robot's camera files, made of its first row: a pose of a camera in the body, and a stereo calibration."""
    root, at = _folder(spark), lambda e, low, high: ", ".join(map(repr, e[low:high]))
    rows = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").cast("array<double>").alias("e")).collect()  # one row a robot
    out = []
    for label, e in rows:
        pose, stereo = f"{root}/{label}/vins.yaml", f"{root}/{label}/stereo.yaml"
        sinks.write_text(spark, pose, f"%YAML:1.0\nbody_T_cam0: !!opencv-matrix\n  rows: 4\n  data: [{at(e, 0, 8)},\n    {at(e, 8, 16)}]\nbody_T_cam1: !!opencv-matrix\n  data: [1]\n")
        camera = lambda k: f"cam{k}:\n  intrinsics: [{at(e, 16, 20)}]\n  distortion_coeffs: [{at(e, 20 + 4 * k, 24 + 4 * k)}]\n  resolution: [{16 * (label + 1)}, 8]\n"  # noqa: B023, E731
        moved = f"  T_cn_cnm1:\n  - [{at(e, 28, 32)}]\n  - [{at(e, 32, 36)}]\n  - [{at(e, 36, 40)}]\n  - [0, 0, 0, 1]\n"
        sinks.write_text(spark, stereo, camera(0) + camera(1) + moved)
        body, found = dimensions.extrinsic(spark, pose), dimensions.stereo_calibration(spark, stereo)
        out.append((label, body[0], body[6], body[15], found.intrinsics[1][0], found.matrix(0)[5], found.distortion[1][3], found.size[0], found.baseline))
    return spark.createDataFrame(out, "label int, first double, middle double, final double, fx double, cy double, distortion double, width int, baseline double")
