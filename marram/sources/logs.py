"""Readers of per-entity logs: <root>/<seq>/<robot>/*.csv and keyframe texts.

A robot without a file has no rows; a sequence without any ranges file is an error. Paths go
through the session's file systems, so a root may be in any store that Spark reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.operators import cleaning
from marram.operators.asof import TRACK_SLOT, nearest_asof
from marram.sources import schemas


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _csv(spark: SparkSession, path: str, schema, header: bool = True) -> DataFrame:
    """A CSV file by column name where it has a header, whatever the columns' order; an empty table if the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    if not header:
        return spark.read.csv(path, schema=schema, header=False, enforceSchema=True)
    raw = spark.read.csv(path, header=True, inferSchema=False)
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])


def ground_truth(spark: SparkSession, root: str, seq: str, robot: str, clean: bool = True, smooth: float = 0.9999) -> DataFrame:
    """timestamp, x, y, z, qx, qy, qz, qw. Clean: gaps and rotation outliers dropped, signs made continuous, smoothed,
    evaluated at the raw times clipped to the clean span, quaternions of length one."""
    raw = _csv(spark, f"{root}/{seq}/{robot}/mocap.csv", schemas.TRUTH)
    raw = raw.withColumnsRenamed(schemas.TRUTH_COLUMNS)
    if not clean:
        return raw
    return smoothed_truth(raw.withColumn("entity", F.lit(0)), raw.select(F.lit(0).alias("entity"), "timestamp"), smooth).drop("entity")


_QUAT = ["qx", "qy", "qz", "qw"]


def clean_truth(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean rows of (entity, timestamp, pose columns), and per entity (rows, dropped)."""
    gaps = cleaning.is_gap(["x", "y", "z"], _QUAT)
    marked = cleaning.rotation_outliers(raw.where(~gaps), ["entity"], "timestamp", _QUAT)
    kept = marked.where("NOT flagged").drop("flagged")
    n = cleaning.norm(*_QUAT)
    unit = kept.withColumns({c: F.col(c) / n for c in _QUAT})
    signs = cleaning.continuous_signs(unit, ["entity"], "timestamp", _QUAT)
    clean = unit.drop(*_QUAT).join(signs.drop("sign"), ["entity", "timestamp"])
    counts = raw.groupBy("entity").agg(F.count(F.lit(1)).alias("rows"))
    left = clean.groupBy("entity").agg(F.count(F.lit(1)).alias("kept"))
    return clean, counts.join(left, "entity", "left").select("entity", "rows", (F.col("rows") - F.coalesce("kept", F.lit(0))).alias("dropped"))


def smoothed_truth(raw: DataFrame, at: DataFrame, smooth: float = 0.9999) -> DataFrame:
    """Smoothed pose of each entity at the times of ``at`` (entity, timestamp), which are clipped to the clean span.

    Of clean rows at one time the least is fitted. A long track is cleaned, fitted and evaluated in pieces.
    """
    columns = ["x", "y", "z", *_QUAT]
    clean, _ = clean_truth(raw)
    once = clean.groupBy("entity", "timestamp").agg(F.min(F.struct(*columns)).alias("least")).select("entity", "timestamp", "least.*")
    knots = cleaning.fitted(once, ["entity"], "timestamp", columns, smooth)
    found = cleaning.evaluated(knots, at.select("entity", "timestamp"), ["entity"], "timestamp", columns, TRACK_SLOT)
    n = cleaning.norm(*_QUAT)
    return found.select("entity", "timestamp", "x", "y", "z", *[(F.col(c) / n).alias(c) for c in _QUAT])


def ranges(spark: SparkSession, root: str, seq: str, robots: list[str], most_std: float = 0.5) -> DataFrame:
    """Ranges of all robots, the first of each (timestamp, from_id, to_id) in robot order, then the quality bound; with kind."""
    paths = [f"{root}/{seq}/{r}/uwb_range.csv" for r in robots]
    found = [_csv(spark, p, schemas.RANGES) for p in paths if exists(spark, p)]
    if not found:
        raise FileNotFoundError(f"no ranges for sequence {seq}")
    # Rows of one file keep their order of reading among equal keys.
    found = [p.withColumn("__row", F.monotonically_increasing_id()) for p in found]
    kept = cleaning.union_ranges(found, ["timestamp", "from_id", "to_id"], "std", most_std, ["__row"])
    return kept.withColumn("kind", cleaning.range_kind(F.col("to_id"))).drop("__row")


def by_time(rows: DataFrame, time: str = "timestamp", most: int | None = None) -> DataFrame:
    """Rows in time order for output, the first ``most`` of them if given; readers leave order to who needs it."""
    ordered = rows.orderBy(time)
    return ordered if most is None else ordered.limit(most)


def heights(spark: SparkSession, root: str, seq: str, robot: str, bias: float) -> DataFrame:
    rows = _csv(spark, f"{root}/{seq}/{robot}/height.csv", schemas.HEIGHT)
    return rows.select("timestamp", (F.col("range") - bias).alias("h"))


def keyframes(spark: SparkSession, path: str) -> DataFrame:
    """Headerless text of eight columns between white space."""
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"{c} double" for c in schemas.KEYFRAMES))
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(*[F.get(parts, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(schemas.KEYFRAMES)])


def odometry(spark: SparkSession, path: str, timeshift: float = 0.0, stride: int = 2) -> DataFrame:
    """t (seconds after the shift), pose (w-first in the file) and speed; every stride-th row in time order."""
    rows = _csv(spark, path, schemas.ODOMETRY, header=False)
    speed = cleaning.norm("vx", "vy", "vz")
    rows = rows.select((F.col("ns") / 1e9 - timeshift).alias("t"), "x", "y", "z", "qx", "qy", "qz", "qw", speed.alias("v"))
    return cleaning.every_kth(rows, stride, [], ["t"])


def frame_pairs(left: DataFrame, right: DataFrame, path: str = "path") -> DataFrame:
    """File names (with stem as a number) that both listings have, by stem."""
    name = F.substring_index(F.col(path), "/", -1).alias("name")
    both = left.select(name).intersect(right.select(name))
    return both.withColumn("t", F.regexp_replace("name", r"\.[^.]*$", "").cast("double"))


def nearest_frames(keyframes: DataFrame, left: DataFrame, right: DataFrame, tolerance: float = 0.05, most: int | None = None, path: str = "path") -> DataFrame:
    """Keyframes (t, ...) with the stereo pair nearest in time: frame_t, left_path, right_path; none over ``tolerance`` apart.

    The pair is told by the stem that both listings have; ``most`` keeps the first so many in time.
    """
    one = F.lit(0)
    pairs = frame_pairs(left, right, path).select(one.alias("__one"), F.col("t").alias("frame_t"), "name")
    met = nearest_asof(keyframes.withColumn("__one", one), pairs, ["__one"], "t", "frame_t", ["name"], tolerance).withColumnRenamed("matched_on", "frame_t").drop("__one", "gap")
    side = lambda df, alias: df.select(F.substring_index(F.col(path), "/", -1).alias("name"), F.col(path).alias(alias))
    out = met.join(side(left, "left_path"), "name").join(side(right, "right_path"), "name").drop("name")
    return out if most is None else by_time(out, "t", most)


def enough_keyframes(spark: SparkSession, paths: dict[str, str], least: int = 20) -> dict[str, int]:
    """Keyframes of each robot's file (0 where it is missing); robots under ``least`` are left out, for their front-end should run again."""
    counts = {robot: keyframes(spark, path).count() for robot, path in paths.items()}
    return {robot: n for robot, n in counts.items() if n >= least}


def with_retries(run, robots: list[str], count, least: int = 20, attempts: int = 3) -> dict[str, int]:
    """Runs ``run(robot)`` until ``count(robot)`` gives ``least`` keyframes, ``attempts`` times at most; the last count of each robot."""
    out = {}
    for robot in robots:
        for _ in range(attempts):
            run(robot)
            out[robot] = count(robot)
            if out[robot] >= least:
                break
    return out


def image_listing(spark: SparkSession, folder: str, pattern: str = "*.jpeg") -> DataFrame:
    """path, modificationTime, length of the images; the bytes stay where they are until asked for."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime", "length")


def image_list(spark: SparkSession, path: str) -> DataFrame:
    """t, path from lines "<t> <path>"; lines without both are skipped."""
    value = F.trim("value")
    rows = spark.read.text(path).select(F.split(value, r"\s+", 2).alias("p")).where("size(p) = 2 AND p[1] <> ''")
    return rows.select(F.get("p", F.lit(0)).try_cast("double").alias("t"), F.get("p", F.lit(1)).alias("path")).where("t IS NOT NULL")


def poses(spark: SparkSession, path: str) -> DataFrame:
    """Fused pose dump; p_body falls back to the pose's translation."""
    rows = spark.read.schema(schemas.DUMP).parquet(path)
    at = lambda i: F.get("pose", F.lit(i))
    return rows.withColumn("p_body", F.coalesce("p_body", F.struct(at(3).alias("x"), at(7).alias("y"), at(11).alias("z"))))


def npz_poses(spark: SparkSession, path: str, robot: str) -> DataFrame:
    """A pose dump of NumPy arrays t, T, tr_sigma_pos and, if there, p_body and sigma_pos, as rows of schemas.DUMP; read in a task."""
    import io

    import numpy as np
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    poses = z["T"].reshape(-1, 16)
                    body = z["p_body"] if "p_body" in z.files else z["T"][:, :3, 3]
                    sigma = z["sigma_pos"].reshape(-1, 9).tolist() if "sigma_pos" in z.files else [None] * len(poses)
                    yield pd.DataFrame({"robot": robot, "i": np.arange(len(poses), dtype=np.int32), "t": z["t"].astype(float), "pose": poses.astype(float).tolist(), "tr_sigma_pos": z["tr_sigma_pos"].astype(float), "p_body": [dict(zip("xyz", map(float, b), strict=True)) for b in body], "sigma_pos": sigma})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schemas.DUMP)


def seconds(ns: Column) -> Column:
    return ns / 1e9
