"""From pairs of grey images to disparities, as operators on tables of pixels (frame, v, u, grey).

Frames are independent. A table that is partitioned by frame keeps that partitioning through every
window and grouping here, so images are shuffled once; what does not depend on the frame (where a
rectified pixel looks in the raw image) is one small table a camera.

Fixed-point undistortion, the rectified camera's focal length and the matching cost are our own
choices: census bits summed over a box, the cheapest disparity, a parabola through its neighbours,
and checks for uniqueness and agreement of both views.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marram.operators.lie import so3_exp, so3_log
from marram.sources.dimensions import StereoCalibration


@dataclass(frozen=True)
class Rectified:
    """Rotations of both cameras into the common frame (row-major), its focal length, principal point and baseline."""

    rotations: tuple[tuple[float, ...], tuple[float, ...]]
    focal: float
    cx: float
    cy: float
    baseline: float


def distorted(x, y, k: tuple[float, ...]):
    """Where a lens with coefficients k1, k2, p1, p2 sees a normalised point; of columns or arrays."""
    k1, k2, p1, p2 = k[:4]
    r2 = x * x + y * y
    radial = 1 + k1 * r2 + k2 * r2 * r2
    return x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def undistorted(x: Column, y: Column, k: tuple[float, ...], rounds: int = 10) -> Column:
    """Struct (x, y) of the point that the lens sees at (x, y), by fixed-point rounds."""
    start = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    def better(p: Column, _: Column) -> Column:
        sx, sy = distorted(p["x"], p["y"], k)
        return F.struct((p["x"] + x - sx).alias("x"), (p["y"] + y - sy).alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, better)


def rectification(c: StereoCalibration) -> Rectified:
    """Rotations that turn each camera by half of what lies between them and then the baseline onto the x axis.

    The focal length is the least with which no rectified pixel of either camera looks outside its image.
    """
    pose = np.array(c.transform).reshape(4, 4)
    half = so3_exp(-0.5 * so3_log(pose[:3, :3]))
    t = half @ pose[:3, 3]
    ahead = np.array([-1.0 if t[0] < 0 else 1.0, 0.0, 0.0])
    axis = np.cross(t, ahead)
    angle = np.arccos(np.clip(t @ ahead / np.linalg.norm(t), -1, 1))
    level = so3_exp(axis / max(np.linalg.norm(axis), 1e-300) * angle)
    rotations = level @ half.T, level @ half
    w, h = c.size
    edges = []
    for k, rotation in enumerate(rotations):
        fx, fy, cx, cy = c.intrinsics[k]
        s = np.linspace(0, 1, 33)
        for x, y in ((0 * s, s * (h - 1)), (0 * s + w - 1, s * (h - 1)), (s * (w - 1), 0 * s), (s * (w - 1), 0 * s + h - 1)):
            seen = np.stack([(x - cx) / fx, (y - cy) / fy])
            p = seen.copy()
            for _ in range(20):
                p = p + seen - np.stack(distorted(p[0], p[1], c.distortion[k]))
            turned = rotation @ np.stack([*p, np.ones_like(x)])
            edges.append(turned[:2] / turned[2])
    left, right, top, bottom = (edges[i::4] for i in range(4))
    x0, x1 = max(e[0].max() for e in left), min(e[0].min() for e in right)
    y0, y1 = max(e[1].max() for e in top), min(e[1].min() for e in bottom)
    focal = max((w - 1) / (x1 - x0), (h - 1) / (y1 - y0))
    cx, cy = (w - 1 - focal * (x0 + x1)) / 2, (h - 1 - focal * (y0 + y1)) / 2
    return Rectified(tuple(tuple(map(float, r.ravel())) for r in rotations), float(focal), float(cx), float(cy), float(np.linalg.norm(pose[:3, 3])))


def rectifying_map(spark: SparkSession, c: StereoCalibration, r: Rectified, camera: int) -> DataFrame:
    """v, u of every rectified pixel with the up to four raw pixels it is made of: sv, su, weight (weights over 0 alone)."""
    w, h = c.size
    m, (fx, fy, cx, cy) = r.rotations[camera], c.intrinsics[camera]
    x, y = (F.col("u") - r.cx) / r.focal, (F.col("v") - r.cy) / r.focal
    ray = [m[k] * x + m[3 + k] * y + m[6 + k] for k in range(3)]
    px, py = distorted(ray[0] / ray[2], ray[1] / ray[2], c.distortion[camera])
    pixels = spark.range(w * h).select(F.floor(F.col("id") / w).cast("int").alias("v"), (F.col("id") % w).cast("int").alias("u"))
    at = pixels.select("v", "u", (fx * px + cx).alias("x"), (fy * py + cy).alias("y"))
    fu, fv = F.col("x") - F.floor("x"), F.col("y") - F.floor("y")
    corner = lambda dv, du, weight: F.struct((F.floor("y") + dv).cast("int").alias("sv"), (F.floor("x") + du).cast("int").alias("su"), weight.alias("weight"))
    corners = F.array(corner(0, 0, (1 - fu) * (1 - fv)), corner(0, 1, fu * (1 - fv)), corner(1, 0, (1 - fu) * fv), corner(1, 1, fu * fv))
    return at.select("v", "u", F.explode(corners).alias("c")).select("v", "u", "c.*").where("weight > 0")


def remapped(pixels: DataFrame, frame: list[str], mapping: DataFrame) -> DataFrame:
    """frame, v, u, grey of rectified images: each pixel by its neighbours' weights; what lies outside the raw image is black."""
    met = pixels.select(*frame, F.col("v").alias("sv"), F.col("u").alias("su"), "grey").join(mapping, ["sv", "su"])
    return met.groupBy(*frame, "v", "u").agg(F.sum(F.col("weight") * F.col("grey")).alias("grey"))


def census(pixels: DataFrame, frame: list[str], grey: str, name: str, reach: int = 1) -> DataFrame:
    """``pixels`` with ``name``: a bit for each neighbour within ``reach`` that is darker than the pixel; bits run by row and column, none stands for a missing neighbour."""
    along = Window.partitionBy(*frame, "v").orderBy("u")
    down = Window.partitionBy(*frame, "u").orderBy("v")
    steps = range(-reach, reach + 1)
    beside = {d: f"__{name}{d + reach}" for d in steps}
    rows = pixels.withColumns({beside[d]: F.lag(grey, -d).over(along) for d in steps})
    bits, place = F.lit(0).cast("long"), 0
    for dv in steps:
        for du in steps:
            if dv or du:
                darker = F.lag(beside[du], -dv).over(down) < F.col(grey)
                bits = bits + F.when(darker, 1 << place).otherwise(0)
                place += 1
    return rows.withColumn(name, bits).drop(*beside.values())


def box_sums(rows: DataFrame, by: list[str], order: str, columns: list[str], reach: int) -> DataFrame:
    """Each column replaced by its sum over the rows within ``reach`` before and after, by differences of running sums; null rows count 0."""
    window = Window.partitionBy(*by).orderBy(order)
    to_here = window.rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumns({c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(to_here) for c in columns})
    last = window.rowsBetween(0, reach)
    return sums.withColumns({c: F.last(c).over(last) - F.coalesce(F.lag(c, reach + 1).over(window), F.lit(0)) for c in columns})


def disparities(pairs: DataFrame, frame: list[str], most: int, reach: int = 2, bits: int = 1, uniqueness: int = 10, agreement: int = 1) -> DataFrame:
    """frame, v, u, disparity (null where none is sure) of rectified pairs (frame, v, u, left, right).

    Disparities 0 to ``most`` - 1. The cost of one is the number of census bits in which the pixel
    and its counterpart differ, summed over a box of ``reach``; a counterpart outside the image
    makes the disparity impossible. The cheapest wins, the smaller of equal ones; it is refined by
    a parabola. It is dropped if another but its neighbours costs less than ``uniqueness`` percent
    more, or if the right image's own winner at the counterpart differs by over ``agreement``.
    """
    rows = census(census(pairs.repartition(*frame), frame, "left", "__l", bits), frame, "right", "__r", bits)
    along = Window.partitionBy(*frame, "v").orderBy("u")
    costs = [f"__c{d}" for d in range(most)]
    rows = rows.select(*frame, "v", "u", *[F.bit_count(F.col("__l").bitwiseXOR(F.lag("__r", d).over(along))).cast("long").alias(c) for d, c in enumerate(costs)])
    possible = [F.col("__column") > d for d in range(most)]
    rows = rows.withColumn("__column", F.row_number().over(along))
    rows = box_sums(rows, [*frame, "v"], "u", costs, reach)
    rows = box_sums(rows, [*frame, "u"], "v", costs, reach)
    rows = rows.withColumns({c: F.when(p, F.col(c)) for c, p in zip(costs, possible, strict=True)})
    ranked = lambda values: F.array_min(F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(v.alias("cost"), F.lit(d).alias("d"))) for d, v in enumerate(values)])))
    # The right image's pixel u meets the left one's u + d.
    rows = rows.withColumns({"__best": ranked([F.col(c) for c in costs]), "__other": ranked([F.lead(c, d).over(along) for d, c in enumerate(costs)])["d"], "__costs": F.array(*costs)}).drop(*costs)
    d, cost = F.col("__best.d"), F.col("__best.cost")
    theirs = F.get(F.array(*[F.lag("__other", k).over(along) for k in range(most)]), d)
    rows = rows.withColumn("__theirs", theirs)
    rivals = F.exists(F.transform("__costs", lambda c, k: (F.abs(k - d) > 1) & (c * 100 < cost * (100 + uniqueness))), lambda hit: hit)
    before, after = F.get("__costs", d - 1), F.get("__costs", d + 1)
    bend = before - 2 * cost + after
    shift = F.when(bend > 0, (before - after) / (2 * bend)).otherwise(0.0)
    sure = ~F.coalesce(rivals, F.lit(False)) & (F.abs(F.col("__theirs") - d) <= agreement)
    return rows.select(*frame, "v", "u", F.when(sure, d + F.coalesce(shift, F.lit(0.0))).alias("disparity"))
