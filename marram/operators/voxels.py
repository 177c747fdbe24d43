"""From depth observations to evidence per voxel."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.functions.geometry import Vector, length, minus, quadratic_form, times, vec
from marram.operators.ranks import grouped_quantiles, quantiles

CELL = ("ix", "iy", "iz")


@dataclass(frozen=True)
class Occupancy:
    """Resolution, log-odds and weights of a map."""

    resolution: float = 0.10
    max_ray: float = 5.0
    l_occ: float = 0.85
    l_free: float = -0.4
    low: float = -2.0
    high: float = 3.5
    alpha: float = 0.3
    beta: float = 0.5
    weighted: bool = True
    use_pose_weight: bool = True
    #: Pose uncertainty moves the occupied evidence along the ray, over so many sigmas.
    spread: bool = False
    spread_reach: float = 2.0
    #: Or it lessens free evidence only: "off", "scale" or "truncate".
    free_mode: str = "off"
    free_alpha: float | None = None
    truncate_sigmas: float = 1.0
    #: 0 keeps what is seen of others.
    dynamic_radius: float = 0.35


def depth(disparity: Column, focal_baseline: float, disparity_sigma: float = 1.0, z_min: float = 0.3, z_max: float = 5.0) -> tuple[Column, Column]:
    """Depth and its sigma, null where the disparity is no positive finite number or the depth out of range.

    NaN is made null first: it compares as larger than every number here. Rounded to single
    precision as depth maps are.
    """
    d = F.when(~F.isnan(disparity) & (disparity > 0) & (disparity < float("inf")), disparity)
    z = (F.lit(focal_baseline) / d).cast("float").cast("double")
    z = F.when((z >= z_min) & (z <= z_max), z)
    return z, (z * z / focal_baseline * disparity_sigma).cast("float").cast("double")


def backproject(u: Column, v: Column, z: Column, fx: float, fy: float, cx: float, cy: float, rectify: Column | None = None) -> Vector:
    """Camera-frame point of a pixel; ``rectify`` is a row-major rotation whose transpose undoes rectification."""
    p = ((u - cx) * z / fx, (v - cy) * z / fy, z)
    if rectify is None:
        return p
    m = lambda i: F.get(rectify, F.lit(i))
    return tuple(m(c) * p[0] + m(3 + c) * p[1] + m(6 + c) * p[2] for c in range(3))


def to_world(rotation: Column, p: Vector, t: Vector) -> Vector:
    r = times(rotation, p)
    return tuple(a + b for a, b in zip(r, t, strict=True))


def weight(trace: Column, sigma_z: Column, c: Occupancy) -> Column:
    """Trust in an observation, in 0..1: one if the map is not weighted."""
    if not c.weighted:
        return F.lit(1.0)
    w = F.exp(-(sigma_z * sigma_z) / c.beta)
    if c.use_pose_weight and not c.spread:
        w = F.exp(-trace / c.alpha) * w
    return F.least(F.greatest(w, F.lit(0.0)), F.lit(1.0))


def cell_of(p: Vector, resolution: float) -> Vector:
    return tuple(F.floor(x / resolution).cast("long") for x in p)


def crossed_cells(rays: DataFrame, ray: list[str], origin: tuple[str, str, str], end: tuple[str, str, str], resolution: float) -> DataFrame:
    """Cells that each ray passes: ray columns, ix, iy, iz, pos (0-based from the origin), cells (number of the ray's cells).

    The origin's and the end's cells are left out. A ray enters a new cell at each grid plane it
    crosses; planes are laid out per axis, ordered by their parameter along the ray (equal ones by
    axis), and a cell is the origin's plus the planes crossed so far on each axis. The last crossing
    enters the end's cell and goes. A ray's cells come from its own row alone, as one array that is
    sorted in place, so nothing is shuffled.
    """
    o, e = vec(*origin), vec(*end)
    crossings = F.array_sort(F.concat(*[_planes(k, o[k], e[k], resolution) for k in range(3)]))
    start = [F.floor(x / resolution).cast("long") for x in o]
    rows = rays.select(*ray, *[s.alias(f"__s{k}") for k, s in enumerate(start)], crossings.alias("__x"))
    rows = rows.withColumn("cells", F.greatest(F.size("__x") - 1, F.lit(0)))
    # Running sums of the steps on each axis, as a fold over the sorted crossings.
    path = F.aggregate(
        F.slice("__x", 1, F.col("cells")),
        F.struct(F.col("__s0").alias("x"), F.col("__s1").alias("y"), F.col("__s2").alias("z"), F.array().cast("array<struct<ix:bigint,iy:bigint,iz:bigint>>").alias("out")),
        lambda s, c: _stepped(s, c),
        lambda s: s["out"],
    )
    each = rows.withColumn("__p", path).select(*ray, "cells", F.posexplode("__p").alias("pos", "__c"))
    return each.select(*ray, "__c.ix", "__c.iy", "__c.iz", "pos", "cells")


def _planes(axis: int, o: Column, e: Column, resolution: float) -> Column:
    """Planes of an axis that a ray crosses, as structs of parameter, axis and step."""
    first, last = (F.floor(x / resolution).cast("long") for x in (o, e))
    step = F.signum(last - first).cast("long")
    ahead = F.when(step > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")

    def crossing(n: Column) -> Column:
        t = ((first + ahead + step * (n - 1)) * resolution - o) / (e - o)
        return F.struct(t.alias("t"), F.lit(axis).alias("axis"), step.alias("step"))

    # sequence(1, 0) counts down, so an axis without crossings is taken out.
    found = F.transform(F.sequence(F.lit(1).cast("long"), F.abs(last - first)), crossing)
    return F.when(first != last, found).otherwise(F.array().cast("array<struct<t:double,axis:int,step:bigint>>"))


def _stepped(s: Column, c: Column) -> Column:
    x, y, z = (s[n] + F.when(c["axis"] == k, c["step"]).otherwise(F.lit(0).cast("long")) for k, n in enumerate("xyz"))
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"), F.array_append(s["out"], F.struct(x.alias("ix"), y.alias("iy"), z.alias("iz"))).alias("out"))


def ray_sigma(covariance: Column, origin: Vector, point: Vector, resolution: float) -> Column:
    """Position sigma along the ray; under half a cell it counts as zero."""
    d = minus(point, origin)
    n = length(d)
    s = F.sqrt(F.greatest(quadratic_form(covariance, tuple(F.coalesce(F.try_divide(x, n), F.lit(0.0)) for x in d)), F.lit(0.0)))
    return F.when(s >= resolution / 2, s).otherwise(0.0)


def free_scale(value: Column, sigma: Column, resolution: float, alpha: float | None = None) -> Column:
    return value * F.exp(-(sigma * sigma) / (alpha if alpha is not None else resolution**2))


def survives_truncation(sigma: Column, resolution: float, k: float, pos: Column, cells: Column) -> Column:
    """Whether a cell stays when a ray loses its last floor(k * sigma / resolution) cells."""
    return pos < cells - dropped_cells(sigma, resolution, k, cells)


def spread_endpoints(points: DataFrame, keep: list[str], origin: tuple[str, str, str], point: tuple[str, str, str], sigma: str, value: str, resolution: float, reach: float = 2.0) -> DataFrame:
    """Endpoint evidence along the ray in proportion to a normal density: keep, ix, iy, iz, value.

    Samples lie one cell apart or less over +-reach*sigma, and their shares add up to one. A sigma
    under half a cell puts all on the endpoint.
    """
    o, p = vec(*origin), vec(*point)
    d = minus(p, o)
    n = length(d)
    s = F.col(sigma)
    active = (s >= resolution / 2) & (n > 0)
    trunc = F.when(active, reach * s).otherwise(0.0)
    count = F.when(active, F.ceil(2 * trunc / resolution) + 1).otherwise(F.lit(1)).cast("int")
    at = lambda i: F.when(count > 1, -trunc + i * (2 * trunc / (count - 1))).otherwise(0.0)
    density = lambda i: F.when(active, F.exp(-(at(i) * at(i)) / (2 * s * s))).otherwise(1.0)
    steps = F.sequence(F.lit(0), count - 1)
    total = F.aggregate(steps, F.lit(0.0), lambda a, i: a + density(i))
    samples = F.transform(steps, lambda i: F.struct(at(i).alias("at"), (density(i) / total).alias("share")))
    each = points.select(*keep, F.col(value).alias("__v"), *[x.alias(f"__p{k}") for k, x in enumerate(p)], *[F.when(n > 0, x / n).otherwise(0.0).alias(f"__u{k}") for k, x in enumerate(d)], F.explode(samples).alias("__s"))
    moved = tuple(F.col(f"__p{k}") + F.col(f"__u{k}") * F.col("__s.at") for k in range(3))
    return each.select(*keep, *[c.alias(name) for c, name in zip(cell_of(moved, resolution), CELL, strict=True)], (F.col("__v") * F.col("__s.share")).alias("value"))


def free_end(origin: Vector, point: Vector, trunc: Column) -> tuple[Vector, Column]:
    """The end of free carving, ``trunc`` short of the point, and whether anything is left."""
    d = minus(point, origin)
    n = length(d)
    scale = F.least(F.greatest(F.coalesce(F.try_divide(n - trunc, n), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return tuple(o + x * scale for o, x in zip(origin, d, strict=True)), scale > 0


def near_any(point: Vector, others: Column, radius: float) -> Column:
    """Whether a struct array (x, y, z) has an element strictly nearer than radius; null and empty arrays have none."""
    x, y, z = point
    hit = F.exists(others, lambda o: F.sqrt((x - o["x"]) * (x - o["x"]) + (y - o["y"]) * (y - o["y"]) + (z - o["z"]) * (z - o["z"])) < radius)
    return F.coalesce(hit, F.lit(False))


def frame_evidence(evidence: DataFrame, frame: list[str], value: str = "value") -> DataFrame:
    """Evidence summed per frame and cell, before any clamp."""
    return evidence.groupBy(*frame, *CELL).agg(F.sum(value).alias(value))


def clamped_fold(evidence: DataFrame, cell: list[str], order: str, value: str, c: Occupancy, chunk: int | None = None) -> DataFrame:
    """cell, l: frames added in order with a clamp after each, from zero.

    A clamped step x -> min(hi, max(lo, x + s)) composed with another is of the same form, so a
    cell's frames may be folded in chunks of consecutive order values (``chunk`` wide, order being an
    integer) whose triples are then composed in order: a hot cell is spread over tasks. Without
    chunk a cell is one ordered fold, which rounds exactly as the plain loop.
    """
    step = F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    low, high = F.lit(c.low), F.lit(c.high)
    hold = lambda x: F.greatest(low, F.least(high, x))
    if chunk is None:
        rows = evidence.groupBy(*cell).agg(F.array_sort(F.collect_list(step)).alias("steps"))
        return rows.select(*cell, F.aggregate("steps", F.lit(0.0), lambda a, x: hold(a + x["v"])).alias("l"))
    return fold_triples(evidence, cell, order, value, c, chunk).select(*cell, F.greatest("lo", F.least("hi", "s")).alias("l"))


#: Chunks of a cell that are composed at once; a cell with more is composed level by level.
FAN = 4096


def fold_triples(evidence: DataFrame, cell: list[str], order: str, value: str, c: Occupancy, chunk: int) -> DataFrame:
    """cell, s, lo, hi: what a cell's frames do, in order, to the value x that they find: min(hi, max(lo, x + s))."""
    step = F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    low, high = F.lit(c.low), F.lit(c.high)
    hold = lambda x: F.greatest(low, F.least(high, x))
    parts = evidence.groupBy(*cell, F.floor(F.col(order) / chunk).alias("__part")).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    triple = F.aggregate("steps", _untouched(), lambda a, x: F.struct((a["s"] + x["v"]).alias("s"), hold(a["lo"] + x["v"]).alias("lo"), hold(a["hi"] + x["v"]).alias("hi")))
    parts = parts.select(*cell, "__part", triple.alias("f")).select(*cell, "__part", "f.*")
    parts = composed(parts, [*cell, F.floor(F.col("__part") / FAN).alias("__group")], "__part").withColumnRenamed("__group", "__part")
    return composed(parts, cell, "__part")


def _untouched() -> Column:
    return F.struct(F.lit(0.0).alias("s"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))


def composed(triples: DataFrame, by: list[str | Column], order: str) -> DataFrame:
    """by, s, lo, hi: a group's triples, one after the other in order, as one."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "s", "lo", "hi")))
    rows = triples.groupBy(*by).agg(held.alias("fs"))
    after = lambda x, v: F.greatest(x["lo"], F.least(x["hi"], v + x["s"]))
    one = F.aggregate("fs", _untouched(), lambda a, x: F.struct((a["s"] + x["s"]).alias("s"), after(x, a["lo"]).alias("lo"), after(x, a["hi"]).alias("hi")))
    return rows.withColumn("f", one).select(*[c for c in rows.columns if c != "fs"], "f.*")


def attribution(evidence: DataFrame, frame: list[str], trace: str, value: str = "value") -> DataFrame:
    """cell, attribution: mean of ``trace`` over the frames that wrote a cell, weighted by the absolute evidence of single rays."""
    per = evidence.groupBy(*frame, *CELL).agg(F.sum(F.abs(value)).alias("__a"), F.first(trace).alias("__t"))
    return per.groupBy(*CELL).agg(F.try_divide(F.sum(F.col("__a") * F.col("__t")), F.sum("__a")).alias("attribution"))


def two_level_mean(df: DataFrame, frame: list[str], value: str, out: str) -> DataFrame:
    """Mean of the frames' means."""
    return df.groupBy(*frame).agg(F.avg(value).alias("__m")).agg(F.avg("__m").alias(out))


def kept_rays(points: DataFrame, c: Occupancy, origin: tuple[str, str, str], point: tuple[str, str, str]) -> DataFrame:
    """Points whose ray is longer than a cell and no longer than max_ray."""
    n = length(minus(vec(*point), vec(*origin)))
    return points.where((n > c.resolution) & (n <= c.max_ray))


def integrate(points: DataFrame, c: Occupancy, frame: list[str], origin: tuple[str, str, str], point: tuple[str, str, str], others: str | None = None, covariance: str | None = None) -> DataFrame:
    """Evidence rows (frame, ix, iy, iz, value) of points with columns tr and sigma_z: occupied ends and free cells.

    Rays no longer than a cell or over max_ray go. A point near another entity leaves no occupied
    evidence but still carves. With ``spread``, a frame's position sigma (root of tr) spreads the
    occupied evidence along the ray and free cells end before the uncertain band; under half a cell
    nothing changes. With a free_mode, the position covariance (array of 9) projected on the ray
    scales the free evidence, or cuts off the last cells.
    """
    if c.free_mode not in ("off", "scale", "truncate"):
        raise ValueError(f"no such free_mode: {c.free_mode}")
    by_ray = c.free_mode != "off" and not c.spread
    if by_ray and covariance is None:
        raise ValueError("free_mode needs the position covariance")
    o, p = vec(*origin), vec(*point)
    rows = kept_rays(points.withColumn("__w", weight(F.col("tr"), F.col("sigma_z"), c)), c, origin, point)
    still = rows if others is None or c.dynamic_radius <= 0 else rows.where(~near_any(p, F.col(others), c.dynamic_radius))
    if c.spread:
        sigma = F.sqrt(F.greatest(F.col("tr"), F.lit(0.0)))
        still = still.withColumns({"__sigma": sigma, "__value": F.col("__w") * c.l_occ})
        ends = spread_endpoints(still, frame, origin, point, "__sigma", "__value", c.resolution, c.spread_reach)
        end, live = free_end(o, p, F.when(sigma >= c.resolution / 2, c.spread_reach * sigma).otherwise(0.0))
        rows = rows.withColumns({f"__e{k}": x for k, x in enumerate(end)}).where(live)
        free = crossed_cells(rows, [*frame, "__w"], origin, ("__e0", "__e1", "__e2"), c.resolution)
    else:
        ends = still.select(*frame, *[x.alias(k) for k, x in zip(CELL, cell_of(p, c.resolution), strict=True)], (F.col("__w") * c.l_occ).alias("value"))
        rows = rows.withColumn("__su", ray_sigma(F.col(covariance), o, p, c.resolution) if by_ray else F.lit(0.0))
        free = crossed_cells(rows, [*frame, "__w", "__su"], origin, point, c.resolution)
    value = F.col("__w") * c.l_free
    if by_ray and c.free_mode == "scale":
        value = free_scale(value, F.col("__su"), c.resolution, c.free_alpha)
    elif by_ray:
        free = free.where(survives_truncation(F.col("__su"), c.resolution, c.truncate_sigmas, F.col("pos"), F.col("cells")))
    return ends.unionByName(free.select(*frame, *CELL, value.alias("value")))


def frame_counts(frames: DataFrame, points: DataFrame, c: Occupancy, origin: tuple[str, str, str], point: tuple[str, str, str]) -> DataFrame:
    """One row (n_frames, n_points): all frames, those without a ray too, and the rays that were kept."""
    n = kept_rays(points, c, origin, point).agg(F.count(F.lit(1)).alias("n_points"))
    return frames.agg(F.count(F.lit(1)).alias("n_frames")).crossJoin(n)  # one row each


def sigma_stats(rays: DataFrame, sigma: str) -> DataFrame:
    """One row (median, p90) of a sigma over all rays of all frames."""
    return rays.sparkSession.createDataFrame([tuple(quantiles(rays, F.col(sigma), [0.5, 0.9]))], "median double, p90 double")


def dropped_cells(sigma: Column, resolution: float, k: float, cells: Column) -> Column:
    """How many of a ray's cells truncation takes."""
    return F.least(F.floor(k * sigma / resolution), cells)


def trace_range(poses: DataFrame, by: list[str], trace: str) -> DataFrame:
    """by, low, middle, high: least, median and greatest covariance trace."""
    return grouped_quantiles(poses, by, F.col(trace), {"low": 0.0, "middle": 0.5, "high": 1.0})


def near_rows(points: DataFrame, others: DataFrame, frame: list[str], point: tuple[str, str, str], other: tuple[str, str, str], radius: float, how: str = "left_semi") -> DataFrame:
    """Points strictly nearer than radius to one of their frame's others (or, by a left_anti join, to none).

    Each of the others is told to the 27 grid cells, of the radius' size, around it, and a point
    meets those of its own cell alone; so neither side is gathered by frame, however many of either
    it has. Rows with a null coordinate are near nothing.
    """
    at = lambda names: [F.floor(F.col(c) / radius).cast("long") for c in names]
    steps = [F.lit(d) for d in (-1, 0, 1)]
    rows = others.select(*[F.col(c).alias(f"__f{k}") for k, c in enumerate(frame)], *[F.col(c).alias(f"__o{k}") for k, c in enumerate(other)], *[c.alias(f"__g{k}") for k, c in enumerate(at(other))])
    for k in range(3):
        rows = rows.withColumn(f"__g{k}", F.explode(F.array(*[F.col(f"__g{k}") + d for d in steps])))
    meets = [F.col(c) == F.col(f"__f{k}") for k, c in enumerate(frame)] + [c == F.col(f"__g{k}") for k, c in enumerate(at(point))]
    apart = [F.col(c) - F.col(f"__o{k}") for k, c in enumerate(point)]
    meets.append(F.sqrt(sum((a * a for a in apart[1:]), apart[0] * apart[0])) < radius)
    return points.join(rows, reduce(Column.__and__, meets), how)


def sampled_frames(pixels: DataFrame, frame: list[str], valid: Column, row: str, column: str, least: int = 100, step: int = 4) -> DataFrame:
    """Valid pixels of every step-th row and column, of frames with ``least`` valid pixels before that."""
    good = pixels.where(valid)
    frames = good.groupBy(*frame).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    return good.where((F.col(row) % step == 0) & (F.col(column) % step == 0)).join(frames, frame, "left_semi")


def position_windows(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds pos (0-based) and cells (row count) of each row in its group."""
    w = Window.partitionBy(*by)
    return df.withColumn("pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn("cells", F.count(F.lit(1)).over(w))
