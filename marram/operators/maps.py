"""Classification, rasters, comparison and export columns of voxel maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.operators.ranks import quantiles, ranked
from marram.operators.voxels import CELL

#: Neighbour offsets by face bit: +x, -x, +y, -y, +z, -z.
FACES = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))
AROUND = tuple((x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) != (0, 0, 0))


def classify(l: Column, tau_occ: float = 0.85, tau_free: float = 0.4) -> Column:  # noqa: E741
    """occupied, free or unknown; both bounds are strict and NaN is unknown."""
    value = F.when(~F.isnan(l), l)
    return F.when(value > tau_occ, "occupied").when(value < -tau_free, "free").otherwise("unknown")


def raster(points: DataFrame, keep: list[str], centre: float, band: float, resolution: float, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Labelled points (x, y, z, label in 'occupied', 'free') as grid cells: keep, gx, gy, label 1 or -1.

    Indices truncate towards zero, so a point just below the lower bound falls into the first
    column. Occupied wins over free.
    """
    x0, x1, y0, y1 = bounds
    nx, ny = int(round((x1 - x0) / resolution)), int(round((y1 - y0) / resolution))
    gx, gy = ((F.col(a) - lo) / resolution for a, lo in (("x", x0), ("y", y0)))
    rows = points.where(F.abs(F.col("z") - centre) < band).where(F.col("label").isin("occupied", "free"))
    rows = rows.select(*keep, gx.cast("int").alias("gx"), gy.cast("int").alias("gy"), F.when(F.col("label") == "occupied", 1).otherwise(-1).alias("label"))
    inside = F.col("gx").between(0, nx - 1) & F.col("gy").between(0, ny - 1)
    return rows.where(inside).groupBy(*keep, "gx", "gy").agg(F.max("label").alias("label"))


def difference(weighted: DataFrame, uniform: DataFrame, keys: list[str]) -> DataFrame:
    """keys, weighted, uniform, suppressed: cells of either raster, zero where absent; suppressed are free in uniform only."""
    w, u = weighted.withColumnRenamed("label", "weighted"), uniform.withColumnRenamed("label", "uniform")
    both = w.join(u, keys, "full_outer").select(*keys, F.coalesce("weighted", F.lit(0)).alias("weighted"), F.coalesce("uniform", F.lit(0)).alias("uniform"))
    return both.withColumn("suppressed", (F.col("uniform") == -1) & (F.col("weighted") != -1))


def suppressed_share(diff: DataFrame) -> DataFrame:
    """suppressed, uniform_free, percent."""
    n, free = F.count_if("suppressed"), F.count_if(F.col("uniform") == -1)
    return diff.agg(n.alias("suppressed"), free.alias("uniform_free"), (100.0 * n / F.greatest(free, F.lit(1))).alias("percent"))


def _neighbours(cells: DataFrame, keep: list[str], offsets) -> DataFrame:
    """keep, cell, bit for every occupied neighbour of an occupied cell: each cell tells its neighbours, which then meet it by equal keys."""
    shifts = F.array(*[F.struct(F.lit(i).alias("bit"), *[F.lit(d).cast("long").alias(f"d{k}") for k, d in enumerate(o)]) for i, o in enumerate(offsets)])
    told = cells.select(*keep, *CELL, F.explode(shifts).alias("__o"))
    told = told.select(*keep, *[(F.col(c) - F.col(f"__o.d{k}")).alias(c) for k, c in enumerate(CELL)], F.col("__o.bit").alias("bit"))
    return cells.join(told, [*keep, *CELL])


def ambient_occlusion(cells: DataFrame, keep: list[str]) -> DataFrame:
    """keep, cell, neighbours, ao: occupied cells among the 26 around, and their share on 0..255 (half-even)."""
    counts = _neighbours(cells, keep, AROUND).groupBy(*keep, *CELL).agg(F.count(F.lit(1)).alias("n"))
    out = cells.join(counts, [*keep, *CELL], "left").withColumn("neighbours", F.coalesce("n", F.lit(0)).cast("long"))
    return out.select(*keep, *CELL, "neighbours", F.rint(F.col("neighbours") / 26.0 * 255.0).cast("int").alias("ao"))


def face_mask(cells: DataFrame, keep: list[str]) -> DataFrame:
    """keep, cell, mask: a bit for each face that an occupied neighbour hides."""
    bits = _neighbours(cells, keep, FACES).groupBy(*keep, *CELL).agg(F.bit_or(F.expr("shiftleft(1, bit)")).alias("m"))
    return cells.join(bits, [*keep, *CELL], "left").select(*keep, *CELL, F.coalesce("m", F.lit(0)).alias("mask"))


def voxel_index(points: DataFrame, resolution: float, names: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Cells of voxel centres, nudged by 1e-6 cells; those outside 16 bits go."""
    rows = points.withColumns({c: F.floor(F.col(n) / resolution + 1e-6).cast("long") for c, n in zip(CELL, names, strict=True)})
    return rows.where(" AND ".join(f"abs({c}) < 32767" for c in CELL))


def thinned(rows: DataFrame, most: int, order: list[str]) -> DataFrame:
    """At most ``most`` rows, evenly spaced in an explicit order: positions trunc(i * (n - 1) / (most - 1)).

    A row at position p is kept if some i maps to it, which its own position tells; no task ranks
    all rows.
    """
    n = rows.count()
    if n <= most:
        return rows
    if most == 1:
        return rows.orderBy(*order).limit(1)
    step = F.lit((n - 1) / (most - 1))
    i = F.ceil(F.col("__pos") / step)
    hit = [F.floor((i + k) * step) == F.col("__pos") for k in (-1, 0)]
    inside = [(i + k >= 0) & (i + k <= most - 1) for k in (-1, 0)]
    return ranked(rows, order, "__pos").where((hit[0] & inside[0]) | (hit[1] & inside[1]) | (F.col("__pos") == n - 1)).drop("__pos")


def framing(points: DataFrame) -> DataFrame:
    """One row: p1 and p99 of z, medians per axis, p97 of the distance from the medians within the core; exact percentiles.

    The core lies strictly between the two z percentiles.
    """
    low, high = quantiles(points, F.col("z"), [0.01, 0.99])
    core = points.where((F.col("z") > F.lit(low)) & (F.col("z") < F.lit(high)))
    middle = [quantiles(core, F.col(a), [0.5])[0] for a in "xyz"]
    far = F.sqrt(sum(((F.col(a) - F.lit(m)) * (F.col(a) - F.lit(m)) for a, m in zip("xyz", middle, strict=True)), F.lit(0.0)))
    radius = quantiles(core, far, [0.97])[0]
    return points.sparkSession.createDataFrame([(low, high, *middle, radius)], "z_low double, z_high double, cx double, cy double, cz double, radius double")
