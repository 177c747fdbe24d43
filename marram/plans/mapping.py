"""Queries: depth, rays, evidence and maps. Line items stand for bulk evidence (frame: month of shipping), embedding components for rays and voxels."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from marram.functions.geometry import CIVIDIS, VIRIDIS, colour, logistic, rotate, vec
from marram.operators import figures, maps, voxels
from marram.operators.kept_map import KeptMap
from marram.operators.voxels import CELL
from marram.plans.registry import events, points, query, r6, table
from marram.session import Workspace, shared_folder
from marram.sources import sinks

FX, FY, CX, CY, FB = 386.0, 386.0, 424.0, 240.0, 20.0


@query(f"""
WITH d AS (SELECT l_orderkey, l_linenumber, (l_partkey % 848)::DOUBLE AS u, (l_suppkey % 480)::DOUBLE AS v, ({FB}::DOUBLE / l_quantity)::FLOAT::DOUBLE AS z
    FROM lineitem WHERE l_quantity > 0)
SELECT l_orderkey, l_linenumber, round((u - {CX}) * z / {FX}, 6) AS x, round((v - {CY}) * z / {FY}, 6) AS y, round(z, 6) AS z, round((z * z / {FB} * 0.5)::FLOAT::DOUBLE, 6) AS sigma_z
FROM d WHERE z >= 0.3 AND z <= 5.0""")
def depth_backproject(spark, sf_dir):
    z, s = voxels.depth(F.col("l_quantity"), FB, 0.5)
    rows = table(spark, sf_dir, "lineitem").withColumns({"z": z, "s": s, "u": (F.col("l_partkey") % 848).cast("double"), "v": (F.col("l_suppkey") % 480).cast("double")}).where("z IS NOT NULL")
    x, y, z = voxels.backproject(F.col("u"), F.col("v"), F.col("z"), FX, FY, CX, CY)
    return rows.select("l_orderkey", "l_linenumber", r6(x).alias("x"), r6(y).alias("y"), r6(z).alias("z"), r6("s").alias("sigma_z"))


@query("""
WITH f AS (SELECT l_shipdate FROM lineitem WHERE l_quantity BETWEEN 4 AND 45 GROUP BY l_shipdate HAVING count(*) >= 12)
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate IN (SELECT l_shipdate FROM f) AND l_partkey % 4 = 0 AND l_suppkey % 4 = 0 AND l_quantity BETWEEN 4 AND 45""")
def valid_frames(spark, sf_dir):
    """Frames with enough valid pixels, counted before every fourth row and column is taken."""
    pixels = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    return voxels.sampled_frames(pixels, ["l_shipdate"], F.col("l_quantity").between(4, 45), "l_partkey", "l_suppkey", 12, 4).select("l_orderkey", "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber, round(least(greatest(exp(-l_discount / 0.3) * exp(-((l_tax * 5) * (l_tax * 5)) / 0.5), 0), 1), 6) AS w FROM lineitem""")
def evidence_weight(spark, sf_dir):
    w = voxels.weight(F.col("l_discount"), F.col("l_tax") * 5, voxels.Occupancy())
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(w).alias("w"))


RES = 0.5
#: An independent march from cell to cell: the next plane with the smallest parameter, ties to the lowest axis.
_RAYS = f"""ray AS (SELECT vec_id, label, embedding[1]::DOUBLE * 10 AS ox, embedding[2]::DOUBLE * 10 AS oy, embedding[3]::DOUBLE * 10 AS oz,
    embedding[4]::DOUBLE * 10 AS px, embedding[5]::DOUBLE * 10 AS py, embedding[6]::DOUBLE * 10 AS pz FROM embeddings),
cells AS (SELECT *, floor(ox / {RES})::BIGINT AS sx, floor(oy / {RES})::BIGINT AS sy, floor(oz / {RES})::BIGINT AS sz,
    floor(px / {RES})::BIGINT AS ex, floor(py / {RES})::BIGINT AS ey, floor(pz / {RES})::BIGINT AS ez FROM ray),
step AS (SELECT vec_id, sx AS x, sy AS y, sz AS z, 0 AS n FROM cells
    UNION ALL SELECT vec_id, x + CASE WHEN axis = 0 THEN sign(ex - x)::BIGINT ELSE 0 END, y + CASE WHEN axis = 1 THEN sign(ey - y)::BIGINT ELSE 0 END,
        z + CASE WHEN axis = 2 THEN sign(ez - z)::BIGINT ELSE 0 END, n + 1
    FROM (SELECT *, CASE WHEN tx <= ty AND tx <= tz THEN 0 WHEN ty <= tz THEN 1 ELSE 2 END AS axis FROM (
        SELECT step.*, ex, ey, ez,
            CASE WHEN ex = x THEN 'infinity'::DOUBLE ELSE ((x + (ex > x)::INT) * {RES}::DOUBLE - ox) / (px - ox) END AS tx,
            CASE WHEN ey = y THEN 'infinity'::DOUBLE ELSE ((y + (ey > y)::INT) * {RES}::DOUBLE - oy) / (py - oy) END AS ty,
            CASE WHEN ez = z THEN 'infinity'::DOUBLE ELSE ((z + (ez > z)::INT) * {RES}::DOUBLE - oz) / (pz - oz) END AS tz
        FROM step JOIN cells USING (vec_id) WHERE x <> ex OR y <> ey OR z <> ez))),
crossed AS (SELECT vec_id, x AS ix, y AS iy, z AS iz, n - 1 AS pos, abs(ex - sx) + abs(ey - sy) + abs(ez - sz) - 1 AS cells
    FROM step JOIN cells USING (vec_id) WHERE n > 0 AND (x <> ex OR y <> ey OR z <> ez))"""

ORIGIN, POINT = ("ox", "oy", "oz"), ("px", "py", "pz")


def _rays(spark, sf_dir):
    return points(spark, sf_dir, [*ORIGIN, *POINT], 10.0)


@query(f"WITH RECURSIVE {_RAYS} SELECT vec_id, ix, iy, iz FROM crossed")
def dda_cells(spark, sf_dir):
    return voxels.crossed_cells(_rays(spark, sf_dir), ["vec_id"], ORIGIN, POINT, RES).select("vec_id", *CELL)


@query(f"WITH RECURSIVE {_RAYS} SELECT ix, iy, iz, count(*) AS rays FROM crossed GROUP BY ix, iy, iz")
def dda_counts(spark, sf_dir):
    return voxels.crossed_cells(_rays(spark, sf_dir), ["vec_id"], ORIGIN, POINT, RES).groupBy(*CELL).agg(F.count(F.lit(1)).alias("rays"))


_SIGMA = f"""sig AS (SELECT vec_id, CASE WHEN s >= {RES} / 2 THEN s ELSE 0.0 END AS su FROM (
    SELECT vec_id, sqrt(greatest(c * (ux * ux + 0.5 * uy * uy + 0.25 * uz * uz), 0)) AS s FROM (
        SELECT vec_id, label * 0.2 AS c, (px - ox) / n AS ux, (py - oy) / n AS uy, (pz - oz) / n AS uz FROM (
            SELECT *, sqrt((px - ox) ** 2 + (py - oy) ** 2 + (pz - oz) ** 2) AS n FROM ray))))"""


def _with_sigma(spark, sf_dir):
    rays = _rays(spark, sf_dir)
    c = F.col("label") * 0.2
    zero = F.lit(0.0)
    covariance = F.array(c, zero, zero, zero, c * 0.5, zero, zero, zero, c * 0.25)
    return rays.withColumn("su", voxels.ray_sigma(covariance, vec(*ORIGIN), vec(*POINT), RES))


@query(f"WITH RECURSIVE {_RAYS}, {_SIGMA} SELECT vec_id, ix, iy, iz FROM crossed JOIN sig USING (vec_id) WHERE pos < cells - least(floor(1.0 * su / {RES}), cells)")
def free_trunc(spark, sf_dir):
    rows = voxels.crossed_cells(_with_sigma(spark, sf_dir), ["vec_id", "su"], ORIGIN, POINT, RES)
    return rows.where(voxels.survives_truncation(F.col("su"), RES, 1.0, F.col("pos"), F.col("cells"))).select("vec_id", *CELL)


@query(f"WITH {_RAYS.split(',' + chr(10) + 'cells AS')[0]}, {_SIGMA} SELECT vec_id, round(su, 6) AS sigma_u, round(-0.4 * exp(-(su * su) / {RES * RES}), 6) AS free FROM sig")
def free_scale(spark, sf_dir):
    return _with_sigma(spark, sf_dir).select("vec_id", r6("su").alias("sigma_u"), r6(voxels.free_scale(F.lit(-0.4), F.col("su"), RES)).alias("free"))


@query(f"""
WITH {_RAYS.split(',' + chr(10) + 'cells AS')[0]},
d AS (SELECT *, label * 0.11 AS s, sqrt((px - ox) * (px - ox) + (py - oy) * (py - oy) + (pz - oz) * (pz - oz)) AS n FROM ray),
k AS (SELECT *, CASE WHEN s >= {RES / 2} AND n > 0 THEN 2.0 * s ELSE 0.0 END AS tr, CASE WHEN s >= {RES / 2} AND n > 0 THEN ceil(2 * (2.0 * s) / {RES})::INT + 1 ELSE 1 END AS m FROM d),
x AS (SELECT *, CASE WHEN m > 1 THEN -tr + i * (2 * tr / (m - 1)) ELSE 0.0 END AS off FROM (SELECT *, unnest(range(m)) AS i FROM k)),
g AS (SELECT *, CASE WHEN m > 1 THEN exp(-(off * off) / (2 * s * s)) ELSE 1.0 END AS w FROM x),
h AS (SELECT *, w / sum(w) OVER (PARTITION BY vec_id) AS share FROM g)
SELECT vec_id, floor((px + (px - ox) / n * off) / {RES})::BIGINT AS ix, floor((py + (py - oy) / n * off) / {RES})::BIGINT AS iy, floor((pz + (pz - oz) / n * off) / {RES})::BIGINT AS iz,
    round(sum(0.85 * share), 6) AS value FROM h GROUP BY ALL""")
def spread_mass(spark, sf_dir):
    rays = _rays(spark, sf_dir).withColumns({"s": F.col("label") * 0.11, "v": F.lit(0.85)})
    cells = voxels.spread_endpoints(rays, ["vec_id"], ORIGIN, POINT, "s", "v", RES)
    return cells.groupBy("vec_id", *CELL).agg(r6(F.sum("value")).alias("value"))


#: Positions of others at one instant.
_OTHERS = ((1.0, 0.5, -0.5), (-1.5, 1.0, 0.0), (0.0, -1.0, 1.5))


@query(f"""
SELECT vec_id, least({", ".join(f"sqrt((x - {a}::DOUBLE) * (x - {a}::DOUBLE) + (y - {b}::DOUBLE) * (y - {b}::DOUBLE) + (z - {c}::DOUBLE) * (z - {c}::DOUBLE))" for a, b, c in _OTHERS)}) < 1.5 AS masked
FROM (SELECT vec_id, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings)""")
def teammate_mask(spark, sf_dir):
    others = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, "xyz", strict=True)]) for o in _OTHERS])
    return points(spark, sf_dir, ["x", "y", "z"], 10.0).select("vec_id", voxels.near_any(vec("x", "y", "z"), others, 1.5).alias("masked"))


_EVIDENCE = """ev AS (SELECT (year(l_shipdate) * 12 + month(l_shipdate))::BIGINT AS frame, floor(l_quantity / 10)::BIGINT AS ix, floor(l_extendedprice / 20000)::BIGINT AS iy, l_linenumber::BIGINT AS iz,
    (l_discount - l_tax) * 4 AS value, l_tax AS tr FROM lineitem),
summed AS (SELECT frame, ix, iy, iz, sum(value) AS value FROM ev GROUP BY ALL)"""
_FOLD = """fold AS (SELECT ix, iy, iz, list_reduce(list_prepend(0.0::DOUBLE, list(value ORDER BY frame)), lambda a, x: greatest(-2.0, least(3.5, a + x))) AS l FROM summed GROUP BY ALL)"""


def _evidence(spark, sf_dir):
    frame = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        frame.alias("frame"),
        F.floor(F.col("l_quantity") / 10).alias("ix"),
        F.floor(F.col("l_extendedprice") / 20000).alias("iy"),
        F.col("l_linenumber").cast("long").alias("iz"),
        ((F.col("l_discount") - F.col("l_tax")) * 4).alias("value"),
        F.col("l_tax").alias("tr"),
    )


def _fold(spark, sf_dir, chunk=12):
    return voxels.clamped_fold(voxels.frame_evidence(_evidence(spark, sf_dir), ["frame"]), list(CELL), "frame", "value", voxels.Occupancy(), chunk)


@query(f"WITH {_EVIDENCE} SELECT frame, ix, iy, iz, round(value, 6) + 0.0 AS value FROM summed")
def frame_scatter_add(spark, sf_dir):
    return voxels.frame_evidence(_evidence(spark, sf_dir), ["frame"]).select("frame", *CELL, (r6("value") + 0.0).alias("value"))


@query(f"WITH {_EVIDENCE}, {_FOLD} SELECT ix, iy, iz, round(l, 6) + 0.0 AS l FROM fold")
def clamped_fold(spark, sf_dir):
    return _fold(spark, sf_dir).select(*CELL, (r6("l") + 0.0).alias("l"))


@query(f"WITH {_EVIDENCE}, {_FOLD} SELECT ix, iy, iz, round(l, 6) + 0.0 AS l FROM fold")
def kept_map(spark, sf_dir):
    """The same frames in three batches, added to a kept map that is compacted once."""
    evidence = voxels.frame_evidence(_evidence(spark, sf_dir), ["frame"])
    low, high = evidence.agg(F.min("frame"), F.max("frame")).first()
    work = Workspace(spark)
    folder = f"{shared_folder(spark)}/map-{uuid.uuid4().hex}"
    kept = KeptMap(spark, folder, voxels.Occupancy(), buckets=8, chunk=12)
    third = (high - low) // 3 + 1
    for batch in range(3):
        kept.add(evidence.where(F.col("frame").between(low + batch * third, low + (batch + 1) * third - 1)), batch)
        if batch == 1:
            kept.compact()
    return work.keep(kept.cells()).select(*CELL, (r6("l") + 0.0).alias("l"))


@query(f"WITH {_EVIDENCE}, {_FOLD} SELECT CASE WHEN l > 0.85 THEN 'occupied' WHEN l < -0.4 THEN 'free' ELSE 'unknown' END AS label, count(*) AS n FROM fold GROUP BY 1")
def classify(spark, sf_dir):
    return _fold(spark, sf_dir).groupBy(maps.classify(F.col("l")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_EVIDENCE}, tr AS (SELECT frame, avg(tr) AS tr FROM ev GROUP BY frame), per AS (SELECT frame, ix, iy, iz, sum(abs(value)) AS a FROM ev GROUP BY ALL)
SELECT ix, iy, iz, round(sum(a * tr) / sum(a), 6) AS attribution FROM per JOIN tr USING (frame) GROUP BY ALL HAVING sum(a) > 0""")
def attribution(spark, sf_dir):
    ev = _evidence(spark, sf_dir)
    frames = ev.groupBy("frame").agg(F.avg("tr").alias("tr"))
    rows = voxels.attribution(ev.drop("tr").join(frames, "frame"), ["frame"], "tr")
    return rows.where("attribution IS NOT NULL").select(*CELL, r6("attribution").alias("attribution"))


_RASTER = """SELECT {0}gx, gy, max(label) AS label FROM (SELECT trunc((x + 2.0) / 0.5)::INT AS gx, trunc((y + 2.0) / 0.5)::INT AS gy, CASE WHEN {1} THEN 1 ELSE -1 END AS label
    FROM (SELECT *, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings) WHERE abs(z - 0.1) < 1.0)
    WHERE gx BETWEEN 0 AND 7 AND gy BETWEEN 0 AND 7 GROUP BY {0}gx, gy"""


def _raster(spark, sf_dir, occupied):
    p = points(spark, sf_dir, ["x", "y", "z"], 10.0).withColumn("label", F.when(occupied, "occupied").otherwise("free"))
    return maps.raster(p, [], 0.1, 1.0, 0.5, (-2.0, 2.0, -2.0, 2.0))


@query(_RASTER.format("", "label < 3"))
def raster_slice(spark, sf_dir):
    return _raster(spark, sf_dir, F.col("label") < 3)


@query(f"""WITH w AS ({_RASTER.format("", "label < 2")}), u AS ({_RASTER.format("", "label = 0")}),
d AS (SELECT gx, gy, coalesce(w.label, 0) AS weighted, coalesce(u.label, 0) AS uniform FROM w FULL JOIN u USING (gx, gy))
SELECT gx, gy, weighted, uniform, uniform = -1 AND weighted <> -1 AS suppressed FROM d""")
def map_diff(spark, sf_dir):
    return maps.difference(_raster(spark, sf_dir, F.col("label") < 2), _raster(spark, sf_dir, F.col("label") == 0), ["gx", "gy"])


@query(f"""WITH w AS ({_RASTER.format("", "label < 2")}), u AS ({_RASTER.format("", "label = 0")}),
d AS (SELECT coalesce(w.label, 0) AS weighted, coalesce(u.label, 0) AS uniform FROM w FULL JOIN u USING (gx, gy))
SELECT count(*) FILTER (uniform = -1 AND weighted <> -1) AS suppressed, count(*) FILTER (uniform = -1) AS uniform_free,
    round(100.0::DOUBLE * count(*) FILTER (uniform = -1 AND weighted <> -1) / greatest(count(*) FILTER (uniform = -1), 1), 6) AS percent FROM d""")
def map_diff_share(spark, sf_dir):
    return maps.suppressed_share(map_diff(spark, sf_dir)).withColumn("percent", r6("percent"))


_VOXELS = "c AS (SELECT DISTINCT floor(embedding[1]::DOUBLE * 10 / 1.0 + 1e-6::DOUBLE)::BIGINT AS ix, floor(embedding[2]::DOUBLE * 10 / 1.0 + 1e-6::DOUBLE)::BIGINT AS iy, floor(embedding[3]::DOUBLE * 10 / 1.0 + 1e-6::DOUBLE)::BIGINT AS iz FROM embeddings)"


def _voxels(spark, sf_dir):
    return maps.voxel_index(points(spark, sf_dir, ["x", "y", "z"], 10.0), 1.0).select(*CELL).distinct()


@query(f"""WITH {_VOXELS}, n AS (SELECT a.ix, a.iy, a.iz, count(b.ix) AS neighbours FROM c a LEFT JOIN c b
    ON abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1 AND (a.ix, a.iy, a.iz) <> (b.ix, b.iy, b.iz) GROUP BY ALL)
SELECT *, round_even(neighbours / 26.0::DOUBLE * 255.0::DOUBLE, 0)::INT AS ao FROM n""")
def ao_26(spark, sf_dir):
    return maps.ambient_occlusion(_voxels(spark, sf_dir), [])


@query(f"""WITH {_VOXELS}, o(dx, dy, dz, bit) AS (VALUES (1, 0, 0, 1), (-1, 0, 0, 2), (0, 1, 0, 4), (0, -1, 0, 8), (0, 0, 1, 16), (0, 0, -1, 32)),
h AS (SELECT a.ix, a.iy, a.iz, sum(bit) AS mask FROM c a JOIN o ON true JOIN c b ON b.ix = a.ix + dx AND b.iy = a.iy + dy AND b.iz = a.iz + dz GROUP BY ALL)
SELECT ix, iy, iz, coalesce(mask, 0)::INT AS mask, bit_count(coalesce(mask, 0)::INT)::INT AS hidden FROM c LEFT JOIN h USING (ix, iy, iz)""")
def face_mask(spark, sf_dir):
    return maps.face_mask(_voxels(spark, sf_dir), []).withColumn("hidden", F.bit_count("mask"))


@query("""WITH p AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
b AS (SELECT quantile_cont(z, 0.01) AS z_low, quantile_cont(z, 0.99) AS z_high FROM p), core AS (SELECT p.* FROM p, b WHERE z > z_low AND z < z_high),
m AS (SELECT quantile_cont(x, 0.5) AS cx, quantile_cont(y, 0.5) AS cy, quantile_cont(z, 0.5) AS cz FROM core),
r AS (SELECT quantile_cont(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2), 0.97) AS radius FROM core, m)
SELECT round(z_low, 6) AS z_low, round(z_high, 6) AS z_high, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, round(radius, 6) AS radius FROM b, m, r""")
def framing_percentiles(spark, sf_dir):
    found = maps.framing(points(spark, sf_dir, ["x", "y", "z"]))
    return found.select(*[r6(c).alias(c) for c in found.columns])


@query("SELECT round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events")
def sigma_u_stats(spark, sf_dir):
    return voxels.sigma_stats(events(spark, sf_dir), "value").select(r6("median").alias("median"), r6("p90").alias("p90"))


@query("SELECT round(avg(m), 6) AS mean_drop FROM (SELECT avg(value) AS m FROM events GROUP BY user_id)")
def trunc_stats(spark, sf_dir):
    return voxels.two_level_mean(events(spark, sf_dir), ["user_id"], "value", "mean_drop").select(r6("mean_drop").alias("mean_drop"))


@query("SELECT event_type, min(value) AS low, quantile_cont(value, 0.5) AS middle, max(value) AS high FROM events GROUP BY event_type")
def trace_range(spark, sf_dir):
    return voxels.trace_range(events(spark, sf_dir), ["event_type"], "value")


#: Rays of frames (label) with a depth sigma and a pose covariance diag(c, c / 2, c / 4), c = 0.2 * label; the trace is 1.75 c.
_MAP = voxels.Occupancy(resolution=RES, max_ray=4.0, dynamic_radius=1.0)
_KEPT = f"""kept AS (SELECT *, least(greatest({{weight}}, 0), 1) AS w, sqrt(least({", ".join(f"(px - {a}::DOUBLE) ** 2 + (py - {b}::DOUBLE) ** 2 + (pz - {c}::DOUBLE) ** 2" for a, b, c in _OTHERS)})) < 1.0 AS near
    FROM (SELECT *, sqrt((px - ox) ** 2 + (py - oy) ** 2 + (pz - oz) ** 2) AS n, label * 0.2 * 1.75 AS tr, (vec_id % 10) / 20.0::DOUBLE AS sz FROM ray) WHERE n > {RES} AND n <= 4.0)"""
_WEIGHT = "exp(-tr / 0.3) * exp(-(sz * sz) / 0.5)"
_ENDS = f"""ends AS (SELECT label, floor(px / {RES})::BIGINT AS ix, floor(py / {RES})::BIGINT AS iy, floor(pz / {RES})::BIGINT AS iz, w * 0.85 AS value FROM kept WHERE NOT near)"""


def _integrated(spark, sf_dir, c):
    rays = _rays(spark, sf_dir)
    k, zero = F.col("label") * 0.2, F.lit(0.0)
    others = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, "xyz", strict=True)]) for o in _OTHERS])
    rays = rays.withColumns({"tr": k * 1.75, "sigma_z": (F.col("vec_id") % 10) / 20.0, "sigma_pos": F.array(k, zero, zero, zero, k * 0.5, zero, zero, zero, k * 0.25), "mates": others})
    found = voxels.frame_evidence(voxels.integrate(rays, c, ["label"], ORIGIN, POINT, "mates", "sigma_pos"), ["label"])
    return found.select("label", *CELL, (r6("value") + 0.0).alias("value"))


def _integrate_sql(free: str, more: str = "") -> str:
    return f"""WITH RECURSIVE {_RAYS}{more}, {_KEPT.format(weight=_WEIGHT)}, {_ENDS},
    free AS (SELECT kept.label, c.ix, c.iy, c.iz, {free})
    SELECT label, ix, iy, iz, round(sum(value), 6) + 0.0 AS value FROM (SELECT * FROM ends UNION ALL SELECT * FROM free) GROUP BY ALL"""


@query(_integrate_sql("w * -0.4 AS value FROM kept JOIN crossed c USING (vec_id)"))
def integrate_plain(spark, sf_dir):
    return _integrated(spark, sf_dir, _MAP)


@query(_integrate_sql(f"w * -0.4 * exp(-(su * su) / {RES * RES}) AS value FROM kept JOIN crossed c USING (vec_id) JOIN sig USING (vec_id)", ", " + _SIGMA))
def integrate_free_scale(spark, sf_dir):
    return _integrated(spark, sf_dir, replace(_MAP, free_mode="scale"))


@query(_integrate_sql(f"w * -0.4 AS value FROM kept JOIN crossed c USING (vec_id) JOIN sig USING (vec_id) WHERE pos < cells - least(floor(1.0 * su / {RES}), cells)", ", " + _SIGMA))
def integrate_free_truncate(spark, sf_dir):
    return _integrated(spark, sf_dir, replace(_MAP, free_mode="truncate"))


_SPREAD_RAYS = _RAYS.replace("embedding[4]::DOUBLE * 10 AS px", "embedding[4]::DOUBLE * 10 AS fx").replace("embedding[5]::DOUBLE * 10 AS py", "embedding[5]::DOUBLE * 10 AS fy").replace("embedding[6]::DOUBLE * 10 AS pz FROM embeddings)", f"""embedding[6]::DOUBLE * 10 AS fz FROM embeddings),
    cut AS (SELECT *, sqrt((fx - ox) ** 2 + (fy - oy) ** 2 + (fz - oz) ** 2) AS n, sqrt(label * 0.2 * 1.75) AS s FROM full_ray),
    stop AS (SELECT *, least(greatest((n - CASE WHEN s >= {RES / 2} THEN 2.0 * s ELSE 0.0 END) / n, 0), 1) AS q FROM cut),
    ray AS (SELECT vec_id, label, ox, oy, oz, ox + (fx - ox) * q AS px, oy + (fy - oy) * q AS py, oz + (fz - oz) * q AS pz FROM stop WHERE q > 0 AND n > {RES} AND n <= 4.0)""").replace("ray AS (SELECT vec_id, label", "full_ray AS (SELECT vec_id, label", 1)


@query(f"""WITH RECURSIVE {_SPREAD_RAYS},
    kept AS (SELECT *, exp(-(((vec_id % 10) / 20.0::DOUBLE) ** 2) / 0.5) AS w, sqrt(least({", ".join(f"(fx - {a}::DOUBLE) ** 2 + (fy - {b}::DOUBLE) ** 2 + (fz - {c}::DOUBLE) ** 2" for a, b, c in _OTHERS)})) < 1.0 AS near FROM stop WHERE n > {RES} AND n <= 4.0),
    k AS (SELECT *, CASE WHEN s >= {RES / 2} THEN 2.0 * s ELSE 0.0 END AS tr, CASE WHEN s >= {RES / 2} THEN ceil(2 * (2.0 * s) / {RES})::INT + 1 ELSE 1 END AS m FROM kept WHERE NOT near),
    x AS (SELECT *, CASE WHEN m > 1 THEN -tr + i * (2 * tr / (m - 1)) ELSE 0.0 END AS off FROM (SELECT *, unnest(range(m)) AS i FROM k)),
    g AS (SELECT *, CASE WHEN m > 1 THEN exp(-(off * off) / (2 * s * s)) ELSE 1.0 END AS d FROM x),
    ends AS (SELECT label, floor((fx + (fx - ox) / n * off) / {RES})::BIGINT AS ix, floor((fy + (fy - oy) / n * off) / {RES})::BIGINT AS iy, floor((fz + (fz - oz) / n * off) / {RES})::BIGINT AS iz, w * 0.85 * (d / sum(d) OVER (PARTITION BY vec_id)) AS value FROM g),
    free AS (SELECT kept.label, c.ix, c.iy, c.iz, w * -0.4 AS value FROM kept JOIN crossed c USING (vec_id))
    SELECT label, ix, iy, iz, round(sum(value), 6) + 0.0 AS value FROM (SELECT * FROM ends UNION ALL SELECT * FROM free) GROUP BY ALL""")
def integrate_spread(spark, sf_dir):
    """Occupied evidence spread along the ray, free cells ended before the uncertain band."""
    return _integrated(spark, sf_dir, replace(_MAP, spread=True))


@query(f"""WITH {_RAYS.split(',' + chr(10) + 'cells AS')[0]}, k AS (SELECT count(*) AS n_points FROM ray WHERE sqrt((px - ox) ** 2 + (py - oy) ** 2 + (pz - oz) ** 2) > {RES} AND sqrt((px - ox) ** 2 + (py - oy) ** 2 + (pz - oz) ** 2) <= 4.0)
SELECT (SELECT count(DISTINCT label) FROM ray) AS n_frames, n_points FROM k""")
def frame_counts(spark, sf_dir):
    rays = _rays(spark, sf_dir)
    return voxels.frame_counts(rays.select("label").distinct(), rays, _MAP, ORIGIN, POINT)


_QUAT_SQL = """q AS (SELECT vec_id, label, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z, embedding[4]::DOUBLE / n AS a, embedding[5]::DOUBLE / n AS b, embedding[6]::DOUBLE / n AS c, embedding[7]::DOUBLE / n AS w
    FROM (SELECT *, sqrt(embedding[4]::DOUBLE ** 2 + embedding[5]::DOUBLE ** 2 + embedding[6]::DOUBLE ** 2 + embedding[7]::DOUBLE ** 2) AS n FROM embeddings))"""


@query(f"""WITH {_QUAT_SQL} SELECT vec_id, round((1 - 2 * (b * b + c * c)) * x + 2 * (a * b - c * w) * y + 2 * (a * c + b * w) * z + 1.5, 6) AS wx,
    round(2 * (a * b + c * w) * x + (1 - 2 * (a * a + c * c)) * y + 2 * (b * c - a * w) * z - 0.5, 6) AS wy, round(2 * (a * c - b * w) * x + 2 * (b * c + a * w) * y + (1 - 2 * (a * a + b * b)) * z + 0.25, 6) AS wz FROM q""")
def world_points(spark, sf_dir):
    """Camera points moved to the world by a row-major rotation and a position."""
    p = points(spark, sf_dir, ["x", "y", "z", "qx", "qy", "qz", "qw"])
    n = F.sqrt(F.col("qx") ** 2 + F.col("qy") ** 2 + F.col("qz") ** 2 + F.col("qw") ** 2)
    q = tuple(F.col(c) / n for c in ("qx", "qy", "qz", "qw"))
    axes = [rotate(q, tuple(F.lit(1.0 if i == k else 0.0) for i in range(3))) for k in range(3)]
    matrix = F.array(*[axes[k][r] for r in range(3) for k in range(3)])
    out = voxels.to_world(matrix, tuple(F.col(c) * 10 for c in "xyz"), (F.lit(1.5), F.lit(-0.5), F.lit(0.25)))
    return p.select("vec_id", *[r6(c).alias(k) for c, k in zip(out, ("wx", "wy", "wz"), strict=True)])


@query(f"""WITH {_RAYS.split(',' + chr(10) + 'cells AS')[0]}, d AS (SELECT *, sqrt((px - ox) ** 2 + (py - oy) ** 2 + (pz - oz) ** 2) AS n, label * 0.4 AS trunc FROM ray),
s AS (SELECT *, least(greatest((n - trunc) / n, 0), 1) AS k FROM d)
SELECT vec_id, round(ox + (px - ox) * k, 6) AS x, round(oy + (py - oy) * k, 6) AS y, round(oz + (pz - oz) * k, 6) AS z, k > 0 AS live FROM s""")
def free_end(spark, sf_dir):
    end, live = voxels.free_end(vec(*ORIGIN), vec(*POINT), F.col("label") * 0.4)
    return _rays(spark, sf_dir).select("vec_id", *[r6(c).alias(k) for c, k in zip(end, "xyz", strict=True)], live.alias("live"))


@query("""WITH c AS (SELECT vec_id, floor(embedding[1]::DOUBLE * 10 / 0.00003::DOUBLE + 1e-6::DOUBLE)::BIGINT AS ix, floor(embedding[2]::DOUBLE * 10 / 0.00003::DOUBLE + 1e-6::DOUBLE)::BIGINT AS iy, floor(embedding[3]::DOUBLE * 10 / 0.00003::DOUBLE + 1e-6::DOUBLE)::BIGINT AS iz FROM embeddings)
SELECT vec_id, ix, iy, iz FROM c WHERE abs(ix) < 32767 AND abs(iy) < 32767 AND abs(iz) < 32767""")
def int16_cells(spark, sf_dir):
    return maps.voxel_index(points(spark, sf_dir, ["x", "y", "z"], 10.0), 0.00003).select("vec_id", *CELL)


@query(f"WITH {_VOXELS} SELECT ix, iy, iz FROM c WHERE (iz + 0.5::DOUBLE) * 1.0 BETWEEN -0.5 AND 1.5")
def height_slice(spark, sf_dir):
    return sinks.height_slice(_voxels(spark, sf_dir), 1.0, -0.5, 1.5)


@query(f"WITH {_EVIDENCE}, {_FOLD} SELECT ix, iy, iz, round(1 / (1 + exp(-l)), 6) AS p FROM fold")
def occupancy_probability(spark, sf_dir):
    return _fold(spark, sf_dir).select(*CELL, r6(logistic(F.col("l"))).alias("p"))


def _stops_sql(stops) -> str:
    channel = lambda k: "[" + ", ".join(f"{s[k]}.0::DOUBLE" for s in stops) + "]"
    return ", ".join(f"round_even({channel(k)}[i + 1] * (1 - (s - i)) + {channel(k)}[i + 2] * (s - i), 0)::INT AS {n}" for k, n in enumerate("rgb"))


def _colour_sql(stops) -> str:
    return f"SELECT event_id, {_stops_sql(stops)} FROM (SELECT *, least(floor(s), 8)::INT AS i FROM (SELECT event_id, least(greatest(value / 150, 0.0), 1.0) * 9 AS s FROM events))"


def _coloured(spark, sf_dir, stops):
    return events(spark, sf_dir).select("event_id", *[c.alias(n) for c, n in zip(colour(F.col("value") / 150, stops), "rgb", strict=True)])


@query(_colour_sql(VIRIDIS))
def colormap_lut(spark, sf_dir):
    return _coloured(spark, sf_dir, VIRIDIS)


@query(_colour_sql(CIVIDIS))
def colormap_cividis(spark, sf_dir):
    return _coloured(spark, sf_dir, CIVIDIS)


@query("""WITH o AS (SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS pos, count(*) OVER () AS n FROM events),
k AS (SELECT DISTINCT floor(i * ((n - 1) / 699.0::DOUBLE))::BIGINT AS pos FROM (SELECT any_value(n) AS n FROM o), range(700) AS r(i))
SELECT event_id FROM o WHERE pos IN (SELECT pos FROM k) OR n <= 700""")
def thinning(spark, sf_dir):
    return maps.thinned(events(spark, sf_dir), 700, ["value", "event_id"]).select("event_id")


@query("""WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)
SELECT a.vec_id FROM e a WHERE a.vec_id % 5 <> 0 AND EXISTS (SELECT 1 FROM e b WHERE b.vec_id % 5 = 0 AND b.label = a.label AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) < 0.1)""")
def near_others(spark, sf_dir):
    """Points that another of their frame is near, by a hashed grid."""
    p = points(spark, sf_dir, ["x", "y", "z"])
    fifth = F.col("vec_id") % 5 == 0
    return voxels.near_rows(p.where(~fifth), p.where(fifth), ["label"], ("x", "y", "z"), ("x", "y", "z"), 0.1).select("vec_id")


@query("""WITH e AS (SELECT event_type, epoch_us(ts) / 1e6 AS t, value, event_id FROM events), b AS (SELECT min(t) AS lo, max(t) AS hi FROM e),
p AS (SELECT *, least(floor((t - lo) / (hi - lo) * 300), 299)::INT AS px FROM e, b)
SELECT event_type, px, round(min(value), 6) AS least, round(max(value), 6) AS most, round(arg_min(value, t), 6) AS first, round(arg_max(value, t), 6) AS last FROM p GROUP BY event_type, px""")
def figure_spans(spark, sf_dir):
    """What a figure 300 pixels wide shows of the events' values in time."""
    e = events(spark, sf_dir).withColumn("t", F.col("t") / 1e6)
    low, high = e.agg(F.min("t"), F.max("t")).first()
    found = figures.spans(e, ["event_type"], "t", "value", low, high, 300)
    return found.select("event_type", "px", *[r6(c).alias(c) for c in ("least", "most", "first", "last")])


@query("""SELECT label, least(floor((embedding[1]::DOUBLE + 0.2) / 0.4 * 40), 39)::INT AS px, least(floor((embedding[2]::DOUBLE + 0.2) / 0.4 * 30), 29)::INT AS py, min(vec_id) AS since
FROM embeddings WHERE embedding[1]::DOUBLE BETWEEN -0.2 AND 0.2 AND embedding[2]::DOUBLE BETWEEN -0.2 AND 0.2 GROUP BY ALL""")
def figure_trails(spark, sf_dir):
    """Pixels that a figure of 40 by 30 shows of points in the plane."""
    return figures.trails(points(spark, sf_dir, ["x", "y"]), ["label"], "vec_id", "x", "y", (-0.2, 0.2, -0.2, 0.2), 40, 30)
