"""Queries: rectification, disparities and octrees. The components of an embedding stand for a grey image of eight by eight pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from marram.operators import stereo
from marram.plans.registry import points, query, r6, table
from marram.session import Workspace
from marram.sources import octree
from marram.sources.dimensions import StereoCalibration

_SIDE, _MOST = 8, 4
_PAIR = StereoCalibration(
    ((9.0, 9.2, 3.6, 3.4), (9.1, 9.0, 3.5, 3.5)),
    ((-0.05, 0.01, 0.001, -0.002), (-0.04, 0.02, -0.001, 0.001)),
    (_SIDE, _SIDE),
    (0.9992, -0.0300, 0.0249, -0.20, 0.0305, 0.9993, -0.0196, 0.004, -0.0243, 0.0203, 0.9995, 0.003, 0.0, 0.0, 0.0, 1.0),
)
_FLAT = stereo.rectification(_PAIR)


def _images(spark, sf_dir):
    """vec_id, v, u, grey."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    at = rows.select("vec_id", F.floor(F.col("i") / _SIDE).cast("int").alias("v"), (F.col("i") % _SIDE).cast("int").alias("u"), F.floor(F.col("x").cast("double") * 1000).cast("long").alias("grey"))
    return at


_IMAGES = "px AS (SELECT vec_id, (i - 1) // 8 AS v, (i - 1) % 8 AS u, floor(embedding[i]::DOUBLE * 1000)::BIGINT AS grey FROM embeddings, range(1, 65) AS r(i))"


def _rectified_sql(camera: int) -> str:
    m, (fx, fy, cx, cy), (k1, k2, p1, p2) = _FLAT.rotations[camera], _PAIR.intrinsics[camera], _PAIR.distortion[camera]
    n = lambda x: f"({x!r}::DOUBLE)"
    ray = lambda k: f"({n(m[k])} * x + {n(m[3 + k])} * y + {n(m[6 + k])})"
    return f"""WITH {_IMAGES},
g AS (SELECT v, u, (u - {n(_FLAT.cx)}) / {n(_FLAT.focal)} AS x, (v - {n(_FLAT.cy)}) / {n(_FLAT.focal)} AS y FROM range(8) AS a(v), range(8) AS b(u)),
t AS (SELECT v, u, {ray(0)} / {ray(2)} AS x, {ray(1)} / {ray(2)} AS y FROM g),
d AS (SELECT *, x * x + y * y AS r2 FROM t),
s AS (SELECT v, u, {n(fx)} * (x * (1 + {n(k1)} * r2 + {n(k2)} * r2 * r2) + 2 * {n(p1)} * x * y + {n(p2)} * (r2 + 2 * x * x)) + {n(cx)} AS sx,
             {n(fy)} * (y * (1 + {n(k1)} * r2 + {n(k2)} * r2 * r2) + {n(p1)} * (r2 + 2 * y * y) + 2 * {n(p2)} * x * y) + {n(cy)} AS sy FROM d)
SELECT vec_id, s.v::INT AS v, s.u::INT AS u, round(sum(greatest(0, 1 - abs(sx - px.u)) * greatest(0, 1 - abs(sy - px.v)) * grey), 4) + 0.0 AS grey
FROM s JOIN px ON abs(sx - px.u) < 1 AND abs(sy - px.v) < 1 GROUP BY vec_id, s.v, s.u"""


@query(_rectified_sql(0))
def rectified_left(spark, sf_dir):
    mapping = stereo.rectifying_map(spark, _PAIR, _FLAT, 0)
    return stereo.remapped(_images(spark, sf_dir), ["vec_id"], mapping).select("vec_id", "v", "u", (F.round("grey", 4) + 0.0).alias("grey"))


@query(_rectified_sql(1))
def rectified_right(spark, sf_dir):
    mapping = stereo.rectifying_map(spark, _PAIR, _FLAT, 1)
    return stereo.remapped(_images(spark, sf_dir), ["vec_id"], mapping).select("vec_id", "v", "u", (F.round("grey", 4) + 0.0).alias("grey"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 6) + 0.0 AS x, round(embedding[2]::DOUBLE, 6) + 0.0 AS y FROM embeddings")
def undistorted_points(spark, sf_dir):
    """Points freed of distortion, and distorted again: they come back."""
    p = points(spark, sf_dir, ["x", "y"])
    k = _PAIR.distortion[0]
    free = p.select("vec_id", stereo.undistorted(F.col("x"), F.col("y"), k).alias("p"))
    x, y = stereo.distorted(F.col("p.x"), F.col("p.y"), k)
    return free.select("vec_id", (r6(x) + 0.0).alias("x"), (r6(y) + 0.0).alias("y"))


def _bits_sql(name: str) -> str:
    place = "((n.v - p.v + 1) * 3 + n.u - p.u + 1)"
    return f"SELECT p.vec_id, p.v, p.u, sum(CASE WHEN n.{name} < p.{name} THEN 1::BIGINT << ({place} - ({place} > 4)::INT) ELSE 0 END)::BIGINT AS bits FROM im p JOIN im n ON n.vec_id = p.vec_id AND abs(n.v - p.v) <= 1 AND abs(n.u - p.u) <= 1 AND (n.v <> p.v OR n.u <> p.u) GROUP BY p.vec_id, p.v, p.u"


@query(f"""WITH {_IMAGES},
im AS (SELECT a.vec_id, a.v, a.u, a.grey AS l, coalesce(b.grey, -a.grey) AS r FROM px a LEFT JOIN px b ON b.vec_id = a.vec_id AND b.v = a.v AND b.u = a.u + a.vec_id % 3),
cl AS ({_bits_sql("l")}), cr AS ({_bits_sql("r")}),
c AS (SELECT l.vec_id, l.v, l.u, l.u - r.u AS d, bit_count(xor(l.bits, r.bits))::BIGINT AS c FROM cl l JOIN cr r ON r.vec_id = l.vec_id AND r.v = l.v AND l.u - r.u BETWEEN 0 AND {_MOST - 1}),
box AS (SELECT p.vec_id, p.v, p.u, p.d, sum(n.c) AS c FROM c p JOIN c n ON n.vec_id = p.vec_id AND n.d = p.d AND abs(n.v - p.v) <= 1 AND abs(n.u - p.u) <= 1 GROUP BY ALL),
best AS (SELECT * FROM box QUALIFY row_number() OVER (PARTITION BY vec_id, v, u ORDER BY c, d) = 1),
theirs AS (SELECT vec_id, v, u - d AS u, d FROM box QUALIFY row_number() OVER (PARTITION BY vec_id, v, u - d ORDER BY c, d) = 1),
j AS (SELECT b.*, t.d AS other, x.c AS x, y.c AS y, EXISTS (SELECT 1 FROM box k WHERE k.vec_id = b.vec_id AND k.v = b.v AND k.u = b.u AND abs(k.d - b.d) > 1 AND k.c * 100 < b.c * 110) AS rival
    FROM best b JOIN theirs t ON t.vec_id = b.vec_id AND t.v = b.v AND t.u = b.u - b.d
    LEFT JOIN box x ON x.vec_id = b.vec_id AND x.v = b.v AND x.u = b.u AND x.d = b.d - 1 LEFT JOIN box y ON y.vec_id = b.vec_id AND y.v = b.v AND y.u = b.u AND y.d = b.d + 1)
SELECT vec_id, v::INT AS v, u::INT AS u, round(CASE WHEN NOT rival AND abs(other - d) <= 1 THEN d + CASE WHEN x - 2 * c + y > 0 THEN (x - y)::DOUBLE / (2 * (x - 2 * c + y)) ELSE 0 END END, 6) AS disparity FROM j""")
def stereo_disparity(spark, sf_dir):
    """Left images, and right ones shifted by no, one or two pixels."""
    images = _images(spark, sf_dir)
    shifted = images.select("vec_id", "v", (F.col("u") - F.col("vec_id") % 3).alias("u"), F.col("grey").alias("right"))
    pairs = images.withColumnRenamed("grey", "left").join(shifted, ["vec_id", "v", "u"], "left").withColumn("right", F.coalesce("right", -F.col("left")))
    return stereo.disparities(pairs, ["vec_id"], _MOST, reach=1).select("vec_id", "v", F.col("u").cast("int").alias("u"), r6("disparity").alias("disparity"))


def _spread_sql(c: str, k: int) -> str:
    return f"list_sum(list_transform(range(16), lambda i: ((({c} + 32768) >> i) & 1) << (3 * i + {k})))::BIGINT"


@query(f"""WITH RECURSIVE c AS (SELECT l_partkey % 23 - 9 AS ix, l_suppkey % 9 - 4 AS iy, l_linenumber::BIGINT - 3 AS iz, max(l_discount) - 0.05 >= 0 AS hit FROM lineitem GROUP BY ALL),
b AS (SELECT ix // 2 AS x, iy // 2 AS y, iz // 2 AS z, max(ix) AS ix, max(hit) AS hit FROM c WHERE ix >= 0 AND iy >= 0 AND iz >= 0 GROUP BY 1, 2, 3),
cells AS (SELECT ix, iy, iz, hit FROM c UNION ALL SELECT 100 + 2 * x + i % 2, 2 * y + i // 2 % 2, 2 * z + i // 4, hit FROM b, range(8) AS r(i)),
up AS (
    SELECT 16 AS depth, {_spread_sql("ix", 0)} + {_spread_sql("iy", 1)} + {_spread_sql("iz", 2)} AS code, CASE WHEN hit THEN 2 ELSE 1 END AS kind, 0 AS children, 0::BIGINT AS n FROM cells
    UNION ALL
    SELECT any_value(depth) - 1, code >> 3, CASE WHEN count(*) = 8 AND min(kind) = max(kind) AND max(kind) < 3 THEN max(kind) ELSE 3 END, sum(kind::INT << (2 * (code & 7))::INT)::INT, count(*)
    FROM up WHERE depth > 0 GROUP BY code >> 3
)
SELECT depth, code, children, n FROM up WHERE kind = 3 AND depth < 16""")
def octree_nodes(spark, sf_dir):
    """Inner nodes of a pruned octree; the second part of the map is made of blocks of eight equal cells."""
    key = [(F.col("l_partkey") % 23 - 9).alias("ix"), (F.col("l_suppkey") % 9 - 4).alias("iy"), (F.col("l_linenumber").cast("long") - 3).alias("iz")]
    cells = table(spark, sf_dir, "lineitem").select(*key, (F.col("l_discount") - 0.05).alias("l")).groupBy("ix", "iy", "iz").agg(F.max("l").alias("l"))
    blocks = cells.where("ix >= 0 AND iy >= 0 AND iz >= 0").groupBy(*[F.floor(F.col(c) / 2).alias(c) for c in ("ix", "iy", "iz")]).agg(F.max("l").alias("l"))
    eight = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    eight = eight.select((100 + 2 * F.col("ix") + F.col("i") % 2).alias("ix"), (2 * F.col("iy") + F.floor(F.col("i") / 2) % 2).alias("iy"), (2 * F.col("iz") + F.floor(F.col("i") / 4)).alias("iz"), "l")
    return octree.inner_nodes(cells.unionByName(eight), Workspace(spark)).select("depth", "code", "children", "n")
