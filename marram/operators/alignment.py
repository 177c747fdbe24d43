"""Alignment of tracks and their error against truth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marram.functions.geometry import length, minus, vec
from marram.operators.lie import rotation_of

SRC, DST = ("sx", "sy", "sz"), ("dx", "dy", "dz")


def yaw_alignment(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, n, yaw, tx, ty, tz of the rotation about z and translation that take SRC columns to DST columns best.

    Centred sums come from plain sums in one aggregation: sum (a-ma)(b-mb) = sum ab - n ma mb.
    """
    means = {c: F.avg(c) for c in (*SRC, *DST)}
    n = F.count(F.lit(1))
    centred = lambda a, b: F.sum(F.col(a) * F.col(b)) - n * means[a] * means[b]
    got = pairs.groupBy(*by).agg(
        n.alias("n"),
        F.atan2(centred("sx", "dy") - centred("sy", "dx"), centred("sx", "dx") + centred("sy", "dy")).alias("yaw"),
        *[m.alias(f"m_{c}") for c, m in means.items()],
    )
    cos, sin = F.cos("yaw"), F.sin("yaw")
    return got.select(
        *by,
        "n",
        "yaw",
        (F.col("m_dx") - (cos * F.col("m_sx") - sin * F.col("m_sy"))).alias("tx"),
        (F.col("m_dy") - (sin * F.col("m_sx") + cos * F.col("m_sy"))).alias("ty"),
        (F.col("m_dz") - F.col("m_sz")).alias("tz"),
    )


def turned(x: str, y: str, z: str) -> tuple[Column, Column, Column]:
    """A point moved by columns yaw, tx, ty, tz."""
    cos, sin = F.cos("yaw"), F.sin("yaw")
    return cos * F.col(x) - sin * F.col(y) + F.col("tx"), sin * F.col(x) + cos * F.col(y) + F.col("ty"), F.col(z) + F.col("tz")


def aligned_by_yaw(pairs: DataFrame, by: list[str]) -> DataFrame:
    """``pairs`` with aligned source as ax, ay, az and distance to the target as error."""
    moved = pairs.join(yaw_alignment(pairs, by), by)
    x, y, z = turned(*SRC)
    moved = moved.withColumns({"ax": x, "ay": y, "az": z})
    return moved.withColumn("error", length(minus(vec("ax", "ay", "az"), vec(*DST))))


def rmse(errors: DataFrame, by: list[str], least_rows: int = 5) -> DataFrame:
    """by, n, rmse of column error; groups under least_rows are left out."""
    return errors.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse")).where(F.col("n") >= least_rows)


def similarity(sums: dict[str, float], n: int, with_scale: bool) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, unit quaternion (xyzw) and translation from moments: sums and products of SRC and DST.

    Horn's form: the best rotation's quaternion is the top eigenvector of a symmetric 4x4 matrix of
    the centred products, and the eigenvalue is the sum of target times rotated source.
    """
    centre_s, centre_d = (np.array([sums[c] for c in cs]) / n for cs in (SRC, DST))
    m = {f"{a[1]}{b[1]}": sums[f"{a}{b}"] - n * centre_s[i] * centre_d[j] for i, a in enumerate(SRC) for j, b in enumerate(DST)}
    form = np.empty((4, 4))
    form[0, 0] = m["xx"] - m["yy"] - m["zz"]
    form[1, 1] = m["yy"] - m["xx"] - m["zz"]
    form[2, 2] = m["zz"] - m["xx"] - m["yy"]
    form[3, 3] = m["xx"] + m["yy"] + m["zz"]
    for i, j, a, b, sign in ((0, 1, "xy", "yx", 1), (0, 2, "zx", "xz", 1), (1, 2, "yz", "zy", 1), (0, 3, "yz", "zy", -1), (1, 3, "zx", "xz", -1), (2, 3, "xy", "yx", -1)):
        form[i, j] = form[j, i] = m[a] + sign * m[b]
    values, vectors = np.linalg.eigh(form)
    own = sum(sums[f"{a}{a}"] for a in SRC) - n * float(centre_s @ centre_s)
    scale = float(values[-1]) / own if with_scale and own > 0 else 1.0
    quaternion = vectors[:, -1]
    return scale, quaternion, centre_d - scale * rotation_of(quaternion) @ centre_s


def similarity_alignment(pairs: DataFrame, by: list[str], with_scale: bool = True) -> DataFrame:
    """by, n, scale, rotation array<double> (row-major 9), translation array<double> (3), quaternion array<double> (xyzw).

    Moments are plain aggregates; only one row per group reaches the 4x4 eigenproblem. Groups are
    first moved by their means, so that far origins cost no digits.
    """
    centre = pairs.groupBy(*by).agg(*[F.avg(c).alias(f"o_{c}") for c in (*SRC, *DST)])
    near = pairs.join(centre, by).withColumns({c: F.col(c) - F.col(f"o_{c}") for c in (*SRC, *DST)})
    moments = [F.sum(c).alias(c) for c in (*SRC, *DST)]
    moments += [F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for a in SRC for b in DST]
    moments += [F.sum(F.col(a) * F.col(a)).alias(f"{a}{a}") for a in SRC]
    rows = near.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *moments, *[F.first(f"o_{c}").alias(f"o_{c}") for c in (*SRC, *DST)])
    k = len(by)
    kinds = [f for f in rows.schema.fields[:k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                scale, quaternion, shift = similarity(r, r["n"], with_scale)
                rotation = rotation_of(quaternion)
                shift = shift + np.array([r[f"o_{c}"] for c in DST]) - scale * rotation @ np.array([r[f"o_{c}"] for c in SRC])
                out.append((r["n"], scale, rotation.reshape(-1).tolist(), shift.tolist(), quaternion.tolist()))
            columns = list(zip(*out, strict=True)) or [[], [], [], [], []]
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), *[pa.list_(pa.float64())] * 3), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *made], names=[*by, "n", "scale", "rotation", "translation", "quaternion"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    return rows.mapInArrow(run, f"{fields}, n long, scale double, rotation array<double>, translation array<double>, quaternion array<double>")


def aligned_by_similarity(pairs: DataFrame, by: list[str], with_scale: bool = True) -> DataFrame:
    """As ``aligned_by_yaw`` for a rigid (with_scale=False) or similarity transform."""
    moved = pairs.join(similarity_alignment(pairs, by, with_scale), by)
    m = lambda i: F.get("rotation", F.lit(i))
    at = [F.col("scale") * (m(3 * r) * F.col("sx") + m(3 * r + 1) * F.col("sy") + m(3 * r + 2) * F.col("sz")) + F.get("translation", F.lit(r)) for r in range(3)]
    moved = moved.withColumns(dict(zip(("ax", "ay", "az"), at, strict=True)))
    return moved.withColumn("error", length(minus(vec("ax", "ay", "az"), vec(*DST))))
