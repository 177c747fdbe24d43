"""Vectors, rotations and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def vec(*names: str) -> Vector:
    return tuple(F.col(n) for n in names)


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def plus(a: Vector, b: Vector) -> Vector:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def length(a: Vector) -> Column:
    x, y, z = a
    return F.sqrt(x * x + y * y + z * z)


def rotate(q: tuple[Column, Column, Column, Column], v: Vector) -> Vector:
    """Rotate by a unit quaternion (x, y, z, w)."""
    x, y, z, w = q
    a, b, c = v
    return (
        (1 - 2 * (y * y + z * z)) * a + 2 * (x * y - z * w) * b + 2 * (x * z + y * w) * c,
        2 * (x * y + z * w) * a + (1 - 2 * (x * x + z * z)) * b + 2 * (y * z - x * w) * c,
        2 * (x * z - y * w) * a + 2 * (y * z + x * w) * b + (1 - 2 * (x * x + y * y)) * c,
    )


def times(matrix: Column, v: Vector) -> Vector:
    """Row-major 3x3 array column times a vector."""
    m = lambda i: F.get(matrix, F.lit(i))
    return tuple(m(3 * r) * v[0] + m(3 * r + 1) * v[1] + m(3 * r + 2) * v[2] for r in range(3))


def quadratic_form(matrix: Column, u: Vector) -> Column:
    s = times(matrix, u)
    return s[0] * u[0] + s[1] * u[1] + s[2] * u[2]


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


#: Ten stops of two colour maps, red green blue.
VIRIDIS = ((68, 1, 84), (72, 40, 120), (62, 74, 137), (49, 104, 142), (38, 130, 142), (31, 158, 137), (53, 183, 121), (109, 205, 89), (180, 222, 44), (253, 231, 37))
CIVIDIS = ((0, 34, 78), (18, 53, 112), (59, 73, 108), (87, 93, 109), (112, 113, 115), (138, 134, 120), (165, 156, 116), (195, 179, 105), (225, 204, 85), (254, 232, 56))


def colour(t: Column, stops=VIRIDIS) -> Vector:
    """Red, green, blue (0..255, half-even) of t in 0..1, linear between the stops."""
    last = len(stops) - 1
    at = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * last
    i = F.least(F.floor(at), F.lit(last - 1)).cast("int")
    f = at - i
    out = []
    for channel in range(3):
        levels = F.array(*[F.lit(float(s[channel])) for s in stops])
        out.append(F.rint(F.get(levels, i) * (1 - f) + F.get(levels, i + 1) * f).cast("int"))
    return tuple(out)
