"""Series reduced to what a figure of a given size can show, whatever their length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pixel(value: Column, low: float, high: float, size: int) -> Column:
    """Pixel 0 to size - 1 of a value from low to high, both included."""
    return F.least(F.floor((value - low) / (high - low) * size), F.lit(size - 1)).cast("int")


def spans(rows: DataFrame, by: list[str], x: str, y: str, low: float, high: float, width: int) -> DataFrame:
    """by, px, least, most, first, last: of each pixel column the range of y, and where a line enters and leaves it; x from low to high."""
    inside = rows.where(F.col(x).between(low, high) & F.col(y).isNotNull() & ~F.isnan(y))
    return inside.groupBy(*by, _pixel(F.col(x), low, high, width).alias("px")).agg(F.min(y).alias("least"), F.max(y).alias("most"), F.min(F.struct(x, y))[y].alias("first"), F.max(F.struct(x, y))[y].alias("last"))


def trails(rows: DataFrame, by: list[str], t: str, x: str, y: str, bounds: tuple[float, float, float, float], width: int, height: int) -> DataFrame:
    """by, px, py, since: pixels that a track visits within bounds (x0, x1, y0, y1), with the time of the first visit; py grows upwards."""
    x0, x1, y0, y1 = bounds
    inside = rows.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
    return inside.groupBy(*by, _pixel(F.col(x), x0, x1, width).alias("px"), _pixel(F.col(y), y0, y1, height).alias("py")).agg(F.min(t).alias("since"))
