"""A voxel map kept up to date from a stream of frames, and association of streams within a tolerance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marram.operators.voxels import CELL, Occupancy


def live_fold(evidence: DataFrame, c: Occupancy) -> DataFrame:
    """ix, iy, iz, l after each micro-batch, from streaming (frame long, ix, iy, iz, value).

    A batch's frames of a cell are summed and folded in frame order, with a clamp after each. Frames
    of later batches come after those of earlier ones, so a source must deliver whole frames in order.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level = state.get[0] if state.exists else 0.0
        rows = pd.concat(batches)
        for v in rows.groupby("frame")["value"].sum().sort_index():
            level = max(c.low, min(c.high, level + float(v)))
        state.update((level,))
        yield pd.DataFrame([[*key, level]], columns=[*CELL, "l"])

    return evidence.groupBy(*CELL).applyInPandasWithState(run, "ix long, iy long, iz long, l double", "l double", "update", GroupStateTimeout.NoTimeout)


def within_tolerance(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str, seconds: float, late: str = "1 minute") -> DataFrame:
    """Pairs of two streams no more than ``seconds`` apart, with gap in seconds; state is bounded by watermarks.

    on and right_on are timestamps. The nearest of a left row's pairs is its match; which one that
    is can only be told when the watermark has passed, so a batch consumer reduces the pairs.
    """
    interval = F.expr(f"INTERVAL {int(seconds * 1e6)} MICROSECONDS")
    a, b = left.withWatermark(on, late), right.withWatermark(right_on, late)
    for c in by:
        b = b.withColumnRenamed(c, f"__{c}")
    same = F.lit(True)
    for c in by:
        same = same & (F.col(c) == F.col(f"__{c}"))
    near = (F.col(right_on) >= F.col(on) - interval) & (F.col(right_on) <= F.col(on) + interval)
    gap = F.abs(F.unix_micros(F.col(on)) - F.unix_micros(F.col(right_on))) / 1e6
    return a.join(b, same & near).drop(*[f"__{c}" for c in by]).withColumn("gap", gap)
