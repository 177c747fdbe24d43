"""Nearest-in-time joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Slots of so many tolerances, unless a slot is given; seconds of a track that make a slot where there is no tolerance.
SLOT_TOLERANCES, TRACK_SLOT = 64, 60.0


def bracketed(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str, carry: list[str], slot: float | None = None, tie_order: str | None = None) -> DataFrame:
    """Left rows with the nearest right row at their time or before (__back) and at it or after (__fwd), as structs (at, *carry), null where there is none.

    Of right rows at one time the one that is first by tie_order counts. Rows of a null entity or
    time are dropped on either side: an unknown entity is not the same as another.

    With ``slot`` (a length of time) each entity is cut into slots: the windows then run within
    (entity, slot), and what lies beyond a slot is carried in from one summary row per slot, so an
    entity with a third of all rows is spread over tasks. Without it an entity is one window.
    """
    known = F.lit(True)
    for c in by:
        known = known & F.col(c).isNotNull()
    left, right = left.where(known), right.where(known)
    node = F.struct(F.col(right_on).alias("at"), *[F.col(c) for c in carry])
    first = F.min(F.struct(F.col(tie_order or right_on).alias("__o"), node.alias("node"))).alias("__m")
    nodes = right.where(F.col(right_on).isNotNull()).groupBy(*by, right_on).agg(first).select(*by, F.col(right_on).alias("__t"), F.col("__m.node").alias("__node"))
    row = F.struct(*[F.col(c) for c in left.columns])
    asks = left.where(F.col(on).isNotNull()).select(*by, F.col(on).alias("__t"), row.alias("__row"))
    empty_row, empty_node = (F.lit(None).cast(x) for x in (asks.schema["__row"].dataType, nodes.schema["__node"].dataType))
    both = asks.select(*by, "__t", "__row", empty_node.alias("__node")).unionByName(nodes.select(*by, "__t", empty_row.alias("__row"), "__node"))
    is_ask = F.col("__row").isNotNull().cast("int")
    keys = [F.col(c) for c in by]
    if slot is not None:
        both = both.withColumn("__slot", F.floor(F.col("__t") / slot))
        keys.append(F.col("__slot"))
    up = Window.partitionBy(*keys).orderBy("__t", is_ask).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.desc("__t"), is_ask).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__back", F.last("__node", True).over(up)).withColumn("__fwd", F.last("__node", True).over(down)).where("__row IS NOT NULL")
    if slot is not None:
        ends = both.groupBy(*by, "__slot").agg(F.max("__node").alias("__hi"), F.min("__node").alias("__lo"))
        order = Window.partitionBy(*by)
        before = F.last("__hi", True).over(order.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1))
        after = F.last("__lo", True).over(order.orderBy(F.desc("__slot")).rowsBetween(Window.unboundedPreceding, -1))
        ends = ends.select(*by, "__slot", before.alias("__before"), after.alias("__after"))
        met = met.join(ends, [*by, "__slot"]).withColumn("__back", F.coalesce("__back", "__before")).withColumn("__fwd", F.coalesce("__fwd", "__after"))
    return met.where("__back IS NOT NULL OR __fwd IS NOT NULL").select("__row.*", "__t", "__back", "__fwd")


def nearest_asof(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    on: str,
    right_on: str,
    carry: list[str],
    tolerance: float | None = None,
    slot: float | None = None,
    tie_order: str | None = None,
) -> DataFrame:
    """Every left row with the right row nearest in time, right columns ``carry``, and ``gap``.

    Of two equally near rows the earlier wins; of rows at one time the one that is first by
    tie_order. gap is the absolute distance, and rows over ``tolerance`` (inclusive) are dropped.
    ``right_on`` comes back as ``matched_on``. Left rows without any right row are dropped. Entities
    are cut into slots as in ``bracketed``, of SLOT_TOLERANCES tolerances unless ``slot`` is given;
    with neither an entity is one window.
    """
    if slot is None and tolerance:
        slot = SLOT_TOLERANCES * tolerance
    met = bracketed(left, right, by, on, right_on, carry, slot, tie_order)
    back, fwd = F.col("__t") - F.col("__back.at"), F.col("__fwd.at") - F.col("__t")
    nearest = F.when(F.col("__back").isNotNull() & (F.col("__fwd").isNull() | (back <= fwd)), F.col("__back")).otherwise(F.col("__fwd"))
    out = met.withColumn("__hit", nearest)
    out = out.select(*left.columns, F.col("__hit.at").alias("matched_on"), *[F.col(f"__hit.{c}").alias(c) for c in carry], F.abs(F.col("__t") - F.col("__hit.at")).alias("gap"))
    return out if tolerance is None else out.where(F.col("gap") <= tolerance)


def nearest_to_first(left: DataFrame, right: DataFrame, by: list[str], on: str, right_on: str, left_cols: list[str], right_cols: list[str]) -> DataFrame:
    """One row per entity: its first left row with the right row nearest to it, the earlier of ties."""
    first = left.groupBy(*by).agg(F.min_by(F.struct(F.col(on).alias("__t0"), *left_cols), on).alias("__first"))
    joined = right.join(first, by)
    gap = F.abs(F.col(right_on) - F.col("__first.__t0"))
    hit = joined.groupBy(*by).agg(F.first("__first").alias("__first"), F.min(F.struct(gap.alias("gap"), F.col(right_on).alias("matched_on"), *right_cols)).alias("__hit"))
    return hit.select(*by, F.col("__first.__t0").alias(on), *[F.col(f"__first.{c}").alias(c) for c in left_cols], "__hit.*")
