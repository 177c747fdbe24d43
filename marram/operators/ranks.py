"""Global positions and exact quantiles, without a task that sees all rows."""

from __future__ import annotations

from functools import reduce
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.session import materialised

#: Values that one task may rank.
SMALL = 1_000_000
#: Relative rank error of a bracket is one over this.
ACCURACY = 10_000


def ranked(rows: DataFrame, order: list[str | Column], name: str = "pos") -> DataFrame:
    """``rows`` with their 0-based position in an explicit order; ties need a total order to be told apart.

    Rows are dealt to ranges of the order and ranked within them; the ranges' counts, one row a
    partition, give the offsets. The ranges are written down first, so a lost executor cannot move
    a row from one to another between the two passes.
    """
    parts = materialised(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = {r["__part"]: r["n"] for r in parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    before = rows.sparkSession.createDataFrame(offsets, "__part int, __before long")
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.join(F.broadcast(before), "__part").withColumn(name, rank + F.col("__before")).drop("__part", "__before")


def quantiles(rows: DataFrame, value: Column, shares: list[float], small: int = SMALL) -> list[float | None]:
    """Exact quantiles, linear between neighbours; None of an empty table. Null values do not count.

    Up to ``small`` values one aggregate ranks them. Beyond, each rank is bracketed by approximate
    quantiles and the bracket is narrowed pass by pass until it is small; every pass reads all
    values and keeps none.
    """
    values = rows.select(value.cast("double").alias("v")).where("v IS NOT NULL")
    n = values.count()
    if not n:
        return [None] * len(shares)
    if n <= small:
        return list(values.agg(F.percentile("v", F.array(*map(F.lit, shares)))).first()[0])
    out = []
    for share in shares:
        at = share * (n - 1)
        low = _kth(values, floor(at), n, small)
        out.append(low if at == floor(at) else low + (at - floor(at)) * (_kth(values, floor(at) + 1, n, small) - low))
    return out


def grouped_quantiles(rows: DataFrame, by: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """by, and for each name the group's exact quantile, linear between neighbours; null if all its values are.

    All groups at once: the values are ranked in ranges of (group, value), a group's first rank and
    length tell which ranks it needs, and these are looked up. No task holds a group.
    """
    values = rows.select(*by, value.cast("double").alias("__v"))
    known = ranked(values.where("__v IS NOT NULL"), [*by, "__v"], "__rank")
    spans = values.groupBy(*by).agg(F.count("__v").alias("__n")).withColumnsRenamed({c: f"{c}__of" for c in by})
    starts = known.groupBy(*by).agg(F.min("__rank").alias("__start"))
    match = lambda suffix: reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(c + suffix)) for c in by], F.lit(True))
    spans = spans.join(starts, match("__of"), "left").select(*[F.col(f"{c}__of").alias(c) for c in by], "__n", "__start")
    at = {name: share * (F.col("__n") - 1) for name, share in shares.items()}
    needed = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(a), F.ceil(a)) for a in at.values()])))
    asked = spans.withColumn("__at", F.explode(needed)).withColumn("__rank", F.col("__start") + F.col("__at"))
    met = asked.join(known.select("__rank", "__v"), "__rank", "left")
    pick = lambda place: F.max(F.when(F.col("__at") == place, F.col("__v")))
    out = []
    for name, a in at.items():
        low, high = pick(F.floor(a)), pick(F.ceil(a))
        part = F.max(a - F.floor(a))
        out.append((low + part * (high - low)).alias(name))
    return met.groupBy(*by).agg(*out)


def _kth(values: DataFrame, k: int, n: int, small: int) -> float:
    below = 0
    while n > small:
        share = (k - below) / n
        low, high = values.agg(F.percentile_approx("v", F.array(F.lit(max(0.0, share - 2 / ACCURACY)), F.lit(min(1.0, share + 2 / ACCURACY))), F.lit(ACCURACY))).first()[0]
        if low == high:
            under, upto = values.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v") <= low)).first()
            if below + under <= k < below + upto:
                return low
            break
        under, inside = values.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
        if not below + under <= k < below + under + inside or inside == n:
            break  # the approximation missed, or nothing is gained: rank what is left
        values, below, n = values.where(F.col("v").between(low, high)), below + under, inside
    return values.orderBy("v").offset(k - below).limit(1).first()[0]
