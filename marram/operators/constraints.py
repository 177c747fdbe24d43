"""Constraints ("factors") as rows: selection, residual columns, statistics and the gauge."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.functions.geometry import Vector, length, minus, plus, rotate
from marram.session import materialised


@dataclass
class Config:
    """Switches and sigmas of a problem; the defaults are those of a plain run."""

    use_ranges: bool = True
    use_anchor: bool = True
    use_inter: bool = True
    use_height: bool = False
    use_gravity: bool = True
    use_moment_arm: bool = False
    bias_mode: str = "const"
    range_bias: float = 0.14
    range_sigma_floor: float = 0.3
    range_tolerance: float = 0.07
    max_odometry_gap: float = 1.0
    prior_every: int = 0
    anchor_robots: tuple[int, ...] | None = None
    inter_pairs: tuple[tuple[int, int], ...] | None = None
    robots: tuple[int, ...] = (0, 1, 2)
    gauge_per_robot: bool = False
    huber: float = 1.0
    #: "track": a node's start is its robot's whole track fitted to the truth, by yaw or, with yaw_only off, by a rotation; "first_pose": by the first pose alone, and every ungrounded robot has a gauge of its own.
    start: str = "track"
    yaw_only: bool = True
    #: Every how many range rows and height rows count.
    range_every: int = 1
    height_every: int = 1
    sigma_override: float | None = None
    motion_sigma: bool = True
    use_true_range: bool = False
    true_range_sigma: float = 0.05
    #: Synthetic measurements in place of the ranges: sigma, bias, outlier and seed of ``cleaning.injected_range``.
    injected: dict | None = None
    bias_sigma: float = 1.0
    #: Anchors as variables that a tight prior holds, instead of constants.
    pin_anchors: bool = False
    extra: dict = field(default_factory=dict)


def range_factor_kind(config: Config, kind: Column) -> Column:
    """Which factor a range row makes."""
    if config.use_moment_arm:
        return F.when(kind == "anchor", "ma_anchor_range").otherwise("ma_inter_range")
    if config.bias_mode == "online":
        return F.when(kind == "anchor", "anchor_range").otherwise("inter_range")
    return F.lit("native_range")


def adjacent(nodes: DataFrame, by: list[str], order: str, carry: list[str], most: float) -> DataFrame:
    """Consecutive nodes of an entity no further apart than ``most`` (inclusive): carried columns as a_* and b_*."""
    w = Window.partitionBy(*by).orderBy(order)
    ahead = F.lead(F.struct(F.col(order), *[F.col(c) for c in carry if c != order])).over(w)
    rows = nodes.withColumn("__b", ahead).where(F.col("__b").isNotNull() & (F.col(f"__b.{order}") - F.col(order) <= most))
    names = list(dict.fromkeys([order, *carry]))
    return rows.select(*by, *[F.col(c).alias(f"a_{c}") for c in names], *[F.col(f"__b.{c}").alias(f"b_{c}") for c in names])


def allowed_pairs(df: DataFrame, a: str, b: str, pairs: DataFrame | None) -> DataFrame:
    """Rows whose unordered pair is in ``pairs`` (p, q); None lets all pass."""
    if pairs is None:
        return df
    low = pairs.select(F.least("p", "q").alias("__p"), F.greatest("p", "q").alias("__q")).distinct()
    return df.join(low, (F.least(a, b) == F.col("__p")) & (F.greatest(a, b) == F.col("__q")), "left_semi")


def range_residual(a: Vector, b: Vector, z: Column, bias: Column | float = 0.0) -> Column:
    return length(minus(a, b)) - z + bias


def arm_range_residual(pa: Vector, qa, arm_a: Vector, pb: Vector, z: Column, bias: Column | float = 0.0, qb=None, arm_b: Vector | None = None) -> Column:
    """Range between antennas: positions plus rotated arms; without qb the other end is a fixed point."""
    end_b = pb if qb is None else plus(pb, rotate(qb, arm_b))
    return range_residual(plus(pa, rotate(qa, arm_a)), end_b, z, bias)


def range_direction(a: Vector, b: Vector) -> Vector:
    """Unit vector from b to a; the length is held to 1e-6 at least."""
    d = minus(a, b)
    n = F.greatest(length(d), F.lit(1e-6))
    return tuple(x / n for x in d)


def huber_weight(residual: Column, sigma: Column, k: float) -> Column:
    """Weight of the iteratively reweighted problem; sigma is held to 0.01 at least."""
    e = F.abs(residual / F.greatest(sigma, F.lit(1e-2)))
    return F.when(e <= k, F.lit(1.0)).otherwise(k / e)


def huber_cost(residual: Column, sigma: Column, k: float) -> Column:
    e = F.abs(residual / F.greatest(sigma, F.lit(1e-2)))
    return F.when(e <= k, 0.5 * e * e).otherwise(k * (e - 0.5 * k))


def stats(factors: DataFrame, by: list[str]) -> DataFrame:
    return factors.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def untouched(nodes: DataFrame, factors: list[tuple[DataFrame, list[list[str]]]], key: list[str]) -> DataFrame:
    """Nodes that no factor names: they get a weak prior. Each factor table comes with the column lists that name its nodes."""
    seen = None
    for df, columns in factors:
        for names in columns:
            part = df.select(*[F.col(n).alias(k) for n, k in zip(names, key, strict=True)])
            seen = part if seen is None else seen.unionByName(part)
    return nodes.join(seen.distinct(), key, "left_anti")


def linked_entities(entities: DataFrame, config: Config) -> DataFrame:
    """Edges (a, b) between entities (id) that the configuration lets range each other, whatever ranges survived.

    Where all may, each is tied to the next by id, which connects the same.
    """
    if not (config.use_inter and config.use_ranges):
        return entities.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false")
    if config.inter_pairs is None:
        ahead = F.lead("id").over(Window.partitionBy(F.lit(0)).orderBy("id"))  # one row an entity
        return entities.select(F.col("id").alias("a"), ahead.alias("b")).where("b IS NOT NULL")
    pairs = entities.sparkSession.createDataFrame([tuple(p) for p in config.inter_pairs], "a int, b int")
    for side in "ab":
        pairs = pairs.join(entities.select(F.col("id").alias(side)), side, "left_semi")
    return pairs


def gauge_entities(entities: DataFrame, config: Config) -> DataFrame:
    """id of the entities that carry a gauge constraint, of ``entities`` (id): the first of each component that nothing grounds.

    Anchors ground the entities that may range them. Where each track starts from its own first
    pose, every entity is a component.
    """
    anchored = config.use_ranges and config.use_anchor
    if not anchored:
        grounded = entities.where("false")
    else:
        grounded = entities if config.anchor_robots is None else entities.where(F.col("id").isin(list(config.anchor_robots)))
    alone = entities.select("id", F.col("id").alias("component"))
    groups = alone if config.start == "first_pose" else connected(linked_entities(entities, config), entities)
    fixed = groups.join(grounded, "id", "left_semi").select("component").distinct()
    return groups.join(fixed, "component", "left_anti").groupBy("component").agg(F.min("id").alias("id")).select("id")


def connected(edges: DataFrame, vertices: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component) by passing the smallest label along edges (a, b) until nothing changes; isolated vertices are their own."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = vertices.select("id", F.col("id").alias("component"))
    for _ in range(rounds):
        heard = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("heard"))
        moved = labels.join(heard, F.col("id") == F.col("a"), "left").select("id", F.least("component", "heard").alias("component"))
        # A label may jump to its label's label, which halves the rounds that long chains take.
        up = moved.select(F.col("id").alias("up_id"), F.col("component").alias("up"))
        moved = moved.join(up, F.col("component") == F.col("up_id")).select("id", F.least("component", "up").alias("component"))
        moved = materialised(moved)
        changed = moved.join(labels.withColumnRenamed("component", "was"), "id").where("component <> was").limit(1).count()
        labels = moved
        if not changed:
            return labels
    raise RuntimeError(f"labels still move after {rounds} rounds")
