"""Levenberg-Marquardt for one problem of any length, by nested elimination of time segments.

Nodes lie in segments of time. A constraint that crosses from one segment into another makes its
later node a separator; all other nodes of a segment are linked within it and with separators
alone, so each segment eliminates them where its constraints lie and hands on the Schur complement
over the separators it touches. ``fan`` neighbouring segments then form one, in which separators
between them are inner nodes in their turn, and so on until one is left, which also holds the nodes
that belong to no time, such as biases. Back-substitution runs the same levels downwards, and so do
marginal covariances, by the recursion that needs the inverse only where the factor has blocks.

A task holds one front: a segment's constraints, or the complements of ``fan`` segments. The driver
holds a cost and a step length; what a level writes lies in the shared folder until the next round.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marram.operators.lie import quat_of, rotation_of, se3_exp
from marram.operators.ranks import ranked
from marram.operators.solve import _G, _H, _POSE, NODE, _blocks, with_nodes
from marram.session import Workspace

#: Segments that are joined into one of the next level; nodes of a segment when none are given.
FAN, SEGMENT_NODES = 16, 2000

#: A node's code is its level, segment (27 bits) and place (22 bits), 53 bits in all, which doubles hold; codes rise in the order of elimination.
_LEVEL_AT, _SEGMENT_AT, _TIMELESS = 49, 22, (1 << 27) - 1

_D = [f"d{k}" for k in range(6)]
_S = [f"s{k}" for k in range(6)]
_BLOCK = "i long, j long, cost double, " + ", ".join(f"{c} double" for c in _H + _G)
_FRONT = "front long, kind string, level int, i long, j long, " + ", ".join(f"{c} double" for c in _H + _G + _D)
_STEP = "code long, " + ", ".join(f"{c} double" for c in _S)
_INVERSE = "i long, j long, " + ", ".join(f"{c} double" for c in _H)


@dataclass
class Solution:
    """nodes: NODE columns, and covariance array<double> (36, of [rotation, translation]) where asked for."""

    nodes: DataFrame
    cost: float
    first_cost: float
    rounds: int


def _level(code: Column) -> Column:
    return F.shiftright(code, _LEVEL_AT).cast("int")


def _front(code: Column, level: int, fan: int) -> Column:
    """Where nodes of a level are eliminated; nodes of no time are in the last front, number 0."""
    segment = F.shiftright(code, _SEGMENT_AT).bitwiseAND(F.lit(_TIMELESS))
    return F.when(segment == _TIMELESS, 0).otherwise(F.floor(segment / float(fan**level))).cast("long")


def coded(factors: DataFrame, nodes: DataFrame, fan: int) -> tuple[DataFrame, DataFrame, int]:
    """Nodes (id, segment, place, pose) with their code, constraints over codes, and the last level."""
    low, high = nodes.agg(F.min("segment"), F.max("segment")).first()
    levels = 0
    while fan**levels <= (high or 0) - (low or 0):
        levels += 1
    nodes = nodes.withColumn("segment", F.col("segment") - F.lit(low))
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    links = factors.select(F.explode(F.array(pair("a", "b"), pair("a", "c"), pair("b", "c"))).alias("p")).select("p.*").where("u IS NOT NULL AND v IS NOT NULL").distinct()
    at = lambda s: nodes.where("segment IS NOT NULL").select(F.col("id").alias(s), F.col("segment").alias(f"s{s}"))
    met = links.join(at("u"), "u").join(at("v"), "v").where("su <> sv")
    apart = sum((F.floor(F.col("su") / float(fan**k)) != F.floor(F.col("sv") / float(fan**k))).cast("int") for k in range(levels)) if levels else F.lit(0)
    later = met.select(F.when(F.col("su") > F.col("sv"), F.col("u")).otherwise(F.col("v")).alias("id"), apart.alias("level")).groupBy("id").agg(F.max("level").alias("level"))
    placed = nodes.join(later, "id", "left")
    level = F.when(F.col("segment").isNull(), levels).otherwise(F.coalesce("level", F.lit(0)))
    placed = placed.withColumns({"level": level, "segment": F.coalesce("segment", F.lit(_TIMELESS))})
    index = F.row_number().over(Window.partitionBy("level", "segment").orderBy("place", "id")) - 1
    code = F.shiftleft(F.col("level").cast("long"), _LEVEL_AT) + F.shiftleft(F.col("segment").cast("long"), _SEGMENT_AT) + index
    placed = placed.select(code.alias("code"), "id", *_POSE)
    for s in "abc":
        factors = factors.join(placed.select(F.col("id").alias(s), F.col("code").alias(f"__{s}")), s, "left")
    return placed, factors.drop(*"abc").withColumnsRenamed({f"__{s}": s for s in "abc"}), levels


def _matrix(t: pa.Table, columns: list[str]) -> np.ndarray:
    """Columns of a table, nulls as not a number. Fronts are many and small and their columns too many for a frame each."""
    return np.stack([t[c].to_numpy() for c in columns], axis=1)


def _table(head: list[pa.Array], names: list[str], values: np.ndarray, columns: list[str]) -> pa.Table:
    return pa.table([*head, *[pa.array(v) for v in np.ascontiguousarray(values.T)]], names=[*names, *columns])


class Front:
    """Blocks {(i, j): 6*6, i <= j}, gradients and undamped diagonals of a front, whose nodes of ``level`` are eliminated."""

    def __init__(self, t: pa.Table, level: int):
        i, j, v = t["i"].to_numpy(), t["j"].to_numpy(), _matrix(t, _H + _G + _D)
        order = np.lexsort((j, i))
        i, j, v = i[order], j[order], v[order]
        first = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        i, j, v = i[first], j[first], np.add.reduceat(v, first, axis=0)
        self.order = np.unique(np.concatenate([i, j]))
        self.inner = int((self.order >> _LEVEL_AT == level).sum())
        a, b = np.searchsorted(self.order, i), np.searchsorted(self.order, j)
        # Columns of the lower triangle, by place in the order.
        self.columns: list[dict[int, np.ndarray]] = [{} for _ in self.order]
        self.g, self.d = np.zeros((len(self.order), 6)), np.zeros((len(self.order), 6))
        for n, m, h in zip(a.tolist(), b.tolist(), v[:, :36].reshape(-1, 6, 6), strict=True):
            self.columns[n][m] = h.T.copy()
        own = i == j
        self.g[a[own]], self.d[a[own]] = v[own, 36:42], v[own, 42:]

    def eliminate(self, damping: float) -> None:
        for n in range(self.inner):
            column = self.columns[n]
            low = np.linalg.cholesky(column[n] + np.diag(damping * np.maximum(self.d[n], 1e-9)))
            inverse = np.linalg.inv(low)
            self.g[n] = inverse @ self.g[n]
            column[n] = low
            below = sorted(k for k in column if k > n)
            for k in below:
                column[k] = column[k] @ inverse.T
                self.g[k] -= column[k] @ self.g[n]
            for at, k in enumerate(below):
                for m in below[at:]:
                    target = self.columns[k]
                    step = column[m] @ column[k].T
                    target[m] = target[m] - step if m in target else -step

    def rows(self, front: int, level: int) -> pa.Table:
        """Factor rows of the inner nodes (block L_ji, gradient reduced), update rows of the others."""
        i, j, h = [], [], []
        for n, column in enumerate(self.columns):
            for k, block in column.items():
                i.append(n)
                j.append(k)
                h.append(block if n < self.inner else block.T)
        i, j = np.array(i), np.array(j)
        own = (i == j)[:, None]
        out = np.concatenate([np.stack(h).reshape(-1, 36), np.where(own, self.g[i], 0.0), np.where(own, self.d[i], 0.0)], axis=1)
        inner = i < self.inner
        levels = np.where(inner, level, self.order[i] >> _LEVEL_AT).astype(np.int32)
        head = [pa.array(np.full(len(i), front)), pa.array(np.where(inner, "factor", "update").tolist()), pa.array(levels), pa.array(self.order[i]), pa.array(self.order[j])]
        return _table(head, ["front", "kind", "level", "i", "j"], out, _H + _G + _D)


def _with_diagonals(blocks: DataFrame) -> DataFrame:
    own = F.col("i") == F.col("j")
    return blocks.select("i", "j", _level(F.col("i")).alias("level"), "cost", *_H, *_G, *[F.when(own, F.col(_H[7 * k])).otherwise(0.0).alias(d) for k, d in enumerate(_D)])


def _elimination(level: int, damping: float):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        front = Front(t, level)
        front.eliminate(damping)
        return front.rows(key[0].as_py(), level)

    return run


def _eliminated(linear: DataFrame, levels: int, fan: int, damping: float, work: Workspace) -> list[DataFrame]:
    """For each level its factor rows and the update rows that it hands on, stored."""
    done: list[DataFrame] = []
    columns = ["i", "j", *_H, *_G, *_D]
    for level in range(levels + 1):
        rows = linear.where(F.col("level") == level).select(*columns)
        for earlier in done:
            rows = rows.unionByName(earlier.where((F.col("kind") == "update") & (F.col("level") == level)).select(*columns))
        done.append(work.keep(rows.withColumn("front", _front(F.col("i"), level, fan)).groupBy("front").applyInArrow(_elimination(level, damping), _FRONT)))
    return done


def _columns(t: pa.Table) -> tuple[np.ndarray, dict[int, dict[int, np.ndarray]], dict[int, np.ndarray]]:
    """Inner codes in order, their factor columns {i: {j: block}} and reduced gradients."""
    columns: dict[int, dict[int, np.ndarray]] = {}
    i, j = t["i"].to_numpy(), t["j"].to_numpy()
    for n, k, h in zip(i.tolist(), j.tolist(), _matrix(t, _H).reshape(-1, 6, 6), strict=True):
        columns.setdefault(n, {})[k] = h
    own = i == j
    return np.sort(i[own]), columns, dict(zip(i[own].tolist(), _matrix(t, _G)[own], strict=True))


def _substitute(t: pa.Table) -> pa.Table:
    order, columns, g = _columns(t)
    steps = _matrix(t, _S)
    known = np.isfinite(steps[:, 0])
    x = dict(zip(t["j"].to_numpy()[known].tolist(), steps[known], strict=True))
    for n in order[::-1].tolist():
        rest = -g[n] - sum((block.T @ x[k] for k, block in columns[n].items() if k != n), np.zeros(6))
        x[n] = np.linalg.solve(columns[n][n].T, rest)
    return _table([pa.array(order)], ["code"], np.stack([x[n] for n in order.tolist()]), _S)


def _steps(done: list[DataFrame], work: Workspace) -> DataFrame:
    """code and step of every node, from the last level down."""
    steps = None
    for rows in reversed(done):
        own = rows.where("kind = 'factor'")
        if steps is None:
            met = own.select("*", *[F.lit(None).cast("double").alias(s) for s in _S])
        else:
            met = own.join(steps.withColumnRenamed("code", "j"), "j", "left")
        found = work.keep(met.groupBy("front").applyInArrow(_substitute, _STEP))
        steps = found if steps is None else steps.unionByName(found)
    return steps


def _selected(t: pa.Table) -> pa.Table:
    """Blocks of the inverse at the inner nodes' columns; rows of kind update bring those between the others."""
    factor = pc.equal(t["kind"], "factor")
    order, columns, _ = _columns(t.filter(factor))
    between = t.filter(pc.invert(factor))
    inverse: dict[tuple[int, int], np.ndarray] = {}
    for i, j, h in zip(between["i"].to_pylist(), between["j"].to_pylist(), _matrix(between, _H).reshape(-1, 6, 6), strict=True):
        inverse[i, j] = h
    get = lambda a, b: inverse[a, b] if a <= b else inverse[b, a].T
    out = []
    for n in order[::-1].tolist():
        own = np.linalg.inv(columns[n][n])
        scaled = {k: block @ own for k, block in columns[n].items() if k != n}
        for k in scaled:
            inverse[n, k] = -sum(get(k, m) @ scaled[m] for m in scaled).T
        inverse[n, n] = own.T @ own - sum((scaled[k].T @ inverse[n, k].T for k in scaled), np.zeros((6, 6)))
        out += [(n, k) for k in (n, *scaled)]
    blocks = np.stack([inverse[pair] for pair in out]).reshape(-1, 36)
    return _table([pa.array([n for n, _ in out], pa.int64()), pa.array([k for _, k in out], pa.int64())], ["i", "j"], blocks, _H)


def _inverse(done: list[DataFrame], work: Workspace) -> DataFrame:
    """i, j and the inverse's block, wherever the factor has one, from the last level down."""
    inverse = None
    for rows in reversed(done):
        own = rows.where("kind = 'factor'").select("front", "kind", "i", "j", *_H, *_G)
        if inverse is not None:
            between = rows.where("kind = 'update'").select("front", "kind", "i", "j", *_G)
            own = own.unionByName(between.join(inverse, ["i", "j"]))
        found = work.keep(own.groupBy("front").applyInArrow(_selected, _INVERSE))
        inverse = found if inverse is None else inverse.unionByName(found)
    return inverse


def _moved(state: DataFrame, steps: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            if len(pdf):
                pose, (dr, dt) = pdf[_POSE].to_numpy(), se3_exp(pdf[_S].to_numpy())
                r = rotation_of(pose[:, 3:])
                pdf[_POSE] = np.concatenate([pose[:, :3] + (r @ dt[..., None])[..., 0], quat_of(r @ dr)], axis=1)
            yield pdf[["id", *_POSE]]

    return state.join(steps.withColumnRenamed("code", "id"), "id").mapInPandas(run, NODE)


def optimise(factors: DataFrame, nodes: DataFrame, segment: Column | None = None, place: Column | None = None, fan: int = FAN, most: int = 100, tolerance: float = 1e-9, with_marginals: bool = False) -> Solution:
    """Minimise one problem's cost from ``nodes`` (NODE columns, and what the two expressions need).

    segment: a node's segment of time (rising, whole; null for nodes of no time, of which one task
    holds all), chosen so that a segment's constraints fit in a task; place: its order within, the
    id unless given. Without ``segment`` nodes are cut into segments of SEGMENT_NODES by place.
    Constraints between segments should be few beside those within. The result does not depend on
    the segments, but for rounding.
    """
    spark = factors.sparkSession
    work = Workspace(spark)
    place = F.col("id") if place is None else place
    if segment is None:
        nodes = ranked(nodes.withColumn("place", place), ["place", "id"], "segment").withColumn("segment", F.floor(F.col("segment") / SEGMENT_NODES))
    else:
        nodes = nodes.withColumns({"place": place, "segment": segment.cast("long")})
    placed, factors, levels = coded(factors, work.keep(nodes.select("id", "segment", "place", *_POSE)), fan)
    placed, factors = work.keep(placed), work.keep(factors)
    state = work.keep(placed.select(F.col("code").alias("id"), *_POSE))

    def system(at: DataFrame) -> tuple[DataFrame, float]:
        linear = work.keep(_with_diagonals(with_nodes(factors, at).mapInPandas(_blocks, _BLOCK)))
        return linear, linear.agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0]

    linear, cost = system(state)
    first, damping, rounds, last = cost, 1e-4, 0, False
    while rounds < most:
        rounds += 1
        steps = _steps(_eliminated(linear, levels, fan, damping, work), work)
        there = work.keep(_moved(state, steps))
        linear2, cost2 = system(there)
        longest = steps.agg(F.greatest(*[F.max(F.abs(s)) for s in _S])).first()[0]
        # A small gain leaves a step of about its root: one more follows, whose gain may be lost in rounding.
        if cost2 <= cost * (1 + 1e-12 * last):
            gain = cost - cost2
            state, linear, cost, damping = there, linear2, cost2, max(damping / 10, 1e-12)
            work.drop_all_but(placed, factors, state, linear)
            if last or longest < 1e-9:
                break
            last = gain <= tolerance * max(cost, 1e-12)
        else:
            work.drop_all_but(placed, factors, state, linear)
            damping *= 10
            if last or damping > 1e8:
                break
    found = placed.select("id", F.col("code")).join(state.withColumnRenamed("id", "code"), "code")
    if with_marginals:
        own = _inverse(_eliminated(linear, levels, fan, 0.0, work), work).where("i = j")
        found = found.join(own.select(F.col("i").alias("code"), F.array(*_H).alias("covariance")), "code", "left")
    found = work.keep(found.drop("code"))
    work.drop_all_but(found)
    return Solution(found, cost, first, rounds)
