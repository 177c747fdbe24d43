"""Levenberg-Marquardt over a table of constraints, and marginal covariances.

``optimise_groups`` solves independent problems (runs, sequences, components) each in a task of its
own, where its constraints lie; blocks are eliminated in time order: links join nodes close in time,
so the factor stays banded. ``segmented.optimise`` is for one problem too large for a task.

A scalar unknown, such as a range bias, is the x of a node whose other five degrees a tight prior
holds, so it takes part like any pose.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marram.operators import factor_math as fm
from marram.operators.lie import inverse_right_jacobian, quat_of, rotation_of, se3_exp

#: Columns of a node and of a constraint. a, b: its poses; c: the node of its bias; meas: position
#: and quaternion xyzw, or [range] or [height]; point: anchor; arm_a, arm_b: antenna arms; sigma: 6
#: or 1 values; huber: 0 for none.
NODE = "id long, x double, y double, z double, qx double, qy double, qz double, qw double"
FACTOR = "kind string, a long, b long, meas array<double>, point array<double>, arm_a array<double>, arm_b array<double>, sigma array<double>, huber double, c long"

#: Constraints of a group that are linearised at once.
LINEAR_ROWS = 8192

_H = [f"h{i}" for i in range(36)]
_G = [f"g{i}" for i in range(6)]
_POSE = ["x", "y", "z", "qx", "qy", "qz", "qw"]
_BLOCKS = "i long, j long, cost double, " + ", ".join(f"{c} double" for c in _H + _G)


def _poses(pdf: pd.DataFrame, side: str) -> tuple[np.ndarray, np.ndarray]:
    v = pdf[[f"{side}_{c}" for c in _POSE]].to_numpy(dtype=float)
    return rotation_of(v[:, 3:]), v[:, :3]


@dataclass
class Linear:
    """Constraints of one kind: row positions, whitened residuals n*k, costs n, and Jacobians n*k*6 by the nodes of each side."""

    at: np.ndarray
    residual: np.ndarray
    cost: np.ndarray
    by: dict[str, np.ndarray]


def linearise(pdf: pd.DataFrame) -> list[Linear]:
    """A batch of constraints with their nodes' columns (a_x, ..., c_qw), kind by kind, biased ones apart."""
    out = []
    biased = pdf["c"].notna() if "c" in pdf else pd.Series(False, index=pdf.index)
    for (kind, has_bias), rows in pdf.groupby(["kind", biased.rename("biased")], sort=False):
        at = rows.index.to_numpy()
        ra, pa = _poses(rows, "a")
        meas, sigma = (np.stack(rows[c].to_list()).astype(float) for c in ("meas", "sigma"))
        stack = lambda c, rows=rows: np.stack(rows[c].to_list()).astype(float) if rows[c].iloc[0] is not None else None
        by: dict[str, np.ndarray] = {}
        if kind in ("anchor_range", "ma_anchor_range"):
            e, ja = fm.anchor_range(ra, pa, stack("point"), meas[:, 0], arm=stack("arm_a"))
            e, by["a"] = e[:, None], ja[:, None]
        elif kind in ("inter_range", "ma_inter_range", "native_range"):
            rb, pb = _poses(rows, "b")
            e, ja, jb = fm.inter_range(ra, pa, rb, pb, meas[:, 0], arm_a=stack("arm_a"), arm_b=stack("arm_b"))
            e, by["a"], by["b"] = e[:, None], ja[:, None], jb[:, None]
        elif kind == "height":
            e, ja = fm.height(ra, pa, meas[:, 0])
            e, by["a"] = e[:, None], ja[:, None]
        elif kind == "odometry":
            rb, pb = _poses(rows, "b")
            rm, pm = rotation_of(meas[:, 3:]), meas[:, :3]
            e = fm.odometry(ra, pa, rb, pb, rm, pm)
            by["a"], by["b"] = fm.odometry_jacobians(e, ra, pa, rb, pb)
        elif kind in ("pose_prior", "bias_prior", "anchor_pin"):
            r0, p0 = rotation_of(meas[:, 3:]), meas[:, :3]
            e = fm.pose_prior(ra, pa, r0, p0)
            by["a"] = inverse_right_jacobian(e)
        elif kind == "gravity":
            e = fm.gravity(ra, meas)
            by["a"] = fm.gravity_jacobian(ra, meas)
        else:
            raise ValueError(f"no such kind of constraint: {kind}")
        if has_bias:
            rc, pc = _poses(rows, "c")
            e, by["c"] = e + pc[:, :1], fm.scalar_jacobian(rc)[:, None]
        sigma = np.broadcast_to(sigma, e.shape) if sigma.shape[1] == 1 else sigma
        k = rows["huber"].to_numpy(dtype=float)
        sigma = np.where(k[:, None] > 0, np.maximum(sigma, 1e-2), sigma)
        e, by = e / sigma, {s: j / sigma[..., None] for s, j in by.items()}
        size = np.linalg.norm(e, axis=1)
        over = (k > 0) & (size > k)
        cost = np.where(over, k * (size - 0.5 * k), 0.5 * size**2)
        root = np.sqrt(np.where(over, k / np.maximum(size, 1e-300), 1.0))[:, None]
        out.append(Linear(at, e * root, cost, {s: j * root[..., None] for s, j in by.items()}))
    return out


def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Normal-equation blocks of a batch of constraints, summed per (i, j) with i <= j: _BLOCKS columns."""
    pdf = pdf.reset_index(drop=True)
    parts = []

    def part(i, j, h, g, c):
        frame = pd.DataFrame(np.concatenate([h.reshape(len(h), 36), g], axis=1), columns=_H + _G)
        for name, v in (("cost", c), ("j", j), ("i", i)):
            frame.insert(0, name, v)
        parts.append(frame)

    t = lambda m: np.swapaxes(m, -1, -2)
    for found in linearise(pdf):
        none, zero = np.zeros((len(found.at), 6)), np.zeros(len(found.at))
        ids = {s: pdf[s].to_numpy()[found.at].astype(np.int64) for s in found.by}
        sides = list(found.by)
        for n, s in enumerate(sides):
            j = found.by[s]
            part(ids[s], ids[s], t(j) @ j, (t(j) @ found.residual[..., None])[..., 0], zero if n else found.cost)
            for other in sides[n + 1 :]:
                swap = ids[s] > ids[other]
                cross = t(j) @ found.by[other]
                part(np.minimum(ids[s], ids[other]), np.maximum(ids[s], ids[other]), np.where(swap[:, None, None], t(cross), cross), none, zero)
    frame = pd.concat(parts, ignore_index=True)
    return frame.groupby(["i", "j"], as_index=False).sum()[["i", "j", "cost", *_H, *_G]]


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            yield blocks(pdf)


def _as_system(pdf: pd.DataFrame) -> tuple[dict, dict, float]:
    """Blocks {(i, j): 6*6}, gradients {i: 6} and the cost from _BLOCKS rows."""
    h, g = {}, {}
    for i, j, hs, gs in zip(pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf[_H].to_numpy(), pdf[_G].to_numpy(), strict=True):
        h[(int(i), int(j))] = hs.reshape(6, 6)
        if i == j:
            g[int(i)] = gs
    return h, g, float(pdf["cost"].sum())


def with_nodes(factors: DataFrame, nodes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Constraints with the columns of their nodes, a_x to c_qw."""
    by = by or []
    side = lambda s: nodes.select(*by, F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in _POSE])
    return factors.join(side("a"), [*by, "a"]).join(side("b"), [*by, "b"], "left").join(side("c"), [*by, "c"], "left")


def normal_equations(factors: DataFrame, nodes: DataFrame) -> tuple[dict, dict, float]:
    """Blocks {(i, j): 6*6} with i <= j, gradients {i: 6} and the cost at ``nodes``."""
    summed = with_nodes(factors, nodes).mapInPandas(_blocks, _BLOCKS).groupBy("i", "j").agg(F.sum("cost").alias("cost"), *[F.sum(c).alias(c) for c in _H + _G])
    return _as_system(summed.toPandas())


def residuals(factors: DataFrame, nodes: DataFrame, keep: list[str]) -> DataFrame:
    """keep, residual array<double> (divided by sigma, and weighted where robust) and cost of every constraint at ``nodes``."""
    rows = with_nodes(factors, nodes)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            for found in linearise(pdf) if len(pdf) else []:
                yield pdf.loc[found.at, keep].assign(residual=[r.tolist() for r in found.residual], cost=found.cost)

    return rows.mapInPandas(run, f"{fields}, residual array<double>, cost double")


class PlacedCholesky:
    """L L' of a symmetric block matrix of n*n blocks, given by those (i <= j) that are not zero, eliminated in their order."""

    def __init__(self, n: int, pairs: np.ndarray, blocks: np.ndarray, damping: float = 0.0):
        self.columns: list[dict[int, np.ndarray]] = [{} for _ in range(n)]
        for i, j, m in zip(*pairs.T.tolist(), blocks, strict=True):
            self.columns[i][j] = m.T if i < j else m + np.diag(damping * np.maximum(np.diag(m), 1e-9))
        for k, column in enumerate(self.columns):
            low = np.linalg.cholesky(column[k])
            inverse = np.linalg.inv(low)
            column[k] = low
            below = sorted(j for j in column if j > k)
            for j in below:
                column[j] = column[j] @ inverse.T
            for at, j in enumerate(below):
                for m in below[at:]:
                    target = self.columns[j]
                    target[m] = target.get(m, np.zeros((6, 6))) - column[m] @ column[j].T

    def solve(self, rhs: np.ndarray) -> np.ndarray:
        """n*6 from n*6."""
        y = rhs.copy()
        for n, column in enumerate(self.columns):
            y[n] = np.linalg.solve(column[n], y[n])
            for k, m in column.items():
                if k > n:
                    y[k] -= m @ y[n]
        for n in range(len(y) - 1, -1, -1):
            for k, m in self.columns[n].items():
                if k > n:
                    y[n] -= m.T @ y[k]
            y[n] = np.linalg.solve(self.columns[n][n].T, y[n])
        return y

    def marginals(self) -> np.ndarray:
        """Diagonal blocks n*6*6 of the inverse, by the recursion that needs the inverse only where the factor has blocks.

        Columns of the inverse take the place of the factor's, which is gone afterwards.
        """
        inverse = self.columns
        get = lambda a, b: inverse[b][a] if a >= b else inverse[a][b].T
        out = np.empty((len(inverse), 6, 6))
        for n in range(len(inverse) - 1, -1, -1):
            column = inverse[n]
            own = np.linalg.inv(column[n])
            scaled = {k: column[k] @ own for k in column if k > n}
            found = {k: -sum(get(k, m) @ scaled[m] for m in scaled) for k in scaled}
            out[n] = found[n] = own.T @ own - sum((scaled[k].T @ found[k] for k in scaled), np.zeros((6, 6)))
            inverse[n] = found
        return out


class BlockCholesky:
    """The same of blocks {(i, j): 6*6, i <= j or the other way round, not both}, over keys that are eliminated in the order given."""

    def __init__(self, blocks: dict, order: list[int], damping: float = 0.0):
        self.order, place = order, {k: n for n, k in enumerate(order)}
        at = [(place[i], place[j]) for i, j in blocks]
        pairs = np.sort(np.array(at, dtype=np.int64).reshape(-1, 2), axis=1)
        placed = [m if a <= b else m.T for (a, b), m in zip(at, blocks.values(), strict=True)]
        self.factor = PlacedCholesky(len(order), pairs, np.array(placed).reshape(-1, 6, 6), damping)

    def solve(self, rhs: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        return dict(zip(self.order, self.factor.solve(np.stack([rhs.get(k, np.zeros(6)) for k in self.order])), strict=True))

    def marginals(self) -> dict[int, np.ndarray]:
        return dict(zip(self.order, self.factor.marginals(), strict=True))


def moved(poses: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Poses n*7 (x, y, z, quaternion) after right tangents n*6."""
    r, (dr, dt) = rotation_of(poses[:, 3:]), se3_exp(steps)
    return np.concatenate([poses[:, :3] + (r @ dt[..., None])[..., 0], quat_of(r @ dr)], axis=1)


@dataclass
class Descent:
    state: np.ndarray
    cost: float
    first_cost: float
    rounds: int
    blocks: np.ndarray


def descend(system, state: np.ndarray, pairs: np.ndarray, most: int, tolerance: float) -> Descent:
    """Levenberg-Marquardt; system(state) gives blocks (of ``pairs``), gradients and cost."""
    h, g, cost = system(state)
    first, damping, rounds = cost, 1e-4, 0
    while rounds < most:
        rounds += 1
        step = PlacedCholesky(len(state), pairs, h, damping).solve(-g)
        there = moved(state, step)
        h2, g2, cost2 = system(there)
        if cost2 <= cost:
            gain = cost - cost2
            state, h, g, cost, damping = there, h2, g2, cost2, max(damping / 10, 1e-12)
            if gain <= tolerance * max(cost, 1e-12) or np.abs(step).max() < 1e-9:
                break
        else:
            damping *= 10
            if damping > 1e8:
                break
        del h2, g2
    return Descent(state, cost, first, rounds, h)


class Constraints:
    """A group's constraints (FACTOR columns) as they came, over places of nodes; they are linearised LINEAR_ROWS at a time."""

    def __init__(self, rows: pa.Table, ids: np.ndarray):
        self.rows, self.n = rows.select([c for c in rows.column_names if c not in ("a", "b", "c")]), len(ids)
        self.at: dict[str, np.ndarray] = {}
        for s in "abc":
            known = rows[s].is_valid().to_numpy()
            of = rows[s].fill_null(0).to_numpy()
            place = np.minimum(np.searchsorted(ids, of), self.n - 1)
            if not (ids[place] == of)[known].all():
                raise ValueError(f"constraints of a group whose node {s} is not in it")
            self.at[s] = np.where(known, place, -1)
        codes = [np.arange(self.n) * (self.n + 1)]
        for s, t in (("a", "b"), ("a", "c"), ("b", "c")):
            both = (self.at[s] >= 0) & (self.at[t] >= 0)
            x, y = self.at[s][both], self.at[t][both]
            codes.append(np.unique(np.minimum(x, y) * self.n + np.maximum(x, y)))
        self.codes = np.unique(np.concatenate(codes))
        self.pairs = np.stack([self.codes // self.n, self.codes % self.n], axis=1)

    def system(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Blocks of ``pairs``, gradients n*6 and the cost at poses n*7."""
        h, g, cost = np.zeros((len(self.codes), 36)), np.zeros((self.n, 6)), 0.0
        for first in range(0, len(self.rows), LINEAR_ROWS):
            chunk = self.rows.slice(first, LINEAR_ROWS).to_pandas()
            for s in "abc":
                place = self.at[s][first : first + LINEAR_ROWS]
                chunk[s] = np.where(place >= 0, place, np.nan)
                chunk[[f"{s}_{c}" for c in _POSE]] = state[place]
            found = blocks(chunk)
            i, j = found["i"].to_numpy(), found["j"].to_numpy()
            h[np.searchsorted(self.codes, i * self.n + j)] += found[_H].to_numpy()
            own = i == j
            g[i[own]] += found.loc[own, _G].to_numpy()
            cost += float(found["cost"].sum())
        return h.reshape(-1, 6, 6), g, cost


def optimise_groups(factors: DataFrame, nodes: DataFrame, by: list[str], most: int = 100, tolerance: float = 1e-9, with_marginals: bool = False) -> DataFrame:
    """by, NODE columns, cost, first_cost, rounds, covariance array<double> (36, of [rotation, translation]; null without marginals).

    Each group of factors and nodes is a problem of its own and is solved in one task, so many are
    solved at once and nothing comes to the driver; a group must fit in a task, which holds its rows
    as they came, the blocks of its normal equations and their factor.
    """
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    rows = factors.select(*by, "kind", *[F.col(s).cast("long").alias(s) for s in "abc"], "meas", "point", "arm_a", "arm_b", "sigma", "huber")

    def run(own_nodes: pa.Table, own: pa.Table) -> pa.Table:
        own_nodes = own_nodes.sort_by("id")
        ids = own_nodes["id"].to_numpy()
        state = np.stack([own_nodes[c].to_numpy() for c in _POSE], axis=1).astype(float)
        cost, first, rounds, marginals = 0.0, 0.0, 0, None
        if len(own) and len(ids):
            constraints = Constraints(own.drop_columns(by), ids)
            found = descend(constraints.system, state, constraints.pairs, most, tolerance)
            state, cost, first, rounds = found.state, found.cost, found.first_cost, found.rounds
            if with_marginals:
                marginals = PlacedCholesky(len(ids), constraints.pairs, found.blocks).marginals()
        n = len(ids)
        if marginals is None:
            covariance = pa.nulls(n, pa.list_(pa.float64()))
        else:
            covariance = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 36), pa.array(marginals.reshape(-1)))
        figures = [pa.array(np.full(n, v, dtype=t)) for v, t in ((cost, float), (first, float), (rounds, np.int32))]
        columns = [*[own_nodes[c] for c in (*by, "id")], *[pa.array(np.ascontiguousarray(v)) for v in state.T], *figures, covariance]
        return pa.table(columns, names=[*by, "id", *_POSE, "cost", "first_cost", "rounds", "covariance"])

    fields = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    grouped = nodes.select(*by, F.col("id").cast("long").alias("id"), *_POSE).groupBy(*by)
    return grouped.cogroup(rows.groupBy(*by)).applyInArrow(run, f"{fields}, {NODE}, cost double, first_cost double, rounds int, covariance array<double>")


def _starts(anchors: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Starting points 4*n*3 of n problems with k anchors each (n*k*3): their mean, where differences of squared ranges vanish, and
    that point moved to either side of the plane that fits the anchors best, by what the ranges leave over."""
    mean = anchors.mean(axis=1)
    d = anchors - mean[:, None]
    square = (d**2).sum(axis=2) - z**2
    linear = np.einsum("nik,nk->ni", np.linalg.pinv(2 * d, rcond=1e-9), square - square.mean(axis=1, keepdims=True))
    normal = np.linalg.eigh(np.swapaxes(d, 1, 2) @ d)[1][:, :, 0]
    flat = linear - (linear * normal).sum(axis=1, keepdims=True) * normal
    over = (z**2 - ((flat[:, None] - d) ** 2).sum(axis=2)).mean(axis=1)
    side = np.sqrt(np.maximum(over, 0))[:, None] * normal
    return np.stack([mean, mean + linear, mean + flat + side, mean + flat - side])


def _located(anchors: np.ndarray, z: np.ndarray, sigma: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions n*3, costs n and traces n of n problems with k ranges each: a damped descent from every start, of which the lowest end counts.

    From one start alone the descent may stay in a local minimum, even where the ranges are exact.
    """
    starts = _starts(anchors, z)
    tries, n = len(starts), len(z)
    p = starts.reshape(-1, 3)
    anchors, z, sigma = (np.tile(v, (tries,) + (1,) * (v.ndim - 1)) for v in (anchors, z, sigma))

    def at(q, rows):
        d = q[:, None] - anchors[rows]
        size = np.sqrt((d**2).sum(axis=2))
        e, j = (size - z[rows]) / sigma[rows], d / np.maximum(size, fm.LEAST_LENGTH)[..., None] / sigma[rows][..., None]
        return (e**2).sum(axis=1), (np.swapaxes(j, 1, 2) @ e[..., None])[..., 0], np.swapaxes(j, 1, 2) @ j

    live = np.arange(len(p))
    cost, g, h = at(p, live)
    damping = np.full(len(p), 1e-3)
    for _ in range(most):
        own = h[live]
        diagonal = damping[live, None] * np.maximum(np.diagonal(own, axis1=1, axis2=2), 1e-9)
        step = np.linalg.solve(own + diagonal[..., None] * np.eye(3), -g[live][..., None])[..., 0]
        cost2, g2, h2 = at(p[live] + step, live)
        better = cost2 <= cost[live]
        up = live[better]
        p[up] += step[better]
        cost[up], g[up], h[up] = cost2[better], g2[better], h2[better]
        damping[live] = np.where(better, np.maximum(damping[live] / 10, 1e-12), damping[live] * 10)
        live = live[~(better & (np.abs(step).max(axis=1) < 1e-10))]
        if not len(live):
            break
    costs = cost.reshape(tries, n)
    # Of ends that are as low but for rounding the first counts.
    first = (costs <= costs.min(axis=0) * (1 + 1e-9) + 1e-15).argmax(axis=0)
    best = first * n + np.arange(n)
    return p[best], 0.5 * cost[best], np.trace(np.linalg.pinv(h[best]), axis1=1, axis2=2)


def multilaterate(ranges: DataFrame, by: list[str], most: int = 50) -> DataFrame:
    """by, x, y, z, cost, trace: each group's position from ranges (ax, ay, az, z, sigma) to fixed points, with the trace of its covariance.

    Groups are independent three-parameter problems, solved many at once where they lie.
    """
    names = ["ax", "ay", "az", "z", "sigma"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = np.zeros((len(pdf), 5))
            sizes = pdf["__n"].to_numpy()
            for k in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == k)
                for part in np.array_split(rows, -(-len(rows) * k // 50_000)):
                    v = np.stack([np.stack(pdf[f"__{c}"].iloc[part].to_list()).astype(float) for c in names], axis=2)
                    found[part] = np.column_stack(_located(v[..., :3], v[..., 3], v[..., 4], most))
            yield pd.concat([pdf[by], pd.DataFrame(found, columns=["x", "y", "z", "cost", "trace"], index=pdf.index)], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in ranges.schema.fields}
    # Sorted, so that sums do not depend on the order of arrival.
    all_of = F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in names])))
    groups = ranges.groupBy(*by).agg(all_of.alias("__all")).select(*by, F.size("__all").alias("__n"), *[F.col(f"__all.{c}").alias(f"__{c}") for c in names])
    return groups.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", x double, y double, z double, cost double, trace double")
