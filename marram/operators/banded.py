"""Five-diagonal systems of smoothing splines, whole or cut into segments."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def five_diagonals(a: np.ndarray, b: np.ndarray, size: int = 64) -> np.ndarray:
    """Solve a symmetric positive definite five-diagonal system; a holds diagonals 0, 1, 2, and b one right side or a column each.

    Rows go in blocks of ``size``, of which only neighbours are linked, so the elimination is one
    dense step a block.
    """
    m = len(b)
    columns = b.reshape(m, -1)
    count = -(-m // size)
    whole = np.zeros((3, count * size))
    whole[:, :m] = a
    whole[0, m:] = 1.0
    whole[1, max(0, m - 1) :] = 0.0
    whole[2, max(0, m - 2) :] = 0.0
    parts = whole.reshape(3, count, size)
    diagonal, link = np.zeros((count, size, size)), np.zeros((count, size, size))
    for k in range(3):
        i = np.arange(size - k)
        diagonal[:, i, i + k] = diagonal[:, i + k, i] = parts[k, :, : size - k]
        for j in range(size - k, size):
            link[:, j, j + k - size] = parts[k, :, j]
    y = np.zeros((count, size, columns.shape[1]))
    y.reshape(-1, columns.shape[1])[:m] = columns
    for k in range(1, count):
        both = np.linalg.solve(diagonal[k - 1], np.concatenate([link[k - 1], y[k - 1]], axis=1))
        diagonal[k] -= link[k - 1].T @ both[:, :size]
        y[k] -= link[k - 1].T @ both[:, size:]
    for k in range(count - 1, -1, -1):
        y[k] = np.linalg.solve(diagonal[k], y[k] - (link[k] @ y[k + 1] if k + 1 < count else 0.0))
    return y.reshape(-1, columns.shape[1])[:m].reshape(b.shape)


def coefficients(t: np.ndarray, y: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of Reinsch's form, for the inner times of ``t``: diagonals 0, 1, 2 of R + lam Q'Q, right sides Q'y, and Q's three bands."""
    h = np.diff(t).astype(float)
    m = len(t) - 2
    q = np.stack([1 / h[:-1], -1 / h[:-1] - 1 / h[1:], 1 / h[1:]])
    a = np.zeros((3, m))
    a[0] = (h[:-1] + h[1:]) / 3 + lam * (q**2).sum(axis=0)
    a[1, :-1] = h[1:-1] / 6 + lam * (q[1, :-1] * q[0, 1:] + q[2, :-1] * q[1, 1:])
    if m > 2:
        a[2, :-2] = lam * q[2, :-2] * q[0, 2:]
    columns = y.reshape(len(t), -1)
    rhs = q[0][:, None] * columns[:-2] + q[1][:, None] * columns[1:-1] + q[2][:, None] * columns[2:]
    return a, rhs.reshape((m, *y.shape[1:])), q


@dataclass
class Band:
    """A segment's rows of the system: unknowns ``low`` to ``high`` (by row number), its own rows ``first`` to ``end`` of ``n``.

    Its left pair is the unknowns first - 1 and first, its right pair end - 1 and end; the first
    segment has no left and the last no right one.
    """

    first: int
    end: int
    n: int
    low: int
    high: int
    a: np.ndarray
    rhs: np.ndarray
    q: np.ndarray
    y: np.ndarray
    lam: float

    @property
    def has_left(self) -> bool:
        return self.first > 0

    @property
    def has_right(self) -> bool:
        return self.end < self.n

    @property
    def inner(self) -> slice:
        """Inner unknowns, counted from ``low``."""
        return slice(2 if self.has_left else 0, self.high - self.low + 1 - (2 if self.has_right else 0))

    def links(self) -> np.ndarray:
        """Coefficients between inner unknowns and the four of the pairs (zero where a pair is not there)."""
        inside = self.inner
        m = max(0, inside.stop - inside.start)
        out = np.zeros((m, 4))
        at = lambda i, j: self.a[abs(i - j), min(i, j)] if abs(i - j) < 3 else 0.0
        for k in range(min(m, 2)):
            i, j = inside.start + k, inside.stop - 1 - k
            if self.has_left:
                out[i - inside.start, :2] = at(i, 0), at(i, 1)
            if self.has_right:
                out[j - inside.start, 2:] = at(j, inside.stop), at(j, inside.stop + 1)
        return out

    def solved(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Levels and second derivatives of the segment's own rows, given those of the pairs (4 rows, a column a value)."""
        inside, columns = self.inner, self.y.shape[1]
        unknown = np.zeros((self.high - self.low + 1, columns))
        if inside.stop > inside.start:
            unknown[inside] = five_diagonals(self.a[:, inside], self.rhs[inside] - self.links() @ pairs)
        if self.has_left:
            unknown[:2] = pairs[:2]
        if self.has_right:
            unknown[-2:] = pairs[2:]
        # Rows first - 1 to end, with the unknowns that are there.
        curve, back = np.zeros((self.end - self.first + 2, columns)), np.zeros((self.end - self.first + 4, columns))
        at = self.low - (self.first - 1)
        curve[at : at + len(unknown)] = unknown
        for k in range(3):
            back[at + k : at + k + len(unknown)] += self.q[k][:, None] * unknown
        return self.y - self.lam * back[2:-2], curve[1:-1]


def natural_band(at: np.ndarray, t: np.ndarray, y: np.ndarray, first: int, end: int, n: int, lam: float) -> Band:
    """The band of rows ``first`` to ``end`` of ``n``; the arrays hold these and two beyond each end, where there are any."""
    low, high = max(1, first - 1), min(n - 2, end)
    own = slice(first - int(at[0]), end - int(at[0]))
    if high < low:
        none = np.zeros((3, 0))
        return Band(first, end, n, low, low - 1, none, np.zeros((0, y.shape[1])), none, y[own], lam)
    used = slice(low - 1 - int(at[0]), high + 2 - int(at[0]))
    a, rhs, q = coefficients(t[used], y[used], lam)
    return Band(first, end, n, low, high, a, rhs, q, y[own], lam)


def border_system(band: Band) -> tuple[np.ndarray, np.ndarray]:
    """4*4 coefficients and right sides (a column a value) of the two pairs, the inner unknowns eliminated.

    A pair's outer unknown counts in the segment whose row it is.
    """
    s, g = np.zeros((4, 4)), np.zeros((4, band.y.shape[1]))
    top = band.high - band.low
    if band.has_left:
        s[1, 1], g[1] = band.a[0, 1], band.rhs[1]
    if band.has_right:
        s[2, 2], s[2, 3], s[3, 2], g[2] = band.a[0, top - 1], band.a[1, top - 1], band.a[1, top - 1], band.rhs[top - 1]
    inside = band.inner
    if inside.stop > inside.start:
        links = band.links()
        x = five_diagonals(band.a[:, inside], np.concatenate([links, band.rhs[inside]], axis=1))
        s -= links.T @ x[:, :4]
        g -= links.T @ x[:, 4:]
    return s, g


def solve_pairs(s: np.ndarray, g: np.ndarray) -> np.ndarray:
    """For each segment in order the values of its left and right pair (4 rows, a column a value)."""
    count = len(s)
    diagonal, right = s[:-1, 2:, 2:] + s[1:, :2, :2], g[:-1, 2:] + g[1:, :2]
    link = s[1:-1, :2, 2:]
    for k in range(1, count - 1):
        both = np.linalg.solve(diagonal[k - 1], np.concatenate([link[k - 1], right[k - 1]], axis=1))
        diagonal[k] -= link[k - 1].T @ both[:, :2]
        right[k] -= link[k - 1].T @ both[:, 2:]
    x = np.zeros_like(right)
    for k in range(count - 2, -1, -1):
        x[k] = np.linalg.solve(diagonal[k], right[k] - (link[k] @ x[k + 1] if k + 1 < count - 1 else 0.0))
    out = np.zeros((count, 4, g.shape[2]))
    out[1:, :2], out[:-1, 2:] = x, x
    return out
