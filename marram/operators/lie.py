"""Rotations and rigid motions in NumPy, over arrays of any leading shape.

Tangents are [rotation(3), translation(3)]; a pose moves by pose * exp(tangent).
"""

from __future__ import annotations

import numpy as np


def skew(v: np.ndarray) -> np.ndarray:
    out = np.zeros((*v.shape[:-1], 3, 3))
    out[..., 0, 1], out[..., 0, 2], out[..., 1, 2] = -v[..., 2], v[..., 1], -v[..., 0]
    return out - np.swapaxes(out, -1, -2)


def so3_exp(w: np.ndarray) -> np.ndarray:
    a = np.linalg.norm(w, axis=-1)[..., None, None]
    k = skew(w)
    small = a < 1e-8
    safe = np.where(small, 1.0, a)
    first = np.where(small, 1 - a**2 / 6, np.sin(safe) / safe)
    second = np.where(small, 0.5 - a**2 / 24, (1 - np.cos(safe)) / safe**2)
    return np.eye(3) + first * k + second * (k @ k)


def so3_log(r: np.ndarray) -> np.ndarray:
    """Rotation vector, through the quaternion, which is well behaved up to half a turn."""
    q = quat_of(r)
    q = np.where(q[..., 3:] < 0, -q, q)
    v, w = q[..., :3], q[..., 3:]
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    small = n < 1e-10
    return np.where(small, 2 * v, 2 * np.arctan2(n, w) / np.where(small, 1, n) * v)


def quat_of(r: np.ndarray) -> np.ndarray:
    """Unit quaternion xyzw: the eigenvector of the largest eigenvalue of a symmetric 4x4 form."""
    m = np.zeros((*r.shape[:-2], 4, 4))
    t = np.trace(r, axis1=-2, axis2=-1)
    m[..., :3, :3] = r + np.swapaxes(r, -1, -2) - t[..., None, None] * np.eye(3)
    v = np.stack([r[..., 2, 1] - r[..., 1, 2], r[..., 0, 2] - r[..., 2, 0], r[..., 1, 0] - r[..., 0, 1]], axis=-1)
    m[..., :3, 3] = m[..., 3, :3] = v
    m[..., 3, 3] = t
    return np.linalg.eigh(m)[1][..., :, -1]


def rotation_of(q: np.ndarray) -> np.ndarray:
    q = q / np.linalg.norm(q, axis=-1, keepdims=True)
    v, w = q[..., :3], q[..., 3]
    k = skew(v)
    return np.eye(3) + 2 * w[..., None, None] * k + 2 * (k @ k)


def left_jacobian(w: np.ndarray) -> np.ndarray:
    a = np.linalg.norm(w, axis=-1)[..., None, None]
    k = skew(w)
    small = a < 1e-5
    safe = np.where(small, 1.0, a)
    first = np.where(small, 0.5 - a**2 / 24, (1 - np.cos(safe)) / safe**2)
    second = np.where(small, 1 / 6 - a**2 / 120, (safe - np.sin(safe)) / safe**3)
    return np.eye(3) + first * k + second * (k @ k)


def se3_exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, v = x[..., :3], x[..., 3:]
    return so3_exp(w), (left_jacobian(w) @ v[..., None])[..., 0]


def se3_log(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    w = so3_log(r)
    return np.concatenate([w, np.linalg.solve(left_jacobian(w), t[..., None])[..., 0]], axis=-1)


def between(ra, ta, rb, tb) -> tuple[np.ndarray, np.ndarray]:
    """inverse(a) * b."""
    rt = np.swapaxes(ra, -1, -2)
    return rt @ rb, (rt @ (tb - ta)[..., None])[..., 0]


def adjoint(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """n*6*6 that carries a tangent through a pose."""
    out = np.zeros((*r.shape[:-2], 6, 6))
    out[..., :3, :3] = out[..., 3:, 3:] = r
    out[..., 3:, :3] = skew(t) @ r
    return out


def inverse_right_jacobian(x: np.ndarray) -> np.ndarray:
    """n*6*6 derivative of log(exp(x) exp(d)) by d at 0.

    It is the inverse of the left Jacobian at -x, whose lower left block is a series in the products
    of the two parts' skew matrices, summed in closed form (by its first terms near no rotation).
    """
    w, v = -x[..., :3], -x[..., 3:]
    a = np.linalg.norm(w, axis=-1)[..., None, None]
    small = a < 1e-2
    s = np.where(small, 1.0, a)
    k, l = skew(w), skew(v)
    second = np.where(small, 1 / 6 - a**2 / 120, (s - np.sin(s)) / s**3)
    third = np.where(small, 1 / 24 - a**2 / 720, (s**2 + 2 * np.cos(s) - 2) / (2 * s**4))
    fourth = np.where(small, 1 / 120 - a**2 / 2520, (2 * s - 3 * np.sin(s) + s * np.cos(s)) / (2 * s**5))
    kl, lk, klk = k @ l, l @ k, k @ l @ k
    lower = l / 2 + second * (kl + lk + klk) + third * (k @ kl + lk @ k - 3 * klk) + fourth * (klk @ k + k @ klk)
    own = np.linalg.inv(left_jacobian(w))
    out = np.zeros((*x.shape[:-1], 6, 6))
    out[..., :3, :3] = out[..., 3:, 3:] = own
    out[..., 3:, :3] = -own @ lower @ own
    return out
