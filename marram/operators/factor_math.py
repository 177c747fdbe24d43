"""Residuals and Jacobians of constraints, over whole batches. Poses are (rotation n*3*3, position n*3).

Jacobians are with respect to the right tangent [rotation, translation] of each pose.
"""

from __future__ import annotations

import numpy as np

from marram.operators.lie import adjoint, between, inverse_right_jacobian, se3_exp, se3_log, skew

LEAST_LENGTH = 1e-6


def range_jacobian(r: np.ndarray, u: np.ndarray, arm: np.ndarray | None = None) -> np.ndarray:
    """n*6 derivative of a distance along u (pointing at this pose's antenna)."""
    ur = (u[:, None, :] @ r)[:, 0]
    out = np.zeros((len(u), 6))
    out[:, 3:] = ur
    if arm is not None:
        out[:, :3] = -(ur[:, None, :] @ skew(arm))[:, 0]
    return out


def _direction(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.linalg.norm(d, axis=1)
    return n, d / np.maximum(n, LEAST_LENGTH)[:, None]


def antenna(r: np.ndarray, p: np.ndarray, arm: np.ndarray | None) -> np.ndarray:
    return p if arm is None else p + (r @ arm[..., None])[..., 0]


def anchor_range(r, p, anchor, z, bias=0.0, arm=None):
    """residual n, Jacobian n*6 of a range to a fixed point; the derivative by bias is 1."""
    n, u = _direction(antenna(r, p, arm) - anchor)
    return n - z + bias, range_jacobian(r, u, arm)


def inter_range(ra, pa, rb, pb, z, bias=0.0, arm_a=None, arm_b=None):
    """residual n, Jacobians n*6 by each pose of a range between two poses."""
    n, u = _direction(antenna(ra, pa, arm_a) - antenna(rb, pb, arm_b))
    return n - z + bias, range_jacobian(ra, u, arm_a), range_jacobian(rb, -u, arm_b)


def scalar_jacobian(r: np.ndarray) -> np.ndarray:
    """n*6 derivative of a scalar that is kept as the x of a pose."""
    out = np.zeros((len(r), 6))
    out[:, 3:] = r[:, 0, :]
    return out


def height(r, p, h):
    out = np.zeros((len(p), 6))
    out[:, 3:] = r[:, 2, :]
    return p[:, 2] - h, out


def odometry(ra, pa, rb, pb, rm, pm):
    """log(measured^-1 * a^-1 * b), n*6."""
    return se3_log(*between(rm, pm, *between(ra, pa, rb, pb)))


def odometry_jacobians(e, ra, pa, rb, pb):
    """n*6*6 by each pose, at residual ``e``: a step of b comes last, one of a is carried through the motion between them."""
    by_b = inverse_right_jacobian(e)
    return -by_b @ adjoint(*between(rb, pb, ra, pa)), by_b


def pose_prior(r, p, r0, p0):
    return se3_log(*between(r0, p0, r, p))


def gravity(r, measured, up=np.array([0.0, 0.0, 1.0])):
    """Tilt between the world's up seen in the body and the measured one, as two components across the latter (n*2)."""
    return (_across(measured) @ (np.swapaxes(r, -1, -2) @ up[..., None]))[..., 0]


def gravity_jacobian(r, measured, up=np.array([0.0, 0.0, 1.0])):
    """n*2*6: what is seen turns against the pose."""
    out = np.zeros((len(r), 2, 6))
    out[..., :3] = _across(measured) @ skew((np.swapaxes(r, -1, -2) @ up[..., None])[..., 0])
    return out


def _across(measured):
    """n*2*3: two directions across each vector."""
    least = np.abs(measured).argmin(axis=1)
    e1 = np.cross(measured, np.eye(3)[least])
    e1 /= np.linalg.norm(e1, axis=1, keepdims=True)
    return np.stack([e1, np.cross(measured, e1)], axis=1)


def numeric(residual, r, p, eps: float = 1e-6) -> np.ndarray:
    """Central differences of residual(r, p) by the pose's right tangent: n*k*6."""
    columns = []
    for i in range(6):
        step = np.zeros(6)
        step[i] = eps
        sides = []
        for s in (1, -1):
            dr, dt = se3_exp(s * step)
            out = residual(r @ dr, p + (r @ dt[:, None])[..., 0])
            sides.append(out[:, None] if out.ndim == 1 else out)
        columns.append((sides[0] - sides[1]) / (2 * eps))
    return np.stack(columns, axis=-1)
