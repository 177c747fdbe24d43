"""Rectification, undistortion and disparities on made-up cameras and scenes."""

import numpy as np
from pyspark.sql import functions as F

from marram import run
from marram.operators import stereo
from marram.operators.lie import so3_exp
from marram.operators.voxels import Occupancy
from marram.sources.dimensions import StereoCalibration

RNG = np.random.default_rng(11)
W, H = 64, 40


def pair(turn=(0.004, -0.006, 0.003)):
    pose = np.eye(4)
    pose[:3, :3], pose[:3, 3] = so3_exp(np.array(turn)), [-0.1, 0.001, 0.002]
    return StereoCalibration(((50.0, 51.0, 31.0, 20.0), (50.5, 50.2, 32.0, 19.5)), ((-0.02, 0.01, 0.001, 0.0005), (-0.01, 0.0, 0.0, 0.001)), (W, H), tuple(map(float, pose.ravel())))


def seen(c, camera, p):
    """Raw pixel of points in camera 0's frame."""
    pose = np.array(c.transform).reshape(4, 4)
    q = p if camera == 0 else p @ pose[:3, :3].T + pose[:3, 3]
    x, y = stereo.distorted(q[:, 0] / q[:, 2], q[:, 1] / q[:, 2], c.distortion[camera])
    fx, fy, cx, cy = c.intrinsics[camera]
    return fx * x + cx, fy * y + cy


def test_rectified_views_share_rows_and_disparity_is_inverse_depth():
    c = pair()
    r = stereo.rectification(c)
    p = np.stack([RNG.uniform(-1, 1, 50), RNG.uniform(-0.5, 0.5, 50), RNG.uniform(1, 4, 50)], axis=1)
    pose = np.array(c.transform).reshape(4, 4)
    left = p @ np.array(r.rotations[0]).reshape(3, 3).T
    right = (p @ pose[:3, :3].T + pose[:3, 3]) @ np.array(r.rotations[1]).reshape(3, 3).T
    assert np.allclose(left - right, [[r.baseline, 0, 0]], atol=1e-12)
    for m in r.rotations:
        m = np.array(m).reshape(3, 3)
        assert np.allclose(m @ m.T, np.eye(3)) and np.isclose(np.linalg.det(m), 1)


def test_rectified_pixels_look_where_the_lens_sees_them(spark):
    c = pair()
    r = stereo.rectification(c)
    for camera in (0, 1):
        rows = stereo.rectifying_map(spark, c, r, camera).groupBy("v", "u").agg(F.sum(F.col("weight") * F.col("su")).alias("x"), F.sum(F.col("weight") * F.col("sv")).alias("y"), F.sum("weight").alias("w"), F.min("su").alias("low"), F.max("su").alias("high")).collect()
        assert len(rows) == W * H and all(abs(x["w"] - 1) < 1e-9 for x in rows)
        # No pixel looks outside the image but for rounding at its rim.
        assert all(-1 <= x["low"] and x["x"] > -1e-3 and x["x"] < W - 1 + 1e-3 for x in rows)
        at = {(x["v"], x["u"]): (x["x"], x["y"]) for x in rows}
        m = np.array(r.rotations[camera]).reshape(3, 3)
        for v, u in ((0, 0), (20, 31), (39, 63), (7, 50)):
            ray = m.T @ [(u - r.cx) / r.focal, (v - r.cy) / r.focal, 1]
            x, y = stereo.distorted(ray[0] / ray[2], ray[1] / ray[2], c.distortion[camera])
            fx, fy, cx, cy = c.intrinsics[camera]
            assert np.allclose(at[v, u], [fx * x + cx, fy * y + cy], atol=1e-9)


def texture(x, y):
    return 128 + 60 * np.sin(x * 2.1) * np.cos(y * 1.7) + 40 * np.sin(x * 5.3 + y * 3.1) + 25 * np.cos(7.7 * y - 2.2 * x)


def plane_images(spark, c, z=2.0):
    """What both cameras see of a textured wall at depth z of camera 0."""
    pose = np.array(c.transform).reshape(4, 4)
    rows = []
    for camera in (0, 1):
        v, u = np.mgrid[0:H, 0:W]
        fx, fy, cx, cy = c.intrinsics[camera]
        want = np.stack([(u.ravel() - cx) / fx, (v.ravel() - cy) / fy])
        p = want.copy()
        for _ in range(20):
            p = p + want - np.stack(stereo.distorted(p[0], p[1], c.distortion[camera]))
        ray = np.stack([*p, np.ones(W * H)])
        turn, shift = (np.eye(3), np.zeros(3)) if camera == 0 else (pose[:3, :3].T, -pose[:3, :3].T @ pose[:3, 3])
        ray = turn @ ray
        at = shift[:, None] + ray * ((z - shift[2]) / ray[2])
        grey = texture(at[0] * 4, at[1] * 4)
        rows += [("r1", 1.0, camera, int(a), int(b), float(g)) for a, b, g in zip(v.ravel(), u.ravel(), grey, strict=True)]
    return spark.createDataFrame(rows, "robot string, t double, camera int, v int, u int, grey double")


def test_a_wall_comes_out_flat(spark):
    c = pair()
    r = stereo.rectification(c)
    found = run.stereo_frames(plane_images(spark, c), {"r1": c}, most=8).collect()
    assert len(found) == W * H
    sure = [x for x in found if x["disparity"] is not None]
    assert len(sure) > 0.6 * W * H
    off = []
    for x in sure:
        ray = np.array(r.rotations[0]).reshape(3, 3).T @ [(x["u"] - r.cx) / r.focal, (x["v"] - r.cy) / r.focal, 1]
        depth = 2.0 / ray[2]  # of the rectified camera
        off.append(abs(x["disparity"] - r.focal * r.baseline / depth))
    assert np.median(off) < 0.3 and np.quantile(off, 0.9) < 0.8


def test_points_of_rectified_frames_lie_on_the_wall(spark):
    c = pair((0.02, -0.03, 0.02))
    frames = run.stereo_frames(plane_images(spark, c), {"r1": c}, most=8)
    eye = np.eye(4).ravel().tolist()
    poses = spark.createDataFrame([("r1", 0, 1.0, eye, 0.0, (0.0, 0.0, 0.0), [0.0] * 9)], "robot string, i int, t double, pose array<double>, tr_sigma_pos double, p_body struct<x:double,y:double,z:double>, sigma_pos array<double>")
    z = [r["pz"] for r in run.observations(poses, frames, {"r1": c}, Occupancy(), stride=1, rectified=True).collect()]
    assert len(z) > 80 and abs(np.median(z) - 2.0) < 0.2
