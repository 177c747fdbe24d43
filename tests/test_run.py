"""Whole runs on a small data set on disk: two robots, four anchors, a wall."""

import base64
import json

import numpy as np
import pytest

from marram.__main__ import main
from marram.operators.lie import quat_of, so3_exp
from marram.sources import dimensions, logs, sinks

ROBOTS = ["r1", "r2"]
ANCHORS = {0: (-4.0, -4.0, 0.5), 1: (6.0, -4.0, 2.5), 2: (6.0, 4.0, 0.5), 3: (-4.0, 4.0, 2.5)}
#: The camera looks along the body's x.
CAMERA = [0, 0, 1, 0.1, -1, 0, 0, 0, 0, -1, 0, 0, 0, 0, 0, 1]
FX, BASELINE, WALL = 40.0, 2.5, 4.0


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("set")
    t = np.arange(0, 6, 0.1)
    at = {k: np.stack([0.6 * np.cos(t / 2 + k), 0.8 * np.sin(t / 2 + 2 * k) + 2.5 * k - 1.2, 1.0 + 0.1 * np.sin(t)], axis=1) for k in range(2)}
    ranges: dict[str, list[str]] = {r: ["timestamp,from_id,to_id,range,std,gt_range,bias"] for r in ROBOTS}
    for k, robot in enumerate(ROBOTS):
        here = base / "data/run_a" / robot
        here.mkdir(parents=True)
        (here / "infra1").mkdir()
        for s in (1.25, 0.5):
            (here / "infra1" / f"{s}.jpeg").write_bytes(b"x")
        turn = so3_exp(np.stack([0 * t, 0 * t, 0.05 * np.sin(t)], axis=1))
        q = quat_of(turn)
        head = "timestamp," + ",".join(["pose.position." + c for c in "xyz"] + ["pose.orientation." + c for c in "xyzw"])
        (here / "mocap.csv").write_text(head + "\n" + "\n".join(",".join(map(repr, map(float, [s, *p, *o]))) for s, p, o in zip(t, at[k], q, strict=True)))
        (here / "height.csv").write_text("timestamp,range\n" + "\n".join(f"{s},{p[2] + 0.2}" for s, p in zip(t, at[k], strict=True)))
        yaw = so3_exp(np.array([0.0, 0.0, 0.4 + k]))
        drift = np.stack([0.02 * t, -0.03 * t, 0 * t], axis=1)
        own = (at[k] + drift) @ yaw  # the inverse turn
        q = quat_of(yaw.T @ turn)
        track = base / "vio/run_a" / robot
        track.mkdir(parents=True)
        (track / "vio.csv").write_text("".join(f"{round((s + 1.25) * 1e9)},{','.join(repr(float(v)) for v in [*p, o[3], *o[:3], 0.1, 0.0, 0.0])}\n" for s, p, o in zip(t, own, q, strict=True)))
        for i, s in enumerate(t):
            for a, xyz in ANCHORS.items():
                z = float(np.linalg.norm(at[k][i] - np.array(xyz)))
                ranges[robot].append(f"{s},{10 * (k + 1)},{a},{z + 0.14},0.05,{z},0")
            z = float(np.linalg.norm(at[0][i] - at[1][i]))
            ranges[robot].append(f"{s},{10 * (k + 1)},{20 - 10 * k},{z + 0.14},0.05,{z},0")
        (here / "uwb_range.csv").write_text("\n".join(ranges[robot]) + "\n")
        for folder in ("vins", "realsense"):
            (base / "config" / folder / robot).mkdir(parents=True)
        (base / f"config/vins/{robot}/vins.yaml").write_text(f"body_T_cam0: !!opencv-matrix\n  data: {CAMERA}\n")
        rows = [[1.0, 0, 0, -BASELINE], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1.0]]
        cam = "  intrinsics: [40.0, 40.0, 24.0, 16.0]\n  distortion_coeffs: [0.0, 0.0, 0.0, 0.0]\n  resolution: [48, 32]\n"
        (base / f"config/realsense/{robot}/intrinsics.yaml").write_text(f"cam0:\n{cam}cam1:\n{cam}  T_cn_cnm1: {rows}\n")
    (base / "data/run_a/timeshift.yaml").write_text("timeshift_s: 1\ntimeshift_ns: 250000000\n")
    for folder in ("uwb", "height"):
        (base / "config" / folder).mkdir()
    (base / "config/uwb/anchors.yaml").write_text("a:\n" + "".join(f"  {k}: {list(v)}\n" for k, v in ANCHORS.items()))
    (base / "config/uwb/tags.yaml").write_text("r1:\n  10: [0.0, 0.0, 0.05]\nr2:\n  20: [0.0, 0.0, 0.05]\n")
    (base / "config/height/bias.yaml").write_text("r1: 0.2\nr2: 0.2\n")
    return base


def command(spark, root, name, out, *more):
    return main([name, "--root", str(root), "--odometry", f"{root}/vio", "--seq", "run_a", "--robots", "r1,r2", "--out", out, *more], spark)


def test_fuse_scores_and_writes_a_summary(spark, root, tmp_path):
    found = command(spark, root, "fuse", str(tmp_path))
    written = json.loads((tmp_path / "run_a_summary.json").read_text())
    assert written["per_robot"].keys() == {"r1", "r2"} and found["biases"] == {}
    for r in written["per_robot"].values():
        assert r["keyframes"] == 30 and r["after_rmse"] < r["before_rmse"] < 0.1 and r["improve_pct"] > 0
    assert written["stats"]["odometry"] == 58 and written["stats"]["gravity"] == 60


@pytest.fixture(scope="module")
def poses(spark, root, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("dump") / "poses")
    traces = command(spark, root, "dump", path)
    assert [r["robot"] for r in traces] == ["r1", "r2"] and all(0 < r["low"] <= r["middle"] <= r["high"] < 0.5 for r in traces)
    return path


def test_dump_has_camera_poses_and_covariance(spark, root, poses, tmp_path):
    rows = logs.poses(spark, poses).collect()
    assert len(rows) == 60
    for r in rows:
        m, p = np.array(r["pose"]).reshape(4, 4), np.array([r["p_body"][c] for c in "xyz"])
        assert np.allclose(m[:3, :3] @ m[:3, :3].T, np.eye(3), atol=1e-9) and np.isclose(np.linalg.norm(m[:3, 3] - p), 0.1)
        assert np.isclose(np.trace(np.array(r["sigma_pos"]).reshape(3, 3)), r["tr_sigma_pos"])
    free = command(spark, root, "dump", str(tmp_path / "free"), "--anchor-free", "--write", "r2")
    assert [r["robot"] for r in free] == ["r2"]


@pytest.fixture(scope="module")
def disparities(spark, poses, tmp_path_factory):
    """Each pixel of a 48 x 32 image sees the wall; one frame sees nothing, one comes too late for its pose."""
    rows = []
    for r in logs.poses(spark, poses).collect():
        m = np.array(r["pose"]).reshape(4, 4)
        for u in range(48):
            for v in range(32):
                ray = m[:3, :3] @ np.array([(u - 24.0) / FX, (v - 16.0) / FX, 1.0])
                z = (WALL - m[0, 3]) / ray[0]
                rows.append((r["robot"], r["t"] + (0.2 if r["i"] == 4 else 0.001), u, v, float("nan") if r["i"] == 8 else float(FX * BASELINE / z)))
    path = str(tmp_path_factory.mktemp("disparities") / "d")
    spark.createDataFrame(rows, "robot string, t double, u int, v int, disparity double").write.parquet(path)
    return path


def test_map_shows_the_wall(spark, root, poses, disparities, tmp_path):
    at = ["--poses", poses, "--disparities", disparities, "--stride", "4"]
    command(spark, root, "map", str(tmp_path / "map"), *at)
    cells = spark.read.parquet(str(tmp_path / "map")).collect()
    occupied = [r for r in cells if r["l"] > 0.85]
    assert len(occupied) > 20 and {r["ix"] for r in occupied} <= {38, 39, 40}
    assert sum(r["l"] < -0.4 for r in cells) > 500 and all(r["ix"] <= 40 for r in cells)
    command(spark, root, "map", str(tmp_path / "few"), *at, "--frames", "1", "--uniform")
    few = spark.read.parquet(str(tmp_path / "few")).collect()
    assert 0 < len(few) < len(cells) and max(r["l"] for r in few) > 0.85
    got = command(spark, root, "compare", str(tmp_path / "diff"), *at, "--height", "1.0").first()
    assert 0 <= got["suppressed"] <= got["uniform_free"] and got["uniform_free"] > 20


def test_viewer_page(spark, root, poses, disparities, tmp_path):
    (tmp_path / "t.html").write_text("<title>__TITLE__</title>__SUBTITLE__<script>x = /*__OCC_DATA__*/null;</script>")
    scene = command(spark, root, "export", str(tmp_path / "v.html"), "--poses", poses, "--disparities", disparities, "--template", str(tmp_path / "t.html"), "--title", "wall", "--max-free", "100")
    page = (tmp_path / "v.html").read_text()
    assert page.startswith("<title>wall</title>") and json.loads(page.split("x = ")[1].split(";</script>")[0]) == scene
    idx = np.frombuffer(base64.b64decode(scene["occ_idx_b64"]), "<i2").reshape(-1, 3)
    n = len(idx)
    assert n > 20 and set(idx[:, 0]) <= {38, 39, 40}
    assert len(base64.b64decode(scene["occ_col_b64"])) == 3 * n and len(base64.b64decode(scene["occ_ao_b64"])) == len(base64.b64decode(scene["occ_mask_b64"])) == n
    assert len(base64.b64decode(scene["free_idx_b64"])) == 600
    assert [p["name"] for p in scene["trajs"]] == ["r1", "r2"] and scene["czmin"] < scene["czmax"] and scene["radius"] > 1


def test_front_end_files(spark, root, tmp_path):
    command(spark, root, "prepare", str(tmp_path))
    text = (tmp_path / "r1.yaml").read_text()
    assert text.startswith("%YAML:1.0\n") and "Camera1.fx: 40.0\n" in text and "Camera.width: 48\n" in text and "ORBextractor.nFeatures: 1500\n" in text
    lines = [x.split(" ", 1) for x in "".join(p.read_text() for p in sorted((tmp_path / "run_a_r1_list").glob("part-*"))).splitlines()]
    assert [x[0] for x in lines] == ["0.500000000", "1.250000000"] and lines[0][1].endswith("infra1/0.5.jpeg")
    assert dimensions.stereo_calibration(spark, f"{root}/config/realsense/r1/intrinsics.yaml").baseline == BASELINE
    assert sinks.FRONT_END[0] == ("Camera.fps", "30")
