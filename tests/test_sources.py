import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from marram.operators.voxels import Occupancy
from marram.sources import dimensions, logs, sinks
from marram.streaming.live_map import live_fold, within_tolerance


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("logs")
    for robot in ("r1", "r2"):
        (base / "run_a" / robot).mkdir(parents=True)
    t = np.arange(0, 5, 0.1)
    lines = ["timestamp,pose.position.x,pose.position.y,pose.position.z,pose.orientation.x,pose.orientation.y,pose.orientation.z,pose.orientation.w"]
    for i, s in enumerate(t):
        q = [0.0, 0.0, np.sin(s / 4), np.cos(s / 4)]
        if i == 20:
            q = [1.0, 0.0, 0.0, 0.0]
        if i % 7 == 3:
            q = [-v for v in q]
        pos = [0.0, 0.0, 0.0] if i == 30 else [s, 1.0 + np.sin(s), 2.0]
        lines.append(",".join(map(str, [s, *pos, *q])))
    (base / "run_a/r1/mocap.csv").write_text("\n".join(lines))
    (base / "run_a/r1/uwb_range.csv").write_text("timestamp,from_id,to_id,range,std,gt_range,bias,extra\n2,10,1,3,0.9,3,0,x\n1,10,2,3,0.1,3,0,x\n")
    (base / "run_a/r2/uwb_range.csv").write_text("std,timestamp,from_id,to_id,range,gt_range,bias\n0.1,2,10,1,3,3,0\n0.5,3,10,21,4,4,0\n")
    (base / "run_a/r1/height.csv").write_text("timestamp,range\n2,1.5\n1,1.25\n")
    (base / "vio.csv").write_text("".join(f"{(5 - i) * 10**9},{i},0,0,1,0,0,0,3,4,0,9,9\n" for i in range(5)))
    (base / "kf.txt").write_text("2.0 1 2 3 0 0 0 1\n  1.0\t4 5 6 0 0 0 1 \n\n")
    (base / "anchors.yaml").write_text('a:\n  0: "[1, 2, 3]"\n  1: "[4, 5, 6.5]"\n')
    (base / "tags.yaml").write_text('r1:\n  10: "[0.1, 0, 0]"\nr2:\n  20: [0, 0.2, 0]\n')
    (base / "bias.yaml").write_text("r1: 0.25\nr2: {0.5: x}\nr3: [0.75]\n")
    (base / "shift.yaml").write_text("timeshift_s: 1\ntimeshift_ns: 250000000\n")
    (base / "vins.yaml").write_text("%YAML:1.0\nbody_T_cam0: !!opencv-matrix\n  rows: 4\n  data: [" + ", ".join(map(str, range(16))) + "]\nbody_T_cam1: !!opencv-matrix\n  data: [1, 2]\n")
    (base / "list.txt").write_text("1.5 a/b.jpeg\n\n2.5\nx y\n")
    return base


def test_ranges_dedup_then_bound(spark, root):
    rows = logs.by_time(logs.ranges(spark, str(root), "run_a", ["r1", "r2", "r3"])).collect()
    assert [(r["timestamp"], r["to_id"], r["kind"]) for r in rows] == [(1.0, 2, "anchor"), (3.0, 21, "inter")]
    with pytest.raises(FileNotFoundError):
        logs.ranges(spark, str(root), "run_b", ["r1"])


def test_truth_is_cleaned_and_smoothed(spark, root):
    raw = logs.ground_truth(spark, str(root), "run_a", "r1", clean=False)
    clean, counts = logs.clean_truth(raw.withColumn("entity", F.lit(0)))
    assert counts.first()["dropped"] == 3 and clean.count() == 47
    rows = logs.ground_truth(spark, str(root), "run_a", "r1").orderBy("timestamp").collect()
    assert len(rows) == 50
    assert all(abs(r["x"] - r["timestamp"]) < 0.02 and abs(r["qx"] ** 2 + r["qy"] ** 2 + r["qz"] ** 2 + r["qw"] ** 2 - 1) < 1e-9 for r in rows)
    assert logs.ground_truth(spark, str(root), "run_a", "r9", clean=False).count() == 0


def test_other_logs(spark, root):
    assert [(r["timestamp"], r["h"]) for r in logs.by_time(logs.heights(spark, str(root), "run_a", "r1", 0.25)).collect()] == [(1.0, 1.0), (2.0, 1.25)]
    assert [(r["t"], r["x"], r["v"]) for r in logs.by_time(logs.odometry(spark, f"{root}/vio.csv", 0.5), "t").collect()] == [(0.5, 4.0, 5.0), (2.5, 2.0, 5.0), (4.5, 0.0, 5.0)]
    assert [(r["t"], r["x"]) for r in logs.by_time(logs.keyframes(spark, f"{root}/kf.txt"), "t").collect()] == [(1.0, 4.0), (2.0, 1.0)]
    assert logs.keyframes(spark, f"{root}/none.txt").count() == 0
    assert [tuple(r) for r in logs.image_list(spark, f"{root}/list.txt").collect()] == [(1.5, "a/b.jpeg")]
    a, b = (spark.createDataFrame([(p,) for p in ps], "path string") for ps in (["x/1.5.jpeg", "x/2.jpeg"], ["y/2.jpeg", "y/3.jpeg"]))
    assert [tuple(r) for r in logs.frame_pairs(a, b).collect()] == [("2.jpeg", 2.0)]
    near = logs.nearest_frames(spark.createDataFrame([(1.97, 1), (2.2, 2), (2.04, 3)], "t double, k int"), a, b)
    assert sorted((r["k"], r["frame_t"], r["left_path"], r["right_path"]) for r in near.collect()) == [(1, 2.0, "x/2.jpeg", "y/2.jpeg"), (3, 2.0, "x/2.jpeg", "y/2.jpeg")]
    assert [r["k"] for r in logs.nearest_frames(spark.createDataFrame([(2.04, 3), (1.97, 1)], "t double, k int"), a, b, most=1).collect()] == [1]


def test_npz_dump(spark, tmp_path):
    poses = np.tile(np.eye(4), (3, 1, 1))
    poses[:, :3, 3] = np.arange(9).reshape(3, 3)
    np.savez(tmp_path / "a.npz", t=np.array([0.0, 1.0, 2.0]), T=poses, tr_sigma_pos=np.array([0.1, 0.2, 0.3]))
    np.savez(tmp_path / "b.npz", t=np.array([0.5]), T=poses[:1], tr_sigma_pos=np.array([0.1]), p_body=np.array([[7.0, 8.0, 9.0]]), sigma_pos=np.eye(3)[None])
    a, b = (sorted(logs.npz_poses(spark, f"{tmp_path}/{n}.npz", n).collect(), key=lambda r: r["i"]) for n in "ab")
    assert [(r["t"], r["tr_sigma_pos"], r["p_body"]["y"], r["sigma_pos"]) for r in a] == [(0.0, 0.1, 1.0, None), (1.0, 0.2, 4.0, None), (2.0, 0.3, 7.0, None)]
    assert b[0]["robot"] == "b" and b[0]["p_body"]["x"] == 7.0 and b[0]["sigma_pos"] == [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0] and b[0]["pose"][15] == 1.0


def test_keyframe_policy(spark, root):
    assert logs.enough_keyframes(spark, {"r1": f"{root}/kf.txt", "r2": f"{root}/none.txt"}, 2) == {"r1": 2}
    tries = []
    assert logs.with_retries(tries.append, ["a", "b"], lambda r: 25 if r == "a" or len(tries) > 2 else 3) == {"a": 25, "b": 25}
    assert tries == ["a", "b", "b"]
    tries.clear()
    assert logs.with_retries(tries.append, ["a"], lambda r: 3) == {"a": 3} and len(tries) == 3


def test_dimensions(spark, root):
    assert [tuple(r) for r in dimensions.anchors(spark, f"{root}/anchors.yaml", "x_y_a").collect()] == [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.5)]
    assert dimensions.tag_arms(spark, f"{root}/tags.yaml").count() == 2
    assert [dimensions.height_bias(spark, f"{root}/bias.yaml", r) for r in ("r1", "r2", "r3")] == [0.25, 0.5, 0.75]
    assert dimensions.timeshift(spark, f"{root}/shift.yaml") == 1.25
    assert dimensions.extrinsic(spark, f"{root}/vins.yaml") == list(map(float, range(16)))
    with pytest.raises(ValueError):
        dimensions.extrinsic(spark, f"{root}/vins.yaml", 1)
    with pytest.raises(KeyError):
        dimensions.extrinsic(spark, f"{root}/vins.yaml", 2)


def test_sinks(spark, tmp_path):
    report = spark.createDataFrame([("r1", 7, 0.17123456, 0.0661, 61.44)], "robot string, n long, before double, after double, improve_pct double")
    sinks.summary_json(report, spark.createDataFrame([("odo", 3)], "kind string, n long"), f"{tmp_path}/s.json")
    assert json.loads((tmp_path / "s.json").read_text()) == {"stats": {"odo": 3}, "per_robot": {"r1": {"before_rmse": 0.1712, "after_rmse": 0.0661, "improve_pct": 61.4, "keyframes": 7}}}
    cells = spark.createDataFrame([(1, -2, 3, 4, 5, 6, 7, 8)], "ix long, iy long, iz long, r int, g int, b int, ao int, mask int")
    payload = sinks.viewer_payload(cells, 0.1, 5)
    assert payload["idx"] == sinks.packed([1, -2, 3], "<i2") and payload["count"] == 1
    sinks.viewer_html(spark, "<b>__TITLE__</b>/*__OCC_DATA__*/null;", payload, "t", "s", f"{tmp_path}/v.html")
    assert (tmp_path / "v.html").read_text().startswith("<b>t</b>{")
    with pytest.raises(ValueError):
        sinks.viewer_payload(cells.unionAll(cells), 0.1, 1)


def test_live_map_folds_batch_by_batch(spark, tmp_path):
    schema = "frame long, ix long, iy long, iz long, value double"
    for k, v in enumerate([3.0, 3.0, -1.0, -9.0]):
        spark.createDataFrame([(k, 0, 0, 0, v / 2), (k, 0, 0, 0, v / 2)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live_fold(stream, Occupancy()).writeStream.outputMode("update").format("memory").queryName("live").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [r["l"] for r in spark.table("live").collect()][-1] == -2.0


def test_streams_meet_within_tolerance(spark, tmp_path):
    make = lambda rows, path: spark.createDataFrame(rows, "k string, s double").select("k", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(path)
    make([("a", 10.0), ("b", 20.0)], f"{tmp_path}/l")
    make([("a", 10.4), ("a", 12.0), ("b", 19.5)], f"{tmp_path}/r")
    read = lambda p, n: spark.readStream.schema("k string, ts timestamp").parquet(p).withColumnRenamed("ts", n)
    pairs = within_tolerance(read(f"{tmp_path}/l", "lt"), read(f"{tmp_path}/r", "rt"), ["k"], "lt", "rt", 0.5)
    q = pairs.writeStream.format("memory").queryName("pairs").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r["k"], round(r["gap"], 3)) for r in spark.table("pairs").collect()) == [("a", 0.4), ("b", 0.5)]
