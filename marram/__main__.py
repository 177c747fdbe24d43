"""Command line: python -m marram <command> --root DATA --odometry TRACKS ...; run under spark-submit or a local session."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from marram import run
from marram.operators.voxels import Occupancy
from marram.session import DEFAULTS
from marram.sources import dimensions, logs, sinks


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="marram")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        p.add_argument("--root", required=True, help="data set with data/ and config/")
        p.add_argument("--odometry", default="", help="folder of <seq>/<robot>/vio.csv")
        p.add_argument("--seq", default="default_3_zigzag_0")
        p.add_argument("--robots", default=",".join(run.ROBOTS))
        p.add_argument("--out", required=True)
        return p

    command("fuse", "solve a sequence and score it against the truth")
    p = command("dump", "solve with marginals and write fused poses")
    p.add_argument("--anchor-free", action="store_true")
    p.add_argument("--write", default="", help="robots to write; all unless given")
    for name, text in (("map", "fold depth observations into a voxel map"), ("compare", "weighted against uniform map"), ("export", "viewer page")):
        p = command(name, text)
        p.add_argument("--poses", required=True, help="what dump wrote")
        source = p.add_mutually_exclusive_group(required=True)
        source.add_argument("--disparities", help="Parquet of robot, t, u, v, disparity")
        source.add_argument("--images", help="Parquet of robot, t, camera (0 or 1), v, u, grey: raw pairs, rectified and matched here")
        p.add_argument("--stride", type=int, default=3 if name == "export" else 2)
        p.add_argument("--frames", type=int, help="at most so many of each robot")
        p.add_argument("--resolution", type=float, default=0.10)
        p.add_argument("--uniform", action="store_true")
        p.add_argument("--keep-mates", action="store_true", help="keep what is seen of other robots")
        if name == "map":
            p.add_argument("--octree", help="write the map as a binary octree file too")
        if name == "compare":
            p.add_argument("--height", type=float, default=0.8)
        if name == "export":
            p.add_argument("--template", required=True)
            p.add_argument("--title", default="Occupancy map")
            p.add_argument("--subtitle", default="")
            p.add_argument("--max-free", type=int, default=60_000)
    command("prepare", "settings and frame lists of the keyframe front-end")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    a = parser().parse_args(argv)
    if spark is None:
        builder = SparkSession.builder.appName("marram")
        for key, value in DEFAULTS.items():
            builder = builder.config(key, value)
        spark = builder.getOrCreate()
    at, robots = run.Layout(a.root, a.odometry), tuple(a.robots.split(","))
    if a.command == "fuse":
        found = run.fuse(spark, at, a.seq, a.out, robots=robots)
        print(json.dumps(found, indent=2))
        return found
    if a.command == "dump":
        found = [r.asDict() for r in run.dump(spark, at, a.seq, a.out, a.anchor_free, tuple(a.write.split(",")) if a.write else robots, robots).orderBy("robot").collect()]
        print(json.dumps(found))
        return found
    if a.command == "prepare":
        for robot in robots:
            run.prepare(spark, at, a.seq, robot, a.out)
        return None
    c = Occupancy(resolution=a.resolution, weighted=not a.uniform, dynamic_radius=0.0 if a.keep_mates else Occupancy.dynamic_radius)
    poses = logs.poses(spark, a.poses)
    known = {r: dimensions.stereo_calibration(spark, at.config(f"realsense/{r}/intrinsics.yaml")) for r in robots}
    frames = run.stereo_frames(spark.read.parquet(a.images), known) if a.images else spark.read.parquet(a.disparities)
    points = run.observations(poses, frames, known, c, a.stride, a.frames, rectified=bool(a.images))
    if a.command == "map":
        from marram.sources import octree, sinks

        sinks.voxel_map(run.occupancy_map(points, c), a.out)
        if a.octree:
            octree.write_octree(spark.read.parquet(a.out), a.octree, a.resolution)
        return None
    if a.command == "compare":
        found = run.compare(points, c, a.height)
        found.write.mode("overwrite").parquet(a.out)
        print(json.dumps(found.first().asDict()))
        return found
    return run.export(points, c, a.template, a.out, a.title, a.subtitle, a.max_free)


if __name__ == "__main__":
    main()
