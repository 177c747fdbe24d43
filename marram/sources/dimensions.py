"""Calibration and layout files. They are small by nature and are read on the driver, through Spark's file systems."""

from __future__ import annotations

import re
from dataclasses import dataclass

import yaml
from pyspark.sql import DataFrame, SparkSession


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def vector(text: str | list) -> list[float]:
    """``"[x, y, z]"``, or a list as it is."""
    return [float(v) for v in (text if isinstance(text, list) else text.strip().strip("[]").split(","))]


def constellation(seq: str) -> str:
    """The last part of a sequence's name tells its anchor layout."""
    return seq.rsplit("_", 1)[-1]


def anchors(spark: SparkSession, path: str, seq: str) -> DataFrame:
    """id, x, y, z of the sequence's layout."""
    layout = yaml.safe_load(read_text(spark, path))[constellation(seq)]
    return _vectors(spark, {int(k): vector(v) for k, v in layout.items()})


def tag_arms(spark: SparkSession, path: str) -> DataFrame:
    """id, x, y, z of every robot's tags."""
    robots = yaml.safe_load(read_text(spark, path))
    return _vectors(spark, {int(k): vector(v) for tags in robots.values() for k, v in tags.items()})


def _vectors(spark: SparkSession, found: dict[int, list[float]]) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in sorted(found.items())], "id int, x double, y double, z double")


def height_bias(spark: SparkSession, path: str, robot: str) -> float:
    """A number; of a dict its first key, of a list its first item."""
    value = yaml.safe_load(read_text(spark, path))[robot]
    if isinstance(value, dict):
        value = next(iter(value))
    elif isinstance(value, list):
        value = value[0]
    return float(value)


def timeshift(spark: SparkSession, path: str) -> float:
    """Seconds plus nanoseconds; both terms count."""
    value = yaml.safe_load(read_text(spark, path))
    return float(value["timeshift_s"]) + float(value["timeshift_ns"]) / 1e9


def extrinsic(spark: SparkSession, path: str, camera: int = 0) -> list[float]:
    """The 16 numbers (row-major) after ``data:`` of body_T_cam<k>; anything else is an error."""
    text = read_text(spark, path)
    key = f"body_T_cam{camera}"
    if key not in text:
        raise KeyError(f"{path} has no {key}")
    m = re.search(re.escape(key) + r".*?data:\s*\[(.*?)\]", text, re.DOTALL)
    numbers = [float(v) for v in m[1].replace("\n", " ").split(",")] if m else []
    if len(numbers) != 16:
        raise ValueError(f"{key} in {path} has {len(numbers)} numbers, not 16")
    return numbers


@dataclass(frozen=True)
class StereoCalibration:
    """Intrinsics fx, fy, cx, cy and distortion per camera, size, and the pose of camera 1 against 0 (row-major 4x4)."""

    intrinsics: tuple[tuple[float, ...], tuple[float, ...]]
    distortion: tuple[tuple[float, ...], tuple[float, ...]]
    size: tuple[int, int]
    transform: tuple[float, ...]

    @property
    def baseline(self) -> float:
        return abs(self.transform[3])

    def matrix(self, camera: int) -> list[float]:
        fx, fy, cx, cy = self.intrinsics[camera]
        return [fx, 0.0, cx, 0.0, fy, cy, 0.0, 0.0, 1.0]


def stereo_calibration(spark: SparkSession, path: str) -> StereoCalibration:
    value = yaml.safe_load(read_text(spark, path))
    cams = [value["cam0"], value["cam1"]]
    flat = [float(v) for row in cams[1]["T_cn_cnm1"] for v in row]
    return StereoCalibration(tuple(tuple(map(float, c["intrinsics"])) for c in cams), tuple(tuple(map(float, c["distortion_coeffs"])) for c in cams), tuple(cams[0]["resolution"]), tuple(flat))
