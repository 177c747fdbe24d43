"""Writers. Tables go out as Parquet; reports and viewer payloads are bounded and are made on the driver."""

from __future__ import annotations

import base64
import html
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.functions.geometry import colour
from marram.operators import maps, ranks


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file through Spark's file systems, replacing what is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def summary_json(report: DataFrame, stats: DataFrame, path: str) -> dict:
    """Report rows (robot, n, before, after, improve_pct) and stats (kind, n) as one JSON file, rounded."""
    per = {r["robot"]: {"before_rmse": round(r["before"], 4), "after_rmse": round(r["after"], 4), "improve_pct": round(r["improve_pct"], 1), "keyframes": r["n"]} for r in report.collect()}
    out = {"stats": {r["kind"]: r["n"] for r in stats.collect()}, "per_robot": per}
    write_text(report.sparkSession, path, json.dumps(out, indent=2))
    return out


def pose_dump(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("robot").parquet(path)


def voxel_map(rows: DataFrame, path: str) -> None:
    """ix, iy, iz, l; writing changes nothing in the map, so it may come at any time."""
    rows.select("ix", "iy", "iz", "l").write.mode("overwrite").parquet(path)


def image_list(rows: DataFrame, path: str) -> None:
    """Lines "<t> <path>" with nine decimals, by time."""
    rows.orderBy("t").select(F.format_string("%.9f %s", "t", "path").alias("value")).write.mode("overwrite").text(path)


def packed(values, kind: str) -> str:
    """Base64 of little-endian numbers of a NumPy kind such as '<i2' or 'u1'."""
    return base64.b64encode(np.ascontiguousarray(np.asarray(values), dtype=kind).tobytes()).decode("ascii")


def viewer_payload(cells: DataFrame, resolution: float, most: int) -> dict:
    """Column-wise payload of at most ``most`` cells (ix, iy, iz, r, g, b, ao, mask); more cells are an error: thin them first."""
    rows = cells.select("ix", "iy", "iz", "r", "g", "b", "ao", "mask").limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} cells")
    return {
        "resolution": resolution,
        "count": len(rows),
        "idx": packed(rows[["ix", "iy", "iz"]].to_numpy(), "<i2"),
        "rgb": packed(rows[["r", "g", "b"]].to_numpy(), "u1"),
        "ao": packed(rows["ao"].to_numpy(), "u1"),
        "mask": packed(rows["mask"].to_numpy(), "u1"),
    }


#: Colours of the first three tracks in the viewer, and of any other.
TRACK_COLOURS, OTHER_COLOUR = ((0.96, 0.65, 0.14), (0.18, 0.83, 0.75), (0.88, 0.36, 0.78)), (0.7, 0.7, 0.7)


def viewer_scene(cells: DataFrame, tracks: DataFrame, resolution: float, most: int = 500_000, most_free: int = 60_000) -> dict:
    """The viewer's whole payload from a map (ix, iy, iz, l) and camera tracks (robot, t, x, y, z).

    Occupied cells (at most ``most``; more are an error) are coloured by height between the exact
    first and last percentiles and come with neighbourhood shade and hidden faces; free cells are
    thinned evenly; the view is framed on the tracks and the bulk of the occupied cells.
    """
    labelled = cells.withColumn("label", maps.classify(F.col("l")))
    small = " AND ".join(f"abs({c}) < 32767" for c in maps.CELL)
    occupied = labelled.where("label = 'occupied'").where(small).select(*maps.CELL)
    centre = lambda c: (F.col(c) + 0.5) * resolution
    low, high = ranks.quantiles(occupied, centre("iz"), [0.01, 0.99])
    low, high = (0.0, 1.0) if low is None else (low, high if high - low >= 1e-3 else low + 1.0)
    seen = maps.ambient_occlusion(occupied, []).join(maps.face_mask(occupied, []), list(maps.CELL))
    shown = seen.select(*maps.CELL, *[c.alias(n) for c, n in zip(colour((centre("iz") - low) / (high - low)), "rgb", strict=True)], "ao", "mask")
    dense = viewer_payload(shown, resolution, most)
    free = maps.thinned(labelled.where("label = 'free'").where(small).select(*maps.CELL), most_free, list(maps.CELL))
    span = occupied.agg(F.min(centre("iz")), F.max(centre("iz"))).first()
    bulk = occupied.select(*[centre(c).alias(a) for c, a in zip(maps.CELL, "xyz", strict=True)]).where((F.col("z") > low) & (F.col("z") < high))
    cloud = tracks.select("x", "y", "z").unionByName(bulk)
    middle = [ranks.quantiles(cloud, F.col(a), [0.5])[0] or 0.0 for a in "xyz"]
    far = F.sqrt(sum(((F.col(a) - m) * (F.col(a) - m) for a, m in zip("xyz", middle, strict=True)), F.lit(0.0)))
    paths: dict = {}
    for r in tracks.orderBy("robot", "t").select("robot", "x", "y", "z").collect():  # poses that carried a frame
        paths.setdefault(r["robot"], []).append([round(r[a], 3) for a in "xyz"])
    colours = dict(zip(sorted(paths), TRACK_COLOURS, strict=False))
    return {
        "res": resolution,
        "occ_idx_b64": dense["idx"],
        "occ_col_b64": dense["rgb"],
        "occ_ao_b64": dense["ao"],
        "occ_mask_b64": dense["mask"],
        "free_idx_b64": packed(free.orderBy(*maps.CELL).toPandas()[list(maps.CELL)].to_numpy(), "<i2"),
        "zmin": round(span[0] or 0.0, 2),
        "zmax": round(1.0 if span[1] is None else span[1], 2),
        "czmin": round(low, 2),
        "czmax": round(high, 2),
        "center": [round(m, 2) for m in middle],
        "radius": round(ranks.quantiles(cloud, far, [0.97])[0] or 0.0, 2),
        "trajs": [{"name": name, "color": list(colours.get(name, OTHER_COLOUR)), "pts": points} for name, points in paths.items()],
        "color_mode": "height",
        "color_label": "Voxel height (viridis)",
    }


def viewer_html(spark: SparkSession, template: str, payload: dict, title: str, subtitle: str, path: str) -> None:
    """Fill a template's marks for data, title and subtitle."""
    page = template.replace("/*__OCC_DATA__*/null", json.dumps(payload)).replace("__TITLE__", title).replace("__SUBTITLE__", subtitle)
    write_text(spark, path, page)


def height_slice(cells: DataFrame, resolution: float, low: float, high: float) -> DataFrame:
    """Cells whose centre lies in a height slice, bounds included."""
    return cells.where(((F.col("iz") + 0.5) * resolution).between(low, high))


def slice_count(cells: DataFrame, resolution: float, low: float, high: float) -> int:
    return height_slice(cells, resolution, low, high).count()


#: Keys and numbers of the front-end's settings that do not depend on the camera.
FRONT_END = (
    ("Camera.fps", "30"),
    ("Camera.RGB", "1"),
    ("loopClosing", "1"),
    ("loopCorrection", "0"),
    ("ORBextractor.nFeatures", "1500"),
    ("ORBextractor.scaleFactor", "1.2"),
    ("ORBextractor.nLevels", "8"),
    ("ORBextractor.iniThFAST", "20"),
    ("ORBextractor.minThFAST", "7"),
    ("Viewer.KeyFrameSize", "0.05"),
    ("Viewer.KeyFrameLineWidth", "1.0"),
    ("Viewer.GraphLineWidth", "0.9"),
    ("Viewer.PointSize", "2.0"),
    ("Viewer.CameraSize", "0.08"),
    ("Viewer.CameraLineWidth", "3.0"),
    ("Viewer.ViewpointX", "0.0"),
    ("Viewer.ViewpointY", "-0.7"),
    ("Viewer.ViewpointZ", "-1.8"),
    ("Viewer.ViewpointF", "500.0"),
)


def front_end_settings(calibration) -> str:
    """Settings text of the keyframe front-end for camera 0 of a ``dimensions.StereoCalibration``."""
    head = [("File.version", '"1.0"'), ("Camera.type", '"PinHole"')]
    camera = [(f"Camera1.{k}", repr(v)) for k, v in zip(("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2"), (*calibration.intrinsics[0], *calibration.distortion[0]), strict=True)]
    size = [(f"Camera.{k}", str(v)) for k, v in zip(("width", "height"), calibration.size, strict=True)]
    return "%YAML:1.0\n" + "".join(f"{k}: {v}\n" for k, v in (*head, *camera, *size, *FRONT_END))


#: Colours of a figure's series, in their order.
STROKES = ("#4477aa", "#ee6677", "#228833", "#ccbb44", "#66ccee", "#aa3377", "#bbbbbb")


def _svg(width: int, height: int, title: str, names: list[str], shapes: list[str], labels: list[tuple[float, float, str]]) -> str:
    text = lambda x, y, s: f'<text x="{x:g}" y="{y:g}" font-size="11">{html.escape(s)}</text>'
    legend = [text(width + 8, 16 + 14 * k, n).replace("<text", f'<text fill="{STROKES[k % len(STROKES)]}"') for k, n in enumerate(names)]
    frame = f'<rect width="{width}" height="{height}" fill="none" stroke="#888"/>'
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="-50 -24 {width + 200} {height + 50}">{text(0, -8, title)}{frame}{"".join(shapes)}{"".join(legend)}{"".join(text(*label) for label in labels)}</svg>'


def spans_svg(reduced: DataFrame, name: str, path: str, title: str, low: float, high: float, width: int, height: int = 240) -> None:
    """A figure of ``figures.spans`` (one column of keys, ``name``): a line a series, with every column's range."""
    rows = reduced.orderBy(name, "px").toPandas()  # at most ``width`` rows a series
    least, most = (float(rows["least"].min()), float(rows["most"].max())) if len(rows) else (0.0, 1.0)
    y = lambda v: height - (v - least) / max(most - least, 1e-12) * height
    names, shapes = [], []
    for k, (series, own) in enumerate(rows.groupby(name, sort=True)):
        names.append(str(series))
        points = " ".join(f"{x + 0.5:g},{y(v):.2f}" for x, *four in own[["px", "first", "least", "most", "last"]].itertuples(index=False) for v in four)
        shapes.append(f'<polyline fill="none" stroke="{STROKES[k % len(STROKES)]}" points="{points}"/>')
    labels = [(-46, height, f"{least:.3g}"), (-46, 10, f"{most:.3g}"), (0, height + 14, f"{low:.4g}"), (width - 30, height + 14, f"{high:.4g}")]
    write_text(reduced.sparkSession, path, _svg(width, height, title, names, shapes, labels))


def trails_svg(reduced: DataFrame, name: str, path: str, title: str, bounds: tuple[float, float, float, float], width: int, height: int) -> None:
    """A figure of ``figures.trails`` (one column of keys, ``name``): a pixel for each one visited."""
    rows = reduced.orderBy(name, "since").toPandas()  # at most width * height rows a series
    names, shapes = [], []
    for k, (series, own) in enumerate(rows.groupby(name, sort=True)):
        names.append(str(series))
        path_data = "".join(f"M{x} {height - 1 - y}h1v1h-1z" for x, y in zip(own["px"], own["py"], strict=True))
        shapes.append(f'<path fill="{STROKES[k % len(STROKES)]}" d="{path_data}"/>')
    x0, x1, y0, y1 = bounds
    labels = [(-46, height, f"{y0:.3g}"), (-46, 10, f"{y1:.3g}"), (0, height + 14, f"{x0:.3g}"), (width - 30, height + 14, f"{x1:.3g}")]
    write_text(reduced.sparkSession, path, _svg(width, height, title, names, shapes, labels))
