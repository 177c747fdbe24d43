"""Kept maps, quantiles of many groups, radius joins and figures."""

import numpy as np
from pyspark.sql import functions as F

from marram.operators import figures, ranks, voxels
from marram.operators.kept_map import KeptMap
from marram.operators.voxels import Occupancy
from marram.sources import sinks

RNG = np.random.default_rng(8)


def evidence(spark):
    rows = [(f, int(x), 0, 0, float(v)) for f in range(60) for x, v in zip(RNG.integers(0, 6, 3), RNG.normal(0.2, 1.5, 3), strict=True)]
    rows += [(f, 9, 9, 9, 1.0 if f % 3 else -2.5) for f in range(60)]
    return voxels.frame_evidence(spark.createDataFrame(rows, "frame long, ix long, iy long, iz long, value double"), ["frame"])


def values(df):
    return {(r["ix"], r["iy"], r["iz"]): round(r["l"], 9) for r in df.collect()}


def test_batches_equal_one_fold_and_last_beyond_the_session(spark, tmp_path):
    rows, c, folder = evidence(spark), Occupancy(), str(tmp_path / "map")
    want = values(voxels.clamped_fold(rows, ["ix", "iy", "iz"], "frame", "value", c))
    kept = KeptMap(spark, folder, c, buckets=3, chunk=7)
    assert kept.cells().count() == 0
    assert kept.add(rows.where("frame < 20"), 1)
    assert kept.add(rows.where("frame BETWEEN 20 AND 44"), 2)
    assert not kept.add(rows.where("frame BETWEEN 20 AND 44"), 2)
    plan = kept.cells()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    kept.compact()
    assert kept.triples().count() == kept.triples().select("ix", "iy", "iz").distinct().count()
    # A session that has not seen the map finds it in its folder.
    for t in spark.catalog.listTables():
        if t.name.startswith("kept_map_"):
            spark.sql(f"DROP TABLE {t.name}")
    again = KeptMap(spark, folder, c, buckets=3, chunk=7)
    assert again.add(rows.where("frame >= 45"), 3)
    assert values(again.cells()) == want


def test_a_cell_of_very_many_chunks_is_composed_by_levels(spark, monkeypatch):
    monkeypatch.setattr(voxels, "FAN", 3)
    rows = evidence(spark)
    want = values(voxels.clamped_fold(rows, ["ix", "iy", "iz"], "frame", "value", Occupancy()))
    assert values(voxels.clamped_fold(rows, ["ix", "iy", "iz"], "frame", "value", Occupancy(), 2)) == want


def test_quantiles_of_groups(spark):
    rows = [("a", float(v)) for v in RNG.normal(size=101)] + [("b", 3.0)] * 5 + [("c", None), ("c", None), (None, 1.0), (None, 2.0), ("d", 7.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    got = {r["k"]: (r["low"], r["q"], r["high"]) for r in ranks.grouped_quantiles(df, ["k"], F.col("v"), {"low": 0.0, "q": 0.37, "high": 1.0}).collect()}
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    for k, vs in by.items():
        known = [v for v in vs if v is not None]
        want = (min(known), float(np.quantile(known, 0.37)), max(known)) if known else (None, None, None)
        assert got[k] == want if not known else np.allclose(got[k], want)


def test_near_rows_is_strict_and_keeps_to_frames(spark):
    schema = "f int, x double, y double, z double"
    mates = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, -5.0, 0.0, 0.0), (2, 100.0, 0.0, 0.0)], schema)
    pts = [(1, 0.5, 0.0, 0.0), (1, 0.499, 0.0, 0.0), (1, -5.2, -0.3, 0.3), (2, 0.0, 0.0, 0.0), (2, 99.7, 0.0, 0.0), (1, None, 0.0, 0.0)]
    df = spark.createDataFrame(pts, schema)
    args = (["f"], ("x", "y", "z"), ("x", "y", "z"), 0.5)
    assert sorted(r["x"] for r in voxels.near_rows(df, mates, *args).collect()) == [-5.2, 0.499, 99.7]
    assert voxels.near_rows(df, mates, *args, how="left_anti").count() == 3


def test_figures_are_bounded_by_their_pixels(spark, tmp_path):
    n = 5000
    df = spark.createDataFrame([(f"s{i % 2} <&>", float(i), float(np.sin(i / 300)), float(np.cos(i / 300))) for i in range(n)], "k string, t double, x double, y double")
    spans = figures.spans(df, ["k"], "t", "x", 0.0, n - 1.0, 50)
    assert spans.count() == 100
    first = spans.where("px = 0 AND k LIKE 's0%'").first()
    inside = [np.sin(i / 300) for i in range(0, n, 2) if i / (n - 1) * 50 < 1]
    assert np.allclose([first["least"], first["most"], first["first"], first["last"]], [min(inside), max(inside), inside[0], inside[-1]])
    trails = figures.trails(df, ["k"], "t", "x", "y", (-1.0, 1.0, -1.0, 1.0), 20, 20)
    assert trails.count() <= 800 and trails.agg(F.max("px")).first()[0] == 19
    sinks.spans_svg(spans, "k", str(tmp_path / "a.svg"), "a & b", 0.0, n - 1.0, 50)
    sinks.trails_svg(trails, "k", str(tmp_path / "b.svg"), "tracks", (-1.0, 1.0, -1.0, 1.0), 20, 20)
    from xml.etree import ElementTree

    assert len(ElementTree.parse(tmp_path / "a.svg").getroot().findall("{*}polyline")) == 2
    assert len(ElementTree.parse(tmp_path / "b.svg").getroot().findall("{*}path")) == 2
