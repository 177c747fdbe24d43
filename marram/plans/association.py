"""Queries: time association, cleaning and selection of sensor rows. Events stand for a sensor log: the user is the entity, the type the sensor."""

from __future__ import annotations

from pyspark.sql import functions as F

from marram.operators import cleaning
from marram.operators.asof import nearest_asof, nearest_to_first
from marram.plans.registry import DAY, HOUR, events, of_type, points, query, r6, table
from marram.sources import logs

_KINDS = "p AS (SELECT user_id, event_id, value, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, event_id, value, epoch_us(ts) AS t FROM events WHERE event_type = '{}')"


def _nearest(kind: str, tolerance: int | None) -> str:
    bound = f"AND gap <= {tolerance}" if tolerance else ""
    return f"""
    WITH {_KINDS.format(kind)}
    SELECT user_id, event_id, other_id, gap FROM (
        SELECT p.user_id, p.event_id, v.event_id AS other_id, abs(p.t - v.t) AS gap,
               row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.t - v.t), v.t, v.event_id) AS n
        FROM p JOIN v USING (user_id)) WHERE n = 1 {bound}"""


def _asof(spark, sf_dir, kind, tolerance, slot):
    e = events(spark, sf_dir)
    right = of_type(e, kind).select("user_id", F.col("t").alias("rt"), F.col("event_id").alias("other_id"))
    out = nearest_asof(of_type(e, "purchase").select("user_id", "event_id", "t"), right, ["user_id"], "t", "rt", ["other_id"], tolerance, slot, "other_id")
    return out.select("user_id", "event_id", "other_id", "gap")


@query(_nearest("view", 6 * HOUR))
def asof_nearest_tol(spark, sf_dir):
    return _asof(spark, sf_dir, "view", 6 * HOUR, DAY)


@query(_nearest("error", None))
def asof_nearest_notol(spark, sf_dir):
    return _asof(spark, sf_dir, "error", None, 2 * DAY)


@query(f"""
WITH p AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'),
a AS (SELECT * FROM (SELECT p.*, v.value AS va, abs(p.t - epoch_us(v.ts)) AS ga,
      row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.t - epoch_us(v.ts)), v.ts, v.event_id) AS n
      FROM p JOIN events v ON p.user_id = v.user_id AND v.event_type = 'view') WHERE n = 1 AND ga <= {12 * HOUR}),
b AS (SELECT * FROM (SELECT p.event_id, v.value AS vb, abs(p.t - epoch_us(v.ts)) AS gb,
      row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.t - epoch_us(v.ts)), v.ts, v.event_id) AS n
      FROM p JOIN events v ON p.user_id = v.user_id AND v.event_type = 'click') WHERE n = 1 AND gb <= {12 * HOUR})
SELECT a.event_id, ga, gb, round(sqrt(0.3 * 0.3 + (va * (ga / 1e12)) * (va * (ga / 1e12)) + (vb * (gb / 1e12)) * (vb * (gb / 1e12))), 6) AS sigma
FROM a JOIN b ON a.event_id = b.event_id""")
def asof_two_endpoints(spark, sf_dir):
    e = events(spark, sf_dir)
    side = lambda kind, v: of_type(e, kind).select("user_id", F.col("t").alias("rt"), F.col("value").alias(v), F.col("event_id").alias("o"))
    left = of_type(e, "purchase").select("user_id", "event_id", "t")
    a = nearest_asof(left, side("view", "va"), ["user_id"], "t", "rt", ["va"], 12 * HOUR, DAY, "o").withColumnRenamed("gap", "ga").drop("matched_on")
    b = nearest_asof(a, side("click", "vb"), ["user_id"], "t", "rt", ["vb"], 12 * HOUR, DAY, "o").withColumnRenamed("gap", "gb")
    slips = [F.col("va") * (F.col("ga") / 1e12), F.col("vb") * (F.col("gb") / 1e12)]
    return b.select("event_id", "ga", "gb", r6(cleaning.with_motion(F.lit(0.3), *slips)).alias("sigma"))


@query(f"""
WITH p AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase')
SELECT event_id, kind, other_id, gap FROM (
    SELECT p.event_id, v.event_type AS kind, v.event_id AS other_id, abs(p.t - epoch_us(v.ts)) AS gap,
           row_number() OVER (PARTITION BY p.event_id, v.event_type ORDER BY abs(p.t - epoch_us(v.ts)), v.ts, v.event_id) AS n
    FROM p JOIN events v ON p.user_id = v.user_id AND v.event_type <> 'purchase') WHERE n = 1 AND gap <= {3 * HOUR}""")
def asof_many_tracks(spark, sf_dir):
    e = events(spark, sf_dir)
    kinds = ["view", "signup", "click", "error"]
    left = of_type(e, "purchase").select("user_id", "event_id", "t", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    right = e.where(F.col("event_type") != "purchase").select("user_id", F.col("event_type").alias("kind"), F.col("t").alias("rt"), F.col("event_id").alias("other_id"))
    return nearest_asof(left, right, ["user_id", "kind"], "t", "rt", ["other_id"], 3 * HOUR, DAY, "other_id").select("event_id", "kind", "other_id", "gap")


@query(f"""
WITH {_KINDS.format("view")}, f AS (SELECT user_id, min(t) AS t, arg_min(value, t) AS value FROM p GROUP BY user_id)
SELECT f.user_id, round(arg_min(v.value, (abs(f.t - v.t), v.t)) - any_value(f.value), 6) AS offset_value, min(abs(f.t - v.t)) AS gap
FROM f JOIN v USING (user_id) GROUP BY f.user_id""")
def first_pose_offset(spark, sf_dir):
    e = events(spark, sf_dir)
    right = of_type(e, "view").select("user_id", F.col("t").alias("rt"), F.col("value").alias("other"))
    hit = nearest_to_first(of_type(e, "purchase"), right, ["user_id"], "t", "rt", ["value"], ["other"])
    return hit.select("user_id", r6(F.col("other") - F.col("value")).alias("offset_value"), "gap")


@query("""
WITH u AS (SELECT event_id, user_id, value / 50 AS std, 0 AS part FROM events WHERE event_id < 6000
           UNION ALL SELECT event_id, user_id, value / 80, 1 FROM events WHERE event_id >= 4000),
k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY part, std) AS n FROM u)
SELECT event_id, std, CASE WHEN user_id % 20 < 10 THEN 'anchor' ELSE 'inter' END AS kind,
       CASE WHEN user_id >= 10 THEN 'ifo00' || (user_id // 10) END AS robot
FROM k WHERE n = 1 AND std <= 0.5""")
def union_dedup_filter(spark, sf_dir):
    e = events(spark, sf_dir)
    first = e.where("event_id < 6000").select("event_id", "user_id", (F.col("value") / 50).alias("std"))
    second = e.where("event_id >= 4000").select("event_id", "user_id", (F.col("value") / 80).alias("std"))
    kept = cleaning.union_ranges([first, second], ["event_id"], "std", 0.5)
    return kept.select("event_id", "std", cleaning.range_kind(F.col("user_id") % 20).alias("kind"), cleaning.robot_of_tag(F.col("user_id")).alias("robot"))


@query("""
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events) WHERE n % 5 = 0""")
def stride_sample(spark, sf_dir):
    return cleaning.every_kth(events(spark, sf_dir), 5, ["user_id"], ["t", "event_id"]).select("user_id", "event_id")


@query(f"""
WITH p AS (SELECT * FROM (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k
      FROM events WHERE event_type = 'purchase') WHERE k % 3 = 0)
SELECT event_id, other_id FROM (
    SELECT p.event_id, v.event_id AS other_id, abs(p.t - epoch_us(v.ts)) AS gap,
           row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.t - epoch_us(v.ts)), v.ts, v.event_id) AS n
    FROM p JOIN events v ON p.user_id = v.user_id AND v.event_type = 'view') WHERE n = 1 AND gap <= {6 * HOUR}""")
def raw_subsample(spark, sf_dir):
    e = events(spark, sf_dir)
    raw = cleaning.every_kth(of_type(e, "purchase"), 3, ["user_id"], ["t", "event_id"]).select("user_id", "event_id", "t")
    right = of_type(e, "view").select("user_id", F.col("t").alias("rt"), F.col("event_id").alias("other_id"))
    return nearest_asof(raw, right, ["user_id"], "t", "rt", ["other_id"], 6 * HOUR, DAY, "other_id").select("event_id", "other_id")


@query("""
SELECT label, count(*) AS n, count(*) FILTER (gap) AS dropped FROM (
    SELECT label, sqrt(e[1]::DOUBLE * e[1]::DOUBLE + e[2]::DOUBLE * e[2]::DOUBLE + e[3]::DOUBLE * e[3]::DOUBLE) < 0.15
        OR sqrt(e[4]::DOUBLE * e[4]::DOUBLE + e[5]::DOUBLE * e[5]::DOUBLE + e[6]::DOUBLE * e[6]::DOUBLE + e[7]::DOUBLE * e[7]::DOUBLE) < 0.15 AS gap
    FROM (SELECT label, embedding AS e FROM embeddings)) GROUP BY label""")
def gap_filter(spark, sf_dir):
    p = points(spark, sf_dir, ["x", "y", "z", "qx", "qy", "qz", "qw"])
    gap = cleaning.is_gap(["x", "y", "z"], ["qx", "qy", "qz", "qw"], 0.15)
    return p.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(gap).alias("dropped"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT user_id, n, v AS good, false AS bad FROM e WHERE n = 1
      UNION ALL SELECT e.user_id, e.n, CASE WHEN abs(e.v - r.good) > 60 THEN r.good ELSE e.v END, abs(e.v - r.good) > 60
      FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT e.user_id, e.event_id FROM e JOIN r ON e.user_id = r.user_id AND e.n = r.n
LEFT JOIN r s ON s.user_id = r.user_id AND s.n = r.n + 1 WHERE r.bad OR coalesce(s.bad, false)""")
def outlier_state_machine(spark, sf_dir):
    return cleaning.jump_outliers(events(spark, sf_dir), ["user_id"], "event_id", "value", 60.0).where("flagged").select("user_id", "event_id")


@query("""
WITH d AS (SELECT label, vec_id, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
n AS (SELECT label, vec_id, CASE WHEN e[1]::DOUBLE * b[1]::DOUBLE + e[2]::DOUBLE * b[2]::DOUBLE + e[3]::DOUBLE * b[3]::DOUBLE + e[4]::DOUBLE * b[4]::DOUBLE < 0 THEN 1 ELSE 0 END AS neg FROM d)
SELECT label, vec_id, CASE WHEN sum(neg) OVER (PARTITION BY label ORDER BY vec_id) % 2 = 0 THEN 1 ELSE -1 END AS sign FROM n""")
def sign_continuity(spark, sf_dir):
    p = points(spark, sf_dir, ["qx", "qy", "qz", "qw"])
    return cleaning.continuous_signs(p, ["label"], "vec_id", ["qx", "qy", "qz", "qw"]).select("label", "vec_id", "sign")


@query("""
SELECT event_id, round(CASE WHEN user_id % 2 = 0 THEN value / 41 ELSE value / 40 - 0.14 END, 9) + 0.0 AS z,
       round(sqrt(greatest(value / 200, 0.3) * greatest(value / 200, 0.3) + 0.01 * 0.01), 9) AS sigma FROM events""")
def sigma_select(spark, sf_dir):
    e = events(spark, sf_dir).withColumns({"gt_range": F.col("value") / 41, "range": F.col("value") / 40})
    none = F.lit(None).cast("double")
    true, measured = cleaning.measured_range(none, True, False, 0.14, False), cleaning.measured_range(none, False, True, 0.14, False)
    z = F.when(F.col("user_id") % 2 == 0, true).otherwise(measured)
    sigma = cleaning.with_motion(cleaning.measured_sigma(F.col("value") / 200, 0.3), F.lit(0.01))
    return e.select("event_id", (F.round(z, 9) + 0.0).alias("z"), F.round(sigma, 9).alias("sigma"))


_UNIFORM = "('0x' || substr(md5(event_id::VARCHAR || '|{}'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"


@query(f"""
SELECT event_id, round(value / 40 + CASE WHEN kind = 'anchor' THEN 0.0871 ELSE 0.0035 END
    + 0.2 * sqrt(-2.0 * ln(1.0 - {_UNIFORM.format("r")})) * cos(2.0 * pi() * (1.0 - 1.0 + {_UNIFORM.format("a")}))
    + CASE WHEN {_UNIFORM.format("o")} < CASE WHEN kind = 'anchor' THEN 0.0861 ELSE 0.0217 END THEN 0.5 + 1.3 * ({_UNIFORM.format("s")}) ELSE 0.0 END, 6) AS z
FROM (SELECT *, CASE WHEN user_id % 20 < 10 THEN 'anchor' ELSE 'inter' END AS kind FROM events)""")
def noise_injection(spark, sf_dir):
    e = events(spark, sf_dir)
    z = cleaning.injected_range(F.col("value") / 40, cleaning.range_kind(F.col("user_id") % 20), F.col("event_id").cast("string"), 0.2)
    return e.select("event_id", r6(z).alias("z"))


@query("""
SELECT minute FROM (SELECT date_trunc('minute', ts)::VARCHAR AS minute FROM events WHERE event_type = 'view'
INTERSECT SELECT date_trunc('minute', ts)::VARCHAR FROM events WHERE event_type = 'click')""")
def common_stems(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("minute", F.date_format("ts", "yyyy-MM-dd HH:mm:00"))
    return of_type(e, "view").select("minute").intersect(of_type(e, "click").select("minute"))


def _spline(unit: float, smooth: float, digits: int) -> str:
    """Reinsch's five diagonals eliminated forwards and put back backwards, a row at a time."""
    lam = f"{(1 - smooth) / smooth!r}::DOUBLE"
    return f"""WITH RECURSIVE knot AS (
    SELECT user_id AS u, t, min(value) AS y, count(*) AS times, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k FROM (SELECT user_id, epoch_us(ts) / {unit!r}::DOUBLE AS t, value FROM events) GROUP BY user_id, t
), step AS (
    SELECT u, k, lead(t) OVER w - t AS h, lead(t, 2) OVER w - lead(t) OVER w AS i, y, lead(y) OVER w AS y1, lead(y, 2) OVER w AS y2 FROM knot WINDOW w AS (PARTITION BY u ORDER BY k)
), q AS (SELECT u, k, h, i, 1 / h AS p, -1 / h - 1 / i AS q, 1 / i AS r, y, y1, y2 FROM step WHERE i IS NOT NULL),
c AS (
    SELECT u, k, p, q, r, (h + i) / 3 + {lam} * (p * p + q * q + r * r) AS a, coalesce(i / 6 + {lam} * (q * lead(p) OVER w + r * lead(q) OVER w), 0) AS b, coalesce({lam} * r * lead(p, 2) OVER w, 0) AS c, p * y + q * y1 + r * y2 AS f, lead(k) OVER w IS NULL AS final
    FROM q WINDOW w AS (PARTITION BY u ORDER BY k)
), down AS (
    SELECT u, k, a AS d, b / a AS l, c / a AS m, f AS z, 0.0::DOUBLE AS pd, 0.0::DOUBLE AS pm, 0.0::DOUBLE AS pz FROM c WHERE k = 1
    UNION ALL
    SELECT u, k, d, (b - was_d * was_l * was_m) / d, c / d, z, was_d, was_m, was_z
    FROM (SELECT c.u, c.k, c.b, c.c, c.a - o.d * o.l * o.l - o.pd * o.pm * o.pm AS d, c.f - o.l * o.z - o.pm * o.pz AS z, o.d AS was_d, o.l AS was_l, o.m AS was_m, o.z AS was_z FROM down o JOIN c ON c.u = o.u AND c.k = o.k + 1)
), up AS (
    SELECT down.u, down.k, z / d AS g, 0.0::DOUBLE AS pg FROM down JOIN c ON c.u = down.u AND c.k = down.k WHERE final
    UNION ALL
    SELECT n.u, n.k, n.z / n.d - n.l * o.g - n.m * o.pg, o.g FROM up o JOIN down n ON n.u = o.u AND n.k = o.k - 1
), back AS (
    SELECT u, k, sum(v) AS v FROM (
        SELECT u, k, p * g AS v FROM up JOIN c USING (u, k) UNION ALL SELECT u, k + 1, q * g FROM up JOIN c USING (u, k) UNION ALL SELECT u, k + 2, r * g FROM up JOIN c USING (u, k)) GROUP BY u, k
)
SELECT knot.u AS user_id, t, round(y - {lam} * coalesce(v, 0), {digits}) AS value FROM knot LEFT JOIN back USING (u, k), LATERAL (SELECT unnest(range(times)))"""


def _smooth_values(spark, sf_dir, unit: float, smooth: float, digits: int):
    e = events(spark, sf_dir).select("user_id", (F.col("t") / unit).alias("t"), "value")
    return cleaning.smoothed(e, ["user_id"], "t", ["value"], smooth).select("user_id", "t", F.round("value", digits).alias("value"))


@query(_spline(1e6, 0.9999, 6))
def smoothing_spline(spark, sf_dir):
    return _smooth_values(spark, sf_dir, 1e6, 0.9999, 6)


@query(_spline(8.64e10, 0.7, 4))
def stiff_spline(spark, sf_dir):
    """Time in days, where the second derivative weighs about as much as the values; times that lie seconds apart cost the last digits."""
    return _smooth_values(spark, sf_dir, 8.64e10, 0.7, 4)


@query("""
WITH RECURSIVE u AS (SELECT label, vec_id, embedding[1]::DOUBLE / n AS a, embedding[2]::DOUBLE / n AS b, embedding[3]::DOUBLE / n AS c, embedding[4]::DOUBLE / n AS d, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k
    FROM (SELECT *, sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2 + embedding[3]::DOUBLE ** 2 + embedding[4]::DOUBLE ** 2) AS n FROM embeddings)),
r AS (SELECT label, k, a AS ga, b AS gb, c AS gc, d AS gd, false AS bad FROM u WHERE k = 1
    UNION ALL SELECT label, k, CASE WHEN bad THEN ga ELSE a END, CASE WHEN bad THEN gb ELSE b END, CASE WHEN bad THEN gc ELSE c END, CASE WHEN bad THEN gd ELSE d END, bad
    FROM (SELECT u.*, r.ga, r.gb, r.gc, r.gd, 2 * acos(least(1.0, abs(u.a * r.ga + u.b * r.gb + u.c * r.gc + u.d * r.gd))) > 1.0 AS bad FROM r JOIN u ON u.label = r.label AND u.k = r.k + 1))
SELECT u.label, u.vec_id FROM u JOIN r ON u.label = r.label AND u.k = r.k LEFT JOIN r s ON s.label = r.label AND s.k = r.k + 1 WHERE r.bad OR coalesce(s.bad, false)""")
def rotation_outliers(spark, sf_dir):
    quat = ["qx", "qy", "qz", "qw"]
    return cleaning.rotation_outliers(points(spark, sf_dir, quat), ["label"], "vec_id", quat).where("flagged").select("label", "vec_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS n FROM events) WHERE n % 9 = 0")
def raw_subsample_all(spark, sf_dir):
    """Every ninth row of the whole log, ranked range by range."""
    return cleaning.every_kth(events(spark, sf_dir), 9, [], ["t", "event_id"]).select("event_id")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3")
def first_frames(spark, sf_dir):
    return cleaning.first_rows(events(spark, sf_dir), 3, ["user_id"], ["t", "event_id"]).select("user_id", "event_id")


@query(f"""
WITH k AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'),
f AS (SELECT DISTINCT epoch_us(date_trunc('minute', ts)) AS t, strftime(date_trunc('minute', ts), '%Y%m%d%H%M') AS name FROM events WHERE event_type = 'view'
      INTERSECT SELECT epoch_us(date_trunc('minute', ts)), strftime(date_trunc('minute', ts), '%Y%m%d%H%M') FROM events WHERE event_type = 'click'),
p AS (SELECT k.event_id, 'l/' || (f.t // 1000000) || '.jpeg' AS left_path, 'r/' || (f.t // 1000000) || '.jpeg' AS right_path, abs(k.t - f.t) AS gap, f.t AS ft FROM k, f WHERE abs(k.t - f.t) <= {12 * HOUR})
SELECT event_id, left_path, right_path FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap, ft) AS n FROM p) WHERE n = 1""")
def frame_index(spark, sf_dir):
    """Keyframes with the stereo pair nearest in time, told by the stems that both folders have."""
    e = events(spark, sf_dir)
    listing = lambda kind, folder: of_type(e, kind).select(F.concat(F.lit(folder + "/"), (F.floor(F.col("t") / 60_000_000) * 60).cast("string"), F.lit(".jpeg")).alias("path")).distinct()
    keyframes = of_type(e, "purchase").select("event_id", (F.col("t") / 1e6).alias("t"))
    met = logs.nearest_frames(keyframes, listing("view", "l"), listing("click", "r"), 12 * 3600.0)
    return met.select("event_id", "left_path", "right_path")
