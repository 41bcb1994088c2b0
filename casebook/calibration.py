"""Calibration jobs: lineitem rows as calibration points, supplier = calibration, line number = view."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook import case
from casebook.motion import r
from casebook.views import VEC, table, vectors
from surveykit.operators import calibration as c

PT = """pt AS (SELECT l_suppkey AS calib_id, l_linenumber AS view, l_discount * 10 - 0.5 AS dx, l_tax * 10 - 0.4 AS dy, (l_quantity - 25) / 20.0 AS dy_rect FROM lineitem)"""


def points(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("calib_id"),
        F.col("l_linenumber").alias("view"),
        (F.col("l_discount") * 10 - 0.5).alias("dx"),
        (F.col("l_tax") * 10 - 0.4).alias("dy"),
        ((F.col("l_quantity") - 25) / 20.0).alias("dy_rect"),
    )


@case("agg_calib_residual", f"""WITH {PT}, v AS (SELECT calib_id, view, sqrt(avg(dx*dx+dy*dy)) AS a, sqrt(avg(dy_rect*dy_rect)) AS b, count(*) AS points FROM pt GROUP BY ALL),
  e AS (SELECT calib_id, sqrt(avg(dy_rect*dy_rect)) AS x, quantile_cont(abs(dy_rect), 0.95) AS y FROM pt GROUP BY ALL)
  SELECT calib_id, view, round(a, 6) AS reproj_rms, round(b, 6) AS epi_rms, points, round(x, 6) AS epipolar_rms, round(y, 6) AS epipolar_p95 FROM v JOIN e USING (calib_id)""")
def agg_calib_residual(spark, sf):
    p = points(spark, sf)
    out = c.view_residuals(p, ["calib_id"]).join(c.epipolar_summary(p, ["calib_id"]), "calib_id")
    for n in ("reproj_rms", "epi_rms", "epipolar_rms", "epipolar_p95"):
        out = out.withColumn(n, r(n))
    return out


@case("agg_calib_outlier", """WITH s AS (SELECT l_suppkey % 50 AS calib_id, l_partkey AS view, greatest(max(l_quantity) / 50, max(l_discount) * 8, max(l_tax) * 10) AS score FROM lineitem GROUP BY ALL),
  m AS (SELECT calib_id, quantile_cont(score, 0.5) AS med FROM s GROUP BY ALL), d AS (SELECT calib_id, quantile_cont(abs(score - med), 0.5) AS mad FROM s JOIN m USING (calib_id) GROUP BY ALL),
  w AS (SELECT calib_id, view, score FROM s QUALIFY row_number() OVER (PARTITION BY calib_id ORDER BY score DESC, view) = 1)
  SELECT calib_id, round(greatest(1.0, med + 3 * 1.4826 * mad), 6) AS "limit", round(score, 6) AS worst_score, CASE WHEN score > greatest(1.0, med + 3 * 1.4826 * mad) THEN view END AS outlier
  FROM w JOIN m USING (calib_id) JOIN d USING (calib_id)""")
def agg_calib_outlier(spark, sf):
    v = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("calib_id"), F.col("l_partkey").alias("view")).agg(
        (F.max("l_quantity") / 50).alias("left_rms"), (F.max("l_discount") * 8).alias("right_rms"), (F.max("l_tax") * 10).alias("epi_rms"))
    out = c.outlier_view(v, ["calib_id"])
    return out.withColumn("limit", r("limit")).withColumn("worst_score", r("worst_score"))


@case("agg_pose_spread", f"""WITH {VEC}, u AS (SELECT vec_id % 10 AS calib_id, vec_id, e[1]/n AS x, e[2]/n AS y, (e[3] + 0.3)/n AS z FROM
    (SELECT *, sqrt(e[1]*e[1]+e[2]*e[2]+(e[3]+0.3)*(e[3]+0.3)) AS n FROM vec))
  SELECT a.calib_id, round(degrees(acos(greatest(-1, least(1, min(a.x*b.x+a.y*b.y+a.z*b.z))))), 5) AS pose_spread_deg FROM u a JOIN u b ON a.calib_id = b.calib_id AND a.vec_id < b.vec_id GROUP BY ALL""")
def agg_pose_spread(spark, sf):
    e = lambda i: F.element_at("e", i)
    n = vectors(spark, sf).select((F.col("vec_id") % 10).alias("calib_id"), e(1).alias("nx"), e(2).alias("ny"), (e(3) + 0.3).alias("nz"))
    return c.pose_spread(n, ["calib_id"]).withColumn("pose_spread_deg", r("pose_spread_deg", 5))


@case("agg_loo_summary", """SELECT s_nationkey AS calib_id, count(*) AS drops, min(s_acctbal) AS focal_min, max(s_acctbal) AS focal_max, bool_and(s_acctbal > 100) AS all_passed, max(s_acctbal / 7) AS rms_max FROM supplier GROUP BY ALL""")
def agg_loo_summary(spark, sf):
    d = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("calib_id"), F.col("s_acctbal").alias("focal"), (F.col("s_acctbal") > 100).alias("passed"), (F.col("s_acctbal") / 7).alias("rms"))
    return c.loo_summary(d, ["calib_id"])


@case("chk_calibration", f"""WITH {VEC} SELECT vec_id, concat_ws(',', CASE WHEN 20 + e[1]*10 < 20 THEN 'views' END, CASE WHEN 0.9 + e[2] > 1.0 THEN 'left_rms' END, CASE WHEN 0.06 + e[3]/10 NOT BETWEEN 0.045 AND 0.075 THEN 'baseline' END,
  CASE WHEN e[4] * 100 > 10 THEN 'rotation' END, CASE WHEN 10 + e[5]*10 < 10 THEN 'pose_spread' END, CASE WHEN abs((400 + e[6]*1000) - 400) / greatest(1e-9, abs(400 + e[6]*1000 + 400) * 0.5) > 0.25 THEN 'focal_fx' END) AS reasons FROM vec""")
def chk_calibration(spark, sf):
    e = lambda i: F.element_at("e", i)
    arr = lambda *xs: F.array(*[x if not isinstance(x, (int, float)) else F.lit(float(x)) for x in xs])
    fx = F.lit(400.0) + e(6) * 1000
    limits = {**c.LIMITS, "focal_lo": -100.0, "focal_hi": 100.0}
    rep = vectors(spark, sf).select(
        "vec_id", (20 + e(1) * 10).alias("views_used"), (0.9 + e(2)).alias("left_rms"), F.lit(0.5).alias("right_rms"), F.lit(0.5).alias("stereo_rms"),
        F.lit(0.5).alias("epipolar_rms"), F.lit(0.5).alias("epipolar_p95"), (0.06 + e(3) / 10).alias("baseline_m"), F.lit(0.06).alias("translation_norm_m"),
        (e(4) * 100).alias("rotation_deg"), (10 + e(5) * 10).alias("pose_spread_deg"), F.lit(640).alias("width"), F.lit(480).alias("height"),
        arr(fx, 0, 320, 0, 400, 240, 0, 0, 1).alias("k1"), arr(400, 0, 320, 0, 400, 240, 0, 0, 1).alias("k2"),
        arr(400, 0, 320, 0, 0, 400, 240, 0, 0, 0, 1, 0).alias("p1"), arr(400, 0, 320, -24, 0, 400, 240, 0, 0, 0, 1, 0).alias("p2"))
    return c.quality(rep, ["vec_id"], limits).select("vec_id", "reasons")


@case("chk_calib_file", f"WITH {VEC} SELECT vec_id, CASE WHEN vec_id % 7 = 1 THEN 'camera_name' WHEN vec_id % 5 = 2 THEN 'size' WHEN abs(e[1]) > 0.1 THEN 'rectification_finite' WHEN vec_id % 3 = 0 THEN 'model' ELSE 'ok' END AS reason FROM vec")
def chk_calib_file(spark, sf):
    e1 = F.element_at("e", 1)
    m = lambda rows, cols, first: F.struct(F.lit(rows).alias("rows"), F.lit(cols).alias("cols"), F.concat(F.array(first), F.array_repeat(F.lit(1.0), rows * cols - 1)).alias("data"))
    v = F.col("vec_id")
    f = vectors(spark, sf).select(
        "vec_id", F.when(v % 7 == 1, "other").otherwise("left").alias("camera_name"), F.when(v % 5 == 2, 320).otherwise(640).alias("width"), F.lit(480).alias("height"),
        m(3, 3, F.lit(1.0)).alias("camera_matrix"), m(3, 3, F.when(F.abs(e1) > 0.1, float("nan")).otherwise(1.0)).alias("rectification"), m(3, 4, F.lit(1.0)).alias("projection"),
        F.struct(F.lit(1).alias("rows"), F.lit(5).alias("cols"), F.array_repeat(F.lit(0.0), 5).alias("data")).alias("distortion"),
        F.when(v % 3 == 0, "fisheye").otherwise("plumb_bob").alias("model"))
    return c.calibration_file(f, ["vec_id"], "left", 640, 480)


@case("chk_samples", """WITH s AS (SELECT l_orderkey AS run_id, l_linenumber AS i, l_quantity FROM lineitem), g AS (SELECT run_id, count(*) AS n, count(DISTINCT i) AS d, min(i) AS lo, max(i) AS hi, bool_or(l_quantity = 7) AS bad FROM s GROUP BY ALL)
  SELECT run_id, CASE WHEN NOT (lo = 1 AND hi = n AND d = n) THEN 'index' WHEN bad THEN 'board' ELSE 'ok' END AS reason FROM g""")
def chk_samples(spark, sf):
    pts = F.expr("transform(sequence(0, 5), i -> named_struct('x', (i % 3) * 0.02D, 'y', floor(i / 3) * 0.02D, 'z', 0D))")
    flat = F.array_repeat(F.lit(1.0), 6)
    s = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("sample_index"), F.when(F.col("l_quantity") == 7, 4).otherwise(3).alias("board_columns"), F.lit(2).alias("board_rows"),
        F.lit(0.02).alias("square_size"), F.lit(640).alias("width"), F.lit(480).alias("height"), pts.alias("object_points"), flat.alias("left_points"), flat.alias("right_points"))
    return c.samples(s, ["run_id"], 3, 2, 0.02, 640, 480)
