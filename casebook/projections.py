"""Scalar, array and string rules on vectors, scans and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook import case
from casebook.motion import r
from casebook.views import BOX, LOG, SCAN, VEC, boxes, iou_sql, log, scans, table, vectors
from surveykit.functions import boxes as bx, geometry as g, scans as sc, text as tx

PI = "3.141592653589793::DOUBLE"


def e(i):
    return F.element_at("e", i)


QUAT = VEC + """, q AS (SELECT vec_id, e, sqrt(e[1]*e[1]+e[2]*e[2]+e[3]*e[3]+e[4]*e[4]) AS n FROM vec),
  u AS (SELECT vec_id, e, e[1]/n AS x, e[2]/n AS y, e[3]/n AS z, e[4]/n AS w, e[5] AS a, e[6] AS b, e[7] AS c FROM q)"""
# v' = v + 2w(q x v) + 2 q x (q x v), written out for a vector (a, b, c)
ROT = """, t AS (SELECT *, 2*(y*c - z*b) AS tx, 2*(z*a - x*c) AS ty, 2*(x*b - y*a) AS tz FROM u),
  rot AS (SELECT *, a + w*tx + y*tz - z*ty AS ra, b + w*ty + z*tx - x*tz AS rb, c + w*tz + x*ty - y*tx AS rc FROM t)"""


def quats(spark, sf):
    v = vectors(spark, sf)
    x, y, z, w = g.unit_quat(e(1), e(2), e(3), e(4))
    return v.select("vec_id", "e", x.alias("x"), y.alias("y"), z.alias("z"), w.alias("w"))


Q = ["x", "y", "z", "w"]


def q():
    return [F.col(c) for c in Q]


@case("quat_yaw", f"""WITH {QUAT} SELECT vec_id, round(atan2(2*(w*z+x*y), 1-2*(y*y+z*z)), 6) AS yaw, round(atan2(2*w*z, 1-2*z*z), 6) AS planar FROM u""")
def quat_yaw(spark, sf):
    return quats(spark, sf).select("vec_id", r(g.quat_yaw(*q())).alias("yaw"), r(g.planar_yaw(F.col("z"), F.col("w"))).alias("planar"))


@case("angle_delta", f"WITH {VEC} SELECT vec_id, round(atan2(sin(e[1]*40-e[2]*40), cos(e[1]*40-e[2]*40)), 6) AS d FROM vec")
def angle_delta(spark, sf):
    return vectors(spark, sf).select("vec_id", r(g.angle_delta(e(1) * 40, e(2) * 40)).alias("d"))


@case("wrap_angle", f"WITH {VEC} SELECT vec_id, round(atan2(sin(e[1]*100), cos(e[1]*100)), 6) AS wrapped FROM vec")
def wrap_angle(spark, sf):
    return vectors(spark, sf).select("vec_id", r(g.wrap_angle(e(1) * 100)).alias("wrapped"))


@case("transform_xyz", f"WITH {QUAT} {ROT} SELECT vec_id, round(ra + e[8], 6) AS px, round(rb + e[9], 6) AS py, round(rc + e[10], 6) AS pz FROM rot")
def transform_xyz(spark, sf):
    p = g.transform_xyz([e(8), e(9), e(10)], q(), [e(5), e(6), e(7)])
    return quats(spark, sf).select("vec_id", *[r(c).alias(n) for c, n in zip(p, ("px", "py", "pz"))])


@case("compose_pose2d", f"""WITH {VEC} SELECT vec_id, round(e[1] + cos(e[3])*e[4] - sin(e[3])*e[5], 6) AS x, round(e[2] + sin(e[3])*e[4] + cos(e[3])*e[5], 6) AS y,
  round(atan2(sin(e[3]+e[6]), cos(e[3]+e[6])), 6) AS yaw FROM vec""")
def compose_pose2d(spark, sf):
    p = g.compose_pose2d([e(1), e(2), e(3)], [e(4), e(5), e(6)])
    return vectors(spark, sf).select("vec_id", *[r(c).alias(n) for c, n in zip(p, ("x", "y", "yaw"))])


@case("mount_quat", f"""WITH {VEC}, h AS (SELECT vec_id, cos(e[1]/2) AS cy, sin(e[1]/2) AS sy, cos(e[2]/2) AS cp, sin(e[2]/2) AS sp, cos(e[3]/2) AS cr, sin(e[3]/2) AS sr FROM vec)
  SELECT vec_id, round(sr*cp*cy-cr*sp*sy, 6) AS qx, round(cr*sp*cy+sr*cp*sy, 6) AS qy, round(cr*cp*sy-sr*sp*cy, 6) AS qz, round(cr*cp*cy+sr*sp*sy, 6) AS qw FROM h""")
def mount_quat(spark, sf):
    m = g.mount_quat(e(1), e(2), e(3))
    return vectors(spark, sf).select("vec_id", *[r(c).alias(n) for c, n in zip(m, ("qx", "qy", "qz", "qw"))])


@case("laser_azimuth", f"""WITH {QUAT.replace('e[5] AS a, e[6] AS b, e[7] AS c', 'sin(-e[8]) AS a, 0.0::DOUBLE AS b, cos(-e[8]) AS c')} {ROT}
  SELECT vec_id, round(atan2(rb, ra), 6) AS azimuth FROM rot""")
def laser_azimuth(spark, sf):
    return quats(spark, sf).select("vec_id", r(g.laser_azimuth(q(), e(8))).alias("azimuth"))


@case("rotation_angle_deg", f"WITH {VEC} SELECT vec_id, round(degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ((1+e[1])+(1+e[5])+(1+e[9])-1)/2)))), 6) AS angle FROM vec")
def rotation_angle_deg(spark, sf):
    m = F.array(*[e(i) + (1.0 if i in (1, 5, 9) else 0.0) for i in range(1, 10)])
    return vectors(spark, sf).select("vec_id", r(g.rotation_angle_deg(m)).alias("angle"))


DET = "((1+e[1])*((1+e[5])*(1+e[9])-e[6]*e[8]) - e[2]*(e[4]*(1+e[9])-e[6]*e[7]) + e[3]*(e[4]*e[8]-(1+e[5])*e[7]))"


@case("mat3_det", f"WITH {VEC} SELECT vec_id, round({DET}, 6) AS det, {DET} > 0.5 AND {DET} < 1.5 AS ok FROM vec")
def mat3_det(spark, sf):
    d = g.mat3_det(F.array(*[e(i) + (1.0 if i in (1, 5, 9) else 0.0) for i in range(1, 10)]))
    return vectors(spark, sf).select("vec_id", r(d).alias("det"), ((d > 0.5) & (d < 1.5)).alias("ok"))


def _step(i: int) -> str:
    r2 = f"(x{i}*x{i}+y{i}*y{i})"
    rad = f"(1 + ((0.01*{r2} - 0.02)*{r2} + 0.1)*{r2})"
    return f"""s{i + 1} AS (SELECT vec_id, xn, yn, (xn - (2*0.001*x{i}*y{i} + 0.002*({r2} + 2*x{i}*x{i})))/{rad} AS x{i + 1},
      (yn - (0.001*({r2} + 2*y{i}*y{i}) + 2*0.002*x{i}*y{i}))/{rad} AS y{i + 1} FROM s{i})"""


@case("rectify_pixel", f"""WITH {VEC}, s0 AS (SELECT vec_id, e[1] AS xn, e[2] AS yn, e[1] AS x0, e[2] AS y0 FROM vec), {", ".join(_step(i) for i in range(5))}
  SELECT vec_id, round((x5*0.998 - y5*0.01 + 0.02) / (0.01*x5 + 1.0) * 410 + 322, 4) AS u, round((0.01*x5 + y5*0.999) / (0.01*x5 + 1.0) * 410 + 241, 4) AS v FROM s5""")
def rectify_pixel(spark, sf):
    arr = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    k, d = arr([400, 0, 320, 0, 400, 240, 0, 0, 1]), arr([0.1, -0.02, 0.001, 0.002, 0.01])
    rot, p = arr([0.998, -0.01, 0.02, 0.01, 0.999, 0, 0.01, 0, 1]), arr([410, 0, 322, 0, 0, 410, 241, 0, 0, 0, 1, 0])
    u, v = g.rectify_pixel(e(1) * 400 + 320, e(2) * 400 + 240, k, d, rot, p)
    return vectors(spark, sf).select("vec_id", r(u, 4).alias("u"), r(v, 4).alias("v"))


@case("bearing", f"WITH {BOX} SELECT stamp_ns, seq, round(-atan((cx - 320) / 400.0), 6) AS bearing FROM box")
def bearing(spark, sf):
    return boxes(spark, sf).select("stamp_ns", "seq", r(g.bearing(F.col("cx"), F.lit(400.0), F.lit(320.0))).alias("bearing"))


@case("flt_bearing", f"WITH {BOX} SELECT stamp_ns, seq FROM box WHERE abs(-atan((cx - 320) / 400.0)) <= radians(1.5)")
def flt_bearing(spark, sf):
    import math

    b = g.bearing(F.col("cx"), F.lit(400.0), F.lit(320.0))
    return boxes(spark, sf).where(F.abs(b) <= math.radians(1.5)).select("stamp_ns", "seq")


@case("backproject", f"WITH {BOX} SELECT stamp_ns, seq, round(-((cx - 320) * (score*5) / 400.0), 6) AS x, round((cy - 240) * (score*5) / 400.0, 6) AS y, round(score*5, 6) AS z FROM box")
def backproject(spark, sf):
    l = lambda v: F.lit(float(v))
    p = g.backproject(F.col("cx"), F.col("cy"), F.col("score") * 5, l(400), l(400), l(320), l(240), mirror_x=True)
    return boxes(spark, sf).select("stamp_ns", "seq", *[r(c).alias(n) for c, n in zip(p, "xyz")])


@case("disp_to_depth", f"""WITH {VEC} SELECT vec_id, CAST(count(z) AS BIGINT) AS n, round(min(z), 6) AS nearest FROM (
  SELECT vec_id, CASE WHEN d > 0 THEN 24.0 / d END AS z FROM (SELECT vec_id, unnest(e) * 100 AS d FROM vec)) GROUP BY ALL""")
def disp_to_depth(spark, sf):
    z = g.disp_to_depth(F.transform("e", lambda x: x * 100), F.lit(400.0), F.lit(0.06))
    good = F.filter(z, lambda v: v.isNotNull())
    return vectors(spark, sf).select("vec_id", F.size(good).cast("bigint").alias("n"), r(F.array_min(good)).alias("nearest"))


@case("world_cell", f"""WITH {VEC}, p AS (SELECT vec_id, e[1]*10 AS x, e[2]*10 AS y FROM vec)
  SELECT vec_id, CAST(floor((x + 3) / 0.05) AS BIGINT) AS col_a, CAST(floor((y + 4) / 0.05) AS BIGINT) AS row_a,
  round(-3 + (floor((x + 3) / 0.05) + 0.5) * 0.05, 3) AS x_b, round(-4 + (200 - floor((y + 4) / 0.05) - 0.5) * 0.05, 3) AS y_b,
  round((x + 3) / 0.05, 4) AS col_c, round(199 - (y + 4) / 0.05, 4) AS row_c,
  round_even((x + 3) / 0.05, 0) AS col_d, round_even(199 - (y + 4) / 0.05, 0) AS row_d FROM p""")
def world_cell(spark, sf):
    x, y = e(1) * 10, e(2) * 10
    l = lambda v: F.lit(float(v))
    ca, ra = g.cell_floor(x, y, l(-3), l(-4), l(0.05))
    xb, yb = g.cell_centre_topdown(ca, ra, l(-3), l(-4), l(0.05), F.lit(200))
    cc, rc = g.plan_pixel(x, y, l(-3), l(-4), l(0.05), F.lit(200))
    cd, rd = g.patch_pixel(x, y, l(-3), l(-4), l(0.05), F.lit(200))
    return vectors(spark, sf).select(
        "vec_id", ca.alias("col_a"), ra.alias("row_a"), xb.alias("x_b"), yb.alias("y_b"), r(cc, 4).alias("col_c"), r(rc, 4).alias("row_c"), cd.alias("col_d"), rd.alias("row_d"))


@case("plane_pose", f"""WITH {VEC}, p AS (SELECT vec_id, degrees(atan2(e[3], abs(e[2]) + 0.2)) AS pitch, degrees(atan2(e[1], abs(e[2]) + 0.2)) AS roll, abs(e[4]) AS height FROM vec)
  SELECT vec_id, round(pitch, 6) AS pitch, round(roll, 6) AS roll, height, abs(roll) < 15 AND pitch > -10 AND pitch < 50 AND height > 0.04 AND height < 0.40 AS plausible FROM p""")
def plane_pose(spark, sf):
    pitch, roll, height = g.plane_pose(e(1), -(F.abs(e(2)) + 0.2), e(3), e(4))
    return vectors(spark, sf).select("vec_id", r(pitch).alias("pitch"), r(roll).alias("roll"), height.alias("height"), g.plausible_plane(pitch, roll, height).alias("plausible"))


# ---------------------------------------------------------------- boxes


@case("box_iou", f"""WITH {BOX} SELECT a.stamp_ns, a.seq AS a, b.seq AS b, round({iou_sql('a', 'b')}, 6) AS iou FROM box a JOIN box b ON a.stamp_ns = b.stamp_ns AND b.seq = a.seq + 1""")
def box_iou(spark, sf):
    b = boxes(spark, sf).select("stamp_ns", "seq", "cx", "cy", "sx", "sy")
    n = b.select("stamp_ns", (F.col("seq") - 1).alias("seq"), *[F.col(c).alias(f"n_{c}") for c in ("cx", "cy", "sx", "sy")])
    return b.join(n, ["stamp_ns", "seq"]).select(
        "stamp_ns", F.col("seq").alias("a"), (F.col("seq") + 1).alias("b"), r(bx.box_iou(bx.side(), bx.side("n_"))).alias("iou"))


@case("box_orient_back", f"""WITH {BOX}, o AS (SELECT *, (['none','ud','lr','rot180'])[seq % 4 + 1] AS orient, cx - sx/2 AS x1, cy - sy/2 AS y1, cx + sx/2 AS x2, cy + sy/2 AS y2 FROM box)
  SELECT stamp_ns, seq, round(CASE WHEN orient IN ('lr','rot180') THEN w - x2 ELSE x1 END, 6) AS x1, round(CASE WHEN orient IN ('ud','rot180') THEN h - y2 ELSE y1 END, 6) AS y1,
  round(CASE WHEN orient IN ('lr','rot180') THEN 639 - cx ELSE cx END, 6) AS pcx FROM o""")
def box_orient_back(spark, sf):
    o = F.element_at(F.array(*[F.lit(x) for x in ("none", "ud", "lr", "rot180")]), (F.col("seq") % 4 + 1).cast("int"))
    x1, y1, x2, y2 = bx._corners(bx.side())
    a, b, _, _ = bx.orient_back(x1, y1, x2, y2, F.col("w"), F.col("h"), o)
    pc, _ = bx.orient_centre(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), o)
    return boxes(spark, sf).select("stamp_ns", "seq", r(a).alias("x1"), r(b).alias("y1"), r(pc).alias("pcx"))


_WARP = """u AS (SELECT stamp_ns, seq, (cx + sgx*sx/2 - 320) / 400 AS xn, (cy + sgy*sy/2 - 240) / 400 AS yn, radians(-(seq + 1.0)) AS a
    FROM box, (VALUES (-1), (1)) gx(sgx), (VALUES (-1), (1)) gy(sgy)),
  w2 AS (SELECT stamp_ns, seq, xn / (yn*sin(a) + cos(a)) * 400 + 320 AS px, (yn*cos(a) - sin(a)) / (yn*sin(a) + cos(a)) * 400 + 240 AS py FROM u)"""


@case("box_homography", f"WITH {BOX}, {_WARP} SELECT stamp_ns, seq, round(min(px), 4) AS x1, round(min(py), 4) AS y1, round(max(px), 4) AS x2, round(max(py), 4) AS y2 FROM w2 GROUP BY ALL")
def box_homography(spark, sf):
    l = lambda v: F.lit(float(v))
    out = bx.warp_box_back(*bx._corners(bx.side()), l(400), l(400), l(320), l(240), F.col("seq") + 1.0)
    return boxes(spark, sf).select("stamp_ns", "seq", *[r(c, 4).alias(n) for c, n in zip(out, ("x1", "y1", "x2", "y2"))])


@case("box_clip", f"""WITH {BOX}, k AS (SELECT stamp_ns, seq, score, greatest(0, least(cx - sx*3, 640)) AS x1, greatest(0, least(cy - sy*3, 480)) AS y1,
    greatest(0, least(cx - sx*2, 640)) AS x2, greatest(0, least(cy + sy, 480)) AS y2 FROM box)
  SELECT stamp_ns, seq, round(score, 4) AS score, round((x1+x2)/2, 6) AS cx, round((y1+y2)/2, 6) AS cy, round(x2-x1, 6) AS sx, round(y2-y1, 6) AS sy FROM k WHERE x2 > x1 AND y2 > y1""")
def box_clip(spark, sf):
    c = F.col
    cut = bx.clip_box(c("cx") - c("sx") * 3, c("cy") - c("sy") * 3, c("cx") - c("sx") * 2, c("cy") + c("sy"), c("w"), c("h"))
    k = boxes(spark, sf).select("stamp_ns", "seq", r("score", 4).alias("score"), *[v.alias(n) for n, v in cut.items()]).where("keep")
    return k.select("stamp_ns", "seq", "score", *[r(n).alias(n) for n in ("cx", "cy", "sx", "sy")])


# ---------------------------------------------------------------- scans

VALID = "r BETWEEN range_min AND range_max"
WRAP = f"atan2(sin(a + {PI}), cos(a + {PI}))"
BRAKE = "r >= greatest(range_min, 0.18) AND r <= least(range_max, 8.0)"


@case("scan_valid", f"WITH {SCAN} SELECT scan_id, count(*) FILTER ({VALID}) AS n_valid, round(sum(r) FILTER ({VALID}), 4) AS total FROM beam GROUP BY ALL")
def scan_valid(spark, sf):
    v = sc.scan_valid()
    return scans(spark, sf).select("scan_id", F.size(v).cast("bigint").alias("n_valid"), r(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@case("scan_clip", f"""WITH {SCAN}, k AS (SELECT scan_id, i, CASE WHEN r < 0.6 AND NOT (r >= 0.16 AND abs({WRAP}) < 1.05) THEN range_max ELSE r END AS c FROM beam)
  SELECT scan_id, count(*) FILTER (c = 3.0) AS clipped, round(sum(c), 4) AS total FROM k GROUP BY ALL""")
def scan_clip(spark, sf):
    s = scans(spark, sf).withColumn("c", sc.scan_clip(0.6))
    return s.select("scan_id", F.size(F.filter("c", lambda x: x == 3.0)).cast("bigint").alias("clipped"), r(F.aggregate("c", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@case("front_cone_min", f"WITH {SCAN} SELECT scan_id, coalesce(min(r) FILTER ({BRAKE} AND abs({WRAP}) < 0.70), 99.0::DOUBLE) AS nearest FROM beam GROUP BY ALL")
def front_cone_min(spark, sf):
    return scans(spark, sf).select("scan_id", sc.front_cone_min().alias("nearest"))


@case("turn_sweep_min", f"""WITH {SCAN}, b AS (SELECT *, {WRAP} AS b, scan_id % 3 - 1 AS sgn FROM beam)
  SELECT scan_id, coalesce(min(r) FILTER ({BRAKE} AND ((sgn > 0 AND b > 0 AND b < 1.05) OR (sgn < 0 AND b < 0 AND b > -1.05))), 99.0::DOUBLE) AS nearest FROM b GROUP BY ALL""")
def turn_sweep_min(spark, sf):
    return scans(spark, sf).select("scan_id", sc.turn_sweep_min(F.col("scan_id") % 3 - 1).alias("nearest"))


CLEAR = f"""c AS (SELECT scan_id, count(*) FILTER ({VALID}) AS n_valid, min(r) FILTER ({VALID}) AS min_all,
  min(r) FILTER ({VALID} AND (abs(atan2(sin(a), cos(a))) <= 0.70 OR abs(atan2(sin(a - {PI}), cos(a - {PI}))) <= 0.70)) AS min_longitudinal,
  min(r) FILTER ({VALID} AND abs({WRAP}) <= 0.70) AS min_forward, min(r) FILTER ({VALID} AND abs(atan2(sin(a), cos(a))) <= 0.70) AS min_backward FROM beam GROUP BY ALL)"""


@case("clearance_summary", f"WITH {SCAN}, {CLEAR} SELECT *, 'ok' AS reason FROM c")
def clearance_summary(spark, sf):
    return scans(spark, sf).select("scan_id", *[v.alias(n) for n, v in sc.clearance_summary().items()])


def _quarter(centre: str) -> str:
    return f"min(r) FILTER ({VALID} AND abs(atan2(sin(a - {centre}), cos(a - {centre}))) < {PI} / 4)"


@case("quadrant_min", f"""WITH {SCAN} SELECT scan_id, min(r) FILTER ({VALID}) AS min_m, degrees(arg_min(a, struct_pack(r := r, a := a)) FILTER ({VALID})) AS angle_deg,
  {_quarter("0.0")} AS front, {_quarter(f"{PI} / 2")} AS "left", {_quarter(PI)} AS back, {_quarter(f"-{PI} / 2")} AS "right" FROM beam GROUP BY ALL""")
def quadrant_min(spark, sf):
    return scans(spark, sf).select("scan_id", *[v.alias(n) for n, v in sc.quadrant_min().items()])


@case("sector_range", f"""WITH {SCAN}, h AS (SELECT scan_id, count(*) AS n, quantile_cont(r, 0.25) AS a, quantile_cont(r, 0.5) AS m, quantile_cont(r, 0.75) AS b FROM beam
    WHERE r > range_min AND r < range_max AND atan2(sin(a), cos(a)) BETWEEN -0.55 AND 0.55 GROUP BY ALL)
  SELECT scan_id, coalesce(n, 0) AS samples, round(b - a, 6) AS iqr, round(CASE WHEN n >= 3 AND b - a <= 0.9 THEN m END, 6) AS range_m FROM scan LEFT JOIN h USING (scan_id)""")
def sector_range(spark, sf):
    s = sc.sector_range(F.lit(-0.55), F.lit(0.55), 0.9)
    return scans(spark, sf).select("scan_id", s["samples"].alias("samples"), r(s["iqr"]).alias("iqr"), r(s["range_m"]).alias("range_m"))


# ---------------------------------------------------------------- text and hashes


def _label_sql(expr: str, label_set: str) -> str:
    phrases = sorted([(p, l) for l, ps in tx.LABEL_SETS[label_set] for p in ps], key=lambda t: -len(t[0]))
    return "CASE " + " ".join(f"WHEN contains({expr}, '{p}') THEN '{l}'" for p, l in phrases) + " END"


@case("canonical_label", f"""WITH d AS (SELECT p_partkey, lower(p_name || ' ' || (['Closed  Door','wall socket','POSTER','blue cabinet','couch'])[p_partkey % 5 + 1]) AS raw FROM part),
  n AS (SELECT p_partkey, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS t FROM d) SELECT p_partkey, {_label_sql('t', 'hall_v1')} AS label FROM n""")
def canonical_label(spark, sf):
    tail = F.element_at(F.array(*[F.lit(x) for x in ("Closed  Door", "wall socket", "POSTER", "blue cabinet", "couch")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    t = F.concat_ws(" ", F.col("p_name"), tail)
    return table(spark, sf, "part").select("p_partkey", tx.canonical_label(t, tx.HALL_V1).alias("label"))


@case("canonical_frame", "SELECT page_id, regexp_replace(trim(regexp_replace(url, '^[a-z]+:', '')), '^/+', '') AS frame FROM pages")
def canonical_frame(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.canonical_frame(F.regexp_replace("url", "^[a-z]+:", "")).alias("frame"))


@case("csv_labels", """WITH p AS (SELECT item_id, regexp_replace(unnest(string_split(text, ',')), '^\\s+|\\s+$', '', 'g') AS part FROM benchmark)
  SELECT item_id, count(DISTINCT trim(part)) FILTER (trim(part) <> '') AS n_labels, max(trim(part)) AS last_label FROM p GROUP BY ALL""")
def csv_labels(spark, sf):
    a = tx.csv_labels(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", F.size(a).cast("bigint").alias("n_labels"), F.array_max(a).alias("last_label"))


@case("parse_space", """SELECT p_partkey, CASE WHEN p_size % 5 <> 4 AND p_size > 0 THEN p_size * (CASE p_size % 5 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END)::BIGINT END AS bytes FROM part""")
def parse_space(spark, sf):
    unit = F.element_at(F.array(*[F.lit(x) for x in ("", "K", "m", "G", "T")]), (F.col("p_size") % 5 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", tx.parse_space(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"))


@case("camera_mount", f"WITH {VEC} SELECT vec_id, vec_id % 3 <> 1 AS valid, CASE WHEN vec_id % 3 <> 1 THEN vec_id::DOUBLE END AS first FROM vec")
def camera_mount(spark, sf):
    body = F.concat(F.col("vec_id").cast("string"), F.lit(", 0.5 0,0 -1e-1 "), F.when(F.col("vec_id") % 3 == 1, "nan").otherwise("2"))
    m = tx.camera_mount(body)
    return vectors(spark, sf).select("vec_id", m.isNotNull().alias("valid"), m[0].alias("first"))


@case("is_sha256", "SELECT doc_id, doc_id % 2 = 0 AS ok FROM documents")
def is_sha256(spark, sf):
    h = tx.content_sha(F.col("text"))
    h = F.when(F.col("doc_id") % 2 == 0, F.upper(h)).otherwise(F.substring(h, 1, 63))
    return table(spark, sf, "documents").select("doc_id", tx.is_sha256(h).alias("ok"))


@case("is_token", "SELECT doc_id, NOT regexp_matches(t, '[\\x00-\\x20]') AND length(t) BETWEEN 1 AND 256 AS printable, true AS hex32 FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents)")
def is_token(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.is_token(F.col("text")).alias("printable"), tx.is_token32(F.md5(F.col("text").cast("binary"))).alias("hex32"))


@case("content_sha", "SELECT doc_id, sha256(text) AS sha FROM documents")
def content_sha(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.content_sha(F.col("text")).alias("sha"))


@case("canonical_sha", """SELECT o_orderkey, sha256('{"a":"' || o_orderpriority || '","cust":' || o_custkey || ',"key":' || o_orderkey || '}') AS sha FROM orders""")
def canonical_sha(spark, sf):
    sha = tx.canonical_sha({"key": F.col("o_orderkey"), "cust": F.col("o_custkey"), "a": F.col("o_orderpriority")})
    return table(spark, sf, "orders").select("o_orderkey", sha.alias("sha"))


@case("best_text", """WITH c AS (SELECT conv_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, (turn * 37 % 11) / 10.0 AS conf, turn FROM conversations)
  SELECT conv_id, arg_min(text, struct_pack(a := -conf, b := turn)) FILTER (conf > 0 AND regexp_matches(text, '[\\p{L}\\p{N}]')) AS best FROM c GROUP BY ALL""")
def best_text(spark, sf):
    c = table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(tx.best_text_of(F.col("text"), F.col("turn") * 37 % 11 / 10.0, F.col("turn")).alias("best"))
