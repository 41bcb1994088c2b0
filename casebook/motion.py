"""Run summaries and ordered rules on the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook import case
from casebook.views import DAY, HOUR, LOG, SCAN, log, scans, table
from surveykit.functions.scans import scan_valid
from surveykit.operators import motion as m
from surveykit.operators.ordered import Timeline

BY_RUN = Timeline(("run_id",), ("stamp_ns", "seq"), 10 * DAY)
BY_TOPIC = Timeline(("run_id", "topic"), ("stamp_ns", "seq"), 10 * DAY)
POSE = LOG + """, pose AS (SELECT *, stamp_ns AS bag_ns, value / 10.0 AS x, CAST(seq % 100 AS DOUBLE) AS y,
  value / 100.0 AS yaw FROM log)"""


def r(c, digits=6):
    return F.round(c, digits)


def poses(spark, sf):
    return log(spark, sf).select(
        "*",
        F.col("stamp_ns").alias("bag_ns"),
        (F.col("value") / 10.0).alias("x"),
        (F.col("seq") % 100).cast("double").alias("y"),
        (F.col("value") / 100.0).alias("yaw"),
    )


@case("src_messages", f"WITH {LOG} SELECT run_id, topic, stamp_ns, seq FROM log WHERE topic IN ('view', 'click')")
def src_messages(spark, sf):
    from surveykit.sources.tables import select_topics

    return select_topics(log(spark, sf), ["view", "click"]).select("run_id", "topic", "stamp_ns", "seq")


@case("agg_topic_counts", f"""WITH {LOG} SELECT run_id, topic, n, round((b - a) / 1e9, 6) AS duration_s FROM (
  SELECT run_id, topic, count(*) AS n FROM log GROUP BY ALL) JOIN (
  SELECT run_id, min(stamp_ns) AS a, max(stamp_ns) AS b FROM log GROUP BY ALL) USING (run_id)""")
def agg_topic_counts(spark, sf):
    return m.topic_counts(log(spark, sf)).withColumn("duration_s", r("duration_s"))


@case("agg_pose_motion", f"""WITH {POSE}, e AS (SELECT run_id, topic, arg_min(x, seq) AS fx, arg_min(y, seq) AS fy,
  arg_max(x, seq) AS lx, arg_max(y, seq) AS ly, arg_min(yaw, seq) AS fa, arg_max(yaw, seq) AS la, count(*) AS samples
  FROM pose GROUP BY ALL) SELECT run_id, topic, fx AS first_x, fy AS first_y, lx AS last_x, ly AS last_y,
  round(sqrt((lx-fx)*(lx-fx)+(ly-fy)*(ly-fy)), 6) AS translation_m,
  round(atan2(sin(la-fa), cos(la-fa)), 6) AS yaw_change_rad, samples FROM e""")
def agg_pose_motion(spark, sf):
    out = m.pose_motion(poses(spark, sf), ["run_id", "topic"])
    return out.withColumn("translation_m", r("translation_m")).withColumn("yaw_change_rad", r("yaw_change_rad"))


@case("agg_cmd", f"""WITH {LOG}, c AS (SELECT run_id, stamp_ns, CASE WHEN topic = 'error' THEN 0 ELSE value END AS vx,
  CASE WHEN topic = 'view' THEN -value ELSE 0 END AS wz FROM log), f AS (SELECT *, abs(vx) > 1e-9 OR abs(wz) > 1e-9 AS live FROM c)
  SELECT run_id, count(*) AS samples, count(*) FILTER (live) AS nonzero_samples, max(abs(vx)) AS max_abs_linear,
  max(abs(wz)) AS max_abs_angular,
  round(coalesce((max(stamp_ns) FILTER (live) - min(stamp_ns) FILTER (live)) / 1e9, 0.0), 6) AS nonzero_span_s
  FROM f GROUP BY ALL""")
def agg_cmd(spark, sf):
    c = log(spark, sf).select(
        "run_id",
        "stamp_ns",
        F.when(F.col("topic") == "error", 0.0).otherwise(F.col("value")).alias("vx"),
        F.when(F.col("topic") == "view", -F.col("value")).otherwise(0.0).alias("wz"),
    )
    return m.command_summary(c, ["run_id"]).withColumn("nonzero_span_s", r("nonzero_span_s"))


@case("agg_minmax", f"""WITH {LOG}, want AS (SELECT run_id, topic FROM (SELECT DISTINCT run_id FROM log),
  (VALUES ('view'), ('error'), ('reset')) t(topic)) SELECT w.run_id, w.topic, count(l.seq) AS samples,
  coalesce(min(value), 0.0) AS min_value, coalesce(max(value), 0.0) AS max_value
  FROM want w LEFT JOIN log l USING (run_id, topic) GROUP BY ALL""")
def agg_minmax(spark, sf):
    l = log(spark, sf)
    names = F.array(*[F.lit(t) for t in ("view", "error", "reset")])
    want = l.select("run_id").distinct().select("run_id", F.explode(names).alias("topic"))
    return m.minmax(l, ["run_id", "topic"], want)


@case("agg_scan_quality", f"""WITH {SCAN} SELECT run_id, count(DISTINCT scan_id) AS samples, 1::BIGINT AS n_sizes,
  64 AS points_min, 64 AS points_max, round(count(*) FILTER (r BETWEEN range_min AND range_max) / count(*)::DOUBLE, 6) AS valid_ratio,
  min(r) FILTER (r BETWEEN range_min AND range_max) AS minimum_range_m FROM beam GROUP BY run_id""")
def agg_scan_quality(spark, sf):
    return m.scan_quality(scans(spark, sf), ["run_id"], scan_valid()).withColumn("valid_ratio", r("valid_ratio"))


@case("agg_map_delta", """WITH g AS (SELECT l_suppkey AS map_id, epoch_us(l_shipdate) * 1000 AS stamp_ns,
  CAST(l_quantity * 2 - 10 AS INTEGER) AS value FROM lineitem), p AS (SELECT map_id, stamp_ns,
  count(*) FILTER (value >= 0 AND value < 50) AS free, count(*) FILTER (value >= 50) AS occ FROM g GROUP BY ALL)
  SELECT map_id, count(*) AS samples, arg_min(free, stamp_ns) AS first_free, arg_min(occ, stamp_ns) AS first_occupied,
  arg_max(free, stamp_ns) AS last_free, arg_max(occ, stamp_ns) AS last_occupied,
  arg_max(free + occ, stamp_ns) - arg_min(free + occ, stamp_ns) AS known_delta FROM p GROUP BY ALL""")
def agg_map_delta(spark, sf):
    g = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("map_id"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("stamp_ns"),
        (F.col("l_quantity") * 2 - 10).cast("int").alias("value"),
    )
    return m.map_delta(g, ["map_id"])


@case("agg_safety_values", f"WITH {LOG} SELECT DISTINCT run_id, value > 400 AS value FROM log")
def agg_safety_values(spark, sf):
    return m.distinct_values(log(spark, sf).withColumn("value", F.col("value") > 400), ["run_id"])


def _first_last_sql(cut: str) -> str:
    return f"""WITH {LOG} SELECT run_id, count(*) AS samples, arg_min(value, seq) AS first_value, arg_max(value, seq) AS last_value,
  min(value) AS min_value, max(value) AS max_value FROM log WHERE {cut} GROUP BY ALL"""


@case("agg_particle", _first_last_sql("topic = 'view'"))
def agg_particle(spark, sf):
    return m.first_last(poses(spark, sf).where("topic = 'view'"), ["run_id"], ["value"])


@case("agg_amcl", f"""WITH {POSE} SELECT run_id, count(*) AS samples, arg_min(x, seq) AS first_x, arg_max(x, seq) AS last_x,
  min(x) AS min_x, max(x) AS max_x, arg_min(yaw, seq) AS first_yaw, arg_max(yaw, seq) AS last_yaw,
  min(yaw) AS min_yaw, max(yaw) AS max_yaw FROM pose WHERE topic = 'click' GROUP BY ALL""")
def agg_amcl(spark, sf):
    return m.first_last(poses(spark, sf).where("topic = 'click'"), ["run_id"], ["x", "yaw"])


@case("win_step_detect", f"""WITH {LOG}, s AS (SELECT run_id, stamp_ns, value,
  quantile_cont(value, 0.5) OVER pre AS a, quantile_cont(value, 0.5) OVER post AS b,
  count(*) OVER pre AS n0, count(*) OVER post AS n1 FROM log
  WINDOW pre AS (PARTITION BY run_id ORDER BY stamp_ns RANGE BETWEEN {3 * DAY - 1} PRECEDING AND CURRENT ROW),
  post AS (PARTITION BY run_id ORDER BY stamp_ns RANGE BETWEEN 1 FOLLOWING AND {3 * DAY} FOLLOWING)),
  d AS (SELECT run_id, stamp_ns, b - a AS diff FROM s WHERE n0 >= 5 AND n1 >= 5)
  SELECT run_id, stamp_ns AS step_ns, round(diff, 6) AS step, abs(diff) > 2.0 AS reported FROM d
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY abs(diff) DESC, stamp_ns) = 1""")
def win_step_detect(spark, sf):
    out = m.step_detect(log(spark, sf), ["run_id"], "value", 3 * DAY, width=10 * DAY)
    return out.withColumn("step", r("step"))


@case("win_edge_quantile", f"""WITH {LOG}, c AS (SELECT run_id, quantile_cont(stamp_ns::DOUBLE, 0.2) AS q1,
  quantile_cont(stamp_ns::DOUBLE, 0.8) AS q2 FROM log GROUP BY ALL)
  SELECT run_id, round(quantile_cont(value, 0.5) FILTER (stamp_ns < q1), 6) AS head_median,
  round(quantile_cont(value, 0.5) FILTER (stamp_ns > q2), 6) AS tail_median FROM log JOIN c USING (run_id) GROUP BY ALL""")
def win_edge_quantile(spark, sf):
    out = m.edge_quantile(log(spark, sf), ["run_id"], "value")
    return out.withColumn("head_median", r("head_median")).withColumn("tail_median", r("tail_median"))


_DRIFT = """p AS (SELECT *, lag(CASE WHEN value >= 0 THEN value END) OVER w AS prev FROM log WINDOW w AS (PARTITION BY run_id ORDER BY stamp_ns, seq)),
  f AS (SELECT *, coalesce(value - prev >= 0.04, false) AS rise FROM p),
  i AS (SELECT *, sum(CASE WHEN rise THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY stamp_ns, seq) AS run FROM f),
  c AS (SELECT *, CAST(sum(CASE WHEN rise THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, run ORDER BY stamp_ns, seq) AS BIGINT) AS rises FROM i)"""


@case("win_drift", f"WITH {LOG}, {_DRIFT} SELECT run_id, seq, rises, rises >= 3 AS drifting FROM c")
def win_drift(spark, sf):
    return m.drift(log(spark, sf), BY_RUN, "value").select("run_id", "seq", "rises", "drifting")


_LATCH = """l0 AS (SELECT *, value > 150 AS mv FROM log),
  l1 AS (SELECT *, sum(CASE WHEN mv THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY stamp_ns, seq) AS run FROM l0),
  l2 AS (SELECT *, CAST(sum(CASE WHEN mv THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, run ORDER BY stamp_ns, seq) AS BIGINT) AS hits FROM l1),
  l3 AS (SELECT *, hits >= 2 AS robot_moving, max(CASE WHEN hits = 2 THEN stamp_ns END) OVER (PARTITION BY run_id, run ORDER BY stamp_ns, seq) AS motion_started FROM l2)"""


@case("win_motion_latch", f"WITH {LOG}, {_LATCH} SELECT run_id, seq, hits, robot_moving, motion_started FROM l3")
def win_motion_latch(spark, sf):
    out = m.motion_latch(log(spark, sf), BY_RUN, F.col("value") > 150, 2)
    return out.select("run_id", "seq", "hits", "robot_moving", "motion_started")


_HEALTH = f"""h0 AS (SELECT *, value < 300 AS g, lag(robot_moving) OVER (PARTITION BY run_id ORDER BY stamp_ns, seq) AS was FROM l3),
  h1 AS (SELECT *, sum(CASE WHEN g OR (robot_moving AND NOT coalesce(was, false)) THEN 1 ELSE 0 END) OVER w AS bad_run,
    sum(CASE WHEN g THEN 0 ELSE 1 END) OVER w AS good_run, max(CASE WHEN g THEN stamp_ns END) OVER w AS last_good
    FROM h0 WINDOW w AS (PARTITION BY run_id ORDER BY stamp_ns, seq)),
  h2 AS (SELECT *, CAST(sum(CASE WHEN g THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, bad_run ORDER BY stamp_ns, seq) AS BIGINT) AS bad_samples,
    sum(CASE WHEN g THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, good_run ORDER BY stamp_ns, seq) AS ok_count FROM h1),
  h3 AS (SELECT *, max(CASE WHEN ok_count >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY stamp_ns, seq) = 1 AS ready FROM h2)
  SELECT run_id, seq, bad_samples, ready, CASE WHEN NOT ready THEN false WHEN coalesce(stamp_ns - last_good <= {6 * HOUR}, false) THEN true
    WHEN NOT robot_moving THEN true WHEN bad_samples >= 2 THEN false
    ELSE coalesce(stamp_ns - greatest(last_good, motion_started) <= {6 * HOUR}, false) END AS healthy FROM h3"""


@case("win_localization_health", f"WITH {LOG}, {_LATCH}, {_HEALTH}")
def win_localization_health(spark, sf):
    latched = m.motion_latch(log(spark, sf), BY_RUN, F.col("value") > 150, 2)
    out = m.localization_health(
        latched, BY_RUN, F.col("value") < 300, F.col("robot_moving"), F.col("motion_started"), 3, 2, 6 * HOUR
    )
    return out.select("run_id", "seq", "bad_samples", "ready", "healthy")


@case("win_stationary", f"""WITH {LOG}, a AS (SELECT *, value >= 250 AS mv FROM log),
  b AS (SELECT *, sum(CASE WHEN mv THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY stamp_ns, seq) AS run FROM a),
  c AS (SELECT *, CASE WHEN NOT mv THEN min(CASE WHEN NOT mv THEN stamp_ns END) OVER (PARTITION BY run_id, run) END AS since FROM b)
  SELECT run_id, seq, since AS stationary_since, coalesce(stamp_ns - since >= {12 * HOUR}, false) AS settled FROM c""")
def win_stationary(spark, sf):
    out = m.stationary(log(spark, sf), BY_RUN, F.col("value") >= 250, 12 * HOUR)
    return out.select("run_id", "seq", "stationary_since", "settled")


@case("win_phase_done", f"""WITH {POSE}, s AS (SELECT run_id, topic, arg_min(x, seq) AS sx, arg_min(y, seq) AS sy, min(stamp_ns) AS t0, max(stamp_ns) AS t1
    FROM pose GROUP BY ALL),
  q AS (SELECT *, sqrt((x-sx)*(x-sx)+(y-sy)*(y-sy)) >= 60.0 AS hit FROM pose JOIN s USING (run_id, topic)),
  h AS (SELECT run_id, topic, min(seq) FILTER (hit) AS hs, min(stamp_ns) FILTER (hit) AS ht, any_value(t0) AS t0, any_value(t1) AS t1 FROM q GROUP BY ALL)
  SELECT run_id, topic, (SELECT count(*) FROM q WHERE q.run_id = h.run_id AND q.topic = h.topic AND (h.hs IS NULL OR q.seq <= h.hs)) AS samples,
  round(coalesce(ht - t0, t1 - t0) / 1e9, 6) AS elapsed_s, CASE WHEN coalesce(ht - t0 < {10 * DAY}, false) THEN 'complete'
  WHEN coalesce(ht - t0, t1 - t0) >= {10 * DAY} THEN 'timeout' ELSE 'open' END AS outcome FROM h""")
def win_phase_done(spark, sf):
    out = m.phase_done(poses(spark, sf), ["run_id", "topic"], 60.0, 10 * DAY)
    return out.withColumn("elapsed_s", r("elapsed_s"))


@case("win_staleness", f"""WITH {LOG}, g AS (SELECT run_id, topic, seq, stamp_ns - lag(stamp_ns) OVER (PARTITION BY run_id, topic ORDER BY stamp_ns, seq) AS gap_ns FROM log)
  SELECT run_id, topic, seq, gap_ns, coalesce(gap_ns > {DAY}, false) AS stale FROM g""")
def win_staleness(spark, sf):
    return m.staleness(log(spark, sf), BY_TOPIC, DAY).select("run_id", "topic", "seq", "gap_ns", "stale")


@case("win_stamp_advance", f"""WITH {LOG}, a AS (SELECT *, CAST(floor(value * 10) AS BIGINT) AS hdr FROM log),
  b AS (SELECT *, max(hdr) OVER (PARTITION BY run_id ORDER BY stamp_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM a)
  SELECT run_id, seq, top IS NULL OR hdr > top AS advances FROM b""")
def win_stamp_advance(spark, sf):
    l = log(spark, sf).withColumn("hdr", F.floor(F.col("value") * 10))
    return m.stamp_advance(l, BY_RUN, "hdr").select("run_id", "seq", "advances")


@case("win_dup_stamp", """SELECT o_custkey AS run_id, epoch_us(o_orderdate) * 1000 AS stamp_ns, count(*) AS copies, 'duplicate' AS violation
  FROM orders GROUP BY ALL HAVING count(*) > 1""")
def win_dup_stamp(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"),
        (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("stamp_ns"),
    )
    return m.duplicate_stamps(o, ["run_id"])


@case("win_size_drift", """WITH f AS (SELECT l_orderkey AS run_id, l_linenumber * 1000000::BIGINT + l_partkey AS seq, epoch_us(l_shipdate) * 1000 AS stamp_ns,
  l_returnflag AS w, l_linestatus AS h FROM lineitem),
  z AS (SELECT run_id, arg_min(struct_pack(w := w, h := h), struct_pack(s := stamp_ns, q := seq)) AS f0 FROM
    (SELECT run_id, stamp_ns, seq, min(w) AS w, min(h) AS h FROM f GROUP BY ALL) GROUP BY run_id)
  SELECT DISTINCT run_id, seq, stamp_ns, w, h FROM f JOIN z USING (run_id) WHERE w <> f0.w OR h <> f0.h""")
def win_size_drift(spark, sf):
    f = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        (F.col("l_linenumber") * F.lit(1000000).cast("bigint") + F.col("l_partkey")).alias("seq"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("stamp_ns"),
        F.col("l_returnflag").alias("w"),
        F.col("l_linestatus").alias("h"),
    )
    return m.size_drift(f, ["run_id"]).distinct()


@case("win_pose_thin", f"""WITH RECURSIVE {POSE}, p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY stamp_ns, seq) AS i FROM pose),
  w AS (SELECT run_id, i, stamp_ns, seq, x, y, x AS kx, y AS ky, true AS keep FROM p WHERE i = 1
    UNION ALL SELECT p.run_id, p.i, p.stamp_ns, p.seq, p.x, p.y, CASE WHEN sqrt((p.x-kx)*(p.x-kx)+(p.y-ky)*(p.y-ky)) >= 20 THEN p.x ELSE kx END,
      CASE WHEN sqrt((p.x-kx)*(p.x-kx)+(p.y-ky)*(p.y-ky)) >= 20 THEN p.y ELSE ky END, sqrt((p.x-kx)*(p.x-kx)+(p.y-ky)*(p.y-ky)) >= 20
    FROM w JOIN p ON p.run_id = w.run_id AND p.i = w.i + 1)
  SELECT run_id, stamp_ns, seq, x, y FROM w WHERE keep""")
def win_pose_thin(spark, sf):
    p = poses(spark, sf).select("run_id", "stamp_ns", "seq", "x", "y")
    return m.pose_thin(p, ["run_id"], 20.0, 10 * DAY)


@case("flt_stride", f"""WITH {LOG} SELECT run_id, seq FROM log QUALIFY (row_number() OVER (PARTITION BY run_id ORDER BY stamp_ns, seq) - 1) % 5 = 0""")
def flt_stride(spark, sf):
    return m.stride(log(spark, sf), BY_RUN, 5).select("run_id", "seq")


@case("flt_arrival", f"""WITH {POSE}, goal AS (SELECT c_custkey AS goal, c_custkey % 150 AS run_id, c_acctbal / 200.0 AS gx, CAST(c_nationkey * 4 AS DOUBLE) AS gy FROM customer)
  SELECT run_id, goal, min(stamp_ns) AS arrived_ns, count(*) AS samples_inside FROM pose JOIN goal USING (run_id)
  WHERE sqrt((gx-x)*(gx-x)+(gy-y)*(gy-y)) <= 5.0 GROUP BY ALL""")
def flt_arrival(spark, sf):
    g = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("goal"),
        (F.col("c_custkey") % 150).alias("run_id"),
        (F.col("c_acctbal") / 200.0).alias("gx"),
        (F.col("c_nationkey") * 4).cast("double").alias("gy"),
    )
    return m.arrivals(poses(spark, sf), g, ["run_id"], 5.0)


@case("twist_from_delta", f"""WITH {LOG}, d AS (SELECT run_id, seq, value - lag(value) OVER w AS dv, (stamp_ns - lag(stamp_ns) OVER w) / 3.6e12 AS dt
  FROM log WINDOW w AS (PARTITION BY run_id ORDER BY stamp_ns, seq))
  SELECT run_id, seq, round(CASE WHEN dt > 1e-6 AND dt <= 1.0 THEN dv / dt ELSE 0.0 END, 4) AS v FROM d""")
def twist_from_delta(spark, sf):
    from surveykit.functions.geometry import twist_from_delta as twist
    from surveykit.operators.ordered import Step, scan

    a = scan(log(spark, sf), BY_RUN, [Step("p", "lag", F.col("value")), Step("t", "lag", F.col("stamp_ns"))])
    dt = (F.col("stamp_ns") - F.col("t")) / 3.6e12
    return a.select("run_id", "seq", r(twist(F.col("value") - F.col("p"), dt), 4).alias("v"))


@case("velocity_clamp", f"""WITH {LOG} SELECT run_id, seq, least(greatest(value - 200, -150.0), 150.0) AS vx, abs(value - 200) > 150 AS clamped FROM log""")
def velocity_clamp(spark, sf):
    from surveykit.functions.geometry import velocity_clamp as clamp

    v, hit = clamp(F.col("value") - 200, 150.0)
    return log(spark, sf).select("run_id", "seq", v.alias("vx"), hit.alias("clamped"))


@case("pitch_segment", f"""WITH {LOG}, z AS (SELECT run_id, min(stamp_ns) AS t0 FROM log GROUP BY ALL)
  SELECT run_id, seq, CASE WHEN stamp_ns - t0 >= {20 * DAY} THEN 7.5::DOUBLE WHEN stamp_ns - t0 >= {10 * DAY} THEN 4.0::DOUBLE
  WHEN stamp_ns - t0 >= 0 THEN 1.5::DOUBLE END AS pitch_deg FROM log JOIN z USING (run_id)""")
def pitch_segment(spark, sf):
    from surveykit.operators.detections import piecewise

    l = log(spark, sf)
    z = l.groupBy("run_id").agg(F.min("stamp_ns").alias("t0"))
    t = F.col("stamp_ns") - F.col("t0")
    return l.join(z, "run_id").select(
        "run_id", "seq", piecewise(t, [(0, 1.5), (10 * DAY, 4.0), (20 * DAY, 7.5)]).alias("pitch_deg")
    )


@case("sample_cap", f"WITH {LOG} SELECT run_id, seq FROM log QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY md5(concat_ws('|', 1, stamp_ns, seq)), stamp_ns, seq) <= 40")
def sample_cap(spark, sf):
    from surveykit.operators.detections import seeded_cap

    return seeded_cap(log(spark, sf), ["run_id"], ["stamp_ns", "seq"], 40, seed=1).select("run_id", "seq")


@case("set_union_runs", f"WITH {LOG} SELECT run_id, seq FROM log WHERE topic = 'view' UNION ALL SELECT run_id, seq FROM log WHERE topic = 'click'")
def set_union_runs(spark, sf):
    l = log(spark, sf)
    return l.where("topic = 'view'").unionByName(l.where("topic = 'click'")).select("run_id", "seq")
