"""Data-contract jobs over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook import case
from casebook.motion import r
from casebook.timejoins import WIDE
from casebook.views import BOX, DAY, HOUR, LOG, SCAN, VEC, boxes, log, scans, table, vectors
from surveykit.functions import scans as sc, text as tx
from surveykit.operators import contracts as k, detections as d, motion as m
from surveykit.operators.ordered import Timeline



def sha(*parts):
    return F.sha2(F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts]).cast("binary"), 256)


# ---------------------------------------------------------------- recording chain

CHAIN_SQL = """WITH t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'started' WHEN 'assistant' THEN 'completed' ELSE 'started' END AS state, role FROM conversations),
  g AS (SELECT conv_id, count(*) FILTER (state = 'completed') AS nd, min(turn) FILTER (state = 'completed') AS dt, max(turn) FILTER (state = 'started') AS st, bool_or(role = 'system') AS sys FROM t GROUP BY ALL)
  SELECT conv_id AS run_id, CASE WHEN nd <> 1 THEN 'completion_count' WHEN st IS NULL OR st >= dt THEN 'order' WHEN sys THEN 'map_hash_mismatch' ELSE 'ok' END AS reason FROM g"""


def status(spark, sf):
    c = table(spark, sf, "conversations")
    state = F.when(F.col("role") == "assistant", "completed").otherwise("started")
    record = F.struct(
        F.lit(1).alias("schema"), state.alias("state"), sha("t", F.col("conv_id")).alias("token"),
        F.when(F.col("role") == "system", sha("other")).otherwise(sha("i", F.col("conv_id"))).alias("map_image_sha256"), sha("m", F.col("conv_id")).alias("map_manifest_sha256"),
        F.lit("0 0 0.1 0 0 0").alias("camera_mount"), F.lit("amcl").alias("pose_source"))
    return c.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.to_json(record).alias("payload"))


def chain(spark, sf):
    from surveykit.sources.tables import status_events

    return k.state_chain(status_events(status(spark, sf)))


@case("src_status_events", "SELECT conv_id AS run_id, turn AS seq, CASE WHEN role = 'assistant' THEN 'completed' ELSE 'started' END AS state FROM conversations WHERE turn % 5 <> 3")
def src_status_events(spark, sf):
    from surveykit.sources.tables import status_events

    s = status(spark, sf).withColumn("payload", F.when(F.col("seq") % 5 == 3, F.substring("payload", 1, 20)).otherwise(F.col("payload")))
    return status_events(s).select("run_id", "seq", "state")


@case("win_state_chain", CHAIN_SQL)
def win_state_chain(spark, sf):
    return chain(spark, sf).select("run_id", "reason")


@case("chk_recording", """WITH t AS (SELECT conv_id, turn, role = 'assistant' AS done, role = 'system' AS sys FROM conversations),
  g AS (SELECT conv_id, count(*) FILTER (done) AS nd, min(turn) FILTER (done) AS dt, max(turn) FILTER (NOT done) AS st, bool_or(sys) AS sys FROM t GROUP BY ALL)
  SELECT conv_id AS run_id, CASE WHEN nd <> 1 OR st IS NULL OR st >= dt OR sys THEN 'chain' WHEN conv_id % 4 = 1 THEN 'map_image_topic' WHEN conv_id % 5 = 2 THEN 'camera_tf' ELSE 'ok' END AS verdict FROM g""")
def chk_recording(spark, sf):
    run = table(spark, sf, "conversations").select(F.col("conv_id").alias("run_id"))
    ids = run.select("run_id", F.lit("map_image").alias("topic"), F.when(F.col("run_id") % 4 == 1, sha("x")).otherwise(sha("i", F.col("run_id"))).alias("value")).unionByName(
        run.select("run_id", F.lit("map_manifest").alias("topic"), F.upper(sha("m", F.col("run_id"))).alias("value")))
    l = lambda v: F.lit(float(v))
    edges = run.select("run_id", F.lit("/base_footprint").alias("parent"), F.lit("stereo_left_optical").alias("child"), l(0).alias("tx"), l(0).alias("ty"), F.when(F.col("run_id") % 5 == 2, 0.2).otherwise(0.1).alias("tz"),
        l(0).alias("qx"), l(0).alias("qy"), l(0).alias("qz"), l(2).alias("qw"), F.array(l(0), l(0), l(0.1), l(0), l(0), l(0)).alias("mount"))
    return k.check_recording(chain(spark, sf), ids, edges).select("run_id", "verdict")


# ---------------------------------------------------------------- predicates


@case("flt_edge_match", f"WITH {VEC} SELECT vec_id, vec_id % 7 <> 3 AND abs(e[5]) * 1e-4 <= 1e-5 AND abs(1 - cos(e[6] / 20)) <= 1e-5 AS ok FROM vec")
def flt_edge_match(spark, sf):
    from surveykit.functions.geometry import mount_quat

    e = lambda i: F.element_at("e", i)
    q = mount_quat(e(1) + e(6) / 10, F.lit(0.0), F.lit(0.0))
    t = vectors(spark, sf).select(
        "vec_id", F.when(F.col("vec_id") % 7 == 3, "odom").otherwise("/base_footprint").alias("parent"), F.lit("stereo_left_optical").alias("child"), (e(2) + e(5) * 1e-4).alias("tx"), e(3).alias("ty"), e(4).alias("tz"),
        *[(c * 3).alias(n) for c, n in zip(q, ("qx", "qy", "qz", "qw"))], F.array(e(2), e(3), e(4), e(1), F.lit(0.0), F.lit(0.0)).alias("mount"))
    return t.select("vec_id", k.edge_matches().alias("ok"))


def pairs(spark, sf):
    e = lambda i: F.element_at("e", i)
    arr = lambda xs: F.array(*[x if not isinstance(x, (int, float)) else F.lit(float(x)) for x in xs])

    def side(tx_, r0):
        return F.struct(F.lit(640).alias("width"), F.lit(480).alias("height"), arr([400, 0, 320, 0, 400, 240, 0, 0, 1]).alias("k"), arr([0, 0, 0, 0, 0]).alias("d"),
            arr([r0, 0, 0, 0, 1, 0, 0, 0, 1]).alias("r"), arr([400, 0, 320, tx_, 0, 400, 240, 0, 0, 0, 1, 0]).alias("p"), F.lit("stereo_left_optical").alias("frame_id"))

    return vectors(spark, sf).select("vec_id", side(F.lit(0.0), F.lit(1.0) + e(1) * 3).alias("left"), side(F.lit(-24.0) + e(2) * 200, F.lit(1.0)).alias("right"))


@case("flt_calib_valid", f"WITH {VEC} SELECT vec_id, 1 + e[1] * 3 > 0.5 AND 1 + e[1] * 3 < 1.5 AND (-24 + e[2] * 200) / 400 < -1e-6 AS ok FROM vec")
def flt_calib_valid(spark, sf):
    return pairs(spark, sf).select("vec_id", k.stereo_pair_valid().alias("ok"))


@case("flt_baseline", f"WITH {VEC} SELECT vec_id, -(-24 + e[2] * 200) / 400 BETWEEN 0.05 AND 0.07 AS ok FROM vec")
def flt_baseline(spark, sf):
    return pairs(spark, sf).select("vec_id", k.capture_pair_valid().alias("ok"))


@case("flt_pose_quality", f"WITH {VEC} SELECT vec_id, vec_id % 6 <> 4 AND vec_id > 0 AND e[1] >= 0 AND e[2] >= 0 AND e[3] >= 0 AND sqrt(greatest(e[1], e[2])) <= 0.4 AND sqrt(greatest(e[3], 0)) <= 0.35 AS ok FROM vec")
def flt_pose_quality(spark, sf):
    e = lambda i: F.element_at("e", i)
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    cov = F.concat(F.array(e(1)), zeros(6), F.array(e(2)), zeros(27), F.array(e(3)))
    p = vectors(spark, sf).select("vec_id", F.when(F.col("vec_id") % 6 == 4, "odom").otherwise("/map").alias("frame_id"), cov.alias("cov"), F.col("vec_id").cast("double").alias("stamp_s"), (F.col("vec_id") - 0.05).alias("now_s"))
    return p.select("vec_id", k.pose_quality(0.4, 0.35).alias("ok"))


# ---------------------------------------------------------------- documents


@case("chk_frames", f"""WITH {BOX}, x AS (SELECT run_id, stamp_ns, seq, CASE WHEN seq = 3 THEN score + 0.9 ELSE score END AS sc, CASE WHEN seq = 5 THEN cx + 400 ELSE cx END AS c2, cy, sx, sy, w, h FROM box),
  v AS (SELECT run_id, stamp_ns, CASE WHEN sc > 1 THEN 'score_or_size' WHEN c2 - sx/2 < -1e-6 OR cy - sy/2 < -1e-6 OR c2 + sx/2 > w + 1e-6 OR cy + sy/2 > h + 1e-6 THEN 'outside_image' END AS violation FROM x
    UNION ALL SELECT 0, stamp_ns, 'duplicate' FROM (SELECT DISTINCT stamp_ns FROM box) WHERE stamp_ns % 8 = 1 UNION ALL SELECT 0, stamp_ns, 'size_drift' FROM (SELECT DISTINCT stamp_ns FROM box UNION ALL SELECT DISTINCT stamp_ns FROM box WHERE stamp_ns % 8 = 1 AND stamp_ns > 0) WHERE stamp_ns % 9 = 4
    UNION ALL SELECT 0, 0, 'nonpositive')
  SELECT run_id::BIGINT AS run_id, stamp_ns, violation, count(*) AS n FROM v WHERE violation IS NOT NULL GROUP BY ALL""")
def chk_frames(spark, sf):
    from casebook.detections import dirty

    b = dirty(spark, sf)
    one = b.select("run_id", "stamp_ns").distinct()
    frames = one.unionByName(one.where("stamp_ns % 8 = 1 and stamp_ns > 0")).withColumns(
        {"w": F.when(F.col("stamp_ns") % 9 == 4, 320).otherwise(640), "h": F.lit(480), "seq": F.col("stamp_ns")})
    return k.check_frames(frames.withColumn("seq", F.col("stamp_ns")), b, ["run_id"])


def headers(spark, sf):
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        c.alias("run_id"), F.when(c % 11 == 1, "other-v1").otherwise("x-detections-v1").alias("schema"), (c % 7 != 2).alias("complete"), F.md5(c.cast("string").cast("binary")).alias("recording_token"),
        F.when(c % 13 == 5, "12ab").otherwise(sha("i", c)).alias("map_image_sha256"), sha("m", c).alias("map_manifest_sha256"), sha("b", c).alias("source_bag_sha256"),
        F.when(c % 5 == 3, F.array(F.lit("door"), F.lit("chair"))).otherwise(F.array(F.lit("door"))).alias("classes"), F.array_repeat(F.lit(0.5), F.when(c % 17 == 6, 5).otherwise(6)).alias("camera_mount"),
        F.lit("/left").alias("image_topic"), F.lit(False).alias("rectified"))


HEAD = "CASE WHEN c % 11 = 1 THEN 'schema' WHEN c % 7 = 2 THEN 'incomplete' WHEN c % 13 = 5 THEN 'map_image_sha256' WHEN c % 5 = 3 THEN 'classes' WHEN c % 17 = 6 THEN 'camera_mount' ELSE 'ok' END"


@case("chk_document", f"SELECT c AS run_id, {HEAD} AS reason FROM (SELECT c_custkey AS c FROM customer)")
def chk_document(spark, sf):
    return k.check_document(headers(spark, sf), ["run_id"], schema="x-detections-v1")


@case("join_header_identity", "SELECT c AS run_id, CASE WHEN c % 19 = 1 THEN 'no_completion' WHEN c % 23 = 2 THEN 'token' WHEN c % 13 = 5 THEN 'map_image' WHEN c % 29 = 3 THEN 'map_manifest' WHEN c % 17 = 6 THEN 'camera_mount' WHEN c % 31 = 4 THEN 'image_topic' ELSE 'ok' END AS reason FROM (SELECT c_custkey AS c FROM customer)")
def join_header_identity(spark, sf):
    h = headers(spark, sf)
    c = F.col("run_id")
    done = h.where(c % 19 != 1).select(
        "run_id", F.when(c % 23 == 2, "zz").otherwise(F.col("recording_token")).alias("token"), sha("i", c).alias("map_image_sha256"), "map_manifest_sha256", F.array_repeat(F.lit(0.5), 6).alias("camera_mount"),
        "source_bag_sha256", F.when(c % 31 == 4, "/right").otherwise("/left").alias("image_topic"), "rectified")
    maps = h.select("run_id", sha("i", c).alias("image_sha"), F.when(c % 29 == 3, "0").otherwise(F.col("map_manifest_sha256")).alias("manifest_sha"))
    return k.header_identity(h, done, maps)


@case("join_provenance", "SELECT sha256('t' || o) AS recording_token, CASE WHEN o % 10 = 1 THEN 'left_missing' WHEN o % 10 = 2 THEN 'right_missing' WHEN o % 10 = 3 THEN 'source_bag_sha256' WHEN o % 10 = 4 THEN 'camera_mount' ELSE 'ok' END AS reason FROM (SELECT o_orderkey AS o FROM orders)")
def join_provenance(spark, sf):
    o = F.col("o_orderkey")
    base = table(spark, sf, "orders").select(
        o, sha("t", o).alias("recording_token"), sha("b", o).alias("source_bag_sha256"), sha("i", o).alias("map_image_sha256"), sha("m", o).alias("map_manifest_sha256"), F.array_repeat(F.lit(0.25), 6).alias("camera_mount"))
    left = base.where(o % 10 != 1)
    right = base.where(o % 10 != 2).withColumns({
        "source_bag_sha256": F.when(o % 10 == 3, "x").otherwise(F.upper("source_bag_sha256")), "camera_mount": F.array_repeat(F.when(o % 10 == 4, 0.26).otherwise(0.25), 6)})
    return k.provenance(left, right)


@case("chk_map_identity", """WITH m AS (SELECT p_partkey AS p, p_size::DOUBLE AS s FROM part) SELECT p AS map_id, CASE WHEN p % 7 = 1 THEN 'resolution' WHEN p % 11 = 2 THEN 'yaw' WHEN p % 5 = 3 THEN 'negate' WHEN p % 13 = 4 THEN 'thresholds' WHEN p % 3 = 0 THEN 'manifest_sha' ELSE 'ok' END AS reason FROM m""")
def chk_map_identity(spark, sf):
    p = F.col("p_partkey")
    m_ = table(spark, sf, "part").select(
        p.alias("map_id"), F.lit("x-map-manifest-v1").alias("manifest_schema"), sha("i", p).alias("image_sha"), F.when(p % 7 == 1, -0.05).otherwise(0.05).alias("resolution"),
        F.array(-F.col("p_size") / 10, F.col("p_retailprice"), F.when(p % 11 == 2, 0.1).otherwise(0.0)).alias("origin"), F.when(p % 5 == 3, 2.0).otherwise(0.0).alias("negate"),
        F.when(p % 13 == 4, 0.9).otherwise(0.196).alias("free_thresh"), F.lit(0.65).alias("occupied_thresh"))
    good = m_.withColumn("manifest_sha", F.when(F.col("map_id") % 3 == 0, "f" * 64).otherwise(F.upper(k.map_manifest_sha(F.col("image_sha")))))
    return k.check_map_identity(good, ["map_id"])


def artifact(spark, sf, kind):
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(
        p.alias("doc"), F.lit(f"x-{kind}").alias("schema"), (p % 6 != 1).alias("completed"), F.when(p % 7 == 2, "odom").otherwise("map").alias("frame"), F.when(p % 8 == 3, "two words").otherwise("token-a").alias("recording_token"),
        sha("b", p).alias("source_bag_sha256"), sha("i", p).alias("map_image_sha256"), F.when(p % 9 == 4, "").otherwise(sha("m", p)).alias("map_manifest_sha256"),
        F.array_repeat(F.lit(0.1) * p, F.when(p % 10 == 5, 7).otherwise(6)).alias("camera_mount"), sha("o", p).alias("source_objects_sha256"), sha("o", p).alias("objects_artifact_sha256"), sha("q", p).alias("topology_artifact_sha256"),
        (p % 4).cast("int").alias("n_rooms"), F.lit(0).alias("n_doors"), F.when(p % 15 == 7, F.lit(None)).otherwise(1).cast("int").alias("n_edges"), F.array(F.lit(1.0), F.lit(2.0), F.lit(0.0)).alias("origin"), F.lit(0.05).alias("resolution"), F.when(p % 14 != 6, 3).alias("n_objects"))


HEAD3 = "WHEN p % 6 = 1 THEN 'incomplete' WHEN p % 7 = 2 THEN 'frame' WHEN p % 8 = 3 THEN 'recording_token' WHEN p % 9 = 4 THEN 'map_manifest_sha256' WHEN p % 10 = 5 THEN 'camera_mount'"
PARTS = "FROM (SELECT p_partkey AS p FROM part)"


@case("chk_objects", f"SELECT p AS doc, CASE {HEAD3} WHEN p % 14 = 6 THEN 'objects' ELSE 'ok' END AS reason {PARTS}")
def chk_objects(spark, sf):
    return k.check_objects(artifact(spark, sf, "semantic-objects-v1"), ["doc"], schema="x-semantic-objects-v1")


@case("chk_topology", f"SELECT p AS doc, CASE {HEAD3} WHEN p % 4 = 0 THEN 'rooms' WHEN p % 15 = 7 THEN 'topology' ELSE 'ok' END AS reason {PARTS}")
def chk_topology(spark, sf):
    return k.check_topology(artifact(spark, sf, "room-topology-v1"), ["doc"], schema="x-room-topology-v1")


@case("chk_semantic_map", f"SELECT p AS doc, CASE {HEAD3} WHEN p % 4 = 0 THEN 'rooms' WHEN p % 16 = 9 THEN 'observed_labels' WHEN p % 11 = 8 THEN 'content_sha' WHEN p % 12 = 10 THEN 'manifest_sha' ELSE 'ok' END AS reason {PARTS}")
def chk_semantic_map(spark, sf):
    p = F.col("doc")
    strings = lambda *xs: F.array(*[F.lit(x) for x in xs])
    a = artifact(spark, sf, "semantic-map-v1").withColumns({
        "poi_contract": F.struct(F.lit("x-core-poi-contract-v1").alias("schema"), F.lit(True).alias("complete"), strings("door").alias("required_labels"), strings("chair", "door").alias("observed_labels")),
        "actual_labels": F.when(p % 16 == 9, strings("door")).otherwise(strings("chair", "door")), "content_sha": sha("c", p)})
    a = a.withColumn("semantic_content_sha256", F.when(p % 11 == 8, sha("d", p)).otherwise(F.col("content_sha")))
    a = a.withColumn("semantic_manifest_sha256", F.when(p % 12 == 10, sha("e", p)).otherwise(k.semantic_manifest_sha()))
    return k.check_semantic_map(a, ["doc"], schema="x-semantic-map-v1", poi_schema="x-core-poi-contract-v1")


# ---------------------------------------------------------------- counts and readiness


@case("chk_bag_counts", f"""WITH {LOG}, n AS (SELECT run_id, topic, count(*) AS n FROM log GROUP BY ALL), w AS (SELECT run_id, topic, CASE WHEN topic IN ('view', 'click') THEN 9 ELSE 7 END AS need FROM (SELECT DISTINCT run_id FROM log), (VALUES ('view'), ('click'), ('error')) t(topic)),
  g AS (SELECT run_id, count(*) FILTER (coalesce(n, 0) < need) AS short_topics, max(coalesce(n, 0)) FILTER (topic = 'view') AS l, max(coalesce(n, 0)) FILTER (topic = 'click') AS r FROM w LEFT JOIN n USING (run_id, topic) GROUP BY ALL)
  SELECT run_id, short_topics, CASE WHEN short_topics > 0 THEN 'short' WHEN least(l, r) * 1.25 < greatest(l, r) THEN 'imbalanced' ELSE 'ok' END AS reason FROM g""")
def chk_bag_counts(spark, sf):
    l = log(spark, sf)
    need = F.explode(F.array(*[F.struct(F.lit(t).alias("topic"), F.lit(n).alias("minimum")) for t, n in (("view", 9), ("click", 9), ("error", 7))]))
    req = l.select("run_id").distinct().select("run_id", need.alias("q")).select("run_id", "q.*")
    return k.check_bag_counts(m.topic_counts(l), req, ["run_id"], "view", "click")


@case("chk_ready", """WITH e AS (SELECT DISTINCT o_custkey AS run_id, o_orderkey AS s FROM orders), d AS (SELECT DISTINCT run_id, s FROM e JOIN lineitem ON l_orderkey = s), y AS (SELECT DISTINCT run_id, s FROM e JOIN lineitem ON l_orderkey = s WHERE l_linenumber > 1),
  g AS (SELECT run_id, count(*) AS n, count(*) FILTER ((run_id, s) NOT IN (SELECT run_id, s FROM d)) AS md, count(*) FILTER ((run_id, s) NOT IN (SELECT run_id, s FROM y)) AS ms FROM e GROUP BY ALL)
  SELECT run_id, CASE WHEN n <= 1 THEN 'INVALID:budget' WHEN run_id % 17 = 1 THEN 'INVALID:drops' WHEN md > 0 THEN 'NOT_READY:missing_detections' WHEN ms > 1 THEN 'NOT_READY:missing_sync' WHEN run_id % 13 = 2 THEN 'INVALID:duplicates' WHEN run_id % 11 = 3 THEN 'NOT_READY:inflight' WHEN run_id % 7 = 4 THEN 'NOT_READY:quiet' ELSE 'READY' END AS state FROM g""")
def chk_ready(spark, sf):
    e = table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("stamp_ns"))
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("stamp_ns"), "l_linenumber")
    det = e.join(l.select("stamp_ns").distinct(), "stamp_ns").select("run_id", "stamp_ns")
    syn = e.join(l.where("l_linenumber > 1").select("stamp_ns").distinct(), "stamp_ns").select("run_id", "stamp_ns")
    n = e.groupBy("run_id").agg(F.count("*").alias("expected_n"))
    seen = syn.groupBy("run_id").agg(F.count("*").alias("sync_rx"))
    c = F.col("run_id")
    runs = n.join(seen, "run_id", "left").withColumns({
        "sync_rx": F.coalesce("sync_rx", F.lit(0)), "error": F.lit(""), "det_rx": F.col("expected_n") + F.when(c % 13 == 2, 1).otherwise(0), "inflight": F.when(c % 11 == 3, 1).otherwise(0),
        "drops": F.when(c % 17 == 1, 1).otherwise(0), "budget": F.lit(1), "last_activity_s": F.lit(10.0), "now_s": F.when(c % 7 == 4, 10.5).otherwise(11.0)})
    return k.check_ready(runs, e, det, syn, ["run_id"]).join(n, "run_id").select("run_id", "state")


@case("chk_source_contract", """WITH r AS (SELECT s_suppkey AS run_id FROM supplier), p AS (SELECT run_id, 'optical_frame' AS name, CASE WHEN run_id % 3 = 1 THEN 'base' ELSE 'stereo_left_optical' END AS value, 'stereo_left_optical' AS expected FROM r
  UNION ALL SELECT run_id, 'disparity_topic', CASE WHEN run_id % 5 <> 2 THEN '/stereo/disparity' END, '/stereo/disparity' FROM r UNION ALL SELECT run_id, 'detections_rectified', CASE WHEN run_id % 7 = 3 THEN 'True' ELSE 'false' END, 'false' FROM r)
  SELECT run_id, name, value, expected FROM p WHERE lower(value) IS DISTINCT FROM expected""")
def chk_source_contract(spark, sf):
    c = F.col("run_id")
    runs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("run_id"))
    full = [F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in k.FORMAL_SOURCES.items() if n not in ("optical_frame", "disparity_topic")]
    own = [
        F.struct(F.lit("optical_frame").alias("name"), F.when(c % 3 == 1, "base").otherwise("stereo_left_optical").alias("value")),
        F.struct(F.when(c % 5 != 2, "disparity_topic").otherwise("unused").alias("name"), F.lit("/stereo/disparity").alias("value")),
        F.struct(F.lit("detections_rectified").alias("name"), F.when(c % 7 == 3, "True").otherwise("false").alias("value")),
    ]
    params = runs.select("run_id", F.explode(F.array(*full, *own)).alias("p")).select("run_id", "p.*")
    return k.check_source_contract(params, runs, ["run_id"])


@case("chk_bytes_stable", "SELECT doc_id, doc_id % 9 <> 4 AS stable FROM documents")
def chk_bytes_stable(spark, sf):
    t = table(spark, sf, "documents")
    later = F.when(F.col("doc_id") % 9 == 4, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return t.select("doc_id", tx.content_sha(F.col("text")).eqNullSafe(tx.content_sha(later)).alias("stable"))


@case("chk_startup", f"""WITH {LOG}, now AS (SELECT max(stamp_ns) AS now FROM log), t AS (SELECT run_id, topic, max(stamp_ns) AS last FROM log GROUP BY ALL), w AS (SELECT * FROM (SELECT DISTINCT run_id FROM log), (VALUES ('view'), ('click')) x(topic)),
  g AS (SELECT run_id, count(*) FILTER (last IS NULL) AS missing, count(*) FILTER ((SELECT now FROM now) - last > {4 * DAY}) AS stale FROM w LEFT JOIN t USING (run_id, topic) GROUP BY ALL)
  SELECT run_id, missing, stale, CASE WHEN missing > 0 THEN 'missing' WHEN stale > 0 THEN 'stale' WHEN run_id % 5 = 2 THEN 'localization' ELSE 'ready' END AS reason FROM g""")
def chk_startup(spark, sf):
    l = log(spark, sf)
    now = l.agg(F.max("stamp_ns").alias("now_ns"))
    latest = l.groupBy("run_id", "topic").agg(F.max("stamp_ns").alias("last_ns"))
    runs = l.select("run_id").distinct().withColumn("now_ns", now.scalar())
    req = runs.select("run_id", "now_ns", F.explode(F.array(F.lit("view"), F.lit("click"))).alias("topic"))
    loc = runs.select("run_id", F.when(F.col("run_id") % 5 == 2, 1).otherwise(3).alias("good_in_a_row"), F.lit(0).alias("bad_samples"), F.col("now_ns").alias("last_good"), F.lit(False).alias("moving"), F.lit(3).alias("stable_required"))
    return k.check_startup(latest, loc, req, ["run_id"], 4 * DAY)


@case("chk_cmd_age", f"""WITH {LOG}, c AS (SELECT run_id, stamp_ns, value FROM log WHERE topic = 'click'), v AS (SELECT run_id, seq, stamp_ns, value > 400 AS stop FROM log WHERE topic = 'view'),
  j AS (SELECT v.*, v.stamp_ns - c.stamp_ns AS age_ns, c.value AS vx FROM v ASOF LEFT JOIN c ON v.run_id = c.run_id AND v.stamp_ns >= c.stamp_ns)
  SELECT run_id, seq, age_ns, age_ns IS NULL OR age_ns >= {DAY} OR stop AS stopped, CASE WHEN age_ns IS NULL OR age_ns >= {DAY} OR stop THEN 0 ELSE vx END AS vx FROM j""")
def chk_cmd_age(spark, sf):
    l = log(spark, sf)
    c = l.where("topic = 'click'").select("run_id", "stamp_ns", "seq", F.col("value").alias("vx"))
    v = l.where("topic = 'view'").select("run_id", "stamp_ns", "seq", (F.col("value") > 400).alias("safety_stop"))
    return m.command_age(c, v, ["run_id"], DAY, WIDE).select("run_id", "seq", "age_ns", "stopped", "vx")


@case("chk_clearance", f"""WITH {SCAN}, c AS (SELECT scan_id, min(r) FILTER (r BETWEEN range_min AND range_max) AS a, min(r) FILTER (r BETWEEN range_min AND range_max AND abs(atan2(sin(a + pi()), cos(a + pi()))) <= 0.70) AS f FROM beam GROUP BY ALL)
  SELECT scan_id, CASE WHEN scan_id % 9 = 1 THEN 'safety_active' WHEN scan_id % 7 = 2 THEN 'scan_stale' WHEN f < 0.2 THEN 'directional' WHEN a < 0.125 THEN 'rotation' ELSE 'ready' END AS reason FROM c""")
def chk_clearance(spark, sf):
    s = F.col("scan_id")
    rows = scans(spark, sf).select("scan_id", *[v.alias(n) for n, v in sc.clearance_summary().items() if n != "reason"]).withColumns({
        "safety_stop": s % 9 == 1, "scan_age_s": F.when(s % 7 == 2, 3.0).otherwise(0.1), "odom_age_s": F.lit(0.1), "linear_speed": F.lit(0.1)})
    return k.check_clearance(rows, ["scan_id"], 1.0, 0.2, 0.125)
