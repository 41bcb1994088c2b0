"""Detection boxes: gates, suppression, conflicts, counts, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook import case
from casebook.motion import r
from casebook.views import BOX, boxes, iou_sql, log, LOG, table
from surveykit.operators import detections as d
from surveykit.operators.spatial import overlap_pairs

FRAME = ["run_id", "stamp_ns"]


@case("flt_motion_gate", f"WITH {LOG} SELECT run_id, seq FROM log WHERE abs(value / 100 - 2.5) <= 0.25 AND abs(value / 100 - 2.4) <= 0.30")
def flt_motion_gate(spark, sf):
    v = F.col("value") / 100
    return log(spark, sf).where((F.abs(v - 2.5) <= 0.25) & (F.abs(v - 2.4) <= 0.30)).select("run_id", "seq")


REASON = "CASE WHEN score < 0.2 THEN 'score' WHEN label = '_wall' THEN 'excluded' WHEN label = 'door' AND sy < 160 THEN 'bbox_h' ELSE 'ok' END"


def reasons(spark, sf):
    return boxes(spark, sf).withColumn("reason", d.detection_reason(0.2, ["_wall"], ["door"], 160.0))


@case("flt_detection", f"WITH {BOX} SELECT stamp_ns, seq, {REASON} AS reason FROM box")
def flt_detection(spark, sf):
    return reasons(spark, sf).select("stamp_ns", "seq", "reason")


@case("reject_ledger", f"""WITH {BOX}, x AS (SELECT run_id, label, {REASON} AS reason FROM box)
  SELECT run_id, label, count(*) FILTER (reason = 'ok') AS ok, count(*) FILTER (reason = 'score') AS score, count(*) FILTER (reason = 'excluded') AS excluded,
  count(*) FILTER (reason = 'bbox_h') AS bbox_h, count(*) AS total FROM x GROUP BY ALL""")
def reject_ledger(spark, sf):
    return d.reject_ledger(reasons(spark, sf), ["run_id", "label"], "reason", ["ok", "score", "excluded", "bbox_h"])


@case("flt_door_shape", f"""WITH {BOX} SELECT stamp_ns, seq FROM box WHERE NOT (label = 'door' AND (sy < 150 OR (sy < 1.4 * sx
  AND NOT (cx - sx/2 <= 1 OR cy - sy/2 <= 1 OR cx + sx/2 >= w - 1 OR cy + sy/2 >= h - 1))))""")
def flt_door_shape(spark, sf):
    return boxes(spark, sf).where(d.door_shape_ok(150.0, 1.4)).select("stamp_ns", "seq")


@case("flt_distractor", f"""WITH {BOX} SELECT stamp_ns, seq, ltrim(label, '_') AS label, CAST(list_position(['chair','table','door','window'], ltrim(label, '_')) - 1 AS INTEGER) AS cls
  FROM box WHERE label <> '_wall'""")
def flt_distractor(spark, sf):
    out = d.drop_distractors(boxes(spark, sf), ["chair", "table", "door", "window"], emit=True)
    return out.select("stamp_ns", "seq", "label", "cls")


@case("flt_sharpness", """WITH f AS (SELECT doc_id, n_chars % 100 AS sharp, [lang, source] AS dets FROM documents)
  SELECT doc_id, sharp < 30 AS skipped_blur, CASE WHEN sharp < 30 THEN 0 ELSE 2 END AS n_dets FROM f""")
def flt_sharpness(spark, sf):
    f = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 100).alias("sharpness"), F.array("lang", "source").alias("dets"))
    out = d.blur_gate(f, "dets", 30)
    return out.select("doc_id", "skipped_blur", F.size("dets").alias("n_dets"))


@case("flt_detection_row", f"""WITH {BOX}, k AS (SELECT *, CASE WHEN seq = 3 THEN score + 0.9 ELSE score END AS sc, CASE WHEN seq = 5 THEN cx + 400 ELSE cx END AS c2, seq % 5 AS cls FROM box)
  SELECT stamp_ns, seq, CASE WHEN sc < 0 OR sc > 1 OR sx <= 0 OR sy <= 0 THEN 'score_or_size' WHEN c2 - sx/2 < -1e-6 OR cy - sy/2 < -1e-6 OR c2 + sx/2 > w + 1e-6 OR cy + sy/2 > h + 1e-6
  THEN 'outside_image' WHEN cls >= 4 THEN 'class_id' WHEN (['chair','table','door','_window'])[cls + 1] <> label THEN 'class_label' END AS violation FROM k""")
def flt_detection_row(spark, sf):
    k = dirty(spark, sf)
    return k.select("stamp_ns", "seq", d.row_violation(["chair", "table", "door", "_window"]).alias("violation"))


def dirty(spark, sf):
    return (
        boxes(spark, sf)
        .withColumn("score", F.when(F.col("seq") == 3, F.col("score") + 0.9).otherwise(F.col("score")))
        .withColumn("cx", F.when(F.col("seq") == 5, F.col("cx") + 400).otherwise(F.col("cx")))
        .withColumn("cls", (F.col("seq") % 5).cast("int"))
    )


PAIR = f"""pair AS (SELECT a.run_id, a.stamp_ns, a.seq AS a, b.seq AS b, {iou_sql('a', 'b')} AS iou FROM box a JOIN box b
  ON a.stamp_ns = b.stamp_ns AND a.seq < b.seq AND a.label <> b.label)"""


@case("self_iou", f"WITH {BOX}, {PAIR} SELECT stamp_ns, a, b, round(iou, 6) AS iou FROM pair WHERE iou >= 0.6")
def self_iou(spark, sf):
    return overlap_pairs(boxes(spark, sf), FRAME, 0.6, cross_label=True).select("stamp_ns", "a", "b", r("iou").alias("iou"))


# greedy suppression as recursion over the score rank of each frame and label; kept ranks travel in a list
NMS = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, stamp_ns, label ORDER BY score DESC, seq) AS rk FROM box),
  clash AS (SELECT a.run_id, a.stamp_ns, a.label, a.rk AS lo, b.rk AS hi FROM ranked a JOIN ranked b ON a.run_id = b.run_id AND a.stamp_ns = b.stamp_ns
    AND a.label = b.label AND a.rk < b.rk WHERE {iou_sql('a', 'b')} > 0.5),
  blocked AS (SELECT r.run_id, r.stamp_ns, r.label, r.rk, r.seq, coalesce(list(c.lo) FILTER (c.lo IS NOT NULL), []) AS by
    FROM ranked r LEFT JOIN clash c ON c.run_id = r.run_id AND c.stamp_ns = r.stamp_ns AND c.label = r.label AND c.hi = r.rk GROUP BY ALL),
  go AS (SELECT run_id, stamp_ns, label, rk, seq, true AS keep, [rk] AS kept FROM blocked WHERE rk = 1
    UNION ALL SELECT b.run_id, b.stamp_ns, b.label, b.rk, b.seq, NOT list_has_any(g.kept, b.by),
      CASE WHEN list_has_any(g.kept, b.by) THEN g.kept ELSE list_append(g.kept, b.rk) END
    FROM go g JOIN blocked b ON b.run_id = g.run_id AND b.stamp_ns = g.stamp_ns AND b.label = g.label AND b.rk = g.rk + 1)"""


@case("win_nms", f"WITH RECURSIVE {BOX}, {NMS} SELECT stamp_ns, seq FROM go WHERE keep")
def win_nms(spark, sf):
    return d.nms(boxes(spark, sf)).select("stamp_ns", "seq")


AMBIG = f"""edge AS (SELECT stamp_ns, a, b FROM pair WHERE iou >= 0.6 UNION ALL SELECT stamp_ns, b, a FROM pair WHERE iou >= 0.6),
  reach(stamp_ns, s, t) AS (SELECT stamp_ns, seq, seq FROM box UNION SELECT r.stamp_ns, r.s, e.b FROM reach r JOIN edge e ON e.stamp_ns = r.stamp_ns AND e.a = r.t),
  comp AS (SELECT stamp_ns, s AS seq, min(t) AS root, count(*) AS n FROM reach GROUP BY ALL),
  best AS (SELECT stamp_ns, root, label, max(score) AS sc, arg_min(seq, struct_pack(a := -score, b := seq)) AS sq FROM box JOIN comp USING (stamp_ns, seq) WHERE n > 1 GROUP BY ALL),
  rk AS (SELECT *, row_number() OVER (PARTITION BY stamp_ns, root ORDER BY sc DESC, label) AS k, label[1] = '_' AS hid FROM best),
  v AS (SELECT stamp_ns, root, max(sc) FILTER (NOT hid) AS ps, max(sc) FILTER (hid) AS ds, arg_min(sq, k) FILTER (NOT hid) AS pq, arg_min(sq, k) FILTER (hid) AS dq,
    max(sc) FILTER (k = 1) AS s1, max(sc) FILTER (k = 2) AS s2, max(sq) FILTER (k = 1) AS q1 FROM rk GROUP BY ALL),
  win AS (SELECT stamp_ns, root, CASE WHEN ps IS NOT NULL AND ds IS NOT NULL THEN CASE WHEN ds - ps >= 0.1 THEN dq ELSE pq END WHEN s1 - s2 >= 0.1 THEN q1 END AS w FROM v)
  SELECT c.stamp_ns, c.seq, CASE WHEN c.n = 1 OR c.seq = w THEN 'kept' ELSE 'rejected' END AS verdict FROM comp c LEFT JOIN win USING (stamp_ns, root)"""


@case("win_ambiguity", f"WITH RECURSIVE {BOX}, {PAIR}, {AMBIG}")
def win_ambiguity(spark, sf):
    return d.ambiguity(boxes(spark, sf), iou=0.6).select("stamp_ns", "seq", "verdict")


@case("agg_class_counts", f"""WITH {BOX}, want AS (SELECT stamp_ns % 7 AS run_id, unnest(['chair','table','door','_window','lamp']) AS label FROM box GROUP BY 1),
  got AS (SELECT stamp_ns % 7 AS run_id, label, count(*) AS n FROM box GROUP BY ALL)
  SELECT run_id, label, coalesce(n, 0) AS n, min(coalesce(n, 0)) OVER (PARTITION BY run_id) > 0 AS complete FROM want LEFT JOIN got USING (run_id, label)""")
def agg_class_counts(spark, sf):
    b = boxes(spark, sf).withColumn("run_id", F.col("stamp_ns") % 7)
    return d.class_counts(b, b, ["chair", "table", "door", "_window", "lamp"])


@case("src_detections", f"WITH {BOX} SELECT stamp_ns, seq, label, round(score, 6) AS score FROM box")
def src_detections(spark, sf):
    """Boxes written as detection documents and read back."""
    from surveykit.session import scratch_path
    from surveykit.sources.tables import DETECTION_DOCUMENT, detection_tables

    b = boxes(spark, sf)
    det = F.struct("seq", F.lit(0).alias("cls"), "label", "score", "cx", "cy", "sx", "sy")
    frames = b.groupBy("stamp_ns").agg(F.array_sort(F.collect_list(det)).alias("dets"))
    doc = frames.select(F.lit("x-detections-v1").alias("schema"), F.array(F.struct("stamp_ns", F.lit(640).alias("w"), F.lit(480).alias("h"), F.col("dets"))).alias("frames"))
    path = scratch_path(spark, "documents")
    # one document per line here; multi-line documents are read by the same reader
    doc.write.json(path)
    lines = spark.read.schema(DETECTION_DOCUMENT).json(path).withColumn("source", F.input_file_name())
    _, _, out = detection_tables(lines)
    return out.select("stamp_ns", F.col("seq").cast("bigint").alias("seq"), "label", r("score").alias("score"))
