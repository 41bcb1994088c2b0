"""Inputs of the placement chain, all derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.views import HOUR, boxes, cells, log, vectors
from surveykit.plans.pipelines import PlaceParams, place_detections

START = 1_704_067_200_000_000_000  # first day of the log


def inputs(spark, sf):
    run = F.lit(0).cast("bigint")
    at = F.lit(START).cast("bigint") + F.floor(F.col("vec_id") / 10) * 12 * HOUR
    v = vectors(spark, sf)
    e = lambda i: F.element_at("e", i)
    # a small camera: 64 columns, ten rows, each vector is one image row of its frame
    b = boxes(spark, sf).select(
        "run_id", (F.lit(START).cast("bigint") + F.col("stamp_ns") * 12 * HOUR).alias("stamp_ns"), "seq", "label", F.lit(0).alias("cid"),
        F.least(F.lit(1.0), F.col("score") + 0.5).alias("score"),
        (F.lit(32.0) + (F.col("cx") - 320) / 4).alias("cx"), (F.lit(5.0) + (F.col("cy") - 240) / 40).alias("cy"), (F.col("sx") / 6).alias("sx"), (F.col("sy") / 40).alias("sy"))
    disparity = v.select(
        run.alias("run_id"), at.alias("stamp_ns"), (F.col("vec_id") % 10).cast("int").alias("row"), F.lit(50.0).alias("f"), F.lit(0.06).alias("baseline"),
        F.lit(0.0).alias("min_d"), F.lit(64.0).alias("max_d"), F.transform("e", lambda x: x * 4 + 2.0).alias("values"))
    arr = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    info = v.select(run.alias("run_id")).distinct().select(
        "run_id", arr([50, 0, 32, 0, 50, 5, 0, 0, 1]).alias("k"), arr([0, 0, 0, 0, 0]).alias("d"), arr([1, 0, 0, 0, 1, 0, 0, 0, 1]).alias("r"),
        arr([50, 0, 32, 0, 0, 50, 5, 0, 0, 0, 1, 0]).alias("p"))
    l = log(spark, sf)
    odom = l.where("topic = 'view'").select(run.alias("run_id"), "stamp_ns", "seq", (F.col("value") / 1500).alias("vx"), (F.col("value") / 2000).alias("wz"))
    half = F.col("value") / 400
    tf = l.where("topic = 'click'").select(
        run.alias("run_id"), "stamp_ns", "seq", (F.col("value") / 500 - 0.5).alias("tx"), (F.col("value") / 700 - 0.3).alias("ty"), F.lit(0.0).alias("tz"),
        F.sin(half).alias("qx"), F.lit(0.0).alias("qy"), F.lit(0.0).alias("qz"), F.cos(half).alias("qw"))
    grid = cells(spark, sf).groupBy("col", "row").agg(F.max("value").alias("value")).select(run.alias("run_id"), "col", "row", "value")
    return b, info, disparity, odom, tf, grid


PARAMS = PlaceParams(
    score_min=0.5, odom_age_ns=3 * HOUR, tf_slip_ns=6 * HOUR, bucket_ns=10 * 24 * HOUR, min_hits=2, max_spread_m=0.6, occupied_radius_m=0.6,
    depth={"min_samples": 6, "roi_scale": 0.6})


def placed(spark, sf):
    """Reason counts of all boxes next to the number of confirmed points."""
    b, info, disparity, odom, tf, grid = inputs(spark, sf)
    seen, points = place_detections(b, info, disparity, odom, tf, grid, 0.05, -3.2, -3.2, PARAMS)
    reasons = seen.groupBy("reason").agg(F.count("*").alias("n"))
    return reasons.unionByName(points.agg(F.count("*").alias("n")).select(F.lit("confirmed").alias("reason"), "n"))
