"""Ground-plane fits per frame, counted over all points of a frame."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from surveykit.operators.detections import seeded_cap
from surveykit.session import settle

#: points of a frame that candidate planes are drawn through; inliers are counted over all of its points
DRAWN = 96


def believable(n: Column, d: Column) -> Column:
    """Whether a plane can be the floor in front of the camera (fixed values: limits of roll, pitch, height)."""
    roll = F.degrees(F.atan2(n["x"], -n["y"]))
    pitch = F.degrees(F.atan2(n["z"], -n["y"]))
    return (F.abs(roll) < 15) & (pitch > -10) & (pitch < 50) & (F.abs(d) > 0.04) & (F.abs(d) < 0.40)


def _candidates(points: DataFrame, keys: list[str], hypotheses: int, seed: int) -> DataFrame:
    """``keys, no, n, d``: believable planes through three drawn points of the frame, facing up (y negative)."""
    drawn = seeded_cap(points, keys, ["x", "y", "z"], DRAWN, seed).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x", "y", "z"))).alias("p"))
    turn = lambda k: F.get("p", F.pmod(F.xxhash64("no", F.lit(seed), F.lit(k)), F.size("p")).cast("int"))
    numbered = drawn.withColumn("no", F.explode(F.sequence(F.lit(0), F.lit(hypotheses - 1))))
    triples = settle(numbered.select(*keys, "no", *(turn(k).alias(c) for k, c in enumerate("abc"))))
    u = {c: F.col("b")[c] - F.col("a")[c] for c in "xyz"}
    v = {c: F.col("c")[c] - F.col("a")[c] for c in "xyz"}
    cross = {"x": u["y"] * v["z"] - u["z"] * v["y"], "y": u["z"] * v["x"] - u["x"] * v["z"], "z": u["x"] * v["y"] - u["y"] * v["x"]}
    size = F.sqrt(sum((c * c for c in cross.values()), F.lit(0.0)))
    sized = settle(triples.select(*keys, "no", "a", *(c.alias(f"c{k}") for k, c in cross.items()), size.alias("size")))
    # points on one line span no plane
    up = F.when(F.col("size") > 1e-9, F.when(F.col("cy") > 0, -F.col("size")).otherwise(F.col("size")))
    facing = sized.select(*keys, "no", "a", F.struct(*((F.col(f"c{k}") / up).alias(k) for k in "xyz")).alias("n"))
    planes = facing.withColumn("d", -(F.col("n.x") * F.col("a.x") + F.col("n.y") * F.col("a.y") + F.col("n.z") * F.col("a.z")))
    return planes.where(F.col("d").isNotNull()).where(believable(F.col("n"), F.col("d"))).select(*keys, "no", "n", "d")


def _refitted(keys: list[str]):
    """From the moments of the inliers to the plane of least squares."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[[*keys, "m"]].rename(columns={"m": "inliers"})
            mean = pdf[["mx", "my", "mz"]].to_numpy(np.float64)
            c = {k: pdf[k].to_numpy(np.float64) for k in ("xx", "xy", "xz", "yy", "yz", "zz")}
            cov = np.stack([c[k] for k in ("xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz")], axis=1).reshape(-1, 3, 3)
            normal = np.linalg.eigh(cov)[1][:, :, 0] if len(pdf) else np.zeros((0, 3))
            normal = np.where(normal[:, 1:2] > 0, -normal, normal)
            yield out.assign(nx=normal[:, 0], ny=normal[:, 1], nz=normal[:, 2], d=-(normal * mean).sum(axis=1))

    return run


def fit_planes(points: DataFrame, keys: Sequence[str], hypotheses: int = 400, tolerance: float = 0.02, min_inliers: int = 300, seed: int = 0) -> DataFrame:
    """One believable floor plane per frame: normal, offset and inlier count.

    Planes through drawn triples are candidates; every point of the frame counts for each candidate it lies
    on, in partial sums that are added up. The best one is refitted to the moments of its inliers. No task
    holds a frame. Other draws give planes that agree within the inlier tolerance.
    """
    keys = list(keys)
    points = settle(points.select(*keys, "x", "y", "z"))
    planes = settle(_candidates(points, keys, hypotheses, seed))
    away = F.abs(F.col("n.x") * F.col("x") + F.col("n.y") * F.col("y") + F.col("n.z") * F.col("z") + F.col("d"))
    # a frame has at most ``hypotheses`` planes; the pairs are counted where they arise and never shuffled
    met = points.join(planes, keys).where(away < tolerance)
    hits = met.groupBy(*keys, "no").agg(F.count("*").alias("hits")).where(F.col("hits") >= min_inliers)
    best = hits.groupBy(*keys).agg(F.min_by("no", F.struct(-F.col("hits"), "no")).alias("no"))
    inliers = points.join(planes.join(best, [*keys, "no"]), keys).where(away < tolerance)
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    moments = inliers.groupBy(*keys).agg(F.count("*").alias("m"), *(F.avg(c).alias(f"m{c}") for c in "xyz"), *(F.covar_pop(a, b).alias(a + b) for a, b in pairs))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema if f.name in keys)
    out = moments.mapInPandas(_refitted(keys), f"{ddl}, inliers bigint, nx double, ny double, nz double, d double")
    sure = believable(F.struct(F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("nz").alias("z")), F.col("d"))
    return out.where(sure).select(*keys, "nx", "ny", "nz", "d", "inliers")
