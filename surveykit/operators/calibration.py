"""Stereo calibration residuals, outliers, spreads and quality gates as table jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from surveykit.functions.geometry import all_finite, is_finite
from surveykit.operators.contracts import all_reasons, first_reason
from surveykit.operators.quantile import group_percentiles
from surveykit.operators.spatial import listed
from surveykit.session import discard, settle


def view_residuals(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RMS reprojection (dx, dy) and RMS rectified-row offset (dy_rect) per view."""
    return points.groupBy(*keys, "view").agg(
        F.sqrt(F.avg(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).alias("reproj_rms"),
        F.sqrt(F.avg(F.col("dy_rect") * F.col("dy_rect"))).alias("epi_rms"),
        F.count("*").alias("points"),
    )


def epipolar_summary(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RMS and 95th percentile of the absolute rectified-row offset over all points."""
    keys = list(keys)
    rms = points.groupBy(*keys).agg(F.sqrt(F.avg(F.col("dy_rect") * F.col("dy_rect"))).alias("epipolar_rms"))
    p95 = group_percentiles(points.withColumn("_a", F.abs("dy_rect")), keys, "_a", {"epipolar_p95": 0.95}).drop("n")
    return rms.join(p95, keys)


def outlier_view(views: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Worst view per calibration if it exceeds ``max(1, median + 3 * 1.4826 * MAD)``, else null."""
    keys = list(keys)
    s = views.withColumn("score", F.greatest("left_rms", "right_rms", "epi_rms"))
    med = group_percentiles(s, keys, "score", {"median": 0.5}).drop("n")
    gaps = s.join(med, keys).withColumn("_gap", F.abs(F.col("score") - F.col("median")))
    mad = group_percentiles(gaps, keys, "_gap", {"mad": 0.5}).drop("n")
    worst = s.groupBy(*keys).agg(F.max_by(F.struct("view", "score"), F.struct("score", -F.col("view"))).alias("w"))
    # fixed values: floor, factor and normal-consistency constant of the limit
    limit = F.greatest(F.lit(1.0), F.col("median") + F.col("mad") * 3.0 * 1.4826)
    return worst.join(med, keys).join(mad, keys).select(
        *keys, limit.alias("limit"), F.col("w.score").alias("worst_score"), F.when(F.col("w.score") > limit, F.col("w.view")).alias("outlier")
    )


#: the last mesh tried; cells of one direction each end the search before
_FINEST = 2.0**-50
#: what bounds may be off by through rounding
_SLACK = 1e-12


def _direction_cell(mesh: float) -> Column:
    """Cell of a unit vector on the cube around the sphere."""
    return F.struct(*[F.floor(F.col(f"n{a}") / mesh).alias(a) for a in "xyz"])


def _length(parts: Sequence[Column]) -> Column:
    return F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2])


def pose_spread(normals: DataFrame, keys: Sequence[str], mesh: float = 0.25) -> DataFrame:
    """Largest angle between two board normals of a calibration, in degrees.

    Directions are grouped into cells of half the mesh per round. The box around a cell's members bounds the difference
    and the sum of two members, and the widest pair has the longest difference and the shortest sum, so a pair of cells
    that can't hold it by either is dropped; only pairs that are left are split. A cell keeps a handful of partners, so
    the pairs of a round follow the number of views, and members are compared once few pairs of them are left.
    """
    keys = list(keys)
    norm = _length([F.col(f"n{a}") for a in "xyz"])
    unit = normals.select(*keys, *[F.try_divide(F.col(f"n{a}"), norm).alias(f"n{a}") for a in "xyz"])
    unit = settle(unit.where("nx is not null").distinct())
    few = 16 * unit.count() + 10_000
    live = found = None
    while True:
        parent = [] if live is None else [_direction_cell(2.0 * mesh).alias("parent")]
        placed = unit.select(*keys, *parent, _direction_cell(mesh).alias("cell"), "nx", "ny", "nz")
        names = [*keys, *(["parent"] if parent else []), "cell"]
        cells = placed.groupBy(*names).agg(
            F.count("*").alias("n"), *[f(f"n{x}").alias(f"{p}{x}") for x in "xyz" for f, p in ((F.min, "a"), (F.max, "b"))])
        reach = _length([F.col(f"b{x}") - F.col(f"a{x}") for x in "xyz"]) / 2.0
        cells = cells.select(*names, "n", *[((F.col(f"a{x}") + F.col(f"b{x}")) / 2.0).alias(f"c{x}") for x in "xyz"], (reach * (1 + 1e-9)).alias("r"))
        side = lambda s: cells.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in cells.columns if c not in keys])
        if live is None:
            pair = side("a").join(side("b"), keys).where("cell_a <= cell_b").withColumns({"shortest": F.lit(2.0), "longest": F.lit(0.0)})
        else:
            pair = listed(listed(live).join(side("a"), [*keys, "parent_a"])).join(side("b"), [*keys, "parent_b"])
        wide = F.col("r_a") + F.col("r_b")
        apart = _length([F.col(f"c{x}_a") - F.col(f"c{x}_b") for x in "xyz"])
        both = _length([F.col(f"c{x}_a") + F.col(f"c{x}_b") for x in "xyz"])
        hopeful = (F.col("both") - F.col("wide") <= F.col("shortest") + _SLACK) & (F.col("apart") + F.col("wide") >= F.col("longest") - _SLACK)
        pair = pair.select(*keys, "cell_a", "cell_b", (F.col("n_a") * F.col("n_b")).alias("n"), apart.alias("apart"), both.alias("both"), wide.alias("wide"), "shortest", "longest")
        pair = settle(pair.where(hopeful))
        best = pair.groupBy(*keys).agg(F.least(F.min(F.col("both") + F.col("wide")), F.first("shortest")).alias("shortest"), F.greatest(F.max(F.col("apart") - F.col("wide")), F.first("longest")).alias("longest"))
        kept = settle(pair.drop("shortest", "longest").join(best, keys).where(hopeful).select(
            *keys, F.col("cell_a").alias("parent_a"), F.col("cell_b").alias("parent_b"), "n", "wide", "shortest", "longest"))
        discard(pair)
        left = kept.agg(F.sum("n").alias("n"), F.max("wide").alias("wide")).first()
        used = kept.select(*keys, F.explode(F.array("parent_a", "parent_b")).alias("cell")).distinct()
        before, unit = unit, settle(unit.withColumn("cell", _direction_cell(mesh)).join(used, [*keys, "cell"], "left_semi").drop("cell"))
        discard(before)
        if found is not None:
            discard(found)
        found, live = kept, kept.drop("n", "wide")
        if (left.n or 0) <= few or not left.wide or mesh <= _FINEST:
            break
        mesh /= 2.0
    placed = unit.withColumn("parent", _direction_cell(mesh))
    ends = lambda s: placed.select(*keys, F.col("parent").alias(f"parent_{s}"), *[F.col(f"n{x}").alias(f"n{x}_{s}") for x in "xyz"])
    met = listed(listed(live).join(ends("a"), [*keys, "parent_a"])).join(ends("b"), [*keys, "parent_b"])
    dot = sum((F.col(f"n{x}_a") * F.col(f"n{x}_b") for x in "yz"), F.col("nx_a") * F.col("nx_b"))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min(dot)))))
    widest = met.groupBy(*keys).agg(angle.alias("_angle"))
    # rounding can make a direction differ from itself by a hair, one view alone has no spread
    many = normals.groupBy(*keys).agg(F.count("*").alias("_views"))
    return widest.join(many, keys).select(*keys, F.when(F.col("_views") > 1, F.col("_angle")).otherwise(0.0).alias("pose_spread_deg"))


def loo_summary(drops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Leave-one-out summary: focal range, whether all passed, largest RMS."""
    return drops.groupBy(*keys).agg(
        F.count("*").alias("drops"),
        F.min("focal").alias("focal_min"),
        F.max("focal").alias("focal_max"),
        F.bool_and("passed").alias("all_passed"),
        F.max("rms").alias("rms_max"),
    )


# fixed values: hard limits of an accepted calibration
LIMITS = {
    "min_views": 20, "mono_rms": 1.0, "stereo_rms": 1.2, "epipolar_rms": 0.8, "epipolar_p95": 1.5,
    "baseline_lo": 0.045, "baseline_hi": 0.075, "rotation_deg": 10.0, "spread_deg": 10.0,
    "focal_lo": 0.35, "focal_hi": 1.35, "focal_gap": 0.25, "centre_lo": 0.15, "centre_hi": 0.85,
}


def quality(reports: DataFrame, keys: Sequence[str], limits: dict[str, float] = LIMITS) -> DataFrame:
    """All violated gates of a calibration report, comma separated; empty means acceptable."""
    c = F.col
    lim = limits
    scalars = ["left_rms", "right_rms", "stereo_rms", "epipolar_rms", "epipolar_p95", "baseline_m", "translation_norm_m", "rotation_deg", "pose_spread_deg"]
    finite = F.lit(True)
    for s in scalars:
        finite = finite & is_finite(c(s))
    focals = [c("k1")[0], c("k1")[4], c("k2")[0], c("k2")[4]]
    w, h = c("width").cast("double"), c("height").cast("double")
    focal_bad = F.lit(False)
    for f in focals:
        focal_bad = focal_bad | (f < w * lim["focal_lo"]) | (f > w * lim["focal_hi"])

    def gap(i: int) -> Column:
        a, b = c("k1")[i], c("k2")[i]
        return F.abs(a - b) / F.greatest(F.lit(1e-9), F.abs(a + b) * 0.5) > lim["focal_gap"]

    def centre(k: str) -> Column:
        x, y = c(k)[2], c(k)[5]
        return ~(x.between(w * lim["centre_lo"], w * lim["centre_hi"]) & y.between(h * lim["centre_lo"], h * lim["centre_hi"]))

    rules = [
        ("nonfinite", ~finite),
        ("views", c("views_used") < lim["min_views"]),
        ("left_rms", c("left_rms") > lim["mono_rms"]),
        ("right_rms", c("right_rms") > lim["mono_rms"]),
        ("stereo_rms", c("stereo_rms") > lim["stereo_rms"]),
        ("epipolar_rms", c("epipolar_rms") > lim["epipolar_rms"]),
        ("epipolar_p95", c("epipolar_p95") > lim["epipolar_p95"]),
        ("baseline", ~c("baseline_m").between(lim["baseline_lo"], lim["baseline_hi"])),
        ("translation", ~c("translation_norm_m").between(lim["baseline_lo"], lim["baseline_hi"])),
        ("projection_shape", (F.size("p1") != 12) | (F.size("p2") != 12)),
        ("projection_focal", (c("p1")[0] <= 0) | (c("p1")[5] <= 0) | (c("p2")[0] <= 0) | (c("p2")[5] <= 0)),
        ("left_offset", F.abs(c("p1")[3]) > 1e-6),
        ("right_offset", c("p2")[3] >= 0),
        ("rotation", c("rotation_deg") > lim["rotation_deg"]),
        ("pose_spread", c("pose_spread_deg") < lim["spread_deg"]),
        ("image_size", (c("width") <= 0) | (c("height") <= 0)),
        ("focal_range", focal_bad),
        ("focal_fx", gap(0)),
        ("focal_fy", gap(4)),
        ("left_centre", centre("k1")),
        ("right_centre", centre("k2")),
        ("matrix_nonfinite", ~all_finite(F.concat("k1", "k2", "p1", "p2"))),
    ]
    reasons = all_reasons(rules)
    return reports.select(*keys, reasons.alias("reasons"), (reasons == "").alias("ok"))


def calibration_file(files: DataFrame, keys: Sequence[str], name: str, width: int, height: int) -> DataFrame:
    """Stored camera file rows: name, size, matrix shapes, finite values, distortion."""
    c = F.col

    def matrix(m: str, rows: int, cols: int) -> list[tuple[str, Column]]:
        return [
            (f"{m}_shape", (c(m)["rows"] != rows) | (c(m)["cols"] != cols) | (F.size(c(m)["data"]) != rows * cols)),
            (f"{m}_finite", ~all_finite(c(m)["data"])),
        ]

    d = c("distortion")
    rules = [("camera_name", c("camera_name") != name), ("size", (c("width") != width) | (c("height") != height))]
    rules += matrix("camera_matrix", 3, 3) + matrix("rectification", 3, 3) + matrix("projection", 3, 4)
    rules += [
        ("distortion", (d["rows"] != 1) | (d["cols"] != F.size(d["data"])) | (F.size(d["data"]) < 4) | ~all_finite(d["data"])),
        ("model", ~c("model").isin("plumb_bob", "rational_polynomial")),
    ]
    return files.select(*keys, first_reason(rules).alias("reason"))


def samples(rows: DataFrame, keys: Sequence[str], columns: int, rows_: int, square: float, width: int, height: int) -> DataFrame:
    """Stored sample sequence: contiguous index, same board and image size, point counts and positions.

    Contiguity needs no ordering: n distinct indices between 1 and n.
    """
    n = columns * rows_
    c = F.col
    board = (c("board_columns") != columns) | (c("board_rows") != rows_) | (F.abs(c("square_size") - square) > 1e-9)
    size = (c("width") != width) | (c("height") != height)
    expected = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rows_ - 1)), lambda y: F.transform(
        F.sequence(F.lit(0), F.lit(columns - 1)), lambda x: F.struct((x * square).alias("x"), (y * square).alias("y"), F.lit(0.0).alias("z")))))
    off = F.zip_with("object_points", expected, lambda p, q: F.abs(p["x"] - q["x"]) + F.abs(p["y"] - q["y"]) + F.abs(p["z"] - q["z"]))
    points = (F.size("object_points") != n) | (F.size("left_points") != n) | (F.size("right_points") != n)
    bad = first_reason([("board", board), ("image_size", size), ("points", points), ("object_points", ~F.forall(off, lambda v: v <= 1e-6))], "")
    g = rows.withColumn("_bad", bad).groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_distinct("sample_index").alias("d"), F.min("sample_index").alias("lo"), F.max("sample_index").alias("hi"), F.max("_bad").alias("worst")
    )
    contiguous = (c("lo") == 1) & (c("hi") == c("n")) & (c("d") == c("n"))
    return g.select(*keys, F.when(~contiguous, "index").when(c("worst") != "", c("worst")).otherwise("ok").alias("reason"))
