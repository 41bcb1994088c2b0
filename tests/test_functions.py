"""Column expressions with the values and boundary cases of the rules."""

import math

from pyspark.sql import functions as F

from surveykit.functions import geometry as g, scans as sc, text as tx
from surveykit.operators import contracts as k, detections as det
from surveykit.operators.grid.cells import cell_class


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def lit(*xs):
    return [F.lit(float(x)) for x in xs]


def test_wrap_keeps_both_ends(spark):
    got = one(spark, *[g.wrap_angle(F.lit(a)) for a in (math.pi, -math.pi, 3 * math.pi, 4.0, -4.0, 0.5)])
    want = (math.pi, -math.pi, math.pi, 4.0 - 2 * math.pi, 2 * math.pi - 4.0, 0.5)
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in zip(got, want))


def test_finite_means_an_ordinary_number(spark):
    got = one(spark, *[g.is_finite(F.lit(v).cast("double")) for v in (1.0, float("nan"), float("inf"), -float("inf"), None)])
    assert got == (True, False, False, False, False)


def test_cell_conventions_disagree_as_documented(spark):
    x, y = g.cell_centre_topdown(F.lit(0), F.lit(0), *lit(10, 20, 0.05), F.lit(100))
    x2, y2 = g.cell_centre_topdown(F.lit(0), F.lit(99), *lit(10, 20, 0.05), F.lit(100))
    c, r = g.cell_floor(*lit(-0.01, -0.01, 0, 0, 0.05))
    assert one(spark, x, y, x2, y2, c, r) == (10.025, 24.975, 10.025, 20.025, -1, -1)


def test_polygon_membership_and_measure(spark):
    square = F.expr("array(named_struct('x',0D,'y',0D), named_struct('x',2D,'y',0D), named_struct('x',2D,'y',2D), named_struct('x',0D,'y',2D))")
    inside = [g.point_in_polygon(*lit(*p), square) for p in ((1, 1), (1.4, 1), (3, 1), (-0.1, 1))]
    two = g.point_in_polygon(*lit(1, 1), F.slice(square, 1, 2))
    assert one(spark, *inside, two, *g.polygon_measure(square)) == (True, True, False, False, False, 4.0, 1.0, 1.0)


def test_rectified_pixels_without_distortion_stay(spark):
    a = lambda *xs: F.array(*lit(*xs))
    u, v = g.rectify_pixel(*lit(100, 50), a(400, 0, 320, 0, 400, 240, 0, 0, 1), a(0, 0, 0, 0), a(1, 0, 0, 0, 1, 0, 0, 0, 1), a(400, 0, 320, 0, 0, 400, 240, 0, 0, 0, 1, 0))
    got = one(spark, u, v)
    assert all(math.isclose(x, y) for x, y in zip(got, (100.0, 50.0)))


def test_depth_needs_positive_camera_factors(spark):
    v = F.array(*lit(2.0, 0.0))
    got = one(spark, g.disp_to_depth(v, *lit(100, 0.06)), g.disp_to_depth(v, *lit(100, -0.06)))
    assert got == ([3.0, None], None)


def test_twist_and_clamp_limits(spark):
    got = one(spark, *[g.twist_from_delta(*lit(1.0, dt)) for dt in (1.0, 1.0001, 1e-6, float("nan"))])
    assert got == (1.0, 0.0, 0.0, 0.0)
    v, hit = g.velocity_clamp(F.lit(float("nan")), 1.0)
    w, hit2 = g.velocity_clamp(F.lit(1.0), 1.0)
    assert one(spark, v, hit, w, hit2) == (0.0, True, 1.0, False)


def scan_frame(spark, ranges, low=0.1, high=9.0):
    n = len(ranges)
    return spark.createDataFrame([(0.0, 2 * math.pi / n, low, high, ranges)], "angle_min double, angle_increment double, range_min double, range_max double, ranges array<double>")


def test_scan_sectors(spark):
    # laser yaw is half a turn: beam n/2 looks ahead, beam 0 behind
    r = [5.0] * 8
    r[4], r[0] = 0.5, 0.12
    s = scan_frame(spark, r)
    row = s.select(sc.front_cone_min().alias("cone"), sc.scan_clip(0.3).alias("clip"), sc.turn_sweep_min(F.lit(0)).alias("none")).first()
    assert row.cone == 0.5 and row.none == 99.0
    assert row.clip[0] == 9.0 and row.clip[4] == 0.5
    r[4] = float("nan")
    row = scan_frame(spark, r).select(sc.front_cone_min().alias("cone"), sc.scan_clip(0.3).alias("clip"), F.size(sc.scan_valid()).alias("n")).first()
    assert row.cone == 99.0 and math.isnan(row.clip[4]) and row.n == 7
    few = scan_frame(spark, [1.0, 1.0] + [float("inf")] * 6).select(sc.sector_range(F.lit(-4.0), F.lit(4.0), 9.0)["range_m"]).first()
    assert few[0] is None


def test_identifiers(spark):
    good, bad = "A" * 64, "g" * 64
    got = one(spark, tx.is_sha256(F.lit(good)), tx.is_sha256(F.lit(bad)), tx.is_token(F.lit(" run-a ")), tx.is_token(F.lit("two words")), tx.is_token(F.lit("")))
    assert got == (True, False, True, False, False)
    sizes = one(spark, *[tx.parse_space(F.lit(x)) for x in ("700M", "2g", "15", "0K", "1.5G", "", "5T")])
    assert sizes == (734003200, 2147483648, 15, None, None, None, None)
    assert one(spark, tx.csv_labels(F.lit(" door, chair,,door ,")))[0] == ["door", "chair"]
    assert one(spark, tx.canonical_frame(F.lit(" //base_link ")))[0] == "base_link"


def test_numbers_keep_seventeen_digits_and_hash_ignores_key_order(spark):
    got = one(spark, tx.text17(F.lit(0.1)), tx.map_number(F.lit(-0.0)), tx.text17(F.lit(1e22)), tx.text17(F.lit(5.0)))
    assert got == (format(0.1, ".17g"), "0", "1e+22", "5")
    a = tx.canonical_sha({"b": F.lit(1), "a": F.lit("x")})
    b = tx.canonical_sha({"a": F.lit("x"), "b": F.lit(1)})
    import hashlib

    h = one(spark, a, b)
    assert h[0] == h[1] == hashlib.sha256(b'{"a":"x","b":1}').hexdigest()


def test_best_text_wants_a_letter_or_digit(spark):
    c = F.expr("array(named_struct('text',' -- ','confidence',0.9D), named_struct('text',' 12B ','confidence',0.4D), named_struct('text','x','confidence',0.0D))")
    assert one(spark, tx.best_text(c), tx.best_text(F.slice(c, 1, 1))) == ("12B", None)


def test_mount_and_edge(spark):
    m = tx.camera_mount(F.lit("0.1, 0 0.2 0.3 0 0"))
    assert one(spark, m, tx.camera_mount(F.lit("1 2 3")), tx.camera_mount(F.lit("1 2 3 4 5 nan"))) == ([0.1, 0.0, 0.2, 0.3, 0.0, 0.0], None, None)
    q = g.mount_quat(*lit(0.3, 0, 0))
    base = {"parent": F.lit("/base_footprint"), "child": F.lit("stereo_left_optical"), "tx": F.lit(0.1), "ty": F.lit(0.0), "tz": F.lit(0.2), "mount": m}
    row = spark.range(1).select(*[v.alias(n) for n, v in base.items()], *[c.alias(n) for c, n in zip(q, ("qx", "qy", "qz", "qw"))])
    assert row.select(k.edge_matches()).first()[0] is True
    assert row.withColumn("tx", F.lit(0.10002)).select(k.edge_matches()).first()[0] is False


def test_grid_classes_differ_by_flavour(spark):
    got = one(spark, *[cell_class(F.lit(v), s) for v, s in ((60, "segment"), (60, "plan"), (245, "plan"), (245, "segment"), (205, "exact"), (49, "live"), (-1, "live"))])
    assert got == ("unknown", "occ", "free", "unknown", "unknown", "free", "unknown")


def test_piecewise_uses_last_started_segment(spark):
    seg = [(0, 1.5), (10, 4.0)]
    assert one(spark, *[det.piecewise(F.lit(t), seg) for t in (-1, 0, 9, 10)]) == (None, 1.5, 1.5, 4.0)
