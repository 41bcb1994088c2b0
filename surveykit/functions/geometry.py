"""Angles, rotations, poses, pixels and grid coordinates as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def is_finite(c: Column) -> Column:
    """True for an ordinary number. NaN and infinities compare as values in Spark, so test them."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def all_finite(array: Column) -> Column:
    return F.forall(array, is_finite)


def hypot2(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def clamp(c: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.least(F.greatest(c, low), high)


# --- angles -----------------------------------------------------------------------------------


def quat_yaw(x: Column, y: Column, z: Column, w: Column) -> Column:
    return F.atan2((w * z + x * y) * 2.0, 1.0 - (y * y + z * z) * 2.0)


def planar_yaw(z: Column, w: Column) -> Column:
    return F.atan2(w * z * 2.0, 1.0 - z * z * 2.0)


def unit_quat(x: Column, y: Column, z: Column, w: Column) -> tuple[Column, Column, Column, Column]:
    norm = F.sqrt(x * x + y * y + z * z + w * w)
    return tuple(F.try_divide(c, norm) for c in (x, y, z, w))  # type: ignore[return-value]


def angle_delta(current: Column, start: Column) -> Column:
    """Signed shortest turn from ``start`` to ``current``."""
    d = current - start
    return F.atan2(F.sin(d), F.cos(d))


def wrap_angle(a: Column) -> Column:
    """Shift by whole turns into [-pi, pi]; both ends stay as they are."""
    turn = F.pi() * 2.0
    over = F.ceil((a - F.pi()) / turn)
    under = F.ceil((-a - F.pi()) / turn)
    return F.when(a > F.pi(), a - over * turn).when(a < -F.pi(), a + under * turn).otherwise(a)


# --- rotations and poses ------------------------------------------------------------------------


def rotate(q, v) -> tuple[Column, Column, Column]:
    """Rotate ``v`` by quaternion ``q`` (x, y, z, w)."""
    x, y, z, w = q
    a, b, c = v
    tx, ty, tz = (y * c - z * b) * 2.0, (z * a - x * c) * 2.0, (x * b - y * a) * 2.0
    return (
        a + w * tx + (y * tz - z * ty),
        b + w * ty + (z * tx - x * tz),
        c + w * tz + (x * ty - y * tx),
    )


def transform_xyz(t, q, v) -> tuple[Column, Column, Column]:
    r = rotate(q, v)
    return tuple(shift + turned for shift, turned in zip(t, r))  # type: ignore[return-value]


def compose_pose2d(a, b) -> tuple[Column, Column, Column]:
    """Pose ``a`` followed by pose ``b``; each is (x, y, yaw)."""
    c, s = F.cos(a[2]), F.sin(a[2])
    return a[0] + c * b[0] - s * b[1], a[1] + s * b[0] + c * b[1], angle_delta(a[2] + b[2], F.lit(0.0))


def mount_quat(yaw: Column, pitch: Column, roll: Column) -> tuple[Column, Column, Column, Column]:
    cy, sy = F.cos(yaw / 2), F.sin(yaw / 2)
    cp, sp = F.cos(pitch / 2), F.sin(pitch / 2)
    cr, sr = F.cos(roll / 2), F.sin(roll / 2)
    return (
        sr * cp * cy - cr * sp * sy,
        cr * sp * cy + sr * cp * sy,
        cr * cp * sy - sr * sp * cy,
        cr * cp * cy + sr * sp * sy,
    )


def laser_azimuth(q, bearing: Column) -> Column:
    """Azimuth in the laser frame of a camera ray (z ahead, x right) at ``bearing``."""
    vx, vy, _ = rotate(q, (F.sin(-bearing), F.lit(0.0), F.cos(-bearing)))
    return F.atan2(vy, vx)


def rotation_angle_deg(m: Column) -> Column:
    """Angle of a row-major 3x3 rotation."""
    trace = m[0] + m[4] + m[8]
    return F.degrees(F.acos(clamp((trace - 1.0) / 2.0, -1.0, 1.0)))


def mat3_det(m: Column) -> Column:
    return (
        m[0] * (m[4] * m[8] - m[5] * m[7])
        - m[1] * (m[3] * m[8] - m[5] * m[6])
        + m[2] * (m[3] * m[7] - m[4] * m[6])
    )


def turn_between(q0, q1) -> tuple[Column, Column]:
    """Angle between two unit quaternions on the short way round, and the sign to give ``q1``.

    The angle comes from the lengths of sum and difference, which stays exact for small turns.
    """
    add = lambda items: reduce(lambda a, b: a + b, items)
    plus = F.sqrt(add([(a + b) * (a + b) for a, b in zip(q0, q1)]))
    minus = F.sqrt(add([(a - b) * (a - b) for a, b in zip(q0, q1)]))
    theta = F.atan2(F.least(plus, minus), F.greatest(plus, minus)) * 2.0
    return theta, F.when(minus > plus, -1.0).otherwise(1.0)


def slerp_weights(theta: Column, t: Column) -> tuple[Column, Column]:
    """Weights of start and end for a share ``t`` of the turn ``theta``."""
    near = theta < 1e-7
    k0 = F.when(near, 1.0 - t).otherwise(F.try_divide(F.sin((1.0 - t) * theta), F.sin(theta)))
    k1 = F.when(near, t).otherwise(F.try_divide(F.sin(t * theta), F.sin(theta)))
    return k0, k1


def plane_pose(nx: Column, ny: Column, nz: Column, d: Column):
    """Pitch and roll in degrees and height of a ground plane with ``ny < 0``."""
    return F.degrees(F.atan2(nz, -ny)), F.degrees(F.atan2(nx, -ny)), F.abs(d)


def plausible_plane(pitch: Column, roll: Column, height: Column) -> Column:
    # fixed values: roll, pitch and height limits of a believable floor
    return (F.abs(roll) < 15.0) & (pitch > -10.0) & (pitch < 50.0) & (height > 0.04) & (height < 0.40)


# --- camera ---------------------------------------------------------------------------------------


def undistort(xn: Column, yn: Column, d: Column, rounds: int = 5) -> tuple[Column, Column]:
    """Normalised raw point to undistorted point by ``rounds`` fixed-point steps (k1 k2 p1 p2 k3)."""
    k = [F.coalesce(F.try_element_at(d, F.lit(i + 1)), F.lit(0.0)) for i in range(5)]

    def improve(acc: Column, _: Column) -> Column:
        x, y = acc["x"], acc["y"]
        r2 = x * x + y * y
        radial = 1.0 + ((k[4] * r2 + k[1]) * r2 + k[0]) * r2
        dx = k[2] * x * y * 2.0 + k[3] * (r2 + x * x * 2.0)
        dy = k[2] * (r2 + y * y * 2.0) + k[3] * x * y * 2.0
        return F.struct(((xn - dx) / radial).alias("x"), ((yn - dy) / radial).alias("y"))

    start = F.struct(xn.alias("x"), yn.alias("y"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, improve)
    return done["x"], done["y"]


def rectify_pixel(u: Column, v: Column, k: Column, d: Column, r: Column, p: Column) -> tuple[Column, Column]:
    """Raw pixel to rectified pixel: undo K and distortion, rotate by R, project by P."""
    x, y = undistort((u - k[2]) / k[0], (v - k[5]) / k[4], d)
    a = r[0] * x + r[1] * y + r[2]
    b = r[3] * x + r[4] * y + r[5]
    c = r[6] * x + r[7] * y + r[8]
    return F.try_divide(a, c) * p[0] + p[2], F.try_divide(b, c) * p[5] + p[6]


def bearing(u: Column, focal: Column, centre: Column) -> Column:
    return -F.atan((u - centre) / focal)


def backproject(u, v, z, fx, fy, cx, cy, mirror_x: bool = False):
    x = (u - cx) * z / fx
    return (-x if mirror_x else x), (v - cy) * z / fy, z


def disp_to_depth(values: Column, f: Column, baseline: Column) -> Column:
    """Depth per disparity; null unless both camera factors are positive."""
    ok = (f > 0) & (baseline > 0)
    return F.when(ok, F.transform(values, lambda d: F.when(d > 0, f * baseline / d)))


# --- grid conventions: kept apart on purpose -----------------------------------------------------


def cell_floor(x: Column, y: Column, ox, oy, res) -> tuple[Column, Column]:
    """Live grid, row 0 at the bottom, half-open cells."""
    return F.floor((x - ox) / res), F.floor((y - oy) / res)


def cell_centre_topdown(col: Column, row: Column, ox, oy, res, height) -> tuple[Column, Column]:
    """Image grid, row 0 at the top, position of the cell centre rounded to millimetres."""
    return F.round(ox + (col + 0.5) * res, 3), F.round(oy + (height - row - 0.5) * res, 3)


def plan_pixel(x: Column, y: Column, ox, oy, res, height) -> tuple[Column, Column]:
    """Floor-plan pixel as a real number, row 0 at the top, no half cell."""
    return (x - ox) / res, (height - 1) - (y - oy) / res


def patch_pixel(x: Column, y: Column, ox, oy, res, height) -> tuple[Column, Column]:
    c, r = plan_pixel(x, y, ox, oy, res, height)
    return F.rint(c), F.rint(r)


# --- motion ----------------------------------------------------------------------------------------


def twist_from_delta(delta: Column, dt: Column) -> Column:
    ok = is_finite(dt) & (dt > 1e-6) & (dt <= 1.0)
    return F.when(ok, F.try_divide(delta, dt)).otherwise(0.0)


def velocity_clamp(v: Column, limit: float) -> tuple[Column, Column]:
    """Clamped speed and whether it was changed; a non-finite request becomes 0."""
    ok = is_finite(v)
    out = F.when(ok, clamp(v, -limit, limit)).otherwise(0.0)
    return out, ~ok | (F.abs(v) > limit)


# --- polygons ---------------------------------------------------------------------------------------


def point_in_polygon(x: Column, y: Column, poly: Column) -> Column:
    """Even-odd rule over ``ARRAY<STRUCT<x,y>>``; fewer than three corners hold nothing."""
    n = F.size(poly)

    def flip(inside: Column, i: Column) -> Column:
        a = F.element_at(poly, i + 1)
        b = F.element_at(poly, F.when(i == 0, n).otherwise(i))
        spans = (a["y"] > y) != (b["y"] > y)
        # fixed value: guard added to the edge height
        at = F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"] + 1e-12) + a["x"]
        return F.when(spans & (x < at), ~inside).otherwise(inside)

    return F.when(n >= 3, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), flip)).otherwise(False)


def polygon_measure(poly: Column) -> tuple[Column, Column, Column]:
    """Area, centroid x, centroid y by the shoelace sums (null centroid for an empty area)."""
    n = F.size(poly)

    def add(acc: Column, i: Column) -> Column:
        p = F.element_at(poly, i)
        q = F.element_at(poly, F.when(i == n, 1).otherwise(i + 1))
        cross = p["x"] * q["y"] - q["x"] * p["y"]
        return F.struct(
            (acc["s"] + cross).alias("s"),
            (acc["x"] + (p["x"] + q["x"]) * cross).alias("x"),
            (acc["y"] + (p["y"] + q["y"]) * cross).alias("y"),
        )

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    sums = F.when(n >= 3, F.aggregate(F.sequence(F.lit(1), n), zero, add)).otherwise(zero)
    return (
        F.abs(sums["s"]) / 2.0,
        F.try_divide(sums["x"], sums["s"] * 3.0),
        F.try_divide(sums["y"], sums["s"] * 3.0),
    )
