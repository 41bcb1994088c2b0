"""Laser-scan rules as array expressions; a scan stays one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from surveykit.functions.geometry import angle_delta, is_finite, wrap_angle

# fixed values: mounting yaw of the laser, sector half widths (rad), range limits (m)
LASER_YAW = 3.141592653589793
HEAD_HALF = 1.05
HEAD_FLOOR = 0.16
CONE_HALF = 0.70
SHOULDER_HALF = 1.05
RANGE_FLOOR = 0.18
RANGE_CAP = 8.0
CLEAR = 99.0


def angle_of(i: Column) -> Column:
    return F.col("angle_min") + i * F.col("angle_increment")


def _in_limits(r: Column) -> Column:
    return is_finite(r) & (r >= F.col("range_min")) & (r <= F.col("range_max"))


def scan_valid() -> Column:
    """Finite returns inside the sensor limits."""
    return F.filter(F.col("ranges"), _in_limits)


def scan_clip(min_range: float) -> Column:
    """Replace body echoes by ``range_max``; keep true near returns ahead of the head."""

    def one(r: Column, i: Column) -> Column:
        head = (F.abs(wrap_angle(angle_of(i) + LASER_YAW)) < HEAD_HALF) & (r >= HEAD_FLOOR)
        return F.when(is_finite(r) & (r < min_range) & ~head, F.col("range_max")).otherwise(r)

    return F.transform(F.col("ranges"), one)


def beams_where(keep: Callable[[Column, Column], Column]) -> Column:
    """Ranges whose (range, angle) satisfy ``keep``."""
    pairs = F.transform(F.col("ranges"), lambda r, i: F.struct(r.alias("r"), angle_of(i).alias("a")))
    return F.transform(F.filter(pairs, lambda p: keep(p["r"], p["a"])), lambda p: p["r"])


def _braking(r: Column) -> Column:
    low = F.greatest(F.col("range_min"), F.lit(RANGE_FLOOR))
    high = F.least(F.col("range_max"), F.lit(RANGE_CAP))
    return is_finite(r) & (r >= low) & (r <= high)


def front_cone_min() -> Column:
    hits = beams_where(lambda r, a: _braking(r) & (F.abs(wrap_angle(a + LASER_YAW)) < CONE_HALF))
    return F.coalesce(F.array_min(hits), F.lit(CLEAR))


def turn_sweep_min(sign: Column) -> Column:
    """Nearest return in the open shoulder on the side the turn moves into."""

    def swept(r: Column, a: Column) -> Column:
        b = wrap_angle(a + LASER_YAW)
        left = (sign > 0) & (b > 0) & (b < SHOULDER_HALF)
        right = (sign < 0) & (b < 0) & (b > -SHOULDER_HALF)
        return _braking(r) & (left | right)

    return F.coalesce(F.array_min(beams_where(swept)), F.lit(CLEAR))


def clearance_summary() -> dict[str, Column]:
    """Valid count and minima overall, along the axis, ahead and behind, with a reason when unusable."""

    def near(a: Column, centre: float) -> Column:
        return F.abs(angle_delta(a, F.lit(centre))) <= CONE_HALF

    ahead = beams_where(lambda r, a: _in_limits(r) & near(a + LASER_YAW, 0.0))
    behind = beams_where(lambda r, a: _in_limits(r) & near(a + LASER_YAW, LASER_YAW))
    along = beams_where(lambda r, a: _in_limits(r) & (near(a, 0.0) | near(a, LASER_YAW)))
    valid = scan_valid()
    usable = (F.size(valid) > 0) & (F.size(along) > 0) & (F.size(ahead) > 0) & (F.size(behind) > 0)
    return {
        "n_valid": F.size(valid).cast("long"),
        "min_all": F.array_min(valid),
        "min_longitudinal": F.array_min(along),
        "min_forward": F.array_min(ahead),
        "min_backward": F.array_min(behind),
        "reason": F.when(usable, "ok").otherwise("no_usable_clearance"),
    }


def quadrant_min() -> dict[str, Column]:
    pi = LASER_YAW
    pairs = F.transform(F.col("ranges"), lambda r, i: F.struct(r.alias("r"), angle_of(i).alias("a")))
    best = F.array_min(F.filter(pairs, lambda p: _in_limits(p["r"])))

    def quarter(centre: float) -> Column:
        return F.array_min(
            beams_where(lambda r, a: _in_limits(r) & (F.abs(angle_delta(a, F.lit(centre))) < pi / 4))
        )

    return {
        "min_m": best["r"],
        "angle_deg": F.degrees(best["a"]),
        "front": quarter(0.0),
        "left": quarter(pi / 2),
        "back": quarter(pi),
        "right": quarter(-pi / 2),
    }


def sorted_quantile(sorted_array: Column, q: float) -> Column:
    """Linear percentile of an ascending array that already sits in one row."""
    pos = (F.size(sorted_array) - 1) * F.lit(float(q))
    low = F.element_at(sorted_array, (F.floor(pos) + 1).cast("int"))
    high = F.element_at(sorted_array, (F.ceil(pos) + 1).cast("int"))
    weight = pos - F.floor(pos)
    return F.when(F.size(sorted_array) > 0, F.when(low == high, low).otherwise(low + (high - low) * weight))


def sector_range(low: Column, high: Column, iqr_max: float) -> dict[str, Column]:
    """Median return of a sector; null with fewer than three returns or a wide spread."""

    def inside(r: Column, a: Column) -> Column:
        w = F.atan2(F.sin(a), F.cos(a))
        strict = is_finite(r) & (r > F.col("range_min")) & (r < F.col("range_max"))
        return (w >= low) & (w <= high) & strict

    hits = F.array_sort(beams_where(inside))
    spread = sorted_quantile(hits, 0.75) - sorted_quantile(hits, 0.25)
    ok = (F.size(hits) >= 3) & (spread <= iqr_max)
    return {
        "samples": F.size(hits).cast("long"),
        "iqr": F.when(F.size(hits) > 0, spread),
        "range_m": F.when(ok, sorted_quantile(hits, 0.5)),
    }
