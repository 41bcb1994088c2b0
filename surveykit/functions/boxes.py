"""Detection boxes (centre and size) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _corners(b):
    return (
        b["cx"] - b["sx"] / 2.0,
        b["cy"] - b["sy"] / 2.0,
        b["cx"] + b["sx"] / 2.0,
        b["cy"] + b["sy"] / 2.0,
    )


def box_iou(a, b) -> Column:
    """Overlap share of two boxes given as structs or dicts with cx, cy, sx, sy; 0 without area."""
    ax1, ay1, ax2, ay2 = _corners(a)
    bx1, by1, bx2, by2 = _corners(b)
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(ax2, bx2) - F.greatest(ax1, bx1)) * F.greatest(
        zero, F.least(ay2, by2) - F.greatest(ay1, by1)
    )
    size_a = F.greatest(zero, ax2 - ax1) * F.greatest(zero, ay2 - ay1)
    size_b = F.greatest(zero, bx2 - bx1) * F.greatest(zero, by2 - by1)
    union = size_a + size_b - inter
    return F.when(union > 0, F.try_divide(inter, union)).otherwise(0.0)


def side(prefix: str = "", suffix: str = "") -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}{suffix}") for k in ("cx", "cy", "sx", "sy")}


def orient_back(x1, y1, x2, y2, width, height, orient: Column):
    """Corners of a box found in a flipped frame, mapped to the source frame."""
    lr = orient.isin("lr", "rot180")
    ud = orient.isin("ud", "rot180")
    return (
        F.when(lr, width - x2).otherwise(x1),
        F.when(ud, height - y2).otherwise(y1),
        F.when(lr, width - x1).otherwise(x2),
        F.when(ud, height - y1).otherwise(y2),
    )


def orient_centre(cx, cy, width, height, orient: Column):
    """Principal point of the flipped frame."""
    lr = orient.isin("lr", "rot180")
    ud = orient.isin("ud", "rot180")
    return F.when(lr, (width - 1) - cx).otherwise(cx), F.when(ud, (height - 1) - cy).otherwise(cy)


def level_warp(u: Column, v: Column, fx, fy, cx, cy, pitch_deg: Column, inverse: bool = True):
    """Pixel under K Rx K^-1 for a camera pitched up; ``inverse`` maps the levelled frame back."""
    a = F.radians(-pitch_deg if inverse else pitch_deg)
    xn, yn = (u - cx) / fx, (v - cy) / fy
    c, s = F.cos(a), F.sin(a)
    y2, z2 = yn * c - s, yn * s + c
    return F.try_divide(xn, z2) * fx + cx, F.try_divide(y2, z2) * fy + cy


def warp_box_back(x1, y1, x2, y2, fx, fy, cx, cy, pitch_deg: Column):
    """Smallest upright box around the four back-warped corners."""
    pts = [level_warp(u, v, fx, fy, cx, cy, pitch_deg) for u in (x1, x2) for v in (y1, y2)]
    us, vs = [p[0] for p in pts], [p[1] for p in pts]
    return F.least(*us), F.least(*vs), F.greatest(*us), F.greatest(*vs)


def clip_box(x1, y1, x2, y2, width, height) -> dict[str, Column]:
    """Cut to the image; ``keep`` is false for an empty rest."""
    zero = F.lit(0.0)
    w, h = width.cast("double"), height.cast("double")
    a, b = F.greatest(zero, F.least(x1, w)), F.greatest(zero, F.least(y1, h))
    c, d = F.greatest(zero, F.least(x2, w)), F.greatest(zero, F.least(y2, h))
    return {
        "cx": (a + c) / 2.0,
        "cy": (b + d) / 2.0,
        "sx": c - a,
        "sy": d - b,
        "keep": (c > a) & (d > b),
    }
