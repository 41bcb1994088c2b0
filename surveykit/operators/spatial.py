"""Joins in the plane and between boxes. Everything is an equi join on grid cells plus an exact test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from surveykit.functions.boxes import box_iou
from surveykit.functions.geometry import clamp, hypot2, point_in_polygon


def _span(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def _cells(x0: Column, x1: Column, y0: Column, y1: Column, size: float) -> Column:
    rows = _span(y0, y1, size)
    return F.flatten(
        F.transform(_span(x0, x1, size), lambda gx: F.transform(rows, lambda gy: F.struct(gx.alias("gx"), gy.alias("gy"))))
    )


def listed(rows: DataFrame) -> DataFrame:
    """Rows that are listed once per cell, for a join by cell that never sends them whole to the driver.

    The planner takes a listing to be as small as the rows before it, and would broadcast it.
    """
    return rows.hint("merge")


def radius_join(points: DataFrame, targets: DataFrame, keys: Sequence[str], radius: float, px="x", py="y", tx="tx", ty="ty", strict: bool = False) -> DataFrame:
    """All (point, target) rows within ``radius`` with the distance ``d``.

    Points are copied to the cells their circle touches (at most nine); targets stay in one cell.
    """
    size = float(radius)
    x, y = F.col(px), F.col(py)
    p = points.withColumn("_g", F.explode(_cells(x - size, x + size, y - size, y + size, size)))
    t = targets.withColumn(
        "_g", F.struct(F.floor(F.col(tx) / size).alias("gx"), F.floor(F.col(ty) / size).alias("gy"))
    )
    d = hypot2(F.col(px) - F.col(tx), F.col(py) - F.col(ty))
    found = listed(p).join(t, [*keys, "_g"]).withColumn("d", d).drop("_g")
    return found.where(F.col("d") < radius if strict else F.col("d") <= radius)


def nearest_within(points: DataFrame, targets: DataFrame, keys: Sequence[str], point_id: Sequence[str], radius: float, payload: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Nearest target per point (struct ``match``) or null; ties go to the smallest ``tie`` columns."""
    near = radius_join(points, targets, keys, radius)
    best = near.groupBy(*keys, *point_id).agg(
        F.min_by(F.struct("d", *payload), F.struct("d", *tie)).alias("match")
    )
    return points.join(best, [*keys, *point_id], "left")


def points_in_polygons(points: DataFrame, polygons: DataFrame, keys: Sequence[str], point_id: Sequence[str], cell: float = 2.0) -> DataFrame:
    """First polygon (by ``ord``) that contains each point, as ``room_ord``; null when none does.

    A polygon is listed in every grid cell its bounding box touches, so a point meets only polygons
    near it. ``polygons`` has the keys, ``ord`` and ``polygon``.
    """
    c = lambda f, pick: pick(F.transform(F.col("polygon"), lambda p: p[f]))
    boxed = polygons.where(F.size("polygon") >= 3).withColumn(
        "_g",
        F.explode(_cells(c("x", F.array_min), c("x", F.array_max), c("y", F.array_min), c("y", F.array_max), cell)),
    ).select(*keys, "_g", F.col("ord").alias("_ord"), "polygon")
    p = points.withColumn("_g", F.struct(F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy")))
    hit = p.join(listed(boxed), [*keys, "_g"]).where(point_in_polygon(F.col("x"), F.col("y"), F.col("polygon")))
    first = hit.groupBy(*keys, *point_id).agg(F.min("_ord").alias("room_ord"))
    return points.join(first, [*keys, *point_id], "left")


def polygon_edges(polygons: DataFrame) -> DataFrame:
    """One row per edge: corner ``edge_no`` to the next one, the last back to the first."""
    e = polygons.select("*", F.posexplode("polygon").alias("edge_no", "_p"))
    q = F.element_at("polygon", F.when(F.col("edge_no") + 1 == F.size("polygon"), 1).otherwise(F.col("edge_no") + 2))
    return e.select(
        *[c for c in polygons.columns if c != "polygon"],
        "edge_no",
        F.col("_p.x").alias("ax"),
        F.col("_p.y").alias("ay"),
        q["x"].alias("bx"),
        q["y"].alias("by"),
    )


def foot_on_segment(px, py, ax, ay, bx, by) -> tuple[Column, Column, Column]:
    """Nearest point of a segment and the distance to it."""
    ex, ey = bx - ax, by - ay
    t = clamp(F.try_divide((px - ax) * ex + (py - ay) * ey, ex * ex + ey * ey), 0.0, 1.0)
    qx, qy = ax + t * ex, ay + t * ey
    return qx, qy, hypot2(px - qx, py - qy)


def snap_to_edges(points: DataFrame, edges: DataFrame, keys: Sequence[str], point_id: Sequence[str], limit: float) -> DataFrame:
    """Project each point on the nearest edge within ``limit``: qx, qy, angle, snapped."""
    low = lambda a, b: F.least(a, b) - limit
    high = lambda a, b: F.greatest(a, b) + limit
    # the cell grows with the limit, so an edge is listed in few cells
    size = max(4.0 * limit, 1e-6)
    spread = edges.where(hypot2(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) > 1e-9 ** 0.5).withColumn(
        "_g", F.explode(_cells(low(F.col("ax"), F.col("bx")), high(F.col("ax"), F.col("bx")), low(F.col("ay"), F.col("by")), high(F.col("ay"), F.col("by")), size))
    )
    p = points.withColumn("_g", F.struct(F.floor(F.col("x") / size).alias("gx"), F.floor(F.col("y") / size).alias("gy")))
    j = p.join(listed(spread.select(*keys, "_g", "ord", "edge_no", "ax", "ay", "bx", "by")), [*keys, "_g"])
    qx, qy, d = foot_on_segment(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    j = j.withColumn("_d", d).where(F.col("_d") <= limit)
    angle = F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))
    best = j.groupBy(*keys, *point_id).agg(
        F.min_by(F.struct(qx.alias("qx"), qy.alias("qy"), angle.alias("angle")), F.struct("_d", "ord", "edge_no")).alias("m")
    )
    out = points.join(best, [*keys, *point_id], "left")
    return out.select(*points.columns, F.col("m.qx").alias("qx"), F.col("m.qy").alias("qy"), F.col("m.angle").alias("angle"), F.col("m").isNotNull().alias("snapped"))


# ---------------------------------------------------------------- boxes


def _level(size: Column) -> Column:
    return F.floor(F.log2(size))


def home_cell() -> Column:
    """Cell of a box in a grid whose mesh follows the box size."""
    wl, hl = _level(F.col("sx")), _level(F.col("sy"))
    return F.struct(
        wl.alias("wl"),
        hl.alias("hl"),
        F.floor(F.col("cx") / F.pow(F.lit(2.0), wl)).alias("gx"),
        F.floor(F.col("cy") / F.pow(F.lit(2.0), hl)).alias("gy"),
    )


def probe_cells(iou: float) -> Column:
    """Every cell that can be home to a box with at least this overlap share.

    An overlap share of t forces widths and heights within a factor t of each other and centres
    within (1-t) of the larger side, so the list stays short and misses nothing.
    """

    def axis(centre: Column, size: Column, level: str, cell: str) -> Column:
        levels = F.sequence(_level(size * iou * (1 - 1e-9)), _level(size / iou * (1 + 1e-9)))

        def at(lv: Column) -> Column:
            mesh = F.pow(F.lit(2.0), lv)
            widest = F.greatest(size, F.least(mesh * 2.0, size / iou))
            reach = widest * (1.0 - iou) * (1 + 1e-9) + 1e-9
            return F.transform(
                F.sequence(F.floor((centre - reach) / mesh), F.floor((centre + reach) / mesh)),
                lambda g: F.struct(lv.alias(level), g.alias(cell)),
            )

        return F.flatten(F.transform(levels, at))

    xs = axis(F.col("cx"), F.col("sx"), "l", "g")
    ys = axis(F.col("cy"), F.col("sy"), "l", "g")
    return F.flatten(
        F.transform(
            xs,
            lambda a: F.transform(
                ys,
                lambda b: F.struct(
                    a["l"].alias("wl"), b["l"].alias("hl"), a["g"].alias("gx"), b["g"].alias("gy")
                ),
            ),
        )
    )


def overlap_pairs(boxes: DataFrame, keys: Sequence[str], iou: float, cross_label: bool) -> DataFrame:
    """Pairs ``(a, b)`` of box ids (``seq``, a < b) with overlap share >= ``iou`` inside one frame."""
    solid = boxes.where((F.col("sx") > 0) & (F.col("sy") > 0)).select(*keys, "seq", "label", "cx", "cy", "sx", "sy")
    names = ("seq", "label", "cx", "cy", "sx", "sy")
    right = solid.withColumn("_g", home_cell())
    left = solid.withColumn("_g", F.explode(probe_cells(iou)))
    left = left.select(*keys, "_g", *[F.col(c).alias(f"a_{c}") for c in names])
    right = right.select(*keys, "_g", *[F.col(c).alias(f"b_{c}") for c in names])
    labels = (F.col("a_label") != F.col("b_label")) if cross_label else (F.col("a_label") == F.col("b_label"))
    share = box_iou(
        {k: F.col(f"a_{k}") for k in ("cx", "cy", "sx", "sy")}, {k: F.col(f"b_{k}") for k in ("cx", "cy", "sx", "sy")}
    )
    return (
        listed(left).join(right, [*keys, "_g"])
        .where((F.col("a_seq") < F.col("b_seq")) & labels)
        .withColumn("iou", share)
        .where(F.col("iou") >= iou)
        .select(*keys, F.col("a_seq").alias("a"), F.col("b_seq").alias("b"), "iou")
    )
