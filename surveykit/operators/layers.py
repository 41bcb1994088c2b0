"""Rooms, names and the merged semantic map."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from surveykit.functions.geometry import hypot2, polygon_measure
from surveykit.operators.spatial import points_in_polygons, polygon_edges, snap_to_edges

# fixed values: labels that define the type of the room they are in
TYPE_DEFINING = {"staircase": "stairwell", "elevator_door": "elevator_hall"}
# fixed values: room type voted by an object
OBJECT_ROOM = {
    "bed": "Bedroom", "sofa": "Living room", "couch": "Living room", "tv": "Living room",
    "television": "Living room", "refrigerator": "Kitchen", "fridge": "Kitchen", "oven": "Kitchen",
    "stove": "Kitchen", "microwave": "Kitchen", "sink": "Kitchen", "toilet": "Bathroom",
    "bathtub": "Bathroom", "shower": "Bathroom", "washing machine": "Balcony",
    "dining table": "Dining", "table": "Dining", "desk": "Study", "bookshelf": "Study",
}


def lookup(c: Column, table: Mapping[str, str]) -> Column:
    """Value of a short fixed table, else null."""
    items = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    return F.try_element_at(items, c)


def assign_rooms(points: DataFrame, rooms: DataFrame, keys: Sequence[str], point_id: Sequence[str]) -> DataFrame:
    """First room in document order that holds the point; phantom rooms never match."""
    real = rooms.where(F.lower(F.coalesce("status", F.lit("room"))) != "phantom")
    return points_in_polygons(points, real, keys, point_id)


def vote(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Majority name per key; equal counts go to the smaller name."""
    counts = rows.where(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(name, F.struct(-F.col("_n"), F.col(name))).alias("winner"), F.max("_n").alias("votes"))


def room_facilities(assigned: DataFrame, keys: Sequence[str], ordinal: str = "ord", types: Mapping[str, str] = TYPE_DEFINING) -> DataFrame:
    """Per room: distinct facility labels in first-seen order and the voted type ("room" without votes).

    Labels are first reduced to one row each, so the list is bounded by the label vocabulary.
    """
    keys = list(keys)
    typed = assigned.withColumn("_type", lookup(F.col("label"), types))
    firsts = typed.where("_type is null").groupBy(*keys, "label").agg(F.min(ordinal).alias("_o"))
    lists = firsts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_o", "label"))).alias("_f"))
    lists = lists.select(*keys, F.transform("_f", lambda f: f["label"]).alias("facilities"))
    votes = vote(typed, keys, "_type").select(*keys, F.col("winner").alias("_w"))
    base = assigned.select(*keys).distinct()
    out = base.join(lists, keys, "left").join(votes, keys, "left")
    return out.select(
        *keys,
        F.array_join(F.coalesce("facilities", F.expr("cast(array() as array<string>)")), ",").alias("facilities"),
        F.coalesce("_w", F.lit("room")).alias("semantic"),
    )


def room_names(rooms: DataFrame, objects: DataFrame, map_keys: Sequence[str]) -> DataFrame:
    """Names from object votes; unnamed rooms get letters by falling area; repeats get numbers.

    ``rooms`` has id and area_m2; ``objects`` has the room id and a label. Windows run over rooms of one
    map, one row per room.
    """
    mk = list(map_keys)
    winner = vote(objects.withColumn("_v", lookup(F.col("label"), OBJECT_ROOM)), [*mk, "id"], "_v").select(*mk, "id", F.col("winner").alias("_name"))
    r = rooms.join(winner, [*mk, "id"], "left")
    rank = F.row_number().over(W.partitionBy(*mk, F.col("_name").isNull()).orderBy(F.desc("area_m2"), F.asc("id")))
    letter = F.concat(F.lit("Room "), F.expr("char(64 + _k)"))
    r = r.withColumn("_k", rank).withColumn("name", F.coalesce("_name", letter))
    same = W.partitionBy(*mk, "name")
    number = F.row_number().over(same.orderBy("id"))
    many = F.count("*").over(same) > 1
    return r.withColumn("_n", number).withColumn("_many", many).select(
        *mk, "id", "area_m2", F.when(F.col("_many"), F.concat("name", F.col("_n").cast("string"))).otherwise(F.col("name")).alias("name")
    )


def wall_direction(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Length-weighted circular mean of wall angles with a period of 90 degrees; turn in degrees."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    a = F.atan2(dy, dx) * 4.0
    length = hypot2(dx, dy)
    g = segments.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(length * F.cos(a)).alias("_c"), F.sum(length * F.sin(a)).alias("_s"))
    turn = F.when(F.col("n") < 3, 0.0).otherwise(-F.degrees(F.atan2("_s", "_c")) / 4.0)
    return g.select(*keys, "n", turn.alias("turn_deg"))


def polygon_table(polygons: DataFrame, keys: Sequence[str]) -> DataFrame:
    area, cx, cy = polygon_measure(F.col("polygon"))
    return polygons.select(*keys, area.alias("area_m2"), cx.alias("cx"), cy.alias("cy"))


def edge_walls(polygons: DataFrame, distance: DataFrame, keys: Sequence[str], near: float = 0.30, res: float = 0.05) -> DataFrame:
    """Explored share of each room outline.

    Nine samples over the middle 70 % of an edge look up the distance-to-occupied cell under them;
    an edge is a wall when the median is below ``near``. ``distance`` has keys, col, row, dist_m.
    """
    e = polygon_edges(polygons)
    share = F.lit(0.15) + F.col("i") * (0.70 / 8)
    pts = e.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumns(
        {
            "col": F.rint((F.col("ax") + (F.col("bx") - F.col("ax")) * share) / res).cast("long"),
            "row": F.rint((F.col("ay") + (F.col("by") - F.col("ay")) * share) / res).cast("long"),
        }
    )
    ends = distance.groupBy(*keys).agg(*[f(c).cast("long").alias(n) for c, f, n in (("col", F.min, "_c0"), ("col", F.max, "_c1"), ("row", F.min, "_r0"), ("row", F.max, "_r1"))])
    pts = pts.join(ends, list(keys)).withColumns(
        {"col": F.greatest("_c0", F.least("_c1", "col")), "row": F.greatest("_r0", F.least("_r1", "row"))}
    )
    d = distance.select(*keys, F.col("col").cast("long"), F.col("row").cast("long"), "dist_m")
    met = pts.join(d, [*keys, "col", "row"], "left").withColumn("dist_m", F.coalesce("dist_m", F.lit(float("inf"))))
    # nine values per edge
    edges = met.groupBy(*keys, "ord", "edge_no").agg(
        F.percentile("dist_m", F.lit(0.5)).alias("_m"), F.max(hypot2(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("_len")
    )
    real = F.col("_m") < near
    return edges.groupBy(*keys, "ord").agg(
        F.count("*").alias("edges"),
        F.count_if(real).alias("wall_edges"),
        F.try_divide(F.sum(F.when(real, F.col("_len")).otherwise(0.0)), F.sum("_len")).alias("explored_frac"),
    )


def explored(rooms: DataFrame, minimum: float = 0.35) -> DataFrame:
    return rooms.withColumn("status", F.when(F.col("explored_frac") < minimum, "unexplored").otherwise(F.col("status")))


def snap_doors(doors: DataFrame, rooms: DataFrame, room_cells: DataFrame, keys: Sequence[str], door_id: Sequence[str], limit: float = 1.0, probe: float = 0.4, res: float = 0.05) -> DataFrame:
    """Doors on their nearest room edge, opening towards the larger room beside them.

    ``room_cells`` maps (keys, col, row) to the room area. The two probe points are looked up by an
    equi join on their cell.
    """
    keys, door_id = list(keys), list(door_id)
    s = snap_to_edges(doors, polygon_edges(rooms), keys, door_id, limit)
    sides = F.explode(F.array(F.lit(1), F.lit(-1)))
    nx, ny = -F.sin("angle"), F.cos("angle")
    p = s.where("snapped").select(*keys, *door_id, "qx", "qy", "angle", sides.alias("sgn")).select(
        *keys, *door_id, "sgn",
        F.rint((F.col("qx") + F.col("sgn") * nx * probe) / res).cast("long").alias("col"),
        F.rint((F.col("qy") + F.col("sgn") * ny * probe) / res).cast("long").alias("row"),
    )
    cells = room_cells.select(*keys, F.col("col").cast("long"), F.col("row").cast("long"), "area_m2")
    area = p.join(cells, [*keys, "col", "row"], "left").groupBy(*keys, *door_id).agg(
        F.max(F.when(F.col("sgn") == 1, F.coalesce("area_m2", F.lit(-1.0)))).alias("_p"),
        F.max(F.when(F.col("sgn") == -1, F.coalesce("area_m2", F.lit(-1.0)))).alias("_m"),
    )
    swing = F.when(F.col("snapped"), F.when(F.col("_p") >= F.col("_m"), 1).otherwise(-1))
    return s.join(area, [*keys, *door_id], "left").withColumn("swing", swing).drop("_p", "_m")


def zone_table(cells: DataFrame, anchors: DataFrame, pois: DataFrame, names: DataFrame, keys: Sequence[str], res: float) -> DataFrame:
    """Zone rows: area, anchor, sorted point labels, name and who named it."""
    keys = list(keys)
    area = cells.groupBy(*keys, "zone").agg(F.round(F.count("*") * res * res, 1).alias("area_m2"))
    # label lists count repeats; they are bounded by the confirmed points of a zone
    per_label = pois.groupBy(*keys, "zone", "label").agg(F.count("*").alias("_n"))
    labels = per_label.groupBy(*keys, "zone").agg(F.array_sort(F.collect_list(F.struct("label", "_n"))).alias("_l"))
    text = F.array_join(F.flatten(F.transform("_l", lambda x: F.array_repeat(x["label"], x["_n"].cast("int")))), ",")
    out = area.join(anchors, [*keys, "zone"], "left").join(labels.select(*keys, "zone", text.alias("poi_labels")), [*keys, "zone"], "left")
    out = out.join(names.select(*keys, "zone", F.col("name").alias("_given")), [*keys, "zone"], "left")
    auto = F.concat(F.lit("Zone "), (F.col("zone") + 1).cast("string"))
    return out.select(
        *[c for c in out.columns if c not in ("_given", "poi_labels")],
        F.coalesce("poi_labels", F.lit("")).alias("poi_labels"),
        F.coalesce("_given", auto).alias("name"),
        F.when(F.col("_given").isNull(), "segment identifier").otherwise("given name").alias("named_by"),
    )


def required_contract(points: DataFrame, keys: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Sorted observed labels and missing required labels per run."""
    seen = points.where(F.trim("label") != "").select(*keys, F.trim("label").alias("label")).distinct()
    g = seen.groupBy(*keys).agg(F.array_sort(F.collect_list("label")).alias("observed_labels"))
    gone = F.array_sort(F.array_except(F.array(*[F.lit(x) for x in required]), "observed_labels"))
    return g.withColumn("missing", gone).withColumn("complete", F.size("missing") == 0)

