"""The reference jobs as compositions of operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from surveykit.functions.geometry import plane_pose, plausible_plane, rectify_pixel, transform_xyz
from surveykit.functions.text import canonical_sha, texts17  # noqa: F401
from surveykit.operators import asof, contracts, detections as det, fusion, layers, motion
from surveykit.operators.grid import cells as grid, regions
from surveykit.operators.quantile import group_percentiles
from surveykit.session import settle


@dataclass(frozen=True)
class PlaceParams:
    """Defaults of the fusion code; launch settings override some of them."""

    score_min: float = 0.55
    exclude: tuple[str, ...] = ()
    structure: tuple[str, ...] = ("door",)
    min_structure_h: float = 0.0
    max_wz: float = 0.25
    max_vx: float = 0.30
    odom_age_ns: int = 120_000_000
    tf_slip_ns: int = 250_000_000
    bucket_ns: int = 60_000_000_000
    occupied_radius_m: float = 0.30
    min_hits: int = 5
    max_spread_m: float = 0.25
    depth: dict = field(default_factory=dict)


def rectified_boxes(boxes: DataFrame, info: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Boxes with rectified centre and corner hull; ``info`` has one left calibration row per run."""
    j = boxes.join(info.select(*keys, "k", "d", "r", "p"), list(keys))
    hx, hy = F.col("sx") / 2, F.col("sy") / 2
    raw = [(F.col("cx"), F.col("cy"))] + [(F.col("cx") + a * hx, F.col("cy") + b * hy) for a in (-1, 1) for b in (-1, 1)]
    pts = F.array(*[F.struct(u.alias("u"), v.alias("v")) for u, v in raw])

    def fix(q: Column) -> Column:
        u, v = rectify_pixel(q["u"], q["v"], F.col("k"), F.col("d"), F.col("r"), F.col("p"))
        return F.struct(u.alias("u"), v.alias("v"))

    j = j.withColumn("_p", F.transform(pts, fix))
    hull = F.slice("_p", 2, 4)
    us, vs = F.transform(hull, lambda q: q["u"]), F.transform(hull, lambda q: q["v"])
    return j.withColumn("_us", us).withColumn("_vs", vs).select(
        *boxes.columns,
        F.col("_p")[0]["u"].alias("uc"), F.col("_p")[0]["v"].alias("vc"),
        F.array_min("_us").alias("x_min"), F.array_max("_us").alias("x_max"), F.array_min("_vs").alias("y_min"), F.array_max("_vs").alias("y_max"),
        F.col("p")[0].alias("fx"), F.col("p")[5].alias("fy"), F.col("p")[2].alias("cx0"), F.col("p")[6].alias("cy0"),
    )


def place_observations(boxes: DataFrame, info: DataFrame, disparity: DataFrame, odom: DataFrame, tf: DataFrame, par: PlaceParams = PlaceParams()) -> DataFrame:
    """Boxes to map positions with one ``reason`` each; the cheap gates run before the wide join.

    Frame-level work (motion gate, transform) runs on distinct frames and is joined back on the frame.
    """
    run = ["run_id"]
    frame = ["run_id", "stamp_ns"]
    live = boxes.withColumn("reason", det.detection_reason(par.score_min, par.exclude, par.structure, par.min_structure_h))
    frames = boxes.select(*frame).distinct().withColumn("seq", F.lit(0).cast("bigint"))
    odo = asof.nearest(frames, odom.withColumn("seq", F.col("seq").cast("bigint")), run, ["vx", "wz"], par.odom_age_ns, par.bucket_ns, tie="before")
    calm = odo.withColumn("_motion", F.when(F.col("match").isNull(), "no_odom").when(
        (F.abs("match.wz") > par.max_wz) | (F.abs("match.vx") > par.max_vx), "moving")).select(*frame, "seq", "_motion")
    posed = asof.tf_asof(calm.where("_motion is null"), tf, run, par.tf_slip_ns, par.bucket_ns).drop("seq", "_motion")
    fr = settle(calm.select(*frame, "_motion").join(posed, frame, "left"))  # one row per frame, read twice
    gated = live.where("reason = 'ok'").join(fr, frame)
    usable = gated.where(F.col("tx").isNotNull())
    lost = gated.where(F.col("tx").isNull()).withColumn("reason", F.coalesce("_motion", F.concat(F.lit("tf_"), F.col("tf_class"))))
    depth = fusion.roi_depth(rectified_boxes(usable, info), disparity, **par.depth)
    xyz = transform_xyz([F.col("tx"), F.col("ty"), F.col("tz")], [F.col(c) for c in ("qx", "qy", "qz", "qw")], [F.col("X"), F.col("Y"), F.col("Z")])
    out = ["run_id", "stamp_ns", "seq", "label", "cid", "reason", "x", "y"]
    placed = depth.withColumns({"x": xyz[0], "y": xyz[1]}).select(*out)
    nowhere = F.lit(None).cast("double")
    early = live.where("reason <> 'ok'").withColumns({"x": nowhere, "y": nowhere}).select(*out)
    return placed.unionByName(lost.withColumns({"x": nowhere, "y": nowhere}).select(*out)).unionByName(early)


def place_detections(boxes: DataFrame, info: DataFrame, disparity: DataFrame, odom: DataFrame, tf: DataFrame, cells: DataFrame, res: float, ox: float, oy: float, par: PlaceParams = PlaceParams()) -> tuple[DataFrame, DataFrame]:
    """Observations with reasons, and confirmed points (run, label, cid, x, y, hits, spread)."""
    # read twice below; the cut also keeps later filters from being folded into the depth expressions
    seen = settle(place_observations(boxes, info, disparity, odom, tf, par))
    return seen, confirm_points(seen.where("reason = 'ok'"), cells, res, ox, oy, par)


def confirm_points(observations: DataFrame, cells: DataFrame, res: float, ox: float, oy: float, par: PlaceParams = PlaceParams()) -> DataFrame:
    """Map gate, association and confirmation of placed observations."""
    ok = fusion.map_cell_gate(observations, cells, ["run_id"], ["stamp_ns", "seq"], res, ox, oy, par.structure, par.occupied_radius_m).where("map_ok")
    members = settle(fusion.associate(settle(ok)))
    tracks = fusion.track_summary(members, ["run_id", "label", "part", "track"])
    return fusion.confirm(tracks, par.min_hits, par.max_spread_m)


def pose_timeline(planes: DataFrame, keys: Sequence[str], reach: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Pitch, roll and height per accepted ground plane, and the step report per run."""
    pitch, roll, height = plane_pose(F.col("nx"), F.col("ny"), F.col("nz"), F.col("d"))
    series = planes.select(*keys, "stamp_ns", pitch.alias("pitch"), roll.alias("roll"), height.alias("height")).where(
        plausible_plane(F.col("pitch"), F.col("roll"), F.col("height"))
    )
    step = motion.step_detect(series, keys, "pitch", reach, width=width)
    edge = motion.edge_quantile(series, keys, "pitch")
    roll_mid = group_percentiles(series, keys, "roll", {"roll_median": 0.5})
    tall = group_percentiles(series, keys, "height", {"height_median": 0.5}).drop("n")
    report = roll_mid.join(tall, list(keys)).join(edge, list(keys), "left").join(step, list(keys), "left")
    return series, report


def segment_rooms(cells: DataFrame, res: float, scheme: str = "live", seed_m: Sequence[float] = (0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6), min_room: float = 2.0, single: float = 12.5, min_area: float = 1.0) -> DataFrame:
    """Grid to room labels: open, keep large parts, distance, seeds at the best threshold, split, merge."""
    kind = grid.cell_class(F.col("value"), scheme)
    box = grid.bounds(cells)
    free = cells.where(kind == "free").select("map_id", "col", "row")
    clean = grid.opened(free, grid.element("ellipse", 2), box)
    kept = settle(grid.keep_area(grid.components(clean, 8), max(1, int(min_area / (res * res)))).select("map_id", "col", "row"))
    dist = settle(grid.distance(kept, box))
    best = grid.seed_scan(dist, [t / res for t in seed_m])
    core = dist.join(best.select("map_id", "threshold"), "map_id").where("dist >= threshold")
    seeds = grid.components(core.select("map_id", "col", "row"), 4)
    labelled = grid.basins(dist, seeds)
    return regions.merge_regions(labelled, kept, box, res, "small", min_room, single)


def voronoi_rooms(cells: DataFrame, res: float, scheme: str = "live", min_room: float = 2.0, single: float = 12.5) -> DataFrame:
    """Grid to rooms by cutting at critical points of the ridge and merging under the five rules."""
    box = grid.bounds(cells)
    free = settle(cells.where(grid.cell_class(F.col("value"), scheme) == "free").select("map_id", "col", "row"))
    dist = settle(grid.distance(free, box))
    ridge = regions.ridge_prune(regions.ridge_cells(dist), int(round(0.5 / res)))
    half = max(3, int(round(0.7 / res))) // 2
    points = regions.critical_points(ridge, half, 1.0 / res)
    rim = grid.dilate(free, grid.EIGHT, box).join(free, ["map_id", "col", "row"], "left_anti")
    cut = regions.critical_cuts(points, rim)
    parts = grid.components(free.join(cut, ["map_id", "col", "row"], "left_anti"), 8)
    whole = grid.fill_nearest(free, parts)
    return regions.merge_regions(whole, free, box, res, "five", min_room, single)


def merge_layers(points: DataFrame, rooms: DataFrame, objects: DataFrame, topology: DataFrame, keys: Sequence[str], required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Points and rooms to the semantic room table and a manifest row per run.

    ``objects`` and ``topology`` are artifact headers; runs whose provenance differs do not merge.
    """
    keys = list(keys)
    same = contracts.provenance(objects, topology).where("reason = 'ok'").select("recording_token")
    good = objects.join(same, "recording_token", "left_semi")
    p = points.join(good.select(*keys), keys, "left_semi")
    placed = layers.assign_rooms(p, rooms, keys, ["ord"]).withColumnRenamed("ord", "poi_ord")
    inside = placed.where("room_ord is not null")
    facts = layers.room_facilities(inside, [*keys, "room_ord"], "poi_ord")
    counts = inside.groupBy(*keys, "room_ord").agg(F.count("*").alias("n_poi"))
    table = rooms.join(good.select(*keys), keys, "left_semi").withColumnRenamed("ord", "room_ord").join(facts, [*keys, "room_ord"], "left").join(counts, [*keys, "room_ord"], "left")
    table = table.withColumns({"semantic": F.coalesce("semantic", F.lit("room")), "facilities": F.coalesce("facilities", F.lit("")), "n_poi": F.coalesce("n_poi", F.lit(0))})
    contract = layers.required_contract(p, keys, required)
    # content is hashed per room row, and the manifest hashes the ordered row hashes
    row_sha = canonical_sha({"ord": F.col("room_ord"), "semantic": F.col("semantic"), "facilities": F.col("facilities"), "n_poi": F.col("n_poi")})
    content = table.withColumn("_sha", row_sha).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("room_ord", "_sha"))).alias("_s"))
    content = content.select(*keys, F.sha2(F.to_json("_s").cast("binary"), 256).alias("semantic_content_sha256"))
    manifest = good.join(contract, keys).join(content, keys)
    return table, manifest
