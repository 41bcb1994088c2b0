"""Depth, placement on the map, association into tracks and de-duplication."""

from __future__ import annotations

import bisect
import heapq
import math
from collections import deque
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from surveykit.functions.geometry import hypot2, is_finite
from surveykit.functions.scans import sorted_quantile
from surveykit.operators.association import associate, radius_of  # noqa: F401
from surveykit.operators.quantile import group_percentiles

# fixed values: smallest distance between two points of one label (m)
MIN_DIST = {"door": 1.0, "sofa": 1.0, "cabinet": 0.8, "spray": 0.6}
MIN_DIST_DEFAULT = 0.8
REASONS = ["ok", "roi_empty", "calib", "no_pos_d", "few_samples", "depth_gate", "iqr_or_gap", "bearing"]


# ---------------------------------------------------------------- depth


def select_depth(ordered: Column, min_samples: int, iqr_max: float, gap: float) -> Column:
    """Depth from an ascending array of finite samples, or null.

    Two separated clusters: the near one if it has enough samples, else nothing. One cluster: the
    median unless the middle half is too wide.
    """
    n = F.size(ordered)
    low, high = F.element_at(ordered, 1), F.element_at(ordered, -1)
    split = (low + high) * 0.5
    near = F.filter(ordered, lambda z: z <= split)
    far = F.filter(ordered, lambda z: z > split)
    bimodal = (
        (F.lit(gap) > 0)
        & (high - low >= gap)
        & (F.size(far) > 0)
        & (sorted_quantile(far, 0.5) - sorted_quantile(near, 0.5) >= gap)
    )
    wide = F.lit(iqr_max > 0) & (sorted_quantile(ordered, 0.75) - sorted_quantile(ordered, 0.25) > iqr_max)
    return F.when(
        n >= max(1, min_samples),
        F.when(
            bimodal, F.when(F.size(near) >= min_samples, sorted_quantile(near, 0.5))
        ).when(~wide, sorted_quantile(ordered, 0.5)),
    )


def depth_by_group(samples: DataFrame, keys: Sequence[str], value: str, min_samples: int, iqr_max: float, gap: float) -> DataFrame:
    """The same rule for groups of any size: aggregates and exact group percentiles only."""
    keys = list(keys)
    s = samples.where(is_finite(F.col(value)))
    ends = s.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    halves = s.join(ends, keys).withColumn(
        "_side", F.when(F.col(value) <= (F.col("_lo") + F.col("_hi")) * 0.5, "near").otherwise("far")
    )
    mid = group_percentiles(halves, [*keys, "_side"], value, {"m": 0.5})
    mids = mid.groupBy(*keys).agg(
        F.max(F.when(F.col("_side") == "near", F.col("m"))).alias("near_m"),
        F.max(F.when(F.col("_side") == "near", F.col("n"))).alias("near_n"),
        F.max(F.when(F.col("_side") == "far", F.col("m"))).alias("far_m"),
    )
    q = group_percentiles(s, keys, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    all_ = q.join(ends, keys).join(mids, keys, "left")
    bimodal = F.coalesce(
        (F.lit(gap) > 0) & (F.col("_hi") - F.col("_lo") >= gap) & (F.col("far_m") - F.col("near_m") >= gap), F.lit(False)
    )
    wide = F.lit(iqr_max > 0) & (F.col("q75") - F.col("q25") > iqr_max)
    z = F.when(bimodal, F.when(F.col("near_n") >= min_samples, F.col("near_m"))).when(~wide, F.col("q50"))
    reason = F.when(F.col("n") < min_samples, "few_samples").when(z.isNull(), "iqr_or_gap").otherwise("ok")
    return all_.select(*keys, F.col("n").alias("samples"), F.when(F.col("n") >= min_samples, z).alias("depth"), reason.alias("reason"))


def roi_depth(
    boxes: DataFrame,
    disparity: DataFrame,
    keys: Sequence[str] = ("run_id", "stamp_ns"),
    roi_scale: float = 0.40,
    expand: bool = True,
    min_samples: int = 12,
    depth_min: float = 0.3,
    depth_max: float = 10.0,
    iqr_max: float = 1.5,
    gap: float = 0.60,
    max_bearing: float = math.radians(40.0),
    mirror_x: bool = False,
) -> DataFrame:
    """Robust camera point per box with exactly one ``reason``.

    ``boxes`` carry the rectified centre uc, vc, hull x_min..y_max and P entries fx, fy, cx0, cy0;
    ``disparity`` has one row per image row. A box is listed once per image row it covers, so the
    join key is (frame, row) and one crowded frame is spread over its rows.
    """
    keys = list(keys)
    scale = min(1.0, max(0.10, roi_scale))
    half_w = F.greatest(F.lit(1.0), (F.col("x_max") - F.col("x_min")) * scale / 2.0)
    half_h = F.greatest(F.lit(1.0), (F.col("y_max") - F.col("y_min")) * scale / 2.0)
    b = boxes.select(
        "*",
        F.floor(F.col("uc") - half_w).alias("_cx0"),
        (F.ceil(F.col("uc") + half_w) + 1).alias("_cx1"),
        F.floor(F.col("vc") - half_h).alias("_cy0"),
        (F.ceil(F.col("vc") + half_h) + 1).alias("_cy1"),
        F.floor("x_min").alias("_fx0"),
        (F.ceil("x_max") + 1).alias("_fx1"),
        F.floor("y_min").alias("_fy0"),
        (F.ceil("y_max") + 1).alias("_fy1"),
    )
    top = F.greatest(F.lit(0), F.least("_cy0", "_fy0"))
    bottom = F.greatest(top, F.greatest("_cy1", "_fy1") - 1)
    size = disparity.groupBy(*keys).agg(F.max("row").alias("_last"))
    rows = b.join(size, keys, "left").withColumn(
        "_row", F.explode_outer(F.when(F.col("_last").isNotNull() & (top <= F.col("_last")), F.sequence(top, F.least(bottom, F.col("_last").cast("bigint")))))
    )
    d = disparity.select(*keys, F.col("row").cast("bigint").alias("_row"), "f", "baseline", "min_d", "max_d", "values")
    met = rows.join(d, [*keys, "_row"], "left")

    def part(x0: str, x1: str, y0: str, y1: str) -> tuple[Column, Column]:
        start = F.greatest(F.lit(0), F.col(x0))
        stop = F.least(F.size("values").cast("bigint"), F.col(x1))
        inside = F.col("values").isNotNull() & (F.col("_row") >= F.col(y0)) & (F.col("_row") < F.col(y1)) & (stop > start)
        cut = F.slice("values", (start + 1).cast("int"), F.greatest(F.lit(0), stop - start).cast("int"))
        limits = F.col("max_d") > F.col("min_d")
        good = F.filter(
            F.transform(cut, lambda v: v.cast("double")),
            lambda v: is_finite(v) & (v > 0) & (~limits | ((v >= F.col("min_d")) & (v <= F.col("max_d")))),
        )
        return inside, F.when(inside, good)

    c_in, c_vals = part("_cx0", "_cx1", "_cy0", "_cy1")
    f_in, f_vals = part("_fx0", "_fx1", "_fy0", "_fy1")
    # bounded by the pixels of one image
    per_box = met.groupBy(*keys, "seq").agg(
        F.flatten(F.collect_list(c_vals)).alias("_c"),
        F.flatten(F.collect_list(f_vals)).alias("_f"),
        F.bool_or(c_in).alias("_has_c"),
        F.bool_or(f_in).alias("_has_f"),
        F.max("f").alias("_focal"),
        F.max("baseline").alias("_base"),
    )
    grow = F.lit(expand) & F.col("_has_f") & (~F.col("_has_c") | (F.size("_c") < min_samples)) & (
        ~F.col("_has_c") | (F.size("_f") > F.size("_c"))
    )
    s = per_box.withColumn("_grow", grow).withColumn("_d", F.when(grow, F.col("_f")).otherwise(F.col("_c")))
    depth = F.transform("_d", lambda v: F.try_divide(F.col("_focal") * F.col("_base"), v))
    s = s.withColumn("_z", F.array_sort(F.filter(depth, lambda z: is_finite(z) & (z >= depth_min) & (z <= depth_max))))
    s = s.withColumn("z", select_depth(F.col("_z"), min_samples, iqr_max, gap))
    j = boxes.join(s, [*keys, "seq"])
    bearing = F.atan2(F.col("uc") - F.col("cx0"), F.col("fx"))
    reason = (
        F.when(~F.col("_has_c") & ~(F.col("_grow")), "roi_empty")
        .when((F.col("_focal") <= 0) | (F.col("_base") <= 0), "calib")
        .when(F.size("_d") == 0, "no_pos_d")
        .when(F.size("_d") < min_samples, "few_samples")
        .when(F.size("_z") < min_samples, "depth_gate")
        .when(F.col("z").isNull(), "iqr_or_gap")
        .when((F.col("fx") <= 0) | (F.col("fy") <= 0), "calib")
        .when(F.lit(max_bearing > 0) & (F.abs(bearing) > max_bearing), "bearing")
        .otherwise("ok")
    )
    ok = F.col("reason") == "ok"
    side = -1.0 if mirror_x else 1.0
    return j.withColumn("reason", reason).select(
        *boxes.columns,
        "reason",
        F.coalesce("_grow", F.lit(False)).alias("expanded"),
        F.when(ok, (F.col("uc") - F.col("cx0")) * F.col("z") / F.col("fx") * side).alias("X"),
        F.when(ok, (F.col("vc") - F.col("cy0")) * F.col("z") / F.col("fy")).alias("Y"),
        F.when(ok, F.col("z")).alias("Z"),
    )


def disparity_frame(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Valid count and share and depth/disparity percentiles of each frame (one row per image row)."""
    keys = list(keys)
    flat = rows.select(*keys, "f", "baseline", "min_d", F.explode("values").alias("v")).withColumn("v", F.col("v").cast("double"))
    good = is_finite(F.col("v")) & (F.col("v") > F.col("min_d"))
    counts = flat.groupBy(*keys).agg(F.count_if(good).alias("valid"), F.count("*").alias("total"))
    valid = flat.where(good).withColumn("z", F.try_divide(F.col("f") * F.col("baseline"), F.col("v")))
    d = group_percentiles(valid, keys, "v", {"disparity_median": 0.5}).drop("n")
    z = group_percentiles(valid, keys, "z", {"depth_median_m": 0.5, "depth_p10_m": 0.1, "depth_p90_m": 0.9}).drop("n")
    return counts.join(d, keys, "left").join(z, keys, "left").withColumn("ratio", F.try_divide("valid", "total"))


# ---------------------------------------------------------------- map gate


def near_occupied(points: DataFrame, cells: DataFrame, keys: Sequence[str], point_id: Sequence[str], res: float, ox: float, oy: float, radius: float, threshold: int = 50) -> DataFrame:
    """Points with an occupied cell whose centre lies within ``radius``: cell keys, semi join, exact test."""
    span = math.ceil(radius / res)
    offs = F.explode(F.flatten(F.transform(F.sequence(F.lit(-span), F.lit(span)), lambda a: F.transform(
        F.sequence(F.lit(-span), F.lit(span)), lambda b: F.struct(a.alias("dc"), b.alias("dr"))))))
    c0, r0 = F.floor((F.col("x") - ox) / res), F.floor((F.col("y") - oy) / res)
    probe = points.select(*keys, *point_id, "x", "y", offs.alias("o")).select(
        *keys, *point_id, (c0 + F.col("o.dc")).alias("col"), (r0 + F.col("o.dr")).alias("row"), "x", "y"
    )
    centre = hypot2((F.col("col") + 0.5) * res + ox - F.col("x"), (F.col("row") + 0.5) * res + oy - F.col("y"))
    wall = cells.where(F.col("value") >= threshold).select(*keys, F.col("col").cast("bigint").alias("col"), F.col("row").cast("bigint").alias("row"))
    hits = probe.where(centre <= radius).join(wall, [*keys, "col", "row"], "left_semi").select(*keys, *point_id).distinct()
    return points.join(hits, [*keys, *point_id], "left_semi")


def map_cell_gate(points: DataFrame, cells: DataFrame, keys: Sequence[str], point_id: Sequence[str], res: float, ox: float, oy: float, structure: Sequence[str], radius: float, threshold: int = 50) -> DataFrame:
    """Known cell under the point; structure labels also need a wall nearby. Adds ``map_ok``."""
    at = cells.where(F.col("value") >= 0).select(
        *keys, F.col("col").cast("bigint").alias("_c"), F.col("row").cast("bigint").alias("_r"), F.lit(True).alias("_known")
    )
    p = points.withColumn("_c", F.floor((F.col("x") - ox) / res)).withColumn("_r", F.floor((F.col("y") - oy) / res))
    p = p.join(at, [*keys, "_c", "_r"], "left")
    wall = near_occupied(points.where(F.col("label").isin(*structure)), cells, keys, point_id, res, ox, oy, radius, threshold)
    wall = wall.select(*keys, *point_id, F.lit(True).alias("_wall"))
    p = p.join(wall, [*keys, *point_id], "left")
    known = F.coalesce("_known", F.lit(False))
    ok = known & (~F.col("label").isin(*structure) | F.coalesce("_wall", F.lit(False)))
    return p.select(*points.columns, ok.alias("map_ok"))


# ---------------------------------------------------------------- tracks


def axis_parts(points: DataFrame, keys: Sequence[str], reach: Column, out: str = "part", rounds: int = 2) -> DataFrame:
    """Split the points of a key into parts that can never interact.

    Whatever stays inside the x and y extent of its own members (a median, a weighted mean) cannot
    meet a point across a gap wider than ``reach`` along an axis. Gaps are looked for between occupied
    grid lines, on distinct cells, first along x, then y within each part, ``rounds`` times. Stopping
    early only leaves larger parts, never a wrong split.
    """
    keys = list(keys)
    gx, gy = F.floor(F.col("x") / reach), F.floor(F.col("y") / reach)
    placed = points.withColumn("_gx", gx).withColumn("_gy", gy)
    spots = placed.select(*keys, "_gx", "_gy").distinct().withColumn(out, F.lit("0"))
    for _ in range(rounds):
        for axis in ("_gx", "_gy"):
            lines = spots.select(*keys, out, axis).distinct()
            w = W.partitionBy(*keys, out).orderBy(axis)
            # one empty line between two occupied ones means a gap wider than the mesh
            cut = F.when(F.col(axis) - F.lag(axis).over(w) > 1, 1).otherwise(0)
            lines = lines.withColumn("_cut", cut)
            lines = lines.withColumn("_no", F.sum("_cut").over(w)).select(*keys, out, axis, "_no")
            spots = spots.join(lines, [*keys, out, axis]).withColumn(
                out, F.concat_ws(".", F.col(out), F.col("_no").cast("string"))
            ).drop("_no")
    return placed.join(spots, [*keys, "_gx", "_gy"]).drop("_gx", "_gy")


class _Track:
    __slots__ = ("xs", "ys", "last", "no")

    def __init__(self, no: int) -> None:
        self.xs: list[float] = []
        self.ys: list[float] = []
        self.last = None
        self.no = no

    @staticmethod
    def mid(v: list[float]) -> float:
        h = len(v) // 2
        return v[h] if len(v) % 2 else (v[h - 1] + v[h]) / 2.0

    def add(self, x: float, y: float, stamp: int) -> None:
        bisect.insort(self.xs, x)
        bisect.insort(self.ys, y)
        self.last = stamp


def track_summary(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per track: hits, median x and y, and the root mean square of both offsets from the median."""
    keys = list(keys)
    axes = members.select(*keys, F.explode(F.array(
        F.struct(F.lit("x").alias("axis"), F.col("x").alias("v")), F.struct(F.lit("y").alias("axis"), F.col("y").alias("v"))
    )).alias("a")).select(*keys, "a.axis", "a.v")
    mid = group_percentiles(axes, [*keys, "axis"], "v", {"m": 0.5}).drop("n")
    both = mid.groupBy(*keys).agg(
        F.max(F.when(F.col("axis") == "x", F.col("m"))).alias("mx"), F.max(F.when(F.col("axis") == "y", F.col("m"))).alias("my")
    )
    j = members.join(both, keys)
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    return j.groupBy(*keys).agg(
        F.max("mx").alias("x"),
        F.max("my").alias("y"),
        F.count("*").alias("hits"),
        F.sqrt(F.sum(dx * dx + dy * dy) / (F.count("*") * 2)).alias("spread_m"),
    )


def confirm(tracks: DataFrame, min_hits: int, max_spread: float) -> DataFrame:
    return tracks.where((F.col("hits") >= min_hits) & (F.col("spread_m") <= max_spread))


def top_tracks(tracks: DataFrame, run: Sequence[str], limit: int = 6) -> DataFrame:
    """Tracks with most hits per run, with a text line.

    Two cuts: the first per salt keeps a crowded run out of a single task.
    """
    order = [F.desc("hits"), F.asc("label"), F.asc("x"), F.asc("y")]
    salted = tracks.withColumn("_s", F.pmod(F.xxhash64("x", "y"), F.lit(64)))
    first = salted.withColumn("rank", F.row_number().over(W.partitionBy(*run, "_s").orderBy(*order))).where(F.col("rank") <= limit)
    best = first.withColumn("rank", F.row_number().over(W.partitionBy(*run).orderBy(*order))).where(F.col("rank") <= limit)
    text = F.format_string("%s hits=%d spread=%.2f at (%.2f,%.2f)", "label", "hits", "spread_m", "x", "y")
    return best.drop("_s").withColumn("text", text)


def rank_points(points: DataFrame, run: Sequence[str], cell: float = 1.0) -> DataFrame:
    """Place of each point in its run, by label, most hits, x and y.

    Places are counted from groups of (label, hits, x cell): one running sum over groups and a row
    number inside each, so no task sorts a whole run.
    """
    run = list(run)
    p = points.withColumn("_b", F.floor(F.col("x") / cell)).withColumn("_h", -F.col("hits"))
    group = [*run, "label", "_h", "_b"]
    sizes = p.groupBy(*group).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*run).orderBy("label", "_h", "_b").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(*group, F.coalesce(before, F.lit(0)).alias("_s"))
    inner = F.row_number().over(W.partitionBy(*group).orderBy("x", "y"))
    return p.withColumn("_r", inner).join(starts, group).withColumn("place", F.col("_s") + F.col("_r")).drop("_b", "_h", "_r", "_s")


def missing_labels(confirmed: DataFrame, runs: DataFrame, required: Sequence[str], run: str = "run_id") -> DataFrame:
    """Required labels a run has not confirmed (the required list is short and fixed)."""
    want = F.array(*[F.lit(x) for x in required])
    seen = confirmed.where(F.col("label").isin(*required)).groupBy(run).agg(F.collect_set("label").alias("_have"))
    have = F.coalesce("_have", F.expr("cast(array() as array<string>)"))
    gone = F.array_sort(F.array_except(want, have))
    return runs.select(run).distinct().join(seen, run, "left").select(
        run, F.array_join(gone, ",").alias("missing"), (F.size(gone) == 0).alias("complete")
    )


# ---------------------------------------------------------------- de-duplication


#: places that a cell of the first round may hold; the mesh is halved until none holds more
_CROWD = 8


def _merged(a: dict, b: dict, d: float) -> dict:
    hits = a["hits"] + b["hits"]
    return {
        **a,
        "x": round((a["x"] * a["hits"] + b["x"] * b["hits"]) / float(hits), 3),
        "y": round((a["y"] * a["hits"] + b["y"] * b["hits"]) / float(hits), 3),
        "hits": hits,
        "spread_m": round(max(a["spread_m"], b["spread_m"], d / 2.0), 3),
        "merged_from": a["merged_from"] + b["merged_from"],
    }


def _merge_copies(objs: dict[int, dict], fresh: int) -> int:
    """Merge points of one place, the two oldest of a place first; returns the next free number."""
    places: dict[tuple[float, float], deque[int]] = {}
    for i, o in objs.items():
        places.setdefault((o["x"], o["y"]), deque()).append(i)
    heap = [(ids[0], ids[1], at) for at, ids in places.items() if len(ids) > 1]
    heapq.heapify(heap)
    while heap:
        i, j, at = heapq.heappop(heap)
        places[at].popleft(), places[at].popleft()
        objs[fresh] = o = _merged(objs.pop(i), objs.pop(j), 0.0)
        there = places.setdefault((o["x"], o["y"]), deque())
        there.append(fresh)
        fresh += 1
        for where in {at, (o["x"], o["y"])}:
            ids = places[where]
            # a place that only grew behind its first two is on the heap already
            if len(ids) > 1 and (where == at or len(ids) == 2):
                heapq.heappush(heap, (ids[0], ids[1], where))
    return fresh


def _merge_below(objs: dict[int, dict], fresh: int, limit: float) -> int:
    """Merge the closest pair below ``limit`` until none is left, looking only into nearby cells."""
    grid: dict[tuple[int, int], set[int]] = {}
    heap: list[tuple[float, int, int]] = []

    def place(i: int, o: dict) -> None:
        g = (math.floor(o["x"] / limit), math.floor(o["y"] / limit))
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                for j in grid.get((g[0] + a, g[1] + b), ()):
                    d = math.hypot(o["x"] - objs[j]["x"], o["y"] - objs[j]["y"])
                    if d < limit:
                        heapq.heappush(heap, (d, j, i))
        objs[i] = o
        grid.setdefault(g, set()).add(i)

    def remove(i: int) -> dict:
        o = objs.pop(i)
        grid[(math.floor(o["x"] / limit), math.floor(o["y"] / limit))].discard(i)
        return o

    for i, o in list(objs.items()):
        place(i, o)
    while heap:
        d, i, j = heapq.heappop(heap)
        if i not in objs or j not in objs:
            continue
        place(fresh, _merged(remove(i), remove(j), d))
        fresh += 1
    return fresh


def _merge_closest(pdf: pd.DataFrame, limit: float) -> list[dict]:
    """Merge the closest pair below ``limit`` until none is left, the older of equally close ones first.

    Points of one place queue for each other. Then pairs are looked for in rounds, each with twice the mesh of the one
    before: points that are left lie at least a mesh apart, so few lie in a cell of the next, and few pairs are kept.
    """
    objs = dict(enumerate(pdf.sort_values("ord").to_dict("records")))
    fresh = _merge_copies(objs, len(objs))
    at = np.array([(o["x"], o["y"]) for o in objs.values()]).reshape(-1, 2)
    mesh = limit
    for _ in range(40):
        if np.unique(np.floor(at / mesh), axis=0, return_counts=True)[1].max(initial=0) <= _CROWD:
            break
        mesh /= 2.0
    while mesh < limit:
        fresh = _merge_below(objs, fresh, mesh)
        mesh *= 2.0
    _merge_below(objs, fresh, limit)
    return list(objs.values())


def dedupe_points(points: DataFrame, keys: Sequence[str] = ("run_id", "label"), min_dist: Mapping[str, float] = MIN_DIST, default: float = MIN_DIST_DEFAULT) -> DataFrame:
    """Repeatedly merge the closest two points of a label that lie below its minimum distance.

    Weighted means stay inside the extent of what they merge, and rounding moves them by at most half
    a millimetre, so parts with wider gaps never interact and run side by side.
    """
    keys = list(keys)
    limit = F.lit(float(default))
    for name, metres in min_dist.items():
        limit = F.when(F.col("label") == name, F.lit(float(metres))).otherwise(limit)
    p = points.withColumn("_lim", limit).withColumn("merged_from", F.lit(1).cast("bigint"))
    parted = axis_parts(p, keys, F.col("_lim") + 0.001)
    cols = [*keys, "cid", "x", "y", "hits", "spread_m", "merged_from"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_merge_closest(pdf, float(pdf["_lim"].iloc[0])))[cols]

    schema = ", ".join(f"`{c}` {dict(parted.dtypes)[c]}" for c in cols)
    return parted.select(*cols, "ord", "part", "_lim").groupBy(*keys, "part").applyInPandas(run, schema)
