"""Cell classes, neighbourhoods, morphology, components, distances and labels on cell tables.

Neighbourhood rules send each cell to the positions it concerns and aggregate there (one shuffle with
map-side combining). Nothing is grouped by map alone, so a huge map is spread like many small ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from surveykit.operators.components import connected_components
from surveykit.session import settle

AT = ("map_id", "col", "row")
FOUR = [(1, 0), (-1, 0), (0, 1), (0, -1)]
EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]

#: side of the tiles that components are labelled in
TILE = 256

# fixed values: class limits of the grid flavours (occupied at most / free at least, or exact)
SCHEMES = {"segment": (50, 250), "plan": (100, 240)}


def cell_class(value: Column, scheme: str) -> Column:
    """``occ``, ``free`` or ``unknown`` under one of the threshold sets."""
    if scheme == "exact":
        return F.when(value == 0, "occ").when(value == 254, "free").otherwise("unknown")
    if scheme == "live":  # -1 unknown, 0..49 free, 50.. occupied
        return F.when(value >= 50, "occ").when(value >= 0, "free").otherwise("unknown")
    low, high = SCHEMES[scheme]
    return F.when(value <= low, "occ").when(value >= high, "free").otherwise("unknown")


def bounds(cells: DataFrame, keys: Sequence[str] = ("map_id",), margin: int = 0) -> DataFrame:
    return cells.groupBy(*keys).agg(
        (F.min("col") - margin).alias("c0"),
        (F.max("col") + margin).alias("c1"),
        (F.min("row") - margin).alias("r0"),
        (F.max("row") + margin).alias("r1"),
    )


def inside(col: str = "col", row: str = "row") -> Column:
    return F.col(col).between(F.col("c0"), F.col("c1")) & F.col(row).between(F.col("r0"), F.col("r1"))


def crop(cells: DataFrame, known: Column, margin: int, keys: Sequence[str] = ("map_id",)) -> DataFrame:
    """Cells within the bounding box of known cells plus a margin (one box row per map)."""
    box = bounds(cells.where(known), keys, margin)
    return cells.join(box, list(keys)).where(inside()).drop("c0", "c1", "r0", "r1")


# ---------------------------------------------------------------- neighbourhoods


def element(kind: str, radius: int) -> list[tuple[int, int]]:
    """Offsets of a structuring element: box, cross or ellipse of side ``2 radius + 1``."""
    span = range(-radius, radius + 1)
    if kind == "box":
        return [(a, b) for a in span for b in span]
    if kind == "cross":
        return [(a, b) for a in span for b in span if a == 0 or b == 0]
    if kind == "ellipse":
        wide = {b: round(radius * math.sqrt((radius * radius - b * b) / (radius * radius))) for b in span}
        return [(a, b) for b in span for a in span if abs(a) <= wide[b]]
    raise ValueError(f"unknown element {kind}")


def _offsets(items: Iterable[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("dc"), F.lit(b).alias("dr")) for a, b in items])


def spread(cells: DataFrame, offsets: Iterable[tuple[int, int]], keep: Sequence[str] = ()) -> DataFrame:
    """Every cell at every offset position."""
    e = cells.withColumn("_o", F.explode(_offsets(list(offsets))))
    return e.select(
        "map_id",
        *[c for c in keep if c != "map_id"],
        (F.col("col") + F.col("_o.dc")).alias("col"),
        (F.col("row") + F.col("_o.dr")).alias("row"),
    )


def _axis_runs(offsets: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """A box is a row pass and a column pass; other shapes stay one pass."""
    r = max(abs(a) for a, _ in offsets)
    if len(offsets) == (2 * r + 1) ** 2 and r > 0:
        return [[(a, 0) for a in range(-r, r + 1)], [(0, b) for b in range(-r, r + 1)]]
    return [offsets]


def dilate(mask: DataFrame, offsets: list[tuple[int, int]], box: DataFrame | None = None) -> DataFrame:
    """Cells within reach of the mask; ``box`` (one row per map) cuts at the image border."""
    out = mask.select(*AT)
    for part in _axis_runs(offsets):
        out = spread(out, part).distinct()
    if box is not None:
        out = out.join(box, "map_id").where(inside()).select(*AT)
    return out


def erode(mask: DataFrame, offsets: list[tuple[int, int]], box: DataFrame | None = None) -> DataFrame:
    """Cells whose whole neighbourhood lies in the mask; beyond the image border nothing is missing."""
    out = mask.select(*AT)
    for part in _axis_runs(offsets):
        hits = spread(out, [(-a, -b) for a, b in part]).groupBy(*AT).agg(F.count("*").alias("_n"))
        need = F.lit(len(part))
        if box is not None:
            hits = hits.join(box, "map_id").where(inside())
            here = F.filter(
                _offsets(part),
                lambda o: (F.col("col") + o["dc"]).between(F.col("c0"), F.col("c1"))
                & (F.col("row") + o["dr"]).between(F.col("r0"), F.col("r1")),
            )
            need = F.size(here)
        out = hits.where(F.col("_n") == need).select(*AT)
    return out.join(mask.select(*AT), list(AT), "left_semi")


def opened(mask: DataFrame, offsets: list[tuple[int, int]], box: DataFrame | None = None) -> DataFrame:
    return dilate(erode(mask, offsets, box), offsets, box)


def closed(mask: DataFrame, offsets: list[tuple[int, int]], box: DataFrame | None = None) -> DataFrame:
    grown = dilate(mask, offsets, box)
    hits = spread(grown, [(-a, -b) for a, b in offsets]).groupBy(*AT).agg(F.count("*").alias("_n"))
    if box is None:
        return hits.where(F.col("_n") == len(offsets)).select(*AT)
    hits = hits.join(box, "map_id").where(inside())
    here = F.filter(
        _offsets(offsets),
        lambda o: (F.col("col") + o["dc"]).between(F.col("c0"), F.col("c1"))
        & (F.col("row") + o["dr"]).between(F.col("r0"), F.col("r1")),
    )
    return hits.where(F.col("_n") == F.size(here)).select(*AT)


def density(mask: DataFrame, targets: DataFrame, half: int = 12) -> DataFrame:
    """Share of mask cells in the box around each target, divided by the in-bounds cell count.

    Row sums by aggregation, column sums by a range window over one grid column. At the image edge the
    box is cut, not reflected.
    """
    box = bounds(targets)
    rows = spread(mask.select(*AT), [(a, 0) for a in range(-half, half + 1)]).groupBy(*AT).agg(F.count("*").alias("_k"))
    want = targets.select(*AT, F.lit(0).cast("bigint").alias("_k"), F.lit(1).alias("_t"))
    both = rows.withColumn("_t", F.lit(0)).unionByName(want)
    w = W.partitionBy("map_id", "col").orderBy("row").rangeBetween(-half, half)
    summed = both.withColumn("_s", F.sum("_k").over(w)).where("_t = 1")
    j = summed.join(box, "map_id")
    width = F.least("c1", F.col("col") + half) - F.greatest("c0", F.col("col") - half) + 1
    height = F.least("r1", F.col("row") + half) - F.greatest("r0", F.col("row") - half) + 1
    return j.select(*AT, (F.col("_s") / (width * height)).alias("density"))


# ---------------------------------------------------------------- components


def row_runs(mask: DataFrame, keys: Sequence[str] = ("map_id",)) -> DataFrame:
    """Cells with the id of their horizontal run. Windows run per grid row, so they are short."""
    keys = list(keys)
    w = W.partitionBy(*keys, "row").orderBy("col")
    island = F.col("col") - F.row_number().over(w)
    a = mask.select(*keys, "col", "row").withColumn("_i", island)
    start = F.min("col").over(W.partitionBy(*keys, "row", "_i"))
    return a.withColumn("run", F.shiftleft(F.col("row").cast("bigint"), 32) + start.cast("bigint")).drop("_i")


def _roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest vertex of each component of ``n`` vertices: roots are hooked under smaller ones, then paths are halved."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            return root
        np.minimum.at(root, high[apart], low[apart])
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above


def _tile_labels(col: np.ndarray, row: np.ndarray, connect: int) -> np.ndarray:
    """Smallest cell number of each cell's component inside one tile."""
    cells, first, back = np.unique((row << 32) + col, return_index=True, return_inverse=True)
    row, col = row[first], col[first]
    at = np.full((row.max() - row.min() + 2, col.max() - col.min() + 3), -1)
    r, c = row - row.min(), col - col.min() + 1
    at[r, c] = np.arange(len(cells))
    ends = [(at[r, c], at[r + dr, c + dc]) for dr, dc in ((0, 1), (1, 0), *(((1, 1), (1, -1)) if connect == 8 else ()))]
    a, b = (np.concatenate(e) for e in zip(*ends, strict=True))
    return cells[_roots_of(len(cells), a[b >= 0], b[b >= 0])][back]


def components(mask: DataFrame, connect: int = 8, keys: Sequence[str] = ("map_id",), tile: int = TILE) -> DataFrame:
    """Label connected cells: ``label`` is the smallest ``(row << 32) + col`` of the component.

    Tiles of ``tile`` x ``tile`` cells are labelled side by side, each in one task. Only labels that touch a tile's border
    enter the graph, whose components are found by star contraction.
    """
    keys = list(keys)
    where = {"_tx": F.floor(F.col("col") / tile), "_ty": F.floor(F.col("row") / tile)}
    cells = mask.select(*keys, "col", "row")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema) + ", label bigint"
    names = cells.columns

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[names].assign(label=_tile_labels(pdf["col"].to_numpy(np.int64), pdf["row"].to_numpy(np.int64), connect))

    tagged = settle(cells.withColumns(where).groupBy(*keys, "_tx", "_ty").applyInPandas(label, schema))
    x, y = F.pmod(F.col("col"), F.lit(tile)), F.pmod(F.col("row"), F.lit(tile))
    rim = tagged.where((x == 0) | (x == tile - 1) | (y == 0) | (y == tile - 1)).withColumns(where)
    steps = [(1, 0), (0, 1), *([(1, 1), (-1, 1)] if connect == 8 else [])]
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps])).alias("s")
    ahead = rim.select(*keys, "col", "row", "_tx", "_ty", "label", step)
    ahead = ahead.select(*keys, (F.col("col") + F.col("s.a")).alias("col"), (F.col("row") + F.col("s.b")).alias("row"), F.col("_tx").alias("_fx"), F.col("_ty").alias("_fy"), F.col("label").alias("a"))
    ahead = ahead.where((F.floor(F.col("col") / tile) != F.col("_fx")) | (F.floor(F.col("row") / tile) != F.col("_fy")))
    meets = ahead.join(rim.select(*keys, "col", "row", F.col("label").alias("b")), [*keys, "col", "row"]).select(*keys, "a", "b")
    roots = connected_components(meets, keys).select(*keys, F.col("id").alias("label"), "root")
    return tagged.join(roots, [*keys, "label"], "left").select(*keys, "col", "row", F.coalesce("root", "label").alias("label"))


def component_sizes(labelled: DataFrame, keys: Sequence[str] = ("map_id",)) -> DataFrame:
    return labelled.groupBy(*keys, "label").agg(F.count("*").alias("n"))


def keep_area(labelled: DataFrame, minimum: int, keys: Sequence[str] = ("map_id",)) -> DataFrame:
    """Cells of components with at least ``minimum`` cells."""
    big = component_sizes(labelled, keys).where(F.col("n") >= minimum).select(*keys, "label")
    return labelled.join(big, [*keys, "label"], "left_semi")


def keep_largest(labelled: DataFrame, keys: Sequence[str] = ("map_id",)) -> DataFrame:
    """Cells of the largest component per map; equal sizes go to the smaller label."""
    best = component_sizes(labelled, keys).groupBy(*keys).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))
    return labelled.join(best, [*keys, "label"], "left_semi")


def fill_holes(mask: DataFrame) -> DataFrame:
    """Mask plus every enclosed background part (4-connected background that misses the border)."""
    box = bounds(mask)
    lines = box.withColumn("row", F.explode(F.sequence("r0", "r1")))
    # one background row per grid line, expanded in parallel
    back = lines.select("map_id", "row", F.explode(F.sequence("c0", "c1")).alias("col")).select(*AT)
    back = back.join(mask.select(*AT), list(AT), "left_anti")
    lab = settle(components(back, 4))
    rim = (F.col("col") == F.col("c0")) | (F.col("col") == F.col("c1")) | (F.col("row") == F.col("r0")) | (F.col("row") == F.col("r1"))
    outer = lab.join(box, "map_id").where(rim).select("map_id", "label").distinct()
    holes = lab.join(outer, ["map_id", "label"], "left_anti")
    return mask.select(*AT).unionByName(holes.select(*AT))


# ---------------------------------------------------------------- distances


def _nearest_on_line(t: np.ndarray, c: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """For each place ``t`` the source that minimises ``(t - c)^2 + cost``, the first in the given order of equal ones.

    Sources ordered by place, the best one moves to the right with ``t``. So the middle place of a run of places cuts
    the sources in two, and all runs of one depth are searched together: every depth looks at each source about once.
    """
    n = len(c)
    order = np.lexsort((np.arange(n), c))
    c, cost, rank = c[order], cost[order], order
    places, back = np.unique(t, return_inverse=True)
    best = np.empty(len(places), np.int64)
    # runs of places [a, b) whose sources lie in [low, high]
    a, b, low, high = (np.array([v]) for v in (0, len(places), 0, n - 1))
    while len(a):
        mid = (a + b) // 2
        size = high - low + 1
        starts = np.cumsum(size) - size
        run = np.repeat(np.arange(len(a)), size)
        source = np.arange(size.sum()) - starts[run] + low[run]
        d2 = (places[mid][run] - c[source]) ** 2 + cost[source]
        top = np.minimum.reduceat(d2, starts)
        tied = np.where(d2 == top[run], rank[source], n)
        first = np.minimum.reduceat(tied, starts)
        hit = np.flatnonzero(tied == first[run])
        best[mid] = source[hit]
        # equal sources: those left of the first of them can't win further right, nor the others further left
        left, right = np.full(len(a), n), np.full(len(a), -1)
        ties = np.flatnonzero(d2 == top[run])
        np.minimum.at(left, run[ties], source[ties])
        np.maximum.at(right, run[ties], source[ties])
        a, b, low, high = (np.concatenate(p) for p in ((a, mid + 1), (mid, b), (low, left), (right, high)))
        some = a < b
        a, b, low, high = a[some], b[some], low[some], high[some]
    return order[best[back]]


def _row_nearest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Nearest source of each wanted cell of one grid row, from the vertical distances; ties: lower row, lower column."""
    src = pdf[pdf["o_row"].notna()]
    want = pdf[pdf["want"]]
    out = want[["map_id", "col", "row"]].copy()
    if src.empty or want.empty:
        out["o_col"], out["o_row"], out["d2"] = pd.NA, pd.NA, pd.NA
        return out.iloc[0:0]
    c, rows = src["col"].to_numpy(np.int64), src["o_row"].to_numpy(np.int64)
    order = np.lexsort((c, rows))
    c, rows = c[order], rows[order]
    t, cost = want["col"].to_numpy(np.int64), (rows - int(src["row"].iloc[0])) ** 2
    pick = _nearest_on_line(t, c, cost)
    out["o_col"], out["o_row"], out["d2"] = c[pick], rows[pick], (t - c[pick]) ** 2 + cost[pick]
    return out


def nearest_cells(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Nearest source of each target cell: ``o_col, o_row, d2`` in cells; ties go to the lower row, then lower column.

    First the nearest source along each grid column, for the lines that hold targets, then the best of one grid row: both
    groups are single lines of the raster, and each is read once. Targets of a map without sources have no result.
    """
    lines = targets.select("map_id", "row").distinct().withColumn("_no", F.pmod(F.xxhash64("row"), F.lit(64)))
    columns = sources.select("map_id", "col").distinct().withColumn("_no", F.explode(F.sequence(F.lit(0), F.lit(63))))
    crossings = lines.join(columns, ["map_id", "_no"]).select(*AT, F.lit(False).alias("hit"))
    return _by_lines(crossings.unionByName(sources.select(*AT, F.lit(True).alias("hit"))).withColumn("want", F.lit(False)), targets)


def _by_lines(cells: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Nearest ``hit`` cell of each ``want`` cell, and of ``targets``; a row's sources are the nearest hits of its cells."""
    # both ways from an end of the line: a frame that reaches on to the other end is read anew for every cell
    w = W.partitionBy("map_id", "col").rowsBetween(W.unboundedPreceding, 0)
    hit = F.when(F.col("hit"), F.col("row"))
    low = F.last(hit, ignorenulls=True).over(w.orderBy("row", F.desc("hit")))
    high = F.last(hit, ignorenulls=True).over(w.orderBy(F.desc("row"), F.desc("hit")))
    lines = cells.withColumns({"_a": low, "_b": high})
    up = F.col("_b") - F.col("row")
    down = F.col("row") - F.col("_a")
    o_row = F.when(F.col("_b").isNull() | (down <= up), F.col("_a")).otherwise(F.col("_b"))
    lines = lines.select(*AT, "want", F.coalesce(o_row, "_b").alias("o_row"))
    if targets is not None:
        lines = lines.unionByName(targets.select(*AT, F.lit(True).alias("want"), F.lit(None).cast("int").alias("o_row")))
    schema = f"map_id {dict(cells.dtypes)['map_id']}, col int, row int, o_col int, o_row int, d2 bigint"
    cast = lines.select("map_id", F.col("col").cast("int").alias("col"), F.col("row").cast("int").alias("row"), "want", F.col("o_row").cast("int").alias("o_row"))
    return cast.groupBy("map_id", "row").applyInPandas(_row_nearest, schema)


def distance(free: DataFrame, box: DataFrame | None = None) -> DataFrame:
    """Exact distance (in cells) of each free cell to the nearest cell that is not free.

    The nearest obstacle always touches free space, so the rim around the mask stands for all obstacles, and the cells of
    the mask and its rim stand for all crossings of columns and rows. Ties go to the lower row, then the lower column.
    """
    f = free.select(*AT)
    rim = dilate(f, EIGHT, box).join(f, list(AT), "left_anti")
    both = f.select(*AT, F.lit(True).alias("want"), F.lit(False).alias("hit")).unionByName(rim.select(*AT, F.lit(False).alias("want"), F.lit(True).alias("hit")))
    return _by_lines(both).withColumn("dist", F.sqrt(F.col("d2").cast("double")))


def fill_nearest(targets: DataFrame, labelled: DataFrame, start: int | None = None) -> DataFrame:
    """Give each target the label of the nearest labelled cell (ties: lower row, then lower column).

    A labelled cell is its own nearest one. Targets of a map without labelled cells have no result. ``start`` was the
    first radius of an earlier search and has no effect.
    """
    near = nearest_cells(targets.select(*AT), labelled)
    names = labelled.select("map_id", F.col("col").alias("o_col"), F.col("row").alias("o_row"), "label")
    return near.join(names, ["map_id", "o_col", "o_row"]).select(*AT, "label")


# ---------------------------------------------------------------- labels


def seed_scan(dist: DataFrame, thresholds: Sequence[float], tie: str = "larger") -> DataFrame:
    """Threshold with most components of ``dist >= t`` per map, and the count.

    Both tie rules of the method family pick the larger threshold; they differ in the threshold list.
    """
    ts = F.array(*[F.lit(float(t)) for t in thresholds])
    over = dist.select("map_id", "col", "row", F.explode(F.filter(ts, lambda t: t <= F.col("dist"))).alias("t"))
    lab = components(over, 4, ["map_id", "t"])
    n = lab.select("map_id", "t", "label").distinct().groupBy("map_id", "t").agg(F.count("*").alias("n"))
    order = F.struct(F.col("n"), F.col("t") if tie == "larger" else -F.col("t"))
    best = n.groupBy("map_id").agg(F.max_by(F.struct("t", "n"), order).alias("b"))
    return best.select("map_id", F.col("b.t").alias("threshold"), F.col("b.n").alias("components"))


TILE = 256


def _flood(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spread (steps, label) inside one tile until nothing improves; halo cells only give."""
    c0, r0 = pdf["col"].min(), pdf["row"].min()
    width, height = pdf["col"].max() - c0 + 3, pdf["row"].max() - r0 + 3
    far = np.iinfo(np.int64).max
    cost = np.full((height, width), far, dtype=np.int64)
    open_ = np.zeros((height, width), dtype=bool)
    r, c = (pdf["row"] - r0 + 1).to_numpy(), (pdf["col"] - c0 + 1).to_numpy()
    open_[r, c] = True
    known = pdf["label"].notna().to_numpy()
    labels = pdf["label"].fillna(0).to_numpy(np.int64)
    names = np.unique(labels[known])
    if len(names):
        rank = np.searchsorted(names, labels)
        size = len(names) + 1
        cost[r[known], c[known]] = pdf["steps"].fillna(0).to_numpy(np.int64)[known] * size + rank[known]
        while True:
            near = np.minimum.reduce([np.roll(cost, 1, 0), np.roll(cost, -1, 0), np.roll(cost, 1, 1), np.roll(cost, -1, 1)])
            step = np.where(near < far, near + size, far)
            better = open_ & (step < cost)
            if not better.any():
                break
            cost[better] = step[better]
        v = cost[r, c]
        hit = v < far
        pdf = pdf.assign(steps=pd.array(np.where(hit, v // size, 0), dtype="Int64"), label=pd.array(np.where(hit, names[np.minimum(v % size, len(names) - 1)], 0), dtype="Int64"))
        pdf.loc[~hit, ["steps", "label"]] = pd.NA
    own = pdf[pdf["home"]]
    return own[["map_id", "col", "row", "steps", "label"]]


def wavefront(seeds: DataFrame, free: DataFrame, tile: int = TILE) -> DataFrame:
    """Label of the geodesically nearest seed inside the free mask, 4-connected; ties: lower label.

    The mask is cut into tiles. Each round floods every tile that can still change, with a one-cell
    halo, then hands its border to the neighbours. Rounds follow the number of tiles along the longest
    way, not the number of cells.
    """
    start = free.select(*AT).join(seeds.select(*AT, "label"), list(AT), "left").withColumn(
        "steps", F.when(F.col("label").isNotNull(), F.lit(0)).cast("bigint")
    ).withColumn("label", F.col("label").cast("bigint"))
    state = settle(start)
    tc, tr = F.floor(F.col("col") / tile), F.floor(F.col("row") / tile)
    types = dict(state.dtypes)
    schema = f"map_id {types['map_id']}, col {types['col']}, row {types['row']}, steps bigint, label bigint"
    active = None
    while True:
        homes = state.withColumns({"_tc": tc, "_tr": tr, "home": F.lit(True)})
        halo = state.where("label is not null").withColumn("_o", F.explode(_offsets(FOUR))).withColumns(
            {"_tc": F.floor((F.col("col") + F.col("_o.dc")) / tile), "_tr": F.floor((F.col("row") + F.col("_o.dr")) / tile)}
        )
        halo = halo.where((F.col("_tc") != tc) | (F.col("_tr") != tr)).drop("_o").distinct().withColumn("home", F.lit(False))
        both = homes.unionByName(halo)
        if active is not None:
            both = both.join(active, ["map_id", "_tc", "_tr"], "left_semi")
        flooded = settle(both.groupBy("map_id", "_tc", "_tr").applyInPandas(_flood, schema))
        old = state.select(*AT, F.col("steps").alias("_s"), F.col("label").alias("_l"))
        moved = flooded.join(old, list(AT)).where(~F.col("steps").eqNullSafe(F.col("_s")) | ~F.col("label").eqNullSafe(F.col("_l")))
        # tiles next to a changed border cell have to run again
        edge = moved.withColumn("_o", F.explode(_offsets(FOUR))).select(
            "map_id",
            F.floor((F.col("col") + F.col("_o.dc")) / tile).alias("_tc"),
            F.floor((F.col("row") + F.col("_o.dr")) / tile).alias("_tr"),
            tc.alias("_hc"),
            tr.alias("_hr"),
        ).where("_tc <> _hc or _tr <> _hr").select("map_id", "_tc", "_tr").distinct()
        edge = settle(edge)
        untouched = state.join(flooded.select(*AT), list(AT), "left_anti").select(*flooded.columns)
        state = settle(untouched.unionByName(flooded))
        if edge.isEmpty():
            return state
        active = edge


def basins(dist: DataFrame, seeds: DataFrame, tile: int = TILE) -> DataFrame:
    """Split the free space among seeds: climb to larger distance until a seed is met.

    Each cell points to its highest 8-neighbour (ties: lower row, then column), seeds to themselves;
    doubling the pointers resolves all climbs in logarithmic rounds. Cells that end on a peak without
    a seed take the geodesically nearest label. This re-aims a priority flood, whose exact tie order
    has no distributed meaning.
    """
    d = dist.select(*AT, F.col("dist"))
    offer = d.withColumn("_o", F.explode(_offsets([*EIGHT, (0, 0)]))).select(
        "map_id",
        (F.col("col") + F.col("_o.dc")).alias("col"),
        (F.col("row") + F.col("_o.dr")).alias("row"),
        F.struct((-F.col("dist")).alias("h"), F.col("row").alias("r"), F.col("col").alias("c")).alias("_p"),
    )
    up = offer.groupBy(*AT).agg(F.min("_p").alias("_p")).join(d.select(*AT), list(AT), "left_semi")
    s = seeds.select(*AT, "label")
    links = up.join(s, list(AT), "left").select(
        *AT,
        F.when(F.col("label").isNotNull(), F.col("col")).otherwise(F.col("_p.c")).alias("pc"),
        F.when(F.col("label").isNotNull(), F.col("row")).otherwise(F.col("_p.r")).alias("pr"),
    )
    links = settle(links)
    while True:
        nxt = links.select("map_id", F.col("col").alias("pc"), F.col("row").alias("pr"), F.col("pc").alias("nc"), F.col("pr").alias("nr"))
        step = links.join(nxt, ["map_id", "pc", "pr"]).select(*AT, F.col("nc").alias("pc"), F.col("nr").alias("pr"), ((F.col("nc") != F.col("pc")) | (F.col("nr") != F.col("pr"))).alias("_m"))
        step = settle(step)
        changed = not step.where("_m").isEmpty()
        links = step.drop("_m")
        if not changed:
            break
    tops = s.select("map_id", F.col("col").alias("pc"), F.col("row").alias("pr"), "label")
    lab = settle(links.join(tops, ["map_id", "pc", "pr"], "left").select(*AT, "label"))
    if lab.where("label is null").isEmpty():
        return lab
    return wavefront(lab.where("label is not null"), lab, tile).select(*AT, "label")
