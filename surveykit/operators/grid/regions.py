"""Regions of labelled cells: adjacency, merging, doors, cuts, visibility and evaluation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from surveykit.functions.geometry import hypot2
from surveykit.operators.grid.cells import AT, EIGHT, FOUR, components, component_sizes, inside, nearest_cells, spread
from surveykit.operators.spatial import _cells, radius_join
from surveykit.session import discard, settle

# ---------------------------------------------------------------- measures


def region_stats(labelled: DataFrame, res: float) -> DataFrame:
    """Cells, area, centroid and bounding box per region."""
    return labelled.groupBy("map_id", "label").agg(
        F.count("*").alias("n_cells"),
        (F.count("*") * res * res).alias("area_m2"),
        F.avg("col").alias("cx"),
        F.avg("row").alias("cy"),
        F.min("col").alias("c0"),
        F.max("col").alias("c1"),
        F.min("row").alias("r0"),
        F.max("row").alias("r1"),
    )


def unknown_ring(labelled: DataFrame, unknown: DataFrame, box: DataFrame | None = None) -> DataFrame:
    """Share of each region's 8-neighbour ring that is unknown; phantom above one half."""
    own = labelled.select(*AT, "label")
    ring = spread(own, EIGHT, ["label"]).distinct().join(own, [*AT, "label"], "left_anti")
    if box is not None:
        ring = ring.join(box, "map_id").where(inside()).select("map_id", "label", "col", "row")
    u = unknown.select(*AT, F.lit(1).alias("_u"))
    g = ring.join(u, list(AT), "left").groupBy("map_id", "label").agg(F.count("*").alias("ring"), F.count("_u").alias("unknown"))
    share = F.col("unknown") / F.greatest(F.lit(1), F.col("ring"))
    return g.withColumn("unknown_ratio", share).withColumn("status", F.when(share > 0.5, "phantom").otherwise("room"))


def _contacts(labelled: DataFrame) -> DataFrame:
    """Label pairs that meet across a cell side, one row per side and direction."""
    own = labelled.select(*AT, "label")
    here = own.select(*AT, F.col("label").alias("s"), F.lit(None).cast("bigint").alias("x"), F.lit(None).cast("bigint").alias("y"))
    right = own.select("map_id", (F.col("col") + 1).alias("col"), "row", F.lit(None).cast("bigint").alias("s"), F.col("label").alias("x"), F.lit(None).cast("bigint").alias("y"))
    up = own.select("map_id", "col", (F.col("row") + 1).alias("row"), F.lit(None).cast("bigint").alias("s"), F.lit(None).cast("bigint").alias("x"), F.col("label").alias("y"))
    met = here.unionByName(right).unionByName(up).groupBy(*AT).agg(F.max("s").alias("s"), F.max("x").alias("x"), F.max("y").alias("y"))
    pairs = met.where("s is not null").select("map_id", "col", "row", "s", F.explode(F.array("x", "y")).alias("o")).where("o is not null and o <> s")
    both = F.explode(F.array(F.struct(F.col("s").alias("label"), F.col("o").alias("neighbour")), F.struct(F.col("o").alias("label"), F.col("s").alias("neighbour"))))
    return pairs.select("map_id", both.alias("p")).select("map_id", "p.label", "p.neighbour")


def adjacency(labelled: DataFrame) -> DataFrame:
    """Shared border length in cell sides for each ordered pair of neighbouring regions.

    Every cell meets its left and lower neighbour in one aggregation; nothing wraps around the image.
    """
    return _contacts(labelled.withColumn("label", F.col("label").cast("bigint"))).groupBy("map_id", "label", "neighbour").agg(F.count("*").alias("shared"))


def borders(labelled: DataFrame, free: DataFrame, box: DataFrame) -> DataFrame:
    """Wall and total border per region; the total is wall plus contact with other regions."""
    own = labelled.select(*AT, F.col("label").cast("bigint").alias("label"))
    out = spread(own, FOUR, ["label"]).join(box, "map_id").where(inside()).select("map_id", "label", "col", "row")
    wall = out.join(free.select(*AT), list(AT), "left_anti").groupBy("map_id", "label").agg(F.count("*").alias("wall"))
    near = adjacency(own).groupBy("map_id", "label").agg(F.sum("shared").alias("contact"))
    base = own.select("map_id", "label").distinct()
    j = base.join(wall, ["map_id", "label"], "left").join(near, ["map_id", "label"], "left").fillna(0, ["wall", "contact"])
    return j.withColumn("total", F.col("wall") + F.col("contact"))


def boundary_cells(labelled: DataFrame) -> DataFrame:
    """Cells that touch another region across a side (no wraparound)."""
    own = labelled.select(*AT, "label")
    seen = spread(own, FOUR, ["label"]).groupBy(*AT).agg(F.min("label").alias("_a"), F.max("label").alias("_b"))
    return own.join(seen, list(AT)).where((F.col("_a") != F.col("label")) | (F.col("_b") != F.col("label"))).select(*AT, "label")


def label_anchor(labelled: DataFrame, dist: DataFrame) -> DataFrame:
    """Deepest cell of each region (ties: lower row, then lower column)."""
    j = labelled.join(dist.select(*AT, "dist"), list(AT))
    best = F.max_by(F.struct("col", "row", "dist"), F.struct("dist", -F.col("row"), -F.col("col")))
    g = j.groupBy("map_id", "label").agg(best.alias("b"))
    return g.select("map_id", "label", "b.col", "b.row", "b.dist")


# ---------------------------------------------------------------- merging


def _contact_facts(regions: DataFrame, contacts: DataFrame) -> DataFrame:
    """Per region with a neighbour: its size, border and what the rules ask about its contacts."""
    ring = contacts.groupBy("map_id", F.col("a").alias("label")).agg(F.sum("shared").alias("border"), F.count("*").alias("k"))
    known = regions.join(ring, ["map_id", "label"]).withColumn("total", F.greatest(F.lit(1), F.col("wall") + F.col("border")))
    mine = known.select("map_id", F.col("label").alias("a"), "n", "wall", "k", "total")
    theirs = known.select("map_id", F.col("label").alias("b"), F.col("n").alias("n_b"), F.col("k").alias("k_b"), F.col("total").alias("total_b"))
    pairs = contacts.join(mine, ["map_id", "a"]).join(theirs, ["map_id", "b"])
    own, other = F.col("shared") / F.col("total"), F.col("shared") / F.col("total_b")
    inward = F.col("n") <= F.col("n_b")
    open_ = F.when(inward, (own >= 0.20) & (other >= 0.10)).otherwise((other >= 0.20) & (own >= 0.10))
    move = F.when(inward, F.struct(F.col("a").alias("src"), F.col("b").alias("dst"))).otherwise(F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return pairs.groupBy("map_id", F.col("a").alias("label"), "n", "wall", "k", "total").agg(
        F.max("shared").alias("top"),
        F.min_by("b", F.struct(-F.col("shared"), "b")).alias("longest"),
        F.max_by("b", F.struct("shared", "b")).alias("widest"),
        F.max("k_b").alias("k_b"),
        F.min(F.when(open_, F.struct("b", move.alias("move"))))["move"].alias("open"),
        F.min(F.when(own > 0.40, F.col("b"))).alias("wide"),
    )


def _moves(regions: DataFrame, contacts: DataFrame, rules: str, res: float, min_room: float, single: float) -> DataFrame:
    """``map_id, src, dst``: the move of each map that has one."""
    area, walled = F.col("n") * (res * res), F.col("wall") / F.col("total")
    to = lambda c: F.struct(F.col("label").alias("src"), F.col(c).alias("dst"))
    lone = F.col("k") == 1
    if rules == "small":
        choice = F.when((area < min_room) | (lone & (area < single)), to("longest"))
    else:
        choice = (
            F.when((area < min_room) & (F.col("top") / F.col("total") >= 0.20), to("widest"))
            .when(area < min_room, to("longest"))
            .when(lone & (area < single) & (walled < 0.75), to("longest"))
            .when(lone & (F.col("k_b") <= 2) & (walled >= 0.50), to("longest"))
            .when(F.col("open").isNotNull(), F.col("open"))
            .when(F.col("wide").isNotNull(), to("wide"))
        )
    facts = _contact_facts(regions, contacts).withColumn("move", choice).where("move IS NOT NULL")
    return facts.groupBy("map_id").agg(F.min_by("move", F.struct("n", "label")).alias("m")).select("map_id", "m.src", "m.dst")


def merge_regions(labelled: DataFrame, free: DataFrame, box: DataFrame, res: float, rules: str = "small", min_room: float = 2.0, single: float = 12.5) -> DataFrame:
    """Cells with merged labels under the small-room rules or the five ordered rules.

    Cells are reduced once to two tables: regions (cells, wall) and contacts (shared border, both ways).
    In each round every map makes one move, the first in order of area, until no map has one. A round is
    a few joins over regions, so no task or row holds a map; the cells only receive a label at the end.
    """
    own = settle(labelled.select(*AT, F.col("label").cast("bigint").alias("label")))
    wall = borders(own, free, box).select("map_id", "label", "wall")
    regions = settle(component_sizes(own).join(wall, ["map_id", "label"], "left").select("map_id", "label", "n", F.coalesce("wall", F.lit(0)).alias("wall")))
    contacts = settle(adjacency(own).select("map_id", F.col("label").alias("a"), F.col("neighbour").alias("b"), "shared"))
    homes = settle(regions.select("map_id", "label", F.col("label").alias("merged")))
    renamed = lambda c: F.when(F.col(c) == F.col("src"), F.col("dst")).otherwise(F.col(c)).alias(c)
    while True:
        moves = settle(_moves(regions, contacts, rules, res, min_room, single))
        if moves.isEmpty():
            break
        spent = (regions, contacts, homes, moves)
        grown = regions.join(moves, "map_id", "left").select("map_id", renamed("label"), "n", "wall")
        joined = contacts.join(moves, "map_id", "left").select("map_id", renamed("a"), renamed("b"), "shared").where("a <> b")
        homes = settle(homes.join(moves, "map_id", "left").select("map_id", "label", renamed("merged")))
        regions = settle(grown.groupBy("map_id", "label").agg(F.sum("n").alias("n"), F.sum("wall").alias("wall")))
        contacts = settle(joined.groupBy("map_id", "a", "b").agg(F.sum("shared").alias("shared")))
        for cut in spent:
            discard(cut)
    alone = contacts.select("map_id", F.col("a").alias("label")).distinct().withColumn("near", F.lit(True))
    sure = F.col("n") * (res * res) >= 0.5
    stay = regions.join(alone, ["map_id", "label"], "left").where(sure if rules == "small" else sure | F.col("near").isNotNull())
    mapping = homes.join(stay.select("map_id", F.col("label").alias("merged")), ["map_id", "merged"])
    return own.join(mapping, ["map_id", "label"]).select(*AT, F.col("merged").alias("label"))


# ---------------------------------------------------------------- ridges and doors


def ridge_cells(dist: DataFrame, apart: float = 3.0) -> DataFrame:
    """Free cells between obstacles: a side neighbour's nearest obstacle lies far from the own one.

    Re-aims the medial axis as a local test on the nearest-obstacle columns of ``distance``.
    """
    d = dist.select(*AT, "dist", "o_col", "o_row")
    n = d.select("map_id", F.col("col").alias("nc"), F.col("row").alias("nr"), F.col("dist").alias("n_dist"), F.col("o_col").alias("n_ocol"), F.col("o_row").alias("n_orow"))
    step = d.withColumn("_o", F.explode(F.array(F.struct(F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.lit(0).alias("a"), F.lit(1).alias("b")))))
    step = step.withColumns({"nc": F.col("col") + F.col("_o.a"), "nr": F.col("row") + F.col("_o.b")}).drop("_o")
    gap = hypot2((F.col("o_col") - F.col("n_ocol")).cast("double"), (F.col("o_row") - F.col("n_orow")).cast("double"))
    far = step.join(n, ["map_id", "nc", "nr"]).where(gap > F.greatest(F.lit(apart), F.col("dist")))
    # of the two cells the one with more clearance is the ridge
    own = F.col("dist") >= F.col("n_dist")
    picked = far.select("map_id", F.when(own, F.col("col")).otherwise(F.col("nc")).alias("col"), F.when(own, F.col("row")).otherwise(F.col("nr")).alias("row")).distinct()
    return d.join(picked, list(AT), "left_semi")


def _degree(ridge: DataFrame) -> DataFrame:
    near = spread(ridge.select(*AT), EIGHT).groupBy(*AT).agg(F.count("*").alias("deg"))
    return ridge.join(near, list(AT), "left").withColumn("deg", F.coalesce("deg", F.lit(0)))


def ridge_prune(ridge: DataFrame, spur: int) -> DataFrame:
    """Remove leaf branches shorter than ``spur`` cells, repeatedly.

    Branches are the parts left after taking out junction cells; a short part with an end cell and a
    junction beside it is a spur.
    """
    current = settle(ridge)
    while True:
        d = settle(_degree(current))
        arms = d.where("deg <= 2")
        lab = components(arms.select(*AT), 8)
        ends = d.where("deg = 1").select(*AT)
        joints = spread(d.where("deg >= 3").select(*AT), EIGHT).distinct()
        marked = lab.join(ends.withColumn("_e", F.lit(1)), list(AT), "left").join(joints.withColumn("_j", F.lit(1)), list(AT), "left")
        short = marked.groupBy("map_id", "label").agg(F.count("*").alias("n"), F.max("_e").alias("e"), F.max("_j").alias("j")).where(
            (F.col("n") < spur) & F.col("e").isNotNull() & F.col("j").isNotNull()
        )
        gone = settle(lab.join(short.select("map_id", "label"), ["map_id", "label"], "left_semi").select(*AT))
        if gone.isEmpty():
            return current
        current = settle(current.join(gone, list(AT), "left_anti"))


def critical_points(ridge: DataFrame, half: int, ceiling: float) -> DataFrame:
    """Ridge cells of least clearance within the window, strictly below its largest, up to ``ceiling``."""
    c, r = F.col("col"), F.col("row")
    probe = ridge.select(*AT, "dist").withColumn("_g", F.explode(_cells(c - half, c + half, r - half, r + half, float(2 * half))))
    home = ridge.select(
        "map_id", F.struct(F.floor(c / float(2 * half)).alias("gx"), F.floor(r / float(2 * half)).alias("gy")).alias("_g"), c.alias("c2"), r.alias("r2"), F.col("dist").alias("d2")
    )
    near = probe.where(F.col("dist") <= ceiling).join(home, ["map_id", "_g"]).where((F.abs(c - F.col("c2")) <= half) & (F.abs(r - F.col("r2")) <= half))
    g = near.groupBy(*AT, "dist").agg(F.min("d2").alias("lo"), F.max("d2").alias("hi"))
    hit = g.where((F.col("dist") <= F.col("lo") + 1e-6) & (F.col("dist") < F.col("hi") - 1e-6)).select(*AT)
    return ridge.join(hit, list(AT), "left_semi")


def line_cells(ac: Column, ar: Column, bc: Column, br: Column) -> Column:
    """Cells of a 4-connected line: one column or one row step at a time."""
    dc, dr = F.abs(bc - ac), F.abs(br - ar)
    n = dc + dr
    sc, sr = F.signum(bc - ac).cast("int"), F.signum(br - ar).cast("int")

    def at(i: Column) -> Column:
        k = F.when(n == 0, 0).otherwise(F.floor((i * dc * 2 + n) / (n * 2))).cast("int")
        return F.struct((ac + sc * k).cast("int").alias("col"), (ar + sr * (i - k)).cast("int").alias("row"))

    return F.transform(F.sequence(F.lit(0), n.cast("int")), at)


def critical_cuts(points: DataFrame, obstacles: DataFrame, min_angle_deg: float = 60.0) -> DataFrame:
    """Line cells from the nearest obstacle to the nearest one on another side of each critical point.

    ``obstacles`` are the non-free cells that touch free space. The search window follows the largest
    clearance of a critical point, which the door ceiling bounds.
    """
    reach = F.floor("dist").cast("int") + 4
    p = points.withColumn("_w", reach).where("o_col <> col or o_row <> row")
    cos_min = math.cos(math.radians(min_angle_deg))
    c, r = F.col("col"), F.col("row")
    probe = p.withColumn("_g", F.explode(_cells(c - F.col("_w"), c + F.col("_w"), r - F.col("_w"), r + F.col("_w"), 16.0)))
    o = obstacles.select("map_id", F.struct(F.floor(F.col("col") / 16.0).alias("gx"), F.floor(F.col("row") / 16.0).alias("gy")).alias("_g"), F.col("col").alias("c2"), F.col("row").alias("r2"))
    j = probe.join(o, ["map_id", "_g"]).where((F.abs(c - F.col("c2")) <= F.col("_w")) & (F.abs(r - F.col("r2")) <= F.col("_w")))
    v1c, v1r = F.col("o_col") - c, F.col("o_row") - r
    v2c, v2r = F.col("c2") - c, F.col("r2") - r
    d2 = v2c * v2c + v2r * v2r
    cos = (v1c * v2c + v1r * v2r) / (hypot2(v1c.cast("double"), v1r.cast("double")) * (F.sqrt(d2.cast("double")) + 1e-9))
    second = j.where(cos < cos_min).groupBy(*AT, "o_col", "o_row").agg(F.min_by(F.struct("c2", "r2"), F.struct(d2, F.col("r2"), F.col("c2"))).alias("s"))
    cells = second.select("map_id", F.explode(line_cells(F.col("o_col"), F.col("o_row"), F.col("s.c2"), F.col("s.r2"))).alias("x"))
    return cells.select("map_id", "x.col", "x.row").distinct()


def door_cells(ridge: DataFrame, labelled: DataFrame, res: float, half: int = 3, low: float = 0.6, high: float = 1.4) -> DataFrame:
    """Narrowest ridge cell between two regions, with its width and kind.

    The two smallest labels of the window name the pair. Ties: lower row, then lower column.
    """
    window = [(a, b) for a in range(-half, half + 1) for b in range(-half, half + 1)]
    probe = ridge.select(*AT, "dist").withColumn("_o", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in window])))
    probe = probe.select("map_id", F.col("col").alias("c0"), F.col("row").alias("r0"), "dist", (F.col("col") + F.col("_o.a")).alias("col"), (F.col("row") + F.col("_o.b")).alias("row"))
    met = probe.join(labelled.select(*AT, "label"), list(AT)).groupBy("map_id", "c0", "r0", "dist").agg(F.array_sort(F.collect_set("label")).alias("ls"))
    two = met.where(F.size("ls") >= 2).select("map_id", F.col("ls")[0].alias("a"), F.col("ls")[1].alias("b"), "c0", "r0", (F.col("dist") * 2.0 * res).alias("width"))
    best = two.groupBy("map_id", "a", "b").agg(F.min_by(F.struct("c0", "r0", "width"), F.struct("width", "r0", "c0")).alias("m"))
    kind = F.when(F.col("m.width").between(low, high), "door").when(F.col("m.width") < low, "narrow").otherwise("opening")
    return best.select("map_id", "a", "b", F.col("m.c0").alias("col"), F.col("m.r0").alias("row"), F.round("m.width", 2).alias("width_m"), kind.alias("kind"))


def narrowest_edges(edges: DataFrame) -> DataFrame:
    """Unordered room pairs with their narrowest opening."""
    e = edges.select("map_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "via", "width_m")
    return e.groupBy("map_id", "a", "b").agg(F.min_by(F.struct("via", "width_m"), F.struct("width_m", "via")).alias("m")).select("map_id", "a", "b", "m.via", "m.width_m")


# ---------------------------------------------------------------- chords


def chord_candidates(notches: DataFrame, mask: DataFrame, res: float, low: float = 0.8, high: float = 4.6) -> DataFrame:
    """Notch pairs ``low``..``high`` metres apart whose midpoint lies in the mask."""
    a = notches.select("map_id", F.col("notch").alias("a"), F.col("col").alias("x"), F.col("row").alias("y"))
    b = notches.select("map_id", F.col("notch").alias("b"), F.col("col").alias("tx"), F.col("row").alias("ty"))
    near = radius_join(a, b, ["map_id"], high / res).where("a < b").withColumn("dist_m", F.col("d") * res)
    near = near.where(F.col("dist_m").between(low, high))
    mid = near.withColumns({"col": F.floor((F.col("x") + F.col("tx")) / 2).cast("int"), "row": F.floor((F.col("y") + F.col("ty")) / 2).cast("int")})
    ok = mid.join(mask.select("map_id", F.col("col").cast("int"), F.col("row").cast("int")), list(AT), "left_semi")
    return ok.select("map_id", "a", "b", F.col("x").alias("ac"), F.col("y").alias("ar"), F.col("tx").alias("bc"), F.col("ty").alias("br"), "dist_m")


def chord_cuts(candidates: DataFrame, mask: DataFrame, res: float, max_zones: int = 5, min_zone_m2: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Accept chords from short to long while a map has fewer than ``max_zones`` parts.

    A chord counts when at least two parts remain and the second largest is big enough. One candidate
    per map is tried in each round, all maps together; the rounds end with the longest list.
    """
    from pyspark.sql import Window as W

    order = W.partitionBy("map_id").orderBy("dist_m", "a", "b")  # candidate lists are short
    cand = settle(candidates.withColumn("k", F.row_number().over(order)))
    last = cand.agg(F.max("k")).first()[0] or 0
    current = settle(mask.select(*AT))
    taken = []
    for k in range(1, last + 1):
        now = component_sizes(components(current, 8)).groupBy("map_id").agg(F.count("*").alias("zones"))
        turn = cand.where(F.col("k") == k).join(now.where(F.col("zones") < max_zones), "map_id", "left_semi")
        turn = settle(turn)
        if turn.isEmpty():
            continue
        drawn = turn.select("map_id", F.explode(line_cells(F.col("ac"), F.col("ar"), F.col("bc"), F.col("br"))).alias("x")).select("map_id", "x.col", "x.row")
        drawn = spread(drawn, [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]).distinct()
        trial = settle(current.join(turn.select("map_id"), "map_id", "left_semi").join(drawn, list(AT), "left_anti"))
        sizes = component_sizes(components(trial, 8)).groupBy("map_id").agg(F.sort_array(F.collect_list("n"), asc=False).alias("s"))
        good = settle(sizes.where((F.size("s") >= 2) & (F.col("s")[1] * res * res >= min_zone_m2)).select("map_id"))
        kept = current.join(good, "map_id", "left_anti").unionByName(trial.join(good, "map_id", "left_semi").select(*AT))
        current = settle(kept)
        taken.append(turn.join(good, "map_id", "left_semi"))
    chords = taken[0] if taken else cand.where("false")
    for t in taken[1:]:
        chords = chords.unionByName(t)
    return current, chords


# ---------------------------------------------------------------- rays and probes


def visible_cells(poses: DataFrame, barrier: DataFrame, box: DataFrame, res: float, reach_m: float = 9.0, rays: int = 1440) -> DataFrame:
    """Cells seen from the poses: along each ray everything before the first barrier cell.

    ``poses`` carry fractional ``pc``, ``pr``. Ray steps meet the barrier by an equi join on the cell;
    the seen part of a ray is generated again from its length, so it is never shuffled twice.
    """
    steps = int(reach_m / res)
    turn = F.col("ray") * (2.0 * math.pi / rays)
    fan = poses.select("map_id", "pose", "pc", "pr", F.explode(F.sequence(F.lit(0), F.lit(rays - 1))).alias("ray"))

    def walk(df: DataFrame, upto: Column) -> DataFrame:
        s = df.withColumn("k", F.explode(F.sequence(F.lit(1), upto)))
        return s.withColumns({"col": F.rint(F.col("pc") + F.cos(turn) * F.col("k")).cast("int"), "row": F.rint(F.col("pr") + F.sin(turn) * F.col("k")).cast("int")})

    wall = barrier.select("map_id", F.col("col").cast("int"), F.col("row").cast("int"), F.lit(True).alias("_w"))
    trod = walk(fan, F.lit(steps)).join(box, "map_id", "left")
    out = trod.where(~inside()).groupBy("map_id", "pose", "ray").agg(F.min("k").alias("k"))
    hit = trod.where(inside()).join(wall, list(AT)).groupBy("map_id", "pose", "ray").agg(F.min("k").alias("k"))
    first = out.unionByName(hit).groupBy("map_id", "pose", "ray").agg(F.min("k").alias("first"))
    seen = fan.join(first, ["map_id", "pose", "ray"], "left").withColumn("_n", F.coalesce(F.col("first") - 1, F.lit(steps))).where("_n >= 1")
    return walk(seen, F.col("_n")).select(*AT).distinct()


def door_behind(doors: DataFrame, cells: DataFrame, keys: Sequence[str], res: float) -> DataFrame:
    """Direction behind a door with most unknown and fewest free probes; an exit needs two unknown.

    ``cells`` has ``kind`` unknown, free or other; a probe without a cell counts as unknown. Twenty-four
    directions with three probes each.
    """
    keys = list(keys)
    probes = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda d: F.transform(F.array(F.lit(0.4), F.lit(0.65), F.lit(0.9)), lambda t: F.struct(d.alias("d"), t.alias("t"))))))
    a = F.col("p.d") * (2.0 * math.pi / 24)
    p = doors.select("map_id", *keys, "col", "row", probes.alias("p")).select(
        "map_id", *keys, "p.d", F.rint(F.col("col") + F.cos(a) * F.col("p.t") / res).cast("int").alias("col"), F.rint(F.col("row") + F.sin(a) * F.col("p.t") / res).cast("int").alias("row")
    )
    c = cells.select("map_id", F.col("col").cast("int"), F.col("row").cast("int"), "kind")
    j = p.join(c, list(AT), "left")
    g = j.groupBy("map_id", *keys, "d").agg(F.count_if(F.coalesce("kind", F.lit("unknown")) == "unknown").alias("n_unknown"), F.count_if(F.col("kind") == "free").alias("n_free"))
    best = g.groupBy("map_id", *keys).agg(F.min_by(F.struct("d", "n_unknown", "n_free"), F.struct(-F.col("n_unknown"), F.col("n_free"), F.col("d"))).alias("b"))
    return best.select(
        "map_id", *keys, F.col("b.d").alias("direction"), F.col("b.n_unknown").alias("n_unknown"), F.col("b.n_free").alias("n_free"),
        ((F.col("b.n_unknown") >= 2) & (F.col("b.n_unknown") > F.col("b.n_free"))).alias("exit_door"),
    )


def mask_distance(points: DataFrame, mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distance of each point (whole ``col, row``) to the nearest mask cell, in cells; none on maps without a mask."""
    if not {dict(points.dtypes)[c] for c in ("col", "row")} <= {"tinyint", "smallint", "int", "bigint"}:
        raise ValueError("points are given by whole cells")
    near = nearest_cells(points.select("map_id", "col", "row").distinct(), mask.select("map_id", "col", "row"))
    return points.select("map_id", *keys, "col", "row").join(near, ["map_id", "col", "row"]).select("map_id", *keys, F.sqrt(F.col("d2").cast("double")).alias("dist"))


def patch_cells(cells: DataFrame, patches: DataFrame) -> DataFrame:
    """Clear a disc, then draw a thick wall, per map (one patch row per map).

    ``patches``: clear_col, clear_row, clear_px, wall ends ac, ar, bc, br and wall_px.
    """
    c, r = F.col("col"), F.col("row")
    p = cells.join(patches, "map_id", "left")
    disc = (c - F.col("clear_col")) * (c - F.col("clear_col")) + (r - F.col("clear_row")) * (r - F.col("clear_row")) <= F.col("clear_px") * F.col("clear_px")
    ex, ey = F.col("bc") - F.col("ac"), F.col("br") - F.col("ar")
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide((c - F.col("ac")) * ex + (r - F.col("ar")) * ey, (ex * ex + ey * ey).cast("double"))))
    t = F.coalesce(t, F.lit(0.0))
    d = hypot2(c - F.col("ac") - t * ex, r - F.col("ar") - t * ey)
    value = F.when(d <= F.col("wall_px") / 2.0, 0).when(disc, 254).otherwise(F.col("value"))
    return p.select(*AT, value.alias("value"))


# ---------------------------------------------------------------- evaluation


def evaluate(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Region overlap metrics from ``(gt, pred)`` per cell (null = not in that labelling).

    Everything follows from one contingency table: recall per truth region, precision per predicted
    region, merged truth pairs, extra significant parts.
    """
    keys = list(keys)
    if not keys:
        return evaluate(pairs.withColumn("_all", F.lit(0)), ["_all"]).drop("_all")
    table = pairs.groupBy(*keys, "gt", "pred").agg(F.count("*").alias("n"))
    gt = table.where("gt is not null").groupBy(*keys, "gt").agg(
        F.sum("n").alias("total"),
        F.max(F.when(F.col("pred").isNotNull(), F.col("n"))).alias("best_n"),
        F.min_by("pred", F.when(F.col("pred").isNotNull(), F.struct(-F.col("n"), F.col("pred")))).alias("owner"),
    )
    significant = table.where("gt is not null and pred is not null").join(gt.select(*keys, "gt", "total"), [*keys, "gt"]).groupBy(*keys, "gt").agg(
        F.count_if(F.col("n") >= F.col("total") * 0.15).alias("sig")
    )
    over = significant.groupBy(*keys).agg(F.sum(F.greatest(F.col("sig") - 1, F.lit(0))).alias("over_count"))
    recall = gt.groupBy(*keys).agg(F.avg(F.coalesce(F.col("best_n"), F.lit(0)) / F.col("total")).alias("recall"))
    owners = gt.where("owner is not null").groupBy(*keys, "owner").agg(F.count("*").alias("k"))
    under = owners.groupBy(*keys).agg(F.sum(F.greatest(F.col("k") - 1, F.lit(0))).alias("under_pairs"))
    pred = table.where("gt is not null and pred is not null").groupBy(*keys, "pred").agg(F.sum("n").alias("total"), F.max("n").alias("best_n"))
    prec = pred.groupBy(*keys).agg(F.avg(F.col("best_n") / F.col("total")).alias("precision"), F.count("*").alias("n_pred"))
    out = recall
    for other in (prec, under, over):
        out = out.join(other, keys, "left")
    return out.fillna(0)
