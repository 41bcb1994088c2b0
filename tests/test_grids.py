"""Cell operators against brute force on small masks."""

import math
import random
from collections import deque

import numpy as np
from pyspark.sql import functions as F

from surveykit.operators.grid import cells as g, regions as rg

CELL = "map_id bigint, col int, row int"


def mask(seed, n=18, p=0.62):
    r = random.Random(seed)
    return {(c, q) for c in range(n) for q in range(n) if r.random() < p}


def frame(spark, cells, m=0):
    return spark.createDataFrame([(m, c, r) for c, r in sorted(cells)], CELL)


def flood(cells, offsets):
    left, out = set(cells), {}
    while left:
        start = min(left, key=lambda p: (p[1], p[0]))
        todo, part = [start], {start}
        while todo:
            c, r = todo.pop()
            for a, b in offsets:
                q = (c + a, r + b)
                if q in left and q not in part:
                    part.add(q)
                    todo.append(q)
        left -= part
        out.update({q: start for q in part})
    return out


def test_components_match_flood(spark):
    for offsets, connect, tile in ((g.FOUR, 4, 256), (g.EIGHT, 8, 256), (g.FOUR, 4, 5), (g.EIGHT, 8, 7)):
        m = {(c - 9, r - 4) for c, r in mask(connect)}
        got = {}
        rows = g.components(frame(spark, m), connect, tile=tile).collect()
        assert {(r.col, r.row): r.label for r in rows} == {p: (s[1] << 32) + s[0] for p, s in flood(m, offsets).items()}
        for r in rows:
            got.setdefault(r.label, set()).add((r.col, r.row))
        want = {}
        for cell, root in flood(m, offsets).items():
            want.setdefault(root, set()).add(cell)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_snake_through_many_tiles_is_one_component(spark):
    m = {(c, r) for r in range(0, 40, 2) for c in range(40)} | {(39 if r % 4 == 1 else 0, r) for r in range(1, 39, 2)}
    assert {r.label for r in g.components(frame(spark, m), 4, tile=8).collect()} == {0}


def test_nearest_cells_and_their_ties(spark):
    r = random.Random(3)
    for n in (1, 3, 12, 60):
        sources = {(r.randrange(-12, 12), r.randrange(-12, 12)) for _ in range(n)}
        targets = {(r.randrange(-30, 30), r.randrange(-30, 30)) for _ in range(80)} | set(list(sources)[:2])
        got = {(x.col, x.row): (x.d2, x.o_row, x.o_col) for x in g.nearest_cells(frame(spark, targets), frame(spark, sources)).collect()}
        assert got == {(c, q): min(((c - a) ** 2 + (q - b) ** 2, b, a) for a, b in sources) for c, q in targets}
    assert g.nearest_cells(frame(spark, {(0, 0)}), frame(spark, {(1, 1)}, m=5)).count() == 0


def test_line_search_picks_the_first_of_equal_sources():
    r = np.random.default_rng(2)
    for n in (1, 2, 9, 200):
        for spread in (3, 40):
            c, cost, t = r.integers(-spread, spread, n), r.integers(0, 9, n) ** 2, r.integers(-60, 60, 50)
            want = ((t[:, None] - c) ** 2 + cost).argmin(axis=1)
            assert (g._nearest_on_line(t, c, cost) == want).all()


def test_distance_and_its_obstacle(spark):
    m = mask(7, p=0.85)
    got = g.distance(frame(spark, m)).collect()
    assert len(got) == len(m)
    away = [(c, r) for c in range(-1, 19) for r in range(-1, 19) if (c, r) not in m]
    for r in got:
        want = min((c - r.col) ** 2 + (q - r.row) ** 2 for c, q in away)
        assert r.d2 == want == (r.o_col - r.col) ** 2 + (r.o_row - r.row) ** 2


def test_wavefront_across_tiles(spark):
    m = mask(8, p=0.75)
    cells = sorted(m)
    seeds = {cells[3]: 7, cells[40]: 2, cells[-5]: 9}
    best = {c: (0, l) for c, l in seeds.items()}
    layer = deque(best)
    while layer:
        nxt = {}
        for c in layer:
            for a, b in g.FOUR:
                q = (c[0] + a, c[1] + b)
                if q in m and q not in best:
                    nxt[q] = min(nxt.get(q, (10**9, 0)), (best[c][0] + 1, best[c][1]))
        best.update(nxt)
        layer = list(nxt)
    s = spark.createDataFrame([(0, *c, l) for c, l in seeds.items()], CELL + ", label bigint")
    got = {(r.col, r.row): (r.steps, r.label) for r in g.wavefront(s, frame(spark, m), tile=5).collect()}
    assert {k: v for k, v in got.items() if v[1] is not None} == best
    assert {k for k, v in got.items() if v[1] is None} == m - set(best)


def test_basins_cover_the_mask(spark):
    m = {(c, r) for c in range(20) for r in range(9) if c not in (9, 10) or r == 4}
    d = g.distance(frame(spark, m))
    seeds = g.components(d.where("dist >= 3").select("map_id", "col", "row"), 4)
    lab = g.basins(d, seeds).collect()
    assert {(r.col, r.row) for r in lab} == m
    assert len({r.label for r in lab}) == 2
    assert {r.label for r in lab if r.col < 8}.isdisjoint({r.label for r in lab if r.col > 11})


def test_fill_nearest_has_no_reach_limit(spark):
    lab = spark.createDataFrame([(0, 0, 0, 1), (0, 100, 0, 2)], CELL + ", label bigint")
    t = spark.createDataFrame([(0, c, 0) for c in range(0, 101, 7)], CELL)
    got = {r.col: r.label for r in g.fill_nearest(t, lab, start=2).collect()}
    assert got == {c: 1 if c < 50 else 2 for c in range(0, 101, 7)}


def test_erosion_ignores_the_image_border(spark):
    m = frame(spark, {(c, r) for c in range(5) for r in range(5)})
    box = g.bounds(m)
    assert g.erode(m, g.element("box", 1), box).count() == 25
    assert g.erode(m, g.element("box", 1)).count() == 9
    assert g.opened(m, g.element("ellipse", 2), box).count() == 25
    assert len(g.element("ellipse", 2)) == 17
    assert g.closed(m, g.element("cross", 1)).count() >= 25


def test_fill_holes_only_fills_enclosed_parts(spark):
    ring = {(c, r) for c in range(7) for r in range(7)} - {(3, 3), (0, 3), (1, 3)}
    got = {(r.col, r.row) for r in g.fill_holes(frame(spark, ring)).collect()}
    assert got == ring | {(3, 3)}


def test_adjacency_does_not_wrap(spark):
    lab = CELL + ", label bigint"
    far = spark.createDataFrame([(0, 0, r, 1) for r in range(3)] + [(0, 4, r, 2) for r in range(3)], lab)
    assert rg.adjacency(far).count() == 0
    near = spark.createDataFrame([(0, 0, 1, 1), (0, 1, 1, 2)], lab)
    assert {(r.label, r.neighbour, r.shared) for r in rg.adjacency(near).collect()} == {(1, 2, 1), (2, 1, 1)}


def test_small_rooms_join_their_longest_border(spark):
    rows = [(0, c, r, 1) for c in range(10) for r in range(10)] + [(0, 10, r, 2) for r in range(10)] + [(0, c, r, 3) for c in range(11, 30) for r in range(10)]
    lab = spark.createDataFrame(rows, CELL + ", label bigint")
    free = lab.select("map_id", "col", "row")
    box = free.groupBy("map_id").agg(F.lit(-1).alias("c0"), F.lit(30).alias("c1"), F.lit(-1).alias("r0"), F.lit(10).alias("r1"))
    out = rg.merge_regions(lab, free, box, 0.4, min_room=2.0, single=3.0)
    assert {r.label: r.n for r in g.component_sizes(out).collect()} == {1: 110, 3: 190}
    five = rg.merge_regions(lab, free, box, 0.4, "five", min_room=2.0, single=3.0)
    assert sum(r.n for r in g.component_sizes(five).collect()) == 300


def test_critical_cut_line_is_side_connected(spark):
    df = spark.range(1).select(F.explode(rg.line_cells(F.lit(2), F.lit(3), F.lit(-4), F.lit(7))).alias("p")).select("p.col", "p.row")
    pts = [(r.col, r.row) for r in df.collect()]
    assert pts[0] == (2, 3) and pts[-1] == (-4, 7)
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(pts, pts[1:]))


def test_two_rooms_and_a_door(spark):
    """Two rooms with one narrow passage: two labels and one door between them."""
    free = {(c, r) for c in range(40) for r in range(30)} | {(c, r) for c in range(44, 84) for r in range(30)} | {(c, r) for c in range(40, 44) for r in range(10, 20)}
    f = frame(spark, free)
    d = g.settle(g.distance(f))
    seeds = g.components(d.where("dist >= 8").select("map_id", "col", "row"), 4)
    lab = g.settle(g.basins(d, seeds))
    assert lab.select("label").distinct().count() == 2
    ridge = rg.ridge_prune(rg.ridge_cells(d), 4)
    doors = rg.door_cells(ridge, lab, 0.1).collect()
    assert len(doors) == 1 and doors[0].kind == "door" and abs(doors[0].width_m - 1.1) < 0.25


def test_chord_needs_a_second_part_of_some_size(spark):
    m = frame(spark, {(c, r) for c in range(60) for r in range(20)})
    cut = {}
    for col in (20, 58):
        notch = spark.createDataFrame([(0, 1, col, 0), (0, 2, col, 19)], "map_id bigint, notch bigint, col int, row int")
        left, chords = rg.chord_cuts(rg.chord_candidates(notch, m, 0.1), m, 0.1, min_zone_m2=1.0)
        cut[col] = (chords.count(), g.component_sizes(g.components(left, 8)).count())
    assert cut == {20: (1, 2), 58: (0, 1)}


def test_rays_stop_at_walls(spark):
    wall = spark.createDataFrame([(0, 10, r) for r in range(0, 21)], CELL)
    box = wall.groupBy("map_id").agg(F.lit(0).alias("c0"), F.lit(20).alias("c1"), F.lit(0).alias("r0"), F.lit(20).alias("r1"))
    pose = spark.createDataFrame([(0, 1, 5.0, 10.0)], "map_id bigint, pose bigint, pc double, pr double")
    seen = rg.visible_cells(pose, wall, box, 0.1, reach_m=3.0, rays=360).collect()
    assert seen and all(r.col < 10 for r in seen)


def test_grid_images_round_trip(spark):
    from surveykit.sources.images import strip_images
    from surveykit.sources.tables import image_cells

    r = random.Random(1)
    rows = [(m, c, q, r.randrange(256)) for m in (1, 2) for c in range(-3, 9) for q in range(5, 20)]
    df = spark.createDataFrame(rows, CELL + ", value int")
    img = strip_images(df, height=4)
    back = image_cells(img.select("image", "content"), img.drop("content")).collect()
    assert sorted((x.map_id, x.col, x.row, x.value) for x in back) == sorted(rows)


def test_evaluation_counts(spark):
    pairs = [(1, 5)] * 6 + [(1, 6)] * 4 + [(2, 6)] * 8 + [(2, None)] * 2 + [(None, 5)] * 3
    row = rg.evaluate(spark.createDataFrame(pairs, "gt int, pred int")).first()
    assert math.isclose(row.recall, (0.6 + 0.8) / 2) and math.isclose(row.precision, (1.0 + 8 / 12) / 2)
    assert (row.n_pred, row.under_pairs, row.over_count) == (2, 0, 1)
