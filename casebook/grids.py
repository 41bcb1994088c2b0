"""Cell-table operators on grids built from embedding pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook import case
from casebook.motion import r
from casebook.views import CELLS, cells, table
from surveykit.operators.grid import cells as g, regions as rg

FREE = CELLS + ", free AS (SELECT map_id, col, \"row\" FROM cells WHERE value = 0), box AS (SELECT map_id, min(col) AS c0, max(col) AS c1, min(\"row\") AS r0, max(\"row\") AS r1 FROM cells GROUP BY ALL)"
OFF8 = "(SELECT a, b FROM (SELECT unnest(range(-1, 2)) AS a), (SELECT unnest(range(-1, 2)) AS b) WHERE NOT (a = 0 AND b = 0)) o"
OFF9 = "(SELECT a, b FROM (SELECT unnest(range(-1, 2)) AS a), (SELECT unnest(range(-1, 2)) AS b)) o"
OFF4 = "(VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(a, b)"
BLOCK = 'labelled AS (SELECT map_id, col, "row", CAST(floor(col / 10) * 100 + floor("row" / 10) AS BIGINT) AS label FROM free)'


def free(spark, sf):
    return cells(spark, sf).where("value = 0").select("map_id", "col", "row")


def box(spark, sf):
    return g.bounds(cells(spark, sf))


def blocks(spark, sf):
    return free(spark, sf).withColumn("label", (F.floor(F.col("col") / 10) * 100 + F.floor(F.col("row") / 10)).cast("bigint"))


@case("src_cells", f"WITH {CELLS} SELECT map_id, col, \"row\", value FROM cells")
def src_cells(spark, sf):
    """Grids packed as grey image strips and unpacked again by the image reader."""
    from surveykit.sources.images import strip_images
    from surveykit.sources.tables import image_cells

    img = strip_images(cells(spark, sf), background=205, height=32)
    return image_cells(img.select("image", "content"), img.drop("content")).where("value <> 205")


@case("cell_class", f"""WITH {CELLS}, v AS (SELECT *, value * 2.54 AS x FROM cells) SELECT map_id, col, "row", CASE WHEN x <= 50 THEN 'occ' WHEN x >= 250 THEN 'free' ELSE 'unknown' END AS segment,
  CASE WHEN value >= 50 THEN 'occ' WHEN value >= 0 THEN 'free' ELSE 'unknown' END AS live FROM v""")
def cell_class(spark, sf):
    return cells(spark, sf).select("map_id", "col", "row", g.cell_class(F.col("value") * 2.54, "segment").alias("segment"), g.cell_class(F.col("value"), "live").alias("live"))


@case("cell_crop", f"""WITH {FREE}, b AS (SELECT map_id, min(col) - 2 AS x0, max(col) + 2 AS x1, min("row") - 2 AS y0, max("row") + 2 AS y1 FROM free GROUP BY ALL)
  SELECT map_id, col, "row", value FROM cells JOIN b USING (map_id) WHERE col BETWEEN x0 AND x1 AND "row" BETWEEN y0 AND y1""")
def cell_crop(spark, sf):
    return g.crop(cells(spark, sf), F.col("value") == 0, 2)


DILATE = f"""d AS (SELECT DISTINCT f.map_id, f.col + o.a AS col, f."row" + o.b AS "row" FROM free f, {OFF9} JOIN box USING (map_id) WHERE f.col + o.a BETWEEN c0 AND c1 AND f."row" + o.b BETWEEN r0 AND r1)"""


@case("cell_morph", f"""WITH {FREE}, d AS (SELECT DISTINCT map_id, col, "row" FROM (SELECT f.map_id, f.col + o.a AS col, f."row" + o.b AS "row" FROM free f, {OFF9}) JOIN box USING (map_id) WHERE col BETWEEN c0 AND c1 AND "row" BETWEEN r0 AND r1),
  e AS (SELECT f.map_id, f.col, f."row" FROM free f JOIN box USING (map_id), {OFF9} LEFT JOIN free n ON n.map_id = f.map_id AND n.col = f.col + o.a AND n."row" = f."row" + o.b
    GROUP BY ALL HAVING count(*) FILTER (n.map_id IS NULL AND f.col + o.a BETWEEN c0 AND c1 AND f."row" + o.b BETWEEN r0 AND r1) = 0),
  oo AS (SELECT DISTINCT e.map_id, e.col + o.a AS col, e."row" + o.b AS "row" FROM e, {OFF9})
  SELECT 'dilate' AS op, map_id, count(*) AS n, sum(col * 1000 + "row")::BIGINT AS chk FROM d GROUP BY ALL UNION ALL SELECT 'erode', map_id, count(*), sum(col * 1000 + "row")::BIGINT FROM e GROUP BY ALL
  UNION ALL SELECT 'open', map_id, count(*), sum(col * 1000 + "row")::BIGINT FROM oo GROUP BY ALL""")
def cell_morph(spark, sf):
    f, b, el = free(spark, sf), box(spark, sf), g.element("box", 1)
    out = None
    for name, df in (("dilate", g.dilate(f, el, b)), ("erode", g.erode(f, el, b)), ("open", g.opened(f, el, b))):
        one = df.groupBy("map_id").agg(F.count("*").alias("n"), F.sum(F.col("col") * 1000 + F.col("row")).cast("bigint").alias("chk")).withColumn("op", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@case("cell_density", f"""WITH {FREE} SELECT c.map_id, c.col, c."row", round(count(f.map_id) / ((least(c1, c.col + 12) - greatest(c0, c.col - 12) + 1) * (least(r1, c."row" + 12) - greatest(r0, c."row" - 12) + 1))::DOUBLE, 6) AS density
  FROM cells c JOIN box USING (map_id) LEFT JOIN free f ON f.map_id = c.map_id AND abs(f.col - c.col) <= 12 AND abs(f."row" - c."row") <= 12 GROUP BY c.map_id, c.col, c."row", c0, c1, r0, r1""")
def cell_density(spark, sf):
    return g.density(free(spark, sf), cells(spark, sf)).withColumn("density", r("density"))


def _flood_sql(offsets: str, src: str = "free") -> str:
    return f"""reach(map_id, col, "row", s) AS (SELECT map_id, col, "row", ("row"::BIGINT << 32) + col FROM {src}
    UNION SELECT f.map_id, f.col, f."row", r.s FROM reach r, {offsets} JOIN {src} f ON f.map_id = r.map_id AND f.col = r.col + o.a AND f."row" = r."row" + o.b)"""


# labels travel as shrinking minima; a round hands on only the cells whose label fell, until none does
def components_sql(offsets: str, src: str = "free", name: str = "comp") -> str:
    return f"""{name}_it(map_id, col, "row", s) USING KEY (map_id, col, "row") AS (SELECT map_id, col, "row", ("row"::BIGINT << 32) + col FROM {src}
    UNION SELECT f.map_id, f.col, f."row", min(r.s) FROM {name}_it r, {offsets} JOIN {src} f ON f.map_id = r.map_id AND f.col = r.col + o.a AND f."row" = r."row" + o.b
      JOIN recurring.{name}_it c ON c.map_id = f.map_id AND c.col = f.col AND c."row" = f."row" WHERE r.s < c.s GROUP BY ALL),
  {name} AS (SELECT map_id, col, "row", s AS label FROM {name}_it)"""


@case("cell_components", f"WITH RECURSIVE {FREE}, {components_sql(OFF8)} SELECT * FROM comp")
def cell_components(spark, sf):
    return g.components(free(spark, sf), 8)


@case("cell_keep_area", f"WITH RECURSIVE {FREE}, {components_sql(OFF8)} SELECT map_id, col, \"row\", label FROM comp QUALIFY count(*) OVER (PARTITION BY map_id, label) >= 5")
def cell_keep_area(spark, sf):
    return g.keep_area(g.components(free(spark, sf), 8), 5)


@case("cell_keep_largest", f"""WITH RECURSIVE {FREE}, {components_sql(OFF4)}, n AS (SELECT map_id, label, count(*) AS n FROM comp GROUP BY ALL),
  b AS (SELECT map_id, label FROM n QUALIFY row_number() OVER (PARTITION BY map_id ORDER BY n DESC, label) = 1) SELECT map_id, label, col, "row" FROM comp JOIN b USING (map_id, label)""")
def cell_keep_largest(spark, sf):
    return g.keep_largest(g.components(free(spark, sf), 4))


@case("cell_fill_holes", f"""WITH RECURSIVE {FREE}, fb AS (SELECT map_id, min(col) AS x0, max(col) AS x1, min("row") AS y0, max("row") AS y1 FROM free GROUP BY ALL),
  bg AS (SELECT map_id, col, "row" FROM (SELECT map_id, unnest(range(x0, x1 + 1)) AS col, y0, y1 FROM fb), LATERAL (SELECT unnest(range(y0, y1 + 1)) AS "row") EXCEPT SELECT map_id, col, "row" FROM free),
  {components_sql(OFF4, 'bg')}, outer_ AS (SELECT DISTINCT map_id, label FROM comp JOIN fb USING (map_id) WHERE col IN (x0, x1) OR "row" IN (y0, y1))
  SELECT map_id, col, "row" FROM free UNION ALL SELECT map_id, col, "row" FROM comp WHERE (map_id, label) NOT IN (SELECT map_id, label FROM outer_)""")
def cell_fill_holes(spark, sf):
    return g.fill_holes(free(spark, sf))


DIST = f"""rim AS (SELECT DISTINCT f.map_id, f.col + o.a AS col, f."row" + o.b AS "row" FROM free f, {OFF8} EXCEPT SELECT map_id, col, "row" FROM free),
  dist AS (SELECT f.map_id, f.col, f."row", min((f.col - m.col) * (f.col - m.col) + (f."row" - m."row") * (f."row" - m."row")) AS d2,
    arg_min(m.col, struct_pack(d := (f.col - m.col) * (f.col - m.col) + (f."row" - m."row") * (f."row" - m."row"), r := m."row", c := m.col)) AS o_col,
    arg_min(m."row", struct_pack(d := (f.col - m.col) * (f.col - m.col) + (f."row" - m."row") * (f."row" - m."row"), r := m."row", c := m.col)) AS o_row
    FROM free f JOIN rim m USING (map_id) GROUP BY ALL)"""


@case("cell_distance", f"WITH {FREE}, {DIST} SELECT map_id, col, \"row\", d2::BIGINT AS d2, o_col, o_row FROM dist")
def cell_distance(spark, sf):
    return g.distance(free(spark, sf)).select("map_id", "col", "row", "d2", "o_col", "o_row")


@case("cell_seed_scan", f"""WITH RECURSIVE {FREE}, {DIST}, thr AS (SELECT map_id * 10 + k AS map_id, col, "row" FROM dist, (VALUES (0, 1.0), (1, 1.5), (2, 2.0), (3, 2.5), (4, 3.0)) t(k, v) WHERE sqrt(d2::DOUBLE) >= v),
  {components_sql(OFF4, 'thr')}, n AS (SELECT map_id, count(DISTINCT label) AS n FROM comp GROUP BY ALL)
  SELECT CAST(map_id // 10 AS BIGINT) AS map_id, 1.0::DOUBLE + (map_id % 10) * 0.5::DOUBLE AS threshold, n AS components FROM n QUALIFY row_number() OVER (PARTITION BY map_id // 10 ORDER BY n DESC, map_id DESC) = 1""")
def cell_seed_scan(spark, sf):
    return g.seed_scan(g.distance(free(spark, sf)), [1.0, 1.5, 2.0, 2.5, 3.0])


def seeds(spark, sf):
    return free(spark, sf).where("(col * 7 + row * 13) % 97 = 0").withColumn("label", F.col("row").cast("bigint") * 1000 + F.col("col"))


@case("cell_wavefront", f"""WITH RECURSIVE {FREE}, seed AS (SELECT *, "row"::BIGINT * 1000 + col AS label FROM free WHERE (col * 7 + "row" * 13) % 97 = 0),
  w(map_id, col, "row", label, k) USING KEY (map_id, col, "row") AS (SELECT map_id, col, "row", label, 0 FROM seed
    UNION SELECT f.map_id, f.col, f."row", min(w.label), any_value(w.k) + 1 FROM w, {OFF4} JOIN free f ON f.map_id = w.map_id AND f.col = w.col + o.a AND f."row" = w."row" + o.b
      LEFT JOIN recurring.w c ON c.map_id = f.map_id AND c.col = f.col AND c."row" = f."row" WHERE c.map_id IS NULL GROUP BY ALL)
  SELECT f.map_id, f.col, f."row", k::BIGINT AS steps, label FROM free f LEFT JOIN w USING (map_id, col, "row")""")
def cell_wavefront(spark, sf):
    return g.wavefront(seeds(spark, sf), free(spark, sf), tile=32).select("map_id", "col", "row", "steps", "label")


@case("cell_basins")
def cell_basins(spark, sf):
    d = g.distance(free(spark, sf)).select("map_id", "col", "row", "dist")
    s = g.components(d.where("dist >= 2"), 4)
    return g.basins(d, s)


@case("cell_fill_nearest", f"""WITH {FREE}, lab AS (SELECT *, "row"::BIGINT * 1000 + col AS label FROM free WHERE (col * 7 + "row" * 13) % 97 = 0)
  SELECT f.map_id, f.col, f."row", arg_min(l.label, struct_pack(d := (f.col - l.col) * (f.col - l.col) + (f."row" - l."row") * (f."row" - l."row"), r := l."row", c := l.col)) AS label
  FROM free f JOIN lab l USING (map_id) GROUP BY ALL""")
def cell_fill_nearest(spark, sf):
    return g.fill_nearest(free(spark, sf), seeds(spark, sf))


ADJ = f"adj AS (SELECT a.map_id, a.label, b.label AS neighbour, count(*) AS shared FROM labelled a, {OFF4} JOIN labelled b ON b.map_id = a.map_id AND b.col = a.col + o.a AND b.\"row\" = a.\"row\" + o.b WHERE a.label <> b.label GROUP BY ALL)"


@case("region_adjacency", f"WITH {FREE}, {BLOCK}, {ADJ} SELECT * FROM adj")
def region_adjacency(spark, sf):
    return rg.adjacency(blocks(spark, sf))


@case("region_border", f"""WITH {FREE}, {BLOCK}, {ADJ}, w AS (SELECT a.map_id, a.label, count(*) FILTER (f.map_id IS NULL AND a.col + o.a BETWEEN c0 AND c1 AND a."row" + o.b BETWEEN r0 AND r1) AS wall
    FROM labelled a JOIN box USING (map_id), {OFF4} LEFT JOIN free f ON f.map_id = a.map_id AND f.col = a.col + o.a AND f."row" = a."row" + o.b GROUP BY ALL),
  c AS (SELECT map_id, label, sum(shared)::BIGINT AS contact FROM adj GROUP BY ALL)
  SELECT map_id, label, wall, coalesce(contact, 0) AS contact, wall + coalesce(contact, 0) AS total FROM w LEFT JOIN c USING (map_id, label)""")
def region_border(spark, sf):
    return rg.borders(blocks(spark, sf), free(spark, sf), box(spark, sf))


@case("zone_boundary", f"WITH {FREE}, {BLOCK} SELECT DISTINCT a.map_id, a.col, a.\"row\", a.label FROM labelled a, {OFF4} JOIN labelled b ON b.map_id = a.map_id AND b.col = a.col + o.a AND b.\"row\" = a.\"row\" + o.b WHERE a.label <> b.label")
def zone_boundary(spark, sf):
    return rg.boundary_cells(blocks(spark, sf))


@case("agg_region", f"WITH {FREE}, {BLOCK} SELECT map_id, label, count(*) AS n_cells, round(count(*) * 0.05 * 0.05, 6)::DOUBLE AS area_m2, round(avg(col), 6) AS cx, round(avg(\"row\"), 6) AS cy, min(col) AS c0, max(col) AS c1, min(\"row\") AS r0, max(\"row\") AS r1 FROM labelled GROUP BY ALL")
def agg_region(spark, sf):
    return rg.region_stats(blocks(spark, sf), 0.05).withColumns({"area_m2": r("area_m2"), "cx": r("cx"), "cy": r("cy")})


@case("agg_unknown_ring", f"""WITH {FREE}, {BLOCK}, ring AS (SELECT DISTINCT a.map_id, a.label, a.col + o.a AS col, a."row" + o.b AS "row" FROM labelled a, {OFF8}
    WHERE NOT EXISTS (SELECT 1 FROM labelled s WHERE s.map_id = a.map_id AND s.label = a.label AND s.col = a.col + o.a AND s."row" = a."row" + o.b)),
  u AS (SELECT map_id, label, count(*) AS ring, count(*) FILTER (NOT EXISTS (SELECT 1 FROM cells c WHERE c.map_id = ring.map_id AND c.col = ring.col AND c."row" = ring."row" AND c.value = 0)) AS unknown FROM ring GROUP BY ALL)
  SELECT map_id, label, ring, unknown, round(unknown / ring::DOUBLE, 6) AS unknown_ratio, CASE WHEN unknown / ring::DOUBLE > 0.5 THEN 'phantom' ELSE 'room' END AS status FROM u""")
def agg_unknown_ring(spark, sf):
    f = free(spark, sf)
    shadow = g.dilate(f, g.EIGHT).join(f, ["map_id", "col", "row"], "left_anti")
    return rg.unknown_ring(blocks(spark, sf), shadow).withColumn("unknown_ratio", r("unknown_ratio"))


@case("region_merge_small")
def region_merge_small(spark, sf):
    return rg.merge_regions(blocks(spark, sf), free(spark, sf), box(spark, sf), 0.2)


@case("region_merge_5rules")
def region_merge_5rules(spark, sf):
    return rg.merge_regions(blocks(spark, sf), free(spark, sf), box(spark, sf), 0.2, rules="five")


RIDGE = f"""pr AS (SELECT a.map_id, a.col, a."row", a.d2 AS da, b.col AS nc, b."row" AS nr, b.d2 AS db FROM dist a, (VALUES (1, 0), (0, 1)) o(a, b)
    JOIN dist b ON b.map_id = a.map_id AND b.col = a.col + o.a AND b."row" = a."row" + o.b
    WHERE sqrt(((a.o_col - b.o_col) * (a.o_col - b.o_col) + (a.o_row - b.o_row) * (a.o_row - b.o_row))::DOUBLE) > greatest(3.0::DOUBLE, sqrt(a.d2::DOUBLE))),
  ridge AS (SELECT DISTINCT map_id, CASE WHEN da >= db THEN col ELSE nc END AS col, CASE WHEN da >= db THEN "row" ELSE nr END AS "row" FROM pr)"""


def ridge(spark, sf):
    return rg.ridge_cells(g.distance(free(spark, sf)))


@case("ridge_cells", f"WITH {FREE}, {DIST}, {RIDGE} SELECT map_id, col, \"row\" FROM ridge")
def ridge_cells(spark, sf):
    return ridge(spark, sf).select("map_id", "col", "row")


@case("ridge_prune")
def ridge_prune(spark, sf):
    return rg.ridge_prune(ridge(spark, sf), 3).select("map_id", "col", "row")


CRITICAL = f"""{RIDGE}, rd AS (SELECT map_id, col, "row", sqrt(d2::DOUBLE) AS d FROM ridge JOIN dist USING (map_id, col, "row")),
  m AS (SELECT a.map_id, a.col, a."row", a.d, min(b.d) AS lo, max(b.d) AS hi FROM rd a JOIN rd b ON a.map_id = b.map_id AND abs(a.col - b.col) <= 7 AND abs(a."row" - b."row") <= 7 GROUP BY ALL),
  critical AS (SELECT map_id, col, "row" FROM m WHERE d <= lo + 1e-6 AND d < hi - 1e-6 AND d <= 20)"""


@case("critical_points", f"WITH {FREE}, {DIST}, {CRITICAL} SELECT map_id, col, \"row\" FROM critical")
def critical_points(spark, sf):
    return rg.critical_points(ridge(spark, sf), 7, 20.0).select("map_id", "col", "row")


@case("critical_cut", f"""WITH {FREE}, {DIST}, {CRITICAL}, p AS (SELECT c.map_id, c.col, c."row", o_col, o_row, CAST(floor(sqrt(d2::DOUBLE)) AS INTEGER) + 4 AS w FROM critical c JOIN dist USING (map_id, col, "row") WHERE o_col <> c.col OR o_row <> c."row"),
  j AS (SELECT p.*, m.col AS c2, m."row" AS r2, o_col - p.col AS ac, o_row - p."row" AS ar, m.col - p.col AS bc, m."row" - p."row" AS br FROM p JOIN rim m ON m.map_id = p.map_id AND abs(m.col - p.col) <= w AND abs(m."row" - p."row") <= w),
  k AS (SELECT * FROM j WHERE (ac * bc + ar * br) / (sqrt((ac * ac + ar * ar)::DOUBLE) * (sqrt((bc * bc + br * br)::DOUBLE) + 1e-9::DOUBLE)) < cos(radians(60.0::DOUBLE))),
  s AS (SELECT map_id, o_col, o_row, c2, r2, abs(c2 - o_col) AS dc, abs(r2 - o_row) AS dr FROM k QUALIFY row_number() OVER (PARTITION BY map_id, col, "row" ORDER BY bc * bc + br * br, r2, c2) = 1),
  l AS (SELECT *, CASE WHEN dc + dr = 0 THEN 0 ELSE (i * dc * 2 + dc + dr) // ((dc + dr) * 2) END AS c FROM (SELECT *, unnest(range(0, dc + dr + 1)) AS i FROM s))
  SELECT DISTINCT map_id, CAST(o_col + sign(c2 - o_col) * c AS INTEGER) AS col, CAST(o_row + sign(r2 - o_row) * (i - c) AS INTEGER) AS "row" FROM l""")
def critical_cut(spark, sf):
    f = free(spark, sf)
    rim = g.dilate(f, g.EIGHT).join(f, ["map_id", "col", "row"], "left_anti")
    return rg.critical_cuts(rg.critical_points(ridge(spark, sf), 7, 20.0), rim)


@case("door_cells", f"""WITH {FREE}, {DIST}, {RIDGE}, {BLOCK}, p AS (SELECT r.map_id, r.col, r."row", d2, list_sort(list(DISTINCT l.label)) AS ls FROM ridge r JOIN dist USING (map_id, col, "row")
    JOIN labelled l ON l.map_id = r.map_id AND abs(l.col - r.col) <= 3 AND abs(l."row" - r."row") <= 3 GROUP BY ALL),
  q AS (SELECT map_id, ls[1] AS a, ls[2] AS b, col, "row", 2.0::DOUBLE * sqrt(d2::DOUBLE) * 0.05::DOUBLE AS w FROM p WHERE len(ls) >= 2)
  SELECT map_id, a, b, col, "row", round(w, 2) AS width_m, CASE WHEN w BETWEEN 0.6 AND 1.4 THEN 'door' WHEN w < 0.6 THEN 'narrow' ELSE 'opening' END AS kind FROM q
  QUALIFY row_number() OVER (PARTITION BY map_id, a, b ORDER BY w, "row", col) = 1""")
def door_cells(spark, sf):
    return rg.door_cells(ridge(spark, sf), blocks(spark, sf), 0.05)


@case("sort_edges", """SELECT s_nationkey % 5 AS map_id, least(s_suppkey % 7, s_nationkey % 11) AS a, greatest(s_suppkey % 7, s_nationkey % 11) AS b, min(s_acctbal) AS width_m FROM supplier GROUP BY ALL""")
def sort_edges(spark, sf):
    e = table(spark, sf, "supplier").select((F.col("s_nationkey") % 5).alias("map_id"), (F.col("s_suppkey") % 7).alias("a"), (F.col("s_nationkey") % 11).cast("bigint").alias("b"), F.lit("door").alias("via"), F.col("s_acctbal").alias("width_m"))
    return rg.narrowest_edges(e).select("map_id", "a", "b", "width_m")


@case("label_anchor", f"""WITH {FREE}, {DIST}, {BLOCK} SELECT map_id, label, col, "row", round(sqrt(d2::DOUBLE), 6) AS dist FROM labelled JOIN dist USING (map_id, col, "row")
  QUALIFY row_number() OVER (PARTITION BY map_id, label ORDER BY d2 DESC, "row", col) = 1""")
def label_anchor(spark, sf):
    return rg.label_anchor(blocks(spark, sf), g.distance(free(spark, sf))).withColumn("dist", r("dist"))


NOTCH = "notch AS (SELECT map_id, col, \"row\", \"row\"::BIGINT * 1000 + col AS notch FROM cells WHERE (col * 3 + \"row\" * 5) % 23 = 0)"


@case("chord_candidates", f"""WITH {FREE}, {NOTCH}, p AS (SELECT a.map_id, a.notch AS a, b.notch AS b, sqrt(((a.col - b.col) * (a.col - b.col) + (a."row" - b."row") * (a."row" - b."row"))::DOUBLE) * 0.2::DOUBLE AS d,
    CAST(floor((a.col + b.col) / 2) AS INTEGER) AS col, CAST(floor((a."row" + b."row") / 2) AS INTEGER) AS "row" FROM notch a JOIN notch b ON a.map_id = b.map_id AND a.notch < b.notch)
  SELECT map_id, a, b, round(d, 6) AS dist_m FROM p JOIN free USING (map_id, col, "row") WHERE d BETWEEN 0.8 AND 4.6""")
def chord_candidates(spark, sf):
    n = cells(spark, sf).where("(col * 3 + row * 5) % 23 = 0").withColumn("notch", F.col("row").cast("bigint") * 1000 + F.col("col"))
    return rg.chord_candidates(n, free(spark, sf), 0.2).select("map_id", "a", "b", r("dist_m").alias("dist_m"))


POSE = "pose AS (SELECT map_id, \"row\"::BIGINT * 1000 + col AS pose, col + 0.25 AS pc, \"row\" + 0.25 AS pr FROM free WHERE (col * 7 + \"row\" * 13) % 97 = 0)"


@case("visibility_rays", f"""WITH {FREE}, {POSE}, ray AS (SELECT map_id, pose, ray, k, CAST(round_even(pc + cos(ray * (2.0 * pi() / 48)) * k, 0) AS INTEGER) AS col, CAST(round_even(pr + sin(ray * (2.0 * pi() / 48)) * k, 0) AS INTEGER) AS "row"
    FROM pose, (SELECT unnest(range(0, 48)) AS ray), (SELECT unnest(range(1, 21)) AS k)),
  h AS (SELECT map_id, pose, ray, min(k) FILTER (c.value = 100 OR NOT (ray.col BETWEEN c0 AND c1 AND ray."row" BETWEEN r0 AND r1)) AS f FROM ray JOIN box USING (map_id) LEFT JOIN cells c USING (map_id, col, "row") GROUP BY ALL)
  SELECT DISTINCT map_id, col, "row" FROM ray JOIN h USING (map_id, pose, ray) WHERE f IS NULL OR k < f""")
def visibility_rays(spark, sf):
    p = seeds(spark, sf).select("map_id", F.col("label").alias("pose"), (F.col("col") + 0.25).alias("pc"), (F.col("row") + 0.25).alias("pr"))
    return rg.visible_cells(p, cells(spark, sf).where("value = 100"), box(spark, sf), 0.05, reach_m=1.0, rays=48)


@case("door_behind", f"""WITH {FREE}, {POSE}, pb AS (SELECT map_id, pose, d, CAST(round_even(floor(pc) + cos(d * (2.0 * pi() / 24)) * t / 0.1, 0) AS INTEGER) AS col, CAST(round_even(floor(pr) + sin(d * (2.0 * pi() / 24)) * t / 0.1, 0) AS INTEGER) AS "row"
    FROM pose, (SELECT unnest(range(0, 24)) AS d), (VALUES (0.4::DOUBLE), (0.65::DOUBLE), (0.9::DOUBLE)) t(t)),
  n AS (SELECT map_id, pose, d, count(*) FILTER (c.value IS NULL) AS u, count(*) FILTER (c.value = 0) AS f FROM pb LEFT JOIN cells c USING (map_id, col, "row") GROUP BY ALL)
  SELECT map_id, pose, d::INTEGER AS direction, u AS n_unknown, f AS n_free, u >= 2 AND u > f AS exit_door FROM n QUALIFY row_number() OVER (PARTITION BY map_id, pose ORDER BY u DESC, f, d) = 1""")
def door_behind(spark, sf):
    d = seeds(spark, sf).withColumnRenamed("label", "pose")
    c = cells(spark, sf).withColumn("kind", F.when(F.col("value") == 0, "free").otherwise("other"))
    return rg.door_behind(d, c, ["pose"], 0.1)


@case("mask_distance_poi", f"""WITH {FREE}, poi AS (SELECT map_id, col, "row", "row"::BIGINT * 1000 + col AS poi FROM cells WHERE value = 100)
  SELECT p.map_id, p.poi, round(min(sqrt(((p.col - f.col) * (p.col - f.col) + (p."row" - f."row") * (p."row" - f."row"))::DOUBLE)), 6) AS dist FROM poi p JOIN free f USING (map_id) GROUP BY ALL""")
def mask_distance_poi(spark, sf):
    p = cells(spark, sf).where("value = 100").withColumn("poi", F.col("row").cast("bigint") * 1000 + F.col("col"))
    return rg.mask_distance(p, free(spark, sf), ["poi"]).withColumn("dist", r("dist"))


@case("cell_patch", f"""WITH {CELLS}, s AS (SELECT *, least(1.0, greatest(0.0, ((col - 50) * 30 + ("row" - 70) * 10) / 1000.0::DOUBLE)) AS t FROM cells)
  SELECT map_id, col, "row", CASE WHEN sqrt((col - 50 - t * 30) * (col - 50 - t * 30) + ("row" - 70 - t * 10) * ("row" - 70 - t * 10)) <= 1.5 THEN 0
    WHEN (col - 64) * (col - 64) + ("row" - 64) * ("row" - 64) <= 49 THEN 254 ELSE value END AS value FROM s""")
def cell_patch(spark, sf):
    c = cells(spark, sf)
    lit = {"clear_col": 64, "clear_row": 64, "clear_px": 7, "ac": 50, "ar": 70, "bc": 80, "br": 80, "wall_px": 3}
    return rg.patch_cells(c, c.select("map_id").distinct().withColumns({k: F.lit(v) for k, v in lit.items()}))


@case("agg_seg_eval", """WITH p AS (SELECT quality AS gt, CAST(substr(source, 4) AS INTEGER) % 4 AS pred FROM documents LEFT JOIN labels USING (doc_id)), t AS (SELECT gt, pred, count(*) AS n FROM p GROUP BY ALL),
  g AS (SELECT gt, sum(n) AS total, max(n) AS best, arg_min(pred, struct_pack(a := -n, b := pred)) AS own FROM t WHERE gt IS NOT NULL GROUP BY ALL),
  s AS (SELECT gt, count(*) FILTER (n >= 0.15 * total) AS sig FROM t JOIN g USING (gt) GROUP BY ALL),
  q AS (SELECT pred, sum(n) AS total, max(n) AS best FROM t WHERE gt IS NOT NULL GROUP BY ALL)
  SELECT (SELECT round(avg(best / total::DOUBLE), 6) FROM g) AS recall, (SELECT round(avg(best / total::DOUBLE), 6) FROM q) AS "precision", (SELECT count(*) FROM q) AS n_pred,
  (SELECT sum(k - 1)::BIGINT FROM (SELECT own, count(*) AS k FROM g GROUP BY ALL)) AS under_pairs, (SELECT sum(greatest(sig - 1, 0))::BIGINT FROM s) AS over_count""")
def agg_seg_eval(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    p = d.select(F.col("quality").alias("gt"), (F.substring("source", 4, 9).cast("int") % 4).alias("pred"))
    return rg.evaluate(p).withColumns({"recall": r("recall"), "precision": r("precision")})
