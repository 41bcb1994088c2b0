"""Depth, placement, tracks, points, rooms and the merged layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook import case
from casebook.grids import DIST, FREE
from casebook.motion import r
from casebook.views import CELLS, LOG, PTS, VEC, cells, log, points, table, vectors
from surveykit.operators import fusion as fu, layers as ly, spatial as sp
from surveykit.operators.grid import cells as g


@case("agg_roi_depth", """WITH s AS (SELECT l_suppkey AS box_id, l_quantity / 10.0 AS z FROM lineitem), e AS (SELECT box_id, min(z) AS lo, max(z) AS hi FROM s GROUP BY ALL),
  h AS (SELECT box_id, quantile_cont(z, 0.5) FILTER (z <= (lo + hi) * 0.5) AS nm, count(*) FILTER (z <= (lo + hi) * 0.5) AS nn, quantile_cont(z, 0.5) FILTER (z > (lo + hi) * 0.5) AS fm,
    count(*) AS n, quantile_cont(z, 0.25) AS a, quantile_cont(z, 0.5) AS b, quantile_cont(z, 0.75) AS c, any_value(hi - lo) AS span FROM s JOIN e USING (box_id) GROUP BY ALL),
  k AS (SELECT *, coalesce(span >= 2.4 AND fm - nm >= 2.4, false) AS bi FROM h), o AS (SELECT *, CASE WHEN bi THEN CASE WHEN nn >= 30 THEN nm END WHEN NOT c - a > 2.5 THEN b END AS z FROM k)
  SELECT box_id, n AS samples, round(CASE WHEN n >= 30 THEN z END, 6) AS depth, CASE WHEN n < 30 THEN 'few_samples' WHEN z IS NULL THEN 'iqr_or_gap' ELSE 'ok' END AS reason FROM o""")
def agg_roi_depth(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("box_id"), (F.col("l_quantity") / 10.0).alias("z"))
    return fu.depth_by_group(s, ["box_id"], "z", 30, 2.5, 2.4).withColumn("depth", r("depth"))


@case("agg_disparity_frame", f"""WITH {VEC}, d AS (SELECT vec_id % 25 AS stamp_ns, unnest(e) * 100 AS v FROM vec), q AS (SELECT stamp_ns, count(*) AS total, count(*) FILTER (v > 1) AS valid,
    quantile_cont(v, 0.5) FILTER (v > 1) AS m, quantile_cont(24.0 / v, [0.5, 0.1, 0.9]) FILTER (v > 1) AS z FROM d GROUP BY ALL)
  SELECT stamp_ns, valid, total, round(m, 6) AS disparity_median, round(z[1], 6) AS depth_median_m, round(z[2], 6) AS depth_p10_m, round(z[3], 6) AS depth_p90_m, round(valid / total::DOUBLE, 6) AS ratio FROM q""")
def agg_disparity_frame(spark, sf):
    rows = vectors(spark, sf).select((F.col("vec_id") % 25).alias("stamp_ns"), F.lit(400.0).alias("f"), F.lit(0.06).alias("baseline"), F.lit(1.0).alias("min_d"), F.transform("e", lambda x: x * 100).alias("values"))
    out = fu.disparity_frame(rows, ["stamp_ns"])
    for c in ("disparity_median", "depth_median_m", "depth_p10_m", "depth_p90_m", "ratio"):
        out = out.withColumn(c, r(c))
    return out


GATED = f"""{CELLS}, pts AS (SELECT vec_id % 4 AS map_id, vec_id AS seq, 'class' || CAST(label % 5 AS VARCHAR) AS label, e[1] * 4 AS x, e[2] * 4 AS y FROM vec),
  near AS (SELECT DISTINCT p.seq FROM pts p JOIN cells c USING (map_id) WHERE value >= 50 AND sqrt(((c.col + 0.5) * 0.05 - 3.2 - x) * ((c.col + 0.5) * 0.05 - 3.2 - x) + ((c."row" + 0.5) * 0.05 - 3.2 - y) * ((c."row" + 0.5) * 0.05 - 3.2 - y)) <= 0.06)"""


def map_points(spark, sf):
    return vectors(spark, sf).select((F.col("vec_id") % 4).alias("map_id"), F.col("vec_id").alias("seq"), F.concat(F.lit("class"), (F.col("label") % 5).cast("string")).alias("label"), (F.element_at("e", 1) * 4).alias("x"), (F.element_at("e", 2) * 4).alias("y"))


@case("join_near_occupied", f"WITH {GATED} SELECT map_id, seq FROM pts WHERE seq IN (SELECT seq FROM near)")
def join_near_occupied(spark, sf):
    return fu.near_occupied(map_points(spark, sf), cells(spark, sf), ["map_id"], ["seq"], 0.05, -3.2, -3.2, 0.06).select("map_id", "seq")


@case("flt_map_cell", f"""WITH {GATED} SELECT p.map_id, p.seq, c.value IS NOT NULL AND (label <> 'class1' OR p.seq IN (SELECT seq FROM near)) AS map_ok FROM pts p
  LEFT JOIN cells c ON c.map_id = p.map_id AND c.col = floor((x + 3.2) / 0.05) AND c."row" = floor((y + 3.2) / 0.05)""")
def flt_map_cell(spark, sf):
    out = fu.map_cell_gate(map_points(spark, sf), cells(spark, sf), ["map_id"], ["seq"], 0.05, -3.2, -3.2, ["class1"], 0.06)
    return out.select("map_id", "seq", "map_ok")


def members(spark, sf):
    return fu.associate(points(spark, sf))


def tracks(spark, sf):
    return fu.track_summary(members(spark, sf), ["run_id", "label", "part", "track"])


def associate_sql(sightings: str, radius: float, found: str) -> str:
    """The plain loop over table ``o`` (``run_id, label, seq, stamp_ns, x, y``), ``found`` naming a track's columns.

    One step of the walk takes the next sighting of each run and label; tracks are a list in the order of opening.
    """
    near = "list_sort(list_transform(range(1, len(w.tracks) + 1), lambda k: {'d': sqrt((list_median(w.tracks[k].xs) - o.x) ** 2 + (list_median(w.tracks[k].ys) - o.y) ** 2), 'k': k}))[1]"
    return f"""WITH RECURSIVE {sightings}, o AS (SELECT *, row_number() OVER (PARTITION BY run_id, label ORDER BY stamp_ns, seq) AS i FROM sightings),
  walk(run_id, label, i, seq, stamp_ns, x, y, tracks, k) AS (
    SELECT DISTINCT run_id, label, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, CAST([] AS STRUCT(seq BIGINT, ns BIGINT, xs DOUBLE[], ys DOUBLE[], last BIGINT)[]), NULL::BIGINT FROM o
    UNION ALL SELECT run_id, label, i, seq, stamp_ns, x, y,
      CASE WHEN k IS NULL THEN list_append(tracks, {{'seq': seq, 'ns': stamp_ns, 'xs': [x], 'ys': [y], 'last': stamp_ns}}) WHEN tracks[k].last = stamp_ns THEN tracks
        ELSE list_transform(tracks, lambda t, j: CASE WHEN j = k THEN {{'seq': t.seq, 'ns': t.ns, 'xs': list_append(t.xs, x), 'ys': list_append(t.ys, y), 'last': stamp_ns}} ELSE t END) END,
      CASE WHEN k IS NULL THEN len(tracks) + 1 WHEN tracks[k].last <> stamp_ns THEN k END
    FROM (SELECT o.run_id, o.label, o.i, o.seq, o.stamp_ns, o.x, o.y, w.tracks, CASE WHEN {near}.d <= {radius} THEN {near}.k END AS k FROM walk w JOIN o ON o.run_id = w.run_id AND o.label = w.label AND o.i = w.i + 1))
  SELECT run_id, label, {found}, stamp_ns, seq FROM walk WHERE k IS NOT NULL"""


@case("win_track_associate", associate_sql(PTS + ", sightings AS (SELECT * FROM pts)", 0.5, "CAST(tracks[k].ns AS VARCHAR) AS part, tracks[k].seq AS track"))
def win_track_associate(spark, sf):
    return members(spark, sf).select("run_id", "label", "part", "track", "stamp_ns", "seq")


@case("agg_track", f"""WITH {PTS}, k AS (SELECT run_id, label, seq % 6 AS track, x, y FROM pts), m AS (SELECT run_id, label, track, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM k GROUP BY ALL)
  SELECT run_id, label, track, round(any_value(mx), 6) AS x, round(any_value(my), 6) AS y, count(*) AS hits, round(sqrt(sum((x-mx)*(x-mx)+(y-my)*(y-my)) / (2 * count(*))), 6) AS spread_m FROM k JOIN m USING (run_id, label, track) GROUP BY ALL""")
def agg_track(spark, sf):
    m = points(spark, sf).withColumn("track", F.col("seq") % 6)
    return fu.track_summary(m, ["run_id", "label", "track"]).withColumns({c: r(c) for c in ("x", "y", "spread_m")})


def _tracks_sql(tail: str) -> str:
    return f"""WITH {PTS}, k AS (SELECT run_id, label, seq % 6 AS track, x, y FROM pts), m AS (SELECT run_id, label, track, quantile_cont(x, 0.5) AS mx, quantile_cont(y, 0.5) AS my FROM k GROUP BY ALL),
  t AS (SELECT run_id, label, track, any_value(mx) AS x, any_value(my) AS y, count(*) AS hits, sqrt(sum((x-mx)*(x-mx)+(y-my)*(y-my)) / (2 * count(*))) AS spread_m FROM k JOIN m USING (run_id, label, track) GROUP BY ALL) {tail}"""


def grouped_tracks(spark, sf):
    return fu.track_summary(points(spark, sf).withColumn("track", F.col("seq") % 6), ["run_id", "label", "track"])


@case("agg_confirm", _tracks_sql("SELECT run_id, label, track, hits FROM t WHERE hits >= 4 AND spread_m <= 1.2"))
def agg_confirm(spark, sf):
    return fu.confirm(grouped_tracks(spark, sf), 4, 1.2).select("run_id", "label", "track", "hits")


TOP = "SELECT run_id, label, track, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY hits DESC, label, x, y)::INTEGER AS rank FROM t) WHERE rank <= 6"


@case("agg_top_tracks", _tracks_sql(TOP))
def agg_top_tracks(spark, sf):
    return fu.top_tracks(grouped_tracks(spark, sf), ["run_id"]).select("run_id", "label", "track", "hits", "rank")


@case("topk_tracks", _tracks_sql("SELECT run_id, hits, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY hits DESC, label, x, y)::INTEGER AS rank FROM t) WHERE rank <= 3"))
def topk_tracks(spark, sf):
    return fu.top_tracks(grouped_tracks(spark, sf), ["run_id"], 3).select("run_id", "hits", "rank")


@case("agg_required_labels", _tracks_sql("""SELECT run_id, array_to_string(list_sort(list_filter(['class1','class3','class9'], lambda q: NOT list_contains(coalesce(any_value(ls), []), q))), ',') AS missing,
  len(list_filter(['class1','class3','class9'], lambda q: NOT list_contains(coalesce(any_value(ls), []), q))) = 0 AS complete
  FROM (SELECT DISTINCT run_id FROM pts) LEFT JOIN (SELECT run_id, list(DISTINCT label) AS ls FROM t WHERE hits >= 9 AND spread_m <= 1.2 GROUP BY ALL) USING (run_id) GROUP BY run_id"""))
def agg_required_labels(spark, sf):
    ok = fu.confirm(grouped_tracks(spark, sf), 9, 1.2)
    return fu.missing_labels(ok, points(spark, sf), ["class1", "class3", "class9"])


def poi(spark, sf):
    p = points(spark, sf)
    return p.select("run_id", "label", "cid", "x", "y", (F.col("seq") % 7 + 1).alias("hits"), (F.col("seq") % 3 / 10.0).alias("spread_m"), F.col("seq").alias("ord"))


def _to_mm(value: str) -> str:
    """Rounded by the exact binary value, as text output does."""
    return f"CAST(printf('%.3f', {value}) AS DOUBLE)"


# one step of the walk merges the closest pair of each run and label; merged points go to the end of the list
_OBJ = "STRUCT(cid INTEGER, x DOUBLE, y DOUBLE, hits BIGINT, spread DOUBLE, n BIGINT)"
_CLOSEST = "list_sort(list_filter(flatten(list_transform(range(1, len(o) + 1), lambda i: list_transform(range(i + 1, len(o) + 1), lambda j: {'d': sqrt((o[i].x - o[j].x) ** 2 + (o[i].y - o[j].y) ** 2), 'i': i, 'j': j}))), lambda p: p.d < lim))[1]"
DEDUPE_SQL = f"""WITH RECURSIVE {PTS}, g AS (SELECT run_id, label, CASE label WHEN 'class1' THEN 0.9::DOUBLE WHEN 'class2' THEN 0.3::DOUBLE ELSE 0.6::DOUBLE END AS lim,
    list(CAST({{'cid': cid, 'x': x, 'y': y, 'hits': seq % 7 + 1, 'spread': seq % 3 / 10.0::DOUBLE, 'n': 1}} AS {_OBJ}) ORDER BY seq) AS o FROM pts GROUP BY ALL),
  walk(run_id, label, lim, o, p) AS (
    SELECT run_id, label, lim, o, {_CLOSEST} FROM g
    UNION ALL SELECT run_id, label, lim, o, {_CLOSEST} FROM (
      SELECT run_id, label, lim, list_append(list_transform(list_filter(range(1, len(o) + 1), lambda k: k <> p.i AND k <> p.j), lambda k: o[k]), CAST({{
        'cid': o[p.i].cid, 'x': {_to_mm("(o[p.i].x * o[p.i].hits + o[p.j].x * o[p.j].hits) / (o[p.i].hits + o[p.j].hits)")}, 'y': {_to_mm("(o[p.i].y * o[p.i].hits + o[p.j].y * o[p.j].hits) / (o[p.i].hits + o[p.j].hits)")},
        'hits': o[p.i].hits + o[p.j].hits, 'spread': {_to_mm('greatest(o[p.i].spread, o[p.j].spread, p.d / 2.0)')}, 'n': o[p.i].n + o[p.j].n}} AS {_OBJ})) AS o
      FROM walk WHERE p IS NOT NULL))
  SELECT run_id, label, u.cid AS cid, u.x AS x, u.y AS y, u.hits AS hits, u.spread AS spread_m, u.n AS merged_from FROM (SELECT run_id, label, unnest(o) AS u FROM walk WHERE p IS NULL)"""


@case("win_poi_dedupe", DEDUPE_SQL)
def win_poi_dedupe(spark, sf):
    return fu.dedupe_points(poi(spark, sf), min_dist={"class1": 0.9, "class2": 0.3}, default=0.6)


@case("sort_poi", f"WITH {PTS} SELECT run_id, label, seq % 7 + 1 AS hits, seq AS ord, row_number() OVER (PARTITION BY run_id ORDER BY label, seq % 7 + 1 DESC, x, y) AS place FROM pts")
def sort_poi(spark, sf):
    return fu.rank_points(poi(spark, sf), ["run_id"]).select("run_id", "label", "hits", "ord", "place").orderBy("run_id", "place")


@case("src_poi_docs", "SELECT p_partkey, p_name, contains(lower(p_name), 'widget') OR contains(lower(p_name), 'ring') AS is_door FROM part")
def src_poi_docs(spark, sf):
    from surveykit.sources.tables import split_poi

    p = table(spark, sf, "part").withColumn("label", F.when(F.col("p_name").contains("widget") | F.col("p_name").contains("ring"), F.concat(F.lit("Door "), F.col("p_name"))).otherwise(F.col("p_name")))
    d, o = split_poi(p)
    pick = lambda df, v: df.select("p_partkey", "p_name", F.lit(v).alias("is_door"))
    return pick(d, True).unionByName(pick(o, False))


# ---------------------------------------------------------------- rooms

ROOMS = """rooms AS (SELECT n_nationkey % 4 AS run_id, n_nationkey AS ord, CASE WHEN n_nationkey % 9 = 0 THEN 'phantom' ELSE 'room' END AS status,
  (n_nationkey % 5) * 1.5 - 3.5 AS x0, (n_nationkey // 5) * 1.5 - 3.5 AS y0, 1.0 + (n_nationkey % 3) * 0.9 AS w FROM nation)"""


def rooms(spark, sf):
    n = F.col("n_nationkey")
    x, y, w = (n % 5) * 1.5 - 3.5, F.floor(n / 5) * 1.5 - 3.5, F.lit(1.0) + (n % 3) * 0.9
    corner = lambda a, b: F.struct((x + w * a).alias("x"), (y + w * b).alias("y"))
    # an L shape, so the bounding box is not the room
    poly = F.array(corner(0.0, 0.0), corner(1.0, 0.0), corner(1.0, 0.5), corner(0.5, 0.5), corner(0.5, 1.0), corner(0.0, 1.0))
    return table(spark, sf, "nation").select((n % 4).cast("bigint").alias("run_id"), n.alias("ord"), F.when(n % 9 == 0, "phantom").otherwise("room").alias("status"), poly.alias("polygon"))


INROOM = f"""{PTS}, {ROOMS}, hit AS (SELECT p.run_id, p.seq, p.label, min(r.ord) AS room_ord FROM pts p JOIN rooms r ON r.run_id = p.run_id AND status <> 'phantom' AND x > x0 AND y > y0
    AND ((x < x0 + w AND y < y0 + w / 2) OR (x < x0 + w / 2 AND y < y0 + w)) GROUP BY ALL)"""


@case("join_point_in_polygon", f"WITH {INROOM} SELECT p.run_id, p.seq, h.room_ord FROM pts p LEFT JOIN hit h USING (run_id, seq)")
def join_point_in_polygon(spark, sf):
    return ly.assign_rooms(points(spark, sf), rooms(spark, sf), ["run_id"], ["seq"]).select("run_id", "seq", "room_ord")


@case("agg_room_facilities", f"""WITH {INROOM}, t AS (SELECT run_id, room_ord, label, min(seq) AS o FROM hit GROUP BY ALL)
  SELECT run_id, room_ord, string_agg(label, ',' ORDER BY o) AS facilities, 'room' AS semantic FROM t GROUP BY ALL""")
def agg_room_facilities(spark, sf):
    a = ly.assign_rooms(points(spark, sf), rooms(spark, sf), ["run_id"], ["seq"]).where("room_ord is not null")
    return ly.room_facilities(a, ["run_id", "room_ord"], "seq")


@case("agg_vote_min_name", """WITH v AS (SELECT n_regionkey, c_mktsegment AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
  SELECT n_regionkey, name AS winner, n AS votes FROM v QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n DESC, name) = 1""")
def agg_vote_min_name(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return ly.vote(c, ["n_regionkey"], "c_mktsegment")


@case("agg_room_name", """WITH o AS (SELECT c_nationkey AS id, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Bedroom' WHEN 'MACHINERY' THEN 'Kitchen' END AS v FROM customer),
  n AS (SELECT id, v, count(*) AS k FROM o WHERE v IS NOT NULL GROUP BY ALL), w AS (SELECT id, v FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC, v) = 1),
  r AS (SELECT n_regionkey AS map_id, n_nationkey AS id, (n_nationkey * 37 % 23)::DOUBLE AS area_m2, v FROM nation LEFT JOIN w ON id = n_nationkey),
  a AS (SELECT *, coalesce(v, 'Room ' || chr((64 + row_number() OVER (PARTITION BY map_id, v IS NULL ORDER BY area_m2 DESC, id))::INTEGER)) AS nm FROM r)
  SELECT map_id, id, area_m2, CASE WHEN count(*) OVER (PARTITION BY map_id, nm) > 1 THEN nm || row_number() OVER (PARTITION BY map_id, nm ORDER BY id) ELSE nm END AS name FROM a""")
def agg_room_name(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("map_id"), F.col("n_nationkey").alias("id"), (F.col("n_nationkey") * 37 % 23).cast("double").alias("area_m2"))
    o = table(spark, sf, "customer").select(F.col("c_nationkey").alias("id"), F.when(F.col("c_mktsegment") == "HOUSEHOLD", "bed").when(F.col("c_mktsegment") == "MACHINERY", "sink").alias("label"))
    return ly.room_names(n, o.join(n.select("map_id", "id"), "id"), ["map_id"])


@case("agg_circular_mean4", f"""WITH {VEC}, s AS (SELECT vec_id % 10 AS map_id, e[3] - e[1] AS dx, e[4] - e[2] AS dy FROM vec), a AS (SELECT map_id, sqrt(dx*dx+dy*dy) AS l, atan2(dy, dx) * 4 AS t FROM s)
  SELECT map_id, count(*) AS n, round(-degrees(atan2(sum(l * sin(t)), sum(l * cos(t)))) / 4, 5) AS turn_deg FROM a GROUP BY ALL""")
def agg_circular_mean4(spark, sf):
    e = lambda i: F.element_at("e", i)
    s = vectors(spark, sf).select((F.col("vec_id") % 10).alias("map_id"), e(1).alias("ax"), e(2).alias("ay"), e(3).alias("bx"), e(4).alias("by"))
    return ly.wall_direction(s, ["map_id"]).withColumn("turn_deg", r("turn_deg", 5))


@case("agg_polygon", f"""WITH {VEC}, p AS (SELECT vec_id, e[1] AS x1, e[2] AS y1, 2 + e[3] AS x2, e[4] AS y2, 2 + e[5] AS x3, 3 + e[6] AS y3, e[7] AS x4, 3 + e[8] AS y4 FROM vec),
  c AS (SELECT *, x1*y2-x2*y1 AS a, x2*y3-x3*y2 AS b, x3*y4-x4*y3 AS c, x4*y1-x1*y4 AS d FROM p)
  SELECT vec_id, round(abs(a+b+c+d)/2, 6) AS area_m2, round(((x1+x2)*a+(x2+x3)*b+(x3+x4)*c+(x4+x1)*d)/(3*(a+b+c+d)), 6) AS cx, round(((y1+y2)*a+(y2+y3)*b+(y3+y4)*c+(y4+y1)*d)/(3*(a+b+c+d)), 6) AS cy FROM c""")
def agg_polygon(spark, sf):
    e = lambda i: F.element_at("e", i)
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    p = vectors(spark, sf).select("vec_id", F.array(pt(e(1), e(2)), pt(2 + e(3), e(4)), pt(2 + e(5), 3 + e(6)), pt(e(7), 3 + e(8))).alias("polygon"))
    return ly.polygon_table(p, ["vec_id"]).withColumns({c: r(c) for c in ("area_m2", "cx", "cy")})


@case("join_poi_zone", f"""WITH {CELLS}, z AS (SELECT map_id, col, "row", CAST(floor(col / 20) AS BIGINT) AS zone FROM cells WHERE value = 0), p AS (SELECT map_id, col, "row", "row"::BIGINT * 1000 + col AS poi FROM cells WHERE value = 100)
  SELECT p.map_id, p.poi, arg_min(z.zone, struct_pack(d := (p.col-z.col)*(p.col-z.col)+(p."row"-z."row")*(p."row"-z."row"), z := z.zone)) AS zone FROM p LEFT JOIN z ON z.map_id = p.map_id AND (p.col-z.col)*(p.col-z.col)+(p."row"-z."row")*(p."row"-z."row") <= 36 GROUP BY ALL""")
def join_poi_zone(spark, sf):
    c = cells(spark, sf)
    z = c.where("value = 0").select("map_id", F.floor(F.col("col") / 20).alias("zone"), F.col("col").alias("tx"), F.col("row").alias("ty"))
    p = c.where("value = 100").select("map_id", (F.col("row").cast("bigint") * 1000 + F.col("col")).alias("poi"), F.col("col").alias("x"), F.col("row").alias("y"))
    return sp.nearest_within(p, z, ["map_id"], ["poi"], 6.0, ["zone"], ["zone"]).select("map_id", "poi", F.col("match.zone").alias("zone"))


@case("join_poi_cell", f"""WITH {CELLS}, p AS (SELECT vec_id, vec_id % 4 AS map_id, CAST(round_even(e[1] * 80, 0) AS INTEGER) + 64 AS col, CAST(round_even(e[2] * 80, 0) AS INTEGER) + 64 AS "row" FROM vec)
  SELECT vec_id, map_id, CAST(floor(c.col / 20) AS BIGINT) AS room FROM p JOIN cells c USING (map_id, col, "row")""")
def join_poi_cell(spark, sf):
    at = lambda i: (F.rint(F.element_at("e", i) * 80) + 64).cast("int")
    p = vectors(spark, sf).select("vec_id", (F.col("vec_id") % 4).alias("map_id"), at(1).alias("col"), at(2).alias("row"))
    lab = cells(spark, sf).select("map_id", "col", "row", F.floor(F.col("col") / 20).alias("room"))
    return p.join(lab, ["map_id", "col", "row"]).select("vec_id", "map_id", "room")


EDGE = """edges AS (SELECT run_id, ord, i AS edge_no, x0 + w * ([0.0,1.0,1.0,0.5,0.5,0.0])[i + 1] AS ax, y0 + w * ([0.0,0.0,0.5,0.5,1.0,1.0])[i + 1] AS ay,
  x0 + w * ([1.0,1.0,0.5,0.5,0.0,0.0])[i + 1] AS bx, y0 + w * ([0.0,0.5,0.5,1.0,1.0,0.0])[i + 1] AS b_y FROM rooms, (SELECT unnest(range(0, 6)) AS i))"""


@case("join_snap_segment", f"""WITH {PTS}, {ROOMS}, {EDGE}, j AS (SELECT p.run_id, p.seq, p.x, p.y, e.ax, e.ay, e.bx, e.b_y, greatest(0.0, least(1.0, ((p.x-ax)*(bx-ax)+(p.y-ay)*(b_y-ay))/((bx-ax)*(bx-ax)+(b_y-ay)*(b_y-ay)))) AS t FROM pts p JOIN edges e USING (run_id)),
  k AS (SELECT *, ax+t*(bx-ax) AS qx, ay+t*(b_y-ay) AS qy, round(sqrt((x-ax-t*(bx-ax))*(x-ax-t*(bx-ax))+(y-ay-t*(b_y-ay))*(y-ay-t*(b_y-ay))), 9) AS d FROM j),
  b AS (SELECT run_id, seq, round(min(d), 5) AS d FROM k WHERE d <= 0.7 GROUP BY ALL) SELECT p.run_id, p.seq, b.d IS NOT NULL AS snapped, b.d FROM pts p LEFT JOIN b USING (run_id, seq)""")
def join_snap_segment(spark, sf):
    d = points(spark, sf)
    out = sp.snap_to_edges(d, sp.polygon_edges(rooms(spark, sf)), ["run_id"], ["seq"], 0.7)
    gap = F.sqrt((F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy")))
    return out.select("run_id", "seq", "snapped", r(gap, 5).alias("d"))


def walls(spark, sf):
    """Distance-to-wall of each free cell of the map, keyed like the rooms."""
    d = g.distance(cells(spark, sf).where("value = 0").select("map_id", "col", "row"))
    return d.select(F.col("map_id").alias("run_id"), (F.col("col") - 64).alias("col"), (F.col("row") - 64).alias("row"), (F.col("dist") * 0.1).alias("dist_m"))


@case("join_edge_wall", f"""WITH {FREE}, {DIST}, {ROOMS}, {EDGE}, wd AS (SELECT map_id AS run_id, col - 64 AS col, "row" - 64 AS "row", sqrt(d2::DOUBLE) * 0.1::DOUBLE AS dist_m FROM dist),
  ends AS (SELECT run_id, min(col) AS c0, max(col) AS c1, min("row") AS r0, max("row") AS r1 FROM wd GROUP BY ALL),
  s AS (SELECT e.*, 0.15::DOUBLE + i * (0.70::DOUBLE / 8) AS share FROM edges e, (SELECT unnest(range(0, 9)) AS i)),
  q AS (SELECT s.*, greatest(c0, least(c1, CAST(round_even((ax + (bx - ax) * share) / 0.1::DOUBLE, 0) AS BIGINT))) AS col, greatest(r0, least(r1, CAST(round_even((ay + (b_y - ay) * share) / 0.1::DOUBLE, 0) AS BIGINT))) AS "row" FROM s JOIN ends USING (run_id)),
  m AS (SELECT run_id, ord, edge_no, median(coalesce(dist_m, 'infinity'::DOUBLE)) < 0.3::DOUBLE AS real_, max(sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay))) AS long_ FROM q LEFT JOIN wd USING (run_id, col, "row") GROUP BY ALL)
  SELECT run_id, ord, count(*) AS edges, count(*) FILTER (real_) AS wall_edges, round(sum(CASE WHEN real_ THEN long_ ELSE 0 END) / sum(long_), 6) AS explored_frac FROM m GROUP BY ALL""")
def join_edge_wall(spark, sf):
    out = ly.edge_walls(rooms(spark, sf), walls(spark, sf), ["run_id"], near=0.3, res=0.1)
    return out.withColumn("explored_frac", r("explored_frac"))


@case("flt_explored", "SELECT n_nationkey, CASE WHEN n_regionkey / 5.0 < 0.35 THEN 'unexplored' ELSE 'room' END AS status FROM nation")
def flt_explored(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", (F.col("n_regionkey") / 5.0).alias("explored_frac"), F.lit("room").alias("status"))
    return ly.explored(n).select("n_nationkey", "status")


@case("snk_zones", f"""WITH {CELLS}, z AS (SELECT map_id, col, "row", value, CAST(floor(col / 20) AS INTEGER) AS zone FROM cells), a AS (SELECT map_id, zone, round(count(*) * 0.05 * 0.05, 1)::DOUBLE AS area_m2 FROM z WHERE value = 0 GROUP BY ALL),
  p AS (SELECT map_id, zone, string_agg(l, ',' ORDER BY l) AS poi_labels FROM (SELECT map_id, zone, 'row' || ("row" % 3) AS l FROM z WHERE value = 100) GROUP BY ALL)
  SELECT map_id, zone, area_m2, coalesce(poi_labels, '') AS poi_labels, CASE zone WHEN 2 THEN 'Hall' ELSE 'Zone ' || (zone + 1) END AS name, CASE zone WHEN 2 THEN 'given name' ELSE 'segment identifier' END AS named_by FROM a LEFT JOIN p USING (map_id, zone)""")
def snk_zones(spark, sf):
    z = cells(spark, sf).withColumn("zone", F.floor(F.col("col") / 20).cast("int"))
    anchors = z.where("value = 0").groupBy("map_id", "zone").agg(F.min("col").alias("label_col"))
    p = z.where("value = 100").withColumn("label", F.concat(F.lit("row"), (F.col("row") % 3).cast("string")))
    names = z.where("zone = 2").select("map_id", "zone").distinct().withColumn("name", F.lit("Hall"))
    return ly.zone_table(z.where("value = 0"), anchors, p, names, ["map_id"], 0.05).drop("label_col")


@case("place_detections")
def place_detections(spark, sf):
    """Full chain: boxes, disparity rows, odometry and transforms derived from the vectors and the log."""
    from casebook.chain import placed

    return placed(spark, sf)


@case("merge_layers", f"""WITH {INROOM}, t AS (SELECT run_id, room_ord, label, min(seq) AS o FROM hit GROUP BY ALL), f AS (SELECT run_id, room_ord, string_agg(label, ',' ORDER BY o) AS facilities FROM t GROUP BY ALL),
  c AS (SELECT run_id, room_ord, count(*) AS n_poi FROM hit GROUP BY ALL)
  SELECT r.run_id::BIGINT AS run_id, r.ord AS room_ord, status, coalesce(facilities, '') AS facilities, 'room' AS semantic, coalesce(n_poi, 0) AS n_poi FROM rooms r LEFT JOIN f ON f.run_id = r.run_id AND f.room_ord = r.ord LEFT JOIN c ON c.run_id = r.run_id AND c.room_ord = r.ord WHERE r.run_id <> 3""")
def merge_layers(spark, sf):
    from surveykit.plans.pipelines import merge_layers as merge

    p = points(spark, sf)
    sha = lambda s: F.sha2(F.concat(F.lit(s), F.col("run_id").cast("string")).cast("binary"), 256)
    head = p.select("run_id").distinct().select(
        "run_id", sha("token").alias("recording_token"), sha("bag").alias("source_bag_sha256"), sha("img").alias("map_image_sha256"), sha("man").alias("map_manifest_sha256"),
        F.array(*[F.lit(float(i)) for i in range(6)]).alias("camera_mount"))
    topo = head.withColumn("map_image_sha256", F.when(F.col("run_id") == 3, F.lit("0")).otherwise(F.col("map_image_sha256")))
    table_, _ = merge(p.select("run_id", F.col("seq").alias("ord"), "label", "x", "y"), rooms(spark, sf), head, topo, ["run_id"], ["class1"])
    return table_.select("run_id", "room_ord", "status", "facilities", "semantic", "n_poi")


@case("pose_timeline", f"""WITH {LOG}, s AS (SELECT run_id, stamp_ns, degrees(atan2(sin(value / 1000), cos(value / 1000))) AS pitch FROM log WHERE degrees(atan2(sin(value / 1000), cos(value / 1000))) < 50 AND degrees(atan2(sin(value / 1000), cos(value / 1000))) > -10)
  SELECT run_id, count(*) AS n, round(min(pitch), 5) AS lo, round(max(pitch), 5) AS hi FROM s GROUP BY ALL""")
def pose_timeline(spark, sf):
    from casebook.views import DAY
    from surveykit.plans.pipelines import pose_timeline as timeline

    v = F.col("value") / 1000
    planes = log(spark, sf).select("run_id", "stamp_ns", F.lit(0.0).alias("nx"), (-F.cos(v)).alias("ny"), F.sin(v).alias("nz"), F.lit(0.1).alias("d"))
    series, report = timeline(planes, ["run_id"], 3 * DAY, 12 * DAY)
    span = series.groupBy("run_id").agg(r(F.min("pitch"), 5).alias("lo"), r(F.max("pitch"), 5).alias("hi"))
    return report.join(span, "run_id").select("run_id", "n", "lo", "hi")


@case("plane_fit_frames")
def plane_fit_frames(spark, sf):
    from surveykit.operators.planes import fit_planes

    e = lambda i: F.element_at("e", i)
    # three points per vector near a floor 0.2 m below the camera, pitched by ten degrees
    pts = vectors(spark, sf).select((F.col("vec_id") % 5).alias("stamp_ns"), F.explode(F.sequence(F.lit(1), F.lit(58), F.lit(3))).alias("k"), "e").select(
        "stamp_ns", (e(F.col("k")) * 4).alias("x"), (F.lit(0.2) + e(F.col("k") + 1) * 0.05 + (e(F.col("k") + 2) * 2 + 2) * 0.176).alias("y"), (e(F.col("k") + 2) * 2 + 2).alias("z"))
    return fit_planes(pts, ["stamp_ns"], hypotheses=64, tolerance=0.02, min_inliers=100)


@case("segment_rooms")
def segment_rooms(spark, sf):
    from surveykit.plans.pipelines import segment_rooms as seg

    return seg(cells(spark, sf), 0.05, seed_m=(0.05, 0.1, 0.15, 0.2), min_area=0.05, min_room=0.1, single=0.5)


@case("voronoi_rooms")
def voronoi_rooms(spark, sf):
    from surveykit.plans.pipelines import voronoi_rooms as vor

    return vor(cells(spark, sf), 0.1, min_room=0.2, single=1.0)
