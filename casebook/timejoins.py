"""Joins on time stamps, set comparisons and pair statistics on the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook import case
from casebook.motion import r
from casebook.views import DAY, HOUR, LOG, log, table
from surveykit.operators import asof, contracts, motion as m

WIDE = 10 * DAY
SIDES = LOG + """, l AS (SELECT run_id, stamp_ns, seq, value FROM log WHERE topic = 'view'),
  r AS (SELECT run_id, stamp_ns, seq, value FROM log WHERE topic = 'click')"""


def sides(spark, sf, a="view", b="click"):
    l = log(spark, sf)
    keep = ["run_id", "stamp_ns", "seq", "value"]
    return l.where(F.col("topic") == a).select(*keep), l.where(F.col("topic") == b).select(*keep)


@case("join_exact_stamp", """SELECT a.o_orderkey AS left_key, b.o_orderkey AS right_key, a.o_custkey AS run_id, epoch_us(a.o_orderdate) * 1000 AS stamp_ns
  FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate = b.o_orderdate
  WHERE a.o_orderpriority = '1-URGENT' AND b.o_orderpriority = '5-LOW'""")
def join_exact_stamp(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"),
        (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000).alias("stamp_ns"),
        "o_orderkey",
        "o_orderpriority",
    )
    a = o.where("o_orderpriority = '1-URGENT'").select("run_id", "stamp_ns", F.col("o_orderkey").alias("left_key"))
    b = o.where("o_orderpriority = '5-LOW'").select("run_id", "stamp_ns", F.col("o_orderkey").alias("right_key"))
    return a.join(b, ["run_id", "stamp_ns"])


def _nearest_sql(tolerance: int, tie: str) -> str:
    after = "ga <= gb" if tie == "after" else "ga < gb"
    return f"""WITH {SIDES}, b AS (SELECT l.*, r.stamp_ns AS bs, r.seq AS bq FROM l ASOF LEFT JOIN r ON l.run_id = r.run_id AND l.stamp_ns >= r.stamp_ns),
  a AS (SELECT l.seq, r.stamp_ns AS s, r.seq AS q FROM l ASOF LEFT JOIN r ON l.run_id = r.run_id AND l.stamp_ns < r.stamp_ns),
  c AS (SELECT b.run_id, b.seq, b.stamp_ns, bs, bq, s, q, b.stamp_ns - bs AS gb, s - b.stamp_ns AS ga FROM b JOIN a USING (seq)),
  d AS (SELECT run_id, seq, CASE WHEN bs IS NULL OR coalesce({after}, false) THEN q ELSE bq END AS mq,
    CASE WHEN bs IS NULL OR coalesce({after}, false) THEN ga ELSE gb END AS gap FROM c)
  SELECT run_id, seq, CASE WHEN gap <= {tolerance} THEN mq END AS match_seq FROM d"""


@case("join_nearest_tol", _nearest_sql(6 * HOUR, "after"))
def join_nearest_tol(spark, sf):
    a, b = sides(spark, sf)
    out = asof.nearest(a, b, ["run_id"], ["seq"], 6 * HOUR, WIDE, tie="after")
    return out.select("run_id", "seq", F.col("match.seq").alias("match_seq"))


@case("join_nearest_odom", _nearest_sql(12 * HOUR, "before"))
def join_nearest_odom(spark, sf):
    a, b = sides(spark, sf)
    out = asof.nearest(a, b, ["run_id"], ["seq"], 12 * HOUR, WIDE, tie="before")
    return out.select("run_id", "seq", F.col("match.seq").alias("match_seq"))


@case("join_scan_fallback", f"""WITH {SIDES}, b AS (SELECT l.run_id, l.seq, l.stamp_ns - r.stamp_ns AS age, r.seq AS q FROM l ASOF LEFT JOIN r
  ON l.run_id = r.run_id AND l.stamp_ns >= r.stamp_ns) SELECT run_id, seq, CASE WHEN age <= {12 * HOUR} THEN q END AS scan_seq FROM b""")
def join_scan_fallback(spark, sf):
    a, b = sides(spark, sf)
    out = asof.latest(a, b, ["run_id"], ["seq"], 12 * HOUR, WIDE)
    return out.select("run_id", "seq", F.col("match.seq").alias("scan_seq"))


# one step of the walk takes the next message of each run; a side's waiting messages are a list, the newest at its end
SLOP4 = 2 * DAY
_NAMES4 = ["left", "right", "left_info", "right_info"]
_TOPICS4 = ["view", "click", "purchase", "signup"]
_FULL = " AND ".join(f"(m.side = {k} OR (len(w.h{k}) > 0 AND m.stamp_ns - w.h{k}[len(w.h{k})].t <= {SLOP4}))" for k in range(4))
_NEXT = ", ".join(f"CASE WHEN {_FULL} THEN CASE WHEN m.side = {k} THEN w.h{k} ELSE w.h{k}[1:len(w.h{k}) - 1] END WHEN m.side = {k} THEN list_append(w.h{k}, {{'t': m.stamp_ns, 'q': m.seq}}) ELSE w.h{k} END" for k in range(4))
_USED = ", ".join(f"CASE WHEN {_FULL} THEN CASE WHEN m.side = {k} THEN {{'t': m.stamp_ns, 'q': m.seq}} ELSE w.h{k}[len(w.h{k})] END END" for k in range(4))
_NONE = "CAST([] AS STRUCT(t BIGINT, q BIGINT)[])"
SETS_SQL = f"""WITH RECURSIVE {LOG}, m AS (SELECT run_id, list_position({_TOPICS4}, topic) - 1 AS side, stamp_ns, seq, row_number() OVER (PARTITION BY run_id ORDER BY stamp_ns, list_position({_TOPICS4}, topic), seq) AS i FROM log WHERE topic IN ({str(_TOPICS4)[1:-1]})),
  walk(run_id, i, h0, h1, h2, h3, u0, u1, u2, u3) AS (
    SELECT DISTINCT run_id, 0::BIGINT, {", ".join([_NONE] * 4)}, {", ".join(["NULL::STRUCT(t BIGINT, q BIGINT)"] * 4)} FROM m
    UNION ALL SELECT w.run_id, m.i, {_NEXT}, {_USED} FROM walk w JOIN m ON m.run_id = w.run_id AND m.i = w.i + 1)
  SELECT run_id, u0.t AS stamp_ns, {", ".join(f"u{k}.q AS {n}_seq" for k, n in enumerate(_NAMES4))}, greatest(u0.t, u1.t, u2.t, u3.t) - least(u0.t, u1.t, u2.t, u3.t) AS span_ns
  FROM walk WHERE u0 IS NOT NULL"""


def four_sided(spark, sf):
    side = F.array_position(F.array(*[F.lit(t) for t in _TOPICS4]), F.col("topic")).cast("int") - 1
    return log(spark, sf).where(F.col("topic").isin(_TOPICS4)).select("run_id", side.alias("side"), "stamp_ns", "seq")


@case("join_approx_sync", SETS_SQL)
def join_approx_sync(spark, sf):
    return asof.approx_sync(four_sided(spark, sf), ["run_id"], SLOP4, WIDE)


@case("join_mutual_nearest", f"""WITH {SIDES}, p AS (SELECT l.run_id, l.seq AS ls, r.seq AS rs, l.stamp_ns AS lt, r.stamp_ns AS rt, abs(l.stamp_ns - r.stamp_ns) AS d,
    CASE WHEN r.stamp_ns <= l.stamp_ns THEN 0 ELSE 1 END AS a1, CASE WHEN l.stamp_ns <= r.stamp_ns THEN 0 ELSE 1 END AS a2
    FROM l JOIN r ON l.run_id = r.run_id AND abs(l.stamp_ns - r.stamp_ns) <= {8 * HOUR}),
  f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY ls ORDER BY d, a1) = 1),
  g AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY rs ORDER BY d, a2) = 1)
  SELECT f.run_id, f.ls AS left_seq, f.lt AS stamp_ns, f.rs AS right_seq, f.rt AS right_stamp_ns FROM f JOIN g ON f.ls = g.ls AND f.rs = g.rs""")
def join_mutual_nearest(spark, sf):
    a, b = sides(spark, sf)
    return asof.mutual_nearest(a, b, ["run_id"], 8 * HOUR, WIDE)


def two_sided(spark, sf):
    l = log(spark, sf).where(F.col("topic").isin("view", "click"))
    return l.select("run_id", "stamp_ns", F.when(F.col("topic") == "view", 0).otherwise(1).alias("side"), "seq")


# the SQL twin walks both sorted streams one step at a time, all runs together
GATE = 8 * HOUR
PAIRING = f"""li AS (SELECT run_id, stamp_ns, row_number() OVER (PARTITION BY run_id ORDER BY stamp_ns) AS i FROM l),
  ri AS (SELECT run_id, stamp_ns, row_number() OVER (PARTITION BY run_id ORDER BY stamp_ns) AS j FROM r),
  walk AS (SELECT li.run_id, i, j, li.stamp_ns AS lt, ri.stamp_ns AS rt FROM li JOIN ri USING (run_id) WHERE i = 1 AND j = 1
    UNION ALL SELECT w.run_id, li.i, ri.j, li.stamp_ns, ri.stamp_ns FROM walk w
    JOIN li ON li.run_id = w.run_id AND li.i = w.i + CASE WHEN w.rt - w.lt < -{GATE} THEN 0 ELSE 1 END
    JOIN ri ON ri.run_id = w.run_id AND ri.j = w.j + CASE WHEN w.rt - w.lt > {GATE} THEN 0 ELSE 1 END),
  pairs AS (SELECT run_id, lt AS left_ns, rt AS right_ns, abs(rt - lt) AS abs_dt_ns FROM walk WHERE abs(rt - lt) <= {GATE})"""


@case("join_gate_one_to_one", f"WITH RECURSIVE {SIDES}, {PAIRING} SELECT * FROM pairs")
def join_gate_one_to_one(spark, sf):
    return asof.gate_one_to_one(two_sided(spark, sf), ["run_id"], GATE, WIDE)


def _pairs(spark, sf):
    l = two_sided(spark, sf)
    counts = l.groupBy("run_id").agg(F.count_if(F.col("side") == 0).alias("left_n"))
    return asof.gate_one_to_one(l, ["run_id"], GATE, WIDE), counts.where("left_n > 0")


STATS = "SELECT run_id, count(*) AS left_n FROM l GROUP BY ALL"


@case("agg_pair_stats", f"""WITH RECURSIVE {SIDES}, {PAIRING}, n AS ({STATS}), o AS (SELECT run_id, list_sort(list(abs_dt_ns / 1e6)) AS d FROM pairs GROUP BY ALL)
  SELECT run_id, left_n, coalesce(len(d), 0) AS pairs, round(coalesce(len(d), 0) / left_n::DOUBLE, 6) AS left_acceptance,
  round(d[CAST(round_even((len(d) - 1) * 0.5::DOUBLE, 0) AS INTEGER) + 1], 6) AS median_dt_ms,
  round(d[CAST(round_even((len(d) - 1) * 0.95::DOUBLE, 0) AS INTEGER) + 1], 6) AS p95_dt_ms, round(d[len(d)], 6) AS max_dt_ms
  FROM n LEFT JOIN o USING (run_id)""")
def agg_pair_stats(spark, sf):
    out = m.pair_stats(*_pairs(spark, sf), ["run_id"], "nearest")
    for c in ("left_acceptance", "median_dt_ms", "p95_dt_ms", "max_dt_ms"):
        out = out.withColumn(c, r(c))
    return out


@case("agg_pair_stats_linear", f"""WITH RECURSIVE {SIDES}, {PAIRING}, n AS ({STATS}), o AS (SELECT run_id, count(*) AS k, quantile_cont(abs_dt_ns / 1e6, 0.5) AS a,
  quantile_cont(abs_dt_ns / 1e6, 0.95) AS b, max(abs_dt_ns / 1e6) AS c FROM pairs GROUP BY ALL)
  SELECT run_id, left_n, coalesce(k, 0) AS pairs, round(coalesce(k, 0) / left_n::DOUBLE, 6) AS left_acceptance, round(a, 6) AS median_dt_ms,
  round(b, 6) AS p95_dt_ms, round(c, 6) AS max_dt_ms FROM n LEFT JOIN o USING (run_id)""")
def agg_pair_stats_linear(spark, sf):
    out = m.pair_stats(*_pairs(spark, sf), ["run_id"], "linear").withColumn("left_acceptance", r("left_acceptance"))
    for c in ("median_dt_ms", "p95_dt_ms", "max_dt_ms"):
        out = out.withColumn(c, r(c))
    return out


@case("join_latest_pair", f"""WITH RECURSIVE {LOG}, m AS (SELECT run_id, stamp_ns, seq, topic = 'click' AS side FROM log WHERE topic IN ('view', 'click')),
  s AS (SELECT *, last_value(CASE WHEN NOT side THEN stamp_ns END IGNORE NULLS) OVER w AS left_ns, last_value(CASE WHEN side THEN stamp_ns END IGNORE NULLS) OVER w AS right_ns
    FROM m WINDOW w AS (PARTITION BY run_id ORDER BY stamp_ns, side, seq)),
  c AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY stamp_ns, side, seq) AS i FROM s WHERE abs(left_ns - right_ns) <= {GATE}),
  w AS (SELECT run_id, i, stamp_ns, left_ns, right_ns, stamp_ns + {2 * DAY} AS ready, true AS keep FROM c WHERE i = 1
    UNION ALL SELECT c.run_id, c.i, c.stamp_ns, c.left_ns, c.right_ns, CASE WHEN c.stamp_ns >= ready THEN c.stamp_ns + {2 * DAY} ELSE ready END, c.stamp_ns >= ready
    FROM w JOIN c ON c.run_id = w.run_id AND c.i = w.i + 1)
  SELECT run_id, stamp_ns, left_ns, right_ns FROM w WHERE keep""")
def join_latest_pair(spark, sf):
    return asof.latest_pair(two_sided(spark, sf), ["run_id"], GATE, 2 * DAY, WIDE)


@case("join_tf_asof", f"""WITH {SIDES}, b AS (SELECT l.run_id, l.seq, l.stamp_ns, r.stamp_ns AS bs, r.value AS bv FROM l ASOF LEFT JOIN r ON l.run_id = r.run_id AND l.stamp_ns >= r.stamp_ns),
  a AS (SELECT l.seq, r.stamp_ns AS s, r.value AS av FROM l ASOF LEFT JOIN r ON l.run_id = r.run_id AND l.stamp_ns < r.stamp_ns),
  c AS (SELECT * FROM b JOIN a USING (seq)), k AS (SELECT *, CASE WHEN bs IS NOT NULL AND (s IS NOT NULL OR bs = stamp_ns) THEN 'exact'
    WHEN bs IS NOT NULL AND stamp_ns - bs <= {DAY} THEN 'latest' WHEN bs IS NOT NULL THEN 'stale' WHEN s IS NOT NULL THEN 'startup' ELSE 'missing' END AS tf_class FROM c),
  p AS (SELECT *, CASE WHEN tf_class = 'exact' AND s IS NOT NULL THEN (stamp_ns - bs)::DOUBLE / (s - bs) ELSE 0 END AS t FROM k)
  SELECT run_id, seq, tf_class, CASE WHEN tf_class IN ('exact', 'latest') THEN round(bv + (coalesce(av, bv) - bv) * t, 6) END AS tx,
  CASE WHEN tf_class IN ('exact', 'latest') THEN round(sin((bv + (coalesce(av, bv) - bv) * t) / 1000.0), 6) END AS qz FROM p""")
def join_tf_asof(spark, sf):
    a, b = sides(spark, sf)
    half = F.col("value") / 1000.0
    tf = b.select(
        "run_id", "stamp_ns", "seq", F.col("value").alias("tx"), F.lit(0.0).alias("ty"), F.lit(0.0).alias("tz"),
        F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"), F.cos(half).alias("qw"))
    out = asof.tf_asof(a, tf, ["run_id"], DAY, WIDE)
    return out.select("run_id", "seq", "tf_class", r("tx").alias("tx"), r("qz").alias("qz"))


EXPECT = """e AS (SELECT DISTINCT o_orderkey AS stamp_ns FROM orders), s AS (SELECT DISTINCT l_orderkey AS stamp_ns FROM lineitem WHERE l_linenumber > 1)"""


def _expected(spark, sf):
    e = table(spark, sf, "orders").select(F.col("o_orderkey").alias("stamp_ns"))
    s = table(spark, sf, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("stamp_ns"))
    return e, s


@case("anti_missing_stamp", f"""WITH {EXPECT} SELECT stamp_ns, 'missing' AS side FROM (FROM e EXCEPT FROM s)
  UNION ALL SELECT stamp_ns, 'unexpected' AS side FROM (FROM s EXCEPT FROM e)""")
def anti_missing_stamp(spark, sf):
    return contracts.set_difference(*_expected(spark, sf), ["stamp_ns"])


@case("set_diff", f"WITH {EXPECT} FROM e EXCEPT FROM s")
def set_diff(spark, sf):
    e, s = _expected(spark, sf)
    return e.distinct().join(s, ["stamp_ns"], "left_anti")


@case("set_subset", f"WITH {LOG}, want AS (SELECT * FROM (VALUES ('view'), ('error'), ('signup')) t(topic)) SELECT run_id, count(DISTINCT topic) FILTER (topic IN (SELECT topic FROM want)) = 3 AS is_superset FROM log GROUP BY ALL")
def set_subset(spark, sf):
    return contracts.contains_all(log(spark, sf), ["run_id"], "topic", ["view", "error", "signup"])


@case("anti_missing_topic", f"""WITH {LOG}, want AS (SELECT * FROM (SELECT DISTINCT run_id FROM log), (VALUES ('view'), ('error'), ('purchase')) t(topic))
  SELECT run_id, topic FROM want WHERE (run_id, topic) NOT IN (SELECT run_id, topic FROM log WHERE value > 150)""")
def anti_missing_topic(spark, sf):
    l = log(spark, sf)
    return contracts.missing_members(l.where("value > 150"), l.select("run_id"), ["run_id"], "topic", ["view", "error", "purchase"])


@case("anti_missing_edge", """WITH g AS (SELECT DISTINCT 'region' || n_regionkey AS parent, s_nationkey AS child FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 7000),
  want AS (SELECT 'region' || n_regionkey AS parent, n_nationkey AS child FROM nation)
  SELECT parent, child FROM want WHERE (parent, child) NOT IN (SELECT parent, child FROM g)""")
def anti_missing_edge(spark, sf):
    from surveykit.functions.text import canonical_frame

    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    parent = canonical_frame(F.concat(F.lit(" /region"), F.col("n_regionkey").cast("string")))
    want = n.select(parent.alias("parent"), F.col("n_nationkey").alias("child"))
    seen = s.where("s_acctbal > 7000").join(n, s.s_nationkey == n.n_nationkey).select(parent.alias("parent"), F.col("s_nationkey").alias("child"))
    return want.join(seen, ["parent", "child"], "left_anti")


@case("set_singleton", """SELECT s_nationkey AS run_id, CASE WHEN count(DISTINCT s_name) = 0 THEN 'none' WHEN count(DISTINCT s_name) > 1 THEN 'many' ELSE 'ok' END AS verdict
  FROM supplier GROUP BY ALL""")
def set_singleton(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("run_id"), F.col("s_name").alias("identity"))
    return contracts.singleton(s, ["run_id"], "identity").select("run_id", "verdict")
