"""Streaming rules driven to completion over the event log, results read back from a shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook import case
from casebook.fusion import associate_sql
from casebook.motion import _DRIFT, _HEALTH, _LATCH, r
from casebook.timejoins import SETS_SQL, SIDES, SLOP4, four_sided
from casebook.views import DAY, HOUR, LOG, log
from surveykit.session import scratch_path
from surveykit.sources.sinks import batch_committer, commit_once, read_committed
from surveykit.streaming import live as st, timed

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
HOURS8 = 8 * HOUR
# the file source does not order rows, so the watermark must cover the whole table once
DELAY = "400 days"


def stream(spark, sf):
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("topic"), (F.unix_micros("ts") * 1000).alias("stamp_ns"), F.col("event_id").alias("seq"), "value")


def drain(df, name, mode="append"):
    """Run a stream over everything available and return its table."""
    spark = df.sparkSession
    out, mark = scratch_path(spark, name), scratch_path(spark, name + "-mark")
    q = df.writeStream.outputMode(mode).option("checkpointLocation", mark).trigger(availableNow=True)
    q = q.format("parquet").option("path", out).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def replay(spark, rows, name, end_ns=None, parts=4, jitter=2 * DAY, shift=None):
    """``rows`` as a stream of files out of order, one per trigger: a row comes up to ``jitter`` after later ones.

    ``shift`` is by how much, from the row's seq. The last file holds one row of no run at ``end_ns``, which ends the
    recording.
    """
    path = scratch_path(spark, name)
    came = F.col("stamp_ns") + (F.pmod(F.xxhash64("seq"), F.lit(jitter)) if shift is None else shift)
    ends = rows.agg(F.min("stamp_ns").alias("a"), F.max("stamp_ns").alias("b")).first()
    wide = (ends.b + jitter - ends.a) // parts + 1
    for k in range(parts):
        here = rows.where(F.floor((came - ends.a) / wide) == k)
        here.repartition(1).orderBy(F.xxhash64("seq", F.lit(1))).write.mode("append").parquet(path)
    if end_ns is not None:
        rows.limit(1).select(*[F.lit(end_ns(ends.b)).alias(c) if c == "stamp_ns" else F.lit(None).cast(t).alias(c) if c in ("run_id", "topic", "label") else F.col(c) for c, t in rows.dtypes]).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain_timed(df, name):
    with timed.timer_store(df.sparkSession):
        return drain(df, name)


LAG = "3 days"
later = lambda last: last + 40 * DAY


def drain_all(df, name):
    """For aggregations: every group once, written by the complete output of the last batch."""
    spark = df.sparkSession
    out, mark = scratch_path(spark, name), scratch_path(spark, name + "-mark")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(out)

    df.writeStream.outputMode("complete").option("checkpointLocation", mark).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def sides(spark, sf):
    return [stream(spark, sf).where(F.col("topic") == t).select("run_id", "stamp_ns", "seq") for t in ("view", "click")]


@case("st_sync_pairs", f"WITH {SIDES} SELECT l.run_id, l.seq AS left_seq, r.seq AS right_seq FROM l JOIN r ON l.run_id = r.run_id AND abs(l.stamp_ns - r.stamp_ns) <= {HOURS8}")
def st_sync_pairs(spark, sf):
    a, b = sides(spark, sf)
    return drain(st.sync_join(a, b, ["run_id"], HOURS8, "1 day"), "sync").select("run_id", "left_seq", "right_seq")


@case("st_sync_join", SETS_SQL)
def st_sync_join(spark, sf):
    live = replay(spark, four_sided(spark, sf), "sets-in", later)
    return drain_timed(timed.sync_sets(live, ["run_id"], "run_id bigint", SLOP4, LAG), "sets")


@case("st_nearest_odom", f"""WITH {SIDES}, p AS (SELECT l.run_id, l.seq AS left_seq, r.seq AS right_seq, abs(l.stamp_ns - r.stamp_ns) AS d, r.stamp_ns AS rt FROM l JOIN r ON l.run_id = r.run_id AND abs(l.stamp_ns - r.stamp_ns) <= {HOURS8})
  SELECT run_id, left_seq, right_seq FROM p QUALIFY row_number() OVER (PARTITION BY left_seq ORDER BY d, rt) = 1""")
def st_nearest_odom(spark, sf):
    live = replay(spark, log(spark, sf).select("run_id", "topic", "stamp_ns", "seq"), "nearest-in", later)
    a, b = (live.where(F.col("topic").eqNullSafe(t) | F.col("topic").isNull()).select("run_id", "stamp_ns", "seq") for t in ("view", "click"))
    return drain_timed(timed.nearest_live(a, b, ["run_id"], "run_id bigint", HOURS8, LAG), "nearest").where("run_id IS NOT NULL").select("run_id", "left_seq", "right_seq")


@case("st_pair_health", f"""WITH {LOG}, s AS (SELECT run_id % 10 AS run_id, CAST(floor(stamp_ns / {DAY}) AS BIGINT) * {DAY // 1000} AS start_us, topic, value FROM log),
  g AS (SELECT run_id, start_us, count(*) FILTER (topic = 'view') AS left_n, count(*) FILTER (topic = 'click') AS right_n, count(*) FILTER (topic = 'purchase') AS accepted, avg(value) FILTER (topic = 'purchase') AS m, max(value) FILTER (topic = 'purchase') AS x FROM s GROUP BY ALL)
  SELECT run_id, start_us, left_n, right_n, accepted, round(m, 6) AS mean_dt_ms, x AS max_dt_ms, CASE WHEN left_n = 0 OR right_n = 0 THEN 'missing_side' WHEN accepted = 0 THEN 'no_pairs' ELSE 'ok' END AS status FROM g""")
def st_pair_health(spark, sf):
    s = stream(spark, sf)
    side = F.when(F.col("topic") == "view", "left").when(F.col("topic") == "click", "right").when(F.col("topic") == "purchase", "pair")
    m = s.select((F.col("run_id") % 10).alias("run_id"), "stamp_ns", side.alias("side"), F.when(F.col("topic") == "purchase", F.col("value")).alias("dt_ms"))
    return drain_all(st.pair_health(m, ["run_id"], "1 day", DELAY), "health").withColumn("mean_dt_ms", r("mean_dt_ms"))


@case("st_dup_guard", f"WITH {LOG} SELECT run_id, CAST(floor(stamp_ns / {6 * HOUR}) AS BIGINT) AS stamp_ns, count(*) AS copies FROM log GROUP BY ALL HAVING count(*) > 1")
def st_dup_guard(spark, sf):
    s = stream(spark, sf).withColumn("stamp_ns", F.floor(F.col("stamp_ns") / (6 * HOUR)))
    return drain_all(st.duplicate_guard(s, ["run_id"], DELAY), "dup")


@case("st_provenance", f"""WITH {LOG}, s AS (SELECT run_id, topic, CAST(floor(stamp_ns / {6 * HOUR}) AS BIGINT) * {6 * HOUR} AS stamp_ns, seq FROM log)
  SELECT d.run_id, d.stamp_ns, d.seq FROM s d SEMI JOIN (SELECT * FROM s WHERE topic = 'view') c ON d.run_id = c.run_id AND d.stamp_ns = c.stamp_ns WHERE d.topic = 'purchase'""")
def st_provenance(spark, sf):
    """Detections whose stamp the camera has published, files out of order."""
    stamps = log(spark, sf).withColumn("stamp_ns", F.floor(F.col("stamp_ns") / (6 * HOUR)) * (6 * HOUR)).select("run_id", "topic", "stamp_ns", "seq")
    s = replay(spark, stamps, "proof-in", later)
    made, seen = (s.where(F.col("topic") == t).select("run_id", "stamp_ns", "seq") for t in ("purchase", "view"))
    return drain(st.proven(made, seen, ["run_id"], LAG), "proof")


@case("st_stamp_cache", f"WITH {LOG} SELECT DISTINCT run_id, CAST(floor(stamp_ns / {6 * HOUR}) AS BIGINT) AS stamp_ns FROM log")
def st_stamp_cache(spark, sf):
    s = stream(spark, sf).withColumn("stamp_ns", F.floor(F.col("stamp_ns") / (6 * HOUR)))
    return drain(st.known_stamps(s, ["run_id"], DELAY), "stamps")


GRACE, SILENCE = 12 * DAY, 8 * DAY


@case("st_staleness", f"""WITH {LOG}, e AS (SELECT max(stamp_ns) AS z FROM log), b AS (SELECT run_id, min(stamp_ns) AS began FROM log GROUP BY ALL),
  k AS (SELECT run_id, began, topic FROM b, (SELECT DISTINCT topic FROM log)),
  f AS (SELECT k.*, (SELECT min(stamp_ns) FROM log WHERE log.run_id = k.run_id AND log.topic = k.topic) AS first_ns FROM k),
  g AS (SELECT run_id, topic, stamp_ns AS p, coalesce(lead(stamp_ns) OVER (PARTITION BY run_id, topic ORDER BY stamp_ns), z) AS n FROM log, e),
  s AS (SELECT run_id, topic, min(p) AS last_ns FROM g WHERE n - p > {SILENCE} GROUP BY ALL),
  m AS (SELECT run_id, topic, began + {GRACE} AS due_ns FROM f, e WHERE coalesce(first_ns, z) - began > {GRACE})
  SELECT run_id, topic, 'missing' AS reason, NULL::BIGINT AS last_ns, due_ns FROM m
  UNION ALL SELECT run_id, topic, 'stale', last_ns, last_ns + {SILENCE} FROM s ANTI JOIN m USING (run_id, topic)""")
def st_staleness(spark, sf):
    messages = log(spark, sf).select("run_id", "topic", "stamp_ns", "seq", F.lit(False).alias("start"))
    began = messages.groupBy("run_id").agg(F.min("stamp_ns").alias("stamp_ns"), F.min("seq").alias("seq"))
    topics = F.explode(F.array(*[F.lit(t) for t in ("signup", "error", "purchase", "view", "click")]))
    starts = began.select("run_id", topics.alias("topic"), "stamp_ns", "seq", F.lit(True).alias("start"))
    live = replay(spark, messages.unionByName(starts), "silent-in", lambda last: last + 3 * DAY)
    return drain_timed(timed.silent_topics(live, ["run_id", "topic"], "run_id bigint, topic string", SILENCE, GRACE, LAG), "silent")


@case("st_staleness_gaps", f"""WITH {LOG}, g AS (SELECT run_id, topic, stamp_ns, lag(stamp_ns) OVER (PARTITION BY run_id, topic ORDER BY stamp_ns, seq) AS p FROM log)
  SELECT run_id, topic, arg_min(p, stamp_ns) AS last_ns, arg_min(stamp_ns - p, stamp_ns) AS gap_ns FROM g WHERE stamp_ns - p > {5 * DAY} GROUP BY ALL""")
def st_staleness_gaps(spark, sf):
    return drain(st.staleness_latch(stream(spark, sf), ["run_id", "topic"], "run_id bigint, topic string", 5 * DAY), "stale")


@case("st_motion_localization", f"WITH {LOG}, {_LATCH}, {_HEALTH}".replace("SELECT run_id, seq, bad_samples, ready", "SELECT run_id, seq, bad_samples::INTEGER AS bad_samples, ready"))
def st_motion_localization(spark, sf):
    s = stream(spark, sf).select("run_id", "stamp_ns", "seq", (F.col("value") > 150).alias("moving"), (F.col("value") < 300).alias("good"))
    return drain(st.motion_localization(s, ["run_id"], "run_id bigint", 2, 3, 2, 6 * HOUR), "loc")


@case("st_drift", f"WITH {LOG}, {_DRIFT} SELECT run_id, stamp_ns, seq, rises::INTEGER AS rises FROM c WHERE rises >= 3")
def st_drift(spark, sf):
    return drain(st.drift_alarm(stream(spark, sf), ["run_id"], "run_id bigint"), "drift")


SIGHTINGS = LOG + ", sightings AS (SELECT run_id % 20 AS run_id, topic AS label, stamp_ns, seq, value / 100 AS x, 0.0::DOUBLE AS y FROM log)"


@case("st_tracks", associate_sql(SIGHTINGS, 0.5, "CAST(k - 1 AS INTEGER) AS track, x, y"))
def st_tracks(spark, sf):
    rows = log(spark, sf).select((F.col("run_id") % 20).alias("run_id"), F.col("topic").alias("label"), "stamp_ns", "seq", (F.col("value") / 100).alias("x"), F.lit(0.0).alias("y"))
    live = replay(spark, rows, "tracks-in", later)
    return drain_timed(timed.live_tracks(live, ["run_id", "label"], "run_id bigint, label string", LAG), "tracks")


@case("st_late", f"WITH {LOG} SELECT run_id, stamp_ns, CASE WHEN value < 20 THEN 'startup' WHEN value <= 250 THEN 'exact' WHEN value <= 350 THEN 'latest' ELSE 'stale' END AS tf_class FROM log")
def st_late(spark, sf):
    latest = F.when(F.col("value") >= 20, F.col("stamp_ns") - ((F.col("value") * 100).cast("bigint") - 25000))
    s = stream(spark, sf).withColumn("latest_tf_ns", latest)
    return drain(st.late_counter(s, ["run_id"], 10000), "late")


LATE_SHIFT = "(seq * 7919 % 48) * 3600000000000"


@case("st_late_rows", f"""WITH {LOG}, e AS (SELECT min(stamp_ns) AS a, max(stamp_ns) AS b FROM log),
  c AS (SELECT run_id, stamp_ns, (stamp_ns + {LATE_SHIFT} - a) // ((b + {2 * DAY} - a) // 4 + 1) AS part FROM log, e),
  p AS (SELECT run_id, part, max(stamp_ns) AS top FROM c GROUP BY ALL),
  n AS (SELECT run_id, part, max(top) OVER (PARTITION BY run_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest_ns FROM p)
  SELECT run_id, newest_ns, count(*) AS late, max(newest_ns - stamp_ns) AS latest_slip_ns FROM c JOIN n USING (run_id, part) WHERE newest_ns - stamp_ns > {6 * HOUR} GROUP BY run_id, part, newest_ns""")
def st_late_rows(spark, sf):
    """Rows that come more than six hours behind their run, files out of order."""
    rows = log(spark, sf).select("run_id", "stamp_ns", "seq")
    live = replay(spark, rows, "late-in", shift=F.expr(LATE_SHIFT))
    return drain(st.late_rows(live, ["run_id"], "run_id bigint", 6 * HOUR), "late-rows")


@case("st_quiet_close", f"""WITH {LOG}, d AS (SELECT *, stamp_ns - lag(stamp_ns) OVER (PARTITION BY run_id ORDER BY stamp_ns) AS g FROM log), i AS (SELECT *, sum(CASE WHEN g IS NULL OR g >= {DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY stamp_ns) AS s FROM d)
  SELECT run_id, (min(stamp_ns) // 1000)::BIGINT AS start_us, count(*) AS messages, max(stamp_ns) AS last_ns FROM i GROUP BY run_id, s""")
def st_quiet_close(spark, sf):
    return drain_all(st.quiet_sessions(stream(spark, sf), ["run_id"], "1 day", DELAY), "quiet")


@case("st_commit_once", f"WITH {LOG} SELECT run_id, seq, value FROM log")
def st_commit_once(spark, sf):
    root, mark = scratch_path(spark, "commit"), scratch_path(spark, "commit-mark")
    s = stream(spark, sf).select("run_id", "seq", "value")
    write = batch_committer(root, "survey-7")

    def twice(df, batch_id):
        write(df, batch_id)
        write(df, batch_id)  # the replay of a batch is refused

    s.writeStream.option("checkpointLocation", mark).trigger(availableNow=True).foreachBatch(twice).start().awaitTermination()
    return read_committed(spark, root)


@case("snk_commit_once", f"WITH {LOG} SELECT run_id, topic, count(*) AS n FROM log GROUP BY ALL")
def snk_commit_once(spark, sf):
    root = scratch_path(spark, "publish")
    out = log(spark, sf).groupBy("run_id", "topic").agg(F.count("*").alias("n"))
    commit_once(out, root, "token-a")
    commit_once(out, root, "token-a")
    commit_once(out, root, "token-b", violations=out)
    return read_committed(spark, root)
