"""Run summaries and ordered rules over time-stamped logs.

A scan reads its input twice (rows and bucket summaries). Rules that chain scans cut the lineage
between them, so the work grows with the number of scans and not with its power of two.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from surveykit.functions.geometry import angle_delta, hypot2, is_finite
from surveykit.operators.folding import fold
from surveykit.operators.ordered import BUCKET, Step, Timeline, islands, scan, with_halo
from surveykit.operators.quantile import group_percentiles
from surveykit.session import settle

# ---------------------------------------------------------------- run summaries


def topic_counts(messages: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Messages per topic with the duration of the whole run in seconds."""
    keys = list(keys)
    per_topic = messages.groupBy(*keys, "topic").agg(
        F.count("*").alias("n"), F.min("stamp_ns").alias("_a"), F.max("stamp_ns").alias("_b")
    )
    span = per_topic.groupBy(*keys).agg(((F.max("_b") - F.min("_a")) / 1e9).alias("duration_s"))
    return per_topic.join(span, keys).select(*keys, "topic", "n", "duration_s")


def pose_motion(poses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First and last pose in arrival order, displacement, yaw change and count."""
    at = F.struct("bag_ns", "seq")
    pose = F.struct("x", "y", "yaw")
    ends = poses.groupBy(*keys).agg(
        F.min_by(pose, at).alias("a"), F.max_by(pose, at).alias("b"), F.count("*").alias("samples")
    )
    return ends.select(
        *keys,
        F.col("a.x").alias("first_x"),
        F.col("a.y").alias("first_y"),
        F.col("b.x").alias("last_x"),
        F.col("b.y").alias("last_y"),
        hypot2(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")).alias("translation_m"),
        angle_delta(F.col("b.yaw"), F.col("a.yaw")).alias("yaw_change_rad"),
        "samples",
    )


def command_summary(cmd: DataFrame, keys: Sequence[str]) -> DataFrame:
    live = (F.abs("vx") > 1e-9) | (F.abs("wz") > 1e-9)
    t = F.when(live, F.col("stamp_ns"))
    return cmd.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.count_if(live).alias("nonzero_samples"),
        F.max(F.abs("vx")).alias("max_abs_linear"),
        F.max(F.abs("wz")).alias("max_abs_angular"),
        F.coalesce((F.max(t) - F.min(t)) / 1e9, F.lit(0.0)).alias("nonzero_span_s"),
    )


def minmax(values: DataFrame, keys: Sequence[str], topics: DataFrame) -> DataFrame:
    """Count, min and max per expected topic; zeros for a topic without messages."""
    got = values.groupBy(*keys).agg(F.count("*").alias("samples"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return topics.join(got, list(keys), "left").select(
        *topics.columns,
        F.coalesce("samples", F.lit(0)).alias("samples"),
        F.coalesce("lo", F.lit(0.0)).alias("min_value"),
        F.coalesce("hi", F.lit(0.0)).alias("max_value"),
    )


def scan_quality(scans: DataFrame, keys: Sequence[str], valid: Column) -> DataFrame:
    """Scan count, distinct points-per-scan, share of valid returns and the smallest return."""
    s = scans.withColumn("_v", valid).withColumn("_n", F.size("ranges"))
    return s.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.count_distinct("_n").alias("n_sizes"),
        F.min("_n").alias("points_min"),
        F.max("_n").alias("points_max"),
        F.try_divide(F.sum(F.size("_v")), F.sum("_n")).alias("valid_ratio"),
        F.min(F.array_min("_v")).alias("minimum_range_m"),
    )


def map_delta(grids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``grids`` has one row per grid cell and snapshot; counts per first and last snapshot."""
    v = F.col("value")
    per = grids.groupBy(*keys, "stamp_ns").agg(
        F.count_if((v >= 0) & (v < 50)).alias("free"), F.count_if(v >= 50).alias("occupied")
    )
    both = F.struct("free", "occupied")
    ends = per.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.min_by(both, "stamp_ns").alias("a"), F.max_by(both, "stamp_ns").alias("b")
    )
    known = lambda s: F.col(f"{s}.free") + F.col(f"{s}.occupied")
    return ends.select(
        *keys,
        "samples",
        F.col("a.free").alias("first_free"),
        F.col("a.occupied").alias("first_occupied"),
        F.col("b.free").alias("last_free"),
        F.col("b.occupied").alias("last_occupied"),
        (known("b") - known("a")).alias("known_delta"),
    )


def distinct_values(values: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Distinct values as rows (not as one array: their number is not bounded)."""
    return values.select(*keys, value).distinct()


def first_last(values: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """First, last, min, max of each field and the sample count."""
    at = F.struct("bag_ns", "seq")
    aggs: list[Column] = [F.count("*").alias("samples")]
    for f in fields:
        aggs += [
            F.min_by(f, at).alias(f"first_{f}"),
            F.max_by(f, at).alias(f"last_{f}"),
            F.min(f).alias(f"min_{f}"),
            F.max(f).alias(f"max_{f}"),
        ]
    return values.groupBy(*keys).agg(*aggs)


def pair_stats(pairs: DataFrame, left_counts: DataFrame, keys: Sequence[str], method: str = "nearest") -> DataFrame:
    """Accepted share and median, p95, max of the offset in ms (nearest rank or linear)."""
    keys = list(keys)
    ms = pairs.withColumn("_ms", F.col("abs_dt_ns") / 1e6)
    q = group_percentiles(ms, keys, "_ms", {"median_dt_ms": 0.5, "p95_dt_ms": 0.95, "max_dt_ms": 1.0}, method)
    return left_counts.join(q, keys, "left").select(
        *keys,
        F.col("left_n"),
        F.coalesce("n", F.lit(0)).alias("pairs"),
        F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)), F.col("left_n")), F.lit(0.0)).alias("left_acceptance"),
        "median_dt_ms",
        "p95_dt_ms",
        "max_dt_ms",
    )


# ---------------------------------------------------------------- windows


def step_detect(
    series: DataFrame,
    keys: Sequence[str],
    value: str,
    reach: int,
    min_count: int = 5,
    min_step: float = 2.0,
    width: int | None = None,
) -> DataFrame:
    """Largest jump between the median of ``(t, t+reach]`` and of ``(t-reach, t]``.

    Rows are copied into the buckets they can influence, so the range frames run per bucket.
    """
    line = Timeline(tuple(keys), ("stamp_ns",), width or reach * 4)
    cut = with_halo(series, line, reach, reach)
    w = W.partitionBy(*keys, BUCKET).orderBy("stamp_ns")
    pre, post = w.rangeBetween(-(reach - 1), 0), w.rangeBetween(1, reach)
    mid = lambda frame: F.percentile(value, F.lit(0.5)).over(frame)
    seen = cut.select(
        *keys,
        "stamp_ns",
        "_home",
        mid(pre).alias("_pre"),
        mid(post).alias("_post"),
        F.count(value).over(pre).alias("_n0"),
        F.count(value).over(post).alias("_n1"),
    ).where(F.col("_home") & (F.col("_n0") >= min_count) & (F.col("_n1") >= min_count))
    diff = F.col("_post") - F.col("_pre")
    best = seen.select(*keys, "stamp_ns", diff.alias("diff")).groupBy(*keys).agg(
        F.max_by(F.struct("stamp_ns", "diff"), F.struct(F.abs("diff"), -F.col("stamp_ns"))).alias("b")
    )
    return best.select(
        *keys,
        F.col("b.stamp_ns").alias("step_ns"),
        F.col("b.diff").alias("step"),
        (F.abs("b.diff") > min_step).alias("reported"),
    )


def edge_quantile(series: DataFrame, keys: Sequence[str], value: str, share: float = 0.2) -> DataFrame:
    """Medians of the first and of the last ``share`` of the time axis (open ends)."""
    keys = list(keys)
    cuts = group_percentiles(series, keys, "stamp_ns", {"_q1": share, "_q2": 1.0 - share}).drop("n")
    with_cut = series.join(cuts, keys)
    part = F.when(F.col("stamp_ns") < F.col("_q1"), "head").when(F.col("stamp_ns") > F.col("_q2"), "tail")
    tagged = with_cut.withColumn("part", part).where("part is not null")
    med = group_percentiles(tagged, [*keys, "part"], value, {"m": 0.5})
    return med.groupBy(*keys).agg(
        F.max(F.when(F.col("part") == "head", F.col("m"))).alias("head_median"),
        F.max(F.when(F.col("part") == "tail", F.col("m"))).alias("tail_median"),
    )


def drift(series: DataFrame, line: Timeline, value: str, required: int = 3, min_step: float = 0.04) -> DataFrame:
    """``drifting`` after ``required`` consecutive rises of at least ``min_step``.

    A non-finite or negative sample forgets the previous value and the count.
    """
    v = F.col(value)
    ok = is_finite(v) & (v >= 0)
    a = scan(series, line, [Step("_prev", "lag", F.when(ok, v))])
    rise = ok & F.col("_prev").isNotNull() & (v - F.col("_prev") >= min_step)
    rise = F.coalesce(rise, F.lit(False))
    run = islands(settle(a.withColumn("_rise", rise)), line, ~F.col("_rise"), "_run")
    return consecutive(settle(run), line, F.col("_rise"), "_run", "rises").withColumn(
        "drifting", F.col("rises") >= required
    ).drop("_prev", "_rise", "_run")


def consecutive(df: DataFrame, line: Timeline, flag: Column, run: str, out: str) -> DataFrame:
    """Number of consecutive true rows up to this one, given islands that restart on every false row."""
    longer = Timeline((*line.keys, run), line.order, line.width)
    return scan(df, longer, [Step(out, "sum", F.when(flag, 1).otherwise(0))])


def motion_latch(series: DataFrame, line: Timeline, moving: Column, confirm: int) -> DataFrame:
    """Debounced motion: ``confirm`` moving samples in a row set it, one still sample clears it."""
    a = series.withColumn("_m", F.coalesce(moving, F.lit(False)))
    a = settle(islands(a, line, ~F.col("_m"), "_run"))
    a = settle(consecutive(a, line, F.col("_m"), "_run", "hits"))
    need = max(1, confirm)
    a = a.withColumn("robot_moving", F.col("hits") >= need)
    longer = Timeline((*line.keys, "_run"), line.order, line.width)
    first = F.when(F.col("hits") == need, F.col(line.order[0]))
    a = scan(a, longer, [Step("motion_started", "last", first)])
    return a.drop("_m", "_run")


def localization_health(
    samples: DataFrame,
    line: Timeline,
    good: Column,
    moving: Column,
    motion_started: Column,
    stable: int,
    bad_limit: int,
    timeout: int,
) -> DataFrame:
    """Ready latch, bad-sample run and last good age, combined into the steady-state rule.

    The bad run restarts on a good sample and when motion begins.
    """
    t = F.col(line.order[0])
    a = settle(samples).withColumn("_g", F.coalesce(good, F.lit(False))).withColumn("_mv", F.coalesce(moving, F.lit(False)))
    a = a.withColumn("_ms", motion_started)
    a = scan(
        a,
        line,
        [
            Step("_was", "lag", F.col("_mv")),
            Step("_bad_runs", "sum", F.when(~F.col("_g"), 1).otherwise(0)),
            Step("_good_runs", "sum", F.when(F.col("_g"), 1).otherwise(0)),
            Step("last_good", "last", F.when(F.col("_g"), t)),
        ],
    )
    a = settle(a)
    onset = F.col("_mv") & ~F.coalesce(F.col("_was"), F.lit(False))
    # counts since the last reset = running count minus the count held at the reset
    at_reset = F.when(F.col("_g"), F.col("_bad_runs")).when(onset, F.col("_bad_runs") - F.when(F.col("_g"), 0).otherwise(1))
    a = scan(
        a,
        line,
        [
            Step("_bad0", "last", at_reset),
            Step("_good0", "last", F.when(~F.col("_g"), F.col("_good_runs"))),
        ],
    )
    a = settle(a)
    a = a.withColumn("bad_samples", F.col("_bad_runs") - F.coalesce("_bad0", F.lit(0)))
    a = a.withColumn("_stable", F.col("_good_runs") - F.coalesce("_good0", F.lit(0)))
    a = scan(a, line, [Step("_ready", "max", F.when(F.col("_stable") >= stable, 1).otherwise(0))])
    recent = F.coalesce(t - F.col("last_good") <= timeout, F.lit(False))
    ref = F.greatest("last_good", "_ms")
    healthy = (
        F.when(F.col("_ready") == 0, False)
        .when(recent, True)
        .when(~F.col("_mv"), True)
        .when(F.col("bad_samples") >= bad_limit, False)
        .otherwise(F.coalesce(t - ref <= timeout, F.lit(False)))
    )
    a = a.withColumn("ready", F.col("_ready") == 1).withColumn("healthy", healthy)
    return a.drop("_g", "_mv", "_ms", "_was", "_bad_runs", "_good_runs", "_bad0", "_good0", "_stable", "_ready")


def stationary(series: DataFrame, line: Timeline, moving: Column, settle_ns: int) -> DataFrame:
    """Time since the robot stands still and whether it stood for ``settle_ns``."""
    t = F.col(line.order[0])
    a = series.withColumn("_m", F.coalesce(moving, F.lit(True)))
    a = settle(scan(a, line, [Step("_was", "lag", F.col("_m"))]))
    began = F.when(~F.col("_m") & F.coalesce(F.col("_was"), F.lit(True)), t)
    a = scan(a, line, [Step("_since", "last", began)])
    since = F.when(~F.col("_m"), F.col("_since"))
    return a.withColumn("stationary_since", since).withColumn(
        "settled", F.coalesce(t - since >= settle_ns, F.lit(False))
    ).drop("_m", "_was", "_since")


def phase_done(samples: DataFrame, keys: Sequence[str], target: float, timeout_ns: int, turn: bool = False) -> DataFrame:
    """First sample of a phase whose displacement (or turn) from the phase start reaches ``target``.

    ``samples`` has stamp_ns, seq, x, y, yaw per phase key. Plain aggregates: the start pose comes
    from ``min_by``, then one join and one ``min``.
    """
    keys = list(keys)
    at = F.struct("stamp_ns", "seq")
    start = samples.groupBy(*keys).agg(F.min_by(F.struct("stamp_ns", "x", "y", "yaw"), at).alias("s"))
    moved = (
        F.abs(angle_delta(F.col("yaw"), F.col("s.yaw")))
        if turn
        else hypot2(F.col("x") - F.col("s.x"), F.col("y") - F.col("s.y"))
    )
    rel = samples.join(start, keys).withColumn("_hit", moved >= target)
    hit = rel.groupBy(*keys).agg(
        F.min(F.when(F.col("_hit"), at)).alias("_at"), F.min("s.stamp_ns").alias("_t0"), F.max("stamp_ns").alias("_t1")
    )
    counted = (
        rel.select(*keys, at.alias("_p"))
        .join(hit.select(*keys, "_at"), keys)
        .groupBy(*keys)
        .agg(F.count_if(F.col("_at").isNull() | (F.col("_p") <= F.col("_at"))).alias("samples"))
    )
    out = hit.join(counted, keys)
    done_ns = F.col("_at.stamp_ns") - F.col("_t0")
    in_time = F.coalesce(done_ns < timeout_ns, F.lit(False))
    outcome = F.when(in_time, "complete").when(
        F.coalesce(done_ns, F.col("_t1") - F.col("_t0")) >= timeout_ns, "timeout"
    ).otherwise("open")
    return out.select(*keys, "samples", (F.coalesce(done_ns, F.col("_t1") - F.col("_t0")) / 1e9).alias("elapsed_s"), outcome.alias("outcome"))


def staleness(messages: DataFrame, line: Timeline, timeout: int) -> DataFrame:
    """Gap to the previous message of the same key and whether it exceeds the timeout."""
    t = F.col(line.order[0])
    a = scan(messages, line, [Step("_prev", "lag", t)])
    gap = t - F.col("_prev")
    return a.withColumn("gap_ns", gap).withColumn("stale", F.coalesce(gap > timeout, F.lit(False))).drop("_prev")


def stamp_advance(messages: DataFrame, line: Timeline, stamp: str) -> DataFrame:
    """Arrival-ordered messages whose stamp is not above everything seen before (null stamp: no)."""
    a = scan(messages, line, [Step("_top", "max_prev", F.col(stamp))])
    ok = F.col(stamp).isNotNull() & (F.col("_top").isNull() | (F.col(stamp) > F.col("_top")))
    return a.withColumn("advances", ok).drop("_top")


def duplicate_stamps(messages: DataFrame, keys: Sequence[str], stamp: str = "stamp_ns") -> DataFrame:
    """Stamps that occur more than once or are not positive, as an aggregate (no wide window)."""
    g = messages.groupBy(*keys, stamp).agg(F.count("*").alias("copies"))
    reason = F.when(F.col(stamp) <= 0, "nonpositive").when(F.col("copies") > 1, "duplicate")
    return g.withColumn("violation", reason).where("violation is not null")


def size_drift(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames whose size differs from the first frame of their run."""
    keys = list(keys)
    first = frames.groupBy(*keys).agg(F.min_by(F.struct("w", "h"), F.struct("stamp_ns", "seq")).alias("_f"))
    bad = (F.col("w") != F.col("_f.w")) | (F.col("h") != F.col("_f.h"))
    return frames.join(first, keys).where(bad).drop("_f")


def stride(messages: DataFrame, line: Timeline, n: int) -> DataFrame:
    """Every n-th message in order, starting with the first."""
    a = scan(messages, line, [Step("_i", "sum", F.lit(1))])
    return a.where((F.col("_i") - 1) % n == 0).drop("_i")


def _thin(limit: float):
    def step(rows: list[tuple], state: list[float]) -> tuple[list[tuple], list[float]]:
        last, out = tuple(state), []
        for t, q, x, y in rows:
            if not last or math.hypot(x - last[0], y - last[1]) >= limit:
                out.append((t, q, x, y))
                last = (x, y)
        return out, list(last)

    return step


def pose_thin(poses: DataFrame, keys: Sequence[str], step_m: float, width: int) -> DataFrame:
    """Keep a pose when it lies at least ``step_m`` from the last kept pose."""
    line = Timeline(tuple(keys), ("stamp_ns", "seq"), width)
    return fold(poses, line, _thin(step_m), ["stamp_ns bigint", "seq bigint", "x double", "y double"], ["x", "y"])


def arrivals(poses: DataFrame, goals: DataFrame, keys: Sequence[str], radius: float = 0.28) -> DataFrame:
    """First stamp within ``radius`` (inclusive) of each goal of the run, by a join on grid cells."""
    from surveykit.operators.spatial import radius_join

    keys = list(keys)
    # goals are copied to the cells they reach, poses stay in theirs
    hit = radius_join(goals, poses, keys, radius, px="gx", py="gy", tx="x", ty="y")
    return hit.groupBy(*keys, "goal").agg(F.min("stamp_ns").alias("arrived_ns"), F.count("*").alias("samples_inside"))


def command_age(cmds: DataFrame, cycles: DataFrame, keys: Sequence[str], timeout: int, width: int) -> DataFrame:
    """Stop decision per control cycle from the newest command and a safety flag.

    Uses the as-of kernel; a missing, negative or too old command, or an active stop, stops the base.
    """
    from surveykit.operators.asof import neighbours

    both = neighbours(cycles, cmds, keys, ["vx"], width)
    age = F.col("stamp_ns") - F.col("before.stamp")
    stop = age.isNull() | (age < 0) | (age >= timeout) | F.col("safety_stop")
    v = F.col("before.vx")
    stopped = stop | ~is_finite(v)
    return both.select(
        *cycles.columns, age.alias("age_ns"), stopped.alias("stopped"), F.when(stopped, 0.0).otherwise(v).alias("vx")
    )
