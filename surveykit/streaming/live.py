"""Structured Streaming forms of the live rules."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from surveykit.streaming.shards import dealt, packed, undealt, unpacked


def event_time(ns: Column) -> Column:
    """Timestamp for watermarks only; joins and equality stay on the nanosecond integer."""
    # integer division: a double cannot hold today's nanosecond stamps
    return F.timestamp_micros(F.call_function("div", ns, F.lit(1000)))


def stamped(df: DataFrame, delay: str, ns: str = "stamp_ns", out: str = "ts") -> DataFrame:
    return df.withColumn(out, event_time(F.col(ns))).withWatermark(out, delay)


def sync_join(left: DataFrame, right: DataFrame, keys: Sequence[str], slop_ns: int, delay: str) -> DataFrame:
    """Stream-stream inner join with ``|dt| <= slop``; both watermarks bound the kept state.

    The equi key contains a time bucket, so one busy run is spread over many state partitions.
    """
    w = max(1, slop_ns)
    l = stamped(left, delay, out="l_ts").select(*keys, "l_ts", F.col("stamp_ns").alias("left_ns"), F.col("seq").alias("left_seq"))
    l = l.withColumn("_b", F.explode(F.sequence(F.floor((F.col("left_ns") - slop_ns) / w), F.floor((F.col("left_ns") + slop_ns) / w))))
    r = stamped(right, delay, out="r_ts").select(*[F.col(k).alias(f"r_{k}") for k in keys], "r_ts", F.col("stamp_ns").alias("right_ns"), F.col("seq").alias("right_seq"))
    r = r.withColumn("r_b", F.floor(F.col("right_ns") / w))
    same = F.col("_b") == F.col("r_b")
    for k in keys:
        same = same & (F.col(k) == F.col(f"r_{k}"))
    seconds = slop_ns / 1e9 + 0.001
    span = F.expr(f"r_ts BETWEEN l_ts - INTERVAL {seconds} SECONDS AND l_ts + INTERVAL {seconds} SECONDS")
    near = F.abs(F.col("left_ns") - F.col("right_ns")) <= slop_ns
    return l.join(r, same & span & near).select(*keys, "left_seq", "right_seq", "left_ns", "right_ns")


def pair_health(pairs: DataFrame, keys: Sequence[str], window: str, delay: str) -> DataFrame:
    """Per tumbling window: left, right, accepted, mean and max offset, and a status.

    ``pairs`` is one stream of messages with ``side`` left, right or pair and ``dt_ms`` on pairs. One
    aggregation serves all counts.
    """
    t = stamped(pairs, delay)
    g = t.groupBy(F.window("ts", window).alias("w"), *keys).agg(
        F.count_if(F.col("side") == "left").alias("left_n"),
        F.count_if(F.col("side") == "right").alias("right_n"),
        F.count_if(F.col("side") == "pair").alias("accepted"),
        F.avg("dt_ms").alias("mean_dt_ms"),
        F.max("dt_ms").alias("max_dt_ms"),
    )
    status = F.when((F.col("left_n") == 0) | (F.col("right_n") == 0), "missing_side").when(F.col("accepted") == 0, "no_pairs").otherwise("ok")
    return g.select(*keys, F.unix_micros(F.col("w.start")).alias("start_us"), "left_n", "right_n", "accepted", "mean_dt_ms", "max_dt_ms", status.alias("status"))


def duplicate_guard(messages: DataFrame, keys: Sequence[str], delay: str) -> DataFrame:
    """Stamps that arrive more than once inside the watermark, as violations (nothing is dropped)."""
    t = stamped(messages, delay)
    # the event time is part of the key, so state leaves with the watermark
    g = t.groupBy(*keys, "stamp_ns", "ts").agg(F.count("*").alias("copies"))
    return g.where("copies > 1").select(*keys, "stamp_ns", "copies")


def known_stamps(messages: DataFrame, keys: Sequence[str], delay: str) -> DataFrame:
    """Each camera stamp once; the proof list for later joins, bounded by the watermark."""
    return stamped(messages, delay).dropDuplicatesWithinWatermark([*keys, "stamp_ns"]).select(*keys, "stamp_ns")


def proven(rows: DataFrame, messages: DataFrame, keys: Sequence[str], delay: str) -> DataFrame:
    """Rows whose stamp a message of the same key carries: a stream-stream semi join on the exact stamp.

    Both watermarks bound the state; a stamp proves rows that come before and after it, as often as they come.
    """
    stamp = [*keys, "stamp_ns"]
    left = stamped(rows, delay, out="l_ts")
    right = stamped(messages, delay, out="r_ts").select(*[F.col(c).alias(f"r_{c}") for c in stamp], "r_ts")
    same = F.expr("l_ts = r_ts")
    for c in stamp:
        same = same & (F.col(c) == F.col(f"r_{c}"))
    return left.join(right, same, "left_semi").drop("l_ts")


def late_rows(messages: DataFrame, keys: Sequence[str], key_ddl: str, allowed_ns: int) -> DataFrame:
    """Counter of late rows: per key and micro-batch that has any, ``newest_ns`` before it, ``late`` and ``latest_slip_ns``.

    A row is late when it lies more than ``allowed_ns`` behind the newest stamp of its key in earlier micro-batches. The
    engine's watermark drops such rows without a trace; this side output sees the stream before it, and keeps one number
    per key.
    """

    def run(shard, batches, state: GroupState):
        rows = pd.concat(list(batches))[["key", "stamp_ns"]]
        known = dict(zip(*[c.to_pylist() for c in unpacked(bytes(state.get[0])).columns], strict=True)) if state.exists else {}
        of, found = pd.factorize(rows["key"])
        stamps = rows["stamp_ns"].to_numpy(np.int64)
        top = np.full(len(found), np.iinfo(np.int64).min)
        np.maximum.at(top, of, stamps)
        seen = np.array([k in known for k in found], bool)
        newest = np.array([known.get(k, 0) for k in found], np.int64)
        slip = newest[of] - stamps
        late = seen[of] & (slip > allowed_ns)
        number = np.bincount(of[late], minlength=len(found))
        far = np.zeros(len(found), np.int64)
        np.maximum.at(far, of[late], slip[late])
        hit = number > 0
        known.update(zip(found, np.where(seen, np.maximum(newest, top), top).tolist(), strict=True))
        state.update((packed(pa.table({"key": pa.array(known.keys(), pa.string()), "newest": pa.array(known.values(), pa.int64())})),))
        yield pd.DataFrame({"key": np.asarray(found, object)[hit], "newest_ns": newest[hit], "late": number[hit].astype(np.int64), "latest_slip_ns": far[hit]})

    out = dealt(messages, keys, "stamp_ns").groupBy("shard").applyInPandasWithState(
        run, "key string, newest_ns bigint, late bigint, latest_slip_ns bigint", "newest binary", "append", GroupStateTimeout.NoTimeout
    )
    return undealt(out, key_ddl)


def late_counter(messages: DataFrame, keys: Sequence[str], tolerance_ns: int) -> DataFrame:
    """Split by slip against the newest transform: used as is, replaced by the latest, or dropped."""
    slip = F.col("stamp_ns") - F.col("latest_tf_ns")
    klass = F.when(F.col("latest_tf_ns").isNull(), "startup").when(slip <= 0, "exact").when(slip <= tolerance_ns, "latest").otherwise("stale")
    return messages.select(*keys, "stamp_ns", klass.alias("tf_class"))


def quiet_sessions(messages: DataFrame, keys: Sequence[str], gap: str, delay: str) -> DataFrame:
    """Activity sessions that close after ``gap`` without a message."""
    t = stamped(messages, delay)
    g = t.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("messages"), F.max("stamp_ns").alias("last_ns"))
    return g.select(*keys, F.unix_micros(F.col("w.start")).alias("start_us"), "messages", "last_ns")


# ---------------------------------------------------------------- state per key


def _ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one key and micro-batch in stamp order (micro-batches bound their number)."""
    frames = [b for b in batches if len(b)]
    if frames:
        yield pd.concat(frames).sort_values(["stamp_ns", "seq"], kind="stable")


def _since(marks: np.ndarray, carried: float) -> np.ndarray:
    """Rows since the last mark, the marked row being 0; before the first mark ``carried`` rows count too."""
    at = np.arange(len(marks))
    last = np.maximum.accumulate(np.where(marks, at, -1))
    return np.where(last >= 0, at - last, at + 1 + carried)


def _latest(values: np.ndarray, there: np.ndarray, carried: float) -> np.ndarray:
    """The newest value that is there, up to each row; ``carried`` (or nan) before the first."""
    last = np.maximum.accumulate(np.where(there, np.arange(len(values)), -1))
    return np.where(last >= 0, values[np.maximum(last, 0)], carried)


def drift_alarm(distances: DataFrame, keys: Sequence[str], key_ddl: str, required: int = 3, min_step: float = 0.04) -> DataFrame:
    """Rows that end ``required`` rises in a row or more; state is the last value and the rises so far.

    A row rises when the row before it has a distance too and lies ``min_step`` or more below. The rises
    at a row are the rows since the last one that did not rise.
    """

    def run(key, batches, state: GroupState):
        for pdf in _ordered(batches):
            before, rises = state.get if state.exists else (float("nan"), 0)
            v = pdf["value"].to_numpy(np.float64, na_value=np.nan)
            v = np.where(np.isfinite(v) & (v >= 0), v, np.nan)
            step = np.diff(v, prepend=before)
            count = _since(~(step >= min_step), rises)
            state.update((float(v[-1]), int(count[-1])))
            hit = count >= required
            out = pdf.loc[hit, ["stamp_ns", "seq"]].assign(rises=count[hit].astype(np.int32))
            yield out.assign(**dict(zip(keys, key, strict=True)))[[*keys, "stamp_ns", "seq", "rises"]]

    return distances.groupBy(*keys).applyInPandasWithState(
        run, f"{key_ddl}, stamp_ns bigint, seq bigint, rises int", "prev double, cnt int", "append", GroupStateTimeout.NoTimeout
    )


def staleness_latch(messages: DataFrame, keys: Sequence[str], key_ddl: str, timeout_ns: int) -> DataFrame:
    """First gap above the timeout per key. The failure is terminal: later messages never clear it."""

    def run(shard, batches, state: GroupState):
        names = ("key", "last", "failed")
        known = {k: (last, failed) for k, last, failed in zip(*[c.to_pylist() for c in unpacked(bytes(state.get[0])).columns], strict=True)} if state.exists else {}
        out = []
        for pdf in _ordered(batches):
            for key, t in zip(pdf["key"].tolist(), pdf["stamp_ns"].tolist(), strict=True):
                last, failed = known.get(key, (None, False))
                if failed or (last is not None and t <= last):
                    continue  # a repeated or backward stamp does not refresh
                if last is not None and t - last > timeout_ns:
                    known[key] = (last, True)
                    out.append((key, last, t - last))
                else:
                    known[key] = (t, False)
        rows = ([*known], [v[0] for v in known.values()], [v[1] for v in known.values()])
        state.update((packed(pa.table([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int64(), pa.bool_()), strict=True)], names=names)),))
        yield pd.DataFrame(out, columns=["key", "last_ns", "gap_ns"])

    out = dealt(messages, keys, "stamp_ns", "seq").groupBy("shard").applyInPandasWithState(
        run, "key string, last_ns bigint, gap_ns bigint", "known binary", "append", GroupStateTimeout.NoTimeout
    )
    return undealt(out, key_ddl)


def motion_localization(samples: DataFrame, keys: Sequence[str], key_ddl: str, confirm: int, stable: int, bad_limit: int, timeout_ns: int) -> DataFrame:
    """Bad samples in a row, ready latch and health per sample (``moving``, ``good``).

    Motion is confirmed on a sample with ``confirm`` moving ones in a row. Bad samples count from the last
    good one or from the start of a motion, whichever is later. Ready stays once ``stable`` good samples came
    in a row. A ready key is healthy while a good sample is recent, without motion, or while neither the bad
    samples nor the time since the last good sample or start of motion exceed their limits. State is the
    lengths of the runs at the end of a micro-batch and the two newest stamps.
    """

    def run(key, batches, state: GroupState):
        for pdf in _ordered(batches):
            still_n, calm_n, good_n, ready, good_at, start_at = state.get if state.exists else (0, 0, 0, False, None, None)
            moves, good = (pdf[c].to_numpy(bool) for c in ("moving", "good"))
            t = pdf["stamp_ns"].to_numpy(np.int64)
            in_motion = _since(~moves, still_n)
            start, moving = in_motion == confirm, in_motion >= confirm
            # a start is like a good sample that lies just before its own row
            bad = np.where(good, 0, np.minimum(_since(good, calm_n), _since(start, np.inf) + 1)).astype(np.int64)
            run_good = _since(~good, good_n)
            latched = ready | np.logical_or.accumulate(run_good >= stable)
            # stamps are kept as places in the batch, the carried ones before it, so that they stay exact
            stamps = np.concatenate([[-1 if start_at is None else start_at, -1 if good_at is None else good_at], t])
            place = np.arange(2, len(stamps))
            at_good = _latest(place, good, 1).astype(int)
            at_start = np.where(moving, _latest(place, start, 0), 0).astype(int)
            known_good = (at_good > 1) | (good_at is not None)
            known_start = moving & ((at_start > 1) | (start_at is not None))
            recent = known_good & (t - stamps[at_good] <= timeout_ns)
            ref = np.maximum(np.where(known_good, stamps[at_good], np.iinfo(np.int64).min), np.where(known_start, stamps[at_start], np.iinfo(np.int64).min))
            within = (known_good | known_start) & (t - np.where(known_good | known_start, ref, t) <= timeout_ns)
            healthy = latched & (recent | ~moving | ((bad < bad_limit) & within))
            state.update((
                int(in_motion[-1]), int(bad[-1]), int(run_good[-1]), bool(latched[-1]),
                int(stamps[at_good[-1]]) if known_good[-1] else None, int(stamps[at_start[-1]]) if known_start[-1] else None,
            ))
            out = pdf[["seq"]].assign(bad_samples=bad.astype(np.int32), ready=latched, healthy=healthy)
            yield out.assign(**dict(zip(keys, key, strict=True)))[[*keys, "seq", "bad_samples", "ready", "healthy"]]

    return samples.groupBy(*keys).applyInPandasWithState(
        run,
        f"{key_ddl}, seq bigint, bad_samples int, ready boolean, healthy boolean",
        "in_motion int, bad_n int, good_n int, ready boolean, good_at bigint, start_at bigint",
        "append",
        GroupStateTimeout.NoTimeout,
    )
