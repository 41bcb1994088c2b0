"""Rules of live streams that follow event time: rows wait for the watermark, and timers speak for silence.

A processor keeps rows of its key until the watermark has passed them and then takes them in (stamp, seq) order, so the
result does not depend on how rows were dealt over micro-batches. An event-time timer wakes a key that gets no more
rows. State is bounded by the watermark's delay: what is waiting, and a few numbers.

Timers need the RocksDB state store, see ``timer_store``.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from surveykit.operators.asof import SIDES4, span_sets
from surveykit.operators.association import radius_of
from surveykit.operators.fusion import _Track
from surveykit.streaming.live import event_time
from surveykit.streaming.shards import dealt, packed, undealt, unpacked

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PARTS = "spark.sql.shuffle.partitions"
#: parts of the state per core
WAVES = 3
_MS = 1_000_000
NEVER = np.iinfo(np.int64).max


@contextmanager
def timer_store(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which timers, lists and maps of state need.

    Their state has at most ``WAVES`` parts per core: each part starts a Python worker's state of its own in every
    micro-batch, however few rows it gets. A checkpoint keeps the number it began with.
    """
    parts = min(int(spark.conf.get(_PARTS)), WAVES * spark.sparkContext.defaultParallelism)
    before = {name: spark.conf.get(name) for name in (_STORE, _PARTS)}
    try:
        spark.conf.set(_STORE, _ROCKS)
        spark.conf.set(_PARTS, parts)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _timed(df: DataFrame, delay: str) -> DataFrame:
    return df.withColumn("ts", event_time(F.col("stamp_ns"))).withWatermark("ts", delay)


def _passed(timer_values) -> int:
    """Nanoseconds up to which rows are complete (whole microseconds at the watermark, as Spark judges late rows)."""
    return timer_values.getCurrentWatermarkInMs() * _MS + 999


class _Woken(StatefulProcessor):
    """Keeps one timer per key, at the next stamp where something can happen, and runs ``advance`` on rows and timers."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def advance(self, key: tuple, new: pd.DataFrame | None, passed: int) -> tuple[pd.DataFrame, int]:
        """Result rows, and the stamp to wake up at (``NEVER``: none)."""
        raise NotImplementedError

    def _run(self, key: tuple, new: pd.DataFrame | None, passed: int) -> Iterator[pd.DataFrame]:
        out, wake = self.advance(key, new, passed)
        at = wake // _MS
        for timer in list(self.handle.listTimers()):
            if timer != at:
                self.handle.deleteTimer(timer)
        if wake != NEVER:
            self.handle.registerTimer(at)
        yield out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        return self._run(key, pd.concat(list(rows)), _passed(timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._run(key, None, _passed(timerValues))

    def close(self) -> None:
        pass


class _Shard(_Woken):
    """State of all keys of a shard: tables by name, each kept as one value."""

    TABLES: dict[str, pa.Schema] = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.kept = {name: handle.getValueState(name, "rows binary") for name in self.TABLES}

    def load(self, name: str) -> pa.Table:
        state = self.kept[name]
        return unpacked(bytes(state.get()[0])) if state.exists() else self.TABLES[name].empty_table()

    def save(self, name: str, table: pa.Table) -> None:
        state = self.kept[name]
        if table.num_rows:
            state.update((packed(table),))
        elif state.exists():
            state.clear()

    def ripe(self, new: pd.DataFrame | None, passed: int, by: Sequence[str]) -> tuple[pd.DataFrame, int]:
        """Rows of table ``waiting`` and new ones that the watermark has passed, in order, and the next stamp waiting."""
        schema = self.TABLES["waiting"]
        held = self.load("waiting").to_pandas()
        rows = held if new is None else new[schema.names] if not len(held) else pd.concat([held, new[schema.names]])
        done = rows["stamp_ns"].to_numpy(np.int64) <= passed
        waiting = rows[~done]
        self.save("waiting", pa.Table.from_pandas(waiting, schema=schema, preserve_index=False))
        return rows[done].sort_values(list(by), kind="stable"), int(waiting["stamp_ns"].min()) if len(waiting) else NEVER


def _by_key(rows: pd.DataFrame, columns: Sequence[str]) -> dict[str, list[tuple]]:
    found: dict[str, list[tuple]] = {}
    for key, *row in zip(rows["key"].tolist(), *[rows[c].tolist() for c in columns], strict=True):
        found.setdefault(key, []).append(tuple(row))
    return found


def _table(schema: pa.Schema, rows: Sequence[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


# ---------------------------------------------------------------- a topic that falls silent


class _Watch(_Shard):
    TABLES = {
        "waiting": pa.schema([("key", pa.string()), ("stamp_ns", pa.int64()), ("start", pa.int64())]),
        "watch": pa.schema([("key", pa.string()), ("began", pa.int64()), ("last", pa.int64()), ("heard", pa.int64()), ("failed", pa.bool_()), ("wake", pa.int64())]),
    }

    def __init__(self, timeout_ns: int, grace_ns: int, forget_ns: int | None):
        self.timeout, self.grace, self.forget = timeout_ns, grace_ns, forget_ns

    def advance(self, key, new, passed):
        rows, wake = self.ripe(new, passed, ["stamp_ns"])
        watch = {k: v for k, *v in zip(*[c.to_pylist() for c in self.load("watch").columns], strict=True)}
        todo = dict.fromkeys((k for k, v in watch.items() if v[4] <= passed), ())
        todo |= _by_key(rows, ["stamp_ns", "start"])
        found = []
        for k, seen in todo.items():
            stamps, starts = np.array(seen, np.int64).reshape(-1, 2).T
            facts, failures = self._turned(watch.pop(k, (None, None, None, False))[:4], stamps, starts, passed)
            found += [(k, *f) for f in failures]
            if facts is not None:
                watch[k] = facts
        self.save("watch", _table(self.TABLES["watch"], [(k, *v) for k, v in watch.items()]))
        # a stamp beside a null must not become a double
        columns = zip(["key", "reason", "last_ns", "due_ns"], list(zip(*found, strict=True)) or [()] * 4, [object, object, "Int64", "Int64"], strict=True)
        return pd.DataFrame({n: pd.array(c, dtype=t) if t == "Int64" else pd.Series(c, dtype=t) for n, c, t in columns}), min([wake, *[v[4] for v in watch.values()]])

    def _turned(self, facts: Sequence, stamps: np.ndarray, starts: np.ndarray, passed: int) -> tuple[tuple | None, list[tuple]]:
        """What is known of one key after its rows, with the stamp to wake up at (null: nothing), and its failures."""
        began, last, heard, failed = facts
        found = []
        while True:
            if failed:
                rest = self._after_silence(heard, stamps, passed)
                if rest is None:
                    heard = int(max([heard, *stamps[-1:]]))
                    break
                stamps, starts = stamps[rest:], starts[rest:]
                began, last, heard, failed = None, None, None, False
            began, last, failure = self._judged(stamps, starts == 1, began, last, passed)
            if failure is None:
                break
            found.append(failure)
            failed, heard = True, began if failure[1] is None else failure[1]
            later = stamps > heard
            stamps, starts = stamps[later], starts[later]
        if failed:
            wake = NEVER if self.forget is None else heard + self.forget + _MS
        else:
            wake = last + self.timeout + _MS if last is not None else began + self.grace + _MS if began is not None else NEVER
        known = failed or began is not None or last is not None
        return (began, last, heard, failed, wake) if known else None, found

    def _after_silence(self, heard: int, stamps: np.ndarray, passed: int) -> int | None:
        """Where the rows after a silence of ``forget`` begin; none while the failure is remembered."""
        if self.forget is None:
            return None
        known = np.concatenate([[heard], stamps])
        quiet = np.flatnonzero(np.diff(known) > self.forget)
        if len(quiet):
            return int(quiet[0])
        return len(stamps) if passed - known[-1] > self.forget else None

    def _judged(self, stamps: np.ndarray, starts: np.ndarray, began: int | None, last: int | None, passed: int):
        """Start, last stamp, and the failure that rows up to ``passed`` show, if any: (reason, last stamp, due stamp)."""
        if began is None and starts.any():
            began = int(stamps[starts][0])
        stamps = stamps[~starts]
        # stamps that move on, behind the one that the topic is known by
        top = np.maximum.accumulate(stamps if last is None else np.concatenate([[last], stamps]))
        if not len(top):
            late = began is not None and passed - began > self.grace
            return began, last, ("missing", None, began + self.grace) if late else None
        if last is None and began is not None and top[0] - began > self.grace:
            return began, last, ("missing", None, began + self.grace)
        gaps = np.flatnonzero(np.diff(top, append=passed) > self.timeout)
        last = int(top[gaps[0]] if len(gaps) else top[-1])
        return began, last, ("stale", last, last + self.timeout) if len(gaps) else None


def silent_topics(messages: DataFrame, keys: Sequence[str], key_ddl: str, timeout_ns: int, grace_ns: int, delay: str, forget_ns: int | None = None) -> DataFrame:
    """One row per key that failed: ``reason, last_ns, due_ns``. The failure is terminal, later messages never clear it.

    ``messages`` has ``keys, stamp_ns`` and ``start``: true on a row that begins the watch of a topic. ``stale``: no newer
    stamp within ``timeout_ns`` of ``last_ns``; ``missing``: no message within ``grace_ns`` of the start. A repeated or
    backward stamp doesn't refresh. A failure is reported when the watermark passes ``due_ns``, with or without another
    message. Without ``forget_ns`` a failed key stays failed for ever; with it, its state goes once it has been silent so
    long, and a later message is watched anew.
    """
    rows = _timed(dealt(messages, keys, "stamp_ns", F.coalesce("start", F.lit(False)).cast("bigint").alias("start")), delay)
    watch = _Watch(timeout_ns, grace_ns, forget_ns)
    out = rows.groupBy("shard").transformWithStateInPandas(watch, "key string, reason string, last_ns bigint, due_ns bigint", "append", "eventtime")
    return undealt(out, key_ddl)


# ---------------------------------------------------------------- nearest row of another stream


class _Nearest(_Shard):
    SIDE = pa.schema([("key", pa.string()), ("bucket", pa.int64()), ("stamp_ns", pa.int64()), ("seq", pa.int64())])
    TABLES = {"left": SIDE, "right": SIDE}

    def __init__(self, tolerance_ns: int):
        self.tolerance = tolerance_ns

    def advance(self, key, new, passed):
        left, right = (self.load(n).to_pandas() for n in self.TABLES)
        if new is not None:
            left, right = (pd.concat([h, new.loc[new["side"] == k, self.SIDE.names]]) if len(h) else new.loc[new["side"] == k, self.SIDE.names] for k, h in enumerate((left, right)))
        rows = pd.concat([left, right])
        group = rows.groupby(["key", "bucket"], sort=False).ngroup().to_numpy(np.int64)
        known, rank = np.unique(rows["stamp_ns"].to_numpy(np.int64), return_inverse=True)
        # one number per group and stamp, in their order
        place = group * (len(known) + 1) + rank
        n = len(left)
        by_place = np.lexsort((right["seq"].to_numpy(np.int64), place[n:]))
        places, first = np.unique(place[n:][by_place], return_index=True)  # the smallest seq speaks for its stamp
        first = by_place[first]
        stamps, seqs, of = (v[first] for v in (right["stamp_ns"].to_numpy(np.int64), right["seq"].to_numpy(np.int64), group[n:]))
        left_ns = left["stamp_ns"].to_numpy(np.int64)
        ripe = left_ns + self.tolerance <= passed
        t, mine = left_ns[ripe], group[:n][ripe]
        after = np.searchsorted(places, place[:n][ripe], side="right")
        far = np.int64(self.tolerance) + 1
        stamps, seqs, of = (np.concatenate([v, [e]]) for v, e in ((stamps, 0), (seqs, 0), (of, -1)))
        gap_before = np.where(of[after - 1] == mine, t - stamps[after - 1], far)
        gap_after = np.where(of[after] == mine, stamps[after] - t, far)
        pick = np.where(gap_before <= gap_after, after - 1, after)
        near = np.minimum(gap_before, gap_after) <= self.tolerance
        pick, asked = pick[near], left[ripe][near]
        out = pd.DataFrame({"key": asked["key"].to_numpy(), "left_seq": asked["seq"].to_numpy(np.int64), "right_seq": seqs[pick], "left_ns": t[near], "right_ns": stamps[pick]})
        # rows that may still come lie behind the watermark
        oldest = np.full(group.max(initial=-1) + 1, passed)
        np.minimum.at(oldest, group[:n][~ripe], left_ns[~ripe])
        left, right = left[~ripe], right[right["stamp_ns"].to_numpy(np.int64) >= oldest[group[n:]] - self.tolerance]
        for name, rest in (("left", left), ("right", right)):
            self.save(name, pa.Table.from_pandas(rest, schema=self.SIDE, preserve_index=False))
        wake = int(left["stamp_ns"].min()) if len(left) else int(right["stamp_ns"].max()) if len(right) else NEVER
        return out, wake if wake == NEVER else wake + self.tolerance


def nearest_live(left: DataFrame, right: DataFrame, keys: Sequence[str], key_ddl: str, tolerance_ns: int, delay: str, width_ns: int | None = None) -> DataFrame:
    """``keys, left_seq, right_seq, left_ns, right_ns``: the right row nearest to each left one, within the tolerance.

    A left row is answered once the watermark has passed its stamp by ``tolerance_ns``; the earlier of two equally near
    rows wins, the smaller ``seq`` of equal stamps. Left rows without a partner have no result. A key's rows are spread
    over buckets of ``width_ns`` (60 tolerances if not stated), right rows near a border lie in both.
    """
    width = max(width_ns or 60 * tolerance_ns, 2 * tolerance_ns, 1)
    t = F.col("stamp_ns")
    bucket = lambda c: F.floor(c / width)
    l = left.select(*keys, F.lit(0).alias("side"), "stamp_ns", "seq", bucket(t).alias("bucket"))
    r = right.select(*keys, F.lit(1).alias("side"), "stamp_ns", "seq", F.explode(F.sequence(bucket(t - tolerance_ns), bucket(t + tolerance_ns))).alias("bucket"))
    rows = _timed(dealt(l.unionByName(r), keys, "side", "bucket", "stamp_ns", "seq", by=["bucket"]), delay)
    out = rows.groupBy("shard").transformWithStateInPandas(_Nearest(tolerance_ns), "key string, left_seq bigint, right_seq bigint, left_ns bigint, right_ns bigint", "append", "eventtime")
    return undealt(out, key_ddl)


# ---------------------------------------------------------------- tracks


class _Tracks(_Woken):
    """Small facts of all tracks and the members of each are kept apart: a batch reads and writes members of few tracks."""

    WAITING = pa.schema([("stamp_ns", pa.int64()), ("seq", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("rad", pa.float64())])

    def __init__(self, keys: Sequence[str], forget_ns: int | None):
        self.keys, self.forget = list(keys), forget_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        # as one table: rows kept one by one would be sent one by one
        self.waiting = handle.getValueState("waiting", "rows binary")
        self.opened = handle.getValueState("opened", "n int")
        self.facts = handle.getMapState("facts", "track int", "x double, y double, last bigint")
        self.members = handle.getMapState("members", "track int", "xs array<double>, ys array<double>")

    def advance(self, key, new, passed):
        held = unpacked(bytes(self.waiting.get()[0])) if self.waiting.exists() else self.WAITING.empty_table()
        rows = held.to_pandas()
        if new is not None:
            rows = pd.concat([rows, new[self.WAITING.names]]) if len(rows) else new[self.WAITING.names]
        ripe = rows["stamp_ns"].to_numpy(np.int64) <= passed
        now, waiting = rows[ripe].sort_values(["stamp_ns", "seq"], kind="stable"), rows[~ripe]
        known = sorted((k[0], *v) for k, v in self.facts.iterator()) if self.facts.exists() else []
        names, mx, my, last = ([r[i] for r in known] for i in range(4))
        opened = self.opened.get()[0] if self.opened.exists() else 0
        touched: dict[int, tuple[list[float], list[float]]] = {}
        out = []
        for t, seq, x, y, rad in now.itertuples(index=False, name=None):
            gap = np.hypot(np.array(mx) - x, np.array(my) - y)
            if self.forget is not None:
                gap[t - np.array(last, np.int64) > self.forget] = np.inf
            k = int(gap.argmin()) if len(gap) else -1
            if k >= 0 and gap[k] <= rad:
                if last[k] == t:
                    continue  # that track has a sighting of this frame
            else:
                k, opened = len(names), opened + 1
                names.append(opened - 1)
                for v in (mx, my, last):
                    v.append(None)
                touched[names[k]] = ([], [])
            if names[k] not in touched:
                touched[names[k]] = tuple(list(v) for v in self.members.getValue((names[k],)))
            xs, ys = touched[names[k]]
            insort(xs, float(x))
            insort(ys, float(y))
            mx[k], my[k], last[k] = _Track.mid(xs), _Track.mid(ys), int(t)
            out.append((*key, names[k], int(t), int(seq), float(x), float(y)))
        for name, x, y, t in zip(names, mx, my, last, strict=True):
            if self.forget is not None and passed - t > self.forget:
                if self.facts.containsKey((name,)):
                    self.facts.removeKey((name,))
                    self.members.removeKey((name,))
            elif name in touched:
                self.facts.updateValue((name,), (x, y, t))
                self.members.updateValue((name,), touched[name])
        self.opened.update((opened,))
        if len(waiting):
            self.waiting.update((packed(pa.Table.from_pandas(waiting, schema=self.WAITING, preserve_index=False)),))
        elif self.waiting.exists():
            self.waiting.clear()
        wake = int(waiting["stamp_ns"].min()) if len(waiting) else NEVER
        if self.forget is not None:
            wake = min([wake, *[t + self.forget + _MS for t in last if passed - t <= self.forget]])
        return pd.DataFrame(out, columns=[*self.keys, "track", "stamp_ns", "seq", "x", "y"]), wake


def live_tracks(observations: DataFrame, keys: Sequence[str], key_ddl: str, delay: str, forget_ns: int | None = None) -> DataFrame:
    """Live association, in the order of (stamp, seq) per key: each sighting with the number of its track.

    The rule is that of ``association.associate``; tracks of a key are numbered as they open. ``keys`` contain the label.
    With ``forget_ns`` a track unseen for longer takes no sighting any more, and its state goes.
    """
    rows = _timed(observations.select(*keys, "stamp_ns", "seq", "x", "y", radius_of(F.col("label")).alias("rad")), delay)
    ddl = f"{key_ddl}, track int, stamp_ns bigint, seq bigint, x double, y double"
    return rows.groupBy(*keys).transformWithStateInPandas(_Tracks(keys, forget_ns), ddl, "append", "eventtime")


# ---------------------------------------------------------------- sets of four streams


class _Sets(_Shard):
    WAITING = pa.schema([("key", pa.string()), ("stamp_ns", pa.int64()), ("side", pa.int64()), ("seq", pa.int64())])
    TABLES = {"waiting": WAITING, "open": WAITING}

    def __init__(self, slop_ns: int):
        self.slop = slop_ns

    def advance(self, key, new, passed):
        names = ["stamp_ns", "side", "seq"]
        rows, wake = self.ripe(new, passed, names)
        held: dict[str, list[list[tuple[int, int]]]] = {}
        for k, t, side, seq in zip(*[c.to_pylist() for c in self.load("open").columns], strict=True):
            held.setdefault(k, [[] for _ in SIDES4])[side].append((t, seq))
        sets = []
        for k, seen in _by_key(rows, names).items():
            sets += [(k, *s) for s in span_sets(seen, held.setdefault(k, [[] for _ in SIDES4]), self.slop)]
        still = [(k, t, side, seq) for k, sides in held.items() for side, kept in enumerate(sides) for t, seq in kept if t + self.slop >= passed]
        self.save("open", _table(self.WAITING, still))
        wake = min([wake, *[t + self.slop + _MS for _, t, _, _ in still]])
        return pd.DataFrame(sets, columns=["key", "stamp_ns", *[f"{s}_seq" for s in SIDES4], "span_ns"]), wake


def sync_sets(messages: DataFrame, keys: Sequence[str], key_ddl: str, slop_ns: int, delay: str) -> DataFrame:
    """Live form of ``asof.approx_sync``, with the same rows: sets of one message of each of four streams."""
    rows = _timed(dealt(messages, keys, "stamp_ns", F.col("side").cast("bigint").alias("side"), "seq"), delay)
    ddl = f"key string, stamp_ns bigint, {', '.join(f'{s}_seq bigint' for s in SIDES4)}, span_ns bigint"
    return undealt(rows.groupBy("shard").transformWithStateInPandas(_Sets(slop_ns), ddl, "append", "eventtime"), key_ddl)
