"""Live rules that follow event time, over files out of order, beside plain loops."""

import random
from itertools import product

import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveykit.operators import asof
from surveykit.operators.association import associate
from surveykit.streaming import timed

US = 1000
DELAY = "1 second"
SECOND = 1_000_000_000


def play(spark, folder, schema, batches, make):
    """Each list of rows is one micro-batch; returns what the stream wrote."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = make(live)
    with timed.timer_store(spark):
        before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        q = out.writeStream.option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).format("parquet").start(f"{folder}/out")
        q.awaitTermination()
        assert "RocksDB" in before
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    return spark.read.schema(out.schema).parquet(f"{folder}/out").collect()


def dealt(r, rows, at, jitter, parts=4):
    """Rows in micro-batches, out of order by up to ``jitter``; a last row of no run ends the recording."""
    came = sorted(rows, key=lambda x: x[at] + r.randrange(jitter))
    size = -(-len(came) // parts)
    batches = [came[k : k + size] for k in range(0, len(came), size)]
    for b in batches:
        r.shuffle(b)
    return batches


def by_hand(rows, slop):
    """Every set that a message can complete, the one of smallest span first; plain search over all waiting messages."""
    waiting, sets = [], []
    for t, side, seq in sorted(rows):
        others = [[w for w in waiting if w[1] == k] for k in range(4) if k != side]
        choices = [c for c in product(*others) if t - min(w[0] for w in c) <= slop]
        if choices:
            best = max(choices, key=lambda c: (min(w[0] for w in c), sorted(c)))
            best = tuple(max(o) for o in others)  # all smallest spans: the newest of each side is one of them
            assert t - min(w[0] for w in best) == min(t - min(w[0] for w in c) for c in choices)
            used = sorted([*best, (t, side, seq)], key=lambda w: w[1])
            sets.append((used[0][0], *[u[2] for u in used], max(u[0] for u in used) - min(u[0] for u in used)))
            waiting = [w for w in waiting if w not in best]
        else:
            waiting.append((t, side, seq))
    return sets


def some_messages(r, n):
    return [(run, r.randrange(n * 16) * 25 * US * 1000, r.randrange(4), k) for run in (1, 2) for k in range(n)]


@pytest.mark.parametrize("width", [4 * SECOND, 10**15])
def test_sets_of_four_equal_plain_search(spark, width):
    r = random.Random(width)
    rows = some_messages(r, 120) + [(3, 5 * SECOND, k, k) for k in (3, 1, 0, 2)] + [(4, 0, 0, 0)]
    slop = 3 * SECOND
    out = asof.approx_sync(spark.createDataFrame(rows, "run_id bigint, stamp_ns bigint, side int, seq bigint"), ["run_id"], slop, width)
    assert out.columns == ["run_id", "stamp_ns", "left_seq", "right_seq", "left_info_seq", "right_info_seq", "span_ns"]
    want = [(run, *s) for run in (1, 2, 3, 4) for s in by_hand([x[1:] for x in rows if x[0] == run], slop)]
    assert sorted(map(tuple, out.collect())) == sorted(want) and len(want) > 20 and (3, 5 * SECOND, 0, 1, 2, 3, 0) in want


def test_live_sets_equal_batch(spark, tmp_path):
    r = random.Random(5)
    rows = some_messages(r, 60)
    slop = 3 * SECOND
    schema = "run_id bigint, stamp_ns bigint, side int, seq bigint"
    batches = [*dealt(r, rows, 1, SECOND), [(None, 10**15, 0, 0)]]
    got = play(spark, f"file:{tmp_path}", schema, batches, lambda s: timed.sync_sets(s, ["run_id"], "run_id bigint", slop, DELAY))
    want = asof.approx_sync(spark.createDataFrame(rows, schema), ["run_id"], slop, 5 * SECOND).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 5


def test_nearest_is_handed_out_once(spark, tmp_path):
    r = random.Random(6)
    rows = [(run, r.randrange(2), r.randrange(4000) * 25 * US * 1000, k) for run in (1, 2) for k in range(150)]
    rows += [(7, 0, 10 * SECOND, 1), (7, 1, 9 * SECOND, 5), (7, 1, 11 * SECOND, 4), (7, 1, 9 * SECOND, 3), (8, 0, SECOND, 1)]
    tolerance = SECOND
    want = []
    for run, side, t, seq in rows:
        near = [(abs(t - u), u, q) for a, b, u, q in rows if a == run and b == 1 and abs(t - u) <= tolerance] if side == 0 else []
        want += [(run, seq, min(near)[2], t, min(near)[1])] if near else []
    batches = [*dealt(r, rows, 2, SECOND), [(None, 0, 10**15, 0)]]

    def make(s):
        left, right = (s.where(F.col("side") == k).select("run_id", "stamp_ns", "seq") for k in (0, 1))
        return timed.nearest_live(left, right, ["run_id"], "run_id bigint", tolerance, DELAY, width_ns=20 * SECOND)

    got = play(spark, f"file:{tmp_path}", "run_id bigint, side int, stamp_ns bigint, seq bigint", batches, make)
    assert sorted(map(tuple, got)) == sorted(want) and (7, 1, 3, 10 * SECOND, 9 * SECOND) in want


def test_silence_is_reported_without_a_message(spark, tmp_path):
    at = lambda run, seconds, start=False: (run, "scan", int(seconds * SECOND), start)
    batches = [
        [at(1, 100, True), at(2, 100, True), at(3, 100, True), at(4, 100, True), at(1, 101), at(4, 103), at(5, 100), at(5, 102)],
        [at(1, 103), at(1, 102), at(4, 103), at(4, 100.5), at(5, 103), at(5, 104.5)],
        [at(1, 105), at(5, 106.5), at(4, 107)],
        [at(1, 107), at(5, 108)],
        [at(1, 190), at(5, 109.9), at(2, 111)],
        [(None, "end", 200 * SECOND, False)],
    ]
    schema = "run_id bigint, topic string, stamp_ns bigint, start boolean"
    got = play(spark, f"file:{tmp_path}", schema, batches, lambda s: timed.silent_topics(s, ["run_id", "topic"], "run_id bigint, topic string", 3 * SECOND, 10 * SECOND, "4 seconds"))
    # 1: gap, then a message; 2: first message too late; 3: never a message; 4: repeated and backward stamps don't refresh; 5: stops
    want = [(1, "stale", 107, 110), (2, "missing", None, 110), (3, "missing", None, 110), (4, "stale", 103, 106), (5, "stale", 109, 112)]
    assert sorted((g.run_id, g.reason, g.last_ns and g.last_ns // SECOND, g.due_ns // SECOND) for g in got) == want


def test_forgotten_failures_are_watched_anew(spark, tmp_path):
    rows = [[(1, 100)], [(2, 110)], [(2, 150)], [(1, 160)], [(2, 190)], [(2, 200)]]
    batches = [[(k, t * SECOND, False) for k, t in b] for b in rows]
    make = lambda s: timed.silent_topics(s, ["run_id"], "run_id bigint", 3 * SECOND, SECOND, "1 second", forget_ns=20 * SECOND)
    got = play(spark, f"file:{tmp_path}", "run_id bigint, stamp_ns bigint, start boolean", batches, make)
    assert [(g.last_ns // SECOND, g.due_ns // SECOND) for g in sorted(got, key=lambda g: g.due_ns) if g.run_id == 1] == [(100, 103), (160, 163)]


def test_live_tracks_equal_batch_association(spark, tmp_path):
    r = random.Random(4)
    rows = [(run, "chair", (10 + k // 2) * SECOND, k, r.gauss(0, 1.0), r.gauss(0, 1.0)) for run in (1, 2) for k in range(80)]
    schema = "run_id bigint, label string, stamp_ns bigint, seq bigint, x double, y double"
    batches = [*dealt(r, rows, 2, SECOND), [(None, "chair", 10**15, 0, 0.0, 0.0)]]
    got = play(spark, f"file:{tmp_path}", schema, batches, lambda s: timed.live_tracks(s, ["run_id", "label"], "run_id bigint, label string", DELAY))
    want = associate(spark.createDataFrame(rows, schema).withColumn("cid", F.lit(0))).collect()

    def groups(rows, name):
        out = {}
        for g in rows:
            out.setdefault((g.run_id, name(g)), []).append(g.seq)
        return sorted(map(sorted, out.values()))

    assert groups(got, lambda g: g.track) == groups(want, lambda g: (g.part, g.track))
    opened = [min(g.seq for g in got if (g.run_id, g.track) == (1, k)) for k in range(1 + max(g.track for g in got if g.run_id == 1))]
    assert opened == sorted(opened) and len(opened) > 5


def test_tracks_unseen_for_long_are_forgotten(spark, tmp_path):
    rows = [[(1, "chair", t * SECOND, t, 0.0, 0.0)] for t in (10, 12, 40, 41)] + [[(2, "chair", t * SECOND, t, 5.0, 5.0)] for t in (60, 90)]
    schema = "run_id bigint, label string, stamp_ns bigint, seq bigint, x double, y double"
    got = play(spark, f"file:{tmp_path}", schema, rows, lambda s: timed.live_tracks(s, ["run_id", "label"], "run_id bigint, label string", DELAY, forget_ns=10 * SECOND))
    assert sorted((g.seq, g.track) for g in got if g.run_id == 1) == [(10, 0), (12, 0), (40, 1), (41, 1)]


def test_state_of_many_keys_is_held_by_shard(spark, tmp_path, monkeypatch):
    from surveykit.streaming import shards

    monkeypatch.setattr(shards, "SHARDS", 2)
    began = 1_704_163_170_377_255_001  # no double holds it
    rows = [(k if k else None, "a\"b", began + k, k % 2 == 0) for k in range(40)]
    schema = "run_id bigint, topic string, stamp_ns bigint, start boolean"
    batches = [rows, [(-1, "end", began + 100 * SECOND, False)]]

    make = lambda s: timed.silent_topics(s, ["run_id", "topic"], "run_id bigint, topic string", 3 * SECOND, 5 * SECOND, "1 second")
    got = play(spark, f"file:{tmp_path}", schema, batches, make)
    want = [(None if k == 0 else k, "a\"b", *(("stale", began + k, began + k + 3 * SECOND) if k % 2 else ("missing", None, began + k + 5 * SECOND))) for k in range(40)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    state = spark.read.format("statestore").option("stateVarName", "watch").load(f"file:{tmp_path}/mark")
    assert state.count() <= 2


def test_state_has_few_parts_per_core(spark):
    """Each part of the state is a task with a Python worker of its own in every micro-batch."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 2000)
        with timed.timer_store(spark):
            assert int(spark.conf.get(name)) <= timed.WAVES * spark.sparkContext.defaultParallelism
        assert spark.conf.get(name) == "2000"
    finally:
        spark.conf.set(name, before)


class OneValue:
    """State of one key that counts its writes."""

    def __init__(self):
        self.value, self.writes = None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1

    def clear(self):
        self.value = None


class ManyValues(dict):
    exists, iterator, containsKey = dict.__len__, dict.items, dict.__contains__
    getValue, updateValue, removeKey = dict.__getitem__, dict.__setitem__, dict.pop


class Handle:
    """Single values and maps only: a list of rows would go to the store row by row."""

    def getValueState(self, name, schema):
        return self.__dict__.setdefault(name, OneValue())

    def getMapState(self, name, key, value):
        return ManyValues()


def test_waiting_sightings_are_one_value():
    handle = Handle()
    tracks = timed._Tracks(["run_id", "label"], None)
    tracks.init(handle)
    new = pd.DataFrame({"stamp_ns": [30, 10, 20], "seq": [3, 1, 2], "x": [0.1, 0.0, 9.0], "y": 0.0, "rad": 0.5})
    assert not len(tracks.advance((0, "cup"), new, 5)[0]) and handle.waiting.writes == 1
    out, wake = tracks.advance((0, "cup"), None, 20)
    assert out["track"].tolist() == [0, 1] and wake == 30 and handle.waiting.writes == 2
    out, _ = tracks.advance((0, "cup"), None, 30)
    assert out["track"].tolist() == [0] and not handle.waiting.exists()
