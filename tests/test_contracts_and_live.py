"""Readiness order, recording chains, sinks and streaming latches."""

import json

from pyspark.sql import functions as F

from surveykit.operators import contracts as k
from surveykit.session import scratch_path
from surveykit.sources import sinks
from surveykit.sources.sinks import commit_once, read_committed
from surveykit.sources.tables import STATUS, read_detections, status_events  # noqa: F401
from surveykit.streaming import live

exists = sinks._exists
RUN = "run_id int, error string, expected_n int, det_rx int, sync_rx int, inflight int, drops int, budget int, last_activity_s double, now_s double"


def ready(spark, expected, detected, synced, **over):
    base = {"error": "", "expected_n": len(set(expected)), "det_rx": len(detected), "sync_rx": len(synced), "inflight": 0, "drops": 0, "budget": 0, "last_activity_s": 10.0, "now_s": 12.0}
    base.update(over)
    runs = spark.createDataFrame([(1, *base.values())], RUN)
    stamps = [spark.createDataFrame([(1, s) for s in v] or [], "run_id int, stamp_ns int") for v in (expected, detected, synced)]
    return k.check_ready(runs, *stamps, ["run_id"]).first().state


def test_ready_barrier(spark):
    five = [11, 22, 33, 44, 55]
    assert ready(spark, five, five, five[:4]) == "NOT_READY:missing_sync"
    assert ready(spark, five, five, five, now_s=10.5) == "NOT_READY:quiet"
    assert ready(spark, five, five, five) == "READY"
    assert ready(spark, five, five, five, det_rx=6) == "INVALID:duplicates"
    assert ready(spark, five, five, five, inflight=1) == "NOT_READY:inflight"
    assert ready(spark, five, five, five, drops=1) == "INVALID:drops"
    assert ready(spark, [11, 22, 33], [11, 22, 33], [11, 22], budget=1) == "READY"
    assert ready(spark, [11, 22, 33], [11, 22, 33], [11, 22], budget=3) == "INVALID:budget"
    assert ready(spark, [11, 22, 33], [11, 22, 33], [11, 22], budget=-1) == "INVALID:budget"
    assert ready(spark, [11, 22], [11, 22, 99], [11, 22]) == "INVALID:unexpected"


def chain(spark, events):
    base = {"schema": 1, "token": "t", "map_image_sha256": "a" * 64, "map_manifest_sha256": "b" * 64, "camera_mount": "0 0 0 0 0 0", "pose_source": "amcl"}
    rows = [(1, i, e if isinstance(e, str) else json.dumps({**base, **e})) for i, e in enumerate(events)]
    return k.state_chain(status_events(spark.createDataFrame(rows, "run_id int, seq int, payload string"))).first().reason


def test_recording_chain(spark):
    start, done = {"state": "started"}, {"state": "completed"}
    assert chain(spark, [start, start, "not json", done]) == "ok"
    assert chain(spark, [done, start]) == "order"
    assert chain(spark, [start, done, done]) == "completion_count"
    assert chain(spark, [start, {**done, "token": "u"}]) == "sessions"
    assert chain(spark, [start, {"state": "failed"}, done]) == "failed"
    assert chain(spark, [start, {"state": "paused"}, done]) == "unknown_state"
    assert chain(spark, [start, {**done, "map_image_sha256": "c" * 64}]) == "map_hash_mismatch"
    assert chain(spark, [{**start, "camera_mount": "1 0 0 0 0 0"}, done]) == "mount_mismatch"
    assert chain(spark, [start, {**done, "pose_source": "other"}]) == "pose_source_unknown"


def test_detection_documents_keep_empty_frames(spark, tmp_path):
    doc = {"schema": "x-detections-v1", "complete": True, "frames": [
        {"stamp_ns": 5, "w": 640, "h": 480, "dets": []},
        {"stamp_ns": 6, "w": 640, "h": 480, "dets": [{"cls": 0, "label": "door", "score": 0.5, "cx": 1.0, "cy": 2.0, "sx": 3.0, "sy": 4.0}]}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    header, frames, boxes = read_detections(spark, str(tmp_path))
    assert header.count() == 1 and frames.count() == 2
    assert [(r.stamp_ns, r.seq, r.label) for r in boxes.collect()] == [(6, 0, "door")]


def test_commit_happens_once(spark):
    root = scratch_path(spark, "once")
    df = spark.range(5)
    assert commit_once(df, root, "a", violations=df) == "invalid"
    assert commit_once(df, root, "a") == "committed"
    assert commit_once(spark.range(9), root, "a") == "refused"
    assert read_committed(spark, root).count() == 5


def test_two_writers_of_one_token(spark, monkeypatch):
    root = scratch_path(spark, "race")
    monkeypatch.setattr(sinks, "_exists", lambda s, where: False if where.endswith(".json") else exists(s, where))
    token = "a/b =%1"
    assert commit_once(spark.range(5), root, token) == "committed"
    assert commit_once(spark.range(9), root, token) == "refused"  # it did not see the first one, the name did
    assert commit_once(spark.range(2), root, token + "x") == "committed"
    assert sorted(r.id for r in read_committed(spark, root).collect()) == [0, 0, 1, 1, 2, 3, 4]
    assert spark.read.parquet(f"{root}/data").count() == 7
    assert sorted((r.token, r.rows) for r in sinks.committed(spark, root).collect()) == [(token, 5), (token + "x", 2)]


def test_late_rows_are_counted(spark, tmp_path):
    src = f"file:{tmp_path}/in"
    schema = "run_id bigint, stamp_ns bigint"
    for rows in ([(1, 100), (2, 5)], [(1, 60), (1, 94), (1, 89), (2, 9)], [(1, 120), (2, 1)], [(1, 109)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = live.late_rows(s, ["run_id"], "run_id bigint", 10)
    q.writeStream.option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out").awaitTermination()
    got = spark.read.schema(q.schema).parquet(f"file:{tmp_path}/out").collect()
    assert sorted(map(tuple, got)) == [(1, 100, 2, 40), (1, 120, 1, 11)]


def test_staleness_latch_is_terminal_across_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    for i, stamps in enumerate([[0, 10, 20], [15, 20, 95], [96, 97, 300]]):
        spark.createDataFrame([(1, "scan", s, s) for s in stamps], "run_id bigint, topic string, stamp_ns bigint, seq bigint").coalesce(1).write.mode("append").parquet(f"{src}/b{i}")
    schema = "run_id bigint, topic string, stamp_ns bigint, seq bigint"
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(src)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    q = live.staleness_latch(s, ["run_id", "topic"], "run_id bigint, topic string", 50)
    q.writeStream.outputMode("append").option("checkpointLocation", mark).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    got = spark.read.schema(q.schema).parquet(out).collect()
    assert [(r.last_ns, r.gap_ns) for r in got] == [(20, 75)]


def played_in_shards(spark, folder, monkeypatch, make):
    """Result of two micro-batches of 40 keys, and how many states they left."""
    from surveykit.streaming import shards

    monkeypatch.setattr(shards, "SHARDS", 2)
    schema = "run_id bigint, topic string, stamp_ns bigint, seq bigint"
    at = 1_704_163_170_377_255_001  # no double holds it
    for rows in ([(k if k else None, "a\"b", at + k, k) for k in range(40)], [(k if k else None, "a\"b", at + k + (100 if k % 2 else -100), k) for k in range(40)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    out = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    out.writeStream.option("checkpointLocation", f"{folder}/mark").trigger(availableNow=True).format("parquet").start(f"{folder}/out").awaitTermination()
    states = spark.read.format("statestore").load(f"{folder}/mark").count()
    return sorted(map(str, map(tuple, spark.read.schema(out.schema).parquet(f"{folder}/out").collect()))), at, states


def test_late_rows_of_many_keys_share_a_state(spark, tmp_path, monkeypatch):
    from surveykit.streaming import live

    got, at, states = played_in_shards(spark, f"file:{tmp_path}", monkeypatch, lambda s: live.late_rows(s, ["run_id"], "run_id bigint", 50))
    assert got == sorted(str((k or None, at + k, 1, 100)) for k in range(0, 40, 2)) and states <= 2


def test_gap_latches_of_many_keys_share_a_state(spark, tmp_path, monkeypatch):
    from surveykit.streaming import live

    got, at, states = played_in_shards(spark, f"file:{tmp_path}", monkeypatch, lambda s: live.staleness_latch(s, ["run_id", "topic"], "run_id bigint, topic string", 50))
    assert got == sorted(str((k, "a\"b", at + k, 100)) for k in range(1, 40, 2)) and states <= 2
