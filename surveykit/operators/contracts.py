"""Data-contract checks. Each returns rows; nothing is raised on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from surveykit.functions.geometry import all_finite, hypot2, is_finite, mat3_det, mount_quat  # noqa: F401
from surveykit.functions.text import camera_mount, canonical_frame, canonical_sha, is_sha256, is_token, is_token32, map_number, mount_equal, texts17
from surveykit.operators.detections import row_violation
from surveykit.operators.motion import duplicate_stamps, size_drift

NO_STRINGS = "cast(array() as array<string>)"


def first_reason(rules: Sequence[tuple[str, Column]], good: str = "ok") -> Column:
    """Name of the first rule whose violation holds. A null test counts as a violation."""
    out = F.lit(good)
    for name, bad in reversed(list(rules)):
        out = F.when(F.coalesce(bad, F.lit(True)), F.lit(name)).otherwise(out)
    return out


def all_reasons(rules: Sequence[tuple[str, Column]]) -> Column:
    """Names of all violated rules, comma separated, in rule order."""
    marks = F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules])
    return F.array_join(F.filter(marks, lambda m: m.isNotNull()), ",")


# fixed values: schema strings of documents; a project that writes a prefix states its own
DETECTIONS, OBJECTS, TOPOLOGY = "detections-v1", "semantic-objects-v1", "room-topology-v1"
SEMANTIC_MAP, POI_CONTRACT = "semantic-map-v1", "core-poi-contract-v1"


def schema_is(c: Column, expected: str) -> Column:
    return c.eqNullSafe(F.lit(expected))


# ---------------------------------------------------------------- sets


def set_difference(expected: DataFrame, seen: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Expected but not seen and seen but not expected, one pass: flags per key, then a filter."""
    both = expected.select(*cols, F.lit(1).alias("_e"), F.lit(0).alias("_s")).unionByName(
        seen.select(*cols, F.lit(0).alias("_e"), F.lit(1).alias("_s"))
    )
    g = both.groupBy(*cols).agg(F.max("_e").alias("_e"), F.max("_s").alias("_s")).where("_e <> _s")
    return g.select(*cols, F.when(F.col("_e") == 1, "missing").otherwise("unexpected").alias("side"))


def contains_all(df: DataFrame, keys: Sequence[str], member: str, required: Sequence[str]) -> DataFrame:
    flags = [F.max(F.when(F.col(member) == x, 1).otherwise(0)) for x in required]
    total = sum(flags[1:], flags[0])
    return df.groupBy(*keys).agg((total == len(required)).alias("is_superset"))


def missing_members(df: DataFrame, runs: DataFrame, keys: Sequence[str], member: str, required: Sequence[str]) -> DataFrame:
    """Required members a run lacks: expected rows minus the seen ones."""
    want = runs.select(*keys).distinct().select(*keys, F.explode(F.array(*[F.lit(x) for x in required])).alias(member))
    seen = df.where(F.col(member).isin(*required)).select(*keys, member).distinct()
    return want.join(seen, [*keys, member], "left_anti")


def singleton(df: DataFrame, keys: Sequence[str], value: str, expected: str | None = None) -> DataFrame:
    """Exactly one distinct identity per run; min and max say the same as a distinct count."""
    clean = F.lower(F.trim(F.col(value)))
    g = df.groupBy(*keys).agg(F.min(clean).alias("_lo"), F.max(clean).alias("_hi"), *([F.max(expected).alias("_want")] if expected else []))
    verdict = F.when(F.col("_lo").isNull(), "none").when(F.col("_lo") != F.col("_hi"), "many")
    if expected:
        verdict = verdict.when(~F.col("_lo").eqNullSafe(F.lower(F.trim(F.col("_want")))), "mismatch")
    return g.select(*keys, F.col("_lo").alias("identity"), verdict.otherwise("ok").alias("verdict"))


# ---------------------------------------------------------------- recordings

POSE_SOURCES = ["gmapping", "amcl"]  # fixed values: accepted pose sources


def state_chain(events: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Validate started -> completed per run; ``events`` are parsed status rows with ``seq``.

    Only aggregates: order is decided by the smallest and largest position, equality by min and max.
    """
    keys = list(keys)
    norm = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    e = events.where("schema = 1").withColumn("state", F.coalesce("state", F.lit("")))
    e = e.withColumn("_mount", F.to_json(camera_mount(F.col("camera_mount"))))
    done = (F.col("state") == "completed") & (F.coalesce("token", F.lit("")) != "")
    head = e.groupBy(*keys).agg(
        F.count_if(F.col("state") == "failed").alias("n_failed"),
        F.max_by("reason", F.when(F.col("state") == "failed", F.col("seq"))).alias("failed_reason"),
        F.count_if(~F.col("state").isin("started", "completed", "failed")).alias("n_unknown"),
        F.min(F.when(F.col("token") != "", F.col("token"))).alias("tok_lo"),
        F.max(F.when(F.col("token") != "", F.col("token"))).alias("tok_hi"),
        F.count_if(done).alias("n_done"),
        F.min(F.when(done, F.col("seq"))).alias("done_seq"),
        F.min_by(
            F.struct("token", norm("map_image_sha256").alias("img"), norm("map_manifest_sha256").alias("man"), F.col("_mount").alias("mount"), norm("pose_source").alias("pose")),
            F.when(done, F.col("seq")),
        ).alias("d"),
    )
    starts = e.where("state = 'started'").join(head.select(*keys, "d.token"), [*keys, "token"])
    s = starts.groupBy(*keys).agg(
        F.max("seq").alias("start_hi"),
        *[F.min(c).alias(f"{n}_lo") for n, c in (("img", norm("map_image_sha256")), ("man", norm("map_manifest_sha256")), ("mount", F.coalesce("_mount", F.lit("bad"))), ("pose", norm("pose_source")))],
        *[F.max(c).alias(f"{n}_hi") for n, c in (("img", norm("map_image_sha256")), ("man", norm("map_manifest_sha256")), ("mount", F.coalesce("_mount", F.lit("bad"))), ("pose", norm("pose_source")))],
    )
    j = head.join(s, keys, "left")

    def differs(n: str) -> Column:
        return (F.col(f"{n}_lo") != F.col(f"d.{n}")) | (F.col(f"{n}_hi") != F.col(f"d.{n}"))

    rules = [
        ("failed", F.col("n_failed") > 0),
        ("unknown_state", F.col("n_unknown") > 0),
        ("sessions", F.col("tok_lo").isNull() | (F.col("tok_lo") != F.col("tok_hi"))),
        ("completion_count", F.col("n_done") != 1),
        ("order", F.col("start_hi").isNull() | (F.col("start_hi") >= F.col("done_seq"))),
        ("map_hash_invalid", ~is_sha256(F.col("d.img"))),
        ("map_hash_mismatch", differs("img")),
        ("manifest_invalid", ~is_sha256(F.col("d.man"))),
        ("manifest_mismatch", differs("man")),
        ("mount_invalid", F.col("d.mount").isNull()),
        ("mount_mismatch", differs("mount")),
        ("pose_source_unknown", ~F.col("d.pose").isin(*POSE_SOURCES)),
        ("pose_source_mismatch", differs("pose")),
    ]
    return j.select(
        *keys, first_reason(rules).alias("reason"), F.col("d.token").alias("token"), F.col("d.img").alias("map_image_sha256"),
        F.col("d.man").alias("map_manifest_sha256"), F.col("d.mount").alias("camera_mount"), F.col("d.pose").alias("pose_source"),
    ).withColumn("ok", F.col("reason") == "ok")


def edge_matches(tolerance: float = 1e-5, expected_child: str = "stereo_left_optical") -> Column:
    """Camera transform (parent, child, tx..qw) equals the sealed ``mount`` array of the run."""
    mount = F.col("mount")
    t = [F.col(c) for c in ("tx", "ty", "tz")]
    q = [F.col(c) for c in ("qx", "qy", "qz", "qw")]
    norm = F.sqrt(sum((c * c for c in q[1:]), q[0] * q[0]))
    want = mount_quat(mount[3], mount[4], mount[5])
    dot = F.abs(sum((a * b for a, b in zip(want[1:], q[1:])), want[0] * q[0])) / F.nullif(norm, F.lit(0.0))
    finite = F.lit(True)
    for c in [*t, *q]:
        finite = finite & is_finite(c)
    close = F.lit(True)
    for i, c in enumerate(t):
        close = close & (F.abs(c - mount[i]) <= tolerance)
    frames = (canonical_frame(F.col("parent")) == "base_footprint") & (canonical_frame(F.col("child")) == expected_child)
    return F.coalesce(frames & finite & close & (F.abs(1.0 - dot) <= tolerance), F.lit(False))


def stereo_pair_valid() -> Column:
    """Calibrated stereo pair: columns left and right are structs with width, height, k, d, r, p, frame_id."""
    l, r = F.col("left"), F.col("right")
    ok = F.lit(True)
    for s in (l, r):
        det = mat3_det(s["r"])
        ok = ok & all_finite(F.concat(s["d"], s["k"], s["r"], s["p"])) & (F.size(s["d"]) >= 4)
        ok = ok & (s["k"][0] > 0) & (s["k"][4] > 0) & (s["p"][0] > 0) & (s["p"][5] > 0) & (det > 0.5) & (det < 1.5)
    ok = ok & (l["width"] == r["width"]) & (l["height"] == r["height"]) & (l["width"] > 0) & (l["height"] > 0)
    ok = ok & (F.abs(F.try_divide(l["p"][3], l["p"][0])) < 1e-6) & (F.try_divide(r["p"][3], r["p"][0]) < -1e-6)
    return F.coalesce(ok & (l["frame_id"] != "") & (l["frame_id"] == r["frame_id"]), F.lit(False))


def capture_pair_valid(frame: str = "stereo_left_optical", low: float = 0.05, high: float = 0.07) -> Column:
    """Capture-time variant: fixed array lengths and a baseline between the limits."""
    l, r = F.col("left"), F.col("right")
    ok = F.lit(True)
    for s in (l, r):
        ok = ok & all_finite(F.concat(s["d"], s["k"], s["r"], s["p"])) & (F.size(s["d"]) >= 4)
        ok = ok & (F.size(s["k"]) == 9) & (F.size(s["r"]) == 9) & (F.size(s["p"]) == 12)
        ok = ok & (canonical_frame(s["frame_id"]) == frame) & (s["p"][0] > 0) & (s["p"][5] > 0)
    ok = ok & (l["width"] == r["width"]) & (l["height"] == r["height"]) & (l["width"] > 0) & (l["height"] > 0)
    baseline = -F.try_divide(r["p"][3], r["p"][0])
    ok = ok & (F.abs(F.try_divide(l["p"][3], l["p"][0])) <= 1e-6) & (baseline >= low) & (baseline <= high)
    return F.coalesce(ok, F.lit(False))


def pose_quality(max_xy: float, max_yaw: float) -> Column:
    """Map-frame pose with a sane stamp and bounded, finite covariance (frame_id, cov, stamp_s, now_s)."""
    cov = F.col("cov")
    picks = [cov[0], cov[7], cov[35]]
    good = F.lit(True)
    for c in picks:
        good = good & is_finite(c) & (c >= 0)
    frame = canonical_frame(F.col("frame_id")).isin("", "map")
    stamp = (F.col("stamp_s") > 0) & (F.col("stamp_s") - F.col("now_s") <= 0.10)
    small = (F.sqrt(F.greatest(picks[0], picks[1])) <= max_xy) & (F.sqrt(picks[2]) <= max_yaw)
    return F.coalesce(frame & (F.size(cov) >= 36) & stamp & good & small, F.lit(False))


# ---------------------------------------------------------------- jobs


def check_frames(frames: DataFrame, boxes: DataFrame, keys: Sequence[str], classes: Sequence[str] | None = None) -> DataFrame:
    """Violations of detection frames and rows as (keys, stamp_ns, violation, n)."""
    keys = list(keys)
    dup = duplicate_stamps(frames, keys).select(*keys, "stamp_ns", "violation")
    drifted = size_drift(frames, keys).select(*keys, "stamp_ns", F.lit("size_drift").alias("violation"))
    empty = frames.where((F.col("w") <= 0) | (F.col("h") <= 0)).select(*keys, "stamp_ns", F.lit("dimensions").alias("violation"))
    rows = boxes.withColumn("violation", row_violation(classes)).where("violation is not null").select(*keys, "stamp_ns", "violation")
    every = dup.unionByName(drifted).unionByName(empty).unionByName(rows)
    return every.groupBy(*keys, "stamp_ns", "violation").agg(F.count("*").alias("n"))


CLASS_TABLES = [["chair", "table", "door"], ["door"], ["door", "sofa", "cabinet", "spray"]]  # fixed values: allowed class tables


def check_document(headers: DataFrame, keys: Sequence[str], schema: str = DETECTIONS) -> DataFrame:
    """First broken rule of a detection header."""
    tables = [F.array(*[F.lit(x) for x in t]) for t in CLASS_TABLES]
    allowed = F.lit(False)
    for t in tables:
        allowed = allowed | F.col("classes").eqNullSafe(t)
    mount = F.col("camera_mount")
    rules = [
        ("schema", ~schema_is(F.col("schema"), schema)),
        ("incomplete", ~F.coalesce("complete", F.lit(False))),
        ("token", ~is_token32(F.col("recording_token"))),
        ("map_image_sha256", ~is_sha256(F.col("map_image_sha256"))),
        ("map_manifest_sha256", ~is_sha256(F.col("map_manifest_sha256"))),
        ("source_bag_sha256", ~is_sha256(F.col("source_bag_sha256"))),
        ("classes", ~allowed),
        ("camera_mount", ~((F.size(mount) == 6) & all_finite(mount))),
    ]
    return headers.select(*keys, first_reason(rules).alias("reason"))


def provenance(left: DataFrame, right: DataFrame, key: str = "recording_token") -> DataFrame:
    """Two artifact headers on one token with the first field that differs."""
    fields = ["source_bag_sha256", "map_image_sha256", "map_manifest_sha256"]
    l = left.select(key, *[F.col(c).alias(f"l_{c}") for c in [*fields, "camera_mount"]], F.lit(True).alias("_l"))
    r = right.select(key, *[F.col(c).alias(f"r_{c}") for c in [*fields, "camera_mount"]], F.lit(True).alias("_r"))
    j = l.join(r, [key], "full")
    rules = [("left_missing", F.col("_l").isNull()), ("right_missing", F.col("_r").isNull())]
    rules += [(c, ~F.lower(F.trim(F.col(f"l_{c}"))).eqNullSafe(F.lower(F.trim(F.col(f"r_{c}"))))) for c in fields]
    rules += [("camera_mount", ~mount_equal(F.col("l_camera_mount"), F.col("r_camera_mount")))]
    return j.select(key, first_reason(rules).alias("reason"))


def header_identity(headers: DataFrame, completions: DataFrame, maps: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Detection header against the completion record and the map identity of its run."""
    c = completions.select(*keys, *[F.col(x).alias(f"c_{x}") for x in ("token", "map_image_sha256", "map_manifest_sha256", "camera_mount", "source_bag_sha256", "image_topic", "rectified")])
    m = maps.select(*keys, F.col("image_sha").alias("m_image"), F.col("manifest_sha").alias("m_manifest"))
    j = headers.join(c, list(keys), "left").join(m, list(keys), "left")
    same = lambda a, b: ~F.lower(F.trim(F.col(a))).eqNullSafe(F.lower(F.trim(F.col(b))))
    rules = [
        ("no_completion", F.col("c_token").isNull()),
        ("token", same("recording_token", "c_token")),
        ("map_image", same("map_image_sha256", "c_map_image_sha256") | same("map_image_sha256", "m_image")),
        ("map_manifest", same("map_manifest_sha256", "c_map_manifest_sha256") | same("map_manifest_sha256", "m_manifest")),
        ("camera_mount", ~mount_equal(F.col("camera_mount"), F.col("c_camera_mount"))),
        ("source_bag", same("source_bag_sha256", "c_source_bag_sha256")),
        ("image_topic", ~F.col("image_topic").eqNullSafe(F.col("c_image_topic"))),
        ("rectified", ~F.col("rectified").eqNullSafe(F.col("c_rectified"))),
    ]
    return j.select(*keys, first_reason(rules).alias("reason"))


def check_bag_counts(counts: DataFrame, required: DataFrame, keys: Sequence[str], left: str, right: str, ratio: float = 1.25) -> DataFrame:
    """Too few messages per required topic, and an unbalanced camera pair.

    ``required`` is the run-topic list with ``minimum``; ``counts`` has ``n`` per topic.
    """
    keys = list(keys)
    j = required.join(counts.select(*keys, "topic", "n"), [*keys, "topic"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    g = j.groupBy(*keys).agg(
        F.count_if(F.col("n") < F.col("minimum")).alias("short_topics"),
        F.max(F.when(F.col("topic") == left, F.col("n"))).alias("_l"),
        F.max(F.when(F.col("topic") == right, F.col("n"))).alias("_r"),
    )
    skewed = F.least("_l", "_r") * ratio < F.greatest("_l", "_r")
    reason = F.when(F.col("short_topics") > 0, "short").when(F.coalesce(skewed, F.lit(False)), "imbalanced").otherwise("ok")
    return g.select(*keys, "short_topics", reason.alias("reason"))


def check_ready(runs: DataFrame, expected: DataFrame, detected: DataFrame, synced: DataFrame, keys: Sequence[str], quiet_s: float = 1.0) -> DataFrame:
    """Completeness barrier per run: INVALID, NOT_READY or READY with the first reason.

    ``runs`` carries error, expected_n, det_rx, sync_rx, inflight, drops, budget, last_activity_s, now_s;
    the other tables hold stamps. All three stamp sets meet in one aggregate per (run, stamp).
    """
    keys = list(keys)

    def mark(df: DataFrame, e: int, d: int, s: int) -> DataFrame:
        return df.select(*keys, "stamp_ns", F.lit(e).alias("_e"), F.lit(d).alias("_d"), F.lit(s).alias("_s"))

    per = mark(expected, 1, 0, 0).unionByName(mark(detected, 0, 1, 0)).unionByName(mark(synced, 0, 0, 1))
    per = per.groupBy(*keys, "stamp_ns").agg(F.max("_e").alias("e"), F.max("_d").alias("d"), F.max("_s").alias("s"))
    sets = per.groupBy(*keys).agg(
        F.sum("e").alias("n_expected"),
        F.count_if((F.col("e") == 0) & ((F.col("d") == 1) | (F.col("s") == 1))).alias("n_unexpected"),
        F.count_if((F.col("e") == 1) & (F.col("d") == 0)).alias("missing_det"),
        F.count_if((F.col("e") == 1) & (F.col("s") == 0)).alias("missing_sync"),
    )
    j = runs.join(sets, keys, "left").fillna(0, ["n_expected", "n_unexpected", "missing_det", "missing_sync"])
    c = F.col
    quiet = c("now_s") - c("last_activity_s")
    rules = [
        ("INVALID:error", F.coalesce(c("error"), F.lit("")) != ""),
        ("INVALID:budget", (c("budget") < 0) | (c("budget") >= F.greatest(c("expected_n"), F.lit(1)))),
        ("INVALID:drop_count", c("drops") < 0),
        ("INVALID:drops", c("drops") > 0),
        ("INVALID:expected", c("expected_n") <= 0),
        ("INVALID:stamp_count", c("n_expected") != c("expected_n")),
        ("INVALID:unexpected", c("n_unexpected") > 0),
        ("NOT_READY:missing_detections", c("missing_det") > 0),
        ("NOT_READY:missing_sync", c("missing_sync") > c("budget")),
        ("INVALID:duplicates", (c("det_rx") > c("expected_n")) | (c("sync_rx") > c("expected_n"))),
        ("NOT_READY:detections", c("det_rx") != c("expected_n")),
        ("NOT_READY:sync", c("sync_rx") < c("expected_n") - c("budget")),
        ("NOT_READY:inflight", c("inflight") != 0),
        ("NOT_READY:no_activity", c("last_activity_s").isNull()),
        ("NOT_READY:quiet", quiet < quiet_s),
    ]
    return j.select(*keys, first_reason(rules, "READY").alias("state"), (c("expected_n") - c("sync_rx")).alias("unsynced"))


def map_manifest_sha(image_sha: Column) -> Column:
    """Hash of the canonical map manifest.

    Columns: manifest_schema, resolution, origin, negate, free_thresh, occupied_thresh.
    """
    origin = F.array(*[map_number(F.col("origin")[i]) for i in range(3)])
    return canonical_sha(
        {
            "schema": F.col("manifest_schema"),
            "map_image_sha256": image_sha,
            "resolution": map_number(F.col("resolution")),
            "origin": origin,
            "negate": F.col("negate").cast("int"),
            "free_thresh": map_number(F.col("free_thresh")),
            "occupied_thresh": map_number(F.col("occupied_thresh")),
        }
    )


def check_map_identity(maps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Manifest fields and recomputed manifest hash of stored map identities."""
    c = F.col
    rules = [
        ("image", F.coalesce(c("image_sha"), F.lit("")) == ""),
        ("resolution", ~(is_finite(c("resolution")) & (c("resolution") > 0))),
        ("origin", ~((F.size("origin") >= 3) & all_finite(c("origin")))),
        ("yaw", F.abs(F.try_element_at("origin", F.lit(3))) > 1e-12),
        ("negate", ~c("negate").isin(0.0, 1.0)),
        ("thresholds", ~(is_finite(c("free_thresh")) & is_finite(c("occupied_thresh")) & (c("free_thresh") >= 0) & (c("free_thresh") < c("occupied_thresh")) & (c("occupied_thresh") <= 1))),
        ("image_sha", ~is_sha256(c("image_sha"))),
        ("manifest_sha", ~F.lower(F.trim(c("manifest_sha"))).eqNullSafe(c("_sha"))),
    ]
    return maps.withColumn("_sha", map_manifest_sha(c("image_sha"))).select(*keys, first_reason(rules).alias("reason"))


CORE_TABLES = [["chair", "table", "door"], ["door"]]  # fixed values: accepted required-label tables


def _artifact_rules(schema: str, hashes: Sequence[str]) -> list[tuple[str, Column]]:
    rules = [
        ("schema", ~schema_is(F.col("schema"), schema)),
        ("incomplete", ~F.coalesce("completed", F.lit(False))),
        ("frame", F.col("frame") != "map"),
        ("recording_token", ~is_token(F.col("recording_token"))),
    ]
    rules += [(h, ~is_sha256(F.col(h))) for h in hashes]
    rules += [("camera_mount", ~((F.size("camera_mount") == 6) & all_finite(F.col("camera_mount"))))]
    return rules


def check_objects(docs: DataFrame, keys: Sequence[str], schema: str = OBJECTS) -> DataFrame:
    rules = _artifact_rules(schema, ["source_bag_sha256", "map_image_sha256", "map_manifest_sha256"])
    rules += [("objects", F.col("n_objects").isNull())]
    return docs.select(*keys, first_reason(rules).alias("reason"))


def check_topology(docs: DataFrame, keys: Sequence[str], schema: str = TOPOLOGY) -> DataFrame:
    hashes = ["source_bag_sha256", "map_image_sha256", "map_manifest_sha256"]
    rules = _artifact_rules(schema, hashes) + [
        ("source_objects_sha256", ~is_sha256(F.col("source_objects_sha256"))),
        ("rooms", ~(F.col("n_rooms") > 0)),
        ("doors", F.col("n_doors").isNull()),
        ("topology", F.col("n_edges").isNull()),
        ("origin", ~((F.size("origin") >= 3) & all_finite(F.col("origin")) & (F.abs(F.try_element_at("origin", F.lit(3))) <= 1e-12))),
        ("resolution", ~(is_finite(F.col("resolution")) & (F.col("resolution") > 0))),
    ]
    return docs.select(*keys, first_reason(rules).alias("reason"))


def semantic_manifest_sha() -> Column:
    """Hash of the self-checking provenance manifest of a semantic map row."""
    contract = F.struct(
        F.col("poi_contract.complete").alias("complete"),
        F.col("poi_contract.observed_labels").alias("observed_labels"),
        F.col("poi_contract.required_labels").alias("required_labels"),
        F.col("poi_contract.schema").alias("schema"),
    )
    plain = ["schema", "completed", "recording_token"]
    hashes = ["source_bag_sha256", "map_image_sha256", "map_manifest_sha256", "objects_artifact_sha256", "topology_artifact_sha256", "semantic_content_sha256"]
    fields = {n: F.col(n) for n in plain}
    fields |= {n: F.lower(F.trim(F.col(n))) for n in hashes}
    return canonical_sha({**fields, "camera_mount": texts17(F.col("camera_mount")), "poi_contract": contract})


def check_semantic_map(docs: DataFrame, keys: Sequence[str], actual_labels: str = "actual_labels", schema: str = SEMANTIC_MAP, poi_schema: str = POI_CONTRACT) -> DataFrame:
    """Final map rows: fields, POI contract against the labels present, content and manifest checksum.

    ``content_sha`` is the hash recomputed from the stored content; ``actual_labels`` the sorted labels.
    """
    c = F.col
    tables = F.lit(False)
    for t in CORE_TABLES:
        tables = tables | c("poi_contract.required_labels").eqNullSafe(F.array(*[F.lit(x) for x in t]))
    hashes = ["source_bag_sha256", "map_image_sha256", "map_manifest_sha256", "objects_artifact_sha256", "topology_artifact_sha256"]
    rules = _artifact_rules(schema, hashes) + [
        ("rooms", ~(c("n_rooms") > 0)),
        ("poi_contract", ~(schema_is(c("poi_contract.schema"), poi_schema) & c("poi_contract.complete") & tables)),
        ("core_poi", F.size(F.array_except("poi_contract.required_labels", actual_labels)) > 0),
        ("observed_labels", ~c("poi_contract.observed_labels").eqNullSafe(c(actual_labels))),
        ("content_sha", ~F.lower(F.trim(c("semantic_content_sha256"))).eqNullSafe(c("content_sha"))),
        ("manifest_sha", ~F.lower(F.trim(c("semantic_manifest_sha256"))).eqNullSafe(c("_sha"))),
    ]
    return docs.withColumn("_sha", semantic_manifest_sha()).select(*keys, first_reason(rules).alias("reason"))


FORMAL_SOURCES = {  # fixed values: parameters a formal run must have
    "img_topic": "/stereo/left/image_raw/compressed",
    "left_image_base": "/stereo/left/image_raw",
    "right_image_base": "/stereo/right/image_raw",
    "camera_info_topic": "/stereo/left/camera_info",
    "disparity_topic": "/stereo/disparity",
    "optical_frame": "stereo_left_optical",
}
FORBIDDEN_FLAGS = ["detections_rectified", "stereo_lidar_fallback"]


def check_source_contract(params: DataFrame, runs: DataFrame, keys: Sequence[str], required: Mapping[str, str] = FORMAL_SOURCES, off: Sequence[str] = FORBIDDEN_FLAGS) -> DataFrame:
    """Run parameters (name, value) that differ from the required set, or flags that are on."""
    keys = list(keys)
    items = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("expected")) for k, v in [*required.items(), *[(f, "false") for f in off]]]))
    want = runs.select(*keys).distinct().select(*keys, items.alias("w")).select(*keys, "w.*")
    j = want.join(params.select(*keys, "name", "value"), [*keys, "name"], "left")
    flag = F.col("name").isin(*off)
    on = F.lower(F.trim(F.coalesce("value", F.lit("false")))).isin("true", "1")
    bad = F.when(flag, on).otherwise(~F.col("value").eqNullSafe(F.col("expected")))
    return j.where(bad).select(*keys, "name", "value", "expected")


def check_recording(chain: DataFrame, identities: DataFrame, edges: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """State chain, identity topics (map image and manifest) and camera transform of a run together.

    ``identities`` has topic ``map_image`` or ``map_manifest`` and the published ``value``.
    """
    keys = list(keys)
    norm = F.lower(F.trim(F.col("value")))

    def pick(topic: str, fn) -> Column:
        return fn(F.when(F.col("topic") == topic, norm))

    ids = identities.groupBy(*keys).agg(
        pick("map_image", F.min).alias("_i0"), pick("map_image", F.max).alias("_i1"),
        pick("map_manifest", F.min).alias("_m0"), pick("map_manifest", F.max).alias("_m1"),
    )
    tf = edges.withColumn("_ok", edge_matches()).groupBy(*keys).agg(F.bool_and("_ok").alias("tf_ok"))
    j = chain.join(ids, keys, "left").join(tf, keys, "left")
    c = F.col
    rules = [
        ("chain", c("reason") != "ok"),
        ("map_image_topic", c("_i0").isNull() | (c("_i0") != c("_i1")) | (c("_i0") != c("map_image_sha256"))),
        ("map_manifest_topic", c("_m0").isNull() | (c("_m0") != c("_m1")) | (c("_m0") != c("map_manifest_sha256"))),
        ("camera_tf", ~F.coalesce(c("tf_ok"), F.lit(False))),
    ]
    return j.select(*keys, first_reason(rules).alias("verdict"))


def check_clearance(rows: DataFrame, keys: Sequence[str], stale_s: float, longitudinal: float, rotation: float) -> DataFrame:
    """Readiness from message ages, the safety flag and scan minima, first reason wins."""
    c = F.col
    ahead = F.when(c("linear_speed").isNull(), c("min_longitudinal")).when(c("linear_speed") > 0, c("min_forward")).otherwise(c("min_backward"))
    rules = [
        ("no_safety", c("safety_stop").isNull()),
        ("safety_active", c("safety_stop")),
        ("scan_stale", c("scan_age_s").isNull() | (c("scan_age_s") > stale_s)),
        ("odom_stale", c("odom_age_s").isNull() | (c("odom_age_s") > stale_s)),
        ("scan_unusable", c("min_all").isNull() | c("min_longitudinal").isNull() | c("min_forward").isNull() | c("min_backward").isNull()),
        ("directional", ahead < longitudinal),
        ("rotation", c("min_all") < rotation),
    ]
    return rows.select(*keys, first_reason(rules, "ready").alias("reason"))


def check_startup(latest: DataFrame, loc: DataFrame, required: DataFrame, keys: Sequence[str], stale_ns: int) -> DataFrame:
    """Inputs present and fresh and enough consecutive good poses at the run's check time.

    ``latest`` has the newest stamp per topic, ``required`` the topics with ``now_ns``, ``loc`` one
    row per run with good_in_a_row, bad_samples, last_good, moving, stable_required.
    """
    keys = list(keys)
    j = required.join(latest, [*keys, "topic"], "left")
    g = j.groupBy(*keys).agg(
        F.count_if(F.col("last_ns").isNull()).alias("missing"),
        F.count_if(F.col("now_ns") - F.col("last_ns") > stale_ns).alias("stale"),
        F.max("now_ns").alias("now_ns"),
    ).join(loc, keys, "left")
    c = F.col
    good = (c("good_in_a_row") >= c("stable_required")) & (c("bad_samples") == 0) & c("last_good").isNotNull()
    fresh = ~c("moving") | (c("now_ns") - c("last_good") <= stale_ns)
    rules = [("missing", c("missing") > 0), ("stale", c("stale") > 0), ("localization", ~(good & fresh))]
    return g.select(*keys, "missing", "stale", first_reason(rules, "ready").alias("reason"))
