"""Time headline queries: ``BENCH_SF_DIR`` (default sf0.1) on ``local[BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import casebook  # noqa: E402
from surveykit.session import build_session  # noqa: E402

HEADLINE = [
    "agg_topic_counts",
    "agg_pose_motion",
    "agg_scan_quality",
    "win_staleness",
    "win_step_detect",
    "win_localization_health",
    "join_nearest_tol",
    "join_tf_asof",
    "join_gate_one_to_one",
    "win_nms",
    "win_ambiguity",
    "agg_roi_depth",
    "agg_track",
    "win_track_associate",
    "join_point_in_polygon",
    "cell_components",
    "cell_distance",
    "region_adjacency",
    "chk_ready",
    "anti_missing_stamp",
    "st_drift",
    "join_approx_sync",
    "win_poi_dedupe",
    "cell_fill_nearest",
    "critical_cut",
    "place_detections",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    casebook.load_all()
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    casebook.QUERIES["agg_topic_counts"](spark, sf).write.format("noop").mode("overwrite").save()  # warm up
    took = {}
    for name in names:
        start = time.perf_counter()
        casebook.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_query_seconds", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
