"""Readers for topic logs, detection documents, occupancy maps, status events and point documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DETECTION_DOCUMENT = (
    "schema string, complete boolean, recording_token string, source_bag_sha256 string, map_image_sha256 string, "
    "map_manifest_sha256 string, classes array<string>, camera_mount array<double>, image_topic string, "
    "frames array<struct<stamp_ns: bigint, w: int, h: int, skipped_blur: boolean, "
    "dets: array<struct<cls: int, label: string, score: double, cx: double, cy: double, sx: double, sy: double>>>>"
)
STATUS = (
    "schema int, state string, token string, reason string, map_image_sha256 string, "
    "map_manifest_sha256 string, camera_mount string, pose_source string"
)
POI_DOCUMENT = (
    "run_id string, schema string, completed boolean, frame string, recording_token string, "
    "objects array<struct<label: string, class_id: int, x: double, y: double, hits: int, spread_m: double>>"
)


def read_messages(spark: SparkSession, path: str, topics: Sequence[str]) -> DataFrame:
    """Selected topics of a log stored as Parquet partitioned by run and topic; pruned at the scan."""
    return select_topics(spark.read.parquet(path), topics)


def select_topics(messages: DataFrame, topics: Sequence[str]) -> DataFrame:
    return messages.where(F.col("topic").isin(*topics))


def read_detections(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headers, frames (also those without boxes) and boxes of detection documents."""
    doc = spark.read.schema(DETECTION_DOCUMENT).option("multiLine", True).json(path).withColumn(
        "source", F.input_file_name()
    )
    return detection_tables(doc)


def detection_tables(doc: DataFrame, key: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    header = doc.drop("frames")
    frames = doc.select(key, F.posexplode_outer("frames").alias("frame_no", "f")).select(
        key, "frame_no", "f.stamp_ns", "f.w", "f.h", "f.skipped_blur", F.col("f.dets").alias("dets")
    )
    boxes = frames.select(key, "stamp_ns", "w", "h", F.posexplode("dets").alias("seq", "d")).select(
        key, "stamp_ns", "w", "h", "seq", "d.*"
    )
    return header, frames.drop("dets"), boxes


def _pgm_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Binary grey images (P5, comment lines allowed) to one row per raster line, row 0 on top."""
    for pdf in batches:
        for path, data in zip(pdf["path"], pdf["content"]):
            fields, at = [], 0
            while len(fields) < 4:
                end = at
                while end < len(data) and data[end : end + 1] not in b" \t\r\n":
                    end += 1
                word = data[at:end]
                if word.startswith(b"#"):
                    while end < len(data) and data[end : end + 1] != b"\n":
                        end += 1
                elif word:
                    fields.append(word)
                at = end + 1
            width, height = int(fields[1]), int(fields[2])
            grid = np.frombuffer(data, dtype=np.uint8, count=width * height, offset=at).reshape(height, width)
            for start in range(0, height, 256):
                part = grid[start : start + 256]
                yield pd.DataFrame(
                    {
                        "path": path,
                        "line": np.arange(start, start + len(part), dtype="int32"),
                        "height": height,
                        "pixels": [line.astype("int32") for line in part],
                    }
                )


def read_cells(spark: SparkSession, path: str, maps: DataFrame) -> DataFrame:
    """Map images below ``path`` to ``cells(map_id, col, row, value)`` with row 0 at the bottom."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pgm").load(path)
    return image_cells(files.select(F.element_at(F.split("path", "/"), -1).alias("image"), "content"), maps)


def image_cells(files: DataFrame, maps: DataFrame) -> DataFrame:
    """``files(image, content)`` and ``maps(map_id, image, negate[, col0, row0])`` to cells.

    Only the file bytes pass through Python, which cuts them into raster lines; the cells are exploded
    on the JVM side. ``col0`` and ``row0`` place a strip inside its map.
    """
    lines = files.select(F.col("image").alias("path"), "content").mapInPandas(_pgm_rows, "path string, line int, height int, pixels array<int>")
    origin = [F.col(c) if c in maps.columns else F.lit(0).alias(c) for c in ("col0", "row0")]
    named = lines.withColumnRenamed("path", "image").join(maps.select("map_id", "image", "negate", *origin), "image")
    flat = named.select(
        "map_id", "negate", "col0", (F.col("row0") + F.col("height") - 1 - F.col("line")).alias("row"), F.posexplode("pixels").alias("_c", "_v")
    )
    value = F.when(F.col("negate") == 1, 255 - F.col("_v")).otherwise(F.col("_v"))
    return flat.select("map_id", (F.col("col0") + F.col("_c")).alias("col"), "row", value.alias("value"))


def status_events(events: DataFrame, payload: Column | str = "payload") -> DataFrame:
    """Parsed status records of schema 1; unreadable payloads are dropped."""
    record = F.from_json(payload, STATUS, {"mode": "PERMISSIVE"})
    keep = [c for c in events.columns if c != "payload"]
    return events.select(*keep, record.alias("s")).where("s is not null and s.schema = 1").select(*keep, "s.*")


def read_poi_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Doors and other points of point documents (JSON lines)."""
    doc = spark.read.schema(POI_DOCUMENT).json(path)
    return split_poi(doc.select("run_id", F.posexplode("objects").alias("ord", "o")).select("run_id", "ord", "o.*"))


def split_poi(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels that contain "door", and the rest."""
    is_door = F.contains(F.lower(F.coalesce("label", F.lit(""))), F.lit("door"))
    return points.where(is_door), points.where(~is_door)
