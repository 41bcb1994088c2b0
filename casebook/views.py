"""How the driver tables stand in for survey logs: once as DataFrames, once as SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from surveykit.functions.text import LABEL_SETS  # noqa: F401

DAY = 86_400_000_000_000
HOUR = 3_600_000_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def log(spark: SparkSession, sf: str) -> DataFrame:
    """events as a topic log: run = user, topic = event type, stamp in ns."""
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("topic"),
        ns.alias("stamp_ns"),
        F.col("event_id").alias("seq"),
        "value",
    )


LOG = """log AS (SELECT user_id AS run_id, event_type AS topic,
  CAST(epoch_us(ts) AS BIGINT) * 1000 AS stamp_ns, event_id AS seq, value FROM events)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("e")
    )


VEC = "vec AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def scans(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as laser scans of 64 beams, ranges = 10 |e|."""
    v = vectors(spark, sf)
    return v.select(
        (F.col("vec_id") % 20).alias("run_id"),
        F.col("vec_id").alias("scan_id"),
        F.lit(-3.141592653589793).alias("angle_min"),
        F.lit(3.141592653589793 / 32).alias("angle_increment"),
        F.lit(0.12).alias("range_min"),
        F.lit(3.0).alias("range_max"),
        F.transform("e", lambda x: F.abs(x) * 10.0).alias("ranges"),
    )


SCAN = VEC + """, scan AS (SELECT vec_id % 20 AS run_id, vec_id AS scan_id, -3.141592653589793::DOUBLE AS angle_min,
  (3.141592653589793::DOUBLE / 32) AS angle_increment, 0.12::DOUBLE AS range_min, 3.0::DOUBLE AS range_max,
  list_transform(e, lambda x: abs(x) * 10.0::DOUBLE) AS ranges FROM vec),
beam AS (SELECT run_id, scan_id, range_min, range_max, r, angle_min + (i - 1) * angle_increment AS a, i
  FROM (SELECT *, unnest(ranges) AS r, unnest(range(1, 65)) AS i FROM scan))"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as detection boxes, ten per frame."""
    e = lambda i: F.element_at("e", i)
    names = F.array(*[F.lit(n) for n in ("chair", "table", "door", "_window", "_wall")])
    return vectors(spark, sf).select(
        F.lit(0).cast("bigint").alias("run_id"),
        F.floor(F.col("vec_id") / 10).alias("stamp_ns"),
        (F.col("vec_id") % 10).alias("seq"),
        F.element_at(names, (F.col("label") % 5 + 1).cast("int")).alias("label"),
        F.least(F.lit(1.0), F.abs(e(5)) * 4.0).alias("score"),
        (F.lit(320.0) + e(1) * 100.0).alias("cx"),
        (F.lit(240.0) + e(2) * 100.0).alias("cy"),
        (F.lit(120.0) + e(3) * 100.0).alias("sx"),
        (F.lit(160.0) + e(4) * 100.0).alias("sy"),
        F.lit(640).alias("w"),
        F.lit(480).alias("h"),
    )


BOX = VEC + """, box AS (SELECT 0::BIGINT AS run_id, CAST(floor(vec_id / 10) AS BIGINT) AS stamp_ns, vec_id % 10 AS seq,
  (['chair','table','door','_window','_wall'])[label % 5 + 1] AS label,
  least(1.0::DOUBLE, abs(e[5]) * 4.0::DOUBLE) AS score,
  320.0::DOUBLE + e[1] * 100.0::DOUBLE AS cx, 240.0::DOUBLE + e[2] * 100.0::DOUBLE AS cy,
  120.0::DOUBLE + e[3] * 100.0::DOUBLE AS sx, 160.0::DOUBLE + e[4] * 100.0::DOUBLE AS sy, 640 AS w, 480 AS h FROM vec)"""



def iou_sql(a: str, b: str) -> str:
    """IoU of two aliased rows, as text."""
    ix = f"greatest(0.0::DOUBLE, least({a}.cx + {a}.sx/2, {b}.cx + {b}.sx/2) - greatest({a}.cx - {a}.sx/2, {b}.cx - {b}.sx/2))"
    iy = f"greatest(0.0::DOUBLE, least({a}.cy + {a}.sy/2, {b}.cy + {b}.sy/2) - greatest({a}.cy - {a}.sy/2, {b}.cy - {b}.sy/2))"
    inter = f"({ix} * {iy})"
    area = lambda r: (
        f"(greatest(0.0::DOUBLE, ({r}.cx + {r}.sx/2) - ({r}.cx - {r}.sx/2)) * greatest(0.0::DOUBLE, ({r}.cy + {r}.sy/2) - ({r}.cy - {r}.sy/2)))"
    )
    union = f"({area(a)} + {area(b)} - {inter})"
    return f"(CASE WHEN {union} > 0 THEN {inter} / {union} ELSE 0.0::DOUBLE END)"


def points(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as map sightings: x, y in metres, five per frame."""
    return vectors(spark, sf).select(
        (F.col("vec_id") % 4).alias("run_id"),
        F.floor(F.col("vec_id") / 20).alias("stamp_ns"),
        F.col("vec_id").alias("seq"),
        F.concat(F.lit("class"), (F.col("label") % 5).cast("string")).alias("label"),
        (F.col("label") % 5).cast("int").alias("cid"),
        (F.element_at("e", 1) * 10.0).alias("x"),
        (F.element_at("e", 2) * 10.0).alias("y"),
    )


PTS = VEC + """, pts AS (SELECT vec_id % 4 AS run_id, CAST(floor(vec_id / 20) AS BIGINT) AS stamp_ns, vec_id AS seq,
  'class' || CAST(label % 5 AS VARCHAR) AS label, CAST(label % 5 AS INTEGER) AS cid,
  e[1] * 10.0::DOUBLE AS x, e[2] * 10.0::DOUBLE AS y FROM vec)"""

CELL_SHIFT = 64


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as four occupancy grids: element pairs hit cells; one hit = occupied, more = free."""
    pairs = vectors(spark, sf).select(
        (F.col("vec_id") % 4).alias("map_id"),
        F.explode(F.sequence(F.lit(1), F.lit(63), F.lit(2))).alias("k"),
        "e",
    )
    at = lambda off: (F.floor(F.element_at("e", F.col("k") + off) * 80.0) + CELL_SHIFT).cast("int")
    hits = pairs.select("map_id", at(0).alias("col"), at(1).alias("row")).groupBy("map_id", "col", "row").count()
    return hits.select("map_id", "col", "row", F.when(F.col("count") >= 2, 0).otherwise(100).alias("value"))


CELLS = VEC + """, hit AS (SELECT vec_id % 4 AS map_id, CAST(floor(e[k] * 80.0::DOUBLE) AS INTEGER) + 64 AS col,
  CAST(floor(e[k + 1] * 80.0::DOUBLE) AS INTEGER) + 64 AS "row"
  FROM vec, (SELECT unnest(range(1, 64, 2)) AS k)),
cells AS (SELECT map_id, col, "row", CASE WHEN count(*) >= 2 THEN 0 ELSE 100 END AS value FROM hit GROUP BY ALL)"""
