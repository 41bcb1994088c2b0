"""Binary grey images (P5) of cell tables, built as strips of bounded height."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from surveykit.operators.grid.cells import bounds


def strip_images(cells: DataFrame, background: int = 205, height: int = 256) -> DataFrame:
    """One image row per map and strip: map_id, image, content, negate, col0, row0.

    A strip holds ``height`` raster lines, so no row grows with the map. ``col0`` and ``row0`` are the
    grid position of the lower left pixel. Pure column expressions; pixels are joined as hex text.
    """
    h = F.lit(height)
    box = bounds(cells)
    lines = box.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("strip", F.floor((F.col("row") - F.col("r0")) / h))
    packed = cells.groupBy("map_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("_v"))
    pixel = lambda c: F.lpad(F.hex(F.coalesce(F.try_element_at(F.col("_v"), c), F.lit(background)).cast("bigint")), 2, "0")
    text = F.array_join(F.transform(F.sequence("c0", "c1"), pixel), "")
    full = lines.join(packed, ["map_id", "row"], "left").select("map_id", "strip", "row", "c0", "c1", text.alias("px"))
    strips = full.groupBy("map_id", "strip").agg(
        F.sort_array(F.collect_list(F.struct("row", "px")), asc=False).alias("_l"),
        F.min("row").alias("row0"),
        F.count("*").alias("_h"),
        F.max("c0").alias("col0"),
        F.max(F.col("c1") - F.col("c0") + 1).alias("_w"),
    )
    head = F.format_string("P5\n# cells\n%d %d\n255\n", F.col("_w"), F.col("_h"))
    body = F.unhex(F.array_join(F.transform("_l", lambda l: l["px"]), ""))
    name = F.concat_ws("-", F.col("map_id").cast("string"), F.col("strip").cast("string"))
    return strips.select(
        "map_id", F.concat(name, F.lit(".pgm")).alias("image"), F.concat(head.cast("binary"), body).alias("content"), F.lit(0).alias("negate"), "col0", "row0"
    )
