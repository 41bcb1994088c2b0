"""Connected components of an edge table by alternating star contraction.

Each round links every vertex to the smallest vertex it can see. The number of rounds grows with the
logarithm of the component size, and every round is two joins on vertex ids, so one huge component
is spread over all tasks (hot ids are split by the adaptive skew join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from surveykit.session import discard, settle


def _both_ways(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    flipped = edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))
    return edges.select(*keys, "a", "b").unionByName(flipped)


def _large_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    near = _both_ways(edges, keys)
    low = near.groupBy(*keys, "a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        near.where(F.col("b") > F.col("a"))
        .join(low, [*keys, "a"])
        .select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        .where("a <> b")
        .distinct()
    )


def _small_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    down = edges.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy(*keys, "a").agg(F.min("b").alias("m"))
    moved = down.join(low, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select(*keys, "a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``edges(keys.., a, b)`` to ``(keys.., id, root)`` for vertices that have an edge.

    ``root`` is the smallest id of the component. Isolated vertices are their own root and are left
    to the caller. The loop ends when a round no longer changes the edge set.
    """
    keys = list(keys)
    current = settle(edges.select(*keys, "a", "b").where("a <> b").distinct())
    seen = None
    while True:
        mark = current.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if seen == (mark.n, mark.h):
            break
        seen = (mark.n, mark.h)
        if mark.n == 0:
            break
        before, current = current, settle(_small_star(_large_star(current, keys), keys))
        discard(before)
    roots = current.groupBy(*keys, F.col("a").alias("id")).agg(F.min("b").alias("root"))
    tops = current.select(*keys, F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return roots.unionByName(tops)
