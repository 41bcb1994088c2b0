"""Exact percentiles per group without holding a group in one task.

Values are first counted per ``(group, value)``, which splits a hot group over its values. A monotone
log-scaled bin then gives a small cumulative table per group; only the bins that hold a wanted rank
are ranked value by value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_RESOLUTION = 65536.0


def _bin(value: Column) -> Column:
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * F.lit(_RESOLUTION))


def _ranks(method: str, q: float, n: Column) -> tuple[Column, Column, Column]:
    """Lower rank, upper rank and weight of the upper one (zero-based ranks)."""
    pos = F.lit(float(q)) * (n - 1)
    if method == "linear":
        low = F.floor(pos)
        return low, F.ceil(pos), pos - low
    if method == "nearest":  # round half to even of (n-1)q
        rank = F.rint(pos).cast("long")
        return rank, rank, F.lit(0.0)
    raise ValueError(f"unknown percentile method {method}")


def group_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: Mapping[str, float],
    method: str = "linear",
) -> DataFrame:
    """One row per group: ``keys``, ``n`` and one column per entry of ``wanted``."""
    keys = list(keys)
    v = F.col(value).cast("double")
    counted = (
        df.select(*keys, v.alias("_v"))
        .where(F.col("_v").isNotNull())
        .withColumn("_bin", _bin(F.col("_v")))
        .groupBy(*keys, "_bin", "_v")
        .agg(F.count("*").alias("_k"))
    )
    bins = counted.groupBy(*keys, "_bin").agg(F.sum("_k").alias("_m"))
    by_key = W.partitionBy(*keys)
    running = by_key.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.select(
        *keys,
        "_bin",
        "_m",
        F.coalesce(F.sum("_m").over(running), F.lit(0)).alias("_below"),
        F.sum("_m").over(by_key).alias("n"),
    )
    targets = {name: _ranks(method, q, F.col("n")) for name, q in wanted.items()}

    def inside(rank: Column, start: Column, size: Column) -> Column:
        return (rank >= start) & (rank < start + size)

    touched = F.lit(False)
    for low, high, _ in targets.values():
        touched = touched | inside(low, F.col("_below"), F.col("_m")) | inside(high, F.col("_below"), F.col("_m"))
    picked = counted.join(bins.where(touched), [*keys, "_bin"])
    in_bin = W.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    ranked = picked.withColumn("_start", F.col("_below") + F.coalesce(F.sum("_k").over(in_bin), F.lit(0)))
    aggs = [F.max("n").alias("n")]
    for name, (low, high, _) in targets.items():
        aggs.append(F.max(F.when(inside(low, F.col("_start"), F.col("_k")), F.col("_v"))).alias(f"_lo_{name}"))
        aggs.append(F.max(F.when(inside(high, F.col("_start"), F.col("_k")), F.col("_v"))).alias(f"_hi_{name}"))
    found = ranked.groupBy(*keys).agg(*aggs) if keys else ranked.agg(*aggs)
    out = []
    for name, (_, _, weight) in targets.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * weight).alias(name))
    return found.select(*keys, "n", *out)
