"""Ordered scans that never put a whole run into one task.

A plain ``Window.partitionBy(run)`` sends a run that holds a third of the archive through one task.
Here a run is cut into time buckets of a fixed width. Window functions run per ``(run, bucket)``;
one summary row per bucket carries the running state across buckets. The summary table has
``rows / bucket`` rows, so its per-run window stays small. Results equal the plain window exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BUCKET = "_bucket"
SECOND = 1_000_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


@dataclass(frozen=True)
class Timeline:
    """Keys that name one sequence, its total order, and the bucket width (unit of ``order[0]``)."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    width: int

    def bucket(self) -> Column:
        return F.floor(F.col(self.order[0]) / F.lit(self.width))

    def position(self) -> Column:
        return F.struct(*[F.col(c) for c in self.order])


@dataclass(frozen=True)
class Step:
    """One output column of a scan.

    kind: ``lag`` / ``lead`` (neighbouring row, nulls included), ``last`` / ``next`` (nearest
    non-null, this row included), ``prev`` / ``following`` (nearest non-null, this row excluded),
    ``sum`` / ``max`` / ``count`` (running, this row included), ``max_prev`` (this row excluded).
    """

    out: str
    kind: str
    expr: Column


_FORWARD = {"lead", "next", "following"}


def scan(df: DataFrame, line: Timeline, steps: Sequence[Step]) -> DataFrame:
    keys = list(line.keys)
    names = [s.out for s in steps]
    work = df.withColumn(BUCKET, line.bucket())
    for s in steps:
        work = work.withColumn(f"_e_{s.out}", s.expr)
    order = [F.col(c) for c in line.order]
    part = W.partitionBy(*keys, BUCKET).orderBy(*order)
    upto = part.rowsBetween(W.unboundedPreceding, 0)
    before = part.rowsBetween(W.unboundedPreceding, -1)
    # a frame that ends at the partition's end is read anew for every row; one that begins there, backwards, is not
    back = W.partitionBy(*keys, BUCKET).orderBy(*[c.desc() for c in order])
    onward = back.rowsBetween(W.unboundedPreceding, 0)
    after = back.rowsBetween(W.unboundedPreceding, -1)
    local, summary = [], []
    for s in steps:
        e = F.col(f"_e_{s.out}")
        boxed = F.struct(e.alias("v"))
        here = F.when(e.isNotNull(), boxed)
        pos = F.when(e.isNotNull(), line.position())
        if s.kind == "lag":
            local.append(F.lag(boxed).over(part))
            summary.append(F.max_by(boxed, line.position()))
        elif s.kind == "lead":
            local.append(F.lead(boxed).over(part))
            summary.append(F.min_by(boxed, line.position()))
        elif s.kind in ("last", "prev"):
            local.append(F.last(here, ignorenulls=True).over(upto if s.kind == "last" else before))
            summary.append(F.max_by(here, pos))
        elif s.kind in ("next", "following"):
            local.append(F.last(here, ignorenulls=True).over(onward if s.kind == "next" else after))
            summary.append(F.min_by(here, pos))
        elif s.kind in ("sum", "count"):
            local.append(F.sum(e).over(upto) if s.kind == "sum" else F.count(e).over(upto))
            summary.append(F.sum(e) if s.kind == "sum" else F.count(e))
        elif s.kind in ("max", "max_prev"):
            local.append(F.max(e).over(upto if s.kind == "max" else before))
            summary.append(F.max(e))
        else:
            raise ValueError(f"unknown step kind {s.kind}")
    rows = work.select("*", *[c.alias(f"_l_{n}") for n, c in zip(names, local)])
    totals = work.groupBy(*keys, BUCKET).agg(*[c.alias(f"_s_{n}") for n, c in zip(names, summary)])
    by_bucket = W.partitionBy(*keys).orderBy(BUCKET)
    past = by_bucket.rowsBetween(W.unboundedPreceding, -1)
    future = W.partitionBy(*keys).orderBy(F.col(BUCKET).desc()).rowsBetween(W.unboundedPreceding, -1)
    carried = []
    for s in steps:
        c = F.col(f"_s_{s.out}")
        if s.kind in _FORWARD:
            carried.append(F.last(c, ignorenulls=True).over(future))
        elif s.kind in ("sum", "count"):
            carried.append(F.sum(c).over(past))
        elif s.kind in ("max", "max_prev"):
            carried.append(F.max(c).over(past))
        else:
            carried.append(F.last(c, ignorenulls=True).over(past))
    carry = totals.select(*keys, BUCKET, *[c.alias(f"_c_{n}") for n, c in zip(names, carried)])
    joined = _null_safe_join(rows, carry, [*keys, BUCKET])
    out = []
    for s in steps:
        here, held = F.col(f"_l_{s.out}"), F.col(f"_c_{s.out}")
        if s.kind in ("sum", "count"):
            value = F.coalesce(here, F.lit(0)) + F.coalesce(held, F.lit(0))
        elif s.kind in ("max", "max_prev"):
            value = F.greatest(here, held)
        else:
            value = F.coalesce(here, held)["v"]
        out.append(value.alias(s.out))
    keep = [c for c in df.columns if c not in names]
    return joined.select(*keep, *out)


def _null_safe_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join on equal keys, a null key being equal to a null one."""
    held = right.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in right.columns if c not in on])
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return left.join(held, reduce(and_, same), "left").drop(*[f"_on_{c}" for c in on])


def islands(df: DataFrame, line: Timeline, starts: Column, out: str) -> DataFrame:
    """Number the maximal stretches; ``starts`` is true on the first row of each stretch."""
    return scan(df, line, [Step(out, "sum", F.when(starts, 1).otherwise(0))])


def with_halo(df: DataFrame, line: Timeline, before: int, after: int) -> DataFrame:
    """Copy each row into every bucket whose rows may look at it; ``_home`` marks the original.

    A row in bucket ``b`` looks back ``before`` and ahead ``after`` units. Rows are copied only to the
    buckets within reach, so the growth is ``(before + after) / width``.
    """
    t = F.col(line.order[0])
    first = F.floor((t - F.lit(after)) / F.lit(line.width))
    last = F.floor((t + F.lit(before)) / F.lit(line.width))
    return (
        df.withColumn("_own", line.bucket())
        .withColumn(BUCKET, F.explode(F.sequence(first, last)))
        .withColumn("_home", F.col("_own") == F.col(BUCKET))
        .drop("_own")
    )
