"""Exact distributed form of a left fold over a long sequence.

Some rules (pair the oldest, keep a pose when it is far enough from the last *kept* pose) depend on
all earlier rows. Each time bucket is folded on its own, starting from a guessed state. Then every
bucket whose guess differs from what its predecessor really produced is folded again, until all
guesses hold. The result is the sequential one; most rules forget their past within a bucket, so the
loop ends after two or three rounds. At worst it takes one round per bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from surveykit.operators.ordered import BUCKET, Timeline
from surveykit.session import settle

# rows of one bucket as tuples (order columns, then the extra columns) and the state
Fold = Callable[[list[tuple], list[float]], tuple[list[tuple], list[float]]]
CHUNK = 4096  # rows per Arrow batch handed back
Group = tuple[tuple, list[tuple], list[float]]


def _groups(batches: Iterator[pd.DataFrame], n_keys: int) -> Iterator[Group]:
    """Consecutive rows of one (keys, bucket) from sorted Arrow batches; the state is the last column."""
    current: tuple | None = None
    held: list[tuple] = []
    state: list[float] = []
    for pdf in batches:
        for row in zip(*[pdf[c].tolist() for c in pdf.columns]):
            group = row[:n_keys]
            if group != current:
                if current is not None:
                    yield current, held, state
                current, held, state = group, [], [float(v) for v in row[-1]]
            held.append(row[n_keys:-1])
    if current is not None:
        yield current, held, state


def fold(df: DataFrame, line: Timeline, step: Fold, out_columns: Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    """Run ``step(rows, state) -> (output rows, new state)`` over every sequence.

    ``state`` is a list of doubles, empty at the start of a sequence. ``out_columns`` is the DDL of the
    output rows, which follow the key columns. ``columns`` are the extra columns Python receives.
    """
    keys, order = list(line.keys), list(line.order)
    need = [*order, *[c for c in columns if c not in order]]
    rows = settle(df.select(*keys, line.bucket().alias(BUCKET), *need))
    group = [*keys, BUCKET]
    width = len(group)
    ddl = {f.name: f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema}
    group_ddl = ", ".join(ddl[c] for c in group)
    empty = F.expr("cast(array() as array<double>)")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = []
        for key, held, state in _groups(batches, width):
            found.append((*key, state, list(step(held, list(state))[1])))
            if len(found) >= CHUNK:
                yield pd.DataFrame(found, columns=[*group, "state_in", "state_out"])
                found = []
        yield pd.DataFrame(found, columns=[*group, "state_in", "state_out"])

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = []
        for key, held, state in _groups(batches, width):
            found += [(*key[:-1], *r) for r in step(held, list(state))[0]]
            if len(found) >= CHUNK:
                yield pd.DataFrame(found, columns=[*keys, *names])
                found = []
        yield pd.DataFrame(found, columns=[*keys, *names])

    names = [c.strip().split(" ")[0] for c in ", ".join(out_columns).split(", ")]

    def with_state(todo: DataFrame | None) -> DataFrame:
        started = rows.withColumn("_s", empty) if todo is None else rows.join(todo.withColumnRenamed("state_in", "_s"), group)
        # a fixed number of parts: Python work is not to be merged into few tasks because it is small in bytes
        return started.select(*group, *need, "_s").repartition(parts, *group).sortWithinPartitions(*group, *order)

    known, todo = None, None
    while True:
        fresh = with_state(todo).mapInPandas(ends, f"{group_ddl}, state_in array<double>, state_out array<double>")
        known = settle(fresh if known is None else known.join(todo.select(*group), group, "left_anti").unionByName(fresh))
        chain = W.partitionBy(*keys).orderBy(BUCKET)  # one row per bucket
        truth = known.withColumn("want", F.coalesce(F.lag("state_out").over(chain), empty))
        wrong = truth.where(~F.col("want").eqNullSafe(F.col("state_in")))
        todo = settle(wrong.select(*group, F.col("want").alias("state_in")))
        if todo.isEmpty():
            break
    final = with_state(known.select(*group, "state_in"))
    key_ddl = ", ".join(ddl[c] for c in keys)
    return final.mapInPandas(emit, f"{key_ddl}, {', '.join(out_columns)}")
