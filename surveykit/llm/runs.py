"""Runs of rows with one key in batches that are sorted by key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def key_runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """One table per run of equal (not null) integer keys, joined across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = tuple(values[:, a].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal (not null) integer keys, about one a batch, and where each run begins and ends."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        held = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
        cuts = _starts(held, keys)
        if len(cuts) > 1:
            yield held.slice(0, cuts[-1]).combine_chunks(), cuts
            held = held.slice(cuts[-1])
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _starts(rows: pa.Table, keys: Sequence[str]) -> np.ndarray:
    values = np.stack([rows.column(k).to_numpy() for k in keys])
    return np.concatenate([[0], np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1])
