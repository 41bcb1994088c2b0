"""Packing documents into sequences: first-fit decreasing in randomised groups of documents.

A text's ids are cut at the sequence length; whole cuts fill a sequence each and need no packing. The rest of each
document is packed by first-fit decreasing. A tournament tree over the bins holds the largest free room below each
node, so the first bin with room is found by walking down once. Groups are dealt by a hash, hold a bounded number of
documents on average and are packed apart from each other, each in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from surveykit.llm.bpe import encoded, forget, public_vocabulary, slices
from surveykit.llm.registry import query, table
from surveykit.session import settle

ROOM = 2048
GROUP = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Bins in a row; ``first(size)`` is the leftmost with that much room, ``take`` uses some of it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.free = [room] * (2 * self.leaves)

    def first(self, size: int) -> int:
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        return node - self.leaves

    def take(self, at: int, size: int) -> None:
        free, node = self.free, at + self.leaves
        free[node] -= size
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])


def first_fit_decreasing(sizes: Sequence[int], room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in the bin of each size (1 to ``room``); equal sizes keep their order."""
    sizes = np.asarray(sizes, dtype=np.int64)
    bins, places, tree = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), Tournament(len(sizes), room)
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        at = tree.first(size)
        bins[k], places[k] = at, room - tree.free[at + tree.leaves]
        tree.take(at, size)
    return bins, places


def token_pieces(docs: DataFrame, vocabulary: str, end: int, room: int = ROOM) -> DataFrame:
    """``doc_id, doc_tokens, crcs``: the checksums of the document's cuts, whole ones first."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 4 * room
        for batch in slices(batches):
            counts, crcs = [], []
            for ids in encoded(batch.column("text").to_pylist(), vocabulary, end):
                counts.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[k : k + step]) for k in range(0, len(ids), step)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["doc_id", "doc_tokens", "crcs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, doc_tokens long, crcs array<long>")


def packed(key: tuple, rows: pd.DataFrame, room: int) -> pd.DataFrame:
    """The pieces of a group's documents. Pieces of text are not looked up any more here, and their table is given back."""
    forget()
    rows = rows.sort_values(["doc_id", "deal"], kind="stable")
    tokens = rows["doc_tokens"].to_numpy()
    left, whole = tokens % room, tokens // room
    some = np.flatnonzero(left)
    bins, places = first_fit_decreasing(left[some], room)
    used = int(bins.max()) + 1 if len(bins) else 0
    base = int(key[0]) << 32
    n = whole + (left > 0)
    of = np.repeat(np.arange(len(rows)), n)
    cut = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    last = left[of] * (cut == whole[of])
    sequence, offset = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    sequence[last > 0], offset[last > 0] = base + bins, places
    sequence[last == 0] = base + used + np.arange(int((last == 0).sum()))
    return pd.DataFrame(
        {
            "doc_id": rows["doc_id"].to_numpy()[of],
            "start": cut * room,
            "length": np.where(last > 0, last, room),
            "ids_crc32": np.concatenate([*rows["crcs"], np.zeros(0, np.int64)]).astype(np.int64),
            "doc_tokens": tokens[of],
            "sequence_id": sequence,
            "offset": offset,
        }
    )


def pack(docs: DataFrame, vocabulary: str, end: int, room: int = ROOM, group: int = GROUP, seed: int = 0) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    A null or empty text is its end id alone. Null and repeated ids are packed like others, row by row; an empty table
    gives no rows; further columns are not read. The deal depends on the rows and on how the input is split.
    """
    cuts = settle(token_pieces(docs, vocabulary, end, room).withColumn("deal", F.xxhash64("doc_id", "crcs", F.monotonically_increasing_id(), F.lit(seed))))
    groups = max(1, -(-cuts.count() // group))

    return cuts.withColumn("grp", F.pmod("deal", F.lit(groups))).groupBy("grp").applyInPandas(lambda key, rows: packed(key, rows, room), PIECES)


VOCABULARY, END = "byte_bpe_50k.json", 1


@query("op7_pack_sequences")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_vocabulary(VOCABULARY), END)
