"""Token counts without token ids: pieces are counted once per distinct pre-token and summed by frequencies.

No piece of the vocabulary has a blank after another character, and none longer than one character has a line feed.
So a text falls into pre-tokens whose pieces never touch each other: a run of blanks with what follows it, a line feed,
or what follows a line feed. A text's count is the sum over its pre-tokens of their counts.

Documents are cut into slices of a bounded number of pre-tokens. A slice numbers its distinct pre-tokens and keeps its
documents as packed frequencies of those numbers. Its pre-tokens go out in buckets by checksum, so all slices' equal
pre-tokens meet in one task, which has the library count each of them once and answers every slice with counts in the
order it asked. The answers join the packed frequencies by slice. A pre-token that every text holds comes once per slice.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from surveykit.llm.bpe import public_vocabulary, slices
from surveykit.llm.registry import query, table
from surveykit.llm.runs import key_runs
from surveykit.llm.token_files import pack_values, unpack_values
from surveykit.session import settle

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
#: pre-tokens of a slice; the document that passes it ends the slice
SLICE = 4_000_000
#: what stands for a blank in the vocabulary, also where a text holds it
BLANK = "▁"
_PRE_TOKEN = re.compile(r" +[^ \n]*|\n|[^ \n]+")
_OPEN: dict[str, PieceCounts] = {}


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens in order, blanks as spaces; the library puts one blank before any text that isn't empty."""
    return _PRE_TOKEN.findall(" " + text.replace(BLANK, " ")) if text else []


class PieceCounts:
    """Counts the pieces of pre-tokens with the library's own encoder."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        vocabulary = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        if any(len(p) > 1 and "\n" in p or re.search(f"[^{BLANK}]{BLANK}", p) for p in vocabulary):
            raise ValueError("pieces of this vocabulary cross the cuts between pre-tokens")
        self.head = len(self.model.encode("\n", num_threads=1))
        probe = "  Two  words,\n\nÉté ﬁ一\x00 ▁\n <s> end "
        if self.of(pre_tokens(probe)).sum() != len(self.model.encode(probe, num_threads=1)):
            raise ValueError("this vocabulary changes texts before it cuts them")

    def of(self, pieces: Iterable[str]) -> np.ndarray:
        """Each piece is encoded behind a line feed, which it never joins."""
        coded = self.model.encode(["\n" + p for p in pieces], num_threads=1)
        return np.array([len(ids) - self.head for ids in coded], np.int64)


def open_counts(path: str) -> PieceCounts:
    """One per worker and vocabulary file."""
    if path not in _OPEN:
        _OPEN[path] = PieceCounts(path)
    return _OPEN[path]


def _packed(values: np.ndarray) -> bytes:
    """Values and their number, squeezed: most of them take one byte, and runs of equal bytes next to none."""
    control, data = pack_values(values)
    return pa.compress(np.array([len(values), len(control)], "<i8").tobytes() + control + data, codec="zstd", asbytes=True)


def _unpacked(squeezed: bytes) -> np.ndarray:
    whole = _opened(squeezed)
    n, size = np.frombuffer(whole, "<i8", 2)
    return unpack_values(np.frombuffer(whole, np.uint8, size, 16), np.frombuffer(whole, np.uint8, -1, 16 + size), n).astype(np.int64)


def _opened(squeezed: bytes) -> bytes:
    with pa.input_stream(pa.py_buffer(squeezed), compression="zstd") as whole:
        return whole.read()


_TYPES = {"slice": pa.int64(), "bucket": pa.int32(), "pieces": pa.binary(), "doc_ids": pa.list_(pa.int64()), "n_bytes": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "gaps": pa.binary(), "times": pa.binary()}
_FIELDS = "slice long, bucket int, pieces binary, doc_ids array<long>, n_bytes array<long>, sizes array<int>, gaps binary, times binary"


def _filled(n: int, **columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in _TYPES.items()], list(_TYPES))


class _Slice:
    """Documents in a row, until they are many enough."""

    def __init__(self, name: int):
        self.name = name
        self.known: dict[str, int] = {}
        self.docs: list[tuple[int | None, int, int]] = []
        self.pieces: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str) -> None:
        pieces = pre_tokens(text)
        known = self.known
        for p in set(pieces).difference(known):
            known[p] = len(known)
        self.pieces.append(np.fromiter(map(known.__getitem__, pieces), np.int32, len(pieces)))
        self.docs.append((doc_id, len(text.encode()), len(pieces)))
        self.size += len(pieces)

    def batches(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """A row with the documents, then a row for each bucket of pre-tokens; those are numbered bucket by bucket."""
        pieces = np.array(list(self.known), dtype=object)
        bucket = np.fromiter((zlib.crc32(p.encode()) % buckets for p in pieces), np.int64, len(pieces))
        order = np.array(sorted(range(len(pieces)), key=pieces.__getitem__), np.int64)
        order = order[np.argsort(bucket[order], kind="stable")]
        number = np.empty(len(pieces), np.int64)
        number[order] = np.arange(len(pieces))
        ids, n_bytes, lengths = zip(*self.docs, strict=True)
        row = np.repeat(np.arange(len(ids)), lengths)
        wide = max(1, len(pieces))
        place, times = np.unique(row * wide + number[np.concatenate(self.pieces)], return_counts=True)
        row, place = place // wide, place % wide
        sizes = np.bincount(row, minlength=len(ids))
        gaps = np.diff(place, prepend=0)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        gaps[starts] = place[starts]
        yield _filled(1, slice=[self.name], doc_ids=[ids], n_bytes=[n_bytes], sizes=[sizes], gaps=[_packed(gaps)], times=[_packed(times)])
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            blob = "\n".join(["" if p == "\n" else p for p in pieces[order[cuts[b] : cuts[b + 1]]]])
            yield _filled(1, slice=[self.name], bucket=[b], pieces=[pa.compress(blob.encode(), codec="zstd", asbytes=True)])


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, size: int = SLICE, buckets: int | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs`` (``doc_id, text``).

    ``path`` is a sentencepiece model that every executor has. ``buckets``: tasks among which distinct pre-tokens are
    dealt, the session's shuffle partitions if not stated; each holds the distinct pre-tokens of one bucket. A null text
    counts as an empty one, which has no bytes and no tokens. Rows with a null or repeated id are counted one by one;
    other columns are not read. An empty table gives no rows. Texts are never cut: one longer than ``size`` pre-tokens
    ends its slice.
    """
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        now = _Slice(name)
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                now.add(doc_id, text or "")
                if now.size >= size:
                    yield from now.batches(buckets)
                    name += 1
                    now = _Slice(name)
        if now.docs:
            yield from now.batches(buckets)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, bucket, known = open_counts(path), None, {}
        for batch in slices(batches, 1):
            here = batch.column("bucket")[0].as_py()
            if here != bucket:
                bucket, known = here, {}
            pieces = _opened(batch.column("pieces")[0].as_py()).decode().split("\n")
            new = [p for p in pieces if p not in known]
            for k in range(0, len(new), 4096):
                part = new[k : k + 4096]
                known.update(zip(part, counts.of([p or "\n" for p in part]).tolist(), strict=True))
            answer = _packed(np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces)))
            yield pa.RecordBatch.from_arrays([batch.column("slice"), batch.column("bucket"), pa.array([answer], pa.binary())], ["slice", "bucket", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in key_runs(batches, ["slice"]):
            counts = [_unpacked(c) for c in rows.column("counts").to_pylist() if c is not None]
            n_of = np.concatenate([np.zeros(0, np.int64), *counts])
            (own,) = rows.filter(rows.column("counts").is_null()).select(["doc_ids", "n_bytes", "sizes", "gaps", "times"]).to_pylist()
            ends = np.concatenate([[0], np.cumsum(own["sizes"])])
            gaps = _unpacked(own["gaps"])
            # numbers start anew with each document
            ahead = np.concatenate([[0], np.cumsum(gaps)])
            numbers = ahead[1:] - np.repeat(ahead[ends[:-1]], own["sizes"])
            sums = np.concatenate([[0], np.cumsum(n_of[numbers] * _unpacked(own["times"]))])
            yield pa.RecordBatch.from_arrays([pa.array(own["doc_ids"], pa.int64()), pa.array(own["n_bytes"], pa.int64()), pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    cut = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sliced, _FIELDS))
    asked = cut.where("bucket IS NOT NULL").select("bucket", "slice", "pieces").repartition("bucket").sortWithinPartitions("bucket", "slice")
    answers = asked.mapInArrow(counted, "slice long, bucket int, counts binary")
    own = cut.where("bucket IS NULL").drop("pieces", "bucket")
    met = own.unionByName(answers, allowMissingColumns=True).repartition("slice").sortWithinPartitions("slice", "bucket")
    found = met.mapInArrow(summed, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op13_token_counts")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(table(spark, folder, "documents"), public_vocabulary(VOCABULARY))
