"""Token ids in binary files: ids ranked by frequency, in a byte-aligned code with the lengths kept apart.

File: a fixed header (magic, part, number of documents and ids, ids before it in its part), the document ids with a
validity byte each, the ids per document, then the control bytes (two bits a value: its bytes less one) and the data
bytes of all values. A value is the rank of a token id by its frequency in the whole corpus, so most take one byte.
Decoding looks the four lengths up that each control byte stands for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from surveykit.llm.bpe import encoded, forget, public_vocabulary, slices
from surveykit.llm.registry import query, table
from surveykit.session import discard, scratch_path, settle

MAGIC = b"RANKVB01"
HEAD = np.dtype([("magic", "S8"), ("part", "<i8"), ("docs", "<i8"), ("ids", "<i8"), ("before", "<i8")])
FILE_IDS = 2_000_000
#: control byte -> bytes of its four values
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8) + 1


def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    short = (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = short
    control = (codes.reshape(-1, 4) << (2 * np.arange(4, dtype=np.uint8))).sum(axis=1).astype(np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= short[:, None]]
    return control.tobytes(), data.tobytes()


def unpack_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    lengths = LENGTHS[control].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < lengths[:, None]] = data
    return out.view("<u4").ravel()


def to_file(part: int, before: int, doc_ids: list[int | None], counts: list[int], values: np.ndarray) -> bytes:
    head = np.array([(MAGIC, part, len(doc_ids), len(values), before)], dtype=HEAD)
    control, data = pack_values(values)
    there = np.array([d is not None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([head.tobytes(), there.tobytes(), ids.tobytes(), np.array(counts, "<i8").tobytes(), control, data])


def from_file(content: bytes) -> tuple[int, int, list[int | None], np.ndarray, np.ndarray]:
    head = np.frombuffer(content, HEAD, 1)[0]
    if head["magic"] != MAGIC:
        raise ValueError("not a file of ranked ids")
    docs, n, at = int(head["docs"]), int(head["ids"]), HEAD.itemsize
    there = np.frombuffer(content, np.uint8, docs, at)
    ids = np.frombuffer(content, "<i8", docs, at + docs)
    counts = np.frombuffer(content, "<i8", docs, at + 9 * docs)
    at += 17 * docs
    control = np.frombuffer(content, np.uint8, -(-n // 4), at)
    values = unpack_values(control, np.frombuffer(content, np.uint8, offset=at + len(control)), n)
    return int(head["part"]), int(head["before"]), [int(d) if t else None for d, t in zip(ids, there, strict=True)], counts, values


def _narrow(ids: int) -> np.dtype:
    return np.dtype("<u2" if ids <= 1 << 16 else "<u4")


def token_table(docs: DataFrame, vocabulary: str, end: int, ids: int) -> DataFrame:
    """``doc_id, ids``: all ids of the text and the end id, in as few bytes each as a vocabulary of ``ids`` needs.

    One more row per task has ``seen``, how often each id came in the task, and nulls for the rest.
    """
    kind, names = _narrow(ids), ["doc_id", "ids", "seen"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(ids, np.int64)
        for batch in slices(batches):
            held = [np.frombuffer(one, "<u4").astype(kind).tobytes() for one in encoded(batch.column("text").to_pylist(), vocabulary, end)]
            seen += np.bincount(np.frombuffer(b"".join(held), kind), minlength=ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held, pa.binary()), pa.nulls(len(held), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen.tobytes()], pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, seen binary")


def frequency_ranks(tokens: DataFrame, ids: int) -> np.ndarray:
    """Ids by falling frequency in all documents, the smaller first on ties; as long as the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen = np.zeros(ids, np.int64)
        for batch in batches:
            for one in batch.column("seen"):
                seen += np.frombuffer(one.as_buffer(), np.int64)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["id", "n"])

    total = np.zeros(ids, np.int64)
    counts = tokens.where("seen IS NOT NULL").select("seen").mapInArrow(count, "id long, n long")
    for row in counts.groupBy("id").agg(F.sum("n").alias("n")).collect():
        total[row.id] = row.n
    return np.argsort(-total, kind="stable").astype("<u4")


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end: int, ids: int, file_ids: int = FILE_IDS) -> np.ndarray:
    """Writes the files of a corpus in ascending order of ``doc_id`` and returns the ids that each part holds.

    Parts are ranges of ``doc_id`` (rows that share an id are split by their ids' hash); files of a part follow each
    other. A file is written under a name of its own attempt and then renamed, so a repeated task leaves the same file.
    """
    spark = docs.sparkSession
    tokens, kind = settle(token_table(docs, vocabulary, end, ids)), _narrow(ids)
    by_rank = frequency_ranks(tokens, ids)
    spark.createDataFrame([(bytearray(by_rank.tobytes()),)], "ids binary").coalesce(1).write.parquet(f"{folder}/ranks")
    rank_of = np.empty(ids, "<u4")
    rank_of[by_rank] = np.arange(ids, dtype="<u4")
    target = f"{folder}/files"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        task = TaskContext.get()
        store, root = pyarrow.fs.FileSystem.from_uri(_plain(target))
        store.create_dir(root, recursive=True)
        part, number, before = task.partitionId(), 0, 0
        doc_ids, counts, held, running = [], [], [], 0

        def flush() -> tuple[int, int]:
            name = f"{root}/part-{part:07d}-{number:07d}.rvb"
            values = rank_of[np.frombuffer(b"".join(held), kind)]
            with store.open_output_stream(f"{name}.{task.attemptNumber()}.{task.taskAttemptId()}.tmp") as out:
                out.write(to_file(part, before, doc_ids, counts, values))
            store.move(f"{name}.{task.attemptNumber()}.{task.taskAttemptId()}.tmp", name)
            return number + 1, before + len(values)

        for batch in batches:
            for doc, one in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                doc_ids.append(doc)
                held.append(one.as_py())
                counts.append(len(held[-1]) // kind.itemsize)
                running += counts[-1]
                if running >= file_ids:
                    number, before = flush()
                    doc_ids, counts, held, running = [], [], [], 0
        if held:
            number, before = flush()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([before], pa.int64())], ["part", "ids"])

    ordered = tokens.where("seen IS NULL").select("doc_id", "ids").withColumn("tie", F.xxhash64("ids")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    sizes = ordered.mapInArrow(run, "part long, ids long").collect()
    discard(tokens)
    out = np.zeros(max((r.part for r in sizes), default=-1) + 1, np.int64)
    for row in sizes:
        out[row.part] = row.ids
    return out


def _plain(uri: str) -> str:
    """``file:/x`` as ``file:///x``, which is how both sides read it."""
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def read_token_files(spark: SparkSession, folder: str, part_ids: np.ndarray) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files; ``start`` counts the ids of all documents before it."""
    if not part_ids.sum():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    ranks = np.frombuffer(spark.read.parquet(f"{folder}/ranks").first().ids, "<u4")
    first = np.concatenate([[0], np.cumsum(part_ids)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for one in batch.column("content"):
                part, before, doc_ids, counts, values = from_file(one.as_py())
                ids, ends = ranks[values].tobytes(), np.cumsum(counts)
                starts = ends - counts
                own = [ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts + before + first[part]), pa.array(counts), pa.array(own, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rvb").load(f"{folder}/files")
    return files.select("content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


VOCABULARY, END, VOCABULARY_IDS = "word_bpe_49k.json", 2, 49_408


@query("op2_token_files")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch_path(spark, "ids")
    docs = table(spark, folder, "documents").select("doc_id", "text")
    part_ids = write_token_files(docs, out, public_vocabulary(VOCABULARY), END, VOCABULARY_IDS)
    back = read_token_files(spark, out, part_ids)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = pa.array([zlib.crc32(x.as_buffer()) for x in batch.column("ids")], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], crc], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return back.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
