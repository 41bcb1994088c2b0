"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, and a rerank with the vectors.

A rotation of the principal axes is learned so that signs lose least (iterative quantisation); signs of the rotated
vector are its code. It is learned around the mean, which balances the codes, and applied from the origin, so that a
bit differs with the odds of the angle between two vectors whatever direction they have in common. Many rotations from
different starts give one long code; each run of ``chunk`` bits of it is the key of one table. ``chunk`` is the binary
logarithm of the number of vectors, so buckets do not grow with it, and the number of tables is what leaves a pair at
the threshold no common key with odds of ``MISS`` only: at a cosine of 0.9 a bit differs with odds of 0.144, 16 bits
agree with odds of 0.084, and 105 tables are used. Rows that share a key and differ in few bits of the first
``FILTER_BITS`` are compared by cosine, in double precision.

Equal vectors are one class. A bucket is split into blocks by hash, and each pair of blocks is a task; a task hands
on link counts per row and one component edge per row, never its pairs. A pair that meets in several tables is counted
in the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from surveykit.llm.registry import query, table
from surveykit.llm.runs import whole_runs
from surveykit.operators.components import connected_components
from surveykit.session import discard, settle

#: vectors that the rotations are learned from, at most; every vector is indexed
SAMPLE = 20_000
#: odds at which a pair at the threshold may meet in no table
MISS = 1e-4
LEAST_CHUNK = 8
#: leading bits of the code that travel with each key, and the share of them in which rows may differ to be compared
FILTER_BITS = 192
REACH = 18 / 64
#: rotations of fewer bits say too little about an angle: every second one stays random, and no row is filtered out
FEW_BITS = 16
BLOCK = 1024
#: buckets of up to so many rows are compared side by side
SMALL = 64
COSINE = 0.9


class Codes:
    """Codes of ``n`` bits, learned from a sample of unit vectors."""

    def __init__(self, sample: np.ndarray, n: int, rounds: int = 30, seed: int = 0):
        self.rotated = min(64, sample.shape[1])
        _, axes = np.linalg.eigh(sample.T @ sample)
        axes = axes[:, ::-1][:, : self.rotated]
        centred = (sample - sample.mean(axis=0)) @ axes
        random = np.random.default_rng(seed)
        found = []
        for k in range(-(-n // self.rotated)):
            turn = np.linalg.qr(random.standard_normal((self.rotated, self.rotated)))[0]
            for _ in range(0 if self.rotated < FEW_BITS and k % 2 else rounds):
                signs = np.where(centred @ turn >= 0, 1.0, -1.0)
                left, _, right = np.linalg.svd(signs.T @ centred)
                turn = (left @ right).T
            found.append(axes @ turn)
        self.planes = np.concatenate(found, axis=1)[:, :n]

    def bits(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.planes >= 0


def tables_of(chunk: int, cosine: float, miss: float = MISS) -> int:
    """Tables of ``chunk`` bits in which a pair at ``cosine`` shares no key with odds of ``miss``."""
    agree = (1 - np.arccos(min(1.0, cosine)) / np.pi) ** chunk
    return 1 if agree >= 1 - miss else int(np.ceil(np.log(miss) / np.log1p(-agree)))


def chunk_keys(bits: np.ndarray, chunk: int) -> np.ndarray:
    """Keys by table: the bits cut into runs of ``chunk``, a short last run included."""
    cuts = range(0, bits.shape[1], chunk)
    return np.stack([bits[:, k : k + chunk] @ (1 << np.arange(bits[:, k : k + chunk].shape[1])) for k in cuts], axis=1)


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _packed(bits: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1)], pa.binary())


def _unpacked(column, n: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(packed, axis=1)[:, :n].astype(bool)


def _sound(vector: str = "embedding"):
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _pairs(rows: pa.Table, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of each bucket, or of its two blocks: small buckets together by distance in the order, others by stretches."""
    sizes = np.diff(cuts)
    side, crossed = rows.column("side").to_numpy(), rows.column("i").to_numpy() != rows.column("j").to_numpy()
    small = (sizes <= SMALL) & ~crossed[cuts[:-1]]
    run = np.repeat(np.arange(len(sizes)), sizes)
    x, apart = np.flatnonzero(small[run]), 0
    while len(x):
        apart += 1
        x = x[x + apart < len(run)]
        x = x[run[x] == run[x + apart]]
        yield x, x + apart
    for k in np.flatnonzero(~small):
        at = np.arange(cuts[k], cuts[k + 1])
        left, right = (at[side[at] == 0], at[side[at] == 1]) if crossed[at[0]] else (at, at)
        for own in np.split(left, range(256, len(left), 256)):
            x, y = (v.ravel() for v in np.broadcast_arrays(own[:, None], right[None, :]))
            yield (x, y) if crossed[at[0]] else (x[x < y], y[x < y])


def _joined(x: np.ndarray, y: np.ndarray, low: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest labels once more pairs are joined, and the labels that rows left with those they took (two rows).

    A row that leaves a label which is not its own would lose those that still bear it; the second answer keeps them.
    """
    left = []
    while len(x):
        met = low.copy()
        np.minimum.at(met, x, low[y])
        np.minimum.at(met, y, low[x])
        if (met == low).all():
            break
        moved = (met != low) & (low != cls)
        left.append(np.stack([low[moved], met[moved]]))
        low = met
    return low, np.unique(np.concatenate(left, axis=1), axis=1) if left else np.zeros((0, 0), np.int64)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, chunk: int | None = None, miss: float = MISS, seed: int = 0) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors`` (``vec_id, embedding``).

    Vectors that are null, zero, or hold null or non-finite components link with nothing, nor do rows without an id.
    Vectors of unlike lengths are compared with their own length only, each length by a search of its own. Rows that
    repeat an id are judged by their own vectors; only a component takes its smallest id. An empty table gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", (F.col("vec_id").isNotNull() & _sound()).alias("sound"))
    plain = rows.where("NOT sound OR sound IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    good = rows.where("sound").select("vec_id", F.transform("embedding", lambda x: x.cast(kind) + 0).alias("v"))
    for row in good.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect():
        plain = plain.unionByName(_of_length(good.where(F.size("v") == row.dim), row.dim, cosine, sample, chunk, miss, seed))
    return plain


def _of_length(good: DataFrame, dim: int, cosine: float, sample: int, chunk: int | None, miss: float, seed: int) -> DataFrame:
    classes = settle(good.groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("size")).withColumn("cls", F.monotonically_increasing_id()))
    total = classes.count()
    part = min(1.0, 1.5 * sample / max(1, total))
    drawn = classes.where(F.pmod(F.xxhash64("first", F.lit(seed)), F.lit(1 << 20)) < int(part * (1 << 20)) + 1).select("v").limit(sample).toArrow()
    chunk = chunk or max(LEAST_CHUNK, (total - 1).bit_length())
    tables = tables_of(chunk, cosine, miss)
    codes = Codes(_unit(_matrix(drawn.column("v"), dim)), tables * chunk, seed=seed)
    wide = min(FILTER_BITS, tables * chunk)
    reach = wide if codes.rotated < FEW_BITS else int(REACH * wide)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits = codes.bits(_unit(_matrix(batch.column("v"), dim)))
                yield pa.RecordBatch.from_arrays([batch.column("cls"), _packed(bits)], ["cls", "code"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits = _unpacked(batch.column("code"), codes.planes.shape[1])
                keys = chunk_keys(bits, chunk)
                packed = _packed(bits[:, :wide])
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t, np.int32)), pa.array(keys[:, t].astype(np.int64)), batch.column("cls"), packed], ["tab", "key", "cls", "code"])

    whole = settle(classes.select("cls", "v").mapInArrow(coded, "cls long, code binary"))
    placed = whole.mapInArrow(index, "tab int, key long, cls long, code binary")
    placed = settle(placed)
    crowd = placed.groupBy("tab", "key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    spread = placed.join(crowd, ["tab", "key"]).withColumn("part", F.pmod(F.xxhash64("cls"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    spread = spread.select("tab", "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).cast("int").alias("side"), "cls", "code")
    where = ["tab", "key", "i", "j"]

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a pair of blocks that have a partner within reach of their code."""
        for rows, cuts in whole_runs(batches, where):
            code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint64).reshape(rows.num_rows, -1)
            near = np.zeros(rows.num_rows, bool)
            for x, y in _pairs(rows, cuts):
                apart = np.zeros(len(x), np.int32)
                for w in range(code.shape[1]):
                    apart += np.bitwise_count(code[x, w] ^ code[y, w])
                hit = apart <= reach
                near[x[hit]] = True
                near[y[hit]] = True
            if near.any():
                yield from rows.filter(pa.array(near)).to_batches()

    fields = "tab int, key long, i int, j int, side int, cls long, code binary"
    hopeful = settle(spread.repartition(*where).sortWithinPartitions(*where).mapInArrow(close, fields))
    discard(placed)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in whole_runs(batches, where):
            cls, size, tab = (rows.column(c).to_numpy() for c in ("cls", "size", "tab"))
            unit = _unit(_matrix(rows.column("v"), dim))
            keys = chunk_keys(_unpacked(rows.column("code"), codes.planes.shape[1])[:, : max(1, tab.max()) * chunk], chunk)
            low, n = cls.copy(), np.zeros(len(cls), np.int64)
            for x, y in _pairs(rows, cuts):
                like = np.concatenate([np.einsum("ij,ij->i", unit[x[k : k + 65536]], unit[y[k : k + 65536]]) for k in range(0, len(x), 65536)] or [np.zeros(0)]) >= cosine
                x, y = x[like], y[like]
                low, left = _joined(x, y, low, cls)
                if len(left):
                    yield pa.RecordBatch.from_arrays([pa.array(left[0]), pa.array(left[1]), pa.array(np.zeros(len(left[0]), np.int64))], ["a", "b", "n"])
                for t in range(tab.max()):  # pairs that met in an earlier table were counted there
                    fresh = (tab[x] <= t) | (keys[x, t] != keys[y, t])
                    x, y = x[fresh], y[fresh]
                np.add.at(n, x, size[y])
                np.add.at(n, y, size[x])
            some = (n > 0) | (low != cls)
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(cls[some]), pa.array(low[some]), pa.array(n[some])], ["a", "b", "n"])

    judged = hopeful.drop("code").join(classes, "cls").join(whole, "cls").select(*where, "side", "cls", "code", "v", "size")
    judged = settle(judged.repartition(*where).sortWithinPartitions(*where).mapInArrow(links, "a long, b long, n long"))
    discard(hopeful)
    discard(whole)
    counts = judged.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    roots = connected_components(judged.select("a", "b").where("a <> b").distinct()).withColumnRenamed("id", "cls")
    placed = classes.join(counts, "cls", "left").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    answer = placed.join(smallest, "root").select("v", "component_id", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    return good.join(answer, "v").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


@query("op9_embedding_near_dedup")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "embeddings").select("vec_id", "embedding"))
