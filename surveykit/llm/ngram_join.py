"""Documents linked by the Jaccard similarity of their word shingles, found with signature trees.

Two sets with a similarity of t share one of the first n - ceil(t n) + 1 shingles of each, in any fixed order. So each
shingle that two sets have among those is the root of a tree over the sets that have it; the order puts shingles that
are frequent in the corpus last, which keeps trees small. A node holds the OR of its sets' bitmaps, their range of
sizes, the most shingles that fall on a bit already set, and its label if all its sets are known to be linked. A pair
of nodes is left where sizes or the largest possible overlap rule a link out, or where both have one and the same
label. Pairs of sets that remain are compared exactly.

Labels come from a first round that compares each set of a tree with the tree's first set only: a family of copies
becomes one component by links that grow with its size, not with its square. Trees with one label need no traversal.
A tree larger than ``TREE_SETS`` is split in parts by hash, and each pair of parts is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from surveykit.llm.bpe import slices
from surveykit.llm.registry import query, table
from surveykit.llm.runs import key_runs
from surveykit.llm.shingles import mixed, shingles
from surveykit.operators.components import connected_components
from surveykit.session import discard, settle

WIDTH = 5
PERCENT = 75
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 14
BUCKETS = 1 << 18
TREE_SETS = 4096
FAN = 8
NODE_PAIRS = 4096
FILTER_BITS = 1 << 24


def _set_of(text: str | None, width: int) -> np.ndarray:
    return np.unique(shingles(text, width))


def _class_of(values: np.ndarray) -> int:
    return int(mixed(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64)) if len(values) else 0


def _bitmap(values: np.ndarray) -> bytes:
    """A power of two of bits, three to six for each shingle within limits.

    Half as many let most pairs of a family of copies through that are not quite similar enough: its pairs with a
    similarity of 0.55 to 0.74 were then nearly all compared by text.
    """
    width = min(MOST_BITS, max(LEAST_BITS, 1 << (3 * len(values)).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(values % np.uint64(width)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _unfolded(bitmaps: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitmaps at the width of the widest, the bits set in each as it came, and the bytes it came in.

    A narrow bitmap is repeated: that sets every bit that the set would set in a wide one, so bounds stay bounds. Two
    bitmaps meet in a pattern that repeats at the wider one's own width; what they share is counted once per repetition.
    """
    width = max(map(len, bitmaps))
    own = np.array([int.from_bytes(x).bit_count() for x in bitmaps], np.int64)
    bits = np.frombuffer(b"".join(x * (width // len(x)) for x in bitmaps), np.uint64).reshape(len(bitmaps), -1)
    return bits, own, np.array([len(x) for x in bitmaps], np.int64)


def _shared_bits(x: np.ndarray, y: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Bits that unfolded bitmaps share, row by row; ``width`` is the wider one's own number of bytes."""
    return _ones(x & y) // (8 * x.shape[-1] // width)


def described(docs: DataFrame, width: int) -> DataFrame:
    """One row per document (``doc_id, mark, n, cls, bits``) and one per task with its shingle counts by hash bucket.

    ``cls`` is a fingerprint of the set; equal sets share it. ``mark`` tells the texts of a repeated id apart.
    """
    names = ["doc_id", "mark", "n", "cls", "bits", "seen"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, at, held = np.zeros(BUCKETS, np.int64), [], 0
        for batch in slices(batches):
            n, cls, bits = [], [], []
            for text in batch.column("text").to_pylist():
                values = _set_of(text, width)
                n.append(len(values))
                cls.append(_class_of(values))
                bits.append(_bitmap(values) if len(values) else None)
                at.append((values >> np.uint64(46)).astype(np.int32))
                held += len(values)
                if held >= 1 << 22:
                    seen += np.bincount(np.concatenate(at), minlength=BUCKETS)
                    at, held = [], 0
            none = pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(bits, pa.binary()), none], names)
        if at:
            seen += np.bincount(np.concatenate(at), minlength=BUCKETS)
        blank = [pa.nulls(1, t) for t in (*[pa.int64()] * 4, pa.binary())]
        yield pa.RecordBatch.from_arrays([*blank, pa.array([seen.astype("<i8").tobytes()], pa.binary())], names)

    marked = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    return marked.mapInArrow(run, "doc_id long, mark long, n long, cls long, bits binary, seen binary")


def bucket_ranks(parts: DataFrame) -> np.ndarray:
    """For each bucket of hashes, how many times over the mean it is filled, as a power of two; 0 for most.

    ``BUCKETS`` numbers at any size of the corpus. They only order shingles, so their coarseness changes no result.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for one in batch.column("seen"):
                seen += np.frombuffer(one.as_buffer(), "<i8")
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["bucket", "n"])

    counts = parts.where("seen IS NOT NULL").select("seen").mapInArrow(spread, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = settle(counts)
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / BUCKETS
    ranks = np.zeros(BUCKETS, np.uint8)
    for row in counts.where(F.col("n") >= 2 * mean).collect():
        ranks[row.bucket] = min(60, int(np.log2(row.n / mean)))
    discard(counts)
    return ranks


def prefix_tokens(docs: DataFrame, ranks: np.ndarray, width: int, percent: int) -> DataFrame:
    """``token, cls, doc_id``: the shingles of each set of which similar sets share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            tokens, classes, ids = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                values = _set_of(text, width)
                if n := len(values):
                    order = np.argsort(ranks[(values >> np.uint64(46)).astype(np.int64)], kind="stable")
                    first = values[order[: n - -(-percent * n // 100) + 1]]
                    tokens.append(first.view(np.int64))
                    classes.append(np.full(len(first), _class_of(values), np.int64))
                    ids.append(np.full(len(first), doc, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, classes, ids)], ["token", "cls", "doc_id"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "token long, cls long, doc_id long")


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """The rows of tokens that two classes have, once each, and of tokens with the same classes only one token's.

    ``leader`` is the class of the tree's smallest document id: copies mostly resemble what came first. All that is
    known of a token's classes is found where the token's rows meet once.
    """
    by = Window.partitionBy("token")
    kept = (
        tokens.withColumns({"lo": F.min("cls").over(by), "hi": F.max("cls").over(by), "prev": F.lag("cls").over(by.orderBy("cls", "doc_id"))})
        .where("lo <> hi AND (prev IS NULL OR prev <> cls)")
        .withColumns({"sets": F.count("*").over(by), "x": F.bit_xor(F.xxhash64("cls")).over(by), "y": F.bit_xor(F.hash("cls", F.lit(7))).over(by), "leader": F.min_by("cls", F.struct("doc_id", "cls")).over(by)})
    )
    kept = settle(kept.select("token", "cls", "sets", "x", "y", "leader", "hi"))
    one = kept.where("cls = leader").groupBy("sets", "x", "y", "leader", "hi").agg(F.min("token").alias("token")).select("token")
    shared = settle(kept.select("token", "cls", "sets", "leader").join(one, "token"))
    discard(kept)
    return shared


def _ones(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits).sum(axis=-1, dtype=np.int64)


class Tree:
    """Sets of one tree, or of one part of it, as levels of nodes; each node has up to ``FAN`` nodes of the level below."""

    def __init__(self, classes: np.ndarray, sizes: np.ndarray, labels: np.ndarray, bits: np.ndarray, ones: np.ndarray, widths: np.ndarray):
        order = np.lexsort((classes, sizes, labels))
        self.classes = classes[order]
        bits, sizes, labels = bits[order], sizes[order], labels[order]
        self.levels = [(bits, widths[order], sizes, sizes, sizes - ones[order], labels, labels)]
        most, least = np.maximum, np.minimum
        while len(self.levels[-1][0]) > 1:
            at = np.arange(0, len(self.levels[-1][0]), FAN)
            by = (np.bitwise_or, most, least, most, most, least, most)
            self.levels.append(tuple(f.reduceat(x, at) for f, x in zip(by, self.levels[-1], strict=True)))

    def level(self, up: int):
        return self.levels[min(up, len(self.levels) - 1)]


def possible(a: Tree, b: Tree, up: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Of pairs of nodes of a level, those that may hold a link between different labels."""
    bits_a, width_a, small_a, large_a, extra_a, low_a, high_a = a.level(up)
    bits_b, width_b, small_b, large_b, extra_b, low_b, high_b = b.level(up)
    fit = 100 * np.minimum(large_a[i], large_b[j]) >= percent * np.maximum(small_a[i], small_b[j])
    fit &= ~((low_a[i] == high_a[i]) & (low_b[j] == high_b[j]) & (low_a[i] == low_b[j]))
    i, j = i[fit], j[fit]
    overlap = np.empty(len(i), np.int64)
    for k in range(0, len(i), 65536):
        x, y = i[k : k + 65536], j[k : k + 65536]
        overlap[k : k + 65536] = _shared_bits(bits_a[x], bits_b[y], np.maximum(width_a[x], width_b[y]))
    overlap = np.minimum(overlap + np.minimum(extra_a[i], extra_b[j]), np.minimum(large_a[i], large_b[j]))
    fit[fit] = (100 + percent) * overlap >= percent * (small_a[i] + small_b[j])
    return fit


def dual_traversal(a: Tree, b: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Class pairs whose sets may be similar; ``a`` may be ``b``, then each pair once. Runs of node pairs bound memory."""
    same, step = a is b, np.arange(FAN)
    top = max(len(a.levels), len(b.levels)) - 1
    root = np.zeros(1, np.int64)
    todo = [(top, root, root)] if possible(a, b, top, root, root, percent).all() else []
    while todo:
        up, i, j = todo.pop()
        if up == 0:
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield a.classes[i], b.classes[j]
            continue
        if len(i) > NODE_PAIRS:
            todo.append((up, i[NODE_PAIRS:], j[NODE_PAIRS:]))
            i, j = i[:NODE_PAIRS], j[:NODE_PAIRS]
        under_a = i[:, None] * FAN + step if up < len(a.levels) else i[:, None]
        under_b = j[:, None] * FAN + step if up < len(b.levels) else j[:, None]
        x, y = (v.ravel() for v in np.broadcast_arrays(under_a[:, :, None], under_b[:, None, :]))
        real = (x < len(a.level(up - 1)[0])) & (y < len(b.level(up - 1)[0]))
        if same:
            real &= x <= y
        x, y = x[real], y[real]
        keep = possible(a, b, up - 1, x, y, percent)
        if keep.any():
            todo.append((up - 1, x[keep], y[keep]))


def candidate_pairs(trees: DataFrame, percent: int) -> DataFrame:
    """``trees``: ``token, sets, cls, n, bits, label`` to class pairs ``a, b`` that the bounds and labels leave."""
    parts = F.ceil(F.col("sets") / TREE_SETS).cast("int")
    part = F.pmod(F.xxhash64("cls"), parts).cast("int")
    dealt = trees.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.select("token", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).cast("int").alias("side"), "cls", "n", "label", "bits")

    def search(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        side = rows.column("side").to_numpy()
        sets = [*(rows.column(c).to_numpy() for c in ("cls", "n", "label")), *_unfolded(rows.column("bits").to_pylist())]
        if rows.column("i")[0].as_py() == rows.column("j")[0].as_py():
            a = b = Tree(*sets)
        else:
            if side.all() or not side.any():
                return
            a, b = (Tree(*(x[side == s] for x in sets)) for s in (0, 1))
        for x, y in dual_traversal(a, b, percent):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in key_runs(batches, ["token", "i", "j"]):
            yield from search(rows)

    return dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(run, "a long, b long").distinct()


def possible_pairs(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sizes and bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            m, n = (batch.column(c).to_numpy() for c in ("m", "n"))
            bits, ones, widths = _unfolded(batch.column("x").to_pylist() + batch.column("y").to_pylist())
            k = batch.num_rows
            overlap = _shared_bits(bits[:k], bits[k:], np.maximum(widths[:k], widths[k:]))
            overlap = np.minimum(overlap + np.minimum(m - ones[:k], n - ones[k:]), np.minimum(m, n))
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * overlap >= percent * (m + n)))

    left = signs.select(F.col("cls").alias("a"), F.col("n").alias("m"), F.col("bits").alias("x"))
    right = signs.select(F.col("cls").alias("b"), "n", F.col("bits").alias("y"))
    near = (F.col("m") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("m") * percent)
    sizes = pairs.join(left.drop("x"), "a").join(right.drop("y"), "b").where(near).select("a", "b")
    return sizes.join(left, "a").join(right, "b").select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a long, b long")


def of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` that may have one of ``ids``, so that few texts are shuffled for a join that follows.

    A bit table of ``FILTER_BITS`` is all that passes the driver; a full one lets every row through.
    """

    def spots(values: np.ndarray) -> np.ndarray:
        h = mixed(values.astype(np.int64).view(np.uint64))
        return np.stack([h % np.uint64(FILTER_BITS), (h >> np.uint64(32)) % np.uint64(FILTER_BITS)]).astype(np.int64)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, np.uint8)
        for batch in batches:
            bits[spots(batch.column("doc_id").to_numpy()).ravel()] = 1
        packed = np.packbits(bits).view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at])], ["word", "bits"])

    words = ids.select("doc_id").mapInArrow(marks, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    packed = np.zeros(FILTER_BITS // 64, np.int64)
    packed[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    table = packed.view(np.uint8)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = spots(batch.column("doc_id").to_numpy())
            hit = (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1
            yield batch.filter(pa.array(hit.all(axis=0)))

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(keep, "doc_id long, text string")


def linked(pairs: DataFrame, docs: DataFrame, of: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs of classes whose sets are similar. ``of``: ``cls, doc_id`` of one document per class.

    Where an id is repeated with other texts, only the text of the class is read for it.
    """
    pairs = settle(pairs)
    needed = settle(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(of, "cls"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            real = [_class_of(_set_of(t, width)) == c for c, t in zip(batch.column("cls").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield batch.filter(pa.array(real, pa.bool_()))

    texts = of_ids(docs, needed).join(needed, "doc_id").select("cls", "text").mapInArrow(own, "cls long, text string")
    texts = settle(texts.groupBy("cls").agg(F.min("text").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            known: dict[str, np.ndarray] = {}
            keep = []
            for one, two in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                left, right = (known[t] if t in known else known.setdefault(t, _set_of(t, width)) for t in (one, two))
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("cls").alias("b"), F.col("text").alias("y")), "b")
    found = settle(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))
    for cut in (pairs, needed, texts):
        discard(cut)
    return found


def _components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, mark, n, root`` of each row; ``root`` is a class of the component, null for sets without shingles."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = settle(described(docs, width))
    known = parts.where("seen IS NULL")
    of = known.where("n > 0 AND doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    shared = shared_tokens(prefix_tokens(docs, bucket_ranks(parts), width, percent))
    signs = known.where("n > 0").join(of, ["cls", "doc_id"]).select("cls", "n", "bits").dropDuplicates(["cls"])
    signs = settle(signs.join(shared.select("cls").distinct(), "cls"))
    stars = shared.where("cls <> leader").select(F.col("leader").alias("a"), F.col("cls").alias("b")).distinct()
    found = linked(possible_pairs(stars, signs, percent), docs, of, width, percent)
    labels = settle(connected_components(found))
    labelled = shared.join(labels.withColumnRenamed("id", "cls"), "cls", "left").select("token", "sets", "cls", F.coalesce("root", "cls").alias("label"))
    open_trees = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    trees = labelled.join(open_trees, "token").join(signs, "cls")
    more = linked(candidate_pairs(trees, percent), docs, of, width, percent)
    roots = settle(connected_components(found.unionByName(more)))
    for cut in (shared, signs, labels, found, more):
        discard(cut)
    placed = known.select("doc_id", "mark", "n", "cls").join(roots.withColumnRenamed("id", "cls"), "cls", "left")
    return placed.withColumn("root", F.when(F.col("n") > 0, F.coalesce("root", "cls"))).drop("cls")


def ngram_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``.

    A null or empty text has no shingles and links with nothing. Rows with equal sets are one class, linked by
    themselves; a null id is never a component's id unless no row of the component has another. Rows that repeat an id
    are described one by one, each by its own text. An empty table gives no rows; other columns are not read.
    """
    placed = _components(docs, width, percent)
    smallest = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    with_words = placed.where("root IS NOT NULL").join(smallest, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return with_words.unionByName(placed.where("root IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one_per_group(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of each component, that of the smallest id, with the columns it came with. Rows without an id stay.

    A row is known by its id and its text: of rows that repeat an id, each text goes or stays by its own component, the
    smaller hash of text deciding where both are the component's first. Rows equal in both are one.
    """
    placed = _components(docs, width, percent).where("doc_id IS NOT NULL")
    first = placed.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    lost = placed.join(first, "root").where(F.struct("doc_id", "mark") != F.col("first")).select("doc_id", "mark").distinct()
    mark = F.xxhash64("text").alias("mark")
    alone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    held = docs.select("doc_id", mark, alone.alias("alone"), F.struct("*").alias("row")).join(lost, ["doc_id", "mark"], "left_anti")
    return held.dropDuplicates(["doc_id", "mark", "alone"]).select("row.*")


@query("op10_ngram_jaccard_join")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_components(table(spark, folder, "documents"))
