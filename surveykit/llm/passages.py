"""Passages that repeat across documents, found by compact windows and verified word by word.

A text is its sequence of hashed word shingles. For a hash function, all its subsequences of ``LEAST`` shingles or
more whose smallest hash is the same one form a node of the Cartesian tree over the hashes; the nodes that are wide
enough are the runs of equal minima of a window of that width, which numpy finds without building the tree. A node is
a compact window: from, to and the smallest hash. Windows that share it in two documents hold subsequences with equal
min-hash; where windows of enough hash functions meet on a pair of documents, both are read and compared.

A window is first held against the first document that has its hash and the one before its own in order of id. The
partner with most windows of a document is read first; windows that its passages explain are done, the others' partners
are read after that. Most windows of copies end here, at 2 g comparisons for a passage in g documents.

Windows that do not lie inside a passage found so far go on. Runs of ``LEAST`` shingles in them are compared by hash
with those of all documents that share the windows' hashes of every function, so an exact repeat is found whatever other
documents hold its smallest shingle. Windows still with room for a passage go to their key with a sketch of each
shingle. Where a window's shingles can't make up a passage, wherever earlier windows of the key have them, it is done at
once, which needs one sort of a key's shingles; others are held against the earlier windows, some at a time, until the
passages found leave no room. So a family of g edited copies costs g windows and not their pairs, as long as most windows
find a partner soon or can have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from surveykit.llm.bpe import slices
from surveykit.llm.registry import query, table
from surveykit.llm.runs import whole_runs
from surveykit.llm.shingles import mixed, shingles, shingles_of_words, word_hashes
from surveykit.session import discard, settle, settle_by

WIDTH = 5
WORDS = 50
HASHES = 4
#: hash functions whose windows must meet on a passage before it is compared
ENOUGH = 2
PERCENT = 75
#: shingles without a partner that a passage may run over: two changed words next to each other
GAP = 10
#: a sketch has this many bits of flags: taken, an earlier place has the shingle, another place has it, and the code of a joint
BITS, JOINT = 5, 3
FLAGS, TAKEN, AGAIN, TWICE = (np.uint32(x) for x in ((1 << BITS) - 1, 1, 2, 4))
#: by code, how many other shingles stand at least where shingles of a passage were replaced
BETWEEN = np.array([0, 2, 3, 4])
#: cost of a place that no passage has
NEVER = 1 << 24
#: earlier windows that a window is held against first, and places that are looked at side by side
NEXT, CELLS = 64, 1 << 18
#: rows of a batch that are handed on
ROWS_OUT = 20_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each window of ``width`` along the last axis, by minima of windows of doubled width."""
    if values.shape[-1] < width:
        return values[..., :0]
    low, wide = values, 1
    while 2 * wide <= width:
        low = np.minimum(low[..., :-wide], low[..., wide:])
        wide *= 2
    rest = width - wide
    return np.minimum(low[..., : low.shape[-1] - rest], low[..., rest:]) if rest else low


def windows_of_rows(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, smallest hash, first and last shingle of each node of at least ``width`` of each row."""
    low = window_minima(values, width)
    new = np.ones(low.shape, bool)
    new[:, 1:] = low[:, 1:] != low[:, :-1]
    row, first = np.nonzero(new)
    after = np.append(first, 0)[1:]
    return row, low[new], first, np.where(after > 0, after, low.shape[1]) + width - 2


def compact_windows(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest hash, first and last shingle of each node of at least ``width``."""
    return windows_of_rows(values[None], width)[1:]


def _seed(k: int) -> np.uint64:
    return mixed(np.array([k + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0]


def window_rows(docs: DataFrame, hashes: int, words: int, width: int) -> DataFrame:
    """``key, doc, place``: the window's hash, its document, and hash function, first and last shingle in one number."""
    least = words - width + 1
    seeds = np.array([_seed(k) for k in range(hashes)])[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, docs_, places = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = shingles(text, width)
                if len(own) < least:
                    continue
                k, low, first, last = windows_of_rows(mixed(own ^ seeds), least)
                keys.append(low.view(np.int64))
                places.append((k << 60) | (first << 30) | last)
                docs_.append(np.full(len(low), doc, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(docs_)), pa.array(np.concatenate(places))], ["key", "doc", "place"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "key long, doc long, place long")


def run_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` values, equal wherever the run stands."""
    n = len(values)
    if n < width:
        return values[:0]
    up, down = np.full(n, _STEP), np.full(n, _BACK)
    up[0] = down[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * np.cumprod(up, dtype=np.uint64), dtype=np.uint64)])
    return mixed((sums[width:] - sums[:-width]) * np.cumprod(down, dtype=np.uint64)[: n - width + 1])


def _runs(at: np.ndarray, gap: int) -> Iterator[np.ndarray]:
    if len(at):
        yield from np.split(at, np.flatnonzero(np.diff(at) > gap) + 1)


def _in(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value stands in the ascending ``known``, and whether it is there."""
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return at, known[at] == values


def steps(first: np.ndarray, again: np.ndarray, others: np.ndarray | None, single: np.ndarray, percent: int, gap: int = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Gain and cost of each shingle of a text beside each partner, a row each, from the places where the partner first has it.

    In hundredths: a shared shingle counts ``100 - percent``, another one of the text ``-percent``, and so do those of the partner
    (``others`` counts them up to each place) between places close to each other of shingles that follow each other in the
    text. Those around a place of the partner that isn't ``single`` don't count, nor does one that comes ``again``.
    """
    found, places = first >= 0, np.arange(first.shape[1])
    last = np.maximum.accumulate(np.where(found, places, -1), axis=1)
    last = np.concatenate([np.full((len(first), 1), -1), last[:, :-1]], axis=1)
    follows = found & (last >= 0)
    cost = np.where(follows & (places - last > gap), NEVER, 0)
    if others is not None:
        before = np.take_along_axis(first, np.maximum(last, 0), axis=1)
        near = follows & (first > before) & (first - before <= gap) & single[first] & single[before]
        cost += np.where(near, percent * (others[first] - others[before]), 0)
    return np.where(found, 100 - percent, np.where(again, 0, -percent)), cost


def best_part(gain: np.ndarray, cost: np.ndarray, least: int) -> tuple[int, int] | None:
    """First and last place of the longest span around the one of the largest sum, if there is one that isn't below 0."""
    sums = np.cumsum(gain - cost)
    begin = np.where(gain > 0, sums - gain, NEVER * len(gain))
    best = np.where(gain > 0, sums, -NEVER * len(gain))[least - 1 :] - np.minimum.accumulate(begin)[: len(gain) + 1 - least]
    if not len(best) or best.max() < 0:
        return None
    end = int(best.argmax()) + least - 1
    s = int(begin[: end + 2 - least].argmin())
    e = int(np.flatnonzero((gain > 0) & (sums - begin[s] >= 0))[-1])
    return int(np.flatnonzero((gain > 0) & (sums[e] - begin >= 0))[0]), e


def matching_passages(a: np.ndarray, b: np.ndarray, least: int, percent: int, gap: int = GAP, wanted=lambda s, e: True) -> Iterator[tuple[int, int, int, int]]:
    """Spans (first and last shingle in ``a``, then in ``b``) of at least ``least`` shingles that are similar enough.

    ``wanted`` tells of a span in ``a`` whether it counts; where it doesn't, no part of the span may count.
    """
    in_b, at_b = np.unique(b, return_index=True)
    which, there = _in(in_b, a)
    wide = lambda r: len(r) and r[-1] - r[0] + 1 >= least and wanted(r[0], r[-1])
    whole = [r for r in _runs(np.flatnonzero(there), gap) if wide(r)]
    if not whole:
        return
    inverse = _in(in_b, b)[0]

    def partner(run: np.ndarray) -> tuple[int, int] | None:
        """The span of ``b`` that is similar to the one of the run."""
        shared = np.zeros(len(in_b), bool)
        shared[which[run]] = True
        best = max(_runs(np.flatnonzero(shared[inverse]), gap), key=lambda r: len(np.unique(inverse[r])))
        theirs = np.zeros(len(in_b), bool)
        theirs[inverse[best[0] : best[-1] + 1]] = True
        both, mine = int((shared & theirs).sum()), int(shared.sum())
        inside = a[run[0] : run[-1] + 1][~there[run[0] : run[-1] + 1]]
        union = mine + len(np.unique(inside)) + int(theirs.sum()) - both
        return (int(best[0]), int(best[-1])) if 100 * both >= percent * union else None

    for long in whole:
        if other := partner(long):
            yield int(long[0]), int(long[-1]), *other
            continue
        begin, own = long[0], a[long[0] : long[-1] + 1]
        again, new, shared = np.ones(len(own), bool), np.zeros(len(b), bool), np.zeros(len(in_b), bool)
        again[np.unique(own, return_index=True)[1]] = False
        new[at_b] = shared[which[long]] = True
        first = np.full(len(own), -1)
        first[long - begin] = at_b[which[long]]
        others = None if again.any() else np.cumsum(~shared[inverse] & new)
        gain, cost = (x[0] for x in steps(first[None], again, others, np.bincount(inverse)[inverse] == 1, percent, gap))
        left, todo, ends = gain.copy(), [long], best_part(gain, cost, least)
        # parts of the run, then the longest of what they leave and parts of that
        while ends:
            while todo:
                run = todo.pop()
                if not wide(run):
                    continue
                span = slice(run[0] - begin, run[-1] + 1 - begin)
                if run is not long:
                    if not best_part(gain[span], cost[span], least):
                        continue
                    if other := partner(run):
                        yield int(run[0]), int(run[-1]), *other
                        left[span] = -NEVER
                        continue
                # two passages of b side by side in a, or loose ends: part where the partner jumps, else at the widest gap
                jumps = np.abs(np.diff(at_b[which[run]])) + gap * np.diff(run)
                if len(jumps) and jumps.max() > gap + 1:
                    cut = int(jumps.argmax()) + 1
                    todo += [run[:cut], run[cut:]]
            if ends := best_part(left, cost, least):
                todo = [np.flatnonzero(first[ends[0] : ends[1] + 1] >= 0) + begin + ends[0]]
                left[ends[0] : ends[1] + 1] = -NEVER


def _longest(free: np.ndarray) -> int:
    """The most places in a row that are free."""
    return int(np.diff(np.flatnonzero(np.concatenate([[True], ~free, [True]]))).max()) - 1


def _unexplained(first: np.ndarray, last: np.ndarray, s: np.ndarray, e: np.ndarray, least: int) -> np.ndarray:
    """Which windows hold ``least`` shingles in a row outside the spans from ``s`` to ``e``."""
    free = np.ones(int(last.max(initial=0)) + 1, bool)
    for x, y in zip(s.tolist(), e.tolist(), strict=True):
        free[x : y + 1] = False
    held = np.concatenate([[0], np.cumsum(free)])
    begins = np.concatenate([[0], np.cumsum(held[least:] - held[:-least] == least)])
    return begins[np.minimum(last - least + 2, len(begins) - 1)] > begins[np.minimum(first, len(begins) - 1)]


def _outside(first: np.ndarray, last: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Which windows lie inside none of the spans."""
    return ~((s <= first[:, None]) & (e >= last[:, None])).any(axis=1)


def _ends(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return place >> 30 & 0x3FFFFFFF, place & 0x3FFFFFFF


def _covered(place: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` shingles lie in one of the places."""
    steps = np.zeros(n + 1, np.int64)
    first, last = _ends(place)
    np.add.at(steps, np.minimum(first, n), 1)
    np.add.at(steps, np.minimum(last + 1, n), -1)
    return np.cumsum(steps)[:n] > 0


def _numbers(lists: pa.Array, *names: str) -> Iterator[list[np.ndarray]]:
    """The named fields of each list of structs, none of a null."""
    for one in lists:
        yield [one.values.field(c).to_numpy() if one.is_valid else np.zeros(0, np.int64) for c in names]


def _lists(parts: list[list[np.ndarray]], names: list[str]) -> pa.Array:
    """Lists of structs of whole numbers."""
    ends = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
    columns = [pa.array(np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]).astype(np.int64)) for k in range(len(names))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names))


def _with_spans(rows: DataFrame, every: DataFrame) -> DataFrame:
    """``rows`` with the spans found in their document, ``cuts``, null where there is none."""
    return rows.join(every.groupBy("doc").agg(F.collect_set(F.struct("p.s", "p.e")).alias("cuts")), "doc", "left")


def open_windows(windows: DataFrame, every: DataFrame, is_open, enough: int = 1) -> DataFrame:
    """``key, doc, place`` of windows that are open beside the spans, of documents with those of ``enough`` functions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [[np.zeros(0, np.int64)] * 3]
            for doc, (key, place), (s, e) in zip(batch.column("doc").to_pylist(), _numbers(batch.column("ws"), "key", "place"), _numbers(batch.column("cuts"), "s", "e"), strict=True):
                keep = is_open(*_ends(place), s, e)
                if len(np.unique(place[keep] >> 60)) >= enough:
                    out.append([key[keep], np.full(keep.sum(), doc, np.int64), place[keep]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["key", "doc", "place"])

    held = windows.groupBy("doc").agg(F.collect_list(F.struct("key", "place")).alias("ws"))
    return _with_spans(held, every).select("doc", "ws", "cuts").mapInArrow(run, "key long, doc long, place long")


def exact_repeats(shared: DataFrame, texts: DataFrame, keys: DataFrame, every: DataFrame, width: int, least: int, hashes: int) -> DataFrame:
    """``doc, to, p``: runs of ``least`` shingles and more that lie in no span of ``every`` and repeat word by word.

    ``to`` is the first document with the run. A run's windows of all functions are open where it is, and shared with
    each document that holds it; so only the places of documents are hashed that such windows of every function cover.
    ``keys`` are those of the windows that lie in no span.
    """
    places = shared.join(keys, "key").groupBy("doc").agg(F.collect_list("place").alias("places"))
    places = places.where(F.size(F.array_distinct(F.transform("places", lambda x: F.shiftright(x, 60)))) == hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]]
            for doc, text, held, (s, e) in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), batch.column("places"), _numbers(batch.column("cuts"), "s", "e"), strict=True):
                runs = run_hashes(shingles(text, width), least)
                place = held.values.to_numpy()
                # a repeated id has windows of all its texts, the longest is read
                place = place[(place & 0x3FFFFFFF) < len(runs) + least - 1]
                met = np.zeros((hashes, len(runs) + 1), np.int32)
                first, last = _ends(place)
                np.add.at(met, (place >> 60, first), 1)
                np.add.at(met, (place >> 60, last - least + 2), -1)
                at = np.flatnonzero((np.cumsum(met, axis=1) > 0).all(axis=0)[:-1])
                out.append([runs[at].view(np.int64), np.full(len(at), doc, np.int64), at, _outside(at, at + least - 1, s, e)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["run", "doc", "at", "out"])

    runs = _with_spans(places.join(texts, "doc"), every).select("doc", "text", "places", "cuts").mapInArrow(run, "run long, doc long, at long, out boolean")
    by = Window.partitionBy("run")
    met = runs.withColumn("h", F.min(F.struct("doc", "at")).over(by)).where("out AND doc <> h.doc").select("doc", "at", F.col("h.doc").alias("to"), (F.col("h.at") - F.col("at")).alias("off"))
    met = met.distinct().withColumn("isle", F.col("at") - F.row_number().over(Window.partitionBy("doc", "to", "off").orderBy("at")))
    spans = met.groupBy("doc", "to", "off", "isle").agg(F.min("at").alias("s"), (F.max("at") + least - 1).alias("e"))
    return settle(spans.select("doc", "to", F.struct("s", "e", (F.col("s") + F.col("off")).alias("s0"), (F.col("e") + F.col("off")).alias("e0")).alias("p")))


def sketch(values: np.ndarray) -> np.ndarray:
    """27 bits of each shingle above its flags: ``TWICE`` where another place has it too, ``AGAIN`` where an earlier one has."""
    out = (values >> np.uint64(32)).astype(np.uint32) & ~FLAGS
    order = np.argsort(values, kind="stable")
    same = values[order[1:]] == values[order[:-1]]
    out[order[1:][same]] |= AGAIN | TWICE
    out[order[:-1][same]] |= TWICE
    return out


def joints(words: np.ndarray, n: int, width: int = WIDTH) -> np.ndarray:
    """Flags of ``n`` shingles: how many others stand at least before one where what is before it in a text was replaced.

    Shingles around a joint that share no words have ``width - 1`` others between them, and fewer only by as many words as
    stand near the joint twice.
    """
    same = np.zeros((GAP + 1, n + width - 1), bool)
    for k, by in enumerate((-2, -1, *range(1, GAP))):
        if by > 0:
            same[k, by:] = words[by:] == words[:-by]
        else:
            same[k, :by] = words[-by:] == words[:by]
    long, level = np.ones((GAP + 1, n), bool), np.zeros(n, np.int64)
    for k in range(width - 1):
        long &= same[:, k : k + n]
        any_ = long.any(axis=0)
        if not any_.any():
            break
        level += any_
    return np.searchsorted(BETWEEN[1:], width - 1 - level, side="right").astype(np.uint32) << JOINT


def best_spans(gain: np.ndarray, cost: np.ndarray, free: np.ndarray, begins: np.ndarray, least: int) -> np.ndarray:
    """The largest sum of a span with ``least`` free places in a row in each row, less than 0 where there is none.

    Rows lie one behind the other. A span begins and ends with a gain; the cost of its first place doesn't count.
    """
    size = np.diff(begins)
    row, at = np.repeat(np.arange(len(size)), size), np.arange(len(gain))
    sums = np.cumsum(gain - cost) - row * (100 * np.int64(size.max(initial=0) + 1))
    low = np.minimum.accumulate(np.where(gain > 0, sums - gain, np.iinfo(np.int64).max >> 1))
    # where the run of free places begins, and the last place at which so many begin
    run = np.maximum(np.maximum.accumulate(np.where(free, 0, at + 1)), begins[row])
    start = np.maximum.accumulate(np.where(at + 1 - run >= least, at + 1 - least, -1))
    ends = np.flatnonzero((gain > 0) & (start >= begins[row]))
    out = np.full(len(size), -1, np.int64)
    np.maximum.at(out, row[ends], sums[ends] - low[start[ends]])
    return out


def side_by_side(sketches: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of windows one behind the other, and where each begins and the last one ends."""
    return np.concatenate(sketches), np.concatenate([[0], np.cumsum([len(one) for one in sketches])])


def margins(own: np.ndarray, theirs: np.ndarray, begins: np.ndarray, least: int, percent: int) -> np.ndarray:
    """By how much window ``own`` may hold a passage with each window beside it that has ``least`` shingles in a row not taken.

    In hundredths of a shingle, below zero where there can be none: of shared shingles and others of either side, ``percent``
    in a hundred must be shared. Others of the partner are those between places close to each other of shingles that follow
    each other in ``own``. Where a shingle is repeated the margin is larger, never smaller.
    """
    n, m = len(begins) - 1, len(own)
    if m < least or not n:
        return np.full(n, -1, np.int64)
    known, which = np.unique(own >> BITS, return_inverse=True)
    at, there = _in(known, theirs >> BITS)
    row = np.repeat(np.arange(n), np.diff(begins))
    first = np.full((n, len(known)), -1, np.int64)
    shared = np.flatnonzero(there)[::-1]
    first[row[shared], at[shared]] = shared
    gain, cost = steps(first[:, which], own & AGAIN != 0, None if (own & TWICE).any() else np.cumsum(~there & (theirs & AGAIN == 0)), theirs & TWICE == 0, percent)
    return best_spans(gain.ravel(), cost.ravel(), np.tile(own & TAKEN == 0, n), np.arange(n + 1) * m, least)


def gains(flat: np.ndarray, begins: np.ndarray, held: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain and cost of each shingle, and whether it is free, where a passage may have its shingles from any windows that hold them."""
    row = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    gain = np.where(held, 100 - percent, np.where(flat & AGAIN != 0, 0, -percent))
    at = np.arange(len(flat))
    last = np.concatenate([[-1], np.maximum.accumulate(np.where(held, at, -1))])[:-1]
    joint = np.where(held & (last >= begins[row]), at - last, 0)
    single = np.bincount(row[flat & TWICE != 0], minlength=len(begins) - 1)[row] == 0
    return gain, np.where(joint > GAP, NEVER, np.where((joint > 1) & single, percent * BETWEEN[flat >> JOINT & 3], 0)), flat & TAKEN == 0


def partners(docs: np.ndarray, asks: np.ndarray, flat: np.ndarray, begins: np.ndarray, cuts: np.ndarray, least: int, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of an asking window and an earlier document's, of the same key, that hold a passage not taken.

    Keys' windows lie between ``cuts``, in order of document. A window whose shingles, wherever earlier windows of the key
    have them, can't make up a passage is done; others are held against the earlier windows until the passages found
    leave no room for one.
    """
    size = np.diff(begins)
    group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    _, at, which = np.unique(np.repeat(group.astype(np.uint64) << np.uint64(32), size) | flat >> BITS, return_index=True, return_inverse=True)
    doc = np.repeat(docs, size)
    asking = np.repeat(asks & (size >= least), size)
    held = doc[at][which[asking]] < doc[asking]
    rows = np.flatnonzero(asks & (size >= least))
    starts = np.concatenate([[0], np.cumsum(size[rows])])
    for j in np.flatnonzero(best_spans(*gains(flat[asking], starts, held, percent), starts, least) >= 0).tolist():
        k, span = rows[j], slice(starts[j], starts[j + 1])
        own, ends = flat[begins[k] : begins[k + 1]].copy(), np.array([0, size[k]])
        now = cuts[group[k]]
        before, many = now + np.searchsorted(docs[now : cuts[group[k] + 1]], docs[k]), NEXT
        while now < before:
            to = min(before, now + max(1, min(many, CELLS // len(own))))
            tried = np.zeros(to - now, bool)
            while True:
                score = margins(own, flat[begins[now] : begins[to]], begins[now : to + 1] - begins[now], least, percent)
                found = False
                for x in np.argsort(-score, kind="stable")[: (score >= 0).sum()].tolist():
                    if tried[x]:
                        continue
                    tried[x] = True
                    theirs = flat[begins[now + x] : begins[now + x + 1]]
                    for s, e, _, _ in matching_passages(own >> BITS, theirs >> BITS, least, percent, wanted=lambda s, e: _longest(own[s : e + 1] & TAKEN == 0) >= least):  # noqa: B023
                        found = True
                        own[s : e + 1] |= TAKEN
                    if found:
                        yield k, now + x
                        break
                if not found:
                    break
            if best_spans(*gains(own, ends, held[span], percent), ends, least)[0] < 0:
                break
            now, many = to, 4 * many


def _of_enough(pairs: DataFrame, enough: int) -> DataFrame:
    return pairs.where(F.size(F.array_distinct(F.transform("ws", lambda w: F.shiftright(w["place"], 60)))) >= enough)


def others_of_key(shared: DataFrame, texts: DataFrame, open_: DataFrame, every: DataFrame, verify, width: int, least: int, percent: int) -> DataFrame:
    """``doc, to, p``: passages of open windows that no passage of ``every`` explains, with any earlier document of their keys.

    Each window of a key comes with sketches of its shingles in order. A window and the documents in which it finds passages
    there are pairs that are read; others are never rows.
    """
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool), np.zeros(0, np.int64)]]
            flat = [np.zeros(0, np.uint32)]
            for doc, text, (key, place, asks), (s, e) in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), _numbers(batch.column("held"), "key", "place", "open"), _numbers(batch.column("cuts"), "s", "e"), strict=True):
                words = word_hashes(text)
                values = shingles_of_words(words, width)
                own = sketch(values)
                if asks.any():
                    if len(words) >= width:
                        own |= joints(words, len(own), width)
                    own[_covered(s << 30 | e, len(own))] |= TAKEN
                windows = [own[first : last + 1] for first, last in zip(*(x.tolist() for x in _ends(place)), strict=True)]
                flat += windows
                out.append([key, np.full(len(key), doc, np.int64), place, asks > 0, np.array([len(x) for x in windows], np.int64)])
            key, doc_, place, asks, size = (np.concatenate(x) for x in zip(*out, strict=True))
            ends = np.concatenate([[0], 4 * np.cumsum(size)]).astype(np.int32)
            sketches = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(flat))])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc_), pa.array(place), pa.array(asks), sketches], ["key", "doc", "place", "open", "sketch"])

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in whole_runs(batches, ["key"]):
            if not rows.num_rows:
                continue
            docs, places = rows["doc"].to_numpy(), rows["place"].to_numpy()
            sketches = [np.frombuffer(x.as_buffer(), np.uint32) for x in rows["sketch"].combine_chunks()]
            met = list(partners(docs, rows["open"].to_numpy(), *side_by_side(sketches), cuts, least, percent))
            who, to = np.array(met, np.int64).reshape(-1, 2).T
            for at in range(0, len(who), ROWS_OUT):
                part = slice(at, at + ROWS_OUT)
                yield pa.RecordBatch.from_arrays([pa.array(docs[who[part]]), pa.array(docs[to[part]]), pa.array(places[who[part]])], ["doc", "to", "place"])

    asking = open_.select("key", "doc", "place", F.lit(1).cast("long").alias("open"))
    held = shared.join(open_.select("key").distinct(), "key").join(asking, ["key", "doc", "place"], "left").select("doc", "key", "place", F.coalesce("open", F.lit(0)).alias("open"))
    held = held.groupBy("doc").agg(F.collect_list(F.struct("key", "place", "open")).alias("held"))
    sketches = _with_spans(held.join(texts, "doc"), every).select("doc", "text", "held", "cuts").mapInArrow(sketched, "key long, doc long, place long, open boolean, sketch binary")
    met = sketches.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(meeting, "doc long, to long, place long")
    pairs = settle(met.groupBy("doc", "to").agg(F.collect_set(F.struct("place", "to")).alias("ws")))
    found = settle(verify(pairs, 1).select("doc", "to", F.explode("spans").alias("p")))
    discard(pairs)
    return found


def repeated_passages(docs: DataFrame, words: int = WORDS, width: int = WIDTH, percent: int = PERCENT, hashes: int = HASHES, enough: int = ENOUGH) -> DataFrame:
    """One row per passage of ``words`` words or more that an earlier document (by id) holds too.

    ``doc_id, start, n_words`` (in words), ``source_doc_id, source_start, source_words``. A text shorter than ``words``,
    an empty or null one and a row without an id have none; letters A-Z compare as lower case. Rows that repeat an id
    are one document whose longest text is read. Passages of one document may touch. An empty table gives no rows.
    """
    least = words - width + 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    by = Window.partitionBy("key")
    before = by.orderBy("doc").rangeBetween(Window.unboundedPreceding, -1)
    shared = settle_by(
        window_rows(docs, hashes, words, width)
        .withColumns({"lead": F.min("doc").over(by), "hi": F.max("doc").over(by), "prev": F.max("doc").over(before)})
        .where("lead <> hi")
        .select("key", "doc", "place", "lead", "prev"),
        "key",
    )
    needed = shared.select("doc").distinct()
    texts = settle_by(docs.withColumnRenamed("doc_id", "doc").join(needed, "doc").groupBy("doc").agg(F.max_by("text", F.struct(F.char_length("text"), "text")).alias("text")), "doc")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The partner with most windows of a document, of those of enough functions, the first one of equals."""
        for batch in slices(batches):
            docs, tos, ws = [], [], []
            for doc, (place, lead, prev) in zip(batch.column("doc").to_pylist(), _numbers(batch.column("all"), "place", "lead", "prev"), strict=True):
                other = prev != lead
                place, to = np.concatenate([place, place[other]]), np.concatenate([lead, prev[other]])
                whom, at, n = np.unique(to, return_inverse=True, return_counts=True)
                met = np.zeros((len(whom), hashes), bool)
                met[at, place >> 60] = True
                n[met.sum(axis=1) < enough] = 0
                if n.any():
                    docs.append(doc)
                    tos.append(int(whom[n.argmax()]))
                    ws.append([place, to])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(tos, pa.int64()), _lists(ws, ["place", "to"])], ["doc", "to", "ws"])

    pairs_of = "doc long, to long, ws array<struct<place:bigint,to:bigint>>"
    later = shared.where("doc <> lead")
    most = later.groupBy("doc").agg(F.collect_list(F.struct("place", "lead", "prev")).alias("all")).mapInArrow(best, pairs_of)

    def verified(batches: Iterator[pa.RecordBatch], enough: int) -> Iterator[pa.RecordBatch]:
        """Passages of a document and a partner, and the windows with other partners that they don't explain."""
        for batch in slices(batches, 64):
            spans, rest = [], []
            for (place, whom), to, x, y in zip(_numbers(batch.column("ws"), "place", "to"), *(batch.column(c).to_pylist() for c in ("to", "x", "y")), strict=True):
                first, last = _ends(place)
                own = whom == to
                mine = list(zip(first[own].tolist(), last[own].tolist(), (place[own] >> 60).tolist(), strict=True))
                wanted = lambda s, e: len({k for f, l, k in mine if f <= e and l >= s}) >= enough
                a, b = (shingles(t, width) for t in (x, y))
                cuts = np.array(list(matching_passages(a, b, least, percent, wanted=wanted)), np.int64).reshape(-1, 4).T
                left = ~own & _unexplained(first, last, cuts[0], cuts[1], least)
                spans.append(list(cuts))
                rest.append([place[left], whom[left]])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("to"), _lists(spans, ["s", "e", "s0", "e0"]), _lists(rest, ["place", "to"])], ["doc", "to", "spans", "rest"])

    def verify(pairs: DataFrame, enough: int = enough) -> DataFrame:
        y = texts.select(F.col("doc").alias("to"), F.col("text").alias("y"))
        both = pairs.join(y, "to").join(texts.withColumnRenamed("text", "x"), "doc")
        return both.select("doc", "ws", "to", "x", "y").mapInArrow(lambda batches: verified(batches, enough), "doc long, to long, spans array<struct<s:bigint,e:bigint,s0:bigint,e0:bigint>>, rest array<struct<place:bigint,to:bigint>>")

    done = settle(verify(most))
    others = done.select("doc", F.explode("rest").alias("w")).groupBy("doc", F.col("w.to").alias("to")).agg(F.collect_list("w").alias("ws"))
    span = F.explode("spans").alias("p")
    every = settle(done.select("doc", "to", span).unionByName(verify(_of_enough(others, enough)).select("doc", "to", span)))
    discard(done)
    free = settle(open_windows(later.select("key", "doc", "place"), every, _outside))
    every = every.unionByName(exact_repeats(shared, texts, free.select("key").distinct(), every, width, least, hashes))
    open_ = settle(open_windows(free, every, lambda first, last, s, e: _unexplained(first, last, s, e, least), enough))
    discard(free)
    every = every.unionByName(others_of_key(shared, texts, open_, every, verify, width, least, percent))
    for cut in (shared, texts, open_):
        discard(cut)
    edge = width - 1
    return every.select(
        F.col("doc").alias("doc_id"),
        F.col("p.s").alias("start"),
        (F.col("p.e") - F.col("p.s") + 1 + edge).alias("n_words"),
        F.col("to").alias("source_doc_id"),
        F.col("p.s0").alias("source_start"),
        (F.col("p.e0") - F.col("p.s0") + 1 + edge).alias("source_words"),
    ).distinct()


def cut_repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` without the repeated passages of later documents; a row with nothing left goes.

    The first document of a passage keeps it. Rows without a repeated passage stay as they are. ``n_chars`` follows. Of
    rows that repeat an id, those with the text that was read for it are cut, and the others stay as they are.
    """
    spans = repeated_passages(docs, words).groupBy("doc_id").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n_words")).alias("end"))).alias("_cut"))
    again = docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id")
    read = docs.select("doc_id", "text").join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by("text", F.struct(F.char_length("text"), "text")).alias("_read"))
    held = docs.select("doc_id", F.struct("*").alias("_row"), "text").join(spans, "doc_id", "left").join(read, "doc_id", "left")
    held = held.withColumn("_cut", F.when(F.col("_read").isNull() | (F.col("text") == F.col("_read")), F.col("_cut")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in slices(batches):
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("_cut").to_pylist(), strict=True):
                places = [m.span() for m in word.finditer(text)]
                kept, at = [], 0
                for s, e in sorted((x["start"], x["end"]) for x in spans):
                    if places[min(e, len(places)) - 1][1] <= at:
                        continue
                    kept.append(text[at : max(at, places[s][0])])
                    at = places[min(e, len(places)) - 1][1]
                out.append("".join([*kept, text[at:]]).strip(" \t\n\v\f\r"))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out, pa.string())], ["_row", "text"])

    kind = held.schema["_row"].dataType.simpleString()
    changed = held.where("_cut IS NOT NULL").select("_row", "text", "_cut").mapInArrow(cut, f"_row {kind}, text string").where("text <> ''")
    whole = held.where("_cut IS NULL").select("_row", "text")
    names = docs.columns
    both = changed.unionByName(whole).withColumn("_row", F.col("_row").withField("text", F.col("text")))
    if "n_chars" in names:
        both = both.withColumn("_row", F.col("_row").withField("n_chars", F.when(F.col("text").isNull(), F.col("_row.n_chars")).otherwise(F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))))
    return both.select("_row.*")


@query("op6_repeated_passages")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages(table(spark, folder, "documents"))
