"""Spelling variants: words one edit apart, found by search schemes on FM-indexes, and each word's commoner form.

A word and a word one edit away agree on either half of the latter. Two searches cover both cases: one matches the
first half exactly from the left and extends to the right, one matches the second half from the right and extends to
the left; either allows one error in the part it extends over. As searches are anchored at a delimiter, each runs in one
direction, so of the two-way index each needs one side: the index of the reversed vocabulary for extending to the right,
that of the vocabulary for extending to the left. A match is an interval of suffix ranks.

The vocabulary is spread by (direction, length, half) over shards of bounded size, each indexed in one task; a word is
sent to the shards of the six halves it can agree on. A half that more words share than a shard holds is cut into blocks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from surveykit.llm.bpe import slices
from surveykit.llm.registry import query, table
from surveykit.session import discard, settle

SHORTEST = 5
LEAST = 3
#: a form is at least so many times as frequent as the word
RATIO = 2
#: one run in so many loses a code point
SLIP = 97
#: words of a shard
SHARD = 4096
#: distinct words counted by a task before it hands them on
KEPT = 200_000
#: words searched at a time
BATCH = 2048
_RUN = re.compile(f"[a-zÀ-ÿ]{{{SHORTEST},}}")


def slipped(word: str, doc: int, slip: int = SLIP) -> str:
    """The word, or where the checksum of its document (``doc``: of ``<doc_id>:``) and itself says so, one shorter."""
    h = zlib.crc32(word.encode(), doc)
    if h % slip:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def vocabulary(docs: DataFrame, least: int = LEAST, slip: int = SLIP) -> DataFrame:
    """``word, n`` of all texts; each task adds up its own counts before the shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                doc = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # bytes lower only A-Z
                for word, n in Counter(_RUN.findall(text.encode().lower().decode())).items():
                    word = slipped(word, doc, slip)
                    if len(word) >= SHORTEST:
                        total[word] += n
            if len(total) >= KEPT:
                yield out()
                total.clear()
        if total:
            yield out()

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class DelimitedIndex:
    """FM-index of distinct words between delimiters, searched from a delimiter to the right.

    The text holds each word reversed, so that prepending to a match is reading on in the word. It is a circle: the
    last delimiter stands before the first word.
    """

    def __init__(self, words: list[str]):
        signs = sorted({c for w in words for c in w})
        self.code = {c: k + 1 for k, c in enumerate(signs)}
        self.signs = len(signs) + 1
        text = np.array([s for w in words for s in (*map(self.code.__getitem__, reversed(w)), 0)], np.int64)
        self.n = n = len(text)
        self.ranks = ranks = self._sorted_turns(text)
        self.bwt = bwt = text[ranks - 1]
        #: places of each sign in the transform, ordered by sign and place: a step is two searches in it
        self.places = np.sort(bwt * n + np.arange(n))
        ends = np.flatnonzero(text == 0)
        self.word_behind = np.zeros(n, np.int64)
        self.word_behind[ends] = np.roll(np.arange(len(words)), -1)

    @staticmethod
    def _sorted_turns(text: np.ndarray) -> np.ndarray:
        """Starts of the circle's turns in order, by doubling the length compared."""
        n, wide = len(text), 1
        rank = text
        while True:
            key = rank * (int(rank.max()) + 1) + np.roll(rank, -wide)
            order = np.argsort(key, kind="stable")
            fresh = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1:
                return order
            wide *= 2

    def step(self, sign: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals read on by one sign; a sign below 0 occurs nowhere."""
        at = sign * self.n
        low, high = np.searchsorted(self.places, at + low), np.searchsorted(self.places, at + high)
        return low, np.where(sign < 0, low, high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, sign) for each sign but the delimiter that follows an interval: by its ranks, or by all signs if fewer."""
        wide = high - low > self.signs
        few = np.flatnonzero(~wide)
        size = (high - low)[few]
        row = np.repeat(few, size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[row]
        seen = np.unique(row * self.signs + self.bwt[place])
        every = (np.flatnonzero(wide)[:, None] * self.signs + np.arange(self.signs)).ravel()
        both = np.concatenate([seen, every])
        both = both[both % self.signs > 0]
        return both // self.signs, both % self.signs

    def near(self, words: list[str], change: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, word of the index) one edit apart: ``change`` -1, 0, 1 as the found word is shorter, equal or longer.

        The first ``exact`` signs agree and the edit lies behind them.
        """
        length = np.array([len(w) for w in words])
        own = np.full((len(words), int(length.max(initial=0)) + 1), -1, np.int64)
        for k, w in enumerate(words):
            own[k, : len(w)] = [self.code.get(c, -1) for c in w]
        own[np.arange(len(words)), length] = 0
        row = np.arange(len(words))
        low, high = self.step(np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full(len(words), self.n))
        states = []
        for i in range(own.shape[1]):
            at = np.flatnonzero(exact[row] <= i)
            kind, sign = change[row[at]], own[row[at], i]
            inside = i < length[row[at]]
            # one sign less: of a run of equal signs the last one goes
            gone = at[(kind == -1) & inside & (sign != own[row[at], np.minimum(i + 1, own.shape[1] - 1)])]
            states.append((row[gone], np.full(len(gone), i + 1), low[gone], high[gone]))
            # another sign in its place, or one more before it
            other = at[((kind == 0) & inside) | (kind == 1)]
            k, sign = self.branches(low[other], high[other])
            differs = sign != own[row[other[k]], i]
            k, sign = other[k[differs]], sign[differs]
            l, h = self.step(sign, low[k], high[k])
            states.append((row[k], np.where(change[row[k]] == 0, i + 1, i), l, h))
            on = np.flatnonzero(i < length[row])
            row = row[on]
            low, high = self.step(own[row, i], low[on], high[on])
            some = low < high
            row, low, high = row[some], low[some], high[some]
        row, at, low, high = (np.concatenate(c) for c in zip(*states, strict=True))
        found = []
        while len(row):
            low, high = self.step(own[row, at], low, high)
            some = low < high
            done = some & (at == length[row])
            found.append(np.stack([row[done], self.word_behind[self.ranks[low[done]]]]))
            row, at, low, high = row[some & ~done], at[some & ~done] + 1, low[some & ~done], high[some & ~done]
        found = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return found[0], found[1]


def _half(side, length):
    """Signs of a word of ``length`` that the direction matches exactly: the first half, or what is behind it."""
    return length // 2 if side == 0 else length - length // 2


def _best_near(index: DelimitedIndex, side: int, known: list[str], frequent: list[int], words: list[str], change: np.ndarray) -> dict[int, tuple[int, int, str]]:
    """By row of ``words`` that has near words: their number, the frequency (negative) of the commonest, and that word."""
    exact = np.array([_half(side, len(w) + c) for w, c in zip(words, change.tolist(), strict=True)])
    best: dict[int, tuple[int, int, str]] = {}
    for k, t in np.stack(index.near(words if side == 0 else [w[::-1] for w in words], change, exact), axis=1).tolist():
        near = known[t]
        first = len(near) // 2
        if side == 1 and near[:first] == words[k][:first]:
            continue  # found from the left as well
        n, low, name = best.get(k, (0, 0, ""))
        new = (-frequent[t], near)
        best[k] = (n + 1, *(min((low, name), new) if n else new))
    return best


def _searched(words: DataFrame, shard: int) -> DataFrame:
    """``word, k, best_n, best``: partial counts of near words, and the commonest, of each shard a word is sent to."""
    count = words.count()
    shards = max(1, -(-2 * count // shard))
    size = F.length("word")
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    half = F.floor(F.col("length") / 2).cast("int")
    matched = F.when(F.col("side") == 0, half).otherwise(F.col("length") - half)
    piece = F.when(F.col("side") == 0, F.expr("substring(word, 1, matched)")).otherwise(F.expr("substring(word, size - matched + 1, matched)"))
    fields = ["side", "length", "piece"]

    def routed(change):
        out = words.select("word", "n", size.alias("size"), sides, change)
        out = out.withColumn("length", F.col("size") + F.col("change")).where(F.col("length") >= SHORTEST)
        return out.withColumn("matched", matched).withColumn("piece", piece).select("word", "n", "change", *fields)

    held = routed(F.lit(0).alias("change"))
    asked = routed(F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("change"))
    crowded = settle(held.groupBy(*fields).count().where(F.col("count") > shard).select(*fields, F.ceil(F.col("count") / shard).cast("int").alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("word"), blocks).cast("int")
    held = held.join(crowded, fields, "left").select(*fields, own.alias("block"), F.lit(0).alias("role"), "word", "n", "change")
    asked = asked.join(crowded, fields, "left").select(*fields, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(1).alias("role"), "word", "n", "change")
    place = F.pmod(F.xxhash64(*fields, "block"), F.lit(shards))
    met = held.unionByName(asked).select("side", place.alias("shard"), "role", "word", "n", "change")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's own words come first and are held; the words sent to it pass by."""
        place, known, frequent, index = None, [], [], None
        for batch in batches:
            values = np.stack([batch.column(c).to_numpy() for c in ("side", "shard", "role")])
            cuts = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
            for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if at == end:
                    continue
                side, shard_no, role = values[:, at].tolist()
                if place != (side, shard_no):
                    place, known, frequent, index = (side, shard_no), [], [], None
                words = batch.column("word").slice(at, end - at).to_pylist()
                if role == 0:
                    known += words
                    frequent += batch.column("n").slice(at, end - at).to_pylist()
                    continue
                if not known:
                    continue
                index = index or DelimitedIndex(known if side == 0 else [w[::-1] for w in known])
                change = batch.column("change").slice(at, end - at).to_numpy()
                for k in range(0, len(words), BATCH):
                    best = _best_near(index, side, known, frequent, words[k : k + BATCH], change[k : k + BATCH])
                    if best:
                        counts, low, names = zip(*best.values(), strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array([words[k + i] for i in best]), pa.array(counts, pa.int64()), pa.array([-n for n in low], pa.int64()), pa.array(names)], ["word", "k", "best_n", "best"])

    return met.repartition("side", "shard").sortWithinPartitions("side", "shard", "role").mapInArrow(search, "word string, k long, best_n long, best string")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words that have a form: each round follows twice as many forms, which grow in number."""
    current = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = F.col("further").isNotNull().alias("moved")
        before, current = current, settle(current.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), moved))
        discard(before)
        if not current.where("moved").limit(1).count():
            return current.select("word", "root")


def variants(docs: DataFrame, least: int = LEAST, ratio: int = RATIO, slip: int = SLIP, shard: int = SHARD) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of ``docs`` (``doc_id, text``).

    A null or empty text has no words; a null id stands as an empty text before the colon of the checksum. Rows that
    repeat an id are read one by one. Ties of the commonest near word go to the smallest in code-point order. A word
    without a form is its own root. An empty table gives no rows; other columns are not read. Words may be of any length.
    """
    words = settle(vocabulary(docs, least, slip))
    found = _searched(words, shard)
    best = F.min(F.struct((-F.col("best_n")).alias("low"), F.col("best").alias("name"))).alias("best")
    near = found.groupBy("word").agg(F.sum("k").alias("n_near"), best)
    commoner = -F.col("best.low") >= ratio * F.col("n")
    formed = settle(
        words.join(near, "word", "left").select(
            "word",
            F.when(commoner, F.col("best.name")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(commoner, -F.col("best.low")).alias("form_n"),
        )
    )
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


OP12_SQL = f"""
WITH RECURSIVE
bits(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT i, c FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= {SHORTEST} GROUP BY ALL),
walk(doc_id, run, k, h, j, c) AS (
  SELECT doc_id, run, k, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run), 0, 4294967295 FROM runs
  UNION ALL
  SELECT w.doc_id, w.run, w.k, w.h, w.j + 1, xor(w.c >> 8, t.c)
  FROM walk w JOIN crc t ON t.i = xor(w.c & 255, CAST('0x' || substr(w.h, 2 * w.j + 1, 2) AS BIGINT))
  WHERE 2 * w.j < length(w.h)),
hashed AS (SELECT run, k, xor(c, 4294967295) AS h FROM walk WHERE 2 * j = length(h)),
read_as AS (
  SELECT CASE WHEN h % {SLIP} = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM read_as WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(k) >= {LEAST}),
without AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM without a JOIN without b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM without a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, n, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM pairs),
formed AS (
  SELECT w.word, CASE WHEN b.near_n >= {RATIO} * w.n THEN b.near END AS form, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= {RATIO} * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.r = 1),
follow(word, last) AS (
  SELECT word, word FROM formed
  UNION ALL SELECT f.word, g.form FROM follow f JOIN formed g ON g.word = f.last WHERE g.form IS NOT NULL)
SELECT o.word, o.form, l.last AS root, o.n, o.n_near, o.form_n
FROM formed o JOIN (SELECT f.word, f.last FROM follow f JOIN formed g ON g.word = f.last WHERE g.form IS NULL) l ON l.word = o.word
"""


@query("op12_spelling_variants", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return variants(table(spark, folder, "documents"))
