"""Toxicity of restored text: a noisy-channel decoder undoes leetspeak, spacing and repetition before scoring.

The channel turns a letter into a look-alike sign, repeats it, or sets signs and blanks between letters. Each noisy
token, or run of single letters, is a lattice: every character may be a letter, a repetition or a filler. Viterbi
search finds the likeliest reading under a letter trigram model of the whole corpus. Restored words are then weighed
by how often they, and their letter four-grams, occur in toxic rather than other labelled texts; a text's score is a
logistic function of its heaviest words.

Readings and weights of a token are kept per worker, so the work grows with distinct tokens, not with the text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from surveykit.llm.registry import query, table

#: labelled rows the classifier is fitted on, at most; the letter model counts all texts
SAMPLE = 20_000
BINS = 1 << 20
TOP = 4
BEAM = 24
#: pseudo-counts that a feature must overcome to weigh
PRIOR = 2.0
THRESHOLD = 0.7
KEPT_TOKENS = 300_000

# Letters that a sign stands for in leetspeak.
LOOKS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
CODES = {c: k + 1 for k, c in enumerate(LETTERS)}
K = len(LETTERS) + 1
_TABLE = np.zeros(0x110000, np.uint8)
for _c, _k in CODES.items():
    _TABLE[ord(_c)] = _k
LOOK_COST, REPEAT_COST, FILL_COST, LOST_COST, BREAK_COST, RARE = 0.7, 0.7, 1.5, 5.0, 3.0, 0.02

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_NOISY = re.compile(r"[^\W\d_][\d@$!|+(€£.*_~^-]+[^\W\d_]|^[\d@$!|(€£][^\W\d_]+|[^\W\d_]{2}[\d$@€£]$|([^\W\d_])\1\1")


def letter_counts(docs: DataFrame) -> DataFrame:
    """``gram, n``: letter trigrams of all texts, anything else being a boundary. At most K**3 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(K**3, np.int64)
        for batch in batches:
            held: list[str] = []
            size = 0
            for text in batch.column("text").to_pylist():
                for k in range(0, len(text or ""), 1 << 19):
                    held.append(text[max(0, k - 2) : k + (1 << 19)])
                    size += len(held[-1])
                    if size >= 1 << 19:
                        seen += _trigrams(" \n ".join(held))
                        held, size = [], 0
            if held:
                seen += _trigrams(" \n ".join(held))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _trigrams(text: str) -> np.ndarray:
    codes = _TABLE[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int32)
    grams = (codes[:-2] * K + codes[1:-1]) * K + codes[2:]
    return np.bincount(grams, minlength=K**3)


class LetterModel:
    """Costs of a letter (or the boundary, 0) after two others."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        n = np.full(K**3, RARE)
        n[grams] += counts
        n[0] = RARE
        by_two = n.reshape(K * K, K)
        self.cost = (np.log(by_two.sum(axis=1, keepdims=True)) - np.log(by_two)).reshape(K, K, K).astype(np.float32)

    def read(self, token: str) -> list[str]:
        """The likeliest words behind a noisy token; a blank in it is a place where words may join or part."""
        cost = self.cost
        beam: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        last = ""
        for c in token:
            ways: list[tuple[int | None, float]] = []
            if c in CODES:
                ways.append((CODES[c], 0.0))
                if c == last:
                    ways.append((None, REPEAT_COST))
            else:
                ways += [(CODES[x], LOOK_COST) for x in LOOKS.get(c, "")]
                ways.append((None, 0.0 if c == " " else REPEAT_COST if c == last else LOST_COST if c in LOOKS else FILL_COST))
                ways.append((0, BREAK_COST))
            last = c
            grown: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (p, q), (had, path) in beam.items():
                for out, price in ways:
                    if out is None or (out == 0 and q == 0):
                        key, total, way = (p, q), had + price, path
                    else:
                        key, total, way = (q, out), had + price + float(cost[p, q, out]), (path, out)
                    if key not in grown or total < grown[key][0]:
                        grown[key] = (total, way)
            beam = dict(sorted(grown.items(), key=lambda x: x[1][0])[:BEAM]) if len(grown) > BEAM else grown
        path = min(((had + (0.0 if q == 0 else float(cost[p, q, 0])), way) for (p, q), (had, way) in beam.items()), key=lambda x: x[0])[1]
        out = []
        while path:
            path, k = path
            out.append(" " if k == 0 else LETTERS[k - 1])
        return "".join(reversed(out)).split()


def features(word: str) -> list[int]:
    """Bins of a word: itself and its letter four-grams, its edges marked."""
    marked = f"^{word}$"
    grams = [marked[k : k + 4] for k in range(len(marked) - 3)]
    return [xxhash.xxh32_intdigest(g.encode("utf-8", "surrogatepass")) % BINS for g in [marked + "=", *grams]]


class Restorer:
    """Words of a token after decoding, kept per token."""

    def __init__(self, letters: LetterModel):
        self.letters = letters

    def words(self, token: str) -> list[str]:
        plain = _EDGE.sub("", token)
        found = [plain] if plain else []
        if " " in token or _NOISY.search(token):
            found += self.letters.read(token)
        return found


_LONE = re.compile(r"^[\W_]*[^\W_][\W_]*$")


def tokens_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def lone_runs(tokens: list[str], lone: Iterable[int]) -> Iterator[str]:
    """Runs of three or more single letters, as one token with blanks."""
    run: list[int] = []
    for at in [*lone, -9]:
        if run and at != run[-1] + 1:
            if len(run) >= 3:
                yield " ".join(tokens[k] for k in run)
            run = []
        run.append(at)


class Weights(dict):
    """Token to the weight of the heaviest word in it; a token that is a single letter has 1000 added."""

    def __init__(self, restorer: Restorer, weights: dict[int, float]):
        super().__init__()
        self.restorer, self.weights = restorer, weights

    def __missing__(self, token: str) -> float:
        if len(self) >= KEPT_TOKENS:
            self.clear()
        most = 0.0
        for word in self.restorer.words(token):
            most = max(most, max((self.weights.get(f, 0.0) for f in features(word)), default=0.0))
        self[token] = most = most + (1000.0 if _LONE.match(token) else 0.0)
        return most

    def heaviest(self, text: str | None) -> np.ndarray:
        """The ``TOP`` largest weights of the text, and the logarithm of its words."""
        tokens = tokens_of(text)
        found = np.fromiter(map(self.__getitem__, tokens), np.float64, len(tokens))
        lone = np.flatnonzero(found >= 1000)
        found[lone] -= 1000
        if len(lone) >= 3:
            found = np.append(found, [self[run] for run in lone_runs(tokens, lone.tolist())])
        top = np.zeros(TOP + 1)
        best = np.sort(found)[-TOP:][::-1] if len(found) <= TOP else np.sort(np.partition(found, -TOP)[-TOP:])[::-1]
        top[: len(best)] = best
        top[TOP] = math.log1p(len(tokens))
        return top


_OPEN: dict[str, Weights] = {}


def _opened(key: str, letters: LetterModel, weights: dict[int, float]) -> Weights:
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Weights(Restorer(letters), weights)
    return _OPEN[key]


def feature_counts(labelled: DataFrame, letters: LetterModel) -> DataFrame:
    """``bin, toxic, other``: labelled texts of each kind that have the feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, known = Restorer(letters), {}
        seen = np.zeros((2, BINS), np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                tokens = tokens_of(text)
                lone = [k for k, t in enumerate(tokens) if len(t) < 4 and _LONE.match(t)]
                own: set[int] = set()
                for token in {*tokens, *lone_runs(tokens, lone)}:
                    if token not in known:
                        if len(known) >= KEPT_TOKENS:
                            known.clear()
                        known[token] = [f for word in restorer.words(token) for f in features(word)]
                    own.update(known[token])
                seen[0 if toxic else 1, list(own)] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], ["bin", "toxic", "other"])

    return labelled.mapInArrow(run, "bin long, toxic long, other long").groupBy("bin").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients, the intercept last, by Newton steps with a ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs`` (``doc_id, text``).

    Learns from rows of ``labels`` (``doc_id, toxic``) that aren't held out, by hash order up to ``sample``. A null or
    empty text scores like one without a heavy word. Repeated rows score alike; a null id isn't held out. Without
    labelled texts of both kinds every score is the share of toxic ones, 0 without any. Other columns are not read.
    """
    docs = docs.select("doc_id", "text")
    grams = letter_counts(docs).toArrow()
    letters = LetterModel(grams.column("gram").to_numpy(), grams.column("n").to_numpy())
    chosen = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic").distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    # at most `sample` rows of two numbers
    labelled = docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    kinds = {bool(r.toxic): r.n for r in labelled.groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    toxic, other = kinds.get(True, 0), kinds.get(False, 0)
    if not toxic or not other:
        flat = 1.0 if toxic else 0.0
        return docs.select("doc_id", held_out().alias("held_out"), F.lit(flat).alias("score"), F.lit(int(flat >= threshold)).alias("predicted"))
    counts = feature_counts(labelled.withColumn("toxic", F.col("toxic") == 1), letters)
    share = toxic / (toxic + other)
    lift = (F.col("toxic") + PRIOR * share) / (F.col("other") + PRIOR * (1 - share)) * ((1 - share) / share)
    heavy = counts.where("toxic >= 2").select("bin", F.log(lift).alias("w")).where("w > 0.5").toArrow()
    weights = dict(zip(heavy.column("bin").to_pylist(), heavy.column("w").to_pylist(), strict=True))
    key = xxhash.xxh64_hexdigest(repr(sorted(weights.items())))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _opened(key, letters, weights)
        for batch in batches:
            tops = np.array([own.heaviest(t) for t in batch.column("text").to_pylist()]).reshape(-1, TOP + 1)
            yield pa.RecordBatch.from_arrays([*(pa.array(tops[:, k]) for k in range(TOP + 1)), batch.column("toxic")], [*(f"x{k}" for k in range(TOP + 1)), "toxic"])

    schema = ", ".join(f"x{k} double" for k in range(TOP + 1)) + ", toxic boolean"
    seen = labelled.withColumn("toxic", F.col("toxic") == 1).mapInArrow(measure, schema).toArrow()
    x = np.column_stack([seen.column(f"x{k}").to_numpy() for k in range(TOP + 1)])
    model = fit_logistic(x, seen.column("toxic").to_numpy(zero_copy_only=False).astype(float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _opened(key, letters, weights)
        for batch in batches:
            tops = np.array([own.heaviest(t) for t in batch.column("text").to_pylist()]).reshape(-1, TOP + 1)
            scores = 1 / (1 + np.exp(-np.clip(tops @ model[:-1] + model[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")


@query("op1_toxicity")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
