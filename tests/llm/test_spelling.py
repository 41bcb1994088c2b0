"""Spelling variants beside a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from surveykit.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def want(rows, least=3, ratio=2, slip=97):
    n = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= 5
    n = {w: k for w, k in n.items() if k >= least}
    others = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(others[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: v if v is not None and n[v] >= ratio * n[w] else None for w, v in form.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n[w], len(others[w]), n.get(form[w], 0)) for w in n)


def rows_of(frame):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in frame.collect())


def some_words(r, n, signs="abé", low=4, high=9):
    return ["".join(r.choice(signs) for _ in range(r.randrange(low, high))) for _ in range(n)]


def test_index_finds_all_words_one_edit_away():
    r = random.Random(7)
    for signs, n in (("ab", 60), ("abcÿ", 300), ("a", 5)):
        words = sorted(set(some_words(r, n, signs, 1, 9)))
        index = spelling.DelimitedIndex(words)
        asked = words + some_words(r, 100, signs + "z", 1, 10)
        change, exact = np.array([r.choice([-1, 0, 1]) for _ in asked]), np.array([r.randrange(len(w) + 1) for w in asked])
        got = list(zip(*(x.tolist() for x in index.near(asked, change, exact)), strict=True))
        hits = [(k, t) for k, w in enumerate(asked) for t, v in enumerate(words) if len(v) == len(w) + change[k] and near(w, v) and next((i for i, (x, y) in enumerate(zip(w, v, strict=False)) if x != y), min(len(w), len(v))) >= exact[k]]
        assert sorted(got) == hits and len(set(got)) == len(got)


@pytest.mark.parametrize("shard", [7, 4096])
def test_variants_equal_brute_force(docs_of, shard):
    r = random.Random(3)
    pool = some_words(r, 400) + ["fünfzig", "Fünfzig", "FÜNFZIG", "aaaaa", "aaaaaa", "aaaaaaa", "×÷×÷×", "word", "_words_", "İstanbul"]
    weight = [1 / (k % 37 + 1) for k in range(len(pool))]
    rows = [(None if k == 5 else k // 2, " ".join(r.choices(pool, weight, k=60)) + f" {k}\n", "s") for k in range(60)] + [(900, None, "s"), (901, "", "s")]
    out = spelling.variants(docs_of(rows).repartition(3), shard=shard)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(out) == want(rows)


def test_chains_ties_and_slips(docs_of):
    chain = ["abcdefghij"[: 5 + k] for k in range(6)]
    texts = [" ".join(f"{w} " * 3 ** (k + 1) for k, w in enumerate(chain))] + ["mouse house louse " * 4 + "rouse " * 2 + "rouse"]
    rows = list((k, t, "s") for k, t in enumerate(texts))
    got = rows_of(spelling.variants(docs_of(rows), slip=10**12))
    assert got == want(rows, slip=10**12)
    assert {g[2] for g in got if g[0].startswith("abcde")} == {"abcdefghij"} and ("rouse", "", "rouse", 3, 3, 0) in got
    rows = [(k, "stretch letters Ärger " * 9, "s") for k in range(40)]
    assert rows_of(spelling.variants(docs_of(rows), slip=3)) == want(rows, slip=3)


def test_edges(docs_of):
    assert spelling.variants(docs_of([])).count() == 0
    assert spelling.variants(docs_of([None, "", "one two 123"])).count() == 0
    r = random.Random(1)
    long = "".join(r.choice("abc") for _ in range(30_000))
    rows = [(k, f"{long} {long[:-1]}x {long[1:]} {'b' * 3000} {'b' * 3001}", "s") for k in range(4)]
    assert rows_of(spelling.variants(docs_of(rows), slip=10**12)) == want(rows, slip=10**12)
