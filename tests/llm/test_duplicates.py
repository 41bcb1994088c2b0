"""Near-duplicate operators beside brute force on small tables with hot groups."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from surveykit.llm import embeddings, ngram_join, passages


def words(r, n, pool=4000):
    return [f"w{r.randrange(pool)}" for _ in range(n)]


def edited(r, text, n):
    text = list(text)
    for _ in range(n):
        text[r.randrange(len(text))] = f"e{r.randrange(10**6)}"
    return text


def family_texts(seed=1):
    r = random.Random(seed)
    line = words(r, 8)
    texts = [None, "", "  ", "One two", "one TWO", "one two three four five", "One\ttwo three four FIVE"]
    base = words(r, 120)
    texts += [" ".join(base)] * 15
    texts += [" ".join(edited(r, base, r.randrange(1, 6))) for _ in range(60)]
    for _ in range(60):
        own = words(r, r.randrange(6, 300)) + line
        texts.append(" ".join(own))
        if r.random() < 0.5:
            texts.append(" ".join(edited(r, own, r.randrange(1, 8))))
    texts.append(" ".join(words(r, 20_000, 10**6)))
    texts.append(texts[-1] + " more words at the end")
    return texts


def brute_components(texts, percent=75):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    low = list(range(len(sets)))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            low[y] = x
    return {k: (len(s), find(k)) for k, s in enumerate(sets)}


def test_ngram_join_equals_brute_force(docs_of):
    texts = family_texts()
    docs = docs_of(texts)
    want = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs).collect()}
    assert got == want
    kept = ngram_join.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, (_, c) in want.items() if k == c)


def test_ngram_join_edges(docs_of):
    assert ngram_join.ngram_components(docs_of([])).count() == 0
    rows = [(None, "a b c d e f", "s"), (None, None, "s"), (4, "a b c d e f", "s"), (4, "a b c d e f", "s"), (2, "x y z", "s")]
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id is not None and r.component_id or -1) for r in ngram_join.ngram_components(docs_of(rows)).collect())
    assert got == [(False, 0, 0, -1), (False, 0, 2, 4), (True, 2, 1, 2), (True, 4, 2, 4), (True, 4, 2, 4)]
    kept = sorted(str(r.doc_id) for r in ngram_join.keep_one_per_group(docs_of(rows)).collect())
    assert kept == ["2", "4", "None", "None"]


def test_tree_traversal_is_exact_for_any_split(monkeypatch):
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 2**63, r.integers(1, 900)).astype(np.uint64)) for _ in range(40)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * 0.9)], r.integers(0, 2**63, 5).astype(np.uint64)])) for s in sets]
    bits, ones, wide = ngram_join._unfolded([ngram_join._bitmap(s) for s in sets])
    cls, n = np.arange(len(sets)), np.array([len(s) for s in sets])
    want = set()
    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 75 * (n[a] + n[b] - both):
            want.add((a, b))
    label = cls.copy()
    tree = ngram_join.Tree(cls, n, label, bits, ones, wide)
    pairs = {tuple(sorted(p)) for x, y in ngram_join.dual_traversal(tree, tree, 75) for p in zip(x.tolist(), y.tolist(), strict=True)}
    assert want and want <= pairs and len(pairs) < 4 * len(want)
    left = cls % 3 == 0
    one, two = (ngram_join.Tree(cls[m], n[m], label[m], bits[m], ones[m], wide[m]) for m in (left, ~left))
    crossed = {tuple(sorted(p)) for x, y in ngram_join.dual_traversal(one, two, 75) for p in zip(x.tolist(), y.tolist(), strict=True)}
    assert {p for p in want if left[p[0]] != left[p[1]]} <= crossed
    same = np.zeros(len(sets), np.int64)
    assert not list(ngram_join.dual_traversal(t := ngram_join.Tree(cls, n, same, bits, ones, wide), t, 75))


def test_bounds_of_narrow_bitmaps_beside_a_wide_one():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in (100, 100, 4000)]
    bits, ones, wide = ngram_join._unfolded([ngram_join._bitmap(s) for s in sets])
    assert len(set(wide.tolist())) == 2
    alone, _, own = ngram_join._unfolded([ngram_join._bitmap(s) for s in sets[:2]])
    assert ngram_join._shared_bits(bits[0], bits[1], wide[0]) == ngram_join._shared_bits(alone[0], alone[1], own[0])
    tree = ngram_join.Tree(np.arange(3), np.array([len(s) for s in sets]), np.arange(3), bits, ones, wide)
    assert not list(ngram_join.dual_traversal(tree, tree, 75))


def test_ngram_join_of_repeated_ids(docs_of):
    b, c, d = (" ".join(f"{k}{i}" for i in range(30)) for k in "bcd")
    rows = [(5, b, "s"), (5, c, "s"), (9, c + " y", "s")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs_of(rows)).collect())
    assert got == [(5, 26, 5), (5, 26, 5), (9, 27, 5)]
    rows = [(1, b, "s"), (5, b, "s"), (5, c, "s"), (7, b, "s"), (7, d, "s"), (7, d, "s"), (8, c + " y", "s")]
    kept = sorted((r.doc_id, r.text) for r in ngram_join.keep_one_per_group(docs_of(rows)).collect())
    assert kept == [(1, b), (5, c), (7, d)]


def test_split_trees_find_the_same(docs_of, monkeypatch):
    monkeypatch.setattr(ngram_join, "TREE_SETS", 4)
    texts = family_texts(2)[:120]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs_of(texts)).collect()}
    assert got == brute_components(texts)


def test_compact_windows_equal_definition():
    r = np.random.default_rng(1)
    for n, width in ((0, 3), (2, 3), (3, 3), (50, 7), (64, 8), (5, 1)):
        values = r.integers(0, 30, n).astype(np.uint64)
        low, first, last = passages.compact_windows(values, width)
        of = {}
        for k, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
            for i in range(a, b - width + 2):
                of[i] = low[k]
        assert of == {i: values[i : i + width].min() for i in range(n - width + 1)}


def test_passages(docs_of):
    r = random.Random(7)
    shared, short = words(r, 70), words(r, 40)
    texts = [None, "", "few words"]
    for k in range(60):
        own = words(r, 150, 10**6)
        at = r.randrange(len(own))
        if k % 3 == 0:
            own[at:at] = shared
        elif k % 3 == 1:
            own[at:at] = short
        texts.append(" ".join(own))
    copy = " ".join(words(r, 90, 10**6))
    texts += [copy] * 8
    near = words(r, 300, 10**6)
    texts += [" ".join(near), " ".join(edited(r, near, 5)).upper()]
    docs = docs_of(texts)
    found = passages.repeated_passages(docs).collect()
    with_shared = [k for k, t in enumerate(texts) if t and " ".join(shared) in t]
    copies = [k for k, t in enumerate(texts) if t == copy]
    last = len(texts) - 1
    assert {f.doc_id for f in found} == {*with_shared[1:], *copies[1:], last}
    for f in found:
        w = texts[f.doc_id].split()
        if f.doc_id in with_shared:
            assert f.source_doc_id in with_shared and " ".join(w[f.start : f.start + f.n_words]) == " ".join(shared)
        elif f.doc_id in copies:
            assert (f.start, f.n_words) == (0, 90)
    assert sum(f.n_words for f in found if f.doc_id == last) >= 250
    cut = {x.doc_id: x for x in passages.cut_repeats(docs).collect()}
    assert sorted(set(range(len(texts))) - set(cut)) == [*copies[1:], last]
    for k, t in enumerate(texts):
        if k in cut and k not in with_shared[1:] and k != last:
            assert cut[k].text == t
    for k in with_shared[1:]:
        assert " ".join(shared) not in cut[k].text and len(cut[k].text.split()) == 150 and cut[k].n_chars == len(cut[k].text)
    assert passages.cut_repeats(docs).columns == docs.columns
    assert passages.repeated_passages(docs_of([])).count() == 0
    twice = [(None, copy, "s"), (3, copy, "s"), (3, copy, "s"), (4, copy, "s")]
    assert {(f.doc_id, f.source_doc_id) for f in passages.repeated_passages(docs_of(twice)).collect()} == {(4, 3)}


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], "vec_id long, embedding array<float>, cls int, key string")


def test_embeddings_equal_brute_force(spark, monkeypatch):
    r = np.random.default_rng(5)
    centres = r.standard_normal((12, 32))
    x = np.concatenate([r.standard_normal((300, 32)), *(c + 0.08 * r.standard_normal((40, 32)) for c in centres), np.repeat(centres[:1], 30, axis=0)]).astype(np.float32)
    x = x[r.permutation(len(x))]
    rows = [(int(k) + 10, v.tolist()) for k, v in enumerate(x)]
    extra = [(1, None), (2, [0.0] * 32), (3, [float("nan")] * 32), (4, [1.0, None] * 16), (5, [1.0]), (None, x[0].tolist())]
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    got = {v.vec_id: v for v in embeddings.near_duplicates(vectors(spark, rows + extra)).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    like = unit @ unit.T >= 0.9
    np.fill_diagonal(like, False)
    found = sum(got[k + 10].n_links for k in range(len(x)))
    assert 0.9 * like.sum() <= found <= like.sum()
    assert all(got[k + 10].n_links <= n for k, n in enumerate(like.sum(axis=1)))
    assert all(v.kept == (v.vec_id == v.component_id) for v in got.values() if v.vec_id is not None)
    for k in (1, 2, 3, 4, 5):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True)
    assert got[None].n_links == 0
    for k in range(len(x)):
        assert got[k + 10].component_id <= k + 10


def test_embeddings_edges(spark):
    assert embeddings.near_duplicates(vectors(spark, [])).count() == 0
    same = [(k, [1.0, 2.0, 3.0]) for k in range(5)] + [(9, [2.0, 4.0, 6.0]), (12, [-1.0, 0.0, 0.5])]
    got = {v.vec_id: (v.n_links, v.component_id) for v in embeddings.near_duplicates(vectors(spark, same)).collect()}
    assert got == {0: (5, 0), 1: (5, 0), 2: (5, 0), 3: (5, 0), 4: (5, 0), 9: (5, 0), 12: (0, 12)}


def test_passages_behind_popular_runs(docs_of):
    """Every older document holds a run of the passage, and documents between source and copy hold it too."""
    r = random.Random(11)
    run = words(r, 44, 10**6)
    filler = lambda: words(r, 80, 10**6)
    popular = lambda n: [" ".join([*filler(), *run, *filler()]) for _ in range(n)]
    passages_ = [[*words(r, 8, 10**6), *run, *words(r, 8, 10**6)] for _ in range(12)]
    near = [edited(r, p, 1) for p in passages_[6:]]
    texts = popular(25) + [" ".join([*filler(), *p, *filler()]) for p in passages_] + popular(25)
    at = len(texts)
    texts += [" ".join([*filler(), *p, *filler()]) for p in passages_[:6] + near]
    found = passages.repeated_passages(docs_of(texts)).collect()
    exact = {(f.doc_id, f.source_doc_id): f for f in found}
    for k in range(6):
        f = exact[at + k, 25 + k]
        assert texts[f.doc_id].split()[f.start : f.start + f.n_words] == passages_[k]
    assert {f.doc_id for f in found} <= set(range(at, at + 12))


def test_passages_of_two_sources_that_overlap(docs_of):
    x = words(random.Random(3), 131, 10**6)
    found = passages.repeated_passages(docs_of([" ".join(x[:100]), " ".join(x[60:]), " ".join(x)])).collect()
    assert {(f.doc_id, f.source_doc_id, f.start, f.n_words) for f in found} >= {(2, 0, 0, 100)}
    covered = {w for f in found if f.doc_id == 2 for w in range(f.start, f.start + f.n_words)}
    assert covered == set(range(131))


def pairs_of_bands(shared, bands, n, dim=64):
    """2 n vectors a band with a mean cosine of ``shared``; vector k and its partner are at the band's cosine."""
    r = np.random.default_rng(8)
    ways = np.linalg.qr(r.standard_normal((dim, dim)))[0]
    x = r.standard_normal((len(bands) * n, dim - 1))
    x = np.sqrt(1 - shared) * x / np.linalg.norm(x, axis=1, keepdims=True)
    x = np.concatenate([np.full((len(x), 1), np.sqrt(shared)), x], axis=1) @ ways
    z = r.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = np.repeat(bands, n)[:, None]
    return np.concatenate([x, c * x + np.sqrt(1 - c * c) * z]).astype(np.float32)


@pytest.mark.parametrize("shared", [0.0, 0.5, 0.8, 0.9])
def test_embeddings_recall_by_band(spark, shared):
    """Links at cosines from 0.90 up, 64 components, with and without a direction that all vectors have in common."""
    bands = (0.901, 0.92, 0.95, 0.98)
    x = pairs_of_bands(shared, bands, 150)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    like = unit @ unit.T
    np.fill_diagonal(like, 0)
    got = {v.vec_id: v.n_links for v in embeddings.near_duplicates(vectors(spark, [(k, v.tolist()) for k, v in enumerate(x)])).collect()}
    found, true = np.array([got[k] for k in range(len(x))]), (like >= 0.9).sum(axis=1)
    assert (found <= true).all()
    for b in range(len(bands)):
        own = slice(b * 150, (b + 1) * 150)
        assert found[own].sum() >= 0.99 * true[own].sum(), (bands[b], found[own].sum(), true[own].sum())


def test_codes_meet_in_some_table_by_band():
    """The search alone, as it is set for 2^20 vectors: pairs of each band that share a key and pass the filter."""
    for shared in (0.0, 0.5, 0.8, 0.9):
        x = pairs_of_bands(shared, (0.9, 0.95), 1000).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        n = embeddings.tables_of(20, 0.9)
        bits = embeddings.Codes(x[:1500], 20 * n, rounds=5).bits(x)
        keys = embeddings.chunk_keys(bits, 20)
        half = len(x) // 2
        near = (bits[:half, : embeddings.FILTER_BITS] != bits[half:, : embeddings.FILTER_BITS]).sum(axis=1) <= embeddings.REACH * embeddings.FILTER_BITS
        met = (keys[:half] == keys[half:]).any(axis=1) & near
        assert met[:1000].mean() >= 0.99 and met[1000:].mean() >= 0.999


def test_embeddings_of_unlike_lengths_and_few_components(spark):
    r = np.random.default_rng(3)
    turns = r.uniform(0, 2 * np.pi, 60)
    flat = np.stack([np.cos(turns), np.sin(turns)], axis=1)
    rows = [(k, [1.0, 2.0, 3 + k / 1000]) for k in range(5)] + [(10, [2.0]), (11, [5.0]), (12, [-1.0])]
    rows += [(100 + k, v.tolist()) for k, v in enumerate(flat)]
    got = {v.vec_id: (v.n_links, v.component_id) for v in embeddings.near_duplicates(vectors(spark, rows)).collect()}
    assert [got[k] for k in range(5)] == [(4, 0)] * 5
    assert (got[10], got[11], got[12]) == ((1, 10), (1, 10), (0, 12))
    true = (flat @ flat.T >= 0.9).sum() - 60
    assert 0.99 * true <= sum(got[100 + k][0] for k in range(60)) <= true


def test_labels_and_left_labels_keep_components():
    """Pairs that come in portions: rows with their labels, and labels left, hold each component together."""
    r = np.random.default_rng(4)

    def roots(n, edges):
        root = list(range(n))
        for a, b in edges:
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        return [next(x for x in iter(lambda x=[k]: x.__setitem__(0, root[x[0]]) or x[0], None) if root[x] == x) for k in range(n)]

    for _ in range(60):
        cls, low, edges, held = np.arange(30), np.arange(30), [], []
        for _ in range(6):
            x, y = r.integers(0, 30, (2, 5))
            edges += zip(x.tolist(), y.tolist())
            low, left = embeddings._joined(x, y, low, cls)
            held += zip(*left.tolist()) if len(left) else []
        held += zip(cls.tolist(), low.tolist())
        assert roots(30, held) == roots(30, edges)


def test_small_and_large_buckets_give_the_same_pairs(monkeypatch):
    sizes = [1, 3, 70, 2, 5]
    rows = pa.table({"i": [0] * 81, "j": [0] * 70 + [0] * 11, "side": [0] * 81})
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    want = {(a, b) for k, n in enumerate(sizes) for a, b in itertools.combinations(range(cuts[k], cuts[k] + n), 2)}
    for small in (0, 4, 64, 100):
        monkeypatch.setattr(embeddings, "SMALL", small)
        got = [(int(a), int(b)) for x, y in embeddings._pairs(rows, cuts) for a, b in zip(x, y)]
        assert len(got) == len(set(got)) and set(got) == want


def test_embeddings_of_a_repeated_id(spark):
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (9, [0.0, 1.0, 0.1]), (7, [1.0, 0.1, 0.0]), (7, [1.0, 0.1, 0.0])]
    got = sorted((v.vec_id, v.n_links, v.component_id) for v in embeddings.near_duplicates(vectors(spark, rows)).collect())
    assert got == [(5, 1, 5), (5, 2, 5), (7, 2, 5), (7, 2, 5), (9, 1, 5)]


def test_cutting_leaves_other_texts_of_a_repeated_id(docs_of):
    r = random.Random(12)
    shared = " ".join(words(r, 80))
    tail = " ".join(words(r, 30))
    rows = [(1, shared, "s"), (2, f"{shared} {tail}", "s"), (2, f"{shared} {tail}", "s"), (2, None, "s"), (2, "short one", "s"), (2, "", "s"), (None, shared, "s")]
    got = passages.cut_repeats(docs_of(rows))
    assert sorted(((g.doc_id or 0, g.text) for g in got.collect()), key=repr) == sorted([(1, shared), (2, tail), (2, tail), (2, None), (2, "short one"), (2, ""), (0, shared)], key=repr)


def test_sets_of_a_family_that_are_not_similar_enough_are_ruled_out():
    """Copies of one text, edited so much that most of their pairs have a similarity of about 0.65."""
    r = np.random.default_rng(6)
    base = r.integers(0, 2**63, 146).astype(np.uint64)
    sets = []
    for _ in range(200):
        own = base.copy()
        own[r.permutation(146)[:17]] = r.integers(0, 2**63, 17).astype(np.uint64)
        sets.append(np.unique(own))
    tree = ngram_join.Tree(np.arange(200), np.array([len(s) for s in sets]), np.arange(200), *ngram_join._unfolded([ngram_join._bitmap(s) for s in sets]))
    pairs = {tuple(sorted(p)) for x, y in ngram_join.dual_traversal(tree, tree, 75) for p in zip(x.tolist(), y.tolist(), strict=True)}
    similar = {(a, b) for a, b in itertools.combinations(range(200), 2) if 175 * len(np.intersect1d(sets[a], sets[b])) >= 75 * (len(sets[a]) + len(sets[b]))}
    assert similar <= pairs and len(pairs) < 0.1 * 200 * 199 / 2


def test_shingles_of_words_in_another_order_differ(docs_of):
    texts = ["a b b a c", "b a a b c", "xa yb zb wa v", "xb ya za wb v"]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs_of(texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3}


def test_passages_leave_only_tables_that_their_rows_read(spark, docs_of):
    from pathlib import Path

    from surveykit.session import shared_dir

    r = random.Random(13)
    shared = words(r, 80)
    docs = docs_of([" ".join([*words(r, 60), *shared, *words(r, 60)]) for _ in range(6)])
    there = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file:")).glob("cut-*")}
    before = there()
    found = passages.repeated_passages(docs)
    assert len(there() - before) <= 3 and not [t for t in spark.catalog.listTables() if t.name.startswith("cut_")]
    assert {(f.doc_id, f.n_words) for f in found.collect()} >= {(k, 80) for k in range(1, 6)}


def test_windows_explained_by_spans_equal_definition():
    r = np.random.default_rng(2)
    for _ in range(200):
        first = r.integers(0, 60, 8)
        last = first + 5 + r.integers(0, 30, 8)
        s = r.integers(0, 80, 3)
        e = s + r.integers(0, 25, 3)
        free = [not ((s <= k) & (e >= k)).any() for k in range(120)]
        want = [any(all(free[k : k + 6]) for k in range(f, l - 4)) for f, l in zip(first.tolist(), last.tolist(), strict=True)]
        assert passages._unexplained(first, last, s, e, 6).tolist() == want
        assert passages._outside(first, last, s, e).tolist() == [not any(a <= f and b >= l for a, b in zip(s, e, strict=True)) for f, l in zip(first, last, strict=True)]


def test_family_of_edited_copies_is_found_without_all_its_pairs(docs_of):
    r = random.Random(17)
    base = words(r, 220, 10**6)
    texts = [" ".join(words(r, 1, 10**6)[0] if r.random() < 0.035 else w for w in base) for _ in range(60)]
    found = passages.repeated_passages(docs_of(texts)).collect()
    assert {f.doc_id for f in found} >= set(range(10, 60))
    assert len({(f.doc_id, f.source_doc_id) for f in found}) <= 8 * len(texts)


def test_margins_never_rule_out_a_passage():
    r = np.random.default_rng(4)
    least, percent = 20, 75
    for trial in range(300):
        base = r.integers(0, 1 << 63, 60).astype(np.uint64) * np.uint64(2)
        a, b = (np.where(r.random(60) < 0.002 * (trial % 60), r.integers(0, 1 << 63, 60).astype(np.uint64), base) for _ in range(2))
        b = b[r.integers(0, 8) : 60 - r.integers(0, 8)]
        wide, held = passages.side_by_side([passages.sketch(b)])
        margin = passages.margins(passages.sketch(a), wide, held, least, percent)[0]
        if any(True for _ in passages.matching_passages(a, b, least, percent)):
            assert margin >= 0
        taken = passages.sketch(a) | np.where(np.arange(60) % least == 0, passages.TAKEN, 0).astype(np.uint16)
        assert passages.margins(taken, wide, held, least, percent)[0] < 0
    assert passages.margins(passages.sketch(base), *passages.side_by_side([passages.sketch(~base)]), least, percent)[0] < 0


def test_passage_between_loose_ends_is_found():
    """44 of 54 shingles of the middle are shared, but neither the whole run nor its parts at the first gap are similar."""
    r = np.random.default_rng(9)
    new = lambda n: r.integers(0, 1 << 63, n).astype(np.uint64)
    blocks = [new(k) for k in (3, 26, 18, 4)]
    a, b = (np.concatenate([x for k in blocks for x in (k, new(5))]) for _ in range(2))
    found = list(passages.matching_passages(a, b, 46, 75))
    assert found == [(8, 56, 8, 56)]
    assert list(passages.matching_passages(a, b, 50, 75)) == []


def test_best_spans_equal_definition():
    r = np.random.default_rng(5)
    for _ in range(300):
        sizes = r.integers(0, 14, 5)
        begins = np.concatenate([[0], np.cumsum(sizes)])
        gain, cost, free = r.choice([25, 0, -75], begins[-1], p=[0.7, 0.1, 0.2]), r.choice([0, 75, passages.NEVER], begins[-1], p=[0.8, 0.15, 0.05]), r.random(begins[-1]) < 0.8
        got = passages.best_spans(gain, cost, free, begins, 4)
        for k, (x, y) in enumerate(itertools.pairwise(begins.tolist())):
            sums = [gain[s : e + 1].sum() - cost[s + 1 : e + 1].sum() for s in range(x, y) for e in range(s, y) if gain[s] > 0 and gain[e] > 0 and any(free[i : i + 4].all() for i in range(s, e - 2))]
            assert max(got[k], -1) == max([-1, *sums])


def test_partners_of_a_family_are_one_for_each_part():
    """Windows of edited copies: one partner for each part that has some, however many copies hold it, and none is missed."""
    r = random.Random(31)
    base, least = words(r, 100, 10**6), 46
    sketches, values = [], []
    for k in range(150):
        text = " ".join(edited(r, base, r.choice((1, 2, 3, 6)) if k else 0))
        own = passages.shingles(text, 5)
        values.append(own)
        sketches.append(passages.sketch(own) | passages.joints(passages.word_hashes(text), len(own)))
    docs = np.arange(150)
    met = list(passages.partners(docs, docs > 0, *passages.side_by_side(sketches), np.array([0, 150]), least, 75))
    spans = {}
    for k, x in met:
        assert x < k
        spans.setdefault(k, []).extend((s, e) for s, e, _, _ in passages.matching_passages(values[k], values[x], least, 75))
    assert len(met) < 1.5 * 150
    for k in range(1, 150):
        free = np.ones(96, bool)
        for s, e in spans.get(k, ()):
            free[s : e + 1] = False
        left = [(s, e) for x in range(k) for s, e, _, _ in passages.matching_passages(values[k], values[x], least, 75) if passages._longest(free[s : e + 1]) >= least]
        assert not left


def test_joints_are_never_more_than_the_others_between():
    """Words of a text are replaced by others, or by words of the text: shingles of a partner between those around it."""
    r = random.Random(6)
    for trial in range(400):
        text = [f"w{r.randrange(6 if trial % 2 else 40)}" for _ in range(40)]
        at, cut = r.randrange(8, 30), r.randrange(0, 4)
        other = [*text[:at], *[f"w{r.randrange(6)}" for _ in range(r.randrange(0, 4))], *text[at + cut :]]
        a, b = (passages.shingles(" ".join(t), 5) for t in (text, other))
        if len(np.unique(a)) < len(a) or len(np.unique(b)) < len(b):
            continue
        codes = passages.joints(passages.word_hashes(" ".join(text)), len(a))
        where = {v: k for k, v in enumerate(b.tolist())}
        shared = [k for k, v in enumerate(a.tolist()) if v in where]
        for i, j in itertools.pairwise(shared):
            if 1 < j - i <= passages.GAP and 0 < where[a.tolist()[j]] - where[a.tolist()[i]]:
                assert passages.BETWEEN[codes[j] >> passages.JOINT & 3] <= where[a.tolist()[j]] - where[a.tolist()[i]] - 1


def test_family_of_edited_copies_has_few_sources(docs_of):
    r = random.Random(17)
    base = words(r, 220, 10**6)
    texts = [" ".join(words(r, 1, 10**6)[0] if r.random() < 0.035 else w for w in base) for _ in range(120)]
    found = passages.repeated_passages(docs_of(texts)).collect()
    sets = [passages.shingles(t, 5) for t in texts]
    assert {f.doc_id for f in found} == {k for k in range(120) if any(True for x in range(k) for _ in passages.matching_passages(sets[k], sets[x], 46, 75))}
    assert len({(f.doc_id, f.source_doc_id) for f in found}) <= 4 * len(texts)
