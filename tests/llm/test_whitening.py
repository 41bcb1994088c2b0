"""Whitening beside numpy's own eigensolver and exact whole numbers."""

import math

import numpy as np
import pytest

from surveykit.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, x string, component int, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], SCHEMA)


def test_leading_components():
    r = np.random.default_rng(1)
    for d in (1, 2, 3, 16, 90):
        x = r.standard_normal((300, d)) * np.arange(1, d + 1) ** -0.5
        flat = np.where(np.arange(d) < d // 2, x, 0)
        twice = np.linalg.qr(r.standard_normal((d, d)))[0] if d > 1 else np.eye(1)
        pairs = twice @ np.diag(np.repeat(np.arange(d, 0, -1), 2)[:d]) @ twice.T
        for a in (x.T @ x, flat.T @ flat, np.eye(d) * 3, np.zeros((d, d)), pairs, np.diag(np.arange(d) % 3.0)):
            values, vectors = whitening.leading_components(a, 16)
            size = max(np.abs(a).max(), 1e-300)
            assert np.allclose(values / size, np.linalg.eigvalsh(a)[::-1][:16] / size, rtol=0, atol=1e-13 * d)
            assert np.allclose(vectors.T @ vectors, np.eye(len(values)), rtol=0, atol=1e-12)
            assert np.allclose(a @ vectors / size, vectors * values / size, rtol=0, atol=1e-12 * d)


def test_sturm_count():
    diagonal, off = np.array([2.0, 0.0, 2.0, -1.0]), np.array([1.0, 0.0, 1e-3])
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    at = np.array([-9.0, -0.5, 0.0, 1.0, 2.3, 9.0])
    assert whitening.sturm_count(diagonal, off, at).tolist() == [(values < x).sum() for x in at]


def want(rows, k=16):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good]
    fit = np.array(sorted({tuple(x) for x in xs}), np.float64)
    n, total = len(fit), [sum(c) for c in zip(*sorted({tuple(x) for x in xs}), strict=True)]
    mean = fit.mean(axis=0)
    a = (fit - mean).T @ (fit - mean) / n
    values, vectors = np.linalg.eigh(a)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    keep = values > 1e-10 * max(values[0], 0)
    out = []
    for (i, _), x in zip(good, xs, strict=True):
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, total, strict=True))
        out += [(i, j + 1, n, deviation, abs((np.array(x) - mean) @ vectors[:, j]) / math.sqrt(values[j]), values[j] / np.trace(a)) for j in range(len(values)) if keep[j]]
    return out


def key(r):
    return r[0] is not None, r[0] or 0, r[3], r[1]


def same(got, rows, k=16):
    got = sorted(((g.vec_id, g.component, g.n, g.deviation, abs(g.whitened), g.explained, g.identity_error) for g in got), key=key)
    expected = sorted(want(rows, k), key=key)
    assert [g[:4] for g in got] == [e[:4] for e in expected]
    assert np.allclose([g[4:6] for g in got], [e[4:6] for e in expected], rtol=1e-6, atol=1e-7)
    assert all(g[6] <= 1e-9 for g in got) and len({g[6] for g in got}) <= 1


def test_whiten_equals_numpy(spark):
    r = np.random.default_rng(4)
    rows = [(k, v.tolist()) for k, v in enumerate((r.standard_normal((400, 20)) * np.arange(1, 21)) / 5 + 2)]
    rows += [(900, rows[3][1]), (900, rows[4][1]), (None, rows[5][1])] + [(k, rows[7][1]) for k in range(1000, 1200)]
    rows += [(901, None), (902, [None] + [0.0] * 19), (903, [float("nan")] * 20), (904, [float("inf")] * 20)]
    out = whitening.whiten(frame(spark, rows).repartition(4))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same(out.collect(), rows)
    got = {g.component: g.whitened for g in out.where("vec_id = 3").collect()}
    assert got == {g.component: g.whitened for g in whitening.whiten(frame(spark, rows).repartition(4)).where("vec_id = 3").collect()}
    same(whitening.whiten(frame(spark, rows), components=3).collect(), rows, 3)


def test_whiten_edges(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, []), (2, None), (3, [2.0, 3.0]), (4, [2.0, 3.0])])).count() == 0
    line = [(k, [float(k), 2.0 * k, 1.0]) for k in range(5)]
    out = whitening.whiten(frame(spark, line)).collect()
    assert {g.component for g in out} == {1}
    same(out, line)
    mixed = line + [(k + 50, [float(k * k), float(k)]) for k in range(6)]
    got = whitening.whiten(frame(spark, mixed)).collect()
    same([g for g in got if g.vec_id < 50], line)
    same([g for g in got if g.vec_id >= 50], mixed[5:])
    far = [(k, [4e4 * k, -3.0 * k * k]) for k in range(40)]
    same(whitening.whiten(frame(spark, far)).collect(), far)
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(frame(spark, [(k, [1e9 * k]) for k in range(40)])).collect()
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(frame(spark, [(1, [1e30, 0.0]), (2, [1.0, 0.0])])).collect()
