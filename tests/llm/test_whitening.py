"""Operator 11 against exact integers and a covariance formed by brute force."""

from fractions import Fraction

import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from itemforge.llm import registry, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, k=4):
    """n, deviation of each row, its absolute whitened values, shares; rows: (id, vector)."""
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dims = max(len(x) for _, x in kept)
    kept = [(i, x + [0] * (dims - len(x))) for i, x in kept]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    far = [sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for _, x in kept]
    centred = lambda xs: np.array([[float(c - Fraction(s, n)) for c, s in zip(x, sums, strict=True)] for x in xs])
    c = centred(fit)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, dims)
    live = values[:k] > values[0] * 1e-12
    white = np.abs(centred([x for _, x in kept]) @ vectors[:, :k]) / np.sqrt(np.where(live, values[:k], np.nan))
    return n, [i for i, _ in kept], far, white, np.where(live, values[:k], 0) / max(values.sum(), 1e-300)


def check(got, rows):
    n, ids, far, white, share = expected(rows)
    k = len(share)
    assert sorted(repr(r.vec_id) for r in got) == sorted(repr(i) for i in ids for _ in range(k))
    want = sorted((repr(i), d, c + 1, tuple(w)) for i, d, w in zip(ids, far, white, strict=True) for c in range(k))
    mine = sorted(((repr(r.vec_id), r.deviation, r.component, r) for r in got), key=lambda x: x[:3])
    assert [x[:3] for x in mine] == [x[:3] for x in want]
    for (*_, r), (*_, w) in zip(mine, want, strict=True):
        assert r.n == n
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9, abs=1e-15)
        w = w[r.component - 1]
        assert r.whitened is None if np.isnan(w) else abs(r.whitened) == pytest.approx(w, rel=1e-6, abs=1e-9)


def test_whole_table(spark):
    got = registry.queries()["op11_whitening"](spark, oracle.DATA).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{oracle.DATA}/embeddings.parquet").collect()]
    check(got, rows)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    # one direction for all rows: the whitened values of distinct vectors have no covariance
    w = np.array([[r.whitened for r in sorted(got, key=lambda r: (r.vec_id, r.component)) if r.component == c] for c in range(1, 5)])
    assert np.allclose(np.cov(w, bias=True), np.eye(4), atol=1e-6)


NAN, INF = float("nan"), float("inf")
CASES = {
    "dropped rows": [(1, None), (2, [1.0, None]), (3, [NAN, 1.0]), (4, [INF, 1.0]), (5, [-INF, 0.0]), (6, [1.0, 2.0]), (7, [2.0, 1.0]), (8, [-0.0, 0.001]), (9, [-0.001, 5.0])],
    "copies do not count": [(i, [1.0, 2.0, 3.0]) for i in range(40)] + [(None, [3.0, 1.0, 2.0]), (None, [0.0, 1.0, 7.0]), (50, [0.5, 0.25, 1.0]), (51, [9.0, 0.25, 1.0])],
    "far mean": [(i, [30000.0 + i % 7, 60000.0 + i % 5, i % 3 - 30000.0]) for i in range(60)],
    "short vectors": [(1, []), (2, [1.0]), (3, [1.0, 2.0]), (4, [2.0, 0.5, 4.0]), (5, [0.0, 3.0])],
    "one vector": [(1, [1.0, 2.0]), (2, [1.0, 2.0])],
    "no variance in a direction": [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)],
}


@pytest.mark.parametrize("name", CASES)
def test_brute(spark, name):
    rows = CASES[name]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5).withColumns({c: F.lit(0) for c in ("x", "n", "id", "component")})
    check(whitening.whiten(df).collect(), rows)


def test_merging_in_a_tree(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (1, 2, 3, 4, 5, 6)]) for i in range(400)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    fit = whitening.whole(df, "vec_id", "embedding").select("x").repartition(37)
    mid = whitening.centre(fit, 6)
    r = whitening.triangle(fit, mid)
    x = np.array([list(row.x) for row in fit.collect()], float)
    c = x - x.mean(axis=0)
    assert np.allclose(r.T @ r, c.T @ c)


def test_empty_and_beyond_a_long(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 0), (2, [], 0)], SCHEMA)).count() == 0
    got = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0], 0), (2, [-1e30, 1.0], 0), (3, [1.0, 2.0], 0)], SCHEMA)).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got if r.vec_id < 3)
