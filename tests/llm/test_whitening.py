"""Components and whitened coordinates against numpy's own solver and whole-number sums."""

import math
import random

import duckdb
import numpy as np
import pytest

from tessera import llm
from tessera.llm import whitening
from tests.conftest import SMALL

llm.load_all()


@pytest.mark.parametrize("kind", ["random", "clusters", "steep", "rank", "same", "diagonal"])
def test_components_are_eigenvectors(kind):
    rng = np.random.default_rng(7)
    n = 40
    basis = np.linalg.qr(rng.standard_normal((n, n)))[0]
    values = {"random": rng.random(n), "clusters": np.repeat([5.0, 5.0 + 1e-9, 1.0, 0.5], 10), "steep": 10.0 ** -np.arange(n),
              "rank": np.r_[3.0, 2.0, 1.0, np.zeros(n - 3)], "same": np.full(n, 2.0), "diagonal": np.arange(n) + 1.0}[kind]
    a = np.diag(values) if kind == "diagonal" else (basis * values) @ basis.T
    got, vectors = whitening.principal_components(a, 8)
    scale = values.max()
    assert np.abs(got - np.sort(values)[::-1][:8]).max() < 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-13
    assert np.abs(a @ vectors - vectors * got).max() < 1e-12 * scale


def brute(rows, dimension):
    good = [(i, v) for i, v in rows if v and len(v) == dimension and all(c is not None and math.isfinite(c) for c in v)]
    xs = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in good]
    n, sums = len(xs), [sum(col) for col in zip(*xs)]
    y = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in xs])
    return [i for i, _ in good], n, [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in xs], y


def check(got, rows, dimension, k):
    ids, n, deviation, y = brute(rows, dimension)
    spread = y.T @ y / n
    values, vectors = np.linalg.eigh(spread)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    assert len(got) == n * k
    for j in range(k):
        one = sorted((r for r in got if r.component == j + 1), key=lambda r: r.vec_id)
        order = np.argsort(ids, kind="stable")
        mine, want = np.array([r.whitened for r in one]), (y @ vectors[:, j] / math.sqrt(values[j]))[order]
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-8
        assert [int(r.deviation) for r in one] == [deviation[i] for i in order]
        assert all(abs(r.explained - values[j] / np.trace(spread)) < 1e-10 and r.n == n and r.identity_error < 1e-8 for r in one)


def test_the_given_vectors(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SMALL}/embeddings.parquet'").fetchall()
    check(llm.QUERIES["op11_whitening"](spark, SMALL).collect(), rows, len(rows[0][1]), 8)


def test_odd_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(3, 1 + d) for d in range(5)]) for i in range(60)]
    rows += [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [math.nan] * 5), (104, [math.inf, 0.0, 0.0, 0.0, 0.0]),
             (105, [1.0]), (106, [0.0, -0.0, 1e-30, -1e-30, 50.0]), (107, [1e300] * 5)]
    shape = "vec_id long, embedding array<double>, n string, at int, whitened int, i int, explained int"
    given = spark.createDataFrame([(*r, "own", 1, 2, 3, 4) for r in rows], shape)
    check(whitening.whiten(given, k=5).collect(), rows[:-1], 5, 5)
    assert whitening.whiten(given.limit(0)).count() == 0 and whitening.whiten(given.where("vec_id IN (100, 101, 103)")).count() == 0
    flat = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 5.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(flat).collect()
    assert len(got) == 6 and all((r.whitened is None) == (r.component == 2) and r.explained == 2 - r.component for r in got)
    still = whitening.whiten(flat.limit(2)).collect()
    assert len(still) == 4 and all(r.whitened is None and r.identity_error is None and int(r.deviation) == 0 for r in still)


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(2**50 + 1000 * i), 1.0 / (i + 1)]) for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).collect()
    _, _, deviation, _ = brute(rows, 2)
    assert {int(r.deviation) for r in got} == set(deviation)
