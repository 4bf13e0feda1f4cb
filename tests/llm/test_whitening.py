from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from tallyframe.llm import whitening
from tallyframe.llm.whitening import above, isolated, leading, op12_whitening, pivots, whitened
from tests.conftest import SF001


def symmetric(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.array(values, float)) @ q.T


@pytest.mark.parametrize("seed", range(6))
def test_inertia_counts_eigenvalues(seed):
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((17, 17))
    a += a.T
    values = np.linalg.eigvalsh(a)
    for shift in [*(values[:-1] + values[1:]) / 2, values[0] - 1, values[-1] + 1]:
        assert above(a, shift) == (values > shift).sum()
    assert pivots(np.array([[0.0, 1.0], [1.0, 0.0]])) == (1, 0) and pivots(np.zeros((3, 3))) == (0, 3)


def test_intervals_hold_one_eigenvalue():
    a = symmetric([9, 8.999999, 5, 1, 0, 0], 1)
    for number, value in enumerate([9, 8.999999, 5], 1):
        low, high = isolated(a, number, -20, 20, 1e-12)
        assert low < value <= high and above(a, low) == number and above(a, high) == number - 1


@pytest.mark.parametrize(
    "values", [[9, 8, 7, 6, 5], [100, 99.9999999, 1, 0.5, 0.1], [3, 3, 3, 1, 0], [1, 0, 0, 0, 0], [1e12, 1, 1e-3, 0, 0], [2] * 5]
)
def test_components_equal_a_dense_solver(values):
    a = symmetric(values, 4)
    got, vectors = leading(a, 4)
    scale = max(values)
    np.testing.assert_allclose(got, sorted(values, reverse=True)[:4], atol=1e-13 * scale)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(4), atol=1e-12)
    np.testing.assert_allclose(a @ vectors, vectors * got, atol=1e-13 * scale)
    dense, exact = np.linalg.eigh((a + a.T) / 2)
    for k, value in enumerate(got):
        if np.sum(np.abs(dense - value) < 1e-6 * scale) == 1:
            assert abs(abs(vectors[:, k] @ exact[:, np.abs(dense - value).argmin()]) - 1) < 1e-12
    assert leading(np.zeros((2, 2)), 4)[0].tolist() == [0, 0] and leading(np.array([[3.0]]), 4)[1].tolist() == [[1.0]]


def brute_force(rows):
    """(id, component) -> values, in exact fractions up to the eigenvectors."""
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    centred = np.array([[float(Fraction(n * x[k] - sums[k], n)) for k in range(d)] for x in fit])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    out = {}
    for i, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        w = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) @ vectors / np.sqrt(values)
        for k in range(len(values)):
            out.setdefault((i, k + 1), []).append((n, deviation, abs(w[k]), values[k] / np.trace(covariance)))
    return out


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF001}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = brute_force(rows)
    got = op12_whitening(spark, SF001).collect()
    assert len(got) == 4 * len(rows)
    for r in got:
        (n, deviation, w, explained), = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-9
        assert abs(abs(r.whitened) - w) < 1e-9 and abs(r.explained - explained) < 1e-12


def test_results_do_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{SF001}/embeddings.parquet").limit(200).cache()
    rows = [sorted(map(str, whitened(df.repartition(n)).drop("identity_error").collect())) for n in (1, 5)]
    assert rows[0] == rows[1]


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [0.5, 1.0, -0.25]), (1, [0.5, 1.0, -0.25]), (None, [0.1, -1.0, 2.0]), (2, None), (3, []), (4, [1.0, None, 0.0]),
        (5, [1.0, inf, 0.0]), (6, [nan, 1.0, 0.0]), (7, [-0.0, 0.0, 3.0]), (8, [1.0, 2.0]), (9, [1e300, 0.0, 0.0]), (10, [-2.0, 0.3, 0.7]),
    ]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, x int, component int")
    got = whitened(df).collect()
    want = brute_force([r for r in rows if r[0] in (1, None, 7, 10)])
    assert sorted(str(r.vec_id) for r in got) == sorted(["1", "1", "None", "7", "10"] * 3)
    for r in got:
        n, deviation, w, explained = want[r.vec_id, r.component][0]
        assert (r.n, r.deviation) == (4, deviation) and abs(abs(r.whitened) - w) < 1e-9 and abs(r.explained - explained) < 1e-12
    assert whitened(df.limit(0)).count() == 0 and whitened(df.filter("vec_id = 2")).columns == got[0].__fields__


def test_without_variance_and_large_entries(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert {tuple(r)[1:] for r in whitened(same).collect()} == {(k, 1, 0, None, 0.0, 0.0) for k in (1, 2)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<float>")
    got = {(r.vec_id, r.component): r for r in whitened(line).collect()}
    assert abs(abs(got[0, 1].whitened) - 2**0.5) < 1e-12 and got[0, 2].whitened is None and got[0, 1].identity_error < 1e-12
    big = spark.createDataFrame([(i, [2.0**40 * i, 1.0 * i * i]) for i in range(3)], "vec_id long, embedding array<double>")
    got = whitened(big).collect()
    assert {r.deviation for r in got if r.vec_id != 1} == {None} and {r.deviation for r in got if r.vec_id == 1} == {512**2}


@pytest.mark.parametrize("exact", [1 << 53, 1 << 14, 1])
def test_products_are_exact(monkeypatch, exact):
    monkeypatch.setattr(whitening, "EXACT", exact)
    x = np.random.default_rng(5).integers(-200, 200, (3000, 3))
    batch = pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.int64()))], names=["x"])
    out, = whitening.products_in(iter([batch]), np.array([1, -2, 3]))
    y = x - [1, -2, 3]
    assert [(r["i"], int(r["v"])) for r in out.to_pylist()] == [(3 * p + q, int((y[:, p] * y[:, q]).sum())) for p in range(3) for q in range(p, 3)]
