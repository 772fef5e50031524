"""Whitening against numpy's eigenvectors and plain sums; small eigenvalues, ties, and vectors that take no part."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from lattico.llm import whitening
from lattico.llm.common import table
from tests.conftest import DATA


def plain(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    return x, n, s, ((n * x - s) ** 2).sum(axis=1)


def test_query_against_numpy(spark):
    rows = table(spark, f"{DATA}/sf0.001", "embeddings").collect()
    x, n, s, deviation = plain([r["embedding"] for r in rows])
    c = (x - 1_000_000) - (s - 1_000_000 * n) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    want = c @ vectors / np.sqrt(values)
    got = whitening.op11_whitening(spark, f"{DATA}/sf0.001").toPandas()
    assert got.dtypes.astype(str).to_dict() == {"vec_id": "int64", "component": "int32", "n": "int64", "deviation": "int64", "whitened": "float64", "explained": "float64", "identity_error": "float64"}
    ids = [r["vec_id"] for r in rows]
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert wide.shape == want.shape and np.abs(wide * np.sign((wide * want).sum(axis=0)) - want).max() < 1e-9
    assert got.groupby("vec_id")["deviation"].first().loc[ids].tolist() == deviation.tolist() and set(got["n"]) == {n}
    explained = got.groupby("component")["explained"].first().to_numpy()
    assert np.abs(explained / (values / np.trace(c.T @ c / n)) - 1).max() < 1e-9
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9


@pytest.mark.parametrize("d", [1, 2, 3, 8, 17, 40])
def test_rounds_meet_each_pair_once(d):
    met = [(int(p), int(q)) for ps, qs in whitening.rounds(d) for p, q in zip(ps, qs, strict=True)]
    assert sorted(met) == [(i, j) for i in range(d) for j in range(i + 1, d)]
    assert all(len({*ps, *qs}) == 2 * len(ps) for ps, qs in whitening.rounds(d))


@pytest.mark.parametrize("d", [1, 2, 5, 30, 64])
def test_jacobi_on_random_matrices(d):
    rng = np.random.default_rng(d)
    b = rng.normal(size=(d, d))
    a = b @ b.T
    values, vectors = whitening.jacobi(a)
    assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-13) and np.allclose(vectors * values @ vectors.T, a, atol=1e-11 * np.trace(a))
    assert (np.diff(values) <= 0).all()


def test_jacobi_keeps_small_eigenvalues_accurate():
    """A graded matrix: its least eigenvalues lie far under the rounding of its largest entry."""
    d = 6
    core = np.eye(d) + 0.3 * (np.ones((d, d)) - np.eye(d))
    scale = np.array([10.0 ** (-3 * i) for i in range(d)])
    a = core * scale[:, None] * scale[None, :]
    # determinant of the graded matrix, exactly; the product of the eigenvalues must be it
    exact = [[Fraction(float(x)) for x in row] for row in a]
    det = Fraction(1)
    for i in range(d):
        det *= exact[i][i]
        for r in range(i + 1, d):
            f = exact[r][i] / exact[i][i]
            exact[r] = [x - f * y for x, y in zip(exact[r], exact[i], strict=True)]
    values, _ = whitening.jacobi(a)
    assert (values > 0).all() and abs(math.fsum(np.log(values)) - math.log(det)) < 1e-11


def test_scatter_is_exact_at_any_size():
    rng = random.Random(1)
    for far in (10, 10**6, 2**45):
        rows = [[rng.randrange(-far, far) for _ in range(4)] for _ in range(50)]
        got = whitening.scatter_of(np.array(rows, np.int64), np.array([1, -2, 3, far // 2]))
        ys = [[v - c for v, c in zip(r, (1, -2, 3, far // 2), strict=True)] for r in rows]
        assert got.tolist() == [[sum(y[i] * y[j] for y in ys) for j in range(4)] for i in range(4)]


def test_who_takes_part(spark):
    rng = random.Random(2)
    good = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in range(20)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [1.0, float("inf"), 2.0]), (105, [1.0, 2.0]), (106, [1e300, 0.0, 0.0])]
    rows = good + odd + [good[0], (None, good[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = whitening.whiten(df).collect()
    fit = [v for _, v in good] + [good[0][1], good[1][1]]
    x, n, s, deviation = plain(fit)
    assert len(got) == 3 * n and {r["n"] for r in got} == {n} and {r["component"] for r in got} == {1, 2, 3}
    assert sorted(int(r["deviation"]) for r in got if r["component"] == 1) == sorted(deviation.tolist())
    assert math.isclose(sum(r["explained"] for r in got if r["vec_id"] == 5), 1.0, rel_tol=1e-12) and max(r["identity_error"] for r in got) < 1e-9
    assert {(r["component"], r["whitened"]) for r in got if r["vec_id"] == 0} and len({(r["component"], r["whitened"]) for r in got if r["vec_id"] == 0}) == 3  # repeated rows agree


def test_far_entries_are_exact(spark):
    rows = [(i, [float((-1) ** i * i * 2**40), float(i), 1.0]) for i in range(6)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    xs = [[64 * int(v) + 1_000_000 for v in r] for _, r in rows]
    s = [sum(c) for c in zip(*xs, strict=True)]
    assert {k: int(v) for k, v in got.items()} == {i: sum((6 * a - b) ** 2 for a, b in zip(x, s, strict=True)) for i, x in enumerate(xs)}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    """Empty tables, a single vector and equal vectors have no component with a variance."""
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as n", "2 as Component", "3 as other")
    out = whitening.whiten(df)
    assert out.columns == ["vec_id", "other", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.collect() == []


def test_constant_dimension_and_fewer_vectors_than_dimensions(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(9)] + [0.5]) for i in range(5)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert set(got["component"]) == {1, 2, 3, 4} and got["identity_error"].max() < 1e-9 and math.isclose(got.groupby("component")["explained"].first().sum(), 1.0)


def test_too_long_vectors_are_refused(spark):
    df = spark.range(2).selectExpr("id as vec_id", f"transform(sequence(1, {whitening.MOST_DIMENSIONS + 1}), x -> double(x * id)) as embedding")
    with pytest.raises(ValueError, match="are the most"):
        whitening.whiten(df)
