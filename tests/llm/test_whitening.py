from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest

from ledgerloom.llm.whitening import _Roots, exact_products, null_vectors, polynomial_modulo, whiten
from tests.llm import brute

FOLDER = "/root/testdata/sf0.1"
SHAPE = "vec_id long, embedding array<float>"


def plain(vectors, components=32):
    """n, deviations, eigenvalues, whitened rows; the last by floating-point eigenvectors."""
    whole = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(whole), whole.sum(0)
    deviations = [sum((n * int(x) - int(s)) ** 2 for x, s in zip(row, sums)) for row in whole]
    centred = whole - sums / n
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    values, columns = values[::-1], columns[:, ::-1]
    keep = [at for at in range(min(components, len(values))) if values[at] > 1e-9]
    return n, deviations, values[keep], values.clip(0).sum(), centred @ columns[:, keep] / np.sqrt(values[keep])


def by_vector(df):
    rows = {}
    for row in sorted(df.collect(), key=lambda row: (row["vec_id"], row["component"])):
        rows.setdefault(row["vec_id"], []).append(row)
    return rows


def check(df, vectors):
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    n, deviations, values, total, whitened = plain(list(vectors.values()))
    found = by_vector(df)
    assert list(found) == sorted(vectors)
    assert all([row["component"] for row in own] == list(range(1, len(values) + 1)) for own in found.values())
    by_id = dict(zip(vectors, range(len(vectors))))
    got = np.array([[row["whitened"] for row in found[key]] for key in vectors])
    signs = np.sign((got * whitened).sum(0))
    assert np.abs(got * signs - whitened).max() < 1e-6
    for key, own in found.items():
        assert {(row["n"], row["deviation"]) for row in own} == {(n, deviations[by_id[key]])}
        assert np.allclose([row["explained"] for row in own], values / total, rtol=1e-9)
        assert all(row["identity_error"] < 1e-9 for row in own)


def test_whole_table(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding")
    check(whiten(brute.with_clashing(df)), {row["vec_id"]: row["embedding"] for row in df.collect()})


def test_odd_vectors(spark):
    bad = [(100, None), (200, []), (400, [1.0, None, 0.0]), (500, [float("nan"), 1.0, 1.0]), (600, [float("inf"), 1.0, 2.0]), (700, [1.0, 2.0])]
    draw = np.random.default_rng(1)
    good = {number: [float(np.float32(x)) for x in draw.normal(size=3) * (1, 5, 0.2)] for number in range(50)}
    good |= {60: [0.0, 0.0, 0.0], 61: good[3], 62: good[3]}
    check(whiten(brute.with_clashing(spark.createDataFrame(bad + list(good.items()), SHAPE))), good)
    assert whiten(spark.createDataFrame(bad[:5], SHAPE)).collect() == []
    assert whiten(spark.createDataFrame([], SHAPE)).collect() == []
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, SHAPE)).collect() == []
    ids = whiten(spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [4.0, 2.0])], SHAPE)).collect()
    assert sorted((row["vec_id"] or 0, row["component"], row["n"], row["deviation"]) for row in ids) == [(0, 1, 3, 36864)] * 2 + [(3, 1, 3, 147456)]


def test_huge_entries(spark):
    rows = [(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [5.0, 1.0])]
    found = whiten(spark.createDataFrame(rows, SHAPE)).collect()
    assert len(found) == 6 and all(row["identity_error"] < 1e-4 for row in found)


def test_repeated_eigenvalues_and_missing_directions(spark):
    # Four corners in two planes: eigenvalues 2048 twice, 512 twice, and two directions without variance.
    rows = []
    for a, b in ((1, 1), (1, -1), (-1, 1), (-1, -1)):
        rows += [[a, b, 0, 0, 0, 3], [0, 0, a / 2, b / 2, 0, 3]]
    found = by_vector(whiten(spark.createDataFrame([(key, [float(x) for x in row]) for key, row in enumerate(rows)], SHAPE)))
    assert all(len(own) == 4 for own in found.values())
    assert np.allclose([row["explained"] for row in found[0]], [0.4, 0.4, 0.1, 0.1])
    got = np.array([[row["whitened"] for row in own] for own in found.values()])
    assert np.allclose(got.T @ got / 8, np.eye(4)) and found[0][0]["identity_error"] < 1e-12


@pytest.mark.parametrize("most", [3, 2**19, 2**40, 2**52])
def test_products_are_exact(most):
    whole = np.random.default_rng(2).integers(-most, most + 1, (9000, 3))
    wanted = whole.astype(object).T @ whole.astype(object)
    assert (exact_products(whole) == wanted).all()


def test_polynomials_and_roots():
    roots = [0, 0, 1, 4, 4, 9, 1000, 10**12]
    coefficients = [1]
    for root in roots:
        coefficients = [a - root * b for a, b in zip([0, *coefficients], [*coefficients, 0])]
    assert [coefficients[-1], coefficients[-2]] == [1, -sum(roots)]
    found = _Roots(coefficients).largest(8)
    assert [times for _, times in found] == [1, 1, 1, 2, 1]
    assert [round(value) for value, _ in found] == [10**12, 1000, 9, 4, 1]
    assert all(abs(value / round(value) - 1) < Fraction(1, 2**150) for value, _ in found)
    prime = 2**31 - 1
    draw = np.random.default_rng(5)
    for matrix in (np.diag(roots).astype(object), np.zeros((4, 4), object)):
        wanted = coefficients if matrix.any() else [0, 0, 0, 0, 1]
        assert polynomial_modulo(matrix, prime).tolist() == [value % prime for value in wanted]
    mixed = draw.integers(-5, 6, (6, 6)).astype(object)
    mixed = mixed @ mixed.T
    got = polynomial_modulo(mixed, prime).tolist()
    assert got == [round(value) % prime for value in np.poly(mixed.astype(float))[::-1]]


def test_null_vectors_of_a_space():
    matrix = np.diag([5, 5, 5, 2]).astype(object)
    vectors = null_vectors(matrix, Fraction(5), 3)
    assert np.allclose(vectors @ vectors.T, np.eye(3), atol=1e-15) and np.abs(vectors[:, 3]).max() < 1e-15
