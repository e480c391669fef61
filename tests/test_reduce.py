"""Components of samples by products with vectors, for more samples than have a matrix of products."""

import numpy as np
import pytest

from seqloom.operators import reduce

from .test_statistics import rows
from .test_whole_jobs import against_sql


def exact(x):
    centred = x - x.mean(axis=1, keepdims=True)
    u, s, _ = np.linalg.svd(centred.T, full_matrices=False)
    return u * s, s


@pytest.mark.parametrize(("features", "samples"), [(200, 30), (5, 40), (1, 12), (60, 3)])
def test_products_give_the_components(spark, features, samples):
    x = np.random.default_rng(features).random((features, samples)) * (1 + np.arange(features))[:, None]
    found, (scores, s) = reduce.pca_by_products(rows(spark, x), "norm", samples, 2), exact(x)
    have = min(2, len(s))
    assert np.abs(found.scores[:, :have]) == pytest.approx(np.abs(scores[:, :have]), abs=1e-5 * s[0])
    assert found.variance[:have] == pytest.approx(s[:have] ** 2 / (samples - 1), rel=1e-8, abs=1e-8 * s[0] ** 2)
    assert found.ratio[0] == pytest.approx(s[0] ** 2 / (s**2).sum())
    assert (found.scores.max(axis=0) >= np.abs(found.scores.min(axis=0)) - 1e-9).all()


def test_both_ways_agree_and_the_wide_one_is_taken_beyond_its_bound(spark, monkeypatch):
    df = rows(spark, np.random.default_rng(5).random((80, 25)))
    narrow = reduce.pca(df, "norm", 25, 3)
    monkeypatch.setattr(reduce, "GRAM_SAMPLES", 24)
    monkeypatch.setattr(reduce, "gram", None)
    monkeypatch.setattr(reduce, "SLICE", 60)  # slices of two rows
    wide = reduce.pca(df, "norm", 25, 3)
    assert wide.scores == pytest.approx(narrow.scores, abs=1e-6) and wide.variance == pytest.approx(narrow.variance[:3])
    assert len(reduce.variance_table(spark, wide, 80).columns) == 4


@pytest.mark.parametrize("x", [np.zeros((0, 4)), np.ones((3, 4))])
def test_nothing_to_tell_apart(spark, x):
    df = spark.createDataFrame([(r.tolist(),) for r in x], "norm array<double>")
    found = reduce.pca_by_products(df, "norm", 4, 2)
    assert np.abs(found.scores).max() == 0 and (found.variance == 0).all()


def test_leading_values_of_a_large_matrix_hold_few_numbers():
    n = 20_000  # its products would be 3.2 GB
    rng = np.random.default_rng(1)
    factors = np.linalg.qr(rng.standard_normal((n, 30)))[0]
    sizes = np.concatenate([[900.0, 700.0, 650.0], np.linspace(100, 1, 27)])
    calls = []

    def product(v):
        calls.append(v.shape[1])
        return factors @ (sizes[:, None] * (factors.T @ v))

    size, vectors = reduce.leading(product, n, 3)
    assert size == pytest.approx(sizes[:3], rel=1e-9) and len(calls) < 12
    assert np.abs((vectors * factors[:, :3]).sum(axis=0)) == pytest.approx(np.ones(3))


@pytest.mark.parametrize("name", ["pca_scores", "pca_scores_krylov"])
def test_scores_equal_those_of_sql(spark, name):
    against_sql(spark, name)
