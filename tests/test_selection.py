"""Top lists in one pass, folds by what is left out, and pairs counted by merging, against plain forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import rowstats
from seqloom.operators import select


def values_frame(spark, seed, rows=400):
    r = random.Random(seed)
    listed = [(f"k{i:04d}", [i, i + 1], r.choice([math.nan, -3.0, 3.0, 0.0, None, r.gauss(0, 1), round(r.gauss(0, 1), 1)]), float(r.randrange(5))) for i in range(rows)]
    r.shuffle(listed)
    return spark.createDataFrame(listed, "kmer string, counts array<long>, a double, b double").repartition(5)


@pytest.mark.parametrize("n", [1, 7, 60, 1000])
def test_top_lists_are_the_single_lists(spark, n):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    df = values_frame(spark, n).withColumn("a", F.coalesce("a", F.lit(math.nan)))
    lists = {"big": ("a", False), "far": ("a", True), "b": ("b", False)}
    got = select.top_lists(df, lists, n).orderBy("list", "rank").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name, (column, absolute) in lists.items():
        want = select.top(df, column, n, absolute).collect()
        own = [r for r in got if r["list"] == name]
        assert [r["kmer"] for r in own] == [r["kmer"] for r in want] and [r["rank"] for r in own] == list(range(len(want)))
        assert [repr(r["value"]) for r in own] == [repr(r[column]) for r in want] and [r["counts"] for r in own] == [r["counts"] for r in want]


def test_top_lists_of_nulls_and_of_nothing(spark):
    df = values_frame(spark, 2, 50)
    got = select.top_lists(df, {"a": ("a", True)}, 50).orderBy("rank").collect()
    missing = {r["kmer"] for r in df.where("a is null or isnan(a)").collect()}
    assert len(got) == 50 and {r["kmer"] for r in got[50 - len(missing) :]} == missing
    assert select.top_lists(df.where("false"), {"a": ("a", True)}, 50).count() == 0


def test_top_lists_read_their_rows_once(spark):
    df = values_frame(spark, 3)
    plan = select.top_lists(df, {f"l{i}": (c, i % 2 == 0) for i, c in enumerate("abababa")}, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan


def rows_for_folds(samples):
    g = np.random.default_rng(samples)
    x = np.concatenate([
        g.gamma(1.0, 50.0, (60, samples)), g.integers(0, 3, (60, samples)), np.zeros((2, samples)), np.full((2, samples), 0.1),
        np.eye(samples)[: min(samples, 12)] * 7.3,  # only one sample has anything: folds without it have no spread
        1e8 + g.integers(0, 2, (10, samples)), 1e-9 * g.integers(0, 4, (10, samples)),
    ])
    return x.astype(float)


@pytest.mark.parametrize(("samples", "leave"), [(4, 1), (6, 2), (20, 2), (20, 10), (30, 15)])
@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_folds_are_correlations_of_the_training_samples(spark, samples, leave, method):
    x = rows_for_folds(samples)
    y = [float(7 * i % 5) for i in range(samples)]
    df = spark.createDataFrame([(f"k{i:03d}", r.tolist()) for i, r in enumerate(x)], "kmer string, norm array<double>")
    found, tests = select.cross_validate(df, "norm", y, method, leave)
    got = found.orderBy("kmer").toPandas()
    for f, test in enumerate(tests):
        train = [i for i in range(samples) if i not in test]
        part = df.select("kmer", F.array(*[F.col("norm")[i] for i in train]).alias("part"))
        want = select.CORRELATIONS[method](part, "part", [y[i] for i in train], "r").orderBy("kmer").toPandas()
        np.testing.assert_allclose(got[f"cv_{method}_{f}"].to_numpy(float), want["r"].to_numpy(float), atol=2e-9, equal_nan=True)


@pytest.mark.parametrize("ties", [2, 6, 10_000])
@pytest.mark.parametrize("samples", [1, 2, 5, 64, 65, 127, 300])
def test_pairs_counted_by_merging(samples, ties):
    g = np.random.default_rng(samples + ties)
    x, y = g.integers(0, ties, (25, samples)).astype(float), g.integers(0, ties, samples).astype(float)
    x[0] = 4.5
    for a, b in zip(rowstats._pair_tau(x, y), rowstats._merge_tau(x, y), strict=True):
        assert (a == b).all()


def test_tau_of_a_thousand_samples(spark):
    g = np.random.default_rng(1)
    x, y = g.integers(0, 50, (300, 1000)).astype(float), g.normal(size=1000)
    df = spark.createDataFrame([(f"k{i:03d}", r.tolist()) for i, r in enumerate(x)], "kmer string, norm array<double>")
    got = rowstats.kendall(df, "norm", y.tolist()).orderBy("kmer").toPandas()["kendall_tau"].to_numpy()
    score, loose = rowstats._pair_tau(x[:20], y)
    np.testing.assert_allclose(got[:20], score / np.sqrt(loose * (1000 * 999 / 2)), atol=1e-12)
