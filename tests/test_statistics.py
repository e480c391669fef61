import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.functions import rowstats, special
from seqloom.operators import normalize, pvalues, reduce, select


def rows(spark, values, name="norm"):
    data = [(f"k{i:03d}", [float(x) for x in v]) for i, v in enumerate(values)]
    return spark.createDataFrame(data, f"kmer string, {name} array<double>")


def column(df, name):
    return [r[name] for r in df.orderBy("kmer").collect()]


NAN = pytest.approx(float("nan"), nan_ok=True)


def test_correlations_and_their_edge_cases(spark):
    y = [1, 2, 3, 4, 5]
    df = rows(spark, [[2, 4, 6, 8, 10], [5, 4, 3, 2, 1], [3, 3, 3, 3, 3], [1, 3, 2, 2, 9]])
    assert column(rowstats.pearson(df, "norm", y), "pearson") == pytest.approx([1, -1, 1, np.corrcoef([1, 3, 2, 2, 9], y)[0, 1]])
    assert column(rowstats.spearman(df, "norm", y), "spearman")[:3] == pytest.approx([1, -1, 1])
    assert column(rowstats.kendall(df, "norm", y), "kendall_tau") == [pytest.approx(1), pytest.approx(-1), NAN, pytest.approx(5 / math.sqrt(9 * 10))]
    assert column(rowstats.pearson(df, "norm", [7, 7, 7, 7, 7]), "pearson") == [1, 1, 1, 1]


def test_long_rows_are_folded(spark):
    rng = np.random.default_rng(1)
    x, y = rng.random((5, 90)), rng.random(90).tolist()
    df = rows(spark, x)
    assert column(rowstats.pearson(df, "norm", y), "pearson") == pytest.approx([np.corrcoef(r, y)[0, 1] for r in x])
    c = [i % 2 for i in range(90)]
    want = [abs(r[::2].mean() - r[1::2].mean()) / (r[::2].std(ddof=1) + r[1::2].std(ddof=1)) for r in x]
    assert column(rowstats.signal_to_noise(df, "norm", c), "snr") == pytest.approx(want)
    assert len(column(rowstats.dids(df, "norm", c), "dids")) == 5


def test_entropy(spark):
    df = rows(spark, [[0, 0, 0, 0], [7, 0, 0, 0]], "counts")
    p = np.array([8, 1, 1, 1]) / 11
    assert column(rowstats.entropy(df, "counts", 4), "entropy") == pytest.approx([2.0, -(p * np.log2(p)).sum()])


def test_differential_edge_cases(spark):
    df = rows(spark, [[1, 1, 1, 1], [0, 0, 5, 5], [1, 2, 3, 5]], "counts")
    assert column(rowstats.welch(df, "counts", [0, 1, 1, 1]), "ttest_p") == [NAN] * 3
    assert column(rowstats.welch(df, "counts", [0, 0, 1, 1]), "ttest_stat")[:2] == [NAN] * 2
    assert column(rowstats.signal_to_noise(df, "counts", [0, 0, 1, 1]), "snr")[:2] == [0, 0]
    wrs = rowstats.rank_sum(df, "counts", [0, 0, 1, 1])
    assert column(wrs, "wrs_p")[0] == 1 and column(wrs, "wrs_u1") == [2, 0, 0] and column(wrs, "wrs_u2") == [2, 4, 4]
    z = (4 - 2 - 0.5) / math.sqrt(2 / 6 * 5)
    assert column(wrs, "wrs_p")[2] == pytest.approx(math.erfc(z / math.sqrt(2)))
    assert column(rowstats.anova(df, "counts", [0, 1, 2, 3]), "anova_stat") == [NAN] * 3
    assert column(rowstats.anova(df, "counts", [0, 0, 1, 1]), "anova_stat")[0] == NAN
    assert column(rowstats.dids(df, "counts", [0, 0, 1, 1], "quadratic"), "dids") == [0, 50, 1 + 9]
    student = rowstats.student(df, "counts", [0, 0, 1, 1])
    assert column(student, "student_stat")[2] == pytest.approx(-2.5 / math.sqrt((0.5 + 2) / 2)) and column(student, "student_df")[2] == 2


def test_tails_against_closed_forms():
    t, f = np.array([0.0, 0.5, 3.0, -40.0]), np.array([0.1, 1.0, 7.5, 300.0])
    assert special.t_two_sided(t, 1) == pytest.approx(1 - 2 * np.arctan(np.abs(t)) / math.pi, abs=1e-12)
    assert special.t_two_sided(t, 2) == pytest.approx(1 - np.abs(t) / np.sqrt(2 + t * t), abs=1e-12)
    for d2 in (1, 5, 17, 1000):
        assert special.f_upper(f, 2, d2) == pytest.approx((1 + 2 * f / d2) ** (-d2 / 2), abs=1e-12)
    assert special.normal_two_sided(np.array([-5, 0, 1.959963984540054])) == pytest.approx([1, 1, 0.05])
    assert np.isnan(special.t_two_sided(np.array([np.nan]), 3)).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=2, max_size=8))
def test_ranks_and_tau_of_a_row_with_itself(v):
    x = np.array([v], float)
    assert rowstats.average_ranks(x)[0].tolist() == [sum(b < a for b in v) + (v.count(a) - 1) / 2 for a in v]
    assert rowstats.tie_sums(x)[0] == sum(v.count(a) ** 3 - v.count(a) for a in set(v))
    if len(set(v)) > 1:
        assert rowstats.kendall_tau(x, x[0])[0] == pytest.approx(1)


def plain_corrections(p, method):
    m = len(p)
    order = sorted((i for i in range(m) if not math.isnan(p[i])), key=lambda i: p[i])
    out = list(p)
    if method == "b":
        return [x if math.isnan(x) else min(1, x * m) for x in p]
    if method == "hb":
        top = 0
        for i, k in enumerate(order):
            top = max(top, min(1, p[k] * (m - i)))
            out[k] = top
        return out
    scale = sum(1 / i for i in range(1, m + 1)) if method == "by" else 1
    low = 1
    for i in range(len(order), 0, -1):
        low = min(low, p[order[i - 1]] * m / i * scale)
        out[order[i - 1]] = low
    return out


@pytest.mark.parametrize("method", pvalues.METHODS)
def test_corrections(spark, method):
    rng = np.random.default_rng(8)
    p = [float(x) for x in np.round(rng.random(200) ** 3, 2)] + [float("nan"), 0.0, 1e-300, 1.0]
    df = spark.createDataFrame([(f"k{i:03d}", x) for i, x in enumerate(p)], "kmer string, p double")
    got = pvalues.correct(df, "p", method, "q")
    assert column(got, "q") == pytest.approx(_holm_ties(p, plain_corrections(p, method), method), nan_ok=True)
    assert pvalues.significant(got, "q", 0.05).count() == sum(x <= 0.05 for x in column(got, "q") if not math.isnan(x))


def _holm_ties(p, adjusted, method):
    """Equal p-values count as their first in Holm's order."""
    if method != "hb":
        return adjusted
    least = {}
    for x, a in zip(p, adjusted, strict=True):
        least[x] = min(a, least.get(x, 2))
    return [a if math.isnan(x) else least[x] for x, a in zip(p, adjusted, strict=True)]


def counts(spark, m):
    return spark.createDataFrame([(f"k{i}", [int(x) for x in r]) for i, r in enumerate(m)], "kmer string, counts array<bigint>")


def test_normalisation(spark):
    m = [[1, 2, 0], [4, 0, 0], [5, 8, 0]]
    df = counts(spark, m)
    assert normalize.learn(df, 3, "freq").values == [0.1, 0.1, 0.0]
    assert normalize.learn(df, 3, "deseq").values == [1, 1, 1]
    full = [[2, 4], [3, 9], [10, 10]]
    ratios = np.array([np.log(r) - np.log(r).mean() for r in full])
    assert normalize.learn(counts(spark, full), 2, "deseq").values == pytest.approx(1 / np.exp(np.median(ratios, axis=0)))


def test_medians_are_exact(spark):
    rng = np.random.default_rng(12)
    values = [rng.normal(size=301), rng.normal(size=300), np.r_[np.zeros(90), rng.normal(size=20)], np.array([-7.25]), np.array([1.0, 2.0]), np.round(rng.normal(size=400), 1)]
    cells = spark.createDataFrame([(i, float(x)) for i, v in enumerate(values) for x in v], "sample int, value double").repartition(3)
    assert normalize.medians(cells) == {i: pytest.approx(np.median(v), abs=1e-15) for i, v in enumerate(values)}
    assert normalize.medians(cells.limit(0)) == {}


def test_counts_not_learned_are_an_error(spark, monkeypatch):
    learned = normalize.learn(counts(spark, [[1, 2], [3, 4]]), 2, "q")
    for most in (1 << 20, 0):
        monkeypatch.setattr(normalize, "LOOKUP_BYTES", most)
        with pytest.raises(Exception, match="not learned"):
            learned.transform(counts(spark, [[1, 9]])).collect()


@pytest.mark.parametrize("by_join", [False, True])
def test_quantiles(spark, monkeypatch, by_join, tmp_path):
    if by_join:
        monkeypatch.setattr(normalize, "LOOKUP_BYTES", 0)
    m = np.random.default_rng(4).integers(0, 6, (40, 3))
    profile = np.sort(m, axis=0).mean(axis=1)
    want = [[np.mean([profile[r] for r in range(40) if np.sort(m[:, j])[r] == x]) for j, x in enumerate(row)] for row in m]
    df = counts(spark, m)
    normalize.save(normalize.learn(df, 3, "q"), spark, f"file://{tmp_path}/q")
    got = {r["kmer"]: r["norm"] for r in normalize.load(spark, f"file://{tmp_path}/q").transform(df).collect()}
    assert [got[f"k{i}"] for i in range(40)] == [pytest.approx(w) for w in want]


def test_top_and_folds(spark):
    df = spark.createDataFrame([("c", 1.0), ("a", float("nan")), ("b", -3.0), ("d", 1.0)], "kmer string, v double")
    assert [r["kmer"] for r in select.top(df, "v", 4).collect()] == ["c", "d", "b", "a"]
    assert [r["kmer"] for r in select.top(df, "v", 2, absolute=True).collect()] == ["b", "c"]
    assert select.folds(8, 2) == [[2, 4], [0, 1], [3, 7], [5, 6]] and select.folds(3, 1) == [[0], [1], [2]]
    for leave in (0, 8, 3):
        with pytest.raises(ValueError, match="samples a fold"):
            select.folds(8, leave)


def test_cross_validation(spark):
    x = np.random.default_rng(6).random((6, 8))
    y = [3, 1, 4, 1, 5, 9, 2, 6]
    df = rows(spark, x).selectExpr("kmer", "norm", "transform(norm, v -> cast(10 * v AS bigint)) AS counts")
    got, tests = select.cross_validate(df, "norm", y, "pearson", 2)
    for f, test in enumerate(tests):
        train = [i for i in range(8) if i not in test]
        assert column(got, f"cv_pearson_{f}") == pytest.approx([np.corrcoef(r[train], np.array(y)[train])[0, 1] for r in x])
    best = select.fold_top(got, "pearson", 0, tests, [f"s{i}" for i in range(8)], 3)
    assert best.columns[-2:] == ["[TEST]_s2", "[TEST]_s4"] and best.count() == 3


def test_components_and_umap(spark):
    x = np.random.default_rng(2).random((50, 6)) + np.repeat([0, 3], 3) * np.random.default_rng(3).random((50, 1))
    df = rows(spark, x)
    found = reduce.pca(df, "norm", 6, 2)
    centred = x - x.mean(axis=1, keepdims=True)
    u, s, v = np.linalg.svd(centred.T, full_matrices=False)
    assert found.variance == pytest.approx(s**2 / 5, abs=1e-9) and np.abs(found.scores) == pytest.approx(np.abs(u[:, :2] * s[:2]), abs=1e-9)
    assert found.ratio.sum() == pytest.approx(1)
    at = reduce.umap(df, "norm", 6, 2, reduce.UmapOptions(num_neighbors=2))
    gap = np.linalg.norm(at[:3].mean(axis=0) - at[3:].mean(axis=0))
    assert gap > max(np.linalg.norm(at[g] - at[g].mean(axis=0), axis=1).max() for g in (slice(0, 3), slice(3, 6)))
    assert (at == reduce.umap(df, "norm", 6, 2, reduce.UmapOptions(num_neighbors=2))).all()
    for d in (0, 6):
        with pytest.raises(ValueError, match="dimensions"):
            reduce.pca(df, "norm", 6, d)
    a, b = reduce._curve(1.0, 0.1)
    assert a == pytest.approx(1.577, abs=0.02) and b == pytest.approx(0.895, abs=0.02)


def test_quantile_tables_are_filled_without_map_lookups(spark, monkeypatch):
    """A place for each count up to the largest; a lookup in a map of counts for each place would be quadratic."""
    from seqloom.operators import normalize

    rows = [(f"k{i}", [i * i % 977, i, 60_000 - i]) for i in range(200)]
    matrix = spark.createDataFrame(rows, "kmer string, counts array<long>")
    model = normalize.learn(matrix, 3, "q")
    by_table = model.transform(matrix)
    assert "map_from_entries(collect_list(struct(value" not in by_table._jdf.queryExecution().optimizedPlan().toString().replace("named_", "")
    monkeypatch.setattr(normalize, "LOOKUP_BYTES", 0)
    assert {r["kmer"]: r["norm"] for r in by_table.collect()} == {r["kmer"]: r["norm"] for r in model.transform(matrix).collect()}
