"""Statistics of matrix rows: a row holds one value per sample in an array column.

Phenotypes and classes are short lists known when the plan is built, so they become constants in
generated expressions; everything but ranks, Kendall's tau and distribution functions runs as
built-in expressions. Sums go from the first sample to the last, which keeps tests against zero
reproducible. Each function returns ``df`` with columns added.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from seqloom.functions.special import f_pvalue, normal_pvalue, t_pvalue

#: Rows of up to this many samples are written out term by term; longer ones are folded.
UNROLL = 64
NAN = "double('NaN')"

Term = Callable[[str], str]


def defined(value: Column) -> Column:
    """Arrow functions return null for NaN; here undefined is NaN."""
    return F.coalesce(value, F.lit(float("nan")))


def fold(indices: Sequence[int], term: Term) -> str:
    """SQL for the sum of ``term(i)`` over the indices, in their order."""
    if not indices:
        return "0D"
    if len(indices) <= UNROLL:
        return "(" + " + ".join(["0D", *(term(str(i)) for i in indices)]) + ")"
    listed = f"sequence(0, {len(indices) - 1})" if list(indices) == list(range(len(indices))) else f"array({', '.join(map(str, indices))})"
    return f"aggregate({listed}, 0D, (acc, i) -> acc + {term('i')})"


def constant(values: Sequence[float]) -> Term:
    """SQL for the i-th of some numbers, the number itself where i is known."""
    texts = [f"{float(v)!r}D" for v in values]
    listed = f"array({', '.join(texts)})"
    return lambda i: texts[int(i)] if i.isdigit() else f"{listed}[{i}]"


def members(classes: Sequence[int]) -> list[list[int]]:
    """Sample indices of each class."""
    return [[i for i, c in enumerate(classes) if c == k] for k in range(max(classes, default=-1) + 1)]


def _tie_groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's sorting order, and for every sorted place the first and last place of its tie group."""
    order = np.argsort(x, axis=1, kind="stable")
    ordered = np.take_along_axis(x, order, 1)
    rows, n = x.shape
    at = np.arange(n)
    first = np.ones((rows, n), bool)
    first[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    last = np.ones((rows, n), bool)
    last[:, :-1] = first[:, 1:]
    begin = np.maximum.accumulate(np.where(first, at, 0), axis=1)
    end = np.minimum.accumulate(np.where(last, at, n)[:, ::-1], axis=1)[:, ::-1]
    return order, begin, end


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Zero-based ranks within each row, ties sharing their mean rank."""
    order, begin, end = _tie_groups(x)
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (begin + end) / 2, 1)
    return out


def tie_sums(x: np.ndarray) -> np.ndarray:
    """Sum of t^3 - t over each row's groups of t equal values."""
    _, begin, end = _tie_groups(x)
    return ((end - begin + 1.0) ** 2 - 1).sum(axis=1)


def _matrix(values: pd.Series) -> np.ndarray:
    return np.array(values.to_list(), dtype=float).reshape(len(values), -1)


@F.pandas_udf(ArrayType(DoubleType()))
def row_ranks(values: pd.Series) -> pd.Series:
    return pd.Series(list(average_ranks(_matrix(values)))) if len(values) else pd.Series([], dtype=object)


@F.pandas_udf(DoubleType())
def row_ties(values: pd.Series) -> pd.Series:
    return pd.Series(tie_sums(_matrix(values)) if len(values) else [], dtype=float)


def _centred(df: DataFrame, values: str, y: Sequence[float], out: str) -> DataFrame:
    """Correlation from centred sums; rows or phenotypes without spread give one, no samples zero."""
    n = len(y)
    if not n:
        return df.withColumn(out, F.lit(0.0))
    every = range(n)
    mean_y = sum(map(float, y)) / n
    dy = [float(v) - mean_y for v in y]
    root_y = float(np.sqrt(sum(d * d for d in dy)))
    dev = constant(dy)
    m = f"__mean_{out}"
    df = df.withColumn(m, F.expr(f"{fold(every, lambda i: f'{values}[{i}]')} / {n}"))
    cross = fold(every, lambda i: f"({values}[{i}] - {m}) * {dev(i)}")
    spread = fold(every, lambda i: f"({values}[{i}] - {m}) * ({values}[{i}] - {m})")
    df = df.withColumn(f"__c_{out}", F.expr(cross)).withColumn(f"__d_{out}", F.expr(f"sqrt({spread}) * {root_y!r}D"))
    value = F.expr(f"CASE WHEN __d_{out} = 0 THEN 1D ELSE __c_{out} / __d_{out} END")
    return df.withColumn(out, value).drop(m, f"__c_{out}", f"__d_{out}")


def pearson(df: DataFrame, values: str, phenotype: Sequence[float], out: str = "pearson") -> DataFrame:
    """Pearson's r of every row with the phenotype; 1 where either has no spread."""
    return _centred(df, values, phenotype, out)


def spearman(df: DataFrame, values: str, phenotype: Sequence[float], out: str = "spearman") -> DataFrame:
    """Spearman's rho: Pearson's r of average ranks."""
    ranks = average_ranks(np.array([phenotype], float))[0] if len(phenotype) else []
    return _centred(df.withColumn("__ranks", row_ranks(values)), "__ranks", list(ranks), out).drop("__ranks")


def _ordered_pairs(ranks: np.ndarray) -> np.ndarray:
    """For every row of whole numbers the pairs that rise less those that fall, from left to right.

    Blocks of doubling width are merged, as in a merge sort; all rows and all blocks of one width are
    counted at once: sorted by value, each value of a right half has the smaller ones of its left half before it.
    """
    rows, n = ranks.shape
    out, width = np.zeros(rows, np.int64), 1
    at = np.arange(n)
    while width < n:
        block, left = at // (2 * width), (at // width) % 2 == 0
        size = np.bincount(block, weights=left).astype(np.int64)  # of each left half
        base = block * np.int64(2 * (n + 1))
        for strict in (True, False):
            # equal values of the left half stand behind those of the right half where only smaller ones count
            order = np.argsort(base + 2 * ranks + (left if strict else ~left), axis=1, kind="stable")
            before = np.cumsum(left[order], axis=1) - (np.cumsum(size) - size)[block]  # blocks keep their places
            found = np.where(left[order], 0, before).sum(axis=1)
            out += found if strict else found - int((size[block] * ~left).sum())
        width *= 2
    return out


def _untied(ranks: np.ndarray) -> np.ndarray:
    """For every row the number of pairs that do not tie."""
    n = ranks.shape[1]
    ordered = np.sort(ranks, axis=1)
    same = np.zeros(len(ranks), np.int64)
    run = np.zeros(len(ranks), np.int64)
    for j in range(1, n):  # a value ties with as many before it as its run is long
        run = np.where(ordered[:, j] == ordered[:, j - 1], run + 1, 0)
        same += run
    return n * (n - 1) // 2 - same


def _merge_tau(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and untied pairs of every row, in n log n steps of whole-array sorts."""
    by_y = np.argsort(y, kind="stable")
    ordered, y = np.sort(x, axis=1), y[by_y]
    fresh = np.zeros(x.shape, np.int64)
    fresh[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    ranks = np.empty(x.shape, np.int64)
    np.put_along_axis(ranks, np.argsort(x, axis=1, kind="stable"), np.cumsum(fresh, axis=1), 1)
    ranks = ranks[:, by_y]
    score = _ordered_pairs(ranks)
    edges = np.flatnonzero(np.diff(y, prepend=np.nan, append=np.nan))
    for a, b in zip(edges, edges[1:], strict=False):  # pairs that tie in y do not count
        if b - a > 1:
            score -= _ordered_pairs(ranks[:, a:b])
    return score.astype(float), _untied(ranks).astype(float)


def _pair_tau(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and untied pairs of every row, pair by pair."""
    score, loose = np.zeros(len(x)), np.zeros(len(x))
    for i in range(len(y) - 1):
        s = np.sign(x[:, i : i + 1] - x[:, i + 1 :])
        score += s @ np.sign(y[i] - y[i + 1 :])
        loose += np.abs(s).sum(axis=1)
    return score, loose


#: Samples above which pairs are counted by merging, and cells that are merged at once.
MERGE, CELLS = 64, 1 << 20


def kendall_tau(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Tau-b of every row of ``x`` with ``y``; NaN where all pairs tie in either."""
    n = len(y)
    if n <= MERGE:
        score, loose = _pair_tau(x, y)
    else:
        step = max(1, CELLS // n)
        parts = [_merge_tau(x[i : i + step], y) for i in range(0, len(x), step)]
        score, loose = (np.concatenate([p[j] for p in parts]) if parts else np.zeros(0) for j in (0, 1))
    _, ties = np.unique(y, return_counts=True)
    loose_y = float(n * (n - 1) // 2 - (ties * (ties - 1) // 2).sum())
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((loose > 0) & (loose_y > 0), score / np.sqrt(loose * loose_y), np.nan)


def kendall(df: DataFrame, values: str, phenotype: Sequence[float], out: str = "kendall_tau") -> DataFrame:
    """Kendall's tau-b of every row with the phenotype."""
    y = np.asarray(phenotype, float)

    @F.pandas_udf(DoubleType())
    def tau(rows: pd.Series) -> pd.Series:
        return pd.Series(kendall_tau(_matrix(rows), y) if len(rows) else [], dtype=float)

    return df.withColumn(out, defined(tau(values)))


def entropy(df: DataFrame, counts: str, samples: int, out: str = "entropy", pseudo: int = 1) -> DataFrame:
    """Entropy in bits of the row's counts, each increased by ``pseudo``."""
    every = range(samples)
    total = fold(every, lambda i: f"({counts}[{i}] + {pseudo})")
    logs = fold(every, lambda i: f"({counts}[{i}] + {pseudo}) * ln({counts}[{i}] + {pseudo})")
    df = df.withColumn("__t", F.expr(total)).withColumn("__l", F.expr(logs))
    return df.withColumn(out, F.expr("(ln(__t) - __l / __t) / ln(2)")).drop("__t", "__l")


def _moments(df: DataFrame, value: Term, classes: Sequence[int], tag: str) -> tuple[DataFrame, list[str]]:
    """Mean and standard deviation (n - 1; zero below two members) of each class, and the columns' names to drop."""
    names = []
    for k, own in enumerate(members(classes)):
        n, m, s = len(own), f"__m{k}_{tag}", f"__s{k}_{tag}"
        df = df.withColumn(m, F.expr(f"{fold(own, value)} / {max(n, 1)}"))
        squares = fold(own, lambda i, m=m: f"({value(i)} - {m}) * ({value(i)} - {m})")
        df = df.withColumn(s, F.expr(f"sqrt({squares} / {n - 1})") if n > 1 else F.lit(0.0))
        names += [m, s]
    return df, names


def welch(df: DataFrame, counts: str, classes: Sequence[int], out: str = "ttest", pvalue: bool = True) -> DataFrame:
    """Welch's t-test on log2(count + 1): ``<out>_stat``, ``<out>_df`` and ``<out>_p``; NaN where undefined."""
    n0, n1 = (len(m) for m in members(classes))
    if min(n0, n1) < 2:
        for c in ("stat", "df", *["p"] * pvalue):
            df = df.withColumn(f"{out}_{c}", F.expr(NAN))
        return df
    df = df.withColumn("__log", F.transform(counts, lambda x: F.log2(x + 1)))
    df, names = _moments(df, lambda i: f"__log[{i}]", classes, out)
    v0, v1 = f"(__s0_{out} * __s0_{out} / {n0})", f"(__s1_{out} * __s1_{out} / {n1})"
    below = f"({v0} * {v0} / {n0 - 1} + {v1} * {v1} / {n1 - 1})"
    df = df.withColumn("__delta", F.expr(f"sqrt({v0} + {v1})"))
    df = df.withColumn(f"{out}_stat", F.expr(f"CASE WHEN __delta = 0 THEN {NAN} ELSE (__m0_{out} - __m1_{out}) / __delta END"))
    df = df.withColumn(f"{out}_df", F.expr(f"CASE WHEN __delta = 0 OR {below} = 0 THEN {NAN} ELSE ({v0} + {v1}) * ({v0} + {v1}) / {below} END"))
    if pvalue:
        df = df.withColumn(f"{out}_p", defined(t_pvalue(f"{out}_stat", f"{out}_df")))
    return df.drop("__log", "__delta", *names)


def student(df: DataFrame, values: str, classes: Sequence[int], out: str = "student") -> DataFrame:
    """Pooled two-sample t-test on the values as they are: ``_stat``, ``_df``, ``_p``; NaN without pooled spread."""
    n0, n1 = (len(m) for m in members(classes))
    if not n0 or not n1 or n0 + n1 < 3:
        return df.withColumn(f"{out}_stat", F.expr(NAN)).withColumn(f"{out}_df", F.expr(NAN)).withColumn(f"{out}_p", F.expr(NAN))
    df, names = _moments(df, lambda i: f"{values}[{i}]", classes, out)
    pooled = f"sqrt((({n0 - 1} * __s0_{out} * __s0_{out} + {n1 - 1} * __s1_{out} * __s1_{out}) / {n0 + n1 - 2}) * (1D / {n0} + 1D / {n1}))"
    df = df.withColumn("__delta", F.expr(pooled))
    df = df.withColumn(f"{out}_stat", F.expr(f"CASE WHEN __delta = 0 THEN {NAN} ELSE (__m0_{out} - __m1_{out}) / __delta END"))
    df = df.withColumn(f"{out}_df", F.lit(float(n0 + n1 - 2)))
    return df.withColumn(f"{out}_p", defined(t_pvalue(f"{out}_stat", f"{out}_df"))).drop("__delta", *names)


def signal_to_noise(df: DataFrame, values: str, classes: Sequence[int], out: str = "snr") -> DataFrame:
    """|mean0 - mean1| / (sd0 + sd1); zero where either standard deviation is zero."""
    df, names = _moments(df, lambda i: f"{values}[{i}]", classes, out)
    value = f"CASE WHEN __s0_{out} = 0 OR __s1_{out} = 0 THEN 0D ELSE abs(__m0_{out} - __m1_{out}) / (__s0_{out} + __s1_{out}) END"
    return df.withColumn(out, F.expr(value)).drop(*names)


def rank_sum(df: DataFrame, values: str, classes: Sequence[int], out: str = "wrs", pvalue: bool = True) -> DataFrame:
    """Mann-Whitney U with tie correction and continuity 0.5: ``_u1``, ``_u2`` and ``_p`` (1 where all values tie)."""
    first = members(classes)[0]
    n = len(classes)
    n0, n1 = len(first), n - len(first)
    df = df.withColumn("__ranks", row_ranks(values))
    u1 = f"{fold(first, lambda i: f'(__ranks[{i}] + 1)')} - {n0 * (n0 + 1) / 2!r}D"
    df = df.withColumn(f"{out}_u1", F.expr(u1)).withColumn(f"{out}_u2", F.expr(f"{float(n0 * n1)!r}D - {out}_u1"))
    if pvalue:
        spread = f"sqrt({n0 * n1 / 2 / 6!r}D * ({n + 1} - __ties / {max(n * (n - 1), 1)}))"
        df = df.withColumn("__ties", row_ties("__ranks")).withColumn("__s", F.expr(spread))
        z = f"CASE WHEN __s = 0 OR isnan(__s) THEN -double('Infinity') ELSE (greatest({out}_u1, {out}_u2) - {n0 * n1 / 2!r}D - 0.5D) / __s END"
        df = df.withColumn(f"{out}_p", defined(normal_pvalue(F.expr(z)))).drop("__s", "__ties")
    return df.drop("__ranks")


#: What DIDS adds up for an excess d over a class's maximum.
DIDS = {"sqrt": lambda d: f"sqrt({d})", "quadratic": lambda d: f"({d}) * ({d})", "tanh": lambda d: f"(1D + tanh(3D * ({d}) - 3D))"}


def dids(df: DataFrame, values: str, classes: Sequence[int], mode: str = "sqrt", out: str = "dids") -> DataFrame:
    """Largest over classes of the sum of f(excess over the class's maximum, at least zero) of other classes' samples."""
    groups = members(classes)
    for k, own in enumerate(groups):
        df = df.withColumn(f"__max{k}", F.expr(f"greatest(0D, {', '.join(f'double({values}[{i}])' for i in own)})" if own else "0D"))
    scores = []
    for k, own in enumerate(groups):
        rest = [i for i in range(len(classes)) if i not in set(own)]
        excess = lambda i, k=k: f"{values}[{i}] - __max{k}"
        scores.append(fold(rest, lambda i, e=excess, k=k: f"CASE WHEN {values}[{i}] > __max{k} THEN {DIDS[mode](e(i))} ELSE 0D END"))
    return df.withColumn(out, F.expr(f"greatest({', '.join(scores)})" if len(scores) > 1 else scores[0])).drop(*[f"__max{k}" for k in range(len(groups))])


def anova(df: DataFrame, values: str, classes: Sequence[int], out: str = "anova", pvalue: bool = True) -> DataFrame:
    """One-way analysis of variance: ``_stat`` and ``_p``; NaN for an empty class, one class, one sample a class or no spread inside classes."""
    groups = members(classes)
    n, c = len(classes), len(groups)
    if c < 2 or n == c or not all(groups):
        df = df.withColumn(f"{out}_stat", F.expr(NAN))
        return df.withColumn(f"{out}_p", F.expr(NAN)) if pvalue else df
    every = range(n)
    total, squares = fold(every, lambda i: f"{values}[{i}]"), fold(every, lambda i: f"{values}[{i}] * {values}[{i}]")
    df = df.withColumn("__sum", F.expr(total)).withColumn("__sq", F.expr(squares))
    between = " + ".join(f"{len(g)} * power({fold(g, lambda i: f'{values}[{i}]')} / {len(g)} - __sum / {n}, 2)" for g in groups)
    df = df.withColumn("__bg", F.expr(between)).withColumn("__wg", F.expr(f"(__sq - __sum * __sum / {n}) - __bg"))
    df = df.withColumn(f"{out}_stat", F.expr(f"CASE WHEN __wg = 0 THEN {NAN} ELSE (__bg / {c - 1}) / (__wg / {n - c}) END"))
    if pvalue:
        df = df.withColumn(f"{out}_p", defined(f_pvalue(f"{out}_stat", F.lit(float(c - 1)), F.lit(float(n - c)))))
    return df.drop("__sum", "__sq", "__bg", "__wg")


def any_nan(values: Column) -> Column:
    return F.exists(values, F.isnan)


def all_finite(values: Column) -> Column:
    """Neither NaN nor infinite, every one."""
    return F.forall(values, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
