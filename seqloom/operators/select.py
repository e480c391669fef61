"""Top-N selection, one list or many in one pass, and cross-validation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from seqloom.functions import rowstats

CORRELATIONS = {"pearson": rowstats.pearson, "spearman": rowstats.spearman, "kendall": rowstats.kendall}


def top(df: DataFrame, value: str | Column, n: int = 10_000, absolute: bool = False, key: str = "kmer") -> DataFrame:
    """The n rows of largest (absolute) value, sorted; NaN comes last, ties in the key's order."""
    v = F.col(value) if isinstance(value, str) else value
    v = F.abs(v) if absolute else v
    return df.orderBy(F.isnan(v), F.desc(v), F.asc(key)).limit(n)


def _best(columns: list[tuple[str, str, bool]], n: int, keep: str):
    """mapInArrow function: rows (kmer, keep, values...) -> the best n of the task for each list, (list, kmer, value, keep).

    The threshold of a list that is full keeps most rows of a batch out of the sort.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table | None] = [None] * len(columns)
        least: list[float | None] = [None] * len(columns)
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for i, (_, column, absolute) in enumerate(columns):
                value = pc.fill_null(rows[column], math.nan)
                size = pc.abs(value) if absolute else value
                mine = pa.table({"kmer": rows["kmer"], "value": value, "size": size, keep: rows[keep]})
                if least[i] is not None:
                    mine = mine.filter(pc.greater_equal(size, least[i]))
                if not mine.num_rows:
                    continue
                both = mine if kept[i] is None else pa.concat_tables([kept[i], mine])
                flat = both.append_column("nan", pc.is_nan(both["size"]))
                order = pc.sort_indices(flat.select(["nan", "size", "kmer"]), [("nan", "ascending"), ("size", "descending"), ("kmer", "ascending")])
                kept[i] = both.take(order[:n])
                if kept[i].num_rows == n:
                    last = kept[i]["size"][n - 1].as_py()
                    least[i] = None if math.isnan(last) else last
        for (name, _, _), best in zip(columns, kept, strict=True):
            if best is not None:
                out = pa.table({"list": pa.array([name] * best.num_rows), "kmer": best["kmer"], "value": best["value"], keep: best[keep]})
                yield from out.combine_chunks().to_batches()

    return run


def top_lists(df: DataFrame, lists: dict[str, tuple[str, bool]], n: int = 10_000, keep: str = "counts") -> DataFrame:
    """Many top lists in one pass: ``(list, rank, kmer, value, keep)``, rank from 0.

    ``lists`` gives each list's name the column that it goes by, and whether by its absolute value. Each
    is what :func:`top` returns: NaN comes last, ties in the order of k-mers. A task keeps its best n of each list,
    these meet in parts of some tasks each, and only the parts' best come together, so no task
    sees more than n rows for each part, whatever the table.
    """
    columns = [(name, column, absolute) for name, (column, absolute) in lists.items()]
    named = [F.col(c).cast("double").alias(c) for c in dict.fromkeys(c for _, c, _ in columns)]
    kind = dict(df.dtypes)[keep]
    schema = f"list string, kmer string, value double, {keep} {kind}"
    found = df.select("kmer", keep, *named).mapInArrow(_best(columns, n, keep), schema)
    size = F.when(F.lit(False), 0.0)
    for name, _, absolute in columns:
        size = F.when(F.col("list") == name, F.abs("value") if absolute else F.col("value")).otherwise(size)
    order = [F.isnan("size").asc(), F.desc("size"), F.asc("kmer")]
    tasks = df.sparkSession.sparkContext.defaultParallelism
    part = F.pmod(F.xxhash64("kmer"), F.lit(max(1, math.isqrt(tasks))))
    some = found.withColumn("size", size).withColumn("part", part)
    within = some.withColumn("rank", F.row_number().over(Window.partitionBy("list", "part").orderBy(*order))).where(F.col("rank") <= n)
    ranked = within.withColumn("rank", F.row_number().over(Window.partitionBy("list").orderBy(*order)) - 1).where(F.col("rank") < n)
    return ranked.select("list", F.col("rank").cast("long").alias("rank"), "kmer", "value", keep)


def folds(samples: int, leave: int = 2, seed: int = 1_234_567_890) -> list[list[int]]:
    """Test samples of each fold: consecutive slices, sorted, of a seeded shuffle (identity for ``leave`` 1)."""
    if not 1 <= leave < samples or samples % leave:
        raise ValueError(f"{leave} samples a fold: must be at least 1, below {samples}, and divide it")
    order = list(range(samples))
    if leave > 1:
        draw = np.random.RandomState(seed)._bit_generator.random_raw  # the 32-bit Mersenne twister stream
        for i in range(samples):
            j = i + int(draw()) % (samples - i)
            order[i], order[j] = order[j], order[i]
    return [sorted(order[i : i + leave]) for i in range(0, samples, leave)]


def _sum(x: np.ndarray) -> np.ndarray:
    """Sums of rows from the first column to the last, as the statistics of whole rows take them."""
    return np.add.accumulate(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pearson's r of every row of ``x`` with ``y``, in two passes; 1 where either has no spread."""
    n = len(y)
    a, b = x - (_sum(x) / n)[:, None], (y - _sum(y[None])[0] / n)[None]
    d = np.sqrt(_sum(a * a)) * np.sqrt(_sum(b * b))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(d == 0, 1.0, _sum(a * b) / d)


#: Parts of a row's spread, and of its sum of squares, below which a fold is counted anew.
THIN, FLAT = 1e-6, 1e-14


def _pearson_folds(x: np.ndarray, y: np.ndarray, tests: list[list[int]]) -> np.ndarray:
    """Each fold from the sums over all samples less those of the samples left out."""
    n = len(y)
    a, b = x - x.mean(axis=1, keepdims=True), y - y.mean()
    aa, ab, bb, least = (a * a).sum(axis=1), a @ b, b @ b, FLAT * (x * x).sum(axis=1)
    out = np.empty((len(x), len(tests)))
    for f, test in enumerate(tests):
        t, la, lb = n - len(test), a[:, test], b[test]
        sa, sb = -la.sum(axis=1), -lb.sum()
        spread = aa - (la * la).sum(axis=1) - sa * sa / t
        spread_y = bb - lb @ lb - sb * sb / t
        cross = ab - la @ lb - sa * sb / t
        with np.errstate(invalid="ignore", divide="ignore"):
            out[:, f] = cross / np.sqrt(spread * spread_y)
        thin = ~((spread > THIN * aa) & (spread > least)) | ~np.isfinite(out[:, f]) if spread_y > THIN * bb else np.ones(len(x), bool)
        if thin.any():
            train = [i for i in range(n) if i not in test]
            out[thin, f] = _exact(x[np.ix_(thin, train)], y[train])
    return out


def _spearman_folds(x: np.ndarray, y: np.ndarray, tests: list[list[int]]) -> np.ndarray:
    """Ranks within a fold are those within all samples less what the samples left out have below."""
    n = len(y)
    ranks, ranks_y = rowstats.average_ranks(x), rowstats.average_ranks(y[None])[0]
    out = np.empty((len(x), len(tests)))
    for f, test in enumerate(tests):
        train = [i for i in range(n) if i not in test]
        own, own_y = ranks[:, train].copy(), ranks_y[train].copy()
        for i in test:
            own -= (np.sign(x[:, train] - x[:, [i]]) + 1) / 2
            own_y -= (np.sign(y[train] - y[i]) + 1) / 2
        out[:, f] = _exact(own, own_y)
    return out


def _kendall_folds(x: np.ndarray, y: np.ndarray, tests: list[list[int]]) -> np.ndarray:
    """Pairs of all samples, less those in which a sample left out has part."""
    n = len(y)
    sy = np.sign(y[:, None] - y[None])
    score, loose = np.zeros(x.shape), np.zeros(x.shape)
    for i in range(n):
        s = np.sign(x[:, [i]] - x)
        score[:, i], loose[:, i] = s @ sy[i], np.abs(s).sum(axis=1)
    all_score, all_loose, loose_y = score.sum(axis=1) / 2, loose.sum(axis=1) / 2, np.abs(sy).sum() / 2
    out = np.empty((len(x), len(tests)))
    for f, test in enumerate(tests):
        c, v, w = all_score - score[:, test].sum(axis=1), all_loose - loose[:, test].sum(axis=1), loose_y - np.abs(sy[test]).sum()
        for at, i in enumerate(test):
            for j in test[:at]:  # pairs of two samples left out went twice
                s = np.sign(x[:, i] - x[:, j])
                c, v, w = c + s * sy[i, j], v + np.abs(s), w + abs(sy[i, j])
        with np.errstate(invalid="ignore", divide="ignore"):
            out[:, f] = np.where((v > 0) & (w > 0), c / np.sqrt(v * w), np.nan)
    return out


FOLDS = {"pearson": _pearson_folds, "spearman": _spearman_folds, "kendall": _kendall_folds}
#: Cells of a batch that are worked on at once.
CELLS = 1 << 20


def cross_validate(
    matrix: DataFrame, values: str, phenotype: Sequence[float], method: str = "pearson", leave: int = 2, seed: int = 1_234_567_890
) -> tuple[DataFrame, list[list[int]]]:
    """Adds ``cv_<method>_<fold>``: the correlation over each fold's training samples; returns the folds as well.

    Values are normalised over all samples beforehand. All folds are computed in one pass, each from
    what all samples give and the few left out.
    """
    tests, y, work = folds(len(phenotype), leave, seed), np.asarray(phenotype, float), FOLDS[method]

    @F.pandas_udf(ArrayType(DoubleType()))
    def every(rows: pd.Series) -> pd.Series:
        step = max(1, CELLS // len(y))
        parts = [work(np.array(rows.iloc[i : i + step].tolist(), float), y, tests) for i in range(0, len(rows), step)]
        return pd.Series([list(r) for p in parts for r in p], dtype=object)

    found = matrix.withColumn("__folds", every(values))
    columns = {f"cv_{method}_{f}": rowstats.defined(F.col("__folds")[f]) for f in range(len(tests))}
    return found.withColumns(columns).drop("__folds"), tests


def fold_lists(validated: DataFrame, methods: dict[str, list[list[int]]], n: int = 10_000) -> DataFrame:
    """The best rows of all folds of all methods by absolute correlation, in one pass; lists are named ``cv_<method>_<fold>``."""
    names = [f"cv_{m}_{f}" for m, tests in methods.items() for f in range(len(tests))]
    return top_lists(validated, {c: (c, True) for c in names}, n)


def fold_top(validated: DataFrame, method: str, fold: int, tests: list[list[int]], samples: Sequence[str], n: int = 10_000) -> DataFrame:
    """One fold's best rows by absolute correlation: value, then counts of training and of test samples."""
    best = top(validated, f"cv_{method}_{fold}", n, absolute=True)
    return best.select("kmer", F.col(f"cv_{method}_{fold}").alias(method), *[F.col("counts")[i].alias(c) for c, i in fold_columns(samples, tests[fold])])


def fold_columns(samples: Sequence[str], test: Sequence[int]) -> list[tuple[str, int]]:
    """Names of a fold's count columns and the samples they are of: training samples, then test samples."""
    train = [i for i in range(len(samples)) if i not in test]
    return [(f"[TRAIN]_{samples[i]}", i) for i in train] + [(f"[TEST]_{samples[i]}", i) for i in test]
