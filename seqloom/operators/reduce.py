"""Dimension reduction of samples: principal components and UMAP.

Samples are few and k-mers many, so Spark reduces the matrix to products between samples (n x n
numbers) and the small rest is done with numpy on the driver; n is the number of columns. With more
than ``GRAM_SAMPLES`` of them the products are never made: the leading components come from a block
Krylov space, a scan of the matrix for each of its steps, and only n x (block x steps) numbers are held.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Samples up to which all their products are made (32 MB).
GRAM_SAMPLES = 2048
#: Directions of a Krylov block beyond the components asked for, most steps, and the error at which steps end.
EXTRA, STEPS, TOLERANCE = 8, 40, 1e-10
#: Numbers of a matrix that a task looks at together.
SLICE = 1 << 22


def _dense(column: pa.Array, samples: int, centred: bool) -> Iterator[np.ndarray]:
    """The rows of a batch of arrays, some at a time; centred over the samples if asked."""
    step = max(1, SLICE // samples)
    for at in range(0, len(column), step):
        x = column.slice(at, step).flatten().to_numpy(zero_copy_only=False).reshape(-1, samples)
        yield x - x.mean(axis=1, keepdims=True) if centred else x


def _rows(matrix: DataFrame, values: str) -> DataFrame:
    return matrix.select(F.transform(values, lambda x: x.cast("double")).alias("v"))


def gram(matrix: DataFrame, values: str, samples: int, centred: bool = True) -> np.ndarray:
    """Sums over rows of products of samples' values, each row centred over the samples if asked.

    The matrix is read once. A task adds up the products of its rows, batch by batch, and passes on
    a row for each pair of samples; Spark sums these.
    """
    upper = np.triu_indices(samples)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((samples, samples))
        for batch in batches:
            for x in _dense(batch.column(0), samples, centred):
                total += x.T @ x
        columns = [pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(total[upper])]
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", "g"])

    out = np.zeros((samples, samples))
    for r in _rows(matrix, values).mapInArrow(products, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["g"]
    return out


def times(matrix: DataFrame, values: str, samples: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function that multiplies the products of :func:`gram`, which are not made, with a few vectors (samples x p).

    A call is one scan: a task adds up its rows' outer products with what the vectors make of them, and Spark sums by sample.
    """
    spark, rows = matrix.sparkSession, _rows(matrix, values)

    def product(vectors: np.ndarray) -> np.ndarray:
        width, sent = vectors.shape[1], spark.sparkContext.broadcast(vectors)  # samples x p numbers
        names = [f"y{j}" for j in range(width)]

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros((samples, width)), False
            for batch in batches:
                for x in _dense(batch.column(0), samples, True):
                    total += x.T @ (x @ sent.value)
                    seen = True
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(samples)), *(pa.array(c.copy()) for c in total.T)], ["i", *names])

        summed = rows.mapInArrow(part, "i long, " + ", ".join(f"{c} double" for c in names)).groupBy("i").agg(*[F.sum(c).alias(c) for c in names])
        out = np.zeros((samples, width))
        got = summed.toPandas()  # a row a sample
        out[got["i"].to_numpy()] = got[names].to_numpy()
        sent.destroy()
        return out

    return product


def leading(product: Callable[[np.ndarray], np.ndarray], samples: int, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, downwards, and their vectors, of a symmetric matrix known by its products with vectors.

    Blocks of a Krylov space are made orthogonal to all before them; after each, the best approximations
    within the space are exact up to their residuals, which end the steps. An eigenvalue that is repeated
    more often than a block is wide is found fewer times.
    """
    width = min(samples, wanted + EXTRA)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((samples, width)))[0]
    basis, image = np.zeros((samples, 0)), np.zeros((samples, 0))
    for _ in range(STEPS):
        block = block[:, : samples - basis.shape[1]]
        basis, image = np.hstack([basis, block]), np.hstack([image, product(block)])
        inside = basis.T @ image
        size, mix = np.linalg.eigh((inside + inside.T) / 2)
        size, mix = size[::-1][:wanted], mix[:, ::-1][:, :wanted]
        vectors = basis @ mix
        error = np.linalg.norm(image @ mix - vectors * size, axis=0).max()
        if error <= TOLERANCE * max(size[0], 1e-300) or basis.shape[1] == samples:
            break
        block = image[:, -block.shape[1] :]
        for _again in range(2):  # once leaves rounding errors behind
            block = np.linalg.qr(block - basis @ (basis.T @ block))[0]
    return size, vectors


@dataclass
class Components:
    scores: np.ndarray  # samples x dimensions
    variance: np.ndarray  # of all components, padded with zeros to the number of samples; or only of the scores'
    ratio: np.ndarray


def _signed(scores: np.ndarray) -> np.ndarray:
    """A component's largest score in absolute value is positive."""
    sign = np.sign(scores[np.abs(scores).argmax(axis=0), np.arange(scores.shape[1])])
    return scores * np.where(sign == 0, 1, sign)


def pca_by_products(matrix: DataFrame, values: str, samples: int, dimensions: int = 2) -> Components:
    """The leading components without the samples' products: for many samples, with variances of these components alone."""
    total = _rows(matrix, values).select(F.array_size("v").alias("n"), "v").agg(
        F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) - F.pow(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), F.lit(2)) / F.col("n"))
    ).first()[0] or 0.0
    size, vectors = leading(times(matrix, values, samples), samples, dimensions)
    size = np.clip(size, 0, None)
    return Components(_signed(vectors * np.sqrt(size)), size / (samples - 1), size / total if total else size)


def pca(matrix: DataFrame, values: str, samples: int, dimensions: int = 2) -> Components:
    """Principal components of samples. A component's largest score in absolute value is positive.

    Beyond ``GRAM_SAMPLES`` samples only the variances of the components asked for are worked out.

    The covariance of features and the singular values of the matrix give the same components, so
    there is one way to compute them.
    """
    if not 1 <= dimensions < samples:
        raise ValueError(f"dimensions must be at least 1 and below {samples}")
    if samples > GRAM_SAMPLES:
        return pca_by_products(matrix, values, samples, dimensions)
    g = gram(matrix, values, samples)
    # rows are centred over samples, so the samples' mean is the origin
    size, vectors = np.linalg.eigh(g)
    size, vectors = np.clip(size[::-1], 0, None), vectors[:, ::-1]
    size[size < 1e-12 * max(size[0], 1e-300)] = 0.0
    scores = vectors[:, :dimensions] * np.sqrt(size[:dimensions])
    variance = size / (samples - 1)
    return Components(_signed(scores), variance, variance / variance.sum() if variance.sum() else variance)


def distances(matrix: DataFrame, values: str, samples: int) -> np.ndarray:
    """Euclidean distances between samples."""
    g = gram(matrix, values, samples)
    d = np.diag(g)
    return np.sqrt(np.clip(d[:, None] + d[None] - 2 * g, 0, None))


def _curve(spread: float, min_dist: float) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^2b) closest to a step at ``min_dist`` that decays with ``spread``, by Gauss-Newton."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    theta = np.array([0.0, 0.0])  # logarithms of a and b
    damp = 1e-2
    residual = lambda t: 1 / (1 + np.exp(t[0]) * x ** (2 * np.exp(t[1]))) - y
    for _ in range(200):
        r = residual(theta)
        a, b = np.exp(theta)
        p = x ** (2 * b)
        slope = -1 / (1 + a * p) ** 2
        jac = np.stack([slope * a * p, slope * a * p * 2 * b * np.log(x)], axis=1)
        step = np.linalg.solve(jac.T @ jac + damp * np.eye(2), -jac.T @ r)
        if (residual(theta + step) ** 2).sum() < (r**2).sum():
            theta, damp = theta + step, damp / 3
        else:
            damp *= 4
    return float(np.exp(theta[0])), float(np.exp(theta[1]))


@dataclass
class UmapOptions:
    local_connectivity: float = 1.0
    bandwidth: float = 1.0
    mix_ratio: float = 1.0
    spread: float = 1.0
    min_dist: float = 0.01
    a: float = 0.0
    b: float = 0.0
    repulsion_strength: float = 1.0
    initialize: str = "spectral"  # spectral, spectral-only, random, none
    num_neighbors: int = 15
    num_epochs: int = -1
    learning_rate: float = 1.0
    negative_sample_rate: float = 5.0
    seed: int = 1_234_567_890
    parallel_optimization: int = 0  # accepted, without effect


def _memberships(d: np.ndarray, o: UmapOptions) -> np.ndarray:
    """Fuzzy neighbourhood weights from distances, symmetrised."""
    n = len(d)
    k = max(1, min(o.num_neighbors, n - 1))
    order = np.argsort(d + np.where(np.eye(n, dtype=bool), -1.0, 0.0), axis=1)[:, 1 : k + 1]
    near = np.take_along_axis(d, order, 1)
    w = np.zeros((n, n))
    for i in range(n):
        positive = near[i][near[i] > 0]
        whole = int(o.local_connectivity)
        rho = 0.0
        if len(positive) >= o.local_connectivity and whole:
            rho = positive[whole - 1]
            if whole < len(positive):
                rho += (o.local_connectivity - whole) * (positive[whole] - positive[whole - 1])
        elif len(positive):
            rho = positive.max()
        low, high, target = 0.0, math.inf, math.log2(k + 1) * o.bandwidth
        sigma = 1.0
        for _ in range(64):
            total = np.exp(-np.clip(near[i] - rho, 0, None) / sigma).sum()
            if abs(total - target) < 1e-6:
                break
            low, high = (low, sigma) if total > target else (sigma, high)
            sigma = (low + high) / 2 if high < math.inf else 2 * sigma
        w[i, order[i]] = np.exp(-np.clip(near[i] - rho, 0, None) / max(sigma, 1e-12))
    both = w * w.T
    return o.mix_ratio * (w + w.T - both) + (1 - o.mix_ratio) * both


def umap(matrix: DataFrame, values: str, samples: int, dimensions: int = 2, options: UmapOptions | None = None) -> np.ndarray:
    """UMAP coordinates of samples (samples x dimensions); the same for the same seed."""
    if not 1 <= dimensions < samples:
        raise ValueError(f"dimensions must be at least 1 and below {samples}")
    o = options or UmapOptions()
    w = _memberships(distances(matrix, values, samples), o)
    rng = np.random.default_rng(o.seed)
    at = rng.uniform(-10, 10, (samples, dimensions))
    if o.initialize.startswith("spectral"):
        degree = np.maximum(w.sum(axis=1), 1e-12)
        laplacian = np.eye(samples) - w / np.sqrt(degree[:, None] * degree[None])
        size, vectors = np.linalg.eigh(laplacian)
        if (size < 1e-9).sum() == 1:  # one connected graph
            at = vectors[:, 1 : dimensions + 1]
            at = at / np.abs(at).max() * 10 + rng.normal(0, 1e-4, at.shape)
        elif o.initialize == "spectral-only":
            raise ValueError("the neighbourhood graph falls apart: no spectral start")
    elif o.initialize == "none":
        at = np.zeros((samples, dimensions))
    a, b = (o.a, o.b) if o.a > 0 and o.b > 0 else _curve(o.spread, o.min_dist)
    epochs = o.num_epochs if o.num_epochs > 0 else 500
    i, j = np.nonzero(np.triu(w, 1) >= w.max() / epochs)
    every = w.max() / w[i, j]  # an edge takes part every so many epochs
    due = every.copy()
    for epoch in range(1, epochs + 1):
        rate = o.learning_rate * (1 - epoch / epochs)
        for e in np.flatnonzero(due <= epoch):
            due[e] += every[e]
            for s, t in ((i[e], j[e]), (j[e], i[e])):
                diff = at[s] - at[t]
                d2 = float(diff @ diff)
                if d2 > 0:
                    pull = -2 * a * b * d2 ** (b - 1) / (1 + a * d2**b)
                    at[s] += rate * np.clip(pull * diff, -4, 4)
                for r in rng.integers(0, samples, round(o.negative_sample_rate)):
                    if r == s:
                        continue
                    diff = at[s] - at[r]
                    d2 = float(diff @ diff)
                    push = 2 * o.repulsion_strength * b / ((0.001 + d2) * (1 + a * d2**b))
                    at[s] += rate * (np.clip(push * diff, -4, 4) if d2 > 0 else 4.0)
    return at


def table(spark: SparkSession, rows: np.ndarray, first: str, names: list[str], columns: list[str]) -> DataFrame:
    """A small result as a DataFrame: a name in the first column, then one double per column."""
    schema = f"`{first}` string, " + ", ".join(f"`{c}` double" for c in columns)
    return spark.createDataFrame([(n, *map(float, r)) for n, r in zip(names, rows, strict=True)], schema)


def coordinates_table(spark: SparkSession, scores: np.ndarray, prefix: str, samples: list[str]) -> DataFrame:
    """Rows ``<prefix>1..d``, a column per sample."""
    return table(spark, scores.T, "Dimension", [f"{prefix}{i + 1}" for i in range(scores.shape[1])], samples)


def variance_table(spark: SparkSession, found: Components, features: int) -> DataFrame:
    """Variance and its ratio of the first min(samples, features) components, zeros beyond; of those found, where these are not all."""
    n = len(found.variance)
    keep = np.arange(n) < min(n, features)
    rows = np.stack([found.variance * keep, found.ratio * keep])
    return table(spark, rows, "Property", ["variance", "variance_ratio"], [f"D{i}" for i in range(n)])
