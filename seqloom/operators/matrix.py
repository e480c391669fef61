"""The count matrix: k-mer counting, merging of samples, cutoffs and filters.

A matrix is a DataFrame ``(kmer STRING, counts ARRAY<BIGINT>)`` with one slot per sample, zero where
the sample lacks the k-mer. Merging N samples is not N joins: rows of all samples are grouped by
k-mer once. :func:`of_reads` makes a matrix from reads, with k-mers as integers until the end;
:func:`extract`, :func:`count` and :func:`merge` do it with a row of text per window, for streams and
for keys that are no k-mers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import kmers, packed
from seqloom.operators import counting
from seqloom.operators.counting import WIDE, at_least, cut
from seqloom.sources.scratch import materialize


def extract(reads: DataFrame, k: int, canonical: bool = True, keep: Sequence[str] = ("sample",)) -> DataFrame:
    """``reads(sample, seq)`` -> ``(sample, kmer)``, a row per window of k bases; null and short sequences give none.

    ``keep`` names the columns carried along in place of ``sample``.
    """
    pieces = F.flatten(F.transform(kmers.runs(F.col("seq"), k), lambda run: kmers.pieces(run, k, canonical)))
    parts = reads.select(*keep, F.inline(pieces))  # null sequences have none
    # windows are cut in generated code, a row each; a function over an array would be interpreted
    piece, at = F.col("piece"), F.col("at")
    places = parts.select("*", F.explode(kmers.starts(piece, k)).alias("at"))
    cut = kmers.canonical_window(piece, F.col("other"), at, k) if canonical else kmers.window(piece, at, k)
    return places.select(*keep, cut.cast("string").alias("kmer"))


def count(extracted: DataFrame) -> DataFrame:
    """``(sample, kmer)`` -> ``(sample, kmer, n)``."""
    return extracted.groupBy("sample", "kmer").agg(F.count(F.lit(1)).alias("n"))


def merge(
    extracted: DataFrame, samples: Sequence[str], ci: int = 1, cx: int = 4_000_000_000, cs: int = 65_535, key: str = "kmer", partitions: int | None = None
) -> DataFrame:
    """``(sample, kmer)`` occurrences -> matrix over ``samples``, without rows that no sample holds after the cutoffs.

    Rows of samples not listed are left out. ``partitions`` sets the number of shuffle partitions
    (else the session's).
    """
    if partitions:
        extracted = extracted.repartition(partitions, key)
    if len(samples) <= WIDE:
        counted = extracted.groupBy(key).agg(*[F.count_if(F.col("sample") == s).alias(f"c{i}") for i, s in enumerate(samples)])
        cells = [cut(F.col(f"c{i}"), ci, cx, cs) for i in range(len(samples))]
        matrix = counted.select(key, F.array(*cells).alias("counts"))
    else:
        place = F.element_at(F.create_map(*[x for i, s in enumerate(samples) for x in (F.lit(s), F.lit(i))]), F.col("sample"))
        counted = extracted.groupBy(key, "sample").agg(F.count(F.lit(1)).alias("n")).select(key, place.alias("i"), cut(F.col("n"), ci, cx, cs).alias("n"))
        listed = counted.where("i is not null").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("m"))
        every = F.sequence(F.lit(0), F.lit(len(samples) - 1))
        matrix = listed.select(key, F.transform(every, lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("counts"))
    return matrix.where(F.exists("counts", lambda c: c > 0))


def filter_rows(matrix: DataFrame, threshold: int = 1, ratio: float = 0.0, keep: DataFrame | None = None, drop: DataFrame | None = None) -> DataFrame:
    """Rows that pass the threshold, are in the set ``keep(kmer)`` if given, and not in ``drop(kmer)``."""
    if ratio > 0:
        matrix = matrix.where(at_least(F.col("counts"), threshold, ratio))
    if keep is not None:
        matrix = matrix.join(keep.select("kmer"), "kmer", "left_semi")
    if drop is not None:
        matrix = matrix.join(drop.select("kmer"), "kmer", "left_anti")
    return matrix


def packed_set(sequences: DataFrame, k: int, canonical: bool = True, cx: int = 4_000_000_000, codes: np.ndarray = packed.DNA) -> DataFrame:
    """Different k-mers of ``sequences(seq)`` as integers ``(w0, ...)``, for filters; those above ``cx`` do not count."""
    return counting.packed_set(sequences, k, canonical, cx, codes)


def kmer_set(sequences: DataFrame, k: int, canonical: bool = True, cx: int = 4_000_000_000) -> DataFrame:
    """The same as text, ``(kmer)``."""
    return packed_set(sequences, k, canonical, cx).select(packed.text(k).alias("kmer"))


def of_reads(
    reads: DataFrame, samples: Sequence[str], k: int, canonical: bool = True, ci: int = 1, cx: int = 4_000_000_000, cs: int = 65_535,
    keep: DataFrame | None = None, drop: DataFrame | None = None, hot: int = counting.HOT, partitions: int | None = None,
    threshold: int = 1, ratio: float = 0.0, codes: np.ndarray = packed.DNA,
) -> DataFrame:
    """``reads(sample, seq)`` -> matrix over ``samples``, without rows that no sample holds after the cutoffs.

    ``keep`` and ``drop`` are sets of :func:`packed_set`. Occurrences outside ``keep`` go before the exchange,
    as far as a Bloom filter tells them, the rest in a semi-join behind it; no k-mer of the set is lost.
    ``threshold`` and ``ratio`` are those of :func:`filter_rows`, held where k-mers are counted; ``codes`` says what bytes
    other than A, C, G and T stand for (:func:`packed.alphabet`).
    """
    keys = packed.columns(k)
    if keep is not None:
        keep = materialize(keep.select(*keys), "filter-set")  # read to build the filter, and to join
        found = counting.bloom_filter(keep, k)
    bloom = reads.sparkSession.sparkContext.broadcast(found) if keep is not None and found is not None else None
    matrix = counting.packed_matrix(reads, samples, k, canonical, bloom, ci, cx, cs, hot, partitions, threshold, ratio, codes)
    if keep is not None:
        matrix = matrix.join(keep, keys, "left_semi")
    if drop is not None:
        matrix = matrix.join(drop.select(*keys), keys, "left_anti")
    return matrix.select(packed.text(k).alias("kmer"), "counts")


def count_reads(reads: DataFrame, samples: Sequence[str], k: int, canonical: bool = True) -> DataFrame:
    """``reads(sample, seq)`` -> ``(sample, kmer, n)`` of the listed samples."""
    counted = counting.packed_counts(reads, samples, k, canonical)
    name = F.element_at(F.array(*[F.lit(s) for s in samples]), (F.col("i") + 1).cast("int"))
    return counted.select(name.alias("sample"), packed.text(k).alias("kmer"), "n")


def totals(matrix: DataFrame, samples: Sequence[str]) -> DataFrame:
    """One row: the sum of each sample's counts over the rows of the matrix."""
    return matrix.agg(*[F.coalesce(F.sum(F.col("counts")[i]), F.lit(0)).cast("long").alias(s) for i, s in enumerate(samples)])


def size_and_totals(matrix: DataFrame, samples: Sequence[str]) -> tuple[int, list[int]]:
    """The number of rows and each sample's sum, in one pass."""
    n, *sums = matrix.agg(F.count(F.lit(1)), *[F.sum(F.col("counts")[i]) for i in range(len(samples))]).first()
    return n, [s or 0 for s in sums]


def wide(matrix: DataFrame, values: str, names: Sequence[str], *keep: str) -> DataFrame:
    """The array column as one column per sample."""
    return matrix.select(*keep, *[F.col(values)[i].alias(n) for i, n in enumerate(names)])


def intervals(matrix: DataFrame, column: Column, splits: Sequence[float], *keep: str) -> DataFrame:
    """Histogram of a column over the intervals between split points: ``(*keep, bin, n)``; bin 0 is below the first."""
    bin_ = sum((F.when(column >= s, 1).otherwise(0) for s in splits), F.lit(0))
    return matrix.groupBy(*keep, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
