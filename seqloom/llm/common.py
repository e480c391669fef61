"""Shared pieces of the training-data operators: scratch tables, folds, bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.sources.scratch import discard, materialize, remove, scratch_path, shared_dir  # noqa: F401

#: A word is a run of characters outside the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; decides folds. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def hash_fraction(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, max_rows: int, seed: int, modulus: int = 1, held_out: int | None = None
) -> DataFrame:
    """A scratch table (doc_id, text, label) of at most about ``max_rows`` training documents, one row per doc_id.

    Only documents whose id remainder differs from ``held_out`` take part. The sample is drawn by
    a seeded hash of doc_id, so it does not depend on the layout of the files. Ids with several
    labels take their mean; ids with several texts take the smallest text; null ids and labels go.
    The drawn ids are broadcast, being about ``max_rows`` at most, so texts of other documents are
    never shuffled.
    """
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("double").alias("label")).where(
        F.col("label").isNotNull() & F.col("doc_id").isNotNull()
    )
    if held_out is not None:
        known = known.where(id_remainder(F.col("doc_id"), modulus) != held_out)
    share = min(1.0, max_rows / max(1, known.count()))
    drawn = known.where(hash_fraction(seed, F.col("doc_id").cast("string")) < share)
    marks = materialize(drawn.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label")), "sample-ids")
    few = marks.count() <= 2 * max_rows
    texts = docs.select("doc_id", "text").join(F.broadcast(marks) if few else marks, "doc_id")
    sample = texts.groupBy("doc_id").agg(F.min(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"), F.first("label").alias("label"))
    out = materialize(sample, "sample")
    discard(marks)
    return out


def slices(sizes: np.ndarray, most_rows: int, most_bytes: int) -> Iterator[tuple[int, int]]:
    """(first, rows) of consecutive slices of at most ``most_rows`` rows and, unless a row alone is larger, ``most_bytes`` bytes."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        end = min(at + most_rows, max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right"))))
        yield at, min(end, len(sizes)) - at
        at = end


def map_texts(
    docs: DataFrame, keep: list[str] | None, score: Callable[[list[str | None]], list[pa.Array]], added: str,
    slice_rows: int = 1000, slice_bytes: int = 4 << 20, done: Callable[[], None] | None = None,
) -> DataFrame:
    """Whole texts through a Python function, in Arrow batches, without a shuffle.

    Returns a column ``rec`` that holds the columns ``keep`` of ``docs`` (all if None) as a struct,
    so that no name can clash, and beside it the columns of the DDL string ``added``. The function
    gets slices of a batch, bounded in rows and bytes; its answers must not depend on the slice. ``done``
    is called at a task's end, as what a function keeps would stay in the worker beside later tasks.
    """
    names = docs.columns if keep is None else keep
    rec = F.struct(*[F.col(f"`{c}`") for c in names]).alias("rec")
    # a text that is in the struct does not travel twice
    within = names.index("text") if names.count("text") == 1 and docs.schema["text"].dataType == T.StringType() else None
    packed = docs.select(rec) if within is not None else docs.select(rec, F.col("text").cast("string").alias("text"))
    schema = T.StructType([packed.schema["rec"], *T.StructType.fromDDL(added).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1) if within is None else batch.column(0).field(within)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for at, rows in slices(sizes, slice_rows, slice_bytes):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), *score(texts.slice(at, rows).to_pylist())], schema.names)
        if done is not None:
            done()

    return packed.mapInArrow(run, schema)
