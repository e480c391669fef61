"""K-mer counts over a growing folder of reads, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators.matrix import count, extract
from seqloom.sources.scratch import remove


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """``(sample, seq)`` from Parquet files that appear in ``folder``."""
    return spark.readStream.schema("sample string, seq string").option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def running_counts(reads: DataFrame, k: int, canonical: bool = True) -> DataFrame:
    """``(sample, kmer, n)`` so far; state is one counter per sample and k-mer."""
    return count(extract(reads, k, canonical))


def windowed_counts(reads: DataFrame, time: str, k: int, window: str, late: str, canonical: bool = True) -> DataFrame:
    """Counts per event-time window; rows later than ``late`` are left out and their state goes."""
    found = extract(reads.withWatermark(time, late), k, canonical, ("sample", time))
    return found.groupBy(F.window(time, window).alias("window"), "sample", "kmer").agg(F.count(F.lit(1)).alias("n"))


def start_windows(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each window's counts to ``path`` once the watermark has passed it; its state goes then."""
    return counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()


def start(counts: DataFrame, path: str, checkpoint: str, compact: int = 20) -> StreamingQuery:
    """Keep running counts in ``path``; :func:`current_counts` reads them at any time.

    A batch writes the counts that it changed into a folder of its own number, so its bytes follow the new
    reads, not the state, and a batch that is replayed after a failure writes the same folder again.
    Every ``compact`` batches the counts so far become one table. What it stands for is deleted when
    the next one is complete, so a reader that began before loses nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/delta-{number:012d}")
        if (number + 1) % compact == 0:
            _compact(batch.sparkSession, path, number)

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(apply).start()


def _folders(spark: SparkSession, path: str) -> list[tuple[str, int, str]]:
    """(kind, batch number, folder) of what has been written completely."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for status in fs.listStatus(root) if fs.exists(root) else []:
        kind, _, number = status.getPath().getName().partition("-")
        if kind in ("base", "delta") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            out.append((kind, int(number), f"{path}/{status.getPath().getName()}"))
    return sorted(out)


def _state(spark: SparkSession, folders: list[tuple[str, int, str]], below: float) -> DataFrame:
    """The latest count of each key in the last base table before batch ``below`` and the deltas after it."""
    base = max((n for kind, n, _ in folders if kind == "base" and n < below), default=-1)
    wanted = [p for kind, n, p in folders if (kind == "base" and n == base) or (kind == "delta" and n > base)]
    if not wanted:
        return spark.createDataFrame([], "sample string, kmer string, n long")
    # counts of a key only grow, so the latest is the largest
    return spark.read.schema("sample string, kmer string, n long").parquet(*wanted).groupBy("sample", "kmer").agg(F.max("n").alias("n"))


def current_counts(spark: SparkSession, path: str) -> DataFrame:
    """``(sample, kmer, n)`` as of the last complete batch that :func:`start` has written to ``path``; none before the first."""
    return _state(spark, _folders(spark, path), float("inf"))


def _compact(spark: SparkSession, path: str, number: int) -> None:
    folders = _folders(spark, path)
    _state(spark, [f for f in folders if f[1] <= number], number).write.mode("overwrite").parquet(f"{path}/base-{number:012d}")
    before = max((n for kind, n, _ in folders if kind == "base" and n < number), default=-1)
    for kind, n, folder in folders:  # what the base table before this one stands for
        if n < before or (n == before and kind == "delta"):
            remove(spark, folder)
