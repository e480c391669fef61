"""Input files: sample manifests, sequence files, k-mer lists and phenotypes.

Manifests and phenotypes have a line per sample and are read on the driver; sequence files are read
by Spark, in parallel and by byte ranges wherever the file is not compressed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bases after which a piece of a long record ends.
PIECE = 1 << 20
#: Bytes for each core up to which a scan is dealt out evenly.
SMALL = 32 << 20


@dataclass(frozen=True)
class Sample:
    name: str
    paths: tuple[str, ...]


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a file scan dealt out evenly, where the scan would keep part of the session idle.

    A compressed file, and a row group of Parquet, are read by one task, however many there are. So a
    scan of fewer parts than the session works on at once, or of less than ``SMALL`` bytes for each
    of them, is dealt out; a large table is left alone.
    """
    wanted = rows.sparkSession.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(wanted) if size < wanted * SMALL or rows.rdd.getNumPartitions() < wanted else rows


def _lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of a small text file, in order."""
    text = spark.read.text(path, wholetext=True).collect()
    return [line for r in text for line in r["value"].splitlines()]


def manifest(spark: SparkSession, path: str) -> list[Sample]:
    """``name path [path ...]`` a line; a single word is both; blank lines are skipped.

    Duplicate names, unreadable files and an empty manifest are errors.
    """
    out: dict[str, Sample] = {}
    for line in _lines(spark, path):
        words = line.split()
        if not words:
            continue
        name, paths = words[0], tuple(words[1:] or words[:1])
        if name in out:
            raise ValueError(f"sample {name!r} is listed twice")
        for p in paths:
            where = spark._jvm.org.apache.hadoop.fs.Path(p)
            if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
                raise FileNotFoundError(f"sample {name!r}: no file {p}")
        out[name] = Sample(name, paths)
    if not out:
        raise ValueError(f"no samples in {path}")
    return list(out.values())


def _fastq(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Second lines of four-line records.

    A record begins with '@' and its third line with '+', but '@' may begin a quality line as well.
    So files are split at '\\n@': a chunk whose third line begins with '+' is a record's beginning
    (a quality line's chunk lacks one), wherever the file was cut into ranges.
    """
    chunks = _located(spark.read.option("lineSep", "\n@").text(list(paths)))
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    return chunks.select("file", lines.alias("l")).where(F.get("l", F.lit(2)).startswith("+")).select("file", F.get("l", F.lit(1)).alias("seq"))


def _fasta(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines that are no header."""
    lines = _located(spark.read.text(list(paths)))
    return lines.where(~F.col("value").startswith(">") & (F.trim("value") != "")).select("file", F.trim("value").alias("seq"))


def _multi_fasta(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Sequence lines of each record joined, so that k-mers cross line ends."""
    records = _located(spark.read.option("lineSep", ">").text(list(paths))).where(F.trim("value") != "")
    joined = records.select("file", F.regexp_replace(F.regexp_replace("value", r"^[^\n]*(\n|$)", ""), r"\s", "").alias("seq"))
    return joined.where("seq <> ''")


class _Range:
    """Lines of one byte range of a multi-line FASTA file, joined into pieces that overlap by k - 1 bases."""

    def __init__(self, file: str, start: int, k: int):
        self.file, self.start, self.k = file, start, k
        self.head, self.tail, self.parts, self.size, self.ended = "", "", [], 0, False

    def _joined(self) -> str:
        return "".join(self.parts)

    def line(self, line: str) -> str | None:
        """A piece that the line completes, if any."""
        if line.startswith(">"):
            piece = self._joined()
            self.parts, self.size, self.tail = [], 0, ""
            self.ended = True
            return piece
        line = "".join(line.split())
        lap = self.k - 1
        if not self.ended and len(self.head) < lap:  # the record that the range before began
            self.head += line[: lap - len(self.head)]
        self.tail = (self.tail + line)[-lap:] if lap else ""
        self.parts.append(line)
        self.size += len(line)
        if self.size < PIECE + lap:
            return None
        piece = self._joined()
        rest = piece[len(piece) - lap :] if lap else ""
        self.parts, self.size = [rest], len(rest)
        return piece

    def close(self) -> tuple[str, tuple]:
        """The last piece, and what ranges beside this one need: its first and last bases, and whether a record ends in it."""
        return self._joined(), (self.file, self.start, None, self.head, self.tail, self.ended)


RANGE = "file string, start long, seq string, head string, tail string, ended boolean"


def _ranges(k: int):
    """mapInArrow function: lines (file, start, value) in order -> pieces ``seq``, and a row of seams for each range."""
    names = [c.split()[0] for c in RANGE.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, size = None, [], 0

        def taken() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
            out.clear()
            return rows

        def add(piece: str | None) -> None:
            if piece and len(piece) >= k:
                out.append((now.file, now.start, piece, None, None, None))

        for batch in batches:
            for file, start, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if now is None or (file, start) != (now.file, now.start):
                    if now is not None:
                        last, seam = now.close()
                        add(last)
                        out.append(seam)
                    now = _Range(file, start, k)
                add(now.line(value))
                size += len(value)
                if size >= 4 * PIECE and out:
                    yield taken()
                    size = 0
        if now is not None:
            last, seam = now.close()
            add(last)
            out.append(seam)
            yield taken()

    return run


def _seams(k: int):
    """mapInArrow function: seams sorted by file and start -> ``(file, seq)`` of the bases around each border."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, carry, lap = None, "", k - 1
        for batch in batches:
            out = []
            for name, _, _, head, tail, ended in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if name != file:
                    file, carry = name, ""
                if len(carry) + len(head) >= k:
                    out.append((file, carry + head))
                # a range shorter than k - 1 bases without an end hands on what came before it as well
                carry = tail if ended or len(tail) >= lap else (carry + tail)[-lap:]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["file", "seq"])

    return run


def _located(df: DataFrame) -> DataFrame:
    return df.select(F.col("_metadata.file_path").alias("file"), "value")


def _cut_multi_fasta(spark: SparkSession, paths: Sequence[str], k: int) -> DataFrame:
    """``(file, seq)``: pieces of records of any length that together have each window of k bases once.

    Files are read by lines, in byte ranges, so a record may be longer than a range or a task's memory. Windows
    across the border of two ranges come from the last and first k - 1 bases of both, k - 1 at most for each range.
    """
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    cut = lines.mapInArrow(_ranges(k), RANGE)
    inside = cut.where("seq is not null").select("file", "seq")
    if k == 1:
        return inside
    borders = cut.where("seq is null").repartition("file").sortWithinPartitions("file", "start")
    return inside.unionByName(borders.mapInArrow(_seams(k), "file string, seq string"))


LOCATED = {"fq": _fastq, "fa": _fasta, "mf": _multi_fasta}


def sequences(spark: SparkSession, paths: Sequence[str], fmt: str = "fq") -> DataFrame:
    """``(seq)`` of FASTQ (``fq``), FASTA (``fa``) or multi-line FASTA (``mf``) files, gzipped or not, a row per record or line."""
    return LOCATED[fmt](spark, paths).select("seq")


def _files(spark: SparkSession, path: str) -> list[str]:
    """The data files that a file, folder or pattern stands for, as a scan names them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out, found = [], fs.globStatus(where)
    for status in found or []:
        if status.isFile():
            out.append(status.getPath().toUri().toString())
        else:
            out += [s.getPath().toUri().toString() for s in fs.listStatus(status.getPath()) if s.isFile() and s.getPath().getName()[0] not in "_."]
    return out


def reads(spark: SparkSession, samples: Sequence[Sample], fmt: str = "fq", k: int | None = None) -> DataFrame:
    """``(sample, seq)`` of all samples, from one scan of all their files; a file may belong to several samples.

    With ``k`` records of multi-line FASTA come in pieces that overlap by k - 1 bases, otherwise whole.
    """
    paths = list(dict.fromkeys(p for s in samples for p in s.paths))
    of_file = [(f, s.name) for s in samples for p in s.paths for f in _files(spark, p)]  # as long as the manifest's list of files
    if fmt == "mf" and k is not None:
        found = _cut_multi_fasta(spark, paths, k)
    else:
        found = LOCATED[fmt](spark, paths)
    # a local file is spelled with one slash or with three
    one_slash = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    table = spark.createDataFrame(of_file, "file string, sample string").select(one_slash("file").alias("file"), "sample")
    return spread(found.withColumn("file", one_slash("file")).join(F.broadcast(table), "file").select("sample", "seq"))


def filter_sequences(spark: SparkSession, path: str, k: int) -> DataFrame:
    """``(seq)`` of a filter file: multi-line FASTA if its first non-blank line begins with '>', else words of exactly k."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    if first and first[0]["value"].lstrip().startswith(">"):
        return _cut_multi_fasta(spark, [path], k).select("seq")
    words = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("seq")).where("seq <> ''")
    wrong = F.raise_error(F.concat(F.lit(f"not of length {k}: "), F.col("seq"))).cast("string")
    return words.select(F.when(F.length("seq") == k, F.col("seq")).otherwise(wrong).alias("seq"))


def numeric_phenotype(spark: SparkSession, path: str, samples: int) -> list[float]:
    """A number per sample, separated by white space."""
    words = " ".join(_lines(spark, path)).split()
    try:
        values = [float(w) for w in words]
    except ValueError as e:
        raise ValueError(f"{path}: {e}") from None
    if len(values) != samples:
        raise ValueError(f"{path}: {len(values)} values for {samples} samples")
    return values


def class_ids(labels: Sequence[str]) -> list[int]:
    """Labels as class numbers in order of first appearance; labels that are all digits must be 0..C-1 and stand for themselves."""
    order = list(dict.fromkeys(labels))
    if len(order) < 2:
        raise ValueError("at least two classes are needed")
    if all(x.isdigit() for x in order):
        if sorted(int(x) for x in order) != list(range(len(order))):
            raise ValueError("numeric classes must be 0, 1, ... without gaps")
        return [int(x) for x in labels]
    return [order.index(x) for x in labels]


def class_phenotype(spark: SparkSession, path: str, samples: int) -> list[int]:
    """A label per sample, separated by white space, as class numbers."""
    words = " ".join(_lines(spark, path)).split()
    if len(words) != samples:
        raise ValueError(f"{path}: {len(words)} labels for {samples} samples")
    return class_ids(words)
