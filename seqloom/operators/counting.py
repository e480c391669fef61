"""Counting k-mers of reads: packed integers, super-k-mers through the exchange, early set filters.

Up to ``SHORT`` bases there are few different k-mers, so tasks count them before the shuffle. Longer
k-mers hardly repeat inside a task. Neighbouring windows share most of their bases, though, and
mostly the smallest m-mer too, whichever strand is read: a run of windows with one minimizer travels as one
packed sequence, is cut into k-mers behind the exchange, and all occurrences of a k-mer are there.
Runs of a task whose minimizers fall into one bucket travel as one row, so that rows are few.

A minimizer that holds too many windows for a task is split: its windows travel by themselves, counted
in the task before, in the bucket of the whole k-mer.

A filter set is tested before the exchange by a Bloom filter, which Spark builds from the set; what it
lets through by mistake goes in an exact semi-join behind the count. A set too large for a filter of
bounded size is joined only there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import packed

#: Longest k-mers that are counted before the shuffle.
SHORT = 12
#: Up to this many samples the matrix is made in one grouping with a conditional sum a sample.
WIDE = 64
#: Bases of a minimizer.
MINIMIZER = 11
#: Windows of a minimizer above which it is split, and windows that are counted together.
HOT = 1 << 21
CHUNK = 1 << 19
#: Windows in one run at most.
LONGEST = 64
#: Buckets of minimizers, and as many of split windows (of 16 bits of a hash); the bases whose runs a task gathers into rows, the
#: split windows that it counts together, and the runs of one row at most.
BUCKETS = 1 << 16
GATHERED = 1 << 24
SPLIT = 1 << 21
ROW = 1 << 12
#: Most k-mers that a Bloom filter is made of (32 MB at 16 bits each).
FILTER_KEYS = 1 << 24
#: Cells of the dense matrix in one batch.
CELLS = 1 << 20
#: Cells of all possible k-mers and samples up to which a task counts into one array (32 MB), and the bases it then works on at once.
TABLE = 1 << 22
BASES = 1 << 19


# ---------------------------------------------------------------- Bloom filter


class Bloom:
    """Four bits in one 64-bit word for each key; about 0.5 % of other keys pass at four keys a word."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        mask = np.zeros(len(hashes), np.uint64)
        for shift in (0, 6, 12, 18):
            mask |= np.uint64(1) << (hashes >> np.uint64(shift) & np.uint64(63))
        return (hashes >> np.uint64(24)) % np.uint64(words), mask

    def might_hold(self, hashes: np.ndarray) -> np.ndarray:
        at, mask = self.places(hashes, len(self.bits))
        return self.bits[at] & mask == mask


def bloom_filter(keys: DataFrame, k: int, most: int = FILTER_KEYS) -> Bloom | None:
    """A filter of packed k-mers ``keys(w0, ...)``, or None if there are more than ``most`` of them."""
    n = keys.count()
    if n > most:
        return None
    words = max(1, n // 4)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, mask = Bloom.places(packed.mixed([c.to_numpy(zero_copy_only=False) for c in batch.columns]), words)
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(mask.view(np.int64))], ["at", "mask"])

    rows = keys.select(*packed.columns(k)).mapInArrow(marks, "at long, mask long").groupBy("at").agg(F.expr("bit_or(mask)").alias("mask"))
    bits = np.zeros(words, np.uint64)
    for part in rows.toArrow().to_batches():  # a word each, so bounded by ``most``
        bits[part.column(0).to_numpy()] = part.column(1).to_numpy().view(np.uint64)
    return Bloom(bits)


# ---------------------------------------------------------------- tasks before the exchange


def _stretches(
    batch: pa.RecordBatch, k: int, place: dict[str, int], size: int = packed.SLICE, codes: np.ndarray = packed.DNA
) -> Iterator[tuple[packed.Stretch, np.ndarray]]:
    """Stretches of a batch (sample, seq), with the sample's number for each row; other samples' rows are left out."""
    samples = np.array([place.get(x, -1) for x in batch.column(0).to_pylist()], dtype=np.int64)
    seq = batch.column(1).cast(pa.large_binary())
    if seq.null_count:
        seq = seq.fill_null(b"")
    buffers = seq.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[seq.offset : seq.offset + len(seq) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    if (samples < 0).any():
        listed = np.flatnonzero(samples >= 0)
        pieces = [data[offsets[i] : offsets[i + 1]] for i in listed]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        data, samples = np.concatenate(pieces) if pieces else data[:0], samples[listed]
    offsets, data = packed.without_skipped(offsets, data, codes)
    for s in packed.stretches(offsets, data, k, size, codes):
        yield s, samples


def _kept(s: packed.Stretch, k: int, canonical: bool, bloom: Bloom | None, words: list[np.ndarray] | None = None) -> np.ndarray:
    ok = packed.valid(s, k)
    if bloom is not None:
        words = words or packed.windows(s.codes, k, canonical)
        at = np.flatnonzero(ok)
        ok[at] = bloom.might_hold(packed.mixed([w[at] for w in words]))
    return ok


def _counts(k: int, canonical: bool, place: dict[str, int], bloom, codes: np.ndarray = packed.DNA) -> Callable:
    """mapInArrow function: (sample, seq) -> (w0, ..., i, n), counted over the whole task where there are few cells, else in each slice of a batch."""
    cells = len(place) << 2 * k

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for s, samples in _stretches(batch, k, place, max(BASES, cells), codes):
                words = packed.windows(s.codes, k, canonical)
                ok = np.flatnonzero(_kept(s, k, canonical, bloom and bloom.value, words))
                rows = samples[s.rows[np.searchsorted(s.ends, ok, "right")]]
                total += np.bincount(rows << 2 * k | words[0][ok], minlength=cells)
        at = np.flatnonzero(total)
        for begin in range(0, len(at), CELLS):
            own = at[begin : begin + CELLS]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (own & (1 << 2 * k) - 1, own >> 2 * k, total[own])], [*packed.columns(k), "i", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, samples in _stretches(batch, k, place, codes=codes):
                words = packed.windows(s.codes, k, canonical)
                ok = np.flatnonzero(_kept(s, k, canonical, bloom and bloom.value, words))
                rows = samples[s.rows[np.searchsorted(s.ends, ok, "right")]]
                found, rows, n = packed.tally([w[ok] for w in words], rows)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*found, rows, n)], [*packed.columns(k), "i", "n"])

    return table if cells <= TABLE else run


@dataclass
class _Runs:
    """Runs of windows with one minimizer each in a stretch of sequences, without the split ones, whose k-mers are given by themselves."""

    codes: np.ndarray
    first: np.ndarray
    n: np.ndarray
    bins: np.ndarray
    i: np.ndarray
    words: list[np.ndarray]
    words_i: np.ndarray


def _super(k: int, canonical: bool, place: dict[str, int], bloom, codes: np.ndarray, heavy) -> Callable:
    """Batches (sample, seq) -> runs; minimizers of the sorted array ``heavy`` are split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[_Runs]:
        hot = heavy and heavy.value
        for batch in batches:
            for s, samples in _stretches(batch, k, place, BASES, codes):
                bins = packed.minimizers(s.codes, k, min(MINIMIZER, k))
                first, n, rows = packed.runs(s, bins, _kept(s, k, canonical, bloom and bloom.value), LONGEST)
                own, i = bins[first].astype(np.int64), samples[rows]
                words, words_i = [], i[:0]
                if hot is not None:
                    split = hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own
                    if split.any():
                        many = n[split]
                        at = np.repeat(first[split] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                        words, words_i = [w[at] for w in packed.windows(s.codes, k, canonical)], np.repeat(i[split], many)
                        first, n, own, i = first[~split], n[~split], own[~split], i[~split]
                yield _Runs(s.codes, first, n, own, i, words, words_i)

    return run


def _spelled(words: list[np.ndarray], k: int) -> np.ndarray:
    """The codes of k-mers, one behind the other."""
    return np.concatenate([(w[:, None] >> np.arange(2 * n - 2, -1, -2)) & 3 for w, n in zip(words, packed.sizes(k), strict=True)], axis=1).astype(np.uint8).ravel()


RUN = "i long, bin long, bases int, times long, seq binary"


def _rows_of_runs(k: int, found: Callable) -> Callable:
    """mapInArrow function: (sample, seq) -> a row for each run, and for each different split window of a stretch, with its own hash as bin."""

    def batch_of(i: np.ndarray, bins: np.ndarray, bases: np.ndarray, times: np.ndarray, codes: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        data, offsets = packed.pack_runs(codes, first, bases)
        seq = pa.Array.from_buffers(pa.binary(), len(bases), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(bins), pa.array(bases.astype(np.int32)), pa.array(times), seq], ["i", "bin", "bases", "times", "seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in found(batches):
            if len(r.first):
                yield batch_of(r.i, r.bins, r.n + k - 1, np.ones(len(r.n), np.int64), r.codes, r.first)
            if len(r.words_i):
                words, i, times = packed.tally(r.words, r.words_i)
                yield batch_of(i, packed.mixed(words).view(np.int64), np.full(len(i), k), times, _spelled(words, k), np.arange(len(i)) * k)

    return run


GATHER = "bin long, i binary, n binary, times binary, seq binary"


def _number(samples: int) -> np.dtype:
    """The type of a sample's number in a gathered row."""
    return np.min_scalar_type(max(1, samples) - 1)


def _gathered(k: int, samples: int, found: Callable) -> Callable:
    """mapInArrow function: (sample, seq) -> rows of runs of one bucket: their samples, numbers of windows, times (none: once each) and sequences."""

    def rows(bins: np.ndarray, i: np.ndarray, n: np.ndarray, times: np.ndarray | None, quads: np.ndarray, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(bins, kind="stable")
        for begin in range(0, len(order), GATHERED // 128):
            own = order[begin : begin + GATHERED // 128]
            bucket = bins[own]
            data, offsets = packed.pack_quads(quads, first[own].astype(np.int64), n[own].astype(np.int64) + k - 1)
            begins = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]) | (np.arange(len(own)) % ROW == 0))
            edges = np.append(begins, len(own))
            parts = [(i[own].astype(_number(samples)), edges), (n[own].astype(np.uint8), edges), (np.zeros(0, np.int64) if times is None else times[own], edges if times is not None else 0 * edges)]
            columns = [(part, at * part.itemsize) for part, at in parts] + [(data, offsets[edges])]
            binary = [pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(part)]) for part, at in columns]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[begins].astype(np.int64)), *binary], ["bin", "i", "n", "times", "seq"])

    def run_rows(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        bucket, i, n, quads, first = (np.concatenate(part) for part in zip(*held, strict=True))
        held.clear()
        yield from rows(bucket, i, n, None, quads, first)

    def split_rows(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        words, i, times = packed.tally([np.concatenate(w) for w in zip(*(w for w, _ in held), strict=True)], np.concatenate([i for _, i in held]))
        held.clear()
        bucket = (packed.mixed(words) >> np.uint64(48)).astype(np.int64) + BUCKETS
        for at in range(0, len(i), BASES):
            own = slice(at, at + BASES)
            codes = _spelled([w[own] for w in words], k)
            yield from rows(bucket[own], i[own], np.ones(len(i[own]), np.int64), times[own], packed.quads(codes), np.arange(len(i[own])) * k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bases, split, windows = [], 0, [], 0
        for r in found(batches):
            if len(r.words_i):
                split.append((r.words, r.words_i))
                windows += len(r.words_i)
            if len(r.first):
                bucket = r.bins.astype(np.uint32) * np.uint32(0x9E3779B1) >> 16  # the smallest hashes are mostly small
                held.append((bucket.astype(np.uint16), r.i.astype(_number(samples)), r.n.astype(np.uint8), packed.quads(r.codes), (r.first + bases).astype(np.uint32)))
                bases += len(r.codes)
            if bases >= GATHERED:
                yield from run_rows(held)
                bases = 0
            if windows >= SPLIT:
                yield from split_rows(split)
                windows = 0
        if held:
            yield from run_rows(held)
        if split:
            yield from split_rows(split)

    return run


def _weights(k: int, canonical: bool, place: dict[str, int], bloom, codes: np.ndarray, least: int) -> Callable:
    """mapInArrow function: (sample, seq) -> (bin, n), windows of each minimizer in the whole task, where there are ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 2 * MINIMIZER, np.int64)
        for r in _super(k, canonical, place, bloom, codes, None)(batches):
            np.add.at(total, r.bins, r.n)
        at = np.flatnonzero(total >= least)
        for begin in range(0, len(at), CELLS):
            own = at[begin : begin + CELLS]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["bin", "n"])

    return run


# ---------------------------------------------------------------- tasks behind the exchange


def _cut(batch: pa.RecordBatch, k: int, canonical: bool, samples: int) -> Iterator[tuple]:
    """The k-mers of gathered rows, some rows at a time: their integers, of each window the sample and the times (None: once each), the rows' bins, and where each row's windows begin."""

    def column(c: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        own = batch.column(c)
        buffers = own.buffers()
        offsets = np.frombuffer(buffers[1], np.int32)[own.offset : own.offset + len(own) + 1].astype(np.int64)
        size = np.dtype(kind).itemsize
        data = np.frombuffer(buffers[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        return np.frombuffer(data.tobytes(), kind), (offsets - offsets[0]) // size

    bins = batch.column(0).to_numpy()
    (i, edges), (n, _), (times, times_edges), (seq, seq_edges) = column(1, _number(samples)), column(2, np.uint8), column(3, np.int64), column(4, np.uint8)
    n = n.astype(np.int64)
    before = np.concatenate([[0], np.cumsum(n)])[edges]  # windows before each row
    row = 0
    while row < len(bins):
        end = max(row + 1, int(np.searchsorted(before, before[row] + CHUNK, "right")) - 1)
        low, high = edges[row], edges[end]
        own = n[low:high]
        packed_bytes = (own + k + 2) // 4
        words = packed.run_windows(seq[seq_edges[row] : seq_edges[end]], np.cumsum(packed_bytes) - packed_bytes, own, k, canonical)
        often = None
        if times_edges[end] > times_edges[row]:  # rows with times have one window a run
            often = np.ones(len(own), np.int64)
            often[np.repeat(np.diff(times_edges[row : end + 1]) > 0, np.diff(edges[row : end + 1]))] = times[times_edges[row] : times_edges[end]]
            often = np.repeat(often, own)
        yield words, np.repeat(i[low:high].astype(np.int64), own), often, bins[row:end], before[row:end] - before[row]
        row = end


def _dense(k: int, canonical: bool, samples: int, ci: int, cx: int, cs: int, threshold: int, ratio: float) -> Callable:
    """mapInArrow function: gathered runs sorted by bin -> (w0, ..., counts) of the k-mers that pass.

    Bins are counted whole, some together, at least ``CHUNK`` windows at a time. Only k-mers that pass the threshold get a row of counts.
    """
    names, rows_at_once = [*packed.columns(k), "counts"], max(1, CELLS // max(1, samples))

    def settled(words: list[np.ndarray], i: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        fresh = np.zeros(len(i), bool)
        fresh[:1] = True
        for w in words:
            fresh[1:] |= w[1:] != w[:-1]
        begins = np.flatnonzero(fresh)
        if not len(begins):
            return
        n = np.where((n >= ci) & (n <= cx), np.minimum(n, cs), 0)
        passed = np.maximum.reduceat(n, begins) > 0
        if ratio > 0:  # zeros reach no threshold but one of zero
            passed &= (np.add.reduceat(n >= threshold, begins, dtype=np.int64) / samples if threshold > 0 else 1.0) >= ratio
        lengths = np.diff(np.append(begins, len(i)))
        kept, begins, lengths = np.repeat(passed, lengths), begins[passed], lengths[passed]
        i, n, edges = i[kept], n[kept], np.append(0, np.cumsum(lengths))
        words = [w[begins] for w in words]
        for at in range(0, len(begins), rows_at_once):
            own = lengths[at : at + rows_at_once]
            counts = np.zeros((len(own), samples), np.int64)
            cells = slice(edges[at], edges[at + len(own)])
            counts[np.repeat(np.arange(len(own)), own), i[cells]] = n[cells]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * np.int32(samples)), pa.array(counts.ravel()))
            yield pa.RecordBatch.from_arrays([*(pa.array(w[at : at + len(own)]) for w in words), lists], names)

    def merged(parts: list[tuple]) -> tuple:
        once = all(p[2] is None for p in parts)
        times = None if once else np.concatenate([np.ones(len(p[1]), np.int64) if p[2] is None else p[2] for p in parts])
        return packed.tally([np.concatenate(w) for w in zip(*(p[0] for p in parts), strict=True)], np.concatenate([p[1] for p in parts]), times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        waiting, last = 0, None
        for words, i, times, bins, begins in (part for batch in batches if batch.num_rows for part in _cut(batch, k, canonical, samples)):
            open_from = int(begins[np.searchsorted(bins, bins[-1], "left")])  # all bins before the part's last one are complete
            if waiting >= CHUNK and (open_from or bins[0] != last):
                if open_from:
                    held.append(([w[:open_from] for w in words], i[:open_from], None if times is None else times[:open_from]))
                    words, i, times = [w[open_from:] for w in words], i[open_from:], None if times is None else times[open_from:]
                yield from settled(*merged(held))
                held, waiting = [], 0
            elif waiting >= 2 * CHUNK:  # one bin goes on and on: only its different k-mers are kept
                held = [merged(held)]
                waiting = CHUNK
            held.append((words, i, times))
            waiting += len(i)
            last = bins[-1]
        if held:
            yield from settled(*merged(held))

    return run


# ---------------------------------------------------------------- operators


def _place(samples: Sequence[str]) -> dict[str, int]:
    return {s: i for i, s in enumerate(samples)}


def _input(reads: DataFrame) -> DataFrame:
    return reads.select(F.col("sample").cast("string"), F.col("seq").cast("string"))


def short_counts(reads: DataFrame, samples: Sequence[str], k: int, canonical: bool = True, bloom=None, codes: np.ndarray = packed.DNA) -> DataFrame:
    """``reads(sample, seq)`` -> ``(w0, ..., i, n)``, counted in the tasks; a k-mer of a sample may have many rows."""
    schema = ", ".join(f"{c} long" for c in [*packed.columns(k), "i", "n"])
    return _input(reads).mapInArrow(_counts(k, canonical, _place(samples), bloom, codes), schema)


def heavy_minimizers(reads: DataFrame, samples: Sequence[str], k: int, canonical: bool = True, bloom=None, hot: int = HOT, codes: np.ndarray = packed.DNA):
    """A broadcast, sorted array of the minimizers that are split, or None if there are none: all of more than ``hot`` windows, none of half of them or fewer.

    A task leaves out a minimizer where it has fewer than hot / 2^13 windows, so 2^12 tasks leave out less than half of ``hot``; with more tasks
    a minimizer of a few more windows may stay whole. There are fewer than 4^11 minimizers, and fewer than 2 windows / hot are split.
    """
    weighed = _input(reads).mapInArrow(_weights(k, canonical, _place(samples), bloom, codes, max(1, hot >> 13)), "bin long, n long")
    heavy = weighed.groupBy("bin").agg(F.sum("n").alias("n")).where(F.col("n") > hot / 2).select("bin").toArrow()
    found = np.sort(heavy.column(0).to_numpy())
    return reads.sparkSession.sparkContext.broadcast(found) if len(found) else None


def super_kmers(reads: DataFrame, samples: Sequence[str], k: int, canonical: bool = True, bloom=None, hot: int = HOT) -> DataFrame:
    """``reads(sample, seq)`` -> runs ``(i, bin, bases, times, seq)``; every occurrence of a k-mer is in one bin.

    ``i`` is the sample's number, ``seq`` two bits a base. Sequences are read twice: first to learn which minimizers are split.
    """
    found = _super(k, canonical, _place(samples), bloom, packed.DNA, heavy_minimizers(reads, samples, k, canonical, bloom, hot))
    return _input(reads).mapInArrow(_rows_of_runs(k, found), RUN)


def gathered(
    reads: DataFrame, samples: Sequence[str], k: int, canonical: bool = True, bloom=None, hot: int = HOT, codes: np.ndarray = packed.DNA
) -> DataFrame:
    """The runs of :func:`super_kmers`, those of a bucket of minimizers in a task in one row (``GATHER``); every occurrence of a k-mer is in one bin."""
    found = _super(k, canonical, _place(samples), bloom, codes, heavy_minimizers(reads, samples, k, canonical, bloom, hot, codes))
    return _input(reads).mapInArrow(_gathered(k, len(samples), found), GATHER)


def cut(n: Column, ci: int = 1, cx: int = 4_000_000_000, cs: int = 65_535) -> Column:
    """A count below ``ci`` or above ``cx`` is none in this sample; what remains is at most ``cs``."""
    return F.when((n >= ci) & (n <= cx), F.least(n, F.lit(cs))).otherwise(F.lit(0)).cast("long")


def at_least(counts: Column, threshold: int = 1, ratio: float = 0.0) -> Column:
    """Whether at least this ratio of samples has a count of ``threshold`` or more; ratio 0 holds for every row."""
    return F.size(F.filter(counts, lambda c: c >= threshold)) / F.size(counts) >= ratio


def packed_matrix(
    reads: DataFrame, samples: Sequence[str], k: int, canonical: bool = True, bloom=None,
    ci: int = 1, cx: int = 4_000_000_000, cs: int = 65_535, hot: int = HOT, partitions: int | None = None,
    threshold: int = 1, ratio: float = 0.0, codes: np.ndarray = packed.DNA,
) -> DataFrame:
    """``reads(sample, seq)`` -> ``(w0, ..., counts)``: each k-mer that a sample holds after the cutoffs, with a count for each of ``samples``.

    With a ratio, only rows where :func:`at_least` that ratio of samples reaches the threshold: others do not leave the task that counts
    them. ``codes`` is what each byte of a sequence stands for (:func:`packed.alphabet`).
    Reads of other samples, and null or short sequences, count for nothing.
    """
    keys = packed.columns(k)
    if k > SHORT:
        schema = ", ".join([*(f"{c} long" for c in keys), "counts array<long>"])
        rows = gathered(reads, samples, k, canonical, bloom, hot, codes)
        dealt = rows.repartition(partitions, "bin") if partitions else rows.repartition("bin")
        return dealt.sortWithinPartitions("bin").mapInArrow(_dense(k, canonical, len(samples), ci, cx, cs, threshold, ratio), schema)
    counted = short_counts(reads, samples, k, canonical, bloom, codes)
    if partitions:
        counted = counted.repartition(partitions, *keys)
    if len(samples) <= WIDE:
        sums = counted.groupBy(*keys).agg(*[F.sum(F.when(F.col("i") == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(len(samples))])
        dense = sums.select(*keys, F.array(*[cut(F.col(f"c{i}"), ci, cx, cs) for i in range(len(samples))]).alias("counts"))
    else:
        pairs = counted.groupBy(*keys, "i").agg(cut(F.sum("n"), ci, cx, cs).alias("n"))
        listed = pairs.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("m"))
        every = F.sequence(F.lit(0).cast("long"), F.lit(len(samples) - 1).cast("long"))
        dense = listed.select(*keys, F.transform(every, lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("counts"))
    dense = dense.where(F.exists("counts", lambda c: c > 0))
    return dense.where(at_least(F.col("counts"), threshold, ratio)) if ratio > 0 else dense


def packed_counts(reads: DataFrame, samples: Sequence[str], k: int, canonical: bool = True) -> DataFrame:
    """``reads(sample, seq)`` -> ``(w0, ..., i, n)``: each k-mer of each sample once, ``i`` being the sample's number."""
    keys = packed.columns(k)
    if k <= SHORT:
        return short_counts(reads, samples, k, canonical).groupBy(*keys, "i").agg(F.sum("n").alias("n"))
    dense = packed_matrix(reads, samples, k, canonical, cs=(1 << 63) - 1, cx=(1 << 63) - 1)
    return dense.select(*keys, F.posexplode("counts").alias("i", "n")).where("n > 0")


def packed_set(sequences: DataFrame, k: int, canonical: bool = True, cx: int = 4_000_000_000, codes: np.ndarray = packed.DNA) -> DataFrame:
    """Different k-mers ``(w0, ...)`` of ``sequences(seq)``, for filters; those above ``cx`` do not count."""
    return packed_matrix(sequences.select(F.lit("").alias("sample"), "seq"), [""], k, canonical, cx=cx, codes=codes).select(*packed.columns(k))
