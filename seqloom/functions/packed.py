"""K-mers as integers: two bits a base, in numpy over whole batches of sequences.

A k-mer is ``words(k)`` integers of up to 31 bases each, the last one shorter; comparing them from the
first on is comparing the k-mers as text. The other strand is the reversed sequence with 3 - code for
each base, so canonical forms are minima of integers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases in one integer.
WORD = 31
#: Windows of one piece of a long sequence; pieces overlap by k - 1.
PIECE = 1 << 20
#: Bases that are worked on at once.
SLICE = 4 << 20

#: What a byte may stand for besides the bases 0 to 3: a break of the sequence, or nothing at all.
BREAK, SKIP = 4, 5


def alphabet(letters: str = "ACGT", bases: str = "ACGT", other: int = BREAK) -> np.ndarray:
    """What each byte stands for, if ASCII ``letters`` stand for ``bases`` and all other bytes for ``other``."""
    codes = np.full(256, other, np.uint8)
    codes[np.frombuffer(letters.encode(), np.uint8)] = ["ACGT".index(b) for b in bases]
    return codes


DNA = alphabet()


def sizes(k: int) -> list[int]:
    """Bases in each integer of a k-mer."""
    return [min(WORD, k - at) for at in range(0, k, WORD)]


def columns(k: int) -> list[str]:
    """Names of the integers of a k-mer."""
    return [f"w{i}" for i in range(len(sizes(k)))]


def text(k: int) -> Column:
    """The k-mer that the columns :func:`columns` hold, as text."""
    parts = [F.translate(F.lpad(F.conv(F.col(c).cast("string"), 10, 4), n, "0"), "0123", "ACGT") for c, n in zip(columns(k), sizes(k), strict=True)]
    return F.concat(*parts)


def encode(kmers: Sequence[str], k: int) -> list[list[int]]:
    """The integers of k-mers given as text, a list for each of :func:`columns`."""
    digits = str.maketrans("ACGT", "0123")
    out, at = [], 0
    for n in sizes(k):
        out.append([int(x[at : at + n].translate(digits), 4) for x in kmers])
        at += n
    return out


@dataclass
class Stretch:
    """Sequences side by side: base codes (4 for other symbols), and for each sequence where it ends and its row."""

    codes: np.ndarray
    ends: np.ndarray
    rows: np.ndarray


def without_skipped(offsets: np.ndarray, data: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences ``data[offsets[i]:offsets[i + 1]]`` without the bytes that stand for nothing, and their offsets."""
    if not (codes == SKIP).any():
        return offsets, data
    data = data[offsets[0] : offsets[-1]]
    kept = codes[data] != SKIP
    lengths = np.diff(offsets)
    some = np.flatnonzero(lengths)
    if len(some):
        lengths[some] = np.add.reduceat(kept, (offsets - offsets[0])[some], dtype=np.int64)
    return np.concatenate([[0], np.cumsum(lengths)]), data[kept]


def stretches(offsets: np.ndarray, data: np.ndarray, k: int, size: int = SLICE, codes: np.ndarray = DNA) -> Iterator[Stretch]:
    """Sequences ``data[offsets[i]:offsets[i + 1]]`` in stretches of about ``size`` bases, long ones cut into overlapping pieces."""
    lengths = np.diff(offsets)
    keep = np.flatnonzero(lengths >= k)
    count = (lengths[keep] - k) // PIECE + 1
    rows = np.repeat(keep, count)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    starts = offsets[rows] + nth * PIECE
    stops = np.minimum(offsets[rows + 1], starts + PIECE + k - 1)
    total, at = np.cumsum(stops - starts), 0
    while at < len(rows):
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + size, "right")))
        own = codes[np.concatenate([data[a:b] for a, b in zip(starts[at:end], stops[at:end], strict=True)])]
        yield Stretch(own, total[at:end] - done, rows[at:end])
        at = end


def _packed(codes: np.ndarray, n: int, kind: type = np.int64) -> np.ndarray:
    """Integers of the windows of n codes, by doubling."""
    out, have, power, width = None, 0, codes.astype(kind), 1
    while width <= n:
        if n & width:
            out = power if out is None else _joined(out, have, power, width)
            have += width
        if 2 * width <= n:
            power = (power[:-width] << (2 * width)) | power[width:]
        width *= 2
    return out


def _joined(head: np.ndarray, have: int, tail: np.ndarray, width: int) -> np.ndarray:
    """Windows of ``have`` bases, each with the ``width`` bases behind it."""
    n = min(len(head), len(tail) - have)
    return (head[:n] << (2 * width)) | tail[have : have + n]


def _other(words: np.ndarray, n: int) -> np.ndarray:
    """The other strand of n bases in each unsigned integer: complements in reversed order."""
    bits = 8 * words.itemsize
    pairs, halves = 0x3333333333333333 & (1 << bits) - 1, 0x0F0F0F0F0F0F0F0F & (1 << bits) - 1
    out = ~words
    out = (out >> 2) & pairs | (out & pairs) << 2
    out = (out >> 4) & halves | (out & halves) << 4
    return out.byteswap() >> (bits - 2 * n)


def _strand(codes: np.ndarray, k: int) -> list[np.ndarray]:
    """The integers of all windows of k codes."""
    n, out = len(codes) - k + 1, []
    for i, size in enumerate(sizes(k)):
        out.append(_packed(codes, size)[i * WORD : i * WORD + n])
    return out


def windows(codes: np.ndarray, k: int, canonical: bool) -> list[np.ndarray]:
    """The integers of all windows of k codes, of the smaller strand if asked; windows over breaks are to be left out."""
    bases = codes & 3
    own = _strand(bases, k)
    if not canonical:
        return own
    return _smaller(own, [w[::-1] for w in _strand((3 - bases)[::-1], k)])


def _smaller(own: list[np.ndarray], other: list[np.ndarray]) -> list[np.ndarray]:
    """The integers of the smaller of two k-mers each."""
    if len(own) == 1:
        return [np.minimum(own[0], other[0])]
    less, even = np.zeros(len(own[0]), bool), np.ones(len(own[0]), bool)
    for a, b in zip(own, other, strict=True):
        less |= even & (b < a)
        even &= a == b
    return [np.where(less, b, a) for a, b in zip(own, other, strict=True)]


def valid(s: Stretch, k: int) -> np.ndarray:
    """Which windows of k bases lie in one sequence and have no other symbol."""
    n = len(s.codes) - k + 1
    ends = np.repeat(s.ends.astype(np.int32), np.diff(s.ends, prepend=0))
    ok = np.arange(k, n + k, dtype=np.int32) <= ends[:n]
    breaks = s.codes > 3
    if breaks.any():
        broken = np.zeros(len(breaks) + 1, np.int32)
        np.cumsum(breaks, out=broken[1:])
        ok &= broken[k:] == broken[:-k]
    return ok


def mixed(words: Sequence[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of the integers of k-mers."""
    h = np.zeros(len(words[0]), np.uint64)
    for w in words:
        h = (h ^ w.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def minimizers(codes: np.ndarray, k: int, m: int) -> np.ndarray:
    """For each window of k codes the smallest hash, below 4^m, of its canonical m-mers (of up to 15 bases), the same for both strands."""
    own = _packed(codes & 3, m, np.uint32)
    least, mask = np.minimum(own, _other(own, m)), (1 << 2 * m) - 1
    for odd in (0x2C1B3C6D, 0x297A2D39):  # each step is a permutation of the m-mers
        least ^= least >> m
        least *= np.uint32(odd)
        least &= mask
    least ^= least >> m
    width, want = 1, k - m + 1
    while width * 2 <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[: len(least) - (want - width)], least[want - width :])


def runs(s: Stretch, bins: np.ndarray, ok: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring valid windows of one bin: first window, number of windows, and row; none is longer than ``longest``."""
    apart = np.ones(len(ok) + 1, bool)  # between a window and the one before it
    apart[1:-1] = (bins[1:] != bins[:-1]) | ~(ok[1:] & ok[:-1])
    first = np.flatnonzero(ok & apart[:-1])
    n = np.flatnonzero(ok & apart[1:]) - first + 1
    if len(n) and n.max() > longest:  # a long run of one bin begins anew after so many windows
        parts = (n + longest - 1) // longest
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, n = np.repeat(first, parts) + nth * longest, np.minimum(np.repeat(n, parts) - nth * longest, longest)
    return first, n, s.rows[np.searchsorted(s.ends, first, "right")]


def quads(codes: np.ndarray) -> np.ndarray:
    """At each code a byte of four bases, its own first."""
    c = np.concatenate([codes & 3, np.zeros(3, np.uint8)])
    return c[:-3] << 6 | c[1:-2] << 4 | c[2:-1] << 2 | c[3:]


def pack_quads(quads: np.ndarray, first: np.ndarray, bases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of what :func:`quads` gave as bytes of four bases each, and the offsets of the stretches in them; what fills a last byte is arbitrary."""
    padded = (bases + 3) // 4
    offsets = np.concatenate([[0], np.cumsum(padded)])
    return quads[np.repeat(first - 4 * offsets[:-1], padded) + 4 * np.arange(offsets[-1])], offsets


def pack_runs(codes: np.ndarray, first: np.ndarray, bases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of codes as bytes of four bases each, and the offsets of the stretches in them."""
    return pack_quads(quads(codes), first, bases)


def run_windows(data: np.ndarray, offsets: np.ndarray, n: np.ndarray, k: int, canonical: bool) -> list[np.ndarray]:
    """The integers of the first n windows of k bases of each stretch that :func:`pack_runs` packed; others are not looked at."""
    one = np.concatenate([data, np.zeros(k // 4 + 16, np.uint8)]).astype(np.uint64)
    two = one[:-1] << 8 | one[1:]
    four = two[:-2] << 16 | two[2:]
    eight = four[:-4] << 32 | four[4:]
    place = np.repeat(4 * offsets - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def bases(at: int, size: int) -> np.ndarray:
        begin = place + at
        byte, shift = begin >> 2, (begin & 3).astype(np.uint64) << 1
        out = eight[byte] << shift
        if size > 29:  # they may reach into a ninth byte
            out |= one[byte + 8] >> (8 - shift)
        return out >> (64 - 2 * size)

    size = sizes(k)
    own = [bases(i * WORD, of) for i, of in enumerate(size)]
    if canonical:
        own = _smaller(own, [_other(own[0] if len(size) == 1 else bases(k - i * WORD - of, of), of) for i, of in enumerate(size)])
    return [w.view(np.int64) for w in own]


def unpack_runs(data: np.ndarray, offsets: np.ndarray, bases: np.ndarray) -> np.ndarray:
    """What :func:`pack_runs` packed: the codes of all stretches, one behind the other."""
    codes = np.stack([data >> 6, data >> 4 & 3, data >> 2 & 3, data & 3], axis=1).ravel()
    within = np.arange(bases.sum()) - np.repeat(np.cumsum(bases) - bases, bases)
    return codes[np.repeat(offsets[:-1] * 4, bases) + within]


def tally(words: list[np.ndarray], rows: np.ndarray, times: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Different (k-mer, row) pairs, sorted, and how often each occurs."""
    bits = int(rows.max()).bit_length() if len(rows) else 0
    if len(words) == 1 and len(rows) and int(words[0].max()).bit_length() + bits < 64:  # both fit in one integer
        both = words[0] << bits | rows
        if times is None:
            both.sort()
        else:
            order = np.argsort(both)
            both, times = both[order], times[order]
        begins = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        n = np.diff(np.append(begins, len(both))) if times is None else np.add.reduceat(times, begins)
        both = both[begins]
        return [both >> bits], both & (1 << bits) - 1, n
    order = np.lexsort([rows, *words[::-1]])
    words, rows = [w[order] for w in words], rows[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = rows[1:] != rows[:-1]
    for w in words:
        fresh[1:] |= w[1:] != w[:-1]
    begins = np.flatnonzero(fresh)
    if times is None:
        n = np.diff(np.append(begins, len(rows)))
    else:
        n = np.add.reduceat(times[order], begins) if len(begins) else np.zeros(0, np.int64)
    return [w[begins] for w in words], rows[begins], n
