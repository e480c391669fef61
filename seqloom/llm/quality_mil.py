"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded: the shape of its
bytes (frequencies of byte classes and of pairs of classes), its letters (hashed byte trigrams),
its words' lengths, how often words repeat inside it, and how much of it repeats earlier parts of
the document. A small network turns
encodings into representations, gated attention weighs the passages, and the weighted mean is
scored. Only documents carry labels; which passages matter is learned. Training is done in numpy
on a bounded sample; scoring reads every passage of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import discard, id_remainder, labelled_sample, map_texts

PASSAGE = 64
#: Bytes of a text that are encoded at once.
BLOCK = 1 << 20
#: Bounds of the training sample: documents, and passages of one document (spread evenly over it).
SAMPLE = 5000
TRAIN_PASSAGES = 64

_KINDS = 14
_CLASS = np.zeros(256, np.int64)
for _c in range(256):
    _ch = chr(_c)
    if _c >= 0xC0:
        _CLASS[_c] = 0  # first byte of a longer character
    elif _c >= 0x80:
        _CLASS[_c] = 1
    elif "A" <= _ch <= "Z":
        _CLASS[_c] = 2
    elif _ch in "aeiouy":
        _CLASS[_c] = 3
    elif "a" <= _ch <= "z":
        _CLASS[_c] = 4
    elif _ch.isdigit():
        _CLASS[_c] = 5
    elif _ch == "\n":
        _CLASS[_c] = 6
    elif _c <= 32:
        _CLASS[_c] = 7
    elif _ch in ".,":
        _CLASS[_c] = 8
    elif _ch in "!?":
        _CLASS[_c] = 9
    elif _ch in "#*$%&":
        _CLASS[_c] = 10
    elif _ch in "|<>":
        _CLASS[_c] = 11
    elif _ch in ":;'\"()-/@_=":
        _CLASS[_c] = 12
    else:
        _CLASS[_c] = 13
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Buckets of byte trigrams, in lower case.
TRIGRAMS = 128
_LOW = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint32)
#: Length of a passage's encoding.
SIZE = _KINDS + _KINDS * _KINDS + TRIGRAMS + 6


def _hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of a text, and where each passage begins; read ``BLOCK`` bytes at a time."""
    codes, begins, at, words = [], [], 0, 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        while end < len(raw) and not _SPACE[raw[end]]:  # a word is not cut
            end += 1
        part = np.frombuffer(raw, np.uint8, end - at, at)
        blank = _SPACE[part]
        starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
        codes.append(np.fromiter(map(hash, raw[at:end].split()), np.int64, len(starts)).view(np.uint64))
        begins.append(at + starts[-words % PASSAGE :: PASSAGE])
        words, at = words + len(starts), end
    return (np.concatenate(codes), np.concatenate(begins)) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _heard(code: np.ndarray) -> np.ndarray:
    """Which words begin a trigram of words that the text has had already, looked up in a few shares of the trigrams at a time."""
    out = np.zeros(len(code), bool)
    if len(code) >= 3:
        triple = code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:]
        shares = 1 + len(triple) // BLOCK
        for share in range(shares):
            own = np.flatnonzero(triple % np.uint64(shares) == np.uint64(share)) if shares > 1 else np.arange(len(triple))
            order = own[np.argsort(triple[own], kind="stable")]
            out[order[1:][triple[order][1:] == triple[order][:-1]]] = True
    return out


def blocks(text: str) -> Iterator[np.ndarray]:
    """Encodings of the passages of a text, at least one (of zeros where there is no word), some passages at a time.

    Beside the text a block needs memory for its own passages, and the whole text ten bytes for each word.
    """
    raw = text.encode("utf-8", "surrogatepass")
    code, begin = _hashes(raw)
    if not len(code):
        yield np.zeros((1, SIZE), np.float32)
        return
    heard, same = _heard(code), np.r_[False, code[1:] == code[:-1]]
    begin[0] = 0
    at = 0
    while at < len(begin):
        end = max(at + 1, int(np.searchsorted(begin, begin[at] + BLOCK, "right")) - 1) if begin[-1] > begin[at] + BLOCK else len(begin)
        stop = int(begin[end]) if end < len(begin) else len(raw)
        own = slice(at * PASSAGE, end * PASSAGE)
        yield _encoded(raw[begin[at] : stop + 2], stop - int(begin[at]), begin[at:end] - begin[at], code[own], heard[own], same[own])
        at = end


def _encoded(data: bytes, size: int, begin: np.ndarray, code: np.ndarray, heard: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Encodings of passages that begin at ``begin`` of ``data``; up to two bytes beyond ``size`` are those that follow."""
    raw, passages, words = np.frombuffer(data, np.uint8), len(begin), len(code)
    passage = np.repeat(np.arange(passages), np.diff(np.r_[begin, size]))
    kinds = _CLASS[raw]
    single = np.bincount(passage * _KINDS + kinds[:size], minlength=passages * _KINDS).reshape(passages, -1)
    n = min(size, len(raw) - 1)
    pairs = np.bincount(passage[:n] * _KINDS**2 + kinds[:n] * _KINDS + kinds[1 : n + 1], minlength=passages * _KINDS**2).reshape(passages, -1)
    low, n = _LOW[raw], max(0, min(size, len(raw) - 2))
    bucket = ((low[:n] << 16 | low[1 : n + 1] << 8 | low[2 : n + 2]) * np.uint32(0x9E3779B1)) >> np.uint32(25)
    letters = np.bincount(passage[:n] * TRIGRAMS + bucket, minlength=passages * TRIGRAMS).reshape(passages, -1)
    total = single.sum(axis=1, keepdims=True)
    count = np.full(passages, PASSAGE, float)
    count[-1] = words - (passages - 1) * PASSAGE
    at = np.arange(words) // PASSAGE
    length = np.fromiter(map(len, data[:size].split()), np.int64, words)
    # words that a passage has had already, words equal to their predecessor, trigrams the text has had already
    order = np.lexsort((code, at))
    again = (code[order][1:] == code[order][:-1]) & (at[order][1:] == at[order][:-1])
    repeats = np.bincount(at[order][1:][again], minlength=passages)
    same, old = np.bincount(at[same], minlength=passages), np.bincount(at[heard], minlength=passages)
    return np.column_stack([
        single / total, 4 * pairs / total, 8 * letters / total, repeats / count, same / count, old / count,
        np.bincount(at, length, passages) / count / 10, np.bincount(at, length > 20, passages) / count, count / PASSAGE,
    ]).astype(np.float32)


def encode(text: str) -> np.ndarray:
    """Encodings of all passages of a text in one array."""
    return np.concatenate(list(blocks(text)))


def _spread(text: str, most: int) -> np.ndarray:
    """Encodings of at most ``most`` passages, spread evenly over the text."""
    passages = max(1, -(-len(text.split()) // PASSAGE)) if len(text) < BLOCK else len(_hashes(text.encode("utf-8", "surrogatepass"))[1]) or 1
    wanted = np.linspace(0, passages - 1, most).astype(int) if passages > most else np.arange(passages)
    out, before = [], 0
    for block in blocks(text):
        out.append(block[wanted[(wanted >= before) & (wanted < before + len(block))] - before])
        before += len(block)
    return np.concatenate(out)


@dataclass
class AttentionModel:
    """Weights: encoder, gated attention, score. ``mean``/``scale`` standardise encodings."""

    mean: np.ndarray
    scale: np.ndarray
    params: list[np.ndarray]  # encoder W, b; attention V, U, w; score c, d

    def passages(self, x: np.ndarray):
        """Encodings -> standardised ones, representations, both sides of the gate, and attention before it is normalised."""
        w, b, v, u, a = self.params[:5]
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.maximum(z @ w + b, 0)
        left, gate = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        return z, h, left, gate, (left * gate) @ a

    def probability(self, parts: Iterator[np.ndarray]) -> float:
        """The probability of one bag whose passages come in parts; attention is normalised as they come."""
        c, d = self.params[5:]
        top, total, pooled = -np.inf, 0.0, 0.0
        for x in parts:
            _, h, _, _, raw = self.passages(x)
            high = max(top, float(raw.max()))
            e, before = np.exp(raw - high), np.exp(top - high)
            total, pooled, top = total * before + float(e.sum()), pooled * before + e @ h, high
        return float(1 / (1 + np.exp(-(pooled / total @ c + d[0]))))

    def forward(self, x: np.ndarray, first: np.ndarray):
        """Passages of bags that begin at ``first`` -> probabilities of the bags, and what training needs."""
        c, d = self.params[5:]
        z, h, left, gate, raw = self.passages(x)
        bag = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(x)]))
        e = np.exp(raw - np.maximum.reduceat(raw, first)[bag])
        alpha = e / np.add.reduceat(e, first)[bag]
        pooled = np.add.reduceat(alpha[:, None] * h, first)
        p = 1 / (1 + np.exp(-(pooled @ c + d[0])))
        return p, (z, h, left, gate, alpha, pooled, bag)


def train(
    bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, inner: int = 12, epochs: int = 25, batch: int = 128, rate: float = 0.004, decay: float = 1e-4, seed: int = 5
) -> AttentionModel:
    """Fit by Adam on the logistic loss of documents."""
    rng = np.random.default_rng(seed)
    mean, scale = np.zeros(SIZE, np.float32), np.ones(SIZE, np.float32)
    if bags:  # sums by bag: the sample is not held twice
        n = sum(map(len, bags))
        mean = (sum(b.sum(axis=0, dtype=float) for b in bags) / n).astype(np.float32)
        scale = (np.sqrt(sum(((b - mean) ** 2).sum(axis=0, dtype=float) for b in bags) / n) + 1e-3).astype(np.float32)
    shapes = [(SIZE, hidden), (hidden,), (hidden, inner), (hidden, inner), (inner,), (hidden,), (1,)]
    params = [rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32) if len(s) > 1 or s[0] == inner else np.zeros(s, np.float32) for s in shapes]
    params[5] = rng.normal(0, 0.3, hidden).astype(np.float32)
    prior = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
    params[6][:] = np.log(prior / (1 - prior))
    model = AttentionModel(mean, scale, params)
    if not len(labels):
        return model
    m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(bags), batch):
            rows = order[i : i + batch]
            part = [bags[r] for r in rows]
            first = np.cumsum([0, *map(len, part[:-1])])
            y = labels[rows]
            p, (z, h, left, gate, alpha, pooled, bag) = model.forward(np.concatenate(part), first)
            w, b, v, u, a, c, d = params
            delta = ((p - y) / len(y)).astype(np.float32)
            d_pooled = delta[:, None] * c
            d_alpha = (d_pooled[bag] * h).sum(axis=1)
            d_raw = alpha * (d_alpha - np.add.reduceat(alpha * d_alpha, first)[bag])
            d_left = d_raw[:, None] * a * gate * (1 - left**2)
            d_gate = d_raw[:, None] * a * left * gate * (1 - gate)
            d_h = (alpha[:, None] * d_pooled[bag] + d_left @ v.T + d_gate @ u.T) * (h > 0)
            grads = [z.T @ d_h, d_h.sum(axis=0), h.T @ d_left, h.T @ d_gate, (left * gate).T @ d_raw, pooled.T @ delta, np.array([delta.sum()])]
            step += 1
            lr = rate * (1 - epoch / (epochs + 1))
            for q, g, f, s in zip(params, grads, m1, m2, strict=True):
                g = g + decay * q
                f += 0.1 * (g - f)
                s += 0.001 * (g * g - s)
                q -= lr * (f / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, max_rows: int = SAMPLE, seed: int = 29) -> AttentionModel:
    """Learn from at most about ``max_rows`` labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, "quality", max_rows, seed, modulus, held_out)

    def run(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array([_spread(t or "", TRAIN_PASSAGES).astype("<f2").tobytes() for t in texts], pa.binary())]

    rows = map_texts(sample, ["doc_id", "label"], run, "bag binary").select("rec.*", "bag").collect()
    discard(sample)
    rows.sort(key=lambda r: r["doc_id"])
    bags = [np.frombuffer(r["bag"], "<f2").reshape(-1, SIZE) for r in rows]
    return train(bags, np.array([r["label"] for r in rows], np.float32))


def score(docs: DataFrame, model: AttentionModel, keep: list[str] | None = None) -> DataFrame:
    """``docs(text, ...)`` -> ``(rec, score)``, a row per input row; rec holds the columns ``keep`` (all).

    score: probability of quality label 1. Null texts count as empty: one passage without words. A text
    of more than ``BLOCK`` characters is encoded and pooled block by block, so beside itself it needs
    ten bytes a word and one block's encodings, however long it is. A row repeated in every column gets
    the score of its like, and an empty table gives an empty result.
    """

    def run(texts: list[str | None]) -> list[pa.Array]:
        p = np.zeros(len(texts))
        short = [i for i, t in enumerate(texts) if len(t or "") <= BLOCK]
        if short:
            bags = [encode(texts[i] or "") for i in short]
            p[short] = model.forward(np.concatenate(bags), np.cumsum([0, *map(len, bags[:-1])]))[0]
        for i in set(range(len(texts))) - set(short):
            p[i] = model.probability(blocks(texts[i]))
        return [pa.array(p, pa.float64())]

    return map_texts(docs, keep, run, "score double", slice_rows=200)


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """Train and score all of ``docs``: ``(doc_id, held_out, score, predicted)``."""
    model = fit(docs, labels, modulus, held_out)
    return score(docs, model, ["doc_id"]).select(
        "rec.doc_id",
        (id_remainder(F.col("rec.doc_id"), modulus) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
