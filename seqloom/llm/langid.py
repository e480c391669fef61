"""Language identification with a byte convolutional network.

Bytes are embedded, filters of widths two, three and four run over them, the strongest response
of every filter in a window of ``WINDOW`` bytes is kept, and a softmax layer names the language.
The network is trained in numpy on windows drawn from labelled text and applied to every window
of every text; a document's probabilities are the mean over its windows, weighted by their bytes.

At inference a response at byte i needs bytes i..i+3 only, so all filters together are two table
rows: one for the byte pair at i and one for the pair at i+2. Every text stands alone: zero bytes
follow its last window, and sums run in a fixed order, so an answer depends on the text only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import discard, hash_fraction, id_remainder, map_texts, materialize

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
#: Bounds of the training sample: documents of a language, windows of a document, documents of all languages.
DOCS_PER_LANGUAGE = 900
WINDOWS_PER_DOC = 2
MOST_DOCS = 20_000
UNKNOWN = "und"


@dataclass
class ByteCnn:
    """Weights of the network; a few thousand numbers."""

    languages: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: list[np.ndarray]  # for each width: width x EMBED x FILTERS
    bias: np.ndarray  # len(WIDTHS) * FILTERS
    dense: np.ndarray  # len(WIDTHS) * FILTERS x languages
    offset: np.ndarray  # languages

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses to the byte pairs at i and at i + 2, for all filters side by side."""
        parts = [[self.embed @ f[j] if j < len(f) else None for j in range(4)] for f in self.filters]
        zero = np.zeros((256, FILTERS), np.float32)
        pair = lambda x, y: ((zero if x is None else x)[:, None] + (zero if y is None else y)[None]).reshape(65536, -1)
        first = np.concatenate([pair(p[0], p[1]) for p in parts], axis=1).astype(np.float32)
        second = np.concatenate([pair(p[2], p[3]) for p in parts], axis=1).astype(np.float32)
        return np.ascontiguousarray(first), np.ascontiguousarray(second)

    def head(self, pooled: np.ndarray) -> np.ndarray:
        """Probabilities; one filter is added after the other, so a row's result does not depend on the rows beside it."""
        act = np.maximum(pooled + self.bias, 0).astype(float)
        logits = np.tile(self.offset.astype(float), (len(act), 1))
        for j, weights in enumerate(self.dense.astype(float)):
            logits += act[:, j, None] * weights
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(texts: list[bytes], targets: list[str], seed: int = 7, epochs: int = 8, batch: int = 64, rate: float = 0.01) -> ByteCnn:
    """Fit the network on windows of bytes. Without any window, a network that knows nothing."""
    languages = sorted(set(targets)) or [UNKNOWN]
    rng = np.random.default_rng(seed)
    total = len(WIDTHS) * FILTERS
    embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
    filters = [rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
    net = ByteCnn(
        languages, embed, filters, np.zeros(total, np.float32),
        rng.normal(0, 0.3, (total, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32),
    )
    if not texts:
        return net
    x = np.zeros((len(texts), WINDOW + 3), np.uint8)
    for i, t in enumerate(texts):
        x[i, : min(len(t), WINDOW)] = np.frombuffer(t[:WINDOW], np.uint8)
    y = np.searchsorted(languages, targets)
    share = np.bincount(y, minlength=len(languages)) / len(y)
    weight = (1 / np.maximum(share * len(languages), 1e-9))[y].astype(np.float32)  # rare languages count as much
    params = [net.embed, *net.filters, net.bias, net.dense, net.offset]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            xb, yb, n = x[rows], y[rows], len(rows)
            grads = [np.zeros_like(p) for p in params]
            pooled, where = [], []
            for f in net.filters:
                out = sum((net.embed @ f[j])[xb[:, j : j + WINDOW]] for j in range(len(f)))
                best = out.argmax(axis=1)  # n x FILTERS
                where.append(best)
                pooled.append(np.take_along_axis(out, best[:, None], 1)[:, 0])
            z = np.concatenate(pooled, axis=1) + net.bias
            act = np.maximum(z, 0)
            logits = act @ net.dense + net.offset
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            delta = e / e.sum(axis=1, keepdims=True)
            delta[np.arange(n), yb] -= 1
            delta *= (weight[rows] / n)[:, None]
            grads[-1] += delta.sum(axis=0)
            grads[-2] += act.T @ delta
            dz = (delta @ net.dense.T) * (z > 0)
            grads[-3] += dz.sum(axis=0)
            for k, f in enumerate(net.filters):
                d = dz[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(len(f)):
                    hit = np.take_along_axis(xb, where[k] + j, 1)  # the byte under tap j at the maximum
                    grads[1 + k][j] += np.einsum("nfe,nf->ef", net.embed[hit], d)
                    np.add.at(grads[0], hit, d[:, :, None] * f[j].T[None])
            step += 1
            lr = rate * (1 - epoch / (epochs + 1))
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def training_windows(
    docs: DataFrame, modulus: int = 3, held_out: int = 1, docs_per_language: int = DOCS_PER_LANGUAGE, most_docs: int = MOST_DOCS, seed: int = 11
) -> list:
    """A bounded sample of (bytes, language): some windows of some training documents a language.

    Documents are drawn by a seeded hash of id and text, equally many a language, ``most_docs`` of all
    languages together; windows begin at seeded places anywhere in the text.
    """
    known = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder(F.col("doc_id"), modulus) != held_out)
    ).select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = materialize(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "langid-counts")
    languages = counts.count()
    if not languages:
        return []
    each = min(docs_per_language, max(1, most_docs // languages))
    drawn = hash_fraction(seed, F.col("doc_id").cast("string"), F.col("text"))
    start = F.expr(f"cast(pmod(xxhash64({seed}, cast(doc_id as string), k), room) as int) + 1")
    windows = (
        known.join(counts, "lang")
        .withColumn("draw", drawn)
        .where(F.col("draw") * F.col("n") < 1.3 * each)
        .withColumn("room", F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1)
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(WINDOWS_PER_DOC))))
        .select("lang", "draw", "k", F.substring("text", start, F.lit(WINDOW)).alias("piece"))
        .orderBy("draw", "k", "lang", "piece")
        .limit(2 * WINDOWS_PER_DOC * each * languages)
    )
    rows = [(r["piece"].encode("utf-8")[:WINDOW], r["lang"]) for r in windows.collect()]
    discard(counts)
    return rows


def probabilities(net: ByteCnn, texts: list[bytes], tables=None, block: int = 256) -> np.ndarray:
    """Mean language probabilities of whole texts; ``block`` windows are worked on at a time."""
    first, second = tables or net.tables()
    out = np.zeros((len(texts), len(net.languages)))
    # each text is laid out with zeros up to a whole window and three more, for filters that reach beyond
    buffer, starts, owner, weight, at = [], [], [], [], 0
    for i, t in enumerate(texts):
        n = -(-len(t) // WINDOW)
        if not n:
            continue
        room = n * WINDOW + 3
        buffer += [t, bytes(room - len(t))]
        starts.append(at + WINDOW * np.arange(n))
        owner.append(np.full(n, i))
        weight.append(np.minimum(WINDOW, len(t) - WINDOW * np.arange(n)))
        at += room
    if not at:
        return out
    starts, owner, weight = np.concatenate(starts), np.concatenate(owner), np.concatenate(weight).astype(float)
    data = np.frombuffer(b"".join(buffer), np.uint8)
    reach = np.arange(WINDOW + 3)
    a, b = (np.empty((block, WINDOW, first.shape[1]), np.float32) for _ in range(2))
    for at in range(0, len(starts), block):
        k = min(block, len(starts) - at)
        piece = data[starts[at : at + k, None] + reach].astype(np.intp)
        pair = piece[:, :-1] * 256 + piece[:, 1:]
        np.take(first, pair[:, :WINDOW], axis=0, out=a[:k], mode="clip")
        np.take(second, pair[:, 2:], axis=0, out=b[:k], mode="clip")
        a[:k] += b[:k]
        np.add.at(out, owner[at : at + k], net.head(a[:k].max(axis=1)) * weight[at : at + k, None])
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-300)


def _predictor(net: ByteCnn):
    tables = []  # built once in each task

    def predict(texts: list[str | None]) -> list[pa.Array]:
        if not tables:
            tables.extend(net.tables())
        texts = [t or "" for t in texts]
        p = probabilities(net, [t.encode("utf-8", "surrogatepass") for t in texts], tuple(tables))
        best = p.argmax(axis=1)
        speaks = np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool)
        names = [net.languages[k] if s else UNKNOWN for k, s in zip(best, speaks, strict=True)]
        return [pa.array(names, pa.string()), pa.array(np.where(speaks, p[np.arange(len(best)), best], 0.0), pa.float64())]

    return predict


def fit(docs: DataFrame, modulus: int = 3, held_out: int = 1, **bounds) -> ByteCnn:
    """Learn from text and non-null lang of the documents outside the held-out fold."""
    windows = training_windows(docs, modulus, held_out, **bounds)
    return train([w for w, _ in windows], [lang for _, lang in windows])


def predict(docs: DataFrame, net: ByteCnn, keep: list[str] | None = None) -> DataFrame:
    """``docs(text, ...)`` -> ``(rec, lang_pred, score)``, a row per input row; rec holds the columns ``keep`` (all).

    lang_pred is ``und`` with score 0 where the text is null or has no letter (a character of a
    Unicode letter category). Whole texts are read, however long; copies get equal answers,
    whatever partition or batch they are in.
    """
    return map_texts(docs, keep, _predictor(net), "lang_pred string, score double")


def identify(docs: DataFrame, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """Train on ``docs`` and predict for all of them: ``(doc_id, held_out, lang_pred, score)``."""
    net = fit(docs, modulus, held_out)
    return predict(docs, net, ["doc_id"]).select(
        "rec.doc_id", (id_remainder(F.col("rec.doc_id"), modulus) == held_out).alias("held_out"), "lang_pred", "score"
    )
