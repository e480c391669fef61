"""Toxicity scores: boosted trees over dense text features, with isotonic calibration.

The lexicon is learned, not shipped: words and word beginnings that toxic training documents use
far more often than others, with their log-odds. Features are densities of lexicon words (plain,
beginnings, and words that match only after undoing obfuscation), how near they stand to
second-person words, and rates of capitals, punctuation and obfuscation. Every whole text is read.

Trees and calibration are fitted on features whose lexicon was learned without the document's own
fold, so a document's label never reaches its own features; texts to be scored get the lexicon of
all training documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.boosting import Isotonic, Trees, cross_margins, fit_isotonic, fit_trees
from seqloom.llm.common import discard, id_remainder, labelled_sample, map_texts

#: Bound of the labelled sample that everything is learned from, in documents.
SAMPLE = 6000
#: Folds that lexicons are learned without.
FOLDS = 4
#: Entries of the learned lexicon: words, and beginnings of words.
ENTRIES = (400, 400)
BEGINNINGS = (4, 5, 6, 7)
#: Words between a lexicon word and a second-person word that still count as near.
NEAR = 4

#: Fixed value: second-person words of the languages at hand.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur ya du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos tú usted ustedes ti tus vosotros vuestro".split()
)
#: Fixed value: letters that digits and signs stand for in disguised words.
LEET = str.maketrans("013457@$!|€+", "oieastasiiet")

_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”‘’«»…–—"
#: A leading '$' or '@' may stand for a letter.
_LEFT = _EDGE.replace("$", "").replace("@", "")
_PLAIN = re.compile(r"[^\W\d_]+", re.UNICODE)
_INNER = re.compile(r"[^\w]|\d|_", re.UNICODE)
_STRETCH = re.compile(r"(.)\1{2,}")

_CLASS = np.zeros(256, np.int64)
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = 0 if _c >= 128 else 1 if "A" <= _ch <= "Z" else 2 if "a" <= _ch <= "z" else 3 if _ch.isdigit() else 4 if _c <= 32 else 5 if _ch == "!" else 6 if _ch in ".,;:?'\"()-" else 7

NAMES = (
    "log_words", "lex_hits", "lex_density", "lex_distinct", "lex_weight", "lex_top",
    "start_hits", "start_density", "start_distinct", "start_weight", "start_top",
    "hidden_hits", "hidden_density", "any_distinct",
    "you_density", "you_near", "capitals", "bangs", "punctuation", "signs", "digits",
    "mixed_words", "stretched", "spelled",
)


def plain_form(token: str) -> str:
    """A lower-case token with disguise undone: digits and signs to letters, the rest dropped, stretches folded."""
    return _STRETCH.sub(r"\1", "".join(_PLAIN.findall(token.translate(LEET))))


def tokens_of(text: str) -> list[str]:
    return [t.lstrip(_LEFT).rstrip(_EDGE) for t in text.lower().split()]


def _spelled(tokens: list[str]) -> list[str]:
    """Words spelled out letter by letter: runs of four or more one-letter tokens, joined."""
    out, run = [], []
    for t in [*tokens, ""]:
        if len(t) == 1 and t.isalpha():
            run.append(t)
        else:
            if len(run) >= 4:
                out.append("".join(run))
            run = []
    return out


def features(text: str, words: dict[str, float], starts: dict[str, float]) -> list[float]:
    """The dense features of one text, in the order of ``NAMES``."""
    tokens = tokens_of(text)
    n = max(1, len(tokens))
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    count = np.bincount(_CLASS[raw], minlength=8) if len(raw) else np.zeros(8)
    stretched = int(((raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (_CLASS[raw[2:]] < 3)).sum())
    vocabulary = set(tokens)
    hits: dict[str, float] = {t: words[t] for t in vocabulary & words.keys()}
    begun: dict[str, tuple[str, float]] = {}
    hidden: dict[str, float] = {}
    mixed = set()
    for t in vocabulary:
        if not t.isalpha() and t:
            if _INNER.search(t) and _PLAIN.search(t):
                mixed.add(t)
            p = plain_form(t)
            if p in words:
                hidden[t] = words[p]
        elif t not in hits and len(t) >= BEGINNINGS[0]:
            if stretched and (p := _STRETCH.sub(r"\1", t)) != t and p in words:
                hidden[t] = words[p]
                continue
            for k in BEGINNINGS:
                weight = starts.get(t[:k])
                if weight is not None and (t not in begun or weight > begun[t][1]):
                    begun[t] = (t[:k], weight)
    spaced = _spelled(tokens) if sum(len(t) == 1 for t in vocabulary) >= 3 else []
    hidden |= {s: words[s] for s in spaced if s in words}
    lex_n = start_n = hid_n = you_n = mix_n = near = 0
    if hits or hidden or begun or mixed or vocabulary & SECOND_PERSON:
        marked, you = [], []
        for i, t in enumerate(tokens):
            if t in hits:
                lex_n += 1
                marked.append(i)
            elif t in hidden:
                hid_n += 1
                marked.append(i)
            elif t in begun:
                start_n += 1
            if t in SECOND_PERSON:
                you.append(i)
            elif t in mixed:
                mix_n += 1
        hid_n += sum(s in hidden for s in spaced)
        you_n = len(you)
        if marked and you:
            y = np.array(you)
            at = np.array(marked)
            k = np.searchsorted(y, at)
            gap = np.minimum(np.abs(at - y[np.minimum(k, len(y) - 1)]), np.abs(at - y[np.maximum(k - 1, 0)]))
            near = int((gap <= NEAR).sum())
    letters = max(1, count[1] + count[2])
    size = max(1, len(raw))
    return [
        math.log1p(len(tokens)), lex_n, lex_n / n, len(hits), sum(hits.values()), max(hits.values(), default=0.0),
        start_n, start_n / n, len({b for b, _ in begun.values()}), sum(w for _, w in begun.values()), max((w for _, w in begun.values()), default=0.0),
        hid_n, hid_n / n, len(hits) + len(hidden),
        you_n / n, near, count[1] / letters, count[5] / n, count[6] / n, count[7] / n, count[3] / size,
        mix_n / n, stretched / n, len(spaced) / n,
    ]


@dataclass
class ToxicityModel:
    words: dict[str, float]
    starts: dict[str, float]
    trees: Trees
    calibrate: Isotonic

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t or "", self.words, self.starts) for t in texts]).reshape(len(texts), len(NAMES))
        return np.clip(self.calibrate(self.trees.margin(x)), 0.0, 1.0)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label, fold) -> the different words (kind 0) and beginnings (their length) of each text."""
    for batch in batches:
        kinds, terms, at = [], [], []
        for i, text in enumerate(batch.column(0).to_pylist()):
            own = {(0, t) for t in tokens_of(text) if t and t.isalpha()}
            own |= {(k, t[:k]) for _, t in own for k in BEGINNINGS if len(t) > k}
            kinds += [k for k, _ in own]
            terms += [t for _, t in own]
            at += [i] * len(own)
        rows = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.int32()), pa.array(terms, pa.string()), batch.column(1).take(rows), batch.column(2).take(rows)],
            ["kind", "term", "label", "fold"],
        )


Lexicon = tuple[dict[str, float], dict[str, float]]


def choose(kinds: np.ndarray, terms: np.ndarray, toxic: np.ndarray, clean: np.ndarray, all_toxic: int, all_clean: int, entries: tuple[int, int], least: int) -> Lexicon:
    """Of counted terms, the words and beginnings with the largest log-odds for label 1 that are surely above one."""
    if not all_toxic or not all_clean:
        return {}, {}
    odds = np.log((toxic + 0.5) / (all_toxic + 1)) - np.log((clean + 0.5) / (all_clean + 1))
    sure = odds - 2 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))  # lower end of about two standard errors
    out = []
    for own, most in ((kinds == 0, entries[0]), (kinds > 0, entries[1])):
        fit = np.flatnonzero(own & (toxic >= least) & (sure > 0.7))
        best = sorted(fit.tolist(), key=lambda i: (-sure[i], terms[i]))[:most]
        out.append({str(terms[i]): float(odds[i]) for i in best})
    return out[0], out[1]


def learn_lexicons(sample: DataFrame, folds: int = FOLDS, entries: tuple[int, int] = ENTRIES, least: int = 3) -> tuple[Lexicon, list[Lexicon]]:
    """``sample(text, label, fold)`` -> the lexicon of all rows, and for each fold the one of all other rows.

    Terms are counted by Spark, once for all folds; those that ``least`` toxic documents hold, a
    part of the bounded sample's vocabulary, come to the driver.
    """
    every = range(folds)
    rows = {r["fold"]: r for r in sample.groupBy("fold").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).collect()}
    size = np.array([[rows[k][c] if k in rows else 0 for k in every] for c in "tc"])
    per_fold = [F.count_if((F.col("label") == (c == "t")) & (F.col("fold") == k)).alias(f"{c}{k}") for c in "tc" for k in every]
    terms = sample.select("text", F.col("label") == 1, "fold").mapInArrow(_terms, "kind int, term string, label boolean, fold int")
    counted = terms.groupBy("kind", "term").agg(F.count_if("label").alias("t"), *per_fold).where(F.col("t") >= least).toPandas()
    kinds, names = counted["kind"].to_numpy(), counted["term"].to_numpy()
    toxic, clean = (counted[[f"{c}{k}" for k in every]].to_numpy().reshape(-1, folds) for c in "tc")
    without = lambda k: choose(
        kinds, names, *(x.sum(axis=1) - (x[:, k] if k is not None else 0) for x in (toxic, clean)),
        *(int(x.sum() - (x[k] if k is not None else 0)) for x in size), entries, least,
    )
    return without(None), [without(k) for k in every]


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, max_rows: int = SAMPLE, seed: int = 23) -> ToxicityModel:
    """Learn from at most about ``max_rows`` labelled documents outside the held-out fold."""
    drawn = labelled_sample(docs, labels, "toxic", max_rows, seed, modulus, held_out)
    sample = drawn.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id").cast("string")), F.lit(FOLDS)).cast("int"))
    (words, starts), others = learn_lexicons(sample)

    def run(lexicon: Lexicon):
        return lambda texts: [pa.array([features(t or "", *lexicon) for t in texts], pa.list_(pa.float64()))]

    rows = []
    for k, lexicon in enumerate(others):
        own = map_texts(sample.where(F.col("fold") == k), ["doc_id", "label", "fold"], run(lexicon), "x array<double>")
        rows += own.select("rec.*", "x").collect()
    discard(drawn)
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(NAMES))
    y, fold = (np.array([r[c] for r in rows], dtype=float) for c in ("label", "fold"))
    return ToxicityModel(words, starts, fit_trees(x, y), fit_isotonic(cross_margins(x, y, fold), y))


def score(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """``docs(text, ...)`` -> ``(rec, score)``, a row per input row; rec holds the columns ``keep`` (all).

    score lies in 0..1; null texts count as empty and get the score of a text without words;
    copies, and rows repeated in every column, get equal scores. A text's tokens are read one after the
    other and only counts are kept, so a very long text needs a few times its own size. An empty table
    gives an empty result.
    """
    return map_texts(docs, keep, lambda texts: [pa.array(model.scores(texts), pa.float64())], "score double")


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """Train and score all of ``docs``: ``(doc_id, held_out, score, predicted)``."""
    model = fit(docs, labels, modulus, held_out)
    return score(docs, model, ["doc_id"]).select(
        "rec.doc_id",
        (id_remainder(F.col("rec.doc_id"), modulus) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
