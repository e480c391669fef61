"""Byte-level BPE encoding by speculation and verification, and decoding.

A text is cut at the vocabulary's special tokens and then into words. A word's tokens are first
guessed by greedy longest match. A sequence of tokens is what the merges would produce exactly
when that holds for every two neighbours alone, so one vectorised pass over all neighbours of a
batch checks the guesses against a table of pair verdicts; pairs not met before are judged once by
merging their bytes. Only words with a failing pair go through exact merging.

The vocabulary file is a parameter; the driver reads it and broadcasts its bytes (a few MB).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from seqloom.llm.common import map_texts

#: Fixed value: how byte-level vocabularies of this family split text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same for texts of Latin-1 characters only, for the faster standard module.
LATIN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+"
    r"| ?[^ \t-\r\x85\xa0A-Za-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-\xff]+"
    r"|[ \t-\r\x85\xa0]+(?![^ \t-\r\x85\xa0])|[ \t-\r\x85\xa0]+"
)

#: Words and pairs that a task remembers at most; beyond, the memory is emptied and fills again.
REMEMBER = 600_000
#: Characters of a word up to which it is remembered from one batch to the next.
LONG = 200

#: Stands for the rank of a pair that never merges.
NEVER = 1 << 60


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


@dataclass
class Codec:
    """Encoder and decoder of one vocabulary."""

    tokens: list[bytes]  # bytes of each id
    ids: dict[bytes, int]  # ordinary tokens
    ranks: dict[tuple[int, int], int]  # of mergeable pairs
    made: list[int]  # id that the pair of each rank becomes
    special: dict[str, int]
    proposed: dict[bytes, int] = field(default_factory=dict)  # tokens that their own bytes merge into
    reach: dict[bytes, int] = field(default_factory=dict)  # first two bytes -> longest such token
    words: dict[str, bytes] = field(default_factory=dict)  # ids as little-endian 32-bit integers
    verdicts: dict[int, bool] = field(default_factory=dict)

    @classmethod
    def from_json(cls, raw: bytes) -> Codec:
        spec = json.loads(raw)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        tokens = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for t, i in special.items():
            tokens[i] = t.encode()
        ids = {}
        for t, i in vocab.items():
            if t not in special:
                tokens[i] = bytes(letters[c] for c in t)
                ids[tokens[i]] = i
        ranks, made = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            ranks[vocab[left], vocab[right]] = rank
            made.append(vocab[left + right])
        codec = cls(tokens, ids, ranks, made, special)
        codec.proposed = {b: i for b, i in ids.items() if len(b) == 1 or codec.merge(b) == [i]}
        for b in codec.proposed:
            codec.reach[b[:2]] = max(len(b), codec.reach.get(b[:2], 1))
        codec.splitter, codec.latin = regex.compile(PATTERN), re.compile(LATIN)
        codec.cutter = regex.compile("|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
        return codec

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: again and again the pair of lowest rank, leftmost first."""
        parts = [self.ids[word[i : i + 1]] for i in range(len(word))]
        if len(parts) > 64:
            return self._merge_long(parts)
        rank = self.ranks.get
        ranks = [rank(pair, NEVER) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [self.made[best]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), NEVER)
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), NEVER)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same for long words, with a heap of pairs over a linked list: n log n."""
        n = len(parts)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        rank = self.ranks.get
        heap = [(r, i, *pair) for i, pair in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank(pair, NEVER)) < NEVER]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], after[i] = self.made[best], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else n
                if y < n and (r := rank((parts[x], parts[y]), NEVER)) < NEVER:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p, ok in zip(parts, alive, strict=True) if ok]

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.splitter.findall(text)
        return self.latin.findall(text)

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, proposed, reach, n = [], 0, self.proposed.get, self.reach.get, len(word)
        while at < n:
            end = min(n, at + reach(word[at : at + 2], 1))
            while (token := proposed(word[at:end])) is None:
                end -= 1
            out.append(token)
            at = end
        return out

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """Whether the two tokens of each pair (left * size + right) stay as they are when merged alone."""
        unique, inverse = np.unique(keys, return_inverse=True)
        size, known = len(self.tokens), self.verdicts
        verdict = np.empty(len(unique), bool)
        for i, k in enumerate(unique.tolist()):
            ok = known.get(k)
            if ok is None:
                left, right = divmod(k, size)
                ok = known[k] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
            verdict[i] = ok
        return verdict[inverse]

    def encode_words(self, words: list[str]) -> None:
        """Make sure that all ``words`` are in the memory: propose, check all pairs at once, mend."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        guesses = [self.propose(w) for w in raw]
        lengths = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        ok = self.compatible(flat[inner] * len(self.tokens) + flat[inner + 1])
        failing = np.unique(owner[inner[~ok]])
        for i in failing.tolist():
            guesses[i] = self.merge(raw[i])
        packed = flat.astype("<u4").tobytes() if not len(failing) else np.fromiter((t for g in guesses for t in g), "<u4").tobytes()
        ends = np.cumsum(np.fromiter(map(len, guesses), np.int64, len(guesses))) * 4
        self.words.update(zip(words, map(packed.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist())), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.words) > REMEMBER:
            self.words.clear()
        if len(self.verdicts) > REMEMBER:
            self.verdicts.clear()
        segments = [[(text, None)] for text in texts]
        for own, text in zip(segments, texts, strict=True):
            cuts = list(self.cutter.finditer(text)) if any(t in text for t in self.special) else []
            if cuts:
                ends = [0, *(m.end() for m in cuts)]
                own[:] = [(text[at : m.start()], self.special[m[0]]) for at, m in zip(ends, cuts, strict=False)] + [(text[ends[-1] :], None)]
        pieces = [[(self.split(t), token) for t, token in own] for own in segments]
        fresh = set().union(*(words for own in pieces for words, _ in own)) - self.words.keys()
        self.encode_words(list(fresh))
        packed = self.words.__getitem__
        out = []
        for own in pieces:
            raw = [b"".join(map(packed, words)) + (b"" if token is None else token.to_bytes(4, "little")) for words, token in own]
            out.append(np.frombuffer(b"".join(raw), "<u4"))
        for word in fresh:
            if len(word) > LONG:
                del self.words[word]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec_of(raw: bytes) -> Codec:
    """The codec of a vocabulary file's bytes, built once in a process."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec.from_json(raw)
    return _CODECS[key]


def encode_decode(docs: DataFrame, vocab_path: str, keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text: ``(rec, n_tokens, ids_sha256, decoded_sha256[, ids, decoded])``.

    rec holds the columns ``keep`` of ``docs`` (all if None). A null text counts as empty. The
    hashes are of the ids as little-endian unsigned 32-bit integers and of the decoded text in
    UTF-8. ``with_ids`` adds the ids and the decoded text themselves. A text is coded whole, however
    long, in memory some times its size; rows repeated in every column get equal results, and an empty
    table gives an empty one.
    """
    with open(vocab_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(texts: list[str | None]) -> list[pa.Array]:
        codec = codec_of(shared.value)
        ids = codec.encode([t or "" for t in texts])
        decoded = [codec.decode(i) for i in ids]
        out = [
            pa.array([len(i) for i in ids], pa.int64()),
            pa.array([hashlib.sha256(i.tobytes()).hexdigest() for i in ids], pa.string()),
            pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
        ]
        if with_ids:
            out += [pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64())), pa.array(decoded, pa.string())]
        return out

    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids
    return map_texts(docs, keep, run, added, done=lambda: codec_of(shared.value).words.clear())
