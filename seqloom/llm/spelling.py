"""Spelling variants: words one edit apart, found through groups of words, never through pairs.

A word with one code point wiped out, or left out, is a pattern. Words that share a wiped pattern
(position, prefix, suffix) differ in that code point alone; a word that equals another with one
code point left out differs from it by an insertion. A group needs its size and its two best words
only: a word's best neighbour there is the best word, or for that one the second. So each word
gets a count and a best neighbour from each of its patterns, and these are added up by word.

Words are numbered in the order that decides between neighbours, largest n first and then by code
points, so the smallest number is the best, and patterns carry numbers instead of texts. A pattern
is named by polynomial hashes of the whole pattern modulo 2^61 - 1 under two bases, made from
those of prefix and suffix; a word of any length costs a fixed number of bytes for each code point.
Two of 10^11 patterns share a name with a probability below 10^-11.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import discard, materialize

LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form occurs this many times as often as the word at least.
TIMES = 10
#: Of so many different runs one loses a code point.
ONE_IN = 31
#: Different words that a task holds before it hands on their counts.
HELD = 200_000
#: Rows of patterns in one batch.
ROWS = 20_000

#: A run is at least as long as a word; greedy matches begin where a run begins.
_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PRIME = (1 << 61) - 1
_BASES = (1_111_111_111_111_111_111, 1_618_033_988_749_894_848)
WIPED, LEFT_OUT = 0, 1


def words(doc_id: int | None, text: str | None) -> Iterator[str]:
    """The words of a text; some runs lose a code point, as a hash of document and run decides. A null id counts as ''."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for m in _RUN.finditer(text or ""):
        run = m[0].translate(_LOWER)
        h = zlib.crc32(run.encode(), seed)
        if h % ONE_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        yield run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def taken() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        held.clear()
        return rows

    for batch in batches:
        texts = batch.column(1)
        for i, doc_id in enumerate(batch.column(0).to_pylist()):
            for word in words(doc_id, texts[i].as_py()):
                held[word] += 1
                if len(held) >= HELD:
                    yield taken()
    if held:
        yield taken()


def vocabulary(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> a scratch table ``(id, word, n)``; smaller ids are larger n, then smaller words.

    Counts are added up in the tasks before the shuffle. Null texts have no words; documents that
    share an id, or have none, count one by one.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_counts, "word string, n long")
    counted = found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    ranked = counted.repartitionByRange(F.desc("n"), "word").sortWithinPartitions(F.desc("n"), "word")
    return materialize(ranked.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "spelling-words")


class _Hash:
    """Polynomial hashes of a word with a code point wiped or left out, from those of its prefixes and suffixes."""

    def __init__(self, base: int):
        self.base, self.powers = base, [1]

    def patterns(self, codes: list[int]) -> tuple[int, list[int], list[int]]:
        """The word's own hash, and those of its patterns by position."""
        n, base, powers = len(codes), self.base, self.powers
        while len(powers) <= n:
            powers.append(powers[-1] * base % _PRIME)
        suffix = [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            suffix[i] = (suffix[i + 1] + codes[i] * powers[n - 1 - i]) % _PRIME
        whole, prefix, wiped, left = suffix[0], 0, [], []
        for i, code in enumerate(codes):
            rest = powers[n - 1 - i]
            wiped.append((whole - code * rest) % _PRIME)
            left.append((prefix * rest + suffix[i + 1]) % _PRIME)
            prefix = (prefix * base + code) % _PRIME
        return whole, wiped, left


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, length, place, a, b, id, own): a word wiped at each place, with each code point left out, and as it is."""
    first, second = _Hash(_BASES[0]), _Hash(_BASES[1])
    types = [pa.int8(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["kind", "length", "place", "a", "b", "id", "own"]
    out: list[tuple] = []

    def taken() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        out.clear()
        return rows

    for batch in batches:
        for id_, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes = [ord(c) for c in word]
            (whole, wiped, left), (whole2, wiped2, left2) = first.patterns(codes), second.patterns(codes)
            out.append((LEFT_OUT, len(codes), 0, whole, whole2, id_, True))
            for i in range(len(codes)):
                out.append((WIPED, len(codes), i, wiped[i], wiped2[i], id_, False))
                if not i or codes[i] != codes[i - 1]:  # within a run of one code point all deletions are one
                    out.append((LEFT_OUT, len(codes) - 1, 0, left[i], left2[i], id_, False))
                if len(out) >= ROWS:
                    yield taken()
    if out:
        yield taken()


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """``vocabulary(id, word, n)`` -> ``(id, n_near, best)`` of words with a neighbour; ``best`` is its id.

    A wiped group has as many words as there are letters at most; a word has at most as many
    others above it as letters fit into its places. Windows hold one group at a time, and spill.
    """
    patterns = vocabulary.select("id", "word").mapInArrow(_patterns, "kind tinyint, length int, place int, a long, b long, id long, own boolean")
    group = Window.partitionBy("kind", "length", "place", "a", "b")
    longer = F.when(~F.col("own"), F.col("id"))
    seen = patterns.select(
        "kind", "own", "id", F.count(F.lit(1)).over(group).alias("size"),
        F.min("id").over(group).alias("first"), F.lead("id").over(group.orderBy("id")).alias("next"),
        F.min(F.when(F.col("own"), F.col("id"))).over(group).alias("shorter"), F.min(longer).over(group).alias("longer"), F.count(longer).over(group).alias("n_longer"),
    ).where("size > 1")
    replaced = F.struct((F.col("size") - 1).alias("near"), F.when(F.col("id") == F.col("first"), F.col("next")).otherwise(F.col("first")).alias("best"))
    grown = F.struct(F.col("n_longer").alias("near"), F.col("longer").alias("best"))
    shrunk = F.struct(F.lit(1).cast("long").alias("near"), F.col("shorter").alias("best"))
    told = seen.select("id", F.when(F.col("kind") == WIPED, replaced).when(F.col("own"), grown).when(F.col("shorter").isNotNull(), shrunk).alias("x")).where("x is not null")
    return told.groupBy("id").agg(F.sum("x.near").alias("n_near"), F.min("x.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``forms(id, form)`` -> ``(id, root)``, the last of the chain of forms, by doubling; n grows tenfold a step, so few rounds do."""
    now = materialize(forms.select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        step = materialize(now.join(further, "root", "left").select("id", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        discard(now)
        now = step
        if now.where("moved").isEmpty():
            return now.select("id", "root")


def variants(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> a row per word: ``(word, form, root, n, n_near, form_n)``.

    form: the near word of largest n, if it is ``TIMES`` as frequent, else null, as is form_n; root: the
    end of the chain of forms, the word itself if it has none. A table without words gives no rows.
    """
    known = vocabulary(docs)
    near = materialize(neighbours(known), "spelling-near")
    ids = known.select(F.col("id").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    told = known.join(near, "id", "left").join(ids, "best", "left")
    has = F.col("best_n") >= TIMES * F.col("n")
    listed = materialize(
        told.select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best")).alias("form_id"),
            F.when(has, F.col("best_word")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"),
        ), "spelling-forms",
    )
    discard(near)
    roots = _roots(listed.where("form_id is not null").select("id", F.col("form_id").alias("form")))
    named = roots.join(known.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return listed.join(named, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def oracle() -> str:
    """SQL for the variants, with near words as pairs; for small tables. Letters beyond ASCII are two bytes in UTF-8."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    table = f"list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda x, i: {step}))"
    codes = "flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda a, b: xor(crcs[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)"
    return f"""WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}')), '{upper}', '{lower}') AS run FROM documents),
hashed AS (SELECT run, {crc} AS h FROM runs, (SELECT {table} AS crcs)),
found AS (SELECT CASE WHEN h % {ONE_IN} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
voc AS (SELECT word, count(*) AS n FROM found WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING count(*) >= {LEAST_COUNT}),
cut AS (SELECT word, n, i, substr(word, 1, i::INT) AS a, substr(word, i::INT + 2) AS b FROM voc, unnest(range(length(word))) u(i)),
shorter AS (SELECT DISTINCT word, n, a || b AS rest FROM cut),
pairs AS (SELECT x.word, x.n, y.word AS other, y.n AS m FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT s.word, s.n, v.word, v.n FROM shorter s JOIN voc v ON v.word = s.rest
  UNION ALL SELECT v.word, v.n, s.word, s.n FROM shorter s JOIN voc v ON v.word = s.rest),
best AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * v.n THEN other END AS form, CASE WHEN m >= {TIMES} * v.n THEN m END AS form_n FROM voc v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM formed UNION ALL SELECT w.word, f.form FROM walk w JOIN formed f ON f.word = w.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM formed f JOIN walk w USING (word) JOIN formed e ON e.word = w.root AND e.form IS NULL"""
