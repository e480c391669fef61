"""Quality rules as learned decision lists, evaluated with built-in Spark expressions only.

Text statistics are columns. From the statistics of labelled documents a decision list is learned
by sequential covering: for either verdict a rule, a conjunction of thresholds, is grown on one part
of the labelled rows by information gain and pruned on the other, and the more accurate of the two
joins the list; the rows it covers are set aside and the next rule is learned, until no rule is
accurate enough. The list becomes one ordered conditional expression: the first rule that holds
gives the verdict, so an earlier rule that keeps shields from a later one that drops, and the last
rule, which has no test, gives the verdict that most of the remaining rows deserve.

Window repeats are found inside each row: hashes of all five-word windows are sorted and compared
with their neighbours, so nothing is shuffled and no row is multiplied.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import WORD, discard, labelled_sample

#: Bound of the labelled sample the rules are learned from, in documents.
SAMPLE = 8000
WINDOW = 5

#: What rules may test; each is a ratio or a count that any text has.
TESTED = (
    "n_words", "n_repeat_share", "n_dup_line_share", "symbols_per_word", "chars_per_word",
    "capitals_per_char", "bangs_per_word", "bars_per_word", "digits_per_char", "words_per_line", "distinct_share",
)


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``docs(text, ...)`` -> ``(keep..., n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ...)``.

    A null text counts as a text without words. n_repeat_words: words that lie in a five-word
    window found twice or more in the text, all its occurrences included. The columns of
    ``TESTED`` follow.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("_text")).withColumn(
        "_words", F.regexp_extract_all("_text", F.lit(f"({WORD})"), F.lit(1))
    )
    count = F.size("_words")
    hashed = cut.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    last = F.greatest(count - WINDOW, F.lit(0))
    at = lambda i, k: F.get(F.col("_hash"), i + k)
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))
    hashed = hashed.withColumn("_windows", F.when(count >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    # hashes that occur more than once, found as equal neighbours after sorting; most texts have none
    hashed = hashed.withColumn("_sorted", F.sort_array("_windows"))
    twice = F.array_distinct(F.filter("_sorted", lambda h, i: h == F.get(F.col("_sorted"), i + 1)))
    hashed = hashed.withColumn("_twice", twice)
    # only for texts with repeats: (hash, place) sorted, places whose hash has an equal neighbour, in order
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    hashed = hashed.withColumn("_placed", F.when(F.size("_twice") > 0, placed))
    beside = lambda i: (F.get(F.col("_placed"), i + 1)["h"], F.get(F.col("_placed"), i - 1)["h"])
    repeated = F.filter(
        "_placed",
        lambda p, i: F.coalesce(p["h"] == beside(i)[0], F.lit(False)) | F.coalesce(p["h"] == beside(i)[1], F.lit(False)),
    )
    hashed = hashed.withColumn("_places", F.sort_array(F.transform(repeated, lambda p: p["i"])))
    covered = F.aggregate(
        F.transform("_places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_places"), i + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, b: a + b,
    )
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    figures = F.struct(
        count.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).alias("_capitals"),
        F.regexp_count("_text", F.lit(r"[!?]")).alias("_bangs"),
        F.regexp_count("_text", F.lit(r"\|")).alias("_bars"),
        F.regexp_count("_text", F.lit(r"[0-9]")).alias("_digits"),
        F.size(F.array_distinct("_words")).alias("_distinct"),
    )
    # the one-element explode keeps later filters from being moved, and copied, into the functions above
    kept = [F.col(f"`{c}`") for c in keep]
    counted = hashed.withColumn("_lines", lines).select(*kept, F.explode(F.array(figures)).alias("_figures")).select(*kept, "_figures.*")
    n, chars = F.col("n_words"), F.col("word_chars")
    return counted.select(
        *[F.col(f"`{c}`") for c in keep],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        _safe(F.col("n_repeat_words"), n).alias("n_repeat_share"),
        _safe(F.col("n_dup_lines"), F.col("n_lines")).alias("n_dup_line_share"),
        _safe(F.col("n_symbols"), n).alias("symbols_per_word"),
        _safe(chars, n).alias("chars_per_word"),
        _safe(F.col("_capitals"), chars).alias("capitals_per_char"),
        _safe(F.col("_bangs"), n).alias("bangs_per_word"),
        _safe(F.col("_bars"), n).alias("bars_per_word"),
        _safe(F.col("_digits"), chars).alias("digits_per_char"),
        _safe(n, F.col("n_lines")).alias("words_per_line"),
        _safe(F.col("_distinct"), n).alias("distinct_share"),
    )


@dataclass(frozen=True)
class Test:
    """One threshold: ``column >= bound`` or ``column < bound``."""

    column: str
    above: bool
    bound: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, TESTED.index(self.column)]
        return v >= self.bound if self.above else v < self.bound

    def expression(self) -> Column:
        return F.col(self.column) >= F.lit(self.bound) if self.above else F.col(self.column) < F.lit(self.bound)

    def __str__(self) -> str:
        return f"{self.column} {'>=' if self.above else '<'} {self.bound:.4g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction of tests and the verdict where it holds."""

    tests: tuple[Test, ...]
    keep: bool

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for t in self.tests:
            out &= t.holds(x)
        return out

    def __str__(self) -> str:
        return (" and ".join(map(str, self.tests)) or "otherwise") + (" -> keep" if self.keep else " -> drop")


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional expression over the statistics columns; what no rule covers is kept."""
    out = None
    for r in rules:
        condition = F.lit(True)
        for t in r.tests:
            condition = condition & t.expression()
        out = F.when(condition, F.lit(r.keep)) if out is None else out.when(condition, F.lit(r.keep))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def decide(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    """What :func:`verdict` says, for rows of statistics in the order of ``TESTED``."""
    out, open_ = np.ones(len(x), bool), np.ones(len(x), bool)
    for r in rules:
        hit = open_ & r.holds(x)
        out[hit] = r.keep
        open_ &= ~hit
    return out


def _candidates(x: np.ndarray, wanted: np.ndarray, steps: int = 24) -> list[Test]:
    """Thresholds at quantiles of each statistic, over all rows, the wanted ones and the others."""
    out = []
    for j, name in enumerate(TESTED):
        cuts = set()
        for part in (x[:, j], x[wanted, j], x[~wanted, j]):
            if len(part):
                cuts |= set(np.unique(np.quantile(part, np.linspace(0.02, 0.98, steps))).tolist())
        out += [Test(name, above, float(f"{c:.6g}")) for c in sorted(cuts) for above in (True, False)]
    return out


def _grow(x: np.ndarray, wanted: np.ndarray, candidates: list[Test], most: int = 4) -> list[Test]:
    """Add the test of highest information gain until only wanted rows are covered."""
    masks = np.array([t.holds(x) for t in candidates])
    covered, tests = np.ones(len(x), bool), []
    while len(tests) < most and (covered & ~wanted).any():
        p0, n0 = (covered & wanted).sum(), (covered & ~wanted).sum()
        p = (masks & (covered & wanted)).sum(axis=1)
        n = (masks & (covered & ~wanted)).sum(axis=1)
        gain = p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(p0 / (p0 + n0)))
        best = int(gain.argmax())
        if gain[best] <= 1e-6:
            break
        tests.append(candidates[best])
        covered &= masks[best]
    return tests


def _counts(tests: list[Test], x: np.ndarray, wanted: np.ndarray) -> tuple[int, int]:
    hit = Rule(tuple(tests), True).holds(x)
    return int((hit & wanted).sum()), int((hit & ~wanted).sum())


def _worth(tests: list[Test], x: np.ndarray, wanted: np.ndarray) -> float:
    p, n = _counts(tests, x, wanted)
    return (p - n) / (p + n) if p + n else -1.0


def _best_rule(keep: bool, x: np.ndarray, good: np.ndarray, part: np.ndarray, least: int, precision: float) -> tuple[float, Rule] | None:
    """A grown and pruned rule of one verdict with its accuracy, if it covers enough rows and is right often enough."""
    wanted = good == keep
    if (wanted & part).sum() < least or not (~wanted).any():
        return None
    tests = _grow(x[part], wanted[part], _candidates(x[part], wanted[part]))
    while len(tests) > 1 and _worth(tests[:-1], x[~part], wanted[~part]) >= _worth(tests, x[~part], wanted[~part]):
        tests = tests[:-1]
    p, n = _counts(tests, x, wanted)
    if not tests or p < least or p < precision * (p + n):
        return None
    return (p + 1) / (p + n + 2), Rule(tuple(tests), keep)


def learn(x: np.ndarray, good: np.ndarray, most_rules: int = 12, precision: float = 0.8, least: int = 5, seed: int = 17) -> list[Rule]:
    """Sequential covering with rules of both verdicts; ``x`` has the columns of ``TESTED``.

    Rules are grown on two thirds of the rows not yet covered and pruned on the rest, by dropping
    last tests while that does not lower (p - n) / (p + n). Of a rule that drops and one that keeps,
    the one that is right more often comes first. Learning ends when no rule covers ``least`` rows
    and is right as often as ``precision``. The last rule holds for all that is left.
    """
    rules: list[Rule] = []
    good = good.astype(bool)
    part = np.random.default_rng(seed).random(len(x)) < 2 / 3
    left = np.ones(len(x), bool)
    while len(rules) < most_rules and left.any():
        found = [r for keep in (False, True) if (r := _best_rule(keep, x[left], good[left], part[left], least, precision))]
        if not found:
            break
        rule = max(found, key=lambda r: r[0])[1]
        rules.append(rule)
        left &= ~rule.holds(x)
    return [*rules, Rule((), bool(good[left].mean() >= 0.5) if left.any() else True)]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = SAMPLE, seed: int = 31) -> list[Rule]:
    """Learn a decision list from the statistics of at most about ``max_rows`` labelled documents.

    Documents are drawn by a seeded hash of doc_id. Ids with several labels take their mean.
    """
    sample = labelled_sample(docs, labels, "quality", max_rows, seed)
    rows = with_statistics(sample, "doc_id", "label").select("doc_id", "label", *TESTED).orderBy("doc_id").collect()
    discard(sample)
    x = np.array([[float(r[c]) for c in TESTED] for r in rows]).reshape(len(rows), len(TESTED))
    return learn(x, np.array([r["label"] for r in rows], dtype=bool))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs(doc_id, text)`` -> base statistics, ``base_failed`` and ``kept``, a row per input row.

    base_failed: fewer than 10 words, or more than a fifth of the words in repeated windows. kept:
    false if base_failed, else the verdict of the list. Null and empty texts have no words and fail;
    repeated rows get equal answers; a long text costs memory for its own words only; an empty table
    gives an empty result.
    """
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return with_statistics(docs, "doc_id").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"),
    )
