"""Mixing sources to target weights by Pareto order sampling.

A source's target divided by its size says how often each of its documents is due. The whole part
is allocated to every document for certain. What is left is drawn without replacement and with
unequal probabilities: a document's inclusion probability is proportional to its size, and
documents are ranked by the odds of a random number divided by the odds of inclusion (Pareto order
sampling). Documents so large that they would be included with a probability of one or more are
taken for certain first, and the rest is drawn for what they leave. The sample has a fixed size,
counted in words: it ends at the rank where the words come nearest to what was left. Random numbers
are made from the md5 of doc_id, text and, of rows repeated in every column, the copy's number, so
reruns and other engines agree, and rows that share an id are drawn one by one.

No source is ever sorted in one task: ranks are counted in bins first, and only the documents of
the one bin in which a source's sample ends are ordered. Repeated rows are counted before they are
numbered, so that they travel once, however many they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import WORD, discard, materialize

#: Bins of the rank key; the bin where the sample ends holds about this share of a source's documents.
BINS = 4096
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
#: Copies of a repeated row that are made in one task.
LOT = 10_000
#: What the order of documents in a source goes by.
ORDER = ("rank", "doc_id", "size", "text_hash", "number", "row_hash")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _text_hash(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def uniform(doc_id: Column, text_hash: Column, number: Column) -> Column:
    """A number inside (0, 1) from the first 13 hex digits of the md5 of id, text hash and copy number."""
    whole = F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("null")), text_hash, number.cast("string"))
    digits = F.substring(F.md5(whole.cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """``sizes(source, source_size)`` -> with ``target`` added: weighted shares, none above ``most`` times its source.

    Sources in code-point order, null last, take the weights in turn. Pouring the excess of capped
    sources over the others until none is above equals one level c with target
    ``min(most * size, c * weight)``: in ascending order of ``most * size / weight`` a prefix is
    capped, and c is what remains for the rest a unit of weight.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.lit(float(weights[-1]))
    for i, w in reversed(list(enumerate(weights[:-1]))):
        weight = F.when(F.col("turn") % len(weights) == i, F.lit(float(w))).otherwise(weight)
    ranked = sizes.withColumn("turn", turn).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    up_to = Window.orderBy((F.col("cap") / F.col("weight")), "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_rows = Window.partitionBy()
    poured = (
        ranked.withColumn("room", F.sum("source_size").over(all_rows) * F.lit(share))
        .withColumn("capped_before", F.sum("cap").over(up_to) - F.col("cap"))
        .withColumn("weight_from", F.sum("weight").over(all_rows) - F.sum("weight").over(up_to) + F.col("weight"))
        .withColumn("level", (F.col("room") - F.col("capped_before")) / F.col("weight_from"))
    )
    # the first source whose cap its level does not reach begins the uncapped rest
    first = F.min(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "turn", "level"))).over(all_rows)
    return poured.withColumn("first", first).select(
        "source",
        "source_size",
        F.when(
            F.col("first").isNull() | (F.struct((F.col("cap") / F.col("weight")).alias("at"), "turn") < F.struct("first.at", "first.turn")),
            F.col("cap").cast("double"),
        )
        .otherwise(F.col("first.level") * F.col("weight"))
        .alias("target"),
    )


def _certain(counted: DataFrame) -> DataFrame:
    """``counted(source, size, words, source_size, target)`` -> a row per source with target, certain copies and certain sizes.

    ``from_size``: documents of that size or more are certain; ``left`` and ``squares`` are of the others.
    Sizes are walked from the largest down, each taken for certain if the larger ones gone it would
    be included with a probability of one or more; once a size is not, no smaller one is. Goes by the
    different sizes of a source, not by its documents.
    """
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    above, below = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    sure_copies = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long")
    walked = (
        counted.withColumn("sure", sure_copies)
        .withColumn("squares", F.sum((F.col("words").cast("decimal(38,0)") * F.col("size")).cast("decimal(38,0)")).over(below).cast("double"))
        .withColumn("left", F.col("target") - F.col("sure") * F.col("source_size") - F.coalesce(F.sum("words").over(above), F.lit(0)))
    )
    # a source without words has no squares
    certain = (F.col("left") > 0) & F.coalesce(F.try_divide(F.col("left") * F.col("size"), "squares") >= 1, F.lit(False))
    ends = walked.groupBy("source").agg(
        *[F.first(c).alias(c) for c in ("source_size", "target", "sure")],
        F.min(F.when(certain, F.col("size"))).alias("from_size"),
        F.max(F.when(~certain & (F.col("size") > 0), F.struct("size", "left", "squares"))).alias("rest"),
    )
    return ends.select("source", "source_size", "target", "sure", "from_size", F.coalesce("rest.left", F.lit(0.0)).alias("left"), F.col("rest.squares").alias("squares"))


def _ranked(sized: DataFrame, goals: DataFrame, bins: int) -> DataFrame:
    """``sized`` with its source's row of ``goals``, whether it is certain, the rank and its bin."""
    joined = sized.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    certain = F.coalesce(F.col("size") >= F.col("from_size"), F.lit(False))
    chance = F.col("left") * F.col("size") / F.col("squares")
    u = uniform(F.col("doc_id"), F.col("text_hash"), F.col("number"))
    odds = F.try_divide(chance, 1 - chance)  # certain documents have none
    rank = F.when((F.col("size") > 0) & ~F.col("certain") & (F.col("left") > 0), F.try_divide(u / (1 - u), odds))
    return joined.withColumn("certain", certain).withColumn("rank", rank).withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * bins).cast("int"))


def cutoffs(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, bins: int = BINS) -> DataFrame:
    """Numbered ``sized`` rows -> a row per source: target, certain copies, certain sizes, and where its sample ends.

    The sample holds the bins before ``last_bin`` and, in that bin, what is ordered up to ``cut``.
    ``last_bin`` is null where all documents with a rank belong to it.
    """
    # a row for each source and size: what a source's target and its certain documents go by
    counted = materialize(sized.groupBy("source", "size").agg(F.sum("size").alias("words")), "mix-counted")
    goals = targets(counted.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most).withColumnRenamed("source", "s")
    goals = materialize(_certain(counted.join(goals, F.col("source").eqNullSafe(F.col("s"))).drop("s")), "mix-goals")
    ranked = _ranked(sized, goals, bins).where("bin is not null").select("source", "left", "bin", *ORDER)
    # words of each bin, and of all bins before it: at most `bins` rows a source
    of_bins = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bin")) - F.col("words")
    ending = materialize(
        of_bins.withColumn("before", before)
        .where((F.col("before") < F.col("left")) & (F.col("before") + F.col("words") >= F.col("left")))
        .select(F.col("source").alias("s"), F.col("bin").alias("last_bin"), "before"),
        "mix-bins",
    )
    inside = ranked.join(ending, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("last_bin")))
    in_order = Window.partitionBy("source").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("end", F.col("before") + F.sum("size").over(in_order))
    # the document at which the words pass what is left belongs to the sample if that comes nearer
    chosen = (F.col("end") <= F.col("left")) | (F.col("end") - F.col("left") < F.col("left") - (F.col("end") - F.col("size")))
    cuts = inside.where(chosen).groupBy("s").agg(F.max(F.struct(*ORDER)).alias("cut")).withColumnRenamed("s", "c")
    ends = ending.drop("before").join(cuts, F.col("s").eqNullSafe(F.col("c")), "left").drop("c")
    out = materialize(goals.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "mix-cutoffs")
    discard(counted, goals, ending)
    return out


def _copies(sized: DataFrame, cuts: DataFrame, bins: int) -> DataFrame:
    inside = (F.col("bin") == F.col("last_bin")) & (F.struct(*ORDER) <= F.col("cut"))
    drawn = F.col("bin").isNotNull() & (F.col("last_bin").isNull() | (F.col("bin") < F.col("last_bin")) | F.coalesce(inside, F.lit(False)))
    return _ranked(sized, cuts, bins).withColumn("copies", F.col("sure") + (F.col("certain") | drawn).cast("long"))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    """Slim rows of ``docs``; text_hash and row_hash together name a row's contents."""
    whole = F.struct(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
        _text_hash(F.col("text")).alias("text_hash"), F.xxhash64(F.lit(29), whole).alias("row_hash"), *more,
    )


CONTENTS = ("doc_id", "source", "size", "text_hash", "row_hash")


def _numbered(sized: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``sized`` with ``number``, 0, 1, ... among rows of equal contents, and the contents that occur more than once (or None)."""
    repeats = materialize(sized.groupBy("text_hash", "row_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("text_hash", "row_hash"), "mix-repeats")
    if repeats.isEmpty():
        discard(repeats)
        return sized.withColumn("number", F.lit(0).cast("long")), None
    key = ["text_hash", "row_hash"]
    singles = sized.join(repeats, key, "left_anti").select(*CONTENTS, F.lit(0).cast("long").alias("number"))
    counted = sized.join(repeats, key, "left_semi").groupBy(*CONTENTS).agg(F.count(F.lit(1)).alias("n"))
    return singles.unionByName(_again(counted, F.col("n"), "number").select(*CONTENTS, "number")), repeats


def _again(rows: DataFrame, times: Column, number: str) -> DataFrame:
    """Every row ``times`` times with its ``number``, at most ``LOT`` of them made in one task."""
    lots = rows.withColumn("_times", times.cast("long")).where("_times > 0").withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / LOT))))
    lots = lots.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[F.col(c) for c in ("text_hash", "row_hash", "_lot")])
    first = F.col("_lot") * LOT
    return lots.withColumn(number, F.explode(F.sequence(first, F.least(first + LOT, F.col("_times")) - 1))).drop("_times", "_lot")


def plan(docs: DataFrame, bins: int = BINS, **options) -> DataFrame:
    """``docs(doc_id, text, source)`` -> ``(doc_id, source, size, source_size, target, copies, taken)``, a row per input row.

    copies: how often the mix takes the document; taken = copies * size, so at most ``most`` times
    its size. Null texts have size 0 and get the certain copies only. Rows that share an id, null
    ids too, are drawn one by one; of rows equal in every column as many are taken as the draw says.
    """
    sized = materialize(_sized(docs), "mix-sizes")
    numbered, repeats = _numbered(sized)
    if repeats is not None:
        numbered = materialize(numbered, "mix-numbered")
    out = _copies(numbered, cutoffs(numbered, bins=bins, **options), bins)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, bins: int = BINS, **options) -> DataFrame:
    """The mixed documents themselves: every row of ``docs`` as often as :func:`plan` says, all columns kept.

    Texts are not shuffled: each row is decided upon by its source's cutoff, a row of a small table.
    Only rows equal in every column are brought together, one of each a task, and made again.
    """
    sized = materialize(_sized(docs), "mix-sizes")
    numbered, repeats = _numbered(sized)
    if repeats is not None:
        numbered = materialize(numbered, "mix-numbered")
    cuts = cutoffs(numbered, bins=bins, **options)
    key = ["text_hash", "row_hash"]
    whole = _sized(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec"))
    singles = whole if repeats is None else whole.join(repeats, key, "left_anti")
    out = _copies(singles.withColumn("number", F.lit(0).cast("long")), cuts, bins).select(
        "rec", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    )
    out = out.select("rec")
    if repeats is not None:
        due = _copies(numbered.join(repeats, key, "left_semi"), cuts, bins).groupBy(*key).agg(F.sum("copies").alias("due"))
        one = whole.join(repeats, key, "left_semi").groupBy(*key).agg(F.first("rec").alias("rec"))
        out = out.unionByName(_again(one.join(due, key), F.col("due"), "_number").select("rec"))
    return out.select("rec.*")


def oracle(weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> str:
    """The same plan as DuckDB SQL, with an ordinary running sum in place of bins."""
    cases = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(weights))
    return f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS th,
         row_number() OVER (PARTITION BY source, doc_id, text) - 1 AS number FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS turn FROM sized GROUP BY source),
ranked AS (
  SELECT *, (CASE turn % {len(weights)} {cases} END)::DOUBLE AS weight, source_size * {most} AS cap FROM sources),
poured AS (
  SELECT *, cap / weight AS ratio,
         (sum(source_size) OVER ()::DOUBLE * {share} - (sum(cap) OVER w - cap)::DOUBLE)
           / (sum(weight) OVER () - sum(weight) OVER w + weight) AS level
  FROM ranked WINDOW w AS (ORDER BY cap / weight, turn ROWS UNBOUNDED PRECEDING)),
first_open AS (SELECT ratio, turn, level FROM poured WHERE ratio > level ORDER BY ratio, turn LIMIT 1),
goals AS (
  SELECT p.source, p.source_size,
         CASE WHEN f.ratio IS NULL OR p.ratio < f.ratio OR (p.ratio = f.ratio AND p.turn < f.turn) THEN p.cap::DOUBLE
              ELSE f.level * p.weight END AS target
  FROM poured p LEFT JOIN first_open f ON true),
due AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS sure FROM goals),
walked AS (
  SELECT source, size, sum(count(*) * size) OVER w - count(*) * size AS words_above,
         sum(sum(size::HUGEINT * size)) OVER (PARTITION BY source) - sum(sum(size::HUGEINT * size)) OVER w + sum(size::HUGEINT * size) AS squares
  FROM sized WHERE size > 0 GROUP BY source, size WINDOW w AS (PARTITION BY source ORDER BY size DESC ROWS UNBOUNDED PRECEDING)),
chances AS (
  SELECT d.*, w.size, d.target - d.sure * d.source_size - w.words_above AS rest, w.squares::DOUBLE AS squares
  FROM walked w JOIN due d ON w.source IS NOT DISTINCT FROM d.source),
judged AS (SELECT *, rest > 0 AND rest * size / squares >= 1 AS is_sure FROM chances),
ends_at AS (
  SELECT source, min(size) FILTER (is_sure) AS from_size, arg_max(rest, size) FILTER (NOT is_sure) AS due_left,
         arg_max(squares, size) FILTER (NOT is_sure) AS squares FROM judged GROUP BY source),
drawn AS (
  SELECT s.doc_id, s.size, s.th, s.number, d.*, coalesce(e.due_left, 0) AS due_left, e.squares, coalesce(s.size >= e.from_size, false) AS certain,
         (('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, 'null') || '/' || s.th || '/' || s.number), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)} AS u
  FROM sized s JOIN due d ON s.source IS NOT DISTINCT FROM d.source LEFT JOIN ends_at e ON s.source IS NOT DISTINCT FROM e.source),
chance AS (
  SELECT *, due_left * size / squares AS p, size > 0 AND NOT certain AND due_left > 0 AS takes_part FROM drawn),
odds AS (
  SELECT *, CASE WHEN takes_part THEN (u / (1 - u)) / (p / (1 - p)) END AS rk FROM chance),
ends AS (
  SELECT *, sum(CASE WHEN takes_part THEN size ELSE 0 END) OVER
    (PARTITION BY source ORDER BY rk NULLS LAST, doc_id NULLS FIRST, size, th, number ROWS UNBOUNDED PRECEDING) AS stop FROM odds)
SELECT doc_id, size, source_size, target,
       ((sure + CASE WHEN certain OR (takes_part AND (stop <= due_left OR stop - due_left < due_left - (stop - size))) THEN 1 ELSE 0 END)
         * size)::BIGINT AS taken
FROM ends"""
