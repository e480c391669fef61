"""Count normalisation: frequency, median of ratios, quantile. Learn on a matrix, apply to a matrix.

A learned model is a small table that can be written and read again: a factor per sample, or for
quantiles a value per sample and count.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.sources.scratch import discard, materialize

#: Bytes up to which a quantile table is looked up as broadcast arrays; beyond, by a join.
LOOKUP_BYTES = 64 << 20
#: Ranges a unit of log-ratio in which values are counted before medians are taken.
RANGES = 1024
#: Ranges of ranks that are summed up apart for quantiles.
PLACES = 1024


@dataclass
class Factors:
    """A multiplier per sample."""

    method: str
    values: list[float]

    def transform(self, matrix: DataFrame, out: str = "norm") -> DataFrame:
        """Adds the normalised row as an array of doubles."""
        cells = [F.col("counts")[i] * F.lit(f) for i, f in enumerate(self.values)]
        return matrix.withColumn(out, F.array(*cells))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.method, i, float(f)) for i, f in enumerate(self.values)]
        return spark.createDataFrame(rows, "method string, sample int, factor double")


@dataclass
class Quantiles:
    """``mapping(sample, value, mapped)``: what each count of each sample becomes."""

    mapping: DataFrame
    samples: int

    def transform(self, matrix: DataFrame, out: str = "norm") -> DataFrame:
        """Adds the normalised row. Counts that the model has not seen raise an error."""
        size = self.mapping.agg(F.coalesce(F.max("value"), F.lit(0)).alias("most")).first()["most"]
        if 8 * (size + 1) * self.samples > LOOKUP_BYTES:
            return self._by_join(matrix, out)
        # each count's place is joined, as looking it up in a map would take all counts of the sample each time
        counts = self.mapping.select("sample").distinct().withColumn("value", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size).cast("long"))))
        filled = counts.join(self.mapping, ["sample", "value"], "left").groupBy("sample")
        dense = filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("value", "mapped"))), lambda c: c["mapped"]).alias("at"))
        row = dense.agg(F.map_from_entries(F.collect_list(F.struct("sample", "at"))).alias("m")).select(
            F.transform(F.sequence(F.lit(0), F.lit(self.samples - 1)), lambda i: F.col("m")[i]).alias("__tables")
        )  # one row of at most LOOKUP_BYTES
        cells = [F.coalesce(F.get(F.col("__tables")[i], F.col("counts")[i].cast("int")), F.raise_error(F.lit("count not learned")).cast("double")) for i in range(self.samples)]
        return matrix.crossJoin(F.broadcast(row)).withColumn(out, F.array(*cells)).drop("__tables")

    def _by_join(self, matrix: DataFrame, out: str) -> DataFrame:
        cells = matrix.select("kmer", F.posexplode("counts").alias("sample", "value")).join(self.mapping, ["sample", "value"], "left")
        mapped = F.coalesce("mapped", F.raise_error(F.lit("count not learned")).cast("double"))
        rows = cells.withColumn("mapped", mapped).groupBy("kmer").agg(F.array_sort(F.collect_list(F.struct("sample", "mapped"))).alias("c"))
        return matrix.join(rows.select("kmer", F.transform("c", lambda c: c["mapped"]).alias(out)), "kmer")


def learn_frequency(matrix: DataFrame, samples: int, totals: Sequence[int] | None = None) -> Factors:
    """One over the sample's total; zero for an empty sample. The matrix is not read if the totals are known."""
    if totals is None:
        totals = matrix.agg(*[F.sum(F.col("counts")[i]) for i in range(samples)]).first()
    return Factors("freq", [1.0 / s if s else 0.0 for s in totals])


def medians(cells: DataFrame) -> dict[int, float]:
    """``cells(sample, value)`` -> each sample's exact median.

    Values are counted by narrow ranges first. Only those in the one or two ranges that hold a
    sample's middle are looked at again, grouped by value, so no task ever holds a sample's values.
    """
    of_range = cells.withColumn("part", F.floor(F.col("value") * RANGES).cast("long"))
    counted = of_range.groupBy("sample", "part").agg(F.count(F.lit(1)).alias("n"))
    upward, whole = Window.partitionBy("sample").orderBy("part"), Window.partitionBy("sample")
    placed = counted.withColumn("upto", F.sum("n").over(upward)).withColumn("total", F.sum("n").over(whole))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1  # ranks of the middle, from one
    middle = materialize(
        placed.withColumn("low", low).withColumn("high", high).where("upto >= low and upto - n < high")
        .select("sample", "part", (F.col("upto") - F.col("n")).alias("before"), "low", "high"), "median-ranges",
    )
    # at most two rows a sample
    inside = of_range.join(F.broadcast(middle), ["sample", "part"]).groupBy("sample", "part", "before", "low", "high", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = inside.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("sample", "part").orderBy("value")))
    ends = ranked.where("upto >= low and upto - n < high").groupBy("sample").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    out = {r["sample"]: (r["a"] + r["b"]) / 2 for r in ends.collect()}  # a row per sample
    discard(middle)
    return out


def learn_deseq(matrix: DataFrame, samples: int) -> Factors:
    """Median of ratios to the row's geometric mean, over rows without zeros; one where there is no such row.

    The matrix is read twice: keep it before, if it is not a table yet.
    """
    full = matrix.where(F.forall("counts", lambda c: c > 0))
    logs = full.select(F.transform("counts", lambda c: F.ln(c)).alias("l"))
    mean = F.aggregate("l", F.lit(0.0), lambda a, x: a + x) / samples
    ratios = logs.withColumn("m", mean).select(F.posexplode(F.transform("l", lambda x: x - F.col("m"))).alias("sample", "value"))
    found = medians(ratios)
    return Factors("deseq", [1.0 / math.exp(found.get(i, 0.0)) for i in range(samples)])


def learn_deseq_frequency(matrix: DataFrame, samples: int) -> Factors:
    """Median-of-ratios factors divided by the samples' totals."""
    ratio, share = learn_deseq(matrix, samples).values, learn_frequency(matrix, samples).values
    return Factors("deseq_freq", [a * b for a, b in zip(ratio, share, strict=True)])


def learn_quantiles(matrix: DataFrame, samples: int) -> Quantiles:
    """The mean, over the ranks a count takes in its own sample, of the mean sorted profile of all samples.

    Works on histograms. The profile of all samples is a step function of the rank; its steps are
    where any sample's sorted counts change, so running sums over those few places give its integral
    everywhere it is needed.
    """
    cells = matrix.select(F.posexplode("counts").alias("sample", "value"))
    histogram = cells.groupBy("sample", "value").agg(F.count(F.lit(1)).alias("n"))
    upward = Window.partitionBy("sample").orderBy("value")
    spans = materialize(
        histogram.withColumn("end", F.sum("n").over(upward))
        .withColumn("start", F.col("end") - F.col("n"))
        .withColumn("jump", F.col("value") - F.coalesce(F.lag("value").over(upward), F.lit(0))),
        "quantile-spans",
    )
    rows = spans.agg(F.max("end")).first()[0] or 1
    whole = "decimal(38,0)"
    # places where the profile changes, or is asked for, with the change and its first moment
    steps = (
        spans.select(F.col("start").alias("at"), "jump").unionByName(spans.select(F.col("end").alias("at"), F.lit(0).cast("long").alias("jump")))
        .groupBy("at").agg(F.sum(F.col("jump").cast(whole)).cast(whole).alias("jump")).withColumn("moment", (F.col("jump") * F.col("at")).cast(whole))
        .withColumn("part", F.floor(F.col("at") * PLACES / rows).cast("int"))
    )
    # running sums inside ranges of places, and before them: a range is a task, and ranges are few
    inside = Window.partitionBy("part").orderBy("at")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = steps.groupBy("part").agg(*[F.sum(c).cast(whole).alias(c) for c in ("jump", "moment")])
    offsets = sums.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast(whole).alias(f"{c}_before") for c in ("jump", "moment")])
    total = lambda c: (F.sum(c).over(inside).cast(whole) + F.col(f"{c}_before")).cast(whole)
    joined = steps.join(offsets, "part")
    # the integral of a step function up to a place: place times the sum of changes, less the sum of their moments
    profile = joined.select("at", (F.col("at") * total("jump") - total("moment")).cast(whole).alias("area"))
    left = profile.select(F.col("at").alias("start"), F.col("area").alias("from"))
    right = profile.select(F.col("at").alias("end"), F.col("area").alias("to"))
    mapped = (F.col("to") - F.col("from")).cast("double") / (F.col("n") * samples)
    return Quantiles(spans.join(left, "start").join(right, "end").select("sample", "value", mapped.alias("mapped")), samples)


LEARN = {"freq": learn_frequency, "deseq": learn_deseq, "q": learn_quantiles, "deseq_freq": learn_deseq_frequency}


def learn(matrix: DataFrame, samples: int, method: str, totals: Sequence[int] | None = None) -> Factors | Quantiles:
    """``method``: freq, deseq, q, or deseq_freq. ``totals`` are the samples' sums, where they are known."""
    return learn_frequency(matrix, samples, totals) if method == "freq" else LEARN[method](matrix, samples)


def save(model: Factors | Quantiles, spark: SparkSession, path: str) -> None:
    """Write a model's table as Parquet."""
    if isinstance(model, Factors):
        model.table(spark).coalesce(1).write.mode("overwrite").parquet(path)
    else:
        model.mapping.withColumn("samples", F.lit(model.samples)).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Factors | Quantiles:
    """Read a model written by :func:`save`."""
    df = spark.read.parquet(path)
    if "factor" in df.columns:
        rows = df.orderBy("sample").collect()  # a row per sample
        return Factors(rows[0]["method"], [r["factor"] for r in rows])
    return Quantiles(df.drop("samples"), df.first()["samples"])
