"""Correction of p-values for many tests, without sorting all rows in one task.

Equal p-values are always corrected equally, so the work is done on the table of different
p-values with their counts. That table is cut into ranges; each range is summed up on its own, the
few range sums are accumulated, and the results are joined back on p. NaN stays NaN but counts
among the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.sources.scratch import materialize

METHODS = ("b", "hb", "bh", "by")


def _ranked(df: DataFrame, p: str) -> DataFrame:
    """Different p-values with counts, and how many tests lie at or below each: ``(p, n, upto, part)``."""
    distinct = df.where(~F.isnan(p) & F.col(p).isNotNull()).groupBy(F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    # ranges are cut by the logarithm of p, a thousand to a power of two: fixed, whatever the data
    part = F.when(F.col("p") > 0, F.floor(F.log2("p") * 1024).cast("int")).otherwise(-(1 << 30))
    parts = materialize(distinct.withColumn("part", part), "p-values")  # read four times; the rows behind it only once
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("part").agg(F.sum("n").alias("s")).select("part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("p"))
    return parts.withColumn("inside", inside).join(offsets, "part").select("p", "n", "part", (F.col("inside") + F.col("offset")).alias("upto"))


def _running(ranked: DataFrame, value: str, lowest: bool) -> DataFrame:
    """Running maximum of ``value`` upwards in p, or (lowest) running minimum downwards, over ranges and inside them."""
    agg, order = (F.min, F.desc) if lowest else (F.max, F.asc)
    parts = ranked.groupBy("part").agg(agg(value).alias("s"))
    over_parts = Window.orderBy(order("part")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", agg("s").over(over_parts).alias("carried"))
    inside = agg(value).over(Window.partitionBy("part").orderBy(order("p")))
    merged = F.least if lowest else F.greatest
    return ranked.withColumn("own", inside).join(offsets, "part").select("p", merged("own", "carried").alias("adjusted"))


def correct(df: DataFrame, p: str, method: str, out: str) -> DataFrame:
    """Adds the corrected p-value: Bonferroni ``b``, Holm ``hb``, Benjamini-Hochberg ``bh`` or Benjamini-Yekutieli ``by``."""
    if method not in METHODS:
        raise ValueError(f"unknown correction {method!r}")
    m = df.count()
    if method == "b":
        return df.withColumn(out, F.when(F.isnan(p), F.col(p)).otherwise(F.least(F.lit(1.0), F.col(p) * m)))
    ranked = _ranked(df, p)
    if method == "hb":
        raw = F.col("p") * (m - (F.col("upto") - F.col("n")))
        table = _running(ranked.withColumn("raw", F.least(F.lit(1.0), raw)), "raw", lowest=False)
    else:
        scale = sum(1.0 / i for i in range(1, m + 1)) if method == "by" and m < 10_000_000 else 1.0
        if method == "by" and m >= 10_000_000:
            import math

            scale = math.log(m) + 0.5772156649015329 + 1 / (2 * m)  # the harmonic number to 1e-15
        raw = F.col("p") * m / F.col("upto") * scale
        table = _running(ranked.withColumn("raw", F.least(F.lit(1.0), raw)), "raw", lowest=True)
    joined = df.join(table.withColumnRenamed("p", "__p"), F.col(p) == F.col("__p"), "left").drop("__p")
    return joined.withColumn(out, F.when(F.isnan(p), F.col(p)).otherwise(F.col("adjusted"))).drop("adjusted")


def significant(df: DataFrame, corrected: str, most: float = 0.05) -> DataFrame:
    """Rows whose corrected p-value is at most ``most``; NaN is not."""
    return df.where(~F.isnan(corrected) & (F.col(corrected) <= most))
