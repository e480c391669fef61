"""Outputs: text matrices, FASTA and statistics tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(scientific: Column, value: Column) -> Column:
    """Digits and decimal power of a number of six digits in scientific notation; zeros at the end go where it is exact."""
    six = F.translate(F.get(F.split(scientific, "e"), F.lit(0)), ".", "")
    digits = F.when(scientific.cast("double") == F.abs(value), F.regexp_replace(six, "(?<=.)0+$", "")).otherwise(six)
    return F.struct(digits.alias("digits"), F.get(F.split(scientific, "e"), F.lit(1)).cast("int").alias("power"))


def _spelled(digits: Column, power: Column, n: Column) -> Column:
    """The text of ``n`` digits, the first of which stands at a decimal power."""
    shift = power - (n - 1)
    exponent = F.concat(
        F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, 2, 5))).otherwise(""),
        F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.when(F.abs(power) < 10, F.lit("0")).otherwise(""), F.abs(power).cast("string"),
    )
    pointed = F.concat(F.substring(digits, F.lit(1), n + shift), F.lit("."), F.substring(digits, n + shift + 1, -shift))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -shift - n), digits)
    return F.when(shift == 0, digits).when((shift > 0) | (-shift >= n + 4), exponent).when(-shift < n, pointed).otherwise(small)


def number(value: Column) -> Column:
    """A double as text of at most six significant digits; nan, inf and -inf in lower case.

    The digits are those of the shortest decimal that gives the double, rounded half up to six if
    there are more (zeros at the end then stay). Digits times a positive power of ten, and numbers
    with more than three zeros after the point, are written with an exponent of a sign and two digits.
    """
    parts = lambda x: _bound(F.format_string("%.5e", F.abs(x)), lambda s: _digits(s, x))
    plain = lambda x: _bound(parts(x), lambda d: _spelled(d["digits"], d["power"], F.length(d["digits"])))
    text = lambda x: (
        F.when(x.isNull() | F.isnan(x), F.lit("nan"))
        .when(x == float("inf"), F.lit("inf"))
        .when(x == float("-inf"), F.lit("-inf"))
        .when(x == 0, F.lit("0"))
        .otherwise(F.concat(F.when(x < 0, F.lit("-")).otherwise(""), plain(x)))
    )
    return _bound(value, text)


def _text(df: DataFrame) -> DataFrame:
    return df.select(*[number(F.col(f"`{n}`")).alias(n) if t == "double" else F.col(f"`{n}`").cast("string").alias(n) for n, t in df.dtypes])


def tsv(df: DataFrame, path: str, header: bool = True) -> None:
    """A tab-separated text table (a folder of part files, each with the header)."""
    _text(df).write.mode("overwrite").option("sep", "\t").option("header", header).option("quote", "").option("emptyValue", "").csv(path)


def matrix_text(matrix: DataFrame, path: str, samples: Sequence[str], values: str = "counts") -> None:
    """``k-mer`` and a column per sample."""
    tsv(matrix.select(F.col("kmer").alias("k-mer"), *[F.col(values)[i].alias(s) for i, s in enumerate(samples)]), path)


def fasta(matrix: DataFrame, path: str, name: Column | None = None) -> None:
    """``>id`` and the k-mer, two lines each; ids are arbitrary but unique unless ``name`` gives them."""
    title = F.monotonically_increasing_id().cast("string") if name is None else name
    matrix.select(F.concat(F.lit(">"), title, F.lit("\n"), F.col("kmer"))).write.mode("overwrite").text(path)


def ranked(best: DataFrame, value: str, path: str, columns: Sequence[tuple[str, int]]) -> None:
    """The three files of a top list ``best(rank, kmer, value, counts)``: values, counts, and FASTA named by rank.

    ``value`` names the column of values, ``columns`` those of counts and the sample each is of.
    """
    one = best.coalesce(1).sortWithinPartitions("rank")
    tsv(one.select(F.col("kmer").alias("k-mer"), F.col("value").alias(value)), f"{path}_top")
    tsv(one.select(F.col("kmer").alias("k-mer"), *[F.col("counts")[i].alias(c) for c, i in columns]), f"{path}_top_matrix")
    fasta(one, f"{path}_top.fa", F.concat(F.lit("rank"), F.col("rank").cast("string")))


def significant(rows: DataFrame, columns: Sequence[str], path: str, samples: Sequence[str]) -> None:
    """The significant rows of a corrected test: values, counts and FASTA."""
    tsv(rows.select(F.col("kmer").alias("k-mer"), *columns), f"{path}_cor_significant")
    matrix_text(rows, f"{path}_cor_significant_matrix", samples)
    fasta(rows, f"{path}_cor_significant.fa")
