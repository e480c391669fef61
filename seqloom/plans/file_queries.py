"""Registered queries that go through files: what a source reads back, and what a sink has written.

The documents are written as sequence files, filters or phenotypes into the scratch folder, in a
format a source knows, and read by that source; results are written by a sink and read back as text.
Each has the SQL that gives the same rows from the tables themselves.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import kmers, packed, rowstats
from seqloom.operators import matrix as mx
from seqloom.operators import normalize, pvalues, select
from seqloom.plans import queries as q
from seqloom.plans.analysis import run
from seqloom.plans.options import Options
from seqloom.sources import kept, readers, writers
from seqloom.sources.scratch import scratch_path

RECORD = {
    # '@' is a quality as well, and begins a line then
    "fq": lambda seq: F.concat(F.lit("@read\n"), seq, F.lit("\n+\n"), F.repeat(F.lit("@"), F.length(seq))),
    "fa": lambda seq: F.concat(F.lit(">read\n"), seq),
    "mf": lambda seq: F.concat(F.lit(">read of several lines\n"), F.regexp_replace(seq, "(.{60})", "$1\n")),
}


def text_file(spark: SparkSession, lines: list[str], name: str) -> str:
    path = scratch_path(spark, name)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def sequence_files(spark: SparkSession, sf_dir: str, fmt: str, compression: str = "none") -> str:
    """The documents as sequence files, a folder per sample; returns the path of their manifest."""
    bases = q.reads(spark, sf_dir).select("sample", F.regexp_replace(F.coalesce("seq", F.lit("")), "[^ACGT]", "N").alias("seq"))
    least = spark.createDataFrame([(s, "N") for s in q.SAMPLES], "sample string, seq string")  # no sample is without a file
    path = scratch_path(spark, f"reads-{fmt}")
    bases.unionByName(least).select("sample", RECORD[fmt](F.col("seq")).alias("value")).write.partitionBy("sample").option("compression", compression).text(path)
    return text_file(spark, [f"{s} {path}/sample={s}" for s in q.SAMPLES], "manifest")


def counted(spark: SparkSession, sf_dir: str, fmt: str, compression: str = "none") -> DataFrame:
    samples = readers.manifest(spark, sequence_files(spark, sf_dir, fmt, compression))
    return mx.count_reads(readers.reads(spark, samples, fmt, q.K), q.SAMPLES, q.K)


def filtered(spark: SparkSession, sf_dir: str, fasta: bool) -> DataFrame:
    """The matrix with the k-mers of ``benchmark`` alone, which come from a filter file."""
    path = scratch_path(spark, "filter")
    if fasta:
        bases = F.regexp_replace(kmers.pseudo_dna(F.coalesce("text", F.lit(""))), "[^ACGT]", "N")
        q.table(spark, sf_dir, "benchmark").select(RECORD["mf"](bases)).write.text(path)
    else:
        lines = q.benchmark_set(spark, sf_dir).select(packed.text(q.K).alias("kmer")).groupBy(F.substring("kmer", 1, 2)).agg(F.concat_ws(" ", F.collect_list("kmer")).alias("value"))
        lines.select("value").write.text(path)
    return q.wide(q.base(spark, sf_dir, keep=mx.packed_set(readers.filter_sequences(spark, path, q.K), q.K)))


def tsv(spark: SparkSession, path: str, kinds: str = "double") -> DataFrame:
    """A text table as a sink wrote it: names in the header, a first column of text, then numbers."""
    got = spark.read.option("sep", "\t").option("header", True).csv(path)
    first, *rest = got.columns
    return got.select(F.col(f"`{first}`").alias(first.replace("k-mer", "kmer")), *[F.col(f"`{c}`").cast(kinds).alias(c) for c in rest])


def back(frame: DataFrame, write) -> str:
    path = scratch_path(frame.sparkSession, "sink")
    write(path)
    return path


def matrix_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = q.base(spark, sf_dir)
    return tsv(spark, back(matrix, lambda p: writers.matrix_text(matrix, p, q.COUNTS)), "long")


def fasta_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = q.base(spark, sf_dir)
    return readers.sequences(spark, [back(matrix, lambda p: writers.fasta(matrix, p))], "fa").withColumnRenamed("seq", "kmer")


def totals_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = mx.totals(q.base(spark, sf_dir), q.SAMPLES).select(F.lit("tot_cnt").alias("measure"), *q.SAMPLES)
    return tsv(spark, back(totals, lambda p: writers.tsv(totals, p)), "long")


def normalized_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q.normalized(spark, sf_dir, "freq")
    return tsv(spark, back(rows, lambda p: writers.matrix_text(rows, p, q.COUNTS, "norm")))


def _ranks(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, rank) of a FASTA file whose records are named by rank."""
    lines = F.split("value", "\n")
    records = spark.read.option("lineSep", ">").text(path).where("value <> ''")
    return records.select(F.get(lines, F.lit(1)).alias("kmer"), F.substring(F.get(lines, F.lit(0)), 5, 20).cast("long").alias("rank"))


def top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three files of a top list, joined: value, counts, rank."""
    rows = rowstats.pearson(q.normalized(spark, sf_dir), "norm", q.PHENOTYPE).withColumn("pearson", F.round("pearson", 6))
    path = scratch_path(spark, "sink")
    writers.ranked(select.top_lists(rows, {"pearson": ("pearson", True)}, q.TOP), "pearson", path, [(c, i) for i, c in enumerate(q.COUNTS)])
    return tsv(spark, f"{path}_top").join(tsv(spark, f"{path}_top_matrix", "long"), "kmer").join(_ranks(spark, f"{path}_top.fa"), "kmer")


def fold_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three files of all folds, joined: ``(fold, kmer, pearson, rank, first, sum)``, with the first training sample's count and all counts' sum."""
    rows, tests = select.cross_validate(q.normalized(spark, sf_dir), "norm", q.PHENOTYPE)
    names = [f"cv_pearson_{f}" for f in range(len(tests))]
    rows = rows.withColumns({c: F.round(c, 6) for c in names})
    best = q.materialize(select.fold_lists(rows, {"pearson": tests}, q.TOP), "folds")
    out = None
    for fold, test in enumerate(tests):
        path, columns = scratch_path(spark, "sink"), select.fold_columns(q.COUNTS, test)
        writers.ranked(best.where(F.col("list") == names[fold]), "pearson", path, columns)
        counts = tsv(spark, f"{path}_top_matrix", "long")
        counts = counts.select("kmer", F.col(f"`{columns[0][0]}`").alias("first"), sum((F.col(f"`{c}`") for c, _ in columns), F.lit(0)).alias("sum"))
        part = tsv(spark, f"{path}_top").join(counts, "kmer").join(_ranks(spark, f"{path}_top.fa"), "kmer").select(F.lit(fold).cast("long").alias("fold"), "kmer", "pearson", "rank", "first", "sum")
        out = part if out is None else out.unionByName(part)
    return out


def significant_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the significant rows of a corrected test, joined: values and counts, for rows that are in the FASTA too."""
    tested = q.materialize(rowstats.anova(q.normalized(spark, sf_dir), "norm", q.THREE).select("kmer", "counts", "anova_p", "anova_stat"), "anova")
    corrected = pvalues.correct(tested, "anova_p", "bh", "p_cor")
    path = scratch_path(spark, "sink")
    writers.significant(pvalues.significant(corrected, "p_cor", 0.998), ["p_cor"], path, q.COUNTS)
    in_fasta = readers.sequences(spark, [f"{path}_cor_significant.fa"], "fa").withColumnRenamed("seq", "kmer")
    values = tsv(spark, f"{path}_cor_significant").withColumn("p_cor", F.round("p_cor", 4))
    return values.join(tsv(spark, f"{path}_cor_significant_matrix", "long"), "kmer").join(in_fasta, "kmer", "left_semi")


def kept_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, settings = scratch_path(spark, "kept"), Options(k=q.K).matrix_settings(q.SAMPLES)
    kept.save(q.base(spark, sf_dir), path, settings)
    return q.wide(kept.load(spark, path, settings).rows)


def grown_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of all sources, of which every third came later than the others."""
    path, reads = scratch_path(spark, "kept"), q.reads(spark, sf_dir)
    first, later = [s for i, s in enumerate(q.SAMPLES) if i % 3], q.SAMPLES[::3]
    kept.save(mx.of_reads(reads, first, q.K), path, Options(k=q.K).matrix_settings(first))
    settings = Options(k=q.K).matrix_settings(q.SAMPLES)
    return q.wide(kept.grow(kept.part(spark, path, settings), mx.of_reads(reads, later, q.K), later, settings).rows)


def observed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and totals of the matrix as they were observed while it was written: ``(sample, total, n_rows)``."""
    found = kept.save(q.base(spark, sf_dir), scratch_path(spark, "kept"), Options(k=q.K).matrix_settings(q.SAMPLES))
    return spark.createDataFrame([(n, t, found.n_rows) for n, t in zip(found.names, found.totals, strict=True)], "sample string, total long, n_rows long")


def kept_normaliser(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    matrix, path = q.materialize(q.base(spark, sf_dir), "matrix"), scratch_path(spark, "normaliser")
    normalize.save(normalize.learn(matrix, q.N, method), spark, path)
    return q.wide(normalize.load(spark, path).transform(matrix), "norm")


def phenotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and class labels of the sources, a file each, as read for the samples: their characters, and whether those are odd."""
    sums = q.table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("n"))
    have = {r["source"]: r["n"] or 0 for r in sums.where(F.col("source").isin(q.SAMPLES)).collect()}  # one a sample
    counts = [have.get(s, 0) for s in q.SAMPLES]
    numbers = text_file(spark, [" ".join(f"{c}.5" for c in counts[:7]), "\n".join(f"{c}.5" for c in counts[7:])], "numbers")
    labels = text_file(spark, [" ".join("odd" if c % 2 else "even" for c in counts)], "labels")
    read = zip(q.SAMPLES, readers.numeric_phenotype(spark, numbers, q.N), readers.class_phenotype(spark, labels, q.N), strict=True)
    return spark.createDataFrame(list(read), "sample string, y double, class long")


def whole_run(spark: SparkSession, sf_dir: str, suffix: str) -> DataFrame:
    """A result file of a whole analysis, from the manifest on."""
    y, c = (text_file(spark, [" ".join(map(str, v))], "phenotype") for v in (q.PHENOTYPE, q.TWO))
    options = Options(k=q.K, fmt="mf", thr=2, thr_rat=0.5, normalize="freq", cor=("pearson",), phenotype=y, diff=("snr",), classes=c, entropy=True, n_top=q.TOP)
    prefix = scratch_path(spark, "run")
    run(spark, options, sequence_files(spark, sf_dir, "mf"), prefix)
    return tsv(spark, prefix + suffix)


#: Statistics whose files a whole run leaves for three classes, and for two: each with its query of :mod:`queries`, of the same columns.
THREE_CLASSES = {"_spearman": "cor_spearman", "_kendall_tau": "cor_kendall", "_entropy": "entropy", "_dids": "dids_sqrt", "_anova": "anova"}
TWO_CLASSES = {"_ttest": "ttest_full", "_wrs": "wrs_full", "_snr_for_unnornalized": "snr_raw"}


def statistics_files(spark: SparkSession, sf_dir: str, classes: list[int], suffixes: dict[str, str], **options) -> DataFrame:
    """All values of the statistics' files of one run: ``(statistic, kmer, value)``, a row for each column and k-mer."""
    y, c = (text_file(spark, [" ".join(map(str, v))], "phenotype") for v in (q.PHENOTYPE, classes))
    prefix, out = scratch_path(spark, "run"), None
    run(spark, Options(k=q.K, fmt="mf", thr=2, thr_rat=0.5, normalize="freq", phenotype=y if options.get("cor") else None, classes=c, **options), sequence_files(spark, sf_dir, "mf"), prefix)
    for suffix in suffixes:
        got = tsv(spark, prefix + suffix)
        listed = got.unpivot("kmer", [c for c in got.columns if c != "kmer"], "statistic", "value").withColumn("statistic", F.concat(F.lit(f"{suffix}."), "statistic"))
        out = listed if out is None else out.unionByName(listed)
    return out.withColumn("value", four(F.col("value")))


def four(value: Column) -> Column:
    """Four decimals, by the same steps as in SQL; nan stays."""
    return F.rint(value * 10_000) / 10_000


def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the counts times powers of ten from -8 to 11, a power a sample, as the text of a sink."""
    rows = q.normalized(spark, sf_dir, "freq")
    rows = rows.select("kmer", F.array(*[F.col("norm")[i] * F.lit(float(f"1e{i - 8}")) for i in range(q.N)]).alias("v"))
    return tsv(spark, back(rows, lambda p: writers.matrix_text(rows, p, q.COUNTS, "v")), "string")


def number_sql() -> str:
    """SQL for the text of numbers that are not negative, from the rule for six significant digits."""
    return q.sql(
        q.cells(), q.FREQ,
        f"num AS (SELECT kmer, i, v * {q._case([f'1e{i - 8}::DOUBLE' for i in range(q.N)])} AS u FROM norm)",
        # the shortest decimal that gives the number, as digits and the power of the first; more than six are rounded half up
        "sci AS (SELECT kmer, i, u, split_part(u::VARCHAR, 'e', 1) AS m, coalesce(nullif(split_part(u::VARCHAR, 'e', 2), '')::INT, 0) AS x FROM num)",
        "raw AS (SELECT *, split_part(m, '.', 1) AS whole, replace(m, '.', '') AS every FROM sci)",
        "pow AS (SELECT kmer, i, u, ltrim(every, '0') AS l, x + len(whole) - 1 - (len(every) - len(ltrim(every, '0'))) AS p FROM raw)",
        "cut AS (SELECT kmer, i, u, p, rtrim(l, '0') AS s, CASE WHEN len(rtrim(l, '0')) > 6 THEN l[1:6]::INT + (l[7] >= '5')::INT END AS r FROM pow)",
        "dig AS (SELECT kmer, i, u, p + (coalesce(r, 0) = 1000000)::INT AS p, CASE WHEN r IS NULL THEN s ELSE (r::VARCHAR)[1:6] END AS d FROM cut)",
        "len AS (SELECT *, len(d) AS n, p - len(d) + 1 AS e FROM dig)",
        """txt AS (SELECT kmer, i, CASE WHEN u = 0 THEN '0' WHEN e = 0 THEN d
 WHEN e > 0 OR -e >= n + 4 THEN d[1] || CASE WHEN n > 1 THEN '.' || d[2:] ELSE '' END || CASE WHEN p < 0 THEN 'e-' ELSE 'e+' END || lpad(abs(p)::VARCHAR, 2, '0')
 WHEN -e < n THEN d[1:n + e] || '.' || d[n + e + 1:] ELSE '0.' || repeat('0', (-e - n)::INT) || d END AS t FROM len)""",
        select=q.pivot("txt", "t"),
    )


def six(value: str) -> str:
    """SQL for a number as six significant digits give it back."""
    return f"printf('%.5e', {value})::DOUBLE"


def _register() -> None:
    q.register("source_fastq", lambda s, d: counted(s, d, "fq"), q.ORACLES["kmer_count_canonical"])
    q.register("source_fasta", lambda s, d: counted(s, d, "fa"), q.ORACLES["kmer_count_canonical"])
    q.register("source_multi_fasta", lambda s, d: counted(s, d, "mf"), q.ORACLES["kmer_count_canonical"])
    q.register("source_gzip", lambda s, d: counted(s, d, "fq", "gzip"), q.ORACLES["kmer_count_canonical"])
    q.register("source_filter_list", lambda s, d: filtered(s, d, False), q.ORACLES["kmer_filter_set"])
    q.register("source_filter_fasta", lambda s, d: filtered(s, d, True), q.ORACLES["kmer_filter_set"])
    samples = ", ".join(f"('{s}', {i})" for i, s in enumerate(q.SAMPLES))
    q.register(
        "source_phenotypes", phenotypes,
        f"""WITH per AS (SELECT sample, i, (SELECT coalesce(sum(n_chars), 0) FROM documents WHERE source = sample) AS n FROM (VALUES {samples}) t(sample, i))
SELECT sample, n + 0.5::DOUBLE AS y, (n % 2 <> (SELECT n % 2 FROM per WHERE i = 0))::BIGINT AS class FROM per""",
    )
    q.register("sink_matrix", matrix_file, q.ORACLES["kmer_matrix_any"])
    q.register("sink_fasta", fasta_file, q.sql(q.cells(), select="SELECT DISTINCT kmer FROM cells"))
    q.register("sink_totals", totals_file, q.ORACLES["tot_cnt"].replace("SELECT coalesce(sum(x) FILTER (i = 0)", "SELECT 'tot_cnt' AS measure, coalesce(sum(x) FILTER (i = 0)"))
    q.register("sink_normalized", normalized_file, q.sql(q.cells(), q.FREQ, select=q.pivot("norm", six("v"))))
    q.register("sink_kept_matrix", kept_matrix, q.ORACLES["kmer_matrix_any"])
    q.register("kept_matrix_grown", grown_matrix, q.ORACLES["kmer_matrix_any"])
    q.register(
        "kept_matrix_observed", observed_totals,
        q.sql(q.cells(), select="SELECT 'src' || i AS sample, sum(x)::BIGINT AS total, count(*)::BIGINT AS n_rows FROM cells GROUP BY i"),
    )
    for name, method in (("deseq", "deseq"), ("quantile", "q")):
        q.register(f"sink_normaliser_{name}", lambda s, d, m=method: kept_normaliser(s, d, m), q.ORACLES[f"norm_{name}"])
    best = f"""best AS (SELECT kmer, round(r, 6) AS r, row_number() OVER (ORDER BY abs(round(r, 6)) DESC, kmer) - 1 AS rank FROM cor
QUALIFY rank < {q.TOP}), piv AS ({q.pivot()})"""
    q.register(
        "sink_top", top_files,
        q.sql(q.cells(), q.DESEQ, q.corr_sql("norm", "v", q.Y), best, select=f"SELECT piv.*, {six('r')} AS pearson, rank::BIGINT AS rank FROM best JOIN piv USING (kmer)"),
    )
    tests = select.folds(q.N, 2)
    fitted = " UNION ALL ".join(
        f"SELECT kmer, {f} AS fold, r FROM (WITH {q.corr_sql('norm', 'v', q.Y, f'WHERE i NOT IN ({t[0]}, {t[1]})')} SELECT * FROM cor)" for f, t in enumerate(tests)
    )
    first = q._case([min(set(range(q.N)) - set(t)) for t in tests], "fold")
    chosen = f"""chosen AS (SELECT kmer, fold, round(r, 6) AS r, row_number() OVER (PARTITION BY fold ORDER BY abs(round(r, 6)) DESC, kmer) - 1 AS rank FROM ({fitted})
QUALIFY rank < {q.TOP})"""
    q.register(
        "sink_cv", fold_files,
        q.sql(q.cells(), q.DESEQ, chosen, select=f"SELECT fold::BIGINT AS fold, kmer, {six('r')} AS pearson, rank::BIGINT AS rank, (max(x) FILTER (i = {first}))::BIGINT AS first, sum(x)::BIGINT AS sum FROM chosen JOIN cells USING (kmer) GROUP BY ALL"),
    )
    q.register(
        "sink_significant", significant_files,
        q.sql(q.cells(), q.DESEQ, q.corrected_sql("bh").replace("cor AS (", "fit AS ("), f"piv AS ({q.pivot()})", select=f"SELECT piv.*, round({six('pc')}, 4) AS p_cor FROM fit JOIN piv USING (kmer) WHERE pc <= 0.998"),
    )
    half = "cells0 AS (SELECT * FROM cells WHERE kmer IN (SELECT kmer FROM cells GROUP BY kmer HAVING count(*) FILTER (x >= 2) / 20.0 >= 0.5))"
    freq = q.FREQ.replace("FROM cells", "FROM cells0")
    q.register("run_pearson", lambda s, d: tsv_rounded(whole_run(s, d, "_pearson"), "pearson"), q.sql(q.cells(), half, freq, q.corr_sql("norm", "v", q.Y), select=f"SELECT kmer, round({six('r')}, 4) AS pearson FROM cor"))
    snr = f"SELECT kmer, round({six('CASE WHEN s0 = 0 OR s1 = 0 THEN 0 ELSE abs(m0 - m1) / (s0 + s1) END')}, 4) AS snr FROM two"
    q.register("run_snr", lambda s, d: tsv_rounded(whole_run(s, d, "_snr"), "snr"), q.sql(q.cells(), half, freq, q.moments("v"), select=snr))


    normal = f"{half},\n{freq}"
    for name, classes, suffixes, options in (
        ("run_files_three_classes", q.THREE, THREE_CLASSES, {"cor": ("spearman", "kendall"), "entropy": True, "diff": ("dids", "anova"), "n_top": q.TOP}),
        ("run_files_two_classes", q.TWO, TWO_CLASSES, {"diff": ("ttest", "wrs", "snr"), "snr_raw": True, "n_top": q.TOP}),
    ):
        q.register(
            name, lambda s, d, c=classes, f=suffixes, o=options: statistics_files(s, d, c, f, **o),
            " UNION ALL ".join(_listed(suffix, q.ORACLES[of], half, normal) for suffix, of in suffixes.items()),
        )
    q.register("sink_number_text", number_text, number_sql())


def _listed(suffix: str, oracle: str, half: str, normal: str) -> str:
    """SQL of a statistic over the matrix a run has, unrounded, as ``(statistic, kmer, value)`` of six digits."""
    begin = "WITH " + q.cells()
    body = oracle[len(begin) :].replace(f",\n{q.DESEQ}", f",\n{normal}") if q.DESEQ in oracle else f",\n{half}" + oracle[len(begin) :].replace("FROM cells", "FROM cells0")
    ctes, _, last = body.rpartition("\nSELECT ")
    last = re.sub(r"round\((.+?), [56]\) AS ", r"\1 AS ", last)
    columns = re.findall(r" AS (\w+)", last.partition(" FROM ")[0])
    parts = [f"SELECT '{suffix}.{c.replace('snr', 'snr_raw') if 'unn' in suffix else c}' AS statistic, kmer, {c}::DOUBLE AS v FROM stat" for c in columns]
    return f"SELECT statistic, kmer, round_even({six('v')} * 10000, 0) / 10000 AS value FROM ({begin}{ctes},\nstat AS (SELECT {last})\n{' UNION ALL '.join(parts)})"


def tsv_rounded(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.round(column, 4))


_register()
