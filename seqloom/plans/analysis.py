"""An analysis from sample files to result files."""

from __future__ import annotations

import logging
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import rowstats
from seqloom.operators import matrix as mx
from seqloom.operators import normalize, pvalues, reduce, select
from seqloom.plans.options import WITH_PVALUE, Options
from seqloom.sources import kept as kept_matrix
from seqloom.sources import readers, writers
from seqloom.sources.scratch import discard, materialize, put_text

log = logging.getLogger("seqloom")

#: Columns that each test adds, the p-value first where there is one.
COLUMNS = {
    "pearson": ["pearson"], "spearman": ["spearman"], "kendall": ["kendall_tau"], "entropy": ["entropy"],
    "ttest": ["ttest_p", "ttest_df", "ttest_stat"], "snr": ["snr"], "snr_raw": ["snr_raw"],
    "wrs": ["wrs_p", "wrs_u1", "wrs_u2"], "dids": ["dids"], "anova": ["anova_p", "anova_stat"],
}
#: Names of files; the misspelt one is a fixed value.
SUFFIX = {n: n for n in COLUMNS} | {"kendall": "kendall_tau", "snr_raw": "snr_for_unnornalized"}


@contextmanager
def _timed(step: str):
    began = time.time()
    log.info("%s: begun", step)
    yield
    log.info("%s: %.1f s", step, time.time() - began)


class _Lines(logging.Handler):
    """Keeps what is logged."""

    def __init__(self) -> None:
        super().__init__()
        self.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        self.lines: list[str] = []

    def emit(self, record: logging.LogRecord) -> None:
        self.lines.append(self.format(record))


@contextmanager
def _log_file(spark: SparkSession, path: str):
    """What happens inside goes to a log file as well, whatever the level of messages on the console; failures too."""
    kept, level = _Lines(), log.level
    log.addHandler(kept)
    log.setLevel(logging.INFO)
    try:
        yield
    except Exception as e:
        log.error("%s: %s", type(e).__name__, str(e).partition("\n")[0])
        raise
    finally:
        log.removeHandler(kept)
        log.setLevel(level)
        put_text(spark, path, "\n".join([*kept.lines, ""]))


class Analysis:
    """The steps of an analysis over one set of samples; each can be used by itself."""

    def __init__(self, spark: SparkSession, options: Options, names: list[str], phenotype: list[float] | None = None, classes: list[int] | None = None):
        options.check()
        options.check_samples(len(names), classes)
        self.kept: kept_matrix.Kept | None = None  # the kept table that the matrix is, if it is one
        self.n_rows: int | None = None  # of the matrix, and its sums by sample, once they are known
        self.totals: list[int] | None = None
        self.spark, self.options, self.names, self.phenotype, self.classes = spark, options, names, phenotype, classes

    def build(self, reads: DataFrame, keep: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
        """``reads(sample, seq)`` -> the filtered matrix over ``names`` (else all); ``keep`` are sequences whose k-mers alone remain."""
        o = self.options
        wanted = None if keep is None else mx.packed_set(keep, o.k, o.canonical, o.cx)
        return mx.of_reads(reads, names or self.names, o.k, o.canonical, o.ci, o.cx, o.cs, wanted, threshold=o.thr, ratio=o.thr_rat)

    def normalized(self, matrix: DataFrame) -> DataFrame:
        """Adds ``norm`` if a normalisation is asked for."""
        if not self.options.normalize:
            return matrix
        if self.kept is not None:
            return self.kept.model(self.options.normalize).transform(matrix)
        return normalize.learn(matrix, len(self.names), self.options.normalize, self.totals).transform(matrix)

    def statistics(self, matrix: DataFrame) -> DataFrame:
        """Adds every statistic asked for, in one pass over the rows."""
        o, df = self.options, matrix
        for c in o.cor:
            df = select.CORRELATIONS[c](df, "norm", self.phenotype)
        if o.entropy:
            df = rowstats.entropy(df, "counts", len(self.names))
        if "ttest" in o.diff:
            df = rowstats.welch(df, "counts", self.classes)
        if "snr" in o.diff:
            df = rowstats.signal_to_noise(df, "norm", self.classes)
            if o.snr_raw:
                df = rowstats.signal_to_noise(df, "counts", self.classes, "snr_raw")
        if "wrs" in o.diff:
            df = rowstats.rank_sum(df, "norm", self.classes)
        if "dids" in o.diff:
            df = rowstats.dids(df, "norm", self.classes, o.dids_mode)
        if "anova" in o.diff:
            df = rowstats.anova(df, "norm", self.classes)
        return df

    def asked(self) -> list[str]:
        """Names of the statistics asked for, in the order of output."""
        o = self.options
        raw = ["snr_raw"] if "snr" in o.diff and o.snr_raw else []
        have = [*o.cor, *(["entropy"] if o.entropy else []), *o.diff, *raw]
        return [n for n in COLUMNS if n in have]

    def write(self, matrix: DataFrame, prefix: str) -> None:
        """All outputs asked for, each under its own suffix of ``prefix``."""
        o, names = self.options, self.names
        if "matrix" in o.outputs:
            writers.matrix_text(matrix, f"{prefix}_matrix", names)
        if "fa" in o.outputs:
            writers.fasta(matrix, f"{prefix}.fa")
        if o.totals:
            known = self.totals if self.totals is not None else mx.size_and_totals(matrix, names)[1]
            row = self.spark.createDataFrame([("tot_cnt", *known)], "measure string, " + ", ".join(f"`{n}` long" for n in names))
            writers.tsv(row, f"{prefix}_tot_cnt")
        with _timed("statistics"):
            rows = self.statistics(self.normalized(matrix)).persist()
            if o.save_normalized:
                writers.matrix_text(rows, f"{prefix}_matrix_norm", names, "norm")
            for name in self.asked():
                columns, path = COLUMNS[name], f"{prefix}_{SUFFIX[name]}"
                if name in WITH_PVALUE and o.pval_corr:
                    p = columns[0]
                    corrected = pvalues.correct(rows.withColumn(f"{p}_raw", F.col(p)), f"{p}_raw", o.pval_corr, f"{p}_cor")
                    listed = [f"{p}_cor", *columns[1:]]
                    writers.tsv(corrected.select(F.col("kmer").alias("k-mer"), *listed), f"{path}_cor")
                    writers.significant(pvalues.significant(corrected, f"{p}_cor", o.max_corrected_pval), listed, path, names)
                else:
                    writers.tsv(rows.select(F.col("kmer").alias("k-mer"), *columns), path)
            self._write_lists(rows, prefix)
            self._write_reductions(rows, prefix)
            rows.unpersist()

    def _write_lists(self, rows: DataFrame, prefix: str) -> None:
        """The top lists of all statistics and of all folds, found in one pass over the rows."""
        o, names = self.options, self.names
        files = {}  # of each list: column of values, path, columns of counts
        lists = {}
        for name in self.asked():
            if name not in WITH_PVALUE:
                lists[name] = (COLUMNS[name][0], name in select.CORRELATIONS)
                files[name] = (COLUMNS[name][0], f"{prefix}_{SUFFIX[name]}", [(s, i) for i, s in enumerate(names)])
        for method in o.cor if o.cv else ():
            rows, tests = select.cross_validate(rows, "norm", self.phenotype, method, o.leave, o.cv_seed)
            for fold, test in enumerate(tests):
                column = f"cv_{method}_{fold}"
                lists[column] = (column, True)
                files[column] = (method, f"{prefix}_cv_{SUFFIX[method]}_{fold}_{len(tests)}", select.fold_columns(names, test))
        if not lists:
            return
        best = materialize(select.top_lists(rows, lists, o.top), "top-lists")
        for name, (value, path, columns) in files.items():
            writers.ranked(best.where(F.col("list") == name), value, path, columns)
        discard(best)

    def _write_reductions(self, rows: DataFrame, prefix: str) -> None:
        o, n = self.options, len(self.names)
        for wanted, step in ((o.pca, self._write_pca), (o.umap, self._write_umap)):
            if wanted:
                try:
                    step(rows, prefix, n)
                except ValueError as e:  # an analysis goes on without this output
                    log.error("%s", e)

    def _write_pca(self, rows: DataFrame, prefix: str, n: int) -> None:
        found = reduce.pca(rows, "norm", n, self.options.dims)
        writers.tsv(reduce.coordinates_table(self.spark, found.scores, "PCA", self.names), f"{prefix}_pca")
        writers.tsv(reduce.variance_table(self.spark, found, rows.count() if self.n_rows is None else self.n_rows), f"{prefix}_pca_variance")

    def _write_umap(self, rows: DataFrame, prefix: str, n: int) -> None:
        at = reduce.umap(rows, "norm", n, self.options.dims, self.options.umap_options)
        writers.tsv(reduce.coordinates_table(self.spark, at, "UMAP", self.names), f"{prefix}_umap")


def run(spark: SparkSession, options: Options, manifest: str, prefix: str) -> DataFrame:
    """From a sample manifest to all outputs, with ``<prefix>.log``; returns the matrix."""
    with _log_file(spark, f"{prefix}.log"):
        return _run(spark, options, manifest, prefix)


def _run(spark: SparkSession, options: Options, manifest: str, prefix: str) -> DataFrame:
    samples = readers.manifest(spark, manifest)
    names = [s.name for s in samples]
    log.info("%d samples, k = %d", len(names), options.k)
    phenotype = readers.numeric_phenotype(spark, options.phenotype, len(names)) if options.phenotype else None
    classes = readers.class_phenotype(spark, options.classes, len(names)) if options.classes else None
    analysis = Analysis(spark, options, names, phenotype, classes)
    with _timed("matrix"):
        matrix = _matrix(spark, analysis, samples, f"{prefix}.db")
    if not analysis.n_rows:
        raise ValueError("the matrix is empty: no k-mer passed the filters")
    empty = [n for n, total in zip(names, analysis.totals, strict=True) if not total]
    if empty:
        log.warning("samples without k-mers: %s", ", ".join(empty))
    analysis.write(matrix, prefix)
    return matrix


def _matrix(spark: SparkSession, analysis: Analysis, samples: list[readers.Sample], path: str) -> DataFrame:
    """The matrix, from the kept table as far as that has its samples; the analysis knows its size and totals."""
    options, names = analysis.options, analysis.names
    settings = options.matrix_settings(names)
    kept = kept_matrix.load(spark, path, settings) if options.reuse else None
    if kept is None:
        part = kept_matrix.part(spark, path, settings) if options.reuse else None
        new = [s for s in samples if part is None or s.name not in part.names]
        keep = readers.filter_sequences(spark, options.flt, options.k) if options.flt else None
        built = analysis.build(readers.reads(spark, new, options.fmt, options.k), keep, [s.name for s in new])
        if not options.reuse:
            matrix = built.persist()
            analysis.n_rows, analysis.totals = mx.size_and_totals(matrix, names)
            return matrix
        if part is not None:
            log.info("%d of %d samples are kept", len(part.names), len(names))
            kept = kept_matrix.grow(part, built, [s.name for s in new], settings)
        else:
            kept = kept_matrix.save(built, path, settings)
    analysis.kept, analysis.n_rows, analysis.totals = kept, kept.n_rows, kept.totals
    if kept.n_rows:
        for method, wanted in (("freq", True), ("deseq", options.learn_deseq), ("q", options.learn_q)):
            if wanted:
                kept.model(method)
    return kept.rows
