"""Registered queries over the driver's tables, each with the SQL that gives the same rows.

Documents serve as reads: their letters stand for bases, their source is the sample. Phenotypes are
made from the sample's number. The matrix has a column for each of ``SAMPLES``; documents of another
source, or of none, are an error, as they would have no column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import kmers, packed, rowstats
from seqloom.operators import matrix as mx
from seqloom.operators import normalize, pvalues, reduce, select
from seqloom.sources import readers
from seqloom.sources.scratch import materialize

K = 6
N = 20
SAMPLES = [f"src{i}" for i in range(N)]
COUNTS = [f"c{i}" for i in range(N)]
PHENOTYPE = [float(7 * i % 11) for i in range(N)]
TWO = [i % 2 for i in range(N)]
THREE = [i % 3 for i in range(N)]
FLAGS = ["AF", "NF", "NO", "RF"]
TOP = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    unknown = F.raise_error(F.concat(F.lit("no column for source "), F.coalesce("source", F.lit("null")))).cast("string")
    sample = F.when(F.col("source").isin(SAMPLES), F.col("source")).otherwise(unknown)
    documents = readers.spread(table(spark, sf_dir, "documents").select("source", "text"))
    return documents.select(sample.alias("sample"), kmers.pseudo_dna(F.col("text")).alias("seq"))


def base(spark: SparkSession, sf_dir: str, canonical: bool = True, **cutoffs) -> DataFrame:
    return mx.of_reads(reads(spark, sf_dir), SAMPLES, K, canonical, **cutoffs)


#: Bases of the long k-mers, which cross the ends of words: documents are read as one run of their letters.
LONG = 25
LETTERS = packed.alphabet(kmers.LETTERS, kmers.BASES, packed.SKIP)


def long_reads(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """Whole texts as sequences, to be read by ``LETTERS``."""
    rows = readers.spread(table(spark, sf_dir, name))
    sample = F.col("source") if "source" in rows.columns else F.lit("")
    return rows.select(sample.alias("sample"), F.col("text").alias("seq"))


def normalized(spark: SparkSession, sf_dir: str, method: str = "deseq") -> DataFrame:
    matrix = materialize(base(spark, sf_dir), "matrix")  # read to learn and to transform, counted once
    return normalize.learn(matrix, N, method).transform(matrix)


def wide(matrix: DataFrame, values: str = "counts") -> DataFrame:
    out = mx.wide(matrix, values, COUNTS, "kmer")
    return out if values == "counts" else out.select("kmer", *[F.round(c, 9).alias(c) for c in COUNTS])


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.select("kmer", *[F.round(c, places).alias(c) for c in columns])


def anova_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANOVA of every row, kept for the passes of a correction."""
    return materialize(rowstats.anova(normalized(spark, sf_dir), "norm", THREE).select("kmer", "anova_p"), "anova")


def benchmark_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.packed_set(table(spark, sf_dir, "benchmark").select(kmers.pseudo_dna(F.col("text")).alias("seq")), K)


# ---------------------------------------------------------------- SQL

OCC = f"""dna AS (SELECT source, translate(text, '{kmers.LETTERS}', '{kmers.BASES}') AS seq FROM documents),
runs AS (SELECT source, unnest(regexp_extract_all(seq, '[ACGT]{{{K},}}')) AS run FROM dna),
occ AS (SELECT source, unnest(list_transform(range(1, len(run) - {K - 2}), lambda i: run[i:i+{K - 1}])) AS w FROM runs)"""
CANON = "least(w, reverse(translate(w, 'ACGT', 'TGCA')))"


def cells(canonical: bool = True, value: str = "least(n, 65535)", samples: str = f"SELECT 'src' || i AS source, i FROM range({N}) t(i)", occ: str = OCC, km: str | None = None) -> str:
    """CTEs down to ``cells(kmer, i, x)``: the dense matrix, a row per k-mer and sample."""
    km = km or f"SELECT source, {CANON if canonical else 'w'} AS kmer FROM occ"
    return f"""{occ},
km AS ({km}),
cnt AS (SELECT kmer, source, count(*) AS n FROM km GROUP BY ALL),
kept AS (SELECT kmer, source, {value} AS n FROM cnt),
smp AS ({samples}),
rws AS (SELECT DISTINCT kmer FROM kept JOIN smp USING (source) WHERE n > 0),
cells AS (SELECT r.kmer, s.i, coalesce(c.n, 0)::BIGINT AS x FROM rws r CROSS JOIN smp s
          LEFT JOIN kept c ON c.kmer = r.kmer AND c.source = s.source)"""


def pivot(source: str = "cells", value: str = "x", names: list[str] = COUNTS, key: str = "kmer", where: str = "") -> str:
    listed = ", ".join(f"max({value}) FILTER (i = {i}) AS {c}" for i, c in enumerate(names))
    return f"SELECT kmer AS {key}, {listed} FROM {source} {where} GROUP BY kmer"


FREQ = "norm AS (SELECT kmer, i, x, x * (1.0::DOUBLE / sum(x) OVER (PARTITION BY i)) AS v FROM cells)"
DESEQ = """whole AS (SELECT kmer FROM cells GROUP BY kmer HAVING min(x) > 0),
ratio AS (SELECT i, ln(x) - avg(ln(x)) OVER (PARTITION BY kmer) AS r FROM cells SEMI JOIN whole USING (kmer)),
factor AS (SELECT i, 1 / exp(median(r)) AS f FROM ratio GROUP BY i),
norm AS (SELECT kmer, i, x, x * coalesce(f, 1.0) AS v FROM cells LEFT JOIN factor USING (i))"""
QUANT = f"""ordered AS (SELECT kmer, i, x, row_number() OVER (PARTITION BY i ORDER BY x, kmer) AS r FROM cells),
ref AS (SELECT r, sum(x) / {N}::DOUBLE AS m FROM ordered GROUP BY r),
mapped AS (SELECT i, x, avg(m) AS v FROM ordered JOIN ref USING (r) GROUP BY i, x),
norm AS (SELECT kmer, i, x, v FROM cells JOIN mapped USING (i, x))"""


def _case(values: list, column: str = "i") -> str:
    return f"(CASE {column} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END)"


Y = _case(PHENOTYPE)
RANKED = """rk AS (SELECT *, rank() OVER (PARTITION BY kmer ORDER BY v) - 1 + (count(*) OVER (PARTITION BY kmer, v) - 1) / 2.0 AS rv FROM norm)"""


def corr_sql(source: str, x: str, y: str, where: str = "") -> str:
    return f"""dev AS (SELECT kmer, {x} - avg({x}) OVER (PARTITION BY kmer) AS a, {y} - avg({y}) OVER (PARTITION BY kmer) AS b FROM {source} {where}),
cor AS (SELECT kmer, CASE WHEN sqrt(sum(a * a)) * sqrt(sum(b * b)) = 0 THEN 1.0
        ELSE sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) END AS r FROM dev GROUP BY kmer)"""


def y_ranks() -> str:
    import numpy as np

    return _case([float(x) for x in rowstats.average_ranks(np.array([PHENOTYPE]))[0]])


def moments(value: str, classes: int = 2) -> str:
    return f"""grp AS (SELECT kmer, i % {classes} AS c, count(*) AS n, avg({value}) AS m, coalesce(stddev_samp({value}), 0) AS s FROM norm GROUP BY ALL),
two AS (SELECT a.kmer, a.n AS n0, a.m AS m0, a.s AS s0, b.n AS n1, b.m AS m1, b.s AS s1 FROM grp a JOIN grp b ON a.kmer = b.kmer AND a.c = 0 AND b.c = 1)"""


ANOVA = f"""tot AS (SELECT kmer, sum(v) AS s, sum(v * v) AS q FROM norm GROUP BY kmer),
grp AS (SELECT kmer, i % 3 AS c, count(*) AS n, avg(v) AS m FROM norm GROUP BY ALL),
bg AS (SELECT kmer, sum(n * (m - s / {N}) * (m - s / {N})) AS b FROM grp JOIN tot USING (kmer) GROUP BY kmer),
fst AS (SELECT kmer, (b / 2) / ((q - s * s / {N} - b) / {N - 3}) AS f FROM bg JOIN tot USING (kmer)),
pv AS (SELECT kmer, f, power(1 + 2 * f / {N - 3}, -{N - 3} / 2.0) AS p FROM fst)"""


def simpson(term: str, upto: str, steps: int = 400) -> str:
    """The integral of ``term`` in {{x}} from 0 to ``upto``."""
    at = term.format(x=f"({upto} * g / {steps})")
    return f"""({upto}) / {3 * steps} * list_sum(list_transform(range({steps + 1}), lambda g:
       (CASE WHEN g = 0 OR g = {steps} THEN 1 WHEN g % 2 = 1 THEN 4 ELSE 2 END) * {at}))"""


def dids_sql(f: str) -> str:
    return f"""mxs AS (SELECT kmer, i % 3 AS c, greatest(0, max(v)) AS m FROM norm GROUP BY ALL),
exc AS (SELECT n.kmer, m.c, sum(CASE WHEN n.v > m.m THEN {f.format(d='(n.v - m.m)')} ELSE 0 END) AS s
        FROM norm n JOIN mxs m ON n.kmer = m.kmer AND n.i % 3 <> m.c GROUP BY ALL),
did AS (SELECT kmer, max(s) AS d FROM exc GROUP BY kmer)"""


CORRECTED = {
    "b": "least(1.0, p * m)",
    "hb": "least(1.0, max(p * (m - lo)) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING))",
    "bh": "least(1.0, min(p * m / hi) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING))",
    "by": "least(1.0, min(p * m / hi * h) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING))",
}


def corrected_sql(method: str) -> str:
    return f"""{ANOVA},
pos AS (SELECT kmer, p, count(*) OVER () AS m, rank() OVER (ORDER BY p) - 1 AS lo,
        count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS hi,
        (SELECT sum(1.0::DOUBLE / g) FROM range(1, (SELECT count(*) + 1 FROM pv)) t(g)) AS h FROM pv),
cor AS (SELECT kmer, {CORRECTED[method]} AS pc FROM pos)"""


def long_cells() -> str:
    """CTEs down to ``cnt(kmer, source, n)`` and ``lset(kmer)`` of the long k-mers of documents and benchmark passages."""
    windows = lambda t, keep: f"""SELECT {keep}unnest(list_transform(range(1, greatest(len(q) - {LONG - 2}, 1)), lambda i: q[i:i+{LONG - 1}])) AS w
FROM (SELECT {keep}translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{kmers.LETTERS}', '{kmers.BASES}') AS q FROM {t})"""  # noqa: E731
    return f"""occ AS ({windows('documents', 'source, ')}),
cnt AS (SELECT source, {CANON} AS kmer, count(*) AS n FROM occ GROUP BY ALL),
lset AS (SELECT DISTINCT {CANON} AS kmer FROM ({windows('benchmark', '')}))"""


def long_pivot(where: str) -> str:
    listed = ", ".join(f"coalesce(max(least(n, 65535)) FILTER (source = '{s}'), 0)::BIGINT AS {c}" for s, c in zip(SAMPLES, COUNTS, strict=True))
    return f"SELECT kmer, {listed} FROM cnt WHERE {where} GROUP BY kmer"


def sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


LINES = """li AS (SELECT p_brand AS w, l_returnflag || l_linestatus AS source FROM lineitem JOIN part ON l_partkey = p_partkey)"""
FLAG_SMP = "SELECT * FROM (VALUES " + ", ".join(f"('{f}', {i})" for i, f in enumerate(FLAGS)) + ") t(source, i)"
BRANDS = cells(value="n", samples=FLAG_SMP, occ=LINES, km="SELECT source, w AS kmer FROM li")
BENCH = f"""bd AS (SELECT translate(text, '{kmers.LETTERS}', '{kmers.BASES}') AS seq FROM benchmark),
br AS (SELECT unnest(regexp_extract_all(seq, '[ACGT]{{{K},}}')) AS run FROM bd),
bo AS (SELECT unnest(list_transform(range(1, len(run) - {K - 2}), lambda i: run[i:i+{K - 1}])) AS w FROM br),
bset AS (SELECT DISTINCT {CANON} AS kmer FROM bo)"""


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    occurrences = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", F.concat("l_returnflag", "l_linestatus").alias("sample"))
    return mx.merge(occurrences, FLAGS, cs=4_294_967_295, key="p_brand").withColumnRenamed("p_brand", "kmer")


# ---------------------------------------------------------------- registry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def _counting() -> None:
    for name, canonical in (("canonical", True), ("raw", False)):
        register(
            f"kmer_count_{name}",
            lambda s, d, c=canonical: mx.count_reads(reads(s, d), SAMPLES, K, c),
            sql(OCC, select=f"SELECT source AS sample, {CANON if canonical else 'w'} AS kmer, count(*) AS n FROM occ GROUP BY ALL"),
        )
    for name, thr, ratio in (("any", 1, 0.0), ("half", 1, 0.5), ("all", 1, 1.0), ("thr", 3, 0.25)):
        have = f"WHERE kmer IN (SELECT kmer FROM cells GROUP BY kmer HAVING count(*) FILTER (x >= {thr}) / {N}.0 >= {ratio})"
        register(f"kmer_matrix_{name}", lambda s, d, t=thr, r=ratio: wide(mx.filter_rows(base(s, d), t, r)), sql(cells(), select=pivot(where=have)))
    register(
        "kmer_cutoffs",
        lambda s, d: wide(base(s, d, ci=2, cx=60, cs=25)),
        sql(cells(value="CASE WHEN n >= 2 AND n <= 60 THEN least(n, 25) ELSE 0 END"), select=pivot()),
    )
    register("kmer_matrix_noncanonical", lambda s, d: wide(base(s, d, canonical=False)), sql(cells(canonical=False), select=pivot()))
    for name, keep in (("filter_set", True), ("except_set", False)):
        register(
            f"kmer_{name}",
            lambda s, d, k=keep: wide(base(s, d, **{"keep" if k else "drop": benchmark_set(s, d)})),
            sql(cells(), BENCH, select=pivot(where=f"WHERE kmer {'' if keep else 'NOT '}IN (SELECT kmer FROM bset)")),
        )
    shared = 4
    register(
        "kmer_matrix_long",
        lambda s, d: wide(mx.of_reads(long_reads(s, d), SAMPLES, LONG, threshold=1, ratio=shared / N, codes=LETTERS)),
        sql(long_cells(), f"often AS (SELECT kmer FROM cnt GROUP BY kmer HAVING count(*) >= {shared})", select=long_pivot("kmer IN (SELECT kmer FROM often)")),
    )
    register(
        "kmer_filter_set_long",
        lambda s, d: wide(mx.of_reads(long_reads(s, d), SAMPLES, LONG, keep=mx.packed_set(long_reads(s, d, "benchmark").select("seq"), LONG, codes=LETTERS), codes=LETTERS)),
        sql(long_cells(), select=long_pivot("kmer IN (SELECT kmer FROM lset)")),
    )
    register(
        "tot_cnt",
        lambda s, d: mx.totals(base(s, d), SAMPLES),
        sql(cells(), select="SELECT " + ", ".join(f"coalesce(sum(x) FILTER (i = {i}), 0)::BIGINT AS {c}" for i, c in enumerate(SAMPLES)) + " FROM cells"),
    )
    register(
        "count_intervals",
        lambda s, d: mx.intervals(base(s, d), F.col("counts")[0], [1, 5, 20, 100]).select(F.col("bin").cast("long"), "n"),
        sql(cells(), select="SELECT ((x >= 1)::BIGINT + (x >= 5)::BIGINT + (x >= 20)::BIGINT + (x >= 100)::BIGINT) AS bin, count(*) AS n FROM cells WHERE i = 0 GROUP BY 1"),
    )
    register(
        "count_intervals_all",
        lambda s, d: mx.intervals(base(s, d).select(F.posexplode("counts")).withColumn("sample", F.concat(F.lit("src"), "pos")), F.col("col"), [1, 5, 20, 100], "sample").select("sample", F.col("bin").cast("long"), "n"),
        sql(cells(), select="SELECT 'src' || i AS sample, ((x >= 1)::BIGINT + (x >= 5)::BIGINT + (x >= 20)::BIGINT + (x >= 100)::BIGINT) AS bin, count(*) AS n FROM cells GROUP BY 1, 2"),
    )


def _normalisation() -> None:
    for name, method, cte in (("freq", "freq", FREQ), ("deseq", "deseq", DESEQ), ("quantile", "q", QUANT)):
        register(f"norm_{name}", lambda s, d, m=method: wide(normalized(s, d, m), "norm"), sql(cells(), cte, select=pivot("norm", "round(v, 9)")))
    both = DESEQ + ", nf AS (SELECT kmer, i, v / sum(x) OVER (PARTITION BY i) AS v FROM norm)"
    register("norm_deseq_freq", lambda s, d: wide(normalized(s, d, "deseq_freq"), "norm"), sql(cells(), both, select=pivot("nf", "round(v, 9)")))


def _correlation() -> None:
    register(
        "cor_pearson",
        lambda s, d: rounded(rowstats.pearson(normalized(s, d), "norm", PHENOTYPE), "pearson"),
        sql(cells(), DESEQ, corr_sql("norm", "v", Y), select="SELECT kmer, round(r, 6) AS pearson FROM cor"),
    )
    register(
        "cor_spearman",
        lambda s, d: rounded(rowstats.spearman(normalized(s, d), "norm", PHENOTYPE), "spearman"),
        sql(cells(), DESEQ, RANKED, corr_sql("rk", "rv", y_ranks()), select="SELECT kmer, round(r, 6) AS spearman FROM cor"),
    )
    pairs = f"""prs AS (SELECT a.kmer, sign(a.v - b.v) AS s, sign({_case(PHENOTYPE, 'a.i')} - {_case(PHENOTYPE, 'b.i')}) AS t
FROM norm a JOIN norm b ON a.kmer = b.kmer AND a.i < b.i)"""
    tau = "sum(s * t) / sqrt(sum(abs(s))::DOUBLE * sum(abs(t)))"
    register(
        "cor_kendall",
        lambda s, d: rounded(rowstats.kendall(normalized(s, d), "norm", PHENOTYPE), "kendall_tau"),
        sql(cells(), DESEQ, pairs, select=f"SELECT kmer, round(CASE WHEN sum(abs(s)) = 0 THEN 'nan'::DOUBLE ELSE {tau} END, 6) AS kendall_tau FROM prs GROUP BY kmer"),
    )
    tests = select.folds(N, 2)
    kept = [f"i NOT IN {tuple(t)} AND j NOT IN {tuple(t)}" for t in tests]
    by_fold = ", ".join(
        f"round(CASE WHEN sum(abs(s)) FILTER ({c}) = 0 THEN 'nan'::DOUBLE ELSE sum(s * t) FILTER ({c}) / sqrt(sum(abs(s)) FILTER ({c})::DOUBLE * sum(abs(t)) FILTER ({c})) END, 6) AS cv_kendall_{f}"
        for f, c in enumerate(kept)
    )
    register(
        "cv_kendall_folds",
        lambda s, d: rounded(select.cross_validate(normalized(s, d), "norm", PHENOTYPE, "kendall")[0], *[f"cv_kendall_{f}" for f in range(len(tests))]),
        sql(cells(), DESEQ, pairs.replace("SELECT a.kmer,", "SELECT a.kmer, a.i AS i, b.i AS j,"), select=f"SELECT kmer, {by_fold} FROM prs GROUP BY kmer"),
    )
    entropy = "SELECT kmer, (ln(sum(x + {p})) - sum((x + {p}) * ln(x + {p})) / sum(x + {p})) / ln(2) AS e FROM cells GROUP BY kmer"
    register(
        "entropy",
        lambda s, d: rounded(rowstats.entropy(base(s, d), "counts", N), "entropy"),
        sql(cells(), f"en AS ({entropy.format(p=1)})", select="SELECT kmer, round(e, 6) AS entropy FROM en"),
    )
    full = "fullrows AS (SELECT kmer FROM cells GROUP BY kmer HAVING min(x) > 0)"
    register(
        "entropy_plain",
        lambda s, d: rounded(rowstats.entropy(mx.filter_rows(base(s, d), 1, 1.0), "counts", N, pseudo=0), "entropy"),
        sql(cells(), full, f"en AS ({entropy.format(p=0).replace('FROM cells', 'FROM cells SEMI JOIN fullrows USING (kmer)')})", select="SELECT kmer, round(e, 6) AS entropy FROM en"),
    )
    for method, source, x, y in (("pearson", DESEQ, "v", Y), ("spearman", DESEQ, None, None)):
        tests = select.folds(N, 2)
        if method == "pearson":
            parts = [
                f"SELECT kmer, {f} AS fold, r FROM (WITH {corr_sql('norm', x, y, f'WHERE i NOT IN ({t[0]}, {t[1]})')} SELECT * FROM cor)" for f, t in enumerate(tests)
            ]
        else:
            import numpy as np

            parts = []
            for f, t in enumerate(tests):
                train = [i for i in range(N) if i not in t]
                ranks = rowstats.average_ranks(np.array([[PHENOTYPE[i] for i in train]]))[0]
                yr = "(CASE i " + " ".join(f"WHEN {i} THEN {float(r)}" for i, r in zip(train, ranks, strict=True)) + " END)"
                fold_rank = RANKED.replace("FROM norm", f"FROM norm WHERE i NOT IN ({t[0]}, {t[1]})")
                parts.append(f"SELECT kmer, {f} AS fold, r FROM (WITH {fold_rank}, {corr_sql('rk', 'rv', yr)} SELECT * FROM cor)")
        # three queries cover all folds; the first keeps its SQL
        for name, some in (("fold", range(3)), ("folds_3_5", range(3, 6)), ("folds_6_9", range(6, len(tests)))):
            folded = "fld AS (" + " UNION ALL ".join(parts[f] for f in some) + ")"
            listed = ", ".join(f"round(max(r) FILTER (fold = {f}), 6) AS cv_{method}_{f}" for f in some)
            register(
                f"cv_{method}_{name}",
                lambda s, d, m=method, some=some: rounded(select.cross_validate(normalized(s, d), "norm", PHENOTYPE, m)[0], *[f"cv_{m}_{f}" for f in some]),
                sql(cells(), source, folded, select=f"SELECT kmer, {listed} FROM fld GROUP BY kmer"),
            )


def _tests() -> None:
    welch = f"""wl AS (SELECT kmer, m0, m1, s0 * s0 / n0 AS v0, s1 * s1 / n1 AS v1, n0, n1 FROM two),
tt AS (SELECT kmer, CASE WHEN v0 + v1 = 0 THEN 'nan'::DOUBLE ELSE (m0 - m1) / sqrt(v0 + v1) END AS t,
       CASE WHEN v0 + v1 = 0 THEN 'nan'::DOUBLE ELSE (v0 + v1) * (v0 + v1) / (v0 * v0 / (n0 - 1) + v1 * v1 / (n1 - 1)) END AS df FROM wl)"""
    plain = "norm AS (SELECT kmer, i, x, x::DOUBLE AS v FROM cells)"
    register(
        "ttest_stat",
        lambda s, d: rounded(rowstats.welch(base(s, d), "counts", TWO, pvalue=False), "ttest_stat", "ttest_df"),
        sql(cells(), plain, moments("log2(v + 1)"), welch, select="SELECT kmer, round(t, 6) AS ttest_stat, round(df, 6) AS ttest_df FROM tt"),
    )
    # P(|T| >= t) = 1 - 2 / B(1/2, df/2) * integral of cos(a) ** (df - 1) from 0 to atan(t / sqrt(df)), by Simpson's rule
    tail = f"""tp AS (SELECT kmer, t, df, CASE WHEN isnan(t) THEN 'nan'::DOUBLE ELSE greatest(0, least(1, 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi())
       * {simpson("power(cos({x}), df - 1)", "atan(abs(t) / sqrt(df))")})) END AS p FROM tt)"""
    register(
        "ttest_full",
        lambda s, d: rounded(rowstats.welch(base(s, d), "counts", TWO), "ttest_p", "ttest_df", "ttest_stat"),
        sql(cells(), plain, moments("log2(v + 1)"), welch, tail, select="SELECT kmer, round(p, 6) AS ttest_p, round(df, 6) AS ttest_df, round(t, 6) AS ttest_stat FROM tp"),
    )
    pooled = "sqrt(((n0 - 1) * s0 * s0 + (n1 - 1) * s1 * s1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1))"
    register(
        "student_stat",
        lambda s, d: rounded(rowstats.student(normalized(s, d), "norm", TWO), "student_stat"),
        sql(cells(), DESEQ, moments("v"), select=f"SELECT kmer, round(CASE WHEN {pooled} = 0 THEN 'nan'::DOUBLE ELSE (m0 - m1) / {pooled} END, 6) AS student_stat FROM two"),
    )
    snr = "CASE WHEN s0 = 0 OR s1 = 0 THEN 0 ELSE abs(m0 - m1) / (s0 + s1) END"
    for name, cte, make in (("snr", DESEQ, normalized), ("snr_raw", plain, base)):
        values = "norm" if name == "snr" else "counts"
        register(
            name,
            lambda s, d, m=make, v=values: rounded(rowstats.signal_to_noise(m(s, d), v, TWO), "snr"),
            sql(cells(), cte, moments("v"), select=f"SELECT kmer, round({snr}, 6) AS snr FROM two"),
        )
    u1 = f"sum(rv + 1) FILTER (i % 2 = 0) - {(N // 2) * (N // 2 + 1) / 2}"
    register(
        "wrs_u",
        lambda s, d: rounded(rowstats.rank_sum(normalized(s, d), "norm", TWO, pvalue=False), "wrs_u1", "wrs_u2"),
        sql(cells(), DESEQ, RANKED, select=f"SELECT kmer, round({u1}, 6) AS wrs_u1, round({(N // 2) ** 2} - ({u1}), 6) AS wrs_u2 FROM rk GROUP BY kmer"),
    )
    half = N // 2
    us = f"""us AS (SELECT kmer, {u1} AS u1, {half**2} - ({u1}) AS u2 FROM rk GROUP BY kmer),
tied AS (SELECT kmer, sum(t * t * t - t) AS ties FROM (SELECT kmer, v, count(*)::DOUBLE AS t FROM norm GROUP BY ALL) GROUP BY kmer),
zs AS (SELECT kmer, u1, u2, (greatest(u1, u2) - {half**2 / 2} - 0.5) / nullif(sqrt({half**2 / 2} / 6 * ({N + 1} - ties / {N * (N - 1)})), 0) AS z FROM us JOIN tied USING (kmer)),
wp AS (SELECT kmer, u1, u2, CASE WHEN z IS NULL OR z <= 0 THEN 1 ELSE greatest(0, 1 - 2 / sqrt(2 * pi()) * {simpson("exp(-{x} * {x} / 2)", "z")}) END AS p FROM zs)"""
    register(
        "wrs_full",
        lambda s, d: rounded(rowstats.rank_sum(normalized(s, d), "norm", TWO), "wrs_p", "wrs_u1", "wrs_u2"),
        sql(cells(), DESEQ, RANKED, us, select="SELECT kmer, round(p, 6) AS wrs_p, round(u1, 6) AS wrs_u1, round(u2, 6) AS wrs_u2 FROM wp"),
    )
    register(
        "anova",
        lambda s, d: rounded(rowstats.anova(normalized(s, d), "norm", THREE), "anova_p", "anova_stat"),
        sql(cells(), DESEQ, ANOVA, select="SELECT kmer, round(p, 6) AS anova_p, round(f, 6) AS anova_stat FROM pv"),
    )
    for mode, f in (("sqrt", "sqrt({d})"), ("quadratic", "{d} * {d}"), ("tanh", "(1 + tanh(3 * {d} - 3))")):
        register(
            f"dids_{mode}",
            lambda s, d, m=mode: rounded(rowstats.dids(normalized(s, d), "norm", THREE, m), "dids", places=5),
            sql(cells(), DESEQ, dids_sql(f), select="SELECT kmer, round(d, 5) AS dids FROM did"),
        )
    for method, name in (("b", "bonferroni"), ("hb", "holm"), ("bh", "bh"), ("by", "by")):
        register(
            f"pval_{name}",
            lambda s, d, m=method: rounded(pvalues.correct(anova_rows(s, d), "anova_p", m, "p_cor"), "p_cor"),
            sql(cells(), DESEQ, corrected_sql(method), select="SELECT kmer, round(pc, 6) AS p_cor FROM cor"),
        )
    register(
        "significant_kmers",
        lambda s, d: rounded(pvalues.significant(pvalues.correct(anova_rows(s, d), "anova_p", "bh", "p_cor"), "p_cor", 0.998), "p_cor"),
        sql(cells(), DESEQ, corrected_sql("bh"), select="SELECT kmer, round(pc, 6) AS p_cor FROM cor WHERE pc <= 0.998"),
    )


def _top() -> None:
    limit = f"ORDER BY v DESC, kmer LIMIT {TOP}"

    def best(df: DataFrame, column: str, absolute: bool = False) -> DataFrame:
        return select.top(rounded(df, column), column, TOP, absolute)

    register(
        "top_pearson",
        lambda s, d: best(rowstats.pearson(normalized(s, d), "norm", PHENOTYPE), "pearson", True),
        sql(cells(), DESEQ, corr_sql("norm", "v", Y), select=f"SELECT kmer, round(r, 6) AS pearson FROM cor ORDER BY abs(round(r, 6)) DESC, kmer LIMIT {TOP}"),
    )
    register(
        "top_entropy",
        lambda s, d: best(rowstats.entropy(base(s, d), "counts", N), "entropy"),
        sql(
            cells(),
            "en AS (SELECT kmer, round((ln(sum(x + 1)) - sum((x + 1) * ln(x + 1)) / sum(x + 1)) / ln(2), 6) AS v FROM cells GROUP BY kmer)",
            select=f"SELECT kmer, v AS entropy FROM en {limit}",
        ),
    )
    snr = "sn AS (SELECT kmer, round(CASE WHEN s0 = 0 OR s1 = 0 THEN 0 ELSE abs(m0 - m1) / (s0 + s1) END, 6) AS v FROM two)"
    register(
        "top_snr",
        lambda s, d: best(rowstats.signal_to_noise(normalized(s, d), "norm", TWO), "snr"),
        sql(cells(), DESEQ, moments("v"), snr, select=f"SELECT kmer, v AS snr FROM sn {limit}"),
    )
    register(
        "top_dids",
        lambda s, d: best(rowstats.dids(normalized(s, d), "norm", THREE), "dids"),
        sql(cells(), DESEQ, dids_sql("sqrt({d})"), "rd AS (SELECT kmer, round(d, 6) AS v FROM did)", select=f"SELECT kmer, v AS dids FROM rd {limit}"),
    )


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir, "freq").withColumn("norm", F.transform("norm", lambda x: x * 10_000))


def _reduction() -> None:
    def gram(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = reduce.gram(_scaled(spark, sf_dir), "norm", N)
        listed = [(i, j, round(float(g[i, j]), 4)) for i in range(N) for j in range(i, N)]
        return spark.createDataFrame(listed, "i long, j long, g double")

    centred = "ctr AS (SELECT kmer, i, 10000 * v - avg(10000 * v) OVER (PARTITION BY kmer) AS a FROM norm)"
    register(
        "pca_gram", gram,
        sql(cells(), FREQ, centred, select="SELECT a.i AS i, b.i AS j, round(sum(a.a * b.a), 4) AS g FROM ctr a JOIN ctr b ON a.kmer = b.kmer AND a.i <= b.i GROUP BY ALL"),
    )
    # sums of powers of the variances are traces of powers of the products, and distances of all scores are the samples' own
    gram_ctes = (
        "g AS (SELECT a.i AS i, b.i AS j, sum(a.a * b.a) AS g FROM ctr a JOIN ctr b ON a.kmer = b.kmer GROUP BY ALL)",
        "g2 AS (SELECT a.i AS i, b.j AS j, sum(a.g * b.g) AS g FROM g a JOIN g b ON a.j = b.i GROUP BY ALL)",
    )
    traces = f"""t1 AS (SELECT sum(g) AS t FROM g WHERE i = j)
SELECT 1::BIGINT AS power, round(t / {N - 1}, 4) AS total FROM t1
UNION ALL SELECT 2, round(sum(g / t / t), 8) FROM g2, t1 WHERE i = j
UNION ALL SELECT 3, round(sum(a.g / t * b.g / t / t), 8) FROM g a JOIN g2 b ON a.i = b.j AND a.j = b.i, t1"""

    # the first two components by multiplying a vector again and again, the second with the first taken out
    power = ",\n".join(
        f"""m{c} AS MATERIALIZED ({m}),
it{c}(k, v) AS (SELECT 0, list_transform(range({N}), lambda i: 1.0::DOUBLE + i % 7) UNION ALL
  SELECT k + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (SELECT k, list_transform(m, lambda r: list_dot_product(r, v)) AS w FROM it{c}, m{c} WHERE k < 3000)),
e{c} AS MATERIALIZED (SELECT v, sqrt(list_dot_product(w, w)) AS size FROM (SELECT v, list_transform(m, lambda r: list_dot_product(r, v)) AS w FROM it{c}, m{c} WHERE k = 3000))"""
        for c, m in (
            (1, "SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(g ORDER BY j) AS r FROM g GROUP BY i)"),
            (2, f"SELECT list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - size * v[i] * v[j])) AS m FROM m1, e1"),
        )
    ) + f""",
pc AS (SELECT 'PCA' || c AS d, list_transform(v, lambda x: x * sqrt(size)) AS s FROM (SELECT 1 AS c, v, size FROM e1 UNION ALL SELECT 2, v, size FROM e2)),
signed AS (SELECT d, CASE WHEN list_max(s) >= -list_min(s) THEN 1 ELSE -1 END AS g, s FROM pc)
SELECT d AS "Dimension", {", ".join(f"round(g * s[{i + 1}], 3) AS {n}" for i, n in enumerate(SAMPLES))} FROM signed"""  # fmt: skip

    def variance_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = reduce.pca(_scaled(spark, sf_dir), "norm", N)
        rows = [(1, round(float(found.variance.sum()), 4)), *((k, round(float((found.ratio**k).sum()), 8)) for k in (2, 3))]
        return spark.createDataFrame(rows, "power long, total double")

    def score_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = reduce.pca(_scaled(spark, sf_dir), "norm", N, N - 1).scores
        rows = [(i, j, round(float(((at[i] - at[j]) ** 2).sum()), 4)) for i in range(N) for j in range(i + 1, N)]
        return spark.createDataFrame(rows, "i long, j long, d2 double")

    register("pca_variance_powers", variance_powers, "WITH " + ",\n".join([cells(), FREQ, centred, *gram_ctes, traces]))
    register(
        "pca_score_distances", score_distances,
        sql(cells(), FREQ, select="SELECT a.i AS i, b.i AS j, round(sum((10000 * a.v - 10000 * b.v) * (10000 * a.v - 10000 * b.v)), 4) AS d2 FROM norm a JOIN norm b ON a.kmer = b.kmer AND a.i < b.i GROUP BY ALL"),
    )
    def scores(spark: SparkSession, sf_dir: str, found) -> DataFrame:
        table = reduce.coordinates_table(spark, found(_scaled(spark, sf_dir), "norm", N).scores, "PCA", SAMPLES)
        return table.select("Dimension", *[F.round(c, 3).alias(c) for c in SAMPLES])

    register("pca_scores", lambda s, d: scores(s, d, reduce.pca), "WITH RECURSIVE " + ",\n".join([cells(), FREQ, centred, *gram_ctes, power]))
    register("pca_scores_krylov", lambda s, d: scores(s, d, reduce.pca_by_products), ORACLES["pca_scores"])

    def variance(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _scaled(spark, sf_dir)
        return reduce.variance_table(spark, reduce.pca(rows, "norm", N), rows.count())

    register("pca_variance", variance)
    register("umap", lambda s, d: reduce.coordinates_table(s, reduce.umap(_scaled(s, d), "norm", N), "UMAP", SAMPLES))


def _lineitem() -> None:
    names = [f"n_{f.lower()}" for f in FLAGS]
    register("lineitem_matrix", lambda s, d: mx.wide(brands(s, d), "counts", names, "kmer"), sql(BRANDS, select=pivot(names=names)))
    register(
        "lineitem_matrix_freq",
        lambda s, d: (lambda m: mx.wide(normalize.learn(m, 4, "freq").transform(m), "norm", names, "kmer").select("kmer", *[F.round(c, 9).alias(c) for c in names]))(brands(s, d)),
        sql(BRANDS, FREQ, select=pivot("norm", "round(v, 9)", names)),
    )
    register(
        "lineitem_matrix_entropy",
        lambda s, d: rounded(rowstats.entropy(brands(s, d), "counts", 4), "entropy"),
        sql(BRANDS, select="SELECT kmer, round((ln(sum(x + 1)) - sum((x + 1) * ln(x + 1)) / sum(x + 1)) / ln(2), 6) AS entropy FROM cells GROUP BY kmer"),
    )


for _group in (_counting, _normalisation, _correlation, _tests, _top, _reduction, _lineitem):
    _group()
