"""The kept matrix: buckets, observed totals, samples added later, models beside it."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import matrix as mx
from seqloom.operators import normalize
from seqloom.plans.analysis import run
from seqloom.plans.options import Options
from seqloom.sources import kept

from .test_files import put, text_rows
from .test_whole_jobs import against_sql

NAMES = ["a", "b", "c", "d"]


def made_with(names, **options):
    return Options(k=5, **options).matrix_settings(names)


@pytest.fixture(scope="module")
def reads(spark):
    rng = np.random.default_rng(7)
    rows = [(NAMES[i % 4], "".join(rng.choice(list("ACGT"), 60))) for i in range(40)]
    return spark.createDataFrame([*rows, ("e", "ACGTACGT"), (None, "AAAAAAA"), ("a", None)], "sample string, seq string")


def rows_of(matrix):
    return {r["kmer"]: r["counts"] for r in matrix.collect()}


def exchanges(df):
    return re.findall(r"Exchange (\w+)", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize(("first", "later"), [(["a", "b", "c"], ["d"]), (["d", "b"], ["c", "a"]), (["c"], ["a", "b", "d"])])
@pytest.mark.parametrize("cutoffs", [{}, {"ci": 2, "cs": 3}])
def test_grown_is_recounted(spark, reads, tmp_path, first, later, cutoffs):
    path = f"{tmp_path}/it's.db"
    kept.save(mx.of_reads(reads, first, 5, **cutoffs), path, made_with(first, **cutoffs), buckets=6)
    old = kept.part(spark, path, made_with(NAMES, **cutoffs))
    found = kept.grow(old, mx.of_reads(reads, later, 5, **cutoffs), later, made_with(NAMES, **cutoffs))
    whole = mx.of_reads(reads, NAMES, 5, **cutoffs)
    assert rows_of(found.rows) == rows_of(whole)
    assert (found.n_rows, found.totals, found.buckets) == (*mx.size_and_totals(whole, NAMES), 6)
    assert rows_of(kept.load(spark, path, made_with(NAMES, **cutoffs)).rows) == rows_of(whole)
    assert len(list(tmp_path.glob("it's.db/matrix-*"))) == 1  # the old table is gone


def test_only_new_samples_are_shuffled(spark, reads, tmp_path):
    old = kept.save(mx.of_reads(reads, NAMES[:3], 5), f"{tmp_path}/db", made_with(NAMES[:3]), buckets=6)
    fresh = spark.createDataFrame([("AAAAA", [1])], "kmer string, counts array<bigint>")
    plan = kept.joined(old, fresh, ["d"], NAMES)
    assert exchanges(plan) == ["hashpartitioning"]
    assert "SelectedBucketsCount: 6 out of 6" in plan._jdf.queryExecution().executedPlan().toString()
    # so are set filters: the set moves, the matrix does not
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        wanted = fresh.repartition(6, "kmer")
        assert exchanges(mx.filter_rows(old.rows, keep=wanted)) == ["hashpartitioning"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_bucket_is_a_file(spark, reads, tmp_path):
    kept.save(mx.of_reads(reads, NAMES[:3], 5), f"{tmp_path}/db", made_with(NAMES[:3]), buckets=6)
    grown = kept.grow(kept.part(spark, f"{tmp_path}/db", made_with(NAMES)), mx.of_reads(reads, ["d"], 5), ["d"], made_with(NAMES))
    assert len(grown.rows.inputFiles()) == 6
    per_file = grown.rows.groupBy(F.input_file_name()).agg(F.collect_set(F.pmod(F.hash("kmer"), F.lit(6))).alias("b"))
    assert sorted(r["b"] for r in per_file.collect()) == [[b] for b in range(6)]


def test_what_does_not_go_together_is_not_reused(spark, reads, tmp_path):
    path = f"{tmp_path}/db"
    assert kept.load(spark, path, made_with(NAMES)) is None and kept.part(spark, path, made_with(NAMES)) is None
    kept.save(mx.of_reads(reads, NAMES[:3], 5), path, made_with(NAMES[:3]))
    assert kept.part(spark, path, made_with(NAMES, ci=2)) is None
    assert kept.part(spark, path, made_with(["a", "b", "d"])) is None  # has a sample that is not wanted
    assert kept.part(spark, path, made_with(NAMES, thr_rat=0.5)) is None
    kept.save(mx.of_reads(reads, NAMES[:3], 5), path, made_with(NAMES[:3], thr_rat=0.5))
    assert kept.part(spark, path, made_with(NAMES, thr_rat=0.5)) is None  # a dropped k-mer may pass with more samples


def test_empty_matrices(spark, reads, tmp_path):
    none = mx.of_reads(reads.where("false"), NAMES[:2], 5)
    empty = kept.save(none, f"{tmp_path}/db", made_with(NAMES[:2]))
    assert (empty.n_rows, empty.totals) == (0, [0, 0])
    grown = kept.grow(empty, mx.of_reads(reads, ["d"], 5), ["d"], made_with(["d", "a", "b"]))
    assert grown.n_rows > 0 and grown.totals[1:] == [0, 0]
    again = kept.grow(grown, none.select("kmer", F.slice("counts", 1, 1).alias("counts")), ["c"], made_with(["c", "d", "a", "b"]))
    assert again.totals == [0, *grown.totals] and again.n_rows == grown.n_rows


@pytest.mark.parametrize("method", ["freq", "deseq", "q", "deseq_freq"])
def test_models_beside_the_table(spark, reads, tmp_path, method):
    table = kept.save(mx.of_reads(reads, NAMES, 5), f"{tmp_path}/db", made_with(NAMES))
    expected = normalize.learn(table.rows, 4, method).transform(table.rows)
    for _ in range(2):  # learned, then read
        got = {r["kmer"]: r["norm"] for r in table.model(method).transform(table.rows).collect()}
        for r in expected.collect():
            assert got[r["kmer"]] == pytest.approx(r["norm"], rel=1e-12)
    assert len(list(tmp_path.glob(f"db/norm_{method}-*/_SUCCESS"))) == 1


def test_frequencies_need_no_scan_of_a_kept_table(spark, reads, tmp_path):
    table = kept.save(mx.of_reads(reads, NAMES, 5), f"{tmp_path}/db", made_with(NAMES))
    expected = normalize.learn_frequency(table.rows, 4).values
    assert normalize.learn(None, 4, "freq", table.totals).values == expected


def test_a_run_adds_its_new_samples(spark, tmp_path):
    rng = np.random.default_rng(3)
    files = {n: put(tmp_path / f"{n}.fa", "".join(f">r\n{''.join(rng.choice(list('ACGT'), 80))}\n" for _ in range(5))) for n in NAMES}
    manifest = lambda names: put(tmp_path / f"m{len(names)}", "".join(f"{n} {files[n]}\n" for n in names))
    options = Options(k=7, fmt="fa", reuse=True, totals=True, normalize="freq", save_normalized=True)
    run(spark, options, manifest(["b", "d"]), f"{tmp_path}/x")
    got = rows_of(run(spark, options, manifest(NAMES), f"{tmp_path}/x"))
    assert "2 of 4 samples are kept" in (tmp_path / "x.log").read_text()
    assert got == rows_of(run(spark, Options(k=7, fmt="fa", totals=True, normalize="freq", save_normalized=True), manifest(NAMES), f"{tmp_path}/y"))
    for suffix in ("_tot_cnt", "_matrix_norm"):
        assert sorted(text_rows(f"{tmp_path}/x{suffix}")) == sorted(text_rows(f"{tmp_path}/y{suffix}"))


@pytest.mark.parametrize("name", ["sink_kept_matrix", "kept_matrix_grown", "kept_matrix_observed", "sink_number_text"])
def test_queries_through_tables_and_text(spark, name):
    against_sql(spark, name)
