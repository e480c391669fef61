import gzip

import pytest

from seqloom.__main__ import parser
from seqloom.plans.analysis import run
from seqloom.plans.options import OptionError, Options
from seqloom.sources import kept, readers, writers

from .test_kmers import EXAMPLE, GOLDEN


def put(path, text):
    path.write_text(text)
    return str(path)


@pytest.fixture
def samples(tmp_path):
    lines = []
    for name, seqs in EXAMPLE.items():
        paths = []
        for i, q in enumerate(seqs):
            p = tmp_path / f"{name}_{i}.fq.gz"
            p.write_bytes(gzip.compress(f"@r1 {name}\n{q}\n+\n{'@' * len(q)}\n@r2\nNNN\n+\n@@@\n".encode()))
            paths.append(str(p))
        lines.append(" ".join([name, *paths]))
    return put(tmp_path / "samples", "\n".join([lines[0], "", *lines[1:]]) + "\n")


def text_rows(path):
    from pathlib import Path

    return [line for f in sorted(Path(path).glob("part-*")) for line in f.read_text().splitlines()]


def test_whole_analysis(spark, samples, tmp_path):
    y, c = put(tmp_path / "y", "1 2\n3"), put(tmp_path / "c", "x\nx\ny\n")
    prefix = f"{tmp_path}/out"
    options = Options(outputs=("matrix", "fa"), totals=True, reuse=True, normalize="freq", save_normalized=True, cor=("pearson", "kendall"), phenotype=y,
                      diff=("anova", "dids", "snr"), classes=c, pval_corr="bh", entropy=True, n_top=2, cv=True, leave=1, pca=True, umap=True)
    matrix = run(spark, options, samples, prefix)
    assert {r["kmer"]: r["counts"] for r in matrix.collect()} == GOLDEN
    lines = text_rows(f"{prefix}_matrix")
    assert "k-mer\tsample1\tsample2\tsample3" in lines and "AAAACACACAAACAGATAAACAGAT\t1\t1\t0" in lines
    assert "tot_cnt\t4\t4\t4" in text_rows(f"{prefix}_tot_cnt") and len(text_rows(f"{prefix}.fa")) == 12
    assert len([x for x in text_rows(f"{prefix}_pearson_top") if not x.startswith("k-mer")]) == 2
    assert text_rows(f"{prefix}_pearson_top.fa")[0] == ">rank0"
    for suffix in ("_matrix_norm", "_kendall_tau", "_entropy_top_matrix", "_anova_cor", "_dids", "_snr_top", "_cv_pearson_2_3_top", "_pca", "_pca_variance", "_umap"):
        assert text_rows(prefix + suffix), suffix
    assert not (tmp_path / "out_anova").exists()
    log = (tmp_path / "out.log").read_text()
    assert "3 samples, k = 25" in log and "matrix: begun" in log and "statistics: " in log
    again = run(spark, options, samples, prefix)
    assert "out.db/matrix" in again.inputFiles()[0]
    assert kept.load(spark, f"{prefix}.db", options.matrix_settings(["other"])) is None


def test_a_failed_run_leaves_its_log(spark, tmp_path):
    f = put(tmp_path / "f", ">x\nAC\n")
    with pytest.raises(ValueError, match="empty"):
        run(spark, Options(k=5, fmt="fa"), put(tmp_path / "m", f"s {f}\n"), f"{tmp_path}/bad")
    assert "ValueError: the matrix is empty" in (tmp_path / "bad.log").read_text()


def test_manifest(spark, tmp_path):
    f = put(tmp_path / "f", ">x\nACGT\n")
    assert readers.manifest(spark, put(tmp_path / "m", f"{f}\n\ns {f} {f}\n")) == [readers.Sample(f, (f,)), readers.Sample("s", (f, f))]
    with pytest.raises(ValueError, match="twice"):
        readers.manifest(spark, put(tmp_path / "m2", f"a {f}\na {f}\n"))
    with pytest.raises(FileNotFoundError):
        readers.manifest(spark, put(tmp_path / "m3", "a /no/such\n"))
    with pytest.raises(ValueError, match="no samples"):
        readers.manifest(spark, put(tmp_path / "m4", "\n"))


def seqs(df):
    return sorted(r["seq"] for r in df.collect())


def test_sequence_formats(spark, tmp_path):
    fa = put(tmp_path / "a.fa", ">x one\nACGT\n>y\nTTTT\n")
    mf = put(tmp_path / "a.mf", ">x one\nACGT\nAC\n\n>y\nTT\nT\n")
    fq = put(tmp_path / "a.fq", "@a\nACGT\n+\n@+@+\n@b\nGGGG\n+b\n+@@@\n")
    assert seqs(readers.sequences(spark, [fa], "fa")) == ["ACGT", "TTTT"]
    assert seqs(readers.sequences(spark, [mf], "mf")) == ["ACGTAC", "TTT"]
    assert seqs(readers.sequences(spark, [fq], "fq")) == ["ACGT", "GGGG"]


def test_small_scans_are_dealt_out(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    spark.range(100).coalesce(1).write.parquet(path)
    whole = spark.read.parquet(path)
    assert readers.spread(whole).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r["id"] for r in readers.spread(whole).collect()) == list(range(100))
    monkeypatch.setattr(readers, "SMALL", 1)
    assert "RoundRobin" not in readers.spread(spark.read.parquet(path).repartition(8))._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]


def test_filter_files(spark, tmp_path):
    assert seqs(readers.filter_sequences(spark, put(tmp_path / "f1", "\n>x\nACG\nT\n"), 4)) == ["ACGT"]
    assert seqs(readers.filter_sequences(spark, put(tmp_path / "f2", "ACGT TTTT\nCCCC\n"), 4)) == ["ACGT", "CCCC", "TTTT"]
    with pytest.raises(Exception, match="not of length"):
        readers.filter_sequences(spark, put(tmp_path / "f3", "ACG\n"), 4).collect()


def test_phenotypes(spark, tmp_path):
    assert readers.numeric_phenotype(spark, put(tmp_path / "p", "1 2.5\n-3e2\n"), 3) == [1, 2.5, -300]
    for text, n in (("1 2", 3), ("1 x", 2)):
        with pytest.raises(ValueError, match="p2"):
            readers.numeric_phenotype(spark, put(tmp_path / "p2", text), n)
    assert readers.class_ids("1 0 0 1".split()) == [1, 0, 0, 1] and readers.class_ids("b a b".split()) == [0, 1, 0]
    for bad in (["1", "2"], ["a", "a"]):
        with pytest.raises(ValueError, match="class"):
            readers.class_ids(bad)


def test_numbers(spark):
    values = [0.0, 1.5, -2.0, 0.000123456789, 1234567.0, 100.0, float("nan"), float("inf"), float("-inf"), 1e-9, 999999.5, 0.1 + 0.2]
    values += [1200.0, -123456.0, 12345.67, 0.05, 0.00012, 1e-4, 1e-5, 123e-7, 1.7e308, 2500000.0, 12.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(writers.number(df.v)).collect()]
    assert got[:12] == ["0", "1.5", "-2", "0.000123457", "1.23457e+06", "1e+02", "nan", "inf", "-inf", "1e-09", "1.00000e+06", "0.300000"]
    assert got[12:] == ["1.2e+03", "-123456", "12345.7", "0.05", "0.00012", "0.0001", "1e-05", "1.23e-05", "1.7e+308", "2.5e+06", "12"]


def test_option_rules():
    Options(normalize="freq", cor=("pearson", "pearson"), phenotype="p").check()
    assert Options(cor=("pearson", "pearson")).cor == ("pearson",)
    for bad in (
        dict(cor=("pearson",), phenotype="p"), dict(diff=("anova",), classes="c"), dict(dimensions=2), dict(pval_corr="bh"), dict(diff=("ttest",)), dict(n_top=3),
        dict(diff=("ttest",), classes="c", dids_mode="tanh"), dict(learn_q=True), dict(k=0), dict(k=257), dict(thr_rat=1.5), dict(cs=1), dict(save_normalized=True), dict(cv=True), dict(umap=True),
    ):
        with pytest.raises(OptionError):
            Options(**bad).check()
    Options(diff=("ttest",), classes="c", pval_corr="b").check()
    with pytest.warns(UserWarning, match="no effect"):
        Options(thr=2).check()
    with pytest.raises(OptionError, match="two classes"):
        Options(diff=("ttest",), classes="c").check_samples(3, [0, 1, 2])
    with pytest.raises(OptionError, match="leave"):
        Options(cv=True, cor=("pearson",), leave=3).check_samples(8, None)
    args = parser().parse_args("s p -k 31 --cor pearson spearman -b --umap-min-dist 0.2".split())
    assert args.k == 31 and args.cor == ["pearson", "spearman"] and not args.canonical and args.umap_min_dist == 0.2
