"""Files in byte ranges: records longer than a range, many samples in one scan."""

import gzip
import random

import pytest

from seqloom.operators import matrix as mx
from seqloom.sources import readers

from .test_kmers import as_dict, plain_counts


def records(seed, lengths):
    r = random.Random(seed)
    return ["".join(r.choices("ACGTN", [9, 9, 9, 9, 0.2], k=n)) for n in lengths]


def fasta(seqs, width):
    return "".join(f">r{i} some text\n" + "".join(s[j : j + width] + "\n" for j in range(0, len(s), width)) for i, s in enumerate(seqs))


@pytest.mark.parametrize("size", ["23b", "300b", "4k", "1m"])
@pytest.mark.parametrize(("k", "width"), [(1, 60), (6, 60), (25, 7), (25, 70), (40, 11)])
def test_multi_line_records_in_ranges_of_any_size(spark, tmp_path, monkeypatch, size, k, width):
    monkeypatch.setattr(readers, "PIECE", 64)
    seqs = records(k + width, [900, 3, 0, 50, 24, 25, 1, 400])
    (tmp_path / "a.fa").write_text(fasta(seqs, width))
    (tmp_path / "b.fa").write_text(fasta(seqs[:2], width).rstrip("\n"))
    (tmp_path / "list").write_text(f"one {tmp_path}/a.fa\ntwo {tmp_path}/b.fa {tmp_path}/a.fa\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        found = readers.reads(spark, readers.manifest(spark, str(tmp_path / "list")), "mf", k)
        got = as_dict(mx.of_reads(found, ["one", "two"], k))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    one, two = plain_counts(seqs, k, True), plain_counts([*seqs, *seqs[:2]], k, True)
    assert got == {w: [one[w], two[w]] for w in two}


def test_a_long_record_comes_in_pieces(spark, tmp_path):
    text = ">chromosome\n" + ("ACGTTGCAAC" * 7 + "\n") * 100_000
    (tmp_path / "long.fa").write_text(text)
    samples = [readers.Sample("s", (str(tmp_path / "long.fa"),))]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        found = readers.reads(spark, samples, "mf", 25)
        longest, total = found.selectExpr("max(length(seq))", "sum(length(seq) - 24)").first()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert longest < 2 * readers.PIECE and total == 7_000_000 - 24


def test_many_samples_are_one_scan(spark, tmp_path):
    names = []
    for i in range(40):
        folder = tmp_path / f"s #{i} %41"
        folder.mkdir()
        body = f"@r\nACGTACGTAC{'ACGT'[i % 4]}\n+\n{'I' * 11}\n"
        if i % 2:
            (folder / "x.fq").write_text(body)
        else:
            with gzip.open(folder / "x.fq.gz", "wt") as f:
                f.write(body)
        names.append(readers.Sample(f"s{i}", (str(folder),)))
    found = readers.reads(spark, names, "fq")
    assert {(r["sample"], r["seq"]) for r in found.collect()} == {(f"s{i}", "ACGTACGTAC" + "ACGT"[i % 4]) for i in range(40)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
