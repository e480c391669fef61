import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.functions import kmers
from seqloom.operators import matrix as mx

EXAMPLE = {
    "sample1": ["ACGTACGTGGGTTAAAACCCAGGGGT", "ATCTGTTTATCTGTTTGTGTGTTTTA"],
    "sample2": ["ACGTACGTGGGTTAAAACCCAGGGGT", "ATCTGTTTATCTGTTTGTGTGTTTTA"],
    "sample3": ["ACGTAGGTGGGTTAATTCCCAGGGGT", "ACGTACGTGGGTTAAAACCCAGGGGT"],
}
GOLDEN = {
    "AAAACACACAAACAGATAAACAGAT": [1, 1, 0],
    "ACCCCTGGGAATTAACCCACCTACG": [0, 0, 1],
    "ACCCCTGGGTTTTAACCCACGTACG": [1, 1, 1],
    "ACGTACGTGGGTTAAAACCCAGGGG": [1, 1, 1],
    "ACGTAGGTGGGTTAATTCCCAGGGG": [0, 0, 1],
    "TAAAACACACAAACAGATAAACAGA": [1, 1, 0],
}


def frame(spark, data):
    return spark.createDataFrame([(s, q) for s, reads in data.items() for q in reads], "sample string, seq string")


def built(spark, data, k, canonical=True, **cut):
    return mx.merge(mx.extract(frame(spark, data), k, canonical), list(data), **cut)


def as_dict(matrix):
    return {r["kmer"]: r["counts"] for r in matrix.collect()}


@pytest.mark.parametrize(("ratio", "least"), [(0.0, 0), (0.5, 2), (1.0, 3)])
def test_worked_example(spark, ratio, least):
    got = as_dict(mx.filter_rows(built(spark, EXAMPLE, 25), ratio=ratio))
    assert got == {k: v for k, v in GOLDEN.items() if sum(v) >= least}


def reverse_complement(w):
    return w[::-1].translate(str.maketrans("ACGT", "TGCA"))


def plain_counts(reads, k, canonical):
    out = Counter()
    for q in reads:
        for i in range(len(q or "") - k + 1):
            w = q[i : i + k]
            if set(w) <= set("ACGT"):
                out[min(w, reverse_complement(w)) if canonical else w] += 1
    return out


@pytest.mark.parametrize("canonical", [True, False])
def test_counts_equal_brute_force(spark, canonical):
    r = random.Random(3)
    reads = ["".join(r.choices("ACGTN", [9, 9, 9, 9, 1], k=n)) for n in (0, 3, 4, 50, 3000, 5000)] + [None, "ACGT", "NNNN", "acgt"]
    got = {k: v[0] for k, v in as_dict(built(spark, {"s": reads}, 4, canonical)).items()}
    assert got == plain_counts(reads, 4, canonical)


@settings(max_examples=50, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=12))
def test_canonical_of_reverse_complement_is_the_same(w):
    assert min(w, reverse_complement(w)) == min(reverse_complement(w), w)


def test_canonical_column(spark):
    row = spark.createDataFrame([("ACGT",), ("TTTA",)], "w string").select(kmers.canonical(F.col("w"))).collect()
    assert [r[0] for r in row] == ["ACGT", "TAAA"]


def test_cutoffs_and_saturation(spark):
    data = {"a": ["AAAA"] * 3 + ["CCCC"], "b": ["AAAA"], "c": ["GAGA"] * 9}
    assert as_dict(built(spark, data, 4, ci=2, cs=5)) == {"AAAA": [3, 0, 0], "GAGA": [0, 0, 5]}
    assert as_dict(built(spark, data, 4, cx=2)) == {"AAAA": [0, 1, 0], "CCCC": [1, 0, 0]}


def test_many_samples_take_the_long_way(spark):
    data = {f"s{i}": ["ACGTT"] * (i % 3) for i in range(70)}
    rows = spark.createDataFrame([(s, q) for s, v in data.items() for q in v], "sample string, seq string")
    got = as_dict(mx.merge(mx.extract(rows, 5), list(data)))
    assert got == {"AACGT": [i % 3 for i in range(70)]}


def test_threshold_without_ratio_keeps_all(spark):
    m = built(spark, EXAMPLE, 25)
    assert mx.filter_rows(m, threshold=2, ratio=0.0).count() == 6 and mx.filter_rows(m, threshold=2, ratio=0.1).count() == 0


def test_sets_and_totals(spark):
    m = built(spark, EXAMPLE, 25)
    wanted = mx.kmer_set(spark.createDataFrame([("ACGTACGTGGGTTAAAACCCAGGGG",)], "seq string"), 25)
    assert list(as_dict(mx.filter_rows(m, keep=wanted))) == ["ACGTACGTGGGTTAAAACCCAGGGG"]
    assert mx.filter_rows(m, drop=wanted).count() == 5
    assert tuple(mx.totals(m, list(EXAMPLE)).first()) == (4, 4, 4)
    assert tuple(mx.totals(m.limit(0), list(EXAMPLE)).first()) == (0, 0, 0)


def test_one_shuffle_and_partial_counts(spark):
    plan = built(spark, EXAMPLE, 25)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_count" in plan


def test_streaming_counts(spark, tmp_path):
    from seqloom.streaming import counts

    folder = f"{tmp_path}/in"
    frame(spark, EXAMPLE).write.parquet(folder)
    frame(spark, {"sample1": EXAMPLE["sample1"]}).write.mode("append").parquet(folder)
    running = counts.running_counts(counts.read_stream(spark, folder, 1), 25)
    query = counts.start(running, f"{tmp_path}/out", f"{tmp_path}/ck")
    query.processAllAvailable()
    query.stop()
    got = {(r["sample"], r["kmer"]): r["n"] for r in counts.current_counts(spark, f"{tmp_path}/out").collect()}
    assert got["sample1", "AAAACACACAAACAGATAAACAGAT"] == 2 and got["sample3", "ACCCCTGGGAATTAACCCACCTACG"] == 1


def test_late_reads_are_left_out_of_their_window(spark, tmp_path):
    from seqloom.streaming import counts

    folder = f"{tmp_path}/in"
    schema = "sample string, seq string, t timestamp"
    spark.createDataFrame([], schema).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    query = counts.start_windows(counts.windowed_counts(stream, "t", 4, "1 hour", "10 minutes"), f"{tmp_path}/out", f"{tmp_path}/ck")
    # in time; far ahead, which moves the watermark to 02:50; late for the first window but not for the second; far ahead again
    for batch in ([("a", "AAAAC", "00:05:00"), ("b", "AAAA", "00:50:00")], [("a", "CCCC", "03:00:00")], [("a", "AAAA", "00:06:00"), ("b", "GAGA", "02:55:00")], [("a", "TTTT", "09:00:00")]):
        rows = spark.createDataFrame([(s, q, f"2024-01-01 {t}") for s, q, t in batch], "sample string, seq string, t string")
        rows.withColumn("t", F.col("t").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)
        query.processAllAvailable()
    query.stop()
    got = {(r["window"]["start"].hour, r["sample"], r["kmer"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(0, "a", "AAAA"): 1, (0, "a", "AAAC"): 1, (0, "b", "AAAA"): 1, (2, "b", "GAGA"): 1, (3, "a", "CCCC"): 1}
