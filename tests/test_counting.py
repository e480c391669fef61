"""Packed k-mers, super-k-mers and early filters, against text and brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.functions import packed
from seqloom.operators import counting
from seqloom.operators import matrix as mx

from .test_kmers import EXAMPLE, GOLDEN, as_dict, frame, plain_counts, reverse_complement


def random_reads(seed, many=30):
    r = random.Random(seed)
    reads = ["".join(r.choices("ACGTN", [9, 9, 9, 9, 0.3], k=r.choice([0, 5, 40, 300, 900]))) for _ in range(many)]
    return [*reads, *reads[:7], None, "", "N" * 40, "A" * 700, "acgt" * 20, "".join(r.choices("ACGT", k=400)) * 2]


def stretch(text, k):
    data = np.frombuffer(text.encode(), np.uint8)
    return next(packed.stretches(np.array([0, len(data)]), data, k))


@settings(max_examples=80, deadline=None)
@given(st.text("ACGTN", min_size=1, max_size=150), st.sampled_from([1, 2, 5, 6, 25, 31, 32, 62, 63, 70]), st.booleans())
def test_windows_are_those_of_the_text(text, k, canonical):
    if len(text) < k:
        return
    s = stretch(text, k)
    ok = np.flatnonzero(packed.valid(s, k))
    want = [text[i : i + k] for i in range(len(text) - k + 1) if "N" not in text[i : i + k]]
    want = [min(w, reverse_complement(w)) for w in want] if canonical else want
    got = [w[ok].tolist() for w in packed.windows(s.codes, k, canonical)]
    assert got == (packed.encode(want, k) if want else [[] for _ in packed.columns(k)])


@settings(max_examples=60, deadline=None)
@given(st.text("ACGT", min_size=40, max_size=120), st.integers(13, 40))
def test_minimizers_do_not_depend_on_the_strand(text, k):
    a = packed.minimizers(stretch(text, k).codes, k, 11)
    b = packed.minimizers(stretch(reverse_complement(text), k).codes, k, 11)
    assert (a == b[::-1]).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ACGT", min_size=1, max_size=30), min_size=1, max_size=20))
def test_runs_are_packed_reversibly(texts):
    codes = np.concatenate([stretch(t, 1).codes for t in texts])
    bases = np.array([len(t) for t in texts])
    data, offsets = packed.pack_runs(codes, np.cumsum(bases) - bases, bases)
    assert (packed.unpack_runs(data, offsets, bases) == codes).all() and len(data) == sum((len(t) + 3) // 4 for t in texts)


def plain_matrix(data, k, canonical):
    per = {s: plain_counts(reads, k, canonical) for s, reads in data.items()}
    return {w: [per[s][w] for s in data] for w in set().union(*per.values())}


@pytest.mark.parametrize("k", [4, 6, 12, 13, 25, 31, 32, 63, 256])
@pytest.mark.parametrize("canonical", [True, False])
def test_matrix_of_reads_equals_brute_force(spark, monkeypatch, k, canonical):
    monkeypatch.setattr(packed, "PIECE", 97)
    monkeypatch.setattr(packed, "SLICE", 500)
    data = {"a": random_reads(k), "b": random_reads(k, 40), "c": []}
    rows = frame(spark, data | {"unlisted": random_reads(1)}).repartition(3)
    assert as_dict(mx.of_reads(rows, list(data), k, canonical)) == plain_matrix(data, k, canonical)


def test_worked_example_by_super_kmers(spark):
    assert as_dict(mx.of_reads(frame(spark, EXAMPLE), list(EXAMPLE), 25)) == GOLDEN


@pytest.mark.parametrize("hot", [1, 200])
def test_hot_minimizers_are_split(spark, monkeypatch, hot):
    monkeypatch.setattr(counting, "CHUNK", 64)
    data = {"a": random_reads(2), "b": ["A" * 5000, "AC" * 900, *random_reads(3)]}
    rows = frame(spark, data).repartition(2)
    assert as_dict(mx.of_reads(rows, ["a", "b"], 21, hot=hot)) == plain_matrix(data, 21, True)
    whole = counting.super_kmers(rows, ["a", "b"], 21)
    split = counting.super_kmers(rows, ["a", "b"], 21, hot=hot)
    load = lambda df: max(r["n"] for r in df.selectExpr("bin", "(bases - 20) AS n").groupBy("bin").sum("n").withColumnRenamed("sum(n)", "n").collect())
    assert load(whole) > 4500 and load(split) <= max(hot, 10)


def test_a_chunk_ends_between_bins_only(spark, monkeypatch):
    monkeypatch.setattr(counting, "CHUNK", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        data = {"a": random_reads(8), "b": random_reads(9)}
        assert as_dict(mx.of_reads(frame(spark, data), ["a", "b"], 17)) == plain_matrix(data, 17, True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("k", [5, 25])
def test_cutoffs_of_both_ways(spark, k):
    data = {"a": ["ACGTT" * 9] * 3, "b": ["ACGTT" * 6] * 40}
    want = {w: [0 if c < 2 or c > 150 else min(c, 60) for c in v] for w, v in plain_matrix(data, k, True).items()}
    got = as_dict(mx.of_reads(frame(spark, data), ["a", "b"], k, ci=2, cx=150, cs=60))
    assert got == {w: v for w, v in want.items() if any(v)}


def test_many_samples(spark):
    data = {f"s{i}": ["ACGTACGTTGCAACGTAAAC"[i % 7 :]] for i in range(70)}
    for k in (6, 13):
        assert as_dict(mx.of_reads(frame(spark, data), list(data), k)) == plain_matrix(data, k, True)


def test_counts_by_sample(spark):
    data = {"a": random_reads(4), "b": random_reads(5)}
    for k in (7, 22):
        got = {(r["sample"], r["kmer"]): r["n"] for r in mx.count_reads(frame(spark, data), ["a", "b"], k).collect()}
        assert got == {(s, w): n for s, reads in data.items() for w, n in plain_counts(reads, k, True).items()}


def shuffle_metric(df, name):
    """A metric of all exchanges of a query that has run."""
    total, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(plan.plan())
        else:
            if kind == "ShuffleExchangeExec":
                total += plan.metrics().apply(name).value()
            children = plan.children()
            plans += [children.apply(i) for i in range(children.size())]
    return total


def written(df, name="shuffleRecordsWritten"):
    df.collect()
    return shuffle_metric(df, name)


@pytest.mark.parametrize("k", [9, 25])
def test_filters_drop_occurrences_before_the_exchange(spark, monkeypatch, k):
    r = random.Random(k)
    reads = ["".join(r.choices("ACGT", k=500)) for _ in range(40)]
    data, wanted = {"a": reads[:20], "b": reads[20:]}, [reads[3][:60], reads[30][100:140]]
    rows, names = frame(spark, data), ["a", "b"]
    keep = mx.packed_set(spark.createDataFrame([(w,) for w in wanted], "seq string"), k)
    listed = set(plain_counts(wanted, k, True))
    want = {w: v for w, v in plain_matrix(data, k, True).items() if w in listed}
    filtered = mx.of_reads(rows, names, k, keep=keep)
    assert as_dict(filtered) == want
    # rows into all exchanges: those of the reads' windows that are in the set, instead of all
    everything = written(mx.of_reads(rows, names, k))
    assert everything > 1000 and written(filtered) < 0.1 * everything
    monkeypatch.setattr(counting.bloom_filter, "__defaults__", (1,))  # a set too large for a filter is joined all the same
    assert as_dict(mx.of_reads(rows, names, k, keep=keep)) == want
    dropped = as_dict(mx.of_reads(rows, names, k, drop=keep))
    assert dropped == {w: v for w, v in plain_matrix(data, k, True).items() if w not in listed}


def test_a_bloom_filter_loses_no_key_and_few_others_pass(spark):
    keys = mx.packed_set(spark.createDataFrame([("".join(random.Random(1).choices("ACGT", k=4000)),)], "seq string"), 33)
    bloom = counting.bloom_filter(keys, 33)
    own = [np.array(c) for c in zip(*keys.collect(), strict=True)]
    assert bloom.might_hold(packed.mixed(own)).all()
    other = np.random.default_rng(1).integers(0, 1 << 62, 20_000)
    assert bloom.might_hold(packed.mixed([other, other % 64])).mean() < 0.05
    assert not counting.bloom_filter(keys.where("false"), 33).might_hold(packed.mixed([other, other])).any()


def test_super_kmers_shuffle_a_fifth_of_the_windows(spark):
    r = random.Random(6)
    rows = frame(spark, {"a": ["".join(r.choices("ACGT", k=3000)) for _ in range(60)]})
    as_text = written(mx.merge(mx.extract(rows, 25), ["a"]), "shuffleBytesWritten")
    as_runs = written(mx.of_reads(rows, ["a"], 25), "shuffleBytesWritten")
    assert 0 < as_runs < as_text / 5


def test_counter_of_plain_counts():
    assert plain_counts(["ACGTN"], 4, True) == Counter({"ACGT": 1})


@pytest.mark.parametrize("canonical", [True, False])
def test_a_task_counts_short_kmers_in_one_table(canonical):
    """However many batches and slices there are, a k-mer of a sample leaves the task once, and little memory is taken."""
    import tracemalloc

    import pyarrow as pa

    r = random.Random(3)
    names, reads = ["a", "b", "c"], ["".join(r.choices("ACGTN", [9, 9, 9, 9, 0.3], k=2_000)) for _ in range(30)]
    batches = [pa.RecordBatch.from_arrays([pa.array([names[i % 2], "other", "c"]), pa.array([seq, seq, None])], ["sample", "seq"]) for i, seq in enumerate(reads)]
    got = [row for b in counting._counts(6, canonical, {s: i for i, s in enumerate(names)}, None)(iter(batches)) for row in zip(*b.to_pydict().values(), strict=True)]
    want = {i: plain_counts(reads[i::2], 6, canonical) for i in range(2)}
    kmers = {(i, w): n for i, per in want.items() for w, n in per.items()}
    codes = dict(zip(kmers, packed.encode([w for _, w in kmers], 6)[0], strict=True))
    assert sorted(got) == sorted((codes[x], x[0], n) for x, n in kmers.items())
    long = [pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array(["ACGTTGCA" * 500_000])], ["sample", "seq"])]
    tracemalloc.start()
    assert sum(n for b in counting._counts(6, canonical, {"a": 0}, None)(iter(long)) for n in b.column(2).to_pylist()) == 4_000_000 - 5
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ACGT", min_size=0, max_size=9), st.integers(1, 12)), min_size=1, max_size=6), st.sampled_from([13, 25, 29, 30, 31, 32, 62, 63, 70]), st.booleans(), st.randoms())
def test_windows_of_packed_runs_are_those_of_the_text(tails, k, canonical, r):
    texts = ["".join(r.choices("ACGT", k=k - 1 + n)) + tail for tail, n in tails]  # windows behind the first n are not asked for
    n = np.array([n for _, n in tails])
    codes = np.concatenate([stretch(t, 1).codes for t in texts])
    lengths = np.array([len(t) for t in texts])
    data, offsets = packed.pack_runs(codes, np.cumsum(lengths) - lengths, n + k - 1)
    want = [t[i : i + k] for t, m in zip(texts, n, strict=True) for i in range(m)]
    want = [min(w, reverse_complement(w)) for w in want] if canonical else want
    assert [w.tolist() for w in packed.run_windows(data, offsets[:-1], n, k, canonical)] == packed.encode(want, k)


@pytest.mark.parametrize("k", [6, 25])
def test_thresholds_are_held_where_kmers_are_counted(spark, k):
    data = {"a": random_reads(1), "b": random_reads(1)[:25] + random_reads(2), "c": random_reads(2)[10:], "d": []}
    rows, names = frame(spark, data).repartition(2), list(data)
    whole = as_dict(mx.of_reads(rows, names, k, cs=5))
    for threshold, ratio in [(1, 0.5), (1, 0.75), (2, 0.5), (5, 0.25), (6, 0.25), (1, 1.0), (0, 1.0), (3, 0.0)]:
        want = {w: v for w, v in whole.items() if ratio == 0 or sum(c >= threshold for c in v) / 4 >= ratio}
        assert as_dict(mx.of_reads(rows, names, k, cs=5, threshold=threshold, ratio=ratio)) == want


def test_kmers_below_a_threshold_leave_no_task_and_runs_share_rows(spark):
    r = random.Random(11)
    rows = spark.createDataFrame([("a", "".join(r.choices("ACGT", k=1_500_000)))], "sample string, seq string").coalesce(1)
    matrix = mx.of_reads(rows, ["a", "b"], 25, ratio=1.0)
    assert matrix.count() == 0
    assert 0 < written(matrix) <= counting.BUCKETS  # there are about 190,000 runs
    plans, counted = [matrix._jdf.queryExecution().executedPlan()], []
    while plans:
        plan = plans.pop()
        kind = plan.getClass().getSimpleName()
        children = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        plans += children
        if kind == "MapInArrowExec":
            counted.append(plan.metrics().apply("pythonNumRowsReceived").value())
    assert sorted(counted)[0] == 0 and len(counted) == 2


@pytest.mark.parametrize("k", [5, 25])
def test_texts_are_read_by_an_alphabet(spark, k):
    letters = packed.alphabet("ABCDabcd", "ACGTACGT", packed.SKIP)
    r = random.Random(k)
    texts = ["".join(r.choices("abcdABCD é\n\0漢.", k=r.choice([0, 3, 60, 400]))) for _ in range(40)] + [None, "", "éé", "x" * 90, "abcd" * 20]
    plain = [None if t is None else "".join("ACGT"["abcd".index(c.lower())] for c in t if c in "abcdABCD") for t in texts]
    rows = spark.createDataFrame([("ab"[i % 2], t) for i, t in enumerate(texts)] + [("other", "abcd" * 30)], "sample string, seq string").repartition(3)
    want = plain_matrix({"a": [t for t in plain[0::2] if t], "b": [t for t in plain[1::2] if t]}, k, True)
    assert as_dict(mx.of_reads(rows, ["a", "b"], k, codes=letters)) == want and want


@pytest.mark.parametrize("k", [13, 25, 40])
@pytest.mark.parametrize("split", [0, 2, 1])
def test_gathered_runs_give_all_counts_in_small_portions(monkeypatch, k, split):
    """Tasks that gather little at once, rows of few runs, and no, half or all minimizers split."""
    from types import SimpleNamespace

    import pyarrow as pa

    for name, value in (("GATHERED", 1024), ("BASES", 300), ("SPLIT", 100), ("ROW", 3), ("CHUNK", 64)):
        monkeypatch.setattr(counting, name, value)
    data = {"a": [x or "" for x in random_reads(5)], "b": [x or "" for x in random_reads(6)] * 2}
    place, none = {"a": 0, "b": 1}, packed.DNA
    batches = [pa.RecordBatch.from_arrays([pa.array([s] * 5), pa.array(reads[i : i + 5], pa.string())], ["sample", "seq"]) for s, reads in data.items() for i in range(0, len(reads) - 4, 5)]
    data = {s: reads[: len(reads) // 5 * 5] for s, reads in data.items()}
    bins = np.unique(np.concatenate([r.bins for r in counting._super(k, True, place, None, none, None)(iter(batches))]))
    heavy = SimpleNamespace(value=bins[::split]) if split else None
    rows = list(counting._gathered(k, 2, counting._super(k, True, place, None, none, heavy))(iter(batches)))
    parts = pa.Table.from_batches(rows).sort_by("bin").combine_chunks().to_batches(max_chunksize=7)
    names = packed.columns(k)
    got = {}
    for batch in counting._dense(k, True, 2, 1, 4_000_000_000, 65_535, 1, 0.0)(iter(parts)):
        for *words, counts in zip(*(batch.column(c).to_pylist() for c in [*names, "counts"]), strict=True):
            assert tuple(words) not in got
            got[tuple(words)] = counts
    want = plain_matrix(data, k, True)
    codes = zip(*packed.encode(list(want), k), strict=True)
    assert got == dict(zip(codes, want.values(), strict=True))


def test_minimizers_of_many_windows_are_found_over_many_tasks(spark):
    data = {"a": ["A" * 900, *random_reads(2)], "b": ["AC" * 900, *random_reads(3)]}
    rows = frame(spark, data)
    total = Counter()
    for reads in data.values():
        for text in reads:
            if text and len(text) >= 21:
                whole = stretch(text, 21)
                total.update(packed.minimizers(whole.codes, 21, 11)[packed.valid(whole, 21)].tolist())
    for parts in (1, 13):
        heavy = counting.heavy_minimizers(rows.repartition(parts), ["a", "b"], 21, hot=200).value.tolist()
        assert {b for b, n in total.items() if n > 200} <= set(heavy) <= {b for b, n in total.items() if n > 100} and heavy == sorted(heavy)
    assert counting.heavy_minimizers(rows, ["a", "b"], 21) is None
