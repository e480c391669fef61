import base64
import gzip
import hashlib
import io
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqloom.llm import common, mixing, sharding, warc


def test_mixing_equals_its_sql_and_the_law(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.plan(docs, bins=64).select("doc_id", "size", "source_size", "target", "taken").toPandas()
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = con.sql(mixing.oracle()).df()
    assert rows.sort_values("doc_id").reset_index(drop=True).equals(want[rows.columns].sort_values("doc_id").reset_index(drop=True).astype(rows.dtypes))
    assert (rows.taken <= 2 * rows["size"]).all()


def test_targets_by_pouring(spark):
    sizes = {"a": 10, "b": 500, "c": 30, None: 400}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    weight = dict(zip(["a", "b", "c", None], [5, 2, 1, 5], strict=True))
    left, want, open_ = 1.5 * 940, {}, set(sizes)
    while True:  # pour the excess over what is not capped, again and again
        unit = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if unit * weight[s] > 2 * sizes[s]}
        if not above:
            want |= {s: unit * weight[s] for s in open_}
            break
        want |= {s: 2.0 * sizes[s] for s in above}
        left -= sum(2 * sizes[s] for s in above)
        open_ -= above
    assert got == pytest.approx(want)


def test_mixing_of_odd_rows(spark, odd_docs, no_docs):
    rows = mixing.plan(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert mixing.plan(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_pareto_order_prefers_large_documents_and_comes_near(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(n)), "s") for i, n in enumerate(rng.integers(1, 60, 3000))] + [(9000 + i, "w " * 20, "t") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan(docs, share=0.5, bins=128).toPandas()
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 60
    s = got[got.source == "s"]
    if s.copies.between(0, 1).all() and s.copies.nunique() == 2:
        assert s[s.copies == 1]["size"].mean() > s[s.copies == 0]["size"].mean()


def mixed_as_sql(docs, spark, **options):
    """Counts of (doc_id, size, taken) by the operator and by its SQL."""
    got = mixing.plan(docs, **options)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())  # pandas would make ids with nulls doubles
    want = con.sql(mixing.oracle()).df()
    listed = lambda t: Counter((None if pd.isna(a) else int(a), int(b), int(c)) for a, b, c in zip(t.doc_id, t["size"], t.taken, strict=True))
    rows = got.toPandas()
    assert listed(rows) == listed(want)
    return rows


@pytest.mark.parametrize("repeated", ["same row", "same id", "null id"])
def test_mixing_comes_near_where_ids_repeat(spark, repeated):
    """A source half of which shares an id; the target is met to within one document."""
    hot = {"same row": (7, "w " * 30), "same id": (7, None), "null id": (None, None)}[repeated]
    rows = [(hot[0], hot[1] or "w " * 30 + str(i), "s") if i % 2 else (1000 + i, "v " * 30 + str(i), "s") for i in range(1000)]
    rows += [(5000 + i, "u " * 30, "t") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixed_as_sql(docs, spark, bins=64)
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 31
    mixed = Counter(map(tuple, mixing.mix(docs, bins=64).collect()))
    assert sum(len(t.split()) * n for (_, t, _), n in mixed.items()) == got.taken.sum()
    assert all(n <= 2 * Counter(rows)[k] for k, n in mixed.items())


def test_huge_documents_are_certain(spark):
    rows = [(i, "w " * n, "z") for i, n in enumerate([9000, 5000, 700] + [10] * 900)] + [(5000 + i, "u " * 30, "t") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixed_as_sql(docs, spark, bins=32)
    z = got[got.source == "z"]
    # 1.5 times the source is due: each document once, and of the rest the largest for certain
    assert z.copies.min() == 1 and z[z["size"] == 9000].copies.tolist() == [2]
    assert abs(z.taken.sum() - z.target.iloc[0]) <= 5000


def check_shards(written, count, shards):
    per = Counter(r["shard"] for r in written)
    assert sum(per.values()) == count and max(per.values()) - min(per.get(s, 0) for s in range(shards)) <= 1
    for s in per:
        assert sorted(r["slot"] for r in written if r["shard"] == s) == list(range(per[s]))


def test_shards(spark, odd_docs, no_docs):
    a = sharding.write_shards(odd_docs, 7)
    rows = a.collect()
    check_shards(rows, odd_docs.count(), 7)
    assert sorted(map(repr, (r["rec"] for r in rows))) == sorted(map(repr, odd_docs.collect()))
    again = {(repr(r["rec"]), r["shard"], r["slot"]) for r in sharding.write_shards(odd_docs.repartition(5), 7).collect()}
    assert again == {(repr(r["rec"]), r["shard"], r["slot"]) for r in rows}
    assert sharding.write_shards(no_docs, 7).count() == 0
    assert {c for c, _ in sharding.digest(a).dtypes} >= {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}


def test_many_equal_rows_are_split(spark):
    docs = spark.range(900).select(F.when(F.col("id") < 500, 1).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 500, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"))
    rows = sharding.write_shards(docs, 4, alike=50).collect()
    check_shards(rows, 900, 4)
    assert sum(r["rec"]["text"] == "same" for r in rows) == 500
    spread, _ = sharding.scattered(docs, 13, alike=50)
    assert spread.where("rec.text = 'same'").select("bucket").distinct().count() > 3


def test_rows_that_differ_in_another_column_are_scattered(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"), F.concat(F.lit("u"), "id").alias("url"))
    spread, buckets = sharding.scattered(docs, 13, alike=50)
    assert spread.select("bucket").distinct().count() == buckets and spread.count() == 3000
    rows = sharding.write_shards(docs, 4, alike=50).collect()
    check_shards(rows, 3000, 4)
    assert len({r["rec"]["url"] for r in rows}) == 3000


def plain_shards(docs, shards, seed=13):
    """Both passes in plain Python, for a table without crowds: (doc_id, shard, slot)."""
    spread, _ = sharding.scattered(docs, seed)
    buckets = {}
    for r in spread.collect():
        buckets.setdefault(r["bucket"], []).append((r["h"], r["h2"], r["rec"]["doc_id"]))
    sequence = []
    for b in sorted(buckets):
        rows, rng = sorted(buckets[b], key=lambda x: x[:2]), np.random.default_rng([seed, b])
        draws = rng.integers(0, np.arange(len(rows), 1, -1)).tolist() if len(rows) > 1 else []
        for i, j in zip(range(len(rows) - 1, 0, -1), draws, strict=True):
            rows[i], rows[j] = rows[j], rows[i]
        sequence += [x[2] for x in rows]
    base, longer = divmod(len(sequence), shards)
    out, at = [], 0
    for s in range(shards):
        n = base + (s < longer)
        out += [(i, s, k) for k, i in enumerate(sequence[at : at + n])]
        at += n
    return out


def test_shards_equal_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    written = sharding.write_shards(docs, 40)
    got = sorted((r["doc_id"], r["shard"], r["slot"]) for r in written.select("rec.doc_id", "shard", "slot").collect())
    assert got == sorted(plain_shards(docs, 40))


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, np.random.default_rng(s))) for s in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 850


def pages(spark):
    rows = [(5, "u5", "same"), (3, "u3", "same"), (9, None, "same"), (1, "u1", None), (2, "u2", ""), (4, "a\nb", "é🙂" * 1000), (6, "u6", "x" * 200_000), (6, "u6", "x" * 200_000), (None, "n", "same"), (None, "n", "alone")]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")


def test_warc_round_trip(spark):
    got = sorted(map(tuple, warc.round_trip(pages(spark)).collect()), key=repr)
    want = []
    first = {"same": 3, "": 1, "é🙂" * 1000: 4, "x" * 200_000: 6, "alone": None}
    for r in pages(spark).collect():
        payload = r["html"] or ""
        f = first[payload]
        revisit = f is not None and f != r["page_id"]
        digest = base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()
        want.append((r["page_id"], len(payload.encode()), digest, "revisit" if revisit else "response", f if revisit else None))
    assert got == sorted(want, key=repr)
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


@pytest.mark.parametrize("range_bytes", [1 << 30, 5000, 333])
def test_every_split_gives_every_record_once(spark, range_bytes):
    path = common.scratch_path(spark, "warc-test")
    source = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("page_id < 60")
    warc.write(source.repartition(2), path)
    ids = [r["page_id"] for r in warc.read(spark, path, range_bytes).select("page_id").collect()]
    assert sorted(ids) == list(range(60))


def test_archives_are_plain_concatenated_gzip(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write(pages(spark).coalesce(1), path)
    files = list((tmp_path / "w").glob("part-*"))
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files if f.stat().st_size)
    assert text.count(b"WARC/1.1\r\n") == 10 and text.endswith(b"\r\n\r\n")


def test_archives_in_folders_with_odd_names(spark, tmp_path):
    path = f"file://{tmp_path}/a#b ?c%20d/w"
    warc.write(pages(spark), path)
    assert warc.read(spark, path).count() == 10


def test_reader_skips_false_magic_and_damage():
    records = [warc.record(i, "u", b"p" * (i * 700), None) for i in range(6)]
    members = [warc.member(r) + b"\x00" for r in records]
    junk = warc.MAGIC + b"\x00" * 20
    data = members[0] + junk + members[1] + members[2][:-9] + members[3] + gzip.compress(b"no record") + members[4] + members[5]
    got = [r for _, r in warc.records_of(io.BytesIO(data), 0, len(data))]
    assert got == [records[i] for i in (0, 1, 3, 4, 5)]
    for cut in range(1, len(data), 97):
        parts = [o for s, e in ((0, cut), (cut, len(data))) for o, _ in warc.records_of(io.BytesIO(data), s, e)]
        assert len(parts) == len(set(parts)) == 5


def test_long_records_end_with_a_zero_byte():
    big = warc.member(b"a" * (17 << 20)) + b"\x00"
    assert gzip.decompress(big) == b"a" * (17 << 20)


def test_first_ranks_are_running_sums(spark):
    rng = np.random.default_rng(4)
    n = {int(b): int(c) for b, c in zip(rng.choice(5000, 700, replace=False), rng.integers(1, 50, 700), strict=True)}
    got = dict(map(tuple, sharding.first_ranks(spark.createDataFrame(list(n.items()), "bucket int, n long"), group=64).collect()))
    assert got == {b: sum(c for o, c in n.items() if o < b) for b in n}
