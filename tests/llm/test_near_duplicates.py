import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import lattice, simhash
from seqloom.llm.components import connected_components

from .conftest import words


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abC \n\té🙂", max_size=60))
def test_fingerprint_is_the_bitwise_majority(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def flipped(value, bits):
    for b in bits:
        value ^= 1 << b
    return value


@pytest.mark.parametrize("bucket", [2048, 17])
def test_links_connect_what_lies_within_three_bits(spark, bucket):
    rng = np.random.default_rng(7)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    fps = set(base)
    for b in base[:20]:
        for n in (1, 2, 3, 4):
            fps.add(flipped(b, rng.choice(64, n, replace=False).tolist()))
    crowd = base[0]  # a dense ball: one bucket holds many
    for _ in range(400):
        fps.add(flipped(crowd, rng.choice(20, rng.integers(1, 7), replace=False).tolist()))
    # links whose two halves both differ
    fps.add(flipped(base[30], [0, 1, 40])), fps.add(flipped(base[31], [33, 34, 2]))
    values = np.array(sorted(fps), dtype=np.uint64)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    got = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.links(df, bucket).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in got)
    true, found = Union(fps), Union(fps)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values ^ v) <= 3):
            true.join(int(v), int(values[j]))
    for a, b in got:
        found.join(a, b)
    assert {f: true.find(f) for f in fps} == {f: found.find(f) for f in fps}


def test_simhash_on_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    texts = odd_docs.select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    have = defaultdict(set)
    for d, t in texts:
        have[d].add(f"{plain_fingerprint(t):016x}")
    assert all(r["fingerprint"] in have[r["doc_id"]] for r in rows)
    component = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in rows}
    zero = "0" * 16
    assert [component[i, zero] for i in (1, 2, 3)] == [1, 1, 1]
    assert component[6, f"{plain_fingerprint(texts[[t[0] for t in texts].index(6)][1]):016x}"] == 5
    assert component[9, f"{plain_fingerprint('word'):016x}"] == 8
    assert component[None, f"{plain_fingerprint('no id here'):016x}"] is None
    assert simhash.near_duplicates(no_docs).count() == 0


def test_keep_one_keeps_one_row_a_component_and_all_columns(spark, odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    components = {r["component_fp"] for r in simhash.near_duplicates(odd_docs).collect()}
    assert len(rows) == len(components)
    assert sorted(r["text"] for r in rows if r["doc_id"] == 12) == sorted(["Ünïcödé 中文 🙂 text", "another text, same id"])
    assert [r["doc_id"] for r in rows if r["text"] == "word"] == [8]
    assert simhash.keep_one(no_docs).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 1), (2, 3), (5, 5), (7, 6), (10, 9), (9, 8), (8, 10), (None, 3)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 260)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 8, 9: 8, 10: 8} | {i: 100 for i in range(100, 160)} | {i: 200 for i in range(200, 261)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_e8_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 2, (300, 8))
    p = lattice.decode_e8(x)
    doubled = np.rint(2 * p).astype(int)
    assert ((doubled % 2 == doubled[:, :1] % 2).all(axis=1)).all() and (p.sum(axis=1) % 2 == 0).all()
    own = ((x - p) ** 2).sum(axis=1)
    for v in lattice.NEIGHBOURS:
        assert (own <= ((x - p - v) ** 2).sum(axis=1) + 1e-9).all()
    assert len(lattice.NEIGHBOURS) == 240 and np.allclose((lattice.NEIGHBOURS**2).sum(axis=1), 2)


def brute(vectors, cosine):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    union = Union(range(len(vectors)))
    for i, j in zip(*np.nonzero(near), strict=True):
        union.join(int(i), int(j))
    return near.sum(axis=1), [union.find(i) for i in range(len(vectors))]


BANDS = ((0.9, 0.91), (0.91, 0.92), (0.92, 0.95), (0.95, 1.0))
LEAST = (0.95, 0.95, 0.98, 0.99)


def planted(rng, x, low, high):
    """For each unit vector one whose cosine with it lies between the bounds."""
    cos = rng.uniform(low, high, (len(x), 1))
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    return cos * x + np.sqrt(1 - cos**2) * y / np.linalg.norm(y, axis=1, keepdims=True)


def met(a, b):
    """Whether rows of codes meet in some table."""
    own = a[:, :, 0] == b[:, :, 0]
    return (own | (a[:, :, 1:] == b[:, :, :1]).any(axis=2) | (b[:, :, 1:] == a[:, :, :1]).any(axis=2)).any(axis=1)


def test_recall_of_every_level_by_band_and_unrelated_pairs_meet_ever_less():
    rng = np.random.default_rng(7)
    x = lattice.unit_rows(rng.normal(size=(1000, 64)))
    shares = []
    for n in range(len(lattice.LEVELS)):
        hasher = lattice.Hasher(64, **lattice.level(n))
        codes = hasher.codes(x)
        for (low, high), least in zip(BANDS, LEAST, strict=True):
            assert met(codes, hasher.codes(planted(rng, x, low, high))).mean() >= least, (n, low)
        shares.append(np.mean([met(codes, np.roll(codes, k, axis=0)).mean() for k in range(1, 200)]))
    assert all(a > 2 * b for a, b in zip(shares[:-1], shares[1:], strict=True)) and shares[-1] < 3e-4


def test_lattice_recall_by_band_and_precision(spark):
    rng = np.random.default_rng(5)
    x = lattice.unit_rows(rng.normal(size=(1200, 64)))
    groups = [x, *(planted(rng, x[300 * i : 300 * (i + 1)], *band) for i, band in enumerate(BANDS))]
    v = np.concatenate(groups).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in lattice.near_duplicates(df).collect()}
    links, roots = brute(v.astype(float), 0.9)
    mine = np.array([got[i]["n_links"] for i in range(len(v))])
    assert (mine <= links).all()
    for i, least in enumerate(LEAST):
        own = slice(1200 + 300 * i, 1500 + 300 * i)
        assert mine[own].sum() >= least * links[own].sum() > 0, BANDS[i]
    assert all(got[i]["component_id"] >= roots[i] for i in range(len(v)))
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(len(v)))
    # cells cut into parts, and few rows at a time, change nothing
    cut = {r["vec_id"]: r for r in lattice.near_duplicates(df.repartition(4), cell=20, passing=30).collect()}
    assert cut == got


@pytest.mark.parametrize("number", [2, 4, 5])
def test_finer_levels_end_to_end_for_short_and_long_vectors(spark, number):
    rng = np.random.default_rng(15)
    found, there = np.zeros(len(BANDS)), np.zeros(len(BANDS))
    rows, links = [], []
    for dim in (8, 64, 768):  # vectors of different lengths do not link, so one table holds all
        x = lattice.unit_rows(rng.normal(size=(160, dim)))
        v = np.concatenate([x, *(planted(rng, x[40 * i : 40 * (i + 1)], *band) for i, band in enumerate(BANDS))]).astype(np.float32)
        rows += [(len(rows) + i, r.tolist()) for i, r in enumerate(v)]
        links.append(brute(v.astype(float), 0.9)[0])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in lattice.near_duplicates(df, **lattice.level(number)).collect()}
    for k, own in enumerate(links):
        mine = np.array([got[320 * k + i] for i in range(320)])
        assert (mine <= own).all()
        for i in range(len(BANDS)):
            at = slice(160 + 40 * i, 200 + 40 * i)
            found[i], there[i] = found[i] + mine[at].sum(), there[i] + own[at].sum()
    assert (found >= np.array(LEAST) * there - 2).all() and (there >= 120).all()
    if number == 4:
        cut = lattice.near_duplicates(df.repartition(3), cell=5, passing=8, **lattice.level(number))
        assert {r["vec_id"]: r["n_links"] for r in cut.collect()} == got


def test_a_level_is_chosen_by_what_meets_in_the_table(spark):
    rng = np.random.default_rng(16)
    x, common = lattice.unit_rows(rng.normal(size=(1500, 64))), lattice.unit_rows(rng.normal(size=(1, 64)))
    chosen = []
    for share in (0, 0.25, 0.5):  # mean cosine of the vectors
        v = (np.sqrt(1 - share) * x + np.sqrt(share) * common).astype("<f4")
        classes = spark.createDataFrame([(bytes(r.tobytes()),) for r in v], "vec binary")
        levels = [lattice.choose(classes, n, "<f4")["tables"] for n in (1000, 1_000_000, 100_000_000)]
        assert levels == sorted(levels) and levels[0] == lattice.LEVELS[0][2] < levels[-1]
        assert levels[1] == lattice.choose(classes.repartition(5), 1_000_000, "<f4")["tables"]
        chosen.append(levels)
    assert all(a <= b for few, more in zip(chosen, chosen[1:], strict=False) for a, b in zip(few, more, strict=True))
    assert chosen[0][1] < chosen[2][1]
    # meetings are those of a plain count
    hasher = lattice.Hasher(64, **lattice.level(1))
    codes = hasher.codes(x[:60])
    plain = sum(
        int(codes[i, t, 0] == codes[j, t, 0]) + int(codes[j, t, 0] in codes[i, t, 1:]) + int(codes[i, t, 0] in codes[j, t, 1:])
        for t in range(hasher.tables) for i in range(60) for j in range(i)
    )
    assert lattice.meetings(x[:60], hasher) == plain > 0


def test_codes_do_not_depend_on_the_rows_beside():
    x = lattice.unit_rows(np.random.default_rng(17).normal(size=(500, 96)))
    hasher = lattice.Hasher(96, **lattice.level(3))
    codes = hasher.codes(x)
    for at, n in ((0, 1), (7, 3), (63, 65), (100, 128), (499, 1)):
        assert np.array_equal(codes[at : at + n], hasher.codes(x[at : at + n]))


def test_lattice_equals_its_sql_where_links_are_close(spark):
    import duckdb

    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 16))
    v = np.concatenate([x, x[:20] + rng.normal(0, 0.01, (20, 16)), 2 * x[:5], x[:20] + rng.normal(0, 0.01, (20, 16))])
    rows = [(i, r.tolist()) for i, r in enumerate(v)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    want = con.sql(lattice.oracle()).fetchall()
    assert sorted(map(tuple, lattice.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect())) == sorted(want)


def test_lattice_counts_and_joins_a_crowd_of_different_vectors(spark):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(2, 32))
    v = np.concatenate([c + rng.normal(0, 0.02, (400, 32)) for c in centre])  # doubles: no float32 holds them
    v[5] = v[6]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    links, roots = brute(v, 0.9)
    for options in ({}, {"cell": 64, "passing": 100}):
        got = {r["vec_id"]: r for r in lattice.near_duplicates(df, **options).collect()}
        assert [got[i]["n_links"] for i in range(800)] == links.tolist()
        assert [got[i]["component_id"] for i in range(800)] == roots


def test_lattice_tells_doubles_apart_and_takes_any_magnitude(spark):
    rows = [(1, [1e300, 1e300]), (2, [1e-300, 1.1e-300]), (3, [1.0, -1.0]), (4, [1.0, 1.0 + 1e-15])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in lattice.near_duplicates(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (0, 3), 4: (2, 1)}


def test_lattice_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, inf]), (6, [1.0, None]), (7, [1.0, 0.0]), (8, [1.0, 0.01]), (9, [1.0, 0.0, 0.0]), (9, [1.0, 0.0, 0.0]), (None, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, rep string")
    got = [tuple(r) for r in lattice.near_duplicates(df).collect()]
    assert sorted(g for g in got if g[0] and g[0] < 7) == [(i, 0, i, True) for i in range(1, 7)]
    assert (7, 1, 7, True) in got and (8, 1, 7, False) in got and got.count((9, 1, 9, True)) == 2 and (None, 0, None, True) in got
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_words_helper_is_stable():
    assert words(3, 1) == words(3, 1)
