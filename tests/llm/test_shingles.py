"""Near-duplicates by Jaccard similarity, against brute force."""

import random

import pytest

import corpus_pipeline
from seqloom.llm import shingles, simhash

from .conftest import DOCS, doc
from .test_near_duplicates import Union


def plain_set(text, width=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def edited_texts():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(25):
        base = r.choices(vocabulary, k=r.randint(40, 300))
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 5, 9):
            near = list(base)
            for at in r.sample(range(len(near)), edits):
                near[at] = r.choice(vocabulary)
            texts.append(" ".join(near))
    crowd = r.choices(vocabulary, k=200)
    for _ in range(80):
        near = list(crowd)
        for at in r.sample(range(200), 3):
            near[at] = r.choice(vocabulary)
        texts.append(" ".join(near))
    return [*texts, "", None, "word", "Word", "two words", texts[0].upper()]


def brute(texts, similarity=0.8):
    sets, union = [plain_set(t) for t in texts], Union(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) / len(a | b) >= similarity:
                union.join(i, j)
    return [union.find(i) for i in range(len(texts))]


@pytest.mark.parametrize("bucket", [2048, 9])
def test_similar_finds_every_pair_and_no_other(spark, bucket):
    texts = edited_texts()
    df = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(df, bucket=bucket).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_pipeline_stage_drops_copies_with_a_few_edits(spark):
    texts = edited_texts()
    df = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOCS)
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute(texts)))


def test_stage_on_odd_rows(spark, odd_docs, no_docs):
    rows = corpus_pipeline.near_duplicates(spark, odd_docs, "").collect()
    classes = simhash.similar(odd_docs).collect()
    assert len(rows) == len({r["component_fp"] for r in classes}) and len(classes) == odd_docs.count()
    assert [r["doc_id"] for r in rows if r["text"] == "word"] == [8]
    assert corpus_pipeline.near_duplicates(spark, no_docs, "").count() == 0


def test_bands_of_long_and_empty_sets():
    assert shingles.bands(shingles.shingle_set(" \n")) == []
    long = shingles.shingle_set(" ".join(map(str, range(20_000))))
    assert len(set(shingles.bands(long))) == shingles.BANDS


def crowd_rows(spark, texts):
    docs = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOCS).repartition(4)
    unique = shingles.numbered(shingles.banded(docs))
    sets = shingles.map_texts(docs.select("text"), [], shingles._set_arrays(5), "name string, shingles binary").join(unique.select("fp", "name"), "name").select("fp", "shingles")
    return docs, unique, sets


@pytest.mark.parametrize("bucket", [1500, 100, 25])
def test_a_crowd_travels_a_bounded_number_of_times(spark, monkeypatch, bucket):
    """1,500 texts that differ in one word of 300, in 1, 15 and 60 parts: whole sets shuffled for each text."""
    r = random.Random(9)
    base = r.choices([f"w{i}" for i in range(500)], k=300)
    texts = []
    for i in range(1500):
        near = list(base)
        near[r.randrange(300)] = f"v{i}"
        texts.append(" ".join(near))
    docs, unique, sets = crowd_rows(spark, texts)
    shuffled = []
    told = shingles._hub_links
    monkeypatch.setattr(shingles, "_hub_links", lambda crowded, *rest: shuffled.append(crowded.where("fp <> hub").select("fp", "hub").distinct().count()) or told(crowded, *rest))
    placed = []
    visits = shingles._visits

    def counted(*args):
        out = visits(*args)
        placed.append(out[0].count())
        return out

    monkeypatch.setattr(shingles, "_visits", counted)
    found = shingles.links(docs, unique, 5, 0.8, bucket)
    copies = placed[0] + sum(shuffled)
    assert copies < 60 * len(texts) and (bucket == 1500 or copies < 6 * len(texts))
    links = Union(range(unique.count()))
    numbers = {r["fp"]: i for i, r in enumerate(unique.select("fp").collect())}
    for r_ in found.collect():
        links.join(numbers[r_["a"]], numbers[r_["b"]])
    assert len({links.find(i) for i in range(unique.count())}) == 1


@pytest.mark.parametrize("bucket", [40, 7])
def test_crowds_with_others_among_them(spark, bucket):
    """Half of a crowd is near its hub, the rest shares bands with it but lies on both sides of the threshold."""
    r = random.Random(11)
    base = r.choices([f"w{i}" for i in range(900)], k=120)
    texts = []
    for i in range(150):
        near = list(base)
        for at in r.sample(range(120), r.choice([1, 1, 2, 3, 4, 5, 6])):
            near[at] = f"x{r.randrange(40)}"
        texts.append(" ".join(near[: r.choice([120, 120, 100, 80])]))
    docs = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs, bucket=bucket).collect()}
    one_part = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [one_part[i] for i in range(len(texts))] == brute(texts)


def test_names_that_agree_in_64_bits_lose_no_document(spark, monkeypatch):
    plain = shingles.set_name
    monkeypatch.setattr(shingles, "set_name", lambda s: "0123456789abcdef" + plain(s)[16:])
    texts = edited_texts()[:40]
    docs = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOCS)
    assert len(simhash.keep_one(docs, width=5, similarity=0.8).collect()) == len(set(brute(texts)))


def test_stage_finds_pairs_within_three_bits_by_simhash_alone(spark, monkeypatch):
    """Without any band, the fingerprints' classes propose what lies within three bits, and the sets decide."""
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), " ".join([*base, "tail"]), " ".join(["head", *base]), " ".join(f"v{i}" for i in range(400)), "", None]
    bits = [shingles.majority(shingles.shingle_set(t)) for t in texts[:4]]
    assert max((bits[0] ^ b).bit_count() for b in bits[1:3]) <= simhash.MAX_BITS < (bits[0] ^ bits[3]).bit_count()
    monkeypatch.setattr(shingles, "bands", lambda s: [])
    docs = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOCS)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted(set(brute(texts))) == [0, 3, 4]
    # linked by bits, but not alike enough
    kept = simhash.keep_one(docs, width=5, similarity=0.9999)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4]
