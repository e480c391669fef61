"""The pipeline's stages, one after the other, against plain versions on a small table."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from seqloom.llm import common, langid, mixing, toxicity
from seqloom.llm.queries import tokenizer_path

from .test_shingles import brute

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage, as pandas tables."""
    docs, out = common.read_table(spark, SMALL, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = common.materialize(stage(spark, docs, SMALL), f"test-{name}")
        out[name] = docs, docs.toPandas(), after.toPandas()
        docs = after
    return out


def same_rows(a, b):
    return Counter(map(tuple, a.astype(object).values.tolist())) == Counter(map(tuple, b.astype(object).values.tolist()))


def test_stages_are_the_five_in_order_and_keep_the_columns(stages):
    assert list(stages) == ["language", "toxicity", "near_duplicates", "mixing", "tokens"]
    for _, before, after in list(stages.values())[:-1]:
        assert list(after.columns) == list(before.columns) and 0 < len(after)


def test_language_stage(stages):
    docs, before, after = stages["language"]
    net, window = langid.fit(docs), langid.WINDOW
    keep = []
    for text in before.text:
        data, p = (text or "").encode(), np.zeros(len(net.languages))
        for at in range(0, len(data), window):
            size = min(window, len(data) - at)
            # what lies behind the text is zero
            x = np.frombuffer((data[at:] + bytes(window + 3))[: window + 3], np.uint8)
            pooled = [sum((net.embed @ f[j])[x[j : j + window]] for j in range(len(f))).max(axis=0) for f in net.filters]
            p += size * net.head(np.concatenate(pooled)[None])[0]
        keep.append(any(c.isalpha() for c in text or "") and p.max() / p.sum() >= corpus_pipeline.LANGUAGE_SCORE)
    assert same_rows(before[keep], after)
    known = before[np.array(keep) & before.lang.notna()]
    assert len(known) > 0.9 * before.lang.notna().sum()  # clean documents stay


def test_toxicity_stage(spark, stages):
    docs, before, after = stages["toxicity"]
    model = toxicity.fit(docs, common.read_table(spark, SMALL, "labels"))
    assert same_rows(before[model.scores(before.text.tolist()) < corpus_pipeline.TOXIC_SCORE], after)


def test_near_duplicate_stage(stages):
    """The stage's own contract is five words and a similarity of 0.8, by brute force over all pairs."""
    _, before, after = stages["near_duplicates"]
    root = before.text.map(dict(zip(before.text, brute(before.text.tolist()), strict=True)))
    assert same_rows(before.loc[before.doc_id.groupby(root).idxmin()], after)
    assert len(after) < len(before)


def rows_of(df):
    return Counter(map(repr, df.collect()))


def test_stages_take_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    given, out = rows_of(odd_docs), {}
    for name, stage in corpus_pipeline.STAGES:
        after = out[name] = stage(spark, odd_docs, SMALL)
        if name != "tokens":
            assert after.columns == odd_docs.columns, name
        if name in ("language", "toxicity", "near_duplicates"):
            assert not rows_of(after) - given and rows_of(after), name
        assert stage(spark, no_docs, SMALL).count() == 0, name
    told = out["language"].collect()
    assert not [r for r in told if r["doc_id"] in (1, 2, 3, 13)] and all(n == given[k] for k, n in rows_of(out["language"]).items())
    assert all(n == given[k] for k, n in rows_of(out["toxicity"]).items())
    texts = [r["text"] for r in odd_docs.collect()]
    assert out["near_duplicates"].count() == len(set(brute(texts)))
    assert all(n <= 2 * given[k] for k, n in rows_of(out["mixing"]).items())
    tokens = out["tokens"].collect()
    assert len(tokens) == len(texts) and {r["n_tokens"] for r in tokens if r["doc_id"] in (1, 2)} == {0}


def test_mixing_stage(stages):
    _, before, after = stages["mixing"]
    con = duckdb.connect()
    con.register("documents", before)
    want = con.sql(mixing.oracle()).df()
    taken = Counter(after.doc_id.tolist())
    sized = want[want["size"] > 0]
    for doc_id, size, total in zip(sized.doc_id, sized["size"], sized.taken, strict=True):
        assert taken[doc_id] == total // size


def test_token_stage_and_the_whole_run(spark, stages):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    library.no_padding()
    _, before, after = stages["tokens"]
    want = []
    for doc_id, text in zip(before.doc_id, before.text, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    told = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(want) == Counter(map(tuple, after[told].values.tolist()))
    whole = corpus_pipeline.run(spark, SMALL).toPandas()
    assert same_rows(whole[sorted(whole.columns)], after[sorted(after.columns)])
