import hashlib
import random
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seqloom.llm import boosting, bpe, common, langid, quality_mil, quality_rules, toxicity

from .conftest import words

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation(), t.no_padding()
    return t


def test_bpe_equals_the_library_on_random_texts(reference):
    codec = bpe.codec_of(open(PATH, "rb").read())
    r = random.Random(1)
    letters = [chr(i) for i in range(256)] + list("  \n\t'sdtrevemláñß中文🙂　\x85\x1c​́١½") + ["<|endoftext|>", "'ll", " the", "ing"] * 5
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["a" * 5000, " " * 300, "ab" * 900]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        want = reference.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert codec.decode(ids) == reference.decode(want, skip_special_tokens=False)


def test_bpe_memory_may_be_emptied(monkeypatch, reference):
    codec = bpe.Codec.from_json(open(PATH, "rb").read())
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    for i in range(6):
        text = words(20, i)
        assert codec.encode([text, text])[1].tolist() == reference.encode(text).ids


def test_bpe_on_odd_rows(spark, odd_docs, no_docs, reference):
    rows = bpe.encode_decode(odd_docs, PATH, ["doc_id", "text"], with_ids=True).select("rec.*", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded").collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        ids = reference.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == (r["text"] or "")
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.encode_decode(no_docs, PATH).count() == 0


def test_language_network_learns_and_tables_equal_convolution():
    r = random.Random(2)
    speak = {"xx": "ka lo mi tu re".split(), "yy": "qwe zxc plö bnm".split(), "zz": "ñas ión que".split()}
    make = lambda lang: " ".join(r.choice(speak[lang]) for _ in range(40)).encode()
    data = [(make(lang), lang) for lang in speak for _ in range(60)]
    net = langid.train([a for a, _ in data], [b for _, b in data], epochs=6)
    fresh = [(make(lang), lang) for lang in speak for _ in range(20)]
    p = langid.probabilities(net, [a for a, _ in fresh])
    assert [net.languages[k] for k in p.argmax(axis=1)] == [b for _, b in fresh]
    text = fresh[0][0][:100]
    x = np.frombuffer(text + bytes(langid.WINDOW + 3 - len(text)), np.uint8)
    pooled = np.concatenate([
        np.max(sum((net.embed @ f[j])[x[j : j + langid.WINDOW]] for j in range(len(f))), axis=0) for f in net.filters
    ])
    assert np.allclose(net.head(pooled[None]), langid.probabilities(net, [text]), atol=1e-5)


def test_language_depends_on_the_text_alone(spark):
    rng = np.random.default_rng(3)
    r = random.Random(3)
    sizes = [*range(12), *(256 * k + d for k in (1, 2, 3) for d in range(-4, 5)), *rng.integers(0, 1500, 960).tolist()]
    texts = ["".join(r.choice("abcdefg hij éß") for _ in range(n)) for n in sizes]
    net = langid.train([t.encode() for t in texts[100:300]], ["x" if i % 2 else "y" for i in range(200)], epochs=1)
    together = langid.probabilities(net, [t.encode() for t in texts], block=37)
    alone = np.concatenate([langid.probabilities(net, [t.encode()]) for t in texts])
    assert np.array_equal(together, alone)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    told = [sorted(map(tuple, langid.predict(docs.repartition(n), net, ["doc_id"]).select("rec.doc_id", "lang_pred", "score").collect())) for n in (1, 5)]
    assert told[0] == told[1]


def test_digits_and_numerals_are_no_letters(spark):
    net = langid.train([b"ab", b"cd"], ["x", "y"], epochs=1)
    odd = ["½ ² Ⅷ ①", "12_3", "ß", "中", "٣"]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    rows = sorted(langid.predict(docs, net).select("rec.doc_id", "lang_pred").collect())
    assert [x["lang_pred"] == "und" for x in rows] == [True, True, False, False, True]


def test_slices_are_bounded_in_rows_and_bytes():
    sizes = np.array([5, 5, 100, 1, 1, 1, 0, 40])
    parts = list(common.slices(sizes, 3, 12))
    assert parts == [(0, 2), (2, 1), (3, 3), (6, 1), (7, 1)]
    assert list(common.slices(np.zeros(0, int), 3, 12)) == []


def test_sample_shuffles_labelled_texts_only(spark, monkeypatch):
    plans = {}
    whole = common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name: plans.update({name: df._jdf.queryExecution().toString()}) or whole(df, name))
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = common.labelled_sample(docs, marks, "quality", 5000, 1, 4, 2)
    known = {r["doc_id"]: r["quality"] for r in marks.where("quality is not null").collect()}
    rows = got.collect()
    assert rows and all(r["label"] == known[r["doc_id"]] for r in rows)
    physical = plans["sample"].split("== Physical Plan ==")[1]
    # the join with the broadcast ids lies below the only shuffle of texts
    assert "SortMergeJoin" not in physical and physical.index("Exchange hashpartitioning") < physical.index("BroadcastHashJoin")


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    rows = langid.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    by_id = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert [by_id[i] for i in (1, 2, 3, 13)] == ["und"] * 4 and by_id[4] in ("en", "de", "fr")
    assert langid.identify(no_docs).count() == 0


def test_trees_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = boosting.fit_trees(x[:1500], y[:1500])
    assert ((model.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95
    iso = boosting.fit_isotonic(np.array([0.0, 1.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    assert (np.diff(iso.values) >= 0).all() and iso(np.array([-9.0]))[0] == iso.values[0]


def test_toxicity_features_see_through_disguise():
    lex, starts = {"stupid": 3.0}, {"idio": 2.0}
    f = lambda t: dict(zip(toxicity.NAMES, toxicity.features(t, lex, starts), strict=True))
    assert f("You are stupid.")["lex_hits"] == 1 and f("You are stupid.")["you_near"] == 1
    assert f("so stup1d $tup!d st*upid stuuupid")["hidden_hits"] == 4
    assert f("s t u p i d that")["hidden_hits"] == 1 and f("an idiotic day")["start_hits"] == 1
    assert f("")["log_words"] == 0


def labels(spark, docs):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 13)] + [(1, None, None), (None, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("op", [toxicity, quality_mil])
def test_scores_of_odd_rows(spark, odd_docs, no_docs, op):
    rows = op.classify(odd_docs, labels(spark, odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    nothing = labels(spark, odd_docs).limit(0)
    assert op.classify(no_docs, nothing).count() == 0 and op.classify(odd_docs, nothing).count() == len(rows)


@pytest.mark.parametrize(("op", "label", "least"), [(toxicity, "toxic", 0.95), (quality_mil, "quality", 0.95)])
def test_held_out_accuracy(spark, op, label, least):
    from pyspark.sql import functions as F

    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(marks, "doc_id", "left_semi")
    told = op.classify(docs, marks).join(marks, "doc_id").where("held_out")
    right, called, ones = told.agg(*[F.count_if(F.expr(c)) for c in (f"predicted = 1 AND {label} = 1", "predicted = 1", f"{label} = 1")]).first()
    # precision and recall: of a rare label, accuracy alone would not tell
    assert right >= least * called and right >= (least if label == "quality" else 0.85) * ones > 0


@pytest.mark.parametrize("block", [50, 777])
def test_encodings_do_not_depend_on_blocks(monkeypatch, block):
    r = random.Random(1)
    texts = [" ".join(r.choice("the of HOUSE water,, a.b 1234 ünï — x\n\n y".split(" ")) for _ in range(n)) for n in (0, 1, 3, 63, 64, 65, 129, 3000)]
    texts += [" " + t + "\n" for t in texts] + [texts[-1] * 2]
    whole = [quality_mil.encode(t) for t in texts]
    model = quality_mil.train(whole, np.array([i % 2 for i in range(len(texts))], np.float32), epochs=2)
    at_once, _ = model.forward(np.concatenate(whole), np.cumsum([0, *map(len, whole[:-1])]))
    monkeypatch.setattr(quality_mil, "BLOCK", block)
    for t, bag, p in zip(texts, whole, at_once, strict=True):
        assert np.array_equal(quality_mil.encode(t), bag)
        assert abs(model.probability(quality_mil.blocks(t)) - p) < 1e-5
        few = bag[np.linspace(0, len(bag) - 1, 8).astype(int)] if len(bag) > 8 else bag
        assert np.array_equal(quality_mil._spread(t, 8), few)


def test_a_very_long_text_is_encoded_in_bounded_memory():
    code = """
import resource
from seqloom.llm import quality_mil
text = "some words of a text that goes on and on, line by line\\n" * 900_000
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
before = peak()
assert len(text) > 49_000_000 and sum(map(len, quality_mil.blocks(text))) == -(-900_000 * 13 // 64)
print(peak() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True)
    assert int(out.stdout) < 500 * 1024


def test_attention_prefers_the_telling_passage():
    rng = np.random.default_rng(4)
    bags, y = [], []
    for i in range(400):
        bag = rng.normal(0, 0.1, (rng.integers(2, 8), quality_mil.SIZE)).astype(np.float32)
        if i % 2:
            bag[rng.integers(len(bag)), 3] += 2.0
        bags.append(bag)
        y.append(1.0 - i % 2)
    model = quality_mil.train(bags, np.array(y, np.float32))
    p, (_, _, _, _, alpha, _, _) = model.forward(np.concatenate(bags), np.cumsum([0, *map(len, bags[:-1])]))
    assert ((p > 0.5) == np.array(y)).mean() > 0.95


def plain_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times, covered, seen, dup = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if times[x] > 1:
            covered.update(range(i, i + 5))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_rule_statistics_equal_brute_force(spark, odd_docs, no_docs):
    extra = ["a b c d e a b c d e f", "x x x x x x x x", "l1\nl1\n \nl1\r\nl2", "q\x1cq\x85z", "1 2 3 4 5 6 7 1 2 3 4 5 | # <b>"]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    joined = quality_rules.with_statistics(docs, "doc_id", "text")
    for r in joined.collect():
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_statistics(r["text"])[:5], r["text"]
    test, rule = quality_rules.Test, quality_rules.Rule
    rules = [
        rule((test("n_words", True, 200.0), test("distinct_share", False, 0.5)), True),
        rule((test("symbols_per_word", True, 0.2),), False), rule((test("chars_per_word", False, 4.5), test("n_words", True, 20.0)), False), rule((), True),
    ]
    # every answer against the plain statistics and the list applied in numpy
    answers = quality_rules.judge(docs, rules).collect()
    stats = quality_rules.with_statistics(docs, "doc_id", "text").collect()
    x = np.array([[float(r[c]) for c in quality_rules.TESTED] for r in stats])
    want = Counter()
    for r, kept in zip(stats, quality_rules.decide(rules, x), strict=True):
        *figures, failed = plain_statistics(r["text"])
        want[(r["doc_id"], *figures, failed, bool(kept) and not failed)] += 1
    assert Counter(map(tuple, answers)) == want and len({r["kept"] for r in answers}) == 2
    marks = labels(spark, odd_docs)
    assert quality_rules.judge(no_docs, quality_rules.fit(no_docs, marks)).count() == 0
    assert isinstance(quality_rules.fit(odd_docs, marks), list)


def test_sequential_covering_finds_planted_rules():
    rng = np.random.default_rng(9)
    x = rng.random((3000, len(quality_rules.TESTED)))
    a, b = quality_rules.TESTED.index("symbols_per_word"), quality_rules.TESTED.index("distinct_share")
    good = ~((x[:, a] > 0.8) | ((x[:, b] < 0.2) & (x[:, 0] > 0.5)))
    rules = quality_rules.learn(x, good)
    assert (quality_rules.decide(rules, x) == good).mean() > 0.97 and 2 <= len(rules) <= 9
    assert quality_rules.learn(x[:0], good[:0]) == [quality_rules.Rule((), True)]


def test_order_of_rules_matters():
    rng = np.random.default_rng(10)
    x = rng.random((4000, len(quality_rules.TESTED)))
    a, b = quality_rules.TESTED.index("symbols_per_word"), quality_rules.TESTED.index("distinct_share")
    good = (x[:, a] > 0.7) | (x[:, b] > 0.4)  # what is rich in symbols stays, however few words differ
    rules = quality_rules.learn(x, good)
    assert {r.keep for r in rules[:-1]} == {True, False}
    assert (quality_rules.decide(rules, x) == good).mean() > 0.98
    assert (quality_rules.decide(rules[::-1], x) == good).mean() < 0.9


def plain_features(text, words, starts):
    """The figures of a text, token by token, as the operator's docstrings define them."""
    toks = toxicity.tokens_of(text)
    n, out = max(1, len(toks)), dict.fromkeys(toxicity.NAMES, 0.0)
    raw = text.encode("utf-8", "surrogatepass")
    stretch = [i for i in range(2, len(raw)) if raw[i] == raw[i - 1] == raw[i - 2] and (raw[i] >= 128 or chr(raw[i]).isalpha())]
    kind = {}
    for t in set(toks):
        folded = re.sub(r"(.)\1{2,}", r"\1", t)
        beginnings = [(starts[t[:k]], -k) for k in toxicity.BEGINNINGS if t[:k] in starts]
        if t in words:
            kind[t] = ("lex", t, words[t])
        elif t and not t.isalpha():
            if toxicity.plain_form(t) in words:
                kind[t] = ("hidden", t, 0.0)
        elif len(t) >= 4 and stretch and folded != t and folded in words:
            kind[t] = ("hidden", t, 0.0)
        elif len(t) >= 4 and beginnings:
            weight, k = max(beginnings)
            kind[t] = ("start", t[:-k], weight)
    runs, run = [], []
    if sum(len(t) == 1 for t in set(toks)) >= 3:
        for t in [*toks, ""]:
            if len(t) == 1 and t.isalpha():
                run.append(t)
            else:
                runs += ["".join(run)] if len(run) >= 4 else []
                run = []
    you = [i for i, t in enumerate(toks) if t in toxicity.SECOND_PERSON]
    of = lambda k: [i for i, t in enumerate(toks) if kind.get(t, ("",))[0] == k]
    lex, hidden, start = of("lex"), of("hidden"), of("start")
    spelled = [s for s in runs if s in words]
    own = {t: w for t, (k, _, w) in kind.items() if k == "lex"}
    begun = {(b, w) for k, b, w in kind.values() if k == "start"}
    begun_all = [(b, w) for k, b, w in kind.values() if k == "start"]
    hidden_all = {t for t, (k, _, _) in kind.items() if k == "hidden"} | set(spelled)
    out |= {"log_words": np.log1p(len(toks)), "lex_hits": len(lex), "lex_density": len(lex) / n, "lex_distinct": len(own), "lex_weight": sum(own.values()), "lex_top": max(own.values(), default=0)}
    out |= {"start_hits": len(start), "start_density": len(start) / n, "start_distinct": len(begun), "start_weight": sum(w for _, w in begun_all), "start_top": max((w for _, w in begun_all), default=0)}
    out |= {"hidden_hits": len(hidden) + len(spelled), "hidden_density": (len(hidden) + len(spelled)) / n, "any_distinct": len(own) + len(hidden_all)}
    out |= {"you_density": len(you) / n, "you_near": sum(any(abs(i - j) <= toxicity.NEAR for j in you) for i in lex + hidden)}
    upper, lower = (sum(lo <= c <= hi for c in raw) for lo, hi in ((65, 90), (97, 122)))
    out |= {"capitals": upper / max(1, upper + lower), "bangs": raw.count(b"!") / n, "punctuation": sum(chr(c) in ".,;:?'\"()-" for c in raw) / n}
    out |= {"signs": sum(32 < c < 128 and not chr(c).isalnum() and chr(c) not in "!.,;:?'\"()-" for c in raw) / n, "digits": sum(48 <= c <= 57 for c in raw) / max(1, len(raw))}
    mixed = [t for t in toks if t and not t.isalpha() and re.search(r"[^\W\d_]", t) and re.search(r"[^\w]|\d|_", t) and t not in toxicity.SECOND_PERSON and t not in own and kind.get(t, ("",))[0] != "hidden"]
    disguised = [i for i in hidden if not toks[i].isalpha() and re.search(r"[^\W\d_]", toks[i])]
    return out | {"mixed_words": (len(mixed) + len(disguised)) / n, "stretched": len(stretch) / n, "spelled": len(runs) / n}


def test_toxicity_features_equal_a_plain_version(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, marks)
    extra = ["", "You 1diot, stup1d y0u!!! s t u p i d", "aaaa bbbb!!! ###", "ÉÉÉ ßßß"]
    some = [r["text"] for r in docs.limit(150).collect()] + [r["text"] for r in docs.join(marks.where("toxic = 1"), "doc_id").limit(60).collect()] + extra
    lexicon = dict(list(model.words.items())[:50]) | {"stupid": 2.0, "idiot": 1.5}
    for t in some:
        want = plain_features(t, lexicon, model.starts)
        got = dict(zip(toxicity.NAMES, toxicity.features(t, lexicon, model.starts), strict=True))
        assert got == pytest.approx(want), t[:200]
    # the trees, row by row and node by node
    x = np.array([toxicity.features(t, model.words, model.starts) for t in some])
    for row, margin in zip(x, model.trees.margin(x), strict=True):
        total = model.trees.start
        for f, th, leaf in zip(model.trees.feature, model.trees.threshold, model.trees.leaf, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + (2 if row[f[k]] > th[k] else 1)
            total += leaf[k - len(f)]
        assert margin == pytest.approx(total)


def test_lexicon_of_a_fold_has_not_seen_it(spark):
    rows = [(f"only{i % 2}x word{i % 2}y und", 1, i % 2) for i in range(40)] + [("clean words here", 0, i % 2) for i in range(200)]
    sample = spark.createDataFrame(rows, "text string, label int, fold int")
    whole, (first, second) = toxicity.learn_lexicons(sample.repartition(3), folds=2)
    assert not any(w.isalpha() for w in whole[0] if any(c.isdigit() for c in w)) and set(whole[0]) == {"und"}
    rows = [(f"{'abe'[i % 2] * 4}rt und", 1, i % 2) for i in range(40)] + [("clean words here", 0, i % 2) for i in range(200)]
    whole, (first, second) = toxicity.learn_lexicons(spark.createDataFrame(rows, "text string, label int, fold int"), folds=2)
    assert set(whole[0]) == {"aaaart", "bbbbrt", "und"} and set(first[0]) == {"bbbbrt", "und"} and set(second[0]) == {"aaaart", "und"}


def test_attention_model_equals_a_plain_forward_pass():
    texts = [words(n, n) for n in (1, 63, 64, 65, 400)] + ["", "Zeile\nnoch eine ###", "a a a a b b c é ß " * 30]
    model = quality_mil.train([quality_mil.encode(t) for t in texts], np.arange(len(texts)) % 2.0, epochs=2)
    bags = [quality_mil.encode(t) for t in texts]
    together, _ = model.forward(np.concatenate(bags), np.cumsum([0, *map(len, bags[:-1])]))
    w, b, v, u, a, c, d = model.params
    for bag, p in zip(bags, together, strict=True):
        hidden, raw = [], []
        for x in bag:
            h = np.maximum(np.clip((x - model.mean) / model.scale, -6, 6) @ w + b, 0)
            hidden.append(h)
            raw.append(float((np.tanh(h @ v) / (1 + np.exp(-(h @ u)))) @ a))
        e = np.exp(np.array(raw) - max(raw))
        pooled = sum(x * k for x, k in zip(hidden, e / e.sum(), strict=True))
        assert p == pytest.approx(1 / (1 + np.exp(-(pooled @ c + d[0]))), rel=1e-4)


def test_passages_are_encoded_as_defined():
    text = " ".join(["Abc", "abc", "x1", "x1", "longwordofmorethantwenty"] * 30) + "\nlast !!"
    tokens = text.split()
    got = quality_mil.encode(text)
    assert got.shape == (-(-len(tokens) // quality_mil.PASSAGE), quality_mil.SIZE)
    seen = set()
    for i, row in enumerate(got):
        own = tokens[i * quality_mil.PASSAGE : (i + 1) * quality_mil.PASSAGE]
        at = range(i * quality_mil.PASSAGE, i * quality_mil.PASSAGE + len(own))
        repeats = len(own) - len(set(own))
        same = sum(tokens[k] == tokens[k + 1] for k in at if k + 1 < len(tokens) and k + 1 in at) + (i > 0 and tokens[at[0]] == tokens[at[0] - 1])
        old = 0
        for k in at:
            if k + 2 < len(tokens):
                triple = tuple(tokens[k : k + 3])
                old += triple in seen
                seen.add(triple)
        tail = [repeats / len(own), same / len(own), old / len(own), sum(map(len, own)) / len(own) / 10, sum(len(t) > 20 for t in own) / len(own), len(own) / quality_mil.PASSAGE]
        assert row[-6:] == pytest.approx(tail)
    backwards = quality_mil.encode(" ".join(t[::-1] for t in tokens))
    letters = slice(quality_mil._KINDS * (quality_mil._KINDS + 1), quality_mil._KINDS * (quality_mil._KINDS + 1) + quality_mil.TRIGRAMS)
    assert np.abs(got[:, letters] - backwards[:, letters]).max() > 0.1 and got[:, letters].sum() > 0


def test_texts_travel_once_and_tasks_end_with_a_call(spark, tmp_path):
    """A text among the kept columns is no second column, and what a function remembers goes with its task."""
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "ü")], "doc_id long, text string").coalesce(1)
    mark = str(tmp_path / "done")
    told = common.map_texts(docs, None, lambda texts: [pa.array([t and t.upper() for t in texts])], "big string", 2, done=lambda: open(mark, "a").write("x"))
    assert sorted((r["rec"]["doc_id"], r["rec"]["text"], r["big"]) for r in told.collect()) == [(1, "a b", "A B"), (2, None, None), (3, "ü", "Ü")]
    with open(mark) as f:
        assert f.read() == "x"
    given = told._jdf.queryExecution().optimizedPlan().children().head().output()
    assert given.size() == 1
