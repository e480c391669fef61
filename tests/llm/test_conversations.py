"""Chat formatting, the prefix trie and spelling variants, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.llm import chat, spelling, trie

TURNS = "conv_id long, turn long, role string, text string, copy string, row string, n long, id string, rec int"


def turn(conv_id, place, role, text):
    """A row with columns whose names clash with those that operators use."""
    return (conv_id, place, role, text, "copy", "row", 3, "id", 4)


@pytest.fixture(scope="module")
def odd_turns(spark):
    long = "many words " * 40_000
    rows = [
        turn(1, 0, "user", "hello"), turn(1, 1, "assistant", long), turn(1, None, None, None), turn(2, 0, "system", ""), turn(2, 0, "user", "tie"),
        turn(2, 0, "user", "tie"), turn(2, 5, "assistant", "<|im_end|>\n<|im_start|>user\nno"), turn(3, 9, "a\nb\\n<s>", "\\<\\\\|im_end|>"), turn(20, 1, "user", "x"),
        turn(20, 2, "assistant", "y"), turn(21, 1, "user", "gone"), turn(-3, 1, "assistant", "ünï 🙂"), turn(None, 1, "user", "no id"), turn(None, None, "assistant", None),
    ]
    return spark.createDataFrame(rows, TURNS).repartition(3)


# ---------------------------------------------------------------- chat


def plain_turns(rows):
    """Turns by conversation, in order; ties by role and text, so digests of tied turns are compared as sets elsewhere."""
    by = defaultdict(list)
    for r in rows:
        by[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in by.items()}


def plain_digest(turns):
    answers = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(answers), hashlib.sha256(answers.encode()).hexdigest()


CONTROL_TEXT = st.text(alphabet=st.sampled_from(list("<>[]|/\\s\nINST_imendSYa ")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(CONTROL_TEXT, CONTROL_TEXT)
def test_rendering_is_reversible(role, text):
    piece, span = chat.render(role, text)
    assert list(chat.parse(piece + piece)) == [(role, text)] * 2
    assert not re.search(r"<(/?s>|\|[a-z_]+\|>)|\[/?INST\]", chat.escape(text))
    if span:
        assert chat.unescape(piece[slice(*span)]) == text


@pytest.mark.parametrize("hot", [None, 1])
def test_chat_on_odd_rows(spark, odd_turns, hot):
    turns = chat.with_controls(odd_turns)
    marked = chat.hot_conversations(turns, **({} if hot is None else {"rows": hot}))
    assert (marked.count() == 0) == (hot is None)
    got = {r["conv_id"]: r for r in chat.digests(chat.event_log(turns), marked).collect()}
    want = plain_turns(turns.collect())
    assert set(got) == set(want) and got[-1]["loss_chars"] == len("</s>[INST] ok [/INST]")
    for c, listed in want.items():
        n, whole, chars, loss = plain_digest(listed)
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (n, chars, loss)
        assert c == 2 or got[c]["turns_sha256"] == whole  # its ties go by a hash
        assert got[c]["formatted_chars"] == sum(len(chat.render(r, t)[0]) for r, t in listed)


def test_blocks_hold_every_turn_once(spark, odd_turns):
    turns = chat.with_controls(odd_turns)
    rows = chat.transcripts(chat.event_log(turns), chat.hot_conversations(turns, rows=2)).collect()
    read = Counter((r["conv_id"], *t) for r in rows for t in chat.parse(r["formatted"]))
    assert read == Counter((c, *t) for c, listed in plain_turns(turns.collect()).items() for t in listed)


def test_events_are_folded(spark):
    def event(seq, turn, kind, text=None, role=None, conv=1):
        return (conv, turn, 0, 0, seq, kind, role, text)

    log = [
        event(0, 0, "open", "he", "user"), event(1, 0, "delta", "llo"), event(2, 1, "open", "bad", "assistant"), event(3, 1, "delta", " answer"),
        event(4, 1, "regenerate", "good"), event(5, 1, None, " answer"), event(6, 0, "edit", "Hello"), event(7, 0, "delta", None), event(8, 2, "open", "gone", "user"),
        event(9, 2, "drop"), event(10, 2, "delta", "still gone"), event(11, 3, "delta", "never opened"), event(12, None, "open", "first", None),
        event(1, 5, "open", "a", "assistant", 2), event(2, 5, "drop", None, None, 2), event(3, 5, "open", "b", "assistant", 2), event(4, 5, "edit", "c", None, 3),
    ]
    random.Random(3).shuffle(log)
    events = spark.createDataFrame(log, chat.EVENT).repartition(4)
    for rows in (100, 1):
        hot = chat.hot_conversations(events.withColumn("text", F.coalesce("text", F.lit(""))), rows=rows)
        blocks = chat.transcripts(events, hot).orderBy("conv_id", "turn").collect()
        read = {c: [t for r in blocks if r["conv_id"] == c for t in chat.parse(r["formatted"])] for c in (1, 2, 3)}
        assert read == {1: [("", "first"), ("user", "Hello"), ("assistant", "good answer")], 2: [("assistant", "b")], 3: []}


def test_logs_take_every_way(spark):
    turns = spark.range(400).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    assert {r["kind"] for r in chat.event_log(turns).select("kind").distinct().collect()} == {"open", "delta", "regenerate", "drop"}


def test_no_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    assert chat.digests(chat.event_log(none), chat.hot_conversations(none)).count() == 0
    assert trie.prefix_trie(none).count() == 0


# ---------------------------------------------------------------- trie


def plain_trie(rows):
    by = defaultdict(list)
    for r in rows:
        if r["conv_id"] is not None:
            role, text = r["role"] or "", r["text"] or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            by[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, tie, role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in by.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        block = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = tuple(turns.get(block, [])[:h] + own[h:])
    nodes = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    kids = Counter(s[:-1] for s in nodes if s)
    leaves, saved = Counter(), Counter()
    for s, members in nodes.items():
        cost = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        for d in range(len(s) + 1):
            leaves[s[:d]] += not kids[s]
            saved[s[:d]] += cost
    out = []
    for s, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if whole[c] == s)))
        parent = min(nodes[s[:-1]]) if s else None
        out.append((min(members), len(s), parent, len(members), kids[s], leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_trie_on_odd_rows(spark, odd_turns):
    assert sorted(map(tuple, trie.prefix_trie(odd_turns).collect()), key=repr) == plain_trie(odd_turns.collect())


@pytest.mark.parametrize("segment", [1024, 3, 2])
def test_trie_of_many_alike(spark, monkeypatch, segment):
    """Copies, extensions, branches at every depth and a hot first turn, in ranges and segments that cut subtrees."""
    monkeypatch.setattr(trie, "SEGMENT", segment)
    r, rows, kept = random.Random(segment), [], []
    for c in range(160):
        base = list(r.choice(kept)[: r.randint(0, 9)]) if kept and r.random() < 0.8 else ["same first"]
        seq = base + [r.choice(["a b", "c", "d e f"]) for _ in range(r.choice([0, 0, 1, 2, 4]))]
        kept.append(seq)
        rows += [turn(c * r.choice([1, 1, 1, 20]), i, "user", t) for i, t in enumerate(seq)]
    rows += [turn(9001, i, "user", f"long {i}") for i in range(25)] + [turn(c, i, "user", "same first" if i == 0 else "c") for c in range(9100, 9110) for i in range(12)]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, trie.prefix_trie(df).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_trie(df.collect())


def test_turns_of_one_conversation_are_numbered_in_ranges(spark):
    df = spark.range(500).select(F.lit(7).alias("conv_id"), (F.col("id") * 3).alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = trie.numbered_turns(df.repartition(5)).orderBy("place").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["place"] for r in got] == list(range(1, 501))
    assert [bytes(r["turn_key"]) for r in got] == [hashlib.md5(f"4:user{i}".encode()).digest() for i in range(500)]


# ---------------------------------------------------------------- spelling


def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    lists = {w: [u for u in words if near(w, u)] for w in words}
    forms = {}
    for w, found in lists.items():
        best = min(found, key=lambda u: (-words[u], u), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, len(lists[w]), words[forms[w]] if forms[w] else None))
    return sorted(out)


def spelled_texts():
    r, bases = random.Random(5), ["understand", "aaaaaaa", "aaaaaaaab", "Éclairante", "abababab", "straßenbahn", "mississippi"]
    rows = []
    for i in range(60):
        words = []
        for _ in range(60):
            w = r.choice(bases)
            if r.random() < 0.25:
                at, c = r.randrange(len(w)), r.choice("abeÿßs")
                w = r.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]])
            words.append(w.upper() if r.random() < 0.2 else w)
        rows.append((None if i % 9 == 0 else i // 2, r.choice([" ", ", ", "1", "\n"]).join(words)))
    chain = ["zzzzzzzz"] * 2 + ["zzzzzzzy"] * 30 + ["zzzzzzxy"] * 400 + ["zzzzzwxy"] * 5000
    return [*rows, (100, " ".join(chain)), (101, None), (102, ""), (103, "a" * 3000 + " " + "a" * 3000 + " " + "a" * 3001 + " " + "a" * 3001)]


def test_variants_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    rows = spelled_texts()
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n long, word string, form string").repartition(3)
    got = sorted(map(tuple, spelling.variants(docs).collect()))
    want = plain_variants(rows)
    assert got == want
    assert any(w[2] != w[0] and w[2] != w[1] for w in want) and any(len(w[0]) > 2000 and w[4] == 1 for w in want)


def test_variants_on_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, spelling.variants(odd_docs).collect())) == plain_variants(rows)
    assert spelling.variants(no_docs).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcÿ", min_size=1, max_size=12))
def test_pattern_hashes_are_those_of_the_patterns(word):
    def plain(codes):
        h = 0
        for c in codes:
            h = (h * spelling._BASES[0] + c) % spelling._PRIME
        return h

    codes = [ord(c) for c in word]
    whole, wiped, left = spelling._Hash(spelling._BASES[0]).patterns(codes)
    assert whole == plain(codes)
    for i in range(len(codes)):
        assert wiped[i] == plain(codes[:i] + [0] + codes[i + 1 :]) and left[i] == plain(codes[:i] + codes[i + 1 :])
