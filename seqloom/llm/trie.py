"""The prefix trie of conversations, as a Patricia trie made from their sorted order.

A turn is named by the MD5 of its role and text, so texts never travel. Conversations become rows
of turn names; equal ones are counted together, the different ones are cut into ranges of their
order, and each range is sorted and walked once with a stack. Only points become nodes: where
conversations branch, where one ends, and leaves; an edge keeps the words of the turns between
two points. Counts and sums are made on the points, and the nodes between them follow at last
from the sums over the rest of their edge.

Ranges cut subtrees. A task knows how many turns its first row shares with the row before, and its
last row with the one after; along these shared paths every depth is a point, in each task that
meets it, so what the tasks found of it adds up in one grouping by the point.

A row holds ``SEGMENT`` turns. What a conversation has beyond is its own affair if nobody shares the
turns before; conversations that do share them go through the same steps again with the next
segment, in the trie of those that began alike, and its sums are handed up to the segment before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import WORD, discard, materialize

#: Turns in one row.
SEGMENT = 1024
#: Conversations that begin alike by rule: blocks of this many ids share the first turns of their first.
BLOCK = 20
EMPTY = hashlib.sha256(b"").hexdigest()
#: Bytes of text that one piece of a digested list has at most.
PIECE = 1 << 20

NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# ---------------------------------------------------------------- turns and rebuilt conversations


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, place, turn_key, words)``: turns by number from 1, null turns first, ties by role and text's MD5.

    Rows are dealt out by ranges of (conv_id, turn), so the turns of one very long conversation are
    numbered in many tasks; only conversations that lie in several ranges need the sizes of earlier ones.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), named.alias("turn_key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    ranged = materialize(rows.repartitionByRange("conv_id", "turn", "turn_key").withColumn("range", F.spark_partition_id()), "trie-turns")
    sizes = ranged.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    cut = sizes.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("range", "n"))).alias("parts")).where(F.size("parts") > 1)
    before = lambda i: F.aggregate(F.slice("parts", 1, i), F.lit(0).cast("long"), lambda s, p: s + p["n"])
    # two rows at most for each range, whatever the table
    offsets = cut.select("conv_id", F.inline(F.transform("parts", lambda p, i: F.struct(p["range"].alias("range"), before(i).alias("before")))))
    own = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(F.col("turn").asc_nulls_first(), "turn_key"))
    local = ranged.withColumn("own", own).join(F.broadcast(offsets), ["conv_id", "range"], "left")
    return local.select("conv_id", (F.col("own") + F.coalesce("before", F.lit(0))).alias("place"), "turn_key", "words")


def shared_turns(conv_id: Column) -> Column:
    """How many first turns of a conversation are those of the first of its block."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with the shared first turns put in: ``(conv_id, place, turn_key, words)``, and a table ``(conv_id, n_turns)``."""
    first = F.col("conv_id") - F.col("conv_id") % BLOCK
    ids = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("shared", shared_turns(F.col("conv_id"))).withColumn("block", first)
    turn = F.struct("place", "turn_key", "words")
    heads = turns.where((F.col("conv_id") % BLOCK == 0) & (F.col("place") < 4)).groupBy(F.col("conv_id").alias("block")).agg(F.sort_array(F.collect_list(turn)).alias("head"))
    none = F.array().cast("array<struct<place:bigint,turn_key:binary,words:bigint>>")
    head = F.coalesce("head", none)
    listed = ids.join(heads, "block", "left").select("conv_id", "n", "shared", F.slice(head, 1, F.least(F.col("shared").cast("int"), F.size(head))).alias("head"))
    table = materialize(listed, "trie-ids")
    own = turns.join(table.select("conv_id", "shared", F.size("head").alias("given")), "conv_id").where("place > shared")
    moved = own.select("conv_id", (F.col("place") - F.col("shared") + F.col("given")).alias("place"), "turn_key", "words")
    given = table.select("conv_id", F.inline("head"))
    lengths = table.select("conv_id", (F.size("head") + F.greatest(F.col("n") - F.col("shared"), F.lit(0))).cast("long").alias("n_turns"))
    return materialize(moved.unionByName(given), "trie-rebuilt"), lengths


# ---------------------------------------------------------------- rows of turns, ranges of their order


def _segments(turns: DataFrame, live: DataFrame, level: int) -> DataFrame:
    """``live(conv_id, n_turns, grp)`` with its turns of one segment: ``(conv_id, grp, key, seq, words, more)``."""
    low = level * SEGMENT
    part = turns.where((F.col("place") > low) & (F.col("place") <= low + SEGMENT))
    lists = part.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "turn_key", "words"))).alias("t"))
    joined = live.join(lists, "conv_id", "left")
    seq = F.coalesce(F.col("t.turn_key"), F.array().cast("array<binary>"))
    counts = F.coalesce(F.col("t.words"), F.array().cast("array<bigint>"))
    hexed = F.concat(F.col("grp"), F.array_join(F.transform("seq", lambda x: F.hex(x)), ""))
    key = F.when(F.size("seq") == 0, F.col("grp")).otherwise(F.md5(F.unhex(hexed)))
    return joined.select("conv_id", "n_turns", "grp", seq.alias("seq"), counts.alias("words")).select(
        "conv_id", "n_turns", "grp", key.alias("key"), "seq", "words", (F.col("n_turns") > low + SEGMENT).alias("more")
    )


def _paths(segments: DataFrame) -> DataFrame:
    """Different rows of turns, with the number of conversations, the smallest id, and how many go on."""
    return segments.groupBy("grp", "key").agg(
        F.first("seq").alias("seq"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("lead"), F.count_if("more").alias("n_more")
    )


def _shared(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(first == 0, F.size(a)).otherwise(first - 1).cast("int")


POINT = "edge boolean, id string, parent string, depth long, above long, n long, lead long, leaves long, saved long, children long, rest array<bigint>"


class _Point:
    __slots__ = ("depth", "id", "opened", "edge", "n", "lead", "leaves", "saved", "children")

    def __init__(self, depth: int, id_: str, opened: bool, edge: bool):
        self.depth, self.id, self.opened, self.edge = depth, id_, opened, edge
        self.n, self.lead, self.leaves, self.saved, self.children = 0, None, 0, 0, 0


class _Walk:
    """The stack of points along the current row of one range; closed points are collected in ``out``."""

    def __init__(self, low: int):
        self.low, self.out, self.stack = low, [], []
        self.words, self.states = [], []

    def _name(self, depth: int) -> str:
        return self.states[depth].hexdigest() if depth else self.group

    def _add(self, depth: int, opened: bool, edge: bool) -> None:
        """A point on the current path, among those there are."""
        at = len(self.stack)
        while at and self.stack[at - 1].depth >= depth:
            at -= 1
        if at < len(self.stack) and self.stack[at].depth == depth:
            self.stack[at].edge |= edge
        else:
            self.stack.insert(at, _Point(depth, self._name(depth), opened, edge))

    def _close(self, shared: int) -> None:
        """Close all points deeper than ``shared``; -1 closes the whole trie."""
        while self.stack and self.stack[-1].depth > shared:
            p = self.stack.pop()
            if p.depth:
                p.saved += p.n * self.words[p.depth - 1] - (self.words[p.depth - 1] if p.opened else 0)
                if shared >= 0 and (not self.stack or self.stack[-1].depth < shared):
                    self._add(shared, True, False)
                up = self.stack[-1]
                rest, total = [0], 0
                for depth in range(p.depth - 1, up.depth, -1):
                    total += self.words[depth - 1]
                    rest.append(total)
                up.n += p.n
                up.lead = p.lead if up.lead is None else min(up.lead, p.lead)
                up.leaves += p.leaves
                up.saved += p.saved + (p.n - 1) * total
                up.children += 1 if p.opened or p.depth > up.depth + 1 else 0
                above, parent = up.depth, up.id
            else:
                rest, above, parent = [0], -1, None
            deep = (p.depth + self.low, above + self.low)
            self.out.append((p.edge, p.id, parent, *deep, p.n, p.lead, p.leaves, p.saved, p.children, rest[::-1]))

    def step(self, group: str, seq: list, words: list, shared: int, first: bool, after: int | None, n: int, lead: int, tail: tuple) -> None:
        """The next row, which shares ``shared`` turns with the one before, and the last one of the range ``after`` with the one behind."""
        self._close(shared if not first else -1)
        if first or shared < 0:
            self.group, self.states = group, [hashlib.md5(bytes.fromhex(group))]
            kept = 0
        else:
            kept = shared
        del self.states[kept + 1 :]
        for name in seq[kept:]:
            state = self.states[-1].copy()
            state.update(name)
            self.states.append(state)
        self.words = words
        if first and shared >= 0:
            for depth in range(shared + 1):
                self._add(depth, False, True)
        elif first or shared < 0:
            self._add(0, True, False)
        self._add(len(seq), True, False)
        if after is not None:
            for depth in range(after + 1):
                self._add(depth, True, True)
        end = self.stack[-1] if self.stack[-1].depth == len(seq) else None
        saved, leaves, children = tail
        end.n += n
        end.lead = lead if end.lead is None else min(end.lead, lead)
        end.saved += saved
        end.leaves += leaves
        end.children += children


def _walker(level: int):
    """mapInArrow function over rows (range, before, after, grp, seq, words, n, lead, saved, leaves, children) sorted by range, grp, seq."""
    types = [pa.bool_(), pa.string(), pa.string(), *[pa.int64()] * 7, pa.list_(pa.int64())]
    names = [c.split()[0] for c in POINT.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, held = _Walk(level * SEGMENT), None

        def taken() -> Iterator[pa.RecordBatch]:
            if walk.out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*walk.out, strict=True), types, strict=True)], names)
                walk.out.clear()

        def common(a: list, b: list) -> int:
            return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

        def settle(row: tuple, shared: int, first: bool, following: tuple | None) -> None:
            """A row goes in when the one behind it is known: one that is not continued is a leaf."""
            range_, _, after, group, seq, words, n, lead, *tail = row
            last = following is None or following[0] != range_
            on = after if last else common(seq, following[4]) if following[3] == group else -1
            saved, leaves, children = tail
            leaf = 0 if on == len(seq) else 1
            walk.step(group, seq, words, shared, first, after if last and after >= 0 else None, n, lead, (saved, leaves or leaf, children))

        before = None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if held is not None:
                    settle(held, *before, row)
                    if len(walk.out) >= 2048:
                        yield from taken()
                first = held is None or held[0] != row[0]
                before = (row[1] if first else common(held[4], row[4]) if held[3] == row[3] else -1, first)
                held = row
        if held is not None:
            settle(held, *before, None)
            walk._close(-1)
        yield from taken()

    return walk


def _points(paths: DataFrame, level: int) -> DataFrame:
    """``paths`` with what lies below their ends -> the points of the Patricia tries of all groups, each once."""
    ranged = materialize(paths.repartitionByRange("grp", "seq").withColumn("range", F.spark_partition_id()), "trie-paths")
    row = F.struct("grp", "seq")
    ends = ranged.groupBy("range").agg(F.min(row).alias("low"), F.max(row).alias("high"))
    order = Window.orderBy("range")  # a row for each range
    linked = ends.withColumn("prev", F.lag("high").over(order)).withColumn("next", F.lead("low").over(order))
    over = lambda near, own: F.when(F.col(f"{near}.grp") == F.col(f"{own}.grp"), _shared(F.col(f"{near}.seq"), F.col(f"{own}.seq"))).otherwise(-1)
    bounds = linked.select("range", over("prev", "low").alias("before"), over("next", "high").alias("after"))
    rows = ranged.join(F.broadcast(bounds), "range").select("range", "before", "after", "grp", "seq", "words", "n", "lead", "saved", "leaves", "children")
    found = materialize(rows.repartition("range").sortWithinPartitions("range", "grp", "seq").mapInArrow(_walker(level), POINT), "trie-points")
    sums = [F.sum(c).alias(c) for c in ("n", "leaves", "saved", "children")]
    firsts = [F.first(c).alias(c) for c in ("parent", "depth", "above", "rest")]
    merged = found.where("edge").groupBy("id").agg(*sums, *firsts, F.min("lead").alias("lead"))
    columns = ["id", "parent", "depth", "above", "n", "lead", "leaves", "saved", "children", "rest"]
    return found.where("not edge").select(columns).unionByName(merged.select(columns))


# ---------------------------------------------------------------- digests of ends


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one key in sorted rows (key, id), as comma-joined texts of at most about ``PIECE`` bytes."""
    key, first, parts, size, out = None, None, [], 0, []

    def taken() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["key", "first", "ids"])
        out.clear()
        return rows

    waiting = 0
    for batch in batches:
        for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if parts and (k != key or size >= PIECE):
                out.append((key, first, ",".join(parts)))
                waiting, parts, size = waiting + size, [], 0
                if waiting >= PIECE:
                    yield taken()
                    waiting = 0
            if not parts:
                key, first = k, i
            parts.append(str(i))
            size += len(parts[-1]) + 1
    if parts:
        out.append((key, first, ",".join(parts)))
    if out:
        yield taken()


def _joined_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each key, joined by commas."""
    key, state = None, None
    for batch in batches:
        out = []
        for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if state is None or k != key:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["id", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([state.hexdigest()], pa.string())], ["id", "ends_sha256"])


def id_digests(rows: DataFrame) -> DataFrame:
    """``(key, id)`` -> ``(id, ends_sha256)``: the digest of each key's decimal ids, ascending, joined by commas.

    Ids are joined in ranges of (key, id) first, so the task that digests a frequent key reads texts of up to
    a megabyte, one after the other.
    """
    pieces = rows.repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(_pieces, "key string, first long, ids string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_joined_digests, "id string, ends_sha256 string")


# ---------------------------------------------------------------- the whole trie


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` -> a row per node of the trie of rebuilt conversations.

    conv_id: the smallest member; depth; parent_conv_id; n_convs; n_children; n_leaves; saved_tokens: words
    that need not be read again in its subtree; ends_sha256. Rows without conv_id are left out, null roles
    and texts are empty, repeated rows are turns each. An empty table has no trie, not even a root.
    """
    turns = materialize(numbered_turns(conversations), "trie-numbered")
    rows, lengths = rebuilt(turns)
    live, levels, tails, level = lengths.withColumn("grp", F.lit("")), [], [], 0
    ends = None
    while True:  # one more round only where several conversations share a whole segment and go on
        segments = materialize(_segments(rows, live, level), "trie-segments")
        paths = materialize(_paths(segments), "trie-different")
        here = segments.where("not more").select("key", F.col("conv_id").alias("id"))
        ends = here if ends is None else ends.unionByName(here)
        levels.append(paths)
        if segments.where("more").isEmpty():
            break
        going = segments.where("more").select("conv_id", "n_turns", "key").join(paths.select("key", "n_more", F.col("lead").alias("top")), "key")
        tails.append((level, going.where("n_more = 1").select("conv_id", "n_turns", "top")))
        live = going.where("n_more > 1").select("conv_id", "n_turns", F.col("key").alias("grp"))
        level += 1
        if live.isEmpty():
            break
    below, found = None, []
    for level in range(len(levels) - 1, -1, -1):
        paths = levels[level].withColumn("alone", (F.col("n_more") == 1).cast("long"))
        if below is None:
            ready = paths.select("*", F.lit(0).cast("long").alias("saved"), F.col("alone").alias("leaves"), F.col("alone").alias("children"))
        else:
            sums = below.where(F.col("parent").isNull()).select(F.col("id").alias("key"), "saved", "leaves", "children")
            either = [F.coalesce(F.col(c), F.lit(0) if c == "saved" else F.col("alone")).alias(c) for c in ("saved", "leaves", "children")]
            ready = paths.join(sums, "key", "left").select(*[c for c in paths.columns], *either)
        below = _points(ready, level)
        found.append(below if level == 0 else below.where(F.col("parent").isNotNull()))
    points = found[0]
    for more in found[1:]:
        points = points.unionByName(more)
    points = materialize(points, "trie-merged")
    parents = points.select(F.col("id").alias("parent"), F.col("lead").alias("parent_lead"))
    whole = points.join(parents, "parent", "left").join(id_digests(ends), "id", "left")
    at = lambda name: F.col(f"v.{name}")
    nodes = whole.select("lead", "above", "parent_lead", "n", "leaves", "saved", "children", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends"), F.posexplode("rest").alias("i", "sum"), F.size("rest").alias("size"))
    last = F.col("i") == F.col("size") - 1
    out = nodes.select(
        F.col("lead").alias("conv_id"), (F.col("above") + 1 + F.col("i")).alias("depth"), F.when(F.col("i") == 0, F.col("parent_lead")).otherwise(F.col("lead")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(F.lit(1).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("n") - 1) * F.col("sum")).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
    for level, tail in tails:
        out = out.unionByName(_own_tail(rows, tail, level))
    discard(turns)
    return out.select(*NODE)


def _own_tail(rows: DataFrame, tail: DataFrame, level: int) -> DataFrame:
    """Nodes of turns that only one conversation has, beyond a segment: one member, one leaf, nothing saved."""
    low = (level + 1) * SEGMENT
    one, last = F.lit(1).cast("long"), F.col("place") == F.col("n_turns")
    return rows.where(F.col("place") > low).join(tail, "conv_id").select(
        "conv_id", F.col("place").alias("depth"), F.when(F.col("place") == low + 1, F.col("top")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        one.alias("n_convs"), F.when(last, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )


def oracle() -> str:
    """SQL for the nodes, with every prefix spelled out; for tables of short conversations without ties."""
    table = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    bits = f"list_reduce(list_prepend({{}}, range(8)), lambda x, i: {table})"
    start = "list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT))"
    crc = f"xor(list_reduce({start}, lambda a, b: {bits.format('xor(a, b)')}), 4294967295)"
    return rf"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p,
  md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS w FROM conversations),
ids AS (SELECT conv_id, ({crc}) % 4 AS h, conv_id - conv_id % {BLOCK} AS b, count(*) AS n FROM t GROUP BY conv_id),
given AS (SELECT i.conv_id, t.p, t.k, t.w FROM ids i JOIN t ON t.conv_id = i.b AND t.p <= i.h),
own AS (SELECT t.conv_id, t.p - i.h + (SELECT count(*) FROM given g WHERE g.conv_id = t.conv_id) AS p, t.k, t.w FROM t JOIN ids i USING (conv_id) WHERE t.p > i.h),
r AS (SELECT * FROM given UNION ALL SELECT * FROM own),
c AS (SELECT conv_id, coalesce(list(k ORDER BY p) FILTER (k IS NOT NULL), []) AS ks, coalesce(list(w ORDER BY p) FILTER (k IS NOT NULL), []) AS ws FROM (SELECT conv_id, p, k, w FROM ids LEFT JOIN r USING (conv_id)) GROUP BY conv_id),
m AS (SELECT conv_id, d, array_to_string(ks[1:d], '') AS x, CASE WHEN d > 0 THEN array_to_string(ks[1:d - 1], '') END AS up, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, len(ks) = d AS fin FROM c, unnest(range(len(ks) + 1)) u(d)),
nodes AS (SELECT x, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (fin), '')) AS ends FROM m GROUP BY x, d),
kids AS (SELECT a.x, a.d, count(b.x) AS kids FROM nodes a LEFT JOIN nodes b ON b.up = a.x AND b.d = a.d + 1 GROUP BY a.x, a.d),
every AS (SELECT *, kids = 0 AS leaf, (n - 1) * w AS s FROM nodes JOIN kids USING (x, d)),
under AS (SELECT x, d, sum(leaf::INT) AS leaves, sum(s) AS saved FROM (
  SELECT x[1:32 * u.d] AS x, u.d AS d, leaf, s FROM every, unnest(range(every.d + 1)) u(d)) GROUP BY x, d)
SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, a.n AS n_convs, a.kids AS n_children, u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, a.ends AS ends_sha256
FROM every a JOIN under u USING (x, d) LEFT JOIN nodes p ON p.x = a.up AND p.d = a.d - 1"""
