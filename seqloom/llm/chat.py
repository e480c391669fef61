"""Chat logs as events, folded into final messages and rendered as training text with a loss mask.

A log has a row per event: ``open`` begins a message with its role and first text, ``delta`` adds
text, ``edit`` and ``regenerate`` put new text in place of all that came before, ``drop`` takes the
message away until it is opened again. A message is named by its conversation, its ``turn`` (null
first) and, where a turn has several messages, by ``copy`` and ``row``; its events follow ``seq``.

The log is partitioned by conversation and sorted, so a task folds one message after the other and
holds no more than one message and one block of output. A conversation of very many events, or of
very much text, is cut into ranges of its messages instead, which are folded in tasks of their own.

The template marks a message as ``<|im_start|>role``, a line end, the text and ``<|im_end|>``. In
texts and roles one backslash goes after the first character of every control string, and of every
string that is a control string but for backslashes there; taking one away gives the text back, and
no control string remains that is not the template's.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import materialize

#: Code points of text in one event of a log that is made from finished turns.
CHUNK = 2048
#: Rows, and code points of text, above which a conversation is cut into ranges.
HOT_ROWS, HOT_CHARS = 1 << 16, 1 << 26
#: Code points after which a block of rendered text ends; a message is never cut.
BLOCK = 1 << 20

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common chat templates, cut after their first character.
CONTROL = r"(/?s>|/?SYS>>|/?INST\]|\|[a-z_]+\|>)"
_CONTROL = re.compile(r"([<\[])(\\*)" + CONTROL)
_ESCAPED = re.compile(r"([<\[])\\(\\*)" + CONTROL)
_LINE = re.compile(r"\\(.)", re.DOTALL)

KEY = ["conv_id", "turn", "copy", "row"]
EVENT = "conv_id long, turn long, copy long, row long, seq long, kind string, role string, text string"
BLOCKS = "conv_id long, turn long, copy long, row long, n_turns long, formatted string, loss array<struct<start:int,end:int>>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, tuple[int, int] | None]:
    """A message as text, and the span of it that the loss covers, which only an answer has."""
    head = START + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"
    body = escape(text)
    return head + body + END, (len(head), len(head) + len(body)) if role == "assistant" else None


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each message of rendered text."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError("text outside of messages")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        role = _LINE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(formatted[at + len(START) : line]))
        yield role, unescape(formatted[line + 1 : end])
        at = end + len(END)


# ---------------------------------------------------------------- logs from finished turns


def _events(role: str, text: str, mark: int) -> Iterator[tuple[int, int, str, str]]:
    """(stray, seq, kind, text) of the events that lead to a message; ``mark`` decides by which way."""
    first, draft = text[:CHUNK], text[: 16 + mark % 32][::-1]
    begin = "open"
    if mark % 4 == 0:
        yield 0, 0, "open", draft
        yield 0, 1, "delta", draft
        begin = "regenerate" if role == "assistant" else "edit"
    elif mark % 16 == 1:  # a message that was sent and taken back
        yield 1, 0, "open", draft
        yield 1, 1, "drop", ""
    yield 0, 2, begin, first
    for i, at in enumerate(range(CHUNK, len(text), CHUNK)):
        yield 0, 3 + i, "delta", text[at : at + CHUNK]


def _log(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in EVENT.split(", "))])

    def taken(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for batch in batches:
        ids, role_at, text_at = [batch.column(i).to_pylist() for i in range(4)], batch.column(4), batch.column(5)
        out, size = [[] for _ in schema], 0
        for i, (conv, turn, copy, row) in enumerate(zip(*ids, strict=True)):
            role, text = role_at[i].as_py() or "", text_at[i].as_py() or ""
            for stray, seq, kind, part in _events(role, text, copy & 0x7FFFFFFF):
                for column, value in zip(out, (conv, turn, copy, -1 - row if stray else row, seq, kind, role, part), strict=True):
                    column.append(value)
                size += len(part)
                if size > BLOCK or len(out[0]) >= 4096:
                    yield taken(out)
                    out, size = [[] for _ in schema], 0
        if out[0]:
            yield taken(out)


def event_log(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> the log of events that led to them, with drafts, edits and messages taken back.

    Null roles and texts are empty; long texts come in many deltas. Turns that tie are ordered by a
    hash of role and text; equal rows are messages each. Null ids are a conversation of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("copy"),
        F.monotonically_increasing_id().alias("row"), role.alias("role"), text.alias("text"),
    )
    return named.mapInArrow(_log, EVENT)


# ---------------------------------------------------------------- folding and rendering


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, turn, copy, row, role, text) of the messages that remain, from events sorted by key and seq."""
    key, role, parts = None, None, None
    for batch in batches:
        for *name, _, kind, by, text in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if name != key:
                if parts is not None:
                    yield *key, role, "".join(parts)
                key, role, parts = name, "", None
            text = text or ""
            if kind == "open":
                role, parts = by or "", [text]
            elif parts is None:
                continue  # events of a message that is not there
            elif kind in ("edit", "regenerate"):
                parts = [text]
            elif kind == "drop":
                parts = None
            else:
                parts.append(text)
    if parts is not None:
        yield *key, role, "".join(parts)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rendered text in order, each of one conversation."""
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    types = [pa.int64()] * 5 + [pa.string(), spans]
    names = [c.split()[0] for c in BLOCKS.split(", ")[:6]] + ["loss"]
    first, pieces, loss, size, rows = None, [], [], 0, []

    def taken() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        rows.clear()
        return out

    waiting = 0
    for *name, role, text in _messages(batches):
        if first is not None and (name[0] != first[0] or size >= BLOCK):
            rows.append((*first, len(pieces), "".join(pieces), loss))
            waiting += size
            first, pieces, loss, size = None, [], [], 0
            if waiting >= BLOCK or len(rows) >= 1024:
                yield taken()
                waiting = 0
        piece, span = render(role, text)
        if span:
            loss.append({"start": size + span[0], "end": size + span[1]})
        first, size = first or name, size + len(piece)
        pieces.append(piece)
    if first is not None:
        rows.append((*first, len(pieces), "".join(pieces), loss))
    if rows:
        yield taken()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the blocks of each conversation say, in order, read back from text and spans alone."""
    names = [c.split()[0] for c in DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    out: list[tuple] = []
    conv, n, whole, loss, chars, total = None, 0, None, None, 0, 0

    def close():
        out.append((conv, n, whole.hexdigest(), chars, loss.hexdigest(), total))

    def taken() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        out.clear()
        return rows

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for i, id_ in enumerate(ids):
            if whole is None or id_ != conv:
                if whole is not None:
                    close()
                conv, n, whole, loss, chars, total = id_, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
            formatted = batch.column(5)[i].as_py()
            for role, text in parse(formatted):
                n += 1
                whole.update(f"{role}\n{text}\n".encode())
            for span in batch.column(6)[i].as_py():
                masked = unescape(formatted[span["start"] : span["end"]])
                chars += len(masked)
                loss.update(masked.encode())
            total += len(formatted)
        if out:
            yield taken()
    if whole is not None:
        close()
    if out:
        yield taken()


def hot_conversations(turns: DataFrame, rows: int = HOT_ROWS, chars: int = HOT_CHARS) -> DataFrame:
    """A scratch table of the conversations that are cut into ranges: at most one for every ``rows`` rows or ``chars`` code points."""
    sizes = turns.groupBy(F.col("conv_id").cast("long").alias("hot")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    return materialize(sizes.where((F.col("n") > rows) | (F.coalesce("chars", F.lit(0)) > chars)).select("hot"), "chat-hot")


def _parts(events: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Blocks of the ordinary conversations, each in one task and in order; and those of the hot ones, in any place."""
    order = [*KEY, "seq", "kind"]
    if hot.isEmpty():
        cold, cut = events, None
    else:
        # as many rows as ranges of HOT_ROWS rows or HOT_CHARS code points fit into the log, so small enough to broadcast
        marked, is_hot = F.broadcast(hot), F.col("conv_id").eqNullSafe(F.col("hot"))
        cold, many = events.join(marked, is_hot, "left_anti"), events.join(marked, is_hot, "left_semi")
        cut = many.repartitionByRange(*KEY).sortWithinPartitions(*order).mapInArrow(_blocks, BLOCKS)
    return cold.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_blocks, BLOCKS), cut


def transcripts(events: DataFrame, hot: DataFrame) -> DataFrame:
    """A log -> rendered conversations in blocks: ``(conv_id, turn, copy, row, n_turns, formatted, loss)``.

    The text of a conversation is that of its blocks, ordered by turn, copy and row, which are those
    of a block's first message; ``loss`` has the spans of its answers as [start, end) in code points of
    the block. ``hot`` is a table of :func:`hot_conversations`. An event of null kind is a delta, null
    roles and texts are empty, null turns and sequence numbers come first, events that tie are taken in
    the order of their kinds. An empty log gives an empty result.
    """
    cold, cut = _parts(events.select(*[c.split()[0] for c in EVENT.split(", ")]), hot)
    return cold if cut is None else cold.unionByName(cut)


def digests(events: DataFrame, hot: DataFrame) -> DataFrame:
    """A row per conversation of a log: counts and SHA-256 digests of its turns and of all text under the loss mask.

    They are worked out from the rendered blocks alone. A digest reads a conversation from its
    beginning to its end, one block after the other, so a hot conversation's blocks meet in one task,
    which holds one of them at a time.
    """
    cold, cut = _parts(events.select(*[c.split()[0] for c in EVENT.split(", ")]), hot)
    out = cold.mapInArrow(_digests, DIGEST)
    if cut is not None:
        out = out.unionByName(cut.repartition("conv_id").sortWithinPartitions(*KEY).mapInArrow(_digests, DIGEST))
    return out


#: The conversation that shows that control strings in texts do no harm.
CONTROLS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def with_controls(conversations: DataFrame) -> DataFrame:
    """Turns with the conversation of control strings beside them."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    )
    return turns.unionByName(turns.sparkSession.createDataFrame(CONTROLS, "conv_id long, turn long, role string, text string"))


def oracle() -> str:
    """SQL for the digests of ``conversations``; turns must not tie."""
    escaped = r"regexp_replace({x}, '([<\[])(\\*)" + CONTROL + r"', '\1\\\2\3', 'g')"
    head = escaped.format(x=r"replace(replace(role, '\', '\\'), chr(10), '\n')")
    listed = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in CONTROLS)
    return f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT * FROM (VALUES {listed}) v(conv_id, turn, role, text)),
made AS (SELECT *, {len(START) + len(END) + 1} + length({head}) + length({escaped.format(x='text')}) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum(chars)::BIGINT AS formatted_chars FROM made GROUP BY conv_id"""
