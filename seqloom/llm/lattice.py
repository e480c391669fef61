"""Near-duplicate embeddings by E8 lattice hashing.

Unit vectors are projected at random to groups of eight dimensions (blocks), in several independent
tables, and each group is decoded to the nearest point of the E8 lattice. A vector is filed under
the lattice cell it falls into and also asks in the ``PROBES`` neighbouring cells, over all blocks,
that are nearest to its projection. Whoever is filed where another one is filed or asks is a
candidate; cosines are then computed in double precision inside the task, block by block.

How large cells are and how many tables are searched (``LEVELS``) goes by the table: every level
has the same recall, finer ones move each vector more often and compare fewer pairs. How often
pairs meet at each level is counted on a bounded sample of the table's own vectors (``SAMPLE``), whose
directions may have much in common, and the level that costs least for all of them is taken.

A pair may meet in several cells, and counts at the first. Which cells two vectors have in common
follows from the vectors, so a task works out the codes of those that it has found a link of, and
only vectors travel. So no pair becomes a row: a task sums up the links of each of its vectors and
passes on a spanning forest of the links, from which the components are made.

Equal vectors are grouped first. A cell in which more vectors are filed than a task holds at once
(``HELD_BYTES``) is cut into parts by hash: a part holds its own vectors and sees those of the parts
after it, and the asking ones, go by in batches. Every pair of a cell still meets once. There is no
limit on candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.common import discard, materialize
from seqloom.llm.components import connected_components

PROBES = 1
COSINE = 0.9
#: Blocks, width of a cell in units of the projections of unit vectors, tables. Measured in simulation, for pairs
#: of cosine 0.901, 0.92 and 0.95, recall is 0.97, 0.99 and 0.995 or more at each level, and 11 %, 4 %, 1.7 %,
#: 0.16 %, 0.016 % and less than 0.001 % of pairs of unrelated directions meet.
LEVELS = ((1, 2.2, 5), (1, 1.8, 7), (1, 1.5, 11), (2, 2.0, 21), (2, 1.6, 46), (3, 1.8, 124))
#: Different vectors whose meetings are counted to choose a level; fewer are searched at the first one.
SAMPLE = 1000
#: Comparisons that take as long as moving one vector once.
MOVE = 2000
#: Bytes of unit vectors filed in one cell that a task holds together; larger cells are cut.
HELD_BYTES = 32 << 20
#: Rows of a table of cut cells (16 bytes each) that may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows that go by between two comparisons with the held ones, and sides of the blocks compared.
PASSING = 8192
#: Rows of one product of vectors and projections.
ROWS = 64
SIDES = (512, 2048)
#: Links found before they are counted.
FOUND = 1 << 16


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a in (1.0, -1.0):
            for b in (1.0, -1.0):
                v = np.zeros(8)
                v[i], v[j] = a, b
                out.append(v)
    signs = 0.5 - (np.arange(256)[:, None] >> np.arange(8) & 1)
    return np.concatenate([np.array(out), signs[(signs < 0).sum(axis=1) % 2 == 0]])


NEIGHBOURS = _minimal_vectors()


def _decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer point with even coordinate sum: the worst coordinate goes the other way if need be."""
    out = np.rint(x)
    off = x - out
    rows = np.flatnonzero(out.sum(axis=1) % 2 != 0)
    worst = np.abs(off[rows]).argmax(axis=1)
    out[rows, worst] += np.where(off[rows, worst] >= 0, 1, -1)
    return out


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: E8 is D8 and D8 moved by one half in every coordinate."""
    whole, half = _decode_d8(x), _decode_d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by a power of two first, so that no square overflows or vanishes."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def level(number: int) -> dict:
    """A level as options: blocks, scale and tables."""
    return dict(zip(("blocks", "scale", "tables"), LEVELS[number], strict=True))


class Hasher:
    """Cells and probes of unit vectors of one dimension; the same for the same seed everywhere."""

    def __init__(self, dim: int, tables: int, blocks: int, scale: float, probes: int = PROBES, seed: int = 41):
        rng = np.random.default_rng([seed, dim])
        self.dim, self.tables, self.blocks, self.probes = dim, tables, blocks, probes
        self.project = rng.normal(0, 1 / scale, (tables, blocks, dim, 8))
        self.factor = rng.integers(1, 1 << 62, (tables, blocks, 8)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.start = rng.integers(1, 1 << 62, tables).astype(np.uint64)
        # what a step to each lattice neighbour of each block adds to a cell's number
        self.steps = np.stack([np.concatenate([self._number(NEIGHBOURS, t, b) for b in range(blocks)]) for t in range(tables)])

    def _number(self, points: np.ndarray, table: int, block: int) -> np.ndarray:
        doubled = np.rint(2 * points).astype(np.int64).view(np.uint64)
        return (doubled * self.factor[table, block]).sum(axis=1, dtype=np.uint64)

    def _projected(self, unit: np.ndarray, table: int, block: int) -> np.ndarray:
        """Products of always the same shape, so that a vector's are the same to the bit whatever rows are beside it."""
        padded = np.zeros((-(-len(unit) // ROWS), ROWS, self.dim))
        padded.reshape(-1, self.dim)[: len(unit)] = unit
        return (padded @ self.project[table, block]).reshape(-1, 8)[: len(unit)]

    def codes(self, unit: np.ndarray, asking: bool = True) -> np.ndarray:
        """Codes of 32 bits of the own cell and those asked in: rows x tables x (1 + probes). Cells of one code are one cell."""
        out = np.zeros((len(unit), self.tables, 1 + self.probes if asking else 1), np.uint64)
        for t in range(self.tables):
            out[:, t] = self.start[t]
            closeness = []
            for b in range(self.blocks):
                x = self._projected(unit, t, b)
                point = decode_e8(x)
                out[:, t] += self._number(point, t, b)[:, None]
                closeness.append((x - point) @ NEIGHBOURS.T if asking else None)
            if asking:
                near = np.argpartition(-np.concatenate(closeness, axis=1), self.probes, axis=1)[:, : self.probes]
                out[:, t, 1:] += self.steps[t][near]
        codes = (_mixed(out ^ np.uint64(self.dim << 32)) >> np.uint64(32)).astype(np.uint32)
        codes[:, :, 1:] ^= codes[:, :, 1:] == codes[:, :, :1]  # nobody asks where it is filed
        return codes

    @staticmethod
    def keys(codes: np.ndarray, table: int) -> np.ndarray:
        """Shuffle keys of cells; the last eight bits name the table, so that tables never share one."""
        return codes.astype(np.int64) << 8 | table


def _by_length(batch: pa.RecordBatch, column: str, kind: str, options: dict, hashers: dict) -> Iterator[tuple]:
    """(rows, unit vectors, hasher) for each length of vectors in a batch."""
    size = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for width in np.unique(size):
        part = batch.filter(pa.array(size == width))
        x = np.frombuffer(b"".join(part.column(column).to_pylist()), kind).astype(float).reshape(part.num_rows, -1)
        if x.shape[1] not in hashers:
            hashers[x.shape[1]] = Hasher(x.shape[1], **options)
        yield part, unit_rows(x), hashers[x.shape[1]]


def _filed(kind: str, options: dict):
    """(rep, members, vec) -> rows (key, asks, rep, members, vec) for every table and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}
        for batch in batches:
            for part, unit, hasher in _by_length(batch, "vec", kind, options, hashers):
                codes = hasher.codes(unit)
                n, _, m = codes.shape
                at = pa.array(np.repeat(np.arange(n), m))
                for t in range(hasher.tables):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(hasher.keys(codes[:, t], t).ravel()), pa.array(np.tile((np.arange(m) > 0).astype(np.int32), n)),
                            part.column("rep").take(at), part.column("members").take(at), part.column("vec").take(at),
                        ],
                        ["key", "asks", "rep", "members", "vec"],
                    )

    return run


def _own_cells(kind: str, options: dict):
    """(vec) -> the key of the own cell in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}
        for batch in batches:
            for _, unit, hasher in _by_length(batch, "vec", kind, options, hashers):
                codes = hasher.codes(unit, asking=False)[:, :, 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([hasher.keys(codes[:, t], t) for t in range(hasher.tables)]))], ["key"])

    return run


def _spread(filed: DataFrame, owned: DataFrame, cell: int) -> DataFrame:
    """``filed`` with ``chunk`` and ``role``: (key, chunk) is what a task compares, role 0 what it holds.

    A cell of at most ``cell`` filed vectors is one chunk. In a larger one a filed vector is held in the
    chunk that its hash names and goes by in the chunks before it; an asking one goes by in all.
    """
    crowded = owned.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell)
    crowded = materialize(crowded.select("key", F.ceil(F.col("n") / cell).cast("int").alias("chunks")), "lattice-crowded")
    n = crowded.count()
    if not n:
        return filed.withColumn("chunk", F.lit(0)).withColumn("role", F.col("asks"))
    sized = filed.join(F.broadcast(crowded) if n <= BROADCAST_ROWS else crowded, "key", "left")
    chunks = F.coalesce("chunks", F.lit(1))
    home = F.pmod(F.xxhash64(F.lit(3), "rep"), chunks).cast("int")
    return (
        sized.withColumn("home", home)
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.when(F.col("asks") == 0, F.col("home")).otherwise(chunks - 1))))
        .withColumn("role", F.when((F.col("asks") == 0) & (F.col("chunk") == F.col("home")), 0).otherwise(1))
        .drop("chunks", "home")
    )


class _Links:
    """Counts the links of rows that lie in cells, and keeps a forest of them.

    ``table`` is the table of each row's cell. Codes are worked out when a row's first link is found.
    """

    def __init__(self, hasher: Hasher, table: np.ndarray, rep: np.ndarray, members: np.ndarray, unit: np.ndarray):
        self.hasher, self.table, self.rep, self.members, self.unit = hasher, table, rep, members, unit
        self.codes = np.zeros((len(rep), hasher.tables, 1 + hasher.probes), np.uint32)
        self.known = np.zeros(len(rep), bool)
        self.linked = np.zeros(len(rep), np.int64)
        self.label = np.arange(len(rep))
        self.forest: list[np.ndarray] = []
        self.found: list[np.ndarray] = []
        self.waiting = 0

    def _counted_here(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of linked pairs, i being filed here, those that meet here first: see the module's text."""
        rows = np.unique(np.r_[i, j])
        rows = rows[~self.known[rows]]
        for k in range(0, len(rows), PASSING):
            part = rows[k : k + PASSING]
            self.codes[part] = self.hasher.codes(self.unit[part])
        self.known[rows] = True
        a, b, table = self.codes[i], self.codes[j], self.table[i]
        same = a[:, :, 0] == b[:, :, 0]
        j_asks = (b[:, :, 1:] == a[:, :, :1]).any(axis=2)
        i_asks = (a[:, :, 1:] == b[:, :, :1]).any(axis=2)
        earlier = ((same | j_asks | i_asks) & (np.arange(same.shape[1]) < table[:, None])).any(axis=1)
        # in one table two vectors that ask for each other meet twice: where the smaller rep is filed counts
        at = np.arange(len(i)), table
        return ~earlier & ~(~same[at] & i_asks[at] & (self.rep[i] > self.rep[j]))

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Link i[k] and j[k]; pairs that join different labels become edges of the forest."""
        while True:
            a, b = self.label[i], self.label[j]
            new = a != b
            if not new.any():
                return
            i, j = i[new], j[new]
            high, low = np.maximum(a, b)[new], np.minimum(a, b)[new]
            roots, at = np.unique(high, return_index=True)
            self.forest.append(np.stack([i[at], j[at]]))
            self.label[roots] = low[at]
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up

    def flush(self) -> None:
        """Count the links found so far."""
        if self.waiting:
            i, j = np.concatenate(self.found, axis=1)
            self.found, self.waiting = [], 0
            fit = self._counted_here(i, j)
            i, j = i[fit], j[fit]
            np.add.at(self.linked, i, self.members[j])
            np.add.at(self.linked, j, self.members[i])
            self._join(i, j)

    def compare(self, cosine: float, start: int, stop: int, held: int, inner: bool) -> None:
        """The first ``held`` rows from ``start`` with the rest up to ``stop`` and, if ``inner``, with each other."""
        rows, columns = SIDES
        for at in range(start, start + held, rows):
            end = min(at + rows, start + held)
            for to in range(at if inner else start + held, stop, columns):
                near_i, near_j = np.nonzero(self.unit[at:end] @ self.unit[to : min(to + columns, stop)].T >= cosine)
                for k in range(0, len(near_i), FOUND):
                    i, j = near_i[k : k + FOUND] + at, near_j[k : k + FOUND] + to
                    fit = (j > i) & (self.rep[i] != self.rep[j])
                    self.found.append(np.stack([i[fit], j[fit]]))
                    self.waiting += int(fit.sum())
                    if self.waiting >= FOUND:
                        self.flush()

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Rows (a, b, 0), a link of the forest, and (a, null, n), n links of a counted here."""
        self.flush()
        names = ["a", "b", "linked"]
        if self.forest:
            i, j = np.concatenate(self.forest, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(self.rep[i]), pa.array(self.rep[j]), pa.array(np.zeros(len(i), np.int64))], names)
            some = np.flatnonzero(self.linked)
            yield pa.RecordBatch.from_arrays([pa.array(self.rep[some]), pa.nulls(len(some), pa.int64()), pa.array(self.linked[some])], names)


def _verified(kind: str, cosine: float, options: dict, passing: int = PASSING):
    """Rows sorted by (key, chunk, role) -> rows of :meth:`_Links.rows`."""

    def met(table: pa.Table, hashers: dict, memory: dict, done: bool) -> Iterator[pa.RecordBatch]:
        """Whole runs of (key, chunk); ``done``: the held ones of the first run have been compared with each other.

        ``memory`` has, for each length of vectors, the codes of the held ones of the run that was last.
        """
        if not table.num_rows:
            return
        batch = table.combine_chunks().to_batches()[0]
        opened = batch.column("key")[0].as_py(), batch.column("chunk")[0].as_py()
        for part, unit, hasher in _by_length(batch, "vec", kind, options, hashers):
            key, chunk, role, rep, members = (part.column(c).to_numpy() for c in ("key", "chunk", "role", "rep", "members"))
            links = _Links(hasher, key & 255, rep, members, unit)
            starts = _starts(key, chunk).tolist()
            for s, e in zip(starts, [*starts[1:], len(key)], strict=True):
                run, held = (int(key[s]), int(chunk[s])), int((role[s:e] == 0).sum())
                if s == 0 and run == memory.get(hasher.dim, [None])[0]:
                    links.known[:held], links.codes[:held] = memory[hasher.dim][1:]
                links.compare(cosine, s, e, held, not (done and run == opened))
            yield from links.rows()
            memory[hasher.dim] = run, links.known[s : s + held].copy(), links.codes[s : s + held].copy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}
        memory: dict[int, tuple] = {}
        rest: list[pa.RecordBatch] = []  # rows of the run that may go on
        done = False  # they are held ones, compared with each other
        for batch in _with_end(batches):
            parts = [b for b in (*rest, batch) if b is not None and b.num_rows]
            if not parts:
                continue
            table = pa.Table.from_batches(parts)
            key, chunk, role = (table.column(c).to_numpy() for c in ("key", "chunk", "role"))
            starts = _starts(key, chunk)
            lengths = np.diff(np.r_[starts, len(key)])
            last = len(starts) if batch is None else len(starts) - 1
            meets = (np.arange(len(starts)) < last) & (lengths > 1) & (role[starts] == 0)  # someone is held, and not alone
            goes_on = done and bool(meets[0])
            yield from met(table.filter(pa.array(np.repeat(meets, lengths))), hashers, memory, goes_on)
            if last == len(starts):
                break
            tail = table.slice(starts[last])
            done = done and last == 0
            if lengths[last] - (n := int((role[starts[last] :] == 0).sum())) > passing:
                if n:
                    yield from met(tail, hashers, memory, done)
                tail, done = tail.slice(0, n), n > 0
            rest = tail.to_batches()

    return run


def _starts(key: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])])


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def meetings(unit: np.ndarray, hasher: Hasher) -> int:
    """How often two of the vectors meet in a cell, over all tables."""
    codes, n = hasher.codes(unit), 0
    for t in range(hasher.tables):
        own, filed = np.unique(codes[:, t, 0], return_counts=True)
        asked = codes[:, t, 1:].ravel()
        at = np.searchsorted(own, asked).clip(max=len(own) - 1)
        n += int((filed * (filed - 1) // 2).sum() + filed[at][own[at] == asked].sum())
    return n


def choose(classes: DataFrame, n: int, kind: str) -> dict:
    """The level that costs ``n`` different vectors least: each travels once a cell, and meets as many others as a sample's vectors do.

    The sample is the ``SAMPLE`` vectors whose hashes are smallest; only they reach the driver.
    """
    if n <= SAMPLE:
        return level(0)
    rows = classes.select("vec").orderBy(F.xxhash64(F.lit(9), "vec"), "vec").limit(SAMPLE).collect()
    by_length: dict[int, list] = {}
    for row in rows:
        by_length.setdefault(len(row["vec"]), []).append(np.frombuffer(row["vec"], kind).astype(float))
    costs = []
    for i in range(len(LEVELS)):
        met = sum(meetings(unit_rows(np.stack(x)), Hasher(len(x[0]), **level(i))) for x in by_length.values())
        costs.append(n * (1 + PROBES) * level(i)["tables"] * MOVE + met * (n / len(rows)) ** 2)
    return level(int(np.argmin(costs)))


def links(classes: DataFrame, kind: str = "<f4", cosine: float = COSINE, cell: int | None = None, passing: int = PASSING, **options) -> DataFrame:
    """``classes(rep, members, vec)`` of different vectors -> rows ``(a, b, linked)``.

    vec holds numbers of the numpy ``kind``. Rows with b are links of cosine >= ``cosine`` that connect
    what all such links connect; rows without b add ``linked`` to the number of a's links, each
    link counting the members of its other end. ``cell``: vectors that a task holds of one cell;
    ``options``: blocks, scale and tables in place of those of :func:`choose`.
    """
    found = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("vec")).alias("bytes")).first()
    if not {"blocks", "scale", "tables"} <= options.keys():
        options = choose(classes, found["n"], kind) | options
    cell = cell or max(1, HELD_BYTES // (8 * (found["bytes"] or 8) // np.dtype(kind).itemsize))
    filed = classes.select("rep", "members", "vec").mapInArrow(
        _filed(kind, options), "key long, asks int, rep long, members long, vec binary"
    )
    owned = classes.select("vec").mapInArrow(_own_cells(kind, options), "key long")
    return (
        _spread(filed, owned, cell)
        .drop("asks")
        .repartition("key", "chunk")
        .sortWithinPartitions("key", "chunk", "role")
        .mapInArrow(_verified(kind, cosine, options, passing), "a long, b long, linked long")
    )


def _bytes(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(vec_id, embedding) -> (vec_id, vec): the numbers' bytes, null where the vector cannot be compared."""
        for batch in batches:
            column = batch.column(1)
            flat = pc.list_flatten(column)
            values = np.nan_to_num(flat.to_numpy(zero_copy_only=False).astype(float), nan=np.inf, posinf=np.inf, neginf=-np.inf)  # nulls are NaN here
            lengths = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            ends = np.cumsum(lengths)
            out = []
            for s, e in zip(ends - lengths, ends, strict=True):
                v = values[s:e]
                out.append((v + 0.0).astype(kind).tobytes() if e > s and np.isfinite(v).all() and v.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "vec"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, **options) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> ``(vec_id, n_links, component_id, kept)``, a row per input row.

    n_links: other vectors (rows) linked directly, equal ones included. component_id: the smallest
    vec_id reachable. Null, empty and zero vectors and those with null or non-finite components
    link with nothing; vectors of different lengths do not link. Rows that repeat a vec_id count
    as vectors of their own. A row with null vec_id keeps a null component_id only if all its
    component's ids are null. An empty table gives an empty result.
    """
    single = vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull)
    kind, held = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(held).alias("embedding"))
    rows = materialize(plain.mapInArrow(_bytes(kind), "vec_id long, vec binary"), "lattice-rows")
    classes = materialize(
        rows.where("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("smallest"), F.count(F.lit(1)).alias("members"))
        # numbered as they are written, once: no two classes share a number
        .withColumn("rep", F.monotonically_increasing_id()),
        "lattice-classes",
    )
    found = materialize(links(classes, kind, cosine, **options), "lattice-links")  # ids of links are class numbers
    direct = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("linked").alias("linked"))
    roots = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    named = materialize(
        classes.join(direct, "rep", "left").join(roots, "rep", "left").select(
            "vec", "smallest", (F.col("members") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root")
        ),
        "lattice-named",
    )
    discard(classes, found)
    smallest = named.groupBy("root").agg(F.min("smallest").alias("component_id"))
    answers = named.join(smallest, "root").select("vec", "n_links", "component_id")
    linked = rows.where("vec is not null").join(answers, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def oracle(cosine: float = COSINE) -> str:
    """All pairs compared and links followed, as DuckDB SQL; for small tables."""
    return f"""
WITH RECURSIVE numbered AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
sound AS (SELECT * FROM numbered WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(v, lambda x: x * x)) > 0),
links AS (
  SELECT a.r AS a, b.r AS b FROM sound a JOIN sound b ON a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))
    / sqrt(list_sum(list_transform(a.v, lambda x: x * x)) * list_sum(list_transform(b.v, lambda x: x * x))) >= {cosine}),
reach AS (SELECT r AS a, r AS b FROM numbered UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
components AS (SELECT reach.a AS r, min(n.vec_id) AS component_id FROM reach JOIN numbered n ON reach.b = n.r GROUP BY reach.a),
degrees AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM numbered JOIN components USING (r) LEFT JOIN degrees USING (r)"""
