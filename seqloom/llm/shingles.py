"""Links of texts by the Jaccard similarity of their word shingles: SimHash classes and MinHash bands propose, the sets decide.

A text's set holds the hashes of its word shingles. Texts whose SimHash fingerprints are linked within three
bits share a bucket (:mod:`simhash` makes these classes). A similarity of 0.8 is mostly farther apart in bits, so
bands propose the rest: texts that agree in a band of ``ROWS`` minima share a bucket; with ``BANDS`` bands a pair of similarity 0.8 misses all buckets with probability
7e-5, one of 0.9 practically never. Equal sets count once, and of buckets with the same members one
is looked at. Members meet inside a task with their whole sets, every link is verified on them,
and only a spanning forest of the links leaves the task.

For verification a set travels as 40 bits of each hash, five bytes a shingle: two different shingles of
one pair of texts of 20,000 words fall together with a probability below 0.001, and then change
the similarity by 0.00005. Only sets with a candidate travel at all.

A bucket that is too large for a task is a crowd. First its members are compared with one of them, its hub;
crowds that share most members mostly share the hub too, so a set travels to few. Members that are
linked to the hub need no links to each other. The others stay in parts of their own and go by all parts
before, those of the linked members first, so that every two members meet that need to. A crowd without
others takes no further part.

A set is named by 128 bits of its hashes, by which equal sets are found and numbered; at 10^11 different sets
two share a name with a probability below 10^-16. Links, buckets and components are in numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import discard, map_texts, materialize

WIDTH = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 5
#: About the most sets, and the most shingles of all of them, that stay in a task at once.
BUCKET = 2048
SHINGLES = 1 << 22
#: Sets with a candidate whose names and numbers (40 bytes each) are broadcast to pick them out; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FACTORS, _SHIFTS = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64)
_FACTORS |= np.uint64(1)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted different XXH64 hashes (seed 42) of the word shingles; the whole text if it is shorter than one."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = zip(*(words[i:] for i in range(min(width, len(words)))), strict=False)
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts], dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of shingle hashes: a bit is set if it is in over half of them; zero for none."""
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        block = hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def set_name(shingles: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(shingles.tobytes(), 42) if len(shingles) else "0" * 32


def bands(shingles: np.ndarray) -> list[int]:
    """A hash of each band of minima; none for an empty set."""
    if not len(shingles):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1 << 12):
        least = np.minimum(least, (shingles[at : at + (1 << 12)] * _FACTORS + _SHIFTS).min(axis=1))
    return [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))]


def packed(shingles: np.ndarray) -> bytes:
    """The upper 40 bits of sorted hashes, each once, five bytes each."""
    short = np.unique(shingles >> np.uint64(24))
    return short.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return np.concatenate([np.zeros((len(raw), 3), np.uint8), raw], axis=1).view(">u8").ravel().astype(np.uint64)


def _lists(values: list) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)])
    flat = np.concatenate([np.zeros(0, np.uint64), *(np.array(v, dtype=np.uint64) for v in values)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


def name_arrays(width: int = WIDTH):
    return lambda texts: [pa.array([set_name(shingle_set(t, width)) for t in texts], pa.string())]


def _band_arrays(width: int):
    def arrays(texts: list[str | None]) -> list[pa.Array]:
        sets = [shingle_set(t, width) for t in texts]
        return [pa.array([set_name(s) for s in sets], pa.string()), pa.array([len(s) for s in sets], pa.int64()), _lists([bands(s) for s in sets]), pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64), pa.int64())]

    return arrays


def _set_arrays(width: int):
    def arrays(texts: list[str | None]) -> list[pa.Array]:
        sets = [shingle_set(t, width) for t in texts]
        return [pa.array([set_name(s) for s in sets], pa.string()), pa.array([packed(s) for s in sets], pa.binary())]

    return arrays


class _Sets:
    """Sets side by side in one array, to be compared with one set at a time."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.flat = np.concatenate(sets)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def near(self, one: np.ndarray, similarity: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(one, self.flat), len(one) - 1)
        common = np.add.reduceat((one[at] == self.flat).astype(np.int64), self.starts)
        return common / (self.sizes + len(one) - common) >= similarity


def _forest(sets: list[np.ndarray], similarity: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the links among ``sets``, and each set's tree."""
    links, tree, rest = [], np.arange(len(sets)), np.arange(len(sets))
    while len(rest) > 1:
        first, rest = rest[0], rest[1:]
        queue = [first]
        packed = _Sets([sets[i] for i in rest])
        while queue and len(rest):
            x = queue.pop()
            near = packed.near(sets[x], similarity)
            if near.any():
                links += [(x, y) for y in rest[near]]
                tree[rest[near]] = first
                queue.extend(rest[near])
                rest = rest[~near]
                packed = _Sets([sets[i] for i in rest]) if len(rest) else None
    return links, tree


def _search(similarity: float):
    """mapInArrow function over rows (band, part, passes, fp, shingles) sorted by the first four.

    The rows of a part that stay come before those that pass; yields verified links (a, b).
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, names, sets, packed, tree = None, [], [], None, None
        out: list[tuple[int, int]] = []

        def settle():
            nonlocal packed, tree
            if packed is None and sets:
                links, tree = _forest(sets, similarity)
                out.extend((names[x], names[y]) for x, y in links)
                packed = _Sets(sets)

        def taken():
            rows = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
            out.clear()
            return rows

        for batch in batches:
            band, part, passes, fp = (batch.column(i).to_pylist() for i in range(4))
            column = batch.column(4)
            for i in range(batch.num_rows):
                own = unpacked(column[i].as_py())
                if group != (band[i], part[i]):
                    settle()
                    group, names, sets, packed, tree = (band[i], part[i]), [], [], None, None
                if not passes[i]:
                    names.append(fp[i])
                    sets.append(own)
                elif sets:
                    settle()
                    near = np.flatnonzero(packed.near(own, similarity))
                    out.extend((names[near[j]], fp[i]) for j in np.unique(tree[near], return_index=True)[1])
            if out:
                yield taken()
        settle()
        if out:
            yield taken()

    return search


def _with_hub(similarity: float):
    """mapInArrow function over rows (hub, part, member, fp, shingles) sorted by the first three; yields members linked to their hub (a, b)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, None
        for batch in batches:
            hub, part, member, fp = (batch.column(i).to_pylist() for i in range(4))
            column, out = batch.column(4), []
            for i in range(batch.num_rows):
                one = unpacked(column[i].as_py())
                if not member[i]:
                    group, own = (hub[i], part[i]), one
                elif group == (hub[i], part[i]) and _Sets([one]).near(own, similarity)[0]:
                    out.append((hub[i], fp[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return compare


def _hub_links(crowded: DataFrame, sets: DataFrame, similarity: float, bucket: int) -> DataFrame:
    """``crowded(band, fp, hub)`` -> verified links ``(a, b)`` of hubs with members; a hub's set goes to each ``bucket`` of its members."""
    pairs = crowded.where("fp <> hub").select("hub", "fp").distinct()
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / bucket).alias("parts"))
    part = F.pmod(F.xxhash64(F.lit(11), "fp"), F.col("parts"))
    members = pairs.join(sizes, "hub").select("hub", part.alias("part"), F.lit(True).alias("member"), "fp")
    hubs = sizes.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("member"), F.col("hub").alias("fp"))
    met = members.unionByName(hubs).join(sets, "fp").select("hub", "part", "member", "fp", "shingles")
    return met.repartition("hub", "part").sortWithinPartitions("hub", "part", "member").mapInArrow(_with_hub(similarity), "a long, b long")


def _visits(members: DataFrame, sets: DataFrame, similarity: float, bucket: int) -> tuple[DataFrame, DataFrame | None]:
    """Where members of buckets meet, ``(band, part, passes, fp)``, and the links with hubs, a scratch table if there are any crowds.

    ``members(band, parts, fp)``; a bucket of one part is no crowd.
    """
    plain = members.where("parts = 1").select("band", F.lit(0).cast("long").alias("part"), F.lit(False).alias("passes"), "fp")
    if members.where("parts > 1").isEmpty():
        return plain, None
    named = members.where("parts > 1").groupBy("band").agg(F.min_by("fp", F.struct(F.xxhash64(F.lit(5), "fp"), "fp")).alias("hub"))
    crowded = materialize(members.where("parts > 1").join(named, "band"), "shingle-crowds")
    linked = materialize(_hub_links(crowded, sets, similarity, bucket), "shingle-hubs")
    near = linked.select(F.col("a").alias("hub"), F.col("b").alias("fp"), F.lit(True).alias("near"))
    told = crowded.join(near, ["hub", "fp"], "left").withColumn("near", F.coalesce("near", F.col("fp") == F.col("hub")))
    shares = told.groupBy("band").agg(F.count_if("near").alias("n_near"), F.count_if(~F.col("near")).alias("n_others")).where("n_others > 0")
    needed = lambda n: F.ceil(F.col("parts") * F.col(n) / (F.col("n_near") + F.col("n_others")))
    placed = told.join(shares, "band").withColumn("near_parts", needed("n_near"))
    mark = F.xxhash64(F.lit(7), "fp")
    home = F.when(F.col("near"), F.pmod(mark, F.col("near_parts"))).otherwise(F.col("near_parts") + F.pmod(mark, needed("n_others")))
    first = F.when(F.col("near"), F.col("home")).otherwise(F.lit(0).cast("long"))
    parts = placed.withColumn("home", home.cast("long")).select("band", "fp", "home", F.explode(F.sequence(first, F.col("home"))).alias("part"))
    return plain.unionByName(parts.select("band", "part", (F.col("part") < F.col("home")).alias("passes"), "fp")), linked


def links(docs: DataFrame, unique: DataFrame, width: int, similarity: float, bucket: int = BUCKET, classes: DataFrame | None = None) -> DataFrame:
    """``unique(fp, name, size, bands)`` of ``docs`` -> links ``(a, b)`` of different sets, each verified.

    ``classes(fp, size, band)``: buckets beside those of the bands.
    """
    rows = unique.select("fp", "size", F.explode("bands").alias("band"))
    if classes is not None:
        rows = rows.unionByName(classes)
    shared = rows.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.expr("bit_xor(xxhash64(fp))").alias("mark")
    )
    needed = F.greatest(F.ceil(F.col("n") / bucket), F.ceil(F.col("total") / SHINGLES))
    looked_at = shared.where("n > 1").groupBy("mark", "n", "total").agg(F.min("band").alias("band")).select("band", needed.alias("parts"))
    members = materialize(rows.join(looked_at, "band").select("band", "parts", "fp"), "shingle-members")
    wanted = materialize(members.select("fp").distinct().join(unique.select("fp", "name"), "fp"), "shingle-wanted")
    few = wanted.count() <= BROADCAST_ROWS
    sets = map_texts(docs.select("text"), [], _set_arrays(width), "name string, shingles binary").select("name", "shingles")
    sets = sets.join(F.broadcast(wanted) if few else wanted, "name")
    sets = materialize(sets.groupBy("fp").agg(F.first("shingles").alias("shingles")), "shingle-sets")
    visits, hubs = _visits(members, sets, similarity, bucket)
    met = visits.join(sets, "fp").select("band", "part", "passes", "fp", "shingles")
    found = met.repartition("band", "part").sortWithinPartitions("band", "part", "passes", "fp").mapInArrow(_search(similarity), "a long, b long")
    out = materialize(found if hubs is None else found.unionByName(hubs), "shingle-links")
    discard(members, wanted, sets, *([] if hubs is None else [hubs]))
    return out


def numbered(own: DataFrame) -> DataFrame:
    """``own(doc_id, name, size, bands, bits)`` -> a scratch table ``(fp, name, size, bands, bits)`` of the different sets, numbered."""
    different = own.groupBy("name").agg(F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    return materialize(different.select(F.monotonically_increasing_id().alias("fp"), "name", "size", "bands", "bits"), "shingle-unique")


def banded(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, name, size, bands, bits)``; name stands for the set, bits are its SimHash fingerprint."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_texts(named, ["doc_id"], _band_arrays(width), "name string, size long, bands array<long>, bits long").select("rec.doc_id", "name", "size", "bands", "bits")
