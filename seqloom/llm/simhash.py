"""SimHash near-duplicates found with deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Two fingerprints that differ in at most three bits
differ in at most one bit in one of the halves, so every half is indexed under its 32 variants
with one bit wiped out: whoever shares a variant is a candidate. An equality shuffle on the
variant brings candidates together, sorted, and numpy verifies them inside the task; no pair that
fails ever becomes a row.

A bucket that holds more than ``BUCKET`` different fingerprints is not compared pair by pair: its
members go on to a second level, where the other half is cut in two again (16 wiped variants
each), and then to a third (8 each). Members of a third-level bucket agree in 53 bits, so it can
hold at most 2**11 fingerprints. No pair is lost on the way: at each level the bits not yet fixed
differ in at most three places.

Rows with null text count as rows without words (fingerprint zero, linked to its like); rows with
null doc_id take part, but a component is named after its smallest non-null id. Repeated rows and
equal texts share a fingerprint and are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm import shingles
from seqloom.llm.common import discard, map_texts, materialize
from seqloom.llm.components import connected_components

#: Most fingerprints of a bucket that are compared inside one task.
BUCKET = 2048
#: Runs up to this length are compared by shifted arrays.
SHORT = 16
MAX_BITS = 3

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint of one text: majority of XXH64 (seed 42) bits over its word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= width:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return shingles.majority(np.array([xxhash.xxh64_intdigest(s, 42) for s in parts], dtype="<u8"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp)``; fp is the unsigned value's bits as a long."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_texts(named, ["doc_id"], _fp_arrays, "fp long").select("rec.doc_id", "fp")


def _fp_arrays(texts: list[str | None]) -> list[pa.Array]:
    return [pa.array(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64), pa.int64())]


def _first_meeting(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the variants that a pair shares at level one, whether ``key`` is the one that reports it."""
    x = a ^ b
    high, low = x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)
    variant = (key >> np.uint64(32)).astype(np.int64)
    own = np.where(variant < 32, high, low)
    bit = np.uint64(1) << (variant % 32).astype(np.uint64)
    meets = np.where(own == 0, variant % 32 == 0, own == bit)
    return meets & ((variant < 32) | (np.bitwise_count(high) > 1))


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the fingerprints of one bucket."""
    left, right = [], []
    rest = fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= MAX_BITS
            if near.any():
                found = rest[near]
                rest = rest[~near]
                left.append(np.full(len(found), x, np.uint64))
                right.append(found)
                queue.extend(found)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _links_of_runs(key: np.ndarray, sub: np.ndarray, fp: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among sorted rows, all runs of equal (key, sub) being whole and at most BUCKET long."""
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])])
    lengths = np.diff(np.r_[starts, len(key)])
    left, right = [], []
    for s, n in zip(starts[lengths > SHORT], lengths[lengths > SHORT], strict=True):
        a, b = _forest(fp[s : s + n])
        left.append(a)
        right.append(b)
    short = np.repeat((lengths > 1) & (lengths <= SHORT), lengths)
    run = np.repeat(np.arange(len(lengths)), lengths)[short]
    k, f = key[short], fp[short]
    for d in range(1, SHORT):
        same = np.flatnonzero(run[d:] == run[:-d])
        if not len(same):
            break
        a, b = f[same], f[same + d]
        near = np.bitwise_count(a ^ b) <= MAX_BITS
        a, b, k1 = a[near], b[near], k[same][near]
        if level == 1:
            first = _first_meeting(k1, a, b)
            a, b = a[first], b[first]
        left.append(a)
        right.append(b)
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _search(level: int, bucket: int = BUCKET):
    """mapInArrow function over rows (key, sub, fp) sorted by all three.

    Yields rows (a, b, sub, hot): a verified link a-b, or (hot) a member b of the overfull bucket a.
    """

    def rows(a, b, sub, hot):
        cols = [pa.array(x.astype(np.uint64).view(np.int64)) for x in (a, b, sub)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(a), hot))], ["a", "b", "sub", "hot"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, np.uint64)] * 3
        hot = None  # the overfull bucket whose members pass through
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3)]
            key, sub, fp = (np.concatenate(x) for x in zip(kept, new, strict=True))
            if not len(key):
                continue
            if hot is not None:
                n = int(((key == hot[0]) & (sub == hot[1])).sum())  # sorted: they come first
                if n:
                    yield rows(key[:n], fp[:n], sub[:n], True)
                if n == len(key):
                    kept = [np.zeros(0, np.uint64)] * 3
                    continue
                key, sub, fp, hot = key[n:], sub[n:], fp[n:], None
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1])])
            lengths = np.diff(np.r_[starts, len(key)])
            for s, n in zip(starts[lengths > bucket], lengths[lengths > bucket], strict=True):
                yield rows(key[s : s + n], fp[s : s + n], sub[s : s + n], True)
            if lengths[-1] > bucket:
                hot, whole = (key[-1], sub[-1]), len(key)
            else:
                whole = int(starts[-1])
            ok = np.repeat(lengths <= bucket, lengths)[:whole]
            a, b = _links_of_runs(key[:whole][ok], sub[:whole][ok], fp[:whole][ok], level) if ok.any() else (fp[:0], fp[:0])
            if len(a):
                yield rows(a, b, np.zeros(len(a), np.uint64), False)
            kept = [key[whole:], sub[whole:], fp[whole:]]
        if len(kept[0]):
            a, b = _links_of_runs(*kept, level)
            if len(a):
                yield rows(a, b, np.zeros(len(a), np.uint64), False)

    return search


def _wiped(value, width: int, position):
    """``value`` (``width`` bits) with the bit at ``position`` wiped out."""
    return value.bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(1L, {position})")).bitwiseAND(F.lit((1 << width) - 1)))


def _level_one(fps: DataFrame) -> DataFrame:
    half = F.when(F.col("w") < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    key = F.shiftleft(F.col("w").cast("long"), 32).bitwiseOR(_wiped(half, 32, "w % 32"))
    return fps.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(63)))).select(
        key.alias("key"), F.lit(0).cast("long").alias("sub"), "fp"
    )


def _level_two(hot: DataFrame) -> DataFrame:
    """Variants of the half that the first level's key does not fix; bits 38.. of the key name it."""
    other = F.when(F.shiftrightunsigned("key", 32) < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(
        F.shiftrightunsigned("fp", 32)
    )
    quarter = F.when(F.col("w") < 16, F.shiftrightunsigned("other", 16)).otherwise(F.col("other").bitwiseAND(F.lit(0xFFFF)))
    sub = F.shiftleft(F.col("w").cast("long"), 16).bitwiseOR(_wiped(quarter, 16, "w % 16"))
    return (
        hot.select("key", "fp", other.alias("other"))
        .withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(31))))
        .select("key", sub.alias("sub"), "fp")
    )


def _level_three(hot: DataFrame) -> DataFrame:
    """Variants of the quarter that the second level leaves free."""
    other = F.when(F.shiftrightunsigned("key", 32) < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(
        F.shiftrightunsigned("fp", 32)
    )
    free = F.when(F.shiftrightunsigned("sub", 16) < 16, F.col("other").bitwiseAND(F.lit(0xFFFF))).otherwise(
        F.shiftrightunsigned("other", 16)
    )
    eighth = F.when(F.col("w") < 8, F.shiftrightunsigned("free", 8)).otherwise(F.col("free").bitwiseAND(F.lit(0xFF)))
    sub = F.shiftleft(F.col("sub"), 16).bitwiseOR(
        F.shiftleft(F.col("w").cast("long"), 8).bitwiseOR(_wiped(eighth, 8, "w % 8"))
    )
    return (
        hot.select("key", "sub", "fp", other.alias("other"))
        .select("key", "sub", "fp", free.alias("free"))
        .withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(15))))
        .select("key", sub.alias("sub"), "fp")
    )


def _searched(variants: DataFrame, level: int, bucket: int) -> DataFrame:
    return materialize(
        variants.repartition("key", "sub")
        .sortWithinPartitions("key", "sub", "fp")
        .mapInArrow(_search(level, bucket if level < 3 else 1 << 11), "a long, b long, sub long, hot boolean"),
        "simhash-links",
    )


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Distinct ``fps(fp)`` -> links ``(a, b)`` that connect all fingerprints within three bits.

    Every pair within three bits is joined by a path of returned links, and every returned link
    is such a pair. In a long bucket only a spanning forest of the pairs is returned.
    """
    found = _searched(_level_one(fps), 1, bucket)
    out = found.where("not hot").select("a", "b")
    for level, variants in ((2, _level_two), (3, _level_three)):
        hot = found.where("hot").select(F.col("a").alias("key"), "sub", F.col("b").alias("fp"))
        if hot.isEmpty():
            break
        found = _searched(variants(hot), level, bucket)
        out = out.unionByName(found.where("not hot").select("a", "b"))
    return out


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, fingerprint, component_id, component_fp)``, a row per input row.

    fingerprint: 16 lower-case hex digits. component_id: the smallest doc_id reachable over links
    of at most three differing bits (null only if all ids there are null). component_fp: the
    fingerprint value that stands for the component. An empty table gives an empty result.
    """
    own = materialize(fingerprints(docs), "simhash-fp")
    return _classes(own, links(own.select("fp").distinct(), bucket), _digits(F.col("fp")))


def _digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def similar(docs: DataFrame, width: int = shingles.WIDTH, similarity: float = shingles.SIMILARITY, bucket: int = shingles.BUCKET) -> DataFrame:
    """Like :func:`near_duplicates`, over links of texts whose sets of ``width``-word shingles are at least ``similarity`` alike.

    Sets whose SimHash fingerprints are linked within three bits are compared, and those that share a MinHash band,
    as most pairs of 0.8 differ in more bits. fingerprint: 32 hex digits, a hash of the set.
    """
    own = materialize(shingles.banded(docs, width), "shingle-bands")
    unique = shingles.numbered(own)
    classes = materialize(_bit_classes(unique), "simhash-buckets")
    found = shingles.links(docs, unique, width, similarity, bucket, classes)
    numbers = materialize(own.select("doc_id", "name").join(unique.select("fp", "name"), "name"), "shingle-numbers")
    discard(own, unique, classes)
    return _classes(numbers, found, F.col("name"))


def _bit_classes(unique: DataFrame) -> DataFrame:
    """``unique(fp, size, bits)`` -> ``(fp, size, band)``: a bucket for each component of fingerprints within three bits; sets without shingles are in none.

    Every two sets within three bits share a bucket.
    """
    sets = unique.where("size > 0").select("fp", "size", "bits")
    roots = connected_components(links(sets.select(F.col("bits").alias("fp")).distinct()))
    named = sets.join(roots.withColumnRenamed("node", "bits"), "bits", "left")
    return named.select("fp", "size", F.xxhash64(F.lit(3), F.coalesce("root", "bits")).alias("band"))


def _classes(own: DataFrame, found: DataFrame, fingerprint: Column) -> DataFrame:
    """Rows ``own(doc_id, fp, ...)`` with the components of the links ``found(a, b)`` among their fps."""
    unique = own.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = connected_components(found)
    named = materialize(
        unique.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "rep", F.coalesce("root", "fp").alias("root")
        ),
        "simhash-named",
    )
    names = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = named.join(names, "root").select("fp", "component_id", F.col("root").alias("component_fp"))
    return own.join(classes, "fp").select("doc_id", fingerprint.alias("fingerprint"), "component_id", "component_fp")


def keep_one(docs: DataFrame, bucket: int = BUCKET, width: int = 3, similarity: float | None = None) -> DataFrame:
    """One row of ``docs`` for each component of near-duplicates: that of the smallest doc_id; all columns kept.

    Near-duplicates lie within three bits of the fingerprint or, where ``similarity`` is given, have
    sets of ``width``-word shingles that are at least that much alike (:func:`similar`).
    Texts are shuffled once at most, by doc_id, against the ids that go. Only rows whose doc_id
    occurs more than once (nulls included) are fingerprinted again, to tell them apart.
    """
    if similarity is None:
        classes, arrays, kind, own = near_duplicates(docs, bucket), _fp_arrays, "fp long", _digits(F.col("fp"))
    else:
        classes, arrays, kind, own = similar(docs, width, similarity, bucket), shingles.name_arrays(width), "name string", F.col("name")
    found = materialize(classes, "simhash-classes")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec"))
    own_id = F.col("rec.doc_id").cast("long")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    goes = found.where(~stays).select(F.col("doc_id").alias("gone"))
    kept = packed.join(goes, own_id.eqNullSafe(F.col("gone")), "left_anti")
    counted = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = materialize(counted.where("n > 1").select(F.col("doc_id").alias("twin")), "simhash-twins")
    if repeated.isEmpty():
        return kept.select("rec.*")
    twin = own_id.eqNullSafe(F.col("twin"))
    singles = kept.join(repeated, twin, "left_anti")
    twins = packed.join(repeated, twin, "left_semi").withColumn("text", F.col("rec.text"))
    marked = map_texts(twins, ["rec"], arrays, kind).select("rec.rec", own.alias("own"))
    stay = found.where(stays).select("doc_id", "fingerprint", "component_fp").distinct()
    chosen = marked.join(stay, own_id.eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("fingerprint")))
    return singles.unionByName(chosen.dropDuplicates(["component_fp"]).select("rec")).select("rec.*")
