"""Shuffled shards by a two-pass external shuffle.

First pass: every record is scattered to one of B buckets by a seeded hash, B being such that a
bucket fits in a task's memory. Second pass: each bucket is put in a fixed order and shuffled with
Fisher-Yates by a generator seeded with the bucket's number, then written. Buckets follow each
other; a record's rank in that sequence decides its shard and slot, so shards differ by at most
one record (law ``rows``).

Both passes depend on the seed and the records only, so a lost task is redone with the same result.
Records that are equal in every column are interchangeable; where more than ``ALIKE`` of them exist
they are numbered first and scattered by number as well. Records that differ in any column are
scattered apart, so no bucket overflows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.common import materialize, scratch_path

#: Bytes of text that a bucket is meant to hold.
BUCKET_BYTES = 64 << 20
#: Buckets at least, so that small tables occupy more than a few tasks.
LEAST_BUCKETS = 64
#: Equal records up to this number stay in one bucket.
ALIKE = 5000
#: Tasks of the second pass at most; beyond, a task shuffles one bucket after the other.
MOST_TASKS = 20_000


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of 0..n-1: from the end, each place is swapped with one not after it."""
    order = list(range(n))
    if n > 1:
        partners = rng.integers(0, np.arange(n, 1, -1)).tolist()
        for i, j in zip(range(n - 1, 0, -1), partners, strict=True):
            order[i], order[j] = order[j], order[i]
    return np.array(order, dtype=np.int64)


def _shuffled(seed: int):
    def shuffle(table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("h2", "ascending"), ("part", "ascending")])
        bucket = table.column("bucket")[0].as_py()
        order = fisher_yates(table.num_rows, np.random.default_rng([seed, bucket]))
        table = table.take(pa.array(order))
        place = pa.array(np.arange(table.num_rows), pa.int64())
        return pa.table({"rec": table.column("rec"), "bucket": table.column("bucket"), "place": place})

    return shuffle


def scattered(docs: DataFrame, seed: int, bucket_bytes: int = BUCKET_BYTES, alike: int = ALIKE) -> tuple[DataFrame, int]:
    """First pass: ``(rec, h, h2, part, bucket)`` of all rows, and the number of buckets."""
    total = docs.agg(F.sum(size_of(F.col("text"))).alias("bytes")).first()["bytes"] or 0
    buckets = max(LEAST_BUCKETS, -(-total // bucket_bytes))
    whole = F.struct(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec"),
        F.xxhash64(F.lit(seed), whole).alias("h"),
        F.xxhash64(F.lit(seed + 1), whole).alias("h2"),
    )
    # how many equal records there are is asked with the hashes alone
    crowds = packed.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > alike)
    crowds = materialize(crowds, "shard-crowds")
    if crowds.isEmpty():
        spread = packed.withColumn("part", F.lit(0))
    else:
        plain = packed.join(crowds, ["h", "h2"], "left_anti").select("rec", "h", "h2", F.lit(0).alias("part"))
        # hashes of 128 bits name the records, so equal ones are counted in the tasks before one of them travels
        crowd = packed.join(crowds.select("h", "h2"), ["h", "h2"]).groupBy("h", "h2").agg(F.first("rec").alias("rec"), F.count(F.lit(1)).cast("int").alias("n"))
        # the copies of one record are made again in many tasks, ``alike`` at a time
        lots = crowd.withColumn("lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / alike).cast("int"))))
        lots = lots.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h", "h2", "lot")
        copies = F.sequence(F.col("lot") * alike, F.least((F.col("lot") + 1) * alike, F.col("n")) - 1)
        again = lots.select("rec", "h", "h2", F.explode(copies).alias("part"))
        spread = plain.unionByName(again)
    return spread.withColumn("bucket", F.pmod(F.xxhash64("h", "h2", (F.col("part") / alike).cast("int")), F.lit(buckets)).cast("int")), buckets


def first_ranks(counts: DataFrame, group: int = 4096) -> DataFrame:
    """``counts(bucket, n)`` -> ``(bucket, start)``: records before each bucket, summed in groups of buckets."""
    grouped = counts.withColumn("g", F.floor(F.col("bucket") / group))
    before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # a row per group of buckets
    groups = grouped.groupBy("g").agg(F.sum("n").alias("of_group")).select("g", F.coalesce(F.sum("of_group").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return grouped.join(groups, "g").select("bucket", (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).cast("long").alias("start"))


def write_shards(docs: DataFrame, shards: int, path: str | None = None, seed: int = 13, bucket_bytes: int = BUCKET_BYTES, alike: int = ALIKE) -> DataFrame:
    """Shuffle ``docs`` into ``shards`` and write them under ``path``, a folder per shard.

    Without ``path`` they go to a scratch folder that lasts as long as the application.

    Returns what was written: ``(rec, shard, slot)``, rec holding all columns of ``docs``, shard
    0..shards-1 and slot 0.. without gaps in each shard. Law ``rows``: counts of shards differ by
    at most one. Null texts and ids, repeated rows and any further columns are carried along; an
    empty table gives an empty result.
    """
    spread, buckets = scattered(docs, seed, bucket_bytes, alike)
    counts = materialize(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "shard-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    starts = first_ranks(counts)
    out = T.StructType([spread.schema["rec"], T.StructField("bucket", T.IntegerType()), T.StructField("place", T.LongType())])
    # a task a bucket, so about as many bytes a task at every size
    dealt = spread.repartitionById(buckets, "bucket") if buckets <= MOST_TASKS else spread.repartition(MOST_TASKS, "bucket")
    shuffled = dealt.groupBy("bucket").applyInArrow(_shuffled(seed), out)
    base, longer = divmod(total, shards)
    rank = F.col("start") + F.col("place")
    head = longer * (base + 1)  # ranks in the shards that hold one more
    shard = F.when(rank < head, F.floor(rank / (base + 1))).otherwise(longer + F.floor((rank - head) / max(base, 1)))
    slot = F.when(rank < head, rank % (base + 1)).otherwise((rank - head) % max(base, 1))
    placed = shuffled.join(starts, "bucket").select("rec", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))
    path = path or scratch_path(docs.sparkSession, "shards")
    placed.write.partitionBy("shard").parquet(path)
    schema = T.StructType([placed.schema["rec"], placed.schema["slot"], placed.schema["shard"]])
    return docs.sparkSession.read.schema(schema).parquet(path)


def digest(written: DataFrame, law: str = "rows") -> DataFrame:
    """What was written, without the texts: a row per record, computed from the records as read back."""
    text = F.col("rec.text")
    return written.select(
        F.col("rec.doc_id").alias("doc_id"),
        size_of(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit(law).alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
