"""The kept matrix: a table in buckets of k-mers that later runs read, join and add samples to.

It lies in a folder as Parquet, each k-mer in the bucket of its hash, so a join by k-mer moves only the
other side. Totals and the number of rows are observed while it is written, and kept with the settings.
A new sample is an outer join with the buckets, which stay where they are; the result is a new
table, and the settings file is what makes it the current one. Models learned from a table lie beside it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import normalize
from seqloom.sources.scratch import exists, put_text, qualified, remove

SCHEMA = "kmer STRING, counts ARRAY<BIGINT>"


@dataclass
class Kept:
    """A kept matrix: its rows, and what was observed when they were written."""

    path: str
    version: str
    rows: DataFrame
    names: list[str]
    totals: list[int]
    n_rows: int
    buckets: int

    def model(self, method: str) -> normalize.Factors | normalize.Quantiles:
        """The model learned from this table: read if it was kept, else learned and kept."""
        spark, place = self.rows.sparkSession, f"{self.path}/norm_{method}-{self.version}"
        if not exists(spark, f"{place}/_SUCCESS"):
            normalize.save(normalize.learn(self.rows, len(self.names), method, self.totals), spark, place)
        return normalize.load(spark, place)


def _table(spark: SparkSession, folder: str) -> str:
    return "seqloom_" + hashlib.sha256(folder.encode()).hexdigest()[:24]


def _open(spark: SparkSession, folder: str, buckets: int) -> DataFrame:
    """The rows of a folder, with its buckets known to the planner."""
    place = folder.replace("\\", "\\\\").replace("'", "\\'")
    name = _table(spark, folder)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMA}) USING parquet CLUSTERED BY (kmer) SORTED BY (kmer) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.read.table(name)


def _settings(spark: SparkSession, path: str) -> dict | None:
    if not exists(spark, f"{path}/settings"):
        return None
    return json.loads("".join(r["value"] for r in spark.read.text(f"{path}/settings").collect()))


def _kept(spark: SparkSession, path: str, about: dict) -> Kept:
    rows = _open(spark, f"{path}/matrix-{about['version']}", about["buckets"])
    return Kept(path, about["version"], rows, about["settings"]["samples"], about["totals"], about["rows"], about["buckets"])


def save(matrix: DataFrame, path: str, settings: dict, buckets: int | None = None, dealt: bool = False) -> Kept:
    """Keep the matrix with the settings that made it, ``samples`` among them, in place of what the folder held.

    ``buckets`` is by default the session's number of shuffle partitions. ``dealt`` says that rows of a
    bucket are in one partition already.
    """
    spark, names = matrix.sparkSession, settings["samples"]
    path, buckets = qualified(spark, path), buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    before, version = _settings(spark, path), uuid.uuid4().hex[:12]
    folder, seen = f"{path}/matrix-{version}", Observation()
    rows = matrix.select("kmer", "counts") if dealt else matrix.select("kmer", "counts").repartition(buckets, "kmer")
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.sum(F.col("counts")[i]).alias(f"s{i}") for i in range(len(names))])
    rows.write.bucketBy(buckets, "kmer").sortBy("kmer").option("path", folder).saveAsTable(_table(spark, folder), format="parquet")
    found = seen.get
    totals = [found[f"s{i}"] or 0 for i in range(len(names))]
    about = {"settings": settings, "version": version, "buckets": buckets, "rows": found["rows"], "totals": totals}
    put_text(spark, f"{path}/settings", json.dumps(about, sort_keys=True))
    if before:
        old = f"{path}/matrix-{before['version']}"
        spark.sql(f"DROP TABLE IF EXISTS {_table(spark, old)}")
        for place in (old, *(f"{path}/norm_{m}-{before['version']}" for m in normalize.LEARN)):
            remove(spark, place)
    return _kept(spark, path, about)


def load(spark: SparkSession, path: str, settings: dict) -> Kept | None:
    """The kept matrix if it exists and was made with these settings, else None."""
    path = qualified(spark, path)
    about = _settings(spark, path)
    return _kept(spark, path, about) if about and about["settings"] == json.loads(json.dumps(settings)) else None


def part(spark: SparkSession, path: str, settings: dict) -> Kept | None:
    """The kept matrix if it lacks only samples of these settings; else None.

    A ratio of samples that a k-mer must reach rules this out: a row that was dropped may pass with more samples.
    """
    path = qualified(spark, path)
    about = _settings(spark, path)
    if not about or settings["thr_rat"] > 0:
        return None
    same = {**about["settings"], "samples": None} == json.loads(json.dumps({**settings, "samples": None}))
    return _kept(spark, path, about) if same and set(about["settings"]["samples"]) < set(settings["samples"]) else None


def joined(kept: Kept, fresh: DataFrame, fresh_names: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The matrix over ``names``, whose counts come from the kept table or from ``fresh``, the matrix of further samples.

    Only ``fresh`` is shuffled. Rows stay in the partitions of their buckets.
    """
    new = fresh.select("kmer", F.col("counts").alias("more")).repartition(kept.buckets, "kmer")
    old = {n: F.col("counts")[i] for i, n in enumerate(kept.names)}
    cell = {n: F.col("more")[i] for i, n in enumerate(fresh_names)} | old
    counts = F.array(*[F.coalesce(cell[n], F.lit(0).cast("long")) for n in names])
    # a merge join: no side may be hashed whole in memory, and partitions are not cut
    return kept.rows.hint("merge").join(new, "kmer", "full_outer").select("kmer", counts.alias("counts"))


def grow(kept: Kept, fresh: DataFrame, fresh_names: Sequence[str], settings: dict) -> Kept:
    """Add the matrix ``fresh`` of further samples; the grown table takes the place of the kept one."""
    return save(joined(kept, fresh, fresh_names, settings["samples"]), kept.path, settings, kept.buckets, dealt=True)
