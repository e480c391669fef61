"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and an equality join that adaptive
execution may split, so a vertex with very many neighbours never has to sit in one task whole.
Each round is written to the shared folder, which keeps the lineage short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of orderable ids -> ``(node, root)``, root the smallest node reachable.

    Self loops, repeated and reversed edges and nulls are harmless; nodes without an edge to
    another node are not returned. An empty edge table gives an empty result.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "cc-edges",
    )
    before = None
    for _ in range(max_rounds):
        after = materialize(_small_star(_large_star(now)), "cc-edges")
        mark = after.agg(
            F.count(F.lit(1)), F.expr("bit_xor(xxhash64(hi, lo))"), F.expr("bit_xor(xxhash64(lo, hi, 7))")
        ).first()
        discard(now)
        now = after
        if mark == before:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
                now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
            )
        before = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
