"""Running counts kept as deltas."""

import os
import random

from seqloom.streaming import counts

from .test_kmers import plain_counts


def bases(path, kind):
    return sorted(n for n in os.listdir(path) if n.startswith(kind)) if os.path.exists(path) else []


def test_deltas_follow_the_new_reads_and_replays_change_nothing(spark, tmp_path):
    r, folder, out = random.Random(1), f"{tmp_path}/in", f"{tmp_path}/out"
    assert counts.current_counts(spark, out).count() == 0
    os.makedirs(folder)
    state, every = counts.running_counts(counts.read_stream(spark, folder), 8), []
    written = []
    for step in range(7):
        new = ["".join(r.choices("ACGT", k=400 if step < 3 else 20)) for _ in range(5)]
        every += new
        spark.createDataFrame([("s", q) for q in new], "sample string, seq string").coalesce(1).write.mode("append").parquet(folder)
        query = counts.start(state, out, f"{tmp_path}/ck", compact=3)
        query.processAllAvailable()
        query.stop()
        got = {x["kmer"]: x["n"] for x in counts.current_counts(spark, out).collect()}
        assert got == plain_counts(every, 8, True)
        written.append(spark.read.parquet(f"{out}/{bases(out, 'delta')[-1]}").count())
    assert max(written[3:]) <= 5 * 13 < min(written[:2])  # the keys that a batch changed, whatever the state
    assert bases(out, "base") == ["base-000000000002", "base-000000000005"] and bases(out, "delta")[0] == "delta-000000000003"
    before = counts.current_counts(spark, out).orderBy("kmer").collect()
    replay = spark.read.parquet(f"{out}/delta-000000000005").toPandas()
    spark.createDataFrame(replay).write.mode("overwrite").parquet(f"{out}/delta-000000000005")
    counts._compact(spark, out, 5)
    assert counts.current_counts(spark, out).orderBy("kmer").collect() == before
    os.remove(f"{out}/base-000000000005/_SUCCESS")  # an unfinished table is not read
    assert counts.current_counts(spark, out).orderBy("kmer").collect() == before
