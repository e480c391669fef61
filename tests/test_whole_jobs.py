"""Queries that together cover all folds and all samples."""

import duckdb
import pytest

from seqloom.operators import select
from seqloom.plans import queries

from .test_queries import SMALL, normal


def against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    assert normal(got) == normal(con.sql(queries.ORACLES[name]).df())
    return got


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_queries_cover_every_fold(spark, method):
    have = [c for name in queries.QUERIES if name.startswith(f"cv_{method}_fold") for c in against_sql(spark, name).columns]
    assert sorted(c for c in have if c != "kmer") == sorted(f"cv_{method}_{f}" for f in range(len(select.folds(queries.N, 2))))


def test_intervals_of_every_sample(spark):
    assert set(against_sql(spark, "count_intervals_all")["sample"]) == set(queries.SAMPLES)


@pytest.mark.parametrize(("name", "columns"), [("run_files_three_classes", 6), ("run_files_two_classes", 7)])
def test_files_of_all_statistics(spark, name, columns):
    assert against_sql(spark, name)["statistic"].nunique() == columns
