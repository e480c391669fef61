import duckdb
import pytest

import __spark_entry__
from seqloom.plans import queries

SMALL = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def normal(df):
    columns = sorted(df.columns)
    out = df[columns].copy()
    for c in columns:
        if out[c].dtype.kind == "f":
            out[c] = out[c].round(5) + 0.0
    return sorted(map(tuple, out.astype(str).values.tolist()))


@pytest.mark.parametrize("name", ["kmer_matrix_half", "kmer_cutoffs", "kmer_filter_set", "tot_cnt", "norm_quantile", "cor_spearman", "anova", "pval_holm", "lineitem_matrix"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "lineitem", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert normal(queries.QUERIES[name](spark, SMALL).toPandas()) == normal(con.sql(queries.ORACLES[name]).df())


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
