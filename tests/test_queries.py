"""Every registered graph query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from sylva.plans import catalog

FOLDER = os.environ.get("SYLVA_TEST_TABLES", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"se_distributed", "pi_search", "se_gnn", "se_louvain", "dendrogram_checked", "leiden_distributed", "tree_refined", "diameter"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def ordered(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype) == "str":
            df[c] = df[c].map(lambda x: "" if x is None else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLES) - SLOW))
def test_query_equals_sql(spark, duck, name):
    got = ordered(catalog.QUERIES[name](spark, FOLDER).toPandas())
    want = ordered(duck.execute(catalog.ORACLES[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=2e-6)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - SLOW))
def test_query_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
