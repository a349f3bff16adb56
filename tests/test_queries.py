"""Every core query runs; those with SQL agree with DuckDB on the same tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from multisift import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, SQL = core.queries(), core.oracle_sql()
#: Queries that train models; tests/test_plans.py has their plans on experiments with known doublets.
SLOW = {"main_multiplets", "main2_direct_classification", "main3_clamulet", "den1_doublet_density", "ml6_fast_clusters", "ml7_aggregated_features", "sim3_artificial_doublets"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return "None" if math.isnan(v) else f"{v + 0.0:.5f}".replace("-0.00000", "0.00000")
        return str(v)

    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    found = duck.execute(SQL[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in found.description], found.fetchall())


def test_poisson_tail_agrees_with_sql_where_features_are_frequent(spark, tmp_path):
    orders = spark.range(60050).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"))
    feature = F.when(F.col("id") < 20000, 0).when(F.col("id") < 40150, 1).otherwise(2)
    items = spark.range(60050).select(F.col("id").alias("l_orderkey"), feature.alias("l_partkey"), F.lit(50).alias("l_quantity"))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    items.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = QUERIES["prb1_poisson_tail"](spark, str(tmp_path))
    found = con.execute(SQL["prb1_poisson_tail"])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in found.description], found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", ["den1_doublet_density", "ml6_fast_clusters", "main_multiplets", "main2_direct_classification"])
def test_runs_over_the_whole_tables(spark, sf, name):
    got = [r.cell_id for r in QUERIES[name](spark, sf).select("cell_id").collect()]
    assert sorted(got) == sorted(r.cell_id for r in core.cells(spark, sf).select("cell_id").collect())


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())


def test_core_does_not_need_the_llm_package():
    root = os.path.dirname(core.__file__)
    for folder, _, files in os.walk(root):
        if "llm" not in folder:
            assert not any("llm" in open(os.path.join(folder, f)).read() for f in files if f.endswith(".py"))
