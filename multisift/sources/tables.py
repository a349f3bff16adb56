"""The driver's tables as count matrices, cells, fragments, embeddings and scored cells, in Spark and in DuckDB.

The SQL twin of each is a common table expression; with_sql() puts those that a query names in front of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.random import uniform, uniform_sql

MARKER_CLUSTERS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 100).cast("string").alias("feature"), "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("cell_id"))
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("cell_id", "feature").agg(F.sum("l_quantity").cast("double").alias("count"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("cell_id"), F.col("c_mktsegment").alias("cluster"), "c_nationkey")
    nations = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("sample"))
    ordering = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("cell_id"))
    out = customers.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations at any scale
    return out.select("cell_id", "cluster", "sample").join(ordering, "cell_id", "left_semi")


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select(F.col("event_type").alias("seqname"), start.alias("start"), (start + F.floor(F.col("value") * 1800) + 1).alias("end"), F.col("user_id").cast("string").alias("name"), F.lit(1).alias("score"))


def exclusion(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("error", 0, 1704300000)], "seqname string, start long, end long")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("cell_id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as scored cells: every fourth one is an artificial doublet of two clusters, with a higher score."""
    c = cells(spark, sf_dir)
    artificial = F.col("cell_id").cast("long") % 4 == 0
    other = F.element_at(F.array(*map(F.lit, MARKER_CLUSTERS)), (F.floor(5 * uniform("other", "cell_id")) + 1).cast("int"))
    u = uniform("score", "cell_id")
    c = c.withColumn("src", F.when(artificial, "artificial").otherwise("real")).withColumn("type", F.when(artificial, "doublet").otherwise("real"))
    c = c.withColumn("score", F.round(F.when(artificial, F.sqrt(u)).otherwise(u * u), 6)).withColumn("include_in_training", F.col("cell_id").cast("long") % 11 != 0)
    c = c.withColumn("mostLikelyOrigin", F.when(other != F.col("cluster"), F.concat_ws("+", F.least("cluster", other), F.greatest("cluster", other))))
    return c.withColumn("difficulty", F.round(uniform("difficulty", "cell_id"), 6))


_SQL = {
    "counts": "SELECT o_custkey::VARCHAR cell_id, (l_partkey % 100)::VARCHAR feature, sum(l_quantity)::DOUBLE \"count\" FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL",
    "cells": "SELECT c_custkey::VARCHAR cell_id, c_mktsegment \"cluster\", n_regionkey::VARCHAR sample FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "fragments": "SELECT event_type seqname, floor(epoch(ts))::BIGINT s, floor(epoch(ts))::BIGINT + floor(value * 1800)::BIGINT + 1 e, user_id::VARCHAR \"name\", 1 score FROM events",
    "exclusion": "SELECT 'error' seqname, 0::BIGINT s, 1704300000::BIGINT e",
    "vectors": "SELECT vec_id::VARCHAR cell_id, embedding::DOUBLE[] vec, label FROM embeddings",
    "scored": f"""SELECT cell_id, "cluster", sample, CASE WHEN a THEN 'artificial' ELSE 'real' END src, CASE WHEN a THEN 'doublet' ELSE 'real' END "type",
        round(CASE WHEN a THEN sqrt(u) ELSE u * u END, 6) score, cell_id::BIGINT % 11 <> 0 include_in_training,
        CASE WHEN other <> "cluster" THEN least("cluster", other) || '+' || greatest("cluster", other) END "mostLikelyOrigin", round(d, 6) difficulty
        FROM (SELECT *, cell_id::BIGINT % 4 = 0 a, {uniform_sql('score', 'cell_id')} u, {uniform_sql('difficulty', 'cell_id')} d,
            {list(MARKER_CLUSTERS)}[(floor(5 * {uniform_sql('other', 'cell_id')}) + 1)::INT] other FROM cells)""",
}
_NEEDS = {"scored": ("cells",)}


def with_sql(names: str, query: str) -> str:
    """The query behind `WITH` its base tables (space-separated names); a query may go on with more expressions after a comma."""
    wanted: list[str] = []
    for n in names.split():
        for m in (*_NEEDS.get(n, ()), n):
            if m not in wanted:
                wanted.append(m)
    head = "WITH " + ", ".join(f"{n} AS ({_SQL[n]})" for n in wanted)
    query = query.strip()
    return f"{head}, {query[5:]}" if query[:5].upper() == "WITH " else f"{head} {query}"
