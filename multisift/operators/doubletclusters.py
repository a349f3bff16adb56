"""Clusters that may consist of doublets: their expression lies between that of two others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import adjusted
from ..model import checkpointed
from .matrix import log_normalised, pairwise_tests, size_factors


def source_pairs(tests: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(cluster, source1, source2, num_de, best, p_value) for each cluster and each pair of others, source1 the later by name.

    A feature speaks against the pair if it differs from both in the same direction: its log p is the larger of both, and 0
    (p = 1) if the directions differ. num_de counts features that do so after adjustment over all features.
    """
    a, b = tests.alias("a"), tests.alias("b")
    both = a.join(b, F.expr("a.cluster = b.cluster AND a.feature = b.feature AND b.other < a.other"))
    log_p = F.when(F.signum("a.logFC") != F.signum("b.logFC"), 0.0).otherwise(F.greatest("a.log_p", "b.log_p"))
    both = both.select(F.col("a.cluster").alias("cluster"), F.col("a.other").alias("source1"), F.col("b.other").alias("source2"), F.col("a.feature").alias("feature"), log_p.alias("log_p"))
    keys = ["cluster", "source1", "source2"]
    both = adjusted(checkpointed(both), "log_p", "bh", "adj", keys, log=True)
    return both.groupBy(*keys).agg(F.count_if(F.exp("adj") <= threshold).alias("num_de"), F.min(F.struct("log_p", "feature", "adj")).alias("top")).select(*keys, "num_de", F.col("top.feature").alias("best"), F.exp("top.adj").alias("p_value"))


def doublet_clusters(counts: DataFrame, cells: DataFrame, threshold: float = 0.05, features: DataFrame | None = None, all_pairs: bool = False) -> DataFrame:
    """One row for each cluster, the likeliest doublets first: its best pair of sources, the features against it, the sources' library
    sizes over its own, and its share of the cells. Needs at least three clusters."""
    cells = cells.where("cluster IS NOT NULL")
    if cells.select("cluster").distinct().count() < 3:
        raise ValueError("need at least three clusters to detect doublet clusters")
    if features is not None:
        counts = counts.join(features.select("feature").distinct(), "feature", "left_semi")
    factors = size_factors(counts)
    pairs = source_pairs(pairwise_tests(log_normalised(counts, factors), cells), threshold)
    middle = cells.join(factors, "cell_id").groupBy("cluster").agg(F.median("sf").alias("sf"))
    shares = cells.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("prop", F.col("n") / F.sum("n").over(Window.partitionBy()))
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("num_de", F.desc("p_value"), "source1", "source2"))).where("r = 1").drop("r")
    typical = pairs.groupBy("cluster").agg(F.median("num_de").alias("median_de"), *([F.sort_array(F.collect_list(F.struct("num_de", "source1", "source2", "best", "p_value"))).alias("all_pairs")] if all_pairs else []))
    out = best.join(typical, "cluster").join(shares.select("cluster", "prop"), "cluster").join(middle, "cluster")
    for k in (1, 2):
        out = out.join(middle.select(F.col("cluster").alias(f"source{k}"), F.col("sf").alias(f"sf{k}")), f"source{k}")
    out = out.select("cluster", "source1", "source2", "num_de", "median_de", "best", "p_value", (F.col("sf1") / F.col("sf")).alias("lib_size1"), (F.col("sf2") / F.col("sf")).alias("lib_size2"), "prop", *(["all_pairs"] if all_pairs else []))
    return out.orderBy("num_de", F.desc("p_value"), "cluster")
