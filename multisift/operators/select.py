"""Choosing features and cells: top by mean, interleaved by cluster, markers, cluster sizes and library sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .matrix import by_cluster, feature_totals, markers


def top_by_mean(counts: DataFrame, n: int, n_cells: int = 1) -> DataFrame:
    return feature_totals(counts, n_cells).select("feature", "mean").orderBy(F.desc("mean"), "feature").limit(n)


def interleaved_by_cluster(counts: DataFrame, cells: DataFrame, n: int) -> DataFrame:
    """The first n distinct features of: every cluster's highest mean, every cluster's second, and so on; clusters in order."""
    ranked = by_cluster(counts, cells).withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("mean"), "feature")))
    # no feature behind rank n of all clusters can be among the first n
    first = ranked.where(F.col("r") <= n).groupBy("feature").agg(F.min(F.struct("r", "cluster")).alias("first"))
    return first.select("feature", F.col("first.r").alias("r"), F.col("first.cluster").alias("cluster")).orderBy("r", "cluster").limit(n)


def select_features(counts: DataFrame, cells: DataFrame | None = None, n: int = 1000, marker_share: float = 0, most_fdr: float = 0.05) -> DataFrame:
    """(feature): top by mean without clusters, else interleaved; marker_share of them are the clusters' markers."""
    if cells is None or "cluster" not in cells.columns:
        return top_by_mean(counts, n).select("feature")
    wanted = round(n * marker_share)
    plain = interleaved_by_cluster(counts, cells, n).select("feature", F.lit(1).alias("o"), F.col("r").alias("k"))
    if not wanted:
        return plain.select("feature")
    best = markers(counts, cells).where(F.col("FDR") < most_fdr).groupBy("feature").agg(F.min("top").alias("k")).orderBy("k", "feature").limit(wanted)
    both = best.select("feature", F.lit(0).alias("o"), F.col("k").cast("int").alias("k")).unionByName(plain).groupBy("feature").agg(F.min(F.struct("o", "k")).alias("x"))
    return both.orderBy("x.o", "x.k", "feature").limit(n).select("feature")


def library_filter(sizes: DataFrame, cells: DataFrame | None = None, low: float = 0.05, high: float = 0.95, least_cells: int = 10) -> DataFrame:
    """Cells with a library above 0 and within these quantiles of all, or of their cluster; small clusters keep all up to their largest.
    Cells without a cluster go if clusters are given."""
    sizes = sizes.where("lsizes > 0")
    if cells is None:
        bounds = sizes.agg(F.percentile("lsizes", F.array(F.lit(low), F.lit(high))).alias("__q"))
        return sizes.crossJoin(F.broadcast(bounds)).where("lsizes BETWEEN __q[0] AND __q[1]").drop("__q")  # one row
    sizes = sizes.join(cells.where("cluster IS NOT NULL").select("cell_id", "cluster"), "cell_id")
    bounds = sizes.groupBy("cluster").agg(F.when(F.count("*") >= least_cells, F.percentile("lsizes", F.array(F.lit(low), F.lit(high)))).otherwise(F.array(F.lit(0.0), F.max("lsizes"))).alias("__q"))
    return sizes.join(F.broadcast(bounds), "cluster").where("lsizes BETWEEN __q[0] AND __q[1]").drop("__q")  # one row for each cluster


def largest_libraries(counts: DataFrame, n: int) -> DataFrame:
    return counts.groupBy("cell_id").agg(F.sum("count").alias("lsizes")).orderBy(F.desc("lsizes"), "cell_id").limit(n)


def large_clusters(cells: DataFrame, share: float = 0.1, most: int | None = None) -> DataFrame:
    """(cluster, n) of clusters with at least this share of the cells, the largest `most` of them."""
    sizes = cells.where("cluster IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("__t"))
    out = sizes.crossJoin(F.broadcast(total)).where(F.col("n") >= share * F.col("__t")).drop("__t")  # one row
    return out.orderBy(F.desc("n"), "cluster").limit(most) if most else out
