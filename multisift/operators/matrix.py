"""Operators on counts(cell_id, feature, count): sums, normalisation, TF-IDF, correlation and differential expression.

All statistics over cells include the zeros that have no row: sums and squares divide by the number of cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import adjusted, log_t_below, _udf


def library_sizes(counts: DataFrame) -> DataFrame:
    """(cell_id, lsizes, nfeatures, nAbove2)."""
    return counts.groupBy("cell_id").agg(F.sum("count").alias("lsizes"), F.count_if(F.col("count") > 0).alias("nfeatures"), F.count_if(F.col("count") > 2).alias("nAbove2"))


def feature_totals(counts: DataFrame, n_cells: int | Column) -> DataFrame:
    """(feature, total, mean, detected): the mean over all cells."""
    n = F.lit(n_cells) if isinstance(n_cells, int) else n_cells
    return counts.groupBy("feature").agg(F.sum("count").alias("total"), (F.sum("count") / n).alias("mean"), F.count_if(F.col("count") > 0).alias("detected"))


def frequent_features(counts: DataFrame, least: float = 1) -> DataFrame:
    kept = counts.groupBy("feature").agg(F.sum("count").alias("__t")).where(F.col("__t") >= least).select("feature")
    return counts.join(kept, "feature", "left_semi")


def autosomal_features(features: DataFrame, widest: int = 500, exclude: tuple[str, ...] = ("chrM", "M", "Mt")) -> DataFrame:
    """Features with ranges (seqname, start, end) that are neither too wide nor on an excluded chromosome."""
    return features.where((F.col("end") - F.col("start") <= widest) & ~F.col("seqname").isin(*exclude))


def by_cluster(counts: DataFrame, cells: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, feature, total, mean): pseudo-bulk sums and means over a cluster's cells, zeros included."""
    sizes = cells.groupBy(cluster).agg(F.count("*").alias("__n"))
    sums = counts.join(cells.select("cell_id", cluster), "cell_id").groupBy(cluster, "feature").agg(F.sum("count").alias("total"))
    return sums.join(sizes, cluster).select(cluster, "feature", "total", (F.col("total") / F.col("__n")).alias("mean"))


def by_feature_group(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """Counts of meta-features: groups(feature, group)."""
    return counts.join(groups.select("feature", "group"), "feature").groupBy("cell_id", F.col("group").alias("feature")).agg(F.sum("count").alias("count"))


def size_factors(counts: DataFrame) -> DataFrame:
    """(cell_id, sf): library sizes over their mean."""
    sizes = counts.groupBy("cell_id").agg(F.sum("count").alias("ls"))
    return sizes.crossJoin(F.broadcast(sizes.agg(F.avg("ls").alias("__m")))).select("cell_id", (F.col("ls") / F.col("__m")).alias("sf"))  # one row


def log_normalised(counts: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """log2(count / sf + 1); zeros stay zeros."""
    factors = size_factors(counts) if factors is None else factors
    return counts.join(factors.select("cell_id", "sf"), "cell_id").select("cell_id", "feature", F.log2(F.col("count") / F.col("sf") + 1).alias("count"))


def tf_idf(counts: DataFrame, n_cells: int | None = None, scale: float = 10_000) -> DataFrame:
    """log1p(scale * count / the cell's sum * cells / the feature's sum)."""
    cell = counts.groupBy("cell_id").agg(F.sum("count").alias("__c"))
    feature = counts.groupBy("feature").agg(F.sum("count").alias("__f"))
    n = F.lit(n_cells) if n_cells else F.col("__cells")
    joined = counts.join(cell, "cell_id").join(feature, "feature")
    if not n_cells:
        joined = joined.crossJoin(F.broadcast(cell.agg(F.count("*").alias("__cells"))))  # one row
    return joined.select("cell_id", "feature", F.coalesce(F.log1p(scale * F.col("count") / F.col("__c") * n / F.col("__f")), F.lit(0.0)).alias("count"))


def z_scores(df: DataFrame, value: str, by: list[str], out: str = "z") -> DataFrame:
    stats = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    return df.join(stats, by).withColumn(out, F.try_divide(F.col(value) - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def average_ranks(df: DataFrame, value: str, by: list[str], out: str = "rank") -> DataFrame:
    """Ranks with ties averaged, within groups."""
    w = Window.partitionBy(*by).orderBy(value)
    return df.withColumn(out, F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2)


def cluster_correlation(counts: DataFrame, cells: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """(cell_id, cluster, rho): Spearman's correlation of each cell with each cluster's mean profile over all given features.

    A cell's zeros share one average rank, so only its non-zero entries have rows: with r ranks, x profile ranks and z the zeros'
    rank, sum(r * x) = sum over non-zero of (r - z) * x + z * sum(x). Every cell has a row for each cluster, with a null for a cell
    without counts; counts of other cells don't appear.
    """
    if features is not None:
        counts = counts.join(features.select("feature").distinct(), "feature", "left_semi")
    names = counts.select("feature").distinct()
    m = names.count()
    profile = by_cluster(counts, cells).select("cluster", "feature", "mean")
    full = cells.select("cluster").where("cluster IS NOT NULL").distinct().join(names).join(profile, ["cluster", "feature"], "left").select("cluster", "feature", F.coalesce("mean", F.lit(0.0)).alias("mean"))
    profile = average_ranks(full, "mean", ["cluster"], "x").select("cluster", "feature", "x")
    moments = profile.groupBy("cluster").agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    zeros = m - F.count("*").over(Window.partitionBy("cell_id"))
    ranked = average_ranks(counts, "count", ["cell_id"], "r0").withColumn("z0", zeros)
    ranked = ranked.select("cell_id", "feature", (F.col("r0") + F.col("z0")).alias("r"), ((F.col("z0") + 1) / 2).alias("z"), "z0")
    mine = ranked.groupBy("cell_id").agg(F.sum("r").alias("r1"), F.sum(F.col("r") * F.col("r")).alias("r2"), F.first("z").alias("z"), F.first("z0").alias("z0"))
    mine = mine.select("cell_id", "z", (F.col("r1") + F.col("z0") * F.col("z")).alias("sr"), (F.col("r2") + F.col("z0") * F.col("z") * F.col("z")).alias("srr"))
    cross = ranked.join(profile, "feature").groupBy("cell_id", "cluster").agg(F.sum((F.col("r") - F.col("z")) * F.col("x")).alias("d"))
    every = cells.select("cell_id").distinct().join(mine, "cell_id", "left").crossJoin(F.broadcast(moments))  # one row for each cluster
    out = every.join(cross, ["cell_id", "cluster"], "left")
    cov = F.col("d") + F.col("z") * F.col("sx") - F.col("sr") * F.col("sx") / m
    return out.select("cell_id", "cluster", F.try_divide(cov, F.sqrt((F.col("srr") - F.col("sr") * F.col("sr") / m) * (F.col("sxx") - F.col("sx") * F.col("sx") / m))).alias("rho"))


_LOG_P = _udf(lambda t, df: log_t_below(t, df))


def pairwise_tests(values: DataFrame, cells: DataFrame) -> DataFrame:
    """Welch tests of every ordered pair of clusters for each feature: (cluster, other, feature, logFC, t, df, log_p), log_p two-sided.

    Means and variances come from sums and squares over each cluster's cells, zeros included; a feature without variance in both
    has a p-value of one.
    """
    sizes = cells.where("cluster IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("n"))
    sums = values.join(cells.select("cell_id", "cluster"), "cell_id").groupBy("cluster", "feature").agg(F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("q"))
    full = sizes.join(values.select("feature").distinct()).join(sums, ["cluster", "feature"], "left")
    mean = F.coalesce("s", F.lit(0.0)) / F.col("n")
    spread = F.try_divide(F.greatest(F.lit(0.0), F.coalesce("q", F.lit(0.0)) - F.col("n") * F.col("mean") * F.col("mean")), F.col("n") - 1)
    full = full.withColumn("mean", mean).withColumn("v", spread / F.col("n")).select("cluster", "feature", "mean", "v", "n")
    a, b = full.alias("a"), full.alias("b")
    both = a.join(b, F.expr("a.feature = b.feature AND a.cluster <> b.cluster"))
    va, vb = F.col("a.v"), F.col("b.v")
    df = F.try_divide((va + vb) * (va + vb), F.try_divide(va * va, F.col("a.n") - 1) + F.try_divide(vb * vb, F.col("b.n") - 1))
    both = both.select(F.col("a.cluster").alias("cluster"), F.col("b.cluster").alias("other"), F.col("a.feature").alias("feature"), (F.col("a.mean") - F.col("b.mean")).alias("logFC"), F.sqrt(va + vb).alias("se"), df.alias("df"))
    both = both.withColumn("t", F.when(F.col("se") > 0, F.col("logFC") / F.col("se"))).drop("se")
    from ..functions.stats import log_t_two_sided_udf

    return both.withColumn("log_p", F.coalesce(log_t_two_sided_udf(F.abs(F.col("t")), F.col("df")), F.lit(0.0)))


def markers(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """(cluster, feature, top, p_value, FDR): features detected more often in a cluster than in the others.

    A binomial test of the detected cells for each pair of clusters; a feature's p-value for a cluster is its least over the others
    times their number, and `top` its best rank over them.
    """
    from ..functions.stats import log_binomial_from_udf

    sizes = cells.where("cluster IS NOT NULL").groupBy("cluster").agg(F.count("*").alias("n"))
    found = counts.where("count > 0").join(cells.select("cell_id", "cluster"), "cell_id").groupBy("cluster", "feature").agg(F.count("*").alias("k"))
    full = sizes.join(counts.select("feature").distinct()).join(found, ["cluster", "feature"], "left").select("cluster", "feature", "n", F.coalesce("k", F.lit(0)).alias("k"))
    a, b = full.alias("a"), full.alias("b")
    both = a.join(b, F.expr("a.feature = b.feature AND a.cluster <> b.cluster"))
    both = both.select(F.col("a.cluster").alias("cluster"), F.col("b.cluster").alias("other"), F.col("a.feature").alias("feature"), F.col("a.k").alias("k"), (F.col("a.k") + F.col("b.k")).alias("all"), (F.col("a.n") / (F.col("a.n") + F.col("b.n"))).alias("share"))
    both = both.withColumn("log_p", log_binomial_from_udf(F.col("k"), F.col("all"), F.col("share")))
    both = both.withColumn("rank", F.row_number().over(Window.partitionBy("cluster", "other").orderBy("log_p", "feature")))
    best = both.groupBy("cluster", "feature").agg(F.min("rank").alias("top"), F.least(F.lit(1.0), F.exp(F.min("log_p")) * F.count("*")).alias("p_value"))
    return adjusted(best, "p_value", "bh", "FDR", ["cluster"])
