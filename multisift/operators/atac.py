"""Doublets in fragment data from how often more than two fragments cover a place, and from simulated coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import adjusted, poisson_above
from ..model import checkpointed
from .cluster import aggregate_features
from .intervals import coverage, covered_windows, deep_runs, fragment_overlaps, frequent_barcodes, narrow, summed_coverage, window_coverage, without_regions
from .neighbors import nearest
from .reduce import dense, feature_names, latent_semantic
from .simulate import random_pairs


def poisson_calls(stats: DataFrame, value: str = "nAbove2") -> DataFrame:
    """Adds p_value, the Poisson tail above the value at the mean of all, and q_value (Benjamini-Hochberg)."""
    stats = checkpointed(stats)
    mean = stats.agg(F.avg(value).alias("__m"))
    out = stats.crossJoin(F.broadcast(mean)).withColumn("p_value", poisson_above(F.col(value), F.col("__m"))).drop("__m")  # one row
    return adjusted(out, "p_value", "bh", "q_value")


def amulet(fragments: DataFrame, **options) -> DataFrame:
    return poisson_calls(fragment_overlaps(fragments, **options))


def amulet_from_counts(counts: DataFrame, cells: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """(cell_id, nAbove2, p_value, q_value) from the features of each cell with counts above 2.

    Features that are above 2 in more cells than chance allows (Holm-adjusted Poisson tail of at most 0.01) don't count.
    """
    if features is not None:
        counts = counts.join(features.select("feature"), "feature", "left_semi")
    above = counts.where("count > 2")
    n = counts.select("feature").distinct()
    rows = n.join(above.groupBy("feature").agg(F.count("*").alias("k")), "feature", "left").select("feature", F.coalesce("k", F.lit(0)).alias("k"))
    rows = checkpointed(rows)
    mean = rows.agg(F.avg("k").alias("__m"))
    rows = rows.crossJoin(F.broadcast(mean)).withColumn("p", poisson_above(F.col("k"), F.col("__m")))  # one row
    kept = adjusted(rows.select("feature", "p"), "p", "holm", "adj").where("adj > 0.01")
    per_cell = above.join(kept.select("feature"), "feature", "left_semi").groupBy("cell_id").agg(F.count("*").alias("nAbove2"))
    return poisson_calls(cells.select("cell_id").join(per_cell, "cell_id", "left").select("cell_id", F.coalesce("nAbove2", F.lit(0)).alias("nAbove2")))


def name_pairs(names: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(pair, name1, name2): n distinct random pairs of names."""
    pairs = random_pairs(names.select(F.col("name").alias("cell_id")), n, seed)
    pairs = pairs.select(F.least("cell1", "cell2").alias("name1"), F.greatest("cell1", "cell2").alias("name2")).distinct()
    return pairs.select(F.concat(F.lit("dbl."), F.concat_ws("+", "name1", "name2")).alias("pair"), "name1", "name2")


def simulated_table(fragments: DataFrame, n_artificial: int | None = None, exclude: DataFrame | str | None = "default", least: float = 500, min_count: float = 0.001, n_features: int = 25, k: int | None = None, widest: int = 1000, seed: int = 42) -> DataFrame:
    """The working table of cells and coverage-simulated doublets: (cell_id, src, type, total, nAbove2, ratio, and coordinates c0...).

    Windows are what many cells cover; an artificial doublet's coverage of a window is the sum of its members', and its loci are
    those of the summed coverage.
    """
    kept = without_regions(narrow(fragments, widest), exclude)
    names = frequent_barcodes(kept, least).select("name")
    n = names.count()
    cov = coverage(kept.join(names, "name", "left_semi"))
    pairs = name_pairs(names, n_artificial or max(1500, -(-8 * n // 10)), seed)
    windows = covered_windows(cov, n, min_count, seed=seed)
    real = window_coverage(cov, windows).select(F.col("name").alias("cell_id"), F.col("window_id").alias("feature"), F.col("cov").cast("double").alias("count"))
    members = pairs.select("pair", F.explode(F.array("name1", "name2")).alias("cell_id"))
    made = members.join(real, "cell_id").groupBy(F.col("pair").alias("cell_id"), "feature").agg(F.sum("count").alias("count"))
    loci = deep_runs(cov, 3).groupBy(F.col("name").alias("cell_id")).agg(F.count("*").alias("nAbove2"))
    made_loci = deep_runs(summed_coverage(cov, pairs), 3, by=("pair",)).groupBy(F.col("pair").alias("cell_id")).agg(F.count("*").alias("nAbove2"))
    counts = real.unionByName(made)
    cells = names.select(F.col("name").alias("cell_id"), F.lit("real").alias("src")).unionByName(pairs.select(F.col("pair").alias("cell_id"), F.lit("artificial").alias("src")))
    if windows.count() > 2 * n_features:
        counts, _ = aggregate_features(counts, cells, k=n_features, seed=seed)
        vec = dense(counts, feature_names(counts), cells).withColumnRenamed("x", "vec")
    else:
        vec = latent_semantic(counts, cells, min(n_features, 20))
    knn = nearest(vec, k or 20)
    doublet = cells.select(F.col("cell_id").alias("nbr_id"), (F.col("src") == "artificial").cast("int").alias("d"))
    ratio = knn.join(doublet, "nbr_id").groupBy("cell_id").agg(F.avg("d").alias("ratio"))
    size = len(vec.first()["vec"])
    out = cells.join(counts.groupBy("cell_id").agg(F.sum("count").alias("total")), "cell_id", "left").join(loci.unionByName(made_loci), "cell_id", "left").join(ratio, "cell_id", "left").join(vec, "cell_id")
    return out.select("cell_id", "src", F.when(F.col("src") == "real", "real").otherwise("doublet").alias("type"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("total", "nAbove2", "ratio")], *[F.col("vec")[i].alias(f"c{i}") for i in range(size)])


def clamulet(fragments: DataFrame, iterations: int = 2, depth: int = 5, **options) -> DataFrame:
    """(cell_id, score) of the real cells, from boosting on simulated_table()."""
    from .classify import iterative_scores

    table = simulated_table(fragments, **options).withColumn("sample", F.lit("all")).withColumn("include_in_training", F.lit(True)).withColumn("initial", F.col("ratio"))
    scores = iterative_scores(table, start="initial", iterations=iterations, depth=depth)
    return scores.join(table.where("src = 'real'").select("cell_id"), "cell_id", "left_semi").select("cell_id", "score")


__all__ = ["amulet", "amulet_from_counts", "clamulet", "name_pairs", "poisson_calls", "simulated_table"]
