"""Synthetic counts with known doublets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.random import normal, poisson, uniform
from ..model import Experiment
from ..operators.expected import expected_doublets


def mock_experiment(spark: SparkSession, sizes: tuple[int, ...] = (200, 300), features: int = 200, dbl_rate: float = 0.1, heterotypic: bool = True, shift: float = 0.0, seed: int = 42) -> Experiment:
    """Cells of several clusters and doublets between them.

    Each cluster's features have log2-normal means; counts are Poisson. Doublets add the means of their clusters; how many there are of
    each pair is Poisson about what is expected at dbl_rate. cells: cell_id, type, origin, cluster, sample.
    """
    names = [f"cluster{i + 1}" for i in range(len(sizes))]
    singlets = spark.createDataFrame([(n, k) for n, k in zip(names, sizes, strict=True)], "origin string, n int").select("origin", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"), F.lit("singlet").alias("type"))
    expected = expected_doublets(singlets.withColumnRenamed("origin", "cluster"), dbl_rate, heterotypic)
    made = expected.select(F.col("combination").alias("origin"), poisson(uniform("mock_n", "combination", seed=seed), F.col("expected")).alias("n")).where("n > 0")
    doublets = made.select("origin", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"), F.lit("doublet").alias("type"))
    cells = singlets.unionByName(doublets).withColumn("cell_id", F.concat_ws(".", "type", "origin", "i"))
    parents = F.split("origin", r"\+")
    homotypic = (F.size(parents) == 2) & (parents[0] == F.get(parents, F.lit(1)))
    cells = cells.withColumn("cluster", F.when(homotypic, parents[0]).otherwise(F.col("origin"))).withColumn("sample", F.when(uniform("mock_sample", "cell_id", seed=seed) < 0.5, "A").otherwise("B"))
    genes = spark.range(1, features + 1).select(F.concat(F.lit("gene"), F.col("id").cast("string")).alias("feature"))
    means = spark.createDataFrame([(n,) for n in names], "cluster string").join(genes).select(F.col("cluster").alias("part"), "feature", F.pow(F.lit(2.0), F.lit(shift) + normal(uniform("mock_mu", "cluster", "feature", seed=seed))).alias("mu"))
    parts = cells.select("cell_id", F.explode(parents).alias("part")).join(F.broadcast(means), "part")  # clusters x features, given as arguments
    rates = parts.groupBy("cell_id", "feature").agg(F.sum("mu").alias("mu"))
    counts = rates.select("cell_id", "feature", poisson(uniform("mock", "cell_id", "feature", seed=seed), F.col("mu")).cast("double").alias("count")).where("count > 0")
    return Experiment(counts, cells.select("cell_id", "type", "origin", "cluster", "sample"))
