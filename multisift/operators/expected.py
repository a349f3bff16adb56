"""Expected doublets and rates, and how observed calls compare with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import negative_binomial_density_udf

PER_1K = 0.008


def cluster_sizes(cells: DataFrame, cluster: str = "cluster") -> DataFrame:
    return cells.where(F.col(cluster).isNotNull()).groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))


def expected_doublets(cells: DataFrame, rate: float | None = None, heterotypic: bool = True, per_1k: float = PER_1K) -> DataFrame:
    """(type1, type2, combination, expected) for each pair of clusters; with heterotypic=False also for each cluster with itself.

    The rate is that of all doublets; its default grows with the number of cells. A single cluster gives one row.
    """
    sizes = cluster_sizes(cells)
    total = sizes.agg(F.sum("n").alias("__t"), F.count("*").alias("__k"))
    sizes = sizes.crossJoin(F.broadcast(total))  # one row
    dbr = F.lit(rate) if rate is not None else F.col("a.__t") * per_1k / 1000
    a, b = sizes.alias("a"), sizes.alias("b")
    same = F.col("a.cluster") == F.col("b.cluster")
    on = F.col("a.cluster") < F.col("b.cluster") if heterotypic else F.col("a.cluster") <= F.col("b.cluster")
    pairs = a.join(b, on | (same & (F.col("a.__k") == 1)))
    value = F.when(F.col("a.__k") == 1, F.col("a.n") * dbr).otherwise(F.col("a.n") * F.col("b.n") / (F.col("a.__t") * F.col("a.__t")) * dbr * F.col("a.__t") * F.when(same, 1).otherwise(2))
    return pairs.select(F.col("a.cluster").alias("type1"), F.col("b.cluster").alias("type2"), F.concat_ws("+", "a.cluster", "b.cluster").alias("combination"), value.alias("expected"))


def homotypic_share(cells: DataFrame) -> DataFrame:
    """One row: the sum of squared cluster shares."""
    return cluster_sizes(cells).agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("prop_homotypic"))


def doublet_rates(cells: DataFrame, per_1k: float = PER_1K, given: dict[str, float] | float | None = None) -> DataFrame:
    """(sample, n, dbr): a rate given for all or for each sample, else one that grows with the sample's real cells."""
    real = cells.where("src = 'real'") if "src" in cells.columns else cells
    sizes = real.groupBy("sample").agg(F.count("*").alias("n"))
    if isinstance(given, dict):
        choice: Column = F.create_map(*[F.lit(x) for p in given.items() for x in p])[F.col("sample")]
    else:
        choice = F.lit(given).cast("double") if given is not None else F.col("n") * per_1k / 1000
    return sizes.withColumn("dbr", choice)


def global_rate(cells: DataFrame, per_1k: float = PER_1K, given: dict[str, float] | float | None = None) -> DataFrame:
    """One row (dbr): the samples' rates, weighted by their cells."""
    return doublet_rates(cells, per_1k, given).agg((F.sum(F.col("dbr") * F.col("n")) / F.sum("n")).alias("dbr"))


def heterotypic_rate(scored: DataFrame, rate: float | None = None, per_1k: float = PER_1K) -> DataFrame:
    """One row (dbr): with clusters, expected heterotypic doublets over real cells; without, the rate less the share of artificial
    doublets whose score is below the share of artificial cells."""
    real = scored.where("src = 'real'")
    if "cluster" in scored.columns:
        total = expected_doublets(real, rate, True, per_1k).agg(F.sum("expected").alias("e"))
        return total.crossJoin(real.agg(F.count("*").alias("n"))).select((F.col("e") / F.col("n")).alias("dbr"))
    share = scored.agg(F.avg(F.when(F.col("src") == "artificial", 1.0).otherwise(0.0)).alias("__s"), F.count_if(F.col("src") == "real").alias("__n"))
    low = scored.where("src = 'artificial'").crossJoin(F.broadcast(share)).agg(F.avg(F.when(F.col("score") < F.col("__s"), 1.0).otherwise(0.0)).alias("low"), F.first("__n").alias("n"))
    return low.select(((1 - F.col("low")) * (F.lit(rate) if rate is not None else F.col("n") * per_1k / 1000)).alias("dbr"))


def observed_and_expected(called: DataFrame, expected: DataFrame, theta: float | None = None) -> DataFrame:
    """(combination, observed, expected, deviation, prop_deviation[, prob]): called doublets of each origin against what is expected."""
    observed = called.where(F.col("mostLikelyOrigin").isNotNull()).groupBy(F.col("mostLikelyOrigin").alias("combination")).agg(F.count("*").alias("observed"))
    out = expected.select("combination", "expected").join(observed, "combination", "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    out = out.withColumn("deviation", F.abs(F.col("expected") - F.col("observed"))).withColumn("prop_deviation", F.try_divide("deviation", F.sum("expected").over(Window.partitionBy())))
    if theta is not None:
        out = out.withColumn("prob", negative_binomial_density_udf(F.col("observed"), F.col("expected"), F.lit(theta)))
    return out


def pair_statistics(scored: DataFrame, thresholds: DataFrame | float, rate: float | None = None) -> DataFrame:
    """(sample, combination, observed, expected, deviation, prop_deviation, FNR, difficulty): calls of each origin and sample.

    thresholds: one number, or (sample, threshold). FNR is the share of an origin's artificial doublets at or below it.
    """
    if isinstance(thresholds, (int, float)):
        scored = scored.withColumn("threshold", F.lit(float(thresholds)))
    else:
        scored = scored.join(F.broadcast(thresholds), "sample")  # one row for each sample
    sizes = scored.where("src = 'real' AND cluster IS NOT NULL").groupBy("sample", "cluster").agg(F.count("*").alias("n"))
    totals = sizes.groupBy("sample").agg(F.sum("n").alias("t"))
    sizes = sizes.join(totals, "sample")
    dbr = F.lit(rate) if rate is not None else F.col("a.t") * PER_1K / 1000
    a, b = sizes.alias("a"), sizes.alias("b")
    expected = a.join(b, F.expr("a.sample = b.sample AND a.cluster < b.cluster")).select(F.col("a.sample").alias("sample"), F.concat_ws("+", "a.cluster", "b.cluster").alias("combination"), (2 * F.col("a.n") * F.col("b.n") / F.col("a.t") * dbr).alias("expected"))
    by_origin = scored.where("mostLikelyOrigin IS NOT NULL").groupBy("sample", F.col("mostLikelyOrigin").alias("combination")).agg(
        F.count_if((F.col("src") == "real") & (F.col("score") > F.col("threshold"))).alias("observed"),
        F.avg(F.when(F.col("src") == "artificial", F.when(F.col("score") <= F.col("threshold"), 1.0).otherwise(0.0))).alias("FNR"),
        F.median("difficulty").alias("difficulty"),
    )
    out = expected.join(by_origin, ["sample", "combination"], "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    out = out.withColumn("deviation", F.abs(F.col("expected") - F.col("observed")))
    return out.withColumn("prop_deviation", F.try_divide("deviation", F.sum("expected").over(Window.partitionBy("sample"))))


def most_likely_origins(neighbours: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(cell_id, mostLikelyOrigin, originAmbiguous) from (cell_id, distance, nbr_origin).

    The origin most neighbours have; if several have as many, of all origins near the cell that with the nearest neighbour, and
    ambiguous if the second nearest is not over a fifth farther. Cells without any have null; known(cell_id, origin) overrides.
    """
    counts = neighbours.where("nbr_origin IS NOT NULL").groupBy("cell_id", "nbr_origin").agg(F.count("*").alias("n"), F.min("distance").alias("d"))
    listed = counts.groupBy("cell_id").agg(
        F.max(F.struct("n", F.col("nbr_origin").alias("o"))).alias("top"),
        F.sort_array(F.collect_list(F.struct("d", F.col("nbr_origin").alias("o")))).alias("near"),  # at most one for each neighbour
        F.sort_array(F.collect_list("n"), asc=False).alias("ns"),
    )
    tied = (F.size("ns") > 1) & (F.col("ns")[0] == F.get("ns", F.lit(1)))
    d1, d2 = F.col("near")[0]["d"], F.get("near", F.lit(1))["d"]
    found = listed.select("cell_id", F.when(tied, F.col("near")[0]["o"]).otherwise(F.col("top.o")).alias("mostLikelyOrigin"), F.when(tied, F.coalesce(F.try_divide(d2 - d1, d1) <= 0.2, F.lit(True))).otherwise(False).alias("originAmbiguous"))
    out = neighbours.select("cell_id").distinct().join(found, "cell_id", "left").withColumn("originAmbiguous", F.coalesce("originAmbiguous", F.lit(False)))
    if known is not None:
        known = known.where("origin IS NOT NULL").select("cell_id", F.col("origin").alias("__o"))
        out = out.join(known, "cell_id", "left").select("cell_id", F.coalesce("__o", "mostLikelyOrigin").alias("mostLikelyOrigin"), (F.col("__o").isNull() & F.col("originAmbiguous")).alias("originAmbiguous"))
    return out
