"""Set operations and changes of shape: pair lists to symmetric tables, maps of enrichment, one-hot labels and melted metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .threshold import sweep


def symmetric(pairs: DataFrame, value: str) -> DataFrame:
    """(type1, type2, value) in both orders from (combination "A+B", value); pairs that are missing have 0 and the diagonal null."""
    ends = F.split("combination", r"\+")
    one = pairs.select(ends[0].alias("type1"), ends[1].alias("type2"), F.col(value).cast("double").alias(value))
    both = one.unionByName(one.select(F.col("type2").alias("type1"), F.col("type1").alias("type2"), value)).groupBy("type1", "type2").agg(F.sum(value).alias(value))
    names = both.select("type1").distinct()  # one for each cluster
    grid = names.join(names.select(F.col("type1").alias("type2")))
    out = grid.join(both, ["type1", "type2"], "left")
    return out.select("type1", "type2", F.when(F.col("type1") != F.col("type2"), F.coalesce(value, F.lit(0.0))).alias(value))


def wide(pairs: DataFrame, value: str) -> DataFrame:
    """The symmetric table with a column for each second type."""
    return symmetric(pairs, value).groupBy("type1").pivot("type2").agg(F.first(value))


def doublet_map(pairs: DataFrame, color: str = "enrichment", label: str = "observed", sizes: DataFrame | None = None) -> DataFrame:
    """(type1, type2, observed, expected, enrichment, label) of every two clusters, averaged over samples; with sizes(cluster, n), names
    carry them in brackets."""
    d = pairs.groupBy("combination").agg(F.avg("observed").alias("observed"), F.avg("expected").alias("expected"))
    d = d.withColumn("enrichment", F.log2((F.col("observed") + 1) / (F.col("expected") + 1)))
    out = None
    for c in ("observed", "expected", "enrichment"):
        part = symmetric(d, c)
        out = part if out is None else out.join(part, ["type1", "type2"])
    out = out.withColumn("color", F.col(color)).withColumn("label", F.round(label, 1).cast("string"))
    if sizes is not None:
        for k in (1, 2):
            named = sizes.select(F.col("cluster").alias(f"type{k}"), F.concat("cluster", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias(f"name{k}"))
            out = out.join(F.broadcast(named), f"type{k}", "left")  # one row for each cluster
    return out


def threshold_curves(scored: DataFrame, dbr: float, grid: list[float] | None = None, dbr_sd: float | None = None) -> DataFrame:
    """(threshold, measure, value) of the error rates over a grid, by default 0 to 1 in hundredths; values are cut off at 1."""
    table = sweep(scored, dbr, dbr_sd, grid=[k / 100 for k in range(101)] if grid is None else grid)
    long = table.unpivot("threshold", ["FNR", "FDR", "FPR", "dev", "cost"], "measure", "value")
    return long.withColumn("value", F.least(F.lit(1.0), "value"))


def dummies(df: DataFrame, column: str, drop_first: bool = True) -> DataFrame:
    """0/1 columns for the values of a column, the first left out."""
    names = sorted(r[0] for r in df.select(column).distinct().collect() if r[0] is not None)
    return df.select("*", *[(F.col(column) == n).cast("double").alias(f"{column}_{n}") for n in names[1 if drop_first else 0 :]])


def cross_table(df: DataFrame, rows: str, columns: str) -> DataFrame:
    return df.groupBy(rows).pivot(columns).count().na.fill(0)
