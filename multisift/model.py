"""Data model: a count matrix in long form beside the dimension tables of its cells, and argument checks.

counts(cell_id, feature, count) holds the non-zero entries; absent entries are zeros and every mean, variance or median over cells
divides by the number of cells, not of rows.
"""

from __future__ import annotations

import inspect
import re
import tempfile
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTS = T.StructType([T.StructField("cell_id", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("count", T.DoubleType())])
FRAGMENTS = T.StructType([T.StructField("seqname", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("name", T.StringType()), T.StructField("score", T.IntegerType())])
REGIONS = T.StructType(FRAGMENTS.fields[:3])
#: Columns of the working table that are labels and outcomes, not predictors.
NOT_PREDICTORS = ("mostLikelyOrigin", "originAmbiguous", "distanceToNearestDoublet", "type", "src", "distanceToNearest", "class", "nearestClass", "cluster", "sample", "expected", "include_in_training", "observed")


@dataclass(frozen=True)
class Experiment:
    """counts with the tables of cells (cell_id and any columns), and optionally reduced dimensions pca(cell_id, vec)."""

    counts: DataFrame
    cells: DataFrame
    pca: DataFrame | None = None
    metadata: dict = field(default_factory=dict)

    def with_(self, **changes) -> Experiment:
        return replace(self, **changes)

    def select_features(self, features: DataFrame) -> Experiment:
        return self.with_(counts=self.counts.join(features.select("feature").distinct(), "feature", "left_semi"))

    def select_cells(self, ids: DataFrame) -> Experiment:
        ids = ids.select("cell_id").distinct()
        return self.with_(counts=self.counts.join(ids, "cell_id", "left_semi"), cells=self.cells.join(ids, "cell_id", "left_semi"), pca=self.pca and self.pca.join(ids, "cell_id", "left_semi"))


def shared_folder(spark: SparkSession) -> str:
    """The folder for cut lineage and written tables that the session names; a local session without one (tests) gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="multisift-"))
    return named or spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Runs the plan once and cuts its lineage, in the folder that driver and executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def check_counts(counts: DataFrame) -> DataFrame:
    """The counts as (cell_id, feature, count) without zeros and nulls; raises if a column is missing or a count is negative."""
    missing = {"cell_id", "feature", "count"} - set(counts.columns)
    if missing:
        raise ValueError(f"counts lack the columns {sorted(missing)}")
    counts = counts.select(F.col("cell_id").cast("string").alias("cell_id"), F.col("feature").cast("string").alias("feature"), F.col("count").cast("double").alias("count"))
    checked = F.when(F.col("count") < 0, F.raise_error(F.lit("counts have to be positive"))).otherwise(F.col("count"))
    return counts.withColumn("count", checked).where("count <> 0")


def low_libraries(counts: DataFrame, least: float = 200) -> DataFrame:
    """Cells whose library is below `least`, which the pipelines warn about."""
    return counts.groupBy("cell_id").agg(F.sum("count").alias("lsizes")).where(F.col("lsizes") < least)


def unique_names(df: DataFrame, name: str, order: str, out: str = "unique_name") -> DataFrame:
    """Later rows of a name get .1, .2, ... appended, in the given order."""
    k = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return df.withColumn(out, F.when(k == 0, F.col(name)).otherwise(F.concat_ws(".", name, k.cast("string"))))


def column_or_values(cells: DataFrame, given: str | DataFrame | None, name: str) -> DataFrame:
    """cells with `name` set from a column of theirs, or from a frame (cell_id, value); None leaves cells alone."""
    if given is None:
        return cells
    if isinstance(given, str):
        if given not in cells.columns:
            raise ValueError(f"cells have no column {given}")
        return cells.withColumn(name, F.col(given))
    value = next(c for c in given.columns if c != "cell_id")
    return cells.drop(name).join(given.select("cell_id", F.col(value).alias(name)), "cell_id", "left")


def proportion(value: float | None, name: str, allow_none: bool = True) -> float | None:
    if value is None and allow_none:
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= 1:
        raise ValueError(f"{name} has to be a number between 0 and 1")
    return float(value)


def one_of(value: str, choices: Iterable[str], name: str) -> str:
    """An unambiguous prefix is enough."""
    found = [c for c in choices if c == value] or [c for c in choices if c.startswith(value)]
    if len(found) != 1:
        raise ValueError(f"{name} has to be one of {list(choices)}")
    return found[0]


def processing_function(value: str | Callable, named: dict[str, Callable]) -> Callable:
    """A named processing, or a function that takes (experiment, dims)."""
    if callable(value):
        if len(inspect.signature(value).parameters) < 2:
            raise ValueError("a processing function takes an experiment and a number of dimensions")
        return value
    return named[one_of(value, named, "processing")]


def neighbour_counts(k: int | list[int] | None, n: int) -> list[int]:
    """The numbers of neighbours for ratios: given ones up to half of n, or a default set up to its largest."""
    half = -(-n // 2)
    if k is not None:
        ks = [k] if isinstance(k, int) else list(k)
        return sorted({min(x, half) for x in ks})
    most = max(-(-int(half**0.5 * 1000) // 1000), 25)
    return sorted({x for x in (3, 10, 15, 20, 25, 50, most) if x <= most})


def artificial_count(given: float | None, cells: int, clusters: int) -> int:
    """How many doublets to simulate: at most 25,000; a number up to 2 is a multiple of the cells."""
    if given is None:
        return min(25_000, max(1500, -(-8 * cells // 10), 10 * clusters * clusters))
    return min(25_000, -(-int(given * cells * 1000) // 1000)) if given <= 2 else int(given)


def matching_columns(df: DataFrame, patterns: Iterable[str]) -> list[str]:
    """Columns that a pattern names: * stands for anything; patterns with a leading - take columns away."""
    patterns = list(patterns)
    rules = [(p.startswith("-"), re.compile("^" + re.escape(p.lstrip("-")).replace(r"\*", ".*") + "$")) for p in patterns]
    wanted = [r for minus, r in rules if not minus]
    drop = [r for minus, r in rules if minus]
    return [c for c in df.columns if (not wanted or any(r.match(c) for r in wanted)) and not any(r.match(c) for r in drop)]


def predictors(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NOT_PREDICTORS and c != "cell_id"]


def common_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables' rows in the columns that every table has, with the table's name as sample."""
    shared = [c for c in next(iter(tables.values())).columns if all(c in t.columns for t in tables.values())]
    out = None
    for name, t in tables.items():
        part = t.select(F.lit(name).alias("sample"), *[c for c in shared if c != "sample"])
        out = part if out is None else out.unionByName(part)
    return out


def null_to_zero(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))
