"""Fragments and regions from BED-like files and frames. Coordinates are 0-based and half-open throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import FRAGMENTS, REGIONS

#: Left out unless other regions are given: mitochondrial and sex chromosomes as wholes (fixed values).
EXCLUDED = ("M", "chrM", "MT", "X", "Y", "chrX", "chrY")
WHOLE = 100_000_000


def read_fragments(spark: SparkSession, path: str, partitions: int | None = None, sniffed: int = 5) -> DataFrame:
    """seqname, start, end, name and, where the file has it, the number of reads; # starts a comment. Gzip files can't be split:
    `partitions` deals their rows out again.

    The first `sniffed` rows tell the form, and are refused if they have under three columns, a number for a chromosome or a start or end
    that is no whole number. A fifth column that isn't a whole number in all of them is not taken as reads. Below, a start or end
    that is no whole number fails the read when it is reached. A file without rows gives an empty frame.
    """
    whole = r"^-?[0-9]+$"
    first = [line.split("\t") for line in (r[0] for r in spark.read.text(path).where("NOT startswith(value, '#') AND value <> ''").limit(sniffed).collect())]
    if any(len(x) < 3 or not all(v.strip().lstrip("-").isdigit() for v in x[1:3]) for x in first) or (first and all(x[0].replace(".", "", 1).isdigit() for x in first)):
        raise ValueError(f"malformed BED rows in {path}: a chromosome's name, a start and an end have to come first")
    names = ["seqname", "start", "end", "name", "score"]
    raw = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path, sep="\t", comment="#")

    def number(c: str):
        bad = F.raise_error(F.concat(F.lit(f"malformed BED row: {c} is "), F.coalesce(F.col(c), F.lit("missing")))).cast("long")
        return F.when(F.trim(c).rlike(whole), F.trim(c).cast("long")).otherwise(bad).alias(c)

    counted = bool(first) and all(len(x) > 4 and x[4].strip().lstrip("-").isdigit() for x in first)
    score = F.coalesce(F.expr("try_cast(score AS int)"), F.lit(1)) if counted else F.lit(1)
    out = raw.select("seqname", number("start"), number("end"), "name", score.alias("score"))
    return out.repartition(partitions) if partitions else out


def write_by_chromosome(fragments: DataFrame, path: str) -> None:
    """A table with a folder for each chromosome, of which read_chromosomes() reads only those asked for."""
    fragments.repartition("seqname", F.expr("start div 10000000")).write.partitionBy("seqname").parquet(path)


def read_chromosomes(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    out = spark.read.schema(FRAGMENTS).parquet(path)
    return out.where(F.col("seqname").isin(names)) if names else out


def from_frame(df: DataFrame) -> DataFrame:
    """Checks a frame of fragments; a missing score is 1."""
    missing = {"seqname", "start", "end", "name"} - set(df.columns)
    if missing:
        raise ValueError(f"fragments lack the columns {sorted(missing)}")
    score = F.coalesce(F.col("score").cast("int"), F.lit(1)) if "score" in df.columns else F.lit(1)
    return df.select("seqname", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("name").cast("string").alias("name"), score.alias("score"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGIONS).csv(path, sep="\t", comment="#").orderBy("seqname", "start", "end")


def default_regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, 0, WHOLE) for c in EXCLUDED], REGIONS)


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("name")).where("name <> ''")
