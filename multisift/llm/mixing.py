"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Each source gets a number of words to give (its target) and a schedule, a weight that changes linearly over training time 0 to 1.
The integral of the schedule says which share of the target is due by a time; its inverse turns a document's place in its
source's stream of words into a training position. Streams follow a hash of doc_id and text and start again where a target exceeds the
source. Documents range-sorted by position are the training order.

Running sums over a source are taken in two steps, within ranges of the hash (16 to the power `digits` of them) and over their
totals, so that a source with most of the rows is spread over that many groups. Texts are not shuffled to find positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, materialise

#: Weights, and start and end of the schedules, by a source's rank, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
RAMPS = ((1.0, 1.0), (0.5, 1.5), (1.5, 0.5))


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _cycle(values: tuple[float, ...], rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds weight, ramp and target to (source, source_size), one row for each source.

    All sources share `share` times all sizes by weight, but none gets more than `most` times its size; what it would get beyond
    goes to the others by weight, again until none is above. That is one level L with target = min(most * size, L * weight):
    sources in order of most * size / weight, with what the capped ones before take subtracted, tell where the level lies.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", _cycle(WEIGHTS, F.col("rank"))).withColumn("cap", most * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight"))
    before = Window.orderBy("fill", "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level)
    # the first source that the level doesn't fill sets it for all behind it
    final = F.min(F.when(F.col("level") < F.col("fill"), F.struct("fill", "rank", "level"))).over(Window.partitionBy())["level"]
    ranked = ranked.withColumn("target", F.least(F.col("cap"), F.coalesce(final * F.col("weight"), F.col("cap"))))
    return ranked.select("source", "source_size", "weight", "target", _cycle(tuple(a for a, _ in RAMPS), F.col("rank")).alias("from"), _cycle(tuple(b for _, b in RAMPS), F.col("rank")).alias("to"))


def position(due: Column, start: Column, end: Column) -> Column:
    """The time by which the share `due` of a source's words is given, under a weight going linearly from start to end."""
    slope = end - start
    return F.when(slope == 0, due).otherwise((F.sqrt(start * start + 2 * slope * due * (start + slope / 2)) - start) / F.when(slope == 0, 1.0).otherwise(slope))


def schedule(docs: DataFrame, share: float = 1.5, most: float = 2.0, digits: int = 3) -> DataFrame:
    """What the mix takes of each document and when, range-sorted by the time of its first visit.

    Returns doc_id, source, size (words), source_size, target, taken (words, repeats counted), takes (words taken at each visit
    of the stream), positions (of each visit, 0 to 1) and position (of the first, null without one), one row for each input row. A
    source's taken words sum to its target, rounded down. A visit that reaches the target ends within its document, of which the
    first words are taken.

    Null texts, empty and blank ones have size 0: nothing is taken. A null source is a source of its own, last in order. A stream's order
    follows a hash of doc_id and text, so rows that repeat both are alike and share nothing but their order, and neither they nor
    null ids change the place of others. An empty table gives an empty frame. Other columns are left out, whatever their names.
    Reruns agree, however the rows are dealt.
    """
    out = _schedule(docs.select("doc_id", "source", "text", F.lit(None).cast("long").alias("key")), share, most, digits)
    return out.repartitionByRange("position", "h").sortWithinPartitions("position", "h").drop("key", "h")


def _schedule(docs: DataFrame, share: float, most: float, digits: int) -> DataFrame:
    """The schedule of (doc_id, source, text, key), with key and the stream's hash h."""
    name = F.md5(F.concat_ws(" ", F.col("doc_id").cast("long").cast("string"), F.col("text").cast("string")).cast("binary"))
    sized = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words().alias("size"), name.alias("h"), "key"))
    sized = sized.withColumn("part", F.substring("h", 1, digits))
    totals = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    goals = targets(totals.groupBy("source").agg(F.sum("part_size").alias("source_size")), share, most)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("part_from", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    totals = totals.withColumnRenamed("source", "s").join(goals, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    inner = Window.partitionBy("source", "part").orderBy("h", "doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, -1)
    some = F.col("size") > 0  # the others take nothing, and any number of them may share a hash
    placed = sized.where(some).withColumn("place", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    placed = placed.unionByName(sized.where(~some).withColumn("place", F.lit(0).cast("long")))
    totals = totals.select(F.col("source").alias("s"), F.col("part").alias("p"), "part_from", "source_size", "target", "from", "to")
    placed = placed.join(totals, F.col("s").eqNullSafe(F.col("source")) & (F.col("p") == F.col("part"))).withColumn("place", F.col("place") + F.col("part_from"))
    visits = F.transform(F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1)), lambda r: r * F.col("source_size") + F.col("place"))
    placed = placed.withColumn("visits", F.filter(visits, lambda a: (a < F.floor("target")) & (F.col("size") > 0)))
    placed = placed.withColumn("takes", F.transform("visits", lambda a: F.least(F.col("size"), F.floor("target") - a)))
    placed = placed.withColumn("positions", F.transform("visits", lambda a: position(a / F.col("target"), F.col("from"), F.col("to"))))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda x, y: x + y)
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "takes", "positions", F.get("positions", F.lit(0)).alias("position"), "key", "h")


def mixed_documents(docs: DataFrame, partitions: int | None = None, share: float = 1.5, most: float = 2.0, digits: int = 3) -> DataFrame:
    """The training stream: all columns of the documents, a row for each visit, range-sorted by position.

    A visit that a target cuts short keeps the first words, up to where the last one of them ends. Null, empty and blank texts are not in
    the stream. Rows whose doc_id repeats or is null can't be joined to their visits by it; if there are any, rows are joined through a
    number of their own, which changes neither visits nor order. Names of other columns can't clash with those of working
    columns. An empty table gives an empty frame.
    """
    key, visit, size, cut, order = (free_name(docs.columns, n) for n in ("mix_key", "mix_visit", "mix_size", "mix_cut", "mix_order"))
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count():
        docs = materialise(docs.withColumn(key, F.monotonically_increasing_id()))
    else:
        docs = docs.withColumn(key, F.col("doc_id").cast("long"))
    plan = _schedule(docs.select("doc_id", "source", "text", F.col(key).alias("key")), share, most, digits).where("taken > 0")
    plan = plan.select(F.col("key").alias(key), F.col("size").alias(size), F.col("h").alias(order), F.explode(F.arrays_zip("takes", "positions")).alias(visit))
    out = docs.join(plan, key).withColumn(cut, F.col(f"{visit}.takes") < F.col(size))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col(f"{visit}.takes").cast("int")), "")
    out = out.withColumn("text", F.when(F.col(cut), first).otherwise(F.col("text")))
    by = [F.col(f"{visit}.positions"), F.col(order)]
    out = out.repartitionByRange(partitions, *by) if partitions else out.repartitionByRange(*by)
    out = out.sortWithinPartitions(*by)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cut) & F.col("n_chars").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.drop(key, size, visit, cut, order)
