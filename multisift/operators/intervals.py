"""Interval operators: coverage sweeps, runs of deep coverage, merging, overlap joins and the filters around them.

Sweeps and merges are cut at multiples of `cut` along the chromosome: windows run within (name, seqname, piece), so a barcode or
chromosome with most of the intervals is many groups. What crosses a cut is settled by a row or two for each piece, in windows
over pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import poisson_above
from ..model import checkpointed, one_of
from ..sources.fragments import default_regions

CUT = 1 << 22


def _pieces(df: DataFrame, cut: int, start: str = "start", end: str = "end") -> DataFrame:
    """One row for each piece of length `cut` that an interval touches, clipped to it."""
    df = df.where(F.col(start) < F.col(end)).withColumn("__piece", F.explode(F.sequence(F.expr(f"`{start}` div {cut}"), F.expr(f"(`{end}` - 1) div {cut}"))))
    return df.withColumn(start, F.greatest(F.col(start), F.col("__piece") * cut)).withColumn(end, F.least(F.col(end), (F.col("__piece") + 1) * cut))


def coverage(fragments: DataFrame, by: tuple[str, ...] = ("name",), weight: Column | None = None, cut: int = CUT) -> DataFrame:
    """The step function of depth for each key and chromosome: (by..., seqname, start, end, cov), depths above 0 only.

    Ends and starts at one position net out before the running sum. Constant runs may be cut at multiples of `cut`.
    """
    p = _pieces(fragments.withColumn("__w", F.lit(1) if weight is None else weight), cut)
    keys = [*by, "seqname", "__piece"]
    events = p.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("pos"), F.col("__w").alias("d")), F.struct(F.col("end").alias("pos"), (-F.col("__w")).alias("d")))).alias("e"))
    net = events.groupBy(*keys, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d")).where("d <> 0")
    w = Window.partitionBy(*keys).orderBy("pos")
    steps = net.select(*by, "seqname", "__piece", F.col("pos").alias("start"), F.lead("pos").over(w).alias("end"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cov"))
    return steps.where("cov > 0").select(*by, "seqname", "start", "end", "cov")


def _same(left: list[Column], right: list[Column]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & a.eqNullSafe(b)
    return out


def merged(ranges: DataFrame, by: tuple[str, ...] = ("seqname",), gap: int = 0, group: str = "site", touching: bool = False, cut: int = CUT) -> DataFrame:
    """Adds `group`: the start, which is unique within `by`, of the merged range each range belongs to.

    Ranges merge while the next starts less than `gap` behind the farthest end so far; with gap 0 only ranges that overlap do, with
    touching also those that meet. Each range belongs to the piece of its start; how far the ranges of earlier pieces reach, and where the
    last merged range before a piece began, are windows over one row for each piece.
    """
    keys = [*by, "__piece"]
    placed = ranges.withColumn("__piece", F.expr(f"start div {cut}"))

    def earlier(rows: DataFrame, value: Column) -> DataFrame:
        """(keys as k0..., __before): the largest value in the pieces before each."""
        pieces = rows.groupBy(*keys).agg(F.max(value).alias("__v"))
        before = F.max("__v").over(Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1))
        return pieces.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], before.alias("__before"))

    def beside(rows: DataFrame, pieces: DataFrame, name: str) -> DataFrame:
        names = [f"__k{i}" for i in range(len(keys))]
        return rows.join(pieces.withColumnRenamed("__before", name), _same([F.col(k) for k in keys], [F.col(n) for n in names])).drop(*names)

    w = Window.partitionBy(*keys).orderBy("start", "end")
    rows = beside(placed, earlier(placed, F.col("end")), "__reach")
    reach = F.greatest(F.col("__reach"), F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = reach.isNull() | (F.col("start") > reach if touching else F.col("start") >= reach + gap)
    rows = rows.withColumn("__first", F.when(new, F.col("start"))).withColumn("__first", F.max("__first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = beside(rows, earlier(rows, F.col("__first")), "__carried")
    return rows.withColumn(group, F.coalesce("__first", "__carried")).drop("__piece", "__reach", "__first", "__carried")


def reduced(ranges: DataFrame, by: tuple[str, ...] = ("seqname",), gap: int = 0, touching: bool = False, cut: int = CUT) -> DataFrame:
    """The merged ranges with the number of their members."""
    return merged(ranges, by, gap, "__group", touching, cut).groupBy(*by, "__group").agg(F.max("end").alias("end"), F.count("*").alias("members")).select(*by, F.col("__group").alias("start"), "end", "members")


def deep_runs(cov: DataFrame, depth: float, by: tuple[str, ...] = ("name",), cut: int = CUT) -> DataFrame:
    """Maximal runs with at least this depth, with the largest depth in each.

    Runs are found within pieces; only those that touch a cut, at most two for each piece, are joined across it.
    """
    keys = [*by, "seqname"]
    deep = _pieces(cov.where(F.col("cov") >= depth).select(*keys, "start", "end", "cov"), cut)

    def joined(rows: DataFrame, part: str, most: str) -> DataFrame:
        w = Window.partitionBy(*keys, part).orderBy("start", "end")
        new = F.when(F.col("start") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), 1).otherwise(0)
        runs = rows.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return runs.groupBy(*keys, part, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max(most).alias("depth"))

    runs = joined(deep, "__piece", "cov")
    edge = (F.col("start") % cut == 0) | (F.col("end") % cut == 0)
    return joined(runs.withColumn("__at", F.when(edge, -1).otherwise(F.col("__piece"))).drop("__run"), "__at", "depth").select(*keys, "start", "end", "depth")


def overlaps(left: DataFrame, right: DataFrame, cut: int = CUT) -> DataFrame:
    """Pairs of overlapping ranges: left's columns, then right's with the prefix r_. Ranges meet in the pieces they share, and count
    in the one that holds the start of their overlap, so no pair comes twice."""
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    a = left.where("start < end").withColumn("__piece", F.explode(F.sequence(F.expr(f"start div {cut}"), F.expr(f"(end - 1) div {cut}"))))
    b = right.where("r_start < r_end").withColumn("__piece", F.explode(F.sequence(F.expr(f"r_start div {cut}"), F.expr(f"(r_end - 1) div {cut}"))))
    joined = a.join(b, (F.col("seqname") == F.col("r_seqname")) & (a["__piece"] == b["__piece"]) & (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")))
    return joined.where(a["__piece"] == F.expr(f"greatest(start, r_start) div {cut}")).drop("__piece")


def outside(ranges: DataFrame, regions: DataFrame, cut: int = CUT) -> DataFrame:
    """Ranges that overlap none of the regions. Regions are merged first, so that each range has few to meet.

    A range shorter than a piece is looked for in the piece of its start, where the regions are that a range from there may reach; only
    longer ones meet all regions of their chromosome.
    """
    flat = reduced(regions.where("start < end").select("seqname", "start", "end"), touching=True, cut=cut).select(F.col("seqname").alias("__s"), F.col("start").alias("__a"), F.col("end").alias("__b"))
    meets = (F.col("seqname") == F.col("__s")) & (F.col("start") < F.col("__b")) & (F.col("__a") < F.col("end"))
    short = F.coalesce(F.col("end") - F.col("start") <= cut, F.lit(True))
    near = flat.withColumn("__p", F.explode(F.sequence(F.expr(f"greatest(0, __a - {cut}) div {cut}"), F.expr(f"(__b - 1) div {cut}"))))
    return ranges.where(short).join(near, meets & (F.expr(f"start div {cut}") == F.col("__p")), "left_anti").unionByName(ranges.where(~short).join(flat, meets, "left_anti"))


def without_regions(ranges: DataFrame, exclude: DataFrame | str | None) -> DataFrame:
    """Ranges outside of regions, given or "default"."""
    if exclude is None:
        return ranges
    if isinstance(exclude, str):
        exclude = default_regions(ranges.sparkSession) if one_of(exclude, ("default",), "exclude") else None
    return outside(ranges, exclude)


def narrow(fragments: DataFrame, most: int = 1000) -> DataFrame:
    return fragments.where(F.col("end") - F.col("start") <= most)


def frequent_barcodes(fragments: DataFrame, least: float = 500, barcodes: DataFrame | None = None) -> DataFrame:
    """(name, uniqFrags, nFrags) of barcodes with at least `least` fragments (below 1: that share of all fragments), or of those given."""
    counts = fragments.groupBy("name").agg(F.count("*").alias("uniqFrags"), F.sum("score").alias("nFrags"))
    if barcodes is not None:
        return counts.join(barcodes.select("name").distinct(), "name", "left_semi")
    if 0 < least < 1:
        total = fragments.agg(F.bround(F.count("*") * least).alias("__least"))
        return counts.crossJoin(F.broadcast(total)).where("uniqFrags >= __least").drop("__least")  # one row
    return counts.where(F.col("uniqFrags") >= least)


def site_sizes(loci: DataFrame, p_value: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """loci with their merged site, and the sites with the number of loci and whether that is more than chance allows."""
    sited = checkpointed(merged(checkpointed(loci), gap=0, group="site"))  # each read several times
    sites = sited.groupBy("seqname", "site").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))
    mean = sites.agg(F.avg("n").alias("__mean"))
    sites = sites.crossJoin(F.broadcast(mean)).withColumn("p", poisson_above(F.col("n"), F.col("__mean"))).drop("__mean")  # one row
    return sited, sites.withColumn("excluded", F.col("p") < p_value)


def without_frequent_sites(loci: DataFrame, p_value: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Loci but those in sites that too many barcodes share, and those sites."""
    sited, sites = site_sizes(loci, p_value)
    excluded = sites.where("excluded")
    return sited.join(excluded.select("seqname", "site"), ["seqname", "site"], "left_anti").drop("site"), excluded.select("seqname", "start", "end", "n", "p")


def fragment_overlaps(
    fragments: DataFrame, barcodes: DataFrame | None = None, exclude: DataFrame | str | None = "default", least: float = 500, unique: bool = True, widest: int = 1000, depth: int = 3, drop_frequent: bool = True, result: str = "stats"
) -> DataFrame:
    """For each barcode, the loci covered by more than two fragments.

    result: stats (name, nFrags, uniqFrags, nAbove2, total_nAbove2), loci, or coverages. With unique, a fragment counts once
    whatever its number of reads; otherwise as often as its score. Barcodes without loci have zeros. Fragments in `exclude` are left out:
    regions, "default" for the mitochondrial and sex chromosomes, or None for no regions.
    """
    kept = without_regions(narrow(fragments, widest), exclude)
    barcodes = frequent_barcodes(kept, least, barcodes)
    kept = kept.join(barcodes.select("name"), "name", "left_semi")
    cov = coverage(kept, weight=None if unique else F.col("score"))
    if result == "coverages":
        return cov
    loci = deep_runs(cov, depth)
    if result == "loci":
        return loci
    loci, barcodes = checkpointed(loci), checkpointed(barcodes)  # read several times below
    rest = without_frequent_sites(loci)[0] if drop_frequent else loci
    total = loci.groupBy("name").agg(F.count("*").alias("total_nAbove2"))
    above = rest.groupBy("name").agg(F.count("*").alias("nAbove2"))
    out = barcodes.join(total, "name", "left").join(above, "name", "left")
    return out.select("name", "nFrags", "uniqFrags", F.coalesce("nAbove2", F.lit(0)).alias("nAbove2"), F.coalesce("total_nAbove2", F.lit(0)).alias("total_nAbove2"))


def window_coverage(cov: DataFrame, windows: DataFrame, cells: DataFrame | None = None, cut: int = CUT) -> DataFrame:
    """The largest depth of each name in each window (window_id, seqname, start, end); with cells (name), also its zeros."""
    found = overlaps(cov, windows, cut).groupBy("name", F.col("r_window_id").alias("window_id")).agg(F.max("cov").alias("cov"))
    if cells is None:
        return found
    every = cells.select("name").distinct().join(windows.select("window_id").distinct())
    return every.join(found, ["name", "window_id"], "left").select("name", "window_id", F.coalesce("cov", F.lit(0)).alias("cov"))


def summed_coverage(cov: DataFrame, pairs: DataFrame, cut: int = CUT) -> DataFrame:
    """The coverage of pairs (pair, name1, name2) of names: both members' steps as weighted intervals, swept anew."""
    members = pairs.select("pair", F.explode(F.array("name1", "name2")).alias("name"))
    return coverage(cov.join(members, "name"), by=("pair",), weight=F.col("cov"), cut=cut)


def covered_windows(cov: DataFrame, names: int, least: float = 0.001, gap: int = 100, most: int = 500, seed: int = 42) -> DataFrame:
    """Windows (window_id, seqname, start, end) that many names cover.

    Of each name, up to `most` covered runs are drawn; where at least `least` names (below 1: a share of them, but 2 at least) cover a
    position, it is kept, and what is less than `gap` apart is merged.
    """
    from ..functions.random import uniform

    runs = deep_runs(cov, 1)
    draw = F.row_number().over(Window.partitionBy("name").orderBy(uniform("windows", "name", "seqname", "start", seed=seed), "seqname", "start"))
    runs = runs.withColumn("__k", draw).where(F.col("__k") <= most).drop("__k")
    need = max(2, round(least * names)) if least < 1 else least
    pooled = deep_runs(coverage(runs, by=()), need, by=())
    return reduced(checkpointed(pooled), gap=gap).select(F.concat_ws("-", "seqname", "start", "end").alias("window_id"), "seqname", "start", "end")
