"""The driver's queries: one or more for each operator of the inventory, on count matrices, cells, fragments, embeddings and scores
derived from the driver's tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import model
from .functions import stats
from .functions.random import uniform_sql
from .operators import atac, classify, cluster, coexpression, doubletclusters, enrichment, expected, intervals, matrix, neighbors, reduce, reshape, select, simulate, threshold
from .plans import density, multiplets
from .sinks import plots
from .sources import fragments as bed
from .sources import mock
from .sources.tables import MARKER_CLUSTERS, cells, counts, embeddings, exclusion, fragments, read, scored, with_sql

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, tables: str = "", name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql:
            _SQL[key] = with_sql(tables, sql) if tables else sql
        return f

    return register


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[rnd(f"`{c}`" if "." in c else c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that executors share."""
    return f"{model.shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- sources and sinks


@query('SELECT cell_id, feature, "count" FROM counts WHERE "count" <> 0', "counts")
def src1_checked_counts(s, d):
    return model.check_counts(counts(s, d))


@query("""SELECT c_custkey, c_mktsegment || CASE WHEN k > 0 THEN '.' || k ELSE '' END unique_name
    FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 k FROM customer)""")
def src1_unique_names(s, d):
    return model.unique_names(read(s, d, "customer"), "c_mktsegment", "c_custkey").select("c_custkey", "unique_name")


@query('SELECT seqname, s AS "start", e AS "end", "name", score FROM fragments', "fragments")
def src2_fragment_file(s, d):
    path = scratch(s)
    fragments(s, d).write.option("sep", "\t").option("compression", "gzip").csv(path)
    return bed.read_fragments(s, path)


@query("""SELECT seqname, s AS "start", e AS "end", "name", score FROM fragments WHERE seqname IN ('error', 'click')""", "fragments")
def src3_chromosome_scan(s, d):
    path = scratch(s)
    bed.write_by_chromosome(fragments(s, d), path)
    return bed.read_chromosomes(s, path, ["error", "click"]).select("seqname", "start", "end", "name", "score")


@query('SELECT seqname, s AS "start", e AS "end", "name", CASE WHEN s % 2 = 0 THEN 3 ELSE 1 END score FROM fragments', "fragments")
def src4_scores_that_are_no_numbers(s, d):
    path = scratch(s)
    f = fragments(s, d).withColumn("score", F.when(F.col("start") % 2 == 0, "3").otherwise("."))
    f.where("score = '3'").write.option("sep", "\t").csv(f"{path}/a")
    f.where("score = '.'").write.option("sep", "\t").csv(f"{path}/b")
    return bed.read_fragments(s, f"{path}/a").unionByName(bed.read_fragments(s, f"{path}/b"))


@query("""SELECT "name", count(*) n FROM fragments WHERE "name"::BIGINT % 3 = 0 GROUP BY "name\"""", "fragments")
def src5_barcode_file(s, d):
    path = scratch(s)
    f = fragments(s, d)
    f.select("name").distinct().where("cast(name AS long) % 3 = 0").write.text(path)
    return f.join(bed.read_barcodes(s, path), "name", "left_semi").groupBy("name").agg(F.count("*").alias("n"))


@query('SELECT seqname, s AS "start", e AS "end" FROM exclusion', "exclusion")
def src6_region_file(s, d):
    path = scratch(s)
    exclusion(s).write.option("sep", "\t").csv(path)
    return bed.read_regions(s, path)


@query()
def src7_mock_experiment(s, d):
    e = mock.mock_experiment(s, (60, 80, 50), 60)
    return e.counts.join(e.cells, "cell_id")


@query('SELECT seqname, s AS "start", e AS "end", "name", 1 score FROM fragments', "fragments")
def src8_fragment_frame(s, d):
    return bed.from_frame(fragments(s, d).drop("score"))


@query('SELECT c.cell_id, c."cluster", c.sample, s.score multisift_score, s."mostLikelyOrigin" "multisift_mostLikelyOrigin" FROM cells c LEFT JOIN (SELECT * FROM scored WHERE src = \'real\') s USING (cell_id)', "cells scored")
def snk1_attached_columns(s, d):
    return multiplets.attach(cells(s, d), scored(s, d).where("src = 'real'").select("cell_id", "score", "mostLikelyOrigin"))


@query("""SELECT 'full' shape, count(*) n, sum(score) total FROM scored UNION ALL SELECT 'table', count(*), sum(score) FROM scored WHERE src = 'real'
    UNION ALL SELECT 'cells', count(*), sum(CASE WHEN src = 'real' THEN score END) FROM scored""".replace("sum(score)", "round(sum(score), 4)").replace("sum(CASE WHEN src = 'real' THEN score END)", "round(sum(CASE WHEN src = 'real' THEN score END), 4)"), "scored")
def snk2_result_shapes(s, d):
    out = None
    for shape in ("full", "table", "cells"):
        t = multiplets.shaped(scored(s, d), cells(s, d), shape)
        part = t.agg(F.lit(shape).alias("shape"), F.count("*").alias("n"), rnd(F.sum("multisift_score" if shape == "cells" else "score"), 4).alias("total"))
        out = part if out is None else out.union(part)
    return out


LOCI = """
    ev AS (SELECT "name", seqname, s p, 1 d FROM frag UNION ALL SELECT "name", seqname, e, -1 FROM frag),
    g AS (SELECT "name", seqname, p, sum(d) d FROM ev GROUP BY ALL),
    cv AS (SELECT "name", seqname, p, sum(d) OVER w c, lead(p) OVER w np FROM g WINDOW w AS (PARTITION BY "name", seqname ORDER BY p)),
    seg AS (SELECT *, CASE WHEN lag(np) OVER (PARTITION BY "name", seqname ORDER BY p) = p THEN 0 ELSE 1 END b FROM cv WHERE c >= 3),
    isl AS (SELECT *, sum(b) OVER (PARTITION BY "name", seqname ORDER BY p) i FROM seg),
    loci AS (SELECT "name", seqname, min(p) s, max(np) e, max(c)::BIGINT depth FROM isl GROUP BY "name", seqname, i)"""
#: Events last for days, unlike fragments.
WIDEST = 10_000_000
FRAG = f"WITH frag AS (SELECT * FROM fragments WHERE e - s <= {WIDEST}),"
SITES = """,
    o AS (SELECT *, max(e) OVER (PARTITION BY seqname ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pm FROM loci),
    k AS (SELECT *, sum(CASE WHEN pm IS NULL OR s >= pm THEN 1 ELSE 0 END) OVER (PARTITION BY seqname ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) site FROM o),
    sites AS (SELECT seqname, site, min(s) s, max(e) e, count(*) n FROM k GROUP BY seqname, site),
    bad AS (SELECT *, """ + stats.poisson_above_sql("n", "m") + """ p FROM (SELECT *, avg(n) OVER () m FROM sites))"""


@query(FRAG + LOCI + ' SELECT "name", seqname, s AS "start", e AS "end", depth FROM loci', "fragments")
def snk3_overlap_loci(s, d):
    return intervals.fragment_overlaps(fragments(s, d), least=1, widest=WIDEST, result="loci")


@query("""WITH c AS (SELECT count(DISTINCT "cluster") n FROM cells) SELECT 'heat map' picture, n * n AS marks FROM c UNION ALL SELECT 'threshold curves', 5""", "cells")
def snk4_pictures(s, d):
    """The pictures, saved and read back: the number of tiles and of lines in them."""
    heat, lines = scratch(s), scratch(s)
    plots.save(s, plots.heat_map(expected.pair_statistics(scored(s, d), 0.5, 0.1)), heat)
    plots.save(s, plots.curves(scored(s, d), 0.1, threshold=0.5), lines)
    out = plots.load(s, heat).select(F.lit("heat map").alias("picture"), F.regexp_count("svg", F.lit('class="tile"')).cast("long").alias("marks"))
    return out.union(plots.load(s, lines).select(F.lit("threshold curves"), F.regexp_count("svg", F.lit("<polyline")).cast("long")))


# ---------------------------------------------------------------- projections and filters


@query("""SELECT cell_id, feature, "count" FROM counts WHERE feature IN ('1', '5', '42') AND cell_id IN (SELECT cell_id FROM cells WHERE "cluster" = 'BUILDING')""", "counts cells")
def prj1_slice(s, d):
    few = s.createDataFrame([("1",), ("5",), ("42",)], "feature string")
    return model.Experiment(counts(s, d), cells(s, d)).select_features(few).select_cells(cells(s, d).where("cluster = 'BUILDING'")).counts.select("cell_id", "feature", "count")


@query('SELECT cell_id, score, difficulty, src FROM scored', "scored")
def prj2_column_difference(s, d):
    return scored(s, d).drop("cluster", "sample", "type", "include_in_training", "mostLikelyOrigin")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def prj3_matching_columns(s, d):
    c = read(s, d, "customer")
    return c.select(*model.matching_columns(c, ["c_*", "-c_n*", "-c_acct*"]))


@query("SELECT cell_id, score, difficulty FROM scored", "scored")
def prj4_default_predictors(s, d):
    t = scored(s, d)
    return t.select("cell_id", *model.predictors(t))


SIZES = 'WITH ls AS (SELECT cell_id, sum("count") lsizes FROM counts GROUP BY cell_id)'


@query(SIZES + ", q AS (SELECT quantile_cont(lsizes, 0.05) a, quantile_cont(lsizes, 0.95) b FROM ls WHERE lsizes > 0) SELECT cell_id, lsizes FROM ls, q WHERE lsizes BETWEEN a AND b", "counts")
def fil1_library_sizes(s, d):
    return select.library_filter(matrix.library_sizes(counts(s, d)).select("cell_id", "lsizes"))


@query(SIZES + """, m AS (SELECT * FROM ls JOIN cells USING (cell_id) WHERE lsizes > 0),
    q AS (SELECT "cluster", CASE WHEN count(*) >= 10 THEN quantile_cont(lsizes, 0.05) ELSE 0 END a, CASE WHEN count(*) >= 10 THEN quantile_cont(lsizes, 0.95) ELSE max(lsizes) END b FROM m GROUP BY "cluster")
    SELECT cell_id, m."cluster", lsizes FROM m JOIN q USING ("cluster") WHERE lsizes BETWEEN a AND b""", "counts cells")
def fil1_library_sizes_by_cluster(s, d):
    return select.library_filter(matrix.library_sizes(counts(s, d)).select("cell_id", "lsizes"), cells(s, d)).select("cell_id", "cluster", "lsizes")


@query('SELECT seqname, s AS "start", e AS "end", "name" FROM fragments WHERE e - s <= 1000', "fragments")
def fil2_narrow_fragments(s, d):
    return intervals.narrow(fragments(s, d)).select("seqname", "start", "end", "name")


@query('SELECT "name", count(*) "uniqFrags" FROM fragments GROUP BY "name" HAVING count(*) >= 60', "fragments")
def fil3_frequent_barcodes(s, d):
    return intervals.frequent_barcodes(fragments(s, d), 60).select("name", "uniqFrags")


@query('SELECT "name", count(*) "uniqFrags" FROM fragments GROUP BY "name" HAVING count(*) >= round_even((SELECT count(*) FROM fragments) * 0.0067, 0)', "fragments")
def fil3_barcodes_with_a_share(s, d):
    return intervals.frequent_barcodes(fragments(s, d), 0.0067).select("name", "uniqFrags")


@query('SELECT cell_id, feature, "count" FROM counts WHERE feature IN (SELECT feature FROM counts GROUP BY feature HAVING sum("count") >= 800)', "counts")
def fil4_frequent_features(s, d):
    return matrix.frequent_features(counts(s, d), 800).select("cell_id", "feature", "count")


@query("""SELECT seqname, s AS "start", e AS "end", "name" FROM fragments WHERE e - s <= 500 AND seqname NOT IN ('error', 'M')""", "fragments")
def fil5_feature_ranges(s, d):
    return matrix.autosomal_features(fragments(s, d), 500, ("error", "M")).select("seqname", "start", "end", "name")


@query("SELECT cell_id, score FROM scored WHERE src = 'real'", "scored")
def fil6_real_cells(s, d):
    return scored(s, d).where("src = 'real'").select("cell_id", "score")


@query("""WITH r AS (SELECT "cluster", quantile_cont(score, 0.9) q9, median(score) q5 FROM scored WHERE src = 'real' GROUP BY "cluster"),
    a AS (SELECT "mostLikelyOrigin" origin, count(*) n, quantile_cont(score, 0.1) d1, median(score) d5 FROM scored WHERE src = 'artificial' AND "mostLikelyOrigin" IS NOT NULL GROUP BY 1 HAVING count(*) >= 5),
    p AS (SELECT origin, any_value(d1) d1, any_value(d5) d5, max(q9) q9, max(q5) q5 FROM a JOIN r ON list_contains(string_split(origin, '+'), "cluster") GROUP BY origin)
    SELECT origin FROM p WHERE d1 < q9 OR d5 - greatest(q5, (SELECT median(score) FROM scored WHERE src = 'real')) < 0.1""", "scored")
def fil7_unrecognisable_doublets(s, d):
    return threshold.unrecognisable(scored(s, d))


@query(FRAG + LOCI + SITES + ' SELECT "name", k.seqname, k.s AS "start", k.e AS "end" FROM k JOIN bad USING (seqname, site) WHERE p >= 0.01', "fragments")
def fil8_without_frequent_sites(s, d):
    return intervals.without_frequent_sites(intervals.fragment_overlaps(fragments(s, d), least=1, widest=WIDEST, result="loci"))[0].select("name", "seqname", "start", "end")


@query("SELECT 'dbr' AS argument, 0.1::DOUBLE AS \"value\" UNION ALL SELECT 'mode', 2")
def fil9_checked_arguments(s, d):
    rows = [("dbr", model.proportion(0.1, "dbr")), ("mode", float(("a", "b", "single").index(model.one_of("sing", ("a", "b", "single"), "mode"))))]
    return s.createDataFrame(rows, "argument string, value double")


CALLED = """WITH c AS (SELECT *, CASE WHEN score > 0.55 THEN 'doublet' ELSE 'singlet' END "call" FROM scored),
    n AS (SELECT count(*) FILTER (src = 'real') r, count(*) FILTER (src = 'real' AND "call" = 'doublet') rd, count(*) FILTER (src = 'artificial') a, count(*) FILTER (src = 'artificial' AND score < 0.2) al FROM c),
    x AS (SELECT c.*, row_number() OVER (PARTITION BY src ORDER BY score DESC, cell_id) k1, row_number() OVER (PARTITION BY src ORDER BY score, cell_id) k2 FROM c)"""


@query(CALLED + """ SELECT cell_id FROM x, n WHERE NOT include_in_training
    OR (src = 'real' AND CASE WHEN rd * 3 <= r THEN "call" = 'doublet' ELSE k1 <= floor(0.2 * r) END)
    OR (src = 'artificial' AND CASE WHEN al * 4 <= a THEN score < 0.2 ELSE k2 <= floor(0.1 * a) END)""", "scored")
def fil10_training_exclusions(s, d):
    return threshold.training_exclusions(scored(s, d).withColumn("call", F.when(F.col("score") > 0.55, "doublet").otherwise("singlet")))


@query("SELECT vec_id::VARCHAR cell_id, label = 9 AS \"known\" FROM embeddings")
def fil11_known_doublets(s, d):
    return embeddings(s, d).select("cell_id", (F.col("label") == 9).alias("known"))


# ---------------------------------------------------------------- joins


@query('SELECT c.cell_id, coalesce(n, 0)::BIGINT n FROM cells c LEFT JOIN (SELECT cell_id, count(*) n FROM counts WHERE "count" > 60 GROUP BY cell_id) USING (cell_id)', "cells counts")
def jn1_lookup_with_zeros(s, d):
    n = counts(s, d).where("count > 60").groupBy("cell_id").agg(F.count("*").alias("n"))
    return cells(s, d).join(n, "cell_id", "left").select("cell_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT cell_id, \"cluster\" FROM cells WHERE cell_id IN (SELECT cell_id FROM counts WHERE feature = '7')", "cells counts")
def jn2_semi_join(s, d):
    return cells(s, d).join(counts(s, d).where("feature = '7'"), "cell_id", "left_semi").select("cell_id", "cluster")


@query("SELECT cell_id, \"cluster\" FROM cells WHERE cell_id NOT IN (SELECT cell_id FROM counts WHERE feature = '7')", "cells counts")
def jn3_anti_join(s, d):
    return cells(s, d).join(counts(s, d).where("feature = '7'"), "cell_id", "left_anti").select("cell_id", "cluster")


@query('SELECT f.seqname, f.s AS "start", f.e AS "end", f."name" FROM fragments f WHERE NOT EXISTS (SELECT 1 FROM exclusion x WHERE x.seqname = f.seqname AND f.s < x.e AND x.s < f.e)', "fragments exclusion")
def jn4_interval_anti_join(s, d):
    return intervals.outside(fragments(s, d), exclusion(s)).select("seqname", "start", "end", "name")


COVER = """WITH ev AS (SELECT "name", seqname, s p, 1 d FROM fragments UNION ALL SELECT "name", seqname, e, -1 FROM fragments),
    g AS (SELECT "name", seqname, p, sum(d) d FROM ev GROUP BY ALL),
    cv AS (SELECT "name", seqname, p s, lead(p) OVER w e, sum(d) OVER w c FROM g WINDOW w AS (PARTITION BY "name", seqname ORDER BY p)),
    lo AS (SELECT min(s) a FROM fragments), wn AS (SELECT t.seqname, a + i * 86400 ws, a + i * 86400 + 43200 we, t.seqname || '-' || i window_id FROM lo, range(0, 30) r(i), (SELECT DISTINCT seqname FROM fragments) t)"""


def _windows(s: SparkSession, d: str) -> DataFrame:
    f = fragments(s, d)
    a = f.agg(F.min("start").alias("a")).first()["a"]
    w = f.select("seqname").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(29))))
    return w.select(F.concat_ws("-", "seqname", "i").alias("window_id"), "seqname", (F.lit(a) + F.col("i") * 86400).alias("start"), (F.lit(a) + F.col("i") * 86400 + 43200).alias("end"))


@query(COVER + ' SELECT "name", window_id, max(c)::BIGINT cov FROM cv JOIN wn ON cv.seqname = wn.seqname AND s < we AND ws < e AND c > 0 GROUP BY ALL', "fragments")
def jn5_window_maxima(s, d):
    return intervals.window_coverage(intervals.coverage(fragments(s, d)), _windows(s, d))


KNN = """WITH p AS (SELECT a.cell_id, b.cell_id nbr_id, sqrt(list_sum([(x - y) ** 2 for x, y in list_zip(a.vec, b.vec)])) distance FROM vectors a JOIN vectors b ON a.cell_id <> b.cell_id)"""
KNN = KNN.replace("sqrt(list_sum([(x - y) ** 2 for x, y in list_zip(a.vec, b.vec)]))", "list_distance(a.vec, b.vec)")
KNN += ', knn AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY distance, nbr_id)::INT AS "rank" FROM p)'


@query(KNN + ' SELECT cell_id, "rank", nbr_id, round(distance, 6) distance FROM knn WHERE "rank" <= 10', "vectors")
def jn6_knn(s, d):
    return rounded(neighbors.nearest(embeddings(s, d), 10))


@query(KNN + ', r AS (SELECT cell_id, avg((label = 9)::INT) proportion FROM knn JOIN (SELECT cell_id nbr_id, label FROM vectors) USING (nbr_id) WHERE "rank" <= 20 GROUP BY cell_id) SELECT cell_id, round(proportion, 6) proportion FROM r', "vectors")
def jn7_neighbour_share(s, d):
    v = embeddings(s, d)
    near = neighbors.nearest(v, 20).join(v.select(F.col("cell_id").alias("nbr_id"), (F.col("label") == 9).cast("int").alias("k")), "nbr_id")
    return near.groupBy("cell_id").agg(rnd(F.avg("k")).alias("proportion"))


@query(KNN + ' SELECT cell_id, round(distance, 6) radius FROM knn WHERE "rank" = 15', "vectors")
def jn8_kth_distance(s, d):
    return rounded(neighbors.kth_distance(embeddings(s, d), 15))


@query(KNN + """, r AS (SELECT cell_id, distance * 1.00000001 radius FROM knn WHERE "rank" = 15), v AS (SELECT * FROM vectors WHERE label >= 7)
    SELECT r.cell_id, count(v.cell_id) n FROM r JOIN vectors q USING (cell_id) LEFT JOIN v ON list_distance(q.vec, v.vec) <= radius GROUP BY r.cell_id""", "vectors")
def jn9_within_own_radius(s, d):
    v = embeddings(s, d)
    q = v.join(neighbors.kth_distance(v, 15), "cell_id").withColumn("radius", F.col("radius") * 1.00000001)
    return neighbors.within_radius(q, v.where("label >= 7"))


@query('WITH c AS (SELECT DISTINCT "cluster" c FROM cells) SELECT a.c c1, b.c c2, d.c c3 FROM c a JOIN c b ON a.c < b.c JOIN c d ON b.c < d.c', "cells")
def jn10_cluster_triplets(s, d):
    c = cells(s, d).select("cluster").distinct()
    a, b, e = (c.select(F.col("cluster").alias(n)) for n in ("c1", "c2", "c3"))
    return a.join(b, F.expr("c1 < c2")).join(e, F.expr("c2 < c3"))


@query('WITH p AS (SELECT "cluster" c, count(*) / sum(count(*)) OVER () p FROM cells GROUP BY "cluster") SELECT a.c type1, b.c type2, round(a.p * b.p, 8) share FROM p a, p b', "cells")
def jn11_outer_product(s, d):
    p = cells(s, d).groupBy("cluster").count().withColumn("p", F.col("count") / F.sum("count").over(Window.partitionBy()))
    a, b = p.select(F.col("cluster").alias("type1"), F.col("p").alias("p1")), p.select(F.col("cluster").alias("type2"), F.col("p").alias("p2"))
    return a.crossJoin(b).select("type1", "type2", rnd(F.col("p1") * F.col("p2"), 8).alias("share"))  # clusters by clusters


PAIRS = "WITH p AS (SELECT a.cell_id cell1, b.cell_id cell2 FROM cells a JOIN cells b ON b.cell_id::BIGINT = a.cell_id::BIGINT + 1)"


def _next_pairs(s: SparkSession, d: str) -> DataFrame:
    c = cells(s, d).select("cell_id")
    return c.select(F.col("cell_id").alias("cell1"), (F.col("cell_id").cast("long") + 1).cast("string").alias("cell2")).join(c.withColumnRenamed("cell_id", "cell2"), "cell2", "left_semi").select("cell1", "cell2")


@query(PAIRS + """ SELECT 'dbl.' || cell1 || '+' || cell2 cell_id, feature, sum("count") "count" FROM (SELECT p.*, feature, "count" FROM p JOIN counts ON cell_id = cell1 UNION ALL SELECT p.*, feature, "count" FROM p JOIN counts ON cell_id = cell2) GROUP BY cell1, cell2, feature""", "cells counts")
def jn12_pair_sums(s, d):
    return simulate.create_doublets(counts(s, d), _next_pairs(s, d), resample=0, half=0)


EXCLUSIVE = """WITH n AS (SELECT count(*) n FROM cells), ones AS (SELECT cell_id, feature FROM counts WHERE "count" >= 1),
    f AS (SELECT feature, count(*) k, round(count(*) / any_value(n.n) * (1 - count(*) / any_value(n.n)), 12) v, count(*) / any_value(n.n) p FROM ones, n GROUP BY feature),
    t AS (SELECT * FROM f ORDER BY v DESC, feature LIMIT 30),
    b AS (SELECT a.feature f1, b.feature f2, count(*) n12 FROM ones a JOIN ones b USING (cell_id) WHERE a.feature < b.feature GROUP BY ALL),
    e AS (SELECT x.feature f1, y.feature f2, x.k + y.k - 2 * coalesce(n12, 0) obs, x.p * (1 - y.p) + y.p * (1 - x.p) prob, n.n FROM n, t x JOIN t y ON x.feature < y.feature LEFT JOIN b ON b.f1 = x.feature AND b.f2 = y.feature)"""


@query(EXCLUSIVE + " SELECT f1, f2, obs, round(prob, 8) prob FROM e", "counts cells")
def jn13_exclusive_pairs(s, d):
    n = cells(s, d).count()
    return coexpression.exclusive_pairs(*coexpression.detected(counts(s, d), n, 1.0, 30), n).select("f1", "f2", "obs", rnd("prob", 8).alias("prob"))


@query("""WITH m AS (SELECT "cluster" c, feature f, avg("count") a FROM counts JOIN cells USING (cell_id) GROUP BY ALL)
    SELECT x.c "query", y.c source1, z.c source2, count(*) n FROM m x JOIN m y ON x.f = y.f AND x.c <> y.c JOIN m z ON x.f = z.f AND z.c <> x.c AND z.c < y.c WHERE sign(round(x.a - y.a, 6)) = sign(round(x.a - z.a, 6)) GROUP BY ALL""", "counts cells")
def jn14_joined_comparisons(s, d):
    m = counts(s, d).join(cells(s, d), "cell_id").groupBy(F.col("cluster").alias("c"), F.col("feature").alias("f")).agg(F.avg("count").alias("a"))
    x, y, z = m.alias("x"), m.alias("y"), m.alias("z")
    j = x.join(y, F.expr("x.f = y.f AND x.c <> y.c")).join(z, F.expr("x.f = z.f AND z.c <> x.c AND z.c < y.c")).where(F.signum(F.round(F.col("x.a") - F.col("y.a"), 6)) == F.signum(F.round(F.col("x.a") - F.col("z.a"), 6)))
    return j.groupBy(F.col("x.c").alias("query"), F.col("y.c").alias("source1"), F.col("z.c").alias("source2")).agg(F.count("*").alias("n"))


SUMMED = f"""WITH nm AS (SELECT DISTINCT "name" n FROM fragments), p AS (SELECT a.n || '+' || b.n pair, a.n n1, b.n n2 FROM nm a JOIN nm b ON b.n::BIGINT = a.n::BIGINT + 1),
    frag AS (SELECT pair "name", seqname, s, e FROM fragments f JOIN p ON f."name" IN (n1, n2) WHERE e - s <= {WIDEST}),"""


@query(SUMMED + LOCI + ' SELECT "name" pair, seqname, s AS "start", e AS "end", depth FROM loci', "fragments")
def jn15_summed_coverage(s, d):
    f = intervals.narrow(fragments(s, d), WIDEST)
    n = f.select("name").distinct()
    pairs = n.select(F.col("name").alias("name1"), (F.col("name").cast("long") + 1).cast("string").alias("name2")).join(n.withColumnRenamed("name", "name2"), "name2", "left_semi")
    pairs = pairs.select(F.concat_ws("+", "name1", "name2").alias("pair"), "name1", "name2")
    return intervals.deep_runs(intervals.summed_coverage(intervals.coverage(f), pairs), 3, by=("pair",))


# ---------------------------------------------------------------- aggregates


@query('SELECT cell_id, sum("count") lsizes FROM counts GROUP BY cell_id', "counts")
def agg1_library_sizes(s, d):
    return matrix.library_sizes(counts(s, d)).select("cell_id", "lsizes")


@query('SELECT feature, sum("count") total, round(sum("count") / (SELECT count(*) FROM cells), 6) mean FROM counts GROUP BY feature', "counts cells")
def agg1_feature_means(s, d):
    return matrix.feature_totals(counts(s, d), cells(s, d).count()).select("feature", "total", rnd("mean").alias("mean"))


@query('SELECT cell_id, count(*) FILTER ("count" > 0) nfeatures, count(*) FILTER ("count" > 2) "nAbove2" FROM counts GROUP BY cell_id', "counts")
def agg2_conditional_counts(s, d):
    return matrix.library_sizes(counts(s, d)).select("cell_id", "nfeatures", "nAbove2")


@query("""SELECT "cluster", count(*) FILTER (sample = '0') "0", count(*) FILTER (sample = '1') "1", count(*) FILTER (sample = '2') "2", count(*) FILTER (sample = '3') "3", count(*) FILTER (sample = '4') "4" FROM cells GROUP BY "cluster\"""", "cells")
def agg3_cross_table(s, d):
    return reshape.cross_table(cells(s, d), "cluster", "sample")


@query('SELECT "cluster", feature, sum("count") total, round(sum("count") / any_value(n), 6) mean FROM counts JOIN cells USING (cell_id) JOIN (SELECT "cluster", count(*) n FROM cells GROUP BY 1) USING ("cluster") GROUP BY "cluster", feature', "counts cells")
def agg4_pseudobulk(s, d):
    return rounded(matrix.by_cluster(counts(s, d), cells(s, d)))


@query("SELECT cell_id, 'g' || (feature::INT % 10) feature, sum(\"count\") \"count\" FROM counts GROUP BY ALL", "counts")
def agg5_meta_features(s, d):
    c = counts(s, d)
    groups = c.select("feature").distinct().withColumn("group", F.concat(F.lit("g"), (F.col("feature").cast("int") % 10).cast("string")))
    return matrix.by_feature_group(c, groups)


@query('SELECT "cluster", median(score) med, round(avg(score), 6) mean, round(quantile_cont(score, 0.9), 9) q9, min(score) low, max(score) high FROM scored GROUP BY "cluster"', "scored")
def agg6_split_apply(s, d):
    return scored(s, d).groupBy("cluster").agg(F.median("score").alias("med"), rnd(F.avg("score")).alias("mean"), rnd(F.percentile("score", F.lit(0.9)), 9).alias("q9"), F.min("score").alias("low"), F.max("score").alias("high"))


@query('SELECT "cluster", sample, round(sum(score), 4) total, round(avg(difficulty), 6) difficulty FROM scored GROUP BY ALL', "scored")
def agg7_two_keys(s, d):
    return scored(s, d).groupBy("cluster", "sample").agg(rnd(F.sum("score"), 4).alias("total"), rnd(F.avg("difficulty")).alias("difficulty"))


@query('SELECT "name", count(*) n, sum(e - s)::BIGINT width FROM fragments GROUP BY "name"', "fragments")
def agg8_over_chromosomes(s, d):
    return fragments(s, d).groupBy("name").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("width"))


@query('SELECT "cluster", round(sum(score * difficulty) / sum(difficulty), 6) mean FROM scored GROUP BY "cluster"', "scored")
def agg9_weighted_mean(s, d):
    return scored(s, d).groupBy("cluster").agg(rnd(F.sum(F.col("score") * F.col("difficulty")) / F.sum("difficulty")).alias("mean"))


@query('SELECT sample, round(median(score), 9) mean FROM scored GROUP BY sample', "scored")
def agg10_trimmed_mean(s, d):
    return scored(s, d).groupBy("sample").agg(rnd(F.median("score"), 9).alias("mean"))


MAD = """WITH m AS (SELECT sample, median(score) med FROM scored WHERE src = 'real' GROUP BY sample),
    v AS (SELECT sample, any_value(med) med, 1.4826 * median(CASE WHEN score > med THEN score - med END) mad FROM scored JOIN m USING (sample) WHERE src = 'real' GROUP BY sample)"""


@query(MAD + " SELECT sample, round(med, 9) \"median\", round(mad, 9) mad FROM v", "scored")
def agg11_positive_mad(s, d):
    return rounded(threshold.mad_thresholds(scored(s, d)).select("sample", "median", "mad"), 9)


@query('SELECT count(DISTINCT cell_id) cells, count(DISTINCT feature) features FROM counts', "counts")
def agg12_distinct(s, d):
    return counts(s, d).agg(F.count_distinct("cell_id").alias("cells"), F.count_distinct("feature").alias("features"))


def _origins(s: SparkSession, d: str) -> DataFrame:
    v = embeddings(s, d)
    near = neighbors.nearest(v, 10).join(v.select(F.col("cell_id").alias("nbr_id"), F.when(F.col("label") >= 4, F.col("label").cast("string")).alias("nbr_origin")), "nbr_id")
    return near.select("cell_id", "distance", "nbr_origin")


@query(KNN + """, c AS (SELECT cell_id, label o, count(*) n, min(distance) d FROM knn JOIN (SELECT cell_id nbr_id, label FROM vectors) USING (nbr_id) WHERE "rank" <= 10 AND label >= 4 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY n DESC) rn, max(n) OVER (PARTITION BY cell_id) mx, row_number() OVER (PARTITION BY cell_id ORDER BY d) rd FROM c),
    g AS (SELECT cell_id, count(*) FILTER (n = mx) ties, any_value(o) FILTER (rn = 1) top, any_value(o) FILTER (rd = 1) near, min(d) FILTER (rd = 1) d1, min(d) FILTER (rd = 2) d2 FROM r GROUP BY cell_id)
    SELECT v.cell_id, (CASE WHEN ties > 1 THEN near ELSE top END)::VARCHAR "mostLikelyOrigin", coalesce(ties > 1 AND (d2 - d1) / d1 <= 0.2, FALSE) "originAmbiguous" FROM vectors v LEFT JOIN g USING (cell_id)""", "vectors")
def agg13_most_likely_origins(s, d):
    return expected.most_likely_origins(_origins(s, d))


RATES = """, a AS (SELECT count(*) FILTER (src = 'real') r, count(*) FILTER ("type" = 'doublet') d, count(*) FILTER ("type" = 'real' AND src = 'real' AND include_in_training) n FROM scored),
    b AS (SELECT t threshold, count(*) FILTER (src = 'real' AND score >= t) r1, count(*) FILTER ("type" = 'doublet' AND score >= t) d1, count(*) FILTER ("type" = 'real' AND src = 'real' AND include_in_training AND score >= t) n1 FROM scored, t GROUP BY t),
    c AS (SELECT threshold, (d - d1) / d "FNR", n1 / n "FPR", CASE WHEN n1 + d1 > 0 THEN n1 / (n1 + d1) ELSE 0 END "FDR", 1 + r1 x, 1 + r * greatest(0, 0.06) lo, 1 + r * 0.14 hi FROM a, b),
    z AS (SELECT *, CASE WHEN x BETWEEN lo AND hi THEN 0 ELSE least(abs(x - lo) / lo, abs(x - hi) / hi) END dev FROM c)
    SELECT threshold, round("FNR", 6) "FNR", round("FDR", 6) "FDR", round("FPR", 6) "FPR", round(dev, 6) dev, round(dev * dev + "FNR" + "FPR", 6) cost FROM z"""


@query("WITH t AS (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE t)" + RATES, "scored")
def agg14_error_rates(s, d):
    return rounded(threshold.sweep(scored(s, d), 0.1, 0.04, grid=[0.25, 0.5, 0.75]))


@query("WITH t AS (SELECT i / 100.0::DOUBLE t FROM range(101) r(i))" + RATES, "scored")
def agg15_threshold_grid(s, d):
    return rounded(threshold.sweep(scored(s, d), 0.1, 0.04, grid=[k / 100 for k in range(101)]))


@query("WITH t AS (SELECT DISTINCT score t FROM scored)" + RATES, "scored")
def agg15_every_threshold(s, d):
    return rounded(threshold.sweep(scored(s, d), 0.1, 0.04))


EXPECT = 'WITH z AS (SELECT "cluster" c, count(*) n, sum(count(*)) OVER () t FROM cells GROUP BY 1)'


@query(EXPECT + " SELECT a.c type1, b.c type2, a.c || '+' || b.c combination, round(2 * a.n * b.n / a.t * 0.1, 6) expected FROM z a JOIN z b ON a.c < b.c", "cells")
def agg16_expected_doublets(s, d):
    return rounded(expected.expected_doublets(cells(s, d), 0.1))


@query(EXPECT + " SELECT a.c || '+' || b.c combination, round(CASE WHEN a.c = b.c THEN 1 ELSE 2 END * a.n * b.n / a.t * (0.008 * a.t / 1000), 6) expected FROM z a JOIN z b ON a.c <= b.c", "cells")
def agg16_with_homotypic(s, d):
    return rounded(expected.expected_doublets(cells(s, d), heterotypic=False).select("combination", "expected"))


@query(EXPECT + " SELECT round(sum(n * n) / any_value(t * t), 8) prop_homotypic FROM z", "cells")
def agg17_homotypic_share(s, d):
    return rounded(expected.homotypic_share(cells(s, d)), 8)


@query("WITH n AS (SELECT sample, count(*) n FROM scored WHERE src = 'real' GROUP BY sample) SELECT round(sum(0.008 * n / 1000 * n) / sum(n), 8) dbr FROM n", "scored")
def agg18_global_rate(s, d):
    return rounded(expected.global_rate(scored(s, d)), 8)


@query("WITH z AS (SELECT \"cluster\" c, count(*) n, sum(count(*)) OVER () t FROM scored WHERE src = 'real' GROUP BY 1) SELECT round(sum(2 * a.n * b.n / a.t * 0.1) / any_value(a.t), 8) dbr FROM z a JOIN z b ON a.c < b.c", "scored")
def agg19_heterotypic_rate(s, d):
    return rounded(expected.heterotypic_rate(scored(s, d), 0.1), 8)


@query("WITH p AS (SELECT avg((src = 'artificial')::INT) p FROM scored) SELECT round((1 - avg((score < p)::INT)) * 0.1, 8) dbr FROM scored, p WHERE src = 'artificial'", "scored")
def agg19_rate_without_clusters(s, d):
    return rounded(expected.heterotypic_rate(scored(s, d).drop("cluster"), 0.1), 8)


PAIRSTATS = """WITH z AS (SELECT sample, "cluster" c, count(*) n, sum(count(*)) OVER (PARTITION BY sample) t FROM scored WHERE src = 'real' GROUP BY sample, "cluster"),
    e AS (SELECT a.sample, a.c || '+' || b.c combination, 2 * a.n * b.n / a.t * 0.1 expected FROM z a JOIN z b ON a.sample = b.sample AND a.c < b.c),
    o AS (SELECT sample, "mostLikelyOrigin" combination, count(*) FILTER (src = 'real' AND score > 0.5) observed, avg(CASE WHEN src = 'artificial' THEN (score <= 0.5)::INT END) "FNR", median(difficulty) difficulty FROM scored GROUP BY sample, "mostLikelyOrigin"),
    s AS (SELECT e.*, coalesce(observed, 0) observed, "FNR", difficulty, abs(expected - coalesce(observed, 0)) deviation FROM e LEFT JOIN o USING (sample, combination))"""


@query("""WITH z AS (SELECT "cluster" c, count(*) n, sum(count(*)) OVER () t FROM scored WHERE src = 'real' GROUP BY 1), e AS (SELECT a.c || '+' || b.c combination, 2 * a.n * b.n / a.t * 0.1 expected FROM z a JOIN z b ON a.c < b.c),
    s AS (SELECT e.*, (SELECT count(*) FROM scored WHERE src = 'real' AND score > 0.5 AND "mostLikelyOrigin" = combination) observed FROM e)
    SELECT combination, observed, round(expected, 6) expected, round(abs(expected - observed), 6) deviation, round(abs(expected - observed) / sum(expected) OVER (), 6) prop_deviation FROM s""", "scored")
def agg20_observed_and_expected(s, d):
    t = scored(s, d).where("src = 'real'")
    out = expected.observed_and_expected(t.where("score > 0.5"), expected.expected_doublets(t, 0.1))
    return rounded(out.select("combination", "observed", "expected", "deviation", "prop_deviation"))


@query(PAIRSTATS + ' SELECT sample, combination, observed, round(expected, 6) expected, round("FNR", 6) "FNR", round(difficulty, 9) difficulty, round(deviation, 6) deviation, round(deviation / sum(expected) OVER (PARTITION BY sample), 6) prop_deviation FROM s', "scored")
def agg21_pair_statistics(s, d):
    out = expected.pair_statistics(scored(s, d), 0.5, 0.1)
    return out.select("sample", "combination", "observed", *[rnd(c, 9 if c == "difficulty" else 6).alias(c) for c in ("expected", "FNR", "difficulty", "deviation", "prop_deviation")])


@query(KNN + """, n AS (SELECT cell_id, "rank" r, distance, (label >= 7)::INT t FROM knn JOIN (SELECT cell_id nbr_id, label FROM vectors) USING (nbr_id) WHERE "rank" <= 10),
    a AS (SELECT cell_id, sum(sqrt(10 - r) / distance * t) / sum(sqrt(10 - r) / distance) weighted, min(distance) d1, min(distance) FILTER (t = 1) dd, min(distance) FILTER (t = 0) dr, sum(t) FILTER (r <= 3) / 3 r3, sum(t) / 10 r10, any_value(t) FILTER (r = 1) c FROM n GROUP BY cell_id)
    SELECT cell_id, round(weighted, 6) weighted, round(d1, 6) "distanceToNearest", round(coalesce(dd, 2 * max(d1) OVER ()), 6) "distanceToNearestDoublet", round(coalesce(dr, 2 * max(d1) OVER ()), 6) "distanceToNearestReal", c "nearestClass", round(r3, 6) ratio_k3, round(r10, 6) ratio_k10 FROM a""", "vectors")
def agg22_knn_features(s, d):
    v = embeddings(s, d)
    types = v.select("cell_id", F.when(F.col("label") >= 7, "doublet").otherwise("real").alias("type"))
    return rounded(neighbors.neighbour_features(neighbors.nearest(v, 10), types, [3, 10]))


@query(f"""WITH k AS (SELECT c.*, i k FROM cells c, range(3) r(i)), n AS (SELECT *, count(*) OVER (PARTITION BY "cluster", k) n, row_number() OVER (PARTITION BY "cluster", k ORDER BY {uniform_sql('meta', 'k', 'cell_id')}, cell_id) r FROM k),
    m AS (SELECT *, least(ceil(0.6 * n), 20) m FROM n) SELECT 'meta.' || "cluster" || '.' || k cell_id, "cluster", feature, round(sum("count") / any_value(m), 6) "count" FROM m JOIN counts USING (cell_id) WHERE r <= m GROUP BY "cluster", k, feature""", "cells counts")
def agg23_meta_cells(s, d):
    return rounded(simulate.meta_cells(counts(s, d), cells(s, d), 3, 20))


LOGTAIL = "ln(list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(prob) + (n - i) * ln(1 - prob)) for i in range(obs, n + 1)]))"


@query(EXCLUSIVE + f""", s AS (SELECT f1, f2, {LOGTAIL} s FROM e),
    w AS (SELECT a.cell_id, -2 * sum(s) raw FROM ones a JOIN ones b USING (cell_id) JOIN s ON f1 = a.feature AND f2 = b.feature GROUP BY a.cell_id),
    g AS (SELECT c.cell_id, coalesce(raw, 0) raw FROM cells c LEFT JOIN w USING (cell_id))
    SELECT cell_id, round((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()), 6) cxds_score FROM g""", "counts cells")
def agg24_coexpression(s, d):
    return rounded(coexpression.coexpression_scores(counts(s, d), cells(s, d), top=30, threshold=1.0))


WELCH = """WITH n AS (SELECT "cluster" c, count(*) n FROM cells GROUP BY 1), f AS (SELECT DISTINCT feature FROM counts),
    q AS (SELECT "cluster" c, feature, sum("count") s, sum("count" * "count") q FROM counts JOIN cells USING (cell_id) GROUP BY ALL),
    m AS (SELECT n.c, f.feature, n.n, coalesce(s, 0) / n.n mean, (coalesce(q, 0) - n.n * (coalesce(s, 0) / n.n) ** 2) / (n.n - 1) / n.n v FROM n CROSS JOIN f LEFT JOIN q ON q.c = n.c AND q.feature = f.feature)
    SELECT a.c "cluster", b.c "other", a.feature, round(a.mean - b.mean, 6) "logFC", round((a.mean - b.mean) / sqrt(a.v + b.v), 6) t, round((a.v + b.v) ** 2 / (a.v ** 2 / (a.n - 1) + b.v ** 2 / (b.n - 1)), 4) df FROM m a JOIN m b ON a.feature = b.feature AND a.c <> b.c"""


@query(WELCH, "counts cells")
def agg25_welch_statistics(s, d):
    t = matrix.pairwise_tests(counts(s, d), cells(s, d))
    return t.select("cluster", "other", "feature", rnd("logFC").alias("logFC"), rnd("t").alias("t"), rnd("df", 4).alias("df"))


@query()
def agg26_markers(s, d):
    return rounded(matrix.markers(counts(s, d), cells(s, d)))


@query('WITH c AS (SELECT cell_id, sum("count") c FROM counts GROUP BY 1), f AS (SELECT feature, sum("count") f FROM counts GROUP BY 1) SELECT cell_id, feature, round(ln(1 + 10000 * "count" / c * (SELECT count(*) FROM c) / f), 6) "count" FROM counts JOIN c USING (cell_id) JOIN f USING (feature)', "counts")
def agg27_tf_idf(s, d):
    return rounded(matrix.tf_idf(counts(s, d)))


@query('WITH m AS (SELECT feature, avg("count") m, stddev_samp("count") s FROM counts GROUP BY 1) SELECT cell_id, feature, round(("count" - m) / s, 6) z FROM counts JOIN m USING (feature)', "counts")
def agg28_z_scores(s, d):
    return rounded(matrix.z_scores(counts(s, d), "count", ["feature"]).select("cell_id", "feature", "z"))


@query('WITH l AS (SELECT cell_id, sum("count") ls FROM counts GROUP BY 1) SELECT cell_id, feature, round(log2("count" / (ls / (SELECT avg(ls) FROM l)) + 1), 6) "count" FROM counts JOIN l USING (cell_id)', "counts")
def agg29_log_normalised(s, d):
    return rounded(matrix.log_normalised(counts(s, d)))


@query("""WITH f AS (SELECT DISTINCT feature FROM counts), n AS (SELECT "cluster" c, count(*) n FROM cells GROUP BY 1),
    p0 AS (SELECT n.c, f.feature, coalesce(sum("count"), 0) / any_value(n.n) m FROM n CROSS JOIN f LEFT JOIN (SELECT * FROM counts JOIN cells USING (cell_id)) x ON x."cluster" = n.c AND x.feature = f.feature GROUP BY n.c, f.feature),
    p AS (SELECT c, feature, rank() OVER (PARTITION BY c ORDER BY m) + (count(*) OVER (PARTITION BY c, m) - 1) / 2 x FROM p0),
    v0 AS (SELECT c.cell_id, f.feature, coalesce("count", 0) v FROM cells c CROSS JOIN f LEFT JOIN counts k ON k.cell_id = c.cell_id AND k.feature = f.feature),
    v AS (SELECT cell_id, feature, rank() OVER (PARTITION BY cell_id ORDER BY v) + (count(*) OVER (PARTITION BY cell_id, v) - 1) / 2 r FROM v0)
    SELECT cell_id, c "cluster", round(corr(r, x), 6) rho FROM v JOIN p USING (feature) GROUP BY ALL""", "counts cells")
def agg30_cluster_correlation(s, d):
    return rounded(matrix.cluster_correlation(counts(s, d), cells(s, d)))


@query("SELECT 'a' sample, cell_id, score FROM scored WHERE src = 'real' UNION ALL SELECT 'b', cell_id, score FROM scored WHERE src <> 'real'", "scored")
def agg31_common_columns(s, d):
    t = scored(s, d)
    return model.common_columns({"a": t.where("src = 'real'").select("cell_id", "score", "difficulty"), "b": t.where("src <> 'real'").select("cell_id", "score", "type")})


# ---------------------------------------------------------------- windows and top-k


@query(KNN + """ SELECT cell_id, "rank", round(avg((label >= 7)::INT) OVER (PARTITION BY cell_id ORDER BY "rank" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) share FROM knn JOIN (SELECT cell_id nbr_id, label FROM vectors) USING (nbr_id) WHERE "rank" <= 5""", "vectors")
def win1_neighbour_prefixes(s, d):
    v = embeddings(s, d)
    near = neighbors.nearest(v, 5).join(v.select(F.col("cell_id").alias("nbr_id"), (F.col("label") >= 7).cast("int").alias("t")), "nbr_id")
    return near.select("cell_id", "rank", rnd(F.avg("t").over(Window.partitionBy("cell_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))).alias("share"))


@query("SELECT cell_id, round(cume_dist() OVER (PARTITION BY sample ORDER BY score), 6) ecdf FROM scored", "scored")
def win2_ecdf(s, d):
    return scored(s, d).select("cell_id", rnd(F.cume_dist().over(Window.partitionBy("sample").orderBy("score"))).alias("ecdf"))


@query("SELECT cell_id, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) scaled FROM scored WINDOW w AS (PARTITION BY sample)", "scored")
def win3_min_max(s, d):
    w = Window.partitionBy("sample")
    return scored(s, d).select("cell_id", rnd((F.col("score") - F.min("score").over(w)) / (F.max("score").over(w) - F.min("score").over(w))).alias("scaled"))


@query("""WITH f AS (SELECT sample, least(median(score) FILTER ("type" = 'real'), median(score) FILTER ("type" <> 'real')) q1, greatest(median(score) FILTER ("type" = 'real'), median(score) FILTER ("type" <> 'real')) q2 FROM scored GROUP BY sample),
    g AS (SELECT median(q1) g1, median(q2) g2 FROM f), p AS (SELECT s.*, g1, g2, CASE WHEN score < q1 THEN 0 WHEN score <= q2 THEN 1 ELSE 2 END p FROM scored s JOIN f USING (sample), g),
    r AS (SELECT cell_id, sample, CASE p WHEN 0 THEN 0 WHEN 1 THEN g1 ELSE g2 END + cume_dist() OVER (PARTITION BY sample, p ORDER BY score) * (CASE p WHEN 0 THEN g1 WHEN 1 THEN g2 - g1 ELSE 1 - g2 END) r FROM p)
    SELECT cell_id, round(r / max(r) OVER (PARTITION BY sample), 6) rescaled FROM r""", "scored")
def win4_rescaled_scores(s, d):
    return rounded(threshold.rescaled_by_sample(scored(s, d)).select("cell_id", "rescaled"))


@query(COVER + ' SELECT "name", seqname, sum(e - s)::BIGINT covered, sum((e - s) * c)::BIGINT bases, max(c)::BIGINT depth FROM cv WHERE c > 0 GROUP BY ALL', "fragments")
def win5_coverage_sweep(s, d):
    w = F.col("end") - F.col("start")
    return intervals.coverage(fragments(s, d)).groupBy("name", "seqname").agg(F.sum(w).alias("covered"), F.sum(w * F.col("cov")).alias("bases"), F.max("cov").alias("depth"))


MERGE = """WITH o AS (SELECT *, max(e) OVER (PARTITION BY seqname ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pm FROM fragments),
    k AS (SELECT *, sum(CASE WHEN pm IS NULL OR s >= pm + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY seqname ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) g FROM o)
    SELECT seqname, min(s) AS "start", max(e) AS "end", count(*) members FROM k GROUP BY seqname, g"""


@query(MERGE.format(gap=0), "fragments")
def win6_merged_ranges(s, d):
    return intervals.reduced(fragments(s, d))


@query("SELECT cell_id, rank() OVER (PARTITION BY sample ORDER BY round(score, 1)) + (count(*) OVER (PARTITION BY sample, round(score, 1)) - 1) / 2 AS \"rank\" FROM scored", "scored")
def win7_average_ranks(s, d):
    return matrix.average_ranks(scored(s, d).withColumn("v", F.round("score", 1)), "v", ["sample"]).select("cell_id", F.col("rank").cast("double").alias("rank"))


ADJ = "WITH r AS (SELECT cell_id, score p, row_number() OVER (ORDER BY score, cell_id) rn, count(*) OVER () n FROM scored)"


@query(ADJ + " SELECT cell_id, round(least(1.0::DOUBLE, min(p * n / rn) OVER (ORDER BY p DESC, rn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) q FROM r", "scored")
def win8_benjamini_hochberg(s, d):
    return rounded(stats.adjusted(scored(s, d).select("cell_id", "score"), "score", "bh", "q").select("cell_id", "q"), 8)


@query(ADJ + " SELECT cell_id, round(least(1.0::DOUBLE, max(p * (n - rn + 1)) OVER (ORDER BY p, rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) q FROM r", "scored")
def win9_holm(s, d):
    return rounded(stats.adjusted(scored(s, d).select("cell_id", "score"), "score", "holm", "q").select("cell_id", "q"), 8)


@query("SELECT sample, min(score) AS \"first\" FROM scored WHERE score > 0.5 GROUP BY sample", "scored")
def win10_first_that_satisfies(s, d):
    return scored(s, d).groupBy("sample").agg(F.min_by("score", F.when(F.col("score") > 0.5, F.col("score"))).alias("first"))


@query(KNN + """, n AS (SELECT k.cell_id, k."rank" r, b.label nl, a.label l FROM knn k JOIN vectors a USING (cell_id) JOIN (SELECT cell_id nbr_id, label FROM vectors) b USING (nbr_id) WHERE k."rank" <= 10)
    SELECT cell_id, round((any_value(l) + sum(nl / (r + 1))) / (1 + sum(1 / (r + 1))), 6) smoothed FROM n GROUP BY cell_id""", "vectors")
def win11_smoothed_by_rank(s, d):
    v = embeddings(s, d)
    return rounded(neighbors.smoothed(neighbors.nearest(v, 10), v.select("cell_id", F.col("label").cast("double").alias("score")), by_rank=True))


INTERLEAVED = """WITH m AS (SELECT "cluster" c, feature, sum("count") / any_value(n) m FROM counts JOIN cells USING (cell_id) JOIN (SELECT "cluster", count(*) n FROM cells GROUP BY 1) USING ("cluster") GROUP BY c, feature),
    r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY m DESC, feature) r FROM m), f AS (SELECT feature, min((r, c)) x FROM r GROUP BY feature)
    SELECT feature FROM f ORDER BY x LIMIT 40"""


@query(INTERLEAVED, "counts cells")
def top0_select_features(s, d):
    return select.select_features(counts(s, d), cells(s, d), 40)


@query('SELECT feature, sum("count") mean FROM counts GROUP BY feature ORDER BY mean DESC, feature LIMIT 25', "counts")
def top1_top_features(s, d):
    return select.top_by_mean(counts(s, d), 25)


@query(INTERLEAVED, "counts cells")
def top2_interleaved_features(s, d):
    return select.interleaved_by_cluster(counts(s, d), cells(s, d), 40).select("feature")


@query()
def top3_with_markers(s, d):
    return select.select_features(counts(s, d), cells(s, d), 40, marker_share=0.5, most_fdr=1.1)


@query(EXCLUSIVE + " SELECT feature, round(p, 8) p FROM t", "counts cells")
def top4_variable_features(s, d):
    return rounded(coexpression.detected(counts(s, d), cells(s, d).count(), 1.0, 30)[1], 8)


RECOVER = KNN + """, kn AS (SELECT cell_id, label = 9 k FROM vectors), rp AS (SELECT knn.cell_id, avg(k.k::INT) proportion FROM knn JOIN (SELECT cell_id nbr_id, k FROM kn) k USING (nbr_id) WHERE "rank" <= 20 GROUP BY 1),
    t AS (SELECT rp.cell_id, proportion, kn.k AS "known", (SELECT count(*) FILTER (k) FROM kn) * 0.375 / 0.625 intra, row_number() OVER (PARTITION BY kn.k ORDER BY proportion DESC, rp.cell_id) r FROM rp JOIN kn USING (cell_id))"""


@query(RECOVER + ' SELECT cell_id FROM t WHERE NOT "known" AND r <= floor(intra)', "vectors")
def top5_predicted_doublets(s, d):
    v = embeddings(s, d)
    return neighbors.recover_doublets(v, v.where("label = 9"), [1, 2, 1], 20).where("predicted").select("cell_id")


@query(PAIRSTATS + " , r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY observed, expected DESC, combination) r FROM s) SELECT sample, combination, observed FROM r WHERE r = 1", "scored")
def top6_best_pair(s, d):
    p = expected.pair_statistics(scored(s, d), 0.5, 0.1)
    return p.withColumn("r", F.row_number().over(Window.partitionBy("sample").orderBy("observed", F.desc("expected"), "combination"))).where("r = 1").select("sample", "combination", "observed")


@query(PAIRSTATS + " SELECT sample, combination FROM s ORDER BY deviation DESC, combination, sample LIMIT 10", "scored")
def top7_ordered_results(s, d):
    return expected.pair_statistics(scored(s, d), 0.5, 0.1).orderBy(F.desc("deviation"), "combination", "sample").limit(10).select("sample", "combination")


@query(SIZES + " SELECT cell_id, lsizes FROM ls ORDER BY lsizes DESC, cell_id LIMIT 100", "counts")
def top8_largest_libraries(s, d):
    return select.largest_libraries(counts(s, d), 100)


@query('SELECT "cluster", count(*) n FROM cells GROUP BY 1 HAVING count(*) >= 0.1 * (SELECT count(*) FROM cells) ORDER BY n DESC, "cluster" LIMIT 3', "cells")
def top9_large_clusters(s, d):
    return select.large_clusters(cells(s, d), 0.1, 3)


@query("SELECT cell_id FROM (SELECT cell_id, row_number() OVER (ORDER BY score DESC, cell_id) r, count(*) OVER () n FROM scored WHERE src = 'real') WHERE r <= floor(0.2 * n)", "scored")
def top10_top_share(s, d):
    real = scored(s, d).where("src = 'real'")
    return real.orderBy(F.desc("score"), "cell_id").limit(int(0.2 * real.count())).select("cell_id")


@query('SELECT * FROM (SELECT DISTINCT feature FROM counts) ORDER BY feature LIMIT 12', "counts")
def top11_first_distinct(s, d):
    return counts(s, d).select("feature").distinct().orderBy("feature").limit(12)


# ---------------------------------------------------------------- sets and shapes


@query("SELECT 'c' part, cell_id FROM cells UNION ALL SELECT 's', cell_id FROM scored WHERE src = 'artificial'", "cells scored")
def set1_union_all(s, d):
    return cells(s, d).select(F.lit("c").alias("part"), "cell_id").unionByName(scored(s, d).where("src = 'artificial'").select(F.lit("s").alias("part"), "cell_id"))


_A, _B = "SELECT cell_id FROM counts WHERE feature = '3'", "SELECT cell_id FROM counts WHERE feature = '4'"


def _sets(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = counts(s, d)
    return c.where("feature = '3'").select("cell_id"), c.where("feature = '4'").select("cell_id")


@query(f"{_A} UNION {_B}", "counts")
def set2_union(s, d):
    a, b = _sets(s, d)
    return a.union(b).distinct()


@query(f"{_A} INTERSECT {_B}", "counts")
def set3_intersect(s, d):
    a, b = _sets(s, d)
    return a.intersect(b)


@query(f"{_A} EXCEPT {_B}", "counts")
def set4_difference(s, d):
    a, b = _sets(s, d)
    return a.subtract(b)


@query("SELECT sample, count(*) n, round(max(score) - min(score), 6) spread FROM scored GROUP BY sample", "scored")
def set5_split_and_combine(s, d):
    def run(rows):
        import pandas as pd

        return pd.DataFrame({"sample": [rows["sample"].iloc[0]], "n": [len(rows)], "spread": [round(rows["score"].max() - rows["score"].min(), 6)]})

    return scored(s, d).select("sample", "score").groupBy("sample").applyInPandas(run, "sample string, n long, spread double")


SYM = EXPECT + """, p AS (SELECT a.c t1, b.c t2, 2 * a.n * b.n / a.t * 0.1 v FROM z a JOIN z b ON a.c < b.c WHERE b.c <> 'BUILDING')"""


@query(SYM + " SELECT a.c type1, b.c type2, CASE WHEN a.c <> b.c THEN coalesce(round(v, 6), 0) END expected FROM z a CROSS JOIN z b LEFT JOIN p ON (t1 = a.c AND t2 = b.c) OR (t1 = b.c AND t2 = a.c)", "cells")
def rsh1_symmetric(s, d):
    return rounded(reshape.symmetric(expected.expected_doublets(cells(s, d), 0.1).where("type2 <> 'BUILDING'"), "expected"))


@query("WITH t AS (SELECT i / 100.0::DOUBLE t FROM range(101) r(i))" + RATES.replace("\n    SELECT threshold, round", "\n, y AS (SELECT threshold, round") + """)
    SELECT threshold, measure, least(1.0::DOUBLE, "value") "value" FROM (UNPIVOT y ON "FNR", "FDR", "FPR", dev, cost INTO NAME measure VALUE "value")""", "scored")
def rsh2_threshold_curves(s, d):
    return rounded(reshape.threshold_curves(scored(s, d), 0.1, dbr_sd=0.04))


@query("""SELECT "type1", round(max("value") FILTER (type2 = 'AUTOMOBILE'), 6) "AUTOMOBILE", round(max("value") FILTER (type2 = 'BUILDING'), 6) "BUILDING", round(max("value") FILTER (type2 = 'FURNITURE'), 6) "FURNITURE", round(max("value") FILTER (type2 = 'HOUSEHOLD'), 6) "HOUSEHOLD", round(max("value") FILTER (type2 = 'MACHINERY'), 6) "MACHINERY"
    FROM (SELECT a.c type1, b.c type2, CASE WHEN a.c <> b.c THEN 2 * a.n * b.n / a.t * 0.1 END "value" FROM (SELECT "cluster" c, count(*) n, sum(count(*)) OVER () t FROM cells GROUP BY 1) a, (SELECT "cluster" c, count(*) n FROM cells GROUP BY 1) b) GROUP BY 1""", "cells")
def rsh3_wide_table(s, d):
    return rounded(reshape.wide(expected.expected_doublets(cells(s, d), 0.1), "expected"))


@query('SELECT "name", seqname, s AS "start", i k FROM fragments, range(1, 4) r(i) WHERE i <= s % 3 + 1', "fragments")
def rsh4_repeated_by_count(s, d):
    return fragments(s, d).select("name", "seqname", "start", F.explode(F.sequence(F.lit(1).cast("long"), F.col("start") % 3 + 1)).alias("k"))


@query("SELECT cell_id, (sample = '1')::INT::DOUBLE sample_1, (sample = '2')::INT::DOUBLE sample_2, (sample = '3')::INT::DOUBLE sample_3, (sample = '4')::INT::DOUBLE sample_4 FROM cells", "cells")
def rsh5_dummies(s, d):
    return reshape.dummies(cells(s, d), "sample").drop("cluster", "sample")


@query("SELECT combination, " + ", ".join(f"list_contains(string_split(combination, '+'), '{c}')::INT::DOUBLE \"in_{c}\"" for c in MARKER_CLUSTERS) + " FROM (SELECT a.c || '+' || b.c combination FROM (SELECT DISTINCT \"cluster\" c FROM cells) a, (SELECT DISTINCT \"cluster\" c FROM cells) b WHERE a.c < b.c)", "cells")
def rsh5_memberships(s, d):
    return enrichment.memberships(expected.expected_doublets(cells(s, d), 0.1).select("combination"))[0]


@query(PAIRSTATS + """, m AS (SELECT combination, avg(observed) o, avg(expected) e FROM s GROUP BY combination), c AS (SELECT DISTINCT "cluster" c FROM cells)
    SELECT a.c type1, b.c type2, CASE WHEN a.c <> b.c THEN round(o, 6) END observed, CASE WHEN a.c <> b.c THEN round(e, 6) END expected, CASE WHEN a.c <> b.c THEN round(log2((o + 1) / (e + 1)), 6) END enrichment
    FROM c a CROSS JOIN c b LEFT JOIN m ON combination = least(a.c, b.c) || '+' || greatest(a.c, b.c)""", "scored")
def rsh6_doublet_map(s, d):
    return rounded(reshape.doublet_map(expected.pair_statistics(scored(s, d), 0.5, 0.1)).select("type1", "type2", "observed", "expected", "enrichment"))


# ---------------------------------------------------------------- intervals


@query(COVER + ' SELECT seqname, c::BIGINT cov, sum(e - s)::BIGINT bases FROM cv WHERE c > 0 GROUP BY ALL', "fragments")
def int1_coverage(s, d):
    return intervals.coverage(fragments(s, d)).groupBy("seqname", "cov").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


@query("WITH frag AS (SELECT * FROM fragments)," + LOCI + ' SELECT "name", seqname, s AS "start", e AS "end", depth FROM loci', "fragments")
def int2_loci_of_three(s, d):
    return intervals.deep_runs(intervals.coverage(fragments(s, d)), 3)


@query(MERGE.format(gap=100), "fragments")
def int3_merged_within_gap(s, d):
    return intervals.reduced(fragments(s, d), gap=100)


@query(FRAG + LOCI + SITES + ' SELECT seqname, s AS "start", e AS "end", n FROM bad WHERE p < 0.01', "fragments")
def int4_frequent_sites(s, d):
    return intervals.without_frequent_sites(intervals.fragment_overlaps(fragments(s, d), least=1, widest=WIDEST, result="loci"))[1].select("seqname", "start", "end", "n")


OVERLAPS = f"""WITH f0 AS (SELECT * FROM fragments f WHERE e - s <= {WIDEST} AND NOT EXISTS (SELECT 1 FROM exclusion x WHERE x.seqname = f.seqname AND f.s < x.e AND x.s < f.e)),
    nm AS (SELECT "name", count(*) u FROM f0 GROUP BY 1 HAVING count(*) >= 20), frag AS (SELECT f0.* FROM f0 JOIN nm USING ("name")),""" + LOCI + SITES + """,
    st AS (SELECT nm."name", u "nFrags", u "uniqFrags", (SELECT count(*) FROM k JOIN bad USING (seqname, site) WHERE k."name" = nm."name" AND p >= 0.01) "nAbove2", (SELECT count(*) FROM loci WHERE loci."name" = nm."name") "total_nAbove2" FROM nm)"""


@query(OVERLAPS + ' SELECT * FROM st', "fragments exclusion")
def int5_fragment_overlaps(s, d):
    return intervals.fragment_overlaps(fragments(s, d), exclude=exclusion(s), least=20, widest=WIDEST)


@query(OVERLAPS + f""", pv AS (SELECT *, {stats.poisson_above_sql('"nAbove2"', 'm')} p FROM (SELECT *, avg("nAbove2") OVER () m FROM st)), r AS (SELECT *, row_number() OVER (ORDER BY p, "name") rn, count(*) OVER () n FROM pv)
    SELECT "name", "nFrags", "uniqFrags", "nAbove2", "total_nAbove2", round(p, 8) p_value, round(least(1.0::DOUBLE, min(p * n / rn) OVER (ORDER BY p DESC, rn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) q_value FROM r""", "fragments exclusion")
def int6_amulet(s, d):
    return rounded(atac.amulet(fragments(s, d), exclude=exclusion(s), least=20, widest=WIDEST), 8)


@query(f"""WITH a AS (SELECT * FROM counts WHERE "count" > 2), k AS (SELECT feature, count(*) FILTER ("count" > 2) k FROM counts GROUP BY 1), p AS (SELECT *, {stats.poisson_above_sql('k', 'm')} p FROM (SELECT *, avg(k) OVER () m FROM k)),
    h AS (SELECT feature, p, row_number() OVER (ORDER BY p, feature) rn, count(*) OVER () n FROM p), j AS (SELECT feature, least(1.0::DOUBLE, max(p * (n - rn + 1)) OVER (ORDER BY p, rn)) adj FROM h),
    c AS (SELECT cells.cell_id, count(x.feature) n FROM cells LEFT JOIN (SELECT a.* FROM a JOIN j USING (feature) WHERE adj > 0.01) x USING (cell_id) GROUP BY 1),
    q AS (SELECT *, {stats.poisson_above_sql('n', 'mu')} p FROM (SELECT *, avg(n) OVER () mu FROM c)), r AS (SELECT *, row_number() OVER (ORDER BY p, cell_id) rn, count(*) OVER () m FROM q)
    SELECT cell_id, n "nAbove2", round(p, 8) p_value, round(least(1.0::DOUBLE, min(p * m / rn) OVER (ORDER BY p DESC, rn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) q_value FROM r""", "counts cells")
def int7_amulet_from_counts(s, d):
    return rounded(atac.amulet_from_counts(counts(s, d), cells(s, d)), 8)


@query(f"""WITH ev0 AS (SELECT "name", seqname, s p, 1 d FROM fragments UNION ALL SELECT "name", seqname, e, -1 FROM fragments), g0 AS (SELECT "name", seqname, p, sum(d) d FROM ev0 GROUP BY ALL),
    c0 AS (SELECT "name", seqname, p, sum(d) OVER w c, lead(p) OVER w np FROM g0 WINDOW w AS (PARTITION BY "name", seqname ORDER BY p)), s0 AS (SELECT *, CASE WHEN lag(np) OVER (PARTITION BY "name", seqname ORDER BY p) = p THEN 0 ELSE 1 END b FROM c0 WHERE c >= 1),
    i0 AS (SELECT *, sum(b) OVER (PARTITION BY "name", seqname ORDER BY p) i FROM s0), r0 AS (SELECT "name" nm, seqname, min(p) s, max(np) e FROM i0 GROUP BY "name", seqname, i),
    k0 AS (SELECT *, row_number() OVER (PARTITION BY nm ORDER BY {uniform_sql('windows', 'nm', 'seqname', 's')}, seqname, s) k FROM r0), frag AS (SELECT 'x' "name", seqname, s, e FROM k0 WHERE k <= 50),"""
       + LOCI + """, o AS (SELECT *, max(e) OVER (PARTITION BY seqname ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pm FROM loci),
    k AS (SELECT *, sum(CASE WHEN pm IS NULL OR s >= pm + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY seqname ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) g FROM o)
    SELECT seqname || '-' || min(s) || '-' || max(e) window_id, seqname, min(s) AS "start", max(e) AS "end" FROM k GROUP BY seqname, g""", "fragments")
def int8_covered_windows(s, d):
    f = fragments(s, d)
    return intervals.covered_windows(intervals.coverage(f), f.select("name").distinct().count(), least=3, most=50)


@query(COVER + ', m AS (SELECT "name", window_id, max(c) c FROM cv JOIN wn ON cv.seqname = wn.seqname AND s < we AND ws < e AND c > 0 GROUP BY ALL) SELECT n."name", wn.window_id, coalesce(c, 0)::BIGINT cov FROM (SELECT DISTINCT "name" FROM fragments) n CROSS JOIN wn LEFT JOIN m ON m."name" = n."name" AND m.window_id = wn.window_id', "fragments")
def int9_window_matrix(s, d):
    f = fragments(s, d)
    return intervals.window_coverage(intervals.coverage(f), _windows(s, d), f).withColumn("cov", F.col("cov").cast("long"))


@query(SUMMED + LOCI + ' SELECT p.pair, count(loci."name") "nAbove2" FROM p LEFT JOIN loci ON loci."name" = p.pair GROUP BY 1', "fragments")
def int10_doublet_loci(s, d):
    n = fragments(s, d).select("name").distinct()
    pairs = n.select(F.col("name").alias("name1"), (F.col("name").cast("long") + 1).cast("string").alias("name2")).join(n.withColumnRenamed("name", "name2"), "name2", "left_semi").select(F.concat_ws("+", "name1", "name2").alias("pair"))
    loci = jn15_summed_coverage(s, d).groupBy("pair").agg(F.count("*").alias("k"))
    return pairs.join(loci, "pair", "left").select("pair", F.coalesce("k", F.lit(0)).alias("nAbove2"))


@query(FRAG + LOCI + ' SELECT "name", count(*) n, sum(e - s)::BIGINT width FROM loci GROUP BY "name"', "fragments")
def int11_loci_by_cell(s, d):
    loci = intervals.deep_runs(intervals.coverage(intervals.narrow(fragments(s, d), WIDEST)), 3)
    return loci.groupBy("name").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("width"))


@query(FRAG + LOCI + ' SELECT "name", seqname, s AS "start", e AS "end" FROM loci WHERE NOT EXISTS (SELECT 1 FROM exclusion x WHERE x.seqname = loci.seqname AND loci.s < x.e AND x.s < loci.e)', "fragments exclusion")
def int12_loci_outside_regions(s, d):
    loci = intervals.deep_runs(intervals.coverage(intervals.narrow(fragments(s, d), WIDEST)), 3)
    return intervals.outside(loci, exclusion(s)).select("name", "seqname", "start", "end")


# ---------------------------------------------------------------- probabilities


@query(f"""WITH k AS (SELECT feature, count(*) FILTER ("count" > 40) k FROM counts GROUP BY 1) SELECT feature, round({stats.poisson_above_sql('k', 'm')}, 8) p FROM (SELECT *, avg(k) OVER () m FROM k)""", "counts")
def prb1_poisson_tail(s, d):
    k = counts(s, d).groupBy("feature").agg(F.count_if(F.col("count") > 40).alias("k"))
    return k.crossJoin(F.broadcast(k.agg(F.avg("k").alias("m")))).select("feature", rnd(stats.poisson_above(F.col("k"), F.col("m")), 8).alias("p"))  # one row


@query(EXCLUSIVE + f" SELECT f1, f2, round({LOGTAIL}, 6) s FROM e", "counts cells")
def prb2_log_binomial_tail(s, d):
    n = cells(s, d).count()
    pairs = coexpression.exclusive_pairs(*coexpression.detected(counts(s, d), n, 1.0, 30), n)
    return pairs.select("f1", "f2", rnd(stats.log_binomial_from_udf(F.col("obs"), F.col("n"), F.col("prob"))).alias("s"))


NB = "exp(lgamma(i + 5) - lgamma(5) - lgamma(i + 1) + 5 * ln(5 / (5 + m)) + i * ln(m / (5 + m)))"


@query(f'WITH k AS (SELECT "cluster" c, count(*) FILTER ("count" > 90) k FROM counts JOIN cells USING (cell_id) GROUP BY 1), n AS (SELECT c, k, avg(k) OVER () m FROM k) SELECT c "cluster", round(1 - list_sum([{NB} for i in range(0, k + 1)]), 8) p, round([{NB} for i in [k]][1], 8) density FROM n', "counts cells")
def prb3_negative_binomial(s, d):
    k = counts(s, d).join(cells(s, d), "cell_id").groupBy("cluster").agg(F.count_if(F.col("count") > 90).alias("k"))
    k = k.withColumn("m", F.avg("k").over(Window.partitionBy()))
    return k.select("cluster", rnd(stats.negative_binomial_above_udf(F.col("k"), F.col("m"), F.lit(5.0)), 8).alias("p"), rnd(stats.negative_binomial_density_udf(F.col("k"), F.col("m"), F.lit(5.0)), 8).alias("density"))


@query()
def prb4_normal(s, d):
    return scored(s, d).select("cell_id", rnd(stats.normal_below_udf(F.col("score") * 4 - 2)).alias("p"), rnd(stats.normal_quantile_udf(F.col("difficulty") * 0.98 + 0.01)).alias("z"))


@query()
def prb5_chi_square(s, d):
    return scored(s, d).select("cell_id", rnd(stats.chi_square_1_above_udf(F.col("score") * 10)).alias("p"))


@query()
def prb6_student_t(s, d):
    return rounded(matrix.pairwise_tests(counts(s, d), cells(s, d)).select("cluster", "other", "feature", "log_p"))


@query(ADJ + " SELECT cell_id, round(least(1.0::DOUBLE, min(p * n / rn) OVER (ORDER BY p DESC, rn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) bh, round(least(1.0::DOUBLE, max(p * (n - rn + 1)) OVER (ORDER BY p, rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 8) holm FROM r", "scored")
def prb7_adjusted_p(s, d):
    t = scored(s, d).select("cell_id", "score")
    t = stats.adjusted(stats.adjusted(t, "score", "bh", "bh"), "score", "holm", "holm")
    return rounded(t.select("cell_id", "bh", "holm"), 8)


@query('SELECT "cluster", round(quantile_cont(score, 0.1), 9) q1, round(quantile_cont(score, 0.9), 9) q9, round(median(score), 9) q5 FROM scored GROUP BY 1', "scored")
def prb8_quantiles(s, d):
    return scored(s, d).groupBy("cluster").agg(rnd(F.percentile("score", F.lit(0.1)), 9).alias("q1"), rnd(F.percentile("score", F.lit(0.9)), 9).alias("q9"), rnd(F.median("score"), 9).alias("q5"))


@query()
def prb9_dispersion(s, d):
    import numpy as np

    rows = expected.pair_statistics(scored(s, d), 0.5, 0.1).select("observed", "expected").collect()
    theta = enrichment.dispersion(np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)) if rows else None
    return s.createDataFrame([(None if theta is None else round(theta, 4),)], "theta double")


BEST = "WITH t AS (SELECT DISTINCT score t FROM scored)" + RATES.replace("SELECT threshold, round(\"FNR\"", ", y AS (SELECT threshold, round(\"FNR\"").replace("+ \"FPR\", 6) cost", "+ \"FPR\", 12) cost") + ") SELECT threshold FROM y ORDER BY cost, threshold LIMIT 1"


@query(BEST, "scored")
def prb10_best_threshold(s, d):
    costs = threshold.sweep(scored(s, d), 0.1, 0.04)
    return costs.select(F.round("cost", 12).alias("cost"), "threshold").orderBy("cost", "threshold").limit(1).select("threshold")


@query(PAIRSTATS + " SELECT sample, combination, round(log2((1 + observed) / (1 + expected)), 6) log2enrich FROM s", "scored")
def prb11_log_enrichment(s, d):
    return expected.pair_statistics(scored(s, d), 0.5, 0.1).select("sample", "combination", rnd(F.log2((1 + F.col("observed")) / (1 + F.col("expected")))).alias("log2enrich"))


@query()
def prb12_intersection_union(s, d):
    return rounded(doubletclusters.source_pairs(matrix.pairwise_tests(matrix.log_normalised(counts(s, d)), cells(s, d))))


# ---------------------------------------------------------------- simulation


QUOTA = EXPECT + """, e AS (SELECT a.c t1, b.c t2, 2 * a.n * b.n / a.t * 0.1 e FROM z a JOIN z b ON a.c < b.c), f AS (SELECT t1, t2, e * 400 / sum(e) OVER () + 5 e FROM e),
    q AS (SELECT t1, t2, t1 || '+' || t2 combination, ceil(e * 400 / sum(e) OVER ())::BIGINT quota FROM f)"""


@query(QUOTA + " SELECT combination, quota FROM q", "cells")
def sim1_pair_quotas(s, d):
    return simulate.pair_quotas(cells(s, d), 400).select("combination", "quota")


@query(QUOTA + "".join(f""", p{k} AS (SELECT combination, quota, cell_id, row_number() OVER (PARTITION BY combination ORDER BY {uniform_sql(f'pair{k}', 'combination', 'cell_id')}, cell_id) - 1 r, count(*) OVER (PARTITION BY combination) m FROM q JOIN cells ON "cluster" = t{k}),
    d{k} AS (SELECT p.*, unnest(range(r, quota, m)) k FROM p{k} p WHERE r < quota)""" for k in (1, 2)) + """, s2 AS (SELECT combination, cell_id, floor(k / m)::BIGINT * m + (k + floor(k / m)::BIGINT) % m k, quota FROM d2)
    SELECT DISTINCT d1.cell_id cell1, s2.cell_id cell2, combination orig_clusters FROM d1 JOIN s2 USING (combination, k) WHERE k < s2.quota""", "cells")
def sim1_cell_pairs(s, d):
    return simulate.cell_pairs(cells(s, d), 400)


@query(PAIRS + f""", i AS (SELECT *, 'dbl.' || cell1 || '+' || cell2 id FROM p), x AS (SELECT id, feature, sum("count") c FROM (SELECT id, feature, "count" FROM i JOIN counts ON cell_id = cell1 UNION ALL SELECT id, feature, "count" FROM i JOIN counts ON cell_id = cell2) GROUP BY ALL),
    y AS (SELECT id, feature, round_even(CASE WHEN {uniform_sql('half', 'id')} < 0.5 THEN c / 2 ELSE c END, 0) c FROM x) SELECT id cell_id, feature, c "count" FROM y WHERE c > 0""", "cells counts")
def sim2_create_doublets(s, d):
    return simulate.create_doublets(counts(s, d), _next_pairs(s, d), resample=0, half=0.5)


@query()
def sim2_adjusted_and_resampled(s, d):
    return simulate.create_doublets(counts(s, d), _next_pairs(s, d), cells(s, d), 0.5, 0.5, 0.5)


@query()
def sim3_artificial_doublets(s, d):
    made, origins = simulate.artificial_doublets(multiplets.checkpointed(counts(s, d)), multiplets.checkpointed(cells(s, d)), 600)
    return made.join(origins, "cell_id").groupBy("cell_id", "origin").agg(F.sum("count").alias("lsizes"))


@query()
def sim4_add_doublets(s, d):
    return simulate.add_doublets(counts(s, d), cells(s, d), 0.05)[1]


# ---------------------------------------------------------------- thresholds and statistics


@query()
def thr1_calls(s, d):
    return threshold.doublet_threshold(scored(s, d), "optim", result="call").select("cell_id", "sample", "threshold", "call")


@query("""WITH m AS (SELECT sum(n * n) / any_value(t * t) h, sum(n) r FROM (SELECT count(*) n, sum(count(*)) OVER () t FROM scored WHERE src = 'real' GROUP BY "cluster")),
    z AS (SELECT "cluster" c, count(*) n, sum(count(*)) OVER () t FROM scored WHERE src = 'real' GROUP BY 1), dr AS (SELECT sum(2 * a.n * b.n / a.t * 0.1) / any_value(a.t) dbr FROM z a JOIN z b ON a.c < b.c),
    t AS (SELECT DISTINCT score t FROM scored), a AS (SELECT count(*) FILTER (src = 'real') r, count(*) FILTER ("type" = 'doublet') d, count(*) FILTER ("type" = 'real' AND src = 'real' AND include_in_training) n FROM scored),
    b AS (SELECT t threshold, count(*) FILTER (src = 'real' AND score >= t) r1, count(*) FILTER ("type" = 'doublet' AND score >= t) d1, count(*) FILTER ("type" = 'real' AND src = 'real' AND include_in_training AND score >= t) n1 FROM scored, t GROUP BY t),
    c AS (SELECT threshold, greatest(0, d - d1 - d * h) / d fnr, n1 / n fpr, 1 + r1 x, 1 + a.r * (dbr - 0.4 * dbr) lo, 1 + a.r * (dbr + 0.4 * dbr) hi FROM a, b, m, dr),
    y AS (SELECT threshold, CASE WHEN x BETWEEN lo AND hi THEN 0 ELSE least(abs(x - lo) / lo, abs(x - hi) / hi) END dev, fnr, fpr FROM c)
    SELECT threshold FROM y ORDER BY round(dev * dev + fnr + fpr, 10), threshold LIMIT 1""", "scored")
def thr2_cost_threshold(s, d):
    return s.createDataFrame([(threshold.best_threshold(scored(s, d), 0.1),)], "threshold double")


@query("SELECT round(quantile_cont(score, 0.9), 9) threshold FROM scored WHERE src = 'real'", "scored")
def thr3_rate_threshold(s, d):
    return rounded(threshold.rate_threshold(scored(s, d), 0.1), 9)


@query(MAD + " SELECT sample, round(med + 1.2815515655446004 * mad, 6) threshold FROM v", "scored")
def thr4_mad_threshold(s, d):
    return rounded(threshold.mad_thresholds(scored(s, d), 0.1).select("sample", "threshold"))


@query(RECOVER + ' SELECT cell_id, round(proportion, 6) proportion, "known", NOT "known" AND r <= floor(intra) AS predicted, round(intra, 6) intra FROM t', "vectors")
def den2_recover_doublets(s, d):
    v = embeddings(s, d)
    return rounded(neighbors.recover_doublets(v, v.where("label = 9"), [1, 2, 1], 20))


@query(KNN + """, r AS (SELECT cell_id, distance * 1.00000001 radius FROM knn WHERE "rank" = 20), v AS (SELECT * FROM vectors WHERE label >= 7),
    c AS (SELECT r.cell_id, count(v.cell_id) n FROM r JOIN vectors q USING (cell_id) LEFT JOIN v ON list_distance(q.vec, v.vec) <= radius GROUP BY r.cell_id)
    SELECT cell_id, round(n / (SELECT count(*) FROM v) / (20 / (SELECT count(*) FROM vectors)), 6) density FROM c""", "vectors")
def den1_density_on_coordinates(s, d):
    v = embeddings(s, d)
    return rounded(neighbors.density_scores(v, v.where("label >= 7"), 20))


@query()
def den1_doublet_density(s, d):
    return density.doublet_density(multiplets.checkpointed(counts(s, d)), multiplets.checkpointed(cells(s, d)), 20, 10)


@query()
def clu1_doublet_clusters(s, d):
    return rounded(doubletclusters.doublet_clusters(multiplets.checkpointed(counts(s, d)), multiplets.checkpointed(cells(s, d)), all_pairs=False))


@query(PAIRSTATS + f""", g AS (SELECT combination, sum(observed)::BIGINT o, sum(expected) e FROM s GROUP BY 1), p AS (SELECT combination, log2((1 + o) / (1 + e)) l, CASE WHEN o >= e THEN {stats.poisson_above_sql('o - 1', 'e')} ELSE 1 END p FROM g),
    r AS (SELECT *, row_number() OVER (ORDER BY p, combination) rn, count(*) OVER () n FROM p)
    SELECT combination, round(l, 6) log2enrich, round(p, 8) p_value, round(least(1.0::DOUBLE, max(p * (n - rn + 1)) OVER (ORDER BY p, rn)), 8) "FDR" FROM r""", "scored")
def ml12_pairwise_enrichment(s, d):
    out = enrichment.pairwise_enrichment(expected.pair_statistics(scored(s, d), 0.5, 0.1))
    return out.select("combination", rnd("log2enrich").alias("log2enrich"), rnd("p_value", 8).alias("p_value"), rnd("FDR", 8).alias("FDR"))


@query()
def ml12_other_tests(s, d):
    p = expected.pair_statistics(scored(s, d), 0.5, 0.1)
    out = None
    for test in ("binom", "nbinom", "chisq"):
        part = enrichment.pairwise_enrichment(p, test).withColumn("test", F.lit(test))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query()
def ml11_stickiness(s, d):
    return rounded(enrichment.stickiness(expected.pair_statistics(scored(s, d), 0.5, 0.1)), 4)


@query()
def ml10_difficulty_regression(s, d):
    return rounded(enrichment.pairwise_enrichment(expected.pair_statistics(scored(s, d), 0.5, 0.1), difficulty=True), 4)


# ---------------------------------------------------------------- reduction, clustering and models


@query()
def ml1_principal_components(s, d):
    return reduce.principal_components(counts(s, d), cells(s, d), 10)


@query()
def ml2_latent_semantic(s, d):
    return reduce.latent_semantic(counts(s, d), cells(s, d), 10)


@query()
def ml3_processings(s, d):
    c, n, out = multiplets.checkpointed(counts(s, d)), multiplets.checkpointed(cells(s, d)), None
    for name in reduce.PROCESSINGS:
        part = reduce.PROCESSINGS[name](c, n, 5).select("cell_id", F.lit(name).alias("processing"), "vec")
        out = part if out is None else out.union(part)
    return out


@query()
def ml4_projected_sums(s, d):
    c, n = counts(s, d), cells(s, d)
    values = matrix.log_normalised(c)
    names = reduce.feature_names(values)
    rotation = reduce.fit(reduce.dense(values, names, n), names, 8)
    pairs = simulate.random_pairs(n, 500).withColumn("pair", F.concat_ws("+", "cell1", "cell2"))
    return reduce.spawn_coordinates(c, matrix.size_factors(c), pairs, rotation)


@query()
def ml5_k_means(s, d):
    return cluster.k_means(embeddings(s, d), 8)


@query()
def ml6_fast_clusters(s, d):
    return cluster.fast_clusters(multiplets.checkpointed(counts(s, d)), multiplets.checkpointed(cells(s, d)), n_features=80)


@query()
def ml7_aggregated_features(s, d):
    return cluster.aggregate_features(multiplets.checkpointed(counts(s, d)), cells(s, d), k=20)[0]


@query()
def ml8_boosting(s, d):
    t = scored(s, d).withColumn("initial", F.lit(0.5)).withColumn("x", F.col("score")).select("cell_id", "sample", "src", "type", "x", "difficulty", "initial", "include_in_training")
    return classify.iterative_scores(t, ["x", "difficulty"], iterations=1)


@query()
def ml9_iterative_scores(s, d):
    t = scored(s, d).withColumn("initial", F.col("score")).withColumn("x", F.col("score")).drop("score")
    return classify.iterative_scores(t, ["x", "difficulty"], iterations=3)


@query()
def main_multiplets(s, d):
    e = model.Experiment(counts(s, d), cells(s, d))
    out = multiplets.detect_multiplets(e, clusters="cluster", dims=10, include_pcs=5)
    return out.select("cell_id", "score", "class")


@query()
def main2_direct_classification(s, d):
    return multiplets.direct_classification(model.Experiment(counts(s, d), cells(s, d)), dims=10)


@query()
def main3_clamulet(s, d):
    return atac.clamulet(multiplets.checkpointed(fragments(s, d)), n_artificial=300, least=20, min_count=3, widest=WIDEST)


@query("SELECT 'k' AS \"what\", unnest([3, 10, 15, 20, 25]) \"value\" UNION ALL SELECT 'given', unnest([3, 50])")
def aux1_neighbour_counts(s, d):
    rows = [("k", k) for k in model.neighbour_counts(None, 500)] + [("given", k) for k in model.neighbour_counts([3, 400], 100)]
    return s.createDataFrame(rows, "what string, value int")


@query("SELECT unnest([1500, 8000, 25000, 600, 700]) n")
def aux2_artificial_counts(s, d):
    rows = [(model.artificial_count(*x),) for x in ((None, 500, 3), (None, 10_000, 5), (None, 100_000, 5), (1.5, 400, 2), (700, 400, 2))]
    return s.createDataFrame(rows, "n int")


@query("WITH f AS (SELECT cell_id, -ln(greatest(score, 0.001)) - ln(greatest(difficulty, 0.001)) h FROM scored) SELECT cell_id, round(exp(-h) * (1 + h), 8) p FROM f", "scored")
def aux3_fisher_combination(s, d):
    return scored(s, d).select("cell_id", rnd(stats.fisher_two(F.col("score"), F.col("difficulty")), 8).alias("p"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)



