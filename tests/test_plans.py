"""Statistics, models and plans: against known values, and on generated experiments with known doublets."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from multisift import model
from multisift.functions import boosting, stats
from multisift.operators import cluster, coexpression, doubletclusters, enrichment, expected, matrix, neighbors, select, simulate, threshold
from multisift.plans import density, multiplets
from multisift.sources.mock import mock_experiment


@pytest.fixture(scope="module")
def experiment(spark):
    e = mock_experiment(spark, (90, 110, 80), 100, dbl_rate=0.12, shift=1.0)
    return cut(e)


def cut(e):
    """Generated once and without its lineage."""
    return e.with_(counts=multiplets.checkpointed(e.counts), cells=multiplets.checkpointed(e.cells))


def test_tails():
    x = np.array([0.0, 3, 10, 50])
    exact = [sum(math.comb(60, k) * 0.2**k * 0.8 ** (60 - k) for k in range(int(v), 61)) for v in x]
    assert np.exp(stats.log_binomial_from(x, np.full(4, 60.0), np.full(4, 0.2))) == pytest.approx(exact, rel=1e-9)
    assert np.exp(stats.log_t_two_sided(np.array([2.228138852, 12.7062]), np.array([10.0, 1.0]))) == pytest.approx([0.05, 0.05], rel=1e-5)
    assert stats.negative_binomial_above(np.array([4.0]), np.array([3.0]), np.array([1e9])) == pytest.approx(1 - sum(math.exp(-3) * 3**k / math.factorial(k) for k in range(5)), rel=1e-4)
    assert stats.poisson_quantile(np.array([0.0, 0.5, 0.999]), np.array([3.0, 3.0, 3.0])).tolist() == [0, 3, 10]


def test_poisson_tail_is_precise_when_small(spark):
    row = spark.range(1).select(stats.poisson_above(F.lit(40), F.lit(5.0)).alias("a"), stats.poisson_above(F.lit(999), F.lit(1000.0)).alias("b"), stats.poisson_above(F.lit(-1), F.lit(2.0)).alias("c"), stats.poisson_above(F.lit(2), F.lit(0.0)).alias("d")).first()
    exact = math.fsum(math.exp(-5 + k * math.log(5) - math.lgamma(k + 1)) for k in range(41, 200))
    assert row.a == pytest.approx(exact, rel=1e-9, abs=0) and row.b == pytest.approx(0.50421, abs=1e-4) and row.c == 1 and row.d == 0


def test_adjusted_within_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(g, i, float(round(p, 2))) for g in "ab" for i, p in enumerate(rng.random(120))] + [("a", 999, None)]
    df = spark.createDataFrame(rows, "g string, i int, p double")
    for method in ("bh", "holm"):
        got = {(r.g, r.i): r.q for r in stats.adjusted(df, "p", method, "q", ["g"], parts=7).collect()}
        for g in "ab":
            mine = sorted((p, i) for h, i, p in rows if h == g and p is not None)
            n, best = len(mine), 1.0 if method == "bh" else 0.0
            order = range(n - 1, -1, -1) if method == "bh" else range(n)
            for k in order:
                best = min(best, mine[k][0] * n / (k + 1)) if method == "bh" else max(best, min(1.0, mine[k][0] * (n - k)))
                if (method == "bh" and (k == 0 or mine[k - 1][0] != mine[k][0])) or (method == "holm" and (k == n - 1 or mine[k + 1][0] != mine[k][0])):
                    same = [i for p, i in mine if p == mine[k][0]]
                    assert all(got[g, i] == pytest.approx(best) for i in same)
        assert got["a", 999] is None


def test_argument_checks(spark):
    with pytest.raises(ValueError):
        model.proportion(2, "dbr")
    with pytest.raises(ValueError):
        model.one_of("s", ("split", "single"), "mode")
    with pytest.raises(Exception, match="positive"):
        model.check_counts(spark.createDataFrame([("a", "g", -1.0)], model.COUNTS)).collect()
    assert model.neighbour_counts(10, 8) == [4]


def test_boosting_learns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    fit = boosting.train(x[:400], y[:400], 0.25, 4)
    assert ((fit.predict(x[400:]) > 0.5) == y[400:]).mean() > 0.85


def test_selection_of_features_equals_selection_before(experiment):
    few = select.top_by_mean(experiment.counts, 20)
    a = matrix.log_normalised(experiment.counts.join(few, "feature", "left_semi"))
    b = matrix.log_normalised(experiment.select_features(few).counts)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_communities_are_pure(experiment):
    singlets = experiment.cells.where("type = 'singlet'")
    own = experiment.select_cells(singlets)
    found = cluster.fast_clusters(own.counts, own.cells, n_features=100).join(singlets.select("cell_id", F.col("cluster").alias("true")), "cell_id")
    counts = found.groupBy("cluster", "true").count().collect()
    best = {}
    for r in counts:
        best[r.cluster] = max(best.get(r.cluster, 0), r["count"])
    assert sum(best.values()) > 0.8 * sum(r["count"] for r in counts)


def test_coexpression_is_higher_in_doublets(experiment):
    s = coexpression.coexpression_scores(experiment.counts, experiment.cells, top=60).join(experiment.cells, "cell_id").groupBy("type").agg(F.avg("cxds_score").alias("m"), F.min("cxds_score").alias("a"), F.max("cxds_score").alias("b"))
    by = {r.type: r for r in s.collect()}
    assert min(r.a for r in by.values()) == 0 and max(r.b for r in by.values()) == 1


def test_doublet_cluster_comes_first(spark):
    e = cut(mock_experiment(spark, (60, 60), 80, dbl_rate=0.6, shift=1.5))
    made = simulate.create_doublets(e.counts, simulate.random_pairs(e.cells.where("type = 'singlet' AND cluster = 'cluster1'"), 5), resample=0, half=0)
    assert made.count() > 0
    out = doubletclusters.doublet_clusters(e.counts, e.cells, all_pairs=True).collect()
    assert out[0].cluster == "cluster1+cluster2" and {out[0].source1, out[0].source2} == {"cluster1", "cluster2"} and len(out) == 3
    assert sum(r.prop for r in out) == pytest.approx(1)
    with pytest.raises(ValueError):
        doubletclusters.doublet_clusters(e.counts, e.cells.where("cluster <> 'cluster1'"))


def test_recovery_predicts_near_known(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.3, (40, 3)), rng.normal(4, 0.3, (40, 3)), rng.normal(2, 0.3, (20, 3))])
    points = spark.createDataFrame([(f"c{i}", [float(v) for v in r]) for i, r in enumerate(x)], "cell_id string, vec array<double>")
    out = neighbors.recover_doublets(points, points.where("cast(substr(cell_id, 2) AS int) >= 90"), [1, 1], 10).collect()
    chosen = [int(r.cell_id[1:]) for r in out if r.predicted]
    assert len(chosen) == 10 and all(80 <= i < 90 for i in chosen) and not any(r.known and r.predicted for r in out)


def test_density_is_higher_in_doublets(experiment):
    d = density.doublet_density(experiment.counts, experiment.cells, 20, 10, 1500).join(experiment.cells, "cell_id")
    by = {r.type: r.m for r in d.groupBy("type").agg(F.median("density").alias("m")).collect()}
    assert by["doublet"] > by["singlet"]


def test_thresholds_and_grid_agree(spark, sf):
    from multisift.sources.tables import scored

    s = scored(spark, sf)
    every = {r.threshold: r.cost for r in threshold.sweep(s, 0.1).collect()}
    some = sorted(every)[::9]
    assert all(r.cost == pytest.approx(every[r.threshold]) for r in threshold.sweep(s, 0.1, grid=some).collect())
    assert every[threshold.best_threshold(s.drop("cluster"), 0.1)] <= min(every.values()) + 0.5


def test_enrichment_prefers_the_enriched_pair(spark):
    rows = [("A+B", 40.0, 10.0, 0.5), ("A+C", 9.0, 10.0, 0.4), ("A+D", 8.0, 10.0, 0.3), ("B+C", 11.0, 10.0, 0.6), ("B+D", 10.0, 10.0, 0.2), ("C+D", 9.0, 10.0, 0.4)]
    df = spark.createDataFrame(rows, "combination string, observed double, expected double, difficulty double")
    for test in ("poisson", "binom", "nbinom", "chisq"):
        out = enrichment.pairwise_enrichment(df, test).collect()
        assert out[0].combination == "A+B" and all(0 <= r.p_value <= r.FDR <= 1 for r in out)
    for family in ("quasibinomial", "binomial", "poisson", "nbinom"):
        out = enrichment.stickiness(df, family).collect()
        assert len(out) == 4 and all(r.FDR is not None for r in out)


def test_added_doublets(experiment):
    singlets = experiment.cells.where("type = 'singlet'")
    own = experiment.select_cells(singlets)
    counts, cells = simulate.add_doublets(own.counts, own.cells, 0.1)
    want = expected.expected_doublets(singlets, 0.1).agg(F.sum(F.bround("expected"))).first()[0]
    assert cells.where("type = 'doublet'").count() == want and counts.select("cell_id").distinct().count() == cells.count()


@pytest.mark.parametrize("clusters", ["cluster_known", None])
def test_multiplets_are_found(experiment, clusters):
    known = experiment.with_(cells=experiment.cells.withColumn("cluster_known", F.when(F.col("type") == "singlet", F.col("cluster"))))
    out = multiplets.detect_multiplets(known, clusters=clusters, dbr=0.1, n_artificial=250, dims=10, include_pcs=6).join(experiment.cells.select("cell_id", F.col("type").alias("true")), "cell_id").collect()
    right = sum((r["class"] == "doublet") == (r.true == "doublet") for r in out)
    assert right > 0.8 * len(out) and all(0 <= r.score <= 1 for r in out)


def test_numbers_follow_the_order(spark):
    rows = spark.range(0, 500).select(F.concat(F.lit("c"), (F.col("id") * 7919 % 500).cast("string")).alias("cell_id")).repartition(5)
    got = sorted((r.i, r.cell_id) for r in simulate.numbered_by(rows, "cell_id", "i").collect())
    assert got == list(enumerate(sorted(f"c{i}" for i in range(500))))


def test_mini_batches_find_separate_groups(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(300, 3)) * 0.2 + c for c in ([0, 0, 0], [9, 0, 0], [0, 9, 0], [0, 0, 9])])
    points = spark.createDataFrame([(f"c{i}", [float(v) for v in r]) for i, r in enumerate(x)], "cell_id string, vec array<double>")
    of = {r.cell_id: r.cluster for r in cluster.mini_batch_k_means(points, 24, batch_rows=200).collect()}
    for a in range(4):
        mine, others = {of[f"c{i}"] for i in range(300 * a, 300 * a + 300)}, {of[f"c{i}"] for i in range(1200) if not 300 * a <= i < 300 * a + 300}
        assert not mine & others
    same = {r.cell_id: r.cluster for r in cluster.mini_batch_k_means(points.repartition(7), 24, batch_rows=200).collect()}
    assert len(of) == 1200 and sum(of[i] == same[i] for i in of) > 1190


def test_result_shapes(spark):
    table = spark.createDataFrame([("a", "real", 0.1), ("b", "real", 0.9), ("x", "artificial", 0.8)], "cell_id string, src string, score double")
    cells = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "cell_id string, other int")
    ids = lambda shape: sorted(r.cell_id for r in multiplets.shaped(table, cells, shape).collect())
    assert ids("table") == ["a", "b"] and ids("full") == ["a", "b", "x"] and ids("cells") == ["a", "b", "c"]
    assert {r.cell_id: r.multisift_score for r in multiplets.shaped(table, cells, "cells").collect()} == {"a": 0.1, "b": 0.9, "c": None}
    with pytest.raises(ValueError):
        multiplets.shaped(table, cells, "other")


def test_poisson_tail_sums_all_its_terms(spark):
    cases = [(20, 20.5), (20000, 20000.0), (20150, 20000.5), (299999, 300000.0), (301500, 300000.0), (298500, 300000.0), (2_000_100, 2_000_000.0), (21, 3.0), (19, 1e-3), (40, 1e-20), (0, 800.0), (5, 800.0)]
    df = spark.createDataFrame(cases, "x int, rate double")
    for r in df.select("x", "rate", stats.poisson_above(F.col("x"), F.col("rate")).alias("p")).collect():
        wide = int(40 * math.sqrt(r.rate + r.x)) + 100
        log = [k * math.log(r.rate) - r.rate - math.lgamma(k + 1) for k in range(max(0, r.x - wide), r.x + wide)]
        ks = range(max(0, r.x - wide), r.x + wide)
        exact = math.fsum(math.exp(v) for k, v in zip(ks, log, strict=True) if k > r.x) if r.x + 1 > r.rate else 1 - math.fsum(math.exp(v) for k, v in zip(ks, log, strict=True) if k <= r.x)
        assert r.p == pytest.approx(exact, rel=1e-7, abs=0), r


def test_cluster_correlation_has_all_cells_and_no_others(spark):
    counts = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "y", 1.0), ("stray", "x", 3.0)], "cell_id string, feature string, count double")
    cells = spark.createDataFrame([("a", "k"), ("b", "l"), ("empty", "l")], "cell_id string, cluster string")
    got = {(r.cell_id, r.cluster): r.rho for r in matrix.cluster_correlation(counts, cells).collect()}
    assert got == {("a", "k"): 1, ("a", "l"): 1, ("b", "k"): 1, ("b", "l"): 1, ("empty", "k"): None, ("empty", "l"): None}


def test_boosting_sorts_once_and_finds_the_best_splits(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.column_stack([np.round(rng.normal(size=400), 1), np.floor(rng.normal(size=400)), np.zeros(400), rng.normal(size=400)])
    y = (x[:, 0] + x[:, 3] + rng.normal(size=400) > 0.5).astype(float)

    def tree(grad, hess, rows, depth):
        g, h, best = grad[rows].sum(), hess[rows].sum(), None
        for f in range(x.shape[1]) if depth and len(rows) >= 4 else ():
            for a, b in zip(np.unique(x[rows, f])[:-1], np.unique(x[rows, f])[1:], strict=True):
                low = rows[x[rows, f] <= a]
                gl, hl = grad[low].sum(), hess[low].sum()
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                if hl >= 1 and h - hl >= 1 and gain > 1e-9 and (best is None or gain > best[0]):
                    best = gain, f, (a + b) / 2
        if best is None:
            return np.full(len(x), 0.3 * g / (h + 1))
        low = x[:, best[1]] < best[2]
        return np.where(low, tree(grad, hess, rows[low[rows]], depth - 1), tree(grad, hess, rows[~low[rows]], depth - 1))

    sorts, sort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **k: sorts.append(1) or sort(*a, **k))
    model_ = boosting.Booster(3, subsample=1.0)
    model_.fit(x, y, 2)
    assert len(sorts) == 1
    margin = np.zeros(len(y))
    for _ in range(2):
        p = 1 / (1 + np.exp(-margin))
        margin += tree(y - p, p * (1 - p), np.arange(len(y)), 3)
    assert model_.predict(x) == pytest.approx(1 / (1 + np.exp(-margin)), rel=1e-9)
