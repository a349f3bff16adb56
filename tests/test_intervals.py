"""Interval operators on hand-made and random ranges."""

import random

import pytest

from multisift.operators import atac, intervals
from multisift.sources import fragments as bed

FIXTURE = [(0, 10), (5, 15), (8, 12), (10, 20), (14, 18)]


def frame(spark, ranges, name="b1", seq="c1"):
    return spark.createDataFrame([(seq, a, b, name, 1) for a, b in ranges], "seqname string, start long, end long, name string, score int")


@pytest.mark.parametrize("cut", [3, 7, 1 << 22])
def test_fixture_depths_and_loci(spark, cut):
    cov = intervals.coverage(frame(spark, FIXTURE), cut=cut)
    depth = {}
    for r in cov.collect():
        depth |= dict.fromkeys(range(r.start, r.end), r["cov"])
    assert depth == {p: sum(a <= p < b for a, b in FIXTURE) for p in range(20)}
    for other in (cut, 2, 5):
        assert sorted((r.start, r.end, r.depth) for r in intervals.deep_runs(cov, 3, cut=other).collect()) == [(8, 12, 3), (14, 15, 3)]


@pytest.mark.parametrize("cut", [16, 1 << 22])
def test_random_overlaps(spark, cut):
    rng = random.Random(cut)
    a = [(s := rng.randrange(300), s + rng.randrange(1, 40)) for _ in range(60)]
    b = [(s := rng.randrange(300), s + rng.randrange(1, 60)) for _ in range(40)]
    x, y = frame(spark, a).drop("score"), frame(spark, b).select("seqname", "start", "end")
    got = sorted((r.start, r.end, r.r_start, r.r_end) for r in intervals.overlaps(x, y, cut).collect())
    assert got == sorted((*p, *q) for p in a for q in b if p[0] < q[1] and q[0] < p[1])
    five = y.orderBy("start", "end").limit(5)
    held = [(r.start, r.end) for r in five.collect()]
    for size in (cut, 5):  # ranges shorter and longer than a piece
        left = sorted((r.start, r.end) for r in intervals.outside(x, five, size).collect())
        assert left == sorted(p for p in a if not any(p[0] < q[1] and q[0] < p[1] for q in held))


@pytest.mark.parametrize(("gap", "touching", "expected"), [(0, False, [(0, 10), (10, 20), (25, 30)]), (6, False, [(0, 30)]), (5, False, [(0, 20), (25, 30)]), (0, True, [(0, 20), (25, 30)])])
def test_merging(spark, gap, touching, expected):
    got = intervals.reduced(frame(spark, [(0, 10), (10, 20), (25, 30), (2, 5)]), gap=gap, touching=touching)
    assert sorted((r.start, r.end) for r in got.collect()) == expected


@pytest.mark.parametrize(("gap", "touching"), [(0, False), (0, True), (4, False)])
def test_merging_across_cuts(spark, gap, touching):
    rng = random.Random(gap + touching)
    rows = [(f"c{rng.randrange(2)}", s := rng.randrange(900), s + rng.choice([1, 2, 9, 60])) for _ in range(130)]
    expected = []
    for seq in ("c0", "c1"):
        reach = None
        for _, a, b in sorted(r for r in rows if r[0] == seq):
            if reach is None or (a > reach if touching else a >= reach + gap):
                expected.append([seq, a, b, 0])
                reach = b
            reach = expected[-1][2] = max(reach, b)
            expected[-1][3] += 1
    frame = spark.createDataFrame(rows, "seqname string, start long, end long")
    for cut in (7, 50, 1 << 22):
        got = intervals.reduced(frame, gap=gap, touching=touching, cut=cut)
        assert sorted(map(list, got.select("seqname", "start", "end", "members").collect())) == sorted(expected)


def test_no_window_is_over_a_whole_chromosome(spark):
    """Windows are keyed by the piece, but for those over pieces and over runs that touch a cut."""
    plan = intervals.merged(frame(spark, FIXTURE))._jdf.queryExecution().optimizedPlan().toString()
    assert all("__piece" in line for line in plan.splitlines() if line.strip(" :+-").startswith("Window"))


def test_default_regions_are_left_out(spark):
    f = frame(spark, [(0, 10), (5, 15), (8, 12)]).unionByName(frame(spark, [(0, 10), (5, 15), (8, 12)], seq="chrM")).unionByName(frame(spark, [(0, 10), (5, 15), (8, 12)], seq="X"))
    count = lambda **o: intervals.fragment_overlaps(f, least=1, drop_frequent=False, **o).first()["nAbove2"]
    assert count() == 1 and count(exclude=None) == 3 and count(exclude=bed.default_regions(spark).where("seqname = 'X'")) == 2
    with pytest.raises(ValueError):
        count(exclude="none")


@pytest.mark.parametrize("text", ["c1\t5\n", "c1\tx\t9\n", "c1\t5\t9.5\n", "1\t5\t9\n2\t6\t9\n", "c1\t\t9\n"])
def test_malformed_files_are_refused(spark, tmp_path, text):
    (tmp_path / "f.bed").write_text(text)
    with pytest.raises(ValueError):
        bed.read_fragments(spark, str(tmp_path / "f.bed"))


def test_files_with_other_columns_comments_and_late_faults(spark, tmp_path):
    good = "# head\n" + "".join(f"c1\t{i}\t{i + 5}\tb\n" for i in range(8))
    (tmp_path / "a.bed").write_text(good)
    (tmp_path / "b.bed").write_text(good.replace("\tb\n", "\tb\t.\tmore\n"))
    (tmp_path / "c.bed").write_text(good + "c1\tx\t9\tb\n")
    (tmp_path / "d.bed").write_text("")
    assert {tuple(r)[3:] for n in "ab" for r in bed.read_fragments(spark, str(tmp_path / f"{n}.bed")).collect()} == {("b", 1)}
    with pytest.raises(Exception, match="malformed BED row"):
        bed.read_fragments(spark, str(tmp_path / "c.bed")).collect()
    assert bed.read_fragments(spark, str(tmp_path / "d.bed")).collect() == []


def test_scores_count_reads_unless_unique(spark):
    f = frame(spark, [(0, 100), (50, 120)]).withColumn("score", bed.F.lit(2))
    assert intervals.fragment_overlaps(f, least=1).first()["nAbove2"] == 0
    assert intervals.fragment_overlaps(f, least=1, unique=False, drop_frequent=False).first()["nAbove2"] == 1
    assert intervals.fragment_overlaps(f, least=10).count() == 0


def test_amulet_finds_the_deep_barcode(spark):
    rng = random.Random(1)
    rows = [("c1", s := rng.randrange(1_000_000), s + 200, f"b{k}", 1) for k in range(8) for _ in range(60)]
    rows += [("c1", 2_000_000 + 5000 * i + j, 2_000_300 + 5000 * i + j, "b7", 1) for i in range(6) for j in range(3)]
    f = spark.createDataFrame(rows, "seqname string, start long, end long, name string, score int")
    got = {r["name"]: r for r in atac.amulet(f, least=10).collect()}
    assert got["b7"].nAbove2 == 6 and got["b7"].p_value < 0.01 and all(got[f"b{k}"].nAbove2 <= 1 for k in range(7))
    assert sum(r.p_value < 0.05 for r in got.values()) == 1


def test_files_round_trip(spark, tmp_path):
    f = frame(spark, FIXTURE)
    f.write.option("sep", "\t").csv(str(tmp_path / "f"))
    assert sorted(map(tuple, bed.read_fragments(spark, str(tmp_path / "f")).collect())) == sorted(map(tuple, f.collect()))
    assert bed.default_regions(spark).count() == 7


def test_stream_sees_all_batches(spark, tmp_path):
    from multisift.streaming.overlaps import amulet_stream

    source = str(tmp_path / "in")
    for k in range(2):
        frame(spark, FIXTURE, f"b{k}").write.mode("append").parquet(source)
    stream = spark.readStream.schema(frame(spark, FIXTURE).schema).option("maxFilesPerTrigger", 1).parquet(source)
    amulet_stream(stream, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "cp"), least=1, drop_frequent=False).awaitTermination()
    assert {(r["name"], r.nAbove2) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("b0", 2), ("b1", 2)}
