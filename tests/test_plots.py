"""Pictures of small tables."""

import xml.etree.ElementTree as ET

import pytest

from multisift.sinks import plots

SVG = "{http://www.w3.org/2000/svg}"


def test_heat_map(spark):
    pairs = spark.createDataFrame([("a+b", 4.0, 2.0), ("a+c", 0.0, 3.0), ("b+<c>", 1.0, 1.0)], "combination string, observed double, expected double")
    root = ET.fromstring(plots.heat_map(pairs))
    tiles = [t for t in root.iter(f"{SVG}rect") if t.get("class") == "tile"]
    assert len(tiles) == 16 and {"4.0", "<c>"} <= {t.text for t in root.iter(f"{SVG}text")}
    fill = {(t.get("x"), t.get("y")): t.get("fill") for t in tiles}
    assert sum(f == "#dddddd" for f in fill.values()) == 4 and any(f.endswith("ff") and f != "#ffffff" for f in fill.values())


def test_curves_and_files(spark, tmp_path):
    rows = [(f"c{i}", "artificial" if i % 2 else "real", "doublet" if i % 2 else "real", i / 40, True) for i in range(40)]
    scored = spark.createDataFrame(rows, "cell_id string, src string, type string, score double, include_in_training boolean")
    picture = plots.curves(scored, 0.1, threshold=0.25)
    root = ET.fromstring(picture)
    lines = {t.get("class"): t.get("points").split() for t in root.iter(f"{SVG}polyline")}
    assert set(lines) == {"FNR", "FDR", "FPR", "dev", "cost"} and all(len(p) == 101 for p in lines.values())
    assert [t.get("x1") for t in root.iter(f"{SVG}line")] == ["160.00"]
    plots.save(spark, picture, str(tmp_path / "p"))
    assert plots.load(spark, str(tmp_path / "p")).first().svg == picture


def test_large_tables_are_refused(spark):
    with pytest.raises(ValueError):
        plots._rows(spark.range(plots.MOST + 1))
