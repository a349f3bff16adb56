"""Pictures as SVG text: a heat map of pairs of clusters, and error rates over thresholds.

Both draw tables that are small by nature, a row for each pair of clusters or for each point of a grid, which the driver collects; a
larger one is refused. save() writes a picture through Spark, so it reaches any store that the session does.
"""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reshape import doublet_map, threshold_curves

#: The most rows a picture is drawn of, and the colours of the curves.
MOST = 100_000
COLOURS = {"FNR": "#1b6ca8", "FDR": "#c8553d", "FPR": "#588157", "dev": "#8d6a9f", "cost": "#222222"}
_CELL, _LEFT, _WIDTH, _HEIGHT = 34, 130, 480, 300


def _rows(table: DataFrame) -> list:
    rows = table.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a picture of more than {MOST} rows can't be drawn")
    return rows


def _svg(width: float, height: float, parts: list[str]) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width:g}" height="{height:g}" font-family="sans-serif" font-size="10">' + "".join(parts) + "</svg>"


def _text(x: float, y: float, text: str, anchor: str = "middle", turn: float = 0) -> str:
    spin = f' transform="rotate({turn:g} {x:g} {y:g})"' if turn else ""
    return f'<text x="{x:g}" y="{y:g}" text-anchor="{anchor}"{spin}>{escape(text)}</text>'


def _colour(value: float | None, low: float, high: float) -> str:
    """Blue below zero, red above, the deeper the farther; grey without a value."""
    if value is None:
        return "#dddddd"
    most = max(abs(low), abs(high)) or 1.0
    fade = round(255 * (1 - min(1.0, abs(value) / most)))
    return f"#ff{fade:02x}{fade:02x}" if value >= 0 else f"#{fade:02x}{fade:02x}ff"


def heat_map(pairs: DataFrame, color: str = "enrichment", label: str = "observed", sizes: DataFrame | None = None) -> str:
    """A tile for every two clusters, coloured by `color` and marked with `label`; pairs as for doublet_map()."""
    rows = _rows(doublet_map(pairs, color, label, sizes).orderBy("type1", "type2"))
    names = sorted({r.type1 for r in rows})
    title = {r.type1: getattr(r, "name1", None) or r.type1 for r in rows} if sizes is not None else {n: n for n in names}
    place = {n: i for i, n in enumerate(names)}
    values = [r.color for r in rows if r.color is not None]
    low, high = min(values, default=0.0), max(values, default=0.0)
    parts = []
    for r in rows:
        x, y = _LEFT + place[r.type2] * _CELL, _LEFT + place[r.type1] * _CELL
        parts.append(f'<rect class="tile" x="{x}" y="{y}" width="{_CELL}" height="{_CELL}" fill="{_colour(r.color, low, high)}" stroke="#ffffff"/>')
        if r.label is not None:
            parts.append(_text(x + _CELL / 2, y + _CELL / 2 + 3, r.label))
    for n in names:
        at = _LEFT + place[n] * _CELL + _CELL / 2
        parts += [_text(_LEFT - 6, at + 3, title[n], "end"), _text(at, _LEFT - 6, title[n], "start", -60)]
    size = _LEFT + len(names) * _CELL + 20
    return _svg(size, size, [*parts, _text(size / 2, size - 6, color)])


def curves(scored: DataFrame, dbr: float, dbr_sd: float | None = None, threshold: float | None = None) -> str:
    """A line for each error rate over thresholds from 0 to 1, with the chosen threshold as an upright."""
    by: dict[str, list[tuple[float, float]]] = {}
    for r in _rows(threshold_curves(scored, dbr, dbr_sd=dbr_sd).orderBy("measure", "threshold")):
        by.setdefault(r.measure, []).append((40 + r.threshold * _WIDTH, 20 + (1 - r.value) * _HEIGHT))
    parts = [f'<rect x="40" y="20" width="{_WIDTH}" height="{_HEIGHT}" fill="none" stroke="#888888"/>']
    for k in range(6):
        parts += [_text(40 + k * _WIDTH / 5, _HEIGHT + 34, f"{k / 5:g}"), _text(34, 24 + (1 - k / 5) * _HEIGHT, f"{k / 5:g}", "end")]
    for k, (measure, points) in enumerate(sorted(by.items())):
        colour = COLOURS.get(measure, "#000000")
        path = " ".join(f"{x:.2f},{y:.2f}" for x, y in points)
        parts += [f'<polyline class="{escape(measure)}" points="{path}" fill="none" stroke="{colour}"/>', f'<rect x="{_WIDTH + 52}" y="{24 + 16 * k}" width="10" height="3" fill="{colour}"/>', _text(_WIDTH + 66, 30 + 16 * k, measure, "start")]
    if threshold is not None:
        x = 40 + threshold * _WIDTH
        parts.append(f'<line class="threshold" x1="{x:.2f}" x2="{x:.2f}" y1="20" y2="{20 + _HEIGHT}" stroke="#222222" stroke-dasharray="4"/>')
    return _svg(_WIDTH + 120, _HEIGHT + 50, parts)


def save(spark: SparkSession, picture: str, path: str) -> None:
    """Writes a picture as one text file in a folder."""
    spark.createDataFrame([(picture,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """(svg) of a saved picture."""
    return spark.read.text(path, wholetext=True).select(F.trim(F.regexp_replace("value", r"\n$", "")).alias("svg"))
