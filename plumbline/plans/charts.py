"""Small deterministic SVG charts. Bins of a histogram are counted on the executors."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, HEIGHT, PAD, BINS = 640, 320, 36, 40


def _frame(title: str, body: str) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" role="img"><title>{escape(title)}</title><rect width="{WIDTH}" height="{HEIGHT}" fill="none" stroke="#ccc"/>{body}</svg>'


def _scale(v: float, lo: float, hi: float, a: float, b: float) -> float:
    return round(a + (b - a) * ((v - lo) / (hi - lo) if hi > lo else 0.5), 2)


def line_chart(values: list[float], title: str) -> str:
    if not values:
        return _frame(title, "")
    lo, hi = min(values), max(values)
    points = " ".join(f"{_scale(k, 0, max(1, len(values) - 1), PAD, WIDTH - PAD)},{_scale(v, lo, hi, HEIGHT - PAD, PAD)}" for k, v in enumerate(values))
    return _frame(title, f'<polyline points="{points}" fill="none" stroke="#246"/>')


def bar_chart(bars: dict[str, float], title: str) -> str:
    if not bars:
        return _frame(title, "")
    lo, hi = min(0.0, *bars.values()), max(0.0, *bars.values())
    step, zero = (WIDTH - 2 * PAD) / len(bars), _scale(0, lo, hi, HEIGHT - PAD, PAD)
    parts = []
    for k, (name, v) in enumerate(bars.items()):
        y = _scale(v, lo, hi, HEIGHT - PAD, PAD)
        parts.append(f'<rect x="{round(PAD + k * step, 2)}" y="{min(y, zero)}" width="{round(step * 0.8, 2)}" height="{round(abs(y - zero), 2)}" fill="#246"><title>{escape(name)}: {v:.6g}</title></rect>')
    return _frame(title, "".join(parts))


def histogram_chart(counts: list[int], title: str) -> str:
    step, most = (WIDTH - 2 * PAD) / max(1, len(counts)), max(1, *counts)
    bar = lambda k, n: f'<rect x="{round(PAD + k * step, 2)}" y="{_scale(n, 0, most, HEIGHT - PAD, PAD)}" width="{round(step, 2)}" height="{_scale(n, 0, most, 0, HEIGHT - 2 * PAD)}" fill="#246"><title>{n}</title></rect>'
    return _frame(title, "".join(bar(k, n) for k, n in enumerate(counts)))


def histogram(df: DataFrame, column: str, bins: int = BINS) -> list[int]:
    """Counts of equal bins from the least to the largest value; the last bin holds its upper end."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return [0] * bins
    width = (hi - lo) / bins or 1.0
    at = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1))
    got = {r[0]: r[1] for r in df.where(F.col(column).isNotNull()).groupBy(at.alias("b")).count().collect()}
    return [got.get(k, 0) for k in range(bins)]
