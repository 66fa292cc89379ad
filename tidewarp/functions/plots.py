"""Line plots as SVG text. Only a bounded tail of a series reaches the driver."""

from __future__ import annotations

from collections.abc import Sequence
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLOURS = ("#1f5fa8", "#c0562b", "#3f8a57", "#7a4fa3", "#8a8a8a")
WIDTH, HEIGHT, EDGE = 800, 300, 40
MOST_POINTS = 5000


def svg(lines: Sequence[tuple[str, Sequence[float | None]]], band: tuple[int, Sequence[float], Sequence[float]] | None = None, ticks: Sequence[str] = (), starts: Sequence[int] | None = None) -> str:
    """Named lines from their start positions, an optional band (start, lower, upper), labels along the time axis."""
    starts = list(starts or [0] * len(lines))
    values = [v for _, ys in lines for v in ys if v is not None] + ([*band[1], *band[2]] if band else [])
    if not values:
        raise ValueError("nothing to plot")
    low, high = min(values), max(values)
    length = max(s + len(ys) for s, (_, ys) in zip(starts, lines, strict=True))
    x = lambda i: EDGE + i * (WIDTH - 2 * EDGE) / max(1, length - 1)
    y = lambda v: HEIGHT - EDGE - (v - low) * (HEIGHT - 2 * EDGE) / ((high - low) or 1)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-size="11" font-family="sans-serif">']
    if band:
        at, lower, upper = band
        points = [(x(at + i), y(v)) for i, v in enumerate(upper)] + [(x(at + i), y(v)) for i, v in reversed(list(enumerate(lower)))]
        out.append(f'<polygon fill="{COLOURS[1]}" opacity="0.2" points="{" ".join(f"{a:.1f},{b:.1f}" for a, b in points)}"/>')
    for n, (start, (name, ys)) in enumerate(zip(starts, lines, strict=True)):
        points = " ".join(f"{x(start + i):.1f},{y(v):.1f}" for i, v in enumerate(ys) if v is not None)
        out.append(f'<polyline fill="none" stroke="{COLOURS[n % len(COLOURS)]}" points="{points}"/><text x="{EDGE + 110 * n}" y="16" fill="{COLOURS[n % len(COLOURS)]}">{escape(name)}</text>')
    for i, label in enumerate(ticks):
        out.append(f'<text x="{x(i * (length - 1) / max(1, len(ticks) - 1)):.1f}" y="{HEIGHT - 8}" text-anchor="middle">{escape(label)}</text>')
    out += [f'<text x="2" y="{y(v) + 4:.1f}">{v:.4g}</text>' for v in {low, high}]
    return "".join(out) + "</svg>"


def _tail(df: DataFrame, time: str, columns: list[str], points: int) -> list:
    rows = df.orderBy(F.col(time).desc()).limit(min(points, MOST_POINTS)).select(time, *columns).collect()
    return rows[::-1]


def plot_single_series(df: DataFrame, time: str, target: str, label: str | None = None, points: int = 1000) -> str:
    rows = _tail(df, time, [target], points)
    return svg([(label or target, [r[1] for r in rows])], ticks=[str(rows[0][0])[:10], str(rows[-1][0])[:10]])


def plot_data_period(truth: DataFrame, forecast: DataFrame, time: str, target: str, labels: tuple[str, str] = ("truth", "forecast"), points: int = 1000) -> str:
    """Truth and forecast on one time axis, with the forecast's interval if it has one."""
    extra = [c for c in (f"{target}_lower", f"{target}_upper") if c in forecast.columns]
    a, b = _tail(truth, time, [target], points), _tail(forecast, time, [target, *extra], points)
    times = sorted({r[0] for r in a} | {r[0] for r in b})
    place = {t: i for i, t in enumerate(times)}
    at = place[b[0][0]]
    band = (at, [r[2] for r in b], [r[3] for r in b]) if len(extra) == 2 else None
    return svg([(labels[0], [r[1] for r in a]), (labels[1], [r[1] for r in b])], band, [str(times[0])[:10], str(times[-1])[:10]], [place[a[0][0]], at])


def plot1d(*series: Sequence[float], labels: Sequence[str] = ()) -> str:
    return svg([(labels[i] if i < len(labels) else str(i), list(s)) for i, s in enumerate(series)])


def plot2d(*matrices: Sequence[Sequence[float]], row: int = -1, labels: Sequence[str] = ()) -> str:
    """One row of each matrix; the row is a number."""
    return plot1d(*[m[row] for m in matrices], labels=labels)
