"""Pictures of summaries: an event-rate curve as SVG, a kinectograph as an image.

Both take rows that are already small: one for each sample, or each pixel.
"""

from __future__ import annotations

from math import ceil, floor, log10

import numpy as np
from pyspark.sql import DataFrame

from eventloom.functions.color import THEMES, Colormap
from eventloom.functions.timecode import to_timecode
from eventloom.operators.frames import resize


def axis_range(values: np.ndarray, logarithmic: bool) -> tuple[float, float]:
    """Round numbers around the values; powers of ten on a logarithmic axis."""
    values = values[np.isfinite(values)]
    if logarithmic:
        values = values[values > 0]
        if not len(values):
            return 1.0, 10.0
        low, high = floor(log10(values.min())), ceil(log10(values.max()))
        return 10.0**low, 10.0 ** max(high, low + 1)
    top = float(values.max(initial=0.0))
    if top <= 0:
        return 0.0, 1.0
    step = 10.0 ** floor(log10(top))
    return 0.0, ceil(top / step) * step


def rate_svg(rates: DataFrame, width: int = 1280, height: int = 480, column: str = "rate", logarithmic: bool = False, theme: str = "light") -> str:
    """The curve of ``rates`` (t and a column of rates) with axes."""
    colors = THEMES[theme]
    rows = rates.orderBy("bucket").select("t", column).collect()
    t, v = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    low, high = axis_range(v, logarithmic)
    left, bottom = 90, 40
    scale = (lambda x: np.log10(np.maximum(x, low))) if logarithmic else (lambda x: x)
    x = left + (t - t[0]) / max(1.0, t[-1] - t[0]) * (width - left - 20)
    y = (height - bottom) - (scale(v) - scale(low)) / (scale(high) - scale(low)) * (height - bottom - 20)
    ticks = [10.0**k for k in range(round(log10(low)), round(log10(high)) + 1)] if logarithmic else np.linspace(low, high, 5).tolist()
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="13">', f'<rect width="{width}" height="{height}" fill="{colors["background"]}"/>']
    for tick in ticks:
        at = (height - bottom) - (scale(tick) - scale(low)) / (scale(high) - scale(low)) * (height - bottom - 20)
        out.append(f'<line x1="{left}" x2="{width - 20}" y1="{at:.1f}" y2="{at:.1f}" stroke="{colors["lines"]}"/>')
        out.append(f'<text x="{left - 8}" y="{at + 4:.1f}" text-anchor="end" fill="{colors["labels"]}">{tick:g}</text>')
    for share, anchor in ((0.0, "start"), (1.0, "end")):
        out.append(f'<text x="{left + share * (width - left - 20):.1f}" y="{height - 12}" text-anchor="{anchor}" fill="{colors["labels"]}">{to_timecode(int(t[0] + share * (t[-1] - t[0])))}</text>')
    points = " ".join(f"{a:.1f},{b:.1f}" for a, b in zip(x, y, strict=True))
    out += [f'<polyline points="{points}" fill="none" stroke="{colors["accent"]}"/>', "</svg>"]
    return "\n".join(out)


def kinectograph_image(pixels: DataFrame, width: int, height: int, colormap: Colormap, background: str | None = None, factor: int = 1) -> np.ndarray:
    """RGBA of a kinectograph: time picks the colour, opacity is alpha; on a background it is blended."""
    from eventloom.functions.color import color_to_floats

    table = colormap.rgba
    out = np.zeros((height, width, 4))
    for r in pixels.select("x", "y", "mean_time", "opacity").toLocalIterator():
        color = table[min(len(table) - 1, max(0, round(r.mean_time * (len(table) - 1))))]
        out[r.y, r.x] = (*color[:3], r.opacity * color[3])
    if background:
        under, alpha = np.array(color_to_floats(background)), out[..., 3:]
        out = np.concatenate((out[..., :3] * alpha + under[:3] * (1 - alpha), np.ones_like(alpha)), 2)
    return resize(np.floor(np.clip(out, 0, 1) * 255 + 0.5).astype(np.uint8), factor)
