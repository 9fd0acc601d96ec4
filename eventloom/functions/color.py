"""Colours and colormaps: small tables, made by rule on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np

# Fixed values of the sRGB standard (IEC 61966-2-1) with D65 white.
RGB_TO_XYZ = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
WHITE = np.array([0.95047, 1.0, 1.08883])
# Linear-RGB projections for each kind of dichromacy (Machado, Oliveira and Fernandes 2009, severity 1).
DICHROMACY = {
    "protanopia": [[0.152286, 1.052583, -0.204868], [0.114503, 0.786281, 0.099216], [-0.003882, -0.048116, 1.051998]],
    "deuteranopia": [[0.367322, 0.860646, -0.227968], [0.280085, 0.672501, 0.047413], [-0.011820, 0.042940, 0.968881]],
    "tritanopia": [[1.255528, -0.076749, -0.178779], [-0.078411, 0.930809, 0.147602], [0.004733, 0.691367, 0.303900]],
}
#: Background, line and text colours.
THEMES = {"light": {"background": "#ffffff", "lines": "#d0d0d0", "labels": "#202020", "accent": "#1b66c9"}, "dark": {"background": "#141414", "lines": "#484848", "labels": "#e4e4e4", "accent": "#6aa9ff"}}

Color = str | Sequence[float]


def color_to_floats(color: Color) -> tuple[float, float, float, float]:
    if not isinstance(color, str):
        values = [float(c) for c in color]
        return tuple(values + [1.0] * (4 - len(values)))
    digits = color.removeprefix("#")
    if len(digits) not in (6, 8):
        raise ValueError(f"not a colour: {color!r}")
    return tuple(int((digits + "ff")[i : i + 2], 16) / 255 for i in (0, 2, 4, 6))


def color_to_ints(color: Color) -> tuple[int, int, int, int]:
    """Truncated, not rounded."""
    return tuple(int(c * 255) for c in color_to_floats(color))


def color_to_hex_string(color: Color) -> str:
    return "#" + "".join(f"{c:02x}" for c in color_to_ints(color))


def srgb_to_linear(c: np.ndarray) -> np.ndarray:
    c = np.asarray(c, float)
    return np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)


def linear_to_srgb(c: np.ndarray) -> np.ndarray:
    c = np.asarray(c, float)
    return np.where(c <= 0.0031308, c * 12.92, 1.055 * np.maximum(c, 0.0031308) ** (1 / 2.4) - 0.055)


def srgb_to_lab(rgb: np.ndarray) -> np.ndarray:
    x = srgb_to_linear(rgb) @ RGB_TO_XYZ.T / WHITE
    f = np.where(x > (6 / 29) ** 3, np.cbrt(x), x / (3 * (6 / 29) ** 2) + 4 / 29)
    return np.stack((116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])), -1)


def lab_to_srgb(lab: np.ndarray) -> np.ndarray:
    l = (lab[..., 0] + 16) / 116
    f = np.stack((l + lab[..., 1] / 500, l, l - lab[..., 2] / 200), -1)
    x = np.where(f > 6 / 29, f**3, 3 * (6 / 29) ** 2 * (f - 4 / 29)) * WHITE
    return np.clip(linear_to_srgb(x @ np.linalg.inv(RGB_TO_XYZ).T), 0, 1)


def gradient(a: Color, b: Color, n: int) -> np.ndarray:
    """``n`` colours from a to b, straight in Lab, alpha straight too."""
    a, b, u = np.array(color_to_floats(a)), np.array(color_to_floats(b)), np.linspace(0, 1, n)[:, None]
    lab = srgb_to_lab(a[:3]) * (1 - u) + srgb_to_lab(b[:3]) * u
    return np.concatenate((lab_to_srgb(lab), a[3] * (1 - u) + b[3] * u), 1)


@dataclass(frozen=True, eq=False)
class Colormap:
    """``kind`` is sequential, diverging or cyclic; ``rgba`` has a row of four floats for each step."""

    name: str
    kind: str
    rgba: np.ndarray

    @classmethod
    def from_rgba_table(cls, name: str, kind: str, rgba) -> Colormap:
        return cls(name, kind, np.asarray(rgba, float))

    @classmethod
    def from_rgb_table(cls, name: str, kind: str, rgb) -> Colormap:
        rgb = np.asarray(rgb, float)
        return cls(name, kind, np.concatenate((rgb, np.ones((len(rgb), 1))), 1))

    @classmethod
    def sequential_from_pair(cls, name: str, start: Color, end: Color, n: int = 256) -> Colormap:
        return cls(name, "sequential", gradient(start, end, n))

    @classmethod
    def diverging_from_triplet(cls, name: str, start: Color, middle: Color, end: Color, n: int = 257) -> Colormap:
        half = n // 2 + 1
        return cls(name, "diverging", np.concatenate((gradient(start, middle, half)[:-1], gradient(middle, end, n - half + 1))))

    def as_type(self, kind: str) -> Colormap:
        return replace(self, kind=kind)

    def flipped(self) -> Colormap:
        return replace(self, rgba=self.rgba[::-1])

    def rolled(self, shift: int) -> Colormap:
        return replace(self, rgba=np.roll(self.rgba, shift, 0))

    def repeated(self, count: int, flip_odd: bool = False) -> Colormap:
        return replace(self, rgba=np.concatenate([self.rgba[::-1] if flip_odd and i % 2 else self.rgba for i in range(count)]))

    def colorblindness_simulation(self, kind: str) -> Colormap:
        seen = np.clip(linear_to_srgb(srgb_to_linear(self.rgba[:, :3]) @ np.array(DICHROMACY[kind]).T), 0, 1)
        return replace(self, name=f"{self.name} ({kind})", rgba=np.concatenate((seen, self.rgba[:, 3:]), 1))

    def bytes(self) -> np.ndarray:
        """Rows of four bytes, rounded half away from zero."""
        return np.floor(np.clip(self.rgba, 0, 1) * 255 + 0.5).astype(np.uint8)

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """Of a diverging or cyclic map, the OFF rows (middle to first) and the ON rows (middle to last)."""
        b = self.bytes()
        middle = len(b) // 2
        return b[middle::-1], b[middle:]


def _hue(h: float, s: float, v: float) -> tuple[float, float, float]:
    import colorsys

    return colorsys.hsv_to_rgb(h % 1.0, s, v)


def catalogue() -> dict[str, Colormap]:
    """38 colormaps by rule: sequential ones darken or brighten one hue, diverging ones join two, cyclic ones turn through all."""
    out: dict[str, Colormap] = {}
    for i in range(11):
        h = i / 11
        out[f"ink_{i}"] = Colormap.sequential_from_pair(f"ink_{i}", "#ffffff", _hue(h, 0.9, 0.45))
        out[f"glow_{i}"] = Colormap.sequential_from_pair(f"glow_{i}", "#000000", _hue(h, 0.5, 1.0))
        out[f"split_{i}"] = Colormap.diverging_from_triplet(f"split_{i}", _hue(h, 0.9, 0.8), "#191919" if i % 2 else "#ffffff", _hue(h + 0.5, 0.9, 0.8))
    for i in range(5):
        turn = [_hue(i / 5 + k / 256, 0.4 + 0.1 * i, 0.95) for k in range(256)]
        out[f"wheel_{i}"] = Colormap.from_rgb_table(f"wheel_{i}", "cyclic", turn)
    return out
