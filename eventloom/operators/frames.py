"""Frames: dense rows (frame, t, pixels as RGBA bytes) and sparse pixel tables."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.timecode import timecode_column

FRAME = "frame long, t long, pixels binary"


def frames_from_list(spark: SparkSession, start: int, frequency_hz: float, frames: list[np.ndarray]) -> DataFrame:
    return spark.createDataFrame([(i, start + round(i * 1e6 / frequency_hz), bytes(np.ascontiguousarray(f))) for i, f in enumerate(frames)], FRAME)


def frames_from_function(spark: SparkSession, start: int, frequency_hz: float, count: int, get_frame: Callable[[int], np.ndarray]) -> DataFrame:
    """``get_frame`` is called on the executors with each frame's time, which is the end of its interval."""

    def run(batches):
        for pdf in batches:
            t = start + np.rint((pdf["id"].to_numpy() + 1) * 1e6 / frequency_hz).astype(np.int64)
            yield pdf.assign(frame=pdf["id"], t=t, pixels=[bytes(np.ascontiguousarray(get_frame(int(x)))) for x in t])[["frame", "t", "pixels"]]

    return spark.range(count).mapInPandas(run, FRAME)


def scale_factor(width: int, height: int, factor_or_minimum=(960, 720)) -> int:
    """A whole factor, 1 at least; of minimum sides, the least that reaches both."""
    if isinstance(factor_or_minimum, (int, float)):
        return max(1, int(-(-factor_or_minimum // 1)))
    return max(1, *(-(-m // n) for m, n in zip(factor_or_minimum, (width, height), strict=True)))


def scale_pixels(pixels: DataFrame, factor: int) -> DataFrame:
    """Each sparse pixel as a square of ``factor`` by ``factor``."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    wide = pixels.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    return wide.withColumns({"x": (F.col("x") * factor + F.col("_dx")).cast("int"), "y": (F.col("y") * factor + F.col("_dy")).cast("int")}).drop("_dx", "_dy")


def _kernel(name: str, x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    if name == "triangle":
        return np.maximum(0, 1 - x)
    if name == "catmull_rom":
        return np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))
    if name == "gaussian":
        return np.where(x < 3, np.exp(-2 * x * x), 0)
    if name == "lanczos3":
        return np.where(x < 3, np.sinc(x) * np.sinc(x / 3), 0)
    raise ValueError(f"unknown sampling filter {name!r}")


def resize(image: np.ndarray, factor: int, sampling: str = "nearest") -> np.ndarray:
    """``image`` enlarged by a whole factor."""
    if sampling == "nearest":
        return image.repeat(factor, 0).repeat(factor, 1)
    out = image.astype(float)
    for axis in (0, 1):
        n = out.shape[axis]
        centre = (np.arange(n * factor) + 0.5) / factor - 0.5
        weight = _kernel(sampling, centre[:, None] - np.arange(n))
        out = np.moveaxis(np.tensordot(weight / weight.sum(1, keepdims=True), out, (1, axis)), 0, axis)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def map_frames(frames: DataFrame, width: int, height: int, function: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """``function`` of each frame's (height, width, 4) array and time, in Arrow batches."""

    def run(batches):
        for pdf in batches:
            made = [bytes(np.ascontiguousarray(function(np.frombuffer(p, np.uint8).reshape(height, width, 4), int(t)), np.uint8)) for p, t in zip(pdf["pixels"], pdf["t"], strict=True)]
            yield pdf.assign(pixels=made)[["frame", "t", "pixels"]]

    return frames.mapInPandas(run, FRAME)


def over(base: np.ndarray, top: np.ndarray, x: int, y: int) -> np.ndarray:
    """``top`` laid on a copy of ``base`` with its corner at (x, y), whole-number alpha."""
    out = base.copy()
    a, b = out[max(0, y) : y + top.shape[0], max(0, x) : x + top.shape[1]], top[max(0, -y) :, max(0, -x) :]
    b = b[: a.shape[0], : a.shape[1]].astype(np.uint32)
    alpha, under = b[..., 3:], a.astype(np.uint32)
    total = alpha * 255 + under[..., 3:] * (255 - alpha)
    color = (b[..., :3] * alpha * 255 + under[..., :3] * under[..., 3:] * (255 - alpha)) // np.maximum(total, 1)
    a[...] = np.concatenate((color, total // 255), 2)
    return out


def add_overlay(frames: DataFrame, width: int, height: int, overlay: np.ndarray, x: int, y: int, factor: int = 1, sampling: str = "nearest") -> DataFrame:
    top = resize(overlay, factor, sampling)
    return map_frames(frames, width, height, lambda image, _: over(image, top, x, y))


def annotate(frames: DataFrame, text: str | Column, x: int, y: int, size: int = 30, color: str = "#ffffff") -> DataFrame:
    """A note for the sink that draws text; the pixels stay."""
    note = F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(size).alias("size"), F.lit(color).alias("color"))
    notes = F.concat("notes", F.array(note)) if "notes" in frames.columns else F.array(note)
    return frames.withColumn("notes", notes)


def speed_label(output_rate: float, frequency_hz: float) -> str:
    speed = output_rate / frequency_hz
    if abs(speed - 1) <= 1e-3:
        return "Real-time"
    return f"× {_short(speed)}" if speed > 1 else f"× 1/{_short(1 / speed)}"


def _short(value: float) -> str:
    return f"{value:.2f}".rstrip("0").rstrip(".")


def add_timecode(frames: DataFrame, output_rate: float | None = None, frequency_hz: float | None = None) -> DataFrame:
    """``frames`` with ``timecode``, followed by the playback speed where rates are given."""
    code = timecode_column(F.col("t"))
    return frames.withColumn("timecode", code if output_rate is None else F.concat(code, F.lit(f" ({speed_label(output_rate, frequency_hz)})")))


def played(frames: DataFrame, skip: int = 0, rewind: bool = False) -> DataFrame:
    """``frames`` in playing order (``turn``): the first ``skip`` left out, and with ``rewind`` the inner ones once more, backwards."""
    kept = frames.where(F.col("frame") >= skip)
    turn = kept.withColumn("turn", F.col("frame") - skip)
    if not rewind:
        return turn
    last = kept.agg(F.max("frame").alias("_last"))
    back = kept.join(F.broadcast(last)).where((F.col("frame") > skip) & (F.col("frame") < F.col("_last")) & (F.col("_last") - skip >= 2))
    back = back.withColumn("turn", 2 * (F.col("_last") - skip) - (F.col("frame") - skip)).drop("_last")
    return turn.unionByName(back)


def png(image: np.ndarray) -> bytes:
    """An 8-bit RGBA PNG file."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w = image.shape[:2]
    raw = np.concatenate((np.zeros((h, 1), np.uint8), image.reshape(h, w * 4)), 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The pixels of an 8-bit RGBA PNG file without interlacing."""
    at, parts, size = 8, [], (0, 0)
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, color, interlace) != (8, 6, 0):
                raise ValueError("only 8-bit RGBA without interlacing is read")
            size = (h, w)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    h, w = size
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + 4 * w)
    out = np.zeros((h, 4 * w), np.uint8)
    for y in range(h):
        line, above, kind = raw[y, 1:].astype(np.int64), (out[y - 1] if y else np.zeros(4 * w, np.uint8)).astype(np.int64), raw[y, 0]
        if kind in (0, 2):
            out[y] = (line + (above if kind == 2 else 0)) & 255
            continue
        for i in range(4 * w):
            left, corner = (int(out[y, i - 4]), int(above[i - 4])) if i >= 4 else (0, 0)
            guess = left + int(above[i]) - corner
            near = min((left, int(above[i]), corner), key=lambda v: abs(guess - v))
            out[y, i] = (int(line[i]) + (left if kind == 1 else (left + int(above[i])) // 2 if kind == 3 else near)) & 255
    return out.reshape(h, w, 4)


def to_files(frames: DataFrame, width: int, height: int, pattern: str) -> int:
    """Writes a PNG file for each frame from the executors (to a folder that they share); ``pattern`` names {index} or {timestamp}. Returns how many."""
    if not any(f"{{{k}" in pattern for k in ("i", "index", "t", "timestamp")):
        raise ValueError("the pattern must hold {index} or {timestamp}")

    def write(batches):
        import pandas as pd

        from eventloom.functions.timecode import to_timecode

        for pdf in batches:
            for i, t, p in zip(pdf["frame"], pdf["t"], pdf["pixels"], strict=True):
                code = to_timecode(int(t), "-")
                with open(pattern.format(i=i, index=i, t=code, timestamp=code), "wb") as f:
                    f.write(png(np.frombuffer(p, np.uint8).reshape(height, width, 4)))
            yield pd.DataFrame({"n": [len(pdf)]})

    return int(frames.select("frame", "t", "pixels").mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0)
