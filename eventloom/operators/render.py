"""Rasterisation: events to sparse pixel tables, one row for each frame and pixel that has been hit.

The label T of frame k is the end of its packet. A pixel keeps what it last
received, so a pixel's last event of a packet holds from that frame until the
frame of its next one: those intervals are exploded, and no product of all
frames and pixels is formed. Pixels never hit have index 0.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.color import Colormap

DECAYS = ("exponential", "linear", "window", "cumulative")


@dataclass(frozen=True)
class Style:
    decay: str
    tau: float
    colormap: Colormap
    minimum_clip: float = 0.0
    maximum_clip: float = 0.99
    gamma: float = 0.0

    def __post_init__(self):
        if self.decay not in DECAYS:
            raise ValueError(f"unknown decay {self.decay!r}")
        if self.tau <= 0:
            raise ValueError("tau must be positive")
        if not 0 <= self.minimum_clip < self.maximum_clip <= 1:
            raise ValueError("clips must lie between 0 and 1, the minimum below the maximum")

    @property
    def signed(self) -> bool:
        return self.colormap.kind != "sequential"

    @property
    def steps(self) -> int:
        """Steps of the whole map, or of one half."""
        n = len(self.colormap.rgba)
        return n - n // 2 if self.signed else n


def label(k: Column, start: int, period: float) -> Column:
    """The end of packet k, rounded half to even."""
    return F.lit(start) + F.rint((k + 1).cast("double") * period).cast("long")


def last_events(df: DataFrame, frames: int) -> DataFrame:
    """``frame, x, y, t_last, on_last`` for each frame from a pixel's first event on."""
    own = df.groupBy("packet", "x", "y").agg(F.max(F.struct("seq", "t", "on")).alias("e"))
    until = F.coalesce(F.lead("packet").over(Window.partitionBy("x", "y").orderBy("packet")), F.lit(frames))
    held = own.withColumn("until", until)
    return held.select(F.explode(F.sequence(F.col("packet"), F.col("until") - 1)).alias("frame"), "x", "y", F.col("e.t").alias("t_last"), F.col("e.on").alias("on_last"))


def activities(df: DataFrame, frames: int, start: int, period: float, tau: float) -> DataFrame:
    """``frame, x, y, off_sum, on_sum``: sums of exp(-(T - t) / tau) over a pixel's events until then.

    A packet's sum at its own label decays by exp(-(T' - T) / tau) until a
    later label T'. So the sums of a pixel's packets are carried along in
    order, one step for each of its packets, as they stream by; and from one
    packet to the next every frame is a decayed copy of the last sum.
    """
    at = lambda k: label(k, start, period)
    decayed = F.exp(-(at(F.col("packet")) - F.col("t")) / tau)
    part = df.groupBy("packet", "x", "y").agg(F.sum(F.when(~F.col("on"), decayed).otherwise(0.0)).alias("off"), F.sum(F.when(F.col("on"), decayed).otherwise(0.0)).alias("on"))

    def carry(batches):
        pixel, last, off, on = None, 0.0, 0.0, 0.0
        for batch in batches:
            x, y, packet, own_off, own_on = (c.to_numpy() for c in batch.columns)
            labels = np.rint((packet + 1.0) * period)
            sums = np.empty((2, len(x)))
            fade = np.exp(-np.diff(labels, prepend=last) / tau, where=np.diff(labels, prepend=last) >= 0, out=np.zeros(len(x)))
            for i, key in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
                if key != pixel:
                    pixel, off, on = key, 0.0, 0.0
                off, on = off * fade[i] + own_off[i], on * fade[i] + own_on[i]
                sums[:, i] = off, on
            last = labels[-1] if len(labels) else last
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums[0]), pa.array(sums[1])], ["x", "y", "packet", "off", "on"])

    lined = part.select("x", "y", "packet", "off", "on").repartition("x", "y").sortWithinPartitions("x", "y", "packet")
    summed = lined.mapInArrow(carry, "x int, y int, packet long, off double, on double")
    until = F.coalesce(F.lead("packet").over(Window.partitionBy("x", "y").orderBy("packet")), F.lit(frames))
    held = summed.withColumn("until", until).select("x", "y", "packet", "off", "on", F.explode(F.sequence(F.col("packet"), F.col("until") - 1)).alias("frame"))
    fade = F.exp(-(at(F.col("frame")) - at(F.col("packet"))).cast("double") / tau)
    return held.select("frame", "x", "y", (F.col("off") * fade).alias("off_sum"), (F.col("on") * fade).alias("on_sum"))


def _nearest(n: Column, share: float) -> Column:
    return F.round((n - 1) * F.lit(float(share)), 0).cast("long")


def _clips(values: DataFrame, style: Style) -> DataFrame:
    """For each frame the bounds ``lo < hi`` of what is shown (a frame has at most one value for each pixel).

    These are the nearest-rank clips over the frame's values above 0; where
    they coincide its least and greatest value, and where these do so too, the
    value and one above it.
    """
    over = values.where("v > 0")
    ranked = over.select("frame", "v", (F.row_number().over(Window.partitionBy("frame").orderBy("v")) - 1).alias("i"), F.count("*").over(Window.partitionBy("frame")).alias("n"))
    rank = lambda share: F.max(F.when(F.col("i") == _nearest(F.col("n"), share), F.col("v")))
    low = F.lit(0.0) if style.minimum_clip == 0 else rank(style.minimum_clip)
    found = ranked.groupBy("frame").agg(low.alias("a"), rank(style.maximum_clip).alias("b"), F.min("v").alias("least"), F.max("v").alias("most"))
    lo = F.when(F.col("a") < F.col("b"), F.col("a")).otherwise(F.col("least"))
    hi = F.when(F.col("a") < F.col("b"), F.col("b")).when(F.col("least") < F.col("most"), F.col("most")).otherwise(F.col("least") + 1)
    return found.select("frame", lo.alias("lo"), hi.alias("hi"))


def _curve(u: Column, steps: int, gamma: float) -> Column:
    """From 0..1 to an index: linear for gamma 0, else a hyperbola through both ends."""
    if gamma == 0 or steps < 2:
        return F.round(u * (steps - 1), 0)
    rho = 2 + gamma * gamma if gamma < 0 else -2 - gamma * gamma
    sigma = sqrt(rho * rho - 4)
    alpha, beta = 2 * sigma / ((steps - 1) * (rho + sigma)), (rho - sigma) / ((steps - 1) * (rho + sigma))
    return F.round(u / (u * alpha + beta), 0)


def render(df: DataFrame, frames: int, start: int, period: float, style: Style) -> DataFrame:
    """``frame, t, x, y, half, idx, value``. ``half`` is -1 or 1 for the OFF or ON half of a signed map, else 0."""
    n = style.steps
    t = label(F.col("frame"), start, period)
    if style.decay == "cumulative":
        sums = activities(df, frames, start, period, style.tau)
        if style.signed:
            half = F.when(F.col("on_sum") > F.col("off_sum"), 1).otherwise(-1)
            sums = sums.withColumns({"v": F.greatest("on_sum", "off_sum"), "half": half})
        else:
            sums = sums.withColumns({"v": F.col("on_sum") + F.col("off_sum"), "half": F.lit(0)})
        sums = sums.join(_clips(sums, style), "frame", "left")
        # A frame without a value above 0 has no bounds, and shows 0.
        u = F.coalesce((F.least(F.greatest("v", "lo"), F.col("hi")) - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0))
        return sums.select("frame", t.alias("t"), "x", "y", "half", F.greatest(F.lit(0), F.least(F.lit(n - 1), _curve(u, n, style.gamma))).cast("int").alias("idx"), F.col("v").alias("value"))
    held = last_events(df, frames)
    age = (t - F.col("t_last")).cast("double")
    half = F.when(F.col("on_last"), 1).otherwise(-1) if style.signed else F.lit(0)
    if style.decay == "exponential":
        value = F.exp(-age / style.tau)
        idx = F.round(value * (n - 1), 0)
    elif style.decay == "linear":
        value = F.greatest(F.lit(0.0), 1 - age / (2 * style.tau))
        idx = (n - 1) - F.least(F.floor(age * (n - 1) / (2 * style.tau)), F.lit(n - 1))
    else:
        value = F.when(age <= style.tau, 1.0).otherwise(0.0)
        idx = value * (n - 1)
    return held.select("frame", t.alias("t"), "x", "y", half.alias("half"), idx.cast("int").alias("idx"), value.alias("value"))


def colored(pixels: DataFrame, style: Style) -> DataFrame:
    """``pixels`` with ``r, g, b, a`` from the colormap (a table of a few hundred rows)."""
    halves = dict(zip((-1, 1), style.colormap.halves(), strict=True)) if style.signed else {0: style.colormap.bytes()}
    rows = [(h, i, *map(int, c)) for h, table in halves.items() for i, c in enumerate(table)]
    table = pixels.sparkSession.createDataFrame(rows, "half int, idx int, r int, g int, b int, a int")
    return pixels.join(F.broadcast(table), ["half", "idx"], "left")


def dense(pixels: DataFrame, width: int, height: int, style: Style, frames: DataFrame) -> DataFrame:
    """``frame, t, pixels``: RGBA bytes by row for each of ``frames`` (frame, t), those without pixels too; made at the sink only."""
    blank = bytes(map(int, (style.colormap.halves()[0] if style.signed else style.colormap.bytes())[0]))

    def draw(pdf):
        import pandas as pd

        image = np.frombuffer(blank * (width * height), np.uint8).reshape(height, width, 4).copy()
        hit = pdf[pdf["x"].notna()]
        image[hit["y"].astype(int), hit["x"].astype(int)] = hit[["r", "g", "b", "a"]].to_numpy(np.uint8)
        return pd.DataFrame({"frame": [pdf["frame"].iloc[0]], "t": [pdf["t"].iloc[0]], "pixels": [image.tobytes()]})

    drawn = frames.join(colored(pixels, style).select("frame", "x", "y", "r", "g", "b", "a"), "frame", "left")
    return drawn.groupBy("frame").applyInPandas(draw, "frame long, t long, pixels binary")
