"""Summaries of finite streams."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import ceil, cos, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_range(df: DataFrame) -> tuple[int, int]:
    """The first event's time and one past the last event's, in arrival order; (0, 1) without events."""
    r = df.agg(F.min_by("t", "seq").alias("a"), F.max_by("t", "seq").alias("b")).first()
    return (0, 1) if r.a is None else (r.a, r.b + 1)


def _bucket_start(i: Column, t0: int, t1: int, samples: int) -> Column:
    return F.floor(i / F.lit(samples / (t1 - t0))) + t0


def event_rate(df: DataFrame, t0: int, t1: int, samples: int = 1600) -> DataFrame:
    """``bucket, t, rate``: events a second in equal parts of the range, those without events included."""
    bucket = F.floor((F.col("t") - t0).cast("double") * F.lit(samples / (t1 - t0)))
    counts = df.where((F.col("t") >= t0) & (F.col("t") < t1)).groupBy(bucket.cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    i = F.col("id").cast("double")
    spine = df.sparkSession.range(samples).select(F.col("id").alias("bucket"), _bucket_start(i, t0, t1, samples).alias("t"), (_bucket_start(i + 1, t0, t1, samples) - _bucket_start(i, t0, t1, samples)).alias("width"))
    rate = F.coalesce("n", F.lit(0)) / F.when(F.col("width") > 0, F.col("width") / 1e6).otherwise(F.lit(1.0))
    return spine.join(counts, "bucket", "left").select("bucket", "t", rate.alias("rate"))


def smoothed(rates: DataFrame, weights: list[float]) -> DataFrame:
    """``rates`` with ``smooth``: weighted means of neighbouring buckets, edges repeated. As many rows as there are samples."""
    n, total = len(weights), sum(weights)
    order = Window.orderBy("bucket")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    terms = []
    for j, w in enumerate(weights):
        k = j - n // 2
        near = F.lag("rate", -k).over(order) if k < 0 else F.lead("rate", k).over(order) if k else F.col("rate")
        edge = F.first("rate").over(whole) if k < 0 else F.last("rate").over(whole)
        terms.append(F.coalesce(F.lag("rate", -k).over(order) if k < 0 else near, edge) * (w / total))
    out = terms[0]
    for x in terms[1:]:
        out = out + x
    return rates.withColumn("smooth", out)


def hamming(n: int) -> list[float]:
    return [1.0] if n == 1 else [0.54 - 0.46 * cos(2 * pi * i / (n - 1)) for i in range(n)]


def kinectograph(df: DataFrame, t0: int, t1: int, quantile: float = 0.9, time_gamma=None, opacity_gamma=None) -> DataFrame:
    """``x, y, mean_time, opacity`` for pixels with events: mean normalised time, and count against a quantile of the counts."""
    slope = 0.0 if t1 - t0 <= 1 else 1.0 / (t1 - (t0 + 1))
    middle = 0.5 if t1 - t0 <= 1 else 0.0
    # A sum of times leaves 64 bits from some 40,000 events of a pixel years after the first; decimals are exact.
    total = F.sum((F.col("t") - t0).cast("decimal(20,0)")).cast("double")
    pixels = df.groupBy("x", "y").agg((total / F.count("*")).alias("late"), F.count("*").alias("n"))
    # A row for each pixel of the sensor at most, which one task can hold; so the events are read once.
    out = pixels.withColumn("q", F.percentile("n", quantile).over(Window.partitionBy())).select("x", "y", (F.col("late") * slope + middle).alias("mean_time"), F.least(F.lit(1.0), F.col("n") / F.col("q")).alias("opacity"))
    for name, gamma in (("mean_time", time_gamma), ("opacity", opacity_gamma)):
        out = out.withColumn(name, gamma(F.col(name))) if gamma else out
    return out


def digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: event count and an order-sensitive 64-bit sum for each column (each value is hashed with its ordinal), made without moving rows."""
    return df.agg(F.count("*").alias("events"), *[F.sum(F.xxhash64("seq", c).cast("decimal(38,0)")).alias(f"hash_{c}") for c in columns])


def sha3_224(df: DataFrame, columns: dict[str, str]) -> dict[str, str]:
    """SHA3-224 of each column's bytes in arrival order (numpy types by column); streams through the driver batch by batch."""
    import numpy as np

    hashes = {c: hashlib.sha3_224() for c in columns}
    for row in df.orderBy("seq").select(*columns).toLocalIterator(prefetchPartitions=True):
        for c, kind in columns.items():
            hashes[c].update(np.array(row[c], kind).tobytes())
    return {c: h.hexdigest() for c, h in hashes.items()}


@dataclass(frozen=True)
class Wiggle:
    """Parameters of a short looping clip of a recording."""

    frequency_hz: float
    tau: int
    skip: int
    frame_rate: float
    rewind: bool

    @classmethod
    def of(cls, t0: int, t1: int, rewind: bool = True, decay: str = "cumulative", output_duration: float = 3e6, tau_frames: float = 5.0, frame_rate: float = 30.0, skip: int | None = None) -> Wiggle:
        """Frames fill the output, with those played backwards counted twice; the first ones, in which the decay hasn't settled, are skipped."""
        settles = {"exponential": 3.0, "linear": 2.0, "window": 1.0, "cumulative": 1.0}[decay]
        skip = ceil(settles * tau_frames) if skip is None else skip
        shown = ceil(frame_rate * output_duration / 1e6)
        if rewind and shown >= 3:
            shown = ceil((shown + 2) / 2)
        frequency = (shown + skip) * 1e6 / (t1 - t0)
        return cls(frequency, round(tau_frames / frequency * 1e6), skip, frame_rate, rewind)
