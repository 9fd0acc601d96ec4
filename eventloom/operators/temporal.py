"""Slices and packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.order import with_ordinals


def period_us(frequency_hz: float) -> float:
    return 1e6 / frequency_hz


def boundary(start: int, k: int, frequency_hz: float) -> int:
    """Where packet k begins: rounded half to even."""
    return start + round(k * period_us(frequency_hz))


def packet_of(t: Column, start: int, frequency_hz: float) -> Column:
    """The packet of a time: a floor, corrected where rounding moves a boundary across it.

    The start is subtracted first, so that doubles stay exact for times since 1970.
    """
    p = period_us(frequency_hz)
    since = (t - F.lit(start)).cast("double")
    k = F.floor(since / p)
    return F.when(since >= F.rint((k + 1) * p), k + 1).when(since < F.rint(k * p), k - 1).otherwise(k)


def packet_count(start: int, end: int, frequency_hz: float) -> int:
    """Packets from ``start`` until one begins at or after ``end``; one at least."""
    k = max(1, int((end - start) / period_us(frequency_hz)) - 1)
    while boundary(start, k, frequency_hz) < max(start + 1, end):
        k += 1
    return k


def regularize(df: DataFrame, frequency_hz: float, start: int) -> DataFrame:
    """Events with their ``packet``; those before the start are dropped."""
    return df.where(F.col("t") >= start).withColumn("packet", packet_of(F.col("t"), start, frequency_hz).cast("long"))


def packet_spine(spark, count: int) -> DataFrame:
    """Every packet's number, whether or not it has events."""
    return spark.range(count).withColumnRenamed("id", "packet")


def chunks(df: DataFrame, length: int) -> DataFrame:
    """Events with their ``packet`` of ``length`` events in arrival order; the last may be shorter."""
    return with_ordinals(df, "_ordinal").withColumn("packet", F.floor(F.col("_ordinal") / length)).drop("_ordinal")


def time_slice(df: DataFrame, start: int, end: int, zero: bool = False) -> DataFrame:
    out = df.where((F.col("t") >= start) & (F.col("t") < end))
    return out.withColumn("t", F.col("t") - start) if zero else out


def event_slice(df: DataFrame, start: int, end: int) -> DataFrame:
    return with_ordinals(df, "_ordinal").where((F.col("_ordinal") >= start) & (F.col("_ordinal") < end)).drop("_ordinal")


def packet_slice(df: DataFrame, start: int, end: int, shift: int = 0) -> DataFrame:
    """Packets from ``start`` to before ``end``, numbered anew from 0; ``shift`` is taken from the times."""
    out = df.where((F.col("packet") >= start) & (F.col("packet") < end))
    return out.withColumns({"packet": F.col("packet") - start, "t": F.col("t") - shift})
