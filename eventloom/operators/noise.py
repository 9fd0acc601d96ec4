"""Noise filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.order import with_run_lengths


def arbiter_saturation_lines(df: DataFrame, threshold: int, orientation: str = "row") -> DataFrame:
    """Without runs, in arrival order, of more than ``threshold`` events on one line, and without the run still open at the end."""
    line = {"row": "y", "column": "x"}[orientation]
    found = with_run_lengths(df, line, "_length", "_last")
    return found.where((F.col("_length") <= threshold) & ~F.col("_last")).select(*df.columns)


def hot_pixels(df: DataFrame, ratio: float) -> DataFrame:
    """Without pixels that, within a packet, reach ``ratio`` times the count of their busiest neighbour (counts start at 1)."""
    if "packet" not in df.columns:
        df = df.withColumn("packet", F.lit(0).cast("long"))
        return hot_pixels(df, ratio).drop("packet")
    counts = df.groupBy("packet", "x", "y").agg((F.count("*") + 1).alias("c"))
    # Each pixel tells its four neighbours its count: one aggregation in place of four joins.
    told = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(own).alias("own"), F.col("c").alias("c")) for dx, dy, own in ((0, 0, True), (1, 0, False), (-1, 0, False), (0, 1, False), (0, -1, False))])
    seen = counts.select("packet", F.explode(told).alias("p")).select("packet", "p.*")
    both = seen.groupBy("packet", "x", "y").agg(F.max(F.when(F.col("own"), F.col("c"))).alias("c"), F.max(F.when(~F.col("own"), F.col("c"))).alias("m"))
    cold = both.where(F.col("c").isNotNull() & (F.col("c") < ratio * F.coalesce("m", F.lit(1)))).select("packet", "x", "y")
    on = reduce(lambda a, b: a & b, (F.col(f"e.{k}") == F.col(f"k.{k}") for k in ("packet", "x", "y")))
    return df.alias("e").join(cold.alias("k"), on, "left_semi").select(*df.columns)
