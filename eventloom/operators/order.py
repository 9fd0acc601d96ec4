"""Arrival order without a single task: prefix sums over value buckets of ``seq``.

A global window would move all rows to one task. Instead rows are numbered
within buckets of ``seq``; tables with one row for each bucket, and one for
each ``WIDE`` buckets, carry what came before, and are joined back. Only the
last of these, a row for some 270 million values of ``seq``, passes through one
task. Events lie in the order that a merge join takes, and are told to be
joined so: where their size is estimated too low, Spark would broadcast them. Buckets depend on values only, so a recomputed task gives the same
numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET, WIDE = 1 << 16, 1 << 12


def _so_far(buckets: DataFrame, value: Column, combine: Callable[[Column], Column], name: str) -> DataFrame:
    """``buckets`` (a row for each ``_bucket``) with ``name``, the combined values of all buckets before, or null."""
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    own = buckets.withColumns({"_value": value, "_wide": F.floor(F.col("_bucket") / WIDE)})
    above = own.groupBy("_wide").agg(combine(F.col("_value")).alias("_all"))
    above = above.select("_wide", combine(F.col("_all")).over(earlier(Window.orderBy("_wide"))).alias("_above"))
    own = own.withColumn("_below", combine(F.col("_value")).over(earlier(Window.partitionBy("_wide").orderBy("_bucket"))))
    a, b = F.col("_above"), F.col("_below")
    total = F.greatest(a, b) if combine is F.max else F.coalesce(a + b, a, b)
    joined = own.join(above, "_wide").withColumn(name, total)
    return joined.select(*buckets.columns, name)


def with_ordinals(df: DataFrame, name: str = "ordinal", bucket: int = BUCKET) -> DataFrame:
    """``df`` with each event's number in arrival order, from 0."""
    cut = df.withColumn("_bucket", F.floor(F.col("seq") / bucket))
    before = _so_far(cut.groupBy("_bucket").agg(F.count("*").alias("_n")), F.col("_n"), F.sum, "_before").drop("_n")
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("seq")) - 1
    return cut.withColumn("_inside", inside).hint("merge").join(before, "_bucket").withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_inside")).select(*df.columns, name)


def _marked(df: DataFrame, key: str, bucket: int) -> DataFrame:
    """``df`` with its ``_bucket`` and the number of each event's run there, from 0."""
    cut = df.withColumn("_bucket", F.floor(F.col("seq") / bucket))
    order = Window.partitionBy("_bucket").orderBy("seq")
    starts = F.when(F.lag(key).over(order) != F.col(key), 1).otherwise(0)
    return cut.withColumn("_starts", starts).withColumn("_inside", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")


def with_runs(df: DataFrame, key: str, name: str = "run", bucket: int = BUCKET) -> DataFrame:
    """``df`` with the number of each event's run of equal ``key`` in arrival order, from 1."""
    marked = _marked(df, key, bucket)
    edge = marked.groupBy("_bucket").agg(F.min_by(key, "seq").alias("_first"), F.max_by(key, "seq").alias("_last"), F.max("_inside").alias("_inner"))
    last = _so_far(edge, F.struct("_bucket", "_last"), F.max, "_earlier")
    opens = F.when(F.col("_earlier").isNotNull() & F.col("_earlier._last").eqNullSafe(F.col("_first")), 0).otherwise(1)
    line = last.withColumn("_opens", opens).withColumn("_total", F.col("_inner") + F.col("_opens"))
    line = _so_far(line.select("_bucket", "_opens", "_total"), F.col("_total"), F.sum, "_before").select("_bucket", (F.coalesce("_before", F.lit(0)) + F.col("_opens")).alias("_base"))
    return marked.hint("merge").join(line, "_bucket").withColumn(name, F.col("_base") + F.col("_inside")).select(*df.columns, name)


def with_run_lengths(df: DataFrame, key: str, length: str = "length", last: str = "last", bucket: int = BUCKET) -> DataFrame:
    """``df`` with the number of events in each event's run of equal ``key`` (not negative) in arrival order, and whether that is the stream's last run.

    Most runs end within their bucket and are counted there. Of each bucket
    only the first and the last run meet those of other buckets, in a table of
    three rows for each.
    """
    marked = _marked(df, key, bucket)
    # A run's length is the way from its start to the next one's, found in the order that the rows have already: a window by run would sort them
    # again while they are still held. The bucket's last run has no next one.
    order, start = Window.partitionBy("_bucket").orderBy("seq"), "PARTITION BY _bucket ORDER BY seq"
    first = F.when(F.coalesce(F.lag("_inside").over(order) != F.col("_inside"), F.lit(True)), F.row_number().over(order))
    counted = marked.withColumn("_first", first)
    counted = counted.withColumn("_own", F.last("_first", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    counted = counted.withColumn("_next", F.expr(f"lead(_first, 1) IGNORE NULLS OVER ({start})"))
    edge = marked.groupBy("_bucket", "_inside").agg(F.count("*").alias("n"), F.first(key).alias("k"))
    edge = edge.groupBy("_bucket").agg(F.min(F.struct("_inside", "k", "n")).alias("a"), F.max(F.struct("_inside", "k", "n")).alias("z"))
    one = lambda e, part: F.struct((F.col("_bucket") * 3 + part).alias("seq"), F.col(f"{e}.k").cast("int").alias("k"), F.col(f"{e}.n").alias("n"))
    between = F.struct((F.col("_bucket") * 3 + 1).alias("seq"), F.lit(-1).alias("k"), F.lit(0).cast("long").alias("n"))  # keeps two runs of a bucket apart
    ends = edge.select(F.explode(F.when(F.col("a._inside") == F.col("z._inside"), F.array(one("a", 0))).otherwise(F.array(one("a", 0), between, one("z", 2)))).alias("e")).select("e.*")
    runs = with_runs(ends, "k", "_run")
    total = runs.groupBy("_run").agg(F.sum("n").alias("_total"), F.collect_list("seq").alias("_at"))  # a run of very many buckets is one of very many events
    final = total.agg(F.max("_run").alias("_end"))
    total = total.join(F.broadcast(final)).select(F.explode("_at").alias("_at"), "_total", (F.col("_run") == F.col("_end")).alias("_ends"))
    place = F.floor(F.col("_at") / 3).alias("_bucket")
    sides = total.where("_at % 3 != 1").groupBy(place).agg(*[F.max(F.when(F.col("_at") % 3 == part, F.struct("_total", "_ends"))).alias(side) for part, side in ((0, "_a"), (2, "_z"))])
    joined = counted.hint("merge").join(sides, "_bucket")
    found = F.when(F.col("_inside") == 0, F.col("_a")).when(F.col("_next").isNull(), F.col("_z")).otherwise(F.struct((F.col("_next") - F.col("_own")).cast("long").alias("_total"), F.lit(False).alias("_ends")))
    return joined.withColumn("_found", found).select(*df.columns, F.col("_found._total").alias(length), F.col("_found._ends").alias(last))


def running_max(df: DataFrame, column: str, bucket: int = BUCKET) -> DataFrame:
    """``df`` with ``column`` raised to its running maximum in arrival order."""
    cut = df.withColumn("_bucket", F.floor(F.col("seq") / bucket))
    before = _so_far(cut.groupBy("_bucket").agg(F.max(column).alias("_top")), F.col("_top"), F.max, "_before").drop("_top")
    inside = F.max(column).over(Window.partitionBy("_bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_inside", inside).hint("merge").join(before, "_bucket").withColumn(column, F.greatest("_inside", "_before")).select(*df.columns)
