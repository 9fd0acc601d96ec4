"""Views of the driver's tables as event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.sources import files

WIDTH, HEIGHT = 16, 12
#: Of lineitem rows every column, so that the order is total.
LINE_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")

EVENTS_SQL = f"""SELECT event_id AS seq, epoch_us(ts) - 1704067200000000 AS t, CAST(user_id % {WIDTH} AS INTEGER) AS x,
  CAST(floor(value) AS INTEGER) % {HEIGHT} AS y, event_type IN ('click', 'purchase', 'view') AS "on" FROM events"""
LINES_SQL = f"""SELECT row_number() OVER (ORDER BY {", ".join(LINE_ORDER)}) - 1 AS seq, epoch_us(l_shipdate) - 694224000000000 AS t,
  CAST(l_suppkey % {WIDTH} AS INTEGER) AS x, CAST(l_partkey % {HEIGHT} AS INTEGER) AS y, l_returnflag <> 'N' AS "on" FROM lineitem"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.select(
        F.col("event_id").alias("seq"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").alias("t"),
        (F.col("user_id") % WIDTH).cast("int").alias("x"),
        (F.floor("value").cast("int") % HEIGHT).alias("y"),
        F.col("event_type").isin("click", "purchase", "view").alias("on"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by ship date, with ties. The table has no arrival order of its own, so one is made: ranks within a day, after the sum of earlier days."""
    from pyspark.sql import Window

    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    days = df.groupBy("l_shipdate").agg(F.count("*").alias("n"))
    before = days.select("l_shipdate", F.coalesce(F.sum("n").over(Window.orderBy("l_shipdate").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = df.withColumn("r", F.row_number().over(Window.partitionBy("l_shipdate").orderBy(*LINE_ORDER[1:])))
    return own.join(before, "l_shipdate").select(
        (F.col("before") + F.col("r") - 1).alias("seq"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1992-01-01 00:00:00', l_shipdate)").alias("t"),
        (F.col("l_suppkey") % WIDTH).cast("int").alias("x"),
        (F.col("l_partkey") % HEIGHT).cast("int").alias("y"),
        (F.col("l_returnflag") != "N").alias("on"),
    )


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder for files that are written and read again: in ``spark.checkpoint.dir``, which executors share, or without it, in a local session, a temporary one."""
    folder = files.scratch(spark, name)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return folder
