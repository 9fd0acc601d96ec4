"""Live cameras: an interface only, since drivers are optional packages of their vendors."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

BUFFER = 1024


def events_stream_from_camera(spark: SparkSession, drivers: tuple[str, ...] = (), manufacturer: str | None = None, buffer_size: int = BUFFER):
    """Tries the driver modules in turn; each offers ``open(spark, manufacturer, buffer_size)``, which gives a streaming DataFrame and the sensor's sides."""
    from eventloom.model import EventStream

    for name in drivers:
        try:
            module = import_module(name)
        except ImportError:
            continue
        df, width, height = module.open(spark, manufacturer, buffer_size)
        return EventStream(df, width, height, finite=False)
    raise RuntimeError("no camera driver is installed")


def demonstration(spark: SparkSession, width: int = 64, height: int = 48, rows_per_second: int = 1000):
    """An infinite made-up stream, for trying out live queries."""
    from eventloom.model import EventStream

    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    spot = F.pmod(F.xxhash64("value"), F.lit(width * height))
    df = rate.select(F.col("value").alias("seq"), F.unix_micros("timestamp").alias("t"), (spot % width).cast("int").alias("x"), F.floor(spot / width).cast("int").alias("y"), (F.col("value") % 2 == 0).alias("on"))
    return EventStream(df, width, height, finite=False)
