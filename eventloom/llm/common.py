"""What the corpus operators share: reading tables, intermediate tables, word rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The whitespace of every contract here: space and the code points 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
#: A word is a longest run of anything else.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where ``spark.checkpoint.dir`` is unset (a local session, as in
    tests) a new temporary folder is set instead.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="eventloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def table(df: DataFrame, name: str, items: Column | None = None) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back; ``rows`` is how many there are, and ``items`` the sum of a column.

    This cuts the lineage: a lost executor costs tasks of the running stage
    only, and several consumers read the table rather than recompute it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    counted = Observation()
    df.observe(counted, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.lit(0) if items is None else items), F.lit(0)).alias("items")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at, out.rows, out.items = path, counted.get["rows"], counted.get["items"]  # counted as they are written: a lost task may count twice
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``table`` has made and no later plan reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key is hot when it holds more than one in so many of the rows, so there are never more hot keys than this.
SHARE = 10_000
#: A key of at most so many rows is never split.
WHOLE_KEY = 64
#: Tables are broadcast up to this size, and joined by a shuffle beyond.
BROADCAST_BYTES = 8_000_000
#: An item of a list in such a table takes about so many.
ITEM_BYTES = 40


def fits_broadcast(right: DataFrame, width: int) -> bool:
    """Whether ``right`` (a stored table, or cheap to count), of about ``width`` bytes a row, is small enough to broadcast."""
    rows = getattr(right, "rows", None)
    if rows is None:
        rows = right.limit(BROADCAST_BYTES // width + 1).count()
    return rows * width + getattr(right, "items", 0) * ITEM_BYTES <= BROADCAST_BYTES


def hot_parts(counts: DataFrame, on: list[str], total: int) -> DataFrame:
    """``on, parts`` for the hot keys of ``counts`` (on, times), whose times add up to at most ``total``.

    At most ``SHARE`` rows, whatever the data, and parts that add up to twice that.
    """
    unit = max(total // SHARE, WHOLE_KEY)
    return counts.where(F.col("times") > unit).select(*on, F.ceil(F.col("times") / unit).cast("int").alias("parts"))


def spread_join(left: DataFrame, right: DataFrame, on: list[str], parts: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, where rows of a hot key of ``left`` are dealt out by the hash of ``by``, and the key's rows in ``right`` are repeated for each part."""
    parts = F.broadcast(parts)
    dealt = left.join(parts, on, "left").withColumn("_part", F.pmod(F.xxhash64(*by), F.coalesce("parts", F.lit(1)).cast("long")).cast("int")).drop("parts")
    there = right.join(parts, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(there, [*on, "_part"], how).drop("_part")


def lookup(left: DataFrame, right: DataFrame, on: str, by: list[str], *, width: int = 16, how: str = "inner") -> DataFrame:
    """``left``, a stored table, joined to ``right`` by the column ``on``: by a broadcast while ``right`` is small, else by a shuffle that splits hot keys."""
    if fits_broadcast(right, width):
        return left.join(F.broadcast(right), on, how)
    counts = left.groupBy(on).agg(F.count("*").alias("times"))
    return spread_join(left, right, [on], hot_parts(counts, [on], left.rows if hasattr(left, "rows") else left.count()), by, how)


def part_of(stored: DataFrame, *columns) -> DataFrame:
    """Columns of a stored table, which keep its count."""
    out = stored.select(*columns)
    out.rows, out.items = stored.rows, stored.items
    return out


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to clash with no column of ``docs``."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def same_row(key: Column, text: Column) -> list[Column]:
    """Columns ``_id`` and ``_text`` by which rows of equal key and text can be joined, of null ones too."""
    return [key_name(key).alias("_id"), F.xxhash64(text.isNull(), text).alias("_text")]


def key_name(key: Column) -> Column:
    """A string for each key, and one for null."""
    return F.concat(F.when(key.isNull(), F.lit("n")).otherwise(F.lit("k")), F.coalesce(key.cast("string"), F.lit("")))


def with_found(docs: DataFrame, key: str, text: str, found: DataFrame) -> DataFrame:
    """``row`` (all of a row of ``docs`` as a struct), ``text``, and the columns of ``found`` (_id, _text, ...) or nulls.

    ``found`` grows with the documents, so it isn't broadcast: the texts are
    shuffled once, at any size, and rows that repeat very often are split.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), *same_row(F.col(key), F.col(text)))
    counts = rows.groupBy("_id", "_text").agg(F.count("*").alias("times"))
    many = table(counts.where(F.col("times") > WHOLE_KEY), "repeated", F.col("times"))
    parts = hot_parts(many, ["_id", "_text"], many.items)
    rows = rows.withColumn("_any", F.monotonically_increasing_id())  # only deals rows out; any value will do
    return spread_join(rows, found, ["_id", "_text"], parts, ["_any"], "left").drop("_id", "_text", "_any")


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """``batches`` in smaller ones, so that what is made of a batch is small too; memory that a batch took is given back after it."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        del batch
        pa.default_memory_pool().release_unused()


def words_in(text: Column) -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
