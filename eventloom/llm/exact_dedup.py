"""Exact deduplication by content-defined chunk recipes.

Each text, with every run of whitespace replaced by one space, is cut where a
rolling hash of its last bytes says so; equal texts are cut alike, and long
texts that share passages share chunks. A chunk gets an identifier that is
verified against the chunk's SHA-256: where two digests meet on one 64-bit
hash, they are told apart by rank. A document is then the ordered list of its
chunks' identifiers, and documents are equal when these lists are. Only
hashes move between tasks, never texts.

Defined results: a null text counts as empty; an empty text has the empty
recipe; of rows with equal texts the one of smallest key stays (null keys
last), and of repeated rows one; an empty table gives one; a text of any
length is cut in its own row; further columns are ignored, whatever their
names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm.common import fits_broadcast, hot_parts, read, spread_join, table

LEAST, MOST = 256, 8192
#: A cut follows a byte where so many high bits of the rolling hash are 0.
CUT_BITS = 10
SCHEMA = "key long, sha binary, hashes array<long>, digests array<binary>"


@cache
def byte_codes() -> np.ndarray:
    """A pseudo-random 32-bit code for each byte, by a fixed multiplicative rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(29)
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)


def normalised(text: str | None) -> bytes:
    data = (text or "").encode()
    out = b" ".join(data.split())
    if not data or not out:
        return b" " if data else b""
    return b" " * data[:1].isspace() + out + b" " * data[-1:].isspace()


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``. The hash at a byte covers it and the 15 before it."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = byte_codes()[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8):
        ahead = h[:-k] << np.uint32(k)
        h = h.copy()
        h[k:] += ahead
    spots = np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1
    ends, at = [], 0
    for end in [*spots.tolist(), n]:
        while end - at > MOST:
            at += MOST
            ends.append(at)
        if end - at >= LEAST or end == n > at:
            ends.append(end)
            at = end
    return ends


def recipes(docs: DataFrame, key: Column, text: Column) -> DataFrame:
    """``SCHEMA``: for each row the hashes and digests of its chunks, and the digest of its normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            shas, hashes, digests = [], [], []
            for t in batch.column(1).to_pylist():
                data, at = normalised(t), 0
                own, full = [], []
                for end in cuts(data):
                    chunk = data[at:end]
                    own.append(xxhash.xxh3_64_intdigest(chunk) - (1 << 63))
                    full.append(hashlib.sha256(chunk).digest())
                    at = end
                shas.append(hashlib.sha256(data).digest())
                hashes.append(own)
                digests.append(full)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(digests, pa.list_(pa.binary()))], ["key", "sha", "hashes", "digests"])

    return docs.select(key.cast("long").alias("key"), text.alias("text")).mapInArrow(run, SCHEMA)


def exact_groups(docs: DataFrame, key: Column, text: Column) -> DataFrame:
    """``key, keep_id, group_size, kept, sha`` for each row."""
    cut = table(recipes(docs, key, text), "recipes")
    # Repeated rows are one entry with a count, and so may be told by key and digest.
    entry = cut.groupBy("key", "sha").agg(F.count("*").alias("times"))
    chunk = cut.select("key", "sha", F.posexplode(F.arrays_zip("hashes", "digests")).alias("pos", "c")).select("key", "sha", "pos", F.col("c.hashes").alias("hash"), F.col("c.digests").alias("digest"))
    met = chunk.groupBy("hash").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.count("*").alias("times")).where("lo != hi")
    met = table(met.select("hash", "times"), "met")
    ranks = table(chunk.join(F.broadcast(met) if fits_broadcast(met, 16) else met, "hash").select("hash", "digest").distinct(), "ranks")
    ranks = table(ranks.withColumn("rank", F.row_number().over(Window.partitionBy("hash").orderBy("digest"))), "ranks")
    if fits_broadcast(ranks, 64):
        named = chunk.join(F.broadcast(ranks), ["hash", "digest"], "left")
    else:  # the digests of a hash are few, so that its count tells what is hot
        parts = hot_parts(met, ["hash"], met.agg(F.sum("times")).first()[0])
        named = spread_join(chunk, ranks.withColumnRenamed("digest", "known"), ["hash"], parts, ["key", "sha", "pos"], "left").where(F.col("known").isNull() | (F.col("known") == F.col("digest")))
    named = named.select("key", "sha", "pos", F.struct("hash", F.coalesce("rank", F.lit(0)).alias("rank")).alias("id"))
    listed = named.distinct().groupBy("key", "sha").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("l")).select("key", "sha", F.col("l.id").alias("recipe"))
    same = (F.col("a.key").eqNullSafe(F.col("b.key"))) & (F.col("a.sha") == F.col("b.sha"))
    whole = entry.alias("a").join(listed.alias("b"), same, "left").select("a.*", F.coalesce("recipe", F.array().cast("array<struct<hash: long, rank: int>>")).alias("recipe"))
    whole = table(whole, "listed")
    # Most recipes are of one entry and need no join; those of very many are split.
    groups = whole.groupBy("recipe").agg(F.min("key").alias("keep_id"), F.sum("times").alias("group_size"), F.count("*").alias("times")).where("times > 1")
    groups = table(groups, "groups")
    parts = hot_parts(groups, ["recipe"], groups.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0])
    out = spread_join(whole, groups.select("recipe", "keep_id", "group_size"), ["recipe"], parts, ["key", "sha"], "left")
    first = F.when(F.col("group_size").isNull(), F.col("key")).otherwise(F.col("keep_id"))
    out = out.select("key", "sha", first.alias("keep_id"), F.coalesce("group_size", "times").alias("group_size"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("turn"))
    return out.select("key", "keep_id", "group_size", (F.col("key").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"), "sha")


def query(spark, sf_dir: str) -> DataFrame:
    found = exact_groups(read(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))
    return found.select(F.col("key").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
