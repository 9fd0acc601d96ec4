"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import discard, hot_parts, lookup, spread_join, table

#: So many edges, whatever the input's size, are taken in one task.
FEW = 10_000


def of_few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, root`` of the edges (a, b) of one task."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (above := up.setdefault(x, x)) != x:
            up[x] = x = up[above]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = sorted((top(a), top(b)))
            up[b] = a
    yield pa.RecordBatch.from_arrays([pa.array([*up], pa.int64()), pa.array([top(x) for x in up], pa.int64())], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b: long); the root is the least node of the component.

    Alternating large-star and small-star steps: each rewires neighbours to
    the least node known, until nothing changes. Only edges are stored, never
    members of a component in one row, and each step is a partial aggregation
    and a join, in which a node of very many edges is split. At most ``FEW``
    edges need no steps.
    """
    now = table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    if now.rows <= FEW:
        return now.coalesce(1).mapInArrow(of_few, "node long, root long")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        seen = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("times"))
        low = seen.select("a", F.least("a", "low").alias("low"))
        parts = hot_parts(seen, ["a"], 2 * now.rows)
        large = table(spread_join(both, low, ["a"], parts, ["b"]).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b").distinct(), "large")
        seen = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("times"))
        least = seen.select("a", "low")
        small = spread_join(large, least, ["a"], hot_parts(seen, ["a"], large.rows), ["b"])
        small = small.where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b"))).distinct()
        new = table(small, "edges", F.xxhash64("a", "b").cast("decimal(38,0)"))
        discard(now, large)
        now, last, mark = new, mark, (new.rows, new.items)
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def merged(root: DataFrame | None, links: DataFrame) -> DataFrame:
    """A table ``node, root`` of the components of ``root`` (such a table, or none) after ``links`` (a, b) join some of them.

    Only the links between roots take part in the steps, so a few late links
    cost little.
    """
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    if root is None:
        return table(components(links), "roots")
    ends = table(ends.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.col("root").isNull().alias("new")), "ends")
    end = lambda x: ends.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    up = table(components(links.join(end("a"), "a").join(end("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("up")), "up")
    every = root.unionByName(ends.where("new").select("node", "root"))
    return table(lookup(every, up, "root", ["node"], how="left").select("node", F.coalesce("up", "root").alias("root")), "roots")
