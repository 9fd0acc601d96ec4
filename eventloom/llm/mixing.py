"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they
belong to). A flow network routes each pattern's tokens to the sources'
quotas; taking a pattern again costs more each time (convex repetition cost),
so nothing repeats before all else is used. Within a pattern, documents stand
in seeded hash order, and each pass takes a prefix of that order.

Only sums by pattern reach the driver (as many rows as there are distinct
source combinations); documents are placed by prefix sums over hash buckets,
so that a source holding a third of all rows is still spread over many tasks.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; rows of equal key and size are interchangeable; texts are only
counted here, whatever their length; further columns are ignored, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import hot_parts, read, spread_join, table, words_in

SEED = 17
#: Hash buckets of a pattern: hexadecimal digits.
BUCKET_DIGITS = 3
#: The plan is broadcast up to so many patterns, and joined by a shuffle beyond.
BROADCAST_PATTERNS = 10_000
MAX_PASSES = 2
SHARE = 1.5
WEIGHTS = (3.0, 1.0, 2.0)


def capped_targets(sizes: Sequence[float], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size; what is cut off goes to the others by weight."""
    targets, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        unit = sum(weights[i] for i in sorted(free))
        over = {i for i in free if left * weights[i] / unit > cap * sizes[i]}
        if not over:
            for i in free:
                targets[i] = left * weights[i] / unit
            break
        for i in sorted(over):
            targets[i] = cap * sizes[i]
            left -= targets[i]
        free -= over
    return targets


def min_cost_flow(supplies: Sequence[float], members: Sequence[Sequence[int]], quotas: Sequence[float], passes: int) -> list[dict[int, float]]:
    """Flow from patterns to sources, by successive shortest paths.

    Pattern p offers ``supplies[p]`` in each pass at the cost of the pass
    number, and may serve the sources ``members[p]``, which take up to their
    quota. Returns, for each pattern, the amount for each source.
    """
    n_p, n_s = len(supplies), len(quotas)
    start, end = 0, 1 + n_p + n_s
    edges: list[list[float]] = []  # from, to, room, cost
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def link(a: int, b: int, room: float, cost: float) -> None:
        for x in ((a, b, room, cost), (b, a, 0.0, -cost)):
            out[x[0]].append(len(edges))
            edges.append([*x])

    for p in range(n_p):
        for k in range(passes):
            link(start, 1 + p, float(supplies[p]), float(k))
        for s in members[p]:
            link(1 + p, 1 + n_p + s, float("inf"), 0.0)
    for s in range(n_s):
        link(1 + n_p + s, end, float(quotas[s]), 0.0)
    tiny = 1e-9 * max(1.0, sum(quotas))
    while True:
        cost, via, queue = [float("inf")] * (end + 1), [-1] * (end + 1), [start]
        cost[start] = 0.0
        while queue:
            waiting = []
            for a in queue:
                for e in out[a]:
                    _, b, room, c = edges[e]
                    if room > tiny and cost[a] + c < cost[int(b)] - 1e-12:
                        cost[int(b)], via[int(b)] = cost[a] + c, e
                        waiting.append(int(b))
            queue = list(dict.fromkeys(waiting))
        if via[end] < 0:
            break
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = int(edges[via[at]][0])
        amount = min(edges[e][2] for e in path)
        for e in path:
            edges[e][2] -= amount
            edges[e ^ 1][2] += amount
    flow: list[dict[int, float]] = [{} for _ in range(n_p)]
    for a, b, room, _ in edges[1::2]:  # the reverse edges hold what flows
        if n_p < a < end and 0 < b <= n_p and room > 0:
            flow[int(b) - 1][int(a) - 1 - n_p] = room
    return flow


def mix(docs: DataFrame, key: Column, size: Column, sources: Column, *, total: float | None = None, weights: Sequence[float] = WEIGHTS, share: float = SHARE, passes: int = MAX_PASSES, seed: int = SEED, mark: Column | None = None) -> DataFrame:
    """Columns ``key, mark, size, sources, source_size, target, taken, routed``.

    ``sources`` is an array of names, null elements allowed. ``taken`` counts
    words with repeats; ``routed`` names the source served by each pass;
    ``mark`` is carried along, to tell rows of equal key.
    ``source_size`` and ``target`` are sums over the document's sources.
    """
    spark = docs.sparkSession
    name = F.transform(sources, lambda s: F.when(s.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), s)))
    rank = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}")))
    base = table(docs.select(key.alias("key"), (F.lit(None).cast("long") if mark is None else mark).alias("mark"), size.cast("long").alias("size"), F.array_sort(F.array_distinct(name)).alias("pattern"), rank.alias("rank")), "mix")

    sums = base.groupBy("pattern").agg(F.sum("size").alias("words"), F.count("*").alias("times")).collect()  # a row for each set of sources that documents have
    patterns = sorted((tuple(r.pattern), r.words) for r in sums)
    names = sorted({s for p, _ in patterns for s in p}, key=lambda s: (s[0] == "n", s))
    at = {s: i for i, s in enumerate(names)}
    own = [0.0] * len(names)
    for p, words in patterns:
        for s in p:
            own[at[s]] += words
    whole = sum(w for _, w in patterns) * share if total is None else total
    targets = capped_targets(own, [weights[i % len(weights)] for i in range(len(names))], whole, float(passes))
    flow = min_cost_flow([w for _, w in patterns], [[at[s] for s in p] for p, _ in patterns], targets, passes)
    plan_rows = []
    for (p, words), sent in zip(patterns, flow, strict=True):
        cuts, done = [], 0.0
        for s in sorted(sent):
            done += sent[s]
            cuts.append((done, None if names[s] == "n" else names[s][1:]))
        plan_rows.append(([*p], int(words), float(done), cuts, int(sum(own[at[s]] for s in p)), float(sum(targets[at[s]] for s in p))))
    schema = T.StructType.fromDDL("pattern array<string>, words long, take double, cuts array<struct<upto: double, source: string>>, source_size long, target double")
    plan = spark.createDataFrame(plan_rows, schema)

    bucket = F.substring("rank", 1, BUCKET_DIGITS)
    placed = base.withColumn("bucket", bucket)
    before = placed.groupBy("pattern", "bucket").agg(F.sum("size").alias("held"))
    before = before.withColumn("before", F.sum("held").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("held")
    inside = Window.partitionBy("pattern", "bucket").orderBy("rank", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(before, ["pattern", "bucket"])
    if len(plan_rows) <= BROADCAST_PATTERNS:
        placed = placed.join(F.broadcast(plan), "pattern")
    else:
        counts = spark.createDataFrame([([*r.pattern], r.times) for r in sums], "pattern array<string>, times long")
        placed = spread_join(placed, plan, ["pattern"], hot_parts(counts, ["pattern"], base.rows), ["rank"])
    middle = F.coalesce("before", F.lit(0)) + F.col("inside") + F.col("size") / 2
    # Pass k covers the words k * words up to (k + 1) * words; a document is in when its middle is below what is taken.
    spots = F.filter(F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), lambda k: k * F.col("words") + middle), lambda m: m < F.col("take"))
    routed = F.transform(spots, lambda m: F.element_at(F.filter("cuts", lambda c: m < c["upto"]), 1)["source"])
    return placed.select("key", "mark", "size", F.transform("pattern", lambda s: F.when(s == "n", F.lit(None)).otherwise(F.substring(s, 2, 1 << 30))).alias("sources"), "source_size", "target", (F.size(spots) * F.col("size")).cast("long").alias("taken"), routed.alias("routed"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    mixed = mix(docs, F.col("doc_id"), words_in(F.col("text")), F.array("source"))
    return mixed.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


#: The targets in closed form: sources fill up in the order of cap over weight.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null') || ':17') AS rank
  FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS i FROM d GROUP BY source
), s1 AS (
  SELECT source, source_size, CASE (i - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
         1.5::DOUBLE * sum(source_size) OVER () AS total FROM s0
), s2 AS (
  SELECT *, 2.0::DOUBLE * source_size / w AS full_at, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source) AS turn,
         coalesce(sum(2 * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w DESC, source DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open_w
  FROM s1
), s3 AS (
  SELECT arg_min((total - filled) / open_w, turn) FILTER (WHERE (total - filled) / open_w <= full_at) AS unit FROM s2
), s4 AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, s3.unit * w)::DOUBLE AS target FROM s2, s3
), p AS (
  SELECT d.*, s4.source_size, s4.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2.0::DOUBLE AS middle
  FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source
)
SELECT doc_id, size, source_size, target,
       (size * ((middle < target)::INT + (source_size + middle < target)::INT))::BIGINT AS taken FROM p
"""
