"""Line deduplication by winnowing over line hashes (DataFrame functions only).

A run of lines that occurs before, in the order of key and line, is deleted
where it occurs again. A run counts from ``least`` lines on, or from one line
of ``long`` characters.

1. Every line becomes a hash; grams of ``gram`` consecutive hashes slide over
   the document, and of every ``least - gram + 1`` neighbouring grams the
   smallest is kept as a fingerprint. So any run of ``least`` lines holds one
   at the same place wherever it stands: the guarantee of winnowing. A long
   line is a fingerprint of its own.
2. Fingerprints that occur once are dropped; the others' positions join.
3. At each position left, the match is extended both ways into all runs of
   ``least`` lines around the fingerprint, each under a 128-bit key. Longer
   repeats are unions of these.
4. Of equal runs the first stays; lines of later ones are deleted.

No pairs of positions are formed: each step counts, or takes the least of, a
group, so a passage shared by any number of documents costs what its
occurrences cost; and keys of very many occurrences are split in the joins.

Defined results: blank lines take no part and stay; surrounding whitespace of
a line is ignored in comparing; a null text stays null; documents without a
run long enough, and empty tables, stay as they are; texts of any length are
cut into lines in their own row; rows of equal key count as standing at the
same place, so repeated rows are treated alike and neither is the later; null
keys come first. Further columns stay, whatever their names: the two counts
take free names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import free_names, hot_parts, read, same_row, spread_join, table, with_found

GRAM = 2
LEAST = 3
LONG = 50


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def fingerprints(docs: DataFrame, key: str, text: str, gram: int, least: int, long: int) -> DataFrame:
    """``k, _id, _text, mark, runs``: for each fingerprint the runs around it (place, length and key)."""
    span = least - gram + 1
    own = F.filter(F.transform(split_lines(F.col(text)), bare), lambda s: s != "")
    lines = docs.select(F.col(key).alias("k"), *same_row(F.col(key), F.col(text)), own.alias("own"))
    hashed = lines.select("k", "_id", "_text", F.size("own").alias("n"), F.transform("own", lambda s: F.xxhash64(s)).alias("h"), F.transform("own", lambda s: F.xxhash64(F.lit("line"), s)).alias("g"), F.transform("own", lambda s: F.length(s) >= long).alias("wide"))
    hashed = hashed.where((F.col("n") >= least) | F.array_contains("wide", True))
    grams = hashed.withColumn("grams", F.when(F.col("n") >= gram, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - gram + 1)), lambda i: F.xxhash64(F.slice("h", i, F.lit(gram))))))
    near = lambda i: F.slice("grams", i, F.lit(span))
    chosen = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - least + 1)), lambda i: (i - 1 + F.array_position(near(i), F.array_min(near(i)))).cast("int")))
    run = lambda at, size, k1, k2: F.struct(at.cast("int").alias("at"), F.lit(size).alias("size"), k1.alias("k1"), k2.alias("k2"))
    around = lambda p: F.transform(
        F.sequence(F.greatest(F.lit(1), p - span + 1), F.least(p, F.col("n") - least + 1)),
        lambda i: run(i, least, F.xxhash64(F.slice("h", i, F.lit(least))), F.xxhash64(F.slice("g", i, F.lit(least)))),
    )
    several = F.transform(chosen, lambda p: F.struct(F.element_at("grams", p).alias("mark"), around(p).alias("runs")))
    alone = lambda i: F.struct(F.xxhash64(F.lit("long"), F.element_at("h", i)).alias("mark"), F.array(run(i, 1, F.xxhash64(F.lit("long"), F.element_at("h", i)), F.xxhash64(F.lit("long"), F.element_at("g", i)))).alias("runs"))
    single = F.transform(F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.element_at("wide", i)), alone)
    marks = F.concat(F.when(F.col("n") >= least, several).otherwise(F.slice(single, 1, 0)), single)
    return grams.where("n > 0").select("k", "_id", "_text", F.explode(marks).alias("m")).select("k", "_id", "_text", "m.*")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", *, gram: int = GRAM, least: int = LEAST, long: int = LONG) -> DataFrame:
    """The columns of ``docs`` with ``text`` reduced, and ``_lines`` and ``_removed`` (counts of lines that aren't blank) as the last two, under free names."""
    marks = fingerprints(docs, key, text, gram, least, long)
    shared = table(marks.groupBy("mark").agg(F.count("*").alias("times")).where("times > 1"), "shared")
    total = shared.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    runs = spread_join(marks, shared.select("mark"), ["mark"], hot_parts(shared, ["mark"], total), ["_id", "_text"], "left_semi")
    runs = table(runs.select("k", "_id", "_text", F.explode("runs").alias("r")).select("k", "_id", "_text", "r.*"), "runs")
    place = F.struct("k", "at")
    first = table(runs.groupBy("k1", "k2").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("times")).where("lo < hi").select("k1", "k2", "lo", "times"), "first")
    later = spread_join(runs, first.drop("times"), ["k1", "k2"], hot_parts(first, ["k1", "k2"], runs.rows), ["_id", "_text"]).where(place > F.col("lo"))
    gone = table(later.groupBy("_id", "_text").agg(F.collect_set(F.struct("at", "size")).alias("at")), "gone")

    n_lines, n_removed = free_names(docs, "_lines", "_removed")
    out = with_found(docs, key, text, gone).withColumn("every", split_lines(F.col("text")))
    out = out.withColumn("own", F.filter(F.sequence(F.lit(1), F.size("every")), lambda i: bare(F.element_at("every", i)) != ""))
    places = F.array_distinct(F.flatten(F.transform("at", lambda s: F.transform(F.sequence(s["at"], s["at"] + s["size"] - 1), lambda i: F.element_at("own", i)))))
    out = out.withColumn("gone", F.when(F.col("at").isNotNull(), places))
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(1), F.size("every")), "gone"), lambda i: F.element_at("every", i)), "\n")
    now = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    return out.select(*[now.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns], F.size("own").cast("long").alias(n_lines), F.greatest(F.lit(0), F.coalesce(F.size("gone"), F.lit(0))).cast("long").alias(n_removed))


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"))


#: Runs of LEAST lines, and lines of LONG characters, as texts, without fingerprints.
ORACLE = r"""
WITH l AS (
  SELECT doc_id, line, pos, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), o AS (
  SELECT doc_id, pos, bare, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS spot FROM l WHERE bare <> ''
), r AS (
  SELECT doc_id, spot, bare AS b1, lead(bare, 1) OVER w AS b2, lead(bare, 2) OVER w AS b3 FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY spot)
), again AS (
  SELECT doc_id, spot, 3 AS size FROM (SELECT doc_id, spot, row_number() OVER (PARTITION BY b1, b2, b3 ORDER BY doc_id, spot) AS turn FROM r WHERE b3 IS NOT NULL) WHERE turn > 1
  UNION ALL
  SELECT doc_id, spot, 1 FROM (SELECT doc_id, spot, row_number() OVER (PARTITION BY bare ORDER BY doc_id, spot) AS turn FROM o WHERE length(bare) >= 50) WHERE turn > 1
), gone AS (
  SELECT DISTINCT o.doc_id, o.pos FROM o JOIN again a ON o.doc_id = a.doc_id AND o.spot BETWEEN a.spot AND a.spot + a.size - 1
), kept AS (
  SELECT l.doc_id, string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos) AS text,
         count(*) FILTER (WHERE l.bare <> '') AS n_lines, count(g.pos) AS n_removed
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN n_removed = 0 THEN d.text ELSE coalesce(kept.text, '') END AS text, n_lines, n_removed
FROM documents d JOIN kept ON d.doc_id = kept.doc_id
"""
