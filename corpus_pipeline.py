"""A corpus pipeline: from raw documents to packed training sequences.

Each stage is one operator of ``eventloom.llm``, works on all that its
predecessor kept, and is written as Parquet before the next one reads it.

Defined results in every stage: an empty table gives one; rows of null id, of
null, empty or very long text and repeated rows are handled as each operator
says, and a row is told by its id and text; further columns go along, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import jaccard_join, line_dedup, mixing, packing, quality
from eventloom.llm.common import key_name, lookup, read, table, with_found, words_in

#: Near copies share this similarity of shingles of so many words.
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 80, 100


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    judged = quality.judged(docs, read(spark, sf_dir, "labels"))
    return judged.where(F.col(judged.columns[-1])).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later runs of lines go; documents stay, if need be with an empty text, and ``n_chars`` follows."""
    out = line_dedup.dedup_lines(docs)
    return out.select(*[F.when(F.col(out.columns[-1]) > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else c for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one text stays, that of least id (null if there is no other) and then of least hash, and of repeated rows one.

    Rows are told apart by id and text: other texts of an id stay, also of a null id.
    """
    mark = F.xxhash64(F.col("text").isNull(), F.col("text"))  # as ``with_found`` tells texts
    found = table(jaccard_join.joined(docs, F.col("doc_id"), F.col("text"), words=NEAR_WORDS, num=NEAR_NUM, den=NEAR_DEN, mark=mark).select("doc", "mark", "root"), "near")
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "mark")
    # Components of one row need no join, and rows of an empty text have none.
    least = found.where("root IS NOT NULL").groupBy("root").agg(F.min(place).alias("least"), F.count("*").alias("rows")).where("rows > 1").select("root", "least")
    state = lookup(found, table(least, "least"), "root", ["mark"], width=60, how="left").groupBy("doc", "mark").agg(F.min(F.coalesce(place == F.col("least"), F.lit(True))).alias("stays"), F.count("*").alias("times"))
    state = table(state.where("NOT stays OR times > 1").select(key_name(F.col("doc")).alias("_id"), F.col("mark").alias("_text"), "stays", "times"), "state")
    left = with_found(docs, "doc_id", "text", state).where("stays IS NULL OR stays")
    once = left.where("times > 1").groupBy("row.doc_id", "text").agg(F.first("row").alias("row"))
    return left.where("times IS NULL OR times = 1").select("row").unionByName(once.select("row")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be never."""
    mark = F.xxhash64(F.col("text").isNull(), F.col("text"))
    mixed = mixing.mix(docs, F.col("doc_id"), words_in(F.col("text")), F.array("source"), mark=mark)
    passes = mixed.groupBy("key", "mark").agg(F.max(F.size("routed")).alias("passes")).where("passes > 0")
    passes = table(passes.select(key_name(F.col("key")).alias("_id"), F.col("mark").alias("_text"), "passes"), "passes")
    taken = with_found(docs, "doc_id", "text", passes).where("passes IS NOT NULL")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("passes")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences and places."""
    return packing.pack(docs, F.col("doc_id"), F.col("text"))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The quality model can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
