"""Language identification by compression.

A text is encoded once per language with zstandard, each time against a
raw-content dictionary made of that language's own text; the language whose
dictionary yields the fewest bytes is chosen (case is folded first). The
dictionaries are learned from a bounded sample of labelled rows, whose texts
are taken whole; every text is scored whole.

Defined results: a null text, or one without any letter, is ``und`` with
score 0; ties go to the first language by code point; with no learned
language all rows are ``und``; equal texts have equal results, so repeated rows
have, too; an empty table gives one; a text of any length is encoded in blocks
in its own task; further columns of the input are ignored, whatever their
names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A dictionary is made of at most so many documents of a language ...
DOCS_PER_LANGUAGE = 64
#: ... preferably of at most so many characters; longer ones are taken, whole, only for want of others.
PREFERRED_CHARS = 2000
#: Longer texts are encoded in blocks, so that the dictionary keeps counting.
BLOCK_BYTES = 8192
#: A choice is accepted when the second best needs this share more bytes.
LEAST_MARGIN = 0.01
#: Of zstandard; below it the matcher is too coarse for texts of a few words.
LEVEL = 6

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, margin double, accepted boolean"


def learn(labelled: DataFrame, key: str, text: str, lang: str) -> dict[str, bytes]:
    """Raw-content dictionaries by language.

    The sample is bounded: of each language, keys fall into
    ``DOCS_PER_LANGUAGE`` hash classes and of each class one row is taken, that
    of least hash among those of preferred length, or else among all (a partial
    aggregation, so a frequent language is no hot spot).
    """
    known = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(text).alias("m")).where("k is not null and l is not null and length(t) > 0")
    spot = F.xxhash64("k", F.lit("dictionary"))
    place = F.struct((F.length("t") > PREFERRED_CHARS).alias("long"), spot.alias("h"), "k", "m")
    chosen = known.groupBy("l", F.pmod(spot, F.lit(DOCS_PER_LANGUAGE)).alias("class")).agg(F.min(place).alias("least")).select("l", "least.h", "least.k", "least.m")
    rows = known.join(F.broadcast(chosen), ["k", "l", "m"]).select("l", "h", "k", "t").distinct().collect()  # at most DOCS_PER_LANGUAGE for each language
    parts: dict[str, list[tuple[int, int, str]]] = defaultdict(list)
    for r in rows:
        parts[r.l].append((r.h, r.k, r.t))
    return {lang: "\n".join(t for _, _, t in sorted(own)).lower().encode() for lang, own in sorted(parts.items())}


def encoded_sizes(dictionaries: dict[str, bytes]):
    """A function from a text's bytes to its encoded size under each dictionary, in the order given."""
    import zstandard

    coders = []
    for content in dictionaries.values():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def sizes(data: bytes) -> list[int]:
        if len(data) <= BLOCK_BYTES:
            return [len(c(data)) for c in coders]
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(c(b)) for b in blocks) for c in coders]

    return sizes


def judged(sizes: list[int], names: list[str]) -> tuple[str, float, float]:
    """Language, score and margin. The score is the choice's share when each saved byte doubles the odds twice a bit."""
    if not sizes:
        return "und", 0.0, 0.0
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], names[i]))
    best = sizes[order[0]]
    margin = (sizes[order[1]] - best) / sizes[order[1]] if len(order) > 1 else 1.0
    return names[order[0]], 1.0 / sum(2.0 ** (-0.5 * min(s - best, 2000)) for s in sizes), margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], key: Column, text: Column, held_out: Column) -> DataFrame:
    """One row of ``SCHEMA`` per row of ``docs``; map-only, the dictionaries travel with the task (a bounded size for each language)."""
    names = list(dictionaries)
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = encoded_sizes(sent.value)
        for batch in batches:
            seen: dict[str, tuple[str, float, float]] = {}
            out = []
            for t in batch.column(1).to_pylist():
                if t is None or not any(map(str.isalpha, t)):
                    out.append(("und", 0.0, 0.0))
                    continue
                if t not in seen:
                    seen[t] = judged(sizes(t.lower().encode()), names)
                out.append(seen[t])
            lang, score, margin = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array([m >= LEAST_MARGIN for m in margin], pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "margin", "accepted"],
            )

    return docs.select(key.cast("long").alias("doc_id"), text.alias("text"), held_out.alias("held_out")).mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """Predictions for all documents, learned from those whose crc32(doc_id) mod 4 is not 2."""
    from eventloom.llm.common import read

    docs = read(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    dictionaries = learn(docs.where(fold != 2), "doc_id", "text", "lang")
    return identify(docs, dictionaries, F.col("doc_id"), F.col("text"), F.coalesce(fold == 2, F.lit(False)))
