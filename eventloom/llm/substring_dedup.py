"""Substring deduplication by sliding sentence spans.

A text is cut into sentences at words that follow ``.``, ``!`` or ``?``, start
a line, or are capitalised (a passage pasted into the middle of a sentence
starts so). From every sentence slides a span: the fewest consecutive
sentences, at least ``sentences``, that hold at least ``words`` words. Spans
are hashed over their words and joined globally; a sentence that any span
other than the first of its kind covers is removed, with the space after it.

First means least in the order of key and position. Texts are compared by
words, so spacing doesn't matter. Per span only two hashes, the key and its
place move; a shared span costs what its occurrences cost, no pairs are formed,
and a span of very many occurrences is split in the joins.

With ``most`` a span holds at most so many words, and ends within a sentence if
it must; and of every ``gap`` words in a row none of which starts a sentence,
the one of least hash starts a span too. Both depend on those words alone. So
where one sentence is enough for a span and ``gap + most`` is at most 50, every
run of 50 words (with the same line breaks) holds a whole span that is the same
wherever the run stands: one starts among its words 2 to ``gap + 1``. With
``gap`` at most ``words`` the spans of a longer run leave no holes.

Defined results: a null text stays null; texts with fewer sentences or words
than a span needs, and empty tables, stay as they are; a text of any length is
cut in its own row; rows of equal key count as standing at the same place, so
neither of two repeated rows is the later; null keys come first; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import discard, hot_parts, key_name, read, spread_join, table, with_found

SENTENCES = 3
WORDS = 20
#: The query's spans: repeated runs of GAP + MOST words hold one, whatever their sentences.
GAP, MOST = 20, 30
#: ``a`` and ``b`` are the halves of a span's digest.
SPANS = "key long, row long, spans array<struct<a: long, b: long, start: int, stop: int>>"

_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_STOP = np.isin(np.arange(256), list(b".!?"))
_CODES = np.where(_SPACE, 0, np.random.RandomState(8).randint(1, 1 << 62, 256)).astype(np.uint64)
_UPPER = np.isin(np.arange(256), list(range(65, 91)))


def _upper(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a capital of ASCII or Latin-1 starts at each place, and where the next character is."""
    last = len(data) - 1
    first, second = data[np.minimum(at, last)], data[np.minimum(at + 1, last)]
    wide = (first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
    return _UPPER[first] | wide, at + 1 + wide


def words_and_sentences(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The byte where each word starts, and the number of each sentence's first word."""
    data = np.frombuffer(text, np.uint8)
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, starts
    lines = np.cumsum(data == 10)
    capital, following = _upper(data, starts)
    capital &= ~_upper(data, following)[0]
    opens = capital.copy()
    opens[0] = True
    opens[1:] |= _STOP[data[ends[:-1] - 1]] | (lines[starts[1:] - 1] > lines[ends[:-1] - 1])
    return starts, np.flatnonzero(opens)


def inner_starts(data: np.ndarray, starts: np.ndarray, first: np.ndarray, gap: int) -> np.ndarray:
    """The words of least hash of all ``gap`` words in a row that start no sentence."""
    if not 0 < gap <= len(starts):
        return first[:0]
    before = np.zeros(len(starts) + 1, np.int64)
    before[first + 1] = 1
    before = np.cumsum(before)
    free = np.flatnonzero(before[gap:] == before[:-gap])
    if not len(free):
        return free
    # Letters in another order hash alike; that moves a start, and moves it wherever the words stand.
    rank = np.add.reduceat(_CODES[data], starts) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
    return np.unique(free + np.lib.stride_tricks.sliding_window_view(rank, gap)[free].argmin(1))


def spans(text: bytes, sentences: int, words: int, digest, gap: int = 0, most: int | None = None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The digest, first word and one past the last of each span."""
    own = text.split()
    starts, first = words_and_sentences(text)
    start = np.union1d(first, inner_starts(np.frombuffer(text, np.uint8), starts, first, gap))
    first = np.append(first, len(starts))
    stop = np.maximum(np.searchsorted(first, start + words), np.searchsorted(first, start, "right") - 1 + sentences)
    good = stop < len(first)
    start, stop = start[good], first[stop[good]]
    if most is not None:
        stop = np.minimum(stop, start + most)
    joined = b" ".join(own)
    at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)))
    return [digest(joined[i:j]) for i, j in zip(at[start].tolist(), (at[stop] - 1).tolist(), strict=True)], start, stop


def all_spans(docs: DataFrame, key: str, text: str, sentences: int, words: int, gap: int, most: int | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            found = [spans((t or "").encode(), sentences, words, xxhash.xxh3_128_digest, gap, most) for t in batch.column(1).to_pylist()]
            ids = np.frombuffer(b"".join(x for f in found for x in f[0]), np.int64).reshape(-1, 2)
            places = [pa.array(np.concatenate([np.empty(0, np.int64), *(f[k] for f in found)]).astype(np.int32)) for k in (1, 2)]
            held = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(ids[:, k])) for k in (0, 1)] + places, names=["a", "b", "start", "stop"])
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(f[0]) for f in found]))), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(offsets, held)], ["key", "row", "spans"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text).isNull(), F.col(text)).alias("row")).mapInArrow(run, SPANS)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", *, sentences: int = SENTENCES, words: int = WORDS, gap: int = 0, most: int | None = None) -> DataFrame:
    """A table ``key, row, cover``: for each row that has any, its spans (first, one past last word) that aren't the first of their kind."""
    # Counting and the rest each hash the texts: a stored table of all spans would take more disk than the texts take time.
    found = all_spans(docs, key, text, sentences, words, gap, most).select("key", "row", F.explode("spans").alias("s")).select("key", "row", "s.*")
    often = table(found.groupBy("a").agg(F.count("*").alias("times")).where("times > 1"), "often")
    total = often.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    met = table(spread_join(found, often.select("a"), ["a"], hot_parts(often, ["a"], total), ["row", "start"], "left_semi"), "met")
    place = F.struct("key", "start")
    first = table(met.groupBy("a", "b").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("times")).where("lo < hi").select("a", "b", "lo", "times"), "first")
    later = spread_join(met, first.drop("times"), ["a", "b"], hot_parts(first, ["a", "b"], total), ["row", "start"]).where(place > F.col("lo"))
    out = table(later.groupBy("key", "row").agg(F.collect_set(F.struct("start", "stop")).alias("cover")), "cover")
    discard(often, met, first)
    return out


REMOVED = "key long, text string, n_removed long"


def without(text: str, cover: list[tuple[int, int]]) -> tuple[str, int]:
    """``text`` without the words in the ranges given, and how many sentences lose any."""
    data = text.encode()
    starts, first = words_and_sentences(data)
    change = np.zeros(len(starts) + 1, np.int64)
    for start, stop in cover:
        change[start] += 1
        change[stop] -= 1
    drop = np.cumsum(change[:-1]) > 0
    turns = np.flatnonzero(np.diff(drop.astype(np.int8), prepend=0))
    edges = [0, *starts[turns].tolist(), len(data)]
    if drop[:1].any():  # and the space before
        edges[1] = 0
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=False)).decode(), int(np.add.reduceat(drop, first, dtype=np.int64).astype(bool).sum())


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", *, sentences: int = SENTENCES, words: int = WORDS, gap: int = 0, most: int | None = None) -> DataFrame:
    """``REMOVED`` for each row of ``docs``; ``n_removed`` counts sentences that are removed or, with ``most``, lose words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covers = batch.column(2).to_pylist()
            out = [without(t, [(c["start"], c["stop"]) for c in cover]) if cover else (t, 0) for t, cover in zip(batch.column(1).to_pylist(), covers, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], ["key", "text", "n_removed"])

    cover = repeated_spans(docs, key, text, sentences=sentences, words=words, gap=gap, most=most)
    base = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    joined = with_found(base, "key", "text", cover.select(key_name(F.col("key")).alias("_id"), F.col("row").alias("_text"), "cover"))
    return joined.select("row.key", "text", "cover").mapInArrow(run, REMOVED)


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), sentences=1, gap=GAP, most=MOST).withColumnRenamed("key", "doc_id")
