"""Best-fit packing of tokenised documents by patterns of lengths.

1. Each text becomes token ids and a final end id. Documents longer than a
   sequence are cut into whole sequences, the first piece holding what is
   left over; pieces of full length are sequences of their own.
2. The histogram of the other lengths (at most ``capacity - 1`` numbers,
   whatever the input's size) goes to the driver. There, patterns of two and
   three lengths that fill a sequence exactly are enumerated, repeat counts
   are fitted to the histogram by non-negative least squares and rounded
   down, and what remains is packed best fit, longest first, by length and
   count. The plan is a table of intervals: pieces of length L numbered from
   lo to hi go to sequences numbered from base, at an offset.
3. Pieces are numbered within their length by prefix sums over salted groups,
   and look up their interval.

Defined results: a null text counts as empty (the end id alone); rows of equal
key are pieces of their own; pieces of equal length stand in the order
of key, place and checksum; a text of any length is encoded in its own task;
further columns are ignored, whatever their names; an empty table gives no
rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import read, table

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: Groups in which pieces of one length are numbered, and rows a group is meant for beyond that.
SALTS, ROWS_PER_SALT = 64, 1 << 20
#: Entries of each half of a worker's cache from a stretch of text to its ids, and the longest stretch that it keeps.
CACHE, LONGEST = 650_000, 48
#: Entries of its cache from a piece of a stretch to its ids.
PIECES_KEPT = 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where it is printable in Latin-1, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Known(dict):
    """A dictionary that asks ``missing`` for the values that it doesn't hold."""

    def __init__(self, missing: Callable[[str], bytes]):
        self.missing = missing

    def __missing__(self, x: str) -> bytes:
        return self.missing(x)


class Encoder:
    """Token ids of whole texts, equal to the tokenizer's own, by stretches.

    The vocabulary's pattern starts a token at every space that stands alone
    between other characters, so stretches cut there are encoded apart, and
    each distinct one only once. Texts in which a space meets other
    whitespace are cut by the pattern itself. Added tokens, such as
    ``<|endoftext|>``, are cut out first and are one id each.
    """

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.between = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.meeting = re.compile(r"\s |\x20\s")
        self.white = [c for c in map(chr, range(1, 0x3001)) if c.isspace() and c not in " \n"]
        self.known: dict[str, bytes] = Known(self.missing)
        self.extra: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()

    def stretches(self, text: str) -> list[str]:
        if any(x in text for x in self.added):
            return [y for x in self.between.split(text) if x for y in ([x] if x in self.added else self.plain_stretches(x))]
        return self.plain_stretches(text)

    def plain_stretches(self, text: str) -> list[str]:
        # Searches for fixed strings are much faster than the expression, and mostly settle it.
        if ("  " in text or " \n" in text or "\n " in text or any(c in text for c in self.white)) and self.meeting.search(text):
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def part(self, part: str) -> bytes:
        """The ids of a stretch that the pattern doesn't cut: straight from the tokenizer's merges, in the letters that stand for bytes there."""
        letters = part.replace(" ", "\u0120") if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merge(letters)]).tobytes()

    def piece(self, piece: str) -> bytes:
        """``part`` of a piece of a stretch, which many stretches may have: looked up, and kept if it is short."""
        ids = self.pieces.get(piece) or self.known.get(piece) or self.older.get(piece)
        if ids is None:
            ids = self.part(piece)
            if len(piece) <= LONGEST:
                self.pieces[piece] = ids
        return ids

    def stretch(self, x: str) -> bytes:
        """The ids of any stretch."""
        word = x[:-1]
        if x in self.added:
            return array("I", [self.added[x]]).tobytes()
        if x[1:].isalpha() and x[0] == " ":
            return self.part(x)
        if x[-1:] in (".", ",") and word[1:].isalpha() and word[0] == " ":  # the pattern cuts before the mark
            return self.piece(word) + self.piece(x[-1])
        return b"".join(map(self.piece, self.pattern.findall(x)))

    def missing(self, x: str) -> bytes:
        """The ids of a stretch that isn't among the known ones, which are kept for later."""
        short = len(x) <= LONGEST
        ids = (self.older if short else self.extra).get(x)  # what is still used comes back from the older half
        if ids is None:
            ids = self.stretch(x)
        (self.known if short else self.extra)[x] = ids
        return ids

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.known) > CACHE:
            self.known, self.older = Known(self.missing), self.known
        if len(self.pieces) > PIECES_KEPT:
            self.pieces = {}
        self.extra = {}
        get = self.known.__getitem__
        return [b"".join(map(get, self.stretches(t))) for t in texts]


def pieces_of(count: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece of ``count`` tokens."""
    if count <= capacity:
        return [(0, count)]
    first = count % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, count, capacity))]


def tokenised(docs: DataFrame, key: Column, text: Column, vocabulary: str, capacity: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(texts), 256):
                rows = []
                for k, ids in zip(keys[i : i + 256], encode([t or "" for t in texts[i : i + 256]]), strict=True):
                    ids += end
                    rows += [(k, p, s, n, zlib.crc32(memoryview(ids)[4 * s : 4 * (s + n)])) for p, (s, n) in enumerate(pieces_of(len(ids) // 4, capacity))]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(key.cast("long").alias("key"), text.alias("text")).mapInArrow(run, PIECES)


def fitted_patterns(histogram: np.ndarray, capacity: int, rounds: int = 300) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of two and three lengths that sum to ``capacity``, with repeat counts from non-negative least squares, rounded down.

    ``histogram[n]`` counts the pieces of length n. The fit is by
    multiplicative updates, which keep the counts non-negative.
    """
    there = np.flatnonzero(histogram)
    pairs = np.array([(a, capacity - a) for a in there if 2 * a <= capacity and histogram[capacity - a]], np.int64).reshape(-1, 2)
    a, b = np.meshgrid(there, there, indexing="ij")
    c = capacity - a - b
    keep = (a <= b) & (b <= c)
    triples = np.stack([a[keep], b[keep], c[keep]], 1)
    triples = triples[histogram[triples[:, 2]] > 0]
    of = np.concatenate([np.repeat(np.arange(len(pairs)), 2), len(pairs) + np.repeat(np.arange(len(triples)), 3)])
    at = np.concatenate([pairs.ravel(), triples.ravel()])
    count = len(pairs) + len(triples)
    if not count:
        return []
    want = histogram.astype(float)
    goal = np.bincount(of, want[at], count)
    x = np.where(np.arange(count) < len(pairs), 1.0, 0.01) * max(1.0, want.sum() / count)
    for _ in range(rounds):
        made = np.bincount(at, x[of], len(want))
        x *= goal / np.maximum(np.bincount(of, made[at], count), 1e-12)
    left, out = histogram.copy(), []
    for i in np.argsort(-x, kind="stable"):
        if x[i] < 1:
            break
        p = tuple(int(n) for n in (pairs[i] if i < len(pairs) else triples[i - len(pairs)]))
        n = min([int(x[i]), *(int(left[m]) // p.count(m) for m in set(p))])
        if n:
            out.append((p, n))
            for m in p:
                left[m] -= n
    return out


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, of ``left[n]`` pieces of each length n; equal bins are handled together."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], room: int, count: int) -> None:
        if count and room:
            open_bins.setdefault(room, []).append((pattern, count))
        elif count:
            done.append((pattern, count))

    for n in range(len(left) - 1, 0, -1):
        c = int(left[n])
        while c:
            room = min((r for r in open_bins if r >= n), default=0)
            if room:
                pattern, held = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
            else:
                pattern, held, room = (), c, capacity
            each = room // n
            full = min(held, c // each)
            put(pattern + (n,) * each, room - each * n, full)
            c -= each * full
            if full < held and c:  # fewer than each are left, and one bin takes them
                put(pattern + (n,) * c, room - c * n, 1)
                put(pattern, room, held - full - 1) if pattern else None
                c = 0
            elif pattern:
                put(pattern, room, held - full)
    return done + [x for r in sorted(open_bins) for x in open_bins[r]]


def intervals(histogram: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows of length, lo, hi, base, place. Which pieces of a length come first doesn't matter."""
    used = np.zeros_like(histogram)
    plan = fitted_patterns(histogram, capacity)
    left = histogram.copy()
    for p, n in plan:
        for m in p:
            left[m] -= n
    out, base = [], 0
    for p, n in [*plan, *best_fit(left, capacity)]:
        place = 0
        for m in p:
            out.append((m, int(used[m]), int(used[m]) + n, base, place))
            used[m] += n
            place += m
        base += n
    return out


def pack(docs: DataFrame, key: Column, text: Column, *, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """``PIECES`` with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    cut = table(tokenised(docs, key, text, vocabulary, capacity), "pieces")
    counts = cut.groupBy("length").count().collect()
    histogram = np.zeros(capacity, np.int64)
    for r in counts:
        if r["length"] < capacity:
            histogram[r["length"]] = r["count"]
    plan = spark.createDataFrame(intervals(histogram, capacity), "length long, lo long, hi long, base long, place long")

    salts = max(SALTS, int(histogram.max(initial=0)) // ROWS_PER_SALT)
    short = cut.where(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = short.groupBy("length", "salt").agg(F.count("*").alias("own"))
    before = sizes.select("length", "salt", F.coalesce(F.sum("own").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = short.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    # The plan's size depends on the capacity alone.
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & F.col("rank").between(F.col("lo"), F.col("hi") - 1))
    columns = [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32")]
    placed = placed.select(*columns, ranked["length"], (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), F.col("place").alias("offset"))
    whole = cut.where(F.col("length") == capacity).select(*columns, "length", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(whole)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))
