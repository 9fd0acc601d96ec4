"""N-gram Jaccard join by parity sketches.

A document's set holds the hashes of its distinct word shingles. Two sets are
linked when their Jaccard similarity reaches ``num / den``; documents in one
component of links share the component's least key.

1. Every hash toggles one bit of a long parity vector, so the Hamming distance
   of two vectors is at most the symmetric difference of the sets. The vector
   is cut into blocks, each kept as the XOR of its toggles' codes. Documents
   are compared within size bands, which fix the number of blocks.
2. Similar sets of sizes a and b differ in at most
   ``(den - num) / (den + num) * (a + b)`` elements, D. Each toggles one block,
   so by the pigeonhole principle two similar documents agree on one of the
   first D + 1 blocks that aren't empty, in the order of blocks, and on
   1 + s of the first D + 1 + s. Each document emits so many, in its band and
   in the next one if a partner can be there. Equal sets are one class, and
   only one of them emits.
3. Each class drops those s of its shared keys that most classes share (a
   passage that many documents quote), in one order of all keys: any partner
   shares 1 + s keys with it, so of these both keep the one that fewest share.
   A class with at most s shared keys has no partner and is done. What is left
   are groups of at most ``HOT`` classes, and larger groups of those that are
   made of such passages altogether.
4. In each group all are compared with the first. A parity sketch of about as
   many bits as the set has elements (so that it doesn't saturate, however
   large the set is) rules out what isn't similar by its Hamming distance; the
   rest are verified on the sets, which travel once for each first document.
5. Groups whose members are in one component are done. In the others each
   member outside the group's largest component is compared with all of other
   components, by sketches again: large groups are cut into tiles of at most
   about ``TILE`` by ``TILE`` members, so no task holds a whole group, and
   tiles are done in turns of bounded size with components merged between. A
   tile first gives only a least spanning forest of the pairs that its
   sketches allow, so groups of near copies never form all their pairs; then,
   of groups where that left out pairs and of components that are still apart,
   all pairs that sketches can't rule out.
   No link between components is lost.

Defined results: a null or empty text has the empty set and links with
nothing; a text of fewer words than a shingle is one shingle; repeated rows
are copies; rows of null key take part, and a component's id is its least key
(null if it has none); further columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.llm.common import discard, fits_broadcast, hot_parts, lookup, part_of, read, sliced, spread_join, table
from eventloom.llm.components import merged

WORDS, NUM, DEN = 4, 85, 100
#: A sketch has at least so many bits.
SKETCH_BITS = 128
#: Bands grow by this factor; a band has this much more blocks (a percentage) than its largest sets must fill.
GROWTH, SPARE, LEAST_BLOCKS = 1.6, 125, 40
#: A key is hot when more classes share it.
HOT = 32
#: Members of a slot of a large group; a tile compares two slots.
TILE = 2048
#: A turn deals at most about so many rows for each class, and so many more, to tiles.
ROWS_PER_CLASS, TURN_ROWS = 16, 1_000_000
#: Sketches are compared in pieces of so many 64-bit words.
STEP_WORDS = 1 << 20

SIGNED = "doc long, mark long, n long, s1 long, s2 long, sketch array<long>, keys array<long>, room int, short int"
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int, digest) -> np.ndarray:
    """The sorted hashes of the distinct word shingles of a whole text; A to Z are lower-cased."""
    own = (text or "").encode().lower().split()
    if not own:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(digest, own), np.uint64, len(own))
    size = min(words, len(own))
    out = np.full(len(h) - size + 1, np.uint64(len(own) if len(own) < words else 0))
    for k in range(size):
        out = mix(out * _M3 + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def band_ends(most: int) -> list[int]:
    ends = [4]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, int(ends[-1] * GROWTH)))
    return ends


_ENDS = band_ends(1 << 40)


def blocks_needed(n: int, num: int, den: int) -> int:
    """One more than the most elements in which a set of n and a similar one can differ."""
    return (n + n * den // num) * (den - num) // (den + num) + 1


def spare_blocks(n: int, num: int, den: int) -> int:
    """How many blocks more than needed a set of n emits; grows with n."""
    return max(blocks_needed(n, num, den) // 8, min(4, n // 16))


def hot_room(n: int, num: int, den: int) -> int:
    """How many shared keys a set of n may drop: its partners, down to the smallest, emit so many blocks more than can differ."""
    return spare_blocks(n * num // den, num, den)


def block_keys(hashes: np.ndarray, num: int, den: int, wider: dict[int, int]) -> tuple[np.ndarray, int]:
    """The keys that a set emits, whose lowest bits tell its two bands apart; and the band in which it fills fewer blocks than it is to emit, or -1."""
    n = len(hashes)
    emit = blocks_needed(n, num, den) + spare_blocks(n, num, den)
    keys, short = [], -1
    codes = mix(hashes ^ _M2)
    for band in range(bisect_left(_ENDS, n), bisect_left(_ENDS, n * den // num) + 1):
        most = _ENDS[band]
        blocks = max(LEAST_BLOCKS, (blocks_needed(most, num, den) + spare_blocks(most, num, den)) * SPARE // 100 + 4) * wider.get(band, 1)
        # The hashes are sorted, so equal high parts, and with them equal blocks, are neighbours.
        block = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        if len(starts) < emit:
            short = band
        folded = np.bitwise_xor.reduceat(codes, starts)[:emit]
        key = mix(folded ^ mix(block[starts[:emit]] * _M3 + np.uint64(band + 1)))
        keys.append(key >> np.uint64(1) << np.uint64(1) | np.uint64(band & 1))
    return np.concatenate(keys), short


def sketch_bits(n: int, num: int, den: int) -> int:
    """A power of two, at least 18 times what similar sets can differ in, so that few differences fall on one bit."""
    return max(SKETCH_BITS, 1 << (18 * blocks_needed(n, num, den) - 1).bit_length())


def parity_sketch(hashes: np.ndarray, bits: int = 1024) -> np.ndarray:
    """The parity of each bit; halves of a longer sketch fold by XOR into the shorter one."""
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _hasher():
    import xxhash

    return xxhash.xxh3_64_intdigest


def signed(docs: DataFrame, words: int, num: int, den: int, wider: dict[int, int]) -> DataFrame:
    """``SIGNED`` for each row of ``docs`` (doc, mark, text): size, two checksums of the set, sketch, block keys and how many shared ones it may drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = _hasher()
        lists = lambda parts: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int64), *parts])))
        for batch in sliced(batches):
            n, s1, s2, sketches, keys, room, short = [], [], [], [], [], [], []
            for t in batch.column(2).to_pylist():
                h = shingles(t, words, digest)
                own, few = block_keys(h, num, den, wider) if len(h) else (np.empty(0, np.uint64), -1)
                n.append(len(h))
                s1.append(int(np.bitwise_xor.reduce(mix(h ^ _M1), initial=0)) - (1 << 63))
                s2.append(int(np.add.reduce(mix(h ^ _M3), dtype=np.uint64, initial=0)) - (1 << 63))
                sketches.append(parity_sketch(h, sketch_bits(len(h), num, den)))
                keys.append(own.view(np.int64))
                room.append(hot_room(len(h), num, den))
                short.append(few)
            longs = [pa.array(x, pa.int64()) for x in (n, s1, s2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *longs, lists(sketches), lists(keys), pa.array(room, pa.int32()), pa.array(short, pa.int32())], ["doc", "mark", "n", "s1", "s2", "sketch", "keys", "room", "short"])

    return docs.select("doc", "mark", "text").mapInArrow(run, SIGNED)


_ROLE = "struct<a: long, part: int, other: long>"


def sets_of(texts: DataFrame, words: int) -> DataFrame:
    """``a, part, other, bag`` for each role of the rows of (roles, s1, text) whose text has the checksum s1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = _hasher()
        for batch in sliced(batches):
            good, bags = [], []
            for i, (s1, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                h = shingles(t, words, digest)
                if int(np.bitwise_xor.reduce(mix(h ^ _M1), initial=0)) - (1 << 63) == s1:
                    good.append(i)
                    bags.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good, pa.int64())), pa.array(bags, pa.binary())], ["roles", "bag"])

    made = texts.select("roles", "s1", "text").mapInArrow(run, f"roles array<{_ROLE}>, bag binary")
    return made.select(F.explode("roles").alias("role"), "bag").select("role.*", "bag")


def linked(pairs: DataFrame, facts: DataFrame, docs: DataFrame, words: int, num: int, den: int, repeated: bool) -> DataFrame:
    """The pairs (a, b), from a stored table, whose sets reach the similarity.

    Each set is made from its text in the task that reads it, and travels once
    for every a that it is compared with; there the set of a comes first, and
    the others stream past it. An a of very many pairs is split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, np.uint64)
        for batch in batches:
            good = []
            for other, bag in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                y = np.frombuffer(bag, np.uint64)
                if other is None:
                    own = y
                    good.append(False)
                    continue
                both = np.sort(np.concatenate((own, y)), kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                good.append(den * same >= num * (len(own) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    counts = pairs.groupBy("a").agg(F.count("*").alias("times"))
    parts = F.broadcast(hot_parts(counts, ["a"], pairs.rows))
    dealt = pairs.join(parts, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)).cast("long")).cast("int").alias("part"))
    role = lambda other: F.struct("a", "part", other.cast("long").alias("other"))
    roles = dealt.select(F.col("b").alias("cls"), role(F.col("b")).alias("role")).unionByName(dealt.select("a", "part").distinct().select(F.col("a").alias("cls"), role(F.lit(None)).alias("role")))
    roles = roles.groupBy("cls").agg(F.collect_list("role").alias("roles"))  # as many as the pairs of one class in this round
    wanted = table(facts.join(roles, "cls").select("cls", F.col("doc").alias("d"), F.col("mark").alias("m"), "s1", "roles"), "wanted", F.size("roles"))
    wanted_rows = F.broadcast(wanted) if fits_broadcast(wanted, 150) else wanted
    texts = docs.join(wanted_rows, F.col("doc").eqNullSafe(F.col("d")) & F.col("mark").eqNullSafe(F.col("m")))
    if repeated:  # of repeated rows one for each task that reads them, and of these one
        texts = texts.groupBy("cls", "s1").agg(F.first("roles").alias("roles"), F.first("text").alias("text"))
    met = sets_of(texts, words).repartition("a", "part").sortWithinPartitions("a", "part", F.col("other").asc_nulls_first())
    return met.mapInArrow(run, "a long, b long")


def half(sketch: Column) -> Column:
    """The sketch of half as many bits."""
    middle = F.floor(F.size(sketch) / 2).cast("int")
    return F.zip_with(F.slice(sketch, F.lit(1), middle), F.slice(sketch, middle + 1, middle), lambda x, y: x.bitwiseXOR(y))


def plausible(num: int, den: int) -> Column:
    """Whether sizes and sketches of (na, ka) and (nb, kb) allow a link: the sketches' distance is at most the symmetric difference."""
    fold = lambda k, other: F.when(F.size(k) > F.size(other), half(k)).otherwise(k)
    a, b = F.col("ka"), F.col("kb")
    away = F.aggregate(F.zip_with(fold(a, b), fold(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    near = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
    return F.when(near, away * (den + num) <= (F.col("na") + F.col("nb")) * (den - num)).otherwise(F.lit(False))


def sketched(pairs: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b), from a stored table, that ``plausible`` lets pass."""
    side = lambda x: facts.select(F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"))
    if fits_broadcast(facts, 400):
        return pairs.join(F.broadcast(side("a")), "a").join(F.broadcast(side("b")), "b").where(plausible(num, den)).select("a", "b")
    hot = lambda x: hot_parts(pairs.groupBy(x).agg(F.count("*").alias("times")), [x], total)
    total = pairs.rows
    both = spread_join(spread_join(pairs, side("b"), ["b"], hot("b"), ["a"]), side("a"), ["a"], hot("a"), ["b"])
    return both.where(plausible(num, den)).select("a", "b")


def folded(sketches: np.ndarray, size: int) -> np.ndarray:
    while sketches.shape[1] > size:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def tile_pairs(slot: np.ndarray, root: np.ndarray, n: np.ndarray, flat: np.ndarray, starts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places (i, j) of a tile's members that ``plausible`` lets pass, and the sketches' distances: of two slots, or, of one, i < j; only of different roots."""
    width = np.diff(starts)
    one = slot[0] == slot[-1]
    left = np.arange(len(slot)) if one else np.flatnonzero(slot == slot[0])
    right = left if one else np.flatnonzero(slot != slot[0])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for size in np.unique(width):  # the shorter sketch of a pair, to which the other one is folded
        packs = {}
        for own in np.unique(width[width >= size]):
            rows = np.flatnonzero(width == own)
            packs[own] = rows, folded(flat[starts[rows, None] + np.arange(own)], size)
        base, words = packs[size]
        for own, (rows, other) in packs.items():
            for x, xs, y, ys in ((base, words, rows, other), (rows, other, base, words))[: 1 if own == size else 2]:
                keep, there = np.isin(x, left), np.isin(y, right)
                x, xs, y, ys = x[keep], xs[keep], y[there], ys[there]
                step = max(1, STEP_WORDS // max(1, len(y) * int(size)))
                for k in range(0, len(x), step):
                    i = x[k : k + step, None]
                    least, most = np.minimum(n[i], n[y]), np.maximum(n[i], n[y])
                    good = (root[i] != root[y]) & (least * den >= most * num)
                    if one:
                        good &= i < y
                    p, q = np.nonzero(good)
                    for z in range(0, len(p), max(1, STEP_WORDS // int(size))):
                        u, v = p[z : z + STEP_WORDS // int(size) + 1], q[z : z + STEP_WORDS // int(size) + 1]
                        away = np.bitwise_count((xs[k + u] ^ ys[v]).view(np.uint64)).sum(1, dtype=np.int64)
                        near = away * (den + num) <= (n[x[k + u]] + n[y[v]]) * (den - num)
                        found.append((x[k + u[near]], y[v[near]], away[near]))
    if not found:
        return left[:0], left[:0], left[:0]
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def least_forest(p: np.ndarray, q: np.ndarray, away: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that join roots which nearer pairs don't join."""
    up: dict[int, int] = {}

    def top(r: int) -> int:
        while (above := up.get(r, r)) != r:
            up[r] = r = up.get(above, above)
        return r

    keep = []
    order = np.lexsort((q, p, away))
    for k, a, b in zip(order.tolist(), root[p[order]].tolist(), root[q[order]].tolist(), strict=True):
        if (a := top(a)) != (b := top(b)):
            up[b] = a
            keep.append(k)
    return p[keep], q[keep]


def tiled(placed: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """The plausible pairs (a, b) of different roots in the tiles of ``placed`` (g, x, root, n, sketch, main, held, others), or of each tile a least spanning forest of them, and then a row of g alone where that leaves out pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        last = None

        def pairs(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            g, lo, hi, slot, x, root, n = (table.column(c).to_numpy() for c in range(7))
            lists = table.column(7).chunk(0) if table.num_rows else pa.array([], pa.list_(pa.int64()))
            starts = np.asarray(lists.offsets, np.int64)
            flat = np.asarray(lists.values)
            edges = np.flatnonzero((g[1:] != g[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            out, cut = [], []
            for i, j in zip(np.concatenate(([0], edges)), np.concatenate((edges, [len(g)])), strict=True):
                if j - i > 1 and (lo[i] == hi[i] or slot[i] != slot[j - 1]):
                    p, q, away = tile_pairs(slot[i:j], root[i:j], n[i:j], flat, starts[i : j + 1], num, den)
                    if forest and len(p) > 1:
                        every = len(p)
                        p, q = least_forest(p, q, away, root[i:j])
                        cut += [int(g[i])] * (len(p) < every)
                    out.append((x[i:j][p], x[i:j][q]))
            a = np.concatenate([np.empty(0, np.int64), *(o[0] for o in out)])
            b = np.concatenate([np.empty(0, np.int64), *(o[1] for o in out)])
            none = pa.nulls(len(cut), pa.int64())
            columns = [pa.concat_arrays([pa.array(f(a, b)), none]) for f in (np.minimum, np.maximum)]
            return pa.RecordBatch.from_arrays([*columns, pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(cut, pa.int64())])], ["a", "b", "g"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in range(3))
            g, lo, hi = (batch.column(c).to_numpy() for c in range(3))
            same = (g == key[0]) & (lo == key[1]) & (hi == key[2])
            start = int(np.argmax(same))  # where the batch's last tile, which may go on, begins
            if start or key != last:
                done = [*waiting, batch.slice(0, start)]
                waiting = []
                if sum(b.num_rows for b in done):
                    yield pairs(pa.Table.from_batches(done))
            waiting.append(batch.slice(start))
            last = key
        if waiting:
            yield pairs(pa.Table.from_batches(waiting))

    slots = lambda members: F.ceil(members / TILE).cast("int")
    odd, whole = slots(F.col("others")), slots(F.col("others")) + slots(F.col("held") - F.col("others"))
    spot = F.xxhash64("x", F.lit(3))
    slot = F.when(F.col("main"), odd + F.pmod(spot, whole - odd)).otherwise(F.pmod(spot, odd)).cast("int")
    # A quarter of the bits, where sets with nothing in common still differ in twice as many as similar ones may, will do for small groups.
    sketch = F.when((F.col("held") <= HOT) & (F.size("sketch") >= 8), half(half(F.col("sketch")))).otherwise(F.col("sketch")).alias("sketch")
    dealt = placed.select("g", "x", "root", "n", sketch, slot.alias("slot"), F.explode(F.sequence(F.lit(0), F.when(F.col("main"), odd).otherwise(whole) - 1)).alias("t"))
    dealt = dealt.select("g", F.least("slot", "t").alias("lo"), F.greatest("slot", "t").alias("hi"), "slot", "x", "root", "n", "sketch")
    return dealt.repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi", "slot").mapInArrow(run, "a long, b long, g long")


def shared_blocks(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """A table ``g, c, x, m``: the groups g of m classes x that share keys, each with its first class c.

    Keys of the same members are one group. ``repeats`` holds the rows that
    aren't the first of their class.
    """
    one = rows.where("n > 0")
    one = one.join(F.broadcast(repeats) if fits_broadcast(repeats, 16) else repeats, "rid", "left_anti")
    emitted = one.select("rid", F.explode("keys").alias("key"))
    shared = table(emitted.groupBy("key").agg(F.count("*").alias("times")).where("times > 1"), "shared")
    total = shared.agg(F.sum("times")).first()[0] or 0
    top = hot_parts(shared.where(F.col("times") > HOT), ["key"], total)
    emitted = emitted.join(F.broadcast(top.join(shared, "key").select("key", F.col("times").alias("most"))), "key", "left")
    # Keys of very many rows are known to be hot and shared, and aren't shuffled.
    met = emitted.where("most IS NULL").select("rid", "key").join(shared, "key").unionByName(emitted.where("most IS NOT NULL").select("rid", "key", F.col("most").alias("times")))
    last = Window.partitionBy("rid", F.col("key").bitwiseAND(F.lit(1))).orderBy(F.col("times").desc(), "key")
    met = met.join(rows.select("rid", "room"), "rid").withColumn("place", F.row_number().over(last)).where("place > room")
    hit = table(met.select(F.col("rid").alias("x"), "key", (F.col("times") > HOT).alias("hot")), "hit")

    own = Window.partitionBy("key")
    sign = lambda seed: F.bit_xor(F.xxhash64("x", F.lit(seed)))
    cold = hit.where("NOT hot").select("x", F.count("*").over(own).alias("m"), F.min("x").over(own).alias("c"), sign(1).over(own).alias("g1"), sign(2).over(own).alias("g2"))
    cold = cold.where("m > 1").select(F.xxhash64("g1", "g2").alias("g"), "c", "x", "m").distinct()

    held = table(hit.where("hot").select("x", "key"), "held")
    named = table(held.groupBy("key").agg(F.min("x").alias("c"), F.count("*").alias("m"), sign(1).alias("g1"), sign(2).alias("g2")).where("m > 1").select("key", "c", "m", F.xxhash64("g1", "g2").alias("g")), "named")
    one = named.groupBy("g").agg(F.min("key").alias("key"), F.min("c").alias("c"), F.min("m").alias("m"))  # of keys with the same members, one
    warm = lookup(held, table(one, "one"), "key", ["x"], width=32).select("g", "c", "x", "m")
    out = table(cold.unionByName(warm), "groups")
    discard(shared, hit, held, named)
    return out


def of_class(members: DataFrame, right: DataFrame, *, width: int = 16, how: str = "inner") -> DataFrame:
    """The members (g, x) of groups joined to ``right``, which has a row for a class x: by a broadcast while that is small, else by a shuffle.

    A class is in no more groups than its document has keys, so none is hot,
    however large a group is, and each row passes through one join.
    """
    return members.join(F.broadcast(right) if fits_broadcast(right, width) else right, "x", how)


def joined(docs: DataFrame, key: Column, text: Column, *, words: int = WORDS, num: int = NUM, den: int = DEN, mark: Column | None = None) -> DataFrame:
    """``doc, n, s1, component`` for each row of ``docs``; where a ``mark`` (long) tells apart rows of one key, also ``mark`` and the component's own number ``root``, which is null for empty sets."""
    extra = [] if mark is None else ["mark", "root"]
    docs = docs.select(key.cast("long").alias("doc"), (F.xxhash64(text) if mark is None else mark).alias("mark"), text.alias("text"))
    wider: dict[int, int] = {}
    while True:  # a set whose hashes crowd into too few blocks needs more of them in its band; that is very rare, and then all are cut anew
        rows = table(signed(docs, words, num, den, wider).withColumn("rid", F.monotonically_increasing_id()), "signed")
        crowded = [r.short for r in rows.where("short >= 0").select("short").distinct().collect()]
        if not crowded:
            break
        discard(rows)
        wider |= {band: 4 * wider.get(band, 1) for band in crowded}
    base = table(rows.select("rid", "doc", "mark", "n", "s1", "s2"), "base")
    full = base.where("n > 0")
    counts = full.groupBy("s1", "s2").agg(F.min("rid").alias("cls"), F.count("*").alias("times"))
    # A class of one row needs no join; the rows of a large class are split.
    several = table(counts.where("times > 1"), "several")
    parts = hot_parts(several, ["s1", "s2"], several.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0])
    named = table(spread_join(full, several.select("s1", "s2", "cls"), ["s1", "s2"], parts, ["rid"], "left").withColumn("cls", F.coalesce("cls", "rid")), "classes")
    repeats = table(named.where("rid != cls").select("rid"), "repeats")
    classes = named.rows - repeats.rows
    repeated = bool(base.groupBy("doc", "mark").count().where("count > 1").limit(1).count())

    groups = shared_blocks(rows, repeats)
    met = table(groups.select(F.col("x").alias("cls")).distinct(), "met")
    facts = table(rows.join(F.broadcast(met) if fits_broadcast(met, 16) else met, F.col("rid") == F.col("cls"), "left_semi").select(F.col("rid").alias("cls"), "doc", "mark", "n", "s1", "sketch"), "facts")
    discard(rows, met)

    root = tried = None

    def rooted(found: DataFrame, x: str, name: str) -> DataFrame:
        """``found``, a stored table, with the component of ``x`` so far."""
        if root is None:
            return found.withColumn(name, F.col(x))
        named = part_of(root, F.col("node").alias(x), F.col("root").alias(name))
        return lookup(found, named, x, [c for c in found.columns if c != x], how="left").withColumn(name, F.coalesce(name, x))

    def apart(found: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are in different components."""
        half = rooted(found, "a", "ra")
        half = half if root is None or fits_broadcast(root, 16) else table(half, "half")
        return rooted(half, "b", "rb").where("ra != rb").select("a", "b")

    def verified(found: DataFrame) -> None:
        """Merges the components that the pairs (a, b), a stored table, link."""
        nonlocal root, tried
        if found.rows:
            tried = found if tried is None else tried.unionByName(found)
            links = table(linked(found, facts, docs, words, num, den, repeated), "links")
            if links.rows:
                root = merged(root, links)

    def settled(found: DataFrame) -> None:
        """Verifies the pairs, a stored table, as far as their ends are in different components: of each b one a first, twice, and then the rest."""
        for part in (F.min("a"), F.max("a"), None):
            if not found.rows:
                return
            now = found if part is None else table(found.groupBy("b").agg(part.alias("a")).select("a", "b"), "first")
            verified(now)
            if part is not None:
                found = table(apart(table(found.join(now, ["a", "b"], "left_anti"), "others")), "apart")

    firsts = table(groups.where("c != x").select(F.col("c").alias("a"), F.col("x").alias("b")).distinct(), "firsts")
    settled(table(sketched(firsts, facts, num, den), "pairs"))
    discard(firsts)

    # The first of each group has met all others. What is left are groups of several components among these; groups of two are done.
    rest = table(groups.where("c != x AND m > 2").select("g", "x"), "rest")
    turn, turns, forest = 0, 1, True
    while turn < turns:
        placed = rest.withColumn("root", F.col("x")) if root is None else of_class(rest, part_of(root, F.col("node").alias("x"), "root"), how="left").withColumn("root", F.coalesce("root", "x"))
        placed = table(placed.select("g", "x", "root"), "placed")
        if not placed.rows:
            break
        parts = placed.groupBy("g", "root").agg(F.count("*").alias("k"))
        mixed = parts.groupBy("g").agg(F.count("*").alias("parts"), F.max(F.struct("k", "root")).alias("most"), F.sum("k").alias("held")).where("parts > 1")
        mixed = table(mixed.select("g", F.col("most.root").alias("largest"), "held", (F.col("held") - F.col("most.k")).alias("others")), "mixed")
        rest = table(lookup(rest, part_of(mixed, "g"), "g", ["x"]), "rest")  # a group in one component stays so
        load = mixed.agg(F.sum(F.col("held") + (F.col("held") * F.col("others") / TILE).cast("long"))).first()[0] or 0
        turns = max(turns, turn + 1 + int(load) // (TURN_ROWS + ROWS_PER_CLASS * classes))
        chosen = F.pmod(F.xxhash64("g", F.lit(turn)), F.lit(turns - turn)) == 0  # of the last turn all
        now = table(lookup(placed, mixed if turn + 1 == turns else mixed.where(chosen), "g", ["x"], width=40).withColumn("main", F.col("root") == F.col("largest")), "now")
        now = of_class(now, part_of(facts, F.col("cls").alias("x"), "n", "sketch"), width=400)
        both = table(tiled(now, num, den, forest).distinct(), "tiles")
        near = both.where("a IS NOT NULL").select("a", "b")
        verified(table(near if tried is None else near.join(tried, ["a", "b"], "left_anti"), "near"))
        cut = table(both.where("a IS NULL").select("g", F.lit(True).alias("cut")), "cut")  # of these groups the forests left out pairs; the others of this turn are done
        rest = table(lookup(rest, cut, "g", ["x"], how="left").where(~chosen | F.col("cut")).select("g", "x") if cut.rows else rest.where(~chosen), "rest")
        forest = not (forest and cut.rows)
        turn += forest
    whole = table(rooted(named, "cls", "root"), "whole")
    least = table(whole.groupBy("root").agg(F.min("doc").alias("component"), F.count("*").alias("times")), "least")
    more = table(least.where("times > 1").select("root", F.col("component").alias("least"), F.lit(True).alias("more")), "more")
    out = lookup(whole, more, "root", ["rid"], how="left").withColumn("component", F.when(F.col("more"), F.col("least")).otherwise(F.col("doc")))
    out = out.select("doc", "n", "s1", "component", *extra)
    empty = base.where("n = 0").withColumn("root", F.lit(None).cast("long"))
    return out.unionByName(empty.select("doc", "n", "s1", F.col("doc").alias("component"), *extra))


def query(spark, sf_dir: str) -> DataFrame:
    found = joined(read(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


#: Every pair that shares a shingle, counted; for small tables only.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END)) AS g FROM w
), n AS (
  SELECT d.doc_id, count(s.g) AS n FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)
), e AS (
  SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (
  SELECT doc_id, doc_id AS root FROM n UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b
)
SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY ALL
"""
