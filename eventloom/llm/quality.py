"""Quality by perplexity under an interpolated modified Kneser-Ney model.

For each language a model of ``ORDER`` characters is trained on trusted text
(documents labelled as of good quality, all of them). Characters are code
points as they are, of any script; a run of whitespace is one space. Counts,
continuation counts, discounts and back-off weights are made by aggregations
and joins sharded by language and gram, so the model grows with the trusted
text and nothing bounds it.

The logarithm of a document's probability is a sum over the grams of each
size that end at its characters: a gram of the model adds what it changes
against the next shorter one, and, as a context, its back-off weight; other
grams add nothing. So scoring is one join of documents' grams with the model.
While the model's size allows (``BROADCAST_GRAMS``) the join is a look-up in
the task that reads the text; beyond that each document's distinct grams with
their counts are joined with the sharded model by a shuffle in which frequent
grams are split. Both give the same sums.

Two quantiles of the trusted perplexities of a language are its limits:
documents above the upper one are noise, those below the lower one are
abnormally easy to tell (the same words over and over). A model knows the texts
it was trained on better than others as good. So one in ``FOLDS`` of the
trusted texts, by a hash of the text, is left out of the training and sets the
upper limit, and the others set the lower one. Perplexities count in
steps of 1 / ``STEPS`` of their logarithm, so that quantiles are exact sums of
counts and don't depend on the order of rows.

Short texts say little: ``PRIOR`` characters at the language's trusted mean are
added to each text before its perplexity is taken.

Defined results: a null language is a language of its own; languages without
trusted text are judged by the model of all trusted text together; a null or
empty text has the perplexity of the mean, and stays; with no trusted text at
all every document stays, with a null perplexity; an empty table gives one.
Rows are judged one by one, repeated ones alike, and texts of any length are
cut into pieces in their own task. Further columns stay, whatever their names:
the three that are added take free names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import discard, fits_broadcast, free_names, hot_parts, key_name, read, sliced, spread_join, table

ORDER = 5
#: Limits on the trusted perplexities of a language.
LOWER, UPPER = 0.002, 0.995
#: Limit on the share of the most frequent gram in trusted texts.
REPEATS = 0.998
FOLDS = 4
PRIOR = 96
STEPS = 10_000
#: A model of at most so many grams (16 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_GRAMS = 4_000_000
#: The key of the model of all languages together, and of a null language.
ALL, NONE = "*", ""
#: What stands before a text, as a character.
PAD = 2
#: Texts are taken in slices of about so many characters, and in larger ones to count, where a slice gives its distinct grams.
_SLICE, _COUNT_SLICE = 1 << 17, 1 << 20
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, whitespace runs as one space, each text after ``ORDER - 1`` pads; and where each text starts, with the end of the last."""
    pad = chr(PAD) * (ORDER - 1)
    data = np.frombuffer((pad + pad.join(t or "" for t in texts) if texts else "").encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len(t or "") for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths + ORDER - 1)))
    space = (data == 32) | ((data >= 9) & (data <= 13)) | (data == 0)
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    data = np.where(space, np.uint32(32), data)[keep]
    return data, np.concatenate(([0], np.cumsum(keep)))[starts]


def _slices(texts: list[str | None], size: int = _SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` characters together."""
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + len(texts[j] or "") <= size):
            held += len(texts[j] or "") + ORDER
            j += 1
        yield i, j
        i = j


def hashes(data: np.ndarray) -> Iterator[np.ndarray]:
    """For sizes 1 to ORDER the hash of the gram that ends at each character (those before the first count as 0)."""
    wide, run, power = data.astype(np.uint64), np.zeros(len(data), np.uint64), 1
    for size in range(1, ORDER + 1):
        run[size - 1 :] += wide[: max(0, len(wide) - size + 1)] * np.uint64(power)
        power = power * int(_P) % (1 << 64)
        x = (run ^ (run >> np.uint64(31))) * _Q + np.uint64(size)
        yield x ^ (x >> np.uint64(29))


def _own(starts: np.ndarray, count: int) -> np.ndarray:
    """Which characters aren't pads."""
    own = np.ones(count, bool)
    own[(starts[:-1, None] + np.arange(ORDER - 1)).ravel()] = False
    return own


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    langs = np.array(pc.fill_null(batch.column(0), NONE).to_pylist(), object)
    for lang in sorted(set(langs)):
        yield lang, np.flatnonzero(langs == lang)


def counted(trusted: DataFrame) -> DataFrame:
    """``lang, gram, n``: the grams of ORDER characters in ``trusted`` (lang, text), of each language and of all together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2048):
            for lang, rows in _by_language(batch):
                texts = batch.column(1).take(pa.array(rows)).to_pylist()
                for i, j in _slices(texts, _COUNT_SLICE):
                    data, starts = characters(texts[i:j])
                    for whole in hashes(data):  # the last are those of the longest grams
                        pass
                    at = np.flatnonzero(_own(starts, len(data)))
                    _, first, n = np.unique(whole[at], return_index=True, return_counts=True)
                    if len(n):
                        windows = data[at[first][:, None] + np.arange(1 - ORDER, 1)]
                        grams = np.ascontiguousarray(windows).view(f"<U{ORDER}").ravel()
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(grams.tolist(), pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    made = trusted.select("lang", "text").mapInArrow(run, "lang string, gram string, n long")
    own = table(made.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    return own.unionByName(own.groupBy("gram").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("lang"), "gram", "n"))


def _discounts(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts d1, d2, d3 of each language, from the counts of counts (with stand-ins where these are 0)."""
    of = [F.sum(F.when(F.col("n") == k, 1).otherwise(0)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    part = lambda k, stand: F.when((F.col(f"n{k}") > 0) & (F.col("n1") > 0), F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")))).otherwise(F.lit(stand)).alias(f"d{k}")
    return counts.groupBy("lang").agg(*of).select("lang", part(1, 0.5), part(2, 0.75), part(3, 0.9))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """A table ``lang, gram, gain, back`` of grams of up to ORDER characters.

    ``gain`` is what a gram adds to the logarithm of its last character's
    probability against the next shorter gram, ``back`` the logarithm of its
    back-off weight as a context. The empty gram's gain is the logarithm of an
    unknown character's probability.

    Below the highest order a gram's count is the number of characters seen
    before it. Each order joins its counts with its context sums, and with the
    next lower order's probabilities.
    """
    level = {ORDER: table(counts, "order")}
    for size in range(ORDER - 1, 0, -1):
        level[size] = table(level[size + 1].groupBy("lang", F.substring("gram", 2, size).alias("gram")).agg(F.count("*").alias("n")), "order")
    lower, out = None, None
    for size in range(1, ORDER + 1):
        found = _discounts(level[size])  # a row for each language
        cut = level[size].join(F.broadcast(found) if fits_broadcast(found, 64) else found, "lang")
        cut = cut.withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))).withColumn("context", F.substring("gram", 1, size - 1))
        context = table(cut.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.log(F.sum("d") / F.sum("n")).alias("back"), F.count("*").alias("times")), "contexts")
        if lower is None:  # one context, the empty one, for each language
            own = cut.join(F.broadcast(context) if fits_broadcast(context, 64) else context, ["lang", "context"]).withColumn("below", -F.log(F.col("times") + 1))
            out = own.select("lang", F.lit("").alias("gram"), (F.col("back") + F.col("below")).alias("gain"), F.lit(0.0).alias("back")).distinct()
        else:
            parts = hot_parts(context, ["lang", "context"], context.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0])
            own = spread_join(cut, context.drop("times"), ["lang", "context"], parts, ["gram"])
            own = own.withColumn("suffix", F.substring("gram", 2, size - 1)).join(lower.select("lang", F.col("gram").alias("suffix"), F.col("logp").alias("below")), ["lang", "suffix"])
            out = out.unionByName(context.select("lang", F.col("context").alias("gram"), F.lit(0.0).alias("gain"), "back"))
        logp = F.log((F.col("n") - F.col("d")) / F.col("total") + F.exp(F.col("back") + F.col("below")))
        lower = table(own.select("lang", "gram", logp.alias("logp"), (logp - F.col("back") - F.col("below")).alias("gain")), "logp")
        out = out.unionByName(lower.select("lang", "gram", "gain", F.lit(0.0).alias("back")))
    return table(out.groupBy("lang", "gram").agg(F.sum("gain").alias("gain"), F.sum("back").alias("back")), "model")


def gram_hashes(grams: np.ndarray) -> np.ndarray:
    """The hashes of strings of 1 to ORDER characters (of one length), as ``hashes`` gives them."""
    size = len(grams[0])
    data = np.ascontiguousarray(grams.astype(f"<U{size}")).view(np.uint32)
    return list(hashes(data))[size - 1][size - 1 :: size]


def hashed(model: DataFrame) -> DataFrame:
    """``lang, hash, gain, back`` of the model; the empty gram has the hash 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = np.array(batch.column(1).to_pylist(), object)
            sizes = np.fromiter(map(len, grams), np.int64, len(grams))
            out = np.zeros(len(grams), np.uint64)
            for size in np.unique(sizes[sizes > 0]):
                out[sizes == size] = gram_hashes(grams[sizes == size])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64)), batch.column(2), batch.column(3)], ["lang", "hash", "gain", "back"])

    return model.select("lang", "gram", F.col("gain").cast("float"), F.col("back").cast("float")).mapInArrow(run, "lang string, hash long, gain float, back float")


class Lookup:
    """Grams by hash, by open addressing in arrays; gain and back-off weight are the parts of a complex number."""

    def __init__(self, keys: np.ndarray, gain: np.ndarray, back: np.ndarray):
        size = 1 << max(4, (3 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size, np.complex64)
        left, slot = np.arange(len(keys)), (keys & self.mask).astype(np.int64)
        self.probes = 0
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)  # an empty slot's key is 0
            spots, first = np.unique(slot[free], return_index=True)
            now = left[free[first]]
            self.keys[spots], self.values[spots] = keys[now], gain[now] + 1j * back[now]
            stay = np.ones(len(left), bool)
            stay[free[first]] = False
            left, slot = left[stay], (slot[stay] + 1) & int(self.mask)
            self.probes += 1

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """Adds what the known grams have to ``values``."""
        slot = (h & self.mask).view(np.int64)
        found = self.keys[slot]
        same = found == h
        at = np.flatnonzero(same)
        values[at] += self.values[slot[at]]
        at = np.flatnonzero(~same & (found != 0))  # an empty slot ends the search
        for k in range(1, self.probes):
            if not len(at):
                return
            now = (slot[at] + k) & int(self.mask)
            found = self.keys[now]
            same = found == h[at]
            values[at[same]] += self.values[now[same]]
            at = at[~same & (found != 0)]


def most_frequent(whole: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often the most frequent gram of ORDER characters stands in each text."""
    out = np.zeros(len(starts) - 1, np.int64)
    for i, (a, b) in enumerate(zip(starts[:-1] + ORDER - 1, starts[1:], strict=True)):
        if a < b:
            runs = np.sort(whole[a:b])
            edges = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1], [True])))
            out[i] = (edges[1:] - edges[:-1]).max()
    return out


def sums(texts: list[str | None], known: Lookup, base: float, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text the logarithm of its probability, its number of characters, and how often its most frequent gram stands in it."""
    total, sizes, most = np.zeros(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, j in _slices(texts):
        data, starts = characters(texts[i:j])
        values = np.zeros(len(data), np.complex64)
        for h in hashes(data):
            known.add(h, values)
        values[~_own(starts, len(data))] = 0
        n = np.diff(starts) - (ORDER - 1)
        run = np.concatenate(([0.0], np.cumsum(values.real + values.imag, dtype=np.float64)))
        last = np.where(n > 0, values.imag[np.maximum(starts[1:] - 1, 0)], 0.0) if len(data) else 0.0
        total[i:j] = np.where(n > 0, run[starts[1:]] - run[starts[:-1]] - last + n * base + start, 0.0)
        sizes[i:j], most[i:j] = n, most_frequent(h, starts)
    return total, sizes, most


def _constants(model: DataFrame) -> dict[str, tuple[float, float]]:
    """For each language the logarithm of an unknown character's probability, and the back-off weights at a text's start; a few rows for each language."""
    rows = model.where((F.length("gram") < ORDER) & (F.translate("gram", chr(PAD), "") == "")).collect()
    return {lang: (sum(r.gain for r in rows if r.lang == lang and not r.gram), sum(r.back for r in rows if r.lang == lang and r.gram)) for lang in sorted({r.lang for r in rows})}


def scored(docs: DataFrame, model: DataFrame, lang: str, text: str) -> DataFrame:
    """``row`` (all of a row of ``docs`` as a struct), ``named`` (the language whose model counts, or null), ``logp``, ``symbols`` and ``most`` (how often the most frequent gram stands in the text)."""
    constants = _constants(model)
    known = F.coalesce(F.col(lang), F.lit(NONE))
    named = F.when(known.isin(sorted(constants)), known).otherwise(F.lit(ALL) if ALL in constants else F.lit(None)).alias("named")
    rows = docs.select(F.struct("*").alias("row"), named)
    place = docs.columns.index(text)
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("named", T.StringType()), T.StructField("logp", T.DoubleType()), T.StructField("symbols", T.LongType()), T.StructField("most", T.LongType())])
    if model.rows > BROADCAST_GRAMS:
        return _joined(rows.withColumn("text", F.col("row").getField(text)), model, constants)
    got = hashed(model).where("hash != 0").toArrow().combine_chunks()
    langs = got["lang"].combine_chunks().dictionary_encode() if got.num_rows else None
    codes = {x: k for k, x in enumerate(langs.dictionary.to_pylist())} if langs else {}
    columns = [got["hash"].to_numpy().view(np.uint64), *(got[c].to_numpy() for c in ("gain", "back"))]
    places = {x: np.flatnonzero(langs.indices.to_numpy() == codes[x]) if x in codes else [] for x in constants}
    sent = docs.sparkSession.sparkContext.broadcast({x: [c[places[x]] for c in columns] for x in constants})
    del got, langs, columns, places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, Lookup] = {}
        for batch in sliced(batches):
            logp, sizes, most = np.zeros(len(batch)), np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for name, places in _by_language(batch.select([1])):
                if name in constants:
                    if name not in tables:
                        tables[name] = Lookup(*sent.value[name])
                    logp[places], sizes[places], most[places] = sums(batch.column(0).field(place).take(pa.array(places)).to_pylist(), tables[name], *constants[name])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(logp), pa.array(sizes), pa.array(most)], ["row", "named", "logp", "symbols", "most"])

    return rows.mapInArrow(run, schema)


def _joined(rows: DataFrame, model: DataFrame, constants: dict[str, tuple[float, float]]) -> DataFrame:
    """``scored`` for a model of any size: each text's distinct grams are joined with it by a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = []
            for t in batch.column(2).to_pylist():
                data, starts = characters([t])
                own = _own(starts, len(data))
                parts = [np.empty((0, 3), np.int64)]
                for h in hashes(data):
                    found, at, n = np.unique(h[own], return_inverse=True, return_counts=True)
                    inner = n.copy()  # a text's last gram is no context
                    if len(at):
                        inner[at[-1]] -= 1
                    parts.append(np.stack((found.view(np.int64), n, inner), 1))
                grams.append(np.concatenate(parts))
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(g) for g in grams]))).astype(np.int32))
            flat = np.concatenate([np.empty((0, 3), np.int64), *grams])
            held = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], names=["hash", "n", "inner"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, held)], ["id", "named", "grams"])

    marked = rows.withColumns({"mark": F.xxhash64(F.col("text").isNull(), "text"), "second": F.xxhash64(F.lit(1), "text")})
    texts = marked.where("named IS NOT NULL").groupBy("named", "mark", "second").agg(F.first("text").alias("text"))  # equal texts of a language once
    stored = table(texts.select(F.struct("mark", "second").alias("id"), "named", "text"), "texts")
    found = stored.mapInArrow(run, "id struct<mark: long, second: long>, named string, grams array<struct<hash: long, n: long, inner: long>>")
    found = found.select("id", F.col("named").alias("lang"), F.explode("grams").alias("g")).select("id", "lang", "g.*")
    values = table(hashed(model).where("hash != 0"), "values")
    counts = table(found.groupBy("lang", "hash").agg(F.count("*").alias("times")).where("times > 64"), "frequent")
    parts = hot_parts(counts, ["lang", "hash"], counts.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0])
    met = spread_join(found, values, ["lang", "hash"], parts, ["id"])
    total = met.groupBy("id", "lang").agg(F.sum(F.col("n") * F.col("gain").cast("double") + F.col("inner") * F.col("back").cast("double")).alias("sum"))

    def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, most = [], []
            for t in batch.column(2).to_pylist():
                data, starts = characters([t])
                *_, whole = hashes(data)
                sizes.append(len(data) - (ORDER - 1))
                most.append(int(most_frequent(whole, starts)[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(most, pa.int64())], ["id", "lang", "symbols", "most"])

    sized = stored.mapInArrow(counts_of, "id struct<mark: long, second: long>, lang string, symbols long, most long")
    by = F.create_map(*[F.lit(x) for lang, (base, start) in constants.items() for x in (lang, F.array(F.lit(base), F.lit(start)))]) if constants else F.lit(None).cast("map<string, array<double>>")
    value = F.when(F.col("symbols") > 0, F.coalesce("sum", F.lit(0.0)) + F.col("symbols") * by[F.col("lang")][0] + by[F.col("lang")][1]).otherwise(F.lit(0.0))
    done = table(sized.join(total, ["id", "lang"], "left").select(F.col("id.mark").alias("mark"), F.col("id.second").alias("second"), F.col("lang").alias("named"), value.alias("logp"), "symbols", "most"), "scores")
    discard(stored, values, counts)
    whole = marked.join(done, ["mark", "second", "named"], "left")
    return whole.select("row", "named", F.coalesce("logp", F.lit(0.0)).alias("logp"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("symbols", "most")])


def _trusted(docs: DataFrame, labels: DataFrame, key: str, good: str) -> DataFrame:
    ids = labels.where(F.col(good) == 1).select(key_name(F.col("doc_id")).alias("_id")).where(F.col("doc_id").isNotNull()).distinct()
    ids = F.broadcast(ids) if fits_broadcast(ids, 24) else ids
    return docs.join(ids, key_name(F.col(key)) == F.col("_id"), "left_semi")


def limits(own: DataFrame, lower: float, upper: float, repeats: float) -> list[tuple[str, float, float, float, float]]:
    """``named, mean, least, limit, repeats`` for each language of ``own`` (named, mean, held, logp, symbols, most), by exact nearest ranks over counts of steps."""
    kinds = F.array(F.struct(F.lit(0).alias("kind"), _step(_log_perplexity()).alias("step")), F.struct(F.lit(1).alias("kind"), _step(_repeated()).alias("step")))
    steps = own.where("mean IS NOT NULL").select("named", "mean", "held", F.explode(kinds).alias("s")).select("named", "mean", "held", "s.*")
    found: dict[str, list] = {}
    for r in steps.groupBy("named", "mean", "held", "kind", "step").agg(F.count("*").alias("n")).orderBy("named", "kind", "step").collect():  # at most the steps between the least and the greatest value, for each language
        found.setdefault(r.named, []).append(r)

    def at(rows: list, share: float) -> float:
        upto = np.cumsum([r.n for r in rows])
        return rows[int(np.searchsorted(upto, min(upto[-1], np.ceil(share * upto[-1]))))].step / STEPS

    out = []
    for named, rows in found.items():
        held, known = ([r for r in rows if r.held == x and not r.kind] or [r for r in rows if not r.kind] for x in (True, False))
        out.append((named, float(rows[0].mean), float(np.exp(at(known, lower))), float(np.exp(at(held, upper))), at([r for r in rows if r.kind], repeats)))
    return out


def _step(value):
    return F.round(STEPS * value).cast("long")


def _repeated():
    return F.greatest(F.lit(0), F.col("most") - 1) / (F.col("symbols") + PRIOR)


def _log_perplexity():
    return -(F.col("logp") + PRIOR * F.col("mean")) / (F.col("symbols") + PRIOR)


def judged(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", lang: str = "lang", text: str = "text", good: str = "quality", lower: float = LOWER, upper: float = UPPER, repeats: float = REPEATS) -> DataFrame:
    """``docs`` with ``_perplexity``, ``_least`` and ``_limit``, ``_repeated`` and ``_most`` (the values and the quantiles of its language) and ``_kept``, under free names, as the last six columns."""
    names = free_names(docs, "_perplexity", "_least", "_limit", "_repeated", "_most", "_kept")
    trusted = _trusted(docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")), labels, "key", good)
    trusted = trusted.withColumn("held", F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0)
    model = kneser_ney(counted(trusted.where("NOT held")))
    own = table(scored(trusted, model, "lang", "text").select("named", "row.held", "logp", "symbols", "most").where("named IS NOT NULL"), "trusted")
    own = own.unionByName(own.where(F.col("named") != ALL).withColumn("named", F.lit(ALL)))
    # The mean of texts that the model hasn't seen, or of all where there are none.
    part = lambda c: F.sum(F.when(F.col("held"), F.col(c)))
    mean = table(own.groupBy("named").agg(F.coalesce(F.try_divide(part("logp"), part("symbols")), F.try_divide(F.sum("logp"), F.sum("symbols"))).alias("mean")), "means")
    found = limits(own.join(F.broadcast(mean), "named"), lower, upper, repeats)  # a row for each language
    bounds = docs.sparkSession.createDataFrame(found, "named string, mean double, least double, limit double, repeats double")
    out = scored(docs, model, lang, text).join(F.broadcast(bounds), "named", "left")
    perplexity, repeated = F.exp(_step(_log_perplexity()) / STEPS), _step(_repeated()) / STEPS
    # Compared by steps: the limits are exponentials too.
    inside = (_step(_log_perplexity()) >= _step(F.log("least"))) & (_step(_log_perplexity()) <= _step(F.log("limit"))) & (_step(_repeated()) <= _step(F.col("repeats")))
    made = (perplexity, F.col("least"), F.col("limit"), repeated, F.col("repeats"), F.coalesce(inside, F.lit(True)))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *[x.alias(n) for x, n in zip(made, names, strict=True)])


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    out = judged(docs, read(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", F.col("_perplexity").alias("perplexity"), F.col("_least").alias("lower"), F.col("_limit").alias("threshold"), F.col("_repeated").alias("repeated"), F.col("_most").alias("most_repeated"), F.col("_kept").alias("kept"))
