"""Awkward rows for every operator: nulls, empty and very long texts, ties, repeats, empty tables, clashing names, hot keys."""

import random
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from eventloom.llm import common, components, exact_dedup, jaccard_join, language_id, line_dedup, media, mixing, packing, pii, quality, substring_dedup
from tests.llm.test_operators import plain_components, removed_lines

DIR = "/root/testdata/sf0.001"
#: Names that operators use inside, as columns of the caller.
CLASHES = ("_k", "_t", "_at", "_all", "_own", "_gone", "_lines", "_removed", "_id", "_text", "_part", "parts", "row", "key", "sha", "mark", "k", "h", "g", "at", "every", "own", "named", "logp", "symbols", "_logp", "_symbols", "_limit", "_kept", "_perplexity", "_most", "_spans", "_sure", "_proposed", "_gen_0", "_base_email", "root", "cls", "rid", "a", "b", "start", "stop", "cover", "rank", "pattern", "bucket", "size", "n", "times", "total", "piece", "length", "LANG2")


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    body = say(120)
    out = [(i, say(rng.randint(1, 90)) + f"\n{body if i % 3 == 0 else say(20)}\n" + say(5), rng.choice(["en", "fr", None]), rng.choice(["x", "y", None]), 7) for i in range(30)]
    out += [(100, None, None, None, None), (101, "", "en", "x", 0), (102, " \n\t ", "fr", "y", 4), (None, body, "en", "x", 9), (None, None, "en", None, 1), (None, body, "en", "x", 9)]
    return [*out, out[5], out[5], out[7], (103, "very long " * 10_000, "en", "x", 1), (104, "Mail a@b.cc now. " * 5_000, "en", "y", 1)]


@pytest.fixture(scope="module")
def frames(spark, rows):
    plain = frame_of(spark, rows)
    return plain, plain.select("*", *[F.lit(f"mine {i}").alias(c) for i, c in enumerate(CLASHES)])


def labels_of(spark):
    return spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(60)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": lambda spark, d: line_dedup.dedup_lines(d),
    "op2": lambda spark, d: pii.find(d, "text", MODEL),
    "op3": lambda spark, d: mixing.mix(d, F.col("doc_id"), common.words_in(F.col("text")), F.array("source")),
    "op4": lambda spark, d: quality.judged(d, labels_of(spark)),
    "op5": lambda spark, d: exact_dedup.exact_groups(d, F.col("doc_id"), F.col("text")),
    "op6": lambda spark, d: jaccard_join.joined(d, F.col("doc_id"), F.col("text")),
    "op7": lambda spark, d: packing.pack(d, F.col("doc_id"), F.col("text")).select("doc_id", "piece", "start", "length", "ids_crc32"),
    "op8": lambda spark, d: substring_dedup.remove_repeats(d, sentences=1, gap=substring_dedup.GAP, most=substring_dedup.MOST),
    "op10": lambda spark, d: language_id.identify(d, language_id.learn(d, "doc_id", "text", "lang"), F.col("doc_id"), F.col("text"), F.lit(False)),
}
#: Thresholds that take every proposal, so that all are seen.
MODEL = pii.Model([0.5], 0.0, 1.0, 0.0, [0.1] * len(pii.ALL_KINDS))


def counted(df, leave=()):
    return Counter(tuple(str(v) for v in r) for r in df.select(*[c for c in df.columns if c not in leave]).collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_change_nothing(spark, frames, rows, name):
    plain, wide = (OPERATORS[name](spark, d) for d in frames)
    want = counted(plain)
    if name != "op7":  # every row has its row
        keys = [c for c in plain.columns if c in ("doc_id", "key", "doc")][:1]
        assert Counter(r[plain.columns.index(keys[0])] for r in want.elements()) == Counter(str(r[0]) for r in rows)
    if name in ("op1", "op2", "op4"):  # the caller's columns stay, and those that are added come last
        added = len(plain.columns) - 5
        assert wide.columns[: 5 + len(CLASHES)] == frames[1].columns and len(set(map(str.lower, wide.columns))) == len(wide.columns)
        mine = wide.select(*CLASHES).distinct().collect()
        assert [tuple(r) for r in mine] == [tuple(f"mine {i}" for i in range(len(CLASHES)))]
        wide = wide.select(*wide.columns[:5], *wide.columns[-added:])
    assert counted(wide) == want


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, frames, name):
    assert OPERATORS[name](spark, frames[0].where("false")).count() == 0


def test_media_of_awkward_rows(spark, monkeypatch):
    short = [(1, None), (2, ""), (2, ""), (None, "é" * 70), (3, "x" * 50_000)]
    plain = spark.createDataFrame(short, "doc_id long, text string")
    found = []
    for d in (plain, plain.select("*", *[F.lit("mine").alias(c) for c in CLASHES]), plain.where("false")):
        monkeypatch.setattr(media, "read", lambda *_, d=d: d)
        found.append(counted(media.query(spark, "")))
    assert found[0] == found[1] and sum(found[0].values()) == len(short) and not found[2]


@pytest.mark.parametrize("stage", range(len(P.STAGES)))
def test_pipeline_stages_on_awkward_tables(spark, frames, rows, stage):
    name, function = P.STAGES[stage]
    for d in (frames[1], frames[0].where("false")):
        out = function(spark, d, DIR)
        n = out.count()
        if stage < len(P.STAGES) - 1:
            assert out.columns == d.columns
        assert (n > 0) == (d is frames[1])
        if d is frames[1] and stage < len(P.STAGES) - 1:
            assert [tuple(r) for r in out.select(*CLASHES).distinct().collect()] == [tuple(f"mine {i}" for i in range(len(CLASHES)))]


# -- hot keys: half of all rows share one


@pytest.fixture
def narrow(monkeypatch):
    """Keys count as hot from a few rows on, and tables are never broadcast."""
    monkeypatch.setattr(common, "WHOLE_KEY", 3)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)


def hot_rows():
    rng = random.Random(9)
    say = lambda n: " ".join(f"v{rng.randrange(5000)}" for _ in range(n))
    passage = "\n".join(say(12) for _ in range(4))
    return [(i, f"{say(30)}\n{passage}\n{say(30)}" if i % 2 else say(60)) for i in range(160)] + [(200 + i, "the same text for many rows") for i in range(60)]


def test_hot_lines(spark, narrow):
    rows = hot_rows()
    gone = removed_lines(rows)
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r._removed for r in out} == {k: len(gone[k]) for k, _ in rows}


def test_hot_recipes(spark, narrow):
    rows = hot_rows()
    out = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id"), F.col("text")).collect()
    assert Counter((r.keep_id, r.group_size) for r in out if r.group_size > 1) == {(200, 60): 60} and len(out) == len(rows) and sum(r.kept for r in out) == 161


def test_hot_spans(spark, narrow):
    rows = hot_rows()
    make = lambda: {r.key: (r.text, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), sentences=1, gap=20, most=30).collect()}
    narrow_ = make()
    common.BROADCAST_BYTES, common.WHOLE_KEY = 16_000_000, 64
    assert narrow_ == make() and sum(n > 0 for _, n in narrow_.values()) >= 70


@pytest.mark.parametrize("tile", [3, 2048])
def test_hot_blocks(spark, narrow, monkeypatch, tile):
    """Clusters around one text, some linked in chains only, beside documents that share a passage; all keys are hot, tiles are small and turns are many."""
    monkeypatch.setattr(jaccard_join, "HOT", 2)
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "ROWS_PER_CLASS", 0)
    monkeypatch.setattr(jaccard_join, "TURN_ROWS", 3000)
    rng = random.Random(tile)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(60):
        own = [*base]
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = f"c{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    walk = [f"d{i}" for i in range(80)]
    for i in range(25):
        walk[rng.randrange(80)] = f"e{rng.randrange(10**6)}"
        rows.append((100 + i, " ".join(walk)))
    rows += [(200 + i, " ".join(base[:40] + [f"f{rng.randrange(10**6)}" for _ in range(60)])) for i in range(20)]
    rows += [(300, rows[3][1]), (None, rows[61][1]), (3, rows[3][1])]
    got = jaccard_join.joined(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id"), F.col("text"), words=2, num=80, den=100).select("doc", "n", "component").collect()
    assert Counter(map(tuple, got)) == Counter(plain_components(rows, 2, 80, 100))


@pytest.mark.parametrize("num", [80, 85])
def test_sketches_tell_large_sets_apart(num):
    rng = np.random.default_rng(num)
    for n in (300, 2400, 3300, 20_000):
        a, b = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(2))
        bits = jaccard_join.sketch_bits(n, num, 100)
        away = int(np.bitwise_count((jaccard_join.parity_sketch(a, bits) ^ jaccard_join.parity_sketch(b, bits)).view(np.uint64)).sum())
        assert away * (100 + num) > 3 * (len(a) + len(b)) * (100 - num)
        half = jaccard_join.parity_sketch(a, bits // 2)
        assert (jaccard_join.folded(jaccard_join.parity_sketch(a, bits)[None], len(half))[0] == half).all()


def test_spare_keys_meet_without_hot_ones():
    """Of similar sets either may drop as many keys as it has room for, and they still share one."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(20, 900))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64) * np.uint64(2))
        for num in (80, 85):
            k = int(len(a) * (100 - num) / (100 + num) * rng.random())
            b = np.unique(np.concatenate((rng.permutation(a)[k:], rng.integers(0, 1 << 62, k).astype(np.uint64) * np.uint64(2) + np.uint64(1))))
            same = len(np.intersect1d(a, b))
            if 100 * same < num * (len(a) + len(b) - same):
                continue
            (ka, sa), (kb, sb) = (jaccard_join.block_keys(x, num, 100, {}) for x in (a, b))
            if sa < 0 and sb < 0:
                shared = np.intersect1d(ka, kb)
                best = max(int((shared & np.uint64(1) == band).sum()) for band in (0, 1))
                assert best > max(jaccard_join.hot_room(len(x), num, 100) for x in (a, b)) - 0


def test_tiles_against_all_pairs():
    rng = np.random.default_rng(1)
    for trial in range(60):
        m = int(rng.integers(2, 30))
        base = np.unique(rng.integers(0, 1 << 62, int(rng.integers(1, 900))).astype(np.uint64))
        sets = [np.unique(np.concatenate((rng.permutation(base)[int(len(base) * rng.random() * 0.3) :], rng.integers(0, 1 << 62, int(len(base) * rng.random() * 0.5) + 1).astype(np.uint64)))) for _ in range(m)]
        n, root = np.array([len(x) for x in sets]), rng.integers(0, 6, m)
        sketches = [jaccard_join.parity_sketch(x, jaccard_join.sketch_bits(len(x), 80, 100)) for x in sets]
        starts = np.concatenate(([0], np.cumsum([len(x) for x in sketches])))
        slot = np.sort(rng.integers(0, 2, m)) if trial % 2 else np.zeros(m, int)
        i, j, away = jaccard_join.tile_pairs(slot, root, n, np.concatenate(sketches), starts, 80, 100)
        want = {}
        for a in range(m):
            for b in range(a + 1, m):
                size = min(len(sketches[a]), len(sketches[b]))
                x, y = (jaccard_join.folded(sketches[k][None], size)[0] for k in (a, b))
                d = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
                if root[a] != root[b] and (slot[0] == slot[-1] or slot[a] != slot[b]) and min(n[a], n[b]) * 100 >= max(n[a], n[b]) * 80 and d * 180 <= (n[a] + n[b]) * 20:
                    want[(a, b)] = d
        assert {(min(p), max(p)): d for *p, d in zip(i.tolist(), j.tolist(), away.tolist(), strict=True)} == want
        p, q = jaccard_join.least_forest(i, j, away, root)
        joined = lambda pairs: {frozenset(c) for c in _classes(pairs, set(root.tolist()))}
        assert joined([(root[a], root[b]) for a, b in zip(p, q, strict=True)]) == joined([(root[a], root[b]) for a, b in want]) and len(p) < 6


def _classes(pairs, nodes):
    up = {x: {x} for x in nodes}
    for a, b in pairs:
        if up[a] is not up[b]:
            up[a] |= up[b]
            for x in up[b]:
                up[x] = up[a]
    return {id(s): s for s in up.values()}.values()


# -- language identification against a plain version


def test_languages_against_plain_compression(spark, frames, rows):
    import xxhash
    import zstandard

    spot = lambda k: xxhash.xxh64(b"dictionary", seed=xxhash.xxh64(struct.pack("<q", k), seed=42).intdigest()).intdigest()
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    classes = defaultdict(dict)
    for k, t, lang, *_ in rows:
        if k is not None and lang is not None and t:
            h = signed(spot(k))
            best = classes[lang].setdefault(h % language_id.DOCS_PER_LANGUAGE, (True, 1 << 63, 0, ""))
            classes[lang][h % language_id.DOCS_PER_LANGUAGE] = min(best, (len(t) > language_id.PREFERRED_CHARS, h, k, t))
    plain = {lang: "\n".join(t for _, _, _, t in sorted(own.values(), key=lambda r: r[1:])).lower().encode() for lang, own in sorted(classes.items())}
    learned = language_id.learn(frames[0], "doc_id", "text", "lang")
    assert learned == plain
    small = {k: v[:20_000] for k, v in plain.items()}
    out = {(r.doc_id, i): r for i, r in enumerate(language_id.identify(frames[0].coalesce(1), small, F.col("doc_id"), F.col("text"), F.lit(False)).collect())}
    for (k, _), r in out.items():
        text = next(t for key, t, *_ in rows if key == k and (key is not None or (t is None) == (r.lang_pred == "und")))
        if text is None or not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
            continue
        data, sizes = text.lower().encode(), {}
        for lang, content in small.items():
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=language_id.LEVEL)
            coder = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(coder.compress(data[i : i + language_id.BLOCK_BYTES])) for i in range(0, len(data), language_id.BLOCK_BYTES))
        best = min(sizes, key=lambda x: (sizes[x], x))
        second = min(v for x, v in sizes.items() if x != best)
        assert r.lang_pred == best and r.margin == pytest.approx((second - sizes[best]) / second) and r.accepted == (r.margin >= language_id.LEAST_MARGIN)
        assert r.score == pytest.approx(1 / sum(2.0 ** (-0.5 * min(v - sizes[best], 2000)) for v in sizes.values()))


def test_few_shared_keys_make_no_groups(spark):
    """Sets of 300 words of which any two share 30: some keys are shared by few of them, but by fewer than a partner would share, so no group is left."""
    rng = random.Random(5)
    common_words = [f"s{i}" for i in range(30)]
    rows = [(i, " ".join(common_words + [f"w{rng.randrange(10**9)}" for _ in range(270)])) for i in range(20)]
    rows += [(50, rows[0][1] + " more"), (51, rows[1][1] + " more")]
    docs = spark.createDataFrame(rows, "doc long, text string").withColumn("mark", F.xxhash64("text"))
    signed = common.table(jaccard_join.signed(docs, 1, 85, 100, {}).withColumn("rid", F.monotonically_increasing_id()), "signed")
    assert signed.select(F.explode("keys").alias("key")).groupBy("key").count().where("count > 2").count() > 0
    groups = jaccard_join.shared_blocks(signed, common.table(signed.where("rid < 0").select("rid"), "repeats"))
    assert {r.doc for r in groups.join(signed, F.col("x") == F.col("rid")).select("doc").distinct().collect()} == {0, 1, 50, 51}


def test_members_of_groups_pass_one_join(spark, narrow, monkeypatch):
    """Pairs leave no members to compare again, and what is left of larger groups isn't dealt out by class."""
    rng = random.Random(11)
    say = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    pairs = [[own, [*own, "more"]] for own in (say(100) for _ in range(12))]
    base = say(100)
    larger = [[*base[:-9], *say(9)] for _ in range(6)] + [[*base[:-30], *say(30)] for _ in range(6)]
    left, dealt, table, spread = [], [], common.table, common.spread_join
    monkeypatch.setattr(jaccard_join, "table", lambda df, name, *more: (out := table(df, name, *more), left.append(out.rows) if name == "rest" else None)[0])
    monkeypatch.setattr(common, "spread_join", lambda a, b, on, *more: (dealt.append(on), spread(a, b, on, *more))[1])

    def components(texts):
        rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
        got = jaccard_join.joined(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id"), F.col("text"), words=1).select("doc", "n", "component").collect()
        assert Counter(map(tuple, got)) == Counter(plain_components(rows, 1, 85, 100))
        return len({r.component for r in got})

    assert components([t for pair in pairs for t in pair]) == 12 and left == [0]
    left.clear()
    assert components(larger) > 1 and left[0] > 0
    assert dealt and ["x"] not in dealt


def test_components_by_steps_and_in_one_task(spark, monkeypatch):
    rng = random.Random(3)
    edges = spark.createDataFrame([(rng.randrange(400), rng.randrange(400)) for _ in range(200)] + [(7, 7)], "a long, b long")
    few = {tuple(r) for r in components.components(edges).collect()}
    monkeypatch.setattr(components, "FEW", 0)
    assert few == {tuple(r) for r in components.components(edges).collect()} and len(few) == len({x for x, _ in few}) > 200


def test_pieces_are_encoded_once():
    """Marks and words that many stretches share go through the tokenizer's merges once; also with nothing kept, ids stay those of the tokenizer."""
    encoder = packing.Encoder(packing.VOCABULARY)
    merge, seen = encoder.merge, []
    encoder.merge = lambda letters: seen.append(letters) or merge(letters)
    texts = [f"a word{i}, word{i}. (word{i}) word{i}; " + "x" * 60 + f" {'y' * 60} é{i}, <|endoftext|>\n" for i in range(30)]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(texts)] == want
    assert len([x for x in seen if len(x) <= packing.LONGEST]) == len({x for x in seen if len(x) <= packing.LONGEST})
    assert [np.frombuffer(x, "<u4").tolist() for t in texts for x in encoder([t])] == want


@pytest.mark.parametrize("share", [0, 0.02, 0.3, 1])
def test_media_items_are_placed_without_a_sort(monkeypatch, share):
    """Blocks without coefficients, with long runs of zeros and with none: the items of each scan are put where they belong, not sorted."""
    rng = np.random.default_rng(int(100 * share))

    def refused(*args, **more):
        raise AssertionError("the items were sorted")

    images = []
    for units in (1, 7, 30):
        c = rng.integers(-96, 160, (units * media.jpeg.MCU_BLOCKS, 64), np.int32) * (rng.random((units * media.jpeg.MCU_BLOCKS, 64)) < share)
        images.append((1, units, c.astype(np.int32), b"x"))
    monkeypatch.setattr(np, "argsort", refused)
    files = media.jpeg.encode(images)
    monkeypatch.undo()
    for (_, _, c, _), own, info in zip(images, files, media.jpeg.decode(files), strict=True):
        assert (info["coefficients"] == c).all() and media.jpeg.encode([(1, len(c) // media.jpeg.MCU_BLOCKS, c, b"x")])[0] == own
