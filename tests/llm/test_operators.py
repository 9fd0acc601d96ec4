"""Each operator against a plain version on small tables, with the awkward rows: nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import exact_dedup, jaccard_join, language_id, line_dedup, media, mixing, packing, pii, progressive_jpeg, quality, substring_dedup
from eventloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def table_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    """A few hundred rows of the small table, near copies of some, and awkward ones."""
    rng = random.Random(7)
    base = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(150).collect()]
    out = list(base)
    for i, (_, text, lang, source, _) in enumerate(base[:40]):
        words = text.split(" ")
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "changed"
        out.append((1000 + i, " ".join(words), lang, source, len(text)))
    out += [(2000, None, None, None, None), (2001, "", "en", "a", 0), (2002, " \t\n", None, "a", 3), (2003, "one two", "en", None, 7), (2004, "one  two", "en", "b", 8), (None, "no id here at all, really none", "en", "b", 5)]
    out += [out[3], out[3], (2005, "long " * 20000 + "\n" * 500, "fr", "b", 0)]
    return out


@pytest.fixture(scope="module")
def frame(spark, docs):
    return table_of(spark, docs)


def words_of(text):
    return (text or "").encode().split()


# -- 1


def removed_lines(rows, least=3, long=50):
    """Positions of lines in later runs, or later long lines, by key and line number."""
    own = {}
    for k, t in rows:
        lines = (t or "").split("\n")
        own[k] = [(i, x.strip(" \t\n\x0b\x0c\r")) for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
    first, gone = {}, defaultdict(set)
    for k in sorted(own):
        for j in range(len(own[k]) - least + 1):
            run = tuple(x for _, x in own[k][j : j + least])
            if first.setdefault(run, (k, j)) != (k, j):
                gone[k] |= {i for i, _ in own[k][j : j + least]}
        for j, (i, x) in enumerate(own[k]):
            if len(x) >= long and first.setdefault(x, (k, j)) != (k, j):
                gone[k].add(i)
    return gone


def test_line_dedup(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice("abcde ") for _ in range(rng.randint(0, 14)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "\n\n"), (303, "x\n" * 3000), (304, "p\nq\nr\ns"), (305, " p \nq\n\nr\t\nend")]
    wide, near = "wide " * 9 + "wi\u00e9\U0001f600t", "wide " * 9 + "wi\u00e9t"  # 50 characters, and 49
    rows += [(306, f"one\n{wide}\ntwo"), (307, f"{wide}\n{near}"), (308, f"a\n {wide}\t\n{near}\n{wide}"), (309, wide)]
    gone = removed_lines(rows)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n int, h int")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    for k, t in rows:
        want = t if not gone[k] else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k])
        assert (out[k].text, out[k]._removed, out[k].n) == (want, len(gone[k]), 1)
    assert out[305].text == "\nend" and out[306]._removed == 0 and out[308].text == f"a\n{near}" and out[309].text == ""
    for gram, least in ((1, 2), (2, 5), (3, 3)):
        gone = removed_lines(rows, least, 60)
        got = {r.doc_id: r._removed for r in line_dedup.dedup_lines(df, gram=gram, least=least, long=60).collect()}
        assert got == {k: len(gone[k]) for k, _ in rows}
    twice = line_dedup.dedup_lines(spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc"), (None, "a\nb\nc")], "doc_id long, text string"))
    assert Counter((r.doc_id, r._removed) for r in twice.collect()) == {(1, 3): 2, (2, 3): 1, (None, 0): 1}


# -- 2


def base_spans(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else 2 * int(c) % 10 + 2 * int(c) // 10 for i, c in enumerate(reversed(d))) % 10 == 0

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (kind == "card" and not (16 <= len(d) <= 19 and luhn(d))) or (kind == "phone" and not 8 <= len(d) <= 15):
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark, monkeypatch):
    rng = random.Random(3)
    texts = [None, "", "a@b.c_x@d.e +1 (743) 555-3824 4785380592391139 001.2.3.4 300.1.1.1", "é😀 x@y.zz 1.2.3.4.5.6.7.8", "9" * 20000, "+1" * 3000, "a" * 50000 + "@b", "@" * 500, "1 " * 8000]
    texts += ["".join(rng.choice("ab01 .-+@%()\n9é😀") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += ["".join(rng.choice("0123456789. -") for _ in range(150)) for _ in range(100)]
    monkeypatch.setattr(pii, "read", lambda *_: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    out = {r.doc_id: r for r in pii.query(spark, "").collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert out[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(out[i].spans.split(","))
        assert [out[i][f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]


def test_pii_model(spark):
    model = pii.train(spark)
    texts = {"write to john.doe (at) mail (dot) com now": "write to [EMAIL] now", "call (743) 555-3824 today": "call [PHONE] today", "card 378282246310005 paid": "card [CARD] paid", "host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 ok": "host [IP] ok", "we meet at noon, version 2.4.1 of 2024-05-06": None, "order 1234567890123 x, pages 12-34": None}
    out = pii.find(spark.createDataFrame([(t,) for t in texts], "text string"), "text", model)
    assert {r.text: r.red for r in out.withColumn("red", pii.redacted(F.col("text"), F.col("_spans"))).collect()} == {k: v or k for k, v in texts.items()}
    # The trees as a column give what they give in numpy.
    x = np.random.default_rng(0).integers(0, 20, (200, len(pii.FEATURES)))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, f array<int>").select("i", model.column(F.col("f")).alias("p"))
    np.testing.assert_allclose([r.p for r in df.orderBy("i").collect()], model.probabilities(x), rtol=1e-9)


# -- 3


def test_targets():
    assert mixing.capped_targets([100, 100, 100], [1, 1, 1], 150, 2) == [50, 50, 50]
    out = mixing.capped_targets([10, 100, 400], [3, 1, 2], 510 * 1.5, 2)
    assert out[0] == 20 and sum(out) == pytest.approx(765) and all(a <= 2 * b + 1e-9 for a, b in zip(out, [10, 100, 400], strict=True))
    assert mixing.capped_targets([], [], 0, 2) == []


def test_flow_prefers_first_passes_and_fills_quotas():
    flow = mixing.min_cost_flow([100, 50, 80], [[0], [0, 1], [1]], [150, 120], 2)
    assert sum(f.get(0, 0) for f in flow) == pytest.approx(150) and sum(f.get(1, 0) for f in flow) == pytest.approx(120)
    spent = [sum(f.values()) for f in flow]
    assert spent[1] >= 50 and sum(max(0, s - c) for s, c in zip(spent, [100, 50, 80], strict=True)) == pytest.approx(40)


def test_mixing(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "read", lambda *_: table_of(spark, docs))
    rows = mixing.query(spark, "").collect()
    assert len(rows) == len(docs) and sorted(map(str, rows)) == sorted(map(str, mixing.query(spark, "").collect()))
    size = Counter()
    for _, t, _, s, _ in docs:
        size[s] += len(words_of(t))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    targets = dict(zip(names, mixing.capped_targets([size[s] for s in names], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(names))], 1.5 * sum(size.values()), 2), strict=True))
    source = {k: s for k, _, _, s, _ in docs}
    taken, top = Counter(), Counter()
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(targets[s]) and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
        top[s] = max(top[s], r.size)
    assert all(abs(taken[s] - targets[s]) <= top[s] / 2 + 1e-6 for s in names)


def test_mixing_overlaps(spark):
    rows = [(i, 10, [["a"], ["a", "b"], ["b"]][i % 3]) for i in range(300)]
    out = mixing.mix(spark.createDataFrame(rows, "k long, n long, s array<string>"), F.col("k"), F.col("n"), F.col("s"), total=2000.0, weights=(1.0, 1.0)).collect()
    got = Counter(x for r in out for x in r.routed)
    assert abs(got["a"] - 100) <= 1 and abs(got["b"] - 100) <= 1 and all(set(r.routed) <= set(r.sources) for r in out)


# -- 4


def symbols_of(text):
    return [chr(quality.PAD)] * (quality.ORDER - 1) + list(re.sub(r"[\x00\x20\x09-\x0D]+", " ", text or ""))


def plain_kn(texts):
    """Interpolated modified Kneser-Ney over characters, with dictionaries."""
    n = quality.ORDER
    grams = Counter()
    for t in texts:
        s = symbols_of(t)
        grams.update(tuple(s[i : i + n]) for i in range(len(s) - n + 1))
    level = {n: grams}
    for size in range(n - 1, 0, -1):
        level[size] = Counter(g[1:] for g in level[size + 1])
    tables = {}
    for size in range(1, n + 1):
        c = level[size]
        k = [0, *(sum(v == i for v in c.values()) for i in (1, 2, 3, 4))]
        d = [0, 0.5, 0.75, 0.9]
        if k[1]:
            y = k[1] / (k[1] + 2 * k[2])
            d = [0, *(max(0.05, min(i - 0.05, i - (i + 1) * y * k[i + 1] / k[i])) if k[i] else d[i] for i in (1, 2, 3))]
        total, back = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            back[g[:-1]] += d[min(v, 3)]
        tables[size] = (c, d, total, back)

    def p(g):
        if not g:
            return 1 / (len(level[1]) + 1)
        c, d, total, back = tables[len(g)]
        h = g[:-1]
        if not total[h]:
            return p(g[1:])
        return max(0, c[g] - d[min(c[g], 3)]) / total[h] + back[h] / total[h] * p(g[1:])

    def logp(t):
        s = symbols_of(t)
        return sum(np.log(p(tuple(s[i : i + n]))) for i in range(len(s) - n + 1))

    return logp, p, [g[0] for g in level[1]]


@pytest.fixture(scope="module")
def model(spark, docs):
    """A model of some texts in English and one in three scripts."""
    texts = {"en": [t for _, t, lang, _, _ in docs if lang == "en" and t][:40], "xx": ["Быстрая лиса и 漢字かな交じり文 και ελληνικά", "漢字かな漢字かな", "x\x02y \x00z"]}
    df = spark.createDataFrame([(k, t) for k, ts in texts.items() for t in ts], "lang string, text string")
    return texts, quality.kneser_ney(quality.counted(df))


TRIED = ["", "### $$$ ZZZ", "é", "x" * 50, None, " \n\t a  b\x00c ", "Быстрая 漢字 лиса", "漢漢漢漢", "lone \U0001f600 end"]


def test_quality_against_dictionaries(spark, model, monkeypatch):
    texts, made = model
    tried = [t[:500] for t in texts["en"][:5]] + TRIED
    frame = spark.createDataFrame([(i, lang, t) for i, t in enumerate(tried) for lang in ("en", "xx", "none")], "i int, lang string, text string")
    plain = {"en": plain_kn(texts["en"])[0], "xx": plain_kn(texts["xx"])[0], "none": plain_kn(sum(texts.values(), []))[0]}
    for most in (quality.BROADCAST_GRAMS, 10):  # by look-up, and by the join
        monkeypatch.setattr(quality, "BROADCAST_GRAMS", most)
        out = quality.scored(frame, made, "lang", "text").select("row.i", "row.lang", "logp", "symbols", "most").collect()
        assert len(out) == 3 * len(tried)
        for r in out:
            s = symbols_of(tried[r.i])
            assert r.logp == pytest.approx(plain[r.lang](tried[r.i]), rel=1e-5, abs=1e-4) and r.symbols == len(s) - quality.ORDER + 1
            assert r.most == max(Counter(tuple(s[i : i + 5]) for i in range(len(s) - 4)).values(), default=0)


def test_gram_hashes():
    for grams in (["a"], ["ab", "漢字"], ["a", "é"], ["abcde"]):
        one = [list(quality.hashes(np.array([ord(c) for c in "x" * (5 - len(g)) + g], np.uint32)))[len(g) - 1][-1] for g in grams]
        assert quality.gram_hashes(np.array(grams, object)).tolist() == [int(h) for h in one]


def test_quality_probabilities_sum_to_one(model):
    texts, _ = model
    _, p, known = plain_kn(texts["xx"])
    for context in [tuple(symbols_of(texts["xx"][0])[i : i + 4]) for i in (0, 3, 10, 20)] + [tuple("qqqq")]:
        assert sum(p((*context, c)) for c in known) + p((*context, "unknown")) == pytest.approx(1)


def test_quality_decisions(spark, docs):
    labels = spark.createDataFrame([(k, int(i % 5 > 0), 0) for i, (k, *_) in enumerate(docs) if k is not None and k < 1000], "doc_id long, quality int, toxic int")
    frame = table_of(spark, docs + [(3000, "### $$$ %%% &&& ### *** " * 30, "en", "a", 1), (3001, "#@!" * 100, "xx", "a", 1), (3002, "The " * 300, "en", "a", 1), (3003, "漢字 лиса " * 50, "en", "b", 1)]).withColumn("n", F.lit(1))
    rows = quality.judged(frame, labels).collect()
    out = {r.doc_id: r for r in rows}
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in frame.select("doc_id").collect())
    assert not any(out[k]._kept for k in (3000, 3001, 3002, 3003)) and out[2000]._kept and out[2001]._kept and out[3000].n == 1
    # Limits by plain nearest ranks, over the texts left out of the training and the others.
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    marks = {r.doc_id: r.h for r in frame.select("doc_id", (F.pmod(F.xxhash64("text"), F.lit(quality.FOLDS)) == 0).alias("h")).collect()}
    rank = lambda values, q: sorted(values)[min(len(values), int(np.ceil(q * len(values)))) - 1]
    for lang in ("en", "fr"):
        own = [r for r in rows if r.lang == lang and r.doc_id in good]
        assert {round(r._limit, 9) for r in own} == {round(rank([r._perplexity for r in own if marks[r.doc_id]], quality.UPPER), 9)}
        assert {round(r._least, 9) for r in own} == {round(rank([r._perplexity for r in own if not marks[r.doc_id]], quality.LOWER), 9)}
        assert {round(r._most, 9) for r in own} == {round(rank([r._repeated for r in own], quality.REPEATS), 9)}
    e = 1e-9
    assert all(r._kept == (r._least - e <= r._perplexity <= r._limit + e and r._repeated <= r._most + e) for r in rows)
    assert sum(out[k]._kept for k in good) >= 0.97 * len(good)
    none = quality.judged(frame, labels.where("false")).collect()
    assert len(none) == frame.count() and all(r._kept and r._perplexity is None for r in none)
    assert quality.judged(frame.where("false"), labels).count() == 0


# -- 5


def test_chunks_are_content_defined():
    rng = np.random.default_rng(0)
    body = bytes(rng.integers(97, 123, 60_000, dtype=np.uint8))
    cut = lambda d: [d[a:b] for a, b in zip([0, *exact_dedup.cuts(d)], exact_dedup.cuts(d), strict=False)]
    assert b"".join(cut(body)) == body and len(set(cut(body)) & set(cut(b"other start " + body))) > len(cut(body)) * 0.8
    assert max(map(len, cut(b"a" * 50_000))) <= exact_dedup.MOST and exact_dedup.cuts(b"") == []


def test_exact_dedup(spark, docs, frame, monkeypatch):
    monkeypatch.setattr(exact_dedup, "read", lambda *_: frame)
    rows = exact_dedup.query(spark, "").collect()
    plain = lambda t: SPACE.sub(" ", t or "")
    groups = defaultdict(list)
    for k, t, *_ in docs:
        groups[plain(t)].append(k)
    want = Counter()
    for t, ks in groups.items():
        ids = [k for k in ks if k is not None]
        keep, left = min(ids, default=None), True
        for k in ks:
            stays = k == keep and left
            left = left and not stays
            want[(k, keep, len(ks), stays, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in rows) == want
    assert exact_dedup.exact_groups(frame.where("false"), F.col("doc_id"), F.col("text")).count() == 0


# -- 6


def plain_components(docs, words, num, den):
    sets = []
    for k, t in docs:
        w = (t or "").encode().lower().split()
        sets.append((k, {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(sets):
        if k is not None:
            least[find(i)].append(k)
    return [(k, len(s), min(least[find(i)], default=None) if s else k) for i, (k, s) in enumerate(sets)]


@pytest.mark.parametrize(("words", "num"), [(4, 85), (5, 80)])
def test_jaccard_join(spark, docs, frame, words, num):
    rng = random.Random(words)
    extra = []
    for g in range(12):  # small texts and chains of growing difference
        base = [f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 40, 90]))]
        for i in range(8):
            if rng.random() < 0.7:
                base = [*base]
                base[rng.randrange(len(base))] = f"v{rng.randrange(1000)}"
            extra.append((5000 + 10 * g + i, " ".join(base), "en", "a", 1))
    whole = table_of(spark, docs + extra)
    got = jaccard_join.joined(whole, F.col("doc_id"), F.col("text"), words=words, num=num, den=100).select("doc", "n", "component").collect()
    assert Counter(map(tuple, got)) == Counter(plain_components([(k, t) for k, t, *_ in docs + extra], words, num, 100))
    assert jaccard_join.joined(whole.where("false"), F.col("doc_id"), F.col("text")).count() == 0


def test_blocks_meet():
    rng = np.random.default_rng(5)
    for _ in range(600):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        drop = int(rng.integers(0, 1 + len(a) // 6))
        b = np.unique(np.concatenate((a[rng.permutation(len(a))[drop:]], rng.integers(0, 1 << 63, int(rng.integers(0, 2 + len(a) // 6))).astype(np.uint64))))
        same = len(np.intersect1d(a, b))
        for num in (80, 85):
            if not len(b) or 100 * same < num * (len(a) + len(b) - same):
                continue
            (ka, sa), (kb, sb) = (jaccard_join.block_keys(x, num, 100, {}) for x in (a, b))
            assert sa >= 0 or sb >= 0 or len(np.intersect1d(ka, kb))
            assert max(sa, sb) < 0 or min(len(a), len(b)) < 40
            away = int(np.bitwise_count((jaccard_join.parity_sketch(a) ^ jaccard_join.parity_sketch(b)).view(np.uint64)).sum())
            assert away <= len(a) + len(b) - 2 * same


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (200, 200)] + [(300, 301 + i) for i in range(50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100} | {i: 300 for i in range(300, 351)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 7


def test_packing(spark, docs, frame, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "read", lambda *_: frame)
    rows = packing.query(spark, "").collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want, total = Counter(), 0
    for k, t, *_ in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        first = len(ids) % 1024 or 1024 if len(ids) > 1024 else len(ids)
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(k, p, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(held) <= 1.1 * total / 1024 + 2
    assert packing.pack(frame.where("false"), F.col("doc_id"), F.col("text")).count() == 0


def test_stretches_are_the_tokenizers_own():
    encoder = packing.Encoder(packing.VOCABULARY)
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "B", "é", "ñ", " ", " ", "\n", "\t", "1", "42", ".", ",", "'s", "'ll", "😀", "\xa0", "#", "<|endoftext|>", "中", "of", "ing"]) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder(texts) == want


def test_added_tokens_are_one_id():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    texts = ["x<|endoftext|>y", "<|endoftext|>", "a  <|endoftext|> \n b<|endoftext|><|endoftext|>", " <|endoftext|>.", "<|endoftext|", "of <|ENDOFTEXT|> "]
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.Encoder(packing.VOCABULARY)(texts)] == want
    assert want[0] == [87, 50256, 88]


@pytest.mark.parametrize("n", [0, 1, 2, 50, 5000, 300_000])
def test_plan_uses_each_piece_once(n):
    h = np.bincount(np.random.default_rng(n).integers(1, 1024, n), minlength=1024) if n else np.zeros(1024, np.int64)
    plan = packing.intervals(h, 1024)
    used, ends, sequences = np.zeros(1024, np.int64), defaultdict(list), 0
    for length, lo, hi, base, _ in plan:
        used[length] += hi - lo
        ends[length].append((lo, hi))
        sequences = max(sequences, base + hi - lo)
    assert (used == h).all() and sequences <= 1.01 * (h * np.arange(1024)).sum() / 1024 + 12
    for own in ends.values():
        assert [a for a, _ in sorted(own)] == [0, *(b for _, b in sorted(own))][:-1]


# -- 8


def test_sentence_spans(spark):
    passage = "Here stands a passage of many words. It goes on for some time so that it counts. And here is a third sentence with more words in it. Then a fourth one closes it all."
    rows = [(1, f"First text begins. {passage} It ends here."), (2, f"other words before {passage} and after it."), (3, f"Lone.\n{passage.replace(' ', '  ')}\nLast one."), (4, None), (5, ""), (6, "Nothing is repeated here. Not at all. No."), (7, passage), (7, passage), (8, "x " * 30000)]
    out = substring_dedup.remove_repeats(spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, key int")).collect()
    by = {(r.key, r.text): r.n_removed for r in out}
    assert by[(1, rows[0][1])] == 0 and by[(2, "other words before and after it.")] == 4 and by[(3, "Lone.\nLast one.")] == 4
    assert by[(4, None)] == 0 and by[(5, "")] == 0 and by[(6, rows[5][1])] == 0 and [r.text for r in out if r.key == 7] == ["", ""]
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spans_against_brute_force(spark, docs):
    rows = [(k, t) for k, t, *_ in docs if k is not None and t and k not in (docs[3][0], 2005)]
    got = {r.key: r.n_removed for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first, gone = {}, defaultdict(set)
    for k, t in sorted(rows):
        data = t.encode()
        starts, opens = substring_dedup.words_and_sentences(data)
        words, edges = data.split(), [*opens.tolist(), len(starts)]
        for i in range(len(edges) - 1):
            j = i + 3
            while j < len(edges) and edges[j] - edges[i] < 20:
                j += 1
            if j < len(edges) and first.setdefault(tuple(words[edges[i] : edges[j]]), (k, i)) != (k, i):
                gone[k] |= set(range(i, j))
    assert got == {k: len(gone[k]) for k, _ in rows}


def test_repeats_of_one_and_two_sentences(spark):
    rng = random.Random(8)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    one, two, none, long = f"One {words(54)}.", f"Two {words(26)}. And {words(26)}.", words(55), words(400)
    rows = []
    for i in range(6):
        for j, passage in enumerate((one, two, none, long)):
            rows.append((10 * i + j, f"Before it {words(rng.randrange(1, 40))} {passage} {words(rng.randrange(1, 40))}. {words(30)}"))
    rows += [(100, None), (101, ""), (102, "The " * 300), (103, one), (103, one)]
    whole = spark.createDataFrame(rows, "doc_id long, text string")
    out = substring_dedup.remove_repeats(whole, sentences=1, gap=substring_dedup.GAP, most=substring_dedup.MOST).collect()
    assert Counter(r.key for r in out) == Counter(k for k, _ in rows)
    met = {}
    for r in out:
        own = (r.text or "").split()
        for i in range(len(own) - 49):
            assert met.setdefault(tuple(own[i : i + 50]), r.key) == r.key
    by = {r.key: r for r in out}
    for k, t in rows:
        if k < 100:
            left = set((by[k].text or "").split())
            assert (by[k].text == t) == (k < 10) and all(w in left for w in t.split()[:3] + t.split()[-29:])


# -- 9


def test_media(spark, docs, frame, monkeypatch):
    monkeypatch.setattr(media, "read", lambda *_: frame)
    rows = media.query(spark, "").collect()
    want = Counter()
    for k, t, *_ in docs:
        data = (t or "").encode()
        payload = media.padded(data)
        want[(k, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    same = defaultdict(set)
    text = {(k, len((t or "").encode())): t for k, t, *_ in docs}
    for r in rows:
        same[text[(r.doc_id, r.n_bytes)]].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in same.values())
    t = media.tensors(frame.limit(3), F.col("doc_id"), F.col("text")).first()
    assert len(t.rgb) == t.height * t.width * 3 and t.media[:2] == b"\xff\xd8"
    assert media.digests(frame.where("false"), F.col("doc_id"), F.col("text")).count() == 0


def serial_decode(data):
    """A bit-by-bit progressive decoder of one component at a time, for files without interleaving."""
    at, tables, interval, frame, out, script = 2, {}, 0, None, {}, []
    while data[at + 1] != 0xD9:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xC4:
            code, codes, i = 0, {}, 17
            for n in range(1, 17):
                for _ in range(body[n]):
                    codes[(n, code)] = body[i]
                    code, i = code + 1, i + 1
                code <<= 1
            tables[body[0]] = codes
        elif kind == 0xDD:
            interval = int.from_bytes(body, "big")
        elif kind == 0xC2:
            h, w = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame = {1: h * w // 64, 2: h * w // 256, 3: h * w // 256}
            out = {k: [[0] * 64 for _ in range(n)] for k, n in frame.items()}
        elif kind == 0xDA:
            comp, (first, last, bits) = body[1], body[3:6]
            high, low = bits >> 4, bits & 15
            script.append((comp, first, last, high, low))
            stream, pos, blocks, pred, eob = [], 0, out[comp], 0, 0

            def fill():
                nonlocal at, stream, pos
                stream, pos = [], 0
                while not (data[at] == 255 and data[at + 1] != 0):
                    stream += [data[at] >> (7 - i) & 1 for i in range(8)]
                    at += 2 if data[at] == 255 else 1

            def bit():
                nonlocal pos
                pos += 1
                return stream[pos - 1]

            def number(n):
                v = 0
                for _ in range(n):
                    v = v << 1 | bit()
                return v

            def symbol(t):
                n = v = 0
                while True:
                    n, v = n + 1, v << 1 | bit()
                    if (n, v) in t:
                        return t[(n, v)]

            def signed(n):
                v = number(n)
                return v if not n or v >> (n - 1) else v - (1 << n) + 1

            fill()
            for i, c in enumerate(blocks):
                if i and i % interval == 0:
                    assert data[at + 1] == 0xD0 + (i // interval - 1) % 8
                    at += 2
                    fill()
                    pred = eob = 0
                if first == 0:
                    if high:
                        c[0] |= bit() << low
                    else:
                        pred += signed(symbol(tables[0]))
                        c[0] = pred << low
                    continue
                k = first
                fix = lambda: c.__setitem__(k, c[k] + (1 << low) * (1 if c[k] > 0 else -1)) if bit() else None  # noqa: E731, B023
                while k <= last and not eob:
                    rs = symbol(tables[16])
                    r, s = rs >> 4, rs & 15
                    new = 0
                    if s == 0 and r < 15:
                        eob = (1 << r) + number(r)
                        break
                    if s:
                        new = (signed(s) if not high else (1 if bit() else -1)) * (1 << low)
                    while k <= last:
                        if high and c[k]:
                            fix()
                        elif r == 0:
                            c[k] = new
                            k += 1
                            break
                        else:
                            r -= 1
                        k += 1
                if eob:
                    while high and k <= last:
                        if c[k]:
                            fix()
                        k += 1
                    eob -= 1
    return np.array(out[1] + out[2] + out[3]), script


def test_jpeg_is_what_a_serial_decoder_reads():
    rng = np.random.default_rng(8)
    payloads = [media.padded(b"plain words, 0123"), bytes(rng.integers(0, 256, 64 * 9, dtype=np.uint8)), bytes(rng.choice([96, 96, 96, 96, 95, 97, 94, 98], 64 * 70).astype(np.uint8)), b"\x60" * 64 * 5]
    for p, f in zip(payloads, progressive_jpeg.encode([media.as_image(p) for p in payloads]), strict=True):
        c, script = serial_decode(f)
        assert (c[: len(p) // 64].astype(int) + media.BIAS).astype(np.uint8).tobytes() == p
        assert len(script) == 15 and {s[3:] for s in script} == {(0, 1), (1, 0)}


def test_transform_is_the_cosine_sum():
    c = np.zeros((6, 64), np.int64)
    c[:, :9] = np.random.default_rng(1).integers(-90, 90, (6, 9))
    info = progressive_jpeg.decode(progressive_jpeg.encode([(1, 1, c, b"payload 384")]))[0]
    assert (info["coefficients"] == c).all()
    z = progressive_jpeg.zigzag()
    raster = np.zeros((8, 8))
    raster.ravel()[z] = c[0]
    u = np.arange(8)
    t = np.cos((2 * u[:, None] + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1) / 2
    progressive_jpeg.samples([info])
    assert np.abs(info["samples"][0].reshape(8, 8) - np.clip(t @ raster @ t.T + 128, 0, 255)).max() <= 0.51 + 0.1


# -- 10


def test_language_id(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    more = spark.createDataFrame([(9000, None, "en"), (9001, "", "en"), (9002, "12 !? 3", "de"), (None, "the thing is", "en"), (9003, "the thing", None)], "doc_id long, text string, lang string")
    whole = d.union(more)
    learned = language_id.learn(whole.where(fold != 2), "doc_id", "text", "lang")
    assert sorted(learned) == ["de", "en", "es", "fr"]
    out = language_id.identify(whole, learned, F.col("doc_id"), F.col("text"), F.coalesce(fold == 2, F.lit(False))).join(whole.select("doc_id", "lang"), "doc_id")
    r = out.where("held_out and lang is not null and doc_id < 9000").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] >= 0.97 and 0 <= r[1] <= r[2] <= 1
    assert {x.doc_id: x.lang_pred for x in out.where("doc_id in (9000, 9001, 9002)").collect()} == {9000: "und", 9001: "und", 9002: "und"}
    # A label of a held-out row changes nothing.
    other = language_id.learn(whole.withColumn("lang", F.when(fold == 2, F.lit("zz")).otherwise(F.col("lang"))).where(fold != 2), "doc_id", "text", "lang")
    assert other == learned
    assert {x.lang_pred for x in language_id.identify(more, {}, F.col("doc_id"), F.col("text"), F.lit(False)).collect()} == {"und"}
