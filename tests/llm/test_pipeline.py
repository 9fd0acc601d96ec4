"""The pipeline's stages, each on what its predecessor kept, against plain versions."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from eventloom.llm import quality
from eventloom.llm.common import table
from eventloom.llm.mixing import capped_targets
from tests.llm.test_operators import plain_components, removed_lines

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """The documents before each stage, and the last stage's rows."""
    now = spark.read.parquet(f"{DIR}/documents.parquet")
    now = now.union(now.where("doc_id in (5, 6)")).union(spark.createDataFrame([(900, None, "en", "src1", None), (901, "", None, None, 0), (None, "a text without any id of its own", "en", "src1", 32)], now.schema))
    out = [now]
    for name, stage in P.STAGES:
        now = table(stage(spark, now, DIR), name.replace(" ", "-"))
        out.append(now)
    return out


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(kept):
    assert len(P.STAGES) == 5 and all(k.columns == kept[0].columns for k in kept[:-1])
    assert kept[-1].columns[:3] == ["doc_id", "piece", "start"]


def test_quality_stage(spark, kept):
    out = quality.judged(kept[0], spark.read.parquet(f"{DIR}/labels.parquet"))
    want = Counter(r.doc_id for r in out.collect() if r._perplexity is None or (r._least - 1e-9 <= r._perplexity <= r._limit + 1e-9 and r._repeated <= r._most + 1e-9))
    assert Counter(k for k, _ in texts(kept[1])) == want
    good = spark.read.parquet(f"{DIR}/labels.parquet").where("quality = 1").select("doc_id")
    assert kept[1].join(good, "doc_id").select("doc_id").distinct().count() >= 0.97 * good.count()


def test_line_stage(kept):
    before, after = texts(kept[1]), texts(kept[2])
    gone = removed_lines(before)
    want = Counter((k, t if not gone[k] else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k])) for k, t in before)
    assert Counter(after) == want
    assert kept[2].where("text is not null and n_chars != length(text)").count() == 0


def test_near_copy_stage(kept):
    before, after = texts(kept[2]), Counter(texts(kept[3]))
    least = {(k, t): c for (k, t), (_, _, c) in zip(before, plain_components(before, 5, 80, 100), strict=True)}
    assert after == Counter({(k, t): 1 for k, t in before if least[(k, t)] == k})


def test_near_copies_of_shared_and_null_ids(spark):
    words = lambda name, n=60: [f"{name}{i}" for i in range(n)]
    near = lambda w: " ".join([*w[:-1], "other"])
    a, b, c = words("a"), words("b"), words("c")
    rows = [(1, " ".join(a)), (None, near(a)), (None, "alone without an id"), (7, near(a)), (7, "alone under a shared id"), (8, " ".join(b)), (8, near(b)), (None, " ".join(c)), (None, near(c)), (9, "twice"), (9, "twice"), (None, ""), (7, None)]
    docs = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(texts(P.keep_one_of_near_copies(spark, docs, DIR)))
    one = [[x for x in got if x in pair] for pair in ({rows[5], rows[6]}, {rows[7], rows[8]})]
    assert [len(x) for x in one] == [1, 1]
    assert got == Counter([rows[0], rows[2], rows[4], rows[9], rows[11], rows[12], *one[0], *one[1]])


def test_mixing_stage(kept):
    size, source, times = {}, {}, Counter()
    for r in kept[3].collect():
        size[r.doc_id], source[r.doc_id] = len((r.text or "").encode().split()), r.source
    for k, _ in texts(kept[4]):
        times[k] += 1
    assert set(times) <= set(size) and max(times.values()) <= 2
    whole, taken, top = defaultdict(int), defaultdict(int), defaultdict(int)
    for k, s in source.items():
        whole[s] += size[k]
        taken[s] += size[k] * times[k]
        top[s] = max(top[s], size[k])
    names = sorted((s for s in whole if s is not None), key=lambda s: s.encode()) + [None] * (None in whole)
    for s, target in zip(names, capped_targets([whole[s] for s in names], [(3.0, 1.0, 2.0)[i % 3] for i in range(len(names))], 1.5 * sum(whole.values()), 2), strict=True):
        assert abs(taken[s] - target) <= top[s] / 2 + 1e-6


def test_packing_stage(kept):
    last = kept[5].groupBy("doc_id").agg(F.countDistinct("sequence_id", "offset").alias("n"), F.count("*").alias("m"))
    assert last.where("n != m").count() == 0
    assert {r.doc_id for r in last.collect()} == {k for k, _ in texts(kept[4])}
    full = kept[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.where("n != end or n > 1024").count() == 0
