import numpy as np
import pytest

from eventloom.functions.color import Colormap
from eventloom.model import EventStream, events_stream_from_array
from eventloom.operators import noise, order, summary, temporal
from eventloom.operators.spatial import TRANSPOSES

KIND = [("t", "<u8"), ("x", "<u2"), ("y", "<u2"), ("on", "?")]
GREY = Colormap.sequential_from_pair("grey", "#000000", "#ffffff")


def made(spark, rows, width=8, height=6):
    return events_stream_from_array(spark, np.array(rows, KIND), (width, height))


def walk(n=3000, width=8, height=6, seed=4):
    rng = np.random.default_rng(seed)
    out = np.zeros(n, KIND)
    out["t"], out["x"], out["y"], out["on"] = np.sort(rng.integers(0, 2_000_000, n)), rng.integers(0, width, n), rng.integers(0, height, n), rng.random(n) < 0.5
    return out


def got(stream: EventStream):
    return [tuple(r) for r in stream.df.orderBy("seq").select("t", "x", "y", "on").collect()]


def test_empty_and_single(spark):
    empty, one = made(spark, []), made(spark, [(5, 1, 1, True)])
    assert empty.time_range() == (0, 1) and one.time_range() == (5, 6)
    assert got(empty.crop(0, 2, 0, 2)) == [] and empty.regularize(10.0).counts().count() == 1
    assert [tuple(r) for r in one.to_kinectograph().collect()] == [(1, 1, 0.5, 1.0)]
    assert got(empty.filter_hot_pixels(2.0)) == [] and got(one.filter_arbiter_saturation_lines(1.0)) == []
    assert empty.to_event_rate(7).count() == 7
    assert EventStream(empty.df, 8, 6).time_range() == (0, 1)


@pytest.mark.parametrize("hz", [60.0, 31.7, 400_000.0, 1 / 3])
def test_packets_follow_the_boundaries(spark, hz):
    for start in (0, 1_589_000_000_000_000):
        t = start + np.arange(20_000)
        df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(t)], "seq long, t long")
        k = [r.packet for r in temporal.regularize(df, hz, start).orderBy("seq").collect()]
        for x, p in zip(t.tolist(), k, strict=True):
            assert temporal.boundary(start, p, hz) <= x < temporal.boundary(start, p + 1, hz)


def test_empty_packets(spark):
    s = made(spark, [(1000, 0, 0, True), (1500, 0, 0, False), (5000, 0, 0, True)]).regularize(1000.0, start=0)
    assert [(r.events, r.on_events) for r in s.counts().orderBy("packet").collect()] == [(0, 0), (2, 1), (0, 0), (0, 0), (0, 0), (1, 1)]
    assert s.time_range() == (0, 6000)
    assert got(s.packet_slice(1, 3, zero=True)) == [(0, 0, 0, True), (500, 0, 0, False)]


def test_slices(spark):
    a = walk()
    s = made(spark, a)
    assert len(got(s.event_slice(10, 20))) == 10 and got(s.event_slice(10, 20)) == got(s)[10:20]
    assert got(s.time_slice(500_000, 900_000)) == [tuple(r) for r in a[(a["t"] >= 500_000) & (a["t"] < 900_000)].tolist()]
    assert s.time_slice("0.5", "0.9", zero=True).time_range() == (0, 400_000)
    n = [r["count"] for r in s.chunks(700).df.groupBy("packet").count().orderBy("packet").collect()]
    assert n == [700, 700, 700, 700, 200]


def test_states(spark):
    s = made(spark, walk(100))
    for call in (lambda: s.packet_slice(0, 1), lambda: s.regularize(10.0).time_slice(0, 1), lambda: s.counts(), lambda: EventStream(s.df, 8, 6, finite=False).time_range()):
        with pytest.raises(TypeError):
            call()
    for call in (lambda: s.crop(0, 9, 0, 1), lambda: s.crop(2, 2, 0, 1), lambda: s.transpose("x"), lambda: s.mask(np.ones((2, 2), bool)), lambda: s.event_slice(3, 3), lambda: s.regularize(0), lambda: s.chunks(0), lambda: s.render("none", 1, GREY)):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("action", TRANSPOSES)
def test_transposes_undo(spark, action):
    s = made(spark, walk(200))
    back = {"rotate_90_counterclockwise": "rotate_270_counterclockwise", "rotate_270_counterclockwise": "rotate_90_counterclockwise"}.get(action, action)
    turned = s.transpose(action)
    again = turned.transpose(back)
    assert again.dimensions() == s.dimensions() and got(again) == got(s)
    assert all(0 <= x < turned.width and 0 <= y < turned.height for _, x, y, _ in got(turned))


@pytest.mark.parametrize(("bucket", "wide"), [(1, 5), (7, 2), (64, 1), (1 << 16, 1 << 12)])
def test_order_does_not_depend_on_buckets(spark, bucket, wide, monkeypatch):
    monkeypatch.setattr(order, "WIDE", wide)
    df = made(spark, walk(500)).df.where("seq % 3 != 1")
    rows = df.orderBy("seq").collect()
    runs, n = [], 0
    for i, r in enumerate(rows):
        n += not i or rows[i - 1].y != r.y
        runs.append(n)
    assert [r.run for r in order.with_runs(df, "y", bucket=bucket).orderBy("seq").collect()] == runs
    sizes = [(runs.count(k), k == runs[-1]) for k in runs]
    assert [(r.length, r.last) for r in order.with_run_lengths(df, "y", bucket=bucket).orderBy("seq").collect()] == sizes
    assert [r.ordinal for r in order.with_ordinals(df, bucket=bucket).orderBy("seq").collect()] == list(range(len(rows)))
    high = np.maximum.accumulate([r.x for r in rows]).tolist()
    assert [r.x for r in order.running_max(df, "x", bucket=bucket).orderBy("seq").collect()] == high


def test_arbiter_threshold(spark):
    y = [1] * 2 + [2] * 3 + [1] * 2 + [3] * 1 + [4] * 1
    s = made(spark, [(i, 0, v, True) for i, v in enumerate(y)])
    kept = [r.y for r in noise.arbiter_saturation_lines(s.df, 2).orderBy("seq").collect()]
    assert kept == [1, 1, 1, 1, 3]  # three in a row are too many, and the last run is still open


def test_hot_pixels_against_a_grid(spark):
    a = walk(4000)
    for ratio in (1.0, 1.2, 2.0):
        grid = np.ones((6, 8))
        np.add.at(grid, (a["y"], a["x"]), 1)
        wide = np.pad(grid, 1, constant_values=1)
        top = np.max([wide[:-2, 1:-1], wide[2:, 1:-1], wide[1:-1, :-2], wide[1:-1, 2:]], 0)
        want = [tuple(r) for r in a[(grid < ratio * top)[a["y"], a["x"]]].tolist()]
        assert got(made(spark, a).filter_hot_pixels(ratio)) == want


def test_kinectograph_and_rate(spark):
    a = walk()
    s = made(spark, a)
    grid = np.zeros((6, 8))
    np.add.at(grid, (a["y"], a["x"]), 1)
    q = np.quantile(grid[grid > 0], 0.9)
    for r in s.to_kinectograph().collect():
        assert r.opacity == pytest.approx(min(1, grid[r.y, r.x] / q))
        own = a["t"][(a["x"] == r.x) & (a["y"] == r.y)].astype(float)
        assert r.mean_time == pytest.approx(((own - a["t"][0]) / (a["t"][-1] - a["t"][0])).mean())
    rates = [r.rate for r in s.to_event_rate(50).orderBy("bucket").collect()]
    weights = summary.hamming(6)
    smooth = [r.smooth for r in summary.smoothed(s.to_event_rate(50), weights).orderBy("bucket").collect()]
    w = np.array(weights) / sum(weights)
    np.testing.assert_allclose(smooth, np.correlate(np.pad(rates, (3, 2), "edge"), w, "valid"), rtol=1e-9)


def test_last_write_wins(spark):
    s = made(spark, [(10, 1, 1, True), (10, 1, 1, False), (20, 2, 2, True)])
    pixels = s.regularize(100_000.0).render("window", 100, Colormap.diverging_from_triplet("d", "#0000ff", "#000000", "#ff0000")).pixels
    assert {(r.x, r.y): r.half for r in pixels.where("frame = 1").collect()} == {(1, 1): -1, (2, 2): 1}


def test_cumulative_is_the_recursion(spark):
    a = walk(800)
    tau = 90_000.0
    s = made(spark, a).regularize(13.0)
    out = {(r.frame, r.x, r.y): r.value for r in s.render("cumulative", int(tau), GREY).pixels.collect()}
    grid, last = np.zeros((6, 8)), s.start
    i = 0
    for k in range(s.packets):
        end = temporal.boundary(s.start, k + 1, 13.0)
        grid *= np.exp(-(end - last) / tau)
        last = end
        while i < len(a) and a["t"][i] < end:
            grid[a["y"][i], a["x"][i]] += np.exp(-(end - int(a["t"][i])) / tau)
            i += 1
        for (f, x, y), v in out.items():
            if f == k:
                assert v == pytest.approx(grid[y, x], rel=1e-9)


def test_info_and_array(spark):
    import hashlib

    a = walk(50)
    s = made(spark, a)
    assert s.info()["digests"]["x"] == hashlib.sha3_224(a["x"].tobytes()).hexdigest()
    t = s.to_array()
    assert t["t"].to_pylist() == a["t"].tolist() and t.num_rows == 50
    assert s.map(lambda b: b.slice(0, 1)).df.count() <= 50 and s.apply(lambda d: d.where("on")).df.count() == int(a["on"].sum())


def far_apart(spark):
    """Times whose sum at a pixel takes more than 64 bits: half of the events at the first time, half at the last."""
    return EventStream(spark.range(2000).selectExpr("id AS seq", "IF(id < 1000, 0L, 20000000000000000L) AS t", "1 AS x", "2 AS y", "true AS on"), 8, 6)


def test_kinectograph_of_sums_beyond_64_bits(spark):
    assert [tuple(r) for r in far_apart(spark).to_kinectograph().collect()] == [(1, 2, 0.5, 1.0)]


def test_kinectograph_image_of_sums_beyond_64_bits(spark):
    from eventloom.operators import plots

    steps = Colormap.from_rgb_table("steps", "sequential", np.repeat(np.arange(256)[:, None] / 255, 3, 1))
    image = plots.kinectograph_image(far_apart(spark).to_kinectograph(), 8, 6, steps)
    assert image[2, 1].tolist() == [128, 128, 128, 255] and image[..., 3].astype(int).sum() == 255


def test_run_lengths_sort_rows_once(spark):
    import re

    df = order.with_run_lengths(spark.range(1000).selectExpr("id AS seq", "CAST(id DIV 7 % 5 AS INT) AS y"), "y")
    assert not re.search(r"Sort \[_bucket#\w+ ASC NULLS FIRST, _inside", df._jdf.queryExecution().executedPlan().toString())
