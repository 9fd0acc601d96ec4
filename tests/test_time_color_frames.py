import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import color as K
from eventloom.functions import timecode as T
from eventloom.operators import frames
from eventloom.operators.summary import Wiggle

CASES = {"31:41:59.265358": 114119265358, "31-41.5": 1901500000, "31": 31000000, "0.0000005": 0, "0.0000015": 2, "00:00:00.000001": 1, "1:2:3": 3723000000, "7.": 7000000}


def test_times(spark):
    for text, us in CASES.items():
        assert T.parse_time(text) == us
    df = spark.createDataFrame([*CASES.items(), ("x", None), ("1:2:3:4", None)], "s string, us long")
    assert df.where(~T.parse_time_column(F.col("s")).eqNullSafe(F.col("us"))).count() == 0
    code = df.where("us is not null").select(T.timecode_column(F.col("us")).alias("c"), "us").collect()
    assert all(r.c == T.to_timecode(r.us) and T.parse_time(r.c) == r.us for r in code)


def test_time_arithmetic():
    a, b = T.Time(10), T.Time(4)
    assert (a + b, a - b, a * 1.25, 2 * a, a / b, a / 4, a // b, a // 3, a % b, divmod(a, b)) == (T.Time(14), T.Time(6), T.Time(12), T.Time(20), 2.5, T.Time(2), 2, T.Time(3), T.Time(2), (2, T.Time(2)))
    assert b < a and 3 * T.s == T.Time(3_000_000) and T.Time(5).to_timecode_with_dashes() == "00-00-00.000005"
    with pytest.raises(ValueError):
        b - a
    for f in (lambda: a * b, lambda: a + 1, lambda: a < 3):
        with pytest.raises(TypeError):
            f()
    with pytest.raises(ValueError):
        T.parse_time("1.2.3")


def test_colors():
    assert K.color_to_ints("#ff8000") == (255, 128, 0, 255) and K.color_to_hex_string((1.0, 0.5, 0.0)) == "#ff7f00ff"
    rgb = np.random.default_rng(0).random((50, 3))
    np.testing.assert_allclose(K.lab_to_srgb(K.srgb_to_lab(rgb)), rgb, atol=1e-3)
    np.testing.assert_allclose(K.linear_to_srgb(K.srgb_to_linear(rgb)), rgb, atol=1e-6)
    maps = K.catalogue()
    assert len(maps) == 38 and {k: sum(m.kind == k for m in maps.values()) for k in ("sequential", "diverging", "cyclic")} == {"sequential": 22, "diverging": 11, "cyclic": 5}
    m = maps["split_0"]
    off, on = m.halves()
    assert (off[0] == on[0]).all() and (off[-1] == m.bytes()[0]).all() and (on[-1] == m.bytes()[-1]).all()
    assert len(m.repeated(3).rgba) == 3 * len(m.rgba) and (m.flipped().flipped().rgba == m.rgba).all() and (m.rolled(2).rolled(-2).rgba == m.rgba).all()
    for kind in K.DICHROMACY:
        assert ((0 <= m.colorblindness_simulation(kind).rgba) & (m.colorblindness_simulation(kind).rgba <= 1)).all()


def test_frames(spark, tmp_path):
    images = [np.full((3, 4, 4), 40 * i + 15, np.uint8) for i in range(5)]
    f = frames.frames_from_list(spark, 100, 10.0, images)
    assert [r.t for r in f.orderBy("frame").collect()] == [100, 100100, 200100, 300100, 400100]
    g = frames.frames_from_function(spark, 0, 10.0, 3, lambda t: np.full((3, 4, 4), t // 100_000, np.uint8))
    assert [(r.t, r.pixels[0]) for r in g.orderBy("frame").collect()] == [(100_000, 1), (200_000, 2), (300_000, 3)]
    assert frames.to_files(f, 4, 3, f"{tmp_path}/{{index:02d}}.png") == 5
    np.testing.assert_array_equal(frames.from_png((tmp_path / "03.png").read_bytes()), images[3])
    turned = [r.frame for r in frames.played(f, 1, True).orderBy("turn").collect()]
    assert turned == [1, 2, 3, 4, 3, 2]
    assert [r.frame for r in frames.played(f.where("frame < 2"), 0, True).orderBy("turn").collect()] == [0, 1]
    mapped = frames.map_frames(f, 4, 3, lambda image, t: 255 - image).orderBy("frame").first()
    assert mapped.pixels[0] == 240
    with pytest.raises(ValueError):
        frames.to_files(f, 4, 3, f"{tmp_path}/same.png")


def test_overlay_scale_and_notes(spark):
    base, top = np.full((4, 5, 4), 100, np.uint8), np.full((2, 2, 4), 200, np.uint8)
    base[..., 3] = top[..., 3] = 255
    out = frames.over(base, top, 4, 3)
    assert out[3, 4, 0] == 200 and out[0, 0, 0] == 100 and frames.over(base, top, -1, -1)[0, 0, 0] == 200
    top[..., 3] = 0
    assert (frames.over(base, top, 0, 0) == base).all()
    assert frames.scale_factor(320, 240) == 3 and frames.scale_factor(2000, 2000) == 1 and frames.scale_factor(10, 10, 2.1) == 3 and frames.scale_factor(100, 100, (250, 10)) == 3
    for name in ("nearest", "triangle", "catmull_rom", "gaussian", "lanczos3"):
        assert (frames.resize(base, 3, name) == 100).sum() >= 12 * 15 * 3
    f = frames.frames_from_list(spark, 0, 25.0, [base])
    r = frames.annotate(frames.annotate(frames.add_timecode(f, 25.0, 25.0), "a", 1, 2), "b", 3, 4).first()
    assert r.timecode == "00:00:00.000000 (Real-time)" and [n.text for n in r.notes] == ["a", "b"]
    assert frames.speed_label(50, 25) == "× 2" and frames.speed_label(25, 100) == "× 1/4"
    assert frames.add_overlay(f, 5, 4, top, 0, 0).count() == 1


def test_wiggle():
    w = Wiggle.of(0, 1_000_000)
    assert (w.skip, w.frequency_hz, w.tau) == (5, 51.0, round(5 / 51 * 1e6))
    assert Wiggle.of(0, 1_000_000, decay="exponential", rewind=False).skip == 15
