"""Queries of time values, colours and images, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import color
from eventloom.functions.color import Colormap
from eventloom.functions.timecode import Time, parse_time
from eventloom.model import ImageStream
from eventloom.operators import animation, frames, plots, summary
from eventloom.plans import adapter
from eventloom.plans.adapter import HEIGHT, WIDTH, workspace
from eventloom.plans.registry import DAILY, STEPS, TAU, _LAST, line_stream, query, stream

def _each(df: DataFrame, function, schema: str) -> DataFrame:
    """``function`` of the values of each row, which gives a row of ``schema``."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [function(*r) for r in pdf.itertuples(index=False)]
            yield type(pdf)(rows, columns=names)

    return df.mapInPandas(run, schema)


@query("time_arithmetic", " SELECT seq, t + 1500000 AS added, greatest(t, 90000000) - least(t, 90000000) AS apart, CAST(round_even(t * 0.25::DOUBLE, 0) AS BIGINT) AS quarter, CAST(round_even(t / 3.0::DOUBLE, 0) AS BIGINT) AS third, t // 7000000 AS sevens, t % 7000000 AS rest, t < 90000000 AS early FROM e")
def time_arithmetic(spark, d):
    limit, seven = Time(90_000_000), Time.parse("7")

    def row(seq, t):
        t = Time(int(t))
        sevens, rest = divmod(t, seven)
        return int(seq), (t + Time(1_500_000)).us, (max(t, limit) - min(t, limit)).us, (t * 0.25).us, (t / 3).us, sevens, rest.us, t < limit

    return _each(adapter.events(spark, d).select("seq", "t"), row, "seq long, added long, apart long, quarter long, third long, sevens long, rest long, early boolean")


@query("time_units", " SELECT seq, t // 1000 * 1000 AS from_ms, t // 1000000 * 1000000 + 250000 AS parsed FROM e")
def time_units(spark, d):
    from eventloom.functions.timecode import ms

    return _each(adapter.events(spark, d).select("seq", "t"), lambda seq, t: (int(seq), (ms * (int(t) // 1000)).us, parse_time(f"{int(t) // 1_000_000}.25")), "seq long, from_ms long, parsed long")


_CUT = "CAST(trunc({} / 255.0::DOUBLE * 255) AS INT)"
_R, _G, _B = (_CUT.format(f"(p_partkey * {k} % 256)") for k in (1, 7, 13))


@query("color_forms", f" SELECT p_partkey, r, g, b, printf('#%02x%02x%02xff', r, g, b) AS hex, round((p_partkey % 256) / 255.0::DOUBLE, 9) AS red FROM (SELECT p_partkey, {_R} AS r, {_G} AS g, {_B} AS b FROM part)")
def color_forms(spark, d):
    def row(k):
        text = "#" + "".join(f"{int(k) * m % 256:02x}" for m in (1, 7, 13))
        return int(k), *color.color_to_ints(text)[:3], color.color_to_hex_string(text), round(color.color_to_floats(text)[0], 9)

    return _each(spark.read.parquet(f"{d}/part.parquet").select("p_partkey"), row, "p_partkey long, r int, g int, b int, hex string, red double")


_LINEAR = "CASE WHEN c <= 0.04045 THEN c / 12.92 ELSE power((c + 0.055) / 1.055, 2.4) END"


@query("color_linear", f" SELECT p_partkey, round({_LINEAR}, 9) AS linear, round(c, 6) AS again FROM (SELECT p_partkey, (p_partkey % 997) / 996.0::DOUBLE AS c FROM part)")
def color_linear(spark, d):
    def row(k):
        linear = color.srgb_to_linear((int(k) % 997) / 996)
        return int(k), round(float(linear), 9), round(float(color.linear_to_srgb(linear)), 6)

    return _each(spark.read.parquet(f"{d}/part.parquet").select("p_partkey"), row, "p_partkey long, linear double, again double")


def _rows(array: np.ndarray, digits: int = 6) -> list[tuple]:
    return [(i, *(round(float(v), digits) + 0.0 for v in r)) for i, r in enumerate(array)]


def _lab_sql(r: str, g: str, b: str, source: str) -> str:
    """L, a and b of three columns, by the standard's formulas."""
    m, w = color.RGB_TO_XYZ, color.WHITE
    linear = [f"(CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE power(({c} + 0.055) / 1.055, 2.4) END)" for c in (r, g, b)]
    xyz = [" + ".join(f"{m[i, j]!r}::DOUBLE * {linear[j]}" for j in range(3)) for i in range(3)]
    xyz = ", ".join(f"({x}) / {w[i]!r}::DOUBLE AS x{i}".replace("np.float64(", "(") for i, x in enumerate(xyz)).replace("np.float64(", "(")
    f = [f"(CASE WHEN x{i} > power(6 / 29.0::DOUBLE, 3) THEN cbrt(x{i}) ELSE x{i} / (3 * power(6 / 29.0::DOUBLE, 2)) + 4 / 29.0::DOUBLE END)" for i in range(3)]
    return f"SELECT k, 116 * {f[1]} - 16 AS l, 500 * ({f[0]} - {f[1]}) AS a, 200 * ({f[1]} - {f[2]}) AS b FROM (SELECT k, {xyz} FROM ({source}))"


@query("color_lab", " SELECT k::INT AS step, round(l, 6) AS l, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b FROM (" + _lab_sql("r", "g", "b", "SELECT k, (k % 6) / 5.0::DOUBLE AS r, (k // 6 % 6) / 5.0::DOUBLE AS g, (k // 36) / 5.0::DOUBLE AS b FROM (SELECT unnest(range(216)) AS k)") + ")")
def color_lab(spark, d):
    k = np.arange(216)
    return spark.createDataFrame(_rows(color.srgb_to_lab(np.stack((k % 6, k // 6 % 6, k // 36), 1) / 5)), "step int, l double, a double, b double")


@query(
    "color_gradient",
    " SELECT k::INT AS step, round(g.l, 4) AS l, round(g.a, 4) + 0.0 AS a, round(g.b, 4) + 0.0 AS b, round(1 - k / 20.0::DOUBLE * 0.5, 6) AS alpha FROM (SELECT s.k, x.l * (1 - s.k / 20.0::DOUBLE) + y.l * s.k / 20 AS l, x.a * (1 - s.k / 20.0::DOUBLE) + y.a * s.k / 20 AS a, x.b * (1 - s.k / 20.0::DOUBLE) + y.b * s.k / 20 AS b FROM (SELECT unnest(range(21)) AS k) s, ("
    + _lab_sql("r", "g", "b", "SELECT 0 AS k, 51 / 255.0::DOUBLE AS r, 102 / 255.0::DOUBLE AS g, 102 / 255.0::DOUBLE AS b") + ") x, ("
    + _lab_sql("r", "g", "b", "SELECT 0 AS k, 153 / 255.0::DOUBLE AS r, 136 / 255.0::DOUBLE AS g, 119 / 255.0::DOUBLE AS b") + ") y) g",
)
def color_gradient(spark, d):
    """Made in RGB, and looked at in Lab, where it is straight."""
    made = color.gradient("#336666ff", (*color.color_to_floats("#998877")[:3], 0.5), 21)
    return spark.createDataFrame([(i, *(round(float(v), 4) + 0.0 for v in color.srgb_to_lab(r[:3])), round(float(r[3]), 6)) for i, r in enumerate(made)], "step int, l double, a double, b double, alpha double")


@query("colormap_operations", " SELECT k::INT AS step, (255 - k)::INT AS flipped, ((k + 246) % 256)::INT AS rolled, (CASE WHEN k < 128 THEN 2 * k ELSE 255 - 2 * (k - 128) END)::INT AS repeated, (128 - k % 129)::INT AS off_half, least(128 + k % 129, 255)::INT AS on_half FROM (SELECT unnest(range(256)) AS k)")
def colormap_operations(spark, d):
    b = lambda m: m.bytes()[:, 0]
    off, on = Colormap.from_rgb_table("wide", "diverging", np.repeat(np.minimum(np.arange(257), 255)[:, None] / 255, 3, 1)).halves()
    rows = [(k, int(b(STEPS.flipped())[k]), int(b(STEPS.rolled(10))[k]), int(b(STEPS.repeated(2, flip_odd=True))[2 * k]), int(off[k % 129][0]), int(on[k % 129][0])) for k in range(256)]
    return spark.createDataFrame(rows, "step int, flipped int, rolled int, repeated int, off_half int, on_half int")


def _seen_sql() -> str:
    """Reds, greens and blues as a dichromat sees them, in linear light."""
    parts = []
    for kind, m in color.DICHROMACY.items():
        linear = [f"(CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE power(({c} + 0.055) / 1.055, 2.4) END)" for c in "rgb"]
        seen = [" + ".join(f"{v!r}::DOUBLE * {x}" for v, x in zip(row, linear, strict=True)) for row in m]
        encoded = [f"round(greatest(0, least(1, CASE WHEN {x} <= 0.0031308 THEN ({x}) * 12.92 ELSE 1.055 * power(greatest({x}, 0.0031308), 1 / 2.4::DOUBLE) - 0.055 END)), 6) + 0.0 AS {c}" for x, c in zip(seen, "rgb", strict=True)]
        parts.append(f"SELECT '{kind}' AS kind, k::INT AS step, {', '.join(encoded)} FROM g")
    return " , g AS (SELECT k, (k % 6) / 5.0::DOUBLE AS r, (k // 6 % 6) / 5.0::DOUBLE AS g, (k // 36) / 5.0::DOUBLE AS b FROM (SELECT unnest(range(216)) AS k)) " + " UNION ALL ".join(parts)


@query("colorblindness", _seen_sql())
def colorblindness(spark, d):
    k = np.arange(216)
    grid = Colormap.from_rgb_table("grid", "sequential", np.stack((k % 6, k // 6 % 6, k // 36), 1) / 5)
    rows = [(kind, *r[:4]) for kind in color.DICHROMACY for r in _rows(grid.colorblindness_simulation(kind).rgba)]
    return spark.createDataFrame(rows, "kind string, step int, r double, g double, b double")


@query("colormap_kinds", " SELECT * FROM (VALUES ('cyclic', 5::BIGINT, 5::BIGINT, 256::BIGINT), ('diverging', 11, 11, 257), ('sequential', 22, 22, 256)) v(kind, maps, names, steps)")
def colormap_kinds(spark, d):
    rows = [(m.kind, n, len(m.rgba), m.bytes().tobytes()) for n, m in color.catalogue().items()]
    made = spark.createDataFrame(rows, "kind string, name string, steps long, bytes binary")
    return made.groupBy("kind").agg(F.countDistinct("bytes").alias("maps"), F.countDistinct("name").alias("names"), F.max("steps").alias("steps"))


@query("hamming_weights", " SELECT n::INT AS n, k::INT AS k, round(0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * k / (n - 1)), 9) AS weight FROM (SELECT unnest([5, 21, 100]) AS n), (SELECT unnest(range(100)) AS k) WHERE k < n UNION ALL SELECT 1, 0, 1.0")
def hamming_weights(spark, d):
    return spark.createDataFrame([(n, k, round(w, 9)) for n in (1, 5, 21, 100) for k, w in enumerate(summary.hamming(n))], "n int, k int, weight double")


# -- images: a byte of each image is a function of its frame, row, column and channel


def _values(images: DataFrame, names: str = "frame, t") -> DataFrame:
    """A row for each byte: ``frame, t, place, value``."""

    def run(batches):
        for pdf in batches:
            for k, t, p in zip(pdf["frame"], pdf["t"], pdf["pixels"], strict=True):
                value = np.frombuffer(p, np.uint8)
                yield type(pdf)({"frame": k, "t": t, "place": np.arange(len(value)), "value": value.astype(np.int32)})

    return images.select("frame", "t", "pixels").mapInPandas(run, "frame long, t long, place int, value int")


def _made(k: int) -> np.ndarray:
    place = np.arange(WIDTH * HEIGHT * 4).reshape(HEIGHT, WIDTH, 4)
    return (place * 7 + k * 31) % 256


_IMAGES = f""", m AS (SELECT k AS frame, place::INT AS place, ((place * 7 + k * 31) % 256)::INT AS value, place % 4 AS c, place // 4 % {WIDTH} AS x, place // {4 * WIDTH} AS y
    FROM (SELECT unnest(range(6)) AS k), (SELECT unnest(range({WIDTH * HEIGHT * 4})) AS place))"""
_TIMES = "1000 + CAST(round_even(frame * 1000000 / 30.0::DOUBLE, 0) AS BIGINT) AS t"


def images(spark: SparkSession) -> ImageStream:
    return ImageStream(frames.frames_from_list(spark, 1000, 30.0, [_made(k).astype(np.uint8) for k in range(6)]), WIDTH, HEIGHT, 30.0)


@query("frames_from_list", _IMAGES + f" SELECT frame, {_TIMES}, place, value FROM m")
def frames_from_list(spark, d):
    return _values(images(spark).df)


@query("frames_from_function", f" SELECT k AS frame, 1000 + CAST(round_even((k + 1) * 1000000 / 30.0::DOUBLE, 0) AS BIGINT) AS t, place::INT AS place, ((1000 + CAST(round_even((k + 1) * 1000000 / 30.0::DOUBLE, 0) AS BIGINT) + place) % 251)::INT AS value FROM (SELECT unnest(range(6)) AS k), (SELECT unnest(range({WIDTH * HEIGHT * 4})) AS place)")
def frames_from_function(spark, d):
    n = WIDTH * HEIGHT * 4
    return _values(frames.frames_from_function(spark, 1000, 30.0, 6, lambda t: ((np.arange(n) + t) % 251).astype(np.uint8)))


@query("frame_map", _IMAGES + f" SELECT frame, {_TIMES}, place, (255 - value)::INT AS value FROM m")
def frame_map(spark, d):
    return _values(images(spark).map(lambda image, t: 255 - image).df)


@query(
    "frame_overlay",
    _IMAGES + f""", o AS (SELECT m.*, CASE c WHEN 0 THEN 200 WHEN 1 THEN 100 WHEN 2 THEN 50 ELSE 128 END AS top, x BETWEEN 3 AND 7 AND y BETWEEN 2 AND 5 AS inside,
    max(CASE WHEN c = 3 THEN value END) OVER (PARTITION BY frame, x, y) AS alpha FROM m), q AS (SELECT *, 128 * 255 + alpha * 127 AS total FROM o)
    SELECT frame, {_TIMES}, place, (CASE WHEN NOT inside THEN value WHEN c = 3 THEN total // 255 ELSE (top * 128 * 255 + value * alpha * 127) // greatest(total, 1) END)::INT AS value FROM q""",
)
def frame_overlay(spark, d):
    patch = np.tile(np.array([200, 100, 50, 128], np.uint8), (4, 5, 1))
    return _values(images(spark).add_overlay(patch, 3, 2).df)


@query("frame_scale_images", _IMAGES + f" SELECT frame, {_TIMES}, ((y * 2 + dy) * {8 * WIDTH} + (x * 2 + dx) * 4 + c)::INT AS place, value FROM m, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy)")
def frame_scale_images(spark, d):
    return _values(images(spark).scale(2).df)


@query(
    "frame_scale_triangle",
    _IMAGES + f""", s AS (SELECT unnest(range({2 * WIDTH})) AS i), px AS (SELECT i AS x2, x, greatest(0, 1 - abs((i + 0.5::DOUBLE) / 2 - 0.5 - x)) AS w FROM s, (SELECT unnest(range({WIDTH})) AS x)), wx AS (SELECT x2, x, w / sum(w) OVER (PARTITION BY x2) AS w FROM px WHERE w > 0),
    py AS (SELECT i AS y2, y, greatest(0, 1 - abs((i + 0.5::DOUBLE) / 2 - 0.5 - y)) AS w FROM s, (SELECT unnest(range({HEIGHT})) AS y) WHERE i < {2 * HEIGHT}), wy AS (SELECT y2, y, w / sum(w) OVER (PARTITION BY y2) AS w FROM py WHERE w > 0)
    SELECT frame, {_TIMES}, (y2 * {8 * WIDTH} + x2 * 4 + c)::INT AS place, CAST(floor(sum(value * wx.w * wy.w) + 0.5) AS INT) AS value FROM m JOIN wx ON m.x = wx.x JOIN wy ON m.y = wy.y GROUP BY frame, y2, x2, c""",
)
def frame_scale_triangle(spark, d):
    return _values(images(spark).scale(2, "triangle").df)


@query("frame_png_files", _IMAGES + " SELECT frame, place, value FROM m")
def frame_png_files(spark, d):
    """A PNG file for each image, read back."""
    folder = workspace(spark, "png")
    assert images(spark).to_files(f"{folder}/{{index}}.png") == 6

    def run(batches):
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                value = frames.from_png(data).ravel()
                yield type(pdf)({"frame": int(path.rsplit("/", 1)[1][:-4]), "place": np.arange(len(value)), "value": value.astype(np.int32)})

    return spark.read.format("binaryFile").load(f"file://{folder}").select("path", "content").mapInPandas(run, "frame long, place int, value int")


@query("frame_gif_file", f""", i AS (SELECT k AS frame, x, y, c, ((x + y * {WIDTH} + k * 3) % 200)::INT AS value FROM (SELECT unnest(range(6)) AS k), (SELECT unnest(range({WIDTH})) AS x), (SELECT unnest(range({HEIGHT})) AS y), (SELECT unnest(range(3)) AS c)),
    p AS (SELECT frame - 1 AS turn, frame FROM (SELECT unnest(range(1, 6)) AS frame) UNION ALL SELECT 9 - frame, frame FROM (SELECT unnest(range(2, 5)) AS frame))
    SELECT turn, ((y * {WIDTH} + x) * 3 + c)::INT AS place, value FROM p JOIN i ON p.frame = i.frame""")
def frame_gif_file(spark, d):
    """An animation that skips one image and plays back, read again."""
    path = workspace(spark, "gif") + "/images.gif"
    place = np.arange(WIDTH * HEIGHT).reshape(HEIGHT, WIDTH)
    grey = [np.repeat(((place + 3 * k) % 200)[..., None], 4, 2).astype(np.uint8) for k in range(6)]
    assert ImageStream(frames.frames_from_list(spark, 0, 30.0, grey), WIDTH, HEIGHT, 30.0).to_file(path, 25.0, skip=1, rewind=True) == 8
    with open(path, "rb") as f:
        found = animation.read_gif(f.read())
    return spark.createDataFrame([(k, i, int(v)) for k, image in enumerate(found) for i, v in enumerate(image.ravel())], "turn long, place int, value int")


@query("frame_annotate", f" SELECT frame, {_TIMES}, ((8 * 4 + 8) * 2)::BIGINT AS painted FROM (SELECT unnest(range(6)) AS frame)")
def frame_annotate(spark, d):
    """Letters drawn into black images: how many bytes are painted. An F has eight squares, here of two by two pixels and of one, with two full channels each."""
    black = ImageStream(frames.frames_from_list(spark, 1000, 30.0, [np.zeros((HEIGHT, WIDTH, 4), np.uint8)] * 6), WIDTH, HEIGHT, 30.0)
    text = _values(black.annotate("F", 1, 1, 10, "#ff0000").annotate("F", 12, 1, 5, "#00ff00").df)
    return text.groupBy("frame", "t").agg(F.sum((F.col("value") == 255).cast("long")).alias("painted"))


@query("frame_dense_content", _LAST + f""", g AS (SELECT frame, t, x, y FROM lab, (SELECT unnest(range({WIDTH})) AS x), (SELECT unnest(range({HEIGHT})) AS y)),
    w AS (SELECT g.frame, g.t, g.x, g.y, coalesce(round(255 * exp(-(v.t - v.t_last)::DOUBLE / {TAU}), 0), 0)::INT AS idx FROM g LEFT JOIN v ON g.frame = v.frame AND g.x = v.x AND g.y = v.y)
    SELECT frame, t, ((y * {WIDTH} + x) * 4 + c)::INT AS place, CASE WHEN c = 3 THEN 255 ELSE idx END AS value FROM w, (SELECT unnest(range(4)) AS c)""")
def frame_dense_content(spark, d):
    return _values(stream(spark, d).regularize(DAILY).render("exponential", TAU, STEPS).dense())


@query("frame_blank", f" SELECT frame, 1000000 + CAST(round_even((frame + 1) * 1e6::DOUBLE / 50, 0) AS BIGINT) AS t, place::INT AS place, CASE WHEN place % 4 = 3 OR (frame >= 2 AND place < 3) THEN 255 ELSE 0 END AS value FROM (SELECT unnest(range(3)) AS frame), (SELECT unnest(range(8)) AS place)")
def frame_blank(spark, d):
    """Frames before the first event are there, too."""
    from eventloom.model import events_stream_from_array

    one = events_stream_from_array(spark, np.array([(1_050_000, 0, 0, True)], [("t", "<u8"), ("x", "<u2"), ("y", "<u2"), ("on", "?")]), (2, 1))
    late = one.time_slice(0, 1_080_000).regularize(50.0, start=1_000_000)
    return _values(late.render("window", 1_000_000, STEPS).dense())


@query("kinectograph_image", f""", p AS (SELECT x, y, sum(t - t0) / count(*) * (1.0::DOUBLE / any_value(t1 - t0 - 1)) AS late, count(*) AS n FROM l, rl GROUP BY x, y), q AS (SELECT quantile_cont(n, 0.9) AS q FROM p),
    k AS (SELECT x, y, round_even(late * 255, 0)::INT AS v, least(1.0, n / q) AS opacity FROM p, q)
    SELECT x, y, v AS r, CAST(floor(opacity * 255 + 0.5) AS INT) AS a FROM k""")
def kinectograph_image(spark, d):
    image = plots.kinectograph_image(line_stream(spark, d).to_kinectograph(), WIDTH, HEIGHT, STEPS)
    ys, xs = np.nonzero(image[..., 3])
    return spark.createDataFrame([(int(x), int(y), int(image[y, x, 0]), int(image[y, x, 3])) for y, x in zip(ys, xs, strict=True)], "x int, y int, r int, a int")
