"""The engine's queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import timecode
from eventloom.functions.color import Colormap
from eventloom.model import EventStream
from eventloom.operators import frames, summary
from eventloom.operators.spatial import TRANSPOSES
from eventloom.plans import adapter
from eventloom.plans.adapter import EVENTS_SQL, HEIGHT, LINES_SQL, WIDTH

HOUR, DAY = 3_600_000_000, 86_400_000_000
HOURLY, DAILY = 1 / 3600, 1 / 86400
#: Frequencies whose periods aren't whole microseconds.
ODD_HZ = 7e-5
TAU = 6 * HOUR
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH e AS ({EVENTS_SQL}), l AS ({LINES_SQL}), r AS (SELECT arg_min(t, seq) AS t0, arg_max(t, seq) + 1 AS t1 FROM e), rl AS (SELECT arg_min(t, seq) AS t0, arg_max(t, seq) + 1 AS t1 FROM l){sql}"
        return f

    return add


def stream(spark, d) -> EventStream:
    return EventStream(adapter.events(spark, d), WIDTH, HEIGHT)


def line_stream(spark, d) -> EventStream:
    return EventStream(adapter.lines(spark, d), WIDTH, HEIGHT)


ALL = 'seq, t, x, y, "on"'


def packet_sql(t: str, t0: str, period: str) -> str:
    """The packet of a time by its definition: the last boundary at or before it."""
    k = f"CAST(floor(({t} - {t0})::DOUBLE / {period}) AS BIGINT)"
    return f"(CASE WHEN ({t} - {t0}) >= round_even(({k} + 1) * {period}, 0) THEN {k} + 1 WHEN ({t} - {t0}) < round_even({k} * {period}, 0) THEN {k} - 1 ELSE {k} END)"


@query(
    "crop_regularize_counts",
    f""", c AS (SELECT {packet_sql("t", "t0", "3600000000.0::DOUBLE")} AS packet, "on" FROM e, r WHERE x >= 2 AND x < 10 AND y >= 1 AND y < 9),
    n AS (SELECT CAST(ceil((t1 - t0) / 3600000000.0) AS BIGINT) AS n FROM r), s AS (SELECT unnest(range(n)) AS packet FROM n)
    SELECT s.packet, count(c.packet) AS events, coalesce(sum(c."on"::INT), 0)::BIGINT AS on_events FROM s LEFT JOIN c ON s.packet = c.packet GROUP BY s.packet""",
)
def crop_regularize_counts(spark, d):
    return stream(spark, d).crop(2, 10, 1, 9).regularize(HOURLY).counts()


@query("remove_on_events", f' SELECT {ALL} FROM e WHERE NOT "on"')
def remove_on_events(spark, d):
    return stream(spark, d).remove_on_events().df


@query("remove_off_events", f' SELECT {ALL} FROM e WHERE "on"')
def remove_off_events(spark, d):
    return stream(spark, d).remove_off_events().df


@query("crop", ' SELECT seq, t, x - 3 AS x, y - 2 AS y, "on" FROM e WHERE x >= 3 AND x < 12 AND y >= 2 AND y < 11')
def crop(spark, d):
    return stream(spark, d).crop(3, 12, 2, 11).df


@query("mask", f" SELECT {ALL} FROM e WHERE (x * 7 + y * 3) % 5 < 2")
def mask(spark, d):
    y, x = np.indices((HEIGHT, WIDTH))
    return stream(spark, d).mask((x * 7 + y * 3) % 5 < 2).df


#: x' and y' of each action for the adapter's grid.
TURNED = {"flip_left_right": ("15 - x", "y"), "flip_bottom_top": ("x", "11 - y"), "rotate_90_counterclockwise": ("11 - y", "x"), "rotate_180": ("15 - x", "11 - y"), "rotate_270_counterclockwise": ("y", "15 - x"), "flip_up_diagonal": ("y", "x"), "flip_down_diagonal": ("11 - y", "15 - x")}


def _transpose(action: str):
    return lambda spark, d: stream(spark, d).transpose(action).df


for _action in TRANSPOSES:
    query(f"transpose_{_action}", f' SELECT seq, t, {TURNED[_action][0]} AS x, {TURNED[_action][1]} AS y, "on" FROM e')(_transpose(_action))


@query("time_slice", f" SELECT {ALL} FROM e WHERE t >= {5 * DAY} AND t < {9 * DAY}")
def time_slice(spark, d):
    return stream(spark, d).time_slice(5 * DAY, 9 * DAY).df


@query("time_slice_zero", f' SELECT seq, t - {5 * DAY} AS t, x, y, "on" FROM e WHERE t >= {5 * DAY} AND t < {9 * DAY}')
def time_slice_zero(spark, d):
    return stream(spark, d).time_slice("120:00:00", "216:00:00", zero=True).df


@query("regularize_packets", f' SELECT seq, t, x, y, "on", {packet_sql("t", "t0", f"{1e6 / ODD_HZ!r}::DOUBLE")} AS packet FROM e, r')
def regularize_packets(spark, d):
    return stream(spark, d).regularize(ODD_HZ).df


@query("regularize_from_start", f' SELECT seq, t, x, y, "on", {packet_sql("t", str(DAY), "86400000000.0::DOUBLE")} AS packet FROM l WHERE t >= {DAY}')
def regularize_from_start(spark, d):
    return line_stream(spark, d).regularize(DAILY, start=DAY).df


@query("packet_slice", f' SELECT seq, t, x, y, "on", p - 10 AS packet FROM (SELECT *, {packet_sql("t", "t0", "3600000000.0::DOUBLE")} AS p FROM e, r) WHERE p >= 10 AND p < 50')
def packet_slice(spark, d):
    return stream(spark, d).regularize(HOURLY).packet_slice(10, 50).df


@query("packet_slice_zero", f' SELECT seq, t - CAST(trunc(t0 + 10 * 3600000000.0) AS BIGINT) AS t, x, y, "on", p - 10 AS packet FROM (SELECT *, {packet_sql("t", "t0", "3600000000.0::DOUBLE")} AS p FROM e, r) WHERE p >= 10 AND p < 50')
def packet_slice_zero(spark, d):
    return stream(spark, d).regularize(HOURLY).packet_slice(10, 50, zero=True).df


@query("event_slice", f' SELECT {ALL} FROM (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS i FROM e WHERE "on") WHERE i >= 100 AND i < 700')
def event_slice(spark, d):
    return stream(spark, d).remove_off_events().event_slice(100, 700).df


@query("chunks", ' SELECT seq, t, x, y, "on", (row_number() OVER (ORDER BY seq) - 1) // 333 AS packet FROM l')
def chunks(spark, d):
    return line_stream(spark, d).chunks(333).df


@query("map_events", ' SELECT seq, t + 5 AS t, x, y, "on" FROM e')
def map_events(spark, d):
    import pyarrow.compute as pc

    return stream(spark, d).map(lambda b: b.set_column(1, "t", pc.add(b.column("t"), 5))).df


@query("apply_filter", f" SELECT {ALL} FROM e WHERE x + y < 9")
def apply_filter(spark, d):
    return stream(spark, d).apply(lambda df: df.where("x + y < 9")).df


def _arbiter_sql(table: str, line: str, threshold: int) -> str:
    return f""", a AS (SELECT *, CASE WHEN lag({line}) OVER (ORDER BY seq) = {line} THEN 0 ELSE 1 END AS b FROM {table}), g AS (SELECT *, sum(b) OVER (ORDER BY seq) AS run FROM a),
    n AS (SELECT *, count(*) OVER (PARTITION BY run) AS n, max(run) OVER () AS last FROM g) SELECT {ALL} FROM n WHERE n <= {threshold} AND run < last"""


@query("arbiter_rows", _arbiter_sql("e", "y", 2))
def arbiter_rows(spark, d):
    return stream(spark, d).filter_arbiter_saturation_lines(2 / 16).df


@query("arbiter_columns_ties", _arbiter_sql("l", "x", 1))
def arbiter_columns_ties(spark, d):
    return line_stream(spark, d).filter_arbiter_saturation_lines(1 / 12, "column").df


def _hot_sql(source: str, ratio: float, columns: str) -> str:
    return f""", p AS ({source}), c AS (SELECT packet, x, y, count(*) + 1 AS c FROM p GROUP BY ALL),
    m AS (SELECT a.packet, a.x, a.y, a.c, coalesce(max(b.c), 1) AS m FROM c a LEFT JOIN c b ON a.packet = b.packet AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY ALL)
    SELECT {columns} FROM p JOIN m ON p.packet = m.packet AND p.x = m.x AND p.y = m.y WHERE m.c < {ratio} * m.m"""


@query("hot_pixels", _hot_sql("SELECT *, 0 AS packet FROM l", 1.05, 'seq, t, p.x, p.y, "on"'))
def hot_pixels(spark, d):
    return line_stream(spark, d).filter_hot_pixels(1.05).df


@query("hot_pixels_by_packet", _hot_sql(f'SELECT seq, t, x, y, "on", {packet_sql("t", "t0", "86400000000.0::DOUBLE")} AS packet FROM e, r', 1.5, 'seq, t, p.x, p.y, "on", p.packet'))
def hot_pixels_by_packet(spark, d):
    return stream(spark, d).regularize(DAILY).filter_hot_pixels(1.5).df


_RATE = """, k AS (SELECT unnest(range(1600)) AS i), w AS (SELECT i, floor(i::DOUBLE / (1600 / (t1 - t0))) AS a, floor((i + 1)::DOUBLE / (1600 / (t1 - t0))) AS z, t0 FROM k, r),
    n AS (SELECT CAST(floor((t - t0)::DOUBLE * (1600 / (t1 - t0))) AS BIGINT) AS i, count(*) AS n FROM e, r GROUP BY ALL),
    q AS (SELECT w.i AS bucket, CAST(a AS BIGINT) + t0 AS t, coalesce(n, 0) / CASE WHEN z > a THEN (z - a) / 1e6 ELSE 1.0 END AS rate FROM w LEFT JOIN n ON w.i = n.i)"""


@query("event_rate", _RATE + " SELECT bucket, t, round(rate, 9) AS rate FROM q")
def event_rate(spark, d):
    return stream(spark, d).to_event_rate().withColumn("rate", F.round("rate", 9))


@query(
    "event_rate_smoothed",
    _RATE + """, h AS (SELECT unnest([0.25, 0.5, 0.25]::DOUBLE[]) AS w, unnest([-1, 0, 1]) AS o)
    SELECT q.bucket, q.t, round(sum(h.w * b.rate), 9) AS smooth FROM q, h JOIN q b ON b.bucket = greatest(0, least(1599, q.bucket + h.o)) GROUP BY q.bucket, q.t""",
)
def event_rate_smoothed(spark, d):
    rates = stream(spark, d).to_event_rate()
    return summary.smoothed(rates, [1.0, 2.0, 1.0]).select("bucket", "t", F.round("smooth", 9).alias("smooth"))


@query(
    "kinectograph",
    """, p AS (SELECT x, y, sum(t - t0) / count(*) AS late, count(*) AS n, any_value(t1 - t0 - 1) AS span FROM l, rl GROUP BY x, y), q AS (SELECT quantile_cont(n, 0.9) AS q FROM p)
    SELECT x, y, round(late * (1.0::DOUBLE / span), 9) AS mean_time, round(least(1.0, n / q), 9) AS opacity FROM p, q""",
)
def kinectograph(spark, d):
    return line_stream(spark, d).to_kinectograph().select("x", "y", F.round("mean_time", 9).alias("mean_time"), F.round("opacity", 9).alias("opacity"))


@query("time_range", " SELECT t0, t1 FROM r")
def time_range(spark, d):
    df = adapter.events(spark, d)
    return df.agg(F.min_by("t", "seq").alias("t0"), (F.max_by("t", "seq") + 1).alias("t1"))


@query("wiggle_frames", f", g AS (SELECT t0, t1, 51 * 1e6::DOUBLE / (t1 - t0) AS hz FROM r) SELECT {packet_sql('t', 't0', '(1e6::DOUBLE / hz)')} AS packet, count(*) AS events FROM e, g GROUP BY 1")
def wiggle_frames(spark, d):
    s = stream(spark, d)
    w = summary.Wiggle.of(*s.time_range())
    return s.regularize(w.frequency_hz).df.groupBy("packet").agg(F.count("*").alias("events"))


# -- rendering: 256 steps for sequential maps, 129 for each half of signed ones

GREY = Colormap.sequential_from_pair("grey", "#000000", "#ffffff")
STEPS = Colormap.from_rgb_table("steps", "sequential", np.repeat(np.arange(256)[:, None] / 255, 3, 1))
SIGNED = Colormap.diverging_from_triplet("signed", "#0000ff", "#000000", "#ff0000")
_FRAMES = """, p AS (SELECT *, PACKET AS packet FROM e, r), n AS (SELECT CAST(ceil((t1 - t0) / 86400000000.0) AS BIGINT) AS n FROM r),
    f AS (SELECT unnest(range(n)) AS frame FROM n), lab AS (SELECT frame, t0 + CAST(round_even((frame + 1) * 86400000000.0::DOUBLE, 0) AS BIGINT) AS t FROM f, r)""".replace("PACKET", packet_sql("t", "t0", "86400000000.0::DOUBLE"))
_LAST = _FRAMES + """, v AS (SELECT frame, lab.t AS t, x, y, arg_max(p.t, seq) AS t_last, arg_max("on", seq) AS on_last FROM lab JOIN p ON p.packet <= lab.frame GROUP BY ALL)"""
_SUMS = _FRAMES + f""", a AS (SELECT frame, lab.t AS t, x, y, sum(CASE WHEN "on" THEN 0 ELSE exp(-(lab.t - p.t) / {TAU}.0::DOUBLE) END) AS off_sum,
    sum(CASE WHEN "on" THEN exp(-(lab.t - p.t) / {TAU}.0::DOUBLE) ELSE 0 END) AS on_sum FROM lab JOIN p ON p.packet <= lab.frame GROUP BY ALL)"""
_HALF = "CASE WHEN on_last THEN 1 ELSE -1 END"


def _rendered(decay: str, colormap: Colormap, **more):
    def run(spark, d):
        out = stream(spark, d).regularize(DAILY).render(decay, TAU, colormap, **more).pixels
        return out.select("frame", "t", "x", "y", "half", "idx", F.round("value", 6).alias("value"))

    return run


def _shown(idx: str, value: str, half: str, source: str = _LAST) -> str:
    return source + f" SELECT frame, t, x, y, {half} AS half, CAST({idx} AS INTEGER) AS idx, round({value}, 6) AS value FROM v"


for _name, _map, _n, _half in (("sequential", GREY, 255, "0"), ("diverging", SIGNED, 128, _HALF)):
    _age = "(t - t_last)::DOUBLE"
    query(f"render_exponential_{_name}", _shown(f"round({_n} * exp(-{_age} / {TAU}), 0)", f"exp(-{_age} / {TAU})", _half))(_rendered("exponential", _map))
    query(f"render_linear_{_name}", _shown(f"{_n} - least(floor({_age} * {_n} / {2 * TAU}.0::DOUBLE), {_n})", f"greatest(0.0::DOUBLE, 1 - {_age} / {2 * TAU})", _half))(_rendered("linear", _map))
    query(f"render_window_{_name}", _shown(f"CASE WHEN {_age} <= {TAU} THEN {_n} ELSE 0 END", f"CASE WHEN {_age} <= {TAU} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", _half))(_rendered("window", _map))


def _cumulative(source: str, n: int, low: str, gamma: float, high: float = 0.99, base: str | None = None) -> str:
    curve = f"round(u * {n}, 0)"
    if gamma:
        rho = 2 + gamma * gamma if gamma < 0 else -2 - gamma * gamma
        sigma = (rho * rho - 4) ** 0.5
        curve = f"round(u / (u * {2 * sigma / (n * (rho + sigma))!r}::DOUBLE + {(rho - sigma) / (n * (rho + sigma))!r}::DOUBLE), 0)"
    return (base or _SUMS) + f""", s AS ({source}), k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY frame) AS n FROM s WHERE v > 0),
    c0 AS (SELECT frame, {low} AS a, max(v) FILTER (WHERE i = round((n - 1) * {high}::DOUBLE, 0)) AS b, min(v) AS least, max(v) AS most FROM k GROUP BY frame),
    c AS (SELECT frame, CASE WHEN a < b THEN a ELSE least END AS lo, CASE WHEN a < b THEN b WHEN least < most THEN most ELSE least + 1 END AS hi FROM c0),
    w AS (SELECT s.*, coalesce((least(greatest(v, lo), hi) - lo) / (hi - lo), 0) AS u FROM s LEFT JOIN c ON s.frame = c.frame)
    SELECT frame, t, x, y, half, CAST(greatest(0, least({n}, {curve})) AS INTEGER) AS idx, round(v, 6) AS value FROM w"""


_BOTH = "SELECT frame, t, x, y, off_sum + on_sum AS v, 0 AS half FROM a"
_SIDES = "SELECT frame, t, x, y, greatest(off_sum, on_sum) AS v, CASE WHEN on_sum > off_sum THEN 1 ELSE -1 END AS half FROM a"
query("render_cumulative_sequential", _cumulative(_BOTH, 255, "0.0::DOUBLE", 0))(_rendered("cumulative", GREY))
query("render_cumulative_diverging", _cumulative(_SIDES, 128, "0.0::DOUBLE", 0))(_rendered("cumulative", SIGNED))
query("render_cumulative_gamma_clip", _cumulative(_BOTH, 255, "max(v) FILTER (WHERE i = round((n - 1) * 0.1::DOUBLE, 0))", 1.5))(_rendered("cumulative", GREY, minimum_clip=0.1, gamma=1.5))
_LOW = "max(v) FILTER (WHERE i = round((n - 1) * {}::DOUBLE, 0))"
query("render_cumulative_diverging_clip", _cumulative(_SIDES, 128, _LOW.format(0.2), 0, 0.7))(_rendered("cumulative", SIGNED, minimum_clip=0.2, maximum_clip=0.7))

#: One pixel by day 2, two until day 4 and all from then on: clips coincide in the first frames.
_FEW = "((t < 2 * 86400000000 AND x = 3 AND y = 4) OR (t >= 2 * 86400000000 AND t < 4 * 86400000000 AND x IN (3, 9) AND y = 4) OR t >= 4 * 86400000000)"


@query("render_cumulative_clip_degenerate", _cumulative(_BOTH, 255, _LOW.format(0.6), 0, 0.65, _SUMS.replace("FROM e, r)", f"FROM e, r WHERE {_FEW})", 1)))
def render_cumulative_clip_degenerate(spark, d):
    s = stream(spark, d)
    out = s.apply(lambda df: df.where(_FEW)).regularize(DAILY, start=s.time_range()[0]).render("cumulative", TAU, GREY, minimum_clip=0.6, maximum_clip=0.65).pixels
    return out.select("frame", "t", "x", "y", "half", "idx", F.round("value", 6).alias("value"))


@query("render_colors", _LAST + f", q AS (SELECT frame, t, x, y, CAST(round(255 * exp(-(t - t_last)::DOUBLE / {TAU}), 0) AS INTEGER) AS idx FROM v) SELECT frame, t, x, y, idx, idx AS r, idx AS g, idx AS b, 255 AS a FROM q")
def render_colors(spark, d):
    """On a map whose colours are the greys of their steps."""
    return stream(spark, d).regularize(DAILY).render("exponential", TAU, STEPS).colored().select("frame", "t", "x", "y", "idx", "r", "g", "b", "a")


@query("frame_scale", _LAST + f" SELECT frame, x * 2 + dx AS x, y * 2 + dy AS y, CASE WHEN (t - t_last)::DOUBLE <= {TAU} THEN 255 ELSE 0 END AS idx FROM v, (SELECT unnest([0, 1]) AS dx), (SELECT unnest([0, 1]) AS dy)")
def frame_scale(spark, d):
    return stream(spark, d).regularize(DAILY).render("window", TAU, GREY).scale(2).pixels.select("frame", "x", "y", "idx")


@query("frame_rewind", _LAST + ", q AS (SELECT frame, count(*) AS pixels FROM v WHERE frame >= 3 GROUP BY frame), m AS (SELECT max(frame) AS last FROM q) SELECT frame - 3 AS turn, frame, pixels FROM q UNION ALL SELECT 2 * (last - 3) - (frame - 3), frame, pixels FROM q, m WHERE frame > 3 AND frame < last")
def frame_rewind(spark, d):
    counts = stream(spark, d).regularize(DAILY).render("window", TAU, GREY).pixels.groupBy("frame").agg(F.count("*").alias("pixels"))
    return frames.played(counts, skip=3, rewind=True).select("turn", "frame", "pixels")


@query("frame_timecodes", _FRAMES + " SELECT frame, t, printf('%02d:%02d:%02d.%06d', t // 3600000000, t // 60000000 % 60, t // 1000000 % 60, t % 1000000) || ' (× 86400)' AS timecode FROM lab")
def frame_timecodes(spark, d):
    s = stream(spark, d).regularize(DAILY)
    from eventloom.operators.render import label

    spine = spark.range(s.packets).select(F.col("id").alias("frame"), label(F.col("id"), s.start, DAY * 1.0).alias("t"))
    return frames.add_timecode(spine, 1.0, DAILY)


@query("timecodes", " SELECT seq, printf('%02d:%02d:%02d.%06d', t // 3600000000, t // 60000000 % 60, t // 1000000 % 60, t % 1000000) AS timecode, printf('%02d-%02d-%02d.%06d', t // 3600000000, t // 60000000 % 60, t // 1000000 % 60, t % 1000000) AS dashes, t / 1e6 AS seconds, t / 1e3 AS milliseconds, t AS parsed FROM e")
def timecodes(spark, d):
    t = F.col("t")
    out = adapter.events(spark, d).select("seq", timecode.timecode_column(t).alias("timecode"), timecode.timecode_column(t, "-").alias("dashes"), timecode.seconds_column(t).alias("seconds"), timecode.milliseconds_column(t).alias("milliseconds"))
    return out.withColumn("parsed", timecode.parse_time_column(F.col("dashes")))


@query("digest")
def digest(spark, d):
    return summary.digest(adapter.events(spark, d), ["t", "x", "y", "on"])


# -- byte formats: each day's packet goes through its own file's bytes, in parallel


def _through(write: Callable, read: Callable):
    def run(spark, d):
        s = stream(spark, d).regularize(DAILY)

        def pass_through(pdf):
            import pandas as pd

            pdf = pdf.sort_values("seq")
            columns = {k: pdf[k].to_numpy() for k in ("t", "x", "y", "on")}
            data, t0 = write(columns)
            out = read(data, t0)
            return pd.DataFrame({"seq": pdf["seq"].to_numpy(), **{k: out[k] for k in ("t", "x", "y", "on")}})

        return s.df.groupBy("packet").applyInPandas(pass_through, "seq long, t long, x int, y int, on boolean")

    return run


def _codecs() -> None:
    from eventloom.sources import codecs as c

    w, h = WIDTH, HEIGHT
    for name, write, read in (
        ("dat1", lambda e: c.encode_dat(e | {"t": e["t"] // 1000}, w, h, "1"), lambda b, _: c.decode_dat(b)[1]),
        ("dat2", lambda e: c.encode_dat(e | {"t": e["t"] // 1000}, w, h, "2"), lambda b, _: c.decode_dat(b)[1]),
        ("es", lambda e: c.encode_es(e | {"t": e["t"] // 60_000_000}, w, h), lambda b, t0: c.decode_es(b, t0)[1]),
        ("evt2", lambda e: c.encode_evt(e, w, h, "2"), lambda b, _: c.decode_evt(b)[1]),
        ("evt3", lambda e: c.encode_evt(e, w, h, "3"), lambda b, _: c.decode_evt(b)[1]),
        ("aedat", lambda e: c.encode_aedat(e, w, h), lambda b, _: c.decode_aedat(b)[1]),
    ):
        # DAT counts in 32 bits and ES writes a byte for every 127, so these take coarser times.
        t = {"es": "t // 60000000 AS t", "dat1": "t // 1000 AS t", "dat2": "t // 1000 AS t"}.get(name, "t")
        query(f"codec_{name}", f' SELECT seq, {t}, x, y, "on" FROM e')(_through(write, read))


_codecs()


@query("csv_lines", f" SELECT {ALL} FROM e")
def csv_lines(spark, d):
    """Events as CSV lines, and parsed again."""
    from eventloom.sources.files import parse_csv

    lines = adapter.events(spark, d).select("seq", F.concat_ws(",", "t", "x", "y", F.col("on").cast("int")).alias("value"))
    return parse_csv(lines, WIDTH, HEIGHT)


@query("udp_wire_forms", f" SELECT {ALL} FROM e")
def udp_wire_forms(spark, d):
    """Events through datagram bytes, 100 in each."""
    from eventloom.streaming import packets

    def pass_through(pdf):
        pdf = pdf.sort_values("seq")
        out = packets.decode(packets.encode(*(pdf[k].to_numpy() for k in ("t", "x", "y", "on")), "t64_x16_y16_on8"), "t64_x16_y16_on8")
        return out.assign(seq=pdf["seq"].to_numpy())[["seq", "t", "x", "y", "on"]]

    return adapter.events(spark, d).groupBy(F.floor(F.col("seq") / 100)).applyInPandas(pass_through, "seq long, t long, x int, y int, on boolean")


@query("frame_dense_pixels", _LAST + f", f0 AS (SELECT DISTINCT frame, t FROM v) SELECT frame, t, {WIDTH * HEIGHT * 4} AS bytes FROM f0")
def frame_dense_pixels(spark, d):
    return stream(spark, d).regularize(DAILY).render("exponential", TAU, GREY).dense().select("frame", "t", F.length("pixels").alias("bytes"))
