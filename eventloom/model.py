"""An event stream: a DataFrame of (seq, t, x, y, on) with what is known about it.

A stream is finite or not, and regular (cut into packets at a fixed rate) or
not; methods that make no sense for a state raise ``TypeError``, and each
returns a new stream. Nothing runs until a sink or a summary asks for rows,
but for a missing time range, which costs one aggregation over ``t``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.color import Colormap
from eventloom.functions.timecode import Time, microseconds, to_timecode
from eventloom.operators import noise, render, spatial, summary, temporal

EVENT = "seq long, t long, x int, y int, on boolean"
When = int | str | Time


@dataclass(frozen=True, eq=False)
class EventStream:
    df: DataFrame
    width: int
    height: int
    finite: bool = True
    frequency_hz: float | None = None
    start: int | None = None
    packets: int | None = None
    range: tuple[int, int] | None = None
    #: The stream before any filter, which its range is taken from.
    whole: DataFrame | None = None

    def __post_init__(self):
        if self.whole is None:
            object.__setattr__(self, "whole", self.df)

    # -- state

    @property
    def regular(self) -> bool:
        return self.frequency_hz is not None

    def dimensions(self) -> tuple[int, int]:
        return self.width, self.height

    def _need(self, name: str, *, finite: bool | None = None, regular: bool | None = None) -> None:
        for what, need, have in (("finite", finite, self.finite), ("regular", regular, self.regular)):
            if need is not None and need != have:
                raise TypeError(f"{name} needs a stream that is {'' if need else 'not '}{what}")

    def time_range(self) -> tuple[int, int]:
        """First time, and one past the last; declared ranges are not shrunk by filters."""
        self._need("time_range", finite=True)
        if self.range is None:
            object.__setattr__(self, "range", summary.time_range(self.whole))
        return self.range

    def _irregular(self, df: DataFrame, **more) -> EventStream:
        return replace(self, df=df.drop("packet"), frequency_hz=None, start=None, packets=None, **more)

    # -- packets and slices

    def regularize(self, frequency_hz: float, start: When | None = None) -> EventStream:
        if frequency_hz <= 0:
            raise ValueError("the frequency must be positive")
        if not self.finite and start is None:
            raise TypeError("regularize needs a start for an infinite stream")
        begin = self.time_range()[0] if start is None else microseconds(start)
        df = temporal.regularize(self.df.drop("packet"), frequency_hz, begin)
        if not self.finite:
            return replace(self, df=df, frequency_hz=frequency_hz, start=begin)
        count = temporal.packet_count(begin, self.time_range()[1], frequency_hz)
        return replace(self, df=df, frequency_hz=frequency_hz, start=begin, packets=count, range=(begin, temporal.boundary(begin, count, frequency_hz)))

    def chunks(self, length: int) -> EventStream:
        if length <= 0:
            raise ValueError("chunks hold one event at least")
        return replace(self._irregular(self.df), df=temporal.chunks(self.df.drop("packet"), length))

    def time_slice(self, start: When, end: When, zero: bool = False) -> EventStream:
        self._need("time_slice", regular=False)
        a, b = microseconds(start), microseconds(end)
        if a >= b:
            raise ValueError("a slice must end after it starts")
        span = (a, b)
        if self.finite:
            lo, hi = self.time_range()
            span = (min(max(a, lo), hi - 1), max(min(b, hi), min(max(a, lo), hi - 1) + 1))
        if zero:
            span = (max(0, span[0] - a), max(1, span[1] - a))
        return replace(self, df=temporal.time_slice(self.df, a, b, zero), finite=True, range=span)

    def packet_slice(self, start: int, end: int, zero: bool = False) -> EventStream:
        self._need("packet_slice", regular=True)
        if not 0 <= start < end:
            raise ValueError("a slice must end after it starts")
        f = self.frequency_hz
        last = end if self.packets is None else min(end, self.packets)
        shift = int(self.start + temporal.period_us(f) * start) if zero else 0
        begin = temporal.boundary(self.start, start, f) - shift
        span = (begin, max(begin + 1, int(temporal.period_us(f) * (last - start)) if zero else temporal.boundary(self.start, last, f)))
        return replace(self, df=temporal.packet_slice(self.df, start, end, shift), finite=True, start=begin, packets=max(0, last - start), range=span)

    def event_slice(self, start: int, end: int) -> EventStream:
        if not 0 <= start < end:
            raise ValueError("a slice must end after it starts")
        return replace(self, df=temporal.event_slice(self.df, start, end), finite=True)

    # -- filters

    def remove_on_events(self) -> EventStream:
        return replace(self, df=spatial.remove_on(self.df))

    def remove_off_events(self) -> EventStream:
        return replace(self, df=spatial.remove_off(self.df))

    def crop(self, left: int, right: int, top: int, bottom: int) -> EventStream:
        if not (0 <= left < right <= self.width and 0 <= top < bottom <= self.height):
            raise ValueError("the box must lie on the sensor and hold a pixel")
        return replace(self, df=spatial.crop(self.df, left, right, top, bottom), width=right - left, height=bottom - top)

    def mask(self, array: np.ndarray) -> EventStream:
        if array.shape != (self.height, self.width):
            raise ValueError(f"the mask must have {self.height} rows and {self.width} columns")
        return replace(self, df=spatial.mask(self.df, array))

    def transpose(self, action: str) -> EventStream:
        if action not in spatial.TRANSPOSES:
            raise ValueError(f"unknown action {action!r}")
        df, width, height = spatial.transpose(self.df, action, self.width, self.height)
        return replace(self, df=df, width=width, height=height)

    def filter_arbiter_saturation_lines(self, maximum_line_fill_ratio: float, filter_orientation: str = "row") -> EventStream:
        side = {"row": self.width, "column": self.height}[filter_orientation]
        return self._irregular(noise.arbiter_saturation_lines(self.df, round(side * maximum_line_fill_ratio), filter_orientation))

    def filter_hot_pixels(self, maximum_relative_event_count: float) -> EventStream:
        return replace(self, df=noise.hot_pixels(self.df, maximum_relative_event_count))

    def map(self, function: Callable[[pa.RecordBatch], pa.RecordBatch]) -> EventStream:
        """``function`` of Arrow batches of this stream's columns."""
        return replace(self, df=self.df.mapInArrow(lambda batches: map(function, batches), self.df.schema))

    def apply(self, function: Callable[[DataFrame], DataFrame]) -> EventStream:
        return replace(self, df=self.df.transform(function))

    # -- outputs

    def counts(self) -> DataFrame:
        """``packet, events, on_events`` for every packet, empty ones too."""
        self._need("counts", finite=True, regular=True)
        own = self.df.groupBy("packet").agg(F.count("*").alias("events"), F.sum(F.col("on").cast("long")).alias("on_events"))
        spine = temporal.packet_spine(self.df.sparkSession, self.packets)
        return spine.join(own, "packet", "left").na.fill(0, ["events", "on_events"])

    def render(self, decay: str, tau: When, colormap: Colormap, minimum_clip: float = 0.0, maximum_clip: float = 0.99, gamma: float = 0.0) -> FrameStream:
        self._need("render", finite=True)
        style = render.Style(decay, float(microseconds(tau)), colormap, minimum_clip, maximum_clip, gamma)
        if self.regular:
            pixels = render.render(self.df, self.packets, self.start, temporal.period_us(self.frequency_hz), style)
            return FrameStream(pixels, self.width, self.height, style, self.frequency_hz, self.packets, self.start)
        # One frame, labelled one past the last event.
        t0, t1 = self.time_range()
        pixels = render.render(self.df.drop("packet").withColumn("packet", F.lit(0).cast("long")), 1, t0, float(t1 - t0), style)
        return FrameStream(pixels, self.width, self.height, style, None, 1, t0, t1)

    def to_event_rate(self, samples: int = 1600) -> DataFrame:
        if samples <= 0:
            raise ValueError("one sample at least")
        return summary.event_rate(self.df, *self.time_range(), samples)

    def to_kinectograph(self, threshold_quantile: float = 0.9, normalized_times_gamma=None, opacities_gamma=None) -> DataFrame:
        return summary.kinectograph(self.df, *self.time_range(), threshold_quantile, normalized_times_gamma, opacities_gamma)

    def to_array(self) -> pa.Table:
        """All events in arrival order, on the driver."""
        self._need("to_array", finite=True)
        return self.df.orderBy("seq").select("t", "x", "y", "on").toArrow()

    def info(self) -> dict:
        t0, t1 = self.time_range()
        kinds = {"t": "<u8", "x": "<u2", "y": "<u2", "on": "?"}
        return {"dimensions": self.dimensions(), "time_range": (to_timecode(t0), to_timecode(t1)), "duration": to_timecode(t1 - t0), "digests": summary.sha3_224(self.df, kinds)}

    def to_file(self, path: str, **options) -> str:
        from eventloom.sources import files

        self._need("to_file", finite=True)
        return files.write(self, path, **options)

    def to_stdout(self, csv_separator: str = ",", csv_header: bool = True) -> None:
        import sys

        from eventloom.sources import files

        sys.stdout.writelines(files.csv_lines(self, csv_separator, csv_header))

    def to_udp(self, address: tuple[str, int], events_per_packet: int = 100, format: str = "t64_x16_y16_on8") -> None:
        from eventloom.streaming import udp

        udp.send(self.df, address, events_per_packet, format)


@dataclass(frozen=True, eq=False)
class FrameStream:
    """Frames as sparse pixels, made dense at a sink or by an operator of whole images."""

    pixels: DataFrame
    width: int
    height: int
    style: render.Style
    frequency_hz: float | None
    count: int
    start: int
    end: int | None = None

    def dimensions(self) -> tuple[int, int]:
        return self.width, self.height

    def frames(self) -> DataFrame:
        """``frame, t`` of every frame, whether or not it has pixels."""
        frame = F.col("id")
        t = F.lit(self.end) if self.frequency_hz is None else render.label(frame, self.start, temporal.period_us(self.frequency_hz))
        return self.pixels.sparkSession.range(self.count).select(frame.alias("frame"), t.alias("t"))

    def colored(self) -> DataFrame:
        return render.colored(self.pixels, self.style)

    def dense(self) -> DataFrame:
        return render.dense(self.pixels, self.width, self.height, self.style, self.frames())

    def images(self) -> ImageStream:
        return ImageStream(self.dense(), self.width, self.height, self.frequency_hz)

    def scale(self, factor_or_minimum_dimensions=(960, 720), sampling_filter: str = "nearest") -> FrameStream | ImageStream:
        """Enlarged by a whole factor; other filters than the nearest pixel need whole images."""
        from eventloom.operators import frames

        if sampling_filter != "nearest":
            return self.images().scale(factor_or_minimum_dimensions, sampling_filter)
        factor = frames.scale_factor(self.width, self.height, factor_or_minimum_dimensions)
        return replace(self, pixels=frames.scale_pixels(self.pixels, factor), width=self.width * factor, height=self.height * factor)

    def annotate(self, *args, **options) -> ImageStream:
        return self.images().annotate(*args, **options)

    def add_timecode(self, output_frame_rate: float | None = None) -> ImageStream:
        return self.images().add_timecode(output_frame_rate)

    def add_overlay(self, *args, **options) -> ImageStream:
        return self.images().add_overlay(*args, **options)

    def map(self, function: Callable[[np.ndarray, int], np.ndarray]) -> ImageStream:
        return self.images().map(function)

    def to_files(self, pattern: str, **options) -> int:
        return self.images().to_files(pattern, **options)


@dataclass(frozen=True, eq=False)
class ImageStream:
    """Whole images: rows of ``frame, t, pixels`` (RGBA bytes by row), and what is to be said of them."""

    df: DataFrame
    width: int
    height: int
    frequency_hz: float | None = None

    def dimensions(self) -> tuple[int, int]:
        return self.width, self.height

    def map(self, function: Callable[[np.ndarray, int], np.ndarray]) -> ImageStream:
        """``function`` of each image, as (height, width, 4) bytes, and its time; the sides stay."""
        from eventloom.operators import frames

        return replace(self, df=frames.map_frames(self.df, self.width, self.height, function))

    def scale(self, factor_or_minimum_dimensions=(960, 720), sampling_filter: str = "nearest") -> ImageStream:
        from eventloom.operators import frames

        factor = frames.scale_factor(self.width, self.height, factor_or_minimum_dimensions)
        made = frames.map_frames(self.df, self.width, self.height, lambda image, _: frames.resize(image, factor, sampling_filter))
        return replace(self, df=made, width=self.width * factor, height=self.height * factor)

    def add_overlay(self, overlay: np.ndarray | str, x: int = 0, y: int = 0, factor: int = 1, sampling_filter: str = "nearest") -> ImageStream:
        """``overlay``, RGBA or the path of a PNG file, laid over every image."""
        from eventloom.operators import frames

        if isinstance(overlay, str):
            with open(overlay, "rb") as f:
                overlay = frames.from_png(f.read())
        return replace(self, df=frames.add_overlay(self.df, self.width, self.height, overlay, x, y, factor, sampling_filter))

    def annotate(self, text: str, x: int = 21, y: int = 15, size: int = 30, color="#ffffff") -> ImageStream:
        """``text`` drawn into every image."""
        from eventloom.operators import lettering

        return self.map(lettering.writer(text, x, y, size, color))

    def add_timecode(self, output_frame_rate: float | None = None, x: int = 21, y: int = 15, size: int = 30, color="#ffffff") -> ImageStream:
        """Each image's time drawn into it, followed by the playback speed where a rate is given."""
        from eventloom.operators import frames, lettering

        if output_frame_rate is not None and self.frequency_hz is None:
            raise TypeError("a playback speed needs regular frames")
        speed = "" if output_frame_rate is None else f" ({frames.speed_label(output_frame_rate, self.frequency_hz)})"
        return self.map(lettering.writer(lambda t: to_timecode(t) + speed, x, y, size, color))

    def played(self, skip: int = 0, rewind: bool = False) -> DataFrame:
        """The images in playing order (``turn``)."""
        from eventloom.operators import frames

        return frames.played(self.df, skip, rewind)

    def to_files(self, pattern: str, on_progress: Callable[[str, int], None] | None = None) -> int:
        """A PNG file for each image; ``on_progress`` is told the start and the end, with the number of files."""
        from eventloom.operators import frames

        tell = on_progress or (lambda *_: None)
        tell("start", 0)
        count = frames.to_files(self.df, self.width, self.height, pattern)
        tell("end", count)
        return count

    def to_file(self, path: str, frame_rate: float = 60.0, skip: int = 0, rewind: bool = False, on_progress: Callable[[str, int], None] | None = None) -> int:
        """An animated GIF of all images in playing order; returns how many."""
        from eventloom.operators import animation

        if not path.lower().endswith(".gif"):
            raise ValueError("only GIF files are written")
        return animation.write_gif(self.played(skip, rewind), self.width, self.height, path, frame_rate, on_progress)


def events_stream_from_array(spark: SparkSession, events: np.ndarray, dimensions: tuple[int, int]) -> EventStream:
    """A finite stream of a structured array with fields t, x, y and on (or p)."""
    on = events["on"] if "on" in (events.dtype.names or ()) else events["p"]
    if len(events) and int(events["t"].max()) >= 1 << 63:
        raise ValueError("times must be below 2 ** 63")
    table = pa.table({"seq": pa.array(np.arange(len(events))), "t": pa.array(events["t"].astype(np.int64)), "x": pa.array(events["x"].astype(np.int32)), "y": pa.array(events["y"].astype(np.int32)), "on": pa.array(on.astype(bool))})
    span = (int(events["t"][0]), int(events["t"][-1]) + 1) if len(events) else (0, 1)
    return EventStream(spark.createDataFrame(table), *dimensions, range=span)
