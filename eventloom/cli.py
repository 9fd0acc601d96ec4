"""The command line: ``python -m eventloom.cli WORDS``.

``input [file] PATH | stdin | udp HOST:PORT | camera [DRIVER...]``, any number
of ``filter NAME ARGUMENTS``, and any number of ``output [file] PATH | stdout |
udp HOST:PORT | files PATTERN | rate PATH.svg | kinectograph PATH.png``. Without
an input events come from standard input, without an output they go to standard
output. Arguments are given in order or as ``--name value``; a flag without a
value is true. Times may be timecodes, sides are ``WIDTHxHEIGHT``, colormaps go
by name.

Others: ``list-filters``, ``info PATH``, ``init PATTERN [--nicknames]``, ``run
SCRIPT``, ``colormaps [PATH.png]``.
"""

from __future__ import annotations

import glob
import inspect
import json
import os
import subprocess
import sys

from eventloom.functions.color import catalogue
from eventloom.functions.timecode import to_timecode
from eventloom.model import EventStream, FrameStream, ImageStream

KEYWORDS = ("input", "filter", "output")
FILTERS = {
    EventStream: ("regularize", "chunks", "time_slice", "packet_slice", "event_slice", "remove_on_events", "remove_off_events", "crop", "mask", "transpose", "filter_arbiter_saturation_lines", "filter_hot_pixels", "render"),
    FrameStream: ("scale", "annotate", "add_timecode", "add_overlay"),
    ImageStream: ("scale", "annotate", "add_timecode", "add_overlay"),
}
TEMPLATE = "jobs = [\n{{#jobs}}    ({{input}}, {{start}}, {{end}}, {{nickname}}),\n{{/jobs}}]\n"


def list_filters() -> list[str]:
    out = []
    for kind in (EventStream, ImageStream):
        out += [f"{n.removeprefix('filter_')} {inspect.signature(getattr(kind, n))}".replace("self, ", "").replace("(self)", "()") for n in FILTERS[kind]]
    return out


def split(words: list[str]) -> list[tuple[str, list[str]]]:
    """The words after each keyword."""
    out: list[tuple[str, list[str]]] = []
    for w in words:
        if w in KEYWORDS:
            out.append((w, []))
        elif not out:
            raise SystemExit(f"expected one of {', '.join(KEYWORDS)}, not {w}")
        else:
            out[-1][1].append(w)
    return out


def value(word: str) -> object:
    for kind in (int, float, sides):
        try:
            return kind(word)
        except ValueError:
            pass
    return {"true": True, "false": False, "none": None}.get(word.lower(), word)


def sides(word: str) -> tuple[int, int]:
    width, height = word.split("x")
    return int(width), int(height)


def address(word: str) -> tuple[str, int]:
    host, port = word.rsplit(":", 1)
    return host.strip("[]"), int(port)


def arguments(words: list[str]) -> tuple[list, dict[str, object]]:
    """What is given in order, and by name."""
    ordered, named, at = [], {}, 0
    while at < len(words):
        if words[at].startswith("--"):
            name = words[at][2:].replace("-", "_")
            given = at + 1 < len(words) and not words[at + 1].startswith("--")
            negative = name.startswith("no_") and not given
            named[name.removeprefix("no_") if negative else name] = value(words[at + 1]) if given else not negative
            at += 1 + given
        else:
            ordered.append(value(words[at]))
            at += 1
    return ordered, named


def filtered(stream, words: list[str]):
    known = FILTERS[type(stream)]
    name = words[0].replace("-", "_")
    name = name if name in known else f"filter_{name}"
    if name not in known:
        raise SystemExit(f"unknown filter {words[0]}; known here are {', '.join(known)}")
    ordered, named = arguments(words[1:])
    if name == "mask":  # the path of a PNG image, black where events go
        from eventloom.operators.frames import from_png

        with open(str(ordered[0]), "rb") as f:
            ordered[0] = from_png(f.read())[..., :3].any(2)
    if name == "render":
        maps = catalogue()
        ordered = [maps.get(x, x) if i == 2 else x for i, x in enumerate(ordered)]
        named = {k: maps[v] if k == "colormap" else v for k, v in named.items()}
    if name in ("annotate", "add_overlay"):
        ordered[:1] = [str(x) for x in words[1:2] if ordered]
    return getattr(stream, name)(*ordered, **named)


def opened(spark, words: list[str]) -> EventStream:
    """The stream of an input."""
    from eventloom.sources import files

    kind, words = (words[0], words[1:]) if words[0] in ("file", "stdin", "udp", "camera") else ("file", words)
    ordered, named = arguments(words)
    csv = {k.removeprefix("csv_"): named.pop(k) for k in list(named) if k.startswith("csv_")}
    csv = files.CsvProperties(**{k: str(v) if k in ("separator", "on_value", "off_value") else v for k, v in csv.items()})
    dimensions = named.pop("dimensions", named.pop("dimensions_fallback", (1280, 720)))
    if kind == "udp":
        from eventloom.streaming.udp import events_stream_from_udp

        return events_stream_from_udp(spark, dimensions, address(words[0]), named.get("format", "t64_x16_y16_on8"))
    if kind == "camera":
        from eventloom.streaming.camera import events_stream_from_camera

        return events_stream_from_camera(spark, tuple(map(str, ordered)), **named)
    from eventloom.functions.timecode import microseconds

    t0 = None if named.get("t0") is None else microseconds(named.pop("t0"))
    if kind == "stdin":
        return files.events_stream_from_stdin(spark, dimensions, t0 or 0, csv)
    if "version_fallback" in named:
        named["version_fallback"] = str(named["version_fallback"])
    return files.events_stream_from_file(spark, words[0], dimensions_fallback=dimensions, t0=t0, csv_properties=csv, **named)


def delivered(stream, words: list[str]) -> None:
    """Sends a stream to an output."""
    kind, words = (words[0], words[1:]) if words[0] in ("file", "files", "stdout", "udp", "rate", "kinectograph") else ("file", words)
    ordered, named = arguments(words)
    frames = not isinstance(stream, EventStream)
    if kind == "stdout" and not frames:
        stream.to_stdout(str(named.get("csv_separator", ",")), bool(named.get("csv_header", True)))
    elif kind == "udp" and not frames:
        stream.to_udp(address(words[0]), named.get("events_per_packet") or 100, named.get("format", "t64_x16_y16_on8"))
    elif kind == "rate" and not frames:
        from eventloom.operators.plots import rate_svg

        samples = named.pop("samples", 1600)
        with open(words[0], "w") as f:
            f.write(rate_svg(stream.to_event_rate(samples), **named))
    elif kind == "kinectograph" and not frames:
        from eventloom.operators.frames import png
        from eventloom.operators.plots import kinectograph_image

        colormap = catalogue()[str(named.pop("colormap", "glow_3"))]
        with open(words[0], "wb") as f:
            f.write(png(kinectograph_image(stream.to_kinectograph(), stream.width, stream.height, colormap, **named)))
    elif kind == "files" and frames:
        print(stream.to_files(words[0]))
    elif kind == "file" and frames:
        images = stream.images() if isinstance(stream, FrameStream) else stream
        print(images.to_file(words[0], **named))
    elif kind == "file":
        squeeze, level = named.pop("compression_type", None), named.pop("compression_level", 1)
        if squeeze:
            named["compression"] = None if squeeze == "none" else (squeeze, level)
        if "version" in named:
            named["version"] = str(named["version"])
        if named.pop("progress", False):
            named["on_progress"] = lambda what, path: print(what, path, file=sys.stderr)
        print(stream.to_file(words[0], **named))
    else:
        raise SystemExit(f"{kind} takes no {'frames' if frames else 'events'}")


def process(spark, words: list[str]) -> None:
    from eventloom.sources import files

    stream, sent = None, False
    steps = split(words)
    if not steps or steps[0][0] != "input":
        stream = files.events_stream_from_stdin(spark, (1280, 720))
    for kind, args in steps:
        if not args:
            raise SystemExit(f"{kind} needs more words")
        if kind == "input":
            stream = opened(spark, args)
        elif kind == "filter":
            stream = filtered(stream, args)
        else:
            delivered(stream, args)
            sent = True
    if not sent:
        stream.to_stdout()


#: Words of made-up nicknames.
COLORS, THINGS = ("amber", "blue", "coral", "green", "ivory", "red", "silver", "violet"), ("brook", "cloud", "fern", "harbour", "lantern", "meadow", "pebble", "sparrow")


def nickname(path: str) -> str:
    """Two words and a number, always the same for a name."""
    import zlib

    h = zlib.crc32(os.path.basename(path).encode())
    return f"{COLORS[h % 8]}-{THINGS[h // 8 % 8]}-{h // 64 % 1000:03d}"


def init(spark, pattern: str, nicknames: bool = False) -> str:
    """A job list for the files that ``pattern`` matches."""
    from eventloom.jobs import rendered_jobs
    from eventloom.sources import files

    jobs = []
    for path in sorted(glob.glob(pattern)):
        a, b = files.events_stream_from_file(spark, path).time_range()
        jobs.append({"input": repr(path), "start": repr(to_timecode(a)), "end": repr(to_timecode(b)), "nickname": repr(nickname(path) if nicknames else os.path.splitext(os.path.basename(path))[0])})
    return rendered_jobs(TEMPLATE, jobs)


def main(words: list[str]) -> int:
    if not words:
        print(__doc__)
        return 1
    if words[0] == "list-filters":
        print("\n".join(list_filters()))
        return 0
    if words[0] == "colormaps" and len(words) > 1:
        import numpy as np

        from eventloom.operators.frames import png

        strips = [m.bytes()[np.arange(512) * len(m.rgba) // 512][None].repeat(12, 0) for m in catalogue().values()]
        with open(words[1], "wb") as f:
            f.write(png(np.concatenate(strips)))
        return 0
    if words[0] == "colormaps":
        print("\n".join(f"{m.kind}: {n} ({len(m.rgba)} steps)" for n, m in catalogue().items()))
        return 0
    if words[0] == "run":
        return subprocess.run([sys.executable, *words[1:]], check=False).returncode
    from pyspark.sql import SparkSession

    from eventloom.sources import files

    spark = SparkSession.builder.getOrCreate()
    if words[0] == "info":
        print(json.dumps(files.events_stream_from_file(spark, words[1]).info(), indent=1))
    elif words[0] == "init":
        print(init(spark, words[1], "--nicknames" in words))
    else:
        process(spark, words)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
