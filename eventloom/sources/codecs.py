"""Byte formats of event recordings, as numpy columns.

Decoders take a file's bytes and give ``(Header, columns)``; encoders do the
reverse. Both also work in parts: ``parts`` reads an open file block by block,
and a ``Writer`` makes a file's bytes from runs of events that only know the
time before them, so neither holds a file in memory. Columns are ``t, x, y, on`` for plain events (with y counted from the
top), and named otherwise for other records. Times are clamped to their
running maximum on reading and must not decrease on writing.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pyarrow as pa

Columns = dict[str, np.ndarray]
# Fixed values of the formats.
ES_MAGIC, AEDAT_MAGIC = b"Event Stream", b"#!AER-DAT4.0\r\n"
ES_KINDS = {"generic": 0, "dvs": 1, "atis": 2, "color": 4}
DAT_KINDS = {0x00: "2d", 0x0C: "cd", 0x0E: "trigger"}
COMPRESSIONS = ("none", "lz4", "lz4_high", "zstd", "zstd_high")
EXTENSIONS = {".aedat": "aedat", ".aedat4": "aedat", ".csv": "csv", ".dat": "dat", ".es": "es", ".evt": "evt", ".raw": "evt"}
AEDAT_TRACKS = {"EVTS": "events", "FRME": "frame", "IMUS": "imus", "TRIG": "triggers"}
IMU_FIELDS = ("temperature", *(f"{s}_{a}" for s in ("accelerometer", "gyroscope", "magnetometer") for a in "xyz"))


#: Bytes that a decoder reads at a time.
BLOCK = 1 << 20


@dataclass
class Header:
    width: int = 0
    height: int = 0
    version: str = ""
    t0: int = 0
    kind: str = ""
    length: int = 0
    more: dict = field(default_factory=dict)


def detect(path: str, start: bytes) -> str:
    """The format's name: by magic, else by extension."""
    if start.startswith(AEDAT_MAGIC):
        return "aedat"
    if start.startswith(ES_MAGIC):
        return "es"
    for end, name in EXTENSIONS.items():
        if path.lower().endswith(end):
            return name
    raise ValueError(f"unknown format: {path}")


def running(t: np.ndarray) -> np.ndarray:
    return np.maximum.accumulate(t) if len(t) else t


def _ordered(t: np.ndarray) -> np.ndarray:
    if len(t) > 1 and (np.diff(t) < 0).any():
        raise ValueError("times must not decrease")
    return t


def _inside(x: np.ndarray, y: np.ndarray, width: int, height: int) -> None:
    if len(x) and (int(x.max()) >= width or int(y.max()) >= height or int(x.min()) < 0 or int(y.min()) < 0):
        raise ValueError(f"an event lies off the {width}x{height} sensor")


def _events(t, x, y, on) -> Columns:
    return {"t": np.asarray(t, np.int64), "x": np.asarray(x, np.int32), "y": np.asarray(y, np.int32), "on": np.asarray(on, bool)}


# -- lines before the data of DAT and EVT files


def percent_header(data: bytes, dimensions: tuple[int, int] | None, version: str | None) -> Header:
    """The lines that start with %: version, sensor sides and first time; arguments stand in for what is missing."""
    out, at, found = Header(), 0, {}
    while data[at : at + 1] == b"%":
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end + 1
        words = data[at + 1 : end].decode("latin-1").replace(";", " ").split()
        at = end
        if len(words) < 2:
            continue
        name, value = words[0], words[1]
        if name in ("Width", "Height") and value.isdigit():
            found[name.lower()] = int(value)
        elif name == "geometry" and [p.isdigit() for p in value.split("x")] == [True, True]:
            found["width"], found["height"] = map(int, value.split("x"))
        elif name in ("T0", "t0") and value.isdigit():
            out.t0 = int(value)
        elif name in ("Version", "evt", "format"):
            out.version = value.upper().removeprefix("EVT").removesuffix(".0")
            found |= {k: int(v) for k, _, v in (w.partition("=") for w in words[2:]) if k in ("width", "height") and v.isdigit()}
    out.length = at
    out.version = out.version or version or ""
    if "width" in found and "height" in found:
        out.width, out.height = found["width"], found["height"]
    elif dimensions:
        out.width, out.height = dimensions
    else:
        raise ValueError("the header doesn't give the sensor's sides")
    return out


def _percent_start(f: BinaryIO, dimensions, version) -> tuple[Header, bytes]:
    """The header, and what was read after it."""
    start = f.read(BLOCK)
    while True:
        h = percent_header(start, dimensions, version)
        more = f.read(BLOCK) if h.length == len(start) else b""
        if not more:
            return h, start[h.length :]
        start += more


def _words(f: BinaryIO, rest: bytes, size: int) -> Iterator[bytes]:
    """``rest`` and what follows in blocks of whole words of ``size`` bytes; a part of a word at the end is left out."""
    while True:
        more = f.read(BLOCK)
        rest += more
        n = len(rest) // size * size
        if n:
            yield rest[:n]
        rest = rest[n:]
        if not more:
            return


def _joined(found: list[Columns], empty: Columns) -> Columns:
    found = found or [empty]
    return found[0] if len(found) == 1 else {k: np.concatenate([c[k] for c in found]) for k in found[0]}


# -- DAT

_DAT_BITS = {"1": ((0, 9), (9, 8), (17, 4)), "2": ((0, 14), (14, 14), (28, 4))}


def _dat_parts(f: BinaryIO, dimensions=(1280, 720), version: str = "2", t0: int | None = None) -> tuple[Header, Iterator[Columns]]:
    h, rest = _percent_start(f, dimensions, version)
    h.kind = "cd"
    rest += f.read(2) if len(rest) < 2 else b""
    if len(rest) >= 2:
        if rest[0] not in DAT_KINDS or rest[1] != 8:
            raise ValueError("unknown DAT records")
        h.kind, rest = DAT_KINDS[rest[0]], rest[2:]
    h.t0 = h.t0 if t0 is None else t0
    return h, _dat_columns(_words(f, rest, 8), h, h.version or version)


def _dat_columns(blocks: Iterator[bytes], h: Header, version: str) -> Iterator[Columns]:
    before = turns = top = 0
    for block in blocks:
        words = np.frombuffer(block, "<u4").astype(np.int64).reshape(-1, 2)
        low = words[:, 0]
        turn = turns + np.cumsum(np.diff(low, prepend=before) < -(1 << 31))
        t = np.maximum(running(low + (turn << 32)), top)
        before, turns, top = int(low[-1]), int(turn[-1]), int(t[-1])
        if h.kind == "trigger":
            yield {"t": t + h.t0, "source": (words[:, 1] >> 8 & 0xFF).astype(np.int16), "rising": (words[:, 1] & 1).astype(bool)}
            continue
        x, y, p = ((words[:, 1] >> s) & ((1 << n) - 1) for s, n in _DAT_BITS[version])
        _inside(x, y, h.width, h.height)
        yield _events(t + h.t0, x, y, np.minimum(p, 1)) | {"payload": p.astype(np.int16)}


def decode_dat(data: bytes, dimensions=(1280, 720), version: str = "2", t0: int | None = None) -> tuple[Header, Columns]:
    h, found = _dat_parts(io.BytesIO(data), dimensions, version, t0)
    none = np.empty(0, np.int64)
    return h, _joined(list(found), _triggers(none, none, none) if h.kind == "trigger" else _events(none, none, none, none) | {"payload": none.astype(np.int16)})


def _dat_head(width: int, height: int, version: str, t0: int) -> bytes:
    most = {"1": (512, 256), "2": (16384, 16384)}[version]
    if width > most[0] or height > most[1]:
        raise ValueError(f"DAT{version} holds sensors up to {most[0]}x{most[1]}")
    return f"% Version {version}\n% Width {width}\n% Height {height}\n% T0 {t0}\n".encode() + bytes((0x0C, 8))


def _dat_body(c: Columns, version: str, before: int | None) -> bytes:
    (xs, _), (ys, _), (ps, _) = _DAT_BITS[version]
    t = c["t"]
    words = np.empty((len(t), 2), "<u4")
    words[:, 0] = low = t & 0xFFFFFFFF
    before = before or 0
    if (np.diff(t >> 32, prepend=before >> 32) != (np.diff(low, prepend=before & 0xFFFFFFFF) < -(1 << 31))).any():
        raise ValueError("DAT holds 32-bit times, and a gap is too long for its readers to count the turns")
    words[:, 1] = c["x"].astype(np.int64) << xs | c["y"].astype(np.int64) << ys | c["on"].astype(np.int64) << ps
    return words.tobytes()


def encode_dat(c: Columns, width: int, height: int, version: str = "2", zero_t0: bool = True) -> tuple[bytes, int]:
    return _encoded(Writer("dat", width, height, version), c, zero_t0)


# -- ES


def _es_parts(f: BinaryIO, t0: int = 0) -> tuple[Header, Iterator[Columns]]:
    data = f.read(20)
    if not data.startswith(ES_MAGIC) or data[12] != 2:
        raise ValueError("not an Event Stream 2 file")
    kind = {v: k for k, v in ES_KINDS.items()}[data[15]]
    h = Header(version="2.0.0", kind=kind, t0=t0)
    if kind == "generic":
        return h, _es_generic(f, data[16:], t0)
    h.width, h.height = struct.unpack_from("<HH", data, 16)
    return h, _es_columns(f, h)


def _es_generic(f: BinaryIO, data: bytes, t: int) -> Iterator[Columns]:
    at, more = 0, True
    while more:
        more = f.read(BLOCK)
        data, at = data[at:] + more, 0
        n, ts, bodies = len(data), [], []
        while at < n:
            b = data[at]
            if b >= 0xFE:
                t += 254 if b == 0xFF else 0
                at += 1
                continue
            body, size, shift, last = at + 1, 0, 0, 1
            while last and (body < n or not more):
                last = data[body] & 1
                size |= (data[body] >> 1) << shift
                shift += 7
                body += 1
            if more and (last or body + size > n):
                break  # the rest of the record is in the next block
            t += b
            ts.append(t)
            bodies.append(data[body : body + size])
            at = body + size
        if ts:
            own = np.empty(len(ts), object)
            own[:] = bodies
            yield {"t": np.array(ts, np.int64), "bytes": own}


def _es_columns(f: BinaryIO, h: Header) -> Iterator[Columns]:
    kind, t, rest, more = h.kind, h.t0, b"", True
    body = {"dvs": 4, "atis": 4, "color": 7}[kind]
    while more:
        more = f.read(BLOCK)
        data = rest + more
        n, at, ts, flags, places = len(data), 0, [], [], []
        while at < n:
            b = data[at]
            if kind == "dvs":
                if b >= 0xFE:
                    t += 127 if b == 0xFF else 0
                    at += 1
                    continue
                step, flag = b >> 1, b & 1
            elif kind == "atis":
                if b & 0xFC == 0xFC:
                    t += 63 * (b & 3)
                    at += 1
                    continue
                step, flag = b >> 2, b & 3
            else:
                if b >= 0xFE:
                    t += 254 if b == 0xFF else 0
                    at += 1
                    continue
                step, flag = b, 0
            if at + 1 + body > n:
                break
            t += step
            ts.append(t)
            flags.append(flag)
            places.append(at + 1)
            at += 1 + body
        rest = data[at:]
        if ts:
            yield _es_values(h, data, np.array(ts, np.int64), np.array(flags, np.int64), np.array(places, np.int64))


def _es_values(h: Header, data: bytes, t: np.ndarray, flags: np.ndarray, places: np.ndarray) -> Columns:
    raw = np.frombuffer(data, np.uint8)
    take = lambda k: raw[places + k].astype(np.int64)
    x, up = take(0) | take(1) << 8, take(2) | take(3) << 8
    _inside(x, up, h.width, h.height)
    y = h.height - 1 - up  # the format counts y from the bottom
    if h.kind == "color":
        return {"t": t, "x": x.astype(np.int32), "y": y.astype(np.int32), **{k: take(4 + i).astype(np.int16) for i, k in enumerate("rgb")}}
    if h.kind == "dvs":
        return _events(t, x, y, flags == 1)
    return {"t": t, "x": x.astype(np.int32), "y": y.astype(np.int32), "exposure": (flags & 1).astype(bool), "polarity": flags >= 2}


def decode_es(data: bytes, t0: int = 0) -> tuple[Header, Columns]:
    h, found = _es_parts(io.BytesIO(data), t0)
    none = np.empty(0, np.int64)
    empty = {"t": none, "bytes": none.astype(object)} if h.kind == "generic" else _es_values(h, b"", none, none, none)
    return h, _joined(list(found), empty)


def _es_head(width: int, height: int) -> bytes:
    return ES_MAGIC + bytes((2, 0, 0, ES_KINDS["dvs"])) + struct.pack("<HH", width, height)


def _es_body(c: Columns, height: int, before: int | None) -> bytes:
    """Five bytes for each event, and one before them for every 127 that its time is ahead."""
    gap = np.diff(c["t"], prepend=before or 0)
    more = gap // 127
    at = np.cumsum(more + 5) - 5
    out = np.full(int(at[-1]) + 5 if len(at) else 0, 0xFF, np.uint8)
    x, up = c["x"].astype(np.int64), height - 1 - c["y"].astype(np.int64)
    for k, v in enumerate((gap % 127 << 1 | c["on"], x & 0xFF, x >> 8, up & 0xFF, up >> 8)):
        out[at + k] = v
    return out.tobytes()


def encode_es(c: Columns, width: int, height: int, kind: str = "dvs", zero_t0: bool = True) -> tuple[bytes, int]:
    if kind == "dvs":
        return _encoded(Writer("es", width, height), c, zero_t0)
    t = _ordered(c["t"])
    t0 = int(t[0]) if zero_t0 and len(t) else 0
    head = ES_MAGIC + bytes((2, 0, 0, ES_KINDS[kind]))
    gaps = np.diff(t, prepend=t0)
    parts = [head] if kind == "generic" else [head, struct.pack("<HH", width, height)]
    if kind == "generic":
        for gap, body in zip(gaps.tolist(), c["bytes"], strict=True):
            parts += [b"\xff" * (gap // 254), bytes((gap % 254,))]
            size = len(body)
            while True:
                low, size = size & 127, size >> 7
                parts.append(bytes((low << 1 | (size > 0),)))
                if not size:
                    break
            parts.append(bytes(body))
        return b"".join(parts), t0
    _inside(c["x"], c["y"], width, height)
    up = height - 1 - c["y"]
    for i, (gap, x, y) in enumerate(zip(gaps.tolist(), c["x"].tolist(), up.tolist(), strict=True)):
        if kind == "atis":
            more = b"\xff" * (gap // 189)
            gap %= 189
            if gap >= 63:
                more += bytes((0xFC | gap // 63,))
            parts.append(more + struct.pack("<BHH", gap % 63 << 2 | bool(c["polarity"][i]) << 1 | bool(c["exposure"][i]), x, y))
        else:
            parts.append(b"\xff" * (gap // 254) + struct.pack("<BHHBBB", gap % 254, x, y, *(int(c[k][i]) for k in "rgb")))
    return b"".join(parts), t0


# -- EVT 2 and 3


def _evt_parts(f: BinaryIO, dimensions=(1280, 720), version: str = "3", t0: int | None = None) -> tuple[Header, Iterator[tuple[Columns, Columns]]]:
    """The header, and events and triggers of each block."""
    h, rest = _percent_start(f, dimensions, version)
    h.t0 = h.t0 if t0 is None else t0
    if h.version not in ("2", "3"):
        raise NotImplementedError(f"EVT{h.version}")
    return h, _evt2_columns(_words(f, rest, 4), h) if h.version == "2" else _evt3_columns(_words(f, rest, 2), h)


def decode_evt(data: bytes, dimensions=(1280, 720), version: str = "3", t0: int | None = None) -> tuple[Header, Columns, Columns]:
    """Header, events and triggers."""
    h, found = _evt_parts(io.BytesIO(data), dimensions, version, t0)
    found, none = list(found), np.empty(0, np.int64)
    return h, _joined([e for e, _ in found], _events(none, none, none, none)), _joined([g for _, g in found], _triggers(none, none, none))


def _triggers(t, source, rising) -> Columns:
    return {"t": np.asarray(t, np.int64), "source": np.asarray(source, np.int16), "rising": np.asarray(rising, bool)}


def _evt2_columns(blocks: Iterator[bytes], h: Header) -> Iterator[tuple[Columns, Columns]]:
    high, turns, base, top = None, 0, 0, 0  # the last high part, its turns, the time that both make, and the last time
    for block in blocks:
        w = np.frombuffer(block, "<u4").astype(np.int64)
        kind = w >> 28
        marks = kind == 8
        own = (w[marks] & 0xFFFFFFF) << 6
        bases = np.array([base])
        if len(own):
            turn = turns + np.cumsum(np.diff(own, prepend=own[0] if high is None else high) < 0)
            high, turns = int(own[-1]), int(turn[-1])
            bases = np.concatenate((bases, own + (turn << 34)))
            base = int(bases[-1])
        timed = (kind <= 1) | (kind == 10)
        t = np.maximum(running((bases[np.cumsum(marks)] + (w >> 22 & 63))[timed]), top)
        top = int(t[-1]) if len(t) else top
        t, kind, w = t + h.t0, kind[timed], w[timed]
        e = kind <= 1
        x, y = w[e] >> 11 & 2047, w[e] & 2047
        _inside(x, y, h.width, h.height)
        yield _events(t[e], x, y, kind[e] == 1), _triggers(t[~e], w[~e] >> 8 & 31, w[~e] & 1)


def _latest(there: np.ndarray, values: np.ndarray, at: np.ndarray, default: int = 0) -> np.ndarray:
    """For each place the value of the last of ``there`` (ascending places) at or before it."""
    if not len(there):
        return np.full(len(at), default, np.int64)
    k = np.searchsorted(there, at, "right") - 1
    return np.where(k >= 0, values[np.maximum(k, 0)], default)


def _evt3_highs(values: np.ndarray, high: int, turns: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The time that each high part makes, whether it counts, and the last that counts with its turns."""
    full = (1 << 12) - 2
    ahead = np.diff(values, prepend=high)
    if ((ahead < -full) | (0 <= ahead) & (ahead < full)).all():
        turn = turns + np.cumsum(ahead < -full)
        return turn << 24 | values << 12, ahead != 0, int(values[-1]) if len(values) else high, int(turn[-1]) if len(turn) else turns
    base, taken = np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    for i, v in enumerate(values.tolist()):
        ahead = v - high
        turns += ahead < -full
        if 0 < ahead < full or ahead < -full:  # small steps back, and all but whole turns ahead, are glitches
            high, taken[i] = v, True
        base[i] = turns << 24 | high << 12
    return base, taken, high, turns


def _evt3_columns(blocks: Iterator[bytes], h: Header) -> Iterator[tuple[Columns, Columns]]:
    high = turns = base = top = row = sign = start = 0  # what the next word is read by; start: where the next vector does
    for block in blocks:
        words = np.frombuffer(block, "<u2").astype(np.int64)
        kind, value = words >> 12, words & 0xFFF
        rows, columns = np.flatnonzero(kind == 0), np.flatnonzero((kind == 2) | (kind == 3))
        if (value[rows] & 2047 >= h.height).any() or (value[columns] & 2047 >= h.width).any():
            raise ValueError(f"an event lies off the {h.width}x{h.height} sensor")
        highs = np.flatnonzero(kind == 8)
        bases, taken, high, turns = _evt3_highs(value[highs], high, turns)
        times = np.flatnonzero((kind == 6) | (kind == 8))
        is_low = kind[times] == 6
        t = np.where(is_low, _latest(highs, bases, times, base) | value[times], 0)
        t[~is_low] = np.where(taken, bases, 0)  # a high part that counts sets the low one to 0
        t = np.maximum(running(t), top)
        # A vector starts where the last column and the vectors since then end.
        size = np.where(kind == 4, 12, np.where(kind == 5, 8, 0))
        before = np.cumsum(size) - size
        vectors = np.flatnonzero(size)
        origin = (value & 2047)[columns] - before[columns]
        x = np.minimum(_latest(columns, origin, vectors, start) + before[vectors], h.width - 1)
        bits = np.arange(12)
        lit = (value[vectors, None] >> bits & 1 > 0) & (bits < np.minimum(size[vectors], h.width - x)[:, None])
        which, bit = np.nonzero(lit)
        single = np.flatnonzero(kind == 2)
        place = np.concatenate((single, vectors[which]))
        order = np.argsort(place, kind="stable")
        place, x = place[order], np.concatenate((value[single] & 2047, x[which] + bit))[order]
        marks = np.flatnonzero(kind == 10)
        events = _events(_latest(times, t, place, top) + h.t0, x, _latest(rows, (value & 2047)[rows], place, row), _latest(columns, (value >> 11)[columns], place, sign))
        yield events, _triggers(_latest(times, t, marks, top) + h.t0, value[marks] >> 8 & 15, value[marks] & 1)
        base, top = int(bases[-1]) if len(bases) else base, int(t[-1]) if len(t) else top
        row = int(value[rows[-1]] & 2047) if len(rows) else row
        sign = int(value[columns[-1]] >> 11) if len(columns) else sign
        start = (int(origin[-1]) if len(columns) else start) + int(size.sum())


def _evt_head(width: int, height: int, version: str, t0: int) -> bytes:
    most = {"2": 2048, "3": 2048}.get(version)
    if most is None:
        raise NotImplementedError(f"EVT{version}")
    if width > most or height > most:
        raise ValueError(f"EVT{version} holds sensors up to {most}x{most}")
    return f"% evt {version}.0\n% format EVT{version};height={height};width={width}\n% geometry {width}x{height}\n% t0 {t0}\n% end\n".encode()


def encode_evt(c: Columns, width: int, height: int, version: str = "3", zero_t0: bool = True) -> tuple[bytes, int]:
    return _encoded(Writer("evt", width, height, version), c, zero_t0)


def _placed(counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ``counts`` words before each place ``at``: whose each is, its number there, and where it goes."""
    owner = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return owner, number, (at - counts)[owner] + number


def _encode_evt2(t, x, y, on, before: int | None) -> bytes:
    high = t >> 6
    old = np.concatenate(([-1 if before is None else before >> 6], high[:-1]))
    moved = high != old
    # The high part has 28 bits; where it moves by more than a quarter of them it goes in steps, so that no turn is missed.
    step = 1 << 26
    old = np.maximum(old, 0)
    counts = np.where(moved, np.maximum((high - old - 1) // step, 0) + 1, 0)
    at = np.cumsum(counts + 1) - 1
    out = np.empty(int(at[-1]) + 1 if len(at) else 0, "<u4")
    out[at] = on << 28 | (t & 63) << 22 | x << 11 | y
    owner, number, place = _placed(counts, at)
    out[place] = 8 << 28 | np.where(number < counts[owner] - 1, old[owner] + step * (number + 1), high[owner]) & 0xFFFFFFF
    return out.tobytes()


def _run_starts(t, x, y, on) -> np.ndarray:
    """Where runs start that one vector holds: same time, row and polarity, x ascending within 12."""
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (y[1:] != y[:-1]) | (on[1:] != on[:-1]) | (x[1:] <= x[:-1])
    starts = np.flatnonzero(new)
    ends = np.concatenate((starts[1:], [len(t)]))
    for a, z in zip(*(v[x[ends - 1] - x[starts] >= 12].tolist() for v in (starts, ends)), strict=True):
        first = x[a]
        for i in range(a + 1, z):
            if x[i] - first >= 12:
                new[i], first = True, x[i]
    return np.flatnonzero(new)


def _encode_evt3(t, x, y, on, before: int | None) -> bytes:
    if not len(t):
        return b""
    starts = _run_starts(t, x, y, on)
    length = np.diff(starts, append=len(t))
    now, row, first, sign = t[starts], y[starts], x[starts], on[starts]
    ahead = lambda v, start: np.concatenate(([start], v[:-1]))
    # High parts: readers only see a turn from all ones to 0, and steps of up to 1,024.
    high = now >> 12
    old = ahead(high, -1 if before is None else before >> 12)
    moved = high != old
    old = np.maximum(old, 0)
    turned = high >> 12 != old >> 12
    end = np.where(turned, old | 0xFFF, high)
    to_end = (end - old + 1023) >> 10
    whole = np.where(turned, (high >> 12) - (old >> 12) - 1, 0)
    bottom = high & ~0xFFF
    highs = to_end + np.where(turned, 5 * whole + 1 + ((high - bottom + 1023) >> 10), 0)
    low = now & 0xFFF
    lows = low != np.where(moved, 0, ahead(low, -1))
    rows = row != ahead(row, -1)
    # Vectors go on where the one before ended.
    wide = np.maximum.reduceat(x, starts) - first >= 8
    many = length > 1
    after = np.where(many, first + np.where(wide, 12, 8), -1)
    bases = many & ~((ahead(after, -1) == first) & (ahead(sign, -1) == sign))
    at = np.cumsum(highs + lows + rows + bases + 1) - 1
    out = np.empty(int(at[-1]) + 1, "<u2")
    bits = np.add.reduceat(1 << (x - np.repeat(first, length)), starts)
    out[at] = np.where(many, np.where(wide, 4, 5) << 12 | bits, 2 << 12 | sign << 11 | first)
    at = at - bases
    out[at[bases]] = (3 << 12 | sign << 11 | first)[bases]
    at = at - rows
    out[at[rows]] = row[rows]
    at = at - lows
    out[at[lows]] = (6 << 12 | low)[lows]
    owner, number, place = _placed(highs, at)
    rest = number - to_end[owner]
    last = rest - 5 * whole[owner]
    middle = (end[owner] + 1) + (rest // 5 << 12) + np.minimum(rest % 5 << 10, 0xFFF)
    v = np.where(rest < 0, np.minimum(end[owner], old[owner] + (number + 1 << 10)), np.where(last < 0, middle, np.minimum(high[owner], bottom[owner] + (last << 10))))
    out[place] = 8 << 12 | v & 0xFFF
    return out.tobytes()


# -- AEDAT4

_EVENT = np.dtype({"names": ["t", "x", "y", "on"], "formats": ["<i8", "<i2", "<i2", "?"], "offsets": [0, 8, 10, 12], "itemsize": 16})
PER_PACKET = 4096


class _Table:
    """A FlatBuffers table in a buffer."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at
        self.fields = at - struct.unpack_from("<i", data, at)[0]

    def place(self, i: int) -> int:
        """Where field i is, or 0."""
        size = struct.unpack_from("<H", self.data, self.fields)[0]
        offset = struct.unpack_from("<H", self.data, self.fields + 4 + 2 * i)[0] if 4 + 2 * i < size else 0
        return self.at + offset if offset else 0

    def scalar(self, i: int, kind: str, default=0):
        at = self.place(i)
        return struct.unpack_from("<" + kind, self.data, at)[0] if at else default

    def vector(self, i: int) -> tuple[int, int]:
        """Start and length of field i."""
        at = self.place(i)
        if not at:
            return 0, 0
        at += struct.unpack_from("<I", self.data, at)[0]
        return at + 4, struct.unpack_from("<I", self.data, at)[0]

    def tables(self, i: int) -> list[_Table]:
        start, n = self.vector(i)
        return [_Table(self.data, start + 4 * k + struct.unpack_from("<I", self.data, start + 4 * k)[0]) for k in range(n)]


def _root(data: bytes, at: int = 0) -> _Table:
    return _Table(data, at + struct.unpack_from("<I", data, at)[0])


def _vector_table(name: bytes, body: bytes, count: int) -> bytes:
    """A size-prefixed buffer whose root has one vector of structs of 8-byte alignment."""
    buffer = struct.pack("<I4sHHHxxiI", 16, name, 6, 8, 4, 8, 8) + bytes(4) + struct.pack("<I", count) + body
    return struct.pack("<I", len(buffer)) + buffer


def _io_header(compression: int, position: int, description: str) -> bytes:
    text = description.encode() + b"\0"
    # root, identifier, field table (4 entries of 2 bytes and 2 of padding), table: compression, position, description
    body = struct.pack("<I4s", 24, b"IOHE") + struct.pack("<HHHHH", 10, 20, 4, 8, 16) + bytes(6)
    body += struct.pack("<iiqI", 16, compression, position, 4) + struct.pack("<I", len(text) - 1) + text
    return body + bytes(-len(body) % 4)


def _squeezed(data: bytes, compression: str, level: int) -> bytes:
    if compression == "none":
        return data
    if compression.startswith("zstd"):
        import zstandard

        return zstandard.ZstdCompressor(level=level).compress(data)
    if compression.startswith("lz4"):
        return pa.Codec("lz4", compression_level=level).compress(data, asbytes=True)
    raise ValueError(f"unknown compression {compression!r}")


def _opened(data: bytes, compression: int) -> bytes:
    if compression == 0:
        return data
    if compression in (3, 4):
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if compression in (1, 2):
        return pa.CompressedInputStream(pa.BufferReader(data), "lz4").read()
    raise ValueError(f"unknown compression {compression}")


def aedat_header(data: bytes) -> Header:
    """``more`` holds the tracks (id, type, sides), the compression, and where packets start and end."""
    import xml.etree.ElementTree as ET

    if not data.startswith(AEDAT_MAGIC):
        raise ValueError("not an AEDAT 4 file")
    size = struct.unpack_from("<I", data, 14)[0]
    root = _root(data, 18)
    start, n = root.vector(2)
    tracks = []
    for node in ET.fromstring(data[start : start + n].decode()).iter("node"):
        own = {a.get("key"): a.text for a in node.findall("attr")}
        if own.get("typeIdentifier") in AEDAT_TRACKS:
            sides = {a.get("key"): a.text for m in node.findall("node") for a in m.findall("attr")}
            tracks.append({"id": int(node.get("name")), "data_type": AEDAT_TRACKS[own["typeIdentifier"]], "width": int(sides.get("sizeX", 0)), "height": int(sides.get("sizeY", 0))})
    end = root.scalar(1, "q", -1)
    return Header(version="4", more={"tracks": tracks, "compression": root.scalar(0, "i"), "start": 18 + size, "end": len(data) if end < 0 else end, "open": end < 0})


def event_packet(data: bytes, compression: int) -> Columns:
    """The events of one packet's bytes."""
    root = _root(_opened(data, compression), 4)
    start, n = root.vector(0)
    e = np.frombuffer(root.data, _EVENT, n, start) if n else np.empty(0, _EVENT)
    return _events(e["t"], e["x"], e["y"], e["on"])


def _aedat_parts(f: BinaryIO, track_id: int | None = None) -> tuple[Header, Iterator[Columns]]:
    start = f.read(18)
    h = aedat_header(start + f.read(aedat_head_size(start) - 18))
    track = next((k for k in h.more["tracks"] if (k["data_type"] == "events" if track_id is None else k["id"] == track_id)), None)
    if track is None:
        raise ValueError("no such track")
    h.kind, h.width, h.height = track["data_type"], track["width"], track["height"]
    return h, _aedat_columns(f, h, track["id"])


def _aedat_columns(f: BinaryIO, h: Header, track: int) -> Iterator[Columns]:
    """Columns of each packet of a track."""
    at, top = h.more["start"], -(1 << 63)
    while h.more["open"] or at + 8 <= h.more["end"]:
        head = f.read(8)
        if len(head) < 8:
            return
        own, size = struct.unpack("<ii", head)
        data = f.read(size)
        at += 8 + size
        if own == track:
            c = _packet_columns(_root(_opened(data, h.more["compression"]), 4), h)
            c["t"] = np.maximum(running(c["t"]), top)
            top = int(c["t"][-1]) if len(c["t"]) else top
            yield c


def _packet_columns(r: _Table | None, h: Header) -> Columns:
    """What a packet's table holds; without one, the columns with no rows."""
    if h.kind == "events":
        start, n = r.vector(0) if r else (0, 0)
        e = np.frombuffer(r.data, _EVENT, n, start) if n else np.empty(0, _EVENT)
        _inside(e["x"], e["y"], h.width, h.height)
        return _events(e["t"], e["x"], e["y"], e["on"])
    roots = [r] if r else []
    if h.kind == "frame":
        fields = {"t": "q", "start_t": "q", "end_t": "q", "exposure_start_t": "q", "exposure_end_t": "q", "format": "b", "width": "h", "height": "h", "offset_x": "h", "offset_y": "h"}
        pixels = np.empty(len(roots), object)
        pixels[:] = [r.data[r.vector(10)[0] : sum(r.vector(10))] for r in roots]
        return {k: np.array([r.scalar(i, f) for r in roots], np.int64) for i, (k, f) in enumerate(fields.items())} | {"pixels": pixels}
    rows = [x for r in roots for x in r.tables(0)]
    t = np.array([x.scalar(0, "q") for x in rows], np.int64)
    if h.kind == "triggers":
        return {"t": t, "source": np.array([x.scalar(1, "b") for x in rows], np.int16)}
    return {"t": t, **{k: np.array([x.scalar(i + 1, "f", 0.0) for x in rows], np.float32) for i, k in enumerate(IMU_FIELDS)}}


def decode_aedat(data: bytes, track_id: int | None = None) -> tuple[Header, Columns]:
    """Header and columns of one track; of the first with events, unless another is asked for."""
    h, found = _aedat_parts(io.BytesIO(data), track_id)
    return h, _joined(list(found), _packet_columns(None, h))


def encode_aedat(c: Columns, width: int, height: int, compression: tuple[str, int] | None = ("zstd", 1)) -> tuple[bytes, int]:
    """Packets of at most ``PER_PACKET`` events, then a table with each packet's place, count and times."""
    return _encoded(Writer("aedat", width, height, compression=compression), c, False)


def _aedat_head(width: int, height: int, name: str, body: int) -> bytes:
    """All before the packets, which take ``body`` bytes."""
    attr = lambda key, kind, value: f'<attr key="{key}" type="{kind}">{value}</attr>'
    info = attr("sizeX", "int", width) + attr("sizeY", "int", height) + attr("source", "string", "eventloom")
    out = attr("compression", "string", name.upper()) + attr("originalOutputName", "string", "events") + attr("typeIdentifier", "string", "EVTS")
    xml = f'<dv version="2.0"><node name="outInfo" path="/mainloop/Recorder/outInfo/"><node name="0" path="/mainloop/Recorder/outInfo/0/">{out}<node name="info" path="/mainloop/Recorder/outInfo/0/info/">{info}</node></node></node></dv>'
    code = COMPRESSIONS.index(name)
    size = len(_io_header(code, 0, xml))
    return AEDAT_MAGIC + struct.pack("<I", size) + _io_header(code, 18 + size + body, xml)


def _aedat_body(c: Columns, name: str, level: int) -> tuple[bytes, np.ndarray]:
    """Packets, and a row for each: its place and size in these bytes, count, first and last time."""
    at, parts, index = 0, [], []
    for i in range(0, len(c["t"]), PER_PACKET):
        e = np.zeros(len(c["t"][i : i + PER_PACKET]), _EVENT)
        for k in ("t", "x", "y", "on"):
            e[k] = c[k][i : i + PER_PACKET]
        packet = _squeezed(_vector_table(b"EVTS", e.tobytes(), len(e)), name, level)
        parts += [struct.pack("<ii", 0, len(packet)), packet]
        index.append((at, len(packet), len(e), int(e["t"][0]), int(e["t"][-1])))
        at += 8 + len(packet)
    return b"".join(parts), np.array(index, np.int64).reshape(-1, 5)


def _file_table(index: list[tuple[int, int, int, int, int, int]]) -> bytes:
    """The FTAB buffer: a vector of tables (byte_offset, packet_header, elements_count, start_t, end_t) that share their field table."""
    n = len(index)
    fields = 28 + 4 * n
    fields += -fields % 8
    first = fields + 16
    head = struct.pack("<I4sHHHxxiI", 16, b"FTAB", 6, 8, 4, 8, 4)  # the vector follows its reference
    offsets = b"".join(struct.pack("<I", first + 48 * i - (28 + 4 * i)) for i in range(n))
    body = (head + struct.pack("<I", n) + offsets).ljust(fields, b"\0") + struct.pack("<HHHHHHH", 14, 48, 8, 40, 16, 24, 32) + bytes(2)
    rows = b"".join(struct.pack("<iiqqqqii", first + 48 * i - fields, 0, a, count, t0, t1, track, size) for i, (a, track, size, count, t0, t1) in enumerate(index))
    return struct.pack("<I", len(body) + len(rows)) + body + rows


def aedat_head_size(start: bytes) -> int:
    """How many bytes the header takes that ``start`` (18 bytes or more) begins with."""
    return 18 + struct.unpack_from("<I", start, 14)[0]


def aedat_index(data: bytes) -> list[tuple[int, int, int, int, int, int]]:
    """Byte offset, track, size, elements, first and last time of each packet, from the table at the end; a reader may skip by it."""
    h = aedat_header(data)
    return aedat_table(data[h.more["end"] :], h.more["compression"]) if h.more["end"] < len(data) else []


def aedat_table(table: bytes, compression: int) -> list[tuple[int, int, int, int, int, int]]:
    """The rows of an index table's bytes."""
    out = []
    for row in _root(_opened(table, compression), 4).tables(0):
        at = row.place(1)
        track, size = struct.unpack_from("<ii", row.data, at) if at else (0, 0)
        out.append((row.scalar(0, "q"), track, size, row.scalar(2, "q"), row.scalar(3, "q"), row.scalar(4, "q")))
    return out


# -- in parts


@dataclass(frozen=True)
class Writer:
    """Makes the bytes of a file from runs of events, each of which may be encoded elsewhere.

    A file is ``head``, then the ``body`` of each run in order, then ``tail``.
    A run needs to know only the time before its first event, and where
    ``chained`` is false not even that. Times are those after ``t0``.
    """

    kind: str
    width: int
    height: int
    version: str = ""
    compression: tuple[str, int] | None = None

    @property
    def chained(self) -> bool:
        return self.kind != "aedat"

    def head(self, t0: int, body: int) -> bytes:
        """The start of a file whose bodies take so many bytes."""
        if self.kind == "dat":
            return _dat_head(self.width, self.height, self.version, t0)
        if self.kind == "evt":
            return _evt_head(self.width, self.height, self.version, t0)
        return _es_head(self.width, self.height) if self.kind == "es" else _aedat_head(self.width, self.height, self._squeeze[0], body)

    @property
    def _squeeze(self) -> tuple[str, int]:
        return self.compression or ("none", 0)

    def body(self, c: Columns, before: int | None = None) -> tuple[bytes, np.ndarray]:
        """The bytes of some events after one of time ``before``, and the index of their packets."""
        if len(c["t"]) and before is not None and c["t"][0] < before:
            raise ValueError("times must not decrease")
        _ordered(c["t"])
        _inside(c["x"], c["y"], self.width, self.height)
        none = np.empty((0, 5), np.int64)
        if self.kind == "dat":
            return _dat_body(c, self.version, before), none
        if self.kind == "es":
            return _es_body(c, self.height, before), none
        if self.kind == "evt":
            columns = (c[k].astype(np.int64) for k in ("t", "x", "y", "on"))
            return (_encode_evt2 if self.version == "2" else _encode_evt3)(*columns, before), none
        return _aedat_body(c, *self._squeeze)

    def tail(self, index: np.ndarray, start: int) -> bytes:
        """The end of a file whose bodies start at ``start``."""
        if self.kind != "aedat":
            return b""
        return _squeezed(_file_table([(start + at, 0, size, n, a, z) for at, size, n, a, z in index.tolist()]), *self._squeeze)


def _encoded(w: Writer, c: Columns, zero_t0: bool) -> tuple[bytes, int]:
    """The bytes of a whole file, and the time that is left out."""
    t0 = int(c["t"][0]) if zero_t0 and len(c["t"]) else 0
    w.head(t0, 0)
    body, index = w.body(c | {"t": np.asarray(c["t"], np.int64) - t0})
    head = w.head(t0, len(body))
    return head + body + w.tail(index, len(head)), t0


def parts(kind: str, f: BinaryIO, dimensions=(1280, 720), version: str | None = None, t0: int | None = None, track_id: int | None = None, triggers: bool = False) -> tuple[Header, Iterator[Columns]]:
    """The header of an open file, and its columns block by block; of an EVT file its events, or its triggers."""
    if kind == "dat":
        return _dat_parts(f, dimensions, version or "2", t0)
    if kind == "evt":
        h, found = _evt_parts(f, dimensions, version or "3", t0)
        return h, (c[triggers] for c in found)
    return _aedat_parts(f, track_id) if kind == "aedat" else _es_parts(f, t0 or 0)
