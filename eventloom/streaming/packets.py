"""Live packets: byte forms, late packets, and time that wraps.

A packet is late when its first time is before the last time of the packet
accepted before it; late packets are dropped whole. Packets with 32-bit times
that step back by more than half the range have wrapped instead. Both need
what came before, which is kept as keyed state of the streaming query. The
state's task looks at the times of packets only and passes their bytes on;
events are made of them by all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed values of the wire forms: 13 and 8 bytes an event.
T64 = np.dtype([("t", "<u8"), ("x", "<u2"), ("y", "<u2"), ("on", "?")])
T32 = np.dtype([("t", "<u4"), ("x", "<u2"), ("y_on", "<u2")])
FORMATS = {"t64_x16_y16_on8": T64, "t32_x16_y15_on1": T32}
OUT = "stream string, packet long, seq long, t long, x int, y int, on boolean"
STATE = "last long, offset long, count long"


def encode(t: np.ndarray, x: np.ndarray, y: np.ndarray, on: np.ndarray, form: str) -> bytes:
    out = np.zeros(len(t), FORMATS[form])
    out["x"] = x
    if form == "t64_x16_y16_on8":
        out["t"], out["y"], out["on"] = t, y, on
    else:
        out["t"], out["y_on"] = np.asarray(t).astype(np.uint64) & np.uint64(0xFFFFFFFF), np.asarray(y).astype(np.int64) << 1 & 0xFFFE | np.asarray(on).astype(np.int64)
    return out.tobytes()


def decode(data: bytes, form: str) -> pd.DataFrame:
    e = np.frombuffer(data, FORMATS[form], len(data) // FORMATS[form].itemsize)
    if form == "t64_x16_y16_on8":
        return pd.DataFrame({"t": e["t"].astype(np.int64), "x": e["x"].astype(np.int32), "y": e["y"].astype(np.int32), "on": e["on"]})
    return pd.DataFrame({"t": e["t"].astype(np.int64), "x": e["x"].astype(np.int32), "y": (e["y_on"] >> 1).astype(np.int32), "on": (e["y_on"] & 1).astype(bool)})


def accept(events: pd.DataFrame, form: str, last: int, offset: int) -> tuple[pd.DataFrame | None, int, int]:
    """The packet with its full times, or None if it is late; and the state after it."""
    if not len(events):
        return None, last, offset
    t = events["t"].to_numpy().astype(np.int64)
    if form == "t32_x16_y15_on1":
        t = t + offset
        if t[0] < last:
            if last - t[0] <= 1 << 31:
                return None, last, offset
            offset += 1 << 32
            t = t + (1 << 32)
        inner = np.cumsum(np.concatenate(([0], np.diff(t) < -(1 << 31)))) << 32  # a wrap within the packet
        t, offset = t + inner, offset + int(inner[-1])
    elif t[0] < last:
        return None, last, offset
    t = np.maximum.accumulate(t)
    return events.assign(t=t), int(t[-1]), offset


#: Packets that are accepted: what is added to their times, and the number of the event before their first.
KEPT = "stream string, packet long, data binary, offset long, before long"
#: Bytes of packets that are looked at together.
TOGETHER = 4 << 20


def _slices(sizes: list[int]) -> Iterator[slice]:
    """Consecutive packets of some ``TOGETHER`` bytes."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= TOGETHER or i + 1 == len(sizes):
            yield slice(start, i + 1)
            start, total = i + 1, 0


def _times(data: list[bytes], form: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The events of packets that aren't empty; their times, in which turns within a packet count; each packet's start, and the turns in it."""
    size = FORMATS[form].itemsize
    e = np.frombuffer(b"".join(d[: len(d) // size * size] for d in data), FORMATS[form])
    counts = np.array([len(d) // size for d in data], np.int64)
    starts = np.cumsum(counts) - counts
    t, turns = e["t"].astype(np.int64), np.zeros(len(data), np.int64)
    if form == "t32_x16_y15_on1":
        steps = np.diff(t, prepend=0) < -(1 << 31)
        steps[starts] = False
        inner = np.cumsum(steps)
        inner -= np.repeat(inner[starts], counts)
        t, turns = t + (inner << 32), inner[starts + counts - 1]
    return e, t, starts, turns


def _accepted(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, form: str) -> Iterator[pd.DataFrame]:
    last, offset, count = state.get if state.exists else (-1, 0, 0)
    size = FORMATS[form].itemsize
    rows = pd.concat([f[["packet", "data"]] for f in frames]).sort_values("packet")
    rows = rows[rows["data"].str.len() >= size]
    for part in _slices(rows["data"].str.len().tolist()):
        packet, data = rows["packet"].iloc[part].to_numpy(), rows["data"].iloc[part].tolist()
        _, t, starts, turns = _times(data, form)
        found = []
        for i, (a, z, n) in enumerate(zip(t[starts].tolist(), np.maximum.reduceat(t, starts).tolist(), turns.tolist(), strict=True)):
            if a + offset < last:
                if form != "t32_x16_y15_on1" or last - a - offset <= 1 << 31:
                    continue
                offset += 1 << 32
            found.append((i, offset, count - 1))
            last, offset, count = z + offset, offset + (n << 32), count + len(data[i]) // size
        if found:
            i, offsets, before = zip(*found, strict=True)
            yield pd.DataFrame({"stream": key[0], "packet": packet[list(i)], "data": [data[k] for k in i], "offset": offsets, "before": before})
    state.update((last, offset, count))


def _unpacked(batches: Iterator[pa.RecordBatch], form: str) -> Iterator[pa.RecordBatch]:
    """The events of accepted packets."""
    for batch in batches:
        every = batch.column("data").to_pylist()
        for part in _slices([len(d) for d in every]):
            e, t, starts, _ = _times(every[part], form)
            counts = np.diff(starts, append=len(t))
            own = batch.slice(part.start, part.stop - part.start)
            whose = np.repeat(np.arange(len(counts)), counts)
            t = t + own.column("offset").to_numpy()[whose]
            back = np.diff(t, prepend=t[0]) < 0
            back[starts] = False
            for k in np.unique(whose[back]).tolist():  # packets whose times step back
                z = starts[k] + counts[k]
                t[starts[k] : z] = np.maximum.accumulate(t[starts[k] : z])
            y, on = (e["y"], e["on"]) if form == "t64_x16_y16_on8" else (e["y_on"] >> 1, (e["y_on"] & 1).astype(bool))
            columns = [own.column("stream").take(pa.array(whose)), own.column("packet").take(pa.array(whose)), own.column("first").to_numpy()[whose] + np.arange(len(t)) - starts[whose], t, e["x"].astype(np.int32), y.astype(np.int32), on]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["stream", "packet", "seq", "t", "x", "y", "on"])


def accepted_events(packets: DataFrame, form: str = "t64_x16_y16_on8") -> DataFrame:
    """Events of a streaming table (stream string, packet long, data binary), without late packets."""
    kept = packets.groupBy("stream").applyInPandasWithState(lambda k, f, s: _accepted(k, f, s, form), KEPT, STATE, "append", GroupStateTimeout.NoTimeout)
    # A shuffle doesn't take rows as they come from Python's batches, so they are computed.
    return kept.select("stream", "packet", "data", "offset", (F.col("before") + 1).alias("first")).repartition("packet").mapInArrow(lambda batches: _unpacked(batches, form), OUT)


#: Packets of a number that is cut, at most.
CUTS = 1 << 24


def packed(df: DataFrame, form: str, order: tuple[str, ...] = ("seq",), most: int = CUTS) -> DataFrame:
    """``packet, data`` of events with their ``packet``, each by ``order`` within it; packet k of more than ``most`` events gives several, from k times ``CUTS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, packet, done = None, None, 0
        names = ("packet", "t", "x", "y", "on")

        def made(c: dict, number: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
            data, size = encode(*(c[k] for k in names[1:]), form), FORMATS[form].itemsize
            places = [*starts.tolist(), len(number)]
            return pa.RecordBatch.from_arrays([pa.array(number[starts]), pa.array([data[a * size : z * size] for a, z in zip(places, places[1:], strict=False)], pa.binary())], ["packet", "data"])

        for batch in batches:
            c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
            c = {k: np.concatenate((held[k], v)) for k, v in c.items()} if held else c
            n = len(c["packet"])
            if not n:
                continue
            first = np.diff(c["packet"], prepend=c["packet"][0]) != 0
            first[0] = True
            at = np.flatnonzero(first)
            place = np.arange(n) - np.repeat(at, np.diff(at, append=n))
            if packet == c["packet"][0]:
                place[: at[1] if len(at) > 1 else n] += done
            number = c["packet"] * CUTS + place // most if most < CUTS else c["packet"]
            starts = np.flatnonzero(np.diff(number, prepend=number[0] - 1))
            z = starts[-1]  # the last one may go on
            packet, done, held = c["packet"][z], int(place[z]), {k: v[z:] for k, v in c.items()}
            if z:
                yield made({k: v[:z] for k, v in c.items()}, number[:z], starts[:-1])
        if held:
            yield made(held, held["packet"] * CUTS + done // most if most < CUTS else held["packet"], np.array([0]))

    sorted_ = df.repartition("packet").sortWithinPartitions("packet", *order)
    return sorted_.select("packet", "t", "x", "y", "on").mapInArrow(run, "packet long, data binary")


LAST = "x int, y int, seq long, t long, on boolean"


def _last(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    best = state.get if state.exists else (-1, 0, False)
    for pdf in frames:
        row = pdf.loc[pdf["seq"].idxmax()]
        if row["seq"] > best[0]:
            best = (int(row["seq"]), int(row["t"]), bool(row["on"]))
    state.update(best)
    yield pd.DataFrame({"x": [key[0]], "y": [key[1]], "seq": [best[0]], "t": [best[1]], "on": [best[2]]})


def last_event_by_pixel(events: DataFrame) -> DataFrame:
    """Each pixel's last event so far, whenever it changes: the renderer's state, which is as large as the sensor."""
    return events.groupBy("x", "y").applyInPandasWithState(_last, LAST, "seq long, t long, on boolean", "update", GroupStateTimeout.NoTimeout)
