"""Recordings as event streams, and back.

Readers go through Spark's own file sources, so any store that Spark reads
will do. Byte formats are serial within a file, so each file is one task, which
decodes it block by block; CSV is read in parallel. Writers sort rows by arrival
and encode them in the tasks, block by block, into files of a folder that all
executors share; the driver joins these into a temporary file that is then
renamed. No task or driver holds a file.
"""

from __future__ import annotations

import io
import json
import os
import re
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.functions.timecode import to_timecode
from eventloom.model import EVENT, EventStream
from eventloom.operators.order import running_max
from eventloom.sources import codecs

#: Rows of other records, by format and kind.
RECORDS = {
    "atis": "seq long, t long, x int, y int, exposure boolean, polarity boolean",
    "color": "seq long, t long, x int, y int, r smallint, g smallint, b smallint",
    "generic": "seq long, t long, bytes binary",
    "triggers": "seq long, t long, source smallint",
    "evt_triggers": "seq long, t long, source smallint, rising boolean",
    "imus": "seq long, t long, " + ", ".join(f"{k} float" for k in codecs.IMU_FIELDS),
    "frame": "seq long, t long, start_t long, end_t long, exposure_start_t long, exposure_end_t long, format long, width long, height long, offset_x long, offset_y long, pixels binary",
}


@dataclass(frozen=True)
class CsvProperties:
    has_header: bool = True
    separator: str = ","
    t_index: int = 0
    x_index: int = 1
    y_index: int = 2
    on_index: int = 3
    t_scale: float = 0.0
    on_value: str = "1"
    off_value: str = "0"
    skip_errors: bool = False

    def __post_init__(self):
        if len({self.t_index, self.x_index, self.y_index, self.on_index}) < 4:
            raise ValueError("each field needs a column of its own")


def parse_csv(rows: DataFrame, width: int, height: int, t0: int = 0, properties: CsvProperties = CsvProperties()) -> DataFrame:
    """Events from (seq, value) lines. A bad line is an error, or left out with ``skip_errors``; times are clamped to their running maximum."""
    p = properties
    # Java splits at one character without compiling a pattern.
    at = "\\" + p.separator if len(p.separator) == 1 and not p.separator.isalnum() else "\\Q" + p.separator + "\\E"

    def event(cells: Column) -> Column:
        cell = lambda i: F.btrim(F.get(cells, F.lit(i)), F.lit(" \t\r\n"))
        t = cell(p.t_index).try_cast("long") if p.t_scale == 0 else F.round(cell(p.t_index).try_cast("double") * p.t_scale, 0).cast("long")
        on = F.when(cell(p.on_index) == p.on_value, True).when(cell(p.on_index) == p.off_value, False)
        return F.struct((t + t0).alias("t"), cell(p.x_index).try_cast("int").alias("x"), cell(p.y_index).try_cast("int").alias("y"), on.alias("on"))

    def kept(e: Column) -> Column:
        good = F.coalesce(e.t.isNotNull() & e.x.between(0, width - 1) & e.y.between(0, height - 1) & e.on.isNotNull(), F.lit(False))
        return good if p.skip_errors else F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not an event: "), F.col("value"))).cast("boolean"))

    # A filter of columns would be pushed below them, and split the line anew for each; a variable of an array's function is made once.
    found = F.filter(F.transform(F.array(F.split("value", at, -1)), event), kept)
    out = rows.where(F.btrim("value", F.lit(" \t\r\n")) != "").select("seq", F.inline(found))
    return running_max(out, "t").select("seq", "t", "x", "y", "on")


#: Events of the file of rank k, by path, are numbered from k times this.
PER_FILE = 1 << 44


def paths_of(spark: SparkSession, path: str) -> list[str]:
    """The files under ``path`` in order; their contents aren't read."""
    return sorted(r.path for r in spark.read.format("binaryFile").load(path).select("path").collect())


def read_csv(spark: SparkSession, path: str, dimensions: tuple[int, int], t0: int = 0, properties: CsvProperties = CsvProperties()) -> EventStream:
    """The lines of one file, or of the files of a folder one after the other, each without its header."""
    names = paths_of(spark, path)
    lines = spark.read.text(path)
    if len(names) == 1:
        lines = lines.withColumn("seq", F.monotonically_increasing_id())
        lines = lines.where("seq > 0") if properties.has_header else lines
    else:  # lines are numbered within the blocks that are read as one, from the block's first byte
        ranks = F.broadcast(spark.createDataFrame([(n, k) for k, n in enumerate(names)], "file string, rank long"))
        lines = lines.select("value", F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("any"))
        place = F.row_number().over(Window.partitionBy("file", "block").orderBy("any")) - 1
        lines = lines.withColumn("place", place).join(ranks.withColumn("file", F.regexp_replace("file", "^file:/+", "file:/")), "file")
        lines = lines.where("NOT (block = 0 AND place = 0)") if properties.has_header else lines
        lines = lines.select((F.col("rank") * PER_FILE + F.col("block") + F.col("place")).alias("seq"), "value")
    return EventStream(parse_csv(lines, *dimensions, t0, properties), *dimensions)


#: Rows of a batch that is read or encoded, a whole number of AEDAT packets; and bytes of a slice of a file.
ROWS, SLICE = 1 << 16, 4 << 20


def _batch(schema: str, columns: dict[str, np.ndarray], base: int = 0) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "boolean": pa.bool_(), "float": pa.float32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    n = len(columns["t"])
    for i in range(0, n, ROWS):
        part = {k: v[i : i + ROWS] for k, v in columns.items()}
        part["seq"] = base + np.arange(i, min(n, i + ROWS))
        yield pa.RecordBatch.from_arrays([pa.array(part[k].tolist() if kind == "binary" else part[k], kinds[kind]) for k, kind in fields], [k for k, _ in fields])


def decoded(file_type: str | None, name: str, f: BinaryIO, dimensions, version, t0, track_id, kind: str) -> Iterator[codecs.Columns]:
    """The records of an open file block by block; plain events of ATIS streams are those that aren't exposure marks, of DAT those of kind cd."""
    file_type = file_type or codecs.detect(name, f.peek(16)[:16])
    h, found = codecs.parts(file_type, f, dimensions, version, t0, track_id, kind == "evt_triggers")
    if kind == "events" and (file_type, h.kind) == ("es", "atis"):
        for c in found:
            plain = ~c["exposure"]
            yield {"t": c["t"][plain], "x": c["x"][plain], "y": c["y"][plain], "on": c["polarity"][plain]}
        return
    if kind == "events" and (file_type == "dat" and h.kind != "cd" or file_type == "es" and h.kind != "dvs"):
        raise ValueError(f"{'a DAT' if file_type == 'dat' else 'an Event Stream'} file of kind {h.kind} holds no events")
    yield from found


def batches_of(schema: str, found: Iterator[codecs.Columns], base: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows of ``schema`` with their ``seq``; small blocks are put together."""
    held, rows = [], 0
    for c in found:
        held.append(c)
        rows += len(c["t"])
        if rows >= ROWS:
            yield from _batch(schema, {k: np.concatenate([x[k] for x in held]) for k in c}, base)
            base, held, rows = base + rows, [], 0
    if rows:
        yield from _batch(schema, {k: np.concatenate([x[k] for x in held]) for k in held[0]}, base)


def local(path: str) -> str | None:
    """The path to open where ``path`` is in the file system that driver and executors share, else None."""
    return re.sub("^file:/*", "/", path) if path.startswith(("/", "file:/")) else None


class _Slices(io.RawIOBase):
    """A file to read, of its slices in order."""

    def __init__(self, slices: Iterator[bytes]):
        self.slices, self.rest = slices, b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while not self.rest:
            self.rest = next(self.slices, None)
            if self.rest is None:
                self.rest = b""
                return 0
        n = min(len(out), len(self.rest))
        out[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def records(spark: SparkSession, path: str, kind: str = "events", *, file_type: str | None = None, track_id: int | None = None, dimensions_fallback=(1280, 720), version_fallback: str | None = None, t0: int | None = None) -> DataFrame:
    """The rows of one kind in a byte-format file, or in those of a folder one after the other: ``events`` or a key of ``RECORDS``."""
    schema = EVENT if kind == "events" else RECORDS[kind]
    ranks = {name: k for k, name in enumerate(paths_of(spark, path))}
    read = spark.read.format("binaryFile").load(path)

    def rows(name: str, f: BinaryIO) -> Iterator[pa.RecordBatch]:
        return batches_of(schema, decoded(file_type, name, f, dimensions_fallback, version_fallback, t0, track_id, kind), ranks[name] * PER_FILE)

    def opened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with open(local(name), "rb") as f:
                    yield from rows(name, f)

    if all(local(name) for name in ranks):
        return read.select("path").mapInArrow(opened, schema)

    def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task has the slices of a file one after the other."""
        pieces = ((name, data or b"") for batch in batches for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        ahead = next(pieces, None)
        while ahead:

            def own(name: str) -> Iterator[bytes]:
                nonlocal ahead
                while ahead and ahead[0] == name:
                    data, ahead = ahead[1], next(pieces, None)
                    yield data

            name, left = ahead[0], own(ahead[0])
            yield from rows(name, io.BufferedReader(_Slices(left), 1 << 16))
            for _ in left:
                pass

    # Other stores are read by Spark, which gives a file as a whole; Python takes it in slices.
    size = F.length("content")
    cut = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / SLICE).cast("int")), lambda i: F.substring(F.col("content"), i * SLICE + 1, F.lit(SLICE)))
    return read.select("path", F.explode_outer(F.when(size > 0, cut)).alias("slice")).mapInArrow(sliced, schema)


def header(spark: SparkSession, path: str, file_type: str | None = None, dimensions_fallback=(1280, 720), version_fallback: str | None = None, track_id: int | None = None) -> codecs.Header:
    """The header alone: the first MB of the file reaches the driver, or as much as an AEDAT file's description takes."""
    name = paths_of(spark, path)[0]

    def first(size: int) -> bytes:
        if local(name):
            with open(local(name), "rb") as f:
                return f.read(size)
        return bytes(spark.read.format("binaryFile").load(name).select(F.substring("content", 1, size)).first()[0])

    data = first(1 << 20)
    kind = file_type or codecs.detect(name, data[:16])
    if kind == "aedat" and codecs.aedat_head_size(data) > len(data):
        data = first(codecs.aedat_head_size(data))
    if kind in ("dat", "evt"):
        return codecs.percent_header(data, dimensions_fallback, version_fallback)
    if kind == "es":
        return codecs.decode_es(data[:20])[0]
    h = codecs.aedat_header(data)
    track = next(k for k in h.more["tracks"] if (k["data_type"] == "events" if track_id is None else k["id"] == track_id))
    h.width, h.height = track["width"], track["height"]
    return h


def events_stream_from_file(spark: SparkSession, path: str, *, track_id: int | None = None, dimensions_fallback=(1280, 720), version_fallback: str | None = None, t0: int | None = None, file_type: str | None = None, csv_properties: CsvProperties = CsvProperties()) -> EventStream:
    kind = file_type or (codecs.detect(path, b"") if any(path.lower().endswith(e) for e in codecs.EXTENSIONS) else None)
    if kind == "csv":
        return read_csv(spark, path, dimensions_fallback, t0 or 0, csv_properties)
    h = header(spark, path, file_type, dimensions_fallback, version_fallback, track_id)
    return EventStream(records(spark, path, file_type=file_type, track_id=track_id, dimensions_fallback=dimensions_fallback, version_fallback=version_fallback, t0=t0), h.width, h.height)


def events_stream_from_stdin(spark: SparkSession, dimensions: tuple[int, int], t0: int = 0, csv_properties: CsvProperties = CsvProperties(), lines: Iterable[str] | None = None) -> EventStream:
    """CSV from standard input, which the driver copies block by block to a file that executors share."""
    folder = scratch(spark, "stdin")
    lines = sys.stdin if lines is None else lines
    if not folder:  # no file that all see, so the driver keeps the lines
        rows = list(enumerate(x.rstrip("\r\n") for x in lines))[int(csv_properties.has_header) :]
        return EventStream(parse_csv(spark.createDataFrame(rows, "seq long, value string"), *dimensions, t0, csv_properties), *dimensions)
    with open(f"{folder}/in.csv", "w", newline="", encoding="utf-8", errors="surrogateescape") as f:
        if isinstance(lines, io.TextIOBase):
            shutil.copyfileobj(lines, f, 1 << 20)
        else:
            f.writelines(x.rstrip("\r\n") + "\n" for x in lines)
    return read_csv(spark, f"file://{folder}/in.csv", dimensions, t0, csv_properties)


def cached_time_range(stream: EventStream, path: str, cache: str, **options) -> tuple[int, int]:
    """The stream's time range, kept in a JSON file by path, size, time of change and options."""
    about = os.stat(path)
    key = json.dumps([os.path.abspath(path), about.st_size, about.st_mtime_ns, sorted(options.items())])
    known = {}
    if os.path.exists(cache):
        with open(cache) as f:
            known = json.load(f)
    if key not in known:
        known[key] = list(stream.time_range())
        with open(f"{cache}.write", "w") as f:
            json.dump(known, f)
        os.replace(f"{cache}.write", cache)
    return tuple(known[key])


# -- writing


def scratch(spark: SparkSession, name: str) -> str | None:
    """A new folder that driver and executors share: in ``spark.checkpoint.dir``, or without it, in a local session, a temporary one; None where there is none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared and urlparse(shared).scheme in ("", "file"):
        folder = os.path.join(urlparse(shared).path, f"{name}-{uuid.uuid4().hex}")
        os.makedirs(folder)
        return folder
    return tempfile.mkdtemp(prefix=f"eventloom-{name}-") if spark.sparkContext.master.startswith("local") else None


def csv_lines(stream: EventStream, separator: str = ",", with_header: bool = True) -> Iterator[str]:
    if with_header:
        yield _csv_head(stream, separator)
    for row in stream.df.orderBy("seq").select(_csv_line(separator)).toLocalIterator(prefetchPartitions=True):
        yield row.line + "\r\n"


def _csv_head(stream: EventStream, separator: str) -> str:
    return separator.join(("t", f"x@{stream.width}", f"y@{stream.height}", "on")) + "\r\n"


def _csv_line(separator: str):
    return F.concat_ws(separator, "t", "x", "y", F.col("on").cast("int")).alias("line")


#: What a task says of the run that it wrote: its place, file (or its bytes, without a shared folder), first event, last time and index, or what is wrong.
RUN = "part int, path string, size long, data binary, t long, x int, y int, on boolean, last long, index binary, wrong string"


def _lines(columns: dict[str, pa.Array], ordered: bool, before: int | None) -> bytes:
    """The bytes of CSV lines, whose times must not decrease if ``ordered``."""
    if ordered and len(columns["t"]):
        t = columns["t"].to_numpy(zero_copy_only=False)
        if columns["t"].null_count or (np.diff(t) < 0).any() or before is not None and t[0] < before:
            raise ValueError("times must not decrease")
    ended = pc.binary_join_element_wise(columns["line"].cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\r\n", pa.large_string()))
    offsets = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
    return memoryview(ended.buffers()[2])[offsets[0] : offsets[-1]] if len(ended) else b""


def _run_of(batches: Iterable[pa.RecordBatch], out: BinaryIO, writer: codecs.Writer | None, t0: int, ordered: bool) -> dict:
    """Writes a task's events to ``out``. If a run's bytes depend on the time before, its first event is left to the driver, which knows it."""
    first = last = None
    index, at, held, rows = [], 0, [], 0

    def flush(n: int) -> None:
        nonlocal first, last, at, held, rows
        table = pa.Table.from_batches(held)
        head, rest = table.slice(0, n), table.slice(n)
        held, rows = rest.to_batches(), rest.num_rows
        if writer is None:
            columns = {k: head[k].combine_chunks() for k in head.column_names}
            data, first = _lines(columns, ordered, last), head["t"][0].as_py() if first is None else first
            last = head["t"][-1].as_py()
        else:
            c = {k: head[k].to_numpy() for k in ("t", "x", "y", "on")}
            c["t"] = c["t"].astype(np.int64) - t0
            if first is None:
                first = {k: c[k][0].item() for k in c}
                if writer.chained:
                    c, last = {k: v[1:] for k, v in c.items()}, first["t"]
                    writer.body({k: np.array([v]) for k, v in first.items()} | {"t": np.zeros(1, np.int64)})  # is it on the sensor?
            data, own = writer.body(c, last)
            index.append(own + np.array([at, 0, 0, 0, 0]))
            last = int(c["t"][-1]) if len(c["t"]) else last
        out.write(data)
        at += len(data)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        while rows >= ROWS:
            flush(ROWS)
    if rows:
        flush(rows)
    first = {"t": first} if writer is None else first or {"t": None}
    return first | {"size": at, "last": last, "index": np.concatenate(index).tobytes() if index else b""}


def _runs(stream: EventStream, folder: str | None, writer: codecs.Writer | None, t0: int, separator: str, ordered: bool) -> Iterator:
    """The runs of a stream in order, each encoded by a task."""
    from pyspark import TaskContext

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        row = dict.fromkeys(f.split()[0] for f in RUN.split(", ")) | {"part": task.partitionId()}
        try:
            if folder:
                row["path"] = f"{folder}/{task.partitionId()}-{task.taskAttemptId()}"
                with open(row["path"], "wb") as out:
                    row |= _run_of(batches, out, writer, t0, ordered)
            else:
                out = io.BytesIO()
                row |= _run_of(batches, out, writer, t0, ordered)
                row["data"] = out.getvalue()
        except ValueError as wrong:
            row["wrong"] = str(wrong)
        yield from pa.Table.from_pylist([row], kinds).to_batches()

    kinds = pa.schema([("part", pa.int32()), ("path", pa.string()), ("size", pa.int64()), ("data", pa.binary()), ("t", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("on", pa.bool_()), ("last", pa.int64()), ("index", pa.binary()), ("wrong", pa.string())])
    columns = ["t", "x", "y", "on"] if writer else ["t", _csv_line(separator)]
    runs = stream.df.orderBy("seq").select(*columns).mapInArrow(encode, RUN)
    return sorted(runs.collect(), key=lambda r: r.part) if folder else runs.toLocalIterator(prefetchPartitions=True)


def _join(runs: Iterable, out: BinaryIO, writer: codecs.Writer | None, ordered: bool) -> np.ndarray:
    """Writes the runs one after the other, and gives the index of all packets."""
    at, last, index = out.tell(), None, [np.empty((0, 5), np.int64)]
    for r in runs:
        if r.wrong:
            raise ValueError(r.wrong)
        if r.t is None and not r.size:
            continue
        if ordered and last is not None and r.t < last:
            raise ValueError("times must not decrease")
        if writer and writer.chained:
            out.write(writer.body({k: np.array([r[k]]) for k in ("t", "x", "y", "on")}, last)[0])
        index.append(np.frombuffer(bytes(r["index"]), np.int64).reshape(-1, 5) + np.array([out.tell() - at, 0, 0, 0, 0]))
        if r.path:
            with open(r.path, "rb") as f:
                shutil.copyfileobj(f, out, 1 << 20)
        else:
            out.write(r.data)
        last = r.last
    return np.concatenate(index)


def write(stream: EventStream, path: str, *, version: str | None = None, zero_t0: bool = True, compression: tuple[str, int] | None = ("zstd", 1), csv_separator: str = ",", csv_header: bool = True, file_type: str | None = None, enforce_monotonic_timestamps: bool = True, on_progress=None) -> str:
    """Writes one file and returns the timecode of its first time, which DAT, ES and EVT files leave out. Called with (``start`` or ``end``, path), ``on_progress`` follows."""
    kind = file_type or codecs.detect(path, b"")
    tell = on_progress or (lambda *_: None)
    tell("start", path)
    temporary = f"{path}.write"
    t0, ordered, writer = 0, enforce_monotonic_timestamps or kind != "csv", None
    if kind != "csv":
        if not enforce_monotonic_timestamps:
            if kind == "aedat":
                raise ValueError("AEDAT files hold no decreasing times")
            stream = stream.apply(lambda df: running_max(df, "t"))
        version = (version or {"dat": "2", "evt": "3"}.get(kind, "")).removeprefix(kind)
        writer = codecs.Writer(kind, stream.width, stream.height, version, compression if kind == "aedat" else None)
        if kind != "aedat" and zero_t0:
            t0 = stream.df.agg(F.min_by("t", "seq")).first()[0] or 0
        head = writer.head(t0, 0)
    else:
        head = _csv_head(stream, csv_separator).encode() if csv_header else b""
    folder = scratch(stream.df.sparkSession, "write")
    try:
        with open(temporary, "wb") as f:
            f.write(head)
            index = _join(_runs(stream, folder, writer, t0, csv_separator, ordered), f, writer, ordered)
            if writer:
                end = f.tell()
                f.write(writer.tail(index, len(head)))
                f.seek(0)
                f.write(writer.head(t0, end - len(head)))
        os.replace(temporary, path)
    finally:
        if folder:
            shutil.rmtree(folder, ignore_errors=True)
    tell("end", path)
    return to_timecode(t0)
