"""``spark.read.format("event_file")``: byte-format recordings by Spark's data source interface.

Options: ``path`` (a file, or a folder of them, that all executors see),
``file_type``, ``kind``, ``version`` and ``track``. One partition for each
file, but for AEDAT files with an index: their packets are dealt to several,
and a filter on ``t`` skips packets by the index.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from eventloom.model import EVENT
from eventloom.sources import codecs
from eventloom.sources.files import RECORDS, batches_of, decoded

PACKETS_PER_PARTITION = 256


class Part(InputPartition):
    def __init__(self, path: str, packets: list | None = None, first: int = 0):
        self.path, self.packets, self.first = path, packets, first


def _head(f) -> bytes:
    """The header of an open AEDAT file."""
    start = f.read(18)
    return start + f.read(codecs.aedat_head_size(start) - 18)


class EventFileReader(DataSourceReader):
    def __init__(self, options: dict):
        path = options["path"].removeprefix("file://")
        self.paths = sorted(p for p in glob.glob(os.path.join(path, "*")) if os.path.isfile(p)) if os.path.isdir(path) else [path]
        self.type, self.kind = options.get("file_type"), options.get("kind", "events")
        self.version, self.track = options.get("version"), int(options["track"]) if "track" in options else None
        self.low, self.high = -(1 << 63), (1 << 63) - 1

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if getattr(f, "attribute", None) == ("t",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value)
            yield f  # packets are skipped, rows are still filtered by Spark

    def partitions(self) -> list[Part]:
        out = []
        for path in self.paths:
            with open(path, "rb") as f:
                start = f.read(16)
            if self.kind == "events" and (self.type or codecs.detect(path, start)) == "aedat":
                with open(path, "rb") as f:  # the header and the index only
                    h = codecs.aedat_header(_head(f))
                    f.seek(h.more["end"])
                    table = f.read() if h.more["end"] > h.more["start"] else b""
                track = next(k["id"] for k in h.more["tracks"] if (k["data_type"] == "events" if self.track is None else k["id"] == self.track))
                index = [r for r in codecs.aedat_table(table, h.more["compression"]) if r[1] == track] if table else []
                if index:
                    before = np.concatenate(([0], np.cumsum([r[3] for r in index]))).tolist()
                    hit = [(r, b) for r, b in zip(index, before, strict=False) if r[5] >= self.low and r[4] <= self.high]
                    out += [Part(path, hit[i : i + PACKETS_PER_PARTITION]) for i in range(0, len(hit), PACKETS_PER_PARTITION)]
                    continue
            out.append(Part(path))
        return out or [Part("")]

    def read(self, partition: Part) -> Iterator:
        if not partition.path:
            return
        schema = EVENT if self.kind == "events" else RECORDS[self.kind]
        if partition.packets is None:
            with open(partition.path, "rb") as f:
                yield from batches_of(schema, decoded(self.type, partition.path, f, (1280, 720), self.version, None, self.track, self.kind))
            return
        import pyarrow as pa

        with open(partition.path, "rb") as f:
            squeezed = codecs.aedat_header(_head(f)).more["compression"]
            for (at, _, size, _, _, _), first in partition.packets:
                f.seek(at + 8)
                c = codecs.event_packet(f.read(size), squeezed)
                seq = np.arange(first, first + len(c["t"]))
                yield pa.RecordBatch.from_arrays([pa.array(seq), *(pa.array(c[k]) for k in ("t", "x", "y", "on"))], ["seq", "t", "x", "y", "on"])


class EventFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_file"

    def schema(self) -> str:
        kind = self.options.get("kind", "events")
        return EVENT if kind == "events" else RECORDS[kind]

    def reader(self, schema) -> EventFileReader:
        return EventFileReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(EventFile)
