"""UDP: a streaming source of raw packets (at most once) and a sender."""

from __future__ import annotations

import collections
import socket
import threading
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from eventloom.streaming.packets import FORMATS, accepted_events, encode

#: Bytes of a datagram, seconds that a socket waits, and datagrams that one micro-batch takes.
BUFFER, WAIT, PER_BATCH = 65_536, 0.1, 10_000


class UdpReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.stream = f"{options.get('host', '127.0.0.1')}:{options['port']}"
        self.queue: collections.deque = collections.deque()
        self.socket = socket.socket(socket.AF_INET6 if ":" in options.get("host", "") else socket.AF_INET, socket.SOCK_DGRAM)
        self.socket.bind((options.get("host", "127.0.0.1"), int(options["port"])))
        self.socket.settimeout(WAIT)
        self.open = True
        self.sent: dict[int, list] = {}
        threading.Thread(target=self._receive, daemon=True).start()

    def _receive(self) -> None:
        while self.open:
            try:
                self.queue.append(self.socket.recv(BUFFER))
            except TimeoutError:
                continue
            except OSError:
                return

    def initialOffset(self) -> dict:
        return {"packet": 0}

    def read(self, start: dict):
        first = start["packet"]
        rows = []
        while self.queue and len(rows) < PER_BATCH:
            rows.append((self.stream, first + len(rows), self.queue.popleft()))
        self.sent[first] = rows
        return iter(rows), {"packet": first + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([r for rows in self.sent.values() for r in rows if start["packet"] <= r[1] < end["packet"]])

    def commit(self, end: dict) -> None:
        self.sent = {k: v for k, v in self.sent.items() if k >= end["packet"]}


class UdpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_udp"

    def schema(self) -> str:
        return "stream string, packet long, data binary"

    def simpleStreamReader(self, schema) -> UdpReader:
        return UdpReader(self.options)


def events_stream_from_udp(spark: SparkSession, dimensions: tuple[int, int], address: tuple[str, int], form: str = "t64_x16_y16_on8"):
    """An infinite stream; its times don't go back, as late packets are dropped."""
    from eventloom.model import EventStream

    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}")
    spark.dataSource.register(UdpSource)
    raw = spark.readStream.format("event_udp").option("host", address[0]).option("port", str(address[1])).load()
    return EventStream(accepted_events(raw, form), *dimensions, finite=False)


def send(df: DataFrame, address: tuple[str, int], events_per_packet: int = 100, form: str = "t64_x16_y16_on8", pause: float = 0.0) -> int:
    """Sends events in arrival order from the driver, ``events_per_packet`` in each datagram; returns how many datagrams."""
    out, part, count = socket.socket(socket.AF_INET6 if ":" in address[0] else socket.AF_INET, socket.SOCK_DGRAM), [], 0

    def flush() -> None:
        nonlocal count
        t, x, y, on = (np.array(c) for c in zip(*part, strict=True))
        out.sendto(encode(t, x, y, on, form), address)
        part.clear()
        count += 1
        if pause:
            time.sleep(pause)

    with out:
        for row in df.orderBy("seq").select("t", "x", "y", "on").toLocalIterator():
            part.append(tuple(row))
            if len(part) == events_per_packet:
                flush()
        if part:
            flush()
    return count
