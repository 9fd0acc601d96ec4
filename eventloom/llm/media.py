"""Media columns: payloads kept in progressive JPEG files.

A text's UTF-8 bytes, filled up with zeros to a positive multiple of 64, are
the quantised coefficients of an image (a byte less ``BIAS`` each, 64 to a
block): the format's own unit, which its entropy coding keeps losslessly. The
file is read back by accumulating its scans into coefficient arrays; from
these come the payload again, and by inverse transform and chroma upsampling
the RGB tensor at full resolution.

Defined results: a null text counts as empty; equal texts give equal values
(all arithmetic is exact); each row is handled on its own, so repeated rows
agree; a text of any length is one image, made in its own task; an empty table
gives one; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm import progressive_jpeg as jpeg
from eventloom.llm.common import read

UNIT = 64
#: Lower-case letters become small coefficients.
BIAS = 96
#: Files are made and read together up to about so many payload bytes.
TOGETHER = 1 << 20

DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
TENSOR = "doc_id long, media binary, height int, width int, rgb binary"


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % UNIT if data else UNIT)


def as_image(payload: bytes) -> tuple[int, int, np.ndarray, bytes]:
    blocks = len(payload) // UNIT
    rows, columns = jpeg.grid(blocks)
    c = np.zeros((rows * columns * jpeg.MCU_BLOCKS, 64), np.int32)
    c[:blocks] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT).astype(np.int32) - BIAS
    return rows, columns, c, b"payload %d" % len(payload)


def payload_of(info: dict) -> bytes:
    n = int(info["comment"].split()[1])
    return (info["coefficients"][: n // UNIT] + BIAS).astype(np.uint8).tobytes()


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel, and share of horizontal change, from exact sums."""
    n = rgb.shape[0] * rgb.shape[1]
    means = [rgb[:, :, k].sum(dtype=np.int64) for k in range(3)]
    change = int(np.abs(np.diff(rgb[:, :, 1].astype(np.int16), axis=1)).sum(dtype=np.int64))
    return f"{rgb.shape[0]}x{rgb.shape[1]};" + ",".join(f"{1000 * int(m) // n}" for m in means) + f";{1000 * change // n}"


def _together(payloads: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for p in payloads:
        part.append(p)
        size += len(p)
        if size >= TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


def _mapped(docs: DataFrame, key: Column, text: Column, schema: str, row: Callable) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            i = 0
            while i < len(rows):
                j, size = i, 0
                while j < len(rows) and size < 8 * TOGETHER:
                    size += len(rows[j][1] or "") + UNIT
                    j += 1
                part = [(k, (t or "").encode()) for k, t in rows[i:j]]
                done: dict[bytes, tuple] = {}
                for group in _together([padded(d) for d in dict.fromkeys(d for _, d in part)]):
                    files = jpeg.encode([as_image(p) for p in group])
                    images = jpeg.decode(files)
                    jpeg.samples(images)
                    for p, f, info in zip(group, files, images, strict=True):
                        done[p] = row(f, info)
                out = [(k, *done[padded(d)]) if "n_bytes" not in names else (k, len(d), *done[padded(d)]) for k, d in part]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                i = j

    return docs.select(key.cast("long").alias("key"), text.alias("text")).mapInArrow(run, schema)


def digests(docs: DataFrame, key: Column, text: Column) -> DataFrame:
    """``DIGEST`` for each row: what was stored, read back, and its features."""

    def row(media: bytes, info: dict) -> tuple:
        payload = payload_of(info)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(jpeg.to_rgb(info))

    return _mapped(docs, key, text, DIGEST, row)


def tensors(docs: DataFrame, key: Column, text: Column) -> DataFrame:
    """``TENSOR`` for each row: the file and the RGB tensor at full resolution."""

    def row(media: bytes, info: dict) -> tuple:
        rgb = jpeg.to_rgb(info)
        return media, rgb.shape[0], rgb.shape[1], rgb.tobytes()

    return _mapped(docs, key, text, TENSOR, row)


def query(spark, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))
