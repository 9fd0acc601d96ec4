"""Animated GIF files: images are compressed on the executors and joined in playing order by the driver."""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

MOST = 4096


def palette(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A colour for each index and the image's indices: its own colours if 256 do, else three, three and two bits of each."""
    flat = image[..., :3].reshape(-1, 3).astype(np.int64)
    packed = flat[:, 0] << 16 | flat[:, 1] << 8 | flat[:, 2]
    colors, index = np.unique(packed, return_inverse=True)
    if len(colors) > 256:
        coarse = flat[:, 0] >> 5 << 5 | flat[:, 1] >> 5 << 2 | flat[:, 2] >> 6
        k = np.arange(256)
        return np.stack((k >> 5, k >> 2 & 7, k & 3), 1) * np.array([255 / 7, 255 / 7, 255 / 3]) + 0.5, coarse
    return np.stack((colors >> 16, colors >> 8 & 255, colors & 255), 1), index.ravel()


def squeezed(symbols: np.ndarray, bits: int) -> bytes:
    """``symbols`` of so many bits in the format's variable-width codes."""
    clear, codes, out, held, width, buffer = 1 << bits, {}, bytearray(), 0, bits + 1, 0
    free = clear + 2

    def put(code: int) -> None:
        nonlocal buffer, held
        buffer |= code << held
        held += width
        while held >= 8:
            out.append(buffer & 255)
            buffer >>= 8
            held -= 8

    put(clear)
    now = None
    for s in symbols.tolist():
        if now is None:
            now = s
            continue
        known = codes.get((now, s))
        if known is not None:
            now = known
            continue
        put(now)
        if free < MOST:
            codes[(now, s)] = free
            if free == 1 << width:
                width += 1
            free += 1
        else:
            put(clear)
            codes, free, width = {}, clear + 2, bits + 1
        now = s
    if now is not None:
        put(now)
        if free == 1 << width and width < 12:
            width += 1
    put(clear + 1)
    return bytes(out) + bytes((buffer & 255,)) * (held > 0)


def image_block(image: np.ndarray, delay: int) -> bytes:
    """One image with its colours; ``delay`` is in hundredths of a second."""
    colors, index = palette(image)
    bits = max(2, int(len(colors) - 1).bit_length())
    table = np.zeros((1 << bits, 3), np.uint8)
    table[: len(colors)] = colors
    h, w = image.shape[:2]
    data = squeezed(index, bits)
    blocks = b"".join(bytes((len(data[i : i + 255]),)) + data[i : i + 255] for i in range(0, len(data), 255))
    return b"\x21\xf9\x04\x04" + struct.pack("<H", delay) + b"\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0x80 | bits - 1) + table.tobytes() + bytes((bits,)) + blocks + b"\0"


def write_gif(played: DataFrame, width: int, height: int, path: str, frame_rate: float, on_progress: Callable[[str, int], None] | None = None) -> int:
    """Writes ``played`` (turn, pixels) as a GIF that repeats for ever; returns how many images. ``on_progress`` is told the start, each image and the end."""
    tell, delay = on_progress or (lambda *_: None), max(1, round(100 / frame_rate))

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            made = [image_block(np.frombuffer(p, np.uint8).reshape(height, width, 4), delay) for p in pdf["pixels"]]
            yield pdf.assign(block=made)[["turn", "block"]]

    count = 0
    tell("start", 0)
    temporary = f"{path}.write"
    with open(temporary, "wb") as f:
        f.write(b"GIF89a" + struct.pack("<HHBBB", width, height, 0x70, 0, 0) + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0")
        for row in played.select("turn", "pixels").mapInPandas(run, "turn long, block binary").orderBy("turn").toLocalIterator():
            f.write(row.block)
            count += 1
            tell("image", count)
        f.write(b"\x3b")
    os.replace(temporary, path)
    tell("end", count)
    return count


def read_gif(data: bytes) -> list[np.ndarray]:
    """The images of a GIF of whole images with colours of their own, as (height, width, 3) bytes."""
    if data[:4] != b"GIF8":
        raise ValueError("not a GIF file")
    at, out = 13 + (3 << (data[10] & 7) + 1 if data[10] & 0x80 else 0), []
    while data[at] != 0x3B:
        if data[at] == 0x21:
            at += 2
        else:
            w, h, flags = struct.unpack_from("<HHB", data, at + 5)
            colors = np.frombuffer(data, np.uint8, 3 << (flags & 7) + 1, at + 10).reshape(-1, 3)
            at += 10 + colors.size
            bits, body, at = data[at], bytearray(), at + 1
            while data[at]:
                body += data[at + 1 : at + 1 + data[at]]
                at += 1 + data[at]
            at += 1
            out.append(colors[_opened(bytes(body), bits)[: w * h]].reshape(h, w, 3))
            continue
        while data[at]:
            at += 1 + data[at]
        at += 1
    return out


def _opened(data: bytes, bits: int) -> np.ndarray:
    clear, out, known, width, last = 1 << bits, [], [], bits + 1, None
    buffer = held = 0
    for byte in data:
        buffer |= byte << held
        held += 8
        while held >= width:
            code, buffer, held = buffer & (1 << width) - 1, buffer >> width, held - width
            if code == clear:
                known, width, last = [(s,) for s in range(clear)] + [(), ()], bits + 1, None
                continue
            if code == clear + 1:
                return np.array(out, np.int64)
            entry = known[code] if code < len(known) else (*last, last[0])
            out.extend(entry)
            if last is not None and len(known) < MOST:
                known.append((*last, entry[0]))
                if len(known) == 1 << width and width < 12:
                    width += 1
            last = entry
    return np.array(out, np.int64)
