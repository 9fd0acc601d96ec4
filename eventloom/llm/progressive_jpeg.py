"""Progressive JPEG coefficients in numpy, for many images at a time.

The decoder accumulates spectral-selection and successive-approximation scans
into coefficient arrays, inverse-transforms them, upsamples chroma and gives
RGB at full resolution. The encoder writes given coefficients losslessly, in
five scans for each component: DC first and refined, two AC bands, and the
refinement of both. All arithmetic is on integers (the transform in doubles
that stay exact), so that results don't depend on how images are batched.

Entropy-coded segments between restart markers are independent; the decoder
steps through all segments of all images of a batch at once, one symbol or
one coefficient position at a time.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Sequence
from functools import cache

import numpy as np

MCU_BLOCKS = 6
DC_INTERVAL = 16
#: (first, last coefficient, high bit, low bit, blocks between restarts) of each component's scans.
SCRIPT = ((0, 0, 0, 1, DC_INTERVAL), (1, 5, 0, 1, 1), (6, 63, 0, 1, 1), (0, 0, 1, 0, DC_INTERVAL), (1, 63, 1, 0, 1))


@cache
def zigzag() -> np.ndarray:
    """The raster place of each coefficient in zigzag order, by walking the anti-diagonals."""
    cells = [(i, j) for i in range(8) for j in range(8)]
    return np.array([8 * i + j for i, j in sorted(cells, key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))])


@cache
def basis() -> np.ndarray:
    """Coefficients in zigzag order to samples in raster order, times 4096, rounded."""
    u = np.arange(8)
    one = np.cos((2 * u[:, None] + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.5), 1.0) / 2
    return np.rint(np.kron(one, one)[:, zigzag()].T * 4096)


def huffman_lists() -> tuple[tuple[list[int], list[int]], tuple[list[int], list[int]]]:
    """(symbols, code lengths) for DC and AC. DC sizes get 4 bits; of AC, the sizes 1 to 7 without a run get 4 bits and the rest 8."""
    dc = list(range(12))
    short = list(range(1, 8))
    rest = [0x00, 0x08, 0xF0, *(r << 4 for r in range(1, 15)), *(r << 4 | s for r in range(1, 16) for s in range(1, 9))]
    return (dc, [4] * 12), (short + rest, [4] * 7 + [8] * len(rest))


def codes(symbols: Sequence[int], lengths: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Canonical code and length for each of 256 symbols."""
    code, bits, now, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s, n in zip(symbols, lengths, strict=True):
        now <<= n - last
        code[s], bits[s], last = now, n, n
        now += 1
    return code, bits


@cache
def lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for every 16 bits, from a DHT body (16 counts, then the symbols)."""
    symbols, lengths = list(table[16:]), [n + 1 for n in range(16) for _ in range(table[n])]
    sym, size = np.zeros(1 << 16, np.int32), np.full(1 << 16, 1, np.int32)
    code, bits = codes(symbols, lengths)
    for s in symbols:
        a = int(code[s]) << (16 - int(bits[s]))
        sym[a : a + (1 << (16 - int(bits[s])))] = s
        size[a : a + (1 << (16 - int(bits[s])))] = bits[s]
    return sym, size


_SIZES = np.array([n.bit_length() for n in range(1 << 12)])


def sizes_of(v: np.ndarray) -> np.ndarray:
    """The number of bits of each magnitude."""
    return _SIZES[np.abs(v)]


def _magnitude(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (np.int64(1) << size) - 1, v)


def pack(segment: np.ndarray, value: np.ndarray, bits: np.ndarray, count: int, restarts: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Items in order, as stuffed bytes with restart markers; and where each segment starts.

    ``restarts`` holds for each segment the number of the marker after it, or -1.
    """
    edges = np.concatenate(([0], np.cumsum(np.bincount(segment, minlength=count))))
    ends = np.concatenate(([0], np.cumsum(bits)))
    total = np.diff(ends[edges])
    size = (total + 7) // 8
    first = np.concatenate(([0], np.cumsum(size)))
    at = ends[:-1] + np.repeat(first[:-1] * 8 - ends[edges[:-1]], np.diff(edges))
    both = value.astype(np.uint64) << (64 - (at & 31) - bits).astype(np.uint64)
    # Items never share a bit, so that sums of their words are the stream.
    word = at >> 5
    opens = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    both, word = np.add.reduceat(both, opens), word[opens]
    # Ones fill each segment's last byte.
    fill = size * 8 - total
    at = first[:-1] * 8 + total
    stream = np.bincount(at >> 5, ((1 << fill) - 1) << (32 - (at & 31) - fill), int(first[-1]) // 4 + 3).astype(np.uint64)
    stream[word] += both >> np.uint64(32)
    stream[word + 1] += both & np.uint64(0xFFFFFFFF)
    raw = stream.astype(">u4").view(np.uint8)[: int(first[-1])]
    full = np.concatenate(([0], np.cumsum(raw == 255)))
    marks = np.concatenate(([0], np.cumsum(restarts >= 0)))
    starts = first + full[first] + 2 * marks
    out = np.zeros(int(starts[-1]), np.uint8)
    out[np.arange(len(raw)) + full[:-1] + 2 * np.repeat(marks[:-1], size)] = raw
    there = np.flatnonzero(restarts >= 0)
    out[starts[there + 1] - 2] = 255
    out[starts[there + 1] - 1] = 0xD0 + restarts[there]
    return out.tobytes(), starts


def _ac_first(c: np.ndarray, first: int, last: int, low: int, table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code, bits = table
    width = last + 1 - first
    own = np.ascontiguousarray(c[:, first : last + 1]).ravel()
    a = np.abs(own) >> low
    place = np.flatnonzero(a > 0)
    row = place // width
    col = place - row * width
    same = np.concatenate(([False], row[1:] == row[:-1]))[: len(row)]
    run = col - np.where(same, np.concatenate(([0], col[:-1]))[: len(row)], -1) - 1
    a = a[place].astype(np.int64)
    size = _SIZES[a]
    symbol = (run % 16 << 4) | size
    tail = np.full(len(c), -1)
    tail[row] = col
    end = tail < last - first
    zrl = run >> 4  # a symbol for every 16 zeros before
    items = np.bincount(row, minlength=len(c)) + np.bincount(row, zrl, len(c)).astype(np.int64) + end
    stop = np.cumsum(items)
    # Each block has its coefficients, with symbols for long runs before them, and then its end.
    value, length = np.full(int(stop[-1]), code[0xF0]), np.full(int(stop[-1]), bits[0xF0])
    at = np.arange(len(row)) + np.cumsum(zrl) + (np.cumsum(end) - end)[row]
    value[at], length[at] = (code[symbol] << size) | np.where(own[place] < 0, (np.int64(1) << size) - 1 - a, a), bits[symbol] + size
    value[stop[end] - 1], length[stop[end] - 1] = code[0], bits[0]
    return np.repeat(np.arange(len(c)), items), value, length


def _ac_refined(c: np.ndarray, first: int, last: int, low: int, table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code, bits = table
    a = np.abs(c[:, first : last + 1]) >> low
    new, zero, old = a == 1, a == 0, a > 1
    zeros = np.cumsum(zero, 1, dtype=np.int16)
    at_event = np.maximum.accumulate(np.where(new, zeros, np.int16(0)), 1)
    since = zeros - np.concatenate((np.zeros((len(a), 1), zeros.dtype), at_event[:, :-1]), 1)
    events = np.cumsum(new, 1, dtype=np.int16)
    long_run = zero & (since % 16 == 0) & (events < events[:, -1:])
    stop = new | long_run
    span = np.cumsum(stop, 1, dtype=np.int32) - stop
    # A span is its symbol, then a correction bit for each coefficient in it that was there before.
    width = last + 1 - first
    flat = np.flatnonzero(stop)
    r = flat // width
    k = flat - r * width
    fresh = new.ravel()[flat]
    run = np.where(fresh, since.ravel()[flat] % 16, 15)
    symbol = (run << 4) | fresh
    sign = (c[r, k + first] > 0).astype(np.int64)
    before = k + 1 - zeros.ravel()[flat] - events.ravel()[flat]  # so many corrections up to a stop
    shift = np.concatenate(([0], before[:-1]))[: len(r)]
    shift[np.concatenate(([True], r[1:] != r[:-1]))[: len(r)]] = 0
    end = ~new[:, -1]
    stops, olds = np.bincount(r, minlength=len(a)), np.count_nonzero(old, 1)
    items = stops + olds + end
    opens = np.cumsum(items) - items
    value, length = np.empty(int(items.sum()), np.int64), np.ones(int(items.sum()), np.int64)
    at = opens[r] + span.ravel()[flat] + shift
    value[at], length[at] = np.where(fresh, (code[symbol] << 1) | sign, code[symbol]), bits[symbol] + fresh
    done = np.zeros(len(a), np.int64)
    done[r] = before
    at = (opens + stops + done)[end]
    value[at], length[at] = code[0], bits[0]
    flat = np.flatnonzero(old)
    ro = flat // width
    at = np.arange(len(flat)) + (opens + 1 - (np.cumsum(olds) - olds))[ro] + span.ravel()[flat]
    value[at] = a.ravel()[flat] & 1
    return np.repeat(np.arange(len(a)), items), value, length


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


@cache
def _dht(which: int) -> bytes:
    symbols, lengths = huffman_lists()[which]
    return bytes(lengths.count(n) for n in range(1, 17)) + bytes(symbols)


def grid(blocks: int) -> tuple[int, int]:
    """Rows and columns of 16 by 16 units that hold so many blocks."""
    units = -(-blocks // MCU_BLOCKS)
    columns = max(1, int(np.ceil(np.sqrt(units))))
    return -(-units // columns), columns


def encode(images: list[tuple[int, int, np.ndarray, bytes]]) -> list[bytes]:
    """JPEG files from (unit rows, unit columns, coefficients in zigzag order, comment).

    The coefficients are of all luma blocks in raster order, then of both
    chroma components (half resolution), in one array of 64 columns.
    """
    units = np.array([r * k for r, k, _, _ in images])
    sizes = np.stack((4 * units, units, units), 1).ravel()
    ends = np.concatenate(([0], np.cumsum(sizes)))
    c = np.concatenate([x for _, _, x, _ in images]).astype(np.int32)
    within = np.arange(len(c)) - np.repeat(ends[:-1], sizes)
    dc_table, ac_table = (codes(*x) for x in huffman_lists())
    scans = []
    for first, last, high, low, interval in SCRIPT:
        opens = within % interval == 0
        segment = np.cumsum(opens) - 1
        count = int(segment[-1]) + 1
        number = (within // interval)[opens]
        goes_on = np.concatenate((number[1:] > 0, [False]))
        if first:
            row, value, bits = (_ac_refined if high else _ac_first)(c, first, last, low, ac_table)
        elif high:
            row, value, bits = np.arange(len(c)), (c[:, 0].astype(np.int64) >> low) & 1, np.ones(len(c), np.int64)
        else:
            v = c[:, 0].astype(np.int64) >> low
            v = v - np.where(opens, 0, np.concatenate(([0], v[:-1])))
            size = sizes_of(v)
            row, value, bits = np.arange(len(c)), (dc_table[0][size] << size) | _magnitude(v, size), dc_table[1][size] + size
        data, starts = pack(segment[row], value, bits, count, np.where(goes_on, number % 8, -1))
        scans.append((data, starts[np.concatenate((segment[np.minimum(ends[:-1], len(c) - 1)], [count]))].tolist()))
    tables = b"".join(_segment(0xC4, bytes([which << 4]) + _dht(which)) for which in (0, 1)) + _segment(0xDB, b"\0" + b"\1" * 64)
    out = []
    for i, (rows, columns, _, comment) in enumerate(images):
        frame = struct.pack(">BHHB", 8, 16 * rows, 16 * columns, 3) + bytes((1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))
        parts = [b"\xff\xd8", _segment(0xFE, comment), tables, _segment(0xC2, frame)]
        for (first, last, high, low, interval), (data, at) in zip(SCRIPT, scans, strict=True):
            parts.append(_segment(0xDD, struct.pack(">H", interval)))
            for k in range(3):
                parts += [_segment(0xDA, bytes((1, k + 1, 0, first, last, high << 4 | low))), data[at[3 * i + k] : at[3 * i + k + 1]]]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


class _Bits:
    """Reads at many places of one destuffed buffer."""

    def __init__(self, data: np.ndarray):
        d = np.concatenate((data, np.full(4, 255, np.uint8))).astype(np.uint32)
        self.words = (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The next 16 bits."""
        return (self.words[at >> 3] >> (16 - (at & 7))) & 0xFFFF

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 3] >> (31 - (at & 7))) & 1

    def number(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.peek(at) >> (16 - size)


def _signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)


def _scan(c: np.ndarray, rows: list[np.ndarray], reader: _Bits, at: np.ndarray, kinds: list[np.ndarray], first: int, last: int, high: int, low: int, tables: tuple[bytes, bytes]) -> None:
    """Decodes one scan of many segments. ``rows[j]``: for each segment the row in ``c`` of its j-th block, or -1; ``kinds[j]``: its component."""
    at, left, before = at.copy(), np.zeros(len(at), np.int64), np.zeros((len(at), 4), np.int64)
    for row, kind in zip(rows, kinds, strict=True):
        live = np.flatnonzero(row >= 0)
        own, p = row[live], at[live]
        if not first and high:
            c[own, 0] |= reader.bit(p) << low
            p += 1
        elif not first:
            sym, size = lookup(tables[0])
            w = reader.peek(p)
            n = sym[w]
            p += size[w]
            v = _signed(reader.number(p, n), n) + before[live, kind[live]]
            p += n
            before[live, kind[live]] = v
            c[own, 0] = v << low
        elif not high:
            p, left[live] = _first_pass(c, own, reader, p, left[live], first, last, low, lookup(tables[1]))
        else:
            p, left[live] = _refining(c, own, reader, p, left[live], first, last, low, lookup(tables[1]))
        at[live] = p


def _first_pass(c, own, reader, p, left, first, last, low, table):
    sym, size = table
    k = np.where(left > 0, last + 1, first)
    left = np.maximum(left - 1, 0)
    i = np.flatnonzero(k <= last)
    while len(i):
        q = p[i]
        w = reader.peek(q)
        s = sym[w]
        q += size[w]
        run, n = s >> 4, s & 15
        kk = k[i] + run
        put = n > 0
        v = _signed(reader.number(q, n), n) << low
        q += n
        if put.all():
            c[own[i], kk] = v
            kk += 1
        else:
            c[own[i[put]], kk[put]] = v[put]
            kk += 1
            ends = ~put & (run < 15)
            j = i[ends]
            r = run[ends]
            left[j] = (1 << r) - 1 + np.where(r > 0, reader.number(q[ends], r), 0)
            q[ends] += r
            kk[ends] = last + 1
        p[i], k[i] = q, kk
        i = i[kk <= last]
    return p, left


def _refining(c, own, reader, p, left, first, last, low, table):
    sym, size = table
    step = 1 << low
    over = left > 0
    left = np.maximum(left - 1, 0)
    have, run, new = np.zeros(len(own), bool), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
    for k in range(first, last + 1):
        i = np.flatnonzero(~(have | over))
        if len(i):
            q = p[i]
            w = reader.peek(q)
            s = sym[w]
            q += size[w]
            r, n = s >> 4, s & 15
            sign = reader.bit(q)
            q += n
            ends = (n == 0) & (r < 15)
            left[i[ends]] = (1 << r[ends]) - 1 + np.where(r[ends] > 0, reader.number(q[ends], r[ends]), 0)
            q[ends] += r[ends]
            over[i[ends]] = True
            have[i] = ~ends
            run[i] = r
            new[i] = np.where(n > 0, np.where(sign == 1, step, -step), 0)
            p[i] = q
        v = c[own, k].astype(np.int64)
        there = v != 0
        fix = there & (reader.bit(p) == 1)
        p += there
        v += np.where(fix, np.sign(v) * step, 0)
        open_zero = ~there & have
        done = open_zero & (run == 0)
        v = np.where(done, new, v)
        run -= open_zero
        have &= ~done
        c[own, k] = v
    return p, left


def _block_order(scan_parts: list[int], sampling: list[tuple[int, int]], rows: int, columns: int, offsets: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The coefficient row and the component of each block, in the scan's order."""
    if len(scan_parts) == 1:
        k = scan_parts[0]
        n = rows * columns * sampling[k][0] * sampling[k][1]
        return offsets[k] + np.arange(n), np.full(n, k)
    y, x = np.divmod(np.arange(rows * columns), columns)
    out, kinds = [], []
    for k in scan_parts:
        h, v = sampling[k]
        for j in range(v):
            for i in range(h):
                out.append(offsets[k] + (y * v + j) * columns * h + x * h + i)
                kinds.append(np.full(len(y), k))
    return np.stack(out, 1).ravel(), np.stack(kinds, 1).ravel()


def _segments(scans: list, interval: int, restart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of scans alike, the start of each segment, and for its blocks the coefficient rows (-1 past the end) and components."""
    a, b = np.array([s[0] for s in scans]), np.array([s[1] for s in scans])
    scan = np.searchsorted(a, restart, "right") - 1
    inner = restart[(scan >= 0) & (restart < b[np.maximum(scan, 0)])] + 2
    begin = np.sort(np.concatenate((a, inner)))
    if all(len(parts) == 1 for _, _, parts, _ in scans):
        # Blocks of one component stand in the order of their rows.
        first = np.array([info["offsets"][parts[0]] for _, _, parts, info in scans])
        count = np.array([info["rows"] * info["columns"] * info["sampling"][parts[0]][0] * info["sampling"][parts[0]][1] for _, _, parts, info in scans])
        per = interval or int(count.max())
        pieces = -(-count // per)
        piece = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        rows = np.repeat(first, pieces)[:, None] + piece[:, None] * per + np.arange(per)
        rows = np.where(rows < np.repeat(first + count, pieces)[:, None], rows, -1)
        kinds = np.broadcast_to(np.repeat(np.array([parts[0] for _, _, parts, _ in scans]), pieces)[:, None], rows.shape)
        return begin, rows, kinds
    table_rows, table_kinds = [], []
    for _, _, parts, info in scans:
        order, own = _block_order(parts, info["sampling"], info["rows"], info["columns"], info["offsets"])
        per = interval * sum(info["sampling"][k][0] * info["sampling"][k][1] for k in parts) or len(order)
        short = -len(order) % per
        table_rows.append(np.concatenate((order, np.full(short, -1))).reshape(-1, per))
        table_kinds.append(np.concatenate((own, np.zeros(short, own.dtype))).reshape(-1, per))
    width = max(t.shape[1] for t in table_rows)
    wide = lambda ts, fill: np.concatenate([np.pad(t, ((0, 0), (0, width - t.shape[1])), constant_values=fill) for t in ts])
    return begin, wide(table_rows, -1), wide(table_kinds, 0)


def decode(files: list[bytes]) -> list[dict]:
    """``rows, columns`` (of units), ``sampling``, ``quant``, ``comment`` and ``coefficients`` of each file."""
    buf = np.frombuffer(b"".join(files), np.uint8)
    ff = np.flatnonzero(buf[:-1] == 255)
    after = buf[ff + 1]
    restart = ff[(after >= 0xD0) & (after <= 0xD7)]
    marker = ff[(after != 0) & ~((after >= 0xD0) & (after <= 0xD7))].tolist()
    stuffed = ff[after == 0] + 1
    plain = np.delete(buf, stuffed)
    reader = _Bits(plain)
    images, groups, offset, base = [], defaultdict(list), 0, 0
    for data in files:
        info = {"quant": {}, "comment": b"", "sampling": []}
        tables: dict[int, bytes] = {}
        at, interval, number = 2, 0, 0
        while data[at + 1] != 0xD9:
            kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if kind == 0xFE:
                info["comment"] = body
            elif kind == 0xDB:
                for i in range(0, len(body), 65):
                    info["quant"][body[i] & 15] = np.frombuffer(body[i + 1 : i + 65], np.uint8).astype(np.int64)
            elif kind == 0xC4:
                i = 0
                while i < len(body):
                    end = i + 17 + sum(body[i + 1 : i + 17])
                    tables[body[i]] = body[i + 1 : end]
                    i = end
            elif kind == 0xDD:
                interval = int.from_bytes(body, "big")
            elif kind == 0xC2:
                height, width = struct.unpack(">HH", body[1:5])
                info["ids"] = [body[6 + 3 * k] for k in range(body[5])]
                info["sampling"] = [(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15) for k in range(body[5])]
                info["rows"], info["columns"] = -(-height // (8 * max(v for _, v in info["sampling"]))), -(-width // (8 * max(h for h, _ in info["sampling"])))
                counts = [info["rows"] * info["columns"] * h * v for h, v in info["sampling"]]
                info["offsets"] = [offset + sum(counts[:k]) for k in range(len(counts))]
                info["range"] = (offset, offset + sum(counts))
                offset += sum(counts)
            elif kind == 0xDA:
                n = body[0]
                parts = [info["ids"].index(body[1 + 2 * k]) for k in range(n)]
                pick = body[2]
                first, last, bits = body[1 + 2 * n : 4 + 2 * n]
                end = marker[bisect_left(marker, base + at)] - base
                spec = (number, first, last, bits >> 4, bits & 15, interval, tables.get(pick >> 4, b""), tables.get(0x10 | pick & 15, b""))
                groups[spec].append((base + at, base + end, parts, info))
                number += 1
                at = end
            elif kind in (0xC0, 0xC1, 0xC3) or 0xC5 <= kind <= 0xCF:
                raise ValueError("not a progressive Huffman-coded JPEG file")
        images.append(info)
        base += len(data)
    c = np.zeros((offset, 64), np.int32)
    for (_, first, last, high, low, interval, dc, ac), scans in sorted(groups.items(), key=lambda g: g[0]):
        begin, rows, kinds = _segments(scans, interval, restart)
        begin = (begin - np.searchsorted(stuffed, begin)) * 8
        _scan(c, list(rows.T), reader, begin.astype(np.int64), list(kinds.T), first, last, high, low, (dc, ac))
    for info in images:
        info["coefficients"] = c[slice(*info["range"])]
    return images


def samples(images: list[dict]) -> None:
    """Adds ``samples`` to each image: its blocks after the inverse transform, as bytes."""
    whole = np.concatenate([x["coefficients"] * x["quant"][0] for x in images]).astype(np.float64) @ basis()
    whole += 2048 + 128 * 4096
    whole = np.clip(np.floor(whole * (1 / 4096)), 0, 255).astype(np.uint8)
    at = 0
    for x in images:
        n = len(x["coefficients"])
        x["samples"] = whole[at : at + n]
        at += n


def to_rgb(info: dict) -> np.ndarray:
    """The image's samples (height, width, 3) as bytes; chroma is repeated to full resolution."""
    if "samples" not in info:
        samples([info])
    rows, columns, lo = info["rows"], info["columns"], info["range"][0]
    planes, tall, wide = [], max(v for _, v in info["sampling"]), max(h for h, _ in info["sampling"])
    for k, (h, v) in enumerate(info["sampling"]):
        n = rows * columns * h * v
        own = info["samples"][info["offsets"][k] - lo : info["offsets"][k] - lo + n]
        plane = own.reshape(rows * v, columns * h, 8, 8).swapaxes(1, 2).reshape(rows * v * 8, columns * h * 8)
        planes.append(plane if (tall, wide) == (v, h) else plane.repeat(tall // v, 0).repeat(wide // h, 1))
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2)
    y, cb, cr = (p.astype(np.int32) for p in planes)
    cb -= 128
    cr -= 128
    out = np.empty((*y.shape, 3), np.uint8)
    for i, x in enumerate((y + ((91881 * cr + 32768) >> 16), y - ((22554 * cb + 46802 * cr + 32768) >> 16), y + ((116130 * cb + 32768) >> 16))):
        out[:, :, i] = np.clip(x, 0, 255)
    return out
