import numpy as np
import pytest

from eventloom.sources import codecs as C


def events(n=5000, width=64, height=48, seed=1, step=400):
    rng = np.random.default_rng(seed)
    t = 1_000_000 + np.cumsum(rng.integers(0, step, n))
    return {"t": t.astype(np.int64), "x": rng.integers(0, width, n).astype(np.int32), "y": rng.integers(0, height, n).astype(np.int32), "on": rng.random(n) < 0.5}


def same(a, b):
    for k in ("t", "x", "y", "on"):
        np.testing.assert_array_equal(a[k], b[k])


ROUND = {
    "dat1": (lambda c: C.encode_dat(c, 64, 48, "1"), lambda d: C.decode_dat(d)[1]),
    "dat2": (lambda c: C.encode_dat(c, 64, 48, "2"), lambda d: C.decode_dat(d)[1]),
    "evt2": (lambda c: C.encode_evt(c, 64, 48, "2"), lambda d: C.decode_evt(d)[1]),
    "evt3": (lambda c: C.encode_evt(c, 64, 48, "3"), lambda d: C.decode_evt(d)[1]),
    "aedat": (lambda c: C.encode_aedat(c, 64, 48), lambda d: C.decode_aedat(d)[1]),
    "aedat_lz4": (lambda c: C.encode_aedat(c, 64, 48, ("lz4", 1)), lambda d: C.decode_aedat(d)[1]),
    "aedat_lz4_high": (lambda c: C.encode_aedat(c, 64, 48, ("lz4_high", 9)), lambda d: C.decode_aedat(d)[1]),
    "aedat_plain": (lambda c: C.encode_aedat(c, 64, 48, None), lambda d: C.decode_aedat(d)[1]),
}


@pytest.mark.parametrize("name", ROUND)
@pytest.mark.parametrize("step", [2, 400, 3_000_000])
@pytest.mark.parametrize("n", [0, 1, 5000])
def test_round_trip(name, step, n):
    write, read = ROUND[name]
    c = events(n, step=step)
    same(c, read(write(c)[0]))


@pytest.mark.parametrize("step", [2, 400, 5000])
def test_es_dvs(step):
    c = events(800, step=step)
    data, t0 = C.encode_es(c, 64, 48)
    h, out = C.decode_es(data, t0)
    assert (h.width, h.height, h.kind) == (64, 48, "dvs")
    same(c, out)


def test_es_others():
    rng = np.random.default_rng(2)
    c = events(300)
    atis = {"t": c["t"], "x": c["x"], "y": c["y"], "exposure": rng.random(300) < 0.5, "polarity": c["on"]}
    data, t0 = C.encode_es(atis, 64, 48, "atis")
    for k, v in C.decode_es(data, t0)[1].items():
        np.testing.assert_array_equal(v, atis[k])
    color = {"t": c["t"], "x": c["x"], "y": c["y"], **{k: rng.integers(0, 256, 300) for k in "rgb"}}
    data, t0 = C.encode_es(color, 64, 48, "color")
    for k, v in C.decode_es(data, t0)[1].items():
        np.testing.assert_array_equal(v, color[k])
    generic = {"t": c["t"][:50], "bytes": np.array([bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in range(0, 500, 10)], object)}
    data, t0 = C.encode_es(generic, 0, 0, "generic")
    out = C.decode_es(data, t0)[1]
    assert out["t"].tolist() == generic["t"].tolist() and list(out["bytes"]) == list(generic["bytes"])


def test_dat_wraps():
    t = np.array([0, 1 << 31, (1 << 32) - 5, (1 << 32) + 7, (1 << 33) - 9, (1 << 33) + 1], np.int64)
    c = {"t": t, "x": np.zeros(6, np.int32), "y": np.zeros(6, np.int32), "on": np.ones(6, bool)}
    same(c, C.decode_dat(C.encode_dat(c, 4, 4)[0])[1])


def test_evt3_vectors():
    c = {"t": np.full(5, 9, np.int64), "x": np.array([3, 4, 8, 14, 20], np.int32), "y": np.full(5, 2, np.int32), "on": np.ones(5, bool)}
    data, t0 = C.encode_evt(c, 64, 48, "3", zero_t0=False)
    same(c, C.decode_evt(data)[1])


def test_evt_triggers_and_clamp():
    words = np.array([8 << 28 | 2, 1 << 28 | 5 << 22 | 3 << 11 | 4, 10 << 28 | 7 << 22 | 6 << 8 | 1, 0 << 28 | 1 << 22 | 1 << 11 | 1], "<u4")
    h, e, g = C.decode_evt(b"% evt 2.0\n% geometry 64x48\n" + words.tobytes())
    assert e["t"].tolist() == [133, 135] and e["on"].tolist() == [True, False]
    assert (g["t"].tolist(), g["source"].tolist(), g["rising"].tolist()) == ([135], [6], [True])


def test_not_there_yet_and_wrong():
    with pytest.raises(NotImplementedError):
        C.decode_evt(b"% evt 2.1\n% geometry 4x4\n")
    with pytest.raises(ValueError):
        C.encode_dat(events(10), 64, 48 * 10, "1")
    down = events(10) | {"t": np.arange(10, 0, -1)}
    with pytest.raises(ValueError):
        C.encode_evt(down, 64, 48)
    with pytest.raises(ValueError):
        C.decode_dat(C.encode_dat(events(10), 64, 48)[0].replace(b"Width 64", b"Width 02"))


def test_aedat_index_and_detection():
    c = events(9000)
    data, _ = C.encode_aedat(c, 64, 48)
    index = C.aedat_index(data)
    assert [r[3] for r in index] == [4096, 4096, 808]
    assert (index[0][4], index[-1][5]) == (c["t"][0], c["t"][-1])
    assert C.detect("a.bin", data[:16]) == "aedat" and C.detect("x.RAW", b"") == "evt" and C.detect("q", b"Event Stream\2") == "es"


#: Bytes written by hand from the published descriptions of the formats: ON at (3, 2) and t = 5, OFF at (63, 47) and t = 70.
GOLDEN = {
    "dat2": (b"% Data file containing CD events\n% Version 2\n% Width 64\n% Height 48\n\x0c\x08" + (5).to_bytes(4, "little") + (3 | 2 << 14 | 1 << 28).to_bytes(4, "little") + (70).to_bytes(4, "little") + (63 | 47 << 14).to_bytes(4, "little")),
    "evt2": b"% evt 2.0\n% geometry 64x48\n% end\n" + b"".join(w.to_bytes(4, "little") for w in (8 << 28, 1 << 28 | 5 << 22 | 3 << 11 | 2, 8 << 28 | 1, 6 << 22 | 63 << 11 | 47)),
    "evt3": b"% evt 3.0\n% geometry 64x48\n% end\n" + b"".join(w.to_bytes(2, "little") for w in (0x8000, 0x6005, 0x0002, 0x2803, 0x6046, 0x002F, 0x203F)),
    "evt3 vector": b"% evt 3.0\n% geometry 64x48\n% end\n" + b"".join(w.to_bytes(2, "little") for w in (0x8000, 0x6005, 0x0002, 0x3803, 0x4001, 0x6046, 0x002F, 0x3037, 0x5000, 0x5001)),
    "es": b"Event Stream\x02\x00\x00\x01\x40\x00\x30\x00" + bytes((5 << 1 | 1, 3, 0, 45, 0, 65 << 1, 63, 0, 0, 0)),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_bytes_written_by_hand(name):
    data = GOLDEN[name]
    decode = {"dat2": lambda: C.decode_dat(data)[1], "es": lambda: C.decode_es(data)[1]}.get(name, lambda: C.decode_evt(data)[1])
    out = decode()
    assert [out[k].tolist() for k in ("t", "x", "y", "on")] == [[5, 70], [3, 63], [2, 47], [True, False]]


def test_encoders_write_the_bytes():
    c = {"t": np.array([5, 70]), "x": np.array([3, 63]), "y": np.array([2, 47]), "on": np.array([True, False])}
    assert C.encode_dat(c, 64, 48, "2", False)[0].endswith(GOLDEN["dat2"][-16:])
    assert C.encode_es(c, 64, 48, "dvs", False)[0] == GOLDEN["es"]
    assert C.encode_evt(c, 64, 48, "2", False)[0].endswith(GOLDEN["evt2"][-16:])
    # An LZ4 frame starts with its magic number and ends with four zeros.
    data, _ = C.encode_aedat(c, 64, 48, ("lz4", 1))
    start = C.aedat_header(data).more["start"]
    size = int.from_bytes(data[start + 4 : start + 8], "little")
    assert data[start + 8 : start + 12] == b"\x04\x22\x4d\x18" and data[start + 4 + 4 + size - 4 : start + 8 + size] == bytes(4)


def in_runs(kind, version, c, length=700):
    """A file of runs that know only the time before them."""
    w = C.Writer(kind, 64, 48, version, ("zstd", 1) if kind == "aedat" else None)
    bodies, index, before, at = [], [], None, 0
    for i in range(0, len(c["t"]), length):
        run = {k: v[i : i + length] for k, v in c.items()}
        body, own = w.body(run, before)
        bodies.append(body)
        index.append(own + np.array([at, 0, 0, 0, 0]))
        at, before = at + len(body), int(run["t"][-1])
    head = w.head(0, at)
    return head + b"".join(bodies) + w.tail(np.concatenate(index), len(head))


@pytest.mark.parametrize(("kind", "version", "step"), [("dat", "2", 4_000_000), ("evt", "2", 4_000_000), ("evt", "2", 3), ("evt", "3", 90_000), ("evt", "3", 2), ("es", "", 300), ("aedat", "", 400)])
def test_files_in_runs_and_blocks(monkeypatch, kind, version, step):
    import io

    c = events(step=step)
    c["t"] -= 1_000_000
    data = in_runs(kind, version, c)
    whole = {"dat": lambda: C.decode_dat(data)[1], "evt": lambda: C.decode_evt(data)[1], "es": lambda: C.decode_es(data)[1], "aedat": lambda: C.decode_aedat(data)[1]}[kind]()
    same(c, whole)
    monkeypatch.setattr(C, "BLOCK", 67)
    found = list(C.parts(kind, io.BytesIO(data))[1])
    assert len(found) > 5
    same(c, {k: np.concatenate([f[k] for f in found]) for k in ("t", "x", "y", "on")})
    if kind == "aedat":
        assert sum(r[3] for r in C.aedat_index(data)) == 5000 and {r[3] for r in C.aedat_index(data)} == {700, 100}
    with pytest.raises(ValueError, match="decrease"):
        C.Writer(kind, 64, 48, version).body(c, int(c["t"][0]) + 1)


def test_runs_that_dat_cannot_chain():
    late = {"t": np.array([1 << 33]), "x": np.zeros(1, np.int32), "y": np.zeros(1, np.int32), "on": np.ones(1, bool)}
    with pytest.raises(ValueError, match="turns"):
        C.Writer("dat", 4, 4, "2").body(late, 5)


def peak_mb(f):
    import tracemalloc

    tracemalloc.start()
    f()
    mb = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return mb


@pytest.mark.parametrize(("kind", "version"), [("evt", "2"), ("evt", "3"), ("es", ""), ("aedat", "")])
def test_blocks_bound_memory(kind, version):
    """Three times the events take no more memory."""
    import io

    files = [io.BytesIO(in_runs(kind, version, events(n, step=90), 65_536)) for n in (400_000, 1_200_000)]
    one, three = (peak_mb(lambda f=f: [None for _ in C.parts(kind, f)[1]]) for f in files)
    assert three < 1.2 * one
