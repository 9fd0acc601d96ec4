import socket
import time

import numpy as np
import pytest

from eventloom import cli, jobs
from eventloom.model import EventStream, events_stream_from_array
from eventloom.sources import codecs, datasource, files
from eventloom.streaming import camera, packets, udp

KIND = [("t", "<u8"), ("x", "<u2"), ("y", "<u2"), ("on", "?")]


def recording(n=600, width=40, height=30):
    rng = np.random.default_rng(3)
    a = np.zeros(n, KIND)
    a["t"], a["x"], a["y"], a["on"] = 1000 + np.cumsum(rng.integers(0, 300, n)), rng.integers(0, width, n), rng.integers(0, height, n), rng.random(n) < 0.5
    return a


def rows(s: EventStream):
    return [tuple(r) for r in s.df.orderBy("seq").select("t", "x", "y", "on").collect()]


@pytest.mark.parametrize("name", ["a.csv", "a.dat", "a.es", "a.evt", "a.raw", "a.aedat4"])
def test_round_trips(spark, tmp_path, name):
    a = recording()
    s = events_stream_from_array(spark, a, (40, 30))
    path = str(tmp_path / name)
    seen = []
    code = s.to_file(path, version="2" if name == "a.raw" else None, on_progress=lambda *x: seen.append(x[0]))
    back = files.events_stream_from_file(spark, path, dimensions_fallback=(40, 30), t0=None if name != "a.es" else int(a["t"][0]))
    assert back.dimensions() == (40, 30) and rows(back) == [tuple(r) for r in a.tolist()] and seen == ["start", "end"]
    assert code == ("00:00:00.000000" if name in ("a.csv", "a.aedat4") else f"00:00:00.{int(a['t'][0]):06d}")
    assert back.time_range() == (int(a["t"][0]), int(a["t"][-1]) + 1)


def test_cross_formats(spark, tmp_path):
    a = recording(200)
    now = events_stream_from_array(spark, a, (40, 30))
    for i, end in enumerate(("dat", "evt", "aedat4", "csv")):
        now.to_file(path := str(tmp_path / f"{i}.{end}"))
        now = files.events_stream_from_file(spark, path, dimensions_fallback=(40, 30))
    assert rows(now) == [tuple(r) for r in a.tolist()]


def test_csv_edges(spark):
    lines = ["t;x;y;p", "1;2;3;T\r", " 5 ; 1 ; 1 ; F ", "4;0;0;T", "7;99;0;T", "8;0;0;Q", "bad", ""]
    p = files.CsvProperties(separator=";", on_value="T", off_value="F", skip_errors=True)
    s = files.events_stream_from_stdin(spark, (10, 10), 100, p, lines)
    assert rows(s) == [(101, 2, 3, True), (105, 1, 1, False), (105, 0, 0, True)]
    with pytest.raises(Exception, match="not an event"):
        rows(files.events_stream_from_stdin(spark, (10, 10), 0, files.CsvProperties(separator=";", on_value="T", off_value="F"), lines))
    scaled = files.events_stream_from_stdin(spark, (10, 10), 0, files.CsvProperties(has_header=False, t_scale=1e6, x_index=2, y_index=1), ["0.0000025,1,2,1"])
    assert rows(scaled) == [(3, 2, 1, True)]
    with pytest.raises(ValueError):
        files.CsvProperties(t_index=1)


def test_data_source(spark, tmp_path):
    a = recording(9000)
    s = events_stream_from_array(spark, a, (40, 30))
    s.to_file(str(tmp_path / "b.aedat4"))
    datasource.register(spark)
    df = spark.read.format("event_file").load(str(tmp_path / "b.aedat4"))
    assert [tuple(r) for r in df.orderBy("seq").select("t", "x", "y", "on").collect()] == [tuple(r) for r in a.tolist()]
    cut = int(a["t"][5000])
    assert df.where(f"t >= {cut}").count() == int((a["t"] >= cut).sum())
    s.to_file(str(tmp_path / "b.evt"))
    assert spark.read.format("event_file").load(str(tmp_path / "b.evt")).count() == 9000


def test_other_records(spark, tmp_path):
    path = tmp_path / "atis.es"
    c = {"t": np.array([1, 5, 9]), "x": np.array([1, 2, 3]), "y": np.array([4, 5, 6]), "exposure": np.array([False, True, False]), "polarity": np.array([True, False, False])}
    path.write_bytes(codecs.encode_es(c, 8, 8, "atis", zero_t0=False)[0])
    assert rows(files.events_stream_from_file(spark, str(path))) == [(1, 1, 4, True), (9, 3, 6, False)]
    assert files.records(spark, str(path), "atis").where("exposure").count() == 1


def test_late_packets_and_wraps():
    one = lambda t, form: packets.decode(packets.encode(np.array(t), np.zeros(len(t)), np.full(len(t), 20_000), np.ones(len(t)), form), form)
    last, offset, kept = -1, 0, []
    for t in ([5, 9], [8, 20], [9, 30], [40]):
        e, last, offset = packets.accept(one(t, "t64_x16_y16_on8"), "t64_x16_y16_on8", last, offset)
        kept.append(None if e is None else e["t"].tolist())
    assert kept == [[5, 9], None, [9, 30], [40]]
    last, offset, kept = -1, 0, []
    for t in ([100], [50], [(1 << 32) - 3], [4], [2], [1 << 20]):
        e, last, offset = packets.accept(one(t, "t32_x16_y15_on1"), "t32_x16_y15_on1", last, offset)
        kept.append(None if e is None else (e["t"].tolist(), e["y"].tolist()))
    assert kept == [([100], [20_000]), None, ([(1 << 32) - 3], [20_000]), ([(1 << 32) + 4], [20_000]), None, ([(1 << 32) + (1 << 20)], [20_000])]


def test_streaming_state(spark, tmp_path):
    form = "t64_x16_y16_on8"
    data = [("a", k, packets.encode(np.array(t), np.array([1] * len(t)), np.array([2] * len(t)), np.array([k % 2 == 0] * len(t)), form)) for k, t in enumerate(([1, 5], [4, 6], [7], [7, 8]))]
    src = str(tmp_path / "in")
    spark.createDataFrame(data, "stream string, packet long, data binary").write.parquet(src)
    live = spark.readStream.schema("stream string, packet long, data binary").parquet(src)
    q = packets.accepted_events(live, form).writeStream.format("memory").queryName("accepted").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.sql("SELECT seq, t FROM accepted ORDER BY seq").collect()
    assert [tuple(r) for r in got] == [(0, 1), (1, 5), (2, 7), (3, 7), (4, 8)]
    ev = str(tmp_path / "ev")
    spark.sql("SELECT seq, t, x, y, on FROM accepted").write.parquet(ev)
    live = spark.readStream.schema("seq long, t long, x int, y int, on boolean").parquet(ev)
    q = packets.last_event_by_pixel(live).writeStream.format("memory").queryName("last").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.sql("SELECT x, y, seq, t, on FROM last").collect()] == [(1, 2, 4, 8, False)]


@pytest.mark.parametrize("form", list(packets.FORMATS))
def test_udp_reader(spark, form):
    a = recording(500)
    probe = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    probe.bind(("127.0.0.1", 0))
    port = probe.getsockname()[1]
    probe.close()
    reader = udp.UdpReader({"host": "127.0.0.1", "port": str(port)})
    s = events_stream_from_array(spark, a, (40, 30))
    assert udp.send(s.df, ("127.0.0.1", port), 99, form, pause=0.002) == 6
    rows_, end = [], reader.initialOffset()
    for _ in range(50):
        part, end = reader.read(end)
        rows_ += list(part)
        if len(rows_) == 6:
            break
        time.sleep(0.1)
    reader.open = False
    got = [tuple(r) for _, _, d in rows_ for r in packets.decode(d, form).itertuples(index=False)]
    assert got == [tuple(r) for r in a.tolist()] and end == {"packet": 6}
    assert len(list(reader.readBetweenOffsets({"packet": 2}, {"packet": 4}))) == 2


def test_camera(spark):
    with pytest.raises(RuntimeError):
        camera.events_stream_from_camera(spark)
    assert camera.demonstration(spark).df.isStreaming


def test_jobs(tmp_path):
    calls = []

    @jobs.task(".txt")
    def write(source, out):
        calls.append(source)
        with open(out, "w") as f:
            f.write(str(source))

    m = jobs.JobManager(str(tmp_path))
    m.add("a", 1, write)
    m.add("b", 2, write)
    with pytest.raises(ValueError):
        m.add("a", 3, write)
    assert m.run() == ["a/write", "b/write"] and m.run() == [] and m.run(force=True) == ["a/write", "b/write"] and calls == [1, 2, 1, 2]
    assert len(jobs.file_digest(str(tmp_path / "a_write.txt"))) == 56
    assert jobs.rendered_jobs("x{{#jobs}}<{{a}}>{{/jobs}}y", [{"a": 1}, {"a": 2}]) == "x<1><2>y"


def test_cli(spark, tmp_path, capsys):
    a = recording(50)
    src, out = str(tmp_path / "in.dat"), str(tmp_path / "out.csv")
    events_stream_from_array(spark, a, (40, 30)).to_file(src)
    cli.process(spark, ["input", src, "filter", "crop", "0", "20", "0", "30", "filter", "remove-on-events", "output", out])
    kept = a[(a["x"] < 20) & ~a["on"]]
    with open(out) as f:
        assert len(f.readlines()) == len(kept) + 1
    assert cli.main(["list-filters"]) == 0 and cli.main(["colormaps"]) == 0 and cli.main([]) == 1
    assert "hot_pixels" in capsys.readouterr().out
    assert "in.dat" in cli.init(spark, src)
    with pytest.raises(SystemExit):
        cli.filtered(events_stream_from_array(spark, a, (40, 30)), ["nothing"])


def test_cli_frames(spark, tmp_path, capsys):
    from eventloom.operators.animation import read_gif
    from eventloom.operators.frames import from_png

    a = recording(400)
    src, gif = str(tmp_path / "in.dat"), str(tmp_path / "out.gif")
    s = events_stream_from_array(spark, a, (40, 30))
    s.to_file(src)
    words = ["input", "file", src, "filter", "regularize", "10", "filter", "render", "exponential", "00:00:00.2", "glow_3", "--minimum-clip", "0.1", "filter", "scale", "2", "filter", "add-timecode", "--output-frame-rate", "10", "output", gif, "--frame-rate", "10", "output", "files", str(tmp_path / "{index}.png"), "output", "files", str(tmp_path / "{timestamp}.png")]
    cli.process(spark, words)
    with open(gif, "rb") as f:
        images = read_gif(f.read())
    count = s.regularize(10.0).packets
    assert len(images) == count and images[0].shape == (60, 80, 3)
    with open(tmp_path / "0.png", "rb") as f:
        assert from_png(f.read()).shape == (60, 80, 4)
    assert len(list(tmp_path.glob("*.png"))) == 2 * count
    cli.process(spark, ["input", src, "output", "rate", str(tmp_path / "r.svg"), "--samples", "50", "output", "kinectograph", str(tmp_path / "k.png"), "--factor", "2"])
    assert (tmp_path / "r.svg").read_text().startswith("<svg") and from_png((tmp_path / "k.png").read_bytes()).shape == (60, 80, 4)
    assert cli.main(["colormaps", str(tmp_path / "maps.png")]) == 0 and from_png((tmp_path / "maps.png").read_bytes()).shape == (38 * 12, 512, 4)
    assert cli.init(spark, src, True) == cli.init(spark, src, True)
    with pytest.raises(SystemExit):
        cli.process(spark, ["input", src, "output", "files", "x{index}.png"])
    with pytest.raises(SystemExit):
        cli.process(spark, ["input", src, "filter"])


def test_csv_errors_and_folders(spark, tmp_path):
    (tmp_path / "b.csv").write_text("t,x,y,on\n30,1,1,1\n40,2,2,0\n")
    (tmp_path / "a.csv").write_text("t,x,y,on\n10,3,3,1\n20,4,4,0\n")
    s = files.events_stream_from_file(spark, str(tmp_path), file_type="csv", dimensions_fallback=(10, 10))
    assert s.df.count() == 4 and [r.t for r in s.df.orderBy("seq").collect()] == [10, 20, 30, 40]
    (tmp_path / "b.csv").write_text("t,x,y,on\n30,1,1,1\nnothing\n")
    with pytest.raises(Exception, match="not an event"):
        files.events_stream_from_file(spark, str(tmp_path), file_type="csv", dimensions_fallback=(10, 10)).df.count()
    for name, part in (("1.dat", recording(20)), ("2.dat", recording(30))):
        events_stream_from_array(spark, part, (40, 30)).to_file(str(tmp_path / name))
    both = files.records(spark, str(tmp_path / "*.dat"), file_type="dat").orderBy("seq").collect()
    assert len({r.seq for r in both}) == len(both) == 50


def test_time_range_cache(spark, tmp_path):
    s = events_stream_from_array(spark, recording(30), (40, 30))
    path, cache = str(tmp_path / "a.dat"), str(tmp_path / "cache.json")
    s.to_file(path)
    first = files.cached_time_range(s, path, cache, t0=None)
    other = events_stream_from_array(spark, recording(10), (40, 30))
    assert first == s.time_range() == files.cached_time_range(other, path, cache, t0=None)
    assert files.cached_time_range(other, path, cache, t0=5) == other.time_range()


def test_pictures(spark):
    from eventloom.functions.color import catalogue
    from eventloom.operators import plots

    s = events_stream_from_array(spark, recording(), (40, 30))
    for logarithmic in (False, True):
        svg = plots.rate_svg(s.to_event_rate(40), logarithmic=logarithmic, theme="dark")
        assert svg.startswith("<svg") and len(svg.split("points=")[1].split('"')[1].split()) == 40
    image = plots.kinectograph_image(s.to_kinectograph(), 40, 30, catalogue()["ink_2"], "#000000", 2)
    assert image.shape == (60, 80, 4) and (image[..., 3] == 255).all() and image[..., :3].any()
    assert plots.axis_range(np.array([0.0, 37.0]), False) == (0.0, 40.0) and plots.axis_range(np.array([0.0, 5.0, 300.0]), True) == (1.0, 1000.0)


NAMES = ["a.csv", "a.dat", "a.es", "2.evt", "3.evt", "a.aedat4"]


@pytest.fixture
def in_tasks(spark, monkeypatch):
    """Events that reach the driver are an error, and runs aren't put together."""
    from pyspark.sql import DataFrame

    def no(*_, **__):
        raise AssertionError("events reach the driver")

    monkeypatch.setattr(type(spark.range(0)), "toArrow", no)
    monkeypatch.setattr(files, "csv_lines", no)
    monkeypatch.setattr(DataFrame, "toArrow", no)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("zero_t0", [False, True])
def test_files_are_written_by_tasks(spark, tmp_path, in_tasks, name, zero_t0):
    a = recording(2000)
    s = events_stream_from_array(spark, a, (40, 30))
    path = str(tmp_path / name)
    s.to_file(path, version=name[0] if name.endswith("evt") else None, zero_t0=zero_t0)
    back = files.events_stream_from_file(spark, path, dimensions_fallback=(40, 30), t0=int(a["t"][0]) if zero_t0 and name == "a.es" else None)
    assert rows(back) == [tuple(r) for r in a.tolist()]
    if name in ("a.csv", "a.aedat4"):
        return
    assert rows(files.events_stream_from_file(spark, path, dimensions_fallback=(40, 30), t0=0))[0][0] == (0 if zero_t0 else a["t"][0])


@pytest.mark.parametrize("name", NAMES)
def test_times_that_decrease_between_runs(spark, tmp_path, in_tasks, name):
    a = recording(2000)
    a["t"][1000:] -= 1000  # each half is in order
    s = EventStream(events_stream_from_array(spark, a, (40, 30)).df, 40, 30)
    with pytest.raises(ValueError, match="decrease"):
        s.to_file(str(tmp_path / name))
    assert not (tmp_path / name).exists()
    if name != "a.aedat4":
        s.to_file(str(tmp_path / name), zero_t0=False, enforce_monotonic_timestamps=False)
        back = files.events_stream_from_file(spark, str(tmp_path / name), dimensions_fallback=(40, 30))
        assert [r[0] for r in rows(back)] == np.maximum.accumulate(a["t"]).tolist()


@pytest.mark.parametrize("name", NAMES)
def test_without_a_shared_folder(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(files, "scratch", lambda *_: None)
    a = recording()
    events_stream_from_array(spark, a, (40, 30)).to_file(str(tmp_path / name), zero_t0=False)
    assert rows(files.events_stream_from_file(spark, str(tmp_path / name), dimensions_fallback=(40, 30))) == [tuple(r) for r in a.tolist()]


def test_files_in_a_store_that_only_spark_reads(spark, tmp_path, monkeypatch):
    a = recording(3000)
    s = events_stream_from_array(spark, a, (40, 30))
    for name in ("1.dat", "2.dat"):
        s.to_file(str(tmp_path / name))
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.other.link./in", f"file://{tmp_path}")
    monkeypatch.setattr(files, "SLICE", 1000)
    got = files.records(spark, "viewfs://other/in/*.dat", file_type="dat").orderBy("seq").select("t", "x", "y", "on").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in a.tolist()] * 2
    assert files.header(spark, "viewfs://other/in/1.dat").width == 40


def test_events_are_not_broadcast(spark, tmp_path):
    """A file of few bytes holds many events, so its size says little."""
    a = recording()
    events_stream_from_array(spark, a, (40, 30)).to_file(str(tmp_path / "a.raw"))
    s = files.events_stream_from_file(spark, str(tmp_path / "a.raw"))
    from eventloom.operators import order

    for df in (order.with_ordinals(s.df, "i"), order.running_max(s.df, "t"), order.with_runs(s.df, "y"), order.with_run_lengths(s.df, "y")):
        df.count()
        assert "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_stdin_is_copied_in_blocks(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes(b"t,x,y,on\r\n5,1,2,1\r\n\r\n7,3,4,0\n8,3,4,1")
    with open(tmp_path / "in.csv") as f:
        s = files.events_stream_from_stdin(spark, (10, 10), 100, lines=f)
        assert f.read() == ""
    assert rows(s) == [(105, 1, 2, True), (107, 3, 4, False), (108, 3, 4, True)]
    assert "ExistingRDD" not in s.df._jdf.queryExecution().executedPlan().toString() and "FileScan text" in s.df._jdf.queryExecution().executedPlan().toString()
    assert rows(files.events_stream_from_stdin(spark, (10, 10), lines=[])) == []


@pytest.mark.parametrize("form", list(packets.FORMATS))
def test_packets_are_taken_as_one_by_one(spark, tmp_path, monkeypatch, form):
    """Empty, late and disordered packets and turns, in two streams and through the plain rule packet by packet."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(packets, "TOGETHER", 50)
    data, want = [], []
    for stream in "ab":
        t, last, offset, count = 0, -1, 0, 0
        for k in range(60):
            t += int(rng.integers(0, 1 << 30))
            own = np.maximum(0, t - int(rng.integers(0, 1 << 29)) * (k % 5 == 3) + rng.integers(-50, 1 << 30, int(rng.integers(0, 5))))
            d = packets.encode(own, own % 7, own % 5, own % 2 == 0, form)
            data.append((stream, k, d))
            e, last, offset = packets.accept(packets.decode(d, form), form, last, offset)
            if e is not None:
                want += [(stream, k, count + i, *r) for i, r in enumerate(e[["t", "x", "y", "on"]].itertuples(index=False, name=None))]
                count += len(e)
    spark.createDataFrame(data, "stream string, packet long, data binary").write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("stream string, packet long, data binary").parquet(str(tmp_path / "in"))
    (tmp_path / "out").mkdir()
    packets.accepted_events(live, form).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(60)
    got = spark.read.schema(packets.OUT).parquet(str(tmp_path / "out")).orderBy("stream", "seq").collect()
    assert [tuple(r) for r in got] == want and 60 < len(want) < sum(len(d) for _, _, d in data) // packets.FORMATS[form].itemsize


def test_packing(spark):
    df = spark.range(1000).selectExpr("id AS seq", "id DIV 300 AS packet", "id * 10 AS t", "CAST(id % 9 AS INT) AS x", "1 AS y", "id % 2 = 0 AS on")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        whole, cut = (packets.packed(df, "t64_x16_y16_on8", most=most).orderBy("packet").collect() for most in (packets.CUTS, 128))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.packet, len(r.data) // 13) for r in whole] == [(0, 300), (1, 300), (2, 300), (3, 100)]
    assert [(r.packet, len(r.data) // 13) for r in cut] == [(k * packets.CUTS + i, n) for k in range(4) for i, n in enumerate((128, 128, 44) if k < 3 else (100,))]
    for rows_ in (whole, cut):
        assert packets.decode(b"".join(bytes(r.data) for r in rows_), "t64_x16_y16_on8")["t"].tolist() == list(range(0, 10_000, 10))


def test_live_events_do_not_reach_the_driver(spark, monkeypatch):
    from eventloom.plans import recordings

    monkeypatch.setattr(spark, "table", lambda *_: pytest.fail("a sink in memory"))
    form = "t64_x16_y16_on8"
    rows_ = spark.createDataFrame([("a", 0, packets.encode(np.array([3]), np.array([1]), np.array([2]), np.array([True]), form))], "stream string, packet long, data binary")
    for frame, n in ((rows_, 1), (rows_.where("false"), 0)):
        assert recordings._streamed(spark, frame, "stream string, packet long, data binary", lambda live: packets.accepted_events(live, form), "append").count() == n


def test_wrapped_times_come_in_many_packets(spark, monkeypatch):
    from eventloom.plans import recordings

    seen = []
    monkeypatch.setattr(recordings, "PACKET", 16)
    streamed = recordings._streamed
    monkeypatch.setattr(recordings, "_streamed", lambda spark, rows_, *more: seen.append(rows_) or streamed(spark, rows_, *more))
    found = recordings.wrapped_times(spark, "/root/testdata/sf0.001")
    sizes = [len(r.data) // 8 for r in seen[0].collect()]
    assert max(sizes) <= 16 and len(sizes) >= 1000 // 16 and found.count() == 1000


def test_lines_are_split_once(spark):
    lines = spark.createDataFrame([(0, "5,1,2,1")], "seq long, value string")
    plan = files.parse_csv(lines, 10, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == plan.count("inline(")  # once for the rows, once for the buckets' maxima
