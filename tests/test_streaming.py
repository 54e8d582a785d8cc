import datetime as dt

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from arcspark.operators import codec, reading
from arcspark.session import shared_path
from arcspark.streaming import ingest, segments, windows


def test_stream_ingest_restarts_without_duplicates(spark, tmp_path):
    out = shared_path(spark, "stream")
    for i in range(5):
        (tmp_path / f"f{i}.txt").write_bytes(b"x" * (i * 1000 + 1))
    ingest.Ingest(ingest.files(spark, str(tmp_path), 2), out, slice_size=1024).finish()
    first = ingest.published(spark, out).count()
    (tmp_path / "g.txt").write_bytes(b"new")
    report = ingest.Ingest(ingest.files(spark, str(tmp_path), 2), out, slice_size=1024).finish().first()
    assert report.total_files == 6 and ingest.published(spark, out).count() == first + 1
    before = ingest.published(spark, out)
    assert ingest.publish(spark, out).first() == report
    # Readers of what was published before still have it.
    assert before.count() == first + 1 and ingest.published(spark, out, "manifest").first().row_count == first + 1


def test_windows(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, t + dt.timedelta(minutes=m), u, 1.0) for i, (m, u) in enumerate([(0, 1), (29, 1), (60, 1), (61, 2), (62, 2), (200, 2)])]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, value double")
    assert sorted((r.window_start.hour, r.events, r.total) for r in windows.tumbling(df, value="value").collect()) == [(0, 2, 2.0), (1, 3, 3.0), (3, 1, 1.0)]
    assert sorted((r.user_id, r.events) for r in windows.sessions(df).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_streamed_windows_drop_late_and_repeated_events(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    schema = "event_id bigint, ts timestamp, user_id bigint"
    put = lambda rows: spark.createDataFrame([(i, t + dt.timedelta(minutes=m), 1) for i, m in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([(1, 0), (1, 0), (2, 10), (3, 300)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = windows.tumbling(windows.distinct_within(stream, "1 hour"), "1 hour")
    run = lambda: out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    run()
    put([(4, 5)])
    run()
    assert [(r.window_start, r.events) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(t, 2)]


@pytest.mark.parametrize("size", [1 << 20, 100, 7, 3])
def test_segments_over_ranges(spark, tmp_path, size):
    lines = [b"%d;%s" % (i, b"y" * (i % 13)) for i in range(60)] + [b"", b"last"]
    (tmp_path / "a").write_bytes(b"\n".join(lines))
    kind = StructType([StructField("text", StringType()), StructField("n_bytes", LongType())])
    df = segments.transform(spark, str(tmp_path / "a"), lambda r: [(r.decode(), len(r))], kind, range_size=size)
    assert [r.text.encode() for r in df.orderBy("at", "n").collect()] == lines
    tail = segments.transform(spark, str(tmp_path / "a"), lambda r: [], kind, range_size=size, finish=lambda: [("end", 0)])
    assert tail.count() == -(-len(b"\n".join(lines)) // size)


@pytest.mark.parametrize("size", [1 << 20, 64, 11, 3])
def test_own_splitter_over_ranges(spark, tmp_path, size):
    """Segments that begin with '>' and end where the next begins, in parallel; the last one of the file is told."""
    parts = [b">%d%s" % (i, b"x\n" * (i % 5)) for i in range(40)]
    (tmp_path / "a").write_bytes(b"".join(parts))

    def split(data):
        starts = [i for i, c in enumerate(data) if c == 62]
        return [data[a:b] for a, b in zip(starts, starts[1:])], starts[-1] if starts else 0

    kind = StructType([StructField("text", StringType()), StructField("last", LongType())])
    df = segments.transform(spark, str(tmp_path / "a"), lambda r, last: [(r.decode(), int(last))], kind, range_size=size, split=split, find_start=lambda data, at: data.find(b">", at), chunk=16, with_last=True)
    rows = df.orderBy("at").collect()
    assert [r.text.encode() for r in rows] == parts and [r.last for r in rows] == [0] * 39 + [1]
    lines = segments.transform(spark, str(tmp_path / "a"), lambda r, last: [(r.decode(), int(last))], kind, range_size=size, with_last=True).orderBy("at").collect()
    assert "".join(r.text for r in lines).encode() == b"".join(parts) and [r.last for r in lines] == [0] * (len(lines) - 1) + [1]
    with pytest.raises(ValueError):
        segments.transform(spark, str(tmp_path / "a"), lambda r: [], kind, split=split)


def test_carry():
    data = b"aa|bbb|c|dddd"
    for chunk in (1, 2, 5, 100):
        at = iter(range(0, 1000, chunk))
        got = list(segments.segments_of(lambda n: (lambda i: data[i : i + n])(next(at)), segments.by_delimiter(b"|"), chunk))
        assert [(o, s) for o, s, _ in got] == [(0, b"aa|"), (3, b"bbb|"), (7, b"c|"), (9, b"dddd")] and [x for *_, x in got] == [False] * 3 + [True]
    with pytest.raises(ValueError):
        list(segments.segments_of(lambda n: b"x" * n, segments.by_delimiter(), 10, limit=35))
    assert list(segments.segments_of(lambda n: b"", segments.by_delimiter(), 10)) == []


def test_segment_bytes(spark):
    df = spark.createDataFrame([("p", 5, 0, bytearray(b"b")), ("p", 0, 0, bytearray(b"a")), ("q", 0, 0, bytearray(b"z"))], "path string, at bigint, n bigint, data binary")
    assert {r.path: bytes(r.content) for r in segments.bytes_of(df).collect()} == {"p": b"ab", "q": b"z"}


def test_stream_keeps_folders(spark, tmp_path):
    root = tmp_path / "in"
    for d in ("a", "b/c"):
        (root / d).mkdir(parents=True)
        (root / d / "pom.xml").write_bytes(d.encode())
    out = shared_path(spark, "stream")
    report = ingest.Ingest(ingest.files(spark, str(root)), out).finish().first()
    got = {r.relative_path: bytes(r.content) for r in reading.reassemble(codec.decode(spark.read.parquet(f"{out}/blobs"))).collect()}
    assert report.total_files == 2 and got == {"a/pom.xml": b"a", "b/c/pom.xml": b"b/c"}
    out = shared_path(spark, "stream")
    ingest.Ingest(ingest.files(spark, f"{root}/*"), out).finish()
    assert {r.relative_path for r in ingest.published(spark, out).collect()} == set(got)
