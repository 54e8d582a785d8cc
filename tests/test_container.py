import pytest

from arcspark.operators import codec, reading
from arcspark.plans import archive
from arcspark.session import shared_path
from arcspark.sources import container as C
from arcspark.sources import entries, sinks

ROWS = [("b.txt", b"bb" * 50, 1, "x"), ("a.txt", b"a" * 10_000, 1, "x"), ("i.png", b"\x89" * 30, 2, "y"), ("empty", b"", None, None)]


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("c") / "one")
    df = spark.createDataFrame([(p, bytearray(c), t, r) for p, c, t, r in ROWS], entries.ENTRY)
    n = sinks.ContainerSink(out, extension=".arc").write(archive.encode(df, slice_size=4096, level=3))
    with open(out + ".arc", "rb") as f:
        assert len(f.read()) == n
    return out + ".arc"


def test_footers():
    assert C.footer((12345).to_bytes(8, "little")) == ("single", 12345)
    assert C.footer(C.MARK + (99999).to_bytes(8, "little")) == ("multi", 99999)
    assert C.footer(b"OTHERMRK" + (7).to_bytes(8, "little"), b"OTHERMRK") == ("multi", 7)
    with pytest.raises(ValueError):
        C.footer(b"abc")


def test_manifest_bytes():
    rows = [dict(zip(C.ARROW_MANIFEST.names, r)) for r in ((1, "central", "maven", 0, 1024, 42), (2, "crates-io", "cargo", 1024, 512, 17))]
    assert C.manifest_entries(C.manifest_bytes(rows)) == rows and C.manifest_entries(C.manifest_bytes([])) == []
    with pytest.raises(ValueError):
        C.manifest_entries(C.stream_bytes(C.pa.table({"pkg_type": [1]})))


def test_index_and_pruning(spark, path):
    index = C.index(spark, path)
    assert {(r.relative_path, r.chunk_seq): r.uncompressed_size for r in index.collect()} == {("b.txt", 0): 100, ("a.txt", 0): 4096, ("a.txt", 1): 4096, ("a.txt", 2): 1808, ("i.png", 0): 30, ("empty", 0): 0}
    one = C.index(spark, path).where("repo = 'y'")
    assert [r.relative_path for r in one.collect()] == ["i.png"] and one.rdd.getNumPartitions() == 1
    assert sorted((r.pkg_type, r.repo, r.row_count) for r in C.manifest(spark, path).collect()) == [(0, "", 1), (1, "x", 4), (2, "y", 1)]


def test_blobs(spark, path):
    files = reading.reassemble(codec.decode(C.stored_blobs(spark, path, C.index(spark, path))))
    assert {r.relative_path: bytes(r.content) for r in files.collect()} == {p: c for p, c, *_ in ROWS}


def test_without_pushdown(spark, path):
    """A session that pushes no filters to Python sources reads the same rows."""
    key = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "false")
    try:
        assert [r.relative_path for r in C.index(spark, path).where("repo = 'y'").collect()] == ["i.png"]
        assert C.index(spark, path).count() == 6 and C.manifest(spark, path).count() == 3
    finally:
        spark.conf.set(key, "true")


def test_single_index(spark, tmp_path):
    """An archive of the older form has no manifest: its one index stands at the offset in its last 8 bytes."""
    names = C.ARROW_INDEX.names
    rows = [dict(zip(names, ("a", 0, 0, False, 3, 0, 3, bytes(32)))), dict(zip(names, ("b", 0, 0, False, 1, 3, 1, bytes(32))))]
    own = C.stream_bytes(C.pa.Table.from_pylist(rows, C.ARROW_INDEX))
    (tmp_path / "x").write_bytes(b"abcd" + own + (4).to_bytes(8, "little"))
    file = str(tmp_path / "x")
    assert [tuple(r) for r in C.manifest(spark, file).select("pkg_type", "repo", "index_offset", "row_count").collect()] == [(0, "", 4, 2)]
    blobs = C.stored_blobs(spark, file, C.index(spark, file))
    assert {r.relative_path: bytes(r.blob) for r in blobs.collect()} == {"a": b"abc", "b": b"d"}
    (tmp_path / "y").write_bytes(b"data" + (99).to_bytes(8, "little"))
    with pytest.raises(Exception):
        C.manifest(spark, str(tmp_path / "y")).collect()


def test_table_sink_of_many_groups(spark):
    index = spark.createDataFrame([(f"f{i}", 0, 0, False, 1, i, 1, bytearray(32), i % 3, f"r/{i % 5}") for i in range(90)], "relative_path string, chunk_seq int, fdata_offset bigint, compressed boolean, uncompressed_size bigint, blob_offset bigint, blob_size bigint, checksum binary, pkg_type tinyint, repo string")
    sink = sinks.TableSink(spark, "ns2", location=shared_path(spark, "tables"))
    for _ in range(2):
        assert sink.write(index) > 0
    names = sink.names(index).collect()
    assert len(names) == 15 and names[0].table == "idx_000_r_0_0"
    for g in names:
        own = spark.table(f"ns2.{g.table}").collect()
        assert len(own) == 6 and {(r.pkg_type, r.repo) for r in own} == {(g.pkg_type, g.repo)}


def test_table_sink(spark):
    rows = [(p, i, 0, c, s, o, b, bytearray([i] * 32)) for i, (p, c, s, o, b) in enumerate((("a.txt", True, 100, 0, 50), ("b.bin", False, 200, 100, 200), ("c.dat", True, 300, 300, 80)))]
    index = spark.createDataFrame(rows, archive.INDEX)
    sink = sinks.TableSink(spark, "ns1", location=shared_path(spark, "tables"))
    assert sink.write(index) > 0
    assert [r.table for r in sink.names(index).collect()] == ["idx_000_0"]
    back = spark.table("ns1.idx_000_0")
    assert back.count() == 3 and dict(back.dtypes)["pkg_type"] == "int"
    with pytest.raises(ValueError):
        sink.write(index.where("false"))
