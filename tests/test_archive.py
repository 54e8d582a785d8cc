import os
import zipfile

import pytest
from pyspark.sql import functions as F

from arcspark import cli
from arcspark.operators import codec, ingest, reading
from arcspark.operators import plugins as PL
from arcspark.plans import archive
from arcspark.schema import INDEX, MANIFEST, compose, declared
from arcspark.session import materialize, shared_path
from arcspark.sources import entries, ranges

ENTRY = entries.ENTRY


def frame(spark, rows):
    return spark.createDataFrame([(p, bytearray(c) if c is not None else None, t, r) for p, c, t, r in rows], ENTRY)


def written(spark, rows, **options):
    out = shared_path(spark, "archive")
    report = archive.write(frame(spark, rows), out, **{"level": 3} | options).first()
    return archive.open(spark, out), report


THREE = [("file1.txt", b"Hello from file 1", None, None), ("subdir/file2.txt", b"Hello from subdir, file two", None, None), ("binary.bin", bytes(i % 256 for i in range(4096)), None, None)]


def test_round_trip(spark):
    own, report = written(spark, THREE)
    assert own.file_count() == 3 and report.total_files == 3 and report.compressed_files == 3
    for path, content, *_ in THREE:
        assert own.extract(path) == content and own.file_size(path) == len(content) and own.contains(path)
    assert not own.contains("nope") and own.file_size("nope") is None
    with pytest.raises(KeyError):
        own.extract("nope")
    asked = spark.createDataFrame([("file1.txt",), ("nope",)], "relative_path string")
    got = {r.relative_path: (r.content and bytes(r.content), r.error) for r in own.extract_many(asked).collect()}
    assert got == {"file1.txt": (b"Hello from file 1", None), "nope": (None, "no such file")}


def test_index_schema(spark):
    own, _ = written(spark, THREE)
    index = own.index()
    assert index.columns[:8] == INDEX.names == ["relative_path", "chunk_seq", "fdata_offset", "compressed", "uncompressed_size", "blob_offset", "blob_size", "checksum"]
    assert all(len(r.checksum) == 32 for r in index.collect())
    rows = sorted(index.collect(), key=lambda r: r.blob_offset)
    assert [r.blob_offset for r in rows] == [sum(x.blob_size for x in rows[:i]) for i in range(len(rows))]


def test_empty_file_and_empty_archive(spark):
    own, _ = written(spark, [("empty.txt", b"", None, None), ("null.txt", None, None, None)])
    assert own.file_count() == 2 and own.index().count() == 2 and own.extract("empty.txt") == b""
    own, report = written(spark, [])
    assert own.file_count() == 0 and report.total_files == 0 and own.verify().first().total_files == 0


def test_entries_with_one_path(spark):
    rows = [("a", b"AAA", None, None), ("b", b"B", None, None), ("a", b"BBBB", None, None)]
    with pytest.raises(ValueError, match="a"):
        written(spark, rows)
    numbered = frame(spark, rows).withColumn("entry_no", F.octet_length("content"))
    out = shared_path(spark, "archive")
    archive.write(numbered, out, on_duplicate="last", level=3)
    own = archive.open(spark, out)
    assert own.extract("a") == b"BBBB" and own.extract("b") == b"B" and own.file_count() == 2
    with pytest.raises(ValueError):
        archive.write(numbered, out, on_duplicate="first")


def test_slices_do_not_carry_the_content(spark):
    """What the generator passes on beside its pieces."""
    node = ingest.slices(frame(spark, THREE), 16)._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Generate":
        node = node.children().apply(0)
    assert "content" not in node.requiredChildOutput().mkString() and "relative_path" in node.requiredChildOutput().mkString()


def test_too_large_for_a_row(spark, monkeypatch):
    own, _ = written(spark, THREE)
    monkeypatch.setattr(reading, "MAX_CONTENT", 1000)
    assert own.extract("file1.txt") == b"Hello from file 1"
    with pytest.raises(Exception, match="too large"):
        own.extract("binary.bin")


def test_many_chunks(spark):
    data = bytes(i % 251 for i in range(300_000))
    own, report = written(spark, [("big.bin", data, None, None)], slice_size=1 << 16)
    assert report.chunks == 5 and own.extract("big.bin") == data
    listing = own.listing().first()
    assert listing.chunk0_size == 1 << 16 and own.files().first().file_size == 300_000
    chunks = reading.entries(own.index()).first()
    assert [c.fdata_offset for c in chunks.chunk_list] == [i << 16 for i in range(5)]


def test_stored_and_forced(spark):
    image = [("image.png", b"\xaa" * 1024, None, None), (".gz", b"x", None, None), ("A.TAR.GZ", b"y", None, None), ("noext", b"z", None, None)]
    own, report = written(spark, image)
    assert (report.uncompressed_files, report.compressed_files) == (2, 2)
    _, report = written(spark, image, no_skip=True)
    assert report.compressed_files == 4


def test_groups(spark):
    own, _ = written(spark, [("pom.xml", b"1", 1, "maven"), ("lib.jar", b"2", 1, "maven"), ("Cargo.toml", b"3", 2, "cargo"), ("x", b"4", None, None)])
    got = {(r.pkg_type, r.repo): r.row_count for r in own.manifest().collect()}
    assert got == {(1, "maven"): 2, (2, "cargo"): 1, (0, ""): 1}
    plan = own.index().where("repo = 'maven'")
    assert plan.count() == 2
    own.views("a")
    assert spark.sql("select count(*) from a_index join a_manifest using (pkg_type, repo)").first()[0] == 4


def test_verify_finds_corruption(spark):
    own, _ = written(spark, [("check.bin", bytes(i % 127 for i in range(10_000)), None, None), ("ok", b"fine", None, None), ("cut", b"z" * 100, None, None)])
    assert (own.verify().first().verified_files, own.verify().first().corrupt_files) == (3, 0)
    blobs = own.blobs().collect()
    rows = [r.asDict() for r in blobs]
    for r in rows:
        if r["relative_path"] == "check.bin":
            r["checksum"] = bytearray(32)
        if r["relative_path"] == "cut":
            r["blob"] = r["blob"][:5]
    bad = codec.decode(spark.createDataFrame(rows, own.blobs().schema))
    report = codec.verify_report(bad).first()
    assert (report.corrupt_files, report.corrupt_files_distinct, report.corrupt_bytes, report.verified_bytes, report.chunks, report.verified_files) == (1, 1, 10_000, 4, 3, 2)
    assert {r.relative_path: r.status for r in bad.collect()} == {"check.bin": "corrupt", "ok": "ok", "cut": "undecodable"}


def test_unknown_checksum_raises(spark):
    with pytest.raises(ValueError):
        codec.encode(frame(spark, THREE), algorithm="blake3")


def tree(root):
    os.makedirs(f"{root}/nested")
    files = {f"small_{i}.txt": f"content {i}".encode() for i in range(50)} | {"nested/deep.txt": b"deep", "blob.gz": b"\x1f\x8b\x08abcd", "empty.txt": b"", "big.bin": bytes(i % 256 for i in range(1 << 20)), "name with space & ü%20.txt": b"q"}
    for name, data in files.items():
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)
    return files


def read_tree(root):
    out = {}
    for d, _, names in os.walk(root):
        for n in names:
            with open(os.path.join(d, n), "rb") as f:
                out[os.path.relpath(os.path.join(d, n), root)] = f.read()
    return out


def test_folder(spark, tmp_path):
    files = tree(tmp_path / "in")
    out = str(tmp_path / "out")
    report = archive.write_dir(spark, str(tmp_path / "in"), out, slice_size=1 << 18, level=3).first()
    assert report.total_files == len(files) and report.uncompressed_files == 1
    own = archive.open(spark, out)
    done = own.extract_all(str(tmp_path / "back")).first()
    assert done.corrupt_files == 0 and read_tree(tmp_path / "back") == files
    listed = {r.relative_path: r.file_size for r in entries.listing(spark, str(tmp_path / "in")).collect()}
    assert listed == {k: len(v) for k, v in files.items()}
    raw = {r.relative_path: bytes(r.content) for r in entries.from_dir(spark, str(tmp_path / "in")).collect()}
    assert raw == files
    small = entries.from_dir(spark, str(tmp_path / "in"), max_size=1000)
    assert small.count() == len(files) - 1


def test_extract_one_group_and_unsafe_paths(spark, tmp_path):
    own, _ = written(spark, [("a", b"1", 1, "x"), ("b", b"2", 2, "y")])
    own.extract_all(str(tmp_path / "x"), repo="x").first()
    assert read_tree(tmp_path / "x") == {"a": b"1"}
    for bad in ("../a", "/etc/x", "a\\..\\..\\b"):
        with pytest.raises(ValueError):
            archive.safe_target("/tmp", bad)
    assert archive.safe_target("/r", "a..b/c") == "/r/a..b/c"


def test_plugin_columns(spark):
    rows = [("c/serde-1.0.200.crate", b"1", 2, "r"), ("p/a-1-py3-none-any.whl", b"2", 4, "r"), ("z.txt", b"3", None, None)]
    own, _ = written(spark, rows, plugins=(PL.cargo(), PL.pypi()))
    got = {r.relative_path: (r.name, r.version, r.python_tag) for r in own.index().collect()}
    assert got == {"c/serde-1.0.200.crate": ("serde", "1.0.200", None), "p/a-1-py3-none-any.whl": ("a", "1", "py3"), "z.txt": (None, None, None)}


def test_report_ratios(spark):
    index = spark.createDataFrame([("a", True, 100, 20), ("b", False, 50, 50)], "relative_path string, compressed boolean, uncompressed_size bigint, blob_size bigint")
    r = ingest.compression_report(index).first()
    assert (r.ratio_stream, round(r.ratio_dir, 6), round(r.ratio, 6)) == (500.0, round(100 / 70 * 100, 6), round(150 / 70, 6))
    r = ingest.compression_report(index.where("compressed")).first()
    assert (r.ratio_stream, r.ratio_dir) == (500.0, 0.0)


def test_prefix_sum_with_ties_and_nothing(spark):
    df = spark.createDataFrame([(i % 7, i, i % 3) for i in range(500)], "a int, b int, n int").repartition(5)
    got = sorted(ingest.prefix_sum(df, ["a", "b"], df.n, "at").collect())
    total = 0
    for r in got:
        assert r.at == total
        total += r.n
    assert ingest.prefix_sum(df.where("false"), ["a"], df.n, "at").count() == 0


def test_schema_helpers():
    assert [f.dataType.simpleString() for f in declared("a:utf8, b:u32,c:i8,d:odd,e:list")] == ["string", "int", "tinyint", "string", "array<string>"]
    assert compose().names == INDEX.names and compose(declared("g:utf8")).names[-2:] == ["pkg_type", "g"]
    assert MANIFEST.names[0] == "pkg_type"


def test_ranges(spark, tmp_path):
    with open(tmp_path / "f", "wb") as f:
        f.write(bytes(range(100)))
    open(tmp_path / "e", "wb").close()
    ranges.register(spark)
    rows = spark.read.format("byte_ranges").option("rangeSize", 30).option("taskSize", 50).load(str(tmp_path)).collect()
    assert sorted((r.relative_path, r.chunk_seq, r.fdata_offset, r.uncompressed_size) for r in rows) == [("e", 0, 0, 0), ("f", 0, 0, 30), ("f", 1, 30, 30), ("f", 2, 60, 30), ("f", 3, 90, 10)]
    assert b"".join(bytes(r.data) for r in sorted(rows, key=lambda r: r.fdata_offset)) == bytes(range(100))


def test_command_line(spark, tmp_path, capsys):
    files = tree(tmp_path / "in")
    out, back = str(tmp_path / "a"), tmp_path / "back"
    assert cli.main(["compress", "-i", str(tmp_path / "in"), "-o", out, "--level", "1"]) == 0
    assert cli.main(["verify", "-i", out]) == 0 and cli.main(["manifest", "-i", out]) == 0
    assert cli.main(["decompress", "-i", out, "-o", str(back)]) == 0
    assert read_tree(back) == files
    capsys.readouterr()
    cli.main(["list", "-i", out])
    assert "nested/deep.txt\t4" in capsys.readouterr().out


def test_materialize_keeps_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert sorted(map(tuple, materialize(df, "t").collect())) == [(1, None), (2, "x")]


def test_plugins_see_files_of_any_size_and_name(spark, tmp_path):
    root = tmp_path / "in"
    (root / "_hidden").mkdir(parents=True)
    (root / "_hidden/a-2-py3-none-any.whl").write_bytes(b"x")
    pom = b"<project><groupId>g</groupId><artifactId>a</artifactId><version>7</version></project>"
    with open(root / "big.jar", "wb+") as f:
        f.truncate(1 << 30)
        f.seek(0, 2)
        with zipfile.ZipFile(f, "a") as z:
            z.writestr("META-INF/maven/g/a/pom.xml", pom)
    with open(root / "serde-1.0.200.crate", "wb") as f:
        f.truncate((1 << 30) + 1)
    (root / "small.pom").write_bytes(pom)
    (root / "broken.jar").write_bytes(b"PK\x05\x06" + b"\xff" * 18)
    out = shared_path(spark, "archive")
    archive.write_dir(spark, str(root), out, no_skip=True, plugins=(PL.maven(), PL.cargo(), PL.pypi()), level=1)
    got = {r.relative_path: r.version for r in archive.open(spark, out).index().select("relative_path", "version").distinct().collect()}
    assert got == {"_hidden/a-2-py3-none-any.whl": "2", "big.jar": "7", "serde-1.0.200.crate": "1.0.200", "small.pom": "7", "broken.jar": None}


def test_unreadable_file_raises(spark, tmp_path):
    (tmp_path / "a.pom").write_bytes(b"<project/>")
    rows = PL.maven().rows(entries.names(spark, str(tmp_path)).withColumn("file", F.lit(str(tmp_path / "gone.pom"))))
    with pytest.raises(Exception, match="gone.pom"):
        rows.collect()


def test_permissive_reading(spark, tmp_path):
    """A range that can't be read: it fails, or leaves out its file, whole, and says so."""
    gone = ranges.Ranges([(str(tmp_path / "gone"), 0, 5)])
    with pytest.raises(OSError):
        list(ranges.RangeReader({"path": str(tmp_path)}).read(gone))
    row = list(ranges.RangeReader({"path": str(tmp_path), "mode": "permissive"}).read(gone))
    assert row[0][:5] == ("gone", 0, 0, None, 5) and "gone" in row[0][5]
    files = tree(tmp_path / "in")
    out = shared_path(spark, "archive")
    archive.write_dir(spark, str(tmp_path / "in"), out, mode="permissive", level=1, plugins=(PL.pypi(),)).first()
    own = archive.open(spark, out)
    assert own.errors().count() == 0 and own.file_count() == len(files) and own.extract("nested/deep.txt") == b"deep"
    raw = frame(spark, THREE).withColumn("error", F.when(F.col("relative_path") == "file1.txt", "bad block"))
    encoded = codec.encode(ingest.slices(raw, 8).withColumn("compressed", F.lit(True)).drop("file_size"), 1)
    partly = encoded.withColumn("error", F.when(F.col("chunk_seq") == 1, F.col("error")))
    own = archive._put(partly, shared_path(spark, "archive"), {"checksum": "sha256"})
    assert [tuple(r) for r in own.errors().collect()] == [("file1.txt", "bad block")]
    assert {r.relative_path for r in own.blobs().collect()} == {r.relative_path for r in own.index().collect()} == {"subdir/file2.txt", "binary.bin"}
    written(spark, THREE)[0].errors().collect() == []
