import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from arcspark.functions import archives as A
from arcspark.functions import maven as M
from arcspark.functions import packages as P
from arcspark.operators import plugins as PL


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("serde-1.0.200.crate", ("serde", "1.0.200")), ("a/tokio-1.38.0.crate", ("tokio", "1.38.0")), ("serde-derive-1.0.200.crate", ("serde-derive", "1.0.200")), ("proc-macro2-1.0.82.crate", ("proc-macro2", "1.0.82")),
        ("utf8-width-0.1.7.crate", ("utf8-width", "0.1.7")), ("not-a-crate.tar.gz", None), ("nodigits.crate", None), ("a-1-2.crate", ("a-1", "2")), (None, None),
    ],
)
def test_crates(spark, path, want):
    got = one(spark, path, P.crate)
    assert (got and tuple(got)) == want


WHEELS = {
    "numpy-1.26.0-cp312-cp312-manylinux_2_17_x86_64.manylinux2014_x86_64.whl": ("numpy", "1.26.0", None, "cp312", "cp312", "manylinux_2_17_x86_64.manylinux2014_x86_64"),
    "d/requests-2.31.0-py3-none-any.whl": ("requests", "2.31.0", None, "py3", "none", "any"),
    "package-1.0-1-py3-none-any.whl": ("package", "1.0", "1", "py3", "none", "any"),
    "my-cool-pkg-1.0-py3-none-any.whl": ("my_cool", "pkg", "1.0", "py3", "none", "any"),
    "my-cool-pkg-v1-py3-none-any.whl": ("my_cool_pkg", "v1", None, "py3", "none", "any"),
    "a-b-1.0-2x-py3-none-any.whl": ("a_b", "1.0", "2x", "py3", "none", "any"),
    "x-1-py3-none.whl": None,
    "x.tar.gz": None,
    "x-1-py3-none-any.WHL": None,
}


@pytest.mark.parametrize("path", WHEELS)
def test_wheels(spark, path):
    got = one(spark, path, P.wheel)
    assert (got and tuple(got)) == WHEELS[path]


def test_other_names(spark):
    assert tuple(one(spark, "requests-2.31.0.tar.gz", P.sdist)) == ("requests", "2.31.0", None, "source", "none", "any")
    assert one(spark, "nohyphen.zip", P.sdist) is None
    assert one(spark, "My_Cool.Package", P.pypi_name) == "my-cool-package" and one(spark, "a__b", P.pypi_name) == "a--b"
    assert one(spark, "numpy", lambda c: P.dist_info(c, F.lit("1.26.0"))) == "numpy-1.26.0.dist-info"
    none = F.lit(None).cast("string")
    assert one(spark, "netty-all", lambda c: P.maven_file(c, F.lit("4.1.109.Final"), F.lit("jar"), none)) == "netty-all-4.1.109.Final.jar"
    assert one(spark, "net.quarry.tools", lambda c: P.maven_url(c, F.lit("core"), F.lit("3"), none, F.lit("sources"))) == "https://repo1.maven.org/maven2/net/quarry/tools/core/3/core-3-sources.jar"
    assert one(spark, "Name: x\nRequires-Dist: a >=1 \r\nrequires-dist: no\nRequires-Dist:b", P.requires_dist) == ["a >=1", "b"]
    assert one(spark, -1, lambda c: P.table_name(c, F.lit("_my repo!"), F.lit(None).cast("string"), F.lit(3)), "tinyint") == "idx_255_my_repo_3"
    assert one(spark, "12ab-3", P.lenient_long) == 123 and one(spark, "-x7", P.lenient_long) == -7
    assert one(spark, "-59.32935678", P.coord_e7) == -593293567
    got = [one(spark, p, lambda c: P.matches(c, *P.MAVEN)) for p in ("a.jar", "a.war", "a.ear", "a.pom", "a.crate", "Cargo.toml", "a.JAR")]
    assert got == [True] * 4 + [False] * 3


POM = b"""<project><groupId>net.quarry</groupId><artifactId>stone-cutter</artifactId><version>4.7.2</version><packaging>war</packaging>
<dependencyManagement><dependencies><dependency><groupId>m</groupId><artifactId>m</artifactId><version>1</version></dependency></dependencies></dependencyManagement>
<dependencies><dependency><groupId>net.quarry.tools</groupId><artifactId>chisel-core_2</artifactId><version>1.9.3</version></dependency>
<dependency><groupId>junit</groupId><artifactId>junit</artifactId><version>4</version><scope>test</scope></dependency>
<dependency><groupId>n</groupId><artifactId>noversion</artifactId></dependency>
<dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version><type>zip</type><classifier>c</classifier><exclusions><exclusion><groupId>ex</groupId></exclusion></exclusions></dependency>
</dependencies></project>"""


def test_pom():
    assert M.project(POM) == {"group_id": "net.quarry", "artifact_id": "stone-cutter", "version": "4.7.2", "packaging": "war"}
    got = M.dependencies(POM)
    assert [(d["group_id"], d["artifact_id"], d["packaging"], d["classifier"]) for d in got] == [("net.quarry.tools", "chisel-core_2", "jar", None), ("ex", "a", "zip", "c")]
    assert M.dependencies(POM, exclusions_overwrite=False)[1]["group_id"] == "g"
    assert M.project(POM[:120])["version"] == "4.7.2" and M.project(b"<project>") is None and M.project(b"") is None
    assert len(M.dependencies(POM[: POM.index(b"<dependency><groupId>junit") + 10])) == 1
    assert M.project(b"<p><parent><groupId>x</groupId></parent><groupId>a &amp; b</groupId><artifactId>c</artifactId><version> 1 </version></p>")["group_id"] == "a & b"


def zipped(files):
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        for n, d in files.items():
            z.writestr(n, d)
    return sink.getvalue()


def tarred(files, mode="w:gz"):
    sink = io.BytesIO()
    with tarfile.open(fileobj=sink, mode=mode) as t:
        for n, d in files.items():
            info = tarfile.TarInfo(n)
            info.size = len(d)
            t.addfile(info, io.BytesIO(d))
    return sink.getvalue()


def test_maven_plugin(spark):
    rows = [("x.jar", zipped({"META-INF/maven/g/a/pom.xml": POM})), ("y.jar", zipped({"META-INF/MANIFEST.MF": b""})), ("z.pom", POM), ("w.jar", b"broken"), ("n.war", None), ("q.txt", POM)]
    df = spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in rows], "relative_path string, content binary")
    got = {r.relative_path: (r.group_id, r.packaging, r.pkg_type) for r in PL.maven().rows(df).collect()}
    assert got == {"x.jar": ("net.quarry", "war", 1), "z.pom": ("net.quarry", "war", 1)}
    poms = df.where("relative_path like '%.pom'")
    assert poms.select(M.project_of(F.col("content")).alias("p")).first().p.version == "4.7.2"


def test_archives(spark):
    files = {"d/a.txt": b"1", "b.toml": b"2"}
    assert dict(A.zip_find(zipped(files))) == files and dict(A.zip_find(zipped(files), "toml")) == {"b.toml": b"2"}
    for mode in ("w", "w:gz", "w:bz2"):
        assert dict(A.tar_find(tarred(files, mode))) == files
    assert list(A.zip_find(b"no")) == list(A.tar_find(b"no")) == []
    df = spark.createDataFrame([("t", bytearray(tarred(files))), ("bad", bytearray(b"x")), ("none", None)], "relative_path string, content binary")
    assert sorted((r.relative_path, r.name) for r in A.entries(df, "tar").collect()) == [("t", "b.toml"), ("t", "d/a.txt")]


def test_expand():
    import bz2
    import gzip
    import zlib

    import zstandard

    raw = b"abc" * 100
    deflate = zlib.compressobj(wbits=-15)
    packed = {"gzip": gzip.compress(raw), "bzip2": bz2.compress(raw), "zstd": zstandard.compress(raw), "deflate": deflate.compress(raw) + deflate.flush()}
    for kind, data in packed.items():
        assert A.expand(data, kind) == raw and A.expand(b"\xff\xff\xff\xff", kind) is None


def test_crate_and_wheel_contents(spark):
    toml = b"[package]\nname='x'\n[dependencies]\nserde = '1'\n# c\ntokio={version='1'}\n[dev-dependencies]\nno='1'\n"
    whl = zipped({"p/__init__.py": b"", "p-1.dist-info/METADATA": b"Name: p\nRequires-Dist: a>1\n", "p-1.dist-info/RECORD": b"r"})
    df = spark.createDataFrame([("x-1.crate", bytearray(tarred({"x-1/Cargo.toml": toml}))), ("bad-1.crate", bytearray(b"no")), ("p-1-py3-none-any.whl", bytearray(whl)), ("s-2.tar.gz", bytearray(b""))], "relative_path string, content binary")
    both = PL.Registry().register(PL.cargo(deps=True)).register(PL.pypi(deps=True))
    got = {r.relative_path: (r.name, r.dependencies, r.requires_dist) for r in both.rows(df).collect()}
    assert got == {"x-1.crate": ("x", ["serde", "tokio"], None), "bad-1.crate": ("bad", [], None), "p-1-py3-none-any.whl": ("p", None, ["a>1"]), "s-2.tar.gz": ("s", None, None)}
    assert PL.wheel_files(whl) == {"METADATA": "Name: p\nRequires-Dist: a>1\n", "RECORD": "r"}


def test_declared_plugin_and_conflicts(spark):
    p = PL.declared("size", 3, (".txt",), "size:u32,first:utf8", lambda path, data: {"size": len(data), "first": data[:1].decode()} if data else None)
    df = spark.createDataFrame([("a.txt", bytearray(b"xy")), ("b.txt", None)], "relative_path string, content binary")
    assert [tuple(r) for r in p.rows(df).collect()] == [("a.txt", 3, 2, "x")]
    q = PL.declared("other", 5, (".bin",), "size:utf8", lambda *_: None)
    with pytest.raises(ValueError):
        PL.Registry([p, q]).schema()
    answers = spark.createDataFrame([(1, '{"a": "x", "b": 3}'), (2, "null"), (3, "{broken"), (4, None)], "i int, j string")
    assert [(r.a, r.b) for r in PL.json_rows(answers, "j", "a:utf8,b:u32").orderBy("i").collect()] == [("x", 3)] + [(None, None)] * 3


def test_staged_files(spark):
    own = PL.Staged().push("a-1.0.crate", b"x").push("b.txt", b"yz")
    assert len(own) == 2 and own.total_bytes() == 3
    assert [(r.relative_path, r.name, r.version) for r in own.extract(spark, PL.cargo()).collect()] == [("a-1.0.crate", "a", "1.0")]
    assert {r.relative_path: bytes(r.content) for r in own.drain(spark).collect()} == {"a-1.0.crate": b"x", "b.txt": b"yz"}
    assert len(own) == 0 and own.drain(spark).count() == 0
