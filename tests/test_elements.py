import random

import pytest
from pyspark.sql import functions as F

from arcspark.operators import lookup, resolve, zonemap
from arcspark.sources import osm

XML = (
    b'<?xml version="1.0"?>\n<osm>\n <!-- <node id="9"> -->\n'
    b'<node id="1" lat="59.3293" lon="-18.06865555"/>\n<node id="-2" lat="-1.5" lon="2"><tag k="amenity" v="x"/><tag k="other" v="y"/></node>\n'
    b'<way id="3"><nd ref="1"/><tag k="highway" v="a"/><tag k="building" v="b"/></way>\n'
    b'<relation id="4"><member type="node" ref="1"></member><tag k="boundary" v="b"/></relation>\n<node\nid="5" lat="1" lon="1"/>\n<bounds minlat="1"/>\n'
)
WANT = [(0, 1, 593293000, -180686555, 0), (0, -2, -15000000, 20000000, 1 << 6), (1, 3, 0, 0, 3), (2, 4, 0, 0, 0)]


def body(n):
    rnd = random.Random(1)
    out = [b"<osm>\n"]
    for i in range(n):
        tag = rnd.choice(osm.TAG_KEYS).decode()
        out.append(rnd.choice([f'<node id="{i}" lat="{rnd.uniform(-90, 90):.7f}" lon="{rnd.uniform(-180, 180):.9f}"/>\n', f'<way id="{i}">\n<tag k="{tag}" v="1"/></way>\n', f'<node id="{i}" lat="1" lon="2"><tag k="{tag}" v="é"/></node>', f'<relation id="{i}"></relation> ']).encode())
    return b"".join([*out, b"</osm>"])


def test_scan():
    got = list(osm.scan(XML))
    assert [g[2:] for g in got] == WANT
    for at, n, *_ in got:
        assert XML[at : at + 1] == b"<" and XML[at : at + n].endswith(b">")
    assert osm.count(XML) == 5 and osm.next_start(XML, XML.index(b"<way") - 1) == XML.index(b"<way")
    assert osm.safe_end(XML) == XML.index(b'lon="1"/>') + 9 and osm.safe_end(XML[: XML.index(b'<bounds') - 5]) == XML.index(b'</relation>') + 11 and osm.safe_end(b"<node id='1'>") == 0
    assert [g[1] for g in osm.scan(b'<way id="1"><nd/>')] == [17]
    tab = b'<node\tid="7" lat="0.1" lon="0"/>'
    assert len(list(osm.scan(tab))) == 1 and list(osm.scan(tab, strict=True)) == []


@pytest.mark.parametrize("size", [1 << 20, 5000, 700, 64])
def test_ranges_equal_one_scan(spark, tmp_path, size):
    data = body(300)
    (tmp_path / "m.osm").write_bytes(data)
    got = [tuple(r)[1:] for r in osm.elements(spark, str(tmp_path / "m.osm"), size).orderBy("file_offset").collect()]
    assert got == list(osm.scan(data)) and len(got) == 300


def test_slices(spark, tmp_path):
    data = body(40)
    (tmp_path / "m.osm").write_bytes(data)
    found = osm.elements(spark, str(tmp_path / "m.osm"), 500).where("kind = 1")
    got = {r.file_offset: bytes(r.xml) for r in osm.sliced(found).collect()}
    assert got == {at: data[at : at + n] for at, n, kind, *_ in osm.scan(data) if kind == 1} and all(x.startswith(b"<way") for x in got.values())
    beyond = found.withColumn("file_length", F.when(F.col("file_offset") == min(got), len(data)).otherwise(F.col("file_length")))
    assert osm.sliced(beyond).count() == len(got) - 1


def test_pruned_scan_reads_its_blocks_only(spark):
    """Rows the scan gives out, by its own metrics."""
    n = 40_000
    df = spark.range(n).selectExpr("id * 10 as file_offset", "cast(id % 2 as tinyint) as kind", "id", "cast(id as int) as lat_e7", "cast(id as int) as lon_e7", "cast(if(id div 1024 in (3, 4, 30), 4, 0) as int) as tag_flags")
    stored = zonemap.store(zonemap.number(df))
    found = zonemap.filter_pruned(stored, zonemap.summaries(stored), zonemap.Filter(tag_mask=4))
    own = found._jdf.queryExecution()
    assert own.toRdd().count() == 3 * 1024
    leaves = own.executedPlan().collectLeaves()
    read = sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))
    assert 3 * 1024 <= read < n / 4
    assert zonemap.filter_pruned(stored, zonemap.summaries(stored), zonemap.Filter(tag_mask=8)).count() == 0


def frame(spark, n=3000):
    rnd = random.Random(2)
    rows = [(i * 10, 9, rnd.choice([0, 0, 1]) if i < 2048 else rnd.choice([1, 2]), i, rnd.randint(-90, 90), rnd.randint(-180, 180), 1 << rnd.randint(0, 7) if rnd.random() < 0.01 else 0) for i in range(n)]
    return spark.createDataFrame(rows, "file_offset bigint, file_length bigint, kind tinyint, id bigint, lat_e7 int, lon_e7 int, tag_flags int"), rows


def test_zone_maps_and_filters(spark):
    df, rows = frame(spark)
    numbered = zonemap.number(df)
    zones = sorted(zonemap.summaries(numbered).collect(), key=lambda z: z.block_id)
    assert [(z.index_start, z.index_end) for z in zones] == [(0, 1024), (1024, 2048), (2048, 3000)]
    for z in zones:
        own = rows[z.index_start : z.index_end]
        nodes = [r for r in own if r[2] == 0]
        flags = mask = 0
        for r in own:
            flags |= r[6]
            mask |= 1 << r[2]
        assert (z.kind_mask, z.tag_flags) == (mask, flags)
        assert z.lat_min == (min(r[4] for r in nodes) if nodes else None) and z.lon_max == (max(r[5] for r in nodes) if nodes else None)
    summary = zonemap.summaries(numbered)
    for f in (zonemap.Filter(kind=0), zonemap.Filter(kind=2), zonemap.Filter(kind=1, tag_mask=1), zonemap.Filter(tag_mask=6), zonemap.Filter(bbox=(0, 10, 0, 10)), zonemap.Filter(kind=0, bbox=(0, 3, 0, 3)), zonemap.Filter()):
        want = [r[3] for r in rows if (f.kind is None or r[2] == f.kind) and (not f.tag_mask or r[6] & f.tag_mask) and (not f.bbox or r[2] != 0 or (f.bbox[0] <= r[4] <= f.bbox[1] and f.bbox[2] <= r[5] <= f.bbox[3]))]
        assert sorted(r.id for r in zonemap.filter_scan(df, f).collect()) == want == sorted(r.id for r in zonemap.filter_pruned(numbered, summary, f).collect())
    assert {r.kind: r.elements for r in zonemap.counts(df).collect()}[2] == sum(r[2] == 2 for r in rows)


@pytest.mark.parametrize("keys", [[1, 3, 5, 7, 9, 11, 13, 15, 100, 200], [42], list(range(1, 9)), list(range(-500, 500)), [1, 1, 2, 2, 5, 5], [], [2**62, -(2**62)]])
def test_lookup(spark, keys):
    index = lookup.build(spark.createDataFrame([(k,) for k in keys], "id bigint"))
    ask = sorted({*keys, 0, 4, 16, -501, 10**9}) + [None]
    got = {r.query_pos: r.pos for r in lookup.batch(spark.createDataFrame(list(enumerate(ask)), "query_pos bigint, id bigint"), index).collect()}
    order = sorted(keys)
    assert got == {i: order.index(k) if k in keys else None for i, k in enumerate(ask)}
    near = lookup.near(spark.createDataFrame([(5,), (1,), (3,)], "id bigint").coalesce(1))
    assert [r.id for r in near.collect()] == [1, 3, 5] and "Exchange" not in near._jdf.queryExecution().executedPlan().toString()
    assert [r.pos for r in lookup.find(index, 42).collect()] == ([order.index(42)] if 42 in keys else [])


def test_sort(spark):
    for rows in ([], [(42, i) for i in range(500)], [((i * 11400714819323198485) % (1 << 50) - (1 << 49), i) for i in range(2000)], [(1 if i % 10 else -i, i) for i in range(1000)]):
        df = spark.createDataFrame(rows, "id bigint, at bigint").repartition(4)
        assert [tuple(r) for r in lookup.by_key(df, "id", "at").collect()] == sorted(rows)
        assert [r.id for r in lookup.by_key(df).collect()] == sorted(a for a, _ in rows)
        assert sorted((r.pos, r.at) for r in lookup.rank(df, ["id", "at"]).collect()) == [(i, a) for i, (_, a) in enumerate(sorted(rows))]


def test_transitive(spark):
    edges = spark.createDataFrame([("r:r:1", "a:a:1", "x"), ("a:a:1", "b:b:1", "x"), ("a:a:1", "c:c:1", None), ("b:b:1", "d:d:1", None), ("c:c:1", "d:d:1", None), ("d:d:1", "a:a:1", None), ("d:d:1", "e:e:${v}", None), ("d:d:1", "f:f:1", None), (None, "z:z:1", None), ("a:a:1", None, None)], "parent string, child string, depth string")
    direct = spark.createDataFrame([("r", "a:a:1"), ("r", "a:a:1"), ("r", "q:q:$x"), ("s", "d:d:1"), ("s", None)], "root string, coord string")
    got = {n: {(r.root, r.coord.split(":")[0]): r.depth for r in resolve.transitive(direct, edges, n).collect()} for n in (0, 1, 3, 9)}
    assert got[0] == {("r", "a"): 0, ("r", "q"): 0, ("s", "d"): 0}
    assert got[1] == got[0] | {("r", "b"): 1, ("r", "c"): 1, ("s", "a"): 1, ("s", "f"): 1}
    assert got[3] == got[9] == got[1] | {("r", "d"): 2, ("r", "f"): 3, ("s", "b"): 2, ("s", "c"): 2}


def test_regressions(spark):
    base = spark.createDataFrame([("a", 100.0, 100.0), ("b", 100.0, 100.0), ("old", 1.0, 1.0)], "name string, compress_mbs double, decompress_mbs double")
    now = spark.createDataFrame([("a", 80.0, 79.9), ("b", 200.0, 100.0), ("new", 0.0, 0.0)], base.schema)
    assert [(r.name, r.metric, round(r.drop_pct, 1)) for r in resolve.regressions(now, base).collect()] == [("a", "decompress_mbs", 20.1)]
    assert resolve.regressions(now.where(F.lit(False)), base).collect() == []
