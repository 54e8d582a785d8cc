import struct

import pytest

from arcspark.operators import lookup, zonemap
from arcspark.sources import records


@pytest.mark.parametrize("stride", [8, 16, 24])
def test_records(spark, tmp_path, stride):
    rows = [(i * 7919 % 1000 - 500, i / 2, -i / 4) for i in range(1000)]
    pack = {8: lambda a, b, c: struct.pack("<q", a), 16: lambda *r: struct.pack("<qff", *r), 24: lambda *r: struct.pack("<qff8x", *r)}[stride]
    (tmp_path / "r").write_bytes(b"".join(pack(*r) for r in rows))
    df = records.records(spark, str(tmp_path / "r"), stride)
    got = df.orderBy("pos").collect()
    assert [r.id for r in got] == [a for a, *_ in rows] and len(got[0].payload) == stride - 8
    if stride == 16:
        assert [(r.lat, r.lon) for r in got] == [(b, c) for _, b, c in rows]
    assert [r.id for r in lookup.by_key(df, "id", "pos").collect()] == sorted(a for a, *_ in rows)
    index = lookup.build(df)
    assert [r.pos for r in lookup.find(index, -500).collect()] == [0]


def test_length_must_fit(spark, tmp_path):
    (tmp_path / "r").write_bytes(b"x" * 17)
    with pytest.raises(Exception, match="multiple"):
        records.records(spark, str(tmp_path / "r")).collect()


def test_flat_files(spark, tmp_path):
    """Elements and zone maps as flat files of 40 and 32 bytes a record, and back."""
    rows = [(i * 10, 9, i % 3, i - 5, i, -i, 1 << (i % 8)) for i in range(3000)]
    df = spark.createDataFrame(rows, "file_offset bigint, file_length bigint, kind tinyint, id bigint, lat_e7 int, lon_e7 int, tag_flags int").repartition(3)
    numbered = zonemap.number(df)
    path = str(tmp_path / "e")
    assert records.write_flat(numbered.sortWithinPartitions("elem_pos"), path, records.ELEMENTS, "elem_pos", 3000) == 3000 * 40
    assert [tuple(r)[1:] for r in records.read_flat(spark, path, records.ELEMENTS, 700).orderBy("pos").collect()] == rows
    zones = zonemap.summaries(numbered.where("kind <> 0 or elem_pos < 2048"))
    assert records.write_flat(zones, path + "z", records.ZONES, "block_id", 3) == 3 * 32
    got = records.read_flat(spark, path + "z", records.ZONES).orderBy("pos").collect()
    assert (got[0].index_start, got[0].index_end, got[0].kind_mask, got[0].lat_max) == (0, 1024, 7, 1023) and got[2].lat_min == 2**31 - 1 and got[2].lon_max == -(2**31)
    with pytest.raises(ValueError):
        records.write_flat(zones, path + "z", records.ZONES, "block_id", 4)
    with open(path, "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        records.read_flat(spark, path, records.ELEMENTS)
