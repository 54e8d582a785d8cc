import datetime as dt
import random
import re

from arcspark.operators import references as R

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
DAY = dt.timedelta(days=1)
EXT = "ext_id bigint, name string, version string, requires_dist array<string>, extracted_at timestamp, key string, block int"
EDGE = "edge_id bigint, parent string, child string, dep_scope string, resolved_at timestamp, at string"
GONE = "removal_id bigint, name string, version string, reason string, removed_at timestamp, until string"


def frames(spark, ext, edges, gone):
    return spark.createDataFrame([(*r, "k", 1) for r in ext], EXT), spark.createDataFrame([(*r, "z") for r in edges], EDGE), spark.createDataFrame([(*r, "z") for r in gone], GONE)


def ids(df):
    rows = [(r.src_table, r.src_id, r.ref_no) for r in df.collect()]
    return sorted(rows, key=repr)


def norm(s):
    return re.sub("[-_.]+", "-", s.lower())


def brute(ext, edges, gone):
    refs = []
    for i, _, _, needs, at in ext:
        for n, e in enumerate(needs or []):
            m = e and re.match(r"\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)", e.split(";")[0])
            if m:
                rest = re.sub(r"\[[^\]]*\]", "", e.split(";")[0][m.end() :]).strip()
                bounds = [] if rest.startswith("@") else re.sub(r"[()\s]", "", rest).split(",")
                pins = {b.lstrip("=") for b in bounds if re.fullmatch(r"={2,3}[^=*]+", b)}
                refs.append(("extension_row", i, n, norm(m[1]), pins.pop() if len(pins) == 1 else None, at))
    for i, p, c, _, at in edges:
        for n, coord in enumerate((p, c)):
            if coord and len(x := coord.split(":", 2)) > 1 and x[1]:
                v = x[2] if len(x) > 2 else ""
                refs.append(("dependency_edge", i, n, norm(x[1]), v if v and "${" not in v else None, at))
    out = []
    for table, i, n, name, version, at in refs:
        holds = False
        for _, en, ev, _, eat in ext:
            if at is not None and en is not None and eat is not None and norm(en) == name and version in (None, ev) and eat <= at:
                holds |= not any(gn is not None and norm(gn) == name and gv in (None, ev) and gat is not None and eat <= gat <= at for _, gn, gv, _, gat in gone)
        if not holds:
            out.append((table, i, n))
    return sorted(out, key=repr)


def random_case(seed, n=120):
    rnd = random.Random(seed)
    name = lambda: rnd.choice(["a-b", "A_b", "a.b", "cc", "CC", "d", "nope", None])
    version = lambda: rnd.choice(["1.0", "2.0", "3", None])
    when = lambda: rnd.choice([None] + [T0 + DAY * rnd.randint(0, 9) for _ in range(12)])
    entry = lambda: rnd.choice(["{}", "{}==1.0", "{} (==2.0)", "{}[x]>=1,==3; python_version == '3'", "{} @ file:///x==1.0", "{}==1.*", "{}===2.0", "#", "", " ", "; extra == 'x'", "{}==1.0,==2.0", "(>=1.0)", None])
    line = lambda: (e := entry()) and e.format(name() or "zz")
    ext = [(i, name(), version(), rnd.choice([None, [], [line() for _ in range(rnd.randint(1, 4))]]), when()) for i in range(n)]
    coord = lambda: rnd.choice([None, f"pypi:{name()}:{version() or ''}", f"pypi:{name()}:${{v}}", f"pypi:{name()}"])
    edges = [(i, coord(), coord(), rnd.choice([None, "runtime"]), when()) for i in range(n)]
    gone = [(i, name(), version(), None, when()) for i in range(6)]
    return ext + ext[:5], edges + edges[:5], gone + gone[:2]


def test_against_brute_force(spark):
    for seed in range(3):
        case = random_case(seed)
        want = brute(*case)
        assert ids(R.orphans(*frames(spark, *case))) == want
        assert ids(R.orphans(*frames(spark, *case), max_filter_bytes=0)) == want


def test_removal_at_the_same_time_counts(spark):
    ext = [(1, "a", "1", None, T0), (2, "b", "1", ["a==1"], T0 + DAY), (3, "c", "1", ["a"], T0 + 2 * DAY), (4, "a", "1", ["a==1"], T0 + 3 * DAY)]
    gone = [(1, "A", None, None, T0 + 2 * DAY)]
    assert ids(R.orphans(*frames(spark, ext, [], gone))) == [("extension_row", 3, 0)]


def test_filter_has_no_false_negative(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) as key")
    for blocks in (1, 7, 400):
        for small in (True, False):
            probed = R.with_filter(keys, R.bloom_blocks(keys, blocks), blocks, small)
            assert probed.where("not maybe").count() == 0
    others = spark.range(5000).selectExpr("concat('other', id) as key")
    assert R.with_filter(others, R.bloom_blocks(keys, 313), 313).where("maybe").count() < 100


def test_empty_and_report(spark):
    assert ids(R.orphans(*frames(spark, [], [], []))) == []
    found = R.orphans(*frames(spark, [(1, "a", "1", ["zz", "yy"], T0)], [(1, "pypi:a:1", None, None, T0)], []))
    assert [tuple(r) for r in R.report(found).collect()] == [("extension_row", "2024-01", 2, 2)]


def test_reasons_do_not_depend_on_the_filter(spark):
    case = frames(spark, *random_case(4))
    reasons = [sorted((r.src_table, r.src_id, r.ref_no, r.reason) for r in R.orphans(*case, max_filter_bytes=n).collect()) for n in (R.MAX_FILTER_BYTES, 0)]
    assert reasons[0] == reasons[1] and {r[3] for r in reasons[0]} == {"unknown", "not alive"}
