import hashlib
import random

import pytest

from arcspark.functions.paths import resolve
from arcspark.llm import history as H

SCHEMA = "row_id bigint, batch_no int, file_index bigint, relative_path string, chunk_seq int, uncompressed_size bigint, checksum binary, token string, cls int, place string"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "x", 1, "y") for i, r in enumerate(rows)], SCHEMA)


def sum_of(x):
    return bytearray(hashlib.sha256(str(x).encode()).digest())


def brute(rows):
    files = {}
    for b, f, path, seq, size, check in rows:
        if b is None or f is None:
            continue
        own = files.setdefault((b, f), (set(), {}, set()))
        own[0].add(path)
        key = seq if seq is not None else ("x", bytes(check or b""))
        own[1][key] = max(own[1].get(key, 0), size or 0)
        if check is not None:
            own[2].add(bytes(check))
    taken, out = [], set()
    for (b, f), (paths, sizes, checks) in sorted(files.items()):
        path, total = min((p for p in paths if p is not None), default=None), sum(sizes.values())
        same = [g for g, p, t, c in taken if (path is not None and p is not None and resolve(p) == resolve(path) and t == total) or (checks and c and total and t and len(c & checks) * 5 >= len(c | checks) * 4)]
        out |= {(min(f, g), max(f, g)) for g in same}
        if not same:
            taken.append((f, path, total, checks))
    return out


def case(seed, n=150):
    rnd = random.Random(seed)
    sets, rows = [], []
    for f in rnd.sample(range(10_000), n):
        batch = rnd.randint(1, 12)
        kind = rnd.random()
        if sets and kind < 0.5:
            tokens = list(rnd.choice(sets))
            for _ in range(rnd.randint(0, 2)):
                if tokens and rnd.random() < 0.5:
                    tokens.pop(rnd.randrange(len(tokens)))
                else:
                    tokens.append(rnd.random())
        else:
            tokens = [rnd.choice(["hot", rnd.random()]) for _ in range(rnd.choice([0, 1, 2, 4, 5, 9, 10, 20]))]
        sets.append(tokens)
        path = rnd.choice([None, "a/b", "A\\./B", "/a/c/../b", f"p/{f}", f"p/{f % 9}", "caf%C3%A9/x", "café/x"])
        for seq, t in enumerate(tokens or [None]):
            rows.append((batch, f, path, seq, rnd.choice([0, 5]) if seq else 10 * (rnd.random() < 0.9), None if t is None or rnd.random() < 0.02 else sum_of(t)))
    rnd.shuffle(rows)
    return rows + rows[:20] + [(None, 1, "a/b", 0, 1, sum_of(1)), (1, None, "a/b", 0, 1, sum_of(1)), (3, 20_000, "q", None, None, sum_of("z")), (3, 20_000, "q", None, None, sum_of("z"))]


@pytest.mark.parametrize("hot_range, seed", [(200, 1), (8, 2), (1, 3)])
def test_against_brute_force(spark, monkeypatch, hot_range, seed):
    monkeypatch.setattr(H, "HOT_RANGE", hot_range)
    rows = case(seed)
    got = [tuple(r) for r in H.repeats(frame(spark, rows), first=6).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows) != set()


@pytest.mark.parametrize("most, hot_range", [(500_000, 200), (0, 2)])
def test_batches_against_history(spark, monkeypatch, most, hot_range):
    monkeypatch.setattr(H, "MAX_LOOKUP", most)
    monkeypatch.setattr(H, "HOT_RANGE", hot_range)
    monkeypatch.setattr(H, "SEGMENT_ROWS", 8)
    rows = case(4)
    want, h, got = brute(rows), H.History(spark), set()
    for lo, hi in ((1, 4), (5, 5), (6, 6), (7, 12)):
        got |= {tuple(r) for r in h.check(frame(spark, [r for r in rows if r[0] is not None and lo <= r[0] <= hi]), accept=True).collect()}
        if hi == 5:
            h.merge()
            assert len(h.runs) == 1
        if hi == 6:
            h = H.History(spark, h.path)
    assert got == want
    assert h.check(frame(spark, rows).where("false"), accept=True).collect() == []


def test_runs_are_merged(spark, monkeypatch):
    monkeypatch.setattr(H, "MAX_RUNS", 2)
    rows = [(b, b * 10 + f, f"p/{b}/{f}", s, 5, sum_of((b, f, s))) for b in range(4) for f in range(3) for s in range(5)]
    h = H.History(spark)
    for b in range(4):
        assert h.check(frame(spark, [r for r in rows if r[0] == b]), accept=True).collect() == []
    assert len(h.runs) == 2 and sum(r["forest"] for r in h.runs) == 12 * H.TREES == h._all("forest").count()
    again = [(9, 900 + r[1], None, *r[3:]) for r in rows]
    assert {tuple(r) for r in h.check(frame(spark, again)).collect()} == {(r[1], 900 + r[1]) for r in rows}


def read(df):
    """Rows that the scans of a plan without exchanges give out."""
    own = df._jdf.queryExecution()
    own.toRdd().count()
    leaves = own.executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_a_batch_reads_its_segments_only(spark, monkeypatch):
    """What a batch reads of runs, sets and keys doesn't grow with the history."""
    monkeypatch.setattr(H, "SEGMENT_ROWS", 64)
    seen = {}
    own = H.History._near

    def near(self, table, wanted, key, rows):
        df = own(self, table, wanted, key, rows)
        seen[table] = seen.get(table, 0) + read(df)
        return df

    batch = [(9_000, 9_000_000 + f, f"p/{f}/x", s, 5, sum_of((0, f, s))) for f in range(2) for s in range(6)]
    amounts = []
    for files in (500, 4_000):
        rows = [(1 + f // 100, f, f"p/{f}", s, 5, sum_of((0, f, s))) for f in range(files) for s in range(6)]
        h = H.History(spark)
        assert h.check(frame(spark, rows), accept=True).collect() == []
        seen.clear()
        with monkeypatch.context() as m:
            m.setattr(H.History, "_near", near)
            assert {tuple(r) for r in h.check(frame(spark, batch)).collect()} == {(0, 9_000_000), (1, 9_000_001)}
        fresh = [(*r[:5], sum_of(("new", *r[:4]))) for r in batch]
        with monkeypatch.context() as m:
            m.setattr(H.History, "_near", near)
            assert h.check(frame(spark, fresh)).collect() == []
        amounts.append(dict(seen))
        assert h._all("forest").count() == files * H.TREES
    # 2 sets of 12 trees lie in at most 24 segments of 32 to 64 rows.
    assert 0 < amounts[1]["forest"] <= 1.5 * amounts[0]["forest"] < 4_000 * H.TREES / 8
    assert amounts[1]["keys"] <= 24 * 64


def test_hot_group_is_linear(spark):
    rows = [(1 + f // 50, f, f"p/{f}", s, 5, sum_of(s)) for f in range(400) for s in range(5)]
    assert {tuple(r) for r in H.repeats(frame(spark, rows)).collect()} == {(0, f) for f in range(1, 400)}


@pytest.mark.parametrize("hot_range", [200, 6])
def test_recall_of_the_forest(spark, monkeypatch, hot_range):
    """Share of similar sets found by ranges (and, with hot nodes, by rarest members), against all pairs."""
    monkeypatch.setattr(H, "HOT_RANGE", hot_range)
    rnd = random.Random(9)
    sets = []
    for g in range(60):
        base = [f"{g}-{i}" for i in range(18)] + [f"all-{i}" for i in range(2)]
        sets += [base, base[:18] + [f"{g}-x"], base[1:]]
    rows = [(1, f, None, s, 5, sum_of(t)) for f, own in enumerate(sets) for s, t in enumerate(own)]
    rnd.shuffle(rows)
    own = H.files(frame(spark, rows))
    name = {r.cid: r.file_id for r in own.select(H.F.xxhash64("cls").alias("cid"), "file_id").collect()}
    found = H.History(spark).candidates(H.sets_of(own)).collect()
    got = {tuple(sorted((name[r.a], name[r.b]))) for r in found}
    near = {(a, b) for a in range(len(sets)) for b in range(a) if len(set(sets[a]) & set(sets[b])) * 5 >= len(set(sets[a]) | set(sets[b])) * 4}
    near = {tuple(sorted(p)) for p in near}
    assert len(got & near) >= 0.99 * len(near) > 0 and len(got) < len(sets) ** 2 / 8


def test_widening_meets_recall():
    d = H.search_depth()
    miss = lambda depth: (1 - 0.8**depth) ** H.TREES
    assert miss(d) <= 1 - H.RECALL < miss(d + 1)
    hot = H.np.zeros((3, H.TREES, H.DEPTH), bool)
    hot[1, :4, d - 1] = True
    hot[2, :, :] = True
    depth, done = H.widened(hot)
    # Four trees stay a step narrower, for which the others widen; where every node is hot nothing is searched.
    assert list(done) == [True, True, False] and set(depth[0]) == {d} and set(depth[2]) == {0}
    assert (depth[1, :4] != d).all() and H.np.where(depth[1] > 0, 1 - 0.8 ** depth[1], 1).prod() <= 1 - H.RECALL


def test_places():
    same = ["a/b.txt", "/A//b.TXT", "a\\.\\b.txt", "x/../a/b.txt", "../a/b.txt", "%61/b.txt", "./a/b.txt/"]
    assert {resolve(p) for p in same} == {"a/b.txt"} and resolve("café") == resolve("café") == resolve("CAF%C3%89")
    assert resolve(None) is None and resolve("") == "" and resolve("100%/x") == "100%/x"
