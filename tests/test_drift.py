import collections
import json
import random

from pyspark.sql import functions as F

from arcspark.operators import drift
from arcspark.plans import catalog

SCHEMA = "line_id bigint, series string, file_name string, file_seq int, line_no int, raw string, tag string, n string, field int"


def frame(spark, rows):
    return spark.createDataFrame([(i, s, "f", f, n, raw, "x", "y", 1) for i, (s, f, n, raw) in enumerate(rows)], SCHEMA)


def brute(rows):
    """Changes by the statement of the problem, file after file."""
    files = {}
    done = set()
    for s, f, n, raw in rows:
        if s is None or f is None or (s, f, n) in done:
            continue
        done.add((s, f, n))
        leaves = drift.leaf_values(raw)
        if not leaves:
            continue
        own = files.setdefault((s, f), {})
        for _, path, tag, *_, text in leaves:
            if tag == "object":
                continue
            tag = "number" if tag == "integer" else tag
            kinds, values = own.setdefault(path, (collections.Counter(), set()))
            if text is not None:
                kinds[tag] += 1
                values.add(text)
    kind = lambda c: min(c, key=lambda k: (-c[k], k)) if c else None
    out = set()
    for s in {s for s, _ in files}:
        order = sorted(f for x, f in files if x == s)
        for a, b in zip(order, order[1:]):
            old, new = files[s, a], files[s, b]
            gone, came = old.keys() - new.keys(), new.keys() - old.keys()
            pairs = {(g, c) for g in gone for c in came if old[g][1] & new[c][1]}
            out |= {(s, b, "renamed", g, c) for g, c in pairs} | {(s, b, "retyped", g, c) for g, c in pairs if kind(old[g][0]) != kind(new[c][0])}
            out |= {(s, b, "removed", g, "") for g in gone - {g for g, _ in pairs}} | {(s, b, "added", "", c) for c in came - {c for _, c in pairs}}
            out |= {(s, b, "retyped", p, p) for p in old.keys() & new.keys() if None not in (kind(old[p][0]), kind(new[p][0])) and kind(old[p][0]) != kind(new[p][0])}
    return out


def found(df):
    rows = [tuple(r) for r in drift.changes(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for s in ("bench-a", "bench-b", "manifest-c"):
        for f in rnd.sample(range(1, 9000), 12):
            names = rnd.sample(["version", "ver", "cores", "host.cores", "files", "module"], 4)
            for n in range(rnd.randint(1, 6)):
                o = {}
                for name in names:
                    v = rnd.choice([rnd.randint(1, 40), str(rnd.randint(1, 40)), None, True, [1, 2], rnd.random()])
                    head, _, tail = name.partition(".")
                    if tail:
                        o[head] = {tail: v}
                    else:
                        o[name] = v
                o["results"] = [{"name": "x", "files": rnd.choice([1, "1", None])} for _ in range(rnd.randint(0, 3))]
                rows.append((s, f, n, json.dumps(o)))
    rows += [("bench-a", 5, 0, '{"a": 1'), ("bench-a", 6, 0, "[1]"), ("bench-a", 7, 0, ""), ("bench-a", 7, 1, None), (None, 1, 1, "{}"), ("bench-a", None, 1, '{"a": 1}')]
    assert found(frame(spark, rows)) == brute(rows) != set()


def test_defined_cases(spark):
    rows = [
        ("s", 1, 1, '{"a": 8, "b": null, "l": [1, 2], "o": {}}'),
        ("s", 1, 1, '{"zzz": 1}'),  # the same line again
        ("s", 3, 1, '{"x": {"a": "8"}, "b": 1, "l": [{"k": 1}, 2]}'),
        ("s", 4, 1, '{"x": {"a": "9"}, "b": "1", "l": [{"k": true}, 2]}'),
        ("s", 4, 2, '{"a": NaN}'),
    ]
    assert found(frame(spark, rows)) == {
        ("s", 3, "renamed", "a", "x.a"), ("s", 3, "retyped", "a", "x.a"), ("s", 3, "added", "", "l.k"), ("s", 3, "retyped", "l", "l"),
        ("s", 4, "retyped", "b", "b"), ("s", 4, "retyped", "l.k", "l.k"),
    }


def test_odd_values():
    leaf = {(e, p): rest for e, p, *rest in drift.leaf_values('{"a": "\\ud800", "b": [], "c": [[{"d": 1}]], "e": 1e400, "f": ' + "9" * 400 + "}")}
    assert leaf["", "a"][1] == "?" and leaf["", "b"][0] == "array" and ("0.0", "c.d") in leaf
    assert leaf["", "f"][0] == "integer" and leaf["", "f"][2] is None and leaf["0.0", "c"][0] == "object"
    assert drift.leaf_values("[" * 100_000) == [] and drift.leaf_values("1") == []
    for raw in ('{"": {"a": 1, "": 2}, "b": [[1, {"c": null}], {"d": [1, "x"]}, 3, []], "e": {}, "f": [true]}', '{"a": 1.0, "b": 1e400, "c": -0.0, "d": 1e22}'):
        value, out = json.loads(raw), []
        drift._gather(value, "", out)
        assert out == [(p, v) for p, _, v in drift._walk(value, "", "", False)]
        assert all(drift.tagged(v)[1] == json.dumps(v) for _, v in out if v is not None and not isinstance(v, str))


def test_empty(spark):
    df = frame(spark, [("s", 1, 1, "{}")]).where("false")
    assert found(df) == set() and drift.records(df).count() == 0


def test_records_are_one_table(spark):
    rows = [("s", 1, 1, '{"cores": 8, "results": [{"files": 1}, {"files": 2}]}'), ("s", 2, 1, '{"n_cores": "8", "results": [{"files": "3"}]}'), ("t", 1, 1, '{"cores": 4}'), ("t", 2, 1, '{"cores": "many"}')]
    long = drift.records(frame(spark, rows))
    got = {(r.series, r.file_seq, r.entry, r.field, r.source_field, r.tag, r.canonical_value) for r in long.collect()}
    # As many numbers as strings under 'cores': the last in order of the two types holds.
    assert got == {
        ("s", 1, "", "cores", "cores", "integer", "8"), ("s", 2, "", "cores", "n_cores", "string", "8"), ("t", 1, "", "cores", "cores", "integer", "4"), ("t", 2, "", "cores", "cores", "string", "many"),
        ("s", 1, "0", "results.files", "results.files", "integer", "1"), ("s", 1, "1", "results.files", "results.files", "integer", "2"), ("s", 2, "0", "results.files", "results.files", "string", "3"),
        ("s", 1, "0", "results", "results", "object", None), ("s", 1, "1", "results", "results", "object", None), ("s", 2, "0", "results", "results", "object", None),
    }
    wide = drift.wide(long, {"cores": "cores", "files": "results.files"})
    # What stands beside a list holds for its entries.
    assert {(r.series, r.file_seq, r.entry, r.cores, r.files) for r in wide.collect()} == {("s", 1, "0", "8", "1"), ("s", 1, "1", "8", "2"), ("s", 2, "0", "8", "3"), ("t", 1, "", "4", None), ("t", 2, "", "many", None)}


def test_values_carried_down_and_kept_exactly(spark):
    rows = [("s", 1, 1, '{"v": 9007199254740993, "r": [{"a": 1.5, "q": [{"b": 1}, {"b": 2}]}, {"a": null}], "o": {}}'), ("s", 2, 1, '{"v": {"w": 77}}')]
    long = drift.records(frame(spark, rows))
    exact = long.where("field = 'v' and tag = 'integer'").first()
    assert str(exact.integer_value) == "9007199254740993" and exact.number_value is None
    kinds = {(r.field, r.tag, r.first_file) for r in drift.alternatives(long).collect()}
    assert {("v", "integer", 1), ("v", "object", 2), ("o", "object", 1), ("r.a", "number", 1), ("r.a", "null", 1)} <= kinds
    got = {(r.file_seq, r.entry, r.v, r.a, r.b) for r in drift.wide(long, {"v": "v", "a": "r.a", "b": "r.q.b"}).collect()}
    v = "9007199254740993"
    assert got == {(1, "0.0", v, "1.5", "1"), (1, "0.1", v, "1.5", "2"), (1, "1", v, None, None), (2, "", None, None, None)}


def test_lines_loaded_again(spark, monkeypatch):
    rows = [("s", 1, n % 3 if n % 4 else None, f'{{"a": {n}}}') for n in range(12)] + [("s", 2, 1, '{"b": 1}')]
    want = brute(rows)
    for most in (200_000, 0):
        monkeypatch.setattr(drift, "MAX_LOOKUP", most)
        assert found(frame(spark, rows)) == want
        once = drift.lines_once(frame(spark, rows)).collect()
        assert sorted((r.file_seq, r.line_no, r.line_id) for r in once if r.line_no is not None) == [(1, 0, 3), (1, 1, 1), (1, 2, 2), (2, 1, 12)] and len(once) == 7


def test_runs_keep_a_field_whose_new_name_prevails(spark, tmp_path):
    rows = [("s", 1, 1, '{"cores": 8, "version": "a"}'), ("s", 2, 1, '{"n_cores": 8, "version": "a"}'), ("s", 3, 1, '{"n_cores": 4, "version": "a"}')]
    frame(spark, rows).write.parquet(str(tmp_path / "history_line.parquet"))
    got = {(r.file_seq, r.cores, r.version, r.files) for r in catalog.p1_runs(spark, str(tmp_path)).collect()}
    assert got == {(1, "8", "a", None), (2, "8", "a", None), (3, "4", "a", None)}
