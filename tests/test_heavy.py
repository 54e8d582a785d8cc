import math
import random

import pytest

from arcspark.operators import heavy as H

MAN = "entry_id bigint, batch_no int, pkg_type tinyint, repo string, module_name string, part_no int, index_len bigint, row_count bigint, lo int, n string"


@pytest.mark.parametrize("max_keys", [50_000, 0])
def test_exact_quantiles(spark, monkeypatch, max_keys):
    monkeypatch.setattr(H, "MAX_KEYS", max_keys)
    monkeypatch.setattr(H, "HEAVY_PART", 2)
    rnd = random.Random(3)
    rows = [("hot", rnd.randint(-(10**6), 10**6)) for _ in range(3000)] + [("same", 7)] * 50 + [("wide", v) for v in (-(2**63), 2**63 - 1, 0, 5, None)] + [("null", None)] * 3 + [("one", 3), (None, 4)]
    df = spark.createDataFrame(rows, "k string, v bigint").repartition(3)
    got = {r.k: r for r in H.profile(df, ["k"], "v", (0.0, 0.25, 0.5, 0.999)).collect()}
    for key in {k for k, _ in rows if k}:
        values = sorted(v for k, v in rows if k == key and v is not None)
        for q, col in ((0.0, "p0"), (0.25, "p25"), (0.5, "p50"), (0.999, "p99_9")):
            assert got[key][col] == (values[max(1, math.ceil(q * len(values))) - 1] if values else None), (key, q)
        assert got[key].rows == sum(k == key for k, _ in rows) and got[key].n == len(values)


def test_heavy_keys(spark):
    rows = [(1, 1, 1, "r", None, 0, 9, 96), (2, 1, 1, "r", "x", 0, 9, 96), (3, 1, None, None, None, 0, 9, 2), (4, 1, 0, "", None, 1, 9, 2), (5, 1, 2, "q", None, 0, 9, None)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], MAN)
    assert sorted(tuple(r) for r in H.heavy_keys(df).collect()) == [(0, ""), (1, "r")]
    assert H.heavy_keys(df.where("false")).collect() == [] and H.heavy_keys(df.where("entry_id = 5")).collect() == []


def test_key_results(spark):
    man = spark.createDataFrame([(1, 1, 1, "r", None, 0, 9, 4, 1, "z"), (2, 1, 3, "only", None, 0, 9, 1, 1, "z")], MAN)
    index = spark.createDataFrame([(1, 1, 0, 1, "r", 10, "p"), (1, 1, 0, 1, "r", 10, "p"), (1, 1, 1, 1, "r", 30, "p"), (1, 2, 0, None, None, None, "p")], "batch_no int, file_index bigint, chunk_seq int, pkg_type tinyint, repo string, uncompressed_size bigint, parts string")
    got = {(r.pkg_type, r.repo): tuple(r)[2:] for r in H.key_results(man, index).collect()}
    assert got == {(1, "r"): (1, 4, 2, 40, 1, 10, 30, 30, True), (3, "only"): (1, 1, 0, 0, 0, None, None, None, True), (0, ""): (0, 0, 1, 0, 1, None, None, None, False)}
    assert H.key_results(man.where("false"), index.where("false")).collect() == []


def test_heavy_keys_by_ranks(spark):
    """Against sums of all keys, with keys at the very threshold and ones just under it."""
    rnd = random.Random(7)
    for total in (100, 2_500, 10_007):
        weights, left = [], total
        while left > 0:
            w = min(left, rnd.choice([total // 25, -(-total // 25), total // 25 - 1, 1, 3, total // 9]))
            weights.append(w)
            left -= w
        rows = [(i, 1, 1, f"r{k}", None, i, 9, part, 1, "z") for i, (k, part) in enumerate((k, p) for k, w in enumerate(weights) for p in (w // 2, w - w // 2))]
        got = {r.repo for r in H.heavy_keys(spark.createDataFrame(rows, MAN).repartition(3)).collect()}
        assert got == {f"r{k}" for k, w in enumerate(weights) if w * 25 >= total} != set()
