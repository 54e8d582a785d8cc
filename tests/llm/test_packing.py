import os
import random

import numpy as np
import pytest

from arcspark.llm import packing as P
from arcspark.llm import tokens as T

DOC = "doc_id bigint, text string, size bigint, salt int, full string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in texts], DOC)


def valid(rows, sizes, capacity):
    """Everything is placed once, nothing overlaps, nothing is split that fits."""
    held, pieces = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.size))
        held.setdefault(r.container, []).append((r.place, r.token_offset, r.size))
    for c in held.values():
        c.sort()
        assert [p for p, _, _ in c] == list(range(len(c)))
        assert sum(s for *_, s in c) <= capacity
        at = 0
        for _, offset, s in c:
            assert offset == at
            at += s
    assert sorted(held) == list(range(len(held)))
    for doc, own in pieces.items():
        own.sort()
        assert [p for p, _ in own] == list(range(len(own))) and sum(s for _, s in own) == sizes[doc]
        assert len(own) == max(1, -(-sizes[doc] // capacity))
    assert pieces.keys() == sizes.keys()
    return len(held)


@pytest.mark.parametrize("salt", [200_000, 3])
def test_packing(spark, monkeypatch, salt):
    monkeypatch.setattr(P, "PER_SALT", salt)
    rnd = random.Random(1)
    texts = [(i, "a " * rnd.choice([0, 1, 7, 7, 7, 30, 50, 64, 65, 128, 200, rnd.randint(1, 64)])) for i in range(300)]
    sizes = {i: len(t.split()) for i, t in texts}
    rows = P.pack(frame(spark, texts), 64, "words").collect()
    assert valid(rows, sizes, 64) <= 1.02 * -(-sum(sizes.values()) // 64) + 1


def test_defined_cases(spark):
    for texts in ([], [(1, None)], [(1, ""), (2, None), (3, "a"), (3, "a"), (None, "b"), (4, "x " * 128)]):
        rows = P.pack(frame(spark, texts), 64, "words").collect()
        assert sum(r.size for r in rows) == sum(len((t or "").split()) for _, t in texts)
        assert len({(r.container, r.place) for r in rows}) == len(rows) == sum(max(1, -(-len((t or "").split()) // 64)) for _, t in texts)
    assert P.report(P.pack(frame(spark, []), 64, "words")).first().containers == 0


def test_fillings_use_up_the_histogram():
    rnd = np.random.default_rng(2)
    for capacity in (10, 64, 500):
        counts = rnd.integers(0, 50, capacity + 1)
        counts[0] = 0
        left = counts.copy()
        for times, own in P.fillings(counts, capacity):
            assert times > 0 and sum(s * m for s, m in own.items()) <= capacity
            for s, m in own.items():
                left[s] -= times * m
        assert not left.any()


def test_two_for_one():
    """A bin of 6 and 3 leaves 1 of 10 unused; 3 gives way to two 2s."""
    counts = np.zeros(11, np.int64)
    counts[[6, 3]] = 1
    counts[2] = 2
    assert P.fillings(counts, 10)[0] == (1, {6: 1, 2: 2})
    counts[2] = 0
    assert P.fillings(counts, 10) == [(1, {6: 1, 3: 1})]


def test_very_large_counts():
    counts = np.zeros(101, np.int64)
    counts[[60, 41, 40, 1]] = 10**9
    plan = P.fillings(counts, 100)
    assert len(plan) < 20 and sum(t for t, _ in plan) <= 1.5 * 10**9


@pytest.mark.skipif(not os.path.isdir(T.FOLDER), reason="no tokenizers")
@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model", "words"])
def test_tokenizers(name):
    own = T.load(name)
    for text in ("", "Grüße, 1.000 Sätze!\n\n— Ende", "<|endoftext|>", "a" * 5000, "\ud800x"):
        starts = own.starts(text)
        assert len(starts) == own.count(text) and starts == sorted(starts)
    assert T.load("byte_bpe_50k.tiktoken").count("one two") == T.load("byte_bpe_50k.json").count("one two")
