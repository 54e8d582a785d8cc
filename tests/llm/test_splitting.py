import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arcspark.llm import catalog
from arcspark.llm import splitting as S
from arcspark.llm import tokens as T


def chain(step):
    at, out = 0, [0]
    while at < len(step) - 1:
        at = int(step[at])
        out.append(at)
    return out


def check(text, found, limit, overlap, own):
    assert found[0][2] == 0 and found[-1][3] == len(text)
    starts = own.starts(text)
    for a, b in zip(found, found[1:]):
        assert b[2] <= a[3] and len([s for s in starts if b[2] <= s < a[3]]) == overlap
    for _, _, a, b, n in found:
        assert n == len([s for s in starts if a <= s < b]) <= limit
    assert [p[1] for p in found] == list(range(len(found)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "Satz. ", "x, ", "\n\n", "\r\n", " ", "é", "_", "!", "字", "​"]), max_size=300), st.integers(2, 40), st.data())
def test_pieces_cover_the_text(parts, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    text = "".join(parts)
    found = S.cut_batch([text], limit, overlap)
    if not text:
        assert found == []
    else:
        check(text, found, limit, overlap, T.load("words"))
        assert (len(found) > 1) == (T.load("words").count(text) > limit)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=2, max_size=400), st.integers(3, 50), st.data())
def test_doubling_equals_walking(levels, limit, data):
    overlap = data.draw(st.integers(0, limit - 2))
    level = np.array([1, *levels, 1])
    step = S.successors(level, limit, overlap)
    assert list(S.cuts(step, np.array([0]))) == chain(step)
    at = np.arange(len(step))
    assert (step[:-1] > at[:-1]).all() and (step - np.maximum(0, at - overlap) <= limit).all()


def test_natural_boundaries_win():
    text = "one two three. four five six\n\nseven eight nine ten. eleven twelve"
    cut = [text[a:b] for _, _, a, b, _ in S.cut_batch([text], 9, 0)]
    assert cut[0].endswith("\n\n") and "".join(cut) == text


def test_batch_equals_single():
    rnd = random.Random(3)
    texts = [None, "", "   \n"] + ["".join(rnd.choice(["ab ", "c. ", "\n\n", "d"]) for _ in range(rnd.randint(1, 900))) for _ in range(30)] + ["x" * 100_000, "! " * 20_000]
    both = S.cut_batch(texts, 64, 8)
    assert both == [(i, *p[1:]) for i, t in enumerate(texts) for p in S.cut_batch([t], 64, 8)]


def test_frame(spark):
    rows = [(1, "a " * 3000, 5), (1, "a " * 3000, 5), (2, None, 5), (3, "", 5), (None, "b " * 2049, 5), (4, "c " * 2048, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, piece int")
    got = S.pieces(df).collect()
    assert sorted((r.doc_id or 0, r.piece) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 0), (1, 1), (1, 1), (4, 0)]
    assert {r.doc_id for r in S.oversized(df).collect()} == {1, None}
    assert S.pieces(df.where("false")).collect() == []
    with pytest.raises(ValueError):
        S.cut_batch(["x"], 5, 5)


@pytest.mark.skipif(not os.path.isdir(T.FOLDER), reason="no tokenizers")
@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json"])
def test_public_tokenizer(name):
    text = "The court held that. " * 300 + "\n\n" + "Es wurde entschieden; " * 200
    found = S.cut_batch([text], 128, 16, name)
    check(text, found, 128, 16, T.load(name))


@pytest.mark.skipif(not os.path.isdir(T.FOLDER), reason="no tokenizers")
def test_registered_pieces_are_under_the_limit_in_public_tokens(spark, tmp_path):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("abcdefgh") for _ in range(40_000)), "漢字かな" * 3000, "ab-" * 1500, "The court held it. " * 700]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    own = T.load(T.NAME)
    rows = sorted(catalog.p7_pieces(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id, r.piece))
    for i, text in enumerate(texts):
        of = [r for r in rows if r.doc_id == i]
        assert len(of) > 1 and of[0].start_char == 0 and of[-1].end_char == len(text)
        assert all(own.count(r.text) <= 2048 and r.text == text[r.start_char : r.end_char] for r in of)
        assert all(128 <= own.count(text[b.start_char : a.end_char]) <= 131 for a, b in zip(of, of[1:]))
    assert all(r.text.rstrip().endswith(".") for r in rows if r.doc_id == 3)


@pytest.mark.skipif(not os.path.isdir(T.FOLDER), reason="no tokenizers")
@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json"])
def test_public_tokens_inside_characters(name):
    rnd, own = random.Random(5), T.load(name)
    for _ in range(200):
        text = "".join(rnd.choice(["word", "Satz. ", "x, ", "\n\n", " ", "é", "字", "😀", "'ve", "!!!", "   ", "ༀ"]) for _ in range(rnd.randint(1, 150)))
        limit = rnd.randint(9, 40)
        found = S.cut_batch([text], limit, rnd.randint(0, limit - 8), name)
        assert found[0][2] == 0 and found[-1][3] == len(text)
        assert all(own.count(text[a:b]) <= limit for _, _, a, b, _ in found)
        assert all(a[2] < b[2] <= a[3] < b[3] for a, b in zip(found, found[1:]))
        assert list(own.located(text)[0]) == own.starts(text)
