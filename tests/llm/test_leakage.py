import random

from arcspark.llm import leakage as L

DOC, ITEM = "doc_id bigint, text string, item_id int", "item_id bigint, suite string, lang string, text string, doc_id int"


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1) for d in docs], DOC), spark.createDataFrame([(i, "s", "en", t, 1) for i, t in items], ITEM)


def brute(docs, items):
    out = set()
    for d, text in docs:
        w = L.words(text)
        runs = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        for i, t in items:
            own = L.words(t)
            covered = {k for a in range(len(own) - 11) if tuple(own[a : a + 12]) in runs for k in range(a, a + 12)}
            if d is not None and i is not None and covered and len(covered) * 10 >= len(own) * 4:
                out.add((d, i))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)] + ["Straße", "é"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.choice([5, 11, 12, 13, 30, 60]))) for i in range(40)] + [(40, None), (41, ""), (42, "a " * 40), (None, text(30))]
    items += [(1, items[1][1]), (50, items[5][1])]
    docs = []
    for d in range(150):
        own = L.words(rnd.choice(items)[1])
        a = rnd.randint(0, max(0, len(own) - 12))
        part = " ".join(own[a : a + rnd.choice([11, 12, 13, 24, 60])]).upper()
        docs.append((d, f"{text(rnd.randint(0, 80))} {part} {text(rnd.randint(0, 40))}"))
    docs += [(900, None), (901, ""), (None, docs[0][1]), (docs[3][0], docs[3][1]), (902, "A " * 5000), (903, "x" * 500_000 + " " + items[4][1])]
    want = brute(docs, items)
    for block in (10**6, 50):
        got = [tuple(r) for r in L.leaks(*frames(spark, docs, items), max_words=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want != set()


def test_words():
    assert L.words("Die Ge-\r\n  richts-\nbarkeit, ﬁne_x 1-\n2 Été") == ["die", "gerichtsbarkeit", "fine", "x", "1", "2", "été"]
    assert L.words(None) == L.words("") == L.words(" .,") == []


def test_empty(spark):
    docs, items = frames(spark, [(1, "a b")], [(1, "a b " * 20)])
    assert L.leaks(docs.where("false"), items).collect() == [] and L.leaks(docs, items.where("false")).collect() == []
    assert L.leaked_items(docs, items).collect() == []


def test_share_is_exact(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs, items = frames(spark, [(1, " ".join(f"w{i}" for i in range(12))), (2, " ".join(f"w{i}" for i in range(11)))], [(1, item), (2, item + " z")])
    assert {tuple(r) for r in L.leaks(docs, items).collect()} == {(1, 1)}
