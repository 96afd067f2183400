import random
import re

import numpy as np

from lodestone.llm import leakage
from lodestone.llm.leakage import leaks


def words(t):
    return re.findall(r"[^\W_]+", t.lower()) if t else []


def brute(docs, items, w=10):
    grams = {}
    for i, t in items:
        x = words(t)
        for k in range(len(x) - w + 1):
            grams.setdefault(tuple(x[k : k + w]), set()).add(i)
    out = set()
    for d, t in docs:
        x = words(t)
        for k in range(len(x) - w + 1):
            out |= {(d, i) for i in grams.get(tuple(x[k : k + w]), ())}
    return out


def sample(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["Éa", "ß", "漢字", "12"]
    text = lambda m: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "\n"]) for _ in range(m))
    items = [(i, text(rng.randrange(5, 40))) for i in range(12)] + [(12, None), (13, ""), (14, "w1 " * 40)]
    docs = []
    for d in range(n):
        t = text(rng.randrange(0, 60))
        if rng.random() < 0.5:
            x = rng.choice(items[:12])[1].split()
            a = rng.randrange(max(1, len(x) - 9))
            t += " " + " ".join(x[a : a + rng.randrange(8, 14)]).upper()
        docs.append((d, t))
    return docs + [(n, None), (n + 1, ""), (n + 2, "w1 " * 500)], items


def test_equal_windows_are_all_found(spark, monkeypatch):
    docs, items = sample(1)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs + docs[:5] + [(None, "x")]], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(i, t, "x") for i, t in items + items[:3] + [(None, "y")]], "item_id bigint, text string, doc_id string")
    want = brute(docs, items)
    got = [tuple(r) for r in leaks(d, i).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    monkeypatch.setattr(leakage, "MAX_WINDOWS", 200)  # several blocks of items
    assert {tuple(r) for r in leaks(d, i).collect()} == want


def test_a_passage_of_many_items(spark):
    """Windows that all items share enter once, and a document gets a row for each item."""
    shared = " ".join(f"s{k}" for k in range(40))
    items = [(i, f"own{i} {shared} tail{i % 3} " + " ".join(f"t{i % 3}x{k}" for k in range(12))) for i in range(300)] + [(900, shared + " " + shared)]
    docs = [(1, "x " + shared), (2, shared + " tail1 t1x0"), (3, " ".join(f"t2x{k}" for k in range(12))), (4, "s1 s2 s3")]
    import pyarrow as pa

    found = leakage._Items(np.array([i for i, _ in items]), pa.array([t for _, t in items]), 10, 0, 0.99)
    assert len(found.tables[0][1]) < 31 + 300 * 3 + 100 and len(found.set_size) < 330  # windows that differ, sets of items
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {tuple(r) for r in leaks(d, i).collect()} == brute(docs, items)


def test_edits_against_brute_force(spark):
    """All pairs of windows within one edit, of texts with many words in common."""
    docs, items = sample(3, 40)
    docs, items = [x for x in docs if x[1] and len(x[1]) < 1_000], [x for x in items if x[1] and x[0] != 14]
    grams = lambda t: {tuple(x[k : k + 10]) for x in [words(t)] for k in range(len(x) - 9)}
    code = {}
    numbers = lambda g: np.array([[code.setdefault(w, len(code)) for w in x] for x in g])
    of_items = [(i, numbers(g)) for i, t in items if (g := grams(t))]
    want = set()
    for d, t in docs:
        for x in numbers(grams(t)) if grams(t) else ():
            for i, g in of_items:
                if leakage.within_edits(np.repeat(x[None], len(g), 0), g, 1).any():
                    want.add((d, i))
    got = {tuple(r) for r in leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), edits=1).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 5


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    i = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id bigint, text string")
    assert leaks(d, i).count() == leaks(d, some).count() == 0


def test_edited_windows_reach_the_recall(spark):
    rng = random.Random(5)
    items = [(i, " ".join(f"v{rng.randrange(500)}" for _ in range(12))) for i in range(60)]
    docs = []
    for i, t in items:
        x = t.split()
        x[rng.randrange(2, 10)] = "other"
        docs.append((i, " ".join(["pad"] * 5 + x + ["pad"] * 5)))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = {tuple(r) for r in leaks(d, i, edits=1, recall=0.95).collect()}
    assert len(got & {(k, k) for k in range(60)}) >= 57
    assert all(a == b for a, b in got)  # verified on the words


def test_repetitions_reach_the_recall_at_each_place():
    rng = np.random.default_rng(9)
    n, window = 4_000, 10
    start = np.arange(n) * window
    for place in range(window):
        a = rng.integers(0, 2**63, (n, window)).astype(np.uint64)
        b = a.copy()
        b[:, place] = rng.integers(0, 2**63, n).astype(np.uint64)
        found = np.zeros(n, bool)
        for seed in range(1, 1 + leakage.repetitions(window, 1, 0.99)):
            found |= leakage.walk_keys(a.ravel(), start, window, seed) == leakage.walk_keys(b.ravel(), start, window, seed)
        assert found.mean() >= 0.987  # 0.99 less two standard errors


def test_edits_are_within_their_number():
    for edits in (1, 2, 3):
        for way in leakage.edited_windows(10, edits):
            assert leakage.within_edits(np.arange(10)[None], way[None], edits)[0]
