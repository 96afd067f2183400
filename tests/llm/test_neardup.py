import random
import re

import numpy as np

from lodestone.llm import neardup
from lodestone.llm.neardup import Forest, components, groups, similar_pairs


def shingles(t, n):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= 12 else set()


def brute(rows, n, threshold):
    sets = {i: s for i, t in rows if i is not None and (s := shingles(t, n))}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def sample(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Éa", "ß", "漢"] + [f"w{i}" for i in range(400)])
    rows = []
    for g in range(40):
        base = [word() for _ in range(rng.randrange(14, 90))]
        for _ in range(rng.randrange(1, 5)):
            x = list(base)
            for _ in range(rng.randrange(0, 5)):
                k = rng.randrange(len(x))
                if rng.random() < 0.5:
                    x[k] = word()
                else:
                    x[k:k] = [word()]
            rows.append((len(rows) * 3, (", " if g % 2 else " ").join(x)))
    n = len(rows) * 3
    return rows + [(n, rows[0][1].upper()), (n + 1, rows[0][1]), (n + 2, None), (n + 3, ""), (n + 4, "few words only"), (n + 5, "same " * 300), (n + 6, "same " * 500)]


def test_pairs_groups_and_blocks(spark):
    rows = sample(1)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows + rows[:7] + [(None, rows[0][1])]], "id bigint, content string, a int")
    want = brute(rows, 3, 0.6)
    for node_rows in (8_192, 3):
        got = [tuple(r) for r in similar_pairs(df, 0.6, 3, node_rows=node_rows).collect()]
        assert len(got) == len(set(got)) and set(got) <= want
        assert len(got) >= 0.97 * len(want) > 0
    out = groups(df, 0.6, 3).collect()
    assert sorted(r.id for r in out) == sorted(i for i, t in rows if shingles(t, 3))
    assert all(r.group_id <= r.class_id <= r.id for r in out)
    by = {r.id: r.group_id for r in out}
    assert all(by[a] == by[b] for a, b in got)


def test_five_words_by_default_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, text + " more"), (3, text.replace("w30", "x"))], "id bigint, content string")
    assert {tuple(r) for r in similar_pairs(df).collect()} == brute([(1, text), (2, text + " more"), (3, text.replace("w30", "x"))], 5, 0.8)
    assert similar_pairs(df.limit(0)).count() == groups(df.limit(0)).count() == 0


def test_search_finds_all_within_the_limit():
    rng = np.random.default_rng(2)
    fp = rng.integers(0, 2**63, (700, 2)).astype(np.uint64)
    near = fp[:300] ^ (np.uint64(1) << rng.integers(0, 63, (300, 2)).astype(np.uint64))
    fp = np.concatenate([fp, near])
    g = neardup.gray_rank(fp[:, 0], fp[:, 1])
    fp = fp[np.lexsort((g[1], g[0]))]
    d = np.bitwise_count(fp[:, None, :] ^ fp[None, :, :]).sum(2)
    # one tree, and a forest of trees of 1, 2, ... and many rows
    sizes = [1, 2, 3, 16, 17, 1, 40, 256, 300, 364]
    for key in (np.zeros(len(fp), np.int64), np.repeat(np.arange(len(sizes)), sizes)):
        for work in (1 << 21, 500):
            i, j = Forest(fp, key).near(30, work)
            want = np.nonzero(np.triu((d <= 30) & (key[:, None] == key[None, :]), 1))
            assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(*(x.tolist() for x in want)))
    assert [len(x) for x in Forest(fp[:0], key[:0]).near(30)] == [0, 0]


def test_rows_of_a_hot_node_grow_in_proportion(spark, monkeypatch):
    """A pattern that a third of many records share, 100,000 of them: refined, not cut into pairs of blocks."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    def classes(n):  # each third record in one node; twins of equal values
        twin = (F.col("id") / 2).cast("bigint")
        r = lambda k: F.xxhash64(twin, F.lit(k))
        hot = F.when(F.col("id") % 6 < 2, F.lit(7)).otherwise(r(100))
        return spark.range(n).select(
            "id", r(1).alias("hi"), r(2).alias("lo"), F.array(hot, r(101)).alias("keys"), F.array(*(F.hash(twin, F.lit(k)) for k in range(neardup.REFINED * neardup.DEPTH))).alias("more")
        )

    small = neardup.candidates(classes(6_000), 10, node_rows=100)
    assert {tuple(x) for x in small.collect()} == {(i, i + 1) for i in range(0, 6_000, 2)}

    def counted(limit, two_blocks):
        def run(batches):
            n = sum(b.num_rows for b in batches)
            yield pa.RecordBatch.from_arrays([pa.array([np.random.default_rng().integers(2**62)]), pa.array([n])], names=["a", "b"])

        return run

    monkeypatch.setattr(neardup, "_search_nodes", counted)
    searched = [neardup.candidates(classes(n), 10, node_rows=1_000).agg(F.sum("b")).first()[0] for n in (30_000, 300_000)]
    assert searched[1] < 11 * searched[0] and searched[1] < 300_000 * (1 + neardup.REFINED)


def test_nodes_stay_whole_where_hot_keys_are_joined_adaptively(spark):
    """Large tables: nothing says beforehand that the hot keys are few, only the adaptive plan sees it."""
    from pyspark.sql import functions as F

    twin = F.pmod("id", F.lit(3_000))  # twins stand in different partitions
    r = lambda k: F.xxhash64(twin, F.lit(k))
    classes = spark.range(6_000).select(
        "id", r(1).alias("hi"), r(2).alias("lo"), F.array(F.when(twin % 30 == 0, F.lit(7)).otherwise(r(100)), r(101)).alias("keys"), F.array(*(F.hash(twin, F.lit(k)) for k in range(neardup.REFINED * neardup.DEPTH))).alias("more")
    )
    limits = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        got = neardup.candidates(classes, 10, node_rows=100).collect()
    finally:
        for k in limits:
            spark.conf.unset(k)
    assert {tuple(x) for x in got} == {(i, i + 3_000) for i in range(3_000)}


def test_neighbours_in_gray_code_differ_in_one_bit():
    value = np.arange(64, dtype=np.uint64)
    code = value ^ (value >> np.uint64(1))
    assert (neardup.gray_rank(np.zeros(64, np.uint64), code)[1] == value).all()


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (100, 102), (7, 200)]
    pairs += [(300, k) for k in range(301, 340)]  # a hub
    for hub in (100_000, 10):
        got = {r.id: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint"), hub).collect()}
        assert {k: v for k, v in got.items() if k >= 300} == dict.fromkeys(range(300, 340), 300)
    got = {k: v for k, v in got.items() if k < 300}
    assert got == {**{i: 0 for i in range(61)}, 200: 0, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
