import numpy as np
import pyarrow as pa

from lodestone.llm.neighbours import EqualRows, Pivots, cells, nearest, neighbour_pairs, unit_rows, vector_hash

DIMS = 24
SCHEMA = "id bigint, embedding array<float>, other string"


def truth(ids, x, k):
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -9)
    order = np.argsort(-s, axis=1, kind="stable")[:, :k]  # ids ascend, so ties go to the smaller
    return {int(i): [int(ids[c]) for c in row] for i, row in zip(ids, order)}


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, DIMS))
    x = centres[rng.choice(12, n, p=[0.4] + [0.6 / 11] * 11)] + 0.3 * rng.normal(size=(n, DIMS))
    return (x * rng.uniform(0.5, 4, (n, 1))).astype(np.float32)


def test_recall_against_brute_force(spark):
    x = clustered(1_500, 1)
    ids = np.arange(len(x)) * 2
    df = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, x)], SCHEMA)
    want = truth(ids, x, 10)
    for options in ({}, {"file_rows": 150}, {"task_rows": 150}, {"exact": True}):  # the second divides files, the third cuts them
        got = {}
        for r in nearest(df, 10, DIMS, **options).collect():
            got.setdefault(r.id, []).append(r.other)
        assert all(len(v) == 10 for v in got.values()) and len(got) == len(ids)
        assert sum(len(set(got[i]) & set(want[i])) for i in got) >= 0.9 * 10 * len(ids)


def test_recall_of_divided_files_in_many_dimensions(spark):
    """Few pivots, as a very large collection has for its size, files divided and cut over tasks."""
    rng = np.random.default_rng(8)
    n, inner, dims = 3_000, 10, 768
    centres = rng.normal(size=(20, inner))
    x = centres[rng.choice(20, n, p=[0.35] + [0.65 / 19] * 19)] + 0.4 * rng.normal(size=(n, inner))
    x = np.tanh(x @ rng.normal(size=(inner, dims)) / 3).astype(np.float32)
    ids = np.arange(n)
    want = truth(ids, x, 10)
    df = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, x)], SCHEMA).repartition(4)
    for options in ({"max_pivots": 64}, {"max_pivots": 64, "file_rows": 100}, {"max_pivots": 64, "file_rows": 100, "task_rows": 150}):
        got = {}
        for r in nearest(df, 10, **options).select("id", "other").collect():
            got.setdefault(r.id, set()).add(r.other)
        assert sum(len(got[i] & set(want[i])) for i in got) >= 0.95 * 10 * n, options


def test_pivots_in_groups_are_nearly_the_nearest():
    x = clustered(4_000, 9)
    _, x = unit_rows(pa.array(x.tolist(), pa.list_(pa.float32())), DIMS)
    index = Pivots(x[:900])
    got, sim = index.orders(x, 8)
    full = np.argsort(-(x @ x[:900].T), axis=1, kind="stable")[:, :8]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(got, full)]) >= 0.95 * 8
    assert np.allclose(sim, np.take_along_axis(x @ x[:900].T, got, 1), atol=1e-5) and (np.diff(sim, axis=1) <= 0).all()
    few, _ = Pivots(x[:3]).orders(x, 8)
    assert few.shape == (4_000, 3) and (np.sort(few, axis=1) == np.arange(3)).all()


def test_equal_rows_keep_few_of_a_large_class():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3, 64))
    x = (v[rng.choice(3, 5_000, p=[0.9, 0.09, 0.01])] * rng.uniform(0.3, 5, (5_000, 1))).astype(np.float32)
    rows, got = EqualRows(4), {}
    for a in range(0, 5_000, 700):
        for q, c in zip(*rows.add(np.arange(a, min(a + 700, 5_000)), x[a : a + 700])):
            got.setdefault(q, []).append(c)
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    same = np.round(y @ y.T, 9) >= 1
    assert all(sorted(got[i]) == np.flatnonzero(same[i])[:4].tolist() for i in range(5_000))
    assert len(rows.ids) <= 3 * 4


def test_unusable_repeated_and_equal_vectors(spark):
    x = clustered(60, 2)
    same = x[0]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(100 + i, (same * (1 + i % 2)).tolist(), "x") for i in range(30)]
    bad = [(200, None, "x"), (201, [1.0] * (DIMS - 1), "x"), (202, [0.0] * DIMS, "x"), (203, [float("nan")] + [1.0] * (DIMS - 1), "x"), (204, [None] + [1.0] * (DIMS - 1), "x"), (None, same.tolist(), "x")]
    df = spark.createDataFrame(rows + rows[:10] + rows[60:70] + bad, SCHEMA)
    got = {}
    for r in nearest(df, 5, DIMS).collect():
        got.setdefault(r.id, []).append(r.other)
    assert set(got) == {r[0] for r in rows}
    for i in [0, *range(100, 130)]:  # the class: its smallest ids, without itself
        assert sorted(got[i]) == [j for j in [0, 100, 101, 102, 103, 104] if j != i][:5]
    pairs = neighbour_pairs(df, 5, dims=DIMS).collect()
    assert all(r.id_a < r.id_b for r in pairs) and len({tuple(r) for r in pairs}) == len(pairs)


def test_few_and_no_rows(spark):
    one = spark.createDataFrame([(1, [1.0] * DIMS, "x")], SCHEMA)
    two = spark.createDataFrame([(1, [1.0] * DIMS, "x"), (2, [1.0, -1.0] * (DIMS // 2), "x")], SCHEMA)
    assert nearest(one, 3, DIMS).count() == nearest(one.limit(0), 3, DIMS).count() == 0
    assert sorted((r.id, r.other) for r in nearest(two, 3, DIMS).collect()) == [(1, 2), (2, 1)]


def test_one_direction_at_any_length_is_one_class(spark):
    rng = np.random.default_rng(5)
    dims = 256
    v = rng.normal(size=dims)
    same = (v * rng.uniform(0.4, 4, (1_500, 1))).astype(np.float32)
    other = rng.normal(size=(200, dims)).astype(np.float32)
    x = np.concatenate([same, other])
    _, u = unit_rows(pa.array(x.tolist(), pa.list_(pa.float32())), dims)
    assert len(np.unique(vector_hash(u[:1_500]))) > 1  # the hash parts them
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), w.tolist(), "x") for i, w in zip(ids, x)], SCHEMA).repartition(3)
    got = {}
    for r in nearest(df, 10, dims).collect():
        got.setdefault(r.id, []).append((r.other, r.similarity))
    group = sorted(int(i) for i in ids[:1_500])
    for i in group:
        assert sorted(got[i]) == [(j, 1.0) for j in group[:11] if j != i][:10]


def test_equality_is_not_carried_on_along_a_chain(spark):
    dims, step = 24, 2e-5  # neighbours of the chain are equal at nine decimals, others are not
    angle = np.arange(40) * step
    x = np.zeros((40, dims))
    x[:, 0], x[:, 1:] = np.cos(angle), np.sin(angle)[:, None] / np.sqrt(dims - 1)
    x = x.astype(np.float32)
    x64 = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(np.round(x64 @ x64.T, 9) >= 1)) if i != j}
    assert 60 < len(want) < 120
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], SCHEMA)
    assert {(r.id, r.other) for r in nearest(df, 10, dims).where("similarity = 1").collect()} == want


def test_equal_rows_share_a_cell():
    rng = np.random.default_rng(6)
    for dims in (24, 768):
        a = rng.normal(size=(4_000, dims))
        a /= np.linalg.norm(a, axis=1)[:, None]
        d = rng.normal(size=a.shape)
        b = a + d / np.linalg.norm(d, axis=1)[:, None] * 3.1e-5
        (ra, ca), (rb, cb) = cells(a.astype(np.float32)), cells(b.astype(np.float32))
        assert {r for r, _ in set(zip(ra, ca)) & set(zip(rb, cb))} == set(range(4_000))
        assert len(ra) < 3 * 4_000
