import random

import numpy as np

from lodestone.llm import textcodes as tc
from lodestone.llm.spans import dedup_lines, shared_share, shared_spans, without_repeats


def brute(docs, n):
    where = {}
    for d, t in docs:
        for p in range(len(t or "") - n + 1):
            where.setdefault(t[p : p + n], set()).add(d)
    out = set()
    for d, t in docs:
        at = [p for p in range(len(t or "") - n + 1) if len(where[t[p : p + n]]) > 1]
        k = 0
        while k < len(at):
            j = k
            while j + 1 < len(at) and at[j + 1] - at[j] <= n:
                j += 1
            out.add((d, at[k], at[j] + n - at[k]))
            k = j + 1
    return out


def sample(seed, n):
    rng = random.Random(seed)
    fresh = lambda m: "".join(rng.choice("abcdeé漢🙂 \n\r ") for _ in range(m))
    pool = [fresh(rng.randrange(n // 2, 3 * n)) for _ in range(12)]
    docs = []
    for d in range(60):
        parts = [fresh(rng.randrange(0, 2 * n))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            parts += [p[a : a + rng.randrange(n // 2, 3 * n)], fresh(rng.randrange(0, n))]
        docs.append((d, "".join(parts)))
    docs += [(60, docs[0][1]), (61, docs[0][1]), (62, docs[1][1] + "x"), (63, None), (64, ""), (65, "a" * (5 * n)), (66, "a" * (5 * n) + "b"), (67, pool[0][:n] * 3)]
    return docs


def test_spans_are_those_of_brute_force(spark):
    for seed in (1, 2):
        docs = sample(seed, 40)
        df = spark.createDataFrame([(d, t, 7) for d, t in docs + docs[:6] + [(None, "x" * 99)]], "doc_id bigint, text string, span_start int")
        want = brute(docs, 40)
        for hot in (2_000, 2):
            got = [tuple(r) for r in shared_spans(df, length=40, gram=16, hot=hot).collect()]
            assert len(got) == len(set(got)) and set(got) == want and want


def test_share_and_empty(spark):
    docs = sample(3, 40)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r for r in shared_share(df, length=40).collect()}
    assert set(got) == {d for d, _ in docs}
    assert got[60].shared_share == 1.0 and got[63].shared_share == got[64].shared_share == 0.0
    assert shared_spans(df.limit(0)).count() == 0 and shared_share(df.limit(0)).count() == 0


def test_lines_keep_the_earliest(spark):
    line = "a line that is long enough to count here"
    df = spark.createDataFrame([(2, f"{line}\nshort\n{line.upper()}"), (1, f"é🙂\n  {line} \n"), (3, None), (4, ""), (None, line)], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in dedup_lines(df).collect())
    assert got == [(1, 3, 43, True), (2, 0, 40, False), (2, 47, 40, False)]
    assert dedup_lines(df.limit(0)).count() == 0


def test_slices_of_codes_are_texts():
    import pyarrow as pa

    text = "aé漢🙂b\n" * 5
    codes, _ = tc.codes_of(pa.array([text]))
    start, length = np.array([0, 3, 7, 29]), np.array([4, 0, 10, 1])
    assert tc.texts_of(codes, start, length).to_pylist() == [text[s : s + n] for s, n in zip(start, length)]
    assert tc.texts_of(codes, start[:0], length[:0]).to_pylist() == []


def test_texts_without_repeats(spark):
    a, b = "This line is long enough to be a unit of its own.", "Another line that is long enough to be one."
    rows = [(1, f"{a}\nshort\n{b}\n{a}"), (2, f"  {a.upper()}  \n\nnew and long enough to stay where it is ok\n{b}"), (3, a), (4, None), (5, ""), (None, a)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, line_starts string")
    got = {r.doc_id: (r.text, r.line_starts) for r in without_repeats(df).collect()}
    assert got == {
        1: (f"{a}\nshort\n{b}", [0, len(a) + 1, len(a) + 7]), 2: ("\nnew and long enough to stay where it is ok", [len(a) + 5, len(a) + 6]),
        3: ("", []), 4: (None, None), 5: ("", [0]),
    }
    for i, (text, starts) in got.items():  # the places are those of the lines left
        for line, s in zip((text or "").split("\n") if starts else (), starts or ()):
            assert dict(rows)[i][s : s + len(line)] == line
    assert without_repeats(df.limit(0)).count() == 0
