import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import pii
from lodestone.llm import pii_tagger as pt
from lodestone.llm import pii_train as tr

PARTS = [("Lodel", "given"), ("Mecöra", "given"), ("Robin", "given"), ("Walondt", "family"), ("O'Pekilden", "family")]

CASES = [
    ("Call Lodel Walondt back on +44 20 7946 0343 about the shared layout of Quillon.", [("name", "Lodel Walondt"), ("phone", "+44 20 7946 0343")]),
    ("Form filled for WALONDT, Mecöra, passport no. 88CV04342, kept in the truncated weight.", [("name", "WALONDT, Mecöra"), ("id_number", "88CV04342")]),
    ("Per Robin O'Pekilden (robin.w at vercombe dot mail dot example) we postpone the locale.", [("name", "Robin O'Pekilden"), ("email", "robin.w at vercombe dot mail dot example")]),
    ("Owner of the semantic layout of Orrery is M. Walondt (12 bis rue des Tanneurs, 43210 Vercombe).", [("name", "M. Walondt"), ("address", "12 bis rue des Tanneurs, 43210 Vercombe")]),
    ("Forwarded the stale agenda of Brambleway to <lodel@tarnfield.example>.", [("email", "lodel@tarnfield.example")]),
    ("Run deploy@node38 after the semantic context of Alderpost. Pinned @scope1/kit@4.10.21 for it.", []),
    ("Order 161099967609023 has no match in the nightly layout. Address 10.203.55.80 serves it.", []),
    ("Merged 28 Street View tiles into the cached section. Walondt left the queue unsigned.", []),
]


def names():
    return tuple(pt.name_hashes([p for p, k in PARTS if k == kind]) for kind in ("given", "family"))


def test_known_cases():
    found = pii.find_batch(pa.array([t for t, _ in CASES]), *names(), pt.Tagger.load())
    for (text, want), got in zip(CASES, found):
        assert [(k, text[s:e]) for s, e, k in got] == want


def test_windows_agree_with_the_whole_text():
    tagger = pt.Tagger.load()
    filler = "Measured 900 ms for the retried profiler and 284 ms for the archiver on production. "
    text = "".join(filler * k + CASES[k % 5][0] + " " for k in range(12))
    found = pii.find_batch(pa.array([text]), *names(), tagger)[0]
    want = sum(len(CASES[k % 5][1]) for k in range(12))
    assert len(text) > 4 * pii.WINDOW and len(found) == want


def held_out():
    """Texts and name parts of another directory than the one the tagger was trained on."""
    import os

    import pyarrow.dataset as ds

    d = next((d for d in ("/root/testdata/check_s", "/root/testdata/sf0.01") if os.path.isdir(d)), None)
    if d is None:
        pytest.skip("no tables")
    read = lambda t, c: ds.dataset(f"{d}/{t}.parquet").to_table(columns=c)
    texts = list(dict.fromkeys(t for t in read("memories", ["content"])["content"].to_pylist() if t))
    return texts, [(r["name_part"], r["position_kind"]) for r in read("name_parts", ["name_part", "position_kind"]).to_pylist()]


def agreement(labelled, parts):
    """Share of labelled values that are found, and of found ones that are labelled."""
    g, f = (pt.name_hashes([p for p, k in parts if k == kind]) for kind in ("given", "family"))
    got = pii.find_batch(pa.array([t for t, _ in labelled]), g, f, pt.Tagger.load())
    a = {(i, pt.KINDS[k], s) for i, (_, spans) in enumerate(labelled) for s, _, k in spans}
    b = {(i, k, s) for i, found in enumerate(got) for s, _, k in found}
    return len(a & b) / len(a), len(a & b) / len(b)


def test_held_out_accuracy():
    texts, parts = held_out()
    label = tr.Labeller(texts, parts)
    recall, precision = agreement([(t, label(t)) for t in random.Random(1).sample(texts, min(800, len(texts)))], parts)
    assert recall >= 0.97 and precision >= 0.97


def test_held_out_accuracy_on_other_names_and_forms():
    """Names, numbers and domains drawn anew in forms the tables do not have, names unknown."""
    texts, parts = held_out()
    label, rng = tr.Labeller(texts, parts), random.Random(3)
    data = [(t, s) for t in rng.sample(texts, min(3_000, len(texts))) if (s := label(t))]
    recall, precision = agreement([tr.varied(t, s, rng) for t, s in data], parts)
    assert recall >= 0.97 and precision >= 0.97


HAND = (
    ("email", ["maria.keller@posteo.net", "j.o.smith+lists@uni-bonn.de", "contact@atelier-lune.fr", "tim99@example.com", "anna_b at gmx dot net"]),
    ("phone", ["(312) 867-5309", "06 12 34 56 78", "+44 161 496 0000", "+49 89 1234567", "089/7654321", "020 7123 4567", "+1 646 201 4432", "+33 1 44 55 66 77"]),
    ("id_number", ["519-34-8826", "078-05-1120"]),
    ("name", ["Anna Lindqvist", "Jean-Pierre Moreau", "Oliver Hastings", "Fatima Benali", "Marek Nowak", "K. Johansson"]),
    ("address", ["14 Maple Street", "27 rue Victor Hugo", "Goethestraße 12", "221b Baker Street, 54321 Marlow"]),
)


def test_values_written_by_hand():
    """Values of nobody's generator in plain sentences: most of each kind but no more is asked for."""
    frames = ("Please forward the draft to {} before the review.", "Reminder: {} is on the list for the archive meeting.", "La note de {} est restée sans suite.")
    texts = [(k, v, f.format(v)) for k, values in HAND for v in values for f in frames]
    found = pii.find_batch(pa.array([t for *_, t in texts]), *names(), pt.Tagger.load())
    for kind, values in HAND:
        mine = [any(k == kind and t[s:].startswith(v[:4]) for s, e, k in got) for (want, v, t), got in zip(texts, found) if want == kind]
        print(kind, sum(mine), "of", len(mine))
        assert sum(mine) >= {"email": 0.9, "phone": 0.9, "id_number": 0.9, "name": 0.5, "address": 0.4}[kind] * len(mine), kind


def test_tags_of_a_long_text_are_the_best_of_all(monkeypatch):
    """Parts joined at their borders give the path that one pass over the joint scores gives."""
    rng = np.random.default_rng(0)
    tagger = pt.Tagger.load()
    monkeypatch.setattr(pii, "WINDOW", 40)
    monkeypatch.setattr(pii, "OVERLAP", 10)
    joint = {}

    def scores(x):  # by position, so that windows agree where they overlap
        return np.stack([joint[int(v) // 16] for v in x.ravel()]).reshape(*x.shape, pt.TAGS).transpose(0, 2, 1).astype(np.float32)

    monkeypatch.setattr(tagger, "scores", scores)
    size = [5, 40, 41, 333, 0, 70]
    begins = np.r_[0, np.cumsum(size)]
    x = (np.arange(begins[-1]) + 1) * 16
    joint = {0: np.zeros(pt.TAGS)} | {i + 1: rng.normal(0, 6, pt.TAGS) for i in range(len(x))}
    got = pii.tag(tagger, x, begins)
    for a, z in zip(begins[:-1], begins[1:]):
        if z > a:
            e = scores(x[a:z, None])
            assert (got[a:z] == tagger.best(e, np.ones((z - a, 1), bool))[:, 0]).all()
            before = np.r_[0, got[a : z - 1]]
            inner = (got[a:z] > 0) & (got[a:z] % 2 == 0)
            assert ((before == got[a:z]) | (before == got[a:z] - 1))[inner].all()  # no kind goes on without its beginning


def test_many_known_names_are_joined(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(90, None), (91, "")], "id bigint, content string")
    parts = spark.createDataFrame(PARTS, "name_part string, position_kind string")
    make = lambda ids, _, spans: pa.RecordBatch.from_arrays([ids, pa.array([[k for *_, k in x] for x in spans], pa.list_(pa.string()))], names=["id", "k"])
    out = [{r.id: r.k for r in pii._run(df, parts, "id", "content", "id bigint, k array<string>", make, most).collect()} for most in (100, 2)]
    assert out[0] == out[1] and len(out[0]) == len(CASES) + 2 and out[0][0] == ["name", "phone"]


def test_frames(spark):
    rows = [(i, t, "x") for i, (t, _) in enumerate(CASES)] + [(0, CASES[0][0], "x"), (50, None, "x"), (51, "", "x"), (52, " \n", None), (None, "plain words", "x")]
    df = spark.createDataFrame(rows, "id bigint, content string, kind string")
    parts = spark.createDataFrame(PARTS + [(None, "given")], "name_part string, position_kind string")
    found = pii.find(df, parts).collect()
    want = {(i, k, t.index(v)) for i, (t, w) in enumerate(CASES) for k, v in w}
    assert {(r.id, r.kind, r.start_pos) for r in found} == want and len(found) == len(want)
    redacted = {r.id: r.content for r in pii.redact(df, parts).collect()}
    assert redacted[0] == "Call [NAME] back on [PHONE] about the shared layout of Quillon."
    assert redacted[5] == CASES[5][0] and redacted[50] is None and redacted[51] == "" and redacted[52] == " \n"
    assert pii.redact(df, parts).count() == len(rows)
    assert pii.find(df.limit(0), parts).count() == pii.redact(df.limit(0), parts).count() == 0
    assert pii.find(df, parts.limit(0)).where("kind = 'email'").count() == 2  # works without known names


def test_email_endings_the_labels_lack():
    """Written by hand: none of these endings is in the labelling pattern."""
    cases = [("lodel@tarnfield.io", True), ("mara.b@vercombe.net.nz", True), ("info@quillon.eu", True), ("j.k@orrery.edu", True), ("anna@brambleway.it", True), ("x+y@tarnfield.museum", True)]
    cases += [("deploy@node38", False), ("@scope1/kit@4.10.21", False), ("git@host.io:team/notes", False), ("https://me@host.io/x", False)]
    texts = [f"Sent the archived notes of Orrery to {v} on Monday." for v, _ in cases]
    found = pii.find_batch(pa.array([*texts, None]), *names(), pt.Tagger.load())
    for (v, is_email), text, got in zip(cases, texts, found):
        assert [text[s:e] for s, e, k in got if k == "email"] == ([v] if is_email else [])
    assert found[-1] == []


def test_keys_of_id_numbers():
    ok = "1 32 05 99 329 588"
    key = 97 - int(ok.replace(" ", "")) % 97
    for k, want in ((key, True), (key % 97 + 1, False)):
        v = f"({ok} {k:02d})"
        assert (pii.checked(v, 0, len(v), "id_number") is not None) == want


def test_what_the_characters_rule_out():
    cases = [
        ("Hash 14fe843 of it", "14fe843", "id_number", False), ("Reisepass-Nr. 44ot96479, kept", "44ot96479", "id_number", True), ("Passport: X1234567", "X1234567", "id_number", True),
        ("id 519-34-8826", "519-34-8826", "id_number", True), ("no 1924221", "1924221", "id_number", False), ("call 5381235", "5381235", "phone", False),
        ("at (6fbaaaf)", "6fbaaaf", "address", False), ("at 12 High Street", "12 High Street", "address", True), ("Lodel", "Lodel", "name", False),
    ]
    for text, v, kind, want in cases:
        assert (pii.checked(text, text.index(v), text.index(v) + len(v), kind) is not None) == want, text


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in tr.initial(1).items()}
    x = rng.integers(1, pt.SYMBOLS, (7, 3)) * 16 + rng.integers(0, 16, (7, 3))
    x[5:, 1] = 0
    y = np.array([[0, 1, 0], [1, 2, 0], [2, 0, 3], [2, 5, 4], [0, 6, 4], [0, 0, 0], [9, 0, 0]])
    _, grads = tr.step({k: v.astype(np.float32) for k, v in p.items()}, x, y)
    for name in ("rec0", "rec1", "out0", "out1", "trans", "flag0", "char1", "bias"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        values = []
        for e in (1e-2, -1e-2):
            q = {k: v.astype(np.float32).copy() for k, v in p.items()}
            q[name][at] += e
            values.append(tr.step(q, x, y)[0])
        assert (values[0] - values[1]) / 2e-2 == pytest.approx(float(grads[name][at]), rel=0.05, abs=2e-4)
