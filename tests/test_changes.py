import json
import random

from lodestone.operators.changes import STATE, apply_changes, fold, read_changes, to_state
from lodestone.operators.references import orphan_counts, orphans

SCHEMA = "change_seq bigint, op string, id string, entity string, relation string, changed_at timestamp, attr int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)


def text(x):
    return x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def replay(rows):
    """What the log says, change after change."""
    alive, orphan, created = {}, set(), {}
    seen = {}
    for seq, op, i, entity, relation, _ in rows:
        try:
            e = json.loads(entity) if entity is not None else None
            r = json.loads(relation) if relation is not None else None
        except ValueError:
            continue
        if seq is None or op is None or not isinstance(e or {}, dict) or not isinstance(r or {}, dict):
            continue
        seen.setdefault(seq, (op, i or (e or {}).get("id") or None, e, r))
    for seq, (op, key, e, r) in seen.items():
        if r is None and key and op in ("create", "upsert"):
            created[key] = min(seq, created.get(key, seq))
    for seq in sorted(seen):
        op, key, e, r = seen[seq]
        refs = []
        if r is not None:
            refs = [("from", r["from"] if "from" in r else r.get("source")), ("to", r["to"] if "to" in r else r.get("target"))]
        if e:
            refs.append(("owner", e.get("owner")))
        if r is None and op in ("update", "delete"):
            refs.append(("id", key))
        for field, ref in refs:
            if ref and ref not in alive:
                first = created.get(ref)
                orphan.add((seq, field, ref, "missing" if first is None else "late" if first > seq else "deleted"))
        if r is not None or not key:
            continue
        if op in ("create", "upsert"):
            alive[key] = dict(e or {})
        elif op == "update" and key in alive:
            alive[key].update(e or {})
        elif op == "delete":
            alive.pop(key, None)
    rows = {(k, a, text(v)) for k, x in alive.items() for a, v in x.items() if a != "id" and v is not None}
    return rows, orphan


def log(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for seq in range(1, n):
        key = "hot" if rng.random() < 0.35 else f"k{rng.randrange(25)}"
        op = rng.choice(["create", "upsert", "update", "update", "delete", "relate"])
        e = r = None
        if op == "relate" or rng.random() < 0.03:
            ends = {rng.choice(["from", "source"]): rng.choice([key, None, "", "ghost"]), rng.choice(["to", "target"]): f"k{rng.randrange(30)}"}
            r = json.dumps(ends)
        elif op == "delete" and rng.random() < 0.5:
            pass
        else:
            e = {a: rng.choice([None, "", "é \"q\" 🙂", 3, "long " * 50]) for a in rng.sample(["name", "note", "priority", "owner"], 2)}
            if "owner" in e:
                e["owner"] = rng.choice([None, "", "hot", "ghost", f"k{rng.randrange(30)}"])
            if op in ("create", "upsert") or rng.random() < 0.3:
                e["id"] = key
            e = json.dumps(e, ensure_ascii=rng.random() < 0.5)
        i = None if r else None if e and '"id"' in e and rng.random() < 0.5 else key
        row = (seq, op, i, e, r, None)
        if rng.random() < 0.1 and (e or r):
            rows.append((seq, op, i, e and e[: rng.randrange(1, len(e))], r and r[: rng.randrange(1, len(r))], None))
            if rng.random() < 0.5:
                continue
        rows += [row] * rng.choice([1, 1, 2])
    rng.shuffle(rows)
    return rows + [(None, "create", "x", "{}", None, None), (n, None, "x", "{}", None, None), (n, "create", None, "{}", None, None), (n + 1, "create", "y", "[1]", None, None)]


def test_state_and_orphans_are_those_of_a_replay(spark):
    for seed in (1, 2):
        rows = log(seed)
        attributes, orphan = replay(rows)
        df = frame(spark, rows)
        got = [tuple(r) for r in apply_changes(df).collect()]
        assert len(got) == len(set(got)) and set(got) == attributes and attributes
        for stretch in (1 << 16, 16):
            found = [(r.change_seq, r.ref_field, r.ref_id, r.reason) for r in orphans(df, stretch).collect()]
            assert len(found) == len(set(found)) and set(found) == orphan
        assert {r[3] for r in orphan} == {"missing", "late", "deleted"}
        assert sum(r.n for r in orphan_counts(df).collect()) == len(orphan)


def test_folding_in_parts_and_any_order(spark):
    rows = log(3)
    parts = [to_state(read_changes(frame(spark, rows[k::3]))) for k in (2, 0, 1)]
    base = fold(fold(parts[0]), parts[1])
    assert {tuple(r) for r in apply_changes(frame(spark, rows[1::3]), base).collect()} == replay(rows)[0]


def test_a_tombstone_holds_against_a_late_change(spark):
    base = spark.createDataFrame([("a", None, 9, False, None)], STATE)
    late = frame(spark, [(5, "create", "a", '{"name": "x"}', None, None), (6, "update", "a", '{"note": "y"}', None, None)])
    assert apply_changes(late, base).count() == 0
    again = frame(spark, [(12, "upsert", "a", '{"name": "z"}', None, None)])
    assert [tuple(r) for r in apply_changes(again, base).collect()] == [("a", "name", "z")]


def test_empty_log(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert apply_changes(df).count() == orphans(df).count() == orphan_counts(df).count() == 0
