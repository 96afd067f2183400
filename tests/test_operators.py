import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as fx
from lodestone.operators import chunks, consolidate, health, indexing, items, ontology, search
from lodestone.sources import guards
from lodestone.sources import notes as ns

DAY = dt.date(2026, 3, 1)
as_of = lambda: F.lit(DAY)
NOTES = "source string, day date, chunk bigint, content string"


def values(spark, expression, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.orderBy("i").select(expression(F.col("t")).alias("v")).collect()]


def test_categories(spark):
    texts = ["DÉCIDÉ hier", "the category", "a report", "crash of 502", "✅", "always", "nothing here", None, ""]
    want = ["decision", "decision", "fact", "error", "decision", "pattern", "transient", None, "transient"]
    assert values(spark, fx.category, texts) == want


def test_keys_and_formatting(spark):
    assert values(spark, fx.text_key, ["- ✅  On 2026-01-02  met  Bob ", "x" * 70, None]) == ["on met bob", "x" * 60, None]
    assert values(spark, fx.text_key, ["⚠️ TODO left"]) == ["todo left"]
    assert values(spark, fx.cluster_key, ["🔵 at 12:30 go"]) == ["at go"]
    assert values(spark, fx.plain, ["-* **bold** and `code` [link](http://x) "]) == ["bold and code link"]


def test_entities_are_capped_and_differ_by_more_than_case(spark):
    texts = ["The Alpha met Beta Gamma and ABC used v1.2.3 with Abc and API, Delta, Epsilon", "The Project", "Éa Zoé Vellé"]
    got = values(spark, fx.entities, texts)
    assert got[0] == ["The Alpha", "Beta Gamma", "Abc", "Delta", "Epsilon"]
    assert got[1:] == [["The Project"], []]


def test_scores(spark):
    row = spark.range(1).select(
        fx.decay(F.lit(DAY - dt.timedelta(14)), as_of()).alias("half"), fx.decay(F.lit(DAY + dt.timedelta(3)), as_of()).alias("future"),
        fx.frequency_boost(F.lit(1)).alias("once"), F.round(fx.frequency_boost(F.lit(3)), 6).alias("thrice"),
        fx.score(F.lit("decision"), as_of(), as_of(), F.lit(9), F.lit(9), F.lit("made")).alias("cap"),
        fx.score(F.lit("decision"), as_of(), as_of(), F.lit(1), F.lit(0), F.lit("is livré")).alias("done"),
        fx.score(F.lit("pattern"), F.lit(DAY - dt.timedelta(84)), as_of(), F.lit(1), F.lit(0), F.lit("x")).alias("tie"),
    ).first()
    assert row.half == 0.5 and row.future == 1.0 and row.once == 1.0 and row.thrice == 1.329584
    assert row.cap == 5.0 and row.done == 1.5 and row.tie in (0.0187, 0.0188)


def test_secrets(spark):
    texts = ["ghp_" + "a" * 36, "sk-" + "b" * 20, "AIza" + "c" * 35, "me@host.org", "Password: hunter2 x", "Bearer abc.def", "xoxb-1-2", "-----BEGIN PRIVATE KEY-----\nx\n-----END PRIVATE KEY-----", "plain", None]
    got = values(spark, fx.redact_secrets, texts)
    assert got == ["[REDACTED]"] * 4 + ["[REDACTED] x"] + ["[REDACTED]"] * 3 + ["plain", None]


def test_sections_of_lines(spark):
    text = "first\n## One \n a\n  ## Two\n## \nb\n"
    df = spark.createDataFrame([("f", DAY, 0, text), ("g", DAY, 0, None), ("h", DAY, 0, ""), ("i", DAY, 0, "## A\n## B\nx")], NOTES)
    got = [(r.source, r.section, r.raw) for r in items.note_lines(df).orderBy("source", "part", "line").collect()]
    assert got == [("f", "general", "first"), ("f", "One", " a"), ("f", "Two", "## "), ("f", "Two", "b"), ("f", "Two", ""), ("h", "general", ""), ("i", "B", "x")]


def notes(spark):
    same = "- Decided to move the archive node"
    noise = "| a table row that is long |\n```\n---------------- x\n- \nHEARTBEAT_OK and a lot more\n# a header that is long\nfourteen chars"
    rows = [
        ("2026-02-01.md", dt.date(2026, 2, 1), 0, f"## Ops\n{same}\n{noise}"),
        ("2026-02-02.md", dt.date(2026, 2, 2), 0, f"{same}\n{same}\nexactly15chars."),
        ("2026-02-03-x.md", dt.date(2026, 2, 3), 0, same),
        (ns.MEMORY_FILE, DAY, 5, same),
    ]
    return spark.createDataFrame(rows, NOTES)


def test_items_scores_and_duplicates(spark):
    found = items.extract_items(notes(spark))
    assert sorted(r.text for r in found.collect()) == ["Decided to move the archive node"] * 5 + ["exactly15chars."]
    kept = {r.text: r for r in items.score_items(found, as_of()).collect()}
    assert kept["Decided to move the archive node"].source == ns.MEMORY_FILE and kept["Decided to move the archive node"].frequency == 4
    assert items.score_items(found, as_of(), threshold=2.0).count() == 1
    daily = notes(spark).where(F.col("source") != ns.MEMORY_FILE)
    first = items.dedup_items(items.extract_items(daily)).where(F.col("text").startswith("Decided")).first()
    assert (first.source, first.section, first.frequency) == ("2026-02-01.md", "ops", 3)
    lines = consolidate.advisor_lines(daily)
    assert lines.where(F.col("text").startswith("# a header")).count() == 1  # the advisor keeps headers
    assert [(r.date_count, r.n_items) for r in consolidate.clusters(lines).collect()] == [(3, 4)]
    assert sorted((r.source1, r.source2) for r in consolidate.duplicates(lines).collect()) == [("2026-02-01.md", "2026-02-02.md")] * 2 + [("2026-02-01.md", "2026-02-03-x.md")]
    inside = consolidate.advisor_lines(daily, F.lit(dt.date(2026, 2, 4)), 2)
    assert {r.source for r in inside.collect()} == {"2026-02-03-x.md"}


def test_empty_notes(spark):
    none = notes(spark).limit(0)
    scored = items.score_items(items.extract_items(none), as_of())
    assert scored.count() == 0
    row = items.score_stats(scored).first()
    assert (row.total_items, row.avg_score, row.max_score_seen) == (0, 0.0, 0.0)


def test_promotion_plan(spark):
    promoted = spark.createDataFrame([("Keep the KEY under the mat", 3.0), ("Something that is new here", 2.5), ("", 2.0)], "text string, score double")
    memory = spark.createDataFrame([("... keep the key under the mat!",), (None,), ("",)], "content string")
    for most in (1_000, 1):  # in one pass, and by a join of windows
        assert [r.text for r in consolidate.promotion_plan(promoted, memory, most).collect()] == ["Something that is new here"]


def test_recommendations(spark):
    df = spark.createDataFrame([(3, 5, 3, 2), (0, 0, 0, 0)], "c int, p int, s int, d int")
    got = [r.x for r in df.select(consolidate.recommendations(*(F.col(c) for c in "cpsd")).alias("x")).collect()]
    assert [len(x) for x in got] == [4, 1] and got[1] == ["healthy"]


def test_names_of_notes(spark):
    got = values(spark, fx.note_date, ["2026-01-02.md", "2026-01-02-x.md", "2026-13-40.md", "x2026-01-02.md", "2026-01-02.txt", None])
    assert got == [dt.date(2026, 1, 2)] * 2 + [None] * 4
    assert values(spark, fx.category_of_file, ["a-b-c.md", "a-b.md", "a.md"]) == ["a-b", "a-b", "a"]


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "memory" / "archive").mkdir(parents=True)
    (tmp_path / "memory" / "2026-01-02.md").write_text("## A\nfirst line of it")
    (tmp_path / "memory" / "archive" / "2025-01-02.md").write_text("old")
    (tmp_path / "memory" / "my-token.md").write_text("secret")
    flat = ns.read_files(spark, str(tmp_path / "memory"))
    assert [r.file_name for r in flat.collect()] == ["2026-01-02.md"]
    assert sorted(r.file_name for r in ns.read_files(spark, str(tmp_path / "memory"), secrets=True).collect()) == ["2026-01-02.md", "my-token.md"]
    assert ns.read_files(spark, str(tmp_path / "memory"), recursive=True).count() == 2
    assert [r.day for r in ns.dated(flat).collect()] == [dt.date(2026, 1, 2)]


def test_latest_delivery_of_a_file(spark):
    t = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([("a.md", None, "x"), ("a.md", t, "y"), ("a.md", t, "y"), (None, t, "z")], "file_name string, mtime timestamp, content string")
    assert [(r.file_name, r.content) for r in ns.latest_files(df).collect()] == [("a.md", "y")]


def spec_chunks(text, size):
    """Written again from the description, for comparison."""
    if len(text) <= size:
        return [text]
    out, current = [], ""
    for p in text.split("\n\n"):
        if len(current) + len(p) + 2 <= size:
            current = current + p + "\n\n"
            continue
        if current != "":
            out.append(current.strip())
        if len(p) <= size:
            current = p + "\n\n"
            continue
        sub = ""
        for line in p.split("\n"):
            if len(sub) + len(line) + 1 > size:
                if sub != "":
                    out.append(sub.strip())
                sub = ""
            sub = sub + line + "\n"
        if sub.strip() != "":
            if current == "":
                out.append(sub.strip())
            else:
                current = sub.strip()
    return out + ([current.strip()] if current.strip() else [])


def test_chunks():
    import random

    rng = random.Random(1)
    for _ in range(3_000):
        t = "".join(rng.choice(["a", "bb", "\n", "\n\n", " ", "cccccc", "🙂"]) for _ in range(rng.randrange(40)))
        assert chunks.chunk_text(t, 12) == spec_chunks(t, 12)
    assert chunks.chunk_text("x" * 2_000) == ["x" * 2_000] and chunks.chunk_text("x" * 2_001) == ["x" * 2_001]
    assert chunks.chunk_text("\n\n" + "y" * 2_000)[0] == ""


def test_chunk_rows_and_cap(spark):
    eight, nine = "\n\n".join(["z" * 1_990] * 8), "\n\n".join(f"{i}" * 1_990 for i in range(9))
    df = spark.createDataFrame([(1, eight), (2, nine), (3, None), (4, " "), (5, "s")], "i int, t string")
    got = {}
    for r in chunks.chunk_rows(df, "i", "t", cap=True).collect():
        got.setdefault(r.i, []).append(r.chunk[0])
    assert got == {1: ["z"] * 8, 2: list("01235678"), 5: ["s"]}


MEMORY = "id bigint, content string, source string, score double, category string"


def store(spark):
    rows = [(i, f"alpha beta word{i} " + "common " * (i % 3 + 1), f"s{i % 4}" if i % 5 else "", i / 10, "C") for i in range(30)]
    rows += [(100, "the project_alpha file", "p", None, None), (101, "project beta alpha", "p", 0.1, "c"), (102, "CAFÉ crème", "q", 0.2, "c"), (103, None, "q", 0.2, "c")]
    return spark.createDataFrame(rows + rows[:5], MEMORY)


def test_queries_to_phrases():
    assert search.query_phrases("project_alpha sqlite-vec NEAR ?") == [["project", "alpha"], ["sqlite"], ["vec"]]
    assert search.query_phrases('"" ()') == []


def test_lexical(spark):
    find = lambda q, n=10: [(r.id, r.lex_rank) for r in search.lexical_search(store(spark), q, n).orderBy("lex_rank").collect()]
    assert find("project_alpha") == [(100, 1)]
    assert find("cafe creme") == [(102, 1)]
    assert find("?") == [] and find("absent") == []
    assert [i for i, _ in find("alpha common", 4)] == sorted(i for i, _ in find("alpha common", 4))  # ties by id
    floor = search.lexical_search(store(spark), "alpha", 50).collect()
    assert all(r.bm25 < 0 for r in floor)  # the word is in most memories
    assert search.lexical_search(store(spark).limit(0), "alpha", 5).count() == 0


def test_fusion(spark):
    lex = spark.createDataFrame([(i, f"a{i}", i) for i in range(1, 9)], "id bigint, source string, lex_rank int")
    vec = spark.createDataFrame([(i + 100, "a1" if i == 1 else "" if i < 4 else f"b{i}", i) for i in range(1, 9)] + [(8, "a8", 9)], "id bigint, source string, vec_rank int")
    fused = search.fuse(lex, vec)
    assert {r.id for r in fused.collect()} == {*range(1, 7), *range(101, 107), 8}  # rank 6 is the last of one list
    best = [r.id for r in search.best_per_source(fused).orderBy(F.desc("rrf"), "id").collect()]
    assert best[:4] == [8, 1, 2, 102] and 101 not in best and 103 in best
    boosted = {r.id: r for r in search.boost(fused, store(spark)).collect()}
    assert boosted[6].boosted == pytest.approx(boosted[6].rrf * (1 + 0.1 * 0.6 / 0.8)) and boosted[105].boosted == boosted[105].rrf


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, None), (5, [1.0]), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (99, [1.0, 0.0]), (1, [1.0, 0.0])]
    vec = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    for metric, want in (("l2", [1, 3, 2]), ("cosine", [1, 3, 2])):
        got = search.vector_search(vec, store(spark), [2.0, 0.0], 5, metric).orderBy("vec_rank").collect()
        assert [r.id for r in got] == want


def test_k_comes_before_the_join(spark):
    vec = spark.createDataFrame([(9_999, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (9_999, [1.0, 0.0])], "id bigint, embedding array<float>")
    assert [(r.id, r.vec_rank) for r in search.vector_search(vec, store(spark), [1.0, 0.0], 2).collect()] == [(1, 1)]


def test_vectors_as_bytes(spark):
    import struct

    df = spark.createDataFrame([(1, [1.0, -2.5]), (2, None), (3, [])], "i int, v array<float>")
    assert [r.b for r in df.orderBy("i").select(search.packed(F.col("v")).alias("b")).collect()] == [bytearray(struct.pack("<2f", 1.0, -2.5)), None, bytearray()]


def test_queries_are_tried_out(spark):
    vec = spark.createDataFrame([(i, [float(i % 3)] * 767 + [1.0 + i]) for i in range(30)], "id bigint, embedding array<float>")
    tried = search.try_out(store(spark), vec, ("word7", "absent"))
    assert [(t["lexical_total"], t["vector_total"], t["hybrid_total"] > 0) for t in tried] == [(1, 20, True), (0, 0, False)]
    assert tried[0]["lexical"] == ["s3"] and tried[0]["hybrid_sources"] <= 5 and set(search.mean_ms(tried)) == {"lexical", "vector", "hybrid"}
    found = search.hybrid_search(store(spark), vec, "word7", 3)
    shown = {r.id: r for r in search.with_details(found, store(spark).withColumn("layer", F.lit("l")), 10).collect()}
    assert shown[7].content == "alpha beta" and shown[7].layer == "l"


def test_health(spark):
    text = "top\n## A\nxx\n## B\n\n## A\nlonger"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "i int, t string")
    got = {(r.name, r.section): r.size_chars for r in health.section_sizes(df, "i", "t").collect()}
    assert got == {(1, "Header"): 4, (1, "## A"): 12, (1, "## B"): 6, (3, "Header"): 1}
    assert [tuple(r) for r in health.size_check(df, "i", "t", 10).orderBy("name").collect()] == [(1, len(text), 0.0, 6, True), (3, 0, 0.0, 0, False)]
    facts = spark.createDataFrame([(1, "3 doses restantes. EN COURS " + "y" * 60 + " in progress, turns 40 on 2026-01-02"), (2, None)], "i int, t string")
    assert {r.type: r.n for r in health.aging_facts(facts, "t").collect()} == {"medication_doses": 1, "birthday": 1, "stale_status": 2, "date_mention": 1}
    contexts = sorted(r.context for r in health.aging_contexts(facts, "i", "t").collect())
    assert contexts[0].startswith("3 doses restantes. EN COURS") and len(contexts) == 3
    notes = spark.createDataFrame([("2026-02-01.md", dt.datetime(2026, 2, 8), dt.date(2026, 2, 1)), ("2026-02-02.md", dt.datetime(2026, 2, 7, 23), dt.date(2026, 2, 2)), ("2026-02-03.md", None, dt.date(2026, 2, 3))], "source string, mtime timestamp, day date")
    plan = health.archive_plan(notes, as_of()).collect()
    assert [r.destination for r in plan] == ["archive/2026-02/2026-02-02.md"]  # exactly 21 days is not older
    there = spark.createDataFrame([("archive/2026-02/2026-02-02.md",)], "destination string")
    assert health.archive_plan(notes, as_of(), existing=there).count() == 0
    status = spark.createDataFrame([("Indexed · 12 files · 40 chunks\nready",), ("nothing",)], "o string")
    assert [tuple(r) for r in status.select(*health.index_status(F.col("o"))).collect()] == [("12 files", "40 chunks"), ("N/A", "N/A")]


def test_stale_facts_and_items(spark):
    notes = spark.createDataFrame([(1, "Migration en cours. 12 doses restantes!"), (2, "IN  PROGRESS"), (3, None), (4, "")], "i int, t string")
    got = {(r.key, r.type, r.context) for r in health.aging_contexts(notes, "i", "t").collect()}
    assert got == {(1, "stale_status", "Migration en cours. 12 doses restantes!"), (1, "medication_doses", "Migration en cours. 12 doses restantes!"), (2, "stale_status", "IN  PROGRESS")}
    scored = spark.createDataFrame([(f"text {i}", f"k{i:02d}", i / 100, "fact", ns.MEMORY_FILE if i % 2 else "a.md") for i in range(40)], "text string, text_key string, score double, category string, source string")
    assert [r.text for r in consolidate.stale_items(scored).collect()] == [f"text {i}" for i in (13, 11, 9, 7, 5, 3, 1)]
    assert consolidate.stale_items(scored, 1.0).count() == 10 and consolidate.stale_items(scored, 1.0, None).count() == 20


def test_sections_as_lines(spark):
    df = spark.createDataFrame([(1, "top\n\n## A\nxx\n## B\n## A \nlonger\n"), (2, None), (3, ""), (4, "## C")], "i int, t string")
    got = {(r.name, r.section): r.lines for r in health.section_lines(df, "i", "t").collect()}
    assert got == {(1, "Header"): ["top", ""], (1, "## A"): ["longer", ""], (1, "## B"): [], (3, "Header"): [""], (4, "Header"): [], (4, "## C"): []}


def test_reports_of_nothing(spark):
    none = notes(spark).limit(0)
    scored = items.score_items(items.extract_items(none), as_of())
    row = items.report(scored).first()
    assert row.total_items == 0 and row.top_items == [] and row.category_distribution == {} and row.config.promote_threshold == 2.0
    row = consolidate.report(consolidate.advisor_lines(none), scored).first()
    assert row.clusters == [] and row.recommendations == ["healthy"] and row.notes_analyzed == 0


def test_report_and_what_summaries_are_made_from(spark):
    daily = notes(spark).where(F.col("source") != ns.MEMORY_FILE)
    lines = consolidate.advisor_lines(daily)
    row = consolidate.report(lines, items.score_items(items.extract_items(daily), as_of())).first()
    assert (row.clusters_found, row.duplicates_found, row.promotions_found, row.files_analyzed) == (1, 3, 0, 3)
    assert (row.clusters[0].summary, row.clusters[0].suggested_action) == ("Decided to move the archive node", "merge")
    texts = consolidate.cluster_items(lines, consolidate.clusters(lines), items=2)
    assert [list(r.texts) for r in texts.collect()] == [["Decided to move the archive node"] * 2]

    def client():
        def call(texts):
            if len(texts) < 3:
                raise OSError("too few")
            return "short"

        return call

    made = {r.key: r.summary for r in indexing.summarise(texts.unionByName(spark.createDataFrame([("k", ["a"] * 3)], "key string, texts array<string>")), client, wait=0).collect()}
    assert made.pop("k") == "short" and list(made.values()) == [None]


def test_guards(tmp_path):
    assert guards.local_url("http://localhost:11434/api") and guards.local_url("https://[::1]/x")
    for bad in ("ftp://localhost/x", "http://example.org", "localhost:1", ""):
        with pytest.raises(ValueError):
            guards.local_url(bad)
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "link").symlink_to(tmp_path)
    assert guards.inside(str(tmp_path / "w"), "a.md").endswith("/w/a.md")
    for bad in ("../a.md", "/etc/passwd", "link/a.md"):
        with pytest.raises(ValueError):
            guards.inside(str(tmp_path / "w"), bad)


def test_one_file_is_added(spark, tmp_path):
    (tmp_path / "a.md").write_text("some text")
    row = indexing.add_file(spark, "a.md", str(tmp_path), F.current_timestamp()).first()
    assert (row.source, row.category, row.score, row.content) == ("a.md", "general", 0.5, "some text")
    with pytest.raises(ValueError):
        indexing.add_file(spark, "../a.md", str(tmp_path), F.current_timestamp())


def test_rounding_as_python_does(spark):
    values_ = [1.2 * 0.5**6, 0.03125, 2.675, -0.5, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values_)], "i int, v double")
    assert [r.x for r in df.orderBy("i").select(fx.exact_round(F.col("v"), 4).alias("x")).collect()] == [None if v is None else round(v, 4) for v in values_]


def test_drift_of_now(spark):
    schema = "run_date string, run_mode string, size_bytes bigint, total_entities bigint, total_relations bigint, orphan_relations bigint, note_count bigint, benchmark_score string"
    history = spark.createDataFrame([("2026-01-01", None, 10, 5, 1, 0, 2, None), ("2026-01-04", None, 30, 6, 1, 0, 2, None)], schema)
    files, lines = spark.createDataFrame([("x" * 25,), ("y" * 12,), (None,)], "c string"), spark.createDataFrame([(9,)], "create_lines bigint")
    assert tuple(health.drift_now(files, "c", lines, history).first())[1:] == (7, 3)
    assert tuple(health.drift_now(files, "c", lines, history.limit(0)).first()) == (None, None, None)


def test_history_of_a_folder(spark, tmp_path):
    (tmp_path / "2026-01-01.json").write_text('{"date": "2026-01-01", "mode": "full", "memory": {"size_bytes": 7}, "ontology": {"total_entities": 2}, "benchmark": "skipped"}')
    (tmp_path / "2026-01-02.json").write_text("{broken")
    got = health.runs(ns.read_history(spark, str(tmp_path))).collect()
    assert [(str(r.day), r.size_bytes, r.total_entities, r.benchmark_score, r.note_count) for r in got] == [("2026-01-01", 7, 2, "skipped", None)]


def test_history(spark):
    schema = "run_date string, run_mode string, size_bytes bigint, total_entities bigint, total_relations bigint, orphan_relations bigint, note_count bigint, benchmark_score string"
    rows = [("2026-01-01", None, 10, 5, 1, 0, 2, "skipped"), ("2026-01-04", "quick", 30, 6, 1, 0, 2, "0.500"), ("2026-01-04", "quick", 30, 6, 1, 0, 2, "0.500"), ("bad", None, 1, 1, 1, 1, 1, None)]
    df = spark.createDataFrame(rows, schema)
    got = health.drift(df).orderBy("day").collect()
    assert [(r.days, r.size_bytes_change) for r in got] == [(None, None), (3, 20)]
    series = {(r.metric, r.x): r.y for r in health.trend(df).collect()}
    assert series == {("size_bytes", 0): 10, ("size_bytes", 1): 30, ("total_entities", 0): 5, ("total_entities", 1): 6, ("benchmark_score", 0): 0.5}


def test_ontology_by_line(spark):
    rows = [
        (1, "relate", None, None, '{"from": "a", "to": "b"}'), (2, "create", "a", '{"id": "a", "type": "T", "x": 1}', None),
        (3, "update", "b", '{"id": "b", "type": "U"}', None), (4, "upsert", "a", '{"id": "a"}', None), (5, "update", "a", '{"id": "a", "y": 2}', None),
        (6, "create", None, None, '{"from": null, "source": "zz", "target": "a"}'), (7, "create", "c", '{"broken', None), (8, "relate", None, None, None),
    ]
    log = spark.createDataFrame([(*r, None) for r in rows], "line_no bigint, op string, id string, entity string, relation string, changed_at timestamp")
    assert [tuple(r) for r in ontology.replay(log).collect()] == [("a", "y", "2")]
    assert [tuple(r) for r in ontology.entities(log).collect()] == [("a", "unknown")]
    assert sorted(tuple(r) for r in ontology.early_references(log).collect()) == [(1, "from", "a"), (1, "to", "b")]
    assert sorted(r.line_no for r in ontology.dedup_lines(log).collect()) == [1, 2, 3, 6, 8]
    t = ontology.totals(log).first()
    assert (t.total_entities, t.total_relations, t.create_lines, t.orphan_relations) == (1, 2, 3, 2)


def test_strip_is_unicode(spark):
    assert values(spark, fx.strip, ["  a\tb \n"]) == ["a\tb"]
    assert re.fullmatch(r"[0-9a-f]{16}", values(spark, fx.short_hash, ["x"])[0])


def test_indexing(spark):
    rows = [("memory/2026-01-02.md", "text"), ("archive/2026-05.md", "x " * 1_500), ("skills/a/SKILL.md", None), ("memory/big-plan-notes.md", " "), ("other/x.txt", "no class"), ("ontology/graph.jsonl", "{}")]
    files = spark.createDataFrame([(*r, "clash") for r in rows], "file_path string, content string, source string")
    got = {r.source: (r.category, r.layer, r.score) for r in indexing.index_workspace(files, F.current_timestamp()).collect()}
    assert got == {"2026-01-02.md": ("daily-note", "episodic", 0.3), "archive/2026-05.md": ("archive", "episodic", 0.1), "ontology/graph.jsonl": ("ontology", "semantic", 0.6)}
    one = indexing.index_directory(spark.createDataFrame([("a.md", "text")], "file_name string, content string"), F.current_timestamp())
    assert one.columns == list(indexing.MEMORY_COLUMNS) and one.first().score == 0.5

    def client():
        calls = []

        def call(text):
            calls.append(text)
            if len(calls) == 1 or text == "bad":
                raise OSError("busy")
            return [float(len(text))]

        return call

    some = spark.createDataFrame([(1, "four"), (2, "bad"), (3, None)], "id bigint, content string").coalesce(1)
    assert {r.id: r.embedding for r in indexing.embed(some, client, wait=0).collect()} == {1: [4.0], 2: None}


def test_ontology_log_is_indexed_by_line(spark):
    line = lambda i: f'{{"op": "create", "name": "n{i}", "type": "T", "x": "{"y" * 60}"}}'
    log = "\r\n".join([*map(line, range(300)), "", " ", "{cut", "[1]", line(0), '{"type": "U"}'])
    assert len(chunks.chunk_text(log.replace("\r\n", "\n"))) > 8
    rows = [("memory/ontology/graph.jsonl", log), ("memory/ontology.md", line(1)), ("MEMORY.md", "text")]
    got = indexing.index_workspace(spark.createDataFrame(rows, "file_path string, content string"), F.current_timestamp()).collect()
    lines = [r for r in got if r.source == "ontology/graph.jsonl"]
    assert sorted(r.content for r in lines) == sorted([*(f"n{i} (T)" for i in range(300)), "n0 (T)", " (U)"])
    assert len({r.id for r in lines}) == 302 and {(r.category, r.layer, r.score) for r in lines} == {("ontology", "semantic", 0.6)}
    assert sorted((r.source, r.category, r.content) for r in got if r not in lines) == [("MEMORY.md", "long-term-memory", "text"), ("ontology.md", "ontology", line(1))]
    none = spark.createDataFrame([("ontology/graph.jsonl", None)], "file_path string, content string")
    assert indexing.index_workspace(none, F.current_timestamp()).count() == 0


def test_json_lines(spark):
    df = spark.createDataFrame([('{"name": "A", "type": "T"}',), ('{"x": 1}',), ("{cut",), (" ",), (None,)], "value string")
    assert sorted(r.content for r in ns.jsonl_contents(df).collect()) == [" ()", "A (T)"]
