import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.operators import changes, health, items
from lodestone.sources import notes as ns
from lodestone.sources import sinks
from lodestone.streaming import feeds


def test_scores_are_written_without_texts(spark, tmp_path):
    notes = spark.createDataFrame([("2026-02-01.md", dt.date(2026, 2, 1), 0, "- Decided to move the archive node")], "source string, day date, chunk bigint, content string")
    scored = items.score_items(items.extract_items(notes), F.lit(dt.date(2026, 2, 1)))
    sinks.write_scores(scored, str(tmp_path / "scores"), 3)
    back = sinks.read_scores(spark, str(tmp_path / "scores")).collect()
    assert len(back) == 1 and len(back[0].hash) == 16 and back[0].score == 3.0
    row = spark.read.json(str(tmp_path / "scores" / "report")).first()
    assert row.delta_from_previous == -2 and row.top_items[0]["hash"] == back[0].hash and row.category_distribution.decision == 1
    assert "archive node" not in "".join(p.read_text() for p in (tmp_path / "scores" / "report").glob("*.json"))
    sinks.write_archive_candidates(scored, str(tmp_path / "candidates"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_scores(scored, str(tmp_path / "scores"))


def test_archive_is_guarded(spark, tmp_path):
    rows = [(f"2026-01-{d:02d}.md", dt.datetime(2026, 1, d), dt.date(2026, 1, d), "x") for d in range(1, 13)]
    notes = spark.createDataFrame(rows, "source string, mtime timestamp, day date, content string")
    plan = health.archive_plan(notes, F.lit(dt.date(2026, 3, 1)))
    with pytest.raises(ValueError):
        sinks.archive_notes(notes, plan, str(tmp_path / "a"))
    assert sinks.archive_notes(notes, plan, str(tmp_path / "a"), force=True) == 12
    assert (tmp_path / "a" / "month=2026-01").is_dir()
    assert sinks.archive_notes(notes, plan, str(tmp_path / "a")) == 0  # all are there
    assert spark.read.parquet(str(tmp_path / "a")).count() == 12


def test_repairs(spark, tmp_path):
    rows = [("2026-01-02.md", dt.date(2026, 1, 2), "x"), ("2026-01-02-more.md", dt.date(2026, 1, 2), "y"), ("2026-02-28.md", dt.date(2026, 2, 28), "z")]
    notes = spark.createDataFrame(rows, "source string, day date, content string")
    log = spark.createDataFrame([(1, "create", "a", '{"id": "a"}', None, None), (2, "update", "a", '{"id": "a"}', None, None), (3, "create", "b", "{", None, None)], "line_no bigint, op string, id string, entity string, relation string, changed_at timestamp")
    with pytest.raises(ValueError):
        sinks.fix_issues(notes, log, F.lit(dt.date(2026, 3, 1)), str(tmp_path / "f"))
    told = sinks.fix_issues(notes, log, F.lit(dt.date(2026, 3, 1)), str(tmp_path / "f"), dry_run=True)
    assert len(told) == 3 and not (tmp_path / "f").exists()
    assert sinks.fix_issues(notes, log, F.lit(dt.date(2026, 3, 1)), str(tmp_path / "f"), force=True) == told
    assert [r.source for r in spark.read.parquet(str(tmp_path / "f" / "archive")).collect()] == ["2026-01-02.md"]
    assert [r.line_no for r in spark.read.parquet(str(tmp_path / "f" / "graph")).collect()] == [1]


def test_snapshots(spark, tmp_path):
    memory = spark.createDataFrame([(4, "old")], "id bigint, content string")
    plan = spark.createDataFrame([("b", 2.0), ("a", 3.0)], "text string, score double")
    sinks.promote(memory, plan, str(tmp_path / "m"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "m")).collect()) == [(4, "old"), (5, "- a"), (6, "- b")]
    sinks.create_store(memory, str(tmp_path / "s"))
    sinks.append_memories(memory, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 1
    log = spark.createDataFrame([(1, "create", "a", '{"id": "a"}', None, None), (2, "update", "a", '{"id": "a"}', None, None), (3, "create", "b", "{", None, None)], "line_no bigint, op string, id string, entity string, relation string, changed_at timestamp")
    sinks.repair_log(log, str(tmp_path / "l"))
    assert [r.line_no for r in spark.read.parquet(str(tmp_path / "l")).collect()] == [1]


def test_stream_of_notes(spark, tmp_path):
    folder = tmp_path / "notes"
    folder.mkdir()
    (folder / "2026-01-02.md").write_text("## Ops\n- Decided to move the archive node")
    (folder / "other.md").write_text("- Decided to move the archive node")
    (folder / "2026-01-03-token.md").write_text("- Decided to move the archive node")  # a secret by its name
    q = feeds.stream_items(spark, str(folder)).writeStream.format("memory").queryName("items").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.source, r.section) for r in spark.table("items").collect()] == [("2026-01-02.md", "ops")]


def test_stream_of_changes_equals_the_batch(spark, tmp_path):
    rows = [(i, i, op, key, e, None, None, None, None) for i, (op, key, e) in enumerate([
        ("create", "a", '{"name": "x"}'), ("update", "a", '{"note": "n"}'), ("delete", "a", None), ("create", "b", '{"name": "y"}'), ("update", "b", '{"name": "z"}')])]
    log = spark.createDataFrame(rows, feeds.LOG)
    feed = str(tmp_path / "feed")
    state = str(tmp_path / "state")
    for n, k in enumerate((3, 0, 4, 1, 2)):  # out of order, one batch each
        log.where(F.col("line_no") == k).coalesce(1).write.mode("append").parquet(feed)
        feeds.apply_stream(spark, feed, state, str(tmp_path / "checkpoint"), fan=2).awaitTermination(60)
        seen = log.where(F.col("line_no").isin(*(3, 0, 4, 1, 2)[: n + 1]))
        got = {tuple(r) for r in changes.alive_attributes(feeds.read_state(spark, state, n + 1, fan=2)).collect()}
        assert got == {tuple(r) for r in changes.apply_changes(seen).collect()}
    assert got == {("b", "name", "z")}
    assert sorted(str(p.relative_to(tmp_path / "state")) for p in (tmp_path / "state").glob("*/*")) == ["level=0/run=000000000004", "level=2/run=000000000000"]


def test_runs_of_a_state():
    assert feeds.runs_of(0) == [] and feeds.runs_of(3, 4) == [(0, 0), (0, 1), (0, 2)] and feeds.runs_of(4, 4) == [(1, 0)]
    for version in range(1, 70):  # each batch is in one run
        spans = [(number * 4**level, (number + 1) * 4**level) for level, number in feeds.runs_of(version, 4)]
        assert sorted(k for a, z in spans for k in range(a, z)) == list(range(version))
