"""Checks of a workspace: sections, ages of notes, stale facts, history of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE_LIMIT, NOTE_AGE, ARCHIVE_AGE = 5_000, 14, 21
# Facts that age, and whether a check reports them.
AGING = (
    ("medication_doses", r"(\d+)\s*doses?\s+restantes?", True),
    ("birthday", r"turn(?:ing|s)?\s+\d+", False),
    ("stale_status", r"en\s+cours|in\s+progress", True),
    ("date_mention", r"\d{4}[/-]\d{1,2}[/-]\d{1,2}", False),
)


def section_sizes(files: DataFrame, name: str, content: str, n: int | None = 5) -> DataFrame:
    """(name, section, size_chars): characters of each section with its header, newlines counted;
    of a repeated header the last one counts.  The ``n`` largest per file, ties by section."""
    parts = F.split(F.concat(F.col(content), F.lit("\n")), r"(?<=\n)(?=## )")
    rows = files.where(F.col(content).isNotNull()).select(F.col(name).alias("name"), F.posexplode(parts).alias("i", "part")).where("part <> ''")
    head = F.regexp_replace(F.element_at(F.split("part", "\n"), 1), r"(?U)\A\s+|\s+\z", "")
    section = F.when(F.col("part").startswith("## "), head).otherwise("Header")
    sized = rows.groupBy("name", section.alias("section")).agg(F.max_by(F.length("part"), F.col("i")).alias("size_chars"))
    if n is not None:
        order = Window.partitionBy("name").orderBy(F.desc("size_chars"), "section")
        sized = sized.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).drop("r")
    return sized


def size_check(files: DataFrame, name: str, content: str, limit: int = SIZE_LIMIT) -> DataFrame:
    """(name, size_chars, size_kb, lines, over_limit) of each file; size is in characters."""
    c = F.col(content)
    n = F.length(c)
    return files.where(c.isNotNull()).select(
        F.col(name).alias("name"), n.alias("size_chars"), F.round(n / 1024, 1).alias("size_kb"),
        (n - F.length(F.replace(c, F.lit("\n"), F.lit("")))).alias("lines"), (n > limit).alias("over_limit"),
    )


def section_lines(files: DataFrame, name: str, content: str) -> DataFrame:
    """(name, section, lines): the lines below each header as an array, without the header; of a
    repeated header the last one counts.  What stands before the first is ``Header``."""
    parts = F.split(F.col(content), r"(?<=\n)(?=## )")
    rows = files.where(F.col(content).isNotNull()).select(F.col(name).alias("name"), F.size(parts).alias("n"), F.posexplode(parts).alias("i", "part"))
    headed = F.col("part").startswith("## ")
    # the newline before the next header is no line of its own
    body = F.split(F.when(F.col("i") < F.col("n") - 1, F.regexp_replace("part", r"\n\z", "")).otherwise(F.col("part")), "\n")
    section = F.when(headed, F.regexp_replace(body[0], r"(?U)\A\s+|\s+\z", "")).otherwise("Header")
    kept = F.when(headed, F.slice(body, 2, F.size(body))).otherwise(body)
    # text that begins with a header has an empty first section
    opening = rows.where((F.col("i") == 0) & headed).select("name", F.lit("Header").alias("section"), F.lit(-1).alias("i"), F.array().cast("array<string>").alias("lines"))
    return rows.select("name", section.alias("section"), "i", kept.alias("lines")).unionByName(opening).groupBy("name", "section").agg(F.max_by("lines", "i").alias("lines"))


def note_ages(notes: DataFrame, as_of: Column, limit: int = NOTE_AGE) -> DataFrame:
    """One row over dated notes (source, day): totals, stale ones, newest and oldest with their ages."""
    age = F.datediff(as_of, F.col("day"))
    return notes.agg(
        F.count("*").alias("total_notes"), F.count_if(age > limit).alias("stale_notes"),
        F.max("day").alias("newest"), F.min("day").alias("oldest"), F.min(age).alias("newest_age"), F.max(age).alias("oldest_age"),
    )


def stale_notes(notes: DataFrame, as_of: Column, n: int | None = 5, limit: int = NOTE_AGE) -> DataFrame:
    """(source, day, age_days) of the notes older than ``limit`` days, the oldest ``n`` (all for None)."""
    aged = notes.select("source", "day", F.datediff(as_of, F.col("day")).alias("age_days")).where(F.col("age_days") > limit).orderBy("day", "source")
    return aged if n is None else aged.limit(n)


def flat_archive_plan(notes: DataFrame, as_of: Column, days: int = NOTE_AGE) -> DataFrame:
    """(source, destination): notes named by nothing but their date and older by it than ``days``,
    into one archive folder: what a repair moves, beside the plan by age of the file."""
    plain = F.col("source").rlike(r"\A\d{4}-\d{2}-\d{2}\.md\z")
    return notes.where(plain & (F.datediff(as_of, F.col("day")) > days)).select("source", F.concat(F.lit("archive/"), "source").alias("destination")).orderBy("source")


def archive_plan(notes: DataFrame, as_of: Column, days: int = ARCHIVE_AGE, existing: DataFrame | None = None) -> DataFrame:
    """(source, mtime, destination) of dated notes not touched for ``days`` days, oldest first.

    The age is that of the file, the folder the month in its name.  ``existing`` destinations are
    never overwritten.  A file without a time stays.
    """
    plan = notes.where(F.col("mtime") < as_of.cast("timestamp") - F.make_dt_interval(F.lit(days))).select(
        "source", "mtime", F.concat(F.lit("archive/"), F.date_format("day", "yyyy-MM"), F.lit("/"), "source").alias("destination")
    )
    if existing is not None:
        plan = plan.join(existing.select("destination"), "destination", "left_anti")
    return plan.orderBy("mtime", "source")


def aging_facts(texts: DataFrame, content: str) -> DataFrame:
    """(type, reported, n): matches of each kind of aging fact over all texts."""
    kinds = F.array(
        *(
            F.struct(F.lit(t).alias("type"), F.lit(r).alias("reported"), F.coalesce(F.size(F.regexp_extract_all(content, F.lit(f"(?iU){p}"), 0)), F.lit(0)).alias("k"))
            for t, p, r in AGING
        )
    )
    return texts.select(F.explode(kinds).alias("x")).groupBy("x.type", "x.reported").agg(F.sum("x.k").alias("n"))


def aging_contexts(texts: DataFrame, key: str, content: str, around: int = 40, unreported: bool = False) -> DataFrame:
    """(key, type, context): reported facts (with ``unreported``, the others too) with ``around``
    characters on both sides, stripped.

    Offsets follow from the lengths of what lies between the matches, so contexts may overlap.
    """
    out = None
    for kind, pattern, reported in AGING:
        if not (reported or unreported):
            continue
        rx = f"(?iU){pattern}"
        found = F.regexp_extract_all(content, F.lit(rx), 0)
        between = F.split(F.col(content), rx)
        size = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, x: s + F.length(x))
        at = F.transform(found, lambda m, i: F.struct((size(between, i + 1) + size(found, i)).alias("s"), F.length(m).alias("n")))
        part = texts.select(F.col(key).alias("key"), F.col(content).alias("c"), F.explode(at).alias("x")).select(
            "key", F.lit(kind).alias("type"),
            F.regexp_replace(
                F.substring(F.col("c"), F.greatest(F.col("x.s") - around, F.lit(0)) + 1, F.col("x.s") + F.col("x.n") + around - F.greatest(F.col("x.s") - around, F.lit(0))),
                r"(?U)\A\s+|\s+\z", "",
            ).alias("context"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def runs(history: DataFrame) -> DataFrame:
    """One row per valid run_date: of doubled days the greatest row by its counts."""
    day = F.try_to_date("run_date", "yyyy-MM-dd")
    row = ("size_bytes", "total_entities", "total_relations", "orphan_relations", "note_count", "benchmark_score", "run_mode")
    return (
        history.withColumn("day", day).where("day is not null")
        .groupBy("day").agg(F.max(F.struct(*row)).alias("x")).select("day", "x.*")
    )


def drift(history: DataFrame) -> DataFrame:
    """Each run against the one before: days between and changes, null for the first.

    The history has one row per day, so that a window over all of it is small.
    """
    order = Window.orderBy("day")
    change = lambda c: (F.col(c) - F.lag(c).over(order)).alias(f"{c}_change")
    return runs(history).select(
        "day", F.datediff("day", F.lag("day").over(order)).alias("days"), change("size_bytes"), change("total_entities"), change("note_count")
    )


def trend(history: DataFrame) -> DataFrame:
    """(metric, day, x, y, y_share): series to draw.  x counts the metric's days from 0, y_share is
    y relative to the metric's maximum; scores that are no numbers leave a gap."""
    score = F.try_to_number(F.col("benchmark_score"), F.lit("0.999")).cast("double")
    series = F.array(
        F.struct(F.lit("size_bytes").alias("metric"), F.col("size_bytes").cast("double").alias("y")),
        F.struct(F.lit("total_entities").alias("metric"), F.col("total_entities").cast("double").alias("y")),
        F.struct(F.lit("benchmark_score").alias("metric"), score.alias("y")),
    )
    rows = runs(history).select("day", F.explode(series).alias("s")).select("day", "s.*").where("y is not null")
    by = Window.partitionBy("metric")
    return rows.select(
        "metric", "day", (F.row_number().over(by.orderBy("day")) - 1).alias("x"), "y",
        F.round(F.col("y") / F.nullif(F.max("y").over(by), F.lit(0.0)), 6).alias("y_share"),
    )


def pipeline_status(has_scores: Column, has_report: Column) -> Column:
    return F.when(has_scores & has_report, "active").when(has_scores, "partial").otherwise("not_initialized")


def index_status(output: Column) -> tuple[Column, Column]:
    """Files and chunks from a status text such as ``Indexed · 12 files · 40 chunks``: the last
    part that names them in a line with ``Indexed``, else N/A."""
    lines = F.filter(F.split(output, "\n"), lambda x: x.contains("Indexed"))
    parts = F.flatten(F.transform(lines, lambda x: F.transform(F.split(x, "·"), lambda p: F.regexp_replace(p, r"(?U)\A\s+|\s+\z", ""))))
    last = lambda word: F.coalesce(F.try_element_at(F.filter(parts, lambda p: p.contains(word)), F.lit(-1)), F.lit("N/A"))
    return last("files"), last("chunks")


def drift_now(files: DataFrame, content: str, create_lines: DataFrame, history: DataFrame) -> DataFrame:
    """One row: the state now (characters of ``files``, creating lines of the log) against the last run.

    The log's lines are compared with the entities of that run, as a check of the workspace does,
    so a repeated creation counts as a change.  Without a run the last check and changes are null.
    """
    size = files.agg(F.coalesce(F.sum(F.length(content)), F.lit(0)).alias("size"))
    last = runs(history).agg(F.max("day").alias("last_check"), F.max_by("size_bytes", "day").alias("s"), F.max_by("total_entities", "day").alias("e"))
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(size).join(one(create_lines), "one").join(one(last), "one").select(
        "last_check", (F.col("size") - F.col("s")).alias("memory_size_change"), (F.col("create_lines") - F.col("e")).alias("entity_count_change")
    )


def report(sizes: DataFrame, ontology: DataFrame, ages: DataFrame, facts: DataFrame, drift: DataFrame, limit: int = SIZE_LIMIT) -> DataFrame:
    """One row of all checks; each frame but ``facts`` has one row, and each status is ok or warning."""
    one = lambda df: df.withColumn("one", F.lit(1))
    status = lambda bad: F.when(bad, "warning").otherwise("ok")
    row = one(sizes).join(one(ontology), "one").join(one(ages), "one").join(one(drift), "one")
    row = row.join(one(facts.agg(F.sum(F.when(F.col("reported"), F.col("n")).otherwise(0)).alias("stale_facts"))), "one").drop("one")
    return row.withColumns({
        "memory_status": status(F.col("size_chars") > limit), "ontology_status": status(F.col("orphan_relations") > 0),
        "notes_status": status(F.col("stale_notes") > 0), "decay_status": status(F.col("stale_facts") > 0),
    })
