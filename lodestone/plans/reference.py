"""Queries over a workspace's tables: items, scores, consolidation, ontology, health, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as fx
from lodestone.operators import chunks, consolidate, health, indexing, items, ontology, search
from lodestone.session import table
from lodestone.sources import notes as ns

#: The day all ages are counted from, in place of a clock.
AS_OF = "2026-06-01"
QUERY = "silent scheduler"
# The queries by which the search is tried out.
TRIED = ("project_alpha", "roadmap planning quarterly", "memory scoring decay temporal", "sample_note_01", "sqlite-vec FTS5 hybrid search", "team leadership coaching session", "knowledge base inbox archive")
#: More of them: phrases, accents, operators, a word of most memories, none at all.
MORE = ("silent_scheduler", "résolu MINUTES", "memory", "schicht -geflickt", "hybrid NEAR team", "roadmap team", '"?"')
_GRAPH = ("line_no", "op", "id", "entity", "relation", "changed_at")


def as_of():
    return F.lit(AS_OF).cast("date")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return ns.dated(table(spark, sf, "daily_notes", "file_name", "mtime", "content"))


def memory_file(spark: SparkSession, sf: str) -> DataFrame:
    return ns.long_term(table(spark, sf, "memories", "id", "source", "content"), as_of())


def all_notes(spark, sf):
    """Notes of the items, without those whose name is secret; the advisor reads all daily notes."""
    return ns.without_secrets(daily(spark, sf), "source").unionByName(memory_file(spark, sf))


def all_items(spark, sf):
    return items.extract_items(all_notes(spark, sf))


def scored(spark, sf):
    return items.score_items(all_items(spark, sf), as_of())


def graph(spark, sf):
    return table(spark, sf, "graph", *_GRAPH)


def memories(spark, sf):
    return table(spark, sf, "memories", "id", "content", "source", "score", "category", "layer", "created_at")


def vectors(spark, sf):
    return table(spark, sf, "memories_vec", "id", "embedding")


def _day(df):
    return df.withColumn("day", F.col("day").cast("string"))


def item_extract(spark, sf):
    return _day(all_items(spark, sf)).select("source", "day", "section", "text", "category", "text_key")


def noise_filter(spark, sf):
    s = F.col("stripped")
    noise = (F.length(s) < items.LEAST) | s.rlike(f"(?dU){fx.NOISE}")
    return items.note_lines(all_notes(spark, sf)).groupBy("source").agg(
        F.count("*").alias("n_lines"), F.count_if(noise).alias("n_noise")
    )


def category_detect(spark, sf):
    return search.one_per_id(memories(spark, sf), fx.category(F.col("content")).alias("detected"))


def category_hist(spark, sf):
    return items.dedup_items(all_items(spark, sf)).groupBy("category").agg(F.count("*").alias("n"))


def text_key_norm(spark, sf):
    return all_items(spark, sf).groupBy("text_key").agg(F.count("*").alias("n"))


def cluster_key_norm(spark, sf):
    lines = consolidate.advisor_lines(daily(spark, sf))
    return lines.groupBy(fx.cluster_key(F.col("text")).alias("cluster_key")).agg(F.count("*").alias("n"))


def entity_extract(spark, sf):
    return all_items(spark, sf).select("source", "text", F.concat_ws("|", "entities").alias("entities"))


def decay_score(spark, sf):
    return search.one_per_id(memories(spark, sf), F.round(fx.decay(F.col("created_at").cast("date"), as_of()), 6).alias("decay"))


def freq_boost(spark, sf):
    return items.dedup_items(all_items(spark, sf)).select("text_key", "frequency", F.round(fx.frequency_boost(F.col("frequency")), 6).alias("boost"))


def item_score(spark, sf):
    return _day(scored(spark, sf)).select("text_key", "source", "day", "category", "frequency", "score")


def dedup_keep_first(spark, sf):
    return _day(items.dedup_items(all_items(spark, sf))).select("text_key", "source", "day", "section", "text")


def score_topk(spark, sf):
    return items.public(items.ranked(scored(spark, sf), 50))


def score_stats(spark, sf):
    return items.score_stats(scored(spark, sf), previous_total=0)


def promotions(spark, sf):
    return items.public(items.ranked(items.promotions(scored(spark, sf)), 20))


def archive_candidates(spark, sf):
    return items.public(items.archive_candidates(scored(spark, sf))).drop("frequency", "category")


def archive_sources(spark, sf):
    return items.archive_candidates(scored(spark, sf)).where(F.col("source") != ns.MEMORY_FILE).groupBy("source").agg(F.count("*").alias("n"))


def item_hash(spark, sf):
    return search.one_per_id(memories(spark, sf), fx.short_hash(F.col("content")).alias("hash"))


def clusters(spark, sf):
    found = consolidate.clusters(consolidate.advisor_lines(daily(spark, sf)))
    return found.select("key", "n_items", "date_count", F.array_join(F.transform("dates", lambda d: d.cast("string")), "|").alias("dates"), F.array_join("sources", "|").alias("sources"), "sample_text")


def top_clusters(spark, sf):
    found = consolidate.top_clusters(consolidate.advisor_lines(daily(spark, sf)))
    return found.select("key", "date_count", consolidate.summary_of(F.col("sample_text")).alias("summary"))


def advisor_stats(spark, sf):
    return consolidate.line_stats(consolidate.advisor_lines(daily(spark, sf), as_of(), 90))


def duplicates(spark, sf):
    found = consolidate.duplicates(consolidate.advisor_lines(daily(spark, sf)))
    return found.withColumns({c: F.col(c).cast("string") for c in ("date1", "date2")})


def top_duplicates(spark, sf):
    found = consolidate.duplicates(consolidate.advisor_lines(daily(spark, sf)), consolidate.MOST_DUPLICATES)
    return found.withColumns({c: F.col(c).cast("string") for c in ("date1", "date2")})


def advisor_promotions(spark, sf):
    return _day(consolidate.advisor_promotions(scored(spark, sf)))


def stale(spark, sf):
    """The predicate of stale items at a threshold that MEMORY.md's items, which never age, can miss."""
    return consolidate.stale_items(scored(spark, sf), threshold=2.0, n=None)


def recommendations(spark, sf):
    return _report(spark, sf).select(F.explode("recommendations").alias("recommendation"))


def _report(spark, sf):
    return consolidate.report(consolidate.advisor_lines(daily(spark, sf)), scored(spark, sf))


def consolidation_report(spark, sf):
    texts = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), "|")
    return _report(spark, sf).select(
        "notes_analyzed", "files_analyzed", "clusters_found", "promotions_found", "stale_items_found", "duplicates_found",
        texts("clusters", "summary").alias("clusters"), texts("promotions", "text").alias("promotions"),
        F.array_join(F.array_sort(F.transform("duplicates", lambda x: x["text"])), "|").alias("duplicates"), F.array_join("recommendations", "|").alias("recommendations"),
    )


def scores_report(spark, sf):
    row = items.report(scored(spark, sf), previous_total=0)
    listed = lambda c, *more: F.transform(c, lambda x, i: F.struct(F.lit(c).alias("list"), i.alias("place"), x["hash"].alias("hash"), x["score"].alias("score"), x["source"].alias("source"), x["date"].alias("date")))
    kinds = F.transform(F.map_entries("category_distribution"), lambda x: F.struct(
        F.lit("category").alias("list"), F.lit(0).alias("place"), x["key"].alias("hash"), x["value"].cast("double").alias("score"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("date")))
    return row.select(F.explode(F.concat(listed("top_items"), listed("promoted"), listed("archive"), kinds)).alias("x")).select("x.*")


def pii_redact(spark, sf):
    return search.one_per_id(memories(spark, sf), fx.redact_secrets(F.col("content")).alias("redacted"))


def pii_counts(spark, sf):
    counts = F.array(*(F.struct(F.lit(k).alias("kind"), fx.secret_count(F.col("content"), k).alias("n")) for k, _ in fx.SECRETS))
    return search.one_per_id(memories(spark, sf), counts.alias("counts")).select(F.explode("counts").alias("x")).groupBy("x.kind").agg(F.sum("x.n").alias("n"))


def promotion_apply_plan(spark, sf):
    return consolidate.promotion_plan(consolidate.advisor_promotions(scored(spark, sf)), memory_file(spark, sf)).select("text", "source", "score")


def ontology_replay(spark, sf):
    return ontology.replay(graph(spark, sf))


def ontology_entities(spark, sf):
    return ontology.entities(graph(spark, sf))


def ontology_types(spark, sf):
    return ontology.type_counts(graph(spark, sf))


def ontology_orphans(spark, sf):
    return ontology.early_references(graph(spark, sf))


def ontology_totals(spark, sf):
    return ontology.totals(graph(spark, sf))


def ontology_dedup(spark, sf):
    return ontology.dedup_lines(graph(spark, sf))


def section_sizes(spark, sf):
    return health.section_sizes(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text").withColumnRenamed("name", "doc_id")


def size_check(spark, sf):
    return health.size_check(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text").withColumnRenamed("name", "doc_id")


def note_hygiene(spark, sf):
    found = health.note_ages(daily(spark, sf), as_of())
    return found.withColumns({c: F.col(c).cast("string") for c in ("newest", "oldest")})


def stale_notes(spark, sf):
    return _day(health.stale_notes(daily(spark, sf), as_of()))


def flat_archive_plan(spark, sf):
    """At the name's first ten characters, for no note of these tables is named by its date alone."""
    plain = daily(spark, sf).withColumn("source", F.concat(F.substring("source", 1, 10), F.lit(".md"))).dropDuplicates(["source"])
    return health.flat_archive_plan(plain, as_of())


def archive_plan(spark, sf):
    notes = ns.latest_files(table(spark, sf, "daily_notes", "file_name", "mtime", "content")).withColumn("day", fx.note_date(F.col("file_name")))
    notes = notes.where("day is not null").withColumnRenamed("file_name", "source")
    return health.archive_plan(notes, as_of()).select("source", F.date_format("mtime", "yyyy-MM-dd HH:mm:ss").alias("mtime"), "destination")


def stale_facts(spark, sf):
    return health.aging_facts(memory_file(spark, sf), "content")


def aging_contexts(spark, sf):
    """Contexts of all kinds of facts: those that a check reports do not occur in these tables."""
    return health.aging_contexts(memory_file(spark, sf), "chunk", "content", unreported=True)


def memory_sections(spark, sf):
    found = health.section_lines(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")
    return found.select(F.col("name").alias("doc_id"), "section", F.size("lines").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("digest"))


def drift_now(spark, sf):
    found = health.drift_now(memory_file(spark, sf), "content", ontology.totals(graph(spark, sf)).select("create_lines"), table(spark, sf, "health_runs"))
    return found.withColumn("last_check", F.col("last_check").cast("string"))


def health_report(spark, sf):
    memory = memory_file(spark, sf)
    sizes = memory.agg(F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("size_chars"))
    totals = ontology.totals(graph(spark, sf))
    drifted = health.drift_now(memory, "content", totals.select("create_lines"), table(spark, sf, "health_runs"))
    row = health.report(sizes, totals, health.note_ages(daily(spark, sf), as_of()), health.aging_facts(memory, "content"), drifted)
    return row.withColumns({c: F.col(c).cast("string") for c in ("newest", "oldest", "last_check")})


def drift(spark, sf):
    return health.drift(table(spark, sf, "health_runs")).withColumn("day", F.col("day").cast("string"))


def trend_series(spark, sf):
    return health.trend(table(spark, sf, "health_runs")).withColumn("day", F.col("day").cast("string"))


def pipeline_status(spark, sf):
    s = scored(spark, sf).agg(F.count("*").alias("items")).withColumn("one", F.lit(1))
    c = consolidate.clusters(consolidate.advisor_lines(daily(spark, sf))).agg(F.count("*").alias("clusters")).withColumn("one", F.lit(1))
    return s.join(c, "one").select("items", "clusters", health.pipeline_status(F.col("items") > 0, F.col("clusters") > 0).alias("status"))


def chunk_docs(spark, sf):
    return chunks.chunk_rows(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")


def chunk_cap(spark, sf):
    return chunks.chunk_rows(table(spark, sf, "documents", "doc_id", "text"), "doc_id", "text", cap=True)


def corpus_classes(spark, sf):
    return ns.classify_files(table(spark, sf, "documents", "source").where("source is not null").distinct().withColumnRenamed("source", "file_path")).drop("file_path")


def jsonl_contents(spark, sf):
    return ns.jsonl_contents(table(spark, sf, "graph", "entity"), "entity").groupBy("content").agg(F.count("*").alias("n"))


def lexical_search(spark, sf):
    return search.lexical_search(memories(spark, sf), QUERY, 40).withColumn("bm25", F.round("bm25", 6))


def lexical_tried(spark, sf):
    return search.lexical_many(memories(spark, sf), [*TRIED, *MORE], 20).withColumn("bm25", F.round("bm25", 6))


def _vector(spark, sf):
    return search.query_vector(vectors(spark, sf), search.lexical_search(memories(spark, sf), QUERY, 40))


def _near(spark, sf, metric):
    v = _vector(spark, sf)
    if v is None:
        return spark.createDataFrame([], "id bigint, source string, distance double, vec_rank int")
    return search.vector_search(vectors(spark, sf), memories(spark, sf), v, 40, metric).withColumn("distance", F.round("distance", 5))


def vector_l2(spark, sf):
    return _near(spark, sf, "l2")


def vector_cosine(spark, sf):
    return _near(spark, sf, "cosine")


def hybrid_rrf(spark, sf):
    found = search.fuse(search.lexical_search(memories(spark, sf), QUERY, 40), _near(spark, sf, "l2"))
    return found.withColumn("rrf", F.round("rrf", 6))


def hybrid_boosted(spark, sf):
    fused = search.fuse(search.lexical_search(memories(spark, sf), QUERY, 40), _near(spark, sf, "l2"))
    return search.boost(fused, memories(spark, sf)).select("id", F.round("rrf", 6).alias("rrf"), F.round("boosted", 6).alias("boosted"))


def hybrid_dedup(spark, sf):
    found = search.hybrid_search(memories(spark, sf), vectors(spark, sf), QUERY, 10)
    return found.select("id", "source", "lex_rank", "vec_rank", F.round("rrf", 6).alias("rrf"), F.round("boosted", 6).alias("boosted"))


def hybrid_results(spark, sf):
    found = search.hybrid_search(memories(spark, sf), vectors(spark, sf), QUERY, 5, details=("content", "category", "layer"))
    return found.withColumn("content", F.substring("content", 1, 300)).select("id", "source", F.round("rrf", 6).alias("rrf"), "content", "category", "layer")


def round_exact(spark, sf):
    """Rounding of exact binary values: scores halved until they end in a 5 of the next decimal."""
    one = search.one_per_id(memories(spark, sf), "score").where("score is not null")
    return one.select("id", fx.exact_round(F.round(F.col("score") * 32, 0) / 32, 4).alias("rounded"))


def index_documents(spark, sf):
    files = table(spark, sf, "documents", "source", "text").where("source is not null").select(F.col("source").alias("file_path"), F.col("text").alias("content"))
    return indexing.index_workspace(files, as_of().cast("timestamp")).groupBy("source", "category", "layer", "score").agg(F.count("*").alias("n_chunks"))


def store_stats(spark, sf):
    return search.store_stats(memories(spark, sf), vectors(spark, sf)).withColumn("latest", F.date_format("latest", "yyyy-MM-dd HH:mm:ss"))


def category_breakdown(spark, sf):
    return search.breakdown(memories(spark, sf), "category")


def layer_breakdown(spark, sf):
    return search.breakdown(memories(spark, sf), "layer")


QUERIES = {
    f.__name__: f
    for f in (
        item_extract, noise_filter, category_detect, category_hist, text_key_norm, cluster_key_norm, entity_extract,
        decay_score, freq_boost, item_score, dedup_keep_first, score_topk, score_stats, promotions, archive_candidates,
        archive_sources, item_hash, clusters, top_clusters, advisor_stats, duplicates, top_duplicates, consolidation_report, scores_report, advisor_promotions, stale, recommendations, pii_redact, pii_counts,
        promotion_apply_plan, ontology_replay, ontology_entities, ontology_types, ontology_orphans, ontology_totals,
        ontology_dedup, section_sizes, size_check, note_hygiene, stale_notes, flat_archive_plan, archive_plan, stale_facts, aging_contexts, memory_sections, drift, drift_now, health_report,
        trend_series, pipeline_status, chunk_docs, chunk_cap, corpus_classes, jsonl_contents, lexical_search, lexical_tried, vector_l2,
        vector_cosine, hybrid_rrf, hybrid_boosted, hybrid_dedup, hybrid_results, round_exact, index_documents, store_stats, category_breakdown, layer_breakdown,
    )
}
