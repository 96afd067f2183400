"""Queries of the llm problems, pN_..., and the SQL that checks them where SQL can."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import table

#: Vocabulary file of problem 6; any path all executors can read.
TOKENIZER = os.environ.get("LODESTONE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.llm.neighbours import neighbour_pairs

    return neighbour_pairs(table(spark, sf, "memories_vec", "id", "embedding"))


def p1_nearest(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.llm.neighbours import nearest

    return nearest(table(spark, sf, "memories_vec", "id", "embedding")).withColumn("similarity", F.round("similarity", 3))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.llm.pii import find

    return find(table(spark, sf, "memories", "id", "content"), table(spark, sf, "name_parts")).drop("end_pos")


def p3_redacted(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.llm.pii import redact

    return redact(table(spark, sf, "memories", "id", "content"), table(spark, sf, "name_parts"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.llm.neardup import similar_pairs

    return similar_pairs(table(spark, sf, "memories", "id", "content"), threshold=0.6, shingle=3)


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.llm.neardup import groups

    return groups(table(spark, sf, "memories", "id", "content"), threshold=0.6, shingle=3)


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.llm.tokenizer import encode

    return encode(table(spark, sf, "documents", "doc_id", "text"), TOKENIZER)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.llm.leakage import leaks

    return leaks(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "benchmark", "item_id", "text"))


def p7_edited(spark: SparkSession, sf: str) -> DataFrame:
    """Passages that may differ by one word edit."""
    from lodestone.llm.leakage import leaks

    return leaks(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "benchmark", "item_id", "text"), edits=1)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.llm.spans import shared_spans

    return shared_spans(table(spark, sf, "documents", "doc_id", "text"))


def p8_share(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.llm.spans import shared_share

    return shared_share(table(spark, sf, "documents", "doc_id", "text"))


def p8_lines(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.llm.spans import dedup_lines

    return dedup_lines(table(spark, sf, "documents", "doc_id", "text"))


def p8_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    from lodestone.llm.spans import without_repeats

    found = without_repeats(table(spark, sf, "documents", "doc_id", "text"))
    return found.withColumn("line_starts", F.array_join("line_starts", ","))


QUERIES = {f.__name__: f for f in (p1_found, p1_nearest, p3_found, p3_redacted, p4_found, p4_groups, p6_ids, p7_found, p7_edited, p8_found, p8_share, p8_lines, p8_cleaned)}

_GRAMS = """
  select {id}, array_to_string(w[i:i+9], ' ') as g
  from (select {id}, w, unnest(range(1, len(w) - 8)) as i
        from (select {id}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from {table}) where len(w) >= 10)
"""

_SPANS = """
with w as (select doc_id, p, substr(text, p + 1, 200) as g
           from (select doc_id, text, unnest(range(0, length(text) - 199)) as p from documents where length(text) >= 200)),
s as (select doc_id, p from w join (select g from w group by g having min(doc_id) < max(doc_id)) using (g)),
m as (select doc_id, p, case when p - lag(p) over (partition by doc_id order by p) <= 200 then 0 else 1 end as b from s),
k as (select doc_id, p, sum(b) over (partition by doc_id order by p) as r from m),
spans as (select doc_id, min(p) as span_start, max(p) + 200 - min(p) as span_len from k group by doc_id, r)
"""

_LINES = """
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(0, len(string_split(text, chr(10))))) as k
           from documents where text is not null),
s as (select doc_id, k, line, length(line) as len,
             coalesce(sum(length(line) + 1) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0)::bigint as start,
             trim(regexp_replace(lower(line), '[\\s\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g')) as norm from l),
m as (select *, length(norm) < 30 or row_number() over (partition by norm order by doc_id, start) = 1 as is_kept from s)
"""

SQL = {
    "p8_found": _SPANS + "select doc_id, span_start, span_len from spans",
    "p8_share": _SPANS + """
select d.doc_id, coalesce(n_spans, 0) as n_spans, coalesce(shared_chars, 0) as shared_chars,
       round(coalesce(shared_chars / nullif(n, 0)::double, 0), 6) as shared_share
from (select doc_id, max(coalesce(length(text), 0)) as n from documents group by doc_id) d
left join (select doc_id, count(*) as n_spans, sum(span_len)::bigint as shared_chars from spans group by doc_id) using (doc_id)""",
    "p8_lines": _LINES + "select doc_id, start as line_start, len as line_len, is_kept from m where length(norm) >= 30",
    "p8_cleaned": _LINES + """
select d.doc_id, case when d.text is not null then coalesce(string_agg(line, chr(10) order by k), '') end as text,
       coalesce(string_agg(start::varchar, ',' order by k), case when d.text is not null then '' end) as line_starts
from documents d left join m on d.doc_id = m.doc_id and is_kept group by d.doc_id, d.text""",
    "p7_found": f"""
with d as ({_GRAMS.format(id="doc_id", table="documents")}), i as ({_GRAMS.format(id="item_id", table="benchmark")})
select distinct d.doc_id, i.item_id from d join i using (g)""",
}
