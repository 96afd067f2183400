"""Queries of the general data problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators import changes, references
from lodestone.session import table

_COLUMNS = ("change_seq", "op", "id", "entity", "relation", "changed_at")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return references.orphans(table(spark, sf, "graph", *_COLUMNS)).drop("op", "changed_at")


def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    return references.orphan_counts(table(spark, sf, "graph", *_COLUMNS))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return changes.apply_changes(table(spark, sf, "graph", *_COLUMNS))


QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p5_found)}

_READ = """
with c as (
  select change_seq as seq, lower(op) as op, entity, relation, changed_at,
         coalesce(nullif(id, ''), nullif(json_extract_string(entity, '$.id'), '')) as key
  from (select * from graph where (entity is null or (json_valid(entity) and ltrim(entity) like '{%'))
                              and (relation is null or (json_valid(relation) and ltrim(relation) like '{%')))
  where change_seq is not null and op is not null),
life as (select distinct key, seq, op <> 'delete' as alive from c
         where relation is null and key is not null and op in ('create', 'upsert', 'delete'))
"""

_ORPHANS = _READ + """,
r as (
  select seq, op, changed_at, 'from' as field,
         case when json_extract(relation, '$.from') is not null then json_extract_string(relation, '$.from') else json_extract_string(relation, '$.source') end as ref from c
  union all
  select seq, op, changed_at, 'to',
         case when json_extract(relation, '$.to') is not null then json_extract_string(relation, '$.to') else json_extract_string(relation, '$.target') end from c
  union all select seq, op, changed_at, 'owner', json_extract_string(entity, '$.owner') from c
  union all select seq, op, changed_at, 'id', key from c where op in ('update', 'delete') and relation is null),
d as (select seq, field, ref, min(op) as op, min(changed_at) as changed_at from r where ref <> '' group by seq, field, ref),
a as (select d.*, (select arg_max(l.alive, l.seq) from life l where l.key = d.ref and l.seq < d.seq) as alive,
             (select min(l.seq) from life l where l.key = d.ref and l.alive) as first from d),
o as (select seq as change_seq, field as ref_field, ref as ref_id, op, changed_at,
             case when first is null then 'missing' when first > seq then 'late' else 'deleted' end as reason
      from a where not coalesce(alive, false))
"""

SQL = {
    "p2_found": _ORPHANS + "select change_seq, ref_field, ref_id, reason from o",
    "p2_counts": _ORPHANS + "select op, strftime(changed_at at time zone 'UTC', '%Y-%m') as month, reason, count(*) as n from o group by all",
    "p5_found": _READ + """,
s as (select key, max(seq) as seq, arg_max(alive, seq) as alive from life group by key),
x as (select key, seq, entity, unnest(json_keys(entity)) as attr from c
      where relation is null and key is not null and entity is not null and op in ('create', 'upsert', 'update')),
v as (select key, seq, attr, json_extract_string(entity, '$."' || attr || '"') as val from x),
m as (select key, attr, seq, val, row_number() over (partition by key, attr order by seq desc, val desc nulls last) as n from v)
select m.key as id, m.attr, m.val from m join s on m.key = s.key and s.alive and m.seq >= s.seq
where n = 1 and attr <> 'id' and val is not null""",
}
