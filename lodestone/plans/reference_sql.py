"""The same queries in SQL for DuckDB, written apart from the DataFrame plans."""

from __future__ import annotations

# Fixed values, written here once more so that a slip in the plans shows: the day ages are counted
# from, words of categories, kinds of secrets, words that are no entities, facts that age.
AS_OF = "2026-06-01"
CATEGORY_WORDS = (
    ('decision', r"décidé|decided|choisi|chosen|validé|validated|mis en place|deployed|désactivé|disabled|activé|enabled|supprimé|deleted|créé|created|configuré|configured|migré|migrated|installé|installed|livré|shipped|GO|✅|fais-le|approuvé|approved|renamed|changé|changed|switched|updated to|upgraded to"),
    ('error', r"erreur|error|bug|fail|échec|crash|broken|corrompu|corrupted|fixé|fixed|résolu|resolved|workaround|⚠️|❌|panic|exception|timeout|429|500|502|503"),
    ('fact', r"version|v\d+\.\d+|released|publié|annoncé|announced|status|état|config|settings|port|url|ip address|token|key|password|api|endpoint|✅|mis à jour|updated|ajouté|added"),
    ('pattern', r"toujours|always|jamais|never|récurrence|recurring|pattern|habit|chaque|every|quotidien|daily|cron|schedule|régulier|regular"),
)
SECRETS = (
    ('github_token', r"gh[pousr]_[A-Za-z0-9]{36}"),
    ('openai_key', r"sk-[A-Za-z0-9]{20,}"),
    ('google_key', r"AIza[A-Za-z0-9_\\-]{35}"),
    ('email', r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}"),
    ('credential', r"(?i)(?:password|passwd|pwd|secret|token|api_key)\s*[:=]\s*\S+"),
    ('bearer', r"Bearer\s+[A-Za-z0-9._-]+"),
    ('slack_token', r"xox[baprs]-[A-Za-z0-9-]+"),
    ('private_key', r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC )?PRIVATE KEY-----"),
)
NO_ENTITY = ('The', 'This', 'That', 'These', 'Those', 'Today', 'Tonight', 'Yesterday', 'Tomorrow', 'Morning', 'Evening', 'Afternoon', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday')
NO_ACRONYM = ('API', 'URL', 'IP', 'SSH', 'HTTP', 'HTTPS', 'DNS', 'TCP', 'UDP', 'XML', 'HTML', 'CSS', 'SQL', 'JSON', 'YAML', 'TOML', 'CSV', 'PDF', 'PNG', 'JPG', 'SVG', 'UTC', 'GMT', 'CET')
AGING = (
    ('medication_doses', r"(\d+)\s*doses?\s+restantes?", True),
    ('birthday', r"turn(?:ing|s)?\s+\d+", False),
    ('stale_status', r"en\s+cours|in\s+progress", True),
    ('date_mention', r"\d{4}[/-]\d{1,2}[/-]\d{1,2}", False),
)
SECRET_PATHS = r"(?i)\.secrets/|\.env$|credentials|token|password|\.git/"
_WS = r"[\t-\r \x{85}\p{Z}]"
_DAY = f"date '{AS_OF}'"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _category(x: str) -> str:
    arms = " ".join(f"when regexp_matches({x}, {_q('(?i)(?:' + w + ')')}) then '{n}'" for n, w in CATEGORY_WORDS)
    return f"case when {x} is null then null {arms} else 'transient' end"


def _key(x: str, marks: str, clock: bool) -> str:
    x = _strip(f"lower({x})")
    x = f"regexp_replace({x}, '^[-*]{_WS}+', '')"
    x = f"regexp_replace({x}, '^(?:{marks}){_WS}*', '')"
    x = rf"regexp_replace({x}, '\p{{Nd}}{{4}}-\p{{Nd}}{{2}}-\p{{Nd}}{{2}}', '', 'g')"
    if clock:
        x = rf"regexp_replace({x}, '\p{{Nd}}+:\p{{Nd}}+', '', 'g')"
    x = f"regexp_replace({x}, '{_WS}+', ' ', 'g')"
    return _strip(f"substr({x}, 1, 60)")


_TEXT_KEY = lambda x: _key(x, "TODO|DONE|✅|❌|⚠️", False)
_CLUSTER_KEY = lambda x: _key(x, "TODO|DONE|✅|❌|⚠️|🔵", True)


def _plain(x: str) -> str:
    x = rf"regexp_replace({x}, '\*\*(.+?)\*\*', '\1', 'g')"
    x = rf"regexp_replace({x}, '`(.+?)`', '\1', 'g')"
    x = rf"regexp_replace({x}, '\[([^\]]+)\]\([^)]+\)', '\1', 'g')"
    return _strip(f"ltrim({x}, '-* ')")


_LIST = lambda names: ", ".join(f"'{n}'" for n in names)


_NOTES = rf"""
with memory as (select id, max(content) as content from memories where source = 'MEMORY.md' group by id),
files as (
  select * from (select *, row_number() over (partition by file_name order by mtime desc nulls last, content desc nulls last) as n
                 from daily_notes where file_name is not null) where n = 1),
dated as (
  select * from (select *, try_strptime(regexp_extract(file_name, '^(\d{{4}}-\d{{2}}-\d{{2}})(?:-.+)?\.md$', 1), '%Y-%m-%d')::date as day from files)
  where day is not null),
notes as (
  select file_name as source, day, 0 as chunk, content, false as late, regexp_matches(file_name, '{SECRET_PATHS}') as secret from dated
  union all select 'MEMORY.md', {_DAY}, id, content, true, false from memory),
split as (
  select source, day, chunk, late, secret, unnest(string_split(content, chr(10))) as raw, unnest(range(len(string_split(content, chr(10))))) as i
  from notes where content is not null),
marked as (select *, {_strip("raw")} as s from split),
headed as (select *, case when s like '## %' then {_strip("ltrim(s, '# ')")} end as h from marked),
lines as (
  select * from (select *, coalesce(last_value(h ignore nulls) over (partition by source, chunk order by i rows unbounded preceding), 'general') as section
                 from headed) where h is null)
"""

_NOISE = _q(rf"^(?:{_WS}*[-*]{_WS}*$|#{{1,6}}{_WS}|{_WS}*```|{_WS}*\|.*\|{_WS}*$|---+|{_WS}*(?:HEARTBEAT_OK|NO_REPLY))")

#: Letters beyond ASCII become _, so that RE2's ASCII word borders agree with Unicode's.
_BORDERS = r"regexp_replace(clean, '[\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{2af}\x{370}-\x{1fff}\x{2c00}-\x{2dff}\x{3040}-\x{d7ff}]', '_', 'g')"

_ITEMS = (
    _NOTES
    + rf""",
clean as (
  select * from (select *, {_plain("s")} as clean from lines where not secret and length(s) >= 15 and not regexp_matches(s, {_NOISE})) where length(clean) >= 15),
found as (
  select *, {_BORDERS} as b from clean),
listed as (
  select *, list_concat(list_concat(
      list_filter(regexp_extract_all(b, '\b([A-Z][a-z]+(?:{_WS}+[A-Z][a-z]+)?)\b', 1), lambda w: w not in ({_LIST(NO_ENTITY)})),
      regexp_extract_all(b, '\b(v\p{{Nd}}+\.\p{{Nd}}+(?:\.\p{{Nd}}+)?)\b', 1)),
      list_filter(regexp_extract_all(b, '\b([A-Z]{{2,5}})\b', 1), lambda w: w not in ({_LIST(NO_ACRONYM)}))) as all_entities from found),
items as (
  select source, day, chunk, late, i, lower(section) as section, substr(clean, 1, 200) as text, {_TEXT_KEY("clean")} as text_key,
         {_category("clean")} as category,
         list_filter(all_entities, lambda w, k: list_position(list_transform(all_entities, lambda x: lower(x)), lower(w)) = k)[1:5] as entities
  from listed)
"""
)

_DEDUP = (
    _ITEMS
    + """,
kept as (
  select i.*, f.frequency from (
    select *, row_number() over (partition by text_key order by late desc, source, chunk, i) as n from items) i
  join (select text_key, count(distinct day) as frequency from items group by text_key) f using (text_key) where n = 1)
"""
)

_WEIGHT = "case category when 'decision' then 3.0::double when 'error' then 2.0::double when 'fact' then 1.5::double when 'pattern' then 1.2::double else 1.0::double end"
_SCORED = (
    _DEDUP
    + f""",
scored as (
  select *, round(least({_WEIGHT} * pow(0.5::double, greatest(datediff('day', day, {_DAY}), 0) / 14.0::double)
      * case when frequency > 1 then 1 + ln(frequency::double) * (1.3::double - 1.0::double) else 1 end
      * case when len(entities) > 2 then 1 + 0.1::double * least(len(entities) - 2, 3) else 1 end
      * case when category = 'decision' and regexp_matches(text, '(?i)\\[x\\]|completed|done|terminé|livré') then 0.5::double else 1 end, 5.0::double)::decimal(30, 17), 4)::double as score
  from kept)
"""
)

_PUBLIC = "substr(sha256(text), 1, 16) as hash, score, category, source, day::varchar as date, frequency"

_ADVISOR = (
    _NOTES
    + f""",
adv as (
  select source, day, i, section, substr(clean, 1, 200) as text from (
    select *, {_plain("s")} as clean from lines where not late and length(s) >= 15 and s not like '```%' and s not like '|%') where length(clean) >= 15),
keyed as (select *, {_CLUSTER_KEY("text")} as key from adv),
clusters as (
  select key, count(*) as n_items, count(distinct day) as date_count, string_agg(distinct day::varchar, '|' order by day::varchar) as dates,
         string_agg(distinct source, '|' order by source) as sources, arg_min(text, (source, i)) as sample_text
  from keyed where key <> '' group by key having count(distinct day) >= 2),
dups as (
  select substr(text, 1, 100) as text, s1 as source1, source as source2, d1::varchar as date1, day::varchar as date2, i from (
    select *, first_value(source) over w as s1, first_value(day) over w as d1 from keyed window w as (partition by key order by source, i)) where s1 <> source)
"""
)

_PROMOTED = (
    _SCORED
    + f""",
promoted as (
  select * from (select *, row_number() over (partition by {_CLUSTER_KEY("text")} order by score desc, text_key) as m
                 from scored where score >= 2.0 and source <> 'MEMORY.md') where m = 1 order by score desc, text_key limit 20)
"""
)

_GRAPH = """
with g as (
  select line_no, lower(op) as op, entity, relation, coalesce(nullif(id, ''), nullif(json_extract_string(entity, '$.id'), '')) as key
  from (select * from graph where (entity is null or (json_valid(entity) and ltrim(entity) like '{%'))
                              and (relation is null or (json_valid(relation) and ltrim(relation) like '{%')))
  where line_no is not null and op is not null),
made as (select key, max(line_no) as last, min(line_no) as first from g
         where relation is null and key is not null and op in ('create', 'upsert') group by key),
x as (select g.key, line_no, entity, unnest(json_keys(entity)) as attr from g join made m on g.key = m.key and line_no >= m.last
      where relation is null and entity is not null and op in ('create', 'upsert', 'update')),
attrs as (select key as id, attr, arg_max(json_extract_string(entity, '$."' || attr || '"'), line_no) as val0,
                 (select json_extract_string(e.entity, '$."' || x.attr || '"') from g e where e.line_no = max(x.line_no)) as val
          from x group by key, attr),
ends as (
  select line_no, 'from' as side, case when json_extract(relation, '$.from') is not null then json_extract_string(relation, '$.from') else json_extract_string(relation, '$.source') end as ref
  from g where relation is not null and op in ('relate', 'create', 'upsert')
  union all
  select line_no, 'to', case when json_extract(relation, '$.to') is not null then json_extract_string(relation, '$.to') else json_extract_string(relation, '$.target') end
  from g where relation is not null and op in ('relate', 'create', 'upsert')),
early as (select line_no, side, ref from ends left join made on ref = key where ref <> '' and (first is null or first >= line_no)),
entities as (select key as id, coalesce((select val from attrs a where a.id = made.key and a.attr = 'type'), 'unknown') as type from made)
"""

_ONE = "(select * from (select *, row_number() over (partition by id order by source) as n from memories where id is not null) where n = 1)"

_LEX = r"""
with one as {ONE},
t as (select id, source, regexp_extract_all(strip_accents(lower(content)), '[\p{L}\p{N}]+') as t from one where content is not null),
c as (select id, source, len(t) as len, len(list_filter(t, lambda w: w = 'silent')) as a, len(list_filter(t, lambda w: w = 'scheduler')) as b from t),
s as (select count(*) as n, avg(len) as avgdl, count(*) filter (a > 0) as da, count(*) filter (b > 0) as db from c),
k as (select c.*, case when ln((n - da + 0.5) / (da + 0.5)) > 0 then ln((n - da + 0.5) / (da + 0.5)) else 1e-6 end as ia,
             case when ln((n - db + 0.5) / (db + 0.5)) > 0 then ln((n - db + 0.5) / (db + 0.5)) else 1e-6 end as ib, 1.2 * (1 - 0.75 + 0.75 * len / avgdl) as norm from c, s),
lex as (select id, source, -(ia * a * 2.2 / (a + norm)) - (ib * b * 2.2 / (b + norm)) as bm25 from k where a > 0 and b > 0),
lexical as (select *, row_number() over (order by bm25, id)::integer as lex_rank from lex qualify lex_rank <= 40),
usable as (select id, any_value(embedding::double[]) as v from memories_vec
           where len(embedding) = 768 and len(list_filter(embedding, lambda x: isnan(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by id),
q as (select v from usable join lexical using (id) order by lex_rank limit 1),
dist as (select u.id, {distance} as distance from usable u, q),
top as (select * from dist qualify row_number() over (order by round(distance, 9), id) <= 40),
vector as (select top.id, one.source, distance, row_number() over (order by round(distance, 9), top.id)::integer as vec_rank from top join one on top.id = one.id),
fused as (
  select coalesce(l.id, v.id) as id, coalesce(l.source, v.source) as source, lex_rank, vec_rank,
         coalesce(1 / (60 + lex_rank)::double, 0) + coalesce(1 / (60 + vec_rank)::double, 0) as rrf
  from lexical l full join vector v on l.id = v.id),
floored as (select * from fused where rrf >= 0.015),
boosted as (
  select f.*, rrf * (1 + 0.1 * coalesce(score, 0) / (select coalesce(nullif(max(score), 0), 1.0) from one where id in (select id from floored))) as boosted
  from floored f left join one using (id)),
best as (
  select * from (select *, row_number() over (partition by source order by rrf desc, id) as m from boosted) where m = 1 or source is null or source = '')
""".replace("{ONE}", _ONE)
_L2 = _LEX.replace("{distance}", "sqrt(list_sum(list_transform(list_zip(u.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))")
_COS = _LEX.replace("{distance}", "1 - list_dot_product(u.v, q.v) / (sqrt(list_dot_product(u.v, u.v)) * sqrt(list_dot_product(q.v, q.v)))")


def _tried() -> str:
    """The same for queries of any phrases, each written out as its tokens."""
    tried = {
        "project_alpha": ["project alpha"], "roadmap planning quarterly": ["roadmap", "planning", "quarterly"], "memory scoring decay temporal": ["memory", "scoring", "decay", "temporal"],
        "sample_note_01": ["sample note 01"], "sqlite-vec FTS5 hybrid search": ["sqlite", "vec", "fts5", "hybrid", "search"], "team leadership coaching session": ["team", "leadership", "coaching", "session"],
        "knowledge base inbox archive": ["knowledge", "base", "inbox", "archive"], "silent_scheduler": ["silent scheduler"], "résolu MINUTES": ["resolu", "minutes"], "memory": ["memory"],
        "schicht -geflickt": ["schicht", "geflickt"], "hybrid NEAR team": ["hybrid", "team"], "roadmap team": ["roadmap", "team"],
    }
    rows = ", ".join(f"('{q}', '{p}', {len(ps)})" for q, ps in tried.items() for p in ps)
    return rf"""
with one as {_ONE},
t as (select id, source, regexp_extract_all(strip_accents(lower(content)), '[\p{{L}}\p{{N}}]+') as t from one where content is not null),
p(query, phrase, n_phrases) as (values {rows}),
w as (select distinct string_split(phrase, ' ') as w, phrase from p),
tf as (select id, source, len(t) as len, phrase, len(list_filter(range(1, len(t) - len(w) + 2), lambda i: t[i:i + len(w) - 1] = w)) as f from t, w where list_contains(t, w[1])),
s as (select count(*) as n, avg(len(t)) as avgdl from t),
df as (select phrase, count(*) as df from tf where f > 0 group by phrase),
part as (select query, n_phrases, id, source, greatest(ln((n - df + 0.5) / (df + 0.5)), 0) as idf, f, 1.2 * (1 - 0.75 + 0.75 * len / avgdl) as norm
         from p join tf using (phrase) join df using (phrase), s where f > 0),
hit as (select query, id, source, -sum(case when idf > 0 then idf else 1e-6 end * f * 2.2 / (f + norm)) as bm25 from part group by query, n_phrases, id, source having count(*) = n_phrases)
select query, id, source, round(bm25, 6) as bm25, row_number() over (partition by query order by bm25, id)::integer as lex_rank from hit qualify lex_rank <= 20"""


def _redact(x: str) -> str:
    for _, p in SECRETS:
        x = f"regexp_replace({x}, {_q(p)}, '[REDACTED]', 'g')"
    return x


_RUNS = """
with r as (select *, try_strptime(run_date, '%Y-%m-%d')::date as day from health_runs),
runs as (
  select * from (select *, row_number() over (partition by day order by size_bytes desc nulls last, total_entities desc nulls last, total_relations desc nulls last,
    orphan_relations desc nulls last, note_count desc nulls last, benchmark_score desc nulls last, run_mode desc nulls last) as n from r where day is not null) where n = 1)
"""

_NOW = _RUNS.strip().removeprefix("with") + """,
now_ as (
  select max(day)::varchar as last_check, ((select coalesce(sum(length(c)), 0) from (select max(content) as c from memories where source = 'MEMORY.md' group by id)) - arg_max(size_bytes, day))::bigint as memory_size_change,
         (select count(*) from g where op in ('create', 'upsert')) - arg_max(total_entities, day) as entity_count_change from runs)
"""

# The fold of chunks: events of each text in order (P a paragraph that fits, S and E begin and end a
# longer one, L a line of it, F the end of the text), each of which puts out one chunk or none.
_CHUNKS = f"""
with recursive t as (select distinct doc_id as key, text from documents where text is not null),
par as (select key, unnest(string_split(text, chr(10) || chr(10))) as p, unnest(range(len(string_split(text, chr(10) || chr(10))))) as i from t where length(text) > 2000),
ev as (
  select key, i, 0 as j, 'P' as kind, p as x from par where length(p) <= 2000
  union all select key, i, -1, 'S', '' from par where length(p) > 2000
  union all select key, i, unnest(range(len(string_split(p, chr(10))))), 'L', unnest(string_split(p, chr(10))) from par where length(p) > 2000
  union all select key, i, 1000000000, 'E', '' from par where length(p) > 2000
  union all select key, 1000000000, 0, 'F', '' from (select distinct key from par)),
seq as (select key, row_number() over (partition by key order by i, j) as n, kind, x from ev),
fold as (
  select key, 0::bigint as n, '' as pending, '' as tail, null::varchar as chunk from (select distinct key from par)
  union all
  select f.key, s.n,
    case kind when 'P' then case when length(pending) + length(x) + 2 > 2000 then '' else pending end || x || chr(10) || chr(10)
              when 'E' then case when {_strip("tail")} <> '' and pending <> '' then {_strip("tail")} else pending end else pending end,
    case kind when 'L' then case when length(tail) + length(x) + 1 > 2000 then '' else tail end || x || chr(10) else '' end,
    case when kind = 'P' and pending <> '' and length(pending) + length(x) + 2 > 2000 then {_strip("pending")}
         when kind = 'S' and pending <> '' then {_strip("pending")}
         when kind = 'L' and tail <> '' and length(tail) + length(x) + 1 > 2000 then {_strip("tail")}
         when kind = 'E' and pending = '' and {_strip("tail")} <> '' then {_strip("tail")}
         when kind = 'F' and {_strip("pending")} <> '' then {_strip("pending")} end
  from fold f join seq s on s.key = f.key and s.n = f.n + 1),
chunks as (
  select key, 0::bigint as chunk_no, text as chunk, 1::bigint as total from t where length(text) <= 2000
  union all select key, row_number() over (partition by key order by n) - 1, chunk, count(*) over (partition by key) from fold where chunk is not null),
few as (select key, row_number() over (partition by key order by chunk_no) - 1 as chunk_no, chunk from chunks where total <= 8 or chunk_no < 4 or chunk_no >= total - 4)
"""

SQL = {
    "item_extract": _ITEMS + "select source, day::varchar as day, section, text, category, text_key from items",
    "noise_filter": _NOTES + f"select source, count(*) as n_lines, count(*) filter (length(s) < 15 or regexp_matches(s, {_NOISE})) as n_noise from lines where not secret group by source",
    "category_detect": f"select id, {_category('content')} as detected from {_ONE}",
    "category_hist": _DEDUP + "select category, count(*) as n from kept group by category",
    "text_key_norm": _ITEMS + "select text_key, count(*) as n from items group by text_key",
    "cluster_key_norm": _ADVISOR + "select key as cluster_key, count(*) as n from keyed group by key",
    "entity_extract": _ITEMS + "select source, text, array_to_string(entities, '|') as entities from items",
    "decay_score": f"select id, round(pow(0.5::double, greatest(datediff('day', (created_at at time zone 'UTC')::date, {_DAY}), 0) / 14.0::double), 6) as decay from {_ONE}",
    "freq_boost": _DEDUP + "select text_key, frequency, round(case when frequency > 1 then 1 + ln(frequency::double) * (1.3::double - 1.0::double) else 1 end, 6) as boost from kept",
    "item_score": _SCORED + "select text_key, source, day::varchar as day, category, frequency, score from scored",
    "dedup_keep_first": _DEDUP + "select text_key, source, day::varchar as day, section, text from kept",
    "score_topk": _SCORED + f"select {_PUBLIC} from (select * from scored order by score desc, text_key limit 50)",
    "score_stats": _SCORED + """select count(*) as total_items, count(*) filter (score >= 2.0 and source <> 'MEMORY.md') as promotions, count(*) filter (score < 0.05) as archive_candidates,
  round(coalesce(avg(score), 0), 4) as avg_score, round(coalesce(max(score), 0), 4) as max_score_seen, count(*) as delta_from_previous from scored""",
    "promotions": _SCORED + f"select {_PUBLIC} from (select * from scored where score >= 2.0 and source <> 'MEMORY.md' order by score desc, text_key limit 20)",
    "archive_candidates": _SCORED + "select substr(sha256(text), 1, 16) as hash, score, source, day::varchar as date from scored where score < 0.05",
    "archive_sources": _SCORED + "select source, count(*) as n from scored where score < 0.05 and source <> 'MEMORY.md' group by source",
    "item_hash": f"select id, substr(sha256(content), 1, 16) as hash from {_ONE}",
    "clusters": _ADVISOR + "select * from clusters",
    "top_clusters": _ADVISOR + """select c.key, c.date_count, substr(c.sample_text, 1, 80) as summary from clusters c
join (select key, min((source, i)) as first from keyed group by key) f using (key) order by c.date_count desc, f.first limit 10""",
    "advisor_stats": _ADVISOR + f"select count(*) as n_lines, count(distinct source) as n_files, count(distinct day) as n_days from adv where day > {_DAY} - 90",
    "duplicates": _ADVISOR + "select text, source1, source2, date1, date2 from dups",
    "advisor_promotions": _PROMOTED + "select text, score, category, source, day::varchar as day, frequency from promoted",
    "stale": _SCORED + "select text, score, category from scored where source = 'MEMORY.md' and score < 2.0",
    "top_duplicates": _ADVISOR + "select text, source1, source2, date1, date2 from (select * from dups order by source2, i limit 10)",
    "recommendations": _PROMOTED + """,
n as (select (select count(*) from cl) as c, (select count(*) from promoted) as p, (select count(*) from scored where source = 'MEMORY.md' and score < 0.15) as s, (select count(*) from du) as d),
r as (select unnest(list_filter([case when c >= 3 then 'merge_clusters' end, case when p >= 5 then 'promote_items' end, case when s >= 3 then 'trim_stale' end,
                                 case when d >= 2 then 'consolidate_duplicates' end], lambda x: x is not null)) as recommendation from n)
select recommendation from r union all select 'healthy' where not exists (select 1 from r)""",
    "pii_redact": f"select id, {_redact('content')} as redacted from {_ONE}",
    "pii_counts": "\nunion all\n".join(f"select '{k}' as kind, sum(len(regexp_extract_all(content, {_q(p)})))::bigint as n from {_ONE}" for k, p in SECRETS),
    "promotion_apply_plan": _PROMOTED + "select text, source, score from promoted p where not exists (select 1 from memory m where contains(lower(m.content), lower(substr(p.text, 1, 50))))",
    "ontology_replay": _GRAPH + "select id, attr, val from attrs where attr <> 'id' and val is not null",
    "ontology_entities": _GRAPH + "select id, type from entities",
    "ontology_types": _GRAPH + "select type, count(*) as n from entities group by type order by n desc, type limit 10",
    "ontology_orphans": _GRAPH + "select * from early",
    "ontology_totals": _GRAPH + """select (select count(*) from made) as total_entities, (select count(*) from g where relation is not null and op in ('relate', 'create', 'upsert')) as total_relations,
  (select count(*) from g where op in ('create', 'upsert')) as create_lines, (select count(*) from early) as orphan_relations""",
    "ontology_dedup": _GRAPH + """select line_no from (select line_no, nullif(json_extract_string(entity, '$.id'), '') as eid from g)
  qualify eid is null or row_number() over (partition by eid order by line_no) = 1""",
    "section_sizes": f"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents where text is not null),
h as (select *, sum(case when line like '## %' then 1 else 0 end) over (partition by doc_id order by i) as k from l),
p as (select doc_id, k, sum(length(line) + 1) as size, arg_min(line, i) as first from h group by doc_id, k),
s as (select doc_id, case when first like '## %' then {_strip("first")} else 'Header' end as section, k, size from p),
d as (select doc_id, section, arg_max(size, k)::bigint as size_chars from s group by doc_id, section)
select * from d qualify row_number() over (partition by doc_id order by size_chars desc, section) <= 5""",
    "size_check": "select doc_id, length(text) as size_chars, round(length(text) / 1024.0::double, 1) as size_kb, length(text) - length(replace(text, chr(10), '')) as lines, length(text) > 5000 as over_limit from documents where text is not null",
    "note_hygiene": _NOTES + f"""select count(*) as total_notes, count(*) filter (datediff('day', day, {_DAY}) > 14) as stale_notes, max(day)::varchar as newest, min(day)::varchar as oldest,
  min(datediff('day', day, {_DAY})) as newest_age, max(datediff('day', day, {_DAY})) as oldest_age from dated""",
    "stale_notes": _NOTES + f"""select file_name as source, day::varchar as day, datediff('day', day, {_DAY}) as age_days from dated where datediff('day', day, {_DAY}) > 14 order by day, file_name limit 5""",
    "flat_archive_plan": _NOTES + f"""select distinct substr(file_name, 1, 10) || '.md' as source, 'archive/' || substr(file_name, 1, 10) || '.md' as destination
from dated where datediff('day', day, {_DAY}) > 14""",
    "aging_contexts": "with memory as (select id, max(content) as content from memories where source = 'MEMORY.md' group by id)\n" + "\nunion all\n".join(
        f"""select id as key, '{t}' as type, {_strip("substr(content, greatest(s - 40, 0) + 1, s + n + 40 - greatest(s - 40, 0))")} as context from (
  select id, content, length(f[k]) as n, coalesce(list_sum(list_transform(b[1:k], lambda x: length(x))), 0)::bigint + coalesce(list_sum(list_transform(f[1:k - 1], lambda x: length(x))), 0)::bigint as s from (
    select id, content, f, b, unnest(range(1, len(f) + 1)) as k from (
      select id, content, regexp_extract_all(content, {_q('(?i)' + p)}) as f, string_split_regex(content, {_q('(?i)(?:' + p.replace('(', '(?:').replace('(?:?:', '(?:') + ')')}) as b from memory)))"""
        for t, p, _ in AGING
    ),
    "memory_sections": f"""
  with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents where text is not null),
  h as (select *, sum(case when line like '## %' then 1 else 0 end) over (partition by doc_id order by i) as k from l),
  p as (select doc_id, k, arg_min(line, i) as first, list(line order by i) as lines from h group by doc_id, k),
  z as (select doc_id, k, case when k > 0 then {_strip("first")} else 'Header' end as section, case when k > 0 then lines[2:] else lines end as lines from p
        union all select doc_id, 0, 'Header', [] from l where i = 0 and line like '## %'),
  s as (select doc_id, section, arg_max(lines, k) as lines from z group by doc_id, section)
  select doc_id, section, len(lines) as n_lines, md5(array_to_string(lines, chr(10))) as digest from s""",
    "archive_plan": _NOTES + f"""select file_name as source, strftime(mtime at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as mtime, 'archive/' || strftime(day, '%Y-%m') || '/' || file_name as destination
from dated where mtime at time zone 'UTC' < {_DAY}::timestamp - interval 21 day order by dated.mtime, file_name""",
    "stale_facts": "\nunion all\n".join(
        f"select '{t}' as type, {str(r).lower()} as reported, coalesce(sum(len(regexp_extract_all(content, {_q('(?i)' + p)}))), 0)::bigint as n from (select max(content) as content from memories where source = 'MEMORY.md' group by id)" for t, p, r in AGING
    ),
    "drift": _RUNS + """select day::varchar as day, datediff('day', lag(day) over w, day) as days, size_bytes - lag(size_bytes) over w as size_bytes_change,
  total_entities - lag(total_entities) over w as total_entities_change, note_count - lag(note_count) over w as note_count_change from runs window w as (order by day)""",
    "drift_now": _GRAPH + "," + _NOW + "select * from now_",
    "health_report": _GRAPH + "," + _NOW + "," + _NOTES.strip().removeprefix("with") + f""",
  tot as (select (select count(*) from made) as total_entities, (select count(*) from g where relation is not null and op in ('relate', 'create', 'upsert')) as total_relations,
    (select count(*) from g where op in ('create', 'upsert')) as create_lines, (select count(*) from early) as orphan_relations),
  ages as (select count(*) as total_notes, count(*) filter (datediff('day', day, {_DAY}) > 14) as stale_notes, max(day)::varchar as newest, min(day)::varchar as oldest,
    min(datediff('day', day, {_DAY})) as newest_age, max(datediff('day', day, {_DAY})) as oldest_age from dated),
  sizes as (select coalesce(sum(length(content)), 0)::bigint as size_chars,
    coalesce(sum({" + ".join(f"len(regexp_extract_all(content, {_q('(?i)' + p)}))" for _, p, r in AGING if r)}), 0)::bigint as stale_facts from memory)
  select sizes.*, tot.*, ages.*, now_.*, case when size_chars > 5000 then 'warning' else 'ok' end as memory_status, case when orphan_relations > 0 then 'warning' else 'ok' end as ontology_status,
    case when stale_notes > 0 then 'warning' else 'ok' end as notes_status, case when stale_facts > 0 then 'warning' else 'ok' end as decay_status from sizes, tot, ages, now_""",
    "trend_series": _RUNS + """,
s as (select 'size_bytes' as metric, day, size_bytes::double as y from runs union all select 'total_entities', day, total_entities::double from runs
      union all select 'benchmark_score', day, try_cast(benchmark_score as double) from runs)
select metric, day::varchar as day, row_number() over (partition by metric order by day) - 1 as x, y, round(y / nullif(max(y) over (partition by metric), 0), 6) as y_share from s where y is not null""",
    "jsonl_contents": f"""select coalesce(json_extract_string(entity, '$.name'), '') || ' (' || coalesce(json_extract_string(entity, '$.type'), '') || ')' as content, count(*) as n
from graph where {_strip("entity")} <> '' and json_valid(entity) group by all""",
    "chunk_docs": _CHUNKS + "select key as doc_id, chunk_no::integer as chunk_no, chunk from chunks where trim(chunk, ' ') <> ''",
    "chunk_cap": _CHUNKS + "select key as doc_id, chunk_no::integer as chunk_no, chunk from few where trim(chunk, ' ') <> ''",
    "round_exact": f"select id, (floor(v) + case when r > 0.5 or (r = 0.5 and floor(v)::bigint % 2 = 1) then 1 else 0 end) / 10000 as rounded from (select id, v, v - floor(v) as r from (select id, round(score * 32) / 32 * 10000 as v from {_ONE} where score is not null))",
    "corpus_classes": r"""
select file_name, k.category as category, k.layer as layer, k.source as source, k.score as score from (
  select regexp_extract(p, '[^/]*$') as file_name, case
    when regexp_matches(p, '^memory/\d{4}-[^/]*\.md$') then {'category': 'daily-note', 'layer': 'episodic', 'source': regexp_extract(p, '[^/]*$'), 'score': 0.3::double}
    when regexp_matches(p, '^(memory/)?archive/[^/]+\.md$') then {'category': 'archive', 'layer': 'episodic', 'source': 'archive/' || regexp_extract(p, '[^/]*$'), 'score': 0.1::double}
    when regexp_matches(p, '^skills/[^/]+/SKILL\.md$') then {'category': 'skill', 'layer': 'procedural', 'source': p, 'score': 0.8::double}
    when regexp_matches(p, '^memory/[^/]+\.md$') then {'category': case when len(string_split(b, '-')) > 2 then string_split(b, '-')[1] || '-' || string_split(b, '-')[2] else b end, 'layer': 'semantic', 'source': regexp_extract(p, '[^/]*$'), 'score': 0.7::double}
    when p = 'MEMORY.md' then {'category': 'long-term-memory', 'layer': 'procedural', 'source': p, 'score': 0.9::double}
    when p = 'TOOLS.md' then {'category': 'config', 'layer': 'procedural', 'source': p, 'score': 0.7::double}
    when regexp_matches(p, '^(memory/)?ontology/graph\.jsonl$') then {'category': 'ontology', 'layer': 'semantic', 'source': 'ontology/graph.jsonl', 'score': 0.6::double} end as k
  from (select distinct source as p, replace(regexp_extract(source, '[^/]*$'), '.md', '') as b from documents where source is not null)) where k is not null""",
    "lexical_search": _L2 + "select id, source, round(bm25, 6) as bm25, lex_rank from lexical",
    "lexical_tried": _tried(),
    "vector_l2": _L2 + "select id, source, round(distance, 5) as distance, vec_rank from vector",
    "vector_cosine": _COS + "select id, source, round(distance, 5) as distance, vec_rank from vector",
    "hybrid_rrf": _L2 + "select id, source, lex_rank, vec_rank, round(rrf, 6) as rrf from floored",
    "hybrid_boosted": _L2 + "select id, round(rrf, 6) as rrf, round(boosted, 6) as boosted from boosted",
    "hybrid_dedup": _L2 + "select id, source, lex_rank, vec_rank, round(rrf, 6) as rrf, round(boosted, 6) as boosted from (select * from best order by rrf desc, id limit 10)",
    "hybrid_results": _L2.replace("<= 40", "<= 20") + """select b.id, b.source, round(rrf, 6) as rrf, substr(content, 1, 300) as content, category, layer
from (select * from best order by rrf desc, id limit 5) b join one using (id)""",
    "store_stats": f"""select count(*) as memories, count(distinct source) as sources, strftime(max(created_at) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as latest,
  (select count(distinct id) from memories_vec where id is not null and embedding is not null) as vectors from {_ONE}""",
    "category_breakdown": f"select lower(category) as category, count(*) as n from {_ONE} group by lower(category)",
    "layer_breakdown": f"select lower(layer) as layer, count(*) as n from {_ONE} group by lower(layer)",
}

_classes = SQL["corpus_classes"].replace("select distinct source as p", "select doc_id, source as p").replace("select file_name, k.category as category", "select doc_id, file_name, k.category as category").replace(
    "select regexp_extract(p, '[^/]*$') as file_name", "select doc_id, regexp_extract(p, '[^/]*$') as file_name")
SQL["index_documents"] = _CHUNKS + f"""
select c.source, c.category, c.layer, c.score, count(*) as n_chunks from few join ({_classes}) c on few.key = c.doc_id where trim(chunk, ' ') <> '' group by all"""
SQL["scores_report"] = _SCORED + """,
r as (select *, substr(sha256(text), 1, 16) as hash, day::varchar as date, row_number() over (order by score desc, text_key) as nth from scored),
l as (select 'top_items' as list, * from r union all select 'promoted', * from r where score >= 2.0 and source <> 'MEMORY.md' union all select 'archive', * from r where score < 0.05)
select list, place::integer as place, hash, score, source, date from (select *, row_number() over (partition by list order by nth) - 1 as place from l) where place < case list when 'top_items' then 50 else 20 end
union all select 'category', 0, category, count(*)::double, null, null from scored group by category"""
SQL["consolidation_report"] = _PROMOTED + """,
n as (select (select count(*) from cl) as c, (select count(*) from promoted) as p, (select least(count(*), 10) from scored where source = 'MEMORY.md' and score < 0.15) as s, (select least(count(*), 10) from du) as d),
top as (select c.key, c.date_count, substr(c.sample_text, 1, 80) as summary, f.first from cl c join (select key, min((source, i)) as first from keyed group by key) f using (key) order by c.date_count desc, f.first limit 10),
d as (select text from du order by source2, i limit 10)
select (select count(*) from adv) as notes_analyzed, (select count(distinct source) from adv) as files_analyzed, c as clusters_found, p as promotions_found, s as stale_items_found, d as duplicates_found,
  (select string_agg(summary, '|' order by date_count desc, first) from top) as clusters, (select string_agg(text, '|' order by text) from promoted) as promotions, (select string_agg(text, '|' order by text) from d) as duplicates,
  coalesce(nullif(concat_ws('|', case when c >= 3 then 'merge_clusters' end, case when p >= 5 then 'promote_items' end, case when s >= 3 then 'trim_stale' end, case when d >= 2 then 'consolidate_duplicates' end), ''), 'healthy') as recommendations from n"""

# the advisor's tables beside the scores, under other names
_both = _ADVISOR[_ADVISOR.index("adv as (") :].replace("clusters as (", "cl as (").replace("dups as (", "du as (")
for _name in ("recommendations", "consolidation_report"):
    SQL[_name] = SQL[_name].replace(",\nn as (", f",\n{_both},\nn as (", 1)
SQL["pipeline_status"] = _SCORED + f""",
{_both},
n as (select (select count(*) from scored) as items, (select count(*) from cl) as clusters)
select items, clusters, case when items > 0 and clusters > 0 then 'active' when items > 0 then 'partial' else 'not_initialized' end as status from n"""
