"""Queries of the core operators and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, heavy, references
from ..session import table

Query = Callable[[SparkSession, str], DataFrame]
RUN_FIELDS = {"version": "version", "cores": "cores", "name": "results.name", "files": "results.files", "module_name": "module_name", "row_count": "row_count"}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "history_line"))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    long = drift.records(table(spark, d, "history_line"))
    return long.withColumn("integer_value", F.col("integer_value").try_cast("bigint"))


def p1_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return drift.alternatives(drift.records(table(spark, d, "history_line")))


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    long = drift.records(table(spark, d, "history_line"))
    return drift.wide(long, drift.elected(long, RUN_FIELDS))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.orphans(*(table(spark, d, t) for t in ("extension_row", "dependency_edge", "removed_release")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src_table", "src_id", "ref_no")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return references.report(_orphans(spark, d)).select("src_table", "month", "orphans")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy.heavy_keys(table(spark, d, "manifest"))


def p4_keys(spark: SparkSession, d: str) -> DataFrame:
    return heavy.key_results(table(spark, d, "manifest"), table(spark, d, "chunk_index"))


#: Leaves of all counted lines, as (line, series, file_seq, line_no, line_id, entry, field, tag, text), and the changes between files.
LEAVES = r"""
with recursive ranked as (select series, file_seq, line_no, line_id, raw, row_number() over (partition by series, file_seq, line_no, case when line_no is null then line_id end order by line_id) as nth
    from history_line where series is not null and file_seq is not null and raw is not null),
  lines as (select *, row_number() over () as line from ranked where nth = 1 and json_valid(raw) and json_type(raw) = 'OBJECT'),
  tree as (select line, series, file_seq, line_no, line_id, j.id, j.parent, j.type, j.value, j.fullkey,
      j.type = 'ARRAY' and not contains(regexp_replace(j.value::varchar, '"(\\.|[^"\\])*"', '', 'g'), '{') as plain
    from lines, json_tree(lines.raw) j),
  every as (select t.line, t.series, t.file_seq, t.line_no, t.line_id, array_to_string(regexp_extract_all(t.fullkey, '\[(\d+)\]', 1), '.') as entry,
      replace(regexp_replace(t.fullkey, '\[\d+\]', '', 'g')[3:], '"', '') as field,
      case when t.type = 'VARCHAR' then 'string' when t.type in ('BOOLEAN', 'ARRAY', 'NULL', 'OBJECT') then lower(t.type) when t.type in ('DOUBLE') then 'number' else 'integer' end as tag,
      case when t.type in ('NULL', 'OBJECT') then null else t.value ->> '$' end as text
    from tree t left join tree p on p.line = t.line and p.id = t.parent
    where t.fullkey <> '$' and (t.type <> 'ARRAY' or t.plain) and not coalesce(p.plain, false)),
  leaf as (select * replace (case tag when 'integer' then 'number' when 'null' then null else tag end as tag) from every where tag <> 'object'),
  counted as (select series, file_seq, field, tag, count(tag) as n from leaf group by all),
  typed as (select series, file_seq, field, min_by(tag, (-n, tag)) filter (where tag is not null) as type from counted group by all),
  steps as (select series, file_seq, lag(file_seq) over (partition by series order by file_seq) as prev from (select distinct series, file_seq from typed)),
  was as (select s.series, s.file_seq, t.field, t.type from steps s join typed t on t.series = s.series and t.file_seq = s.prev),
  now as (select s.series, s.file_seq, t.field, t.type from steps s join typed t using (series, file_seq) where s.prev is not null),
  gone as (select * from was anti join now using (series, file_seq, field)),
  came as (select * from now anti join was using (series, file_seq, field)),
  old_text as (select distinct s.series, s.file_seq, l.field, l.text from steps s join leaf l on l.series = s.series and l.file_seq = s.prev where l.text is not null),
  new_text as (select distinct series, file_seq, field, text from leaf where text is not null),
  renamed as (select distinct g.series, g.file_seq, g.field as old_field, c.field as new_field, g.type as old_type, c.type as new_type
    from gone g join came c using (series, file_seq) join old_text o on o.series = g.series and o.file_seq = g.file_seq and o.field = g.field
    join new_text n on n.series = c.series and n.file_seq = c.file_seq and n.field = c.field and n.text = o.text)"""

CHANGES = LEAVES + """
select series, file_seq, 'renamed' as change, old_field, new_field from renamed
union all select series, file_seq, 'retyped', old_field, new_field from renamed where old_type <> new_type
union all select series, file_seq, 'removed', field, '' from gone anti join (select series, file_seq, old_field as field from renamed) using (series, file_seq, field)
union all select series, file_seq, 'added', '', field from came anti join (select series, file_seq, new_field as field from renamed) using (series, file_seq, field)
union all select series, file_seq, 'retyped', field, field from was join now using (series, file_seq, field) where was.type <> now.type"""

#: Each leaf under the name that most files of those connected by renames have, and its value as that field's prevailing type.
RECORDS = LEAVES + r""",
  links as (select old_field as a, new_field as b from renamed union select new_field, old_field from renamed),
  weight as (select field, count(*) as files from (select distinct series, file_seq, field from every) group by all),
  reach as (select field as a, field as b from weight union select reach.a, links.b from reach join links on links.a = reach.b),
  names as (select a as field, min_by(b, (-files, b)) as canonical from reach join weight on weight.field = reach.b group by all),
  kinds as (select canonical, max_by(tag, (n, tag)) as kind from (select canonical, tag, count(*) as n from every join names using (field) where tag not in ('null', 'object') group by all) group by all),
  records as (select series, file_seq, line_no::bigint as line_no, line_id, entry, canonical as field, field as source_field, tag, case when tag = 'string' then text end as string_value,
      case when tag = 'integer' then try_cast(text as bigint) end as integer_value, case when tag = 'number' then text::double end as number_value, case when tag = 'boolean' then text::boolean end as boolean_value,
      case when tag = 'array' then text end as array_value, kind as canonical_type,
      case when kind = 'integer' then case when regexp_matches(text, '^\s*-?\d+\s*$') then trim(text) end
        when kind = 'number' then case when regexp_matches(text, '^\s*-?\d+(\.\d+)?([eE][-+]?\d+)?\s*$') then trim(text) end
        when kind = 'boolean' then case when lower(text) in ('true', 'false') then lower(text) end
        when kind = 'array' and tag <> 'array' then to_json([text])::varchar else text end as canonical_value
    from every join names using (field) left join kinds using (canonical))"""

RUNS = RECORDS + f""",
  fields as (select c, coalesce(canonical, f) as field from (values {", ".join(f"('{c}', '{f}')" for c, f in RUN_FIELDS.items())}) v(c, f) left join names on names.field = v.f),
  cells as (select series, file_seq, line_no, line_id, entry, c, min(canonical_value) as v from records join fields using (field) group by all),
  places as (select distinct series, file_seq, line_no, line_id, entry from cells),
  ends as (select * from places p where not exists (select 1 from places q where q.line_id = p.line_id and q.entry <> p.entry and (p.entry = '' or starts_with(q.entry, p.entry || '.'))))
select e.series, e.file_seq, e.line_no, e.line_id, e.entry, {", ".join(f"max_by(v, length(k.entry)) filter (where c = '{c}' and v is not null) as {c}" for c in RUN_FIELDS)}
from ends e join cells k on k.line_id = e.line_id and (k.entry = '' or k.entry = e.entry or starts_with(e.entry, k.entry || '.')) group by all"""

ALIVE = r"""
with removals as (select regexp_replace(lower(name), '[-_.]+', '-', 'g') as name, version, removed_at from removed_release),
uploads as (select regexp_replace(lower(name), '[-_.]+', '-', 'g') as name, version, extracted_at as at from extension_row where name is not null),
alive as (select u.name, u.version, u.at as since, coalesce(min(r.removed_at), timestamptz '9999-12-31 00:00:00+00') as until
  from uploads u left join removals r on r.name = u.name and (r.version is null or r.version = u.version) and r.removed_at >= u.at
  group by u.name, u.version, u.at),
entries as (select ext_id, extracted_at, i - 1 as ref_no, trim(split_part(requires_dist[i], ';', 1)) as spec
  from (select ext_id, extracted_at, requires_dist, unnest(range(1, len(requires_dist) + 1)) as i from extension_row)),
named as (select *, regexp_extract(spec, '^\s*([A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?)', 1) as raw_name from entries),
pinned as (select ext_id, extracted_at, ref_no, regexp_replace(lower(raw_name), '[-_.]+', '-', 'g') as name,
  case when contains(spec, '@') then [] else list_distinct(regexp_extract_all(regexp_replace(spec, '[\s()]', '', 'g') || ',', '[^=!<>~]={2,3}([^=*,]+),', 1)) end as pins
  from named where raw_name <> ''),
refs as (select 'extension_row' as src_table, ext_id as src_id, ref_no, name, case when len(pins) = 1 then pins[1] end as version, extracted_at as at from pinned
  union all
  select 'dependency_edge', edge_id, n, regexp_replace(lower(trim(split_part(coord, ':', 2))), '[-_.]+', '-', 'g'),
    case when split_part(coord, ':', 3) <> '' and split_part(coord, ':', 3) not like '%${%' then split_part(coord, ':', 3) end, resolved_at
  from (select edge_id, resolved_at, 0 as n, parent as coord from dependency_edge union all select edge_id, resolved_at, 1, child from dependency_edge) where coord is not null),
orphans as (select * from refs r where not exists (
  select 1 from alive a where a.name = r.name and (r.version is null or a.version = r.version) and a.since <= r.at and r.at < a.until))
"""

ENTRIES = "select batch_no, coalesce(pkg_type, 0)::int as pkg_type, coalesce(repo, '') as repo, part_no, max(row_count) as row_count from manifest group by all"


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_records, p1_alternatives, p1_runs, p3_found, p3_report, p4_found, p4_keys)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": CHANGES,
        "p1_records": RECORDS + " select * from records",
        "p1_alternatives": RECORDS + ' select field, tag, series, min(file_seq) as first_file, count(*) as "values" from records group by all',
        "p1_runs": RUNS,
        "p3_found": ALIVE + "select src_table, src_id, cast(ref_no as int) as ref_no from orphans",
        "p3_report": ALIVE + "select src_table, strftime(orphans.at at time zone 'UTC', '%Y-%m') as month, count(*) as orphans from orphans group by all",
        "p4_found": f"with e as ({ENTRIES}), k as (select pkg_type, repo, sum(row_count) as n from e group by all) select pkg_type, repo from k where n * 25 >= (select sum(n) from k)",
        "p4_keys": f"""
with e as ({ENTRIES}),
c as (select coalesce(pkg_type, 0)::int as pkg_type, coalesce(repo, '') as repo, batch_no, file_index, chunk_seq, max(uncompressed_size) as size from chunk_index group by all),
parts as (select pkg_type, repo, count(*) as parts, sum(row_count)::bigint as listed_rows from e group by all),
ranked as (select pkg_type, repo, size, row_number() over (partition by pkg_type, repo order by size) as r, count(*) over (partition by pkg_type, repo) as n from c),
sizes as (select pkg_type, repo, count(*) as "rows", sum(size)::bigint as bytes,
  max(case when r = ceil(0.5 * n) then size end) as p50, max(case when r = ceil(0.9 * n) then size end) as p90, max(case when r = ceil(0.99 * n) then size end) as p99 from ranked group by all),
files as (select pkg_type, repo, count(distinct (batch_no, file_index)) as files from c group by all)
select pkg_type, repo, coalesce(parts, 0) as parts, coalesce(listed_rows, 0) as listed_rows, coalesce("rows", 0) as "rows", coalesce(bytes, 0) as bytes, coalesce(files, 0) as files,
  p50, p90, p99, coalesce(listed_rows, 0) * 25 >= (select sum(listed_rows) from parts) as is_heavy
from parts full join sizes using (pkg_type, repo) left join files using (pkg_type, repo)""",
    }
