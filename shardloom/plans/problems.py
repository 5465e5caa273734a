"""Queries p1, p2 and p4 of TESTDATA.md, with the SQL they are compared to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import table
from ..operators import hierarchy, nested, orphans


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.unrooted(table(spark, d, "shard_meta"))


def p1_merged(spark: SparkSession, d: str) -> DataFrame:
    """All records by blocks of 16, so that most runs are put together from several forests; compared to the same rule as the others."""
    full = hierarchy.build(table(spark, d, "shard_meta"), block_rows=16)
    return full.select("run_id", "shard_id", "kind", "head_id", "steps", (F.col("below") - 1).alias("n_descendants"))


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, d, "shard_meta")).withColumn("path", F.array_join("path", "\n"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(table(spark, d, "shard_meta")).withColumn("distance", F.col("distance").cast("bigint"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.array_objects(table(spark, d, "file_shard"))


def p2_flat(spark: SparkSession, d: str) -> DataFrame:
    """All objects of all texts; members as a JSON object of their JSON texts, escapes in strings folded."""
    flat = nested.flat_objects(table(spark, d, "file_shard"), table(spark, d, "shard_meta"))
    fields = F.to_json(F.transform_values("fields", lambda k, v: F.when(v.startswith('"') & v.contains("\\"), F.to_json(F.try_parse_json(v))).otherwise(v)))
    return flat.withColumns({"fields": fields, "original_path": F.to_json("original_path")})


def _state(spark: SparkSession, d: str, step: int = 6) -> tuple[orphans.OrphanState, list[str]]:
    """Pending-orphan state after all months of the four tables, a batch for each half-year (or as many months as asked for)."""
    refs = orphans.shard_references(table(spark, d, "shard_meta"), table(spark, d, "doc_meta"))
    return orphans.replay(refs, table(spark, d, "file_shard"), table(spark, d, "shard_removal"), step)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d)[0].orphans()


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d)[0].snapshot()


def p4_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Counts by state after each quarter's batch, from the differences that the batches left."""
    state, months = _state(spark, d, 3)
    names = F.array(*(F.lit(m) for m in months))
    rows = state.deltas().groupBy("batch", "src_table", "state").agg(F.sum("n").alias("n"))
    later = rows.withColumn("batch", F.explode(F.sequence("batch", F.lit(len(months)))))
    return later.groupBy(F.get(names, F.col("batch") - 1).alias("month"), "src_table", "state").agg(F.sum("n").alias("n")).where("n <> 0")


_UP = """
with recursive rec as (select run_id, shard_id, min(nullif(parent_id, '')) as own from shard_meta group by all),
held as (select run_id, c as shard_id, min(shard_id) as holder from (select run_id, shard_id, unnest(child_ids) as c from shard_meta) where c <> '' group by all),
up as (select r.run_id, r.shard_id, coalesce(r.own, h.holder) as p from rec r left join held h using (run_id, shard_id)),
n as (select run_id, count(*) as n from rec group by 1),
walk as (
  select run_id, shard_id, shard_id as cur, 0 as steps, [shard_id] as line from up
  union all
  select w.run_id, w.shard_id, u.p, w.steps + 1, list_append(w.line, u.p)
  from walk w join up u on u.run_id = w.run_id and u.shard_id = w.cur join rec r on r.run_id = u.run_id and r.shard_id = u.p
  where not list_contains(w.line[:-2], w.cur)
),
ends as (
  select w.run_id, w.shard_id, w.cur, w.steps, w.line, u.p from walk w join up u on u.run_id = w.run_id and u.shard_id = w.cur
  left join rec r on r.run_id = u.run_id and r.shard_id = u.p
  where r.shard_id is null or list_contains(w.line[:-2], w.cur)
)"""

_STATES = """
with st as (select run_id, shard_id as ref_id, min(written_at) as fw, max(written_at) as lw from file_shard group by all),
rm as (select run_id, shard_id as ref_id, max(removed_at) as lr from shard_removal group by all),
refs as (
  select 'shard_meta' as src_table, run_id, shard_id, 'parent_id' as ref_field, parent_id as ref_id, recorded_at from shard_meta
  union select 'shard_meta', run_id, shard_id, 'next_shard', next_shard, recorded_at from shard_meta
  union select 'shard_meta', run_id, shard_id, 'previous_shard', previous_shard, recorded_at from shard_meta
  union select 'doc_meta', run_id, root_shard, 'root_shard', root_shard, created_at from doc_meta
),
judged as (
  select distinct src_table, r.run_id, shard_id, ref_field, r.ref_id, recorded_at,
    case when st.ref_id is null then 'missing' when lr > lw then 'removed' when fw > recorded_at then 'late' else 'held' end as state, strftime(recorded_at, '%Y-%m') as period
  from refs r left join st using (run_id, ref_id) left join rm using (run_id, ref_id) where r.ref_id <> ''
)"""

QUERIES = {f.__name__: f for f in (p1_found, p1_merged, p1_hierarchy, p1_descendants, p2_found, p2_flat, p4_found, p4_counts, p4_snapshots)}

SQL = {
    "p1_found": _UP
    + """
select run_id, shard_id, case when p is null then '' when list_contains(line[:-2], cur) then if(list_position(line, cur) = 1, 'cycle', 'under_cycle') else 'detached' end as kind,
  case when list_contains(line[:-2], cur) then list_min(line[list_position(line, cur):]) else cur end as head_id,
  cast(case when list_contains(line[:-2], cur) then list_position(line, cur) - 1 else steps end as int) as steps
from ends where p is not null""",
    "p1_merged": _UP
    + """,
below as (select run_id, shard_id, count(*) as n from (select run_id, unnest(line[2:]) as shard_id from ends where p is null) group by all)
select e.run_id, e.shard_id, case when p is null then 'rooted' when list_contains(line[:-2], cur) then if(list_position(line, cur) = 1, 'cycle', 'under_cycle') else 'detached' end as kind,
  case when list_contains(line[:-2], cur) then list_min(line[list_position(line, cur):]) else cur end as head_id,
  cast(case when list_contains(line[:-2], cur) then list_position(line, cur) - 1 else steps end as int) as steps, if(p is null, coalesce(b.n, 0), null) as n_descendants
from ends e left join below b on b.run_id = e.run_id and b.shard_id = e.shard_id""",
    "p1_hierarchy": _UP
    + """,
below as (select run_id, shard_id, count(*) as n from (select run_id, unnest(line[2:]) as shard_id from ends where p is null) group by all)
select e.run_id, e.shard_id, u.p as parent_id,
  case when e.p is null then 'rooted' when list_contains(line[:-2], cur) then if(list_position(line, cur) = 1, 'cycle', 'under_cycle') else 'detached' end as state,
  if(e.p is null, cur, null) as root_id, cast(if(e.p is null, steps, null) as int) as depth, if(e.p is null, array_to_string(list_reverse(line), chr(10)), null) as path,
  if(e.p is null, coalesce(b.n, 0), null) as n_descendants
from ends e join up u on u.run_id = e.run_id and u.shard_id = e.shard_id left join below b on b.run_id = e.run_id and b.shard_id = e.shard_id""",
    "p1_descendants": _UP
    + """
select run_id, a as shard_id, shard_id as descendant_id, cast(i as bigint) as distance
from (select run_id, shard_id, unnest(line[2:]) as a, generate_subscripts(line[2:], 1) as i from ends where p is null)""",
    "p2_found": """
with recursive docs as (select distinct run_id, shard_id, if(json_type(data) = 'VARCHAR', json_extract_string(data, '$'), data) as j from file_shard where json_valid(data)),
ok as materialized (select * from docs where json_valid(j) and json_type(j) in ('OBJECT', 'ARRAY') and not regexp_matches(regexp_replace(j, '"([^"\\\\]|\\\\.)*"', '', 'gs'), '(?i)nan|inf')),
t as materialized (select run_id, shard_id, x.id, x.parent, x.key, x.type from ok, json_tree(ok.j) x),
n as (
  select run_id, shard_id, id, type, '' as ptr, '' as near, false as hit from t where parent is null
  union all
  select t.run_id, t.shard_id, t.id, t.type, n.ptr || '/' || replace(replace(t.key, '~', '~0'), '/', '~1'), if(n.hit, n.ptr, n.near), n.type = 'ARRAY' and t.type = 'OBJECT'
  from t join n on t.run_id = n.run_id and t.shard_id = n.shard_id and t.parent = n.id
)
select distinct run_id, shard_id, near as parent_ptr, ptr as child_ptr from n where hit""",
    "p2_flat": """
with recursive docs as (select distinct run_id, shard_id, if(json_type(data) = 'VARCHAR', json_extract_string(data, '$'), data) as j from file_shard where json_valid(data)),
ok as materialized (select * from docs where json_valid(j) and json_type(j) in ('OBJECT', 'ARRAY') and not regexp_matches(regexp_replace(j, '"([^"\\\\]|\\\\.)*"', '', 'gs'), '(?i)nan|inf')),
t as materialized (select run_id, shard_id, x.id, x.parent, x.key, x.type, x.value::varchar as value from ok, json_tree(ok.j) x),
n as (
  select run_id, shard_id, id, type, '' as ptr, '' as near, '' as tp, false as in_array from t where parent is null
  union all
  select t.run_id, t.shard_id, t.id, t.type, n.ptr || '/' || replace(replace(t.key, '~', '~0'), '/', '~1'), if(n.type = 'OBJECT', n.ptr, n.near), n.tp || '/' || if(n.type = 'ARRAY', '*', replace(replace(t.key, '~', '~0'), '/', '~1')), n.type = 'ARRAY'
  from t join n on t.run_id = n.run_id and t.shard_id = n.shard_id and t.parent = n.id
),
own as (select run_id, shard_id, parent as id, string_agg(to_json(key)::varchar || ':' || to_json(value)::varchar, ',' order by id) as f from t where type not in ('OBJECT', 'ARRAY') group by all),
place as (select run_id, shard_id, min(original_path) as original_path, min(data_type) as data_type from shard_meta group by all)
select run_id, shard_id, if(ptr = '', null, near) as parent_ptr, ptr as child_ptr, tp as table_path, in_array, '{' || coalesce(f, '') || '}' as fields, to_json(original_path)::varchar as original_path, data_type
from n left join own using (run_id, shard_id, id) left join place using (run_id, shard_id) where type = 'OBJECT'""",
    "p4_found": _STATES + " select distinct src_table, run_id, shard_id, ref_field, ref_id, state, period from judged where state <> 'held'",
    "p4_counts": _STATES + " select src_table, period, state, count(*) as n from (select distinct * from judged) group by all",
    "p4_snapshots": """
with ev as (select distinct 'shard_meta' as src_table, run_id, shard_id, f as ref_field, r as ref_id, recorded_at from (select *, unnest(['parent_id', 'next_shard', 'previous_shard']) as f, unnest([parent_id, next_shard, previous_shard]) as r from shard_meta) where r <> ''
  union select 'doc_meta', run_id, root_shard, 'root_shard', root_shard, created_at from doc_meta where root_shard <> ''),
months as (select distinct strftime(date_trunc('quarter', t), '%Y-%m') as month from (select recorded_at as t from ev union all select written_at from file_shard union all select removed_at from shard_removal)),
st as (select month, run_id, shard_id as ref_id, min(written_at) as fw, max(written_at) as lw from months join file_shard on strftime(date_trunc('quarter', written_at), '%Y-%m') <= month group by all),
rm as (select month, run_id, shard_id as ref_id, max(removed_at) as lr from months join shard_removal on strftime(date_trunc('quarter', removed_at), '%Y-%m') <= month group by all)
select month, src_table, case when st.ref_id is null then 'missing' when lr > lw then 'removed' when fw > recorded_at then 'late' else 'held' end as state, count(*) as n
from months join ev on strftime(date_trunc('quarter', recorded_at), '%Y-%m') <= month left join st using (month, run_id, ref_id) left join rm using (month, run_id, ref_id) group by all""",
}
