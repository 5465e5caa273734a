"""Queries for the operators on documents, shards, links and runs, with the SQL they are compared to.

Documents are the texts of file_shard (`run_id/shard_id`); small exact size rules run on the properties of events.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import metrics
from ..cluster import shared_dir, table
from ..functions import sizes as Z
from ..operators import analysis as A
from ..operators import links as L
from ..operators import packing, sharding
from ..sources import corpus, sinks
from ..streaming import documents
from .problems import _UP

LIMIT = 4000
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _docs(spark, d):
    return corpus.from_shards(table(spark, d, "file_shard"))


def _nodes(spark, d, raw=False):
    return corpus.nodes(_docs(spark, d), raw=raw)


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", "props", Z.compact_size("props").alias("size"))


_EV = "(select event_id, event_type, props, octet_length(encode(json(props))) as size from events)"

_DOCS = """docs as (select distinct run_id || '/' || shard_id as doc_id, data from file_shard where json_valid(data) and json_type(data) in ('OBJECT', 'ARRAY'))"""


def _tree(more: str = "", first: str = "", then: str = "", docs: str = _DOCS) -> str:
    """Recursive tables of documents, their values and their nodes, with further columns of the nodes if asked for."""
    return f"""with recursive {docs},
t as materialized (select doc_id, j.id, j.parent, j.key, case j.type when 'OBJECT' then 'dict' when 'ARRAY' then 'list' else 'primitive' end as kind, j.type as jt, j.value::varchar as value from docs, json_tree(json(docs.data)) j),
n as (select *, 0 as depth, '' as top, false as in_list, true as sampled{first} from t where parent is null
  union all select t.*, n.depth + 1, if(n.depth = 0, t.key, n.top), n.in_list or n.kind = 'list', n.sampled and (n.kind <> 'list' or try_cast(t.key as int) < 5){then} from t join n on t.doc_id = n.doc_id and t.parent = n.id),
kids as (select doc_id, parent as id, count(*) as k from t where parent is not null group by all),
nodes as (select n.*, coalesce(k, 0) as n_children, octet_length(encode(n.value)) as compact{more} from n left join kids using (doc_id, id))"""


_TREE = _tree()
#: With the number of the node in its document, its place, and its spaced size.
_SIZED = (
    _tree(", row_number() over (partition by doc_id order by n.id) - 1 as node", ", []::varchar[] as path, [id] as line", ", list_append(n.path, if(n.kind = 'list', '[' || t.key || ']', t.key)), list_append(n.line, t.id)")
    + """,
gaps as (select doc_id, id, sum(g) as g from (select doc_id, unnest(line) as id, n_children - 1 + if(kind = 'dict', n_children, 0) as g from nodes where n_children > 0) group by all),
sized as (select nodes.*, to_json(path)::varchar as place, compact + coalesce(g, 0)::bigint as spaced from nodes left join gaps using (doc_id, id))"""
)

#: Type of a value by its own name.
_TYPE = "case n.jt when 'OBJECT' then 'dict' when 'ARRAY' then 'list' when 'VARCHAR' then 'str' when 'BOOLEAN' then 'bool' when 'NULL' then 'NoneType' when 'DOUBLE' then 'float' else 'int' end"
#: Bytes of a value on its own, scalars by the rule for bare scalars.
_BARE = "case jt when 'NULL' then 4 when 'BOOLEAN' then if(value = 'true', 5, 4) when 'VARCHAR' then octet_length(encode(value ->> '$')) + 2 + length(value ->> '$') - length(replace(value ->> '$', '\"', '')) + length(value ->> '$') - length(replace(value ->> '$', '\\', '')) else compact end"
_ROOTS = (
    _TREE
    + """,
tops as (select doc_id, top, min_by(kind, id) as kind, max(depth) - 1 as deep from nodes where depth > 0 group by all),
per as (select doc_id, count_if(kind = 'dict') as dicts, count_if(kind = 'list') as lists, count_if(kind = 'primitive') as primitives, min(deep) as min_depth, max(deep) as max_depth, avg(deep) as avg_depth from tops group by all),
roots as (select r.doc_id, r.kind as root_kind, r.n_children as n, coalesce(dicts, 0) as dicts, coalesce(lists, 0) as lists, coalesce(primitives, 0) as primitives, coalesce(min_depth, 0) as min_depth, coalesce(max_depth, 0) as max_depth, coalesce(avg_depth, 0) as avg_depth
  from nodes r left join per using (doc_id) where r.depth = 0),
k as (select *, cast(dicts > 0 as int) + cast(lists > 0 as int) + cast(primitives > 0 as int) as kinds, if(n > 0, dicts / n, 0) as d, if(n > 0, lists / n, 0) as l, if(n > 0, primitives / n, 0) as p from roots),
classed as (select *, case when root_kind = 'list' then if(kinds > 1, 'mixed', 'list') when n = 0 or d >= 0.7 or (dicts = 0 and lists = 0) then 'dict-of-dicts' else 'mixed' end as structure,
  case when root_kind = 'list' then if(kinds > 1, 'mixed', 'list') when n = 0 or d >= 0.8 or p >= 0.8 then 'dict-of-dicts' else 'mixed' end as advisory from k)"""
)


# sizes


@query(f"select event_id, size as compact_size from {_EV}")
def z1_compact_size(spark, d):
    return _events(spark, d).select("event_id", F.col("size").alias("compact_size"))


@query("select doc_id, octet_length(encode(text)) + 2 + length(text) - length(replace(text, '\"', '')) + length(text) - length(replace(text, '\\', '')) as size from documents")
def z2_string_size(spark, d):
    return table(spark, d, "documents").select("doc_id", Z.string_size("text").alias("size"))


@query("select distinct run_id, shard_id, octet_length(encode(cast(size as varchar))) as size_digits, case when size is null then 4 else octet_length(encode(cast(size as varchar))) end as scalar from file_shard")
def z2_scalar_size(spark, d):
    s = F.col("size").cast("string")
    return table(spark, d, "file_shard").select("run_id", "shard_id", F.octet_length(s).cast("bigint").alias("size_digits"), Z.scalar_size(s, F.lit("int")).alias("scalar")).distinct()


@query(
    f"select event_id, size + 322 as schema_size, size + floor(size * 0.08)::bigint + 64 as total_size, greatest(1, ceil(size * 1000 / floor({LIMIT} * 0.8)))::bigint as shards, greatest(1, ceil(size * 1000 / {LIMIT}))::bigint as plain_shards, "
    f"(size * 100 + 500 + 300 + floor((size * 100 + 500 + 300) * 0.08) + 64 > 2000) as exceeds, floor(size * 1e6 * 5 / 1048576 * 1.2)::bigint as memory_mb from {_EV}"
)
def z7_size_rules(spark, d):
    """Schema size (Z5), overhead (Z7), shard estimates (Z9, Z10), limit check (Z12) and memory."""
    s = F.col("size")
    return _events(spark, d).select(
        "event_id", Z.schema_size("size").alias("schema_size"), Z.with_overhead("size").alias("total_size"), Z.shard_estimate(s * 1000, LIMIT).alias("shards"), Z.plain_estimate(s * 1000, LIMIT).alias("plain_shards"),
        Z.will_exceed(s * 100, F.lit(500), 2000).alias("exceeds"), Z.memory_estimate_mb(s * 1e6).alias("memory_mb"),
    )


@query(
    _TREE
    + """, r as (select doc_id, max(if(depth = 0, compact, 0)) as compact, sum(if(n_children > 0, n_children - 1 + if(kind = 'dict', n_children, 0), 0)) as gaps,
sum(if(n_children > 0, n_children * (1 + 2 * (depth + 1)) + 1 + 2 * depth + if(kind = 'dict', n_children, 0), 0)) as lines, sum(if(n_children > 0, 2 * (n_children + 1), 0)) as shift from nodes group by all)
select doc_id, compact, (compact + gaps)::bigint as spaced, (compact + lines)::bigint as formatted, compact + 322 as schema, (compact + lines + shift + 228 + floor((compact + lines + shift + 228) * 0.08) + 64)::bigint as file, lines::bigint as pretty_gain from r"""
)
def z6_size_breakdown(spark, d):
    """Compact, spaced, formatted, schema and file sizes of each document."""
    return A.size_breakdown(_nodes(spark, d))


@query(f"select event_id, least({2 * 92160}, greatest({92160 // 2}, greatest(1, floor(536870912 / (size * 3))) * size))::bigint as chunk_size from {_EV}")
def z15_chunk_size(spark, d):
    return _events(spark, d).select("event_id", Z.chunk_size("size").alias("chunk_size"))


@query(f"select run_id, shard_id, coalesce(size > {LIMIT}, false) as oversized from (select run_id, shard_id, max(size) as size from file_shard group by all)")
def v11_oversized(spark, d):
    """Shards that say they are larger than a limit."""
    s = table(spark, d, "file_shard").groupBy("run_id", "shard_id").agg(F.max("size").alias("size"))
    return s.select("run_id", "shard_id", Z.is_oversized("size", LIMIT).alias("oversized"))


@query(_TREE + " select r.doc_id, bool_or(coalesce(c.kind <> 'primitive', false)) as nested from nodes r left join nodes c on c.doc_id = r.doc_id and c.depth = 1 where r.depth = 0 group by all")
def v11_nested(spark, d):
    return A.has_nested(_nodes(spark, d))


@query("""with m as (select run_id, max(original_size) as b, max(shard_count) as n, min(created_at) as t from doc_meta group by all)
select run_id, round(b / 1024, 6) as kb, round(b / 1048576, 6) as mb, if(n > 0, round(b / n, 6), null) as average_shard, round(epoch_us(timestamp '2026-07-01 00:00:00' - t) / 3600000000, 6) as age_hours, coalesce(b > 20000, false) as large from m""")
def v13_document_facts(spark, d):
    """Sizes, average shard and age of each run's document, and whether it is large."""
    return A.document_facts(table(spark, d, "doc_meta"), "2026-07-01 00:00:00", 20000)


@query("select doc_id, ok as is_valid from (select doc_id, coalesce(case when json_valid(data) then json_type(data) in ('OBJECT', 'ARRAY') end, false) as ok from (select distinct run_id || '/' || shard_id as doc_id, data from file_shard))")
def v10_validate_input(spark, d):
    return A.validate_input(_docs(spark, d)).select("doc_id", "is_valid")


@query("""with rec as (select distinct run_id, shard_id, data_type, original_path from shard_meta)
select run_id, shard_id, octet_length(encode(to_json(struct_pack(shardId := shard_id, parentId := null::varchar, childIds := []::varchar[], dataType := data_type, originalPath := original_path, nextShard := null::varchar, previousShard := null::varchar, version := '1.0.0'))::varchar)) as bytes from rec""")
def z4_metadata_size(spark, d):
    """Compact bytes of the metadata of each record with its links null."""
    none = F.lit(None).cast("string")
    m = F.struct(F.col("shard_id").alias("shardId"), none.alias("parentId"), F.array().cast("array<string>").alias("childIds"), F.col("data_type").alias("dataType"), F.col("original_path").alias("originalPath"), none.alias("nextShard"), none.alias("previousShard"), F.lit("1.0.0").alias("version"))
    return _rec(spark, d).select("run_id", "shard_id", Z.metadata_size(m).alias("bytes"))


@query(f"with recursive {_DOCS}, c as (select doc_id, json(data)::varchar as j from docs), n as (select doc_id, length(j) + 5 * length(regexp_replace(j, '[\\x00-\\x7F]', '', 'g')) + 6 * length(regexp_replace(j, '[\\x00-\\x{{FFFF}}]', '', 'g')) as n from c) select doc_id, n as original_size, n as optimized_size, 1.0::double as ratio, 0.3::double as gzip, 0.5::double as lz4, 0.25::double as zstd, if(n > 50000, 'zstd', 'lz4') as algorithm from n")
def z16_compression(spark, d):
    return A.compression_potential(_docs(spark, d))


@query()
def z13_memory(spark, d):
    """Bytes of objects of one Python build; no SQL."""
    return A.memory_usage(_docs(spark, d))


# validation and structure


@query(
    """with recursive all_docs as (select distinct run_id || '/' || shard_id as doc_id, data from file_shard),
sound as (select *, case when json_valid(data) then json_type(data) in ('OBJECT', 'ARRAY') end as ok from all_docs)"""
    + ", "
    + _tree(docs="docs as (select doc_id, data from sound where ok)").removeprefix("with recursive ")
    + """
select doc_id, 'error' as severity, case when json_valid(data) then 'STRUCTURE' else 'SYNTAX' end as error_type, case when coalesce(trim(data, chr(32) || chr(9) || chr(10) || chr(13)), '') = '' then 'JSON string is empty'
  when json_valid(data) then 'Root element must be dict or list, got ' || case if(json_valid(data), json_type(data), null) when 'VARCHAR' then 'str' when 'BOOLEAN' then 'bool' when 'NULL' then 'NoneType' when 'DOUBLE' then 'float' else 'int' end end as message from sound where not coalesce(ok, false)
union all select doc_id, 'warning', 'STRUCTURE', 'nested ' || max(depth) || ' deep' from nodes group by doc_id having max(depth) > 20"""
)
def v1_validate(spark, d):
    """Errors and warnings of each document; where a text breaks off is not compared, as parsers put it differently."""
    v = A.validate(_docs(spark, d))
    return v.withColumn("message", F.when(~F.col("message").rlike(r"\(line \d+, column \d+\)$"), F.col("message")))


@query(_TREE + " select doc_id, max(depth) as depth from nodes group by all")
def v4_depth(spark, d):
    return A.depths(_nodes(spark, d))


@query(_SIZED + f""" select doc_id, max(if(depth = 0, spaced, null)) as spaced_size, max(depth) as depth, count_if(depth > 0 and spaced > {LIMIT // 2}) as large_values,
max(if(depth = 0, spaced, null)) > {1000 * LIMIT} as too_large, max(depth) > 10 as too_deep from sized group by all""")
def v6_preflight(spark, d):
    return A.preflight(_nodes(spark, d), LIMIT)


@query(_SIZED + f" select doc_id, place, spaced as size from sized where depth > 0 and spaced > {LIMIT // 2}")
def v7_large_values(spark, d):
    return A.large_values(_nodes(spark, d), LIMIT // 2)


@query(_ROOTS + " select doc_id, root_kind, n, dicts, lists, primitives, min_depth, max_depth, avg_depth, structure, advisory from classed")
def d1_classify(spark, d):
    return A.classify(A.children_of_root(_nodes(spark, d)))


@query(_ROOTS + " select doc_id, root_kind, n, dicts, lists, primitives, min_depth, max_depth, avg_depth, structure, advisory, d as dict_ratio, l as list_ratio, p as primitive_ratio, kinds <= 1 as homogeneous from classed")
def d4_patterns(spark, d):
    return A.patterns(A.children_of_root(_nodes(spark, d)))


@query(_SIZED + " select doc_id, node, place, kind as type, n_children as size, depth from sized where kind <> 'primitive'")
def d6_nested(spark, d):
    return A.nested(_nodes(spark, d))


@query("select event_id::varchar as doc_id, json_extract(props, '$.k')::varchar as value from events")
def d7_value_at_path(spark, d):
    return A.value_at(corpus.from_events(table(spark, d, "events")), ["k"])


@query(_TREE + " select doc_id, max(depth) as level from nodes where kind = 'dict' and not in_list group by all")
def d9_object_nesting(spark, d):
    return A.object_nesting(_nodes(spark, d))


@query(_TREE + f""" select n.doc_id, {_TYPE} as type, count(*) as n, max(n.compact) as largest from nodes n join nodes r on r.doc_id = n.doc_id and r.depth = 0 and r.kind = 'list' where n.depth = 1 group by all""")
def d12_list_types(spark, d):
    return A.type_histogram(_nodes(spark, d))


@query(
    _TREE
    + """,
lv as (select doc_id, depth, count_if(kind = 'dict') as a, count_if(kind = 'list') as b, count_if(kind = 'primitive') as c from nodes where sampled group by all),
s as (select doc_id, sum(a)::bigint as dicts, sum(b)::bigint as lists, sum(c)::bigint as primitives, max(depth) as max_depth, count_if(cast(a > 0 as int) + cast(b > 0 as int) + cast(c > 0 as int) > 1) as blended from lv group by all)
select doc_id, dicts, lists, primitives, max_depth, round(least(10.0, (cast(dicts > 0 as int) + cast(lists > 0 as int) + cast(primitives > 0 as int)) * 0.5 + max_depth * 0.3 + if(dicts + lists + primitives > 100, 1.0, 0.0) + blended * 0.5), 6)::double as score from s"""
)
def d13_mixed_analysis(spark, d):
    return A.mixed_analysis(_nodes(spark, d))


@query(_ROOTS + " select doc_id, advisory, round(least(5.0, if(n > 0, max_depth * 0.3 + if(kinds <= 1, 0.0, 0.5) + if(advisory = 'mixed', 0.7, 0.0) + if(n > 100, 0.4, 0.0), 0.0)), 6)::double as score from classed")
def d15_advisory_score(spark, d):
    return A.advisory_score(A.children_of_root(_nodes(spark, d)))


@query(
    _TREE
    + """ select doc_id, count_if(kind = 'dict') as dicts, count_if(kind = 'list') as lists, count_if(kind = 'primitive') as primitives,
sum(if(kind = 'dict', n_children, 0))::bigint as keys, sum(if(kind = 'list', n_children, 0))::bigint as items, max(depth) as depth,
(max(if(depth = 0, compact, 0)) + sum(if(n_children > 0, n_children - 1 + if(kind = 'dict', n_children, 0), 0)))::bigint as spaced_size from nodes group by all"""
)
def d16_statistics(spark, d):
    return A.statistics(_nodes(spark, d))


_CANDIDATES = f"""select doc_id, node, place, kind as type, spaced as size, n_children, round(greatest(0.1, spaced / {LIMIT // 4} + least(n_children / 100, 1.0) + if(kind = 'dict', 0.2, 0.0) - depth * 0.1), 6)::double as priority from sized where kind <> 'primitive' and spaced > {LIMIT // 4}"""


@query(_SIZED + " " + _CANDIDATES)
def n1_candidates(spark, d):
    return A.candidates(_nodes(spark, d), LIMIT // 4)


@query(_SIZED + f" select * from (select *, row_number() over (partition by doc_id order by priority desc, node) as rank from ({_CANDIDATES})) where rank <= 5")
def a8_top_candidates(spark, d):
    return A.top_candidates(A.candidates(_nodes(spark, d), LIMIT // 4))


_ADVISED = (
    _ROOTS.replace(_TREE, _SIZED, 1)
    + f""",
z as (select doc_id, max(if(depth = 0, spaced, null)) as spaced, count_if(kind <> 'primitive' and spaced > {LIMIT // 2}) as candidates from sized group by all),
advised as (select *, round(least(5.0, if(n > 0, max_depth * 0.3 + if(kinds <= 1, 0.0, 0.5) + if(advisory = 'mixed', 0.7, 0.0) + if(n > 100, 0.4, 0.0), 0.0)), 6)::double as score from classed join z using (doc_id)),
plan as (select doc_id, structure, advisory, case advisory when 'dict-of-dicts' then 'dict_processor' when 'list' then 'list_processor' else 'mixed_processor' end as processor, candidates, greatest(1, ceil(spaced / {LIMIT}))::bigint as shards, score,
  case when candidates = 0 then 'simple_sharding' when score > 3 then 'complex_hierarchical' when candidates > 10 then 'aggressive_sharding' when advisory = 'mixed' then 'mixed_strategy' else 'standard_sharding' end as strategy from advised)"""
)


@query(_ADVISED + " select * from plan")
def n3_recommend(spark, d):
    return A.recommend(_nodes(spark, d), LIMIT)


_OVERVIEW = _SIZED + """,
o as (select doc_id, max(if(depth = 0, kind, null)) as root, max(if(depth = 0, n_children, null)) as n, count_if(depth = 1 and {bare} > {at}) as large, coalesce(sum({bare}) filter (depth = 1 and {bare} > {at}), 0) as large_bytes,
  count_if(depth = 1 and kind <> 'primitive') as containers, count(distinct {kind}) filter (depth = 1) as types, max(depth) filter (kind = 'dict' and not in_list) as level,
  sum(if(n_children > 0, n_children * (1 + 2 * (depth + 1)) + 1 + 2 * depth + if(kind = 'dict', n_children, 0) + 2 * (n_children + 1), 0)) + max(if(depth = 0, compact, 0)) + 228 as b from sized n group by all),
f as (select *, (b + floor(b * 0.08) + 64)::bigint as size from o)"""


def _overview(share: float, rules: list[tuple[str, str, str]], where: str) -> str:
    parts = " union all ".join(f"select doc_id, '{name}' as suggestion, ({value})::double as value from f where {where} and {test}" for test, name, value in rules)
    return _OVERVIEW.format(bare=f"({_BARE})", at=LIMIT * share, kind=_TYPE) + " " + parts


@query(_overview(0.5, [("large > 0", "split_large_values", "large"), ("level > 5", "flatten_deep_nesting", "level"), ("n > 1000", "group_related_keys", "n")], "root = 'dict'"))
def n6_dict_advice(spark, d):
    return A.dict_advice(_nodes(spark, d), LIMIT)


@query(_overview(0.5, [("large > 0", "split_large_items", "large"), ("types > 1", "group_similar_items", "types"), ("containers > 0", "flatten_nested_structures", "containers"), ("n > 10000", "batch_processing", "n")], "root = 'list' and n > 0"))
def n7_list_advice(spark, d):
    return A.list_advice(_nodes(spark, d), LIMIT)


@query(_overview(0.3, [("root = 'dict' and large > 0", "split_large_values", "large_bytes * 0.5"), ("root = 'list' and n > 10", "split_list", "round(size * 0.6, 6)"), (f"size - {LIMIT} < size * 0.1", "remove_formatting", "round(size * 0.08, 6)")], f"size > {LIMIT}"))
def n8_size_advice(spark, d):
    return A.size_advice(_nodes(spark, d), LIMIT)


# packing and sharding


def _fits(policy: str, limit: int) -> str:
    usable, fill = Z.room(limit)
    return {"fill": f"(c.used + e.size > {fill} and c.used > 0) or c.used + e.size > {usable}", "tight": f"c.used > 0 and c.used + e.size > {limit} * 0.9", "plain": f"c.used > 0 and c.used + e.size > {limit}"}[policy]


def _next_fit(policy: str, limit: int) -> str:
    return f"""with recursive e as (select event_type, event_id, size, row_number() over (partition by event_type order by event_id) as i from {_EV}),
c as (select event_type, i, size as used, 0 as chunk, event_id, size from e where i = 1
  union all select e.event_type, e.i, if({_fits(policy, limit)}, e.size, c.used + e.size), c.chunk + if({_fits(policy, limit)}, 1, 0), e.event_id, e.size from e join c on e.event_type = c.event_type and e.i = c.i + 1),
chunks as (select event_type, chunk::bigint as chunk, count(*) as n_items, sum(size)::bigint as bytes, min(event_id) as first, max(event_id) as last from c group by all)"""


@query(_next_fit("fill", 722) + " select * from chunks")
def k1_nextfit(spark, d):
    return packing.chunk_table(packing.stream(_events(spark, d), ["event_type"], "event_id", "size", 722), ["event_type"], "event_id", "size")


@query(_next_fit("tight", 722) + " select * from chunks")
def k17_nextfit_tight(spark, d):
    return packing.chunk_table(packing.stream(_events(spark, d), ["event_type"], "event_id", "size", 722, "tight"), ["event_type"], "event_id", "size")


@query(_next_fit("plain", 722) + " select * from chunks")
def t2_stream_chunks(spark, d):
    return packing.chunk_table(packing.stream(_events(spark, d), ["event_type"], "event_id", "size", 722, "plain", block=256), ["event_type"], "event_id", "size")


@query(
    _SIZED
    + f""", m as (select n.doc_id, n.node, if(r.kind = 'dict', n.key, null) as key, row_number() over (partition by n.doc_id order by n.node) as i, if(r.kind = 'dict', octet_length(encode(to_json(n.key)::varchar)) + 3 + n.compact, {_BARE.replace("jt", "n.jt").replace("value", "n.value").replace("else compact", "else n.compact")}) as size
  from sized n join sized r on r.doc_id = n.doc_id and r.depth = 0 where n.depth = 1),
c as (select doc_id, i, size as used, 0 as chunk, key, size from m where i = 1
  union all select m.doc_id, m.i, if(c.used + m.size > 400 and c.used > 0, m.size, c.used + m.size), c.chunk + if(c.used + m.size > 400 and c.used > 0, 1, 0), m.key, m.size from m join c on c.doc_id = m.doc_id and m.i = c.i + 1)
select doc_id, chunk::bigint as chunk, count(*) as n_items, sum(size)::bigint as bytes, max(if(size > 400, key, null)) as alone from c group by all"""
)
def t1_member_chunks(spark, d):
    return documents.member_chunks(_nodes(spark, d), 400)


@query(
    _SIZED
    + f""" select n.doc_id, n.node, n.kind as type, n.compact > {LIMIT * 0.3} or n.n_children > if(n.kind = 'dict', 10, 20) or exists (from sized c where c.doc_id = n.doc_id and c.parent = n.id and c.kind <> 'primitive') as heavy
from sized n join sized r on r.doc_id = n.doc_id and r.depth = 0 and r.kind = 'list' where n.depth = 1 and n.kind <> 'primitive'"""
)
def k24_heavy_items(spark, d):
    return A.heavy_items(_nodes(spark, d), LIMIT)


@query(_next_fit("fill", 722) + """ select event_type, chunk, n_items, bytes, first, last, printf('shard_%03d', chunk + 1) as shard_id, if(chunk > 0, printf('shard_%03d', chunk), null) as previous_shard,
if(chunk < max(chunk) over (partition by event_type), printf('shard_%03d', chunk + 2), null) as next_shard from chunks""")
def k2_shard_ids(spark, d):
    return packing.number(k1_nextfit(spark, d), ["event_type"])


def _shards(spark, d, mode="lossless"):
    return sharding.shard(_docs(spark, d), LIMIT, mode)


def _flat(df):
    return df.withColumns({c: F.to_json(c) for c in ("child_ids", "original_path")})


@query()
def k9_shards(spark, d):
    """Documents cut into shards by structure (K1 to K26), lossless; no SQL, as cutting is recursive in sizes of what it cut before. `s2_rebuilt` joins them again."""
    return _flat(_shards(spark, d))


@query()
def k9_shards_compatible(spark, d):
    """The same with the quirks kept; no SQL. The routes have SQL below, one by one."""
    return _flat(_shards(spark, d, "reference"))


def _objects(spark, d):
    return _docs(spark, d).where(F.col("json").rlike(r"^\s*\{"))


def _object_shards(spark, d):
    """Documents that are objects, cut where the structure demands it and nowhere else, keys as they come, quirks kept."""
    return sharding.shard(_objects(spark, d), 1 << 30, "reference", sort=False)


def _shard_name(n: str) -> str:
    return f"printf('shard_%03d', {n})"


#: Shards of objects that no limit cuts (K9 to K11, K13, K22, K24, K25): an object has one, and so have non-empty lists below it;
#: objects come before lists. Places below a mixed root are those within its values, and its references name their processor.
_OBJECTS = (
    _tree(", n.id as nid", ", []::varchar[] as path, [id] as line, '' as okey", ", list_append(n.path, if(n.kind = 'list', '[' || t.key || ']', t.key)), list_append(n.line, t.id), n.okey || if(t.kind = 'list', '1', '0') || printf('%09d', t.id)").replace(_DOCS, _DOCS.replace("in ('OBJECT', 'ARRAY')", "= 'OBJECT'"), 1)
    + f""",
share as (select doc_id, count(*) as m, count_if(kind = 'dict') as dicts, count_if(kind <> 'primitive') as containers from nodes where depth = 1 group by all),
cls as (select r.doc_id, coalesce(dicts / m < 0.7 and containers > 0, false) as mixed, octet_length(encode(data)) as original_size from nodes r join docs using (doc_id) left join share using (doc_id) where r.depth = 0),
sh as (select n.*, mixed, original_size, row_number() over (partition by n.doc_id order by okey) as no, case when kind = 'list' and mixed and depth = 1 then [if(n_children = 0, '[]', '[0:' || n_children || ']')] when mixed then path[2:] else path end as place
  from nodes n join cls using (doc_id) where not in_list and (kind = 'dict' or (kind = 'list' and depth > 0 and (n_children > 0 or (mixed and depth = 1))))),
member as (select n.doc_id, n.parent, s.no, case n.kind when 'dict' then 1 when 'list' then 2 else 0 end as grp, n.id, to_json(n.key)::varchar || ':' || case when n.kind = 'primitive' then n.value
    else '{{"_shard_ref":"' || {_shard_name("s.no")} || '","_shard_type":"' || n.kind || '"' || if(mixed and n.depth = 1, ',"_processor":"' || n.kind || '_processor"', '') || ',"_original_path":' || to_json(if(mixed and n.depth > 1, n.path[2:], n.path))::varchar || '}}' end as text,
    case when n.kind = 'primitive' then 0 else if(mixed and n.depth = 1, 37, 29) + 9 * len(if(mixed and n.depth > 1, n.path[2:], n.path)) + 7 end + 6 as lines
  from nodes n left join sh s on s.doc_id = n.doc_id and s.id = n.id where n.kind = 'primitive' or s.no is not null),
body as (select doc_id, parent as id, '{{' || string_agg(text, ',' order by grp, id) || '}}' as data, sum(lines)::bigint + 3 as lines, list({_shard_name("no")} order by no) filter (no is not null) as child_ids from member group by all),
inner_ as (select doc_id, unnest(line) as id, generate_subscripts(line, 1) - 1 as above, depth, kind, n_children from nodes where n_children > 0 and in_list or kind = 'list'),
spread as (select doc_id, id, sum(n_children * (1 + 2 * (depth - above + 2)) + 1 + 2 * (depth - above + 1) + if(kind = 'dict', n_children, 0))::bigint as lines from inner_ where n_children > 0 group by all),
made as (select sh.doc_id, (sh.no - 1)::int as ord, {_shard_name("sh.no")} as shard_id, if(sh.depth = 0, null, {_shard_name("up.no")}) as parent_id, coalesce(body.child_ids, []) as child_ids, sh.kind as data_type, sh.place as original_path, null::varchar as next_shard, null::varchar as previous_shard, '1.0.0' as version,
    if(sh.kind = 'dict', coalesce(body.data, '{{}}'), sh.value) as data, 228 + if(sh.kind = 'dict', coalesce(octet_length(encode(body.data)) + body.lines, 2), sh.compact + coalesce(spread.lines, 0)) as b, if(sh.mixed, 'mixed', 'dict-of-dicts') as data_structure, sh.original_size
  from sh left join sh up on up.doc_id = sh.doc_id and up.id = sh.parent left join body on body.doc_id = sh.doc_id and body.id = sh.id left join spread on spread.doc_id = sh.doc_id and spread.id = sh.id),
shards as (select * exclude (b), (b + floor(b * 0.08) + 64)::bigint as size from made)"""
)


@query(_OBJECTS + " select * exclude (original_size) replace (to_json(child_ids)::varchar as child_ids, to_json(original_path)::varchar as original_path) from shards")
def k9_objects(spark, d):
    return _flat(_object_shards(spark, d))


@query(
    _TREE
    + f""",
e as (select n.doc_id, n.value, {_BARE.replace("jt", "n.jt").replace("value", "n.value").replace("else compact", "else n.compact")} as size, row_number() over (partition by n.doc_id order by n.id) as i from nodes n where n.depth = 1 and n.doc_id in (select doc_id from nodes group by doc_id having max(depth) filter (kind <> 'primitive') = 0 and max(if(depth = 0, kind, null)) = 'list')),
c as (select doc_id, i, size as used, 0 as chunk, value from e where i = 1
  union all select e.doc_id, e.i, if(c.used + e.size > 60 * 0.9, e.size, c.used + e.size), c.chunk + if(c.used + e.size > 60 * 0.9, 1, 0), e.value from e join c on c.doc_id = e.doc_id and e.i = c.i + 1),
k as (select doc_id, chunk, min(i) - 1 as a, max(i) as z, '[' || string_agg(value, ',' order by i) || ']' as data, count(*) as m from c group by all),
lists as (select doc_id, chunk, a, z, data, m from k union all select doc_id, 0, 0, 0, '[]', 0 from nodes where depth = 0 and kind = 'list' and n_children = 0),
b as (select *, 228 + octet_length(encode(data)) + if(m > 0, m * 5 + 3, 0) as b from lists)
select doc_id, chunk::int as ord, {_shard_name("chunk + 1")} as shard_id, null::varchar as parent_id, '[]' as child_ids, 'list' as data_type, if(m = 0, '["[]"]', '["[' || {{a}} || ':' || {{z}} || ']"]') as original_path,
  if(chunk < max(chunk) over (partition by doc_id), {_shard_name("chunk + 2")}, null) as next_shard, if(chunk > 0, {_shard_name("chunk")}, null) as previous_shard, '1.0.0' as version, data, (b + floor(b * 0.08) + 64)::bigint as size, 'list' as data_structure from b""".format(a="a", z="z")
)
def k15_simple_lists(spark, d):
    """Lists of scalars cut into slices at nine tenths of a small limit (K14, K15, K17, K20), slices at their true places."""
    return _flat(sharding.shard(_simple_lists(spark, d), 60, sort=False))


def _simple_lists(spark, d):
    n = _nodes(spark, d).where("depth <= 1 and kind <> 'primitive'").groupBy("doc_id").agg(F.max("depth").alias("d"), F.min_by("kind", "depth").alias("k")).where("d = 0 and k = 'list'")
    return _docs(spark, d).join(n.select("doc_id"), "doc_id", "left_semi")


@query(SQL["k15_simple_lists"].replace("'[\"[' || a || ':' || z", "'[\"[' || (chunk * m) || ':' || ((chunk + 1) * m)"))
def k15_simple_lists_compatible(spark, d):
    """The same with the quirk kept that slices are numbered by the length of the current one."""
    return _flat(sharding.shard(_simple_lists(spark, d), 60, "reference", sort=False))


@query(
    f"""with recursive e as (select (o_custkey // 10)::varchar as doc_id, '"' || o_orderkey || '":"' || o_orderpriority || '"' as pair, row_number() over (partition by o_custkey // 10 order by o_orderkey) as i from orders),
whole as (select doc_id, '{{{{' || string_agg(pair, ',' order by i) || '}}}}' as data, count(*) as m from e group by all),
sized as (select *, 228 + octet_length(encode(data)) + m * 6 + 3 as b from whole),
over as (select doc_id from sized where b + floor(b * 0.08) + 64 > 2000),
f as (select *, 239 + octet_length(encode(pair)) + floor((239 + octet_length(encode(pair))) * 0.08)::bigint + 64 as size from e join over using (doc_id)),
c as (select doc_id, i, size as used, 0 as chunk, pair from f where i = 1
  union all select f.doc_id, f.i, if({{opens}}, f.size, c.used + f.size), c.chunk + if({{opens}}, 1, 0), f.pair from f join c on c.doc_id = f.doc_id and f.i = c.i + 1),
parts as (select doc_id, chunk, '{{{{' || string_agg(pair, ',' order by i) || '}}}}' as data, count(*) as m from c group by all),
out as (select doc_id, chunk as ord, {_shard_name("chunk + 2")} as shard_id, data, 228 + octet_length(encode(data)) + m * 6 + 3 as b, if(chunk < max(chunk) over (partition by doc_id), {_shard_name("chunk + 3")}, null) as next_shard, if(chunk > 0, {_shard_name("chunk + 1")}, null) as previous_shard from parts
  union all select doc_id, 0, 'shard_001', data, b, null, null from sized where doc_id not in (from over))
select doc_id, ord::int as ord, shard_id, 'dict' as data_type, data, (b + floor(b * 0.08) + 64)::bigint as size, next_shard, previous_shard from out""".format(opens="((c.used + f.size > 1445 and c.used > 0) or c.used + f.size > 1700)")
)
def k8_redistributed(spark, d):
    """Objects of the orders of ten customers, one shard each, those over a limit cut again member by member (K4, K5, K7, K8)."""
    pair = F.struct("o_orderkey", "o_orderpriority")
    docs = table(spark, d, "orders").groupBy(F.expr("o_custkey div 10").cast("string").alias("doc_id")).agg(F.to_json(F.map_from_entries(F.transform(F.sort_array(F.collect_list(pair)), lambda x: F.struct(x["o_orderkey"].cast("string"), x["o_orderpriority"])))).alias("json"))
    return sharding.redistribute(sharding.shard(docs, 1 << 30, "reference", sort=False), 2000).select("doc_id", "ord", "shard_id", "data_type", "data", "size", "next_shard", "previous_shard")


@query(
    f"""with recursive line as (select l_orderkey, '[' || string_agg('{{{{"line":' || l_linenumber || ',"part":' || l_partkey || ',"quantity":' || l_quantity::bigint || '}}}}', ',' order by l_linenumber, l_partkey, l_quantity) || ']' as lines, count(*) as m from lineitem group by all),
ord as (select o_custkey, o_orderkey, '{{{{"lines":' || coalesce(lines, '[]') || ',"order":' || o_orderkey || ',"status":"' || o_orderstatus || '"}}}}' as text, coalesce(m, 0) as m from orders left join line on l_orderkey = o_orderkey),
e as (select *, octet_length(encode(text)) as size, row_number() over (partition by o_custkey order by o_orderkey) as i from ord),
c as (select o_custkey, i, size as used, 0 as chunk, text, m from e where i = 1
  union all select e.o_custkey, e.i, if({{opens}}, e.size, c.used + e.size), c.chunk + if({{opens}}, 1, 0), e.text, e.m from e join c on c.o_custkey = e.o_custkey and e.i = c.i + 1),
k as (select o_custkey, chunk, min(i) - 1 as a, max(i) as z, '[' || string_agg(text, ',' order by i) || ']' as data, count(*) * 5 + 3 + sum(3 * 8 + 5 + if(m > 0, m * 9 + 7 + m * (3 * 12 + 9), 0)) as lines from c group by all),
last as (select *, max(chunk) over (partition by o_custkey) as top from k),
out as (
  select o_custkey, chunk + 2 as ord, {_shard_name("chunk + 3")} as shard_id, if(chunk = 0, 'shard_001', null) as parent_id, '[]' as child_ids, 'list' as data_type, '["orders","[' || a || ':' || z || ']"]' as original_path, if(chunk < top, {_shard_name("chunk + 4")}, null) as next_shard, if(chunk > 0, {_shard_name("chunk + 2")}, null) as previous_shard, data, octet_length(encode(data)) + lines as b from last
  union all select c_custkey, 1, 'shard_002', 'shard_001', '[]', 'dict', '["place"]', null, null, '{{{{"nation":' || c_nationkey || '}}}}', octet_length(encode('{{{{"nation":' || c_nationkey || '}}}}')) + 9 from customer
  union all select c_custkey, 0, 'shard_001', null, '["shard_002","shard_003"]', 'dict', '[]', null, null, r.data, octet_length(encode(r.data)) + 4 * 6 + 3 + 2 * (37 + 16) from (select c_custkey, '{{{{"name":"' || c_name || '","orders":{{{{"_shard_ref":"shard_003","_shard_type":"list","_processor":"list_processor","_original_path":["orders"]}}}},"place":{{{{"_shard_ref":"shard_002","_shard_type":"dict","_processor":"dict_processor","_original_path":["place"]}}}},"segment":"' || c_mktsegment || '"}}}}' as data from customer) r)
select o_custkey::varchar as doc_id, ord::int as ord, shard_id, parent_id, child_ids, data_type, original_path, next_shard, previous_shard, '1.0.0' as version, data, (b + 228 + floor((b + 228) * 0.08) + 64)::bigint as size, 'mixed' as data_structure from out where o_custkey in (select o_custkey from orders)""".format(opens="((c.used + e.size > 2890 and c.used > 0) or c.used + e.size > 3400)")
)
def k21_customer_shards(spark, d):
    """Mixed documents made of customers with their orders and lines, cut into shards."""
    docs = corpus.from_orders(table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "customer"))
    return _flat(sharding.shard(docs, LIMIT))


@query(
    """with recursive all_docs as (select distinct run_id || '/' || shard_id as doc_id, data from file_shard), sound as (select *, coalesce(case when json_valid(data) then json_type(data) in ('OBJECT', 'ARRAY') end, false) as ok from all_docs), """
    + _tree(docs="docs as (select doc_id, data from sound where ok)").removeprefix("with recursive ")
    + """,
ranked as (select n.*, row_number() over (partition by n.doc_id, n.parent order by if(p.kind = 'dict', n.key, ''), n.id) as rank, p.kind as within from nodes n left join nodes p on p.doc_id = n.doc_id and p.id = n.parent),
place as (select doc_id, id, kind, value, key, within, rank, '' as spot from ranked where parent is null
  union all select r.doc_id, r.id, r.kind, r.value, r.key, r.within, r.rank, place.spot || printf('%06d', r.rank) from ranked r join place on place.doc_id = r.doc_id and place.id = r.parent),
token as (select doc_id, spot, if(spot <> '' and rank > 1, ',', '') || if(within = 'dict', to_json(key)::varchar || ':', '') || case kind when 'dict' then '{' when 'list' then '[' else value end as text from place
  union all select doc_id, spot || '~', if(kind = 'dict', '}', ']') from place where kind <> 'primitive'),
made as (select doc_id, string_agg(text, '' order by spot) as json from token group by all)
select doc_id, json, case when ok then null when json_valid(data) then 'STRUCTURE' else 'SYNTAX' end as error_type from sound left join made using (doc_id)"""
)
def k27_sorted_keys(spark, d):
    return corpus.canonical(_docs(spark, d), sort=True).select("doc_id", "json", "error_type")


@query(_TREE + " select doc_id, true as dense, true as parents, true as children, true as chained, true as named from nodes where depth = 0")
def k9_links(spark, d):
    """Of the lossless shards of each document, whether ids and order are dense, parents and children name each other, next and previous as well, and all places are texts."""
    s = _shards(spark, d)
    other = s.select("doc_id", F.col("shard_id").alias("o"), F.col("child_ids").alias("o_kids"), F.col("parent_id").alias("o_parent"), F.col("previous_shard").alias("o_previous"))
    up = s.where("parent_id is not null").withColumnRenamed("parent_id", "o").join(other, ["doc_id", "o"], "left").groupBy("doc_id").agg(F.bool_and(F.col("o_kids").isNotNull()).alias("parents"))
    down = s.select("doc_id", "shard_id", F.explode("child_ids").alias("o")).join(other, ["doc_id", "o"], "left").groupBy("doc_id").agg(F.bool_and(F.col("o_parent").eqNullSafe(F.col("shard_id"))).alias("children"))
    on = s.where("next_shard is not null").withColumnRenamed("next_shard", "o").join(other, ["doc_id", "o"], "left").groupBy("doc_id").agg(F.bool_and(F.col("o_previous").eqNullSafe(F.col("shard_id"))).alias("chained"))
    own = s.groupBy("doc_id").agg(((F.count("*") == F.count_distinct("shard_id")) & (F.max("ord") == F.count("*") - 1)).alias("dense"), F.bool_and(F.col("original_path").isNotNull() & F.col("shard_id").startswith("shard_")).alias("named"))
    j = own.join(up, "doc_id", "left").join(down, "doc_id", "left").join(on, "doc_id", "left")
    return j.select("doc_id", "dense", *(F.coalesce(c, F.lit(True)).alias(c) for c in ("parents", "children", "chained")), "named")


def _mixed_lists(spark, d):
    m = A.classify(A.children_of_root(_nodes(spark, d))).where("structure = 'mixed' and root_kind = 'list'")
    return _docs(spark, d).join(m.select("doc_id"), "doc_id", "left_semi")


@query(
    _OBJECTS.split(",\nshare as")[0].replace("= 'OBJECT'", "= 'ARRAY'", 1)
    + f""",
kinds as (select doc_id, count(distinct kind) as k from nodes where depth = 1 group by all),
item as (select n.doc_id, n.id, n.kind, n.value, n.n_children, row_number() over (partition by n.doc_id order by n.id) - 1 as i,
    n.kind <> 'primitive' and (n.n_children > if(n.kind = 'dict', 10, 20) or exists (from nodes c where c.doc_id = n.doc_id and c.parent = n.id and c.kind <> 'primitive')) as heavy
  from nodes n join kinds using (doc_id) where n.depth = 1 and k > 1),
run as (select *, sum(if(heavy, 1, 0)) over (partition by doc_id order by i) as g from item),
slice as (select doc_id, min(i) as i, max(i) + 1 as z, '[' || string_agg(value, ',' order by i) || ']' as data from run where not heavy group by doc_id, g),
-- what lies in heavy items: an object gives a shard, so does a non-empty list below objects; a list as item gives one
inside as (select item.doc_id, item.i, item.id as top, n.id, n.parent, n.kind, n.okey, n.value, n.n_children, n.path[2:] as path, n.key, n.id = item.id as head from item join nodes n on n.doc_id = item.doc_id and list_contains(n.line, item.id)
  where heavy and (n.id = item.id or (item.kind = 'dict' and n.kind <> 'primitive' and (n.kind = 'dict' or n.n_children > 0) and not exists (from nodes u where u.doc_id = n.doc_id and list_contains(n.line[3:-2], u.id) and u.kind = 'list')))),
-- ids: within a heavy item its parts in order, then the wrapper; slices one each
number as (select doc_id, i, sub, row_number() over (partition by doc_id order by i, sub) as no, id from (select doc_id, i, row_number() over (partition by doc_id, i order by okey) as sub, id from inside union all select doc_id, i, 1000000, null from item where heavy union all select doc_id, i, 1, null from slice)),
shards as (
  select slice.doc_id, slice.i, 0 as sub, no, null::bigint as parent, []::bigint[] as kids, 'list' as data_type, ['[' || slice.i || ':' || z || ']'] as path from slice join number using (doc_id, i) where number.id is null
  union all select item.doc_id, item.i, 0, w.no, null, [h.no], item.kind, ['[' || item.i || ']'] from item join number w on w.doc_id = item.doc_id and w.i = item.i and w.sub = 1000000 join number h on h.doc_id = item.doc_id and h.i = item.i and h.sub = 1
  union all select x.doc_id, x.i, n.sub, n.no, coalesce(u.no, w.no), coalesce((select list(k.no order by k.no) from number k join inside y on y.doc_id = k.doc_id and y.id = k.id where k.doc_id = x.doc_id and y.parent = x.id and y.i = x.i), []), x.kind,
      if(x.head and x.kind = 'list', [if(x.n_children = 0, '[]', '[0:' || x.n_children || ']')], x.path)
    from inside x join number n on n.doc_id = x.doc_id and n.id = x.id join number w on w.doc_id = x.doc_id and w.i = x.i and w.sub = 1000000 left join number u on u.doc_id = x.doc_id and u.id = x.parent and not x.head),
o as (select *, row_number() over (partition by doc_id order by i, sub) - 1 as ord from shards),
chained as (select doc_id, ord, lag(no) over w as before, lead(no) over w as after from o where data_type = 'list' window w as (partition by doc_id order by ord))
select o.doc_id, o.ord::int as ord, {_shard_name("no")} as shard_id, if(parent is null, null, {_shard_name("parent")}) as parent_id, to_json(list_transform(kids, lambda x: {_shard_name("x")}))::varchar as child_ids, data_type, to_json(path)::varchar as original_path,
  if(after is null, null, {_shard_name("after")}) as next_shard, if(before is null, null, {_shard_name("before")}) as previous_shard from o left join chained using (doc_id, ord)"""
)
def k23_mixed_lists(spark, d):
    """Lists with elements of several kinds, cut where the structure demands it and nowhere else, quirks kept."""
    s = _flat(sharding.shard(_mixed_lists(spark, d), 1 << 30, "reference", sort=False))
    return s.select("doc_id", "ord", "shard_id", "parent_id", "child_ids", "data_type", "original_path", "next_shard", "previous_shard")




@query(_OBJECTS + " select doc_id, version, max(original_size) as original_size, count(*)::int as shard_count, min(shard_id) filter (ord = 0) as root_shard, data_structure from shards group by all")
def s1_document_table(spark, d):
    docs = _objects(spark, d)
    return sharding.document_table(_object_shards(spark, d), docs)


@query(_OBJECTS + """ select doc_id, '{"version":"1.0.0","originalSize":' || max(original_size) || ',"shardCount":' || count(*) || ',"rootShard":"shard_001","createdAt":"2026-07-01T00:00:00","dataStructure":"' || data_structure || '"}' as text from shards group by doc_id, data_structure""")
def s9_global_metadata(spark, d):
    return sinks.global_metadata(s1_document_table(spark, d), "2026-07-01T00:00:00")


@query(f"with recursive {_DOCS} select count(*) as documents, true as equal from docs")
def s2_rebuilt(spark, d):
    """Whether cutting and joining gives every document back."""
    docs = _docs(spark, d)
    back = sharding.rebuild_corpus(sharding.shard(docs, LIMIT)).withColumnRenamed("json", "back")
    j = corpus.canonical(docs, sort=True).where("json is not null").join(back, "doc_id", "left")
    return j.agg(F.count("*").alias("documents"), F.bool_and(F.col("json").eqNullSafe(F.col("back"))).alias("equal"))


@query(
    """with rec as (select distinct run_id, shard_id, data_type, original_path from shard_meta)
select run_id, shard_id, array_to_string([shard_id] || list_filter(list_transform(coalesce(original_path, [])[-2:], lambda x: regexp_replace(regexp_replace(x, '[\\[\\]]', '', 'g'), '[:/\\\\]', '_', 'g')), lambda x: x <> '') || [coalesce(data_type, 'unknown')], '_') || '.json' as filename from rec"""
)
def s10_filenames(spark, d):
    rec = L.records(table(spark, d, "shard_meta"))
    return rec.select("run_id", "shard_id", sinks.filename().alias("filename"))


_NAME = """array_to_string([shard_id] || list_filter(list_transform(original_path[-2:], lambda x: regexp_replace(regexp_replace(x, '[\\[\\]]', '', 'g'), '[:/\\\\]', '_', 'g')), lambda x: x <> '') || [data_type], '_') || '.json'"""


@query(_OBJECTS + f" select doc_id, ord, shard_id, {_NAME} as filename, data_type as type, size, parent_id, to_json(child_ids)::varchar as child_ids, next_shard, previous_shard from shards")
def s11_index(spark, d):
    return sinks.index(_object_shards(spark, d)).withColumn("child_ids", F.to_json("child_ids"))


@query(_OBJECTS + " select doc_id, '1.0.0' as version, count(*) as total_shards, sum(size)::bigint as total_size from shards group by all")
def s11_totals(spark, d):
    return sinks.index_totals(_object_shards(spark, d))


# links


def _rec(spark, d):
    return L.records(table(spark, d, "shard_meta"))


_REC = """rec as materialized (select distinct run_id, shard_id, nullif(parent_id, '') as parent_id, coalesce(child_ids, []) as child_ids, data_type, original_path, nullif(next_shard, '') as next_shard, nullif(previous_shard, '') as previous_shard from shard_meta),
cl as (select run_id, shard_id, c as child_id, i - 1 as position from (select run_id, shard_id, unnest(child_ids) as c, generate_subscripts(child_ids, 1) as i from rec) where c <> '')"""
_ISSUES = f"""with recursive {_REC},
links as (select run_id, shard_id, 'parent' as kind, parent_id as other from rec where parent_id is not null union all select run_id, shard_id, 'next', next_shard from rec where next_shard is not null union all select run_id, shard_id, 'child', child_id from cl),
issues as (select distinct l.run_id, l.shard_id, case when o.shard_id is null then 'missing_' || kind when kind = 'child' and o.parent_id is distinct from l.shard_id then 'child_parent_mismatch' when kind = 'next' and o.previous_shard is distinct from l.shard_id then 'next_previous_mismatch' end as issue, other
  from links l left join rec o on o.run_id = l.run_id and o.shard_id = l.other
  union all select run_id, null, if(n = 0, 'no_root', 'several_roots'), null from (select run_id, count_if(parent_id is null) as n from rec group by all) where n <> 1)"""


@query(
    f"""with recursive {_REC} select run_id, shard_id, unnest(list_filter([if(not starts_with(shard_id, 'shard_'), 'no_prefix', null), if(parent_id = shard_id, 'own_parent', null), if(list_contains(child_ids, shard_id), 'own_child', null),
if(data_type is null or data_type not in ('dict', 'list', 'primitive'), 'bad_data_type', null), if(original_path is null, 'null_path', null), if(len(child_ids) > len(list_distinct(child_ids)) + if(list_contains(list_transform(child_ids, lambda x: x is null), true), 1, 0), 'repeated_child', null),
if(len(list_filter(child_ids, lambda x: x is null or x = '')) > 0, 'blank_child', null)], lambda x: x is not null)) as issue from rec"""
)
def g1_record_issues(spark, d):
    return L.record_issues(_rec(spark, d))


@query(_ISSUES + " select * from issues where issue is not null")
def g2_link_issues(spark, d):
    return L.link_issues(_rec(spark, d))


@query(_ISSUES + " select run_id, count_if(coalesce(issue in ('missing_child', 'child_parent_mismatch'), false)) = 0 as valid from (select distinct run_id from rec) left join issues using (run_id) group by all")
def g3_hierarchy_valid(spark, d):
    return L.hierarchy_valid(_rec(spark, d))


@query(
    f"""with recursive {_REC}, o as (select *, coalesce(try_cast(nullif(regexp_extract(shard_id, '(\\d{{1,15}})', 1), '') as bigint), 4611686018427387904) as num from rec where data_type = 'list'),
w as (select *, lag(shard_id) over (partition by run_id order by num, shard_id) as b, lead(shard_id) over (partition by run_id order by num, shard_id) as a from o)
select run_id, bool_and(next_shard is not distinct from a and previous_shard is not distinct from b) as valid from w group by all"""
)
def g4_order_valid(spark, d):
    return L.order_valid(_rec(spark, d))


@query(_TREE + """ select distinct doc_id, value ->> '$' as ref from nodes where key = '_shard_ref' and depth <= 2 and jt = 'VARCHAR' and not in_list_key(doc_id)""".replace(" and not in_list_key(doc_id)", " and (split_part(doc_id, '/', 1)::bigint, value ->> '$') not in (select (run_id, shard_id) from shard_meta)"))
def g5_references_in_data(spark, d):
    return L.references_in_data(_nodes(spark, d), _rec(spark, d))


@query(
    f"""with recursive {_REC}, o as (select *, coalesce(try_cast(nullif(regexp_extract(shard_id, '(\\d{{1,15}})', 1), '') as bigint), 4611686018427387904) as num from rec where data_type = 'list')
select run_id, shard_id, lag(shard_id) over w as previous_shard, lead(shard_id) over w as next_shard from o window w as (partition by run_id order by num, shard_id)"""
)
def g8_relinked(spark, d):
    return L.relink(_rec(spark, d))


@query(f"with recursive {_REC} select c.run_id, c.shard_id, c.position, c.child_id, r.data_type as child_type from cl c join rec r on r.run_id = c.run_id and r.shard_id = c.child_id")
def g10_children(spark, d):
    c = L.children(_rec(spark, d))
    return c.withColumn("position", F.col("position").cast("bigint"))


_NEXT = f"""with recursive {_REC},
walk as (select run_id, shard_id, [shard_id] as line, next_shard as nxt from rec
  union all select w.run_id, w.shard_id, list_append(w.line, w.nxt), r.next_shard from walk w join rec r on r.run_id = w.run_id and r.shard_id = w.nxt where not list_contains(w.line, w.nxt)),
far as (select *, case when nxt is null then 'end' when list_contains(line, nxt) then 'ring' else 'unknown' end as ending from walk w where nxt is null or list_contains(line, nxt) or not exists (from rec r where r.run_id = w.run_id and r.shard_id = w.nxt))"""


@query(
    _NEXT
    + """ select far.run_id, far.shard_id, rec.next_shard as next_id, if(ending = 'ring', list_min(line[list_position(line, nxt):]), line[-1]) as last_id, ending, if(ending = 'ring', list_position(line, nxt) - 1, len(line) - 1)::bigint as position,
len(line) + if(ending = 'unknown', 1, 0) as length from far join rec using (run_id, shard_id)"""
)
def g11_chains(spark, d):
    return L.chains(_rec(spark, d))


@query(f"with recursive {_REC} select run_id, shard_id, len(child_ids) > 0 as has_children, parent_id is null as is_root, len(child_ids) = 0 as is_leaf, coalesce(len(original_path), 0) as depth, if(len(original_path) > 0, array_to_string(original_path, '.'), 'root') as place from rec")
def v12_record_predicates(spark, d):
    return L.predicates(_rec(spark, d))


def _lists(df):
    return df.select("run_id", "shard_id", "parent_id", F.array_join(F.array_sort(F.filter("child_ids", lambda c: c.isNotNull())), "|").alias("child_ids"))


@query(f"with recursive {_REC}, more as (select run_id, parent_id as shard_id, list(distinct shard_id) as kids from rec where parent_id is not null group by all) select rec.run_id, rec.shard_id, parent_id, array_to_string(list_sort(list_filter(if(kids is null, child_ids, list_distinct(child_ids || kids)), lambda x: x is not null)), '|') as child_ids from rec left join more using (run_id, shard_id)")
def g7_established(spark, d):
    """Every parent that a record names made to list it (G7); lists sorted, without nulls."""
    rec = _rec(spark, d)
    return _lists(L.establish(rec, rec.where("parent_id is not null").select("run_id", "parent_id", F.col("shard_id").alias("child_id"))))


@query(f"with recursive {_REC}, stale as (select c.run_id, c.shard_id, list(distinct c.child_id) as kids from cl c join rec r on r.run_id = c.run_id and r.shard_id = c.child_id where r.parent_id is distinct from c.shard_id group by all) select rec.run_id, rec.shard_id, parent_id, array_to_string(list_sort(list_filter(child_ids, lambda x: x is not null and not coalesce(list_contains(kids, x), false))), '|') as child_ids from rec left join stale using (run_id, shard_id)")
def g9_detached(spark, d):
    """Children that name another parent, or none, taken off the lists."""
    rec = _rec(spark, d)
    stale = L.link_issues(rec).where("issue = 'child_parent_mismatch'").select("run_id", F.col("shard_id").alias("parent_id"), F.col("other").alias("child_id"))
    return _lists(L.detach(rec, stale))


@query(f"with recursive {_REC} select run_id, shard_id, case when lower(trim(data_type)) in ('dict', 'list', 'primitive') then lower(trim(data_type)) else data_type end as data_type, coalesce(next_shard, previous_shard) as next_shard from rec")
def g6_updated(spark, d):
    """Records after changes to some fields: spellings of types folded, missing next links filled with the previous ones."""
    rec = _rec(spark, d)
    t = F.lower(F.trim("data_type"))
    changes = rec.select("run_id", "shard_id", F.when(t.isin(*L.TYPES), t).alias("data_type"), F.when(F.col("next_shard").isNull(), F.col("previous_shard")).alias("next_shard"))
    return L.update(rec, changes).select("run_id", "shard_id", "data_type", "next_shard")


@query(_NEXT + " select run_id, shard_id as start_id, unnest(line) as shard_id, generate_subscripts(line, 1) - 1 as position from far where ending <> 'ring' and not exists (from rec r where r.run_id = far.run_id and r.next_shard = far.shard_id)")
def g11_chain_members(spark, d):
    c = L.chain_members(_rec(spark, d))
    return c.withColumn("position", F.col("position").cast("bigint"))


@query(
    _UP.replace("rec ", "known ").replace("rec r", "known r") + ", " + _REC + """,
links as (select run_id, shard_id, 'parent' as kind, parent_id as other from rec where parent_id is not null union all select run_id, shard_id, 'next', next_shard from rec where next_shard is not null
  union all select run_id, shard_id, 'previous', previous_shard from rec where previous_shard is not null union all select run_id, shard_id, 'child', child_id from cl),
bad as (select run_id, count(*) as errors from (select distinct l.run_id, l.shard_id, case when o.shard_id is null then 'missing_' || kind when kind = 'child' and o.parent_id is distinct from l.shard_id then 'child_parent_mismatch'
  when kind = 'next' and o.previous_shard is distinct from l.shard_id then 'next_previous_mismatch' when kind = 'parent' and not list_contains(o.child_ids, l.shard_id) then 'not_listed' end as issue, other
  from links l left join rec o on o.run_id = l.run_id and o.shard_id = l.other
  union all select run_id, null, 'no_root', null from rec group by run_id having count_if(parent_id is null) = 0) where issue is not null group by all),
rings as (select run_id, count(distinct list_min(line[list_position(line, cur):])) as cycles from ends where p is not null and list_contains(line[:-2], cur) and list_position(line, cur) = 1 group by all),
base as (select run_id, count(*) as shards, sum(len(child_ids))::bigint as relationships, count(next_shard) as sequential_links, count_if(parent_id is null and len(child_ids) = 0) as orphans from rec group by all)
select *, errors = 0 and cycles = 0 as valid from (select base.*, coalesce(errors, 0) as errors, coalesce(cycles, 0) as cycles from base left join bad using (run_id) left join rings using (run_id))"""
)
def g12_integrity(spark, d):
    return L.integrity(_rec(spark, d))


@query(_UP + " select run_id, list_min(line[list_position(line, cur):]) as head_id, count(*) as members from ends where p is not null and list_contains(line[:-2], cur) and list_position(line, cur) = 1 group by all")
def g13_cycles(spark, d):
    return L.cycles(_rec(spark, d))


_SUM = f"""with recursive {_REC}, s as (select run_id, count(*) as shards, count_if(data_type = 'dict') as dicts, count_if(data_type = 'list') as lists, count_if(data_type = 'primitive') as primitives, count_if(parent_id is null) as roots,
count_if(len(child_ids) = 0) as leaves, coalesce(max(len(original_path)), 0) as max_depth, count_if(len(child_ids) > 0) as relationships from rec group by all)"""


@query(_SUM + " select * from s")
def g14_summary(spark, d):
    return L.summary(_rec(spark, d))


@query(f"with recursive {_REC} select len(original_path) as depth, data_type, count(*) as n from rec group by all")
def g14_depths(spark, d):
    return L.depth_histogram(_rec(spark, d))


@query(f"with recursive {_REC} select distinct run_id, shard_id as src, child_id as dst, 'parent_child' as kind from cl union all select run_id, shard_id, next_shard, 'sequential' from rec where next_shard is not null")
def g15_edges(spark, d):
    return L.edges(_rec(spark, d))


@query(
    _NEXT + ", " + _SUM.removeprefix(f"with recursive {_REC}, ") + """, c as (select run_id, max(len(line) + if(ending = 'unknown', 1, 0)) as chain from far group by all)
select run_id, x.s as suggestion, x.p as priority, x.v as value from (select run_id, unnest([if(max_depth > 10, struct_pack(s := 'reduce_nesting', p := 'high', v := max_depth), null), if(roots > 5, struct_pack(s := 'consolidate_roots', p := 'medium', v := roots), null),
  if(leaves > shards * 0.8, struct_pack(s := 'balance_tree', p := 'low', v := leaves), null), if(chain > 20, struct_pack(s := 'break_long_chains', p := 'medium', v := chain), null)]) as x from s left join c using (run_id)) where x is not null"""
)
def g16_suggestions(spark, d):
    return L.suggestions(_rec(spark, d))


@query(_SUM + " select *, round(greatest(0.0, least(1.0, 1 - greatest(max_depth - 5, 0) * 0.05 - greatest(roots - 1, 0) * 0.1 - greatest(leaves / shards - 0.8, 0) * 0.5)), 6)::double as score from s")
def g17_efficiency(spark, d):
    return L.efficiency(L.summary(_rec(spark, d))).withColumn("score", F.round("score", 6))


@query(
    f"""with recursive {_REC}, one as (select run_id, shard_id, max(data) as data from file_shard group by all),
k as (select *, case when not coalesce(json_valid(data), false) then 'invalid' when json_type(data) = 'OBJECT' then 'dict' when json_type(data) = 'ARRAY' then 'list' else 'primitive' end as actual from one),
j as (select rec.*, data, actual, not starts_with(shard_id, 'shard_') or coalesce(parent_id = shard_id, false) or list_contains(child_ids, shard_id) or data_type is null or data_type not in ('dict', 'list', 'primitive') as bad from rec left join k using (run_id, shard_id)),
w as (select *, case when bad then 'lost' when data is null then 'missing' when actual = data_type or (data_type = 'primitive' and actual <> 'invalid') then 'kept' else 'rebuilt' end as state, '{{"_recovered":true,"_original_id":"' || shard_id || '"}}' as stub from j)
select run_id, shard_id, state, case when state = 'kept' then data when state = 'rebuilt' then case data_type when 'dict' then stub when 'list' then '[' || stub || ']' else '"_recovered_from_' || shard_id || '"' end end as data from w"""
)
def g18_recovered(spark, d):
    return L.recover(_rec(spark, d), table(spark, d, "file_shard"))


@query(
    f"""with recursive {_REC}, kept as (select c.run_id, c.shard_id, string_agg(c.child_id, '|' order by position) as kids from cl c join rec r on r.run_id = c.run_id and r.shard_id = c.child_id group by all)
select rec.run_id, rec.shard_id, p.shard_id as parent_id, n.shard_id as next_shard, q.shard_id as previous_shard, coalesce(kids, '') as child_ids from rec left join rec p on p.run_id = rec.run_id and p.shard_id = rec.parent_id
left join rec n on n.run_id = rec.run_id and n.shard_id = rec.next_shard left join rec q on q.run_id = rec.run_id and q.shard_id = rec.previous_shard left join kept on kept.run_id = rec.run_id and kept.shard_id = rec.shard_id"""
)
def g20_repaired(spark, d):
    return L.repair(_rec(spark, d)).select("run_id", "shard_id", "parent_id", "next_shard", "previous_shard", F.array_join("child_ids", "|").alias("child_ids"))


@query(
    """with o as (select log_id, any_value(lower(trim(error_type))) as error_type, any_value(case when lower(trim(severity)) like 'warn%' then 'warning' when lower(trim(severity)) like 'err%' then 'error' else lower(trim(severity)) end) as severity from validation_log group by 1)
select error_type, severity, count(*) as n, coalesce(error_type in ('memory', 'corruption', 'filesystem'), false) as can_recover, coalesce(case error_type when 'memory' then 'reduce_limit' when 'corruption' then 'recover' when 'filesystem' then 'check_permissions' when 'circular' then 'remove_references' end, 'check_logs') as action from o group by all"""
)
def g21_error_advice(spark, d):
    return L.advise_errors(table(spark, d, "validation_log"))


@query(
    f"""with recursive {_REC}, z as (select run_id, shard_id, max(octet_length(encode(data))) as size from file_shard group by all)
select run_id, shard_id, data_type, if(len(original_path) > 0, array_to_string(original_path, '.'), 'root') as place, parent_id, len(child_ids) as n_children, size from rec left join z using (run_id, shard_id)"""
)
def g22_references(spark, d):
    return L.references(_rec(spark, d), table(spark, d, "file_shard"))


# statistics


def _stored(spark, d):
    one = table(spark, d, "file_shard").groupBy("run_id", "shard_id").agg(F.max(F.octet_length("data")).cast("bigint").alias("size"))
    return one.join(_rec(spark, d).select("run_id", "shard_id", "data_type"), ["run_id", "shard_id"], "left")


_STAT = """with one as (select run_id, shard_id, max(octet_length(encode(data))) as size from file_shard group by all), r as (select distinct run_id, shard_id, data_type from shard_meta),
s as (select run_id, count(*) as shards, coalesce(sum(size), 0)::bigint as total_size, avg(size) as average_size, min(size) as min_size, max(size) as max_size, count_if(size < 5000) as small, count_if(size >= 5000 and size < 15000) as medium,
count_if(size >= 15000 and size < 25000) as large, count_if(size >= 25000) as oversized, count_if(data_type = 'dict') as dicts, count_if(data_type = 'list') as lists, count_if(data_type = 'primitive') as primitives from one left join r using (run_id, shard_id) group by all)"""


@query(_STAT + " select *, round(total_size / (shards * 25000), 6) as efficiency from s")
def a1_shard_statistics(spark, d):
    return A.shard_statistics(_stored(spark, d), ["run_id"], "size", "data_type")


@query(_STAT + " select run_id, least(1.0, round(average_size * 1.2 / 25000, 6))::double as tuned from s")
def a9_tuned_score(spark, d):
    return A.tuned_score(A.shard_statistics(_stored(spark, d), ["run_id"], "size", "data_type"), 25000).select("run_id", F.round("tuned", 6).alias("tuned"))


@query(f"with recursive {_DOCS} select split_part(doc_id, '/', 1)::bigint as run_id, count(*) as list_shards, sum(json_array_length(data))::bigint as items, round(avg(json_array_length(data)), 6) as average_items from docs where json_type(data) = 'ARRAY' group by all")
def a3_list_statistics(spark, d):
    return A.list_statistics(_docs(spark, d))


@query(f"with recursive {_DOCS} select split_part(doc_id, '/', 1)::bigint as run_id, coalesce(json_extract_string(data, '$._processor'), 'mixed_processor') as processor, count(*) as shards, sum(octet_length(encode(json(data)::varchar)))::bigint as bytes from docs group by all")
def a4_processor_statistics(spark, d):
    return A.processor_statistics(_docs(spark, d))


_RUNS = "(select distinct * replace (lower(trim(operation_name)) as operation_name) from run_metrics)"


@query(
    f"""select operation_name as operation, count(*) as operations, round(sum(duration), 3) as total_duration, round(coalesce(sum(input_size), 0) / 1048576, 6) as input_mb, round(coalesce(sum(output_size), 0) / 1048576, 6) as output_mb, sum(shards_created)::bigint as shards,
round(avg(throughput_mbps), 6) as throughput, round(avg(memory_peak_mb), 6) as memory_peak, round(avg(cpu_percent), 6) as cpu, round(if(sum(input_size) > 0, sum(output_size) / sum(input_size), 1.0), 6) as ratio from {_RUNS} group by all"""
)
def a5_performance(spark, d):
    return A.performance(table(spark, d, "run_metrics"))


@query(
    f"""with h as (select operation_name as operation, max(memory_peak_mb) as peak, avg(memory_peak_mb) as memory, avg(throughput_mbps) as mbps, avg(compression_ratio) as ratio, avg(shards_created) as shards from {_RUNS} group by all),
r as (select operation, unnest([if(peak > 2000, struct_pack(s := 'reduce_chunk_size', v := peak), null), if(memory > 1000, struct_pack(s := 'smaller_batches', v := memory), null), if(mbps < 1.0, struct_pack(s := 'enable_parallel', v := mbps), null), if(ratio > 1.5, struct_pack(s := 'optimize_structure', v := ratio), null),
  if(shards > 100, struct_pack(s := 'increase_chunk_size', v := shards), null), if(shards < 2, struct_pack(s := 'decrease_chunk_size', v := shards), null)]) as x from h)
select operation, x.s as suggestion, round(x.v, 6) as value from r where x is not null union all select operation, 'looks_optimal', null from h where operation not in (select operation from r where x is not null)"""
)
def n9_history_advice(spark, d):
    return A.history_advice(table(spark, d, "run_metrics"))


@query(SQL["n9_history_advice"].replace("unnest([if(peak", "unnest(list_filter([if(peak").replace("v := shards), null)]) as x from h)", "v := shards), null)], lambda x: x is not null)[:3]) as x from h)"))
def a8_top_advice(spark, d):
    """The first three suggestions for each operation."""
    return A.history_advice(table(spark, d, "run_metrics"), 3)


@query(f"select operation_name, run_id, duration, coalesce(shards_created, 0) as shards_created from {_RUNS} where duration is not null")
def m2_metrics(spark, d):
    return A.distinct_runs(table(spark, d, "run_metrics")).where("duration is not null").select("operation_name", "run_id", "duration", F.coalesce("shards_created", F.lit(0)).alias("shards_created"))


@query(
    """select distinct run_id, concat_ws(',', coalesce(operation_name, ''), coalesce(duration::decimal(20, 6)::varchar, ''), coalesce(input_size::varchar, ''), coalesce(output_size::varchar, ''), coalesce(memory_peak_mb::decimal(20, 6)::varchar, ''), coalesce(throughput_mbps::decimal(20, 6)::varchar, ''),
coalesce(shards_created::varchar, ''), coalesce(compression_ratio::decimal(20, 6)::varchar, '')) as line from run_metrics"""
)
def m2_export(spark, d):
    return metrics.export_rows(table(spark, d, "run_metrics")).distinct()


@query("select run_id, shard_id, case when size is null or size <= 0 then 'error' when size < 1024 or size > 104857600 then 'warning' end as issue from (select distinct run_id, shard_id, size from file_shard)")
def v8_limits(spark, d):
    """The check of limits, for each shard's size taken as one."""
    return table(spark, d, "file_shard").select("run_id", "shard_id", "size").distinct().select("run_id", "shard_id", Z.limit_issue("size").alias("issue"))


@query(
    """with docs as (select distinct run_id || '/' || shard_id as doc_id, data from file_shard), v as (select *, if(json_valid(data), data, null) as j from docs)
select doc_id, case json_type(j) when 'OBJECT' then 'dict with ' || len(json_keys(j)) || ' keys' when 'ARRAY' then 'list with ' || json_array_length(j) || ' items' when 'VARCHAR' then 'str: ' || substring(j ->> '$', 1, 50) || '...' when 'BOOLEAN' then 'bool: ' || if((j ->> '$') = 'true', 'True', 'False') || '...'
  when 'NULL' then 'NoneType: None...' when 'DOUBLE' then 'float: ' || (j ->> '$') || '...' else case when j is not null then 'int: ' || (j ->> '$') || '...' end end as summary from v"""
)
def d10_summaries(spark, d):
    return A.summaries(_docs(spark, d))


@query(_OBJECTS + f", f as (select case when starts_with({_NAME}, '_') then 'metadata' else data_type end as kind, size from shards) select kind, count(*) as files, sum(size)::bigint as bytes, avg(size) as average, round(sum(size) / 1048576, 6) as mb from f group by all")
def s15_file_statistics(spark, d):
    """Files and bytes by class of name, over the names and estimated sizes of an index."""
    i = sinks.index(_object_shards(spark, d))
    return sinks.file_statistics(i.select(F.concat_ws("/", F.lit("out"), "doc_id", "filename").alias("path"), F.col("size").alias("length")))


@query(_OBJECTS + " select doc_id, shard_id, true as metadata_same, data from shards")
def s16_file_schema(spark, d):
    """Shards written as the text of their file and read back."""
    s = _object_shards(spark, d).withColumn("back", sinks.read_file_text(sinks.file_text()))
    same = [F.col(f"back.metadata.{c}").eqNullSafe(F.col(c)) for c in sinks.META]
    return s.select("doc_id", "shard_id", F.least(*same).alias("metadata_same"), "data").where("back is not null")


@query("with s as (" + SQL["k21_customer_shards"] + ") select doc_id, count(*) as files, 0::bigint as failed, true as full_size from s group by all")
def s6_written(spark, d):
    """Shards of the customers' documents written to shared storage, one file each (S6, S8): files, failures, and whether each is at least as long as its data."""
    docs = corpus.from_orders(table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "customer"))
    shards = sharding.shard(docs, LIMIT)
    out = sinks.write_files(shards, f"{shared_dir(spark).removeprefix('file:')}/written-{uuid4().hex}")
    j = out.join(shards.select("doc_id", "shard_id", F.octet_length("data").alias("least")), ["doc_id", "shard_id"])
    return j.groupBy("doc_id").agg(F.count("bytes").alias("files"), F.count("error").alias("failed"), F.bool_and(F.col("bytes") > F.col("least")).alias("full_size"))
