"""Structure analysis of documents, statistics of shards and runs, and advice: aggregates over the node table and shard tables."""

from __future__ import annotations

from sys import getsizeof

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sizes as Z
from ..functions.jsonnodes import compact, strict_parse
from ..sources import corpus as C

ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


# validation


def validate(docs: DataFrame) -> DataFrame:
    """(doc_id, severity, error_type, message): SYNTAX and STRUCTURE errors, and a warning for documents deeper than 20."""
    bad = C.canonical(docs).where("error_type is not null").select("doc_id", F.lit("error").alias("severity"), "error_type", "message")
    deep = C.nodes(docs).groupBy("doc_id").agg(F.max("depth").alias("d")).where("d > 20")
    return bad.unionByName(deep.select("doc_id", F.lit("warning").alias("severity"), F.lit("STRUCTURE").alias("error_type"), F.format_string("nested %d deep", "d").alias("message")))


def validate_input(docs: DataFrame) -> DataFrame:
    """(doc_id, is_valid, error_type, message) of every document: whether it can be cut at all."""
    return C.canonical(docs).select("doc_id", F.col("error_type").isNull().alias("is_valid"), "error_type", "message")


def depths(nodes: DataFrame) -> DataFrame:
    """(doc_id, depth): deepest value; scalars at the root and empty containers have depth 0."""
    return nodes.groupBy("doc_id").agg(F.max("depth").cast("bigint").alias("depth"))


def preflight(nodes: DataFrame, limit: int) -> DataFrame:
    """(doc_id, spaced_size, depth, large_values, too_large, too_deep): warnings before processing; large values are above half the limit, the root left out."""
    big = (F.col("depth") > 0) & (F.col("spaced_size") > limit // 2)
    a = nodes.groupBy("doc_id").agg(F.max(F.when(F.col("depth") == 0, F.col("spaced_size"))).alias("spaced_size"), F.max("depth").cast("bigint").alias("depth"), F.count_if(big).alias("large_values"))
    return a.withColumns({"too_large": F.col("spaced_size") > 1000 * limit, "too_deep": F.col("depth") > 10})


def large_values(nodes: DataFrame, threshold: int) -> DataFrame:
    """(doc_id, place, size) of values above the threshold, spaced sizes, the root left out."""
    return nodes.where((F.col("depth") > 0) & (F.col("spaced_size") > threshold)).select("doc_id", F.to_json("path").alias("place"), F.col("spaced_size").alias("size"))


def summaries(docs: DataFrame) -> DataFrame:
    """(doc_id, summary) of each document: `dict with 3 keys`, `list with 2 items`, else the type of the scalar and its first fifty characters; null for invalid texts."""

    def told(text: str | None) -> str | None:
        v, error, _ = strict_parse(text)
        if isinstance(v, dict):
            return f"dict with {len(v)} keys"
        if isinstance(v, list):
            return f"list with {len(v)} items"
        return f"{type(v).__name__}: {str(v)[:50]}..." if error == "STRUCTURE" else None

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([told(x) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "summary"])

    return docs.select("doc_id", "json").mapInArrow(run, "doc_id string, summary string")


def has_nested(nodes: DataFrame) -> DataFrame:
    """(doc_id, nested): whether the root holds an object or a list."""
    return nodes.where("depth <= 1").groupBy("doc_id").agg(F.bool_or((F.col("depth") == 1) & (F.col("kind") != "primitive")).alias("nested"))


def heavy_items(nodes: DataFrame, limit: int) -> DataFrame:
    """(doc_id, node, type, heavy) of the containers that are elements of root lists: whether they are to get shards of their own.

    They are if they take more than three tenths of the limit, have more than ten members (objects) or twenty elements
    (lists), or hold a container.
    """
    item = nodes.where("depth = 1 and pos is not null and kind <> 'primitive'")
    full = nodes.where("depth = 2 and kind <> 'primitive'").select("doc_id", F.col("parent").alias("node")).distinct().withColumn("full", F.lit(True))
    much = F.when(F.col("kind") == "dict", 10).otherwise(20)
    heavy = (F.col("compact_size") > limit * 0.3) | (F.col("n_children") > much) | F.col("full").isNotNull()
    return item.join(full, ["doc_id", "node"], "left").select("doc_id", "node", F.col("kind").alias("type"), heavy.alias("heavy"))


# structure


def _roots(nodes: DataFrame, threshold: int = 1 << 62) -> DataFrame:
    """`children_of_root` with the root's spaced size and the number of containers above the threshold: one pass over the nodes."""
    big = F.count_if((F.col("kind") != "primitive") & (F.col("spaced_size") > threshold))
    top = nodes.groupBy("doc_id", F.get("path", F.lit(0)).alias("seg")).agg(
        F.min_by("kind", "node").alias("kind"), (F.max("depth") - 1).cast("bigint").alias("deep"), F.max(F.when(F.col("depth") == 0, F.col("n_children"))).alias("n"), F.max(F.when(F.col("depth") == 0, F.col("spaced_size"))).alias("size"), big.alias("big")
    )
    k, root = F.col("kind"), F.col("seg").isNull()
    deep = F.when(~root, F.col("deep"))
    per = top.groupBy("doc_id").agg(
        F.max(F.when(root, k)).alias("root_kind"), F.max("n").alias("n"), *(F.count_if(~root & (k == x)).alias(f"{x}s") for x in ("dict", "list", "primitive")),
        F.min(deep).alias("min_depth"), F.max(deep).alias("max_depth"), F.avg(deep).alias("avg_depth"), F.max("size").alias("spaced_size"), F.sum("big").alias("candidates"),
    )
    return per.fillna(0, ["min_depth", "max_depth", "avg_depth"])


def children_of_root(nodes: DataFrame) -> DataFrame:
    """(doc_id, root_kind, n, dicts, lists, primitives, min_depth, max_depth, avg_depth) of each document's root; depths are those of its values."""
    return _roots(nodes).drop("spaced_size", "candidates")


def _kinds() -> Column:
    return (F.col("dicts") > 0).cast("int") + (F.col("lists") > 0).cast("int") + (F.col("primitives") > 0).cast("int")


def classify(roots: DataFrame) -> DataFrame:
    """`children_of_root` with the class that decides the sharding plan, and the advisory class.

    structure: an object is dict-of-dicts from seven tenths of objects on, or if it holds scalars only; a list with
    elements of several kinds is mixed. advisory: eight tenths of objects or of scalars.
    """
    d, p = ratio("dicts", "n"), ratio("primitives", "n")
    is_list = F.col("root_kind") == "list"
    flat = (F.col("dicts") == 0) & (F.col("lists") == 0)
    structure = F.when(is_list, F.when(_kinds() > 1, "mixed").otherwise("list")).otherwise(F.when((F.col("n") == 0) | (d >= 0.7) | flat, "dict-of-dicts").otherwise("mixed"))
    advisory = F.when(is_list, F.when(_kinds() > 1, "mixed").otherwise("list")).otherwise(F.when((F.col("n") == 0) | (d >= 0.8) | (p >= 0.8), "dict-of-dicts").otherwise("mixed"))
    return roots.withColumns({"structure": structure, "advisory": advisory})


def patterns(roots: DataFrame) -> DataFrame:
    """`classify` with shares by kind and whether all values are of one kind (so empty roots are)."""
    return classify(roots).withColumns({"dict_ratio": ratio("dicts", "n"), "list_ratio": ratio("lists", "n"), "primitive_ratio": ratio("primitives", "n"), "homogeneous": _kinds() <= 1})


def nested(nodes: DataFrame) -> DataFrame:
    """(doc_id, node, place, type, size, depth) of every container, the root included; `node` orders them."""
    return nodes.where("kind <> 'primitive'").select("doc_id", "node", F.to_json("path").alias("place"), F.col("kind").alias("type"), F.col("n_children").alias("size"), F.col("depth").cast("bigint").alias("depth"))


def value_at(docs: DataFrame, path: list[str]) -> DataFrame:
    """(doc_id, value): JSON text of the value at a path of names and `[i]`, null where there is none."""
    step = "".join(f"[{s[1:-1]}]" if s[:1] == "[" and s[1:-1].isdigit() else "['" + s.replace("\\", "\\\\").replace("'", "\\'") + "']" for s in path)
    v = F.try_parse_json("json")
    return docs.select("doc_id", F.to_json(F.try_variant_get(v, f"${step}", "variant")).alias("value"))


def object_nesting(nodes: DataFrame) -> DataFrame:
    """(doc_id, level): how deep objects lie in objects, lists not entered; 0 for an object of scalars."""
    return nodes.where("kind = 'dict' and not in_list").groupBy("doc_id").agg(F.max("depth").cast("bigint").alias("level"))


def type_histogram(nodes: DataFrame) -> DataFrame:
    """(doc_id, type, n, largest): elements of root lists by type, with the largest compact size."""
    lists = nodes.where("depth = 1 and pos is not null")
    return lists.groupBy("doc_id", F.when(F.col("kind") == "primitive", F.col("scalar_type")).otherwise(F.col("kind")).alias("type")).agg(F.count("*").alias("n"), F.max("compact_size").alias("largest"))


def mixed_analysis(nodes: DataFrame) -> DataFrame:
    """(doc_id, dicts, lists, primitives, max_depth, score): over values within the first five elements of every list.

    score, at most 10: half a point for each kind, 0.3 for each level, one for over a hundred values, half for each
    level with several kinds.
    """
    s = nodes.where("sampled")
    level = s.groupBy("doc_id", "depth").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("dict", "list", "primitive")))
    kinds = sum(((F.col(k) > 0).cast("int") for k in ("dict", "list", "primitive")), F.lit(0))
    a = level.groupBy("doc_id").agg(
        F.sum("dict").alias("dicts"), F.sum("list").alias("lists"), F.sum("primitive").alias("primitives"), F.max("depth").cast("bigint").alias("max_depth"), F.count_if(kinds > 1).alias("blended")
    )
    total = F.col("dicts") + F.col("lists") + F.col("primitives")
    score = _kinds() * 0.5 + F.col("max_depth") * 0.3 + F.when(total > 100, 1.0).otherwise(0.0) + F.col("blended") * 0.5
    return a.withColumn("score", F.round(F.least(F.lit(10.0), score), 6)).drop("blended")


def _advisory_score() -> Column:
    s = F.col("max_depth") * 0.3 + F.when(F.col("homogeneous"), 0.0).otherwise(0.5) + F.when(F.col("advisory") == "mixed", 0.7).otherwise(0.0) + F.when(F.col("n") > 100, 0.4).otherwise(0.0)
    return F.round(F.least(F.lit(5.0), F.when(F.col("n") > 0, s).otherwise(0.0)), 6)


def advisory_score(roots: DataFrame) -> DataFrame:
    """(doc_id, advisory, score), at most 5: 0.3 for each level, 0.5 if not of one kind, 0.7 if mixed, 0.4 for over a hundred values; 0 for empty roots."""
    return patterns(roots).select("doc_id", "advisory", _advisory_score().alias("score"))


def statistics(nodes: DataFrame) -> DataFrame:
    """(doc_id, dicts, lists, primitives, keys, items, spaced_size, depth) of each document."""
    k = F.col("kind")
    return nodes.groupBy("doc_id").agg(
        F.count_if(k == "dict").alias("dicts"), F.count_if(k == "list").alias("lists"), F.count_if(k == "primitive").alias("primitives"),
        F.sum(F.when(k == "dict", F.col("n_children")).otherwise(0)).alias("keys"), F.sum(F.when(k == "list", F.col("n_children")).otherwise(0)).alias("items"),
        F.max(F.when(F.col("depth") == 0, F.col("spaced_size"))).alias("spaced_size"), F.max("depth").cast("bigint").alias("depth"),
    )


def size_breakdown(nodes: DataFrame) -> DataFrame:
    """(doc_id, compact, spaced, formatted, schema, file, pretty_gain) of each document."""
    r = nodes.where("depth = 0")
    return r.select("doc_id", F.col("compact_size").alias("compact"), F.col("spaced_size").alias("spaced"), F.col("formatted_size").alias("formatted"), Z.schema_size("compact_size").alias("schema"), Z.file_size("nested_size").alias("file"), (F.col("formatted_size") - F.col("compact_size")).alias("pretty_gain"))


def document_facts(documents: DataFrame, now: str, threshold: int = 10 << 20) -> DataFrame:
    """(run_id, kb, mb, average_shard, age_hours, large) of the rows of doc_meta, repeated ones once; no shards give no average."""
    one = documents.groupBy("run_id").agg(F.max("original_size").alias("b"), F.max("shard_count").alias("n"), F.min("created_at").alias("t"))
    hours = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("t").cast("timestamp"))) / 3_600_000_000
    return one.select("run_id", F.round(F.col("b") / 1024, 6).alias("kb"), F.round(F.col("b") / 1048576, 6).alias("mb"), F.when(F.col("n") > 0, F.round(F.col("b") / F.col("n"), 6)).alias("average_shard"), F.round(hours, 6).alias("age_hours"), Z.is_large("b", threshold).alias("large"))


def compression_potential(docs: DataFrame) -> DataFrame:
    """(doc_id, original_size, optimized_size, ratio, gzip, lz4, zstd, algorithm) of each valid document; sizes in characters with escapes.

    Sorting keys, which is all that is done, changes no length, so the ratio is one; those of the algorithms are usual ones.
    """
    n = Z.escaped_length("json")
    rows = C.canonical(docs).where("json is not null").select("doc_id", n.alias("original_size"))
    return rows.select("doc_id", "original_size", F.col("original_size").alias("optimized_size"), F.lit(1.0).alias("ratio"), F.lit(0.3).alias("gzip"), F.lit(0.5).alias("lz4"), F.lit(0.25).alias("zstd"), F.when(F.col("original_size") > 50000, "zstd").otherwise("lz4").alias("algorithm"))


def memory_usage(docs: DataFrame) -> DataFrame:
    """(doc_id, shallow, deep, json_size, ratio): bytes of the parsed objects of each valid document in the Python that runs here, beside its compact text."""

    def size(v: object) -> int:
        total, todo = 0, [v]
        while todo:
            x = todo.pop()
            total += getsizeof(x)
            if isinstance(x, dict):
                total += sum(map(getsizeof, x))
                todo += x.values()
            elif isinstance(x, list):
                todo += x
        return total

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v, error, _ = strict_parse(text)
                if not error:
                    n = len(compact(v).encode())
                    rows.append((doc, getsizeof(v), size(v), n))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "shallow", "deep", "json_size"])

    rows = docs.select("doc_id", "json").mapInArrow(run, "doc_id string, shallow bigint, deep bigint, json_size bigint")
    return rows.withColumn("ratio", F.col("deep") / F.col("json_size"))


# advice


def candidates(nodes: DataFrame, threshold: int) -> DataFrame:
    """(doc_id, node, place, type, size, n_children, priority) of containers above the threshold, spaced.

    priority: size over threshold, up to one for children by the hundred, 0.2 for objects, less a tenth a level; 0.1 at
    least. Highest first within a document, ties in pre-order (`node`).
    """
    p = F.col("spaced_size") / threshold + F.least(F.col("n_children") / 100, F.lit(1.0)) + F.when(F.col("kind") == "dict", 0.2).otherwise(0.0) - F.col("depth") * 0.1
    rows = nodes.where((F.col("kind") != "primitive") & (F.col("spaced_size") > threshold))
    return rows.select("doc_id", "node", F.to_json("path").alias("place"), F.col("kind").alias("type"), F.col("spaced_size").alias("size"), "n_children", F.round(F.greatest(F.lit(0.1), p), 6).alias("priority"))


def top_candidates(found: DataFrame, k: int = 5) -> DataFrame:
    """The k first candidates of each document by priority: a top-k report."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("priority"), "node")
    return found.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def recommend(nodes: DataFrame, limit: int) -> DataFrame:
    """(doc_id, structure, advisory, processor, candidates, shards, score, strategy): the whole advice for each document."""
    roots = _roots(nodes, limit // 2)
    p = patterns(roots)
    j = p.select("doc_id", "structure", "advisory", "candidates", Z.plain_estimate("spaced_size", limit).alias("shards"), _advisory_score().alias("score"))
    processor = F.when(F.col("advisory") == "dict-of-dicts", "dict_processor").when(F.col("advisory") == "list", "list_processor").otherwise("mixed_processor")
    strategy = (
        F.when(F.col("candidates") == 0, "simple_sharding").when(F.col("score") > 3, "complex_hierarchical").when(F.col("candidates") > 10, "aggressive_sharding")
        .when(F.col("advisory") == "mixed", "mixed_strategy").otherwise("standard_sharding")
    )
    return j.select("doc_id", "structure", "advisory", processor.alias("processor"), "candidates", "shards", "score", strategy.alias("strategy"))


def _suggest(df: DataFrame, rules: list[tuple[Column, str, Column]]) -> DataFrame:
    hits = F.filter(F.array(*(F.when(t, F.struct(F.lit(n).alias("suggestion"), v.cast("double").alias("value"))) for t, n, v in rules)), lambda x: x.isNotNull())
    return df.select("doc_id", F.inline(hits))


def _overview(nodes: DataFrame, limit: int, share: float) -> DataFrame:
    """What the advice needs of each document, in one pass: its root, values above a share of the limit, containers and types among them, object nesting."""
    k, top, root = F.col("kind"), F.col("depth") == 1, F.col("depth") == 0
    text = F.when(F.col("scalar_type") == "str", F.from_json(F.concat(F.lit("["), "raw", F.lit("]")), "array<string>")[0]).otherwise(F.col("raw"))
    size = F.when(k == "primitive", Z.scalar_size(text, "scalar_type")).otherwise(F.col("compact_size"))
    large = F.when(top & (size > limit * share), size)
    return nodes.groupBy("doc_id").agg(
        F.max(F.when(root, k)).alias("root"), F.max(F.when(root, F.col("n_children"))).alias("n"), F.max(F.when(root, Z.file_size("nested_size"))).alias("size"),
        F.count(large).alias("large"), F.coalesce(F.sum(large), F.lit(0)).alias("large_bytes"), F.count_if(top & (k != "primitive")).alias("containers"),
        F.size(F.collect_set(F.when(top, F.coalesce("scalar_type", "kind")))).alias("types"), F.max(F.when((k == "dict") & ~F.col("in_list"), F.col("depth"))).alias("level"),
    )


def dict_advice(nodes: DataFrame, limit: int) -> DataFrame:
    """(doc_id, suggestion, value) for object roots: large values, deep nesting, many keys."""
    j = _overview(nodes, limit, 0.5).where("root = 'dict'")
    return _suggest(j, [(F.col("large") > 0, "split_large_values", F.col("large")), (F.col("level") > 5, "flatten_deep_nesting", F.col("level")), (F.col("n") > 1000, "group_related_keys", F.col("n"))])


def list_advice(nodes: DataFrame, limit: int) -> DataFrame:
    """(doc_id, suggestion, value) for list roots: large elements, several types, containers, many elements."""
    j = _overview(nodes, limit, 0.5).where("root = 'list' and n > 0")
    return _suggest(j, [(F.col("large") > 0, "split_large_items", F.col("large")), (F.col("types") > 1, "group_similar_items", F.col("types")), (F.col("containers") > 0, "flatten_nested_structures", F.col("containers")), (F.col("n") > 10000, "batch_processing", F.col("n"))])


def size_advice(nodes: DataFrame, limit: int) -> DataFrame:
    """(doc_id, suggestion, value) for documents over the limit, value the bytes that may be saved."""
    j = _overview(nodes, limit, 0.3).where(F.col("size") > limit)
    over = F.col("size") - limit
    return _suggest(j, [((F.col("root") == "dict") & (F.col("large") > 0), "split_large_values", F.col("large_bytes") * 0.5), ((F.col("root") == "list") & (F.col("n") > 10), "split_list", F.round(F.col("size") * 0.6, 6)), (over < F.col("size") * 0.1, "remove_formatting", F.round(F.col("size") * Z.OVERHEAD_SHARE, 6))])


# shards and runs


def shard_statistics(shards: DataFrame, keys: list[str], size: str, kind: str, target: int = 25000) -> DataFrame:
    """Counts, sizes, size classes, kinds and efficiency of shards by `keys`; null sizes count in no size."""
    s = F.col(size)
    return shards.groupBy(*keys).agg(
        F.count("*").alias("shards"), F.coalesce(F.sum(s), F.lit(0)).cast("bigint").alias("total_size"), F.avg(s).alias("average_size"), F.min(s).alias("min_size"), F.max(s).alias("max_size"),
        F.count_if(s < 5000).alias("small"), F.count_if((s >= 5000) & (s < 15000)).alias("medium"), F.count_if((s >= 15000) & (s < 25000)).alias("large"), F.count_if(s >= 25000).alias("oversized"),
        *(F.count_if(F.col(kind) == k).alias(f"{k}s") for k in ("dict", "list", "primitive")),
    ).withColumn("efficiency", F.round(Z.efficiency("total_size", "shards", target), 6))


def tuned_score(stats: DataFrame, limit: int) -> DataFrame:
    """Score of the pipeline: 1.2 times the average size over the limit, at most one."""
    return stats.withColumn("tuned", F.least(F.lit(1.0), F.col("average_size") * 1.2 / limit))


def list_statistics(docs: DataFrame) -> DataFrame:
    """(run_id, list_shards, items, average_items) of the documents `run_id/shard_id` whose root is a list."""
    lists = C.canonical(docs).where("json like '[%'")
    one = lists.select(F.split("doc_id", "/")[0].cast("bigint").alias("run_id"), F.json_array_length("json").cast("bigint").alias("n"))
    return one.groupBy("run_id").agg(F.count("*").alias("list_shards"), F.sum("n").alias("items"), F.round(F.avg("n"), 6).alias("average_items"))


def processor_statistics(docs: DataFrame) -> DataFrame:
    """(run_id, processor, shards, bytes): documents `run_id/shard_id` by the processor they name at their top level, else mixed; invalid ones left out."""
    p = F.coalesce(F.get_json_object("json", "$._processor"), F.lit("mixed_processor"))
    one = C.canonical(docs).where("json is not null").select(F.split("doc_id", "/")[0].cast("bigint").alias("run_id"), p.alias("processor"), F.octet_length("json").alias("b"))
    return one.groupBy("run_id", "processor").agg(F.count("*").alias("shards"), F.sum("b").cast("bigint").alias("bytes"))


def _operation() -> Column:
    return F.lower(F.trim("operation_name")).alias("operation")


def distinct_runs(metrics: DataFrame) -> DataFrame:
    """Each distinct row of run_metrics once, the spelling of the operation folded."""
    return metrics.withColumn("operation_name", F.lower(F.trim("operation_name"))).distinct()


def performance(metrics: DataFrame) -> DataFrame:
    """Totals and means of the runs by operation; nulls count in no mean; no input gives ratio 1."""
    mb = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0)) / 1048576, 6)
    mean = lambda c: F.round(F.avg(c), 6)
    return distinct_runs(metrics).groupBy(_operation()).agg(
        F.count("*").alias("operations"), F.round(F.sum("duration"), 3).alias("total_duration"), mb("input_size").alias("input_mb"), mb("output_size").alias("output_mb"), F.sum("shards_created").cast("bigint").alias("shards"),
        mean("throughput_mbps").alias("throughput"), mean("memory_peak_mb").alias("memory_peak"), mean("cpu_percent").alias("cpu"),
        F.round(F.when(F.sum("input_size") > 0, F.sum("output_size") / F.sum("input_size")).otherwise(1.0), 6).alias("ratio"),
    )


def history_advice(metrics: DataFrame, first: int | None = None) -> DataFrame:
    """(operation, suggestion, value): what the history of an operation suggests; `looks_optimal` if nothing. first: only so many suggestions for each, in the order of the rules."""
    h = distinct_runs(metrics).groupBy(_operation()).agg(F.max("memory_peak_mb").alias("peak"), F.avg("memory_peak_mb").alias("memory"), F.avg("throughput_mbps").alias("mbps"), F.avg("compression_ratio").alias("ratio"), F.avg("shards_created").alias("shards"))
    rules = [(F.col("peak") > 2000, "reduce_chunk_size", "peak"), (F.col("memory") > 1000, "smaller_batches", "memory"), (F.col("mbps") < 1.0, "enable_parallel", "mbps"), (F.col("ratio") > 1.5, "optimize_structure", "ratio"), (F.col("shards") > 100, "increase_chunk_size", "shards"), (F.col("shards") < 2, "decrease_chunk_size", "shards")]
    hits = F.filter(F.array(*(F.when(t, F.struct(F.lit(n).alias("suggestion"), F.round(F.col(v), 6).alias("value"))) for t, n, v in rules)), lambda x: x.isNotNull())
    hits = hits if first is None else F.slice(hits, 1, first)
    none = F.array(F.struct(F.lit("looks_optimal").alias("suggestion"), F.lit(None).cast("double").alias("value")))
    return h.select("operation", F.inline(F.when(F.size(hits) > 0, hits).otherwise(none)))
