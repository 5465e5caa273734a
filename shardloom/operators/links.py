"""Links between shard records: checks, repair, summaries. All runs at once; keys are (run_id, shard_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import blank_to_null, cut
from ..sources import corpus
from . import hierarchy

KEY = ["run_id", "shard_id"]
TYPES = ("dict", "list", "primitive")


def records(meta: DataFrame) -> DataFrame:
    """One row for each (run_id, shard_id), empty links null, null child lists empty; rows without a key are left out.

    Of repeated deliveries, which differ in ingested_at only, the first is taken.
    """
    cols = ["doc_key", "parent_id", "child_ids", "data_type", "original_path", "next_shard", "previous_shard", "version", "recorded_at"]
    one = meta.where("run_id is not null and shard_id is not null").groupBy(*KEY).agg(F.min_by(F.struct(*cols), F.struct("ingested_at", "recorded_at")).alias("r")).select(*KEY, "r.*")
    return one.withColumns({c: blank_to_null(c) for c in ("parent_id", "next_shard", "previous_shard")} | {"child_ids": F.coalesce("child_ids", F.array().cast("array<string>"))})


def record_issues(rec: DataFrame) -> DataFrame:
    """(run_id, shard_id, issue): records whose own fields are wrong."""
    sid = F.col("shard_id")
    tests: list[tuple[str, Column]] = [
        ("no_prefix", ~sid.startswith("shard_")),
        ("own_parent", F.col("parent_id") == sid),
        ("own_child", F.array_contains("child_ids", sid)),
        ("bad_data_type", ~F.coalesce(F.col("data_type").isin(*TYPES), F.lit(False))),
        ("null_path", F.col("original_path").isNull()),
        ("repeated_child", F.size("child_ids") > F.size(F.array_distinct("child_ids"))),
        ("blank_child", F.exists("child_ids", lambda c: c.isNull() | (c == ""))),
    ]
    hit = F.filter(F.array(*(F.when(t, F.lit(n)) for n, t in tests)), lambda x: x.isNotNull())
    return rec.select(*KEY, F.explode(hit).alias("issue"))


def child_links(rec: DataFrame) -> DataFrame:
    """(run_id, shard_id, position, child_id): entries of child lists, blank ones left out."""
    return rec.select(*KEY, F.posexplode("child_ids").alias("position", "child_id")).where("child_id <> ''")


def edges(rec: DataFrame) -> DataFrame:
    """(run_id, src, dst, kind): parent_child from child lists, sequential from next links; each once."""
    a = child_links(rec).select("run_id", F.col("shard_id").alias("src"), F.col("child_id").alias("dst"), F.lit("parent_child").alias("kind"))
    b = rec.where("next_shard is not null").select("run_id", F.col("shard_id").alias("src"), F.col("next_shard").alias("dst"), F.lit("sequential").alias("kind"))
    return a.distinct().unionByName(b)


def link_issues(rec: DataFrame, strict: bool = False) -> DataFrame:
    """(run_id, shard_id, issue, other): links that don't hold. One probe of the record index for links of all kinds.

    missing_parent, missing_child, missing_next: no such record; child_parent_mismatch: the child names another parent;
    next_previous_mismatch: the next record names another one before it. strict: also not_listed, a parent that doesn't
    list the record, and missing_previous. `run` level: no_root and several_roots, with null shard_id.
    """
    link = lambda kind, c: rec.where(F.col(c).isNotNull()).select(*KEY, F.lit(kind).alias("kind"), F.col(c).alias("other"))
    links = link("parent", "parent_id").unionByName(link("next", "next_shard")).unionByName(child_links(rec).select(*KEY, F.lit("child").alias("kind"), F.col("child_id").alias("other")))
    if strict:
        links = links.unionByName(link("previous", "previous_shard"))
    there = rec.select("run_id", F.col("shard_id").alias("other"), F.lit(True).alias("there"), F.col("parent_id").alias("p"), F.col("previous_shard").alias("q"), *([F.col("child_ids").alias("kids")] if strict else []))
    k = F.col("kind")
    issue = (
        F.when(F.col("there").isNull(), F.concat(F.lit("missing_"), k))
        .when((k == "child") & ~F.col("p").eqNullSafe(F.col("shard_id")), "child_parent_mismatch")
        .when((k == "next") & ~F.col("q").eqNullSafe(F.col("shard_id")), "next_previous_mismatch")
    )
    if strict:
        issue = issue.when((k == "parent") & ~F.array_contains("kids", F.col("shard_id")), "not_listed")
    found = links.join(there, ["run_id", "other"], "left").select(*KEY, issue.alias("issue"), "other").where("issue is not null").distinct()
    roots = rec.groupBy("run_id").agg(F.count_if(F.col("parent_id").isNull()).alias("n")).where("n <> 1")
    return found.unionByName(roots.select("run_id", F.lit(None).cast("string").alias("shard_id"), F.when(F.col("n") == 0, "no_root").otherwise("several_roots").alias("issue"), F.lit(None).cast("string").alias("other")))


def hierarchy_valid(rec: DataFrame) -> DataFrame:
    """(run_id, valid): whether every listed child exists and names its lister as parent."""
    bad = link_issues(rec).where(F.col("issue").isin("missing_child", "child_parent_mismatch")).select("run_id").distinct().withColumn("bad", F.lit(True))
    return rec.select("run_id").distinct().join(bad, "run_id", "left").select("run_id", F.col("bad").isNull().alias("valid"))


def neighbours(rec: DataFrame, block: int = 100_000) -> DataFrame:
    """Records with `before` and `after`, the ids next to theirs in the run by number of the id.

    The records are cut by sampled ranges of (run, number, id), so blocks are bounded whatever the ids; lag and lead run
    within the blocks of a run, whose edges are matched through one row a block. Ids without a number come last, by text.
    """
    digits = F.regexp_extract("shard_id", r"(\d{1,15})", 1)
    rows = cut(rec.withColumn("num_", F.coalesce(F.when(digits != "", digits.cast("bigint")), F.lit(1 << 62))))
    parts = max(1, -(-rows.count() // block))
    rows = cut(rows.repartitionByRange(parts, "run_id", "num_", "shard_id").withColumn("block_", F.spark_partition_id()))
    w = Window.partitionBy("run_id", "block_").orderBy("num_", "shard_id")
    local = rows.withColumns({"before": F.lag("shard_id").over(w), "after": F.lead("shard_id").over(w)})
    ends = rows.groupBy("run_id", "block_").agg(F.min_by("shard_id", F.struct("num_", "shard_id")).alias("first_"), F.max_by("shard_id", F.struct("num_", "shard_id")).alias("last_"))
    v = Window.partitionBy("run_id").orderBy("block_")
    ends = ends.select("run_id", "block_", F.lag("last_").over(v).alias("prior_"), F.lead("first_").over(v).alias("next_"))
    return local.join(ends, ["run_id", "block_"]).withColumns({"before": F.coalesce("before", "prior_"), "after": F.coalesce("after", "next_")}).drop("num_", "block_", "prior_", "next_")


def order_valid(rec: DataFrame) -> DataFrame:
    """(run_id, valid): whether next and previous of the list shards are their neighbours among the list shards of the run."""
    n = neighbours(rec.where("data_type = 'list'"))
    ok = F.col("next_shard").eqNullSafe(F.col("after")) & F.col("previous_shard").eqNullSafe(F.col("before"))
    return n.groupBy("run_id").agg(F.bool_and(ok).alias("valid"))


def relink(rec: DataFrame) -> DataFrame:
    """(run_id, shard_id, previous_shard, next_shard) with the list shards of each run chained by position."""
    return neighbours(rec.where("data_type = 'list'")).select(*KEY, F.col("before").alias("previous_shard"), F.col("after").alias("next_shard"))


def children(rec: DataFrame) -> DataFrame:
    """(run_id, shard_id, position, child_id, child_type) of listed children that exist, in list order."""
    kid = rec.select("run_id", F.col("shard_id").alias("child_id"), F.col("data_type").alias("child_type"))
    return child_links(rec).join(kid, ["run_id", "child_id"]).select(*KEY, "position", "child_id", "child_type")


def establish(rec: DataFrame, pairs: DataFrame) -> DataFrame:
    """Records after making each (run_id, parent_id, child_id) of `pairs` a parent and child; what is so already stays so."""
    up = pairs.groupBy("run_id", F.col("child_id").alias("shard_id")).agg(F.min("parent_id").alias("new_parent"))
    down = pairs.groupBy("run_id", F.col("parent_id").alias("shard_id")).agg(F.array_sort(F.collect_set("child_id")).alias("new_kids"))
    j = rec.join(up, KEY, "left").join(down, KEY, "left")
    return j.withColumns({"parent_id": F.coalesce("new_parent", "parent_id"), "child_ids": F.coalesce(F.array_union("child_ids", "new_kids"), "child_ids")}).drop("new_parent", "new_kids")


def update(rec: DataFrame, changes: DataFrame, fields: tuple[str, ...] = ("parent_id", "child_ids", "data_type", "original_path", "next_shard", "previous_shard")) -> DataFrame:
    """Records with the non-null allowed fields of `changes` (one row a key) in place of theirs; unknown keys change nothing."""
    new = [c for c in fields if c in changes.columns]
    named = changes.select(*KEY, *(F.col(c).alias(f"new_{c}") for c in new))
    return rec.join(named, KEY, "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in new}).drop(*(f"new_{c}" for c in new))


def detach(rec: DataFrame, pairs: DataFrame) -> DataFrame:
    """Records after undoing each (run_id, parent_id, child_id) of `pairs`: the child leaves the list, and names no parent if it named this one."""
    gone = pairs.groupBy("run_id", F.col("parent_id").alias("shard_id")).agg(F.collect_set("child_id").alias("gone"))
    lost = pairs.select("run_id", F.col("child_id").alias("shard_id"), "parent_id").distinct().withColumn("undone", F.lit(True))
    j = rec.join(gone, KEY, "left").join(lost, [*KEY, "parent_id"], "left")
    kept = F.when(F.col("gone").isNull(), F.col("child_ids")).otherwise(F.filter("child_ids", lambda c: ~F.coalesce(F.array_contains("gone", c), F.lit(False))))
    return j.withColumns({"child_ids": kept, "parent_id": F.when(F.col("undone").isNull(), F.col("parent_id"))}).drop("gone", "undone")


def _forward(rec: DataFrame, close: bool = False) -> DataFrame:
    """Next links as parent links; close: those that name no record are dropped."""
    rows = rec.select("run_id", "shard_id", F.col("next_shard").alias("parent_id"))
    if close:
        known = rec.select("run_id", F.col("shard_id").alias("parent_id"), F.lit(True).alias("known"))
        rows = rows.join(known, ["run_id", "parent_id"], "left").select("run_id", "shard_id", F.when(F.col("known"), F.col("parent_id")).alias("parent_id"))
    return rows.withColumn("child_ids", F.array().cast("array<string>"))


def chains(rec: DataFrame) -> DataFrame:
    """(run_id, shard_id, next_id, last_id, ending, position, length): where the line of next links from each record leads.

    ending: `end` at a record without next, `unknown` at one whose next names no record, `ring` at a repetition (last_id
    is then the least id of the ring). position: links to last_id or into the ring. length: ids of the chain from the
    record on, the unknown one included, each once. One row a record; no chain is written out (see `chain_members`).
    """
    full = cut(hierarchy.build(_forward(rec)))
    k = F.col("kind")
    rings = full.where(k == hierarchy.CYCLE).groupBy("run_id", "head_id").agg(F.count("*").alias("ring"))
    ending = F.when(k == hierarchy.ROOTED, "end").when(k == hierarchy.DETACHED, "unknown").otherwise("ring")
    length = F.col("steps") + F.when(ending == "end", 1).when(ending == "unknown", 2).otherwise(F.col("ring"))
    return full.join(rings, ["run_id", "head_id"], "left").select(*KEY, F.col("parent_id").alias("next_id"), F.col("head_id").alias("last_id"), ending.alias("ending"), F.col("steps").cast("bigint").alias("position"), length.cast("bigint").alias("length"))


def chain_members(rec: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(run_id, start_id, position, shard_id): the records along the next links of each start, one row each.

    starts: (run_id, shard_id); without, the records that no next link names, so every chain is listed once and none of
    its suffixes. Unknown ids at the end are left out, chains into a ring give no rows.
    """
    if starts is None:
        starts = rec.select(*KEY).join(rec.select("run_id", F.col("next_shard").alias("shard_id")).where("shard_id is not null").distinct(), KEY, "left_anti")
    full = hierarchy.build(_forward(rec, True), True, starts=starts).where("path is not null")
    return full.select("run_id", F.col("shard_id").alias("start_id"), F.posexplode(F.reverse("path")).alias("position", "shard_id"))


def cycles(rec: DataFrame) -> DataFrame:
    """(run_id, head_id, members): rings of parent links, each once, named by their least id."""
    ring = hierarchy.build(rec.select("run_id", "shard_id", "parent_id", "child_ids")).where("kind = 'cycle'")
    return ring.groupBy("run_id", "head_id").agg(F.count("*").alias("members"))


def references_in_data(nodes: DataFrame, rec: DataFrame) -> DataFrame:
    """(doc_id, ref) of the references to other shards at the first level of the values of a document that name no record of its run.

    nodes: of documents `run_id/shard_id`; a reference is the text under `_shard_ref` of the root or of one of its values.
    """
    n = nodes.where("key = '_shard_ref' and depth <= 2 and scalar_type = 'str'").select("doc_id", F.split("doc_id", "/")[0].cast("bigint").alias("run_id"), F.from_json(F.concat(F.lit("["), "raw", F.lit("]")), "array<string>")[0].alias("ref"))
    return n.join(rec.select("run_id", F.col("shard_id").alias("ref")), ["run_id", "ref"], "left_anti").select("doc_id", "ref").distinct()


def predicates(rec: DataFrame) -> DataFrame:
    """(run_id, shard_id, has_children, is_root, is_leaf, depth, place) of each record; a null path has depth 0 and place `root`."""
    kids = F.size("child_ids") > 0
    p = F.coalesce("original_path", F.array().cast("array<string>"))
    return rec.select(*KEY, kids.alias("has_children"), F.col("parent_id").isNull().alias("is_root"), (~kids).alias("is_leaf"), F.size(p).cast("bigint").alias("depth"), F.when(F.size(p) > 0, F.array_join(p, ".")).otherwise("root").alias("place"))


def integrity(rec: DataFrame) -> DataFrame:
    """(run_id, shards, relationships, sequential_links, orphans, errors, cycles, valid) of each run, by the strict checks."""
    base = rec.groupBy("run_id").agg(
        F.count("*").alias("shards"), F.sum(F.size("child_ids")).alias("relationships"), F.count("next_shard").alias("sequential_links"),
        F.count_if(F.col("parent_id").isNull() & (F.size("child_ids") == 0)).alias("orphans"),
    )
    bad = link_issues(rec, True).where("issue <> 'several_roots'").groupBy("run_id").agg(F.count("*").alias("errors"))
    rings = cycles(rec).groupBy("run_id").agg(F.count("*").alias("cycles"))
    j = base.join(bad, "run_id", "left").join(rings, "run_id", "left").fillna(0, ["errors", "cycles"])
    return j.withColumn("valid", (F.col("errors") == 0) & (F.col("cycles") == 0))


def summary(rec: DataFrame) -> DataFrame:
    """(run_id, shards, dicts, lists, primitives, roots, leaves, max_depth, relationships) of each run; depth is the length of the path."""
    t = F.col("data_type")
    return rec.groupBy("run_id").agg(
        F.count("*").alias("shards"), F.count_if(t == "dict").alias("dicts"), F.count_if(t == "list").alias("lists"), F.count_if(t == "primitive").alias("primitives"),
        F.count_if(F.col("parent_id").isNull()).alias("roots"), F.count_if(F.size("child_ids") == 0).alias("leaves"),
        F.coalesce(F.max(F.when(F.col("original_path").isNotNull(), F.size("original_path"))), F.lit(0)).cast("bigint").alias("max_depth"), F.count_if(F.size("child_ids") > 0).alias("relationships"),
    )


def depth_histogram(rec: DataFrame) -> DataFrame:
    """(depth, data_type, n) over all runs; null paths have a null depth."""
    return rec.groupBy(F.when(F.col("original_path").isNotNull(), F.size("original_path")).cast("bigint").alias("depth"), "data_type").agg(F.count("*").alias("n"))


def efficiency(total: DataFrame) -> DataFrame:
    """`summary` with a score from 0 to 1: less for depth over five, more than one root, and over four fifths of leaves."""
    ratio = F.col("leaves") / F.col("shards")
    score = 1 - F.greatest(F.col("max_depth") - 5, F.lit(0)) * 0.05 - F.greatest(F.col("roots") - 1, F.lit(0)) * 0.1 - F.greatest(ratio - 0.8, F.lit(0.0)) * 0.5
    return total.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def suggestions(rec: DataFrame) -> DataFrame:
    """(run_id, suggestion, priority, value): what to change in the structure of a run."""
    long = chains(rec).groupBy("run_id").agg(F.max("length").alias("chain"))
    s = summary(rec).join(long, "run_id", "left")
    rule = lambda test, name, priority, value: F.when(test, F.struct(F.lit(name).alias("suggestion"), F.lit(priority).alias("priority"), value.cast("bigint").alias("value")))
    rules = F.array(
        rule(F.col("max_depth") > 10, "reduce_nesting", "high", F.col("max_depth")),
        rule(F.col("roots") > 5, "consolidate_roots", "medium", F.col("roots")),
        rule(F.col("leaves") > F.col("shards") * 0.8, "balance_tree", "low", F.col("leaves")),
        rule(F.col("chain") > 20, "break_long_chains", "medium", F.col("chain")),
    )
    return s.select("run_id", F.inline(F.filter(rules, lambda x: x.isNotNull())))


def repair(rec: DataFrame) -> DataFrame:
    """Records without their dangling links: parents, next, previous and children that are no record of the run."""
    known = rec.select("run_id", F.col("shard_id").alias("id"), F.lit(True).alias("ok"))
    single = F.array(*(F.struct(F.lit(c).alias("f"), F.col(c).alias("id"), F.lit(0).alias("i")) for c in ("parent_id", "next_shard", "previous_shard")))
    kids = F.transform("child_ids", lambda c, i: F.struct(F.lit("child").alias("f"), c.alias("id"), i.alias("i")))
    links = rec.select(*KEY, F.inline(F.concat(single, kids))).where("id is not null").join(known, ["run_id", "id"], "left_semi")
    pick = lambda c: F.max(F.when(F.col("f") == c, F.col("id"))).alias(c)
    held = links.groupBy(*KEY).agg(pick("parent_id"), pick("next_shard"), pick("previous_shard"), F.transform(F.array_sort(F.collect_list(F.when(F.col("f") == "child", F.struct("i", "id")))), lambda x: x["id"]).alias("child_ids"))
    rest = rec.drop("parent_id", "next_shard", "previous_shard", "child_ids")
    return rest.join(held, KEY, "left").withColumn("child_ids", F.coalesce("child_ids", F.array().cast("array<string>")))


def data_kinds(shards: DataFrame) -> DataFrame:
    """(run_id, shard_id, data, actual): actual is dict, list, primitive or invalid, by a strict parse of the text."""
    one = shards.groupBy(*KEY).agg(F.max("data").alias("data")).withColumn("doc_id", F.concat_ws("/", F.col("run_id").cast("string"), "shard_id"))
    parsed = corpus.canonical(one.select("doc_id", F.col("data").alias("json"))).select("doc_id", F.col("json").alias("sound"), "error_type").dropDuplicates(["doc_id"])
    first = F.substring("sound", 1, 1)
    kind = F.when(first == "{", "dict").when(first == "[", "list").when((F.col("error_type") == "STRUCTURE"), "primitive").otherwise("invalid")
    return one.join(parsed, "doc_id").select(*KEY, "data", kind.alias("actual"))


def recover(rec: DataFrame, shards: DataFrame) -> DataFrame:
    """(run_id, shard_id, state, data): `lost` where the record is unsound, `rebuilt` with a stub where the data doesn't fit the declared type, else `kept`.

    Rebuilt shards hold `_recovered` and `_original_id` in the declared type. Records without a stored text are `missing`.
    """
    bad = record_issues(rec).where(F.col("issue").isin("no_prefix", "own_parent", "own_child", "bad_data_type")).select(*KEY).distinct().withColumn("bad", F.lit(True))
    data = data_kinds(shards)
    j = rec.select(*KEY, "data_type").join(bad, KEY, "left").join(data, KEY, "left")
    kind = F.col("actual")
    fits = (kind == F.col("data_type")) | ((F.col("data_type") == "primitive") & (kind != "invalid"))
    stub = F.to_json(F.struct(F.lit(True).alias("_recovered"), F.col("shard_id").alias("_original_id")))
    made = F.when(F.col("data_type") == "dict", stub).when(F.col("data_type") == "list", F.concat(F.lit("["), stub, F.lit("]"))).otherwise(F.concat(F.lit('"_recovered_from_'), F.col("shard_id"), F.lit('"')))
    state = F.when(F.col("bad").isNotNull(), "lost").when(F.col("data").isNull(), "missing").when(fits, "kept").otherwise("rebuilt")
    return j.select(*KEY, state.alias("state"), F.when(state == "kept", F.col("data")).when(state == "rebuilt", made).alias("data"))


#: What can be done about an error of each type (fixed values).
ADVICE = {"memory": (True, "reduce_limit"), "corruption": (True, "recover"), "filesystem": (True, "check_permissions"), "circular": (False, "remove_references")}


def advise_errors(log: DataFrame) -> DataFrame:
    """(error_type, severity, n, can_recover, action): messages by type, each log_id once; spellings of type and severity are folded."""
    sev = F.lower(F.trim("severity"))
    sev = F.when(sev.startswith("warn"), "warning").when(sev.startswith("err"), "error").otherwise(sev)
    kind = F.lower(F.trim("error_type"))
    one = log.select("log_id", kind.alias("error_type"), sev.alias("severity")).dropDuplicates(["log_id"])
    pick = lambda i, other: F.coalesce(*(F.when(F.col("error_type") == k, F.lit(v[i])) for k, v in ADVICE.items()), F.lit(other))
    return one.groupBy("error_type", "severity").agg(F.count("*").alias("n")).withColumns({"can_recover": pick(0, False), "action": pick(1, "check_logs")})


def references(rec: DataFrame, shards: DataFrame) -> DataFrame:
    """(run_id, shard_id, data_type, place, parent_id, n_children, size) of each record, the place as dotted path or `root`."""
    size = shards.groupBy(*KEY).agg(F.max(F.octet_length("data")).cast("bigint").alias("size"))
    place = F.when(F.size("original_path") > 0, F.array_join("original_path", ".")).otherwise("root")
    return rec.select(*KEY, "data_type", place.alias("place"), "parent_id", F.size("child_ids").cast("bigint").alias("n_children")).join(size, KEY, "left")
