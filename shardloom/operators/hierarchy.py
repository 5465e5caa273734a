"""Parent-child links to full hierarchies.

Method: weighted disjoint-set forests. Every record has at most one link to its parent, so the links form a forest
with some cycles. A block (a whole run, or a part of a larger one) compresses its own links into (representative,
offset) pairs; blocks of a run are then merged over the records that other blocks point to, segments of doubled length
in each round, which finds roots and cycles; at last paths are read off by parent traversal along the index. Sizes of
subtrees are folded upwards the same way: within blocks from the leaves, between blocks along the exits.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import blank_to_null, cut, map_groups

#: Records of a block; runs of more are cut into several, which are merged.
BLOCK_ROWS = 512
#: Parts that a stretch of ids may be cut into, as they count within a block number.
_PARTS = 1 << 20
ROOTED, CYCLE, UNDER, DETACHED, OPEN = "rooted", "cycle", "under_cycle", "detached", "open"


def resolve_parents(meta: DataFrame) -> DataFrame:
    """(run_id, shard_id, parent_id) of every distinct record, parent_id null for roots.

    The parent is `parent_id`; if null or empty, the record of the run whose `child_ids` hold the record (the least,
    should there be several). Rows without run_id or shard_id are no records. Null lists, null or empty entries and
    entries that name no record are ignored; repeated rows count once. One shuffle, pre-aggregated on the map side.
    """
    rows = meta.where(F.col("run_id").isNotNull() & F.col("shard_id").isNotNull())
    own = rows.select("run_id", "shard_id", blank_to_null("parent_id").alias("own"), F.lit(None).cast("string").alias("held"), F.lit(True).alias("real"))
    held = rows.select("run_id", F.explode("child_ids").alias("c"), "shard_id").where("c <> ''").select("run_id", F.col("c").alias("shard_id"), F.lit(None).cast("string").alias("own"), F.col("shard_id").alias("held"), F.lit(False).alias("real"))
    return (
        own.unionAll(held)
        .groupBy("run_id", "shard_id")
        .agg(F.min("own").alias("own"), F.min("held").alias("held"), F.max("real").alias("real"))
        .where("real")
        .select("run_id", "shard_id", F.coalesce("own", "held").alias("parent_id"))
    )


def _find(ptr: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Weighted find with full path compression for all members at once: (representative, offset to it, rounds)."""
    limit = ceil(log2(len(ptr) + 1)) + 1
    for k in range(limit):
        nxt = ptr[ptr]
        if np.array_equal(nxt, ptr):
            return ptr, off, k
        off = off + off[ptr]
        ptr = nxt
    return ptr, off, limit


class _Forest:
    """The links of some whole blocks: `up` is the row of the parent, the row itself where the line leaves the block or ends."""

    def __init__(self, t: pa.Table):
        n = t.num_rows
        ids = t.column("shard_id").combine_chunks()
        parents = t.column("parent_id").combine_chunks()
        names = pc.unique(pa.concat_arrays([x if isinstance(x, pa.Array) else x.combine_chunks() for x in (ids, parents)])).drop_null()
        self.names = names.take(pc.sort_indices(names))  # codes in text order
        node = pc.index_in(ids, self.names).to_numpy(zero_copy_only=False).astype(np.int64)
        par = pc.fill_null(pc.index_in(parents, self.names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        run = t.column("run_id").to_numpy()
        block = t.column("block").to_numpy()
        edge = np.ones(n, bool)  # rows come sorted by (run_id, block)
        edge[1:] = (run[1:] != run[:-1]) | (block[1:] != block[:-1])
        group = np.cumsum(edge)
        width = len(self.names) + 1
        key = group * width + node
        order = np.argsort(key, kind="stable")
        want = group * width + par
        at = np.minimum(np.searchsorted(key[order], want), max(n - 1, 0))
        found = (par >= 0) & (key[order][at] == want) if n else np.zeros(0, bool)
        self.n, self.node, self.par = n, node, par
        self.up = np.where(found, order[at], np.arange(n)) if n else np.zeros(0, np.int64)
        self.self_loop = found & (self.up == np.arange(n))
        self.leaves = ~found  # the line ends here or leaves the block

    def solve(self, through: np.ndarray | None = None):
        """(end row, offset, on_cycle, least code on the cycle, row that told) of every row.

        through: rows known to be on cycles that run through other blocks; for every row on such a cycle the last result
        is the one of them that it was reached from, else -1.
        """
        n, me = self.n, np.arange(self.n)
        ptr, off, _ = _find(self.up.copy(), (self.up != me).astype(np.int64))
        ends = self.leaves[ptr]
        on = np.zeros(n, bool)
        on[ptr[~ends]] = True
        least = self.node.copy()
        if on.any():
            p = np.where(on, self.up, me)
            for _ in range(ceil(log2(n + 1)) + 1):
                least = np.where(on, np.minimum(least, least[p]), least)
                p = p[p]
        told = np.full(n, -1)
        if through is not None and through.any():
            at = np.flatnonzero(through)
            told[at] = at
            while len(at):
                on[at] = True
                above, first = np.unique(self.up[at], return_index=True)
                fresh = ~on[above]
                told[above[fresh]] = told[at[first[fresh]]]
                at = above[fresh]
        if on.any():
            up = np.where(on, me, self.up)
            ptr, off, _ = _find(up, (up != me).astype(np.int64))
        return ptr, off, on, least, told

    def below(self, off: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Weights summed over the subtree of each row, itself included: levels folded from the deepest upwards."""
        total = weight.astype(np.int64)
        order = np.argsort(off, kind="stable")
        edge = np.searchsorted(off[order], np.arange(int(off.max()) + 2)) if len(off) else np.zeros(1, np.int64)
        for k in range(len(edge) - 2, 0, -1):
            rows = order[edge[k] : edge[k + 1]]
            np.add.at(total, self.up[rows], total[rows])
        return total

    def segments(self, stop: np.ndarray, keep: np.ndarray) -> pa.Array:
        """For each row in `keep` the ids from below its end (inclusive) down to itself, by parent traversal along the index."""
        me = np.arange(self.n)
        up = np.where(stop, me, self.up)
        _, off, _ = _find(up.copy(), (up != me).astype(np.int64))
        size = np.where(keep, off + 1, 0)
        start = np.concatenate([[0], np.cumsum(size)])
        values = np.zeros(start[-1], np.int64)
        at, cur = start[1:][keep] - 1, me[keep]
        first = start[:-1][keep]
        while len(cur):
            values[at] = self.node[cur]
            go = at > first
            at, cur, first = at[go] - 1, up[cur[go]], first[go]
        return pa.LargeListArray.from_arrays(pa.array(start, pa.int64()), self.names.take(pa.array(values))).cast(pa.list_(pa.string()))


_LOCAL = "run_id bigint, block bigint, shard_id string, parent_id string, want boolean, kind string, head_id string, steps bigint, below bigint, ext string, least string, path array<string>"
_SECOND = "run_id bigint, shard_id string, parent_id string, want boolean, kind string, head_id string, steps bigint, below bigint, path array<string>"


def _text(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(object), pa.string())


def _local(paths: bool):
    """First pass over blocks: everything about lines that end within the block, and the exits of the others."""

    def f(t: pa.Table) -> pa.Table:
        w = _Forest(t)
        hot = t.column("hot").to_numpy(zero_copy_only=False)
        ptr, off, on, least, _ = w.solve()
        ends_on = on[ptr]
        kind = np.select([on, ends_on, w.par[ptr] < 0, hot], [CYCLE, UNDER, ROOTED, OPEN], DETACHED)
        opened = kind == OPEN
        low = w.node.copy()  # least id of the segment, for cycles through several blocks
        if opened.any():
            p = np.where(on, np.arange(w.n), w.up)
            for _ in range(ceil(log2(w.n + 1)) + 1):
                low = np.minimum(low, low[p])
                p = p[p]
        take = lambda code, ok: w.names.take(pa.array(code, mask=~ok))
        want = t.column("want").to_numpy(zero_copy_only=False)
        lines = ((kind == ROOTED) & (want | hot)) | opened if paths else np.zeros(w.n, bool)
        steps = np.where(on, 0, off)
        cols = {
            **{c: t.column(c) for c in ("run_id", "block", "shard_id", "parent_id", "want")}, "kind": _text(kind), "head_id": w.names.take(pa.array(np.where(ends_on, least[ptr], w.node[ptr]))), "steps": pa.array(steps),
            "below": pa.array(w.below(steps, np.ones(w.n))), "ext": take(np.maximum(w.par[ptr], 0), opened), "least": take(low, opened), "path": w.segments(on, lines),
        }
        return pa.table(cols)

    return f


def _again(paths: bool):
    """Second pass over blocks of split runs: rows carry what the merge found for their exit (e_*) and for themselves (cycle_head, extra)."""

    def f(t: pa.Table) -> pa.Table:
        w = _Forest(t)
        cycle_head = t.column("cycle_head").combine_chunks()
        ptr, off, on, least, told = w.solve(pc.is_valid(cycle_head).to_numpy(zero_copy_only=False))
        end = pa.array(ptr)
        e_kind = t.column("e_kind").combine_chunks().take(end)
        ek = e_kind.to_numpy(zero_copy_only=False)
        gone = pc.is_null(e_kind).to_numpy(zero_copy_only=False)
        ends_on = on[ptr]
        here = w.par[ptr] < 0
        beyond = ~ends_on & ~here & ~gone
        kind = np.select([on, ends_on, here, gone, ek == CYCLE], [CYCLE, UNDER, ROOTED, DETACHED, UNDER], ek.astype(object))
        mine = w.names.take(pa.array(np.where(ends_on, least[ptr], w.node[ptr])))
        ring = cycle_head.take(pa.array(np.maximum(told[ptr], 0), mask=~ends_on | (told[ptr] < 0)))
        far = t.column("e_head").combine_chunks().take(pa.array(ptr, mask=~beyond))
        more = pc.fill_null(t.column("e_steps").combine_chunks().take(end), 0).to_numpy(zero_copy_only=False)
        steps = np.where(on, 0, off)
        extra = pc.fill_null(t.column("extra").combine_chunks(), 0).to_numpy(zero_copy_only=False)
        cols = {
            **{c: t.column(c) for c in ("run_id", "shard_id", "parent_id", "want")}, "kind": _text(kind), "head_id": pc.coalesce(ring, far, mine), "steps": pa.array(np.where(beyond, steps + more + 1, steps)), "below": pa.array(w.below(steps, 1 + extra)),
        }
        if not paths:
            return pa.table(cols | {"path": pa.nulls(w.n, pa.list_(pa.string()))})
        lines = (kind == ROOTED) & t.column("want").to_numpy(zero_copy_only=False)
        seg = w.segments(on, lines)
        prefix = t.column("e_path").combine_chunks().take(pa.array(ptr, mask=~(lines & beyond)))
        return pa.table(cols | {"path": _joined(prefix, seg)})

    return f


def _into_cycles(t: pa.Table) -> pa.Table:
    """Rows whose line runs, within the block, into a cycle that goes through other blocks: where it does, and after how many links."""
    w = _Forest(t)
    cycle_head = t.column("cycle_head").combine_chunks()
    ptr, off, on, _, told = w.solve(pc.is_valid(cycle_head).to_numpy(zero_copy_only=False))
    hit = np.flatnonzero(on[ptr] & (told[ptr] >= 0))
    kind = np.where(on, CYCLE, UNDER)[hit]
    return pa.table({"run_id": t.column("run_id").take(pa.array(hit)), "t": t.column("shard_id").take(pa.array(hit)), "c_kind": _text(kind), "c_head": cycle_head.take(pa.array(told[ptr[hit]])), "c_steps": pa.array(np.where(on, 0, off)[hit])})


def _joined(a: pa.Array, b: pa.Array) -> pa.Array:
    """Lists of `a` (null as empty) followed by those of `b`, by one gather."""
    a = pc.fill_null(a, pa.scalar([], a.type)) if a.null_count else a
    la, lb = (pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b))
    va, vb = a.flatten(), b.flatten()
    start = np.r_[0, np.cumsum(la + lb)]
    out = np.zeros(start[-1], np.int64)
    spread = lambda first, size: np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    out[spread(start[:-1], la)] = np.arange(len(va))
    out[spread(start[:-1] + la, lb)] = len(va) + np.arange(len(vb))
    return pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.concat_arrays([va, vb]).take(pa.array(out)))


def _merge(local: DataFrame, paths: bool) -> tuple[DataFrame, DataFrame]:
    """What the blocks of split runs tell each other.

    First (run_id, t, kind, head, steps, path, cycle_head) of the records that other blocks point to; then (run_id, t,
    extra), the records of other blocks below them. Each round joins every open segment with the segment it points to,
    so their length doubles; after log2 of their number all that is still open runs into a cycle. Distributed
    throughout: keys are single records, unique on the joined side.
    """
    wanted = local.where("ext is not null").select("run_id", F.col("ext").alias("t")).distinct()
    path = F.col("path") if paths else F.lit(None).cast("array<string>")
    start = cut(wanted.join(local.withColumnRenamed("shard_id", "t"), ["run_id", "t"]).select("run_id", "t", "kind", F.col("head_id").alias("head"), "steps", F.col("ext").alias("ptr"), "least", path.alias("path")))
    rounds = ceil(log2(start.count() + 1)) + 1
    step = start.select("run_id", "t", "ptr", "least")
    for _ in range(rounds):
        if step.where("ptr is not null").isEmpty():
            break
        nxt = step.select("run_id", F.col("t").alias("ptr"), F.col("ptr").alias("p2"), F.col("least").alias("l2"))
        step = cut(step.join(nxt, ["run_id", "ptr"], "left").select("run_id", "t", F.col("p2").alias("ptr"), F.least("least", "l2").alias("least")))
    members = step.where("ptr is not null").select("run_id", F.col("ptr").alias("t")).distinct().join(step, ["run_id", "t"]).select("run_id", "t", F.col("least").alias("cycle_head"))
    # once more, with the records on cycles as ends: kinds, offsets and paths; lines may run into a cycle within a block
    members = cut(members)
    looped = members.select("run_id").distinct()
    rows = local.join(looped, "run_id", "left_semi").select("run_id", "block", "shard_id", "parent_id").join(members.withColumnRenamed("t", "shard_id"), ["run_id", "shard_id"], "left")
    found = "run_id bigint, t string, c_kind string, c_head string, c_steps bigint"
    into = local.sparkSession.createDataFrame([], found) if members.isEmpty() else map_groups(rows, ["run_id", "block"], _into_cycles, found)
    ends = F.col("c_kind").isNotNull()
    walk = cut(
        start.join(members, ["run_id", "t"], "left").join(into, ["run_id", "t"], "left").select(
            "run_id", "t", F.when(~ends, F.col("ptr")).alias("ptr"), F.coalesce("c_kind", "kind").alias("kind"), F.coalesce("c_head", "head").alias("head"), F.coalesce("c_steps", "steps").alias("steps"), "path", "cycle_head",
        )
    )
    closed = F.col("ptr").isNull()
    for _ in range(rounds):
        if walk.where(~closed).isEmpty():
            break
        nxt = walk.select("run_id", F.col("t").alias("ptr"), F.col("ptr").alias("p2"), F.col("kind").alias("k2"), F.col("head").alias("h2"), F.col("steps").alias("s2"), F.col("path").alias("q2"))
        walk = cut(
            walk.join(nxt, ["run_id", "ptr"], "left").select(
                "run_id", "t", F.col("p2").alias("ptr"),
                F.when(closed, F.col("kind")).when(F.col("k2") == CYCLE, F.lit(UNDER)).otherwise(F.col("k2")).alias("kind"),
                F.when(closed, F.col("head")).otherwise(F.col("h2")).alias("head"),
                F.when(closed, F.col("steps")).otherwise(F.col("steps") + F.col("s2") + 1).alias("steps"),
                F.when(closed, F.col("path")).otherwise(F.concat("q2", "path")).alias("path"),
                "cycle_head",
            )
        )
    # trees below exits: sums over segments of doubled length, as far as they hang on roots
    exits = local.where((F.col("kind") == OPEN) & (F.col("shard_id") == F.col("head_id"))).select("run_id", F.col("shard_id").alias("e"), F.col("below").alias("total"), F.col("ext").alias("t"))
    rooted = walk.where(F.col("kind") == ROOTED).select("run_id", "t")
    onward = start.join(rooted, ["run_id", "t"], "left_semi").select("run_id", "t", F.when(F.col("kind") == OPEN, F.col("head")).alias("up"))
    tree = cut(exits.join(onward, ["run_id", "t"]))
    for _ in range(rounds):
        if tree.where("up is not null").isEmpty():
            break
        got = tree.where("up is not null").groupBy("run_id", F.col("up").alias("e")).agg(F.sum("total").alias("more"))
        nxt = tree.select("run_id", F.col("e").alias("up"), F.col("up").alias("up2"))
        tree = cut(tree.join(got, ["run_id", "e"], "left").join(nxt, ["run_id", "up"], "left").select("run_id", "e", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"), "t", F.col("up2").alias("up")))
    return walk, tree.groupBy("run_id", "t").agg(F.sum("total").alias("extra"))


def _blocks(nodes: DataFrame, block_rows: int) -> DataFrame | None:
    """Nodes with `block` and `hot`, the latter for runs of several blocks; None if there is no such run.

    A block holds neighbouring ids, by the number at their end, as links mostly join neighbours. Where a stretch holds
    more than a block (equal numbers, or none at all), it is cut again by hash, so blocks are bounded whatever the ids.
    """
    hot = nodes.groupBy("run_id").count().where(F.col("count") > block_rows).select("run_id").withColumn("hot", F.lit(True))
    hot = cut(hot)
    if hot.isEmpty():
        return None
    number = F.regexp_extract("shard_id", r"(\d{1,15})$", 1)
    rows = nodes.join(hot, "run_id", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    rows = rows.withColumn("stretch", F.when(~F.col("hot"), 0).when(number != "", F.floor(number.cast("bigint") / block_rows)).otherwise(-1).cast("bigint"))
    sizes = rows.where("hot").groupBy("run_id", "stretch").agg(F.ceil(F.count("*") / block_rows).cast("bigint").alias("parts"))
    part = F.pmod(F.pmod(F.xxhash64("shard_id"), F.coalesce("parts", F.lit(1))), F.lit(_PARTS))
    return rows.join(sizes, ["run_id", "stretch"], "left").withColumn("block", (F.col("stretch") * _PARTS + part).cast("bigint")).drop("stretch", "parts")


def build(meta: DataFrame, paths: bool = False, block_rows: int = BLOCK_ROWS, starts: DataFrame | None = None) -> DataFrame:
    """(run_id, shard_id, parent_id, kind, head_id, steps, below[, path]) of every distinct record.

    kind: `rooted` (head_id is the root, steps the depth), `cycle`, `under_cycle` (head_id is the least id on the
    cycle, steps the links to its first record), `detached` (head_id is the last record, whose parent_id names no
    record). below: records of the subtree, itself included; null where there is no root. path: the ids from the root
    to the record; null where there is no root; only for the (run_id, shard_id) of `starts`, if given. An empty table
    gives no rows. Runs of more than `block_rows` records are cut into blocks, so no task holds a whole hot run.
    """
    nodes = resolve_parents(meta)
    if starts is None:
        nodes = cut(nodes.withColumn("want", F.lit(True)))
    else:
        nodes = cut(nodes.join(starts.select("run_id", "shard_id").distinct().withColumn("want", F.lit(True)), ["run_id", "shard_id"], "left").withColumn("want", F.coalesce("want", F.lit(False))))
    rooted = F.col("kind") == ROOTED
    keep = ["run_id", "shard_id", "parent_id", "kind", "head_id", F.col("steps").cast("int").alias("steps"), F.when(rooted, F.col("below")).alias("below"), *([F.when(rooted & F.col("want"), F.col("path")).alias("path")] if paths else [])]
    parts = _blocks(nodes, block_rows)
    if parts is None:
        flat = nodes.withColumns({"block": F.lit(0).cast("bigint"), "hot": F.lit(False)})
        return map_groups(flat, ["run_id", "block"], _local(paths), _LOCAL).select(*keep)
    local = cut(map_groups(parts, ["run_id", "block"], _local(paths), _LOCAL))
    # exits that no record answers end their lines
    gaps = local.where("ext is not null").select("run_id", "ext").distinct().join(local.select("run_id", F.col("shard_id").alias("ext")), ["run_id", "ext"], "left_anti").withColumn("gap", F.lit(True))
    gone = F.col("gap").isNotNull()
    local = cut(local.join(gaps, ["run_id", "ext"], "left").withColumns({"kind": F.when(gone, F.lit(DETACHED)).otherwise(F.col("kind")), "ext": F.when(~gone, F.col("ext"))}).drop("gap"))
    found, extra = _merge(local, paths)
    split = cut(local.where(F.col("kind") == OPEN).select("run_id").distinct())
    mine = found.where("cycle_head is not null").select("run_id", F.col("t").alias("shard_id"), "cycle_head")
    exits = found.select("run_id", F.col("t").alias("ext"), F.col("kind").alias("e_kind"), F.col("head").alias("e_head"), F.col("steps").alias("e_steps"), F.col("path").alias("e_path"))
    rows = local.join(split, "run_id", "left_semi").select("run_id", "block", "shard_id", "parent_id", "want", "ext").join(mine, ["run_id", "shard_id"], "left")
    rows = rows.join(exits, ["run_id", "ext"], "left").join(extra.withColumnRenamed("t", "shard_id"), ["run_id", "shard_id"], "left")
    second = map_groups(rows, ["run_id", "block"], _again(paths), _SECOND)
    return local.join(split, "run_id", "left_anti").select(*keep).unionByName(second.select(*keep))


def hierarchy(meta: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(run_id, shard_id, parent_id, state, root_id, depth, path, n_descendants) of every distinct record.

    depth is 0 for roots; root_id, depth and path are null where the line of parents reaches no root (state tells why).
    n_descendants counts the records below a rooted record; the records themselves come from `descendants`.
    """
    ok = F.col("kind") == ROOTED
    return build(meta, True, block_rows).select(
        "run_id", "shard_id", "parent_id", F.col("kind").alias("state"), F.when(ok, F.col("head_id")).alias("root_id"), F.when(ok, F.col("steps")).alias("depth"), "path", (F.col("below") - 1).alias("n_descendants")
    )


def descendants(meta: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(run_id, shard_id, descendant_id, distance): every record below every rooted record, one row each, so that the records below a hot root never form one value."""
    full = build(meta, True, block_rows).where(F.col("kind") == ROOTED)
    return full.select("run_id", F.col("shard_id").alias("descendant_id"), F.size("path").alias("n"), F.posexplode("path")).where("pos < n - 1").select("run_id", F.col("col").alias("shard_id"), "descendant_id", (F.col("n") - 1 - F.col("pos")).alias("distance"))


def unrooted(meta: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(run_id, shard_id, kind, head_id, steps) of the records that hang on no root."""
    return build(meta, False, block_rows).where(F.col("kind") != ROOTED).select("run_id", "shard_id", "kind", "head_id", "steps")
