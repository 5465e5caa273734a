"""Filling fixed-capacity containers with items of varying length.

Method: large-item matching. At most two items above a third of the capacity fit one container, so these are paired
greedily, each with the largest partner that fits; the smaller items then go, largest first, where they leave the least
room. Items are packed in blocks of some thousand containers, spread by hash, so that the few hot classes never form one
task; a block wastes at most a few containers, well under a thousandth.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import cut, map_groups

#: Containers' worth of items in a block.
BLOCK = 2048


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, all of them at most `capacity`; deterministic, ties by position."""
    order = np.argsort(-sizes, kind="stable")
    out = np.full(len(sizes), -1, np.int64)
    n_large = int(np.searchsorted(-sizes[order], -(capacity / 3), "left"))  # strictly above a third
    large = order[:n_large].tolist()
    room: list[tuple[int, int]] = []  # (gap, container), sorted
    n = 0
    # from the largest on, each takes the largest of those left that fits beside it
    left = [(int(sizes[i]), -k, i) for k, i in enumerate(large)][::-1]  # ascending by size
    free = list(range(len(left) + 1))  # free[j]: j itself, or lower where j is taken; 0 stands for none, entries count from 1

    def last_free(j: int) -> int:
        while free[j] != j:
            free[j] = free[free[j]]
            j = free[j]
        return j

    while hi := last_free(len(left)):
        s, _, i = left[hi - 1]
        free[hi] = hi - 1
        out[i] = n
        gap = capacity - s
        if j := last_free(min(bisect_left(left, (gap + 1,)), hi)):
            free[j] = j - 1
            out[left[j - 1][2]] = n
            gap -= left[j - 1][0]
        if gap:
            insort(room, (gap, n))
        n += 1
    for i in order[n_large:].tolist():
        s = int(sizes[i])
        at = bisect_left(room, (s,))
        if at < len(room):
            gap, c = room.pop(at)
        else:
            gap, c = capacity, n
            n += 1
        out[i] = c
        if gap > s:
            insort(room, (gap - s, c))
    return out


def _pack_groups(t: pa.Table) -> pa.Table:
    kind, block = t.column("data_structure").to_pylist(), t.column("block").to_numpy()
    size, cap = t.column("bytes").to_numpy(), t.column("capacity_bytes").to_numpy()
    n = len(size)
    edge = [0, *(i for i in range(1, n) if block[i] != block[i - 1] or kind[i] != kind[i - 1]), n]
    bins, fill = np.zeros(n, np.int64), np.zeros(n, np.int64)
    run, shard, piece = t.column("run_id").to_pylist(), t.column("shard_id").to_pylist(), t.column("piece").to_pylist()
    for a, b in zip(edge, edge[1:]):
        if a == b:
            continue
        order = np.array(sorted(range(a, b), key=lambda i: (run[i], shard[i] or "", piece[i])))
        got = pack(size[order], int(cap[a]))
        bins[order] = got
        fill[order] = np.bincount(got, weights=size[order])[got].astype(np.int64)
    return t.append_column("bin", pa.array(bins)).append_column("bin_bytes", pa.array(fill))


def shard_lengths(shards: DataFrame, docs: DataFrame) -> DataFrame:
    """(run_id, shard_id, data_structure, bytes) of each stored shard.

    Length is the UTF-8 bytes of `data`; where that is null, `size` if positive, else 0. Repeated rows count once (of
    differing ones the longest). Only lengths are shuffled. A run without doc_meta has a null data_structure.
    """
    size = F.coalesce(F.octet_length("data").cast("bigint"), F.when(F.col("size") > 0, F.col("size")), F.lit(0).cast("bigint"))
    rows = shards.select("run_id", "shard_id", size.alias("bytes")).groupBy("run_id", "shard_id").agg(F.max("bytes").alias("bytes"))
    return rows.join(docs.groupBy("run_id").agg(F.min("data_structure").alias("data_structure")), "run_id", "left")


def assign(items: DataFrame, spec: DataFrame, block: int = BLOCK) -> DataFrame:
    """(run_id, shard_id, piece, n_pieces, data_structure, bytes, capacity_bytes, bin_id, bin_bytes) of every item.

    Containers hold one data_structure only. An item above the capacity is divided into full pieces and a rest (the
    full ones have a container each); others have one piece. Items whose data_structure has no capacity come out with
    null container. Items of no bytes are packed like others. Empty tables give no rows. `bin_id` is unique within
    (data_structure).
    """
    cap = spec.select("data_structure", "capacity_bytes").where("data_structure is not null and capacity_bytes > 0").groupBy("data_structure").agg(F.min("capacity_bytes").alias("capacity_bytes"))
    # lengths are wanted twice, for the totals and for the packing; texts are read for them once
    rows = cut(items.select("run_id", "shard_id", "data_structure", "bytes").join(cap, "data_structure", "left"))
    c, b = F.col("capacity_bytes"), F.col("bytes")
    n = F.when(b > c, F.ceil(b / c)).otherwise(1)
    parts = rows.select("run_id", "shard_id", "data_structure", "capacity_bytes", b.alias("whole"), n.cast("int").alias("n_pieces"), F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("piece"))
    size = F.when(F.col("n_pieces") == 1, F.col("whole")).when(F.col("piece") < F.col("n_pieces"), c).otherwise(F.col("whole") - (F.col("n_pieces") - 1) * c)
    parts = parts.withColumn("bytes", size).drop("whole")
    # blocks of some `block` containers each, from the totals by data_structure, which are as few as the specification's rows
    totals = rows.where(c.isNotNull()).groupBy("data_structure").agg(F.sum("bytes").alias("all_bytes"), F.count("*").alias("all_items"))
    blocks = totals.join(cap, "data_structure").select("data_structure", F.ceil(F.greatest(F.col("all_bytes") / c / block, F.col("all_items") / (64 * block))).alias("blocks")).collect()
    few = {r.data_structure: max(1, r.blocks) for r in blocks}
    n_blocks = F.create_map(*(F.lit(v) for s, k in few.items() for v in (s, k)))[F.col("data_structure")] if few else F.lit(1)
    key = F.pmod(F.xxhash64("run_id", "shard_id", "piece"), n_blocks.cast("bigint"))
    schema = "run_id bigint, shard_id string, data_structure string, capacity_bytes bigint, n_pieces int, piece int, bytes bigint, block bigint"
    cols = [x.split()[0] for x in schema.split(", ")]
    ready = parts.where(c.isNotNull()).withColumn("block", key).select(cols)
    packed = map_groups(ready, ["data_structure", "block"], _pack_groups, f"{schema}, bin bigint, bin_bytes bigint")
    packed = packed.withColumn("bin_id", F.concat_ws("-", "block", "bin"))
    out = ["run_id", "shard_id", "piece", "n_pieces", "data_structure", "bytes", "capacity_bytes"]
    none = parts.where(c.isNull()).select(*out, F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("bigint").alias("bin_bytes"))
    return packed.select(*out, "bin_id", "bin_bytes").unionByName(none)


def containers(assignment: DataFrame) -> DataFrame:
    """(data_structure, containers, items, bytes, room, least_containers) by data_structure."""
    one = assignment.where("bin_id is not null").groupBy("data_structure", "bin_id").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("items"), F.max("capacity_bytes").alias("c"))
    return one.groupBy("data_structure").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("bytes").alias("bytes"), F.sum(F.col("c") - F.col("bytes")).alias("room"), F.ceil(F.sum("bytes") / F.max("c")).alias("least_containers"))
