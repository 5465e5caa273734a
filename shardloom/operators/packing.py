"""Next-fit packing of ordered items into chunks, by the policies of functions.sizes.opens_new."""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce
from math import floor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import cut, map_groups
from ..functions.sizes import opens_new, room


def fold(items: DataFrame, keys: list[str], order: str, size: str, limit: int, policy: str = "fill") -> DataFrame:
    """(keys, order, size, chunk): chunk numbers from 0 within the group, by a fold over its ordered array.

    For groups that fit a row (members of one container). Null sizes count 0; ties of `order` go by size.
    """
    item = F.struct(F.col(order).alias("o"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("s"))
    start = F.struct(F.lit(0).cast("bigint").alias("chunk"), F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("n"), F.array().cast("array<bigint>").alias("out"))

    def step(a, x):
        new = opens_new(a["size"], x["s"], limit, policy) & (a["n"] > 0)
        chunk = a["chunk"] + new.cast("bigint")
        return F.struct(chunk.alias("chunk"), F.when(new, x["s"]).otherwise(a["size"] + x["s"]).alias("size"), (a["n"] + 1).alias("n"), F.concat(a["out"], F.array(chunk)).alias("out"))

    packed = items.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))
    rows = packed.select(*keys, F.arrays_zip("items", F.aggregate("items", start, step, lambda a: a["out"]).alias("chunks")).alias("z")).select(*keys, F.inline("z"))
    return rows.select(*keys, F.col("items.o").alias(order), F.col("items.s").alias(size), F.col("chunks").alias("chunk"))


class _Block:
    """Neighbouring items of one group, packed from every state that may hold at their beginning.

    `next[i]` is the item that ends a chunk begun by item i. Chunks begun at different items soon coincide, so the state
    at the end (bytes of the open chunk, chunks begun) is a step function of the bytes open at the beginning, with as
    many steps as items fit one chunk at most.
    """

    def __init__(self, sizes: np.ndarray, cap: int, zero_cap: int | None):
        n = self.n = len(sizes)
        self.sums = p = np.r_[0, np.cumsum(sizes)]
        self.cap, self.zero_cap, self.sizes = cap, zero_cap, sizes
        first = np.where(sizes > 0, np.arange(n), n)
        self.positive = np.r_[np.minimum.accumulate(first[::-1])[::-1], n].astype(np.int64)  # first item of any bytes from i on
        me = np.arange(n)
        self.next = self._ends(me, p[:-1])
        at, self.count = np.where(self.next < n, self.next, me), (self.next < n).astype(np.int64)
        while not np.array_equal(at, at[at]):
            self.count = self.count + self.count[at]
            at = at[at]
        self.exit = p[n] - p[at]

    def _ends(self, begin: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The first item that a chunk open from `begin` on, with `base` bytes of the prefix not in it, has no room for."""
        n, p = self.n, self.positive[begin]
        j = np.maximum(np.searchsorted(self.sums, base + self.cap, "right") - 1, p + 1)
        j = np.minimum(j, n)
        if self.zero_cap is not None:
            inner = np.minimum(p, max(n - 1, 0))
            j = np.where((p > begin) & (p < n) & (self.sizes[inner] > self.zero_cap), p, j)
        return np.where(p >= n, n, j)

    def first_break(self, used: int) -> int:
        """The item that a chunk of `used` bytes before the block has no room for; n if it takes them all."""
        if used > 0:
            return min(max(int(np.searchsorted(self.sums, self.cap - used, "right")) - 1, 0), self.n)
        p = int(self.positive[0])
        if p < self.n and self.zero_cap is not None and self.sizes[p] > self.zero_cap:
            return p
        return int(self._ends(np.zeros(1, np.int64), np.zeros(1, np.int64))[0]) if p < self.n else self.n

    def table(self) -> dict:
        """Step function over the bytes open at the beginning: from lo on, (exit, chunks begun); exit -1: all is taken up."""
        j = np.arange(self.n - 1, -1, -1)
        lo = np.maximum(1, self.cap - self.sums[j + 1] + 1)
        j, lo = j[lo < self.cap + 2], lo[lo < self.cap + 2]
        last = np.r_[lo[1:] != lo[:-1], True]
        j, lo = j[last], lo[last]
        out, count = self.exit[j], self.count[j] + 1
        if self.cap - self.sums[-1] >= 1:
            lo, out, count = np.r_[1, lo], np.r_[-1, out], np.r_[0, count]
        keep = np.r_[True, (out[1:] != out[:-1]) | (count[1:] != count[:-1]) | (out[1:] < 0)]
        k = self.first_break(0)
        zero = (int(self.sums[-1]), 0) if k >= self.n else (int(self.exit[k]), int(self.count[k]) + 1)
        return {"lo": lo[keep].tolist(), "exit": out[keep].tolist(), "count": count[keep].tolist(), "zero_exit": zero[0], "zero_count": zero[1], "total": int(self.sums[-1]), "first_exit": int(self.exit[0]), "first_count": int(self.count[0])}

    def chunks(self, used: int) -> np.ndarray:
        """Number of chunks begun up to each item, for `used` bytes open at the beginning (-1: the group begins here)."""
        new = np.zeros(self.n, np.int64)
        k = int(self.next[0]) if used < 0 else self.first_break(used)
        while k < self.n:
            new[k] = 1
            k = int(self.next[k])
        return np.cumsum(new)


_TABLE = "lo array<bigint>, exit array<bigint>, count array<bigint>, zero_exit bigint, zero_count bigint, total bigint, first_exit bigint, first_count bigint"


def _edges(t: pa.Table, names: list[str]) -> list[int]:
    """Rows at which a new group of `names` begins, and the number of rows."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in names:
        col = t.column(c).combine_chunks()
        code = col.dictionary_encode(null_encoding="encode")
        code = (code if isinstance(code, pa.DictionaryArray) else code.combine_chunks()).indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return [*np.flatnonzero(new).tolist(), t.num_rows]


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null equals null; columns of `b` other than the keys are added."""
    named = b.select(*(F.col(k).alias(f"{k}__") for k in keys), *(c for c in b.columns if c not in keys))
    return a.join(named, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys]), how).drop(*(f"{k}__" for k in keys))


def stream(items: DataFrame, keys: list[str], order: str, size: str, limit: int, policy: str = "fill", block: int = 1 << 17) -> DataFrame:
    """The same for groups of any length, with the same result.

    The rows are cut by sampled ranges of (keys, order) into blocks of about `block` rows, whatever the values of the
    order. Next-fit over a block is a function of the bytes open at its beginning; it is tabulated for each block of a
    group that has several, the tables are composed in order over one row a block, and the blocks are packed again from
    the states found. So no task holds a whole hot group. `order` must be integral; null sizes count 0; ties of `order`
    go by size; null keys form a group.
    """
    usable, fill = room(limit)
    cap, zero_cap = {"fill": (fill, usable), "tight": (floor(limit * 0.9), None), "plain": (limit, None)}[policy]
    rows = items.select(*keys, F.col(order).cast("bigint").alias(order), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias(size))
    parts = -(-rows.count() // block)
    if parts > 1:
        rows = cut(rows.repartitionByRange(parts, *keys, order, size).withColumn("block_", F.spark_partition_id().cast("bigint")))
        spans = rows.groupBy(*keys).agg((F.min("block_") < F.max("block_")).alias("long_"))
        rows = _same(rows, spans, keys)
    else:
        rows = rows.withColumns({"block_": F.lit(0).cast("bigint"), "long_": F.lit(False)})
    names = [*keys, "block_"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    in_order = lambda t: t.sort_by([(c, "ascending") for c in [*names, order, size]])

    def tabulate(t: pa.Table) -> pa.Table:
        t = in_order(t)
        edge, sizes = _edges(t, names), t.column(size).to_numpy()
        found = [_Block(sizes[a:b], cap, zero_cap).table() for a, b in zip(edge, edge[1:])]
        lists = {f.split()[0]: pa.list_(pa.int64()) if "array" in f else pa.int64() for f in _TABLE.split(", ")}
        head = t.select(names).take(pa.array(edge[:-1], pa.int64()))
        return pa.table([*head.columns, *(pa.array([x[c] for x in found], k) for c, k in lists.items())], [*names, *lists])

    def compose(batches):
        now = used = base = None
        for batch in batches:
            entry, number = [], []
            for x in batch.to_pylist():
                key = tuple(x[k] for k in keys)
                if key != now:
                    now, used, base = key, -1, 0
                entry.append(used), number.append(base)
                if used < 0:
                    used, base = x["first_exit"], x["first_count"]
                elif used == 0:
                    used, base = x["zero_exit"], base + x["zero_count"]
                else:
                    i = bisect_right(x["lo"], used) - 1
                    used, base = (used + x["total"] if x["exit"][i] < 0 else x["exit"][i]), base + x["count"][i]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(entry, pa.int64()), pa.array(number, pa.int64())], [*names, "entry_", "base_"])

    def pack(t: pa.Table) -> pa.Table:
        t = in_order(t)
        edge, sizes, entry, base = _edges(t, names), t.column(size).to_numpy(), pc.fill_null(t.column("entry_"), -1).to_numpy(), pc.fill_null(t.column("base_"), 0).to_numpy()
        out = [_Block(sizes[a:b], cap, zero_cap).chunks(int(entry[a])) + base[a] for a, b in zip(edge, edge[1:])]
        return t.select([*keys, order, size]).append_column("chunk", pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))

    if parts <= 1:  # no group has several blocks, so none is entered
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys, order, size).schema)
        begun = rows.drop("long_").withColumns({"entry_": F.lit(-1).cast("bigint"), "base_": F.lit(0).cast("bigint")})
        return map_groups(begun, names, pack, f"{fields}, chunk bigint")
    tables = map_groups(rows.where("long_").drop("long_"), names, tabulate, f"{kinds}, {_TABLE}")
    states = tables.repartition(*keys).sortWithinPartitions(*names).mapInArrow(compose, f"{kinds}, entry_ bigint, base_ bigint")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys, order, size).schema)
    return map_groups(_same(rows.drop("long_"), states, names, "left"), names, pack, f"{fields}, chunk bigint")


def chunk_table(packed: DataFrame, keys: list[str], order: str, size: str) -> DataFrame:
    """(keys, chunk, n_items, bytes, first, last) of each chunk."""
    return packed.groupBy(*keys, "chunk").agg(F.count("*").alias("n_items"), F.sum(size).alias("bytes"), F.min(order).alias("first"), F.max(order).alias("last"))


def number(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks with shard_id `shard_001`... in their order, and the ids before and after: dense numbers need no window."""
    name = lambda n: F.format_string("shard_%03d", n)
    last = chunks.groupBy(*keys).agg(F.max("chunk").alias("last_"))
    c = F.col("chunk")
    return _same(chunks, last, keys).select(*chunks.columns, name(c + 1).alias("shard_id"), F.when(c > 0, name(c)).alias("previous_shard"), F.when(c < F.col("last_"), name(c + 2)).alias("next_shard"))
