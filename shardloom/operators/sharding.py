"""Cutting JSON documents into linked, size-bounded shards.

A document is cut on its own, by one of three plans (by the class of its structure): `dict` gives every nested object a
shard, `list` packs elements into slices, `mixed` hands the values of its root to the other two. Packing is next-fit:
it is sequential within one container and independent between documents, so documents are the unit of parallelism.

Two modes: `reference` keeps known quirks of the behaviour to be matched (an empty list under an object loses its key,
slices of simple lists are numbered by the length of the current chunk, a split root leaves its children pointing to the
dropped id, an oversized scalar of an object loses its key, paths below a mixed root are relative). `lossless` repairs
these: every shard names the absolute place of its data, so `rebuild` gives the document back.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import floor

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsonnodes import compact, compact_bytes, strict_parse

# fixed values: defaults, bytes of the file schema around a value, shares of overhead and metadata
MAX_SIZE = 92160
SCHEMA_BYTES = 228
OVERHEAD_SHARE, OVERHEAD_BYTES, FILL = 0.08, 64, 0.85

OUT = "doc_id string, ord int, shard_id string, parent_id string, child_ids array<string>, data_type string, original_path array<string>, next_shard string, previous_shard string, version string, data string, size bigint, data_structure string"


def kind_of(v: object) -> str:
    return "dict" if isinstance(v, dict) else "list" if isinstance(v, list) else "primitive"


def structure_of(v: object) -> str:
    """Class that decides the plan: by the share of objects among the root's values, or by the kinds of its elements."""
    kinds = [kind_of(x) for x in (v.values() if isinstance(v, dict) else v)]
    if isinstance(v, list):
        return "mixed" if len(set(kinds)) > 1 else "list"
    if not kinds or kinds.count("dict") / len(kinds) >= 0.7:
        return "dict-of-dicts"
    return "mixed" if set(kinds) != {"primitive"} else "dict-of-dicts"


def compact_size(v: object) -> int:
    """Compact bytes; bare scalars by the rule for scalars: booleans 5 and 4 the wrong way round, only quotes and backslashes of strings escaped."""
    if v is None:
        return 4
    if isinstance(v, bool):
        return 5 if v else 4
    if isinstance(v, str):
        return (len(v) if v.isascii() else len(v.encode("utf-8", "replace"))) + 2 + v.count('"') + v.count("\\")
    return compact_bytes(v)


def _lines(v: object, d: int) -> int:
    """Bytes that indenting by two adds to the compact text of a container whose depth is d."""
    total, level = 0, [v]
    while level:  # all containers of a depth
        below: list = []
        for x in level:
            if x:
                pairs = isinstance(x, dict)
                total += len(x) * ((4 if pairs else 3) + 2 * d) + 1 + 2 * d
                below += [y for y in (x.values() if pairs else x) if isinstance(y, (dict, list))]
        level, d = below, d + 1
    return total


def sorted_keys(v: object) -> object:
    """The value with the keys of all objects in code point order, lists as they are; of any depth."""
    top: list = [None]
    todo: list[tuple[object, object, object]] = [(v, top, 0)]
    while todo:
        x, into, at = todo.pop()
        if isinstance(x, dict):
            new: object = dict.fromkeys(sorted(x))
            todo += [(y, new, k) for k, y in x.items()]
        elif isinstance(x, list):
            new = [None] * len(x)
            todo += [(y, new, i) for i, y in enumerate(x)]
        else:
            new = x
        into[at] = new  # type: ignore[index]
    return top[0]


def file_size(v: object) -> int:
    """Estimated bytes of a value's shard file: the formatted text with its metadata, a share and a constant on top."""
    b = SCHEMA_BYTES + compact_bytes(v) + (_lines(v, 1) if isinstance(v, (dict, list)) else 0)
    return b + floor(b * OVERHEAD_SHARE) + OVERHEAD_BYTES


def opens_new(current: int, new: int, limit: int) -> bool:
    """Whether an item goes to a new chunk: it would pass 85 % of the limit less its reserve, or the latter at all."""
    reserve = 0.08 if limit >= 90000 else 0.10 if limit >= 50000 else 0.15
    room = limit - floor(limit * reserve)
    return (current + new > floor(room * FILL) and current > 0) or current + new > room


class Ref(dict):
    """A reference to another shard in place of a value."""


@dataclass
class Shard:
    shard_id: str
    data: object
    data_type: str
    path: list[str]
    parent_id: str | None = None
    child_ids: list[str] = field(default_factory=list)
    next_shard: str | None = None
    previous_shard: str | None = None


def chain(shards: list[Shard]) -> None:
    for a, b in zip(shards, shards[1:]):
        a.next_shard, b.previous_shard = b.shard_id, a.shard_id


class Cutter:
    """One document's cutting: limit, mode and the counters its ids come from."""

    def __init__(self, limit: int = MAX_SIZE, lossless: bool = True):
        self.limit, self.lossless, self.count = limit, lossless, 0

    def new_id(self) -> str:
        self.count += 1
        return f"shard_{self.count:03d}"

    # next-fit over the members of a container, by file size

    def chunks(self, v: object, path: list[str]) -> Iterator[tuple[object, list[str]]]:
        """(chunk, path) of a container's members; members over the limit are cut further, or stand alone if scalars."""
        if not isinstance(v, (dict, list)):
            yield v, path
            return
        pairs = isinstance(v, dict)
        held: list[tuple[object, object]] = []
        size = first = 0

        def flush():
            if held:
                part = dict(held) if pairs else [x for _, x in held]
                yield part, path if pairs or not self.lossless else [*path, f"[{first}:{first + len(held)}]"]

        for i, (key, item) in enumerate(v.items() if pairs else enumerate(v)):
            n = file_size({key: item} if pairs else item)
            here = [*path, key if pairs else f"[{i}]"]
            if n > self.limit:
                yield from flush()
                held, size, first = [], 0, i + 1
                if isinstance(item, (dict, list)) and item and not (self.lossless and isinstance(item, Ref)):
                    yield from self.chunks(item, here)
                else:
                    yield ({key: item}, path) if pairs and self.lossless else ([item], [*path, f"[{i}:{i + 1}]"]) if self.lossless else (item, here)
            elif opens_new(size, n, self.limit):
                yield from flush()
                held, size, first = [(key, item)], n, i
            else:
                held.append((key, item))
                size += n
        yield from flush()

    def from_chunks(self, parts: Iterable[tuple[object, list[str]]], parent: str | None) -> list[Shard]:
        out = [Shard(self.new_id(), x, kind_of(x), p, parent) for x, p in parts]
        chain(out)
        return out

    # objects

    def cut_dict(self, v: dict, path: list[str], parent: str | None = None) -> list[Shard]:
        """The shard of an object, then those of its nested objects, lists and overflow, in pre-order."""
        me = Shard(self.new_id(), {}, "dict", path, parent)
        own: dict = {k: x for k, x in v.items() if not isinstance(x, (dict, list))}
        below: list[Shard] = []
        for kind in (dict, list):
            for k, x in v.items():
                if not isinstance(x, kind):
                    continue
                there = [*path, k]
                parts = self.cut_dict(x, there, me.shard_id) if kind is dict else self.list_below(x, there, me.shard_id)
                if parts:
                    below += parts
                    me.child_ids.append(parts[0].shard_id)
                    own[k] = Ref(_shard_ref=parts[0].shard_id, _shard_type=kind_of(x), _original_path=there)
        if self.lossless:
            own = {k: own[k] for k in v if k in own}
        me.data = own
        if file_size(own) > self.limit:
            rest = list(self.chunks(own, path))
            if len(rest) > 1:
                me.data = rest[0][0]
                for i, (x, p) in enumerate(rest[1:], 1):
                    more = Shard(f"{me.shard_id}_overflow_{i}", x, "dict", p, me.shard_id)
                    below.append(more)
                    me.child_ids.append(more.shard_id)
        return [me, *below]

    def list_below(self, v: list, path: list[str], parent: str) -> list[Shard]:
        parts = list(self.chunks(v, path))
        if not parts and self.lossless:
            parts = [([], [*path, "[]"])]
        out = self.from_chunks(parts, parent)
        if not self.lossless:
            for s in out:
                s.data_type, s.path = "list", path
        return out

    # lists

    def tight(self, v: list) -> list[list]:
        """Next-fit by compact size up to nine tenths of the limit, without regard to single items above it."""
        out: list[list] = []
        size = 0
        for x in v:
            n = compact_size(x)
            if not out or size + n > self.limit * 0.9:
                out.append([])
                size = 0
            out[-1].append(x)
            size += n
        return out or [[]]

    def slices(self, part: list, start: int, path: list[str]) -> list[Shard]:
        """The shards of neighbouring elements from `start` on."""
        out = []
        for x in [part] if compact_size(part) <= self.limit else self.tight(part):
            out.append(Shard(self.new_id(), x, "list", [*path, f"[{start}:{start + len(x)}]"]))
            start += len(x)
        return out

    def runs(self, v: list, apart, path: list[str], alone) -> list[Shard]:
        """Next-fit over elements by compact size; elements for which `apart` holds end the chunk and are cut by `alone`."""
        out: list[Shard] = []
        held: list = []
        size = start = 0
        for i, x in enumerate(v):
            if apart(x):
                out += self.slices(held, start, path) if held else []
                out += alone(x, i)
                held, size, start = [], 0, i + 1
                continue
            n = compact_size(x)
            if opens_new(size, n, self.limit):
                out += self.slices(held, start, path) if held else []
                held, size, start = [x], n, i
            else:
                held.append(x)
                size += n
        return out + (self.slices(held, start, path) if held else [])

    def cut_list(self, v: list, path: list[str] | None = None) -> list[Shard]:
        path = path or []
        if not v:
            return [Shard(self.new_id(), [], "list", [*path, "[]"])]
        if not any(isinstance(x, (dict, list)) for x in v):
            out, at = [], 0
            for i, x in enumerate(self.tight(v)):
                a, b = (at, at + len(x)) if self.lossless else (i * len(x), (i + 1) * len(x))
                out.append(Shard(self.new_id(), x, "list", [*path, f"[{a}:{b}]"]))
                at += len(x)
        else:
            out = self.runs(v, lambda x: compact_size(x) > self.limit, path, lambda x, i: self.oversized(x, i, path))
        chain(out)
        return out

    def oversized(self, x: object, i: int, path: list[str]) -> list[Shard]:
        here = [*path, f"[{i}]"]
        if isinstance(x, dict):
            return self.cut_dict(x, here)
        if isinstance(x, list):
            return self.cut_list(x, here)
        return [Shard(self.new_id(), {"_warning": "Oversized primitive item", "_original_index": i, "_item": x}, "primitive", here)]

    # mixed roots

    def heavy(self, x: object) -> bool:
        """Whether an element of a mixed list gets shards of its own: large, long, or with containers in it."""
        if not isinstance(x, (dict, list)):
            return False
        inner = x.values() if isinstance(x, dict) else x
        return compact_size(x) > self.limit * 0.3 or len(x) > (10 if isinstance(x, dict) else 20) or any(isinstance(y, (dict, list)) for y in inner)

    def cut_mixed(self, v: object) -> list[Shard]:
        if isinstance(v, list):
            out = self.runs(v, self.heavy, [], self.wrapped)
            chain([s for s in out if s.data_type == "list"])
            return out
        root = Shard(self.new_id(), {k: x for k, x in v.items() if not isinstance(x, (dict, list))}, "dict", [])
        below: list[Shard] = []
        for kind in (dict, list):
            for k, x in v.items():
                if not isinstance(x, kind):
                    continue
                there = [k] if self.lossless else []
                parts = self.cut_dict(x, there) if kind is dict else self.cut_list(x, there)
                parts[0].parent_id = root.shard_id
                root.child_ids.append(parts[0].shard_id)
                root.data[k] = Ref(_shard_ref=parts[0].shard_id, _shard_type=kind_of(x), _processor=f"{kind_of(x)}_processor", _original_path=[k])
                below += parts
        if self.lossless:
            root.data = {k: root.data[k] for k in v}
        if file_size(root.data) <= self.limit:
            return [root, *below]
        heads = self.from_chunks(self.chunks(root.data, []), None)
        if self.lossless:
            old, first = root.shard_id, heads[0]
            first.child_ids = root.child_ids
            for s in below:
                if s.parent_id == old:
                    s.parent_id = first.shard_id
        return [*heads, *below]

    def wrapped(self, x: object, i: int) -> list[Shard]:
        here = [f"[{i}]"]
        parts = self.cut_dict(x, here if self.lossless else []) if isinstance(x, dict) else self.cut_list(x, here if self.lossless else [])
        data = {"_list_item_index": i, "_shard_ref": parts[0].shard_id, "_shard_type": kind_of(x), "_processor": f"{kind_of(x)}_processor"}
        me = Shard(self.new_id(), data, kind_of(x), here, child_ids=[parts[0].shard_id])
        parts[0].parent_id = me.shard_id
        return [me, *parts]

    def cut(self, v: object, structure: str | None = None) -> list[Shard]:
        structure = structure or structure_of(v)
        if structure == "mixed":
            return self.cut_mixed(v)
        return self.cut_list(v) if isinstance(v, list) else self.cut_dict(v, [])


def rebuild(shards: Iterable[tuple[str, list[str], object]]) -> object:
    """The document from its lossless shards (shard_id, path, data) in order: the reverse, an addition of this engine.

    Shards are laid down at their places: object chunks are merged into the object there, slices put into the list
    there. References to shards of the document at the very place they name are left out, as those shards fill it.
    """
    rows = list(shards)
    ids = {i for i, _, _ in rows}

    class Box:
        """A container whose kind is known once something is laid into it."""

        def __init__(self):
            self.kind, self.items = None, {}

        def child(self, seg):
            return self.items.setdefault(seg, Box())

    def is_ref(x, path):
        return isinstance(x, dict) and x.get("_shard_ref") in ids and x.get("_original_path") == path

    root = Box()
    for _, path, data in rows:
        if isinstance(data, dict) and "_list_item_index" in data and data.get("_shard_ref") in ids:
            continue
        tail = path[-1] if path else ""
        sliced = isinstance(data, list) and (tail == "[]" or (tail.startswith("[") and ":" in tail))
        box = root
        for seg in path[:-1] if sliced else path:
            box = box.child(seg)
        if isinstance(data, dict) and data.keys() == {"_warning", "_original_index", "_item"}:
            box.kind, box.items = "value", data["_item"]
        elif sliced:
            box.kind = "list"
            start = int(tail[1:].split(":")[0]) if tail != "[]" else 0
            for k, x in enumerate(data):
                leaf = box.child(f"[{start + k}]")
                leaf.kind, leaf.items = "value", x
        else:
            box.kind = "dict"
            for k, x in data.items():
                leaf = box.child(k)
                if not is_ref(x, [*path, k]):
                    leaf.kind, leaf.items = "value", x

    def read(b: Box):
        if b.kind == "value":
            return b.items
        if b.kind == "dict" or (b.kind is None and not all(k[:1] == "[" and k[-1:] == "]" and k[1:-1].isdigit() for k in b.items)):
            return {k: read(x) for k, x in b.items.items()}
        return [read(b.items[k]) for k in sorted(b.items, key=lambda k: int(k[1:-1]))]

    return read(root)


def _shard_batches(batches, limit: int, lossless: bool, sort: bool):
    names = [c.split()[0] for c in OUT.split(", ")]
    texts, lists = pa.string(), pa.list_(pa.string())
    types = [texts, pa.int32(), texts, texts, lists, texts, lists, texts, texts, texts, texts, pa.int64(), texts]
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("json").to_pylist()):
            v, error, _ = strict_parse(text)
            if error:
                continue
            if sort:
                v = sorted_keys(v)
            structure = structure_of(v)
            try:
                cut = Cutter(limit, lossless).cut(v, structure)
            except RecursionError:  # nested too deeply to be cut: the document stays whole
                cut = [Shard("shard_001", v, kind_of(v), [] if isinstance(v, dict) else [f"[0:{len(v)}]"])]
            for i, s in enumerate(cut):
                rows.append((doc, i, s.shard_id, s.parent_id, s.child_ids, s.data_type, s.path, s.next_shard, s.previous_shard, "1.0.0", compact(s.data), file_size(s.data), structure))
        cols = list(zip(*rows)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names)


def shard(corpus: DataFrame, limit: int = MAX_SIZE, mode: str = "lossless", sort: bool = True) -> DataFrame:
    """The shards of every valid document of a corpus; invalid ones give none (see sources.corpus.canonical for their errors).

    sort: keys in code point order first, the default of the pipeline. Documents nested more deeply than the recursion
    of the cutting allows (about 900 levels) stay whole, as one shard. A map over documents, no shuffle.
    """
    if limit <= 0:
        raise ValueError("limit must be positive")
    return corpus.select("doc_id", "json").mapInArrow(lambda b: _shard_batches(b, limit, mode == "lossless", sort), OUT)


_PIECES = "doc_id string, ord int, piece int, pieces int, data_type string, data string, size bigint"


def _resplit(batches, limit: int, lossless: bool):
    for batch in batches:
        rows = []
        for doc, at, data, path in zip(*(batch.column(i).to_pylist() for i in range(4))):
            parts = list(Cutter(limit, lossless).chunks(json.loads(data), path or []))
            rows += [(doc, at, i, len(parts), kind_of(x), compact(x), file_size(x)) for i, (x, _) in enumerate(parts)]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64()]
        cols = list(zip(*rows)) if rows else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], [c.split()[0] for c in _PIECES.split(", ")])


def redistribute(shards: DataFrame, limit: int, lossless: bool = False) -> DataFrame:
    """Shards with those over the limit cut again; the others stay as they are.

    New shards keep the parent and the path of the one they come from, are chained among themselves, and are numbered on
    from the greatest number of the document; links to the old shard stay as they are. An empty container over the limit
    (which has no members to cut) stays. `ord` goes on being the order within a document.
    """
    over = F.col("size") > limit
    cut = shards.where(over).select("doc_id", "ord", "data", "original_path").mapInArrow(lambda b: _resplit(b, limit, lossless), _PIECES)
    number = F.coalesce(F.regexp_extract("shard_id", r"^shard_(\d{1,15})", 1).try_cast("bigint"), F.lit(0))
    last = shards.groupBy("doc_id").agg(F.max(number).alias("last_"))
    w = Window.partitionBy("doc_id").orderBy("ord")  # one row for each shard that is cut
    start = cut.where("piece = 0").select("doc_id", "ord", (F.sum("pieces").over(w) - F.col("pieces")).alias("before_")).join(last, "doc_id").select("doc_id", "ord", (F.col("before_") + F.col("last_")).alias("base_"))
    name = lambda i: F.format_string("shard_%03d", F.col("base_") + i)
    i = F.col("piece")
    old = shards.where(over).select("doc_id", "ord", "shard_id", "parent_id", "original_path", "version", "data_structure", *(F.col(c).alias(f"{c}_") for c in ("child_ids", "data_type", "data", "size", "next_shard", "previous_shard")))
    none = F.array().cast("array<string>")
    j = old.join(cut.join(start, ["doc_id", "ord"]), ["doc_id", "ord"], "left")
    made = F.col("piece").isNotNull()
    pick = lambda new, kept: F.when(made, new).otherwise(F.col(kept))
    new = j.select(
        "doc_id", "ord", F.coalesce("piece", F.lit(0)).alias("piece"), pick(name(i + 1), "shard_id").alias("shard_id"), "parent_id", pick(none, "child_ids_").alias("child_ids"), pick(F.col("data_type"), "data_type_").alias("data_type"), "original_path",
        pick(F.when(i + 1 < F.col("pieces"), name(i + 2)), "next_shard_").alias("next_shard"), pick(F.when(i > 0, name(i)), "previous_shard_").alias("previous_shard"), "version", pick(F.col("data"), "data_").alias("data"), pick(F.col("size"), "size_").alias("size"), "data_structure",
    )
    rows = shards.where(~F.coalesce(over, F.lit(False))).withColumn("piece", F.lit(0)).unionByName(new)
    order = Window.partitionBy("doc_id").orderBy("ord", "piece")  # a document is cut in one task, so its shards are bounded by it
    return rows.withColumn("ord", (F.row_number().over(order) - 1).cast("int")).drop("piece")


def document_table(shards: DataFrame, corpus: DataFrame) -> DataFrame:
    """(doc_id, version, original_size, shard_count, root_shard, data_structure) of each sharded document."""
    per = shards.groupBy("doc_id").agg(F.count("*").cast("int").alias("shard_count"), F.min_by("shard_id", "ord").alias("root_shard"), F.first("data_structure").alias("data_structure"))
    return per.join(corpus.select("doc_id", F.octet_length("json").cast("bigint").alias("original_size")), "doc_id").select("doc_id", F.lit("1.0.0").alias("version"), "original_size", "shard_count", "root_shard", "data_structure")


def rebuild_corpus(shards: DataFrame) -> DataFrame:
    """(doc_id, json), keys sorted, from lossless shards; the shards of one document, bounded by the document, meet in one task."""
    parts = shards.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "shard_id", "original_path", "data"))).alias("parts"))

    def run(batches):
        for batch in batches:
            out = [compact(rebuild((p["shard_id"], p["original_path"], json.loads(p["data"])) for p in parts), True) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "json"])

    return parts.mapInArrow(run, "doc_id string, json string")
