"""Deeply nested semi-structured records to related flat tables.

Method: Arrow-buffer flattening (functions.jsonbuf): offsets and parent indices emit the child arrays of a whole batch,
keys go down by vectorised take; no row is parsed on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonbuf import OBJ, fields, flatten

#: Bytes of text indexed at once; a longer single text is indexed alone.
PIECE = 4 << 20


def pieces(batch: pa.RecordBatch, text: str, size: int = PIECE):
    """Slices of the batch with about `size` bytes of text each, the text column as large_string."""
    col = pc.cast(batch.column(text), pa.large_string())
    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(col):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
        yield batch.slice(at, to - at), col.slice(at, to - at)
        at = to


def _cases(batches):
    for batch in batches:
        for part, text in pieces(batch, "data"):
            out = flatten(text)
            if len(out["row"]):
                at = pa.array(out["row"])
                yield pa.RecordBatch.from_arrays([part.column("run_id").take(at), part.column("shard_id").take(at), pc.cast(out["parent_ptr"], pa.string()), pc.cast(out["child_ptr"], pa.string())], ["run_id", "shard_id", "parent_ptr", "child_ptr"])


def array_objects(shards: DataFrame) -> DataFrame:
    """(run_id, shard_id, parent_ptr, child_ptr) of every object that is a direct element of an array in `data`.

    Null, empty and invalid texts (by RFC 8259, from first to last character) give no rows; a text that is one JSON
    string holding an object or array is opened once. Repeated rows count once. The flattening is a map over the scan;
    only the short result rows are shuffled to drop repetitions.
    """
    rows = shards.select("run_id", "shard_id", "data").where("data is not null and (contains(data, '[') or contains(data, '\\\\'))")
    return rows.mapInArrow(_cases, "run_id bigint, shard_id string, parent_ptr string, child_ptr string").distinct()


def _objects(batches):
    for batch in batches:
        for part, text in pieces(batch, "data"):
            out = flatten(text, every=True)
            if not len(out["row"]):
                continue
            at, x, token = pa.array(out["row"]), out["index"], out["token"]
            up = x.up[token]
            in_array = pa.array((up >= 0) & (x.typ[np.maximum(up, 0)] != OBJ))
            child = pc.cast(out["child_ptr"], pa.string())
            parent = pc.if_else(pc.equal(child, ""), None, pc.cast(out["parent_ptr"], pa.string()))
            cols = [*(part.column(c).take(at) for c in ("run_id", "shard_id")), parent, child, pc.cast(out["table_path"], pa.string()), in_array, fields(x, token), *(part.column(c).take(at) for c in ("original_path", "data_type"))]
            whole = pa.table(cols, [c.split()[0] for c in _FLAT.split(", ")])
            yield from whole.to_batches(max_chunksize=20_000)


_FLAT = "run_id bigint, shard_id string, parent_ptr string, child_ptr string, table_path string, in_array boolean, fields map<string;string>, original_path array<string>, data_type string"


def one_delivery(shards: DataFrame) -> DataFrame:
    """(run_id, shard_id, data) of each stored shard, one whole row of its deliveries: the first written (where there is a time), of those the one of the least hash; null texts are left out."""
    first = ([F.col("written_at")] if "written_at" in shards.columns else []) + [F.xxhash64("data")]
    return shards.where("data is not null").groupBy("run_id", "shard_id").agg(F.min_by("data", F.struct(*first)).alias("data"))


def flat_objects(shards: DataFrame, meta: DataFrame) -> DataFrame:
    """Every object of every valid text as a row that names the object it lay in.

    parent_ptr: pointer of the nearest enclosing object ('' can be the root object; null for rows that lie in no
    object and hold the pointer '' themselves); table_path: the pointer with element numbers replaced by *, the name of
    the flat table; fields: own scalar members as JSON texts. original_path and data_type come from shard_meta (null
    where it has no record); of repeated deliveries there the one with the least values is taken. Texts are shuffled
    once by their key, to have one delivery of each beside its place; flattening follows, so flat rows are not shuffled.
    """
    place = meta.groupBy("run_id", "shard_id").agg(F.min("original_path").alias("original_path"), F.min("data_type").alias("data_type"))
    rows = one_delivery(shards).join(place, ["run_id", "shard_id"], "left")
    return rows.mapInArrow(_objects, _FLAT.replace(";", ","))
