"""Streams of JSON documents: sharding as files arrive, and next-fit chunks of their members."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.jsonnodes import compact
from ..functions.sizes import scalar_size
from ..operators import packing, sharding


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (doc_id, json) over the JSON files that appear in a folder."""
    return spark.readStream.schema("value string").option("wholetext", "true").text(folder).select(F.col("_metadata.file_name").alias("doc_id"), F.col("value").alias("json"))


def shard_stream(docs: DataFrame, out: str, checkpoint: str, limit: int = sharding.MAX_SIZE) -> StreamingQuery:
    """Shard each document as it arrives and append the shards to a table; documents are independent, so there is no state."""
    return sharding.shard(docs, limit).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def chunk_members(value: dict | list, limit: int) -> Iterator[tuple[str | None, dict | list, int]]:
    """(key, chunk, bytes) of a container's members by plain next-fit; a member over the limit comes alone, under its key if it has one."""
    pairs = isinstance(value, dict)
    held: dict | list = {} if pairs else []
    used = 0
    for k, x in value.items() if pairs else enumerate(value):
        n = len(compact({k: x}).encode()) if pairs else sharding.compact_size(x)
        if used and used + n > limit or n > limit and used:
            yield None, held, used
            held, used = {} if pairs else [], 0
        if n > limit:
            yield (k, x, n) if pairs else (None, [x], n)
        elif pairs:
            held[k] = x
            used += n
        else:
            held.append(x)
            used += n
    if used:
        yield None, held, used


def member_chunks(nodes: DataFrame, limit: int) -> DataFrame:
    """(doc_id, chunk, n_items, bytes, alone) of the members of every root, by `chunk_members` over the whole corpus.

    A member of an object has the bytes of an object of it alone. alone: the name of a member over the limit, which is
    a chunk of its own; null for elements of lists and other chunks. Roots of any length are packed in blocks.
    """
    name = F.octet_length(F.to_json(F.array("key"))) - 2
    text = F.when(F.col("scalar_type") == "str", F.from_json(F.concat(F.lit("["), "raw", F.lit("]")), "array<string>")[0]).otherwise(F.col("raw"))
    element = F.when(F.col("kind") == "primitive", scalar_size(text, "scalar_type")).otherwise(F.col("compact_size"))
    size = F.when(F.col("key").isNotNull(), name + 3 + F.col("compact_size")).otherwise(element)
    members = nodes.where("depth = 1").select("doc_id", "node", "key", size.cast("bigint").alias("size"))
    packed = packing.chunk_table(packing.stream(members, ["doc_id"], "node", "size", limit, "plain"), ["doc_id"], "node", "size")
    big = members.where(F.col("size") > limit).select("doc_id", F.col("node").alias("first"), F.col("key").alias("alone"))
    return packed.join(big, ["doc_id", "first"], "left").select("doc_id", "chunk", "n_items", "bytes", "alone")
