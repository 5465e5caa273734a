"""Corpora of JSON documents: (doc_id STRING, json STRING), one row a document."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonnodes import SCHEMA, compact, node_table, strict_parse
from ..operators.nested import pieces


def from_strings(spark: SparkSession, documents: dict[str, str]) -> DataFrame:
    """A corpus of texts in memory, by id."""
    return spark.createDataFrame(list(documents.items()), "doc_id string, json string")


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """A corpus of files, one document each, named by their place."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("json"))


def from_shards(shards: DataFrame) -> DataFrame:
    """The texts of file_shard as documents of their own, by `run_id/shard_id`; of several deliveries the first written, of those the one of the least hash; null texts come last."""
    first = ([F.col("written_at")] if "written_at" in shards.columns else []) + [F.xxhash64("data")]
    rows = shards.select(F.concat_ws("/", F.col("run_id").cast("string"), "shard_id").alias("doc_id"), F.col("data").alias("json"), F.struct(F.col("data").isNull(), *first).alias("first_"))
    return rows.groupBy("doc_id").agg(F.min_by("json", "first_").alias("json"))


def from_events(events: DataFrame) -> DataFrame:
    """The properties of events as documents, by event_id."""
    return events.select(F.col("event_id").cast("string").alias("doc_id"), F.col("props").alias("json"))


def from_orders(orders: DataFrame, lines: DataFrame, customers: DataFrame) -> DataFrame:
    """One mixed document for each customer: scalars, a map of the nation and a list of orders with their lines."""
    line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("bigint").alias("quantity"))
    items = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    order = F.struct(F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status"), F.coalesce("lines", F.array().cast("array<struct<line:int,part:bigint,quantity:bigint>>")).alias("lines"))
    per = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.sort_array(F.collect_list(order)).alias("orders"))
    doc = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.struct(F.col("c_nationkey").alias("nation")).alias("place"), F.col("orders")))
    return customers.join(per, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_custkey").cast("string").alias("doc_id"), doc.alias("json"))


def _canonical(batches, sort: bool):
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("json").to_pylist()):
            v, kind, message = strict_parse(text)
            rows.append((doc, None if kind else compact(v, sort), kind, message))
        cols = list(zip(*rows)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in cols], ["doc_id", "json", "error_type", "message"])


def canonical(corpus: DataFrame, sort: bool = False) -> DataFrame:
    """(doc_id, json, error_type, message): documents parsed once and written compactly, keys sorted by code point if asked for.

    Invalid documents keep their row with a null text and the error: blank or malformed text SYNTAX, a scalar as root
    STRUCTURE. Of repeated names in an object the last holds.
    """
    return corpus.select("doc_id", "json").mapInArrow(lambda b: _canonical(b, sort), "doc_id string, json string, error_type string, message string")


def nodes(corpus: DataFrame, sort: bool = False, raw: bool = False) -> DataFrame:
    """The node table of a corpus (see functions.jsonnodes): one row for each value of each valid document."""

    def run(batches):
        for batch in _canonical(batches, sort):
            keep = batch.filter(pa.compute.is_valid(batch.column("json")))
            for part, text in pieces(keep, "json"):
                yield from node_table(part.column("doc_id"), text, raw).to_batches(max_chunksize=20_000)

    return corpus.select("doc_id", "json").mapInArrow(run, SCHEMA)
