"""Shard files, their names, the index, and what lies in an output folder."""

from __future__ import annotations

import json
import os
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_SCHEMA = "doc_id string, shard_id string, filename string, bytes bigint, error string"
META = ("shard_id", "parent_id", "child_ids", "data_type", "original_path", "next_shard", "previous_shard", "version")
CAMEL = {"shard_id": "shardId", "parent_id": "parentId", "child_ids": "childIds", "data_type": "dataType", "original_path": "originalPath", "next_shard": "nextShard", "previous_shard": "previousShard", "version": "version"}


def filename(shard_id: str = "shard_id", path: str = "original_path", data_type: str = "data_type") -> Column:
    """Name of a shard's file: id, the last two segments of its path and its type.

    Brackets are dropped from segments, `:` and, so that no folder can be left, `/` and `\\` become `_`; empty segments
    are dropped, null types are `unknown`.
    """
    p = F.coalesce(F.col(path), F.array().cast("array<string>"))
    last = F.when(F.size(p) > 2, F.slice(p, -2, 2)).otherwise(p)
    clean = F.filter(F.transform(last, lambda s: F.regexp_replace(F.regexp_replace(s, r"[\[\]]", ""), r"[:/\\]", "_")), lambda s: s != "")
    return F.concat(F.concat_ws("_", F.array(F.col(shard_id)), clean, F.array(F.coalesce(F.col(data_type), F.lit("unknown")))), F.lit(".json"))


def metadata_json() -> Column:
    """The metadata record of a shard row as JSON, camelCase, nulls included."""
    return F.to_json(F.struct(*(F.col(c).alias(CAMEL[c]) for c in META)), {"ignoreNullFields": "false"})


def read_metadata(text: str | Column) -> Column:
    """The inverse of `metadata_json`: a struct, missing child lists and paths empty, a missing version 1.0.0."""
    m = F.from_json(text, "shardId string, parentId string, childIds array<string>, dataType string, originalPath array<string>, nextShard string, previousShard string, version string")
    none = F.array().cast("array<string>")
    fill = {"child_ids": none, "original_path": none, "version": F.lit("1.0.0")}
    return F.struct(*((F.coalesce(m[CAMEL[c]], fill[c]) if c in fill else m[CAMEL[c]]).alias(c) for c in META))


def file_text() -> Column:
    """The compact text of a shard's file: its metadata and its data."""
    return F.concat(F.lit('{"_metadata":'), metadata_json(), F.lit(',"data":'), F.col("data"), F.lit("}"))


def folder_name(doc_id: str) -> str:
    """The folder of a document: its id with all characters but letters, digits, `-`, `_` and inner dots as %XX, so no two documents share one and none leads out."""
    name = quote(str(doc_id), safe="")
    return name.replace(".", "%2E") if not name.strip(".") else name or "%"


def read_file_text(text: str | Column) -> Column:
    """The inverse of `file_text`: a struct of the metadata, as `read_metadata` gives it, and the data as JSON text; null for what is no shard file. Data with NaN or Infinity, which are no JSON, come back null."""
    t = F.col(text) if isinstance(text, str) else text
    meta = F.from_json(t, "_metadata string")["_metadata"]
    return F.when(meta.isNotNull(), F.struct(read_metadata(meta).alias("metadata"), F.to_json(F.try_variant_get(F.try_parse_json(t), "$.data", "variant")).alias("data")))


def _put(place: str, name: str, body: bytes) -> None:
    """Write a file whole or not at all: a task that runs twice leaves one."""
    os.makedirs(place, exist_ok=True)
    part = os.path.join(place, f".{name}.{os.getpid()}")
    with open(part, "wb") as f:
        f.write(body)
    os.replace(part, os.path.join(place, name))


def _indented(text: str) -> bytes:
    return json.dumps(json.loads(text), indent=2, ensure_ascii=False).encode("utf-8", "replace")


def _write(batches, folder: str):
    for batch in batches:
        out = []
        for doc, sid, name, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            try:
                body = _indented(text)
                _put(os.path.join(folder, folder_name(doc)), name, body)
                out.append((doc, sid, name, len(body), None))
            except (OSError, ValueError, TypeError, RecursionError) as e:
                out.append((doc, sid, name, None, str(e)))
        cols = list(zip(*out)) if out else [[]] * 5
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], [c.split()[0] for c in FILE_SCHEMA.split(", ")])


def write_files(shards: DataFrame, folder: str, name: Column | None = None) -> DataFrame:
    """Write one indented file a shard, in a folder for each document; gives (doc_id, shard_id, filename, bytes, error).

    name: names of one's own, as for single shards. Written as rows are asked for, by the tasks; `folder` must be shared
    by all executors. Failures are rows, not exceptions. For large outputs prefer `write_table`.
    """
    rows = shards.select("doc_id", "shard_id", (filename() if name is None else name).alias("filename"), file_text().alias("text"))
    return rows.mapInArrow(lambda b: _write(b, folder), FILE_SCHEMA)


def global_metadata(documents: DataFrame, created_at: str | Column) -> DataFrame:
    """(doc_id, text) of the global metadata record of each row of a document table, camelCase; the time is given, so results can be repeated."""
    at = F.lit(created_at) if isinstance(created_at, str) else created_at
    record = F.struct(F.col("version"), F.col("original_size").alias("originalSize"), F.col("shard_count").alias("shardCount"), F.col("root_shard").alias("rootShard"), at.alias("createdAt"), F.col("data_structure").alias("dataStructure"))
    return documents.select("doc_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("text"))


def write_global_metadata(documents: DataFrame, folder: str, created_at: str) -> DataFrame:
    """Write `_global_metadata.json` in the folder of each document; gives rows as `write_files`, with null shard_id."""
    rows = global_metadata(documents, created_at).select("doc_id", F.lit(None).cast("string").alias("shard_id"), F.lit("_global_metadata.json").alias("filename"), "text")
    return rows.mapInArrow(lambda b: _write(b, folder), FILE_SCHEMA)


def write_table(shards: DataFrame, folder: str) -> None:
    """Write all shards as a table of JSON lines, a few large files."""
    shards.write.mode("overwrite").json(folder)


def index(shards: DataFrame) -> DataFrame:
    """(doc_id, ord, shard_id, filename, type, size, parent_id, child_ids, next_shard, previous_shard): the entries of the indexes, one row each; sizes are estimates."""
    return shards.select("doc_id", "ord", "shard_id", filename().alias("filename"), F.col("data_type").alias("type"), "size", "parent_id", "child_ids", "next_shard", "previous_shard")


def index_totals(shards: DataFrame) -> DataFrame:
    """(doc_id, version, total_shards, total_size) of each document's index."""
    return shards.groupBy("doc_id").agg(F.lit("1.0.0").alias("version"), F.count("*").alias("total_shards"), F.sum("size").alias("total_size"))


def _write_index(batches, folder: str):
    """Entries come sorted by document and order; a file is written as they pass, so a document may have any number."""
    state: dict = {"doc": None, "file": None, "n": 0}

    def close():
        if state["file"] is not None:
            state["file"].write("\n]}\n")
            state["file"].close()
            os.replace(state["part"], state["place"])
            done.append((state["doc"], state["n"]))
            state["file"] = None

    for batch in batches:
        done: list = []
        for doc, total, size, entry in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if state["file"] is None or doc != state["doc"]:
                close()
                where = os.path.join(folder, folder_name(doc))
                os.makedirs(where, exist_ok=True)
                state |= {"doc": doc, "n": 0, "place": os.path.join(where, "_index.json"), "part": os.path.join(where, f"._index.json.{os.getpid()}")}
                state["file"] = open(state["part"], "w", encoding="utf-8")
                state["file"].write(f'{{"version": "1.0.0", "total_shards": {total}, "total_size": {size}, "shards": [')
            state["file"].write((",\n" if state["n"] else "\n") + entry)
            state["n"] += 1
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["doc_id", "entries"])
    done = []
    close()
    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["doc_id", "entries"])


def write_index(shards: DataFrame, folder: str) -> DataFrame:
    """Write `_index.json` in the folder of each document, entries in order, as rows are asked for; gives (doc_id, entries)."""
    entry = F.to_json(F.struct(*(c for c in index(shards).columns if c not in ("doc_id", "ord"))), {"ignoreNullFields": "false"})
    rows = index(shards).join(index_totals(shards).drop("version"), "doc_id").select("doc_id", "total_shards", "total_size", entry.alias("entry"), "ord")
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "ord").drop("ord").mapInArrow(lambda b: _write_index(b, folder), "doc_id string, entries bigint")


def file_statistics(files: DataFrame) -> DataFrame:
    """(kind, files, bytes, average, mb) of files (path, length) by the class their names tell: metadata, dict, list, primitive or other."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(name.startswith("_"), "metadata")
    for k in ("dict", "list", "primitive"):
        kind = kind.when(name.endswith(f"_{k}.json"), k)
    return files.groupBy(kind.otherwise("other").alias("kind")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.avg("length").alias("average"), F.round(F.sum("length") / 1048576, 6).alias("mb"))


def output_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """`file_statistics` of the files below a folder."""
    return file_statistics(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length"))


def check_folder(folder: str) -> list[tuple[str, str]]:
    """(severity, message) of what is wrong with an output folder on this machine."""
    if not folder or "\x00" in folder:
        return [("error", "no folder")]
    if ".." in folder.replace("\\", "/").split("/"):
        return [("error", "leads out of its parent")]
    if os.path.exists(folder):
        if not os.path.isdir(folder):
            return [("error", "not a folder")]
        if not os.access(folder, os.W_OK | os.R_OK):
            return [("error", "not readable and writable")]
        return [("warning", "not empty")] if os.listdir(folder) else []
    parent = os.path.dirname(os.path.abspath(folder))
    while not os.path.exists(parent):
        parent = os.path.dirname(parent)
    return [] if os.access(parent, os.W_OK) else [("error", "parent not writable")]


def check_limit(limit: int) -> list[tuple[str, str]]:
    """(severity, message) of a size limit in bytes."""
    if limit <= 0:
        return [("error", "must be positive")]
    return [("warning", "very small")] if limit < 1024 else [("warning", "very large")] if limit > 100 << 20 else []


def clean_folder(folder: str, suffix: str = ".json") -> int:
    """Delete the files of a folder with a suffix, not those below it; gives their number."""
    found = [os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(suffix) and os.path.isfile(os.path.join(folder, f))]
    for f in found:
        os.remove(f)
    return len(found)
