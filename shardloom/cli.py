"""python -m shardloom.cli unflatten FILE | flatten DIR: cut a JSON file into shard files, and join them again."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import __version__
from .metrics import get_profiler
from .operators import sharding
from .sources import corpus, sinks


def unflatten(spark: SparkSession, path: str, limit: int, out: str, mode: str = "lossless") -> int:
    """Cut the document(s) at path; gives the number of shard files. Raises ValueError for a bad limit, folder or document.

    A document is named by its place below the folder that all have in common, so files of one name in several folders stay apart.
    """
    wrong = [m for s, m in [*sinks.check_limit(limit), *sinks.check_folder(out)] if s == "error"]
    docs = corpus.from_files(spark, path)
    wrong += [f"{r.doc_id}: {r.error_type}: {r.message}" for r in corpus.canonical(docs).where("error_type is not null").limit(5).collect()]
    if wrong:
        raise ValueError("; ".join(wrong))
    ends = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    shared = os.path.commonprefix([ends.a or "", ends.b or ""]).rpartition("/")[0]
    docs = docs.withColumn("doc_id", F.substr("doc_id", F.lit(len(shared) + 2)))
    with get_profiler().operation("unflatten", docs.agg(F.sum(F.octet_length("json"))).first()[0] or 0) as m:
        shards = sharding.shard(docs, limit, mode).persist()
        written = sinks.write_files(shards, out).agg(F.count("bytes").alias("n"), F.sum("bytes").alias("b"), F.count("error").alias("bad")).first()
        sinks.write_global_metadata(sharding.document_table(shards, docs), out, datetime.now().isoformat()).count()
        sinks.write_index(shards, out).count()
        m.output_size, m.shards_created = written.b or 0, written.n
        shards.unpersist()
    if written.bad:
        raise ValueError(f"{written.bad} files could not be written")
    return written.n


def flatten(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, json) of the documents whose lossless shard files lie below folder, by the name that their folder stands for."""
    text = spark.read.text(f"{folder}/*/*.json", wholetext=True).select(F.url_decode(F.url_decode(F.element_at(F.split(F.input_file_name(), "/"), -2))).alias("doc_id"), "value")
    rows = text.select("doc_id", sinks.read_metadata(F.get_json_object("value", "$._metadata")).alias("m"), F.to_json(F.try_variant_get(F.try_parse_json("value"), "$.data", "variant")).alias("data")).select("doc_id", "m.*", "data").where("shard_id is not null")
    order = F.struct(F.length("shard_id"), "shard_id")
    parts = rows.withColumn("ord", F.dense_rank().over(Window.partitionBy("doc_id").orderBy(order)))
    return sharding.rebuild_corpus(parts)


def write_documents(documents: DataFrame, folder: str) -> int:
    """One JSON file a document below folder, written by the tasks; gives their number."""

    def run(batches):
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sinks._put(folder, f"{sinks.folder_name(name)}.json", text.encode())
            yield batch.select([0])

    return documents.mapInArrow(run, "doc_id string").count()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="shardloom", description=__doc__)
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("unflatten", help="cut a JSON file into shards")
    a.add_argument("file"), a.add_argument("--size", type=int, default=sharding.MAX_SIZE), a.add_argument("--output", default="./output"), a.add_argument("--verbose", action="store_true")
    b = sub.add_parser("flatten", help="join shards to the document")
    b.add_argument("folder"), b.add_argument("--output", help="folder for one file a document"), b.add_argument("--verbose", action="store_true")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("shardloom").getOrCreate()
    try:
        if args.command == "unflatten":
            print(f"{unflatten(spark, args.file, args.size, args.output)} shards in {args.output}")
        else:
            docs = flatten(spark, args.folder)
            if args.output:
                print(f"{write_documents(docs, args.output)} documents in {args.output}")
            else:
                for r in docs.toLocalIterator():
                    print(r.doc_id, r.json)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if args.verbose:
        print(get_profiler().export("summary"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
