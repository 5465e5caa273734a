"""Queries p3 and p5 to p8 of TESTDATA.md, with the SQL they are compared to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..cluster import table
from . import garbled, mixture, packing, splitting, tokens


def _pieces(spark: SparkSession, d: str, place: bool) -> DataFrame:
    meta = table(spark, d, "shard_meta") if place else None
    return splitting.split_shards(table(spark, d, "file_shard"), table(spark, d, "doc_meta"), table(spark, d, "split_limit"), meta)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, False).where("piece = 1 and n_pieces > 1").select("run_id", "shard_id")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d, True).withColumn("original_path", F.to_json("original_path"))


def p3_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Each oversized shard put together from its pieces again, as a digest, with its longest piece and whether all overlaps are within six bytes of what is asked for."""
    lim = table(spark, d, "split_limit").select("data_structure", "overlap_bytes")
    p = _pieces(spark, d, False).join(lim, "data_structure", "left")
    own = F.expr("substring(encode(text, 'UTF-8'), int(shared_bytes) + 1)")
    near = (F.col("piece") == 1) | (F.abs(F.col("shared_bytes") - F.col("overlap_bytes")) <= 6)
    parts = p.groupBy("run_id", "shard_id").agg(F.array_sort(F.collect_list(F.struct("piece", F.hex(own).alias("x")))).alias("parts"), F.bool_and(F.octet_length("text") <= F.col("max_bytes")).alias("within"), F.bool_and(near).alias("overlapping"))
    return parts.select("run_id", "shard_id", F.md5(F.unhex(F.array_join(F.col("parts.x"), ""))).alias("digest"), "within", "overlapping")


def _assignment(spark: SparkSession, d: str) -> DataFrame:
    items = packing.shard_lengths(table(spark, d, "file_shard"), table(spark, d, "doc_meta"))
    return packing.assign(items, table(spark, d, "bin_spec"))


def p5_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _assignment(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _assignment(spark, d).where("piece = 1 and n_pieces > 1").select("run_id", "shard_id")


def p5_tightness(spark: SparkSession, d: str) -> DataFrame:
    """By data_structure the containers that are needed at least, and whether at most one in a hundred and two more were used and none is overfull."""
    a = _assignment(spark, d)
    over = a.groupBy("data_structure", "bin_id").agg(F.sum("bytes").alias("b"), F.max("capacity_bytes").alias("c")).where("b > c").groupBy("data_structure").agg(F.count("*").alias("overfull"))
    c = packing.containers(a).join(over, "data_structure", "left")
    return c.select("data_structure", "items", "bytes", "least_containers", (F.col("containers") <= F.col("least_containers") * 1.01 + 2).alias("tight"), F.coalesce("overfull", F.lit(0)).alias("overfull"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p6_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each document, and whether their stitches leave no more pieces and more than half as many."""
    c = tokens.chunk_report(table(spark, d, "documents"))
    return c.select("doc_id", "chunks", ((F.col("pieces") <= F.col("chunks")) & (F.col("pieces") * 2 >= F.col("chunks"))).alias("stitched"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts as they come back from their ids; null texts come back empty."""
    return tokens.decode(tokens.encode(table(spark, d, "documents")))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_target"))[0]


def p7_reached(spark: SparkSession, d: str) -> DataFrame:
    """By source its documents, whether its tokens are within two of the longest documents of its target share among the sources that have any (as at most two are rounded), and whether no document is used too often."""
    docs, goal = table(spark, d, "documents"), table(spark, d, "mix_target")
    mixed, sizes = mixture.mixture(docs, goal)
    most = mixed.groupBy("source").agg(F.max("copies").alias("most"), F.max("tokens").alias("longest"))
    rows = mixture.shares(mixed, sizes).join(most, "source", "left")
    all_ = Window.partitionBy()  # over the sources of the target
    there, whole, longest = F.sum(F.when(F.col("available") > 0, F.col("target_share"))).over(all_), F.sum("tokens").over(all_), F.max("longest").over(all_)
    aim = F.when(F.col("available") > 0, F.col("target_share") / there).otherwise(0.0)
    return rows.select("source", "target_share", "max_repeats", "documents", "most", (F.abs(F.col("tokens") - aim * whole) <= 2 * longest).alias("near")).select("source", "target_share", "max_repeats", "documents", "near", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.restore(table(spark, d, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.restore(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_pieces, p3_rebuilt, p5_found, p5_assignment, p5_tightness, p6_ids, p6_chunks, p6_decoded, p7_mixture, p7_reached, p8_found, p8_restored)}

_KIND = "(select run_id, min(data_structure) as data_structure from doc_meta group by 1)"

SQL = {
    "p3_found": f"select distinct run_id, shard_id from file_shard join {_KIND} using (run_id) join split_limit using (data_structure) where octet_length(encode(data)) > max_bytes",
    "p5_found": f"""select distinct run_id, shard_id from file_shard join {_KIND} using (run_id) join bin_spec using (data_structure)
where coalesce(octet_length(encode(data)), case when size > 0 then size end, 0) > capacity_bytes""",
    "p3_rebuilt": f"select distinct run_id, shard_id, md5(data) as digest, true as within, true as overlapping from file_shard join {_KIND} using (run_id) join split_limit using (data_structure) where octet_length(encode(data)) > max_bytes",
    "p5_tightness": f"""with one as (select run_id, shard_id, max(coalesce(octet_length(encode(data)), case when size > 0 then size end, 0)) as bytes from file_shard group by all)
select data_structure, sum(greatest(1, ceil(bytes / capacity_bytes)))::bigint as items, sum(bytes)::bigint as bytes, ceil(sum(bytes) / max(capacity_bytes))::bigint as least_containers, true as tight, 0::bigint as overfull
from one join {_KIND} using (run_id) join bin_spec using (data_structure) group by all""",
    "p6_chunks": "select doc_id, ceil(coalesce(length(text), 0) / 1024)::bigint as chunks, true as stitched from documents",
    "p7_reached": "select m.source, target_share, max_repeats, count(doc_id) as documents, true as near, true as within_repeats from (select distinct * from mix_target) m left join documents d on d.source = m.source group by all",
    "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
