"""Session-level helpers: tables, shared storage, bounded streaming over partitions."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session. Where it is unset, one of this machine on a local master, as in tests; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = spark.conf.get("spark.checkpoint.dir", None)
        if place is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="shardloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint: later jobs read it from shared storage, also after the loss of an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def blank_to_null(c: str | Column) -> Column:
    """Null for the empty string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != "", c)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 400_000, size: int = 64 << 20) -> Iterator[pa.Table]:
    """Regroup the batches of a partition sorted by `keys` into tables that hold whole groups only.

    A table ends at the first group boundary after `rows` rows or `size` bytes, so that a partition of any length
    is worked off in bounded memory as long as single groups are bounded (callers salt those that are not).
    """
    held: list[pa.RecordBatch] = []
    n = b = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n, b = n + batch.num_rows, b + batch.nbytes
        if n < rows and b < size:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        same = None
        for k in keys:
            c = t.column(k)
            e = pc.fill_null(pc.equal(c, c[len(c) - 1]), c[len(c) - 1].as_py() is None) if c[len(c) - 1].as_py() is not None else pc.is_null(c)
            same = e if same is None else pc.and_(same, e)
        last = pc.sum(pc.cast(same, pa.int64())).as_py()
        if last < t.num_rows:
            yield t.slice(0, t.num_rows - last)
            held = t.slice(t.num_rows - last).combine_chunks().to_batches()
            n, b = last, sum(x.nbytes for x in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def map_groups(df: DataFrame, keys: list[str], f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Apply `f` to tables of whole groups (see whole_groups): one shuffle by `keys`, one sort within partitions."""

    def run(batches):
        for t in whole_groups(batches, keys):
            yield from f(t).to_batches(max_chunksize=20_000)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
