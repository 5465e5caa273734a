"""Pending-orphan state over streams of references, arrivals and removals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.orphans import OrphanState

#: Events of all kinds in one stream: kind is ref, stored or removed; at is the event's time.
EVENT = "kind string, run_id bigint, ref_id string, src_table string, shard_id string, ref_field string, at timestamp"
OUT = "run_id bigint, ref_id string, src_table string, shard_id string, ref_field string, state string"
_STATE = "stored boolean, first timestamp, last timestamp, gone timestamp, src array<string>, shard array<string>, field array<string>, at array<timestamp>, said array<string>"


def _step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    stored, first, last, gone, *lists = state.get if state.exists else (False, None, None, None, [], [], [], [], [])
    known = {tuple(x[:4]): x[4] for x in zip(*lists)}  # reference and time to the state last told
    least = lambda a, b: b if a is None else a if b is None else min(a, b)
    most = lambda a, b: b if a is None else a if b is None else max(a, b)
    for f in frames:
        for kind, t, a, b, c in zip(f["kind"], f["at"], f["src_table"], f["shard_id"], f["ref_field"]):
            t = None if pd.isna(t) else t
            if kind == "stored":
                stored, first, last = True, least(first, t), most(last, t)
            elif kind == "removed":
                gone = most(gone, t)
            else:
                known.setdefault((a, b, c, t), "")
    out = []
    for (a, b, c, t), said in known.items():
        now = "missing" if not stored else "removed" if gone is not None and last is not None and gone > last else "late" if first is not None and t is not None and first > t else "held"
        if now != said:
            known[a, b, c, t] = now
            out.append((*key, a, b, c, now))
    cols = list(zip(*known)) if known else [[]] * 4
    state.update((stored, first, last, gone, *(list(x) for x in cols), list(known.values())))
    yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])


def track(events: DataFrame) -> DataFrame:
    """Changes of state of each reference, from a stream of EVENT rows. Null times compare as unknown, as in OrphanState.

    State is kept by referenced key in the state store, its references in one value. For keys that a large share of all
    references name, use `ledger`, whose state is a table and whose joins split hot keys.
    """
    return events.groupBy("run_id", "ref_id").applyInPandasWithState(_step, OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def ledger(events: DataFrame, out: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Fold each micro-batch of EVENT rows into an OrphanState kept under `out`, with a snapshot of counts for each batch.

    Micro-batch n is batch n + 1 of the state, so one that is repeated after a failure is written over. The state is
    `OrphanState(spark, out, buckets, n + 1)`.
    """

    def fold(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        refs = batch.where("kind = 'ref'").select("src_table", "run_id", "shard_id", "ref_field", "ref_id", F.col("at").alias("recorded_at"))
        stored = batch.where("kind = 'stored'").select("run_id", F.col("ref_id").alias("shard_id"), F.col("at").alias("written_at"))
        removed = batch.where("kind = 'removed'").select("run_id", F.col("ref_id").alias("shard_id"), F.col("at").alias("removed_at"))
        before = OrphanState(batch.sparkSession, out, buckets, epoch)
        before.vacuum()  # what this state doesn't need, a repetition of the batch doesn't either
        state = before.advance(refs, stored, removed)
        state.snapshot().withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/snapshots/epoch={epoch}")
        batch.unpersist()

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
