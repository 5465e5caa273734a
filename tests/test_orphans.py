import os
import random
from datetime import datetime, timedelta

import pytest

from shardloom.operators import orphans as O
from shardloom.operators.orphans import OrphanState, shard_references
from shardloom.streaming import orphans as stream

REFS = "src_table string, run_id bigint, shard_id string, ref_field string, ref_id string, recorded_at timestamp_ntz"


def events(seed, n=200):
    r = random.Random(seed)
    t = lambda: datetime(2024, 1, 1) + timedelta(hours=r.randint(0, 3000))
    key = lambda: f"s{r.randint(0, 30)}"
    refs = [("shard_meta", r.randint(1, 2), key(), r.choice(["parent_id", "next_shard"]), key(), t()) for _ in range(n)]
    stored = [(r.randint(1, 2), key(), t()) for _ in range(60)]
    removed = [(r.randint(1, 2), key(), t()) for _ in range(30)]
    return refs + refs[:10], stored + stored[:5], removed


def brute(refs, stored, removed):
    out = set()
    for src, run, sid, f, ref, at in refs:
        w = [x for a, b, x in stored if (a, b) == (run, ref)]
        g = [x for a, b, x in removed if (a, b) == (run, ref)]
        s = "missing" if not w else "removed" if g and max(g) > max(w) else "late" if min(w) > at else None
        if s:
            out.add((src, run, sid, f, ref, s, at.strftime("%Y-%m")))
    return out


def frames(spark, refs, stored, removed):
    return (spark.createDataFrame(refs, REFS), spark.createDataFrame(stored, "run_id bigint, shard_id string, written_at timestamp_ntz"), spark.createDataFrame(removed, "run_id bigint, shard_id string, removed_at timestamp_ntz"))


def snapshot(refs, stored, removed):
    out = {}
    for src, run, sid, f, ref, at in set(refs):
        w = [x for a, b, x in stored if (a, b) == (run, ref)]
        g = [x for a, b, x in removed if (a, b) == (run, ref)]
        s = "missing" if not w else "removed" if g and max(g) > max(w) else "late" if min(w) > at else "held"
        key = (src, at.strftime("%Y-%m"), s)
        out[key] = out.get(key, 0) + 1
    return out


@pytest.mark.parametrize("buckets", [1, 5])
def test_batches_in_any_order_give_the_same(spark, buckets):
    refs, stored, removed = events(1)
    want = brute(refs, stored, removed)
    assert {x[5] for x in want} == {"missing", "removed", "late"}
    assert {tuple(x) for x in OrphanState.start(*frames(spark, refs, stored, removed)).orphans().collect()} == want
    a, b, c = frames(spark, refs[:50], stored[30:], removed[:10])
    state = OrphanState.new(spark, buckets=buckets).advance(a, b, c)
    first = {(x.src_table, x.period, x.state): x.n for x in state.snapshot().collect()}
    assert first == snapshot(refs[:50], stored[30:], removed[:10])
    a, b, c = frames(spark, refs[40:], stored[:40], removed[5:])
    state = state.advance(removals=c).advance(refs=a).advance(arrivals=b)
    assert {tuple(x) for x in state.orphans().collect()} == want
    assert {(x.src_table, x.period, x.state): x.n for x in state.snapshot().collect()} == snapshot(refs, stored, removed)
    assert {(x.src_table, x.period, x.state): x.n for x in state.snapshot(1).collect()} == first


def test_many_batches_are_merged(spark, monkeypatch):
    monkeypatch.setattr(O, "COMPACT", 3)
    refs, stored, removed = events(4, 120)
    a, b, c = frames(spark, refs, stored, removed)
    state, months = O.replay(a, b, c)
    assert state.batches == len(months) >= 4 and len(state.parts) < 3
    assert {tuple(x) for x in state.orphans().collect()} == brute(refs, stored, removed)
    assert {(x.src_table, x.period, x.state): x.n for x in state.snapshot().collect()} == snapshot(refs, stored, removed)
    had = sorted(map(tuple, state.orphans().collect()))
    state.vacuum()
    assert sorted(map(tuple, state.orphans().collect())) == had and len([f for f in os.listdir(state.folder.removeprefix("file:") + "/index") if f.startswith("part=")]) <= 3
    late = state.advance(removals=spark.createDataFrame([(1, "s1", datetime(2030, 1, 1))], "run_id bigint, shard_id string, removed_at timestamp_ntz"))
    assert {tuple(x) for x in late.orphans().collect()} == brute(refs, stored, [*removed, (1, "s1", datetime(2030, 1, 1))])
    again = OrphanState(spark, state.folder, state.buckets, state.batches)
    assert again.snapshot().agg({"n": "sum"}).first()[0] <= len(set(refs))


def test_work_of_a_batch_does_not_grow_with_history(spark):
    """Rows of index and held references in the buckets that one late batch reads, after much and after little history."""
    seen = {}
    for n in (40, 400):
        ids = spark.range(n).selectExpr("id as run_id", "concat('s', id) as shard_id", "timestamp_ntz'2024-01-01' as written_at")
        refs = spark.range(n).selectExpr("'shard_meta' as src_table", "id as run_id", "'x' as shard_id", "'parent_id' as ref_field", "concat('s', id) as ref_id", "timestamp_ntz'2024-01-02' as recorded_at")
        state = OrphanState.new(spark, buckets=n // 4).advance(refs, ids)
        bucket = state._read("index", O._INDEX, state.parts).where("run_id = 3").first().bucket
        seen[n] = state._read("index", O._INDEX, state.parts, [bucket]).count() + state._refs("held", state.parts, [bucket]).count()
        late = state.advance(removals=spark.createDataFrame([(3, "s3", datetime(2024, 2, 1))], "run_id bigint, shard_id string, removed_at timestamp_ntz"))
        assert [(x.run_id, x.state) for x in late.orphans().collect()] == [(3, "removed")]
        assert late.references().count() == 1  # what is pending, nothing else
    assert seen[400] <= 3 * max(seen[40], 8)


def test_null_times(spark):
    refs = spark.createDataFrame([("shard_meta", 1, "a", "parent_id", k, None) for k in ("k", "gone", "none")], REFS)
    stored = spark.createDataFrame([(1, "k", None), (1, "gone", None)], "run_id bigint, shard_id string, written_at timestamp_ntz")
    removed = spark.createDataFrame([(1, "gone", None), (None, None, None)], "run_id bigint, shard_id string, removed_at timestamp_ntz")
    state, months = O.replay(refs, stored, removed)
    assert months == ["0000-00"] and [tuple(x) for x in state.orphans().collect()] == [("shard_meta", 1, "a", "parent_id", "none", "missing", None)]


def test_references_and_empty(spark):
    meta = spark.createDataFrame([(1, "a", "p", "", None, None)], "run_id bigint, shard_id string, parent_id string, next_shard string, previous_shard string, recorded_at timestamp_ntz")
    docs = spark.createDataFrame([(1, "r", None), (1, None, None)], "run_id bigint, root_shard string, created_at timestamp_ntz")
    refs = shard_references(meta, docs)
    _, s, g = frames(spark, *events(1))
    got = {tuple(x) for x in OrphanState.start(refs, s.limit(0), g.limit(0)).orphans().collect()}
    assert got == {("shard_meta", 1, "a", "parent_id", "p", "missing", None), ("doc_meta", 1, "r", "root_shard", "r", "missing", None)}
    assert OrphanState.start(refs.limit(0), s, g).orphans().collect() == []


def test_streams(spark, tmp_path):
    refs, stored, removed = events(2, 80)
    rows = [("ref", run, ref, src, sid, f, at) for src, run, sid, f, ref, at in refs] + [("stored", r, k, None, None, None, t) for r, k, t in stored] + [("removed", r, k, None, None, None, t) for r, k, t in removed]
    random.Random(3).shuffle(rows)
    src = str(tmp_path / "in")
    for part in (rows[:60], rows[60:]):
        spark.createDataFrame(part, stream.EVENT).coalesce(1).write.mode("append").parquet(src)
    read = lambda: spark.readStream.schema(stream.EVENT).option("maxFilesPerTrigger", 1).parquet(src)
    want = {x[:6] for x in brute(refs, stored, removed)}
    q = stream.ledger(read(), str(tmp_path / "state"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    last = OrphanState(spark, str(tmp_path / "state"), 64, 2)
    assert sum(x.n for x in last.snapshot().collect()) == len(set(refs))
    assert {tuple(x)[:6] for x in last.orphans().collect()} == want
    q = stream.track(read()).writeStream.format("memory").queryName("tracked").outputMode("update").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    now = {}
    for x in spark.table("tracked").collect():
        now[x.src_table, x.run_id, x.shard_id, x.ref_field, x.ref_id] = now.get((x.src_table, x.run_id, x.shard_id, x.ref_field, x.ref_id), set()) | {x.state}
    assert {k for k, v in now.items() if v - {"held"}} >= {x[:5] for x in want}
