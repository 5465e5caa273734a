from datetime import datetime

from shardloom.operators import links as L

SCHEMA = "run_id bigint, doc_key string, shard_id string, parent_id string, child_ids array<string>, data_type string, original_path array<string>, next_shard string, previous_shard string, version string, recorded_at timestamp_ntz, ingested_at timestamp_ntz, note string"


def row(run, sid, par=None, kids=(), kind="dict", path=(), nxt=None, prev=None, at=1):
    t = datetime(2024, 1, at)
    return (run, "d", sid, par, None if kids is None else list(kids), kind, None if path is None else list(path), nxt, prev, "1", t, t, "clash")


ROWS = [
    row(1, "shard_001", kids=["shard_002", "shard_003", "gone"]),
    row(1, "shard_002", "shard_001", kind="list", path=["a"], nxt="shard_003"),
    row(1, "shard_003", "shard_001", kind="list", path=["b", "[0:2]"], prev="shard_002", nxt="lost"),
    row(1, "shard_004", "nobody", kids=None, kind="odd", path=None, nxt="", prev=""),
    row(2, "x", "x", kids=["x", "x", "", None]),
    row(2, "x", "x", kids=["x", "x", "", None], at=2),
    row(3, "shard_001", "shard_002", kids=["shard_002"]),
    row(3, "shard_002", "shard_001", kids=["shard_001"]),
]


def test_records_and_issues(spark):
    rec = L.records(spark.createDataFrame(ROWS, SCHEMA))
    assert rec.count() == 7
    bad = {(r.run_id, r.shard_id, r.issue) for r in L.record_issues(rec).collect()}
    assert {x for x in bad if x[0] == 1} == {(1, "shard_004", "bad_data_type"), (1, "shard_004", "null_path")}
    assert {x[2] for x in bad if x[0] == 2} == {"no_prefix", "own_parent", "own_child", "repeated_child", "blank_child"}
    got = {(r.run_id, r.shard_id, r.issue, r.other) for r in L.link_issues(rec).collect()}
    assert (1, "shard_001", "missing_child", "gone") in got and (1, "shard_003", "missing_next", "lost") in got and (1, "shard_004", "missing_parent", "nobody") in got
    assert (3, None, "no_root", None) in got and not any(r[2] == "next_previous_mismatch" for r in got)
    strict = {(r.run_id, r.shard_id, r.issue) for r in L.link_issues(rec, True).collect()}
    assert not any(i == "not_listed" for _, _, i in strict)


def test_repair_and_graph(spark):
    rec = L.records(spark.createDataFrame(ROWS, SCHEMA))
    fixed = {(r.run_id, r.shard_id): r for r in L.repair(rec).collect()}
    assert fixed[1, "shard_001"].child_ids == ["shard_002", "shard_003"] and fixed[1, "shard_003"].next_shard is None and fixed[1, "shard_004"].parent_id is None
    assert {(r.run_id, r.head_id, r.members) for r in L.cycles(rec).collect()} == {(2, "x", 1), (3, "shard_001", 2)}
    assert {r.run_id: r.valid for r in L.integrity(rec).collect()} == {1: False, 2: False, 3: False}
    chain = {(r.run_id, r.shard_id): (r.last_id, r.ending, r.position, r.length) for r in L.chains(rec).collect()}
    assert chain[1, "shard_002"] == ("shard_003", "unknown", 1, 3) and chain[1, "shard_001"] == ("shard_001", "end", 0, 1)  # the unknown id belongs to the chain
    assert L.order_valid(rec).collect()[0].valid is False
    assert {(r.shard_id, r.previous_shard, r.next_shard) for r in L.relink(rec).collect()} == {("shard_002", None, "shard_003"), ("shard_003", "shard_002", None)}
    kids = [(r.position, r.child_id) for r in L.children(rec).where("run_id = 1").orderBy("position").collect()]
    assert kids == [(0, "shard_002"), (1, "shard_003")]
    more = L.establish(rec, spark.createDataFrame([(1, "shard_002", "shard_004")], "run_id bigint, parent_id string, child_id string"))
    by = {(r.run_id, r.shard_id): r for r in more.collect()}
    assert by[1, "shard_004"].parent_id == "shard_002" and by[1, "shard_002"].child_ids == ["shard_004"]
    up = L.update(rec, spark.createDataFrame([(1, "shard_004", "dict"), (8, "nobody", "list")], "run_id bigint, shard_id string, data_type string"))
    assert {(r.run_id, r.shard_id): r.data_type for r in up.collect()}[1, "shard_004"] == "dict"


def test_chains(spark):
    nxt = {"a": "b", "b": "c", "c": None, "x": "b", "l": "gone", "r1": "r2", "r2": "r3", "r3": "r2", "self": "self"}
    rec = L.records(spark.createDataFrame([row(1, k, nxt=v) for k, v in nxt.items()], SCHEMA))
    got = {r.shard_id: (r.last_id, r.ending, r.position, r.length) for r in L.chains(rec).collect()}
    assert got == {"a": ("c", "end", 2, 3), "b": ("c", "end", 1, 2), "c": ("c", "end", 0, 1), "x": ("c", "end", 2, 3), "l": ("l", "unknown", 0, 2), "r1": ("r2", "ring", 1, 3), "r2": ("r2", "ring", 0, 2), "r3": ("r2", "ring", 0, 2), "self": ("self", "ring", 0, 1)}
    lists = {}
    for r in L.chain_members(rec).orderBy("position").collect():
        lists.setdefault(r.start_id, []).append(r.shard_id)
    assert lists == {"a": ["a", "b", "c"], "x": ["x", "b", "c"], "l": ["l"]}
    one = L.chain_members(rec, spark.createDataFrame([(1, "b")], "run_id bigint, shard_id string"))
    assert [(r.start_id, r.shard_id) for r in one.orderBy("position").collect()] == [("b", "b"), ("b", "c")]


def test_detach(spark):
    rec = L.records(spark.createDataFrame(ROWS, SCHEMA))
    got = {(r.run_id, r.shard_id): r for r in L.detach(rec, spark.createDataFrame([(1, "shard_001", "shard_002"), (1, "shard_001", "gone"), (1, "nobody", "shard_003")], "run_id bigint, parent_id string, child_id string")).collect()}
    assert len(got) == 7 and got[1, "shard_001"].child_ids == ["shard_003"] and got[1, "shard_002"].parent_id is None and got[1, "shard_003"].parent_id == "shard_001"


def test_neighbours_over_blocks(spark):
    rows = [row(1, f"shard_{i:03d}", kind="list") for i in range(1, 30)] + [row(1, "odd", kind="list")]
    rec = L.records(spark.createDataFrame(rows, SCHEMA))
    a = {(r.shard_id, r.before, r.after) for r in L.neighbours(rec, 7).collect()}
    assert a == {(r.shard_id, r.before, r.after) for r in L.neighbours(rec).collect()}
    assert ("shard_007", "shard_006", "shard_008") in a and ("odd", "shard_029", None) in a


def test_recover(spark):
    rec = L.records(spark.createDataFrame(ROWS, SCHEMA))
    shards = spark.createDataFrame([(1, "shard_001", "{}"), (1, "shard_002", "{}"), (1, "shard_003", "[1]"), (1, "shard_004", "x")], "run_id bigint, shard_id string, data string")
    got = {(r.run_id, r.shard_id): (r.state, r.data) for r in L.recover(rec, shards).collect()}
    assert got[1, "shard_001"] == ("kept", "{}") and got[1, "shard_003"] == ("kept", "[1]") and got[1, "shard_004"][0] == "lost" and got[3, "shard_001"][0] == "missing"
    assert got[1, "shard_002"] == ("rebuilt", '[{"_recovered":true,"_original_id":"shard_002"}]')


def test_empty(spark):
    rec = L.records(spark.createDataFrame([], SCHEMA))
    for f in (L.record_issues, L.link_issues, L.repair, L.cycles, L.integrity, L.summary, L.chains, L.chain_members, L.predicates, L.edges, L.order_valid, L.suggestions, L.hierarchy_valid):
        assert f(rec).collect() == []
