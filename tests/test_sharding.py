import json
import random

from shardloom.functions.jsonnodes import compact
from shardloom.operators import sharding as S
from shardloom.sources import corpus

from .test_nested import tree

#: An orchard: objects in objects, with scalars of all kinds.
ORCHARD = {"rows": {"north": {"trees": 41, "grafted": True, "soil": {"ph": 6.5, "drained": None}}, "south": {"trees": 17, "soil": {"ph": 7, "drained": False}}}, "press": {"litres": 900}}


def walk(v, path=()):
    """(path, parent's path) of every object in objects, in pre-order."""
    out = [(list(path), list(path[:-1]) if path else None)]
    for k, x in v.items():
        if isinstance(x, dict):
            out += walk(x, (*path, k))
    return out


def test_objects():
    out = S.Cutter(25000, False).cut(ORCHARD)
    want = walk(ORCHARD)
    ids = {tuple(p): f"shard_{i:03d}" for i, (p, _) in enumerate(want, 1)}
    assert [(s.shard_id, s.path) for s in out] == [(ids[tuple(p)], p) for p, _ in want] and len(out) == 7
    assert [s.parent_id for s in out] == [None if up is None else ids[tuple(up)] for _, up in want]
    assert all(s.child_ids == [x.shard_id for x in out if x.parent_id == s.shard_id] for s in out)
    assert S.file_size({}) == 312 and S.file_size({"k": "v"}) == 329 and S.file_size([1, 2, 3]) == 337


def test_mixed():
    doc = {"vessel": "Auk", "hull": {"beam": 4.2, "keel": {"lead": True}}, "log": [[1, "calm"], [2, "gale"]], "crew": []}
    out = S.Cutter(25000, False).cut(doc)
    # the root, then the objects with what lies in them, then the lists; places are those within the value
    assert [(s.path, s.parent_id, s.data_type) for s in out] == [([], None, "dict"), ([], "shard_001", "dict"), (["keel"], "shard_002", "dict"), (["[0:2]"], "shard_001", "list"), (["[]"], "shard_001", "list")]
    assert out[0].child_ids == ["shard_002", "shard_004", "shard_005"] and {k: v.get("_processor") for k, v in out[0].data.items() if k != "vessel"} == {"hull": "dict_processor", "log": "list_processor", "crew": "list_processor"}
    assert [s.path for s in S.Cutter(25000).cut(doc)] == [[], ["hull"], ["hull", "keel"], ["log", "[0:2]"], ["crew", "[]"]]


def test_deep_documents(spark):
    deep = "{" + '"a":{' * 3000 + "}" * 3001
    lists = "[" * 700 + "]" * 700
    got = S.shard(corpus.from_strings(spark, {"deep": deep, "lists": lists, "flat": '{"a":1}'}), 25000).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in got} >= {"flat", "lists"}
    r = random.Random(4)
    for _ in range(100):
        v = tree(r, 5)
        assert S.sorted_keys(v) == v and compact(S.sorted_keys(v)) == compact(v, True)


def test_redistribute(spark):
    r = random.Random(6)
    docs = {f"d{k}": compact({f"k{i}": r.choice([i, "x" * r.randint(1, 900), {"a": [1] * r.randint(0, 400)}, [r.randint(0, 9)] * r.randint(0, 500)]) for i in range(25)}) for k in range(6)}
    s = S.shard(corpus.from_strings(spark, docs), 1 << 20, "reference").where("doc_id <> 'none'")
    got = S.redistribute(s, 1500).collect()
    old = {(x.doc_id, x.shard_id): x for x in s.collect()}
    new = {(x.doc_id, x.shard_id): x for x in got}
    assert len(new) == len(got)
    want = []
    for x in sorted(old.values(), key=lambda x: (x.doc_id, x.ord)):
        if x.size <= 1500:
            want.append((x.doc_id, x.data, x.original_path, x.parent_id))
        else:
            want += [(x.doc_id, compact(p), x.original_path, x.parent_id) for p, _ in S.Cutter(1500, False).chunks(json.loads(x.data), x.original_path)]
    assert [(x.doc_id, x.data, x.original_path, x.parent_id) for x in sorted(got, key=lambda x: (x.doc_id, x.ord))] == want and len(want) > len(old)
    for x in got:
        if x.next_shard and (x.doc_id, x.shard_id) not in old:
            assert new[x.doc_id, x.next_shard].previous_shard == x.shard_id
    assert S.redistribute(s.limit(0), 1500).collect() == [] and S.redistribute(s, 1 << 20).count() == len(old)


def test_limits():
    assert not S.opens_new(0, 72069, 92160) and S.opens_new(1, 72069, 92160) and S.opens_new(0, 84789, 92160)
    assert S.compact_size(True) == 5 and S.compact_size(False) == 4 and S.compact_size('a"\\') == 7


def test_sizes_are_formatted_sizes():
    r = random.Random(2)
    for _ in range(200):
        v = tree(r, 4)
        b = 228 + len(json.dumps({"d": v}, indent=2, ensure_ascii=False).encode()) - len('{\n  "d": \n}')
        assert S.file_size(v) == b + b * 8 // 100 + 64


def test_rebuild():
    r = random.Random(9)
    for k in range(400):
        v = tree(r, 6)
        if isinstance(v, (dict, list)):
            for limit in (330, 400, 900, 25000):
                out = S.Cutter(limit, True).cut(v)
                assert len({s.shard_id for s in out}) == len(out)
                assert compact(S.rebuild((s.shard_id, s.path, s.data) for s in out), True) == compact(v, True), (v, limit)


def test_operator(spark):
    c = corpus.from_strings(spark, {"a": compact(ORCHARD), "b": "[1,2", "c": "[]", "d": "{}", "e": json.dumps([{"x": i, "y": ["z"] * (i % 7)} for i in range(60)])})
    got = S.shard(c, 600)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {"a", "c", "d", "e"}
    back = {r.doc_id: r.json for r in S.rebuild_corpus(got).collect()}
    assert back["a"] == compact(ORCHARD, True) and back["c"] == "[]" and back["d"] == "{}"
    assert {r.doc_id: r.shard_count for r in S.document_table(got, c).collect()}["d"] == 1
    assert S.shard(c.limit(0)).collect() == []


def test_overflow_and_oversized_scalars():
    wide = {f"key{i:02d}": "v" * 40 for i in range(12)}
    out = S.Cutter(900, False).cut({"a": wide, "b": {}})
    assert [s.shard_id for s in out][:3] == ["shard_001", "shard_002", "shard_002_overflow_1"] and all(s.parent_id == "shard_002" and s.data_type == "dict" for s in out if "overflow" in s.shard_id)
    assert out[1].child_ids == [s.shard_id for s in out if "overflow" in s.shard_id]
    merged = {}
    for s in out[1:]:
        if s.shard_id.startswith("shard_002"):
            merged |= s.data
    assert merged == wide
    only = S.Cutter(1000, False).cut_list([[1], "z" * 3000, [2]])
    assert [(s.data_type, s.path) for s in only] == [("list", ["[0:1]"]), ("primitive", ["[1]"]), ("list", ["[2:3]"])] and only[1].data["_original_index"] == 1 and set(only[1].data) == {"_warning", "_original_index", "_item"}
    assert [(s.previous_shard, s.next_shard) for s in only] == [(None, only[1].shard_id), (only[0].shard_id, only[2].shard_id), (only[1].shard_id, None)]
