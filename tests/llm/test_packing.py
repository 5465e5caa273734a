import random
from collections import defaultdict

import numpy as np

from shardloom.llm import packing


def test_pack_is_valid_and_tight():
    r = random.Random(6)
    for k in range(60):
        cap = r.choice([10, 100, 16384])
        sizes = np.array([r.choice([0, r.randint(0, cap), r.randint(cap // 3, cap), cap, cap // 2]) for _ in range(r.randint(0, 300))], np.int64)
        got = packing.pack(sizes, cap)
        fill = np.bincount(got, weights=sizes) if len(sizes) else np.zeros(0)
        assert (fill <= cap).all() and (got >= 0).all()
        # no two containers could be one unless both hold more than half: at most one is at most half full
        assert (fill * 2 <= cap).sum() <= 1 or sorted(fill)[:2][0] + sorted(fill)[:2][1] > cap
    small = np.array([r.randint(1, 1000) for _ in range(20000)], np.int64)
    assert packing.pack(small, 16384).max() + 1 <= np.ceil(small.sum() / 16384) + 1


def test_large_items_pair():
    sizes = np.array([60, 40, 55, 45, 70, 30, 34, 34], np.int64)
    got = packing.pack(sizes, 100)
    assert got[0] == got[1] and got[2] == got[3] and got[4] == got[5] and got[6] == got[7]


def test_assignment(spark):
    shards = [(1, f"s{i}", "x" * (i * 7 % 130), None, "clash") for i in range(200)] + [(2, "null", None, 40, ""), (2, "neg", None, -4, ""), (3, "noclass", "abc", 3, ""), (1, None, "abc", 3, ""), (1, "big", "é" * 120, 1, ""), (1, "big", "é" * 120, 1, "")]
    s = spark.createDataFrame(shards, "run_id bigint, shard_id string, data string, size bigint, bin_id string")
    m = spark.createDataFrame([(1, "list"), (1, "list"), (2, "mixed")], "run_id bigint, data_structure string")
    spec = spark.createDataFrame([("list", 100), ("mixed", 50), ("unused", 10)], "data_structure string, capacity_bytes bigint")
    rows = packing.assign(packing.shard_lengths(s, m), spec, block=8).collect()
    by, fill = defaultdict(list), defaultdict(int)
    for r in rows:
        by[r.run_id, r.shard_id].append(r)
        if r.bin_id is not None:
            fill[r.data_structure, r.bin_id] += r.bytes
    assert len(by) == 205
    assert all(v <= {"list": 100, "mixed": 50}[k[0]] for k, v in fill.items())
    assert sorted(r.bytes for r in by[1, "big"]) == [40, 100, 100] and len({r.piece for r in by[1, "big"]}) == 3
    assert by[3, "noclass"][0].bin_id is None and by[2, "null"][0].bytes == 40 and by[2, "neg"][0].bytes == 0
    assert {(r.run_id, r.shard_id) for r in rows if r.n_pieces > 1} == {(1, f"s{i}") for i in range(200) if i * 7 % 130 > 100} | {(1, "big")}
    assert packing.assign(packing.shard_lengths(s.limit(0), m), spec).collect() == []
    assert packing.containers(packing.assign(packing.shard_lengths(s, m), spec)).count() == 2
