import random
from bisect import bisect_right

import numpy as np
import pytest

from shardloom.functions import sizes as Z
from shardloom.operators import packing as P


def brute(items, limit, policy):
    usable, fill = Z.room(limit)
    out, used, chunk = [], 0, 0
    for k, s in enumerate(items):
        t = used + s
        new = ((t > fill and used > 0) or t > usable) if policy == "fill" else used > 0 and t > (limit * 0.9 if policy == "tight" else limit)
        if k and new:
            chunk, used = chunk + 1, s
        else:
            used = t
        out.append(chunk)
    return out


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 17])
def test_policies(spark, block):
    r = random.Random(3)
    groups = {g: [r.choice([0, 0, r.randint(1, 400), 860, 1200]) if g != "c" else r.choice([0, 2000]) for _ in range(60)] for g in ("a", "b", "c", None)}
    df = spark.createDataFrame([(g, i, s, "c") for g, v in groups.items() for i, s in enumerate(v)], "g string, i bigint, s bigint, chunk_ string")
    for policy in ("fill", "tight", "plain"):
        want = {(g, i): c for g, v in groups.items() for i, c in enumerate(brute(v, 1000, policy))}
        for f in (lambda *a: P.stream(*a, block=block), *([P.fold] if block == 7 else [])):
            got = {(x.g, x.i): x.chunk for x in f(df, ["g"], "i", "s", 1000, policy).collect()}
            assert got == want, (policy, f)


def test_block_tables():
    r = random.Random(8)
    for _ in range(400):
        cap = r.choice([1, 10, 90])
        zero = r.choice([None, cap + r.randint(0, 8)])
        sizes = [r.choice([0, r.randint(1, cap), r.randint(1, 2 * cap + 12)]) for _ in range(r.randint(1, 25))]
        x = P._Block(np.array(sizes, np.int64), cap, zero)
        t = x.table()
        for used in [-1, 0, *range(1, cap + 15)]:
            now, n = (sizes[0], 0) if used < 0 else (used, 0)
            for s in sizes[1:] if used < 0 else sizes:
                new = now + s > cap if now > 0 else zero is not None and s > zero
                now, n = (s, n + 1) if new else (now + s, n)
            if used < 0:
                got = t["first_exit"], t["first_count"]
            elif used == 0:
                got = t["zero_exit"], t["zero_count"]
            else:
                i = bisect_right(t["lo"], used) - 1
                got = (used + t["total"] if t["exit"][i] < 0 else t["exit"][i]), t["count"][i]
            assert got == (now, n) and x.chunks(used)[-1] == n, (sizes, cap, zero, used)


def test_blocks_of_hot_groups(spark):
    df = spark.range(500).selectExpr("1 as g", "id as i", "100L as s")
    got = P.chunk_table(P.stream(df, ["g"], "i", "s", 1000, "plain", block=64), ["g"], "i", "s").orderBy("chunk").collect()
    assert [x.chunk for x in got] == list(range(len(got))) and sum(x.n_items for x in got) == 500 and all(x.bytes <= 1000 for x in got)
    ids = P.number(P.chunk_table(P.fold(df.limit(30), ["g"], "i", "s", 1000, "plain"), ["g"], "i", "s"), ["g"]).orderBy("chunk").collect()
    assert ids[0].previous_shard is None and ids[0].next_shard == "shard_002" and ids[-1].next_shard is None
    assert P.fold(df.limit(0), ["g"], "i", "s", 1000).collect() == []


def test_clumped_order(spark):
    """One far value of the order leaves the blocks as they are."""
    far = [*range(300), 10**17]
    df = spark.createDataFrame([("g", i, (i * 37) % 200) for i in far], "g string, i bigint, s bigint")
    got = {x.i: x.chunk for x in P.stream(df, ["g"], "i", "s", 1000, "plain", block=40).collect()}
    assert got == dict(zip(far, brute([(i * 37) % 200 for i in far], 1000, "plain")))
