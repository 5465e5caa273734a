import random

import pytest

from shardloom.operators import hierarchy as H

SCHEMA = "run_id bigint, shard_id string, parent_id string, child_ids array<string>, extra string"


def brute(rows):
    records, own, held = set(), {}, {}
    for run, sid, par, kids, _ in rows:
        if run is None or sid is None:
            continue
        records.add((run, sid))
        if par:
            own[run, sid] = min(par, own.get((run, sid), par))
        for k in kids or []:
            if k:
                held.setdefault((run, k), set()).add(sid)
    up = {k: own.get(k) or (min(held[k]) if k in held else None) for k in records}
    out = {}
    for run, sid in records:
        line, seen, cur = [], {}, sid
        while True:
            if cur in seen:
                cyc = line[seen[cur]:]
                on = sid in cyc
                out[run, sid] = ("cycle" if on else "under_cycle", min(cyc), 0 if on else seen[cur], None)
                break
            seen[cur] = len(line)
            line.append(cur)
            p = up[run, cur]
            if p is None:
                out[run, sid] = ("rooted", cur, len(line) - 1, line[::-1])
                break
            if (run, p) not in records:
                out[run, sid] = ("detached", cur, len(line) - 1, None)
                break
            cur = p
    return out


def make(seed, n_runs, n):
    r, rows = random.Random(seed), []
    for run in range(n_runs):
        size = r.randint(1, n)
        ids = [f"shard_{i:03d}" if r.random() < 0.9 else f"odd/{i}" for i in range(size)]
        for i, s in enumerate(ids):
            par = r.choice([None, "", "gone", *([ids[max(0, i - r.randint(1, 4))]] * 20), r.choice(ids)])
            rows.append((run, s, par, r.choice([None, [], [r.choice(ids)], [None, "", "nobody"]]), "x"))
        rows += r.sample(rows, min(len(rows), 3))
    return [*rows, (None, "a", None, None, None), (1, None, None, ["shard_000"], None)]


@pytest.mark.parametrize("block", [200_000, 7])
def test_against_brute_force(spark, block):
    rows = make(5, 12, 60)
    rows = [x for x in rows if x[1] is not None]
    got = {(x.run_id, x.shard_id): (x.kind, x.head_id, x.steps, x.path) for x in H.build(spark.createDataFrame(rows, SCHEMA), True, block).collect()}
    want = brute(rows)
    assert {k[0] for k in {v[:1] for v in want.values()}} == {"rooted", "cycle", "under_cycle", "detached"}
    assert got == want


def test_cycle_across_blocks(spark):
    n = 30
    rows = [(1, f"s_{i:03d}", f"s_{(i * 7 + 3) % n:03d}", None, "") for i in range(n)] + [(1, f"s_{i:03d}", f"s_{i - 1:03d}", None, "") for i in range(n, 60)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {x.shard_id: (x.kind, x.head_id, x.steps) for x in H.build(df, False, 10).collect()}
    assert got == {k[1]: v[:3] for k, v in brute(rows).items()}


def test_lines_into_a_cycle_within_a_block(spark):
    # the cycle 001, 002, 003, 011 leaves its block at 003; 015 comes from another block over 005, which joins it at 002
    up = {1: 2, 2: 3, 3: 11, 11: 1, 5: 2, 15: 5, 16: 15, 25: 16, 26: None, 27: 26}
    rows = [(1, f"s_{i:03d}", f"s_{up[i]:03d}" if up.get(i) is not None else None, None, "") for i in range(30)]
    got = {x.shard_id: (x.kind, x.head_id, x.steps) for x in H.build(spark.createDataFrame(rows, SCHEMA), False, 10).collect()}
    assert got == {k[1]: v[:3] for k, v in brute(rows).items()} and got["s_015"] == ("under_cycle", "s_001", 2)


@pytest.mark.parametrize("seed", range(3))
def test_many_cycles_over_blocks(spark, seed):
    r, rows = random.Random(seed), []
    for run in range(40):
        n = r.randint(8, 40)
        rows += [(run, f"s_{i:03d}", r.choice([None, "gone", *[f"s_{r.randrange(n):03d}"] * 12]), None, "") for i in range(n)]
    got = {(x.run_id, x.shard_id): (x.kind, x.head_id, x.steps) for x in H.build(spark.createDataFrame(rows, SCHEMA), False, 5).collect()}
    assert got == {k: v[:3] for k, v in brute(rows).items()}


def test_empty_and_descendants(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert H.build(empty, True).collect() == [] and H.hierarchy(empty).collect() == []
    rows = [(1, "a", None, ["b", "b"], ""), (1, "b", None, ["c"], ""), (1, "c", "b", None, ""), (1, "d", "d", None, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(x.shard_id, x.descendant_id, x.distance) for x in H.descendants(df).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}
    assert {(x.shard_id, x.state, x.root_id, x.depth, x.n_descendants) for x in H.hierarchy(df).collect()} == {("a", "rooted", "a", 0, 2), ("b", "rooted", "a", 1, 1), ("c", "rooted", "a", 2, 0), ("d", "cycle", None, None, None)}


def test_subtrees_over_blocks(spark):
    rows = make(11, 6, 80)
    rows = [x for x in rows if x[1] is not None]
    line = {k: v[3] for k, v in brute(rows).items()}
    want = {k: (sum(k[1] in (v or [])[:-1] for o, v in line.items() if o[0] == k[0]) if line[k] else None) for k in line}
    for block in (9, 512):
        got = {(x.run_id, x.shard_id): x.n_descendants for x in H.hierarchy(spark.createDataFrame(rows, SCHEMA), block).collect()}
        assert got == want


def test_blocks_are_bounded_whatever_the_ids(spark):
    ids = spark.range(3000).selectExpr("1L as run_id", "concat('p', id, '_shard_001') as shard_id", "if(id > 0, concat('p', (id - 1) div 2, '_shard_001'), null) as parent_id", "cast(null as array<string>) as child_ids")
    sizes = [r["count"] for r in H._blocks(H.resolve_parents(ids), 100).groupBy("block").count().collect()]
    assert len(sizes) > 25 and max(sizes) < 160
    top = H.build(ids, block_rows=100).orderBy("steps").first()
    assert (top.below, top.kind) == (3000, "rooted")


def test_paths_of_some_records(spark):
    df = spark.range(60).selectExpr("1L as run_id", "format_string('s_%02d', id) as shard_id", "if(id > 0, format_string('s_%02d', id - 1), null) as parent_id", "cast(null as array<string>) as child_ids")
    starts = spark.createDataFrame([(1, "s_40"), (1, "nobody")], "run_id bigint, shard_id string")
    for block in (7, 512):
        got = {r.shard_id: r.path for r in H.build(df, True, block, starts).collect()}
        assert len(got) == 60 and got.pop("s_40") == [f"s_{i:02d}" for i in range(41)] and set(map(type, got.values())) == {type(None)}
