import json
import random

import pyarrow as pa

from shardloom.functions.jsonbuf import Index, fields, flatten
from shardloom.operators import nested


def strict(x):
    def no(_):
        raise ValueError

    return json.loads(x, parse_constant=no)


def brute(text):
    try:
        v = strict(text)
        if isinstance(v, str):
            try:
                w = strict(v)
                v = w if isinstance(w, (dict, list)) else v
            except ValueError:
                pass
    except (ValueError, TypeError):
        return set()
    out = set()

    def walk(x, ptr, near, elem):
        if isinstance(x, dict):
            if elem:
                out.add((near, ptr))
                near = ptr
            for k, y in x.items():
                walk(y, f"{ptr}/{k.replace('~', '~0').replace('/', '~1')}", near, False)
        elif isinstance(x, list):
            for i, y in enumerate(x):
                walk(y, f"{ptr}/{i}", near, True)

    walk(v, "", "", False)
    return out


def tree(r, depth):
    k = r.random()
    if depth <= 0 or k < 0.25:
        return r.choice([None, True, False, 0, -1, 1.5, 1e30, -0.0, "", "é\n\"\\", "  {[,:", "a/b~", "[{}]", "\\", "\\\\\""])
    if k < 0.6:
        return {r.choice(["a", "b", "", "a/b", "m~n", "é", "q\"", "back\\", "0", "x y"]): tree(r, depth - 1) for _ in range(r.randint(0, 4))}
    return [tree(r, depth - 1) for _ in range(r.randint(0, 4))]


def texts(seed, n):
    r, out = random.Random(seed), []
    for _ in range(n):
        t = json.dumps(tree(r, r.randint(0, 6)), ensure_ascii=r.random() < 0.5, indent=r.choice([None, None, 2]))
        k = r.random()
        if k < 0.15:
            t = json.dumps(t, ensure_ascii=r.random() < 0.5)
        elif k < 0.55 and t:
            p = r.randrange(len(t))
            t = r.choice([t[:p], t[:p] + r.choice('{}[],:"\\ 0-.e\n\tux') + t[p:], t[:p] + t[p + 1:], t + r.choice([" ", "x", "}", "\x00", "﻿"])])
        out.append(t)
    return [*out, None, "", "  ", "[NaN]", "[01]", "[1.]", "[.5]", "[-]", '["\\x"]', '["\\u12"]', '["\\u123', '{"a":[{}],"a":[{},{}]}', '{"a":[{}],"a":1}', '{"a":[{"x":[{}]}],"\\u0061":[[{}]]}', '[{}]\\', '"', '\\"', "[" * 3000 + "{}" + "]" * 3000, "tru", "[truefalse]", '{"a":1}{"b":2}', "[]]", "][", '[{"a" : [ {} , 5 , [ {} ] ] }]']


def test_valid_and_flatten():
    sample = [t for t in texts(1, 6000) if t is None or len(t) < 5000]
    out = flatten(pa.array(sample, pa.large_string()))
    got = {}
    for row, a, b in zip(out["row"].tolist(), out["parent_ptr"].to_pylist(), out["child_ptr"].to_pylist()):
        got.setdefault(row, set()).add((a, b))
    hits = 0
    for i, t in enumerate(sample):
        want = brute(t)
        hits += bool(want)
        assert got.get(i, set()) == want, t
    assert hits > 500
    index = Index(pa.array(sample, pa.large_string()))
    for i, t in enumerate(sample):
        try:
            strict(t)
            ok = True
        except (ValueError, TypeError):
            ok = False
        assert index.valid[i] == ok, t


def test_deep_alone():
    deep = "[" * 3000 + "{}" + "]" * 3000
    out = flatten(pa.array([deep], pa.large_string()))
    assert out["child_ptr"].to_pylist() == ["/0" * 3000]


def test_fields():
    out = flatten(pa.array(['{"a":1,"b":{"c":"x"},"a":"2"}'], pa.large_string()), every=True)
    assert [dict(x) for x in fields(out["index"], out["token"]).to_pylist()] == [{"a": '"2"'}, {"c": '"x"'}]
    assert out["child_ptr"].to_pylist() == ["", "/b"]


def test_operator(spark):
    sample = [t for t in texts(2, 300) if t is None or len(t) < 5000]
    rows = [(i % 7, f"shard_{i:03d}", t, "clash") for i, t in enumerate(sample)]
    df = spark.createDataFrame(rows + rows[:20], "run_id bigint, shard_id string, data string, parent_ptr string")
    got = {tuple(x) for x in nested.array_objects(df).collect()}
    want = {(r, s, a, b) for r, s, t, _ in rows for a, b in (brute(t) if t is not None else ())}
    assert got == want
    assert nested.array_objects(df.limit(0)).collect() == []
    meta = spark.createDataFrame([(0, "shard_000", ["a"], "dict")], "run_id bigint, shard_id string, original_path array<string>, data_type string")
    flat = nested.flat_objects(df, meta).collect()
    assert {(x.run_id, x.shard_id, x.child_ptr) for x in flat if x.in_array} == {w[:2] + w[3:] for w in want}
