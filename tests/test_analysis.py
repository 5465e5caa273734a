import json
import random
from collections import Counter

import pytest

from shardloom.functions.jsonnodes import compact
from shardloom.operators import analysis as A
from shardloom.operators import sharding as S
from shardloom.sources import corpus

from .test_nested import tree
from .test_nodes import walk


def docs(seed=11, n=120):
    r = random.Random(seed)
    fixed = [{}, [], {"a": {}, "b": {}, "c": {}, "d": 1}, {"a": {}, **{str(i): i for i in range(9)}}, list(range(150)), [{"a": [1]}, 2, "x"], {"k": {"l": {"m": {"n": {"o": {"p": {"q": 1}}}}}}}]
    return fixed + [v for v in (tree(r, 5) for _ in range(n)) if isinstance(v, (dict, list))]


@pytest.fixture(scope="module")
def nodes(spark):
    df = corpus.nodes(corpus.from_strings(spark, {str(i): compact(v) for i, v in enumerate(docs())})).persist()
    yield df
    df.unpersist()


def by_id(df):
    return {int(r.doc_id): r for r in df.collect()}


def depth(v):
    if isinstance(v, (dict, list)) and v:
        return 1 + max(map(depth, v.values() if isinstance(v, dict) else v))
    return 0


def test_structure(nodes):
    got = by_id(A.patterns(A.children_of_root(nodes)))
    for i, v in enumerate(docs()):
        kids = list(v.values()) if isinstance(v, dict) else v
        kinds = Counter(map(S.kind_of, kids))
        r = got[i]
        assert r.structure == S.structure_of(v) and (r.n, r.dicts, r.lists, r.primitives) == (len(kids), kinds["dict"], kinds["list"], kinds["primitive"])
        assert r.max_depth == max(map(depth, kids), default=0) and r.homogeneous == (len(kinds) <= 1)
        if isinstance(v, dict) and kids:
            assert (r.advisory == "dict-of-dicts") == (kinds["dict"] / len(kids) >= 0.8 or kinds["primitive"] / len(kids) >= 0.8)
    assert got[2].structure == "dict-of-dicts" and got[2].advisory == "mixed" and got[3].structure == "mixed" and got[3].advisory == "dict-of-dicts"


def test_counts_and_scores(nodes):
    stats, mixed, nest, deep = by_id(A.statistics(nodes)), by_id(A.mixed_analysis(nodes)), by_id(A.object_nesting(nodes)), by_id(A.depths(nodes))

    def sample(v, d=0):
        yield v, d
        for x in v.values() if isinstance(v, dict) else v[:5] if isinstance(v, list) else []:
            yield from sample(x, d + 1)

    def level(v):
        return max((1 + level(x) for x in v.values() if isinstance(x, dict)), default=0)

    for i, v in enumerate(docs()):
        all_ = list(walk(v))
        assert stats[i].dicts == sum(isinstance(x, dict) for x, *_ in all_) and stats[i]["keys"] == sum(len(x) for x, *_ in all_ if isinstance(x, dict)) and stats[i]["items"] == sum(len(x) for x, *_ in all_ if isinstance(x, list))
        assert stats[i].spaced_size == len(json.dumps(v, ensure_ascii=False).encode()) and deep[i].depth == depth(v)
        s = list(sample(v))
        levels = {}
        for x, d in s:
            levels.setdefault(d, set()).add(S.kind_of(x))
        score = 0.5 * len({S.kind_of(x) for x, _ in s}) + 0.3 * max(d for _, d in s) + (len(s) > 100) + 0.5 * sum(len(k) > 1 for k in levels.values())
        assert mixed[i].score == pytest.approx(min(10, score)) and mixed[i].max_depth == max(d for _, d in s)
        if isinstance(v, dict):
            assert nest[i].level == level(v)


def test_advice(nodes):
    limit = 60
    found = {}
    for r in A.candidates(nodes, limit).collect():
        found.setdefault(int(r.doc_id), {})[tuple(json.loads(r.place))] = r.priority
    for i, v in enumerate(docs()):
        want = {}
        for x, p, d in walk(v):
            n = len(json.dumps(x, ensure_ascii=False).encode())
            if isinstance(x, (dict, list)) and n > limit:
                want[p] = max(0.1, n / limit + min(len(x) / 100, 1) + 0.2 * isinstance(x, dict) - 0.1 * d)
        assert {k: pytest.approx(x, abs=1e-5) for k, x in want.items()} == found.get(i, {})
    top = A.top_candidates(A.candidates(nodes, limit), 2).groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert top <= 2
    assert {r.suggestion for r in A.dict_advice(nodes, 40).collect()} >= {"split_large_values", "flatten_deep_nesting"}
    assert {r.suggestion for r in A.list_advice(nodes, 40).collect()} >= {"group_similar_items", "flatten_nested_structures"}
    assert by_id(A.recommend(nodes, limit)).keys() == set(range(len(docs())))
    sizes = by_id(A.size_breakdown(nodes))
    assert all(sizes[i].file == S.file_size(v) for i, v in enumerate(docs()))


def test_validation_and_paths(spark):
    c = corpus.from_strings(spark, {"ok": '{"a":{"b.c":[1,{"x":null}]}}', "bad": "{", "blank": " ", "scalar": "3", "deep": "[" * 30 + "]" * 30})
    got = {r.doc_id: (r.severity, r.error_type) for r in A.validate(c).collect()}
    assert got == {"bad": ("error", "SYNTAX"), "blank": ("error", "SYNTAX"), "scalar": ("error", "STRUCTURE"), "deep": ("warning", "STRUCTURE")}
    at = lambda *p: {r.doc_id: r.value for r in A.value_at(c, list(p)).collect()}["ok"]
    assert at("a", "b.c", "[0]") == "1" and at("a", "nope") is None and at("a", "b.c", "[1]", "x") in (None, "null")


def test_runs(spark):
    m = spark.createDataFrame([("A ", 1.0, 100, 50, 5.0, 2500.0, 0.5, 1, 2.0), ("a", 3.0, 100, 350, None, 100.0, 0.1, 2, 2.0), ("a", 3.0, 100, 350, None, 100.0, 0.1, 2, 2.0)], "operation_name string, duration double, input_size bigint, output_size bigint, cpu_percent double, memory_peak_mb double, throughput_mbps double, shards_created int, compression_ratio double")
    r = A.performance(m).first()
    assert (r.operations, r.total_duration, r.shards, r.ratio, r.cpu) == (2, 4.0, 3, 2.0, 5.0)
    assert {x.suggestion for x in A.history_advice(m).collect()} == {"reduce_chunk_size", "smaller_batches", "enable_parallel", "optimize_structure", "decrease_chunk_size"}
    assert A.performance(m.limit(0)).collect() == []
