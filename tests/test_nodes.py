import json

import pyarrow as pa

from shardloom.functions.jsonnodes import compact, node_table
from shardloom.sources import corpus

from .test_nested import texts, tree
import random


def walk(v, path=(), depth=0):
    yield v, path, depth
    if isinstance(v, dict):
        for k, y in v.items():
            yield from walk(y, (*path, k), depth + 1)
    elif isinstance(v, list):
        for i, y in enumerate(v):
            yield from walk(y, (*path, f"[{i}]"), depth + 1)


def test_nodes_against_python():
    r = random.Random(4)
    docs = [v for v in (tree(r, 5) for _ in range(400)) if isinstance(v, (dict, list))]
    t = node_table(pa.array([str(i) for i in range(len(docs))]), pa.array([compact(v) for v in docs]), True).to_pylist()
    want = [(str(i), v, p, d) for i, doc in enumerate(docs) for v, p, d in walk(json.loads(compact(doc)))]
    assert len(t) == len(want)
    size = lambda v, **k: len(json.dumps(v, ensure_ascii=False, **k).encode())
    for x, (i, v, p, d) in zip(t, want):
        assert (x["doc_id"], tuple(x["path"]), x["depth"]) == (i, p, d)
        assert json.loads(x["raw"]) == v or v != v
        assert x["kind"] == ("dict" if isinstance(v, dict) else "list" if isinstance(v, list) else "primitive")
        assert x["scalar_type"] == (None if isinstance(v, (dict, list)) else type(v).__name__)
        assert x["n_children"] == (len(v) if isinstance(v, (dict, list)) else 0)
        assert x["compact_size"] == size(v, separators=(",", ":")) and x["spaced_size"] == size(v) and x["formatted_size"] == size(v, indent=2)
        assert x["nested_size"] == size({"d": v}, indent=2) - len('{\n  "d": \n}')


def test_corpus(spark):
    sample = {str(i): t for i, t in enumerate(texts(3, 80)) if t is None or len(t) < 3000}
    c = corpus.from_strings(spark, {k: v for k, v in sample.items() if v is not None})
    got = {r.doc_id: (r.json, r.error_type) for r in corpus.canonical(c).collect()}
    assert len(got) == len([v for v in sample.values() if v is not None])
    assert all((a is None) != (b is None) for a, b in got.values())
    assert corpus.nodes(c.limit(0)).collect() == []
    roots = corpus.nodes(c).where("depth = 0").count()
    assert 0 < roots <= len(got)
