import random

import pytest

from shardloom.llm import mixture

DOCS = "doc_id bigint, source string, tokens bigint"
GOAL = "source string, target_share double, max_repeats int"


def test_plan_reaches_shares_where_repeats_allow():
    t = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 5), "gone": (0.0, 3)}
    p = mixture.plan({"a": 1000, "b": 100, "c": 100}, t)
    used = {s: p[s] * n for s, n in {"a": 1000, "b": 100, "c": 100}.items()}
    total = sum(used.values())
    assert used["a"] / total == pytest.approx(0.5) and used["b"] / total == pytest.approx(0.3) and p["b"] == pytest.approx(2)
    assert all(p[s] <= t[s][1] + 1e-9 for s in p)
    p = mixture.plan({"a": 1000, "b": 10, "c": 100}, t, total=1000)
    assert p["b"] == pytest.approx(2) and sum(p[s] * n for s, n in {"a": 1000, "b": 10, "c": 100}.items()) == pytest.approx(1000)
    assert mixture.plan({}, t) == {} and mixture.plan({"a": 0}, t) == {}


def test_flight_keeps_both_totals():
    r = random.Random(1)
    x = [r.randint(1, 5000) for _ in range(2000)]
    p = [0.3] * 2000
    mixture._fly(p, x, random.Random(2))
    inside = [i for i in range(2000) if 0 < p[i] < 1]
    assert len(inside) <= 2
    assert sum(p) == pytest.approx(600, abs=1e-4) and sum(a * b for a, b in zip(p, x)) == pytest.approx(0.3 * sum(x), rel=1e-6)


@pytest.mark.parametrize("block", [50, 4096])
def test_mixture(spark, block):
    r = random.Random(4)
    rows = [(i if i > 5 else None, r.choice(["big"] * 8 + ["small", "other", None]), r.choice([0, r.randint(1, 900)])) for i in range(4000)]
    goal = [("big", 0.7, 1), ("small", 0.3, 3), ("small", 0.3, 3), ("absent", 0.1, 2), (None, 0.2, 1)]
    mixed, sizes = mixture.mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame(goal, GOAL), block=block)
    got = mixed.collect()
    assert len({g.doc_id for g in got if g.doc_id is not None}) == sum(g.doc_id is not None for g in got)
    assert all(1 <= g.copies <= {"big": 1, "small": 3}[g.source] for g in got)
    share = {s.source: s.actual_share for s in mixture.shares(mixed, sizes).collect()}
    assert share["big"] == pytest.approx(0.7, abs=0.003) and share["small"] == pytest.approx(0.3, abs=0.003) and share["absent"] == 0
    assert sorted((g.doc_id or -1, g.copies) for g in got) == sorted((g.doc_id or -1, g.copies) for g in mixture.mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame(goal, GOAL), block=block)[0].collect())


def test_empty(spark):
    none, goal = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], GOAL)
    mixed, sizes = mixture.mix(none, goal)
    assert mixed.collect() == [] and mixture.shares(mixed, sizes).first().actual_share is None
    assert mixture.mix(spark.createDataFrame([(1, "a", 5)], DOCS), goal.limit(0))[0].collect() == []
