import json
import random

import numpy as np

from shardloom.llm import splitting as S


def check(raw, limit, overlap, near):
    got = S.split(raw, limit, overlap, near)
    if len(raw) <= limit:
        assert got == [(0, len(raw), 0)]
        return got
    assert got[0][0] == 0 and got[-1][1] == len(raw)
    for (a, b, s), (c, d, t) in zip(got, got[1:]):
        assert c == b - t and t >= 0 and d > b
    assert all(b - a <= limit for a, b, _ in got)
    return got


def test_limits_and_overlap():
    r = random.Random(8)
    for k in range(150):
        text = "".join(r.choice(["word ", "é", "漢字", "🙂", "x" * 30, "\n", '","', "},", "\\u00e9", "\\n", ". "]) for _ in range(r.randint(0, 400)))
        limit = r.choice([40, 100, 500])
        overlap = r.choice([0, 5, limit // 3])
        for near in (0, 32):
            got = check(text.encode(), limit, overlap, near)
            for a, b, s in got:
                text.encode()[a:b].decode()  # whole characters only
            for a, b, s in got[1:]:
                assert abs(s - overlap) <= 6


def test_natural_boundaries():
    raw = json.dumps([{"id": i, "text": "some words here " * 3} for i in range(80)], separators=(",", ":")).encode()
    got = check(raw, 1000, 0, 32)
    assert all(raw[b - 2 : b] == b"}," for _, b, _ in got[:-1])
    lines = ("line of text\n" * 200).encode()
    assert all(lines[b - 1 : b] == b"\n" for _, b, _ in check(lines, 300, 20, 32))
    assert len(check(b"x" * 1000, 300, 0, 32)) == 4


def test_indivisible_units():
    assert [b - a for a, b, _ in S.split("🙂🙂".encode(), 4, 0)] == [4, 4]
    assert all(b - a <= 3 for a, b, _ in S.split("🙂🙂".encode(), 3, 0))
    assert S.split(b"", 10, 2) == [(0, 0, 0)]


def test_operator(spark):
    shards = spark.createDataFrame([(1, "a", "word " * 100, "c"), (1, "a", "word " * 100, "c"), (1, "b", "short", "c"), (1, "n", None, "c"), (2, "a", "word " * 100, "c"), (9, "a", "word " * 100, "c")], "run_id bigint, shard_id string, data string, piece string")
    docs = spark.createDataFrame([(1, "list"), (1, "list"), (2, "other")], "run_id bigint, data_structure string")
    lim = spark.createDataFrame([("list", 120, 10), ("mixed", 5, None)], "data_structure string, max_bytes bigint, overlap_bytes bigint")
    meta = spark.createDataFrame([(1, "a", ["x", "y"])], "run_id bigint, shard_id string, original_path array<string>")
    rows = sorted(S.split_shards(shards, docs, lim, meta).collect(), key=lambda r: r.piece)
    assert {(r.run_id, r.shard_id) for r in rows} == {(1, "a")} and [r.piece for r in rows] == list(range(1, rows[0].n_pieces + 1))
    assert rows[0].original_path == ["x", "y"]
    text = "".join(r.text.encode()[r.shared_bytes :].decode() for r in rows)
    assert text == "word " * 100
    assert S.split_shards(shards.limit(0), docs, lim).collect() == [] and S.split_shards(shards, docs, lim.limit(0)).collect() == []


def test_strings_are_spared():
    raw = json.dumps({f"k{i}": "one, two. three, four" for i in range(60)}, separators=(",", ":")).encode()
    for _, b, _ in check(raw, 300, 0, 8)[:-1]:
        assert raw[b - 2 : b] == b'",'
    body = json.dumps({"t": "\n".join("some line of text" for _ in range(100))}).encode()
    assert all(body[b - 2 : b] == b"\\n" for _, b, _ in check(body, 400, 0, 0)[:-1])


def cost(raw, pieces, limit, overlap):
    pen = S.cut_penalties(raw)
    mean = len(raw) / max(1, int(-(-(len(raw) - overlap) // max(1, limit - overlap))))
    own = [a + s for a, _, s in pieces] + [len(raw)]
    return sum(pen[p] for p in own[1:-1]) + S.BALANCE * sum(((b - a) / mean - 1) ** 2 for a, b in zip(own, own[1:]))


def test_near_the_best():
    r = random.Random(3)
    worse = []
    for k in range(25):
        raw = json.dumps([{"id": i, "text": " ".join(r.choice(["quay", "berth", "é", "sluice."]) for _ in range(r.randint(1, 30)))} for i in range(60)], ensure_ascii=False).encode()
        limit, overlap = r.choice([400, 900]), r.choice([0, 30])
        best, found = (cost(raw, S.split(raw, limit, overlap, g), limit, overlap) for g in (0, S.NEAR))
        assert found >= best - 1e-9
        worse.append(found / best - 1)
    assert max(worse) < 0.02 and sum(worse) / len(worse) < 0.002


def test_runs_make_no_difference():
    r = random.Random(5)
    for _ in range(300):
        m = r.randint(2, 90)
        pos = np.cumsum([0, *(r.choice([1, 2, 30, 90]) for _ in range(m - 1))])
        frm = np.maximum(0, pos - np.where(pos > 0, r.choice([0, 3]), 0))
        cost = np.array([0.0, *(r.choice([0.0, 0.2, 1.0, 50.0]) for _ in range(m - 2)), 0.0])
        limit, mean = r.choice([40, 95, 300]), r.choice([30.0, 80.0])
        best = [0.0]
        for i in range(1, m):
            best.append(min((best[a] + S.BALANCE * ((pos[i] - pos[a]) / mean - 1) ** 2 for a in range(i) if pos[i] - frm[a] <= limit), default=float("inf")) + cost[i])
        cuts = S._cheapest(pos, frm, cost, limit, mean)
        assert (cuts is None) == (best[-1] == float("inf"))
        if cuts:
            assert all(pos[b] - frm[a] <= limit for a, b in zip(cuts, cuts[1:]))
            assert abs(sum(cost[c] for c in cuts[1:]) + sum(S.BALANCE * ((pos[b] - pos[a]) / mean - 1) ** 2 for a, b in zip(cuts, cuts[1:])) - best[-1]) < 1e-9
