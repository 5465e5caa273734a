import json
import os

import pytest
from pyspark.sql import functions as F

from shardloom import cli
from shardloom.metrics import Profiler
from shardloom.operators import sharding
from shardloom.sources import corpus, sinks
from shardloom.streaming import documents


def test_cli_round_trip(spark, tmp_path):
    docs = {f"{d}/doc.json": {"users": {f"u{i}": {"name": "é" * i, "tags": list(range(i)), "a.b/c": {"x": None}} for i in range(30)}, "n": 1.5, "of": d} for d in ("one", "two")}
    for name, doc in docs.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True)
        (tmp_path / "in" / name).write_text(json.dumps(doc), encoding="utf-8")
    out = str(tmp_path / "out")
    n = cli.unflatten(spark, str(tmp_path / "in/*/*.json"), 1500, out)
    assert sorted(os.listdir(out)) == ["one%2Fdoc.json", "two%2Fdoc.json"]
    place = os.path.join(out, "one%2Fdoc.json")
    files = [f for f in os.listdir(place) if f.startswith("shard_")]
    assert len(files) * 2 == n > 60
    index, meta = (json.load(open(os.path.join(place, f), encoding="utf-8")) for f in ("_index.json", "_global_metadata.json"))
    assert index["total_shards"] == len(index["shards"]) == meta["shardCount"] == len(files) and {e["filename"] for e in index["shards"]} == set(files)
    assert index["shards"][0]["shard_id"] == meta["rootShard"] == "shard_001" and meta["createdAt"] and meta["originalSize"] > 0
    back = {r.doc_id: json.loads(r.json) for r in cli.flatten(spark, out).collect()}
    assert back == docs
    assert cli.write_documents(cli.flatten(spark, out), str(tmp_path / "back")) == 2 and sorted(os.listdir(tmp_path / "back")) == ["one%2Fdoc.json.json", "two%2Fdoc.json.json"]
    stats = {r.kind: r.files for r in sinks.output_statistics(spark, place).collect()}
    assert sum(v for k, v in stats.items() if k in ("dict", "list", "primitive")) == len(files)
    with pytest.raises(ValueError):
        cli.unflatten(spark, str(tmp_path / "in/one/doc.json"), 0, out)


def test_single_shard_and_folders(spark, tmp_path):
    c = corpus.from_strings(spark, {"a/b": '{"x":[1]}', "a_b": '{"y":2}', "..": "{}"})
    s = sharding.shard(c, 25000)
    got = sinks.write_files(s.where("doc_id = 'a/b' and ord = 0"), str(tmp_path), F.lit("mine.json")).collect()
    assert [(r.filename, r.error) for r in got] == [("mine.json", None)] and json.load(open(tmp_path / "a%2Fb" / "mine.json"))["_metadata"]["shardId"] == "shard_001"
    assert len({sinks.folder_name(x) for x in ("a/b", "a_b", "..", ".", "", "a.b", "%2E")}) == 7 and "/" not in sinks.folder_name("../x")
    assert sinks.write_files(s, str(tmp_path)).where("error is not null").count() == 0 and os.path.isdir(tmp_path / "%2E%2E")


def test_metadata_and_names(spark):
    c = corpus.from_strings(spark, {"a": '{"x":{"y/z":{"[0]":[1,2]}}}'})
    s = sharding.shard(c, 25000)
    rows = s.select("*", sinks.filename().alias("f"), sinks.read_metadata(sinks.metadata_json()).alias("m")).orderBy("ord").collect()
    assert [r.f for r in rows] == ["shard_001_dict.json", "shard_002_x_dict.json", "shard_003_x_y_z_dict.json", "shard_004_0_0_2_list.json"] or rows[3].f.endswith("_list.json")
    assert all(r.m.shard_id == r.shard_id and r.m.child_ids == r.child_ids and r.m.original_path == r.original_path for r in rows)
    assert sinks.index_totals(s).first().total_shards == len(rows) and [e.shard_id for e in sinks.index(s).orderBy("ord").collect()] == [r.shard_id for r in rows]


def test_checks(tmp_path):
    assert sinks.check_limit(0)[0][0] == "error" and sinks.check_limit(10)[0][0] == "warning" and sinks.check_limit(5000) == []
    assert sinks.check_folder("")[0][0] == "error" and sinks.check_folder("../x")[0][0] == "error" and sinks.check_folder(str(tmp_path / "new")) == []
    (tmp_path / "f.json").write_text("{}")
    assert sinks.check_folder(str(tmp_path))[0][0] == "warning" and sinks.check_folder(str(tmp_path / "f.json"))[0][0] == "error"
    assert sinks.clean_folder(str(tmp_path)) == 1


def test_profiler():
    p = Profiler()
    with p.operation("x", 1 << 20) as m:
        m.output_size = 1 << 19
    assert p.history[0].compression_ratio == 0.5 and "x" in p.export("csv") and json.loads(p.export())[0]["input_size"] == 1 << 20
    with pytest.raises(ValueError):
        p.export("xml")
    with pytest.raises(KeyError), p.operation("fails"):
        raise KeyError
    assert p.history[1].operation_name == "fails" and p.history[1].memory_peak_mb >= p.history[1].memory_start_mb > 0


def test_streams(spark, tmp_path):
    assert [(k, c) for k, c, _ in documents.chunk_members({"a": 1, "b": "x" * 50, "c": 2, "d": 3}, 20)] == [(None, {"a": 1}), ("b", "x" * 50), (None, {"c": 2, "d": 3})]
    assert list(documents.chunk_members([], 5)) == []
    src = tmp_path / "in"
    src.mkdir()
    (src / "one.json").write_text('{"a":{"b":[1,2]}}')
    q = documents.shard_stream(documents.read_documents(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_protocols():
    from shardloom import interfaces

    assert isinstance(sharding, interfaces.Engine) and isinstance(sharding.Cutter(), interfaces.Processor)
    e = interfaces.ProcessingError("no room", "memory", {"at": 3})
    assert (str(e), e.error_type, e.context) == ("no room", "memory", {"at": 3})
    with pytest.raises(ValueError):
        interfaces.ProcessingError("x", "odd")
