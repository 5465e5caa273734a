import random

import pytest

from shardloom.llm import tokens

SCHEMA = "doc_id bigint, text string, ids string, n bigint"


def whole(text):
    return tokens.encoder(tokens.vocabulary()).encode_ordinary(text) if text else []


def samples(seed=3):
    r = random.Random(seed)
    alphabet = ["a", "word", " ", "  ", "\n", "'s", "'ll", "1", "23", "é", "漢字", "かな", "🙂", "!", "...", "\t", "x" * 40, " " * 30, "<|endoftext|>", "' ", "l'l"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 400))) for _ in range(40)]
    return [None, "", " ", "\n", "a", "y" * 700, " " * 700, "ab" * 300 + " c", "漢" * 500, "'" * 300, *texts]


@pytest.mark.parametrize("chunk,overlap,spread", [(64, 16, 100), (50, 8, 1), (16, 8, 1 << 20), (1024, 256, 1 << 20)])
def test_chunks_give_the_ids_of_the_whole(spark, chunk, overlap, spread):
    rows = [(i, t, "clash", 1) for i, t in enumerate(samples())]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.ids for r in tokens.encode(df, chunk=chunk, overlap=overlap, spread=spread).collect()}
    assert got == {i: whole(t) for i, t, _, _ in rows}
    twice = df.select("doc_id", "text").unionByName(df.select("doc_id", "text"))
    n = tokens.count_tokens(twice, chunk=chunk, overlap=overlap, spread=spread).collect()
    assert sorted((r.doc_id, r.tokens) for r in n) == sorted([(i, len(whole(t))) for i, t, _, _ in rows] * 2)


def test_sure_places_are_boundaries():
    split, sure = tokens._splitter()
    for seed in range(60):
        for t in samples(seed):
            if t:
                starts = {m.start() for m in split.finditer(t)}
                assert {m.start() for m in sure.finditer(t)} <= starts | {len(t)}


def test_corpus_goes_through_the_stitches(spark):
    t = "Die Vorrichtung nach Anspruch 1 umfasst eine Kühlplatte, die 25 mm dick ist. " * 60
    r = tokens.chunk_report(spark.createDataFrame([(1, t, "", 0), (2, "漢字" * 3000, "", 0), (3, None, "", 0), (4, "", "", 0)], SCHEMA)).collect()
    assert {x.doc_id: (x.chunks, x.pieces) for x in r} == {1: (5, 5), 2: (6, 1), 3: (0, 0), 4: (0, 0)}


def test_same_ids_as_the_other_library():
    lib = pytest.importorskip("tokenizers")
    t = lib.Tokenizer.from_file(tokens.vocabulary(name="byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for x in samples(5):
        if x:
            assert t.encode(x, add_special_tokens=False).ids == whole(x)


def test_round_trip_and_counts(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(samples())]
    df = spark.createDataFrame(rows, SCHEMA)
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df)).collect()}
    assert back == {i: t or "" for i, t, _, _ in rows}
    counts = {r.doc_id: r.tokens for r in tokens.count_tokens(df.select("doc_id", "text")).collect()}
    assert counts == {i: len(whole(t)) for i, t, _, _ in rows}
    assert tokens.encode(df.limit(0)).collect() == []
