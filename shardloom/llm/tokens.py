"""Encoding of a corpus with a public byte-level BPE tokenizer.

Method: overlapping chunk encoding. Every text is cut into chunks; around each cut, neighbours overlap and are both
pre-tokenised there, the one before from a place that surely begins a pre-token, the one after from the cut itself.
Where their boundaries agree again they are stitched, and the pieces between such points are encoded on their own.
What a stitch is depends on the overlap only, so the chunks of a very long text find theirs in tasks of their own, and
nothing but short pieces ever meets in one call. Decoding joins the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Folder of the public vocabularies.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pattern that goes with these vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a chunk, and of the overlap on either side of a cut.
CHUNK, OVERLAP = 1024, 256
#: Characters from which the chunks of a text are spread over tasks.
SPREAD = 1 << 21
#: Places where a pre-token begins whatever stands before: between characters of different kinds that no alternative of
#: the pattern joins (a space joins what follows it, an apostrophe some letters).
SURE = r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])"


def vocabulary(folder: str = TOKENIZERS, name: str = VOCABULARY) -> str:
    """Path of a vocabulary file."""
    return os.path.join(folder, name)


@lru_cache(4)
def encoder(path: str):
    """The tokenizer of a file of ranks; one for each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _splitter():
    import regex

    return regex.compile(PATTERN), regex.compile(SURE, regex.REVERSE)


def stitch(window: str, at: int) -> int | None:
    """The first place from `at` on where the pre-tokens of both sides begin, not after white space (whose split depends on what follows); None if the window shows none."""
    split, sure = _splitter()
    m = sure.search(window, 1, at + 1) if at else None
    if m is None:
        return None
    before, after = split.finditer(window, m.start()), split.finditer(window, at)
    b = next(before, None)
    for x in after:
        p = x.start()
        while b is not None and b.start() < p:
            b = next(before, None)
        if b is None:
            return None
        if b.start() == p and not window[p - 1].isspace():
            return p
    return None


def cuts(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Where the pieces of a text begin, and its length; chunks that find no stitch go on in the next."""
    out = [0]
    for k in range(chunk, len(text), chunk):
        p = stitch(text[k - overlap : k + overlap], overlap)
        if p is not None:
            out.append(k - overlap + p)
    return [*out, len(text)]


def _ids(enc, text: str, chunk: int, overlap: int) -> list[np.ndarray]:
    """Ids of the pieces of a text."""
    at = cuts(text, chunk, overlap)
    return [enc.encode_to_numpy(text[a:b], disallowed_special=()) for a, b in zip(at, at[1:])]


def _encode(batches, path: str, chunk: int, overlap: int):
    enc = encoder(path)
    for batch in batches:
        parts: list[np.ndarray] = []
        off = [0]
        for x in batch.column(1).to_pylist():
            got = _ids(enc, x, chunk, overlap) if x else []
            parts += got
            off.append(off[-1] + sum(map(len, got)))
        values = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
        ids = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values))
        yield pa.RecordBatch.from_arrays([batch.column(0), ids], [batch.schema.names[0], "ids"])


def _spread(batches, chunk: int, overlap: int):
    """Rows (keys, no, chunk of the text with its overlap on both sides); the text is the last column."""
    for batch in batches:
        names = batch.schema.names[:-1]
        for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            for no, at in enumerate(range(0, len(text), chunk)):
                keys = [batch.column(j).slice(i, 1) for j in range(len(names))]
                yield pa.RecordBatch.from_arrays([*keys, pa.array([no]), pa.array([text[max(0, at - overlap) : at + chunk + overlap]])], [*names, "no", "part"])


def _chunks(batches, path: str, chunk: int, overlap: int):
    """Rows (keys, no, joins, goes_on, ids, body): ids of what lies between the stitches of a chunk; where one is wanting, the text of it."""
    enc = encoder(path)
    for batch in batches:
        joins, goes_on, ids, bodies = [], [], [], []
        for no, part in zip(batch.column("no").to_pylist(), batch.column("part").to_pylist()):
            lead = overlap if no else 0
            a = stitch(part[: 2 * overlap], overlap) if no else 0
            end = lead + chunk
            b = stitch(part[end - overlap : end + overlap], overlap) if len(part) > end else len(part) - end + overlap
            begin, stop = lead if a is None else a, end if b is None else end - overlap + b
            body = part[begin : min(stop, len(part))]
            whole = a is not None and b is not None
            joins.append(a is None), goes_on.append(b is None), bodies.append(None if whole else body)
            ids.append(enc.encode_to_numpy(body, disallowed_special=()).astype(np.int32) if whole else None)
        keep = [c for c in batch.schema.names if c != "part"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(joins, pa.bool_()), pa.array(goes_on, pa.bool_()), pa.array(ids, pa.list_(pa.int32())), pa.array(bodies, pa.string())], [*keep, "joins", "goes_on", "ids", "body"])


def _long_pieces(rows: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(keys, no, ids) of the pieces of long texts; `text` is the last column. A chunk needs nothing of its neighbours; only
    chunks without a stitch between them, which belong to one very long pre-token, are put together."""
    if chunk < 2 * overlap:
        raise ValueError("a chunk must be at least twice its overlap")
    keys = rows.columns[:-1]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    parts = rows.mapInArrow(lambda b: _spread(b, chunk, overlap), f"{kinds}, no bigint, part string").repartition(*keys, "no")
    got = parts.mapInArrow(lambda b: _chunks(b, path, chunk, overlap), f"{kinds}, no bigint, joins boolean, goes_on boolean, ids array<int>, body string")
    w = Window.partitionBy(*keys).orderBy("no")
    odd = got.where("body is not null").withColumn("first", F.last(F.when(~F.col("joins"), F.col("no")), True).over(w))
    joined = odd.groupBy(*keys, "first").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "body"))), lambda x: x["body"]), "").alias("text"))
    one = joined.select(F.struct(*keys, "first").alias("key"), "text").mapInArrow(lambda b: _encode(b, path, 1 << 40, 0), f"key struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in rows.select(*keys).schema)}, first:bigint>, ids array<int>")
    return got.where("body is null").select(*keys, "no", "ids").unionByName(one.select("key.*", "ids").withColumnRenamed("first", "no"))


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """(doc_id, ids) of every document, without special tokens (their spellings are ordinary text).

    Null and empty texts give an empty list; blank texts have ids. doc_id should be unique for texts of `spread`
    characters or more, whose chunks are spread over tasks; the chunks of others stay with their row, so repeated ids
    stay as they come and nothing is shuffled.
    """
    path = path or vocabulary()
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    long = F.coalesce(F.length("text"), F.lit(0)) >= spread
    short = rows.where(~long).mapInArrow(lambda b: _encode(b, path, chunk, overlap), f"doc_id {kind}, ids array<int>")
    pieces = _long_pieces(rows.where(long), path, chunk, overlap)
    return short.unionByName(pieces.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias("ids")))


def _count(batches, path: str, chunk: int, overlap: int):
    enc = encoder(path)
    for batch in batches:
        i = batch.schema.get_field_index("text")
        n = [sum(map(len, _ids(enc, x, chunk, overlap))) if x else 0 for x in batch.column(i).to_pylist()]
        keep = [j for j in range(batch.num_columns) if j != i]
        yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in keep), pa.array(n, pa.int64())], [*(batch.schema.names[j] for j in keep), "tokens"])


def count_tokens(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """The rows with `tokens` (0 for null and empty texts) in place of `text`, by the same chunks as `encode`. No ids leave the worker."""
    path = path or vocabulary()
    names = [c for c in docs.columns if c != "text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    long = F.coalesce(F.length("text"), F.lit(0)) >= spread
    short = docs.where(~long).mapInArrow(lambda b: _count(b, path, chunk, overlap), f"{fields}, tokens bigint")
    # equal rows are counted once and come back as often as they were
    once = docs.where(long).groupBy(*names, F.xxhash64("text").alias("hash_")).agg(F.count("*").alias("times_"), F.first("text").alias("text"))
    whole = _long_pieces(once, path, chunk, overlap).groupBy(*names, "hash_", "times_").agg(F.sum(F.size("ids")).alias("tokens"))
    return short.unionByName(whole.select(*names, "tokens", F.explode(F.sequence(F.lit(1), F.col("times_").cast("int")))).drop("col"))


def chunk_report(docs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunks, pieces): chunks of each text, and the pieces that their stitches leave; none for null and empty texts."""

    def run(batches):
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            pieces = [len(cuts(x, chunk, overlap)) - 1 if x else 0 for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([-(-len(x) // chunk) for x in texts], pa.int64()), pa.array(pieces, pa.int64())], ["doc_id", "chunks", "pieces"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, chunks bigint, pieces bigint")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the bytes of the ids joined, then read as UTF-8 (bytes that are none become U+FFFD). Null ids give null."""
    path = path or vocabulary()

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            out = [None if x is None else b"".join(map(enc.decode_single_token_bytes, x)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
