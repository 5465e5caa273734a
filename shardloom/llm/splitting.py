"""Splitting oversized texts at natural boundaries.

Method: dynamic programming over boundary positions. Every place where a text may be cut has a penalty by its kind; the
program finds the cuts with the least sum of penalties and size imbalance under which no piece, with the overlap it
shares with the one before, exceeds the limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Penalties of a cut, by what stands before it: line end; end of a container and its comma; comma, end of a sentence;
#: white space; an escaped line end; any other place between characters. Within the strings of a JSON text all cost more.
PENALTY = {"line": 0.0, "container": 0.05, "comma": 0.15, "sentence": 0.2, "escaped_line": 0.15, "space": 0.4, "inside": 1.0}
IN_STRING = 0.3
#: The program runs over the places that no better one is near, then over all places within NEAR bytes of the cuts it
#: found; 0 tries all at once. A better place is near if it makes up for REACH times the imbalance on the way: with 1 no
#: place is lost that could be needed but for the limit; more leaves it more ways to keep to the limit.
NEAR, REACH = 32, 8.0
#: Weight of the squared deviation of a piece from the mean length against one penalty.
BALANCE = 0.5

#: Places of a run that are worked off at once.
RUN = 64
#: Tasks of the splitting for each of the scan.
SPREAD = 4

_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?;"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in " \t\r\n"]] = True


def cut_penalties(raw: bytes) -> np.ndarray:
    """Penalty of a cut before byte i, infinite inside a character, an escape or a CR LF; entry len(raw) is the end."""
    b = np.frombuffer(raw, np.uint8)
    n = len(b)
    pen = np.full(n + 1, PENALTY["inside"])
    at, nxt = pen[1:n], b[1:]  # views: the cut before nxt
    p1 = b[:-1]
    p2, p3 = np.zeros_like(p1), np.zeros_like(p1)
    p2[1:], p3[2:] = p1[:-1], p1[:-2]
    word = _SPACE[p1] & ~_SPACE[nxt]
    at[word] = PENALTY["space"]
    at[(word & _END[p2]) | ((p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x82))] = PENALTY["sentence"]  # the latter: ideographic full stop
    comma = p1 == ord(",")
    at[comma] = PENALTY["comma"]
    at[comma & ((p2 == ord("}")) | (p2 == ord("]")))] = PENALTY["container"]
    at[p1 == ord("\n")] = PENALTY["line"]
    # no cut inside characters, escapes, line ends
    at[(nxt & 0xC0) == 0x80] = np.inf
    at[(p1 == 13) & (nxt == 10)] = np.inf
    slash = np.flatnonzero(b == ord("\\"))
    if len(slash):
        new = np.r_[True, slash[1:] != slash[:-1] + 1]
        i = np.arange(len(slash))
        starts = slash[(i - np.maximum.accumulate(np.where(new, i, 0))) % 2 == 0]
        after = starts[b[np.minimum(starts + 1, n - 1)] == ord("n")] + 2
        pen[after[after < n]] = PENALTY["escaped_line"]
        for k in range(1, 6):
            p = starts + k
            unicode = b[np.minimum(starts + 1, n - 1)] == ord("u")
            p = p[(p < n) & (unicode | (k == 1))]
            pen[p] = np.inf
    if raw.lstrip()[:1] in (b"{", b"["):
        quote = b == ord('"')
        if len(slash):
            quote[np.minimum(starts + 1, n - 1)] = False
        pen[1:] += IN_STRING * (np.cumsum(quote) % 2)  # places with an odd number of quotes before them
    pen[0] = pen[n] = 0.0
    return pen


def split(raw: bytes, limit: int, overlap: int, near: int = NEAR) -> list[tuple[int, int, int]]:
    """(start, end, bytes shared with the piece before) of the pieces of `raw`.

    Every piece has at most `limit` bytes, the shared ones included. The shared bytes are `overlap` or, where that
    would start inside a character or an escape, the nearest number at which it does not (the larger of two, while it
    stays under the limit); at most half the limit is shared, as pieces would not get on else. Texts within the limit are one piece; an empty text too. Where no character fits (limit
    below its bytes) the character is cut.
    """
    n = len(raw)
    if n <= limit:
        return [(0, n, 0)]
    overlap = max(0, min(overlap, limit // 2))
    pen = cut_penalties(raw)
    ok = np.flatnonzero(np.isfinite(pen))
    if len(ok) < 2 or np.diff(ok).max() + min(overlap + 12, limit // 2 + 6) > limit:
        pen[~np.isfinite(pen)] = 50.0  # an indivisible unit as long as the limit
        ok = np.arange(n + 1)
    want = ok - overlap
    j = np.searchsorted(ok, want)
    hi, lo = ok[np.minimum(j, len(ok) - 1)], ok[np.maximum(j - 1, 0)]
    begin = np.maximum(np.where(np.abs(lo - want) <= np.abs(hi - want), lo, hi), 0)  # start of a piece whose own part begins at ok
    begin = np.minimum(begin, ok)
    begin[0] = 0
    pieces = max(1, int(np.ceil((n - overlap) / max(1, limit - overlap))))
    cand = every = np.arange(len(ok))
    if near > 0 and len(ok) > 2:
        # moving a cut by d bytes changes the imbalance by d over the mean at most, so no place is needed that has a better one
        # so near that this makes up for less than the difference of penalties
        slope = REACH * pieces / n
        down, up = pen[ok] - slope * ok, pen[ok] + slope * ok
        least = np.minimum(np.minimum.accumulate(down) + slope * ok, np.minimum.accumulate(up[::-1])[::-1] - slope * ok)
        cand = np.unique(np.r_[0, np.flatnonzero(pen[ok] <= least + 1e-12), len(ok) - 1])
    program = lambda c: _cheapest(ok[c], begin[c], pen[ok[c]], limit, n / pieces)
    cuts = program(cand)
    if cuts is None and len(cand) < len(every):  # too few for this limit
        cand, cuts = every, program(every)
    if len(cand) < len(every):
        # once more over all places near the cuts found, as the limit may keep a cut from its best place
        at = ok[cand[cuts]]
        lo, hi = np.searchsorted(ok, at - near), np.searchsorted(ok, at + near, "right")
        cand = np.unique(np.concatenate([np.r_[0, len(ok) - 1], *(np.arange(a, b) for a, b in zip(lo, hi))]))
        cuts = program(cand)
    pos, frm = ok[cand], begin[cand]
    return [(int(frm[a]), int(pos[b]), int(pos[a] - frm[a])) for a, b in zip(cuts, cuts[1:])]


def _cheapest(pos: np.ndarray, frm: np.ndarray, cost: np.ndarray, limit: int, mean: float) -> list[int] | None:
    """The cuts, as numbers of places, with the least sum of costs and imbalance; None if no way keeps to the limit.

    A piece that ends at pos[i] and whose own part begins at pos[a] takes the bytes from frm[a] on. Places are worked
    off in runs much shorter than a piece: what comes from before the run is found for all its places at once, and
    places within the run are tried one by one only where so short a piece could pay.
    """
    m = len(pos)
    total, back = np.full(m, np.inf), np.full(m, -1)
    total[0] = 0.0
    first = np.searchsorted(frm, pos - limit)  # frm ascends with pos
    i = 1
    while i < m:
        to = min(i + RUN, int(np.searchsorted(pos, pos[i] + mean / 8, "right")))
        lo = int(first[i])
        if lo < i:
            t = total[lo:i] + BALANCE * ((pos[i:to, None] - pos[lo:i]) / mean - 1.0) ** 2
            t[np.arange(lo, i) < first[i:to, None]] = np.inf
            k = np.argmin(t, axis=1)
            best = t[np.arange(to - i), k]
            total[i:to], back[i:to] = best + cost[i:to], np.where(np.isfinite(best), lo + k, -1)
        short = BALANCE * (1.0 - (pos[to - 1] - pos[i]) / mean) ** 2
        if not (total[i:to].min() + short >= (total[i:to] - cost[i:to]).max()):
            for j in range(i + 1, to):
                a = max(i, int(first[j]))
                if a < j:
                    t = total[a:j] + BALANCE * ((pos[j] - pos[a:j]) / mean - 1.0) ** 2
                    k = int(np.argmin(t))
                    if t[k] + cost[j] < total[j]:
                        total[j], back[j] = t[k] + cost[j], a + k
        i = to
    if not np.isfinite(total[-1]):
        return None
    cuts = [m - 1]
    while cuts[-1] > 0:
        cuts.append(int(back[cuts[-1]]))
    return cuts[::-1]


_OUT = "run_id bigint, shard_id string, data_structure string, max_bytes bigint, piece int, n_pieces int, start_byte bigint, end_byte bigint, shared_bytes bigint, text string"


def _run(batches):
    for batch in batches:
        cols = batch.to_pydict()
        rows = []
        for run, shard, data, kind, limit, overlap in zip(cols["run_id"], cols["shard_id"], cols["data"], cols["data_structure"], cols["max_bytes"], cols["overlap_bytes"]):
            raw = data.encode()
            got = split(raw, limit, overlap)
            rows += [(run, shard, kind, limit, k + 1, len(got), a, b, s, raw[a:b].decode("utf-8", "replace")) for k, (a, b, s) in enumerate(got)]
        names = [x.split()[0] for x in _OUT.split(", ")]
        types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[x.split()[1]]) for i, x in enumerate(_OUT.split(", "))], names)


def oversized(shards: DataFrame, docs: DataFrame, limits: DataFrame) -> DataFrame:
    """(run_id, shard_id, data, data_structure, max_bytes, overlap_bytes) of each stored shard over its limit, once.

    The scan drops what is within every limit before anything is shuffled. Null data, runs without doc_meta and
    data_structures without a limit (null or below 1) give no rows; a null overlap counts as 0.
    """
    lim = limits.where("data_structure is not null and max_bytes > 0").groupBy("data_structure").agg(F.min("max_bytes").alias("max_bytes"), F.coalesce(F.min("overlap_bytes"), F.lit(0)).alias("overlap_bytes"))
    least = lim.agg(F.min("max_bytes")).first()[0]
    big = shards.select("run_id", "shard_id", "data").where(F.octet_length("data") > (least if least is not None else 1 << 62))
    kinds = docs.groupBy("run_id").agg(F.min("data_structure").alias("data_structure")).join(lim, "data_structure")
    return big.join(kinds, "run_id").where(F.octet_length("data") > F.col("max_bytes")).dropDuplicates(["run_id", "shard_id"])


def split_shards(shards: DataFrame, docs: DataFrame, limits: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Numbered pieces of each oversized shard: (run_id, shard_id, data_structure, max_bytes, piece, n_pieces, start_byte, end_byte, shared_bytes, text[, original_path])."""
    rows = oversized(shards, docs, limits).select("run_id", "shard_id", "data", "data_structure", "max_bytes", "overlap_bytes")
    # work is by the byte and heavy, so it is spread more widely than shuffled bytes would ask for, in step with the scan
    parts = SPREAD * max(1, shards.rdd.getNumPartitions())
    out = rows.repartition(parts, "run_id", "shard_id").mapInArrow(_run, _OUT)
    if meta is None:
        return out
    return out.join(meta.groupBy("run_id", "shard_id").agg(F.min("original_path").alias("original_path")), ["run_id", "shard_id"], "left")
