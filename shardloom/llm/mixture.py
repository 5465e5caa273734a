"""Mixing sources to target weights.

Method: cube-method balanced sampling. Every document of a source has the same expected number of copies; its whole
part is given outright, the fraction is an inclusion probability. In the flight phase, three probabilities at a time
move along the null space of the two constraints (number of documents, number of tokens) until one of them is 0 or 1,
so both totals stay exact; blocks of bounded size fly on their own, what they leave flies again in larger blocks, and
the at most two units left for a source are landed on the side that misses the token total least.
"""

from __future__ import annotations

from math import ceil
from random import Random

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import cut, map_groups
from .tokens import count_tokens

#: Documents that fly together; a block leaves at most two.
BLOCK = 4096
_EPS = 1e-9


def plan(available: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Expected copies of each document by source, from tokens by source and (target share, most repeats) by source.

    Without a total, the largest is taken at which every source that has tokens still reaches its share of the whole
    (shares of sources without any are divided among the others in proportion). With a total, sources that are too
    small give all they may and the rest is filled by the others in proportion to their shares, up to their own caps.
    """
    have = {s: (w, r, available[s]) for s, (w, r) in targets.items() if w > 0 and r > 0 and available.get(s, 0) > 0}
    if not have:
        return {}
    if total is None:
        scale = sum(w for w, _, _ in have.values())
        total = min(r * a * scale / w for w, r, a in have.values())
    want: dict[str, float] = {}
    free, rest = dict(have), float(total)
    while free:
        scale = sum(w for w, _, _ in free.values())
        full = {s for s, (w, r, a) in free.items() if rest * w / scale >= r * a}
        if not full:
            want |= {s: rest * w / scale for s, (w, _, _) in free.items()}
            break
        for s in full:
            _, r, a = free.pop(s)
            want[s] = float(r * a)
            rest -= r * a
    return {s: t / have[s][2] for s, t in want.items()}


def _fly(p: list[float], x: list[int], rng: Random) -> None:
    """Flight phase in place: at most two probabilities stay inside (0, 1)."""
    held: list[int] = []
    for i in range(len(p)):
        if _EPS < p[i] < 1 - _EPS:
            held.append(i)
        while len(held) >= 3:
            a, b, c = held[-3:]
            u = (x[c] - x[b], x[a] - x[c], x[b] - x[a])
            if not any(u):
                u = (1, -1, 0)
            up = down = float("inf")
            for k, v in zip((a, b, c), u):
                if v > 0:
                    up, down = min(up, (1 - p[k]) / v), min(down, p[k] / v)
                elif v < 0:
                    up, down = min(up, -p[k] / v), min(down, (p[k] - 1) / v)
            move = up if rng.random() * (up + down) < down else -down
            for k, v in zip((a, b, c), u):
                q = p[k] + move * v
                p[k] = 0.0 if q < _EPS else 1.0 if q > 1 - _EPS else q
            held[-3:] = [k for k in (a, b, c) if 0 < p[k] < 1]


def _land(p: list[float], x: list[int]) -> None:
    """Round the last units so that the tokens missed are least, then the documents missed."""
    left = [i for i in range(len(p)) if 0 < p[i] < 1]
    best = min(range(1 << len(left)), key=lambda m: (abs(sum(((m >> k & 1) - p[i]) * x[i] for k, i in enumerate(left))), abs(sum((m >> k & 1) - p[i] for k, i in enumerate(left)))))
    for k, i in enumerate(left):
        p[i] = float(best >> k & 1)


def _flight(seed: int, last: bool):
    def f(t: pa.Table) -> pa.Table:
        src, blk, ids, x, p = (t.column(c).to_pylist() for c in ("source", "block", "doc_id", "tokens", "p"))
        order = sorted(range(len(p)), key=lambda i: (src[i], blk[i], ids[i] is not None, ids[i]))
        at = 0
        while at < len(order):
            to = at
            while to < len(order) and (src[order[to]], blk[order[to]]) == (src[order[at]], blk[order[at]]):
                to += 1
            group = order[at:to]
            q, y = [p[i] for i in group], [x[i] for i in group]
            _fly(q, y, Random(f"{seed}/{src[group[0]]}/{blk[group[0]]}/{last}"))
            if last:
                _land(q, y)
            for i, v in zip(group, q):
                p[i] = v
            at = to
        return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

    return f


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 7, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(mixture, sizes): documents with `copies` > 0, and what was available of each source.

    docs: doc_id, source, tokens. targets: source, target_share, max_repeats; repeated rows count once, rows without
    source, share or repeats are left out. Documents of other or null sources and documents without tokens are not
    used; empty tables give no rows. Only the totals of the target's sources come to the driver.
    """
    goal = targets.select("source", "target_share", "max_repeats").where("source is not null and target_share is not null and max_repeats is not null").distinct()
    used = cut(docs.select("doc_id", "source", F.coalesce("tokens", F.lit(0)).alias("tokens")).join(goal.select("source").distinct(), "source", "left_semi"))
    sizes = goal.join(used.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("available")), "source", "left").fillna(0, ["documents", "available"])
    facts = sizes.collect()
    copies = plan({r.source: r.available for r in facts}, {r.source: (r.target_share, r.max_repeats) for r in facts}, total)
    schema = "source string, block bigint, doc_id {}, tokens bigint, base bigint, p double".format(docs.schema["doc_id"].dataType.simpleString())
    if not copies:
        return docs.select("doc_id", "source", "tokens").where(F.lit(False)).withColumn("copies", F.lit(0).cast("bigint")), sizes
    units = {r.source: r.documents for r in facts}
    facts_map = F.create_map(*(F.lit(v) for s, c in copies.items() for v in (s, c)))
    blocks = {s: ceil(units[s] / block) for s in copies}
    spread = lambda b: F.create_map(*(F.lit(v) for s, n in b.items() for v in (s, n)))
    pi = facts_map[F.col("source")]
    flying = used.where("tokens > 0").where(pi.isNotNull()).select("source", F.pmod(F.xxhash64("doc_id"), spread(blocks)[F.col("source")].cast("bigint")).alias("block"), "doc_id", "tokens", F.floor(pi + _EPS).alias("base"), F.greatest(F.lit(0.0), pi - F.floor(pi + _EPS)).alias("p"))
    done = None
    while True:
        last = max(blocks.values()) == 1
        out = cut(map_groups(flying, ["source", "block"], _flight(seed, last), schema))
        inside = F.col("p").between(_EPS, 1 - _EPS)
        landed = out if last else out.where(~inside)
        done = landed if done is None else done.unionByName(landed)
        if last:
            break
        blocks = {s: ceil(n * 2 / block) for s, n in blocks.items()}
        flying = out.where(inside).withColumn("block", F.pmod(F.col("block"), spread(blocks)[F.col("source")].cast("bigint")))
    result = done.select("doc_id", "source", "tokens", (F.col("base") + F.round("p").cast("bigint")).alias("copies")).where("copies > 0")
    return result, sizes


def shares(mixture: DataFrame, sizes: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, available, used_documents, tokens, actual_share, binding) by source of the target; shares of an empty mixture are null.

    binding: whether all that the source has is used as often as it may be, so that it holds the size of the mixture down.
    """
    got = mixture.groupBy("source").agg(F.count("*").alias("used_documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    rows = sizes.join(got, "source", "left").fillna(0, ["used_documents", "tokens"])
    whole = F.sum("tokens").over(Window.partitionBy())  # over the sources of the target, not over documents
    return rows.select("source", "target_share", "max_repeats", "documents", "available", "used_documents", "tokens", (F.col("tokens") / F.when(whole > 0, whole)).alias("actual_share"), ((F.col("available") > 0) & (F.col("tokens") >= F.col("available") * F.col("max_repeats"))).alias("binding"))


def mixture(documents: DataFrame, targets: DataFrame, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """`mix` over documents with texts, their sizes in tokens of the public tokenizer; texts of other sources are not encoded."""
    names = targets.select("source").distinct()
    rows = documents.select("doc_id", "source", "text").join(names, "source", "left_semi")
    return mix(count_tokens(rows.select("doc_id", "source", "text")), targets, total)
