"""Node tables of JSON documents, built from the structural index of a batch, with all sizes in closed form.

Sizes are UTF-8 bytes of three ways to write a value: compact (no spaces), spaced (one space after `,` and `:`) and
formatted (indented by two). The latter two follow from the compact size and the numbers of children of the non-empty
containers below, so they are differences of prefix sums over the tokens.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .jsonbuf import ARR, ARR_END, COMMA, OBJ, OBJ_END, SCALAR, STR, Index, _slices

SCHEMA = (
    "doc_id string, node bigint, parent bigint, depth int, kind string, scalar_type string, key string, pos int, path array<string>, n_children bigint, "
    "compact_size bigint, spaced_size bigint, formatted_size bigint, nested_size bigint, raw string, in_list boolean, sampled boolean"
)


def strict_parse(text: str | None) -> tuple[object, str | None, str | None]:
    """(value, error type, message) of a text: blank or malformed texts are SYNTAX errors, scalars at the root STRUCTURE errors."""
    if text is None or not text.strip():
        return None, "SYNTAX", "JSON string is empty"
    try:
        v = json.loads(text)
    except RecursionError:
        return None, "STRUCTURE", "nested too deeply to parse"
    except json.JSONDecodeError as e:
        return None, "SYNTAX", f"{e.msg} (line {e.lineno}, column {e.colno})"
    if not isinstance(v, (dict, list)):
        return v, "STRUCTURE", f"Root element must be dict or list, got {type(v).__name__}"
    return v, None, None


#: Writers made once, with and without sorting; every value written is a tree, so cycles needn't be looked for.
_WRITE = {sort: json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), sort_keys=sort, check_circular=False).encode for sort in (False, True)}


def compact(value: object, sort: bool = False) -> str:
    """Compact JSON text, keys in code point order if asked for; half surrogate pairs become '?'."""
    text = _WRITE[sort](value)
    if text.isascii():
        return text
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode()


def compact_bytes(value: object) -> int:
    """UTF-8 bytes of the compact text."""
    text = _WRITE[False](value)
    return len(text) if text.isascii() else len(text.encode("utf-8", "replace"))


def node_table(doc_ids: pa.Array, texts: pa.Array, raw: bool = False) -> pa.Table:
    """One row for each value of each document in pre-order; `texts` in compact form, invalid ones give no rows.

    nested_size: formatted size of the value one level deep, as below the data key of a shard file. raw: JSON text of
    scalars, or of all values if asked for. in_list: whether a list is above; sampled: whether the value lies within the
    first five elements of every list above.
    """
    x = Index(pc.cast(texts, pa.large_string()), True)
    typ, n = x.typ, len(x.typ)
    value = ~x.key & np.isin(typ, (STR, SCALAR, OBJ, ARR))
    at = np.flatnonzero(value)
    m = len(at)
    # end token of containers, children by container
    opener = x.opener
    closer = np.flatnonzero((typ == OBJ_END) | (typ == ARR_END))
    last = np.arange(n)
    last[x.own[closer]] = closer
    up = x.up[at]
    kids = np.bincount(up[up >= 0], minlength=n) if m else np.zeros(n, np.int64)
    end = np.where(opener[at], x.pos[last[at]] + 1, x.end[at])
    size = end - x.pos[at]
    full = opener & (kids > 0)
    is_obj = typ == OBJ
    spaced = np.where(full, kids - 1 + np.where(is_obj, kids, 0), 0)
    depth = x.level.astype(np.int64) - opener  # depth of the value a token begins
    lines = np.where(full, kids * (1 + 2 * (depth + 1)) + 1 + 2 * depth + np.where(is_obj, kids, 0), 0)
    shift = np.where(full, 2 * (kids + 1), 0)
    add = lambda v: np.r_[0, np.cumsum(v)]
    sum_of = lambda v: (c := add(v))[last[at] + 1] - c[at]
    d = depth[at]
    formatted = size + sum_of(lines) - d * sum_of(shift)
    nested = formatted + sum_of(shift)
    # numbers within the document, parents, keys
    row = x.row[at]
    number = np.full(n + 1, -1, np.int64)
    first = np.r_[True, row[1:] != row[:-1]] if m else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(m), 0)) if m else np.zeros(0, np.int64)
    number[at] = np.arange(m)
    parent = np.where(up >= 0, number[np.maximum(up, 0)], -1)
    in_obj = (up >= 0) & is_obj[np.maximum(up, 0)]
    in_arr = (up >= 0) & ~in_obj
    # element numbers: commas of the container before the value
    commas = np.flatnonzero(typ == COMMA)
    width = n + 1
    ckey = np.sort(x.level[commas].astype(np.int64) * width + commas)
    lv = (d[in_arr]) * width
    index = np.searchsorted(ckey, lv + at[in_arr]) - np.searchsorted(ckey, lv + up[in_arr])
    pos = np.zeros(m, np.int32)
    pos[in_arr] = index
    names = x.names(at[in_obj] - 2) if in_obj.any() else pa.array([], pa.large_string())
    labels = pc.binary_join_element_wise(pa.scalar("[", pa.large_string()), pc.cast(pa.array(index), pa.large_string()), pa.scalar("]", pa.large_string()), pa.scalar("", pa.large_string())) if in_arr.any() else pa.array([], pa.large_string())
    order = np.zeros(m, np.int64)
    order[np.flatnonzero(in_obj)] = np.arange(in_obj.sum())
    order[np.flatnonzero(in_arr)] = in_obj.sum() + np.arange(in_arr.sum())
    pool = pa.concat_arrays([pc.cast(names, pa.large_string()), labels])
    # paths by parent traversal
    off = np.r_[0, np.cumsum(d)]
    ids = np.zeros(off[-1], np.int64)
    slot, cur, low = off[1:] - 1, np.arange(m), off[:-1]
    go = slot >= low
    slot, cur, low = slot[go], cur[go], low[go]
    while len(cur):
        ids[slot] = order[cur]
        slot, cur = slot - 1, parent[cur]
        go = slot >= low
        slot, cur, low = slot[go], cur[go], low[go]
    path = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pc.cast(pool.take(pa.array(ids)), pa.string()))
    # below a list; within the first five elements of every list above
    inside, early = in_arr.copy(), ~in_arr | (pos < 5)
    for level in range(1, int(d.max()) + 1 if m else 0):
        q = np.flatnonzero(d == level)
        inside[q] |= inside[parent[q]]
        early[q] &= early[parent[q]]
    kind = np.where(is_obj[at], "dict", np.where(typ[at] == ARR, "list", "primitive")).astype(object)
    byte = x.buf[x.pos[at]]
    stype = np.full(m, None, object)
    stype[typ[at] == STR] = "str"
    sc = typ[at] == SCALAR
    stype[sc & np.isin(byte, (ord("t"), ord("f")))] = "bool"
    stype[sc & (byte == ord("n"))] = "NoneType"
    number_like = sc & ~np.isin(byte, (ord("t"), ord("f"), ord("n")))
    if number_like.any():
        q = np.flatnonzero(number_like)
        frac = pc.match_substring_regex(_slices(x.buf, x.pos[at[q]], x.end[at[q]]), "[.eENI]").to_numpy(zero_copy_only=False)
        stype[q] = np.where(frac, "float", "int")
    take = np.arange(m) if raw else np.flatnonzero(~opener[at])
    text = np.full(m, -1, np.int64)
    text[take] = np.arange(len(take))
    raws = pc.cast(_slices(x.buf, x.pos[at[take]], end[take]), pa.string()).take(pa.array(text, mask=text < 0))
    keys = pc.cast(pool, pa.string()).take(pa.array(order, mask=~in_obj))
    cols = [
        doc_ids.take(pa.array(row)), pa.array(np.arange(m) - start), pa.array(parent - start, mask=parent < 0), pa.array(d.astype(np.int32)), pa.array(kind, pa.string()), pa.array(stype, pa.string()),
        keys, pa.array(pos, mask=~in_arr), path, pa.array(kids[at].astype(np.int64)), pa.array(size), pa.array(size + sum_of(spaced)), pa.array(formatted), pa.array(nested), raws, pa.array(inside), pa.array(early),
    ]
    return pa.table(cols, [c.split()[0] for c in SCHEMA.split(", ")])
