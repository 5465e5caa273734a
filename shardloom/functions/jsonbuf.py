"""Structural index of JSON texts over Arrow buffers.

All texts of a batch are tokenised and checked against RFC 8259 at once by array kernels over their common byte
buffer; no row is parsed on its own. Containers know their parent by index, so keys and pointers are propagated from
level to level by `take`.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OBJ, ARR, OBJ_END, ARR_END, COMMA, COLON, STR, SCALAR = (ord(c) for c in '{[}],:"0')
_NUMBER = r"^(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)$"
_CONSTANT = _NUMBER.replace("null", "null|NaN|-?Infinity")
_SPACE = " \t\n\r"
_KIND = np.full(256, 3, np.uint8)  # 0 white space, 1 structural, 2 quote, 3 scalar
_KIND[[ord(c) for c in _SPACE]] = 0
_KIND[[OBJ, ARR, OBJ_END, ARR_END, COMMA, COLON]] = 1
_KIND[STR] = 2
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_ESC = np.zeros(256, bool)
_ESC[[ord(c) for c in '"\\/bfnrtu']] = True


def open_strings(texts: pa.Array) -> pa.Array:
    """Texts that are one JSON string holding the JSON text of an object or array are replaced by that text."""
    first = pc.binary_slice(pc.cast(pc.ascii_ltrim(texts, characters=_SPACE), pa.large_binary()), 0, 1)
    at = np.flatnonzero(pc.fill_null(pc.equal(first, pa.scalar(b'"', pa.large_binary())), False).to_numpy(zero_copy_only=False))
    if not len(at):
        return texts
    new = []
    for x in texts.take(pa.array(at)).to_pylist():
        try:
            inner = json.loads(x)
        except (ValueError, RecursionError):
            inner = ""
        new.append(inner.encode("utf-8", "replace").decode() if inner.lstrip(_SPACE)[:1] in ("{", "[") else x)
    mask = np.zeros(len(texts), bool)
    mask[at] = True
    return pc.replace_with_mask(texts, pa.array(mask), pa.array(new, texts.type))


def _slices(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte slices [start, end) as one binary array, copied by a single gather."""
    size = end - start
    off = np.concatenate([[0], np.cumsum(size)])
    data = buf[np.repeat(start - off[:-1], size) + np.arange(off[-1])] if off[-1] else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def unescape(raw: pa.Array) -> pa.Array:
    """Contents of JSON strings from the bytes between their quotes; half surrogate pairs become '?'."""
    text = pc.cast(raw, pa.large_string())
    odd = np.flatnonzero(pc.match_substring(text, "\\").to_numpy(zero_copy_only=False))
    if not len(odd):
        return text
    mask = np.zeros(len(text), bool)
    mask[odd] = True
    plain = [json.loads(f'"{x}"').encode("utf-8", "replace").decode() for x in text.take(pa.array(odd)).to_pylist()]
    return pc.replace_with_mask(text, pa.array(mask), pa.array(plain, pa.large_string()))


class Index:
    """Tokens of the valid texts among `texts` (a large_string array; nulls count as invalid).

    valid: by row. Tokens: pos, typ, row, level (of the container they lie in; of their own for brackets), up (token of
    the enclosing opener, -1 at the root), end (end of strings and scalars). Members of an object whose name comes
    again later are dropped with all below them, as the last one holds. constants: NaN and Infinity count as numbers.
    """

    def __init__(self, texts: pa.Array, constants: bool = False):
        texts = pc.fill_null(texts, "")
        n_rows = len(texts)
        off = np.frombuffer(texts.buffers()[1], np.int64, n_rows + 1, texts.offset * 8)
        base, total = int(off[0]), int(off[-1] - off[0])
        off = off - base
        data = texts.buffers()[2]
        buf = np.frombuffer(data, np.uint8, total, base) if data is not None and total else np.zeros(0, np.uint8)
        self.buf = buf
        bad = off[1:] == off[:-1]
        row_at = lambda p: np.searchsorted(off, p, "right") - 1
        # escapes
        quote = buf == STR
        slash = np.flatnonzero(buf == ord("\\"))
        starters = np.zeros(0, np.int64)
        if len(slash):
            srow = row_at(slash)
            new = np.ones(len(slash), bool)
            new[1:] = (slash[1:] != slash[:-1] + 1) | (srow[1:] != srow[:-1])
            i = np.arange(len(slash))
            k = i - np.maximum.accumulate(np.where(new, i, 0))
            pick = (k % 2 == 0) & (slash + 1 < off[srow + 1])
            starters, srow = slash[pick], srow[pick]
            quote[starters + 1] = False
        qpos = np.flatnonzero(quote)
        qrow = row_at(qpos)
        odd = np.bincount(qrow, minlength=n_rows) % 2 == 1
        bad |= odd
        if odd.any():
            keep = ~odd[qrow]
            qpos, qrow = qpos[keep], qrow[keep]
        opens, closes = qpos[0::2], qpos[1::2]
        turn = np.zeros(total + 1, np.int8)
        turn[opens] = 1
        turn[closes + 1] -= 1
        inside = np.cumsum(turn[:total], dtype=np.int8).view(bool)  # with both quotes
        kind = _KIND[buf]
        ctrl = np.flatnonzero(inside & (buf < 32))
        if len(ctrl):
            bad[row_at(ctrl)] = True
        if len(starters):
            nxt = buf[starters + 1]
            wrong = ~inside[starters] | ~_ESC[nxt]
            u = np.flatnonzero(nxt == ord("u"))
            if len(u):
                s, short = starters[u], starters[u] + 5 >= off[srow[u] + 1]
                at = np.minimum(s, max(total - 6, 0))
                wrong[u] |= short | ~(_HEX[buf[at + 2]] & _HEX[buf[at + 3]] & _HEX[buf[at + 4]] & _HEX[buf[at + 5]])
            bad[srow[wrong]] = True
        scalar = (kind == 3) & ~inside
        first = scalar.copy()
        first[1:] &= ~scalar[:-1]
        last = scalar.copy()
        last[:-1] &= ~scalar[1:]
        cutoff = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < total)]
        first[cutoff] |= scalar[cutoff]
        last[cutoff - 1] |= scalar[cutoff - 1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(begin):
            words = _slices(buf, begin, end)
            ok = pc.match_substring_regex(words, _CONSTANT if constants else _NUMBER).to_numpy(zero_copy_only=False)
            if not ok.all():
                bad[row_at(begin[~ok])] = True
        mark = (kind == 1) & ~inside
        mark[opens] = True
        mark |= first
        pos = np.flatnonzero(mark)
        typ = buf[pos].copy()
        typ[first[pos]] = SCALAR
        close = np.zeros(len(pos), np.int64)
        close[typ == STR] = closes + 1
        close[typ == SCALAR] = end
        row = row_at(pos)
        # brackets balance
        delta = np.isin(typ, (OBJ, ARR)).astype(np.int32) - np.isin(typ, (OBJ_END, ARR_END))
        depth = np.cumsum(delta)
        seen = np.zeros(n_rows, bool)
        seen[row] = True
        bad |= ~seen
        if len(pos):
            heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            before = np.where(heads > 0, depth[heads - 1], 0)
            low = np.minimum.reduceat(depth, heads)
            total_of = np.add.reduceat(delta, heads)
            bad[row[heads[(low < before) | (total_of != 0)]]] = True
        pos, typ, row, close = (x[~bad[row]] for x in (pos, typ, row, close))
        self._link(pos, typ, row, close)
        bad[self.row[self._wrong()]] = True
        ok = ~bad[self.row]
        if not ok.all():
            self._link(*(x[ok] for x in (self.pos, self.typ, self.row, self.end)))
        self.valid = ~bad
        self.alive = self._last_members()

    def _link(self, pos, typ, row, close) -> None:
        n = len(pos)
        opener, closer = (typ == OBJ) | (typ == ARR), (typ == OBJ_END) | (typ == ARR_END)
        level = np.cumsum(opener.astype(np.int32) - closer)
        level[closer] += 1
        by = np.argsort(level.astype(np.int16) if n and level.max() < 32000 else level, kind="stable")
        inner = by[np.maximum.accumulate(np.where(opener[by], np.arange(n), 0))] if n else by
        own = np.full(n, -1, np.int64)
        own[by] = inner
        own[level == 0] = -1
        heads = by[opener[by]]
        up = own
        if len(heads):
            key = level[heads].astype(np.int64) * (n + 1) + heads
            want = (level[heads].astype(np.int64) - 1) * (n + 1) + heads
            at = np.searchsorted(key, want) - 1
            up = own.copy()
            up[heads] = np.where(level[heads] > 1, heads[np.maximum(at, 0)], -1)
        self.pos, self.typ, self.row, self.end, self.level, self.own, self.up, self.opener = pos, typ, row, close, level, own, up, opener
        nxt = np.zeros(n, np.uint8)
        nxt[:-1] = np.where(row[1:] == row[:-1], typ[1:], 0)
        self.key = (typ == STR) & (nxt == COLON)

    def _wrong(self) -> np.ndarray:
        """Tokens that may not stand where they stand, judged by the token before and the enclosing container."""
        typ, row = self.typ, self.row
        n = len(typ)
        prev = np.zeros(n, np.uint8)
        prev[1:] = np.where(row[1:] == row[:-1], typ[:-1], 0)
        enc = np.where(self.up >= 0, typ[np.maximum(self.up, 0)], 0)
        mine = np.where(self.own >= 0, typ[np.maximum(self.own, 0)], 0)
        ended = np.isin(prev, (STR, SCALAR, OBJ_END, ARR_END))
        value = ~self.key & np.isin(typ, (STR, SCALAR, OBJ, ARR))
        good = np.select(
            [self.key, value & (enc == OBJ), value & (enc == ARR), value, typ == COLON, typ == COMMA, typ == OBJ_END],
            [(enc == OBJ) & ((prev == OBJ) | (prev == COMMA)), prev == COLON, (prev == ARR) | (prev == COMMA), prev == 0, prev == STR, (self.level > 0) & ended, (mine == OBJ) & ((prev == OBJ) | ended)],
            (mine == ARR) & ((prev == ARR) | ended),
        )
        return ~good

    def names(self, tokens: np.ndarray) -> pa.Array:
        """Names or contents of the string tokens."""
        return unescape(_slices(self.buf, self.pos[tokens] + 1, self.end[tokens] - 1))

    def _last_members(self) -> np.ndarray:
        """Openers that are no member, nor lie in a member, whose name comes again in the same object."""
        alive = self.opener.copy()
        heads = np.flatnonzero(self.opener & (self.up >= 0))
        if not len(heads):
            return alive
        holds = np.zeros(len(self.typ), bool)
        holds[self.up[heads]] = True
        keys = np.flatnonzero(self.key)
        keys = keys[holds[self.up[keys]]]
        if not len(keys):
            return alive
        code = self.names(keys).dictionary_encode().indices.to_numpy()
        pair = self.up[keys] * (int(code.max()) + 1) + code
        order = np.argsort(pair, kind="stable")
        again = np.flatnonzero(pair[order][1:] == pair[order][:-1])
        if not len(again):
            return alive
        dead = np.zeros(len(self.typ), bool)
        dead[keys[order[again]] + 2] = True
        dead &= self.opener
        for lv in range(2, int(self.level.max()) + 1):
            at = heads[self.level[heads] == lv]
            dead[at] |= dead[self.up[at]]
        return alive & ~dead

    def positions(self, heads: np.ndarray) -> np.ndarray:
        """Element numbers of openers that lie in arrays: the commas of the array before them."""
        n = len(self.typ) + 1
        commas = np.flatnonzero(self.typ == COMMA)
        key = np.sort(self.level[commas].astype(np.int64) * n + commas)
        lv = (self.level[heads].astype(np.int64) - 1) * n
        return np.searchsorted(key, lv + heads) - np.searchsorted(key, lv + self.up[heads])


def flatten(texts: pa.Array, every: bool = False) -> dict[str, pa.Array | np.ndarray]:
    """The objects of the texts that are direct elements of arrays (every: all objects), level by level.

    row: position in `texts`; child_ptr: JSON Pointer; parent_ptr: that of the nearest enclosing object of the same
    choice, or ''; table_path (every only): child_ptr with element numbers replaced by *; token: for `fields`; index: the Index.
    """
    x = Index(open_strings(texts))
    heads = np.flatnonzero(x.alive)
    up = x.up[heads]
    in_array = (up >= 0) & (x.typ[np.maximum(up, 0)] == ARR)
    case = (x.typ[heads] == OBJ) & (in_array | every)
    slash = pa.scalar("/", pa.large_string())
    # only what leads to a case needs a pointer
    need = np.zeros(len(x.typ), bool)
    need[heads[case]] = True
    levels = x.level[heads]
    top = int(levels.max()) if len(heads) else 0
    by_level = [heads[levels == lv] for lv in range(1, top + 1)]
    for at in reversed(by_level[1:]):
        at = at[need[at]]
        need[x.up[at]] = True
    is_case = np.zeros(len(x.typ), bool)
    is_case[heads[case]] = True
    slot = np.zeros(len(x.typ), np.int64)
    rows, tokens, children, parents, tables = [], [], [], [], []
    above = above_case = above_table = None
    for lv, at in enumerate(by_level, 1):
        at = at[need[at]]
        if not len(at):
            break
        slot[at] = np.arange(len(at))
        if lv == 1:
            ptr = pa.array([""] * len(at), pa.large_string())
            near = table = ptr
        else:
            up = x.up[at]
            arr = x.typ[up] == ARR
            seg = np.zeros(len(at), np.int64)
            order = np.r_[np.flatnonzero(arr), np.flatnonzero(~arr)]
            seg[order] = np.arange(len(at))
            number = pc.cast(pa.array(x.positions(at[arr])), pa.large_string())
            name = pc.replace_substring(pc.replace_substring(x.names(at[~arr] - 2), "~", "~0"), "/", "~1")
            step = pa.concat_arrays([number, name]).take(pa.array(seg))
            take = pa.array(slot[up])
            ptr_up = above.take(take)
            ptr = pc.binary_join_element_wise(ptr_up, step, slash)
            table = pc.binary_join_element_wise(above_table.take(take), pc.if_else(pa.array(arr), pa.scalar("*", pa.large_string()), step), slash) if every else ptr
            near = pc.if_else(pa.array(is_case[up]), ptr_up, above_case.take(take))
        hit = np.flatnonzero(is_case[at])
        if len(hit):
            pick = pa.array(hit)
            rows.append(x.row[at[hit]]), tokens.append(at[hit]), children.append(ptr.take(pick)), parents.append(near.take(pick)), tables.append(table.take(pick))
        above, above_case, above_table = ptr, near, table
    if not rows:
        none = pa.array([], pa.large_string())
        return {"row": np.zeros(0, np.int64), "token": np.zeros(0, np.int64), "child_ptr": none, "parent_ptr": none, "table_path": none, "index": x}
    return {"row": np.concatenate(rows), "token": np.concatenate(tokens), "child_ptr": pa.concat_arrays(children), "parent_ptr": pa.concat_arrays(parents), "table_path": pa.concat_arrays(tables), "index": x}


def fields(x: Index, objects: np.ndarray) -> pa.Array:
    """For each object token a map of its own scalar members, name to JSON text; of repeated names the last holds."""
    keys = np.flatnonzero(x.key)
    val = keys + 2
    code = x.names(keys).dictionary_encode() if len(keys) else None
    if code is not None:
        pair = x.up[keys] * (len(code.dictionary) + 1) + code.indices.to_numpy()
        order = np.argsort(pair, kind="stable")
        lastone = np.ones(len(keys), bool)
        lastone[order[:-1]] = pair[order][1:] != pair[order][:-1]
        pick = np.flatnonzero(lastone & ~x.opener[val])
    else:
        pick = np.zeros(0, np.int64)
    rank = np.full(len(x.typ) + 1, -1, np.int64)
    rank[objects] = np.arange(len(objects))
    owner = rank[x.up[keys[pick]]]
    pick, owner = pick[owner >= 0], owner[owner >= 0]
    order = np.argsort(owner, kind="stable")
    pick = pick[order]
    start = np.searchsorted(owner[order], np.arange(len(objects) + 1))
    names = pc.cast(x.names(keys[pick]), pa.string())
    values = pc.cast(_slices(x.buf, x.pos[val[pick]], x.end[val[pick]]), pa.string())
    return pa.MapArray.from_arrays(pa.array(start.astype(np.int32)), names, values)
