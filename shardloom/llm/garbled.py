"""Text that was decoded with the wrong character encoding: finding it and restoring it.

Method: adjacent character pairs are scored by corpus mutual information, maximum-scoring segments isolate the
improbable runs, and inverse mappings are tried only inside those runs. Plain mutual information is high for garbled
pairs, as their characters occur with each other only; its cubic form, log p(ab)^3 / (p(a) p(b)), ranks pairs by how
usual they are as well, so it is what scores here. An inverse mapping is accepted by what it restores: valid sequences
of the encoding the text was written in, made of pairs that the corpus knows better than those of the garbled run.
"""

from __future__ import annotations

import codecs
import html
import re
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import cut

#: Pairs with at least this share of all counted pairs are told apart; so the model has at most a million pairs at any size of the corpus.
LEAST_SHARE = 1e-6
#: Characters that the model tells apart, the most frequent of those pairs.
SYMBOLS = 8192
#: Information in bits of a pair that the model doesn't know.
FLOOR = 20.0
#: A pair is improbable if its cubic mutual information is below a bound by script: for Greek and Cyrillic, and for the wide
#: scripts of East Asia, that of the least probable twentieth of all pairs of the script, else a fixed one, as garbled
#: text itself makes up much of those pairs. Score of a pair of ASCII characters. Least score of a segment by script.
THRESHOLD, RARE, ASCII_SCORE = -12.0, 0.03, -3.0
LEAST_SCORE, MARK_SCORE = (0.0, 12.0, 16.0), 16.0

#: Encodings that bytes are read in by mistake, with one byte a character and with several (fixed values).
SINGLE = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r", "cp866")
MULTI = ("gbk", "cp932", "big5", "euc_jp")
#: (read in, written in) other than UTF-8 (fixed values).
LEGACY = (
    ("cp1252", "gbk"), ("latin-1", "gbk"), ("cp1252", "cp932"), ("latin-1", "cp932"), ("cp1252", "euc_jp"), ("latin-1", "euc_jp"), ("cp1252", "big5"), ("latin-1", "big5"),
    ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("cp1252", "koi8_r"), ("latin-1", "koi8_r"), ("cp1252", "cp866"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("koi8_r", "cp866"), ("cp866", "koi8_r"), ("cp1251", "mac_cyrillic"), ("cp1252", "iso8859_5"), ("cp1251", "iso8859_5"), ("latin-1", "iso8859_5"),
    ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp1250", "cp1252"), ("cp1252", "cp1250"), ("cp1252", "mac_roman"), ("latin-1", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp850"), ("latin-1", "cp850"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp437"),
    ("big5", "gbk"), ("gbk", "big5"), ("cp932", "gbk"), ("gbk", "cp932"), ("euc_jp", "gbk"), ("gbk", "euc_jp"), ("cp932", "euc_jp"), ("euc_jp", "cp932"), ("big5", "cp932"), ("cp932", "big5"), ("cp1251", "gbk"), ("cp1251", "cp932"), ("cp1251", "euc_jp"),
)
#: Stand-ins for a lost byte and for a character that the code page doesn't have.
_LOST, _OTHER = 0x1A, 0x1B
_SEQ = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf\x1a]|[\xe1-\xef](?:[\x80-\xbf][\x80-\xbf\x1a]|\x1a[\x80-\xbf])|[\xf0-\xf4][\x80-\xbf]{2}[\x80-\xbf\x1a]|[\xe1-\xef][\x80-\xbf]")
#: A few characters outside ASCII, without Latin letters of ASCII, that fill a pair of quotation marks of their own.
_EXAMPLE = re.compile(r"(?<![\x80-\u04ff\u2000-\u2bff])([“„«‘‚‹\"']\s?|[「『])(?=[^A-Za-z]*[^\x00-\x7f])([^A-Za-z\s“”„«»「」『』\"]{1,8}?)(\s?[”“»’‘›\"']|[」』])(?![\x80-\u04ff\u2000-\u2bff])")


def _keep(e: UnicodeError):
    """Bytes of what the code page cannot hold: controls stand for themselves, the replacement character for a lost byte."""
    out = bytes(o if 0x80 <= (o := ord(c)) <= 0x9F else _LOST if o == 0xFFFD else _OTHER for c in e.object[e.start : e.end])
    return out, e.end


codecs.register_error("shardloom.keep", _keep)


def _table(read: str) -> np.ndarray:
    """Byte of each code point below 65536 in a code page of single bytes."""
    t = np.full(0x10000, _OTHER, np.uint8)
    t[0x80:0xA0] = np.arange(0x80, 0xA0)
    for k in range(256):
        try:
            t[ord(bytes([k]).decode(read))] = k
        except UnicodeDecodeError:
            pass
    t[:128] = np.arange(128)
    t[0xFFFD] = _LOST
    return t


_TABLES = {r: _table(r) for r in SINGLE}
_WRITTEN = {r: [w for q, w in LEGACY if q == r] for r in (*SINGLE, *MULTI)}


# corpus statistics


def _points(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts of a batch, and where each text ends."""
    text = pc.fill_null(text, "")
    ends = np.cumsum(pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
    joined = "".join(text.to_pylist())
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), ends


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inverse, np.concatenate(counts), len(k)).astype(np.int64)


def _count_pairs(batches):
    keys, counts, held = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            x, ends = _points(batch.column(0).slice(at, 1000))
            if len(x) < 2:
                continue
            odd = x > 127
            take = odd[:-1] | odd[1:]
            take[ends[(ends > 0) & (ends < len(x))] - 1] = False
            i = np.flatnonzero(take)
            k, n = np.unique(x[i].astype(np.int64) << 21 | x[i + 1], return_counts=True)
            keys.append(k), counts.append(n)
            held += len(k)
            if held > 2_000_000:
                k, n = _merge(keys, counts)
                keys, counts, held = [k], [n], 0
    if keys:
        k, n = _merge(keys, counts)
        for at in range(0, len(k), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array((k[part] >> 21).astype(np.int32)), pa.array((k[part] & 0x1FFFFF).astype(np.int32)), pa.array(n[part])], ["a", "b", "n"])


def pair_counts(docs: DataFrame) -> DataFrame:
    """(a, b, n): adjacent pairs of code points of all texts with at least one outside ASCII; counted by task before the shuffle."""
    return docs.select("text").where("text is not null").mapInArrow(_count_pairs, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def script(points: np.ndarray) -> np.ndarray:
    """2 for wide scripts, 1 for Greek and Cyrillic, else 0."""
    return np.where(points >= 0x2E80, 2, np.where((points >= 0x370) & (points < 0x530), 1, 0))


class Model:
    """Information of pairs (bits, joint) and of characters by side, in a dense table of the model's symbols."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, total: int):
        self.total = max(int(total), 1)
        points, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
        weight = np.bincount(inverse, np.concatenate([n, n]), len(points))
        keep = np.sort(np.argsort(-weight, kind="stable")[: SYMBOLS - 1])
        number = np.zeros(len(points) + 1, np.int64)
        number[keep] = np.arange(1, len(keep) + 1)
        self.points, self.codes = points, number
        ia, ib = number[inverse[: len(a)]], number[inverse[len(a) :]]
        size = len(keep) + 1
        info = -np.log2(n / self.total)
        self.lookup = np.zeros(0x110000, np.uint16)
        self.lookup[points] = number[:-1]
        self.info = np.full((size, size), FLOOR, np.float16)
        ok = (ia > 0) & (ib > 0)
        self.info[ia[ok], ib[ok]] = np.minimum(info[ok], FLOOR)
        left, right = np.bincount(ia, n, size), np.bincount(ib, n, size)
        with np.errstate(divide="ignore"):
            self.left, self.right = (np.minimum(-np.log2(v / self.total), FLOOR).astype(np.float32) for v in (left, right))
        self.left[0] = self.right[0] = FLOOR
        self.bounds = np.full(3, THRESHOLD, np.float32)
        kind = np.maximum(script(a), script(b))
        cubic = (-3 * np.minimum(info, FLOOR) + self.left[ia] + self.right[ib]).astype(np.float32)
        for k in (1, 2):
            at = np.flatnonzero(kind == k)
            if len(at):
                order = at[np.argsort(cubic[at], kind="stable")]
                mass = np.cumsum(n[order])
                self.bounds[k] = min(THRESHOLD, cubic[order[np.searchsorted(mass, RARE * mass[-1])]])
        self.closed = np.zeros((size, size), bool)
        shut = ok & (kind < 2) & ~self._may_be_garbled(a, b, info)
        self.closed[ia[shut], ib[shut]] = True
        self.marked = np.zeros((size, size), bool)
        seen = np.zeros(0x110000, np.int64)
        seen[points] = weight
        mark = ok & self._is_sequence(a, b, n, seen)
        self.marked[ia[mark], ib[mark]] = True
        self.cache: dict[str, tuple] = {}
        # from which information on a pair counts as unknown, in small corpora those met once or twice; up to which as well known
        self.rare = min(FLOOR - 0.5, float(np.log2(self.total)) - 1.1)
        self.usual = min(FLOOR, float(np.log2(self.total))) - 1.5

    def _may_be_garbled(self, a: np.ndarray, b: np.ndarray, info: np.ndarray) -> np.ndarray:
        """Whether some inverse mapping makes of the pair a part of a UTF-8 sequence, of a double-byte character, or a pair that is known better.

        A garbled run has at least one such pair, so the others needn't be looked at one by one in every text.
        """
        low_a, low_b = np.minimum(a, 0xFFFF), np.minimum(b, 0xFFFF)
        odd = lambda x: ((x >= 0x80) & (x < 0xA0)) | (x == 0xFFFD)
        may = odd(a) | odd(b)
        for read, table in _TABLES.items():
            ra, rb = table[low_a], table[low_b]
            may |= (ra >= 0xC2) & (ra <= 0xF4) & (((rb & 0xC0) == 0x80) | (rb == _LOST))
            has = (ra != _OTHER) & (rb != _OTHER)
            if any(w in MULTI for w in _WRITTEN[read]):
                may |= has & (a > 127) & (b > 127) & (info > 11)
            for written in _WRITTEN[read]:
                if written not in MULTI:
                    back = np.array([ord(bytes([k]).decode(written, "replace")) for k in range(256)])
                    a2, b2 = np.where(ra != _OTHER, back[ra], a), np.where(rb != _OTHER, back[rb], b)
                    may |= ((a2 != a) | (b2 != b)) & (info - self.info[self.lookup[a2], self.lookup[b2]] >= 2)
        return may

    @staticmethod
    def _is_sequence(a: np.ndarray, b: np.ndarray, n: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Whether the pair is a UTF-8 sequence, read in a code page, of a character that is more frequent than the pair: a sign however often it occurs.

        So is the beginning of a sequence of three, unless its second character is punctuation, if the characters that
        begin so are four times as frequent as the pair and more frequent than that second character.
        """
        mark = np.zeros(len(a), bool)
        sums = np.r_[0, np.cumsum(seen)]
        points, at = np.unique(b, return_inverse=True)
        letter = np.array([unicodedata.category(chr(x))[0] != "P" for x in points.tolist()], bool)[at] & (b > 127)
        for table in _TABLES.values():
            ra, rb = table[np.minimum(a, 0xFFFF)], table[np.minimum(b, 0xFFFF)]
            code = (ra.astype(np.int64) & 0x1F) << 6 | (rb & 0x3F)
            mark |= (ra >= 0xC2) & (ra <= 0xDF) & ((rb & 0xC0) == 0x80) & (b > 127) & (seen[code] > 2 * n)
            first = (ra.astype(np.int64) & 0x0F) << 12 | (rb.astype(np.int64) & 0x3F) << 6
            mark |= (ra >= 0xE1) & (ra <= 0xEF) & ((rb & 0xC0) == 0x80) & letter & (sums[first + 64] - sums[first] > np.maximum(4 * n, seen[b]))
        return mark

    def pairs(self, s: str) -> np.ndarray:
        """Information of the pairs of `s` that touch a character outside ASCII."""
        x = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(x) < 2:
            return np.zeros(0)
        odd = x > 127
        c = self.lookup[np.minimum(x, 0x10FFFF)]
        return self.info[c[:-1], c[1:]][odd[:-1] | odd[1:]].astype(np.float64)


def model_arrays(pairs: DataFrame) -> tuple:
    """The model's pairs on the driver: at most 1 / LEAST_SHARE of them, whatever the size of the corpus."""
    pairs = cut(pairs)
    total = pairs.agg(F.sum("n")).first()[0] or 0
    kept = pairs.where(F.col("n") >= total * LEAST_SHARE).toArrow()
    return (*(kept.column(c).to_numpy() for c in ("a", "b", "n")), total)


# segments


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence of scores, over its runs of equal sign."""
    if not len(scores):
        return []
    sign = scores > 0
    edge = np.r_[0, np.flatnonzero(sign[1:] != sign[:-1]) + 1, len(scores)]
    sums = np.add.reduceat(scores, edge[:-1])
    held: list[list[float]] = []  # start, end, sum before, sum after
    total = 0.0
    for k, s in enumerate(sums.tolist()):
        if s <= 0:
            total += s
            continue
        new = [int(edge[k]), int(edge[k + 1]), total, total + s]
        total += s
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j -= 1
            if j < 0 or held[j][3] >= new[3]:
                held.append(new)
                break
            new = [held[j][0], new[1], held[j][2], new[3]]
            del held[j:]
    return [(int(a), int(b), z - y) for a, b, y, z in held]


# inverse mappings


def _utf8(run: str, raw: bytes, read: str) -> tuple[str, int, int, int] | None:
    """(restored, sequences, lost ones, bytes outside ASCII that are in none) of a run whose bytes in `read` are `raw`."""
    single = read in _TABLES
    found = lost = covered = at = 0
    out = []
    for m in _SEQ.finditer(raw):
        b = m.group()
        try:
            new = b.decode()
        except UnicodeDecodeError:
            lost, new = lost + 1, "\ufffd"
        else:
            found += 1
        covered += len(b) - (new == "\ufffd")
        out += [run[at : m.start()] if single else raw[at : m.start()].decode(read, "replace"), new]
        at = m.end()
    if not found:
        return None
    out.append(run[at:] if single else raw[at:].decode(read, "replace"))
    rest = sum(c > 127 for c in raw) - covered
    return "".join(out), found, lost, max(0, rest)


def _other(run: str, raw: bytes, read: str, written: str) -> str:
    """The run with what `read` can hold decoded as `written`, the rest as it is."""
    if read not in _TABLES or _OTHER not in raw:
        return raw.decode(written, "replace").replace(chr(_LOST), "\ufffd").replace(chr(_OTHER), "\ufffd")
    out, at = [], 0
    for m in re.finditer(rb"\x1b+", raw):
        out += [raw[at : m.start()].decode(written, "replace").replace(chr(_LOST), "\ufffd"), run[m.start() : m.end()]]
        at = m.end()
    return "".join([*out, raw[at:].decode(written, "replace").replace(chr(_LOST), "\ufffd")])


def _judge(run: str, model: Model) -> tuple[str, str, str, bool] | None:
    """(restored, read in, written in, whole) of the best accepted inverse mapping of a run with its neighbours, or None.

    From UTF-8: most of the bytes lie in valid sequences, and what they restore is known to the corpus and needs fewer
    bits than the garbled run. From another encoding: nearly all restored pairs are known, and have clearly fewer bits
    each than those of the garbled run.
    """
    before = model.pairs(run)
    if not len(before):
        return None
    x = np.frombuffer(run.encode("utf-32-le", "surrogatepass"), np.uint32)
    odd = x > 127
    wide = float((x[odd] >= 0x2E80).mean())
    best, score = None, 0.0
    mean, total, unknown = float(before.mean()), float(before.sum()), int((before > model.rare).sum())
    raws: dict[str, bytes] = {}
    seen = set()
    for read in (*SINGLE, *MULTI):
        if read in _TABLES:
            if wide > 0.9:
                continue
            code = _TABLES[read][np.minimum(x, 0xFFFF)]
            if float((code[odd] != _OTHER).mean()) < 0.4:
                continue
            raw = code.tobytes()
        else:
            if wide < 0.3:
                continue
            raw = run.encode(read, "shardloom.keep")
            if raw.count(_OTHER) * 3 > len(run):
                continue
        raws[read] = raw
        if raw in seen:
            continue
        seen.add(raw)
        got = _utf8(run, raw, read)
        if got is None:
            continue
        new, found, lost, rest = got
        after = model.pairs(new)
        known = float((after < FLOOR - 0.5).mean()) if len(after) else 1.0
        share = (found + lost) / (found + lost + rest / 2)
        gain = total - float(after.sum())
        ok = share >= 0.6 and gain > 6 and known >= 0.5 if read in _TABLES else found >= 2 and share >= 0.75 and known >= 0.6 and gain > 12
        if ok or (found >= 3 and found + lost >= 8 and share >= 0.8):
            value = gain + 40 * share - 8 * lost
            if best is None or value > score:
                best, score = (new, read, "utf-8", lost == 0 and rest == 0), value
    if best is not None:
        return best
    for read, raw in raws.items():
        for written in _WRITTEN[read]:
            new = _other(run, raw, read, written)
            if new == run:
                continue
            after = model.pairs(new)
            if not len(after):
                continue
            known = float((after < FLOOR - 0.5).mean())
            lower = mean - float(after.mean())
            lost = new.count("\ufffd")
            if written in MULTI:
                ok = (len(after) >= 4 and known >= 0.7 and lower >= 1.5 and lost * 8 <= len(after)) or (len(after) == 3 and known == 1 and lower >= 4)
            else:
                ok = known >= 0.8 and (lower >= 3.5 if len(after) >= 8 else lower >= 4 and mean > FLOOR - 5 and float(after.max()) < FLOOR - 2)
                # a few characters in a word or a formula: nothing that the corpus doesn't know is left of several such pairs
                ok = ok or (unknown >= 2 and float(after.max()) <= model.usual and total - float(after.sum()) >= 3 and not _SIGN_IN_WORD.search(new))
            if ok:
                value = lower * len(before) - 10 * lost
                if best is None or value > score:
                    best, score = (new, read, written, lost == 0), value
    return best or _lost_tail(run, before, unknown, model)


#: A sign other than an apostrophe or hyphen within a word.
_SIGN_IN_WORD = re.compile(r"[A-Za-z](?![’‐‑–·])[^\x00-\x7f\w][A-Za-z]")
#: Punctuation of three bytes that begin with 0xE2 (fixed values), which is all that is left where the others were dropped.
_PUNCTUATION = "“”’‘–—…•™€"


def _lost_tail(run: str, before: np.ndarray, unknown: int, model: Model) -> tuple[str, str, str, bool] | None:
    """The run with the punctuation that fits best for each lone first byte of it, if the corpus knows all pairs then."""
    if "\u00e2" not in run or not unknown:
        return None
    new = list(run)
    for i, c in enumerate(run):
        if c == "\u00e2":
            new[i] = min(_PUNCTUATION, key=lambda x: float(model.pairs("".join(new[max(0, i - 1) : i]) + x + run[i + 1 : i + 2]).sum()))
    text = "".join(new)
    after = model.pairs(text)
    ok = len(after) and float(after.max()) <= model.usual and float(before.mean() - after.mean()) >= 4
    return (text, "latin-1", "utf-8", False) if ok else None


#: Least number of pairs of a run whose lost bytes are made up for, and least share of them that the corpus must know then.
_LONG, _KNOWN = 30, 0.25


def _lost_heads(run: str, model: Model) -> bool:
    """Whether a long run is Japanese text of which bytes were dropped: unknown to the corpus, it is known in part with the byte of hiragana before each of its characters; or, known or not, as far as its bytes still go together."""
    before = model.pairs(run)
    if len(before) < _LONG:
        return False
    x = np.frombuffer(run.encode("utf-32-le", "surrogatepass"), np.uint32)
    raw = _TABLES["cp1252"][np.minimum(x, 0xFFFF)]
    if _OTHER not in raw:
        after = model.pairs(raw.tobytes().decode("cp932", "replace"))
        if len(after) * 4 >= len(before) and float((after < FLOOR - 0.5).mean()) >= 2 * _KNOWN:
            return True
    if float((before > FLOOR - 0.5).mean()) < 0.6:
        return False
    kana = "".join(bytes([0x82, ord(c)]).decode("cp932", "replace") if "\x9f" <= c <= "\xf1" else c for c in run)
    after = model.pairs(kana)
    return float((after < FLOOR - 0.5).mean()) >= _KNOWN


def judge(run: str, model: Model):
    """`_judge`, kept by run as runs repeat all over a corpus, and applied again as long as the result can be restored further."""
    if run in model.cache:
        return model.cache[run]
    got = first = _judge(run, model)
    for _ in range(3):
        if got is None or got[2] != "utf-8":
            break
        again = _judge(got[0], model)
        if again is None or again[2] != "utf-8":
            break
        got = (again[0], first[1], "utf-8", got[3] and again[3])
    if len(run) < 200:
        if len(model.cache) > 200_000:
            model.cache.clear()
        model.cache[run] = got
    return got


def examine(text: str, segments: list[tuple[int, int, float]], model: Model) -> tuple[list[tuple[int, int, str]], int, bool, str, str] | None:
    """(replacements, runs, whole, read in, written in) of a text with garbled runs, else None; segments are of pairs.

    A replacement (start, end, text) covers only what its run and the restored text don't have in common at their ends.
    """
    spans: list[list[int]] = []
    n = len(text)
    for a, b, total in segments:
        b += 1  # pairs to characters
        top = max(text[a:b])
        if total < LEAST_SCORE[2 if top >= "\u2e80" else 1 if any("\u0370" <= c < "\u0530" for c in text[a:b]) else 0] and not _GONE.search(text, a, b):
            continue
        while a > 0 and ord(text[a]) > 127 and ord(text[a - 1]) > 127:
            a -= 1
        while b < n and ord(text[b - 1]) > 127 and ord(text[b]) > 127:
            b += 1
        a, b = max(0, a - (ord(text[a]) > 127)), min(n, b + (ord(text[b - 1]) > 127))
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    out, runs, whole, kind = [], 0, True, None
    for a, b in spans:
        for a, b, got in _parts(text, a, b, model):
            if got is not None:
                out.append(_differing(text, a, b, got[0]))
                runs, whole, kind = runs + 1, whole and got[3], kind if kind and kind[0] else got[1:3]
            else:
                runs, whole, kind = runs + 1, False, kind or ("", "")
    if not runs:
        return None
    return out, runs, whole, *kind


def _differing(text: str, a: int, b: int, new: str) -> tuple[int, int, str]:
    """The replacement of text[a:b] by `new` without what both begin and end with."""
    head = 0
    while a + head < b and head < len(new) and text[a + head] == new[head]:
        head += 1
    tail = 0
    while b - tail > a + head and len(new) - tail > head and text[b - tail - 1] == new[-tail - 1]:
        tail += 1
    return a + head, b - tail, new[head : len(new) - tail]


#: Stretches of one kind of script, white space and ASCII between included.
_SCRIPT = re.compile(r"[\u2e80-\uffef](?:[^\x80-\u2e7f\n]*[\u2e80-\uffef])?|[\u0370-\u052f](?:[^\x80-\u036f\u0530-\uffff\n]*[\u0370-\u052f])?|[\x80-\u036f\u0530-\u2e7f](?:[^\u0370-\u052f\u2e80-\uffff\n]*[\x80-\u036f\u0530-\u2e7f])?")


#: What no text that was decoded rightly holds: the sign of a lost byte, and controls above ASCII but for the line end among them.
_GONE = re.compile("[\ufffd\x80-\x84\x86-\x9f]")


def _parts(text: str, a: int, b: int, model: Model):
    """Accepted parts of text[a:b]: the whole, else its lines, else their stretches of one script; and what holds lost bytes."""
    got = judge(text[a:b], model)
    if got is not None:
        yield a, b, got
        return
    cuts = [a, *(i + 1 for i in range(a, b) if text[i] == "\n"), b]
    for c, d in zip(cuts, cuts[1:]):
        if d - c < 2:
            continue
        got = judge("\n" * (c > a) + text[c:d], model) if len(cuts) > 2 else None
        if got is not None:
            yield c, d, (got[0].removeprefix("\n"), *got[1:]) if c > a else got
            continue
        m = _SCRIPT.search(text, c, d)
        if m and (m.start() > c + 1 or m.end() < d - 1):
            hit = False
            while m:
                e, f = max(c, m.start() - 1), min(d, m.end() + 1)
                got = judge(text[e:f], model)
                if got is not None:
                    hit = True
                    yield e, f, got
                c = max(c, f) if got is not None else c
                m = _SCRIPT.search(text, max(m.end(), c), d)
            if hit:
                continue
        if _GONE.search(text, c, d) or _lost_heads(text[c:d], model):
            yield c, d, None


_OUT = "doc_id {}, restored string, runs int, whole boolean, read_as string, written_as string"


def _scan(batches, shared):
    global _MODEL
    if _MODEL is None or _MODEL[0] != shared.id:
        _MODEL = (shared.id, Model(*shared.value))
    model = _MODEL[1]
    for batch in batches:
        rows = []
        for at in range(0, batch.num_rows, 500):
            ids, given = batch.column(0).slice(at, 500), batch.column(1).slice(at, 500).to_pylist()
            # characters spelt as references count as the characters, but stay as they are spelt outside garbled runs
            opened = [open_references(t) if t and "&" in t and ";" in t else (t or "", None) for t in given]
            texts = [t for t, _ in opened]
            x = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
            ends = np.cumsum([len(t) for t in texts])
            if len(x) < 2:
                continue
            odd = x > 127
            touch = np.flatnonzero(odd[:-1] | odd[1:])
            c = model.lookup[x]
            score = np.full(len(x), ASCII_SCORE, np.float32)
            a, b = c[touch], c[touch + 1]
            cubic = -3 * model.info[a, b].astype(np.float32) + model.left[a] + model.right[b]
            kind = script(x)
            score[touch] = np.where(model.closed[a, b], ASCII_SCORE, np.clip(model.bounds[np.maximum(kind[touch], kind[touch + 1])] - cubic, -8, 8))
            score[touch[model.marked[a, b]]] = MARK_SCORE
            lost = np.flatnonzero((x == 0xFFFD) | ((x >= 0x80) & (x < 0xA0) & (x != 0x85)))
            score[lost] = 8
            score[ends[ends > 0] - 1] = -1e6  # a pair over the end of a text
            doc_of = np.searchsorted(ends, np.flatnonzero(score > 0), "right")
            for d in np.unique(doc_of).tolist():
                base = int(ends[d - 1]) if d else 0
                got = probe(texts[d], score[base : int(ends[d]) - 1], model)
                if got is not None:
                    rows.append((ids[d].as_py(), put(given[d], opened[d][1], *got[:2]), *got[2:]))
        if rows:
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())], ["doc_id", "restored", "runs", "whole", "read_as", "written_as"])


def probe(text: str, score: np.ndarray, model: Model):
    """(text as examined, *`examine`) over the maximal segments of the scores of the text's pairs, with quoted examples blanked out."""
    quoted = [(m.start(), m.end()) for m in _EXAMPLE.finditer(text)]
    if quoted:
        score = score.copy()
        blank = list(text)
        for a, b in quoted:
            score[max(0, a - 1) : b] = ASCII_SCORE
            blank[a:b] = _BLANK * (b - a)
        if not (score > 0).any():
            return None
        text = "".join(blank)
    got = examine(text, maximal_segments(score), model)
    return None if got is None else (text, *got)


#: Stands for the characters of quoted examples while a text is examined.
_BLANK = "\x01"
_REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")


def open_references(text: str) -> tuple[str, np.ndarray | None]:
    """The text with characters instead of their references, and where each of its characters (and its end) lies in the given one; None where all stay in place."""
    parts, places, at = [], [], 0
    for m in _REFERENCE.finditer(text):
        new = html.unescape(m.group())
        if new == m.group():
            continue
        parts += [text[at : m.start()], new]
        places += [np.arange(at, m.start()), np.full(len(new), m.start())]
        at = m.end()
    if not parts:
        return text, None
    return "".join([*parts, text[at:]]), np.concatenate([*places, np.arange(at, len(text) + 1)])


def _sparing(seen: str, place: np.ndarray, a: int, b: int, new: str):
    """A replacement cut up so that references within it that it leaves as they are stay as they are spelt."""
    if int(place[b] - place[a]) == b - a or _BLANK in new:
        yield a, b, new
        return
    for op, i, j, k, m in SequenceMatcher(None, seen[a:b], new, autojunk=False).get_opcodes():
        if op != "equal":
            yield a + i, a + j, new[k:m]


def put(given: str, place: np.ndarray | None, seen: str, replacements: list[tuple[int, int, str]]) -> str:
    """The given text with the replacements, whose places are those of the text as examined; nothing else is changed."""
    where = (lambda i: i) if place is None else (lambda i: int(place[i]))
    if place is not None:
        replacements = [x for r in replacements for x in _sparing(seen, place, *r)]
    out, at = [], 0
    for a, b, new in replacements:
        if _BLANK in new:
            held = iter([i for i in range(a, b) if seen[i] == _BLANK])
            new = re.sub(_BLANK, lambda m: "" if (i := next(held, None)) is None else given[where(i) : where(i + 1)], new)  # noqa: B023
        out += [given[at : where(a)], new]
        at = where(b)
    return "".join([*out, given[at:]])


_MODEL: tuple | None = None


class _Shared:
    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast.id if hasattr(broadcast, "id") else id(broadcast)

    @property
    def value(self):
        return self.broadcast.value


def restore(docs: DataFrame) -> DataFrame:
    """(doc_id, restored, runs, whole, read_as, written_as) of the documents with garbled text.

    restored: the text with its garbled runs put right and nothing else changed, U+FFFD for what is lost; whole: nothing was lost. Null, empty and blank texts, texts that only quote garbled sequences,
    dropped or decomposed accents and broken formulas give no rows. Two maps over the scan: counts of pairs over all
    texts, then the search with the model broadcast, which is bounded by LEAST_SHARE and not by the corpus.
    """
    rows = docs.select("doc_id", "text").where("text is not null")
    shared = _Shared(docs.sparkSession.sparkContext.broadcast(model_arrays(pair_counts(docs))))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: _scan(b, shared), _OUT.format(kind))
