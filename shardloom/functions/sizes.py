"""Size rules as column expressions. All stay in whole-stage code generation; sizes are UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
SCHEMA_BYTES, WRAP_BYTES, OVERHEAD_SHARE, OVERHEAD_BYTES, METADATA_BYTES = 228, 22, 0.08, 64, 300
FILL = 0.85


def _c(x: str | int | float | Column) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def whole(x: Column) -> Column:
    return F.floor(x).cast("bigint")


def compact_size(json: str | Column) -> Column:
    """Bytes of a document's compact text; null for what is no JSON text."""
    return F.octet_length(F.to_json(F.try_parse_json(_c(json)))).cast("bigint")


def string_size(text: str | Column) -> Column:
    """Bytes of a bare string: quotes around it, quotes and backslashes in it escaped, other escapes not counted."""
    t = _c(text)
    marks = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    return (F.octet_length(t) + 2 + marks('"') + marks("\\")).cast("bigint")


def scalar_size(value: str | Column, kind: str | Column) -> Column:
    """Bytes of a bare scalar by its kind (str, int, float, bool, NoneType): null 4, true 5 and false 4 the wrong way round."""
    v, k = _c(value), _c(kind)
    return F.when((k == "NoneType") | v.isNull(), 4).when(k == "bool", F.when(v == "true", 5).otherwise(4)).when(k == "str", string_size(v)).otherwise(F.octet_length(v)).cast("bigint")


def with_overhead(b: str | Column) -> Column:
    """b, eight hundredths of it and a constant on top."""
    b = _c(b)
    return b + whole(b * OVERHEAD_SHARE) + OVERHEAD_BYTES


def schema_size(compact: str | Column, metadata: str | int | Column = METADATA_BYTES) -> Column:
    """Compact bytes of a shard file: data, metadata and the two keys around them."""
    return _c(compact) + _c(metadata) + WRAP_BYTES


def file_size(nested: str | Column) -> Column:
    """Estimated bytes of a shard file from the formatted size of its data one level deep."""
    return with_overhead(_c(nested) + SCHEMA_BYTES)


def metadata_size(meta: str | Column) -> Column:
    """Compact bytes of a metadata record, null links included."""
    return F.octet_length(F.to_json(_c(meta), {"ignoreNullFields": "false"})).cast("bigint")


def shard_estimate(total: str | Column, limit: int | Column, spare: float = 0.2) -> Column:
    """Shards needed if each is filled up to the spare share, at least one."""
    return F.greatest(F.lit(1), F.ceil(_c(total) / whole(_c(limit) * (1 - spare)))).cast("bigint")


def plain_estimate(spaced: str | Column, limit: int | Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(_c(spaced) / _c(limit))).cast("bigint")


def will_exceed(current: str | Column, new: str | Column, limit: int | Column) -> Column:
    """Whether a shard of `current` bytes, `new` ones and metadata would pass the limit; unknown sizes do."""
    return F.coalesce(with_overhead(_c(current) + _c(new) + METADATA_BYTES) > _c(limit), F.lit(True))


def memory_estimate_mb(size: str | Column) -> Column:
    """Five times the bytes and a fifth as margin, in whole MB; unknown sizes give -1 / 1024 as a double would, 0 here."""
    return whole(_c(size) * 5 / 1048576 * 1.2)


def chunk_size(first_item: str | Column, chunk: int = 92160, target_mb: int = 512) -> Column:
    """Chunk size adapted to the size of the first element: whole elements for a third of the target, within half and twice `chunk`."""
    s = _c(first_item)
    items = F.greatest(F.lit(1), whole(F.lit(target_mb * 1048576) / (s * 3)))
    return F.when(s > 0, F.least(F.lit(chunk * 2), F.greatest(F.lit(chunk // 2), items * s))).otherwise(F.lit(chunk)).cast("bigint")


def room(limit: int) -> tuple[int, int]:
    """(usable bytes, bytes to fill) of a limit: less the reserve of its class, and 85 % of that."""
    reserve = 0.08 if limit >= 90000 else 0.10 if limit >= 50000 else 0.15
    usable = limit - int(limit * reserve)
    return usable, int(usable * FILL)


def opens_new(current: Column, new: Column, limit: int, policy: str = "fill") -> Column:
    """Whether an item goes to a new chunk. Policies: fill (85 % of the usable bytes), tight (nine tenths of the limit), plain (the limit)."""
    usable, fill = room(limit)
    total = current + new
    if policy == "fill":
        return ((total > fill) & (current > 0)) | (total > usable)
    return (current > 0) & (total > (limit * 0.9 if policy == "tight" else limit))


def efficiency(total: str | Column, n: str | Column, target: int = 25000) -> Column:
    """Share of the target size that shards fill on average; may exceed one."""
    return F.when(_c(n) > 0, _c(total) / (_c(n) * target)).otherwise(0.0)


def is_oversized(size: str | Column, limit: int | Column) -> Column:
    """Whether a shard is over a limit; unknown sizes are not."""
    return F.coalesce(_c(size) > _c(limit), F.lit(False))


def is_large(total: str | Column, threshold: int = 10 << 20) -> Column:
    """Whether a document counts as large; unknown sizes do not."""
    return is_oversized(total, threshold)


def escaped_length(json: str | Column) -> Column:
    """Characters of a JSON text if all but ASCII were written as escapes: six a character, twelve beyond the basic plane."""
    t = _c(json)
    odd, far = F.length(F.regexp_replace(t, r"[\x00-\x7F]", "")), F.length(F.regexp_replace(t, r"[\x00-\x{FFFF}]", ""))
    return (F.length(t) + 5 * odd + 6 * far).cast("bigint")


def limit_issue(limit: str | Column) -> Column:
    """What is wrong with a size limit in bytes: error if it is not positive, warning if very small (below 1 KB) or very large (above 100 MB), else null; unknown limits are errors."""
    v = _c(limit)
    return F.when(v.isNull() | (v <= 0), "error").when((v < 1024) | (v > 100 << 20), "warning")
