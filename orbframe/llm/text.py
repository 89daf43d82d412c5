"""Whole texts as flat arrays: what the operators of this package share inside a task."""

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that separate words: space and \x09 to \x0d.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: A task looks at about so many bytes of text at once; one longer document is looked at whole.
CHUNK = 1 << 20
#: Rows in an Arrow batch; at a few KB a text, a batch is a few MB on either side.
BATCH = 1000
_MULTIPLIER = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240607).integers(0, 2**64, 256, np.uint64)
_powers = {}


def mix(h):
    """Spread a 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int):
    """``b**i`` and ``b**-i`` modulo 2**64, for i up to ``n``."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        size = -(-(n + 1) // CHUNK) * CHUNK
        inverse = pow(_MULTIPLIER, -1, 2**64)
        for name, base in (("up", _MULTIPLIER), ("down", inverse)):
            a = np.full(size + 1, base, np.uint64)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def span_hasher(values):
    """A function that gives a 64-bit hash of ``values[s:e]`` for each span; ``values`` are uint64."""
    up, down = powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return lambda starts, ends: mix((sums[ends] - sums[starts]) * down[starts] + np.uint64(1) * (ends - starts).astype(np.uint64))


def hash_spans(values, starts, ends):
    """A 64-bit hash of ``values[s:e]`` for each span; ``values`` are uint64."""
    return span_hasher(values)(starts, ends)


def flat(column):
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def chunks(column, limit: int = CHUNK):
    """``(first, last, bytes, offsets)`` of runs of rows with about ``limit`` bytes."""
    data, at = flat(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last
    release()


def release() -> None:
    """Hand freed memory back: idle Python workers share an executor's limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def words(data, at):
    """Start and end of each word, and the number of the first word of each row (and of all)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~SPACE[data]
    new = np.zeros(len(data) + 1, bool)
    new[at] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | new[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | new[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hasher(data, lower: bool = False):
    """A function that gives the hashes of words of ``data`` from their starts and ends."""
    table = _TABLE
    if lower:
        table = table.copy()
        table[65:91] = table[97:123]
    return span_hasher(table[data])


def word_hashes(data, starts, ends, lower: bool = False):
    return word_hasher(data, lower)(starts, ends)


def gram_hashes(hashes, k: int):
    """Hash of ``k`` consecutive values, for each start (across rows as well)."""
    n = max(0, len(hashes) - k + 1)
    i = np.arange(n)
    return hash_spans(hashes, i, i + k)


def fixed_hashes(data, k: int):
    """Hash of ``k`` consecutive bytes, for each start, by doubling."""
    h, length = _TABLE[data], 1
    while length * 2 <= k:
        factor = np.uint64(pow(_MULTIPLIER, length, 2**64) | 1)
        h = mix(h[:-length] * factor + h[length:]) if len(h) > length else h[:0]
        length *= 2
    n = max(0, len(data) - k + 1)
    return mix(h[:n] * np.uint64(3) + h[k - length : k - length + n]) if length < k else h[:n]


def sliding_min(values, w: int):
    """Minimum of ``w`` consecutive values, for each start."""
    m, length = values, 1
    while length * 2 <= w:
        m = np.minimum(m[:-length], m[length:]) if len(m) > length else m[:0]
        length *= 2
    n = max(0, len(values) - w + 1)
    return np.minimum(m[:n], m[w - length : w - length + n]) if length < w else m[:n]


def rows_of(at):
    """Row number of each element, from the rows' offsets."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def plain(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, to be handed to Python in small batches."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
