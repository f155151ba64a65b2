"""Vectorised text primitives over Arrow string columns.

Everything works on UTF-8 bytes: the separators used here are ASCII, so byte and
character tokenisation agree. Arrow batches are cut into slices of bounded bytes
before numpy arrays are derived from them, so memory follows the slice (or one
very long text), not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
#: Bytes of text after which a worker hands freed memory back to the system.
RELEASE_BYTES = 4 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_ORDER = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n, skip = len(column), column.offset
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[skip : skip + n + 1] if n else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Hand freed memory back: workers are reused, and what an idle one holds its executor lacks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_learned: dict[str, Callable[[], None]] = {}


def keep_learned(owner: str, forget: Callable[[], None]) -> None:
    """What a worker has learned for one operator stays from task to task until another operator's texts come."""
    _learned[owner] = forget


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, owner: str | None = None) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch, each with at most ``limit`` bytes of text or one row.

    What earlier pieces freed is handed back every ``RELEASE_BYTES`` and after the last
    one; what was learned for another operator than ``owner`` is forgotten first.
    """
    for other in [name for name in _learned if name != owner]:
        _learned.pop(other)()
        release()
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    at = released = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
        if ends[at - 1] - released >= RELEASE_BYTES or at == batch.num_rows:
            release()
            released = ends[at - 1]


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, ...]:
    """(start, end, row) of every maximal run of non-separator bytes, rows kept apart."""
    inside = ~separator[data]
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | fresh[:n]))
    ends = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by differences of one prefix hash."""
    up, down = _power_tables(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=prefix[1:])
    raw = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def by_row(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both arrays sorted by row, then value (one sort of packed keys, or two where those tie)."""
    spare = np.uint64(max(1, int(row.max(initial=0)).bit_length()))
    order = np.argsort((row.astype(np.uint64) << (np.uint64(64) - spare)) | (value >> spare))
    a, b = row[order], value[order]
    if ((a[1:] == a[:-1]) & (b[1:] < b[:-1])).any():
        order = np.lexsort((value, row))
        a, b = row[order], value[order]
    return a, b


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every distinct word shingle, sorted by row and hash.

    Words are runs of non-space bytes, A-Z lower-cased. A text with fewer words
    than ``width`` gives its whole word sequence as one shingle; a text without
    words gives none.
    """
    low = LOWER[data]
    starts, ends, rows = word_spans(low, offsets)
    words = span_hashes(low, starts, ends)
    n_words = np.bincount(rows, minlength=len(offsets) - 1)
    count = max(0, len(words) - width + 1)
    total = np.zeros(count, np.uint64)
    for k in range(width):
        total += words[k : k + count] * _ORDER[k]
    whole = rows[:count] == rows[width - 1 :] if count else np.zeros(0, bool)
    row, value = rows[:count][whole], mix(total[whole])
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        first = np.searchsorted(rows, short)
        own = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = n_words[short] > k
            own[has] += words[first[has] + k] * _ORDER[k]
        row = np.concatenate((row, short))
        value = np.concatenate((value, mix(own + n_words[short].astype(np.uint64) * _ORDER[9])))
    row, value = by_row(row, value)
    if len(row):
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        row, value = row[new], value[new]
    return row, value


def in_bitmap(words: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether each 64-bit value's bit is set."""
    word = words[(value & np.uint64(len(words) * 64 - 1)) >> np.uint64(6)]
    return (word >> (value & np.uint64(63))) & np.uint64(1) == 1


def bitmap_of(values: DataFrame, column: str, words: int):
    """A broadcast bitmap of ``words`` 64-bit words (a power of two) with the low bits of a column's values.

    Its words are put together by Spark; their number bounds what reaches the driver.
    """
    bit = F.col(column).bitwiseAND(F.lit(words * 64 - 1))
    one = F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
    found = values.groupBy(F.shiftrightunsigned(bit, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[np.asarray(found["word"])] = np.asarray(found["bits"]).view(np.uint64)
    return values.sparkSession.sparkContext.broadcast(out)
