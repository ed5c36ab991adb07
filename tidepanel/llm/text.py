"""Words, lines and shingles of whole texts as hashed numpy arrays, read straight from Arrow buffers.

Everything works on the UTF-8 bytes of a slice of rows at once. White space is the six ASCII characters
``[\\x20\\x09-\\x0D]``, which never occur inside a longer UTF-8 sequence. Hashes of spans are 64-bit sums of a mixed value for
each byte and its place, as if drawn from a table; they are equal on every machine.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SHINGLE = 5
_BASE = 0xD6E8FEB86659FD93  # any odd number


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_values(seed: int, lower: bool) -> np.ndarray:
    out = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(seed))
    if lower:
        out[65:91] = out[97:123]
    return out


EXACT, EXACT_2, LOWER = byte_values(1, False), byte_values(2, False), byte_values(1, True)
_powers = np.ones(1, np.uint64)
_places = np.zeros(0, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        step = np.full(max(n, 1 << 12), U(_BASE))
        step[0] = U(1)
        _powers = np.cumprod(step, dtype=np.uint64)
    return _powers


def places(n: int) -> np.ndarray:
    """A random value for each place in a span."""
    global _places
    if len(_places) < n:
        _places = mix(np.arange(1, max(n, 1 << 12) + 1, dtype=np.uint64) * U(0xA0761D6478BD642F))
    return _places


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    values = values.cast(pa.large_string())
    if values.null_count:
        values = values.fill_null("")
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64, len(values) + 1, values.offset * 8)
    all_bytes = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return all_bytes[at[0]:at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, name: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows of about ``most`` bytes, one long row alone; with their bytes and offsets."""
    data, at = buffers(column(batch, name))
    first, n = 0, batch.num_rows
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        yield batch.slice(first, last - first), data[at[first]:at[last]], at[first:last + 1] - at[first]
        first = last


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~SPACE[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = at[(at > 0) & (at < len(data))]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(at, starts, side="right") - 1


def lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Start, end and row of every \n-split line; each row has at least one, if empty."""
    breaks = np.flatnonzero(data == 10)
    rows = np.searchsorted(at, breaks, side="right") - 1
    starts = np.concatenate([at[:-1], breaks + 1])
    row = np.concatenate([np.arange(len(at) - 1), rows])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    ends = np.concatenate([starts[1:] - 1, at[-1:]])
    last = np.flatnonzero(np.diff(row, append=len(at)))  # the last line of each row ends with it
    ends[last] = at[row[last] + 1]
    return starts, ends, row


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = EXACT) -> np.ndarray:
    """A hash of each span of bytes; spans don't overlap and ascend.

    The value of a byte is mixed with that of its place before it is added: a plain sum of powers would take some words of the same bytes
    in another order as equal, whatever the values are.
    """
    lens = ends - starts
    out = np.zeros(len(lens), np.uint64)
    full = lens > 0
    if full.any():
        many = lens[full]
        first = np.cumsum(many) - many
        local = np.arange(int(many.sum())) - np.repeat(first, many)
        terms = values[data[local + np.repeat(starts[full], many)]]
        terms += places(int(many.max()))[local]
        terms ^= terms >> U(32)
        terms *= U(0xBF58476D1CE4E5B9)
        terms ^= terms >> U(29)
        out[full] = np.add.reduceat(terms, first)
    return mix(out + lens.astype(np.uint64) * U(0x9E3779B97F4A7C15))


_FACTORS = mix(np.arange(11, 11 + 64, dtype=np.uint64)) | U(1)


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n consecutive words of a row, and the index of its first word."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(count, U(n))
    for k in range(n):
        total += hashes[k:k + count] * _FACTORS[k]
    at = np.flatnonzero(rows[:count] == rows[n - 1:])
    return mix(total[at]), at


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's n-word shingles, A-Z lowered; a row with fewer words has its whole sequence as one."""
    starts, ends, rows = words(data, at)
    hashes = span_hashes(data, starts, ends, LOWER)
    values, first = grams(hashes, rows, n)
    bounds = np.searchsorted(rows[first], np.arange(len(at)))
    counts = np.searchsorted(rows, np.arange(len(at)))
    out = []
    for i in range(len(at) - 1):
        a, z = bounds[i], bounds[i + 1]
        if z > a:
            s = np.sort(values[a:z])
            out.append(s if z - a == 1 else s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif (k := counts[i + 1] - counts[i]) > 0:
            out.append(mix((hashes[counts[i]:counts[i + 1]] * _FACTORS[:k]).sum(keepdims=True) + U(k)))
        else:
            out.append(values[:0])
    return out
