"""NumPy kernels over the UTF-8 bytes of a block of texts: words, hashes, n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes that separate words: blank and 09 to 0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: One random 64-bit value per byte.
BYTE_CODE = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Keeps the first n bytes of a little-endian lane of 8.
LANE = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
#: Bytes that a span is hashed in one after another; longer ones by parts of so many.
PART = 64
#: Bytes of a long text that a kernel looks at together.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds): row ``i`` is bytes[bounds[i]:bounds[i + 1]]; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word ``[^\\x20\\x09-\\x0D]+``; no word crosses rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(bounds, start, "right") - 1


def _lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one number; zeros after the end."""
    return np.ndarray((len(data),), U64, np.concatenate((data, np.zeros(8, np.uint8))), 0, (1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span data[start:end], the same wherever the span stands.

    Lanes of 8 bytes go in one after another, each through the finaliser, so no
    algebra of the bytes makes two spans agree. Of a span above PART bytes the
    parts are hashed, then the row of their hashes.
    """
    size = end - start
    out = mix(size.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(0x2545F4914F6CDD1D))
    long = np.flatnonzero(size > PART)
    if len(long):
        parts = -(-size[long] // PART)
        ends = np.cumsum(parts)
        own = np.repeat(long, parts)
        at = start[own] + (np.arange(len(own)) - np.repeat(ends - parts, parts)) * PART
        row = span_hashes(data, at, np.minimum(at + PART, end[own]))
        out[long] = mix(out[long] ^ span_hashes(row.view(np.uint8), (ends - parts) * 8, ends * 8))
    live = np.flatnonzero((size > 0) & (size <= PART))
    at, left, lanes = start[live], size[live], _lanes(data)
    while len(live):
        out[live] = mix((out[live] ^ (lanes[at] & LANE[np.minimum(left, 8)])) * U64(0xA0761D6478BD642F) + U64(1))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def same_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from each ``a`` on are those from ``b`` on."""
    out = np.ones(len(a), bool)
    for i in np.flatnonzero((size > PART) & (a != b)).tolist():
        out[i] = np.array_equal(data[a[i] : a[i] + size[i]], data[b[i] : b[i] + size[i]])
    live = np.flatnonzero((size > 0) & (size <= PART) & (a != b))
    a, b, left, lanes = a[live], b[live], size[live], _lanes(data)
    while len(live):
        out[live] &= ((lanes[a] ^ lanes[b]) & LANE[np.minimum(left, 8)]) == 0
        more = left > 8
        live, a, b, left = live[more], a[more] + 8, b[more] + 8, left[more] - 8
    return out


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a span of each distinct content, number of the content of each span). Equal hashes are checked byte by byte."""
    _, first, number = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
    size, rep = end - start, first[number]
    same = size == size[rep]
    same[same] = same_spans(data, start[same], start[rep][same], size[same])
    if not same.all():  # two contents with one hash
        raw, found = data.tobytes(), {}
        number = np.array([found.setdefault(raw[s:e], len(found)) for s, e in zip(start.tolist(), end.tolist())], np.int64)
        first = np.unique(number, return_index=True)[1]
    return first, number


def slices(data: np.ndarray, bounds: np.ndarray, limit: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, bounds) of the texts, cut at white space where they are long. All rows are in each slice, mostly empty."""
    start = 0
    while start < len(data) or start == 0:
        end = len(data) if len(data) - start <= 2 * limit else start + limit
        while end < len(data):
            gaps = np.flatnonzero(SPACE[data[end : end + limit]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(end + limit, len(data))
        yield data[start:end], np.clip(bounds, start, end) - start
        start = max(end, 1)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word."""
    found = []
    for part, at in slices(data, bounds):
        start, end, row = words(part, at)
        found.append((span_hashes(part, start, end), row))
    return tuple(np.concatenate(c) for c in zip(*found))


def fold(parts: list[np.ndarray], seed: int) -> np.ndarray:
    """One hash of several hashes, in order."""
    out = np.full(len(parts[0]), seed, U64)
    for p in parts:
        out = mix(out * U64(0xA0761D6478BD642F) + p)
    return out


def shingles(data: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of ``width`` words, repeats included; a row with fewer words gives its whole sequence."""
    hashed, row = word_hashes(data, bounds)
    if not len(hashed):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    n = len(hashed) - width + 1
    full = np.flatnonzero(row[: max(n, 0)] == row[width - 1 :]) if n > 0 else np.zeros(0, np.int64)
    out, at = [fold([hashed[full + k] for k in range(width)], width)], [row[full]]
    count = np.bincount(row, minlength=len(bounds) - 1)
    begin = np.concatenate(([0], np.cumsum(count)))[:-1]
    for short in range(1, width):
        rows = np.flatnonzero(count == short)
        if len(rows):
            out.append(fold([hashed[begin[rows] + k] for k in range(short)], short))
            at.append(rows)
    return np.concatenate(out), np.concatenate(at)


def distinct_by_row(values: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values row after row, bounds of the rows)."""
    order = np.argsort(row, kind="stable")
    values, count = values[order], np.bincount(row, minlength=rows)
    at = np.concatenate(([0], np.cumsum(count)))
    parts = [np.unique(values[at[i] : at[i + 1]]) for i in range(rows)]
    return (np.concatenate(parts) if parts else values), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values of each row, wrapping for unsigned types."""
    sums = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def list_array(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))
