"""Vectorised byte and word kernels on Arrow string columns (numpy only)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that the kernels handle at once; bounds their temporaries.
BLOCK_BYTES = 1 << 20
U64 = np.uint64
MASK = (1 << 64) - 1
_ODD = U64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A random word for each byte value, so that runs of equal bytes hash well.
BYTE = mix(np.arange(1, 257, dtype=U64) * _ODD)
_P, _INV = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)


class _Powers:
    """Powers of the polynomial's base and of its inverse, as many as were needed so
    far; shipped to executors without them."""

    def __init__(self):
        self.tables = [np.ones(1, U64), np.ones(1, U64)]

    def __reduce__(self):
        return _Powers, ()


_powers = _Powers()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    tables = _powers.tables
    if len(tables[0]) < n:
        for k, base in enumerate((_P, _INV)):
            p = np.full(n, base, U64)
            p[0] = 1
            tables[k] = np.multiply.accumulate(p)
    return tables[0], tables[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over bytes (or 64-bit hashes) modulo 2**64; see
    ``span_hash``."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((BYTE[data] if data.dtype == np.uint8 else data) * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span stands."""
    inverse = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64) * _ODD)


def utf8(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if lower:
        column = pc.utf8_lower(column)
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole rows of about
    ``most`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space), and the
    number of each row's words."""
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    at = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(at)


def combine(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive values (len - size + 1 of them)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for k in range(size):
        out = mix(out ^ h[k : k + n]) + U64((k + 1) * int(_ODD) & MASK)
    return out


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's word shingles and the row of each.  A row of one to
    ``size - 1`` words has one shingle, all its words."""
    starts, ends, count = words(data, offsets)
    h = span_hash(prefix_hash(data), starts, ends) if len(starts) else np.zeros(0, U64)
    row = np.repeat(np.arange(len(count)), count)
    grams = combine(h, size)
    ok = row[: len(grams)] == row[size - 1 :] if len(grams) else np.zeros(0, bool)
    out, of = [grams[ok]], [row[: len(grams)][ok]]
    at = np.concatenate(([0], np.cumsum(count)))
    for n in range(1, size):
        rows = np.flatnonzero(count == n)
        if len(rows):
            x = np.full(len(rows), U64(n))
            for k in range(n):
                x = mix(x ^ h[at[rows] + k]) + U64((k + 101) * int(_ODD) & MASK)
            out.append(x)
            of.append(rows)
    return np.concatenate(out), np.concatenate(of)


def multiset(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by (row, hash): hash, row, and for each entry its number among the
    equal ones of its row (from 0); and where runs of equal entries start."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    number = np.arange(len(h)) - np.repeat(start, np.diff(np.append(start, len(h))))
    return h, row, number, start


def ragged(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of pool[begin : begin + size], and where each part begins."""
    total = np.concatenate(([0], np.cumsum(size)))
    return pool[np.repeat(begin - total[:-1], size) + np.arange(total[-1])], total


class SpanCache:
    """Codes (packed unsigned 32-bit numbers) of byte spans by their hash; each
    distinct span of a block is looked up once.  ``learn`` codes new spans; at
    most ``most`` are held."""

    def __init__(self, learn, most: int):
        self.learn, self.most, self.known = learn, most, {}

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All codes, and where each span's begin (and the last one's end)."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        h, first, back = np.unique(span_hash(prefix_hash(data), starts, ends), return_index=True, return_inverse=True)
        keys, known = h.tolist(), self.known
        new = [k for k, key in enumerate(keys) if key not in known]
        if len(known) + len(new) > self.most:
            known.clear()
            new = list(range(len(keys)))
        if new:
            raw, at = data.tobytes(), first[new]
            known.update(zip([keys[k] for k in new], self.learn([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]), strict=True))
        found = [known[key] for key in keys]
        size = np.array([len(x) for x in found]) // 4
        return ragged(np.frombuffer(b"".join(found), "<u4"), (np.cumsum(size) - size)[back], size[back])
