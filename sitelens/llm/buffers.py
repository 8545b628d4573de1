"""Numpy helpers over the UTF-8 buffers of Arrow string columns.

Texts are handled as one concatenated ``uint8`` buffer plus offsets, so hashing
and windowing run as a few vector operations per block of documents instead of
once per document. Blocks hold about ``BLOCK_BYTES`` of text (one longer
document makes a block of its own), which bounds a task's memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 16
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (in place on a fresh array)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, cached per process."""
    have = _POWERS.get("up")
    if have is None or have.size < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.ones(size, dtype=_U)
            done = 1
            while done < size:   # doubling: p[k + done] = p[k] * base**done
                step = _U(pow(int(base), done, 1 << 64))
                p[done:2 * done] = p[:done] * step
                done *= 2
            _POWERS[key] = p
    return _POWERS["up"][:n], _POWERS["down"][:n]


def text_column(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = pc.fill_null(col, "" if not pa.types.is_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()[:3]
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32, len(col) + 1, col.offset * (8 if wide else 4))
    o = o.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[o[0]:o[-1]], o - o[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Row ranges [a, b) whose texts together hold about ``limit`` bytes."""
    n, a = offsets.size - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def is_space(buf: np.ndarray) -> np.ndarray:
    return _SEP[buf]


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the words ``[^\\x20\\x09-\\x0D]+``; ``first`` gives each
    document's first word index, with the total at its end. A word never crosses documents."""
    n = buf.size
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(offsets.size, np.int64)
    inside = ~_SEP[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, offsets)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span [start, end): polynomial over coded bytes, from prefix sums."""
    return code_span_hashes(_BYTE_CODE[buf], starts, ends)


def code_span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each run codes[start:end], of any lengths."""
    total, down = span_sums(codes)
    return mix((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(_U))


def span_sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums, scale): the run [a, b) hashes to mix((sums[b] - sums[a]) * scale[a] ^ (b - a))."""
    up, down = _powers(codes.size + 1)
    total = np.zeros(codes.size + 1, _U)
    np.cumsum(codes * up[:-1], out=total[1:])
    return total, down


def window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive codes (uint64), by doubling: a run of 2m is made of two
    runs of m, and any other length of two overlapping ones."""
    n = codes.size - k + 1
    if n <= 0:
        return np.zeros(0, _U)

    def join(left, right):
        out = left * _U(0xF1357AEA2E62A9C5)
        out += right
        out ^= out >> _U(29)
        return out

    h, m = codes, 1
    while 2 * m <= k:
        h = join(h[:-m], h[m:])
        m *= 2
    if m < k:
        h = join(h[:n], h[k - m:k - m + n])
    return mix(h)


def byte_codes(buf: np.ndarray) -> np.ndarray:
    return _BYTE_CODE[buf]


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost minimum of each window of ``w`` consecutive values. The index replaces the
    low 32 bits of each value, so that one running minimum carries it: the order is that of the high 32
    bits, then of position, and so the same wherever equal values stand."""
    n = x.size - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = _U(0xFFFFFFFF)
    best, m = (x & ~low) | np.arange(x.size, dtype=_U), 1
    while 2 * m <= w:
        best = np.minimum(best[:-m], best[m:])
        m *= 2
    if m < w:
        best = np.minimum(best[:n], best[w - m:w - m + n])
    return (best & low).astype(np.int64)


def spread_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + count) for each pair."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    skip = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) - np.repeat(skip, counts) + np.repeat(starts, counts)
