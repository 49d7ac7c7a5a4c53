"""Word and shingle hashing over whole Arrow text columns with numpy.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; those bytes
never occur inside a multi-byte UTF-8 character, so byte runs are exactly the
words ``[^\\x20\\x09-\\x0D]+``. A-Z are folded to a-z. Every hash is 64 bits and
depends on nothing but the words, so results do not depend on batch borders,
partitioning or the worker process.
"""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None  # glibc alone has it
WINDOW = 1 << 20  # bytes hashed at a time; bounds the temporary arrays


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (splitmix64): a bijection that spreads every bit."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def salts(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random constants."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLDED = np.arange(256)
_FOLDED[65:91] += 32
_TABLE = salts(256, 11)[_FOLDED]
_BASE = 0xD1342543DE82EF95 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, WINDOW + 1), base, dtype=U64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(steps)
        _powers[base] = have
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, row offsets) of a string column; a null row is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def _window_ends(data: np.ndarray, offsets: np.ndarray):
    """Cuts of the bytes into windows that never split a word: each ends at a
    row border or just after a space."""
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + WINDOW)
        if to < n:
            row = offsets[np.searchsorted(offsets, to, side="right") - 1]
            spaces = np.flatnonzero(_SPACE[data[at:to]])
            last = at + spaces[-1] + 1 if len(spaces) else at
            to_ = max(row, last)
            while to_ <= at:  # one word longer than the window
                nxt = offsets[np.searchsorted(offsets, to, side="right")]
                spaces = np.flatnonzero(_SPACE[data[to:min(to + WINDOW, nxt)]])
                if len(spaces):
                    to_ = to + spaces[0] + 1
                elif to + WINDOW >= nxt:
                    to_ = nxt
                else:
                    to += WINDOW
            to = int(to_)
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray, spans: bool = False):
    """Hashes of all words in order, and for each row the index of its first
    word (one more entry for the end). With ``spans`` also the words' byte
    starts and ends."""
    out, starts, ends = [], [], []
    borders = np.zeros(len(data) + 1, dtype=bool)
    borders[offsets] = True
    with np.errstate(over="ignore"):
        for lo, hi in _window_ends(data, offsets):
            b = data[lo:hi]
            space = _SPACE[b]
            edge = borders[lo:hi + 1]
            before = np.empty(len(b), dtype=bool)
            before[0] = True
            before[1:] = space[:-1] | edge[1:-1]
            after = np.empty(len(b), dtype=bool)
            after[-1] = True
            after[:-1] = space[1:] | edge[1:-1]
            s = np.flatnonzero(~space & before)
            e = np.flatnonzero(~space & after) + 1
            sums = np.zeros(len(b) + 1, dtype=U64)
            np.cumsum(_TABLE[b] * _power(_BASE, len(b)), out=sums[1:])
            out.append(mix((sums[e] - sums[s]) * _power(_INVERSE, len(b))[s] + (e - s).astype(U64)))
            starts.append(s + lo)
            ends.append(e + lo)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, dtype=kind)
    starts = join(starts, np.int64)
    first = np.searchsorted(starts, offsets)
    return (join(out, U64), first, starts, join(ends, np.int64)) if spans else (join(out, U64), first)


def release() -> None:
    """Give memory of freed arrays back to the system. Workers live on for later
    stages, and the C library keeps what it once had."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def row_slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20):
    """Consecutive slices of a batch whose texts hold about ``most`` bytes (a
    longer row is a slice of its own)."""
    col = batch.column(column)
    sizes = np.asarray(pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def shingle_rows(hashes: np.ndarray, first: np.ndarray, k: int):
    """Yield each row's sorted distinct k-word shingle hashes. A row with
    fewer words has one shingle, its whole sequence; without words, none."""
    salt = salts(k, 101)
    n = len(hashes)
    with np.errstate(over="ignore"):
        if n >= k:
            g = hashes[: n - k + 1] * salt[0]
            for j in range(1, k):
                g += hashes[j: n - k + 1 + j] * salt[j]
            g = mix(g)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= k:
                yield np.unique(g[a: b - k + 1])
            elif b > a:
                short = (hashes[a:b] * salt[: b - a]).sum(dtype=U64) + U64(b - a)
                yield mix(np.array([short], dtype=U64))
            else:
                yield np.zeros(0, dtype=U64)
