"""Vectorised helpers over Arrow text columns.

Everything here works on the concatenated UTF-8 bytes of a slice of rows, so that a Python
worker does a constant number of numpy calls per slice and none per word. Words are runs of
bytes other than space and 0x09-0x0D, the ASCII white space that cannot occur inside a UTF-8
sequence, so byte positions never cut a character.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 21
LONG_WORD = 4096

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=U64)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (shift-multiply rounds)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    kind = np.int64 if wide else np.int32
    bufs = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def valid_utf8(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same text where it is UTF-8; in rows that are not, what is wrong becomes U+FFFD. (A
    string column cast from binary can hold any bytes.)"""
    raw = data.tobytes()
    try:
        raw.decode("utf-8")
        rows = np.flatnonzero((data[off[:-1][off[:-1] < len(data)]] & 0xC0) == 0x80)
        if not len(rows):  # no character reaches over the border of rows
            return data, off
    except UnicodeDecodeError:
        pass
    texts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


def give_back() -> None:
    """Return freed memory to the system: workers live on, and other stages need it."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of about `limit` bytes of text each, one row at least, so that the working
    memory of a worker does not follow the size of the Arrow batch."""
    _, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
    row, n = 0, batch.num_rows
    while row < n:
        end = int(np.searchsorted(off, off[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield batch.slice(row, end - row)
        row = end
    give_back()


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each row the index of its first word
    (one more entry closes the last row)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = off[off < len(data)]
    before[cuts] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word, of its bytes alone."""
    n = len(starts)
    if not n:
        return np.zeros(0, U64)
    lanes = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    left = ends - starts
    h = mix(left.astype(U64) + U64(_BASES[0]))
    long = np.flatnonzero(left > LONG_WORD)
    block = np.ascontiguousarray(lanes[starts]).view("<u8").ravel()
    h = mix(h ^ (block & _MASK[np.minimum(left, 8)]))
    idx = np.flatnonzero((left > 8) & (left <= LONG_WORD))
    pos, rest = starts[idx] + 8, left[idx] - 8
    while len(idx):
        block = np.ascontiguousarray(lanes[pos]).view("<u8").ravel()
        h[idx] = mix(h[idx] * U64(3) ^ (block & _MASK[np.minimum(rest, 8)]))
        more = rest > 8
        idx, pos, rest = idx[more], pos[more] + 8, rest[more] - 8
    for i in long:
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        h[i] = int.from_bytes(digest, "little")
    return h


def _pow(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = _BASES[which]
        inv = pow(base, -1, 1 << 64)
        up = np.full(size, base, U64)
        down = np.full(size, inv, U64)
        up[0] = down[0] = 1
        have = _powers[which] = (np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64))
    return have


def gram_hashes(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of every k consecutive entries: differences of a prefix polynomial modulo 2**64,
    shifted back to their start. Entries of different rows meet in the last k - 1 grams of a
    row; callers leave these out."""
    n = len(words)
    if n < k:
        return np.zeros(0, U64)
    up, down = _pow(which, n)
    own = words if which == 0 else mix(words ^ U64(_BASES[1]))
    prefix = np.zeros(n + 1, U64)
    np.cumsum(own * up[:n], out=prefix[1:])
    return mix((prefix[k:] - prefix[:-k]) * down[: n - k + 1])


def row_of(first: np.ndarray) -> np.ndarray:
    """Row index of every word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def whole_grams(first: np.ndarray, k: int) -> np.ndarray:
    """Start indices of the grams of k words that lie within one row."""
    n = int(first[-1])
    if n < k:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    for back in range(1, k):
        cut = first[1:] - back
        ok[cut[(cut >= first[:-1])]] = False
    return np.flatnonzero(ok)


def span_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the entries from each start to its end, as gram_hashes has it."""
    n = len(words)
    up, down = _pow(0, n + 1)
    prefix = np.zeros(n + 1, U64)
    np.cumsum(words * up[:n], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start])


def window_minima(values: np.ndarray, starts: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """For each w consecutive grams of one row: index of the first gram, and index of the
    (leftmost) smallest of `values`. `values[i]` belongs to the gram at word `starts[i]`; grams
    of one row are consecutive, so rows with fewer than w grams have no such window."""
    n = len(starts)
    if n < w:
        z = np.zeros(0, np.int64)
        return z, z
    low, reach, at = values.copy(), 1, np.arange(n)
    while reach < w:  # doubling: smallest of `reach` entries from each start
        step = min(reach, w - reach)
        other, where = low[step:], at[step:]
        better = other < low[: n - step]
        low[: n - step] = np.where(better, other, low[: n - step])
        at[: n - step] = np.where(better, where, at[: n - step])
        reach += step
    head = np.arange(n - w + 1)
    head = head[starts[head + w - 1] - starts[head] == w - 1]
    return head, at[head]


def minimisers(values: np.ndarray, starts: np.ndarray, w: int) -> np.ndarray:
    """Indices of the grams that are the smallest of some w consecutive grams of one row."""
    return np.unique(window_minima(values, starts, w)[1])
