"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut by the usual pre-token pattern; each pre-token is merged on its own. The queue
of a pre-token has one bucket of linked-list positions per merge rank and a two-level bitmap
over the buckets: find-first-set on the top level names a word, find-first-set on the word
names the lowest rank that has entries. Entries whose pair has changed since they were queued
are skipped when they surface. A merge costs O(log bucket), whatever the length of the
pre-token, so one unbroken run of 100,000 characters is no special case.

Cutting is vectorised: code points are classed by a table, boundaries follow from where the
class changes, and each distinct pre-token of a slice is merged once (and remembered by the
worker up to a bound).

Cases: null text is empty and has no ids; bytes that are not UTF-8 are read as U+FFFD; a very
long text is one slice of its own, in memory some forty times its bytes; an empty table gives an empty table; rows are
independent, so repeated rows and ids give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import unicodedata
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergewell.llm import vec

#: Merged pre-tokens that a worker remembers, in two generations, and the longest of them.
CACHE_ENTRIES = 200_000
CACHE_BYTES_EACH = 64
SLICE_BYTES = 1 << 21

# The code points with the Unicode property White_Space.
_WHITE = (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_state: dict[str, object] = {}


def class_table() -> np.ndarray:
    """Class of every code point: white space, letter, number or other."""
    if "classes" not in _state:
        letter = {"L": LETTER, "N": NUMBER}
        table = np.array([letter.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
        table[_WHITE] = SPACE
        _state["classes"] = table
    return _state["classes"]


def load_ranks(path: str) -> dict[bytes, int]:
    """Merge ranks of a rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def pretokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the pre-tokens and the index of each row's first one."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    place = np.flatnonzero((data & 0xC0) != 0x80)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    cls = class_table()[cp]
    n = len(cp)
    rows = np.searchsorted(place, off)
    first = np.zeros(n + 1, bool)  # first code point of a row, and the end
    first[rows] = True
    white = cls == SPACE
    blank = cp == 32
    change = np.ones(n, bool)
    change[1:] = cls[1:] != cls[:-1]
    change |= first[:n]
    joined = np.zeros(n, bool)  # the space before it belongs to the same pre-token
    joined[1:] = blank[:-1] & ~white[1:] & ~first[1:n]
    start = change & ~joined
    last_white = white.copy()
    last_white[:-1] &= ~white[1:]
    last_white[-1] = False
    last_white &= ~first[1:]
    start |= last_white
    tick = np.flatnonzero((cp == 0x27) & start)
    if len(tick):
        row_end = rows[np.searchsorted(rows, tick, side="right")]
        padded = np.concatenate([cp, np.zeros(2, np.uint32)])
        one, two = padded[tick + 1], padded[tick + 2]
        one = np.where(tick + 1 < row_end, one, 0)
        two = np.where(tick + 2 < row_end, two, 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        wide = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        size = np.where(short, 2, np.where(wide, 3, 0))
        hit = size > 0
        tick, size, row_end = tick[hit], size[hit], row_end[hit]
        start[tick + 1] = False
        after = tick + size
        inner = after < row_end
        after = after[inner]
        # What follows a contraction starts anew unless a boundary rule already put it elsewhere.
        start[after[~white[after]]] = True
    at = np.flatnonzero(start)
    bounds = np.append(place, len(data))
    starts = bounds[at]
    ends = np.append(starts[1:], len(data))
    return starts, ends, np.searchsorted(at, rows)


class RankQueue:
    """Bucket queue over merge ranks. Empty again after every pre-token, so it is reused."""

    BITS = 256

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.words = [0] * (max(ranks.values(), default=0) // self.BITS + 1)
        self.buckets: dict[int, list[int]] = {}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 where they don't merge."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short pre-tokens and how many each has. All share the one queue: what
        surfaces at a rank is merged at once, the leftmost position of each pre-token, and
        later positions of the same pre-token stay queued, so each sees its own strict order."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        lens = np.array([len(p) for p in pieces], np.int64)
        begin = np.concatenate([[0], np.cumsum(lens)])
        n, words, buckets, top = len(data), self.words, self.buckets, 0
        owner = np.repeat(np.arange(len(pieces)), lens)
        limit = begin[1:][owner]
        tok = self.of_byte[data]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        before[begin[:-1]] = -1
        alive, rank_at = np.ones(n, bool), np.full(n, -1, np.int64)
        fresh = np.flatnonzero(after < limit)
        new_ranks = self._rank(tok[fresh], tok[fresh + 1])
        while True:
            rank_at[fresh] = new_ranks
            queued = new_ranks >= 0
            for r, p in zip(new_ranks[queued].tolist(), fresh[queued].tolist(), strict=True):
                if r in buckets:
                    buckets[r].append(p)
                else:
                    buckets[r] = [p]
                    words[r >> 8] |= 1 << (r & 255)
                    top |= 1 << (r >> 8)
            if not top:
                break
            w = (top & -top).bit_length() - 1
            x = words[w]
            r = (w << 8) | ((x & -x).bit_length() - 1)
            at = np.array(buckets[r], np.int64)
            at = at[rank_at[at] == r]  # the rest is stale
            at.sort()
            own = owner[at]
            lead = np.ones(len(at), bool)
            lead[1:] = own[1:] != own[:-1]
            if lead.all():
                del buckets[r]
                words[w] = x = x & (x - 1)
                if not x:
                    top &= top - 1
            else:
                buckets[r] = at[~lead].tolist()
                at = at[lead]
            q = after[at]
            e = after[q]
            after[at], tok[at], alive[q], rank_at[q], rank_at[at] = e, r, False, -1, -1
            inner = e < limit[at]
            before[e[inner]] = at[inner]
            left = before[at]
            has = left >= 0
            fresh = np.concatenate([at[inner], left[has]])
            new_ranks = self._rank(np.concatenate([tok[at[inner]], tok[left[has]]]), np.concatenate([tok[e[inner]], tok[at[has]]]))
        return tok[alive].astype(np.int32), np.add.reduceat(alive, begin[:-1], dtype=np.int64)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: always the pair of lowest rank, leftmost on ties."""
        ranks = self.ranks
        n, get, words, buckets, top = len(piece), ranks.get, self.words, self.buckets, 0
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        rank_at = [-1] * n
        for p in range(n - 1):
            r = get(piece[p : p + 2])
            if r is not None:
                rank_at[p] = r
                if r in buckets:
                    heappush(buckets[r], p)
                else:
                    buckets[r] = [p]
                    words[r >> 8] |= 1 << (r & 255)
                    top |= 1 << (r >> 8)
        while top:
            w = (top & -top).bit_length() - 1
            x = words[w]
            r = (w << 8) | ((x & -x).bit_length() - 1)
            bucket = buckets[r]
            p = heappop(bucket)
            if not bucket:
                del buckets[r]
                words[w] = x = x & (x - 1)
                if not x:
                    top &= top - 1
            if rank_at[p] != r:
                continue  # stale
            q = after[p]
            e = after[q]
            after[p] = e
            rank_at[q] = rank_at[p] = -1
            if e < n:
                before[e] = p
                pairs = ((p, after[e]),)
            else:
                pairs = ()
            if before[p] >= 0:
                rank_at[before[p]] = -1
                pairs += ((before[p], e),)
            for s, t in pairs:
                r = get(piece[s:t])
                if r is not None:
                    rank_at[s] = r
                    if r in buckets:
                        heappush(buckets[r], s)
                    else:
                        buckets[r] = [s]
                        words[r >> 8] |= 1 << (r & 255)
                        top |= 1 << (r >> 8)
        ids, p = [], 0
        while p < n:
            e = after[p]
            ids.append(ranks[piece[p:e]])
            p = e
        return ids


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.queue = RankQueue(ranks)
        self.whole = {token: i.to_bytes(4, "little") for token, i in ranks.items()}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            by_id[i] = token
        self.tokens = pa.array(by_id, pa.large_binary())

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, four bytes an id. One that is itself a token is that token."""
        whole, young, old = self.whole, self.young, self.old
        found = [whole.get(p) or young.get(p) for p in pieces]
        short = []
        for i in [i for i, x in enumerate(found) if x is None]:
            p = pieces[i]
            if len(p) > CACHE_BYTES_EACH:
                found[i] = np.array(self.queue.merge(p), np.int32).tobytes()
            elif p in old:
                found[i] = young[p] = old[p]
            else:
                short.append(i)
        if short:
            ids, size = self.queue.merge_many([pieces[i] for i in short])
            raw, end = ids.tobytes(), (4 * np.cumsum(size)).tolist()
            for i, a, b in zip(short, [0, *end], end, strict=False):
                found[i] = young[pieces[i]] = raw[a:b]
        if len(young) > CACHE_ENTRIES // 2:
            self.young, self.old = {}, young
        return found

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offsets of the rows)."""
        starts, ends, first = pretokens(data, off)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        _, where, back = np.unique(vec.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        each = self.pieces([raw[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        begin = np.concatenate([[0], np.cumsum(size)])
        pool = np.frombuffer(b"".join(each), np.int32)
        counts = size[back]
        total = np.concatenate([[0], np.cumsum(counts)])
        take = np.arange(total[-1]) - np.repeat(total[:-1] - begin[back], counts)
        return pool[take], total[first]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> pa.LargeBinaryArray:
        """Bytes of each row's ids."""
        values = self.tokens.take(pa.array(ids))
        ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset :][: len(ids) + 1]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(ends[off].tobytes()), values.buffers()[2]])


def _codec(key: str, ranks: dict[bytes, int]) -> Codec:
    if _state.get("key") != key:
        _state["codec"], _state["key"] = Codec(ranks), key
    return _state["codec"]


def encode(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = True, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Columns `id_col`, `ids` (array of int) and, if asked for, `decoded` (binary: the ids
    turned back into bytes through the vocabulary). One narrow stage, no shuffle; the rank
    file is read on the driver and broadcast (its size does not depend on the data). A worker
    cuts `slice_bytes` of text at a time; less takes less memory and more time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(rank_path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        codec = _codec(rank_path, shared.value)
        for batch in batches:
            for part in vec.slices(batch, "text", slice_bytes):
                data, off = vec.valid_utf8(*vec.text_bytes(part.column(1)))
                ids, rows = codec.encode(data, off)
                cols = [part.column(0), pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids))]
                if with_decoded:
                    cols.append(codec.decode(ids, rows).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "decoded"][: len(cols)])

    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, ids array<int>" + ", decoded binary" * with_decoded
    )
    return out.withColumnRenamed("doc_id", id_col)
