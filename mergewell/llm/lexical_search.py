"""Ranked lexical search of all documents, by sort-based accumulation.

Items come in blocks of about BLOCK bytes of text, which a driver can hold and send; each block is
two passes. The first reads the documents once and keeps, for each, its length and the item terms
in it with their counts, from which the numbers of documents come. The second turns each kept
count into an impact, concatenates the (item, document, impact) arrays of a slice of documents,
sorts them by packed keys, one radix pass for each 16-bit digit, sums equal keys with reduceat and
keeps each item's best in heaps. Tasks hold stretches of the documents; their best meet in two
steps.

A term is a maximal run of ASCII letters, digits and characters beyond ASCII, of which only A-Z
are lower-cased. Documents' terms are told by 64 bits of hash, their length and first 8 bytes.

Cases: null and empty texts have no terms, which leaves items without results and documents out of
the counts; bytes that are not UTF-8 count as characters beyond ASCII; a document's length counts
every term of a very long text; equal scores rank by ascending id, null ids last; equal rows of
documents rank one after the other; repeated item ids are items of their own; ids of documents are
integers; extra columns are ignored; without documents or items there are no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergewell.llm import shared, vec

TOP = 10
#: Text of items that the driver and every executor hold at a time.
BLOCK = 1 << 22
#: (item, document, impact) entries sorted at a time, and documents with them.
ENTRIES, ROWS = 1 << 20, 1 << 16
#: Parts whose best meet in the first step.
PARTS = 256
_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, row) of all terms of the rows."""
    low = _LOWER[data]
    inside = np.concatenate([_TERM[data], [False]])
    edge = inside[1:] != inside[:-1]  # a run ends or begins after this byte
    cuts = off[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    starts = np.flatnonzero(edge & inside[1:]) + 1
    ends = np.flatnonzero(edge & inside[:-1]) + 1
    if len(data) and inside[0]:
        starts = np.concatenate([[0], starts])
    within = cuts[inside[cuts] & inside[cuts - 1]]  # rows that meet inside a run
    starts, ends = np.sort(np.concatenate([starts, within])), np.sort(np.concatenate([ends, within]))
    return low, starts, ends, np.searchsorted(off, starts, side="right") - 1


def heads(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first 8 bytes of each term."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lanes = np.lib.stride_tricks.sliding_window_view(np.concatenate([low, np.zeros(8, np.uint8)]), 8)
    return np.ascontiguousarray(lanes[starts]).view("<u8").ravel() & vec._MASK[np.minimum(ends - starts, 8)]


def radix_order(keys: np.ndarray) -> np.ndarray:
    """Stable order of unsigned keys, least significant 16 bits first; numpy sorts 16-bit numbers
    by radix. Digits that are in order already take no pass."""
    order, shift = np.arange(len(keys)), np.uint64(0)
    most = int(keys.max()) if len(keys) else 0
    while most >> int(shift):
        digit = (keys[order] >> shift).astype(np.uint16)
        if (digit[1:] < digit[:-1]).any():
            order = order[np.argsort(digit, kind="stable")]
        shift += np.uint64(16)
    return order


class Index:
    """A block of items: their terms, and for each term the items that hold it, how often."""

    def __init__(self, items: list[tuple[object, str | None]]) -> None:
        self.ids = [i for i, _ in items]
        raw = [(t or "").encode("utf-8", "surrogateescape") for _, t in items]
        off = np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).astype(np.int64)
        low, starts, ends, item = terms(np.frombuffer(b"".join(raw), np.uint8), off)
        hashes, self.first, self.term = np.unique(vec.word_hashes(low, starts, ends), return_index=True, return_inverse=True)
        self.hashes, self.size = hashes, (ends - starts)[self.first]
        self.head = heads(low, starts[self.first], ends[self.first])
        pairs, self.times = np.unique(self.term.astype(np.int64) << 32 | item, return_counts=True)
        self.item = pairs & 0xFFFFFFFF
        self.begin = np.searchsorted(pairs >> 32, np.arange(len(hashes) + 1))

    def find(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each term, -1 for those of no item."""
        if not len(self.hashes) or not len(starts):
            return np.full(len(starts), -1)
        at = np.searchsorted(self.hashes, h := vec.word_hashes(low, starts, ends))
        at[at == len(self.hashes)] = 0
        same = (self.hashes[at] == h) & (self.size[at] == ends - starts)
        same[same] = self.head[at[same]] == heads(low, starts[same], ends[same])
        return np.where(same, at, -1)


def postings(docs: DataFrame, index, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, counts) of every document that has terms: how many, and those of items."""

    def run(batches):
        for batch in batches:
            for rows in vec.slices(batch, "text"):
                data, off = vec.text_bytes(rows.column(1))
                low, starts, ends, row = terms(data, off)
                n, term = np.bincount(row, minlength=rows.num_rows), index.value.find(low, starts, ends)
                pairs, times = np.unique(row[term >= 0].astype(np.int64) << 32 | term[term >= 0], return_counts=True)
                kept = np.flatnonzero(n)
                ends_of = np.searchsorted(pairs >> 32, kept, side="right")
                cuts = pa.array(np.concatenate([[0], ends_of]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (pairs & 0xFFFFFFFF, times)]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(kept)), pa.array(n[kept].astype(np.int64)), *lists], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def statistics(held: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(documents, all their terms, documents with each item term)."""

    def run(batches):
        df, n, total = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            df += np.bincount(np.asarray(batch.column(1).flatten()), minlength=n_terms)
            n, total = n + batch.num_rows, total + int(np.asarray(batch.column(0)).sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], seen])), pa.array(np.concatenate([[n, total], df[seen]]))], ["term", "n"])

    found = {r.term: r.n for r in held.select("n", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return found.get(-1, 0), found.get(-2, 0), np.array([found.get(t, 0) for t in range(n_terms)], np.int64)


def best_of_parts(held: DataFrame, index, weights: np.ndarray, n_docs: int, total: int, top: int) -> DataFrame:
    """(part, nth, doc_id, score): of each task the `top` best documents of each item."""

    def run(batches):
        block, part = index.value, TaskContext.get().partitionId()
        fan = np.diff(block.begin)
        heaps: list[list] = [[] for _ in block.ids]
        floor = np.ones(len(block.ids), np.int64)  # least score that can still be among the best
        for batch in batches:
            ids, valid = np.asarray(batch.column(0).fill_null(0)), np.asarray(batch.column(0).is_valid())
            n, term, tf = np.asarray(batch.column(1)), np.asarray(batch.column(2).flatten()).astype(np.int64), np.asarray(batch.column(3).flatten()).astype(np.int64)
            cuts = np.asarray(batch.column(2).offsets).astype(np.int64)
            cuts -= cuts[0]
            m = 100 - 75 + 75 * n * n_docs // total
            row = np.repeat(np.arange(len(n)), np.diff(cuts))
            impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
            work = np.concatenate([[0], np.cumsum(fan[term])])[cuts]
            a = 0
            while a < len(n):
                b = min(max(a + 1, int(np.searchsorted(work, work[a] + ENTRIES, side="right")) - 1), a + ROWS, len(n))
                own = slice(cuts[a], cuts[b])
                item, doc, score = accumulate(block, term[own], row[own] - a, impact[own])
                good = np.flatnonzero(score >= floor[item])
                for i, d, s in zip(item[good].tolist(), (doc[good] + a).tolist(), score[good].tolist(), strict=True):
                    if s >= floor[i]:
                        entry = (s, bool(valid[d]), -int(ids[d]))
                        if len(heaps[i]) < top:
                            heapq.heappush(heaps[i], entry)
                        else:
                            heapq.heappushpop(heaps[i], entry)
                        if len(heaps[i]) == top:
                            floor[i] = heaps[i][0][0]
                a = b
        rows = [(part, i, -d if known else None, s) for i, heap in enumerate(heaps) for s, known, d in heap]
        cols = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["part", "nth", "doc_id", "score"])

    return held.mapInArrow(run, "part long, nth long, doc_id long, score long")


def accumulate(block: Index, term: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, document, score) of a slice: the arrays of all its terms' items are concatenated and
    sorted by item and document, and the impacts of each pair are summed."""
    size = block.begin[term + 1] - block.begin[term]
    at = np.repeat(np.arange(len(term)), size)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + block.begin[term][at]
    keys = (block.item[place] << 16 | doc[at]).astype(np.uint64)
    order = radix_order(keys)
    keys, value = keys[order], (impact[at] * block.times[place])[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[first] >> np.uint64(16)).astype(np.int64), (keys[first] & np.uint64(ROWS - 1)).astype(np.int64), np.add.reduceat(value, first)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP) -> DataFrame:
    """(the item's id, rank, doc_id, score) of each item's `top` best documents with a score above 0."""
    sc = docs.sparkSession.sparkContext
    shared.prepare(docs.sparkSession)
    asked = items.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text"))
    n_bytes = asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n_blocks = max(1, math.ceil(n_bytes / BLOCK))
    block_of = F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks))
    kind = items.schema[item_col].dataType.simpleString()
    results = []
    for k in range(n_blocks):
        rows = sorted(((r.id, r.text) for r in asked.where(block_of == k).collect()), key=str)
        block = Index(rows)
        index = sc.broadcast(block)
        held, _ = shared.table(postings(docs, index, id_col, text_col))
        n_docs, total, df = statistics(held, len(block.hashes))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        best = best_of_parts(held, index, weights, n_docs, max(total, 1), top)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        few = best.withColumn("rank", F.row_number().over(Window.partitionBy("nth", F.floor(F.col("part") / PARTS)).orderBy(*order))).where(F.col("rank") <= top)
        ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("nth").orderBy(*order))).where(F.col("rank") <= top)
        names = docs.sparkSession.createDataFrame([(i, x) for i, x in enumerate(block.ids)], f"nth long, `{item_col}` {kind}")
        found = ranked.join(F.broadcast(names), "nth").select(item_col, "rank", "doc_id", "score")
        results.append(found if n_blocks == 1 else shared.table(found)[0])
        if n_blocks > 1:
            index.destroy()
    out = results[0]
    for r in results[1:]:
        out = out.union(r)
    return out
