"""Repeated passages by sparse suffix arrays.

A passage that repeats has MATCH words or more. Each window of MATCH words belongs to the
GRAM-word sequence in it with the smallest hash, so equal windows belong to equal sequences at
the same place. Only these positions are kept, each with the run of windows that belong to it;
the hash of the words under the run is its kind. Positions are sorted (by the hashed GRAM words,
then kind, document and place) over the cluster in ranges, so a passage in a third of all
documents is cut over many tasks, and members of a kind are tied to their neighbours, also across
range borders: all their windows are equal. Where the same GRAM words have several kinds, or may
have them beyond a range border, the single windows are hashed from the texts, sorted and tied in
the same way; of a kind in two documents or more the first and the last member stand for it there.
So every window that another document has is tied, whatever surrounds it. Matches of one pair of
documents at one distance join into runs.

Each member of a set of equal passages is tied to the nearest member of another document, past
those of its own, so links grow with the number of members, not its square.

Cases: null text has no words; rows with a null id are left out; rows with equal id and text
are one document; a passage repeated within one document is not reported unless another
document has it; ties sort by id, then by text hash; a very long text is one slice of its own, in
memory some thirty times its bytes; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergewell.llm import shared, vec
from mergewell.llm.arrays import before, let

MATCH, GRAM = 50, 26
U64 = np.uint64
_ROW = ["h", "kind", "doc", "t", "at", "n"]
_SCHEMA = "h long, kind long, doc long, t long, at int, n int"
_LINK, _EDGE, _MIXED = 0, 1, 2


def _suffixes(rows: DataFrame, match: int, gram: int) -> DataFrame:
    """(h, kind, doc, t, at, n): runs of n windows from word `at` on that belong to one position,
    the hash of its first words and of all words under the run."""

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, "text"):
                data, off = vec.text_bytes(part.column(2))
                starts, ends, first = vec.word_spans(data, off)
                words = vec.word_hashes(data, starts, ends)
                grams = vec.gram_hashes(words, gram)
                whole = vec.whole_grams(first, gram)
                head, low = vec.window_minima(grams[whole], whole, match - gram + 1)
                if not len(head):
                    continue
                head, low = whole[head], whole[low]
                cut = np.ones(len(head), bool)
                cut[1:] = low[1:] != low[:-1]
                begin = np.flatnonzero(cut)
                n = np.diff(np.append(begin, len(head)))
                head, low = head[begin], low[begin]
                own = np.searchsorted(first, head, side="right") - 1
                kind = vec.span_hashes(words, head, head + n - 1 + match)
                yield pa.RecordBatch.from_arrays([pa.array(grams[low].view(np.int64)), pa.array(kind.view(np.int64)), part.column(0).take(pa.array(own)), part.column(1).take(pa.array(own)), pa.array((head - first[own]).astype(np.int32)), pa.array(n.astype(np.int32))], _ROW)

    return rows.select("doc", "t", "text").mapInArrow(run, _SCHEMA)


def _windows(match: int):
    """The windows of each asked-for run, one a row, as _suffixes has them."""

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, "text", 1 << 21):
                data, off = vec.text_bytes(part.column(2))
                starts, ends, first = vec.word_spans(data, off)
                hashes = vec.gram_hashes(vec.word_hashes(data, starts, ends), match)
                asks = part.column(3)
                flat = asks.flatten()
                own = np.repeat(np.arange(part.num_rows), np.asarray(asks.value_lengths()))
                h, at, n = (np.asarray(flat.field(i)) for i in range(3))
                each = np.repeat(np.arange(len(n)), n)
                nth = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
                for i in range(0, len(each), 65536):
                    e, k = each[i : i + 65536], nth[i : i + 65536]
                    w = hashes[first[own[e]] + at[e] + k]
                    yield pa.RecordBatch.from_arrays([pa.array(h[e]), pa.array(w.view(np.int64)), part.column(0).take(pa.array(own[e])), part.column(1).take(pa.array(own[e])), pa.array((at[e] + k).astype(np.int32)), pa.array(np.ones(len(e), np.int32))], _ROW)

    return run


def _news(h, kind, doc, t):
    """Where the sorted rows have new first words, a new kind, a new document of a kind."""
    fresh = [np.ones(len(h), bool) for _ in range(3)]
    fresh[0][1:] = h[1:] != h[:-1]
    fresh[1][1:] = fresh[0][1:] | (kind[1:] != kind[:-1])
    fresh[2][1:] = fresh[1][1:] | (doc[1:] != doc[:-1]) | (t[1:] != t[:-1])
    return fresh


def _tie(h, kind, doc, t):
    """Row indices of sorted rows, each with the nearest one of its kind in another document: the
    last of the document before, for the first document of a kind the first of the next."""
    _, new_kind, new_doc = _news(h, kind, doc, t)
    begin = np.flatnonzero(new_doc)
    if not len(begin):
        return begin, begin
    follows = ~new_kind[begin]
    ahead = np.append(begin[1:], 0)  # the first row of the next document, where it has the kind
    known = follows | np.append(follows[1:], False)
    other = np.where(follows, begin - 1, ahead)
    own = np.cumsum(new_doc) - 1
    i = np.flatnonzero(known[own])
    return i, other[own[i]]


def _mixed(h, kind, doc, t, border: bool):
    """Row indices whose windows have to be compared one by one."""
    new_h, new_kind, new_doc = _news(h, kind, doc, t)
    at_h, at_kind = np.flatnonzero(new_h), np.flatnonzero(new_kind)
    kinds = np.add.reduceat(new_kind.astype(np.int64), at_h)
    several = np.zeros(len(at_h), bool)  # documents
    for c in (doc, t):
        several |= np.minimum.reduceat(c, at_h) != np.maximum.reduceat(c, at_h)
    open_ = border | ((kinds > 1) & several)
    size = np.diff(np.append(at_kind, len(h)))
    alone = np.repeat(np.add.reduceat(new_doc.astype(np.int64), at_kind) == 1, size)
    last = np.zeros(len(h), bool)
    last[at_kind + size - 1] = True
    return np.flatnonzero(np.repeat(open_, np.diff(np.append(at_h, len(h)))) & (alone | new_kind | last))


def _neighbours(expand: bool):
    """Of each sorted range the links, the members of its first and last document (edges), and
    with `expand` the runs whose windows have to be compared one by one."""
    names = ["what", *_ROW, "doc2", "t2", "apart"]

    def rows(what, cols, i, j=None):
        h, kind, doc, t, at, n = (c[i] for c in cols)
        other = [pa.array(doc if j is None else cols[2][j]), pa.array(t if j is None else cols[3][j]), pa.array(at - at if j is None else at - cols[4][j])]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), what, np.int32)), *(pa.array(c) for c in (h, kind, doc, t, at, n)), *other], names)

    def run(batches):
        held, first = [], True

        def flush(end: bool):  # whole groups of equal first words of this range
            nonlocal first
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            key = cols[:4]
            yield rows(_LINK, cols, *_tie(*key))
            groups = np.flatnonzero(_news(*key)[2])
            if first:
                yield rows(_EDGE, cols, np.arange(groups[1] if len(groups) > 1 else len(cols[0])))
            if end:
                yield rows(_EDGE, cols, np.arange(groups[-1], len(cols[0])))
            if expand:
                begin, last = (np.searchsorted(cols[0], cols[0][0], side="right") if first else 0), (np.searchsorted(cols[0], cols[0][-1]) if end else len(cols[0]))
                for a, b, border in ((0, begin, True), (begin, last, False), (max(begin, last), len(cols[0]), True)):
                    if a < b:
                        yield rows(_MIXED, cols, a + _mixed(*(c[a:b] for c in key), border))
            first = False

        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if held and held[-1][0][-1] != cols[0][-1] or not held and cut:
                if cut:
                    held.append([c[:cut] for c in cols])
                yield from flush(False)
                held = []
            held.append([c[cut:] if not held else c for c in cols])
        if held:
            yield from flush(True)

    return run


_NEIGHBOURS = f"what int, {_SCHEMA}, doc2 long, t2 long, apart int"


def _runs(match: int):
    """Links joined into runs: (doc_id, start, other_id, other_start, n_words)."""
    names, kinds = ["doc_id", "start", "other_id", "other_start", "n_words"], [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches):
        for batch in batches:
            doc, doc2, apart = (np.asarray(c.fill_null(0)) for c in batch.columns[:3])
            found = batch.column(3)
            row = np.repeat(np.arange(batch.num_rows), np.asarray(found.value_lengths()))
            at, n = (np.asarray(found.flatten().field(i)).astype(np.int64) for i in range(2))
            order = np.lexsort((at, row))
            row, at, end = row[order], at[order], (at + n)[order] - 1 + match
            far = np.maximum.accumulate(row << 32 | end)  # the furthest end so far in a row
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] << 32 | at[1:]) > far[:-1]
            begin = np.flatnonzero(new)
            size = (far[np.append(begin[1:], len(row)) - 1] & 0xFFFFFFFF) - at[begin] if len(begin) else begin
            row, at = row[begin], at[begin]
            out = [doc[row], at, doc2[row], at - apart[row], size]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(out, kinds, strict=True)], names)
            for edges in batch.column(4).to_pylist():
                if edges:  # a few of each range, all in one row
                    edge = sorted({tuple(x[c] for c in _ROW) for x in edges})
                    i, j = _tie(*(np.array(c, np.int64) for c in list(zip(*edge, strict=True))[:4]))
                    out = [(edge[x][2], edge[x][4], edge[y][2], edge[y][4], edge[x][5] - 1 + match) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)], names)

    return run


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", match: int = MATCH, gram: int = GRAM) -> DataFrame:
    """(doc_id, start, other_id, other_start, n_words): repeated passages of at least `match`
    words, in words from 0, each between a document and its neighbour in the order of suffixes."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Ranges don't part the places of one document.
    ordered = lambda df: df.repartitionByRange(parts, *_ROW[:4]).sortWithinPartitions(*_ROW[:5])
    whole = shared.cut(ordered(_suffixes(rows, match, gram)).mapInArrow(_neighbours(True), _NEIGHBOURS))
    asks = whole.where(F.col("what") == _MIXED).groupBy("doc", "t").agg(F.collect_set(F.struct("h", "at", "n")).alias("asks"))
    texts = rows.join(asks, ["doc", "t"]).select("doc", "t", "text", "asks")
    single = ordered(texts.mapInArrow(_windows(match), _SCHEMA)).mapInArrow(_neighbours(False), _NEIGHBOURS)
    links = whole.where(F.col("what") != _MIXED).union(single)
    # The edges spread over the same aggregate: one group of a few rows a range.
    edge = F.col("what") == _EDGE
    keys = [F.when(~edge, F.col(c)).alias(f"k_{c}") for c in ("doc", "t", "doc2", "t2", "apart")]
    grouped = links.groupBy(*keys).agg(F.collect_list(F.when(~edge, F.struct("at", "n"))).alias("found"), F.collect_list(F.when(edge, F.struct(*_ROW))).alias("edges"))
    return grouped.select("k_doc", "k_doc2", "k_apart", "found", "edges").mapInArrow(_runs(match), "doc_id long, start int, other_id long, other_start int, n_words int")


def per_document(found: DataFrame) -> DataFrame:
    """For each document with repeated passages: the ranges of repeated words (merged, as
    start:end joined by commas), how many words they hold and the documents it is tied to."""
    side = lambda d, s, o: F.struct(F.col(d).alias("doc_id"), F.col(s).alias("start"), (F.col(s) + F.col("n_words")).alias("end"), F.col(o).alias("other"))
    ends = found.select(F.explode(F.array(side("doc_id", "start", "other_id"), side("other_id", "other_start", "doc_id"))).alias("x")).select("x.*")
    lists = ends.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.collect_set("other")).alias("others"))
    # Ranges in order of their starts; one begins anew where all before it have ended.
    ended = before(F.transform("spans", lambda x: x["end"].cast("long") + 1), lambda a, x: F.greatest(a, x))
    begun = F.filter(F.zip_with("spans", ended, lambda x, e: F.struct(x["start"].alias("start"), (e - 1).cast("int").alias("ended"))), lambda x: x["start"] > x["ended"])
    last = F.array(F.array_max(F.transform("spans", lambda x: x["end"])))
    ends_of = lambda xs: F.concat(F.transform(F.slice(xs, 2, 2_000_000_000), lambda x: x["ended"]), last)
    merged = lists.select("doc_id", "others", let(begun, lambda xs: F.zip_with(xs, ends_of(xs), lambda x, e: F.struct(x["start"].alias("start"), e.alias("end")))).alias("spans"))
    return merged.select(
        "doc_id",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_repeated"),
        F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
        "others",
    )
