"""Substring deduplication with a count-min prefilter.

A window is WINDOW consecutive words. A window whose word sequence also starts in a document
with a smaller id is repeated, and every word under a repeated window goes; windows are judged
on the input.

1. Each window has an anchor, the GRAM-word sequence in it with the smallest hash. Equal
   windows have equal anchors, so the number of documents with an anchor is never less than
   the number with a window. Partitions sketch the anchors of their documents (count-min, two
   rows of cells; a partition's sketch is sent as its cells in use), the sketches are added up,
   and what is kept is one bit a cell: two or more.
2. Windows whose anchor is estimated once are left; no repeated window is among them. The
   others are grouped by 64-bit hashes of their words. Neighbouring windows with one anchor form a segment; equal
   segments are counted together, and only where an anchor has different segments do their
   single windows meet, each distinct segment once. So a passage that a third of all documents
   share costs a partial aggregate, and exact copies cost a row a segment.
3. Repeated windows return to their documents as ranges, and the covered words are removed.

The sketch is the only thing that is broadcast. Its size follows the input up to MAX_CELLS a
row (2 x 32 MB of bits); beyond that estimates get looser, results stay exact.

Cases: null text has no words; texts of fewer than WINDOW words lose none; rows with a null id
neither lose words nor take any; rows with equal ids don't take from each other (neither is
smaller); repeated rows get equal results; bytes that are not UTF-8 are words like others; a very
long text is one slice of its own, in memory some thirty times its bytes; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergewell.llm import membership, shared, vec

WINDOW, GRAM = 50, 9
_REKEY = 0x5DEECE66D
MIN_CELLS, MAX_CELLS = 1 << 20, 1 << 28
U64 = np.uint64


def _cells(anchors: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each anchor in each row of the sketch; rows follow one another."""
    return [(vec.mix(anchors ^ U64(salt)) & U64(cells - 1)).astype(np.int64) + r * cells for r, salt in enumerate((0x51ED, 0xC0FFEE))]


def _windows(data: np.ndarray, off: np.ndarray, window: int, gram: int):
    """(word hashes, index of each row's first word, word where each window starts, hash of
    each window's anchor, word where the anchor starts)."""
    starts, ends, first = vec.word_spans(data, off)
    words = vec.word_hashes(data, starts, ends)
    grams = vec.gram_hashes(words, gram)
    whole = vec.whole_grams(first, gram)
    head, at = vec.window_minima(grams[whole], whole, window - gram + 1)
    return words, first, whole[head], grams[whole[at]], whole[at]


def sketch(docs: DataFrame, cells: int, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Bits of the merged sketch: for each cell whether it counts two documents or more."""

    def count(batches):
        for batch in batches:
            for part in vec.slices(batch, "text"):
                _, first, head, anchor, _ = _windows(*vec.text_bytes(part.column(0)), window, gram)
                if not len(head):
                    continue
                row = np.searchsorted(first, head, side="right") - 1
                new = np.ones(len(head), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                row, anchor = row[new], anchor[new]
                order = np.lexsort((anchor, row))
                row, anchor = row[order], anchor[order]
                once = np.ones(len(row), bool)  # an anchor counts once in a document
                once[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                cell, n = np.unique(np.concatenate(_cells(anchor[once], cells)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    counted = docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1")
    words = counted.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell & 63 as int)))").alias("bits"))
    return membership.pack(words, 2 * cells // 64)


def _estimated_repeated(bits: np.ndarray, anchors: np.ndarray, cells: int) -> np.ndarray:
    hit = np.ones(len(anchors), bool)
    for cell in _cells(anchors, cells):
        hit &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return hit


def segments(docs: DataFrame, bits: np.ndarray, cells: int, window: int = WINDOW, gram: int = GRAM, mixed: membership.Members | None = None) -> DataFrame:
    """(doc_id, h, anchor, seg, start, n[, windows]): runs of n windows from word `start` on with
    one anchor that the sketch estimates repeated. With `mixed`, a set of anchors, only their runs,
    and windows are their hashes, 8 bytes each."""
    sc, hashes = docs.sparkSession.sparkContext, mixed is not None
    held, wanted = sc.broadcast(bits), sc.broadcast(mixed)

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, "text"):
                words, first, head, anchor, at = _windows(*vec.text_bytes(part.column(2)), window, gram)
                if not len(head):
                    continue
                row = np.searchsorted(first, head, side="right") - 1
                cut = np.ones(len(head), bool)
                cut[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
                begin = np.flatnonzero(cut)
                n = np.diff(np.append(begin, len(head)))
                hit = _estimated_repeated(held.value, anchor[begin], cells)
                if hashes:
                    hit &= wanted.value.maybe(anchor[begin])
                begin, n = begin[hit], n[hit]
                if not len(begin):
                    continue
                start, own = head[begin], row[begin]
                seg = vec.span_hashes(words, start, start + n - 1 + window)
                cols = [part.column(0).take(pa.array(own)), part.column(1).take(pa.array(own)), pa.array(anchor[begin].view(np.int64)), pa.array(seg.view(np.int64)), pa.array((start - first[own]).astype(np.int32)), pa.array(n.astype(np.int32))]
                if hashes:
                    each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
                    raw = vec.gram_hashes(words, window)[each].tobytes()
                    ends = np.concatenate([[0], np.cumsum(n) * 8]).astype(np.int32)
                    cols.append(pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)]))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "anchor", "seg", "start", "n", "windows"][: len(cols)])

    return docs.where("doc_id is not null").select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h long, anchor long, seg long, start int, n int" + ", windows binary" * hashes)


def _expand(batches):
    """One row for every window of a segment."""
    for batch in batches:
        raw = batch.column(batch.schema.get_field_index("windows"))
        n = np.diff(np.asarray(pa.Array.from_buffers(pa.int32(), len(raw) + 1, [None, raw.buffers()[1]], offset=raw.offset))) // 8
        keys = [batch.column(batch.schema.get_field_index(c)).take(pa.array(np.repeat(np.arange(len(raw)), n))) for c in ("anchor", "seg", "least")]
        flat = np.frombuffer(b"".join(x.as_py() for x in raw), np.int64)
        nth = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        for i in range(0, len(flat), 65536):
            yield pa.RecordBatch.from_arrays([*(k.slice(i, 65536) for k in keys), pa.array(flat[i : i + 65536]), pa.array(nth[i : i + 65536].astype(np.int32))], ["anchor", "seg", "least", "window", "nth"])


def repeated_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, cells: int | None = None) -> DataFrame:
    """(doc_id, h, ranges): for every document with repeated windows, arrays of the word where a
    run of them starts and the word after its last one. `docs` has doc_id, h and text."""
    if cells is None:
        size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        cells = min(MAX_CELLS, max(MIN_CELLS, 1 << math.ceil(math.log2(max(size, 8) / 8))))
    bits = sketch(docs, cells, window, gram)
    # Where all documents have the same words around an anchor, the smallest id decides. Only
    # anchors with several segments need their windows compared; a second pass hashes those.
    thin = shared.cut(segments(docs, bits, cells, window, gram))
    least = thin.groupBy("anchor", "seg").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    mixed, n_mixed = shared.table(least.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor"))
    full = segments(docs, bits, cells, window, gram, membership.members(mixed, n_mixed))
    segs = full.groupBy("anchor", "seg").agg(F.min("doc_id").alias("least"), F.any_value("windows").alias("windows"))
    apart = segs.join(mixed, "anchor", "left_semi").mapInArrow(_expand, "anchor long, seg long, least long, window long, nth int")
    earliest = apart.groupBy("anchor", "window").agg(F.min("least").alias("earliest"), F.max("least").alias("latest")).where("earliest < latest").drop("latest")
    single = apart.join(earliest, ["anchor", "window"]).where("earliest < least").groupBy("anchor", "seg").agg(F.collect_set("nth").alias("nths"))
    # Documents beyond the smallest lose the whole segment; the smallest loses single windows.
    # What is known of a segment is one row; it is put together before the occurrences meet it,
    # so theirs is the only join on that key and a segment that is everywhere can be split.
    known = least.join(single, ["anchor", "seg"], "left").where("least < most or nths is not null").select("anchor", "seg", "least", "nths")
    # The other key makes Spark deal out both sides for this join alone, which it can then split.
    other = F.col("seg").bitwiseXOR(F.lit(_REKEY)).alias("rekeyed")
    occurrences = thin.withColumn("rekeyed", other).join(known.select("anchor", other, "least", "nths"), ["anchor", "rekeyed"])
    spans = F.when(F.col("doc_id") > F.col("least"), F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + window).alias("b")))).otherwise(
        F.transform("nths", lambda i: F.struct((F.col("start") + i).alias("a"), (F.col("start") + i + window).alias("b")))
    )
    found = occurrences.select("doc_id", "h", spans.alias("spans")).where("size(spans) > 0")
    return found.groupBy("doc_id", "h").agg(F.flatten(F.collect_list("spans")).alias("ranges"))


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, cells: int | None = None) -> DataFrame:
    """`id_col`, kept (the words left, joined by one space), n_words and n_removed."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ranges = repeated_ranges(rows, window, gram, cells)
    # Same words from the same text: a row is known by its id and the hash of its text.
    marked = rows.join(ranges, ["doc_id", "h"], "left").select("doc_id", "text", "ranges")

    def cut(batches):
        for batch in batches:
            for part in vec.slices(batch, "text"):
                data, off = vec.text_bytes(part.column(1))
                starts, ends, first = vec.word_spans(data, off)
                edge = np.zeros(len(starts) + 1, np.int64)
                spans = part.column(2)
                flat = spans.flatten()
                size = np.asarray(spans.value_lengths().fill_null(0))
                base = np.repeat(first[:-1], size)
                np.add.at(edge, base + np.asarray(flat.field(0)), 1)
                np.add.at(edge, base + np.asarray(flat.field(1)), -1)
                keep = np.cumsum(edge[:-1]) == 0
                kept = np.concatenate([[0], np.cumsum(keep)])[first]
                s, n = starts[keep], (ends - starts)[keep] + 1
                ends_at = np.cumsum(n)
                out = data[np.minimum(np.arange(ends_at[-1] if len(n) else 0) - np.repeat(ends_at - n - s, n), max(len(data) - 1, 0))]
                out[ends_at - 1] = 32
                place = np.concatenate([[0], ends_at])[kept]
                text = pa.array([out[a : max(a, b - 1)].tobytes() for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)], pa.binary()).cast(pa.string(), safe=False)
                yield pa.RecordBatch.from_arrays([part.column(0), text, pa.array(np.diff(first)), pa.array(np.diff(first) - np.diff(kept))], ["doc_id", "kept", "n_words", "n_removed"])

    return marked.mapInArrow(cut, "doc_id long, kept string, n_words long, n_removed long").withColumnRenamed("doc_id", id_col)
