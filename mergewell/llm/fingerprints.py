"""Document fingerprints from prefix polynomial hashes.

The code points of a text are one polynomial modulo 2**31 - 1, in two bases. Arrays of prefix
values answer whether any two spans are equal in constant time, and the longest common
extension of two positions by binary search. A fingerprint is the length, the hash of the
whole text and a sketch: hashes of all spans of SPAN code points fall into BUCKETS buckets and
each bucket keeps its smallest. Likeness of two fingerprints is 1 for equal whole hashes, else
the share of buckets that agree.

Cases: null text is the empty text; bytes that are not UTF-8 are read as U+FFFD; rows with equal
ids, and those without an id, which come last, follow one another by a hash of the text; a very
long text is hashed whole, alone in a worker's memory (some sixty times its bytes); empty texts have equal fingerprints; texts shorter than
SPAN use their whole hash as the only span; repeated rows and ids keep one result each;
extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergewell.llm import vec

P = (1 << 31) - 1
BASES = (911_382_323, 972_663_749)
SPAN, BUCKETS = 12, 64
EMPTY = 0x10000
#: Code points of text that a worker compares at a time.
HELD = 1 << 19
U64 = np.uint64
_LEAST = -(1 << 63)
_powers: dict[tuple[int, int], np.ndarray] = {}


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x & U64(P)) + (x >> U64(31))
    x = (x & U64(P)) + (x >> U64(31))
    x[x == P] = 0
    return x


def _pows(base: int, n: int) -> np.ndarray:
    for sign in (1, -1):
        key = (base, sign)
        have = _powers.get(key)
        if have is None or len(have) < n:
            b = pow(base, sign, P)
            out = np.ones(1, U64)
            while len(out) < max(n, 1 << 16):
                out = np.concatenate([out, _mod(out * U64(pow(b, len(out), P)))])
            _powers[key] = out
    return _powers[base, 1]


class PrefixHashes:
    """Prefix arrays over a sequence of code points (of one text or many in a row)."""

    def __init__(self, points: np.ndarray) -> None:
        self.n = len(points)
        self.prefix, self.down = [], []
        for base in BASES:
            up = _pows(base, self.n + 1)
            sums = np.zeros(self.n + 1, U64)
            np.cumsum(_mod((points.astype(U64) + U64(1)) * up[: self.n]), out=sums[1:])
            self.prefix.append(_mod(sums))
            self.down.append(_powers[base, -1])

    def spans(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        """Hash of each span in one of the two bases; depends on its code points alone."""
        h = self.prefix[which]
        return _mod(_mod(h[end] + U64(P) - h[start]) * self.down[which][start])

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the spans of these lengths at a and b are equal."""
        return (self.spans(a, a + length) == self.spans(b, b + length)) & (self.spans(a, a + length, 1) == self.spans(b, b + length, 1))

    def extend(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Longest common extension to the right of positions a and b, at most `most`."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(a, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def sketches(hashes: PrefixHashes, off: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Fingerprint of each row, and its buckets as a matrix."""
    rows = len(off) - 1
    size = np.diff(off)
    whole = [hashes.spans(off[:-1], off[1:], i) for i in (0, 1)]
    low = np.full(rows * BUCKETS, np.iinfo(U64).max, U64)
    at = np.arange(max(hashes.n - SPAN + 1, 0))
    row = np.repeat(np.arange(rows), size)[: len(at)]
    inside = at + SPAN <= off[1:][row]
    at, row = at[inside], row[inside]
    h = vec.mix(hashes.spans(at, at + SPAN))
    np.minimum.at(low, row * BUCKETS + (h & U64(BUCKETS - 1)).astype(np.int64), h)
    few = np.flatnonzero((size < SPAN) & (size > 0))
    h = vec.mix(whole[0][few] ^ (whole[1][few] << U64(31)))
    low[few * BUCKETS + (h & U64(BUCKETS - 1)).astype(np.int64)] = h
    table = np.where(low == np.iinfo(U64).max, EMPTY, (low >> U64(6)) & U64(0xFFFF)).astype(np.int64).reshape(rows, BUCKETS)
    texts = [f"{n}:{a:08x}{b:08x}:" for n, a, b in zip(size.tolist(), whole[0].tolist(), whole[1].tolist(), strict=True)]
    hexes = np.where(table == EMPTY, 0, table).astype(">u2").tobytes().hex()
    flags = np.packbits(table != EMPTY, axis=1).tobytes().hex()
    w, f = BUCKETS * 4, BUCKETS // 4
    return [t + flags[i * f : i * f + f] + hexes[i * w : i * w + w] for i, t in enumerate(texts)], table


def likeness(a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Share of the buckets in use that agree; 1 where the whole hashes are the same."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    agree = ((a == b) & (a != EMPTY)).sum(axis=1)
    return np.where(same, 1.0, agree / np.maximum(used, 1))


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, offsets of rows in them, bytes, byte place of every code point and the end)."""
    data, off = vec.valid_utf8(*vec.text_bytes(texts))
    place = np.flatnonzero((data & 0xC0) != 0x80)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return cp, np.searchsorted(place, off), data, np.append(place, len(data))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, n_chars and fingerprint of every row; one narrow stage."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, "text"):
                cp, off, _, _ = _points(part.column(1))
                prints, _ = sketches(PrefixHashes(cp), off)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off)), pa.array(prints, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_chars long, fingerprint string")
    return out.withColumnRenamed("doc_id", id_col)


def in_descending_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (bucket, doc_id, tail, text as bytes), a bucket a task: whole runs of the descending
    order of `id_col` (ties by a hash of the text, null ids last). Within a bucket a row's
    successor is the next row, and the successor of the last is there as a copy, tail = 1.

    Buckets are cut at quantiles of the ids, as many as there are shuffle partitions, so the
    text moves once. An id that holds more than a bucket's share of the rows, or null, is cut
    further by the hash. Only the buckets' first rows, some three a partition, come to the driver.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    total, nulls, cuts = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 20 * parts)).first()
    share = max(1, total // parts)
    often = rows.where("doc_id is not null").groupBy("doc_id").count().where(F.col("count") > share).collect()
    cuts = sorted({*(cuts or []), *(r[0] for r in often), *(r[0] - 1 for r in often if r[0] > _LEAST)})
    # Cuts at or above the id, by block and then within the block: two square roots of their number.
    step = max(1, math.isqrt(len(cuts)))
    longs = lambda xs: F.array(*[F.lit(c).cast("long") for c in xs]) if xs else F.array().cast("array<long>")
    block = F.size(F.filter(longs(cuts[step - 1 :: step]), lambda c: c < F.col("doc_id")))
    below = block * step + F.size(F.filter(F.slice(longs(cuts), block * step + 1, step), lambda c: c < F.col("doc_id")))
    rows = rows.withColumn("main", F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - below))
    pieces = {len(cuts) - sum(c < r[0] for c in cuts): -(-r[1] // share) for r in often} | ({len(cuts) + 1: -(-nulls // share)} if nulls > share else {})
    sub = F.lit(0)
    if pieces:  # ranges of the hash
        k = F.coalesce(F.create_map(*[F.lit(x) for pair in pieces.items() for x in pair])[F.col("main")], F.lit(1))
        sub = F.least(F.floor((F.col("h") / float(1 << 64) + 0.5) * k).cast("int"), k - 1)
    rows = rows.withColumn("sub", sub)
    # The first row of a bucket has the greatest id and of those the smallest hash.
    firsts = rows.groupBy("main", "sub").agg(F.max(F.struct("doc_id", F.bitwise_not("h").alias("h"))).alias("f")).select("main", "sub", "f.doc_id", "f.h").collect()
    firsts = sorted((tuple(r) for r in firsts), key=lambda r: r[:2])
    lead = spark.createDataFrame([(m, s, i, (i - 1) % len(firsts), f, ~h) for i, (m, s, f, h) in enumerate(firsts)], "main int, sub int, bucket int, prior int, first long, first_h long")
    # The last bucket's tail is the very first row: prior of the first bucket is the last one.
    own = F.struct(F.col("bucket"), F.lit(0).alias("tail"))
    copy = F.struct(F.col("prior").alias("bucket"), F.lit(1).alias("tail"))
    places = F.when(F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("h") == F.col("first_h")), F.array(own, copy)).otherwise(F.array(own))
    dealt = rows.join(F.broadcast(lead), ["main", "sub"]).select("doc_id", "h", F.col("text").cast("binary").alias("text"), F.explode(places).alias("to")).select("to.bucket", "doc_id", "to.tail", "h", "text")
    dealt = dealt.repartitionById(max(1, len(firsts)), F.col("bucket"))
    return dealt.sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), "h", "text").select("bucket", "doc_id", "tail", "text")


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: n_chars, edited (the last third replaced by the start of the next row's
    text in descending order of id), the fingerprints of both, the likeness of the row's
    fingerprint to the edited text's and to the next row's, and the longest common extension
    of text and edited text from their starts."""

    def emit(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        """texts has one entry more: the successor of the last row."""
        n = len(ids)
        cp, off, data, place = _points(pa.array(texts, pa.binary()))
        own = PrefixHashes(cp)
        prints, table = sketches(own, off)
        size = np.diff(off)
        third = size[:n] // 3
        keep = size[:n] - third
        take = np.minimum(third, size[1:])
        raw = data.tobytes()
        pieces, digests = [], []
        for a, k, b, m in zip(off[:n].tolist(), keep.tolist(), off[1 : n + 1].tolist(), take.tolist(), strict=True):
            edited = raw[place[a] : place[a + k]] + raw[place[b] : place[b + m]]
            pieces.append(edited)
            digests.append(hashlib.sha256(edited).hexdigest())
        edited = pa.array(pieces, pa.binary()).cast(pa.string())
        ecp, eoff, _, _ = _points(edited)
        both = PrefixHashes(np.concatenate([cp[: off[n]], ecp]))
        eoff = eoff + off[n]
        common = both.extend(off[:n], eoff[:n], np.minimum(size[:n], np.diff(eoff)))
        eprints, etable = sketches(PrefixHashes(ecp), eoff - off[n])
        same = lambda x, y: np.array([p.split(":")[:2] == q.split(":")[:2] for p, q in zip(x, y, strict=True)])
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(size[:n]), pa.array(digests, pa.string()), pa.array(prints[:n], pa.string()), pa.array(eprints, pa.string()),
             pa.array(likeness(table[:n], etable, same(prints[:n], eprints))), pa.array(likeness(table[:n], table[1:], same(prints[:n], prints[1:]))), pa.array(common)],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"],
        )

    def run(batches: Iterator[pa.RecordBatch]):
        ids, texts, held = [], [], 0
        bucket, closed = None, True
        for batch in batches:
            for part in vec.slices(batch, "text", HELD):
                for b, i, tail, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if tail:
                        if not closed:  # the first tail is the successor of what came before
                            yield emit(ids, [*texts, text])
                            ids, texts, held, closed = [], [], 0, True
                        continue
                    if b == bucket and held > HELD:
                        yield emit(ids, [*texts, text])
                        ids, texts, held = [], [], 0
                    bucket, closed = b, False
                    ids.append(i)
                    texts.append(text)
                    held += len(text)

    return in_descending_order(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
    ).withColumnRenamed("doc_id", id_col)
