"""Which of many keys may be in a set: a bounded bitmap that every executor holds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergewell.llm import vec

#: 64 MB of bits; beyond some 30 million keys more strangers pass, no member is ever missed.
MIN_CELLS, MAX_CELLS, PER_KEY = 1 << 16, 1 << 29, 16
#: Words of 64 bits that come to the driver in one row.
CHUNK_BITS = 12
U64 = np.uint64


def pack(words: DataFrame, n_words: int) -> np.ndarray:
    """The bitmap of (word, bits) rows, one a word. It is put together in chunks on the executors,
    so that the driver gets its bytes and little else."""
    size = 1 << CHUNK_BITS

    def chunks(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                full = np.zeros(size, np.int64)
                at = batch.column(1)[i].values
                full[np.asarray(at.field(0)) & (size - 1)] = np.asarray(at.field(1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([full.tobytes()], pa.binary())], ["chunk", "raw"])

    grouped = words.groupBy(F.shiftright("word", CHUNK_BITS).alias("chunk")).agg(F.collect_list(F.struct("word", "bits")).alias("at"))
    out = np.zeros(-(-n_words // size) * size, np.int64)
    for batch in grouped.mapInArrow(chunks, "chunk long, raw binary").toArrow().to_batches():
        for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            out[chunk * size : (chunk + 1) * size] = np.frombuffer(raw.as_buffer(), np.int64)
    return out[:n_words].view(np.uint8)


class Members:
    """A set of keys (64-bit) that answers `maybe` for all of them and for few others."""

    def __init__(self, bits: np.ndarray, cells: int) -> None:
        self.bits, self.cells = bits, cells

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        hit = np.ones(len(keys), bool)
        for cell in places(keys, self.cells):
            hit &= (self.bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
        return hit


def places(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    return [(vec.mix(keys ^ U64(salt)) & U64(cells - 1)).astype(np.int64) for salt in (0xA11CE, 0xB0B, 0xCAB)]


def members(keys: DataFrame, count: int) -> Members:
    """The set of the only column of `keys`, a long, of which about `count` are expected. Nulls
    are in no set."""
    cells = min(MAX_CELLS, max(MIN_CELLS, 1 << (PER_KEY * count).bit_length()))

    def words(batches):
        for batch in batches:
            cell = np.concatenate(places(np.asarray(batch.column(0).drop_null()).view(U64), cells))
            word, at = np.unique(cell >> 6, return_inverse=True)
            bits = np.zeros(len(word), np.int64)
            np.bitwise_or.at(bits, at, np.left_shift(np.int64(1), cell & 63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits)], ["word", "bits"])

    found = keys.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return Members(pack(found, cells >> 6), cells)


def where_maybe(df: DataFrame, key: str, found: Members) -> DataFrame:
    """`df` with a column `maybe`: whether the key may be in the set; false for null. Only the key
    visits Python."""
    shared = df.sparkSession.sparkContext.broadcast(found)

    @F.arrow_udf("boolean")
    def maybe(keys: pa.Array) -> pa.Array:
        hit = shared.value.maybe(np.asarray(keys.fill_null(0)).view(U64))
        return pa.array(hit & np.asarray(keys.is_valid()))

    return df.withColumn("maybe", maybe(F.col(key)))
