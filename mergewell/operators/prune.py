"""Stored rows that a batch can meet, filtered where they are read.

A batch is small beside the store, so what it asks for is known to the scan before anything is
shuffled or grouped: its keys themselves where they are few, else a Bloom filter of them, which
lets some strangers pass and misses none. The joins and counts that follow stay as they are.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A store that Spark takes to be smaller than this many bytes is read as it is.
SMALL = 16 << 20
#: Estimates from here on are products of joins, not sizes; such frames are read as they are, too.
UNKNOWN = 1 << 60
#: Keys that are broadcast as they are; a key is some 100 bytes.
EXACT = 20_000
#: Bits of a filter for each key, rounded up to a power of two, and the most of all (2 MB): a filter
#: is part of every task that reads the store, and the driver holds some copies of it.
BITS_PER_KEY, MOST_BITS = 16, 1 << 24
#: A store of less than so many bytes for each key of the batch has few more rows than the batch:
#: a filter would let most of it pass. From MANY keys on a filter is large, and so must the store be.
BYTES_PER_KEY, MANY, BYTES_PER_KEY_OF_MANY = 16, 1 << 18, 256
#: Beyond so many keys a filter of MOST_BITS lets more than a fifth of all strangers pass; such a
#: batch is not small beside any store.
MOST_KEYS = MOST_BITS // 4
#: Bits that a key sets in its word of 64.
_SET = 5


def _word(by: list[str], words: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), *by), F.lit(words)).cast("int")


def _mask(by: list[str]) -> Column:
    h = F.xxhash64(F.lit(23), *by)
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 6 * i), F.lit(64)).cast("int"))
    return reduce(Column.bitwiseOR, map(one, range(_SET)))


def bloom(keys: DataFrame, by: list[str], n: int) -> Column:
    """A condition on the columns `by`: true for all of the n `keys`, and for few others. A key has
    a few bits in one word, so that the filter stands in the condition once. It is put together on
    the executors as words of bits; these come to the driver, at most MOST_BITS whatever the number
    of keys, and are the value of a scalar subquery: a literal would be printed in hexadecimal
    wherever Spark tells a plan."""
    words = min(MOST_BITS, max(1 << 10, 1 << (BITS_PER_KEY * n - 1).bit_length())) // 64
    held = keys.groupBy(_word(by, words).alias("word")).agg(F.bit_or(_mask(by)).alias("set"))
    raw = np.zeros(words, ">i8")
    for batch in held.toArrow().to_batches():
        raw[np.asarray(batch.column(0))] = np.asarray(batch.column(1)).astype(">i8")
    bits = keys.sparkSession.createDataFrame(pa.table({"bits": [raw.tobytes()]})).scalar()
    own = F.conv(F.hex(F.substr(bits, _word(by, words) * 8 + 1, F.lit(8))), 16, -10).cast("long")
    return own.bitwiseAND(_mask(by)) == _mask(by)


def _size(df: DataFrame) -> float:
    """Bytes, as Spark estimates them; estimates of joins can have thousands of digits."""
    return _bytes(df._jdf.queryExecution().optimizedPlan())


def _bytes(plan) -> float:
    try:
        return plan.stats().sizeInBytes()
    except ValueError:
        return math.inf


def _read(df: DataFrame) -> float:
    """Bytes of what it is made from, which tells more of a join than the product of both sides."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(_bytes(leaves.apply(i)) for i in range(leaves.size()))


def meeting(stored: DataFrame, batch: DataFrame, by: list[str]) -> DataFrame:
    """Rows of `stored` whose `by`, none of them null, may be in `batch`; all that are. The batch is
    read twice, so it should be written or cheap."""
    size = _size(stored)
    if not SMALL <= size < UNKNOWN or (read := min(size, _read(stored))) < SMALL:
        return stored
    keys = batch.select(*by).dropna()
    n = keys.count()  # with repeats, which only makes the filter larger
    if n <= EXACT:
        return stored.join(F.broadcast(keys), by, "left_semi")
    few = read / (BYTES_PER_KEY if n < MANY else BYTES_PER_KEY_OF_MANY)
    return stored if n > min(MOST_KEYS, few) else stored.where(bloom(keys, by, n))
