"""Linear work within array columns, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128


def let(x: Column, f) -> Column:
    """f(x), with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def before(values: Column, join) -> Column:
    """For each of an array of longs, `join` of 0 and all before it. Arrays are immutable, so the
    results of BLOCK values are put together at a time, and then those of the blocks."""
    start = F.struct(F.lit(0).cast("long").alias("acc"), F.array().cast("array<bigint>").alias("out"))

    def run(xs: Column) -> Column:
        return F.aggregate(xs, start, lambda s, x: F.struct(join(s["acc"], x).alias("acc"), F.concat(s["out"], F.array(s["acc"])).alias("out")))

    def blocks(xs: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
        return F.transform(at, lambda i: run(F.slice(xs, i * BLOCK + 1, BLOCK)))

    def whole(parts: Column) -> Column:
        offsets = run(F.transform(parts, lambda p: p["acc"]))["out"]
        return F.flatten(F.zip_with(parts, offsets, lambda p, o: F.transform(p["out"], lambda x: join(o, x))))

    none = F.array().cast("array<bigint>")
    return let(values, lambda xs: F.when(F.size(xs) == 0, none).otherwise(let(blocks(xs), whole)))
