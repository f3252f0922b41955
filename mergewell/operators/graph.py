"""Graphs of shared keys and of pointers, in rounds that follow the logarithm of their length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergewell.operators.cut import checkpointed


def components(rows: DataFrame) -> DataFrame:
    """(item, label): equal labels for the items that chains of shared keys connect. rows: item,
    key. Each round a label takes the one with the smallest hash under the round's function among
    those that share a key with it, and then what that one took, so that a constant share of the
    labels is left, whatever the order of items."""
    live = checkpointed(rows.select(F.col("item").alias("label"), "key").distinct())
    taken = []
    while True:
        hashed = F.struct(F.xxhash64(F.lit(len(taken)), "label").alias("h"), "label")
        low = live.groupBy("key").agg(F.min(hashed).alias("low"))
        near = live.join(low, "key").groupBy("label").agg(F.min("low").alias("low")).select("label", F.col("low.label").alias("to"))
        near = checkpointed(near)
        two = near.select(F.col("label").alias("to"), F.col("to").alias("then"))
        near = checkpointed(near.join(two, "to").select("label", F.col("then").alias("to")))
        taken.append(near)
        live = checkpointed(live.join(near, "label").select(F.col("to").alias("label"), "key").distinct())
        if live.groupBy("key").count().where("count > 1").isEmpty():
            break
    found = taken.pop()
    while taken:
        then = found.select(F.col("label").alias("to"), F.col("to").alias("then"))
        found = taken.pop().join(then, "to").select("label", F.col("then").alias("to"))
    return found.select(F.col("label").alias("item"), F.col("to").alias("label"))


def ends(pointers: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(ends, endless) of pointers (by, src, at), one of each src: where following them ends, and
    those that never do, with some place on their circle as `at`. `odd` is 1 where the way has an
    odd number of steps. Each round doubles all ways."""
    now = checkpointed(pointers.select(*by, "src", "at", F.lit(1).alias("odd")))
    rounds = now.count().bit_length() + 1  # no way that ends is longer than the pointers are many
    if rounds == 1:
        return now, now
    while True:
        then = now.select(*by, F.col("src").alias("at"), F.col("at").alias("_at"), F.col("odd").alias("_odd"))
        met = now.join(then, [*by, "at"], "left")
        odd = F.pmod(F.col("odd") + F.coalesce("_odd", F.lit(0)), F.lit(2)).alias("odd")
        met = checkpointed(met.select(*by, "src", F.coalesce("_at", "at").alias("at"), odd, F.col("_at").isNotNull().alias("moved")))
        now, left, rounds = met.drop("moved"), met.where("moved").drop("moved"), rounds - 1
        if not rounds or left.isEmpty():
            return met.where("not moved").drop("moved"), left
