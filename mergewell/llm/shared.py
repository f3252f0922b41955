"""Cutting lineage in the folder that all executors share, and meeting hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: A key with a HEAVY-th of all rows or more is dealt over SPLIT tasks.
HEAVY, SPLIT = 1000, 64
#: Parts whose counts are summed in one task.
PARTS = 1024


def prepare(spark: SparkSession) -> None:
    """Use the session's spark.checkpoint.dir. Where it is unset a local session makes a folder;
    on a cluster that is an error, since executors would not share it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder and read from there."""
    prepare(df.sparkSession)
    return df.checkpoint()


def table(df: DataFrame) -> tuple[DataFrame, int]:
    """The same rows, written as Parquet to the shared folder and reread, and their number. Rounds
    of joins need it: a checkpoint carries its estimated size along, which joins multiply from
    round to round."""
    spark = df.sparkSession
    prepare(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"]


def meet(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, total: int, by: Column) -> DataFrame:
    """`rows` joined to `facts` on `keys`. Facts have one row a key, and `weight` is how many of
    the `total` rows hold it. The keys with total / HEAVY rows or more, of which there can be
    HEAVY at most, are broadcast, and their rows are dealt over SPLIT tasks by a hash of `by`."""
    heavy = facts.where(F.col(weight) >= max(2, total // HEAVY)).select(*keys, F.lit(True).alias("_hot"))
    salt = F.pmod(F.xxhash64(by), F.lit(SPLIT)).cast("int")
    left = rows.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    every = F.sequence(F.lit(0), F.when(F.col(weight) >= max(2, total // HEAVY), SPLIT - 1).otherwise(0))
    right = facts.withColumn("_salt", F.explode(every))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def before(runs: DataFrame, keys: list[str], part: str, n: str) -> DataFrame:
    """`runs`, one row a key and part, with `_before`: the sum of `n` of the key's earlier parts, and
    `_total`, that of all. Parts are summed PARTS at a time and then by these blocks, so that a key
    in all parts is not one group of them."""
    blocked = runs.withColumn("_block", F.floor(F.col(part) / PARTS))
    earlier = lambda by, order: F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocked.groupBy(*keys, "_block").agg(F.sum(n).alias(n))
    blocks = blocks.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_block").alias("_b"), earlier(keys, "_block").alias("_base"), F.sum(n).over(Window.partitionBy(*keys)).alias("_total"))
    own = blocked.withColumn("_own", earlier([*keys, "_block"], part))
    same = F.col("_block") == F.col("_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return own.join(blocks, same).withColumn("_before", F.col("_base") + F.col("_own")).drop("_block", "_b", "_base", "_own", *[f"_{k}" for k in keys])
