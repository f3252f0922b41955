"""Landed pages as a cache: requests that a fresh page answers are not made again.

A page is kept under the hash of its request, with the time it was fetched. Requests meet the
latest page that has not expired; the rest are fetched, each once, by tasks that share a limit of
calls, and what may be kept of them is added to the landing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergewell.operators.cut import folder
from mergewell.operators.prune import meeting
from mergewell.sources import payloads
from mergewell.sources.paged import RateLimit, retrying

PAGES = "request_key string, fetched_at timestamp, payload string"


def request_key(*options: str) -> Column:
    """Hash of a request's options (columns), in whatever order they are named."""
    return F.sha2(F.to_json(F.struct(*sorted(options)), {"ignoreNullFields": "false"}), 256)


def split(requests: DataFrame, pages: DataFrame, now: Column, ttl: int) -> tuple[DataFrame, DataFrame]:
    """(requests with fetched_at and payload of the latest page of at most `ttl` seconds, the
    requests that have none). Requests have a request_key."""
    fresh = pages.where((F.col("fetched_at") <= now) & (F.col("fetched_at") > F.timestamp_seconds(F.unix_micros(now) / 1e6 - ttl)))
    near = meeting(fresh, requests, ["request_key"])
    latest = near.groupBy("request_key").agg(F.max_by(F.struct("fetched_at", "payload"), F.struct("fetched_at", "payload")).alias("p")).select("request_key", "p.*")
    return requests.join(latest, "request_key"), requests.join(latest, "request_key", "left_anti")


def whole_scrobble_pages(pages: DataFrame) -> DataFrame:
    """Pages that may be kept: parsed, without an error, with nothing that plays now."""
    parsed = pages.withColumn("_page", F.from_json("payload", payloads.SCROBBLE_PAGE)).select("*", "_page.*")
    return payloads.cacheable(parsed).select(*pages.columns)


class Landing:
    """Pages in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, ttl: int, keep: Callable[[DataFrame], DataFrame] = lambda pages: pages) -> None:
        self.spark, self.path, self.ttl, self.keep = spark, path, ttl, keep
        spark.createDataFrame([], PAGES).write.mode("append").parquet(path)

    def pages(self) -> DataFrame:
        return self.spark.read.schema(PAGES).parquet(self.path)

    def through(self, requests: DataFrame, options: list[str], fetch: Callable[[dict], str | None], now: Column, calls: float | None = None, seconds: float = 1.0, lanes: int = 4) -> DataFrame:
        """`requests` with fetched_at and payload, from the landing or fetched: fetch gets a
        request's options and gives a page, or null. At most `calls` go out in `seconds`, dealt
        over the lanes; equal requests go out once."""
        asked = requests.withColumn("request_key", request_key(*options))
        hits, misses = split(asked, self.pages(), now, self.ttl)
        once = misses.select("request_key", *options).dropDuplicates(["request_key"])

        def run(batches):
            limit = RateLimit(1, seconds * lanes / calls) if calls else None

            def call(request: dict) -> str | None:
                if limit is not None:
                    limit.wait()
                return fetch(request)

            for batch in batches:
                rows = batch.to_pylist()
                got = [retrying(lambda r=r: call({o: r[o] for o in options})) for r in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], ["request_key", "payload"])

        # What was fetched is written before anything reads it, so no page is fetched twice.
        held = f"{folder(self.spark)}/fetched-{uuid.uuid4().hex}"
        once.repartition(lanes, "request_key").mapInArrow(run, "request_key string, payload string").withColumn("fetched_at", now).write.parquet(held)
        fetched = self.spark.read.schema(PAGES).parquet(held).select("request_key", "fetched_at", "payload")
        self.keep(fetched.where("payload is not null")).write.mode("append").parquet(self.path)
        return hits.unionByName(misses.join(fetched, "request_key")).drop("request_key")
