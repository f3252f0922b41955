"""Queries of incremental ingestion and of the analytics that its tables are for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergewell.operators import incremental as Inc
from mergewell.plans.catalogue import query, table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("source"), F.col("ts").alias("played_at"), F.col("event_id").alias("ord"))


@query("SELECT max(ts) AS latest FROM events")
def latest_timestamp(spark: SparkSession, d: str) -> DataFrame:
    return Inc.latest(_events(spark, d))




@query("""
WITH b AS (SELECT to_timestamp(floor((epoch(min(ts)) + epoch(max(ts))) / 2))::TIMESTAMP AS lo, max(ts) AS hi FROM events),
stored AS (SELECT user_id, event_type, ts FROM events WHERE event_id % 10 = 0),
twice AS (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 4 = 0)
SELECT min(event_id) AS event_id, user_id, event_type AS source, ts AS played_at FROM twice e, b
WHERE ts > lo AND ts <= hi AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.user_id = e.user_id AND s.event_type = e.event_type AND s.ts = e.ts) GROUP BY user_id, event_type, ts""")
def new_events_window(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    lo, hi = e.agg(F.timestamp_seconds(F.floor((F.unix_micros(F.min("played_at").cast("timestamp")) + F.unix_micros(F.max("played_at").cast("timestamp"))) / 2e6)), F.max("played_at")).first()
    fetched = e.unionByName(e.where("event_id % 4 = 0"))
    stored = e.where("event_id % 10 = 0")
    return Inc.new_events(fetched, stored, F.lit(lo), F.lit(hi)).select("event_id", "user_id", "source", "played_at")


@query("""
WITH stored AS (SELECT * FROM events WHERE event_id % 10 = 0 AND ts < TIMESTAMP '2024-01-16'),
mark AS (SELECT user_id, event_type, max(ts) AS latest FROM stored GROUP BY ALL)
SELECT event_id, coalesce(ts <= latest, false) AS late FROM events e LEFT JOIN mark USING (user_id, event_type)
WHERE coalesce(ts > latest, true) OR NOT EXISTS (SELECT 1 FROM stored s WHERE s.user_id = e.user_id AND s.event_type = e.event_type AND s.ts = e.ts)""")
def late_events(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth event of the first half month is stored; of the others, those before the last
    one stored of their user and type are late."""
    e = _events(spark, d)
    stored = e.where("event_id % 10 = 0 AND played_at < '2024-01-16'")
    none = spark.createDataFrame([], "user_id long, source string, latest timestamp")
    fresh, late = Inc.split_late(e, Inc.advance(none, stored), stored)
    return fresh.select("event_id", F.lit(False).alias("late")).unionByName(late.select("event_id", F.lit(True).alias("late")))


@query("""
SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.event_id % 3 = 0 AND s.user_id = e.user_id AND s.event_type = e.event_type AND s.ts = e.ts)""")
def play_event_exists_anti(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return Inc.new_events(e, e.where("event_id % 3 = 0"), by=("user_id", "source", "played_at")).select("event_id")


@query("""
WITH stored AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS target_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 4 = 0)
SELECT o_custkey AS user_id, l_partkey AS target_id, min(l_orderkey) AS ord FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE (o_custkey, l_partkey) NOT IN (SELECT (user_id, target_id) FROM stored) GROUP BY ALL""")
def library_item_dedupe(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    items = items.select(F.col("o_custkey").alias("user_id"), F.lit("recording").alias("target_type"), F.col("l_partkey").alias("target_id"), F.col("l_orderkey").alias("ord"))
    return Inc.new_library_items(items, items.where("ord % 4 = 0").dropDuplicates(["user_id", "target_type", "target_id"])).select("user_id", "target_id", "ord")


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 't' || (event_id % 100) END AS track_id,
  CASE WHEN event_id % 5 <> 0 AND event_id % 2 = 0 THEN NULL ELSE 'r' || (event_id % 50) END AS recording_id FROM events""")
def rebind_events(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    e = _events(spark, d).select(k, F.when((k % 2 == 0) & (k % 5 != 0), F.concat(F.lit("ct"), (k % 100).cast("string"))).alias("track_claim_id"), F.concat(F.lit("cr"), (k % 50).cast("string")).alias("recording_claim_id"))
    made = spark.range(100).select(F.explode(F.array(F.struct(F.concat(F.lit("ct"), F.col("id").cast("string")).alias("claim_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("entity_id")), F.struct(F.concat(F.lit("cr"), F.col("id").cast("string")).alias("claim_id"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("entity_id")))).alias("x")).select("x.*")
    return Inc.rebind(e, made).select("event_id", "track_id", "recording_id")


@query("""
SELECT CAST(year(o_orderdate) // 10 * 10 AS INTEGER) AS decade, count(DISTINCT o_orderkey) AS sets, CAST(sum(l_quantity) AS BIGINT) AS plays FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def sets_by_decade(spark: SparkSession, d: str) -> DataFrame:
    """Saved sets by decade with their plays."""
    plays = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("plays"))
    o = table(spark, d, "orders").select("o_orderkey", (F.floor(F.year("o_orderdate") / 10) * 10).cast("int").alias("decade"))
    return o.join(plays, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("decade").agg(F.count("*").alias("sets"), F.sum("plays").cast("long").alias("plays"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def saved_without_plays(spark: SparkSession, d: str) -> DataFrame:
    """Customers as saved items, their urgent finished orders as plays."""
    plays = table(spark, d, "orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").select("c_custkey").join(plays.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""
SELECT s_suppkey, count(l_orderkey) AS plays, min(l_shipdate) AS first_play FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1""")
def artist_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Plays of every artist, zeros included. Plays are summed before they meet the artists."""
    plays = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first_play"))
    met = table(spark, d, "supplier").select("s_suppkey").join(plays, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return met.select("s_suppkey", F.coalesce("n", F.lit(0)).alias("plays"), "first_play")


def _scrobbles(spark: SparkSession, d: str) -> DataFrame:
    """Events as scrobbles of parts: brand is the artist, type the album, name the title."""
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    n = parts.count()
    e = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("timestamp").alias("played_at"), (F.col("event_id") % n + 1).alias("k"))
    text = lambda c: F.lit(None).cast("string").alias(c)
    return e.join(parts, F.col("k") == F.col("p_partkey")).select(
        F.col("event_id").alias("ord"), "user_id", "played_at", F.lit(False).alias("now_playing"), F.col("p_brand").alias("artist"), text("artist_mbid"), text("artist_url"),
        F.col("p_type").alias("album"), text("release_mbid"), F.col("p_name").alias("title"), text("recording_mbid"), text("recording_url"),
    )


@query()
def ingest_play_events_e2e(spark: SparkSession, d: str) -> DataFrame:
    """The whole engine over all events against an empty store: each recording and its plays.
    Greedy deduplication and graph semantics have no SQL twin; tests check replay and models."""
    from mergewell.plans.engine import State, ingest_play_events
    from mergewell.sources.translate import scrobble_claims

    claims, rels, events = scrobble_claims(_scrobbles(spark, d))
    out = ingest_play_events(claims, rels, events, State.empty(spark))
    plays = out.state.play_events.groupBy(F.coalesce("track_id", "recording_id").alias("bound_to")).agg(F.count("*").alias("plays"))
    return plays
