"""Queries of lookups, reads, times and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergewell.functions import values as V
from mergewell.operators import merge as M
from mergewell.operators import policy as P
from mergewell.operators import resolve as R
from mergewell.operators import users as U
from mergewell.plans.catalog_queries import _REDIRECTS, _redirects
from mergewell.plans.catalogue import query, table
from mergewell.plans.engine import State
from mergewell.plans.scalar_queries import TITLE
from mergewell.plans.workflows import ingest_library
from mergewell.schemas import TABLES
from mergewell.sources import lookup

_PAD = "lpad({}::VARCHAR, 8, '0')"


def _id(c: str):
    return F.lpad(F.col(c).cast("string"), 8, "0")


@query(f"""
WITH asked AS (SELECT o_orderkey AS request_id, o_custkey * 2 AS k FROM orders),
moved AS (SELECT request_id, k, CASE WHEN k % 10 = 0 AND k IN (SELECT c_custkey FROM customer) THEN k + 1 ELSE k END AS spot FROM asked)
SELECT request_id, {_PAD.format('k')} AS requested, {_PAD.format('spot')} AS resolved, spot <> k AS redirected, c_custkey IS NOT NULL AS found, c_name AS name
FROM moved LEFT JOIN customer ON spot = c_custkey""")
def lookup_by_id(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.lpad((F.col("o_custkey") * 2).cast("string"), 8, "0").alias("mbid"))
    customer = table(spark, d, "customer")
    moved = customer.where("c_custkey % 10 = 0").select(_id("c_custkey").alias("source_value"), F.lpad((F.col("c_custkey") + 1).cast("string"), 8, "0").alias("target_value"))
    met = lookup.by_id(asked, customer.select(_id("c_custkey").alias("mbid"), F.col("c_name").alias("name")), moved)
    return met.select("request_id", "requested", "resolved", "redirected", "found", F.col("payload.name").alias("name"))


@query(f"""
WITH p AS (SELECT p_partkey, {_PAD.format('p_partkey')} AS mbid, {TITLE.format('p_name')} AS t, {TITLE.format('p_brand')} AS a FROM part),
met AS (SELECT r.p_partkey AS request_id, h.mbid, row_number() OVER (PARTITION BY r.p_partkey ORDER BY h.mbid) - 1 AS ord
  FROM p r JOIN p h ON r.t = h.t AND (r.p_partkey % 2 = 0 OR r.a = h.a) WHERE r.t <> '')
SELECT request_id, ord::INTEGER AS ord, mbid FROM met WHERE ord < 5""")
def lookup_search(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    asked = part.select(F.col("p_partkey").alias("request_id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 2 == 1, F.col("p_brand")).alias("artist"))
    rows = part.select(_id("p_partkey").alias("mbid"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"))
    return lookup.search(asked, rows).select("request_id", "ord", "mbid")


@query(f"""
SELECT request_id, ord::INTEGER AS ord, mbid FROM (
  SELECT c_nationkey AS request_id, {_PAD.format('c_custkey')} AS mbid, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS ord FROM customer)
WHERE ord < 25""")
def lookup_browse(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("request_id"), F.col("n_nationkey").alias("group_id"))
    rows = table(spark, d, "customer").select(_id("c_custkey").alias("mbid"), F.col("c_nationkey").alias("group_id"))
    return lookup.browse(asked, rows, "group_id").select("request_id", "ord", "mbid")


@query("""
SELECT release_id, string_agg(artist, '|' ORDER BY ord, artist) AS artists FROM (
  SELECT l_orderkey AS release_id, p_brand AS artist, min(l_linenumber) AS ord FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) GROUP BY 1""")
def artist_names_of_releases(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("artist"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("release_id"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("p_partkey")).join(part, "p_partkey")
    return lookup.artist_names(rows).select("release_id", F.array_join("artists", "|").alias("artists"))


@query("SELECT c_custkey::VARCHAR AS id, c_name AS display_name, NULL::VARCHAR AS email, NULL::VARCHAR AS spotify_user_id, c_mktsegment AS lastfm_user FROM customer WHERE c_custkey = 7")
def user_point_read(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("display_name"), *[F.lit(None).cast("string").alias(c) for c in ("email", "spotify_user_id")], F.col("c_mktsegment").alias("lastfm_user"))
    return U.get_user(users, "7").select(*[f.split()[0] for f in TABLES["user_account"].split(", ")])


_STRATEGY = "CASE l_returnflag WHEN 'A' THEN 'noop' WHEN 'R' THEN 'manual_review' ELSE 'create' END"


def _acted(spark: SparkSession, d: str) -> DataFrame:
    strategy = F.when(F.col("l_returnflag") == "A", "noop").when(F.col("l_returnflag") == "R", "manual_review").otherwise("create")
    return table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("subject"), strategy.alias("strategy"), F.col("l_linestatus").alias("reason"), "l_linenumber")


@query(f"SELECT 's' || l_suppkey AS subject, {_STRATEGY} AS strategy, l_linestatus AS reason, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2, 3")
def skip_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.skip_reasons(_acted(spark, d))


@query(f"""
SELECT 's' || l_suppkey AS subject, count(*) AS applied, count(*) FILTER ({_STRATEGY} = 'create') AS created, 0::BIGINT AS merged,
  count(*) FILTER ({_STRATEGY} = 'noop') AS skipped, count(*) FILTER ({_STRATEGY} = 'manual_review') AS manual_review FROM lineitem GROUP BY 1""")
def counters_over_runs(spark: SparkSession, d: str) -> DataFrame:
    acted = _acted(spark, d)
    runs = [M.counters(acted.where(f"l_linenumber % 2 = {i}")) for i in (0, 1)]
    return M.sum_counters(runs[0].unionByName(runs[1]))


@query(f"""
WITH RECURSIVE {_REDIRECTS}, ends AS (SELECT a, arg_max(b, len(seen)) AS b FROM walk WHERE namespace = 'isrc' GROUP BY a)
SELECT s_suppkey::VARCHAR AS claim_id, 'e' || (CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey ELSE e.b END)::VARCHAR AS entity_id
FROM supplier LEFT JOIN ends e ON s_suppkey = e.a WHERE s_suppkey > 0""")
def resolve_external_id_redirected(spark: SparkSession, d: str) -> DataFrame:
    """Odd suppliers own their number; even ones reach an owner through redirects."""
    supplier = table(spark, d, "supplier").where("s_suppkey > 0").select(F.col("s_suppkey").cast("string").alias("value"), "s_suppkey")
    owners = supplier.where("s_suppkey % 2 = 1").select(F.lit("isrc").alias("namespace"), "value", F.lit("recording").alias("owner_type"), F.concat(F.lit("e"), "value").alias("owner_id"))
    claims = supplier.select(F.col("value").alias("claim_id"), F.lit("recording").alias("entity_type"), F.lit(0).alias("pos"), F.lit("isrc").alias("namespace"), "value")
    return R.by_external_id(claims, owners, R.redirect_closure(_redirects(spark, d))).select("claim_id", "entity_id")


@query("""
SELECT o_orderkey, (epoch(o_orderdate::TIMESTAMP) - CASE WHEN o_orderkey % 3 = 1 THEN 7200 ELSE 0 END)::BIGINT AS seconds FROM orders""")
def iso_epoch_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Order dates as ISO texts with Z, with an offset and naive, read back."""
    tail = F.when(F.col("o_orderkey") % 3 == 0, "Z").when(F.col("o_orderkey") % 3 == 1, "+02:00").otherwise("")
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00"), tail)
    return table(spark, d, "orders").select("o_orderkey", V.epoch_seconds(V.iso_time(text)).alias("seconds"))


@query("SELECT count(*) AS fetched, count(DISTINCT s_nationkey) AS stored, count(*) - count(DISTINCT s_nationkey) AS skipped FROM supplier")
def ingest_library_e2e(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as followed artists, named by their nation's id: one item a nation is stored."""
    credit = "array<struct<id:string,name:string>>"
    ids = "array<struct<namespace:string,value:string>>"
    album = f"struct<id:string,name:string,ids:{ids}>"
    rows = table(spark, d, "supplier").select(
        F.lit(2).alias("branch"), F.col("s_suppkey").cast("int").alias("ord"), F.lit("artist").alias("target_type"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("id"), F.col("s_name").alias("name"),
        F.lit(None).cast("long").alias("duration_ms"), F.array().cast(credit).alias("credits"), F.array().cast(ids).alias("ids"), F.lit(None).cast(album).alias("album"),
    )
    stored = spark.createDataFrame([], "user_id string, target_type string, target_id string, source string")
    return ingest_library(rows, "u", State.empty(spark), stored)[2]
