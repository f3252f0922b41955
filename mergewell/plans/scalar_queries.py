"""Queries of scalar functions and payload translation over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergewell.functions import text as T
from mergewell.functions import values as V
from mergewell.plans.catalogue import query, table

#: SQL of normalized text, for oracles.
NORM = r"nullif(trim(regexp_replace(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\pP', '', 'g'), '\s+', ' ', 'g')), '')"
TITLE = r"trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {NORM.format('text')} AS normalized FROM documents")
def normalize_text_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normalized"))


@query(f"SELECT p_partkey, {TITLE.format('p_name')} AS title FROM part")
def normalize_title_part(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.normalize_title(F.col("p_name")).alias("title"))


@query(f"""
WITH x AS (SELECT p_partkey, {TITLE.format('p_name')} AS a, {TITLE.format("split_part(p_name, ' ', 1)")} AS b, {TITLE.format('p_type')} AS c FROM part)
SELECT p_partkey,
  CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 2 WHEN contains(a, b) OR contains(b, a) THEN 1 ELSE 0 END AS against_word,
  CASE WHEN a = '' OR c = '' THEN 0 WHEN a = c THEN 2 WHEN contains(a, c) OR contains(c, a) THEN 1 ELSE 0 END AS against_type FROM x""")
def title_match_score(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", T.title_score(F.col("p_name"), F.split("p_name", " ")[0]).alias("against_word"), T.title_score(F.col("p_name"), F.col("p_type")).alias("against_type"))


@query("""
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber <= 0 THEN 0 ELSE greatest(0, l_linenumber + 1 - abs(l_linenumber - CAST(l_quantity AS INTEGER))) END AS INTEGER) AS score
FROM lineitem""")
def track_count_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.track_count_score(F.col("l_linenumber"), F.col("l_quantity").cast("int")).alias("score"))


@query("SELECT p_partkey, CAST(floor(CAST(p_retailprice * 1000 AS BIGINT) / 2000.0) AS BIGINT) AS bucket, CAST(floor(-CAST(p_retailprice * 1000 AS BIGINT) / 2000.0) AS BIGINT) AS below FROM part")
def duration_bucket(spark: SparkSession, d: str) -> DataFrame:
    ms = F.round(F.col("p_retailprice") * 1000).cast("long")
    return table(spark, d, "part").select("p_partkey", V.duration_bucket(ms).alias("bucket"), V.duration_bucket(-ms).alias("below"))


_DATE_TEXT = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, ' %Y ') ELSE 'unknown' END"


def _date_text():
    day = F.col("o_orderdate")
    kind = F.col("o_orderkey") % 4
    return F.when(kind == 0, F.date_format(day, "yyyy-MM-dd")).when(kind == 1, F.date_format(day, "yyyy-MM")).when(kind == 2, F.date_format(day, " yyyy ")).otherwise("unknown")


@query(f"""
WITH x AS (SELECT o_orderkey, string_split(trim({_DATE_TEXT}), '-') AS p FROM orders)
SELECT o_orderkey, TRY_CAST(p[1] AS INTEGER) AS year,
  CASE WHEN TRY_CAST(p[1] AS INTEGER) IS NOT NULL THEN TRY_CAST(p[2] AS INTEGER) END AS month,
  CASE WHEN TRY_CAST(p[1] AS INTEGER) IS NOT NULL THEN TRY_CAST(p[3] AS INTEGER) END AS day FROM x""")
def partial_date_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", V.partial_date(_date_text()).alias("p")).select("o_orderkey", "p.year", "p.month", "p.day")


@query(f"""
WITH x AS (SELECT o_orderkey, string_split(trim({_DATE_TEXT}), '-') AS p FROM orders)
SELECT o_orderkey, make_date(TRY_CAST(p[1] AS INTEGER), coalesce(nullif(TRY_CAST(p[2] AS INTEGER), 0), 1), coalesce(nullif(TRY_CAST(p[3] AS INTEGER), 0), 1))::VARCHAR AS first_day
FROM x""")
def as_date(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "orders").select("o_orderkey", V.partial_date(_date_text()).alias("p"))
    return p.select("o_orderkey", V.as_date(F.col("p")).cast("string").alias("first_day"))


@query("SELECT page_id, 'url:free-download:' || regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS namespace, url AS value FROM pages")
def url_namespace_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", V.url_namespace(F.lit("free download"), F.col("url")).alias("namespace"), F.col("url").alias("value"))


_CODE = "CASE p_partkey % 4 WHEN 0 THEN ' ' || lpad(CAST(p_partkey AS VARCHAR), 12, '0') || ' ' WHEN 1 THEN lpad(CAST(p_partkey AS VARCHAR), 13, '9') WHEN 2 THEN 'CAT ' || CAST(p_partkey AS VARCHAR) ELSE '  ' END"


@query(f"""
WITH x AS (SELECT p_partkey, nullif(trim({_CODE}), '') AS code FROM part)
SELECT p_partkey, code, CASE WHEN regexp_full_match(code, '[0-9]{{12}}') THEN 'release:upc' WHEN regexp_full_match(code, '[0-9]{{13}}') THEN 'release:ean' WHEN code IS NOT NULL THEN 'release:barcode' END AS namespace FROM x""")
def barcode_type(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" "), F.lpad(k.cast("string"), 12, "0"), F.lit(" "))).when(k % 4 == 1, F.lpad(k.cast("string"), 13, "9")).when(k % 4 == 2, F.concat(F.lit("CAT "), k.cast("string"))).otherwise("  ")
    return table(spark, d, "part").select("p_partkey", T.blank_to_null(raw).alias("code"), V.barcode_namespace(raw).alias("namespace"))


@query("""
SELECT o_orderkey, CASE WHEN lower(substr(o_orderpriority, 3)) IN ('urgent', 'high') THEN lower(substr(o_orderpriority, 3)) ELSE 'other' END AS with_default,
  CASE WHEN lower(substr(o_orderpriority, 3)) IN ('urgent', 'high') THEN lower(substr(o_orderpriority, 3)) END AS without_default
FROM (SELECT o_orderkey, '  ' || substr(o_orderpriority, 3) AS o_orderpriority FROM orders)""")
def enum_map_with_default(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("  "), F.substring("o_orderpriority", 3, 100))
    names = ("urgent", "high")
    return table(spark, d, "orders").select("o_orderkey", V.from_vocabulary(raw, names, "other").alias("with_default"), V.from_vocabulary(raw, names).alias("without_default"))


@query("""
WITH x AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)
SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'primary' WHEN contains(lower(prev), 'feat') OR contains(lower(prev), 'ft.') OR contains(lower(prev), 'that') THEN 'featured' ELSE 'unknown' END AS role FROM x""")
def credit_role_conversations(spark: SparkSession, d: str) -> DataFrame:
    prev = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    # Turns stand for credits; "that" plays the part of a featuring phrase in these texts.
    joined = F.regexp_replace(F.lower("prev"), "that", "feat")
    return table(spark, d, "conversations").select("conv_id", "turn", prev.alias("prev")).select("conv_id", "turn", V.credit_role(F.col("turn"), joined).alias("role"))


@query("""
SELECT user_id, event_type AS namespace, min_by(event_id, event_id) AS value, count(*) AS seen FROM events GROUP BY user_id, event_type""")
def external_id_first_per_namespace(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.col("event_type").alias("namespace")).agg(F.min_by("event_id", "event_id").alias("value"), F.count("*").alias("seen"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""
SELECT 0 AS branch, p_partkey AS id, p_name AS name, 'recording' AS target_type FROM part
UNION ALL SELECT 1, o_orderkey, o_orderstatus, 'release_set' FROM orders
UNION ALL SELECT 2, s_suppkey, s_name, 'artist' FROM supplier""")
def library_union_all(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.lit(0).alias("branch"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("recording").alias("target_type"))
    sets = table(spark, d, "orders").select(F.lit(1).alias("branch"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"), F.lit("release_set").alias("target_type"))
    artists = table(spark, d, "supplier").select(F.lit(2).alias("branch"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("artist").alias("target_type"))
    return part.unionByName(sets).unionByName(artists)


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey / 3 ELSE c_custkey END::BIGINT AS resolved FROM customer")
def canonical_coalesce(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    canonical = F.when(k % 3 == 0, F.floor(k / 3))
    return table(spark, d, "customer").select("c_custkey", V.resolved_id(k, canonical).cast("long").alias("resolved"))


@query("""
SELECT l_orderkey, max(l_linenumber)::BIGINT AS explicit, coalesce(nullif(sum(CASE WHEN l_quantity > 25 THEN CAST(l_quantity AS BIGINT) ELSE 0 END), 0), NULL)::BIGINT AS from_media
FROM lineitem GROUP BY l_orderkey""")
def release_track_count(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").cast("long").alias("explicit"), F.collect_list(F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("int")).otherwise(0)).alias("media"))
    return g.select("l_orderkey", "explicit", V.track_count(F.lit(None).cast("int"), F.col("media")).cast("long").alias("from_media"))


@query("""
SELECT o_orderkey, 'musicbrainz:release' AS namespace, 'musicbrainz' AS provider FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, 'url:shop:example.org', NULL FROM orders WHERE o_orderkey % 2 = 1""")
def provider_of_namespace(spark: SparkSession, d: str) -> DataFrame:
    ns = F.when(F.col("o_orderkey") % 2 == 0, "musicbrainz:release").otherwise("url:shop:example.org")
    return table(spark, d, "orders").select("o_orderkey", ns.alias("namespace")).withColumn("provider", V.provider_for(F.col("namespace")))
