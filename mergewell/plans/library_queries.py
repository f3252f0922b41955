"""Queries of cascades, landed pages, facets and absorbed facts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergewell import schemas
from mergewell.operators import browse as B
from mergewell.operators import commands as C
from mergewell.operators import merge as M
from mergewell.plans.catalogue import query, table
from mergewell.plans.engine import State
from mergewell.plans.workflows import ingest_library
from mergewell.sources import landing


@query("""
WITH RECURSIVE owns AS (
  SELECT 'r' || n_regionkey AS owner_id, 'n' || n_nationkey AS id FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION ALL SELECT 'o' || l_orderkey, 'l' || l_orderkey || '-' || l_linenumber FROM lineitem),
gone AS (SELECT 'r' || r_regionkey AS id FROM region WHERE r_regionkey % 3 = 1 UNION SELECT 'n3' UNION SELECT o.id FROM gone g JOIN owns o ON o.owner_id = g.id)
SELECT DISTINCT id FROM gone""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Regions own nations, these customers, these orders and these their lines."""
    named = lambda p, *c: F.concat(F.lit(p), F.concat_ws("-", *[F.col(x).cast("string") for x in c]))
    pair = lambda t, a, b: table(spark, d, t).select(a.alias("owner_id"), b.alias("id"))
    owns = pair("nation", named("r", "n_regionkey"), named("n", "n_nationkey")).unionByName(pair("customer", named("n", "c_nationkey"), named("c", "c_custkey")))
    owns = owns.unionByName(pair("orders", named("c", "o_custkey"), named("o", "o_orderkey"))).unionByName(pair("lineitem", named("o", "l_orderkey"), named("l", "l_orderkey", "l_linenumber")))
    roots = table(spark, d, "region").where("r_regionkey % 3 = 1").select(named("r", "r_regionkey").alias("id"))
    return C.cascade(roots.unionByName(table(spark, d, "nation").where("n_nationkey = 3").select(named("n", "n_nationkey").alias("id"))), owns)


@query("""
WITH pages AS (SELECT c_custkey AS key, o_orderdate AS got, o_orderkey::VARCHAR AS payload FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 = 0),
fresh AS (SELECT key, max_by(payload, (got, payload)) AS payload FROM pages WHERE got <= TIMESTAMP '1998-06-01' AND got > TIMESTAMP '1998-06-01' - INTERVAL 700 DAY GROUP BY key)
SELECT c_custkey, payload IS NOT NULL AS hit, payload FROM customer LEFT JOIN fresh ON key = c_custkey""")
def landed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Customers as requests; every third order as a page of its customer, fetched on its date."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey")
    pages = orders.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey").join(customer, "c_custkey")
    pages = pages.select(landing.request_key("c_custkey").alias("request_key"), F.col("o_orderdate").cast("timestamp").alias("fetched_at"), F.col("o_orderkey").cast("string").alias("payload"))
    hits, misses = landing.split(customer.withColumn("request_key", landing.request_key("c_custkey")), pages, F.lit("1998-06-01").cast("timestamp"), 700 * 86400)
    return hits.select("c_custkey", F.lit(True).alias("hit"), "payload").unionByName(misses.select("c_custkey", F.lit(False).alias("hit"), F.lit(None).cast("string").alias("payload")))


_FACETS = {"decade": "(year(o_orderdate) // 10 * 10)::VARCHAR", "month": "strftime(o_orderdate, '%Y-%m')", "type": "o_orderpriority", "status": "o_orderstatus", "minutes": "least(l_quantity::BIGINT // 10, 4)::VARCHAR"}


@query("WITH x AS (SELECT * FROM orders JOIN lineitem ON l_orderkey = o_orderkey) SELECT 'total' AS facet, NULL AS value, count(*) AS n, sum(l_quantity)::BIGINT AS plays FROM x "
       + " ".join(f"UNION ALL SELECT '{f}', {c}, count(*), sum(l_quantity)::BIGINT FROM x GROUP BY 2" for f, c in _FACETS.items()))
def faceted_browse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    by = {
        "decade": F.floor(F.year("o_orderdate") / 10) * 10, "month": F.date_format("o_orderdate", "yyyy-MM"), "type": F.col("o_orderpriority"),
        "status": F.col("o_orderstatus"), "minutes": F.least(F.floor(F.col("l_quantity").cast("long") / 10), F.lit(4)),
    }
    return B.facets(rows, by, F.sum("l_quantity").cast("long").alias("plays")).select("facet", "value", "n", "plays")


@query("""
WITH discs AS (SELECT l_orderkey AS release_id, l_linenumber % 2 AS disc, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS tracks, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT release_id, sum(n)::BIGINT AS n_tracks, string_agg(disc || '=' || tracks, ';' ORDER BY disc) AS discs FROM discs GROUP BY release_id""")
def drill_down(spark: SparkSession, d: str) -> DataFrame:
    """Orders as releases of two discs."""
    tracks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("release_id"), (F.col("l_linenumber") % 2).alias("disc_number"), F.col("l_linenumber").alias("track_number"), F.col("l_partkey").alias("recording_id"))
    one = lambda t: F.concat_ws(":", t["track_number"].cast("string"), t["recording_id"].cast("string"))
    disc = lambda x: F.concat_ws("=", x["disc_number"].cast("string"), F.array_join(F.transform(x["tracks"], one), ","))
    return B.drill_down(tracks).select("release_id", "n_tracks", F.array_join(F.transform("discs", disc), ";").alias("discs"))


@query("""
WITH x AS (SELECT p_partkey AS k, p_brand AS a, p_type AS b, p_size AS s,
  CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE p_type END AS text_in, CASE WHEN p_partkey % 4 > 0 THEN p_size + 1 END AS value_in FROM part)
SELECT k, CASE k % 5 WHEN 0 THEN 'artist' WHEN 1 THEN 'release_set' WHEN 2 THEN 'label' WHEN 3 THEN 'release' ELSE 'recording' END AS entity_type,
  CASE WHEN k % 3 = 2 THEN text_in ELSE a END AS text_fact, coalesce(value_in, s) AS value_fact,
  CASE WHEN k % 5 = 2 OR k % 5 = 3 THEN NULL WHEN k % 6 = 0 THEN a || '|' || b ELSE a || '|' || b || '|new' END AS list_fact FROM x""")
def absorb_facts_by_type(spark: SparkSession, d: str) -> DataFrame:
    """A text, a value and a list of each type of entity, absorbed by their rules."""
    kinds = ["artist", "release_set", "label", "release", "recording"]
    text = {"artist": "sort_name", "release_set": None, "label": "country", "release": "format", "recording": "version"}
    value = {"artist": "formed_year", "release": "medium_count"}
    lists = {"artist": "aliases", "release_set": "secondary_types", "recording": "aliases"}
    k = F.col("p_partkey")
    part = table(spark, d, "part").withColumn("kind", F.element_at(F.array(*[F.lit(x) for x in kinds]), (k % 5 + 1).cast("int")))
    # Sets have no text among their facts and three types no number: these take another type's field, whose rule is the same.
    text = {t: f or "country" for t, f in text.items()}
    value = {t: value.get(t, "medium_count") for t in kinds}

    def facts(t: Column, v: Column, ls: Column):
        given = {**{f: [x for x in kinds if text[x] == f] for f in set(text.values())}, **{f: [x for x in kinds if value[x] == f] for f in set(value.values())}, **{f: [x for x in kinds if lists.get(x) == f] for f in set(lists.values())}}
        of = lambda f: t if f in text.values() else v if f in value.values() else ls
        return F.struct(*[(F.when(F.col("kind").isin(*given[f]), of(f)) if f in given else F.lit(None)).cast(ddl).alias(f) for f, ddl in schemas.FACT_TYPES.items()])

    text_in = F.when(k % 3 == 1, "  ").when(k % 3 == 2, F.col("p_type"))
    list_in = F.when(k % 6 == 0, F.array("p_type", "p_brand")).otherwise(F.array("p_type", F.lit("new"), F.lit("new")))
    held = part.select(k.alias("k"), F.col("kind").alias("entity_type"), facts(F.col("p_brand"), F.col("p_size"), F.array("p_brand", "p_type")).alias("a"), facts(text_in, F.when(k % 4 > 0, F.col("p_size") + 1), list_in).alias("b"))
    done = held.withColumn("x", M.absorb_facts(F.col("a"), F.col("b")))
    pick = lambda by: F.coalesce(*[F.when(F.col("entity_type") == t, F.col(f"x.{f}")) for t, f in by.items()])
    return done.select("k", "entity_type", pick(text).alias("text_fact"), pick(value).alias("value_fact"), F.array_join(pick(lists), "|").alias("list_fact"))


@query("""
WITH t AS (SELECT p_partkey AS k, 'track ' || p_partkey AS name, p_brand AS lead, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS guest, 'album ' || p_brand AS album FROM part),
who AS (SELECT k, name, album, lead AS artist, 'primary' AS role FROM t UNION ALL SELECT k, name, album, guest, 'unknown' FROM t WHERE guest IS NOT NULL)
SELECT 'entity' AS what, 'recording' AS kind, name AS a, NULL AS b, k::BIGINT * 1000 AS n FROM t UNION ALL SELECT DISTINCT 'entity', 'artist', artist, NULL, NULL::BIGINT FROM who
UNION ALL SELECT DISTINCT 'entity', 'release_set', album, NULL, NULL::BIGINT FROM t UNION ALL SELECT DISTINCT 'entity', 'release', album, NULL, NULL::BIGINT FROM t
UNION ALL SELECT 'item', 'recording', name, NULL, NULL::BIGINT FROM t UNION ALL SELECT DISTINCT 'item', 'release_set', album, NULL, NULL::BIGINT FROM t
UNION ALL SELECT 'item', 'artist', p_brand, NULL, NULL::BIGINT FROM (SELECT DISTINCT p_brand FROM part)
UNION ALL SELECT 'edge', 'recording_contribution ' || role, name, artist, NULL::BIGINT FROM who
UNION ALL SELECT 'edge', 'release_track', album, name, NULL::BIGINT FROM t UNION ALL SELECT DISTINCT 'edge', 'release_set_release', album, album, NULL::BIGINT FROM t
UNION ALL SELECT DISTINCT 'edge', 'release_set_contribution', album, artist, NULL::BIGINT FROM who
UNION ALL SELECT 'code', 'recording:isrc', 'ISRC' || k, name, NULL::BIGINT FROM t WHERE k % 2 = 0""")
def ingest_library_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Parts as saved tracks, their brands as saved albums and followed artists: the entities, the
    edges by the names of their ends, the codes and the items that are stored. Albums drop in favour
    of those that the tracks before them tell of, and their codes with them."""
    credit, code, null = "struct<id:string,name:string>", "array<struct<namespace:string,value:string>>", F.lit(None)
    album_type = f"struct<id:string,name:string,ids:{code}>"
    one = lambda c: F.struct(F.concat(F.lit("a-"), c).alias("id"), c.alias("name")).cast(credit)
    ids = lambda name, c: F.array(F.struct(F.lit(name).alias("namespace"), c.alias("value"))).cast(code)
    none = F.array().cast(code)
    k, brand = F.col("p_partkey"), F.col("p_brand")
    album = F.concat(F.lit("album "), brand)
    part = table(spark, d, "part")
    tracks = part.select(
        F.lit(0).alias("branch"), k.cast("int").alias("ord"), F.lit("recording").alias("target_type"), F.concat(F.lit("t"), k.cast("string")).alias("id"), F.concat(F.lit("track "), k.cast("string")).alias("name"),
        (k * 1000).cast("long").alias("duration_ms"), F.array_compact(F.array(one(brand), F.when(k % 3 == 0, one(F.col("p_type"))))).alias("credits"),
        F.when(k % 2 == 0, ids("isrc", F.concat(F.lit("ISRC"), k.cast("string")))).otherwise(none).alias("ids"), F.struct(F.concat(F.lit("al-"), brand).alias("id"), album.alias("name"), none.alias("ids")).cast(album_type).alias("album"),
    )
    brands = part.groupBy("p_brand").agg(F.min("p_partkey").cast("int").alias("ord"))
    albums = brands.select(F.lit(1).alias("branch"), "ord", F.lit("release_set").alias("target_type"), F.concat(F.lit("al-"), brand).alias("id"), album.alias("name"), null.cast("long").alias("duration_ms"), F.array(one(brand)).alias("credits"), ids("upc", F.concat(F.lit("UPC"), brand)).alias("ids"), null.cast(album_type).alias("album"))
    artists = brands.select(F.lit(2).alias("branch"), "ord", F.lit("artist").alias("target_type"), F.concat(F.lit("a-"), brand).alias("id"), brand.alias("name"), null.cast("long").alias("duration_ms"), F.array().cast(f"array<{credit}>").alias("credits"), none.alias("ids"), null.cast(album_type).alias("album"))
    out, items, _ = ingest_library(tracks.unionByName(albums).unionByName(artists), "u", State.empty(spark), State.empty(spark).library_items)
    s = out.state
    name = s.entities.select("entity_id", "name")
    src, dst = (name.select(F.col("entity_id").alias(f"{e}_id"), F.col("name").alias(c)) for e, c in (("src", "a"), ("dst", "b")))
    nothing = lambda t: null.cast(t)
    entities = s.entities.select(F.lit("entity").alias("what"), F.col("entity_type").alias("kind"), F.col("name").alias("a"), nothing("string").alias("b"), F.col("duration_ms").alias("n"))
    stored = items.join(name.withColumnRenamed("entity_id", "target_id"), "target_id").select(F.lit("item").alias("what"), F.col("target_type").alias("kind"), F.col("name").alias("a"), nothing("string").alias("b"), nothing("long").alias("n"))
    kind = F.when(F.col("kind") == "recording_contribution", F.concat_ws(" ", "kind", "role")).otherwise(F.col("kind")).alias("kind")
    edges = s.edges.join(src, "src_id").join(dst, "dst_id").select(F.lit("edge").alias("what"), kind, "a", "b", nothing("long").alias("n"))
    codes = s.external_ids.where("namespace in ('recording:isrc', 'release:upc')").join(name, F.col("owner_id") == F.col("entity_id")).select(F.lit("code").alias("what"), F.col("namespace").alias("kind"), F.col("value").alias("a"), F.col("name").alias("b"), nothing("long").alias("n"))
    return entities.unionByName(stored).unionByName(edges).unionByName(codes)
