"""Queries of catalog commands, endpoints, rewiring and provider payloads over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergewell import schemas
from mergewell.operators import commands as C
from mergewell.operators import dedupe as D
from mergewell.operators import incremental as Inc
from mergewell.operators import policy as P
from mergewell.operators import resolve as R
from mergewell.plans.catalogue import query, table
from mergewell.plans.ingest_queries import _scrobbles
from mergewell.sources import lookup, paged, payloads, translate

#: Lines as tracks of an order; a part may be on two lines of one order.
_TRACKS = "tracks AS (SELECT 'release_track' AS kind, l_orderkey AS src_id, l_partkey AS dst_id, l_orderkey * 10 + l_linenumber AS edge_id, l_linenumber AS n FROM lineitem)"


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    edge_id = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id")
    return line.select(F.lit("release_track").alias("kind"), F.col("l_orderkey").alias("src_id"), F.col("l_partkey").alias("dst_id"), edge_id, F.col("l_linenumber").alias("n"))


def _name(prefix: str, c: str) -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


@query(f"""
WITH {_TRACKS}, stored AS (SELECT * FROM tracks WHERE n = 1)
SELECT src_id, dst_id, edge_id FROM stored
UNION ALL SELECT src_id, dst_id, min(edge_id) FROM tracks WHERE (src_id, dst_id) NOT IN (SELECT (src_id, dst_id) FROM stored) GROUP BY src_id, dst_id""")
def command_add_edges(spark: SparkSession, d: str) -> DataFrame:
    tracks = _tracks(spark, d)
    return C.add_edges(tracks.where("n = 1").drop("n"), tracks.drop("n")).select("src_id", "dst_id", "edge_id")


@query(f"""
WITH {_TRACKS}, gone AS (SELECT src_id, CASE WHEN src_id % 4 = 0 THEN -dst_id ELSE dst_id END AS dst_id FROM tracks WHERE n = 2)
SELECT 'left' AS what, src_id, dst_id, edge_id FROM tracks WHERE (src_id, dst_id) NOT IN (SELECT (src_id, dst_id) FROM gone)
UNION ALL SELECT 'not there', src_id, dst_id, NULL FROM gone WHERE (src_id, dst_id) NOT IN (SELECT (src_id, dst_id) FROM tracks)""")
def command_remove_edges(spark: SparkSession, d: str) -> DataFrame:
    tracks = _tracks(spark, d)
    gone = tracks.where("n = 2").select("kind", "src_id", F.when(F.col("src_id") % 4 == 0, -F.col("dst_id")).otherwise(F.col("dst_id")).alias("dst_id"))
    left, missing = C.remove_edges(tracks.drop("n"), gone)
    left = left.select(F.lit("left").alias("what"), "src_id", "dst_id", "edge_id")
    return left.unionByName(missing.select(F.lit("not there").alias("what"), "src_id", "dst_id"), allowMissingColumns=True)


@query(f"""
WITH {_TRACKS} SELECT src_id, dst_id, edge_id FROM tracks WHERE src_id % 3 <> 0
UNION ALL SELECT o_orderkey, -o_custkey, -o_orderkey FROM orders WHERE o_orderkey % 3 = 0""")
def command_replace_edges(spark: SparkSession, d: str) -> DataFrame:
    owners = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("src_id"), "o_custkey")
    new = owners.select(F.lit("release_track").alias("kind"), "src_id", (-F.col("o_custkey")).alias("dst_id"), (-F.col("src_id")).alias("edge_id"))
    return C.replace_edges(_tracks(spark, d).drop("n"), owners, new, "release_track").select("src_id", "dst_id", "edge_id")


@query("""
WITH e AS (SELECT l_suppkey AS src_id, l_partkey AS dst_id, min(l_orderkey * 10 + l_linenumber) AS edge_id FROM lineitem GROUP BY ALL),
kept AS (SELECT * FROM e WHERE src_id % 2 = 1), moved AS (SELECT src_id - 1 AS src_id, dst_id, edge_id FROM e WHERE src_id % 2 = 0)
SELECT * FROM kept UNION ALL SELECT * FROM moved WHERE (src_id, dst_id) NOT IN (SELECT (src_id, dst_id) FROM kept)""")
def command_move_edges(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    edges = line.groupBy(F.col("l_suppkey").alias("src_id"), F.col("l_partkey").alias("dst_id")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"))
    moves = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("from_id"), (F.col("s_suppkey") - 1).alias("to_id"))
    return C.move_edges(edges.withColumn("kind", F.lit("release_track")), moves).select("src_id", "dst_id", "edge_id")


@query(f"""
WITH {_TRACKS} SELECT edge_id FROM (SELECT DISTINCT src_id, dst_id, edge_id FROM tracks) WHERE src_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0)
  OR dst_id NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0)""")
def command_orphans(spark: SparkSession, d: str) -> DataFrame:
    tracks = _tracks(spark, d).drop("n").withColumns({"src_id": _name("o", "src_id"), "dst_id": _name("p", "dst_id")})
    orders = table(spark, d, "orders").where("o_orderkey % 5 <> 0").select(_name("o", "o_orderkey").alias("entity_id"))
    parts = table(spark, d, "part").where("p_partkey % 7 <> 0").select(_name("p", "p_partkey").alias("entity_id"))
    return C.orphans(tracks, orders.unionByName(parts)).select("edge_id")


def _part_ids(spark: SparkSession, d: str, value: str) -> DataFrame:
    owner = [F.lit("recording").alias("owner_type"), F.col("p_partkey").alias("owner_id"), F.lit("isrc").alias("namespace")]
    return table(spark, d, "part").select(*owner, F.col(value).alias("value"))


@query("""
WITH stored AS (SELECT * FROM part WHERE p_partkey % 2 = 0)
SELECT 'id' AS what, p_partkey AS owner_id, p_brand AS value FROM stored
UNION ALL SELECT 'id', p_partkey, p_type FROM part WHERE p_partkey % 2 = 1
UNION ALL SELECT 'conflict', p_partkey, p_type FROM stored WHERE p_type <> p_brand""")
def command_put_external_ids(spark: SparkSession, d: str) -> DataFrame:
    stored = _part_ids(spark, d, "p_brand").where("owner_id % 2 = 0")
    ids, clash = C.put_external_ids(stored, _part_ids(spark, d, "p_type"))
    cols = ["owner_id", "value"]
    return ids.select(F.lit("id").alias("what"), *cols).unionByName(clash.select(F.lit("conflict").alias("what"), *cols))


@query("SELECT p_partkey AS owner_id, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS value FROM part WHERE p_partkey % 3 <> 0")
def command_replace_external_ids(spark: SparkSession, d: str) -> DataFrame:
    stored, new = _part_ids(spark, d, "p_brand"), _part_ids(spark, d, "p_type").where("owner_id % 2 = 0")
    ids, _ = C.put_external_ids(stored, new, replace=True)
    return C.remove_external_ids(ids, stored.where("owner_id % 3 = 0")).select("owner_id", "value")


@query("""
SELECT DISTINCT o_custkey AS user_id, CASE WHEN l_partkey % 2 = 0 THEN l_partkey - 1 ELSE l_partkey END AS target_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def command_retarget_items(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"))
    line = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("target_id"))
    items = line.join(orders, "l_orderkey").select("user_id", F.lit("recording").alias("target_type"), "target_id").distinct()
    moves = table(spark, d, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("from_id"), (F.col("p_partkey") - 1).alias("to_id"))
    return C.retarget_items(items.withColumn("source", F.lit("spotify")), moves).select("user_id", "target_id")


@query("SELECT event_id, CASE WHEN event_id % 20 < 10 THEN (event_id % 20) * 100 ELSE event_id % 20 END AS recording_id FROM events")
def command_rebind_plays(spark: SparkSession, d: str) -> DataFrame:
    plays = table(spark, d, "events").select("event_id", (F.col("event_id") % 20).alias("recording_id"))
    return C.rebind_plays(plays, spark.range(10).select(F.col("id").alias("from_id"), (F.col("id") * 100).alias("to_id")))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def command_foreign_rows(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("user_id"))
    return C.foreign(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id")), users).select("o_orderkey")


#: Orders and parts as resolved claims.
_CLAIMS = """
o AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'E' || o_orderkey WHEN 'O' THEN 'o' || o_orderkey END AS src_id FROM orders),
p AS (SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN 'p' || p_partkey END AS dst_id FROM part),
ends AS (SELECT l_orderkey, l_linenumber, src_id, dst_id, CASE WHEN src_id IS NULL THEN 1 ELSE 0 END + CASE WHEN dst_id IS NULL THEN 1 ELSE 0 END AS n_blocked
  FROM lineitem LEFT JOIN o ON l_orderkey = o_orderkey LEFT JOIN p ON l_partkey = p_partkey)"""


def _ends(spark: SparkSession, d: str) -> DataFrame:
    rels = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("release_label").alias("kind"), _name("o", "l_orderkey").alias("src_claim_id"), _name("p", "l_partkey").alias("dst_claim_id"))
    status = F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "new").otherwise("ambiguous")
    orders = table(spark, d, "orders").select(_name("o", "o_orderkey").alias("claim_id"), status.alias("status"), _name("E", "o_orderkey").alias("target_id"))
    parts = table(spark, d, "part").select(_name("p", "p_partkey").alias("claim_id"), F.when(F.col("p_size") % 3 > 0, "new").otherwise("conflict").alias("status"), F.lit(None).cast("string").alias("target_id"))
    return R.endpoints(rels, orders.unionByName(parts))


@query(f"WITH {_CLAIMS} SELECT * FROM ends")
def resolve_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return _ends(spark, d).select("l_orderkey", "l_linenumber", "src_id", "dst_id", F.size("blocked_by").alias("n_blocked"))


@query(f"""
WITH {_CLAIMS}, stored AS (SELECT src_id, dst_id FROM ends WHERE l_linenumber = 1)
SELECT l_orderkey, l_linenumber, CASE WHEN n_blocked > 0 THEN 'manual_review' WHEN (src_id, dst_id) IN (SELECT (src_id, dst_id) FROM stored) THEN 'noop' ELSE 'create' END AS strategy,
  CASE WHEN n_blocked > 0 THEN 'relationship_endpoint_unresolved' WHEN (src_id, dst_id) IN (SELECT (src_id, dst_id) FROM stored) THEN 'link_found' ELSE 'link_not_found' END AS reason FROM ends""")
def link_decisions(spark: SparkSession, d: str) -> DataFrame:
    ends = _ends(spark, d)
    stored = ends.where("l_linenumber = 1 and size(blocked_by) = 0").select("kind", "src_id", "dst_id")
    return P.decide_links(R.resolve_links(ends, stored)).select("l_orderkey", "l_linenumber", "strategy", "reason")


@query("""
SELECT l_orderkey * 10 + l_linenumber AS rel_id, CASE WHEN l_partkey % 9 = 0 THEN 'endpoint_missing' ELSE 'endpoint_type_mismatch' END AS reason
FROM lineitem WHERE l_partkey % 9 = 0 OR l_orderkey % 10 = 0""")
def endpoint_types(spark: SparkSession, d: str) -> DataFrame:
    rels = _tracks(spark, d).select(F.col("edge_id").alias("rel_id"), "kind", _name("o", "src_id").alias("src_claim_id"), _name("p", "dst_id").alias("dst_claim_id"))
    orders = table(spark, d, "orders").select(_name("o", "o_orderkey").alias("claim_id"), F.when(F.col("o_orderkey") % 10 == 0, "label").otherwise("release").alias("entity_type"))
    parts = table(spark, d, "part").where("p_partkey % 9 <> 0").select(_name("p", "p_partkey").alias("claim_id"), F.lit("recording").alias("entity_type"))
    return R.bad_endpoints(rels, orders.unionByName(parts), schemas.ENDS).select("rel_id", "reason")


_DROPPED = "reps AS (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS rep FROM orders)"


def _dropped(spark: SparkSession, d: str) -> DataFrame:
    """Orders that give way to the first one of their customer."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    first = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("rep_claim_id"))
    return orders.join(first, "o_custkey").where("o_orderkey <> rep_claim_id").select(F.col("o_orderkey").alias("claim_id"), "rep_claim_id")


@query(f"WITH {_DROPPED} SELECT rep AS src_id, l_partkey AS dst_id, min(l_orderkey * 10 + l_linenumber) AS rel_id FROM lineitem JOIN reps ON l_orderkey = o_orderkey GROUP BY ALL")
def rewire_dropped(spark: SparkSession, d: str) -> DataFrame:
    rels = _tracks(spark, d).select(F.col("edge_id").alias("rel_id"), F.col("src_id").alias("src_claim_id"), (-F.col("dst_id")).alias("dst_claim_id"))
    wired = D.rewire(rels, _dropped(spark, d)).withColumn("rel_key", F.struct("src_claim_id", "dst_claim_id"))
    return D.collapse_relationships(wired, order="rel_id").select(F.col("src_claim_id").alias("src_id"), (-F.col("dst_claim_id")).alias("dst_id"), "rel_id")


@query(f"WITH {_DROPPED} SELECT rep AS claim_id, min(-o_orderkey) AS root_ord FROM reps GROUP BY 1")
def rewire_roots(spark: SparkSession, d: str) -> DataFrame:
    roots = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), F.lit(True).alias("is_root"), (-F.col("o_orderkey")).alias("root_ord"))
    return D.rewire_roots(roots, _dropped(spark, d))


@query(f"""
WITH {_TRACKS}, ids AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 6 <> 0 UNION ALL SELECT -p_partkey FROM part WHERE p_partkey % 8 <> 0)
SELECT edge_id AS rel_id, 'src_claim_id' AS missing FROM tracks WHERE src_id NOT IN (SELECT id FROM ids)
UNION ALL SELECT edge_id, 'dst_claim_id' FROM tracks WHERE -dst_id NOT IN (SELECT id FROM ids)""")
def missing_endpoints(spark: SparkSession, d: str) -> DataFrame:
    rels = _tracks(spark, d).select(F.col("edge_id").alias("rel_id"), F.col("src_id").alias("src_claim_id"), (-F.col("dst_id")).alias("dst_claim_id"))
    orders = table(spark, d, "orders").where("o_orderkey % 6 <> 0").select(F.col("o_orderkey").cast("long").alias("claim_id"))
    parts = table(spark, d, "part").where("p_partkey % 8 <> 0").select((-F.col("p_partkey")).cast("long").alias("claim_id"))
    return D.missing_endpoints(rels, orders.unionByName(parts)).select("rel_id", "missing")


#: Events as scrobbles of pages of 50: one in 150 plays now, one in four has no album, one in three no id.
_PLAYED = """
played AS (SELECT event_id, event_id // 50 + 1 AS page, CAST(row_number() OVER (PARTITION BY event_id // 50 ORDER BY event_id) - 1 AS INTEGER) AS pos, event_type AS title,
  CASE WHEN event_id % 4 = 0 THEN event_type ELSE event_type || ' LP' END AS album, 'User ' || user_id AS artist, CASE WHEN event_id % 3 > 0 THEN 'm' || event_id END AS recording_mbid,
  event_id % 150 = 0 AS now_playing, CASE WHEN event_id % 150 > 0 THEN CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR) END AS played_s FROM events)"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages as JSON, as they land."""
    k, text = F.col("event_id"), lambda c: c.cast("string")
    seconds = text(F.unix_timestamp(F.col("ts").cast("timestamp")))
    track = F.struct(
        k.alias("event_id"), F.struct(F.concat(F.lit("User "), text(F.col("user_id"))).alias("#text")).alias("artist"), F.when(k % 3 > 0, _name("m", "event_id")).otherwise("").alias("mbid"),
        F.struct(F.when(k % 4 == 0, "").otherwise(F.concat("event_type", F.lit(" LP"))).alias("#text")).alias("album"), F.col("event_type").alias("name"),
        F.when(k % 150 > 0, F.struct(seconds.alias("uts"))).alias("date"), F.when(k % 150 == 0, F.struct(F.lit("true").alias("nowplaying"))).alias("@attr"),
    )
    pages = table(spark, d, "events").groupBy((F.floor(k / 50) + 1).alias("n")).agg(F.array_sort(F.collect_list(track)).alias("track"))
    # Sorted by event_id, which stands first.
    body = F.struct(F.struct(F.col("track"), F.struct(F.lit("u").alias("user"), text(F.col("n")).alias("page")).alias("@attr")).alias("recenttracks"))
    return pages.select(F.to_json(body).alias("body"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select(F.from_json("body", payloads.SCROBBLE_PAGE, {"mode": "FAILFAST"}).alias("p")).select("p.*")


@query(f"WITH {_PLAYED} SELECT CAST(page AS INTEGER) AS page, pos, artist, album, title, recording_mbid, now_playing, played_s FROM played")
def scrobble_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = payloads.scrobbles(_parsed(spark, d))
    return rows.select("ord.page", "ord.pos", "artist", "album", "title", "recording_mbid", "now_playing", F.unix_timestamp("played_at").cast("string").alias("played_s"))


@query(f"WITH {_PLAYED} SELECT CAST(page AS INTEGER) AS page, pos, title, now_playing FROM played")
def now_playing_split(spark: SparkSession, d: str) -> DataFrame:
    dated, playing = Inc.split_now_playing(payloads.scrobbles(_parsed(spark, d)))
    cols = ["ord.page", "ord.pos", "title"]
    return dated.select(*cols, F.lit(False).alias("now_playing")).unionByName(playing.select(*cols, F.lit(True).alias("now_playing")))


@query(f"WITH {_PLAYED} SELECT CAST(page AS VARCHAR) AS page FROM played GROUP BY page HAVING NOT bool_or(now_playing)")
def cacheable_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages in which something plays now are not kept."""
    return payloads.cacheable(_parsed(spark, d)).select(F.col("recenttracks.@attr.page").alias("page"))


_SCROBBLED = "n AS (SELECT count(*) AS n FROM part), firsts AS (SELECT p_brand, p_type, p_name, min(event_id) AS ord FROM events, n JOIN part ON TRUE WHERE event_id % n + 1 = p_partkey GROUP BY ALL)"


@query(f"""
WITH {_SCROBBLED}
SELECT 'recording' AS entity_type, p_name AS name, p_brand AS artist, ord, TRUE AS is_root FROM firsts UNION ALL SELECT 'artist', p_brand, NULL, ord, FALSE FROM firsts
UNION ALL SELECT 'release', p_type, NULL, ord, FALSE FROM firsts UNION ALL SELECT 'release_set', p_type, NULL, ord, FALSE FROM firsts""")
def scrobble_claims(spark: SparkSession, d: str) -> DataFrame:
    claims, _, _ = translate.scrobble_claims(_scrobbles(spark, d))
    return claims.select("entity_type", "name", "artist", F.col("claim_ord.ord").alias("ord"), "is_root")


@query(f"""
WITH {_SCROBBLED}
SELECT ord, k.kind, k.src, k.dst, k.role FROM firsts, (VALUES ('recording_contribution', 'recording', 'artist', 'primary'),
  ('release_track', 'release', 'recording', NULL), ('release_set_release', 'release_set', 'release', NULL)) k(kind, src, dst, role)""")
def scrobble_relationships(spark: SparkSession, d: str) -> DataFrame:
    _, rels, _ = translate.scrobble_claims(_scrobbles(spark, d))
    end = lambda c: F.substring_index(c, "|", 1)
    return rels.select(F.col("rel_ord.ord").alias("ord"), "kind", end("src_claim_id").alias("src"), end("dst_claim_id").alias("dst"), "role")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 'recording:"' || p_name || '"' || CASE WHEN p_partkey % 2 = 0 THEN ' AND artist:"' || p_brand || '"' ELSE '' END END AS q FROM part""")
def search_query(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    title, artist = F.when(k % 3 > 0, F.col("p_name")).otherwise(" "), F.when(k % 2 == 0, F.col("p_brand")).otherwise("")
    return table(spark, d, "part").select("p_partkey", paged.search_query(title, artist).alias("q"))


@query("""
WITH known AS (SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey % 3 > 0), hit AS (SELECT p_partkey AS recording_id, p_partkey AS k FROM known),
same AS (SELECT a.p_partkey AS recording_id, b.p_partkey AS k, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_partkey) AS rn
  FROM part a JOIN known b ON lower(a.p_name) = lower(b.p_name) AND lower(a.p_brand) = lower(b.p_brand) WHERE a.p_partkey % 3 = 0),
found AS (SELECT * FROM hit UNION ALL SELECT recording_id, k FROM same WHERE rn <= 5)
SELECT DISTINCT recording_id, l_orderkey AS release_mbid FROM found JOIN lineitem ON l_partkey = k""")
def release_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Orders that hold a part, or parts of its name and brand if it is not known by id."""
    mbid = F.lpad(F.col("p_partkey").cast("string"), 10, "0").alias("mbid")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("recording_id"), mbid, F.col("p_name").alias("title"), F.col("p_brand").alias("artist"))
    listed = table(spark, d, "lineitem").select(F.lpad(F.col("l_partkey").cast("string"), 10, "0").alias("mbid"), F.col("l_orderkey").alias("release_mbid"), F.col("l_linenumber").alias("pos"))
    return lookup.release_candidates(rows, rows.where("recording_id % 3 > 0").drop("recording_id"), listed).select("recording_id", "release_mbid")


def _listed(spark: SparkSession, d: str, paging: str, limit: int, **more: object) -> DataFrame:
    """Customers, whose keys count from 0, as a provider lists them from 1 through the paged source."""
    paged.register(spark)
    customers = table(spark, d, "customer").select("c_custkey", "c_name")
    reader = spark.read.format("paged").option("paging", paging).option("fetch", f"mergewell.sources.sample:{more.pop('fetch', paging)}")
    pages = reader.options(n=customers.count(), limit=limit, **more).load()
    keys = pages.select("page", F.explode(F.from_json("body", "items array<long>")["items"]).alias("k"))
    return keys.select("page", (F.col("k") - 1).alias("c_custkey")).join(customers, "c_custkey").select("page", "c_custkey", "c_name")


_LISTED = "SELECT CAST(c_custkey // {0} + 1 AS INTEGER) AS page, c_custkey, c_name FROM customer"


@query(_LISTED.format(40))
def paged_by_number(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d, "numbered", 40)


@query(_LISTED.format(50))
def paged_by_offset(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d, "offset", 50, calls=1000, lanes=4)


@query(_LISTED.format(70))
def paged_until_empty(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d, "offset", 70, fetch="untold")


@query(_LISTED.format(90))
def paged_by_cursor(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d, "cursor", 90)
