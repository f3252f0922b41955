"""Queries of deduplication, resolution, policy and merge over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergewell.functions.text import normalize_text
from mergewell.operators import candidates as C
from mergewell.operators import dedupe as D
from mergewell.operators import keys as K
from mergewell.operators import merge as M
from mergewell.operators import persist as X
from mergewell.operators import policy as P
from mergewell.operators import resolve as R
from mergewell.plans.catalogue import query, table
from mergewell.plans.key_queries import recording_claims
from mergewell.plans.scalar_queries import NORM, TITLE

_ART = f"""'["recording:artist-title","' || {NORM.format('p_brand')} || '","' || {NORM.format('p_name')} || '"]'"""


@query(f"SELECT {_ART} AS key, min(p_partkey) AS p_partkey, count(*) AS n_claims FROM part GROUP BY 1")
def dedupe_recordings_single_key(spark: SparkSession, d: str) -> DataFrame:
    kept = D.dedupe_single_key(recording_claims(spark, d).select("key", "p_partkey"), ["key"], ["p_partkey"])
    return kept.select("key", "p_partkey", "n_claims")


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS n_claims FROM (SELECT doc_id, {NORM.format('text')} AS n FROM documents) WHERE n IS NOT NULL GROUP BY n")
def dedupe_documents(spark: SparkSession, d: str) -> DataFrame:
    # The normalized text is the key; only its hash moves, so texts stay where they are.
    # Keyless texts leave after the aggregate: a filter before it would normalize every text twice.
    docs = table(spark, d, "documents").select("doc_id", F.sha2(normalize_text(F.col("text")), 256).alias("key"))
    firsts = docs.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_claims"), F.count("key").alias("keyed"))
    return firsts.where("keyed > 0").select("doc_id", "n_claims")


def _part_keys(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 10, "0")).alias("claim_id"), F.col("p_partkey").alias("claim_ord"), F.lit("recording").alias("entity_type"), "p_name", "p_brand", "p_size", "p_type")
    key = lambda *c: F.concat_ws("|", *[F.col(x).cast("string") for x in c])
    keys = F.array(F.concat(F.lit("a|"), key("p_name", "p_brand")), F.concat(F.lit("b|"), key("p_type", "p_size")))
    return K.explode_keys(p, keys)


@query("""
WITH RECURSIVE k AS (
  SELECT p_partkey AS ord, unnest([0, 1]) AS key_ord,
    unnest(['a|' || p_name || '|' || p_brand, 'b|' || p_type || '|' || p_size]) AS key FROM part),
open AS (
  SELECT ord, key, false AS free FROM k
  UNION ALL
  SELECT ord, key, free FROM (
    SELECT *, bool_or(taken) OVER (PARTITION BY ord) AS lost FROM (
      SELECT *, bool_or(free) OVER (PARTITION BY key) AS taken FROM (
        SELECT ord, key, bool_and(low = ord) OVER (PARTITION BY ord) AS free FROM (
          SELECT ord, key, min(ord) OVER (PARTITION BY key) AS low FROM open WHERE NOT free))))
  WHERE free OR NOT lost),
kept AS (SELECT DISTINCT ord FROM open WHERE free),
met AS (
  SELECT l.ord, arg_min(s.ord, (l.key_ord, s.ord)) AS rep, arg_min(l.key, (l.key_ord, s.ord)) AS matched_key
  FROM k l JOIN k s ON s.key = l.key AND s.ord < l.ord
  WHERE l.ord NOT IN (FROM kept) AND s.ord IN (FROM kept) GROUP BY l.ord),
named AS (SELECT ord, ord AS rep, NULL::VARCHAR AS matched_key FROM kept UNION ALL SELECT ord, rep, matched_key FROM met)
SELECT 'p' || lpad(ord::VARCHAR, 10, '0') AS claim_id, 'p' || lpad(rep::VARCHAR, 10, '0') AS rep_claim_id, matched_key FROM named""")
def dedupe_greedy_multikey(spark: SparkSession, d: str) -> DataFrame:
    """Every part by two keys: the claims that survive, and what the others matched."""
    survivors, dropped = D.dedupe_greedy(_part_keys(spark, d))
    kept = survivors.select("claim_id", F.col("claim_id").alias("rep_claim_id"), F.lit(None).cast("string").alias("matched_key"))
    return kept.unionByName(dropped.select("claim_id", "rep_claim_id", "matched_key"))


@query("""
SELECT l_orderkey, l_partkey, l_returnflag, min(l_linenumber) AS kept_line FROM lineitem GROUP BY l_orderkey, l_partkey, l_returnflag""")
def relationship_collapse_lineitem(spark: SparkSession, d: str) -> DataFrame:
    rels = table(spark, d, "lineitem").select(
        F.lit("release_track").alias("kind"), F.col("l_orderkey").cast("string").alias("src_claim_id"), F.col("l_partkey").cast("string").alias("dst_claim_id"), "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag"
    )
    key = K.relationship_key(F.col("kind"), F.col("src_claim_id"), F.col("dst_claim_id"), [K.text_part(F.col("l_returnflag"))])
    kept = D.collapse_relationships(rels.withColumn("rel_key", key), order="l_linenumber")
    return kept.select("l_orderkey", "l_partkey", "l_returnflag", F.col("l_linenumber").alias("kept_line"))


def _external_ids(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").where("p_partkey % 2 = 0")
    return p.select(F.lit("isrc").alias("namespace"), F.col("p_partkey").cast("string").alias("value"), F.lit("recording").alias("owner_type"), F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("owner_id"))


def _claim_ids(spark: SparkSession, d: str) -> DataFrame:
    """Order lines that claim two recordings by id: their part, then their supplier's number."""
    line = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("claim_id"), F.lit("recording").alias("entity_type"), F.array("l_partkey", "l_suppkey").alias("vs"))
    return line.select("claim_id", "entity_type", F.posexplode("vs").alias("pos", "value")).select("claim_id", "entity_type", "pos", F.lit("isrc").alias("namespace"), F.col("value").cast("string").alias("value"))


_LINE_IDS = """
ids AS (SELECT l_orderkey || '-' || l_linenumber AS claim_id, 0 AS pos, l_partkey AS v FROM lineitem UNION ALL SELECT l_orderkey || '-' || l_linenumber, 1, l_suppkey FROM lineitem)"""


@query(f"""
WITH {_LINE_IDS}, hit AS (SELECT DISTINCT claim_id, pos, v FROM ids JOIN part ON p_partkey = v AND p_partkey % 2 = 0)
SELECT claim_id, 'e' || min_by(v, (pos, v::VARCHAR)) AS entity_id FROM hit GROUP BY claim_id""")
def resolve_external_id(spark: SparkSession, d: str) -> DataFrame:
    claims = _claim_ids(spark, d).dropDuplicates(["claim_id", "pos", "value"])
    return R.by_external_id(claims, _external_ids(spark, d)).select("claim_id", "entity_id")


def _redirects(spark: SparkSession, d: str) -> DataFrame:
    """Chains of suppliers: n redirects to n / 2 while n is even; every hundredth starts a loop."""
    s = F.col("s_suppkey")
    table_ = table(spark, d, "supplier").where("s_suppkey % 2 = 0 and s_suppkey > 0")
    chain = table_.select(F.lit("isrc").alias("namespace"), s.cast("string").alias("source_value"), F.floor(s / 2).cast("string").alias("target_value"))
    loop = table_.where("s_suppkey % 100 = 2").select(F.lit("loop").alias("namespace"), F.explode(F.array(F.struct(s.alias("a"), (s + 1).alias("b")), F.struct((s + 1).alias("a"), s.alias("b")))).alias("x")).select("namespace", F.col("x.a").cast("string").alias("source_value"), F.col("x.b").cast("string").alias("target_value"))
    return chain.unionByName(loop)


_REDIRECTS = """
redirects AS (SELECT 'isrc' AS namespace, s_suppkey AS a, s_suppkey // 2 AS b FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey > 0
  UNION ALL SELECT 'loop', s_suppkey, s_suppkey + 1 FROM supplier WHERE s_suppkey % 100 = 2 UNION ALL SELECT 'loop', s_suppkey + 1, s_suppkey FROM supplier WHERE s_suppkey % 100 = 2),
walk AS (SELECT namespace, a, b, [a, b] AS seen FROM redirects
  UNION ALL SELECT w.namespace, w.a, r.b, list_append(w.seen, r.b) FROM walk w JOIN redirects r ON r.namespace = w.namespace AND r.a = w.b WHERE NOT list_contains(w.seen, r.b))"""


@query(f"WITH RECURSIVE {_REDIRECTS} SELECT namespace, a::VARCHAR AS source_value, arg_max(b, len(seen))::VARCHAR AS target_value FROM walk GROUP BY namespace, a")
def resolve_redirect_chain(spark: SparkSession, d: str) -> DataFrame:
    return R.redirect_closure(_redirects(spark, d))


def _sidecar(spark: SparkSession, d: str) -> DataFrame:
    """The first part of each artist-title and of each type-size key owns it."""
    keys = _part_keys(spark, d).where("claim_ord % 3 = 0")
    empty = keys.select("entity_type", "key").where("false")
    return X.insert_or_ignore(empty, keys.select("entity_type", "key", "claim_ord", F.col("claim_id").alias("entity_id")), ["entity_type", "key"], ["claim_ord"]).select("entity_type", "key", "entity_id")


_PART_KEYS = """
keys AS (SELECT 'p' || lpad(p_partkey::VARCHAR, 10, '0') AS claim_id, p_partkey AS o, 0 AS key_ord, 'a|' || p_name || '|' || p_brand AS key FROM part
  UNION ALL SELECT 'p' || lpad(p_partkey::VARCHAR, 10, '0'), p_partkey, 1, 'b|' || p_type || '|' || p_size FROM part),
sidecar AS (SELECT key, min_by(claim_id, o) AS entity_id FROM keys WHERE o % 3 = 0 GROUP BY key)"""


@query(f"""
WITH {_PART_KEYS}
SELECT claim_id, count(DISTINCT entity_id) AS n_candidates, min_by(entity_id, key_ord) AS first_candidate, min_by(key, key_ord) AS matched_key FROM keys JOIN sidecar USING (key) GROUP BY claim_id""")
def resolve_sidecar_keys(spark: SparkSession, d: str) -> DataFrame:
    found = R.by_keys(_part_keys(spark, d), _sidecar(spark, d))
    return found.select("claim_id", F.size("candidates").cast("long").alias("n_candidates"), F.get("candidates", F.lit(0)).alias("first_candidate"), "matched_key")


def _resolutions(spark: SparkSession, d: str) -> DataFrame:
    """Parts resolved: every seventh by external id, the others by key; every 35th conflicts."""
    keys = _part_keys(spark, d)
    claims = keys.select("claim_id", "claim_ord", "entity_type").distinct()
    ids = claims.where("claim_ord % 7 = 0").select("claim_id", "entity_type", F.lit(0).alias("pos"), F.lit("isrc").alias("namespace"), F.col("claim_ord").cast("string").alias("value"))
    other = claims.where("claim_ord % 35 = 0").select("claim_id", "entity_type", F.lit(1).alias("pos"), F.lit("mbid").alias("namespace"), F.col("claim_ord").cast("string").alias("value"))
    stored = claims.where("claim_ord % 7 = 0").select(F.lit("isrc").alias("namespace"), F.col("claim_ord").cast("string").alias("value"), F.lit("recording").alias("owner_type"), F.concat(F.lit("e"), F.col("claim_ord").cast("string")).alias("owner_id"))
    held = claims.where("claim_ord % 35 = 0").select(F.lit("mbid").alias("namespace"), F.lit("held").alias("value"), F.lit("recording").alias("owner_type"), F.concat(F.lit("e"), F.col("claim_ord").cast("string")).alias("owner_id"))
    none = spark.createDataFrame([], "namespace string, source_value string, target_value string")
    return R.resolve_entities(claims, ids.unionByName(other), keys, stored.unionByName(held), none, _sidecar(spark, d))


_RESOLVED = f"""
{_PART_KEYS}, found AS (SELECT claim_id, o, count(DISTINCT entity_id) AS n, min_by(entity_id, key_ord) AS first_one FROM (SELECT DISTINCT claim_id, o FROM keys) LEFT JOIN keys USING (claim_id, o) LEFT JOIN sidecar USING (key) GROUP BY claim_id, o),
resolved AS (SELECT claim_id, o, CASE WHEN o % 35 = 0 THEN 'conflict' WHEN o % 7 = 0 THEN 'resolved' WHEN n = 0 THEN 'new' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
  CASE WHEN o % 35 = 0 THEN 'external_id_namespace_conflict' WHEN o % 7 = 0 THEN 'exact_match' WHEN n = 0 THEN 'no_exact_match' WHEN n = 1 THEN 'exact_match' ELSE 'multiple_exact_matches' END AS reason,
  CASE WHEN o % 35 = 0 THEN NULL WHEN o % 7 = 0 THEN 'e' || o WHEN n = 1 THEN first_one END AS target_id FROM (SELECT claim_id, o, n, CASE WHEN n > 0 THEN first_one END AS first_one FROM found))"""


@query(f"WITH {_RESOLVED} SELECT claim_id, status, reason, target_id FROM resolved")
def resolve_classify(spark: SparkSession, d: str) -> DataFrame:
    return _resolutions(spark, d).select("claim_id", "status", "reason", "target_id")


@query("""
WITH stored AS (SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL)
SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, CASE WHEN n IS NULL THEN 'new' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
  CASE WHEN n IS NULL THEN 'association_not_found' WHEN n = 1 THEN 'association_found' ELSE 'multiple_association_matches' END AS reason
FROM lineitem l LEFT JOIN stored s ON s.l_orderkey = l.l_orderkey AND s.l_partkey = l.l_partkey""")
def association_resolution_lineitem(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit("release_track").alias("kind"), F.col("l_orderkey").alias("src_id"), F.col("l_partkey").alias("dst_id"))
    edges = line.where("l_linenumber <= 4").select("kind", "src_id", "dst_id", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("edge_id"))
    out = R.resolve_associations(line.withColumn("blocked_by", F.array().cast("array<string>")), edges)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "status", "reason")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') THEN 'link_found' ELSE 'link_not_found' END AS reason FROM lineitem""")
def link_exists(spark: SparkSession, d: str) -> DataFrame:
    kind = F.lit("release_set_release").alias("kind")
    links = table(spark, d, "orders").where("o_orderstatus = 'F'").select(kind, F.col("o_orderkey").alias("src_id"), F.col("o_orderkey").alias("dst_id"))
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", kind, F.col("l_orderkey").alias("src_id"), F.col("l_orderkey").alias("dst_id"), F.array().cast("array<string>").alias("blocked_by"))
    return R.resolve_links(line, links).select("l_orderkey", "l_linenumber", "reason")


@query(f"""
WITH {_RESOLVED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY status = 'resolved', target_id ORDER BY CASE WHEN o % 4 = 0 THEN -1.0 ELSE (o % 5) / 5.0 END DESC, claim_id) AS rn FROM resolved)
SELECT claim_id, CASE WHEN status = 'new' THEN 'create' WHEN status = 'resolved' AND rn = 1 THEN 'merge' WHEN status = 'resolved' THEN 'noop' ELSE 'manual_review' END AS strategy,
  CASE WHEN status = 'resolved' AND rn = 1 THEN 'resolved_target_selected' WHEN status = 'resolved' THEN 'duplicate_resolved_target' ELSE reason END AS reason FROM ranked""")
def policy_winner(spark: SparkSession, d: str) -> DataFrame:
    return _instructions(spark, d).select("claim_id", "strategy", "reason")


def _instructions(spark: SparkSession, d: str) -> DataFrame:
    n = F.substring("claim_id", 2, 10).cast("long")
    confidence = F.when(n % 4 == 0, F.lit(None).cast("double")).otherwise((n % 5) / 5.0)
    return P.decide_entities(_resolutions(spark, d).withColumn("confidence", confidence))


@query("""
SELECT a.l_orderkey, a.l_linenumber, CASE WHEN b.l_orderkey IS NULL THEN 'create' WHEN a.l_returnflag IS DISTINCT FROM b.l_returnflag OR a.l_quantity IS DISTINCT FROM b.l_quantity THEN 'merge' ELSE 'noop' END AS strategy
FROM lineitem a LEFT JOIN (SELECT l_orderkey, l_linenumber, any_value(l_returnflag) AS l_returnflag, any_value(l_quantity) AS l_quantity FROM (SELECT * FROM lineitem ORDER BY l_partkey, l_suppkey, l_quantity) WHERE false GROUP BY ALL) b USING (l_orderkey, l_linenumber)""")
def association_payload_diff_new(spark: SparkSession, d: str) -> DataFrame:
    """Against an empty store every association is created."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("new").alias("status"), F.lit(None).cast("string").alias("reason"))
    return P.decide_associations(line, F.lit(None).cast("boolean")).select("l_orderkey", "l_linenumber", "strategy")


@query("""
SELECT o_orderkey, CASE WHEN (o_orderstatus IS DISTINCT FROM CASE WHEN o_custkey % 2 = 0 THEN 'F' END) OR (o_custkey IS DISTINCT FROM o_custkey) THEN 'merge' ELSE 'noop' END AS strategy,
  CASE WHEN (o_orderstatus IS DISTINCT FROM CASE WHEN o_custkey % 2 = 0 THEN 'F' END) THEN 'association_payload_merge' ELSE 'association_found' END AS reason FROM orders""")
def association_payload_diff(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").alias("_custkey"), "o_orderstatus", F.when(F.col("o_custkey") % 2 == 0, "F").alias("_status"), F.lit("resolved").alias("status"), F.lit("association_found").alias("reason"))
    return P.decide_associations(o, P.payload_differs(["o_orderstatus", "o_custkey"], ["_status", "_custkey"])).select("o_orderkey", "strategy", "reason")


def _stored_labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    stored = s.select(k.alias("entity_id"), F.col("s_name").alias("name"), F.when(k % 3 == 0, "US").alias("country"))
    incoming = s.where("s_suppkey % 2 = 0").select(k.alias("entity_id"), F.when(k % 4 == 0, "  ").otherwise(F.concat("s_name", F.lit("!"))).alias("name"), F.when(k % 6 == 0, "DE").alias("country"))
    return stored, incoming


@query("""
SELECT s_suppkey AS entity_id, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 <> 0 THEN s_name || '!' ELSE s_name END AS name,
  CASE WHEN s_suppkey % 6 = 0 THEN 'DE' WHEN s_suppkey % 3 = 0 THEN 'US' END AS country,
  concat_ws(',', CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 <> 0 THEN 'name' END, CASE WHEN s_suppkey % 6 = 0 THEN 'country' END) AS changed FROM supplier""")
def merge_prefer_incoming(spark: SparkSession, d: str) -> DataFrame:
    merged = M.merge_entities(*_stored_labels(spark, d), "label")
    return merged.select("entity_id", "name", "country", F.array_join("changed_fields", ",").alias("changed"))


@query("""
SELECT o_orderkey AS edge_id, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'primary' END ELSE o_orderstatus END AS role FROM orders""")
def merge_overwrite(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    stored = o.select(F.col("o_orderkey").alias("edge_id"), F.col("o_orderstatus").alias("role"))
    incoming = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("edge_id"), F.when(F.col("o_orderkey") % 4 == 0, "primary").alias("role"))
    return M.overwrite_payload(stored, incoming, ["role"])


@query("""
SELECT p_partkey, p_brand || ',' || p_name || CASE WHEN p_type NOT IN (p_brand, p_name) THEN ',' || p_type ELSE '' END AS aliases FROM part""")
def merge_unique_list(spark: SparkSession, d: str) -> DataFrame:
    grown = M.grow_list(F.array("p_brand", "p_name"), F.array("p_name", "p_type", "p_type", "p_brand"))
    return table(spark, d, "part").select("p_partkey", F.array_join(grown, ",").alias("aliases"))


@query("""
WITH stored AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0)
SELECT user_id AS owner_id, event_type AS namespace, count(*) FILTER (NOT there) > 0 AS added FROM (
  SELECT e.user_id, e.event_type, s.user_id IS NOT NULL AS there FROM (SELECT DISTINCT user_id, event_type FROM events) e LEFT JOIN stored s USING (user_id, event_type)) GROUP BY ALL""")
def merge_external_ids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.lit("user").alias("owner_type"), F.col("user_id").alias("owner_id"), F.col("event_type").alias("namespace"), "event_id")
    incoming = e.select("owner_type", "owner_id", "namespace", F.lit("v").alias("value"))
    stored = e.where("event_id % 2 = 0").select("owner_type", "owner_id", "namespace", F.lit("v").alias("value")).distinct()
    add, _ = M.absorb_external_ids(stored, incoming)
    every = incoming.select("owner_id", "namespace").distinct()
    return every.join(add.select("owner_id", "namespace", F.lit(True).alias("_a")), ["owner_id", "namespace"], "left").select("owner_id", "namespace", F.coalesce("_a", F.lit(False)).alias("added"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'lastfm,musicbrainz,spotify' WHEN c_custkey % 3 = 1 THEN 'lastfm,spotify' ELSE 'musicbrainz' END AS sources,
  CASE WHEN c_custkey % 3 = 2 THEN 'musicbrainz' ELSE 'lastfm' END AS primary_source FROM customer""")
def merge_sources(spark: SparkSession, d: str) -> DataFrame:
    from mergewell.functions.values import primary_source

    k = F.col("c_custkey") % 3
    current = F.when(k == 2, F.lit(None).cast("array<string>")).otherwise(F.array(F.lit("spotify"), F.lit("lastfm")))
    incoming = F.when(k == 1, F.array(F.lit("spotify"))).otherwise(F.array(F.lit("musicbrainz")))
    c = table(spark, d, "customer").select("c_custkey", M.union_sources(current, incoming).alias("s"))
    return c.select("c_custkey", F.array_join("s", ",").alias("sources"), primary_source(F.col("s")).alias("primary_source"))


@query(f"""
WITH {_RESOLVED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY status = 'resolved', target_id ORDER BY CASE WHEN o % 4 = 0 THEN -1.0 ELSE (o % 5) / 5.0 END DESC, claim_id) AS rn FROM resolved)
SELECT 'entity' AS subject, count(*) AS applied, count(*) FILTER (status = 'new') AS created, count(*) FILTER (status = 'resolved' AND rn = 1) AS merged,
  count(*) FILTER (status = 'resolved' AND rn > 1) AS skipped, count(*) FILTER (status IN ('conflict', 'ambiguous')) AS manual_review FROM ranked""")
def apply_counters(spark: SparkSession, d: str) -> DataFrame:
    return M.counters(_instructions(spark, d).withColumn("subject", F.lit("entity")))


@query(f"""
WITH {_PART_KEYS}
SELECT key, min_by(claim_id, o) AS entity_id FROM keys WHERE key NOT IN (SELECT key FROM sidecar) GROUP BY key""")
def sidecar_insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    keys = _part_keys(spark, d).select("entity_type", "key", "claim_ord", F.col("claim_id").alias("entity_id"))
    return X.insert_or_ignore(_sidecar(spark, d), keys, ["entity_type", "key"], ["claim_ord"]).select("key", "entity_id")


@query(f"""
WITH {_PART_KEYS}, gained AS (SELECT key, min_by(claim_id, o) AS entity_id FROM keys WHERE key NOT IN (SELECT key FROM sidecar) GROUP BY key)
SELECT entity_id, count(*) AS n FROM gained GROUP BY entity_id""")
def sidecar_keys_gained(spark: SparkSession, d: str) -> DataFrame:
    """How many keys each owner has now that nobody had before."""
    keys = _part_keys(spark, d).select("entity_type", "key", "claim_ord", F.col("claim_id").alias("entity_id"))
    return X.keys_gained(X.insert_or_ignore(_sidecar(spark, d), keys, ["entity_type", "key"], ["claim_ord"])).select("entity_id", "n")


@query("""
WITH said AS (SELECT user_id, event_type, CAST(floor(value) AS BIGINT) % 4 AS v, event_id % 2 = 0 AS was FROM events),
held AS (SELECT user_id, event_type, min(v) AS held, TRUE AS was FROM said WHERE was GROUP BY ALL),
now AS (SELECT user_id, event_type, min(v) AS held, FALSE AS was FROM said s WHERE NOT was AND NOT EXISTS (FROM held h WHERE h.user_id = s.user_id AND h.event_type = s.event_type) GROUP BY ALL)
SELECT user_id AS owner_id, event_type AS namespace, v AS value, held, count(*) AS n
FROM said JOIN (SELECT user_id, event_type, held FROM held UNION ALL SELECT user_id, event_type, held FROM now) USING (user_id, event_type) WHERE NOT said.was AND v <> held GROUP BY ALL
UNION ALL SELECT user_id, event_type, held, NULL, 1 FROM now""")
def external_id_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Users as owners, event types as namespaces, one of four values: even events are stored, the
    others say what clashes with it or with each other. Ids that are added have no `held`."""
    v = F.pmod(F.floor("value"), F.lit(4)).cast("long").alias("value")
    e = table(spark, d, "events").select(F.lit("user").alias("owner_type"), F.col("user_id").alias("owner_id"), F.col("event_type").alias("namespace"), v, "event_id")
    by = ["owner_type", "owner_id", "namespace"]
    stored = e.where("event_id % 2 = 0").groupBy(*by).agg(F.min("value").alias("value"))
    add, clash = M.absorb_external_ids(stored, e.where("event_id % 2 = 1").drop("event_id"))
    counted = clash.groupBy("owner_id", "namespace", "value", "held").agg(F.count("*").alias("n"))
    return counted.unionByName(add.select("owner_id", "namespace", "value", F.lit(None).cast("long").alias("held"), F.lit(1).cast("long").alias("n")))


@query("""
SELECT 'isrc' AS namespace, s_suppkey::VARCHAR AS source_value, (CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey + 7 ELSE s_suppkey + 1 END)::VARCHAR AS target_value FROM supplier
UNION ALL SELECT 'isrc', 'x' || s_suppkey, s_suppkey::VARCHAR FROM supplier WHERE s_suppkey % 5 = 0""")
def redirect_upsert(spark: SparkSession, d: str) -> DataFrame:
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    row = lambda df, a, b: df.select(F.lit("isrc").alias("namespace"), a.cast("string").alias("source_value"), b.cast("string").alias("target_value"))
    stored = row(s, k, k + 1)
    incoming = row(s.where("s_suppkey % 3 = 0"), k, k + 7).unionByName(row(s.where("s_suppkey % 5 = 0"), F.concat(F.lit("x"), k.cast("string")), k)).unionByName(row(s, k, k))
    return X.upsert_redirects(stored, incoming)


_TS = TITLE.format("p_name")
_CAND = f"""
hits AS (SELECT l_orderkey AS release_id, p_size AS mbid, count(DISTINCT l_linenumber) AS hits, min_by(p_name, (l_linenumber, p_partkey)) AS title, min_by(p_size, (l_linenumber, p_partkey)) AS track_count
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
local AS (SELECT l_orderkey AS release_id, min_by(p_name, (l_linenumber, p_partkey)) AS local_title, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
scored AS (SELECT h.*, CASE WHEN {TITLE.format('local_title')} = {TITLE.format('title')} THEN 2 WHEN contains({TITLE.format('local_title')}, {TITLE.format('title')}) OR contains({TITLE.format('title')}, {TITLE.format('local_title')}) THEN 1 ELSE 0 END AS title_score,
  greatest(0, n + 1 - abs(n - track_count)) AS track_score FROM hits h JOIN local USING (release_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY release_id ORDER BY title_score DESC, hits DESC, track_score DESC, coalesce(title, ''), mbid) AS rank FROM scored)"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    met = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    order = F.struct("l_linenumber", "p_partkey")
    found = met.select(F.col("l_orderkey").alias("release_id"), F.col("l_linenumber").alias("recording_id"), F.col("p_size").alias("mbid"), order.alias("ord"), F.col("p_name").alias("title"), F.col("p_size").alias("track_count"))
    local = met.groupBy(F.col("l_orderkey").alias("release_id")).agg(F.min_by("p_name", order).alias("local_title"), F.count("*").alias("n_tracks"))
    return C.rank(C.aggregate_hits(found), local)


@query(f"WITH {_CAND} SELECT release_id, mbid, hits, title_score::INTEGER AS title_score, track_score::INTEGER AS track_score, rank::INTEGER AS rank FROM ranked")
def recording_candidate_rank(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("release_id", "mbid", "hits", "title_score", "track_score", "rank")


@query(f"""
WITH {_CAND}, nxt AS (SELECT *, lead((title_score, hits, track_score)) OVER (PARTITION BY release_id ORDER BY rank) AS n FROM ranked)
SELECT release_id, mbid, hits FROM nxt WHERE rank = 1 AND title_score > 0 AND (n IS NULL OR (title_score, hits, track_score) > n)""")
def candidate_confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    return C.confident(_ranked(spark, d)).select("release_id", "mbid", "hits")


@query("""
WITH s AS (SELECT o_orderkey AS release_id, 0 AS level, o_custkey AS mbid FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT l_orderkey, 1, l_partkey FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT o_orderkey, 2, o_orderkey FROM orders)
SELECT release_id, min_by(level, (level, mbid)) AS level, min_by(mbid, (level, mbid)) AS mbid FROM s GROUP BY release_id""")
def candidate_waterfall(spark: SparkSession, d: str) -> DataFrame:
    o, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    own = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("release_id"), F.col("o_custkey").alias("mbid"))
    browsed = line.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("release_id"), F.col("l_partkey").alias("mbid"))
    searched = o.select(F.col("o_orderkey").alias("release_id"), F.col("o_orderkey").alias("mbid"))
    return C.waterfall([own, browsed, searched], order="mbid").select("release_id", "level", "mbid")


@query("SELECT o_orderkey AS entity_id FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderkey LIMIT 50")
def release_candidates_without_source(spark: SparkSession, d: str) -> DataFrame:
    sources = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("lastfm"), F.lit("musicbrainz"))).when(F.col("o_orderstatus") == "O", F.array(F.lit("lastfm")))
    return C.without_source(table(spark, d, "orders").select(F.col("o_orderkey").alias("entity_id"), sources.alias("sources")), "musicbrainz", 50).select("entity_id")


@query("""
WITH held AS (SELECT o_orderkey AS v, o_orderkey AS holder FROM orders WHERE o_orderkey % 3 = 0),
asked AS (SELECT o_orderkey, o_orderkey - o_orderkey % 2 AS v FROM orders),
met AS (SELECT a.*, holder, first_value(o_orderkey) OVER (PARTITION BY a.v ORDER BY o_orderkey) AS f FROM asked a LEFT JOIN held USING (v))
SELECT o_orderkey AS release_id, coalesce(holder, f) = o_orderkey AS accepted, CASE WHEN coalesce(holder, f) <> o_orderkey THEN 'musicbrainz_candidate_collision' END AS reason FROM met""")
def anchor_collision(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    ask = table(spark, d, "orders").select(k.alias("release_id"), F.lit("release").alias("owner_type"), k.alias("owner_id"), F.lit("musicbrainz:release").alias("namespace"), (k - k % 2).alias("value"))
    held = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.lit("release").alias("owner_type"), k.alias("owner_id"), F.lit("musicbrainz:release").alias("namespace"), k.alias("value"))
    return C.anchor(ask, held, "musicbrainz_candidate_collision").select("release_id", "accepted", "reason")


@query(f"""
WITH {_RESOLVED}
SELECT claim_id, 'musicbrainz_anchor_mismatch' AS reason FROM resolved WHERE NOT (status = 'resolved' AND target_id IS NOT DISTINCT FROM 'e' || o)""")
def anchor_mismatch(spark: SparkSession, d: str) -> DataFrame:
    res = _resolutions(spark, d)
    roots = res.select("claim_id", F.concat(F.lit("e"), F.substring("claim_id", 2, 10).cast("long").cast("string")).alias("release_id"))
    return C.anchor_mismatch(roots, res).select("claim_id", "reason")
