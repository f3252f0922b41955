"""Queries of users' commands over the driver's tables: events are plays, customers are tracks of
their nations, lines of orders are library items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergewell.operators import commands as C
from mergewell.operators import user_commands as U
from mergewell.plans.catalogue import query, table

#: Plays: one in seven has its user's track, the others a recording, mostly that of the track.
_PLAYS = """
tracks AS (SELECT c_custkey AS track_id, c_nationkey::BIGINT AS of FROM customer),
plays AS (SELECT event_id AS k, user_id, event_type AS source, ts AS played_at, CASE WHEN event_id % 7 = 0 THEN user_id END AS track_id,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 < 2 THEN of ELSE event_id % 25 END AS recording_id FROM events JOIN tracks t ON t.track_id = user_id)"""


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("track_id"), F.col("c_nationkey").cast("long").alias("recording_id"))


def _plays(spark: SparkSession, d: str) -> DataFrame:
    k, of = F.col("event_id"), _tracks(spark, d).select(F.col("track_id").alias("user_id"), F.col("recording_id").alias("of"))
    events = table(spark, d, "events").join(of, "user_id")
    recording = F.when(k % 7 == 0, None).when(k % 3 < 2, F.col("of")).otherwise(k % 25)
    return events.select(k.alias("k"), "user_id", F.col("event_type").alias("source"), F.col("ts").alias("played_at"), F.when(k % 7 == 0, F.col("user_id")).alias("track_id"), recording.alias("recording_id"))


def _told(plays: DataFrame, by_user: Column, **more: Column) -> DataFrame:
    """A command to every play."""
    cols = [c.alias(n) for n, c in more.items()]
    return plays.select(F.col("k").alias("ord"), by_user.alias("by_user"), *U.PLAY, *cols)


def _answers(rows: DataFrame, refused: DataFrame) -> DataFrame:
    """Plays after the commands, and by event why a command was refused."""
    kept = rows.select("k", "track_id", "recording_id", F.lit(None).cast("string").alias("why"))
    return kept.unionByName(refused.select(F.col("ord").alias("k"), F.lit(None).cast("long").alias("track_id"), F.lit(None).cast("long").alias("recording_id"), "why"))


_USER = "CASE WHEN k % 11 = 0 THEN user_id + 1 ELSE user_id END"


def _by(k: Column) -> Column:
    return F.when(k % 11 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))


@query(f"""
WITH {_PLAYS}, told AS (SELECT p.*, CASE WHEN k % 13 = 0 THEN -1 WHEN k % 5 = 0 THEN user_id + 1 ELSE user_id END AS track, {_USER} AS by_user FROM plays p),
said AS (SELECT x.*, t.of, CASE WHEN by_user <> user_id THEN 'not owned by this user' WHEN of IS NULL THEN 'no such track' WHEN x.track_id <> track THEN 'already linked to a track'
  WHEN x.track_id IS NULL AND of <> recording_id THEN 'the track has another recording' END AS why FROM told x LEFT JOIN tracks t ON t.track_id = track)
SELECT k, CASE WHEN why IS NULL THEN track ELSE track_id END AS track_id, CASE WHEN why IS NOT NULL THEN recording_id END AS recording_id, NULL AS why FROM said
UNION ALL SELECT k, NULL, NULL, why FROM said WHERE why IS NOT NULL""")
def command_link_plays(spark: SparkSession, d: str) -> DataFrame:
    plays, k = _plays(spark, d), F.col("k")
    track = F.when(k % 13 == 0, -1).when(k % 5 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
    return _answers(*U.link_plays(plays, _tracks(spark, d), _told(plays, _by(k), track_id=track.cast("long"))))


@query(f"""
WITH {_PLAYS}, said AS (SELECT *, CASE WHEN {_USER} <> user_id THEN 'not owned by this user' WHEN track_id IS NOT NULL THEN 'already linked to a track' WHEN k % 9 = 0 THEN 'no recording' END AS why FROM plays)
SELECT k, track_id, CASE WHEN why IS NULL THEN k % 24 ELSE recording_id END AS recording_id, NULL AS why FROM said UNION ALL SELECT k, NULL, NULL, why FROM said WHERE why IS NOT NULL""")
def command_move_plays(spark: SparkSession, d: str) -> DataFrame:
    plays, k = _plays(spark, d), F.col("k")
    return _answers(*U.move_plays(plays, _told(plays, _by(k), recording_id=F.when(k % 9 > 0, k % 24))))


@query(f"""
WITH {_PLAYS}, told AS (SELECT p.*, {_USER} AS by_user, CASE WHEN k % 4 < 2 THEN (k % 4 * 10000000) + user_id END AS track, CASE WHEN k % 3 = 0 THEN k % 25 END AS recording FROM plays p),
said AS (SELECT x.*, t.of, CASE WHEN by_user <> user_id THEN 'not owned by this user' WHEN track IS NOT NULL AND of IS NULL THEN 'no such track' WHEN of <> recording THEN 'the track has another recording'
  WHEN track IS NULL AND recording IS NULL THEN 'neither track nor recording' END AS why FROM told x LEFT JOIN tracks t ON t.track_id = track)
SELECT k, CASE WHEN why IS NULL THEN track ELSE track_id END AS track_id, CASE WHEN why IS NOT NULL THEN recording_id WHEN track IS NULL THEN recording END AS recording_id, NULL AS why FROM said
UNION ALL SELECT k, NULL, NULL, why FROM said WHERE why IS NOT NULL""")
def command_rebind_to_tracks(spark: SparkSession, d: str) -> DataFrame:
    plays, k = _plays(spark, d), F.col("k")
    track = F.when(k % 4 < 2, k % 4 * 10000000 + F.col("user_id"))
    return _answers(*U.rebind_plays(plays, _tracks(spark, d), _told(plays, _by(k), track_id=track, recording_id=F.when(k % 3 == 0, k % 25))))


@query(f"""
WITH {_PLAYS}, stored AS (SELECT * FROM plays WHERE k % 4 = 0),
told AS (SELECT k AS ord, user_id, source, played_at, CASE WHEN k % 5 = 0 THEN user_id END AS track, CASE WHEN k % 5 <> 1 THEN k % 25 END AS recording FROM plays UNION ALL SELECT k + 1000000000, user_id, source, played_at, NULL, 1 FROM plays WHERE k % 6 = 1),
said AS (SELECT x.*, CASE WHEN x.ord >= 1000000000 THEN 'another command names the row' WHEN of <> recording THEN 'the track has another recording'
  WHEN track IS NULL AND recording IS NULL THEN 'neither track nor recording' WHEN s.k IS NOT NULL THEN 'already logged' END AS why
  FROM told x LEFT JOIN tracks t ON t.track_id = track LEFT JOIN stored s ON s.user_id = x.user_id AND s.source = x.source AND s.played_at = x.played_at)
SELECT user_id, source, played_at, track_id, recording_id, NULL AS why FROM stored
UNION ALL SELECT user_id, source, played_at, CASE WHEN why IS NULL THEN track END, CASE WHEN why IS NULL AND track IS NULL THEN recording END, why FROM said""")
def command_log_plays(spark: SparkSession, d: str) -> DataFrame:
    """All plays logged where a quarter is stored; some are told twice."""
    plays, k = _plays(spark, d), F.col("k")
    told = _told(plays, F.col("user_id"), track_id=F.when(k % 5 == 0, F.col("user_id")), recording_id=F.when(k % 5 != 1, k % 25))
    again = _told(plays.where("k % 6 = 1"), F.col("user_id"), track_id=F.lit(None).cast("long"), recording_id=F.lit(1).cast("long")).withColumn("ord", F.col("ord") + 1000000000)
    cols = [*U.PLAY, "track_id", "recording_id"]
    rows, refused = U.log_plays(plays.where("k % 4 = 0").select(*cols), _tracks(spark, d), told.unionByName(again).drop("user_id"))
    none = F.lit(None).cast("long")
    return rows.withColumn("why", F.lit(None).cast("string")).unionByName(refused.select(F.col("by_user").alias("user_id"), "source", "played_at", none.alias("track_id"), none.alias("recording_id"), "why"))


@query(f"""
WITH {_PLAYS}, stored AS (SELECT * FROM plays WHERE k % 4 > 0), said AS (SELECT k, CASE WHEN {_USER} <> user_id THEN 'not owned by this user' WHEN k % 4 = 0 THEN 'not there' END AS why FROM plays WHERE k % 3 = 0),
left_over AS (SELECT k FROM stored WHERE k NOT IN (SELECT k FROM said WHERE why IS NULL)),
back AS (SELECT k, CASE WHEN k % 11 = 0 THEN 'not owned by this user' END AS why FROM plays WHERE k % 2 = 0)
SELECT k, NULL AS why FROM (SELECT k FROM left_over UNION SELECT k FROM back WHERE why IS NULL) UNION ALL SELECT k, why FROM said WHERE why IS NOT NULL UNION ALL SELECT k, why FROM back WHERE why IS NOT NULL""")
def command_remove_and_rehydrate_plays(spark: SparkSession, d: str) -> DataFrame:
    """Every third play removed, then every second attached again."""
    plays, k = _plays(spark, d), F.col("k")
    rows, refused = U.remove_plays(plays.where("k % 4 > 0"), _told(plays.where("k % 3 = 0"), _by(k)))
    detached = plays.where("k % 2 = 0").select("*", k.alias("ord"), _by(k).alias("by_user"))
    rows, foreign = U.rehydrate_plays(rows, detached)
    why = lambda df: df.select(F.col("ord").alias("k"), "why")
    return rows.select("k", F.lit(None).cast("string").alias("why")).unionByName(why(refused)).unionByName(why(foreign))


#: Items: what the users of two thirds of the orders bought; the others save theirs now, one a line.
_ITEMS = """
lines AS (SELECT o_custkey AS user_id, o_orderkey, l_partkey, max(p_partkey) IS NOT NULL AS known, min(l_linenumber) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY ALL),
ents AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 3 THEN p_partkey - 1 ELSE p_partkey END AS target, CASE WHEN p_size % 2 = 0 THEN 'recording' ELSE 'release' END AS type FROM part),
stored AS (SELECT DISTINCT user_id, type AS target_type, target AS target_id FROM lines JOIN ents ON id = l_partkey WHERE o_orderkey % 3 > 0)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(F.col("o_custkey").alias("user_id"), "o_orderkey", "l_partkey").distinct()


def _entities(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("entity_id"), F.when(F.col("p_size") % 2 == 0, "recording").otherwise("release").alias("entity_type"), F.when(k % 10 == 3, k - 1).alias("canonical_id"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    ents = _entities(spark, d).select(F.col("entity_id").alias("l_partkey"), F.col("entity_type").alias("target_type"), F.coalesce("canonical_id", "entity_id").alias("target_id"))
    return _lines(spark, d).where("o_orderkey % 3 > 0").join(ents, "l_partkey").select(*U.ITEM).distinct()


@query(f"""
WITH {_ITEMS},
saves AS (SELECT user_id, type, target, row_number() OVER (PARTITION BY user_id, type, target ORDER BY o_orderkey, l_partkey) AS rn FROM lines JOIN ents ON id = l_partkey WHERE o_orderkey % 3 = 0),
said AS (SELECT x.*, CASE WHEN rn > 1 THEN 'another command names the row' WHEN s.user_id IS NOT NULL THEN 'already saved' END AS why
  FROM saves x LEFT JOIN stored s ON s.user_id = x.user_id AND s.target_type = x.type AND s.target_id = x.target)
SELECT user_id, target_type, target_id, NULL AS why, 1::BIGINT AS n FROM stored UNION ALL SELECT user_id, type, target, why, count(*) FROM said GROUP BY ALL
UNION ALL SELECT user_id, NULL, NULL, 'no such entity', count(*) FROM lines WHERE o_orderkey % 3 = 0 AND l_partkey NOT IN (SELECT id FROM ents) GROUP BY ALL""")
def command_save_entities(spark: SparkSession, d: str) -> DataFrame:
    """Items for the entities that stand for what is saved, and refusals counted by what they name."""
    saves = _lines(spark, d).where("o_orderkey % 3 = 0").select(F.struct("o_orderkey", "l_partkey").alias("ord"), F.col("user_id").alias("by_user"), F.col("l_partkey").alias("entity_id"))
    ents = _entities(spark, d)
    rows, refused = U.save_entities(_items(spark, d), ents, saves)
    named = ents.select("entity_id", F.col("entity_type").alias("target_type"), F.coalesce("canonical_id", "entity_id").alias("target_id"))
    counted = refused.join(named, "entity_id", "left").groupBy(F.col("by_user").alias("user_id"), "target_type", "target_id", "why").agg(F.count("*").alias("n"))
    return rows.select(*U.ITEM, F.lit(None).cast("string").alias("why"), F.lit(1).cast("long").alias("n")).unionByName(counted)


@query(f"""
WITH {_ITEMS}, told AS (SELECT *, target_id + 1 - 2 * (target_id % 2) AS to_id, CASE WHEN target_id % 7 = 0 THEN user_id + 1 ELSE user_id END AS by_user FROM stored WHERE target_id % 3 < 2),
good AS (SELECT t.*, s.user_id IS NULL AS free FROM told t LEFT JOIN stored s ON s.user_id = t.user_id AND s.target_type = 'release' AND s.target_id = t.to_id WHERE by_user = t.user_id AND (t.target_type <> 'release' OR t.to_id <> t.target_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, to_id ORDER BY target_type, target_id) AS rn FROM good)
SELECT s.user_id, CASE WHEN m.user_id IS NULL THEN s.target_type ELSE 'release' END AS target_type, coalesce(m.to_id, s.target_id) AS target_id, NULL AS why
FROM stored s LEFT JOIN (SELECT * FROM ranked WHERE free AND rn = 1) m ON m.user_id = s.user_id AND m.target_type = s.target_type AND m.target_id = s.target_id
UNION ALL SELECT user_id, target_type, target_id, 'not owned by this user' FROM told WHERE by_user <> user_id UNION ALL SELECT user_id, target_type, target_id, 'already saved' FROM ranked WHERE NOT free OR rn > 1""")
def command_retarget_items_of_users(spark: SparkSession, d: str) -> DataFrame:
    """Two thirds of the items get the neighbour of their target, as a release."""
    items, k = _items(spark, d), F.col("target_id")
    by_user = F.when(k % 7 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
    told = items.where(k % 3 < 2).select(F.struct("user_id", "target_type", "target_id").alias("ord"), by_user.alias("by_user"), *U.ITEM, F.lit("release").alias("to_type"), (k + 1 - 2 * (k % 2)).alias("to_id"))
    rows, refused = U.retarget_items(items, told)
    return rows.withColumn("why", F.lit(None).cast("string")).unionByName(refused.select(*U.ITEM, "why"))


@query(f"""
WITH {_ITEMS}, told AS (SELECT *, CASE WHEN target_id % 7 = 0 THEN user_id + 1 ELSE user_id END AS by_user FROM stored WHERE target_id % 2 = 0)
SELECT user_id, target_type, target_id, NULL AS why FROM stored WHERE NOT (target_id % 2 = 0 AND target_id % 7 > 0)
UNION ALL SELECT user_id, target_type, target_id, 'not owned by this user' FROM told WHERE by_user <> user_id
UNION ALL SELECT user_id, 'label', target_id, 'not there' FROM stored WHERE target_id % 2 = 1""")
def command_remove_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of even targets removed, and labels that nobody saved."""
    items, k = _items(spark, d), F.col("target_id")
    told = items.select(F.when((k % 7 == 0) & (k % 2 == 0), F.col("user_id") + 1).otherwise(F.col("user_id")).alias("by_user"), "user_id", F.when(k % 2 == 1, "label").otherwise(F.col("target_type")).alias("target_type"), "target_id", F.struct(*U.ITEM).alias("ord"))
    rows, refused = U.remove_items(items, told)
    return rows.withColumn("why", F.lit(None).cast("string")).unionByName(refused.select(*U.ITEM, "why"))


@query("""
WITH told AS (SELECT l_partkey, max_by(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS o FROM lineitem GROUP BY 1),
was AS (SELECT p_partkey, p_size::BIGINT AS o FROM part)
SELECT 'set' AS kind, coalesce(t.o, w.o) AS src_id, coalesce(l_partkey, p_partkey) AS dst_id, CASE WHEN t.o IS NULL OR t.o = w.o THEN 'old' ELSE 'new' END AS edge_id
FROM was w FULL JOIN told t ON l_partkey = p_partkey UNION ALL SELECT 'other', w.o, p_partkey, 'old' FROM was w""")
def command_adopt(spark: SparkSession, d: str) -> DataFrame:
    """Parts go to the order of their last line; edges of another kind stay."""
    size = F.col("p_size").cast("long").alias("src_id")
    parts = table(spark, d, "part").select(size, F.col("p_partkey").alias("dst_id"), F.lit("old").alias("edge_id"))
    edges = parts.withColumn("kind", F.lit("set")).unionByName(parts.withColumn("kind", F.lit("other")))
    adds = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src_id"), F.col("l_partkey").alias("dst_id"), F.lit("new").alias("edge_id"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("ord"))
    return C.adopt(edges, adds, "set").select("kind", "src_id", "dst_id", "edge_id")


@query("""
WITH sets AS (SELECT 's' || c_custkey AS id FROM customer WHERE c_custkey % 10 > 0), held AS (SELECT 'r' || p_partkey AS id FROM part WHERE p_partkey % 2 = 0),
told AS (SELECT event_id, 's' || user_id AS src_id, 'r' || event_id // 3 AS entity_id FROM events),
said AS (SELECT t.*, CASE WHEN s.id IS NULL THEN 'no such release set' WHEN h.id IS NOT NULL OR row_number() OVER (PARTITION BY entity_id, s.id IS NULL ORDER BY event_id) > 1 THEN 'the id is taken' END AS why
  FROM told t LEFT JOIN sets s ON s.id = src_id LEFT JOIN held h ON h.id = entity_id)
SELECT event_id, entity_id, src_id, why FROM said WHERE why IS NOT NULL UNION ALL SELECT NULL, entity_id, src_id, NULL FROM said WHERE why IS NULL
UNION ALL SELECT NULL, id, NULL, NULL FROM sets UNION ALL SELECT NULL, id, NULL, NULL FROM held""")
def command_create_releases(spark: SparkSession, d: str) -> DataFrame:
    """Events make releases in the sets of their users, three to an id."""
    named = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    sets = table(spark, d, "customer").where("c_custkey % 10 > 0").select(named("s", F.col("c_custkey")).alias("entity_id"), F.lit("release_set").alias("entity_type"))
    held = table(spark, d, "part").where("p_partkey % 2 = 0").select(named("r", F.col("p_partkey")).alias("entity_id"), F.lit("release").alias("entity_type"))
    k = F.col("event_id")
    told = table(spark, d, "events").select(k.alias("ord"), named("s", F.col("user_id")).alias("src_id"), named("r", F.floor(k / 3)).alias("entity_id"))
    edges = spark.createDataFrame([], "edge_id string, kind string, src_id string, dst_id string")
    entities, edges, refused = C.create_releases(sets.unionByName(held), edges, told)
    owner = edges.select(F.col("dst_id").alias("entity_id"), "src_id")
    kept = entities.join(owner, "entity_id", "left").select(F.lit(None).cast("long").alias("event_id"), "entity_id", "src_id", F.lit(None).cast("string").alias("why"))
    return kept.unionByName(refused.select(F.col("ord").alias("event_id"), "entity_id", "src_id", "why"))
