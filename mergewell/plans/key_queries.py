"""Queries of key derivation: the driver's tables play the catalog's entities.

part is recording (title p_name, artist p_brand, price as milliseconds), supplier label, customer
user, orders release set and release, lineitem release track, events play event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergewell.functions.text import normalize_text
from mergewell.operators import keys as K
from mergewell.plans.catalogue import query, table
from mergewell.plans.scalar_queries import NORM


def ids(namespace: str, value: Column, when: Column) -> Column:
    """One external id on some rows."""
    one = F.array(F.struct(F.lit(namespace).alias("namespace"), value.cast("string").alias("value")))
    return F.when(when, one).otherwise(F.array().cast(K.IDS))


def long(df: DataFrame, id_col: str, keys: Column) -> DataFrame:
    return df.select(id_col, F.posexplode(keys).alias("key_ord", "key"))


def _ranked(id_col: str, parts: list[str], source: str) -> str:
    """SQL of the long key frame from key expressions in order, null where incomplete."""
    listed = ", ".join(parts)
    return f"""
WITH x AS (SELECT {id_col}, list_filter([{listed}], lambda k: k IS NOT NULL) AS ks FROM ({source}))
SELECT {id_col}, CAST(generate_subscripts(ks, 1) - 1 AS INTEGER) AS key_ord, unnest(ks) AS key FROM x"""


def _j(*parts: str) -> str:
    """SQL of a JSON array of a kind and text expressions."""
    head, *rest = parts
    return f"""'["{head}"' || {" || ".join(f"',' || {p}" for p in rest)} || ']'"""


def _q(expr: str) -> str:
    return f"""('"' || {expr} || '"')"""


@query(_ranked("s_suppkey", [
    f"CASE WHEN s_suppkey % 2 = 0 THEN {_j('artist:external_id', _q(chr(39) + 'musicbrainz:artist' + chr(39)), _q('s_suppkey'))} END",
    f"CASE WHEN s_suppkey % 2 = 0 THEN {_j('artist:mbid', _q('s_suppkey'))} END",
    _j("artist:source-name", _q("'lastfm'"), _q("n")), _j("artist:name", _q("n")),
], f"SELECT s_suppkey, {NORM.format('s_name')} AS n FROM supplier"))
def keys_artist(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", normalize_text(F.col("s_name")).alias("n"))
    sources = F.array(F.lit("spotify"), F.lit("lastfm"))
    return long(s, "s_suppkey", K.artist_keys(F.col("n"), sources, ids("musicbrainz:artist", F.col("s_suppkey"), F.col("s_suppkey") % 2 == 0)))


@query(_ranked("s_suppkey", [_j("label:source-name", _q("'musicbrainz'"), _q("n")), _j("label:name", _q("n"))], f"SELECT s_suppkey, {NORM.format('s_name')} AS n FROM supplier"))
def keys_label(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", normalize_text(F.col("s_name")).alias("n"))
    return long(s, "s_suppkey", K.label_keys(F.col("n"), F.array(F.lit("musicbrainz")), F.array().cast(K.IDS)))


_REC = f"SELECT p_partkey, {NORM.format('p_name')} AS t, {NORM.format('p_brand')} AS a, CAST(floor(CAST(round(p_retailprice * 1000) AS BIGINT) / 2000.0) AS BIGINT) AS b FROM part"


def _recordings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", normalize_text(F.col("p_name")).alias("t"), normalize_text(F.col("p_brand")).alias("a"), F.round(F.col("p_retailprice") * 1000).cast("long").alias("ms"))


def _recording_keys() -> Column:
    return K.recording_keys(F.col("t"), F.col("a"), F.col("ms"), F.array(F.lit("spotify")), ids("recording:isrc", F.col("p_partkey"), F.col("p_partkey") % 5 == 0))


@query(_ranked("p_partkey", [
    f"CASE WHEN p_partkey % 5 = 0 THEN {_j('recording:external_id', _q(chr(39) + 'recording:isrc' + chr(39)), _q('p_partkey'))} END",
    _j("recording:artist-title-duration", _q("a"), _q("t"), "CAST(b AS VARCHAR)"), _j("recording:source-artist-title", _q("'spotify'"), _q("a"), _q("t")), _j("recording:artist-title", _q("a"), _q("t")),
], _REC))
def keys_recording(spark: SparkSession, d: str) -> DataFrame:
    return long(_recordings(spark, d), "p_partkey", _recording_keys())


@query(f"""
WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN {_j('recording:external_id', _q(chr(39) + 'recording:isrc' + chr(39)), _q('p_partkey'))}
  ELSE {_j('recording:artist-title-duration', _q('a'), _q('t'), 'CAST(b AS VARCHAR)')} END AS identity FROM ({_REC})) SELECT * FROM x""")
def preferred_identity_key(spark: SparkSession, d: str) -> DataFrame:
    r = _recordings(spark, d).select("p_partkey", _recording_keys().alias("ks"))
    return r.select("p_partkey", K.identity_key(F.col("ks")).alias("identity"))


_SETS = f"SELECT o_orderkey, {NORM.format('o_orderpriority')} AS t, CASE WHEN o_custkey % 2 = 0 THEN {NORM.format('o_orderstatus')} END AS a, o_custkey % 3 = 0 AS identified FROM orders"


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        "o_orderkey", normalize_text(F.col("o_orderpriority")).alias("t"), F.when(F.col("o_custkey") % 2 == 0, normalize_text(F.col("o_orderstatus"))).alias("a"), (F.col("o_custkey") % 3 == 0).alias("identified")
    )


@query(_ranked("o_orderkey", [
    f"CASE WHEN identified THEN {_j('release_set:child_release_external_id', _q(chr(39) + 'musicbrainz:release' + chr(39)), _q('o_orderkey'))} END",
    f"CASE WHEN a IS NOT NULL THEN {_j('release_set:source-artist-title', _q(chr(39) + 'lastfm' + chr(39)), _q('a'), _q('t'))} END",
    f"CASE WHEN a IS NOT NULL THEN {_j('release_set:artist-title', _q('a'), _q('t'))} END",
    f"CASE WHEN a IS NULL AND NOT identified THEN {_j('release_set:source-title', _q(chr(39) + 'lastfm' + chr(39)), _q('t'))} END",
], _SETS))
def keys_release_set(spark: SparkSession, d: str) -> DataFrame:
    children = ids("musicbrainz:release", F.col("o_orderkey"), F.col("identified"))
    return long(_sets(spark, d), "o_orderkey", K.release_set_keys(F.col("t"), F.col("a"), F.array(F.lit("lastfm")), F.array().cast(K.IDS), children))


@query(_ranked("o_orderkey", [
    f"CASE WHEN identified THEN {_j('release:external_id', _q(chr(39) + 'musicbrainz:release' + chr(39)), _q('o_orderkey'))} END",
    f"CASE WHEN identified THEN {_j('release:mbid', _q('o_orderkey'))} END",
    f"CASE WHEN a IS NOT NULL THEN {_j('release:source-artist-title', _q(chr(39) + 'lastfm' + chr(39)), _q('a'), _q('t'))} END",
    f"CASE WHEN a IS NOT NULL THEN {_j('release:artist-title', _q('a'), _q('t'))} END",
    f"CASE WHEN a IS NULL AND NOT identified THEN {_j('release:source-title', _q(chr(39) + 'lastfm' + chr(39)), _q('t'))} END",
], _SETS))
def keys_release(spark: SparkSession, d: str) -> DataFrame:
    own = ids("musicbrainz:release", F.col("o_orderkey"), F.col("identified"))
    return long(_sets(spark, d), "o_orderkey", K.release_keys(F.col("t"), F.col("a"), F.array(F.lit("lastfm")), own))


@query(_ranked("c_custkey", [
    f"CASE WHEN c_custkey % 2 = 0 THEN {_j('user:lastfm', _q('c_name'))} END", f"CASE WHEN c_custkey % 3 = 0 THEN {_j('user:email', _q(chr(39) + 'u@example.org' + chr(39)))} END", _j("user:display_name", _q("n")),
], f"SELECT c_custkey, c_name, {NORM.format('c_name')} AS n FROM customer"))
def keys_user(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_name", normalize_text(F.col("c_name")).alias("n"))
    return long(c, "c_custkey", K.user_keys(F.when(k % 2 == 0, F.col("c_name")), F.lit(""), F.when(k % 3 == 0, "u@example.org"), F.col("n")))


_USER = _j("user:lastfm", _q("CAST(user_id AS VARCHAR)"))
_RECORD = _j("recording:mbid", _q("CAST(event_id % 100 AS VARCHAR)"))
_AT = _q("strftime(ts, '%Y-%m-%d %H:%M:%S')")


@query(_ranked("event_id", [_j("play_event:user-source-played_at", _USER, _q("event_type"), _AT), _j("play_event:recording-played_at", _RECORD, _AT)], "SELECT * FROM events"))
def keys_play_event(spark: SparkSession, d: str) -> DataFrame:
    user = K.key("user:lastfm", K.text_part(F.col("user_id").cast("string")))
    recording = K.key("recording:mbid", K.text_part((F.col("event_id") % 100).cast("string")))
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return long(table(spark, d, "events"), "event_id", K.play_event_keys(user, recording, F.lit(None).cast("string"), F.col("event_type"), at))


_TARGET = f"CASE WHEN event_id % 2 = 0 THEN {_RECORD} ELSE {_j('library_item:target', _q(chr(39) + 'recording' + chr(39)), _q('CAST(event_id % 100 AS VARCHAR)'))} END"


@query(_ranked("event_id", [_j("library_item:user-target", _USER, _q("'recording'"), _TARGET), _j("library_item:user-source-target", _USER, _q("event_type"), _q("'recording'"), _TARGET)], "SELECT * FROM events"))
def keys_library_item(spark: SparkSession, d: str) -> DataFrame:
    user = K.key("user:lastfm", K.text_part(F.col("user_id").cast("string")))
    number = (F.col("event_id") % 100).cast("string")
    known = F.when(F.col("event_id") % 2 == 0, K.key("recording:mbid", K.text_part(number)))
    target = K.library_target(known, F.lit("recording"), number)
    return long(table(spark, d, "events"), "event_id", K.library_item_keys(user, F.col("event_type"), F.lit("recording"), target))


_RELEASE = _j("release:mbid", _q("CAST(l_orderkey AS VARCHAR)"))
_REC2 = _j("recording:mbid", _q("CAST(l_partkey AS VARCHAR)"))


@query(f"""
SELECT l_orderkey, l_partkey, l_linenumber, {_j('release_track:release-recording', _RELEASE, _REC2)} AS by_recording,
  {_j('release_track:release-position', _RELEASE, "'1'", 'CAST(l_linenumber AS VARCHAR)')} AS by_position FROM lineitem""")
def keys_release_track(spark: SparkSession, d: str) -> DataFrame:
    release = K.key("release:mbid", K.text_part(F.col("l_orderkey").cast("string")))
    recording = K.key("recording:mbid", K.text_part(F.col("l_partkey").cast("string")))
    ks = K.release_track_keys(release, recording, F.lit(1), F.col("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", ks.alias("ks")).select("l_orderkey", "l_partkey", "l_linenumber", F.get("ks", F.lit(0)).alias("by_recording"), F.get("ks", F.lit(1)).alias("by_position"))


_ROLE = "CASE l_linenumber % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'featured' ELSE 'unknown' END"


def _role() -> Column:
    n = F.col("l_linenumber") % 3
    return F.when(n == 0, "primary").when(n == 1, "featured")


@query(f"""
SELECT l_orderkey, l_suppkey, l_linenumber, {_j('recording_contribution:recording-artist-role', _RELEASE, _q('CAST(l_suppkey AS VARCHAR)'), _q(_ROLE))} AS by_role,
  {_j('recording_contribution:recording-artist-credit_order', _RELEASE, _q('CAST(l_suppkey AS VARCHAR)'), "CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber AS VARCHAR) ELSE '-1' END")} AS by_order FROM lineitem""")
def keys_contribution(spark: SparkSession, d: str) -> DataFrame:
    owner = K.key("release:mbid", K.text_part(F.col("l_orderkey").cast("string")))
    artist = K.text_part(F.col("l_suppkey").cast("string"))
    ks = K.contribution_keys("recording", owner, artist, _role(), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", ks.alias("ks")).select("l_orderkey", "l_suppkey", "l_linenumber", F.get("ks", F.lit(0)).alias("by_role"), F.get("ks", F.lit(1)).alias("by_order"))


@query(f"""
WITH x AS (SELECT l_orderkey, {NORM.format('s_name')} AS artist, CASE WHEN l_linenumber % 3 = 0 THEN 0 WHEN l_linenumber % 3 = 1 THEN 1 ELSE 11 END AS p, l_linenumber AS o, l_partkey AS n, l_suppkey
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT l_orderkey, artist FROM x QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY p, o, n, l_suppkey) = 1""")
def primary_artist_by_role(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "supplier").select("s_suppkey", normalize_text(F.col("s_name")).alias("artist_name"))
    credits = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", _role().alias("role"), F.col("l_linenumber").alias("credit_order"), F.struct("l_partkey", "l_suppkey").alias("ord"))
    return K.primary_artist(credits.join(names, F.col("l_suppkey") == F.col("s_suppkey")), "l_orderkey")


def recording_claims(spark: SparkSession, d: str) -> DataFrame:
    """Recordings as claims with their last key, the artist and title."""
    ks = K.recording_keys(F.col("t"), F.col("a"), F.col("ms"), F.array(F.lit("spotify")), F.array().cast(K.IDS))
    return _recordings(spark, d).select("p_partkey", "t", "a", F.element_at(ks, -1).alias("key"))


