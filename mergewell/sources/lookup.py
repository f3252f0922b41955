"""Lookups against landed metadata: by id, by text, by what holds them, and candidate releases.

What a provider answers one request at a time is a join here. Limits hold for each request and
are part of the lookup.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergewell.functions.text import normalize_title
from mergewell.operators.cut import checkpointed
from mergewell.operators.keys import first_in_window
from mergewell.operators.prune import meeting

SEARCH_LIMIT, BROWSE_LIMIT = 5, 25


def by_id(requests: DataFrame, rows: DataFrame, redirects: DataFrame | None = None, key: str = "mbid") -> DataFrame:
    """Requests (request_id, mbid) with the row of that id, or of the id it redirects to;
    redirected tells which, found is false for an id that is nowhere."""
    asked = requests.withColumn("_at", F.col(key))
    if redirects is not None:
        to = redirects.select(F.col("source_value").alias("_from"), F.col("target_value").alias("_to"))
        asked = asked.join(to, F.col(key) == F.col("_from"), "left").withColumn("_at", F.coalesce("_to", key)).drop("_from", "_to")
    held = rows.select(F.col(key).alias("_k"), F.struct("*").alias("payload"))
    met = asked.join(held, F.col("_at") == F.col("_k"), "left")
    return met.select("request_id", F.col(key).alias("requested"), F.col("_at").alias("resolved"), (F.col("_at") != F.col(key)).alias("redirected"), F.col("payload").isNotNull().alias("found"), "payload")


def search(requests: DataFrame, rows: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Requests (request_id, title, artist) with the rows (mbid, title, artist) of the same title
    and artist, the first by id; a blank title finds nothing, a blank artist any artist."""
    ask = requests.select("request_id", normalize_title(F.col("title")).alias("_t"), normalize_title(F.col("artist")).alias("_a")).where("_t <> ''")
    held = rows.select("*", normalize_title(F.col("title")).alias("_t"), normalize_title(F.col("artist")).alias("_ra")).where("_t <> ''")
    # However many rows a title has, requests meet the first of them alone.
    anyone = F.col("_a").isNull() | (F.col("_a") == "")
    by_title = ask.where(anyone).drop("_a").join(_first(held, ["_t"], rows.columns, limit).drop("_ra"), "_t")
    by_both = ask.where(~anyone).join(_first(held.where("_ra is not null"), ["_t", "_ra"], rows.columns, limit).withColumnRenamed("_ra", "_a"), ["_t", "_a"])
    return top(by_title.unionByName(by_both.drop("_a")).drop("_t"), limit)


def _first(held: DataFrame, by: list[str], cols: list[str], limit: int) -> DataFrame:
    """The first `limit` different rows of each group, in the order that `top` has."""
    order = ["mbid", *[c for c in cols if c != "mbid"]]
    ranked = held.withColumn("_n", F.dense_rank().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= limit)
    return ranked.drop("_n").distinct()


def browse(requests: DataFrame, rows: DataFrame, by: str, limit: int = BROWSE_LIMIT) -> DataFrame:
    """Rows that a release group, an artist or a release holds: requests (request_id, by)."""
    return top(requests.where(F.col(by).isNotNull()).join(rows, by), limit)


def top(met: DataFrame, limit: int) -> DataFrame:
    """The first `limit` rows of each request by id."""
    cols = [c for c in met.columns if c != "request_id"]
    rows = met.groupBy("request_id").agg(F.array_sort(F.collect_set(F.struct("mbid", *[c for c in cols if c != "mbid"]))).alias("r"))
    return rows.select("request_id", F.posexplode(F.slice("r", 1, limit)).alias("ord", "x")).select("request_id", "ord", "x.*")


def release_candidates(recordings: DataFrame, known: DataFrame, listed: DataFrame) -> DataFrame:
    """Candidate releases of stored recordings (recording_id, mbid, title, artist): the releases
    of the recording with their id, or else, if there is none of that id, of those found by
    title and artist; each release once. listed: mbid of the recording, release_mbid, title,
    track_count, pos."""
    asked = recordings.withColumnRenamed("recording_id", "request_id")
    hit = by_id(asked.select("request_id", "mbid").where("mbid is not null"), known).where("found").select("request_id", F.col("resolved").alias("mbid"))
    rest = asked.join(hit.select("request_id"), "request_id", "left_anti")
    # Equal texts are looked up once.
    text = rest.select("request_id", F.struct("title", F.coalesce("artist", F.lit("")).alias("artist")).alias("text"))
    found = search(text.select(F.col("text").alias("request_id"), "text.title", "text.artist").distinct(), known)
    found = text.join(found.select(F.col("request_id").alias("text"), "mbid"), "text").select("request_id", "mbid")
    # Recordings that lead to the same ids share their releases, so what is put in order is each list
    # once, not every recording with all of it; the rows of the result leave the last join as they are.
    asks = hit.unionByName(found).groupBy(F.col("request_id").alias("recording_id")).agg(F.array_sort(F.collect_set("mbid")).alias("mbids"))
    asks = checkpointed(asks)
    once = first_in_window(listed.repartition("mbid"), ["mbid", "release_mbid"], ["pos"])
    direct = asks.where(F.size("mbids") == 1).select("recording_id", F.col("mbids")[0].alias("mbid")).join(once, "mbid")
    several = asks.where(F.size("mbids") > 1)
    each = checkpointed(several.select("mbids").distinct().select("mbids", F.explode("mbids").alias("mbid")))
    lists = first_in_window(each.join(meeting(listed, each, ["mbid"]), "mbid"), ["mbids", "release_mbid"], ["pos", "mbid"])
    return direct.unionByName(several.join(lists, "mbids").drop("mbids"))


def artist_names(releases: DataFrame) -> DataFrame:
    """Distinct artists of each release's recordings, as first seen: release_id, ord, artist."""
    first = releases.groupBy("release_id", "artist").agg(F.min("ord").alias("ord"))
    return first.groupBy("release_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "artist"))), lambda x: x["artist"]).alias("artists"))
