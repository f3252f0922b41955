"""Ranking of candidate releases for a stored release."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergewell.functions.text import title_score, track_count_score


def aggregate_hits(found: DataFrame) -> DataFrame:
    """Candidates of each release with the number of its recordings that led to them and the
    first payload. Columns: release_id, recording_id, mbid, ord, title, track_count."""
    first = F.min_by(F.struct("title", "track_count"), "ord").alias("p")
    return found.groupBy("release_id", "mbid").agg(F.countDistinct("recording_id").alias("hits"), first).select("release_id", "mbid", "hits", "p.*")


def rank(candidates: DataFrame, releases: DataFrame) -> DataFrame:
    """Adds title_score, track_score and rank. releases: release_id, local_title, n_tracks."""
    met = candidates.join(releases, "release_id").withColumns({"title_score": title_score(F.col("local_title"), F.col("title")), "track_score": track_count_score(F.col("n_tracks"), F.col("track_count"))})
    order = Window.partitionBy("release_id").orderBy(F.desc("title_score"), F.desc("hits"), F.desc("track_score"), F.coalesce("title", F.lit("")), "mbid")
    return met.withColumn("rank", F.row_number().over(order))


def confident(ranked: DataFrame) -> DataFrame:
    """The top candidate where its title matches and it strictly beats the runner-up on title,
    hits and track count."""
    w = Window.partitionBy("release_id").orderBy("rank")
    score = F.struct("title_score", "hits", "track_score")
    top = ranked.where("rank <= 2").withColumn("_next", F.lead(score).over(w)).where("rank = 1")
    return top.where((F.col("title_score") > 0) & (F.col("_next").isNull() | (score > F.col("_next")))).drop("_next")


def waterfall(sources: list[DataFrame], by: str = "release_id", order: str = "ord") -> DataFrame:
    """First candidate of the first source that has any: own ids, then browsing, then ..."""
    every = None
    for level, df in enumerate(sources):
        one = df.withColumn("level", F.lit(level))
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    cols = [c for c in every.columns if c != by]
    return every.groupBy(by).agg(F.min_by(F.struct(*cols), F.struct("level", order)).alias("c")).select(by, "c.*")


def without_source(releases: DataFrame, provider: str, limit: int | None = None, order: str = "entity_id") -> DataFrame:
    """Releases that a provider has not confirmed yet; the limit counts those alone."""
    left = releases.where(~F.coalesce(F.array_contains("sources", provider), F.lit(False)))
    return left.orderBy(order).limit(limit) if limit is not None else left


def anchor(requests: DataFrame, external_ids: DataFrame, reason: str) -> DataFrame:
    """Speculative ids (release_id, owner_type, owner_id, namespace, value) against stored ones:
    accepted, or under review where another owner has the value, with the reason. Of several
    requests for one value in the batch the first release wins."""
    held = external_ids.select("namespace", "value", "owner_type", F.col("owner_id").alias("_holder"))
    w = Window.partitionBy("namespace", "value", "owner_type").orderBy("release_id")
    met = requests.withColumn("_first", F.first("owner_id").over(w)).join(held, ["namespace", "value", "owner_type"], "left")
    clash = F.coalesce(F.col("_holder"), F.col("_first")) != F.col("owner_id")
    return met.withColumns({"accepted": ~clash, "reason": F.when(clash, reason), "holder": F.when(clash, F.coalesce("_holder", "_first"))}).drop("_holder", "_first")


def anchor_mismatch(roots: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Root claims (claim_id, release_id) that did not resolve to the release they were fetched
    for; these go to review and none of their anchors are kept."""
    met = roots.join(resolutions.select("claim_id", "status", "target_id"), "claim_id", "left")
    return met.where(~((F.col("status") == "resolved") & F.col("target_id").eqNullSafe(F.col("release_id")))).withColumn("reason", F.lit("musicbrainz_anchor_mismatch"))
