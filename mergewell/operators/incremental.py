"""Incremental ingestion of events and library items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(events: DataFrame, at: str = "played_at") -> DataFrame:
    """Latest stored time, over all users and sources."""
    return events.agg(F.max(at).alias("latest"))


def new_events(fetched: DataFrame, stored: DataFrame, after: Column | None = None, until: Column | None = None, by: tuple[str, ...] = ("user_id", "source", "played_at"), at: str = "played_at", order: str = "ord") -> DataFrame:
    """Fetched events after `after` (exclusive) and up to `until` (inclusive) that are not stored,
    the first fetched of each key. The bounds filter the scan; a partial aggregate takes repeats
    out before the anti-join."""
    rows = fetched
    if after is not None:
        rows = rows.where(F.col(at) > after)
    if until is not None:
        rows = rows.where(F.col(at) <= until)
    cols = [c for c in rows.columns if c not in by]
    first = rows.groupBy(*by).agg(F.min_by(F.struct(*cols), order).alias("_f")).select(*by, "_f.*")
    return first.join(stored.select(*by), list(by), "left_anti")


def split_late(events: DataFrame, watermarks: DataFrame, stored: DataFrame, by: tuple[str, ...] = ("user_id", "source"), at: str = "played_at", order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(events after their watermark, late ones): what is at its watermark (by, latest) or before it
    is late, unless it is stored already, which is a repeat; of equal late events the first."""
    met = events.join(watermarks.select(*by, "latest"), list(by), "left")
    behind = F.coalesce(F.col(at) <= F.col("latest"), F.lit(False))
    late = new_events(met.where(behind).drop("latest"), stored, by=(*by, at), at=at, order=order)
    return met.where(~behind).drop("latest"), late


def advance(watermarks: DataFrame, events: DataFrame, by: tuple[str, ...] = ("user_id", "source"), at: str = "played_at") -> DataFrame:
    """(by, latest) of the watermarks that these events move forward."""
    newest = events.groupBy(*by).agg(F.max(at).cast("timestamp").alias("_newest"))
    met = newest.join(watermarks.select(*by, "latest"), list(by), "left").where("latest is null or _newest > latest")
    return met.select(*by, F.col("_newest").alias("latest"))


def split_now_playing(rows: DataFrame, flag: str = "now_playing") -> tuple[DataFrame, DataFrame]:
    """(dated rows, the rows that are playing now and are not stored)."""
    playing = F.coalesce(F.col(flag), F.lit(False))
    return rows.where(~playing), rows.where(playing)


def new_library_items(items: DataFrame, stored: DataFrame, order: str = "ord") -> DataFrame:
    """Items to store: one for each user and target, none that is stored."""
    by = ["user_id", "target_type", "target_id"]
    cols = [c for c in items.columns if c not in by]
    first = items.groupBy(*by).agg(F.min_by(F.struct(*cols), order).alias("_f")).select(*by, "_f.*")
    return first.join(stored.select(*by), by, "left_anti")


def rebind(events: DataFrame, materialized: DataFrame) -> DataFrame:
    """Events with the track, else the recording, that their claims became. Events whose claims
    went to review keep null and are reported instead of failing the run."""
    track = materialized.select(F.col("claim_id").alias("_t"), F.col("entity_id").alias("track_id"))
    recording = materialized.select(F.col("claim_id").alias("_r"), F.col("entity_id").alias("recording_id"))
    met = events.join(track, F.col("track_claim_id") == F.col("_t"), "left").join(recording, F.col("recording_claim_id") == F.col("_r"), "left")
    return met.drop("_t", "_r").withColumn("recording_id", F.when(F.col("track_id").isNull(), F.col("recording_id")))
