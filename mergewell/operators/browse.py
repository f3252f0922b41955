"""Faceted browsing of a library and the way down to the tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facets(rows: DataFrame, by: dict[str, Column], *sums: Column) -> DataFrame:
    """(facet, value, n and the sums) of every value of every facet, in one pass over the rows:
    each is a grouping set, and `total` is that of all rows."""
    named = rows.withColumns({f"_{f}": c.cast("string") for f, c in by.items()})
    cols = [f"_{f}" for f in by]
    counted = named.groupingSets([*[[c] for c in cols], []], *cols).agg(F.count("*").alias("n"), *sums, *[F.grouping(c).alias(f"g{c}") for c in cols])
    facet, value = F.lit("total"), F.lit(None).cast("string")
    for f, c in zip(by, cols, strict=True):
        facet, value = F.when(F.col(f"g{c}") == 0, f).otherwise(facet), F.when(F.col(f"g{c}") == 0, F.col(c)).otherwise(value)
    return counted.withColumns({"facet": facet, "value": value}).drop(*cols, *[f"g{c}" for c in cols])


def drill_down(tracks: DataFrame) -> DataFrame:
    """(release_id, n_tracks, discs): of each release its discs in order and on each its tracks in
    order (track_number, recording_id). Tracks are put together by disc first."""
    listed = F.array_sort(F.collect_list(F.struct("track_number", "recording_id")))
    discs = tracks.groupBy("release_id", "disc_number").agg(listed.alias("tracks"), F.count("*").alias("n"))
    whole = F.array_sort(F.collect_list(F.struct("disc_number", "tracks")))
    return discs.groupBy("release_id").agg(F.sum("n").alias("n_tracks"), whole.alias("discs"))
