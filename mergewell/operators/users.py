"""Reads of single users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ["id", "display_name", "email", "spotify_user_id", "lastfm_user"]


def get_user(users: DataFrame, user_id: str) -> DataFrame:
    """The user of that id, or no row. The filter reaches the scan."""
    return users.where(F.col("id") == user_id).select(*FIELDS)


def load_user(users: DataFrame, user_id: str) -> dict:
    """The user of that id; an id that nobody has is an error."""
    row = get_user(users, user_id).first()
    if row is None:
        raise LookupError(f"no user {user_id}")
    return row.asDict()
