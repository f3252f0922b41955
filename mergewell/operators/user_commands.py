"""Commands of users on their library items and plays.

A command is a row with an order (`ord`, unique within a call) and the user who gives it (`by_user`).
Each function takes the stored rows and a frame of commands and tells what became of them: the rows
after all commands that hold, what these added or put, and the commands that do not, with `why`. Of
several commands to one row the first counts and the others are refused. Only stored rows that the
commands can mean are read for the decisions. Empty frames change nothing, a null in a key names no
row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergewell.operators.merge import first_of
from mergewell.operators.prune import meeting

ITEM, PLAY = ["user_id", "target_type", "target_id"], ["user_id", "source", "played_at"]


@dataclass
class Told:
    """Rows after the commands, refused commands, and what changed: rows under new keys, or rows in
    place of those with their keys; neither where rows went or changed their keys."""

    rows: DataFrame
    refused: DataFrame
    added: DataFrame | None = None
    put: DataFrame | None = None

    def __iter__(self) -> Iterator[DataFrame]:
        return iter((self.rows, self.refused))


def _first_why(*rules: tuple[Column, str]) -> Column:
    """The text of the first rule that is broken, or null."""
    out = F.lit(None).cast("string")
    for broken, why in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), why).otherwise(out)
    return out


def _one_each(commands: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(first command to each row, refused later ones)."""
    first = first_of(commands, by, ["ord"])
    later = commands.join(first.select("ord"), "ord", "left_anti")
    return first, later.withColumn("why", F.lit("another command names the row"))


def _meet(stored: DataFrame, commands: DataFrame, by: list[str], rules: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """(commands that hold, refused ones). The row that a command names is `held`, a struct, null
    where it is not stored."""
    first, later = _one_each(commands, by)
    held = meeting(stored, commands, by).select(*by, F.struct(*stored.columns).alias("held")).where(" and ".join(f"{c} is not null" for c in by))
    met = first.join(held, by, "left").withColumn("why", _first_why(*rules))
    refused = met.where("why is not null").select(*commands.columns, "why").unionByName(later.select(*commands.columns, "why"))
    return met.where("why is null").drop("why"), refused


def _stored_as(stored: DataFrame, commands: DataFrame) -> list[Column]:
    """The columns of stored rows as new commands give them, null where they don't."""
    return [(F.col(c) if c in commands.columns else F.lit(None)).cast(stored.schema[c].dataType).alias(c) for c in stored.columns]


_FOREIGN = "not owned by this user"
_GONE = "not there"


def _foreign() -> tuple[Column, str]:
    return ~F.col("by_user").eqNullSafe(F.col("user_id")), _FOREIGN


def _incomplete(by: list[str]) -> tuple[Column, str]:
    missing = F.lit(False)
    for c in by:
        missing = missing | F.col(c).isNull()
    return missing, "incomplete key"


def _add(stored: DataFrame, commands: DataFrame, by: list[str], rules: list[tuple[Column, str]], there: str | None) -> Told:
    """Adds rows; where one is there already it stays, which is refused if `there` says why."""
    every = [_incomplete(by), *rules, *([(F.col("held").isNotNull(), there)] if there else [])]
    good, refused = _meet(stored, commands, by, every)
    new = good.where("held is null").select(*_stored_as(stored, commands))
    return Told(stored.unionByName(new), refused, added=new)


def _remove(stored: DataFrame, commands: DataFrame, by: list[str]) -> Told:
    good, refused = _meet(stored, commands, by, [_foreign(), (F.col("held").isNull(), _GONE)])
    return Told(stored.join(good.select(*by), by, "left_anti").select(*stored.columns), refused)


def save_references(items: DataFrame, saves: DataFrame) -> Told:
    """Saves targets (target_type, target_id, source, saved_at) to the library of `by_user`."""
    given = saves.withColumn("user_id", F.col("by_user"))
    told = _add(items, given, ITEM, [], "already saved")
    return Told(told.rows, told.refused.select(*saves.columns, "why"), told.added)


def save_entities(items: DataFrame, entities: DataFrame, saves: DataFrame) -> Told:
    """Saves entities (entity_id): the item names the one that stands for it, by `canonical_id`, and
    has that one's type."""
    known = entities.select("entity_id", F.col("entity_type").alias("target_type"), F.coalesce("canonical_id", "entity_id").alias("target_id"))
    met = saves.join(known, "entity_id", "left")
    unknown = met.where("target_id is null").select(*saves.columns, F.lit("no such entity").alias("why"))
    told = save_references(items, met.where("target_id is not null"))
    return Told(told.rows, told.refused.select(*saves.columns, "why").unionByName(unknown), told.added)


def remove_items(items: DataFrame, commands: DataFrame) -> Told:
    """Removes items (user_id, target_type, target_id)."""
    return _remove(items, commands, ITEM)


def rehydrate_items(items: DataFrame, detached: DataFrame) -> Told:
    """Attaches detached items to the user they belong to; those that are there stay as they are."""
    return _add(items, detached, ITEM, [_foreign()], None)


def retarget_items(items: DataFrame, commands: DataFrame) -> Told:
    """Items of a user (user_id, target_type, target_id) get other targets (to_type, to_id). What the
    user has saved before the call is in the way, also where it moves in the same call; of several
    moves to one target the first counts."""
    good, refused = _meet(items, commands, ITEM, [_foreign(), (F.col("held").isNull(), _GONE), (F.col("to_id").isNull() | F.col("to_type").isNull(), "no target")])
    to = ["user_id", "to_type", "to_id"]
    moved = good.where("to_type <> target_type or to_id <> target_id")
    saved = items.select("user_id", F.col("target_type").alias("to_type"), F.col("target_id").alias("to_id"))
    first = first_of(moved, to, ["ord"]).join(saved, to, "left_anti")
    lost = moved.join(first.select("ord"), "ord", "left_anti")
    put = first.select(*[F.col(f"to_{c[7:]}").alias(c) if c in ITEM[1:] else F.col("held")[c].alias(c) for c in items.columns])
    rows = items.join(first.select(*ITEM), ITEM, "left_anti").select(*items.columns).unionByName(put)
    return Told(rows, refused.unionByName(lost.select(*commands.columns, F.lit("already saved").alias("why"))))


def _with_track(commands: DataFrame, tracks: DataFrame) -> DataFrame:
    """Commands with `track_of`, the recording of the track they name."""
    of = tracks.select("track_id", F.col("recording_id").alias("track_of"))
    return commands.join(of, "track_id", "left")


def _track_rules() -> list[tuple[Column, str]]:
    named = F.col("track_id").isNotNull()
    return [
        (named & F.col("track_of").isNull(), "no such track"),
        (named & F.col("recording_id").isNotNull() & (F.col("track_of") != F.col("recording_id")), "the track has another recording"),
        (~named & F.col("recording_id").isNull(), "neither track nor recording"),
    ]


def log_plays(plays: DataFrame, tracks: DataFrame, commands: DataFrame) -> Told:
    """Logs plays of `by_user` (source, played_at, recording_id, track_id): a play has its track, or
    else its recording, never both."""
    given = _with_track(commands, tracks).withColumn("user_id", F.col("by_user"))
    good, refused = _meet(plays, given, PLAY, [_incomplete(PLAY), *_track_rules(), (F.col("held").isNotNull(), "already logged")])
    new = good.withColumn("recording_id", F.when(F.col("track_id").isNull(), F.col("recording_id")))
    new = new.select(*_stored_as(plays, new))
    return Told(plays.unionByName(new), refused.select(*commands.columns, "why"), added=new)


def remove_plays(plays: DataFrame, commands: DataFrame) -> Told:
    """Removes plays (user_id, source, played_at)."""
    return _remove(plays, commands, PLAY)


def rehydrate_plays(plays: DataFrame, detached: DataFrame) -> Told:
    """Attaches detached plays to the user they belong to; those that are there stay as they are."""
    return _add(plays, detached, PLAY, [_foreign()], None)


def _change_plays(plays: DataFrame, commands: DataFrame, rules: list[tuple[Column, str]], track: Column, recording: Column) -> Told:
    """Plays that commands name, with another track and recording."""
    good, refused = _meet(plays, commands, PLAY, [_foreign(), (F.col("held").isNull(), _GONE), *rules])
    new = {"track_id": track, "recording_id": recording}
    rows = good.select(*[new[c].alias(c) if c in new else F.col(c) if c in PLAY else F.col("held")[c].alias(c) for c in plays.columns])
    rest = plays.join(rows.select(*PLAY), PLAY, "left_anti").select(*plays.columns)
    return Told(rest.unionByName(rows), refused.select(*[c for c in commands.columns if c != "track_of"], "why"), put=rows)


def rebind_plays(plays: DataFrame, tracks: DataFrame, commands: DataFrame) -> Told:
    """Plays get another recording, or a track of it, whatever they had."""
    return _change_plays(plays, _with_track(commands, tracks), _track_rules(), F.col("track_id"), F.when(F.col("track_id").isNull(), F.col("recording_id")))


def link_plays(plays: DataFrame, tracks: DataFrame, commands: DataFrame) -> Told:
    """Plays of a recording become plays of a track (track_id) of that recording. One that has the
    track already stays; one that has another is refused."""
    now, of = F.col("held.track_id"), F.col("held.recording_id")
    same = now.eqNullSafe(F.col("track_id"))
    rules = [
        (F.col("track_of").isNull(), "no such track"),
        (now.isNotNull() & ~same, "already linked to a track"),
        (~same & of.isNull(), "no recording to replace"),
        (~same & (F.col("track_of") != of), "the track has another recording"),
    ]
    return _change_plays(plays, _with_track(commands, tracks), rules, F.col("track_id"), F.when(same, of))


def move_plays(plays: DataFrame, commands: DataFrame) -> Told:
    """Plays of a recording become plays of another one (recording_id); a play of a track is refused."""
    rules = [(F.col("held.track_id").isNotNull(), "already linked to a track"), (F.col("recording_id").isNull(), "no recording")]
    return _change_plays(plays, commands, rules, F.lit(None).cast(plays.schema["track_id"].dataType), F.col("recording_id"))
