"""Users' commands on what is stored: a commit of them writes what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergewell.operators import user_commands as U
from mergewell.plans.engine import State


def tracks(state: State) -> DataFrame:
    """(track_id, recording_id) of the stored tracks."""
    return state.edges.where("kind = 'release_track'").select(F.col("edge_id").alias("track_id"), F.col("dst_id").alias("recording_id"))


def _entities(state: State) -> DataFrame:
    return state.entities.select("entity_id", "entity_type", F.lit(None).cast("string").alias("canonical_id"))


#: What users can say: the table it is about, its key and the command.
COMMANDS = {
    "save": ("library_items", U.ITEM, lambda s, c: U.save_entities(s.library_items, _entities(s), c)),
    "save_reference": ("library_items", U.ITEM, lambda s, c: U.save_references(s.library_items, c)),
    "remove_item": ("library_items", U.ITEM, lambda s, c: U.remove_items(s.library_items, c)),
    "rehydrate_item": ("library_items", U.ITEM, lambda s, c: U.rehydrate_items(s.library_items, c)),
    "retarget_item": ("library_items", U.ITEM, lambda s, c: U.retarget_items(s.library_items, c)),
    "log_play": ("play_events", U.PLAY, lambda s, c: U.log_plays(s.play_events, tracks(s), c)),
    "remove_play": ("play_events", U.PLAY, lambda s, c: U.remove_plays(s.play_events, c)),
    "rehydrate_play": ("play_events", U.PLAY, lambda s, c: U.rehydrate_plays(s.play_events, c)),
    "rebind_play": ("play_events", U.PLAY, lambda s, c: U.rebind_plays(s.play_events, tracks(s), c)),
    "link_play": ("play_events", U.PLAY, lambda s, c: U.link_plays(s.play_events, tracks(s), c)),
    "move_play": ("play_events", U.PLAY, lambda s, c: U.move_plays(s.play_events, c)),
}


def command(state: State, name: str, commands: DataFrame) -> tuple[State, DataFrame]:
    """(state after the commands, refused ones). Rows that are added or put are committed as such;
    removals and other targets write their table anew. A target or recording that is not stored
    fails the commit, as for any other writer."""
    table, by, tell = COMMANDS[name]
    told = tell(state, commands)
    if told.added is None and told.put is None:
        return State(**{**vars(state), table: told.rows}), told.refused
    return state.grown(table, told.rows, told.added, told.put, tuple(by)), told.refused
