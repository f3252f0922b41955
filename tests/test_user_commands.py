"""Commands of users on items and plays."""

import datetime as dt

import pytest

from mergewell.operators import user_commands as U
from mergewell.operators.persist import Store
from mergewell.plans import user_state
from mergewell.plans.engine import State, typed

T = [dt.datetime(2024, 1, 1, 12, i) for i in range(9)]
ITEM = "user_id string, target_type string, target_id string, source string"
PLAY = "user_id string, source string, played_at timestamp, recording_id string, track_id string"
KEY = "ord long, by_user string, user_id string, "
OF_ITEM, OF_PLAY = KEY + "target_type string, target_id string", KEY + "source string, played_at timestamp"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def why(df):
    return {r.ord: r.why for r in df.collect()}


@pytest.fixture(scope="module")
def plays(spark):
    return spark.createDataFrame([("u", "s", T[0], "r1", None), ("u", "s", T[1], None, "t1"), ("v", "s", T[0], "r2", None)], PLAY)


@pytest.fixture(scope="module")
def tracks(spark):
    return spark.createDataFrame([("t1", "r1"), ("t2", "r1"), ("t3", "r2")], "track_id string, recording_id string")


def test_saving_resolves_and_refuses_repeats(spark):
    items = spark.createDataFrame([("u", "artist", "a1", None)], ITEM)
    entities = spark.createDataFrame([("a1", "artist", None), ("a2", "artist", "a1"), ("r1", "recording", None)], "entity_id string, entity_type string, canonical_id string")
    saves = spark.createDataFrame([(1, "u", "a2", "x"), (2, "v", "a2", "x"), (3, "u", "r1", "x"), (4, "u", "r1", "y"), (5, "u", "gone", "x"), (6, None, "r1", "x"), (7, "u", None, "x")], "ord long, by_user string, entity_id string, source string")
    told = U.save_entities(items, entities, saves)
    assert rows(told.rows, "user_id", "target_type", "target_id", "source") == [("u", "artist", "a1", None), ("u", "recording", "r1", "x"), ("v", "artist", "a1", "x")]
    assert why(told.refused) == {1: "already saved", 4: "another command names the row", 5: "no such entity", 6: "incomplete key", 7: "no such entity"}
    assert told.added.count() == 2


def test_items_are_removed_and_attached_by_their_owner(spark):
    items = spark.createDataFrame([("u", "artist", "a", "x"), ("v", "artist", "a", "x"), ("u", None, "a", "x")], ITEM)
    told = U.remove_items(items, spark.createDataFrame([(1, "u", "u", "artist", "a"), (2, "u", "v", "artist", "a"), (3, "v", "v", "artist", "b"), (4, "u", "u", None, "a")], OF_ITEM))
    assert rows(told.rows, "user_id", "target_type") == [("u", None), ("v", "artist")]  # a null names no row
    assert why(told.refused) == {2: "not owned by this user", 3: "not there", 4: "not there"}
    back = U.rehydrate_items(told.rows, spark.createDataFrame([(1, "u", "u", "artist", "a"), (2, "u", "w", "artist", "a"), (3, "v", "v", "artist", "a")], OF_ITEM))
    assert rows(back.rows, "user_id", "target_type", "source") == [("u", "artist", None), ("u", None, "x"), ("v", "artist", "x")]
    assert why(back.refused) == {2: "not owned by this user"}


def test_retargeting(spark):
    items = spark.createDataFrame([("u", "artist", x, x) for x in "abcd"], ITEM)
    told = U.retarget_items(items, spark.createDataFrame([
        (1, "u", "u", "artist", "a", "label", "l"), (2, "u", "u", "artist", "b", "label", "l"), (3, "u", "u", "artist", "c", "artist", "d"),
        (4, "u", "u", "artist", "d", "artist", "d"), (5, "v", "u", "artist", "a", "artist", "z"), (6, "u", "u", "artist", "b", None, None)], OF_ITEM + ", to_type string, to_id string"))
    assert rows(told.rows, "target_type", "target_id", "source") == [("artist", "b", "b"), ("artist", "c", "c"), ("artist", "d", "d"), ("label", "l", "a")]
    assert why(told.refused) == {2: "already saved", 3: "already saved", 5: "another command names the row", 6: "another command names the row"}


def test_logging_plays(spark, plays, tracks):
    said = [(1, "u", "s", T[2], "r1", "t1"), (2, "u", "s", T[3], "r2", "t1"), (3, "u", "s", T[4], "r2", None), (4, "u", "s", T[5], None, None), (5, "u", "s", T[6], None, "t9"), (6, "u", "s", T[0], "r1", None), (7, "u", None, T[7], "r1", None)]
    told = U.log_plays(plays, tracks, spark.createDataFrame(said, "ord long, by_user string, source string, played_at timestamp, recording_id string, track_id string"))
    assert rows(told.added, "user_id", "played_at", "recording_id", "track_id") == [("u", T[2], None, "t1"), ("u", T[4], "r2", None)]
    assert why(told.refused) == {2: "the track has another recording", 4: "neither track nor recording", 5: "no such track", 6: "already logged", 7: "incomplete key"}
    assert told.rows.count() == 5


def test_plays_are_linked_moved_and_rebound(spark, plays, tracks):
    to = lambda c, *x: spark.createDataFrame(list(x), f"{OF_PLAY}, {c}")
    cols = "user_id", "played_at", "recording_id", "track_id"
    linked = U.link_plays(plays, tracks, to("track_id string", (1, "u", "u", "s", T[0], "t2"), (2, "u", "u", "s", T[1], "t1"), (3, "v", "v", "s", T[0], "t1"), (4, "u", "v", "s", T[0], "t3"), (5, "u", "u", "s", T[8], "t1")))
    assert rows(linked.rows, *cols) == [("u", T[0], None, "t2"), ("u", T[1], None, "t1"), ("v", T[0], "r2", None)]
    assert why(linked.refused) == {3: "the track has another recording", 4: "another command names the row", 5: "not there"}
    again = U.link_plays(linked.rows, tracks, to("track_id string", (1, "u", "u", "s", T[0], "t1"), (2, "u", "v", "s", T[0], "t3"), (3, "u", "u", "s", T[1], "t9")))
    assert why(again.refused) == {1: "already linked to a track", 2: "not owned by this user", 3: "no such track"}
    moved = U.move_plays(plays, to("recording_id string", (1, "u", "u", "s", T[0], "r9"), (2, "u", "u", "s", T[1], "r9"), (3, "v", "v", "s", T[0], None)))
    assert rows(moved.rows, *cols) == [("u", T[0], "r9", None), ("u", T[1], None, "t1"), ("v", T[0], "r2", None)]
    assert why(moved.refused) == {2: "already linked to a track", 3: "no recording"}
    bound = U.rebind_plays(plays, tracks, to("recording_id string, track_id string", (1, "u", "u", "s", T[1], "r5", None), (2, "v", "v", "s", T[0], "r1", "t2"), (3, "u", "u", "s", T[0], "r2", "t1")))
    assert rows(bound.rows, *cols) == [("u", T[0], "r1", None), ("u", T[1], "r5", None), ("v", T[0], None, "t2")]
    assert why(bound.refused) == {3: "the track has another recording"}


def test_empty_frames_change_nothing(spark, plays, tracks):
    none = spark.createDataFrame([], OF_PLAY + ", track_id string, recording_id string")
    for told in (U.link_plays(plays, tracks, none), U.remove_plays(plays, none), U.log_plays(plays, tracks, none.drop("user_id")), U.move_plays(plays, none.drop("track_id"))):
        assert (told.rows.count(), told.refused.count()) == (3, 0)
    told = U.remove_plays(plays.limit(0), spark.createDataFrame([(1, "u", "u", "s", T[0])], OF_PLAY))
    assert (told.rows.count(), why(told.refused)) == (0, {1: "not there"})


def test_commands_are_committed_as_what_changed(spark, tmp_path):
    store, schema = Store(spark, str(tmp_path / "store")), State.schema()
    state = State.empty(spark)
    entities = spark.createDataFrame([("r1", "recording"), ("r2", "recording"), ("l1", "release")], "entity_id string, entity_type string")
    edges = spark.createDataFrame([("t1", "release_track", "l1", "r1")], "edge_id string, kind string, src_id string, dst_id string")
    state = state.add("entities", typed(entities, schema["entities"])).add("edges", typed(edges, schema["edges"]))
    state, refused = user_state.command(state, "log_play", spark.createDataFrame([(1, "u", "s", T[0], "r1", None), (2, "u", "s", T[1], "r2", None)], "ord long, by_user string, source string, played_at timestamp, recording_id string, track_id string"))
    state, unsaved = user_state.command(state, "save", spark.createDataFrame([(1, "u", "r1"), (2, "u", "x")], "ord long, by_user string, entity_id string"))
    assert refused.isEmpty() and why(unsaved) == {2: "no such entity"}
    state.save(store)
    state, refused = user_state.command(State.load(store), "link_play", spark.createDataFrame([(1, "u", "u", "s", T[0], "t1"), (2, "u", "u", "s", T[1], "t1")], OF_PLAY + ", track_id string"))
    assert why(refused) == {2: "the track has another recording"}
    state.save(store)
    kinds = [p["kind"] for p in store.last().tables["play_events"]]
    assert kinds[-1] == "put"  # one row in place of another, not the table
    state = State.load(store)
    assert rows(state.play_events, "played_at", "recording_id", "track_id") == [(T[0], None, "t1"), (T[1], "r2", None)]
    state, _ = user_state.command(state, "remove_item", spark.createDataFrame([(1, "u", "u", "recording", "r1")], OF_ITEM))
    state.save(store)
    assert State.load(store).library_items.isEmpty()
    wrong, _ = user_state.command(State.load(store), "move_play", spark.createDataFrame([(1, "u", "u", "s", T[1], "nowhere")], OF_PLAY + ", recording_id string"))
    with pytest.raises(Exception, match="recording"):
        wrong.save(store)
