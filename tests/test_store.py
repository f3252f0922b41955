"""Commits that write what changes."""

import datetime as dt
import os

import pytest

from mergewell.operators import persist as X
from mergewell.plans import engine
from mergewell.plans.engine import State

KV = "k long, v string"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), KV)


def held(store):
    return {r.k: r.v for r in store.read("t", KV).collect()}


def test_added_and_put_rows(spark, tmp_path):
    store = X.Store(spark, str(tmp_path / "s"))
    store.commit({"t": frame(spark, (1, "a"), (2, "b"))})
    store.commit({"t": X.Change(added=frame(spark, (3, "c")))})
    store.commit({"t": X.Change(added=frame(spark, (4, "d")), put=frame(spark, (1, "A"), (3, None)), by=("k",))})
    store.commit({"t": X.Change(put=frame(spark, (1, "Z")), by=("k",))})
    store.commit({"t": X.Change(added=frame(spark)), "u": X.Change()})
    assert held(store) == {1: "Z", 2: "b", 3: None, 4: "d"}
    assert [p["kind"] for p in store.last().tables["t"]] == ["whole", "added", "added", "put", "put"]
    assert store.read("u", KV).isEmpty() and store.last().number == 5


@pytest.mark.parametrize("base", [1, 5000])
def test_many_parts_become_few(spark, tmp_path, monkeypatch, base):
    monkeypatch.setattr(X.Store, "PARTS", 3)
    store = X.Store(spark, str(tmp_path / "s"))
    store.commit({"t": spark.range(base).selectExpr("id as k", "sha2(string(id), 256) as v").coalesce(1)})
    want, first = held(store), store.last().tables["t"][0]["folder"]
    for i in range(5):
        new, old = (base + i, f"n{i}"), (0, f"p{i}")
        want |= dict([new, old])
        store.commit({"t": X.Change(frame(spark, new).coalesce(1), frame(spark, old).coalesce(1), ("k",))})
        assert held(store) == want and len(store.last().tables["t"]) <= 4
    wrote_anew = store.last().tables["t"][0]["folder"] != first
    assert wrote_anew == (base == 1) and store.last().tables["t"][0]["kind"] == "whole"


def test_a_snapshot_stays_readable(spark, tmp_path):
    store = X.Store(spark, str(tmp_path / "s"))
    store.commit({"t": frame(spark, (1, "a"))})
    then = store.last()
    store.commit({"t": X.Change(put=frame(spark, (1, "b")), by=("k",))})
    assert store.read("t", KV, then).collect()[0].v == "a" and held(store) == {1: "b"}


def test_constraints_see_what_was_written(spark, tmp_path):
    store = X.Store(spark, str(tmp_path / "s"))
    store.commit({"t": frame(spark, (1, "a"))})
    clash = lambda w: {"keys are new": w.new("t", KV).join(w.old("t", KV), "k", "left_semi")}
    before = set(os.listdir(tmp_path / "s"))
    with pytest.raises(ValueError, match="keys are new"):
        store.commit({"t": X.Change(added=frame(spark, (1, "b")))}, clash)
    assert held(store) == {1: "a"} and set(os.listdir(tmp_path / "s")) == before
    store.commit({"t": X.Change(added=frame(spark, (2, "b")))}, clash)
    assert held(store) == {1: "a", 2: "b"}


def user(spark, state, name):
    return spark.createDataFrame([(name, name, None, None, None)], state.users.schema)


def test_a_state_writes_what_grew(spark, tmp_path):
    store = X.Store(spark, str(tmp_path / "s"))
    state = State.load(store)
    state.add("users", user(spark, state, "a")).save(store)
    state = State.load(store)
    two = state.add("users", user(spark, state, "b"))
    two = two.add("users", user(spark, state, "c"))
    two.save(store)
    kinds = lambda: [p["kind"] for p in store.last().tables["users"]]
    assert kinds() == ["whole", "added"] and store.last().tables["sidecar"] == []
    two = two.add("users", user(spark, two, "d"))  # a saved state goes on
    two.save(store)
    assert kinds() == ["whole", "added", "added"]
    assert sorted(r.id for r in State.load(store).users.collect()) == list("abcd")
    with pytest.raises(ValueError, match="another commit came first"):
        state.add("users", user(spark, state, "e")).save(store)
    again = State.load(store)
    with pytest.raises(ValueError, match="a user is stored once"):
        again.add("users", user(spark, again, "a")).save(store)
    again.users = again.users.where("id <> 'b'")  # set in another way: written anew
    again.save(store)
    assert kinds() == ["whole"] and State.load(store).users.count() == 3


def test_plays_of_lost_recordings_are_found_when_entities_shrink(spark, tmp_path):
    store = X.Store(spark, str(tmp_path / "s"))
    state = State.load(store)
    one = spark.createDataFrame([("r", "recording", "Song", None, ["x"])], "entity_id string, entity_type string, name string, duration_ms long, sources array<string>")
    play = spark.createDataFrame([("u", "s", dt.datetime(2024, 1, 1), "r", None)], state.play_events.schema)
    state.add("entities", engine.conform(one, State.schema()["entities"])).add("play_events", play).save(store)
    state = State.load(store)
    state.entities = state.entities.where("entity_id <> 'r'")
    with pytest.raises(ValueError, match="every play event has its recording"):
        state.save(store)
    assert State.load(store).entities.count() == 1
