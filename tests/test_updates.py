"""Release updates layer by layer, one by one, and against what a loop would do."""

import json
import sys

from mergewell import schemas
from mergewell.operators.persist import Store
from mergewell.plans import updates
from mergewell.plans.engine import State
from mergewell.sources import payloads
from mergewell.sources.translate import release_graph


def payload(mbid, title, group, artist="A", tracks=(), label=None, track_credit=None):
    credit = [{"name": artist, "artist": {"id": f"id-{artist}", "name": artist}}]
    out = {"id": mbid, "title": title, "artist-credit": credit, "release-group": {"id": group, "title": title, "artist-credit": credit}, "media": [{"position": 1, "tracks": []}]}
    for n, (rec, name, length) in enumerate(tracks):
        out["media"][0]["tracks"].append({"position": n + 1, "title": name, "length": length, "recording": {"id": rec, "title": name}})
    if label:
        out["label-info"] = [{"label": {"id": label, "name": label}}]
    return out


PAYLOADS = [
    payload("m1", "One", "g1", tracks=[("rec1", "song", 1000)], label="L"),
    payload("m2", "Two", "g2", tracks=[("rec1", "song", 9000)], label="L"),  # the recording of m1, longer
    payload("m3", "Three", "g3", tracks=[("rec3", "third", 1000)], label="L"),
    payload("m4", "Four", "g4", artist="B", tracks=[("rec4", "fourth", 1000)]),
    payload("m5", "Five", "g5", artist="C", tracks=[("rec5", "fifth", 5000), ("rec6", "sixth", 6000)]),
    payload("m7", "Seven", "g7", artist="D"),
    payload("m8", "Eight special", "g8", artist="E"),
]


def stored(spark, store, only=None):
    release = lambda i, name, sources=("lastfm",): (i, "release", name, None, list(sources))
    entities = [release("r1", "one"), release("r2", "two"), release("r3", "three"), release("r4", "four"), release("r4b", "four b"), release("r5", "five"), release("r6", "no such thing"), release("r7", "seven"), release("r7b", "seven again"), release("r8", "eight spezial"), release("r9", "nine", ("lastfm", "musicbrainz"))]
    entities += [("s7", "release_set", "seven", None, ["lastfm"]), ("c5", "recording", "fifth", 5000, ["lastfm"]), ("c6", "recording", "sixth", 6000, ["lastfm"])]
    entities = [x for x in entities if not only or x[0] in only or x[1] != "release"]
    ids = [("musicbrainz:release", v, "release", r, "lastfm") for v, r in (("m1", "r1"), ("m2", "r2"), ("old3", "r3"), ("m4", "r4"), ("m4x", "r4b"), ("m9", "r9")) if not only or r in only]
    edges = [("e1", "release_set_release", "s7", "r7"), ("e2", "release_set_release", "s7", "r7b"), ("e3", "release_track", "r5", "c5"), ("e4", "release_track", "r5", "c6")]
    ids += [("musicbrainz:recording", "rec5", "recording", "c5", "lastfm")]
    edges = [x for x in edges if not only or x[3] in only or x[2] in only]
    e = State.empty(spark)
    full = spark.createDataFrame([(*x, None, None, None, None) for x in edges], schemas.EDGE)
    State(spark.createDataFrame(entities, schemas.ENTITY), spark.createDataFrame(ids, schemas.EXTERNAL_ID), e.redirects, e.sidecar, full, e.play_events, e.library_items, e.users).save(store)


def run(spark, path, only=None, **kw):
    store = Store(spark, str(path))
    stored(spark, store, only)
    (path / "r.jsonl").write_text("".join(json.dumps(p) + "\n" for p in PAYLOADS))
    graph = release_graph(payloads.read(spark, str(path / "r.jsonl"), payloads.METADATA_RELEASE))
    moved = spark.createDataFrame([("musicbrainz:release", "old3", "m3"), ("musicbrainz:release", "m4x", "m4")], schemas.REDIRECT)
    done = updates.update_in_order(store, graph, moved, **kw)
    s = State.load(store)
    name = {r.entity_id: (r.entity_type, r.name) for r in s.entities.collect()}
    state = {
        "entities": sorted((r.entity_type, r.name, r.duration_ms, tuple(r.sources), str(r.facts)) for r in s.entities.collect()),
        "edges": sorted(str((r.kind, name[r.src_id], name[r.dst_id], r.role, r.disc_number, r.track_number, r.duration_ms)) for r in s.edges.collect()),
        "ids": sorted((r.namespace, r.value, r.owner_type, name[r.owner_id]) for r in s.external_ids.collect()),
        "keys": sorted((r.entity_type, r.key, name[r.entity_id]) for r in s.sidecar.collect()),
        "redirects": sorted(tuple(r) for r in s.redirects.select("source_value", "target_value").collect()),
    }
    applied = sorted((r.release_id, r.requested, r.resolved, r.level) for r in done.applied.collect())
    return done, state, applied, sorted((r.release_id, r.reason) for r in done.review.collect())


def test_layers(spark, tmp_path):
    done, state, applied, review = run(spark, tmp_path)
    assert applied == [("r1", "m1", "m1", 0), ("r2", "m2", "m2", 0), ("r3", "old3", "m3", 0), ("r4", "m4", "m4", 0), ("r5", "m5", "m5", 2), ("r7", "m7", "m7", 3), ("r8", "m8", "m8", 3)]
    assert review == [("r4b", "musicbrainz_redirect_collision"), ("r7b", "musicbrainz_candidate_collision")]
    layer = {r.release_id: r.layer for r in done.applied.unionByName(done.review, allowMissingColumns=True).collect()}
    assert [layer[r] for r in ("r1", "r3", "r4", "r5", "r7", "r8")] == [0] * 6  # a label in common, of which they say the same
    assert [layer[r] for r in ("r2", "r4b", "r7b")] == [1] * 3 and done.layers == 2
    assert ("recording", "song", 9000, ("musicbrainz",)) in [e[:4] for e in state["entities"]]  # what r2 said last
    assert state["redirects"] == [("old3", "m3")]
    assert ("musicbrainz:release-group", "g7", "release_set", ("release_set", "Seven")) in state["ids"]


def test_first_layer(spark):
    torn = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("c", "y"), ("d", "z"), ("c", "z")], "release_id string, key string")
    every = spark.createDataFrame([(r,) for r in "abcde"], "release_id string")
    layer = lambda df, width=None: sorted(r[0] for r in updates.first_layer(df, torn.join(df, "release_id", "left_semi"), width).collect())
    assert layer(every) == ["a", "e"] and layer(every, 1) == ["a"]
    assert layer(every.where("release_id > 'a'")) == ["b", "e"] and layer(every.where("release_id > 'b'")) == ["c", "e"]


def test_layers_equal_one_by_one(spark, tmp_path):
    """Two releases that have nothing to do with each other, in one layer and in two."""
    few = {"r1", "r3"}
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    layered, one_by_one = run(spark, tmp_path / "a", few), run(spark, tmp_path / "b", few, width=1)
    assert (layered[0].layers, one_by_one[0].layers) == (1, 2)
    assert layered[1:] == one_by_one[1:]


def test_layer_under_review_is_not_committed(spark, tmp_path):
    """Of a layer all of which goes to review nothing is reconciled; before, it was committed like others."""
    done, state, applied, review = run(spark, tmp_path, {"r4", "r4b"})
    assert applied == [("r4", "m4", "m4", 0)] and review == [("r4b", "musicbrainz_redirect_collision")]
    assert done.layers == 2 and Store(spark, str(tmp_path)).last().number == 2  # what was there, and r4
    assert ("musicbrainz:release", "m4x", "release", ("release", "four b")) in state["ids"]


def test_plans_stay_small(spark, tmp_path, monkeypatch):
    """What the driver plans at once: no plan holds the ways to a candidate or the claims several times."""
    longest = {}

    def cut(df, real=updates.checkpointed):
        of = sys._getframe(1).f_code.co_name
        longest[of] = max(longest.get(of, 0), len(df._jdf.queryExecution().optimizedPlan().toString()))
        return real(df)

    monkeypatch.setattr(updates, "checkpointed", cut)
    run(spark, tmp_path, {"r1", "r3"})
    assert {of: n for of, n in longest.items() if of in ("choose", "conflicts", "update_in_order") and n > 24_000} == {}
