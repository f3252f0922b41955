import json


from mergewell import schemas
from mergewell.operators import commands as X
from mergewell.plans.engine import State
from mergewell.plans.workflows import ingest_library, update_releases
from mergewell.sources import payloads
from mergewell.sources.translate import release_graph

ITEMS = "user_id string, target_type string, target_id string, source string, ord struct<branch:int,ord:int>"


def landed(spark, tmp_path, name, schema, *rows):
    (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    return payloads.read(spark, str(tmp_path / f"{name}.jsonl"), schema)


def test_library(spark, tmp_path):
    art = lambda i, n: {"id": i, "name": n}
    album = {"id": "al", "name": "HUMANiSE", "artists": [art("h", "HAAi")], "external_ids": {"upc": "1"}}
    tracks = landed(spark, tmp_path, "t", payloads.SAVED_TRACKS, {"offset": 0, "items": [
        {"track": {"id": "t1", "name": "New Euphoria", "duration_ms": 319361, "artists": [art("h", "HAAi"), art("x", "Alexis Taylor")], "external_ids": {"isrc": "GB1"}, "album": album}},
        {"track": {"id": "t1", "name": "New Euphoria", "duration_ms": 319361, "artists": [art("h", "HAAi")], "external_ids": {"isrc": "GB1"}, "album": album}},
    ]})
    albums = landed(spark, tmp_path, "a", payloads.SAVED_ALBUMS, {"offset": 0, "items": [{"album": album}]})
    artists = landed(spark, tmp_path, "f", payloads.FOLLOWED_ARTISTS, {"artists": {"items": [art("h", "HAAi")]}})
    rows = payloads.library(tracks, albums, artists)
    out, items, counts = ingest_library(rows, "u", State.empty(spark), spark.createDataFrame([], ITEMS))
    kinds = {r.entity_type: r["count"] for r in out.state.entities.groupBy("entity_type").count().collect()}
    assert kinds == {"recording": 1, "release_set": 1, "release": 1, "artist": 2}
    assert counts.first().asDict() == {"fetched": 4, "stored": 3, "skipped": 1}
    roles = {(r.kind, r.role): r["count"] for r in out.state.edges.groupBy("kind", "role").count().collect()}
    assert roles["recording_contribution", "primary"] == 1 and roles["recording_contribution", "unknown"] == 1
    again = ingest_library(rows, "u", out.state, items)
    assert again[2].first().stored == 0 and again[0].state.entities.count() == out.state.entities.count()


def release(mbid, title, group):
    artist = {"id": "a", "name": "A"}
    return {"id": mbid, "title": title, "artist-credit": [{"name": "A", "artist": artist}], "release-group": {"id": group, "title": title}, "label-info": [{"label": {"id": "l", "name": "L"}}], "media": [{"position": 1, "tracks": [{"position": 1, "title": "s", "recording": {"id": f"rec-{mbid}", "title": "s"}}]}]}


def test_release_updates(spark, tmp_path):
    graph = release_graph(landed(spark, tmp_path, "r", payloads.METADATA_RELEASE, release("m1", "One", "g1"), release("m2", "Two", "g2"), release("m9", "Nine", "g9")))
    entities = spark.createDataFrame([("r1", "release", "one", None, ["lastfm"]), ("r2", "release", "two", None, ["lastfm"]), ("r3", "release", "three", None, ["lastfm"]), ("r4", "release", "four", None, ["musicbrainz"]), ("r9", "release", "nine", None, ["spotify", "musicbrainz"])], schemas.ENTITY)
    empty = State.empty(spark)
    ids = spark.createDataFrame([("musicbrainz:release", "old1", "release", "r1", "lastfm"), ("musicbrainz:release", "m9", "release", "r9", "lastfm")], schemas.EXTERNAL_ID)
    state = State(entities, ids, empty.redirects, empty.sidecar, empty.edges, empty.play_events)
    picks = spark.createDataFrame([("r1", "old1", "m1"), ("r2", "m2", "m2"), ("r3", "m9", "m9"), ("r4", "m2", "m2")], "release_id string, requested string, resolved string")
    up = update_releases(state, picks, graph)
    assert {r.release_id for r in up.accepted.collect()} == {"r1", "r2"}
    assert [(r.release_id, r.reason) for r in up.review.collect()] == [("r3", "musicbrainz_candidate_collision")]
    s = up.outcome.state
    names = {r.entity_id: (r.name, r.sources) for r in s.entities.where("entity_type = 'release'").collect()}
    assert names["r1"] == ("One", ["lastfm", "musicbrainz"]) and names["r3"] == ("three", ["lastfm"]) and len(names) == 5
    assert [tuple(r) for r in s.redirects.collect()] == [("musicbrainz:release", "old1", "m1")]
    assert s.edges.where("kind = 'release_track' and src_id = 'r1'").count() == 1
    assert s.entities.where("entity_type = 'label'").count() == 1 and s.entities.where("entity_type = 'artist'").count() == 1
    done = update_releases(s, picks, graph)
    assert done.accepted.count() == 0 and done.outcome.state.entities.count() == s.entities.count()


def test_commands(spark):
    edge = "edge_id string, kind string, src_id string, dst_id string"
    edges = spark.createDataFrame([("1", "track", "a", "x"), ("2", "track", "a", "y"), ("3", "track", "b", "x")], edge)
    left = lambda df: sorted((r.src_id, r.dst_id) for r in df.collect())
    assert left(X.move_edges(edges, spark.createDataFrame([("a", "b")], "from_id string, to_id string"))) == [("b", "x"), ("b", "y")]
    kept, missing = X.remove_edges(edges, spark.createDataFrame([("1", "track", "a", "x"), ("9", "track", "z", "z")], edge))
    assert left(kept) == [("a", "y"), ("b", "x")] and left(missing) == [("z", "z")]
    assert left(X.add_edges(edges, spark.createDataFrame([("8", "track", "a", "x"), ("9", "track", "c", "x")], edge))) == [("a", "x"), ("a", "y"), ("b", "x"), ("c", "x")]
    assert left(X.replace_edges(edges, spark.createDataFrame([("a",)], "src_id string"), spark.createDataFrame([("7", "track", "a", "z")], edge), "track")) == [("a", "z"), ("b", "x")]
    nodes = spark.createDataFrame([("a", "r"), ("x", "t"), ("y", "t")], "entity_id string, entity_type string")
    assert left(X.orphans(edges, nodes)) == [("b", "x")]
    ids = "owner_type string, owner_id string, namespace string, value string"
    old, new = spark.createDataFrame([("r", "1", "n", "v")], ids), spark.createDataFrame([("r", "1", "n", "w")], ids)
    assert X.put_external_ids(old, new)[1].count() == 1 and X.put_external_ids(old, new, replace=True)[0].first().value == "w"
    assert X.remove_external_ids(old, new).count() == 0
    pointed, bad = X.point_to_canonical(nodes, spark.createDataFrame([("x", "y"), ("y", "y"), ("a", "x")], "entity_id string, canonical_id string"))
    assert {r.entity_id: r.canonical_id for r in pointed.where("entity_type = 't'").collect()} == {"x": "y", "y": None} and bad.count() == 1
    items = spark.createDataFrame([("u", "t", "x"), ("u", "t", "y")], "user_id string, target_type string, target_id string")
    assert X.retarget_items(items, spark.createDataFrame([("x", "y")], "from_id string, to_id string")).count() == 1
    plays = spark.createDataFrame([("x",), ("q",)], "recording_id string")
    assert sorted(r[0] for r in X.rebind_plays(plays, spark.createDataFrame([("x", "y")], "from_id string, to_id string")).collect()) == ["q", "y"]
    assert X.foreign(items, spark.createDataFrame([("v",)], "user_id string")).count() == 2
