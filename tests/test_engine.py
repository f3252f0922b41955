import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mergewell import cli
from mergewell.operators.persist import Store
from mergewell.plans.engine import State, ingest_play_events
from mergewell.sources import paged, payloads
from mergewell.sources.translate import release_graph, scrobble_claims
from mergewell.streaming.ingest import distinct_events, run

SCROBBLE = "ord int, user_id string, played_at timestamp, now_playing boolean, artist string, artist_mbid string, artist_url string, album string, release_mbid string, title string, recording_mbid string, recording_url string"


def scrobble(i, artist, album, title, release=None, recording=None):
    return (i, "u", dt.datetime(2024, 1, 1, 0, 0, i), False, artist, None, None, album, release, title, recording, None)


def ingest(spark, rows, state, **kw):
    return ingest_play_events(*scrobble_claims(spark.createDataFrame(rows, SCROBBLE)), state, **kw)


def kinds(state):
    return {r.entity_type: r["count"] for r in state.entities.groupBy("entity_type").count().collect()}


def test_same_title_of_two_artists(spark):
    out = ingest(spark, [scrobble(1, "A", "X", "Song"), scrobble(2, "B", "Y", "Song")], State.empty(spark))
    assert kinds(out.state)["recording"] == 2 and kinds(out.state)["artist"] == 2 and out.state.play_events.count() == 2


def test_compilation_is_not_split(spark):
    out = ingest(spark, [scrobble(1, "A", "Hits", "One", "rel"), scrobble(2, "B", "Hits", "Two", "rel")], State.empty(spark))
    assert kinds(out.state) == {"artist": 2, "release_set": 1, "release": 1, "recording": 2}
    assert out.state.edges.where("kind = 'release_track'").count() == 2


def test_replay_stores_nothing_and_rematches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    first = ingest(spark, [scrobble(1, "A", "X", "Song"), scrobble(2, "A", "X", "Song"), scrobble(3, "A", "X", "Other")], State.load(store))
    first.state.save(store)
    state = State.load(store)
    assert kinds(state) == {"artist": 1, "release_set": 1, "release": 1, "recording": 2} and state.play_events.count() == 3
    again = ingest(spark, [scrobble(1, "A", "X", "Song"), scrobble(9, "a!", "x", "SONG")], state)
    assert kinds(again.state) == kinds(state) and again.state.sidecar.count() == state.sidecar.count()
    assert again.state.play_events.count() == 4
    assert again.state.play_events.where("recording_id is null and track_id is null").count() == 0


def test_bounds(spark):
    rows = [scrobble(1, "A", "X", "Song"), scrobble(5, "A", "X", "Song"), scrobble(5, "A", "X", "Song"), scrobble(9, "A", "X", "Song")]
    at = lambda s: F.lit(dt.datetime(2024, 1, 1, 0, 0, s))
    assert ingest(spark, rows, State.empty(spark), after=at(1), until=at(5)).state.play_events.count() == 1


def test_failed_commit_leaves_the_version(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    v = store.commit({"t": spark.range(3)})
    with pytest.raises(ValueError, match="never"):
        store.commit({"t": spark.range(5)}, {"never": spark.range(1)})
    assert store.version() == v and store.read("t", "id long, later string").count() == 3


def page(*tracks, n=1):
    return json.dumps({"recenttracks": {"track": list(tracks), "@attr": {"user": "u", "page": str(n), "totalPages": "1"}}})


PLAYED = {"artist": {"#text": "Sample Artist", "mbid": "artist-mbid", "url": ""}, "album": {"#text": "", "mbid": ""}, "name": "Sample Track", "mbid": " ", "url": "u", "date": {"uts": "1704628800"}, "extra": 1}


def test_scrobble_pages(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text(page({**PLAYED, "date": None, "@attr": {"nowplaying": "true"}}, PLAYED) + "\n")
    rows = payloads.scrobbles(payloads.read(spark, str(tmp_path / "p.jsonl"), payloads.SCROBBLE_PAGE)).collect()
    assert [r.now_playing for r in rows] == [True, False]
    assert (rows[1].album, rows[1].artist, rows[1].recording_mbid, rows[1].artist_url) == ("Sample Track", "Sample Artist", None, None)
    assert rows[1].played_at == dt.datetime(2024, 1, 7, 12)
    (tmp_path / "e.jsonl").write_text(json.dumps({"error": 29, "message": "rate"}) + "\n")
    with pytest.raises(Exception, match="rate"):
        payloads.scrobbles(payloads.read(spark, str(tmp_path / "e.jsonl"), payloads.SCROBBLE_PAGE)).collect()


def test_cli_reconciles_landed_pages(spark, tmp_path, capsys):
    (tmp_path / "p.jsonl").write_text(page(PLAYED) + "\n")
    args = ["--store", str(tmp_path / "store"), "reconcile", "lastfm", "--pages", str(tmp_path / "p.jsonl"), "--user-id", "u"]
    assert cli.reconcile_scrobbles(spark, cli.parser().parse_args(args))[0]["applied"] > 0
    assert State.load(Store(spark, str(tmp_path / "store"))).play_events.count() == 1
    assert cli.main([*args, "--start", "2025-01-02T00:00Z", "--end", "2025-01-01T00:00Z"]) == 2


def test_metadata_release(spark, tmp_path):
    credit = lambda n, a, j: {"name": n, "joinphrase": j, "artist": {"id": a, "name": a}}
    release = {
        "id": "r", "title": "T", "status": "Official", "packaging": "Slipcase", "barcode": "1234567890123", "date": "2001-02", "artist-credit": [credit("A", "A", " feat. "), credit("Bee", "B", "")],
        "release-group": {"id": "g", "title": "T", "primary-type": "Album", "secondary-types": ["Live", "Nope"], "artist-credit": []}, "label-info": [{"label": {"id": "l", "name": "L"}}, {"label": None}],
        "media": [{"position": 1, "format": "CD", "track-count": 2, "tracks": [{"position": 1, "title": "t1", "length": 1000, "recording": {"id": "x", "title": "t1"}}, {"position": 2, "title": "alt", "recording": {"id": "y", "title": "t2"}, "artist-credit": [credit("C", "C", "")]}]}, {"format": "CD", "tracks": []}],
    }
    (tmp_path / "r.jsonl").write_text(json.dumps(release) + "\n")
    g = {k: v.collect() for k, v in release_graph(payloads.read(spark, str(tmp_path / "r.jsonl"), payloads.METADATA_RELEASE)).items()}
    r = g["release"][0]
    assert (r.status, r.packaging, r.formats, r.track_count, r.barcode_namespace) == ("official", "other", ["CD"], 2, "release:ean")
    assert (g["release_set"][0].primary_type, g["release_set"][0].secondary_types) == ("album", ["live"])
    assert [x.name for x in g["label"]] == ["L"]
    assert [(t.recording_mbid, t.title_override) for t in g["track"]] == [("x", None), ("y", "alt")]
    roles = {(c.owner_type, c.owner, c.artist_name): (c.role, c.credited_as) for c in g["credit"]}
    assert roles["release_set", "r", "B"] == ("featured", "Bee") and roles["release_set", "r", "A"] == ("primary", None)
    assert ("recording", "x", "A") in roles and ("recording", "y", "A") not in roles


def test_library_order_and_limits(spark):
    tracks = spark.read.schema(payloads.SAVED_TRACKS).json(spark.sparkContext.parallelize([json.dumps({"offset": 0, "items": [{"track": {"id": f"t{i}", "name": "n", "artists": [{"id": "a", "name": "A"}], "external_ids": {"isrc": "I"}, "album": {"id": "al", "name": "x"}}} for i in range(3)]})]))
    albums = spark.createDataFrame([], payloads.SAVED_ALBUMS)
    artists = spark.read.schema(payloads.FOLLOWED_ARTISTS).json(spark.sparkContext.parallelize([json.dumps({"artists": {"items": [{"id": "f", "name": "F"}]}})]))
    got = payloads.library(tracks, albums, artists, (2, None, None)).orderBy("branch", "ord").collect()
    assert [(r.branch, r.id) for r in got] == [(0, "t0"), (0, "t1"), (2, "f")]


def three_pages(options, number):
    return page({**PLAYED, "name": f"t{number}"}, n=number), 3


def test_paged_source(spark):
    paged.register(spark)
    rows = spark.read.format("paged").option("fetch", "tests.test_engine:three_pages").load()
    assert sorted(r.page for r in rows.collect()) == [1, 2, 3]


def test_retries_and_rate_limit():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise paged.ProviderError(503)
        return "ok"

    assert paged.retrying(flaky, waits.append) == "ok" and waits == [0.5, 1.0]
    with pytest.raises(paged.NotFound):
        paged.retrying(lambda: paged.checked(404), waits.append)
    now = [0.0]
    limit = paged.RateLimit(2, 1.0, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(5):
        limit.wait()
    assert now[0] >= 2.0 - 1e-9


def test_stream(spark, tmp_path):
    src, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    spark.createDataFrame([scrobble(1, "A", "X", "Song"), scrobble(2, "A", "X", "Song")], SCROBBLE).coalesce(1).write.parquet(str(src))
    stream = lambda: spark.readStream.schema(SCROBBLE).parquet(str(src))
    run(stream(), store, str(tmp_path / "c1")).awaitTermination()
    run(stream(), store, str(tmp_path / "c2")).awaitTermination()  # the same data again
    assert State.load(store).play_events.count() == 2
    deduped = distinct_events(stream().selectExpr("user_id", "'s' as source", "played_at"))
    q = deduped.writeStream.format("memory").queryName("seen").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c3")).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 2


def test_stream_with_late_and_replayed_batches(spark, tmp_path):
    src, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    land = lambda rows: spark.createDataFrame(rows, SCROBBLE).coalesce(1).write.mode("append").parquet(str(src))
    of = lambda i, user="u": (i, user, *scrobble(i, "A", "X", f"Song {i % 2}")[2:])
    go = lambda check: run(spark.readStream.schema(SCROBBLE).parquet(str(src)), store, str(tmp_path / check)).awaitTermination()
    stored = lambda: sorted((r.user_id, r.played_at.second) for r in State.load(store).play_events.collect())
    behind = lambda: sorted((r.user_id, r.played_at.second) for r in State.load(store).late_events.collect())
    land([of(10), of(12), of(12), of(30, "v")])
    go("c")
    assert stored() == [("u", 10), ("u", 12), ("v", 30)] and behind() == []
    land([of(11), of(11), of(12), of(13), of(20, "v"), of(31, "v"), of(5, "w")])  # 11 and v's 20 come late, 12 is a repeat
    go("c")
    assert stored() == [("u", 10), ("u", 12), ("u", 13), ("v", 30), ("v", 31), ("w", 5)] and behind() == [("u", 11), ("v", 20)]
    marks = {r.user_id: r.latest.second for r in State.load(store).watermarks.collect()}
    assert marks == {"u": 13, "v": 31, "w": 5}
    go("other")  # everything again, as after a lost checkpoint
    assert stored() == [("u", 10), ("u", 12), ("u", 13), ("v", 30), ("v", 31), ("w", 5)] and behind() == [("u", 11), ("v", 20)]
