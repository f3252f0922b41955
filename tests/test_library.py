"""Landed pages as a cache, cascades, facets."""

import datetime as dt
import json

from pyspark.sql import functions as F

from mergewell.operators import browse as B
from mergewell.operators import commands as C
from mergewell.sources import landing

NOW = dt.datetime(2024, 5, 1, 12)


def page(n, playing=False, error=None):
    track = {"name": f"t{n}", "artist": {"#text": "A"}, "album": {"#text": "X"}, "date": {"uts": "1"}}
    if playing:
        track["@attr"] = {"nowplaying": "true"}
    return json.dumps({"error": error, "message": "no"} if error else {"recenttracks": {"track": [track], "@attr": {"page": str(n), "totalPages": "9"}}})


def test_landed_pages_are_not_fetched_again(spark, tmp_path):
    calls = tmp_path / "calls"

    def fetch(request):
        with open(calls, "a") as f:
            f.write(f"{request['user']} {request['page']}\n")
        return None if request["page"] == 7 else page(request["page"], playing=request["page"] == 3, error=6 if request["page"] == 4 else None)

    def went_out():
        lines = sorted(calls.read_text().split("\n")[:-1]) if calls.exists() else []
        calls.write_text("")
        return lines

    cache = landing.Landing(spark, str(tmp_path / "pages"), ttl=3600, keep=landing.whole_scrobble_pages)
    asked = lambda *pages: spark.createDataFrame([("u", p, i) for i, p in enumerate(pages)], "user string, page int, ord int")
    go = lambda df, at: {r.ord: r.payload for r in cache.through(df, ["page", "user"], fetch, F.lit(at), calls=100).collect()}
    got = go(asked(1, 2, 2, 3, 4, 7), NOW)
    assert went_out() == ["u 1", "u 2", "u 3", "u 4", "u 7"]  # equal requests once
    assert got == {0: page(1), 1: page(2), 2: page(2), 3: page(3, playing=True), 4: page(4, error=6), 5: None}
    assert go(asked(1, 2), NOW + dt.timedelta(minutes=30)) == {0: page(1), 1: page(2)} and went_out() == []
    assert go(asked(3, 4), NOW) == {0: page(3, playing=True), 1: page(4, error=6)} and went_out() == ["u 3", "u 4"]  # were not kept
    go(asked(1), NOW + dt.timedelta(hours=1))
    assert went_out() == ["u 1"]  # expired
    go(asked(1), NOW + dt.timedelta(hours=1, minutes=59))
    assert went_out() == []  # the later page counts
    assert go(asked(), NOW) == {} and went_out() == []


def test_request_keys_do_not_depend_on_the_order_of_options(spark):
    r = spark.range(1).select(F.lit("u").alias("user"), F.lit(None).cast("int").alias("page")).select(landing.request_key("user", "page").alias("a"), landing.request_key("page", "user").alias("b"), landing.request_key("user").alias("c")).first()
    assert r.a == r.b != r.c


def tables(spark):
    ent = [("s", "release_set"), ("r1", "release"), ("r2", "release"), ("rec", "recording"), ("art", "artist"), ("other", "release")]
    edges = [("e1", "release_set_release", "s", "r1"), ("e2", "release_set_release", "s", "r2"), ("e3", "release_track", "r1", "rec"), ("e4", "recording_contribution", "rec", "art"), ("e5", "release_track", "other", "rec")]
    return {
        "entities": spark.createDataFrame(ent, "entity_id string, entity_type string"),
        "edges": spark.createDataFrame(edges, "edge_id string, kind string, src_id string, dst_id string"),
        "external_ids": spark.createDataFrame([("n", "v", "r1"), ("n", "w", "other")], "namespace string, value string, owner_id string"),
        "sidecar": spark.createDataFrame([("release", "k", "r2"), ("recording", "k", "rec")], "entity_type string, key string, entity_id string"),
        "library_items": spark.createDataFrame([("u", "release_set", "s"), ("u", "artist", "art")], "user_id string, target_type string, target_id string"),
        "play_events": spark.createDataFrame([("u", "rec")], "user_id string, recording_id string"),
    }


def test_removal_takes_all_that_is_owned(spark):
    roots = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    first = lambda df, c: sorted(r[c] for r in df.collect())
    out, blocked = C.remove_entities(tables(spark), roots("s", "s"))
    assert blocked.count() == 0
    assert first(out["entities"], "entity_id") == ["art", "other", "rec"] and first(out["edges"], "edge_id") == ["e4", "e5"]
    assert first(out["external_ids"], "value") == ["w"] and first(out["sidecar"], "entity_id") == ["rec"] and first(out["library_items"], "target_id") == ["art"]
    kept, blocked = C.remove_entities(tables(spark), roots("rec", "s"))
    assert blocked.count() == 1 and kept["entities"].count() == 6
    assert C.remove_entities(tables(spark), roots())[0]["entities"].count() == 6


def test_cascade_ends_on_circles(spark):
    owns = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), (None, "z")], "owner_id string, id string")
    found = C.cascade(spark.createDataFrame([("a",), ("a",), (None,)], "id string"), owns)
    assert sorted(str(r.id) for r in found.collect()) == ["None", "a", "b", "c", "d"]


def test_facets_and_the_way_down(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "x", "p"), (3, "y", "p")], "n int, a string, b string")
    got = {(r.facet, r.value): (r.n, r.s) for r in B.facets(df, {"a": F.col("a"), "b": F.col("b")}, F.sum("n").alias("s")).collect()}
    assert got == {("total", None): (3, 6), ("a", "x"): (2, 3), ("a", "y"): (1, 3), ("b", None): (1, 1), ("b", "p"): (2, 5)}
    tracks = spark.createDataFrame([("r", 2, 1, "c"), ("r", 1, 2, "b"), ("r", 1, 1, "a"), ("q", None, None, "z")], "release_id string, disc_number int, track_number int, recording_id string")
    down = {r.release_id: (r.n_tracks, [(d.disc_number, [t.recording_id for t in d.tracks]) for d in r.discs]) for r in B.drill_down(tracks).collect()}
    assert down == {"r": (3, [(1, ["a", "b"]), (2, ["c"])]), "q": (1, [(None, ["z"])])}
