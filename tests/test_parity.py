"""Merged facts and payloads, links, checks of endpoints, atomic commits."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mergewell import schemas
from mergewell.operators import merge as M
from mergewell.operators import persist as X
from mergewell.operators import policy as P
from mergewell.operators import resolve as R
from mergewell.plans.engine import State, conform, reconcile

CLAIM = f"claim_id string, claim_ord int, entity_type string, is_root boolean, name string, artist string, duration_ms long, sources array<string>, ids array<struct<namespace:string,value:string>>, child_ids array<struct<namespace:string,value:string>>, confidence double, facts {schemas.FACTS}"
REL = f"rel_id string, rel_ord int, kind string, src_claim_id string, dst_claim_id string, {', '.join(f'{k} {v}' for k, v in schemas.PAYLOAD_TYPES.items())}"


def batch(spark, tag, facts, payload):
    none = dict.fromkeys(schemas.FACT_TYPES)
    ids = lambda ns, v: [(ns, v)]
    claims = [
        (f"rel{tag}", 0, "release", True, "Album", "Band", None, [tag], ids("musicbrainz:release", "r1"), [], None, tuple({**none, **facts}.values())),
        (f"rec{tag}", 1, "recording", False, "Song", "Band", 1000, [tag], ids("musicbrainz:recording", "s1"), [], None, None),
        (f"lab{tag}", 2, "label", False, "Label", None, None, [tag], ids("musicbrainz:label", "l1"), [], None, None),
    ]
    rels = [(f"t{tag}", 0, "release_track", f"rel{tag}", f"rec{tag}", *{**dict.fromkeys(schemas.PAYLOAD), **payload}.values()), (f"p{tag}", 1, "release_label", f"rel{tag}", f"lab{tag}", *[None] * 8)]
    return spark.createDataFrame(claims, CLAIM), spark.createDataFrame(rels, REL)


def test_facts_and_payloads_merge(spark, tmp_path):
    store = X.Store(spark, str(tmp_path / "s"))
    first = reconcile(*batch(spark, "a", {"country": "DE", "status": "official", "release_date": (2001, 2, None)}, {"disc_number": 1, "track_number": 3, "title_override": "Alt"}), State.load(store))
    first.state.save(store)
    second = reconcile(*batch(spark, "b", {"country": " ", "packaging": "box", "status": None}, {"disc_number": 1, "track_number": 4}), State.load(store))
    second.state.save(store)
    state = State.load(store)
    release = state.entities.where("entity_type = 'release'").first()
    assert (release.sources, release.facts.country, release.facts.status, release.facts.packaging, release.facts.release_date.year) == (["a", "b"], "DE", "official", "box", 2001)
    edges = {e.kind: e for e in state.edges.collect()}
    track = edges["release_track"]  # what comes in wins, nulls too
    assert len(edges) == 2 and (track.edge_id, track.track_number, track.title_override) == ("ta", 4, None)
    counts = {r.subject: (r.created, r.merged, r.skipped) for r in second.counters.collect()}
    assert counts == {"entity": (0, 3, 0), "association": (0, 1, 0), "link": (0, 0, 1)}
    assert {(r.subject, r.strategy, r.reason, r.n) for r in second.skip_reasons.collect()} == {("link", "noop", "link_found", 1)}
    total = {r.subject: r.applied for r in M.sum_counters(first.counters.unionByName(second.counters)).collect()}
    assert total == {"entity": 6, "association": 2, "link": 2}


def test_relationships_that_cannot_be(spark):
    claims, rels = batch(spark, "a", {}, {})
    swapped = rels.withColumns({"src_claim_id": F.col("dst_claim_id"), "dst_claim_id": F.col("src_claim_id")})
    with pytest.raises(ValueError, match="endpoint_type_mismatch"):
        reconcile(claims, swapped, State.empty(spark))
    got = {r.rel_id: r.reason for r in R.bad_endpoints(rels, claims.where("entity_type <> 'label'"), schemas.ENDS).collect()}
    assert got == {"pa": "endpoint_missing"}


def test_a_commit_that_dies_leaves_the_version(spark, tmp_path, monkeypatch):
    store = X.Store(spark, str(tmp_path / "s"))
    one = store.commit({"t": spark.range(3)})
    monkeypatch.setattr(X.Store, "_point", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError, match="killed"):
        store.commit({"t": spark.range(5)})
    monkeypatch.undo()
    again = X.Store(spark, str(tmp_path / "s"))
    assert again.version() == one and again.read("t", "id long").count() == 3
    (tmp_path / "s" / "commits" / "next-v0").write_text("half")  # died before the rename
    assert again.version() == one


def test_of_two_commits_from_one_version_the_second_fails(spark, tmp_path):
    a, b = X.Store(spark, str(tmp_path / "s")), X.Store(spark, str(tmp_path / "s"))
    for s in (a, b):
        s.read("t", "id long")
    a.commit({"t": spark.range(1)})
    with pytest.raises(ValueError, match="another commit came first"):
        b.commit({"t": spark.range(2)})
    assert b.read("t", "id long").count() == 1


def test_constraints(spark, tmp_path):
    state = State.empty(spark)
    state.edges = conform(spark.createDataFrame([("e", "release_track", "x", "y", None, None, None, None)], schemas.EDGE), schemas.FULL_EDGE)
    with pytest.raises(ValueError, match="every edge has its ends"):
        state.save(X.Store(spark, str(tmp_path / "s")))
    state = State.empty(spark)
    state.play_events = spark.createDataFrame([("u", "s", dt.datetime(2024, 1, 1), "gone", None)], schemas.PLAY_EVENT)
    with pytest.raises(ValueError, match="play event"):
        state.save(X.Store(spark, str(tmp_path / "s")))


def test_first_of_equal_namespaces_wins(spark):
    ids = "owner_type string, owner_id string, namespace string, value string, pos int"
    stored = spark.createDataFrame([], "owner_type string, owner_id string, namespace string, value string")
    new = spark.createDataFrame([("r", "1", "n", "a", 1), ("r", "1", "n", "z", 0)], ids)
    assert [r.value for r in M.absorb_external_ids(stored, new)[0].collect()] == ["z"]


def test_skip_reasons(spark):
    rows = [("entity", "noop", "x"), ("entity", "noop", "x"), ("link", "create", "y"), ("entity", "manual_review", "z")]
    got = {tuple(r) for r in P.skip_reasons(spark.createDataFrame(rows, "subject string, strategy string, reason string")).collect()}
    assert got == {("entity", "noop", "x", 2), ("entity", "manual_review", "z", 1)}


def test_cli_library_and_releases(spark, tmp_path, capsys):
    import json

    from mergewell import cli
    from mergewell.operators import users as U

    artists = {"artists": {"items": [{"id": "a1", "name": "A"}, {"id": "a1", "name": "A"}, {"id": "a2", "name": "B"}]}}
    (tmp_path / "a.jsonl").write_text(json.dumps(artists) + "\n")
    at = ["--store", str(tmp_path / "store")]
    args = [*at, "reconcile", "spotify", "--user-id", "u", "--artists", str(tmp_path / "a.jsonl")]
    assert cli.reconcile_library(spark, cli.parser().parse_args(args)) == [{"fetched": 3, "stored": 2, "skipped": 1}]
    store = X.Store(spark, str(tmp_path / "store"))
    state = State.load(store)
    assert state.library_items.count() == 2
    album = State.load(store)
    album.entities = album.entities.unionByName(conform(spark.createDataFrame([("r1", "release", "Album", None, ["spotify"])], schemas.ENTITY), schemas.FULL_ENTITY))
    album.library_items = None  # carried over
    album.users = spark.createDataFrame([("7", "Ann", None, None, None)], schemas.TABLES["user_account"])
    album.save(store)
    (tmp_path / "r.jsonl").write_text(json.dumps({"id": "m1", "title": "Album", "country": "DE", "artist-credit": [], "media": [], "label-info": [], "release-group": {"id": "g1", "title": "Album"}}) + "\n")
    (tmp_path / "p.jsonl").write_text(json.dumps({"release_id": "r1", "requested": "m1", "resolved": "m1"}) + "\n")
    args = [*at, "reconcile", "musicbrainz-releases", "--releases", str(tmp_path / "r.jsonl"), "--picks", str(tmp_path / "p.jsonl")]
    cli.reconcile_releases(spark, cli.parser().parse_args(args))
    state = State.load(store)
    release = state.entities.where("entity_id = 'r1'").first()
    assert (release.facts.country, release.sources, state.library_items.count()) == ("DE", ["musicbrainz", "spotify"], 2)
    assert U.load_user(state.users, "7")["display_name"] == "Ann"
    with pytest.raises(LookupError):
        U.load_user(state.users, "8")


def test_cacheable_pages(spark, tmp_path):
    import json

    from mergewell.sources import payloads

    track = {"name": "t", "artist": {"#text": "A"}, "album": {"#text": ""}, "date": {"uts": "1"}}
    page = lambda *t: json.dumps({"recenttracks": {"track": list(t), "@attr": {"user": "u", "page": "1", "totalPages": "1"}}})
    (tmp_path / "p.jsonl").write_text("\n".join([page(track), page({**track, "@attr": {"nowplaying": "true"}}, track), page(), json.dumps({"error": 8, "message": "x"})]) + "\n")
    assert payloads.cacheable(payloads.read(spark, str(tmp_path / "p.jsonl"), payloads.SCROBBLE_PAGE)).count() == 2
