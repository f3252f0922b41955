import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mergewell.operators import candidates as C
from mergewell.operators import dedupe as D
from mergewell.operators import incremental as Inc
from mergewell.operators import keys as K
from mergewell.operators import merge as M
from mergewell.operators import persist as X
from mergewell.operators import policy as P
from mergewell.operators import resolve as R


def keys_of(spark, expr):
    return spark.range(1).select(expr.alias("k")).first()["k"]


def ids(**kv):
    return F.array(*[F.struct(F.lit(n.replace("__", ":")).alias("namespace"), F.lit(v).alias("value")) for n, v in kv.items()]).cast(K.IDS)


def no_ids():
    return F.array().cast(K.IDS)


def null():
    return F.lit(None).cast("string")


def test_artist_keys_in_order(spark):
    got = keys_of(spark, K.artist_keys(F.lit("rem"), F.array(F.lit("spotify"), F.lit("lastfm")), ids(musicbrainz__artist="mbid-1")))
    assert got == ['["artist:external_id","musicbrainz:artist","mbid-1"]', '["artist:mbid","mbid-1"]', '["artist:source-name","lastfm","rem"]', '["artist:name","rem"]']
    assert keys_of(spark, K.artist_keys(F.lit("boards of canada"), F.array().cast("array<string>"), no_ids())) == ['["artist:name","boards of canada"]']


def test_release_set_falls_back_by_context(spark):
    source = F.array(F.lit("lastfm"))
    assert keys_of(spark, K.release_set_keys(F.lit("best of"), null(), source, no_ids(), no_ids())) == ['["release_set:source-title","lastfm","best of"]']
    assert keys_of(spark, K.release_set_keys(F.lit("best of"), null(), source, no_ids(), ids(musicbrainz__release="r"))) == ['["release_set:child_release_external_id","musicbrainz:release","r"]']


def test_recording_without_artist_has_no_key(spark):
    assert keys_of(spark, K.recording_keys(F.lit("t"), null(), F.lit(1000), F.array(F.lit("lastfm")), no_ids())) == []
    assert keys_of(spark, K.user_keys(null(), F.lit(""), null(), null())) == []


def test_identity_key_prefers_free_keys(spark):
    k = K.recording_keys(F.lit('say "x"'), F.lit("a"), F.lit(None).cast("int"), F.array(F.lit("lastfm")), no_ids())
    assert keys_of(spark, K.identity_key(k)) == '["recording:artist-title","a","say \\"x\\""]'


def test_primary_artist(spark):
    rows = [("s", "featured", 0, 1, "guest"), ("s", "primary", 1, 2, "radiohead"), ("s", "primary", None, 3, "late"), ("t", "primary", 0, 1, None), ("t", None, 0, 2, "x")]
    df = spark.createDataFrame(rows, "owner string, role string, credit_order int, ord int, artist_name string")
    assert {r.owner: r.artist for r in K.primary_artist(df, "owner").collect()} == {"s": "radiohead", "t": "x"}


def greedy_model(claims):
    owner, dropped = {}, {}
    for c, ks in claims:
        hit = next(((owner[k], k) for k in ks if k in owner), None)
        if hit:
            dropped[c] = hit
        else:
            owner |= {k: c for k in ks}
    return dropped


def run_greedy(spark, claims):
    rows = [(c, i, "recording", n, k) for i, (c, ks) in enumerate(claims) for n, k in enumerate(ks)]
    df = spark.createDataFrame(rows, "claim_id string, claim_ord long, entity_type string, key_ord int, key string")
    _, dropped = D.dedupe_greedy(df)
    return {r.claim_id: (r.rep_claim_id, r.matched_key) for r in dropped.collect()}


def test_greedy_is_not_transitive(spark):
    claims = [("A", ["k1"]), ("B", ["k1", "k2"]), ("C", ["k2"])]
    assert run_greedy(spark, claims) == {"B": ("A", "k1")} == greedy_model(claims)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6))
def test_greedy_equals_the_sequential_scan(spark, seed):
    rnd = random.Random(seed)
    claims = [(f"c{i:03}", list(dict.fromkeys(f"k{rnd.randint(0, 40)}" for _ in range(rnd.randint(1, 4))))) for i in range(60)]
    assert run_greedy(spark, claims) == greedy_model(claims)


def test_redirects_follow_chains_and_stop_at_loops(spark):
    df = spark.createDataFrame([("n", "old", "mid"), ("n", "mid", "new"), ("l", "a", "b"), ("l", "b", "a"), ("s", "x", "x")], "namespace string, source_value string, target_value string")
    got = {(r.namespace, r.source_value): r.target_value for r in R.redirect_closure(df).collect()}
    assert got == {("n", "old"): "new", ("n", "mid"): "new", ("l", "a"): "b", ("l", "b"): "a"}


def test_resolution_states(spark):
    claims = spark.createDataFrame([(c, "recording") for c in "abcdef"], "claim_id string, entity_type string")
    cid = spark.createDataFrame([("a", "recording", 0, "isrc", "1"), ("b", "recording", 0, "isrc", "9"), ("e", "recording", 0, "isrc", "1"), ("e", "recording", 1, "mbid", "z"), ("f", "recording", 0, "isrc", "old")], "claim_id string, entity_type string, pos int, namespace string, value string")
    ext = spark.createDataFrame([("isrc", "1", "recording", "E1"), ("mbid", "y", "recording", "E1")], "namespace string, value string, owner_type string, owner_id string")
    keys = spark.createDataFrame([("c", "recording", 0, "k1"), ("d", "recording", 0, "k1"), ("d", "recording", 1, "k2"), ("a", "recording", 0, "k2")], "claim_id string, entity_type string, key_ord int, key string")
    side = spark.createDataFrame([("recording", "k1", "E1"), ("recording", "k2", "E2"), ("artist", "k1", "X")], "entity_type string, key string, entity_id string")
    red = spark.createDataFrame([("isrc", "old", "1")], "namespace string, source_value string, target_value string")
    got = {r.claim_id: (r.status, r.reason, r.target_id, r.matched_key) for r in R.resolve_entities(claims, cid, keys, ext, red, side).collect()}
    assert got == {
        "a": ("resolved", "exact_match", "E1", None), "b": ("new", "no_exact_match", None, None), "c": ("resolved", "exact_match", "E1", "k1"),
        "d": ("ambiguous", "multiple_exact_matches", None, "k1"), "e": ("conflict", "external_id_namespace_conflict", None, None), "f": ("resolved", "exact_match", "E1", None),
    }

    odd = spark.createDataFrame([("E1", "recording"), ("E2", "label")], "entity_id string, entity_type string")
    told = {r.claim_id: (r.status, r.reason, r.target_id) for r in R.resolve_entities(claims, cid, keys, ext, red, side, odd).collect()}
    assert told["d"] == ("conflict", "candidate_type_mismatch", None) and told["a"] == ("resolved", "exact_match", "E1") and told["b"][0] == "new"


def test_decisions_do_not_plan_the_search_for_candidates_again(spark):
    claims = spark.createDataFrame([("a", "recording"), ("b", "recording")], "claim_id string, entity_type string")
    cid = spark.createDataFrame([("a", "recording", 0, "isrc", "1")], "claim_id string, entity_type string, pos int, namespace string, value string")
    ext = spark.createDataFrame([("isrc", "1", "recording", "E1")], "namespace string, value string, owner_type string, owner_id string")
    keys = spark.createDataFrame([("b", "recording", 0, "k1")], "claim_id string, entity_type string, key_ord int, key string")
    side = spark.createDataFrame([("recording", "k1", "E1")], "entity_type string, key string, entity_id string")
    red = spark.createDataFrame([], "namespace string, source_value string, target_value string")
    decided = P.decide_entities(R.resolve_entities(claims, cid, keys, ext, red, side).withColumn("confidence", F.lit(None).cast("double")))
    assert {r.claim_id: r.strategy for r in decided.collect()} == {"a": "merge", "b": "noop"}
    assert "key_ord" not in decided._jdf.queryExecution().optimizedPlan().toString()


def test_policy(spark):
    rows = [("b", "recording", "resolved", "T", None, "exact_match"), ("a", "recording", "resolved", "T", None, "exact_match"), ("c", "recording", "resolved", "T", 0.0, "exact_match"), ("d", "recording", "new", None, None, None), ("e", "recording", "ambiguous", None, None, "multiple_exact_matches")]
    df = spark.createDataFrame(rows, "claim_id string, entity_type string, status string, target_id string, confidence double, reason string").withColumn("candidate_ids", F.array(F.lit("x"), F.lit("x")))
    got = {r.claim_id: (r.strategy, r.reason) for r in P.decide_entities(df).collect()}
    assert got == {"c": ("merge", "resolved_target_selected"), "a": ("noop", "duplicate_resolved_target"), "b": ("noop", "duplicate_resolved_target"), "d": ("create", "resolved_as_new"), "e": ("manual_review", "multiple_exact_matches")}


def test_merge_rules(spark):
    stored = spark.createDataFrame([("1", "Old", "GB", ["a", "b"]), ("2", "Keep", None, None)], "entity_id string, name string, country string, aliases array<string>")
    incoming = spark.createDataFrame([("1", "  ", "US", ["b", "c", "c"])], "entity_id string, name string, country string, aliases array<string>")
    got = {r.entity_id: r for r in M.merge_entities(stored, incoming, "artist").collect()}
    assert (got["1"].name, got["1"].country, got["1"].aliases, sorted(got["1"].changed_fields)) == ("Old", "US", ["a", "b", "c"], ["aliases", "country"])
    assert (got["2"].name, got["2"].changed_fields) == ("Keep", [])
    over = M.overwrite_payload(stored.withColumnRenamed("entity_id", "edge_id"), spark.createDataFrame([("1", None)], "edge_id string, country string"), ["country"])
    assert {r.edge_id: r.country for r in over.collect()} == {"1": None, "2": None}


def test_external_id_conflicts_are_told(spark):
    schema = "owner_type string, owner_id string, namespace string, value string"
    add, clash = M.absorb_external_ids(spark.createDataFrame([("r", "1", "n", "v")], schema), spark.createDataFrame([("r", "1", "n", "w"), ("r", "1", "m", "x")], schema))
    assert [r.namespace for r in add.collect()] == ["m"] and [r.value for r in clash.collect()] == ["w"]


def test_first_owner_keeps_a_key(spark):
    stored = spark.createDataFrame([("recording", "k1", "E1")], "entity_type string, key string, entity_id string")
    new = spark.createDataFrame([("recording", "k1", "E2", 1), ("recording", "k2", "E3", 2), ("recording", "k2", "E2", 1)], "entity_type string, key string, entity_id string, o int")
    assert [(r.key, r.entity_id) for r in X.insert_or_ignore(stored, new, ["entity_type", "key"], ["o"]).collect()] == [("k2", "E2")]


CANDIDATE = "release_id string, recording_id string, mbid string, ord int, title string, track_count int"


@pytest.mark.parametrize(("rows", "title", "n", "want"), [
    ([("r", "1", "a", 1, "BLUSH", 3), ("r", "2", "a", 2, "BLUSH", 3), ("r", "3", "a", 3, "BLUSH", 3), ("r", "1", "b", 4, "Other", 9), ("r", "2", "c", 5, "Mix", 12)], "BLUSH", 3, "a"),
    ([("r", "1", "a", 1, "Two Ribbons", 9), ("r", "1", "b", 2, "Ghosts", 9)], "Two Ribbons", 9, "a"),
    ([("r", "1", "a", 1, "Somersaults", 12)], "Somersaults", 1, "a"),
    ([("r", "1", "a", 1, "Same", 2), ("r", "1", "b", 2, "Same", 2)], "Same", 2, None),
    ([("r", "1", "a", 1, "Nothing alike", 2)], "Same", 2, None),
])
def test_candidates(spark, rows, title, n, want):
    local = spark.createDataFrame([("r", title, n)], "release_id string, local_title string, n_tracks int")
    got = [r.mbid for r in C.confident(C.rank(C.aggregate_hits(spark.createDataFrame(rows, CANDIDATE)), local)).collect()]
    assert got == ([want] if want else [])


def test_waterfall_takes_the_first_level(spark):
    df = lambda *r: spark.createDataFrame(list(r), "release_id string, ord int, mbid string")
    got = {r.release_id: r.mbid for r in C.waterfall([df(("x", 1, "own")), df(("x", 1, "browse"), ("y", 2, "b2"), ("y", 1, "b1"))]).collect()}
    assert got == {"x": "own", "y": "b1"}


def test_new_events(spark):
    e = spark.createDataFrame([(i, "u", "s", t) for i, t in enumerate([5, 5, 6, 7, 9])], "ord int, user_id string, source string, played_at int")
    stored = e.where("played_at = 7")
    got = Inc.new_events(e, stored, F.lit(4), F.lit(8)).collect()
    assert sorted((r.played_at, r.ord) for r in got) == [(5, 0), (6, 2)]
    assert Inc.new_events(e, stored, F.lit(5), F.lit(6)).count() == 1  # after is exclusive, until inclusive


def test_endpoints_block(spark):
    rels = spark.createDataFrame([("r1", "a", "b"), ("r2", "a", "c")], "rel_id string, src_claim_id string, dst_claim_id string")
    res = spark.createDataFrame([("a", "resolved", "A"), ("b", "new", None), ("c", "ambiguous", None)], "claim_id string, status string, target_id string")
    got = {r.rel_id: (r.src_id, r.dst_id, r.blocked_by) for r in R.endpoints(rels, res).collect()}
    assert got == {"r1": ("A", "b", []), "r2": ("A", None, ["c"])}


def test_anchor_collisions(spark):
    ask = spark.createDataFrame([("r1", "release", "o1", "n", "v"), ("r2", "release", "o2", "n", "v"), ("r3", "release", "o3", "n", "held")], "release_id string, owner_type string, owner_id string, namespace string, value string")
    held = spark.createDataFrame([("n", "held", "release", "o9")], "namespace string, value string, owner_type string, owner_id string")
    got = {r.release_id: r.accepted for r in C.anchor(ask, held, "c").collect()}
    assert got == {"r1": True, "r2": False, "r3": False}
