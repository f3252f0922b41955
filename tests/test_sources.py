import json

import pytest
from pyspark.sql import functions as F

from mergewell.sources import lookup, payloads
from mergewell.sources.translate import release_graph


def test_lookups(spark):
    rows = spark.createDataFrame([("m1", "Blue Song", "A"), ("m2", "blue  song", "B"), ("m3", "Red", "A")], "mbid string, title string, artist string")
    ask = spark.createDataFrame([("1", "m1"), ("2", "old"), ("3", "nowhere")], "request_id string, mbid string")
    red = spark.createDataFrame([("old", "m3")], "source_value string, target_value string")
    got = {r.request_id: (r.resolved, r.redirected, r.found) for r in lookup.by_id(ask, rows, red).collect()}
    assert got == {"1": ("m1", False, True), "2": ("m3", True, True), "3": ("nowhere", False, False)}
    text = spark.createDataFrame([("1", "BLUE SONG", None), ("2", "blue song", "b"), ("3", " ", "A")], "request_id string, title string, artist string")
    assert sorted((r.request_id, r.mbid) for r in lookup.search(text, rows).collect()) == [("1", "m1"), ("1", "m2"), ("2", "m2")]
    assert [r.mbid for r in lookup.search(text, rows, 1).where("request_id = '1'").collect()] == ["m1"]
    by = spark.createDataFrame([("q", "A"), ("r", None)], "request_id string, artist string")
    assert sorted(r.mbid for r in lookup.browse(by, rows, "artist").collect()) == ["m1", "m3"]


def test_release_candidates_fall_back_to_search(spark):
    known = spark.createDataFrame([("m1", "Song", "A"), ("m2", "Other", "B")], "mbid string, title string, artist string")
    listed = spark.createDataFrame([("m1", "rel1", "R1", 3, 0), ("m1", "rel1", "R1 again", 3, 1), ("m2", "rel2", "R2", 1, 0)], "mbid string, release_mbid string, title string, track_count int, pos int")
    recs = spark.createDataFrame([("x", "m1", "-", "-"), ("y", "gone", "Other", "B"), ("z", None, "nothing", None)], "recording_id string, mbid string, title string, artist string")
    got = sorted((r.recording_id, r.release_mbid, r.title) for r in lookup.release_candidates(recs, known, listed).collect())
    assert got == [("x", "rel1", "R1"), ("y", "rel2", "R2")]


def test_recordings_of_equal_texts_share_their_releases(spark):
    known = spark.createDataFrame([("m1", "Song", "A"), ("m2", "song", "A"), ("m3", "Else", "B")], "mbid string, title string, artist string")
    listed = spark.createDataFrame([("m1", "rel1", "a", 3, 4), ("m2", "rel1", "b", 3, 2), ("m2", "rel2", "c", 1, 0), ("m3", "rel3", "d", 1, 9), ("m3", "rel1", "e", 1, 1)], "mbid string, release_mbid string, title string, track_count int, pos int")
    recs = spark.createDataFrame([("x", None, "SONG", "A"), ("y", "gone", "Song", None), ("z", "m3", "Song", "A"), ("z", "m1", "Song", "A"), ("w", "m1", None, None)], "recording_id string, mbid string, title string, artist string")
    df = lookup.release_candidates(recs, known, listed)
    assert sorted((r.recording_id, r.release_mbid, r.mbid, r.title) for r in df.collect()) == [
        ("w", "rel1", "m1", "a"), ("x", "rel1", "m2", "b"), ("x", "rel2", "m2", "c"), ("y", "rel1", "m2", "b"), ("y", "rel2", "m2", "c"), ("z", "rel1", "m3", "e"), ("z", "rel3", "m3", "d"),
    ]
    # Lists are put in order before recordings meet them, not once for each recording.
    ordered = [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in line]
    assert ordered and not any("recording_id" in line for line in ordered)


def test_artist_names_keep_their_order(spark):
    df = spark.createDataFrame([("r", 2, "B"), ("r", 1, "A"), ("r", 3, "B"), ("r", 4, "C")], "release_id string, ord int, artist string")
    assert lookup.artist_names(df).first().artists == ["A", "B", "C"]


def test_artist_details(spark, tmp_path):
    artist = {"id": "a", "name": "A", "type": "Group", "sort-name": "A, the", "area": {"name": "Paris", "type": "City", "iso-3166-1-codes": ["FR"]}, "begin-area": {"name": "X", "type": "Planet"}, "life-span": {"begin": "1999-02", "ended": False}, "aliases": [{"name": "AA"}], "ipis": ["1", "2"], "relations": [{"type": "free streaming", "url": {"resource": "https://s.org/a"}}, {"type": "none"}]}
    (tmp_path / "r.jsonl").write_text(json.dumps({"id": "r", "title": "T", "artist-credit": [{"name": "A", "artist": artist}], "media": []}) + "\n")
    a = release_graph(payloads.read(spark, str(tmp_path / "r.jsonl"), payloads.METADATA_RELEASE))["artist"].first()
    assert (a.kind, a.sort_name, a.aliases, a.life_span.begin.month, a.life_span.ended) == ("group", "A, the", ["AA"], 2, False)
    assert [(x.name, x.area_type, x.role, x.country_codes) for x in a.areas] == [("Paris", "city", "primary", ["FR"]), ("X", "other", "begin", None)]
    assert [(x.namespace, x.value) for x in a.ids] == [("musicbrainz:artist", "a"), ("artist:ipi", "1"), ("url:free-streaming:s.org", "https://s.org/a")]


def pages_of(spark, paging, **options):
    from mergewell.sources import paged

    paged.register(spark)
    fetch = options.pop("fetch", paging)
    df = spark.read.format("paged").options(paging=paging, fetch=f"mergewell.sources.sample:{fetch}", **options).load()
    return df, [(r.page, json.loads(r.body)["items"]) for r in df.orderBy("page").collect()]


@pytest.mark.parametrize("paging, fetch", [("numbered", "numbered"), ("offset", "offset"), ("offset", "untold"), ("cursor", "cursor")])
def test_pagings_read_the_same_pages(spark, paging, fetch):
    want = [(1, [1, 2, 3]), (2, [4, 5, 6]), (3, [7])]
    assert pages_of(spark, paging, fetch=fetch, n=7, limit=3)[1] == want
    assert pages_of(spark, paging, fetch=fetch, n=7, limit=3, maxpages=2)[1] == want[:2]
    empty = pages_of(spark, paging, fetch=fetch, n=0, limit=3)[1]
    assert empty == ([] if fetch == "untold" else [(1, [])])


def test_lanes_share_the_limit(spark):
    from mergewell.sources.paged import _Reader

    at = {"fetch": "mergewell.sources.sample:numbered", "n": "100", "limit": "10"}
    lanes = lambda **o: [p.value for p in _Reader({**at, **o}).partitions()]
    assert [len(x) for x, _ in lanes()] == [1] * 10
    assert lanes(calls="2", seconds="1") == [([1, 3, 5, 7, 9], 2), ([2, 4, 6, 8, 10], 2)]
    assert [n for _, n in lanes(calls="8", lanes="3")] == [3, 3, 3]
    with pytest.raises(ValueError):
        _Reader({**at, "paging": "backwards"})


def test_a_provider_may_ask_for_a_wait():
    from mergewell.sources.paged import ProviderError, retrying

    waits, failures = [], [ProviderError(429, retry_after=7.0), ProviderError(503), ProviderError(429, retry_after=900.0)]

    def call():
        if failures:
            raise failures.pop(0)
        return "ok"

    assert retrying(call, waits.append, lambda: 0.5) == "ok" and waits == [7.0, 1.5, 60.0]


def joined(df):
    """Rows that the joins of a query make."""

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if "QueryStageExec" in name:
            return walk(plan.plan())
        kids = plan.children()
        return (plan.metrics().apply("numOutputRows").value() if "Join" in name else 0) + sum(walk(kids.apply(i)) for i in range(kids.size()))

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_requests_meet_only_the_first_rows_of_a_frequent_title(spark):
    k = F.col("id")
    rows = spark.range(2000).select(F.lpad(k.cast("string"), 5, "0").alias("mbid"), F.lit("Intro").alias("title"), F.when(k % 4 > 0, F.concat(F.lit("A"), (k % 4).cast("string"))).alias("artist"))
    rows = rows.unionByName(rows)  # equal rows count once
    asked = spark.range(600).select(k.alias("request_id"), F.lit("intro").alias("title"), F.when(k % 3 == 0, "a2").when(k % 3 == 1, " ").alias("artist"))
    found = lookup.search(asked, rows)
    got = {}
    for r in found.collect():
        got.setdefault(r.request_id % 3, set()).add((r.ord, r.mbid))
    first = {(i, f"{i:05}") for i in range(5)}
    assert got == {0: {(i, f"{4 * i + 2:05}") for i in range(5)}, 1: first, 2: first}
    assert joined(found) <= 5 * 600
