"""Release updates in order: each release sees what those before it wrote.

Releases that have nothing to do with each other are updated in one batch. What makes two of them
wait is a conflict: they share a key, an id, a stored entity, a set or an anchor, and do not say
the same of it. (Of what both say alike the second would change nothing.) A layer holds the
releases that are the first in all of their conflicts; it is updated and committed, and the rest
looks again, with what has become stored. A commit a layer also means that a run that dies goes on
where it stopped. The order differs from that of one by one in one case: a release that waits and
then chooses another candidate can find that a later one, with which it had nothing to do before,
has taken it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergewell.functions.text import normalize_text
from mergewell.operators import candidates as C
from mergewell.operators import keys as K
from mergewell.operators import merge as M
from mergewell.operators import persist as X
from mergewell.operators import resolve as R
from mergewell.operators import search as S
from mergewell.operators.cut import checkpointed, collected
from mergewell.plans.engine import State, claim_keys, conform
from mergewell.plans.workflows import release_claims, update_releases
from mergewell.schemas import FACTS
from mergewell.sources import lookup

#: Found recordings and releases of a text search.
FOUND = 5


@dataclass
class Landed:
    """Metadata as translate.release_graph has it, redirects of fetched ids (namespace,
    source_value, target_value), who leads the credits of sets and recordings, and both indexed."""

    graph: dict[str, DataFrame]
    moved: DataFrame
    recordings: S.Index
    releases: S.Index

    @classmethod
    def of(cls, graph: dict[str, DataFrame], moved: DataFrame) -> Landed:
        graph = {name: checkpointed(df) for name, df in graph.items()}
        lead = graph["credit"].where("role = 'primary'").groupBy("owner_type", "owner").agg(F.min_by("artist_name", "credit_order").alias("artist"))
        by = lambda kind: lead.where(F.col("owner_type") == kind).select(F.col("owner").alias("mbid"), "artist")
        known = graph["track"].select(F.col("recording_mbid").alias("mbid"), F.col("recording_title").alias("title")).distinct()
        recordings = S.build(known.join(by("recording"), "mbid", "left"), depth=FOUND)
        releases = S.build(graph["release"].select("mbid", "title").join(by("release_set"), "mbid", "left"), depth=FOUND)
        return cls(graph, checkpointed(moved), recordings, releases)


def local_releases(state: State, provider: str = "musicbrainz") -> DataFrame:
    """Releases without the provider's word: release_id, title, artist (of their set), n_tracks."""
    due = C.without_source(state.entities.where("entity_type = 'release'"), provider).select(F.col("entity_id").alias("release_id"), F.col("name").alias("title"))
    sets = state.edges.where("kind = 'release_set_release'").select(F.col("dst_id").alias("release_id"), F.col("src_id").alias("set_id"))
    sets = M.first_of(sets, ["release_id"], ["set_id"])
    n = state.edges.where("kind = 'release_track'").groupBy(F.col("src_id").alias("release_id")).agg(F.count("*").alias("n_tracks"))
    lead = _leads(state, "release_set_contribution").withColumnRenamed("owner", "set_id")
    met = due.join(sets, "release_id", "left").join(n, "release_id", "left").join(lead, "set_id", "left")
    return met.select("release_id", "set_id", "title", "artist", F.coalesce("n_tracks", F.lit(0)).alias("n_tracks"))


def _leads(state: State, kind: str) -> DataFrame:
    """(owner, artist): the name that leads the stored credits of each set or recording."""
    names = state.entities.where("entity_type = 'artist'").select(F.col("entity_id").alias("dst_id"), normalize_text(F.col("name")).alias("artist_name"))
    credits = state.edges.where(F.col("kind") == kind).join(names, "dst_id")
    return K.primary_artist(credits.select(F.col("src_id").alias("owner"), "role", "credit_order", F.col("edge_id").alias("ord"), "artist_name"), "owner")


def _tracks(state: State) -> DataFrame:
    return state.edges.where("kind = 'release_track'").select(F.col("src_id").alias("release_id"), F.col("dst_id").alias("recording_id")).distinct()


def _ids(state: State, owner_type: str, namespace: str, owner: str) -> DataFrame:
    own = state.external_ids.where((F.col("owner_type") == owner_type) & (F.col("namespace") == namespace))
    return M.first_of(own.select(F.col("owner_id").alias(owner), F.col("value").alias("mbid")), [owner], ["mbid"])


def choose(local: DataFrame, state: State, landed: Landed) -> DataFrame:
    """(release_id, level, requested, resolved) of the releases for which a candidate is found and
    its metadata is there: by their own id, else the first release of their set's group, else the
    best of those of their recordings if it is sure, else the best of a search."""
    graph = landed.graph
    own = _ids(state, "release", "musicbrainz:release", "release_id").join(local.select("release_id"), "release_id").withColumn("ord", F.lit(0))
    own = checkpointed(own)  # like the other sources it is read twice below, and the best of all again

    group = _ids(state, "release_set", "musicbrainz:release-group", "set_id").withColumnRenamed("mbid", "group")
    listed = graph["release_set"].select(F.col("mbid").alias("group"), F.col("release_mbid").alias("mbid"))
    asked = local.join(group, "set_id").select(F.col("release_id").alias("request_id"), "group")
    browsed = checkpointed(lookup.browse(asked, listed, "group").select(F.col("request_id").alias("release_id"), "mbid", "ord"))

    tracks = _tracks(state)
    names = state.entities.where("entity_type = 'recording'").select(F.col("entity_id").alias("recording_id"), F.col("name").alias("title"))
    recordings = local.select("release_id").join(tracks, "release_id").join(names, "recording_id")
    recordings = recordings.join(_ids(state, "recording", "musicbrainz:recording", "recording_id"), "recording_id", "left").join(_leads(state, "recording_contribution").withColumnRenamed("owner", "recording_id"), "recording_id", "left")
    recordings = checkpointed(recordings)
    on = graph["track"].select("recording_mbid", F.col("release_mbid").alias("mbid")).distinct()
    direct = recordings.withColumnRenamed("mbid", "recording_mbid").join(on, "recording_mbid").select("release_id", "recording_id", "mbid")
    unknown = recordings.join(direct.select("recording_id").distinct(), "recording_id", "left_anti")
    hits = checkpointed(S.find(unknown.select(F.col("recording_id").alias("request_id"), "title", "artist").distinct(), landed.recordings, FOUND))
    by_text = hits.select(F.col("request_id").alias("recording_id"), F.col("id").alias("recording_mbid")).join(on, "recording_mbid").join(unknown.select("release_id", "recording_id"), "recording_id").select("release_id", "recording_id", "mbid").distinct()
    facts = graph["release"].select("mbid", "title", "track_count")
    found = direct.unionByName(by_text).join(facts, "mbid").withColumn("ord", F.col("mbid"))
    ranked = C.rank(C.aggregate_hits(found), local.select("release_id", F.col("title").alias("local_title"), "n_tracks"))
    sure = checkpointed(C.confident(ranked).select("release_id", "mbid", F.lit(0).alias("ord")))

    rest = local
    for df in (own, browsed, sure):
        rest = rest.join(df.select("release_id"), "release_id", "left_anti")
    asked = rest.select(F.col("release_id").alias("request_id"), "title", "artist")
    searched = S.find(asked, landed.releases, FOUND).select(F.col("request_id").alias("release_id"), F.col("id").alias("mbid"), "ord")
    best = checkpointed(C.waterfall([df.select("release_id", "mbid", F.col("ord").cast("int").alias("ord")) for df in (own, browsed, sure, searched)]))
    met = lookup.by_id(best.select(F.col("release_id").alias("request_id"), "mbid"), graph["release"], landed.moved.where("namespace = 'musicbrainz:release'")).where("found")
    return best.select("release_id", "level").join(met.select(F.col("request_id").alias("release_id"), "requested", "resolved"), "release_id")


def conflicts(picks: DataFrame, local: DataFrame, state: State, graph: dict[str, DataFrame]) -> DataFrame:
    """(release_id, key): what picks share without saying the same of it, and what of the store
    the choice of any of `local` depends on, where it is shared."""
    only = lambda df, c: df.join(picks.select(F.col("resolved").alias(c)).distinct(), c, "left_semi")
    some = {"release": only(graph["release"], "mbid"), **{n: only(graph[n], "release_mbid") for n in ("release_set", "label", "track")}}
    some = {name: checkpointed(df) for name, df in some.items()}  # they feed many claims
    heard = some["track"].select(F.col("recording_mbid").alias("owner")).distinct()
    credit = graph["credit"]
    some["credit"] = checkpointed(only(credit.where("owner_type = 'release_set'"), "owner").unionByName(credit.where("owner_type = 'recording'").join(heard, "owner", "left_semi")))
    claims, rels = release_claims(some)
    claims = conform(claims, f"facts {FACTS}").where("entity_type <> 'artist'")  # landed artists are one each
    said = F.xxhash64("entity_type", "name", "artist", "duration_ms", F.to_json("ids"), F.to_json("child_ids"), F.to_json("facts"))
    of = F.split("claim_id", r"\|")[1]
    told = checkpointed(claims.select("claim_id", "claim_ord", "entity_type", "name", "artist", "duration_ms", "sources", "ids", "child_ids", "confidence", of.alias("resolved"), said.alias("said")))
    keys = checkpointed(claim_keys(told))
    by_key = keys.select("claim_id", F.concat_ws(" ", F.lit("key"), "entity_type", "key").alias("key"))
    claim_ids = told.select("claim_id", "entity_type", F.posexplode("ids").alias("pos", "x")).select("claim_id", "entity_type", "pos", "x.namespace", "x.value")
    to = R.resolve_entities(told, claim_ids, keys, state.external_ids, state.redirects, state.sidecar)
    by_entity = to.select("claim_id", F.explode("candidate_ids").alias("e")).select("claim_id", F.concat(F.lit("entity "), "e").alias("key"))
    shared = by_key.unionByName(by_entity).join(told.select("claim_id", "resolved", "said"), "claim_id").join(picks.select("release_id", "resolved"), "resolved").select("release_id", "key", "said")
    ends = told.select("claim_id", "said")
    linked = rels.join(ends.select(F.col("claim_id").alias("src_claim_id"), F.col("said").alias("a")), "src_claim_id").join(ends.select(F.col("claim_id").alias("dst_claim_id"), F.col("said").alias("b")), "dst_claim_id", "left")
    payload = F.xxhash64("role", "credit_order", "disc_number", "track_number", "credited_as", "join_phrase", "title_override", "duration_ms")
    linked = linked.select(F.split("rel_id", r"\|")[1].alias("resolved"), F.concat_ws(" ", F.lit("edge"), "kind", "a", F.coalesce(F.col("b").cast("string"), F.col("dst_claim_id"))).alias("key"), payload.alias("said"))
    linked = linked.join(picks.select("release_id", "resolved"), "resolved").select("release_id", "key", "said")
    shared = checkpointed(shared).unionByName(checkpointed(linked))
    me = F.xxhash64("release_id").alias("said")
    anchors = picks.select("release_id", F.explode(F.array_distinct(F.array("requested", "resolved"))).alias("v")).select("release_id", F.concat(F.lit("anchor "), "v").alias("key"), me)
    # What a release is updated from can depend on the ids that its set and its recordings get.
    sets = local.where("set_id is not null").select("release_id", F.concat(F.lit("set "), "set_id").alias("key"), me)
    nameless = _tracks(state).join(_ids(state, "recording", "musicbrainz:recording", "recording_id"), "recording_id", "left_anti")
    heard_here = local.select("release_id").join(nameless, "release_id").select("release_id", F.concat(F.lit("recording "), "recording_id").alias("key"), me)
    every = checkpointed(shared.unionByName(anchors).unionByName(sets).unionByName(heard_here).distinct())
    torn = every.groupBy("key").agg(F.min("said").alias("a"), F.max("said").alias("b")).where("a <> b").select("key")
    return every.join(torn, "key").select("release_id", "key").distinct()


def first_layer(releases: DataFrame, torn: DataFrame, width: int | None = None) -> DataFrame:
    """The releases that are the first of all that they conflict with; `width` at most."""
    low = torn.groupBy("key").agg(F.min("release_id").alias("low"))
    waiting = torn.join(low, "key").where("release_id > low").select("release_id").distinct()
    free = releases.select("release_id").join(waiting, "release_id", "left_anti")
    return free if width is None else free.orderBy("release_id").limit(width)


@dataclass
class Run:
    """`applied` (release_id, requested, resolved, level, layer), `review` (release_id, reason,
    layer), `counters` of all layers and their number. Releases without a candidate are in none."""

    applied: DataFrame
    review: DataFrame
    counters: DataFrame
    layers: int


def update_in_order(store: X.Store, graph: dict[str, DataFrame], moved: DataFrame | None = None, provider: str = "musicbrainz", limit: int | None = None, width: int | None = None) -> Run:
    """Updates of the stored releases that the provider has not confirmed, by id, the first
    `limit` of them, from landed metadata; committed layer by layer. With `width` 1 releases are
    updated one by one."""
    state = State.load(store)
    moved = state.redirects if moved is None else state.redirects.select(*moved.columns).unionByName(moved)
    landed = Landed.of(graph, moved.select("namespace", "source_value", "target_value").distinct())
    collected(store.spark)
    todo = checkpointed(local_releases(state, provider).select("release_id"))
    todo = todo if limit is None else checkpointed(todo.orderBy("release_id").limit(limit))
    applied, review, counts, layers = [], [], [], 0
    while True:
        local = checkpointed(local_releases(state, provider).join(todo, "release_id"))
        if local.isEmpty():
            break
        picks = checkpointed(choose(local, state, landed))
        collected(store.spark)
        layer = checkpointed(first_layer(local, conflicts(picks, local, state, landed.graph), width))
        collected(store.spark)
        todo = checkpointed(todo.join(layer, "release_id", "left_anti"))
        now = checkpointed(picks.join(layer, "release_id"))
        if now.isEmpty():  # no candidates; those that wait behind them look again
            continue
        done = update_releases(state, now, landed.graph, provider, idle=False)
        at = F.lit(layers).alias("layer")
        applied.append(checkpointed(now.join(done.accepted.select("release_id"), "release_id").select("release_id", "requested", "resolved", "level", at)))
        review.append(checkpointed(done.review.select("release_id", "reason", at)))
        layers += 1
        if done.outcome is not None:  # else all of them are under review and the store stays as it is
            counts.append(checkpointed(done.outcome.counters))
            collected(store.spark)
            done.outcome.state.save(store)
            state = State.load(store)
        del done
        collected(store.spark)
    spark = todo.sparkSession
    every = lambda dfs, ddl: _union(dfs) if dfs else spark.createDataFrame([], ddl)
    names = "subject string, applied long, created long, merged long, skipped long, manual_review long"
    return Run(every(applied, "release_id string, requested string, resolved string, level int, layer int"), every(review, "release_id string, reason string, layer int"), M.sum_counters(every(counts, names)), layers)


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out
