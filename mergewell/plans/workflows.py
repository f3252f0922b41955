"""Library ingestion and release updates over the engine."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergewell.operators import candidates as C
from mergewell.operators import dedupe as D
from mergewell.operators import incremental as Inc
from mergewell.operators import merge as M
from mergewell.operators import persist as X
from mergewell.operators import resolve as R
from mergewell.plans.engine import Outcome, State, reconcile
from mergewell.schemas import FACT_TYPES, FACTS, PAYLOAD_TYPES
from mergewell.sources.translate import IDS, external_ids

_NO_IDS = "array<struct<namespace:string,value:string>>"


def _claim(kind: Column | str, claim_id: Column, place: Column, name: Column, artist: Column, ids: Column, source: str, root: Column, /, duration: Column | None = None, children: Column | None = None, **facts: Column) -> Column:
    null = F.lit(None)
    known = F.struct(*[facts.get(f, null).cast(t).alias(f) for f, t in FACT_TYPES.items()]) if facts else null.cast(FACTS)
    return F.struct(
        claim_id.alias("claim_id"), place.alias("claim_ord"), (F.lit(kind) if isinstance(kind, str) else kind).alias("entity_type"), root.alias("is_root"), name.alias("name"), artist.cast("string").alias("artist"),
        (duration if duration is not None else null).cast("long").alias("duration_ms"), F.array(F.lit(source)).alias("sources"), ids.cast(IDS).alias("ids"), (children if children is not None else F.array()).cast(IDS).alias("child_ids"), null.cast("double").alias("confidence"), known.alias("facts"),
    )


def _rel(kind: str, rel_id: Column, place: Column, src: Column, dst: Column, role: Column | None = None, order: Column | None = None, disc: Column | None = None, number: Column | None = None, **payload: Column) -> Column:
    null = F.lit(None)
    cast = lambda c, t: (c if c is not None else null).cast(t)
    return F.struct(
        rel_id.alias("rel_id"), place.alias("rel_ord"), F.lit(kind).alias("kind"), src.alias("src_claim_id"), dst.alias("dst_claim_id"), cast(role, "string").alias("role"),
        cast(order, "int").alias("credit_order"), cast(disc, "int").alias("disc_number"), cast(number, "int").alias("track_number"),
        *[cast(payload.get(c), PAYLOAD_TYPES[c]).alias(c) for c in ("credited_as", "join_phrase", "title_override", "duration_ms")],
    )


def library_claims(rows: DataFrame, source: str = "spotify") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims, rels, items) of saved tracks, albums and artists (payloads.library). Every artist
    credits the set and, of a track, the recording; the first is primary, the rest unknown."""
    codes = F.create_map(*[F.lit(x) for kv in {"isrc": "recording:isrc", "ean": "release:ean", "upc": "release:upc"}.items() for x in kv])
    known = lambda ids: F.filter(F.transform(F.coalesce(ids, F.array().cast(_NO_IDS)), lambda x: F.struct(codes[x["namespace"]].alias("namespace"), x["value"].alias("value"))), lambda x: x["namespace"].isNotNull())
    base = rows.withColumn("pid", F.concat_ws("-", "target_type", "branch", "ord"))
    cid = lambda kind: F.concat(F.lit(f"{kind}|"), F.col("pid"))
    place = lambda n: F.struct(F.struct("branch", "ord").alias("ord"), F.lit(n).alias("place"))
    lead = F.get("credits", F.lit(0))["name"]
    track, album = F.col("target_type") == "recording", F.col("target_type") == "release_set"
    set_id, set_name = F.when(track, F.col("album.id")).otherwise(F.col("id")), F.when(track, F.col("album.name")).otherwise(F.col("name"))
    set_ids = F.concat(external_ids(("spotify:album", set_id)), F.when(album, known(F.col("ids"))).otherwise(F.array().cast(_NO_IDS)))
    entities = F.array(
        F.when(track, _claim("recording", cid("recording"), place(0), F.col("name"), lead, F.concat(external_ids(("spotify:track", F.col("id"))), known(F.col("ids"))), source, track, F.col("duration_ms"))),
        F.when(track | album, _claim("release_set", cid("release_set"), place(1), set_name, lead, set_ids, source, album)),
        F.when(track | album, _claim("release", cid("release"), place(2), set_name, lead, F.array(), source, F.lit(False))),
        F.when(~track & ~album, _claim("artist", cid("artist"), place(3), F.col("name"), F.lit(None), external_ids(("spotify:artist", F.col("id"))), source, F.lit(True))),
    )
    credits = base.where(track | album).select("*", F.posexplode("credits").alias("pos", "credit"))
    aid = F.concat(F.lit("artist|"), F.col("pid"), F.lit("-"), F.col("pos").cast("string"))
    at = F.struct(F.struct("branch", "ord").alias("ord"), (F.col("pos") + 10).alias("place"))
    artists = credits.select(_claim("artist", aid, at, F.col("credit.name"), F.lit(None), external_ids(("spotify:artist", F.col("credit.id"))), source, F.lit(False)).alias("c"))
    claims = base.select(F.explode(F.array_compact(entities)).alias("c")).unionByName(artists).select("c.*")
    role = F.when(F.col("pos") == 0, "primary").otherwise("unknown")
    rid = lambda kind, tail=None: F.concat(F.lit(f"{kind}|"), F.col("pid"), *([F.lit("-"), tail] if tail is not None else []))
    n = F.col("pos").cast("string")
    by_credit = F.array(
        F.when(track, _rel("recording_contribution", rid("recording_contribution", n), at, cid("recording"), aid, role)),
        _rel("release_set_contribution", rid("release_set_contribution", n), at, cid("release_set"), aid, role),
    )
    by_item = F.array(F.when(track, _rel("release_track", rid("release_track"), place(0), cid("release"), cid("recording"))), _rel("release_set_release", rid("release_set_release"), place(1), cid("release_set"), cid("release")))
    rels = credits.select(F.explode(F.array_compact(by_credit)).alias("r")).unionByName(base.where(track | album).select(F.explode(F.array_compact(by_item)).alias("r"))).select("r.*")
    items = base.select("target_type", F.struct("branch", "ord").alias("ord"), F.concat(F.col("target_type"), F.lit("|"), F.col("pid")).alias("target_claim_id"), F.lit(source).alias("source"))
    return claims, rels, items


def ingest_library(rows: DataFrame, user_id: str, state: State, stored: DataFrame) -> tuple[Outcome, DataFrame, DataFrame]:
    """(outcome, items to store, counts fetched / stored / skipped). Items are retargeted to what
    their claims became; those stored or seen before in the batch are skipped."""
    claims, rels, items = library_claims(rows)
    out = reconcile(D.checkpointed(claims), D.checkpointed(rels), state)
    became = out.materialized.select(F.col("claim_id").alias("target_claim_id"), F.col("entity_id").alias("target_id"))
    aimed = items.join(became, "target_claim_id").select(F.lit(user_id).alias("user_id"), "target_type", "target_id", "source", "ord")
    new = D.checkpointed(Inc.new_library_items(aimed, stored))
    counts = items.agg(F.count("*").alias("fetched")).crossJoin(new.agg(F.count("*").alias("stored"))).withColumn("skipped", F.col("fetched") - F.col("stored"))
    return out, new, counts


def release_claims(graph: dict[str, DataFrame], source: str = "musicbrainz") -> tuple[DataFrame, DataFrame]:
    """(claims, rels) of metadata releases (translate.release_graph); the roots are releases."""
    place = lambda key, n: F.struct(F.struct(key.alias("a"), F.lit("").alias("b")).alias("ord"), n.alias("place"))
    key, credit = F.col("release_mbid"), graph["credit"]
    of = lambda *names: {c: F.col(c) for c in names}
    lead = credit.where("role = 'primary'").groupBy("owner_type", "owner").agg(F.min_by("artist_name", "credit_order").alias("lead"))
    set_lead = lead.where("owner_type = 'release_set'").select(F.col("owner").alias("release_mbid"), "lead")
    rec_lead = lead.where("owner_type = 'recording'").select(F.col("owner").alias("recording_mbid"), "lead")
    rel = graph["release"].join(set_lead, F.col("mbid") == F.col("release_mbid"), "left")
    releases = rel.select(_claim("release", F.concat(F.lit("release|"), "mbid"), place(F.col("mbid"), F.lit(0)), F.col("title"), F.col("lead"), F.concat(external_ids(("musicbrainz:release", F.col("mbid"))), F.array_compact(F.array(F.when(F.col("barcode_namespace").isNotNull(), F.struct(F.col("barcode_namespace").alias("namespace"), F.col("barcode").alias("value"))))).cast(IDS)), source, F.lit(True), **of("release_date", "country", "status", "packaging", "medium_count"), format=F.get("formats", F.lit(0))).alias("c"))
    sets = graph["release_set"].join(set_lead, "release_mbid", "left").select(_claim("release_set", F.concat(F.lit("release_set|"), key), place(key, F.lit(1)), F.col("title"), F.col("lead"), external_ids(("musicbrainz:release-group", F.col("mbid"))), source, F.lit(False), children=external_ids(("musicbrainz:release", key)), **of("primary_type", "secondary_types", "first_release", "aliases")).alias("c"))
    track = graph["track"].dropDuplicates(["release_mbid", "recording_mbid"]).join(rec_lead, "recording_mbid", "left")
    recordings = track.select(_claim("recording", F.concat_ws("|", F.lit("recording"), key, "recording_mbid"), place(key, F.lit(2)), F.col("recording_title"), F.col("lead"), external_ids(("musicbrainz:recording", F.col("recording_mbid"))), source, F.lit(False), F.col("duration_ms")).alias("c"))
    labels = graph["label"].select(_claim("label", F.concat_ws("|", F.lit("label"), key, F.col("pos").cast("string")), place(key, F.lit(3)), F.col("name"), F.lit(None), external_ids(("musicbrainz:label", F.col("mbid"))), source, F.lit(False)).alias("c"))
    artists = M.first_of(credit.select("artist_mbid", "artist_name"), ["artist_mbid"], ["artist_name"])
    told = ["sort_name", "country", "kind", "life_span", "areas", "aliases"]
    known = graph["artist"].select(F.col("mbid").alias("artist_mbid"), *told) if "artist" in graph else None
    artists = artists.join(known, "artist_mbid", "left") if known is not None else artists
    artists = artists.select(_claim("artist", F.concat(F.lit("artist|"), "artist_mbid"), place(F.col("artist_mbid"), F.lit(4)), F.col("artist_name"), F.lit(None), external_ids(("musicbrainz:artist", F.col("artist_mbid"))), source, F.lit(False), **(of(*told) if known is not None else {})).alias("c"))
    claims = releases.unionByName(sets).unionByName(recordings).unionByName(labels).unionByName(artists).select("c.*")
    rid = lambda *c: F.concat_ws("|", *c)
    links = graph["release_set"].select(_rel("release_set_release", rid(F.lit("release_set_release"), key), place(key, F.lit(0)), rid(F.lit("release_set"), key), rid(F.lit("release"), key)).alias("r"))
    tracks = graph["track"].select(_rel("release_track", rid(F.lit("release_track"), key, F.col("disc_number").cast("string"), F.col("track_number").cast("string")), place(key, F.lit(1)), rid(F.lit("release"), key), rid(F.lit("recording"), key, "recording_mbid"), disc=F.col("disc_number"), number=F.col("track_number"), **of("title_override", "duration_ms")).alias("r"))
    pressed = graph["label"].select(_rel("release_label", rid(F.lit("release_label"), key, F.col("pos").cast("string")), place(key, F.lit(2)), rid(F.lit("release"), key), rid(F.lit("label"), key, F.col("pos").cast("string"))).alias("r"))
    own = credit.where("owner_type = 'release_set'").select(_rel("release_set_contribution", rid(F.lit("release_set_contribution"), "owner", F.col("credit_order").cast("string")), place(F.col("owner"), F.lit(3)), rid(F.lit("release_set"), "owner"), rid(F.lit("artist"), "artist_mbid"), F.col("role"), F.col("credit_order"), **of("credited_as", "join_phrase")).alias("r"))
    sung = credit.where("owner_type = 'recording'").dropDuplicates(["owner", "credit_order"]).join(graph["track"].select(F.col("recording_mbid").alias("owner"), "release_mbid").distinct(), "owner").select(
        _rel("recording_contribution", rid(F.lit("recording_contribution"), key, "owner", F.col("credit_order").cast("string")), place(key, F.lit(4)), rid(F.lit("recording"), key, "owner"), rid(F.lit("artist"), "artist_mbid"), F.col("role"), F.col("credit_order"), **of("credited_as", "join_phrase")).alias("r")
    )
    rels = links.unionByName(tracks).unionByName(pressed).unionByName(own).unionByName(sung).select("r.*")
    return claims, rels


@dataclass
class Updates:
    outcome: Outcome | None
    accepted: DataFrame
    review: DataFrame


def _asking(rows: DataFrame, owner_type: str, namespace: str, owner: Column, value: Column) -> DataFrame:
    return rows.select("release_id", F.lit(owner_type).alias("owner_type"), owner.alias("owner_id"), F.lit(namespace).alias("namespace"), value.alias("value"))


def update_releases(state: State, picks: DataFrame, graph: dict[str, DataFrame], provider: str = "musicbrainz", limit: int | None = None, idle: bool = True) -> Updates:
    """Stored releases that the provider has not confirmed, updated from fetched metadata.

    picks: release_id, requested, resolved (the id that the fetch ended at). A release without an
    id takes the requested one, one that was redirected the resolved one, and its set the id of the
    group, if it has none. An id that another release or set holds, or an earlier pick of the batch
    wants, sends the release to review, with the first reason there is. A root must then resolve to
    its release; others go to review too. What is under review leaves no ids; redirects are kept
    of accepted picks only. Where all go to review nothing changes; unless `idle`, such a batch is
    not reconciled and has no outcome."""
    releases = state.entities.where("entity_type = 'release'")
    due = C.without_source(releases, provider, limit).select(F.col("entity_id").alias("release_id"))
    by_ns = ["namespace", "owner_type", "owner_id"]
    held = state.external_ids.where("namespace = 'musicbrainz:release' and owner_type = 'release'").select(F.col("owner_id").alias("release_id"), F.col("value").alias("own"))
    wanted = D.checkpointed(picks.select("release_id", "requested", "resolved").join(due, "release_id").join(held, "release_id", "left"))
    moved = F.col("requested") != F.col("resolved")
    release = ("release", "musicbrainz:release", F.col("release_id"))
    first = D.checkpointed(C.anchor(_asking(wanted.where("own is null"), *release, F.col("requested")), state.external_ids, "musicbrainz_candidate_collision").where(~F.col("accepted")))
    wanted = wanted.join(first.select("release_id"), "release_id", "left_anti")
    second = D.checkpointed(C.anchor(_asking(wanted.where(moved), *release, F.col("resolved")), state.external_ids, "musicbrainz_redirect_collision").where(~F.col("accepted")))
    wanted = D.checkpointed(wanted.join(second.select("release_id"), "release_id", "left_anti").withColumn("value", F.when(moved, F.col("resolved")).otherwise(F.coalesce("own", "requested"))))
    # The set of a release takes the group's id, unless it has one or another set has it.
    sets = state.edges.where("kind = 'release_set_release'").select(F.col("src_id").alias("owner_id"), F.col("dst_id").alias("release_id"))
    groups = graph["release_set"].where("mbid is not null").select(F.col("release_mbid").alias("value"), F.col("mbid").alias("group"))
    named = state.external_ids.where("namespace = 'musicbrainz:release-group' and owner_type = 'release_set'").select("owner_id")
    nameless = wanted.select("release_id", F.col("resolved").alias("value")).join(groups, "value").join(sets, "release_id").join(named, "owner_id", "left_anti")
    set_anchors = D.checkpointed(C.anchor(_asking(nameless, "release_set", "musicbrainz:release-group", F.col("owner_id"), F.col("group")), state.external_ids, "musicbrainz_release_set_collision"))
    third = set_anchors.where(~F.col("accepted"))
    good = wanted.join(third.select("release_id"), "release_id", "left_anti").select("release_id", "value", F.lit("release").alias("owner_type"), F.col("release_id").alias("owner_id"), F.lit("musicbrainz:release").alias("namespace"))
    good = D.checkpointed(good)
    if not idle and good.isEmpty():
        none = good.select("release_id", F.concat(F.lit("release|"), "value").alias("claim_id"), "value")
        return Updates(None, none, first.unionByName(second).unionByName(third).select("release_id", "reason"))
    new_ids = X.insert_or_ignore(state.external_ids, good.select("namespace", "value", "owner_type", "owner_id", F.lit(provider).alias("provider")), ["namespace", "value", "owner_type"], ["owner_id"])
    # A release has one id of the namespace: what it was fetched by gives way to where that led.
    ids = state.external_ids.join(good.select(*by_ns), by_ns, "left_anti")
    same = state.external_ids.join(good.select(*by_ns, "value"), [*by_ns, "value"], "left_semi")
    ids = D.checkpointed(ids.unionByName(same).unionByName(new_ids))
    roots = good.select("release_id", F.concat(F.lit("release|"), "value").alias("claim_id"), "value")
    owner = R.by_external_id(roots.select("claim_id", F.lit("release").alias("entity_type"), F.lit(0).alias("pos"), F.lit("musicbrainz:release").alias("namespace"), "value"), ids)
    told = roots.join(owner.select("claim_id", F.col("entity_id").alias("target_id")), "claim_id", "left").withColumn("status", F.when(F.col("target_id").isNotNull(), "resolved").otherwise("new"))
    wrong = C.anchor_mismatch(roots.select("claim_id", "release_id"), told.select("claim_id", "status", "target_id"))
    accepted = D.checkpointed(roots.join(wrong.select("claim_id"), "claim_id", "left_anti"))
    mbids = accepted.select("value")
    only = lambda df, c: df.join(mbids, F.col(c) == F.col("value"), "left_semi")
    some = {"release": only(graph["release"], "mbid"), "release_set": only(graph["release_set"], "release_mbid"), "label": only(graph["label"], "release_mbid"), "track": only(graph["track"], "release_mbid")}
    # Parsed payloads feed many claims; they are written once instead of being parsed for each.
    some = {name: D.checkpointed(df) for name, df in some.items()}
    recordings = some["track"].select(F.col("recording_mbid").alias("owner")).distinct()
    by_set = only(graph["credit"].where("owner_type = 'release_set'"), "owner")
    some["credit"] = by_set.unionByName(graph["credit"].where("owner_type = 'recording'").join(recordings, "owner", "left_semi"))
    some["credit"] = D.checkpointed(some["credit"])
    if "artist" in graph:
        some["artist"] = D.checkpointed(graph["artist"].join(some["credit"].select(F.col("artist_mbid").alias("mbid")).distinct(), "mbid", "left_semi"))
    own = ["owner_type", "owner_id", "namespace"]
    taken = set_anchors.where("accepted").join(accepted.select("release_id"), "release_id", "left_semi")
    free = M.first_of(taken.select(*own, "value", "release_id"), own, ["release_id"])
    ids = D.checkpointed(ids.unionByName(free.select("namespace", "value", "owner_type", "owner_id", F.lit(provider).alias("provider"))))
    moved = picks.where("requested <> resolved").join(accepted.select("release_id"), "release_id", "left_semi").select(F.lit("musicbrainz:release").alias("namespace"), F.col("requested").alias("source_value"), F.col("resolved").alias("target_value"))
    base = replace(state, external_ids=ids).grown("redirects", X.upsert_redirects(state.redirects, moved), put=moved, by=("namespace", "source_value"))
    claims, rels = release_claims(some)
    out = reconcile(D.checkpointed(claims), D.checkpointed(rels), base)
    review = first.unionByName(second).unionByName(third).select("release_id", "reason").unionByName(wrong.select("release_id", "reason"))
    return Updates(out, accepted, review)
