"""Payload rows to claims: entity claims, relationship claims and their order.

One claim stands for all rows with the same payload, placed at the first of them; repeated
payloads would fall to deduplication anyway. Claim ids are hashes of the payload, so a run can
be repeated. claim_ord is a struct (place of the row, place within the row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergewell.functions import values as V

IDS = "array<struct<namespace:string,value:string>>"
_PAYLOAD = ["artist", "artist_mbid", "artist_url", "album", "release_mbid", "title", "recording_mbid", "recording_url"]


def external_ids(*pairs: tuple[str, Column]) -> Column:
    """Ids that have a value, the first of each namespace."""
    every = F.array(*[F.struct(F.lit(ns).alias("namespace"), v.cast("string").alias("value")) for ns, v in pairs])
    return F.filter(every, lambda x: x["value"].isNotNull() & (x["value"] != "")).cast(IDS)


def payload_id(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def scrobble_claims(rows: DataFrame, source: str = "lastfm") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims, rels, events): artist, release set, release and recording of every scrobble, the
    recording's primary credit, the track without a position and the set's link to its release.
    The credit is on the recording alone. Events name the claims they refer to."""
    rows = rows.withColumn("pid", payload_id(_PAYLOAD))
    firsts = rows.groupBy("pid", *_PAYLOAD).agg(F.min("ord").alias("ord"))
    id_of = lambda kind: F.concat(F.lit(f"{kind}|"), F.col("pid"))

    def claim(kind: str, place: int, name: str, ids: Column) -> Column:
        child = external_ids(("musicbrainz:release", F.col("release_mbid"))) if kind == "release_set" else F.array().cast(IDS)
        artist = F.col("artist") if kind == "recording" else F.lit(None).cast("string")
        return F.struct(
            id_of(kind).alias("claim_id"), F.struct(F.col("ord"), F.lit(place).alias("place")).alias("claim_ord"), F.lit(kind).alias("entity_type"), F.lit(kind == "recording").alias("is_root"),
            F.col(name).alias("name"), artist.alias("artist"), F.lit(None).cast("long").alias("duration_ms"), F.array(F.lit(source)).alias("sources"), ids.alias("ids"), child.alias("child_ids"), F.lit(None).cast("double").alias("confidence"),
        )

    made = F.array(
        claim("recording", 0, "title", external_ids(("musicbrainz:recording", F.col("recording_mbid")), ("lastfm:recording", F.col("recording_url")))),
        claim("artist", 1, "artist", external_ids(("musicbrainz:artist", F.col("artist_mbid")), ("lastfm:artist", F.col("artist_url")))),
        claim("release", 2, "album", external_ids(("musicbrainz:release", F.col("release_mbid")))),
        claim("release_set", 3, "album", F.array().cast(IDS)),
    )
    claims = firsts.select(F.explode(made).alias("c")).select("c.*")

    def rel(kind: str, place: int, src: str, dst: str, role: str | None) -> Column:
        return F.struct(F.concat(F.lit(f"{kind}|"), F.col("pid")).alias("rel_id"), F.struct(F.col("ord"), F.lit(place).alias("place")).alias("rel_ord"), F.lit(kind).alias("kind"), id_of(src).alias("src_claim_id"), id_of(dst).alias("dst_claim_id"), F.lit(role).cast("string").alias("role"), F.lit(None).cast("int").alias("credit_order"), F.lit(None).cast("int").alias("disc_number"), F.lit(None).cast("int").alias("track_number"))

    made = F.array(rel("recording_contribution", 0, "recording", "artist", "primary"), rel("release_track", 1, "release", "recording", None), rel("release_set_release", 2, "release_set", "release", None))
    rels = firsts.select(F.explode(made).alias("r")).select("r.*")
    events = rows.where(~F.col("now_playing")).select("user_id", F.lit(source).alias("source"), "played_at", "ord", id_of("recording").alias("recording_claim_id"), F.concat(F.lit("release_track|"), F.col("pid")).alias("track_claim_id"))
    return claims, rels, events


def library_claims(rows: DataFrame, source: str = "spotify") -> tuple[DataFrame, DataFrame]:
    """(credits, targets) of saved items: every artist credits both the set and the recording of a
    saved track, the first as primary, the rest as unknown, without an order."""
    role = F.when(F.col("pos") == 0, "primary").otherwise("unknown")
    base = rows.select("branch", "ord", "target_type", "id", "name", "duration_ms", "ids", "album", F.posexplode_outer("credits").alias("pos", "credit"))
    owners = F.when(F.col("target_type") == "recording", F.array(F.lit("recording"), F.lit("release_set"))).otherwise(F.array(F.lit("release_set")))
    credits = base.where("credit is not null").select("branch", "ord", F.explode(owners).alias("owner_type"), F.col("credit.id").alias("artist_id"), F.col("credit.name").alias("artist_name"), "pos", role.alias("role"))
    own = F.when(F.col("target_type") == "recording", "spotify:track").when(F.col("target_type") == "release_set", "spotify:album").otherwise("spotify:artist")
    codes = {"isrc": "recording:isrc", "ean": "release:ean", "upc": "release:upc"}
    names = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    more = F.filter(F.transform("ids", lambda x: F.struct(names[x["namespace"]].alias("namespace"), x["value"].alias("value"))), lambda x: x["namespace"].isNotNull())
    targets = rows.select("branch", "ord", "target_type", "id", "name", "duration_ms", "album", F.array(F.lit(source)).alias("sources"), F.concat(F.array(F.struct(own.alias("namespace"), F.col("id").alias("value"))), more).cast(IDS).alias("external_ids"))
    return credits, targets


def url_ids(relations: Column) -> Column:
    """Relations with a URL as external ids; the namespace names the relation and the host."""
    held = F.filter(F.coalesce(relations, F.array().cast("array<struct<type:string,url:struct<id:string,resource:string>>>")), lambda r: r["url"]["resource"].isNotNull())
    return F.transform(held, lambda r: F.struct(V.url_namespace(r["type"], r["url"]["resource"]).alias("namespace"), r["url"]["resource"].alias("value"))).cast(IDS)


def artist_entity(a: Column) -> Column:
    """Artist of a credit: kind, life span, areas by role, aliases and ids (one a namespace, the
    first IPI and ISNI of several)."""
    area = lambda x, role: F.when(x["name"].isNotNull(), F.struct(x["name"].alias("name"), V.from_vocabulary(x["type"], V.AREA_TYPES, "other").alias("area_type"), F.lit(role).alias("role"), x["iso-3166-1-codes"].alias("country_codes")))
    life = F.when(a["life-span"].isNotNull(), F.struct(V.partial_date(a["life-span"]["begin"]).alias("begin"), V.partial_date(a["life-span"]["end"]).alias("end"), a["life-span"]["ended"].alias("ended")))
    ids = F.concat(external_ids(("musicbrainz:artist", a["id"]), ("artist:ipi", F.get(a["ipis"], F.lit(0))), ("artist:isni", F.get(a["isnis"], F.lit(0)))), url_ids(a["relations"]))
    return F.struct(
        a["id"].alias("mbid"), a["name"].alias("name"), a["sort-name"].alias("sort_name"), a["country"].alias("country"), V.from_vocabulary(a["type"], V.ARTIST_KINDS).alias("kind"), life.alias("life_span"),
        F.array_compact(F.array(area(a["area"], "primary"), area(a["begin-area"], "begin"), area(a["end-area"], "end"))).alias("areas"), F.transform(a["aliases"], lambda x: x["name"]).alias("aliases"), ids.alias("ids"),
    )


def release_graph(releases: DataFrame) -> dict[str, DataFrame]:
    """Metadata releases (as payloads.METADATA_RELEASE) to frames: release, release_set, label,
    credit (of the set and of each track's recording) and track."""
    title = F.coalesce(F.col("`release-group`.title"), F.col("title"))
    release = releases.select(
        F.col("id").alias("mbid"), "title", V.partial_date(F.col("date")).alias("release_date"), "country", V.from_vocabulary(F.col("status"), V.RELEASE_STATUS).alias("status"),
        V.from_vocabulary(F.col("packaging"), V.RELEASE_PACKAGING, "other").alias("packaging"), V.media_formats(F.transform("media", lambda m: m["format"])).alias("formats"), F.size("media").alias("medium_count"),
        V.track_count(F.col("`track-count`"), F.transform("media", lambda m: m["track-count"])).alias("track_count"), V.barcode_namespace(F.col("barcode")).alias("barcode_namespace"), F.btrim("barcode").alias("barcode"),
    )
    sets = releases.select(
        F.col("id").alias("release_mbid"), F.col("`release-group`.id").alias("mbid"), title.alias("title"), V.from_vocabulary(F.col("`release-group`.`primary-type`"), V.SET_TYPES, "other").alias("primary_type"),
        F.filter(F.transform("`release-group`.`secondary-types`", lambda s: V.from_vocabulary(s, V.SECONDARY_TYPES)), lambda s: s.isNotNull()).alias("secondary_types"), V.partial_date(F.col("`release-group`.`first-release-date`")).alias("first_release"),
        F.transform("`release-group`.aliases", lambda a: a["name"]).alias("aliases"),
    )
    labels = releases.select(F.col("id").alias("release_mbid"), F.posexplode("label-info").alias("pos", "l")).select("release_mbid", "pos", F.col("l.label.id").alias("mbid"), F.coalesce("l.label.name", "l.label.id").alias("name")).where("name is not null")
    tracks = releases.select(F.col("id").alias("release_mbid"), F.col("artist-credit").alias("rc"), F.explode("media").alias("m")).select("release_mbid", "rc", F.col("m.position").alias("disc"), F.explode("m.tracks").alias("t")).where("t.recording is not null")
    track = tracks.select("release_mbid", F.col("disc").alias("disc_number"), F.col("t.position").alias("track_number"), F.col("t.recording.id").alias("recording_mbid"), F.col("t.recording.title").alias("recording_title"), F.when(F.col("t.title") != F.col("t.recording.title"), F.col("t.title")).alias("title_override"), F.col("t.length").alias("duration_ms"))
    some = lambda a, b: F.when(F.coalesce(F.size(a), F.lit(0)) > 0, a).otherwise(b)

    def credits(df: DataFrame, owner_type: str, owner: Column, listed: Column) -> DataFrame:
        one = df.select(F.lit(owner_type).alias("owner_type"), owner.alias("owner"), listed.alias("cs")).select("owner_type", "owner", F.posexplode("cs").alias("pos", "c"), "cs")
        previous = F.get("cs", F.col("pos") - 1)["joinphrase"]
        return one.select("owner_type", "owner", F.col("pos").alias("credit_order"), F.col("c.artist.id").alias("artist_mbid"), F.col("c.artist.name").alias("artist_name"), V.credit_role(F.col("pos"), F.when(F.col("pos") > 0, previous)).alias("role"), V.credited_as(F.col("c.name"), F.col("c.artist.name")).alias("credited_as"), F.col("c.joinphrase").alias("join_phrase"))

    set_credits = credits(releases, "release_set", F.col("id"), some(F.col("`release-group`.`artist-credit`"), F.col("artist-credit")))
    track_credits = credits(tracks, "recording", F.col("t.recording.id"), some(F.col("t.artist-credit"), F.col("rc")))
    every = releases.select(F.explode(F.concat(*[F.coalesce(F.transform(c, lambda x: x["artist"]), F.array().cast(releases.select(F.transform("artist-credit", lambda x: x["artist"]).alias("a")).schema["a"].dataType)) for c in (F.col("artist-credit"), F.col("`release-group`.`artist-credit`"))])).alias("a")).unionByName(tracks.select(F.explode(F.transform("t.artist-credit", lambda x: x["artist"])).alias("a")))
    artist = every.select(artist_entity(F.col("a")).alias("x")).select("x.*").dropDuplicates(["mbid"])
    return {"artist": artist, "release": release, "release_set": sets, "label": labels, "track": track, "credit": set_credits.unionByName(track_credits)}
