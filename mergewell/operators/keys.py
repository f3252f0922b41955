"""Match keys: what makes two claims the same entity, in order of strength.

A key is a JSON array of its kind and components, e.g. ["artist:name","rem"]; nested identities
are nested arrays. Keys with a null or empty component are left out. Every function takes and
returns Columns, so keys are one projection over the entity frame and one posexplode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergewell.functions import values as V

IDS = "array<struct<namespace:string,value:string>>"


def text_part(value: Column) -> Column:
    """A quoted string component; null if absent."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(value, r'(["\\])', r"\\$1"), F.lit('"'))
    return F.when(value != "", quoted)


def raw_part(value: Column) -> Column:
    """An integer or an inner key, as it is."""
    return value.cast("string")


def key(kind: str, *parts: Column) -> Column:
    """A key, null if any component is; parts are made by text_part or raw_part."""
    pieces: list[Column] = [F.lit(f'["{kind}"')]
    for p in parts:
        pieces += [F.lit(","), p]
    return F.concat(*pieces, F.lit("]"))


def complete(keys: list[Column] | Column) -> Column:
    """Keys that are whole, each once, first place kept."""
    every = F.array(*keys) if isinstance(keys, list) else keys
    return F.array_distinct(F.filter(every, lambda k: k.isNotNull()))


def external_id_keys(kind: str, ids: Column) -> Column:
    """One key for each external id, by namespace and value."""
    ordered = F.array_sort(F.coalesce(ids.cast(IDS), F.array().cast(IDS)))
    return F.transform(ordered, lambda x: key(f"{kind}:external_id", text_part(x["namespace"]), text_part(x["value"])))


def id_value(ids: Column, namespace: str) -> Column:
    """First value in a namespace."""
    return F.get(F.filter(ids, lambda x: x["namespace"] == namespace), F.lit(0))["value"]


def _after_ids(kind: str, ids: Column, rest: list[Column]) -> Column:
    return complete(F.concat(external_id_keys(kind, ids), F.array(*rest)))


def artist_keys(name: Column, sources: Column, ids: Column) -> Column:
    """`name` is normalized."""
    return _after_ids("artist", ids, [
        key("artist:mbid", text_part(id_value(ids, "musicbrainz:artist"))),
        key("artist:source-name", text_part(V.primary_source(sources)), text_part(name)),
        key("artist:name", text_part(name)),
    ])


def label_keys(name: Column, sources: Column, ids: Column) -> Column:
    return _after_ids("label", ids, [
        key("label:mbid", text_part(id_value(ids, "musicbrainz:label"))),
        key("label:source-name", text_part(V.primary_source(sources)), text_part(name)),
        key("label:name", text_part(name)),
    ])


def _titled(kind: str, title: Column, artist: Column, sources: Column, identified: Column) -> list[Column]:
    """Title keys: with the artist if there is one, else by source if nothing identifies it."""
    source = text_part(V.primary_source(sources))
    return [
        key(f"{kind}:source-artist-title", source, text_part(artist), text_part(title)),
        key(f"{kind}:artist-title", text_part(artist), text_part(title)),
        F.when(artist.isNull() & ~identified, key(f"{kind}:source-title", source, text_part(title))),
    ]


def release_set_keys(title: Column, artist: Column, sources: Column, ids: Column, child_ids: Column) -> Column:
    """`child_ids` are the external ids of the set's releases."""
    children = F.array_sort(F.array_distinct(F.coalesce(child_ids.cast(IDS), F.array().cast(IDS))))
    child_keys = F.transform(children, lambda x: key("release_set:child_release_external_id", text_part(x["namespace"]), text_part(x["value"])))
    identified = (F.coalesce(F.size(ids), F.lit(0)) > 0) | (F.size(children) > 0)
    rest = [key("release_set:mbid", text_part(id_value(ids, "musicbrainz:release-group"))), *_titled("release_set", title, artist, sources, identified)]
    return complete(F.concat(external_id_keys("release_set", ids), child_keys, F.array(*rest)))


def release_keys(title: Column, artist: Column, sources: Column, ids: Column) -> Column:
    identified = F.coalesce(F.size(ids), F.lit(0)) > 0
    return _after_ids("release", ids, [key("release:mbid", text_part(id_value(ids, "musicbrainz:release"))), *_titled("release", title, artist, sources, identified)])


def recording_keys(title: Column, artist: Column, duration_ms: Column, sources: Column, ids: Column, bucket_ms: int = V.DURATION_BUCKET_MS) -> Column:
    """No key of the title alone: without an artist or an id a recording has no key."""
    a, t = text_part(artist), text_part(title)
    return _after_ids("recording", ids, [
        key("recording:mbid", text_part(id_value(ids, "musicbrainz:recording"))),
        key("recording:artist-title-duration", a, t, raw_part(V.duration_bucket(duration_ms, bucket_ms))),
        key("recording:source-artist-title", text_part(V.primary_source(sources)), a, t),
        key("recording:artist-title", a, t),
    ])


def user_keys(lastfm: Column, spotify: Column, email: Column, display_name: Column) -> Column:
    return complete([
        key("user:lastfm", text_part(lastfm)),
        key("user:spotify", text_part(spotify)),
        key("user:email", text_part(email)),
        key("user:display_name", text_part(display_name)),
    ])


def play_event_keys(user: Column, recording: Column, track: Column, source: Column, played_at: Column) -> Column:
    """user, recording and track are identity keys; played_at is text."""
    at = text_part(played_at)
    return complete([
        key("play_event:user-source-played_at", raw_part(user), text_part(source), at),
        key("play_event:recording-played_at", raw_part(recording), at),
        key("play_event:track-played_at", raw_part(track), at),
    ])


def library_item_keys(user: Column, source: Column, target_type: Column, target: Column) -> Column:
    return complete([
        key("library_item:user-target", raw_part(user), text_part(target_type), raw_part(target)),
        key("library_item:user-source-target", raw_part(user), text_part(source), text_part(target_type), raw_part(target)),
    ])


def library_target(target_key: Column, target_type: Column, target_id: Column) -> Column:
    """Identity of a saved target: its own key if known, else its reference."""
    return F.coalesce(target_key, key("library_item:target", text_part(target_type), text_part(target_id)))


def release_track_keys(release: Column, recording: Column, disc: Column, track: Column) -> Column:
    return complete([
        key("release_track:release-recording", raw_part(release), raw_part(recording)),
        key("release_track:release-position", raw_part(release), raw_part(disc), raw_part(track)),
    ])


def contribution_keys(kind: str, owner: Column, artist: Column, role: Column, credit_order: Column) -> Column:
    """kind is release_set or recording."""
    return complete([
        key(f"{kind}_contribution:{kind}-artist-role", raw_part(owner), raw_part(artist), text_part(F.coalesce(role, F.lit("unknown")))),
        key(f"{kind}_contribution:{kind}-artist-credit_order", raw_part(owner), raw_part(artist), raw_part(F.coalesce(credit_order, F.lit(-1)))),
    ])


def identity_key(keys: Column) -> Column:
    """The first key that is not tied to a source, else the first."""
    free = F.filter(keys, lambda k: ~F.substring_index(k, '"', 2).contains(":source-"))
    return F.coalesce(F.get(free, F.lit(0)), F.get(keys, F.lit(0)))


def relationship_key(kind: Column, source: Column, target: Column, payload: list[Column]) -> Column:
    """Identity of an edge with its payload; absent payload parts are null in it."""
    parts = [F.coalesce(p, F.lit("null")) for p in payload]
    return key("relationship", text_part(kind), text_part(source), text_part(target), *parts)


def track_payload(disc: Column, number: Column, title_override: Column, duration_ms: Column) -> list[Column]:
    """title_override is normalized."""
    return [raw_part(F.coalesce(disc, F.lit(-1))), raw_part(F.coalesce(number, F.lit(-1))), text_part(title_override), raw_part(duration_ms)]


def credit_payload(role: Column, credit_order: Column, credited: Column, join_phrase: Column) -> list[Column]:
    """credited and join_phrase are normalized."""
    return [text_part(F.coalesce(role, F.lit("unknown"))), raw_part(F.coalesce(credit_order, F.lit(-1))), text_part(credited), text_part(join_phrase)]


def primary_artist(credits: DataFrame, owner: str) -> DataFrame:
    """(owner, artist): the normalized name that leads each owner's credits. Columns: owner,
    role, credit_order, ord, artist_name (normalized). One shuffle on the owner; names are
    reduced before it moves."""
    rank = F.struct(V.role_priority(F.col("role")).alias("p"), F.coalesce("credit_order", F.lit(V.NO_CREDIT_ORDER)).alias("o"), F.col("ord").alias("n"))
    named = credits.where(F.coalesce("artist_name", F.lit("")) != "")
    return named.groupBy(owner).agg(F.min_by("artist_name", rank).alias("artist"))


def explode_keys(claims: DataFrame, keys: Column) -> DataFrame:
    """Long frame: claim_id, claim_ord, entity_type, key_ord, key."""
    return claims.select("claim_id", "claim_ord", "entity_type", F.posexplode(keys).alias("key_ord", "key"))


def without_keys(claims: DataFrame, keys: DataFrame) -> DataFrame:
    """Claims to warn about: nothing can match them."""
    return claims.join(keys.select("claim_id").distinct(), "claim_id", "left_anti")


def first_in_window(rows: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """First row of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
