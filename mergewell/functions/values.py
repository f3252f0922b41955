"""Scalar functions over typed values: dates, durations, identifiers, vocabularies, credits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from mergewell.functions.text import blank_to_null

DURATION_BUCKET_MS = 2000

# Role priorities of credits, best first. A missing role comes after all of them.
ROLE_PRIORITY = {
    "primary": 0,
    "featured": 1,
    "producer": 2,
    "composer": 3,
    "conductor": 4,
    "unknown": 10,
}
NO_ROLE_PRIORITY, NO_CREDIT_ORDER = 11, 10_000

# Vocabularies of the metadata payloads. Names outside them map as noted.
RELEASE_STATUS = ("official", "promotion", "bootleg", "pseudo-release", "withdrawn", "expunged", "cancelled")
RELEASE_PACKAGING = ("none", "jewel case", "digipak", "gatefold cover", "cardboard/paper sleeve", "other")
ARTIST_KINDS = ("person", "group", "orchestra", "choir", "other")
AREA_TYPES = ("country", "subdivision", "city", "district", "island", "county", "municipality", "region", "province", "state", "other")
AREA_ROLES = ("primary", "begin", "end")
SET_TYPES = ("album", "single", "ep", "broadcast", "other")
SECONDARY_TYPES = ("compilation", "soundtrack", "spokenword", "interview", "audiobook", "audio drama", "live", "remix", "dj-mix", "mixtape", "demo", "field recording")
ENTITY_TYPES = ("artist", "release_set", "release", "recording", "label", "release_track", "release_set_contribution", "recording_contribution", "user", "play_event", "library_item")
# Namespaces of external ids and the provider that stands behind each.
NAMESPACES = {
    "musicbrainz:artist": "musicbrainz",
    "musicbrainz:release-group": "musicbrainz",
    "musicbrainz:release": "musicbrainz",
    "musicbrainz:recording": "musicbrainz",
    "musicbrainz:label": "musicbrainz",
    "spotify:artist": "spotify",
    "spotify:album": "spotify",
    "spotify:track": "spotify",
    "lastfm:artist": "lastfm",
    "lastfm:recording": "lastfm",
    "recording:isrc": "musicbrainz",
    "release:ean": "spotify",
    "release:upc": "spotify",
    "label:catalog_number": "musicbrainz",
    "label:barcode": "musicbrainz",
    "spotify:user": "spotify",
    "lastfm:user": "lastfm",
}


def duration_bucket(ms: Column, bucket_ms: int = DURATION_BUCKET_MS) -> Column:
    """Floor of ms / bucket; floor also below zero."""
    return F.floor(ms / F.lit(bucket_ms)).cast("long")


def partial_date(text: Column) -> Column:
    """struct(year, month, day) of YYYY[-MM[-DD]]; null without a year, bad parts are null."""
    parts = F.split(F.btrim(text), "-")
    whole = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    return F.when(whole(0).isNotNull(), F.struct(whole(0).alias("year"), whole(1).alias("month"), whole(2).alias("day")))


def as_date(date: Column) -> Column:
    """First day of a partial date: a missing or zero month or day is 1."""
    one = lambda c: F.coalesce(F.nullif(c, F.lit(0)), F.lit(1))
    return F.make_date(date["year"], one(date["month"]), one(date["day"]))


def netloc(url: Column) -> Column:
    """Authority of a URL, with user and port."""
    return F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)


def url_namespace(kind: Column, url: Column) -> Column:
    return F.concat(F.lit("url:"), F.replace(kind, F.lit(" "), F.lit("-")), F.lit(":"), netloc(url))


def barcode_namespace(code: Column) -> Column:
    """upc for 12 digits, ean for 13, else a plain barcode; null for blank."""
    trimmed = blank_to_null(code)
    return F.when(trimmed.rlike(r"^\p{Nd}{12}$"), "release:upc").when(trimmed.rlike(r"^\p{Nd}{13}$"), "release:ean").when(trimmed.isNotNull(), "release:barcode")


def from_vocabulary(value: Column, names: tuple[str, ...], default: str | None = None) -> Column:
    """The lower-cased value if the vocabulary has it, else the default; null stays null."""
    known = F.lower(F.btrim(value))
    return F.when(value.isNull(), None).when(known.isin(*names), known).otherwise(F.lit(default))


def credit_role(position: Column, previous_join: Column) -> Column:
    """First credit is primary; one joined by feat or ft. is featured; else unknown."""
    joined = F.lower(previous_join)
    return F.when(position == 0, "primary").when(joined.contains("feat") | joined.contains("ft."), "featured").otherwise("unknown")


def role_priority(role: Column) -> Column:
    out = F.lit(NO_ROLE_PRIORITY)
    for name, rank in ROLE_PRIORITY.items():
        out = F.when(role == name, rank).otherwise(out)
    return out


def credited_as(name: Column, artist_name: Column) -> Column:
    return F.when((name != "") & (name != artist_name), name)


def provider_for(namespace: Column) -> Column:
    """Provider behind a namespace, null for namespaces of one's own."""
    return F.create_map(*[F.lit(x) for pair in NAMESPACES.items() for x in pair])[namespace]


def resolved_id(entity_id: Column, canonical_id: Column) -> Column:
    return F.coalesce(canonical_id, entity_id)


def primary_source(sources: Column) -> Column:
    """Alphabetically first source."""
    return F.try_element_at(F.array_sort(sources), F.lit(1))


def track_count(explicit: Column, media: Column) -> Column:
    """Explicit count, else the sum of the media's counts, else null."""
    total = F.aggregate(F.filter(media, lambda c: c > 0), F.lit(0), lambda a, c: a + c)
    return F.coalesce(explicit, F.nullif(total, F.lit(0)))


def media_formats(formats: Column) -> Column:
    return F.array_distinct(F.filter(formats, lambda f: f.isNotNull() & (f != "")))


def utc(value: dt.datetime) -> dt.datetime:
    """Naive times are UTC."""
    return value.replace(tzinfo=dt.UTC) if value.tzinfo is None else value.astimezone(dt.UTC)


def iso_time(text: Column) -> Column:
    """Timestamp of an ISO 8601 text, with an offset or `Z`; without one it is UTC whatever the
    time zone of the session. Null for what doesn't parse."""
    return F.when(F.btrim(text).rlike(r"(?:[Zz]|[+-][0-9]{2}:?[0-9]{2})$"), F.btrim(text)).otherwise(F.concat(F.btrim(text), F.lit("Z"))).try_cast("timestamp")


def epoch_seconds(time: Column) -> Column:
    """Whole seconds since 1970 in UTC, cut down."""
    return F.unix_seconds(time)


def parse_iso(text: str) -> dt.datetime:
    return utc(dt.datetime.fromisoformat(text.replace("Z", "+00:00")))


def time_window(start: dt.datetime | None, end: dt.datetime | None, lookback_hours: float | None, now: dt.datetime | None = None) -> tuple[dt.datetime | None, dt.datetime | None]:
    """Bounds of a run: a lookback counts from the end (now, if none is given) and never
    reaches behind an explicit start."""
    start, end = (utc(x) if x else None for x in (start, end))
    if lookback_hours is not None:
        if lookback_hours < 0:
            raise ValueError("lookback must not be negative")
        end = end or utc(now or dt.datetime.now(dt.UTC))
        back = end - dt.timedelta(hours=lookback_hours)
        start = max(start, back) if start else back
    if start and end and start > end:
        raise ValueError("start is after end")
    return start, end
