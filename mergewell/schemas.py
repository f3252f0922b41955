"""Schemas of the stored tables. Adding a column is enough to evolve one: older versions read null."""

from __future__ import annotations

_DATE = "struct<year:int,month:int,day:int>"
_AREAS = "array<struct<name:string,area_type:string,role:string,country_codes:array<string>>>"

TABLES = {
    "artist": f"id string, canonical_id string, name string, sort_name string, country string, kind string, life_span struct<begin:{_DATE},`end`:{_DATE},ended:boolean>, areas {_AREAS}, aliases array<string>, formed_year int, disbanded_year int",
    "label": "id string, canonical_id string, name string, country string",
    "release_set": f"id string, canonical_id string, title string, primary_type string, secondary_types array<string>, aliases array<string>, first_release {_DATE}",
    "release": f"id string, canonical_id string, title string, release_set_id string, release_date {_DATE}, country string, status string, packaging string, format string, medium_count int",
    "release_label": "release_id string, label_id string",
    "release_set_contribution": "id string, release_set_id string, artist_id string, role string, credit_order int, credited_as string, join_phrase string",
    "recording": "id string, canonical_id string, title string, duration_ms int, version string, disambiguation string, aliases array<string>",
    "recording_contribution": "id string, recording_id string, artist_id string, role string, credit_order int, credited_as string, join_phrase string",
    "release_track": "id string, release_id string, recording_id string, disc_number int, track_number int, title_override string, duration_ms int",
    "user_account": "id string, display_name string, email string, spotify_user_id string, lastfm_user string",
    "library_item": "id string, user_id string, target_type string, target_id string, source string, saved_at timestamp",
    "play_event": "id string, user_id string, played_at timestamp, source string, track_id string, recording_id string, duration_ms int",
    "entity_merge": "entity_type string, source_id string, target_id string, reason string, created_at timestamp, created_by string",
    "external_id": "id string, namespace string, value string, owner_type string, owner_id string, provider string, created_at timestamp",
    "external_id_redirect": "id string, namespace string, source_value string, target_value string, provider string, created_at timestamp",
    "provenance": "id string, owner_type string, owner_id string, sources array<string>",
    "normalization_sidecar": "id string, entity_type string, entity_id string, key string",
}

#: What is known of an entity beside its name, duration and sources; null where its type has no such fact.
FACT_TYPES = {
    "sort_name": "string", "country": "string", "kind": "string", "life_span": f"struct<begin:{_DATE},`end`:{_DATE},ended:boolean>", "areas": _AREAS, "aliases": "array<string>", "formed_year": "int", "disbanded_year": "int",
    "primary_type": "string", "secondary_types": "array<string>", "first_release": _DATE, "release_date": _DATE, "status": "string", "packaging": "string", "format": "string", "medium_count": "int", "version": "string", "disambiguation": "string",
}
FACTS = f"struct<{','.join(f'{k}:{v}' for k, v in FACT_TYPES.items())}>"
#: What an edge says beside its ends.
PAYLOAD_TYPES = {"role": "string", "credit_order": "int", "disc_number": "int", "track_number": "int", "credited_as": "string", "join_phrase": "string", "title_override": "string", "duration_ms": "long"}
PAYLOAD = list(PAYLOAD_TYPES)
#: Edges without a payload, and the types of the ends of all kinds.
LINKS = ("release_set_release", "release_label")
ENDS = {
    "recording_contribution": ("recording", "artist"), "release_set_contribution": ("release_set", "artist"), "release_track": ("release", "recording"),
    "release_set_release": ("release_set", "release"), "release_label": ("release", "label"),
}

#: The engine's working frames: one row an entity of any type, and one an edge of any kind.
ENTITY = "entity_id string, entity_type string, name string, duration_ms long, sources array<string>"
EDGE = "edge_id string, kind string, src_id string, dst_id string, role string, credit_order int, disc_number int, track_number int"
#: The same as they are stored, with all facts and whole payloads.
FULL_ENTITY = f"{ENTITY}, facts {FACTS}"
FULL_EDGE = f"{EDGE}, credited_as string, join_phrase string, title_override string, duration_ms long"
EXTERNAL_ID = "namespace string, value string, owner_type string, owner_id string, provider string"
REDIRECT = "namespace string, source_value string, target_value string"
SIDECAR = "entity_type string, key string, entity_id string"
LIBRARY_ITEM = "user_id string, target_type string, target_id string, source string"
WATERMARK = "user_id string, source string, latest timestamp"
LATE_EVENT = "user_id string, source string, played_at timestamp, recording_claim_id string"
PLAY_EVENT = "user_id string, source string, played_at timestamp, recording_id string, track_id string"
