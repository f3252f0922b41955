"""Provider payloads: explicit schemas and readers of landed JSON.

Pages are landed as JSON lines, one response a line, and read with the schemas below; nothing
is inferred. Landing raw pages is what a response cache would be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCROBBLE_PAGE = """recenttracks struct<
 track:array<struct<artist:struct<`#text`:string,name:string,mbid:string,url:string>,mbid:string,
  album:struct<mbid:string,`#text`:string>,name:string,url:string,date:struct<uts:string,`#text`:string>,`@attr`:struct<nowplaying:string>>>,
 `@attr`:struct<user:string,page:string,perPage:string,total:string,totalPages:string>>, error int, message string"""
_ARTISTS = "array<struct<id:string,name:string>>"
_ALBUM = f"struct<id:string,name:string,release_date:string,artists:{_ARTISTS},external_ids:map<string,string>>"
SAVED_TRACKS = f"items array<struct<added_at:timestamp,track:struct<id:string,name:string,duration_ms:int,artists:{_ARTISTS},external_ids:map<string,string>,album:{_ALBUM}>>>, offset int, total int, next string"
SAVED_ALBUMS = f"items array<struct<added_at:timestamp,album:{_ALBUM}>>, offset int, total int, next string"
FOLLOWED_ARTISTS = f"artists struct<items:{_ARTISTS},cursors:struct<after:string,before:string>,next:string,total:int>"
_RELATIONS = "array<struct<type:string,url:struct<id:string,resource:string>>>"
_AREA = "struct<name:string,type:string,`iso-3166-1-codes`:array<string>>"
_MB_ARTIST = f"struct<id:string,name:string,`sort-name`:string,country:string,type:string,area:{_AREA},`begin-area`:{_AREA},`end-area`:{_AREA},`life-span`:struct<begin:string,end:string,ended:boolean>,aliases:array<struct<name:string>>,ipis:array<string>,isnis:array<string>,relations:{_RELATIONS}>"
_CREDITS = f"array<struct<name:string,joinphrase:string,artist:{_MB_ARTIST}>>"
METADATA_RELEASE = f"""id string, title string, status string, country string, date string, barcode string, packaging string, `track-count` int,
 `artist-credit` {_CREDITS},
 `release-group` struct<id:string,title:string,`primary-type`:string,`secondary-types`:array<string>,`first-release-date`:string,`artist-credit`:{_CREDITS},aliases:array<struct<name:string>>,relations:{_RELATIONS}>,
 `label-info` array<struct<`catalog-number`:string,label:struct<id:string,name:string,relations:{_RELATIONS}>>>,
 media array<struct<position:int,format:string,`track-count`:int,tracks:array<struct<id:string,position:int,title:string,length:int,`artist-credit`:{_CREDITS},recording:struct<id:string,title:string,length:int,disambiguation:string>>>>>,
 relations {_RELATIONS}"""


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed responses; a line that doesn't parse fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scrobbles(pages: DataFrame) -> DataFrame:
    """One row a scrobble in page order: ord, user, artist, album, title, ids, urls, played_at,
    now_playing. Error responses stop the read."""
    ok = pages.select(F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("scrobble page error: "), F.coalesce("message", F.lit(""))))).otherwise(F.col("recenttracks")).alias("p"))
    rows = ok.select(F.col("p.`@attr`.user").alias("user"), F.col("p.`@attr`.page").cast("int").alias("page"), F.posexplode("p.track").alias("pos", "t"))
    blank = lambda c: F.nullif(F.btrim(c), F.lit(""))
    playing = F.coalesce(F.col("t.`@attr`.nowplaying") == "true", F.lit(False))
    dated = F.timestamp_seconds(F.col("t.date.uts").cast("long"))
    return rows.select(
        F.struct("page", "pos").alias("ord"), "user", F.coalesce(F.col("t.artist.name"), F.col("t.artist.`#text`")).alias("artist"), blank(F.col("t.artist.mbid")).alias("artist_mbid"), blank(F.col("t.artist.url")).alias("artist_url"),
        F.coalesce(F.nullif(F.col("t.album.`#text`"), F.lit("")), F.col("t.name")).alias("album"), blank(F.col("t.album.mbid")).alias("release_mbid"),
        F.col("t.name").alias("title"), blank(F.col("t.mbid")).alias("recording_mbid"), blank(F.col("t.url")).alias("recording_url"), playing.alias("now_playing"),
        F.when(dated.isNull() & ~playing, F.raise_error(F.lit("a scrobble has neither a date nor plays now"))).otherwise(dated).alias("played_at"),
    )


def library(tracks: DataFrame, albums: DataFrame, artists: DataFrame, limits: tuple[int | None, int | None, int | None] = (None, None, None)) -> DataFrame:
    """Saved tracks, then albums, then followed artists: branch, ord, target_type, id, name,
    duration_ms, credits, ids, album. Limits hold for each branch."""
    kind = "array<struct<namespace:string,value:string>>"
    ids = lambda c: F.transform(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("namespace"), e["value"].alias("value"))).cast(kind)
    none = F.lit(None).cast("struct<id:string,name:string,ids:array<struct<namespace:string,value:string>>>")
    t = tracks.select(F.col("offset"), F.posexplode("items").alias("pos", "i")).select(F.lit(0).alias("branch"), (F.coalesce("offset", F.lit(0)) + F.col("pos")).alias("ord"), F.lit("recording").alias("target_type"), F.col("i.track.id").alias("id"), F.col("i.track.name").alias("name"), F.col("i.track.duration_ms").alias("duration_ms"), F.col("i.track.artists").alias("credits"), ids(F.col("i.track.external_ids")).alias("ids"), F.struct(F.col("i.track.album.id").alias("id"), F.col("i.track.album.name").alias("name"), ids(F.col("i.track.album.external_ids")).alias("ids")).alias("album"))
    a = albums.select(F.col("offset"), F.posexplode("items").alias("pos", "i")).select(F.lit(1).alias("branch"), (F.coalesce("offset", F.lit(0)) + F.col("pos")).alias("ord"), F.lit("release_set").alias("target_type"), F.col("i.album.id").alias("id"), F.col("i.album.name").alias("name"), F.lit(None).cast("int").alias("duration_ms"), F.col("i.album.artists").alias("credits"), ids(F.col("i.album.external_ids")).alias("ids"), none.alias("album"))
    f = artists.select(F.posexplode("artists.items").alias("pos", "i")).select(F.lit(2).alias("branch"), F.col("pos").alias("ord"), F.lit("artist").alias("target_type"), F.col("i.id").alias("id"), F.col("i.name").alias("name"), F.lit(None).cast("int").alias("duration_ms"), F.array().cast(_ARTISTS).alias("credits"), F.array().cast(kind).alias("ids"), none.alias("album"))
    parts = [df if n is None else df.orderBy("ord").limit(n) for df, n in zip((t, a, f), limits, strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def cacheable(pages: DataFrame) -> DataFrame:
    """Scrobble pages that may be kept: whole ones in which nothing plays now."""
    playing = F.exists(F.coalesce(F.col("recenttracks.track"), F.array()), lambda t: F.coalesce(t["@attr"]["nowplaying"] == "true", F.lit(False)))
    return pages.where(F.col("error").isNull() & F.col("recenttracks").isNotNull() & ~playing)


def unmodelled_keys(raw: Column, known: list[str]) -> Column:
    """Top-level keys of a payload that the schema leaves out."""
    return F.array_except(F.json_object_keys(raw), F.array(*[F.lit(k) for k in known]))
