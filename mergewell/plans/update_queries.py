"""The query of release updates in order, over a store of its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergewell import schemas
from mergewell.operators.cut import checkpointed, folder
from mergewell.operators.persist import Store
from mergewell.plans.catalogue import query, table
from mergewell.plans.engine import State
from mergewell.plans.updates import update_in_order
from mergewell.sources import payloads
from mergewell.sources.translate import release_graph

_OUTCOME = "CASE s_suppkey % 4 WHEN 1 THEN 'musicbrainz_redirect_collision' ELSE 'applied' END"


@query(f"""
WITH s AS (SELECT *, s_suppkey % 4 AS n, lpad(s_suppkey::VARCHAR, 8, '0') AS k FROM supplier)
SELECT 'r' || k AS release_id, {_OUTCOME} AS outcome, (n = 1)::INTEGER AS layer, CASE WHEN n <> 1 THEN 'm' || k END AS requested, CASE WHEN n <> 1 THEN 3 END AS level,
  CASE WHEN n <> 1 THEN 1000 * s_suppkey + 500 END AS heard_ms
FROM s WHERE n <> 3""")
def release_updates_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as stored releases. Of four, the first and the third are found by their names; the
    second has an id that leads to what the first is updated from, so it waits and finds that taken;
    the fourth is nowhere to be found."""
    k, n = F.lpad(F.col("s_suppkey").cast("string"), 8, "0"), F.col("s_suppkey") % 4
    supplier = table(spark, d, "supplier").withColumns({"k": k, "n": n})
    name = F.when(F.col("n") == 3, F.concat(F.lit("~"), F.reverse("k"))).otherwise(F.col("s_name"))
    entities = supplier.select(
        F.concat(F.lit("r"), "k").alias("entity_id"), F.lit("release").alias("entity_type"), name.alias("name"), F.lit(None).cast("long").alias("duration_ms"),
        F.array(F.lit("lastfm")).alias("sources"), F.lit(None).cast(schemas.FACTS).alias("facts"),
    )
    second = supplier.where("n = 1")
    ids = second.select(F.lit("musicbrainz:release").alias("namespace"), F.concat(F.lit("x"), "k").alias("value"), F.lit("release").alias("owner_type"), F.concat(F.lit("r"), "k").alias("owner_id"), F.lit("lastfm").alias("provider"))
    to = F.concat(F.lit("m"), F.lpad((F.col("s_suppkey") - 1).cast("string"), 8, "0"))
    moved = second.select(F.lit("musicbrainz:release").alias("namespace"), F.concat(F.lit("x"), "k").alias("source_value"), to.alias("target_value"))

    credit = F.array(F.struct(F.lit("A").alias("name"), F.struct(F.lit("a").alias("id"), F.lit("A").alias("name")).alias("artist")))
    recording = F.struct(F.concat(F.lit("rec"), "k").alias("id"), F.concat(F.lit("song "), "k").alias("title"))
    track = F.struct(F.lit(1).alias("position"), recording["title"].alias("title"), (F.col("s_suppkey") * 1000 + 500).alias("length"), recording.alias("recording"))
    landed = supplier.where("n in (0, 2)").select(F.to_json(F.struct(
        F.concat(F.lit("m"), "k").alias("id"), F.col("s_name").alias("title"), credit.alias("artist-credit"),
        F.struct(F.concat(F.lit("g"), "k").alias("id"), F.col("s_name").alias("title")).alias("release-group"),
        F.array(F.struct(F.lit(1).alias("position"), F.array(track).alias("tracks"))).alias("media"),
    )).alias("json"))
    # Parsed once, by as many tasks as there is text for: all frames of the graph are made from it.
    parsed = checkpointed(landed.repartition("json").select(F.from_json("json", payloads.METADATA_RELEASE).alias("p")).select("p.*"))
    graph = release_graph(parsed)

    store = Store(spark, f"{folder(spark)}/updates-{uuid.uuid4().hex}")
    empty = State.empty(spark)
    State(entities, ids, empty.redirects, empty.sidecar, empty.edges, empty.play_events, empty.library_items, empty.users).save(store)
    done = update_in_order(store, graph, moved)
    after = State.load(store)
    heard = after.edges.where("kind = 'release_track'").join(after.entities.select(F.col("entity_id").alias("dst_id"), F.col("duration_ms").alias("heard_ms")), "dst_id").select(F.col("src_id").alias("release_id"), "heard_ms")
    applied = done.applied.join(heard, "release_id").select("release_id", F.lit("applied").alias("outcome"), "layer", "requested", "level", "heard_ms")
    return applied.unionByName(done.review.withColumnRenamed("reason", "outcome"), allowMissingColumns=True)
