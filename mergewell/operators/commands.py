"""Catalog commands as set-based edits of edge and fact frames.

Each takes the rows to edit as a frame, so one call edits any number of owners, and tells what
it could not do as a frame of violations that must be empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergewell.operators.cut import checkpointed
from mergewell.operators.merge import first_of
from mergewell.operators.persist import insert_or_ignore, upsert


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Adds tracks, credits or links; one that joins the same ends stays as it is."""
    return edges.unionByName(insert_or_ignore(edges, new, ["kind", "src_id", "dst_id"], ["edge_id"]), allowMissingColumns=True)


def remove_edges(edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges left, removals of what is not there)."""
    by = ["kind", "src_id", "dst_id"]
    return edges.join(gone.select(*by), by, "left_anti"), gone.join(edges.select(*by), by, "left_anti")


def replace_edges(edges: DataFrame, owners: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """Replaces all edges of a kind that the owners (src_id) have."""
    kept = edges.join(owners.select("src_id").withColumn("kind", F.lit(kind)), ["kind", "src_id"], "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def move_edges(edges: DataFrame, moves: DataFrame, end: str = "src_id") -> DataFrame:
    """Moves edges from one entity to another (from_id, to_id); where the target already has
    the same edge, that one stays."""
    to = moves.select(F.col("from_id").alias("_f"), F.col("to_id").alias("_t"))
    met = edges.join(to, F.col(end) == F.col("_f"), "left")
    moved = met.where("_t is not null").withColumn(end, F.col("_t")).drop("_f", "_t")
    kept = met.where("_t is null").drop("_f", "_t")
    return kept.unionByName(insert_or_ignore(kept, moved, ["kind", "src_id", "dst_id"], ["edge_id"]), allowMissingColumns=True)


def adopt(edges: DataFrame, adds: DataFrame, kind: str) -> DataFrame:
    """Gives children (dst_id) to owners (src_id) by edges of a kind of which a child has one: what
    it had before goes, a child that is with its owner stays. Of several owners the last one told
    (`ord`) has it. `adds` has an edge_id, too."""
    last = adds.groupBy("dst_id").agg(F.max_by(F.struct("src_id", "edge_id"), "ord").alias("_a")).select("dst_id", "_a.*", F.lit(kind).alias("kind"))
    moved = last.join(edges.select("kind", "src_id", "dst_id"), ["kind", "src_id", "dst_id"], "left_anti")
    rest = edges.join(moved.select("kind", "dst_id"), ["kind", "dst_id"], "left_anti").select(*edges.columns)
    return rest.unionByName(moved, allowMissingColumns=True)


def create_releases(entities: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, edges, refused): releases (entity_id, name, and what else is known of them) made in
    their sets (src_id), each with its edge. Refused, with `why`: sets that are not there, ids that
    are taken, and of several new ones with an id all but the first (`ord`)."""
    sets = entities.where("entity_type = 'release_set'").select(F.col("entity_id").alias("src_id"))
    homeless = new.join(sets, "src_id", "left_anti").withColumn("why", F.lit("no such release set"))
    at_home = new.join(sets, "src_id", "left_semi")
    first = first_of(at_home, ["entity_id"], ["ord"])
    made = first.join(entities.select("entity_id"), "entity_id", "left_anti")
    taken = at_home.join(made.select("ord"), "ord", "left_anti").withColumn("why", F.lit("the id is taken"))
    rows = made.withColumn("entity_type", F.lit("release")).select(*[c for c in entities.columns if c == "entity_type" or c in made.columns])
    kind = "release_set_release"
    owned = made.select(F.concat_ws("|", F.lit(kind), "src_id", "entity_id").alias("edge_id"), F.lit(kind).alias("kind"), "src_id", F.col("entity_id").alias("dst_id"))
    refused = homeless.unionByName(taken).select(*new.columns, "why")
    return entities.unionByName(rows, allowMissingColumns=True), edges.unionByName(owned, allowMissingColumns=True), refused


def orphans(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges that lost an end; deleting these is what a cascade would do."""
    ids = entities.select(F.col("entity_id").alias("_id"))
    return edges.join(ids, F.col("src_id") == F.col("_id"), "left_anti").unionByName(edges.join(ids, F.col("dst_id") == F.col("_id"), "left_anti")).distinct()


def put_external_ids(stored: DataFrame, new: DataFrame, replace: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ids, conflicts): one value for each owner and namespace; replace lets the new one win."""
    by = ["owner_type", "owner_id", "namespace"]
    if replace:
        return upsert(stored, first_of(new, by, ["value"]), by), new.limit(0)
    held = stored.select(*by, F.col("value").alias("held"))
    clash = new.join(held, by).where("value <> held")
    return stored.unionByName(first_of(new, by, ["value"]).join(stored.select(*by), by, "left_anti"), allowMissingColumns=True), clash


def remove_external_ids(stored: DataFrame, gone: DataFrame) -> DataFrame:
    by = ["owner_type", "owner_id", "namespace"]
    return stored.join(gone.select(*by), by, "left_anti")


def point_to_canonical(entities: DataFrame, pointers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities with canonical_id, pointers to another type); to itself is null."""
    to = pointers.select("entity_id", F.nullif("canonical_id", "entity_id").alias("_c"), F.lit(True).alias("_hit"))
    types = entities.select(F.col("entity_id").alias("canonical_id"), F.col("entity_type").alias("_type"))
    bad = pointers.join(entities.select("entity_id", "entity_type"), "entity_id").join(types, "canonical_id").where("entity_type <> _type")
    current = F.col("canonical_id") if "canonical_id" in entities.columns else F.lit(None).cast("string")
    return entities.join(to, "entity_id", "left").withColumn("canonical_id", F.when(F.col("_hit"), F.col("_c")).otherwise(current)).drop("_c", "_hit"), bad


def retarget_items(items: DataFrame, moves: DataFrame) -> DataFrame:
    """Library items moved to other targets; a user who has both keeps one."""
    to = moves.select(F.col("from_id").alias("_f"), F.col("to_id").alias("_t"))
    met = items.join(to, F.col("target_id") == F.col("_f"), "left").withColumn("target_id", F.coalesce("_t", "target_id")).drop("_f", "_t")
    by = ["user_id", "target_type", "target_id"]
    return first_of(met, by, sorted(c for c in met.columns if c not in by))


def rebind_plays(events: DataFrame, moves: DataFrame) -> DataFrame:
    """Play events moved from one recording to another."""
    to = moves.select(F.col("from_id").alias("_f"), F.col("to_id").alias("_t"))
    return events.join(to, F.col("recording_id") == F.col("_f"), "left").withColumn("recording_id", F.coalesce("_t", "recording_id")).drop("_f", "_t")


def foreign(rows: DataFrame, owned: DataFrame, by: str = "user_id") -> DataFrame:
    """Rows whose owner is not there or not theirs."""
    return rows.join(owned.select(by), by, "left_anti")


def cascade(roots: DataFrame, owns: DataFrame) -> DataFrame:
    """(id) of the roots and all that they own (owner_id, id), at any depth. A round a level; what
    was found before is not followed again, so circles end."""
    found = edge = checkpointed(roots.select("id").distinct())
    while True:
        below = owns.join(edge.select(F.col("id").alias("owner_id")), "owner_id", "left_semi").select("id").distinct()
        edge = checkpointed(below.join(found, "id", "left_anti"))
        if edge.isEmpty():
            return found
        found = found.union(edge)


def remove_entities(tables: dict[str, DataFrame], roots: DataFrame, owning: tuple[str, ...] = ("release_set_release",)) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, plays that are in the way) without the roots (id) and all that they own by edges of
    the `owning` kinds: entities, edges with either end among them, ids, keys and library items.
    Plays keep their recordings: where one of these would go, nothing is removed."""
    owns = tables["edges"].where(F.col("kind").isin(*owning)).select(F.col("src_id").alias("owner_id"), F.col("dst_id").alias("id"))
    gone = checkpointed(cascade(roots, owns))
    blocked = tables["play_events"].join(gone.select(F.col("id").alias("recording_id")), "recording_id", "left_semi")
    if not blocked.isEmpty():
        return tables, blocked
    without = lambda df, c: df.join(gone.select(F.col("id").alias(c)), c, "left_anti").select(*df.columns)
    left = {"entities": ["entity_id"], "edges": ["src_id", "dst_id"], "external_ids": ["owner_id"], "sidecar": ["entity_id"], "library_items": ["target_id"]}
    out = dict(tables)
    for name, ends in left.items():
        for c in ends if out.get(name) is not None else ():
            out[name] = without(out[name], c)
    return out, blocked
