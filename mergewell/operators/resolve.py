"""Resolution of claims against the stored catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergewell.operators.cut import checkpointed
from mergewell.operators.graph import ends
from mergewell.operators.merge import first_of
from mergewell.operators.prune import meeting


def redirect_closure(redirects: DataFrame) -> DataFrame:
    """(namespace, source_value, target_value): where each chain of redirects, one of each source,
    ends; a chain that comes back to a value it has seen ends before it. Pointers are doubled, so
    a chain of n takes log n rounds. A chain that never ends leads to a circle: it ends at the
    value before the one where it came in."""
    by = ["namespace"]
    steps = redirects.select("namespace", F.col("source_value").alias("src"), F.col("target_value").alias("at"))
    ended, endless = ends(steps, by)
    out = lambda df: df.select("namespace", F.col("src").alias("source_value"), F.col("at").alias("target_value"))
    done = out(ended)
    if not endless.isEmpty():
        circle = checkpointed(endless.select("namespace", F.col("at").alias("src")).distinct())  # doubled often enough, they are all on it
        back = checkpointed(steps.join(circle, ["namespace", "src"], "left_semi").select("namespace", F.col("at").alias("src"), F.col("src").alias("at")))
        tails = steps.join(endless.select("namespace", "src"), ["namespace", "src"], "left_semi").join(circle, ["namespace", "src"], "left_anti")
        came_in, _ = ends(tails, by)
        before = back.select("namespace", F.col("src").alias("at"), F.col("at").alias("_at"))
        done = done.union(out(back)).union(out(came_in.join(before, ["namespace", "at"]).select("namespace", "src", F.col("_at").alias("at"))))
    stay = redirects.where("source_value = target_value").select("namespace", "source_value")
    return done.join(stay, ["namespace", "source_value"], "left_anti")


def by_external_id(claim_ids: DataFrame, external_ids: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """(claim_id, entity_id): the owner of the first external id, in order, that has one, with
    redirects followed where the id itself has none. claim_ids: claim_id, entity_type, pos,
    namespace, value."""
    owners = external_ids.select("namespace", "value", F.col("owner_type").alias("entity_type"), F.col("owner_id").alias("entity_id"))
    by = ["namespace", "value", "entity_type"]
    asked = claim_ids.select(*by)
    if closure is not None:
        via = meeting(closure.select("namespace", F.col("source_value").alias("value"), "target_value"), claim_ids, ["namespace", "value"])
        asked = asked.union(asked.join(via, ["namespace", "value"]).select("namespace", "target_value", "entity_type"))
    owners = meeting(owners, asked, by)
    direct = claim_ids.join(owners, by, "left")
    if closure is not None:
        hop = owners.select("namespace", F.col("value").alias("target_value"), "entity_type", F.col("entity_id").alias("_via"))
        direct = direct.join(via, ["namespace", "value"], "left").join(hop, ["namespace", "target_value", "entity_type"], "left").withColumn("entity_id", F.coalesce("entity_id", "_via"))
    hits = direct.where("entity_id is not null")
    return hits.groupBy("claim_id").agg(F.min_by(F.struct("entity_id", "namespace", "value"), F.struct("pos", "value")).alias("m")).select("claim_id", "m.*")


def by_keys(keys: DataFrame, sidecar: DataFrame) -> DataFrame:
    """(claim_id, candidates in key order, matched_key): owners of any of a claim's keys."""
    owned = meeting(sidecar.select("entity_type", "key", "entity_id"), keys, ["entity_type", "key"])
    hits = keys.join(owned, ["entity_type", "key"])
    ordered = F.array_sort(F.collect_list(F.struct("key_ord", "entity_id", "key")))
    return hits.groupBy("claim_id").agg(ordered.alias("h")).select("claim_id", F.array_distinct(F.transform("h", lambda x: x["entity_id"])).alias("candidates"), F.get("h", F.lit(0))["key"].alias("matched_key"))


def namespace_conflicts(claim_ids: DataFrame, candidates: DataFrame, external_ids: DataFrame, closure: DataFrame) -> DataFrame:
    """Claims whose candidate holds another value in a shared namespace, unless the claim's
    value redirects to it. candidates: claim_id, entity_id."""
    own = claim_ids.select("claim_id", "namespace", "value")
    held = meeting(external_ids.select(F.col("owner_id").alias("entity_id"), "namespace", F.col("value").alias("held")), candidates, ["entity_id"])
    met = candidates.join(own, "claim_id").join(held, ["entity_id", "namespace"]).where("value <> held")
    ok = closure.select("namespace", F.col("source_value").alias("value"), F.col("target_value").alias("held"))
    return met.join(ok, ["namespace", "value", "held"], "left_anti").select("claim_id").distinct()


def classify(n_candidates: Column, conflict: Column, wrong_type: Column) -> tuple[Column, Column]:
    """(status, reason) of an entity claim."""
    status = F.when(wrong_type | conflict, "conflict").when(n_candidates == 0, "new").when(n_candidates == 1, "resolved").otherwise("ambiguous")
    reason = (
        F.when(wrong_type, "candidate_type_mismatch").when(conflict, "external_id_namespace_conflict")
        .when(n_candidates == 0, "no_exact_match").when(n_candidates == 1, "exact_match").otherwise("multiple_exact_matches")
    )
    return status, reason


def resolve_entities(claims: DataFrame, claim_ids: DataFrame, keys: DataFrame, external_ids: DataFrame, redirects: DataFrame, sidecar: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(claim_id, entity_type, status, target_id, candidate_ids, matched_key, match_kind, reason).
    An external id that has an owner goes before all keys. With the stored `entities` a candidate
    whose type is not the claim's, whatever its ids and keys say, is a conflict."""
    closure = redirect_closure(redirects)
    ext = by_external_id(claim_ids, external_ids, closure).select("claim_id", F.col("entity_id").alias("ext"))
    met = claims.select("claim_id", "entity_type").join(ext, "claim_id", "left").join(by_keys(keys, sidecar), "claim_id", "left")
    found = F.when(F.col("ext").isNotNull(), F.array("ext")).otherwise(F.coalesce("candidates", F.array().cast("array<string>")))
    met = met.select("claim_id", "entity_type", found.alias("candidate_ids"), F.when(F.col("ext").isNull(), F.col("matched_key")).alias("matched_key"), F.when(F.col("ext").isNotNull(), "external_id").when(F.size(found) > 0, "key").alias("match_kind"))
    # Read several times below and again by what decides; a plan would hold all of the above each time.
    met = checkpointed(met)
    pairs = met.select("claim_id", F.explode("candidate_ids").alias("entity_id"))
    bad = namespace_conflicts(claim_ids, pairs, external_ids, closure).withColumn("_conflict", F.lit(True))
    out, wrong = met.join(bad, "claim_id", "left"), F.lit(False)
    if entities is not None:
        types = meeting(entities.select("entity_id", F.col("entity_type").alias("_type")), pairs, ["entity_id"])
        other = met.select("claim_id", "entity_type", F.explode("candidate_ids").alias("entity_id")).join(types, "entity_id").where("entity_type <> _type")
        out, wrong = out.join(other.select("claim_id").distinct().withColumn("_wrong", F.lit(True)), "claim_id", "left"), F.coalesce("_wrong", F.lit(False))
    status, reason = classify(F.size("candidate_ids"), F.coalesce("_conflict", F.lit(False)), wrong)
    out = out.withColumns({"status": status, "reason": reason}).drop("_conflict", "_wrong")
    return out.withColumn("target_id", F.when(F.col("status") == "resolved", F.get("candidate_ids", F.lit(0))))


def bad_endpoints(rels: DataFrame, claims: DataFrame, ends: dict[str, tuple[str, str]]) -> DataFrame:
    """Relationships whose ends are not there or not of the types that their kind joins; must be
    empty. (rel_id, kind, reason)"""
    out = rels
    for i, end in enumerate(("src", "dst")):
        types = claims.select(F.col("claim_id").alias(f"{end}_claim_id"), F.col("entity_type").alias(f"_{end}"))
        want = F.create_map(*[F.lit(x) for kind, pair in ends.items() for x in (kind, pair[i])])
        out = out.join(types, f"{end}_claim_id", "left").withColumn(f"_{end}_want", want[F.col("kind")])
    lost = F.col("_src").isNull() | F.col("_dst").isNull()
    wrong = ~(F.col("_src").eqNullSafe(F.col("_src_want")) & F.col("_dst").eqNullSafe(F.col("_dst_want")))
    return out.where(lost | wrong).select("rel_id", "kind", F.when(lost, "endpoint_missing").otherwise("endpoint_type_mismatch").alias("reason"))


def endpoints(rels: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Adds src_id, dst_id (target if resolved, the claim itself if new) and blocked_by: the
    distinct endpoints that are neither."""
    out = rels
    for end in ("src", "dst"):
        side = resolutions.select(F.col("claim_id").alias("_c"), F.when(F.col("status") == "resolved", F.col("target_id")).when(F.col("status") == "new", F.col("claim_id")).alias("_e"))
        out = out.join(side, F.col(f"{end}_claim_id") == F.col("_c"), "left").withColumn(f"{end}_id", F.col("_e")).drop("_c", "_e")
    lost = F.array_distinct(F.array_compact(F.array(F.when(F.col("src_id").isNull(), F.col("src_claim_id")), F.when(F.col("dst_id").isNull(), F.col("dst_claim_id")))))
    return out.withColumn("blocked_by", lost)


def resolve_associations(rels: DataFrame, edges: DataFrame) -> DataFrame:
    """Associations (rel_id, kind, src_id, dst_id, blocked_by) against edges (kind, src_id,
    dst_id, edge_id): none new, one resolved, more ambiguous, blocked endpoints blocked. Only
    edges between the batch's ends are counted."""
    counts = meeting(edges, rels, ["kind", "src_id", "dst_id"]).groupBy("kind", "src_id", "dst_id").agg(F.count("*").alias("n"), F.min("edge_id").alias("edge_id"))
    met = rels.join(counts, ["kind", "src_id", "dst_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    blocked = F.size("blocked_by") > 0
    status = F.when(blocked, "blocked").when(F.col("n") == 0, "new").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    reason = F.when(blocked, "relationship_endpoint_unresolved").when(F.col("n") == 0, "association_not_found").when(F.col("n") == 1, "association_found").otherwise("multiple_association_matches")
    return met.withColumns({"status": status, "reason": reason, "target_id": F.when(F.col("n") == 1, F.col("edge_id"))}).drop("n", "edge_id")


def resolve_links(rels: DataFrame, links: DataFrame) -> DataFrame:
    """Pure links: resolved if stored (kind, src_id, dst_id), else new."""
    there = meeting(links.select("kind", "src_id", "dst_id"), rels, ["kind", "src_id", "dst_id"]).distinct().withColumn("_hit", F.lit(True))
    met = rels.join(there, ["kind", "src_id", "dst_id"], "left")
    blocked = F.size("blocked_by") > 0
    return met.withColumns({
        "status": F.when(blocked, "blocked").when(F.col("_hit"), "resolved").otherwise("new"),
        "reason": F.when(blocked, "relationship_endpoint_unresolved").when(F.col("_hit"), "link_found").otherwise("link_not_found"),
    }).drop("_hit")


def first_per_namespace(ids: DataFrame, owner: str, order: str) -> DataFrame:
    """One external id for each owner and namespace: the first."""
    return first_of(ids, [owner, "namespace"], [order])
