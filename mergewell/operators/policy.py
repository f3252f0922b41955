"""Decisions: which instruction each resolution leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decide_entities(resolutions: DataFrame) -> DataFrame:
    """Adds strategy and the final reason. Of the claims resolved to one target the most
    confident (no confidence is -1; then the smaller claim id) merges, the others do nothing.
    Needs claim_id, entity_type, status, target_id, candidate_ids, confidence, reason."""
    # A target's claims are reduced before they move, and what comes back is met by claim, so a
    # target that many claims resolve to is in no task's way.
    first = F.min(F.struct(-F.coalesce("confidence", F.lit(-1.0)), "claim_id"))["claim_id"]
    won = resolutions.where("status = 'resolved'").groupBy("entity_type", "target_id").agg(first.alias("claim_id"))
    ranked = resolutions.join(won.select("entity_type", "claim_id", F.lit(True).alias("_won")), ["entity_type", "claim_id"], "left").select(*resolutions.columns, "_won")
    strategy = F.when(F.col("status") == "new", "create").when((F.col("status") == "resolved") & F.col("_won"), "merge").when(F.col("status") == "resolved", "noop").otherwise("manual_review")
    reason = (
        F.when(F.col("status") == "resolved", F.when(F.col("_won"), "resolved_target_selected").otherwise("duplicate_resolved_target"))
        .when(F.col("status") == "new", F.coalesce("reason", F.lit("resolved_as_new")))
        .otherwise(F.coalesce("reason", F.lit("manual_review_required")))
    )
    return ranked.withColumns({"strategy": strategy, "reason": reason, "candidate_ids": F.array_distinct("candidate_ids")}).drop("_won")


def payload_differs(left: list[str], right: list[str]) -> Column:
    """Null-safe difference of any payload field."""
    out = F.lit(False)
    for a, b in zip(left, right, strict=True):
        out = out | ~F.col(a).eqNullSafe(F.col(b))
    return out


def decide_associations(resolutions: DataFrame, differs: Column) -> DataFrame:
    """new: create; resolved: merge if the payload differs, else noop; the rest is reviewed."""
    s = F.col("status")
    strategy = F.when(s == "new", "create").when((s == "resolved") & F.coalesce(differs, F.lit(False)), "merge").when(s == "resolved", "noop").otherwise("manual_review")
    reason = F.when(F.col("strategy") == "merge", F.lit("association_payload_merge")).otherwise(
        F.coalesce("reason", F.when(F.col("strategy") == "create", "association_create").when(F.col("strategy") == "noop", "association_noop").otherwise("association_manual_review_required"))
    )
    return resolutions.withColumn("strategy", strategy).withColumn("reason", reason)


def decide_links(resolutions: DataFrame) -> DataFrame:
    """new: create; resolved: noop; the rest is reviewed."""
    s = F.col("status")
    default = F.when(s == "new", "link_create").when(s == "resolved", "link_exists").when(s == "blocked", "link_endpoint_blocked").otherwise("link_manual_review_required")
    return resolutions.withColumns({"strategy": F.when(s == "new", "create").when(s == "resolved", "noop").otherwise("manual_review"), "reason": F.coalesce("reason", default)})


def manual_review(instructions: DataFrame, subject: str) -> DataFrame:
    """Instructions that a person must look at."""
    return instructions.where("strategy = 'manual_review'").select("claim_id", F.lit(subject).alias("subject"), "candidate_ids", "reason")


def skip_reasons(instructions: DataFrame) -> DataFrame:
    """How often each subject was left out or reviewed, by strategy and reason. Needs subject."""
    out = instructions.where("strategy in ('noop', 'manual_review')")
    return out.groupBy("subject", "strategy", "reason").agg(F.count("*").alias("n"))
