"""Field rules of merges and the frames that apply them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergewell.functions.text import blank_to_null
from mergewell.schemas import FACT_TYPES

#: Fields by rule for each entity type. Text wins if not blank, values if not null, lists grow.
RULES = {
    "artist": {"text": ["name", "sort_name", "country"], "value": ["kind", "life_span", "formed_year", "disbanded_year"], "list": ["areas", "aliases"]},
    "label": {"text": ["name", "country"], "value": [], "list": []},
    "release_set": {"text": ["title"], "value": ["primary_type", "first_release"], "list": ["secondary_types", "aliases"]},
    "release": {"text": ["title", "country", "format"], "value": ["release_date", "status", "packaging", "medium_count"], "list": []},
    "recording": {"text": ["title", "version", "disambiguation"], "value": ["duration_ms"], "list": ["aliases"]},
    "user": {"text": ["display_name", "email", "spotify_user_id", "lastfm_user"], "value": [], "list": []},
}


def prefer_text(current: Column, incoming: Column) -> Column:
    """Incoming if it holds more than white space."""
    return F.when(blank_to_null(incoming).isNotNull(), incoming).otherwise(current)


def prefer_value(current: Column, incoming: Column) -> Column:
    return F.coalesce(incoming, current)


def grow_list(current: Column, incoming: Column) -> Column:
    """Appends what is not there yet, order kept; what was there is not touched."""
    return F.when(current.isNull(), F.array_distinct(incoming)).when(incoming.isNull(), current).otherwise(F.concat(current, F.array_except(incoming, current)))


def union_sources(current: Column, incoming: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(current, none), F.coalesce(incoming, none)))


def absorb_facts(current: Column, incoming: Column) -> Column:
    """A struct of facts with another absorbed, each field by its rule. A field has one rule,
    whatever the type of the entity."""
    by = {"text": prefer_text, "value": prefer_value, "list": grow_list}
    rule = {f: by[r] for rules in RULES.values() for r, fields in rules.items() for f in fields}
    return F.struct(*[rule[f](current[f], incoming[f]).alias(f) for f in FACT_TYPES])


def merge_entities(stored: DataFrame, incoming: DataFrame, entity_type: str, key: str = "entity_id") -> DataFrame:
    """Stored rows with the incoming ones (at most one each) absorbed, and changed_fields."""
    rules = RULES[entity_type]
    pick = {f: prefer_text for f in rules["text"]} | {f: prefer_value for f in rules["value"]} | {f: grow_list for f in rules["list"]}
    pick = {f: r for f, r in pick.items() if f in stored.columns and f in incoming.columns}
    given = incoming.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in pick], F.lit(True).alias("_hit"))
    met = stored.join(given, F.col(key) == F.col("_k"), "left")
    new = {f: F.when(F.col("_hit"), rule(F.col(f), F.col(f"_{f}"))).otherwise(F.col(f)) for f, rule in pick.items()}
    changed = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(c), F.lit(f)) for f, c in new.items()])) if new else F.array().cast("array<string>")
    rest = [F.col(c) for c in stored.columns if c not in new]
    return met.select(*rest, *[c.alias(f) for f, c in new.items()], changed.alias("changed_fields"))


def overwrite_payload(stored: DataFrame, incoming: DataFrame, fields: list[str], key: str = "edge_id") -> DataFrame:
    """Association payloads: incoming always wins, nulls too."""
    given = incoming.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_hit"))
    met = stored.join(given, F.col(key) == F.col("_k"), "left")
    return met.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in stored.columns])


def absorb_external_ids(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids to add, conflicts): an owner keeps one value a namespace, the first in order of `pos`,
    where given, and value. What says another value than the one that is held, or that is added
    now, is a conflict. Columns: owner_type, owner_id, namespace, value."""
    by = ["owner_type", "owner_id", "namespace"]
    add = first_of(incoming, by, [c for c in ("pos", "value") if c in incoming.columns]).join(stored.select(*by), by, "left_anti")
    held = stored.select(*by, F.col("value").alias("held")).unionByName(add.select(*by, F.col("value").alias("held")))
    return add, incoming.join(held, by).where("value <> held")


def first_of(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group: a partial aggregate, so a frequent key shrinks before it moves."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f")).select(*by, "_f.*").select(*rows.columns)


def materialize(instructions: DataFrame) -> DataFrame:
    """(claim_id, entity_id): what each claim has become; nothing for reviewed ones."""
    own = F.coalesce("created_id", "claim_id") if "created_id" in instructions.columns else F.col("claim_id")
    entity = F.when(F.col("strategy") == "create", own).when(F.col("strategy") == "merge", F.col("target_id")).when(F.col("strategy") == "noop", F.coalesce(F.col("target_id"), own))
    return instructions.where("strategy <> 'manual_review'").select("claim_id", entity.alias("entity_id"))


def counters(instructions: DataFrame) -> DataFrame:
    """For each subject: applied, created, merged, skipped, manual_review."""
    n = lambda s: F.sum((F.col("strategy") == s).cast("long"))
    return instructions.groupBy("subject").agg(F.count("*").alias("applied"), n("create").alias("created"), n("merge").alias("merged"), n("noop").alias("skipped"), n("manual_review").alias("manual_review"))


def sum_counters(runs: DataFrame) -> DataFrame:
    """Counters of several runs (as `counters` has them) added up by subject."""
    names = ["applied", "created", "merged", "skipped", "manual_review"]
    return runs.groupBy("subject").agg(*[F.sum(c).alias(c) for c in names])
