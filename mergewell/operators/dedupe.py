"""Deduplication of claims within a batch.

A claim is dropped if one of its keys, in key order, already belongs to an earlier surviving
claim of the same type. Dropped claims own no keys, so this is not transitive: it is the
lexicographically first maximal independent set of "shares a key", not connected components.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergewell.operators import graph
from mergewell.operators.cut import checkpointed
from mergewell.operators.merge import first_of

#: Rows of keys that one task decides in one sorted scan.
SCAN = 1 << 18


def dedupe_single_key(claims: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Survivors where a claim has one key, with the size of their group: the earliest row of
    each key and how many rows it stands for. A partial aggregate, so hot keys shrink before
    they move."""
    cols = [c for c in claims.columns if c not in by]
    first = F.min_by(F.struct(*cols), F.struct(*order)).alias("first")
    return claims.groupBy(*by).agg(first, F.count("*").alias("n_claims")).select(*by, "first.*", "n_claims")


def dedupe_greedy(keys: DataFrame, scan: int = SCAN) -> tuple[DataFrame, DataFrame]:
    """(survivors, dropped) of a long key frame (claim_id, claim_ord, entity_type, key_ord, key).

    What at most `scan` rows of keys leave open is decided by one scan in order. Beyond that, two
    rounds settle what is shallow: the earliest claim on all its keys survives, and so does every
    second one of a chain, as far as each has one claim before it; claims that share a key with a
    survivor drop. What is left falls into components: those of at most `scan` rows are scanned,
    many a task, and the larger ones go on in rounds. (Which claims survive is a sequential
    question in general: only a component that is large, deep and not a chain takes many rounds.)
    Dropped rows carry the survivor and the key they matched: the first in key order whose
    owner comes before them.
    """
    open_keys = checkpointed(keys.select("claim_id", "claim_ord", "entity_type", "key_ord", "key"))
    every, kept, rounds = open_keys, [], 0
    while (left := open_keys.count()) > scan:
        if rounds % 4 == 2:
            small, open_keys = _split(open_keys, left, scan)
            kept.append(checkpointed(_scanned(small)))
        else:
            new, open_keys = _round(open_keys)
            kept.append(new)
        rounds += 1
    if left or not kept:
        kept.append(checkpointed(_scanned(open_keys.withColumn("_task", F.lit(0)))))
    survivors = kept[0]
    for new in kept[1:]:
        survivors = survivors.union(new)
    owned = every.join(survivors.select("claim_id"), "claim_id", "left_semi").select("entity_type", "key", F.col("claim_id").alias("rep_claim_id"), F.col("claim_ord").alias("rep_ord"))
    losers = every.join(survivors.select("claim_id"), "claim_id", "left_anti")
    matched = losers.join(owned, ["entity_type", "key"]).where("rep_ord < claim_ord")
    dropped = matched.groupBy("entity_type", "claim_id").agg(F.min(F.struct("key_ord", "rep_ord", "rep_claim_id", "key")).alias("m")).select("entity_type", "claim_id", "m.rep_claim_id", F.col("m.key").alias("matched_key"))
    return survivors, dropped


def _round(open_keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims that certainly survive, keys that stay open)."""
    by, own = ["entity_type", "key"], F.struct("claim_ord", "claim_id")
    first = open_keys.groupBy(*by).agg(F.min(own).alias("first"))
    ranked = open_keys.join(first, by)
    second = ranked.where(own > F.col("first")).groupBy(*by).agg(F.min(own).alias("second"))
    ranked = ranked.join(second, by, "left")
    before = F.when(own == F.col("second"), F.col("first"))
    told = ranked.groupBy("entity_type", "claim_id", "claim_ord").agg(
        F.min(own == F.col("first")).alias("free"),
        F.min((own == F.col("first")) | (own == F.col("second"))).alias("near"),
        F.min(before).alias("low"), F.max(before).alias("high"),
    )
    told = checkpointed(told)
    free = told.where("free").select("entity_type", "claim_id", "claim_ord")
    # A claim with a single one before it survives just if that one does not.
    single = told.where(~F.col("free") & F.col("near") & (F.col("low") == F.col("high"))).select("entity_type", F.col("claim_id").alias("src"), F.col("low.claim_id").alias("at"))
    ended, _ = graph.ends(single, ["entity_type"])
    second = ended.where("odd = 0").join(free.select("entity_type", F.col("claim_id").alias("at")), ["entity_type", "at"], "left_semi")
    new = checkpointed(free.union(told.join(second.select("entity_type", F.col("src").alias("claim_id")), ["entity_type", "claim_id"], "left_semi").select(*free.columns)))
    taken = open_keys.join(new.select("claim_id"), "claim_id", "left_semi").select(*by).distinct()
    losing = open_keys.join(taken, by, "left_semi").select("claim_id").distinct()
    return new, checkpointed(open_keys.join(losing, "claim_id", "left_anti"))


def _split(open_keys: DataFrame, rows: int, scan: int) -> tuple[DataFrame, DataFrame]:
    """(keys of components with at most `scan` rows, with a task for each, the others)."""
    pairs = open_keys.select(F.struct("entity_type", "claim_id").alias("item"), F.struct("entity_type", "key").alias("key"))
    label = graph.components(pairs).select("item.entity_type", "item.claim_id", "label")
    told = open_keys.join(label, ["entity_type", "claim_id"])
    size = told.groupBy("label").agg(F.count("*").alias("_size"))
    told = checkpointed(told.join(size, "label"))
    task = F.pmod(F.xxhash64("label"), F.lit(2 * rows // scan + 1)).alias("_task")
    return told.where(F.col("_size") <= scan).select(*open_keys.columns, task), told.where(F.col("_size") > scan).select(*open_keys.columns)


def _place(value):
    """A value of Arrow as Spark orders it: nulls first, structs field by field."""
    if isinstance(value, dict):
        return True, tuple(_place(v) for v in value.values())
    return (False,) if value is None else (True, value)


def _scanned(rows: DataFrame) -> DataFrame:
    """Survivors of whole components, decided in order by one scan for each `_task`."""

    def decide(group: pa.Table) -> pa.Table:
        claims: dict = {}
        types, names, keys = (group.column(c).to_pylist() for c in ("entity_type", "claim_id", "key"))
        for i, claim in enumerate(zip(types, names, strict=True)):
            claims.setdefault(claim, []).append(i)
        place = group.column("claim_ord").to_pylist()
        owned, kept = set(), []
        for (kind, _), at in sorted(claims.items(), key=lambda c: _place(place[c[1][0]])):
            own = {(kind, keys[i]) for i in at}
            if owned.isdisjoint(own):
                owned |= own
                kept.append(at[0])
        return group.select(["entity_type", "claim_id", "claim_ord"]).take(pa.array(kept, pa.int64()))

    kind = rows.select("entity_type", "claim_id", "claim_ord").schema
    return rows.select("_task", "entity_type", "claim_id", "claim_ord", "key").groupBy("_task").applyInArrow(decide, kind)


def rewire(rels: DataFrame, dropped: DataFrame) -> DataFrame:
    """Relationship endpoints moved to the representatives of dropped claims."""
    to = dropped.select(F.col("claim_id").alias("_c"), F.col("rep_claim_id").alias("_r"))
    out = rels
    for end in ("src_claim_id", "dst_claim_id"):
        out = out.join(to, F.col(end) == F.col("_c"), "left").withColumn(end, F.coalesce("_r", end)).drop("_c", "_r")
    return out


def collapse_relationships(rels: DataFrame, key: str = "rel_key", order: str = "rel_ord") -> DataFrame:
    """One relationship for each key, the first."""
    return first_of(rels, [key], [order])


def missing_endpoints(rels: DataFrame, claims: DataFrame) -> DataFrame:
    """Relationships that name a claim which is not there; must be empty."""
    ids = claims.select(F.col("claim_id").alias("_c"))
    lost = [rels.join(ids, F.col(end) == F.col("_c"), "left_anti").withColumn("missing", F.lit(end)) for end in ("src_claim_id", "dst_claim_id")]
    return lost[0].unionByName(lost[1])


def rewire_roots(claims: DataFrame, dropped: DataFrame) -> DataFrame:
    """Root claims in order, those that dropped replaced by what they matched, each once."""
    roots = claims.where("is_root").select("claim_id", "root_ord")
    to = dropped.select("claim_id", "rep_claim_id")
    return roots.join(to, "claim_id", "left").groupBy(F.coalesce("rep_claim_id", "claim_id").alias("claim_id")).agg(F.min("root_ord").alias("root_ord"))
