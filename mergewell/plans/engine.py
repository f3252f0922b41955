"""The engine: normalize, deduplicate, resolve, decide, apply, persist, as one plan.

All stages are functions of frames, so a batch of any number of users is one run. Deviations
from a record-at-a-time run: ids are hashes, so ties have one outcome; the catalog and the
activity are committed together; an event whose claims went to review is reported, not fatal.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mergewell import schemas
from mergewell.functions.text import normalize_text
from mergewell.functions.values import provider_for
from mergewell.operators import dedupe as D
from mergewell.operators import incremental as Inc
from mergewell.operators import keys as K
from mergewell.operators import merge as M
from mergewell.operators import persist as X
from mergewell.operators import policy as P
from mergewell.operators import resolve as R
from mergewell.operators.prune import meeting


@dataclass
class State:
    """What is stored. `loaded` is what it was read as, `changes` are tables that grew out of those
    by additions and puts; `save` writes these alone. A table set in any other way is written anew."""

    entities: DataFrame
    external_ids: DataFrame
    redirects: DataFrame
    sidecar: DataFrame
    edges: DataFrame
    play_events: DataFrame
    library_items: DataFrame | None = None
    users: DataFrame | None = None
    watermarks: DataFrame | None = None
    late_events: DataFrame | None = None
    loaded: Loaded | None = None
    changes: dict[str, Grown] = field(default_factory=dict)

    @classmethod
    def schema(cls) -> dict[str, str]:
        return {
            "entities": schemas.FULL_ENTITY,
            "external_ids": schemas.EXTERNAL_ID,
            "redirects": schemas.REDIRECT,
            "sidecar": schemas.SIDECAR,
            "edges": schemas.FULL_EDGE,
            "play_events": schemas.PLAY_EVENT,
            "library_items": schemas.LIBRARY_ITEM,
            "users": schemas.TABLES["user_account"],
            "watermarks": schemas.WATERMARK,
            "late_events": schemas.LATE_EVENT,
        }

    @classmethod
    def empty(cls, spark: SparkSession) -> State:
        return cls(**{n: spark.createDataFrame([], s) for n, s in cls.schema().items()})

    @classmethod
    def load(cls, store: X.Store) -> State:
        """All tables of one commit, whatever is committed meanwhile."""
        at = store.last()
        tables = {n: store.read(n, s, at) for n, s in cls.schema().items()}
        return cls(**tables, loaded=Loaded(store.path, at.number, tables))

    def grown(self, table: str, full: DataFrame, added: DataFrame | None = None, put: DataFrame | None = None, by: tuple[str, ...] = ()) -> State:
        """This state with `full` as a table, which is what it was with rows added and put."""
        now, last = getattr(self, table), self.changes.get(table)
        changes = {n: c for n, c in self.changes.items() if n != table}
        if last is None or last.full is not now:
            changes[table] = Grown(now, full, X.Change(added, put, by))
        elif put is None and last.change.put is None and added is not None and last.change.added is not None:
            changes[table] = Grown(last.of, full, X.Change(last.change.added.unionByName(added)))
        return replace(self, **{table: full}, changes=changes)

    def add(self, table: str, rows: DataFrame) -> State:
        """This state with rows added to a table under keys that it does not have."""
        now = getattr(self, table)
        rows = rows.select(*now.columns)
        return self.grown(table, now.unionByName(rows), rows)

    def _change(self, table: str, loaded: dict[str, DataFrame]) -> DataFrame | X.Change:
        now, grew = getattr(self, table), self.changes.get(table)
        if now is None or now is loaded.get(table):
            return X.Change()
        if grew is not None and grew.full is now and grew.of is loaded.get(table):
            c = grew.change
            return X.Change(typed(c.added, self.schema()[table]), typed(c.put, self.schema()[table]), c.by)
        return typed(now, self.schema()[table])

    def save(self, store: X.Store) -> str:
        """Commits what changed since the state was loaded; afterwards the state counts as loaded."""
        same = self.loaded is not None and self.loaded.path == store.path
        loaded = self.loaded.tables if same else {}
        parts = {n: self._change(n, loaded) for n in self.schema()}
        version = store.commit(parts, self._rules, self.loaded.number if same else None)
        self.loaded = Loaded(store.path, store.last().number, {n: getattr(self, n) for n in parts})
        self.changes = {}
        return version

    def _rules(self, wrote: X.Written) -> dict[str, DataFrame]:
        """Constraints, on new rows where the tables they refer to can only have grown."""
        s = self.schema()
        ids = wrote.rows("entities", s["entities"]).select(F.col("entity_id").alias("_id"))
        shrunk = wrote.whole("entities")

        def fresh(table: str) -> DataFrame:
            return (wrote.rows if shrunk else wrote.new)(table, s[table])

        def lost(df: DataFrame, end: str) -> DataFrame:
            return df.where(F.col(end).isNotNull()).join(ids, F.col(end) == F.col("_id"), "left_anti")

        def twice(table: str, *by: str) -> DataFrame:
            new = wrote.new(table, s[table]).select(*by)
            old = new.join(wrote.old(table, s[table]).select(*by), list(by), "left_semi")
            return new.groupBy(*by).count().where("count > 1").select(*by).unionByName(old)

        edges = fresh("edges")
        return {
            "every edge has its ends": lost(edges, "src_id").unionByName(lost(edges, "dst_id")),
            "edges have ends and a kind": edges.where("src_id is null or dst_id is null or kind is null"),
            "an entity is stored once": twice("entities", "entity_id"),
            "entities have a type": wrote.new("entities", s["entities"]).where("entity_id is null or entity_type is null"),
            "a key has one owner": twice("sidecar", "entity_type", "key"),
            "an external id has one owner": twice("external_ids", "namespace", "value", "owner_type"),
            "every play event has its recording": lost((wrote.rows if shrunk else wrote.changed)("play_events", s["play_events"]), "recording_id"),
            "an item is stored once": twice("library_items", "user_id", "target_type", "target_id"),
            "every library item has its target": lost(fresh("library_items"), "target_id"),
            "a user is stored once": twice("users", "id"),
            "a source of a user has one watermark": twice("watermarks", "user_id", "source"),
        }


@dataclass
class Loaded:
    """The store, the commit and the frames that a state was read as."""

    path: str
    number: int
    tables: dict[str, DataFrame]


@dataclass
class Grown:
    """A table that was `of` and is `full` by a change."""

    of: DataFrame
    full: DataFrame
    change: X.Change


@dataclass
class Outcome:
    state: State
    instructions: DataFrame
    relationships: DataFrame
    materialized: DataFrame
    counters: DataFrame
    manual_review: DataFrame
    skip_reasons: DataFrame
    #: (what, n): entities, keys by which they are found again, edges and events that are new in the store.
    persisted: DataFrame


def claim_keys(claims: DataFrame) -> DataFrame:
    """Long key frame of claims (name, artist, duration_ms, sources, ids, child_ids)."""
    c = claims.withColumns({"n": normalize_text(F.col("name")), "a": normalize_text(F.col("artist"))})
    n, a, s, i = F.col("n"), F.col("a"), F.col("sources"), F.col("ids")
    by_type: dict[str, Column] = {
        "artist": K.artist_keys(n, s, i),
        "label": K.label_keys(n, s, i),
        "release_set": K.release_set_keys(n, a, s, i, F.col("child_ids")),
        "release": K.release_keys(n, a, s, i),
        "recording": K.recording_keys(n, a, F.col("duration_ms"), s, i),
    }
    keys = F.array().cast("array<string>")
    for kind, expr in by_type.items():
        keys = F.when(F.col("entity_type") == kind, expr).otherwise(keys)
    return K.explode_keys(c, keys)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """`df` with the columns of a schema that it lacks, as null."""
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ddl) if f.name not in df.columns])


def typed(df: DataFrame | None, ddl: str) -> DataFrame | None:
    """`df` with the columns and types of a schema."""
    return None if df is None else conform(df, ddl).select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(ddl)])


def number(df: DataFrame, what: str) -> DataFrame:
    """(what, n): how many rows there are."""
    return df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")


def _edge_key() -> Column:
    """Identity of a relationship with its payload; tracks and credits have different ones."""
    col = F.col
    track = K.track_payload(col("disc_number"), col("track_number"), normalize_text(col("title_override")), col("duration_ms"))
    credit = K.credit_payload(col("role"), col("credit_order"), normalize_text(col("credited_as")), normalize_text(col("join_phrase")))
    ends = (col("kind"), col("src_claim_id"), col("dst_claim_id"))
    return F.when(col("kind") == "release_track", K.relationship_key(*ends, track)).when(col("kind").isin(*schemas.LINKS), K.relationship_key(*ends, [])).otherwise(K.relationship_key(*ends, credit))


def reconcile(claims: DataFrame, rels: DataFrame, state: State) -> Outcome:
    """One batch against the stored state. Claims may have `facts`, relationships any of the
    columns of a payload."""
    claims = conform(claims, f"facts {schemas.FACTS}")
    rels = conform(rels, ", ".join(f"{k} {v}" for k, v in schemas.PAYLOAD_TYPES.items()))
    stored, edges = conform(state.entities, schemas.FULL_ENTITY), conform(state.edges, schemas.FULL_EDGE)
    bad = R.bad_endpoints(rels, claims, schemas.ENDS).limit(3).collect()
    if bad:
        raise ValueError(f"relationships that cannot be: {[tuple(r) for r in bad]}")
    keys = D.checkpointed(claim_keys(claims))
    _, dropped = D.dedupe_greedy(keys)
    dropped = D.checkpointed(dropped)
    kept = claims.join(dropped.select("claim_id"), "claim_id", "left_anti")
    kept_keys = keys.join(dropped.select("claim_id"), "claim_id", "left_anti")
    wired = D.rewire(rels, dropped)
    wired = D.collapse_relationships(wired.withColumn("rel_key", _edge_key())).drop("rel_key")

    claim_ids = kept.select("claim_id", "entity_type", F.posexplode("ids").alias("pos", "x")).select("claim_id", "entity_type", "pos", "x.namespace", "x.value")
    resolved = R.resolve_entities(kept, claim_ids, kept_keys, state.external_ids, state.redirects, state.sidecar, stored)
    decided = P.decide_entities(resolved.join(kept.select("claim_id", "confidence"), "claim_id"))
    decided = D.checkpointed(decided.withColumn("created_id", F.col("claim_id")))
    materialized = D.checkpointed(M.materialize(decided))

    # Fresh endpoints are looked up among the batch's own edges, as they were before rewiring.
    fresh = rels.select("kind", F.col("src_claim_id").alias("src_id"), F.col("dst_claim_id").alias("dst_id"), F.col("rel_id").alias("edge_id"))
    known = fresh.unionByName(edges.select("kind", "src_id", "dst_id", "edge_id"))
    ends = D.checkpointed(R.endpoints(wired, decided))
    is_link = F.col("kind").isin(*schemas.LINKS)
    found = R.resolve_associations(ends.where(~is_link), known).withColumn("candidate_ids", F.array().cast("array<string>"))
    # A stored edge takes the payload that is given, where it differs.
    was = edges.select(F.col("edge_id").alias("target_id"), F.lit(True).alias("_stored"), *[F.col(c).alias(f"_{c}") for c in schemas.PAYLOAD])
    differs = F.col("_stored") & P.payload_differs(schemas.PAYLOAD, [f"_{c}" for c in schemas.PAYLOAD])
    acted = P.decide_associations(found.join(was, "target_id", "left"), differs).drop("_stored", *[f"_{c}" for c in schemas.PAYLOAD])
    acted = D.checkpointed(acted)
    linked = D.checkpointed(P.decide_links(R.resolve_links(ends.where(is_link), edges)).withColumns({"candidate_ids": F.array().cast("array<string>"), "target_id": F.lit(None).cast("string")}))

    facts = ["name", "duration_ms", "sources", "facts"]
    new_entities = decided.where("strategy = 'create'").join(kept.select("claim_id", *facts), "claim_id").select(F.col("claim_id").alias("entity_id"), "entity_type", *facts)
    merging = decided.where("strategy = 'merge'").join(kept.select("claim_id", *facts), "claim_id")
    given = merging.select(F.col("target_id").alias("_k"), *[F.col(c).alias(f"_{c}") for c in facts])
    both = lambda rule, c: rule(F.col(c), F.col(f"_{c}")).alias(c)
    absorbed = F.when(F.col("_facts").isNull(), F.col("facts")).otherwise(M.absorb_facts(F.col("facts"), F.col("_facts"))).alias("facts")
    merged_row = ["entity_id", "entity_type", both(M.prefer_text, "name"), both(M.prefer_value, "duration_ms"), both(M.union_sources, "sources"), absorbed]
    old = stored.join(given, F.col("entity_id") == F.col("_k"), "left").select(*merged_row)
    was_row = F.struct(*facts).alias("_was")
    put_entities = stored.join(given, F.col("entity_id") == F.col("_k")).select(*merged_row, was_row).where(~F.col("_was").eqNullSafe(F.struct(*facts))).drop("_was")
    owners = materialized.select("claim_id", F.col("entity_id").alias("owner_id"))
    ids = claim_ids.join(owners, "claim_id").select("claim_id", "pos", "namespace", "value", F.col("entity_type").alias("owner_type"), "owner_id").withColumn("provider", provider_for(F.col("namespace")))
    by = ["namespace", "value", "owner_type"]
    owned = meeting(state.external_ids, materialized.select(F.col("entity_id").alias("owner_id")), ["owner_id"])
    # An id that says another value than its owner has is left out and reviewed.
    own_ids, clashing = M.absorb_external_ids(owned, ids)
    add_ids = X.insert_or_ignore(meeting(state.external_ids, claim_ids, ["namespace", "value"]), own_ids.select(*by, "owner_id", "provider"), by, ["owner_id"])
    rows = X.sidecar_rows(decided, kept_keys)
    add_keys = X.insert_or_ignore(meeting(state.sidecar, kept_keys, ["entity_type", "key"]), rows, ["entity_type", "key"], ["claim_ord", "key_ord"]).select("entity_type", "key", "entity_id")
    # Edges that resolved to their own fresh payload are stored too, though they count as skipped.
    put = acted.where("strategy = 'create' or (strategy = 'noop' and target_id = rel_id)").unionByName(linked.where("strategy = 'create'"))
    add_edges = put.select(F.col("rel_id").alias("edge_id"), "kind", "src_id", "dst_id", *schemas.PAYLOAD)
    merged = M.first_of(acted.where("strategy = 'merge'").select(F.col("target_id").alias("edge_id"), "rel_ord", *schemas.PAYLOAD), ["edge_id"], ["rel_ord"])
    held = edges.select("edge_id", *[c for c in edges.columns if c not in ("edge_id", *schemas.PAYLOAD)])
    put_edges = held.join(merged.drop("rel_ord"), "edge_id").select(*edges.columns)
    edges = M.overwrite_payload(edges, merged, schemas.PAYLOAD)
    ends_by = ["kind", "src_id", "dst_id"]
    add_edges = X.insert_or_ignore(meeting(edges, add_edges, ends_by), add_edges, ends_by, ["edge_id"])
    state = state.grown("entities", old.unionByName(new_entities), new_entities, put_entities, ("entity_id",))
    state = state.grown("edges", edges.unionByName(add_edges), add_edges, put_edges, ("edge_id",))
    state = state.add("external_ids", add_ids).add("sidecar", add_keys)
    of = lambda df, subject: df.select(F.lit(subject).alias("subject"), "strategy", "reason")
    every = of(decided, "entity").unionByName(of(acted, "association")).unionByName(of(linked, "link"))
    counts = M.counters(every)
    by_rel = lambda df: df.withColumn("claim_id", F.col("rel_id"))
    review = P.manual_review(decided, "entity").unionByName(P.manual_review(by_rel(acted), "association")).unionByName(P.manual_review(by_rel(linked), "link"))
    review = review.unionByName(clashing.select("claim_id", F.lit("external_id").alias("subject"), F.array("owner_id").alias("candidate_ids"), F.lit("external_id_conflict").alias("reason")))
    new = {"entities": new_entities, "keys": add_keys, "edges": add_edges}
    persisted = reduce(DataFrame.unionByName, [number(df, what) for what, df in new.items()])
    became = materialized.unionByName(dropped.join(materialized.withColumnRenamed("claim_id", "rep_claim_id"), "rep_claim_id").select("claim_id", "entity_id"))
    return Outcome(state, decided, acted.unionByName(linked), became, counts, review, P.skip_reasons(every), persisted)


def ingest_play_events(claims: DataFrame, rels: DataFrame, events: DataFrame, state: State, after: Column | None = None, until: Column | None = None) -> Outcome:
    """Scrobbles of a run: new events only, their claims reconciled, the events bound to what
    the claims became and stored with the catalog. A replay stores nothing."""
    known = meeting(state.play_events, events, ["user_id", "source", "played_at"])
    fresh = D.checkpointed(Inc.new_events(events, known, after, until))
    used = fresh.select(F.col("recording_claim_id").alias("_c")).distinct()
    pids = used.select(F.substring_index("_c", "|", -1).alias("_pid"))
    own = lambda df, c: df.join(pids, F.substring_index(c, "|", -1) == F.col("_pid"), "left_semi")
    out = reconcile(D.checkpointed(own(claims, "claim_id")), D.checkpointed(own(rels, "rel_id")), state)
    tracks = out.state.edges.where("kind = 'release_track'").select(F.col("edge_id").alias("claim_id"), F.col("edge_id").alias("entity_id"))
    bound = Inc.rebind(fresh, out.materialized.unionByName(tracks))
    stored = bound.select("user_id", "source", F.col("played_at").cast("timestamp").alias("played_at"), "recording_id", "track_id")
    out.state = out.state.add("play_events", stored)
    out.persisted = out.persisted.unionByName(number(stored, "events"))
    return out
