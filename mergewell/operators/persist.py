"""Writes: keyed inserts and upserts over versioned Parquet tables.

A store is a folder with one folder a version and one numbered pointer a commit; the pointer with
the highest number is current and lists the parts that each table is made of. A commit writes what
changed as new parts, checks the constraints on what it wrote, writes its pointer beside and renames
it into place last: whenever a run dies, the version before it is whole and current. A commit that
another one came before fails.

A part is the whole of a table, rows added under new keys, or rows put in place of those with their
keys. Parts added since the whole one are rewritten as one when there are many, and the table as a
whole when they outweigh it, so the writing of a commit grows with what changes, not with the store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mergewell.operators.keys import first_in_window

#: Order of writing by entity type: owners before what refers to them.
PRIORITY = {"user": 0, "artist": 1, "label": 1, "release_set": 2, "release": 3, "recording": 4, "library_item": 5, "play_event": 6}


def persist_order(entity_type: str = "entity_type"):
    out = F.lit(99)
    for name, rank in PRIORITY.items():
        out = F.when(F.col(entity_type) == name, rank).otherwise(out)
    return out


def insert_or_ignore(stored: DataFrame, incoming: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows to insert: the first of each key that is not stored. The first owner keeps a key.
    Keys are reduced to one candidate by a partial aggregate before they meet the store."""
    cols = [c for c in incoming.columns if c not in by]
    first = incoming.groupBy(*by).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_f")).select(*by, "_f.*")
    return first.join(stored.select(*by), by, "left_anti")


def sidecar_rows(instructions: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys to own: created entities and merge or noop targets; nothing for reviewed claims."""
    target = F.when(F.col("strategy") == "create", F.coalesce("created_id", "claim_id")).otherwise(F.col("target_id"))
    owners = instructions.where("strategy <> 'manual_review'").select("claim_id", target.alias("entity_id"))
    return keys.join(owners, "claim_id").select("entity_type", "key", "entity_id", "claim_ord", "key_ord")


def keys_gained(inserted: DataFrame) -> DataFrame:
    """(entity_type, entity_id, n): how many keys each entity owns now that nobody owned before. Keys
    that another entity holds, or that the entity had, are not among the inserted ones."""
    return inserted.groupBy("entity_type", "entity_id").agg(F.count("*").alias("n"))


def upsert(stored: DataFrame, incoming: DataFrame, by: list[str]) -> DataFrame:
    """Stored rows with the incoming ones (at most one a key) in their place."""
    return stored.join(incoming.select(*by), by, "left_anti").unionByName(incoming, allowMissingColumns=True)


def upsert_redirects(stored: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """Redirects by namespace and source: the last one given wins; one to itself is ignored."""
    real = incoming.where("source_value <> target_value")
    if order:
        real = first_in_window(real, ["namespace", "source_value"], [F.col(order).desc()]).drop(order)
    return upsert(stored, real, ["namespace", "source_value"])


@dataclass
class Change:
    """What a commit changes in a table: rows under keys that it does not have yet, and rows that
    take the place of those with the same key (`by`). Neither: the table stays as it is."""

    added: DataFrame | None = None
    put: DataFrame | None = None
    by: tuple[str, ...] = ()


@dataclass
class Snapshot:
    """A commit: its number, its version and the parts of each table, oldest first."""

    number: int
    version: str | None
    tables: dict[str, list[dict]]


@dataclass
class Written:
    """A commit's tables as written, before they become current, for constraints to look at."""

    store: Store
    before: Snapshot
    after: Snapshot
    fresh: dict[str, list[dict]]

    def whole(self, table: str) -> bool:
        """Whether the commit writes the table anew, so that rows may be gone."""
        return any(p["kind"] == "whole" for p in self.fresh.get(table, []))

    def rows(self, table: str, schema: StructType | str) -> DataFrame:
        """The table as it will be."""
        return self.store.assemble(self.after.tables.get(table, []), schema)

    def new(self, table: str, schema: StructType | str) -> DataFrame:
        """Rows under new keys; the whole table where it is written anew."""
        return self.store.assemble([p for p in self.fresh.get(table, []) if p["kind"] != "put"], schema)

    def changed(self, table: str, schema: StructType | str) -> DataFrame:
        """Rows under new keys and rows that were put; the whole table where it is written anew."""
        return self.store.assemble(self.fresh.get(table, []), schema)

    def old(self, table: str, schema: StructType | str) -> DataFrame:
        """Rows that were stored before; none where the table is written anew."""
        return self.store.assemble([] if self.whole(table) else self.before.tables.get(table, []), schema)


class Store:
    """Versioned tables under one path, read and written through Spark only."""

    #: Parts that a table may have besides the whole one before they are written as one.
    PARTS = 16

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._base: int | None = None  # number of the commit that was read

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def last(self) -> Snapshot:
        """The last commit."""
        fs, path = self._fs()
        at = path(f"{self.path}/commits")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        number = max((int(n) for n in names if n.isdigit()), default=0)
        if not number:
            return Snapshot(0, None, {})
        stream = fs.open(path(f"{self.path}/commits/{number:012d}"))
        try:
            held = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Snapshot(number, held["version"], held["tables"])

    def version(self) -> str | None:
        return self.last().version

    def _point(self, snapshot: Snapshot) -> None:
        """Makes a snapshot the current one, unless its number is taken: one rename."""
        fs, path = self._fs()
        jvm = self.spark._jvm
        beside = path(f"{self.path}/commits/next-{snapshot.version}")
        out = fs.create(beside, False)
        out.write(json.dumps({"version": snapshot.version, "tables": snapshot.tables}).encode())
        out.close()
        uri = beside.toUri() if beside.toUri().getScheme() else fs.getUri()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self.spark._jsc.hadoopConfiguration())
        place = path(f"{self.path}/commits/{snapshot.number:012d}")
        no_options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(fs.makeQualified(beside), fs.makeQualified(place), no_options)

    def assemble(self, parts: list[dict], schema: StructType | str) -> DataFrame:
        """A table from its parts: rows whose key was put later give way to the last put. A plain
        scan where nothing was put; else the keys that were put meet the scan in one anti-join,
        which Spark broadcasts while they are few."""
        if not parts:
            return self.spark.createDataFrame([], schema)
        at = lambda some: self.spark.read.schema(schema).parquet(*[f"{self.path}/{p['folder']}" for p in some])
        puts = [p for p in parts if p["kind"] == "put"]
        rest = [p for p in parts if p["kind"] != "put"]
        if not puts:
            return at(rest)
        by, every = puts[0]["by"], None
        for turn, part in enumerate(puts):
            one = at([part]).withColumn("_turn", F.lit(turn))
            every = one if every is None else every.unionByName(one)
        cols = [c for c in every.columns if c not in (*by, "_turn")]
        last = every.groupBy(*by).agg(F.max_by(F.struct(*cols), "_turn").alias("_f")).select(*by, "_f.*")
        return last if not rest else at(rest).join(every.select(*by), list(by), "left_anti").unionByName(last)

    def read(self, table: str, schema: StructType | str, snapshot: Snapshot | None = None) -> DataFrame:
        """A table of a snapshot, by default of the last commit; empty if there is none yet.
        Columns that a part lacks are null."""
        if snapshot is None:
            snapshot = self.last()
            self._base = snapshot.number
        return self.assemble(snapshot.tables.get(table, []), schema)

    def commit(
        self,
        tables: dict[str, DataFrame | Change],
        constraints: dict[str, DataFrame] | Callable[[Written], dict[str, DataFrame]] | None = None,
        since: int | None = None,
    ) -> str:
        """Writes the next version: a frame is a table anew, a `Change` what changes in it, and
        tables not named stay. `constraints` are frames that must be empty, or make them from what
        was written; `since` is the number of the commit that the caller read."""
        before = self.last()
        if since is None:
            since = before.number if self._base is None else self._base
        if since != before.number:
            raise ValueError("constraint violated: another commit came first")
        version = f"v{uuid.uuid4().hex}"
        after, fresh = Snapshot(since + 1, version, dict(before.tables)), {}
        for name, given in tables.items():
            parts = before.tables.get(name, [])
            fresh[name] = self._write(f"{version}/{name}", given, not parts)
            kept = [] if isinstance(given, DataFrame) else parts
            after.tables[name] = self._merged(f"{version}/{name}/merged", kept + fresh[name])
        rules = constraints(Written(self, before, after, fresh)) if callable(constraints) else constraints or {}
        broken = next((name for name, rows in rules.items() if not rows.isEmpty()), None)
        if broken is None and self.last().number != since:
            broken = "another commit came first"
        if broken is not None:
            fs, path = self._fs()
            fs.delete(path(f"{self.path}/{version}"), True)
            raise ValueError(f"constraint violated: {broken}")
        self._point(after)
        self._base = after.number
        return version

    def _part(self, folder: str, df: DataFrame, kind: str, by: list[str]) -> dict:
        df.write.parquet(f"{self.path}/{folder}/{kind}")
        return {"folder": f"{folder}/{kind}", "kind": kind, "by": by, "bytes": self._bytes(f"{folder}/{kind}")}

    def _write(self, folder: str, given: DataFrame | Change, first: bool) -> list[dict]:
        """The parts that a change adds; those without rows are left out."""
        if isinstance(given, DataFrame):
            return [self._part(folder, given, "whole", [])]
        fresh = []
        if given.added is not None:
            fresh.append(self._part(folder, given.added, "whole" if first else "added", []))
        if given.put is not None:
            fresh.append(self._part(folder, given.put, "put", list(given.by)))
        return [p for p in fresh if p["bytes"] or p["kind"] == "whole"]

    def _merged(self, folder: str, parts: list[dict]) -> list[dict]:
        """Parts with the later ones written as one of a kind where there are many, and all as one
        where the later ones outweigh the first."""
        later = parts[1:]
        if len(later) <= self.PARTS:
            return parts
        schema = self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{p['folder']}" for p in parts]).schema
        if sum(p["bytes"] for p in later) > parts[0]["bytes"]:
            return [self._part(folder, self.assemble(parts, schema), "whole", [])]
        out = parts[:1]
        for kinds in (("added", "whole"), ("put",)):
            some = [p for p in later if p["kind"] in kinds]
            if some:
                out.append(self._part(folder, self.assemble(some, schema), kinds[0], some[0]["by"]))
        return out

    def _bytes(self, folder: str) -> int:
        """Bytes of the files that hold rows; 0 where there are none."""
        rows = self.spark.read.parquet(f"{self.path}/{folder}")
        if rows.isEmpty():
            return 0
        fs, path = self._fs()
        return fs.getContentSummary(path(f"{self.path}/{folder}")).getLength()

    def written(self, version: str, table: str) -> DataFrame:
        """A table that some version wrote anew, as it was written."""
        return self.spark.read.parquet(f"{self.path}/{version}/{table}/whole")
