"""Merkle manifests of data sets: a tree over the rows of each group, and one over the groups.

Leaves are put in order by range, so a task holds a stretch of a tree. What it knows of the tree
is a sparse forest: nodes keyed by level and index, without those whose siblings are all known,
which have become their parent. Forests of adjacent stretches are merged, FAN at a time, and so
are the results, until one is left of each tree; a run of siblings, whose number follows from the
number of leaves, becomes its parent in the merge that completes it. The merge is associative and
commutative, and a forest has a few nodes a level, so no task holds more than FAN times that.
Nodes that other stretches need for their proofs are found by a join on level and index.

Cases: a null field is `-` in a leaf; a null group is the first one; null orders come first, and
rows equal in group and order follow one another by their digests; a lone leaf is its tree's root,
and of one group the root of all; repeated rows are leaves of their own; very long texts are hashed
in the JVM, where they are read; other columns are kept by `grow` and `paths` unless their names
begin with an underscore or are `path`, `subroot` or `root`; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from mergewell.llm import shared

ARITY = 3
#: Forests of so many adjacent stretches are merged in one task.
FAN = 32
STEP = "array<struct<before: string, after: string>>"
_NODE = "_tree string, _part long, _total long, level int, idx long, digest string, root boolean, pending boolean"
_FIELDS = pa.schema([("_tree", pa.string()), ("_part", pa.int64()), ("_total", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("root", pa.bool_()), ("pending", pa.bool_())])


def digest_of(text: Column) -> Column:
    """H: lowercase hex sha256."""
    return F.sha2(text.cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """H of the fields, each `-` if null, else its number of UTF-8 bytes, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return digest_of(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]))


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path make."""
    return F.aggregate(path, digest, lambda acc, step: digest_of(F.concat(step["before"], acc, step["after"])))


def proof(path: Column) -> Column:
    """H of the siblings on a path, level by level, left to right."""
    return digest_of(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""))


def _h(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def climb(first: int, digests: list[str], total: int) -> list[tuple[int, list[str]]]:
    """(first index, nodes) of each level of a tree of `total` leaves, as far as the leaves from
    `first` on tell: nodes all of whose leaves are among them."""
    levels, count = [(first, digests)], total
    while count > 1:
        low, nodes = levels[-1]
        end, above = low + len(nodes), -(-count // ARITY)
        start, stop = -(-low // ARITY), above if end == count else end // ARITY
        levels.append((start, [_h(nodes[ARITY * j - low : ARITY * (j + 1) - low]) for j in range(start, stop)]))
        count = above
    return levels


def open_nodes(levels: list[tuple[int, list[str]]]) -> list[tuple[int, int, str, bool]]:
    """(level, index, digest, whether it is the root) of the nodes that have no parent in `levels`."""
    out = []
    for level, (low, nodes) in enumerate(levels):
        top = level + 1 == len(levels)
        start, parents = (0, []) if top else levels[level + 1]
        used = range(ARITY * start, ARITY * (start + len(parents)))
        out += [(level, low + i, d, top) for i, d in enumerate(nodes) if low + i not in used]
    return out


def merge(nodes: dict[tuple[int, int], str], total: int) -> tuple[dict[tuple[int, int], str], dict[tuple[int, int], str], bool]:
    """(nodes without a parent, nodes that were made, whether the root is there) of a forest in
    which all runs of siblings that are complete have become their parents."""
    rest, made, level, count = dict(nodes), {}, 0, total
    while count > 1:
        runs: dict[int, list[int]] = {}
        for depth, i in rest:
            if depth == level:
                runs.setdefault(i // ARITY, []).append(i)
        for j, run in runs.items():
            if len(run) == min(ARITY, count - ARITY * j):
                made[level + 1, j] = rest[level + 1, j] = _h([rest.pop((level, i)) for i in sorted(run)])
        level, count = level + 1, -(-count // ARITY)
    return rest, made, (level, 0) in rest


@dataclass
class Forest:
    """Trees over the rows of `held`. `runs`: stretches of trees, with the index of their first
    leaf and the tree's number of leaves; `nodes`: those that stretches have in common; `roots`
    (_tree, root)."""

    held: DataFrame
    digest: str
    runs: DataFrame
    nodes: DataFrame
    roots: DataFrame


def grow(rows: DataFrame, group: Column, order: Column, digest: str) -> Forest:
    """A tree for each group, over its rows in order. Only digests and keys of rows move, once,
    by range; of each stretch a few nodes."""
    key = F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group.cast("string")))
    keyed, _ = shared.table(rows.withColumns({"_tree": key, "_order": order, "_row": F.monotonically_increasing_id()}))

    def number(batches):
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            nth = np.arange(batch.num_rows)
            trees = pc.run_end_encode(batch.column(batch.schema.get_field_index("_tree")))
            start = 0
            for end, tree in zip(trees.run_ends.to_pylist(), trees.values.to_pylist(), strict=True):
                seen = seen if tree == last else 0
                nth[start:end] += seen - start
                last, seen, start = tree, seen + end - start, end
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part)), pa.array(nth)], [*batch.schema.names, "_part", "_nth"])

    sort = [F.col("_tree"), F.col("_order").asc_nulls_first(), F.col(digest), F.col("_row")]
    dealt = keyed.repartitionByRange(*sort).sortWithinPartitions(*sort).drop("_order", "_row")
    numbered = StructType([*dealt.schema.fields, StructField("_part", LongType()), StructField("_nth", LongType())])
    held, _ = shared.table(dealt.mapInArrow(number, numbered))
    counts = held.groupBy("_tree", "_part").agg(F.count("*").alias("n"))
    runs, _ = shared.table(shared.before(counts, ["_tree"], "_part", "n"))

    def forests(leaves: pa.Table, own: pa.Table) -> pa.Table:
        where = {r["_tree"]: r for r in own.to_pylist()}
        out = []
        for tree, digests in _stretches(leaves, digest):
            r = where[tree]
            out += [(tree, r["_part"], r["_total"], *node, not node[3]) for node in open_nodes(climb(r["_before"], digests, r["_total"]))]
        return _nodes(out)

    own = held.select("_tree", "_part", "_nth", digest).groupBy("_part")
    latest, _ = shared.table(own.cogroup(runs.select("_tree", "_part", "_before", "_total").groupBy("_part")).applyInArrow(forests, _NODE))
    every, parts = [latest], runs.agg(F.max("_part")).first()[0] or 0

    def merged(met: pa.Table) -> pa.Table:
        first = met.slice(0, 1).to_pylist()[0]
        known = {(level, i): d for level, i, d in zip(*(met.column(c).to_pylist() for c in ("level", "idx", "digest")), strict=True)}
        rest, made, done = merge(known, first["_total"])
        rooted = max(rest)[0] if done else None
        tree, part, total = first["_tree"], first["_part"] // FAN, first["_total"]
        out = [(tree, part, total, level, i, d, level == rooted, level != rooted) for (level, i), d in rest.items()]
        out += [(tree, part, total, level, i, d, False, False) for (level, i), d in made.items() if (level, i) not in rest]
        return _nodes(out)

    while parts:
        latest, _ = shared.table(latest.where("pending").groupBy("_tree", F.floor(F.col("_part") / FAN).alias("_block")).applyInArrow(merged, _NODE))
        every.append(latest)
        parts //= FAN
    nodes = reduce(DataFrame.union, every)
    return Forest(held, digest, runs, nodes, nodes.where("root").select("_tree", F.col("digest").alias("root")))


def paths(forest: Forest, above: DataFrame | None = None) -> DataFrame:
    """The rows of `forest` with `subroot`, the root of their tree, and `path`: the siblings before
    and after, level by level; those of `above` (_tree, path, top), a tree over the roots, follow,
    and its root is `root`, else null."""
    digest = forest.digest

    def outer(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                low, end, count, width = r["_before"], r["_before"] + r["n"], r["_total"], 1
                first, last, level = low, end - 1, 0
                while count > 1:
                    around = {i for j in (first // ARITY, last // ARITY) for i in range(ARITY * j, min(ARITY * (j + 1), count))}
                    out += [(r["_tree"], r["_part"], level, i) for i in around if i * width < low or min((i + 1) * width, r["_total"]) > end]
                    first, last, level, count, width = first // ARITY, last // ARITY, level + 1, -(-count // ARITY), width * ARITY
            cols = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["_tree", "_part", "level", "idx"])

    wanted = forest.runs.where("n < _total").mapInArrow(outer, "_tree string, _part long, level int, idx long")
    there = forest.nodes.select("_tree", "level", "idx", "digest").dropDuplicates(["_tree", "level", "idx"])
    around = wanted.join(there, ["_tree", "level", "idx"])
    none = F.lit(None).cast(STEP)
    no_top = F.lit(None).cast("string").alias("top")
    rest = forest.roots.select("*", none.alias("path"), no_top) if above is None else forest.roots.join(above.select("_tree", "path", "top"), "_tree")
    tops = forest.runs.join(rest, "_tree").select("_tree", "_part", F.lit(-1).alias("level"), F.col("_before").alias("idx"), F.col("root").alias("digest"), "_total", "path", "top")
    context = around.select("_tree", "_part", "level", "idx", "digest", F.lit(None).cast("long").alias("_total"), none.alias("path"), no_top).union(tops)
    kept = [f for f in forest.held.schema.fields if not f.name.startswith("_")]

    def along(leaves: pa.Table, own: pa.Table) -> pa.Table:
        leaves = leaves.sort_by([("_tree", "ascending"), ("_nth", "ascending")])
        known: dict[str, dict] = {}
        tops: dict[str, dict] = {}
        for r in own.to_pylist():
            if r["level"] < 0:
                tops[r["_tree"]] = r
            else:
                known.setdefault(r["_tree"], {})[r["level"], r["idx"]] = r["digest"]
        steps: list[list[dict]] = []
        subroots: list[str] = []
        roots: list[str | None] = []
        for tree, digests in _stretches(leaves, digest):
            top, others = tops[tree], known.get(tree, {})
            levels = climb(top["idx"], digests, top["_total"])
            for i in range(top["idx"], top["idx"] + len(digests)):
                count, path = top["_total"], []
                for level, (low, nodes) in enumerate(levels[:-1]):
                    start = i - i % ARITY
                    run = [nodes[k - low] if low <= k < low + len(nodes) else others.get((level, k), "") for k in range(start, min(start + ARITY, count))]
                    path.append({"before": "".join(run[: i - start]), "after": "".join(run[i - start + 1 :])})
                    i, count = i // ARITY, -(-count // ARITY)
                steps.append(path + (top["path"] or []))
                subroots.append(top["digest"])
                roots.append(top["top"])
        step = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        return pa.table([*[leaves.column(f.name) for f in kept], leaves.column("_tree"), pa.array(subroots, pa.string()), pa.array(roots, pa.string()), pa.array(steps, step)], [*[f.name for f in kept], "_tree", "subroot", "root", "path"])

    out = StructType([*kept, *StructType.fromDDL(f"_tree string, subroot string, root string, path {STEP}").fields])
    return forest.held.groupBy("_part").cogroup(context.groupBy("_part")).applyInArrow(along, out)


def manifest(leaves: DataFrame, group: str, order: str, digest: str = "leaf") -> DataFrame:
    """`leaves` with `subroot`, `root` and `path`, that from the leaf to the root of all: a tree for
    each group, and one over their roots, in the order of the groups' bytes, nulls first."""
    trees = grow(leaves, F.col(group), F.col(order), digest)
    roots, _ = shared.table(trees.roots)
    trees.roots = roots
    whole = grow(roots.select(F.col("_tree").alias("tree"), F.col("root").alias("node")), F.lit(None), F.col("tree"), "node")
    above = paths(whole).select(F.col("tree").alias("_tree"), "path", F.col("subroot").alias("top"))
    return paths(trees, above).drop("_tree")


def _stretches(leaves: pa.Table, digest: str) -> list[tuple[str, list[str]]]:
    """(tree, digests in order) of the rows of one task's stretch."""
    leaves = leaves.sort_by([("_tree", "ascending"), ("_nth", "ascending")])
    trees, digests = leaves.column("_tree").to_pylist(), leaves.column(digest).to_pylist()
    edges = [i for i in range(len(trees)) if i == 0 or trees[i] != trees[i - 1]] + [len(trees)]
    return [(trees[a], digests[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def _nodes(rows: list[tuple]) -> pa.Table:
    cols = zip(*rows, strict=True) if rows else [[] for _ in _FIELDS]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(cols, _FIELDS, strict=True)], schema=_FIELDS)
