"""N-gram Jaccard self-join by chosen paths.

A text is the set of its SHINGLE-word sequences (a shorter text is one sequence of all its
words). Texts with equal sets are one node with a multiplicity, named by a number of its own. In
each run a node follows a path of sampled tokens: the token with the smallest hash under the
run's function, then the smallest under a function drawn by the path so far, and so on. Two sets
of similarity s stay together for d levels with probability about s**d. A bucket of at most SMALL
nodes is a leaf and is compared by brute force on 64-bucket sketches; a larger one is split by
the next level, without an end: after DEPTH levels over all tokens the positions of the sketch
are the sampled tokens, in an order drawn by the run. There each member is first compared with a
member drawn by the bucket. The similar ones are tied to it, and the very similar ones need go no
further: by the triangle inequality of the Jaccard distance whatever is similar to them is tied to
the same member. So a big group of near copies ends at once and others are split until small.

Runs repeat until the target recall: `runs_for` gives the number after which a pair at the
threshold is missed with probability 1 - RECALL when it takes DEPTH levels to separate (10 runs
at 0.8), and far less above the threshold.

All this only proposes groups. The exact check follows: each proposed group meets in blocks of
BLOCK sets and BLOCK_TOKENS tokens about, every pair of blocks in a task of its own, which counts
exact intersections. So the links are exact (each pair of a group is verified once), a group of
any size is spread over tasks, and no pair is ever emitted: blocks return a count and a parent in
a tree of low degree per node. Only the texts of grouped nodes are turned into sets again; a
bounded bitmap of their ids finds them where they are, so other texts don't move.

Cases: texts without words link to nothing and are their own class; rows with a null id take
the smallest id of their class, null where it has none; equal texts (repeated rows too) are linked to each other;
one id on several texts stands for each of them; a very long text is one set, held by one task;
extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergewell.llm import membership, shared, vec
from mergewell.llm.components import components, tree

SHINGLE, SIMILARITY = 5, 0.8
RECALL, DEPTH, SMALL = 0.999, 3, 256
BLOCK, BLOCK_TOKENS = 512, 1 << 19
SKETCH = 64
_REKEY = 0x5DEECE66D
#: Sketches of a pair at the threshold agree by less than LOW under it once in some 30,000 pairs.
LOW, TIE, LEAVE = 0.2, 0.25, 0.05
U64 = np.uint64
_SALTS = vec.mix(np.arange(1, 4096, dtype=U64))


def sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, distinct and sorted within each row, and the rows' offsets)."""
    starts, ends, first = vec.word_spans(data, off)
    words = vec.word_hashes(data, starts, ends)
    whole = vec.whole_grams(first, k)
    tokens = vec.gram_hashes(words, k)[whole] if len(whole) else np.zeros(0, U64)
    row = np.searchsorted(first, whole, side="right") - 1
    size = np.diff(first)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        tokens = np.concatenate([tokens, vec.span_hashes(words, first[short], first[short + 1])])
        row = np.concatenate([row, short])
    order = np.lexsort((tokens, row))
    row, tokens = row[order], tokens[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (tokens[1:] != tokens[:-1])
    row, tokens = row[new], tokens[new]
    return tokens, np.searchsorted(row, np.arange(len(off)))


def runs_for(similarity: float, recall: float = RECALL) -> int:
    """How many runs find a pair at the threshold with the asked-for probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min(similarity, 0.99) ** DEPTH)))


def paths(tokens: np.ndarray, off: np.ndarray, runs: int) -> np.ndarray:
    """Rows x runs x DEPTH path keys; every row has tokens."""
    size = np.diff(off)
    out = np.zeros((len(size), runs, DEPTH), U64)
    for r in range(runs):
        key = np.full(len(size), _SALTS[r], U64)
        for d in range(DEPTH):
            salt = key if d else key[:1]
            h = (tokens ^ (np.repeat(salt, size) if d else salt)) * _SALTS[100 + r * DEPTH + d]
            h ^= h >> U64(32)
            key = vec.mix(np.minimum.reduceat(h, off[:-1]) ^ (key * U64(3)))
            out[:, r, d] = key
    return out


def sketch(tokens: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows x SKETCH smallest hashes by bucket, 16 bits each; 0 is an empty bucket."""
    n = len(off) - 1
    h = vec.mix(tokens ^ _SALTS[50])
    low = np.full(n * SKETCH, np.iinfo(U64).max, U64)
    np.minimum.at(low, np.repeat(np.arange(n), np.diff(off)) * SKETCH + (h & U64(SKETCH - 1)).astype(np.int64), h)
    return np.where(low == np.iinfo(U64).max, 0, (low >> U64(6)) % U64(65535) + U64(1)).astype(np.uint16).reshape(n, SKETCH)


def _names(tokens: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's set; every row has tokens."""
    return tuple(np.add.reduceat(vec.mix(tokens ^ salt), off[:-1]).view(np.int64) for salt in _SALTS[60:62])


def _sets(docs: DataFrame, k: int, runs: int) -> DataFrame:
    """(doc_id, a, b, n, sketch, keys): two set hashes, the size of the set, the sketch and the
    path keys of each row with words."""

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, "text"):
                tokens, off = sets(*vec.text_bytes(part.column(1)), k)
                some = np.flatnonzero(np.diff(off))
                if not len(some):
                    continue
                off = np.append(off[some], off[-1])
                a, b = _names(tokens, off)
                raw = sketch(tokens, off)
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * SKETCH), len(some), [None, pa.py_buffer(raw.tobytes())])
                keys = paths(tokens, off, runs).reshape(-1).view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * (runs * DEPTH), pa.array(keys))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), pa.array(a), pa.array(b), pa.array(np.diff(off)), fixed.cast(pa.binary()), lists], ["doc_id", "a", "b", "n", "sketch", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, a long, b long, n long, sketch binary, keys array<long>")


def _alike(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Estimated similarity of pairs of sketches."""
    used = ((p != 0) | (q != 0)).sum(axis=1)
    return ((p == q) & (p != 0)).sum(axis=1) / np.maximum(used, 1)


def _compare_leaves(low: float):
    """From (leaf, node, sketch) rows in order of leaf: a spanning tree of the nodes of each leaf
    whose sketches are alike."""

    def trees(leaf, node, table):
        begin = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
        size = np.diff(np.append(begin, len(leaf)))
        for c in np.unique(size[size > 1]):
            at = begin[size == c]
            i, j = np.triu_indices(c, 1)
            for some in np.array_split(at, max(1, len(at) * len(i) // 50_000)):
                x, y = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                alike = _alike(table[x], table[y]) >= low
                x, y = x[alike], y[alike]
                if c == 2:
                    yield node[x], node[y]
                    continue
                root = np.arange(len(leaf))
                keep = np.zeros(len(x), bool)
                for n, (u, v) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
                    while root[u] != u:
                        root[u] = root[root[u]]
                        u = root[u]
                    while root[v] != v:
                        root[v] = root[root[v]]
                        v = root[v]
                    if u != v:
                        root[v] = u
                        keep[n] = True
                yield node[x[keep]], node[y[keep]]

    def run(batches):
        held = None
        for batch in batches:
            leaf, node = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            table = _table(batch.column(2))
            if held is not None:
                leaf, node, table = (np.concatenate(x) for x in zip(held, (leaf, node, table), strict=True))
            if not len(leaf):
                continue
            last = int(np.searchsorted(leaf, leaf[-1]))
            held = leaf[last:], node[last:], table[last:]
            for a, b in trees(leaf[:last], node[:last], table[:last]) if last else ():
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        if held is not None:
            for a, b in trees(*held):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _table(sketches: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches.to_pylist()), np.uint16).reshape(-1, SKETCH)


def _judge(similarity: float, level: int, small: int):
    """From (bucket, run, node, sketch, size, pivot, pivot_sketch) rows: ties (a, b) of the members
    of large buckets that are similar to their pivot, a tree in each batch; of those that go on
    the next bucket; of leaves the rows, without a run."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches):
        for batch in batches:
            bucket, runs, node, size, pivot = (np.asarray(batch.column(i)) for i in (0, 1, 2, 4, 5))
            own = _table(batch.column(3))
            alike = _alike(own, _table(batch.column(6)))
            tied = np.flatnonzero((size > small) & (alike >= similarity - TIE) & (node != pivot))
            tied = tied[np.lexsort((node[tied], bucket[tied]))]
            a, b = [], []
            for some in np.split(tied, np.flatnonzero(np.diff(bucket[tied])) + 1) if len(tied) else ():
                group = [int(pivot[some[0]]), *node[some].tolist()]
                a += tree(group)
                b += group[1:]
            leaf = np.flatnonzero(size <= small)
            stay = np.flatnonzero((size > small) & (alike < similarity - LEAVE))
            place = (level * (2 * runs[stay] + 1) + runs[stay] * 7) % SKETCH  # odd steps visit every position
            to = vec.mix(bucket[stay].view(U64) ^ vec.mix(own[stay, place].astype(U64) + U64(1)) + U64(level)).view(np.int64)
            rest = np.concatenate([leaf, stay])
            cols = [np.concatenate([bucket[leaf], to]), np.concatenate([np.full(len(leaf), -1), runs[stay]]), node[rest]]
            ties = [pa.array(x, k) for x, k in zip((a, b), kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([*ties, *(pa.nulls(len(a), k) for k in kinds[2:]), pa.nulls(len(a), pa.binary())], _JUDGED)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(rest), k) for k in kinds[:2]), *(pa.array(x).cast(k) for x, k in zip(cols, kinds[2:], strict=True)), batch.column(3).take(pa.array(rest))], _JUDGED)

    return run


_JUDGED = ["a", "b", "bucket", "run", "node", "sketch"]


def propose(nodes: DataFrame, runs: int, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) edges between nodes (node, sketch, keys) that some run leaves together."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.struct(r.alias("run"), *[F.get("keys", r * DEPTH + d).alias(f"k{d}") for d in range(DEPTH)]))
    rest = nodes.select("node", F.explode(path).alias("k")).select("node", "k.*")
    # All levels at once: paths are counted, and the counts of a path's beginnings added up.
    begins = lambda d: [f"k{e}" for e in range(d + 1)]
    sizes = {f"size{d}": F.sum("n").over(Window.partitionBy(*begins(d))) for d in range(DEPTH)}
    counted = rest.groupBy(*begins(DEPTH - 1)).agg(F.count("*").alias("n")).withColumns(sizes).where("size0 > 1")
    # The other key makes Spark deal out both sides for this join alone, so that it can split
    # the bucket of a group that holds a large share of all nodes.
    other = F.col(f"k{DEPTH - 1}").bitwiseXOR(F.lit(_REKEY)).alias("rekeyed")
    met = rest.withColumn("rekeyed", other).join(counted.select("k0", other, *sizes), ["k0", "rekeyed"])
    leaf = F.coalesce(*[F.when(F.col(f"size{d}") <= SMALL, F.struct(F.col(f"k{d}").alias("key"), F.col(f"size{d}").alias("size"))) for d in range(DEPTH)])
    leaves = met.select(leaf.alias("leaf"), "node").where("leaf.size > 1").select(F.col("leaf.key").alias("leaf"), "node")
    rest = met.where(F.col(f"size{DEPTH - 1}") > SMALL)
    sketches = nodes.select("node", "sketch")
    open_, _ = shared.table(rest.select(F.col(f"k{DEPTH - 1}").alias("bucket"), "run", "node").join(sketches, "node").select("bucket", "run", "node", "sketch"))
    met = leaves.join(sketches, "node").select("leaf", "node", "sketch")
    ties = None
    # After SKETCH levels members of a bucket have equal sketches, so there are no more levels.
    for level in range(SKETCH + 1):
        sizes = open_.groupBy("bucket").agg(F.count("*").alias("size"), F.min_by(F.struct("node", "sketch"), F.xxhash64("bucket", "node")).alias("p")).where("size > 1")
        sizes, buckets = shared.table(sizes.select("bucket", "size", F.col("p.node").alias("pivot"), F.col("p.sketch").alias("pivot_sketch")))
        if not buckets:
            break
        total = sizes.agg(F.sum("size")).first()[0]
        all_ = shared.meet(open_, sizes, ["bucket"], "size", total, F.col("node")).select("bucket", "run", "node", "sketch", "size", "pivot", "pivot_sketch")
        judged, _ = shared.table(all_.mapInArrow(_judge(similarity, level, SMALL), "a long, b long, bucket long, run int, node long, sketch binary"))
        more = judged.where("a is not null").select("a", "b")
        ties = more if ties is None else ties.union(more)
        met = met.union(judged.where("run < 0").select(F.col("bucket").alias("leaf"), "node", "sketch"))
        open_ = judged.where("run >= 0").select("bucket", "run", "node", "sketch")
    alike = met.repartition(parts, "leaf").sortWithinPartitions("leaf").mapInArrow(_compare_leaves(similarity - LOW), "a long, b long")
    return (alike if ties is None else alike.union(ties)).distinct()


def _verify(similarity: float):
    """Exact links within and between two blocks of sets, from (grp, x, y, block, node, copies,
    tokens) rows in order of group and pair of blocks."""

    def links(block, node, copies, tokens):
        size = np.array([len(t) // 8 for t in tokens], np.int64)
        m = len(node)
        flat = np.frombuffer(b"".join(tokens), U64)
        row = np.repeat(np.arange(m), size)
        _, back, n = np.unique(flat, return_inverse=True, return_counts=True)
        common = np.zeros((m, m), np.float32)
        shared_ = np.flatnonzero(n > 1)
        place = np.full(len(n), -1, np.int64)
        place[shared_] = np.arange(len(shared_))
        col = place[back]
        row, col = row[col >= 0], col[col >= 0]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for lo in range(0, len(shared_), 4096):
            a, b = np.searchsorted(col, [lo, lo + 4096])
            part = np.zeros((m, min(4096, len(shared_) - lo)), np.float32)
            part[row[a:b], col[a:b] - lo] = 1
            common += part @ part.T
        total = (size[:, None] + size[None, :]).astype(np.float64)
        near = common.astype(np.float64) * (1 + similarity) >= similarity * total - 1e-6
        if len(np.unique(block)) > 1:
            near &= block[:, None] != block[None, :]
        np.fill_diagonal(near, False)
        count = near @ copies.astype(np.float64)
        root = np.arange(m)
        while True:  # smallest connected row of the block pair
            low = np.where(near, root[None, :], m).min(axis=1)
            new = np.minimum(root, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        order = np.argsort(root, kind="stable")
        parent = node.copy()
        for some in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
            parent[some[1:]] = tree(node[some].tolist())
        return count.astype(np.int64), parent

    def run(batches):
        held, key = [], None

        def flush():
            block, node, copies, tokens = zip(*held, strict=True)
            count, parent = links(np.array(block), np.array(node, np.int64), np.array(copies), tokens)
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(count), pa.array(parent)], ["node", "links", "parent"])

        for batch in batches:
            for g, x, y, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, x, y) != key and held:
                    yield flush()
                    held = []
                key = (g, x, y)
                held.append(rest)
        if held:
            yield flush()

    return run


_NO_ID = -(1 << 63)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """`id_col`, class_id (the smallest id of the class) and n_links (other rows whose sets are
    at least as similar as asked) for every row."""
    runs = runs_for(similarity, recall)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seen, n_rows = shared.table(_sets(rows, k, runs))
    # Equal sets have equal sizes, sketches and keys. A node's name is a number: ids may repeat.
    one = [F.any_value(c).alias(c) for c in ("n", "sketch", "keys")]
    nodes = shared.cut(seen.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), *one).withColumn("node", F.monotonically_increasing_id()))
    groups = components(propose(nodes.select("node", "sketch", "keys"), runs, similarity)).select("node", F.col("root").alias("grp"))
    grouped, total = shared.table(nodes.select("node", "a", "b", "least", "copies", "n").join(groups, "node"))
    # Blocks of each group: by a hash, without gathering the group.
    sizes = grouped.groupBy("grp").agg(F.count("*").alias("size"), F.sum("n").alias("tokens"))
    sizes = sizes.withColumn("blocks", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("tokens") / BLOCK_TOKENS)).cast("int"))
    placed = shared.meet(grouped, sizes, ["grp"], "size", total, F.col("node"))
    placed = placed.select("a", "b", "least", "node", "copies", "grp", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"))
    known = membership.members(grouped.select("least"), total)
    asked = membership.where_maybe(rows, "doc_id", known)
    if grouped.where("least is null").limit(1).count():  # sets that only rows without an id have
        asked = asked.withColumn("maybe", F.col("maybe") | F.col("doc_id").isNull())

    def tokens(batches):
        for batch in batches:
            for part in vec.slices(batch, "text"):
                flat, off = sets(*vec.text_bytes(part.column(1)), k)
                some = np.flatnonzero(np.diff(off))
                if not len(some):
                    continue
                a, b = _names(flat, np.append(off[some], off[-1]))
                raw = pa.array([flat[off[i] : off[i + 1]].tobytes() for i in some.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), pa.array(a), pa.array(b), raw], ["least", "a", "b", "tokens"])

    # One row for each node: the rows of its smallest id have equal sets.
    same = F.coalesce("least", F.lit(_NO_ID)).alias("least")
    full = asked.where("maybe").select("doc_id", "text").mapInArrow(tokens, "least long, a long, b long, tokens binary").groupBy("a", "b", same).agg(F.any_value("tokens").alias("tokens"))
    full = full.join(placed.withColumn("least", same), ["a", "b", "least"])
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(other, F.col("block")).alias("x"), F.greatest(other, F.col("block")).alias("y")))
    spread = full.select("grp", F.explode(pairs).alias("p"), "block", "node", "copies", "tokens").select("grp", "p.x", "p.y", "block", "node", "copies", "tokens")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    checked = spread.repartition(parts, "grp", "x", "y").sortWithinPartitions("grp", "x", "y", "node").mapInArrow(_verify(similarity), "node long, links long, parent long")
    checked, _ = shared.table(checked)
    least = nodes.select("node", F.col("least").alias("low"))
    roots = components(checked.select(F.col("node").alias("a"), F.col("parent").alias("b")), least)
    linked = checked.groupBy("node").agg(F.sum("links").alias("links")).join(roots.withColumn("tied", F.lit(True)), "node", "left")
    own = nodes.select("node", "a", "b", "least", "copies").join(linked, "node", "left")
    per_node = own.select("a", "b", "copies", F.when(F.col("tied"), F.col("root")).otherwise(F.col("least")).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    names = seen.select("doc_id", "a", "b").withColumn("at", F.monotonically_increasing_id())
    with_words = shared.meet(names, per_node, ["a", "b"], "copies", n_rows, F.col("at")).select("doc_id", "class_id", "n_links")
    without = rows.where(~F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return with_words.union(without).withColumnRenamed("doc_id", id_col)
