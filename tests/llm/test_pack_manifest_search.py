"""Packing, Merkle manifests and lexical search against plain models."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mergewell.llm import lexical_search, merkle, packing

JSON = public_tokenizers.path("byte_bpe_50k.json")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
TEXTS = [
    None, "", " ", "  a  b \n c\t d ", "a　b  c\x1c d", "it's <|endoftext|> x 12 345", "ñandú ÉL ação 你好 世界 emoji 🙂 x​z", "\r\n \r\nline\n\n next", "x" * 9000,
    "\x85 y", "١٢٣ ²³ ª", "word " * 5000, "tail ", " head", "a  b", "don't DON'T we'LL",
]


@pytest.fixture
def spread(spark):
    """Exchanges into more parts than meet in one merge."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def own_tokenizer():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


def test_words_give_the_tokenizers_ids():
    own, words, rnd = own_tokenizer(), packing.Words(JSON), random.Random(3)
    assert words.fast is not None
    parts = [" ", "  ", "\n", "\t", " ", "\x1c", "a", "B", "é", "你", "1", "²", "'s", "'", ".", "!?", "​", "🙂", "ſ", "\x85"]
    texts = [t for t in TEXTS if t] + ["".join(rnd.choices(parts, k=rnd.randint(1, 30))) for _ in range(3000)]
    for t in texts:
        assert np.frombuffer(words.ids(t), "<u4").tolist() == own.encode(t, add_special_tokens=False).ids, repr(t)


def test_words_are_bounded(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 5)
    words = packing.Words(JSON)
    words.ids(" ".join(f"w{i}" for i in range(100)))
    assert len(words) <= 5


def test_packing(spark, docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (3, TEXTS[3]), (None, "no id")]
    packed = packing.pack(packing.pieces(docs(rows), JSON)).collect()
    own, want = own_tokenizer(), collections.Counter()
    for i, t in rows:
        ids = own.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)] if len(ids) > 2048 else [0, len(ids)]
        for k, (a, b) in enumerate(itertools.pairwise(cuts)):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in packed) == want
    by = collections.defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) == math.ceil(sum(r.length for r in packed) / 2048)  # as few as there can be


def test_sequences_hold_their_pieces(docs, prose):
    packed = packing.pack(packing.pieces(docs([(i, prose(i, 30 + 37 * i)) for i in range(40)]), JSON))
    whole = {r.sequence_id: (r.n_pieces, r.ids) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][1][r.offset : r.offset + r.length] == r.ids
    assert sum(n for n, _ in whole.values()) == packed.count()


def test_fullest_combination_is_the_fullest():
    rnd = random.Random(5)
    for _ in range(200):
        limit = rnd.randint(3, 24)
        sizes = [rnd.randint(1, limit) for _ in range(rnd.randint(1, 9))]
        left = [sizes.count(n) for n in range(limit + 1)]
        found = packing.Lengths(list(left), limit).fullest()
        assert all(left[n] >= c for n, c in found)
        rest = sorted(sizes)[:-1]
        best = max(max(sizes) + sum(c) for k in range(len(rest) + 1) for c in itertools.combinations(rest, k) if max(sizes) + sum(c) <= limit)
        assert sum(n * c for n, c in found) == best and found[0][0] == max(sizes)


def test_sums_follow_what_is_taken():
    rnd = random.Random(6)
    lengths = packing.Lengths([0] + [rnd.randint(0, 30) for _ in range(20)], 20)
    while lengths.longest:
        mix = lengths.fullest()
        lengths.take(mix, min(lengths.left[n] // c for n, c in mix))
        fresh = packing.Lengths(list(lengths.left), 20)
        assert fresh.longest == lengths.longest and fresh.sums[: fresh.longest + 1] == lengths.sums[: fresh.longest + 1]


def test_plan_places_every_rank_once():
    rnd = random.Random(8)
    counts = {n: rnd.randint(1, 50) for n in rnd.sample(range(1, 65), 30)} | {64: 10**12}
    plan = packing.Plan(counts, 64)
    taken = collections.defaultdict(list)
    for n, k in counts.items():
        rank = np.arange(min(k, 50))
        for s, o in zip(*plan.places(np.full(len(rank), n), rank), strict=True):
            taken[s].append((o, n))
    for s, places in taken.items():
        if len(places) > 1:
            assert all(a + n <= b for (a, n), (b, _) in itertools.pairwise(sorted(places)))
    s, _ = plan.places(np.array([64]), np.array([10**12 - 1]))
    assert s[0] < plan.sequences


def test_packing_of_hot_lengths_over_many_parts(spark, spread):
    rows = spark.range(0, 20_000, numPartitions=50).select("id", F.when(F.col("id") % 3 == 0, 700).otherwise(1 + F.col("id") % 512).alias("length"), F.lit("x").alias("_block"))
    packed = packing.pack(rows).collect()
    by = collections.defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    assert len(packed) == 20_000 and all(sum(n for _, n in p) <= 2048 and [o for o, _ in sorted(p)] == [0, *itertools.accumulate(n for _, n in sorted(p))][:-1] for p in by.values())
    assert len(by) <= math.ceil(sum(r.length for r in packed) / 2048) + 1


def test_packing_refuses_other_lengths_and_takes_empty_tables(spark, docs):
    assert packing.pack(packing.pieces(docs([]), JSON, with_ids=False)).collect() == []
    with pytest.raises(Exception, match="lengths must be from 1 to 2048"):
        packing.pack(spark.createDataFrame([(2049,)], "length long"))


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        a = i - i % 3
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + 3])))
        i //= 3
    return out


def manifest_model(rows):
    """(id, subroot, root, path) of rows (id, group, digest)."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        own = sorted(by[g], key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[g] = own, tree([r[2] for r in own])
    top = tree([trees[g][1][-1][0] for g in names])
    return sorted(((r[0], r[1], r[2], trees[g][1][-1][0], top[-1][0], tuple(path(trees[g][1], i) + path(top, n))) for n, g in enumerate(names) for i, r in enumerate(trees[g][0])), key=str)


def manifest_found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string").withColumns({"level": F.lit(1), "tree": F.lit("x"), "digest": F.lit("y"), "n": F.lit(2)})
    got = merkle.manifest(df, "source", "doc_id").collect()
    return sorted(((r.doc_id, r.source, r.leaf, r.subroot, r.root, tuple((p.before, p.after) for p in r.path)) for r in got), key=str)


@pytest.mark.parametrize("sizes", [[1], [3], [4], [2, 1, 1], [1, 9, 28, 5]])
def test_manifest(spark, sizes):
    rows = [(i, f"g{k}", h(f"{k}/{i}")) for k, n in enumerate(sizes) for i in range(n)]
    assert manifest_found(spark, rows) == manifest_model(rows)


def test_manifest_of_trees_over_many_parts(spark, spread):
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 3000), rnd.choice(["hot", "hot", "ü", "Z", None, "a", ""]), h(str(i))) for i in range(3500)]
    rows += [(None, "hot", h("n"))] * 2 + [(5, f"one{i}", h(str(i))) for i in range(120)] + [(7, "same", h("s"))] * 400
    assert manifest_found(spark, rows) == manifest_model(rows)


def test_manifest_of_nothing(spark):
    assert manifest_found(spark, []) == []


def test_merge_is_associative_and_commutative():
    rnd = random.Random(4)
    for total in (1, 2, 3, 4, 10, 27, 29, 100):
        leaves = [h(str(i)) for i in range(total)]
        cuts = sorted({0, total, *(rnd.randint(0, total) for _ in range(6))})
        parts = [{(level, i): d for level, i, d, _ in merkle.open_nodes(merkle.climb(a, leaves[a:b], total))} for a, b in itertools.pairwise(cuts)]
        for _ in range(5):
            rnd.shuffle(parts)
            acc, done = {}, False
            for p in parts:
                acc, _, done = merkle.merge(acc | p, total)
            assert done and list(acc.values()) == [tree(leaves)[-1][0]]


def test_leaf_fields_and_tampering(spark):
    df = spark.createDataFrame([(1, "ü\n", None)], "a long, b string, c int")
    leaf = merkle.leaf(F.col("a"), F.col("b"), F.col("c"))
    assert df.select(leaf).first()[0] == h("1:13:ü\n-")
    step = F.array(F.struct(F.lit("aa").alias("before"), F.lit("bb").alias("after")), F.struct(F.lit("").alias("before"), F.lit("").alias("after")))
    got = df.select(merkle.fold(F.lit("x"), step), merkle.proof(step), merkle.proof(F.array().cast(merkle.STEP))).first()
    assert list(got) == [h(h("aaxbb")), h("aabb"), h("")]


def search_model(docs, items, top=10):
    held = [(d, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, total = len(held), sum(n for *_, n in held)
    df, out = collections.Counter(w for _, c, _ in held for w in c), []
    for item, text in items:
        scored = []
        for d, c, n in held:
            m = 25 + 75 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in TERM.findall((text or "").translate(LOWER)) if w in c)
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


def search_found(spark, docs_df, items):
    asked = spark.createDataFrame([(i, t, 1, 2, "z") for i, t in items], "item_id long, text string, rank int, nth int, score string")
    return sorted((tuple(r) for r in lexical_search.search(docs_df, asked).collect()), key=str)


def corpus(prose):
    rows = [(i, prose(i, 5 + i % 50)) for i in range(300)]
    rows += [(1000 + i, "amber Amber basil") for i in range(40)] + [(5, "Ünï ünï ÜNÏ x-y_z 3d"), (5, "repeat amber"), (5, "repeat amber"), (None, "amber basil cedar"), (None, None), (2000, ""), (2001, "  .,; ")]
    rows += [(3000, "amber " * 20_000 + "cedar"), (3001, "q" * 70_000 + " cedars"), (-4, "basil")]
    items = [(i, prose(900 + i, 12)) for i in range(20)] + [(50, "amber amber BASIL"), (51, None), (52, "..."), (53, "nowhere"), (54, "q" * 70_000), (50, "Ünï"), (55, "qqqqqqqqq"), (None, "cedar")]
    return rows, items


def test_lexical_search(spark, docs, prose):
    rows, items = corpus(prose)
    assert search_found(spark, docs(rows), items) == search_model(rows, items)


def test_lexical_search_in_blocks_slices_and_parts(spark, docs, prose, monkeypatch, spread):
    rows, items = corpus(prose)
    monkeypatch.setattr(lexical_search, "BLOCK", 3000)
    monkeypatch.setattr(lexical_search, "PARTS", 3)
    few = [(i, t) for i, t in items if i != 54]
    assert search_found(spark, docs(rows).repartition(11), few) == search_model(rows, few)


def test_lexical_search_of_nothing(spark, docs):
    assert search_found(spark, docs([]), [(1, "a")]) == []
    assert search_found(spark, docs([(1, "a")]), []) == []
    assert search_found(spark, docs([(1, None)]), [(1, "a")]) == []


def test_accumulate_sums_and_radix_orders():
    keys = np.array([5 << 40, 3, 70_000, 3, 1 << 33, 0], np.uint64)
    assert keys[lexical_search.radix_order(keys)].tolist() == sorted(keys.tolist())
    block = lexical_search.Index([(1, "a b a"), (2, "b c")])
    order = {bytes([c]): i for i, c in enumerate(block.head.astype(np.uint8))}
    term = np.array([order[b"a"], order[b"b"], order[b"b"]])
    item, doc, score = lexical_search.accumulate(block, term, np.array([0, 0, 1]), np.array([10, 1, 5]))
    assert list(zip(item.tolist(), doc.tolist(), score.tolist(), strict=True)) == [(0, 0, 21), (0, 1, 5), (1, 0, 1), (1, 1, 5)]
