"""Long chains, circles and large components, against one-by-one models."""

import random

import pytest
from pyspark.sql import functions as F

from mergewell.operators import dedupe as D
from mergewell.operators import graph
from mergewell.operators import resolve as R

REDIRECTS = "namespace string, source_value string, target_value string"


def jobs(spark, work):
    """(result, number of Spark jobs that it took)."""
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def greedy_model(rows):
    claims = {}
    for claim, order, kind, _, key in rows:
        claims.setdefault((kind, claim), (order, []))[1].append(key)
    owned, kept = set(), set()
    for (kind, claim), (_, keys) in sorted(claims.items(), key=lambda c: c[1][0]):
        if not any((kind, k) in owned for k in keys):
            owned |= {(kind, k) for k in keys}
            kept.add((kind, claim))
    return kept


KEYS = "claim_id string, claim_ord long, entity_type string, key_ord int, key string"


def survivors(spark, rows, **kw):
    kept, dropped = D.dedupe_greedy(spark.createDataFrame(rows, KEYS), **kw)
    got = {(r.entity_type, r.claim_id) for r in kept.collect()}
    assert kept.count() == len(got)
    assert {(r.entity_type, r.claim_id) for r in dropped.collect()} == {(r[2], r[0]) for r in rows} - got
    return got


def chain(n, order=None):
    order = order or list(range(n))
    return [(f"c{i}", order[i], "recording", j, f"k{i + j}") for i in range(n) for j in (0, 1)]


def test_a_chain_of_100_000_claims(spark):
    n, k = 100_000, F.col("id")
    links = F.explode(F.array(F.struct(F.lit(0).alias("key_ord"), k.alias("k")), F.struct(F.lit(1).alias("key_ord"), (k + 1).alias("k"))))
    keys = spark.range(n).select(F.format_string("c%d", k).alias("claim_id"), k.alias("claim_ord"), F.lit("recording").alias("entity_type"), links.alias("x")).select("claim_id", "claim_ord", "entity_type", "x.key_ord", F.format_string("k%d", "x.k").alias("key"))
    (kept, _), used = jobs(spark, lambda: D.dedupe_greedy(keys))
    assert used < 40
    assert kept.agg(F.count("*"), F.sum("claim_ord"), F.max(F.col("claim_ord") % 2)).first() == (n // 2, n // 2 * (n // 2 - 1), 0)


@pytest.mark.parametrize("order", ["up", "down", "mixed"])
def test_a_chain_beyond_one_scan(spark, order):
    n = 3000
    place = list(range(n)) if order == "up" else list(range(n))[::-1] if order == "down" else random.Random(3).sample(range(n), n)
    rows = chain(n, place)
    assert survivors(spark, rows, scan=100) == greedy_model(rows)


def test_components_of_all_sizes(spark):
    rnd, rows, order = random.Random(4), [], iter(random.Random(5).sample(range(10**6), 4000))
    for c in range(300):  # small ones of many shapes, and one large and deep
        size = 900 if c == 0 else rnd.randint(1, 9)
        for i in range(size):
            for j, key in enumerate({rnd.randint(max(0, i - 3), i) for _ in range(rnd.randint(1, 3))}):
                rows.append((f"c{c}-{i}", 0, rnd.choice(["recording"]), j, f"k{c}-{key}"))
    place = {}
    rows = [(c, place.setdefault(c, next(order)) if c not in place else place[c], t, j, k) for c, _, t, j, k in rows]
    assert survivors(spark, rows, scan=64) == greedy_model(rows)
    assert survivors(spark, rows) == greedy_model(rows)


def test_a_hot_key_and_types_apart(spark):
    rows = [(f"c{i}", i, t, 0, "hot") for i in range(400) for t in ("label", "artist")] + [(f"c{i}", i, "artist", 1, f"own{i % 7}") for i in range(400)]
    assert survivors(spark, rows, scan=50) == greedy_model(rows)
    assert survivors(spark, []) == set()


def test_orders_that_are_structs_and_nulls(spark):
    rows = [("a", (None, "x"), "t", 0, "k"), ("b", (1, None), "t", 0, "k"), ("c", (1, "a"), "t", 0, "k2"), ("d", (0, "z"), "t", 0, "k2")]
    df = spark.createDataFrame(rows, "claim_id string, claim_ord struct<x:int,y:string>, entity_type string, key_ord int, key string")
    assert {r.claim_id for r in D.dedupe_greedy(df)[0].collect()} == {"a", "d"}


def test_labels_of_components(spark):
    rnd = random.Random(9)
    rows = [(f"i{i}", f"k{i + j}") for i in rnd.sample(range(2000), 2000) for j in (0, 1) if i % 100 or j] + [("alone", "z"), ("i5", "z2")]
    found = {}
    for r in graph.components(spark.createDataFrame(rows, "item string, key string")).collect():
        found[r.item] = r.label
    groups = {}
    for i in range(2000):
        groups.setdefault(found[f"i{i}"], set()).add(i // 100)
    assert len(groups) == 20 and all(len(g) == 1 for g in groups.values()) and found["alone"] == "alone"


def closure_model(steps):
    to, out = {s: t for s, t in steps}, {}
    for s, t in steps:
        if s != t:
            seen = [s, t]
            while seen[-1] in to and to[seen[-1]] not in seen:
                seen.append(to[seen[-1]])
            out[s] = seen[-1]
    return out


def test_redirects_of_all_shapes(spark):
    rnd = random.Random(7)
    for n in (1, 2, 9, 60):
        steps = [(f"v{i}", f"v{rnd.randrange(n + 3)}") for i in range(n)]
        df = spark.createDataFrame([("ns", *s) for s in steps] + [("other", "v0", "elsewhere")], REDIRECTS)
        got = {(r.namespace, r.source_value): r.target_value for r in R.redirect_closure(df).collect()}
        assert got == {("ns", s): t for s, t in closure_model(steps).items()} | {("other", "v0"): "elsewhere"}


def test_a_chain_of_10_000_redirects(spark):
    k = F.col("id")
    df = spark.range(10_000).select(F.lit("ns").alias("namespace"), F.format_string("v%d", k).alias("source_value"), F.format_string("v%d", k + 1).alias("target_value"))
    done, used = jobs(spark, lambda: R.redirect_closure(df))
    assert used < 100  # some five a round, in fifteen rounds
    assert done.where("target_value <> 'v10000'").count() == 0 and done.count() == 10_000


def test_a_long_tail_into_a_circle(spark):
    steps = [(f"t{i}", f"t{i + 1}") for i in range(300)] + [("t300", "o5")] + [(f"o{i}", f"o{(i + 1) % 40}") for i in range(40)]
    got = {r.source_value: r.target_value for r in R.redirect_closure(spark.createDataFrame([("ns", *s) for s in steps], REDIRECTS)).collect()}
    assert got == closure_model(steps)
    assert R.redirect_closure(spark.createDataFrame([], REDIRECTS)).collect() == []
