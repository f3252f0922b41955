"""Stored rows are filtered before they move."""

import random

import pytest
from pyspark.sql import functions as F

from mergewell.operators import prune
from mergewell.operators import resolve as R


def shuffled(df):
    """Rows written by the shuffles of a query that has run."""

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if "QueryStageExec" in name:
            return walk(plan.plan())
        kids = plan.children()
        own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        return own + sum(walk(kids.apply(i)) for i in range(kids.size()))

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture
def store(spark, tmp_path):
    """100,000 edges, ids and keys on disk."""
    k = F.col("id")
    text = lambda p, c=k: F.concat(F.lit(p), c.cast("string"))
    base = spark.range(100_000)
    tables = {
        "edges": base.select(F.lit("release_track").alias("kind"), text("r", k % 5000).alias("src_id"), text("t").alias("dst_id"), text("e").alias("edge_id")),
        "ids": base.select(F.lit("isrc").alias("namespace"), text("v").alias("value"), F.lit("recording").alias("owner_type"), text("t").alias("owner_id")),
        "sidecar": base.select(F.lit("recording").alias("entity_type"), text("k").alias("key"), text("t").alias("entity_id")),
    }
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / name))
    return {name: spark.read.parquet(str(tmp_path / name)) for name in tables}


@pytest.fixture
def large(monkeypatch):
    monkeypatch.setattr(prune, "SMALL", 0)
    monkeypatch.setattr(prune, "UNKNOWN", float("inf"))


def batch(spark, n=100):
    k = F.col("id") * 997
    text = lambda p, c=k: F.concat(F.lit(p), c.cast("string"))
    some = spark.range(n)
    rels = some.select(text("rel").alias("rel_id"), F.lit("release_track").alias("kind"), text("r", k % 5000).alias("src_id"), text("t").alias("dst_id"), F.array().cast("array<string>").alias("blocked_by"))
    ids = some.select(text("c").alias("claim_id"), F.lit("recording").alias("entity_type"), F.lit(0).alias("pos"), F.lit("isrc").alias("namespace"), text("v").alias("value"))
    keys = some.select(text("c").alias("claim_id"), F.lit("recording").alias("entity_type"), F.lit(0).alias("key_ord"), text("k").alias("key"))
    return rels, ids, keys


@pytest.mark.parametrize("exact", [True, False])
def test_a_batch_shuffles_only_the_rows_it_meets(spark, store, large, monkeypatch, exact):
    if not exact:
        monkeypatch.setattr(prune, "EXACT", 10)
    rels, ids, keys = batch(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = {
            "associations": R.resolve_associations(rels, store["edges"]),
            "links": R.resolve_links(rels, store["edges"]),
            "ids": R.by_external_id(ids, store["ids"]),
            "keys": R.by_keys(keys, store["sidecar"]),
            "conflicts": R.namespace_conflicts(ids, ids.select("claim_id", F.regexp_replace("claim_id", "c", "t").alias("entity_id")), store["ids"], spark.createDataFrame([], "namespace string, source_value string, target_value string")),
        }
        moved = {name: shuffled(df) for name, df in found.items()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(moved.values()) < 1000, moved  # of 100,000 stored
    assert found["associations"].where("status = 'resolved'").count() == 100
    assert found["links"].where("status = 'resolved'").count() == 100
    assert found["ids"].count() == 100 and found["keys"].count() == 100 and found["conflicts"].count() == 0


def test_the_filter_misses_no_key(spark, large, monkeypatch):
    monkeypatch.setattr(prune, "EXACT", 0)
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 10**6), rnd.choice(["a", "é", ""])) for _ in range(20_000)]
    stored = spark.createDataFrame(rows + [(None, "a"), (1, None)], "x long, y string")
    some = spark.createDataFrame(rows[:3000] + [(None, "a"), (7, None)], "x long, y string")
    got = {tuple(r) for r in prune.meeting(stored, some, ["x", "y"]).collect()}
    assert set(rows[:3000]) <= got
    assert len(got - set(rows[:3000])) < 0.03 * len(rows)
    assert prune.meeting(stored, some.limit(0), ["x", "y"]).count() == 0


def test_ids_are_found_through_redirects(spark, store, large):
    closure = spark.createDataFrame([("isrc", "old", "v7"), ("isrc", "gone", "nowhere")], "namespace string, source_value string, target_value string")
    claims = spark.createDataFrame([("a", "recording", 0, "isrc", "old"), ("b", "recording", 0, "isrc", "gone"), ("c", "recording", 0, "isrc", "v8")], "claim_id string, entity_type string, pos int, namespace string, value string")
    assert {r.claim_id: r.entity_id for r in R.by_external_id(claims, store["ids"], closure).collect()} == {"a": "t7", "c": "t8"}


def test_a_filter_is_no_part_of_the_plan_that_is_told(spark, store, large):
    """21,000 keys make a filter of 64 KB, which was printed four times in hexadecimal."""
    some = store["sidecar"].where("cast(substr(key, 2) as int) < 21000")
    got = prune.meeting(store["sidecar"], some, ["entity_type", "key"])
    assert "scalar-subquery" in (told := got._jdf.queryExecution().toString())
    assert len(told) < 50_000
    assert 21_000 <= got.count() < 30_000


def test_a_batch_as_large_as_the_store_makes_no_filter(spark, store, large):
    assert prune.meeting(store["ids"], store["ids"], ["value"]) is store["ids"]


def test_too_many_keys_make_no_filter(spark, store, large, monkeypatch):
    monkeypatch.setattr(prune, "EXACT", 10)
    monkeypatch.setattr(prune, "MOST_KEYS", 99)
    assert prune.meeting(store["ids"], store["ids"].limit(99), ["value"]) is not store["ids"]
    assert prune.meeting(store["ids"], store["ids"].limit(100), ["value"]) is store["ids"]


def test_a_filter_stands_once_in_the_plan(spark, store, large, monkeypatch):
    """Every place of it is a copy in each task and on the driver."""
    monkeypatch.setattr(prune, "EXACT", 10)
    got = prune.meeting(store["ids"], store["ids"].limit(99), ["value"])
    told = got._jdf.queryExecution().optimizedPlan().toString()
    assert next(line for line in told.splitlines() if "Filter" in line).count("scalar-subquery") == 1


def test_many_keys_make_a_filter_only_for_a_much_larger_store(spark, store, large, monkeypatch):
    monkeypatch.setattr(prune, "EXACT", 10)
    some = store["ids"].limit(20_000)
    assert prune.meeting(store["ids"], some, ["value"]) is not store["ids"]
    monkeypatch.setattr(prune, "MANY", 20_000)
    assert prune.meeting(store["ids"], some, ["value"]) is store["ids"]
