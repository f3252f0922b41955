"""Substring, suffix and Jaccard deduplication against brute force, and the pipeline."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mergewell.llm import components, jaccard_join, substring_dedup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def corpus(prose):
    rnd = random.Random(8)
    shared = [prose(500 + i, n) for i, n in enumerate((50, 60, 90, 200, 49))]
    rows = [(i * 3 % 211, prose(i, rnd.randint(1, 160))) for i in range(120)]
    for i in range(40):
        a, b = prose(700 + i, rnd.randint(0, 40)), prose(800 + i, rnd.randint(0, 40))
        rows.append((300 + i, f"{a}\n{shared[i % 5]}  {b}"))
    whole = prose(900, 150)
    rows += [(400 + i, whole) for i in range(20)]
    for i in range(25):
        w = whole.split()
        w[rnd.randint(0, 149)] = f"edit{i}"
        rows.append((430 + i, " ".join(w)))
    rows += [(470, prose(901, 60) + " " + " ".join([prose(902, 12)] * 30)), (471, " ".join([prose(902, 12)] * 20))]
    rows += [(480, None), (481, ""), (482, "   "), (483, "one two"), (484, "one two"), (485, "y" * 20_000), (486, whole), (486, whole), (None, whole), (None, None)]
    return rows


def test_substring_dedup_equals_brute_force(docs, corpus):
    got = defaultdict(list)
    for cells in (None, 64):  # a sketch that is far too small only lets more through
        for r in substring_dedup.remove_repeated(docs(corpus), cells=cells).collect():
            got[cells, r.doc_id].append((r.n_words, r.n_removed, sha(r.kept)))
    starts = defaultdict(set)
    for i, t in corpus:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            starts[tuple(w[k : k + 50])].add(i)
    want = defaultdict(list)
    for i, t in corpus:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and min(x for x in starts[tuple(w[k : k + 50])] if x is not None) < i:
                gone |= set(range(k, k + 50))
        want[i].append((len(w), len(gone), sha(" ".join(x for n, x in enumerate(w) if n not in gone))))
    for cells in (None, 64):
        for i in want:
            assert sorted(got[cells, i]) == sorted(want[i]), (cells, i)
    assert substring_dedup.remove_repeated(docs(corpus).limit(0)).count() == 0


def test_suffix_dedup_finds_every_document_with_a_repeat(docs, corpus):
    found = suffix_dedup.matches(docs(corpus)).collect()
    words = defaultdict(set)
    for i, t in corpus:
        words[i].add(tuple(WORD.findall(t or "")))
    for r in found:  # what is reported is equal, as long as asked, and cannot be longer
        pairs = [(a, b) for a in words[r.doc_id] for b in words[r.other_id] if a[r.start : r.start + r.n_words] == b[r.other_start : r.other_start + r.n_words]]
        assert pairs and r.n_words >= 50
    windows = defaultdict(set)
    for i, t in corpus:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            windows[tuple(w[k : k + 50])].add(i)
    want = {i for ids in windows.values() if len(ids - {None}) > 1 for i in ids if i is not None}
    assert {r.doc_id for r in found} | {r.other_id for r in found} == want
    rows = {r.doc_id: r for r in suffix_dedup.per_document(suffix_dedup.matches(docs(corpus))).collect()}
    assert rows[401].spans == "0:150" and rows[401].n_repeated == 150
    assert suffix_dedup.matches(docs(corpus).limit(0)).count() == 0


def repeated_words(rows):
    """Words under windows of 50 that another document has, by document."""
    where = defaultdict(set)
    for i, t in rows:
        w = WORD.findall(t)
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(i)
    out = defaultdict(set)
    for i, t in rows:
        w = WORD.findall(t)
        for k in range(len(w) - 49):
            if len(where[tuple(w[k : k + 50])]) > 1:
                out[i] |= set(range(k, k + 50))
    return dict(out)


def suffix_words(df):
    out = {}
    for r in suffix_dedup.per_document(suffix_dedup.matches(df)).collect():
        out[r.doc_id] = {k for s in r.spans.split(",") for k in range(*map(int, s.split(":")))}
        assert len(out[r.doc_id]) == r.n_repeated
    return out


def test_suffix_dedup_covers_passages_around_a_frequent_line(docs, prose):
    line, rnd = prose(1000, 40), random.Random(3)
    rows = [(i, f"{prose(2000 + i, 60)} {line} {prose(4000 + i, 60)}") for i in range(300)]
    for i in range(30):
        n = rnd.randint(10, 30)
        passage = f"{prose(6000 + i, rnd.randint(0, n))} {line} {prose(6100 + i, n)}"
        for side in (0, 1):
            rows.append((1000 + 2 * i + side, f"{prose(6200 + 2 * i + side, 55)} {passage} {prose(6300 + 2 * i + side, 55)}"))
    want = repeated_words(rows)
    assert len(want) == 60
    assert suffix_words(docs(rows)) == want


@pytest.mark.parametrize("parts", [4, 40])  # of 40 ranges many borders part a kind
def test_suffix_dedup_covers_repeats_within_documents(spark, docs, prose, parts):
    rows = []
    for i, n in enumerate((60, 120, 300)):
        passage = prose(7000 + i, n)
        for d, times in enumerate((5, 3, 1, 4)):
            rows.append((10 * i + d, " ".join(f"{prose(7100 + 100 * i + 10 * d + k, 7)} {passage}" for k in range(times))))
    rows.append((90, " ".join([prose(7900, 70)] * 4)))  # no other document has it
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = suffix_words(docs(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == repeated_words(rows)


def classes_model(rows, similarity=0.8):
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= similarity * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            low[find(n)] = min(low.get(find(n), i), i)
    return sorted((str(i), str(low.get(find(n))), links[n]) for n, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("small", "block"), [(64, 512), (3, 7)])
def test_jaccard_join_equals_brute_force(docs, corpus, monkeypatch, small, block):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in jaccard_join.classes(docs(corpus)).collect())
    assert got == classes_model(corpus)


def test_jaccard_join_of_nothing(docs):
    assert jaccard_join.classes(docs([(1, "x")]).limit(0)).count() == 0
    assert [(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.classes(docs([(1, None)])).collect()] == [(1, 1, 0)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(1, 1), (3, 2)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 60)} | {2: 2, 3: 2}


def test_components_of_long_chains_in_any_order(spark):
    rnd, edges, want = random.Random(5), [], {}
    down = [0, *range(2999, 0, -1)]
    drawn = rnd.sample(range(10_000, 12_000), 2000)
    drift = rnd.sample(range(20_000, 21_000), 1000)
    for nodes, reach in ((down, 1), (drawn, 1), (drift, 7)):
        edges += [(nodes[i], nodes[i + d]) for d in range(1, reach + 1) for i in range(len(nodes) - d)]
        want |= dict.fromkeys(nodes, min(nodes))
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_pipeline(spark, docs, corpus, prose, tmp_path):
    import corpus_pipeline as c

    item = prose(3000, 40)
    rows = [*corpus, (600, prose(601, 90) + " " + item), (601, "write to someone@example.org now, " + prose(602, 30)), (602, "12 34 !!")]
    docs(rows).select(*c.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in c.run(spark, str(tmp_path)).collect()}
    kept_ids = {i for i, _ in rows} - {600, 602, 480, 481, 482}
    kept_ids -= {int(i) for i, k, _ in classes_model([r for r in rows if r[0] not in (480, 481, 482, 602)]) if i != "None" and k not in (i, "None")}
    assert set(got) == kept_ids
    assert [len(s) for s in c.STAGES] == [2] * 5


def test_pipeline_sends_small_batches_to_workers(spark, docs, prose, monkeypatch):
    import corpus_pipeline as c

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(c, "SLICE_BYTES", 50, raising=False)  # a text a slice
    rows = docs([(i, prose(i, 40)) for i in range(30)])
    spark.conf.unset(key)
    try:
        small = sorted(tuple(r) for r in c.encode(spark, rows, "").collect())
        assert int(spark.conf.get(key)) == c.BATCH_ROWS < 10_000
        spark.conf.set(key, 7)
        monkeypatch.undo()
        assert sorted(tuple(r) for r in c.encode(spark, rows, "").collect()) == small
        assert int(spark.conf.get(key)) == 7
    finally:
        spark.conf.unset(key)


def test_pipeline_keeps_one_row_of_a_class(spark, docs, prose):
    import corpus_pipeline as c

    copy, alone, other = prose(8000, 80), prose(8001, 80), prose(8002, 80)
    near = " ".join([*copy.split()[:-1], "changed"])
    rows = [(5, copy), (5, copy), (6, near), (None, copy), (7, alone), (7, near), (8, other)]
    got = sorted((str(r.doc_id), r.text) for r in c.drop_near_copies(spark, docs(rows), "").collect())
    assert got == sorted([("5", copy), ("7", alone), ("8", other), ("None", copy)])


def test_pipeline_without_languages_rejects_texts_without_letters_alone(spark, docs, prose):
    import corpus_pipeline as c

    rows = [(1, prose(8100, 20)), (2, "12 34 !!"), (3, None), (4, "12 \u00e9"), (5, "")]
    unknown = docs(rows).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r.doc_id for r in c.identify_language(spark, unknown, "").collect()) == [1, 4]


def test_a_path_meets_its_sizes_once(spark):
    """Nodes of one large bucket at all levels: a row a node and run, not one for each level."""
    n, runs = 300, 2
    rows = [(i, bytes([1, 0]) * 64, [1, 2, 10 + i % 2, 4, 5, 20 + i % 2]) for i in range(n)]
    df = jaccard_join.propose(spark.createDataFrame(rows, "node long, sketch binary, keys array<long>"), runs)
    df.collect()

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if "QueryStageExec" in name:
            return walk(plan.plan())
        own = plan.metrics().apply("numOutputRows").value() if "Join" in name and "rekeyed" in plan.simpleString(100) else 0
        return own + sum(walk(plan.children().apply(i)) for i in range(plan.children().size()))

    assert 0 < walk(df._jdf.queryExecution().executedPlan()) <= n * runs
