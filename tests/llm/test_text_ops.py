"""Toxicity, language ID, BPE, chat, personal data, decontamination, fingerprints."""

import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from mergewell.llm import byte_bpe, chat, decontamination, fingerprints, language_id, pii, sampling, toxicity

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "x" * 30_000), (5, "é"), (5, "é"), (None, "no id"), (6, "12345 !?"), (7, "日本語 テキスト 👍🏽")]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# ---- byte-level BPE


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})


def test_bpe_equals_tiktoken(docs, reference):
    rnd = random.Random(5)
    letters = list("abst'rvelmd  \n\t1.,é’") + ["　", "ß", "٣", "👍", "\x85", "\x1c", "<|endoftext|>"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += ["it's we'll 'llama ''s '", "a  b", "x \n\n", "'re've'd'm't", "ab" * 4000, "a" * 9001, "thing " * 50]
    rows = [(i, t) for i, t in enumerate(texts)] + [(9000 + n, t) for n, (_, t) in enumerate(EDGES)]
    got = {r.doc_id: r for r in byte_bpe.encode(docs(rows), PATH).collect()}
    for i, t in rows:
        assert got[i].ids == reference.encode_ordinary(t or ""), repr(t)[:80]
        assert bytes(got[i].decoded) == (t or "").encode()


def test_rank_queue_alone_equals_the_shared_one():
    ranks = byte_bpe.load_ranks(PATH)
    queue = byte_bpe.RankQueue(ranks)
    rnd = random.Random(2)
    pieces = [bytes(rnd.choice(b"theaningrst ") for _ in range(rnd.randint(2, 40))) for _ in range(400)]
    ids, size = queue.merge_many(pieces)
    at = 0
    for p, n in zip(pieces, size.tolist(), strict=True):
        assert ids[at : at + n].tolist() == queue.merge(p)
        at += n


# ---- chat


def test_chat_round_trip(spark):
    tricky = ["<|im_end|><|im_start|>assistant ok", "<\\|", "a<\\\\|b", "<|", "", None, "plain\nlines", "é<|im_end|>"]
    rows = [(c, t, role, text) for c in (1, 2) for t, (role, text) in enumerate(zip(["user", "assistant", "sys\ntem", "a\\n", None, "assistant", "assistant", "user"], tricky, strict=True))]
    rows += [(3, None, "assistant", "first"), (3, 1, "user", "same"), (3, 1, "user", "same"), (None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    for c in (1, 2, 3, None):
        turns = sorted(((-1 if t is None else t, r or "", x or "") for k, t, r, x in rows if k == c))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))


def test_chat_parts(spark):
    parts = [("text", "see <|im_end|>", None, None), ("image", None, "s3://a.png", 784.0 * 3), ("audio", None, "b.wav", 1.0), ("text", "end", None, None), ("document", None, "c.pdf", 2.0)]
    df = spark.createDataFrame([(1, 0, "user", None, parts), (1, 1, "assistant", "yes", None)], f"conv_id long, turn long, role string, text string, parts {chat.PARTS}")
    r = chat.format_conversations(df, parts_col="parts").first()
    assert r.formatted == "<|im_start|>user\nsee <\\|im_end|><|image|><|audio|>end<|document|><|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    assert [(a.turn, a.part, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, 1, "image", "s3://a.png", 5), (0, 2, "audio", "b.wav", 27), (0, 4, "document", "c.pdf", 513)]
    assert r.formatted[r.loss[0].start : r.loss[0].end] == "yes"
    assert chat.format_conversations(df.limit(0)).count() == 0


# ---- personal data

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_model(text):
    out = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, m.end(), kind))
    return sorted(out)


def test_pii_base_equals_plain_patterns(docs):
    rnd = random.Random(11)
    bits = ["a@b.c", "@", ".", "x", "%", " ", "-", "1.2.3.4", "255", "256", "+1 (555) 123-4567", "4111 1111 1111 1111", "4111111111111112", "+", "é", "\n", "7", "a@b", "00", "(", "a@b.c%x@d.e", "1.2.3.4.5.6.7.8"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))) for i in range(1500)]
    rows += [(9000 + n, t) for n, (_, t) in enumerate(EDGES)] + [(9100, "x@" + "a." * 20_000 + "b"), (9101, "1 " * 20_000), (9102, "9" * 40_000), (9103, "+1" + " " * 20_000)]
    got = {r.doc_id: [(s.start, s.nth, s.end, s.kind) for s in r.base] for r in pii.find(docs(rows)).collect()}
    for i, t in rows:
        assert got[i] == base_model(t or ""), repr(t)[:100]


def test_pii_bootstraps_from_context(docs):
    rows = [(i, f"please write to mail user{i}@site{i}.org today and go on") for i in range(12)]
    rows += [(50, "please write to mail user51[at]site today and go on"), (51, "version 2.0 of this"), (52, None)]
    got = {r.doc_id: r for r in pii.find(docs(rows)).collect()}
    new = [(s.start, s.end, s.kind) for s in got[50].spans]
    at = rows[12][1].index("user51")
    assert not got[50].base and new == [(at, at + len("user51[at]site"), "email")]
    assert not got[51].spans and not got[52].spans
    clean = {r.row.doc_id: r.clean for r in pii.redact_documents(docs(rows)).collect()}
    assert clean[50] == "please write to mail [EMAIL] today and go on" and clean[51] == rows[13][1] and clean[52] == ""


# ---- decontamination


def tiled(text, item):
    return sum(n for *_, n in decontamination.tile(text, item))


def test_tiles_are_greedy_and_disjoint():
    assert decontamination.tile([1, 2, 3, 4, 5, 6, 7, 8], [1, 2, 3, 4, 5, 6, 7, 8]) == [(0, 0, 8)]
    assert tiled([5, 6, 7, 8, 1, 2, 3, 4], [1, 2, 3, 4, 5, 6, 7, 8]) == 8  # reordered
    assert tiled([1, 2, 3, 9, 1, 2, 3], [1, 2, 3, 4]) == 0  # runs too short
    rnd = random.Random(3)
    for _ in range(200):
        a, b = ([rnd.randint(0, 3) for _ in range(rnd.randint(0, 30))] for _ in "ab")
        tiles = decontamination.tile(a, b, 3)
        for which in (0, 1):
            marked = [x for t in tiles for x in range(t[which], t[which] + t[2])]
            assert len(marked) == len(set(marked))
        assert all(a[i : i + n] == b[j : j + n] and n >= 3 for i, j, n in tiles)
        # No common run of unmarked words is left.
        free = lambda seq, w: {tuple(seq[i : i + 3]) for i in range(len(seq) - 2) if not any(t[w] <= x < t[w] + t[2] for t in tiles for x in range(i, i + 3))}
        assert not free(a, 0) & free(b, 1)


def test_leaks_found_and_clean_left(spark, docs, prose):
    items = [(i, prose(1000 + i, 40)) for i in range(5)] + [(8, None), (9, "too short")]
    w = [t.split() for _, t in items[:5]]
    rows = [
        (1, prose(1, 300) + " " + items[0][1].upper() + ". " + prose(2, 50)), (2, " ".join(w[1][20:] + prose(3, 80).split() + w[1][:20])), (3, prose(4, 500)),
        (4, " ".join(w[2][:12] + prose(5, 30).split())), (5, items[3][1] + " " + items[4][1]), (6, None), (7, ""), (8, "too short"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontamination.find(docs(rows), bench)
    got = {(r.row.doc_id, h.item_id) for r in out.collect() for h in r.hits}
    assert got == {(1, 0), (2, 1), (5, 3), (5, 4)}
    assert out.select("row.*").columns == docs(rows).columns
    assert decontamination.find(docs(rows), bench.limit(0)).where("size(hits) > 0").count() == 0


def test_large_benchmarks_go_in_chunks(spark, docs, prose, monkeypatch):
    monkeypatch.setattr(decontamination, "CHUNK_BYTES", 400)
    items = [(i, prose(2000 + i, 20)) for i in range(12)]
    rows = [(i, prose(i, 30) + " " + t) for i, t in items]
    got = {(r.row.doc_id, h.item_id) for r in decontamination.find(docs(rows), spark.createDataFrame(items, "item_id long, text string"), carry=["doc_id"]).collect() for h in r.hits}
    assert got == {(i, i) for i, _ in items}


def test_many_chunks_are_passes_one_after_the_other(spark, docs, prose, monkeypatch):
    items = [(i, prose(3000 + i, 20)) for i in range(30)] + [(3, prose(3003, 20)), (None, prose(3000, 20))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, prose(i, 30) + " " + t) for i, t in items[:30]] + [(100 + i, items[0][1] + " " + items[1][1]) for i in range(40)] + [(200, None), (200, None), (None, items[5][1]), (201, ""), (202, prose(9, 90))]
    found = lambda: sorted((str(r.row.doc_id), [(h.item_id, h.coverage, h.start, h.end) for h in r.hits]) for r in decontamination.find(docs(rows), bench, carry=["doc_id"]).collect())
    one = found()
    assert len(one) == len(rows) and sum(len(h) for _, h in one) == 30 + 1 + 80 + 1
    monkeypatch.setattr(decontamination, "CHUNK_BYTES", 400)  # some 13 chunks
    seen = []
    broadcast = decontamination._broadcast
    monkeypatch.setattr(decontamination, "_broadcast", lambda s, part: seen.append(broadcast(s, part)) or seen[-1])
    assert found() == one
    assert len(seen) > 10
    plan = decontamination.find(docs(rows), bench, carry=["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan  # the passes are done and written; no chunk is held by what is left


def test_labels_beyond_the_most_frequent_do_not_train(spark):
    rows = spark.range(12_000).selectExpr("id", "case when id % 2 = 0 then 'en' when id % 3 = 0 then 'fr' else concat('x', id) end AS lang").unionByName(spark.range(9).selectExpr("id", "cast(null as string) lang"))
    picked = sampling.stratified(rows, "lang", "id", 300, 400)
    by = {r.lang: r["count"] for r in picked.groupBy("lang").count().collect()}
    assert picked.count() <= 400 and len(by) == 256 and None not in by
    assert min(by["en"], by["fr"]) > 40 and sum(n for x, n in by.items() if x[0] == "x") == 254  # frequent ones get what rare ones leave
    assert sampling.stratified(rows, "lang", "id", 300, 400, labels=2).select("lang").distinct().count() == 2
    assert 98 <= sampling.stratified(rows, "lang", "id", 300, 100).select("lang").distinct().count() <= 100  # at most as many values as rows; of two a row or none
    assert sampling.stratified(rows.limit(0), "lang", "id", 300, 400).isEmpty()


# ---- fingerprints


def test_prefix_hashes_answer_spans():
    import numpy as np

    rnd = random.Random(4)
    text = np.array([rnd.randint(97, 98) for _ in range(300)], np.uint32)
    h = fingerprints.PrefixHashes(text)
    a, b = (np.array([rnd.randint(0, 280) for _ in range(500)]) for _ in "ab")
    n = np.array([rnd.randint(0, 20) for _ in range(500)])
    want = [text[i : i + k].tolist() == text[j : j + k].tolist() for i, j, k in zip(a, b, n, strict=True)]
    assert h.equal(a, b, n).tolist() == want
    most = np.minimum(300 - a, 300 - b)
    want = [next((k for k in range(m) if text[i + k] != text[j + k]), m) for i, j, m in zip(a, b, most, strict=True)]
    assert h.extend(a, b, most).tolist() == want


def test_edits_in_descending_order(docs, prose):
    rows = [(i * 7 % 101, prose(i, 5 + i)) for i in range(60)] + [(200, None), (201, ""), (202, "é" * 10), (300, "same text here"), (301, "same text here"), (None, "a text without an id")]
    got = {r.doc_id: r for r in fingerprints.compare_with_edits(docs(rows)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -1))
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        m = len(t) // 3
        edited = t[: len(t) - m] + u[:m]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), sha(edited)), i
        assert got[i].common_prefix == next((k for k in range(min(len(t), len(edited))) if t[k] != edited[k]), min(len(t), len(edited)))
    assert got[300].fingerprint == got[301].fingerprint and got[301].near_next == 1.0
    assert got[200].fingerprint == got[201].fingerprint
    long = [r for r in got.values() if r.n_chars > 150]
    assert all(r.near_edited > 0.2 > r.near_next for r in long)
    alone = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs(rows)).collect()}
    assert alone == {i: r.fingerprint for i, r in got.items()}
    assert fingerprints.compare_with_edits(docs([(1, "x")]).limit(0)).count() == 0


def test_buckets_keep_the_order(spark, docs):
    rows = [(i * 37 % 1009, f"text {i}") for i in range(400)] + [(None, "none")]
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        dealt = fingerprints.in_descending_order(docs(rows), "doc_id", "text").where("tail = 0").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(dealt) == len(rows) and len({r.bucket for r in dealt}) >= 20
    order = sorted(dealt, key=lambda r: -(r.doc_id if r.doc_id is not None else -1))
    assert [r.bucket for r in order] == sorted(r.bucket for r in dealt)


def test_edits_of_many_equal_ids(docs):
    rows = [(1, f"text number {i}") for i in range(50)]
    assert fingerprints.compare_with_edits(docs(rows)).count() == 50


# ---- classifiers


def test_toxicity_held_out(spark, docs, prose):
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        t, bad = prose(i, rnd.randint(10, 120)).split(), i % 3 == 0
        if bad:
            for _ in range(1 + len(t) // 25):
                t.insert(rnd.randint(0, len(t)), rnd.choice(["vilenasty", "grubhead", "snarlface"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    rows += [(5000 + n, t) for n, (_, t) in enumerate(EDGES)]
    lab = spark.createDataFrame(labels + [(4, None), (5, 7), (None, 1)], "doc_id long, toxic int")
    held = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    model = toxicity.train(docs(rows), lab.where("doc_id is null or crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    got = {r.doc_id: r.score for r in toxicity.score(docs(rows), model).collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, y in labels if i in held]
    assert len(got) == len({i for i, _ in rows}) and sum(right) / len(right) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and got[5000] == got[5001] < 0.5
    none = toxicity.train(docs(rows), lab.where("toxic = 0"))
    assert toxicity.score(docs(rows), none).where("score >= 0.5").count() == 0


def test_language_id(spark):
    alphabets = {f"l{k}": [a + b for a in "bcdfg"[k % 5 :] + "klmnp"[: k % 5] for b in ("ae" if k < 5 else "iou")] for k in range(9)}
    rnd = random.Random(1)
    rows = [(i, " ".join("".join(rnd.choice(alphabets[f"l{i % 9}"]) for _ in range(3)) for _ in range(40)), f"l{i % 9}") for i in range(900)]
    rows += [(2000 + n, t, "l0") for n, (_, t) in enumerate(EDGES)] + [(3000, "bacabada", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("row", F.lit(1))
    model = language_id.train(df.where("doc_id < 600"))
    got = {r["row"].doc_id: r for r in language_id.predict(df, model).collect()}
    right = [got[i].lang_pred == lang for i, _, lang in rows if 600 <= i < 900]
    assert sum(right) / len(right) > 0.95
    assert [got[2000 + n].lang_pred == "und" for n in range(9)] == [True, True, True, False, False, False, False, True, False]
    assert got[2000].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    empty = language_id.train(df.limit(0))
    assert {r.lang_pred for r in language_id.predict(df, empty).collect()} == {"und"}


def test_codewords_are_apart():
    for n in range(2, 12):
        words = language_id.code(n)
        apart = [(words[i] != words[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= max(1, words.shape[1] // 4), n
