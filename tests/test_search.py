"""Ranked search against a plain model."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from mergewell.functions.text import normalize_one
from mergewell.operators import search as S
from tests.test_sources import joined

ROWS = "mbid string, title string, artist string"
ASKED = "request_id long, title string, artist string"


def feats(text):
    words = [w for w in (text or "").split(" ") if w]
    return {f"w{w}" for w in words} | {"g" + f"^{w}$"[i : i + 3] for w in words for i in range(len(w))}


def model(asked, rows, limit=5, offset=0, share=50):
    entries = collections.defaultdict(list)
    for i, t, a in rows:
        if normalize_one(t):
            entries[normalize_one(t), normalize_one(a) or ""].append(i)
    n, df = len(entries), collections.Counter(("t", f) for t, _ in entries for f in feats(t))
    df.update(("a", f) for _, a in entries for f in feats(a))
    w = lambda side, f: max(1, math.floor(1000 * math.log((n + 1) / (df[side, f] + 0.5))))
    mass = lambda side, fs: sum(w(side, f) for f in fs)
    out = []
    for rid, qt, qa in asked:
        qt, qa = normalize_one(qt), normalize_one(qa)
        if not qt:
            continue
        found = []
        for (t, a), ids in entries.items():
            score = 0
            for side, q, h in (("t", feats(qt), feats(t)), ("a", feats(qa), feats(a))):
                if not q:
                    continue
                both = mass(side, q & h)
                if both * 100 < mass(side, q) * share:
                    break
                score += 2000 * both // (mass(side, q) + mass(side, h))
            else:
                found += [(-score, i) for i in ids]
        out += [(rid, k, i, -s) for k, (s, i) in enumerate(sorted(found)[offset : offset + limit])]
    return sorted(out)


def found(spark, asked, rows, **kw):
    index = S.build(spark.createDataFrame(rows, ROWS))
    return sorted(tuple(r) for r in S.find(spark.createDataFrame(asked, ASKED), index, **kw).collect())


@pytest.fixture(scope="module")
def shelf():
    rnd = random.Random(11)
    words = "the love of night blue moon river dark side heart fire rain song golden ocean mirror".split()
    rows = [(f"m{i:04}", " ".join(rnd.choices(words, k=rnd.randint(1, 5))), rnd.choice(["The Band", "Björk", "Sigur Rós", "AC/DC", "", None])) for i in range(250)]
    rows += [(f"h{i:04}", "Intro", "The Band") for i in range(120)]  # one entry of many rows
    return rows + [("x1", "!!!", "!!!"), ("x2", None, "Björk"), ("x3", "Ágætis byrjun", "Sigur Rós"), ("x4", "Straße 7", None), ("m0001", "twice", "X"), ("m0001", "twice", "X")]


def test_found_as_in_the_model(spark, shelf):
    rnd = random.Random(12)
    asked = [(i, t, a if i % 2 else None) for i, (_, t, a) in enumerate(rnd.sample(shelf, 60))]
    for i in range(60, 120):  # a letter lost, a word lost, words turned
        t = (rnd.choice(shelf)[1] or "dark moon").lower()
        k = rnd.randrange(len(t))
        asked.append((i, [t[:k] + t[k + 1 :], " ".join(t.split()[1:]), " ".join(t.split()[::-1])][i % 3], rnd.choice([None, "bjork", "the band", "sigur ros"])))
    asked += [(200, "", "Björk"), (201, "...", None), (202, "agætis byrjun", "sigur rós"), (203, "STRASSE", None), (204, "zzzz", None), (205, "intro", "the band"), (205, "intro", "the band"), (206, "the", None)]
    assert found(spark, asked, shelf) == model(asked, shelf)
    assert found(spark, asked, shelf, limit=7, offset=3, share=30) == model(asked, shelf, 7, 3, 30)


def test_misspelt_and_partial_titles(spark, shelf):
    top = {r[0]: r[2] for r in found(spark, [(1, "agaetis byrjun", None), (2, "byrjun", None), (3, "Byrjun Ágætis", "sigur"), (4, "Ágætis byrjn", None)], shelf) if r[1] == 0}
    assert top == {1: "x3", 2: "x3", 3: "x3", 4: "x3"}


def test_frequent_features_lead_nowhere(spark):
    """Of a request, only features that can still reach the floor are looked up."""
    rows = [(f"m{i:05}", f"the record {i:05}", "a") for i in range(3000)]
    index = S.build(spark.createDataFrame(rows, ROWS))
    asked = spark.createDataFrame([(1, "the record 01234", None)], ASKED)
    frequent = index.weights.where("feature = 'wthe'").first()
    assert frequent.df == 3000 and frequent.w == 1
    got = S.find(asked, index).collect()
    assert got[0].id == "m01234" and got[0].score == 1000
    assert sorted(tuple(r) for r in got) == model([(1, "the record 01234", None)], rows)


def test_titles_of_few_words_meet_in_blocks(spark, monkeypatch):
    """Nearly every entry shares half of every request, and no join makes these pairs."""
    first, second = "large small hot cold".split(), "ring bolt plate".split()
    rows = [(f"m{i:04}", f"{first[i % 4]} {second[i % 3]} {i % 50}", [None, "Brand 1", "Brand 22"][i % 7 % 3]) for i in range(900)]
    asked = [(i, f"{first[i % 4]} {second[i % 3]}" + f" {i % 41}" * (i % 2), [None, "brand 1", "brand"][i % 5 % 3]) for i in range(0, 600, 2)]
    asked += [(i, f"{second[i % 3]} {first[i % 4]} {i % 60}", "brand 22") for i in range(1001, 1200)]
    monkeypatch.setattr(S, "ENTRIES", 200)
    index = S.build(spark.createDataFrame(rows, ROWS))
    assert index.blocks > 2
    got = S.find(spark.createDataFrame(asked, ASKED), index, limit=4, offset=1)
    assert sorted(tuple(r) for r in got.collect()) == model(asked, rows, 4, 1)
    assert joined(got) <= len(asked) * 5 * (index.blocks + 2)


def test_nothing_to_find(spark):
    assert found(spark, [(1, "a", None)], []) == []
    assert found(spark, [], [("m", "a", None)]) == []
    with pytest.raises(ValueError, match="results reach to 3"):
        S.find(spark.createDataFrame([], ASKED), S.build(spark.createDataFrame([], ROWS), depth=3), limit=2, offset=2)


def test_met_of_few_and_of_many():
    """Texts are weighed alike whether a request names few of a block or most, one request after another."""
    rnd = random.Random(5)
    texts = [f"s {i:04d}" for i in range(400)]
    held = S._Held(pa.array(texts), pa.array([sorted(feats(t)) for t in texts]), np.full(len(texts), 9000))
    df = collections.Counter(f for t in texts for f in feats(t))
    for _ in range(200):
        asked = sorted(feats(rnd.choice(texts)) | feats(rnd.choice(("0123 x", "s", "99"))))
        w = np.array([max(1, math.floor(1000 * math.log(401 / (df[f] + 0.5)))) for f in asked])
        order = sorted(range(len(asked)), key=lambda i: -w[i])
        lead, total = np.zeros(len(asked), bool), int(w.sum())
        for k, i in enumerate(order):
            lead[i] = sum(w[j] for j in order[k:]) * 100 >= total * 50
        at = np.array([held.names.index(f).as_py() for f in asked])
        got, score = held.met(at, w, lead, total, 50)
        both = [sum(int(x) for f, x in zip(asked, w, strict=True) if f in feats(t)) for t in texts]
        want = [i for i, b in enumerate(both) if b * 100 >= total * 50]
        assert got.tolist() == want and score.tolist() == [2000 * both[i] // (total + 9000) for i in want]
        assert not held.got.any()
