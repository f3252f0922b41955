"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are hashed 4- and 5-grams of the lower-cased bytes, present or absent. On a bounded
sample of labelled rows the log ratio of the class-wise document frequencies scales each
feature; the most telling ones enter a logistic regression over the scaled, length-normalised
features. Scoring is one narrow pass over whole texts with one table of weights.

Cases: null and empty texts get the score of no features; rows without a usable label don't
train; an id with both labels trains as toxic; without labels of both kinds every score is
1 / (1 + e), about 0.27 (never toxic); features of equal weight are kept in no stated order; a
very long text is one slice of its own; repeated rows and ids are scored alike; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergewell.llm import sampling, vec

ORDERS = (4, 5)
BITS = 20
KEPT = 4096
U64 = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
for _c in range(128):
    if not chr(_c).isalnum():
        _FOLD[_c] = 32


def _grams(data: np.ndarray, off: np.ndarray):
    """(row, feature) of every n-gram; each text stands between spaces."""
    n = np.diff(off)
    wide = np.full(len(data) + 2 * len(n), 32, np.uint8)
    shift = np.repeat(2 * np.arange(len(n)) + 1, n)
    wide[np.arange(len(data)) + shift] = _FOLD[data]
    rows = np.repeat(np.arange(len(n), dtype=np.int32), n + 2)
    x = wide.astype(U64)
    packed, reach = x, 1
    for k in ORDERS:
        while reach < k:
            if len(packed) < 2:
                return
            packed = packed[:-1] | (x[reach:] << U64(8 * reach))
            reach += 1
        own = rows[: len(packed)]
        inside = own == rows[k - 1 :]
        h = (packed * U64(0x9E3779B97F4A7C15) + U64(k) * U64(0xD6E8FEB86659FD93)) >> U64(64 - BITS)
        yield own, h.astype(np.int32), inside


def features(data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct features of each row and its number of n-grams."""
    keys, total = [], np.zeros(len(off) - 1, np.int64)
    for row, h, inside in _grams(data, off):
        row, h = row[inside], h[inside]
        total += np.bincount(row, minlength=len(total))
        keys.append(row.astype(np.int64) << BITS | h)
    keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    cuts = np.searchsorted(keys, np.arange(len(off)) << BITS)
    low = (keys & ((1 << BITS) - 1)).astype(np.int32)
    return [low[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], total


def fit(rows: list[tuple[np.ndarray, int, int]], ridge: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """(weight of every feature, bias) from (features, number of n-grams, label) rows."""
    weights = np.zeros(1 << BITS, np.float32)
    y = np.array([label for _, _, label in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return weights, -1.0
    df = np.ones((2, 1 << BITS), np.float32)  # one pseudo-document each
    for idx, _, label in rows:
        df[label, idx] += 1
    size = np.array([(y == c).sum() for c in (0, 1)], np.float32) + 2
    ratio = np.log(df[1] / size[1]) - np.log(df[0] / size[0])
    seen = df.sum(axis=0) - 2
    use = np.where(seen >= 3, np.abs(ratio) * np.sqrt(seen), 0)
    kept = np.sort(np.argpartition(-use, KEPT)[:KEPT])
    kept = kept[use[kept] > 0]
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    x = np.zeros((len(rows), len(kept)), np.float32)
    for i, (idx, n, _) in enumerate(rows):
        at = place[idx]
        at = at[at >= 0]
        x[i, at] = ratio[kept[at]] / np.sqrt(n + 1.0)
    scale = np.sqrt((x**2).sum(axis=1).mean()) + 1e-9
    x /= scale
    v, bias = np.ones(len(kept), np.float32), 0.0
    mv, mb = np.zeros_like(v), 0.0
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
    rate = 4.0
    for _ in range(steps):  # full-batch gradient with momentum on balanced classes
        z = np.clip(x @ v + bias, -30, 30)
        g = weight * (1 / (1 + np.exp(-z)) - y)
        mv = 0.9 * mv + x.T @ g + ridge * v
        mb = 0.9 * mb + float(g.sum())
        v -= rate * mv
        bias -= rate * mb
    weights[kept] = v * ratio[kept] / scale
    return weights, float(bias - _cut(x @ v + bias, y))


def _cut(z: np.ndarray, y: np.ndarray) -> float:
    """Where to part the sample: the middle of the widest gap among the cuts with the least
    balanced error. Sparse evidence in long texts scores low but above all clean texts."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    missed = np.cumsum(y) / max(y.sum(), 1)  # positives at or below each value
    wrong = 1 - np.cumsum(1 - y) / max((1 - y).sum(), 1)  # negatives above it
    gaps = np.append(np.diff(z), 0.0)
    error = missed + wrong
    best = np.flatnonzero((error <= error[gaps > 0].min(initial=2.0) + 1e-9) & (gaps > 0))
    if not len(best):
        return 0.0
    i = best[np.argmax(gaps[best])]
    return float((z[i] + z[i + 1]) / 2)


def score_rows(data: np.ndarray, off: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    z, total = np.zeros(len(off) - 1), np.zeros(len(off) - 1, np.int64)
    keys = []
    for row, h, inside in _grams(data, off):
        total += np.bincount(row[inside], minlength=len(total))
        hit = np.flatnonzero((weights[h] != 0) & inside)
        keys.append(row[hit].astype(np.int64) << BITS | h[hit])
    if keys:
        keys = np.unique(np.concatenate(keys))
        z = np.bincount(keys >> BITS, weights[keys & ((1 << BITS) - 1)], minlength=len(total))
    return 1 / (1 + np.exp(-np.clip(z / np.sqrt(total + 1.0) + bias, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = 1500) -> tuple[np.ndarray, float]:
    """Fit on at most about `per_label` labelled rows of each kind. Labels decide the sample, so
    its size is bounded before it meets the texts, and its join can broadcast."""
    chosen = sampling.stratified(labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")), "label", "id", per_label, 2 * per_label)
    chosen = chosen.groupBy("id").agg(F.max("label").alias("label"))
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, "text"):
                found, total = features(*vec.text_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int32())), pa.array(total)], ["label", "features", "n"])

    got = picked.select("label", "text").mapInArrow(run, "label int, features array<int>, n long").toArrow()
    flat = got.column("features").combine_chunks()
    cuts, values = np.asarray(flat.offsets), np.asarray(flat.values)
    order = zip(cuts[:-1], cuts[1:], got.column("n").to_pylist(), got.column("label").to_pylist(), strict=True)
    model = fit([(values[a:b], n, label) for a, b, n, label in order])
    del got, flat, values, order
    vec.give_back()
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and score of every row; one narrow stage. The weights have a fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        weights, bias = shared.value
        for batch in batches:
            for part in vec.slices(batch, "text"):
                data, off = vec.text_bytes(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score_rows(data, off, weights, bias))], ["doc_id", "score"])

    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return out.withColumnRenamed("doc_id", id_col)
