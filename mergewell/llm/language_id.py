"""Language identification with error-correcting output codes.

Each language has a codeword of +1 and -1; one linear classifier of hashed byte n-grams per
bit predicts it. Up to seven languages use the exhaustive code, more use the random code with
the largest least distance of a fixed number of draws. Decoding sums, over the bits, the
logistic loss of the predicted margin against a codeword's bit, weighted by how well the bit
was learned, and takes the nearest codeword; a small lead over the next one is flagged.

Cases: text that is null or has no letter is `und` with score 0 and not ambiguous; without
training rows everything is; rows with a null id or language don't train; of codewords equally
near the first language in order of name wins, flagged ambiguous; a very long text is counted
whole, in a slice of its own; bytes that are not UTF-8 are read as U+FFFD; repeated rows and ids
are predicted alike; extra columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergewell.llm import sampling, vec

ORDERS = (2, 3, 4)
BITS = 13
#: The expected sizes of the training sample: rows a language, and rows in all.
PER_LANGUAGE, IN_ALL = 300, 2000
LEAD = 0.05
UNKNOWN = "und"
U64 = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
for _c in range(128):
    if not chr(_c).isalpha():
        _FOLD[_c] = 32
_ALPHA = np.zeros(256, bool)
_ALPHA[[c for c in range(128) if chr(c).isalpha()]] = True


def counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows by 2**BITS: how often each hashed n-gram occurs in each row."""
    n = len(off) - 1
    size = np.diff(off)
    wide = np.full(len(data) + 2 * n, 32, np.uint8)
    wide[np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, size)] = _FOLD[data]
    rows = np.repeat(np.arange(n), size + 2)
    x = wide.astype(np.uint32)
    packed, reach = x, 1
    out = np.zeros(n << BITS, np.int64)
    for k in ORDERS:
        while reach < k and len(packed) > 1:
            packed = packed[:-1] | (x[reach:] << np.uint32(8 * reach))
            reach += 1
        if reach < k:
            break
        own = rows[: len(packed)]
        inside = own == rows[k - 1 :]
        h = ((packed * np.uint32(0x9E3779B1)) ^ np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)
        out += np.bincount((own[inside] << BITS) | h[inside], minlength=n << BITS)
    return out.reshape(n, 1 << BITS)


def scaled(table: np.ndarray) -> np.ndarray:
    """Logarithms of the counts, of unit length. A float table is changed in place."""
    x = table.astype(np.float32, copy=False)
    np.log1p(x, out=x)
    x /= (np.sqrt(np.einsum("ij,ij->i", x, x)) + 1e-9)[:, None]
    return x


def code(n: int) -> np.ndarray:
    """n codewords as rows of +1 and -1."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 7:
        bits = 2 ** (n - 1) - 1
        rows = [[1] * bits]
        for i in range(1, n):  # the rest of the exhaustive code: runs of halving length
            run = 2 ** (n - 1 - i)
            rows.append([-1 if (j // run) % 2 == 0 else 1 for j in range(bits)])
        return np.array(rows, np.float32)
    rng, best, far = np.random.default_rng(n), None, -1.0
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        draw = rng.choice(np.array([-1, 1], np.float32), (n, bits))
        apart = (bits - draw @ draw.T) / 2
        least = (apart + np.eye(n) * bits).min()
        if least > far and (np.abs(draw.sum(axis=0)) < n).all():
            best, far = draw, least
    return best


class Model:
    """Codewords, bit classifiers and their weights."""

    def __init__(self, table: np.ndarray, langs: list[str], ridge: float = 0.3) -> None:
        self.langs = sorted(set(langs))
        self.words = code(len(self.langs))
        at = {x: i for i, x in enumerate(self.langs)}
        label = np.array([at[x] for x in langs], np.int64)
        if not len(self.langs):
            return
        x, y = scaled(table), self.words[label]
        share = np.bincount(label, minlength=len(self.langs))[label]
        gram = (x @ x.T).astype(np.float64) + 1.0  # the added 1 is the bias feature
        gram[np.diag_indices(len(x))] += ridge * share / share.mean()
        dual = np.linalg.solve(gram, y).astype(np.float32)
        self.weights, self.bias = x.T @ dual, dual.sum(axis=0)
        right = ((x @ self.weights + self.bias) * y > 0).mean(axis=0)
        self.trust = (np.clip(right - 0.5, 0.01, None) / np.clip(right - 0.5, 0.01, None).mean()).astype(np.float32)

    def predict(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, ambiguous) of each row."""
        margin = scaled(table) @ self.weights + self.bias
        loss = np.logaddexp(0, -4 * self.words[None, :, :] * margin[:, None, :]) @ self.trust
        nearest = loss.argmin(axis=1)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        order = np.sort(loss, axis=1)
        lead = (order[:, 1] - order[:, 0]) / self.words.shape[1] if loss.shape[1] > 1 else np.ones(len(loss))
        return nearest, p[np.arange(len(p)), nearest], lead < LEAD


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> Model:
    """Fit on a bounded sample: `per_language` rows a language and `in_all` in all, about. The
    features are counted on the executors, so the driver gets 2**BITS numbers a row at most."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null")
    picked = sampling.stratified(rows, "lang", "id", per_language, in_all)

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, "text", 1 << 20):
                for i in range(0, part.num_rows, 256):
                    some = part.slice(i, 256)
                    table = counts(*vec.text_bytes(some.column(0)))
                    r, c = np.nonzero(table)
                    cuts = np.searchsorted(r, np.arange(len(table) + 1)).astype(np.int32)
                    lists = [pa.ListArray.from_arrays(cuts, pa.array(v.astype(np.int32))) for v in (c, table[r, c])]
                    yield pa.RecordBatch.from_arrays([some.column(1), *lists], ["lang", "at", "n"])

    got = picked.select("text", "lang").mapInArrow(run, "lang string, at array<int>, n array<int>").toArrow()
    table, row = np.zeros((got.num_rows, 1 << BITS), np.float32), 0
    for part in got.to_batches():  # piece by piece: the driver is small
        for at, n in zip(part.column(1), part.column(2), strict=True):
            table[row, np.asarray(at.values)] = np.asarray(n.values)
            row += 1
    langs = got.column("lang").to_pylist()
    del got
    model = Model(table, langs)
    del table
    vec.give_back()
    return model


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    size = np.diff(off)
    seen = np.zeros(len(size), bool)
    full = size > 0
    if full.any():
        seen[full] = np.logical_or.reduceat(_ALPHA[data], off[:-1][full])
    for i in np.flatnonzero(full & ~seen):
        seen[i] = any(c.isalpha() for c in data[off[i] : off[i + 1]].tobytes().decode("utf-8"))
    return seen


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Columns `row` (a struct of all of the input's columns), lang_pred, score and ambiguous;
    one narrow stage. Only the texts visit Python. The model has a fixed size for each language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["lang_pred", "score", "ambiguous"]

    def judge(texts: pa.Array):
        m = shared.value
        for part in vec.slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", 1 << 20):
            for i in range(0, part.num_rows, 256):
                data, off = vec.valid_utf8(*vec.text_bytes(part.slice(i, 256).column(0)))
                known = has_letter(data, off) & bool(m.langs)
                lang, p, unsure = np.zeros(len(known), np.int64), np.zeros(len(known)), np.zeros(len(known), bool)
                if known.any():
                    lang, p, unsure = m.predict(counts(data, off))
                told = np.array([*m.langs, UNKNOWN], object)[np.where(known, lang, len(m.langs))]
                yield [pa.array(told, pa.string()), pa.array(np.where(known, p, 0.0).astype(np.float64)), pa.array(unsure & known)]

    @F.arrow_udf("lang_pred string, score double, ambiguous boolean")
    def told(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            parts = list(judge(batch))
            yield pa.StructArray.from_arrays([pa.concat_arrays(x) for x in zip(*parts, strict=True)], names) if parts else pa.array([], _TOLD)

    # Marked nondeterministic so that a filter on the result doesn't compute it a second time.
    text = F.col(text_col).cast("string")
    return docs.select(F.struct("*").alias("row"), told.asNondeterministic()(text).alias("told")).select("row", *[f"told.{c}" for c in names])


_TOLD = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])
