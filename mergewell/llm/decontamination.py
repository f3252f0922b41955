"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased words (letters and digits; other ASCII separates). Documents and items
that share a TILE-word seed meet; then the item is tiled: running Karp-Rabin finds the longest
common runs of unmarked words, those are marked in both texts, longest first and never
overlapping, and the search length falls until no run of TILE words is left. The share of the
item's words under tiles decides, whatever their order, so passages put together in another
order count as well.

The seeds of the benchmark are broadcast in chunks of about CHUNK_BYTES of text. A larger benchmark
takes one pass over the documents after the other: the leaks that a pass finds, one row for each
different text that has any, are written to the shared folder before the next chunk is read, so
the driver and a task hold one chunk at a time.

Cases: null texts and items hold no words; items of fewer than TILE words can't be tiled and
match nothing; items of fewer than 2 x TILE words must be found whole in one run, as one chance
seed is most of them; items with a null id are left out, repeated items are reported each; of
equally long matches the first in the text is marked, then the first in the item; a very long
text is searched whole, only its words under seeds are tiled; repeated rows and ids are judged
alike; extra columns are ignored or carried; empty tables give empty results.
"""

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergewell.llm import vec
from mergewell.llm.shared import HEAVY, SPLIT, table

TILE, COVERAGE = 4, 0.5
CHUNK_BYTES = 8 << 20
_BITS = 22
_HITS = "array<struct<item_id:bigint,coverage:double,tiles:int,longest:int,start:int,end:int>>"
U64 = np.uint64
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
for _c in range(128):
    if not chr(_c).isalnum():
        _FOLD[_c] = 32


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of each row's first word)."""
    flat = _FOLD[data]
    if len(flat) > 1:  # capitals of the Latin-1 letters, two bytes each
        high = np.flatnonzero((flat[:-1] == 0xC3) & (flat[1:] >= 0x80) & (flat[1:] <= 0x9E) & (flat[1:] != 0x97)) + 1
        flat[high] += 32
    starts, ends, first = vec.word_spans(flat, off)
    return vec.word_hashes(flat, starts, ends), first


def tile(text: list[int], item: list[int], least: int = TILE) -> list[tuple[int, int, int]]:
    """Tiles (place in text, place in item, length), by running Karp-Rabin matching."""
    base, mod = 1_000_003, (1 << 61) - 1
    used_text, used_item = [False] * len(text), [False] * len(item)

    def rolling(seq: list[int], used: list[bool], size: int):
        """(start, hash) of each run of `size` unmarked words."""
        top = pow(base, size - 1, mod)
        h = run = 0
        for i, x in enumerate(seq):
            if used[i]:
                h = run = 0
                continue
            if run >= size:
                h = (h - seq[i - size] * top) % mod
            h = (h * base + x) % mod
            run += 1
            if run >= size:
                yield i - size + 1, h

    tiles, size = [], max(least, min(len(text), len(item)) // 2)
    while True:
        places = defaultdict(list)
        for i, h in rolling(item, used_item, size):
            places[h].append(i)
        found = []
        for t, h in rolling(text, used_text, size):
            for i in places.get(h, ()):
                n = 0
                while t + n < len(text) and i + n < len(item) and text[t + n] == item[i + n] and not used_text[t + n] and not used_item[i + n]:
                    n += 1
                if n >= size:
                    found.append((-n, t, i))
        longest = -min(found)[0] if found else 0
        if longest > 2 * size:
            size = longest
            continue
        for n, t, i in sorted(found):
            n = -n
            if not any(used_text[t : t + n]) and not any(used_item[i : i + n]):
                used_text[t : t + n] = used_item[i : i + n] = [True] * n
                tiles.append((t, i, n))
        if size == least:
            # Runs that lost words to longer tiles may still hold shorter ones.
            if not any(True for n, t, i in found if not any(used_text[t : t - n]) and not any(used_item[i : i - n])) and not _left(text, item, used_text, used_item, least):
                return tiles
        size = max(least, size // 2)


def _left(text: list[int], item: list[int], used_text: list[bool], used_item: list[bool], least: int) -> bool:
    """Whether some run of `least` unmarked words is common still."""
    runs = lambda seq, used: {tuple(seq[i : i + least]) for i in range(len(seq) - least + 1) if not any(used[i : i + least])}
    return bool(runs(text, used_text) & runs(item, used_item))


class Seeds:
    """Seeds of a chunk of the benchmark, for a worker."""

    def __init__(self, items: list[tuple[int, str | None]], least: int) -> None:
        texts = pa.array([t or "" for _, t in items], pa.string())
        flat, first = words(*vec.text_bytes(texts))
        whole = vec.whole_grams(first, least)
        self.ids = [i for i, _ in items]
        self.items = [flat[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        grams = vec.gram_hashes(flat, least)[whole] if len(whole) else np.zeros(0, U64)
        self.size = np.diff(first)
        own = np.searchsorted(first, whole, side="right") - 1
        order = np.argsort(grams, kind="stable")
        self.grams, self.own, self.place = grams[order], own[order], (whole - first[own])[order]
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.grams & U64((1 << _BITS) - 1)).astype(np.int64)] = True


def leaks(data: np.ndarray, off: np.ndarray, seeds: Seeds, least: int, coverage: float) -> list[list[dict]]:
    """The items that each row leaks."""
    out: list[list[dict]] = [[] for _ in range(len(off) - 1)]
    flat, first = words(data, off)
    if len(flat) < least or not len(seeds.grams):
        return out
    grams = vec.gram_hashes(flat, least)
    at = np.flatnonzero(seeds.maybe[(grams & U64((1 << _BITS) - 1)).astype(np.int64)])
    lo, hi = (np.searchsorted(seeds.grams, grams[at], side) for side in ("left", "right"))
    at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
    row = np.searchsorted(first, at, side="right") - 1
    inside = at + least <= first[row + 1]
    at, lo, n, row = at[inside], lo[inside], n[inside], row[inside]
    met = defaultdict(lambda: (set(), []))
    for p, a, k, r in zip(at.tolist(), lo.tolist(), n.tolist(), row.tolist(), strict=True):
        for j in range(a, a + k):
            places, hits = met[r, int(seeds.own[j])]
            places.add(int(seeds.place[j]))
            hits.append(p)
    for (r, own), (places, hits) in met.items():
        size = int(seeds.size[own])
        need = coverage if size >= 2 * least else 1.0
        if len(places) * least < need * size:  # even as tiles of their own they cover too little
            continue
        # Only words under seeds can be under tiles; gaps become words that match nothing.
        near, text, spot, end = sorted(set(hits)), [], [], -1
        for p in near:
            if p > end and text:
                text.append(-1)
                spot.append(-1)
            text.extend(flat[max(p, end) : p + least].tolist())
            spot.extend(range(max(p, end), p + least))
            end = p + least
        tiles = tile(text, seeds.items[own], least)
        share = sum(k for _, _, k in tiles) / size
        if share >= need and (size >= 2 * least or len(tiles) == 1):
            spots = [spot[t] for t, _, _ in tiles], [spot[t + k - 1] + 1 for t, _, k in tiles]
            out[r].append({"item_id": seeds.ids[own], "coverage": share, "tiles": len(tiles), "longest": max(k for _, _, k in tiles), "start": int(min(spots[0]) - first[r]), "end": int(max(spots[1]) - first[r])})
    for found in out:
        found.sort(key=lambda x: x["item_id"])
    return out


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", carry: list[str] | None = None, item_col: str = "item_id", item_text: str = "text", least: int = TILE, coverage: float = COVERAGE) -> DataFrame:
    """Columns `row` (a struct of the carried columns, all by default) and `hits`: the leaked items with
    coverage, number and longest of tiles, and the words of the text from the first tile to the
    last. One narrow stage, or where the benchmark is more than a chunk a written pass for each."""
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).where("id is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    chunks = max(1, math.ceil(size / CHUNK_BYTES))
    none = F.array().cast(_HITS)
    carried = F.struct(*(docs.columns if carry is None else carry)).alias("row")
    if chunks == 1:
        search = _search(_broadcast(docs.sparkSession, items), least, coverage)
        return docs.select(carried, F.coalesce(search(F.col(text_col)), none).alias("hits"))
    # What a text leaks depends on it alone, so leaks are kept by two hashes of the text.
    keys = [F.xxhash64(F.col(text_col)).alias("_h"), F.xxhash64(F.lit("text"), F.col(text_col)).alias("_g")]
    passes = [_pass(docs, text_col, keys, items.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == chunk), least, coverage) for chunk in range(chunks)]
    every = reduce(DataFrame.unionByName, passes).groupBy("_h", "_g").agg(F.array_sort(F.flatten(F.collect_list("_hits"))).alias("hits"), F.max("_n").alias("_n"))
    every, _ = table(every)
    # Texts of many rows, HEAVY at most, are known to all; their rows are dealt over SPLIT tasks.
    hot = F.col("_n") >= max(2, docs.count() // HEAVY)
    texts = docs.where(F.col(text_col).isNotNull()).select(carried, *keys).join(F.broadcast(every.where(hot).select("_h", "_g", F.lit(True).alias("_hot"))), ["_h", "_g"], "left")
    dealt = texts.withColumn("_salt", F.when(F.col("_hot"), F.spark_partition_id() % SPLIT).otherwise(0))
    copies = every.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(hot, SPLIT - 1).otherwise(0))))
    met = dealt.join(copies, ["_h", "_g", "_salt"], "left").select("row", F.coalesce("hits", none).alias("hits"))
    return met.unionByName(docs.where(F.col(text_col).isNull()).select(carried, none.alias("hits")))


def _pass(docs: DataFrame, text_col: str, keys: list[Column], items: DataFrame, least: int, coverage: float) -> DataFrame:
    """Written leaks of the items of a chunk: one row for each text that has any."""
    shared = _broadcast(docs.sparkSession, items)
    found = docs.where(F.col(text_col).isNotNull()).select(*keys, _search(shared, least, coverage)(F.col(text_col)).alias("_hits")).where(F.size("_hits") > 0)
    kept, _ = table(found.groupBy("_h", "_g").agg(F.any_value("_hits").alias("_hits"), F.count("*").alias("_n")))
    shared.destroy()
    return kept


def _broadcast(spark: SparkSession, items: DataFrame) -> Broadcast:
    """The items of a chunk, on every executor."""
    return spark.sparkContext.broadcast([tuple(r) for r in items.collect()])


def _search(shared: Broadcast, least: int, coverage: float):
    """A function of texts: the items of one chunk that each leaks. Only texts visit Python."""
    of = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32()), ("longest", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(_HITS)
    def search(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seeds = Seeds(shared.value, least)
        for batch in texts:
            found = []
            for some in vec.slices(pa.RecordBatch.from_arrays([batch], ["text"]), "text"):
                found += leaks(*vec.text_bytes(some.column(0)), seeds, least, coverage)
            yield pa.array(found, of)

    # Marked nondeterministic so that a filter on the result doesn't compute it a second time.
    return search.asNondeterministic()
