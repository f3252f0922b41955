"""Best-fit packing of token sequences by minimum bin slack.

A document is its token ids and an end id. One longer than the limit is cut into pieces of the
limit, of which the first may be shorter; no other is cut. Packing works on the counts of the
lengths, of which there are `limit` at most: for each sequence, a subset-sum table in bitsets over
the lengths still there finds the fullest combination that holds the longest of them, and takes
it away, as often at once as the counts allow. The plan made of these combinations is bounded by
the limit, not by the documents. A piece finds its place by its rank among those of its length.

Cases: null text is the empty text, which is its end id; bytes that are not UTF-8 are read as
U+FFFD; a very long text is tokenized word by word and cut like any other; strings that look like
special tokens are ordinary text; null ids, repeated ids and repeated rows are documents of their
own; pieces of equal length take places in the order in which they were written; other columns are
ignored by `pieces` and kept by `pack`, which fails on a length outside 1 to the limit; an empty
table gives an empty table.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from mergewell.llm import shared, vec

LIMIT, END_ID = 2048, 0
#: Words that a worker remembers; longer ones are tokenized each time.
WORDS, WORD_CHARS = 400_000, 48
#: A space after a space or other white space, and one where the text can be cut.
_RUN, _CUT = re.compile(r" (?<=\s )"), re.compile(r"(?<=\S) ")
#: Printable characters whose classes are the same in all versions of Unicode.
_PLAIN = re.compile(r"[\n !-~¡-¬®-ɏ]*").fullmatch
_tokenizers: dict[str, Words] = {}


class Words(dict):
    """Token ids (little-endian, 32 bits) of a space and a word, of bounded number.

    The tokenizer's pattern always starts a match at a space that follows something else than
    white space, so what lies between two of those is tokenized on its own. Plain words of a
    tokenizer whose ids are its ranks go through tiktoken, which gives the same ids faster; all
    others through the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        way = spec.get("pre_tokenizer") or {}
        ranked = len(vocab) == 256 + len(merges) and all(vocab["".join(m if isinstance(m, list) else m.split(" "))] == 256 + i for i, m in enumerate(merges))
        self.fast = None
        if ranked and way.get("type") == "ByteLevel" and way.get("use_regex") and not way.get("add_prefix_space") and not spec.get("normalizer"):
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}
            ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is not None and _PLAIN(text):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return array("I", self.own.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(f" {word}")
        if len(word) <= WORD_CHARS:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Token ids of a text."""
        first, *rest = _CUT.split(text) if _RUN.search(text) else text.split(" ")
        return self.encode(first) + b"".join(map(self.__getitem__, rest))


def tokenizer(path: str) -> Words:
    if path not in _tokenizers:
        _tokenizers[path] = Words(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """(the id, piece, start, length, ids_crc32 and, if wanted, ids) of every piece."""
    end = array("I", [end_id]).tobytes()
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        words = tokenizer(path)
        for batch in batches:
            for rows in vec.slices(batch, "text"):
                data, off = vec.valid_utf8(*vec.text_bytes(rows.column(1)))
                raw, at, cells, ids = data.tobytes(), [], [], []
                for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                    coded = words.ids(raw[a:b].decode()) + end
                    n = len(coded) // 4
                    cuts = [0, *range(n % limit or limit, n + 1, limit)] if n > limit else [0, n]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        own = coded[4 * x : 4 * y]
                        at.append(i)
                        cells.append((k, x, y - x, zlib.crc32(own)))
                        if with_ids:
                            ids.append(np.frombuffer(own, "<u4"))
                cols = [rows.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(zip(*cells, strict=True), kinds, strict=True)]]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kind = docs.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, out)


class Lengths:
    """Counts of lengths, with bitsets of subset sums: bit t of sums[n] tells whether some of those
    of lengths up to n add up to t."""

    def __init__(self, left: list[int], limit: int) -> None:
        self.left, self.limit = left, limit
        self.sums = [1] * (limit + 1)
        self.longest = limit
        self._add_up(1)

    def _add_up(self, least: int) -> None:
        """Sums anew from the length `least` on."""
        mask = (1 << (self.limit + 1)) - 1
        for n in range(least, self.longest + 1):
            reach, free, copies = self.sums[n - 1], min(self.left[n], self.limit // n), 1
            while free > 0:
                take = min(copies, free)
                reach |= (reach << (n * take)) & mask
                free, copies = free - take, 2 * copies
            self.sums[n] = reach
        while self.longest and not self.left[self.longest]:
            self.longest -= 1

    def fullest(self) -> list[tuple[int, int]]:
        """(length, copies), longest first: of the combinations of at most `limit` that hold the
        longest length there is, a fullest one; of these the one with most of the longest, then of
        the next and so on, so that what is hard to place goes first."""
        n = self.longest
        fits = lambda room: (self.sums[n - 1] & ((1 << (room + 1)) - 1)).bit_length() - 1
        _, copies = max((c * n + fits(self.limit - c * n), c) for c in range(1, min(self.left[n], self.limit // n) + 1))
        found, target = [(n, copies)], fits(self.limit - copies * n)
        while target:
            n = min(n - 1, target)
            for c in range(min(self.left[n], target // n), 0, -1):
                if self.sums[n - 1] >> (target - c * n) & 1:
                    found.append((n, c))
                    target -= c * n
                    break
        return found

    def take(self, mix: list[tuple[int, int]], times: int) -> None:
        """Removes a combination so many times."""
        changed = []
        for n, c in mix:
            had = min(self.left[n], self.limit // n)
            self.left[n] -= c * times
            if min(self.left[n], self.limit // n) < had:
                changed.append(n)
        if changed:
            self._add_up(min(changed))


class Plan:
    """Places for counts of lengths: for each length and combination, the rank at which the places
    there begin, how many a sequence has, the first sequence and the offset."""

    SHIFT = 50

    def __init__(self, counts: dict[int, int], limit: int) -> None:
        lengths = Lengths([counts.get(n, 0) for n in range(limit + 1)], limit)
        used, rows, self.sequences = [0] * (limit + 1), [], 0
        while lengths.longest:
            mix = lengths.fullest()
            times, offset = min(lengths.left[n] // c for n, c in mix), 0
            for n, c in mix:
                rows.append(((n << self.SHIFT) + used[n], c, self.sequences, offset, n))
                used[n] += c * times
                offset += n * c
            lengths.take(mix, times)
            self.sequences += times
        self.table = np.array(sorted(rows), np.int64).reshape(-1, 5)

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces of these lengths and ranks among their length."""
        key = (length << self.SHIFT) + rank
        row = self.table[np.searchsorted(self.table[:, 0], key, side="right") - 1]
        nth = key - row[:, 0]
        return row[:, 2] + nth // row[:, 1], row[:, 3] + nth % row[:, 1] * row[:, 4]


def pack(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """`rows`, which have a length, with the sequence_id and the offset of their place. Rows are
    written once, numbered within their task and length; the counts of earlier tasks make ranks of
    these numbers. Counts of lengths, `limit` at most, come to the driver."""
    schema = rows.schema

    def number(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in batches:
            size = np.asarray(batch.column(batch.schema.get_field_index("length")).cast(pa.int64()).fill_null(0))
            if len(size) and not (size.min() >= 1 and size.max() <= limit):
                raise ValueError(f"lengths must be from 1 to {limit}")
            order = np.argsort(size, kind="stable")
            run = size[order]
            first = np.searchsorted(run, run)
            nth = np.empty(len(size), np.int64)
            nth[order] = seen[run] + np.arange(len(run)) - first
            seen += np.bincount(size, minlength=limit + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(size), part)), pa.array(nth)], [*batch.schema.names, "_part", "_nth"])

    numbered = StructType([*schema.fields, StructField("_part", LongType()), StructField("_nth", LongType())])
    held, _ = shared.table(rows.mapInArrow(number, numbered))
    runs = held.groupBy(F.col("length").cast("long").alias("_length"), "_part").agg(F.count("*").alias("n"))
    counts = {r["_length"]: r["n"] for r in runs.groupBy("_length").agg(F.sum("n").alias("n")).collect()}
    plan = held.sparkSession.sparkContext.broadcast(Plan(counts, limit))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        sequence, offset = plan.value.places(np.asarray(length), np.asarray(rank))
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    before = shared.before(runs, ["_length"], "_part", "n").select("_length", "_part", "_before")
    met = held.withColumn("_length", F.col("length").cast("long")).join(before, ["_length", "_part"])
    placed = met.withColumn("_place", place(F.col("_length"), F.col("_before") + F.col("_nth")))
    return placed.select(*schema.names, "_place.sequence_id", "_place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, ids): packed pieces with ids put together. A sequence is one row of
    `limit` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
