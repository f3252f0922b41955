"""Ranked text search of titles and artists, for lists of requests.

A text is known by its words and their letter trigrams, weighted by how rare they are, so partial
and misspelt titles find what they mean. A row is found if it shares at least `share` percent of
the weight of the request's title and, if given, of its artist. That floor bounds the work: a
request's features, rarest first, are looked up only as long as those that are left could still
reach it, so frequent ones lead to no rows. Titles are looked up or artists, whichever are rarer
in a request. Equal requests are answered once, and rows of equal title and artist are one entry
with its first ids.

Entries are dealt into blocks of bounded size. A request goes to the blocks that hold one of the
features it looks up; there it is weighed against the block's distinct titles and artists through
postings, and its best entries alone leave the block. So what moves is requests by blocks, also
where few words make up all titles and nearly every entry shares half of every request.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergewell.functions.text import normalize_text
from mergewell.operators.cut import checkpointed

LIMIT, SHARE, DEPTH = 5, 50, 100
#: Entries of a block, and the most requests that meet it in one task.
ENTRIES, REQUESTS = 1 << 15, 1 << 15
_KEY = ("title", "artist")


@dataclass
class Index:
    """`entries` (title, artist, ids, features and weight of each, block), `postings` (field, feature,
    title, artist), `weights` (field, feature, df, w), `places` (field, feature, block), the number
    of entries and of blocks."""

    entries: DataFrame
    postings: DataFrame
    weights: DataFrame
    places: DataFrame
    n: int
    blocks: int
    depth: int


def features(text: Column) -> Column:
    """Distinct words and trigrams (of words between marks) of a normalized text; none of null."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != "")
    marked = lambda w: F.concat(F.lit("^"), w, F.lit("$"))
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.lit("g"), F.substr(marked(w), i, F.lit(3))))))
    return F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("w"), w)), grams))


def weight(df: Column, n: int) -> Column:
    """Of a feature that df of n entries have: at least 1, in thousandths."""
    return F.greatest(F.lit(1).cast("long"), F.floor(1000 * F.log(F.lit(float(n + 1)) / (df + F.lit(0.5)))))


def _exploded(rows: DataFrame, *more: str) -> DataFrame:
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_features").alias("features")) for f in _KEY])
    return rows.select(*_KEY, *more, F.explode(fields).alias("x")).select(*_KEY, *more, "x.field", F.explode("x.features").alias("feature"))


class _Held:
    """The distinct titles or artists of a block, with postings of their features."""

    def __init__(self, texts: pa.Array, features: pa.Array, weight: np.ndarray) -> None:
        self.of = texts.dictionary_encode().indices.to_numpy(zero_copy_only=False)  # by entry
        _, first = np.unique(self.of, return_index=True)
        own, self.n, self.weight = features.take(pa.array(first)), len(first), weight[first]
        flat = own.flatten()
        self.names = flat.unique()
        at = pc.index_in(flat, self.names).to_numpy(zero_copy_only=False)
        order = np.argsort(at, kind="stable")
        self.owner = np.repeat(np.arange(self.n), own.value_lengths().to_numpy(zero_copy_only=False))[order]
        self.start = np.searchsorted(at[order], np.arange(len(self.names) + 1))
        self.got = np.zeros(self.n, np.int64)  # shared weight by text; zero again after each request

    def met(self, at: np.ndarray, w: np.ndarray, lead: np.ndarray, total: int, share: int) -> tuple[np.ndarray, np.ndarray]:
        """(texts that share enough with a request of features `at`, -1 if none has them, parts of
        the score): the leading features name them, the others are added where they are met."""
        got, known = self.got, at >= 0
        posts = [self.owner[self.start[f] : self.start[f + 1]] for f in at[known & lead].tolist()]
        for post, x in zip(posts, w[known & lead].tolist(), strict=True):
            got[post] += x
        rest = np.flatnonzero(known & ~lead)
        if 8 * sum(map(len, posts)) >= self.n:
            found = np.flatnonzero(got)
            for f, x in zip(at[rest].tolist(), w[rest].tolist(), strict=True):
                post = self.owner[self.start[f] : self.start[f + 1]]
                if len(post) > 8 * len(found):
                    spot = np.minimum(np.searchsorted(post, found), len(post) - 1)
                    post = found[post[spot] == found]
                got[post] += x
            sums = got[found]
            got[:] = 0
        else:  # few of the block's texts: only those are looked at, as long as what is left can lift them to the floor
            found = np.unique(np.concatenate(posts)) if posts else np.zeros(0, np.int64)
            sums = got[found]
            got[found] = 0
            every = self.start[at[rest] + 1] - self.start[at[rest]] == self.n  # features of all texts of the block
            sums += w[rest[every]].sum()
            rest = rest[~every]
            rest = rest[np.argsort(-w[rest])]
            left = w[rest].sum()
            for f, x in zip(at[rest].tolist(), w[rest].tolist(), strict=True):
                if len(found) > 4:
                    can = (sums + left) * 100 >= total * share
                    found, sums = found[can], sums[can]
                if not len(found):
                    break
                post = self.owner[self.start[f] : self.start[f + 1]]
                sums[post[np.minimum(post.searchsorted(found), len(post) - 1)] == found] += x
                left -= x
        enough = sums * 100 >= total * share
        found = found[enough]
        return found, 2000 * sums[enough] // (total + self.weight[found])


class _Asked:
    """The asked features of requests, as they stand in a block."""

    def __init__(self, lists: pa.Array, held: _Held) -> None:
        flat = lists.flatten()
        self.at = pc.fill_null(pc.index_in(flat.field("feature"), held.names), -1).to_numpy(zero_copy_only=False)
        self.w, self.lead = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("w", "lead"))
        self.start = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = slice(self.start[i], self.start[i + 1])
        return self.at[own], self.w[own], self.lead[own]


def _best(requests: pa.Table, entries: pa.Table, share: int, reach: int) -> pa.Table:
    """The best `reach` entries of a block for each of the requests, by score, then first id."""
    n = len(entries)
    col = lambda t, c: pa.concat_arrays(t.column(c).chunks) if t.column(c).num_chunks else pa.array([], t.schema.field(c).type)
    requests = requests.sort_by("q_title")  # equal titles are weighed once
    num = lambda t, c: col(t, c).to_numpy(zero_copy_only=False)
    title, artist = (_Held(col(entries, f), col(entries, f"{f}_features"), num(entries, f"{f}_weight")) for f in _KEY)
    asked, by = _Asked(col(requests, "title_asked"), title), _Asked(col(requests, "artist_asked"), artist)
    totals, artist_totals = num(requests, "title_total"), num(requests, "artist_total")
    later = n - 1 - np.argsort(pc.sort_indices(col(entries, "first")).to_numpy(zero_copy_only=False))  # larger for smaller ids
    order = np.argsort(title.of, kind="stable")
    start = np.searchsorted(title.of[order], np.arange(title.n + 1))
    artists: dict[str, np.ndarray] = {}
    last, rows, part, out = None, None, None, []
    for i, (q, a) in enumerate(zip(requests.column("q_title").to_pylist(), requests.column("q_artist").to_pylist(), strict=True)):
        if q != last:
            found, each = title.met(*asked.of(i), totals[i], share)
            size = start[found + 1] - start[found]
            rows = order[np.arange(size.sum()) + np.repeat(start[found] - (np.cumsum(size) - size), size)]
            last, part = q, np.repeat(each, size)
        at, score = rows, part
        if artist_totals[i] > 0:
            if a not in artists:
                artists[a] = np.full(artist.n, -1, np.int64)
                found, each = artist.met(*by.of(i), artist_totals[i], share)
                artists[a][found] = each
            more = artists[a][artist.of[at]]
            at, score = at[more >= 0], (score + more)[more >= 0]
        if len(at):
            key = score * n + later[at]
            top = np.argpartition(key, len(key) - reach)[-reach:] if len(key) > reach else np.arange(len(key))
            out.append((np.full(len(top), i), at[top], score[top]))
    q, e, score = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    asks, hits = requests.select(["q_title", "q_artist"]).take(pa.array(q)), entries.select([*_KEY, "first"]).take(pa.array(e))
    return pa.table([*asks.columns, *hits.columns, pa.array(score)], names=["q_title", "q_artist", *_KEY, "first", "score"])


def build(rows: DataFrame, id_col: str = "mbid", depth: int = DEPTH) -> Index:
    """An index of rows with a title, an artist and an id. Entries keep their first `depth` ids,
    which is how far results reach. Rows without a title are not found."""
    held = rows.select(F.col(id_col).alias("id"), normalize_text(F.col("title")).alias("title"), F.coalesce(normalize_text(F.col("artist")), F.lit("")).alias("artist")).where("title is not null")
    first = held.withColumn("_n", F.row_number().over(Window.partitionBy(*_KEY).orderBy("id"))).where(F.col("_n") <= depth)
    entries = first.groupBy(*_KEY).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    entries = checkpointed(entries.withColumns({f"{f}_features": features(F.col(f)) for f in _KEY}))
    n = entries.count()
    blocks = max(1, math.ceil(n / ENTRIES))
    entries = entries.withColumn("block", F.pmod(F.xxhash64(*_KEY), F.lit(blocks)).cast("int"))
    postings = _exploded(entries)
    weights = checkpointed(postings.groupBy("field", "feature").agg(F.count("*").alias("df")).withColumn("w", weight(F.col("df"), n)))
    totals = [F.coalesce(F.sum(F.when(F.col("field") == f, F.col("w"))), F.lit(0)).alias(f"{f}_weight") for f in _KEY]
    weighed = entries.join(postings.join(weights, ["field", "feature"]).groupBy(*_KEY).agg(*totals), list(_KEY))
    places = checkpointed(_exploded(entries, "block").select("field", "feature", "block").distinct())
    return Index(checkpointed(weighed), postings, weights, places, n, blocks, depth)


def find(requests: DataFrame, index: Index, limit: int = LIMIT, offset: int = 0, share: int = SHARE) -> DataFrame:
    """(request_id, ord, id, score): for requests (request_id, title, artist) the found rows from
    `offset` on, `limit` of them, best first, then by id. A score is up to 1000 for the title and
    as much for the artist: twice the shared weight over the weight of both. A blank title finds
    nothing, a blank artist any artist."""
    reach = offset + limit
    if reach > index.depth:
        raise ValueError(f"results reach to {index.depth}")
    asked = requests.select("request_id", normalize_text(F.col("title")).alias("title"), F.coalesce(normalize_text(F.col("artist")), F.lit("")).alias("artist")).where("title is not null")
    asked = checkpointed(asked)
    each = asked.select(*_KEY).distinct().withColumns({f"{f}_features": features(F.col(f)) for f in _KEY})
    known = _exploded(each).join(index.weights, ["field", "feature"], "left").withColumns({"df": F.coalesce("df", F.lit(0)), "w": F.coalesce("w", weight(F.lit(0), index.n))})
    own = Window.partitionBy(*_KEY, "field")
    rarest = own.orderBy(F.desc("w"), "feature")
    rest = F.sum("w").over(rarest.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    led = checkpointed(known.withColumns({"total": F.sum("w").over(own), "lead": rest * 100 >= F.sum("w").over(own) * share}))
    of = lambda f, what: F.when(F.col("field") == f, what)
    pair = F.struct("feature", "w", "lead")
    whole = led.groupBy(*_KEY).agg(
        *[F.collect_list(of(f, pair)).alias(f"{f}_asked") for f in _KEY],
        *[F.coalesce(F.max(of(f, F.col("total"))), F.lit(0)).alias(f"{f}_total") for f in _KEY],
        *[F.sum(of(f, F.when(F.col("lead"), F.col("df")))).alias(f"{f}_cost") for f in _KEY],
    ).withColumn("by", F.when(F.col("artist_cost") < F.col("title_cost"), "artist").otherwise("title"))
    whole = checkpointed(whole.drop("title_cost", "artist_cost"))
    named = {f: f"q_{f}" for f in _KEY}
    chosen = led.where("lead").join(whole.select(*_KEY, F.col("by").alias("field")), [*_KEY, "field"]).select("field", "feature", *[F.col(f).alias(q) for f, q in named.items()])
    sent = chosen.join(index.places, ["field", "feature"]).select(*named.values(), "block").distinct()
    # Requests are dealt finely enough for all tasks, and never more of them than one task holds.
    parts = max(math.ceil(whole.count() / REQUESTS), math.ceil(2 * asked.sparkSession.sparkContext.defaultParallelism / index.blocks))
    dealt = F.pmod(F.xxhash64(F.lit(7), *named.values()), F.lit(parts)).cast("int")
    sent = checkpointed(sent.join(whole.drop("by").withColumnsRenamed(named), list(named.values())).withColumn("part", dealt))
    goals = sent.select(F.col("block").alias("to_block"), F.col("part").alias("to_part")).distinct()
    held = index.entries.join(F.broadcast(goals), F.col("block") == F.col("to_block")).select("to_block", "to_part", *_KEY, *[f"{f}_{x}" for f in _KEY for x in ("features", "weight")], F.col("ids")[0].alias("first"))
    kind = held.schema["first"].dataType.simpleString()
    together = sent.groupBy("block", "part").cogroup(held.groupBy("to_block", "to_part"))
    scored = together.applyInArrow(lambda left, right: _best(left, right, share, reach), f"q_title string, q_artist string, title string, artist string, first {kind}, score long")
    best = scored.withColumn("_n", F.row_number().over(Window.partitionBy(*named.values()).orderBy(F.desc("score"), "first"))).where(F.col("_n") <= reach)
    best = best.join(index.entries.select(*_KEY, "ids"), list(_KEY))
    rows = best.select(*named.values(), "score", F.explode(F.slice("ids", 1, reach)).alias("id"))
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*named.values()).orderBy(F.desc("score"), "id"))).where(f"_n > {offset} and _n <= {reach}")
    answers = ranked.select(*[F.col(q).alias(f) for f, q in named.items()], (F.col("_n") - 1 - offset).alias("ord"), "id", "score")
    return asked.join(answers, list(_KEY)).select("request_id", "ord", "id", "score")
