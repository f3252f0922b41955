"""Personal data: base patterns and bootstrapped contextual extraction, in DataFrame functions.

Base patterns find emails, IP addresses, payment cards (Luhn) and phone numbers. They are
written with possessive quantifiers and look-behinds so that matching is linear on any text;
what they match is what the plain patterns match. Positions are code points: running sums, by
blocks, of the lengths of matches and of what is between them.

Bootstrapping: every identifier-like token (one with a digit or an at sign, without the marks
around it) stands between words, and each lexical pattern (the two words before, the word before,
the word after, the words before and after) is a node of a graph whose other side is the tokens.
Base entities are the seeds, and so are tokens that look like a credential (a long mix of letters
and digits); of these none is a span until a pattern says so. Rounds alternate: a pattern's
confidence in a kind is the mean score of its distinct tokens, given enough distinct seeds; a
token's score is the mean confidence of its patterns. Tokens that high-confidence patterns agree
on become spans of that kind beside the base ones.

Cases: null text is empty and has no spans; words of more than 64 code points are no context; a
token of several kinds counts for the first of them; patterns equally sure of a token give it
the kind listed last; a very long text is one row, its spans one array; repeated rows and ids keep one
result each; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergewell.llm import shared
from mergewell.llm.arrays import before, let

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: An identifier-like token: starts after white space, holds a digit or an at sign.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Phones hold spaces, so they come before single tokens.
SEEN = rf"{PATTERNS['phone']}|{TOKEN}"
#: What patterns can be sure of: the base kinds, and credentials.
SOUGHT = (*KINDS, "secret")
SECRET = r"^(?=[^0-9]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])[A-Za-z0-9_+/=-]{24,}$"
MIN_SEEDS, CONFIDENT, ROUNDS = 5, 0.8, 3
WORD = 64
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_SPANS = "array<struct<start:bigint,end:bigint,text:string>>"


def _spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, text) of the leftmost non-overlapping matches."""
    pieces = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, hit: F.struct(F.length(gap).cast("long").alias("gap"), F.coalesce(F.length(hit), F.lit(0)).cast("long").alias("n"), hit.alias("text")),
    )

    def place(xs: Column) -> Column:
        at = before(F.transform(xs, lambda x: x["gap"] + x["n"]), lambda a, x: a + x)
        every = F.zip_with(xs, at, lambda x, a: F.struct((a + x["gap"]).alias("start"), (a + x["gap"] + x["n"]).alias("end"), x["text"].alias("text")))
        return F.filter(every, lambda x: x["text"].isNotNull())

    return let(pieces, place)


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(hit, "[ -]", "")
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Spans of one base kind that hold up."""
    found = F.filter(_spans(text, PATTERNS[kind]), lambda s: _valid(kind, s["text"]))
    needs = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")
    return F.when(needs, found).otherwise(F.array().cast(_SPANS))


def _word(s: Column) -> Column:
    """A word of a context: without the marks around it, unless it is nothing else."""
    bare = F.regexp_replace(F.lower(s), r"^[^\p{L}]+|[^\p{L}]+$", "")
    return F.when(F.length(s) > WORD, F.lit("")).otherwise(let(bare, lambda w: F.when(w == "", F.lower(s)).otherwise(w)))


def _tokens(text: Column) -> Column:
    """Array of identifier-like tokens with their place and the words before and after."""
    flat = F.translate(text, "\t\n\r\x0b\x0c", "     ")
    second = lambda p: F.when(F.instr(F.rtrim(p), " ") > 0, F.substring_index(F.substring_index(F.rtrim(p), " ", -2), " ", 1)).otherwise("")
    gaps = F.transform(F.split(flat, SEEN, -1), lambda p: F.struct(F.length(p).cast("long").alias("gap"), _word(second(p)).alias("second"), _word(F.substring_index(F.rtrim(p), " ", -1)).alias("last"), _word(F.substring_index(F.ltrim(p), " ", 1)).alias("first")))
    hits = F.regexp_extract_all(flat, F.lit(SEEN), F.lit(0))
    core = F.transform(hits, lambda h: F.struct(F.length(h).cast("long").alias("n"), F.length(F.regexp_extract(h, r"^[^\p{L}\p{N}+]*+", 0)).cast("long").alias("skip"), F.regexp_extract(h, r"(?s)^[^\p{L}\p{N}+]*+(.*[\p{L}\p{N}])", 1).alias("text"), h.alias("raw")))
    kind = "array<struct<start:bigint,end:bigint,text:string,second:string,left:string,right:string>>"

    def place(gs: Column) -> Column:
        met = F.zip_with(F.zip_with(gs, core, lambda g, c: F.struct(g.alias("g"), c.alias("c"))), F.slice(gs, 2, 2_000_000_000), lambda x, g: F.struct(x["g"].alias("g"), x["c"].alias("c"), g["first"].alias("right")))

        def put(xs: Column) -> Column:
            at = before(F.transform(xs, lambda x: x["g"]["gap"] + F.coalesce(x["c"]["n"], F.lit(0))), lambda a, x: a + x)

            def one(x: Column, a: Column) -> Column:
                bare = x["c"]["text"] == ""  # nothing but marks
                begin = a + x["g"]["gap"] + F.when(bare, 0).otherwise(x["c"]["skip"])
                of = F.when(bare, x["c"]["raw"]).otherwise(x["c"]["text"])
                return F.struct(begin.alias("start"), (begin + F.length(of)).alias("end"), of.alias("text"), x["g"]["second"].alias("second"), x["g"]["last"].alias("left"), x["right"].alias("right"))

            return F.filter(F.zip_with(xs, at, one), lambda t: t["text"].isNotNull())

        return let(met, put)

    return F.when(text.rlike("[0-9@]"), let(gaps, place)).otherwise(F.array().cast(kind))


_BASE = "array<struct<start:bigint,nth:int,end:bigint,kind:string>>"


def _merged(docs: DataFrame, text: Column, keep: list[Column], more: list[Column]) -> DataFrame:
    """Kept columns, `base` (array of start, nth, end, kind in order), more columns, and the spans
    of each kind as _kind."""
    found = docs.select(*keep, *[base_spans(text, k).alias(f"_{k}") for k in KINDS], *more)

    def tagged(i: int, k: str) -> Column:
        return F.transform(F.col(f"_{k}"), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("nth"), s["end"].alias("end"), F.lit(k).alias("kind")))

    return found.select("*", F.array_sort(F.concat(*[tagged(i, k) for i, k in enumerate(KINDS)])).cast(_BASE).alias("base"))


def _meets(spans: Column, start: Column, end: Column) -> Column:
    """Whether one of the disjoint spans, in order, overlaps the one from start to end: the first
    that ends beyond the start is found by halving."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1.0)).cast("int") + 1)
    both = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(spans, mid)["end"] <= start
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.when(below, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi"))))

    return (F.size(spans) > 0) & F.coalesce(F.get(spans, F.aggregate(steps, both, halve)["lo"])["start"] < end, F.lit(False))


def scan(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """One pass over the texts: the kept columns, `base` and `tokens`, each token with the kind
    of the base span it overlaps, if any."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    merged = _merged(docs, text, keep, [_tokens(text).alias("tokens")])

    def with_kind(t: Column) -> Column:
        kinds = [F.when(_meets(F.col(f"_{k}"), t["start"], t["end"]), F.lit(k)) for k in KINDS]
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), t["text"].alias("text"), t["second"].alias("second"), t["left"].alias("left"), t["right"].alias("right"), F.coalesce(*kinds).alias("kind"))

    return merged.withColumn("tokens", F.transform("tokens", with_kind)).drop(*[f"_{k}" for k in KINDS])


def _patterns(second: Column, left: Column, right: Column) -> Column:
    """The lexical patterns of a context; empty words give none."""
    every = F.array(
        F.when((second != "") & (left != ""), F.concat(second, F.lit(" "), left, F.lit(" _"))),
        F.when((left != "") & (right != ""), F.concat(left, F.lit(" _ "), right)),
        F.when(left != "", F.concat(left, F.lit(" _"))),
        F.when(right != "", F.concat(F.lit("_ "), right)),
    )
    return F.filter(every, lambda p: p.isNotNull())


def bootstrap(tokens: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, confident: float = CONFIDENT) -> DataFrame:
    """Patterns with the kind they predict and their confidence, from (text, second, left, right,
    kind) rows. Edges are counted before they move, so a word that stands before a third of all
    tokens is one key of a partial aggregate, and its edges are spread by token."""
    seed = F.coalesce("kind", F.when(F.col("text").rlike(SECRET), F.lit("secret"))).alias("kind")
    edges = (
        tokens.select(F.explode(_patterns(F.col("second"), F.col("left"), F.col("right"))).alias("pattern"), F.xxhash64("text").alias("token"), seed)
        .groupBy("pattern", "token").agg(F.max("kind").alias("kind"))
    )
    edges = shared.cut(edges)
    kinds = [F.lit(k) for k in SOUGHT]
    # Seeds have score 1 in their kind for good; the others start at 0 and get what is found.
    scored = edges.select("pattern", "token", "kind", *[(F.col("kind") == k).cast("double").alias(str(i)) for i, k in enumerate(SOUGHT)]).fillna(0.0)
    sums = [F.sum(str(i)).alias(f"s{i}") for i in range(len(SOUGHT))]
    seeds = [F.sum((F.col("kind") == k).cast("int")).alias(f"n{i}") for i, k in enumerate(SOUGHT)]
    patterns = None
    for r in range(rounds):
        stats = scored.groupBy("pattern").agg(F.count("*").alias("n"), *sums, *seeds)
        best = F.array_max(F.array(*[F.struct(F.when(F.coalesce(F.col(f"n{i}"), F.lit(0)) >= min_seeds, F.col(f"s{i}") / F.col("n")).otherwise(0.0).alias("confidence"), F.lit(-i).alias("nth")) for i in range(len(SOUGHT))]))
        patterns = stats.select("pattern", best.alias("best")).select("pattern", F.element_at(F.array(*kinds), 1 - F.col("best.nth")).alias("of"), F.col("best.confidence").alias("confidence")).where(F.col("confidence") >= confident)
        patterns = shared.cut(patterns)
        if r == rounds - 1:
            break
        # Tokens that some confident pattern holds take its confidence, the rest stay.
        reached = edges.where("kind is null").join(patterns, "pattern").groupBy("token").agg(*[F.max(F.when(F.col("of") == k, F.col("confidence")).otherwise(0.0)).alias(f"t{i}") for i, k in enumerate(SOUGHT)])
        scored = edges.join(reached, "token", "left").select("pattern", "token", "kind", *[F.when(F.col("kind") == k, 1.0).when(F.col("kind").isNull(), F.coalesce(F.col(f"t{i}"), F.lit(0.0))).otherwise(0.0).alias(str(i)) for i, k in enumerate(SOUGHT)])
    return patterns


def _discover(seen: DataFrame, key: str) -> DataFrame:
    """(key, found): spans that the bootstrapped patterns add to each key's base spans."""
    tokens = seen.select(key, F.explode("tokens").alias("t")).select(key, "t.*")
    patterns = bootstrap(tokens)
    free = tokens.where("kind is null").select(key, "start", "end", F.explode(_patterns(F.col("second"), F.col("left"), F.col("right"))).alias("pattern"))
    nth = F.create_map(*[x for i, k in enumerate(SOUGHT) for x in (F.lit(k), F.lit(i))])
    hits = free.join(patterns, "pattern").groupBy(key, "start", "end").agg(F.max(F.struct("confidence", "of")).alias("top"))
    return hits.groupBy(key).agg(F.collect_list(F.struct("start", nth[F.col("top.of")].alias("nth"), "end", F.col("top.of").alias("kind"))).cast(_BASE).alias("found"))


def _all_spans() -> Column:
    return F.array_sort(F.concat("base", F.coalesce("found", F.array().cast(_BASE))))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, base and spans (arrays of start, nth, end, kind) for every row."""
    seen = shared.cut(scan(docs, [F.col(id_col).alias("id")], text_col)).withColumn("row", F.monotonically_increasing_id())
    return seen.join(_discover(seen, "row"), "row", "left").select(F.col("id").alias(id_col), "base", _all_spans().alias("spans"))


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`row` (a struct of all columns) and `clean`, the text with every span replaced by its kind.

    What the patterns add is few rows, so the texts need not move: base spans are found again
    where the text is, and the rest joins by a hash of id and text."""
    key = F.xxhash64(F.col(id_col), F.col(text_col)).alias("key")
    found = _discover(shared.cut(scan(docs, [key], text_col).dropDuplicates(["key"])), "key")
    text = F.coalesce(F.col(text_col), F.lit(""))
    again = _merged(docs, text, [key, F.struct("*").alias("row"), text.alias("plain")], [])
    every = again.join(found, "key", "left").select("row", "plain", _all_spans().alias("spans"))
    return redacted(every, "plain", "spans", "clean").select("row", "clean")


def listing(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(rows: DataFrame, text: str, spans: str, out: str) -> DataFrame:
    """`rows` with column `out`: the text with every span replaced by its kind in brackets; of
    overlapping spans the earlier one wins and a later one only covers what is left of it."""
    chars = F.when(F.size(spans) > 0, F.split(F.col(text), ""))
    ends = F.transform(spans, lambda s: s["end"])
    at = before(ends, lambda a, x: F.greatest(a, x))
    held = rows.withColumns({"_chars": chars, "_at": at})

    def put(s: Column, at: Column) -> Column:
        gap = F.array_join(F.slice("_chars", (at + 1).cast("int"), F.greatest(s["start"] - at, F.lit(0)).cast("int")), "")
        return F.when(s["end"] <= at, F.lit("")).otherwise(F.concat(gap, F.lit("["), F.upper(s["kind"]), F.lit("]")))

    rest = F.array_join(F.slice("_chars", (F.array_max(ends) + 1).cast("int"), 2_000_000_000), "")
    clean = F.concat(F.array_join(F.zip_with(spans, "_at", put), ""), rest)
    return held.withColumn(out, F.when(F.size(spans) > 0, clean).otherwise(F.col(text))).drop("_chars", "_at")
