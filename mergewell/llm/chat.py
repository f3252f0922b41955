"""Chat formatting of typed content parts, in DataFrame functions only.

A visitor flattens each turn's parts in order, and the parts within a part after it: image,
audio and document parts become one placeholder each, with an attachment record (where it stands,
its reference and how many tokens it expands to); each run of adjacent text parts is escaped as
one text, so that no control string can be put together across parts. Turns are marked as
`<|im_start|>role NEWLINE content<|im_end|>NEWLINE`. Inside texts every `<`, any backslashes,
`|` gains one backslash, so no text holds a control string and taking one away restores it;
roles also escape backslashes and line ends.

Cases: null texts, roles and parts are empty; a part of an unknown or no kind is a text part;
parts nest as deep as the column's type says; a very long text is part of one row; turns sort by turn (null first), then role and
text, so repeated rows stay and have a defined order; rows with a null conv_id form one
conversation; extra columns are ignored; an empty table gives an empty table. A conversation
is one output row, so it is gathered in one task, as its digest needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens an attachment expands to: one a unit of so much, rounded up, plus a fixed number.
EXPANSION = {"image": (784.0, 2), "audio": (0.04, 2), "document": (1.0 / 256, 1)}
PARTS = "array<struct<kind:string,text:string,ref:string,units:double>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    lines = F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.replace(lines, F.lit("\\\\"), F.lit("\\"))


def _flat(parts: Column, kind: ArrayType) -> Column:
    """All parts in order of a visit: each part, then those in its field `parts`."""
    inner = {f.name: f.dataType for f in kind.elementType.fields}

    def visit(p: Column) -> Column:
        has = lambda name, as_: (p[name].cast(as_) if name in inner else F.lit(None).cast(as_)).alias(name)
        own = F.array(F.struct(has("kind", "string"), has("text", "string"), has("ref", "string"), has("units", "double")))
        if "parts" not in inner:
            return own
        return F.concat(own, F.coalesce(_flat(p["parts"], inner["parts"]), F.array().cast(PARTS)))

    return F.flatten(F.transform(parts, visit))


def _content(parts: Column) -> Column:
    """Placeholders, and between them the escaped runs of text."""
    none = F.struct(F.lit("").alias("out"), F.lit("").alias("run"))

    def visit(s: Column, part: Column) -> Column:
        mark = F.concat(F.lit("<|"), part["kind"], F.lit("|>"))
        text = F.struct(s["out"].alias("out"), F.concat(s["run"], F.coalesce(part["text"], F.lit(""))).alias("run"))
        return F.when(part["kind"].isin(*EXPANSION), F.struct(F.concat(s["out"], escape(s["run"]), mark).alias("out"), F.lit("").alias("run"))).otherwise(text)

    return F.aggregate(parts, none, visit, lambda s: F.concat(s["out"], escape(s["run"])))


def _tokens(part: Column) -> Column:
    out = F.lit(0).cast("long")
    for kind, (unit, fixed) in EXPANSION.items():
        out = F.when(part["kind"] == kind, F.ceil(F.coalesce(part["units"], F.lit(0.0)) / unit).cast("long") + fixed).otherwise(out)
    return out


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, learn_from: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, formatted, loss (array of turn index from 0, start and
    end in code points of `formatted`) and attachments (turn index, part index, kind, ref,
    tokens). One shuffle on the conversation."""
    text_part = F.array(F.struct(F.lit("text").alias("kind"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))
    parts = F.coalesce(_flat(F.col(parts_col), rows.schema[parts_col].dataType), text_part) if parts_col else text_part
    turns = rows.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        _content(parts).alias("content"),
        F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))), lambda a: a["kind"].isin(*EXPANSION)).alias("files"),
    )
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    turns = turns.select("conv_id", "turn", "role", "content", "files", head.alias("head"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    size = F.length("head") + F.length("content") + len(END) + 1
    placed = turns.select(
        "*",
        (F.row_number().over(order) - 1).alias("at"),
        (F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("content") - len(END) - 1).alias("start"),
    )
    item = F.struct("at", F.concat("head", "content", F.lit(END + "\n")).alias("segment"), F.when(F.col("role") == learn_from, F.struct("at", "start", (F.col("start") + F.length("content")).alias("end"))).alias("loss"), "files")
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("turns"))
    return whole.select(
        F.col("conv_id").alias(conv_col),
        F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["loss"]), lambda x: x.isNotNull()).alias("loss"),
        F.flatten(F.transform("turns", lambda t: F.transform(t["files"], lambda a: F.struct(t["at"].alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
    )


def parse(formatted: Column) -> Column:
    """Turns (role, text, chars of escaped content) read back from a formatted conversation."""
    segments = F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, 2_000_000_000)

    def turn(segment: Column) -> Column:
        role = F.substring_index(segment, "\n", 1)
        content = F.substr(segment, F.length(role) + 2, F.length(segment) - F.length(role) - 2 - len(END))
        return F.struct(_unescape_role(role).alias("role"), unescape(content).alias("text"), F.length(content).alias("chars"))

    return F.transform(segments, turn)


def read_back(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests of formatted conversations, from the formatted text and its loss mask alone."""
    turns = chats.select(conv_col, "loss", F.length("formatted").cast("long").alias("formatted_chars"), parse(F.col("formatted")).alias("turns"))

    def masked(pair: Column) -> Column:
        turn = F.get(F.col("turns"), pair["at"])
        return F.when(turn["chars"] == pair["end"] - pair["start"], turn["text"]).otherwise(F.raise_error("the loss mask is off"))

    learnt = turns.select("*", F.transform("loss", masked).alias("learnt"))
    loss = F.array_join("learnt", "")
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return learnt.select(
        conv_col,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(every.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
