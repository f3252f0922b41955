"""Text functions: normalization for matching and title comparison."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python's str.split has it; Java's \\s is narrower.
_BLANK = r"[\s\x0B\x1C-\x1F\x85\xA0  -     　]+"


@cache
def _punctuation() -> dict[int, None]:
    """Deletion table of every code point of a punctuation category."""
    return {c: None for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)).startswith("P")}


def normalize_one(value: str | None) -> str | None:
    """Compatibility composition, case folding, no punctuation, single spaces; null if empty."""
    if value is None:
        return None
    folded = unicodedata.normalize("NFKC", value).casefold()
    return " ".join(folded.translate(_punctuation()).split()) or None


@F.pandas_udf(StringType())
def _normalize_unicode(values: pd.Series) -> pd.Series:
    return values.map(normalize_one)


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, _BLANK, " "))


def normalize_ascii(text: Column) -> Column:
    """What normalize_one does to pure ASCII, as a built-in expression. Symbols stay."""
    clean = collapse(F.regexp_replace(F.lower(text), r"\p{P}", ""))
    # As a filter of one element, because nullif would evaluate the patterns twice.
    return F.get(F.filter(F.array(clean), lambda x: x != ""), F.lit(0))


def normalize_text(text: Column) -> Column:
    """normalize_one for a column. ASCII values stay in the JVM and reach the UDF as null."""
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.coalesce(F.when(plain, normalize_ascii(text)), _normalize_unicode(F.when(~plain, text)))


def fold_case(text: Column) -> Column:
    """Full case folding in the JVM: upper case expands letters, lower case brings them together.
    The dotless i, which has the capital of another letter, waits as a noncharacter; taking it back
    also keeps the optimizer from merging the two. Cherokee becomes small instead of capital."""
    upper = F.translate(F.upper(F.translate(text, "\u0131", "\ufdd0")), "\ufdd0", "\u0131")
    return F.translate(F.replace(F.lower(upper), F.lit("ß"), F.lit("ss")), "ς", "σ")


def normalize_title(text: Column) -> Column:
    """Case folded with single spaces; punctuation stays."""
    return collapse(fold_case(text))


def title_score(local: Column, candidate: Column) -> Column:
    """2 for equal titles, 1 if one holds the other, else 0; blank titles score 0."""
    a, b = normalize_title(local), normalize_title(candidate)
    return (
        F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0)
        .when(a == b, 2)
        .when(a.contains(b) | b.contains(a), 1)
        .otherwise(0)
    )


def track_count_score(local: Column, candidate: Column) -> Column:
    """n + 1 - |n - m|, at least 0; 0 for an empty release or an unknown count."""
    near = F.greatest(F.lit(0), local + 1 - F.abs(local - candidate))
    return F.when((local <= 0) | local.isNull() | candidate.isNull(), 0).otherwise(near).cast("int")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.btrim(text), F.lit(""))
