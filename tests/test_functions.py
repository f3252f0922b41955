import datetime as dt

import pytest
from pyspark.sql import functions as F

from mergewell.functions import text as T
from mergewell.functions import values as V


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


NAMES = ["R.E.M.!", "AC/DC", "  Sigur   Rós ", "ß STRASSE", "$uicide+", "!!!", "", None, "Ｆｕｌｌ", "a b", "“Heroes”", "ﬁne", "İstanbul", "x\x1cy"]


def test_normalize_text_equals_model(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "i int, n string")
    got = {r.i: r.x for r in df.select("i", T.normalize_text(F.col("n")).alias("x")).collect()}
    assert got == {i: T.normalize_one(n) for i, n in enumerate(NAMES)}
    assert got[0] == "rem" and got[1] == "acdc" and got[5] is None


@pytest.mark.parametrize(("a", "b", "want"), [("Two Ribbons", "two  ribbons", 2), ("Blush", "Blush (Deluxe)", 1), ("A", None, 0), ("", "A", 0), ("x", "y", 0)])
def test_title_score(spark, a, b, want):
    assert one(spark, T.title_score(F.lit(a), F.lit(b).cast("string"))) == want


@pytest.mark.parametrize(("n", "m", "want"), [(3, 3, 4), (3, 5, 2), (3, 9, 0), (0, 3, 0), (3, None, 0)])
def test_track_count_score(spark, n, m, want):
    assert one(spark, T.track_count_score(F.lit(n), F.lit(m).cast("int"))) == want


@pytest.mark.parametrize(("text", "want"), [("2001-02-03", (2001, 2, 3)), ("2001-xx", (2001, None, None)), (" 1999 ", (1999, None, None)), ("", None), ("n/a", None), (None, None)])
def test_partial_date(spark, text, want):
    got = one(spark, V.partial_date(F.lit(text).cast("string")))
    assert (tuple(got) if got else None) == want


def test_as_date_fills_and_zero_is_missing(spark):
    d = F.struct(F.lit(2001).alias("year"), F.lit(0).alias("month"), F.lit(None).cast("int").alias("day"))
    assert one(spark, V.as_date(d)) == dt.date(2001, 1, 1)


def test_duration_bucket_floors(spark):
    assert [one(spark, V.duration_bucket(F.lit(x))) for x in (1999, 2000, -1)] == [0, 1, -1]


def test_url_and_barcodes(spark):
    assert one(spark, V.url_namespace(F.lit("free download"), F.lit("https://u:p@shop.org:8080/a b?q"))) == "url:free-download:u:p@shop.org:8080"
    codes = {" 123456789012 ": "release:upc", "1234567890123": "release:ean", "CAT 1": "release:barcode", "  ": None}
    assert {c: one(spark, V.barcode_namespace(F.lit(c))) for c in codes} == codes


def test_roles_and_vocabularies(spark):
    role = lambda i, j: one(spark, V.credit_role(F.lit(i), F.lit(j).cast("string")))
    assert [role(0, "feat."), role(1, " Feat. "), role(1, " ft. "), role(1, " & "), role(2, None)] == ["primary", "featured", "featured", "unknown", "unknown"]
    assert one(spark, V.from_vocabulary(F.lit(" Digipak "), V.RELEASE_PACKAGING, "other")) == "digipak"
    assert one(spark, V.from_vocabulary(F.lit("Slip"), V.RELEASE_PACKAGING, "other")) == "other"
    assert one(spark, V.provider_for(F.lit("recording:isrc"))) == "musicbrainz"


def test_time_window():
    at = dt.datetime(2025, 1, 1, 3, tzinfo=dt.timezone(dt.timedelta(hours=3)))
    end = V.parse_iso("2025-01-02T00:00Z")
    assert V.time_window(at, end, 2.5) == (dt.datetime(2025, 1, 1, 21, 30, tzinfo=dt.UTC), end)
    with pytest.raises(ValueError):
        V.time_window(end, at, None)
    with pytest.raises(ValueError):
        V.time_window(None, None, -1)


def test_case_folding_equals_model(spark):
    import unicodedata

    cherokee = lambda c: "CHEROKEE" in unicodedata.name(chr(c), "")
    folds = [c for c in range(0x10400) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c) and not cherokee(c)]
    texts = [f"x{chr(c)}" for c in folds] + ["ΟΔΟΣ ΟΔΟΣ", "Straße", "ısı", "IŞIK", "ﬁn", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    late = {0x1C89, 0xA7CB, 0xA7CC, 0xA7DA, 0xA7DC}  # letters that the JVM's tables may lack
    for t, got in df.select("t", T.fold_case(F.col("t"))).collect():
        assert got == (None if t is None else t.casefold()) or (t and len(t) == 2 and ord(t[1]) in late), t
