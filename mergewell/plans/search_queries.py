"""Queries of ranked text search over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergewell.operators import search as S
from mergewell.plans.catalogue import query, table
from mergewell.plans.scalar_queries import NORM

_HELD = "p_name || ' ' || p_type || ' No. ' || p_size AS title, CASE WHEN p_partkey % 11 > 0 THEN p_brand END AS artist"
#: A request for every part: its own title, its first two words, its words the other way round, or
#: with a letter lost; every third one does not say by whom, every thirteenth is for something else.
_ASKED = """CASE WHEN p_partkey % 13 = 0 THEN 'quux zyzzyva' WHEN p_partkey % 4 = 0 THEN title
  WHEN p_partkey % 4 = 1 THEN p_name WHEN p_partkey % 4 = 2 THEN p_type || ' ' || p_name ELSE substr(title, 1, 3) || substr(title, 5) END AS title,
  CASE WHEN p_partkey % 3 > 0 THEN artist END AS artist"""
_FEATURES = """list_distinct(list_concat(list_transform(list_filter(string_split(coalesce({0}, ''), ' '), lambda w: w <> ''), lambda w: 'w' || w),
  flatten(list_transform(list_filter(string_split(coalesce({0}, ''), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 1), lambda i: 'g' || substr('^' || w || '$', i, 3))))))"""


def _scored(limit: int, offset: int) -> str:
    """Every request against every entry that shares a feature, and the floor afterwards."""
    return f"""
WITH held AS (SELECT lpad(p_partkey::VARCHAR, 8, '0') AS id, {NORM.format('title')} AS t, coalesce({NORM.format('artist')}, '') AS a FROM (SELECT p_partkey, {_HELD} FROM part)),
asked AS (SELECT p_partkey AS request_id, {NORM.format('title')} AS qt, coalesce({NORM.format('artist')}, '') AS qa FROM (SELECT p_partkey, {_ASKED} FROM (SELECT *, {_HELD} FROM part))),
entries AS (SELECT DISTINCT t, a FROM held), total AS (SELECT count(*) AS n FROM entries),
post AS (SELECT t, a, 'title' AS field, unnest({_FEATURES.format('t')}) AS f FROM entries UNION ALL SELECT t, a, 'artist', unnest({_FEATURES.format('a')}) FROM entries),
df AS (SELECT field, f, count(*) AS df FROM post GROUP BY ALL),
each AS (SELECT DISTINCT qt, qa FROM asked),
want AS (SELECT qt, qa, 'title' AS field, unnest({_FEATURES.format('qt')}) AS f FROM each UNION ALL SELECT qt, qa, 'artist', unnest({_FEATURES.format('qa')}) FROM each),
wanted AS (SELECT want.*, greatest(1, floor(1000 * ln((n + 1)::DOUBLE / (coalesce(df, 0) + 0.5)::DOUBLE)))::BIGINT AS w FROM want LEFT JOIN df USING (field, f), total),
sums AS (SELECT t, a, field, sum(greatest(1, floor(1000 * ln((n + 1)::DOUBLE / (df + 0.5)::DOUBLE)))::BIGINT)::BIGINT AS own FROM post JOIN df USING (field, f), total GROUP BY ALL),
asks AS (SELECT qt, qa, field, sum(w)::BIGINT AS total FROM wanted GROUP BY ALL),
met AS (SELECT qt, qa, t, a, field, sum(w)::BIGINT AS shared FROM wanted JOIN post USING (field, f) GROUP BY ALL),
good AS (SELECT qt, qa, t, a, field, (2000 * shared) // (total + own) AS s FROM met JOIN asks USING (qt, qa, field) JOIN sums USING (t, a, field) WHERE shared * 100 >= total * 50),
scored AS (SELECT qt, qa, t, a, sum(s)::BIGINT AS score FROM good GROUP BY ALL HAVING count(*) = CASE WHEN qa = '' THEN 1 ELSE 2 END),
ranked AS (SELECT qt, qa, id, score, row_number() OVER (PARTITION BY qt, qa ORDER BY score DESC, id) AS n FROM scored JOIN held USING (t, a))
SELECT request_id, (n - 1 - {offset})::INTEGER AS ord, id, score FROM asked JOIN ranked USING (qt, qa) WHERE n > {offset} AND n <= {offset + limit}"""


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(requests, rows) as _ASKED and _HELD have them."""
    part = table(spark, d, "part").selectExpr("*", *[c.strip() for c in ("p_name || ' ' || p_type || ' No. ' || p_size AS title", "CASE WHEN p_partkey % 11 > 0 THEN p_brand END AS artist")])
    asked = part.selectExpr("p_partkey AS request_id", "title AS own", "artist AS by", "p_name", "p_type", "p_partkey")
    k = F.col("p_partkey")
    lost = F.concat(F.substring("own", 1, 3), F.expr("substr(own, 5)"))
    title = F.when(k % 13 == 0, "quux zyzzyva").when(k % 4 == 0, F.col("own")).when(k % 4 == 1, F.col("p_name")).when(k % 4 == 2, F.concat_ws(" ", "p_type", "p_name")).otherwise(lost)
    return asked.select("request_id", title.alias("title"), F.when(k % 3 > 0, F.col("by")).alias("artist")), part.select(F.lpad(k.cast("string"), 8, "0").alias("mbid"), "title", "artist")


@query(_scored(5, 0))
def search_ranked(spark: SparkSession, d: str) -> DataFrame:
    asked, rows = _parts(spark, d)
    return S.find(asked, S.build(rows))


@query(_scored(10, 7))
def search_ranked_page(spark: SparkSession, d: str) -> DataFrame:
    """The results after the first seven, ten a request."""
    asked, rows = _parts(spark, d)
    return S.find(asked, S.build(rows), limit=10, offset=7)
