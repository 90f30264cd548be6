"""Full-text queries: each benchmark item asks with some of its words, by its number as a conjunction, with a phrase, with
``or`` or with an exclusion, over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.functions import text as T
from orefield.operators import fulltext
from orefield.plans.registry import query, views

_WORD = "[\\p{L}\\p{N}_]+"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_STEM = (
    "CASE WHEN w IN ({stop}) THEN '' WHEN regexp_matches(w, '(^|[^ea])ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(^|[^aeo])es$') THEN regexp_replace(w, 'es$', 'e')"
    " WHEN regexp_matches(w, '[^us]s$') THEN regexp_replace(w, 's$', '') ELSE w END"
).format(stop=_STOP)

_MATCH_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id AS id, text, list_transform(regexp_extract_all(lower(text), '{_WORD}'), lambda w: {_STEM}) AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id AS query_id, item_id % 4 AS kind, list_transform(regexp_extract_all(lower(text), '{_WORD}'), lambda w: {_STEM}) AS x FROM benchmark),
raw AS (
  SELECT query_id, t.* FROM b, LATERAL (SELECT unnest(CASE kind
    WHEN 0 THEN [{{'grp': 0, 'term': 0, 'excluded': false, 'x': [x[1]]}}, {{'grp': 0, 'term': 1, 'excluded': false, 'x': [x[4]]}}, {{'grp': 0, 'term': 2, 'excluded': false, 'x': [x[7]]}}]
    WHEN 1 THEN [{{'grp': 0, 'term': 0, 'excluded': false, 'x': [x[2], x[3]]}}, {{'grp': 0, 'term': 1, 'excluded': false, 'x': [x[5]]}}]
    WHEN 2 THEN [{{'grp': 0, 'term': 0, 'excluded': false, 'x': [x[1]]}}, {{'grp': 0, 'term': 1, 'excluded': false, 'x': [x[2]]}}, {{'grp': 1, 'term': 0, 'excluded': false, 'x': [x[6], x[7]]}}]
    ELSE [{{'grp': 0, 'term': 0, 'excluded': false, 'x': [x[3]]}}, {{'grp': 0, 'term': 1, 'excluded': false, 'x': [x[8]]}}, {{'grp': 0, 'term': 2, 'excluded': true, 'x': [x[1]]}}] END, recursive := true)) t
), kept AS (
  SELECT query_id, grp, excluded, min(term) AS term, ws FROM (SELECT *, list_filter(list_transform(x, lambda w, i: {{'o': i, 'w': w}}), lambda y: y.w <> '') AS ws FROM raw) WHERE len(ws) > 0 GROUP BY query_id, grp, excluded, ws
), n AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, grp, excluded ORDER BY term) - 1 AS t, ws[len(ws)].o - ws[1].o + 1 AS width FROM kept
), g AS (SELECT query_id, grp, count(*) AS nt FROM n WHERE NOT excluded GROUP BY ALL),
s AS MATERIALIZED (
  SELECT n.*, d.id, list_filter(range(0, len(d.w)), lambda p: d.w[p + 1] = ws[1].w AND (len(ws) = 1 OR d.w[p + ws[2].o - ws[1].o + 1] = ws[2].w)) AS starts
  FROM n JOIN d ON list_contains(d.w, ws[1].w)
), hit AS (
  SELECT query_id, grp, id, nt FROM s JOIN g USING (query_id, grp) WHERE len(starts) > 0 GROUP BY ALL HAVING count(*) FILTER (NOT excluded) = nt AND count(*) FILTER (excluded) = 0
)"""

_RANK_SQL = f"""{_MATCH_SQL},
e AS (SELECT s.query_id, s.grp, s.id, hit.nt, s.t, s.width, unnest(s.starts) AS pos FROM s JOIN hit USING (query_id, grp, id) WHERE NOT s.excluded),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, grp, id ORDER BY pos, t) AS r, sum(width) OVER (PARTITION BY query_id, grp, id ORDER BY pos, t) - width AS before FROM e),
l AS (
  SELECT *, list_filter([{{'p': max(pos) FILTER (t = 0) OVER y, 'c': max(before) FILTER (t = 0) OVER y}}, {{'p': max(pos) FILTER (t = 1) OVER y, 'c': max(before) FILTER (t = 1) OVER y}},
      {{'p': max(pos) FILTER (t = 2) OVER y, 'c': max(before) FILTER (t = 2) OVER y}}], lambda z: z.p IS NOT NULL) AS seen,
    greatest(max(pos + width) FILTER (t = 0) OVER y, max(pos + width) FILTER (t = 1) OVER y, max(pos + width) FILTER (t = 2) OVER y) - 1 AS last
  FROM f WINDOW y AS (PARTITION BY query_id, grp, id ORDER BY r)
), low AS (SELECT *, list_min(seen) AS low FROM l WHERE len(seen) = nt),
c AS (
  SELECT query_id, grp, id, low.p AS first, last, greatest(0, last - low.p + 1 - (before + width - low.c)) AS noise FROM low
  QUALIFY low.p > coalesce(max(low.p) OVER (PARTITION BY query_id, grp, id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)
), scored AS (
  SELECT query_id, id, round(sum(0.1::DOUBLE / (1 + noise)), 9) AS score, min({{'noise': noise, 'first': first, 'last': last}}) AS best FROM c GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 10)"""


def _search(spark: SparkSession, sf: str) -> tuple[fulltext.FullText, DataFrame]:
    docs, items = views(spark, sf, "documents", "benchmark")
    x = F.regexp_extract_all(F.lower("text"), F.lit(T.WORD), F.lit(1))
    asked = items.select(F.col("item_id").alias("query_id"), x.alias("x"))
    w = lambda i: F.get("x", F.lit(i - 1))
    quoted = lambda a, b: F.concat(F.lit('"'), w(a), F.lit(" "), w(b), F.lit('"'))
    text = (
        F.when(F.col("query_id") % 4 == 0, F.concat_ws(" ", w(1), w(4), w(7)))
        .when(F.col("query_id") % 4 == 1, F.concat_ws(" ", quoted(2, 3), w(5)))
        .when(F.col("query_id") % 4 == 2, F.concat_ws(" ", w(1), w(2), F.lit("or"), quoted(6, 7)))
        .otherwise(F.concat_ws(" ", w(3), w(8), F.concat(F.lit("-"), w(1))))
    )
    return fulltext.build(docs, "doc_id"), asked.select("query_id", text.alias("text"))


@query(f"{_MATCH_SQL} SELECT DISTINCT query_id, id FROM hit")
def fulltext_match(spark: SparkSession, sf: str) -> DataFrame:
    return fulltext.match(*_search(spark, sf))


@query(f"{_RANK_SQL} SELECT query_id, id, round(score, 6) AS score, rank FROM ranked")
def fulltext_rank(spark: SparkSession, sf: str) -> DataFrame:
    found = fulltext.search(*_search(spark, sf), 10)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""{_RANK_SQL}, asked AS (SELECT query_id, list(y.w) AS wanted FROM (SELECT query_id, unnest(ws) AS y FROM n WHERE NOT excluded) GROUP BY query_id),
    h AS (SELECT r.query_id, r.id, r.rank, wanted, regexp_extract_all(text, '{_WORD}') AS own, regexp_split_to_array(text, '{_WORD}') AS gap, d.w, best.first AS a, best.last AS z FROM ranked r JOIN d USING (id) JOIN asked USING (query_id)),
    i AS (SELECT *, least(len(own), greatest(z + 1, a + 15)) AS hi FROM h), j AS (SELECT *, greatest(0, least(a, hi - 15)) AS lo FROM i), k AS (SELECT *, least(hi, lo + 35) AS top FROM j)
    SELECT query_id, id, rank, array_to_string(list_transform(range(CAST(lo AS BIGINT), CAST(top AS BIGINT)), lambda p: CASE WHEN list_contains(wanted, w[p + 1]) THEN '<b>' || own[p + 1] || '</b>' ELSE own[p + 1] END
      || CASE WHEN p < top - 1 THEN gap[p + 2] ELSE '' END), '') AS highlight FROM k"""
)
def fulltext_highlight(spark: SparkSession, sf: str) -> DataFrame:
    index, asked = _search(spark, sf)
    return fulltext.highlight(index, fulltext.search(index, asked, 10), asked).select("query_id", "id", "rank", "highlight")
