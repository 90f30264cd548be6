"""Usage, jobs, caches, events over time and markup sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.operators import ops, safety
from orefield.plans.registry import query, views
from orefield.sources import markup
from orefield.streaming import events as streams

TASK = "CASE event_id % 4 WHEN 0 THEN 'llm' WHEN 1 THEN 'embedding' WHEN 2 THEN 'external_api' ELSE 'reranker' END"
MODEL = "CASE event_id % 5 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'text-embedding-3-large' WHEN 2 THEN 'cohere-rerank-v3' WHEN 3 THEN 'claude-3-5-sonnet' ELSE 'unknown' END"
_PRICES = ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, a, b in ops.PRICES)


@query(
    f"""WITH p(model, i, o) AS (VALUES {_PRICES}), u AS (SELECT {TASK} AS t, {MODEL} AS model, event_id % 900 AS a, user_id % 300 AS b, event_id % 7 AS c FROM events)
    SELECT sum(a) FILTER (t = 'llm')::BIGINT AS prompt_tokens, sum(b) FILTER (t = 'llm')::BIGINT AS completion_tokens, sum(c) FILTER (t = 'embedding')::BIGINT AS chunks, count(*) FILTER (t = 'external_api') AS calls,
      round(sum(round(a / 1000.0::DOUBLE * coalesce(i, 0) + b / 1000.0::DOUBLE * coalesce(o, 0), 6)), 4) AS cost, count(*) AS records FROM u LEFT JOIN p USING (model)"""
)
def usage_cost(spark: SparkSession, sf: str) -> DataFrame:
    (e,) = views(spark, sf, "events")
    u = e.select(F.expr(TASK).alias("task_type"), F.expr(MODEL).alias("model"), (F.col("event_id") % 900).alias("prompt_tokens"), (F.col("user_id") % 300).alias("completion_tokens"), (F.col("event_id") % 7).alias("chunks"), F.lit(1).alias("calls"))
    return ops.usage_cost(u)


_STAGES = "[" + ", ".join(f"'{s}'" for s in ops.STAGES) + "]"


@query(
    f"""SELECT o_orderkey, {_STAGES}[o_orderkey % 11 + 1] AS stage, round((o_orderkey % 11) / 10.0::DOUBLE * 100, 1) AS progress, {_STAGES}[o_orderkey % 11 + 2] AS next, {_STAGES}[o_orderkey % 11 + 1] AS resume FROM orders"""
)
def job_progress(spark: SparkSession, sf: str) -> DataFrame:
    (o,) = views(spark, sf, "orders")
    stages = F.array(*map(F.lit, ops.STAGES))
    i = (F.col("o_orderkey") % 11).cast("int")
    s = F.get(stages, i)
    return o.select("o_orderkey", s.alias("stage"), ops.progress(s).alias("progress"), ops.next_stage(s).alias("next"), ops.resume_point(F.slice(stages, F.lit(1), i)).alias("resume"))


@query("SELECT event_id, user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS at FROM events ORDER BY event_id DESC LIMIT 50")
def trace_recent(spark: SparkSession, sf: str) -> DataFrame:
    (e,) = views(spark, sf, "events")
    return safety.recent(e, "event_id", 50).select("event_id", "user_id", ops.iso(F.col("ts")).alias("at"))


@query(
    """WITH c AS (SELECT user_id, max(ts) AS stored, user_id % 2 = 0 AS hit FROM events WHERE event_id % 50 = 0 GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
    SELECT DISTINCT user_id FROM events, n WHERE user_id NOT IN (SELECT user_id FROM c, n WHERE stored + CASE WHEN hit THEN INTERVAL 24 HOUR ELSE INTERVAL 1 HOUR END > now)"""
)
def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    (e,) = views(spark, sf, "events")
    cache = e.where("event_id % 50 = 0").groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("stored")).withColumn("value", F.when(F.col("key") % 2 == 0, F.lit("v")))
    now = e.agg(F.max("ts").alias("now"))
    cache = cache.crossJoin(now)  # one row
    keys = e.select(F.col("user_id").alias("key")).distinct()
    return ops.to_look_up(keys, cache, F.col("now")).select(F.col("key").alias("user_id"))


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id % 10 <> 0) AS documents, (SELECT count(*) FROM conversations) AS chunks, (SELECT count(*) FROM embeddings) AS embeddings")
def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    d, c, e = views(spark, sf, "documents", "conversations", "embeddings")
    return ops.index_statistics(d.where("doc_id % 10 <> 0"), c, e)


@query(
    """WITH r AS (SELECT l_orderkey AS query_id, l_partkey AS id, l_linenumber AS rank, l_extendedprice AS score FROM lineitem) SELECT query_id, count(*) AS results_count, sum(rank)::BIGINT AS ranks, round(max(score), 6) AS best FROM r GROUP BY 1"""
)
def search_audit(spark: SparkSession, sf: str) -> DataFrame:
    (li,) = views(spark, sf, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("rank"), F.col("l_extendedprice").alias("score"), F.lit("q").alias("query"))
    q, r = ops.audit_rows(rows)
    return q.join(r.groupBy("query_id").agg(F.sum("rank").alias("ranks"), F.round(F.max("score"), 6).alias("best")), "query_id").drop("query_text")


@query(
    """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang,
      len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs, array_to_string(regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)</h[1-6]>', 1), '|') AS headings FROM pages"""
)
def html_title_extract(spark: SparkSession, sf: str) -> DataFrame:
    return markup.html_pages(views(spark, sf, "pages")[0]).withColumn("headings", F.array_join("headings", "|")).select("page_id", "title", "lang", "n_paragraphs", "headings")


TEI = """'<TEI><title level="a">' || p_name || '</title><idno type="DOI">10.1000/' || CAST(p_partkey AS STRING) || '</idno><author><persName><forename>A</forename><surname>' || p_brand || '</surname></persName><affiliation>Lab ' || CAST(p_size AS STRING) || '</affiliation></author><abstract><p>one</p><p>' || p_type || '</p></abstract><body><div><head>Intro</head><p>x</p></div><div><p>y</p></div></body><formula>a=b</formula></TEI>'"""


@query(
    """SELECT p_partkey, p_name AS title, '10.1000/' || p_partkey AS doi, 'A ' || p_brand AS authors, 'Lab ' || p_size AS affiliations, 'one' || chr(10) || chr(10) || p_type AS abstract, 'Intro:x|Section:y' AS sections, 'a=b' AS formulas FROM part"""
)
def tei_parse(spark: SparkSession, sf: str) -> DataFrame:
    (p,) = views(spark, sf, "part")
    out = markup.tei(p.select("p_partkey", F.expr(TEI).alias("xml")))
    pairs = F.transform("sections", lambda s: F.concat_ws(":", s["title"], s["text"]))
    return out.select("p_partkey", "title", "doi", F.array_join("authors", ",").alias("authors"), F.array_join("affiliations", ",").alias("affiliations"), "abstract", F.array_join(pairs, "|").alias("sections"), F.array_join("formulas", ",").alias("formulas"))


RECORDS = """CASE p_partkey % 3 WHEN 0 THEN '{"title": ["' || p_name || '"], "author": [{"given": "A", "family": "B"}], "issued": {"date-parts": [[2001]]}, "container-title": ["J"], "DOI": "10.1/' || CAST(p_partkey AS STRING) || '"}'
  WHEN 1 THEN '{"title": "' || p_name || '", "authorships": [{"author": {"display_name": "C"}}], "doi": "https://doi.org/10.1/' || CAST(p_partkey AS STRING) || '", "publication_year": 2002, "abstract_inverted_index": {"b": [1], "a": [0, 2]}}'
  ELSE '{"title": "' || p_name || '.", "authors": [{"name": "D"}], "source": "S", "pubdate": "2003 Jan", "articleids": [{"idtype": "doi", "value": "10.1/' || CAST(p_partkey AS STRING) || '"}]}' END"""
PROVIDER = "CASE p_partkey % 3 WHEN 0 THEN 'crossref' WHEN 1 THEN 'openalex' ELSE 'pubmed' END"


@query(
    f"""SELECT p_partkey, {PROVIDER} AS provider, p_name AS title, ['A B', 'C', 'D'][p_partkey % 3 + 1] AS authors, '10.1/' || p_partkey AS doi, 2001 + p_partkey % 3 AS year, ['J', NULL, 'S'][p_partkey % 3 + 1] AS journal,
      CASE WHEN p_partkey % 3 = 1 THEN 'a b a' END AS abstract FROM part"""
)
def scholarly_records(spark: SparkSession, sf: str) -> DataFrame:
    (p,) = views(spark, sf, "part")
    rows = p.select("p_partkey", F.expr(PROVIDER).alias("provider"), F.expr(RECORDS).alias("json"))
    out = markup.scholarly(rows)
    return out.select("p_partkey", "provider", "title", F.array_join("authors", ",").alias("authors"), "doi", F.col("year").cast("long").alias("year"), "journal", "abstract")


@query(
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"""
)
def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return streams.tumbling(views(spark, sf, "events")[0], "1 hour").withColumn("total", F.round("total", 4))


@query(
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, g"""
)
def events_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return streams.sessions(views(spark, sf, "events")[0], "30 minutes")
