"""Retrieval, fusion, reranking, context and evaluation queries.

Documents and vectors are aligned by doc_id = vec_id, benchmark items ask, and the item_id-th vector is the item's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.functions import text as T
from orefield.functions import vectors as V
from orefield.operators import evaluate, fingerprints, fusion, rerank, retrieval, vector_index
from orefield.plans.registry import query, views

WORDS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+'))"
_DOT = "list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"
_NORMS = "(sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])))"
SCORES = {"cosine": f"{_DOT} / {_NORMS}", "ip": _DOT, "l2": "-list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"}


def _vector_sql(metric: str, k: int, where: str = "true", asked: str = "q.vec_id % 20 = 0") -> str:
    return f"""
      SELECT q.vec_id AS query_id, e.vec_id AS id, round({SCORES[metric]}, 6) AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY {SCORES[metric]} DESC, e.vec_id) AS rank
      FROM embeddings q, embeddings e WHERE {asked} AND {where} QUALIFY rank <= {k}"""


def _asked(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("tag"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _topk(metric: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        (e,) = views(spark, sf, "embeddings")
        return _rounded(retrieval.vector_topk(_asked(e), e, 10, metric, id_col="vec_id"), "score")

    return run


for _m in retrieval.METRICS:
    query(_vector_sql(_m, 10), f"vector_topk_{_m}")(_topk(_m))


@query(_vector_sql("cosine", 5, "e.label IN (1, 3)"))
def filtered_vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    (e,) = views(spark, sf, "embeddings")
    own = retrieval.filter_chunks(e, sections=[1, 3], columns={"section": "label"})
    return _rounded(retrieval.vector_topk(_asked(e), own, 5, id_col="vec_id"), "score")


def _index_sql(k: int, share: float, rounds: int = vector_index.ROUNDS) -> str:
    """The index in whole numbers: v (id, tag, e, x), cells of each row in w, cell orders of the queries in o, probes in p."""
    near = lambda c: f"list_dot_product({c}.c, {c}.c) - 2 * list_dot_product(v.x, {c}.c), {c}.cell"
    fit = "".join(
        f"""
    a{r} AS MATERIALIZED (SELECT v.id, v.x, c.cell FROM v, c{r} c QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY {near("c")}) = 1),
    s{r} AS (SELECT cell, list(m ORDER BY i) AS c FROM (SELECT cell, i, floor(sum(y) / count(*)) AS m FROM (SELECT cell, unnest(range(len(x))) AS i, unnest(x) AS y FROM a{r}) GROUP BY ALL) GROUP BY cell),
    c{r + 1} AS MATERIALIZED (SELECT c{r}.cell, coalesce(s{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN s{r} USING (cell)),"""
        for r in range(rounds)
    )
    return f"""
    v AS MATERIALIZED (SELECT vec_id AS id, label AS tag, embedding::DOUBLE[] AS e, sqrt(list_dot_product(e, e)) AS norm, list_transform(e, lambda y: CASE WHEN norm = 0 THEN 0 ELSE floor(y / norm * {vector_index.GRID}) END) AS x FROM embeddings),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) - 1 AS cell, x AS c FROM v QUALIFY cell < (SELECT greatest(1, floor(sqrt(count(*)))) FROM v)),{fit}
    w AS MATERIALIZED (SELECT v.id, v.tag, v.e, v.norm, c.cell FROM v, c{rounds} c QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY {near("c")}) = 1),
    o AS MATERIALIZED (SELECT v.id AS query_id, v.tag AS want, c.cell, row_number() OVER (PARTITION BY v.id ORDER BY {near("c")}) AS place FROM v, c{rounds} c WHERE v.id % 20 = 0),
    d AS MATERIALIZED (SELECT q.id AS query_id, q.tag AS want, w.id, w.tag, w.cell, list_dot_product(q.e, w.e) / (q.norm * w.norm) AS score FROM v q, w WHERE q.id % 20 = 0),
    t AS MATERIALIZED (SELECT o.place, count(*) AS n FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {k}) e JOIN o USING (query_id, cell)
      WHERE query_id IN (SELECT id FROM v WHERE id % 20 = 0 ORDER BY md5(CAST(id AS VARCHAR)), id LIMIT {vector_index.PROBE_QUERIES}) GROUP BY o.place),
    p AS MATERIALIZED (SELECT min(place) AS probes FROM (SELECT place, sum(n) OVER (ORDER BY place) AS up, sum(n) OVER () AS total FROM t) WHERE up >= {share} * total - 1e-9)"""


def _index(spark: SparkSession, sf: str, k: int, share: float) -> tuple[vector_index.VectorIndex, DataFrame, int]:
    (e,) = views(spark, sf, "embeddings")
    index = vector_index.build(e, "vec_id", tag_col="label")
    return index, _asked(e), vector_index.settle_probes(index, _asked(e), k, share)


@query(
    f"""WITH {_index_sql(10, 0.95)}
    SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY d.score DESC, id) AS rank
    FROM d JOIN o USING (query_id, cell), p WHERE o.place <= probes QUALIFY rank <= 10"""
)
def ann_vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    index, asked, probes = _index(spark, sf, 10, 0.95)
    return _rounded(vector_index.search(index, asked, 10, probes), "score")


@query(
    f"""WITH {_index_sql(10, 0.95)},
    exact AS (SELECT query_id, id, cell FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10)
    SELECT count(DISTINCT query_id) AS n_queries, round(avg(CASE WHEN o.place <= probes THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall,
      round((SELECT sum(n) FROM (SELECT o.query_id, count(*) AS n FROM o JOIN w USING (cell), p WHERE o.place <= probes GROUP BY o.query_id)) / (SELECT count(*) FROM d), 6) AS rows_read
    FROM exact JOIN o USING (query_id, cell), p"""
)
def ann_recall(spark: SparkSession, sf: str) -> DataFrame:
    index, asked, probes = _index(spark, sf, 10, 0.95)
    return _rounded(vector_index.recall(index, asked, 10, probes), "recall", "rows_read")


_FILTER_SQL = f"""WITH {_index_sql(5, 0.95)},
    k AS (SELECT o.*, coalesce(n.own, 0) AS own, coalesce(a.n, 0) AS alln, coalesce(sum(n.own) OVER (PARTITION BY o.query_id ORDER BY place), 0) - coalesce(n.own, 0) AS before
      FROM o LEFT JOIN (SELECT cell, tag, count(*) AS own FROM w GROUP BY ALL) n ON n.cell = o.cell AND n.tag = o.want LEFT JOIN (SELECT cell, count(*) AS n FROM w GROUP BY ALL) a ON a.cell = o.cell),
    m AS (SELECT query_id, CASE WHEN coalesce(sum(own) FILTER (place <= probes), 0) * 30 >= 10 * sum(alln) FILTER (place <= probes) THEN 'post' ELSE 'pre' END AS mode FROM k, p GROUP BY query_id),
    post AS (SELECT query_id, id, score FROM (SELECT d.* FROM d JOIN o USING (query_id, cell), p WHERE o.place <= probes QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 30)
      WHERE tag = want QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5),
    pre AS (SELECT d.query_id, id, score FROM d JOIN k USING (query_id, cell), p WHERE d.tag = d.want AND own > 0 AND (place <= probes OR before < 30)
      QUALIFY row_number() OVER (PARTITION BY d.query_id ORDER BY score DESC, id) <= 5)"""


@query(
    f"""{_FILTER_SQL},
    exact AS (SELECT query_id, id FROM d WHERE tag = want QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5),
    r AS (SELECT q.id AS query_id, round(100.0 * (SELECT count(*) FROM v WHERE tag = q.tag) / (SELECT count(*) FROM v), 6) AS selectivity,
      (SELECT count(*) FROM pre JOIN exact USING (query_id, id) WHERE pre.query_id = q.id)::DOUBLE / (SELECT count(*) FROM exact WHERE query_id = q.id) AS pre_recall,
      (SELECT count(*) FROM post JOIN exact USING (query_id, id) WHERE post.query_id = q.id)::DOUBLE / (SELECT count(*) FROM exact WHERE query_id = q.id) AS post_recall
      FROM v q WHERE q.id % 20 = 0)
    SELECT query_id, selectivity, mode, pre_recall, post_recall, round(pre_recall - post_recall, 6) AS recall_delta FROM r JOIN m USING (query_id)"""
)
def ann_filter_recall(spark: SparkSession, sf: str) -> DataFrame:
    index, asked, probes = _index(spark, sf, 5, 0.95)
    return _rounded(vector_index.filter_recall(index, asked, 5, 30, probes), "selectivity", "recall_delta")


@query(
    f"""{_FILTER_SQL}
    SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY x.score DESC, id) AS rank
    FROM (SELECT pre.* FROM pre JOIN m USING (query_id) WHERE mode = 'pre' UNION ALL SELECT post.* FROM post JOIN m USING (query_id) WHERE mode = 'post') x"""
)
def ann_filtered_topk(spark: SparkSession, sf: str) -> DataFrame:
    index, asked, probes = _index(spark, sf, 5, 0.95)
    plan = vector_index.plan_filter(index, asked, 5, 30, probes)
    return _rounded(vector_index.filtered_search(index, plan, 5, 30), "score")


OVERLAP = f"""
  b AS (SELECT item_id AS query_id, {WORDS.format("text")} AS qw FROM benchmark),
  d AS (SELECT doc_id AS id, text, {WORDS.format("text")} AS dw FROM documents),
  overlap AS (SELECT query_id, id, len(list_intersect(qw, dw)) / greatest(len(qw), 1) AS score FROM b, d),
  lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM overlap WHERE score > 0 QUALIFY rank <= 20)"""


def _lexical(spark: SparkSession, sf: str, k: int) -> DataFrame:
    docs, items = views(spark, sf, "documents", "benchmark")
    return retrieval.token_overlap_topk(items.withColumnRenamed("item_id", "query_id"), docs.withColumnRenamed("doc_id", "id"), k)


@query(f"WITH {OVERLAP} SELECT query_id, id, round(score, 6) AS score, rank FROM lexical WHERE rank <= 10")
def lexical_token_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_lexical(spark, sf, 10), "score")


SEMANTIC = f"semantic AS ({_vector_sql('cosine', 20, 'true', 'q.vec_id IN (SELECT item_id FROM benchmark)')})"
FUSED = f"""{OVERLAP}, {SEMANTIC},
  u AS (SELECT query_id, id, score, rank, 's' AS m FROM semantic UNION ALL SELECT query_id, id, score, rank, 'l' FROM lexical),
  fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf, max(score) AS best,
    max(rank) FILTER (m = 's') AS semantic_rank, max(rank) FILTER (m = 'l') AS lexical_rank FROM u GROUP BY query_id, id),
  rrf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, best DESC, CAST(id AS VARCHAR)) AS rank FROM fused)"""


def _lists(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    e, items = views(spark, sf, "embeddings", "benchmark")
    asked = e.join(items.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    return {"semantic": _rounded(retrieval.vector_topk(asked, e, 20, id_col="vec_id"), "score"), "lexical": _lexical(spark, sf, 20)}


@query(f"WITH {FUSED} SELECT query_id, id, rrf, round(best, 6) AS best, coalesce(semantic_rank, 0) AS semantic_rank, coalesce(lexical_rank, 0) AS lexical_rank, rank FROM rrf WHERE rank <= 10")
def rrf_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    fused = _rounded(fusion.rrf_fuse(_lists(spark, sf), top=10), "best")
    return fused.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("semantic_rank", "lexical_rank")})


@query(
    f"""WITH {OVERLAP}, {SEMANTIC},
    s AS (SELECT query_id, id, round(sum(x), 12) AS score FROM (SELECT query_id, id, 0.65::DOUBLE * score AS x FROM lexical
      UNION ALL SELECT query_id, id, (1 - 0.65::DOUBLE) * score FROM semantic) GROUP BY query_id, id)
    SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, id) AS rank FROM s QUALIFY rank <= 10"""
)
def weighted_linear_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    lists = _lists(spark, sf)
    return _rounded(fusion.linear_hybrid(lists["lexical"], lists["semantic"]), "score")


ENTITY = (
    "p_partkey AS id, 'KEY' || lpad(CAST(p_partkey AS STRING), 11, '0') || '-UHFFFAOYSA-N' AS inchi_key, repeat('C', p_size % 9 + 1) || CASE p_partkey % 7 WHEN 0 THEN 'O' WHEN 1 THEN 'N' WHEN 2 THEN '(=O)O'"
    " WHEN 3 THEN 'c1ccccc1' WHEN 4 THEN '(Cl)Br' WHEN 5 THEN '[N+](=O)[O-]' ELSE '' END AS smiles, CAST(p_partkey + 100 AS STRING) || '-11-' || CAST(p_partkey % 10 AS STRING) AS cas, p_name AS name"
)
CHEM_QUERIES = """(VALUES (1, 'KEY00000000017-UHFFFAOYSA-N'), (2, 'CCCCCO'), (3, '140-11-0'), (4, 'lemon'), (5, 'CC_2'), (6, 'KEY'), (7, 'CCCc1ccccc1'), (8, 'CCC(=O)O'), (9, 'CCCC[N+](=O)[O-]'))"""


def _bits_sql(s: str) -> str:
    """The set bits of a notation; runs of one to three tokens, a bit by the hash of each."""
    tokens = f"regexp_extract_all({s}, '(\\[[^\\]]*\\]|Br|Cl|%\\d\\d|.)', 1)"
    run = lambda n: f"list_transform(range(1, len({tokens}) - {n - 2}), lambda i: array_to_string({tokens}[i:i + {n - 1}], ' '))"
    return f"list_distinct(list_transform({' || '.join(map(run, (1, 2, 3)))}, lambda r: CAST('0x' || md5(r)[1:8] AS BIGINT) % {fingerprints.BITS}))"


@query(
    f"""WITH e AS (SELECT *, {_bits_sql("smiles")} AS f FROM (SELECT {ENTITY} FROM part)),
    q AS (SELECT *, CASE WHEN regexp_matches(q, '^C') THEN {_bits_sql("q")} ELSE [] END AS f FROM {CHEM_QUERIES} AS t(query_id, q)),
    hits AS (
      SELECT query_id, id, 1.0::DOUBLE AS score, 'identity' AS source, 1 AS p FROM q, e WHERE inchi_key = q OR smiles = q OR (len(q) - len(replace(q, '-', '')) = 2 AND cas = q)
      UNION ALL SELECT query_id, id, 0.9, 'name', 2 FROM q, e WHERE contains(lower(name), lower(q))
      UNION ALL SELECT query_id, id, s, 'similarity', 3 FROM (SELECT query_id, id, len(list_intersect(q.f, e.f)) / len(list_distinct(q.f || e.f)) AS s FROM q, e WHERE len(q.f) > 0) WHERE s >= 0.5)
    SELECT query_id, id, round(arg_min(score, p), 6) AS score, arg_min(source, p) AS source, round(max(score) FILTER (p = 3), 6) AS similarity
    FROM hits GROUP BY query_id, id"""
)
def chemical_priority_union(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = views(spark, sf, "part")
    e = part.selectExpr(*(x.strip() for x in _split(ENTITY)))
    q = spark.sql(f"SELECT * FROM {CHEM_QUERIES} AS t(query_id, q)")
    pairs = e.crossJoin(F.broadcast(q))  # nine fixed queries
    identity = pairs.where(retrieval.identity_match({k: F.col(k) for k in ("inchi_key", "smiles", "cas")}, F.col("q")))
    names = pairs.where(F.contains(F.lower("name"), F.lower("q")))
    similar = fingerprints.similar(q.where("q like 'C%'").withColumnRenamed("q", "smiles"), e)
    return _rounded(retrieval.chemical_union(identity, names, similar), "score", "similarity")


@query(
    f"""WITH e AS (SELECT id, {_bits_sql("smiles")} AS f FROM (SELECT {ENTITY} FROM part))
    SELECT a.id AS query_id, b.id, round(len(list_intersect(a.f, b.f)) / len(list_distinct(a.f || b.f)), 6) AS score FROM e a, e b
    WHERE a.id % 20 = 0 AND len(list_intersect(a.f, b.f)) >= 0.8::DOUBLE * len(list_distinct(a.f || b.f))"""
)
def fingerprint_similarity(spark: SparkSession, sf: str) -> DataFrame:
    (part,) = views(spark, sf, "part")
    e = part.selectExpr(*(x.strip() for x in _split(ENTITY))).select("id", "smiles")
    return fingerprints.similar(e.where("id % 20 = 0").withColumnRenamed("id", "query_id"), e, 0.8, digits=6)


def _split(exprs: str) -> list[str]:
    """Top-level commas of a select list."""
    out, depth, quoted = [""], 0, False
    for c in exprs:
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return out


RERANKED = f"""{FUSED},
  pool AS (SELECT r.query_id, r.id, r.rrf AS retrieval_score, r.rank AS pre_rank, b.text AS query, d.text
    FROM rrf r JOIN benchmark b ON b.item_id = r.query_id JOIN documents d ON d.doc_id = r.id WHERE r.rank <= 50),
  toks AS (SELECT *, {WORDS.format("query")} AS qw, {WORDS.format("text")} AS tw FROM pool),
  x AS (SELECT *, len(list_intersect(qw, tw)) AS n, len(list_distinct(qw || tw)) AS u FROM toks),
  scored AS (SELECT query_id, id, pre_rank, retrieval_score, round(1 / (1 + exp(-2.5::DOUBLE * (
    0.5::DOUBLE * n / len(qw) + 0.3::DOUBLE * n / greatest(u, 1) + CASE WHEN contains(lower(text), lower(query)) THEN 0.2::DOUBLE ELSE 0 END
    + 0.4::DOUBLE * len(list_filter(regexp_extract_all(query, '\\b(\\d{{2,7}}-\\d{{2}}-\\d)\\b', 1), lambda v: contains(text, v)))
    + 0.25::DOUBLE * len(list_filter(regexp_extract_all(query, '\\b((?:[A-Z][a-z]?\\d*){{2,}})\\b', 1), lambda v: contains(text, v))) - 0.5::DOUBLE))), 4) AS score FROM x),
  reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, retrieval_score DESC, CAST(id AS VARCHAR)) AS rank FROM scored QUALIFY rank <= 10)"""


def _reranked(spark: SparkSession, sf: str) -> DataFrame:
    docs, items = views(spark, sf, "documents", "benchmark")
    fused = fusion.rrf_fuse(_lists(spark, sf), top=50)
    pool = fused.join(items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    pool = pool.join(docs.select(F.col("doc_id").alias("id"), "text", "source"), "id")
    return rerank.rerank(pool.withColumnRenamed("rrf", "retrieval_score"))


@query(f"WITH {RERANKED} SELECT query_id, id, pre_rank, score, rank FROM reranked")
def rerank_lexical(spark: SparkSession, sf: str) -> DataFrame:
    return _reranked(spark, sf).select("query_id", "id", "pre_rank", "score", "rank")


@query(
    """SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS content_hash,
      row_number() OVER (PARTITION BY trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) ORDER BY doc_id) = 1 AS first FROM documents"""
)
def context_dedup(spark: SparkSession, sf: str) -> DataFrame:
    (docs,) = views(spark, sf, "documents")
    chunks = docs.select("doc_id", "text", F.col("doc_id").alias("position"), F.lit(0).alias("query_id"))
    kept = rerank.dedup_context(chunks).select("doc_id", F.lit(True).alias("first"))
    hashed = docs.select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return hashed.join(kept, "doc_id", "left").withColumn("first", F.coalesce("first", F.lit(False)))


PACK_SQL = """
WITH RECURSIVE c AS (
  SELECT doc_id % 40 AS query_id, doc_id AS id, n_chars, text, source AS title, lang AS section, CAST(n_chars % 9 AS INTEGER) AS page,
    row_number() OVER (PARTITION BY doc_id % 40 ORDER BY n_chars DESC, doc_id) AS pos FROM documents
), fold AS (
  SELECT query_id, CAST(0 AS BIGINT) AS pos, CAST(-1 AS BIGINT) AS id, 0 AS n, 0 AS total, false AS used, 0 AS tokens FROM (SELECT DISTINCT query_id FROM c)
  UNION ALL
  SELECT query_id, pos, id, CASE WHEN fits THEN n + 1 ELSE n END, CASE WHEN fits THEN total + cost ELSE total END, fits, cost FROM (
    SELECT c.query_id, c.pos, c.id, f.n, f.total, b.cost, f.n < 8 AND f.total + b.cost <= 1000 AS fits
    FROM fold f JOIN c ON c.query_id = f.query_id AND c.pos = f.pos + 1,
    LATERAL (SELECT '### Source [' || (f.n + 1) || ']: ' || c.title || ' | Section: ' || c.section || ' | Page: ' || c.page || chr(10) || trim(c.text) || chr(10) AS block) k,
    LATERAL (SELECT greatest(1, CAST(floor(greatest(len(regexp_extract_all(k.block, '\\S+')) * 1.3::DOUBLE, length(k.block) / 3.8::DOUBLE)) AS INTEGER)) AS cost) b)
)
SELECT query_id, id, used, CASE WHEN used THEN n ELSE 0 END AS number, tokens FROM fold WHERE pos > 0
"""


@query(PACK_SQL)
def context_budget(spark: SparkSession, sf: str) -> DataFrame:
    (docs,) = views(spark, sf, "documents")
    chunks = docs.select(
        (F.col("doc_id") % 40).alias("query_id"),
        F.col("doc_id").alias("id"),
        F.col("n_chars").alias("score"),
        "text",
        F.col("source").alias("title"),
        F.col("lang").alias("section"),
        (F.col("n_chars") % 9).cast("int").alias("page"),
    )
    return rerank.pack_context(chunks, max_tokens=2000, reserve=1000, max_chunks=8).withColumn("number", F.coalesce("number", F.lit(0)))


METRIC_SQL = f"""WITH {FUSED},
  lists AS (SELECT query_id, list(id ORDER BY rank) AS retrieved FROM rrf WHERE rank <= 10 GROUP BY query_id),
  good AS (SELECT b.item_id AS query_id, list(l.doc_id ORDER BY l.doc_id) FILTER (l.doc_id % 40 = b.item_id % 40) AS expected
    FROM benchmark b, (SELECT doc_id FROM labels WHERE quality = 1) l WHERE l.doc_id % 40 = b.item_id % 40 GROUP BY b.item_id),
  j AS (SELECT query_id, retrieved, coalesce(expected, []) AS expected FROM lists LEFT JOIN good USING (query_id)),
  h AS (SELECT *, list_transform(retrieved[1:5], lambda x, i: CASE WHEN list_contains(expected, x) THEN 1 / log2(i + 1) ELSE 0 END) AS gains,
    list_filter(list_transform(retrieved, lambda x, i: CASE WHEN list_contains(expected, x) THEN i END), lambda x: x IS NOT NULL) AS ranks FROM j),
  m AS (SELECT query_id,
    CASE WHEN len(expected) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(retrieved[1:5], expected)) / len(expected) END AS recall,
    len(list_filter(retrieved[1:5], lambda x: list_contains(expected, x))) / len(retrieved[1:5]) AS precision,
    CASE WHEN len(ranks) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / ranks[1] END AS rr,
    CASE WHEN len(expected) = 0 THEN 1.0::DOUBLE ELSE list_sum(gains) / list_sum(list_transform(range(1, CAST(least(5, len(expected)) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) END AS ndcg FROM h)"""


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    (labels,) = views(spark, sf, "labels")
    fused = fusion.rrf_fuse(_lists(spark, sf), top=10)
    lists = fused.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("retrieved"))
    good = labels.where("quality = 1").groupBy((F.col("doc_id") % 40).alias("part")).agg(F.sort_array(F.collect_list("doc_id")).alias("expected"))
    joined = lists.join(good, F.col("query_id") % 40 == F.col("part"), "left")
    return evaluate.ir_metrics(joined.withColumn("expected", F.coalesce("expected", F.array().cast("array<bigint>"))))


_METRICS = ("recall", "precision", "rr", "ndcg")


@query(METRIC_SQL + " SELECT query_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _METRICS) + " FROM m")
def ir_metrics_per_query(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_judged(spark, sf), *_METRICS)


@query(METRIC_SQL + " SELECT " + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in _METRICS) + ", count(*) AS n_queries FROM m")
def ir_metrics_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.suite_means(_judged(spark, sf)), *(f"mean_{c}" for c in _METRICS))


@query(
    METRIC_SQL
    + """, a AS (SELECT avg(recall) AS recall_at_5, avg(precision) AS precision_at_5, avg(rr) AS mrr FROM m)
    SELECT metric, round(value, 6) AS value, target, value >= target AS passed FROM (
      SELECT 'recall_at_5' AS metric, recall_at_5 AS value, 0.8::DOUBLE AS target FROM a UNION ALL SELECT 'precision_at_5', precision_at_5, 0.0 FROM a
      UNION ALL SELECT 'mrr', mrr, 0.01 FROM a)"""
)
def regression_gate(spark: SparkSession, sf: str) -> DataFrame:
    m = _judged(spark, sf).agg(F.avg("recall").alias("recall_at_5"), F.avg("precision").alias("precision_at_5"), F.avg("rr").alias("mrr"))
    return _rounded(evaluate.regression_gate(m, {"recall_at_5": 0.8, "precision_at_5": 0.0, "mrr": 0.01}), "value")


@query(
    """SELECT event_type, list_sort(list(value))[CAST(floor(0.5 * (count(*) - 1)) AS INTEGER) + 1] AS p50,
      list_sort(list(value))[CAST(floor(0.95 * (count(*) - 1)) AS INTEGER) + 1] AS p95, list_sort(list(value))[CAST(floor(0.99 * (count(*) - 1)) AS INTEGER) + 1] AS p99
    FROM events WHERE value IS NOT NULL GROUP BY event_type"""
)
def latency_floor_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    (events,) = views(spark, sf, "events")
    return evaluate.floor_percentiles(events, "value", by="event_type")


@query("SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{int(p * 100)}" for p in (0.5, 0.95, 0.99)) + " FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    (events,) = views(spark, sf, "events")
    return _rounded(evaluate.percentiles(events, "value", by="event_type"), "p50", "p95", "p99")


LONG = "list_filter(" + WORDS + ", lambda w: len(w) >= 4)"
RAGAS_SQL = f"""
WITH t AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, role, text FROM conversations),
i AS (
  SELECT u.id, coalesce(u.text, '') AS question, coalesce(a.text, '') AS answer, CASE WHEN d.text IS NULL THEN [] ELSE [d.text, u.text] END AS contexts, coalesce(a.text, '') AS expected
  FROM t u JOIN t a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' LEFT JOIN documents d ON d.doc_id = u.conv_id AND u.conv_id % 3 <> 0
  WHERE u.role = 'user'
), x AS (
  SELECT *, {LONG.format("question")} AS q, lower(array_to_string(contexts, ' ')) AS joined,
    list_filter(list_transform(regexp_split_to_array(answer, '[.!?]'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: len(s) > 10) AS claims FROM i
), r AS (
  SELECT id,
    CASE WHEN len(contexts) = 0 THEN 0.0::DOUBLE WHEN len(q) = 0 THEN 1.0 ELSE len(list_filter(contexts, lambda c: len(list_filter(q, lambda w: contains(lower(c), w))) > 0)) / len(contexts) END AS context_precision,
    CASE WHEN len(contexts) = 0 OR len(claims) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(claims, lambda s: len({LONG.format("s")}) = 0 OR len(list_filter({LONG.format("s")}, lambda v: contains(joined, v))) > 0)) / len(claims) END AS context_recall,
    CASE WHEN answer = '' THEN 1.0::DOUBLE WHEN len(contexts) = 0 THEN 0.0 WHEN len(claims) = 0 THEN 1.0 ELSE len(list_filter(claims, lambda s: len({LONG.format("s")}) = 0
      OR len(list_filter({LONG.format("s")}, lambda v: contains(joined, v))) / len({LONG.format("s")}) >= 0.4::DOUBLE)) / len(claims) END AS faithfulness,
    CASE WHEN question = '' OR answer = '' THEN 0.0::DOUBLE WHEN len(q) = 0 THEN 1.0 ELSE len(list_filter(q, lambda w: contains(lower(answer), w))) / len(q) END AS answer_relevance FROM x
)
SELECT id, round(context_precision, 6) AS context_precision, round(context_recall, 6) AS context_recall, round(faithfulness, 6) AS faithfulness,
  round(answer_relevance, 6) AS answer_relevance, round((context_precision + context_recall + faithfulness + answer_relevance) / 4, 6) AS overall FROM r
"""


@query(RAGAS_SQL)
def ragas_scores(spark: SparkSession, sf: str) -> DataFrame:
    turns, docs = views(spark, sf, "conversations", "documents")
    users = turns.where("role = 'user'").select("conv_id", F.col("turn"), F.coalesce("text", F.lit("")).alias("question"), F.col("text").alias("u"))
    replies = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.coalesce("text", F.lit("")).alias("answer"))
    found = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("d"))
    items = users.join(replies, ["conv_id", "turn"]).join(found, "conv_id", "left")
    contexts = F.when(F.col("d").isNull(), F.array().cast("array<string>")).otherwise(F.array("d", "u"))
    items = items.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "question", "answer", contexts.alias("contexts"), F.col("answer").alias("expected"))
    out = evaluate.answer_ratios(items)
    return _rounded(out, *out.columns[1:])


@query(
    """WITH h AS (SELECT doc_id, k, sha256(CASE WHEN t = '' THEN '__EMPTY__' ELSE t END || ':salt_' || k) AS h FROM (SELECT doc_id, coalesce(text, '') AS t, unnest([0, 1]) AS k FROM documents)),
    n AS (SELECT doc_id, k * 8 + j AS i, CAST('0x' || h[j * 8 + 1:j * 8 + 8] AS BIGINT)::DOUBLE AS u FROM (SELECT *, unnest(range(8)) AS j FROM h)),
    v AS (SELECT doc_id, i, (CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END) / 2147483648 AS x FROM n)
    SELECT doc_id, CAST(i AS INTEGER) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS x FROM v"""
)
def hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    (docs,) = views(spark, sf, "documents")
    v = V.check_dimensions(V.hash_vector(F.coalesce("text", F.lit("")), 16), 16)
    return docs.select("doc_id", F.posexplode(v).alias("i", "x")).withColumn("x", F.round("x", 6))


@query(
    """SELECT vec_id, CAST(i AS INTEGER) AS i, round(CASE WHEN n = 0 THEN x ELSE x / n END, 6) AS x FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS x,
      sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)"""
)
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    (e,) = views(spark, sf, "embeddings")
    return e.select("vec_id", F.posexplode(V.l2_normalize("embedding")).alias("i", "x")).withColumn("x", F.round("x", 6))


@query(
    """SELECT doc_id, greatest(len(regexp_extract_all(text, '\\S+')), CAST(floor(length(text) / 4) AS INTEGER)) AS by_quarter,
      CASE WHEN text = '' THEN 0 ELSE greatest(1, CAST(floor(greatest(len(regexp_extract_all(text, '\\S+')) * 1.3::DOUBLE, length(text) / 3.8::DOUBLE)) AS INTEGER)) END AS calibrated,
      sha256(text) AS raw_hash, left(sha256(text), 32) AS short_hash FROM documents"""
)
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    (docs,) = views(spark, sf, "documents")
    t = F.col("text")
    return docs.select("doc_id", T.estimate_by_quarter(t).cast("long").alias("by_quarter"), T.estimate_calibrated(t).cast("long").alias("calibrated"), F.sha2("text", 256).alias("raw_hash"), F.substring(F.sha2("text", 256), 1, 32).alias("short_hash"))
