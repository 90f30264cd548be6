"""Embedding batches, the object store, the progress stream, citations and contexts over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.operators import citations, embedding, evaluate, experiments, extract, ops, rerank
from orefield.plans.documents import TWO
from orefield.plans.registry import SQL, query, views
from orefield.session import materialize, scratch_path, ship
from orefield.sources import store
from orefield.streaming import progress


@query(
    """WITH h AS (SELECT doc_id, sha256(CASE WHEN coalesce(text, '') = '' THEN '__EMPTY__' ELSE text END || ':salt_0') AS h FROM documents),
    n AS (SELECT doc_id, j AS i, CAST('0x' || h[j * 8 + 1:j * 8 + 8] AS BIGINT)::DOUBLE AS u FROM (SELECT *, unnest(range(8)) AS j FROM h)),
    v AS (SELECT doc_id, i, (CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END) / 2147483648 AS x FROM n)
    SELECT doc_id, CAST(i AS INTEGER) AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS x, 'hash' AS model FROM v"""
)
def embedding_batches(spark: SparkSession, sf: str) -> DataFrame:
    (docs,) = views(spark, sf, "documents")
    made = embedding.embed(docs.select("doc_id", "text"), "text", 8).where("error is null")
    return made.select("doc_id", F.posexplode("embedding").alias("i", "x"), "model").withColumn("x", F.round("x", 6))


@query(
    """WITH k AS (SELECT doc_id, source || '/' || left(sha256(coalesce(text, '')), 2) || '/' || sha256(coalesce(text, '')) || '_report_1.txt' AS key, octet_length(encode(coalesce(text, ''))) AS size FROM documents)
    SELECT doc_id, key, size, true AS same, key NOT IN (SELECT key FROM k WHERE doc_id % 3 = 0) AS found FROM k"""
)
def object_store(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is saved and read back; a third is deleted, and what is left is looked up."""
    (docs,) = views(spark, sf, "documents")
    root = scratch_path(spark, "objects")
    saved = materialize(store.save(docs.withColumn("name", F.lit("x/report 1.txt")), root, "doc_id", "source", "name", "text"), "saved")
    back = materialize(store.get(saved, root).select("id", F.sha2("content", 256).alias("back")), "back")
    materialize(store.delete(saved.where("id % 3 = 0"), root), "deleted")
    left = store.exists(saved, root).select("id", "found")
    out = saved.join(back, "id").join(left, "id")
    return out.select(F.col("id").alias("doc_id"), F.col("storage_key").alias("key"), "size", (F.col("back") == F.col("sha256")).alias("same"), "found")


STAGES = ["view", "click", "signup", "purchase"]


@query(
    """WITH s AS (SELECT CAST(user_id AS VARCHAR) AS run, max(coalesce(list_position(['view', 'click', 'signup', 'purchase'], event_type), 0)) AS place, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id)
    SELECT run, coalesce(['view', 'click', 'signup', 'purchase'][place], '') AS stage, n AS n_events, epoch_us(last) AS last_us, round(place / 4.0::DOUBLE * 100, 1) AS progress, place = 4 AS finished FROM s"""
)
def run_progress(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a stream of stages, one run a user, into the sink, and the sink's newest rows."""
    ship(spark)
    (table,) = views(spark, sf, "events")
    stream = spark.readStream.schema(table.schema).parquet(f"{sf}/events.parquet*")
    rows = stream.select(F.col("user_id").cast("string").alias("run"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("ts"))
    path = scratch_path(spark, "progress")
    progress.upsert_sink(progress.progress(rows, STAGES), path, scratch_path(spark, "progress-state")).awaitTermination()
    out = progress.latest(spark, path)
    return out.select("run", F.coalesce("stage", F.lit("")).alias("stage"), "n_events", F.unix_micros("last_ts").alias("last_us"), "progress", "finished")


@query(
    """SELECT doc_id, trim(coalesce(nullif(left(text, doc_id % 3 * 40), ''), nullif(left(text, doc_id % 2 * 20), ''), text)) AS raw_text, coalesce(nullif(CASE WHEN doc_id % 4 > 0 THEN source ELSE '' END, ''), 'Scientific Document') AS document_title,
      CASE WHEN doc_id % 5 > 0 THEN doc_id % 5 ELSE n_chars END AS bbox, round(n_chars / 7.0::DOUBLE, 4) AS confidence FROM documents"""
)
def citation_metadata(spark: SparkSession, sf: str) -> DataFrame:
    (docs,) = views(spark, sf, "documents")
    text = F.col("text")
    fields = {
        "display_text": F.substr(text, F.lit(1), (F.col("doc_id") % 3 * 40).cast("int")),
        "retrieval_text": F.substr(text, F.lit(1), (F.col("doc_id") % 2 * 20).cast("int")),
        "content": text,
        "title": F.when(F.col("doc_id") % 4 > 0, F.col("source")).otherwise(""),
        "bbox": F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 5),
        "meta_bbox": F.col("n_chars"),
        "score": F.col("n_chars") / 7.0,
    }
    return docs.select("doc_id", citations.metadata(fields).alias("m")).select("doc_id", "m.*")


@query(
    """SELECT avg(CASE WHEN n_chars >= 100 THEN 1 ELSE 0 END) AS long_enough, avg(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, count(*) AS n_cases FROM documents LEFT JOIN labels USING (doc_id)"""
)
def suite_pass_ratios(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = views(spark, sf, "documents", "labels")
    cases = docs.select("doc_id", "n_chars").join(labels, "doc_id", "left")
    return evaluate.pass_ratios(cases, {"long_enough": F.col("n_chars") >= 100, "good": F.col("quality") == 1})


@query(
    """WITH c AS (SELECT doc_id % 40 AS query_id, doc_id AS id, n_chars, text, source, lang, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY n_chars, doc_id) AS pos FROM documents QUALIFY pos <= 3),
    b AS (SELECT query_id, pos, '### Source [' || pos || ']: ' || source || ' | Section: ' || lang || ' | Page: ' || n_chars % 9 || chr(10) || trim(text) || chr(10) AS block FROM c)
    SELECT query_id, sha256(string_agg(block, chr(10) ORDER BY pos)) AS context_sha256 FROM b GROUP BY query_id"""
)
def context_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The three shortest documents of each query as one context, whole texts."""
    (docs,) = views(spark, sf, "documents")
    chunks = docs.select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("id"), (-F.col("n_chars")).alias("score"), "text", F.col("source").alias("title"), F.col("lang").alias("section"), (F.col("n_chars") % 9).alias("page"))
    packed = rerank.pack_context(chunks, max_tokens=1 << 30, reserve=0, max_chunks=3)
    return rerank.context_blocks(packed, chunks).select("query_id", F.sha2("context", 256).alias("context_sha256"))


@query(
    """SELECT 'both' AS kind, doc_id FROM (SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM documents WHERE n_chars > 500)
    UNION ALL SELECT 'unlabelled', doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)"""
)
def id_set_operations(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = views(spark, sf, "documents", "labels")
    both = labels.where("quality = 1").select("doc_id").intersect(docs.where("n_chars > 500").select("doc_id"))
    rest = docs.select("doc_id").subtract(labels.select("doc_id"))
    return both.select(F.lit("both").alias("kind"), "doc_id").unionByName(rest.select(F.lit("unlabelled").alias("kind"), "doc_id"))


# Filters of the listing.
ASKED = {"thf": {"solvent": "tHf"}, "pd": {"catalyst": "PD/"}, "none": {"solvent": "none"}, "phenol": {"chemical": "Phenol"}, "role": {"chemical": "'role': 'product'"}, "bar": {"chemical": "'pressure_bar': 1.5"}}


def _names_sql(c: str, role: str) -> str:
    return f"list_transform(list_filter(string_split({c}, ','), lambda x: x <> ''), lambda x: '{{''role'': ''{role}'', ''name'': ''' || x || '''}}')"


def _listing_sql() -> str:
    shown = lambda c: f"coalesce(CAST({c} AS VARCHAR), 'None')"
    quoted = lambda c: f"coalesce('''' || {c} || '''', 'None')"
    texts = {"solvent": shown("solvent"), "catalyst": shown("catalyst"), "chemical": "everything"}
    parts = []
    for name, filters in ASKED.items():
        ((kind, value),) = filters.items()
        literal = value.replace("'", "''")
        parts.append(f"SELECT '{name}' AS asked, * EXCLUDE (everything) FROM r WHERE contains(lower({texts[kind]}), lower('{literal}'))")
    markers = ", ".join(repr(m) for m in extract.MARKERS)
    return f"""WITH x AS ({SQL["experiment_extract"]}),
    t AS (SELECT p_partkey, list_filter(list_transform(string_split({TWO}, chr(10) || chr(10)), lambda x: trim(x)), lambda x: len(x) > 30 AND len(list_filter([{markers}], lambda w: contains(lower(x), w))) > 0) AS ps FROM part),
    r AS (SELECT x.p_partkey AS document_id, x.p_partkey * 100 + paragraph AS id, strftime(TIMESTAMP '2024-01-01' + to_days(CAST(x.p_partkey % 365 AS INTEGER)), '%Y-%m-%dT%H:%M:%S') AS created_at,
      coalesce(nullif(CASE WHEN doc_id % 4 > 0 THEN source ELSE '' END, ''), 'Scientific Paper') AS document_title, ps[paragraph + 1] AS description, temperature, solvent, catalyst, confidence,
      ps[paragraph + 1] || ' [' || array_to_string(list_concat({_names_sql("reactants", "reactant")}, {_names_sql("products", "product")}), ', ') || '] {{''temperature_celsius'': ' || {shown("temperature")} || ', ''pressure_bar'': ' || {shown("pressure")}
        || ', ''solvent'': ' || {quoted("solvent")} || ', ''catalyst'': ' || {quoted("catalyst")} || ', ''reaction_time_hours'': ' || {shown("hours")} || '}}' AS everything
      FROM x JOIN t USING (p_partkey) JOIN documents ON doc_id = x.p_partkey)
    {" UNION ALL ".join(parts)}"""


@query(_listing_sql())
def experiment_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Experiments extracted from all procedures, listed with their documents under each filter."""
    part, docs = views(spark, sf, "part", "documents")
    key = F.col("p_partkey")
    made = extract.experiments(part.select("p_partkey", F.expr(TWO).alias("text")))
    created = F.timestamp_add("DAY", (key % 365).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    made = made.select(key.alias("document_id"), (key * 100 + F.col("paragraph")).cast("long").alias("id"), created.alias("created_at"), *made.columns[2:])
    titles = docs.select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 4 > 0, F.col("source")).otherwise("").alias("title"))
    out = None
    for name, filters in ASKED.items():
        found = experiments.listing(made, titles, **filters).withColumns({"asked": F.lit(name), "created_at": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")})
        found = found.select("asked", "document_id", "id", "created_at", "document_title", "description", "temperature", "solvent", "catalyst", "confidence")
        out = found if out is None else out.unionByName(found)
    return out


@query(
    """WITH d AS (SELECT doc_id, '  ' || upper(source) || lang || ' ' AS i, sha256(coalesce(text, '')) AS h FROM documents)
    SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'cache:pubchem:name:' || trim(lower(i)) WHEN 1 THEN 'cache:crossref:doi:' || trim(lower(i)) WHEN 2 THEN 'cache:europepmc:query:' || h
      WHEN 3 THEN 'cache:ncbi:' || trim(lower(i)) WHEN 4 THEN 'cache:semanticscholar:' || h END AS key FROM d"""
)
def cache_keys(spark: SparkSession, sf: str) -> DataFrame:
    (docs,) = views(spark, sf, "documents")
    n = F.col("doc_id") % 6
    provider = F.element_at(F.array(*map(F.lit, [*ops.CACHE_KEYS, "unknown"])), (n + 1).cast("int"))
    identifier = F.when(n.isin(2, 4), F.sha2(F.coalesce("text", F.lit("")), 256)).otherwise(F.concat(F.lit("  "), F.upper("source"), "lang", F.lit(" ")))
    return docs.select("doc_id", ops.cache_key(provider, F.lit("name"), identifier, "cache").alias("key"))
